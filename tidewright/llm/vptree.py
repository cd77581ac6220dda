"""Exact neighbours of 64-bit fingerprints by vantage-point trees under Hamming distance.

A fingerprint is cut into ``blocks`` equal blocks. Two that differ in at most
``radius`` bits differ in at most ``radius // blocks`` bits in some block, so a
tree for each block, searched with that smaller radius, loses no pair, and its
triangle bounds prune far better than bounds on all 64 bits would (random
fingerprints lie 32 +- 4 bits apart). Values that are equal in a block can't be
told apart by its tree, so for many values each choice of two blocks of
``radius + 2`` has a tree: in one of them the two values are equal.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np


def block_masks(blocks: int, keep: int = 1) -> list[int]:
    """The bits of each choice of ``keep`` of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(some) for some in combinations(each, keep)]


def block_radius(radius: int, blocks: int, keep: int = 1) -> int:
    """How many bits two values within ``radius`` differ in, at most, in some choice of blocks: none if that many blocks are sure to be equal."""
    return 0 if keep <= blocks - radius else radius * keep // blocks


#: Links that are looked at together.
CHUNK = 1 << 13


@dataclass
class Node:
    """Inside: distance to the vantage point at most ``cut``; a leaf has a number and no children."""

    leaf: int = -1
    vantage: int = 0
    cut: int = 0
    inside: Node | None = None
    outside: Node | None = None


def _split(values: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """A vantage point, a cut and the distances to it; None if all values are one.

    The vantage point is the value farthest from the first one, which spreads
    the distances; the cut is the one that halves the values best.
    """
    vantage = values[int(np.argmax(np.bitwise_count(values ^ values[0])))]
    d = np.bitwise_count(values ^ vantage)
    counts = np.cumsum(np.bincount(d, minlength=65))
    at = np.nonzero(counts[:-1] < len(values))[0]
    at = at[counts[at] > 0]
    if not len(at):
        return None
    cut = int(at[np.argmin(np.abs(counts[at] - len(values) / 2))])
    return int(vantage), cut, d


def grow(sample: np.ndarray, depth: int, mask: int) -> tuple[Node, int]:
    """A tree of at most 2**depth leaves over a sample, and its number of leaves. It decides balance only: any value has its leaf."""
    count = 0

    def build(values: np.ndarray, depth: int) -> Node:
        nonlocal count
        cut = _split(values) if depth and len(values) > 1 else None
        if cut is None:
            count += 1
            return Node(leaf=count - 1)
        vantage, mu, d = cut
        return Node(vantage=vantage, cut=mu, inside=build(values[d <= mu], depth - 1), outside=build(values[d > mu], depth - 1))

    return build(np.unique(sample & np.uint64(mask)), depth), count


def route(node: Node, values: np.ndarray, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf that some value's ball meets: (leaf, indexes of these values, whether the value itself belongs there)."""
    out = []

    def walk(node: Node, index: np.ndarray, home: np.ndarray) -> None:
        if not len(index):
            return
        if node.leaf >= 0:
            out.append((node.leaf, index, home))
            return
        d = np.bitwise_count(values[index] ^ np.uint64(node.vantage)).astype(np.int16)
        inner = d <= node.cut
        near = d - radius <= node.cut  # the ball reaches in
        far = d + radius > node.cut  # the ball reaches out
        walk(node.inside, index[near], (home & inner)[near])
        walk(node.outside, index[far], (home & ~inner)[far])

    walk(node, np.arange(len(values)), np.ones(len(values), bool))
    return out


def forest(fps: np.ndarray, home: np.ndarray, mask: int, radius: int, block_radius: int, leaf: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the pairs within ``radius`` between members (``home``) and all values of a shard.

    Pairs are found by a tree on the masked block, searched by all values at
    once; they are never kept together: whenever a batch fills, the forest
    absorbs it. The union of the shards' forests has the same components as
    all pairs, at every distance. Returns (a, b, distance), at most one link
    fewer than values.
    """
    part = fps & np.uint64(mask)
    tree = Links(len(fps))

    def search(members: np.ndarray, queries: np.ndarray) -> None:
        if not len(members) or not len(queries):
            return
        cut = _split(part[members]) if len(members) > leaf else None
        if cut is None:
            _compare(fps, part, members, queries, radius, block_radius, tree)
            return
        vantage, mu, d = cut
        q = np.bitwise_count(part[queries] ^ np.uint64(vantage)).astype(np.int16)
        search(members[d <= mu], queries[q - block_radius <= mu])
        search(members[d > mu], queries[q + block_radius > mu])

    search(np.nonzero(home)[0], np.arange(len(fps)))
    return tree.links()


def _compare(fps, part, members, queries, radius, block_radius, tree) -> None:
    step = max(1, (1 << 20) // len(members))
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        d = np.bitwise_count(fps[q][:, None] ^ fps[members][None, :])
        qi, mi = np.nonzero(d <= radius)
        a, b = q[qi], members[mi]
        keep = a != b
        tree.add(a[keep], b[keep], d[qi, mi][keep])


class Links:
    """Keeps a minimum spanning forest of the links that were added."""

    def __init__(self, n: int, batch: int = 1 << 18):
        self.n, self.batch, self.held, self.waiting = n, batch, [], 0

    def add(self, a, b, d) -> None:
        if len(a):
            self.held.append((a.astype(np.int64), b.astype(np.int64), d.astype(np.int16)))
            self.waiting += len(a)
            if self.waiting > self.batch + self.n:
                self._reduce()

    def _reduce(self) -> None:
        """Kruskal's algorithm, a chunk at a time: what a chunk's links already have in one component goes by array operations.

        A group of copies so costs a loop over its members, not over its pairs.
        """
        a, b, d = (np.concatenate(x) for x in zip(*self.held))
        order = np.argsort(d, kind="stable")
        root = np.arange(self.n)
        kept = []
        for i in range(0, len(order), CHUNK):
            part = order[i : i + CHUNK]
            part = part[root[a[part]] != root[b[part]]]
            if not len(part):
                continue
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = up.get(y, y)
                    x = y
                return x

            for k, x, y in zip(part.tolist(), root[a[part]].tolist(), root[b[part]].tolist()):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    kept.append(k)
            changed = np.array(list(up), np.int64)
            to = np.arange(self.n)
            to[changed] = [find(x) for x in up]
            root = to[root]
        lo, hi = np.minimum(a[kept], b[kept]), np.maximum(a[kept], b[kept])
        self.held = [(lo, hi, d[kept])]
        self.waiting = len(kept)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int16)
        self._reduce()
        return self.held[0]

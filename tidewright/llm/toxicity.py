"""Toxicity by a linear-chain conditional random field over tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import WORDS, fresh, map_batches, release, text_or_empty
from tidewright.llm.langid import held_out

#: Tokens that are taken in lockstep; weights are carried from one run of them to the next.
CHAIN = 128
#: Lengths of stems in bytes.
STEMS = (4, 5, 6, 7)
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORDS).split()


@dataclass
class Model:
    """Weights of two states, plain and toxic; plain ones are zero.

    ``vocab`` numbers the words from 1, ``stems`` their first bytes; 0 is any
    other and weighs nothing. ``word`` and ``stem`` weigh a token's own word
    and stems, ``before`` and ``after`` the previous and next word, and
    ``move[i, j]`` the step from state i to j.
    """

    vocab: dict[bytes, int]
    stems: dict[bytes, int]
    word: np.ndarray
    stem: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    move: np.ndarray
    doc: np.ndarray  # bias, log of the expected toxic tokens, largest marginal, expected tokens in a hundred

    def stem_sum(self, word: bytes) -> float:
        return float(sum(self.stem[self.stems.get(word[:n], 0)] for n in STEMS if len(word) > n))

    def emissions(self, ids: np.ndarray, extra: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For a flat run of texts; ``extra`` has the stems' weights, ``first`` and ``last`` mark the texts' ends."""
        out = self.word[ids] + extra + self.bias
        out[1:] += np.where(first[1:], 0, self.before[ids[:-1]])
        out[:-1] += np.where(last[:-1], 0, self.after[ids[1:]])
        return out


def marginals(e: np.ndarray, used: np.ndarray, move: np.ndarray, into: np.ndarray | None = None, out_of: np.ndarray | None = None, first: np.ndarray | None = None, count: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over chains, one row each: P(toxic), expected moves summed over chains, and the sum of log Z.

    ``e`` (chains, length) is the toxic state's emission, ``used`` the length
    of each chain. A chain that goes on from another has that one's forward
    weights in ``into`` (chains, 2), and ``first`` is false for it; one that
    another goes on from has that one's backward weights in ``out_of``.
    """
    n, length = e.shape
    m = np.exp(move)
    inside = np.arange(length)[None, :] < used[:, None]
    ex = np.exp(np.clip(e, -30, 30)).T.copy()
    a0, a1, scale = np.empty((length, n)), np.empty((length, n)), np.empty((length, n))
    p0, p1 = np.ones(n), ex[0].copy()
    if into is not None:
        p0, p1 = np.where(first, 1.0, into @ m[:, 0]), np.where(first, 1.0, into @ m[:, 1]) * ex[0]
    for t in range(length):
        if t:
            p0, p1 = p0 * m[0, 0] + p1 * m[1, 0], (p0 * m[0, 1] + p1 * m[1, 1]) * ex[t]
        s = p0 + p1
        p0, p1 = p0 / s, p1 / s
        a0[t], a1[t], scale[t] = p0, p1, s
    out, moves = np.zeros((length, n)), np.zeros((2, 2))
    end0, end1 = (np.ones(n), np.ones(n)) if out_of is None else (out_of[:, 0], out_of[:, 1])
    b0, b1 = end0, end1
    for t in range(length - 1, -1, -1):
        z = a0[t] * b0 + a1[t] * b1
        out[t] = a1[t] * b1 / z
        g1 = ex[t] * b1
        live = inside[:, t]
        if count and (t or into is not None):
            before = (a0[t - 1], a1[t - 1]) if t else (into[:, 0], into[:, 1])
            live = live if t else live & ~first
            zz = scale[t] * z
            for i, p in enumerate(before):
                moves[i, 0] += (p * m[i, 0] * b0 / zz)[live].sum()
                moves[i, 1] += (p * m[i, 1] * g1 / zz)[live].sum()
        if t:
            c0, c1 = m[0, 0] * b0 + m[0, 1] * g1, m[1, 0] * b0 + m[1, 1] * g1
            s = c0 + c1
            b0, b1 = np.where(live, c0 / s, end0), np.where(live, c1 / s, end1)  # beyond a chain's end nothing counts
    return np.where(inside, out.T, 0), moves, float(np.log(scale.T[inside]).sum())


def whole_marginals(e: np.ndarray, sizes: np.ndarray, move: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of all tokens of texts of these sizes, in one run, and the expected moves: forward-backward over each whole text.

    Texts are cut into chains of ``CHAIN`` tokens that run side by side. What
    a chain does to forward and backward weights is a 2 x 2 matrix; products
    of these carry the weights over the cuts, so the cuts change nothing.
    """
    if not len(e):
        return np.zeros(0), np.zeros((2, 2))
    place, used, owner = chains(sizes)
    grid = np.zeros((len(used), CHAIN))
    grid.reshape(-1)[place] = e
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    n, m = len(used), np.exp(move)
    into, out_of = np.ones((n, 2)), np.ones((n, 2))
    many = ~(first & np.concatenate([first[1:], [True]]))  # chains of texts with more than one
    if many.any():
        part = np.nonzero(many)[0]
        ex, size, start = np.exp(np.clip(grid[part], -30, 30)).T.copy(), used[part], first[part]
        q = [[np.where(start, 1.0, m[i, 0]), np.where(start, 1.0, m[i, 1]) * ex[0]] for i in (0, 1)]
        for t in range(1, CHAIN):
            live = t < size
            new = [[a * m[0, 0] + b * m[1, 0], (a * m[0, 1] + b * m[1, 1]) * ex[t]] for a, b in q]
            s = sum(x for pair in new for x in pair)
            q = [[np.where(live, x / s, y) for x, y in zip(pair, old)] for pair, old in zip(new, q)]
        step = np.stack([np.stack(pair, 1) for pair in q], 1)  # chain, state before, state at its end
        number = np.arange(len(part)) - np.maximum.accumulate(np.where(start, np.arange(len(part)), 0))
        by = [np.nonzero(number == r)[0] for r in range(int(number.max()) + 1)]
        ends, starts = np.ones((len(part), 2)), np.ones((len(part), 2))
        for r, rows in enumerate(by):
            a = ends[rows - 1] if r else np.tile([1.0, 0.0], (len(rows), 1))
            if r:
                into[part[rows]] = a
            ends[rows] = (a[:, :, None] * step[rows]).sum(1)
            ends[rows] /= ends[rows].sum(1, keepdims=True)
        for rows in by[:0:-1]:
            b = (step[rows] * out_of[part[rows]][:, None, :]).sum(2)
            out_of[part[rows] - 1] = b / b.sum(1, keepdims=True)
    p, moves, _ = marginals(grid, used, move, into, out_of, first, count)
    return p.reshape(-1)[place], moves


def chains(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of these sizes, cut into chains of ``CHAIN`` tokens: (place of each token in the padded matrix, length of each chain, its text)."""
    rows = -(-sizes // CHAIN)
    owner = np.repeat(np.arange(len(sizes)), rows)
    start = np.concatenate([[0], np.cumsum(rows)[:-1]]) * CHAIN
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)
    used = np.full(len(owner), CHAIN)
    some = rows > 0
    used[np.cumsum(rows)[some] - 1] = (sizes - (rows - 1) * CHAIN)[some]
    return place, used, owner


class Numbers(dict):
    """word -> its number and the weight of its stems, packed in one integer; remembers up to ``remember`` words."""

    def __init__(self, model: Model, remember: int = 200_000):
        super().__init__()
        self.model, self.remember = model, remember

    def __missing__(self, word: bytes) -> int:
        weight = int.from_bytes(np.float32(self.model.stem_sum(word)).tobytes(), "little", signed=True)
        if len(self) >= self.remember:
            self.clear()
        out = self[word] = (weight << 32) | self.model.vocab.get(word, 0)
        return out


def edges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the first and last tokens of texts of these sizes."""
    first, last, ends = np.zeros(int(sizes.sum()), bool), np.zeros(int(sizes.sum()), bool), np.cumsum(sizes)
    first[(ends - sizes)[sizes > 0]] = True
    last[ends[sizes > 0] - 1] = True
    return first, last


def infer(m: Model, texts: list[list[bytes]], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of all tokens in one run, and the texts' sizes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    packed = np.fromiter((x for t in texts for x in map(numbers.__getitem__, t)), np.int64, int(sizes.sum()))
    extra = (packed >> 32).astype(np.int32).view(np.float32).astype(float)
    return run_marginals(m, packed & 0xFFFFFFFF, extra, sizes), sizes


def run_marginals(m: Model, ids: np.ndarray, extra: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return whole_marginals(m.emissions(ids, extra, *edges(sizes)), sizes, m.move, False)[0] if len(ids) else np.zeros(0)


def units(word: bytes) -> list[bytes]:
    """The word and its stems, which end in an asterisk."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


def token_labels(texts: list[list[bytes]], toxic: np.ndarray, least_share: float = 0.9) -> set[bytes]:
    """Words and stems whose tokens count as toxic in toxic texts.

    A unit is worth naming if the log-likelihood of the texts' marks gains more
    by it than the log of the number of units. Words that do so by themselves,
    in texts of which at least ``least_share`` are toxic, are chosen first;
    then units one by one, by what a logistic model gains with the unit's count
    beside those chosen before, so that what only goes with toxic words stays
    plain. Units that can't be told apart are chosen together; of a stem and a
    longer unit with the same occurrences the longer stands for both. Equal
    texts are one text. A toxic text has a toxic token: one without a chosen
    unit adds its own longest word that no plain text has, of those that most
    toxic texts have.
    """
    distinct = sorted({(tuple(t), int(k)) for t, k in zip(texts, toxic.tolist())})
    texts, toxic = [list(t) for t, _ in distinct], np.array([k for _, k in distinct], np.int64)
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    if not n1 or not n0:
        return set()
    doc, unit, times, names = unit_counts(texts)
    x, y, cost = np.log1p(times), toxic.astype(float), log(len(names) + 1)
    c1 = np.bincount(unit, y[doc], len(names))
    c0 = np.bincount(unit, minlength=len(names)) - c1
    total = np.bincount(unit, times, len(names))
    gain = _split_gain(c1, c0, n1, n0)
    open_ = (gain >= 0.4 * cost) & (c1 * n0 > c0 * n1)
    number = {u: i for i, u in enumerate(names)}
    for i in np.nonzero(open_)[0].tolist():  # a stem whose occurrences are those of a longer unit
        u = names[i]
        word = u[:-1] if u.endswith(b"*") else u
        for n in STEMS:
            j = number.get(word[:n] + b"*") if n < len(word) else None
            if j is not None and j != i and total[j] == total[i]:
                open_[j] = False
    at = np.nonzero(open_[unit])[0]
    column = np.full(len(names), -1)
    candidates = np.nonzero(open_)[0]
    column[candidates] = np.arange(len(candidates))
    doc, unit, x = doc[at], column[unit[at]], x[at]
    pure = (gain >= cost) & (c1 >= least_share * (c1 + c0)) & ~np.array([u.endswith(b"*") for u in names])
    more = np.nonzero(pure[candidates])[0].tolist()
    chosen: list[int] = []
    logit = np.full(len(y), log(n1 / n0))
    while len(chosen) < len(candidates):
        if not more:
            gain = _count_gain(doc, unit, x, y, logit, len(candidates))
            gain[chosen] = 0
            if gain.max() < cost:
                break
            more = np.nonzero(gain >= gain.max() - 1e-6)[0].tolist()
        chosen.extend(more)
        more = []
        dense = np.zeros((len(y), len(chosen) + 1))
        dense[:, 0] = 1
        place = np.full(len(candidates), -1)
        place[chosen] = np.arange(1, len(chosen) + 1)
        ours = place[unit] > 0
        dense[doc[ours], place[unit[ours]]] = x[ours]
        logit = dense @ logistic(dense, y, ridge=0.1)
    out = {names[candidates[c]] for c in chosen}
    df1, df0 = Counter(w for t, k in zip(texts, toxic.tolist()) if k for w in set(t)), {w for t, k in zip(texts, toxic.tolist()) if not k for w in t}
    for t, k in zip(texts, toxic.tolist()):
        if k and not any(not out.isdisjoint(units(w)) for w in set(t)) and (own := set(t) - df0):
            out.add(max(own, key=lambda w: (df1[w], len(w), w)))
    return out


def unit_counts(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, unit, times) for each unit of each text, and the units."""
    word_id: dict[bytes, int] = {}
    number: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    flat = np.fromiter((word_id.setdefault(w, len(word_id)) for t in texts for w in t), np.int64, sum(sizes))
    at, count = np.unique(np.repeat(np.arange(len(texts)), sizes) * max(1, len(word_id)) + flat, return_counts=True)
    of = np.full((len(word_id) + 1, 1 + len(STEMS)), -1, np.int64)
    for w, i in word_id.items():
        ids = [number.setdefault(u, len(number)) for u in units(w)]
        of[i, : len(ids)] = ids
    doc, word = np.divmod(at, max(1, len(word_id)))
    each = of[word]
    held = each >= 0
    keys, place = np.unique((doc[:, None] * max(1, len(number)) + each)[held], return_inverse=True)
    times = np.bincount(place, np.broadcast_to(count[:, None], each.shape)[held], len(keys))
    doc, unit = np.divmod(keys, max(1, len(number)))
    return doc, unit, times, list(number)


def _split_gain(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood that a split of the texts by a unit gains; the unit is in c1 toxic and c0 plain texts."""
    part = lambda a, n: a * np.log(np.maximum(a, 1e-9) / np.maximum(n, 1e-9))
    held, rest = c1 + c0, n1 + n0 - c1 - c0
    return part(c1, held) + part(c0, held) + part(n1 - c1, rest) + part(n0 - c0, rest) - part(n1, n1 + n0) - part(n0, n1 + n0)


def _count_gain(doc: np.ndarray, unit: np.ndarray, x: np.ndarray, y: np.ndarray, logit: np.ndarray, n: int) -> np.ndarray:
    """Log-likelihood that each unit's count gains beside ``logit`` with a weight of its own from 0 to 8."""
    w, base = np.zeros(n), logit[doc]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(base + w[unit] * x, -30, 30)))
        g = np.bincount(unit, x * (y[doc] - p), n) - 0.05 * w
        h = np.bincount(unit, x * x * p * (1 - p), n) + 0.05
        w = np.clip(w + np.clip(g / h, -1, 1), 0, 8)
    of = lambda z: y[doc] * z - np.logaddexp(0, z)
    return np.bincount(unit, of(base + w[unit] * x) - of(base), n)


def document_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """From the marginals of a flat run of texts."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(p)])
    expected = total[ends] - total[ends - sizes]
    most = np.zeros(len(sizes))
    some = sizes > 0
    if some.any():
        most[some] = np.maximum.reduceat(p, (ends - sizes)[some])
    return np.stack([np.ones(len(sizes)), np.log1p(expected), most, 100 * expected / (sizes + 20)], 1)


def train(texts: list[str], toxic: np.ndarray, steps: int = 45, rate: float = 0.3, decay: float = 1e-4, context_decay: float = 0.03, least_df: int = 3) -> Model:
    """Fits the field to token labels by Adam on its log-likelihood, then the document layer by Newton's method."""
    one: dict[bytes, bytes] = {}  # a word is held once, however often it stands
    ws = [[one.setdefault(w, w) for w in tokens(t)] for t in texts]
    bad = token_labels(ws, toxic)
    df = Counter(w for t in ws for w in set(t))
    stem_df = Counter(u for t in ws for u in {w[:n] for w in set(t) for n in STEMS if len(w) > n})
    vocab = {w: i for i, w in enumerate(sorted(w for w, c in df.items() if c >= least_df or w in bad), 1)}
    stems = {w: i for i, w in enumerate(sorted(w for w, c in stem_df.items() if c >= least_df), 1)}
    v, v2 = len(vocab) + 1, len(stems) + 1
    m = Model(vocab, stems, np.zeros(v), np.zeros(v2), np.zeros(v), np.zeros(v), -3.0, np.zeros((2, 2)), np.zeros(4))
    # Distinct words carry what is looked up; tokens point at them.
    known = {w: i for i, w in enumerate(df)}
    sizes = np.array([len(t) for t in ws], np.int64)
    at = np.fromiter((known[w] for t in ws for w in t), np.int64, int(sizes.sum()))
    word_of = np.array([vocab.get(w, 0) for w in known] or [0])
    stems_of = np.array([[stems.get(w[:n], 0) if len(w) > n else 0 for n in STEMS] for w in known] or [[0] * len(STEMS)])
    marked = np.array([not bad.isdisjoint(units(w)) for w in known] or [False])
    y = (marked[at] & np.repeat(toxic == 1, sizes)).astype(float) if len(at) else np.zeros(0)
    if not y.any():
        m.doc[0] = log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5)) if len(toxic) else -1.0
        return m
    ids = word_of[at]
    first, last = edges(sizes)
    a, b = y[:-1][~last[:-1]], y[1:][~first[1:]]
    seen_moves = np.array([[((a == i) & (b == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    weights = [m.word, m.before, m.after, m.stem, np.array([m.bias]), m.move]
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    count = max(1.0, y.sum())
    for step in range(1, steps + 1):
        m.bias = float(weights[4][0])
        p, moves = whole_marginals(m.emissions(ids, m.stem[stems_of].sum(1)[at], first, last), sizes, m.move)
        diff = p - y
        by_word = np.bincount(at, diff, len(known))
        before = np.bincount(ids[np.nonzero(~first)[0] - 1], diff[~first], v)
        after = np.bincount(ids[np.nonzero(~last)[0] + 1], diff[~last], v)
        g = [np.bincount(word_of, by_word, v), before, after, sum(np.bincount(c, by_word, v2) for c in stems_of.T), np.array([diff.sum()]), moves - seen_moves]
        for k, (w, gr) in enumerate(zip(weights, g)):
            gr = gr / count + (context_decay if k in (1, 2, 5) else decay) * w  # what stands beside a token says less than the token
            if k < 4:
                gr[0] = 0
            s1, s2 = state[k]
            s1 += 0.1 * (gr - s1)
            s2 += 0.01 * (gr * gr - s2)
            w -= rate * (s1 / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-4)
    m.bias = float(weights[4][0])
    p = run_marginals(m, ids, m.stem[stems_of].sum(1)[at], sizes)
    m.doc = logistic(document_features(p, sizes), toxic.astype(float), ridge=0.1)
    return m


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.array([1e-3, *[1.0] * (len(w) - 1)])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(h, x.T @ (p - y) + penalty * w)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Of each class the ``max_rows`` // 2 labelled rows with the smallest hash of their id; whole texts.

    Texts take ``max_bytes`` together, half of it for either class: in that
    order those whose running sum fits, and of texts over a sixteenth of it none.
    """
    marked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).distinct()
    picked = None
    for y in (0, 1):
        some = marked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_rows // 2)
        picked = some if picked is None else picked.unionByName(some)
    size = F.octet_length(text_col)
    short = docs.where(F.col(text_col).isNotNull() & (size <= max_bytes // 16)).select(F.col(id_col).alias("_d"), F.col(text_col).alias("t"))
    found = short.join(F.broadcast(picked), F.col("_d") == F.col("_id")).select("_id", "t", "_y")
    order = Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id", "t")  # over max_rows rows
    return found.withColumn("_sum", F.sum(F.octet_length("t")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= max_bytes // 2)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2000, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of at most ``max_rows`` labelled rows of ``max_bytes`` together, half of either class."""
    rows = sorted({(r["_id"], r["t"], r["_y"]) for r in training_rows(docs, labels, max_rows, max_bytes, id_col, text_col, label_col).collect()})
    model = train([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.int64))
    del rows
    release()  # the driver lives on
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False, names: tuple[str, str, str] = ("score", "predicted", "spans")) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and, if asked for, ``spans`` (or other ``names``): ranges of toxic code points (marginal of 0.5 or more).

    The marginals of all tokens, forward-backward over the whole text, add up
    to the expected number of toxic tokens; that, its share and the largest
    marginal give the score. A null text is empty; empty texts have a score
    too. Rows stay as they are; columns of these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    new = [*names[: 3 if spans else 2]]
    rest = [c for c in docs.columns if c not in new]
    rows = docs.select(*rest, text_or_empty(text_col).alias(fresh(rest, "__text")))

    def some(texts: list[str], m: Model, numbers: Numbers) -> tuple[list, ...]:
        p, sizes = infer(m, [tokens(t) for t in texts], numbers)
        s = 1 / (1 + np.exp(-np.clip(document_features(p, sizes) @ m.doc, -30, 30)))
        out = [s.tolist(), (s >= 0.5).astype(int).tolist()]
        if spans:
            ends = np.cumsum(sizes)
            out.append([_spans(t, p[b - n : b]) for t, n, b in zip(texts, sizes.tolist(), ends.tolist())])
        return tuple(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.float64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        m = held.value
        numbers = Numbers(m)
        for b in batches:
            made: tuple[list, ...] = tuple([] for _ in new)
            texts, size = [], 0
            column = b.column(len(rest))
            for i, t in enumerate(column):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size > 1 << 21 or i == len(column) - 1:
                    for c, x in zip(made, some(texts, m, numbers)):
                        c.extend(x)
                    texts, size = [], 0
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(made, kinds))], names=[*rest, *new])

    from pyspark.sql import types as T

    kinds = ("double", "int", "array<struct<start:int,end:int>>")
    return map_batches(rows, run, T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T._parse_datatype_string(k)) for c, k in zip(new, kinds))]))


def _spans(text: str, p: np.ndarray) -> list[dict]:
    if not len(p) or p.max() < 0.5:
        return []
    out: list[dict] = []
    before = False
    for w, toxic in zip(WORD.finditer(text), (p >= 0.5).tolist()):
        if toxic and before:
            out[-1]["end"] = w.end()
        elif toxic:
            out.append({"start": w.start(), "end": w.end()})
        before = toxic
    return out


def out_of_training(id_col: str = "doc_id") -> Column:
    return held_out(id_col, 5, 0)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; a null text is empty and has a score, repeated rows stay, without labels every score is that of an untrained model. A null id is never held out."""
    model = fit(docs, labels.where(~out_of_training()))
    return score(docs.select("doc_id", "text", out_of_training().alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of a score at or over the threshold; the model learns from the texts of ``labelled`` that ``labels`` marks."""
    model = fit(labelled, labels)
    score_name, predicted = (fresh(docs.columns, c) for c in ("__score", "__predicted"))
    return score(docs, model, text_col, names=(score_name, predicted, "")).where(F.col(score_name) < threshold).select(*docs.columns)

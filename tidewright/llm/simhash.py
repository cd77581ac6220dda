"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by sharded vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm import vptree
from tidewright.llm.common import LOWER, fresh, hot_join, map_batches, own_pool, release, shared, text_or_empty, tidy
from tidewright.llm.components import components

SEED = 42


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each shingle of k space-joined words, repeats included; of all words if there are fewer; none without words."""
    ws = text.translate(LOWER).split()  # bytes split at \x20 and \x09-\x0D
    if not ws:
        return np.empty(0, np.uint64)
    joined = map(b" ".join, zip(*(ws[i:] for i in range(k)))) if len(ws) >= k else [b" ".join(ws)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def mixed(hashes: np.ndarray, plane: int) -> np.ndarray:
    """Hashes as another hash function would give them; of plane 0 as they are."""
    if not plane:
        return hashes
    x = hashes + np.uint64(plane * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(distinct: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of ``rows`` MinHash values; sets of Jaccard similarity J have a key in common with probability 1 - (1 - J ** rows) ** bands. None of an empty set."""
    if not len(distinct):
        return np.empty(0, np.uint64)
    by = mixed(np.arange(bands * rows, dtype=np.uint64), 1) | np.uint64(1)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(distinct), 1 << 10):
        low = np.minimum(low, (distinct[i : i + (1 << 10), None] * by).min(0))
    keys = np.arange(bands, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        keys = mixed(keys ^ column, 2)
    return keys


def fingerprints(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", planes: int = 1) -> DataFrame:
    """``_id, fp0, fp1, …``, a fingerprint for each plane, as signed longs. A null text is empty, and an empty text has fingerprints zero."""
    return _prints(docs, k, id_col, text_col, planes, 0, 0).drop("_h", "node", "keys")


def _prints(docs: DataFrame, k: int, id_col: str, text_col: str, planes: int, bands: int, band_rows: int) -> DataFrame:
    """The fingerprints, with ``_h``, a hash of the text, and with bands also ``node``, 128 bits of the shingle set, and ``keys``, those of the bands."""
    names = [f"fp{p}" for p in range(planes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.zeros((planes, b.num_rows), np.uint64)
            sets, keys = [], []
            for i, t in enumerate(b.column(1)):
                hashes = shingle_hashes(t.as_py(), k)
                for p in range(planes):
                    fps[p, i] = simhash(mixed(hashes, p))
                distinct = np.unique(hashes) if bands else hashes[:0]
                sets.append(xxhash.xxh128_digest(distinct.tobytes(), SEED) if bands else None)
                keys.append(band_keys(distinct, bands, band_rows).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x.view(np.int64)) for x in fps), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_h", *names, "node", "keys"])

    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).cast("binary").alias("_t"), F.xxhash64(text_or_empty(text_col)).alias("_h"))
    return map_batches(rows, run, f"_id {rows.schema['_id'].dataType.simpleString()}, _h bigint, " + ", ".join(f"{n} bigint" for n in names) + ", node binary, keys array<bigint>")


def links(fps: DataFrame, radius: int = 3, blocks: int = 4, shard: int = 40_000, sample: int = 20_000, pairs_from: int = 1 << 22) -> DataFrame:
    """``a, b, distance``: a spanning forest, shortest links first, of the pairs of distinct ``fps(fp)`` that differ in at most ``radius`` bits.

    With a column ``plane``, pairs are those of one plane, which the result then names.

    A tree for each block, grown on the driver over ``sample`` fingerprints
    (those of smallest hash) or four for each shard, cuts them into shards of
    about ``shard``. From ``pairs_from`` fingerprints on, there is a tree for
    each two of ``radius + 2`` blocks instead: a block of 16 bits alone has too
    few values to tell so many apart. Every fingerprint goes to the shard that it belongs to and, as a
    query, to those that its ball reaches over a boundary. Each shard is then
    searched exactly with a tree of its own. The sample only balances shards;
    no pair depends on it. The work is that of the trees, blocks *
    n ** (1 + small), and memory that of one shard; a shard yields fewer links
    than values, whatever the number of its pairs.
    """
    by = [c for c in ("plane",) if c in fps.columns]
    rows, most = fps.agg(F.count(F.lit(1)), F.max("plane") if by else F.lit(0)).first()
    kind, planes = "plane int, " if by else "", 1 + (most or 0)
    n = rows // planes
    keep = 1
    if n >= pairs_from and 2 * 64 // (radius + 2) > 64 // blocks:
        blocks, keep = radius + 2, 2
    sample = max(sample, 4 * n // shard)
    picked = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    masks, block_radius = vptree.block_masks(blocks, keep), vptree.block_radius(radius, blocks, keep)
    if not len(picked):
        return fps.sparkSession.createDataFrame([], f"{kind}a bigint, b bigint, distance int")
    depth = max(0, ceil(log2(max(1, n / shard))))
    trees, first = [], 0
    for m in masks:
        tree, leaves = vptree.grow(picked, depth, m)
        trees.append((tree, first))
        first += leaves
    owner = [i for i, (_, start) in enumerate(trees) for _ in range((trees[i + 1][1] if i + 1 < len(trees) else first) - start)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 1 << 16:
                yield routed(held)
                held, size = [], 0
        if size:
            yield routed(held)

    def routed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        fp = np.concatenate([b.column(len(by)).to_numpy(zero_copy_only=False) for b in held]).view(np.uint64)
        parts = [(start + leaf, index, home) for (tree, start), m in zip(trees, masks) for leaf, index, home in vptree.route(tree, fp & np.uint64(m), block_radius)]
        index = np.concatenate([i for _, i, _ in parts])
        plane = [pa.array(np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])[index])] if by else []
        shards = np.concatenate([np.full(len(i), leaf, np.int32) for leaf, i, _ in parts])
        return pa.RecordBatch.from_arrays([*plane, pa.array(shards), pa.array(fp[index].view(np.int64)), pa.array(np.concatenate([home for _, _, home in parts]))], names=[*by, "shard", "fp", "home"])

    def solve(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        own_pool()
        fp = t.column("fp").to_numpy().view(np.uint64)
        home = t.column("home").to_numpy(zero_copy_only=False).astype(bool)
        a, b, d = vptree.forest(fp, home, masks[owner[key[-1].as_py()]], radius, block_radius)
        release()
        plane = {"plane": pa.array(np.full(len(a), key[0].as_py(), np.int32))} if by else {}
        return pa.table({**plane, "a": fp[a].view(np.int64), "b": fp[b].view(np.int64), "distance": d.astype(np.int32)})

    spreaded = map_batches(fps.select(*by, "fp"), spread, f"{kind}shard int, fp bigint, home boolean")
    return spreaded.groupBy(*by, "shard").applyInArrow(solve, f"{kind}a bigint, b bigint, distance int")


def near_duplicates(docs: DataFrame, k: int = 5, radius: int = 3, blocks: int = 4, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, planes: int = 1, bands: int = 30, band_rows: int = 7, **more) -> DataFrame:
    """One row per input row: ``id_col, fp, component_id``, the component's smallest id.

    Documents are linked if at most ``radius`` bits of their fingerprints of
    any plane differ; further planes, of other hash functions, find what one
    misses by chance. Without ``similarity``, documents of equal fingerprints
    in all planes are one node, so copies cost nothing after the first. With
    it, a node is a shingle set; keys of ``bands`` MinHash bands link nodes
    too, and such links only say what to compare: see :func:`alike`. Null
    and empty texts share fingerprint zero. Null ids take part but name no
    component unless no other id is in it. Repeated rows stay rows. An empty
    table gives no rows.
    """
    names = [f"fp{p}" for p in range(planes)]
    sets = similarity is not None
    rows = _prints(docs, k, id_col, text_col, planes, bands if sets else 0, band_rows)
    if not sets:
        rows = rows.withColumn("node", F.col("fp0") if planes == 1 else F.concat(*(F.lpad(F.hex(n), 16, "0") for n in names)))
    rows = shared(rows)
    pick = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_h")).alias("pick")
    nodes = shared(rows.groupBy("node", *names).agg(F.min("_id").alias("least"), pick, F.first("keys").alias("keys")))
    if sets or planes > 1:  # all planes at once
        prints = nodes.select("node", F.posexplode(F.array(*names)).alias("plane", "fp"))
        first = shared(prints.groupBy("plane", "fp").agg(F.min("node").alias("rep")))
        found = shared(links(first.select("plane", "fp"), radius, blocks, **more).select("plane", F.col("a").alias("_a"), F.col("b").alias("_b")))
        for end, node in (("_a", "a"), ("_b", "b")):
            found = hot_join(found, first.select("plane", F.col("fp").alias(end), F.col("rep").alias(node)), ["plane", end], [c for c in found.columns if c not in ("plane", end)])
        found = found.select("a", "b").unionByName(hot_join(prints, first, ["plane", "fp"], ["node"]).where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")))
    else:
        found = links(nodes.select(F.col("node").alias("fp")), radius, blocks, **more).select("a", "b")
    if sets:
        each = nodes.select("node", F.explode("keys").alias("key"))
        rep = shared(each.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        found = shared(found).unionByName(hot_join(each, rep, ["key"], ["node"]).where("node <> a").select("a", F.col("node").alias("b")))
        tidy(docs.sparkSession)  # as components does after each round
        found = alike(found, nodes, docs, k, similarity, id_col, text_col)
    root = components(found)
    named = nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = hot_join(named.select("node", "root"), least, ["root"], ["node"]).select("node", "component_id")
    return rows.join(label, "node").select(F.col("_id").alias(id_col), F.col("fp0").alias("fp"), "component_id")


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, similarity: float, id_col: str, text_col: str, block: int = 1000, anchors: int = 16, shingles: int = 500_000) -> DataFrame:
    """``a, b``: links with the components of all pairs of that Jaccard similarity inside each component of ``pairs``.

    Every two nodes that ``pairs`` join, by whatever path, count as compared.
    A component is dealt to blocks of about ``block`` nodes, or fewer if they
    have over ``shingles`` shingles together, each with the same
    few ``anchors`` so that a large group of near copies is one at once. Of a
    component of several blocks, the nodes outside its largest group then meet
    all others, block by block.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    group = components(pairs).select("node", F.col("root").alias("c"))
    at = nodes.select("node", "pick").join(group, "node").select("node", "c", F.col("pick._id").alias("_i"), F.col("pick._h").alias("_th"))
    texts = docs.select(F.col(id_col).alias("_d"), text_or_empty(text_col).cast("binary").alias("t"), F.xxhash64(text_or_empty(text_col)).alias("_h"))
    one = texts.join(at, (F.col("_h") == F.col("_th")) & F.col("_d").eqNullSafe(F.col("_i"))).select("c", "node", "t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.unique(shingle_hashes(t.as_py(), k)).view(np.int64) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.list_(pa.int64()))], names=["c", "node", "s"])

    seen = [0]

    def solve(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        own_pool()
        seen[0] += t.num_rows
        if seen[0] >= block:  # most groups are small
            release()
            seen[0] = 0
        place = {x: i for i, x in enumerate(t.column("node").to_pylist())}  # an anchor, or a node outside, may come twice
        t = t.take(pa.array(sorted(place.values())))
        node = t.column("node").combine_chunks()
        a, b = stars(*jaccard_links(t.column("s").combine_chunks(), t.column("g").to_pylist(), similarity), node.to_pylist())
        return pa.table({"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})

    hashed = shared(map_batches(one, sets, f"c {kind}, node {kind}, s array<bigint>"))
    tidy(docs.sparkSession)
    parts = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum(F.size("s")) / shingles, F.lit(1.0)))
    size = hashed.groupBy("c").agg(parts().alias("parts"))
    dealt = hot_join(hashed, size, ["c"], ["node"]).withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")))
    large = size.where("parts > 1")
    schema = f"a {kind}, b {kind}"
    if large.isEmpty():
        return shared(dealt.select("c", "p", "node", F.col("node").alias("g"), "s").groupBy("c", "p").applyInArrow(solve, schema))
    heads = _smallest(hot_join(hashed.select("c", "node"), large.select("c"), ["c"], ["node"]), anchors)
    spread = hashed.join(heads, ["c", "node"]).join(large, "c").select("c", "node", "s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("p"))
    first = shared(dealt.select("c", "p", "node", "s").unionByName(spread.select("c", "p", "node", "s")).withColumn("g", F.col("node")).groupBy("c", "p").applyInArrow(solve, schema))
    now = hot_join(hashed, large, ["c"], ["node"]).join(components(first), "node", "left").select("c", "node", "s", "parts", F.coalesce("root", "node").alias("g"))
    now = shared(now)
    tidy(docs.sparkSession)
    groups = now.groupBy("c", "g").agg(F.count(F.lit(1)).alias("m"))
    top = groups.groupBy("c").agg(F.max_by("g", F.struct("m", "g")).alias("top"))
    minor = hot_join(now, top, ["c"], ["node"]).where("g <> top")
    if minor.isEmpty():
        return first
    few = minor.groupBy("c").agg(parts().alias("few"))
    ours = hot_join(minor, few, ["c"], ["node"]).withColumn("q", F.pmod(F.xxhash64("node"), F.col("few")))
    ours = ours.select("c", "node", "s", "g", "q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("p"))
    all_ = hot_join(now, few, ["c"], ["node"]).select("c", "node", "s", "g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("few") - 1)).alias("q"), F.pmod(F.xxhash64("node"), F.col("parts")).alias("p"))
    second = ours.select("c", "node", "s", "g", "q", "p").unionByName(all_.select("c", "node", "s", "g", "q", "p")).groupBy("c", "q", "p").applyInArrow(solve, schema)
    return shared(first.unionByName(second))


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """``c, node``: the n smallest nodes of each ``c``; each of 64 parts of a key first gives its own n."""
    for by in (["c", F.pmod(F.xxhash64("node"), F.lit(64))], ["c"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("node"))).where(F.col("_n") <= n).drop("_n")
    return rows


def jaccard_links(sets: pa.ListArray, groups: list, similarity: float) -> tuple[list[int], list[int]]:
    """Links that join what pairs of that similarity join, beyond what is one group already; rows are sets of distinct numbers.

    A row is compared with all others unless it is in the largest group: a
    pair across two groups has a row outside of that one.
    """
    n = len(sets)
    sizes = np.diff(sets.offsets.to_numpy())
    values = sets.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), sizes)
    _, token = np.unique(values, return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders = owner[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(token))]).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    names = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    label = np.array([names[g] for g in groups], np.int64)
    done = np.zeros(n, bool)
    a: list[int] = []
    b: list[int] = []
    while True:
        left = np.nonzero(~done & (label != np.argmax(np.bincount(label, minlength=1))))[0] if n else ()
        if not len(left):
            return a, b
        i = int(left[0])
        done[i] = True
        mine = token[ends[i] : ends[i + 1]]
        first, many = starts[mine], starts[mine + 1] - starts[mine]
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(holders[at], minlength=n)
        near = np.nonzero((common >= similarity * (sizes[i] + sizes - common)) & (label != label[i]))[0]
        _, one = np.unique(label[near], return_index=True)
        for j in near[one].tolist():
            a.append(i)
            b.append(j)
        if len(near):
            label[np.isin(label, label[near])] = label[i]


def stars(a: list[int], b: list[int], names: list) -> tuple[list[int], list[int]]:
    """Links with the same components, each from the row of the smallest name to another one: most groups then need no further rounds."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for x, y in zip(a, b):
        x, y = sorted((find(x), find(y)), key=names.__getitem__)
        up[y] = x
    rows = [x for x in dict.fromkeys([*a, *b]) if find(x) != x]
    return rows, [find(x) for x in rows]


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` with the rows of one id, the smallest, for each component. Rows with a null id stay if their component has no other."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **more)
    name = fresh(docs.columns, "_kept")
    kept = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


def simhash_digest(docs: DataFrame, **more) -> DataFrame:
    """Fingerprints as 16 hexadecimal digits, by shingles of three words."""
    found = near_duplicates(docs, k=3, radius=3, **more)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

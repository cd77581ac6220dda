"""SimHash, components and vantage-point trees against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import vptree


def reference_fp(t, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components_of(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = list(root)
    for i, a in enumerate(known):
        for b in known[:i]:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in known}


def corpus():
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    docs = []
    for _ in range(40):
        w = [r.choice(vocab) for _ in range(r.randrange(1, 200))]
        docs.append(" ".join(w))
        for _ in range(r.randrange(4)):
            v = list(w)
            for _ in range(r.randrange(0, 4)):
                v[r.randrange(len(v))] = r.choice(vocab)
            docs.append("  ".join(v).upper() if r.random() < 0.3 else " ".join(v))
    return [*docs, None, "", " \t\n", "one", "ONE", "one two"]


def test_digest(spark):
    from tidewright.llm.simhash import simhash_digest

    docs = [(i * 3 % 997, t) for i, t in enumerate(corpus())]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_digest(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), shard=30, sample=50).collect()}
    fps = {i: reference_fp(t) for i, t in docs}
    root = components_of(set(fps.values()), 3)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}


@pytest.mark.parametrize(("radius", "blocks"), [(3, 4), (3, 2), (3, 1), (7, 4)])
def test_links_lose_no_pair(spark, radius, blocks):
    from tidewright.llm.components import components
    from tidewright.llm.simhash import links

    r = random.Random(radius * 10 + blocks)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = {0, (1 << 64) - 1}
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(r.randrange(radius + 3)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = links(spark.createDataFrame(signed, "fp bigint"), radius, blocks, shard=64, sample=200)
    got = {x.node & (1 << 64) - 1: x.root for x in components(found.select("a", "b")).collect()}
    root = components_of(fps, radius)
    groups = {}
    for f, g in root.items():
        groups.setdefault(g, set()).add(f)
    for g in groups.values():
        assert len({got.get(f, f) for f in g}) == 1
    assert len({got.get(f, f) for f in fps}) == len(groups)
    assert found.where((F.col("distance") > radius) | (F.col("distance") < 1)).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_trees_for_two_blocks_lose_no_pair(spark, radius):
    from tidewright.llm.components import components
    from tidewright.llm.simhash import links

    r = random.Random(radius)
    fps = {0, (1 << 64) - 1}
    for b in [r.getrandbits(64) for _ in range(60)]:
        for _ in range(12):
            x = b
            for _ in range(r.randrange(radius + 3)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = links(spark.createDataFrame(signed, "fp bigint"), radius, 4, shard=64, sample=200, pairs_from=1)
    got = {x.node & (1 << 64) - 1: x.root for x in components(found.select("a", "b")).collect()}
    groups = {}
    for f, g in components_of(fps, radius).items():
        groups.setdefault(g, set()).add(f)
    assert all(len({got.get(f, f) for f in g}) == 1 for g in groups.values()) and len({got.get(f, f) for f in fps}) == len(groups)


def test_forest_is_minimal():
    r = np.random.default_rng(1)
    fps = np.unique(r.integers(0, 1 << 12, 300, dtype=np.uint64))
    a, b, d = vptree.forest(fps, np.ones(len(fps), bool), (1 << 64) - 1, 3, 3, leaf=8)
    assert len(a) == len(fps) - 1 and (d == np.bitwise_count(fps[a] ^ fps[b])).all()


def test_near_dedup_and_edges(spark):
    from tidewright.llm.simhash import near_dedup, near_duplicates

    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    text = " ".join(words[:400])
    near = " ".join([*words[:200], "changed", *words[201:400]])
    far = " ".join(words[400:800])
    docs = spark.createDataFrame([(5, text, "x"), (2, text, "y"), (9, near, "z"), (4, far, "z"), (7, None, "n"), (8, "", "n"), (None, far, "q"), (4, far, "again")], "doc_id bigint, text string, fp string").repartition(3)
    for planes in (1, 3):
        got = {(r.doc_id, r.component_id) for r in near_duplicates(docs, k=5, radius=7, similarity=0.8, planes=planes).collect()}
        assert got == {(5, 2), (2, 2), (9, 2), (4, 4), (7, 7), (8, 7), (None, 4)}
    kept = near_dedup(docs, k=5, radius=7, similarity=0.8, planes=4)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.fp) for r in kept.collect()) == [(2, "y"), (4, "again"), (4, "z"), (7, "n")]
    assert near_duplicates(docs.where("false")).count() == 0


def test_planes_find_more(spark):
    from tidewright.llm.simhash import near_duplicates

    r = random.Random(8)
    docs = []
    for i in range(60):
        w = ["w%d" % r.randrange(10**6) for _ in range(150)]
        v = [x if r.random() > 0.012 else "v%d" % r.randrange(10**6) for x in w]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    met = lambda planes: near_duplicates(df, radius=7, similarity=0.8, planes=planes).where("doc_id % 2 = 1 AND component_id = doc_id - 1").count()
    assert met(4) >= met(1) and met(4) >= 48
    assert near_duplicates(df, radius=7, similarity=0.8, planes=4).where("component_id < doc_id - 1").count() == 0


def exact_components(texts, k=5, least=0.8):
    def shingles(t):
        w = t.split()
        return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def test_pairs_near_the_similarity_are_found(spark):
    from tidewright.llm.simhash import near_duplicates

    r = random.Random(12)
    texts = []
    for _ in range(150):
        w = ["w%d" % r.randrange(10**6) for _ in range(250)]
        v = list(w)
        for at in r.sample(range(5), 1):
            for x in range(5):
                v[at + x * 50] = "v%d" % r.randrange(10**6)
        texts += [" ".join(w), " ".join(v)]
    root = exact_components(texts)
    linked = [i for i in root if root[i] != i]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in near_duplicates(df, radius=7, similarity=0.8, planes=4).collect()}
    assert len(linked) == 150 and sum(got[i] == root[i] for i in linked) >= 149
    assert all(got[i] == root[i] for i in root if root[i] == i)


@pytest.mark.parametrize("block", [1000, 12])
def test_groups_around_a_template_are_exact(spark, block, monkeypatch):
    from functools import partial

    from tidewright.llm import simhash

    monkeypatch.setattr(simhash, "alike", partial(simhash.alike, block=block, anchors=3))
    r = random.Random(6)
    base = ["w%d" % r.randrange(10**6) for _ in range(200)]
    texts = []
    for _ in range(90):
        v = list(base)
        for _ in range(r.randrange(3, 8)):
            v[r.randrange(len(v))] = "v%d" % r.randrange(10**6)
        texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, radius=7, similarity=0.8, planes=4).collect()}
    assert got == exact_components(texts) and 1 < len(set(got.values())) < 90


def test_equal_fingerprints_are_compared(spark):
    from tidewright.llm.simhash import near_duplicates

    r = random.Random(9)
    texts = ["x " * 200 + " ".join("w%d" % r.randrange(10**6) for _ in range(60)) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = near_duplicates(df, radius=7, similarity=0.8, planes=4).collect()
    assert len({x.fp for x in got}) == 1 and sorted((x.doc_id, x.component_id) for x in got) == [(i, i) for i in range(4)]


def test_components(spark):
    from tidewright.llm.components import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, **{300 + i: 300 for i in range(50)}}


def test_each_round_of_components_is_collected(spark, monkeypatch):
    """What a round made is dropped before the next one: no more than a round's two checkpoints lie between collections."""
    from tidewright.llm import components as module

    done = []
    for name in ("shared", "tidy"):
        monkeypatch.setattr(module, name, lambda x, name=name, f=getattr(module, name): (done.append(name), f(x))[1])
    got = {r.node: r.root for r in module.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(61), 0)
    runs = [len(x.split()) for x in " ".join(done).split("tidy")]
    assert len(runs) > 3 and max(runs[1:]) <= 2

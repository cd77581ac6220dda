"""Exact dedup, decontamination, licences and personal data against brute force, with the edge cases of each."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

HARD = [
    (1, "The MIT License and the Apache License. General public license, MIT license!", "a"),
    (2, "The MIT License and the Apache License. General public license, MIT license!", "b"),
    (3, None, "a"),
    (4, "", "a"),
    (5, "mail a@b.co and x.y%z+q@sub.host-a.org, a@b.c_d@e.f; 10.0.0.255 1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.4", "c"),
    (6, "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111111111111111; call +1 (743) 555-3824 or +12", "c"),
    (7, "é€😀 5555-5555-5555-4444 é me@ü.x ü@a.b", None),
    (8, "word " * 3000 + "9" * 5000, "d"),
    (9, "x" * 20000 + "@" + "y" * 100, "d"),
    (9, "x" * 20000 + "@" + "y" * 100, "d"),
    (None, "no id", "e"),
]
SCHEMA = "doc_id bigint, text string, _h string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(HARD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, empty, keep, weak):
    from tidewright.llm.exact_dedup import content_hash, exact_dedup

    hash_of = (lambda t: F.substring(F.md5(t), 1, 1)) if weak else content_hash  # one hex digit: contents clash
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, keep=keep, hash_of=hash_of).collect()), key=repr)
    pick = min if keep == "min" else max
    want = []
    for i, t, _ in HARD:
        same = [j for j, u, _ in HARD if (u or "") == (t or "")]
        ids = [j for j in same if j is not None]
        k = pick(ids) if ids else None
        want.append((i, k, len(same), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup(empty).count() == 0


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


ITEMS = [(1, "one two three four five six seven eight nine ten"), (2, "TWO three four five six seven eight nine"), (10, "short item"), (11, None), (12, ""), (13, "one two three four five six seven eight nine ten"), (14, "a a a a a a a a a a a")]
TEXTS = [(1, "x one Two three, four five six seven eight nine y"), (2, "short item and short item"), (3, "nothing here"), (4, None), (5, ""), (6, "a " * 40), (7, "one two three four five six seven"), (8, "p one two three four five six seven eight nine ten q two three four five six seven eight nine short item"), (8, "p one two three four five six seven eight nine ten q two three four five six seven eight nine short item")]


def contamination(texts, items, n=8):
    wins = []
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        wins += [(str(i), tuple(w[a : a + k])) for a in range(len(w) - k + 1)] if w else []
    out = {}
    for d, t in texts:
        w, hit, ids = words(t), set(), set()
        for i, g in wins:
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    ids.add(i)
        out[d, t] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2)
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontaminate(spark, limit):
    from tidewright.llm.decontaminate import contamination_digest, decontaminate

    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumn("gram", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = contamination(TEXTS, ITEMS)
    got = {r.doc_id: tuple(r)[1:] for r in contamination_digest(docs, items, broadcast_windows=limit).collect()}
    assert got == {d: v for (d, _), v in want.items()}
    assert contamination_digest(docs, items, broadcast_windows=limit).count() == len(TEXTS)  # repeated rows stay rows
    clash = docs.selectExpr("*", "'k' AS _key", "'s' AS _spans", "'c' AS copies")
    for mode in ("documents", "spans"):
        kept = decontaminate(clash, items, min_items=1, mode=mode, broadcast_windows=limit)
        assert kept.columns == clash.columns and {(r._key, r._spans, r.copies) for r in kept.collect()} == {("k", "s", "c")}
    left = decontaminate(docs, items, min_items=2, broadcast_windows=limit)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, t in TEXTS if not want[d, t][4])
    cut = {r.doc_id: r.text for r in decontaminate(docs, items, min_items=1, mode="spans").collect()}
    assert cut[1] == "x  y" and cut[2].strip() == "and" and cut[3] == "nothing here" and cut[4] is None
    assert {r.doc_id for r in decontaminate(docs, items, min_items=1, least_words=8).collect()} == {2, 3, 4, 5, 7}
    none = items.where("false")
    assert decontaminate(docs, none).count() == len(TEXTS) and contamination_digest(docs.where("false"), items).count() == 0


def test_short_items_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    items = [(1, "zebra quantum lattice drips sideways"), (2, "the"), (3, "the answer"), (4, "one two three four five six seven eight nine")]
    texts = [(1, "we saw: Zebra quantum lattice drips sideways today"), (2, "the cat"), (3, "the answer is no"), (4, "so two three four five six seven eight nine"), (5, "zebra quantum lattice drips"), (6, None), (7, "answer")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.benchmark(spark, spark.createDataFrame(texts, "doc_id bigint, text string"), str(tmp_path))
    assert left.columns == ["doc_id", "text"] and sorted(r.doc_id for r in left.collect()) == [2, 5, 6, 7]


def test_licenses(docs, empty, spark):
    from tidewright.llm.license_scan import license_digest, license_scan

    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in license_digest(docs).collect():
        t = next(u for i, u, _ in HARD if i == r.doc_id)
        w = words(t)
        at = sorted((a, lab) for p, lab in phrases.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert license_scan(empty).count() == 0
    other = spark.createDataFrame([(1, "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the Software), to deal in the Software without restriction */"), (2, "Redistribution and use of permitted source conditions"), (3, "All rights reserved.")], "doc_id bigint, text string")
    assert {r.doc_id: r.labels for r in license_digest(other).collect()} == {1: "mit", 2: "", 3: "all-rights-reserved"}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(docs, empty, spark):
    from tidewright.llm.pii import find_pii, pii_digest

    got = {r.doc_id: r for r in pii_digest(docs).collect()}
    assert len(got) == len(HARD) - 1
    for i, t, _ in HARD:
        want = base_spans(t or "") if i != 9 else []
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | ({""} if not want else set())
    assert pii_digest(empty).count() == 0
    # Contexts of seeds find identifiers of the same kind that no base pattern takes.
    texts = [(i, f"customer phone: +1 (743) 555-{3000 + i} thanks") for i in range(30)] + [(100 + i, f"customer phone: 743.555.{4000 + i} thanks") for i in range(3)] + [(200, "order 743.555.9999 shipped")]
    found = {r.doc_id: [(s.kind, s.value) for s in r.found] for r in find_pii(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert found[100] == [("phone", "743.555.4000")] and found[200] == [] and found[1] == []


def test_pii_goes_beyond_the_first_hop(spark):
    from tidewright.llm.pii import find_pii

    texts = [f"call phone: +1 202 555 {i:04d}" for i in range(30)] + [f"call phone: ab{i}2345" for i in range(5)] + [f"see ref: ab{i}2345" for i in range(5)] + ["see ref: zz98765", "see other: qq98765"]
    found = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {s.value: s.kind for r in found for s in r.found} == {**{f"ab{i}2345": "phone" for i in range(5)}, "zz98765": "phone"}

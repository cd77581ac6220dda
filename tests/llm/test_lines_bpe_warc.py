"""Line dedup, the tokenizer and archives: brute force, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F


def passage(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def line_corpus():
    r = random.Random(2)
    long_, block = passage(r, 60), [passage(r, 12) for _ in range(12)]
    docs = []
    for i in range(12):
        own = [passage(r, r.randrange(3, 20)) for _ in range(r.randrange(2, 8))]
        at = r.randrange(len(own) + 1)
        if i % 3 == 0:
            own[at:at] = [long_]
        if i % 3 == 1:
            own[at:at] = block
        docs.append((i, "\n".join([*own, "stock line"])))
    return [*docs, (20, docs[5][1]), (20, docs[5][1]), (21, None), (22, ""), (23, "\n\n\n"), (24, long_ + " é")], long_, block


def brute(docs, min_words=30):
    """All chunks in (id, place) order; the first occurrence stays, later ones go in runs of enough words."""
    from tidewright.llm.line_dedup import chunks

    distinct = sorted({(i, t or "") for i, t in docs})
    parts = {d: [(b"\n".join(a), n) for a, n in chunks(d[1].encode())] for d in distinct}
    seen, repeated = set(), {d: set() for d in distinct}
    places = sorted((d[0], k, d) for d in distinct for k in range(len(parts[d])))
    for _, k, d in places:
        body = parts[d][k][0]
        if body in seen:
            repeated[d].add(k)
        seen.add(body)
    out = {}
    for d, p in parts.items():
        gone, run = set(), []
        for k in range(len(p) + 1):
            if k in repeated[d]:
                run.append(k)
            else:
                if sum(p[x][1] for x in run) >= min_words and run:
                    gone |= set(run)
                run = []
        out[d] = "\n".join(x.decode() for k, (x, _) in enumerate(p) if k not in gone)
    return out


def test_line_dedup(spark):
    from tidewright.llm.line_dedup import line_dedup, line_digest

    docs, long_, block = line_corpus()
    df = spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in docs], "doc_id bigint, text string, h string, n_chars bigint").repartition(3)
    got = line_dedup(df, count_col="n_chars")
    assert got.columns == df.columns
    rows = got.collect()
    assert len(rows) == len(docs)
    want = brute(docs)
    source = dict(docs)
    for r in rows:
        assert (r.text or "") == want[r.doc_id, source[r.doc_id] or ""]
        assert r.n_chars == len(r.text or "") and (r.text is None) == (source[r.doc_id] is None)
    text = "\n".join(r.text or "" for r in rows)
    assert text.split("\n").count(long_) == 1  # a passage is left once, and its near copy as it is
    assert sum(b in text for b in block) == 12 and text.count(block[6]) == 1
    assert all("stock line" in r.text for r in rows if r.doc_id < 12 and r.doc_id % 3 == 2)  # a short line alone is no passage
    assert line_digest(df).count() == len(docs) and line_digest(df.where("false")).count() == 0


def brute_runs(docs, min_words=30):
    """Every run of whole lines of enough words, from a line of words to one, that stood before by (id, place)."""
    seen, out = set(), {}
    for d in sorted({(i, t or "") for i, t in docs}):
        lines, gone = d[1].split("\n"), set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if lines[i].split() and lines[j - 1].split() and sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_whole_runs(spark):
    from tidewright.llm.line_dedup import line_dedup

    docs, _, block = line_corpus()
    r = random.Random(4)
    shared_ = [[passage(r, r.randrange(0, 45)) for _ in range(r.randrange(1, 6))] for _ in range(25)]
    for i in range(30, 90):
        own = [passage(r, r.randrange(0, 20)) for _ in range(r.randrange(6))]
        for _ in range(r.randrange(3)):
            at, run = r.randrange(len(own) + 1), r.choice(shared_)
            own[at:at] = run[r.randrange(2) :]
        docs.append((i, "\n".join(own)))
    pair = [passage(r, 30) for _ in range(2)]
    docs += [(100 + i, "\n".join([passage(r, 8), *pair, passage(r, 8)])) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'k' AS _key", "'g' AS _gone", "'t' AS _t", "'n' AS _r_n_lines").repartition(3)
    want, source = brute_runs(docs), dict(docs)
    for row in line_dedup(df, whole=True).collect():
        assert row[2:] == ("k", "g", "t", "n")
        assert (row.text or "") == want[row.doc_id, source[row.doc_id] or ""]
    left = "\n".join(x.text or "" for x in line_dedup(df, whole=True).collect()).split("\n")
    assert [left.count(x) for x in pair + block] == [1] * 14


def test_chunks_find_runs_in_the_pipeline(spark, monkeypatch):
    """The stage's runs come from its chunks first, and only what lies in none of them is compared by passages."""
    import corpus_pipeline
    from tidewright.llm import line_dedup as module

    r = random.Random(11)
    block, apart = [passage(r, 12) for _ in range(40)], [passage(r, 35) for _ in range(2)]
    docs = [(i, "\n".join([passage(r, 9), *block, passage(r, 9)])) for i in range(4)]
    docs += [(10 + i, "\n".join([*apart, passage(r, 9)])) for i in range(3)]  # too short for a chunk of its own, maybe
    docs += [(20, docs[0][1])] * 3 + [(21, docs[0][1]), (None, docs[5][1]), (22, None), (23, "")]
    docs += [(30 + i, f"{apart[0]}\n\n \n{apart[1]}\n\n{passage(r, 4)}") for i in range(3)]  # lines without words inside a run
    docs += [(40, passage(r, 14) + "\n" + passage(r, 14)), (41, "\n".join([block[5]] * 9)), (42, "\n".join([block[5]] * 9))]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id bigint, text string, n_chars bigint").repartition(3)
    want, left, seen = brute_runs([(-1 if i is None else i, t) for i, t in docs]), module._passages_left, []

    def watched(source, kind, min_words, runs):
        seen.append({(bytes(x._key), x.no, x.end) for x in runs.collect()})
        return left(source, kind, min_words, runs)

    monkeypatch.setattr(module, "_passages_left", watched)
    rows = corpus_pipeline.lines(spark, df, "").collect()
    assert len(rows) == len(docs)
    for x in rows:
        source = dict(docs)[x.doc_id]
        assert (x.text or "") == want[-1 if x.doc_id is None else x.doc_id, source or ""]
    long_runs = [e - a for _, a, e in seen[0] if e - a > 30]
    assert len(long_runs) >= 4  # three blocks but for their ends, and the copy of a document
    monkeypatch.setattr(module, "_passages_left", lambda source, kind, min_words, runs: runs.where("false"))
    assert sum(len((x.text or "").split()) for x in corpus_pipeline.lines(spark, df, "").collect()) < sum(len((t or "").split()) for _, t in docs) / 2


def test_chunks_resist_shifts():
    from tidewright.llm.line_dedup import chunks

    r = random.Random(7)
    lines = [passage(r, 6) for _ in range(200)]
    a = {b"\n".join(x) for x, _ in chunks("\n".join(lines).encode())}
    b = {b"\n".join(x) for x, _ in chunks("\n".join([*lines[:50], "put in", *lines[50:]]).encode())}
    assert len(a - b) <= 3
    assert b"\n".join(b"\n".join(x) for x, _ in chunks(b"a\n\nb\n")) == b"a\n\nb\n"


tokenizers = pytest.importorskip("public_tokenizers")


def test_bpe_equals_the_library(spark):
    import tiktoken

    from tidewright.llm.bpe import bpe_decode, bpe_digest, bpe_encode, read_ranks

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    r = random.Random(4)
    alphabet = " \n\t\r\x1c\x85\xa0　aabbée'stlvdre.,!0123²Ⅷ日本語한😀́_-ß"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(2000)] + [None, "", "a" * 30000, " " * 3000 + "x", "<|endoftext|> it's", "ab" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    path_args = (path, tokenizers.PATTERN)
    full = bpe_decode(bpe_encode(df, *path_args), *path_args)
    for row in full.collect():
        assert row.ids == enc.encode_ordinary(texts[row.doc_id] or "") and bytes(row.decoded) == (texts[row.doc_id] or "").encode()
    for row in bpe_digest(df, *path_args).where("doc_id % 7 = 0").collect():
        ids = enc.encode_ordinary(texts[row.doc_id] or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest())
    assert bpe_digest(df.where("false"), *path_args).count() == 0


def test_small_caches_change_nothing():
    from tidewright.llm.bpe import BytePairCodec, read_ranks

    ranks = read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    a, b = BytePairCodec(ranks, tokenizers.PATTERN), BytePairCodec(ranks, tokenizers.PATTERN, remember=3)
    text = "The quick brown fox's jump  over\n\n12 lazy dogs — déjà vu " * 20
    assert a.encode(text) == b.encode(text) and a.decode(a.encode(text)) == text.encode()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc(spark, tmp_path, compression):
    from tidewright.llm.warc import archive_digest, read_warc

    big = "<p>é " + "x" * 1000 + "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"
    pages = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (7, "u\r\nX: y", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "u", "z" * 1000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    path = f"file://{tmp_path}/w"
    got = {r.page_id: tuple(r)[1:] for r in archive_digest(df, path, compression=compression).collect()}
    want = {}
    for i, _, h in pages:
        data = (h or "").encode()
        keep = max(j for j, _, g in pages if (g or "") == (h or ""))
        revisit = len(data) >= 1000 and keep != i
        want[i] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None)
    assert got == want
    back = read_warc(spark, path)
    assert {bytes(r.payload).decode() for r in back.where("record_type = 'response' AND payload IS NOT NULL").collect()} == {h or "" for _, _, h in pages}
    assert back.where("record_type = 'revisit'").count() == 2 and back.where("record_id = '<urn:page:7>'").first().target_uri == "uX: y"
    assert back.where(F.col("target_uri").startswith("http://")).count() == 2
    assert read_warc(spark, path, payload=False).where("payload IS NOT NULL").count() == 0
    assert archive_digest(df.where("false"), f"{path}-none", compression=compression).count() == 0


def test_warc_skips_payloads():
    import io

    from pyspark.sql.datasource import EqualTo, GreaterThan

    from tidewright.llm.warc import WarcReader

    reader = WarcReader({})
    assert [type(f) for f in reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("http_length",), 3)])] == [GreaterThan]

    class Counting(io.BytesIO):
        got = 0

        def readinto(self, b):
            n = super().readinto(b)
            self.got += n
            return n

    body = b"x" * 500_000
    rec = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    raw = Counting(rec % (b"response", len(body), body) + rec % (b"revisit", 2, b"ok"))
    rows = list(reader.records(io.BufferedReader(raw, 4096), True))
    assert [r[0] for r in rows] == ["revisit"] and raw.got < 20_000


def test_members_are_skipped_packed(spark, tmp_path):
    """Only the headers of a gzip member are unpacked if a predicate rejects the record, and plain tools read the file."""
    import gzip
    import io
    import random

    from pyspark.sql.datasource import EqualTo

    from tidewright.llm.warc import WarcReader, member

    body = random.Random(1).randbytes(400_000)
    rec = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    parts = [rec % (b"response", len(body), body), rec % (b"revisit", 2, b"ok"), rec % (b"response", len(body), body)]
    packed = b"".join(map(member, parts))
    assert gzip.decompress(packed) == b"".join(parts)

    class Counting(io.BytesIO):
        got = 0

        def readinto(self, b):
            n = super().readinto(b)
            self.got += n
            return n

    reader = WarcReader({})
    assert not list(reader.pushFilters([EqualTo(("record_type",), "revisit")]))
    raw = Counting(packed)
    assert [r[0] for r in reader.members(io.BufferedReader(raw, 4096), True)] == ["revisit"] and raw.got < 40_000
    assert [r[8] for r in WarcReader({}).members(io.BufferedReader(io.BytesIO(packed), 4096), True)] == [body, None, body]
    with gzip.open(tmp_path / "foreign.warc.gz", "wb") as f:  # one stream, as other tools write
        f.write(b"".join(parts))
    from tidewright.llm.warc import read_warc

    assert [bytes(r.payload or b"") for r in read_warc(spark, f"file://{tmp_path}").collect()] == [body, b"", body]


def test_archive_edges(spark, tmp_path):
    from tidewright.llm.warc import archive_digest, read_warc

    long_ = "é" * 3_000_000
    rows = [(1, long_, "u", "x"), (2, long_, "u", "x"), (None, "short", None, "x"), (4, None, "u", "x"), (4, None, "u", "x"), (5, "z" * 1000, "u", "x"), (5, "z" * 1000, "u", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, html string, url string, payload string").selectExpr("*", "1 AS keep", "2 AS bytes", "3 AS sha1", "4 AS same", "5 AS id").repartition(2)
    got = sorted(archive_digest(df, f"file://{tmp_path}/a", records_per_file=2).collect(), key=repr)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(1, 6_000_000, sha(long_), "revisit", 2), (2, 6_000_000, sha(long_), "response", None), (None, 5, sha("short"), "response", None), (4, 0, sha(""), "response", None), (4, 0, sha(""), "response", None), (5, 1000, sha("z" * 1000), "response", None), (5, 1000, sha("z" * 1000), "response", None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert read_warc(spark, f"file://{tmp_path}/a", target_bytes=1).rdd.getNumPartitions() >= 4

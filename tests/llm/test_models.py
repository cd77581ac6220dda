"""Toxicity and language: exact inference, held-out accuracy on the small tables, and edge cases."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_marginals_are_exact():
    from tidewright.llm.toxicity import marginals

    r = np.random.default_rng(0)
    e, move, used = r.normal(size=(3, 5)), r.normal(size=(2, 2)), np.array([5, 3, 1])
    p, moves, z = marginals(e, used, move)
    want_moves, want_z = np.zeros((2, 2)), 0.0
    for c, n in enumerate(used):
        total, prob, mv = 0.0, np.zeros(5), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[c, t] * s for t, s in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for t, s in enumerate(path):
                prob[t] += w * s
            for a, b in itertools.pairwise(path):
                mv[a, b] += w
        assert np.allclose(p[c], prob / total)
        want_moves += mv / total
        want_z += np.log(total)
    assert np.allclose(moves, want_moves) and np.isclose(z, want_z)


def test_toxicity_held_out(spark):
    from tidewright.llm.queries import op6_toxicity

    rows = op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    test = [r for r in rows if r.held_out and r.toxic is not None]
    assert np.mean([r.predicted == r.toxic for r in test]) >= 0.95


def test_toxicity_recall_and_precision(spark):
    """Held-out rows of the larger table; about one in twenty of its toxic rows holds only junk, and nothing toxic."""
    from tidewright.llm.queries import op6_toxicity

    sf = "/root/testdata/sf0.1"
    rows = op6_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    hit = sum(r.toxic == 1 and r.predicted == 1 for r in rows)
    assert hit >= 0.9 * sum(r.toxic == 1 for r in rows) and hit >= 0.95 * sum(r.predicted == 1 for r in rows)


@pytest.mark.parametrize("chain", [2, 16, 128])
def test_marginals_run_through_whole_texts(monkeypatch, chain):
    from tidewright.llm import toxicity

    r = np.random.default_rng(0)
    sizes = np.array([5, 0, 300, 128, 129, 1, 700])
    e, move = 2 * r.normal(size=sizes.sum()), r.normal(size=(2, 2))
    want_p, want_moves = [], np.zeros((2, 2))
    for n, end in zip(sizes, np.cumsum(sizes)):
        if n:
            p, moves, _ = toxicity.marginals(e[None, end - n : end], np.array([n]), move)
            want_p.append(p[0])
            want_moves += moves
    monkeypatch.setattr(toxicity, "CHAIN", chain)
    p, moves = toxicity.whole_marginals(e, sizes, move)
    assert np.allclose(p, np.concatenate(want_p)) and np.allclose(moves, want_moves)


def test_training_rows_are_bounded_by_bytes(spark):
    from tidewright.llm.toxicity import training_rows

    docs = spark.createDataFrame([(i, "x" * (10 if i % 3 else 1000)) for i in range(60)] + [(5, "x" * 10)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    rows = training_rows(docs, labels, 40, 200, "doc_id", "text", "toxic").collect()
    assert max(len(r.t) for r in rows) == 10 and all(sum(len(r.t) for r in rows if r._y == y) == 100 for y in (0, 1))


def test_toxicity_edges(spark):
    from tidewright.llm.toxicity import drop_toxic, fit, score, train

    m = train(["you are a rotten fool", "a fine day", "rotten fool again", "the day is fine and long", "fool rotten", "nice"] * 40, np.array([1, 0, 1, 0, 1, 0] * 40), least_df=1)
    docs = spark.createDataFrame([(1, "Well, you ROTTEN fool!", 0.5), (2, None, 0.5), (3, "", 0.5), (4, "fine day", 0.5), (4, "fine day", 0.5), (None, "rotten " * 5000, 0.5)], "doc_id bigint, text string, score double")
    got = {(r.doc_id, r.predicted): r.spans for r in score(docs, m, spans=True).collect()}
    assert [(s.start, s.end) for s in got[1, 1]] == [(10, 21)] and got[2, 0] == [] and got[4, 0] == []
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, toxic int")
    assert drop_toxic(docs, docs, labels).columns == docs.columns
    none = fit(docs, labels.where("false"))
    assert score(docs, none).count() == 6 and score(docs.where("false"), none).count() == 0


def test_language_held_out(spark):
    from tidewright.llm.queries import op9_language

    rows = op9_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) >= 0.95


@pytest.mark.parametrize("block", [7, 256])
def test_phrases_are_greedy_longest_matches(monkeypatch, block):
    from tidewright.llm import langid

    monkeypatch.setattr(langid, "BLOCK", block)
    samples = {"a": "abracadabra alakazam", "b": "the cat sat on the mat"}
    parser = langid.Parser(samples)
    texts = ["The cat!! sat on abra", "zzz", "", "123", "mat mat mat kazam abrac"]
    counts = parser.counts(texts)
    for t, row in zip(texts, counts):
        norm = "".join(map(chr, langid.letters(t)))
        for k, lang in enumerate(parser.languages):
            s = "".join(map(chr, langid.letters(samples[lang])))
            n = 0
            for start in range(0, len(norm), block):
                part = norm[start : start + block]
                while part:
                    size = next((m for m in range(len(part), 0, -1) if part[:m] in s), 1)
                    n, part = n + 1, part[size:]
            assert row[k] == (n if any(c.isalpha() for c in norm) else 0)


def test_language_edges(spark):
    from tidewright.llm.langid import identify, language_digest, training_text

    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", 1.0), (2, None, "en", 1.0), (3, "", None, 1.0), (4, "12 + 3 = 15!", "de", 1.0), (5, "der Hund und die Katze", "de", 1.0), (5, "der Hund und die Katze", "de", 1.0), (None, "the dog " * 9000, "en", 1.0)], "doc_id bigint, text string, lang string, score double")
    samples = training_text(docs, "doc_id", "text", "lang", 5, 1000)
    assert set(samples) == {"de", "en"} and max(map(len, samples.values())) <= 1000
    got = [(r.doc_id, r.lang_pred) for r in identify(docs, samples).collect()]
    assert got == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (5, "de"), (None, "en")]
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"}
    assert language_digest(docs.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    src = spark.read.parquet(f"{SF}/documents.parquet")
    docs = src
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.columns == src.columns
        if n == 0:
            toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1")
            assert docs.join(toxic, "doc_id").count() <= 0.05 * toxic.count()
            clean = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0")
            assert docs.join(clean, "doc_id").count() >= 0.95 * clean.count()
        if n == 1:
            assert docs.count() == before.count()
    import tiktoken
    import public_tokenizers

    from tidewright.llm.bpe import read_ranks

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in docs.limit(50).collect():
        assert r.ids == enc.encode_ordinary(r.text)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert whole.where(F.size("ids") != F.col("n_tokens")).count() == 0


@pytest.mark.parametrize("lane", [16, 256])
def test_phrases_go_on_through_lanes_and_any_alphabet(monkeypatch, lane):
    import random

    from tidewright.llm import langid

    monkeypatch.setattr(langid, "LANE", lane)
    r = random.Random(1)
    han, hangul = [chr(0x4E00 + i) for i in range(2000)], [chr(0xAC00 + i) for i in range(2000)]
    samples = {"zh": "".join(r.choice(han) for _ in range(3000)), "ko": "".join(r.choice(hangul) for _ in range(3000)), "en": "the cat sat on the mat and abracadabra " * 3}
    texts = ["the cat " * 30 + " zz q ", samples["zh"][100:400] + "xx" + samples["zh"][1:90], "abab" * 50 + samples["ko"][5:200]]
    texts += ["".join(r.choice("abcdrthe mson") for _ in range(r.randrange(300))) for _ in range(40)]
    parser = langid.Parser(samples)
    for t, row in zip(texts, parser.counts(texts)):
        norm = "".join(map(chr, langid.letters(t)))
        for k, lang in enumerate(parser.languages):
            s, part, n = "".join(map(chr, langid.letters(samples[lang]))), norm, 0
            while part:
                size = next((m for m in range(len(part), 0, -1) if part[:m] in s), 1)
                n, part = n + 1, part[size:]
            assert row[k] == (n if any(c.isalpha() for c in norm) else 0)
    assert [x for x, _ in parser.best([samples["zh"][7:60], samples["ko"][9:90], "the mat"])] == ["zh", "ko", "en"]

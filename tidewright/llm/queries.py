"""The operators of this subpackage as registered queries, and SQL for those that it can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.common import drop_folder, scratch, shared, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.simhash import simhash_digest

    return simhash_digest(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.license_scan import license_digest

    return license_digest(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.line_dedup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewright.llm.bpe import bpe_digest

    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.toxicity import toxicity_digest

    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.decontaminate import contamination_digest

    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.warc import archive_digest

    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    said = shared(archive_digest(table(spark, sf_dir, "pages"), folder))
    drop_folder(spark, folder)  # what was read back is kept, the archives are not
    return said


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.langid import language_digest

    return language_digest(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_simhash, op3_license_scan, op4_line_dedup, op5_bpe, op6_toxicity, op7_decontaminate, op8_warc, op9_language, op10_pii)}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLE = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op7_decontaminate": f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(8, len(ws)) AS n, ws[i:i + least(8, len(ws)) - 1] AS gram
        FROM (SELECT item, ws, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0)),
dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dg AS (SELECT doc_id, n, i, ws[i:i + n - 1] AS gram
       FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, dg.n, item FROM dg JOIN win ON dg.n = win.n AND dg.gram = win.gram),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_warc": """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id < k THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id < k THEN k END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS k FROM pages)""",
}

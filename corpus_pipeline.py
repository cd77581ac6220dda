"""A training-corpus pipeline over ``documents``: five stages, each written and read again before the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.bpe import bpe_encode
from tidewright.llm.common import drop_folder, scratch, table
from tidewright.llm.decontaminate import decontaminate
from tidewright.llm.line_dedup import line_dedup
from tidewright.llm.simhash import near_dedup
from tidewright.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a field trained on ``labels`` scores 0.5 or more."""
    return drop_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of whole lines of 30 words or more that stood before; every document stays, with what is its own."""
    return line_dedup(docs, count_col="n_chars", whole=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: shingles of five words, Jaccard similarity of 0.8 or more.

    Fingerprints within 3 bits and equal MinHash bands say what is compared. A
    wider radius finds the same pairs, but among billions of documents it would
    also join most of them by chance into one group to be compared.
    """
    return near_dedup(docs, k=5, radius=3, blocks=4, planes=4, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of eight words of a benchmark item occurs, or a whole shorter item; one of one or two words only beside another item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1, weak_words=3)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of the byte-level tokenizer, their number and the hash of what they decode to."""
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, columns=("ids", "n_tokens", "decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("byte-level BPE", tokens)]

#: No SQL: stages train a model, chunk by rolling hashes and search trees. tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet to the cluster's shared folder and read as the next one's input.

    Nulls in any column, empty texts, repeated rows and an empty table pass
    every stage; rows that repeat an id and text share their fate. A stage's
    folder goes once the next one is written.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            drop_folder(spark, f"{folder}/{n - 1}")
    return docs

"""Exact deduplication by a 128-bit content hash with a byte comparison inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import shared, text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits: MD5 of the UTF-8 bytes."""
    return F.md5(text)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Rows whose texts are equal byte for byte form a group; ``keep`` ("min" or
    "max") says which id stays. A null text is an empty one. Rows that repeat
    an id with an equal text are one document: they count in ``group_size``
    and share the fate of their id. A null id stays only in a group without
    any other id. An empty table gives no rows; other columns are not read.

    Bodies are grouped by hash *and* text, so the byte comparison is the
    equality of the grouping key, and copies are combined before the shuffle:
    a group of any size leaves each task as one row. Texts cross the network
    once, without their copies. Rows then look up their group by hash alone;
    only hashes under which two different bodies met take the text along.
    The lookup is a join on a key that may be hot, with one row on the other
    side, which adaptive execution splits.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    text = text_or_empty(text_col)
    body = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    bodies = body.groupBy(hash_of(F.col("_text")).alias("_h"), "_text").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = shared(bodies.groupBy("_h").agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("_bodies")))
    rows = body.select("_id", hash_of(F.col("_text")).alias("_h"), F.sha2("_text", 256).alias("text_sha256"))
    found = rows.join(groups.where("_bodies = 1").drop("_bodies"), "_h")
    clash = groups.where("_bodies > 1").select("_h")
    if not clash.isEmpty():
        apart = body.withColumn("_h", hash_of(F.col("_text"))).join(clash, "_h", "left_semi").withColumn("text_sha256", F.sha2("_text", 256))
        found = found.unionByName(apart.join(bodies.join(clash, "_h", "left_semi"), ["_h", "_text"]).drop("_text"))
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

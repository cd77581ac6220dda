"""Mutable tables in replay: a log of writes in arrival order, folded by key when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.lang.lexer import DialectError

OP = "_op"


def folded(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows that the writes leave.

    Of each key, the last insert, update or upsert stands unless a delete came
    after; an update of a key that is not there does nothing.
    """
    if not key:
        raise DialectError("updates and deletes need a key")
    desc = [F.desc(c) for c in order]
    w = Window.partitionBy(*key).orderBy(*order)
    # A key is alive after an insert or upsert, and dead after a delete; updates leave that as it is.
    alive = F.last(F.when(F.col(OP).isin("insert", "upsert"), True).when(F.col(OP) == "delete", False), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = log.withColumn("_alive", F.coalesce(alive, F.lit(False))).where((F.col(OP) == "delete") | F.col("_alive"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*desc)))
    return rows.where((F.col("_r") == 1) & (F.col(OP) != "delete")).drop("_r", "_alive", OP)


def cached(df: DataFrame, max_size: int, order: list[str]) -> DataFrame:
    """The last ``max_size`` rows to come in, as a first-in-first-out cache keeps them."""
    if max_size < 1:
        raise DialectError("a cache needs a positive max_size")
    return df.orderBy(*(F.desc(c) for c in order)).limit(max_size)


def contains(table: DataFrame, probe: DataFrame) -> DataFrame:
    """The probe's rows that stand in the table as whole rows; nulls equal nulls."""
    common = [c for c in probe.columns if c in table.columns]
    t = table.select(*(F.col(c).alias(f"_t_{c}") for c in common)).distinct()
    return probe.join(t, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in common], "left_semi")

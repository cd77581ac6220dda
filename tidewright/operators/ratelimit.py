"""Output rate: every n rows or every span of time, all, the first or the last; or a snapshot of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.lang.ast import Rate
from tidewright.operators.order import SEQ, TS, dense


def limited(df: DataFrame, rate: Rate, groups: list[str] = ()) -> DataFrame:
    """Rows that the limiter sends. The rows of a last, partial group are sent at the end."""
    rows = dense(df)
    if rate.events is not None:
        rows = rows.withColumn("_unit", F.floor(F.col(SEQ) / rate.events))
    else:
        rows = rows.withColumn("_unit", F.floor(F.col(TS) / rate.ms))
    keys = ["_unit", *groups] if rate.what == "snapshot" else ["_unit"]
    if rate.what == "all":
        return rows.drop("_unit")
    first = rate.what == "first"
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc(SEQ) if first else F.desc(SEQ))))
    return rows.where("_r = 1").drop("_r", "_unit")

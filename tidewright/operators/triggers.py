"""Triggers: streams of ticks with one column, ``triggered_time`` in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.lang.ast import CreateTrigger
from tidewright.operators.order import SEQ, TS
from tidewright.operators.windows import cron_times


def ticks(spark: SparkSession, t: CreateTrigger, start: int, end: int) -> DataFrame:
    """Ticks of a replay from ``start`` to ``end``, both included: one at the start, every period after it, or at cron times."""
    if t.start:
        times = F.array(F.lit(start).cast("bigint"))
    elif t.every:
        times = F.sequence(F.lit(start + t.every).cast("bigint"), F.lit(max(end, start + t.every)).cast("bigint"), F.lit(t.every).cast("bigint"))
        times = F.filter(times, lambda x: x <= end)
    else:
        times = cron_times(None, F.lit(start), F.lit(end), t.cron or "")
    rows = spark.range(1).select(F.posexplode(times).alias(SEQ, "triggered_time"))
    return rows.select("triggered_time", F.col("triggered_time").alias(TS), F.col(SEQ).cast("bigint").alias(SEQ))


def live_ticks(spark: SparkSession, t: CreateTrigger) -> DataFrame:
    """The streaming form of a periodic trigger: the rate source, thinned to the period."""
    if not t.every:
        raise ValueError("only periodic triggers have a streaming source; start and cron ones are driven by the query's trigger")
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", t.every).load()
    return rate.select(F.unix_millis("timestamp").alias("triggered_time"))

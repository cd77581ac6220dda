"""Arrival order: event time in milliseconds and dense sequence numbers, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS, SEQ = "_ts", "_seq"
HOUR = 3_600_000
#: Sequence numbers that one task sorts when numbers are made dense again.
RUN = 1 << 18
#: Values of a time column that is a plain number (often an id, with wide rows) that one task sorts.
IDS = 1 << 14


def millis(df: DataFrame, name: str) -> Column:
    """A time column as epoch milliseconds; times without a zone are UTC."""
    t = df.schema[name].dataType
    if isinstance(t, T.TimestampNTZType | T.DateType):
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        return F.unix_millis(F.from_utc_timestamp(F.col(name).cast("timestamp"), zone) if zone != "UTC" else F.col(name).cast("timestamp"))
    if isinstance(t, T.TimestampType):
        return F.unix_millis(F.col(name))
    return F.col(name).cast("bigint")


def numbered(df: DataFrame, order: list[str], bucket: Column, name: str = SEQ, few: bool = False) -> DataFrame:
    """Adds a dense number from 0 in the order of ``order``.

    ``bucket`` must not decrease along that order. Rows are numbered within
    buckets, in parallel, and the buckets' sizes, a table of one row each,
    give each its offset. A null bucket comes first. With ``few`` buckets
    that table is broadcast: rows whose numbers nobody reads aren't shuffled.
    """
    rows = df.withColumn("_b", F.coalesce(bucket.cast("bigint"), F.lit(-(1 << 62))))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).alias("_o"))
    local = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return local.join(F.broadcast(offsets) if few else offsets, "_b").withColumn(name, F.col("_i") - 1 + F.coalesce("_o", F.lit(0))).drop("_b", "_i", "_o")


def ordered(df: DataFrame, ts: str, tiebreak: list[str] | tuple[str, ...] = (), bucket_ms: int | None = None) -> DataFrame:
    """A stream: the rows with ``_ts`` and dense ``_seq`` in the order of time, then ``tiebreak``.

    ``bucket_ms`` is the time that one task sorts: an hour, or ``IDS`` values
    of a number, which may be anything.
    """
    rows = df.withColumn(TS, millis(df, ts))
    time = isinstance(df.schema[ts].dataType, T.TimestampType | T.TimestampNTZType | T.DateType)
    return numbered(rows, [TS, *tiebreak], F.floor(F.col(TS) / (bucket_ms or (HOUR if time else IDS))), few=time)


def dense(df: DataFrame) -> DataFrame:
    """Numbers anew, in the order of the numbers there are, after a filter or union left gaps."""
    return numbered(df.withColumnRenamed(SEQ, "_was"), ["_was"], F.floor(F.col("_was") / RUN), few=True).drop("_was")


def per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Dense numbers within each key. A key's rows are numbered within ``RUN`` numbers of the stream, on top of the sizes of those before."""
    rows = df.withColumn("_b", F.floor(F.col(SEQ) / RUN))
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    ids = [*keys, "_b"]
    offsets = sizes.select(*(F.col(k).alias(f"_k_{k}") for k in ids), F.coalesce(before, F.lit(0)).alias("_o"))
    local = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*ids).orderBy(SEQ)))
    met = local.join(offsets, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in ids])
    return met.withColumn(SEQ, (F.col("_i") - 1 + F.col("_o")).cast("bigint")).drop("_b", "_i", "_o", *(f"_k_{k}" for k in ids))


def merged(streams: dict[str, DataFrame]) -> DataFrame:
    """Several streams as one: ``_from``, ``_ts``, ``_seq`` and a struct column for each stream, null on others' rows.

    Rows are in the order of time, then of the stream's name, then of their own number.
    """
    out = None
    for name, df in streams.items():
        user = [c for c in df.columns if c not in (TS, SEQ)]
        part = df.select(F.lit(name).alias("_from"), TS, F.col(SEQ).alias("_own"), F.struct(*user).alias(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return numbered(out, [TS, "_from", "_own"], F.floor(F.col(TS) / HOUR))

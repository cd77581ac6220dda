"""Windows over ordered events: frames that slide with every event, and batches that events fall into."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewright.lang.lexer import DialectError
from tidewright.operators.order import SEQ, TS, dense, per_key

#: Rows of a chunk of an ungrouped frame: what one task computes.
CHUNK = 1 << 16

FRAMES = ("length", "time", "externaltime", "running")
BATCHES = ("lengthbatch", "timebatch", "tumbling", "externaltimebatch", "session", "cron", "hopping", "sliding")


@dataclass(frozen=True)
class Spec:
    """A window with its parameters evaluated: ``n`` events, ``ms`` of time, ``column`` of time or order."""

    type: str
    n: int = 0
    ms: int = 0
    slide: int = 0
    column: str | None = None
    sort: tuple[tuple[str, bool], ...] = ()  # column, descending
    cron: str | None = None
    align: str = "first"  # batches start at the first event, or at the epoch


@dataclass
class Framed:
    """Rows with the frame to aggregate over; rows that only fill frames up have ``own`` false and go afterwards."""

    df: DataFrame
    own: Column
    keys: list[str]
    low: int | None
    by: str
    halved: bool = False

    def over(self, groups: list[str] = ()) -> WindowSpec:
        w = Window.partitionBy(*self.keys, *groups).orderBy(self.by)
        if self.low is None:
            return w.rowsBetween(Window.unboundedPreceding, 0)
        return w.rangeBetween(-self.low, 0)

    def halves(self, groups: list[str] = ()) -> list[tuple[Column, WindowSpec]]:
        """A halved frame's two parts, each with the rows it counts: own rows up to the time, and copies that leave after it."""
        w = Window.partitionBy(*self.keys, *groups)
        return [(self.own, w.orderBy(self.by).rangeBetween(Window.unboundedPreceding, 0)), (~self.own, w.orderBy(F.desc(self.by)).rangeBetween(Window.unboundedPreceding, -1))]

    def forever(self, groups: list[str] = ()) -> WindowSpec:
        return Window.partitionBy(*(k for k in self.keys if k != "_chunk"), *groups).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)


def frame(df: DataFrame, spec: Spec, keys: list[str], halved: bool = False) -> Framed:
    """The frame of a sliding window. ``keys``: a partition's keys, within which counts and times stand alone.

    A frame may span most events of its key, or all without keys, so rows are
    cut into chunks that also get the rows before them which their frames
    reach: any number of tasks computes one window. A chunk is at least as
    wide as the frame, so each row has one copy at most.

    Spark computes a sliding frame anew for each row, which grows with the
    square of the events in a window's time. ``halved``, for a window of time
    and aggregates that merge: chunks are as wide as the window, and each row
    has a copy at the time it leaves, in the next chunk. A frame is the rows
    of its chunk so far, and the copies that have yet to leave: two frames
    that only grow.
    """
    if spec.type == "running":
        return Framed(df, F.lit(True), keys, None, SEQ)
    if spec.type == "length":
        if spec.n < 1:
            raise DialectError("length takes a positive count")
        rows, by, reach, width = (per_key(df, keys) if keys else dense(df)), SEQ, spec.n - 1, max(CHUNK, spec.n)
    else:
        if spec.ms < 1:
            raise DialectError(f"{spec.type} takes a positive time")
        by = "_t"
        rows, reach, width = df.withColumn("_t", F.col(spec.column or TS).cast("bigint")), spec.ms - 1, max(CHUNK, 8 * spec.ms)
        if halved:
            leaves = F.when(F.col(by).isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
            rows = rows.withColumn("_leaves", F.explode(leaves)).withColumn(by, F.when(F.col("_leaves"), F.col(by) + spec.ms).otherwise(F.col(by)))
            return Framed(rows.withColumn("_chunk", F.col(by) - F.pmod(by, F.lit(spec.ms))), ~F.col("_leaves"), [*keys, "_chunk"], reach, by, True)
    home = F.floor(F.col(by) / width)
    copies = F.when(F.floor((F.col(by) + reach) / width) > home, F.array(home, home + 1)).otherwise(F.array(home))
    rows = rows.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    return Framed(rows, F.col("_chunk").eqNullSafe(F.col("_home")), [*keys, "_chunk"], reach, by)


def batches(df: DataFrame, spec: Spec, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with the number of their batch in ``_batch``; open batches are left out where the window never sends them. Returns the columns that tell batches apart."""
    ids = [*keys, "_batch"]
    if spec.type == "lengthbatch":
        rows = per_key(df, keys) if keys else dense(df)
        rows = rows.withColumn("_batch", F.floor(F.col(SEQ) / spec.n).cast("bigint"))
        full = rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == spec.n).drop("_n")
        return rows.join(full, ids, "left_semi") if not keys else _same_keys(rows, full, ids), ids
    if spec.type in ("timebatch", "tumbling", "externaltimebatch"):
        t = F.col(spec.column or TS).cast("bigint")
        rows = df.withColumn("_t", t)
        bounds = rows.groupBy(*keys).agg(F.min("_t").alias("_t0"), F.max("_t").alias("_t1"))
        rows = _with(rows, bounds, keys)
        start = F.lit(0).cast("bigint") if spec.align == "epoch" else F.col("_t0")
        rows = rows.withColumn("_batch", F.floor((F.col("_t") - start) / spec.ms).cast("bigint"))
        last = F.floor((F.col("_t1") - start) / spec.ms).cast("bigint")
        closed = rows if spec.align == "epoch" else rows.where(F.col("_batch") < last)
        return closed.withColumn("_start", start + F.col("_batch") * spec.ms).drop("_t", "_t0", "_t1"), ids
    if spec.type in ("hopping", "sliding"):
        t, size, slide = F.col(spec.column or TS).cast("bigint"), spec.ms, spec.slide
        last = F.floor(t / slide)
        first = F.floor((t - size) / slide) + 1
        rows = df.withColumn("_batch", F.explode(F.sequence(first, last)))
        return rows.withColumn("_start", F.col("_batch") * slide), ids
    if spec.type == "session":
        return sessions(df, spec.ms, keys)
    if spec.type == "cron":
        return cron_batches(df, spec.cron or "", keys)
    raise DialectError(f"unknown window {spec.type}")


def _with(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Joins a row for each key, or the only row; null keys match."""
    if not keys:
        return rows.crossJoin(F.broadcast(small))  # one row
    other = small.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(other, on).drop(*(f"_k_{k}" for k in keys))


def _same_keys(rows: DataFrame, full: DataFrame, ids: list[str]) -> DataFrame:
    other = full.select(*(F.col(k).alias(f"_k_{k}") for k in ids))
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in ids], "left_semi")


def sessions(df: DataFrame, gap: int, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Sessions of each key: an event belongs on while it comes at most ``gap`` after the last one.

    Without keys, days of events are marked in parallel: the first event of a
    day looks at the last of the days before through one row a day.
    """
    if keys:
        w = Window.partitionBy(*keys).orderBy(SEQ)
        new = F.coalesce(F.col(TS) - F.lag(TS).over(w) > gap, F.lit(True))
        rows = df.withColumn("_new", new.cast("int")).withColumn("_batch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint") - 1)
        return rows.drop("_new"), [*keys, "_batch"]
    width = 86_400_000
    rows = df.withColumn("_day", F.floor(F.col(TS) / width))
    w = Window.partitionBy("_day").orderBy(SEQ)
    rows = rows.withColumn("_before", F.lag(TS).over(w))
    days = rows.groupBy("_day").agg(F.max(TS).alias("_last"), F.min(TS).alias("_first"), F.sum(F.when(F.col(TS) - F.col("_before") > gap, 1).otherwise(0)).alias("_breaks"))
    across = Window.orderBy("_day")
    days = days.withColumn("_open", F.coalesce(F.col("_first") - F.lag("_last").over(across) > gap, F.lit(True)).cast("int"))
    days = days.withColumn("_base", F.sum(F.col("_open") + F.col("_breaks")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_breaks"))
    rows = rows.join(days.select("_day", "_base"), "_day")
    inside = F.sum(F.when(F.col(TS) - F.col("_before") > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_batch", (F.col("_base") + inside - 1).cast("bigint")).drop("_day", "_before", "_base"), ["_batch"]


#: The fields of a cron string with their bounds.
CRON_FIELDS = (("second", 0, 59), ("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


def cron_fields(text: str) -> list[set[int]]:
    """The values that each of six fields (or five, at second 0) admits; weekday 0 and 7 are Sunday."""
    parts = text.split()
    if len(parts) == 5:
        parts = ["0", *parts]
    if len(parts) not in (6, 7):
        raise DialectError(f"cron takes five or six fields: {text!r}")
    names = {m: i for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)} | {d: i for i, d in enumerate("SUN MON TUE WED THU FRI SAT".split())}
    out = []
    for part, (what, low, high) in zip(parts, CRON_FIELDS):
        held: set[int] = set()
        for piece in part.upper().split(","):
            piece, _, step = piece.partition("/")
            value = lambda s, what=what: names.get(s) if s in names else int(s)
            try:
                if piece in ("*", "?"):
                    a, b = low, high
                elif "-" in piece:
                    a, b = map(value, piece.split("-"))
                else:
                    a = value(piece)
                    b = high if step else a
                held.update(range(a, b + 1, int(step or 1)))
            except ValueError:
                raise DialectError(f"cron {what} {part!r}") from None
        if not held or min(held) < low or max(held) > high:
            raise DialectError(f"cron {what} {part!r}")
        out.append({0 if what == "weekday" and v == 7 else v for v in held})
    return out


def cron_times(df_or_spark, low: Column, high: Column, text: str, rows: DataFrame | None = None) -> Column:
    """All fire times in a range of milliseconds as an array: seconds that every field admits."""
    fields = cron_fields(text)
    step = 1_000 if fields[0] != {0} else 60_000
    at = lambda ms: F.timestamp_millis(ms)
    tests = (F.second, F.minute, F.hour, F.dayofmonth, F.month, lambda t: F.dayofweek(t) - 1)
    full = ({*range(60)}, {*range(60)}, {*range(24)}, {*range(1, 32)}, {*range(1, 13)}, {*range(7)})

    def admits(ms: Column) -> Column:
        out = F.lit(True)
        for f, held, every in zip(tests, fields, full):
            if held != every and not (step == 60_000 and f is F.second):
                out = out & f(at(ms)).isin(sorted(held))
        return out

    start = (F.floor(low / step) * step).cast("bigint")
    return F.filter(F.sequence(start, high.cast("bigint"), F.lit(step).cast("bigint")), admits)


def cron_batches(df: DataFrame, text: str, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Batches that a cron schedule sends: an event belongs to the first fire time after it. A batch still open at the end is left out.

    Only the distinct minutes (or seconds) of events meet the schedule's fire times.
    """
    bounds = df.agg(F.min(TS).alias("a"), F.max(TS).alias("b"))
    fires = bounds.select(F.explode(cron_times(None, F.col("a"), F.col("b"), text)).alias("_f"))
    marks = df.select(F.col(TS).alias("_t"), F.lit(1).alias("_e")).distinct().unionByName(fires.select(F.col("_f").alias("_t"), F.lit(0).alias("_e")))
    day = marks.withColumn("_d", F.floor(F.col("_t") / 86_400_000))
    w = Window.partitionBy("_d").orderBy(F.desc("_t"), F.desc("_e")).rowsBetween(Window.unboundedPreceding, 0)
    fired = F.when(F.col("_e") == 0, F.col("_t"))
    near = day.withColumn("_in", F.last(fired, ignorenulls=True).over(w))
    firsts = day.groupBy("_d").agg(F.min(fired).alias("_f"))
    later = Window.orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.select("_d", F.last("_f", ignorenulls=True).over(later).alias("_next"))
    found = near.where("_e = 1").join(after, "_d").select("_t", F.coalesce("_in", "_next").alias("_batch"))
    rows = df.join(found.where("_batch is not null"), F.col(TS) == F.col("_t")).drop("_t")
    return rows, [*keys, "_batch"]


def sort_window(df: DataFrame, n: int, order: list[tuple[str, bool]], keys: list[str]) -> DataFrame:
    """The final state of a sort window: the n first events of each key in the given order; of equal ones the earlier stay."""
    by = [(F.desc_nulls_last if down else F.asc_nulls_last)(c) for c, down in order]
    if not keys:
        return df.orderBy(*by, SEQ).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by, SEQ))).where(F.col("_r") <= n).drop("_r")


def sort_states(df: DataFrame, n: int, column: str, descending: bool, keys: list[str], out: str = "_top") -> DataFrame:
    """For every event, the window's n first values after it arrived, as an array: a running top-n.

    The state is an array of at most n values that a fold over the events
    before keeps; each chunk starts from the top-n of all chunks before it,
    which is a row for each chunk.
    """
    direction = -1 if descending else 1
    rows = (per_key(df, keys) if keys else dense(df)).withColumn("_chunk", F.floor(F.col(SEQ) / 1024))
    top = lambda c: F.slice(F.sort_array(c, asc=direction > 0), 1, n)
    held = rows.groupBy(*keys, "_chunk").agg(top(F.collect_list(column)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("_before", top(F.flatten(F.collect_list("_c").over(w)))).drop("_c")
    inner = Window.partitionBy(*keys, "_chunk").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    rows = _with(rows, before, [*keys, "_chunk"]).withColumn("_in", F.collect_list(column).over(inner))
    return rows.withColumn(out, top(F.concat(F.coalesce("_before", F.array().cast(df.select(F.collect_list(column)).schema[0].dataType)), F.col("_in")))).drop("_before", "_in", "_chunk")


def expired(df: DataFrame, spec: Spec, keys: list[str]) -> DataFrame:
    """The events that a sliding window lets go, as rows with the ``_ts`` and ``_seq`` at which they go.

    Of a length window, when the n-th event after arrives; of a time window,
    when its time is over, if an event arrives then or later.
    """
    if spec.type == "length":
        rows = per_key(df, keys) if keys else dense(df)
        later = rows.select(*(F.col(k).alias(f"_k_{k}") for k in keys), (F.col(SEQ) - spec.n).alias("_s"), F.col(TS).alias("_at"))
        on = [F.col(SEQ) == F.col("_s"), *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)]
        return rows.join(later, on).withColumn(TS, F.col("_at")).withColumn(SEQ, F.col(SEQ) + spec.n).drop("_s", "_at", *(f"_k_{k}" for k in keys))
    bounds = df.groupBy(*keys).agg(F.max(TS).alias("_end"))
    return _with(df, bounds, keys).where(F.col(TS) + spec.ms <= F.col("_end")).withColumn(TS, F.col(TS) + spec.ms).drop("_end")


def delayed(df: DataFrame, ms: int) -> DataFrame:
    """Every event later by a fixed time; the order stays."""
    return df.withColumn(TS, F.col(TS) + ms)

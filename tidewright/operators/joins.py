"""Joins of streams and tables in replay: eager outer rows, windows on either side, as-of lookups of changing tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.lang.lexer import DialectError
from tidewright.operators.order import SEQ, TS
from tidewright.operators.windows import Spec


@dataclass
class Side:
    """A join's input with its columns prefixed, and the names of its order columns."""

    df: DataFrame
    ts: str
    seq: str
    window: Spec | None = None


def together(left: Side, right: Side) -> tuple[Side, Side]:
    """Both sides with one sequence over their arrivals: by time, then left before right, then own number.

    Each side's number gets its place among both; only (time, number) pairs are merged.
    """
    from tidewright.operators.order import HOUR, numbered

    marks = left.df.select(F.lit(0).alias("_side"), F.col(left.ts).alias("_t"), F.col(left.seq).alias("_s")).unionByName(right.df.select(F.lit(1).alias("_side"), F.col(right.ts).alias("_t"), F.col(right.seq).alias("_s")))
    all_ = numbered(marks, ["_t", "_side", "_s"], F.floor(F.col("_t") / HOUR), "_all")
    out = []
    for n, s in enumerate((left, right)):
        own = all_.where(F.col("_side") == n).select(F.col("_s").alias("_own"), "_all")
        df = s.df.join(own, F.col(s.seq) == F.col("_own")).withColumn(s.seq, F.col("_all")).drop("_own", "_all")
        out.append(Side(df, s.ts, s.seq, s.window))
    return out[0], out[1]


def stream_join(left: Side, right: Side, on: Column | None, how: str, outer: str = "eager", unidirectional: str | None = None) -> DataFrame:
    """Pairs with ``_ts`` and ``_seq`` of the later event.

    ``outer="eager"``: a row that finds no partner among the events *before*
    it is sent alone when it arrives, besides its later pairs. "final": only
    rows without any partner. With windows, a pair needs the earlier event to
    be still in its side's window when the later one arrives.
    """
    both = together(left, right)
    left, right = _ranked(both[0], both[1])
    l_seq, r_seq = F.col(left.seq), F.col(right.seq)
    tests = [on] if on is not None else []
    df_l, df_r = left.df, right.df
    band = _batch_ids(left, right) if _batched(left) and _batched(right) else None
    if band is not None:
        df_l, df_r = band
        tests.append(F.col("_lb") == F.col("_rb"))
    elif any(s.window and s.window.type == "length" for s in (left, right)) or (left.window is None) != (right.window is None):
        return _by_first(left, right, tests, how, outer, unidirectional)
    else:
        if left.window or right.window:
            df_l, df_r, equal = _banded(left, right, df_l, df_r)
            tests += equal
        tests.append(F.when(l_seq < r_seq, _alive(left, right)).otherwise(_alive(right, left)))
    if unidirectional:
        tests.append(r_seq < l_seq if unidirectional == "left" else l_seq < r_seq)
    out = _paired(df_l.join(df_r, _all(tests)), left, right)
    for side, other, a, b, wanted in ((left, right, df_l, df_r, how in ("left", "full")), (right, left, df_r, df_l, how in ("right", "full"))):
        if wanted:
            earlier = [F.col(other.seq) < F.col(side.seq)] if outer == "eager" else []
            alone = a.join(b, _all(tests + earlier), "left_anti")
            if {"_lband", "_rband"} & set(alone.columns):
                alone = _once(a, b, side, tests + earlier)
            out = out.unionByName(_lone(alone, side), allowMissingColumns=True)
    return out


#: Columns that only serve the join.
EXTRA = ("_lb", "_rb", "_lband", "_rband", "_lrank", "_rrank", "_lseen", "_rseen")


def _paired(pairs: DataFrame, left: Side, right: Side) -> DataFrame:
    return pairs.withColumn(TS, F.greatest(left.ts, right.ts)).withColumn(SEQ, F.greatest(left.seq, right.seq)).drop(*EXTRA)


def _lone(rows: DataFrame, side: Side) -> DataFrame:
    return rows.withColumn(TS, F.col(side.ts)).withColumn(SEQ, F.col(side.seq)).drop(*EXTRA)


def _by_first(left: Side, right: Side, tests: list[Column], how: str, outer: str, unidirectional: str | None) -> DataFrame:
    """Pairs whose left event came first, then those whose right event did: of each, only the first one's window counts, which is a band of its ordinals or times."""
    cases = []
    for first, later in ((left, right), (right, left)):
        if unidirectional and (later is left) != (unidirectional == "left"):
            continue
        a, b, equal = _reach(first, later)
        dl, dr = (a, b) if first is left else (b, a)
        cases.append((first, dl, dr, [*tests, *equal, F.col(first.seq) < F.col(later.seq), _alive(first, later)]))
    out = None
    for _, dl, dr, found in cases:
        part = _paired(dl.join(dr, _all(found)), left, right)
        out = part if out is None else out.unionByName(part)
    for side, wanted in ((left, how in ("left", "full")), (right, how in ("right", "full"))):
        if wanted:
            alone = side.df
            for first, dl, dr, found in cases:
                if outer == "eager" and first is side:
                    continue
                a, b = (dl, dr) if side is left else (dr, dl)
                matched = a.join(b, _all(found), "left_semi").select(F.col(side.seq).alias("_m")).distinct()
                alone = alone.join(matched, F.col(side.seq) == F.col("_m"), "left_anti")
            out = out.unionByName(_lone(alone, side), allowMissingColumns=True)
    return out


def _reach(first: Side, later: Side) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Bands as wide as the window of ``first``, in one of which each of its rows is: the window that ``later`` sees lies in two at most."""
    w, (f, n) = first.window, ("_lband", "_rband") if first.seq.startswith("_l") else ("_rband", "_lband")
    if w is None:
        return first.df, later.df, []
    if w.type == "length":
        seen, rank = ("_rseen", "_lrank") if first.seq.startswith("_l") else ("_lseen", "_rrank")
        home, low, high, width = F.col(rank), F.col(seen) - w.n, F.col(seen) - 1, w.n
    elif w.type in ("time", "externaltime", "session"):
        home, low, high, width = F.col(first.ts), F.col(later.ts) - w.ms + 1, F.col(later.ts), w.ms
    else:
        raise DialectError(f"a join takes length, time or batch windows, not {w.type}")
    bands = F.array_distinct(F.array(F.floor(low / width), F.floor(high / width)))
    return first.df.withColumn(f, F.floor(home / width)), later.df.withColumn(n, F.explode(bands)), [F.col(f) == F.col(n)]


def _once(a: DataFrame, b: DataFrame, side: Side, tests: list[Column]) -> DataFrame:
    """Rows of ``a``, which may have copies by band, none of whose copies has a partner."""
    matched = a.join(b, _all(tests), "left_semi").select(F.col(side.seq).alias("_m")).distinct()
    return a.join(matched, F.col(side.seq) == F.col("_m"), "left_anti").dropDuplicates([side.seq])


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _batched(s: Side) -> bool:
    return s.window is not None and s.window.type in ("tumbling", "timebatch", "externaltimebatch", "lengthbatch")


def _batch_ids(left: Side, right: Side) -> tuple[DataFrame, DataFrame]:
    """Batch windows on both sides join batch by batch; times count from the epoch, so that both sides agree."""
    out = []
    for s, name in ((left, "_lb"), (right, "_rb")):
        w = s.window
        rank = "_lrank" if name == "_lb" else "_rrank"
        out.append(s.df.withColumn(name, F.floor(F.col(rank) / w.n) if w.type == "lengthbatch" else F.floor(F.col(s.ts) / w.ms)))
    return out[0], out[1]


def _ranked(left: Side, right: Side) -> tuple[Side, Side]:
    """Adds what length windows need: each event's ordinal on its side, and how many of the other side came before it."""
    if not any(s.window and s.window.type in ("length", "lengthbatch") for s in (left, right)):
        return left, right
    from tidewright.operators.order import RUN

    marks = left.df.select(F.lit(0).alias("_side"), F.col(left.seq).alias("_q")).unionByName(right.df.select(F.lit(1).alias("_side"), F.col(right.seq).alias("_q")))
    marks = marks.withColumn("_b", F.floor(F.col("_q") / RUN))
    is_left = F.when(F.col("_side") == 0, 1).otherwise(0)
    sizes = marks.groupBy("_b").agg(F.sum(is_left).alias("_nl"))
    before = sizes.select("_b", F.coalesce(F.sum("_nl").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ol"))
    w = Window.partitionBy("_b").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("_cl", F.sum(is_left).over(w)).join(before, "_b").withColumn("_lefts", F.col("_cl") + F.col("_ol"))
    # _q is dense over both sides: lefts up to and with it, and so rights
    marks = marks.select("_side", "_q", "_lefts", (F.col("_q") + 1 - F.col("_lefts")).alias("_rights"))
    l_marks = marks.where("_side = 0").select(F.col("_q").alias("_x"), (F.col("_lefts") - 1).alias("_lrank"), F.col("_rights").alias("_lseen"))
    r_marks = marks.where("_side = 1").select(F.col("_q").alias("_x"), (F.col("_rights") - 1).alias("_rrank"), F.col("_lefts").alias("_rseen"))
    dl = left.df.join(l_marks, F.col(left.seq) == F.col("_x")).drop("_x")
    dr = right.df.join(r_marks, F.col(right.seq) == F.col("_x")).drop("_x")
    return Side(dl, left.ts, left.seq, left.window), Side(dr, right.ts, right.seq, right.window)


def _alive(first: Side, later: Side) -> Column:
    """Whether ``first``, which came earlier, is still in its window when ``later`` comes."""
    w = first.window
    if w is None:
        return F.lit(True)
    if w.type in ("time", "externaltime", "session"):
        return F.col(later.ts) - F.col(first.ts) < w.ms
    if w.type == "length":
        seen, rank = ("_rseen", "_lrank") if first.seq.startswith("_l") else ("_lseen", "_rrank")
        return F.col(seen) - F.col(rank) <= w.n
    raise DialectError(f"a join takes length, time or batch windows, not {w.type}")


def _banded(left: Side, right: Side, dl: DataFrame, dr: DataFrame) -> tuple[DataFrame, DataFrame, list[Column]]:
    """A range join as an equi-join: time is cut into bands as wide as the wider window, and the right side's rows go to three."""
    spans = [s.window.ms for s in (left, right) if s.window and s.window.type != "length"]
    if len(spans) < 2:
        return dl, dr, []
    width = max(spans)
    home = F.floor(F.col(right.ts) / width)
    return dl.withColumn("_lband", F.floor(F.col(left.ts) / width)), dr.withColumn("_rband", F.explode(F.array(home - 1, home, home + 1))), [F.col("_lband") == F.col("_rband")]


def lookup(stream: DataFrame, table: DataFrame, on: Column, how: str) -> DataFrame:
    """A table that does not change: inner or left. Spark picks the strategy by the table's size."""
    if how not in ("inner", "left"):
        raise DialectError("a stream looks tables up by INNER or LEFT joins")
    return stream.join(table, on, how)


def as_of(stream: DataFrame, writes: DataFrame, stream_key: str, table_key: str, columns: list[str], ts: str = TS, seq: str = SEQ, write_ts: str = TS, write_seq: str = SEQ, deleted: str | None = None, how: str = "inner") -> DataFrame:
    """Each event with the last write of its key before it; of equal times a write counts as before.

    Stream and writes meet in one sort by key and time, and the last write is
    carried forward: one shuffle, no pairs.
    """
    held = F.struct(*(F.col(c) for c in columns), (F.col(deleted) if deleted else F.lit(False)).alias("_gone"))
    a = stream.select(F.col(stream_key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.col(seq).alias("_s"), F.struct(*stream.columns).alias("_row"), F.lit(None).cast(_type(writes, held)).alias("_w"))
    b = writes.select(F.col(table_key).alias("_k"), F.col(write_ts).alias("_t"), F.lit(0).alias("_side"), F.col(write_seq).alias("_s"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), held.alias("_w"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_s").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_last", F.when(F.col("_k").isNotNull(), F.last("_w", ignorenulls=True).over(w))).where("_side = 1")
    live = F.col("_last").isNotNull() & ~F.col("_last._gone")
    out = met if how == "left" else met.where(live)
    return out.select("_row.*", *(F.when(live, F.col(f"_last.{c}")).alias(c) for c in columns))


def _type(df: DataFrame, c: Column):
    return df.select(c.alias("x")).schema["x"].dataType


def member(stream: DataFrame, table: DataFrame, value: Callable[[DataFrame], Column], column: str, negated: bool = False) -> DataFrame:
    """``x IN table``: a semi join, or an anti join."""
    t = table.select(F.col(column).alias("_m")).distinct()
    return stream.join(t, value(stream) == F.col("_m"), "left_anti" if negated else "left_semi")

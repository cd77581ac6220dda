"""Event patterns in replay: pointers to next events where steps are single, a state machine where they are not."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.lang import ast as A
from tidewright.lang.lexer import DialectError
from tidewright.operators.order import SEQ, TS


@dataclass
class Events:
    """The merged events of a pattern's streams: ``_ts``, ``_seq``, ``_from``, a struct for each stream, and partition keys."""

    df: DataFrame
    keys: list[str] = field(default_factory=list)


def is_step(step: A.Step | A.Absent, test: Callable[[A.Step], Column | None]) -> Column:
    """Whether a merged row is an event of the step; ``test`` makes its filter, if that looks at this event alone."""
    out = F.col("_from") == step.stream
    where = test(step)
    return out if where is None else out & F.coalesce(where, F.lit(False))


def chain(events: Events, p: A.Pattern, test: Callable[[A.Step], Column | None]) -> DataFrame:
    """Matches of single steps: a struct column for each label, with ``_ts`` and ``_seq`` of the last.

    PATTERN: each first event takes the first fitting event after it for the
    next step, and so on; without EVERY only the earliest start that completes
    in time stays. SEQUENCE: the events follow each other without another
    event of these streams between; a run starts where the last one ended.

    The next event of a kind is a running minimum from the end, all pointers
    of all starts in one window; each step then looks its event up by number.
    With keys everything is per key; without, chunks of the sequence look
    beyond their end through one row a chunk.
    """
    steps = [s for s in p.steps if isinstance(s, A.Step)]
    if p.mode == "sequence":
        return _consecutive(events, p, steps, test)
    df = events.df
    out = _starts(df, steps[0], test, events.keys)
    for before, step in zip(steps, steps[1:]):
        wanted = is_step(step, test)
        nexts = _next_pointers(df, wanted, events.keys)
        there = df.where(wanted).select(*(F.col(k).alias(f"_n_{k}") for k in events.keys), F.col(SEQ).alias("_to"), F.col(TS).alias("_t2"), F.col(step.stream).alias(f"_{step.label}"))
        out = out.join(nexts, [F.col("_at") == F.col("_p"), *(F.col(f"_k_{k}").eqNullSafe(F.col(f"_q_{k}")) for k in events.keys)]).drop("_p", *(f"_q_{k}" for k in events.keys))
        out = out.join(there, [F.col("_next") == F.col("_to"), *(F.col(f"_k_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in events.keys)])
        out = out.withColumn("_at", F.col("_to")).withColumn("_t1", F.col("_t2")).drop("_next", "_to", "_t2", *(f"_n_{k}" for k in events.keys))
        if p.within is not None:
            out = out.where(F.col("_t1") - F.col("_t0") <= p.within)
        if p.within_events is not None:
            out = out.where(F.col("_at") - F.col("_s0") < p.within_events)
    if not p.every:
        w = Window.partitionBy(*(f"_k_{k}" for k in events.keys)).orderBy("_s0")
        out = out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r") if events.keys else out.orderBy("_s0").limit(1)
    return _named(out, steps, events.keys)


def _starts(df: DataFrame, step: A.Step, test, keys: list[str]) -> DataFrame:
    return df.where(is_step(step, test)).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(SEQ).alias("_s0"), F.col(TS).alias("_t0"), F.col(SEQ).alias("_at"), F.col(TS).alias("_t1"), F.col(step.stream).alias(f"_{step.label}"))


def _named(out: DataFrame, steps: list[A.Step], keys: list[str]) -> DataFrame:
    return out.select(*(F.col(f"_k_{k}").alias(k) for k in keys), *(F.col(f"_{s.label}").alias(s.label) for s in steps), F.col("_t1").alias(TS), F.col("_at").alias(SEQ))


def _next_pointers(df: DataFrame, wanted: Column, keys: list[str]) -> DataFrame:
    """For each event (``_p``, keys ``_q_…``) the number of the first wanted event after it, ``_next``.

    Frames go from the end: Spark adds to a growing frame, but computes a shrinking one anew for each row.
    """
    mark = F.when(wanted, F.col(SEQ))
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.desc(SEQ)).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(F.col(SEQ).alias("_p"), *(F.col(k).alias(f"_q_{k}") for k in keys), F.min(mark).over(w).alias("_next")).where("_next is not null")
    rows = df.select(SEQ, mark.alias("_m"), F.floor(F.col(SEQ) / (1 << 16)).alias("_c"))
    firsts = rows.groupBy("_c").agg(F.min("_m").alias("_f"))
    beyond = firsts.select("_c", F.min("_f").over(Window.orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    w = Window.partitionBy("_c").orderBy(F.desc(SEQ)).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.min("_m").over(w)).join(beyond, "_c")
    return near.select(F.col(SEQ).alias("_p"), F.coalesce("_near", "_later").alias("_next")).where("_next is not null")


def _consecutive(events: Events, p: A.Pattern, steps: list[A.Step], test) -> DataFrame:
    """All places where the steps' events stand one right after the other; of overlapping ones the first, then the next after its end."""
    df, n = events.df, len(steps)
    if events.keys:
        w = Window.partitionBy(*events.keys).orderBy(SEQ)
        rows = df.withColumn("_i", F.row_number().over(w) - 1)
    else:
        rows = df.withColumn("_i", F.col(SEQ))
    out = None
    for k, s in enumerate(steps):
        part = rows.where(is_step(s, test)).select(*(F.col(c).alias(f"_k_{c}") for c in events.keys), (F.col("_i") - k).alias("_s0"), F.col(TS).alias(f"_t_{k}"), F.col(SEQ).alias(f"_q_{k}"), F.col(s.stream).alias(f"_{s.label}"))
        on = ["_s0", *(f"_k_{c}" for c in events.keys)]
        if out is None:
            out = part
        else:
            other = part.select(*(F.col(c).alias(f"__{c}") for c in on), *(c for c in part.columns if c not in on))
            out = out.join(other, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]).drop(*(f"__{c}" for c in on))
    out = out.withColumn("_t0", F.col("_t_0")).withColumn("_t1", F.col(f"_t_{n - 1}")).withColumn("_at", F.col(f"_q_{n - 1}"))
    if p.within is not None:
        out = out.where(F.col("_t1") - F.col("_t0") <= p.within)
    if n > 1:
        # Starts within n - 1 places of each other overlap. Runs of such starts are taken greedily, a fold over the run.
        keys = [f"_k_{c}" for c in events.keys]
        w = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_s0")
        fresh = F.coalesce(F.col("_s0") - F.lag("_s0").over(w) >= n, F.lit(True)).cast("int")
        out = out.withColumn("_run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        taken = out.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list("_s0")).alias("_all"))
        greedy = F.aggregate("_all", F.array().cast("array<bigint>"), lambda a, s: F.when(F.coalesce(s - F.try_element_at(a, F.lit(-1)) >= n, F.lit(True)), F.concat(a, F.array(s))).otherwise(a))
        picked = taken.select(*(F.col(c).alias(f"__{c}") for c in keys), F.explode(greedy).alias("_pick"))
        out = out.join(picked, [F.col("_s0") == F.col("_pick"), *(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys)], "left_semi")
    return _named(out, steps, events.keys)


def both(events: Events, x: A.Logical, test) -> DataFrame:
    """Top-level AND: the i-th event of one step with the i-th of the other, at the later of the two."""
    from tidewright.operators.order import dense

    sides = []
    for s in (x.a, x.b):
        rows = events.df.where(is_step(s, test)).select(*events.keys, F.col(TS).alias("_t"), SEQ, F.col(s.stream).alias(s.label), F.col(SEQ).alias("_q"))
        if events.keys:
            rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*events.keys).orderBy(SEQ))).drop(SEQ)
        else:
            rows = dense(rows).withColumnRenamed(SEQ, "_i")
        sides.append(rows)
    a, b = sides
    b = b.select(*(F.col(k).alias(f"_b_{k}") for k in events.keys), F.col("_t").alias("_bt"), F.col("_q").alias("_bq"), F.col("_i").alias("_bi"), x.b.label)
    out = a.join(b, [F.col("_i") == F.col("_bi"), *(F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in events.keys)])
    return out.select(*events.keys, x.a.label, x.b.label, F.greatest("_t", "_bt").alias(TS), F.greatest("_q", "_bq").alias(SEQ))


def either(events: Events, x: A.Logical, test) -> DataFrame:
    """Top-level OR: every event of either step, the other null."""
    a, b = is_step(x.a, test), is_step(x.b, test)
    return events.df.where(a | b).select(*events.keys, F.when(a, F.col(x.a.stream)).alias(x.a.label), F.when(b & ~a if x.a.stream == x.b.stream else b, F.col(x.b.stream)).alias(x.b.label), TS, SEQ)


def absent_after(events: Events, first: A.Step, no: A.Absent, test) -> DataFrame:
    """``A -> NOT B FOR d``: each A that no B follows within d, at A's time plus d, if the events reach so far."""
    rows = events.df
    wanted = is_step(no, test)
    nexts = _next_pointers(rows, wanted, events.keys)
    times = rows.where(wanted).select(F.col(SEQ).alias("_to"), F.col(TS).alias("_t2"))
    follow = nexts.join(times, F.col("_next") == F.col("_to")).select("_p", "_t2") if not events.keys else nexts.join(rows.where(wanted).select(F.col(SEQ).alias("_to"), F.col(TS).alias("_t2"), *(F.col(k).alias(f"_n_{k}") for k in events.keys)), [F.col("_next") == F.col("_to"), *(F.col(f"_q_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in events.keys)]).select("_p", "_t2", *(f"_q_{k}" for k in events.keys))
    a = _starts(rows, first, test, events.keys)
    end = rows.agg(F.max(TS).alias("_end"))
    out = a.join(follow, [F.col("_at") == F.col("_p"), *(F.col(f"_k_{k}").eqNullSafe(F.col(f"_q_{k}")) for k in events.keys)], "left").crossJoin(F.broadcast(end))
    out = out.where((F.col("_t2").isNull() | (F.col("_t2") - F.col("_t0") > no.wait)) & (F.col("_t0") + no.wait <= F.col("_end")))
    return _named(out.withColumn("_t1", F.col("_t0") + no.wait), [first], events.keys)


def absent_before(events: Events, no: A.Absent, then: A.Step, test) -> DataFrame:
    """``NOT A FOR d -> B``: each B with no A in the d before it."""
    rows = events.df
    last = F.last(F.when(is_step(no, test), F.col(TS)), ignorenulls=True)
    if events.keys:
        rows = rows.withColumn("_before", last.over(Window.partitionBy(*events.keys).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, -1)))
    else:
        rows = rows.withColumn("_c", F.floor(F.col(SEQ) / (1 << 16)))
        ends = rows.groupBy("_c").agg(F.max(F.when(is_step(no, test), F.col(TS))).alias("_e"))
        prior = ends.select("_c", F.last("_e", ignorenulls=True).over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)).alias("_prior"))
        rows = rows.withColumn("_near", last.over(Window.partitionBy("_c").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, -1))).join(prior, "_c").withColumn("_before", F.coalesce("_near", "_prior"))
    hits = rows.where(is_step(then, test) & (F.col("_before").isNull() | (F.col(TS) - F.col("_before") > no.wait)))
    return hits.select(*events.keys, F.col(then.stream).alias(then.label), TS, SEQ)


# The state machine


class Machine:
    """A pattern over the events of one key, in order; rows are dicts of a step's events.

    Shared by the replay and the live form. An instance is a position in the
    steps with the events taken so far. A step {m,n} takes each fitting event;
    from m on, every further one is also a candidate to go on from, so a
    start may have several matches, one for each count. A logical step takes
    both of its events in any order, or either. Without EVERY the machine
    ends with its first match; a SEQUENCE drops instances that an event of
    these streams doesn't move, and starts anew after a match.
    """

    def __init__(self, p: A.Pattern, fits: Callable[[A.Step, dict, dict], bool], limit: int = 100_000):
        self.p, self.fits, self.limit = p, fits, limit
        self.steps = p.steps
        self.live: list[dict] = []
        self.done = False

    def state(self) -> dict:
        return {"live": self.live, "done": self.done}

    def load(self, state: dict) -> None:
        self.live, self.done = state["live"], state["done"]

    def feed(self, stream: str, row: dict, ts: int, seq: int) -> list[dict]:
        """The matches that this event completes, each label -> list of rows."""
        if self.done:
            return []
        p = self.p
        if p.within is not None:
            self.live = [i for i in self.live if ts - i["t0"] <= p.within]
        if p.within_events is not None:
            self.live = [i for i in self.live if seq - i["s0"] < p.within_events]
        out, kept = [], []
        for i in self.live:
            moved = self._advance(i, stream, row)
            kept += [x for x in moved if x is not None and not self._complete(x)]
            out += [x for x in moved if x is not None and self._complete(x)]
            if not any(m is not None for m in moved) and p.mode == "pattern":
                kept.append(i)
        if p.mode == "pattern" or not out:
            begin = {"step": 0, "got": {}, "t0": ts, "s0": seq}
            if p.mode == "sequence" and kept:
                begin = None
            for x in self._advance(begin, stream, row) if begin else []:
                if x is not None:
                    (out if self._complete(x) else kept).append(x)
        if out and p.mode == "sequence":
            kept, out = [], out[:1]
        if out and not p.every and p.mode == "pattern":
            self.done, kept, out = True, [], out[:1]
        if len(kept) > self.limit:
            raise RuntimeError(f"more than {self.limit} open pattern instances of one key; give the pattern a WITHIN")
        self.live = kept
        return [x["got"] for x in out]

    def _complete(self, i: dict) -> bool:
        return i["step"] >= len(self.steps)

    def _advance(self, i: dict, stream: str, row: dict) -> list[dict | None]:
        """The instances that an instance becomes; none if the event doesn't move it."""
        step = self.steps[i["step"]]
        if isinstance(step, A.Logical):
            return self._logical(i, step, stream, row)
        out: list[dict | None] = []
        got = i["got"].get(step.label, [])
        if step.stream == stream and len(got) < step.most and self.fits(step, row, i["got"]):
            held = {**i["got"], step.label: [*got, row]}
            n = len(got) + 1
            if n >= step.least:
                out.append({**i, "step": i["step"] + 1, "got": held})
            if n < step.most:
                out.append({**i, "got": held})
        return out

    def _logical(self, i: dict, step: A.Logical, stream: str, row: dict) -> list[dict | None]:
        for s in (step.a, step.b):
            if s.stream == stream and s.label not in i["got"] and self.fits(s, row, i["got"]):
                got = {**i["got"], s.label: [row]}
                whole = step.op == "or" or step.a.label in got and step.b.label in got
                return [{**i, "step": i["step"] + whole, "got": got}]
        return []


def machine_matches(events: Events, p: A.Pattern, source: Callable[[], Machine], kinds: dict[str, tuple[str, T.StructType]]) -> DataFrame:
    """Matches of any pattern: an array of structs for each label.

    One machine runs over the sorted events of a key. Without keys all events
    are one sequence by the pattern's meaning, in one task; give the query a
    PARTITION to spread it.
    """
    streams = sorted({s.stream for x in p.steps for s in ((x.a, x.b) if isinstance(x, A.Logical) else (x,))})
    keys = events.keys or ["_all"]
    df = events.df if events.keys else events.df.withColumn("_all", F.lit(0))
    df = df.select(*keys, TS, SEQ, "_from", *streams).where(F.col("_from").isin(streams))
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(label, T.ArrayType(k)) for label, (_, k) in kinds.items()), T.StructField(TS, T.LongType()), T.StructField(SEQ, T.LongType())])

    import pandas as pd

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m, rows = source(), []
        for e in pdf.sort_values(SEQ).to_dict("records"):
            for got in m.feed(e["_from"], _plain(e[e["_from"]]), int(e[TS]), int(e[SEQ])):
                rows.append([*key, *([_plain(r) for r in got.get(label, [])] or None for label in kinds), int(e[TS]), int(e[SEQ])])
        return pd.DataFrame(rows, columns=schema.names)

    out = df.groupBy(*keys).applyInPandas(run, schema)
    return out if events.keys else out.drop("_all")


def _plain(row) -> dict:
    return row.asDict() if hasattr(row, "asDict") else dict(row)


def needs_machine(p: A.Pattern, crosses: Callable[[A.Step], bool]) -> bool:
    """Counts, logical steps inside a chain and filters that look at other steps need the machine."""
    if len(p.steps) == 1 and isinstance(p.steps[0], A.Logical):
        return False
    if any(isinstance(s, A.Absent) for s in p.steps):
        if len(p.steps) != 2 or any(isinstance(s, A.Logical) for s in p.steps):
            raise DialectError("NOT … FOR stands before or after one single step")
        return False
    return any(isinstance(s, A.Logical) or s.most > 1 or crosses(s) for s in p.steps)

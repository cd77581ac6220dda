"""Live forms: the operators on streaming DataFrames, with watermarks for event time and keyed state for order."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.lang import ast as A
from tidewright.operators.patterns import Machine


def tumbling(sdf: DataFrame, ts: str, size: str, keys: list[str], aggregates: list[Column], delay: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """Windows of event time, tumbling or hopping, from the epoch on; a window is sent once, when the watermark has passed its end."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = sdf.withWatermark(ts, delay).groupBy(w.alias("_w"), *keys).agg(*aggregates)
    return out.select(F.unix_millis("_w.start").alias("start"), *(c for c in out.columns if c != "_w"))


def sessions(sdf: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column], latency: str = "0 seconds") -> DataFrame:
    """Sessions of each key; ``latency`` is how late an event may be."""
    out = sdf.withWatermark(ts, latency).groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.unix_millis("_w.start").alias("start"), *(c for c in out.columns if c != "_w"))


def interval_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, on: Column, before: str, after: str, how: str = "inner", delay: str = "0 seconds") -> DataFrame:
    """Stream with stream: the right event at most ``before`` earlier or ``after`` later. Outer rows come when the watermark has passed."""
    a, b = left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay)
    near = F.col(right_ts).between(F.col(left_ts) - F.expr(f"INTERVAL {before}"), F.col(left_ts) + F.expr(f"INTERVAL {after}"))
    return a.join(b, on & near, {"left": "leftOuter", "right": "rightOuter", "full": "fullOuter"}.get(how, how))


def lookup(sdf: DataFrame, table: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """A stream with a table as it is when the micro-batch runs."""
    return sdf.join(table, on, how)


def deduplicated(sdf: DataFrame, ts: str, columns: list[str], delay: str) -> DataFrame:
    """One event of each value, forgetting values behind the watermark."""
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark(columns)


def stateful(sdf: DataFrame, keys: list[str], order: list[str], schema: str | T.StructType, step: Callable[[dict, dict], list[dict]]) -> DataFrame:
    """Event at a time by key: ``step(state, row)`` changes the state, a dict of plain values, and returns rows.

    Events of a micro-batch are taken in ``order``; the state of a key is one
    JSON text in the state store, and so is checkpointed and restored with the
    query. Order across micro-batches is that of arrival.
    """
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(order)
        out = [x for r in rows.to_dict("records") for x in step(held, {k: _plain(v) for k, v in r.items()})]
        state.update((json.dumps(held),))
        yield pd.DataFrame([[x.get(n) for n in want.names] for x in out], columns=want.names).astype({f.name: "object" for f in want.fields})

    return sdf.groupBy(*keys).applyInPandasWithState(run, want, "state string", "append", GroupStateTimeout.NoTimeout)


def _plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, pd.Timestamp):
        return v.value // 1_000_000
    return v.item() if hasattr(v, "item") else v


def length(sdf: DataFrame, keys: list[str], order: list[str], n: int, column: str, emit: list[str]) -> DataFrame:
    """A length window of n events per key: for each event its ``emit`` columns with count, sum, avg, min and max of a column over the window."""
    kinds = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, *emit]) + ", n bigint, sum double, avg double, min double, max double"

    def step(state: dict, row: dict) -> list[dict]:
        held = state.setdefault("values", [])
        held.append(row[column])
        del held[:-n]
        v = [x for x in held if x is not None]
        return [{**{c: row[c] for c in [*keys, *emit]}, "n": len(held), "sum": float(sum(v)), "avg": sum(v) / len(v) if v else None, "min": min(v, default=None), "max": max(v, default=None)}]

    return stateful(sdf, keys, order, schema, step)


def length_batch(sdf: DataFrame, keys: list[str], order: list[str], n: int, column: str) -> DataFrame:
    """Batches of n events per key: count, sum, min and max, sent when a batch is full."""
    kinds = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", n bigint, sum double, min double, max double"

    def step(state: dict, row: dict) -> list[dict]:
        held = state.setdefault("values", [])
        held.append(row[column])
        if len(held) < n:
            return []
        state["values"] = []
        v = [x for x in held if x is not None]
        return [{**{c: row[c] for c in keys}, "n": n, "sum": float(sum(v)), "min": min(v, default=None), "max": max(v, default=None)}]

    return stateful(sdf, keys, order, schema, step)


def top(sdf: DataFrame, keys: list[str], order: list[str], n: int, column: str, descending: bool, emit: list[str]) -> DataFrame:
    """A sort window per key: for each event the n first values so far."""
    kinds = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, *emit]) + f", top array<{kinds[column]}>"

    def step(state: dict, row: dict) -> list[dict]:
        held = sorted([*state.get("top", []), row[column]], reverse=descending)[:n] if row[column] is not None else state.get("top", [])
        state["top"] = held
        return [{**{c: row[c] for c in [*keys, *emit]}, "top": held}]

    return stateful(sdf, keys, order, schema, step)


def pattern(sdf: DataFrame, p: A.Pattern, keys: list[str], stream: str, ts: str, order: list[str], fits: Callable[[A.Step, dict, dict], bool], emit: dict[str, tuple[str, str]]) -> DataFrame:
    """Matches of a pattern per key; ``stream`` names the column that tells an event's stream, ``emit`` maps outputs to (step, column) of a step's last event.

    The machine is the replay's; its open instances are the state.
    """
    kinds = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", " + ", ".join(f"{o} {'bigint' if kinds[c].startswith('timestamp') else kinds[c]}" for o, (_, c) in emit.items())

    def step(state: dict, row: dict) -> list[dict]:
        m = Machine(p, fits)
        if "machine" in state:
            m.load(state["machine"])
        state["seq"] = state.get("seq", 0) + 1
        out = m.feed(row[stream], row, row[ts], state["seq"])
        state["machine"] = m.state()
        return [{**{c: row[c] for c in keys}, **{o: got[label][-1][c] if got.get(label) else None for o, (label, c) in emit.items()}} for got in out]

    return stateful(sdf, keys, order, schema, step)


def upsert_sink(path: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a keyed table as files, one folder for each batch; a batch written twice replaces itself. :func:`upserted` reads it."""

    def write(df: DataFrame, batch: int) -> None:
        last = df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")
        last.withColumn("_version", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def upserted(spark, path: str, key: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    user = [c for c in rows.columns if c not in ("_version", "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*user), "_version").alias("_r")).select("_r.*")

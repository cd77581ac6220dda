"""The runner: applications of the dialect, run over bounded DataFrames in a declared order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import types
from tidewright.lang import ast as A
from tidewright.lang.lexer import DialectError
from tidewright.lang.parser import parse
from tidewright.operators import tables as table_ops
from tidewright.operators.order import SEQ, TS, numbered, ordered
from tidewright.operators.rollup import Rollup, durations
from tidewright.operators.triggers import ticks
from tidewright.plans.query import CHOICES, Context, Stream, Table, evaluate
from tidewright.sources.validation import check_options, cycles


class Runner:
    """Streams and tables by name, and the statements that read and write them.

    Choices (see ``CHOICES``) select between the documented meaning, which is
    the default, and variants of it.
    """

    def __init__(self, spark: SparkSession, **choices: str):
        for k, v in choices.items():
            if v not in CHOICES.get(k, ()):
                raise ValueError(f"{k}={v!r} is not one of {CHOICES.get(k, tuple(CHOICES))}")
        self.spark = spark
        self.ctx = Context({}, {}, {k: v[0] for k, v in CHOICES.items()} | choices)
        self.declared: dict[str, A.CreateStream] = {}
        self.rollups: dict[str, Rollup] = {}
        self.callbacks: dict[str, list[Callable[[DataFrame], None]]] = {}
        self._caches: dict[str, int] = {}

    # inputs

    def stream(self, name: str, df: DataFrame, ts: str, tiebreak: tuple[str, ...] | list[str] = ()) -> Runner:
        """Binds a stream's events: in the order of ``ts``, then ``tiebreak``."""
        self.ctx.streams[name] = Stream(ordered(self._typed(name, df), ts, list(tiebreak)))
        return self

    def table(self, name: str, df: DataFrame, key: tuple[str, ...] = ()) -> Runner:
        """Binds a table that does not change while streams run."""
        self.ctx.tables[name] = Table(df, tuple(key))
        return self

    def table_log(self, name: str, log: DataFrame, key: str, ts: str, tiebreak: tuple[str, ...] = (), op: str | None = None) -> Runner:
        """Binds a table by its writes: lookups see it as it was at each event. ``op`` names a column of insert, update, upsert, delete."""
        rows = ordered(log.withColumn(table_ops.OP, F.col(op) if op else F.lit("upsert")), ts, list(tiebreak))
        user = [c for c in log.columns if c != op]
        rows = rows.select(*user, TS, SEQ, table_ops.OP)
        self.ctx.tables[name] = Table(table_ops.folded(rows, [key], [TS, SEQ]).select(*user), (key,), rows)
        return self

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        """Casts declared columns to their declared types; other columns stay, for order."""
        if name not in self.declared:
            return df
        want = types.schema(self.declared[name].columns)
        for f in want.fields:
            if f.name not in df.columns:
                raise DialectError(f"stream {name} has no column {f.name}")
            have = df.schema[f.name].dataType
            if have != f.dataType and not have.simpleString().startswith(("timestamp", "date")):
                df = df.withColumn(f.name, F.col(f.name).try_cast(f.dataType))
        return df

    # functions and callbacks

    def udf(self, name: str, make: Callable, result: str) -> Runner:
        """A scalar function: ``make`` turns columns into a column (a pandas or Arrow UDF, or built-ins)."""
        self.ctx.udfs[name.lower()] = (make, types.spark_type(result) if result.upper() in types._SPARK else result)
        return self

    def window(self, name: str, make: Callable) -> Runner:
        """A window type of one's own: ``make`` turns its constants into a window's Spec."""
        self.ctx.windows[name.lower()] = make
        return self

    def on(self, stream: str, callback: Callable[[DataFrame], None]) -> Runner:
        """Calls back with a stream's rows after a run."""
        self.callbacks.setdefault(stream, []).append(callback)
        return self

    # statements

    def run(self, app: str | list) -> dict[str, DataFrame]:
        """Runs an application, text or syntax trees. Returns the streams and tables that its queries filled, lazily."""
        statements = parse(app) if isinstance(app, str) else list(app)
        queries: list[tuple[A.Select, dict[str, A.Expr]]] = []
        writes: list[A.Write] = []
        for s in statements:
            if isinstance(s, A.CreateStream):
                check_options(s.name, s.options, table=False)
                types.schema(s.columns)
                self.declared[s.name] = s
                if s.name in self.ctx.streams:
                    self.ctx.streams[s.name] = Stream(self._typed(s.name, self.ctx.streams[s.name].df))
            elif isinstance(s, A.CreateTable):
                check_options(s.name, s.options, table=True)
                if s.name not in self.ctx.tables and s.options.get("extension") == "jdbc":
                    self.ctx.tables[s.name] = Table(self._jdbc(s), s.key)
                elif s.name not in self.ctx.tables:
                    self.ctx.tables[s.name] = Table(self.spark.createDataFrame([], types.schema(s.columns)), s.key)
                elif s.key:
                    self.ctx.tables[s.name].key = s.key
                if s.options.get("extension") == "cache":
                    self._caches[s.name] = int(s.options["max_size"])
            elif isinstance(s, A.CreateTrigger):
                self.ctx.streams[s.name] = Stream(ticks(self.spark, s, *self._span()))
            elif isinstance(s, A.CreateAggregation):
                self.rollups[s.name] = self._rollup(s)
            elif isinstance(s, A.Partition):
                keys = dict(s.keys)
                queries += [(q, keys) for q in s.body]
            elif isinstance(s, A.Write):
                writes.append(s)
            elif isinstance(s, A.Select):
                queries.append((s, {}))
            else:
                raise DialectError(f"unknown statement {s!r}")
        if loop := cycles([(q.target, sorted(sources(q))) for q, _ in queries]):
            raise DialectError(f"queries feed each other: {' -> '.join(loop)}")
        out: dict[str, DataFrame] = {}
        waiting = list(queries)
        targets = {q.target for q, _ in waiting}
        while waiting:
            ready = [(q, k) for q, k in waiting if not ((sources(q) & targets) - {t for t in targets if all(x.target != t for x, _ in waiting)})]
            if not ready:
                raise DialectError(f"no query can start: {sorted(q.target for q, _ in waiting)}")
            for q, keys in ready:
                self.ctx.partition = keys
                self._insert(q.target, evaluate(q, self.ctx).df, out)
            self.ctx.partition = {}
            waiting = [x for x in waiting if x not in ready]
        for w in writes:
            self._write(w, out)
        for name, calls in self.callbacks.items():
            for call in calls:
                if name in out:
                    call(out[name])
        return out

    def _insert(self, target: str, df: DataFrame, out: dict[str, DataFrame]) -> None:
        user = [c for c in df.columns if c not in (TS, SEQ)]
        if target in self.ctx.tables:
            t = self.ctx.tables[target]
            rows = df.select(*(F.col(a).try_cast(f.dataType).alias(f.name) for a, f in zip(user, t.df.schema.fields)), TS, SEQ)
            if target in self._caches:
                rows = table_ops.cached(rows, self._caches[target], [TS, SEQ])
            if t.key:
                log = rows.withColumn(table_ops.OP, F.lit("upsert"))
                t.log = log if t.log is None else t.log.unionByName(log)
                t.df = table_ops.folded(t.log, list(t.key), [TS, SEQ]).select(*t.df.columns)
            else:
                t.df = t.df.unionByName(rows.select(*t.df.columns))
            out[target] = t.df
            return
        if target in self.declared:
            want = types.schema(self.declared[target].columns).fields
            if len(want) != len(user):
                raise DialectError(f"{target} has {len(want)} columns, the query {len(user)}")
            df = df.select(*(F.col(a).try_cast(f.dataType).alias(f.name) for a, f in zip(user, want)), TS, SEQ)
        if target in self.ctx.streams and target in out:
            a, b = self.ctx.streams[target].df.withColumn("_src", F.lit(0)), df.withColumn("_src", F.lit(1))
            both = a.unionByName(b).withColumnRenamed(SEQ, "_own")
            df = numbered(both, [TS, "_src", "_own"], F.floor(F.col(TS) / 3_600_000)).drop("_src", "_own")
        self.ctx.streams[target] = Stream(df)
        out[target] = df.drop(TS, SEQ)

    def _write(self, w: A.Write, out: dict[str, DataFrame]) -> None:
        if w.table not in self.ctx.tables:
            raise DialectError(f"unknown table {w.table}")
        t = self.ctx.tables[w.table]
        key = list(w.key or t.key)
        if not key:
            raise DialectError(f"{w.op} of {w.table} needs a key: ON (columns)")
        rows = evaluate(w.select, self.ctx).df
        columns = [c for c in t.df.columns]
        full = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(t.df.schema[c].dataType).alias(c) for c in columns), TS, SEQ)
        first = t.df.select(*columns, F.lit(None).cast("bigint").alias(TS), F.lit(-1).cast("bigint").alias(SEQ), F.lit("insert").alias(table_ops.OP)) if t.log is None else t.log
        if w.op == "update" and not {*columns} <= {*rows.columns}:
            given = [c for c in columns if c in rows.columns]
            other = rows.select(*(F.col(c).alias(f"_n_{c}") for c in given), SEQ)
            last = other.groupBy(*(f"_n_{c}" for c in key)).agg(*(F.max_by(f"_n_{c}", SEQ).alias(f"_n_{c}") for c in given if c not in key))
            last = last.withColumn("_hit", F.lit(True))
            met = t.df.join(last, [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in key], "left")
            t.df = met.select(*(F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in given and c not in key else F.col(c) for c in columns))
        else:
            log = first.unionByName(full.withColumn(table_ops.OP, F.lit(w.op)))
            t.df = table_ops.folded(log, key, [TS, SEQ]).select(*columns)
        out[w.table] = t.df

    def _jdbc(self, s: A.CreateTable) -> DataFrame:
        """A database's table by Spark's reader, which pushes filters and columns down; the driver's jar must be on the class path."""
        o = s.options
        rows = self.spark.read.jdbc(o["url"], o.get("table", s.name), properties={k.removeprefix("jdbc."): v for k, v in o.items() if k.startswith("jdbc.")})
        return rows.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in types.schema(s.columns).fields))

    def _span(self) -> tuple[int, int]:
        """From the first to the last event of the bound streams."""
        low, high = None, None
        for s in self.ctx.streams.values():
            a, b = s.df.agg(F.min(TS), F.max(TS)).first()
            if a is not None:
                low, high = (a if low is None else min(low, a)), (b if high is None else max(high, b))
        return (low or 0, high or 0)

    def _rollup(self, s: A.CreateAggregation) -> Rollup:
        if not isinstance(s.select.source, A.Rel):
            raise DialectError("an aggregation reads one stream")
        df = self.ctx.stream(s.select.source.name).df
        if s.by:
            df = df.withColumn(TS, F.col(s.by).cast("bigint"))
        aggs, keys = {}, [g.name for g in s.select.group_by]
        for x, alias in s.select.items:
            if isinstance(x, A.Call):
                aggs[alias or x.name] = (x.name.lower(), x.args[0].name if x.args and isinstance(x.args[0], A.Col) else None)
            elif not (isinstance(x, A.Col) and x.name in keys):
                raise DialectError("an aggregation selects its keys and aggregates of columns")
        return Rollup(df, keys, aggs, durations(s.durations))

    def query_aggregation(self, name: str, per: str, within: tuple[int, int] | None = None) -> DataFrame:
        return self.rollups[name].query(per, within)


def sources(q: A.Select) -> set[str]:
    def of(s) -> set[str]:
        if isinstance(s, A.Rel):
            return {s.name}
        if isinstance(s, A.Join):
            return of(s.left) | of(s.right)
        return {x.stream for e in s.steps for x in ((e.a, e.b) if isinstance(e, A.Logical) else (e,))}

    return of(q.source)

"""Plans of SELECT statements in replay: source, filter, window, selector, emission."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright import expr
from tidewright.functions import aggregates
from tidewright.functions.scalars import Typed
from tidewright.lang import ast as A
from tidewright.lang.lexer import DialectError
from tidewright.operators import joins, patterns, ratelimit, windows
from tidewright.operators.order import SEQ, TS, merged
from tidewright.types import of_spark

#: The runner's choices, each with its default first.
CHOICES = {
    "where": ("before_window", "after_window"),
    "null_mode": ("sql", "two_valued"),
    "output_events": ("current", "expired", "all"),
    "outer": ("eager", "final"),
    "emit": ("event", "batch"),
    "align": ("first", "epoch"),
}


@dataclass
class Stream:
    """A named stream: user columns with ``_ts`` and ``_seq``."""

    df: DataFrame

    @property
    def kinds(self) -> dict[str, str]:
        return {f.name: of_spark(f.dataType) for f in self.df.schema.fields if f.name not in (TS, SEQ)}


@dataclass
class Table:
    """A named table: its rows, or a log of writes with ``_ts`` and ``_seq`` that lookups read as of each event."""

    df: DataFrame
    key: tuple[str, ...] = ()
    log: DataFrame | None = None

    @property
    def kinds(self) -> dict[str, str]:
        return {f.name: of_spark(f.dataType) for f in self.df.schema.fields if f.name not in (TS, SEQ)}


@dataclass
class Context:
    streams: dict[str, Stream]
    tables: dict[str, Table]
    choices: dict[str, str]
    udfs: dict = field(default_factory=dict)
    windows: dict = field(default_factory=dict)
    partition: dict[str, A.Expr] = field(default_factory=dict)

    def stream(self, name: str) -> Stream:
        if name not in self.streams:
            raise DialectError(f"unknown stream {name}" if name not in self.tables else f"table {name} cannot be read alone; join it with a stream")
        return self.streams[name]


def evaluate(q: A.Select, ctx: Context) -> Stream:
    """The query's result: its columns with ``_ts`` and ``_seq`` of the events that made each row."""
    return _Select(q, ctx).result()


def window_spec(w: A.WindowSpec, ctx: Context) -> windows.Spec:
    """The window's parameters, which must be constants or columns."""
    kind, args = w.type, list(w.args)
    if kind in ctx.windows:
        return ctx.windows[kind](*[a.value if isinstance(a, A.Lit) else a.name for a in args])

    def number(k: int, what: str) -> int:
        if k >= len(args) or not isinstance(args[k], A.Lit) or not isinstance(args[k].value, int):
            raise DialectError(f"{kind} takes a constant {what}")
        return args[k].value

    def column(k: int) -> str:
        if k >= len(args) or not isinstance(args[k], A.Col):
            raise DialectError(f"{kind} takes a column")
        return args[k].name

    align = ctx.choices["align"]
    if kind in ("length", "lengthbatch"):
        n = number(0, "count")
        if n < 1:
            raise DialectError(f"{kind} takes a positive count")
        return windows.Spec(kind, n=n)
    if kind in ("time", "timebatch", "tumbling", "delay"):
        return windows.Spec(kind, ms=number(0, "time"), align=align)
    if kind in ("externaltime", "externaltimebatch"):
        return windows.Spec(kind, ms=number(1, "time"), column=column(0), align=align)
    if kind in ("sliding", "hopping", "hop"):
        return windows.Spec("hopping", ms=number(0, "size"), slide=number(1, "slide"))
    if kind == "session":
        key = next((a.name for a in args[1:] if isinstance(a, A.Col)), None)
        return windows.Spec("session", ms=number(0, "gap"), column=key)
    if kind == "cron":
        return windows.Spec("cron", cron=str(args[0].value))
    if kind == "sort":
        order: list[tuple[str, bool]] = []
        for a in args[1:]:
            if isinstance(a, A.Col):
                order.append((a.name, False))
            elif isinstance(a, A.Lit) and str(a.value).lower() in ("asc", "desc") and order:
                order[-1] = (order[-1][0], str(a.value).lower() == "desc")
            else:
                raise DialectError("sort takes columns, each with 'asc' or 'desc'")
        return windows.Spec("sort", n=number(0, "count"), sort=tuple(order))
    if kind == "lossycounting":
        return windows.Spec("running")
    raise DialectError(f"unknown window {kind}")


class _Select:
    def __init__(self, q: A.Select, ctx: Context):
        self.q, self.ctx, self.choices = q, ctx, ctx.choices
        self.keys: list[str] = []
        self.chains: dict[str, tuple[Column, dict[str, str]]] = {}
        self.frames: list[tuple[str, dict[str, str], object]] = []
        self.window: windows.Spec | None = None

    # sources

    def result(self) -> Stream:
        q = self.q
        if isinstance(q.source, A.Rel):
            df = self.relation(q.source)
        elif isinstance(q.source, A.Join):
            df = self.join(q.source)
        else:
            df = self.pattern(q.source)
        w = q.window or (q.source.window if isinstance(q.source, A.Rel) else None)
        spec = window_spec(w, self.ctx) if w else None
        after = self.choices["where"] == "after_window" and spec is not None
        if q.where is not None and not after:
            df = self.filter(df, q.where)
        return Stream(self.select(df, spec, q.where if after else None))

    def scope(self, **more) -> expr.Scope:
        return expr.scope_of(self.frames, chains=self.chains, udfs=self.ctx.udfs, null_mode=self.choices["null_mode"], **more)

    def relation(self, r: A.Rel) -> DataFrame:
        s = self.ctx.stream(r.name)
        self.frames = [(r.label, s.kinds, F.col)]
        df = s.df
        if r.name in self.ctx.partition:
            df = df.withColumn("_key", expr.compile(self.ctx.partition[r.name], self.scope()).col)
            self.keys = ["_key"]
        return df

    def filter(self, df: DataFrame, where: A.Expr) -> DataFrame:
        """WHERE, with ``x IN table`` of a conjunction as semi joins."""
        for part in _conjuncts(where):
            negated = isinstance(part, A.Unary) and part.op == "not" and isinstance(part.x, A.InTable)
            inside = part.x if negated else part
            if isinstance(inside, A.InTable):
                t = self.ctx.tables.get(inside.table)
                if t is None or len(t.kinds) != 1:
                    raise DialectError(f"IN takes a table of one column, not {inside.table}")
                value = expr.compile(inside.x, self.scope()).col
                df = joins.member(df, t.df, lambda _, v=value: v, next(iter(t.kinds)), negated)
                continue
            c = expr.compile(part, self.scope())
            if c.type not in ("boolean", "null"):
                raise DialectError(f"WHERE takes a condition, not {c.type}")
            df = df.where(c.col)
        return df

    def join(self, j: A.Join | A.Rel) -> DataFrame:
        if isinstance(j, A.Rel):
            s = self.ctx.stream(j.name)
            kinds, label = s.kinds, j.label
            self.frames.append((label, kinds, lambda n, label=label: F.col(f"{label}__{n}")))
            df = s.df.select(*(F.col(n).alias(f"{label}__{n}") for n in kinds), TS, SEQ)
            if j.name in self.ctx.partition:
                key = expr.compile(self.ctx.partition[j.name], expr.scope_of([self.frames[-1]])).col
                df = df.withColumn(f"_key_{label}", key)
            return df
        if isinstance(j.left, A.Rel) and j.left.name in self.ctx.tables:
            flip = {"left": "right", "right": "left"}.get(j.how, j.how)
            if not isinstance(j.right, A.Rel) or j.right.name in self.ctx.tables:
                raise DialectError("a join needs a stream")
            j = A.Join(j.right, j.left, flip, j.on, j.unidirectional)
        left = self.join(j.left)
        left_keys = [c for c in left.columns if c.startswith("_key")]
        r = j.right
        if r.name in self.ctx.tables:
            return self.lookup(left, r, j)
        right = self.join(r)
        on = expr.compile(j.on, self.scope()).col if j.on is not None else None
        right_key = f"_key_{r.label}"
        if left_keys and right_key in right.columns:
            same = F.col(left_keys[0]) == F.col(right_key)
            on = same if on is None else on & same
            self.keys = ["_key"]
        sides = []
        for df, prefix, rel in ((left, "_l", j.left), (right, "_r", r)):
            w = rel.window if isinstance(rel, A.Rel) else None
            sides.append(joins.Side(df.withColumnRenamed(TS, f"{prefix}_ts").withColumnRenamed(SEQ, f"{prefix}_seq"), f"{prefix}_ts", f"{prefix}_seq", window_spec(w, self.ctx) if w else None))
        out = joins.stream_join(*sides, on, j.how, self.choices["outer"], j.unidirectional)
        if self.keys:
            out = out.withColumn("_key", F.coalesce(left_keys[0], right_key)).drop(right_key, *(k for k in left_keys if k != "_key"))
        # Several pairs may end with one event: their own numbers tell them apart.
        out = out.withColumn("_other", F.coalesce(F.least("_l_seq", "_r_seq"), F.lit(-1)))
        from tidewright.operators.order import RUN, numbered

        out = out.withColumnRenamed(SEQ, "_was").drop("_l_ts", "_r_ts", "_l_seq", "_r_seq")
        return numbered(out, ["_was", "_other"], F.floor(F.col("_was") / RUN), few=True).drop("_was", "_other")

    def lookup(self, left: DataFrame, r: A.Rel, j: A.Join) -> DataFrame:
        t, label = self.ctx.tables[r.name], r.label
        if j.how not in ("inner", "left"):
            raise DialectError("a stream looks tables up by INNER or LEFT joins")
        self.frames.append((label, t.kinds, lambda n, label=label: F.col(f"{label}__{n}")))
        on = expr.compile(j.on, self.scope()).col
        if t.log is None:
            side = t.df.select(*(F.col(n).alias(f"{label}__{n}") for n in t.kinds))
            out = joins.lookup(left, side, on, j.how)
        else:
            out = self.as_of(left, t, label, j)
        if t.key and len(t.key) == 1:
            return out
        from tidewright.operators.order import RUN, numbered

        out = out.withColumnRenamed(SEQ, "_was")
        rest = [c for c in out.columns if c.startswith(f"{label}__")]
        return numbered(out, ["_was", *rest], F.floor(F.col("_was") / RUN), few=True).drop("_was")

    def as_of(self, left: DataFrame, t: Table, label: str, j: A.Join) -> DataFrame:
        """ON must be key = column; the row is the one that the key had when the event came."""
        x = j.on
        if not (isinstance(x, A.Binary) and x.op == "=" and isinstance(x.a, A.Col) and isinstance(x.b, A.Col) and len(t.key) == 1):
            raise DialectError("a changing table is looked up by its key: ON stream.column = table.key")
        a, b = (x.a, x.b) if x.b.of == label or x.b.name == t.key[0] and x.a.of != label else (x.b, x.a)
        probe = left.withColumn("_probe", self.scope().find(a).col)
        log = t.log.select(*(F.col(n).alias(f"{label}__{n}") for n in t.kinds), TS, SEQ, (F.col("_op") == "delete").alias("_deleted"))
        if b.name != t.key[0]:
            raise DialectError(f"{b.name} is not the key of the table")
        return joins.as_of(probe, log, "_probe", f"{label}__{b.name}", [f"{label}__{n}" for n in t.kinds], deleted="_deleted", how=j.how).drop("_probe")

    def pattern(self, p: A.Pattern) -> DataFrame:
        flat = [s for x in p.steps for s in ((x.a, x.b) if isinstance(x, A.Logical) else (x,))]
        names = sorted({s.stream for s in flat})
        sources, keys = {}, []
        for n in names:
            s = self.ctx.stream(n)
            df = s.df
            if n in self.ctx.partition:
                keys = ["_key"]
            sources[n] = df
        events = merged(sources)
        if keys:
            key = F.lit(None)
            for n in names:
                if n in self.ctx.partition:
                    k = expr.compile(self.ctx.partition[n], expr.scope_of([(n, self.ctx.stream(n).kinds, lambda c, n=n: F.col(f"`{n}`.`{c}`"))])).col
                    key = F.when(F.col("_from") == n, k).otherwise(key)
            events = events.withColumn("_key", key)
        self.keys = keys
        labels = {s.label for s in flat if isinstance(s, A.Step)}

        def own(s: A.Step) -> expr.Scope:
            kinds = self.ctx.stream(s.stream).kinds
            col = lambda c: F.col(f"`{s.stream}`.`{c}`")
            sc = expr.scope_of([(s.label, kinds, col), (s.stream, kinds, col)] if s.label != s.stream else [(s.label, kinds, col)])
            for n, t in kinds.items():
                sc.columns[None, n] = Typed(col(n), t)
            sc.null_mode = self.choices["null_mode"]
            return sc

        def crosses(s: A.Step) -> bool:
            return s.where is not None and any(c.of in labels - {s.label, s.stream} for c in _columns(s.where))

        def test(s: A.Step | A.Absent) -> Column | None:
            if s.where is None:
                return None
            step = s if isinstance(s, A.Step) else A.Step(s.stream, s.alias, s.where)
            return expr.compile(step.where, own(step)).col

        ev = patterns.Events(events, keys)
        only = p.steps[0] if len(p.steps) == 1 else None
        if isinstance(only, A.Logical):
            out = patterns.both(ev, only, test) if only.op == "and" else patterns.either(ev, only, test)
            flat_now = [only.a, only.b]
        elif patterns.needs_machine(p, crosses):
            return self.machine(p, ev, flat, crosses, test)
        elif any(isinstance(s, A.Absent) for s in p.steps):
            a, b = p.steps
            out = patterns.absent_after(ev, a, b, test) if isinstance(b, A.Absent) else patterns.absent_before(ev, a, b, test)
            flat_now = [s for s in p.steps if isinstance(s, A.Step)]
        else:
            out = patterns.chain(ev, p, test)
            flat_now = flat
        self.frames = []
        for s in flat_now:
            kinds = self.ctx.stream(s.stream).kinds
            self.name_step(s, kinds, flat_now)
            self.chains[s.label] = (F.when(F.col(s.label).isNotNull(), F.array(F.col(s.label))), kinds)
        self.chains = {k: v for k, v in self.chains.items() if k in _indexed(self.q)}
        return out.withColumn(SEQ, F.col(SEQ))

    def name_step(self, s: A.Step, kinds: dict[str, str], flat: list[A.Step], chained: bool = False) -> None:
        """A step's columns by its label and, if only one step reads the stream, by the stream's name."""
        col = (lambda n, l=s.label: F.try_element_at(F.col(l), F.lit(-1))[n]) if chained else (lambda n, l=s.label: F.col(f"`{l}`.`{n}`"))
        self.frames.append((s.label, kinds, col))
        if s.label != s.stream and sum(x.stream == s.stream for x in flat) == 1:
            self.frames.append((s.stream, kinds, col))

    def machine(self, p: A.Pattern, ev: patterns.Events, flat: list[A.Step], crosses, test) -> DataFrame:
        """Filters on one event alone are columns of the events; those that look at other steps run in the machine."""
        plain = {s.label: test(s) for s in flat if s.where is not None and not crosses(s)}
        df = ev.df
        for s in flat:
            if s.label in plain:
                flag = f"_fit_{s.label}"
                df = df.withColumn(s.stream, F.when(F.col(s.stream).isNotNull(), F.col(s.stream).withField(flag, F.coalesce(plain[s.label], F.lit(False)))))
        cross = {s.label: s.where for s in flat if s.where is not None and crosses(s)}
        kinds = {s.label: (s.stream, df.schema[s.stream].dataType) for s in flat}
        tests = {label: _PyTest(where, label) for label, where in cross.items()}
        flags = set(plain)

        def fits(s: A.Step, row: dict, got: dict) -> bool:
            if s.label in flags and not row.get(f"_fit_{s.label}"):
                return False
            return s.label not in tests or tests[s.label](row, got)

        out = patterns.machine_matches(patterns.Events(df, ev.keys), p, lambda: patterns.Machine(p, fits), kinds)
        self.frames = []
        for s in flat:
            user = self.ctx.stream(s.stream).kinds
            self.name_step(s, user, flat, chained=True)
            self.chains[s.label] = (F.col(s.label), user)
        return out

    # the selector

    def items(self) -> list[tuple[str, A.Expr]]:
        out: list[tuple[str, A.Expr]] = []
        for x, alias in self.q.items:
            if isinstance(x, A.Star):
                if isinstance(self.q.source, A.Pattern):
                    raise DialectError("SELECT * cannot stand over a pattern")
                for label, kinds, _ in self.frames:
                    if x.of in (None, label):
                        out += [(n, A.Col(n, label)) for n in kinds]
            else:
                out.append((alias or (x.name if isinstance(x, A.Col) else f"_col_{len(out)}"), x))
        if twice := {n for n, _ in out if [m for m, _ in out].count(n) > 1}:
            raise DialectError(f"columns of one name need aliases: {sorted(twice)}")
        return out

    def select(self, df: DataFrame, spec: windows.Spec | None, late: A.Expr | None) -> DataFrame:
        q = self.q
        if spec is not None and spec.type == "delay":
            df, spec = windows.delayed(df, spec.ms), None
        if spec is not None and spec.type == "sort":
            df, spec = windows.sort_window(df, spec.n, list(spec.sort), self.keys), None
        if spec is not None and spec.type == "session" and spec.column:
            df = df.withColumn("_session", F.col(spec.column))
            self.keys = [*self.keys, "_session"]
        aggregated = bool(q.group_by) or q.having is not None or any(expr.has_aggregate(x) for x, _ in q.items)
        if self.chains:
            aggregated = bool(q.group_by) or any(self.truly_aggregates(x) for x, _ in q.items)
        batched = spec is not None and spec.type in windows.BATCHES
        if batched:
            df, ids = windows.batches(df, spec, self.keys)
        else:
            ids = list(self.keys)
        if late is not None and (batched or not aggregated):
            df = self.filter(df, late)
            late = None
        groups = [g for g in q.group_by]
        if not aggregated:
            out = self.plain(df, spec)
            chunk = ids if batched else []
        elif batched or self.choices["emit"] == "batch":
            out = self.grouped(df, ids, groups)
            chunk = [i for i in ids if i in out.columns]
        else:
            out = self.framed(df, spec or windows.Spec("running"), groups, late)
            chunk = []
        names = [n for n, _ in self.items()]
        out = self.arranged(out, chunk, names)
        if q.distinct:
            out = out.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy(SEQ))).where("_r = 1").drop("_r")
        if q.rate is not None:
            out = ratelimit.limited(out, q.rate, [n for n, x in self.items() if x in q.group_by])
        return out.select(*names, TS, SEQ)

    def truly_aggregates(self, x: A.Expr) -> bool:
        """Whether an expression aggregates over rows, not over a step's chain."""
        if isinstance(x, A.Call) and aggregates.find(x.name):
            return not (len(x.args) == 1 and isinstance(x.args[0], A.Col) and (x.args[0].of in self.chains or x.args[0].of is None and x.args[0].name in self.chains))
        return any(self.truly_aggregates(v) for v in _children(x))

    def plain(self, df: DataFrame, spec: windows.Spec | None) -> DataFrame:
        s = self.scope()
        mode = self.choices["output_events"]
        if mode != "current" and spec is not None and spec.type in ("length", "time", "externaltime"):
            gone = windows.expired(df, spec, self.keys)
            df = gone if mode == "expired" else df.unionByName(gone)
        ids = [c for c in df.columns if c in ("_batch", *self.keys)]
        return df.select(*(expr.compile(x, s).col.alias(n) for n, x in self.items()), *(c.alias(f"_o{k}") for k, c in enumerate(self.order(s))), *(F.col(c) for c in ids), TS, SEQ)

    def order(self, s: expr.Scope) -> list[Column]:
        aliases = dict(self.items())
        out = []
        for o in self.q.order_by:
            x = aliases[o.x.name] if isinstance(o.x, A.Col) and o.x.of is None and o.x.name in aliases and (None, o.x.name) not in s.columns else o.x
            out.append(expr.compile(x, s).col)
        return out

    def grouped(self, df: DataFrame, ids: list[str], groups: list[A.Expr]) -> DataFrame:
        """One row for each group of each batch: the last values of plain columns, and the batch's aggregates."""
        inner = self.scope()
        keys = [expr.compile(g, inner).col.alias(f"_g{k}") for k, g in enumerate(groups)]
        made: list[Column] = []

        def aggregate(name: str, a: aggregates.Aggregate, x: Typed | None) -> Column:
            label = f"_a{len(made)}"
            col = x.col if x is not None else F.lit(1)
            c = F.min_by(col, SEQ) if name == "first" else F.max_by(col, SEQ) if name == "last" else a.grouped(col)
            made.append(c.alias(label))
            return a.finish(F.col(label))

        columns: dict = {}
        last: dict = {}
        for key, t in inner.columns.items():
            if t is None:
                columns[key] = None
                continue
            g = next((k for k, x in enumerate(groups) if inner.find(x) is t), None)
            if g is not None:
                columns[key] = Typed(F.col(f"_g{g}"), t.type)
            else:
                label = last.setdefault(id(t), f"_l{len(last)}")
                columns[key] = Typed(F.col(label), t.type)
        outer = _Grouping(columns, self.chains, aggregate, self.ctx.udfs, None, self.choices["null_mode"])
        outer.inner = inner
        items = [(n, expr.compile(x, outer).col) for n, x in self.items()]
        having = expr.compile(self.q.having, outer).col if self.q.having is not None else None
        order = self.order(outer)
        by_id = {id(t): t for t in inner.columns.values() if t is not None}
        lasts = [F.max_by(by_id[i].col, SEQ).alias(label) for i, label in last.items() if label in outer.used]
        out = df.groupBy(*ids, *keys).agg(F.max(TS).alias(TS), F.max(SEQ).alias(SEQ), *made, *lasts)
        if having is not None:
            out = out.where(having)
        return out.select(*(c.alias(n) for n, c in items), *(c.alias(f"_o{k}") for k, c in enumerate(order)), *ids, TS, SEQ)

    def framed(self, df: DataFrame, spec: windows.Spec, groups: list[A.Expr], late: A.Expr | None) -> DataFrame:
        """One row for each event: aggregates over the window as it stands when the event has come."""
        inner = self.scope()
        for k, g in enumerate(groups):
            df = df.withColumn(f"_g{k}", expr.compile(g, inner).col)
        used = _aggregate_names((*(x for _, x in self.items()), self.q.having, *(o.x for o in self.q.order_by)))
        f = windows.frame(df, spec, self.keys, spec.type in ("time", "externaltime") and used <= {*aggregates.PARTS, "last"})
        rows = f.df
        if late is not None:
            rows = rows.where(expr.compile(late, inner).col)
        by = [f"_g{k}" for k in range(len(groups))]
        over, forever = f.over(by), f.forever(by)
        # Without keys and groups all events so far are one frame: each chunk is aggregated by itself, on top of the chunks before it.
        spread = f.low is None and not self.keys and not groups
        totals: list[tuple[Column, Column]] = []
        if spread:
            rows = rows.withColumn("_chunk", F.floor(F.col(SEQ) / windows.CHUNK))
            within = Window.partitionBy("_chunk").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)

        def so_far(name: str, col: Column) -> Column:
            parts = []
            for part in aggregates.PARTS[name]:
                total, merge = aggregates.MERGES[part]
                made = aggregates.AGGREGATES[part].grouped(col.cast("double") if name == "avg" else col)
                label = f"_p{len(totals)}"
                totals.append((made.alias(label), total(label).over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias(label)))
                parts.append(merge(F.col(label), made.over(within)))
            return F.try_divide(*parts) if name == "avg" else parts[0]

        def in_halves(name: str, col: Column) -> Column:
            parts = []
            for part in aggregates.PARTS[name]:
                made = [aggregates.AGGREGATES[part].grouped(F.when(counted, col.cast("double") if name == "avg" else col)).over(w) for counted, w in f.halves(by)]
                parts.append(aggregates.MERGES[part][1](*made))
            return F.try_divide(*parts) if name == "avg" else parts[0]

        def aggregate(name: str, a: aggregates.Aggregate, x: Typed | None) -> Column:
            w = forever if a.forever else over
            col = x.col if x is not None else F.lit(1)
            if name == "first":
                return F.first(col).over(w)
            if name == "last":
                return col
            if spread and name in aggregates.PARTS:
                return a.finish(so_far(name, col))
            if f.halved and not a.forever:
                return a.finish(in_halves(name, col))
            return a.framed(col, w) if a.framed else a.finish(a.grouped(col).over(w))

        s = self.scope(aggregate=aggregate)
        cols = [expr.compile(x, s).col.alias(n) for n, x in self.items()]
        having = [expr.compile(self.q.having, s).col.alias("_having")] if self.q.having is not None else []
        order = [c.alias(f"_o{k}") for k, c in enumerate(self.order(s))]
        if totals:
            before = rows.groupBy("_chunk").agg(*(t for t, _ in totals)).select("_chunk", *(p for _, p in totals))
            rows = rows.join(before, "_chunk")
        out = rows.select(*cols, *having, *order, f.own.alias("_own"), *(c for c in self.keys), TS, SEQ).where("_own").drop("_own")
        return out.where("_having").drop("_having") if having else out

    def arranged(self, out: DataFrame, chunk: list[str], names: list[str]) -> DataFrame:
        """ORDER BY, LIMIT and OFFSET within each chunk: a batch, or the whole replay."""
        q = self.q
        by = [(F.desc_nulls_first if o.descending else F.asc_nulls_last)(f"_o{k}") for k, o in enumerate(q.order_by)]
        if q.limit is None and q.offset is None:
            if by and not chunk:
                out = out.orderBy(*by, SEQ)
            return out
        low, high = q.offset or 0, (q.offset or 0) + q.limit if q.limit is not None else None
        if not chunk:
            out = out.orderBy(*by, SEQ).offset(low) if low else out.orderBy(*by, SEQ)
            return out.limit(q.limit) if q.limit is not None else out
        r = F.row_number().over(Window.partitionBy(*chunk).orderBy(*by, SEQ))
        out = out.withColumn("_r", r).where(F.col("_r") > low)
        return (out.where(F.col("_r") <= high) if high is not None else out).drop("_r")


class _Grouping(expr.Scope):
    """The scope above a GROUP BY: aggregate arguments are compiled below it, and what it takes as last values is noted."""

    def __init__(self, *a):
        super().__init__(*a)
        self.used: set[str] = set()

    def find(self, c: A.Col) -> Typed:
        t = super().find(c)
        for key in ((c.of, c.name), (None, c.name)):
            if self.columns.get(key) is t:
                i = self.inner.columns.get(key)
                if i is not None:
                    self.used.add(_name(t.col))
        return t


def _name(c: Column) -> str:
    return str(c._jc.toString()) if hasattr(c, "_jc") else str(c)


def _conjuncts(x: A.Expr) -> list[A.Expr]:
    return [*_conjuncts(x.a), *_conjuncts(x.b)] if isinstance(x, A.Binary) and x.op == "and" else [x]


def _children(x: object) -> list:
    if isinstance(x, tuple):
        return list(x)
    return list(vars(x).values()) if isinstance(x, A.Expr) else []


def _aggregate_names(x: object) -> set[str]:
    """The names of all aggregates in an expression."""
    found = aggregates.find(x.name, x.distinct) if isinstance(x, A.Call) else None
    return {n for v in _children(x) for n in _aggregate_names(v)} | ({found[0]} if found else set())


def _columns(x: object) -> list[A.Col]:
    return [x] if isinstance(x, A.Col) else [c for v in _children(x) for c in _columns(v)]


def _indexed(q: A.Select) -> set[str]:
    """Steps that the query indexes or aggregates."""
    out = set()
    for x in [*(i for i, _ in q.items), q.where, q.having, *q.group_by, *(o.x for o in q.order_by)]:
        out |= {c.of for c in _columns(x) if c.index is not None}
        out |= _aggregated(x)
    return out


def _aggregated(x: object) -> set[str]:
    if isinstance(x, A.Call) and (aggregates.find(x.name) or x.name.lower() in ("event", "allevents")):
        return {c.of or c.name for c in _columns(x.args)}
    return {n for v in _children(x) for n in _aggregated(v)}


class _PyTest:
    """A filter that looks at other steps, on plain values: arithmetic, comparisons and logic with SQL's nulls."""

    def __init__(self, where: A.Expr, label: str):
        self.where, self.label = where, label

    def __call__(self, row: dict, got: dict) -> bool:
        return self.value(self.where, row, got) is True

    def value(self, x: A.Expr, row: dict, got: dict):
        v = lambda y: self.value(y, row, got)
        if isinstance(x, A.Lit):
            return x.value
        if isinstance(x, A.Col):
            if x.of is None or x.of == self.label:
                return _clean(row.get(x.name))
            events = got.get(x.of) or []
            index = -1 if x.index is None else x.index
            return _clean(events[index].get(x.name)) if -len(events) <= index < len(events) else None
        if isinstance(x, A.Unary):
            a = v(x.x)
            return None if a is None else (not a) if x.op == "not" else -a
        if isinstance(x, A.IsNull):
            return (v(x.x) is None) != x.negated
        if isinstance(x, A.InList):
            a = v(x.x)
            return None if a is None else (a in [v(i) for i in x.items]) != x.negated
        if isinstance(x, A.Binary):
            a, b = v(x.a), v(x.b)
            if x.op == "and":
                return False if a is False or b is False else None if a is None or b is None else True
            if x.op == "or":
                return True if a is True or b is True else None if a is None or b is None else False
            if a is None or b is None:
                return None
            if x.op in ("/", "%") and b == 0:
                return None
            import math
            import operator as o

            return {"+": o.add, "-": o.sub, "*": o.mul, "/": o.truediv, "%": math.fmod, "=": o.eq, "!=": o.ne, "<": o.lt, "<=": o.le, ">": o.gt, ">=": o.ge}[x.op](a, b)
        raise DialectError(f"a filter over other steps cannot have {type(x).__name__}")


def _clean(v):
    return None if isinstance(v, float) and v != v else v

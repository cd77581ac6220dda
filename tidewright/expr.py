"""Expressions of the dialect as Spark columns, with the dialect's types and null rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions import aggregates
from tidewright.functions.scalars import ALIASES, SCALARS, Typed
from tidewright.lang import ast as A
from tidewright.lang.lexer import DialectError
from tidewright.types import RANK, spark_type, widest

NULL_MODES = ("sql", "two_valued")


@dataclass
class Scope:
    """What names mean: ``columns`` maps (qualifier or None, name) to a typed column; None marks an ambiguous name.

    ``chains`` maps a pattern step to its array of events. ``aggregate`` makes
    a column for an aggregate call; without it aggregates are errors.
    """

    columns: dict[tuple[str | None, str], Typed | None]
    chains: dict[str, tuple[Column, dict[str, str]]] = field(default_factory=dict)
    aggregate: Callable[[str, aggregates.Aggregate, Typed | None], Column] | None = None
    udfs: dict = field(default_factory=dict)
    tables: Callable[[str], object] | None = None
    null_mode: str = "sql"
    inner: Scope | None = None  # of aggregate arguments, where that is another

    def find(self, c: A.Col) -> Typed:
        if c.index is not None or c.of in self.chains:
            return self.from_chain(c)
        for key in ((c.of, c.name), (c.of and c.of.lower(), c.name.lower())):
            if key in self.columns:
                got = self.columns[key]
                if got is None:
                    raise DialectError(f"{c.name} is ambiguous")
                return got
        raise DialectError(f"unknown column {c.of + '.' if c.of else ''}{c.name}")

    def from_chain(self, c: A.Col) -> Typed:
        if c.of not in self.chains:
            raise DialectError(f"{c.of} has no events to index")
        events, kinds = self.chains[c.of]
        if c.name not in kinds:
            raise DialectError(f"unknown column {c.of}.{c.name}")
        index = -1 if c.index is None else c.index
        return Typed(F.try_element_at(events, F.lit(index + 1 if index >= 0 else index))[c.name], kinds[c.name])


def scope_of(frames: list[tuple[str, dict[str, str], Callable[[str], Column]]], **more) -> Scope:
    """For relations (label, column types, column by name): qualified names, and plain ones where they are unique."""
    columns: dict[tuple[str | None, str], Typed | None] = {}
    for label, kinds, col in frames:
        for n, t in kinds.items():
            typed = Typed(col(n), t)
            columns[label, n] = typed
            columns[None, n] = None if (None, n) in columns else typed
    return Scope(columns, **more)


def compile(x: A.Expr, s: Scope) -> Typed:
    """The typed column of an expression."""
    return _MAKERS[type(x)](x, s)


def has_aggregate(x: object) -> bool:
    if isinstance(x, A.Call) and aggregates.find(x.name):
        return True
    if isinstance(x, tuple):
        return any(map(has_aggregate, x))
    return isinstance(x, A.Expr) and any(map(has_aggregate, vars(x).values()))


def _lit(x: A.Lit, s: Scope) -> Typed:
    kind = {"int": "int", "long": "bigint", "interval": "bigint", "double": "double", "string": "string", "bool": "boolean", "null": "null"}[x.kind]
    return Typed(F.lit(x.value) if kind == "null" else F.lit(x.value).cast(kind), kind, x.value)


def _unary(x: A.Unary, s: Scope) -> Typed:
    a = compile(x.x, s)
    if x.op == "not":
        if a.type not in ("boolean", "null"):
            raise DialectError(f"NOT takes a condition, not {a.type}")
        return Typed(~a.col, "boolean")
    kind = widest("bigint", a.type)  # minus is 0L - x
    constant = -a.constant if isinstance(a.constant, int | float) else None
    return Typed(F.try_subtract(F.lit(0).cast(kind), a.col.cast(kind)), kind, constant)


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    kind = widest(a.type, b.type)
    if op == "/":
        widest(kind, "double")
        return Typed(F.try_divide(a.col.cast("double"), b.col.cast("double")), "double")
    make = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[op]
    return Typed(make(a.col.cast(kind), b.col.cast(kind)), kind)


def comparison(op: str, a: Typed, b: Typed, null_mode: str) -> Typed:
    kinds = {a.type, b.type} - {"null"}
    if "binary" in kinds or len(kinds) > 1 and not kinds <= RANK.keys():
        raise DialectError(f"cannot compare {a.type} with {b.type}")
    if kinds == {"boolean"} and op not in ("=", "!="):
        raise DialectError(f"conditions compare by = and != only, not {op}")
    col = {"=": a.col == b.col, "!=": a.col != b.col, "<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op]
    return Typed(F.coalesce(col, F.lit(op == "!=")) if null_mode == "two_valued" else col, "boolean")


def _binary(x: A.Binary, s: Scope) -> Typed:
    a, b = compile(x.a, s), compile(x.b, s)
    if x.op in ("and", "or"):
        for t in (a, b):
            if t.type not in ("boolean", "null"):
                raise DialectError(f"{x.op.upper()} takes conditions, not {t.type}")
        ca, cb = a.col.cast("boolean"), b.col.cast("boolean")
        if s.null_mode == "two_valued":
            ca, cb = F.coalesce(ca, F.lit(False)), F.coalesce(cb, F.lit(False))
        return Typed(ca & cb if x.op == "and" else ca | cb, "boolean")
    return arithmetic(x.op, a, b) if x.op in "+-*/%" else comparison(x.op, a, b, s.null_mode)


def _call(x: A.Call, s: Scope) -> Typed:
    found = aggregates.find(x.name, x.distinct)
    if found and s.chains and len(x.args) == 1 and isinstance(x.args[0], A.Col) and (x.args[0].of in s.chains or x.args[0].of is None and x.args[0].name in s.chains):
        return _chain_aggregate(*found, x.args[0], s)
    if found:
        if s.aggregate is None:
            raise DialectError(f"{x.name} cannot stand here")
        if x.star or not x.args:
            if found[0] != "count":
                raise DialectError(f"{x.name} takes one argument")
            return Typed(s.aggregate("count", found[1], None), "bigint")
        if len(x.args) != 1:
            raise DialectError(f"{x.name} takes one argument")
        a = compile(x.args[0], s.inner or Scope(s.columns, s.chains, None, s.udfs, s.tables, s.null_mode))
        kind = aggregates.checked(x.name, found[1], a.type)
        return Typed(s.aggregate(found[0], found[1], a).cast(kind) if kind != "null" else s.aggregate(found[0], found[1], a), kind)
    name = x.name.lower()
    if name in s.udfs:
        make, kind = s.udfs[name]
        return Typed(make(*(compile(a, s).col for a in x.args)), kind)
    if name in ("event", "allevents") and len(x.args) == 1 and isinstance(x.args[0], A.Col) and x.args[0].name in s.chains:
        events = s.chains[x.args[0].name][0]
        return Typed(F.try_element_at(events, F.lit(-1)) if name == "event" else events, "object")
    if name in ("cast", "convert") and len(x.args) == 2 and isinstance(x.args[1], A.Lit):
        return _cast(A.Cast(x.args[0], str(x.args[1].value)), s)
    f = SCALARS.get(ALIASES.get(name, name))
    if f is None:
        raise DialectError(f"unknown function {x.name}")
    if not f.least <= len(x.args) <= f.most:
        raise DialectError(f"{x.name} takes {f.least}{'' if f.least == f.most else f' to {f.most}'} arguments, not {len(x.args)}")
    args = [compile(a, s) for a in x.args]
    if name == "concat" and (bad := [a.type for a in args if a.type not in ("string", "null")]):
        raise DialectError(f"concat takes strings, not {bad[0]}")
    return Typed(f.make(args), f.result(args))


def _chain_aggregate(name: str, a: aggregates.Aggregate, c: A.Col, s: Scope) -> Typed:
    """An aggregate over all events of a pattern step: ``count(e)`` or ``sum(e.x)``."""
    events, kinds = s.chains[c.of if c.of is not None else c.name]
    if c.of is None:
        if name != "count":
            raise DialectError(f"{name} of a step takes one of its columns")
        return Typed(F.size(events).cast("bigint"), "bigint")
    if c.name not in kinds or a.chain is None:
        raise DialectError(f"{name}({c.of}.{c.name}) is not known")
    kind = aggregates.checked(name, a, kinds[c.name])
    return Typed(a.finish(a.chain(F.transform(events, lambda e: e[c.name]))).cast(kind), kind)


def _case(x: A.Case, s: Scope) -> Typed:
    results = [compile(r, s) for _, r in x.whens] + ([compile(x.other, s)] if x.other is not None else [])
    kinds = {r.type for r in results} - {"null"}
    if len(kinds) > 1:
        raise DialectError(f"CASE branches must have one type, not {sorted(kinds)}")
    operand = compile(x.operand, s) if x.operand is not None else None
    out = F
    for (when, _), r in zip(x.whens, results):
        c = compile(when, s)
        if operand is None and c.type not in ("boolean", "null"):
            raise DialectError("WHEN takes a condition")
        out = out.when(c.col if operand is None else comparison("=", operand, c, "sql").col, r.col)
    return Typed(out.otherwise(results[-1].col if x.other is not None else F.lit(None)), kinds.pop() if kinds else "null")


def _cast(x: A.Cast, s: Scope) -> Typed:
    a, kind = compile(x.x, s), spark_type(x.type)
    col = F.trim(a.col) if a.type == "string" and kind != "string" else a.col
    if a.type in ("float", "double") and kind in ("int", "bigint"):
        col = F.signum(col) * F.floor(F.abs(col))  # toward zero
    return Typed(col.try_cast(kind), kind)


def _in(x: A.InList, s: Scope) -> Typed:
    if not x.items:
        return Typed(F.lit(x.negated), "boolean")
    out: A.Expr = A.Binary("=", x.x, x.items[0])
    for i in x.items[1:]:
        out = A.Binary("or", out, A.Binary("=", x.x, i))
    if all(isinstance(i, A.Lit) and i.value is not None for i in x.items) and s.null_mode == "sql":
        compile(out, s)  # for its type checks; one set test runs
        col = compile(x.x, s).col.isin([i.value for i in x.items])
        return Typed(~col if x.negated else col, "boolean")
    return compile(A.Unary("not", out) if x.negated else out, s)


def _in_table(x: A.InTable, s: Scope) -> Typed:
    raise DialectError("IN table stands in WHERE, alone or in a conjunction")


def _like(x: A.Like, s: Scope) -> Typed:
    a, p = compile(x.x, s), compile(x.pattern, s)
    for t in (a, p):
        if t.type not in ("string", "null"):
            raise DialectError(f"LIKE takes strings, not {t.type}")
    col = F.like(a.col, p.col)
    return Typed(~col if x.negated else col, "boolean")


def _is_null(x: A.IsNull, s: Scope) -> Typed:
    a = compile(x.x, s)
    return Typed(a.col.isNotNull() if x.negated else a.col.isNull(), "boolean")


def _extract(x: A.Extract, s: Scope) -> Typed:
    a = compile(x.x, s)
    return Typed(F.extract(F.lit(x.part), F.timestamp_millis(a.col.cast("bigint"))).cast("bigint"), "bigint")


def _col(x: A.Col, s: Scope) -> Typed:
    return s.find(x)


_MAKERS = {A.Lit: _lit, A.Col: _col, A.Unary: _unary, A.Binary: _binary, A.Call: _call, A.Case: _case, A.Cast: _cast, A.InList: _in, A.InTable: _in_table, A.Like: _like, A.IsNull: _is_null, A.Extract: _extract}

"""Aggregates: one definition, used over groups, over window frames and over pattern chains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tidewright.lang.lexer import DialectError

NUMERIC = ("int", "bigint", "float", "double")


@dataclass(frozen=True)
class Aggregate:
    """``grouped`` makes the column over a group or, with ``over``, a frame; ``chain`` over an array of a step's events.

    ``framed``, where given, is for frames that take no such aggregate.
    ``forever`` aggregates see all events so far, whatever the window.
    """

    result: Callable[[str | None], str]
    grouped: Callable[[Column], Column]
    chain: Callable[[Column], Column] | None = None
    framed: Callable[[Column, WindowSpec], Column] | None = None
    finish: Callable[[Column], Column] = staticmethod(lambda c: c)
    forever: bool = False
    ordered: bool = False
    numeric: bool = True


def _sum_type(t: str | None) -> str:
    return "double" if t in ("float", "double") else "bigint"


def _same(t: str | None) -> str:
    return t or "null"


def _total(a: Column) -> Column:
    return F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x.cast("double"))


def _mean(a: Column) -> Column:
    held = F.filter(a, lambda x: x.isNotNull())
    return F.try_divide(_total(a), F.size(held))


def _spread(a: Column) -> Column:
    held, mean = F.filter(a, lambda x: x.isNotNull()), _mean(a)
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda s, x: s + (x.cast("double") - mean) * (x.cast("double") - mean)), F.size(held))


AGGREGATES: dict[str, Aggregate] = {
    "sum": Aggregate(_sum_type, lambda x: F.sum(x), _total, finish=lambda c: F.coalesce(c, F.lit(0))),
    "avg": Aggregate(lambda t: "double", lambda x: F.avg(x), _mean),
    "count": Aggregate(lambda t: "bigint", lambda x: F.count(x), lambda a: F.size(F.filter(a, lambda x: x.isNotNull())), numeric=False),
    "distinctcount": Aggregate(lambda t: "bigint", lambda x: F.count_distinct(x), lambda a: F.size(F.array_distinct(F.filter(a, lambda x: x.isNotNull()))), framed=lambda x, w: F.size(F.collect_set(x).over(w)), numeric=False),
    "sumdistinct": Aggregate(_sum_type, lambda x: F.sum_distinct(x), lambda a: _total(F.array_distinct(a)), framed=lambda x, w: _total(F.collect_set(x).over(w)), finish=lambda c: F.coalesce(c, F.lit(0))),
    "approxdistinctcount": Aggregate(lambda t: "bigint", lambda x: F.approx_count_distinct(x), numeric=False),
    "min": Aggregate(_same, lambda x: F.min(x), F.array_min, numeric=False),
    "max": Aggregate(_same, lambda x: F.max(x), F.array_max, numeric=False),
    "minforever": Aggregate(_same, lambda x: F.min(x), F.array_min, forever=True, numeric=False),
    "maxforever": Aggregate(_same, lambda x: F.max(x), F.array_max, forever=True, numeric=False),
    "stddev": Aggregate(lambda t: "double", lambda x: F.stddev_pop(x), lambda a: F.sqrt(_spread(a))),
    "variance": Aggregate(lambda t: "double", lambda x: F.var_pop(x), _spread),
    "first": Aggregate(_same, lambda x: F.first(x), lambda a: F.try_element_at(a, F.lit(1)), ordered=True, numeric=False),
    "last": Aggregate(_same, lambda x: F.last(x), lambda a: F.try_element_at(a, F.lit(-1)), ordered=True, numeric=False),
}
#: Other names.
ALIASES = {"average": "avg", "stddevpop": "stddev", "stddev_pop": "stddev", "var_pop": "variance", "min_forever": "minforever", "max_forever": "maxforever", "distinct_count": "distinctcount"}
#: How an aggregate over all events so far follows from parts of them: what each part has, and how two values of it become one.
PARTS = {"sum": ("sum",), "count": ("count",), "avg": ("sum", "count"), "min": ("min",), "max": ("max",), "minforever": ("min",), "maxforever": ("max",)}
MERGES: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def find(name: str, distinct: bool = False) -> tuple[str, Aggregate] | None:
    key = ALIASES.get(name.lower(), name.lower())
    if distinct:
        key = {"count": "distinctcount", "sum": "sumdistinct"}.get(key, key)
        if key in AGGREGATES and key not in ("distinctcount", "sumdistinct", "min", "max"):
            raise DialectError(f"{name} takes no DISTINCT")
    return (key, AGGREGATES[key]) if key in AGGREGATES else None


def checked(name: str, a: Aggregate, kind: str | None) -> str:
    if a.numeric and kind is not None and kind not in (*NUMERIC, "null"):
        raise DialectError(f"{name} takes numbers, not {kind}")
    return a.result(kind)

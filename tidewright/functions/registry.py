"""Extension points: scalar functions, aggregates and window types of one's own."""

from __future__ import annotations

from collections.abc import Callable

from tidewright.functions.aggregates import AGGREGATES, Aggregate
from tidewright.functions.scalars import SCALARS, Scalar


def scalar(name: str, result: str, least: int = 1, most: int | None = None) -> Callable:
    """Decorates a function from columns to a column; a pandas or Arrow UDF is one."""

    def add(f: Callable) -> Callable:
        SCALARS[name.lower()] = Scalar(least, most if most is not None else least, lambda args: result, lambda args: f(*(a.col for a in args)))
        return f

    return add


def aggregate(name: str, result: str, forever: bool = False, numeric: bool = False) -> Callable:
    """Decorates a function from a column to an aggregate column, of built-ins or a grouped-aggregate pandas UDF."""

    def add(f: Callable) -> Callable:
        AGGREGATES[name.lower()] = Aggregate(lambda t: result, f, forever=forever, numeric=numeric)
        return f

    return add

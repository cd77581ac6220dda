"""Syntax tree of the dialect. The runner takes these objects as well as text."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """Base of expressions."""


@dataclass(frozen=True)
class Lit(Expr):
    value: object
    kind: str  # int, long, double, string, bool, null, interval (ms)


@dataclass(frozen=True)
class Col(Expr):
    name: str
    of: str | None = None
    index: int | None = None  # into a step's events: 0 the first, -1 the last


@dataclass(frozen=True)
class Star(Expr):
    of: str | None = None


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    x: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    other: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    x: Expr
    type: str


@dataclass(frozen=True)
class InList(Expr):
    x: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class InTable(Expr):
    x: Expr
    table: str


@dataclass(frozen=True)
class Like(Expr):
    x: Expr
    pattern: Expr
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Expr):
    x: Expr
    negated: bool = False


@dataclass(frozen=True)
class Extract(Expr):
    part: str
    x: Expr


@dataclass(frozen=True)
class WindowSpec:
    """``args`` are expressions; the meaning is the window type's."""

    type: str
    args: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Rel:
    name: str
    alias: str | None = None
    window: WindowSpec | None = None

    @property
    def label(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    left: Rel | Join
    right: Rel
    how: str  # inner, left, right, full
    on: Expr | None
    unidirectional: str | None = None


@dataclass(frozen=True)
class Step:
    """One pattern element: least to most events of a stream."""

    stream: str
    alias: str | None
    where: Expr | None = None
    least: int = 1
    most: int = 1

    @property
    def label(self) -> str:
        return self.alias or self.stream


@dataclass(frozen=True)
class Logical:
    """Both steps in any order, or either."""

    op: str  # and, or
    a: Step
    b: Step


@dataclass(frozen=True)
class Absent:
    """No event of the stream for a time after the step before (or before the step after)."""

    stream: str
    alias: str | None
    where: Expr | None
    wait: int


@dataclass(frozen=True)
class Pattern:
    mode: str  # pattern, sequence
    steps: tuple[Step | Logical | Absent, ...]
    every: bool = False
    within: int | None = None
    within_events: int | None = None


@dataclass(frozen=True)
class OrderItem:
    x: Expr
    descending: bool = False


@dataclass(frozen=True)
class Rate:
    """``OUTPUT ALL|FIRST|LAST EVERY n EVENTS`` or a time, or ``OUTPUT SNAPSHOT EVERY`` a time."""

    what: str
    events: int | None = None
    ms: int | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[tuple[Expr, str | None], ...]
    source: Rel | Join | Pattern
    where: Expr | None = None
    window: WindowSpec | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[OrderItem, ...] = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    rate: Rate | None = None
    target: str = "OutputStream"


@dataclass(frozen=True)
class CreateStream:
    name: str
    columns: tuple[tuple[str, str], ...]
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, str], ...]
    options: dict = field(default_factory=dict)
    key: tuple[str, ...] = ()


@dataclass(frozen=True)
class CreateTrigger:
    name: str
    start: bool = False
    every: int | None = None
    cron: str | None = None


@dataclass(frozen=True)
class CreateAggregation:
    """A rollup of a stream by calendar-free durations, from the finest to the coarsest."""

    name: str
    select: Select
    durations: tuple[str, ...]
    by: str | None = None


@dataclass(frozen=True)
class Partition:
    keys: tuple[tuple[str, Expr], ...]  # (stream, key)
    body: tuple[Select, ...]


@dataclass(frozen=True)
class Write:
    """``UPDATE t SET … FROM``-free forms: update, delete or upsert of a table from a query, by key."""

    op: str  # update, delete, upsert
    table: str
    select: Select
    key: tuple[str, ...]

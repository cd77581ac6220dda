"""Scalar functions: name -> (argument counts, result type, column)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.lang.lexer import DialectError
from tidewright.types import RANK, widest


@dataclass(frozen=True)
class Typed:
    """A column and its type in the dialect; ``constant`` has a literal's value."""

    col: Column
    type: str
    constant: object = None


@dataclass(frozen=True)
class Scalar:
    least: int
    most: int
    result: Callable[[list[Typed]], str]
    make: Callable[[list[Typed]], Column]


def _double(args: list[Typed]) -> str:
    return "double"


def _string(args: list[Typed]) -> str:
    return "string"


def _int(args: list[Typed]) -> str:
    return "int"


def _long(args: list[Typed]) -> str:
    return "bigint"


def _bool(args: list[Typed]) -> str:
    return "boolean"


def _first(args: list[Typed]) -> str:
    return args[0].type


def _common(args: list[Typed]) -> str:
    kinds = {a.type for a in args} - {"null"}
    if len(kinds) > 1:
        raise DialectError(f"arguments must have one type, not {sorted(kinds)}")
    return kinds.pop() if kinds else "null"


def _wider(args: list[Typed]) -> str:
    out = args[0].type
    for a in args[1:]:
        out = out if a.type == out else widest(out, a.type)
    return out


def d(a: Typed) -> Column:
    return a.col.cast("double")


def _trunc(a: list[Typed]) -> Column:
    if len(a) == 1:
        return F.signum(d(a[0])) * F.floor(F.abs(d(a[0]))).cast("double")
    scale = F.pow(F.lit(10.0), a[1].col)
    return F.signum(d(a[0])) * F.floor(F.abs(d(a[0])) * scale).cast("double") / scale


def _round(a: list[Typed]) -> Column:
    if len(a) == 1:
        return F.round(d(a[0]), 0)
    if isinstance(a[1].constant, int):
        return F.round(d(a[0]), a[1].constant)
    scale = F.pow(F.lit(10.0), a[1].col)
    return F.round(d(a[0]) * scale, 0) / scale


def _extreme(pick: Callable) -> Callable[[list[Typed]], Column]:
    return lambda a: d(a[0]) if len(a) == 1 else pick(*map(d, a))


def _substring(a: list[Typed]) -> Column:
    """From 1; a start below 1 is 1; without a length to the end."""
    start = F.greatest(a[1].col.cast("int"), F.lit(1))
    rest = F.lit((1 << 31) - 1) if len(a) == 2 else F.greatest(a[2].col.cast("int"), F.lit(0))
    return F.substring(a[0].col, start, rest)


def _chr(a: list[Typed]) -> Column:
    """Any code point, without Python: its UTF-8 bytes decoded. Invalid ones give null."""
    n = a[0].col.cast("int")
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    tail = lambda shift: byte(F.shiftright(n, shift).bitwiseAND(63).bitwiseOR(128))
    made = (
        F.when(n < 0x80, byte(n))
        .when(n < 0x800, F.concat(byte(F.shiftright(n, 6).bitwiseOR(0xC0)), tail(0)))
        .when(n < 0x10000, F.concat(byte(F.shiftright(n, 12).bitwiseOR(0xE0)), tail(6), tail(0)))
        .otherwise(F.concat(byte(F.shiftright(n, 18).bitwiseOR(0xF0)), tail(12), tail(6), tail(0)))
    )
    return F.when(n.between(0, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(made), "UTF-8"))


def _pad(f: Callable) -> Callable[[list[Typed]], Column]:
    return lambda a: F.when(a[2].col == "", a[0].col).otherwise(F.call_function(f, a[0].col, a[1].col.cast("int"), a[2].col))


# Conversions of date patterns and what they are in Spark's patterns.
PERCENT = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%I": "hh", "%p": "a", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%3f": "SSS", "%f": "SSSSSSSSS", "%%": "%"}


def date_pattern(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        key = next((k for k in (text[i : i + 3], text[i : i + 2]) if k in PERCENT), None)
        if key:
            out += PERCENT[key]
            i += len(key)
        else:
            c = text[i]
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            i += 1
    return out


def _constant(a: Typed, what: str) -> object:
    if a.constant is None:
        raise DialectError(f"{what} must be a constant")
    return a.constant


def _format_date(a: list[Typed]) -> Column:
    return F.date_format(F.timestamp_millis(a[0].col.cast("bigint")), date_pattern(str(_constant(a[1], "a date pattern"))))


def _parse_date(a: list[Typed]) -> Column:
    return F.unix_millis(F.try_to_timestamp(a[0].col, F.lit(date_pattern(str(_constant(a[1], "a date pattern"))))))


def _date_add(a: list[Typed]) -> Column:
    """Seconds to days; null for other units."""
    unit = str(_constant(a[2], "a date unit")).lower().rstrip("s")
    ms = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}.get(unit)
    return F.lit(None).cast("bigint") if ms is None else a[0].col.cast("bigint") + a[1].col.cast("bigint") * ms


def _trim(left: bool, right: bool) -> Callable[[list[Typed]], Column]:
    """All white space, not spaces only."""

    def make(a: list[Typed]) -> Column:
        out = a[0].col
        if left:
            out = F.regexp_replace(out, r"(?U)^\s+", "")
        return F.regexp_replace(out, r"(?U)\s+\z", "") if right else out

    return make


def _one(f: Callable) -> Callable[[list[Typed]], Column]:
    return lambda a: f(d(a[0]))


def _instance(kind: str) -> Scalar:
    return Scalar(1, 1, _bool, lambda a: a[0].col.isNotNull() if a[0].type == kind else F.lit(False))


def _time(a: Typed) -> Column:
    """Milliseconds, or a date and time as text."""
    return F.unix_millis(F.try_to_timestamp(a.col)) if a.type == "string" else a.col.cast("bigint")


FLOOR_MS = {"second": 1_000, "sec": 1_000, "minute": 60_000, "min": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_592_000_000, "year": 31_536_000_000}


def duration_ms(name: str) -> int:
    """Of a rollup's duration: a month is 30 days, a year 365."""
    key = name.lower() if name.lower() in FLOOR_MS else name.lower().removesuffix("s")
    if key not in FLOOR_MS:
        raise DialectError(f"unknown duration {name}")
    return FLOOR_MS[key]


SCALARS: dict[str, Scalar] = {
    # Numbers
    "abs": Scalar(1, 1, _first, lambda a: F.abs(a[0].col)),
    "ceil": Scalar(1, 1, _double, lambda a: F.ceil(d(a[0])).cast("double")),
    "floor": Scalar(1, 1, _double, lambda a: F.floor(d(a[0])).cast("double")),
    "round": Scalar(1, 2, _double, _round),
    "trunc": Scalar(1, 2, _double, _trunc),
    "sqrt": Scalar(1, 1, _double, _one(F.sqrt)),
    "exp": Scalar(1, 1, _double, _one(F.exp)),
    "ln": Scalar(1, 1, _double, _one(F.ln)),
    "log": Scalar(1, 1, _double, _one(F.ln)),
    "log10": Scalar(1, 1, _double, _one(F.log10)),
    "power": Scalar(2, 2, _double, lambda a: F.pow(d(a[0]), d(a[1]))),
    **{n: Scalar(1, 1, _double, _one(getattr(F, n))) for n in ("sin", "cos", "tan", "asin", "acos", "atan")},
    "mod": Scalar(2, 2, _double, lambda a: F.try_mod(d(a[0]), d(a[1]))),
    "sign": Scalar(1, 1, _int, lambda a: F.signum(d(a[0])).cast("int")),
    "maximum": Scalar(1, 99, _double, _extreme(F.greatest)),
    "minimum": Scalar(1, 99, _double, _extreme(F.least)),
    # Strings
    "length": Scalar(1, 1, _int, lambda a: F.length(a[0].col)),
    "octet_length": Scalar(1, 1, _int, lambda a: F.octet_length(a[0].col)),
    "concat": Scalar(1, 99, _string, lambda a: F.concat(*(x.col for x in a))),
    "lower": Scalar(1, 1, _string, lambda a: F.lower(a[0].col)),
    "upper": Scalar(1, 1, _string, lambda a: F.upper(a[0].col)),
    "substring": Scalar(2, 3, _string, _substring),
    "trim": Scalar(1, 1, _string, _trim(True, True)),
    "ltrim": Scalar(1, 1, _string, _trim(True, False)),
    "rtrim": Scalar(1, 1, _string, _trim(False, True)),
    "like": Scalar(2, 2, _bool, lambda a: F.like(a[0].col, a[1].col)),
    "replace": Scalar(3, 3, _string, lambda a: F.replace(a[0].col, a[1].col, a[2].col)),
    "left": Scalar(2, 2, _string, lambda a: F.left(a[0].col, a[1].col.cast("int"))),
    "right": Scalar(2, 2, _string, lambda a: F.right(a[0].col, a[1].col.cast("int"))),
    "reverse": Scalar(1, 1, _string, lambda a: F.reverse(a[0].col)),
    "repeat": Scalar(2, 2, _string, lambda a: F.repeat(a[0].col, F.greatest(a[1].col.cast("int"), F.lit(0)))),
    "position": Scalar(2, 2, _int, lambda a: F.call_function("position", a[0].col, a[1].col)),
    "ascii": Scalar(1, 1, _int, lambda a: F.when(a[0].col != "", F.ascii(a[0].col))),
    "chr": Scalar(1, 1, _string, _chr),
    "lpad": Scalar(3, 3, _string, _pad("lpad")),
    "rpad": Scalar(3, 3, _string, _pad("rpad")),
    "starts_with": Scalar(2, 2, _bool, lambda a: F.startswith(a[0].col, a[1].col)),
    "ends_with": Scalar(2, 2, _bool, lambda a: F.endswith(a[0].col, a[1].col)),
    "contains": Scalar(2, 2, _bool, lambda a: F.contains(a[0].col, a[1].col)),
    # Nulls, conditions and types
    "coalesce": Scalar(1, 99, _common, lambda a: F.coalesce(*(x.col for x in a))),
    "default": Scalar(2, 2, _wider, lambda a: F.coalesce(*(x.col.cast(_wider(a)) if _wider(a) in RANK else x.col for x in a))),
    "nullif": Scalar(2, 2, _first, lambda a: F.nullif(a[0].col, a[1].col) if a[0].type == a[1].type else a[0].col),
    "if": Scalar(3, 3, lambda a: _common(a[1:]), lambda a: F.when(a[0].col, a[1].col).otherwise(a[2].col)),
    "is_null": Scalar(1, 1, _bool, lambda a: a[0].col.isNull()),
    "is_not_null": Scalar(1, 1, _bool, lambda a: a[0].col.isNotNull()),
    **{f"instanceof{n}": _instance(k) for n, k in (("boolean", "boolean"), ("string", "string"), ("integer", "int"), ("long", "bigint"), ("float", "float"), ("double", "double"))},
    "uuid": Scalar(0, 0, _string, lambda a: F.uuid()),
    # Times
    "now": Scalar(0, 0, _long, lambda a: F.unix_millis(F.current_timestamp())),
    "eventtimestamp": Scalar(0, 0, _long, lambda a: F.col("_ts")),
    "formatdate": Scalar(2, 2, _string, _format_date),
    "parsedate": Scalar(2, 2, _long, _parse_date),
    "dateadd": Scalar(3, 3, _long, _date_add),
    "timestampinmilliseconds": Scalar(0, 1, _long, lambda a: F.unix_millis(F.try_to_timestamp(a[0].col)) if a else F.unix_millis(F.current_timestamp())),
    "aggregatebasetime": Scalar(2, 2, _long, lambda a: a[0].col - F.pmod(a[0].col, F.lit(duration_ms(str(_constant(a[1], "a duration")))))),
    "starttimeendtime": Scalar(2, 2, lambda a: "object", lambda a: F.array(_time(a[0]), _time(a[1]))),
    "shouldupdate": Scalar(1, 1, _bool, lambda a: a[0].col.cast("bigint") >= F.col("_ts")),
    "gettimezone": Scalar(0, 0, _string, lambda a: F.current_timezone()),
}
#: Other names of functions.
ALIASES = {"truncate": "trunc", "pow": "power", "substr": "substring", "locate": "position", "instr": "position", "char": "chr", "ifnull": "default", "iif": "if", "startswith": "starts_with", "endswith": "ends_with", "currenttimemillis": "now"}

"""Mappers between payloads and events: JSON, CSV and bytes, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.lang.lexer import DialectError

#: The largest payload in bytes and the deepest nesting that are accepted.
MAX_BYTES, MAX_DEPTH = 10 << 20, 32
ERROR = "_error"


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    if isinstance(kind, T.BinaryType):
        return text.cast("binary")
    return F.trim(text).try_cast(kind)


def from_json(df: DataFrame, schema: T.StructType, payload: str = "value", mappings: dict[str, str] | None = None) -> DataFrame:
    """``df`` without its payload, with the schema's columns and ``_error``, null where the payload was good.

    Fields are found by name, exactly or else in any case; ``mappings`` gives
    JSON paths instead. Nested values of STRING columns stay JSON text. A value
    that is no value of its type is null. Payloads that are no JSON object,
    too long or too deep have an error and null columns. A null payload is no
    object.
    """
    text = F.col(payload).cast("string")
    rest = [c for c in df.columns if c != payload]
    keys = F.json_object_keys(text)
    plain = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    bare = F.regexp_replace(plain, r"[^\[\]{}]", "")
    for _ in range(MAX_DEPTH):  # each turn takes the innermost brackets off
        bare = F.regexp_replace(bare, r"\[\]|\{\}", "")
    deep = F.when(F.length(F.regexp_replace(plain, r"[^\[{]", "")) > MAX_DEPTH, F.length(bare) > 0)
    error = F.when(F.octet_length(text) > MAX_BYTES, "payload is too long").when(deep, "payload is too deep").when(F.coalesce(keys.isNull(), F.lit(True)), "payload is no JSON object")

    def of(f: T.StructField) -> Column:
        if mappings and f.name in mappings:
            return F.get_json_object(text, mappings[f.name])
        exact = F.get_json_object(text, _path(f.name))
        other = F.try_element_at(F.filter(keys, lambda k: (F.lower(k) == f.name.lower()) & (k != f.name)), F.lit(1))
        loose = F.try_element_at(F.from_json(text, "map<string,string>"), other)
        return F.coalesce(exact, loose)

    made = df.withColumn(ERROR, error)
    return made.select(*rest, *(F.when(F.col(ERROR).isNull(), _typed(of(f), f.dataType)).alias(f.name) for f in schema.fields), ERROR)


def _path(name: str) -> str:
    if "'" in name:
        raise DialectError(f"a JSON field cannot have a quote: {name}")
    return f"$['{name}']"


def to_json(df: DataFrame, template: str | None = None, generic: bool = False) -> DataFrame:
    """One column ``value``: an object of the row's fields, or a template whose ``{{field}}`` are replaced. ``generic`` names fields field_0, field_1 and so on."""
    if template is None:
        cols = [F.col(c).alias(f"field_{k}" if generic else c) for k, c in enumerate(df.columns)]
        return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))
    parts: list[Column] = []
    for k, p in enumerate(re.split(r"\{\{\s*(\w+)\s*\}\}", template)):
        if k % 2 and p not in df.columns:
            raise DialectError(f"the template's field {p} is not in the stream")
        parts.append(F.coalesce(F.col(p).cast("string"), F.lit("null")) if k % 2 else F.lit(p))
    return df.select(F.concat(*parts).alias("value"))


def from_csv(df: DataFrame, schema: T.StructType, payload: str = "value", delimiter: str = ",", quote: str = '"', escape: str = "\\", columns: dict[str, int] | None = None) -> DataFrame:
    """``df`` without its payload, with the schema's columns and ``_error``.

    Fields come by position, or by the positions of ``columns``. A value that
    is no value of its type is null; a record with fewer fields than needed has
    an error and null columns.
    """
    rest = [c for c in df.columns if c != payload]
    order = columns or {f.name: k for k, f in enumerate(schema.fields)}
    width = max(order.values()) + 1
    raw = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)])
    text = F.col(payload).cast("string")
    split = F.from_csv(text, raw.simpleString()[7:-1].replace(":", " "), {"sep": delimiter, "quote": quote, "escape": escape, "mode": "PERMISSIVE"})
    made = df.withColumn("_c", split)
    last = F.col(f"_c.c{width - 1}")
    error = F.when(text.isNull() | (last.isNull() & ~F.endswith(text, F.lit(delimiter))), "too few fields")
    made = made.withColumn(ERROR, error)
    return made.select(*rest, *(F.when(F.col(ERROR).isNull(), _typed(F.col(f"_c.c{order[f.name]}"), f.dataType)).alias(f.name) for f in schema.fields), ERROR)


def to_csv(df: DataFrame, delimiter: str = ",") -> DataFrame:
    return df.select(F.to_csv(F.struct(*df.columns), {"sep": delimiter}).alias("value"))


def from_bytes(df: DataFrame, column: str, payload: str = "value") -> DataFrame:
    """The payload as it is, in a column of bytes."""
    return df.select(*(c for c in df.columns if c != payload), F.col(payload).cast("binary").alias(column), F.lit(None).cast("string").alias(ERROR))


def to_bytes(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("binary").alias("value"))


def mapped(df: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """By the WITH options of a source: ``format`` and the format's own."""
    kind = options.get("format", "json")
    if kind == "json":
        paths = {k.split(".", 2)[2]: v for k, v in options.items() if k.startswith("json.mapping.")}
        return from_json(df, schema, mappings=paths or None)
    if kind == "csv":
        at = {k.split(".", 2)[2]: int(v) for k, v in options.items() if k.startswith("csv.mapping.")}
        return from_csv(df, schema, delimiter=options.get("csv.delimiter", ",").replace("\\t", "\t"), quote=options.get("csv.quote", '"'), escape=options.get("csv.escape", "\\"), columns=at or None)
    if kind == "bytes":
        return from_bytes(df, schema.fields[0].name)
    raise DialectError(f"no mapper for {kind}")

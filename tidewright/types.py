"""Type names of the dialect and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from tidewright.lang.lexer import DialectError

#: The dialect's type names. Decimals are doubles and times are epoch milliseconds.
NAMES = {
    "string": ("VARCHAR", "TEXT", "STRING", "CHAR"),
    "int": ("INT", "INTEGER", "INT2", "INT4", "SMALLINT", "TINYINT"),
    "bigint": ("BIGINT", "INT8", "LONG", "TIMESTAMP", "DATETIME", "DATE", "TIME"),
    "float": ("FLOAT", "REAL"),
    "double": ("DOUBLE", "DECIMAL", "NUMERIC"),
    "boolean": ("BOOLEAN", "BOOL"),
    "binary": ("OBJECT",),
}
_SPARK = {name: spark for spark, names in NAMES.items() for name in names}
CLASSES = {"string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "float": T.FloatType, "double": T.DoubleType, "boolean": T.BooleanType, "binary": T.BinaryType}
RANK = {"int": 0, "bigint": 1, "float": 2, "double": 3}


def spark_type(name: str) -> str:
    """The Spark type of a dialect type name."""
    if name.upper() not in _SPARK:
        raise DialectError(f"type {name} is not supported")
    return _SPARK[name.upper()]


def schema(columns: tuple[tuple[str, str], ...]) -> T.StructType:
    return T.StructType([T.StructField(n, CLASSES[spark_type(t)]()) for n, t in columns])


def widest(a: str, b: str) -> str:
    """The type of arithmetic between two numeric types."""
    if a == "null" or b == "null":
        return b if a == "null" else a
    if a not in RANK or b not in RANK:
        raise DialectError(f"no arithmetic between {a} and {b}")
    return max(a, b, key=RANK.__getitem__)


def of_spark(t: T.DataType) -> str:
    """The dialect's view of a Spark type."""
    name = t.simpleString()
    return {"tinyint": "int", "smallint": "int", "timestamp": "bigint", "timestamp_ntz": "bigint", "date": "bigint", "void": "null"}.get(name, "double" if name.startswith("decimal") else name)

"""What to do with events that a mapper or query could not take: drop, dead letters, fail; and retries of a sink."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.lang.lexer import DialectError
from tidewright.sources.formats import ERROR

#: The columns of a dead-letter stream and the strategies.
DLQ = "originalEvent string, errorMessage string, errorType string, timestamp bigint, attemptCount int, streamName string"
STRATEGIES = ("drop", "retry", "dlq", "fail")


def dead_letters(df: DataFrame, original: str, stream: str, kind: str = "mapping", attempts: int = 1) -> DataFrame:
    """The rows with an error, as dead letters."""
    bad = df.where(F.col(ERROR).isNotNull())
    return bad.select(
        F.coalesce(F.col(original).cast("string"), F.lit("")).alias("originalEvent"),
        F.col(ERROR).alias("errorMessage"),
        F.lit(kind).alias("errorType"),
        F.unix_millis(F.current_timestamp()).alias("timestamp"),
        F.lit(attempts).alias("attemptCount"),
        F.lit(stream).alias("streamName"),
    )


def handled(df: DataFrame, strategy: str, stream: str, original: str = "_payload") -> tuple[DataFrame, DataFrame | None]:
    """The good rows, and dead letters if the strategy keeps them. "fail" ends the query at the first error."""
    if strategy not in STRATEGIES:
        raise DialectError(f"unknown error strategy {strategy}")
    drop = [c for c in (ERROR, original) if c in df.columns]
    if strategy == "fail":
        bad = F.when(F.col(ERROR).isNotNull(), F.raise_error(F.concat(F.lit(f"{stream}: "), F.col(ERROR))).cast("boolean"))
        return df.where(F.coalesce(bad, F.lit(True))).drop(*drop), None
    good = df.where(F.col(ERROR).isNull()).drop(*drop)
    return good, dead_letters(df, original, stream) if strategy == "dlq" else None


def retried(write: Callable[[DataFrame], None], attempts: int = 3, wait: float = 0.1, factor: float = 2.0, fallback: Callable[[DataFrame, Exception, int], None] | None = None) -> Callable[[DataFrame], None]:
    """A sink that tries again with growing waits; what still fails goes to ``fallback`` or is raised."""

    def run(df: DataFrame) -> None:
        pause = wait
        for n in range(1, attempts + 1):
            try:
                return write(df)
            except Exception as e:
                if n == attempts:
                    if fallback is None:
                        raise
                    return fallback(df, e, n)
                time.sleep(pause)
                pause *= factor

    return run


def check_dead_letter_stream(columns: tuple[tuple[str, str], ...], name: str) -> None:
    """A declared dead-letter stream has just these columns."""
    from tidewright.types import spark_type

    want = [tuple(c.split()) for c in DLQ.split(", ")]
    if [(n, spark_type(t)) for n, t in columns] != want:
        raise DialectError(f"{name} is no dead-letter stream: it needs {DLQ}")

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and all ASCII but digits and letters to a space: bytes.split() then gives the words.
WORDS = bytes(32 if b < 128 and not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90) else LOWER[b] for b in range(256))

UPPER_ASCII, LOWER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words for the JVM's regular expressions, once A-Z are lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER_ASCII, LOWER_ASCII)


def words(c: Column) -> Column:
    """Words of digits, letters and non-ASCII characters, A-Z in lower case, as an array."""
    return F.filter(F.split(lower_ascii(c), NOT_WORD), lambda w: w != F.lit(""))


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores in front as long as it is one of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hot_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", salts: int = 2) -> DataFrame:
    """A join where one key may hold much of ``left``, and has few rows in ``right``.

    The columns ``spread`` deal the rows of a key to ``salts`` parts, which the
    right side repeats. As neither side is dealt by ``on`` alone, both are
    exchanged right before the join, so adaptive execution can split a part
    that is still large.
    """
    salt = fresh([*left.columns, *right.columns], "salt")
    a = left.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    b = right.withColumn(salt, F.explode(F.array(*(F.lit(i) for i in range(salts)))))
    return a.join(b, [*on, salt], how).drop(salt)


def scratch(spark: SparkSession) -> str:
    """The folder that all of the cluster shares: ``spark.checkpoint.dir``. Where that is unset a temporary one will do, but only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or tempfile.mkdtemp(prefix="scratch-")).rstrip("/")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system client."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shared(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the cluster shares.

    Spark takes it from ``spark.checkpoint.dir``; see :func:`scratch`.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(scratch(spark))
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with bounded batches: texts may be long, so a batch takes 1000 rows and 8 MB at most.

    A worker gives what it no longer needs back to the system when a task
    ends, as workers live on for other stages.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")):
        df.sparkSession.conf.set(key, most)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_pool()
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(bounded, schema)


def tidy(spark: SparkSession) -> None:
    """Collects garbage on the driver, so that Spark drops shuffles, broadcasts and plans that nothing refers to any more."""
    gc.collect()  # Python's frames hold those of the JVM
    spark.sparkContext._jvm.System.gc()


def own_pool() -> None:
    """Arrow's memory then comes from the C library, which gives it back on request."""
    pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def row_key(id_col: str, text: Column) -> Column:
    """A key by which equal rows are one document, as bytes: the id and a 128-bit hash of the text."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"), F.unhex(F.md5(text)))

"""Helpers that all operators of this package share: staged tables and text batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the class [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may leave it unnamed: there it is a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_root()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, and a lost executor costs no recomputation.

    The write's own shuffle files go when it has ended; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_STORE: dict = {}


def claim(key=None) -> None:
    """Drop what a Python worker keeps for anything but ``key``, and give Arrow's free memory back.

    Workers live from stage to stage, so whoever runs in one claims its store first.
    """
    if _STORE and key not in _STORE:
        _STORE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


def store(key, make: Callable):
    """What a Python worker keeps from task to task: one operator's store at a time."""
    claim(key)
    if key not in _STORE:
        _STORE[key] = make()
    return _STORE[key]


def _libc_trim():
    """The C library's call that returns freed memory to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return None


_trim = _libc_trim()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / "tidemark_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def as_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text): all columns as one struct, so that no name of theirs meets another."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(quoted(text_col)).cast("string").alias("text"))


def of_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the struct ``row``."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def without_space(c: Column) -> Column:
    """``c`` without ASCII white space; plain replacements are several times cheaper than a pattern."""
    return functools.reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("")), SPACE, c)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold about ``most`` bytes; a longer text stays whole, alone."""
    col = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)

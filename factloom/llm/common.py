"""What the operators share: tables, columns under own names, word patterns, sizes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"  # a word: no space, no U+0009..U+000D
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context; Spark copies it to every executor."""
    context = spark.sparkContext
    if getattr(context, "_factloom_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="factloom-code-"), "factloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._factloom_shipped = True


def own(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of ``df`` under the operator's own names, so others can't clash."""
    ship(df.sparkSession)
    return df.select(*(df[f"`{source}`"].alias(name) for name, source in columns.items()))


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: no side of that join is sent whole to the driver and the tasks.

    Spark takes rows of a generator or an Arrow function to be as few as those below, and files to be
    as large as they are packed, so it would send tables that are many times what it allows.
    """
    return side.hint("merge")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """Length in UTF-8 bytes as long; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Hands memory that this process no longer uses back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task``, which releases memory at its end: workers wait for later stages beside those that work."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release()

    return run

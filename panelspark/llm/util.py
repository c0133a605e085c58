"""Shared helpers: byte-level words, 64-bit mixing, work folders, slices of Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_made: list[tuple[SparkSession, str]] = []


def spaced_words(data: bytes) -> list[bytes]:
    """Runs of bytes other than space and 09-0D, after lower-casing A-Z only.

    bytes.lower and bytes.split know ASCII alone, so UTF-8 sequences stay whole.
    """
    return data.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def word_hashes(words) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), dtype=U64, count=len(words))


def bytes_of(text: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its task and would hold it beside an executor's next steps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library other than glibc
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches, rows: int = 512):
    """Arrow batches (whose bytes Spark limits) in slices of few rows, so that few texts are Python objects at a time; gives memory back after the last."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)
        del batch
    give_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master (tests) takes a folder of its own; on a
    cluster that would be another folder on each machine, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        at = f"file://{tempfile.gettempdir()}/panelspark-checkpoints"
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, deleted when the process ends or by settled()."""
    path = f"{shared_dir(spark).rstrip('/')}/{re.sub(r'[^a-z0-9]', '_', name)}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(remove_tables)
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once to the shared folder and read back: later steps start from files, not from the plan above.

    The table is deleted when the process ends, or by settled().
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def repeatable(df: DataFrame, name: str = "input") -> DataFrame:
    """df, if a lost task gives the same rows in the same order again; what stands behind a shuffle may not, and is written once.

    For steps that number rows by their place in a task.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    return cut(df, name) if "Exchange" in plan else df


def remove_tables(but: int = 0) -> None:
    """Deletes what cut() wrote, the first `but` tables apart, if its session still runs."""
    while len(_made) > but:
        spark, path = _made.pop()
        jvm = spark.sparkContext._jvm
        if spark.sparkContext._jsc is not None and jvm is not None:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """make()'s result as a table of its own, once the tables that make() cut on its way are deleted."""
    before = len(_made)
    result = cut(make(), name)
    own = _made.pop()
    remove_tables(before)
    _made.append(own)
    return result

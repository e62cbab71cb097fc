"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: A word is a run of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
BROADCAST_ROWS = 100_000
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, n: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id never does."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n == rest, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a small intermediate to the shared folder and read it back: a fixed, recoverable cut of the lineage."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the folder, for intermediates that ``discard`` removes once nothing reads them any more."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_small(df: DataFrame, small: DataFrame, key: str, *, rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Inner join with one row per (nullable) key on the small side.

    Broadcast while the small side is counted to be within ``rows``; beyond that a salted join, so that a key with a
    third of all rows is still dealt to many tasks.
    """
    right = small.withColumnRenamed(key, "__key")
    if small.limit(rows + 1).count() <= rows:
        return df.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    left = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    right = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__copy"))
    return left.join(right, on).drop("__key", "__salt", "__copy")


def slices(batch, at: int, most: int = 1 << 20):
    """(first row, rows) of the slices of an Arrow batch whose strings in column ``at`` take about ``most`` bytes; a longer one is alone."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield start, stop - start
        start = stop


def tidy() -> None:
    """Give freed memory back to the system: a Python worker lives on for many tasks and would keep its largest one's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)

"""Resumable and report sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table in a folder; None where there is no folder or nothing has been written to it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def missing(keys: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that have no result yet."""
    return keys.join(done.select(*on), list(on), "left_anti")


def append_missing(
    keys: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, on: Sequence[str], *, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Compute and append only what is not in ``path`` yet; returns the whole table.

    Results are appended in one commit per call, never rewritten. A stored table without the key columns, or with
    other columns than the results, is an error.
    """
    spark: SparkSession = keys.sparkSession
    stored = read_if_there(spark, path)
    fresh = compute(keys if stored is None else missing(keys, stored, on))
    if stored is not None and set(stored.columns) != set(fresh.columns):
        raise ValueError(f"the table in {path} has the columns {sorted(stored.columns)}, the results have {sorted(fresh.columns)}")
    writer = fresh.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def write_report(summary: DataFrame, detail: DataFrame, path: str, *, sort: Sequence = ()) -> None:
    """A one-row summary and its sorted detail table, written by the executors."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    (detail.orderBy(*sort) if sort else detail).write.mode("overwrite").parquet(f"{path}/detail")


def detail_order(value: str, key: str = "subject_id"):
    """Largest value first; a missing value counts as 0."""
    return [F.coalesce(F.col(value), F.lit(0.0)).desc(), F.col(key)]

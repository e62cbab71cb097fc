"""Skew-safe building blocks: ordered scans, exact percentiles, size-checked broadcasts.

A window over one key puts the whole key into one task. The helpers here look
at the size of the largest group first and, past a limit, work in key-ordered
chunks: rows are range-partitioned by (keys, order), each chunk is scanned on
its own, and the carry of the few keys that span chunks is added afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import checkpointed

GROUP_ROWS = 2_000_000
BROADCAST_ROWS = 200_000
TASK_ROWS = 250_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; one map-side combined count."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def fits(df: DataFrame, keys: Sequence[str], group_rows: int, at_most: int | None) -> bool:
    """Whether every group is small enough for one task.

    ``at_most`` is a known bound on the rows of a group; without one they are counted.
    """
    return (largest_group(df, keys) if at_most is None else at_most) <= group_rows


def spread(df: DataFrame) -> DataFrame:
    """Fan a scan of few splits out over the cores before heavy work per row.

    A scan with at least as many splits as there are cores is left alone, so a
    large table is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def task_count(spark: SparkSession, rows: int, task_rows: int = TASK_ROWS) -> int:
    """Tasks for a table of ``rows``: with a set number of shuffle partitions a task would grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // task_rows))


def dealt(df: DataFrame, keys: Sequence[str], rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows, by key in tasks of bounded size.

    Done before rows are multiplied, it is the only shuffle: groups and windows by these and further keys stay in place, and so
    do joins by exactly these keys.
    """
    return df.repartition(task_count(df.sparkSession, rows, task_rows), *keys)


def broadcast_within(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the row count is proven to be within the bound."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & a[k].eqNullSafe(b[k])
    return condition


def _chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order)
    # The chunk number must not change when tasks are recomputed, so it is fixed on storage.
    return checkpointed(ranged.withColumn("__chunk", F.spark_partition_id()))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str | Column],
    *,
    group_rows: int = GROUP_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """Inclusive running sums per key in the given order (unique within the key)."""
    values = {f"__v{i}": F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(0)) for i, c in enumerate(sums.values())}
    names = list(sums)
    data = df.withColumns(values)
    if fits(df, keys, group_rows, at_most):
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return data.withColumns({n: F.sum(v).over(w) for n, v in zip(names, values)}).drop(*values)

    parts = _chunks(data, keys, order)
    totals = parts.groupBy(*keys, "__chunk").agg(*[F.sum(v).alias(v) for v in values])
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        totals.select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
            F.col("__chunk").alias("__c"),
            *[F.sum(v).over(before).alias(f"__carry{i}") for i, v in enumerate(values)],
        )
        .where(F.col("__carry0").isNotNull())
    )
    # At most one key continues into each chunk, so the carry has fewer rows than there are chunks.
    on = F.col("__chunk") == F.col("__c")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    local = W.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    scanned = parts.withColumns({n: F.sum(v).over(local) for n, v in zip(names, values)})
    joined = scanned.join(F.broadcast(carry), on, "left")
    joined = joined.withColumns({n: F.col(n) + F.coalesce(F.col(f"__carry{i}"), F.lit(0)) for i, n in enumerate(names)})
    return joined.select(*df.columns, *names)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", **size) -> DataFrame:
    """1-based row number per key; the order must be unique within the key."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, **size)


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    qs: dict[str, float],
    *,
    group_rows: int = GROUP_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """Exact interpolated percentiles per key, one row per key."""
    data = df.select(*keys, F.col(value).alias("__x")).where(F.col("__x").isNotNull())
    if fits(data, keys, group_rows, at_most):
        aggs = [F.percentile("__x", F.lit(q)).alias(n) for n, q in qs.items()]
        return data.groupBy(*keys).agg(*aggs)

    counted = data.groupBy(*keys, "__x").count()
    ranked = running_sums(counted, keys, ["__x"], {"__upto": F.col("count")}, group_rows=0, at_most=1)
    sizes = ranked.groupBy(*keys).agg(F.max("__upto").alias("__n"))
    sizes = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    both = ranked.join(sizes if keys else F.broadcast(sizes), on)
    aggs = []
    for n, q in qs.items():
        position = F.lit(q) * (F.col("__n") - 1)
        lo, hi = F.floor(position), F.ceil(position)
        below = F.col("__upto") - F.col("count")
        at = lambda r: F.max(F.when((below <= r) & (r < F.col("__upto")), F.col("__x")))
        share = F.max(position - lo)
        aggs.append((at(lo) * (F.lit(1.0) - share) + at(hi) * share).alias(n))
    return both.groupBy(*keys).agg(*aggs)


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    medians: dict[str, tuple[str, float]],
    *,
    group_rows: int = GROUP_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """Ordinary aggregates together with exact percentiles {name: (value column, q)}."""
    if fits(df, keys, group_rows, at_most):
        extra = [F.percentile(v, F.lit(q)).alias(n) for n, (v, q) in medians.items()]
        return df.groupBy(*keys).agg(*aggs, *extra)
    df = checkpointed(df)  # read several times below
    out = df.groupBy(*keys).agg(*aggs)
    by_value: dict[str, dict[str, float]] = {}
    for n, (v, q) in medians.items():
        by_value.setdefault(v, {})[n] = q
    for v, qs in by_value.items():
        part = percentiles(df, keys, v, qs, group_rows=0, at_most=1)
        renamed = part.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)], *qs)
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__p{i}"))
        out = out.join(renamed, on, "left").drop(*[f"__p{i}" for i in range(len(keys))])
    return out

"""Seeded samples and work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import GROUP_ROWS, row_numbers


def sample_first_valid(df: DataFrame, n: int, reason: Column, *, key: str, seed: int = 42, draw: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Shuffle by a seeded hash, keep the first n rows without a rejection reason.

    Returns (kept, skip counts per reason up to the n-th hit). ``reason`` is null
    for a valid row. The n-th hit is found by a top-n, so no global running
    count is needed.
    """
    h = draw if draw is not None else F.xxhash64(F.lit(seed), F.col(key))
    rows = df.withColumns({"__h": h, "__why": reason})
    kept = rows.where(F.col("__why").isNull()).orderBy("__h", key).limit(n)
    last = kept.agg(F.max(F.struct("__h", key)).alias("__last"), F.count(F.lit(1)).alias("__n"))  # one row
    before = rows.where(F.col("__why").isNotNull()).crossJoin(F.broadcast(last))
    # With fewer than n hits every row was looked at.
    seen = before.where((F.col("__n") < n) | (F.struct("__h", key) < F.col("__last")))
    return kept.drop("__h", "__why"), seen.groupBy(F.col("__why").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def pick_by_quantile(
    df: DataFrame, by: str, n: int, *, key: str, force: Sequence[str] = (), group_rows: int = GROUP_ROWS
) -> DataFrame:
    """n evenly spaced ranks of ``by`` and, for each forced prefix, the first id that starts with it."""
    ranked = row_numbers(df, [], [by, key], "__rn", group_rows=group_rows)
    size = df.agg(F.count(F.lit(1)).alias("__size"))  # one row
    steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wanted = size.select(F.col("__size"), steps.alias("i")).select((F.bround(F.col("i") * (F.col("__size") - 1) / max(n - 1, 1)) + 1).cast("bigint").alias("__rn")).distinct()
    picks = ranked.join(F.broadcast(wanted), "__rn", "left_semi")  # n rows
    out = picks.select(*df.columns)
    text = F.col(key).cast("string")
    for prefix in force:
        first = df.where(text.startswith(prefix)).orderBy(by, key).limit(1)
        out = out.unionByName(first)
    return out.dropDuplicates([key])


def pick_workload(counts: DataFrame, posteriors: DataFrame, done: DataFrame, target: int, *, max_m: int = 6, key: str = "subject_id") -> DataFrame:
    """Subjects with 1..max_m cues and a posterior: the ``target`` with most cues, minus those done, fewest cues first."""
    eligible = counts.where(F.col("m").between(1, max_m)).join(posteriors.select(key), key, "left_semi")
    picked = eligible.orderBy(F.col("m").desc(), key).limit(target)
    return picked.join(done.select(key), key, "left_anti").orderBy("m", key)

"""Accuracy, ranking, calibration and descriptive reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import ACCURACY_KM, CUE_STOP_WORDS
from .scale import GROUP_ROWS, running_sums, summarise


def threshold_accuracy(distances: DataFrame, *, keys: Sequence[str] = (), km: Sequence[float] = ACCURACY_KM) -> DataFrame:
    """Share of rows within each distance; a null distance is a miss and counts."""
    hits = [F.avg(F.when(F.col("d") <= t, 1.0).otherwise(0.0)).alias(f"acc_{t:g}") for t in km]
    return distances.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *hits)


def topk_recall(ranked: DataFrame, *, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """``ranked(subject_id, rank, canonical, gt)`` with rank from 1, slots not deduplicated."""
    first = F.min(F.when(F.col("canonical") == F.col("gt"), F.col("rank")))
    per = ranked.groupBy("subject_id").agg(first.alias("r"))
    return per.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks])


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", *, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The element at position n div 2 of the sorted non-null values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    ranked = running_sums(counted, keys, [value], {"__upto": F.col("count")}, group_rows=group_rows)
    sizes = ranked.groupBy(*keys).agg(F.max("__upto").alias("__n"))
    on = list(keys)
    both = ranked.join(sizes, on) if on else ranked.crossJoin(F.broadcast(sizes))  # a single row
    middle = F.floor(F.col("__n") / 2)
    hit = (F.col("__upto") - F.col("count") <= middle) & (middle < F.col("__upto"))
    return both.where(hit).select(*keys, F.col(value).alias(name))


def method_distance_table(subjects: DataFrame, results: DataFrame, methods: DataFrame, *, km=ACCURACY_KM) -> DataFrame:
    """Methods side by side: attempted, missing and un-geocodable counts, accuracies, upper median.

    ``results(subject_id, method, d)`` has at most one row per subject and
    method; a subject without one was not attempted. ``methods`` is a short
    list of names. Missing rows are counted, not made.
    """
    known = results.select("subject_id", "method", "d").join(subjects.select("subject_id"), "subject_id", "left_semi")
    hits = [F.avg(F.when(F.col("d") <= t, 1.0).otherwise(0.0)).alias(f"acc_{t:g}") for t in km]
    per = known.groupBy("method").agg(F.count(F.lit(1)).alias("n_attempted"), F.count_if(F.col("d").isNull()).alias("n_ungeocodable"), *hits)
    total = subjects.agg(F.count(F.lit(1)).alias("__all"))  # one row
    table = methods.select("method").join(per, "method", "left").crossJoin(F.broadcast(total))
    filled = table.na.fill(0, ["n_attempted", "n_ungeocodable"]).withColumn("n_missing", F.col("__all") - F.col("n_attempted"))
    columns = ["method", "n_attempted", "n_missing", "n_ungeocodable", *[f"acc_{t:g}" for t in km]]
    return filled.select(*columns).join(upper_median(known, ["method"], "d", "median_km"), "method", "left")


def reliability(conf: DataFrame) -> DataFrame:
    """Five bins [lo, hi), the last one closed. ``conf(conf, correct)``."""
    b = F.least(F.lit(4), F.floor(F.col("conf") * 5).cast("int"))
    return conf.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"))


def calibration(scored: DataFrame, *, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """NLL, multi-class Brier and ECE with bins (lo, hi].

    ``scored(keys..., p_true, brier, conf, correct)`` has one row per subject.
    """
    base = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(-F.log(F.greatest(F.col("p_true"), F.lit(1e-12)))).alias("nll"), F.avg("brier").alias("brier")
    )
    # Confidence 0 falls in no bin.
    b = (F.ceil(F.col("conf") * bins) - 1).cast("int")
    per = scored.where(F.col("conf") > 0).groupBy(*keys, b.alias("__b")).agg(
        F.count(F.lit(1)).alias("__c"), F.avg(F.col("correct").cast("double")).alias("__a"), F.avg("conf").alias("__m")
    )
    ece = per.groupBy(*keys).agg(F.sum(F.col("__c") * F.abs(F.col("__a") - F.col("__m"))).alias("__e"))
    both = base.join(ece, list(keys), "left") if keys else base.crossJoin(F.broadcast(ece))  # one row each
    return both.withColumn("ece", F.coalesce(F.col("__e"), F.lit(0.0)) / F.col("n")).drop("__e")


def score_beliefs(beliefs: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """(keys..., label/ord, p, truth) -> p_true, brier, conf, correct per key."""
    own = F.col("ord") == F.col("truth")
    best = F.max_by(F.struct("ord", "p"), F.struct(F.col("p"), -F.col("ord")))
    out = beliefs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(own, F.col("p"))), F.lit(1e-12)).alias("p_true"),
        F.sum(F.pow(F.col("p") - own.cast("double"), F.lit(2.0))).alias("brier"),
        best.alias("__b"),
        F.max("truth").alias("__t"),
    )
    return out.withColumns({"conf": F.col("__b.p"), "correct": F.col("__b.ord") == F.col("__t")}).drop("__b", "__t")


def grid_losses(beliefs: DataFrame, taus: Sequence[float], *, p: str = "p", truth: str = "truth") -> DataFrame:
    """(tau, n, nll): mean negative log-likelihood of the truth at every temperature, beliefs being read once.

    ``p`` is an array per belief and ``truth`` a position in it; a truth that is null or outside counts as 1e-12, as do
    smaller, null and missing probabilities. A kernel adds the losses of all temperatures up within its task, so one row
    per task and temperature is shuffled, and no belief is multiplied. Null arrays are left out; no beliefs give no rows.
    """
    grid = np.array(taus, float)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(grid))
        for batch in batches:
            lists, at = batch.column("p"), batch.column("t").fill_null(-1).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            n += len(sizes)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            known = (at >= 0) & (at < sizes)
            total += (~known).sum() * -np.log(1e-12)
            logs = np.log(np.fmax(lists.flatten().to_numpy(zero_copy_only=False).astype(float), 1e-12))
            filled = np.flatnonzero(sizes > 0)
            if not len(filled):
                continue
            top = np.maximum.reduceat(logs, starts[filled])
            shifted = logs - np.repeat(top, sizes[filled])
            hit = known[filled]
            own = shifted[(starts + np.where(known, at, 0))[filled[hit]]]
            for i, tau in enumerate(grid):
                mass = np.log(np.add.reduceat(np.exp(shifted / tau), starts[filled]))[hit]
                total[i] -= np.maximum(own / tau - mass, np.log(1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(grid), pa.array(np.full(len(grid), n)), pa.array(total)], names=["tau", "n", "total"])

    parts = beliefs.where(F.col(p).isNotNull()).select(F.col(p).alias("p"), F.col(truth).cast("bigint").alias("t"))
    sums = parts.mapInArrow(losses, "tau double, n bigint, total double").groupBy("tau").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.where(F.col("n") > 0).select("tau", "n", (F.col("total") / F.col("n")).alias("nll"))


def distinct_sketches(df: DataFrame, keys: Sequence[str], value: str, *, lg_k: int = 14) -> DataFrame:
    """(keys..., sketch): a HyperLogLog sketch of the non-null values per key, to be stored and united later.

    With 2^lg_k registers the standard error is about 0.8 % at 14. A sketch has a fixed size, so hot keys combine map-side.
    """
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def distinct_estimate(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., estimate): distinct values of all sketches of a key together; values that several hold count once."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def fit_temperature(nll: DataFrame) -> DataFrame:
    """(tau, nll) -> the tau with the least NLL, the first on ties."""
    return nll.agg(F.min_by("tau", F.struct("nll", "tau")).alias("tau"))


def describe(df: DataFrame, keys: Sequence[str], value: str, **size) -> DataFrame:
    aggs = [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"),
    ]
    return summarise(df, keys, aggs, {"median": (value, 0.5)}, **size)


def histogram(df: DataFrame, value: str | Column, lo: float, width: float, bins: int) -> DataFrame:
    """Counts for every bin, empty ones included; the last bin is closed, values outside are left out."""
    x = F.col(value) if isinstance(value, str) else value
    data = df.select(x.alias("__x")).where((F.col("__x") >= lo) & (F.col("__x") <= lo + width * bins))
    b = F.least(F.lit(bins - 1), F.floor((F.col("__x") - lo) / width)).cast("int")
    counts = data.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def terms(df: DataFrame, text: str, *, stop=CUE_STOP_WORDS, min_length: int = 3, top: int | None = 15) -> DataFrame:
    """Most frequent lower-case words of a text column."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    kept = words.where((F.length("term") >= min_length) & ~F.col("term").isin(*stop))
    counts = kept.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.col("n").desc(), "term")
    return ordered.limit(top) if top else ordered


def worst_risk(df: DataFrame, *, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    rank = F.when(F.col("risk") == "high", 3).when(F.col("risk") == "medium", 2).when(F.col("risk") == "low", 1).otherwise(0)
    return df.groupBy(*keys).agg(F.max_by("risk", rank).alias("risk"))


def confidence_level(confidence: str) -> Column:
    """Confidence given in words: high, medium or low, whatever the case and blanks; anything else is other."""
    word = F.lower(F.trim(confidence))
    return F.when(word.isin("high", "medium", "low"), word).otherwise("other")

"""Comparisons over repeated runs, methods and merge radii, as plain table-to-table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .beliefs import entropy
from .geometry import Geometry
from .leakage import mpl

NO_NOISE = 1e-9  # fixed value: stands for a floor of zero in the ratio


def noise_floor(runs: DataFrame, geometry: Geometry) -> DataFrame:
    """Leakage between repeated runs of one condition against leakage between conditions.

    ``runs(subject_id, cond, run, p)`` holds the beliefs of a few repeated runs in the conditions 'full' and 'masked', in
    gallery order. Returns subject_id, noise_floor (the largest leakage between runs of one condition, null without a
    pair), signal_median, snr and share_above. A floor of zero counts as 1e-9 in the ratio.
    """
    # A subject has a handful of runs: they are paired inside one row instead of by a self join.
    per = runs.groupBy("subject_id").agg(F.collect_list(F.struct("cond", "run", "p")).alias("runs"))
    a, z = F.col("a"), F.col("z")
    pairs = per.select("subject_id", "runs", F.explode("runs").alias("a")).select("subject_id", "a", F.explode("runs").alias("z")).where(
        ((a.cond == z.cond) & (a.run < z.run)) | ((a.cond == "masked") & (z.cond == "full"))
    )
    x = mpl(pairs, geometry, prior=F.col("a.p"), post=F.col("z.p")).select("subject_id", (a.cond == z.cond).alias("noise"), F.col("leak.mean").alias("x"))
    own = W.partitionBy("subject_id")  # the squares of a handful
    x = x.withColumn("floor", F.max(F.when(F.col("noise"), F.col("x"))).over(own)).where(~F.col("noise"))
    out = x.groupBy("subject_id").agg(F.max("floor").alias("noise_floor"), F.percentile("x", F.lit(0.5)).alias("signal_median"), F.avg((F.col("x") > F.col("floor")).cast("double")).alias("share_above"))
    floor = F.when(F.col("noise_floor") > 0, F.col("noise_floor")).otherwise(F.lit(NO_NOISE))
    return out.select("subject_id", "noise_floor", "signal_median", (F.col("signal_median") / floor).alias("snr"), "share_above")


def competitive_subset(beliefs: DataFrame, *, size: int = 5) -> DataFrame:
    """The true label and the ``size`` - 1 strongest others of ``beliefs(subject_id, truth, ord, label, p)``, with rank from 0."""
    order = W.partitionBy("subject_id").orderBy((F.col("ord") != F.col("truth")).cast("int"), F.col("p").desc(), "ord")
    return beliefs.select("subject_id", "label", (F.row_number().over(order) - 1).alias("rank")).where(F.col("rank") < size)


def method_effects(rows: DataFrame, *, keys: Sequence[str] = ("method", "subject_id")) -> DataFrame:
    """Per method and subject: concentration of the full belief, total variation and change of the log odds of the truth
    against its strongest rival when all cues are masked. ``rows(keys, truth, ord, pf, pm, mpl)`` has one row a label."""
    own = F.col("ord") == F.col("truth")
    per = rows.groupBy(*keys).agg(
        F.max("mpl").alias("mpl"),
        (1.0 + F.sum(F.col("pf") * F.log2(F.col("pf") + 1e-12)) / F.log2(F.count(F.lit(1)))).alias("conc"),
        (0.5 * F.sum(F.abs(F.col("pf") - F.col("pm")))).alias("tv"),
        F.max(F.when(own, F.struct("pf", "pm"))).alias("t"),
        F.max_by(F.struct("pf", "pm"), F.when(~own, F.struct(F.col("pf"), -F.col("ord")))).alias("d"),
    )
    return per.withColumn("dlo", F.log(F.col("t.pm") / F.col("d.pm")) - F.log(F.col("t.pf") / F.col("d.pf")))


def entropy_drops(beliefs: DataFrame, reps: DataFrame) -> DataFrame:
    """Entropy of the masked minus that of the full belief after merging, by merge radius: km, n_clusters, drop, n.

    ``beliefs(subject_id, label, p, full)``, ``reps(km, label, rep)`` with one row per radius and gallery label.
    """
    merged = beliefs.join(F.broadcast(reps), "label").groupBy("km", "subject_id", "rep").agg(F.sum("p").alias("p"), F.sum("full").alias("full"))
    per = merged.groupBy("km", "subject_id").agg((entropy("p") - entropy("full")).alias("drop"), F.count(F.lit(1)).alias("k"))
    return per.groupBy("km").agg(F.max("k").alias("n_clusters"), F.avg("drop").alias("drop"), F.count(F.lit(1)).alias("n"))

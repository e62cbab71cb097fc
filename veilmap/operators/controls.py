"""Real cue effects against equal-area controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import summarise


def control_table(real: DataFrame, controls: DataFrame) -> DataFrame:
    """Per cue: its value, mean and maximum of its controls, ratio, resolvable flag.

    ``real(subject_id, cue_idx, category, v)``, ``controls(subject_id, cue_idx, placement, mpl)``.
    """
    per = controls.groupBy("subject_id", "cue_idx").agg(
        F.round(F.avg("mpl"), 9).alias("c_mean"), F.max("mpl").alias("c_max"), F.count(F.lit(1)).alias("n_controls")
    )
    return real.join(per, ["subject_id", "cue_idx"]).withColumns({
        "ratio": F.col("v") / F.greatest(F.col("c_mean"), F.lit(1e-9)),
        "above_mean": F.col("v") > F.col("c_mean"),
        "resolvable": F.col("v") > F.col("c_max"),
        "net": F.col("v") - F.col("c_mean"),
    })


def net_class(margin: float = 0.01):
    return F.when(F.col("net") > margin, "above").when(F.col("net") < -margin, "below").otherwise("level")


def artifact_floor(controls: DataFrame, **size) -> DataFrame:
    """Median, 90th percentile and maximum over all placements."""
    return summarise(controls, [], [F.count("mpl").alias("n"), F.max("mpl").alias("max")], {"median": ("mpl", 0.5), "p90": ("mpl", 0.9)}, **size)


def resolvability(table: DataFrame, *, min_size: int = 1) -> DataFrame:
    """Share of resolvable cues per category; a missing category is 'unknown'."""
    out = table.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("resolvable").cast("double")).alias("share")
    )
    return out.where(F.col("n") >= min_size)


def subject_constant(controls: DataFrame) -> DataFrame:
    return controls.groupBy("subject_id").agg(F.avg("mpl").alias("c_img"))


def corrected_shapley(phi: DataFrame, controls: DataFrame) -> DataFrame:
    """phi' = phi - c_img / m for subjects that have controls."""
    return phi.join(subject_constant(controls), "subject_id").withColumn("phi_corrected", F.col("phi") - F.col("c_img") / F.col("m"))


def corrected_categories(corrected: DataFrame, **size) -> DataFrame:
    named = corrected.withColumn("category", F.coalesce("category", F.lit("unknown")))
    return summarise(
        named, ["category"],
        [F.count(F.lit(1)).alias("n"), F.count_if(F.col("phi_corrected") < -0.01).alias("n_negative")],
        {"phi_median": ("phi", 0.5), "corrected_median": ("phi_corrected", 0.5)},
        **size,
    )

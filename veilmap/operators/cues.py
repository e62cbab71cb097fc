"""Rules over nested cue annotations: one row per cue with its instances as an array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import row_numbers


def flag_degenerate(cues: DataFrame, *, max_ratio: float = 0.4) -> DataFrame:
    """Marks instances whose box covers more than ``max_ratio`` of the image;
    a cue is degenerate when it has instances and all of them are.

    ``instances: array<struct<bbox array<double> (x1, y1, x2, y2), ...>>``, image size ``w``, ``h``.
    """
    size = F.col("w") * F.col("h")

    def mark(i):
        b = i["bbox"]
        share = (b[2] - b[0]) * (b[3] - b[1]) / size
        return i.withField("degenerate", share > max_ratio)

    marked = cues.withColumn("instances", F.transform("instances", mark))
    return marked.withColumn("degenerate", (F.size("instances") > 0) & F.forall("instances", lambda i: i["degenerate"]))


def assign_maskable(cues: DataFrame) -> DataFrame:
    """Maskable iff some instance is not degenerate; the reported flag moves to ``maskable_llm``."""
    good = F.exists("instances", lambda i: ~F.coalesce(i["degenerate"], F.lit(False)))
    out = cues.withColumnRenamed("maskable", "maskable_llm") if "maskable" in cues.columns else cues
    return out.withColumn("maskable", good)


def maskable_cues(cues: DataFrame, order: list[str], *, mask: str = "mask", **kw) -> DataFrame:
    """Maskable cues with at least one usable masked instance, re-indexed from 0 in annotation order."""
    usable = F.exists("instances", lambda i: ~F.coalesce(i["degenerate"], F.lit(False)) & i[mask].isNotNull())
    kept = cues.where(F.col("maskable") & usable)
    return row_numbers(kept, ["subject_id"], order, "__rn", **kw).withColumn("cue_idx", F.col("__rn") - 1).drop("__rn")


def localization_outcome(cues: DataFrame) -> DataFrame:
    good = F.size(F.filter("instances", lambda i: ~F.coalesce(i["degenerate"], F.lit(False))))
    outcome = F.when(F.size("instances") == 0, "Not localized").when(good == 0, "Degenerate").otherwise("Localized")
    return cues.withColumns({"n_mask": good, "outcome": outcome})

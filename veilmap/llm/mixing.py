"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash. A source's budget is met by all documents whose hash lies below the source's
threshold, so that a larger budget always holds the documents of a smaller one. The threshold is found without sorting:
words are summed by (source, hash bucket), the running sum shows the bucket in which the budget ends, and only the
documents of that one bucket are summed again by finer buckets, until the bucket is one hash value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scale import row_numbers
from .common import WORD, join_small, stored

HASH_BITS = 60
LEVEL_BITS = 12


def n_words(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(*parts: Column) -> Column:
    """A document's fixed place in [0, 2^60)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - HASH_BITS)


def targets(sources: DataFrame, *, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Words each source should give: (source, source_size) -> adds weight, target.

    Sources in code point order, null last, take the weights in turn. Together they get ``share`` of all words; none
    gets more than ``most`` times its own, and what is cut off is shared again by weight among the others.
    Every round is one aggregate over the sources; the level only rises, so that the rounds end.
    """
    ordered = sources.withColumn("__last", F.col("source").isNull().cast("int"))
    ranked = row_numbers(ordered, [], ["__last", "source"], "__rank", group_rows=0, at_most=1).drop("__last")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight.cast("double")).drop("__rank"), "mix-sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while total and level > before:
        before = level
        full = F.col("weight") * F.lit(level) >= cap
        capped, free = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            level = float("inf")
            break
        level = max(level, (share * total - (capped or 0.0)) / free)
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if level != float("inf") else cap)


def thresholds(sized: DataFrame, wanted: DataFrame, *, level_bits: int = LEVEL_BITS) -> DataFrame:
    """Per source: ``passes`` whole passes, and the hash ``cut`` below which documents are taken once more.

    ``sized`` has source, size and place. The document (or the documents of one hash) at which the budget ends is
    taken if that brings the source nearer to its target.
    """
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("bigint")
    bounds = wanted.withColumn("passes", passes).withColumns({
        "left": F.when(size > 0, F.col("target") - F.col("passes") * size).otherwise(0.0),
        "low": F.lit(0).cast("bigint"), "bits": F.lit(HASH_BITS), "words": F.lit(0).cast("bigint"), "docs": F.lit(2).cast("bigint"),
    })
    bounds = stored(bounds, "mix-bounds")
    shift = HASH_BITS
    while shift > 0:
        width, shift = shift, max(0, shift - level_bits)
        open_ = bounds.where((F.col("docs") > 1) & (F.col("left") > 0)).select("source", "low", "left")
        # Only the documents of each source's boundary bucket.
        near = join_small(sized.where(F.col("size") > 0).select("source", "size", "place"), open_, "source")
        near = near.where(F.shiftrightunsigned("place", width) == F.shiftrightunsigned("low", width))
        cell = F.shiftleft(F.shiftrightunsigned("place", shift), shift)
        cells = near.groupBy("source", cell.alias("cell"), "left").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("w").over(W.partitionBy("source").orderBy("cell"))
        ends = cells.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("w") < F.col("left")))
        ends = ends.select(F.col("source").alias("__s"), "cell", "w", "n", (F.col("left") - F.col("upto") + F.col("w")).alias("rest"))
        bounds = bounds.join(ends, F.col("source").eqNullSafe(F.col("__s")), "left").select(
            *wanted.columns, "passes", F.coalesce("rest", "left").alias("left"), F.coalesce("cell", "low").alias("low"),
            F.when(F.col("cell").isNull(), F.col("bits")).otherwise(F.lit(shift)).alias("bits"),
            F.coalesce("w", "words").alias("words"), F.coalesce("n", "docs").alias("docs"),
        )
        bounds = stored(bounds, "mix-bounds")
        if not bounds.where((F.col("docs") > 1) & (F.col("left") > 0)).limit(1).count():
            break
    whole = (F.col("left") > 0) & (F.col("left") * 2 >= F.col("words"))
    cut = F.col("low") + F.when(whole, F.expr("shiftleft(1L, bits)")).otherwise(F.lit(0).cast("bigint"))
    return bounds.select("source", "source_size", "target", "passes", cut.alias("cut"))


def mix_plan(sized: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, level_bits: int = LEVEL_BITS) -> DataFrame:
    """(source, source_size, target, passes, cut) for a table of source, size and place."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(sized, targets(sources, weights=weights, share=share, most=most).drop("weight"), level_bits=level_bits)


def copies() -> Column:
    return F.col("passes") + (F.col("place") < F.col("cut")).cast("bigint")


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, place) of every row, written once so that the rounds do not read the texts again."""
    at = place(F.col(id_col).cast("string"), F.col(text_col))
    return stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), at.alias("place")), "mix-sized")


def mix(docs: DataFrame, **options) -> DataFrame:
    """How many words of each document the mix takes: id, source, size, source_size, target, copies, taken.

    A document is taken 0, 1 or 2 times as a whole (with ``most`` = 2). Null and empty texts have size 0 and take part
    with nothing; a null source is a source of its own and comes last; repeated rows (same id and text) share one hash
    and go in or out together. An empty table gives an empty mix.
    """
    names = {k: options.pop(k) for k in ("id_col", "text_col", "source_col") if k in options}
    sized = measured(docs, **names)
    out = join_small(sized, mix_plan(sized, **options), "source")
    return out.withColumn("copies", copies()).select("id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, a document taken twice as two rows; all columns stay.

    Documents without words take no budget and stay once.
    """
    plan = mix_plan(measured(docs, id_col=id_col, text_col=text_col, source_col=source_col), **options)
    plan = plan.select(F.col("source").alias("__source"), F.col("passes").alias("__passes"), F.col("cut").alias("__cut"))
    rows = docs.withColumns({"__source": F.col(source_col), "__place": place(F.col(id_col).cast("string"), F.col(text_col)), "__empty": n_words(F.col(text_col)) == 0})
    rows = join_small(rows, plan, "__source")
    times = F.when(F.col("__empty"), 1).otherwise(F.col("__passes") + (F.col("__place") < F.col("__cut")).cast("bigint"))
    rows = rows.withColumn("__times", times.cast("int")).where(F.col("__times") > 0)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])

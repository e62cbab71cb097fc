"""Table functions for SQL text: cue subsets and mask runs. The native forms (``lattice``, ``masks``) stay the faster ones."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, IntegralType, LongType, NullType, StructType


def _whole(name: str, argument) -> None:
    if not isinstance(argument.dataType, (IntegralType, NullType)):
        raise ValueError(f"{name} must be a whole number, not {argument.dataType.simpleString()}")


class SubsetMasks:
    """``subset_masks(m, max_full)``: (position, mask) by size, then by cue numbers.

    Up to ``max_full`` cues all non-empty subsets, else singles, leave-one-out sets and the full set. No rows for a null or
    less than 1; above 62 cues a mask does not fit and it is an error.
    """

    @staticmethod
    def analyze(m, max_full):
        from pyspark.sql.udtf import AnalyzeResult

        _whole("m", m)
        _whole("max_full", max_full)
        return AnalyzeResult(StructType().add("position", IntegerType()).add("mask", LongType()))

    def eval(self, m, max_full):
        if m is None or m < 1:
            return
        if m > 62:
            raise ValueError(f"{m} cues do not fit in a mask")
        full = (1 << m) - 1
        if max_full is not None and m <= max_full:
            masks = range(1, full + 1)
        else:
            masks = {full, *(1 << k for k in range(m)), *(full ^ 1 << k for k in range(m))} - {0}
        cues = lambda mask: [k for k in range(m) if mask >> k & 1]
        yield from enumerate(sorted(masks, key=lambda mask: (mask.bit_count(), cues(mask))), 1)


class MaskRows:
    """``mask_rows(counts, h, w)``: row runs (y, x1, x2) of run-length counts, the first run being off.

    Runs are cut at the end of the frame; a null argument or element or a frame without pixels gives no rows.
    """

    @staticmethod
    def analyze(counts, h, w):
        from pyspark.sql.udtf import AnalyzeResult

        kind = counts.dataType
        if not isinstance(kind, NullType) and not (isinstance(kind, ArrayType) and isinstance(kind.elementType, (IntegralType, NullType))):
            raise ValueError(f"counts must be an array of whole numbers, not {kind.simpleString()}")
        _whole("h", h)
        _whole("w", w)
        return AnalyzeResult(StructType().add("y", LongType()).add("x1", LongType()).add("x2", LongType()))

    def eval(self, counts, h, w):
        if counts is None or h is None or w is None or h < 1 or w < 1 or any(n is None for n in counts):
            return
        end = 0
        for i, n in enumerate(counts):
            start, end = end, end + int(n)
            if i % 2:
                at, stop = start, min(end, h * w)
                while at < stop:
                    y = at // w
                    upto = min(stop, (y + 1) * w)
                    yield y, at - y * w, upto - y * w
                    at = upto


def register(spark: SparkSession) -> None:
    """Make ``subset_masks`` and ``mask_rows`` known to SQL. ``mask_rows`` gives few rows a call, for which an Arrow batch a call costs more than it saves."""
    spark.udtf.register("subset_masks", udtf(SubsetMasks, useArrow=True))
    spark.udtf.register("mask_rows", udtf(MaskRows, useArrow=False))

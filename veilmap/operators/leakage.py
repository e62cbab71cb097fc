"""Distance-normalised posterior leakage (mPL).

The candidate pairs of one belief are a fixed set of at most a few thousand
labels squared, so they are never emitted as rows by default: an Arrow kernel
works through them per batch of beliefs. The relational form says the same in
joins and is kept for small galleries and as a check.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import Geometry
from .scale import broadcast_within

KERNEL_VALUES = 1 << 20
RESULT = "struct<mean:double,sup:double,i:int,j:int,n_pairs:bigint>"


def log_shift(prior: DataFrame, post: DataFrame, *, keys=("subject_id", "mask"), post_keys=("subject_id",)) -> DataFrame:
    """ln(post / prior) per label, where both sides have mass."""
    a = prior.select(*keys, "label", "ord", F.col("p").alias("__a"))
    b = post.select(*post_keys, "label", F.col("p").alias("__b"))
    both = a.join(b, [*post_keys, "label"]).where((F.col("__a") > 0) & (F.col("__b") > 0))
    return both.select(*keys, "label", "ord", F.log(F.col("__b") / F.col("__a")).alias("llr"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def pair_kernel(geometry: Geometry, tau: float | None = None):
    """Arrow UDF over two belief arrays in gallery order -> mean, sup and its pair.

    mean is in nats per 1000 km (0 without a valid pair), sup in nats per km
    (null without one). With ``tau`` only clusters with mass ``tau`` on either
    side count, and both sides are raised to ``tau`` before the ratio.
    """
    member, inverse = geometry.member, geometry.inverse_km
    merge = member.shape[0] != member.shape[1] or not np.array_equal(member, np.eye(member.shape[0]))
    width, k = member.shape
    step = max(1, KERNEL_VALUES // max(width, 1))  # rows at a time, so that the temporaries stay small whatever the gallery
    empty = pa.struct([("mean", pa.float64()), ("sup", pa.float64()), ("i", pa.int32()), ("j", pa.int32()), ("n_pairs", pa.int64())])

    @F.arrow_udf(RESULT)
    def kernel(prior: pa.Array, post: pa.Array) -> pa.Array:
        parts = [work(prior.slice(at, step), post.slice(at, step)) for at in range(0, len(prior), step)]
        return pa.concat_arrays(parts) if parts else pa.array([], empty)

    def work(prior: pa.Array, post: pa.Array) -> pa.StructArray:
        a, b = _matrix(prior, width), _matrix(post, width)
        if merge:
            a, b = a @ member, b @ member
        if tau is None:
            keep = (a > 0) & (b > 0)
        else:
            keep = np.maximum(a, b) >= tau
            a, b = np.maximum(a, tau), np.maximum(b, tau)
        shift = np.log(np.where(keep, b, 1.0) / np.where(keep, a, 1.0))
        n = len(shift)
        total, count = np.zeros(n), np.zeros(n, dtype=np.int64)
        best, bi, bj = np.full(n, -1.0), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        rows = np.arange(n)
        for i in range(k - 1):
            scale = inverse[i, i + 1 :]
            valid = keep[:, i : i + 1] & keep[:, i + 1 :] & (scale > 0)
            value = np.where(valid, np.abs(shift[:, i : i + 1] - shift[:, i + 1 :]) * scale, -1.0)
            total += np.where(valid, value, 0.0).sum(axis=1)
            count += valid.sum(axis=1)
            top = value.argmax(axis=1)
            peak = value[rows, top]
            better = peak > best
            best = np.where(better, peak, best)
            bi = np.where(better, i, bi).astype(np.int32)
            bj = np.where(better, i + 1 + top, bj).astype(np.int32)
        none = count == 0
        mean = np.where(none, 0.0, total / np.maximum(count, 1) * 1000.0)
        return pa.StructArray.from_arrays(
            [pa.array(mean), pa.array(best, mask=none), pa.array(bi, mask=none), pa.array(bj, mask=none), pa.array(count)],
            names=["mean", "sup", "i", "j", "n_pairs"],
        )

    return kernel


def mpl(wide: DataFrame, geometry: Geometry, *, prior: str | Column = "p", post: str | Column = "full", tau: float | None = None, name: str = "leak") -> DataFrame:
    """Adds the kernel result; no shuffle, the rows stay where they are."""
    return wide.withColumn(name, pair_kernel(geometry, tau)(prior, post))


def mpl_relational(shift: DataFrame, pairs: DataFrame, *, keys=("subject_id", "mask"), all_keys: DataFrame | None = None) -> DataFrame:
    """The same from long log shifts and a pairs table (small galleries)."""
    a = shift.select(*keys, F.col("ord").alias("i"), F.col("llr").alias("__a"))
    b = shift.select(*keys, F.col("ord").alias("j"), F.col("llr").alias("__b"))
    value = F.abs(F.col("__a") - F.col("__b")) / F.col("d")
    valued = a.join(broadcast_within(pairs), "i").join(b, [*keys, "j"]).withColumn("__v", value)
    out = valued.groupBy(*keys).agg(
        (F.avg("__v") * 1000.0).alias("mean"),
        F.max("__v").alias("sup"),
        F.max_by(F.struct("i", "j"), F.struct(F.col("__v"), -F.col("i"), -F.col("j"))).alias("at"),
        F.count(F.lit(1)).alias("n_pairs"),
    )
    if all_keys is not None:
        out = all_keys.select(*keys).join(out, list(keys), "left")
    return out.select(
        *keys, F.coalesce("mean", F.lit(0.0)).alias("mean"), "sup",
        F.col("at.i").alias("i"), F.col("at.j").alias("j"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
    )

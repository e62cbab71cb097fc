"""Cue subsets as bit masks, and attribution over the subset lattice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import full_mask, has_bit

MAX_CUES = 20  # 2^20 subsets a subject; factorial() is exact up to 20


def _bit(k) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(k) if isinstance(k, str) else k).cast("int"))


def subset_masks(m: str = "m", max_full: int = 6) -> Column:
    """Masks to evaluate: all non-empty subsets up to ``max_full`` cues, else
    singles, leave-one-out sets and the full set."""
    n = F.col(m).cast("int")
    full = full_mask(m)
    cues = F.sequence(F.lit(0), n - 1)
    singles = F.transform(cues, _bit)
    without = F.transform(cues, lambda k: full.bitwiseXOR(_bit(k)))
    some = F.array_distinct(F.concat(singles, without, F.array(full)))
    everything = F.sequence(F.lit(1).cast("bigint"), F.when(n <= max_full, full).otherwise(F.lit(1).cast("bigint")))
    return F.when(n <= max_full, everything).otherwise(some)


def expand_subsets(cue_counts: DataFrame, *, max_full: int = 6) -> DataFrame:
    """(subject_id, m) -> (subject_id, m, mask); subjects without cues have no subsets."""
    counted = cue_counts.where(F.col("m") >= 1)
    return counted.select("subject_id", "m", F.explode(subset_masks("m", max_full)).alias("mask"))


def missing_subsets(cue_counts: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intermediate subsets, 2 <= size <= m - 1, that are not in ``done(subject_id, mask)``; subjects of too many cues).

    The subsets of more than ``MAX_CUES`` cues are not listed; those subjects come back as (subject_id, m).
    """
    unlisted = cue_counts.where(F.col("m") > MAX_CUES).select("subject_id", "m")
    wanted = cue_counts.where(F.col("m").between(3, MAX_CUES)).select(
        "subject_id", "m", F.explode(F.sequence(F.lit(1).cast("bigint"), full_mask("m"))).alias("mask")
    )
    wanted = wanted.where((F.bit_count("mask") >= 2) & (F.bit_count("mask") < F.col("m")))
    return wanted.join(done.select("subject_id", "mask"), ["subject_id", "mask"], "left_anti"), unlisted


def gap_counts(cue_counts: DataFrame, done: DataFrame) -> DataFrame:
    """(subject_id, m, n_gaps): how many intermediate subsets are not in ``done(subject_id, mask)``, for every number of cues.

    Nothing is listed: of the 2^m - 2 - m intermediate subsets those in ``done`` are taken off, so there is no largest m
    of ``missing_subsets`` here. Above 62 cues the number does not fit and is null.
    """
    full = full_mask("m")
    scored = done.select("subject_id", "mask").join(cue_counts.select("subject_id", "m"), "subject_id")
    scored = scored.where(F.col("mask").between(1, full) & (F.bit_count("mask") >= 2) & (F.bit_count("mask") < F.col("m")))
    scored = scored.select("subject_id", "m", "mask").distinct().groupBy("subject_id", "m").agg(F.count(F.lit(1)).alias("n_done"))
    inner = F.when(F.col("m") < 3, 0).when(F.col("m") <= 62, full - 1 - F.col("m"))
    return cue_counts.join(scored, ["subject_id", "m"], "left").select(
        "subject_id", "m", (inner - F.coalesce("n_done", F.lit(0))).cast("bigint").alias("n_gaps")
    )


def build_lattice(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete lattices with v(empty) = 0, and the subjects left out as incomplete.

    ``values(subject_id, m, mask, v)`` may come from several sources; a mask
    given twice counts once.
    """
    known = values.where(F.col("mask") > 0).groupBy("subject_id", "m", "mask").agg(F.max("v").alias("v"))
    # The number of masks per subject is at most 2^m, so this stays a small group.
    need = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("m").cast("int")) - 1
    counts = known.groupBy("subject_id", "m").agg(F.count(F.lit(1)).alias("n"))
    complete = counts.where(F.col("n") == need).select("subject_id", "m")
    skipped = counts.where(F.col("n") != need).select("subject_id", "m", "n")
    kept = known.join(complete, ["subject_id", "m"], "left_semi")
    empty = complete.select("subject_id", "m", F.lit(0).cast("bigint").alias("mask"), F.lit(0.0).alias("v"))
    return kept.unionByName(empty), skipped


def _fact(c: Column) -> Column:
    return F.factorial(c.cast("int")).cast("double")


def shapley(lattice: DataFrame, *, value: str = "v", carry: Sequence[str] = ()) -> DataFrame:
    """Exact Shapley value per cue as one signed, weighted sum over the masks.

    v(empty) need not be 0. ``v_all`` is v(N), ``v_single`` the value of the
    cue alone. ``carry`` names columns that are constant per subject.
    """
    each = lattice.select("subject_id", "m", "mask", value, *carry, F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("k"))
    inside = has_bit("mask", "k")
    size = F.bit_count("mask") - inside.cast("int")
    weight = _fact(size) * _fact(F.col("m") - size - 1) / _fact(F.col("m"))
    signed = F.when(inside, F.col(value)).otherwise(-F.col(value))
    return each.groupBy("subject_id", "m", "k").agg(
        F.sum(signed * weight).alias("phi"),
        F.max(F.when(F.col("mask") == full_mask("m"), F.col(value))).alias("v_all"),
        F.max(F.when(F.col("mask") == _bit("k"), F.col(value))).alias("v_single"),
        *[F.max(c).alias(c) for c in carry],
    )


def _cue_pairs(lattice: DataFrame, value: str) -> DataFrame:
    cues = F.sequence(F.lit(0), F.col("m").cast("int") - 1)
    with_k = lattice.where(F.col("m") >= 2).select("subject_id", "m", "mask", value, F.explode(cues).alias("k"))
    later = F.filter(cues, lambda x: x > F.col("k"))
    return with_k.select("subject_id", "m", "mask", value, "k", F.explode(later).alias("l"))


def interactions(lattice: DataFrame, *, value: str = "v") -> DataFrame:
    """Shapley interaction index and the empty-context interaction per cue pair."""
    each = _cue_pairs(lattice, value)
    in_k, in_l = has_bit("mask", "k").cast("int"), has_bit("mask", "l").cast("int")
    size = F.bit_count("mask") - in_k - in_l
    weight = _fact(size) * _fact(F.col("m") - size - 2) / _fact(F.col("m") - 1)
    signed = F.when(in_k + in_l == 1, -F.col(value)).otherwise(F.col(value))
    only = (size == 0) & (in_k + in_l > 0)
    empty = F.when(only, F.when(in_k + in_l == 2, F.col(value)).otherwise(-F.col(value))).otherwise(0.0)
    return each.groupBy("subject_id", "m", "k", "l").agg(F.sum(signed * weight).alias("sii"), F.sum(empty).alias("i_empty"))


def dividends(v: np.ndarray) -> np.ndarray:
    """Moebius transform of a game's values by mask: what each set of cues adds beyond all its subsets, in m * 2^m steps."""
    a = v.astype(float).copy()
    for b in range(len(a).bit_length() - 1):
        halves = a.reshape(-1, 2, 1 << b)
        halves[:, 1] -= halves[:, 0]
    return a


def interactions_by_dividends(lattice: DataFrame, *, value: str = "v") -> DataFrame:
    """As ``interactions``, for complete lattices of up to ``MAX_CUES`` cues: no row per pair and mask.

    A pair's index is the sum of the dividends of all sets that hold both cues, each over its size less one. A group is one
    subject's lattice, 2^m values. A mask that is missing counts as 0; larger subjects are an error.
    """
    kind = lattice.schema["subject_id"].dataType.simpleString()
    most = MAX_CUES

    def run(key: tuple, group: pa.Table) -> pa.Table:
        m = int(key[1].as_py())
        if m > most:
            raise ValueError(f"lattices of at most {most} cues are worked out whole")
        v = np.zeros(1 << m)
        v[group.column("mask").to_numpy()] = group.column("v").to_numpy()
        a = dividends(v)
        share = a / np.maximum(np.bitwise_count(np.arange(1 << m)).astype(int) - 1, 1)
        pairs = [(k, x) for k in range(m) for x in range(k + 1, m)]
        both = [share.reshape(-1, 2, 1 << (x - k - 1), 2, 1 << k)[:, 1, :, 1].sum() for k, x in pairs]
        empty = [a[1 << k | 1 << x] - v[0] for k, x in pairs]
        n = len(pairs)
        return pa.table({"subject_id": pa.array([key[0].as_py()] * n, group.schema.field("subject_id").type), "m": pa.array([m] * n, pa.int64()), "k": pa.array([k for k, _ in pairs], pa.int32()), "l": pa.array([x for _, x in pairs], pa.int32()), "sii": pa.array(both, pa.float64()), "i_empty": pa.array(empty, pa.float64())})

    own = lattice.where(F.col("m") >= 2).select("subject_id", F.col("m").cast("bigint").alias("m"), "mask", F.col(value).cast("double").alias("v"))
    return own.groupBy("subject_id", "m").applyInArrow(run, f"subject_id {kind}, m bigint, k int, l int, sii double, i_empty double")


def pair_tags(lattice: DataFrame, *, value: str = "v") -> DataFrame:
    """synergy / redundant / additive from v(kl), v(k), v(l)."""
    each = _cue_pairs(lattice, value)
    at = lambda mask: F.max(F.when(F.col("mask") == mask, F.col(value)))
    wide = each.groupBy("subject_id", "m", "k", "l").agg(
        at(_bit("k").bitwiseOR(_bit("l"))).alias("v_kl"), at(_bit("k")).alias("v_k"), at(_bit("l")).alias("v_l")
    )
    tag = (
        F.when(F.col("v_kl") > F.col("v_k") + F.col("v_l") + 1e-6, "synergy")
        .when(F.col("v_kl") < F.greatest("v_k", "v_l") + 1e-9, "redundant")
        .otherwise("additive")
    )
    return wide.where(F.col("v_kl").isNotNull() & F.col("v_k").isNotNull() & F.col("v_l").isNotNull()).withColumn("tag", tag)


def two_cue_values(lattice: DataFrame, *, value: str = "v") -> DataFrame:
    """Closed form for two cues: half own value plus half of what is added last."""
    at = lambda mask: F.max(F.when(F.col("mask") == mask, F.col(value)))
    wide = lattice.where(F.col("m") == 2).groupBy("subject_id").agg(at(1).alias("v1"), at(2).alias("v2"), at(3).alias("v_all"))
    return wide.select(
        "subject_id",
        (0.5 * F.col("v1") + 0.5 * (F.col("v_all") - F.col("v2"))).alias("phi_0"),
        (0.5 * F.col("v2") + 0.5 * (F.col("v_all") - F.col("v1"))).alias("phi_1"),
        (F.col("v_all") - F.col("v1") - F.col("v2")).alias("interaction"),
    )


def visible_game(values: DataFrame) -> DataFrame:
    """Re-index a masked-subset game as a game of visible cues: mask -> N minus mask."""
    return values.withColumn("mask", full_mask("m").bitwiseXOR(F.col("mask")))


def interaction_class(x: str | Column, margin: float = 0.01) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x < -margin, "overlap").when(x > margin, "backup").otherwise("additive")

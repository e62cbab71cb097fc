"""Construction and algebra of belief distributions.

Long beliefs have one row per (keys..., label, ord) with probability ``p``;
``keys`` defaults to (subject_id, mask). A distribution is as long as the
gallery, so windows over ``keys`` stay small whatever the number of subjects.
Wide beliefs hold the same numbers as ``array<double>`` in gallery order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import clamp01, tidy_name
from ..functions.fixed_values import COUNTRY_ALIASES, LEVELS, PRIOR_TEMPERATURE, PRIOR_TRUNCATION, SCORE_SMOOTHING

KEYS = ("subject_id", "mask")


def _over(keys: Sequence[str]):
    return W.partitionBy(*keys)


def normalise(df: DataFrame, weight: str | Column, keys: Sequence[str] = KEYS, name: str = "p") -> DataFrame:
    """Divide by the group sum; a group without mass gets null."""
    w = weight if isinstance(weight, Column) else F.col(weight)
    df = df.withColumn("__w", w)
    total = F.sum("__w").over(_over(keys))
    return df.withColumn(name, F.when(total > 0, F.col("__w") / total)).drop("__w")


def prior(raw: DataFrame, *, keys=("subject_id",), tau_p: float = PRIOR_TRUNCATION, temperature: float = PRIOR_TEMPERATURE) -> DataFrame:
    """Clamp, truncate, softmax."""
    score = F.coalesce(clamp01("raw"), F.lit(0.0))
    return normalise(raw, F.exp(F.least(score, F.lit(tau_p)) / F.lit(temperature)), keys)


def score_normalise(raw: DataFrame, *, keys=("subject_id",), smoothing: float = SCORE_SMOOTHING, clamp: bool = True) -> DataFrame:
    """Share of the total (uniform without mass), mixed with uniform; a null score is 0."""
    score = F.coalesce(clamp01("raw") if clamp else F.col("raw"), F.lit(0.0))
    w = _over(keys)
    df = raw.withColumn("__s", score).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__t", F.sum("__s").over(w))
    base = F.when(F.col("__t") > 0, F.col("__s") / F.col("__t")).otherwise(1.0 / F.col("__n"))
    mixed = (1.0 - smoothing) * base + smoothing / F.col("__n")
    return normalise(df, mixed, keys).drop("__s", "__n", "__t")


def softmax(scores: DataFrame, score: str = "score", *, keys=KEYS, tau: float | Column = 1.0, name: str = "p") -> DataFrame:
    tau = tau if isinstance(tau, Column) else F.lit(float(tau))
    peak = F.max(score).over(_over(keys))
    return normalise(scores, F.exp((F.col(score) - peak) / tau), keys, name)


def temper(beliefs: DataFrame, *, keys=KEYS, tau: str | float = "tau", name: str = "p") -> DataFrame:
    """p ^ (1 / tau), renormalised; probabilities below 1e-12 count as 1e-12."""
    t = F.col(tau) if isinstance(tau, str) else F.lit(float(tau))
    logged = beliefs.withColumn("__l", F.log(F.greatest(F.col("p"), F.lit(1e-12))) / t)
    return softmax(logged, "__l", keys=keys, name=name).drop("__l")


def unsmooth(beliefs: DataFrame, *, keys=KEYS, smoothing: float = SCORE_SMOOTHING) -> DataFrame:
    """Undo the uniform mix; falls back to the belief itself when nothing is left."""
    w = _over(keys)
    n = F.count(F.lit(1)).over(w)
    df = beliefs.withColumn("__b", F.greatest(F.lit(0.0), (F.col("p") - smoothing / n) / (1 - smoothing)))
    total = F.sum("__b").over(w)
    return df.withColumn("p", F.when(total > 0, F.col("__b") / total).otherwise(F.col("p"))).drop("__b")


def power_rescale(base: DataFrame, *, keys=KEYS, beta: str = "beta", smoothing: float = SCORE_SMOOTHING) -> DataFrame:
    powered = base.withColumn("raw", F.pow("p", F.col(beta)))
    return score_normalise(powered, keys=keys, smoothing=smoothing, clamp=False).drop("raw")


def letter_belief(visible: DataFrame, options: DataFrame) -> DataFrame:
    """Multiple-choice beliefs from letter log-probabilities.

    ``visible(subject_id, perm, letter, logprob)`` lists the letters the model
    returned, ``options(subject_id, perm, letter, label, ord)`` what each letter
    stood for. A letter that was not returned sits 5 nats below the lowest one
    that was (-20 when there was none). Both sides meet in groups instead of a join, so that sides which lie by subject in the
    same tasks stay there.
    """
    per = ["subject_id", "perm"]
    on = [*per, "letter"]
    known = visible.dropna(subset=on).select(*on, F.lit(None).alias("__o"), F.struct("logprob").alias("__v"))
    offered = options.select(*on, F.struct("label", "ord").alias("__o"), F.lit(None).alias("__v"))
    met = offered.unionByName(known).groupBy(*on).agg(F.collect_list("__o").alias("__o"), F.collect_list("__v").alias("__v"))
    both = met.select(*on, F.explode("__o").alias("__o"), "__v").select(*on, "__o.*", F.explode_outer("__v").alias("__v")).select(*on, "label", "ord", "__v.logprob")
    floor = F.coalesce(F.min("logprob").over(_over(per)), F.lit(-15.0)) - 5.0
    soft = softmax(both.withColumn("__l", F.coalesce("logprob", floor)), "__l", keys=per)
    mean = soft.groupBy("subject_id", "label", "ord").agg(F.avg("p").alias("__p"))
    return normalise(mean, "__p", ["subject_id"]).drop("__p")


def merge(beliefs: DataFrame, clusters: DataFrame, *, keys=KEYS) -> DataFrame:
    """Sum the mass per cluster representative; a label without a cluster stands for itself."""
    # The cluster map has one row per gallery label; the caller decides whether it is broadcast.
    joined = beliefs.join(clusters.select("label", "rep"), "label", "left")
    rep = F.coalesce("rep", "label")
    return joined.groupBy(*keys, rep.alias("label")).agg(F.min("ord").alias("ord"), F.sum("p").alias("p"))


def map_estimate(beliefs: DataFrame, *, keys=KEYS) -> DataFrame:
    """Most probable label; ties go to the first in gallery order."""
    best = F.max_by(F.struct("label", "ord", "p"), F.struct(F.col("p"), -F.col("ord")))
    return beliefs.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.label", "b.ord", "b.p")


def to_wide(beliefs: DataFrame, *, keys=KEYS, value: str = "p", name: str = "p") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ord", value)))
    return beliefs.groupBy(*keys).agg(F.transform(ordered, lambda s: s[value]).alias(name))


def to_long(wide: DataFrame, gallery: DataFrame, *, keys=KEYS, arrays: Sequence[str] = ("p",)) -> DataFrame:
    """One row per label. The gallery carries ``pos``, its 0-based place in the arrays."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    long = wide.select(*keys, F.posexplode(zipped).alias("pos", "__z"))
    long = long.select(*keys, "pos", *[F.col(f"__z.{a}").alias(a) for a in arrays])
    return long.join(F.broadcast(gallery.select("pos", "ord", "label")), "pos").drop("pos")


# Divergences, one row per key.


def entropy(p: str | Column = "p") -> Column:
    """Aggregate: entropy in bits, zero terms skipped."""
    p = p if isinstance(p, Column) else F.col(p)
    return F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p))), F.lit(0.0))


def entropy_bits(beliefs: DataFrame, *, keys=KEYS) -> DataFrame:
    return beliefs.groupBy(*keys).agg(entropy().alias("entropy_bits"))


def concentration(n: int | Column, p: str = "p") -> Column:
    """Aggregate: 1 - H / log2 n with the small constant inside the logarithm."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    return 1.0 + F.sum(F.col(p) * F.log2(F.col(p) + F.lit(1e-12))) / F.log2(n)


def kl_to_uniform(n: int | Column, p: str = "p") -> Column:
    n = n if isinstance(n, Column) else F.lit(float(n))
    return F.coalesce(F.sum(F.when(F.col(p) > 0, F.col(p) * F.log2(F.col(p) * n))), F.lit(0.0))


def kl_bits(p: DataFrame, q: DataFrame, *, keys=("subject_id",)) -> DataFrame:
    """KL(p || q) and total variation; null KL when the supports differ or q has a hole."""
    a = p.select(*keys, "label", F.col("p").alias("__p"))
    b = q.select(*keys, "label", F.col("p").alias("__q"))
    both = a.join(b, [*keys, "label"], "full_outer")
    same = F.bool_and(F.col("__p").isNotNull() & F.col("__q").isNotNull())
    hole = F.bool_or((F.col("__p") > 0) & (F.coalesce("__q", F.lit(0.0)) <= 0))
    total = F.sum(F.when(F.col("__p") > 0, F.col("__p") * F.log2(F.col("__p") / F.col("__q"))).otherwise(0.0))
    tv = 0.5 * F.sum(F.abs(F.coalesce("__p", F.lit(0.0)) - F.coalesce("__q", F.lit(0.0))))
    return both.groupBy(*keys).agg(
        same.alias("same_support"),
        F.when(same & ~hole, total).alias("kl_bits"),
        tv.alias("tv"),
    )


def support_difference(have: DataFrame, want: DataFrame, *, keys=("subject_id",)) -> DataFrame:
    """Labels missing from and extra in ``have``, per key."""
    a = have.select(*keys, "label", F.lit(1).alias("__h")).distinct()
    b = want.select(*keys, "label", F.lit(1).alias("__w")).distinct()
    return (
        a.join(b, [*keys, "label"], "full_outer")
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("__h").isNull()).alias("n_missing"),
            F.count_if(F.col("__w").isNull()).alias("n_extra"),
        )
        .withColumn("same_support", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))
    )


def logodds_distractor(full: DataFrame, masked: DataFrame, truth: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Log-odds of the truth against the strongest other label of the full view.

    With ``clusters`` the distractor comes from outside the cluster of the
    truth. The distractor of the full view is reused for the masked view.
    """
    t = truth.select("subject_id", F.col("label").alias("truth"))
    f = full.select("subject_id", "label", "ord", F.col("p").alias("p_full")).join(t, "subject_id")
    m = masked.select("subject_id", "label", F.col("p").alias("p_masked"))
    rows = f.join(m, ["subject_id", "label"])
    if clusters is None:
        other = F.col("label") != F.col("truth")
    else:
        rows = rows.join(clusters.select("label", F.col("rep").alias("__r")), "label", "left")
        rows = rows.join(clusters.select(F.col("label").alias("truth"), F.col("rep").alias("__tr")), "truth", "left")
        other = F.coalesce("__r", "label") != F.coalesce("__tr", "truth")
    row = F.struct("label", "p_full", "p_masked")
    strength = F.struct(F.col("p_full"), -F.col("ord"))
    best = rows.groupBy("subject_id").agg(
        F.max(F.when(F.col("label") == F.col("truth"), F.struct("p_full", "p_masked"))).alias("t"),
        F.max_by(row, F.when(other, strength)).alias("d"),
    )
    return best.where(F.col("t").isNotNull() & F.col("d").isNotNull()).select(
        "subject_id",
        F.col("d.label").alias("distractor"),
        F.col("t.p_full").alias("p_true_full"),
        F.col("t.p_masked").alias("p_true_masked"),
        F.log(F.col("t.p_full") / F.col("d.p_full")).alias("logodds_full"),
        F.log(F.col("t.p_masked") / F.col("d.p_masked")).alias("logodds_masked"),
    )


def cross_entropy(p_true: str | Column) -> Column:
    p = p_true if isinstance(p_true, Column) else F.col(p_true)
    return -F.log(F.greatest(p, F.lit(1e-12)))


# Names.


def canonical_name(name: str | Column) -> Column:
    """Alias lookup on the tidied lower-case name; unknown names pass through tidied."""
    aliases = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES.items() for x in pair])
    tidy = tidy_name(name)
    return F.coalesce(F.try_element_at(aliases, F.lower(tidy)), tidy)


def canonical_country(df: DataFrame, name: str, out: str = "canonical") -> DataFrame:
    return df.withColumn(out, canonical_name(name))


def clean_candidates(df: DataFrame, *, level: str = "level", keys=("subject_id",)) -> DataFrame:
    """Trim, drop blanks, canonical names at country level; keep the highest
    confidence at the first position with the reason given first."""
    conf = F.coalesce(clamp01(F.col("confidence").try_cast("double")), F.lit(0.0))
    named = df.withColumn("__loc", F.trim("location")).where(F.col("__loc") != "")
    loc = F.when(F.col(level) == "country", canonical_name("__loc")).otherwise(F.col("__loc"))
    return named.groupBy(*keys, level, loc.alias("location")).agg(
        F.max(conf).alias("confidence"),
        F.min("ord").alias("ord"),
        F.min_by("reason", "ord").alias("reason"),
    )


def hierarchical_name(levels: DataFrame, stated: DataFrame | None = None, final: DataFrame | None = None) -> DataFrame:
    """Stated triple if there is one, else the best label per level (finest
    first), else the best final label. Input: (subject_id, level, label, ord, p)."""
    best = map_estimate(levels, keys=("subject_id", "level"))
    by_level = best.groupBy("subject_id").agg(
        *[F.max(F.when(F.col("level") == lv, F.col("label"))).alias(lv) for lv in LEVELS]
    )
    joined_levels = [F.nullif(F.col(lv), F.lit("")) for lv in reversed(LEVELS)]
    names = by_level.select("subject_id", F.concat_ws(", ", *joined_levels).alias("__lv"))
    if stated is not None:
        s = stated.select("subject_id", F.concat_ws(", ", *[F.nullif(F.col(lv), F.lit("")) for lv in reversed(LEVELS)]).alias("__st"))
        names = names.join(s, "subject_id", "full_outer")
    else:
        names = names.withColumn("__st", F.lit(None).cast("string"))
    if final is not None:
        f = map_estimate(final, keys=("subject_id",)).select("subject_id", F.col("label").alias("__fi"))
        names = names.join(f, "subject_id", "full_outer")
    else:
        names = names.withColumn("__fi", F.lit(None).cast("string"))
    return names.select("subject_id", F.coalesce("__st", "__lv", "__fi", F.lit("")).alias("name"))

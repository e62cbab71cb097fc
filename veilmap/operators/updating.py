"""Sequential updating of beliefs and the rules replayed over the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import rating, readable_rating, support_weight, weight_bits
from ..functions.fixed_values import KEY_BITS, LEVELS, STALL_CHANGE, STOP_PROBABILITY
from .scale import GROUP_ROWS, dealt, fits, running_sums

RUN = ("subject_id", "level", "segment")
LABELS_AT_ONCE = 1000


def split_ratings(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable ratings, rejected ones): c must be a number, alpha a number or NaN (which counts as 0)."""
    ok = readable_rating("c", "alpha")
    return ratings.where(ok), ratings.where(~ok)


def support_score(ratings: DataFrame) -> DataFrame:
    """Weight and bits of each rating, null where it cannot be read (see ``split_ratings``)."""
    return ratings.withColumns({"w": support_weight("c", "alpha"), "woe_bits": weight_bits("c", "alpha")})


def repair_ratings(hypotheses: DataFrame, ratings: DataFrame, *, keys=("subject_id", "step")) -> DataFrame:
    """Fit ratings to the hypotheses: a later attempt wins per label, missing
    labels become neutral (3, 0.0) and are flagged, unknown labels are kept only as flags."""
    latest = (
        ratings.groupBy(*keys, "label")
        .agg(F.max_by(F.struct("c", "alpha"), "attempt").alias("r"))
        .select(*keys, "label", F.col("r.c").alias("__c"), F.col("r.alpha").alias("__a"), F.lit(True).alias("__rated"))
    )
    known = hypotheses.select(*keys, "label", "ord", F.lit(True).alias("__known"))
    both = known.join(latest, [*keys, "label"], "full_outer")
    return both.select(
        *keys,
        "label",
        "ord",
        F.when(F.col("__known"), F.coalesce("__c", F.lit(3.0))).alias("c"),
        F.when(F.col("__known"), F.coalesce("__a", F.lit(0.0))).alias("alpha"),
        F.coalesce(F.col("__known") & F.col("__rated").isNull(), F.lit(False)).alias("fallback"),
        F.col("__known").isNull().alias("extra"),
    )


def bayes_step(beliefs: DataFrame, weights: DataFrame, *, keys=("subject_id",)) -> DataFrame:
    """One multiply-and-normalise step with its validity as columns."""
    a = beliefs.select(*keys, "label", "ord", F.col("p").alias("__p"))
    b = weights.select(*keys, "label", F.col("w").alias("__w"))
    both = a.join(b, [*keys, "label"], "full_outer").withColumn("__u", F.col("__p") * F.col("__w"))
    over = W.partitionBy(*keys)
    mismatch = F.bool_or(F.col("__p").isNull() | F.col("__w").isNull()).over(over)
    mass = F.sum("__u").over(over)
    error = F.when(mismatch, "support mismatch").when(F.coalesce(mass, F.lit(0.0)) <= 0, "zero mass")
    return both.select(*keys, "label", "ord", F.when(error.isNull(), F.col("__u") / mass).alias("p"), error.alias("error"))


def sequential_posterior(
    prior: DataFrame, ratings: DataFrame, *, group_rows: int = GROUP_ROWS, at_most: int | None = None, about: int | None = None
) -> DataFrame:
    """Posterior after every step.

    The normalisation of each step cancels, so P_t is the softmax of
    ln P_0 + the running sum of ln W. The prior enters the scan as step 0,
    which saves a join. Every (level, segment) restarts from its own prior.

    A step is ``valid`` if it rates exactly the labels of its prior, once each and readably, and leaves some mass.
    Other steps have no p and delta_p; an unreadable or missing rating then moves its label by nothing, and a label
    without a prior stays at 0.
    A prior may bring ``log_p``, its logarithm up to a constant, to continue
    from an earlier trajectory without underflow. ``about`` is the number of ratings, where it is known: short runs are then
    dealt to tasks of bounded size.
    """
    rated = support_score(ratings)
    if "segment" not in rated.columns:
        rated = rated.withColumn("segment", F.lit(0))
    if "segment" not in prior.columns:
        prior = prior.withColumn("segment", F.lit(0))
    known = F.when(F.col("p") > 0, F.log("p")).otherwise(F.lit(float("-inf")))
    if "log_p" in prior.columns:
        known = F.col("log_p")
    prior = prior.withColumn("__labels", F.count(F.lit(1)).over(W.partitionBy(*RUN)))
    start = prior.select(
        *RUN, F.lit(0).cast("bigint").alias("step"), "label", "ord",
        F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("alpha"),
        F.lit(None).cast("double").alias("w"), F.lit(0.0).alias("woe_bits"),
        known.alias("__ln"), F.lit(1).alias("__has"), F.col("__labels").alias("__of"),
    )
    moves = rated.select(
        *RUN, F.col("step").cast("bigint").alias("step"), "label", "ord",
        F.col("c").try_cast("double").alias("c"), F.col("alpha").try_cast("double").alias("alpha"),
        "w", "woe_bits", F.log("w").alias("__ln"), F.lit(0).alias("__has"), F.lit(0).cast("bigint").alias("__of"),
    )
    rows = start.unionByName(moves)
    keys = [*RUN, "label"]
    small = fits(rows, keys, group_rows, at_most)
    if at_most is not None and at_most * LABELS_AT_ONCE <= group_rows:
        rows = rows.repartition(*RUN) if about is None else dealt(rows, RUN, about)  # runs are known to be short, so that one shuffle serves the windows by label and by step
    scanned = running_sums(
        rows, keys, ["step"], {"__s": "__ln", "__k": "__has", "__n": "__of"}, group_rows=group_rows, at_most=0 if small else group_rows + 1
    ).where(F.col("step") > 0)
    # A label that the prior does not know has no mass.
    scanned = scanned.withColumn("__s", F.when(F.col("__k") > 0, F.col("__s")).otherwise(F.lit(float("-inf"))))
    at_step = W.partitionBy(*RUN, "step")
    previous = F.col("__s") - F.coalesce("__ln", F.lit(0.0))
    soft = lambda c: F.exp(c - F.max(c).over(at_step))
    out = scanned.withColumns({"__e": soft(F.col("__s")), "__f": soft(previous)})
    out = out.withColumns({"p": F.col("__e") / F.sum("__e").over(at_step), "__q": F.col("__f") / F.sum("__f").over(at_step)})
    whole = F.min((F.col("__k") > 0) & F.col("w").isNotNull()).over(at_step) & (F.count(F.lit(1)).over(at_step) == F.max("__n").over(at_step))
    out = out.withColumns({
        "delta_p": F.max(F.abs(F.col("p") - F.col("__q"))).over(at_step),
        "valid": whole & (F.max("__s").over(at_step) > float("-inf")),
    })
    return out.withColumns({c: F.when(F.col("valid"), F.col(c)) for c in ("p", "delta_p")}).select(*RUN, "step", "label", "ord", "c", "alpha", "w", "woe_bits", "p", "delta_p", "valid", F.col("__s").alias("log_p"))


def step_facts(trajectory: DataFrame) -> DataFrame:
    """One row per step with everything the rules look at."""
    c = rating("c")
    return trajectory.groupBy(*RUN, "step").agg(
        F.max("p").alias("max_p"),
        F.max(F.abs("woe_bits")).alias("key_bits"),
        F.max("delta_p").alias("delta_p"),
        F.bool_and(c <= 2).alias("all_refuted"),
        F.bool_or((c >= 4) & (F.col("alpha") > 0)).alias("supported"),
    )


def belief_events(
    facts: DataFrame, *, tau: float = STOP_PROBABILITY, tau_enhance: float = STALL_CHANGE, key_bits: float = KEY_BITS
) -> DataFrame:
    """Typed events (subject_id, level, step, type) from step facts."""
    backtrack = (F.col("level") != LEVELS[0]) & F.col("all_refuted")
    kinds = F.array(
        F.when(F.col("key_bits") >= key_bits, "key_evidence"),
        F.when(backtrack, "backtrack"),
        F.when((F.col("delta_p") < tau_enhance) & ~backtrack, "enhance_flag"),
    )
    per_step = facts.select("subject_id", "level", "step", F.explode(F.array_compact(kinds)).alias("type"))
    crossed = (
        facts.where(F.col("max_p") >= tau)
        .groupBy("subject_id")
        .agg(F.min_by("level", "step").alias("level"), F.min("step").alias("step"))
        .select("subject_id", "level", "step", F.lit("threshold_crossed").alias("type"))
    )
    return per_step.unionByName(crossed)


def recent_key_evidence(trajectory_facts: DataFrame, described: DataFrame, *, key_bits: float = KEY_BITS, last: int = 3) -> DataFrame:
    """Last key-evidence objects per subject. The object is the first clue,
    else the task text, else the first 40 characters of the evidence."""
    keyed = trajectory_facts.where(F.col("key_bits") >= key_bits).select("subject_id", "step", "key_bits")
    obj = F.coalesce(F.try_element_at("clues", F.lit(1)), F.col("task"), F.substring("evidence", 1, 40))
    named = keyed.join(described.select("subject_id", "step", obj.alias("object")), ["subject_id", "step"])
    newest = W.partitionBy("subject_id").orderBy(F.col("step").desc())
    # The rank filter is applied before the shuffle too, so a hot subject sends few rows.
    return named.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= last)


def level_readiness(facts: DataFrame, *, tau: float = STOP_PROBABILITY) -> DataFrame:
    """Per level: where it ended, why, and the level it may move on to."""
    ended = facts.groupBy("subject_id", "level").agg(
        F.max("step").alias("last_step"),
        F.max_by("max_p", "step").alias("max_p"),
        F.bool_or("supported").alias("support_seen"),
    )
    ready = F.col("max_p") >= tau
    following = F.element_at(F.create_map(*[F.lit(x) for pair in zip(LEVELS, LEVELS[1:]) for x in pair]), F.col("level"))
    reason = F.when(ready, "confident").when(F.col("support_seen"), "replace_gated").otherwise("replaceable")
    return ended.withColumns({"reason": reason, "next_level": F.when(ready, following)})

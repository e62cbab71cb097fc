"""Belief construction, divergences, sequential updating and its rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import p_yes
from ..operators import beliefs as B
from ..operators import updating as U
from ..functions.fixed_values import COUNTRY_ALIASES
from ..operators.scale import dealt
from . import views as V
from .registry import query, sql_view
from .views import rounded


@query("prior_softmax", """
  SELECT subject_id, level, label, round(p, 6) + 0.0 AS p FROM priors""")
def prior_softmax(spark, sf):
    return V.priors(spark, sf).select("subject_id", "level", "label", rounded("p").alias("p"))


@query("score_normalise", """
  SELECT subject_id, level, label, round(0.98 * CASE WHEN t > 0 THEN s / t ELSE 1.0 / n END + 0.02 / n + 1e-9, 6) AS p
  FROM (SELECT *, sum(s) OVER w AS t, count(*) OVER w AS n FROM (SELECT *, CASE WHEN (subject_id + ord) % 3 = 0 THEN 0.0 ELSE raw END AS s FROM prior_scores)
        WINDOW w AS (PARTITION BY subject_id, level))""")
def score_normalise(spark, sf):
    """Every third score is missing (null) and counts as 0."""
    raw = V.prior_scores(spark, sf)
    raw = raw.withColumn("raw", F.when((F.col("subject_id") + F.col("ord")) % 3 != 0, F.col("raw")))
    out = B.score_normalise(raw, keys=("subject_id", "level"))
    # Shares of round scores can end exactly between two roundings; step off the tie.
    return out.select("subject_id", "level", "label", rounded(F.col("p") + 1e-9).alias("p"))


@query("temper_beliefs", """
  SELECT subject_id, level, label, tau::DOUBLE AS tau, round(e / sum(e) OVER (PARTITION BY subject_id, level, tau), 6) + 0.0 AS p
  FROM (SELECT *, pow(greatest(p, 1e-12), 1.0 / tau) AS e FROM priors CROSS JOIN (VALUES (0.5), (1.0), (2.0)) t(tau))""")
def temper_beliefs(spark, sf):
    grid = V.priors(spark, sf).select("subject_id", "level", "label", "ord", "p", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("tau"))
    out = B.temper(grid, keys=("subject_id", "level", "tau"))
    return out.select("subject_id", "level", "label", "tau", rounded("p").alias("p"))


# Letters: order o offers its priority list under two permutations; a letter is visible for 3 of 4.
sql_view("letters", """
  SELECT o_orderkey AS subject_id, perm, (pos * 2 + perm * 3 + o_orderkey) % 5 AS letter, pos AS ord, 'option ' || pos AS label,
         CASE WHEN (o_orderkey + pos * 3 + perm) % 4 <> 0 THEN -((o_custkey * 7 + pos * 13 + perm * 5) % 50) / 10.0 END AS lp
  FROM orders CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS pos) CROSS JOIN (SELECT unnest(generate_series(0, 1)) AS perm)""")


@query("mc_letter_belief", """
  WITH f AS (SELECT *, coalesce(lp, coalesce(min(lp) OVER (PARTITION BY subject_id, perm), -15.0) - 5.0) AS l FROM letters),
       s AS (SELECT *, exp(l - max(l) OVER (PARTITION BY subject_id, perm)) AS e FROM f),
       q AS (SELECT *, e / sum(e) OVER (PARTITION BY subject_id, perm) AS p FROM s),
       a AS (SELECT subject_id, label, avg(p) AS p FROM q GROUP BY ALL)
  SELECT subject_id, label, round(p / sum(p) OVER (PARTITION BY subject_id), 6) + 0.0 AS p FROM a""")
def mc_letter_belief(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("subject_id"), "o_custkey")
    # Before an order becomes ten rows; counted from file footers.
    o = dealt(o, ["subject_id"], V.table(spark, sf, "orders").count(), task_rows=25_000)
    rows = o.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ord")).select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("perm"))
    letter = (F.col("ord") * 2 + F.col("perm") * 3 + F.col("subject_id")) % 5
    options = rows.select("subject_id", "perm", letter.alias("letter"), F.concat(F.lit("option "), "ord").alias("label"), "ord")
    seen = rows.where((F.col("subject_id") + F.col("ord") * 3 + F.col("perm")) % 4 != 0)
    visible = seen.select(
        "subject_id", "perm", letter.alias("letter"),
        (-((F.col("o_custkey") * 7 + F.col("ord") * 13 + F.col("perm") * 5) % 50) / F.lit(10.0)).alias("logprob"),
    )
    return B.letter_belief(visible, options).select("subject_id", "label", rounded("p").alias("p"))


@query("p_yes", """
  SELECT event_id, round(CASE WHEN y IS NULL AND n IS NULL THEN 0.5 WHEN y IS NULL THEN 1 - exp(least(0.0, n)) WHEN n IS NULL THEN exp(least(0.0, y))
                    ELSE exp(y) / (exp(y) + exp(n)) END, 6) + 0.0 AS p
  FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN -(event_id % 17) / 4.0 END AS y, CASE WHEN event_id % 5 <> 0 THEN -(event_id % 13) / 4.0 END AS n FROM events)""")
def p_yes_query(spark, sf):
    e = V.table(spark, sf, "events").select("event_id")
    i = F.col("event_id")
    rows = e.select("event_id", F.when(i % 3 != 0, -(i % 17) / F.lit(4.0)).alias("y"), F.when(i % 5 != 0, -(i % 13) / F.lit(4.0)).alias("n"))
    return rows.select("event_id", rounded(p_yes("y", "n")).alias("p"))


# Divergences ---------------------------------------------------------------------

@query("belief_entropy_kl", """
  SELECT a.subject_id, a.mask, round(sum(-a.p * log2(a.p)), 6) + 0.0 AS entropy_bits, round(sum(b.p * log2(b.p / a.p)), 6) + 0.0 AS kl_bits,
         round(0.5 * sum(abs(a.p - b.p)), 6) + 0.0 AS tv
  FROM beliefs a JOIN beliefs b ON a.subject_id = b.subject_id AND a.ord = b.ord AND b.mask = 0 WHERE a.mask > 0 GROUP BY a.subject_id, a.mask""")
def belief_entropy_kl(spark, sf):
    """The full view travels with every masked belief, so no join is needed here."""
    b = V.long_beliefs(spark, sf).where(F.col("mask") > 0)
    kl = F.sum(F.when(F.col("full") > 0, F.col("full") * F.log2(F.col("full") / F.col("p"))))
    out = b.groupBy("subject_id", "mask").agg(B.entropy().alias("h"), kl.alias("kl"), (0.5 * F.sum(F.abs(F.col("p") - F.col("full")))).alias("tv"))
    return out.select("subject_id", "mask", rounded("h").alias("entropy_bits"), rounded("kl").alias("kl_bits"), rounded("tv").alias("tv"))


sql_view("final_beliefs", """
  SELECT subject_id, level, label, ord, p FROM trajectory t WHERE step = (SELECT max(step) FROM step_facts f WHERE f.subject_id = t.subject_id AND f.level = t.level)""")


def final_beliefs(spark, sf):
    """Belief after the last step of each level."""
    t = V.trajectory(spark, sf)
    return t.groupBy("subject_id", "level", "label", "ord").agg(F.max_by("p", "step").alias("p"))


@query("belief_shift_stats", """
  WITH h AS (SELECT f.subject_id, f.level, sum(-q.p * log2(q.p)) AS h0, sum(CASE WHEN f.p > 0 THEN -f.p * log2(f.p) ELSE 0 END) AS h1,
                    sum(CASE WHEN f.p > 0 THEN f.p * log2(f.p / q.p) ELSE 0 END) AS kl FROM final_beliefs f JOIN priors q USING (subject_id, level, label) GROUP BY ALL)
  SELECT level, count(*) AS n, round(avg(h0), 6) + 0.0 AS mean_prior_bits, round(avg(h1), 6) + 0.0 AS mean_final_bits,
         round(avg(h0 - h1), 6) + 0.0 AS mean_drop_bits, round(avg(kl), 6) + 0.0 AS mean_kl_bits, count(*) AS n_same_support FROM h GROUP BY level""")
def belief_shift_stats(spark, sf):
    keys = ("subject_id", "level")
    final = final_beliefs(spark, sf)
    prior = V.priors(spark, sf)
    both = B.kl_bits(final, prior, keys=keys)
    h0 = B.entropy_bits(prior, keys=keys).withColumnRenamed("entropy_bits", "h0")
    h1 = B.entropy_bits(final, keys=keys).withColumnRenamed("entropy_bits", "h1")
    out = both.join(h0, list(keys)).join(h1, list(keys)).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("h0").alias("a"), F.avg("h1").alias("b"), F.avg(F.col("h0") - F.col("h1")).alias("c"),
        F.avg("kl_bits").alias("d"), F.count_if("same_support").alias("n_same_support"),
    )
    return out.select(
        "level", "n", rounded("a").alias("mean_prior_bits"), rounded("b").alias("mean_final_bits"),
        rounded("c").alias("mean_drop_bits"), rounded("d").alias("mean_kl_bits"), "n_same_support",
    )


@query("map_estimate", """
  SELECT subject_id, mask, arg_max(label, (round(p, 12), -ord)) AS label, round(max(p), 6) + 0.0 AS p FROM beliefs GROUP BY subject_id, mask""")
def map_estimate(spark, sf):
    b = V.long_beliefs(spark, sf).withColumn("p", F.round("p", 12))
    return B.map_estimate(b).select("subject_id", "mask", "label", rounded("p").alias("p"))


@query("cross_entropy", """
  SELECT count(*) AS n, round(avg(-ln(greatest(p, 1e-12))), 6) + 0.0 AS cross_entropy, round(ln((SELECT count(*) FROM gallery_small)), 6) + 0.0 AS uniform,
         round(1.0 / (SELECT count(*) FROM gallery_small), 6) + 0.0 AS random_accuracy
  FROM beliefs b JOIN subjects s ON b.subject_id = s.subject_id AND b.ord = s.truth WHERE mask = 0""")
def cross_entropy(spark, sf):
    b = V.long_beliefs(spark, sf, every_mask=False).where((F.col("mask") == 0) & (F.col("ord") == F.col("truth")))
    k = V.gallery_small(spark, sf).agg(F.count(F.lit(1)).alias("k"))
    out = b.agg(F.count(F.lit(1)).alias("n"), F.avg(B.cross_entropy("p")).alias("ce")).crossJoin(F.broadcast(k))  # one row each
    return out.select("n", rounded("ce").alias("cross_entropy"), rounded(F.log("k")).alias("uniform"), rounded(1.0 / F.col("k")).alias("random_accuracy"))


# Sequential updating --------------------------------------------------------------

@query("sequential_posterior", """
  SELECT subject_id, level, step, label, round(w, 6) + 0.0 AS w, round(woe_bits, 6) + 0.0 AS woe_bits, round(p, 6) + 0.0 AS p, round(delta_p, 6) + 0.0 AS delta_p FROM trajectory""")
def sequential_posterior(spark, sf):
    t = V.trajectory(spark, sf)
    return t.select("subject_id", "level", "step", "label", *[rounded(c).alias(c) for c in ("w", "woe_bits", "p", "delta_p")])


sql_view("broken_ratings", """
  SELECT subject_id, level, step, event_id % 10 AS kind, label, CASE WHEN event_id % 10 = 7 AND ord = 1 THEN NULL ELSE c END AS c
  FROM ratings WHERE NOT (event_id % 10 = 3 AND ord = 2)
  UNION ALL SELECT subject_id, level, step, event_id % 10, 'Atlantis', 3 FROM ratings WHERE event_id % 10 = 5 AND ord = 0
  UNION ALL SELECT subject_id, level, step, event_id % 10, label, c FROM ratings WHERE event_id % 10 = 8 AND ord = 4""")


def broken_ratings(spark, sf):
    """Ratings of which every tenth step lacks a label, has an unknown one, an unreadable one, or one twice."""
    r = V.ratings(spark, sf).withColumn("c", F.col("c").cast("string"))
    kind = F.col("event_id") % 10
    kept = r.where(~((kind == 3) & (F.col("ord") == 2))).withColumn("c", F.when((kind == 7) & (F.col("ord") == 1), "unsure").otherwise(F.col("c")))
    extra = r.where((kind == 5) & (F.col("ord") == 0)).withColumns({"label": F.lit("Atlantis"), "c": F.lit("3"), "ord": F.lit(9).cast(r.schema["ord"].dataType)})
    twice = r.where((kind == 8) & (F.col("ord") == 4))
    return kept.unionByName(extra).unionByName(twice)


@query("step_errors", """
  SELECT kind, count(*) AS n_steps, sum(invalid)::BIGINT AS n_invalid FROM (
    SELECT b.subject_id, b.level, b.step, b.kind,
           CASE WHEN bool_or(p.label IS NULL OR b.c IS NULL) OR count(*) <> (SELECT count(*) FROM region) THEN 1 ELSE 0 END AS invalid
    FROM broken_ratings b LEFT JOIN priors p ON b.subject_id = p.subject_id AND b.level = p.level AND b.label = p.label GROUP BY ALL)
  GROUP BY kind""")
def step_errors(spark, sf):
    """Steps that do not rate exactly the labels of their prior, by what was done to them."""
    r = broken_ratings(spark, sf)
    t = U.sequential_posterior(V.priors(spark, sf), r)
    steps = t.groupBy("subject_id", "level", "step").agg(F.bool_and("valid").alias("valid"))
    kinds = r.select("subject_id", "level", F.col("step").cast("bigint").alias("step"), (F.col("event_id") % 10).alias("kind")).distinct()
    return steps.join(kinds, ["subject_id", "level", "step"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(~F.col("valid")).alias("n_invalid"))


@query("rejected_ratings", """
  SELECT event_id % 10 AS kind, count(*) AS n FROM ratings WHERE event_id % 10 = 7 AND ord = 1 GROUP BY ALL""")
def rejected_ratings(spark, sf):
    """Ratings that cannot be read, split off."""
    return U.split_ratings(broken_ratings(spark, sf))[1].groupBy((F.col("event_id") % 10).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


sql_view("step_weights", """
  SELECT subject_id, level, label, CASE WHEN subject_id % 7 = 3 THEN 0.0 ELSE pow(2.0, (ord + subject_id) % 3 - 1) END AS w
  FROM priors WHERE NOT (subject_id % 7 = 1 AND ord = 0)
  UNION ALL SELECT subject_id, level, 'Atlantis', 1.0 FROM priors WHERE subject_id % 7 = 2 AND ord = 0""")


@query("bayes_step", """
  SELECT subject_id, level, label, CASE WHEN error IS NULL THEN round(u / mass, 6) + 0.0 END AS p, error FROM (
    SELECT *, CASE WHEN odd THEN 'support mismatch' WHEN coalesce(mass, 0) <= 0 THEN 'zero mass' END AS error FROM (
      SELECT coalesce(p.subject_id, w.subject_id) AS subject_id, coalesce(p.level, w.level) AS level, coalesce(p.label, w.label) AS label, p.p * w.w AS u,
             bool_or(p.p IS NULL OR w.w IS NULL) OVER g AS odd, sum(p.p * w.w) OVER g AS mass
      FROM priors p FULL JOIN step_weights w ON p.subject_id = w.subject_id AND p.level = w.level AND p.label = w.label
      WINDOW g AS (PARTITION BY coalesce(p.subject_id, w.subject_id), coalesce(p.level, w.level))))""")
def bayes_step(spark, sf):
    """One update of every prior; some weights lack a label, bring an unknown one, or are all zero."""
    p = V.priors(spark, sf)
    seventh = F.col("subject_id") % 7
    w = F.when(seventh == 3, 0.0).otherwise(F.pow(F.lit(2.0), (F.col("ord") + F.col("subject_id")) % 3 - 1))
    given = p.where(~((seventh == 1) & (F.col("ord") == 0))).select("subject_id", "level", "label", w.alias("w"))
    extra = p.where((seventh == 2) & (F.col("ord") == 0)).select("subject_id", "level", F.lit("Atlantis").alias("label"), F.lit(1.0).alias("w"))
    out = U.bayes_step(p, given.unionByName(extra), keys=("subject_id", "level"))
    return out.select("subject_id", "level", "label", rounded("p").alias("p"), "error")


@query("belief_events", "SELECT * FROM belief_event_rows")
def belief_events(spark, sf):
    return U.belief_events(U.step_facts(V.trajectory(spark, sf)))


@query("event_counts", "SELECT level, type, count(*) AS n FROM belief_event_rows GROUP BY ALL")
def event_counts(spark, sf):
    return U.belief_events(U.step_facts(V.trajectory(spark, sf))).groupBy("level", "type").agg(F.count(F.lit(1)).alias("n"))


sql_view("described", """
  SELECT user_id AS subject_id, step, CASE WHEN event_id % 3 = 0 THEN 'clue ' || event_id WHEN event_id % 3 = 1 THEN event_type
         ELSE substr('observed ' || event_type || ' with ' || props || ' at value ' || event_id, 1, 40) END AS object FROM numbered_events""")


def described(spark, sf):
    """What each step looked at: a clue list, a task text or only the evidence."""
    from ..operators.scale import row_numbers

    e = V.table(spark, sf, "events")
    i = F.col("event_id")
    rows = e.select(
        F.col("user_id").alias("subject_id"), "ts", "event_id",
        F.when(i % 3 == 0, F.array(F.concat(F.lit("clue "), i))).otherwise(F.array().cast("array<string>")).alias("clues"),
        F.when(i % 3 == 1, F.col("event_type")).alias("task"),
        F.concat(F.lit("observed "), "event_type", F.lit(" with "), "props", F.lit(" at value "), i).alias("evidence"),
    )
    return row_numbers(rows, ["subject_id"], ["ts", "event_id"], "step", at_most=V.busiest_user(spark, sf))


@query("key_evidence", """
  SELECT subject_id, step, round(key_bits, 6) + 0.0 AS key_bits, object, recency FROM (
    SELECT f.subject_id, f.step, key_bits, object, row_number() OVER (PARTITION BY f.subject_id ORDER BY f.step DESC) AS recency
    FROM step_facts f JOIN described d USING (subject_id, step) WHERE key_bits >= 1.0) WHERE recency <= 3""")
def key_evidence(spark, sf):
    facts = U.step_facts(V.trajectory(spark, sf))
    out = U.recent_key_evidence(facts, described(spark, sf))
    return out.select("subject_id", "step", rounded("key_bits").alias("key_bits"), "object", "recency")


@query("level_readiness", """
  SELECT subject_id, level, max(step) AS last_step, round(arg_max(max_p, step), 6) + 0.0 AS max_p, bool_or(supported) AS support_seen,
         CASE WHEN arg_max(max_p, step) >= 0.7 THEN 'confident' WHEN bool_or(supported) THEN 'replace_gated' ELSE 'replaceable' END AS reason,
         CASE WHEN arg_max(max_p, step) >= 0.7 THEN CASE level WHEN 'country' THEN 'city' WHEN 'city' THEN 'street' END END AS next_level
  FROM step_facts GROUP BY subject_id, level""")
def level_readiness(spark, sf):
    r = U.level_readiness(U.step_facts(V.trajectory(spark, sf)))
    return r.select("subject_id", "level", "last_step", rounded("max_p").alias("max_p"), "support_seen", "reason", "next_level")


@query("level_summary", """
  WITH r AS (SELECT subject_id, max(CASE level WHEN 'country' THEN 0 WHEN 'city' THEN 1 ELSE 2 END) AS depth FROM step_facts GROUP BY subject_id),
       e AS (SELECT subject_id, count(*) FILTER (WHERE type = 'enhance_flag') AS n_enhance FROM belief_event_rows GROUP BY subject_id)
  SELECT CASE depth WHEN 0 THEN 'country' WHEN 1 THEN 'city' ELSE 'street' END AS final_level, count(*) AS n, sum(CASE WHEN depth > 0 THEN 1 ELSE 0 END)::BIGINT AS n_finer,
         sum(depth)::BIGINT AS n_transitions, sum(coalesce(n_enhance, 0))::BIGINT AS n_enhance FROM r LEFT JOIN e USING (subject_id) GROUP BY depth""")
def level_summary(spark, sf):
    facts = U.step_facts(V.trajectory(spark, sf))
    depth = F.when(F.col("level") == "country", 0).when(F.col("level") == "city", 1).otherwise(2)
    stalled = (F.col("delta_p") < 0.05) & ~((F.col("level") != "country") & F.col("all_refuted"))
    per = facts.groupBy("subject_id").agg(F.max(depth).alias("depth"), F.count_if(stalled).alias("n_enhance"))
    name = F.when(F.col("depth") == 0, "country").when(F.col("depth") == 1, "city").otherwise("street")
    return per.groupBy(name.alias("final_level")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth") > 0).alias("n_finer"),
        F.sum("depth").alias("n_transitions"), F.sum("n_enhance").alias("n_enhance"),
    )


@query("rating_histogram", """
  SELECT c::DOUBLE AS c, count(*) AS n, round(avg(alpha), 6) + 0.0 AS alpha_mean, min(alpha) AS alpha_min, max(alpha) AS alpha_max FROM ratings GROUP BY c""")
def rating_histogram(spark, sf):
    events = V.table(spark, sf, "events").select("event_id", "user_id", "ts").withColumn("level", V.level_of())
    r = V.rate_events(events, V.table(spark, sf, "region"))
    return r.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("alpha")).alias("alpha_mean"), F.min("alpha").alias("alpha_min"), F.max("alpha").alias("alpha_max")
    )


@query("hierarchical_name", """
  WITH best AS (SELECT subject_id, level, arg_max(label, (round(p, 9), -ord)) AS label FROM final_beliefs GROUP BY ALL),
       lv AS (SELECT subject_id, concat_ws(', ', max(label) FILTER (WHERE level = 'street'), max(label) FILTER (WHERE level = 'city'), max(label) FILTER (WHERE level = 'country')) AS name FROM best GROUP BY subject_id)
  SELECT subject_id, CASE WHEN subject_id % 7 = 0 THEN CASE WHEN subject_id % 2 = 0 THEN 'Main Street, ' ELSE '' END || 'Stated ' || subject_id ELSE name END AS name FROM lv""")
def hierarchical_name(spark, sf):
    final = final_beliefs(spark, sf).withColumn("p", F.round("p", 9))
    users = V.table(spark, sf, "events").select(F.col("user_id").alias("subject_id")).distinct().where(F.col("subject_id") % 7 == 0)
    stated = users.select(
        "subject_id", F.concat(F.lit("Stated "), "subject_id").alias("country"), F.lit(None).cast("string").alias("city"),
        F.when(F.col("subject_id") % 2 == 0, "Main Street").otherwise("").alias("street"),
    )
    return B.hierarchical_name(final, stated)


# Names and candidates ----------------------------------------------------------------

_ALIAS_SQL = "(VALUES " + ", ".join("('{}', '{}')".format(a.replace("'", "''"), c) for a, c in COUNTRY_ALIASES.items()) + ") t(alias, canonical)"
sql_view("country_aliases", f"SELECT * FROM {_ALIAS_SQL}")
# Written names: customer c writes the alias number c mod n, oddly spaced, or its own nation.
sql_view("written_names", """
  SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 4 = 0 THEN n_name ELSE '  ' || upper(alias) || CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE '' END END AS name,
         CASE WHEN c_custkey % 4 = 0 THEN n_name ELSE canonical END AS want
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN (SELECT *, row_number() OVER (ORDER BY alias) - 1 AS i, count(*) OVER () AS n FROM country_aliases) a ON a.i = c_custkey % a.n""")


def written_names(spark, sf):
    aliases = F.array(*map(F.lit, sorted(COUNTRY_ALIASES)))
    c = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey").withColumn("alias", aliases[(F.col("c_custkey") % len(COUNTRY_ALIASES)).cast("int")])
    n = V.table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    odd = F.concat(F.lit("  "), F.upper("alias"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(""))
    return j.select(F.col("c_custkey").alias("subject_id"), F.when(F.col("c_custkey") % 4 == 0, F.col("n_name")).otherwise(odd).alias("name"))


@query("canonical_country", "SELECT subject_id, name, want AS canonical FROM written_names")
def canonical_country(spark, sf):
    return B.canonical_country(written_names(spark, sf), "name").select("subject_id", "name", "canonical")


sql_view("candidate_rows", """
  SELECT subject_id // 5 AS subject_id, subject_id AS ord, CASE WHEN (subject_id // 5) % 3 = 0 THEN 'city' ELSE 'country' END AS level,
         CASE WHEN subject_id % 11 = 0 THEN '  ' ELSE name END AS location,
         CASE WHEN (subject_id // 5) % 3 = 0 THEN trim(name) ELSE want END AS want,
         CASE WHEN subject_id % 13 = 0 THEN 'high' ELSE CAST((subject_id % 30) / 20.0 - 0.2 AS VARCHAR) END AS confidence,
         CASE WHEN subject_id % 13 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (subject_id % 30) / 20.0 - 0.2)) END AS conf, 'reason ' || subject_id AS reason
  FROM written_names""")


@query("clean_candidates", """
  SELECT subject_id, level, want AS location, round(max(conf), 6) + 0.0 AS confidence, min(ord) AS ord, arg_min(reason, ord) AS reason
  FROM candidate_rows WHERE trim(location) <> '' GROUP BY subject_id, level, want""")
def clean_candidates(spark, sf):
    n = written_names(spark, sf).withColumnRenamed("subject_id", "i")
    i = F.col("i")
    rows = n.select(
        F.expr("i div 5").alias("subject_id"), i.alias("ord"),
        F.when(F.expr("i div 5") % 3 == 0, "city").otherwise("country").alias("level"),
        F.when(i % 11 == 0, "  ").otherwise(F.col("name")).alias("location"),
        F.when(i % 13 == 0, "high").otherwise(((i % 30) / F.lit(20.0) - 0.2).cast("string")).alias("confidence"),
        F.concat(F.lit("reason "), i).alias("reason"),
    )
    out = B.clean_candidates(rows)
    return out.select("subject_id", "level", "location", rounded("confidence").alias("confidence"), "ord", "reason")


@query("support_difference", """
  SELECT subject_id, count(*) FILTER (WHERE NOT have)  AS n_missing, count(*) FILTER (WHERE NOT want) AS n_extra, bool_and(have AND want) AS same_support
  FROM (SELECT subject_id, label, bool_or(side = 'have') AS have, bool_or(side = 'want') AS want FROM (
          SELECT subject_id, label, 'have' AS side FROM ratings WHERE (event_id + ord) % 4 <> 0 UNION ALL SELECT subject_id, label, 'want' FROM priors WHERE level <> 'street') GROUP BY ALL) GROUP BY subject_id""")
def support_difference(spark, sf):
    events = V.table(spark, sf, "events").select("event_id", "user_id", "ts").withColumn("level", V.level_of())
    have = V.rate_events(events, V.table(spark, sf, "region")).where((F.col("event_id") + F.col("ord")) % 4 != 0)
    return B.support_difference(have, V.priors(spark, sf).where(F.col("level") != "street"))


@query("judge_repair", """
  WITH replies AS (SELECT subject_id, step, label, c, alpha, 1 AS attempt FROM ratings WHERE (event_id + ord) % 3 <> 0
                   UNION ALL SELECT subject_id, step, CASE WHEN ord = 4 THEN 'Atlantis' ELSE label END, 6 - c, alpha, 2 FROM ratings WHERE (event_id + ord) % 5 = 0),
       latest AS (SELECT subject_id, step, label, arg_max(c, attempt) AS c, arg_max(alpha, attempt) AS alpha FROM replies GROUP BY ALL)
  SELECT coalesce(r.subject_id, l.subject_id) AS subject_id, coalesce(r.step, l.step) AS step, coalesce(r.label, l.label) AS label,
         CASE WHEN r.label IS NOT NULL THEN coalesce(l.c, 3) END::DOUBLE AS c, CASE WHEN r.label IS NOT NULL THEN coalesce(l.alpha, 0.0) END AS alpha,
         r.label IS NOT NULL AND l.label IS NULL AS fallback, r.label IS NULL AS extra
  FROM ratings r FULL JOIN latest l ON r.subject_id = l.subject_id AND r.step = l.step AND r.label = l.label""")
def judge_repair(spark, sf):
    r = V.ratings(spark, sf, at_most=V.busiest_user(spark, sf))
    part = (F.col("event_id") + F.col("ord"))
    first = r.where(part % 3 != 0).select("subject_id", "step", "label", "c", "alpha", F.lit(1).alias("attempt"))
    again = r.where(part % 5 == 0).select(
        "subject_id", "step", F.when(F.col("ord") == 4, "Atlantis").otherwise(F.col("label")).alias("label"), (6 - F.col("c")).alias("c"), "alpha", F.lit(2).alias("attempt")
    )
    out = U.repair_ratings(r.select("subject_id", "step", "label", "ord"), first.unionByName(again))
    return out.select("subject_id", "step", "label", "c", "alpha", "fallback", "extra")

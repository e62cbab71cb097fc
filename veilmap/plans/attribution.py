"""Leakage and attribution queries over the subset lattice."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import table_functions
from ..functions.columns import full_mask, mask_indices
from ..operators import beliefs as B
from ..operators import lattice as L
from ..operators import leakage as K
from ..operators import pair_tiles, reports, scoring
from ..operators.geometry import clusters, pairs
from ..operators.scale import percentiles, summarise
from ..session import checkpointed
from . import views as V
from .registry import query, sql_view
from .views import rounded, sql_haversine


@query("cue_shapley", """
  SELECT subject_id, m, k, round(phi, 6) + 0.0 AS phi, round(v_all, 6) + 0.0 AS v_all FROM attribution""")
def cue_shapley(spark, sf):
    s = L.shapley(V.lattice(spark, sf))
    return s.select("subject_id", "m", "k", rounded("phi").alias("phi"), rounded("v_all").alias("v_all"))


@query("efficiency_check", """
  SELECT m, count(*) AS n_subjects, sum(CASE WHEN abs(total - v_all) < 1e-9 THEN 1 ELSE 0 END)::BIGINT AS n_ok
  FROM (SELECT subject_id, m, sum(phi) AS total, max(v_all) AS v_all FROM attribution GROUP BY ALL) GROUP BY m""")
def efficiency_check(spark, sf):
    s = L.shapley(V.lattice(spark, sf))
    per = s.groupBy("subject_id", "m").agg(F.sum("phi").alias("total"), F.max("v_all").alias("v_all"))
    ok = F.abs(F.col("total") - F.col("v_all")) < 1e-9
    return per.groupBy("m").agg(F.count(F.lit(1)).alias("n_subjects"), F.count_if(ok).alias("n_ok"))


@query("sii", """
  SELECT subject_id, m, k, l, round(sii, 6) + 0.0 AS sii, round(i_empty, 6) + 0.0 AS i_empty FROM pair_index""")
def sii(spark, sf):
    i = L.interactions(V.lattice(spark, sf))
    return i.select("subject_id", "m", "k", "l", rounded("sii").alias("sii"), rounded("i_empty").alias("i_empty"))


sql_view("wide_game", """
  SELECT w.subject_id, mask, sqrt(CAST(sum(CASE WHEN (mask >> cue) & 1 = 1 THEN worth ELSE 0 END) AS DOUBLE)) AS v FROM (
    SELECT n_regionkey AS subject_id, c_custkey % 16 AS cue, count(*) * (1 + any_value(c_custkey % 16)) AS worth FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) w
  CROSS JOIN (SELECT unnest(generate_series(0, 65535)) AS mask) GROUP BY ALL""")


@query("sii_wide", """
  SELECT subject_id, k, l, round(sum(s * v * f(n) ), 6) + 0.0 AS sii, round(sum(CASE WHEN n = 0 THEN CASE WHEN ik + il = 2 THEN v WHEN ik + il = 1 THEN -v ELSE 0.0 END ELSE 0.0 END), 6) + 0.0 AS i_empty FROM (
    SELECT *, bit_count(mask) - ik - il AS n, CASE WHEN ik + il = 1 THEN -1.0 ELSE 1.0 END AS s FROM (
      SELECT g.subject_id, g.mask, g.v, a.k, b.l, (g.mask >> a.k) & 1 AS ik, (g.mask >> b.l) & 1 AS il
      FROM wide_game g CROSS JOIN (SELECT unnest(generate_series(0, 15)) AS k) a JOIN (SELECT unnest(generate_series(0, 15)) AS l) b ON a.k < b.l)) GROUP BY ALL""".replace("f(n)", "(factorial(CAST(n AS INTEGER)) * factorial(CAST(14 - n AS INTEGER)) / CAST(factorial(15) AS DOUBLE))"))
def sii_wide(spark, sf):
    """Interaction indices of games of 16 cues: the regions, whose cues are shares of their customers."""
    c, n = V.table(spark, sf, "customer"), V.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    cue = F.col("c_custkey") % 16
    own = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("subject_id"), cue.alias("cue")).agg((F.count(F.lit(1)) * (1 + cue)).alias("worth"))
    listed = own.groupBy("subject_id").agg(F.collect_list(F.struct("cue", "worth")).alias("cues"))  # 16 at most
    each = listed.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(65535).cast("bigint"))))
    total = F.aggregate("cues", F.lit(0).cast("bigint"), lambda t, x: t + F.when(F.call_function("shiftright", F.col("mask"), x["cue"].cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1, x["worth"]).otherwise(0))
    game = each.select("subject_id", F.lit(16).alias("m"), "mask", F.sqrt(total.cast("double")).alias("v"))
    out = L.interactions_by_dividends(game)
    return out.select("subject_id", "k", "l", rounded("sii").alias("sii"), rounded("i_empty").alias("i_empty"))


@query("interaction_class", """
  SELECT kind, sum(CASE WHEN x < -0.01 THEN 1 ELSE 0 END)::BIGINT AS n_overlap,
         sum(CASE WHEN x BETWEEN -0.01 AND 0.01 THEN 1 ELSE 0 END)::BIGINT AS n_additive,
         sum(CASE WHEN x > 0.01 THEN 1 ELSE 0 END)::BIGINT AS n_backup,
         round(quantile_cont(x, 0.5), 6) + 0.0 AS median
  FROM (SELECT 'sii' AS kind, sii AS x FROM pair_index UNION ALL SELECT 'empty', i_empty FROM pair_index) GROUP BY kind""")
def interaction_class(spark, sf):
    i = L.interactions(V.lattice(spark, sf))
    both = i.select(F.inline(F.array(
        F.struct(F.lit("sii").alias("kind"), F.col("sii").alias("x")),
        F.struct(F.lit("empty").alias("kind"), F.col("i_empty").alias("x")),
    )))
    cls = L.interaction_class("x")
    counts = [F.count_if(cls == c).alias(f"n_{c}") for c in ("overlap", "additive", "backup")]
    out = summarise(both, ["kind"], counts, {"median": ("x", 0.5)}, at_most=V.most_rows(spark, sf))
    return out.select("kind", "n_overlap", "n_additive", "n_backup", rounded("median").alias("median"))


@query("pair_tags", """
  SELECT subject_id, k, l, CASE WHEN v_kl > v_k + v_l + 1e-6 THEN 'synergy' WHEN v_kl < greatest(v_k, v_l) + 1e-9 THEN 'redundant' ELSE 'additive' END AS tag
  FROM (SELECT subject_id, k, l, max(CASE WHEN mask = (1 << k) | (1 << l) THEN v END) AS v_kl,
               max(CASE WHEN mask = 1 << k THEN v END) AS v_k, max(CASE WHEN mask = 1 << l THEN v END) AS v_l
        FROM cue_pairs GROUP BY ALL)""")
def pair_tags(spark, sf):
    return L.pair_tags(V.lattice(spark, sf)).select("subject_id", "k", "l", "tag")


@query("two_cue_closed_form", """
  SELECT subject_id, round(0.5 * v1 + 0.5 * (v3 - v2), 6) + 0.0 AS phi_0, round(0.5 * v2 + 0.5 * (v3 - v1), 6) + 0.0 AS phi_1,
         round(v3 - v1 - v2, 6) + 0.0 AS interaction
  FROM (SELECT subject_id, max(CASE WHEN mask = 1 THEN v END) AS v1, max(CASE WHEN mask = 2 THEN v END) AS v2, max(CASE WHEN mask = 3 THEN v END) AS v3
        FROM lattice WHERE m = 2 GROUP BY subject_id)""")
def two_cue_closed_form(spark, sf):
    t = L.two_cue_values(V.lattice(spark, sf))
    return t.select("subject_id", *[rounded(c).alias(c) for c in ("phi_0", "phi_1", "interaction")])


@query("visible_game_shapley", """
  SELECT subject_id, m, k, round(sum(CASE WHEN (vis >> k) & 1 = 1 THEN v ELSE -v END
           * factorial((bit_count(vis) - ((vis >> k) & 1))::INT) * factorial((m - bit_count(vis) + ((vis >> k) & 1) - 1)::INT) / factorial(m::INT)), 6) + 0.0 AS phi_bits
  FROM (SELECT subject_id, m, vis, v, unnest(generate_series(0, m - 1)) AS k FROM
         (SELECT subject_id, m, ((1 << m) - 1) - mask AS vis, sum(CASE WHEN p > 0 THEN p * log2(p * (SELECT count(*) FROM gallery_small)) ELSE 0 END) AS v
          FROM beliefs GROUP BY ALL)) GROUP BY ALL""")
def visible_game_shapley(spark, sf):
    k = V.gallery_small(spark, sf).count()
    b = V.long_beliefs(spark, sf)
    v = b.groupBy("subject_id", "m", "mask").agg(B.kl_to_uniform(k).alias("v"))
    s = L.shapley(L.visible_game(v))
    return s.select("subject_id", "m", "k", rounded("phi").alias("phi_bits"))


# Category of cue k: one of the part types in alphabetical order.
sql_view("categories", "SELECT row_number() OVER (ORDER BY p_type) - 1 AS idx, count(*) OVER () AS n, p_type AS category FROM (SELECT DISTINCT p_type FROM part)")
sql_view("attributed", """
  SELECT a.*, c.category, mf.ord = s.truth AS hit FROM attribution a JOIN subjects s USING (subject_id)
  JOIN map_full mf USING (subject_id) JOIN categories c ON c.idx = (a.subject_id + a.k) % c.n""")


def with_category(spark, sf, df):
    """Cue k of a subject gets the ((subject + k) mod n)-th part type."""
    kinds = V.table(spark, sf, "part").select(F.col("p_type").alias("category")).distinct()
    # Part types are a handful of names.
    kinds = kinds.select("category", (F.row_number().over(W.orderBy("category")) - 1).alias("idx"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    return df.join(F.broadcast(kinds), F.col("idx") == (F.col("subject_id") + F.col("k")) % F.col("n")).drop("idx", "n")


def cue_values(spark, sf):
    """phi, v_single and v_all per cue with the hit flag of the subject."""
    leak = V.leaks(spark, sf)
    best = F.array_position(F.col("full"), F.array_max("full"))
    base = leak.select(
        "subject_id", "truth", "m", "mask",
        F.when(F.col("mask") == 0, 0.0).otherwise(F.col("leak.mean")).alias("v"), (best - 1).alias("pos"),
    )
    phi = L.shapley(base, carry=("truth", "pos"))
    g = V.gallery_small(spark, sf).select("pos", "ord")
    out = phi.join(F.broadcast(g), "pos")
    return with_category(spark, sf, out.withColumn("hit", F.col("ord") == F.col("truth")).drop("pos", "ord"))


@query("category_attribution", """
  SELECT stratum, category, n, round(phi_median, 6) + 0.0 AS phi_median, round(v_median, 6) + 0.0 AS v_median,
         rank() OVER (PARTITION BY stratum ORDER BY round(phi_median, 9) DESC) AS phi_rank, rank() OVER (PARTITION BY stratum ORDER BY round(v_median, 9) DESC) AS v_rank
  FROM (SELECT CASE WHEN hit IS NULL THEN 'all' WHEN hit THEN 'hit' ELSE 'miss' END AS stratum, category, count(*) AS n,
               quantile_cont(phi, 0.5) AS phi_median, quantile_cont(v_single, 0.5) AS v_median
        FROM attributed GROUP BY GROUPING SETS ((category), (hit, category)))""")
def category_attribution(spark, sf):
    cues = cue_values(spark, sf)
    strata = F.array(F.lit("all"), F.when(F.col("hit"), "hit").otherwise("miss"))
    rows = cues.select("category", "phi", "v_single", F.explode(strata).alias("stratum"))
    out = summarise(rows, ["stratum", "category"], [F.count(F.lit(1)).alias("n")], {"phi_median": ("phi", 0.5), "v_median": ("v_single", 0.5)}, at_most=V.most_rows(spark, sf))
    by = lambda c: W.partitionBy("stratum").orderBy(F.round(c, 9).desc())
    return out.select(
        "stratum", "category", "n", rounded("phi_median").alias("phi_median"), rounded("v_median").alias("v_median"),
        F.rank().over(by("phi_median")).alias("phi_rank"), F.rank().over(by("v_median")).alias("v_rank"),
    )


@query("negative_and_strong", """
  SELECT 'negative_phi' AS kind, NULL::BIGINT AS subject_id, NULL::BIGINT AS k, NULL::BIGINT AS l, count(*)::DOUBLE AS value FROM attribution WHERE phi < -0.01
  UNION ALL (SELECT 'interaction', subject_id, k, l, round(sii, 6) + 0.0 FROM pair_index ORDER BY round(abs(sii), 9) DESC, subject_id, k, l LIMIT 5)""")
def negative_and_strong(spark, sf):
    lat = checkpointed(V.lattice(spark, sf))  # read twice
    none = F.lit(None).cast("bigint")
    neg = L.shapley(lat).where(F.col("phi") < -0.01).agg(F.count(F.lit(1)).cast("double").alias("value"))
    top = L.interactions(lat).orderBy(F.round(F.abs("sii"), 9).desc(), "subject_id", "k", "l").limit(5)
    return neg.select(F.lit("negative_phi").alias("kind"), none.alias("subject_id"), none.alias("k"), none.alias("l"), "value").unionByName(
        top.select(F.lit("interaction").alias("kind"), "subject_id", F.col("k").cast("bigint"), F.col("l").cast("bigint"), rounded("sii").alias("value"))
    )


@query("case_table", """
  SELECT subject_id, m, round(sum_single, 6) + 0.0 AS sum_single, round(v_all, 6) + 0.0 AS v_all, round(max_i, 6) + 0.0 AS max_i, round(min_i, 6) + 0.0 AS min_i
  FROM (SELECT subject_id, m, sum(v_single) AS sum_single, max(v_all) AS v_all FROM attribution GROUP BY ALL)
  LEFT JOIN (SELECT subject_id, max(sii) AS max_i, min(sii) AS min_i FROM pair_index GROUP BY ALL) USING (subject_id)""")
def case_table(spark, sf):
    lat = checkpointed(V.lattice(spark, sf))  # read twice
    singles = lat.groupBy("subject_id", "m").agg(
        F.sum(F.when(F.bit_count("mask") == 1, F.col("v"))).alias("sum_single"),
        F.max(F.when(F.col("mask") == full_mask("m"), F.col("v"))).alias("v_all"),
    )
    inter = L.interactions(lat).groupBy("subject_id").agg(F.max("sii").alias("max_i"), F.min("sii").alias("min_i"))
    out = singles.join(inter, "subject_id", "left")
    return out.select("subject_id", "m", *[rounded(c).alias(c) for c in ("sum_single", "v_all", "max_i", "min_i")])


@query("subset_order", """
  SELECT subject_id, m, mask, row_number() OVER (PARTITION BY subject_id ORDER BY bit_count(mask), list_filter(generate_series(0, m - 1), lambda k: (mask >> k) & 1 = 1)) AS position
  FROM subject_masks WHERE mask > 0""")
def subset_order(spark, sf):
    e = L.expand_subsets(V.subjects(spark, sf))
    order = W.partitionBy("subject_id").orderBy(F.bit_count("mask"), mask_indices("mask", "m"))
    return e.select("subject_id", F.col("m").cast("bigint").alias("m"), "mask", F.row_number().over(order).alias("position"))


@query("subset_order_sql", """
  SELECT subject_id, m, mask, row_number() OVER (PARTITION BY subject_id ORDER BY bit_count(mask), list_filter(generate_series(0, m - 1), lambda k: (mask >> k) & 1 = 1)) AS position
  FROM subject_masks WHERE mask > 0""")
def subset_order_sql(spark, sf):
    """Cue subsets from SQL text, by the registered table function."""
    table_functions.register(spark)
    subjects = V.subjects(spark, sf).select("subject_id", F.col("m").cast("bigint").alias("m"))
    return spark.sql("SELECT s.subject_id, s.m, u.mask, u.position FROM {s} s, LATERAL subset_masks(s.m, 6) u", s=subjects)


@query("lattice_gaps", """
  SELECT subject_id, m, mask FROM lattice WHERE m >= 3 AND bit_count(mask) BETWEEN 2 AND m - 1 AND NOT v > 0.05""")
def lattice_gaps(spark, sf):
    """Subsets still to score when only those above 0.05 have been."""
    done = V.lattice(spark, sf).where(F.col("v") > 0.05)
    gaps, _ = L.missing_subsets(V.subjects(spark, sf), done)
    return gaps.select("subject_id", F.col("m").cast("bigint").alias("m"), "mask")


@query("lattice_sizes", """
  SELECT o_custkey AS subject_id, o_orderkey % 25 AS m,
         CASE WHEN o_orderkey % 25 > 20 THEN 'too many cues' WHEN o_orderkey % 25 > 6 THEN 'reduced' WHEN o_orderkey % 25 > 0 THEN 'full' ELSE 'no cues' END AS kind,
         CASE WHEN o_orderkey % 25 = 0 THEN 0 WHEN o_orderkey % 25 <= 6 THEN (1 << (o_orderkey % 25)) - 1 ELSE 2 * (o_orderkey % 25) + 1 END::BIGINT AS n_masks,
         CASE WHEN o_orderkey % 25 >= 3 THEN (1::BIGINT << (o_orderkey % 25)) - 2 - o_orderkey % 25 ELSE 0 END::BIGINT AS n_gaps
  FROM (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey)""")
def lattice_sizes(spark, sf):
    """Subjects of 0 to 24 cues: the masks to evaluate, the gaps while nothing is scored, and who is too large to be listed."""
    o = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject_id")).agg((F.max("o_orderkey") % 25).alias("m"))
    masks = L.expand_subsets(o).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_masks"))
    none = o.select("subject_id", F.lit(0).cast("bigint").alias("mask")).limit(0)
    gaps = L.gap_counts(o, none).select("subject_id", "n_gaps")
    _, unlisted = L.missing_subsets(o, none)
    large = unlisted.select("subject_id", F.lit(True).alias("large"))
    out = o.join(masks, "subject_id", "left").join(gaps, "subject_id", "left").join(large, "subject_id", "left")
    kind = F.when(F.col("large"), "too many cues").when(F.col("m") > 6, "reduced").when(F.col("m") > 0, "full").otherwise("no cues")
    return out.select("subject_id", "m", kind.alias("kind"), F.coalesce("n_masks", F.lit(0)).alias("n_masks"), "n_gaps")


@query("lattice_gate", """
  SELECT m, sum(CASE WHEN n = (1 << m) - 1 THEN 1 ELSE 0 END)::BIGINT AS n_complete, sum(CASE WHEN n <> (1 << m) - 1 THEN 1 ELSE 0 END)::BIGINT AS n_skipped
  FROM (SELECT subject_id, m, count(*) AS n FROM lattice WHERE mask > 0 AND v > 0.02 GROUP BY ALL) GROUP BY m""")
def lattice_gate(spark, sf):
    """Lattices that stay complete when values up to 0.02 count as missing."""
    full, skipped = L.build_lattice(checkpointed(V.lattice(spark, sf).where(F.col("v") > 0.02)))
    kept = full.where(F.col("mask") == 0).select("m", F.lit(1).alias("ok"))
    return kept.unionByName(skipped.select("m", F.lit(0).alias("ok"))).groupBy("m").agg(
        F.sum("ok").alias("n_complete"), F.sum(1 - F.col("ok")).alias("n_skipped")
    )


# Leakage ----------------------------------------------------------------------

@query("mpl_mean", """
  SELECT subject_id, mask, n_pairs, round(mean_mpl, 6) + 0.0 AS mpl FROM leaks WHERE mask > 0""")
def mpl_mean(spark, sf):
    leak = V.leaks(spark, sf).where(F.col("mask") > 0)
    return leak.select("subject_id", "mask", "leak.n_pairs", rounded("leak.mean").alias("mpl"))


@query("mpl_relational", """
  SELECT subject_id, mask, n_pairs, round(mean_mpl, 6) + 0.0 AS mpl, round(sup_mpl * 1000, 6) + 0.0 AS sup FROM leaks WHERE mask = (1 << m) - 1""")
def mpl_relational(spark, sf):
    b = V.long_beliefs(spark, sf, every_mask=False).where(F.col("mask") > 0)
    # Prior and posterior come from the same row, so the log shift needs no join.
    shift = b.where((F.col("p") > 0) & (F.col("full") > 0)).select("subject_id", "mask", "ord", F.log(F.col("full") / F.col("p")).alias("llr"))
    out = K.mpl_relational(shift, pairs(V.gallery_small(spark, sf)))
    return out.select("subject_id", "mask", "n_pairs", rounded("mean").alias("mpl"), rounded(F.col("sup") * 1000).alias("sup"))


@query("mpl_sup", """
  SELECT subject_id, mask, i, j, n_pairs, round(v * 1000, 6) + 0.0 AS sup FROM (
    SELECT a.subject_id, a.mask, p.i, p.j, abs(a.llr - b.llr) / d AS v, count(*) OVER (PARTITION BY a.subject_id, a.mask) AS n_pairs,
           row_number() OVER (PARTITION BY a.subject_id, a.mask ORDER BY abs(a.llr - b.llr) / d DESC, p.i, p.j) AS r
    FROM pairs_small p JOIN shifts a ON a.ord = p.i JOIN shifts b ON b.ord = p.j AND a.subject_id = b.subject_id AND a.mask = b.mask WHERE a.mask > 0)
  WHERE r = 1""")
def mpl_sup(spark, sf):
    leak = V.leaks(spark, sf).where(F.col("mask") > 0).select("subject_id", "mask", "leak.*")
    g = V.gallery_small(spark, sf)
    names = lambda side: F.broadcast(g.select(F.col("pos").alias(side), F.col("ord").alias(f"{side}_ord")))
    out = leak.join(names("i"), "i").join(names("j"), "j")
    return out.select("subject_id", "mask", F.col("i_ord").alias("i"), F.col("j_ord").alias("j"), "n_pairs", rounded(F.col("sup") * 1000).alias("sup"))


sql_view("robust_rows", """
  SELECT a.subject_id, a.m, a.mask, a.ord, ln(greatest(b.p, 0.001) / greatest(a.p, 0.001)) AS llr FROM beliefs a JOIN beliefs b
  ON a.subject_id = b.subject_id AND a.ord = b.ord AND b.mask = 0 WHERE greatest(a.p, b.p) >= 0.001""")


@query("mpl_robust", """
  SELECT l.subject_id, l.mask, round(l.mean_mpl, 6) + 0.0 AS raw, round(coalesce(r.robust, 0.0), 6) + 0.0 AS robust FROM leaks l
  LEFT JOIN (SELECT a.subject_id, a.mask, avg(abs(a.llr - b.llr) / d) * 1000 AS robust
             FROM pairs_small p JOIN robust_rows a ON a.ord = p.i JOIN robust_rows b ON b.ord = p.j AND a.subject_id = b.subject_id AND a.mask = b.mask GROUP BY ALL) r
  ON l.subject_id = r.subject_id AND l.mask = r.mask WHERE l.mask > 0""")
def mpl_robust(spark, sf):
    both = K.mpl(V.leaks(spark, sf).where(F.col("mask") > 0), V.geometry_small(spark, sf), tau=1e-3, name="guarded")
    return both.select("subject_id", "mask", rounded("leak.mean").alias("raw"), rounded("guarded.mean").alias("robust"))


@query("mpl_summary", """
  SELECT count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(quantile_cont(x, 0.5), 6) + 0.0 AS median, round(max(x), 6) + 0.0 AS max, round(min(x), 6) + 0.0 AS min
  FROM (SELECT sup_mpl * 1000 AS x FROM leaks WHERE mask = (1 << m) - 1)""")
def mpl_summary(spark, sf):
    leak = K.mpl(V.wide_beliefs(spark, sf, every_mask=False), V.geometry_small(spark, sf)).where(F.col("mask") > 0)
    x = leak.select((F.col("leak.sup") * 1000).alias("x"))
    out = summarise(x, [], [F.count("x").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("max"), F.min("x").alias("min")], {"median": ("x", 0.5)}, at_most=V.most_rows(spark, sf))
    return out.select("n", *[rounded(c).alias(c) for c in ("mean", "median", "max", "min")])


@query("top_leaks", """
  SELECT subject_id, mask, round(sup_mpl * 1000, 6) + 0.0 AS sup FROM leaks WHERE mask = (1 << m) - 1 ORDER BY round(sup_mpl * 1000, 6) DESC, subject_id LIMIT 5""")
def top_leaks(spark, sf):
    leak = K.mpl(V.wide_beliefs(spark, sf, every_mask=False), V.geometry_small(spark, sf)).where(F.col("mask") > 0)
    return leak.select("subject_id", "mask", rounded(F.col("leak.sup") * 1000).alias("sup")).orderBy(F.col("sup").desc(), "subject_id").limit(5)


# A gallery that grows with the customers, and beliefs of every region over it.
sql_view("gallery_customers", """
  SELECT c_custkey AS ord, ((c_custkey * 7919) % 120001) / 1000.0 - 60.0 AS lat, ((c_custkey * 104729) % 360007) / 1000.0 - 180.0 AS lon FROM customer""")
sql_view("customer_shifts", """
  SELECT r_regionkey AS subject_id, c_custkey AS ord,
         ln(CAST(1 + (c_custkey * 31 + r_regionkey * 17 + CAST(floor(abs(c_acctbal)) AS BIGINT)) % 997 AS DOUBLE)) - ln(CAST(1 + (c_custkey * 13 + r_regionkey * 29) % 991 AS DOUBLE)) AS llr
  FROM customer CROSS JOIN region WHERE (c_custkey + r_regionkey) % 10 <> 0""")
sql_view("customer_pairs", f"""
  SELECT a.ord AS i, b.ord AS j, {sql_haversine('a.', 'b.')} AS d FROM gallery_customers a JOIN gallery_customers b ON a.ord < b.ord""")


def _customer_beliefs(spark, sf):
    c = V.table(spark, sf, "customer")
    gallery = c.select(F.col("c_custkey").alias("ord"), (((F.col("c_custkey") * 7919) % 120001) / 1000.0 - 60.0).alias("lat"), (((F.col("c_custkey") * 104729) % 360007) / 1000.0 - 180.0).alias("lon"))
    r = F.broadcast(V.table(spark, sf, "region").select("r_regionkey"))  # five rows
    both = c.join(r, (F.col("c_custkey") + F.col("r_regionkey")) % 10 != 0)
    up = 1 + (F.col("c_custkey") * 31 + F.col("r_regionkey") * 17 + F.floor(F.abs("c_acctbal")).cast("bigint")) % 997
    down = 1 + (F.col("c_custkey") * 13 + F.col("r_regionkey") * 29) % 991
    return both.select(F.col("r_regionkey").alias("subject_id"), F.col("c_custkey").alias("ord"), (F.log(up.cast("double")) - F.log(down.cast("double"))).alias("llr")), gallery


@query("mpl_large_gallery", """
  SELECT subject_id, count(*) AS n_pairs, round(avg(v) * 1000, 6) + 0.0 AS mpl, round(max(v) * 1000, 6) + 0.0 AS sup FROM (
    SELECT a.subject_id, abs(a.llr - b.llr) / d AS v FROM customer_pairs p JOIN customer_shifts a ON a.ord = p.i
    JOIN customer_shifts b ON b.ord = p.j AND a.subject_id = b.subject_id WHERE d > 0) GROUP BY subject_id""")
def mpl_large_gallery(spark, sf):
    """Every pair of a gallery of any size, tile by tile."""
    shift, gallery = _customer_beliefs(spark, sf)
    out = pair_tiles.mpl_tiled(shift, gallery, keys=["subject_id"])
    return out.select("subject_id", "n_pairs", rounded("mean").alias("mpl"), rounded(F.col("sup") * 1000).alias("sup"))


@query("mpl_large_sup", """
  SELECT subject_id, i, j, round(v * 1000, 6) + 0.0 AS sup, true AS few_looked_at FROM (
    SELECT a.subject_id, p.i, p.j, abs(a.llr - b.llr) / d AS v, row_number() OVER (PARTITION BY a.subject_id ORDER BY abs(a.llr - b.llr) / d DESC, p.i, p.j) AS r
    FROM customer_pairs p JOIN customer_shifts a ON a.ord = p.i JOIN customer_shifts b ON b.ord = p.j AND a.subject_id = b.subject_id WHERE d > 0) WHERE r = 1""")
def mpl_large_sup(spark, sf):
    """The leakiest pair by branch and bound, and whether under half of the pairs had to be looked at."""
    shift, gallery = _customer_beliefs(spark, sf)
    out = pair_tiles.mpl_sup(shift, gallery, keys=["subject_id"])
    labels = shift.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    few = F.col("n_checked") * 4 < F.col("n") * (F.col("n") - 1)
    return out.join(labels, "subject_id").select("subject_id", "i", "j", rounded(F.col("sup") * 1000).alias("sup"), few.alias("few_looked_at"))


@query("leave_one_out", """
  SELECT k, n, round(median, 6) + 0.0 AS median, round(max, 6) + 0.0 AS max FROM (
    SELECT (log2(mask))::INT AS k, count(*) AS n, quantile_cont(v, 0.5) AS median, max(v) AS max FROM lattice WHERE bit_count(mask) = 1 GROUP BY ALL)""")
def leave_one_out(spark, sf):
    single = V.lattice(spark, sf).where(F.bit_count("mask") == 1).withColumn("k", F.log2("mask").cast("int"))
    out = summarise(single, ["k"], [F.count(F.lit(1)).alias("n"), F.max("v").alias("max")], {"median": ("v", 0.5)}, at_most=V.most_rows(spark, sf))
    return out.select("k", "n", rounded("median").alias("median"), rounded("max").alias("max"))


sql_view("uniform_leaks", """
  SELECT a.subject_id, a.m, a.mask, avg(abs(ln(a.p) - ln(b.p)) / d) * 1000 AS v
  FROM pairs_small p JOIN beliefs a ON a.ord = p.i JOIN beliefs b ON b.ord = p.j AND a.subject_id = b.subject_id AND a.mask = b.mask GROUP BY ALL""")


@query("leave_one_in", """
  SELECT subject_id, k, round(into_uniform, 6) + 0.0 AS in_vs_uniform, round(into_full, 6) + 0.0 AS in_vs_full, round(o, 6) + 0.0 AS mpl_out,
         CASE WHEN into_uniform > 0.001 AND into_uniform - o > 0.02 THEN CASE WHEN o < 0.005 THEN 'fully redundant' ELSE 'suppressed' END ELSE 'none' END AS redundancy
  FROM (SELECT l.subject_id, k, max(CASE WHEN l.mask = ((1 << l.m) - 1) - (1 << k) THEN u.v END) AS into_uniform,
               max(CASE WHEN l.mask = ((1 << l.m) - 1) - (1 << k) THEN l.v END) AS into_full, max(CASE WHEN l.mask = 1 << k THEN l.v END) AS o
        FROM lattice_cues l JOIN uniform_leaks u ON l.subject_id = u.subject_id AND l.mask = u.mask GROUP BY ALL)""")
def leave_one_in(spark, sf):
    g = V.geometry_small(spark, sf)
    flat = F.array(*[F.lit(1.0 / len(g.labels))] * len(g.labels))
    leak = K.mpl(V.leaks(spark, sf), g, post=flat, name="flat")
    rows = leak.select(
        "subject_id", "m", "mask", F.col("flat.mean").alias("u"),
        F.when(F.col("mask") == 0, 0.0).otherwise(F.col("leak.mean")).alias("v"),
        F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"),
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k"))
    only = F.col("mask") == full_mask("m") - bit
    out = rows.groupBy("subject_id", "k").agg(
        F.max(F.when(only, F.col("u"))).alias("into_uniform"), F.max(F.when(only, F.col("v"))).alias("into_full"),
        F.max(F.when(F.col("mask") == bit, F.col("v"))).alias("o"),
    )
    redundant = (F.col("into_uniform") > 0.001) & (F.col("into_uniform") - F.col("o") > 0.02)
    tag = F.when(~redundant, "none").when(F.col("o") < 0.005, "fully redundant").otherwise("suppressed")
    return out.select("subject_id", "k", rounded("into_uniform").alias("in_vs_uniform"), rounded("into_full").alias("in_vs_full"), rounded("o").alias("mpl_out"), tag.alias("redundancy"))


@query("instrument_check", """
  SELECT b.subject_id, rank_true, round(p_masked - p_full, 6) + 0.0 AS delta_true, rank_true <= 3 AS top3, round(r, 6) + 0.0 AS cov_corr
  FROM (SELECT subject_id, max(CASE WHEN mask = 0 AND ord = truth THEN rk END) AS rank_true, max(CASE WHEN mask = 0 AND ord = truth THEN p END) AS p_full,
               max(CASE WHEN mask = (1 << m) - 1 AND ord = truth THEN p END) AS p_masked
        FROM (SELECT b.*, truth, row_number() OVER (PARTITION BY b.subject_id, mask ORDER BY p DESC, ord) AS rk FROM beliefs b JOIN subjects s ON b.subject_id = s.subject_id) GROUP BY 1) b
  JOIN (SELECT subject_id, CASE WHEN count(DISTINCT bit_count(mask)) > 1 THEN corr(bit_count(mask) / m, v) END AS r FROM lattice WHERE mask > 0 GROUP BY ALL) c ON b.subject_id = c.subject_id""")
def instrument_check(spark, sf):
    g = V.gallery_small(spark, sf)
    leak = V.leaks(spark, sf).join(F.broadcast(g.select(F.col("ord").alias("truth"), F.col("pos").alias("at"))), "truth")
    own = lambda p: F.element_at(F.col(p), (F.col("at") + 1).cast("int"))
    ahead = F.size(F.filter("full", lambda x, i: (x > own("full")) | ((x == own("full")) & (i < F.col("at")))))
    rows = leak.select(
        "subject_id", "m", "mask", (ahead + 1).alias("rank_true"), own("full").alias("p_full"), own("p").alias("p_true"),
        F.when(F.col("mask") > 0, F.bit_count("mask") / F.col("m")).alias("cov"), F.when(F.col("mask") > 0, F.col("leak.mean")).alias("v"),
    )
    out = rows.groupBy("subject_id").agg(
        F.max("rank_true").alias("rank_true"),
        (F.max(F.when(F.col("mask") == full_mask("m"), F.col("p_true"))) - F.max("p_full")).alias("delta"),
        F.when(F.max("cov") > F.min("cov"), F.corr("cov", "v")).alias("r"),
    )
    return out.select("subject_id", "rank_true", rounded("delta").alias("delta_true"), (F.col("rank_true") <= 3).alias("top3"), rounded("r").alias("cov_corr"))


# Scaling laws --------------------------------------------------------------------

TAUS = (0.5, 1.0, 2.0, 5.0)
BETAS = (1.0, 2.0, 3.0, 5.0, 8.0)

sql_view("tempered", """
  SELECT subject_id, m, mask, ord, tau, e / sum(e) OVER (PARTITION BY subject_id, mask, tau) AS p
  FROM (SELECT subject_id, m, mask, ord, tau, exp(l - max(l) OVER (PARTITION BY subject_id, mask, tau)) AS e
        FROM (SELECT *, ln(greatest(p, 1e-12)) / tau AS l FROM beliefs CROSS JOIN (VALUES (0.5), (1.0), (2.0), (5.0)) t(tau) WHERE mask IN (0, (1 << m) - 1)))""")


@query("tau_scaling", """
  WITH s AS (SELECT a.subject_id, a.tau, a.ord, ln(b.p / a.p) AS llr FROM tempered a JOIN tempered b
             ON a.subject_id = b.subject_id AND a.ord = b.ord AND a.tau = b.tau AND b.mask = 0 AND a.mask > 0),
       v AS (SELECT a.subject_id, a.tau, avg(abs(a.llr - b.llr) / d) * 1000 AS x FROM pairs_small p JOIN s a ON a.ord = p.i JOIN s b ON b.ord = p.j AND a.subject_id = b.subject_id AND a.tau = b.tau GROUP BY ALL)
  SELECT v.tau::DOUBLE AS tau, count(*) AS n, round(avg(v.x / o.x), 6) + 0.0 AS mean_ratio, round(1.0 / v.tau, 6) + 0.0 AS expected
  FROM v JOIN v o ON v.subject_id = o.subject_id AND o.tau = 1.0 WHERE o.x > 0 GROUP BY v.tau""")
def tau_scaling(spark, sf):
    ends = V.long_beliefs(spark, sf, every_mask=False).where(F.col("mask") > 0).select("subject_id", "ord", "p", "full")
    grid = ends.select("subject_id", "ord", "p", "full", F.explode(F.array(*map(F.lit, TAUS))).alias("tau"))
    keys = ("subject_id", "tau")
    grid = B.temper(grid, keys=keys, name="prior_p").drop("p").withColumnRenamed("full", "p")
    grid = B.temper(grid, keys=keys, name="post_p")
    arrays = F.array_sort(F.collect_list(F.struct("ord", "prior_p", "post_p")))
    wide = grid.groupBy(*keys).agg(arrays.alias("a")).select(
        *keys, F.transform("a", lambda s: s["prior_p"]).alias("p"), F.transform("a", lambda s: s["post_p"]).alias("full")
    )
    x = K.mpl(wide, V.geometry_small(spark, sf)).select(*keys, F.col("leak.mean").alias("x"))
    # tau = 1 belongs to the grid, so the base value is found within the subject's few rows.
    base = F.max(F.when(F.col("tau") == 1.0, F.col("x"))).over(W.partitionBy("subject_id"))
    out = x.withColumn("base", base).where(F.col("base") > 0).groupBy("tau").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") / F.col("base")).alias("r"))
    return out.select("tau", "n", rounded("r").alias("mean_ratio"), rounded(1.0 / F.col("tau")).alias("expected"))


sql_view("method_raw", """
  SELECT 'independent' AS method, subject_id, m, mask, ord, greatest(0.0, least(1.0, 60.0 * score)) AS r FROM score_rows
  UNION ALL SELECT 'allocate', subject_id, m, mask, ord, greatest(0.0, 60.0 * score) FROM score_rows WHERE mask IN (0, (1 << m) - 1)
  UNION ALL SELECT 'logprob', subject_id, m, mask, ord, 1.0 / (1.0 + exp(-60.0 * score)) FROM score_rows WHERE mask IN (0, (1 << m) - 1)""")
sql_view("shared_out", """
  SELECT method, subject_id, m, mask, ord, (0.98 * CASE WHEN t > 0 THEN r / t ELSE 1.0 / n END + 0.02 / n) AS p
  FROM (SELECT *, sum(r) OVER w AS t, count(*) OVER w AS n FROM method_raw WINDOW w AS (PARTITION BY method, subject_id, mask))""")
sql_view("allocated", "SELECT subject_id, m, mask, ord, p FROM shared_out WHERE method = 'independent'")
sql_view("alloc_shifts", """
  SELECT a.subject_id, a.m, a.mask, a.ord, ln(b.p / a.p) AS llr FROM allocated a JOIN allocated b ON a.subject_id = b.subject_id AND a.ord = b.ord AND b.mask = 0""")
sql_view("alloc_leaks", """
  SELECT a.subject_id, a.m, a.mask, avg(abs(a.llr - b.llr) / d) * 1000 AS v
  FROM pairs_small p JOIN alloc_shifts a ON a.ord = p.i JOIN alloc_shifts b ON b.ord = p.j AND a.subject_id = b.subject_id AND a.mask = b.mask GROUP BY ALL""")


@query("power_scaling", """
  WITH best AS (SELECT subject_id, arg_max(mask, (round(v, 9), -mask)) AS mask FROM alloc_leaks WHERE mask > 0 GROUP BY subject_id HAVING max(v) > 1e-9),
       base AS (SELECT subject_id, side, ord, CASE WHEN sum(b) OVER w > 0 THEN b / sum(b) OVER w ELSE p END AS b FROM (
                  SELECT a.subject_id, CASE WHEN a.mask = 0 THEN 'post' ELSE 'prior' END AS side, a.ord, a.p,
                         greatest(0.0, (a.p - 0.02 / count(*) OVER (PARTITION BY a.subject_id, a.mask)) / 0.98) AS b
                  FROM allocated a JOIN best ON a.subject_id = best.subject_id AND (a.mask = best.mask OR a.mask = 0)) WINDOW w AS (PARTITION BY subject_id, side)),
       re AS (SELECT subject_id, side, ord, beta, 0.98 * CASE WHEN sum(q) OVER w > 0 THEN q / sum(q) OVER w ELSE 1.0 / count(*) OVER w END + 0.02 / count(*) OVER w AS p
              FROM (SELECT *, pow(b, beta) AS q FROM base CROSS JOIN (VALUES (1.0::DOUBLE), (2.0), (3.0), (5.0), (8.0)) t(beta)) WINDOW w AS (PARTITION BY subject_id, side, beta)),
       s AS (SELECT a.subject_id, a.beta, a.ord, ln(b.p / a.p) AS llr FROM re a JOIN re b ON a.subject_id = b.subject_id AND a.ord = b.ord AND a.beta = b.beta AND a.side = 'prior' AND b.side = 'post'),
       v AS (SELECT a.subject_id, a.beta, avg(abs(a.llr - b.llr) / d) * 1000 AS x FROM pairs_small p JOIN s a ON a.ord = p.i JOIN s b ON b.ord = p.j AND a.subject_id = b.subject_id AND a.beta = b.beta GROUP BY ALL)
  SELECT v.beta::DOUBLE AS beta, count(*) AS n, round(avg(v.x / o.x), 5) + 0.0 AS mean_ratio
  FROM v JOIN v o ON v.subject_id = o.subject_id AND o.beta = 1.0 WHERE o.x > 1e-9 GROUP BY v.beta""")
def power_scaling(spark, sf):
    g = V.geometry_small(spark, sf)
    leak = K.mpl(V.wide_beliefs(spark, sf, method="independent"), g).where(F.col("mask") > 0)
    rank = F.struct(F.round("leak.mean", 9), -F.col("mask"))
    best = leak.groupBy("subject_id").agg(F.max_by(F.struct("p", "full"), rank).alias("b"), F.max("leak.mean").alias("v")).where(F.col("v") > 1e-9)
    sides = best.select("subject_id", F.posexplode(F.arrays_zip(F.col("b.p").alias("prior"), F.col("b.full").alias("post"))).alias("ord", "z"))
    sides = sides.select(
        "subject_id", "ord",
        F.inline(F.array(
            F.struct(F.lit("prior").alias("side"), F.col("z.prior").alias("p")),
            F.struct(F.lit("post").alias("side"), F.col("z.post").alias("p")),
        )),
    )
    base = B.unsmooth(sides, keys=("subject_id", "side"))
    grid = base.select("subject_id", "ord", "side", "p", F.explode(F.array(*map(F.lit, BETAS))).alias("beta"))
    keys = ("subject_id", "side", "beta")
    wide = B.to_wide(B.power_rescale(grid, keys=keys), keys=keys)
    both = wide.groupBy("subject_id", "beta").agg(
        F.max_by("p", (F.col("side") == "prior").cast("int")).alias("p"), F.max_by("p", (F.col("side") == "post").cast("int")).alias("full")
    )
    x = K.mpl(both, g).select("subject_id", "beta", F.col("leak.mean").alias("x"))
    first = F.max(F.when(F.col("beta") == 1.0, F.col("x"))).over(W.partitionBy("subject_id"))
    out = x.withColumn("first", first).where(F.col("first") > 1e-9).groupBy("beta").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") / F.col("first")).alias("r"))
    return out.select("beta", "n", rounded("r", 5).alias("mean_ratio"))


# Noise, controls on the lattice, method comparison ----------------------------------
# Repeated runs: run r shifts every score by a fixed small pattern.

RUNS = 4
sql_view("run_beliefs", """
  SELECT subject_id, cond, run, ord, e / sum(e) OVER (PARTITION BY subject_id, cond, run) AS p
  FROM (SELECT b.subject_id, CASE WHEN b.mask = 0 THEN 'full' ELSE 'masked' END AS cond, run, b.ord,
               b.p * exp((((b.subject_id * 7 + run * 13 + b.ord * 29 + CASE WHEN b.mask = 0 THEN 0 ELSE 5 END) % 11) - 5) / 1000.0) AS e
        FROM beliefs b CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS run) WHERE b.mask IN (0, (1 << b.m) - 1))""")
sql_view("run_pairs", """
  SELECT a.subject_id, CASE WHEN a.cond = b.cond THEN 'noise' ELSE 'signal' END AS kind, a.cond AS ca, a.run AS ra, b.cond AS cb, b.run AS rb, a.ord, ln(b.p / a.p) AS llr
  FROM run_beliefs a JOIN run_beliefs b ON a.subject_id = b.subject_id AND a.ord = b.ord
   AND ((a.cond = b.cond AND a.run < b.run) OR (a.cond = 'masked' AND b.cond = 'full'))""")


@query("noise_floor", """
  WITH v AS (SELECT a.subject_id, a.kind, avg(abs(a.llr - b.llr) / d) * 1000 AS x FROM pairs_small p JOIN run_pairs a ON a.ord = p.i
             JOIN run_pairs b ON b.ord = p.j AND a.subject_id = b.subject_id AND a.ca = b.ca AND a.ra = b.ra AND a.cb = b.cb AND a.rb = b.rb
             GROUP BY a.subject_id, a.kind, a.ca, a.ra, a.cb, a.rb),
       f AS (SELECT subject_id, max(x) AS floor_mpl FROM v WHERE kind = 'noise' GROUP BY subject_id)
  SELECT subject_id, round(max(floor_mpl), 6) + 0.0 AS noise_floor, round(quantile_cont(x, 0.5), 6) + 0.0 AS signal_median,
         round(quantile_cont(x, 0.5) / max(floor_mpl), 4) + 0.0 AS snr, round(avg(CASE WHEN x > floor_mpl THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_above
  FROM v JOIN f USING (subject_id) WHERE kind = 'signal' GROUP BY subject_id""")
def noise_floor(spark, sf):
    b = V.long_beliefs(spark, sf, every_mask=False)
    both = b.where(F.col("mask") > 0).select(
        "subject_id", "ord",
        F.inline(F.array(F.struct(F.lit("full").alias("cond"), F.col("full").alias("p")), F.struct(F.lit("masked").alias("cond"), F.col("p").alias("p")))),
    )
    runs = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run"))
    shift = F.when(F.col("cond") == "full", 0).otherwise(5)
    noise = ((F.col("subject_id") * 7 + F.col("run") * 13 + F.col("ord") * 29 + shift) % 11 - 5) / F.lit(1000.0)
    keys = ("subject_id", "cond", "run")
    wide = B.to_wide(B.normalise(runs.withColumn("e", F.col("p") * F.exp(noise)), "e", keys), keys=keys)
    out = reports.noise_floor(wide, V.geometry_small(spark, sf))
    return out.select("subject_id", *[rounded(c).alias(c) for c in ("noise_floor", "signal_median")], rounded("snr", 4).alias("snr"), rounded("share_above").alias("share_above"))


@query("noise_free_floor", """
  SELECT subject_id, 0.0::DOUBLE AS noise_floor, s.x > 0 AS above_nothing FROM (
    SELECT a.subject_id, avg(abs(ln(a.full_p / a.p) - ln(b.full_p / b.p)) / d) AS x FROM pairs_small q
    JOIN (SELECT f.subject_id, f.ord, f.p AS full_p, m.p FROM beliefs f JOIN beliefs m ON f.subject_id = m.subject_id AND f.ord = m.ord AND f.mask = 0 AND m.mask = (1 << m.m) - 1) a ON a.ord = q.i
    JOIN (SELECT f.subject_id, f.ord, f.p AS full_p, m.p FROM beliefs f JOIN beliefs m ON f.subject_id = m.subject_id AND f.ord = m.ord AND f.mask = 0 AND m.mask = (1 << m.m) - 1) b ON b.ord = q.j AND a.subject_id = b.subject_id
    GROUP BY a.subject_id) s""")
def noise_free_floor(spark, sf):
    """A scorer that repeats itself exactly: the floor is zero, and the ratio stays finite."""
    b = V.wide_beliefs(spark, sf, every_mask=False).where(F.col("mask") > 0)
    both = F.array(F.struct(F.lit("full").alias("cond"), F.col("full").alias("p")), F.struct(F.lit("masked").alias("cond"), F.col("p").alias("p")))
    runs = b.select("subject_id", F.inline(both)).withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    out = reports.noise_floor(runs, V.geometry_small(spark, sf))
    return out.select("subject_id", rounded("noise_floor").alias("noise_floor"), ((F.col("snr") > 0) & (F.col("snr") < float("inf"))).alias("above_nothing"))


@query("competitive_subset", """
  SELECT subject_id, label, rank FROM (
    SELECT subject_id, label, row_number() OVER (PARTITION BY subject_id ORDER BY CASE WHEN ord = truth THEN 0 ELSE 1 END, p DESC, ord) - 1 AS rank
    FROM beliefs JOIN subjects USING (subject_id) WHERE mask = 0) WHERE rank < 5""")
def competitive_subset(spark, sf):
    return reports.competitive_subset(V.long_beliefs(spark, sf, every_mask=False).where(F.col("mask") == 0))


def method_rows(spark, sf):
    """Full and masked view per subject for each elicitation method."""
    g = V.geometry_small(spark, sf)
    out = None
    for method in scoring.METHODS:
        wide = K.mpl(V.wide_beliefs(spark, sf, method=method, every_mask=False), g).where(F.col("mask") > 0)
        one = wide.select(F.lit(method).alias("method"), "subject_id", "truth", "p", "full", F.col("leak.mean").alias("mpl"))
        out = one if out is None else out.unionByName(one)
    return out


sql_view("method_beliefs", """
  SELECT 'softmax' AS method, subject_id, m, mask, ord, p FROM beliefs WHERE mask IN (0, (1 << m) - 1)
  UNION ALL SELECT method, subject_id, m, mask, ord, p FROM shared_out WHERE mask IN (0, (1 << m) - 1)""")
sql_view("method_views", """
  SELECT f.method, f.subject_id, f.ord, s.truth, f.p AS pf, m.p AS pm FROM method_beliefs f JOIN method_beliefs m
   ON f.method = m.method AND f.subject_id = m.subject_id AND f.ord = m.ord AND f.mask = 0 AND m.mask > 0 JOIN subjects s ON s.subject_id = f.subject_id""")


@query("method_comparison", """
  WITH per AS (SELECT method, subject_id, 1 + sum(pf * log2(pf + 1e-12)) / log2(count(*)) AS conc, 0.5 * sum(abs(pf - pm)) AS tv,
                      max(CASE WHEN ord = truth THEN pf END) AS tf, max(CASE WHEN ord = truth THEN pm END) AS tm,
                      arg_max((pf, pm), (pf, -ord)) FILTER (WHERE ord <> truth) AS d FROM method_views GROUP BY ALL),
       leak AS (SELECT a.method, a.subject_id, avg(abs(ln(a.pf / a.pm) - ln(b.pf / b.pm)) / d) * 1000 AS v FROM pairs_small p
                JOIN method_views a ON a.ord = p.i JOIN method_views b ON b.ord = p.j AND a.subject_id = b.subject_id AND a.method = b.method GROUP BY ALL),
       r AS (SELECT per.method, conc, tv, v, ln(tm / d[2]) - ln(tf / d[1]) AS dlo FROM per JOIN leak USING (method, subject_id))
  SELECT method, count(*) AS n, round(quantile_cont(conc, 0.5), 6) + 0.0 AS conc_median, round(quantile_cont(dlo, 0.5), 6) + 0.0 AS dlogodds_median,
         sum(CASE WHEN dlo < 0 THEN 1 ELSE 0 END)::BIGINT AS n_negative, round(quantile_cont(tv, 0.5), 6) + 0.0 AS tv_median,
         round(quantile_cont(v, 0.5), 6) + 0.0 AS mpl_median, sum(CASE WHEN v > 1e-6 THEN 1 ELSE 0 END)::BIGINT AS n_nonzero
  FROM r GROUP BY method""")
def method_comparison(spark, sf):
    rows = method_rows(spark, sf)
    long = rows.select("method", "subject_id", "truth", "mpl", F.posexplode(F.arrays_zip("full", "p")).alias("pos", "z"))
    g = V.gallery_small(spark, sf).select("pos", "ord", "label")
    long = long.join(F.broadcast(g), "pos").select("method", "subject_id", "truth", "mpl", "ord", F.col("z.full").alias("pf"), F.col("z.p").alias("pm"))
    per = reports.method_effects(long)
    out = summarise(
        per, ["method"],
        [F.count(F.lit(1)).alias("n"), F.count_if(F.col("dlo") < 0).alias("n_negative"), F.count_if(F.col("mpl") > 1e-6).alias("n_nonzero")],
        {"conc_median": ("conc", 0.5), "dlogodds_median": ("dlo", 0.5), "tv_median": ("tv", 0.5), "mpl_median": ("mpl", 0.5)},
        at_most=V.most_rows(spark, sf),
    )
    return out.select("method", "n", "n_negative", "n_nonzero", *[rounded(c).alias(c) for c in ("conc_median", "dlogodds_median", "tv_median", "mpl_median")])


sql_view("coarse_clusters", f"""
  SELECT label, rep FROM (
    WITH RECURSIVE ordered AS (SELECT row_number() OVER (ORDER BY label) AS i, label, lat, lon FROM gallery_small),
    walk AS (SELECT 1::BIGINT AS i, label AS rep, [label] AS centres FROM ordered WHERE i = 1
      UNION ALL
      SELECT w.i + 1, coalesce(hit.rep, o.label), CASE WHEN hit.rep IS NULL THEN list_append(w.centres, o.label) ELSE w.centres END
      FROM walk w JOIN ordered o ON o.i = w.i + 1
      LEFT JOIN LATERAL (SELECT min(c.label) AS rep FROM ordered c WHERE list_contains(w.centres, c.label)
                         AND {sql_haversine('o.', 'c.')} < 4000) hit ON true)
    SELECT o.label, w.rep FROM walk w JOIN ordered o ON o.i = w.i)""")
sql_view("merged_beliefs", """
  SELECT subject_id, m, mask, rep AS label, min(ord) AS ord, sum(p) AS p FROM beliefs JOIN coarse_clusters USING (label) GROUP BY ALL""")


@query("merge_distribution", """
  SELECT subject_id, mask, label, round(p, 6) + 0.0 AS p FROM merged_beliefs""")
def merge_distribution(spark, sf):
    c = F.broadcast(clusters(V.gallery_small(spark, sf), 4000.0))  # one row per gallery label
    m = B.merge(V.long_beliefs(spark, sf), c)
    return m.select("subject_id", "mask", "label", rounded("p").alias("p"))


@query("logodds_distractor", """
  WITH d AS (SELECT b.subject_id, arg_max(b.ord, (b.p, -b.ord)) AS dord FROM beliefs b JOIN subjects s ON b.subject_id = s.subject_id
             JOIN gallery_small g ON g.ord = s.truth JOIN coarse_clusters ct ON ct.label = g.label JOIN coarse_clusters cb ON cb.label = b.label
             WHERE b.mask = 0 AND cb.rep <> ct.rep GROUP BY b.subject_id),
       r AS (SELECT b.subject_id, max(CASE WHEN mask = 0 AND ord = truth THEN p END) AS tf, max(CASE WHEN mask > 0 AND ord = truth THEN p END) AS tm,
                    max(CASE WHEN mask = 0 AND ord = dord THEN p END) AS df, max(CASE WHEN mask > 0 AND ord = dord THEN p END) AS dm, any_value(dord) AS dord
             FROM beliefs b JOIN subjects s ON b.subject_id = s.subject_id JOIN d ON d.subject_id = b.subject_id WHERE mask IN (0, (1 << b.m) - 1) GROUP BY b.subject_id)
  SELECT r.subject_id, g.label AS distractor, round(tf, 6) + 0.0 AS p_true_full, round(tm, 6) + 0.0 AS p_true_masked,
         round(ln(tf / df), 6) + 0.0 AS logodds_full, round(ln(tm / dm), 6) + 0.0 AS logodds_masked FROM r JOIN gallery_small g ON g.ord = r.dord""")
def logodds_distractor(spark, sf):
    b = V.long_beliefs(spark, sf, every_mask=False).where(F.col("mask") > 0)
    g = V.gallery_small(spark, sf)
    reps = F.broadcast(clusters(g, 4000.0))
    truth = V.subjects(spark, sf).join(F.broadcast(g.select(F.col("ord").alias("truth"), "label")), "truth")
    out = B.logodds_distractor(b.select("subject_id", "label", "ord", F.col("full").alias("p")), b, truth, reps)
    return out.select("subject_id", "distractor", *[rounded(c).alias(c) for c in ("p_true_full", "p_true_masked", "logodds_full", "logodds_masked")])


@query("merge_radius_sweep", """
  SELECT r.km::DOUBLE AS km, r.n_clusters, round(avg(h.h0 - h.h1), 6) + 0.0 AS mean_entropy_drop, count(*) AS n
  FROM (SELECT 4000.0 AS km, count(DISTINCT rep) AS n_clusters FROM coarse_clusters UNION ALL SELECT 1.0, count(*) FROM gallery_small) r
  JOIN (SELECT 4000.0 AS km, subject_id, sum(CASE WHEN mask = 0 THEN 0 ELSE -p * log2(p) END) AS h0, sum(CASE WHEN mask = 0 THEN -p * log2(p) ELSE 0 END) AS h1
        FROM merged_beliefs WHERE mask IN (0, (1 << m) - 1) GROUP BY subject_id
        UNION ALL SELECT 1.0, subject_id, sum(CASE WHEN mask = 0 THEN 0 ELSE -p * log2(p) END), sum(CASE WHEN mask = 0 THEN -p * log2(p) ELSE 0 END)
        FROM beliefs WHERE mask IN (0, (1 << m) - 1) GROUP BY subject_id) h ON r.km = h.km GROUP BY ALL""")
def merge_radius_sweep(spark, sf):
    """Entropy drop under two merge radii: clustering is post-processing over stored beliefs."""
    g = V.gallery_small(spark, sf)
    maps = None
    for km in (1.0, 4000.0):
        one = clusters(g, km).withColumn("km", F.lit(km))
        maps = one if maps is None else maps.unionByName(one)
    b = V.long_beliefs(spark, sf, every_mask=False).where(F.col("mask") > 0)
    out = reports.entropy_drops(b, maps)
    return out.select("km", "n_clusters", rounded("drop").alias("mean_entropy_drop"), "n")

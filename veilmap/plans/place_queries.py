"""Geometry, accuracy, calibration and descriptive reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import coordinate_key, country_of_label, place_of_label, slug
from ..functions.fixed_values import CUE_STOP_WORDS
from ..operators import beliefs as B
from ..operators import cues as Q
from ..operators import evaluation as E
from ..operators import geometry as G
from ..operators import leakage as K
from ..operators import quadtree as T
from ..operators.scale import largest_group, spread, summarise
from ..session import scratch_path
from . import views as V
from .registry import query, sql_view
from .views import rounded, sql_haversine

CLUSTER_KM = 25.0

sql_view("place_clusters", f"""
  SELECT label, rep FROM (
    WITH RECURSIVE ordered AS (SELECT row_number() OVER (ORDER BY label) AS i, label, lat, lon FROM gallery_large),
    walk AS (SELECT 1::BIGINT AS i, label AS rep, [label] AS centres FROM ordered WHERE i = 1
      UNION ALL
      SELECT w.i + 1, coalesce(hit.rep, o.label), CASE WHEN hit.rep IS NULL THEN list_append(w.centres, o.label) ELSE w.centres END
      FROM walk w JOIN ordered o ON o.i = w.i + 1
      LEFT JOIN LATERAL (SELECT min(c.label) AS rep FROM ordered c WHERE list_contains(w.centres, c.label)
                         AND {sql_haversine('o.', 'c.')} < 25) hit ON true)
    SELECT o.label, w.rep FROM walk w JOIN ordered o ON o.i = w.i)""")


@query("cluster_reps", "SELECT label, rep FROM place_clusters")
def cluster_reps(spark, sf):
    return G.clusters(V.gallery_large(spark, sf), CLUSTER_KM)


@query("centre_members", f"""
  SELECT g.label, c.label AS centre, round({sql_haversine('g.', 'c.')}, 6) + 0.0 AS d FROM gallery_large g
  JOIN gallery_large c ON {sql_haversine('g.', 'c.')} < 25 WHERE c.label IN (SELECT rep FROM place_clusters)""")
def centre_members(spark, sf):
    """Range join of all places with the cluster centres."""
    g = V.gallery_large(spark, sf)
    near = G.range_join(g, G.cluster_centres(g, CLUSTER_KM), CLUSTER_KM)
    return near.select(F.col("point").alias("label"), F.col("probe").alias("centre"), rounded("d").alias("d"))


@query("near_sites", f"""
  WITH s AS (SELECT lat, lon, min(label) AS label, count(*) AS n FROM gallery_large GROUP BY lat, lon)
  SELECT a.label AS i, b.label AS j, round({sql_haversine('a.', 'b.')}, 6) + 0.0 AS d, a.n * b.n AS n_pairs FROM s a JOIN s b ON a.label < b.label AND {sql_haversine('a.', 'b.')} < 2
  UNION ALL SELECT label, label, 0.0, n * (n - 1) // 2 FROM s WHERE n > 1""")
def near_sites(spark, sf):
    near = G.near_sites(V.gallery_large(spark, sf), 2.0)
    return near.select("i", "j", rounded("d").alias("d"), "n_pairs")


@query("hard_negatives", f"""
  SELECT subject_id, label, rank, round(d, 6) + 0.0 AS d FROM (
    SELECT q.ord AS subject_id, p.label, row_number() OVER (PARTITION BY q.ord ORDER BY {sql_haversine('q.', 'p.')}, p.ord) AS rank, {sql_haversine('q.', 'p.')} AS d
    FROM gallery_large q JOIN gallery_large p ON q.label <> p.label) WHERE rank <= 3
  UNION ALL SELECT ord, label, 0, 0.0 FROM gallery_large""")
def hard_negatives(spark, sf):
    g = V.gallery_large(spark, sf)
    truth = g.select(F.col("ord").alias("subject_id"), "label", "lat", "lon")
    out = G.hard_negatives(truth, g, 3)
    return out.select("subject_id", "label", "rank", rounded("d").alias("d"))


# A third of the customers stand within a square of about a kilometre, the others over the world.
sql_view("crowded_places", """
  SELECT c_name AS label, c_custkey AS ord,
         CASE WHEN c_custkey % 3 = 0 THEN 48.85 + (c_custkey * 7919::BIGINT) % 10007 / 1000000.0 ELSE (c_nationkey * 37) % 121 - 60 + (c_custkey * 13) % 4001 / 1000.0 END AS lat,
         CASE WHEN c_custkey % 3 = 0 THEN 2.35 + (c_custkey * 104729::BIGINT) % 10007 / 1000000.0 ELSE (c_nationkey * 73) % 360 - 180 + (c_custkey * 29) % 4001 / 1000.0 END AS lon
  FROM customer""")


def crowded_places(spark, sf):
    key, nation = F.col("c_custkey").cast("bigint"), F.col("c_nationkey")
    crowd = key % 3 == 0
    return V.table(spark, sf, "customer").select(
        F.col("c_name").alias("label"), F.col("c_custkey").alias("ord"),
        F.when(crowd, 48.85 + (key * 7919) % 10007 / F.lit(1000000.0)).otherwise((nation * 37) % 121 - 60 + (key * 13) % 4001 / F.lit(1000.0)).alias("lat"),
        F.when(crowd, 2.35 + (key * 104729) % 10007 / F.lit(1000000.0)).otherwise((nation * 73) % 360 - 180 + (key * 29) % 4001 / F.lit(1000.0)).alias("lon"),
    )


@query("crowded_pairs", f"""
  SELECT a.label AS i, b.label AS j, round({sql_haversine('a.', 'b.')}, 6) + 0.0 AS d
  FROM crowded_places a JOIN crowded_places b ON a.label < b.label AND abs(a.lat - b.lat) < 0.002 AND {sql_haversine('a.', 'b.')} < 0.1""")
def crowded_pairs(spark, sf):
    """Places within 100 m of each other where one grid cell would hold a third of all places."""
    return T.tree_pairs(crowded_places(spark, sf), 0.1, shown=rounded)


@query("crowded_nearest", f"""
  SELECT label, rank, round(d, 6) + 0.0 AS d FROM (
    SELECT q.label, row_number() OVER (PARTITION BY q.label ORDER BY {sql_haversine('q.', 'p.')}, p.ord) AS rank, {sql_haversine('q.', 'p.')} AS d
    FROM crowded_places q JOIN crowded_places p ON q.label <> p.label) WHERE rank <= 3""")
def crowded_nearest(spark, sf):
    """Distances to the three nearest other places, by counted cells."""
    g = crowded_places(spark, sf)
    return T.tree_nearest(g.select("label", "lat", "lon"), g, 3).select("label", "rank", rounded("d").alias("d"))


sql_view("addresses", """
  SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'City ' || c_custkey % 40 END AS city, CASE WHEN c_custkey % 5 = 1 THEN 'Town ' || c_custkey % 30 WHEN c_custkey % 5 = 0 THEN 'Hidden' END AS town,
         CASE WHEN c_custkey % 5 = 2 THEN '' END AS village, CASE WHEN c_custkey % 5 IN (2, 3) THEN 'County ' || c_custkey % 20 END AS county, n_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey""")
sql_view("address_labels", """
  SELECT concat_ws(', ', coalesce(city, town, nullif(village, ''), county), country) AS label, country, coalesce(city, town, nullif(village, ''), county) AS place, c_custkey FROM addresses""")


def addresses(spark, sf):
    k = F.col("c_custkey")
    c = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = V.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    none = F.lit(None).cast("string")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "country",
        F.when(k % 5 == 0, F.concat(F.lit("City "), k % 40)).alias("city"),
        F.when(k % 5 == 1, F.concat(F.lit("Town "), k % 30)).when(k % 5 == 0, "Hidden").alias("town"),
        F.when(k % 5 == 2, "").alias("village"), none.alias("municipality"),
        F.when((k % 5).isin(2, 3), F.concat(F.lit("County "), k % 20)).alias("county"),
        none.alias("state_district"), none.alias("state"), none.alias("region"),
    )


@query("gallery_build", """
  WITH l AS (SELECT DISTINCT label, country, place FROM address_labels)
  SELECT label, CASE WHEN place IS NULL OR place LIKE 'Town%' THEN NULL ELSE g.lat + length(l.label) / 10.0 END AS lat, place IS NOT NULL AND place NOT LIKE 'Town%' AS kept
  FROM (SELECT l.*, l.label AS lab FROM l) l JOIN nation_geo g ON g.label = l.country""".replace("SELECT label, CASE", "SELECT l.label, CASE"))
def gallery_build(spark, sf):
    a = addresses(spark, sf)
    known = a.select(G.place_label().alias("label"), "country").distinct()
    geo = V.nation_geo(spark, sf).select(F.col("label").alias("country"), "lat", "lon")  # 25 nations
    located = known.where(~F.col("label").startswith("Town") & F.col("label").contains(", "))
    coordinates = located.join(F.broadcast(geo), "country").select("label", (F.col("lat") + F.length("label") / 10.0).alias("lat"), "lon")
    kept, dropped = G.gallery_build(a, coordinates)
    return kept.select("label", "lat", F.lit(True).alias("kept")).unionByName(
        dropped.select("label", F.lit(None).cast("double").alias("lat"), F.lit(False).alias("kept"))
    )


@query("label_parts", """
  SELECT label, trim(list_last(string_split(label, ','))) AS country, string_split(label, ',')[1] AS place, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS slug, count(*) AS n
  FROM address_labels GROUP BY label""")
def label_parts(spark, sf):
    labels = addresses(spark, sf).groupBy(G.place_label().alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return labels.select("label", country_of_label("label").alias("country"), place_of_label("label").alias("place"), slug("label").alias("slug"), "n")


@query("find_place", """
  SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE CAST(s_suppkey AS VARCHAR) LIKE '7%' OR contains(regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g'), '00042')""")
def find_place(spark, sf):
    """Lookup by id prefix or by place slug."""
    s = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return s.where(F.col("id").cast("string").startswith("7") | slug("name").contains("00042"))


@query("label_at_coordinate", """
  SELECT g.ord AS id, p.first_label FROM gallery_large g JOIN (SELECT CAST(round(lat * 100000) AS BIGINT) AS a, CAST(round(lon * 100000) AS BIGINT) AS b, min(label) AS first_label FROM gallery_large GROUP BY ALL) p
   ON CAST(round(g.lat * 100000) AS BIGINT) = p.a AND CAST(round(g.lon * 100000) AS BIGINT) = p.b""")
def label_at_coordinate(spark, sf):
    g = V.gallery_large(spark, sf)
    key = [coordinate_key("lat").alias("a"), coordinate_key("lon").alias("b")]
    cache = g.groupBy(*key).agg(F.min("label").alias("first_label"))
    return g.select(F.col("ord").alias("id"), *key).join(cache, ["a", "b"]).select("id", "first_label")


@query("distinct_places", "SELECT count(DISTINCT label) AS n_labels, count(DISTINCT country) AS n_countries FROM address_labels")
def distinct_places(spark, sf):
    labels = addresses(spark, sf).select(G.place_label().alias("label"), "country").distinct()
    # Distinct first, then count: no task holds a whole set.
    n = labels.select("label").distinct().agg(F.count(F.lit(1)).alias("n_labels"))
    c = labels.select("country").distinct().agg(F.count(F.lit(1)).alias("n_countries"))
    return n.crossJoin(F.broadcast(c))  # one row each


@query("distinct_estimates", """
  SELECT what, n, true AS close, true AS same FROM (
    SELECT 'orders' AS what, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'parts', count(DISTINCT l_partkey) FROM lineitem
    UNION ALL SELECT 'customers', count(DISTINCT user_id) FROM events) WHERE n > 0""")
def distinct_estimates(spark, sf):
    """Distinct values exactly and from stored sketches: one sketch a return flag or event type, united when they are read again."""
    l, e = V.table(spark, sf, "lineitem"), V.table(spark, sf, "events")
    pick = lambda df, what, part, value: df.select(F.lit(what).alias("what"), F.col(part).alias("part"), F.col(value).cast("bigint").alias("value"))
    rows = pick(l, "orders", "l_returnflag", "l_orderkey").unionByName(pick(l, "parts", "l_returnflag", "l_partkey")).unionByName(pick(e, "customers", "event_type", "user_id"))
    path = scratch_path(spark, "sketches")
    E.distinct_sketches(rows, ["what", "part"], "value").write.parquet(path)
    united = E.distinct_estimate(spark.read.parquet(path), ["what"])
    whole = E.distinct_estimate(E.distinct_sketches(rows, ["what"], "value"), ["what"]).withColumnRenamed("estimate", "whole")
    exact = rows.select("what", "value").distinct().groupBy("what").agg(F.count("value").alias("n"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.03 * F.col(b)
    return exact.join(united, "what").join(whole, "what").select("what", "n", near("estimate", "n").alias("close"), near("estimate", "whole").alias("same"))


# Clean-gallery report: beliefs over merged places ------------------------------------------

@query("clean_gallery_summary", f"""
  WITH truth AS (SELECT s.subject_id, s.m, c.rep AS truth FROM subjects s JOIN gallery_small g ON g.ord = s.truth JOIN coarse_clusters c ON c.label = g.label),
       reps AS (SELECT label, lat, lon FROM gallery_small WHERE label IN (SELECT rep FROM coarse_clusters)),
       prs AS (SELECT a.label AS i, b.label AS j, {sql_haversine('a.', 'b.')} AS d FROM reps a JOIN reps b ON a.label < b.label),
       ends AS (SELECT subject_id, label, sum(CASE WHEN mask = 0 THEN p ELSE 0 END) AS po, sum(CASE WHEN mask = 0 THEN 0 ELSE p END) AS pr, min(ord) AS ord FROM merged_beliefs WHERE mask IN (0, (1 << m) - 1) GROUP BY ALL),
       per AS (SELECT e.subject_id, max(CASE WHEN label = truth THEN pr END) AS pt0, max(CASE WHEN label = truth THEN po END) AS pt1, arg_max(label, (round(pr, 12), -ord)) = any_value(truth) AS hit0, arg_max(label, (round(po, 12), -ord)) = any_value(truth) AS hit1,
                      sum(-pr * log2(pr)) - sum(-po * log2(po)) AS drop_bits FROM ends e JOIN truth USING (subject_id) GROUP BY e.subject_id),
       lk AS (SELECT a.subject_id, max(abs(ln(a.po / a.pr) - ln(b.po / b.pr)) / d) * 1000 AS v FROM prs JOIN ends a ON a.label = prs.i JOIN ends b ON b.label = prs.j AND a.subject_id = b.subject_id GROUP BY a.subject_id)
  SELECT (SELECT count(*) FROM reps) AS n_clusters, count(*) AS n, round(avg(hit0::INT), 6) + 0.0 AS prior_accuracy, round(avg(hit1::INT), 6) + 0.0 AS posterior_accuracy, round(avg(-ln(pt0)), 6) + 0.0 AS ce_prior, round(avg(-ln(pt1)), 6) + 0.0 AS ce_posterior,
         round(avg(drop_bits), 6) + 0.0 AS entropy_drop, round(avg(v), 6) + 0.0 AS mpl_mean, round(quantile_cont(v, 0.5), 6) + 0.0 AS mpl_median, round(max(v), 6) + 0.0 AS mpl_max FROM per JOIN lk USING (subject_id)""")
def clean_gallery_summary(spark, sf):
    g = V.gallery_small(spark, sf)
    reps = G.clusters(g, 4000.0)
    geometry = G.build_geometry(g, reps)
    wide = K.mpl(V.wide_beliefs(spark, sf, every_mask=False), geometry).where(F.col("mask") > 0)
    order = {n: i for i, n in enumerate(geometry.reps)}
    merged = F.broadcast(g.select("pos", "ord", "label").join(reps, "label"))  # gallery-sized
    long = wide.select("subject_id", "truth", F.col("leak.sup").alias("sup"), F.posexplode(F.arrays_zip("p", "full")).alias("pos", "z")).join(merged, "pos")
    each = long.groupBy("subject_id", "rep").agg(
        F.sum("z.p").alias("pr"), F.sum("z.full").alias("po"), F.min("ord").alias("ord"), F.max((F.col("ord") == F.col("truth")).cast("int")).alias("own"), F.max("sup").alias("sup")
    )
    first = lambda p: F.max_by("own", F.struct(F.round(p, 12), -F.col("ord")))
    own = lambda p: F.max(F.when(F.col("own") == 1, F.col(p)))
    per = each.groupBy("subject_id").agg(
        B.cross_entropy(own("pr")).alias("ce0"), B.cross_entropy(own("po")).alias("ce1"), first("pr").alias("hit0"), first("po").alias("hit1"),
        (B.entropy("pr") - B.entropy("po")).alias("drop"), (F.max("sup") * 1000).alias("v"),
    )
    out = summarise(
        per, [],
        [F.lit(len(order)).cast("bigint").alias("n_clusters"), F.count(F.lit(1)).alias("n"), F.avg("hit0").alias("prior_accuracy"), F.avg("hit1").alias("posterior_accuracy"),
         F.avg("ce0").alias("ce_prior"), F.avg("ce1").alias("ce_posterior"), F.avg("drop").alias("entropy_drop"), F.avg("v").alias("mpl_mean"), F.max("v").alias("mpl_max")],
        {"mpl_median": ("v", 0.5)}, at_most=V.most_rows(spark, sf),
    )
    return out.select("n_clusters", "n", *[rounded(c).alias(c) for c in ("prior_accuracy", "posterior_accuracy", "ce_prior", "ce_posterior", "entropy_drop", "mpl_mean", "mpl_median", "mpl_max")])


# Accuracy ---------------------------------------------------------------------------------------

_ACC = ", ".join(f"round(avg(CASE WHEN d <= {t} THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS acc_{t}" for t in (1, 25, 200, 750, 2500))


@query("threshold_accuracy", f"SELECT method, count(*) AS n, {_ACC} FROM customer_km GROUP BY method")
def threshold_accuracy(spark, sf):
    out = E.threshold_accuracy(V.customer_km(spark, sf), keys=["method"])
    return out.select("method", "n", *[rounded(c).alias(c) for c in out.columns[2:]])


_ACC2 = ", ".join(f"round(count(*) FILTER (WHERE r.subject_id IS NOT NULL AND d <= {t}) / count(r.subject_id), 6) + 0.0 AS acc_{t}" for t in (1, 25, 200, 750, 2500))


@query("method_distance_table", f"""
  WITH r AS (SELECT subject_id, method, d FROM customer_km), grid AS (SELECT subject_id, method FROM (SELECT DISTINCT subject_id FROM r) CROSS JOIN (SELECT DISTINCT method FROM r)),
       med AS (SELECT method, round(d, 6) + 0.0 AS median_km FROM (SELECT method, d, row_number() OVER (PARTITION BY method ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM r WHERE d IS NOT NULL) WHERE i = n // 2)
  SELECT g.method, count(r.subject_id) AS n_attempted, count(*) - count(r.subject_id) AS n_missing, count(*) FILTER (WHERE r.subject_id IS NOT NULL AND d IS NULL) AS n_ungeocodable, {_ACC2}, any_value(median_km) AS median_km
  FROM grid g LEFT JOIN r USING (subject_id, method) JOIN med ON med.method = g.method GROUP BY g.method""")
def method_distance_table(spark, sf):
    r = V.customer_km(spark, sf)
    out = E.method_distance_table(r.select("subject_id").distinct(), r, r.select("method").distinct())
    return out.select("method", "n_attempted", "n_missing", "n_ungeocodable", *[rounded(c).alias(c) for c in out.columns if c.startswith(("acc_", "median"))])


@query("distance_work_list", "SELECT truth, count(*) AS n FROM customer_km WHERE d IS NULL GROUP BY truth")
def distance_work_list(spark, sf):
    """Names without coordinates: the work list of the lookup table."""
    return V.customer_km(spark, sf).where(F.col("d").isNull()).groupBy("truth").agg(F.count(F.lit(1)).alias("n"))


@query("accuracy_summary", """
  SELECT count(*) AS n, round(avg(CASE WHEN d <= 25 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS acc_25, round(avg(CASE WHEN d <= 750 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS acc_750, round(avg((gc = tc)::INT), 6) + 0.0 AS country_hit,
         round(quantile_cont(d, 0.5), 6) + 0.0 AS median_km, round(quantile_cont(pt, 0.5), 6) + 0.0 AS median_p_true
  FROM (SELECT mf.subject_id, {0} AS d, g.country AS gc, t.country AS tc, b.p AS pt FROM map_full mf JOIN subjects s USING (subject_id) JOIN gallery_small g ON g.ord = mf.ord JOIN gallery_small t ON t.ord = s.truth
        JOIN beliefs b ON b.subject_id = mf.subject_id AND b.mask = 0 AND b.ord = s.truth)""".format(sql_haversine("g.", "t.")))
def accuracy_summary(spark, sf):
    from ..functions.columns import haversine_km

    g = V.gallery_small(spark, sf)
    w = V.wide_beliefs(spark, sf, every_mask=False).where(F.col("mask") == 0)
    named = lambda p: F.broadcast(g.select(*[F.col(c).alias(p + c) for c in ("ord", "pos", "lat", "lon", "country")]))
    rows = w.withColumn("g_pos", F.array_position("p", F.array_max("p")) - 1).join(named("g_"), "g_pos").join(named("t_"), F.col("truth") == F.col("t_ord"))
    rows = rows.select(
        haversine_km("g_lat", "g_lon", "t_lat", "t_lon").alias("d"), (F.col("g_country") == F.col("t_country")).cast("double").alias("hit"),
        F.element_at("p", (F.col("t_pos") + 1).cast("int")).alias("pt"),
    )
    acc = lambda t: F.avg(F.when(F.col("d") <= t, 1.0).otherwise(0.0))
    out = summarise(
        rows, [], [F.count(F.lit(1)).alias("n"), acc(25).alias("acc_25"), acc(750).alias("acc_750"), F.avg("hit").alias("country_hit")],
        {"median_km": ("d", 0.5), "median_p_true": ("pt", 0.5)}, at_most=V.most_rows(spark, sf),
    )
    return out.select("n", *[rounded(c).alias(c) for c in ("acc_25", "acc_750", "country_hit", "median_km", "median_p_true")])


@query("topk_recall", """
  SELECT count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS recall_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS recall_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS recall_5
  FROM (SELECT b.subject_id, min(CASE WHEN g.country = t.country THEN rk END) AS r FROM
        (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY p DESC, ord) AS rk FROM beliefs WHERE mask = 0) b
        JOIN gallery_small g ON g.ord = b.ord JOIN subjects s ON s.subject_id = b.subject_id JOIN gallery_small t ON t.ord = s.truth GROUP BY b.subject_id)""")
def topk_recall(spark, sf):
    """Candidates as their region names; several slots may carry the same name."""
    g = V.gallery_small(spark, sf)
    b = V.long_beliefs(spark, sf, every_mask=False).where(F.col("mask") == 0)
    order = W.partitionBy("subject_id").orderBy(F.col("p").desc(), "ord")
    ranked = b.withColumn("rank", F.row_number().over(order))
    named = ranked.join(F.broadcast(g.select("ord", F.col("country").alias("c"))), "ord").join(F.broadcast(g.select(F.col("ord").alias("truth"), F.col("country").alias("t"))), "truth")
    named = B.canonical_country(B.canonical_country(named, "c", "canonical"), "t", "gt")
    out = E.topk_recall(named)
    return out.select("n", *[rounded(c).alias(c) for c in ("recall_1", "recall_3", "recall_5")])


@query("truth_rank", """
  WITH r AS (SELECT b.subject_id, b.mask, b.m, p, row_number() OVER (PARTITION BY b.subject_id, b.mask ORDER BY p DESC, ord) AS rk, ord = truth AS own FROM beliefs b JOIN subjects s ON b.subject_id = s.subject_id WHERE mask IN (0, (1 << b.m) - 1))
  SELECT CASE WHEN mask = 0 THEN 'posterior' ELSE 'prior' END AS view, count(*) AS n, round(avg(rk), 6) + 0.0 AS mean_rank, round(avg(p), 6) + 0.0 AS mean_p_true, round(avg((rk = 1)::INT), 6) + 0.0 AS map_accuracy FROM r WHERE own GROUP BY view""")
def truth_rank(spark, sf):
    b = V.long_beliefs(spark, sf, every_mask=False)
    order = W.partitionBy("subject_id", "mask").orderBy(F.col("p").desc(), "ord")
    own = b.withColumn("rk", F.row_number().over(order)).where(F.col("ord") == F.col("truth"))
    view = F.when(F.col("mask") == 0, "posterior").otherwise("prior")
    return own.groupBy(view.alias("view")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("rk")).alias("mean_rank"), rounded(F.avg("p")).alias("mean_p_true"),
        rounded(F.avg((F.col("rk") == 1).cast("int"))).alias("map_accuracy"),
    )


@query("support_coverage", """
  SELECT count(*) AS n, round(avg(cov), 6) + 0.0 AS coverage, round(avg(mp), 6) + 0.0 AS map_accuracy FROM (
    SELECT c.subject_id, max((p.label = c.gt_country)::INT) AS cov, max(CASE WHEN p.rk = 1 THEN (p.label = c.gt_country)::INT END) AS mp FROM customer_km c
    JOIN (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY round(p, 12) DESC, ord) AS rk FROM priors WHERE level = 'country' AND (subject_id + ord) % 5 <> 0) p ON p.subject_id = c.subject_id GROUP BY c.subject_id)""")
def support_coverage(spark, sf):
    """Is the true country among the candidates, and is it the first of them?"""
    p = V.priors(spark, sf).where((F.col("level") == "country") & ((F.col("subject_id") + F.col("ord")) % 5 != 0))
    order = W.partitionBy("subject_id").orderBy(F.round("p", 12).desc(), "ord")
    ranked = p.withColumn("rk", F.row_number().over(order)).select("subject_id", "label", "rk")
    gt = V.customer_km(spark, sf).select("subject_id", "gt_country")
    hit = (F.col("label") == F.col("gt_country")).cast("int")
    per = ranked.join(gt, "subject_id").groupBy("subject_id").agg(F.max(hit).alias("cov"), F.max(F.when(F.col("rk") == 1, hit)).alias("mp"))
    return per.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("cov")).alias("coverage"), rounded(F.avg("mp")).alias("map_accuracy"))


@query("top_bottom_candidates", """
  SELECT subject_id, label, best, worst FROM (SELECT subject_id, label, row_number() OVER (PARTITION BY subject_id ORDER BY p DESC, ord) AS best, row_number() OVER (PARTITION BY subject_id ORDER BY p, ord DESC) AS worst FROM beliefs WHERE mask = 0)
  WHERE best <= 3 OR worst <= 5""")
def top_bottom_candidates(spark, sf):
    b = V.long_beliefs(spark, sf, every_mask=False).where(F.col("mask") == 0)
    own = W.partitionBy("subject_id")
    ranked = b.select(
        "subject_id", "label", F.row_number().over(own.orderBy(F.col("p").desc(), "ord")).alias("best"), F.row_number().over(own.orderBy("p", F.col("ord").desc())).alias("worst")
    )
    return ranked.where((F.col("best") <= 3) | (F.col("worst") <= 5))


# Calibration ---------------------------------------------------------------------------------------

@query("reliability_bins", """
  SELECT least(4, floor(p * 5))::INT AS bin, count(*) AS n, round(avg((mf.ord = s.truth)::INT), 6) + 0.0 AS acc FROM map_full mf JOIN subjects s USING (subject_id) GROUP BY bin""")
def reliability_bins(spark, sf):
    b = V.long_beliefs(spark, sf, every_mask=False).where(F.col("mask") == 0)
    out = E.reliability(E.score_beliefs(b, keys=["subject_id"]))
    return out.select("bin", "n", rounded("acc").alias("acc"))


# The temperature grid: 0.30 to 3.00 in 55 steps, then 3.2 to 8 in 25.
sql_view("tau_grid", """
  SELECT 0.3 + 2.7 * i / 54.0 AS tau FROM (SELECT unnest(generate_series(0, 54)) AS i) UNION ALL SELECT 3.2 + 4.8 * i / 24.0 FROM (SELECT unnest(generate_series(0, 24)) AS i)""")
sql_view("tau_scored", """
  SELECT t.subject_id, t.tau, max(CASE WHEN ord = truth THEN p END) AS pt, sum(pow(p - CASE WHEN ord = truth THEN 1.0 ELSE 0.0 END, 2)) AS brier, max(p) AS conf, arg_max(ord, (p, -ord)) = any_value(truth) AS correct
  FROM (SELECT subject_id, tau, ord, e / sum(e) OVER (PARTITION BY subject_id, tau) AS p FROM (SELECT subject_id, tau::DOUBLE AS tau, ord, pow(greatest(p, 1e-12), 1.0 / tau) AS e FROM beliefs CROSS JOIN tau_grid WHERE mask = 0)) t JOIN subjects USING (subject_id) GROUP BY ALL""")


def tau_grid() -> list[float]:
    return [0.3 + 2.7 * i / 54.0 for i in range(55)] + [3.2 + 4.8 * i / 24.0 for i in range(25)]


def calibration_beliefs(spark, sf):
    """Full-view beliefs in gallery order with the place of the truth in them."""
    wide = V.wide_beliefs(spark, sf, every_mask=False).where(F.col("mask") == 0)
    at = V.gallery_small(spark, sf).select(F.col("ord").alias("truth"), "pos")  # at most the 25 nations
    return wide.join(F.broadcast(at), "truth", "left")


@query("temperature_fit", """
  WITH a AS (SELECT tau, avg(-ln(greatest(pt, 1e-12))) AS nll FROM tau_scored WHERE subject_id % 2 = 0 GROUP BY tau)
  SELECT round(tau, 6) + 0.0 AS tau, round(nll, 6) + 0.0 AS nll, rank() OVER (ORDER BY round(nll, 10), tau) AS place FROM a""")
def temperature_fit(spark, sf):
    """NLL of the training half for every temperature, best first."""
    train = calibration_beliefs(spark, sf).where(F.col("subject_id") % 2 == 0)
    nll = E.grid_losses(train, tau_grid(), truth="pos")
    # 80 rows: one per grid point.
    return nll.select(rounded("tau").alias("tau"), rounded("nll").alias("nll"), F.rank().over(W.orderBy(F.round("nll", 10), "tau")).alias("place"))


@query("calibration_metrics", """
  WITH best AS (SELECT arg_min(tau, (round(nll, 10), tau)) AS tau FROM (SELECT tau, avg(-ln(greatest(pt, 1e-12))) AS nll FROM tau_scored WHERE subject_id % 2 = 0 GROUP BY tau)),
       s AS (SELECT * FROM tau_scored WHERE subject_id % 2 = 1 AND (tau = (SELECT tau FROM best) OR abs(tau - 1.0) < 1e-9)),
       e AS (SELECT tau, sum(n * abs(a - c)) / sum(n) AS ece FROM (SELECT tau, ceil(conf * 10) AS bin, count(*) AS n, avg(correct::INT) AS a, avg(conf) AS c FROM s GROUP BY ALL) GROUP BY tau)
  SELECT round(s.tau, 6) + 0.0 AS tau, count(*) AS n, round(avg(-ln(greatest(pt, 1e-12))), 6) + 0.0 AS nll, round(avg(brier), 6) + 0.0 AS brier, round(any_value(ece), 6) + 0.0 AS ece FROM s JOIN e ON s.tau = e.tau GROUP BY s.tau""")
def calibration_metrics(spark, sf):
    """Test-half metrics at temperature 1 and at the fitted temperature."""
    train = calibration_beliefs(spark, sf).where(F.col("subject_id") % 2 == 0)
    nll = E.grid_losses(train, tau_grid(), truth="pos").select("tau", F.round("nll", 10).alias("nll"))
    best = E.fit_temperature(nll).withColumnRenamed("tau", "best")  # one row
    one = next(t for t in tau_grid() if abs(t - 1.0) < 1e-9)
    b = V.long_beliefs(spark, sf, every_mask=False).where((F.col("mask") == 0) & (F.col("subject_id") % 2 == 1)).crossJoin(F.broadcast(best))
    # Only two temperatures are needed of the other half.
    two = F.explode(F.array_distinct(F.array_compact(F.array(F.lit(one), "best"))))
    tempered = B.temper(b.select("subject_id", "truth", "ord", "p", two.alias("tau")), keys=("subject_id", "tau"))
    test = E.score_beliefs(tempered, keys=["subject_id", "tau"])
    out = E.calibration(test, keys=["tau"])
    return out.select(rounded("tau").alias("tau"), "n", rounded("nll").alias("nll"), rounded("brier").alias("brier"), rounded("ece").alias("ece"))


# Descriptive reports ---------------------------------------------------------------------------------

@query("category_median", """
  SELECT coalesce(category, 'unknown') AS category, count(*) AS n, round(quantile_cont(v_single, 0.5), 6) + 0.0 AS median FROM attributed GROUP BY 1""")
def category_median(spark, sf):
    from .attribution import with_category

    single = V.lattice(spark, sf).where(F.bit_count("mask") == 1).withColumn("k", F.log2("mask").cast("int"))
    named = with_category(spark, sf, single).withColumn("category", F.coalesce("category", F.lit("unknown")))
    return summarise(named, ["category"], [F.count(F.lit(1)).alias("n")], {"median": ("v", 0.5)}, at_most=V.most_rows(spark, sf)).select("category", "n", rounded("median").alias("median"))


@query("describe_leaks", """
  SELECT m, count(*) AS n, round(quantile_cont(v, 0.5), 6) + 0.0 AS median, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS sd, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max FROM lattice WHERE mask > 0 GROUP BY m""")
def describe_leaks(spark, sf):
    d = E.describe(V.lattice(spark, sf).where(F.col("mask") > 0), ["m"], "v", at_most=V.most_rows(spark, sf))
    return d.select("m", "n", *[rounded(c).alias(c) for c in ("median", "mean", "sd", "min", "max")])


@query("histograms", """
  WITH v AS (SELECT 'p_true' AS what, 20 AS bins, floor(p / 0.05) AS b, p AS x, 1.0::DOUBLE AS hi FROM beliefs JOIN subjects USING (subject_id) WHERE mask = 0 AND ord = truth
             UNION ALL SELECT 'sii', 40, floor((sii + 0.5) / 0.025), sii + 0.5, 1.0 FROM pair_index
             UNION ALL SELECT 'area', 24, floor(a / 2.5), a, 60.0 FROM (SELECT round(sum(bit_count(bits)) / 30.72, 9) AS a FROM cue_pixels GROUP BY subject_id, cue_idx)),
       g AS (SELECT what, bins, unnest(generate_series(0, bins - 1)) AS bin FROM (SELECT DISTINCT what, bins FROM v))
  SELECT g.what, g.bin::BIGINT AS bin, count(v.x) AS n FROM g LEFT JOIN v ON g.what = v.what AND least(v.b, g.bins - 1) = g.bin AND v.x BETWEEN 0 AND v.hi GROUP BY ALL""")
def histograms(spark, sf):
    from ..operators import lattice as L
    from ..operators import masks as M

    b = V.long_beliefs(spark, sf, every_mask=False).where((F.col("mask") == 0) & (F.col("ord") == F.col("truth")))
    sii = L.interactions(V.lattice(spark, sf)).select((F.col("sii") + 0.5).alias("x"))
    cov = M.coverage(V.instance_rows(spark, sf), V.FRAME_W, V.FRAME_H).select(F.round(F.col("area") / F.lit(30.72), 9).alias("x"))
    parts = [("p_true", E.histogram(b, "p", 0.0, 0.05, 20)), ("sii", E.histogram(sii, "x", 0.0, 0.025, 40)), ("area", E.histogram(cov, "x", 0.0, 2.5, 24))]
    out = None
    for name, h in parts:
        one = h.select(F.lit(name).alias("what"), F.col("bin").cast("bigint").alias("bin"), "n")
        out = one if out is None else out.unionByName(one)
    return out


sql_view("annotations", """
  SELECT *, CASE WHEN n_inst = 0 THEN 'Not localized' WHEN n_good = 0 THEN 'Degenerate' ELSE 'Localized' END AS outcome FROM (
    SELECT l.*, p_type AS category, l_linenumber % 4 AS n_inst,
           (SELECT count(*) FROM (SELECT unnest(generate_series(0, l_linenumber % 4 - 1)) AS i) WHERE NOT ((1 + (l_quantity::INT + 17 * i) % 60) * (1 + ((l_partkey + 5 * i) * 7) % 46) / (64.0 * 48) > 0.4)) AS n_good
    FROM lineitem l JOIN part ON l_partkey = p_partkey)""")
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def annotations(spark, sf):
    """Nested cue annotations: every line item is a cue with 0 to 3 boxes."""
    l = spread(V.table(spark, sf, "lineitem").select("l_orderkey", *ORDER))
    p = V.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"))
    w = lambda i: 1 + (F.col("l_quantity").cast("int") + 17 * i) % 60
    h = lambda i: 1 + ((F.col("l_partkey") + 5 * i) * 7) % 46
    box = lambda i: F.struct(F.array(F.lit(0.0), F.lit(0.0), w(i).cast("double"), h(i).cast("double")).alias("bbox"), (F.lit(1.0) - i / F.lit(10.0)).alias("score"), F.lit("rle").alias("mask"))
    some = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("l_linenumber") % 4)
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("subject_id"), *ORDER, "category", F.lit(64).alias("w"), F.lit(48).alias("h"),
        F.transform(some, box).alias("instances"), (F.col("l_linenumber") % 2 == 0).alias("maskable"),
    )
    return Q.localization_outcome(Q.assign_maskable(Q.flag_degenerate(rows)))


@query("localization_outcome", """
  SELECT outcome, count(*) AS n, sum(n_good)::BIGINT AS n_mask, sum((n_inst > 0 AND n_good = 0)::INT)::BIGINT AS n_degenerate, sum((n_good > 0)::INT)::BIGINT AS n_maskable, sum((l_linenumber % 2 = 0)::INT)::BIGINT AS n_reported FROM annotations GROUP BY outcome""")
def localization_outcome(spark, sf):
    return annotations(spark, sf).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_mask").alias("n_mask"), F.count_if("degenerate").alias("n_degenerate"), F.count_if("maskable").alias("n_maskable"), F.count_if("maskable_llm").alias("n_reported")
    )


@query("maskable_cues", """
  SELECT l_orderkey AS subject_id, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS cue_idx FROM annotations WHERE n_good > 0""")
def maskable_cues(spark, sf):
    most = largest_group(V.table(spark, sf, "lineitem"), ["l_orderkey"])
    return Q.maskable_cues(annotations(spark, sf), ORDER, at_most=most).select("subject_id", "l_linenumber", "l_partkey", "l_suppkey", "cue_idx")


@query("cue_statistics", """
  SELECT category, count(*) AS n, round(100.0 * avg((outcome = 'Localized')::INT), 6) + 0.0 AS pct_localized, round(avg((category LIKE 'S%')::INT), 6) + 0.0 AS text_share, round(quantile_cont(area, 0.5), 6) + 0.0 AS median_area, count(DISTINCT l_linenumber) AS n_kinds
  FROM (SELECT *, (1 + l_quantity::INT % 60) * (1 + (l_partkey * 7) % 46) / 3072.0 AS area FROM annotations) GROUP BY category""")
def cue_statistics(spark, sf):
    rows = annotations(spark, sf).select(
        "category", "outcome", "l_linenumber", ((1 + F.col("l_quantity").cast("int") % 60) * (1 + (F.col("l_partkey") * 7) % 46) / 3072.0).alias("area")
    )
    out = summarise(
        rows, ["category"],
        [F.count(F.lit(1)).alias("n"), (100.0 * F.avg((F.col("outcome") == "Localized").cast("int"))).alias("a"), F.avg(F.col("category").startswith("S").cast("int")).alias("b")],
        {"c": ("area", 0.5)},
    )
    kinds = rows.select("category", "l_linenumber").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("n_kinds"))
    out = out.join(kinds, "category")
    return out.select("category", "n", rounded("a").alias("pct_localized"), rounded("b").alias("text_share"), rounded("c").alias("median_area"), F.col("n_kinds").cast("bigint").alias("n_kinds"))


@query("cues_per_subject", """
  SELECT n_cues, n_maskable, count(*) AS n FROM (SELECT l_orderkey, count(*) AS n_cues, sum((n_good > 0)::INT)::BIGINT AS n_maskable FROM annotations GROUP BY l_orderkey) GROUP BY ALL""")
def cues_per_subject(spark, sf):
    per = annotations(spark, sf).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_cues"), F.count_if("maskable").alias("n_maskable"))
    return per.groupBy("n_cues", "n_maskable").agg(F.count(F.lit(1)).alias("n"))


@query("outcome_crosstab", """
  SELECT least(7, floor((c - lo) / (hi - lo) * 8))::INT AS bin, count(*) FILTER (WHERE outcome = 'Localized') AS localized, count(*) FILTER (WHERE outcome = 'Degenerate') AS degenerate, count(*) FILTER (WHERE outcome = 'Not localized') AS not_localized
  FROM (SELECT outcome, l_discount * 10 AS c, min(l_discount * 10) OVER () AS lo, max(l_discount * 10) OVER () AS hi FROM annotations) GROUP BY bin""")
def outcome_crosstab(spark, sf):
    rows = annotations(spark, sf).select("outcome", (F.col("l_discount") * 10).alias("c"))
    edges = V.table(spark, sf, "lineitem").agg((F.min("l_discount") * 10).alias("lo"), (F.max("l_discount") * 10).alias("hi"))
    binned = rows.crossJoin(F.broadcast(edges)).select("outcome", F.least(F.lit(7), F.floor((F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 8)).cast("int").alias("bin"))
    out = binned.groupBy("bin").pivot("outcome", ["Localized", "Degenerate", "Not localized"]).count()
    named = {"Localized": "localized", "Degenerate": "degenerate", "Not localized": "not_localized"}
    return out.withColumnsRenamed(named).na.fill(0)


_STOP = ", ".join(f"'{w}'" for w in CUE_STOP_WORDS)


@query("cue_terms", f"""
  SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) WHERE length(term) > 2 AND term NOT IN ({_STOP}) GROUP BY term ORDER BY n DESC, term LIMIT 15""")
def cue_terms(spark, sf):
    return E.terms(spread(V.table(spark, sf, "documents").select("text")), "text")


@query("worst_risk", """
  SELECT o_custkey AS subject_id, CASE max(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 3 WHEN o_orderpriority LIKE '3%' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk FROM orders GROUP BY o_custkey""")
def worst_risk(spark, sf):
    p = F.substring("o_orderpriority", 1, 1)
    risk = F.when(p.isin("1", "2"), "high").when(p == "3", "medium").otherwise("low")
    return E.worst_risk(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), risk.alias("risk")))


@query("hit_strata", """
  SELECT CASE WHEN grouping(quality) = 1 THEN 'all' WHEN quality = 1 THEN 'hit' WHEN quality = 0 THEN 'miss' ELSE 'unknown' END AS stratum, count(*) AS n, round(avg(n_chars), 6) + 0.0 AS mean_chars, round(avg(toxic), 6) + 0.0 AS toxic_share
  FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (quality))""")
def hit_strata(spark, sf):
    """One pass over all rows and both strata by grouping sets."""
    rows = V.table(spark, sf, "labels").join(V.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    out = rows.groupingSets([[], [F.col("quality")]], F.col("quality")).agg(
        F.grouping("quality").alias("whole"), F.count(F.lit(1)).alias("n"), rounded(F.avg("n_chars")).alias("mean_chars"), rounded(F.avg("toxic")).alias("toxic_share")
    )
    stratum = F.when(F.col("whole") == 1, "all").when(F.col("quality") == 1, "hit").when(F.col("quality") == 0, "miss").otherwise("unknown")
    return out.select(stratum.alias("stratum"), "n", "mean_chars", "toxic_share")

"""Model tables derived from the given tables, in Spark and in SQL.

Both sides use plain arithmetic, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import rounded  # noqa: F401  (re-exported for the query modules)
from ..operators import scoring
from ..operators.scale import dealt, largest_group, row_numbers, spread
from .registry import sql_view


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Places ---------------------------------------------------------------------

sql_view("nation_geo", """
  SELECT n_nationkey, n_name AS label, r_regionkey, r_name AS region,
         CAST((n_nationkey * 37) % 121 - 60 AS DOUBLE) AS lat,
         CAST((n_nationkey * 73) % 360 - 180 AS DOUBLE) AS lon
  FROM nation JOIN region ON n_regionkey = r_regionkey""")


def nation_geo(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")  # nations and regions are fixed dimensions (25 and 5 rows)
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("label"), "r_regionkey", F.col("r_name").alias("region"),
        ((F.col("n_nationkey") * 37) % 121 - 60).cast("double").alias("lat"),
        ((F.col("n_nationkey") * 73) % 360 - 180).cast("double").alias("lon"),
    )


sql_view("gallery_small", """
  SELECT n_nationkey AS ord, label, lat, lon, region AS country,
         row_number() OVER (ORDER BY n_nationkey) - 1 AS pos
  FROM nation_geo WHERE n_nationkey IN (SELECT label FROM embeddings)""")


def gallery_small(spark, sf) -> DataFrame:
    """The candidate places of the belief queries: nations that occur as a label."""
    used = table(spark, sf, "embeddings").select(F.col("label").alias("n_nationkey")).distinct()
    g = nation_geo(spark, sf).join(used, "n_nationkey", "left_semi")
    # The gallery is at most the 25 nations, so one window over all of it is small.
    return g.select(
        F.col("n_nationkey").alias("ord"), "label", "lat", "lon", F.col("region").alias("country"),
        (F.row_number().over(W.orderBy("n_nationkey")) - 1).alias("pos"),
    )


_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


def sql_haversine(a: str, b: str) -> str:
    return _HAV.format(a=a, b=b)


sql_view("pairs_small", f"""
  SELECT a.ord AS i, b.ord AS j, {sql_haversine('a.', 'b.')} AS d
  FROM gallery_small a JOIN gallery_small b ON a.ord < b.ord""")

sql_view("gallery_large", """
  SELECT s_name AS label, s_suppkey AS ord, n_name AS country,
         ((s_nationkey * 37) % 121 - 60) + ((s_suppkey * 13) % 40) / 100.0 AS lat,
         ((s_nationkey * 73) % 360 - 180) + ((s_suppkey * 29) % 40) / 100.0 AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")


def _jittered(df, key, nation):
    return df.withColumns({
        "lat": ((F.col(nation) * 37) % 121 - 60) + ((F.col(key) * 13) % 40) / F.lit(100.0),
        "lon": ((F.col(nation) * 73) % 360 - 180) + ((F.col(key) * 29) % 40) / F.lit(100.0),
    })


def gallery_large(spark, sf) -> DataFrame:
    s = _jittered(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("label"), F.col("s_suppkey").alias("ord"), F.col("n_name").alias("country"), "lat", "lon"
    )


# Every nearby pair of places, from one row per site ---------------------------

sql_view("customer_km", f"""
  SELECT c_custkey AS subject_id, c_mktsegment AS method, g.label AS truth, g.region AS gt_country,
         CASE WHEN c_custkey % 17 <> 0 THEN {sql_haversine('c.', 'g.')} END AS d
  FROM (SELECT *, ((c_nationkey * 37) % 121 - 60) + ((c_custkey * 13) % 40) / 100.0 * (1 + c_custkey % 50) AS lat,
               ((c_nationkey * 73) % 360 - 180) + ((c_custkey * 29) % 40) / 100.0 AS lon FROM customer) c
  JOIN nation_geo g ON c.c_nationkey = g.n_nationkey""")


def customer_km(spark, sf) -> DataFrame:
    """Estimated place of each customer against the centre of its nation; some have no estimate."""
    from ..functions.columns import haversine_km

    c = table(spark, sf, "customer").withColumns({
        "clat": ((F.col("c_nationkey") * 37) % 121 - 60) + ((F.col("c_custkey") * 13) % 40) / F.lit(100.0) * (1 + F.col("c_custkey") % 50),
        "clon": ((F.col("c_nationkey") * 73) % 360 - 180) + ((F.col("c_custkey") * 29) % 40) / F.lit(100.0),
    })
    g = nation_geo(spark, sf)
    return c.join(F.broadcast(g), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("method"), F.col("label").alias("truth"),
        F.col("region").alias("gt_country"),
        F.when(F.col("c_custkey") % 17 != 0, haversine_km("clat", "clon", "lat", "lon")).alias("d"),
    )


# Beliefs ---------------------------------------------------------------------

sql_view("components", """
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings""")
sql_view("centroids", "SELECT label, dim, avg(x) AS c FROM components GROUP BY label, dim")
sql_view("subjects", "SELECT vec_id AS subject_id, label AS truth, 1 + vec_id % 5 AS m FROM embeddings")
sql_view("block_scores", """
  SELECT e.vec_id AS subject_id, 1 + e.vec_id % 5 AS m, e.dim % (1 + e.vec_id % 5) AS block, c.label AS ord, sum(e.x * c.c) AS s
  FROM components e JOIN centroids c ON e.dim = c.dim GROUP BY ALL""")
sql_view("subject_masks", """
  SELECT subject_id, m, unnest(generate_series(0, (1 << m) - 1)) AS mask FROM subjects""")
sql_view("score_rows", """
  SELECT k.subject_id, k.m, k.mask, b.ord, sum(CASE WHEN (k.mask >> b.block) & 1 = 0 THEN b.s ELSE 0.0 END) AS score
  FROM subject_masks k JOIN block_scores b ON k.subject_id = b.subject_id GROUP BY ALL""")
sql_view("beliefs", """
  SELECT subject_id, m, mask, s.ord, g.label, e / sum(e) OVER (PARTITION BY subject_id, mask) AS p
  FROM (SELECT *, exp(60.0 * (score - max(score) OVER (PARTITION BY subject_id, mask))) AS e FROM score_rows) s
  JOIN gallery_small g ON g.ord = s.ord""")
sql_view("shifts", """
  SELECT a.subject_id, a.m, a.mask, a.ord, ln(b.p / a.p) AS llr
  FROM beliefs a JOIN beliefs b ON a.subject_id = b.subject_id AND a.ord = b.ord AND b.mask = 0""")
sql_view("leaks", """
  SELECT a.subject_id, a.m, a.mask, avg(abs(a.llr - b.llr) / d) * 1000 AS mean_mpl, max(abs(a.llr - b.llr) / d) AS sup_mpl,
         count(*) AS n_pairs
  FROM pairs_small p JOIN shifts a ON a.ord = p.i JOIN shifts b ON b.ord = p.j AND a.subject_id = b.subject_id AND a.mask = b.mask
  GROUP BY ALL""")
sql_view("lattice", "SELECT subject_id, m, mask, CASE WHEN mask = 0 THEN 0.0 ELSE mean_mpl END AS v FROM leaks")
sql_view("lattice_cues", """
  SELECT l.*, k, (mask >> k) & 1 AS inside, bit_count(mask) - ((mask >> k) & 1) AS others
  FROM (SELECT *, unnest(generate_series(0, m - 1)) AS k FROM lattice) l""")
sql_view("attribution", """
  SELECT subject_id, m, k,
         sum(CASE WHEN inside = 1 THEN v ELSE -v END * factorial(others::INT) * factorial((m - others - 1)::INT) / factorial(m::INT)) AS phi,
         max(CASE WHEN bit_count(mask) = 1 AND inside = 1 THEN v END) AS v_single,
         max(CASE WHEN mask = (1 << m) - 1 THEN v END) AS v_all
  FROM lattice_cues GROUP BY ALL""")
sql_view("cue_pairs", """
  SELECT *, ((mask >> k) & 1) AS in_k, ((mask >> l) & 1) AS in_l,
         bit_count(mask) - ((mask >> k) & 1) - ((mask >> l) & 1) AS others
  FROM (SELECT c.*, unnest(generate_series(k + 1, m - 1)) AS l FROM
         (SELECT subject_id, m, mask, v, unnest(generate_series(0, m - 2)) AS k FROM lattice WHERE m >= 2) c)""")
sql_view("pair_index", """
  SELECT subject_id, m, k, l,
         sum(CASE WHEN in_k + in_l = 1 THEN -v ELSE v END * factorial(others::INT) * factorial((m - others - 2)::INT) / factorial((m - 1)::INT)) AS sii,
         sum(CASE WHEN others = 0 AND in_k + in_l = 2 THEN v WHEN others = 0 AND in_k + in_l = 1 THEN -v ELSE 0 END) AS i_empty
  FROM cue_pairs GROUP BY ALL""")
sql_view("map_full", """
  SELECT subject_id, arg_max(label, (p, -ord)) AS label, arg_max(ord, (p, -ord)) AS ord, max(p) AS p
  FROM beliefs WHERE mask = 0 GROUP BY subject_id""")

SCALE = 60.0


def subjects(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("subject_id"), F.col("label").alias("truth"), (1 + F.col("vec_id") % 5).cast("int").alias("m"))


def most_rows(spark, sf, per_subject: int = 31) -> int:
    """Bound on the rows derived from the subjects (at most 5 cues, 31 masked subsets); counts from file footers."""
    return table(spark, sf, "embeddings").count() * per_subject


def features(spark, sf) -> DataFrame:
    """Embedding vectors; dimension d belongs to cue d % m."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("subject_id"), F.col("label").alias("truth"),
        (1 + F.col("vec_id") % 5).cast("int").alias("m"), F.col("embedding").alias("x"),
    )


def centroids(spark, sf) -> np.ndarray:
    """Mean vector per label: labels x dimensions, a bounded model parameter."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = parts.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("c"))
    return scoring.collect_centroids(means)


def wide_beliefs(spark, sf, *, method: str = "softmax", every_mask: bool = True) -> DataFrame:
    """(subject_id, truth, m, mask, p, full): beliefs of every masked subset in gallery order."""
    scorer = scoring.similarity_scorer(centroids(spark, sf), SCALE, method=method)
    subsets = "all" if every_mask else "ends"
    return scoring.score_subsets(features(spark, sf), scorer, subsets=subsets)


def long_beliefs(spark, sf, **kw) -> DataFrame:
    from ..operators.beliefs import to_long

    wide = wide_beliefs(spark, sf, **kw)
    return to_long(wide, gallery_small(spark, sf), keys=("subject_id", "truth", "m", "mask"), arrays=("p", "full"))


def geometry_small(spark, sf, reps: DataFrame | None = None):
    from ..operators.geometry import build_geometry

    return build_geometry(gallery_small(spark, sf), reps)


def leaks(spark, sf, **kw) -> DataFrame:
    """Wide beliefs with ``leak`` (mean, sup, pair) of each masked subset against the full view."""
    from ..operators.leakage import mpl

    return mpl(wide_beliefs(spark, sf), geometry_small(spark, sf), **kw)


def lattice(spark, sf) -> DataFrame:
    v = F.when(F.col("mask") == 0, F.lit(0.0)).otherwise(F.col("leak.mean"))
    return leaks(spark, sf).select("subject_id", "m", "mask", v.alias("v"))


# Evidence ---------------------------------------------------------------------

sql_view("numbered_events", """
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'country' WHEN ts < TIMESTAMP '2024-01-21' THEN 'city' ELSE 'street' END AS level
  FROM events""")
sql_view("ratings", """
  SELECT user_id AS subject_id, event_id, ts, level, step, r_regionkey AS ord,
         r_name || CASE level WHEN 'country' THEN '' WHEN 'city' THEN ' City' ELSE ' Street' END AS label,
         1 + (((event_id * (7 + 3 * r_regionkey) + 2 * r_regionkey) % 11) % 5) AS c,
         ((event_id + r_regionkey) % 11) / 10.0 AS alpha
  FROM numbered_events CROSS JOIN region""")
sql_view("prior_scores", """
  SELECT user_id AS subject_id, level, r_regionkey AS ord,
         r_name || CASE level WHEN 'country' THEN '' WHEN 'city' THEN ' City' ELSE ' Street' END AS label,
         ((user_id * (r_regionkey + 7 + CASE level WHEN 'country' THEN 0 WHEN 'city' THEN 1 ELSE 2 END)) % 100) / 100.0 AS raw
  FROM (SELECT DISTINCT user_id, level FROM numbered_events) CROSS JOIN region""")
sql_view("priors", """
  SELECT *, exp(least(raw, 0.6) / 1.5) / sum(exp(least(raw, 0.6) / 1.5)) OVER (PARTITION BY subject_id, level) AS p
  FROM prior_scores""")
sql_view("running_weights", """
  SELECT r.*, p.p AS p0, alpha * (c - 3) AS woe_bits, exp(alpha * (c - 3) * ln(2)) AS w,
         ln(p.p) + sum(alpha * (c - 3) * ln(2)) OVER (PARTITION BY r.subject_id, r.level, r.label ORDER BY step) AS s
  FROM ratings r JOIN priors p ON r.subject_id = p.subject_id AND r.level = p.level AND r.label = p.label""")
sql_view("step_beliefs", """
  SELECT *, exp(s - max(s) OVER w) AS e, exp(s - woe_bits * ln(2) - max(s - woe_bits * ln(2)) OVER w) AS f
  FROM running_weights WINDOW w AS (PARTITION BY subject_id, level, step)""")
sql_view("trajectory", """
  SELECT subject_id, event_id, level, step, ord, label, c, alpha, w, woe_bits, p, max(abs(p - q)) OVER (PARTITION BY subject_id, level, step) AS delta_p
  FROM (SELECT *, e / sum(e) OVER w AS p, f / sum(f) OVER w AS q FROM step_beliefs WINDOW w AS (PARTITION BY subject_id, level, step))""")
sql_view("step_facts", """
  SELECT subject_id, level, step, max(p) AS max_p, max(abs(woe_bits)) AS key_bits, max(delta_p) AS delta_p,
         bool_and(c <= 2) AS all_refuted, bool_or(c >= 4 AND alpha > 0) AS supported
  FROM trajectory GROUP BY ALL""")
sql_view("belief_event_rows", """
  SELECT subject_id, level, step, 'key_evidence' AS type FROM step_facts WHERE key_bits >= 1.0
  UNION ALL SELECT subject_id, level, step, 'backtrack' FROM step_facts WHERE level <> 'country' AND all_refuted
  UNION ALL SELECT subject_id, level, step, 'enhance_flag' FROM step_facts WHERE delta_p < 0.05 AND NOT (level <> 'country' AND all_refuted)
  UNION ALL SELECT subject_id, arg_min(level, step), min(step), 'threshold_crossed' FROM step_facts WHERE max_p >= 0.7 GROUP BY subject_id""")


def level_of(ts: str = "ts"):
    return (
        F.when(F.col(ts) < F.lit("2024-01-11").cast("timestamp"), "country")
        .when(F.col(ts) < F.lit("2024-01-21").cast("timestamp"), "city")
        .otherwise("street")
    )


def _level_label():
    suffix = F.when(F.col("level") == "country", "").when(F.col("level") == "city", " City").otherwise(" Street")
    return F.concat("r_name", suffix)


def rate_events(numbered: DataFrame, regions: DataFrame) -> DataFrame:
    """One rating per event and region. The regions are the fixed hypotheses (5 rows)."""
    r = F.col("r_regionkey")
    rated = numbered.crossJoin(F.broadcast(regions))
    c = 1 + ((F.col("event_id") * (7 + 3 * r) + 2 * r) % 11) % 5
    keep = [k for k in ("event_id", "ts", "step") if k in numbered.columns]
    return rated.select(
        F.col("user_id").alias("subject_id"), *keep, "level", r.alias("ord"), _level_label().alias("label"),
        c.cast("double").alias("c"), (((F.col("event_id") + r) % 11) / F.lit(10.0)).alias("alpha"),
    )


def numbered_events(spark, sf, **kw) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", "user_id").withColumn("level", level_of())
    return row_numbers(e, ["user_id"], ["ts", "event_id"], "step", **kw)


def busiest_user(spark, sf) -> int:
    """Events of the busiest user: bounds every group of the evidence tables."""
    return largest_group(table(spark, sf, "events"), ["user_id"])


def ratings(spark, sf, **kw) -> DataFrame:
    return rate_events(numbered_events(spark, sf, **kw), table(spark, sf, "region"))


def prior_scores(spark, sf) -> DataFrame:
    users = table(spark, sf, "events").select("user_id", level_of().alias("level")).distinct()
    depth = F.when(F.col("level") == "country", 0).when(F.col("level") == "city", 1).otherwise(2)
    return users.crossJoin(F.broadcast(table(spark, sf, "region"))).select(
        F.col("user_id").alias("subject_id"), "level", F.col("r_regionkey").alias("ord"), _level_label().alias("label"),
        (((F.col("user_id") * (F.col("r_regionkey") + 7 + depth)) % 100) / F.lit(100.0)).alias("raw"),
    )


def priors(spark, sf) -> DataFrame:
    from ..operators.beliefs import prior

    return prior(prior_scores(spark, sf), keys=("subject_id", "level"))


def trajectory(spark, sf, **kw) -> DataFrame:
    from ..operators.updating import sequential_posterior

    # A hypothesis has one row per event of its user, and its prior.
    kw.setdefault("at_most", busiest_user(spark, sf) + 1)
    about = table(spark, sf, "events").count() * table(spark, sf, "region").count()  # from file footers
    return sequential_posterior(priors(spark, sf), ratings(spark, sf, **kw), about=about, **kw)


# Cues and masks ----------------------------------------------------------------
# A cue is an (order, line) pair; line items that share it are its instances.

FRAME_W, FRAME_H = 64, 48

sql_view("instances", """
  SELECT subject_id, cue_idx, category, confidence, x1, y1, least(x1 + w, 64) AS x2, least(y1 + h, 48) AS y2,
         w, h, w * h > 0.4 * 64 * 48 AS degenerate
  FROM (SELECT l_orderkey AS subject_id, l_linenumber AS cue_idx, p_type AS category, l_discount * 10 AS confidence,
               l_partkey % 48 AS x1, l_suppkey % 32 AS y1, 1 + CAST(l_quantity AS INT) % 60 AS w, 1 + (l_partkey * 7) % 46 AS h
        FROM lineitem JOIN part ON l_partkey = p_partkey)""")
sql_view("instance_rows", """
  SELECT subject_id, cue_idx, y, x1, x2 FROM (SELECT *, unnest(generate_series(y1, y2 - 1)) AS y FROM instances WHERE NOT degenerate)""")
sql_view("cue_pixels", """
  SELECT subject_id, cue_idx, y, bit_or(((1::HUGEINT << (x2 - x1)::INT) - 1) << x1::INT) AS bits FROM instance_rows GROUP BY ALL""")
sql_view("subject_pixels", "SELECT subject_id, y, bit_or(bits) AS bits FROM cue_pixels GROUP BY ALL")


def instances(spark, sf) -> DataFrame:
    """Boxes of each cue, clipped to the frame; boxes over 40 % of the frame are degenerate."""
    l = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"))
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"))
    boxes = l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("subject_id"), F.col("l_linenumber").alias("cue_idx"), "category",
        (F.col("l_discount") * 10).alias("confidence"),
        (F.col("l_partkey") % 48).cast("int").alias("x1"), (F.col("l_suppkey") % 32).cast("int").alias("y1"),
        (1 + F.col("l_quantity").cast("int") % 60).alias("w"), (1 + (F.col("l_partkey") * 7) % 46).cast("int").alias("h"),
    )
    return boxes.withColumns({
        "x2": F.least(F.col("x1") + F.col("w"), F.lit(FRAME_W)),
        "y2": F.least(F.col("y1") + F.col("h"), F.lit(FRAME_H)),
        "degenerate": F.col("w") * F.col("h") > F.lit(0.4 * FRAME_W * FRAME_H),
    })


def boxes_by_subject(spark, sf) -> DataFrame:
    """Usable instances, those of a subject in one task."""
    good = instances(spark, sf).where(~F.col("degenerate")).select("subject_id", "cue_idx", "x1", "x2", "y1", "y2")
    return by_subject(spark, sf, good)


def by_subject(spark, sf, rows) -> DataFrame:
    """Rows of the tasks that hold the boxes of their subjects."""
    # Counted from file footers; a box becomes a row per pixel line, some 15.
    return dealt(rows, ["subject_id"], table(spark, sf, "lineitem").count(), task_rows=50_000)


def instance_rows(spark, sf) -> DataFrame:
    """One run [x1, x2) per pixel row of every usable instance; boxes go to the task of their subject before they become rows."""
    return boxes_by_subject(spark, sf).select("subject_id", "cue_idx", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y"), "x1", "x2")

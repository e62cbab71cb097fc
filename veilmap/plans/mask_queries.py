"""Mask runs, control placements and the control reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions
from ..operators import controls as C
from ..operators import lattice as L
from ..operators import leakage as K
from ..operators import masks as M
from ..operators import scoring
from ..operators.scale import summarise
from . import views as V
from .attribution import cue_values, with_category
from .registry import query, sql_view
from .views import FRAME_H, FRAME_W, rounded

# Run-length masks: one per usable line item, as counts over its row-major frame.


def rle_masks(spark, sf, boxes=None):
    """Boxes written as run-length counts: lead-in, then width and gap per row."""
    good = V.instances(spark, sf).where(~F.col("degenerate")) if boxes is None else boxes
    w = F.col("x2") - F.col("x1")
    lead = F.col("y1") * FRAME_W + F.col("x1")
    body = F.flatten(F.transform(F.sequence(F.col("y1"), F.col("y2") - 1), lambda y: F.array(w, F.lit(FRAME_W) - w)))
    tail = F.lit(FRAME_W * FRAME_H) - lead - (F.col("y2") - F.col("y1")) * FRAME_W + (F.lit(FRAME_W) - w)
    counts = F.concat(F.array(lead), F.slice(body, F.lit(1), F.size(body) - 1), F.array(tail))
    return good.select(
        "subject_id", "cue_idx", "x1", "x2", "y1", "y2", F.lit(FRAME_H).alias("h"), F.lit(FRAME_W).alias("w"), counts.alias("counts")
    )


@query("mask_decode", """
  SELECT y, count(*) AS n_runs, sum(x2 - x1)::BIGINT AS n_pixels, sum(x1)::BIGINT AS sum_x1 FROM instance_rows GROUP BY y""")
def mask_decode(spark, sf):
    """Decode every mask and profile the runs per pixel row."""
    masks = rle_masks(spark, sf).withColumn("inst_idx", F.monotonically_increasing_id())
    rows = M.split_rows(M.decode(masks))
    return rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("x2") - F.col("x1")).alias("n_pixels"), F.sum("x1").alias("sum_x1")
    )


@query("mask_decode_sql", """
  SELECT y, count(*) AS n_runs, sum(x2 - x1)::BIGINT AS n_pixels, sum(x1)::BIGINT AS sum_x1 FROM instance_rows GROUP BY y""")
def mask_decode_sql(spark, sf):
    """Runs per pixel row from SQL text, by the registered table function."""
    table_functions.register(spark)
    return spark.sql("""
      SELECT u.y, count(*) AS n_runs, sum(u.x2 - u.x1) AS n_pixels, sum(u.x1) AS sum_x1
      FROM {k} k, LATERAL mask_rows(k.counts, k.h, k.w) u GROUP BY u.y""", k=rle_masks(spark, sf).select("counts", "h", "w"))


sql_view("cue_union_runs", """
  SELECT subject_id, cue_idx, y, x AS start_x FROM (SELECT subject_id, cue_idx, y, bits, unnest(generate_series(0, 63)) AS x FROM cue_pixels)
  WHERE (bits >> x) & 1 = 1 AND (x = 0 OR (bits >> (x - 1)) & 1 = 0)""")


@query("mask_union", """
  SELECT p.subject_id, p.cue_idx, n_pixels, n_runs, first_y FROM
   (SELECT subject_id, cue_idx, sum(bit_count(bits))::BIGINT AS n_pixels, min(y) AS first_y FROM cue_pixels GROUP BY ALL) p
   JOIN (SELECT subject_id, cue_idx, count(*) AS n_runs FROM cue_union_runs GROUP BY ALL) r USING (subject_id, cue_idx)""")
def mask_union(spark, sf):
    rows = M.union_rows(V.instance_rows(spark, sf))
    return rows.groupBy("subject_id", "cue_idx").agg(
        F.sum(F.col("x2") - F.col("x1")).alias("n_pixels"), F.count(F.lit(1)).alias("n_runs"), F.min("y").alias("first_y")
    )


@query("mask_coverage", """
  SELECT subject_id, area, round(area / 3072.0, 6) + 0.0 AS cov FROM (SELECT subject_id, sum(bit_count(bits))::BIGINT AS area FROM subject_pixels GROUP BY subject_id)""")
def mask_coverage(spark, sf):
    c = M.coverage(V.instance_rows(spark, sf), FRAME_W, FRAME_H, keys=("subject_id",))
    return c.select("subject_id", "area", rounded("cov").alias("cov"))


@query("mask_translate", """
  SELECT subject_id, cue_idx, sum(x2 - x1)::BIGINT AS area, min(x1) AS x1, max(x2) AS x2, min(y) AS y1, max(y) AS y2 FROM (
    SELECT subject_id, cue_idx, y + (subject_id * 7 + cue_idx * 3) % 41 - 20 AS y, greatest(x1 + (subject_id * 5 + cue_idx * 11) % 51 - 25, 0) AS x1,
           least(x2 + (subject_id * 5 + cue_idx * 11) % 51 - 25, 64) AS x2 FROM instance_rows)
  WHERE y BETWEEN 0 AND 47 AND x1 < x2 GROUP BY ALL""")
def mask_translate(spark, sf):
    dx = ((F.col("subject_id") * 5 + F.col("cue_idx") * 11) % 51 - 25).cast("int")
    dy = ((F.col("subject_id") * 7 + F.col("cue_idx") * 3) % 41 - 20).cast("int")
    rows = M.translate(V.instance_rows(spark, sf), dx, dy, FRAME_W, FRAME_H)
    return rows.groupBy("subject_id", "cue_idx").agg(
        F.sum(F.col("x2") - F.col("x1")).alias("area"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2")
    )


@query("mask_overlap", """
  SELECT subject_id, cue_idx, sum(bit_count(c.bits & r.others))::BIGINT AS overlap FROM cue_pixels c JOIN
   (SELECT a.subject_id, a.cue_idx, a.y, bit_or(b.bits) AS others FROM cue_pixels a JOIN cue_pixels b ON a.subject_id = b.subject_id AND a.y = b.y AND b.cue_idx = a.cue_idx % 7 + 1
    GROUP BY ALL) r USING (subject_id, cue_idx, y) GROUP BY subject_id, cue_idx HAVING sum(bit_count(c.bits & r.others)) > 0""")
def mask_overlap(spark, sf):
    """Pixels each cue shares with the cue after it (line 7 with line 1)."""
    before = (F.col("cue_idx") + 5) % 7 + 1
    sides = F.array(F.struct("cue_idx", F.lit(True).alias("own")), F.struct(before.alias("cue_idx"), F.lit(False).alias("own")))
    rows = V.instance_rows(spark, sf).select("subject_id", F.explode(sides).alias("s"), "y", "x1", "x2").select("subject_id", "s.*", "y", "x1", "x2")
    return M.overlap_of_sides(M.words(rows, keys=("subject_id", "cue_idx", "own")))


sql_view("cue_extent", """
  SELECT c.subject_id, c.cue_idx, min(x1) AS x0, max(x2) - 1 AS xm, min(r.y) AS y0, max(r.y) AS ym FROM cue_pixels c JOIN instance_rows r USING (subject_id, cue_idx) GROUP BY ALL""")
sql_view("draws", """
  SELECT *, CASE WHEN xm - x0 < 63 THEN h % (63 - (xm - x0)) - x0 ELSE 0 END AS dx, CASE WHEN ym - y0 < 47 THEN (h // 61) % (47 - (ym - y0)) - y0 ELSE 0 END AS dy
  FROM (SELECT *, subject_id * 31 + cue_idx * 17 + placement * 101 + attempt * 7919 AS h
        FROM cue_extent CROSS JOIN (SELECT unnest(generate_series(0, 1)) AS placement) CROSS JOIN (SELECT unnest(generate_series(0, 39)) AS attempt))""")


sql_view("subject_frames", """
  SELECT subject_id, list(coalesce(bits, 0::HUGEINT) ORDER BY y) AS frame
  FROM (SELECT DISTINCT subject_id FROM subject_pixels) CROSS JOIN (SELECT unnest(generate_series(0, 47)) AS y) LEFT JOIN subject_pixels USING (subject_id, y) GROUP BY subject_id""")
sql_view("cue_lists", "SELECT subject_id, cue_idx, list(y ORDER BY y) AS ys, list(bits ORDER BY y) AS rows_, sum(bit_count(bits))::BIGINT AS area FROM cue_pixels GROUP BY ALL")


@query("control_placement", """
  WITH o AS (SELECT d.subject_id, d.cue_idx, d.placement, d.attempt, d.dx, d.dy, area,
                    list_sum(list_transform(range(1, len(ys) + 1), lambda i:
                      bit_count((CASE WHEN d.dx >= 0 THEN rows_[i] << d.dx::INT ELSE rows_[i] >> (-d.dx)::INT END) & frame[ys[i] + d.dy + 1])))::BIGINT AS overlap
             FROM draws d JOIN cue_lists c USING (subject_id, cue_idx) JOIN subject_frames s USING (subject_id))
  SELECT subject_id, cue_idx, placement, arg_min(dx, (overlap, attempt)) AS dx, arg_min(dy, (overlap, attempt)) AS dy, min(overlap) AS overlap,
         round(min(overlap) / max(area) + 1e-9, 6) AS overlap_frac FROM o GROUP BY subject_id, cue_idx, placement""")
def control_placement(spark, sf):
    key = F.col("subject_id") * 31 + F.col("cue_idx") * 17
    p = M.place_controls(V.instance_rows(spark, sf), FRAME_W, FRAME_H, 2, key=key)
    return p.select("subject_id", "cue_idx", "placement", "dx", "dy", "overlap", rounded(F.col("overlap_frac") + 1e-9).alias("overlap_frac"))


# Control effects on beliefs: control p of cue k hides as many dimensions as a cue does,
# as one contiguous, wrapping block.

sql_view("control_scores", """
  SELECT subject_id, m, k, placement, ord, sum(CASE WHEN (dim - start + 64) % 64 < 64 // m THEN 0.0 ELSE xc END) AS score
  FROM (SELECT e.vec_id AS subject_id, 1 + e.vec_id % 5 AS m, e.dim, c.label AS ord, e.x * c.c AS xc FROM components e JOIN centroids c ON e.dim = c.dim) d
  JOIN (SELECT subject_id, k, placement, (k * 16 + placement * 29 + subject_id * 7) % 64 AS start
        FROM (SELECT subject_id, unnest(generate_series(0, m - 1)) AS k FROM subjects) CROSS JOIN (SELECT unnest(generate_series(0, 1)) AS placement)) p USING (subject_id)
  GROUP BY ALL""")
sql_view("control_shifts", """
  SELECT c.subject_id, m, k, placement, c.ord, ln(b.p / c.p) AS llr
  FROM (SELECT *, e / sum(e) OVER w AS p FROM (SELECT *, exp(60.0 * (score - max(score) OVER (PARTITION BY subject_id, k, placement))) AS e FROM control_scores)
        WINDOW w AS (PARTITION BY subject_id, k, placement)) c
  JOIN (SELECT subject_id, ord, p FROM beliefs WHERE mask = 0) b ON b.subject_id = c.subject_id AND b.ord = c.ord""")
sql_view("control_leaks", """
  SELECT a.subject_id, a.m, a.k, a.placement, round(avg(abs(a.llr - b.llr) / d) * 1000, 9) AS mpl
  FROM pairs_small p JOIN control_shifts a ON a.ord = p.i JOIN control_shifts b ON b.ord = p.j AND a.subject_id = b.subject_id AND a.k = b.k AND a.placement = b.placement
  GROUP BY ALL""")
sql_view("control_rows", """
  SELECT *, v > c_max AS resolvable, v > c_mean AS above_mean, v - c_mean AS net, v / greatest(c_mean, 1e-9) AS ratio FROM (
  SELECT a.subject_id, a.k AS cue_idx, a.m, a.category, round(a.v_single, 9) AS v, a.v_all, a.phi, round(c_mean, 9) AS c_mean, c_max
  FROM attributed a JOIN (SELECT subject_id, k, avg(mpl) AS c_mean, max(mpl) AS c_max FROM control_leaks GROUP BY ALL) c ON a.subject_id = c.subject_id AND a.k = c.k)""")


def control_leaks(spark, sf):
    """(subject_id, m, cue_idx, placement, mpl) of two placements per cue."""
    size = F.floor(F.lit(64) / F.col("m"))
    f = V.features(spark, sf).select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"))
    f = f.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("placement"))
    start = (F.col("k") * 16 + F.col("placement") * 29 + F.col("subject_id") * 7) % 64
    hidden = F.transform("x", lambda v, i: F.when((i - start + 64) % 64 < size, F.lit(0.0)).otherwise(v.cast("double")))
    scorer = scoring.similarity_scorer(V.centroids(spark, sf), V.SCALE)
    rows = f.select("subject_id", "m", F.col("k").alias("cue_idx"), "placement", hidden.alias("view"), "x")
    scored = scoring.score_views(rows, scorer, {"view": "p", "x": "full"})
    leak = K.mpl(scored, V.geometry_small(spark, sf))
    return leak.select("subject_id", "m", "cue_idx", "placement", F.round("leak.mean", 9).alias("mpl"))


def control_rows(spark, sf):
    real = cue_values(spark, sf).select("subject_id", F.col("k").alias("cue_idx"), "m", "category", F.round("v_single", 9).alias("v"), "v_all", "phi")
    # A lone cue and its control hide the same dimensions: compare at nine decimals, free of summation noise.
    return C.control_table(real, control_leaks(spark, sf).drop("m"))


@query("control_table", """
  SELECT subject_id, cue_idx, round(v + 1e-10, 6) AS v, round(c_mean + 1e-10, 6) AS c_mean, round(c_max + 1e-10, 6) AS c_max, resolvable FROM control_rows""")
def control_table(spark, sf):
    t = control_rows(spark, sf)
    return t.select("subject_id", "cue_idx", *[rounded(F.col(c) + 1e-10).alias(c) for c in ("v", "c_mean", "c_max")], "resolvable")


@query("artifact_floor", """
  SELECT count(*) AS n, round(quantile_cont(mpl, 0.5) + 1e-10, 6) AS median, round(quantile_cont(mpl, 0.9) + 1e-10, 6) AS p90, round(max(mpl) + 1e-10, 6) AS max FROM control_leaks""")
def artifact_floor(spark, sf):
    f = C.artifact_floor(control_leaks(spark, sf), at_most=V.most_rows(spark, sf))
    return f.select("n", *[rounded(F.col(c) + 1e-10).alias(c) for c in ("median", "p90", "max")])


@query("resolvability", """
  SELECT category, count(*) AS n, round(avg(CASE WHEN resolvable THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share FROM control_rows GROUP BY category HAVING count(*) >= 3""")
def resolvability(spark, sf):
    return C.resolvability(control_rows(spark, sf), min_size=3).select("category", "n", rounded("share").alias("share"))


@query("control_summary", """
  SELECT n_cues, n_above_mean, n_resolvable, round(ratio_median, 5) + 0.0 AS ratio_median, round(c_median + 1e-10, 6) AS c_median, round(c_min + 1e-10, 6) AS c_min, round(c_max + 1e-10, 6) AS c_max,
         round(r_all, 6) + 0.0 AS corr_with_all, round(r_area, 6) + 0.0 AS corr_with_area FROM
  (SELECT count(*) AS n_cues, sum(above_mean::INT)::BIGINT AS n_above_mean, sum(resolvable::INT)::BIGINT AS n_resolvable, quantile_cont(ratio, 0.5) AS ratio_median, corr((64 // m) / 64.0, c_mean) AS r_area FROM control_rows)
  CROSS JOIN (SELECT quantile_cont(c, 0.5) AS c_median, min(c) AS c_min, max(c) AS c_max, corr(c, v_all) AS r_all
              FROM (SELECT subject_id, avg(mpl) AS c FROM control_leaks GROUP BY subject_id) JOIN (SELECT subject_id, max(v_all) AS v_all FROM attribution GROUP BY subject_id) USING (subject_id))""")
def control_summary(spark, sf):
    t = control_rows(spark, sf).withColumn("area_frac", F.floor(F.lit(64) / F.col("m")) / 64.0)
    cues = summarise(
        t, [],
        [F.count(F.lit(1)).alias("n_cues"), F.count_if("above_mean").alias("n_above_mean"), F.count_if("resolvable").alias("n_resolvable"), F.corr("area_frac", "c_mean").alias("r_area")],
        {"ratio_median": ("ratio", 0.5)},
        at_most=V.most_rows(spark, sf),
    )
    per = t.groupBy("subject_id").agg((F.sum("c_mean") / F.count(F.lit(1))).alias("c"), F.max("v_all").alias("v_all"))
    images = summarise(per, [], [F.min("c").alias("c_min"), F.max("c").alias("c_max"), F.corr("c", "v_all").alias("r_all")], {"c_median": ("c", 0.5)}, at_most=V.most_rows(spark, sf))
    out = cues.crossJoin(F.broadcast(images))  # one row each
    return out.select(
        "n_cues", "n_above_mean", "n_resolvable", rounded("ratio_median", 5).alias("ratio_median"), *[rounded(F.col(c) + 1e-10).alias(c) for c in ("c_median", "c_min", "c_max")],
        rounded("r_all").alias("corr_with_all"), rounded("r_area").alias("corr_with_area"),
    )


@query("net_leakage", """
  SELECT CASE WHEN net > 0.01 THEN 'above' WHEN net < -0.01 THEN 'below' ELSE 'level' END AS class, count(*) AS n, round(avg(net), 6) + 0.0 AS mean_net, round(quantile_cont(v, 0.5) + 1e-10, 6) AS real_median,
         round(quantile_cont(c_mean, 0.5) + 1e-10, 6) AS control_median FROM control_rows GROUP BY class""")
def net_leakage(spark, sf):
    t = control_rows(spark, sf).withColumn("class", C.net_class())
    out = summarise(t, ["class"], [F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean_net")], {"real_median": ("v", 0.5), "control_median": ("c_mean", 0.5)}, at_most=V.most_rows(spark, sf))
    medians = [rounded(F.col(c) + 1e-10).alias(c) for c in ("real_median", "control_median")]
    return out.select("class", "n", rounded("mean_net").alias("mean_net"), *medians)


@query("corrected_shapley", """
  SELECT category, n, n_negative, round(phi_median, 6) + 0.0 AS phi_median, round(corrected_median, 6) + 0.0 AS corrected_median,
         rank() OVER (ORDER BY round(phi_median, 9) DESC) - rank() OVER (ORDER BY round(corrected_median, 9) DESC) AS rank_change
  FROM (SELECT category, count(*) AS n, sum(CASE WHEN phi - c / m < -0.01 THEN 1 ELSE 0 END)::BIGINT AS n_negative, quantile_cont(phi, 0.5) AS phi_median, quantile_cont(phi - c / m, 0.5) AS corrected_median
        FROM attributed JOIN (SELECT subject_id, avg(mpl) AS c FROM control_leaks GROUP BY subject_id) USING (subject_id) GROUP BY category)""")
def corrected_shapley(spark, sf):
    from pyspark.sql import Window as W

    phi = with_category(spark, sf, L.shapley(V.lattice(spark, sf)))
    cats = C.corrected_categories(C.corrected_shapley(phi, control_leaks(spark, sf).drop("m")), at_most=V.most_rows(spark, sf))
    # One row per category.
    change = F.rank().over(W.orderBy(F.round("phi_median", 9).desc())) - F.rank().over(W.orderBy(F.round("corrected_median", 9).desc()))
    return cats.select("category", "n", "n_negative", rounded("phi_median").alias("phi_median"), rounded("corrected_median").alias("corrected_median"), change.alias("rank_change"))

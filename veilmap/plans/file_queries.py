"""The file layouts: tables written in each layout below the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import haversine_km
from ..operators import beliefs as B
from ..operators import evaluation as E
from ..operators import geometry as G
from ..operators import masks as M
from ..operators.scale import row_numbers
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks
from . import views as V
from .mask_queries import rle_masks
from .place_queries import annotations
from .registry import query, sql_view
from .views import rounded


def arrays_of(records: DataFrame, key, path: str) -> str:
    """One JSON array per value of a key, each in a folder of its own; the keys are as many as the input needs."""
    one = records.select(key.alias("part"), F.struct("*").alias("__r")).groupBy("part").agg(F.to_json(F.collect_list("__r")).alias("value"))
    one.write.partitionBy("part").text(path)
    return path


@query("read_subjects", """
  SELECT c_custkey::VARCHAR AS image_id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS lat, n_name AS gt_country
  FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def read_subjects(spark, sf):
    """Two shards of JSON lines; a third of the subjects comes again in the later one."""
    base = scratch_path(spark, "subjects")
    n = V.table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = V.table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("c_custkey").cast("string").alias("image_id"), F.lit("x.jpg").alias("path"), F.col("c_acctbal").cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.col("n_name").alias("gt_country"))
    rows.write.json(f"{base}/shard_a")
    rows.where(F.col("image_id").cast("bigint") % 3 == 0).withColumn("lat", F.col("lat") + 1).write.json(f"{base}/shard_b")
    return R.read_subjects(spark, [f"{base}/shard_a", f"{base}/shard_b"]).select("image_id", "lat", "gt_country")


@query("read_cues", """
  SELECT l_orderkey::VARCHAR AS subject_id, count(*) AS n_cues, count(*) FILTER (WHERE l_linenumber % 3 > 0) AS n_masks, string_agg('c' || l_linenumber || l_returnflag, ',' ORDER BY l_linenumber) AS cues,
         sum(CASE WHEN l_linenumber % 3 > 0 THEN l_partkey % 50 + l_linenumber ELSE 0 END)::BIGINT AS pixels
  FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def read_cues(spark, sf):
    """Nested cue annotations: cues in order, and the pixels of their masks."""
    l = V.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part"))
    on = (F.col("part") % 50 + F.col("l_linenumber")).cast("int")
    rle = F.struct(F.array(F.lit(48), F.lit(64)).alias("size"), F.array(F.lit(7), on, F.lit(3065) - on).alias("counts"))
    instance = F.struct(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), F.lit(0.5).alias("score"), rle.alias("mask_rle"), F.lit(False).alias("degenerate"))
    cue = F.struct("l_linenumber", F.concat(F.lit("c"), "l_linenumber", "flag").alias("cue"), F.when(F.col("l_linenumber") % 3 > 0, F.array(instance)).alias("instances"))
    images = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(cue)).alias("geo_privacy_cues"))
    images = images.select(F.col("l_orderkey").cast("string").alias("image_id"), F.array(F.lit(64), F.lit(48)).alias("image_size"), "geo_privacy_cues")
    path = arrays_of(images, F.floor(F.col("image_id").cast("bigint") / 1000), scratch_path(spark, "cues"))
    cues, instances = R.read_cues(spark, path)
    runs = M.decode(instances).groupBy("subject_id").agg(F.sum(F.col("end") - F.col("start")).alias("pixels"), F.count_distinct("cue_idx").alias("n_masks"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cue"))), lambda s: s["cue"])
    out = cues.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_cues"), F.array_join(named, ",").alias("cues")).join(runs, "subject_id", "left")
    return out.select("subject_id", "n_cues", F.coalesce("n_masks", F.lit(0)).alias("n_masks"), "cues", F.coalesce("pixels", F.lit(0)).alias("pixels"))


def _spread_belief(shift: int):
    share = lambda k: ((F.col("c_custkey") * (k + 3) + shift) % 17 + 1) / F.lit(40.0)
    return F.create_map(F.lit("north"), share(0), F.lit("south"), share(1))


_SHARE = "((c_custkey * (k + 3) + s) % 17 + 1) / 40.0"


@query("read_lattice", f"""
  SELECT c_custkey::VARCHAR AS subject_id, mask::BIGINT AS mask, label, k AS ord, round({_SHARE}, 6) + 0.0 AS p FROM customer
  CROSS JOIN (VALUES (0, 1), (1, 2), (5, 4)) m(mask, s) CROSS JOIN (VALUES ('north', 0), ('south', 1)) l(label, k)""")
def read_lattice(spark, sf):
    """Ablation files: a posterior, and the beliefs with cue 0 and with cues 0 and 2 hidden."""
    combo = lambda subset, shift: F.struct(F.array(*[F.lit(k) for k in subset]).alias("subset"), _spread_belief(shift).alias("prior"))
    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("image_id"), _spread_belief(1).alias("posterior"), F.array(combo([0], 2), combo([0, 2], 4)).alias("combos"))
    path = arrays_of(c, F.floor(F.col("c_custkey") / 500), scratch_path(spark, "lattice"))
    return R.read_lattice(spark, path).select("subject_id", "mask", "label", "ord", rounded("p").alias("p"))


@query("read_sweep", f"""
  WITH d AS (SELECT c_custkey, c_custkey % 3 AS n FROM customer), m AS (SELECT c_custkey, 0 AS mask, 1 AS s FROM d
    UNION ALL SELECT c_custkey, (1 << n) - 1, 2 FROM d WHERE n >= 1 UNION ALL SELECT c_custkey, 1 << i, 3 + i FROM d, (VALUES (0), (1)) v(i) WHERE n = 2)
  SELECT c_custkey::VARCHAR AS subject_id, mask::BIGINT AS mask, label, round({_SHARE}, 6) + 0.0 AS p, (c_custkey % 3)::BIGINT AS n_cues,
         round(CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 0.5 ELSE 1.5 END, 6) + 0.0 AS v_sum
  FROM m CROSS JOIN (VALUES ('north', 0), ('south', 1)) l(label, k)""")
def read_sweep(spark, sf):
    """Sweep records of subjects with none, one or two cues."""
    n = F.col("c_custkey") % 3
    cue = lambda i: F.struct(F.lit(f"cue {i}").alias("cue"), F.lit("sign").alias("category"), F.lit(0.5 + 0.5 * i).alias("mpl"), _spread_belief(3 + i).alias("prior"))
    c = V.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_custkey").cast("string").alias("image_id"), n.cast("int").alias("n_cues"), _spread_belief(1).alias("posterior"),
        F.when(n > 0, _spread_belief(2)).alias("prior_allmask"), F.slice(F.array(cue(0), cue(1)), F.lit(1), n.cast("int")).alias("per_cue"),
    )
    beliefs, cues = R.read_sweep(spark, arrays_of(c, F.floor(F.col("c_custkey") / 500), scratch_path(spark, "sweep")))
    per = cues.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_cues"), F.sum("v").alias("v_sum"))
    out = beliefs.join(per, "subject_id", "left")
    return out.select("subject_id", "mask", "label", rounded("p").alias("p"), F.coalesce("n_cues", F.lit(0)).alias("n_cues"), rounded(F.coalesce("v_sum", F.lit(0.0))).alias("v_sum"))


@query("read_sweep_split", f"""
  WITH m AS (SELECT c_custkey, 0 AS mask, 1 AS s FROM customer UNION ALL SELECT c_custkey, 1, 2 FROM customer)
  SELECT c_custkey::VARCHAR AS subject_id, mask::BIGINT AS mask, label, round({_SHARE}, 6) + 0.0 AS p,
         CASE c_custkey % 4 WHEN 0 THEN 'a "sign", {{left}}' WHEN 1 THEN '}}]' || chr(92) WHEN 2 THEN chr(92) || '"{{' ELSE c_name END AS cue, c_acctbal::DOUBLE AS v
  FROM m JOIN customer USING (c_custkey) CROSS JOIN (VALUES ('north', 0), ('south', 1)) l(label, k)""")
def read_sweep_split(spark, sf):
    """Arrays of 20,000 records, each on one line, read by as many tasks as the splits allow; cue names hold braces, quotes and backslashes."""
    by, back = F.col("c_custkey") % 4, chr(92)
    name = F.when(by == 0, 'a "sign", {left}').when(by == 1, "}]" + back).when(by == 2, back + '"{').otherwise(F.col("c_name"))
    cue = F.struct(name.alias("cue"), F.lit("sign").alias("category"), F.col("c_acctbal").cast("double").alias("mpl"))
    c = V.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_custkey").cast("string").alias("image_id"), F.lit(1).alias("n_cues"), _spread_belief(1).alias("posterior"),
        _spread_belief(2).alias("prior_allmask"), F.array(cue).alias("per_cue"),
    )
    beliefs, cues = R.read_sweep(spark, arrays_of(c, F.floor(F.col("c_custkey") / 20_000), scratch_path(spark, "sweep")), split=True)
    return beliefs.join(cues.select("subject_id", "cue", "v"), "subject_id").select("subject_id", "mask", "label", rounded("p").alias("p"), "cue", "v")


@query("read_points", """
  SELECT s_suppkey || '.jpg' AS subject_id, (s_nationkey - 12) * 5.25 AS lat, s_acctbal / 100.0 AS lon FROM supplier""")
def read_points(spark, sf):
    s = V.table(spark, sf, "supplier").select(F.concat("s_suppkey", F.lit(".jpg")).alias("IMG_ID"), ((F.col("s_nationkey") - 12) * 5.25).alias("LAT"), (F.col("s_acctbal") / F.lit(100.0)).alias("LON"))
    path = scratch_path(spark, "points")
    s.write.option("header", True).csv(path)
    return R.read_points_csv(spark, path)


def _caches(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Both cache maps as files: of the 25 places every fifth is unknown and every fifth could not be located."""
    base, g = scratch_path(spark, "geocode"), V.nation_geo(spark, sf)
    entry = lambda key, value: F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value))))
    by_coord = g.agg(entry(F.concat_ws(",", F.format_string("%.5f", F.col("lat")), F.format_string("%.5f", F.col("lon"))).alias("k"), F.col("label").alias("v")).alias("value"))
    located = F.when(F.col("n_nationkey") % 5 != 1, F.array("lat", "lon"))
    by_name = g.where(F.col("n_nationkey") % 5 != 0).agg(entry(F.col("label").alias("k"), located.alias("v")).alias("value"))
    by_coord.write.text(f"{base}/coordinates")
    by_name.write.text(f"{base}/names")
    return R.read_geocode_cache(spark, f"{base}/coordinates", f"{base}/names")


@query("read_geocode_cache", """
  SELECT 'name' AS what, label, CASE WHEN n_nationkey % 5 <> 1 THEN lat END AS lat, CASE WHEN n_nationkey % 5 <> 1 THEN lon END AS lon FROM nation_geo WHERE n_nationkey % 5 <> 0
  UNION ALL SELECT 'coordinate', label, round(lat * 100000), round(lon * 100000) FROM nation_geo""")
def read_geocode_cache(spark, sf):
    by_coord, by_name = _caches(spark, sf)
    keys = by_coord.select(F.lit("coordinate").alias("what"), "label", F.col("lat_key").cast("double").alias("lat"), F.col("lon_key").cast("double").alias("lon"))
    return by_name.select(F.lit("name").alias("what"), F.col("name").alias("label"), "lat", "lon").unionByName(keys)


sql_view("best_names", """
  SELECT c_custkey AS subject_id, c_nationkey AS own, CASE WHEN c_custkey % 4 = 0 THEN b.label WHEN c_custkey % 4 = 3 THEN '' ELSE a.label END AS name
  FROM customer JOIN nation_geo a ON a.n_nationkey = c_nationkey JOIN nation_geo b ON b.n_nationkey = (c_nationkey + 1) % 25""")


def best_names(spark, sf) -> DataFrame:
    """The better of two candidate places per customer; a quarter has none."""
    g = V.nation_geo(spark, sf).select("n_nationkey", "label")
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), "c_nationkey")
    two = c.where(F.col("subject_id") % 4 != 3).withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1))))
    two = two.join(F.broadcast(g), F.col("n_nationkey") == (F.col("c_nationkey") + F.col("ord")) % 25)
    p = F.when(F.col("subject_id") % 4 == 0, F.lit(0.3) + F.col("ord") * 0.4).otherwise(F.lit(0.6) - F.col("ord") * 0.2)
    names = B.hierarchical_name(two.select("subject_id", F.lit("country").alias("level"), "label", "ord", p.alias("p")))
    return c.join(names, "subject_id", "left").select("subject_id", F.col("c_nationkey").alias("own"), F.coalesce("name", F.lit("")).alias("name"))


@query("localization_distance", """
  SELECT n.subject_id, n.name, round(CASE WHEN f.n_nationkey % 5 > 1 THEN 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(t.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - f.lon) / 2), 2)))) END, 3) + 0.0 AS km
  FROM best_names n JOIN nation_geo t ON t.n_nationkey = own LEFT JOIN nation_geo f ON f.label = n.name""")
def localization_distance(spark, sf):
    """Best name, its place in the lookup table, and the distance to the truth."""
    found, _ = R.geocode(best_names(spark, sf), "name", _caches(spark, sf)[1])
    truth = V.nation_geo(spark, sf).select("n_nationkey", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    out = found.join(F.broadcast(truth), F.col("own") == F.col("n_nationkey"))
    return out.select("subject_id", "name", rounded(haversine_km("lat", "lon", "tlat", "tlon"), 3).alias("km"))


@query("geocode_work_list", """
  SELECT DISTINCT name FROM best_names JOIN nation_geo ON label = name WHERE n_nationkey % 5 = 0""")
def geocode_work_list(spark, sf):
    """Names that the lookup table does not hold yet; those known to have no place are not asked again."""
    return R.geocode(best_names(spark, sf), "name", _caches(spark, sf)[1])[1]


@query("report_order", """
  SELECT o_custkey AS subject_id, v, row_number() OVER (ORDER BY coalesce(v, 0) DESC, o_custkey) AS place, (SELECT count(DISTINCT o_custkey) FROM orders) AS n
  FROM (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice, 2) END) AS v FROM orders GROUP BY o_custkey)""")
def report_order(spark, sf):
    """A report written and read back: its detail rows lie in order, a missing value counts as 0."""
    o = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject_id")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.round("o_totalprice", 2))).alias("v"))
    path = scratch_path(spark, "report")
    sinks.write_report(o.agg(F.count(F.lit(1)).alias("n")), o, path, sort=sinks.detail_order("v"))
    lines = spark.read.parquet(f"{path}/detail").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("line"))
    placed = row_numbers(lines, [], ["file", "line"], "place", group_rows=0, at_most=1).select("subject_id", "v", "place")
    return placed.crossJoin(F.broadcast(spark.read.schema("n bigint").json(f"{path}/summary")))


@query("mask_round_trip", """
  SELECT n_runs, count(*) AS n, sum(pixels)::BIGINT AS pixels FROM (
    SELECT 2 * CASE WHEN x2 - x1 = 64 THEN 1 ELSE y2 - y1 END + CASE WHEN x2 = 64 AND y2 = 48 THEN 0 ELSE 1 END AS n_runs, (x2 - x1) * (y2 - y1) AS pixels FROM instances WHERE NOT degenerate) GROUP BY n_runs""")
def mask_round_trip(spark, sf):
    """Decoded and encoded again: as few runs as the mask has."""
    masks = rle_masks(spark, sf, V.boxes_by_subject(spark, sf)).withColumn("inst_idx", F.xxhash64("*"))
    masks = masks.groupBy(*M.INSTANCE, "h", "w", "counts").agg(F.count(F.lit(1)).alias("times"))
    keys = [*M.INSTANCE, "times"]  # no mask is empty, so that all come back
    out = M.encode(M.decode(masks, keys=keys, dealt=True), keys=keys).select(*keys, F.col("counts").alias("again"))
    on = F.aggregate(F.filter("again", lambda x, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.groupBy(F.size("again").alias("n_runs")).agg(F.sum("times").alias("n"), F.sum(on * F.col("times")).alias("pixels"))


@query("pairs_above_floor", """
  WITH d AS (SELECT 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS d
             FROM gallery_large a JOIN gallery_large b ON a.ord < b.ord)
  SELECT f.km AS floor_km, count(*) AS n, round(avg(1 / d), 9) + 0.0 AS closeness FROM d JOIN (VALUES (0.0), (25.0)) f(km) ON d > 0 AND d >= f.km GROUP BY f.km""")
def pairs_above_floor(spark, sf):
    """Candidate pairs with and without the 25 km floor."""
    far = F.explode(F.array(F.lit(0.0), F.lit(25.0))).alias("floor_km")
    p = G.site_pairs(V.gallery_large(spark, sf)).select("*", far).where(F.col("d") >= F.col("floor_km"))
    mean = F.sum(F.col("n") / F.col("d")) / F.sum("n")
    return p.groupBy("floor_km").agg(F.sum("n").alias("n"), rounded(mean, 9).alias("closeness"))


@query("confidence_crosstab", """
  SELECT CASE WHEN l_linenumber % 4 = 0 THEN 'high' WHEN l_linenumber % 4 = 1 THEN 'medium' WHEN l_linenumber % 4 = 2 THEN 'low' ELSE 'other' END AS bin, outcome, count(*) AS n FROM annotations GROUP BY ALL""")
def confidence_crosstab(spark, sf):
    """Outcome by confidence given in words."""
    at = F.col("l_linenumber") % 4
    words = F.when(at == 0, " High").when(at == 1, "medium").when(at == 2, "LOW ").otherwise("sure?")
    rows = annotations(spark, sf).select("outcome", words.alias("confidence"))
    return rows.groupBy(E.confidence_level("confidence").alias("bin"), "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("mask_frames", """
  SELECT subject_id % 2 = 1 AS narrow, count(*) FILTER (WHERE fits) AS kept, count(*) FILTER (WHERE NOT fits) AS dropped FROM (
    SELECT subject_id, (subject_id % 2 = 0) = (cue_idx % 3 > 0) AS fits FROM instances WHERE NOT degenerate) GROUP BY 1""")
def mask_frames(spark, sf):
    """Masks of another size than their image are dropped and counted; masks and images are dealt alike."""
    masks = rle_masks(spark, sf, V.boxes_by_subject(spark, sf))
    wide = F.col("cue_idx") % 3 > 0
    masks = masks.withColumns({"w": F.when(wide, F.col("w")).otherwise(F.col("h")), "h": F.when(wide, F.col("h")).otherwise(F.col("w"))})
    images = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("subject_id"), F.when(F.col("o_orderkey") % 2 == 0, 64).otherwise(48).alias("w"), F.when(F.col("o_orderkey") % 2 == 0, 48).otherwise(64).alias("h"))
    images = V.by_subject(spark, sf, images)
    kept, dropped = M.of_frame(masks, images)
    both = kept.select("subject_id", F.lit(1).alias("k")).unionByName(dropped.select("subject_id", F.lit(0).alias("k")))
    return both.groupBy((F.col("subject_id") % 2 == 1).alias("narrow")).agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("dropped"))

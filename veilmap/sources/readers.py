"""Readers for the file layouts of the data model. Schemas are explicit, nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import mask_of
from .json_arrays import read_array


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in the given order; one map-side combined aggregate."""
    payload = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*payload), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in payload])


def read_subjects(spark: SparkSession, paths: str | list[str], schema: str = schemas.SUBJECTS, key: str = "image_id") -> DataFrame:
    """Union of JSON-lines shards; per id the later file (by name), then the later line, wins."""
    rows = spark.read.schema(schema).json(paths).select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    )
    kept = rows.where(F.col(key).isNotNull())
    return last_wins(kept, [key], ["__file", "__block", "__line"]).drop("__file", "__block", "__line")


def read_cues(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Nested cue annotations -> (cues, instances with their run-length masks)."""
    raw = spark.read.schema(schemas.CUES).option("multiLine", True).json(path)
    cues = raw.select(
        F.col("image_id").alias("subject_id"), F.col("image_size")[0].alias("w"), F.col("image_size")[1].alias("h"),
        F.posexplode("geo_privacy_cues").alias("pos", "c"),
    ).select("subject_id", "w", "h", "pos", "c.*")
    each = cues.select("subject_id", F.col("pos").alias("cue_idx"), F.posexplode("instances").alias("inst_idx", "i"))
    instances = each.select(
        "subject_id", "cue_idx", "inst_idx", "i.bbox", "i.score", "i.source", "i.degenerate",
        F.col("i.mask_rle.size")[0].alias("h"), F.col("i.mask_rle.size")[1].alias("w"), F.col("i.mask_rle.counts").alias("counts"),
    )
    return cues, instances


def _label_rows(df: DataFrame, keys: Sequence[str], dist: str) -> DataFrame:
    # Label order within a distribution is its order in the gallery; here the order in the file.
    return df.select(*keys, F.posexplode(F.map_entries(dist)).alias("ord", "e")).select(
        *keys, "ord", F.col("e.key").alias("label"), F.col("e.value").alias("p")
    )


def read_lattice(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per-image ablation files -> long beliefs (subject_id, mask, label, ord, p); mask 0 is the posterior."""
    raw = spark.read.schema(schemas.LATTICE).option("multiLine", True).json(path)
    full = raw.select(F.col("image_id").alias("subject_id"), F.lit(0).cast("bigint").alias("mask"), F.col("posterior").alias("d"))
    combos = raw.select(F.col("image_id").alias("subject_id"), F.explode("combos").alias("c")).select(
        "subject_id", mask_of("c.subset").alias("mask"), F.col("c.prior").alias("d")
    )
    return _label_rows(full.unionByName(combos), ["subject_id", "mask"], "d")


def read_sweep(spark: SparkSession, path: str, *, split: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sweep records -> (long beliefs, cues). Mask 0 is the posterior, bit k hides cue k.

    With ``split`` a large array is read by many tasks; without, each file is read by one.
    """
    raw = read_array(spark, path, schemas.SWEEP) if split else spark.read.schema(schemas.SWEEP).option("multiLine", True).json(path)
    raw = raw.withColumnRenamed("image_id", "subject_id")
    one = F.lit(1).cast("bigint")
    bit = lambda k: F.call_function("shiftleft", one, k.cast("int"))
    belief = lambda mask, d: F.struct(mask.cast("bigint").alias("mask"), d.alias("d"))
    each_cue = F.transform("per_cue", lambda c, k: belief(F.when(F.col("n_cues") > 1, bit(k)), c["prior"]))
    every = belief(F.when(F.col("n_cues") >= 1, bit(F.col("n_cues")) - 1), F.col("prior_allmask"))
    # All beliefs of a record leave it at once, so the files are read once.
    dists = F.concat(F.array(belief(F.lit(0), F.col("posterior")), every), F.coalesce(each_cue, F.array()))
    one_each = raw.select("subject_id", F.explode(dists).alias("b")).where(F.col("b.mask").isNotNull() & F.col("b.d").isNotNull())
    beliefs = _label_rows(one_each.select("subject_id", "b.mask", "b.d"), ["subject_id", "mask"], "d")
    each = raw.select("subject_id", "n_cues", F.posexplode("per_cue").alias("k", "c"))
    cues = each.select("subject_id", F.col("n_cues").alias("m"), "k", "c.cue", "c.category", F.col("c.mpl").alias("v"))
    return beliefs, cues


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    points = spark.read.schema(schemas.POINTS).option("header", True).csv(path)
    return points.select(F.col("IMG_ID").alias("subject_id"), F.col("LAT").alias("lat"), F.col("LON").alias("lon"))


def read_gallery(spark: SparkSession, path: str) -> DataFrame:
    """Gallery records -> (label, ord, lat, lon, text, ref_image); ord is the position in the file."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.posexplode(F.from_json("value", f"array<struct<{_struct(schemas.GALLERY)}>>")).alias("ord", "g"))
    return rows.select("g.label", "ord", F.col("g.gps")[0].alias("lat"), F.col("g.gps")[1].alias("lon"), "g.text", "g.ref_image")


def _struct(schema: str) -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in schema.split(", "))


def read_geocode_cache(spark: SparkSession, coordinates: str, names: str) -> tuple[DataFrame, DataFrame]:
    """Two cache maps -> (place_by_coord(lat_key, lon_key, label), coord_by_name(name, lat, lon)).

    A name that could not be located keeps its row with null coordinates.
    """
    from ..functions.columns import coordinate_key

    by_coord = spark.read.text(coordinates, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "label"))
    part = F.split("k", ",")
    by_coord = by_coord.select(coordinate_key(part[0]).alias("lat_key"), coordinate_key(part[1]).alias("lon_key"), "label")
    by_name = spark.read.text(names, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("name", "g"))
    return by_coord, by_name.select("name", F.col("g")[0].alias("lat"), F.col("g")[1].alias("lon"))


def geocode(df: DataFrame, name: str, coord_by_name: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lookup in the table: (rows with lat/lon, names the table does not know yet)."""
    table = coord_by_name.select(F.col("name").alias("__name"), "lat", "lon")
    found = df.join(table, F.col(name) == F.col("__name"), "left").drop("__name")
    unknown = df.select(F.col(name).alias("name")).where(F.col("name") != "").distinct().join(coord_by_name.select("name"), "name", "left_anti")
    return found, unknown

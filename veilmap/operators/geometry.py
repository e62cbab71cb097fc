"""Places on the sphere: grid cells, range joins, greedy clustering, nearest labels.

The grid has latitude bands; every band is cut into longitude cells of about
the same width in km. A point lies in one cell, a search circle covers a few
dozen. Joins run on the cell, so their size follows the number of true
neighbours rather than the number of pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import haversine_km
from ..functions.fixed_values import EARTH_RADIUS_KM, PLACE_FIELDS
from ..session import checkpointed
from .scale import broadcast_within

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0
CELL_SHARE = 0.66  # cell side / radius: a cell's diagonal stays below the radius
GALLERY_ROWS = 5_000
GRIDS = 7  # search grids of 1, 4, 16 ... 4096 km


def _number(km: float | Column) -> Column:
    return km if isinstance(km, Column) else F.lit(float(km))


def _cells_in_band(band: Column, km: Column) -> Column:
    side = km * CELL_SHARE
    step = side / KM_PER_DEGREE
    south = band * step - 90.0
    north = south + step
    nearest = F.when((south <= 0) & (north >= 0), 0.0).otherwise(F.least(F.abs(south), F.abs(north)))
    around = F.cos(F.radians(F.least(nearest, F.lit(90.0)))) * (2 * math.pi * EARTH_RADIUS_KM)
    return F.greatest(F.lit(1), F.ceil(around / side)).cast("bigint")


def with_cell(df: DataFrame, km: float | Column) -> DataFrame:
    """Adds the grid cell (band, cell) of each point."""
    km = _number(km)
    df = df.withColumn("band", F.floor((F.col("lat") + 90.0) / (km * CELL_SHARE / KM_PER_DEGREE)))
    n = _cells_in_band(F.col("band"), km)
    return df.withColumn("cell", F.pmod(F.floor((F.col("lon") + 180.0) / 360.0 * n), n))


def with_cover(df: DataFrame, km: float | Column) -> DataFrame:
    """One row per grid cell that a circle of ``km`` around the point can touch."""
    km = _number(km)
    step = km * CELL_SHARE / KM_PER_DEGREE
    reach = km / KM_PER_DEGREE + 1e-7
    bands = F.sequence(F.floor((F.col("lat") - reach + 90.0) / step), F.floor((F.col("lat") + reach + 90.0) / step))
    df = df.withColumn("band", F.explode(bands))
    n = _cells_in_band(F.col("band"), km)
    at_pole = F.abs("lat") + reach >= 90.0
    angle = F.sin(F.least(km / EARTH_RADIUS_KM, F.lit(math.pi / 2)))
    half = F.degrees(F.asin(F.least(F.lit(1.0), angle / F.cos(F.radians("lat"))))) + 1e-7
    first = F.when(at_pole, F.lit(0).cast("bigint")).otherwise(F.floor((F.col("lon") - half + 180.0) / 360.0 * n))
    last = F.when(at_pole, n - 1).otherwise(F.least(F.floor((F.col("lon") + half + 180.0) / 360.0 * n), first + n - 1))
    return df.withColumn("__n", n).withColumn("__c", F.explode(F.sequence(first, last))).withColumn(
        "cell", F.pmod("__c", "__n")
    ).drop("__c", "__n")


def range_join(points: DataFrame, probes: DataFrame, km: float, *, strict: bool = True) -> DataFrame:
    """(point, probe, d) with d < km. ``probes`` is the smaller side: it is spread over the grid."""
    p = with_cell(points.select(F.col("label").alias("point"), "lat", "lon"), km)
    q = with_cover(probes.select(F.col("label").alias("probe"), "lat", "lon"), km)
    q = q.select("probe", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), "band", "cell")
    joined = p.join(q, ["band", "cell"]).withColumn("d", haversine_km("lat", "lon", "qlat", "qlon"))
    near = F.col("d") < km if strict else F.col("d") <= km
    return joined.where(near).select("point", "probe", "d")


def sites(places: DataFrame) -> DataFrame:
    """Distinct coordinates with their first label; copies of a place collapse here."""
    located = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return located.groupBy("lat", "lon").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))


def near_sites(places: DataFrame, km: float) -> DataFrame:
    """Places closer than ``km``, per pair of distinct sites with the number of
    label pairs they stand for; labels sharing a site appear as (i, i, 0)."""
    s = sites(places)
    pairs = range_join(s, s, km).where(F.col("point") < F.col("probe"))
    count = s.select("label", "n")
    across = (
        pairs.join(count.withColumnsRenamed({"label": "point", "n": "n_i"}), "point")
        .join(count.withColumnsRenamed({"label": "probe", "n": "n_j"}), "probe")
        .select(F.col("point").alias("i"), F.col("probe").alias("j"), "d", (F.col("n_i") * F.col("n_j")).alias("n_pairs"))
    )
    within = s.where(F.col("n") > 1).select(
        F.col("label").alias("i"), F.col("label").alias("j"), F.lit(0.0).alias("d"),
        F.expr("n * (n - 1) div 2").alias("n_pairs"),
    )
    return across.unionByName(within)


LISTED = 8  # first undecided places of a cell that a round looks at
TILE = 16  # side of a tile in radii


def _settle(km: float):
    """Works through the listed places of one tile in label order and gives those that are surely centres.

    A place is taken if a centre with a smaller label is near, a centre if all nearer places of smaller label are taken,
    and left open if one of them is open, belongs to another tile, or may stand unlisted in a crowded cell.
    """

    def settle(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("lat")
        label = np.array(tile.column("label").to_pylist(), dtype=object)
        lat, lon = (np.radians(tile.column(c).to_numpy()) for c in ("lat", "lon"))
        home, last = (tile.column(c).to_numpy() for c in ("home", "last"))
        reach = 2 * km / EARTH_RADIUS_KM * 1.001
        state = np.zeros(len(label), np.int8)  # 0 open, 1 centre, 2 taken
        for p in sorted(np.flatnonzero(home).tolist(), key=lambda i: label[i]):
            lo, hi = np.searchsorted(lat, [lat[p] - reach, lat[p] + reach])
            a = np.sin((lat[lo:hi] - lat[p]) / 2) ** 2 + np.cos(lat[p]) * np.cos(lat[lo:hi]) * np.sin((lon[lo:hi] - lon[p]) / 2) ** 2
            d = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, a)))
            before = (label[lo:hi] < label[p]).astype(bool)
            near = before & (d < km)
            if (state[lo:hi][near] == 1).any():
                state[p] = 2
            elif not (state[lo:hi][near] == 0).any() and not (before & last[lo:hi] & (d < 2 * km)).any():
                state[p] = 1
        return tile.select(["label", "lat", "lon"]).filter(pa.array(state == 1))

    return settle


def cluster_centres(places: DataFrame, km: float) -> DataFrame:
    """Centres of the greedy clustering in label order.

    A place is a centre when no earlier centre is closer than ``km``: the
    lexicographically first maximal independent set of the neighbour graph.
    Each round looks at the first few undecided places of every cell, so a dense
    spot costs its size, not its square, and works through tiles of many cells
    one by one. A chain of places that wait for each other is settled as far as
    it runs inside a tile, so that rounds follow the tiles a chain crosses.
    """
    undecided = checkpointed(with_cell(sites(places).drop("n"), km).withColumn("centre", F.lit(False)))
    centres = undecided.where("centre")
    kind = undecided.schema["label"].dataType.simpleString()
    cell = W.partitionBy("band", "cell")
    while not undecided.isEmpty():
        # The rank filter is applied before the shuffle, so a crowded cell sends few rows.
        listed = undecided.withColumn("__r", F.row_number().over(cell.orderBy("label"))).where(F.col("__r") <= LISTED + 1)
        listed = listed.withColumn("__n", F.max("__r").over(cell)).where(F.col("__r") <= LISTED)
        listed = listed.select("label", "lat", "lon", ((F.col("__n") > LISTED) & (F.col("__r") == LISTED)).alias("last"))
        owned = with_cell(listed, km * TILE).withColumnsRenamed({"band": "tband", "cell": "tcell"})
        seen = with_cover(owned, km * TILE).withColumn("home", (F.col("band") == F.col("tband")) & (F.col("cell") == F.col("tcell")))
        settled = seen.groupBy("band", "cell").applyInArrow(_settle(km), f"label {kind}, lat double, lon double")
        settled = checkpointed(with_cell(settled, km))
        taken = range_join(undecided, settled, km).select(F.col("point").alias("label")).distinct()
        left = undecided.join(taken, "label", "left_anti")
        now = checkpointed(left.unionByName(settled.withColumn("centre", F.lit(True))))
        centres = centres.unionByName(now.where("centre"))
        undecided = now.where(~F.col("centre"))
    return centres.select("label", "lat", "lon")


def clusters(places: DataFrame, km: float, centres: DataFrame | None = None) -> DataFrame:
    """(label, rep): every located label joins the earliest centre closer than ``km``."""
    centres = cluster_centres(places, km) if centres is None else centres
    s = sites(places)
    reps = range_join(s, centres, km).groupBy("point").agg(F.min("probe").alias("rep"))
    named = s.join(reps, s["label"] == reps["point"]).select("lat", "lon", "rep")
    return places.join(named, ["lat", "lon"]).select("label", "rep")


def nearest_labels(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """The k nearest pool labels other than the truth: (label, negative, rank, d).

    ``queries(label, lat, lon)`` holds distinct truths, ``pool(label, ord, lat,
    lon)`` may repeat labels (the first counts). Each query searches on the
    finest grid whose own cell already holds more than k labels: its k-th
    neighbour is then nearer than the cell diagonal, so the search is exact.
    """
    unique = pool.groupBy("label").agg(F.min_by(F.struct("ord", "lat", "lon"), "ord").alias("u")).select("label", "u.*")
    same_place = W.partitionBy("lat", "lon").orderBy("ord")
    # No query needs more than k + 1 labels of one site (one may be the truth itself).
    unique = unique.withColumn("__r", F.row_number().over(same_place)).where(F.col("__r") <= k + 1).drop("__r")
    unique = checkpointed(unique)  # read by every grid below
    grids = F.explode(F.sequence(F.lit(0), F.lit(GRIDS - 1))).alias("grid")
    km = F.pow(F.lit(4.0), F.col("grid"))
    placed = with_cell(unique.select("*", grids), km)
    crowded = placed.groupBy("grid", "band", "cell").count().where(F.col("count") > k).drop("count")
    own = with_cell(queries.select("label", "lat", "lon", grids), km).join(crowded, ["grid", "band", "cell"], "left_semi")
    chosen = queries.select("label", "lat", "lon").join(own.groupBy("label").agg(F.min("grid").alias("grid")), "label", "left")
    chosen = checkpointed(chosen)
    spread = with_cover(chosen.where(F.col("grid").isNotNull()), km).select("label", "lat", "lon", "grid", "band", "cell")
    nearby = _ranked(spread, placed, ["grid", "band", "cell"], ["truth"], k)
    # A query whose widest cell holds too few labels searches everywhere: in each of many shares of the pool, then among their best.
    parts = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = unique.withColumn("share", F.pmod(F.xxhash64("label"), F.lit(parts)))
    lost = chosen.where(F.col("grid").isNull()).select("label", "lat", "lon", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("share"))
    best = _ranked(lost, shares, ["share"], ["truth", "share"], k)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("truth").orderBy("d", "ord"))).where(F.col("rank") <= k)
    columns = [F.col("truth").alias("label"), F.col("label").alias("negative"), "rank", "d"]
    return nearby.select(*columns).unionByName(best.select(*columns))


def _ranked(probes: DataFrame, points: DataFrame, on: list[str], keys: list[str], k: int) -> DataFrame:
    """The k nearest points of every probe among those that share the columns of ``on``."""
    named = probes.withColumnsRenamed({"label": "truth", "lat": "tlat", "lon": "tlon"})
    near = named.join(points.select(*on, "label", "ord", "lat", "lon"), on).where(F.col("label") != F.col("truth"))
    near = near.withColumn("d", haversine_km("tlat", "tlon", "lat", "lon"))
    order = W.partitionBy(*keys).orderBy("d", "ord")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(truth: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Candidates per subject: the truth (rank 0) and its k nearest other labels.

    ``truth(subject_id, label, lat, lon)``: the search runs once per distinct
    truth, however many subjects share it.
    """
    distinct = truth.groupBy("label", "lat", "lon").agg(F.lit(1).alias("__one")).drop("__one")
    near = nearest_labels(distinct, pool, k).select(F.col("label").alias("truth"), F.col("negative").alias("label"), "rank", "d")
    subjects = truth.select("subject_id", F.col("label").alias("truth"))
    own = truth.select("subject_id", F.col("label"), F.lit(0).alias("rank"), F.lit(0.0).alias("d"))
    return own.unionByName(subjects.join(near, "truth").select("subject_id", "label", "rank", "d"))


def place_label(fields=PLACE_FIELDS, country: str = "country") -> Column:
    """'Place, Country' from address fields in order of preference."""
    place = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields])
    return F.concat_ws(", ", place, F.nullif(F.col(country), F.lit("")))


def gallery_build(addresses: DataFrame, coordinates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct labels with coordinates, and the labels that have none."""
    labels = addresses.select(place_label().alias("label")).where(F.col("label") != "").distinct()
    joined = labels.join(coordinates.select("label", "lat", "lon"), "label", "left")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return joined.where(located), joined.where(~located).select("label")


@dataclass(frozen=True)
class Geometry:
    """A gallery ready for the pair kernel: labels in order, cluster members and 1/km."""

    labels: tuple[str, ...]
    reps: tuple[str, ...]
    member: np.ndarray  # labels x clusters, 0/1
    inverse_km: np.ndarray  # clusters x clusters, 0 where there is no distance


def build_geometry(gallery: DataFrame, reps: DataFrame | None = None, *, floor_km: float = 0.0) -> Geometry:
    """Collects a gallery (a bounded dimension; its size is checked) into arrays.

    ``gallery(label, ord, lat, lon)``; ``reps(label, rep)`` merges labels first.
    Pairs closer than ``floor_km`` or at the same spot have no distance.
    """
    g = gallery.select("label", "ord", "lat", "lon")
    if reps is not None:
        g = g.join(reps.select("label", "rep"), "label", "left").withColumn("rep", F.coalesce("rep", "label"))
    else:
        g = g.withColumn("rep", F.col("label"))
    rows = g.limit(GALLERY_ROWS + 1).collect()
    if len(rows) > GALLERY_ROWS:
        raise ValueError(f"the pair kernel takes galleries up to {GALLERY_ROWS} labels; larger ones take pair_tiles.mpl_tiled and mpl_sup")
    rows.sort(key=lambda r: r["ord"])
    names = list(dict.fromkeys(r["rep"] for r in rows))
    place = {r["label"]: (r["lat"], r["lon"]) for r in rows}
    member = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        member[i, names.index(r["rep"])] = 1.0
    at = np.array([[np.nan if v is None else v for v in place.get(n, (None, None))] for n in names], dtype=float)
    lat, lon = np.radians(at[:, 0]), np.radians(at[:, 1])
    a = (
        np.sin((lat[:, None] - lat[None, :]) / 2) ** 2
        + np.cos(lat[:, None]) * np.cos(lat[None, :]) * np.sin((lon[:, None] - lon[None, :]) / 2) ** 2
    )
    km = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, a)))
    usable = np.nan_to_num(km, nan=0.0)
    inverse = np.where((usable > 0) & (usable >= floor_km), 1.0 / np.where(usable > 0, usable, 1.0), 0.0)
    return Geometry(tuple(r["label"] for r in rows), tuple(names), member, inverse)


def pairs(gallery: DataFrame, *, floor_km: float = 0.0) -> DataFrame:
    """All candidate pairs i < j of a bounded gallery with their distance."""
    small = broadcast_within(gallery.select("ord", "lat", "lon"), GALLERY_ROWS)
    a = gallery.select(F.col("ord").alias("i"), F.col("lat").alias("ilat"), F.col("lon").alias("ilon"))
    b = small.select(F.col("ord").alias("j"), F.col("lat").alias("jlat"), F.col("lon").alias("jlon"))
    d = haversine_km("ilat", "ilon", "jlat", "jlon")
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", d.alias("d")).where((F.col("d") > 0) & (F.col("d") >= floor_km))


def site_pairs(gallery: DataFrame) -> DataFrame:
    """(n, d): the pairs of distinct sites of a gallery, with how many pairs of labels each stands for. Labels of one site have
    no distance, so that these are all pairs of ``pairs``."""
    sites = gallery.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    side = lambda c: sites.select(F.col("ord").alias(f"{c}ord"), F.col("lat").alias(f"{c}lat"), F.col("lon").alias(f"{c}lon"), F.col("n").alias(f"{c}n"))
    d = haversine_km("ilat", "ilon", "jlat", "jlon")
    both = side("i").join(broadcast_within(side("j"), GALLERY_ROWS), F.col("iord") < F.col("jord"))
    return both.select((F.col("in") * F.col("jn")).alias("n"), d.alias("d")).where(F.col("d") > 0)

"""Geometry, evaluation, skew-safe building blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veilmap.functions.columns import coordinate_key, country_of_label, haversine_km
from veilmap.operators import evaluation as E
from veilmap.operators import geometry as G
from veilmap.operators import scale as S


def km(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def places(spark, pts):
    return spark.createDataFrame([(n, i, float(a), float(o)) for i, (n, (a, o)) in enumerate(pts.items())], "label string, ord int, lat double, lon double")


def greedy(pts, r):
    centres, reps = [], {}
    for n in sorted(pts):
        hit = next((c for c in centres if km(pts[n], pts[c]) < r), None)
        if hit is None:
            centres.append(n)
        reps[n] = hit or n
    return reps


def test_haversine(spark):
    d = spark.range(1).select(haversine_km(F.lit(51.5074), F.lit(-0.1278), F.lit(48.8566), F.lit(2.3522)), haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)), haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()
    assert abs(d[0] - 344) < 5 and d[1] == 0 and abs(d[2] - math.pi * 6371) < 1e-6


def test_known_clusters(spark):
    pts = {"Westminster": (51.50, -0.13), "GreaterLondon": (51.51, -0.12), "Paris": (48.85, 2.35)}
    got = {r["label"]: r["rep"] for r in G.clusters(places(spark, pts), 25.0).collect()}
    assert got == {"Westminster": "GreaterLondon", "GreaterLondon": "GreaterLondon", "Paris": "Paris"}
    far = {"a": (0, 0), "b": (1, 1), "c": (40, 40)}
    assert len({r["rep"] for r in G.clusters(places(spark, far), 25.0).collect()}) == 3


@pytest.mark.parametrize("seed,spread,r", [(1, 0.6, 25.0), (2, 0.1, 25.0), (3, 30.0, 900.0)])
def test_clusters_equal_greedy(spark, seed, spread, r):
    rng = random.Random(seed)
    pts = {}
    for i in range(150):
        base = rng.choice([(0.0, 179.9), (60.0, 10.0), (-89.7, 0.0), (89.9, -120.0)])
        lat = max(-90.0, min(90.0, base[0] + rng.uniform(-spread, spread)))
        lon = (base[1] + rng.uniform(-spread, spread) * (30 if abs(base[0]) > 80 else 1) + 180) % 360 - 180
        pts[f"p{rng.randrange(10**6):06d}-{i}"] = (lat, lon)
    for i, n in enumerate(list(pts)[:30]):  # copies of a third of some spot
        pts[f"copy{i}"] = pts[list(pts)[0]]
    assert {x["label"]: x["rep"] for x in G.clusters(places(spark, pts), r).collect()} == greedy(pts, r)


def test_chain_of_places(spark):
    pts = {f"c{i:02d}": (0.0, i * 0.2) for i in range(12)}  # each 22 km from the next
    assert {x["label"]: x["rep"] for x in G.clusters(places(spark, pts), 25.0).collect()} == greedy(pts, 25.0)


def test_range_join_finds_everything(spark):
    rng = random.Random(9)
    pts = {f"q{i}": (rng.choice([0.0, 45.0, 89.5, -90.0, 90.0, -45.0]) * rng.uniform(0.98, 1.0), rng.choice([180.0, -180.0, 179.99, -179.99, 0.0, rng.uniform(-180, 180)])) for i in range(120)}
    df = places(spark, pts)
    for r in (5.0, 120.0, 3000.0):
        got = {(x["point"], x["probe"]) for x in G.range_join(df, df, r).collect()}
        assert got == {(a, b) for a in pts for b in pts if km(pts[a], pts[b]) < r}


def test_near_sites_counts_copies(spark):
    df = places(spark, {"a": (0, 0), "b": (0, 0), "c": (0, 0), "d": (0, 0.01), "e": (10, 10)})
    got = {(r["i"], r["j"]): r["n_pairs"] for r in G.near_sites(df, 5.0).collect()}
    assert got == {("a", "a"): 3, ("a", "d"): 3}


def test_hard_negatives(spark):
    pool = places(spark, {"Near1": (0.1, 0.1), "Near2": (0.2, 0.0), "Mid": (5, 5), "Far1": (40, 40), "Far2": (-50, 80)})
    pool = pool.unionByName(places(spark, {"Near1": (70, 70), "Truth": (0, 0)}).withColumn("ord", F.col("ord") + 10))
    t = spark.createDataFrame([(1, "Truth", 0.0, 0.0), (2, "Truth", 0.0, 0.0)], "subject_id int, label string, lat double, lon double")
    got = G.hard_negatives(t, pool, 2).collect()
    assert {r["label"] for r in got if r["subject_id"] == 2} == {"Truth", "Near1", "Near2"}
    assert G.hard_negatives(t, pool, 99).where("subject_id = 1").count() == 6


def test_nearest_labels_equal_brute_force(spark):
    rng = random.Random(4)
    pts = {f"n{i:03d}": (50 + rng.uniform(-0.05, 0.05), 8 + rng.uniform(-0.05, 0.05)) if i % 3 == 0 else (rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(200)}
    df = places(spark, pts)
    got = {}
    for r in G.nearest_labels(df.select("label", "lat", "lon"), df, 4).collect():
        got.setdefault(r["label"], []).append((r["rank"], r["negative"]))
    order = {n: i for i, n in enumerate(pts)}
    for n in pts:
        want = sorted((o for o in pts if o != n), key=lambda o: (km(pts[n], pts[o]), order[o]))[:4]
        assert [x for _, x in sorted(got[n])] == want


def test_gallery_build(spark):
    a = spark.createDataFrame([("Rome", None, "Italy"), (None, "Bled", "Slovenia"), ("", None, "Cuba"), ("Rome", "x", "Italy")], "city string, town string, country string")
    for c in ("village", "municipality", "county", "state_district", "state", "region"):
        a = a.withColumn(c, F.lit(None).cast("string"))
    kept, dropped = G.gallery_build(a, spark.createDataFrame([("Rome, Italy", 41.9, 12.5)], "label string, lat double, lon double"))
    assert [r["label"] for r in kept.collect()] == ["Rome, Italy"]
    assert sorted(r["label"] for r in dropped.collect()) == ["Bled, Slovenia", "Cuba"]


def test_label_columns(spark):
    r = spark.createDataFrame([("Washington, D.C., United States", 0.123455)], "l string, d double").select(country_of_label("l"), coordinate_key("d")).first()
    assert r[0] == "United States" and r[1] in (12345, 12346)


def test_threshold_accuracy(spark):
    df = spark.createDataFrame([(0.5,), (30.0,), (100.0,), (900.0,)], "d double")
    r = E.threshold_accuracy(df).first()
    assert [r[f"acc_{t}"] for t in (1, 25, 200, 750, 2500)] == [0.25, 0.25, 0.75, 0.75, 1.0]
    r = E.threshold_accuracy(spark.createDataFrame([(0.5,), (None,), (None,), (900.0,)], "d double")).first()
    assert [r[f"acc_{t}"] for t in (1, 25, 750, 2500)] == [0.25, 0.25, 0.25, 0.5]


def test_topk_recall(spark):
    rows = [(1, 1, "United Kingdom", "United Kingdom"), (2, 1, "France", "United States"), (2, 2, "France", "United States"), (2, 3, "United States", "United States"), (3, 1, "Peru", "Chile")]
    r = E.topk_recall(spark.createDataFrame(rows, "subject_id int, rank int, canonical string, gt string")).first()
    assert [round(r[f"recall_{k}"], 6) for k in (1, 3, 5)] == [0.333333, 0.666667, 0.666667]


@pytest.mark.parametrize("group_rows", [100, 0])
def test_method_table_upper_median(spark, group_rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), ("b", 7.0), ("b", 7.0), ("b", 9.0), ("b", 8.0)], "m string, d double")
    got = {r["m"]: r["median"] for r in E.upper_median(df, ["m"], "d", group_rows=group_rows).collect()}
    assert got == {"a": 4.0, "b": 8.0}


def test_calibration(spark):
    rows = [(1, 0.8, 0.1, 0.8, True), (2, 0.3, 0.9, 0.7, False), (3, 0.5, 0.5, 0.5, True)]
    r = E.calibration(spark.createDataFrame(rows, "subject_id int, p_true double, brier double, conf double, correct boolean")).first()
    assert abs(r["nll"] + (math.log(0.8) + math.log(0.3) + math.log(0.5)) / 3) < 1e-12
    assert abs(r["ece"] - (abs(1 - 0.8) + abs(0 - 0.7) + abs(1 - 0.5)) / 3) < 1e-12
    b = E.reliability(spark.createDataFrame([(1.0, True), (0.8, False), (0.2, True)], "conf double, correct boolean"))
    assert {x["bin"]: (x["n"], x["acc"]) for x in b.collect()} == {4: (2, 0.5), 1: (1, 1.0)}


def test_histogram_has_empty_bins(spark):
    h = E.histogram(spark.createDataFrame([(0.0,), (1.0,), (0.99,), (2.0,)], "x double"), "x", 0.0, 0.25, 4)
    assert [r["n"] for r in h.orderBy("bin").collect()] == [1, 0, 0, 2]


def test_terms_and_risk(spark):
    t = E.terms(spark.createDataFrame([("The Red sign, red door",), ("Café sign",)], "t string"), "t")
    assert [tuple(r) for r in t.collect()][:2] == [("red", 2), ("sign", 2)]
    r = E.worst_risk(spark.createDataFrame([("s", "low"), ("s", "high"), ("s", "medium")], "subject_id string, risk string"))
    assert r.first()["risk"] == "high"


# A third of all rows under one key --------------------------------------------------

def skewed(spark, n=400):
    rng = random.Random(8)
    return spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 7}", i, float(rng.randrange(60))) for i in range(n)], "k string, i int, v double")


def test_chunked_scan_equals_window(spark):
    df = skewed(spark)
    sums = {"s": "v", "n": F.lit(1)}
    a = S.running_sums(df, ["k"], ["i"], sums).select("k", "i", "s", "n")
    b = S.running_sums(df, ["k"], ["i"], sums, group_rows=0).select("k", "i", "s", "n")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    n = S.row_numbers(df, [], ["i"], "rn", group_rows=0)
    assert [r["rn"] for r in n.orderBy("i").collect()] == list(range(1, 401))


@pytest.mark.parametrize("keys", [["k"], []])
def test_chunked_percentiles_are_exact(spark, keys):
    df = skewed(spark)
    qs = {"p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0}
    a = S.percentiles(df, keys, "v", qs)
    b = S.percentiles(df, keys, "v", qs, group_rows=0)
    for x, y in zip(sorted(map(tuple, a.collect())), sorted(map(tuple, b.select(*a.columns).collect()))):
        assert x[: len(keys)] == y[: len(keys)] and all(abs(p - q) < 1e-12 for p, q in zip(x[len(keys):], y[len(keys):]))
    s1 = S.summarise(df, keys, [F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")], {"med": ("v", 0.5), "i9": ("i", 0.9)})
    s2 = S.summarise(df, keys, [F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")], {"med": ("v", 0.5), "i9": ("i", 0.9)}, group_rows=0)
    for x, y in zip(sorted(map(tuple, s1.collect())), sorted(map(tuple, s2.select(*s1.columns).collect()))):
        assert all(abs(p - q) < 1e-9 if isinstance(p, float) else p == q for p, q in zip(x, y))


def test_broadcast_is_checked(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda d: spark.range(9).join(d, "id")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan(S.broadcast_within(spark.range(5), 10))
        assert "BroadcastHashJoin" not in plan(S.broadcast_within(spark.range(50), 10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """1,000 places in four chains, each within the radius of the next, in label order along the chain."""
    pts = {f"p{i:04d}": (-60.0 + (i // 250) * 20.0, -170.0 + (i % 250) * 0.2) for i in range(1000)}
    rounds = []
    real = G.range_join
    monkeypatch.setattr(G, "range_join", lambda *a, **k: rounds.append(1) or real(*a, **k))
    got = {x["label"]: x["rep"] for x in G.clusters(places(spark, pts), 25.0).collect()}
    assert got == greedy(pts, 25.0) and len(rounds) < 60


def test_site_pairs_stand_for_all_pairs(spark):
    rng = random.Random(8)
    spots = [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(6)]
    g = spark.createDataFrame([(i, *rng.choice(spots)) for i in range(40)], "ord long, lat double, lon double")
    want, got = G.pairs(g).toPandas(), G.site_pairs(g).toPandas()
    assert len(got) == 15 and got["n"].sum() == len(want)
    assert abs((got["n"] / got["d"]).sum() - (1 / want["d"]).sum()) < 1e-9

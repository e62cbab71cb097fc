"""Temperature grids in one pass, and distinct counts from stored sketches."""

import math
import random

import pytest

from veilmap.operators import evaluation as E


def loss(p, truth, tau):
    powers = [max(x or 0.0, 1e-12) ** (1 / tau) for x in p]
    own = powers[truth] / sum(powers) if truth is not None and 0 <= truth < len(p) else 1e-12
    return -math.log(max(own, 1e-12))


def test_grid_losses_equal_one_at_a_time(spark):
    rng = random.Random(3)
    taus = [0.3, 1.0, 2.5, 8.0]
    rows = [([rng.random() for _ in range(rng.randrange(1, 6))], rng.choice([0, 0, 1, 9, -2, None])) for _ in range(200)]
    rows += [([], 0), ([], None), ([1.0, 0.0], 1), ([0.0, 0.0, None], 2), ([1.0], 0)]
    df = spark.createDataFrame(rows, "p array<double>, t int").repartition(5)
    got = {r["tau"]: (r["n"], r["nll"]) for r in E.grid_losses(df, taus, truth="t").collect()}
    assert sorted(got) == taus
    for tau in taus:
        assert got[tau][0] == len(rows)
        assert got[tau][1] == pytest.approx(sum(loss(p, t, tau) for p, t in rows) / len(rows), abs=1e-9)


def test_grid_losses_of_nothing(spark):
    assert E.grid_losses(spark.createDataFrame([], "p array<double>, truth int"), [1.0]).count() == 0
    assert E.grid_losses(spark.createDataFrame([(None, 1)], "p array<double>, truth int"), [1.0]).count() == 0


def test_united_sketches_count_common_values_once(spark):
    df = spark.range(60_000).selectExpr("id % 3 AS part", "id DIV 2 AS value")
    parts = E.distinct_sketches(df.unionByName(df), ["part"], "value")
    assert parts.count() == 3
    estimate = E.distinct_estimate(parts).first()[0]
    assert abs(estimate - 30_000) <= 900
    per = {r["part"]: r["estimate"] for r in E.distinct_estimate(parts, ["part"]).collect()}
    assert all(abs(n - 20_000) <= 600 for n in per.values())


def test_sketch_of_nulls_is_empty(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5)], "k int, v bigint")
    got = {r["k"]: r["estimate"] for r in E.distinct_estimate(E.distinct_sketches(df, ["k"], "v"), ["k"]).collect()}
    assert got == {1: 0, 2: 1}

"""Centroid clustering against plain rounds over all vectors, and against SQL."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from veilmap.llm import centroids, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int, dots int"


def brute(rows, dims=64, k=40, rounds=5, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    now = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(now)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                now[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    each = {j: sum(d for d, c in at if c == j) for j in range(len(now))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted([(i, c, d, each[c], sum(each.values()), shas[c]) for (i, _), (d, c) in zip(kept, at)], key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "mine", 7, 1) for i, v in rows], SCHEMA).repartition(5)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(90)]  # ties, and clusters that stay empty
    rows += [rows[7], rows[7], (7, rows[9][1]), (500, None), (501, [1.0, None] * 4), (502, [math.nan] * 8), (503, [-math.inf] * 8), (504, [1.0] * 7), (505, []), (None, rows[1][1]), (None, [0.5] * 8)]
    for options in ({}, {"k": 3, "rounds": 0}, {"k": 12, "rounds": 7, "seed": 5}, {"k": 1000, "rounds": 2}):
        got = centroids.digests(frame(spark, rows), dimensions=8, **options)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 8, options.get("k", 40), options.get("rounds", 5), options.get("seed", 2))


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        assert centroids.digests(frame(spark, rows), dimensions=8).collect() == []


def test_components_keep_to_64_bits_or_fail(spark):
    edge = centroids.LARGEST / 256
    rows = [(i, [edge if (i >> j) & 1 else -edge for j in range(6)] + [0.25 * i, 1e-9]) for i in range(64)]
    got = centroids.digests(frame(spark, rows), dimensions=8, k=5)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 8, 5)
    with pytest.raises(Exception, match="64 bits"):
        centroids.digests(frame(spark, [(1, [2 * edge] * 8)]), dimensions=8).collect()


def test_only_changed_components_are_multiplied():
    old, new = np.zeros((3, 4), np.int64), np.zeros((3, 4), np.int64)
    new[1] = [0, 5, 0, -2]
    [(c, at, by)] = centroids.changes(old, new)
    assert (c, at.tolist(), by.tolist()) == (1, [1, 3], [5, -2])


def test_oracle_and_one_table_left(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op12_centroid_clusters"]).fetchall()
    before = _tables(spark)
    got = sorted(map(tuple, queries.op12_centroid_clusters(spark, SF).collect()))
    assert got == sorted(want) == sorted(brute(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()))
    assert len(_tables(spark) - before) == 1  # the rounds before the last are removed


def _tables(spark):
    from veilmap.session import durable_dir

    base = os.path.join(durable_dir(spark).removeprefix("file:"), "veilmap")
    return {n for n in os.listdir(base) if n.startswith("centroids")} if os.path.isdir(base) else set()

"""The Jaccard join against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilmap.llm import near
from veilmap.llm.components import components, with_least

from .conftest import SCHEMA, awkward_rows


def shingles(text, k=5):
    w = (text or "").lower().encode().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [shingles(r[1]) for r in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    ids = {k: min((v for v in vs if v is not None), default=None) for k, vs in least.items()}
    return [(rows[i][0], ids[root(i)], links[i]) for i in range(len(rows))]


def edited_rows():
    """Groups of near copies on both sides of the threshold."""
    rng = np.random.default_rng(8)
    rows = awkward_rows()
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for c in range(12):
            words = list(base)
            for at in rng.choice(60, rng.integers(0, 4), replace=False):
                words[at] = f"new{rng.integers(1000)}"
            rows.append((1000 + 50 * g + c, " ".join(words), "en", "s1", 0, "", 0, 0.0))
    return rows


@pytest.mark.parametrize("options", [{}, {"block_nodes": 4, "block_bytes": 900}])
def test_classes_and_links(spark, options):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = near.near_classes(docs, **options).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute(rows))


def test_one_of_each(awkward):
    docs, rows = awkward
    got = near.one_of_each(docs)
    assert got.columns == docs.columns
    wanted = Counter(r[0] for r in rows if not (r[1] or "").split())
    classes = {c for i, c, _ in brute([r for r in rows if (r[1] or "").split()])}
    wanted.update(classes)
    # A repeated id with two texts may stand for both.
    assert set(r.doc_id for r in got.collect()) == set(wanted)
    texts = [shingles(r.text) for r in got.collect() if (r.text or "").split()]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(texts) for b in texts[:i])
    assert near.one_of_each(docs.limit(0)).count() == near.near_classes(docs.limit(0)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    rng = np.random.default_rng(2)
    least = near.least_agreements(0.8, near.TOLERANCE)
    x = rng.integers(0, 256, near.BANDS * near.ROWS).astype(np.uint8)
    close = np.where(rng.random((400, len(x))) < 0.8, x, rng.integers(0, 256, (400, len(x)))).astype(np.uint8)
    far = np.where(rng.random((400, len(x))) < 0.3, x, rng.integers(0, 256, (400, len(x)))).astype(np.uint8)
    assert len(near.survivors(x, close, least)) == 400 and len(near.survivors(x, far, least)) == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000, 5000), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(40)} == {1000}
    assert got[2001] == got[2000] == 2000 and 5000 not in got


def test_components_with_busy_centres(spark):
    rng = random.Random(6)
    edges = [(5, 10_000 + i) for i in range(400)] + [(20_000 + i, 20_001 + i) for i in range(37)] + [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    edges += edges[:50] + [(7, 7), (None, 3), (9_999_999, 10_003)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for busy in (3, 500):
        assert {r.node: r.root for r in components(df, busy=busy).collect()} == {x: find(x) for x in root}
    assert components(df.limit(0)).count() == 0
    least = df.groupBy("a").agg({"b": "min", "*": "count"}).toDF("a", "m", "n")
    plan = with_least(df, least, 3)._jdf.queryExecution().executedPlan().toString()
    assert "salt" in next(line for line in plan.splitlines() if "MergeJoin" in line or "ShuffledHashJoin" in line or "[a#" in line and "Join" in line and "salt" in line)

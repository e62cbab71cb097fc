"""Mixing budgets and threshold-scaled fingerprints."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from veilmap.llm import fingerprints, mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = share * total - sum(most * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level >= most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else weight[s] * level for s in names}
        capped.update(over)


def test_targets_and_taken_words(awkward):
    docs, rows = awkward
    for level_bits in (3, 12):
        got = mixing.mix(docs, level_bits=level_bits).collect()
        assert len(got) == len(rows)
        sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in rows:
            sizes[r[3]] += len((r[1] or "").encode().split())
            biggest[r[3]] = max(biggest[r[3]], len((r[1] or "").encode().split()))
        want = water(sizes)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
            assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
            taken[r.source] += r.taken
        # Within half of the document at the boundary (repeated rows move together).
        assert all(abs(taken[s] - want[s]) <= 3 * biggest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(docs.repartition(5), level_bits=3).collect()
    key = lambda r: (r.id is None, r.id or 0, r.size, str(r.source), r.taken)
    assert sorted(map(key, again)) == sorted(map(key, mixing.mix(docs).collect()))


def test_budgets_are_nested(awkward):
    docs, _ = awkward
    small = {r.id: r.copies for r in mixing.mix(docs, share=0.4, weights=(1,)).collect()}
    large = {r.id: r.copies for r in mixing.mix(docs, share=0.9, weights=(1,)).collect()}
    assert all(large[i] >= c for i, c in small.items())


def test_rows_as_mixed(awkward):
    docs, rows = awkward
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    words = sum(len((r.text or "").encode().split()) for r in got.collect())
    assert words == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert got.where("text is null").count() == sum(r[1] is None for r in rows)
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0


def expected_edits(rows):
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r[1] or "")
    ids = sorted(by_id, key=lambda i: (i is None, i or 0))
    return by_id, {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}


def test_fingerprints_of_edited_texts(awkward):
    docs, rows = awkward
    got = fingerprints.with_edits(docs, fraction=1.0).collect()
    assert len(got) == len(rows)
    by_id, after = expected_edits(rows)
    prints = {}

    def near(a, b):
        def sh(t):
            w = t.lower().encode().split()
            return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

        a, b = sh(a), sh(b)
        return len(a & b) / len(a | b) if a | b else 0.0

    for r in got:
        hits = 0
        for t in by_id[r.id]:
            for nxt in by_id[after[r.id]]:
                half = len(t) // 2
                edited = t[: len(t) - half] + nxt[:half]
                same = len(t) == r.n_chars and hashlib.sha256(edited.encode()).hexdigest() == r.edited_sha256
                hits += same and abs(r.near_edited - (1.0 if t == edited else near(t, edited))) < 1e-9 and abs(r.near_next - (1.0 if t == nxt else near(t, nxt))) < 1e-9
                if same:
                    assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert hits, r
    assert fingerprints.with_edits(docs.limit(0)).count() == 0


def test_short_texts_keep_their_hashes_and_likeness(spark):
    rng = random.Random(7)
    texts = []
    for n in [*range(1, 16), *range(20, 60, 8), 120, 400, 900]:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(words), " ".join(words[:-1] + ["other"])]  # the next document is a near copy
    rows = list(enumerate(texts))
    got = {r.id: r for r in fingerprints.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def sh(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    for i, t in rows:
        nxt = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.fingerprint and r.edited_fingerprint
        for near, other in ((r.near_edited, edited), (r.near_next, nxt)):
            a, b = sh(t), sh(other)
            assert abs(near - len(a & b) / len(a | b)) < (1e-9 if max(len(a), len(b)) <= 256 else 0.1), (i, near)


def test_a_table_of_one_document(spark):
    r = fingerprints.with_edits(spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")).first()
    assert r.n_chars == 15 and r.edited_sha256 == hashlib.sha256(b"a b c d a b c d"[:8] + b"a b c d").hexdigest() and r.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    part = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(1, "x", long), (1, "y", part), (2, "y", part)], "g int, n string, t string")
    df = df.select("g", "n", fingerprints.sketch(F.col("t")).alias("s"))
    one = fingerprints.merged(df, ["g"], "s").where("g = 1").first().s
    rows = {(r.g, r.n): r.s for r in df.collect()}
    assert one == rows[1, "x"] and set(rows[2, "y"]) <= set(one)
    both = df.where("g = 1 and n = 'x'").select(F.col("s").alias("a")).crossJoin(df.where("g = 2").select(F.col("s").alias("b")))
    r = both.select(fingerprints.containment(F.col("b"), F.col("a")).alias("c"), fingerprints.resemblance(F.col("a"), F.col("b")).alias("j")).first()
    assert r.c == 1.0 and 0.05 < r.j < 0.16

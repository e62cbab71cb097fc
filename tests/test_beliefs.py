"""Facts about belief construction, updating and naming."""

import math

import pytest
from pyspark.sql import functions as F

from veilmap.functions.columns import p_yes, rating, support_weight
from veilmap.operators import beliefs as B
from veilmap.operators import updating as U


def raw(spark, rows):
    return spark.createDataFrame([(s, l, i, float(v) if v is not None else None) for i, (s, l, v) in enumerate(rows)], "subject_id string, label string, ord int, raw double")


def dist(df, subject=None):
    rows = df.collect()
    return {r["label"]: r["p"] for r in rows if subject is None or r["subject_id"] == subject}


def test_prior_truncates_and_caps(spark):
    d = dist(B.prior(raw(spark, [("s", "A", 0.8), ("s", "B", 0.9), ("s", "C", 1.0)])))
    assert all(abs(p - 1 / 3) < 1e-12 for p in d.values())
    d = dist(B.prior(raw(spark, [("s", "A", 0.6), ("s", "B", 0.2)])))
    assert abs(d["A"] / d["B"] - math.exp(0.4 / 1.5)) < 1e-12
    d = dist(B.prior(raw(spark, [("s", str(i), v) for i, v in enumerate([1.0, 0, 0.5, 0.31, 0.77])])))
    assert max(d.values()) / min(d.values()) <= math.exp(0.4) + 1e-12 and abs(sum(d.values()) - 1) < 1e-12


def test_prior_clamps(spark):
    d = dist(B.prior(raw(spark, [("s", "A", -0.5), ("s", "B", 0.0), ("s", "C", float("nan"))])))
    assert abs(d["A"] - d["B"]) < 1e-15 and abs(d["C"] - d["B"]) < 1e-15
    d = dist(B.prior(raw(spark, [("s", "A", 1.7), ("s", "B", 1.0)]), tau_p=2.0))
    assert abs(d["A"] - d["B"]) < 1e-15


def test_score_normalise(spark):
    rows = [("a", "Paris", 0.8), ("a", "Lyon", 0.2), ("a", "Rome", 0.0), ("z", "A", 0.0), ("z", "B", 0.0), ("m", "A", 0.9), ("m", "B", None)]
    out = B.score_normalise(raw(spark, rows))
    a, z, m = dist(out, "a"), dist(out, "z"), dist(out, "m")
    assert abs(a["Paris"] - 0.8) < 0.03 and min(a.values()) > 0
    assert z == {"A": 0.5, "B": 0.5}
    assert 0 < m["B"] < m["A"]


def test_support_weight(spark):
    rows = [("3", "1"), ("5", "0"), ("5", "1"), ("1", "1"), ("9", "1.7"), ("0", "1"), ("4.4", "0.5"), ("4", "0.5"), ("2.5", "1"), ("3.5", "1"), ("x", "1")]
    df = spark.createDataFrame(rows, "c string, alpha string").select(rating("c").alias("r"), support_weight("c", "alpha").alias("w"))
    got = [(r["r"], r["w"]) for r in df.collect()]
    want = [(3, 1), (5, 1), (5, 4), (1, 0.25), (5, 4), (1, 0.25), (4, 2**0.5), (4, 2**0.5), (2, 0.5), (4, 2)]
    for (r, w), (er, ew) in zip(got, want):
        assert r == er and abs(w - ew) < 1e-12
    assert got[-1] == (None, None)


def test_p_yes(spark):
    rows = [(None, None), (-1.0, None), (None, -1.0), (-1.0, -2.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "y double, n double").select(p_yes("y", "n")).collect()]
    want = [0.5, math.exp(-1), 1 - math.exp(-1), math.exp(-1) / (math.exp(-1) + math.exp(-2))]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


CHAIN = {
    "country": ({"UK": 0.387, "US": 0.317, "SE": 0.296}, [(1.87, 0.54, 0.56), (0.55, 3.48, 0.55), (0.57, 1.86, 0.29)], [(0.682, 0.161, 0.156), (0.367, 0.549, 0.084), (0.167, 0.813, 0.019)]),
    "city": ({"SF": 0.574, "LA": 0.425}, [(1.74, 0.56)], [(0.809, 0.191)]),
    "street": ({"Franklin": 0.517, "Hayes": 0.483}, [(1.62, 0.66)], [(0.724, 0.276)]),
}


@pytest.mark.parametrize("group_rows", [1000, 0])
def test_golden_chain(spark, group_rows):
    """Weights of the published chain as ratings: c = 5 or 1 with alpha = |log2 W| / 2."""
    priors, rows = [], []
    for level, (prior, steps, _) in CHAIN.items():
        for o, (l, p) in enumerate(prior.items()):
            priors.append(("s", level, l, o, p / sum(prior.values())))
            for i, ws in enumerate(steps):
                bits = math.log2(ws[o])
                rows.append(("s", level, i + 1, l, o, 5.0 if bits > 0 else 1.0, abs(bits) / 2))
    p = spark.createDataFrame(priors, "subject_id string, level string, label string, ord int, p double")
    r = spark.createDataFrame(rows, "subject_id string, level string, step int, label string, ord int, c double, alpha double")
    got = {(x["level"], x["step"], x["label"]): x for x in U.sequential_posterior(p, r, group_rows=group_rows).collect()}
    assert all(x["valid"] for x in got.values())
    for level, (prior, _, want) in CHAIN.items():
        for i, ps in enumerate(want):
            for l, e in zip(prior, ps):
                assert abs(got[(level, i + 1, l)]["p"] - e) < 2e-3


def test_scan_equals_step_by_step(spark):
    labels = ["a", "b", "c"]
    priors = [(s, "country", l, o, [0.5, 0.3, 0.2][o]) for s in range(3) for o, l in enumerate(labels)]
    rows = [(s, "country", t, l, o, float((s + t * 3 + o * 5) % 5 + 1), ((t + o) % 11) / 10) for s in range(3) for t in range(1, 40 if s == 0 else 4) for o, l in enumerate(labels)]
    p = spark.createDataFrame(priors, "subject_id int, level string, label string, ord int, p double")
    r = spark.createDataFrame(rows, "subject_id int, level string, step int, label string, ord int, c double, alpha double")
    got = {(x["subject_id"], x["step"], x["label"]): (x["p"], x["delta_p"]) for x in U.sequential_posterior(p, r, group_rows=0).collect()}
    for s in range(3):
        now = [0.5, 0.3, 0.2]
        for t in range(1, 40 if s == 0 else 4):
            w = [2 ** (((t + o) % 11) / 10 * ((s + t * 3 + o * 5) % 5 + 1 - 3)) for o in range(3)]
            z = sum(a * b for a, b in zip(now, w))
            new = [a * b / z for a, b in zip(now, w)]
            delta = max(abs(a - b) for a, b in zip(now, new))
            now = new
            for o, l in enumerate(labels):
                assert abs(got[(s, t, l)][0] - now[o]) < 1e-9 and abs(got[(s, t, l)][1] - delta) < 1e-9


def test_missing_label_is_not_valid(spark):
    p = spark.createDataFrame([("s", "country", "a", 0, 0.5), ("s", "country", "b", 1, 0.5)], "subject_id string, level string, label string, ord int, p double")
    r = spark.createDataFrame([("s", "country", 1, "a", 0, 5.0, 1.0)], "subject_id string, level string, step int, label string, ord int, c double, alpha double")
    assert [x["valid"] for x in U.sequential_posterior(p, r).collect()] == [False]


def test_steps_that_do_not_rate_their_prior(spark):
    p = spark.createDataFrame([(s, "country", l, o, m) for s in "uzrdk" for o, (l, m) in enumerate([("a", 0.5), ("b", 0.5), ("none", 0.0)])], "subject_id string, level string, label string, ord int, p double")
    good = [("a", 0, "5", 1.0), ("b", 1, "1", 1.0), ("none", 2, "5", 1.0)]
    bad = {"u": [*good, ("Z", 3, "5", 1.0)], "z": good[:2], "r": [good[0], ("b", 1, "x", 1.0), good[2]], "d": [*good, good[0]], "k": good}
    rows = [(s, "country", t, *r) for s, rs in bad.items() for t in (1, 2) for r in (rs if t == 1 else good)]
    r = spark.createDataFrame(rows, "subject_id string, level string, step int, label string, ord int, c string, alpha double")
    got = {(x["subject_id"], x["step"], x["label"]): x for x in U.sequential_posterior(p, r).collect()}
    assert all(x["valid"] == (s == "k" or t == 2) and (x["p"] is None) == (not x["valid"]) for (s, t, _), x in got.items())
    assert abs(got[("k", 1, "a")]["p"] - 16 / 17) < 1e-12 and got[("k", 1, "none")]["p"] == 0
    # An unknown label never gains mass; an unreadable rating moves nothing.
    assert abs(got[("u", 2, "a")]["p"] - 256 / 257) < 1e-12 and abs(got[("r", 2, "a")]["p"] - 64 / 65) < 1e-12
    kept, rejected = U.split_ratings(r)
    assert rejected.count() == 1 and kept.count() == len(rows) - 1


def test_bayes_step_errors(spark):
    b = spark.createDataFrame([("ok", "a", 0, 0.5), ("ok", "b", 1, 0.5), ("bad", "a", 0, 1.0), ("zero", "a", 0, 1.0)], "subject_id string, label string, ord int, p double")
    w = spark.createDataFrame([("ok", "a", 4.0), ("ok", "b", 1.0), ("bad", "x", 1.0), ("zero", "a", 0.0)], "subject_id string, label string, w double")
    got = {(r["subject_id"], r["label"]): (r["p"], r["error"]) for r in U.bayes_step(b, w).collect()}
    assert abs(got[("ok", "a")][0] - 0.8) < 1e-12 and got[("ok", "a")][1] is None
    assert got[("bad", "a")] == (None, "support mismatch") and got[("zero", "a")] == (None, "zero mass")


def test_stall_uses_the_largest_change(spark):
    p = spark.createDataFrame([("s", "coast", x, o, w) for o, (x, w) in enumerate([("north", 0.45), ("south", 0.35), ("east", 0.2)])], "subject_id string, level string, label string, ord int, p double")
    rows = [("s", "coast", 1, "north", 0, 4.0, 0.11), ("s", "coast", 1, "south", 1, 2.0, 0.13), ("s", "coast", 1, "east", 2, 3.0, 0.0)]
    r = spark.createDataFrame(rows, "subject_id string, level string, step int, label string, ord int, c double, alpha double")
    t = U.sequential_posterior(p.select("subject_id", "level", "label", "ord", "p"), r)
    assert t.first()["delta_p"] < 0.05
    assert [e["type"] for e in U.belief_events(U.step_facts(t)).collect()] == ["enhance_flag"]


def test_events_backtrack_and_threshold(spark):
    p = spark.createDataFrame([("s", "city", l, o, 0.5) for o, l in enumerate("ab")], "subject_id string, level string, label string, ord int, p double")
    rows = [("s", "city", 1, "a", 0, 5.0, 1.0), ("s", "city", 1, "b", 1, 1.0, 1.0), ("s", "city", 2, "a", 0, 2.0, 0.1), ("s", "city", 2, "b", 1, 1.0, 0.1)]
    r = spark.createDataFrame(rows, "subject_id string, level string, step int, label string, ord int, c double, alpha double")
    facts = U.step_facts(U.sequential_posterior(p, r))
    got = sorted((e["step"], e["type"]) for e in U.belief_events(facts).collect())
    assert got == [(1, "key_evidence"), (1, "threshold_crossed"), (2, "backtrack")]
    ready = U.level_readiness(facts).first()
    assert ready["reason"] == "confident" and ready["next_level"] == "street"


def beliefs(spark, rows):
    return spark.createDataFrame([(s, m, l, o, p) for s, m, l, o, p in rows], "subject_id string, mask bigint, label string, ord int, p double")


def test_divergences(spark):
    u = beliefs(spark, [("s", 0, l, i, 0.25) for i, l in enumerate("abcd")])
    assert abs(B.entropy_bits(u).first()["entropy_bits"] - 2) < 1e-12
    p = beliefs(spark, [("s", 0, "a", 0, 0.75), ("s", 0, "b", 1, 0.25), ("t", 0, "a", 0, 1.0)])
    q = beliefs(spark, [("s", 0, "a", 0, 0.5), ("s", 0, "b", 1, 0.5), ("t", 0, "b", 0, 1.0)])
    got = {r["subject_id"]: r for r in B.kl_bits(p, q).collect()}
    assert abs(got["s"]["kl_bits"] - (0.75 * math.log2(1.5) + 0.25 * math.log2(0.5))) < 1e-12 and abs(got["s"]["tv"] - 0.25) < 1e-12
    assert got["t"]["kl_bits"] is None and not got["t"]["same_support"]


def test_merge_and_map(spark):
    b = beliefs(spark, [("s", 0, "Westminster", 0, 0.3), ("s", 0, "Greater London", 1, 0.2), ("s", 0, "Paris", 2, 0.5)])
    c = spark.createDataFrame([("Westminster", "Greater London"), ("Greater London", "Greater London")], "label string, rep string")
    got = {r["label"]: r["p"] for r in B.merge(b, c).collect()}
    assert got == {"Greater London": 0.5, "Paris": 0.5}
    assert B.map_estimate(B.merge(b, c)).first()["label"] == "Greater London"  # first in gallery order on a tie


def test_power_rescale_undoes_unsmooth(spark):
    b = B.score_normalise(raw(spark, [("s", "A", 0.6), ("s", "B", 0.3), ("s", "C", 0.1)]))
    again = B.power_rescale(B.unsmooth(b, keys=("subject_id",)).withColumn("beta", F.lit(1.0)), keys=("subject_id",))
    one, two = dist(b), dist(again)
    assert all(abs(one[k] - two[k]) < 1e-12 for k in one)


def test_letters(spark):
    o = spark.createDataFrame([("s", 0, L, l, i) for i, (L, l) in enumerate(zip("AB", "xy"))] + [("n", 0, L, l, i) for i, (L, l) in enumerate(zip("AB", "xy"))], "subject_id string, perm int, letter string, label string, ord int")
    v = spark.createDataFrame([("s", 0, "A", -1.0)], "subject_id string, perm int, letter string, logprob double")
    got = {(r["subject_id"], r["label"]): r["p"] for r in B.letter_belief(v, o).collect()}
    assert abs(got[("s", "y")] / got[("s", "x")] - math.exp(-5)) < 1e-9
    assert abs(got[("n", "x")] - 0.5) < 1e-12


def test_names(spark):
    names = ["UK", "Scotland", "England", "USA", "Türkiye", "  France ", "Atlantis", "people's  republic of   china"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["canonical"] for r in B.canonical_country(df, "name").collect()}
    assert [got[n] for n in names] == ["United Kingdom"] * 3 + ["United States", "Turkey", "France", "Atlantis", "China"]


def test_clean_candidates(spark):
    rows = [("s", "country", 0, "USA", "0.5", "first"), ("s", "country", 1, "United States", "0.7", "second"), ("s", "country", 2, "UK", "0.6", None), ("s", "country", 3, "  ", "1", None), ("t", "city", 0, "USA", "lots", None)]
    df = spark.createDataFrame(rows, "subject_id string, level string, ord int, location string, confidence string, reason string")
    got = [(r["subject_id"], r["location"], r["confidence"], r["reason"]) for r in B.clean_candidates(df).orderBy("subject_id", "ord").collect()]
    assert got == [("s", "United States", 0.7, "first"), ("s", "United Kingdom", 0.6, None), ("t", "USA", 0.0, None)]


def test_hierarchical_name(spark):
    rows = [("a", "country", "United States", 0, 0.9), ("a", "country", "Canada", 1, 0.1), ("a", "city", "San Francisco", 0, 1.0), ("a", "street", "Franklin Street", 0, 1.0), ("b", "country", "France", 0, 1.0)]
    lv = spark.createDataFrame(rows, "subject_id string, level string, label string, ord int, p double")
    st = spark.createDataFrame([("b", "Italy", None, "")], "subject_id string, country string, city string, street string")
    fi = spark.createDataFrame([("c", "Peru", 0, 1.0)], "subject_id string, label string, ord int, p double")
    got = {r["subject_id"]: r["name"] for r in B.hierarchical_name(lv, st, fi).collect()}
    assert got == {"a": "Franklin Street, San Francisco, United States", "b": "Italy", "c": "Peru"}


def test_repair(spark):
    h = spark.createDataFrame([("s", 1, l, o) for o, l in enumerate("abc")], "subject_id string, step int, label string, ord int")
    r = spark.createDataFrame([("s", 1, "a", 5.0, 1.0, 1), ("s", 1, "a", 4.0, 0.5, 2), ("s", 1, "b", 2.0, 0.3, 1), ("s", 1, "z", 1.0, 1.0, 1)], "subject_id string, step int, label string, c double, alpha double, attempt int")
    got = {x["label"]: (x["c"], x["alpha"], x["fallback"], x["extra"]) for x in U.repair_ratings(h, r).collect()}
    assert got == {"a": (4.0, 0.5, False, False), "b": (2.0, 0.3, False, False), "c": (3.0, 0.0, True, False), "z": (None, None, False, True)}


def test_short_runs_are_dealt_to_more_tasks_as_the_ratings_grow(spark):
    prior = spark.createDataFrame([(1, "country", "a", 0, 0.5), (1, "country", "b", 1, 0.5)], "subject_id long, level string, label string, ord int, p double")
    rated = spark.createDataFrame([(1, "country", 1, "a", 0, 5.0, 0.5), (1, "country", 1, "b", 1, 2.0, 0.5)], "subject_id long, level string, step long, label string, ord int, c double, alpha double")
    out = U.sequential_posterior(prior, rated, at_most=10, about=25_000_000)
    assert ", 100), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    plain = U.sequential_posterior(prior, rated)
    assert sorted(map(tuple, out.select("label", "p").collect())) == sorted(map(tuple, plain.select("label", "p").collect()))


def test_letters_meet_as_in_a_join(spark):
    """Letters returned twice, without a value, without a key, or never offered."""
    options = [(1, 0, 0, "a", 0), (1, 0, 1, "b", 1), (1, 1, 0, "b", 1), (1, 1, 1, "a", 0), (1, 1, 1, "c", 2), (2, 0, 0, "a", 0), (2, 0, None, "b", 1), (None, 0, 0, "a", 0)]
    visible = [(1, 0, 0, -1.0), (1, 0, 0, -2.0), (1, 0, 1, None), (1, 1, 1, -0.5), (1, 1, 9, -0.1), (2, 0, None, -0.1), (None, 0, 0, -0.2)]
    o = spark.createDataFrame(options, "subject_id int, perm int, letter int, label string, ord int")
    v = spark.createDataFrame(visible, "subject_id int, perm int, letter int, logprob double")
    soft = {}
    for key in {(s, p) for s, p, *_ in options}:
        rows = [(x[3], next_v) for x in options if x[:2] == key for next_v in ([y[3] for y in visible if None not in x[:3] and y[:3] == x[:3]] or [None])]
        floor = min([lp for _, lp in rows if lp is not None], default=-15.0) - 5.0
        e = [(label, math.exp(floor if lp is None else lp)) for label, lp in rows]
        for label, x in e:
            soft.setdefault(key[0], {}).setdefault(label, []).append(x / sum(y for _, y in e))
    want = {(s, label): sum(p) / len(p) / sum(sum(q) / len(q) for q in own.values()) for s, own in soft.items() for label, p in own.items()}
    got = {(r.subject_id, r.label): r.p for r in B.letter_belief(v, o).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_letters_are_shuffled_once(spark):
    """The orders are, before they become ten rows each."""
    import __spark_entry__ as E

    plan = E.queries()["mc_letter_belief"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "REPARTITION_BY_NUM" in plan

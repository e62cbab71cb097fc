"""Run-length masks, intervals, placements and cue rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmap.operators import cues as Q
from veilmap.operators import masks as M

W, H = 8, 6


def counts(mask):
    """Lengths between the places where the value changes, the first of them of zeros."""
    flat = np.r_[False, np.asarray(mask, bool).ravel()]
    turns = np.flatnonzero(np.diff(flat))
    return np.diff(np.r_[0, turns, len(flat) - 1]).tolist()


def box(y1, y2, x1, x2, h=H, w=W):
    m = np.zeros((h, w), bool)
    m[y1:y2, x1:x2] = True
    return m


def table(spark, masks):
    rows = [(s, c, i, H, W, counts(m)) for (s, c, i), m in masks.items()]
    return spark.createDataFrame(rows, "subject_id int, cue_idx int, inst_idx int, h int, w int, counts array<int>")


def test_round_trip(spark):
    rng = np.random.default_rng(2)
    masks = {(0, 0, 0): box(2, 4, 3, 6), (0, 0, 1): np.zeros((H, W), bool), (0, 0, 2): np.ones((H, W), bool)}
    masks |= {(1, 0, i): rng.random((H, W)) > 0.5 for i in range(5)}
    t = table(spark, masks)
    back = {(r["subject_id"], r["cue_idx"], r["inst_idx"]): list(r["counts"]) for r in M.encode(M.decode(t), frames=t).collect()}
    assert back == {k: counts(m) for k, m in masks.items()}


def test_union_coverage_overlap(spark):
    rng = np.random.default_rng(3)
    masks = {(s, c, i): rng.random((H, W)) > 0.6 for s in range(3) for c in range(2) for i in range(3)}
    rows = M.split_rows(M.decode(table(spark, masks)))
    cov = {r["subject_id"]: r["cov"] for r in M.coverage(rows, W, H, keys=("subject_id",)).collect()}
    cue = M.words(rows)
    runs = {(r["subject_id"], r["cue_idx"]): r["n"] for r in M.union_rows(rows).groupBy("subject_id", "cue_idx").agg(F.sum(F.col("x2") - F.col("x1")).alias("n")).collect()}
    shared = {(r["subject_id"], r["cue_idx"]): r["overlap"] for r in M.overlap(cue, M.words(rows.where("cue_idx = 1"), keys=("subject_id",))).collect()}
    linear = {r["subject_id"]: r["n"] for r in M.union(M.decode(table(spark, masks)), keys=["subject_id"]).groupBy("subject_id").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    for s in range(3):
        u = {c: np.logical_or.reduce([masks[(s, c, i)] for i in range(3)]) for c in range(2)}
        assert abs(cov[s] - (u[0] | u[1]).mean()) < 1e-12 and linear[s] == (u[0] | u[1]).sum()
        for c in range(2):
            assert runs[(s, c)] == u[c].sum()
            assert shared.get((s, c), 0) == (u[c] & u[1]).sum()


def test_words_of_wide_frames(spark):
    rows = spark.createDataFrame([("s", 0, 60, 200), ("s", 0, 190, 256), ("s", 1, 0, 64), ("s", 2, 63, 65)], "subject_id string, y int, x1 int, x2 int")
    got = {(r["y"], r["word"]): bin(r["bits"] & (2**64 - 1)).count("1") for r in M.words(rows, keys=["subject_id"]).collect()}
    assert got == {(0, 0): 4, (0, 1): 64, (0, 2): 64, (0, 3): 64, (1, 0): 64, (2, 0): 1, (2, 1): 1}


def test_translate_clips(spark):
    rows = M.split_rows(M.decode(table(spark, {(0, 0, 0): box(2, 4, 3, 6)})))
    moved = M.translate(rows, F.lit(4), F.lit(3), W, H).collect()
    assert sorted((r["y"], r["x1"], r["x2"]) for r in moved) == [(5, 7, 8)]
    assert M.translate(rows, F.lit(-9), F.lit(0), W, H).count() == 0


@pytest.mark.parametrize("w,h", [(20, 15), (150, 9)])
def test_placement_is_the_least_overlap(spark, w, h):
    n, tries = 3, 40
    rng = random.Random(6)
    cues = {}
    for s in range(4):
        for c in range(3):
            y, x = rng.randrange(h - 6), rng.randrange(w - 8)
            cues[(s, c)] = box(y, y + rng.randrange(1, 6), x, x + rng.randrange(1, 8), h, w)
    cues[(9, 0)] = box(0, 4, 0, w, h, w)  # as wide as the frame: it can only move down
    rows = [(s, c, int(y), int(np.flatnonzero(m[y])[0]), int(np.flatnonzero(m[y])[-1]) + 1) for (s, c), m in cues.items() for y in np.flatnonzero(m.any(axis=1))]
    df = spark.createDataFrame(rows, "subject_id int, cue_idx int, y int, x1 int, x2 int")
    got = M.place_controls(df, w, h, n, key=F.col("subject_id").cast("bigint") * 31 + F.col("cue_idx") * 17).collect()
    assert len(got) == n * len(cues)
    for r in got:
        m = cues[(r["subject_id"], r["cue_idx"])]
        everything = np.logical_or.reduce([v for (s, _), v in cues.items() if s == r["subject_id"]])
        ys, xs = np.nonzero(m)
        best = None
        for t in range(tries):
            k = r["subject_id"] * 31 + r["cue_idx"] * 17 + r["placement"] * 101 + t * 7919
            fx, fy = w - 1 - (xs.max() - xs.min()), h - 1 - (ys.max() - ys.min())
            dx = k % fx - xs.min() if fx > 0 else 0
            dy = (k // 61) % fy - ys.min() if fy > 0 else 0
            o = int(everything[ys + dy, xs + dx].sum())
            if best is None or o < best[0]:
                best = (o, dx, dy)
            if o == 0:
                break
        assert (r["overlap"], r["dx"], r["dy"]) == best and r["area"] == m.sum()


def annotations(spark, rows):
    schema = "subject_id int, pos int, w int, h int, maskable boolean, instances array<struct<bbox array<double>, mask string>>"
    return spark.createDataFrame(rows, schema)


def test_degenerate_and_maskable(spark):
    big, small = ([0.0, 0.0, 100.0, 90.0], "m"), ([0.0, 0.0, 30.0, 20.0], "m")
    edge = ([0.0, 0.0, 80.0, 50.0], "m")  # exactly 40 %
    df = annotations(spark, [(1, 0, 100, 100, True, [big]), (1, 1, 100, 100, False, [big, small]), (1, 2, 100, 100, True, []), (1, 3, 100, 100, True, [edge]), (1, 4, 100, 100, True, [([0.0, 0.0, 1.0, 1.0], None)])])
    out = Q.localization_outcome(Q.assign_maskable(Q.flag_degenerate(df)))
    got = {r["pos"]: (r["degenerate"], r["maskable"], r["maskable_llm"], r["outcome"], r["n_mask"]) for r in out.collect()}
    assert got[0] == (True, False, True, "Degenerate", 0)
    assert got[1] == (False, True, False, "Localized", 1)
    assert got[2] == (False, False, True, "Not localized", 0)
    assert got[3][:2] == (False, True)
    for limit in (100, 0):
        kept = Q.maskable_cues(out, ["pos"], group_rows=limit).collect()
        assert sorted((r["pos"], r["cue_idx"]) for r in kept) == [(1, 0), (3, 1)]


def test_frames_per_image(spark):
    """Subjects with frames of their own size: the same as each size by itself."""
    rng = np.random.default_rng(9)
    runs, sizes = [], {0: (40, 30), 1: (70, 20), 2: (40, 30), 3: (25, 60)}
    for s, (w, h) in sizes.items():
        for c in range(3):
            y, x = int(rng.integers(0, h - 5)), int(rng.integers(0, w - 8))
            runs += [(s, c, y + i, x, x + 6, w, h) for i in range(4)]
    rows = spark.createDataFrame(runs, "subject_id int, cue_idx int, y int, x1 int, x2 int, w int, h int")
    key = F.col("subject_id") * 31 + F.col("cue_idx") * 17
    got = sorted(map(tuple, M.place_controls(rows, "w", "h", 2, key=key).collect()))
    want = [tuple(r) for w, h in set(sizes.values()) for r in M.place_controls(rows.where((F.col("w") == w) & (F.col("h") == h)), w, h, 2, key=key).collect()]
    assert got == sorted(want) and len(got) == 24
    moved = M.translate(rows, F.lit(10), F.lit(0), "w", "h").collect()
    assert all(r["x2"] <= r["w"] for r in moved) and len(moved) <= len(runs)


def test_masks_of_another_size_are_not_united(spark):
    masks = spark.createDataFrame([(1, 0, 0, 2, 4, [0, 8]), (1, 0, 1, 4, 2, [0, 8]), (2, 0, 0, 2, 4, [8])], "subject_id int, cue_idx int, inst_idx int, h int, w int, counts array<int>")
    kept, dropped = M.of_frame(masks, spark.createDataFrame([(1, 2, 4)], "subject_id int, h int, w int"))
    assert [(r["subject_id"], r["inst_idx"]) for r in kept.collect()] == [(1, 0)]
    assert sorted((r["subject_id"], r["inst_idx"]) for r in dropped.collect()) == [(1, 1), (2, 0)]


def test_dealt_boxes_are_the_only_shuffle(spark):
    """Pixel rows stay in the task of their subject, which took a shuffle of every row before."""
    import __spark_entry__ as E

    for name in ("mask_overlap", "mask_union", "mask_coverage", "control_placement", "mask_round_trip"):
        lines = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
        rows = [x for x in lines if "Exchange hashpartitioning" in x and ("y#" in x or "start#" in x or "inst_idx#" in x)]
        assert not rows and any("REPARTITION_BY_NUM" in x for x in lines), name
    plan = E.queries()["mask_decode"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_both_ways_of_decoding_agree(spark):
    rows = [(1, 1, 1, 2, 3, [1, 2, 1, 9]), (1, 1, 2, 2, 3, []), (1, 2, 1, 2, 3, [0, 6]), (2, 1, 1, 1, 4, [2, None, 1, 1]), (2, 1, 2, 1, 4, None), (2, 2, 2, 4, 1, [0, 1, 0, 1, 9])]
    masks = spark.createDataFrame(rows, "subject_id int, cue_idx int, inst_idx int, h int, w int, counts array<int>")
    got = sorted(tuple(r) for r in M.decode(masks).collect())
    assert got == sorted(tuple(r) for r in M.decode(masks, dealt=True).collect())
    assert [r[5:] for r in got] == [(1, 3), (4, 6), (0, 6), (3, 4), (0, 1), (1, 2)]


def test_overlap_of_sides_is_the_overlap(spark):
    import random

    rng = random.Random(5)
    rows = [(s, c, own, y, x, x + rng.randint(1, 90)) for s in range(3) for c in range(3) for own in (True, False) for y in range(3) for x in [rng.randint(0, 100)] if rng.random() < 0.7]
    rows = spark.createDataFrame(rows, "subject_id int, cue_idx int, own boolean, y int, x1 int, x2 int")
    got = sorted(tuple(r) for r in M.overlap_of_sides(M.words(rows, keys=("subject_id", "cue_idx", "own"))).collect())
    want = M.overlap(M.words(rows.where("own")), M.words(rows.where("not own")), on=("subject_id", "cue_idx"))
    assert got and got == sorted(tuple(r) for r in want.collect())


def test_frames_are_compared_where_the_masks_are(spark):
    """Masks and images are dealt alike, to tasks of bounded size, so that their join shuffles and gathers nothing more."""
    import __spark_entry__ as E

    plan = E.queries()["mask_frames"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(subject_id" in line]
    assert shuffles and all("REPARTITION_BY_NUM" in line for line in shuffles)

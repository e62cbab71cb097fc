"""Readers, sinks, parsing, sampling and streams over several batches."""

import json

import pytest
from pyspark.sql import functions as F

from veilmap.operators import updating as U
from veilmap.sources import readers as R
from veilmap.sources import replies as P
from veilmap.sources import sampling as S
from veilmap.sources import sinks
from veilmap.streaming import evidence as X

FENCE = "```"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_later_shard_and_line_win(spark, tmp_path):
    row = lambda i, c: json.dumps({"image_id": i, "path": "p", "lat": 1.0, "lon": 2.0, "gt_country": c, "gt_code": "x"})
    put(tmp_path / "subset1.jsonl", "\n".join([row("a", "one"), row("b", "one")]))
    put(tmp_path / "subset2.jsonl", "\n".join([row("a", "two"), row("a", "three")]))
    got = {r["image_id"]: r["gt_country"] for r in R.read_subjects(spark, str(tmp_path / "subset*.jsonl")).collect()}
    assert got == {"a": "three", "b": "one"}


def test_read_cues(spark, tmp_path):
    inst = {"bbox": [0, 0, 2, 2], "score": 0.5, "source": "s", "mask_rle": {"size": [2, 2], "counts": [0, 4]}, "degenerate": False}
    put(tmp_path / "i.json", json.dumps({"image_id": "i", "image_size": [2, 2], "geo_privacy_cues": [
        {"cue": "sign", "category": "text/signage", "is_text": True, "reasoning": "", "confidence": 0.9, "instances": [inst, inst], "maskable": True, "degenerate": False},
        {"cue": "tree", "category": "plant", "is_text": False, "reasoning": "", "confidence": 0.1, "instances": [], "maskable": False, "degenerate": False}]}))
    cues, instances = R.read_cues(spark, str(tmp_path / "*.json"))
    assert [(r["pos"], r["cue"], r["w"]) for r in cues.orderBy("pos").collect()] == [(0, "sign", 2), (1, "tree", 2)]
    assert [(r["cue_idx"], r["inst_idx"], list(r["counts"])) for r in instances.orderBy("inst_idx").collect()] == [(0, 0, [0, 4]), (0, 1, [0, 4])]


def test_read_lattice_and_sweep(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps({"image_id": "a", "posterior": {"x": 0.6, "y": 0.4}, "combos": [{"subset": [0, 2], "prior": {"x": 0.5, "y": 0.5}}]}))
    got = {(r["mask"], r["label"]): (r["ord"], r["p"]) for r in R.read_lattice(spark, str(tmp_path / "a.json")).collect()}
    assert got == {(0, "x"): (0, 0.6), (0, "y"): (1, 0.4), (5, "x"): (0, 0.5), (5, "y"): (1, 0.5)}
    rec = {"image_id": "s", "true_label": "x", "n_cues": 2, "mpl_all": 0.3, "posterior": {"x": 1.0}, "prior_allmask": {"x": 0.9},
           "per_cue": [{"cue": "c", "category": None, "mpl": 0.1, "prior": {"x": 0.8}}, {"cue": "d", "category": "k", "mpl": 0.2, "prior": {"x": 0.7}}]}
    put(tmp_path / "sweep.json", json.dumps([rec]))
    b, cues = R.read_sweep(spark, str(tmp_path / "sweep.json"))
    assert {r["mask"]: r["p"] for r in b.collect()} == {0: 1.0, 3: 0.9, 1: 0.8, 2: 0.7}
    assert {r["k"]: r["v"] for r in cues.collect()} == {0: 0.1, 1: 0.2}


def test_points_gallery_and_caches(spark, tmp_path):
    p = R.read_points_csv(spark, put(tmp_path / "p.csv", "IMG_ID,LAT,LON\nq,1.5,-2.25\n")).first()
    assert tuple(p) == ("q", 1.5, -2.25)
    g = R.read_gallery(spark, put(tmp_path / "g.json", json.dumps([{"label": "Çavuşin Köyü, Türkiye", "gps": [38.6, 34.8], "text": None, "ref_image": None}, {"label": "Nowhere", "gps": None, "text": None, "ref_image": None}])))
    assert [(r["label"], r["ord"], r["lat"]) for r in g.orderBy("ord").collect()] == [("Çavuşin Köyü, Türkiye", 0, 38.6), ("Nowhere", 1, None)]
    by_coord, by_name = R.read_geocode_cache(spark, put(tmp_path / "c.json", json.dumps({"1.50000,-2.25000": "Here"})), put(tmp_path / "n.json", json.dumps({"Here": [1.5, -2.25], "Gone": None})))
    assert tuple(by_coord.first()) == (150000, -225000, "Here")
    found, unknown = R.geocode(spark.createDataFrame([("Here",), ("Gone",), ("New",)], "name string"), "name", by_name)
    assert {r["name"]: r["lat"] for r in found.collect()} == {"Here": 1.5, "Gone": None, "New": None}
    assert [r["name"] for r in unknown.collect()] == ["New"]


def test_append_missing(spark, tmp_path):
    path = str(tmp_path / "out")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id int")
    mark = lambda run: lambda k: k.withColumn("run", F.lit(run))
    sinks.append_missing(ids(1, 2), mark(1), path, ["id"])
    got = sinks.append_missing(ids(1, 2, 3), mark(2), path, ["id"]).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 2)]


def test_report(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "subject_id string, v double")
    sinks.write_report(d.agg(F.avg("v").alias("mean")), d, str(tmp_path / "r"), sort=sinks.detail_order("v"))
    assert spark.read.json(str(tmp_path / "r/summary")).first()["mean"] == 2.0
    assert [r["subject_id"] for r in d.orderBy(*sinks.detail_order("v")).collect()] == ["c", "a", "b"]


def test_replies(spark):
    good = {1: '{"k": 1}', 2: f'Sure:\n{FENCE}json\n{{"k": 2}}\n{FENCE}\nbye', 3: 'so {"k": 3} it is', 4: f'{FENCE}\nnot json\n{FENCE} {FENCE}{{"k": 4}}{FENCE}', 5: '\n {"k": 5, "x": [1, {"y": 2}]} '}
    bad = {11: "[1, 2]", 12: "garbage", 13: '{"k": 1', 14: '{"k": 1} and {"k": 2}', 15: "7", 16: "", 17: '{"k": 1},{"k": 2}', 18: "} {"}
    df = spark.createDataFrame(list((good | bad).items()), "id int, text string")
    ok, rejected = P.parse_replies(df, "text", "k bigint")
    assert {r["id"]: r["parsed"]["k"] for r in ok.collect()} == {i: i for i in good}
    assert {r["id"] for r in rejected.collect()} == set(bad)


def test_parse_cues(spark):
    rows = [{"name": "sign", "bbox": [1, 2, 3, 4], "category": "text/signage", "confidence": 0.5}, {"cue": "tree", "bbox": ["1", 2, 3, 4]}, {"name": "x", "bbox": [1, 2, 3]}, {"bbox": [1, 2, 3, 4]}, {"name": "y", "bbox": [1, "b", 3, 4]}]
    df = spark.createDataFrame([("s", json.dumps(rows))], "subject_id string, text string")
    got = [(r["pos"], r["cue"], r["category"], r["is_text"], r["confidence"]) for r in P.parse_cues(df, "text").orderBy("pos").collect()]
    assert got == [(0, "sign", "text/signage", True, 0.5), (1, "tree", "other", False, 0.0)]


def test_first_valid(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") * 37 % 101).alias("h"))
    reason = F.when(F.col("id") % 3 == 0, "three").when(F.col("id") % 5 == 0, "five")
    kept, skipped = S.sample_first_valid(df, 10, reason, key="id", draw=F.col("h"))
    order = sorted(range(100), key=lambda i: (i * 37 % 101, i))
    want, counts = [], {}
    for i in order:
        if len(want) == 10:
            break
        why = "three" if i % 3 == 0 else "five" if i % 5 == 0 else None
        if why:
            counts[why] = counts.get(why, 0) + 1
        else:
            want.append(i)
    assert sorted(r["id"] for r in kept.collect()) == sorted(want)
    assert {r["reason"]: r["n"] for r in skipped.collect()} == counts
    kept, skipped = S.sample_first_valid(df, 1000, reason, key="id", draw=F.col("h"))
    assert kept.count() == 53 and sum(r["n"] for r in skipped.collect()) == 47


def test_quantiles_and_workload(spark):
    df = spark.createDataFrame([(f"{i:02d}", float(i * 7 % 20)) for i in range(20)], "id string, v double")
    for limit in (100, 0):
        got = S.pick_by_quantile(df, "v", 5, key="id", force=("1",), group_rows=limit).collect()
        ranks = sorted(df.collect(), key=lambda r: (r["v"], r["id"]))
        want = {ranks[i]["id"] for i in (0, 5, 10, 14, 19)} | {min((r for r in ranks if r["id"].startswith("1")), key=lambda r: (r["v"], r["id"]))["id"]}
        assert {r["id"] for r in got} == want
    m = spark.createDataFrame([(i, i % 8) for i in range(16)], "subject_id int, m int")
    picks = S.pick_workload(m, m.where("subject_id < 12"), m.where("subject_id = 6"), 4)
    assert [(r["m"], r["subject_id"]) for r in picks.collect()] == [(3, 3), (4, 4), (5, 5)]


# Streams in several batches ------------------------------------------------------------

def evidence_files(spark, tmp_path, order=(0, 1, 2)):
    """Ten events per user in three files; ``order`` shuffles which file comes when."""
    rows = [(u, t, u * 100 + t) for u in (1, 2) for t in range(10)]
    for place, part in enumerate(order):
        some = [r for r in rows if r[1] % 10 // 4 == part]
        df = spark.createDataFrame(some, "user_id bigint, t int, event_id bigint").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("t") * 60)).drop("t")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f{place}"))
    return str(tmp_path / "in" / "*"), spark.createDataFrame(rows, "user_id bigint, t int, event_id bigint").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("t") * 60)).drop("t")


def rate(df):
    r = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ord")
    keep = [c for c in ("event_id", "ts", "step") if c in df.columns]
    each = df.select(F.col("user_id").alias("subject_id"), *keep, F.lit("country").alias("level"), r)
    return each.withColumns({"label": F.concat(F.lit("h"), "ord"), "c": ((F.col("event_id") * 3 + F.col("ord") * 2) % 5 + 1).cast("double"), "alpha": ((F.col("event_id") + F.col("ord")) % 7) / F.lit(7.0)})


def priors(spark):
    return spark.createDataFrame([(u, "country", f"h{o}", o, [0.2, 0.3, 0.5][o]) for u in (1, 2) for o in range(3)], "subject_id bigint, level string, label string, ord int, p double")


def open_stream(spark, path):
    return spark.readStream.schema("user_id bigint, event_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def batch_truth(spark, events):
    from veilmap.operators.scale import row_numbers

    return U.sequential_posterior(priors(spark), rate(row_numbers(events, ["user_id"], ["ts", "event_id"], "step")))


def test_stream_posterior_converges_whatever_the_order(spark, tmp_path):
    path, events = evidence_files(spark, tmp_path, order=(2, 0, 1))
    X.run_available(X.stream_posterior(rate(open_stream(spark, path)), priors(spark), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {(r["subject_id"], r["label"]): (r["p"], r["n_evidence"]) for r in X.latest_posterior(spark, str(tmp_path / "out")).collect()}
    t = batch_truth(spark, events).where("step = 10").collect()
    assert len(got) == len(t) == 6
    for r in t:
        assert abs(got[(r["subject_id"], r["label"])][0] - r["p"]) < 1e-9 and got[(r["subject_id"], r["label"])][1] == 10


def test_a_batch_of_one_hypothesis_keeps_the_others(spark, tmp_path):
    """Snapshots and changes: twelve batches, each rating one label of one subject."""
    rated = [(1, f"h{i % 3}", i % 3, float(i % 5 + 1), (i % 7) / 7.0) for i in range(12)] + [(1, "h0", 0, None, 1.0)]
    schema = "subject_id bigint, label string, ord int, c double, alpha double, level string"
    for i, r in enumerate(rated):
        spark.createDataFrame([(*r, "country")], schema).coalesce(1).write.parquet(str(tmp_path / f"in/f={i:02d}"))
    stream = spark.readStream.schema(schema + ", f int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    X.run_available(X.stream_posterior(stream, priors(spark), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert (tmp_path / "out/sums/snapshot").exists()
    weight = [0.2, 0.3, 0.5]
    for _, _, o, c, a in rated[:12]:
        weight[o] *= 2 ** (a * (c - 3))
    got = {r["label"]: (r["p"], r["n_evidence"]) for r in X.latest_posterior(spark, str(tmp_path / "out")).where("subject_id = 1").collect()}
    assert {l: n for l, (_, n) in got.items()} == {"h0": 4, "h1": 4, "h2": 4}
    assert all(abs(got[f"h{o}"][0] - w / sum(weight)) < 1e-12 for o, w in enumerate(weight))


def test_a_foreign_table_is_an_error(spark, tmp_path):
    spark.createDataFrame([(1,)], "other int").write.parquet(str(tmp_path / "t"))
    todo = spark.createDataFrame([(1,), (2,)], "id int")
    with pytest.raises(Exception, match="id"):
        sinks.append_missing(todo, lambda k: k, str(tmp_path / "t"), ["id"])
    spark.createDataFrame([(1, 2)], "id int, more int").write.parquet(str(tmp_path / "u"))
    with pytest.raises(ValueError, match="more"):
        sinks.append_missing(todo, lambda k: k, str(tmp_path / "u"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and sinks.read_if_there(spark, str(tmp_path / "none")) is None


def test_one_odd_element_takes_no_other_with_it(spark):
    good = '{"name": "a", "bbox": [1, 2, 3, 4]}'
    texts = {"mixed": f'[{good}, "noise", null, 7, [1], {good}]', "no": good, "bad": "[{", "null": None, "empty": "[]"}
    kept, rejected = P.split_cues(spark.createDataFrame(list(texts.items()), "subject_id string, text string"), "text")
    assert sorted((r["subject_id"], r["pos"]) for r in kept.collect()) == [("mixed", 0), ("mixed", 5)]
    assert sorted((r["subject_id"], -1 if r["pos"] is None else r["pos"], r["reason"]) for r in rejected.collect()) == [
        ("bad", -1, "no array"), *[("mixed", i, "no object") for i in (1, 2, 3, 4)], ("no", -1, "no array"), ("null", -1, "no array")]


def test_stream_trajectory_equals_batch(spark, tmp_path):
    path, events = evidence_files(spark, tmp_path)
    # Files are read by modification time; the three were written in order.
    stream = open_stream(spark, path).withColumn("level", F.lit("country"))
    X.run_available(X.stream_trajectory(stream, rate, priors(spark), str(tmp_path / "run"), str(tmp_path / "cp")))
    got = {(r["subject_id"], r["step"], r["label"]): r for r in spark.read.parquet(str(tmp_path / "run/trajectory")).collect()}
    truth = batch_truth(spark, events)
    assert len(got) == 60
    for r in truth.collect():
        g = got[(r["subject_id"], r["step"], r["label"])]
        assert abs(g["p"] - r["p"]) < 1e-9 and abs(g["delta_p"] - r["delta_p"]) < 1e-9
    want = sorted((r["subject_id"], r["step"], r["type"]) for r in U.belief_events(U.step_facts(truth)).collect())
    assert sorted((r["subject_id"], r["step"], r["type"]) for r in spark.read.parquet(str(tmp_path / "run/events")).collect()) == want


def test_append_once_over_batches(spark, tmp_path):
    path, events = evidence_files(spark, tmp_path)
    X.run_available(X.append_once(open_stream(spark, path), str(tmp_path / "o"), str(tmp_path / "cp"), ["user_id"]))
    out = spark.read.parquet(str(tmp_path / "o"))
    assert sorted(r["user_id"] for r in out.collect()) == [1, 2]


@pytest.mark.parametrize("name", ["window_evidence", "sliding_evidence"])
def test_windows_count_times_by_rounded_seconds(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as E

    times = ["2024-01-01 05:59:59.4", "2024-01-01 05:59:59.5", "2024-01-01 05:59:59.7", "2024-01-01 11:59:58.5", "2024-01-01 18:00:00.2", "2024-01-02 12:59:59.9"]
    rows = ", ".join(f"({i}, TIMESTAMP '{t}', {i % 2}, 'view', 1.0, '')" for i, t in enumerate(times))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'")
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/region.parquet') TO '{tmp_path}/region.parquet'")
    for table in ("events", "region"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.execute(E.oracle_sql()[name]).fetchall()
    got = E.queries()[name](spark, str(tmp_path)).collect()
    assert sorted((r["start"], r["ord"], r["n"], round(r["log_w"], 5) + 0.0) for r in got) == sorted((s[:19], o, n, round(w, 5) + 0.0) for s, o, n, w in want)


def test_a_large_static_table_is_not_broadcast_once_salted(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 7) for i in range(60)], "event_id long, user_id long")
    users = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "user_id long, name string")
    users.write.parquet(f"{tmp_path}/users")
    users = spark.read.parquet(f"{tmp_path}/users")  # of known, small size
    out = X.join_static(events, users, ["user_id"], spread_by=["event_id"], max_rows=3)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["event_id"], r["name"]) for r in out.collect()) == sorted((i, f"n{i % 7}") for i in range(60) if i % 7 < 5)


def test_batches_of_few_labels_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """A label's ratings lie in as many files as they need, which one micro-batch takes together."""
    from veilmap.plans import flow_queries

    monkeypatch.setattr(flow_queries, "scratch_path", lambda s, name: str(tmp_path))
    monkeypatch.setattr(flow_queries, "task_count", lambda s, rows: 20, raising=False)
    flow_queries.stream_posterior_batches(spark, "/root/testdata/sf0.01").count()
    held = spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name().alias("f")).agg(F.count_distinct("ord").alias("labels"), F.count(F.lit(1)).alias("n")).collect()
    assert len(held) == 20 and all(r.labels == 1 for r in held) and max(r.n for r in held) < 0.1 * sum(r.n for r in held)
    assert len([p for p in (tmp_path / "out" / "sums" / "changes").iterdir() if p.name.startswith("batch=")]) == 5

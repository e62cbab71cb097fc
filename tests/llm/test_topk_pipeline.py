"""Exact top-k against brute force; the pipeline's stages and result."""

import hashlib
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from veilmap.llm import bpe, components, queries, topk
from veilmap.llm.common import stored

SF = "/root/testdata/sf0.001"


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=37)]) for i in range(400)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, [1.0, None] * 18 + [1.0]), (504, [math.nan] * 37), (550, [math.inf] * 37), (600, [1.0, 2.0]), (601, [1.0, 3.0]), (650, []), (651, []), (None, rows[1][1]), rows[7], rows[7]]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    for options in ({}, {"queries": 3, "candidates": 50}):
        got = topk.top_k(docs, F.col("vec_id") % 50 == 0, **options).collect()
        assert sorted(map(tuple, got)) == sorted(brute_multi(rows))
    assert topk.top_k(docs.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def brute_multi(rows):
    return brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(3**i % 1000003), 1e5 + i, -7.5]) for i in range(101)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    top = (1 << 63) - 1
    assert {tuple(r) for r in got} == {(q, r, i, max(-top - 1, min(top, s))) for q, r, i, s in brute(rows)}


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op7_exact_top_k"]).fetchall()
    got = queries.op7_exact_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(want) == sorted(map(tuple, got))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-pipeline")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    counts = {k: v.count() for k, v in seen.items()}
    assert counts["near_duplicates"] < counts["quality"] and counts["repeated_spans"] <= counts["near_duplicates"] and counts["mixing"] == counts["encoding"]
    scores = {r.doc_id: r.predicted for r in queries.op5_quality_scores(spark, SF).collect()}
    assert {r.doc_id for r in seen["quality"].collect()} == {i for i, p in scores.items() if p}
    assert seen["near_duplicates"].select("doc_id").distinct().count() == counts["near_duplicates"]
    changed = [r for r in seen["repeated_spans"].collect() if r.n_chars != len(r.text)]
    assert not changed
    tokenizer = Tokenizer.from_str(bpe.read_spec())
    mixed = {r.doc_id: r.text for r in seen["mixing"].collect()}
    for r in seen["encoding"].collect():
        ids = tokenizer.encode(mixed[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(mixed[r.doc_id].encode()).hexdigest()
    assert corpus_pipeline.run(spark, SF).count() == counts["encoding"]


def test_stages_take_awkward_and_empty_tables(spark, awkward):
    rows = awkward[0].select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0


def test_small_splits_meet_in_larger_tasks(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a few words "), 5).alias("text")).repartition(150)
    got = corpus_pipeline.in_tasks(docs)
    assert got.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    assert got.count() == 2000 and corpus_pipeline.in_tasks(docs.limit(0)).count() == 0


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    files = []

    def noted(df, name):
        out = stored(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "stored", noted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    got = components.components(edges)
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(301)}
    assert len(files) > 2 and max(files[1:]) == 1

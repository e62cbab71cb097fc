"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, centroids, fingerprints, language, licenses, lm, mixing, near, quality, spans, suffixes, topk
from .common import fold, table

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(plan):
    PLANS[plan.__name__] = plan
    return plan


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", "taken")


@query
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 7, 2)
    out = lm.score(docs, ~held_out).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.with_edits(docs).withColumnRenamed("id", "doc_id")


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.digests(docs).withColumnRenamed("id", "doc_id")


@query
def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~fold("doc_id", 4, 2)))
    out = quality.score_column(docs, model, keep=["doc_id"])
    return out.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_column(docs, bpe.read_spec(), keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op7_exact_top_k"] = """
WITH raw AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM raw q JOIN raw c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~fold("doc_id", 5, 0)))
    out = language.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near.near_classes(docs).withColumnRenamed("id", "doc_id")


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.digests(docs).withColumnRenamed("id", "doc_id")


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.digests(docs).withColumnRenamed("id", "doc_id")


ORACLES["op11_license_scan"] = licenses.oracle()


@query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(table(spark, sf_dir, "embeddings"))


def _clusters_sql(rounds: int = 5, k: int = 40) -> str:
    """The rounds one after the other; sums and products of these integers are exact in doubles."""
    steps = [f"""
kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM kept ORDER BY sha256('2:' || vec_id), v LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT e.rowid AS r, e.vec_id, e.v, c.c, list_dot_product(e.v, e.v) - 2 * list_dot_product(e.v, c.v) + list_dot_product(c.v, c.v) AS d
    FROM (SELECT row_number() OVER () AS rowid, * FROM kept) e CROSS JOIN c{r} c) GROUP BY r, vec_id, v)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT cluster, list(CAST(s - ((s % n) + n) % n AS DOUBLE) / n ORDER BY i) AS v FROM (
        SELECT cluster, i, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c.c)""")
    return f"""
WITH {','.join(steps)},
inertias AS (SELECT cluster, sum(distance) AS inertia FROM a{rounds} GROUP BY cluster)
SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, CAST(i.inertia AS BIGINT) AS cluster_inertia, CAST((SELECT sum(inertia) FROM inertias) AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN inertias i USING (cluster) JOIN c{rounds} c ON c.c = a.cluster
"""


ORACLES["op12_centroid_clusters"] = _clusters_sql()


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, bpe.read_spec(), alignment.read_model(), keep=["doc_id"])

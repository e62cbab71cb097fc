"""Exact top-k search by columnar branch-and-bound.

Vectors are scaled to integers and dealt to groups; every group of queries meets every group of candidates in one task.
There the candidates lie in vertical layout, one row per dimension. Scores are accumulated a block of dimensions at a
time; after each block a candidate's score is at most what it has plus the product of the remaining lengths of the
query and of itself, and candidates that cannot reach the query's k-th best lower bound are compacted away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES = 1024
CANDIDATES = 8192
DIMENSIONS = 16


def scaled(rows: list[list[float]], scale: float) -> np.ndarray:
    """floor(scale * x) by dimension x vector: doubles where all sums are exact in them, Python integers otherwise."""
    x = np.floor(np.asarray(rows, np.float64) * scale).T
    if x.size and not np.abs(x).max() ** 2 * len(x) < 2.0**53:
        return np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return np.ascontiguousarray(x)


def search(queries: np.ndarray, own: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, block: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of the k best of each query; ids ascend, and ties keep their order.

    A candidate with the query's own id is left out.
    """
    dims, n = candidates.shape
    cuts = [*range(0, dims, block), dims] if dims else [0, 0]

    def left(x: np.ndarray) -> np.ndarray:
        """Length of each vector in the dimensions from each cut on."""
        squares = [(x[a:b].astype(np.float64) ** 2).sum(axis=0) for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.sqrt(np.cumsum([np.zeros(x.shape[1]), *squares[::-1]], axis=0)[::-1]) * (1 + 1e-9)

    q_left, c_left = left(queries), left(candidates)
    first = queries[: cuts[1]].T @ candidates[: cuts[1]]
    where, found, scores = [], [], []
    for q in range(queries.shape[1]):
        alive = np.flatnonzero(ids != own[q])
        score = first[q][alive]
        for b in range(1, len(cuts)):
            rest = (q_left[b][q] * c_left[b])[alive]
            if len(alive) > k:
                held = score.astype(np.float64)
                low = held - rest
                floor = np.partition(low, len(low) - k)[len(low) - k]
                stay = held + rest >= floor - 1e-9 * abs(floor) - 1e-6
                alive, score = alive[stay], score[stay]
            if b < len(cuts) - 1:
                score = score + queries[cuts[b] : cuts[b + 1], q] @ candidates[cuts[b] : cuts[b + 1]][:, alive]
        best = np.argsort(-score, kind="stable")[:k]
        where += [q] * len(best)
        found += alive[best].tolist()
        scores += [int(s) for s in score[best]]
    top = (1 << 63) - 1
    return np.array(where, np.int64), np.array(found, np.int64), np.array([max(-top - 1, min(top, s)) for s in scores], np.int64)


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to the smaller id.

    Rows without an id or a vector, or with null or non-finite components, take no part; only vectors of one length are
    compared. Rows with the query's own id are not its candidates; repeated query rows count once, repeated candidate
    rows each. Scores beyond 64 bits are cut to them. An empty table gives an empty result.
    """
    v = F.col(f"`{vector_col}`")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & usable)
    rows = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("dim", F.size("v"))
    counts = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q_groups, c_groups = max(1, -(-counts[1] // queries)), max(parts, -(-counts[0] // candidates))
    at = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = rows.where("asks").select("dim", "id", "v").distinct().withColumns({"key": F.xxhash64("v"), "qg": at(q_groups)}).withColumn("cg", each(c_groups))
    held = rows.select("dim", "id", "v").withColumn("cg", at(c_groups)).withColumn("qg", each(q_groups))
    width = DIMENSIONS

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        right = right.sort_by("id")
        own, keys, ids = (np.asarray(c) for c in (left.column("id"), left.column("key"), right.column("id")))
        c, q = scaled(right.column("v").to_pylist(), scale), scaled(left.column("v").to_pylist(), scale)
        if c.dtype != q.dtype or (c.size and c.dtype != object and not np.abs(c).max() * np.abs(q).max() * max(1, len(c)) < 2.0**53):
            c, q = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (c, q))
        at_q, at_c, score = search(q, own, c, ids, k, width)
        return pa.table({"query_id": own[at_q], "key": keys[at_q], "vec_id": ids[at_c], "score": score})

    found = asking.groupBy("dim", "qg", "cg").cogroup(held.groupBy("dim", "qg", "cg")).applyInArrow(run, "query_id bigint, key bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

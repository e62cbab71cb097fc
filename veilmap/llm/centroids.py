"""Centroid clustering with an incremental distance matrix.

Vectors become integers. Beside each vector lies its row of the distance matrix: the exact integer dot product with every
centroid. When the centroids move, only the components in which a centroid changed are multiplied and added to its dot
products; the squared distance is then |v|^2 - 2 v.c + |c|^2, and its least one gives the cluster. The rows are a written
table that every round reads and writes anew, so a lost executor repeats its part of one round. The driver holds the
centroids alone: k x dimension integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored_at

#: Components up to this size keep every squared distance of 64 dimensions, and all sums on the way, within 64 bits.
LARGEST = 1 << 27
STATE = "vec_id {kind}, v array<bigint>, dots array<bigint>, cluster int, distance bigint"


def integers(vectors: DataFrame, *, id_col: str, vector_col: str, dimensions: int, scale: float) -> DataFrame:
    """(vec_id, v): the rows that take part, floor(scale * x) of each component."""
    v = F.col(f"`{vector_col}`")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(v.isNotNull() & (F.size(v) == dimensions) & usable)
    return kept.select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k least hashes of seed and id, in that order; equal ids by vector, rows without an id last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = rows.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r.v for r in got], np.int64)


def changes(old: np.ndarray, new: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(centroid, its changed components, by how much each) of the centroids that moved."""
    moved = new - old
    return [(c, np.flatnonzero(row), row[row != 0]) for c, row in enumerate(moved) if row.any()]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.ravel()))


def nearest(v: np.ndarray, dots: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster (ties: the smaller number) and squared distance of each vector."""
    distances = (v * v).sum(axis=1)[:, None] - 2 * dots + squares
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(len(v)), cluster]


def reassigned(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """Every row with its dot products brought up to date with ``new``, and its cluster and distance."""
    k, width = new.shape
    moved, squares = changes(old, new), (new * new).sum(axis=1)
    limit, begun = LARGEST, "dots" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width)
            if len(v) and max(v.max(), -v.min()) > limit:
                raise ValueError(f"scaled components beyond {limit}: squared distances would leave 64 bits")
            dots = matrix(batch.column("dots"), k).copy() if begun else np.zeros((len(v), k), np.int64)
            for c, at, by in moved:
                dots[:, c] += v[:, at] @ by
            cluster, distance = nearest(v, dots, squares)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists(dots), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "dots", "cluster", "distance"])

    return state.mapInArrow(run, STATE.format(kind=state.schema["vec_id"].dataType.simpleString()))


def sums(state: DataFrame, width: int) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> (rows, componentwise sums). A task sends one row for each cluster it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = {}, {}
        for batch in batches:
            v, cluster = matrix(batch.column("v"), width), batch.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                own = v[cluster == c]
                n[c] = n.get(c, 0) + len(own)
                total[c] = total.get(c, 0) + own.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), lists(np.array(list(total.values())))], names=["cluster", "n", "total"])

    part = state.select("v", "cluster").mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    whole = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)])
    return {r.cluster: (r.n, list(r[2:])) for r in whole.collect()}


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 64, scale: float = 256.0, k: int = 40, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): vec_id, cluster and distance (squared) of each vector, and the final integer centroids.

    Vectors that are null, of another length, or hold a null or non-finite component take no part. Each round assigns
    every vector to the nearest centroid (ties: the smaller number) and replaces every non-empty centroid by the exact
    floor of its vectors' mean; empty ones stay; at the end all are assigned once more. With fewer than ``k`` vectors there
    are as many centroids as vectors. Repeated rows count each. Rows without an id take part, but start a centroid only
    after all others. A scaled component beyond 2^27 is an error. An empty table gives an empty result.
    """
    rows = integers(vectors, id_col=id_col, vector_col=vector_col, dimensions=dimensions, scale=scale)
    now = first_centroids(rows, k, seed)
    if not len(now):
        kind = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), np.zeros((0, dimensions), np.int64)
    state, path, old = rows, None, np.zeros_like(now)
    for r in range(rounds + 1):
        before = path
        state, path = stored_at(reassigned(state, old, now), "centroids")
        if before is not None:
            discard(state.sparkSession, before)
        if r < rounds:
            old, now = now, now.copy()
            for c, (n, total) in sums(state, dimensions).items():
                now[c] = [s // n for s in total]
    return state.select("vec_id", "cluster", "distance"), now


def digests(vectors: DataFrame, **options) -> DataFrame:
    """Per vector: vec_id, cluster, distance, the inertia (sum of distances) of its cluster and of all, centroid_sha256."""
    rows, centroids = cluster(vectors, **options)
    spark = vectors.sparkSession
    shas = [(c, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centroids)]
    named = spark.createDataFrame(shas, "cluster int, centroid_sha256 string")
    each = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = rows.agg(F.sum("distance").alias("inertia"))
    # As many rows as there are centroids, k at most.
    known = each.join(F.broadcast(named), "cluster").join(F.broadcast(whole), F.lit(True))
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

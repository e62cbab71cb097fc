"""Pluggable belief scorers over masked cue subsets.

A scorer turns a batch of feature rows into label scores for each mask. It runs
inside ``mapInArrow``: rows stay in their partition, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import SCORE_SMOOTHING
from .geometry import GALLERY_ROWS
from .lattice import MAX_CUES

CENTROID_VALUES = 8_000_000  # 64 MB: 5,000 labels of 1,600 dimensions
SLICE_VALUES = 1 << 20  # values of one output batch
# (features n x d, cue count m) -> scores n x 2^m-or-fewer masks x labels, for the given masks
Scorer = Callable[[np.ndarray, int, np.ndarray], np.ndarray]


def collect_centroids(means: DataFrame) -> np.ndarray:
    """(label, dim, c) -> labels x dims. Both the labels, as in any gallery, and all values are checked to be within bounds."""
    size = means.agg(F.count_distinct("label"), F.count(F.lit(1))).first()
    if size[0] > GALLERY_ROWS or size[1] > CENTROID_VALUES:
        raise ValueError(f"{size[0]} labels with {size[1]} values; a gallery holds up to {GALLERY_ROWS} labels and {CENTROID_VALUES} values")
    rows = means.toPandas()
    return rows.pivot(index="label", columns="dim", values="c").sort_index().sort_index(axis=1).to_numpy()


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _shares(raw: np.ndarray) -> np.ndarray:
    total, n = raw.sum(axis=-1, keepdims=True), raw.shape[-1]
    base = np.where(total > 0, raw / np.where(total > 0, total, 1.0), 1.0 / n)
    return (1 - SCORE_SMOOTHING) * base + SCORE_SMOOTHING / n


# Ways to turn scores into a belief, by name: one softmax over the gallery, a
# 0..1 score per label, points to share out, and a yes-probability per label.
METHODS = {
    "softmax": _softmax,
    "independent": lambda s: _shares(np.clip(s, 0.0, 1.0)),
    "allocate": lambda s: _shares(np.maximum(s, 0.0)),
    "logprob": lambda s: _shares(1.0 / (1.0 + np.exp(-s))),
}


def similarity_scorer(centroids: np.ndarray, scale: float = 1.0, method: str = "softmax") -> Scorer:
    """Dot product with each centroid; a masked cue adds nothing.

    The score of a subset is a sum over its cues, so the dot products are taken
    once per cue and every mask is a selection of them.
    """
    to_belief = METHODS[method]

    def score(x: np.ndarray, m: int, masks: np.ndarray) -> np.ndarray:
        cue = np.arange(x.shape[1]) % m
        parts = np.stack([x[:, cue == k] @ centroids[:, cue == k].T for k in range(m)], axis=1)
        visible = 1.0 - ((masks[:, None] >> np.arange(m)[None, :]) & 1)
        return to_belief(scale * np.einsum("sk,nkl->nsl", visible, parts))

    return score


def _masks(m: int, subsets: str) -> np.ndarray:
    full = (1 << m) - 1
    return np.arange(full + 1) if subsets == "all" else np.unique(np.array([0, full]))


def score_subsets(features: DataFrame, scorer: Scorer, *, subsets: Literal["all", "ends"] = "all") -> DataFrame:
    """(subject_id, truth, m, x) -> (subject_id, truth, m, mask, p, full).

    Mask 0 is the full view, whose belief is repeated as ``full``. ``subsets``
    is every mask, or only the full and the fully masked view. Rows without cues
    or with more than ``MAX_CUES`` are not scored; ``unscored`` gives them.
    """
    schema = T.StructType([
        features.schema["subject_id"], features.schema["truth"], T.StructField("m", T.IntegerType()),
        T.StructField("mask", T.LongType()),
        T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("full", T.ArrayType(T.DoubleType())),
    ])

    def lists(values: np.ndarray) -> pa.Array:
        offsets = np.arange(0, values.size + 1, values.shape[-1], dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, values.reshape(-1))

    def values(part: pa.RecordBatch) -> np.ndarray:
        return part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms = batch.column("m").to_numpy()
            for m in np.unique(ms):
                group = batch.filter(pa.array(ms == m))
                everything = _masks(int(m), subsets)
                one = group.slice(0, 1)
                labels = scorer(values(one), int(m), everything[:1]).shape[-1]
                # Rows first, then the masks of a row, are cut into slices of about SLICE_VALUES values.
                rows = max(1, SLICE_VALUES // (len(everything) * labels))
                step = max(1, SLICE_VALUES // (rows * labels))
                for at in range(0, group.num_rows, rows):
                    part = group.slice(at, rows)
                    x = values(part)
                    full = scorer(x, int(m), everything[:1])[:, 0, :]
                    for first in range(0, len(everything), step):
                        masks = everything[first : first + step]
                        p = scorer(x, int(m), masks)
                        n, s, k = p.shape
                        again = pa.array(np.repeat(np.arange(n), s))
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("subject_id").take(again), part.column("truth").take(again),
                                pa.array(np.full(n * s, m, dtype=np.int32)), pa.array(np.tile(masks, n).astype(np.int64)),
                                lists(p.reshape(n * s, k)), lists(np.repeat(full, s, axis=0)),
                            ],
                            names=["subject_id", "truth", "m", "mask", "p", "full"],
                        )

    inside = features.where(F.col("m").between(1, MAX_CUES))
    return inside.select("subject_id", "truth", F.col("m").cast("int").alias("m"), "x").mapInArrow(run, schema)


def unscored(features: DataFrame) -> DataFrame:
    """The rows that ``score_subsets`` leaves out: no cues, or more than ``MAX_CUES``."""
    return features.where(F.col("m").isNull() | ~F.col("m").between(1, MAX_CUES))


def score_views(rows: DataFrame, scorer: Scorer, views: dict[str, str]) -> DataFrame:
    """Beliefs of ready-made views: each feature column in ``views`` is scored
    unmasked and replaced by the belief column it maps to."""
    keep = [c for c in rows.columns if c not in views]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(o, T.ArrayType(T.DoubleType())) for o in views.values()])
    none = np.zeros(1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in keep]
            for source in views:
                x = batch.column(source).flatten().to_numpy(zero_copy_only=False).astype(float)
                p = scorer(x.reshape(batch.num_rows, -1), 1, none)[:, 0, :] if batch.num_rows else np.zeros((0, 1))
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * p.shape[1]
                columns.append(pa.ListArray.from_arrays(offsets, p.reshape(-1)))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *views.values()])

    return rows.select(*keep, *views).mapInArrow(run, schema)

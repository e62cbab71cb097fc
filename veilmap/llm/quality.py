"""Supervised subword embeddings for document quality.

Every word, and every character n-gram of the word between its marks, is hashed to one of ``buckets`` vectors;
so is the pair of a word and the same word again, all such pairs to one vector. A document is the average of the
vectors of all its words, n-grams and repeats; a softmax over that average gives the label. The
vectors and the softmax are learned together by stochastic gradient descent in numpy, in one Spark task, on a bounded
sample of labelled rows. For scoring, the softmax's difference of the two labels is folded into the vectors, so that a
word costs one number, which is remembered per distinct word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ODD, mixed
from .common import fold, slices, tidy

BUCKETS = 1 << 17
DIM = 16
GRAMS = (3, 5)
#: The labelled rows fitted on: about this many at most, chosen by hash, however many there are.
SAMPLE_ROWS = 6000
WORDS_REMEMBERED = 100_000
#: Text bytes whose new words are hashed at once.
SLICE_BYTES = 1 << 18
#: The vector of "the word before, again".
AGAIN = zlib.crc32(b"again", 99)
#: Tells a whole word's hash from that of an equal n-gram.
WHOLE = np.uint64(0xA24BAED4963EE407)


def features(words: list[bytes], buckets: int = BUCKETS, grams: tuple[int, int] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their byte n-grams between marks, and the word each belongs to; by n, then in order.

    All words are hashed at once: a polynomial over the joined bytes, of which prefix sums give every stretch.
    """
    marked = b"".join([b"<" + w + b">" for w in words])
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    n = len(marked)
    sums, powers, back = np.zeros(n + 1, np.uint64), np.full(n, ODD, np.uint64), np.full(n, pow(int(ODD), -1, 1 << 64), np.uint64)
    powers[:1] = back[:1] = 1
    np.cumsum((np.frombuffer(marked, np.uint8).astype(np.uint64) + np.uint64(1)) * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64, out=sums[1:])
    back = np.cumprod(back, dtype=np.uint64)
    at, stop = ends - sizes, ends
    found, owner = [(sums[stop] - sums[at]) * back[at] + WHOLE], [np.arange(len(words))]
    left = ends[word] - np.arange(n)  # bytes up to the end of the word
    for k in range(grams[0], grams[1] + 1):
        at = np.flatnonzero((left >= k) & (sizes[word] > k))
        found.append((sums[at + k] - sums[at]) * back[at])
        owner.append(word[at])
    return (mixed(np.concatenate(found)) % np.uint64(buckets)).astype(np.int64), np.concatenate(owner)


def bag(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of all its features."""
    words = text.encode().split()
    counts = Counter(words)
    found, owner = features(list(counts), buckets)
    repeats = np.fromiter(counts.values(), float, len(counts))[owner]
    if again := sum(a == b for a, b in zip(words, words[1:], strict=False)):
        found, repeats = np.r_[found, AGAIN % buckets], np.r_[repeats, float(again)]
    if not len(found):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    idx, at = np.unique(found.astype(np.int32), return_inverse=True)
    share = np.bincount(at, repeats)
    return idx, (share / share.sum()).astype(np.float32)


def fit(texts: list[str], labels: list[int], *, buckets: int = BUCKETS, dim: int = DIM, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): the log odds of label 1 are the bias plus the average of a document's bucket scores.

    The step of a document's vectors is scaled so that their average moves by the rate times the gradient, whatever the
    length of the document.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    bags = [bag(t, buckets) for t in texts]
    steps, total = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = rate * (1 - steps / total)
            steps += 1
            idx, share = bags[i]
            mean = share @ table[idx] if len(idx) else np.zeros(dim, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            if len(idx):
                down = p @ out
                table[idx] -= (lr / float(share @ share)) * np.outer(share, down)
                out -= lr * np.outer(p, mean)
            bias -= 0.1 * lr * p
    return (table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def labelled_sample(labels: DataFrame, *, id_col: str, label_col: str, rows: int) -> DataFrame:
    """About ``rows`` labelled ids at most, the same ones on every run; null labels and ids are left out."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)")
    share = min(1.0, rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < F.lit(round(share * (1 << 30))))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, **options) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample of the labelled rows of ``labels`` whose documents are in ``docs``.

    The sample (about ``rows`` rows) is gathered in one task; what comes back is one number per bucket.
    """
    sample = labelled_sample(labels, id_col=id_col, label_col=label_col, rows=rows)
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).select("text", F.col("__label").alias("label"))
    joined = joined.withColumn("order", F.xxhash64("text", "label"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("order")
        scores, bias = fit(group.column("text").to_pylist(), group.column("label").to_pylist(), buckets=buckets, **options)
        return pa.table({"scores": [scores.tobytes()], "bias": [bias]})

    got = joined.groupBy(F.lit(0).alias("all")).applyInArrow(run, "scores binary, bias double").collect()
    if not got:
        return np.zeros(buckets, np.float32), 0.0
    return np.frombuffer(got[0].scores, np.float32), got[0].bias


def score_column(docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Adds the probability of label 1. A null text counts as empty; an empty text gets the bias alone."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    remembered = WORDS_REMEMBERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = held.value
        buckets = len(table)
        known: dict[bytes, int] = {}
        sums, sizes = np.zeros(remembered), np.zeros(remembered)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for start, rows in slices(batch, batch.num_columns - 1, SLICE_BYTES):
                texts = [t.encode().split() for t in batch.column(batch.num_columns - 1).slice(start, rows).to_pylist()]
                if len(known) > remembered:
                    known.clear()
                new = list(set().union(*texts).difference(known))
                first = len(known)
                if first + len(new) > len(sums):
                    sums, sizes = (np.r_[x, np.zeros(first + len(new))] for x in (sums, sizes))
                found, owner = features(new, buckets)
                sums[first : first + len(new)] = np.bincount(owner, table[found], len(new))
                sizes[first : first + len(new)] = np.bincount(owner, minlength=len(new))
                known.update(zip(new, range(first, first + len(new)), strict=True))
                for r, words in enumerate(texts, start):
                    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    again = int((at[1:] == at[:-1]).sum())
                    z = bias + ((sums[at].sum() + again * table[AGAIN % buckets]) / (sizes[at].sum() + again) if words else 0.0)
                    out[r] = 1 / (1 + np.exp(-z)) if z > -500 else 0.0
                del texts, new, found, owner
            own = [batch.column(k) for k in range(len(keep))]
            tidy()
            yield pa.RecordBatch.from_arrays([*own, pa.array(out)], names=[*keep, name])
        known.clear()
        tidy()

    return source.mapInArrow(run, T.StructType([*source.drop("__text").schema.fields, T.StructField(name, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """The documents scored at ``threshold`` or better, all columns kept; rows of the held-out fold are never learned from."""
    model = train(docs, labels.where(~fold("doc_id", *held_out)))
    return score_column(docs, model, name="__score").where(F.col("__score") >= threshold).drop("__score")

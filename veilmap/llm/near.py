"""N-gram Jaccard join with Bayesian candidate pruning.

Texts of equal shingle sets are one node. Nodes that agree in all values of some MinHash band meet in a bucket. There,
two signatures are compared a few values at a time: after each step the posterior probability that the similarity
reaches the threshold, given the agreements so far, decides whether the pair is dropped. The pairs left tie the nodes to
clusters, in which they are checked exactly on the shingle sets; only exact links count.

With 35 bands of 5 values, two texts at the threshold of 0.8 miss all bands once in a million; the pruning gives up
pairs whose posterior falls below ``tolerance``. No pair is written out: tasks return counts and spanning edges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, join_small, stored, tidy
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 35, 5
STEP = 25
TOLERANCE = 1e-7
#: Nodes of a bucket block, text bytes of a cluster block, rows of a task's batch of small buckets.
BLOCK_NODES = 1500
BLOCK_BYTES = 2 << 20
BATCH_ROWS = 20_000


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words is one shingle, without words none."""
    import xxhash

    words = (text or "").lower().encode().split()
    if not words:
        return np.empty(0, np.uint64)
    at: dict[bytes, int] = {}
    ids = np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, len(words))
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, at), np.uint64, len(at))[ids]
    n = max(1, len(words) - shingle + 1)
    key = np.full(n, len(words) if len(words) < shingle else shingle, np.uint64)
    for k in range(min(shingle, len(words))):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
        key ^= key >> np.uint64(29)
    return np.unique(key * np.uint64(0xBF58476D1CE4E5B9))


def signer(size: int = BANDS * ROWS, seed: int = 3):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, size, np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, size, np.uint64).astype(np.uint32)

    def sign(hashes: np.ndarray) -> bytes:
        """The low byte of each MinHash value, spread first."""
        low = ((hashes >> np.uint64(32)) ^ hashes).astype(np.uint32)
        least = np.full(size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 512):
            np.minimum(least, (low[i : i + 512, None] * a + b).min(axis=0), out=least)
        return ((least * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()

    return sign


def least_agreements(threshold: float, tolerance: float, size: int = BANDS * ROWS, step: int = STEP) -> list[int]:
    """For each number of compared values, the fewest agreements with which a pair stays.

    With a uniform prior the agreement rate r of n values, m agreeing, is Beta(m+1, n-m+1), and P(r >= t) = P(Bin(n+1, t) <= m).
    Bytes of unequal values agree once in 256, which raises t.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in [*range(step, size, step), size]:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(x: np.ndarray, others: np.ndarray, least: list[int], step: int = STEP) -> np.ndarray:
    """Which of the other signatures stay candidates of x, compared step by step."""
    left = np.arange(len(others))
    agreed = np.zeros(len(others), np.int64)
    for i, m in enumerate(least):
        part = slice(i * step, (i + 1) * step)
        agreed = agreed + (others[left, part] == x[part]).sum(axis=1)
        stay = agreed >= m
        left, agreed = left[stay], agreed[stay]
        if not len(left):
            break
    return left


class Forest:
    """Union-find over positions; keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def features(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, mark, node, n, sig, size) of every row; node, the hash of the shingle set, is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer()
        for batch in batches:
            nodes, sizes, sigs, lengths = [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), shingle)
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                sigs.append(sign(s) if len(s) else None)
                lengths.append(len(text.as_py() or ""))
            tidy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(lengths, pa.int64())], names=["id", "mark", "node", "n", "sig", "size"])

    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"), F.col(f"`{text_col}`").alias("text"))
    extra = T.StructType.fromDDL("node binary, n int, sig binary, size bigint").fields
    return own.mapInArrow(run, T.StructType([own.schema["id"], own.schema["mark"], *extra]))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def grid(df: DataFrame, blocks: str, key: list[str]) -> DataFrame:
    """Deals the rows of each key over its number of blocks, and copies them to every pair of blocks they belong to."""
    own = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    out = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return out.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop(blocks, "other")


def segments(group: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    """The slices of a batch that agree in all keys."""
    group = group.sort_by([(k, "ascending") for k in [*keys, "node"]])
    n = group.num_rows
    change = np.zeros(n, bool)
    for k in keys:
        col = np.asarray(group.column(k).to_pylist(), dtype=object if pa.types.is_binary(group.schema.field(k).type) else None)
        change[1:] |= col[1:] != col[:-1]
    at = [0, *np.flatnonzero(change).tolist(), n]
    for lo, hi in zip(at, at[1:], strict=False):
        if hi - lo > 1:
            yield group.slice(lo, hi - lo)


EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def candidate_edges(reps: DataFrame, threshold: float, tolerance: float, block_nodes: int) -> DataFrame:
    """Edges (a, b) that tie together every two nodes which share a band and survive the pruning."""
    least = least_agreements(threshold, tolerance)
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", (i * ROWS + 1).cast("int"), F.lit(ROWS))))
    in_bands = reps.select("node", F.explode(bands).alias("band"))
    shared = in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    members = grid(in_bands.join(shared, "band").withColumn("blocks", F.ceil(F.col("nodes") / block_nodes)).drop("nodes"), "blocks", ["band"])
    members = stored(members, "near-bands")
    tasks = max(partitions(reps), members.count() // BATCH_ROWS)
    members = members.join(reps.select("node", "n", "sig"), "node").withColumn("task", F.pmod(F.xxhash64("band", "i", "j"), F.lit(tasks)))

    def compare(group: pa.Table) -> pa.Table:
        a, b = [], []
        for part in segments(group, ["band", "i", "j"]):
            nodes = part.column("node").to_pylist()
            sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(len(nodes), -1)
            sizes = part.column("n").to_numpy()
            own, cross = part.column("own").to_numpy(), part.column("i")[0].as_py() != part.column("j")[0].as_py()
            forest = Forest(len(nodes))
            tree = np.arange(len(nodes))
            for x in range(len(nodes) - 1):
                later = np.arange(x + 1, len(nodes))
                fits = (sizes[later] >= threshold * sizes[x]) & (threshold * sizes[later] <= sizes[x]) & (tree[later] != tree[x])
                if cross:
                    fits &= own[later] != own[x]
                later = later[fits]
                if len(later):
                    for y in later[survivors(sigs[x], sigs[later], least)].tolist():
                        if tree[x] != tree[y]:
                            forest.join(x, y)
                            tree[tree == max(tree[x], tree[y])] = min(tree[x], tree[y])
            a += [nodes[x] for x, _ in forest.edges]
            b += [nodes[y] for _, y in forest.edges]
        tidy()
        return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=EDGES)

    return members.groupBy("task").applyInArrow(compare, "a binary, b binary")


def exact_links(docs: DataFrame, clustered: DataFrame, reps: DataFrame, *, id_col: str, text_col: str, shingle: int, threshold: float, tolerance: float, block_bytes: int) -> DataFrame:
    """(a, b, links): per node the documents it is linked to, as far as one task sees, and spanning edges (b set) of the links."""
    least = least_agreements(threshold, tolerance)
    known = clustered.join(reps, "node")
    blocks = known.groupBy("root").agg(F.ceil(F.sum("size") / F.lit(block_bytes)).alias("blocks"))
    known = grid(known.join(blocks, "root"), "blocks", ["root"])
    tasks = max(partitions(reps), (known.agg(F.sum("size")).first()[0] or 0) // (2 * block_bytes))
    known = known.select(F.col("rep").alias("id"), "node", "root", "own", "i", "j", "copies", "sig", F.pmod(F.xxhash64("root", "i", "j"), F.lit(tasks)).alias("task"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # A repeated id brings other texts too; those of another node are told by their shingles below.
    held = texts.join(known, F.struct(texts["id"]) == F.struct(known["id"])).drop("id")

    def verify(group: pa.Table) -> pa.Table:
        a, b, links = [], [], []
        for part in segments(group, ["root", "i", "j"]):
            nodes, sets, keep = [], [], []
            for r, (node, text) in enumerate(zip(part.column("node").to_pylist(), part.column("text"), strict=True)):
                if nodes and nodes[-1] == node:
                    continue
                s = shingle_set(text.as_py(), shingle)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == node:
                    nodes.append(node)
                    sets.append(s)
                    keep.append(r)
            part = part.take(keep)
            if len(nodes) < 2:
                continue
            sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(len(nodes), -1)
            own, cross = part.column("own").to_numpy(), part.column("i")[0].as_py() != part.column("j")[0].as_py()
            copies = part.column("copies").to_numpy()
            sizes = np.array([len(s) for s in sets])
            distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
            at = np.r_[0, np.cumsum(sizes)]
            ids = [ids[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]
            inside = np.zeros(len(distinct), np.int32)
            found, forest = np.zeros(len(nodes), np.int64), Forest(len(nodes))
            for x in range(len(nodes) - 1):
                later = np.arange(x + 1, len(nodes))
                fits = (sizes[later] >= threshold * sizes[x]) & (threshold * sizes[later] <= sizes[x])
                if cross:
                    fits &= own[later] != own[x]
                later = later[fits]
                if not len(later) or not len(later := later[survivors(sigs[x], sigs[later], least)]):
                    continue
                inside[ids[x]] = 1
                both = np.add.reduceat(inside[np.concatenate([ids[y] for y in later.tolist()])], np.r_[0, np.cumsum(sizes[later])[:-1]])
                inside[ids[x]] = 0
                linked = later[both >= threshold * (sizes[x] + sizes[later] - both) - 1e-9]
                found[x] += copies[linked].sum()
                found[linked] += copies[x]
                for y in linked.tolist():
                    forest.join(x, y)
            a += nodes + [nodes[x] for x, _ in forest.edges]
            b += [None] * len(nodes) + [nodes[y] for _, y in forest.edges]
            links += found.tolist() + [0] * len(forest.edges)
        tidy()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "links": pa.array(links, pa.int64())})

    return held.groupBy("task").applyInArrow(verify, "a binary, b binary, links bigint")


def classified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_nodes: int = BLOCK_NODES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, mark (hash of the text), root (of its class, null without words), class_id, n_links."""
    rows = stored(features(docs, id_col, text_col, shingle), "near-rows")
    worded = rows.where("node is not null")
    # One row a node: combined before the shuffle, so a group of copies of any size is no hot key.
    reps = stored(worded.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.max("size").alias("size")), "near-reps")
    clustered = components(candidate_edges(reps, threshold, tolerance, block_nodes))
    checked = stored(exact_links(docs, clustered, reps, id_col=id_col, text_col=text_col, shingle=shingle, threshold=threshold, tolerance=tolerance, block_bytes=block_bytes), "near-links")
    links = checked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(checked.where("b is not null").select("a", "b"))
    classes = reps.select("node", "rep", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = classes.join(least, "root").select("node", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = join_small(worded.select("id", "mark", "node"), classes, "node").select("id", "mark", "root", "class_id", "n_links")
    alone = rows.where("node is null").select("id", "mark", F.lit(None).cast("binary").alias("root"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return found.unionByName(alone)


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """Per row: id, class_id, n_links.

    Linked are documents whose sets of word shingles have a Jaccard similarity of ``threshold`` or more, letter case
    aside. ``n_links`` counts the other documents linked to this one, copies included; ``class_id`` is the least id
    among all documents that chains of links lead to (null ids last). A document without words (null, empty, blanks) is
    linked to nothing and a class of its own; repeated rows are copies of each other. An empty table gives an empty result.
    """
    return classified(docs, **options).select("id", "class_id", "n_links")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, that of the least id, all columns kept; documents without words all stay."""
    mark = lambda: F.xxhash64(F.col(f"`{text_col}`"))
    classes = classified(docs, id_col=id_col, text_col=text_col, **options).where("root is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("mark")))
    wanted = classes.groupBy("root").agg(first.alias("first")).select(F.struct("first.id", "first.mark").alias("__want"))
    blank = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(f"^{BLANKS[:-1]}*$")
    keyed = docs.where(~blank).withColumn("__key", F.struct(F.col(f"`{id_col}`").alias("id"), mark().alias("mark")))
    kept = keyed.join(wanted, F.col("__key") == F.col("__want"), "left_semi").dropDuplicates(["__key"]).drop("__key")
    return kept.unionByName(docs.where(blank))

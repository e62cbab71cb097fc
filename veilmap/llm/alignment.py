"""Cross-tokenizer alignment of byte-level BPE (A) and sentence-piece (B) tokens.

Per batch of documents the tokens of either side lie in one frame each, with their byte offsets. ``pandas.merge_asof``,
over bytes numbered through all documents, finds for each token start the other side's token that covers it; the union
of both directions gives all overlaps, and byte offsets where tokens of both sides end cut groups.

How often two ids overlap is counted over all documents. A chunk (a bounded batch of documents) sends each distinct pair
of ids once, with its number of links; the counts are one aggregation; each chunk gets those of its own pairs back. So
texts are encoded once and never shuffled: what travels are positions of pairs within a chunk.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PARTS, byte_table, ranks_of
from .common import slices, stored, tidy

#: Text bytes of a chunk. A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
SHIFT = 32


class Pair:
    """Both tokenizers, with the bytes of each id; made once in each Python worker."""

    def __init__(self, spec: str, model: bytes):
        self.spec, self.model, self.made = spec, model, None

    def __getstate__(self):
        return {"spec": self.spec, "model": self.model, "made": None}

    def left(self):
        """The encoder of A for a list of texts, special tokens' strings being plain text, and the bytes of each id."""
        ranks = ranks_of(self.spec)
        if ranks is not None:
            import tiktoken

            fast = tiktoken.Encoding("a", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
            table = [b""] * (max(ranks.values()) + 1)
            for data, i in ranks.items():
                table[i] = data
            return lambda texts: [fast.encode_ordinary(t) for t in texts], table
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(self.spec)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        table = byte_table(a.get_vocab(with_added_tokens=False), {i: t.content for i, t in a.get_added_tokens_decoder().items()})
        return lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)], table

    def get(self):
        if self.made is None:
            import sentencepiece

            a, a_bytes = self.left()
            b = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            b_bytes = []
            for i in range(b.get_piece_size()):
                piece = b.id_to_piece(i)
                b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
            spelled = np.array([f"{i}{mark}" for i in range(max(len(a_bytes), len(b_bytes))) for mark in (",", "|", ";", "")], object)
            self.made = a, b, a_bytes, b_bytes, spelled
        return self.made

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where the text is empty or a side's bytes differ from blank and text."""
        a, b, a_bytes, b_bytes, _ = self.get()
        left = a([" " + t for t in texts])
        right = b.encode(texts, num_threads=1)
        for i, t in enumerate(texts):
            want = b" " + t.encode()
            if not t or b"".join(map(a_bytes.__getitem__, left[i])) != want or b"".join(map(b_bytes.__getitem__, right[i])) != want:
                left[i], right[i] = [], []
        return left, right


def offsets(ids: list[list[int]], lengths: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids, document, start and end of each token; the bytes of the documents are numbered through."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if len(ids) else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(ids)), counts)
    size = lengths[flat]
    ends = np.cumsum(size)
    first = np.r_[0, ends][np.cumsum(counts) - counts]
    ends = ends - np.repeat(first - bases, counts)
    return flat, doc, ends - size, ends


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of all pairs of tokens whose byte ranges overlap, each once, by a and then b.

    Bytes are numbered through, so a place tells its document: the token before it, if of another one, ends before it.
    """
    a = pd.DataFrame({"at": start_a, "a": np.arange(len(start_a)), "a_end": end_a})
    b = pd.DataFrame({"at": start_b, "b": np.arange(len(start_b)), "b_end": end_b})
    into_b, into_a = pd.merge_asof(a, b, on="at"), pd.merge_asof(b, a, on="at")
    both = []
    for side, end in ((into_b, "b_end"), (into_a, "a_end")):
        covered = (side["at"] < side[end]).to_numpy()  # a start before the other side's first token has no end there
        both.append(side["a"].to_numpy()[covered].astype(np.int64) << SHIFT | side["b"].to_numpy()[covered].astype(np.int64))
    key = distinct(np.concatenate(both))
    return key >> SHIFT, key & ((1 << SHIFT) - 1)


class Aligned:
    """The tokens, groups and links of some documents."""

    def __init__(self, left: list[list[int]], right: list[list[int]], a_sizes: np.ndarray, b_sizes: np.ndarray, text_bytes: np.ndarray):
        self.docs = len(left)
        bases = np.cumsum(text_bytes + 1) - (text_bytes + 1)
        self.a, self.doc_a, start_a, end_a = offsets(left, a_sizes, bases)
        self.b, self.doc_b, start_b, end_b = offsets(right, b_sizes, bases)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        self.groups = np.bincount(np.searchsorted(np.cumsum(text_bytes + 1), cuts), minlength=self.docs)
        self.link_a, self.link_b = overlaps(start_a, end_a, start_b, end_b)
        self.link_doc = self.doc_a[self.link_a]
        self.pairs = self.a[self.link_a] << SHIFT | self.b[self.link_b]

    def per_doc(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=self.docs)

    def texts(self, spelled: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document; ``spelled`` has every id with each of the four marks that may follow."""
        na = len(self.a)
        # Within a group the tokens of A come before those of B.
        place = np.r_[2 * self.group_a, 2 * self.group_b + 1]
        order = np.argsort(place, kind="stable")
        doc, place = np.r_[self.doc_a, self.doc_b][order], place[order]
        last = np.r_[place[1:] != place[:-1], True]
        final = np.r_[doc[1:] != doc[:-1], True] if len(doc) else last[:0]
        mark = np.where(final[: len(doc)], 3, np.where(last[: len(doc)], 1 + place % 2, 0))
        ids = np.r_[self.a, self.b][order]
        parts = spelled[ids << 2 | mark].tolist()
        ends = np.cumsum(self.per_doc(doc)).tolist()
        return ["".join(parts[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)] if na or len(self.b) else [""] * self.docs


ROW = "chunk bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, keys array<bigint>, uses array<bigint>"
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def encoded(docs: DataFrame, pair: Pair, *, carry: list[str], text_col: str, chunk_bytes: int) -> DataFrame:
    """One row per document (links: positions in its chunk's keys), and after them one per chunk (keys, uses), whose links are null."""
    source = docs.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(carry)], F.col(f"`{text_col}`").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(pair)
    extra = T.StructType.fromDDL(ROW).fields
    kept = [T.StructField(f.name, f.dataType, True) for f in source.drop("text").schema.fields]
    schema = T.StructType([*kept, *extra])
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizers = held.value
        _, _, a_bytes, b_bytes, spelled = tokenizers.get()
        a_sizes, b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes))
        # Numbers within the written table: a task's output is committed once.
        chunk = TaskContext.get().partitionId() << SHIFT
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(width)), 0).to_numpy(zero_copy_only=False)
            for start, n in slices(batch, width, chunk_bytes):
                texts = [t or "" for t in batch.column(width).slice(start, n).to_pylist()]
                left, right = tokenizers.encode(texts)
                found = Aligned(left, right, a_sizes, b_sizes, sizes[start : start + n].astype(np.int64))
                keys, of = np.unique(found.pairs, return_inverse=True)
                cut = np.searchsorted(found.link_doc, np.arange(n + 1))
                of = of.astype(np.uint32)
                links = [zlib.compress(of[lo:hi].tobytes(), 1) for lo, hi in zip(cut, cut[1:], strict=False)]
                shas = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in found.texts(spelled)]
                numbers = [found.per_doc(found.doc_a), found.per_doc(found.doc_b), found.groups, found.per_doc(found.link_doc)]
                own = [pa.concat_arrays([batch.column(k).slice(start, n), pa.nulls(1, batch.column(k).type)]) for k in range(width)]
                listed = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array([chunk] * (n + 1), pa.int64()), *[pa.array([*x.tolist(), None], pa.int64()) for x in numbers], pa.array([*shas, None], pa.string()), pa.array([*links, None], pa.binary()),
                     pa.array([*repeat(None, n), keys], listed), pa.array([*repeat(None, n), np.bincount(of, minlength=len(keys))], listed)],
                    schema=names(batch, width),
                )
                chunk += 1
                tidy()

    def names(batch: pa.RecordBatch, width: int) -> pa.Schema:
        kinds = [("chunk", pa.int64()), *[(c, pa.int64()) for c in NAMES[:4]], ("groups_sha256", pa.string()), ("links", pa.binary()), ("keys", pa.list_(pa.int64())), ("uses", pa.list_(pa.int64()))]
        return pa.schema([*[pa.field(f"x{k}", batch.schema.field(k).type) for k in range(width)], *kinds])

    return source.mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(key, n, best): links of each pair of ids over all documents, and whether no other pair of its B id has more."""
    sent = rows.where("links is null").select(F.explode(F.arrays_zip("keys", "uses")).alias("p"))
    counts = sent.groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.uses").alias("n"))
    counts = stored(counts, "alignment-counts")
    b = F.col("key").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    # One row per B id, a vocabulary's size at most.
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, spec: str, model: bytes, *, text_col: str = "text", keep: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 to the kept columns.

    A is the byte-level tokenizer ``spec``, encoding a blank and the text, B the sentence-piece ``model``, encoding the
    text. Texts that are null or empty, or whose bytes a side does not give back, have zeros and ''. ``n_best`` counts
    links whose pair of ids has its B id's highest count over all documents (ties included), ``count_sum`` adds up the
    counts of the pairs of all links. Rows are independent, so repeated rows count each. Kept columns that bear one of
    the new names give way. An empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NAMES]
    rows = stored(encoded(docs, Pair(spec, model), carry=keep, text_col=text_col, chunk_bytes=chunk_bytes), "alignment")
    wanted = rows.where("links is null").select(F.col("chunk").alias("part"), F.explode("keys").alias("key"))
    back = wanted.join(pair_counts(rows), "key").select("part", "key", "n", "best")
    own = rows.where("links is not null").drop("keys", "uses")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    out = ", ".join([*[f"x{i} {fields[c]}" for i, c in enumerate(keep)], "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"])
    width = len(keep)

    def add(key: tuple, group: pa.Table, answer: pa.Table) -> pa.Table:
        answer = answer.sort_by("key")
        n, best = answer.column("n").to_numpy(), answer.column("best").to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for data in group.column("links"):
            at = np.frombuffer(zlib.decompress(data.as_py()), np.uint32)
            n_best.append(int(best[at].sum()) if len(at) else 0)
            total.append(int(n[at].sum()) if len(at) else 0)
        tidy()
        made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table([*[group.column(f"x{k}") for k in range(width)], *[made.get(c, group.column(c) if c in group.column_names else None) for c in NAMES]], names=[*[f"x{k}" for k in range(width)], *NAMES])

    got = own.groupBy("chunk").cogroup(back.groupBy("part")).applyInArrow(add, out)
    return got.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(keep)], *NAMES)


def read_model(name: str = "piece_bpe_32k.model", path: str | None = None) -> bytes:
    """The sentence-piece model, a fixed file, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()

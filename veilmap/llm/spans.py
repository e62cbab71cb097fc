"""Substring deduplication by an exchange of window hashes.

Documents lie in blocks of consecutive ids. Each string of ``window`` words is hashed, and a corpus-wide exchange tells for
every hash the first block in which it starts. A document's windows that start earlier, in another block or before in this
one, cover the words that go. Consecutive hits of one block are grouped to spans. This takes the place of a relative
Lempel-Ziv parse: no factor is extended greedily against a reference block, and none is matched longest-first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import running_sums
from . import blocks as B
from .common import tidy

WINDOW = 20


def consecutive_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """Adds ``block``: blocks of consecutive ids of about ``block_bytes``, a null id last. Rows of one id share a block."""
    sizes = docs.groupBy(F.col(id_col).alias("id")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).alias("size"))
    sizes = sizes.withColumn("last", F.col("id").isNull().cast("int"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    step = max(1, total // B.plan_blocks(docs, total, block_bytes))
    upto = running_sums(sizes, [], ["last", "id"], {"upto": "size"}, group_rows=0, at_most=1)
    firsts = upto.where("id is not null").groupBy(F.floor((F.col("upto") - F.col("size")) / step).alias("b")).agg(F.min("id").alias("id"))
    bounds = np.array(sorted(r.id for r in firsts.select("id").toLocalIterator()))[1:]  # one per block

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        out = np.full(len(ids), len(bounds), np.int32)
        known = ids.notna().to_numpy()
        if len(bounds) and known.any():
            out[known] = np.searchsorted(bounds, ids[known].to_numpy().astype(bounds.dtype), side="right")
        return pd.Series(out)

    return docs.withColumn("block", block_of(F.col(id_col))), total


def block_windows(group: pa.Table, window: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's documents in order; words of each; where windows start; their sorted distinct keys; the key of each window.

    Of equal windows of a block only the first can be new, so a window that is not its key's first is marked by -1 - key.
    """
    group = group.sort_by([("id", "ascending"), ("text", "ascending")])
    index, seqs = B.Index(), []
    for text in group.column("text"):
        seqs.append(index.numbers((text.as_py() or "").encode().split()))
    lengths = np.array([len(s) for s in seqs], np.int64)
    words = np.concatenate(seqs) if seqs else np.empty(0, np.int64)
    keys = B.window_hashes(index.hashes()[words] if len(words) else np.empty(0, np.uint64), window)
    ends = np.cumsum(lengths)
    starts = np.concatenate([np.arange(e - n, e - window + 1) for n, e in zip(lengths, ends, strict=True)]) if len(lengths) else np.empty(0, np.int64)
    unique, first, of = np.unique(keys[starts], return_index=True, return_inverse=True)
    later = np.ones(len(starts), bool)
    later[first] = False
    return group, lengths, starts, unique, np.where(later, -1 - of, of)


def factors(starts: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window of each factor and one past its last: consecutive windows found in the same reference block."""
    hit = source >= 0
    begin = hit & np.r_[True, ~hit[:-1] | (source[1:] != source[:-1]) | (starts[1:] != starts[:-1] + 1)] if len(hit) else hit
    end = hit & np.r_[begin[1:] | ~hit[1:], True] if len(hit) else hit
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def parse(docs: DataFrame, out_schema: str, finish, *, id_col: str, text_col: str, carry: list[str], window: int, block_bytes: int) -> DataFrame:
    """Runs the exchange; ``finish(documents, lengths, removed)`` makes each block's rows from a mask over all its words."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(carry)])
    blocked, total = consecutive_blocks(own, "id", "text", block_bytes)
    bits = B.bucket_bits(docs, total * 8 // 5)

    def send(key: tuple, group: pa.Table) -> pa.Table:
        block = key[0].as_py()
        return B.rows(B.PACKED_SCHEMA, B.packed(block, 0, block_windows(group, window)[3], bits))

    def first_block(key: tuple, group: pa.Table) -> pa.Table:
        blocks, sizes, keys, _ = B.unpack(group)
        held = np.repeat(np.array(blocks, np.int64), sizes)  # ascending, so that the first of equal keys is of the first block
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        source = held[first][of]
        return B.answers(key[0].as_py(), 0, blocks, sizes, np.where(source < held, source + 1, 0))

    def factor(key: tuple, group: pa.Table, back: pa.Table) -> pa.Table:
        block = key[0].as_py()
        group, lengths, starts, _, of = block_windows(group, window)
        found = B.answered(back, 0)
        later = of < 0
        source = found[np.where(later, -1 - of, of)] - 1 if len(of) else of
        source = np.where(later & (source < 0), block, source)  # an earlier place of this very block
        begin, end = factors(starts, source)
        change = np.zeros(int(lengths.sum()) + 1, np.int64)
        np.add.at(change, starts[begin], 1)
        np.add.at(change, starts[end - 1] + window, -1)
        tidy()
        return finish(group, lengths, np.cumsum(change[:-1]) > 0)

    sent = blocked.groupBy("block").applyInArrow(send, B.PACKED)
    back = sent.groupBy("bucket").applyInArrow(first_block, B.ANSWER)
    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(factor, out_schema)


def cut_words(text: str | None, removed: np.ndarray) -> bytes:
    words = (text or "").encode().split()
    if removed.any():
        words = [words[i] for i in np.flatnonzero(~removed)]
    return b" ".join(words)


def per_document(group: pa.Table, lengths: np.ndarray, removed: np.ndarray) -> Iterator[tuple[str | None, np.ndarray]]:
    at = 0
    for text, n in zip(group.column("text"), lengths, strict=True):
        yield text.as_py(), removed[at : at + n]
        at += n


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 of the kept words joined by one blank.

    A word goes if a window that covers it also starts earlier: in a smaller id, or before it in the same text. Rows of
    one id follow each other in the order of their texts, a null id comes last. Null and empty texts, and texts shorter
    than a window, lose nothing. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(group: pa.Table, lengths: np.ndarray, removed: np.ndarray) -> pa.Table:
        n_removed, kept = [], []
        for text, gone in per_document(group, lengths, removed):
            n_removed.append(int(gone.sum()))
            kept.append(hashlib.sha256(cut_words(text, gone)).hexdigest())
        return pa.table({"id": group.column("id"), "n_words": pa.array(lengths, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    out = f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    return parse(docs, out, finish, id_col=id_col, text_col=text_col, carry=[], window=window, block_bytes=block_bytes)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, window: int = WINDOW, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """``docs`` with duplicate spans cut out of the texts; all columns stay.

    A text that loses nothing stays as it is; of others the kept words are joined by one blank. A document that loses
    all its words goes. A column named by ``length_col`` gets the code points of the text where the text has changed.
    """
    carry = [c for c in docs.columns if c not in (id_col, text_col)]
    fields = {c: docs.schema[c].dataType.simpleString() for c in docs.columns}

    def finish(group: pa.Table, lengths: np.ndarray, removed: np.ndarray) -> pa.Table:
        texts, stays, changed = [], [], []
        for text, gone in per_document(group, lengths, removed):
            stays.append(not gone.all() or not len(gone))
            changed.append(bool(gone.any()))
            texts.append(cut_words(text, gone).decode() if changed[-1] else text)
        done = group.drop_columns(["block"]).set_column(1, "text", pa.array(texts, pa.string())).append_column("changed", pa.array(changed, pa.bool_()))
        return done.filter(pa.array(stays, pa.bool_()))

    out = ", ".join([f"id {fields[id_col]}", f"text {fields[text_col]}", *[f"x{i} {fields[c]}" for i, c in enumerate(carry)], "changed boolean"])
    got = parse(docs, out, finish, id_col=id_col, text_col=text_col, carry=carry, window=window, block_bytes=block_bytes)
    if length_col is not None:
        at = f"x{carry.index(length_col)}"
        got = got.withColumn(at, F.when(F.col("changed"), F.length("text").cast(fields[length_col])).otherwise(F.col(at)))
    names = {id_col: "id", text_col: "text"} | {c: f"x{i}" for i, c in enumerate(carry)}
    return got.select(*[F.col(names[c]).alias(c) for c in docs.columns])

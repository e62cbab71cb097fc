"""Corpus-wide look-ups by blocks of documents and buckets of keys.

Documents are dealt to blocks of bounded size. Each block sends every distinct 64-bit key it holds once, sorted and
packed by bucket (the key's leading bits); a bucket sees all blocks' copies of its keys, works out one answer per
copy, and sends the answers back packed in the same order. So no key is hot: the most common one is sent once a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Text bytes of a block, and packed keys of a bucket, that one task holds at a time.
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 6 << 20
PACKED = "bucket int, block int, kind int, keys binary, more binary"
ANSWER = "block int, kind int, bucket int, answer binary"
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads differences over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return x ^ (x >> np.uint64(32))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def plan_blocks(docs: DataFrame, size: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about ``block_bytes`` each; at least one a partition, so that small tables use the cluster too."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))


def bucket_bits(docs: DataFrame, key_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets, a power of two, of about ``bucket_bytes`` each. A block sends a row to each bucket, so that there are no
    more than 32 of them where the keys do not ask for more."""
    parts = min(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(2, max(parts, -(-key_bytes // bucket_bytes)) - 1).bit_length()


def packed(block: int, kind: int, keys: np.ndarray, bits: int, more: np.ndarray | None = None) -> Iterator[dict]:
    """A block's sorted distinct keys by bucket; ``more`` goes along with the keys."""
    if not len(keys):
        return
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    for lo, hi in zip(at, [*at[1:], len(keys)], strict=True):
        yield {"bucket": int(buckets[lo]), "block": block, "kind": kind, "keys": keys[lo:hi].tobytes(), "more": b"" if more is None else shrink(more[lo:hi])}


def rows(schema: pa.Schema, made: Iterable[dict]) -> pa.Table:
    """What a block or bucket sends; it is done with its own tables then."""
    out = pa.Table.from_pylist(list(made), schema=schema)
    tidy()
    return out


PACKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())])
ANSWER_SCHEMA = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())])


def shrink(x: np.ndarray) -> bytes:
    """Small non-negative numbers in as few bytes as they take."""
    top = int(x.max()) if len(x) else 0
    kind = b"1248"[(top >= 1 << 8) + (top >= 1 << 16) + (top >= 1 << 32)]
    return bytes([kind]) + zlib.compress(x.astype(f"<u{chr(kind)}").tobytes(), 1)


def grown(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{chr(data[0])}").astype(np.int64)


def unpack(group: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray | None]:
    """A bucket's rows in block order: blocks, sizes, keys, and what came along."""
    group = group.sort_by("block")
    parts = [np.frombuffer(k, np.uint64) for k in group.column("keys").to_pylist()]
    extra = [grown(m) for m in group.column("more").to_pylist() if m]
    sizes = np.array([len(p) for p in parts])
    return group.column("block").to_pylist(), sizes, np.concatenate(parts), np.concatenate(extra) if extra else None


def answers(bucket: int, kind: int, blocks: list[int], sizes: np.ndarray, answer: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    return rows(ANSWER_SCHEMA, ({"block": b, "kind": kind, "bucket": bucket, "answer": shrink(answer[e - n : e])} for b, n, e in zip(blocks, sizes, ends, strict=True)))


def answered(table: pa.Table, kind: int) -> np.ndarray:
    """A block's answers of one kind, in the order of its sorted keys."""
    own = [(b, a) for b, k, a in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "answer")), strict=True) if k == kind]
    return np.concatenate([grown(a) for _, a in sorted(own)]) if own else np.empty(0, np.int64)


class Index:
    """Numbers for the distinct words of a block, in order of first use, and a 64-bit hash of each."""

    def __init__(self):
        self.at: dict[bytes, int] = {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        at = self.at
        new = set(words).difference(at)
        at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh64_intdigest, self.at), np.uint64, len(self.at))


def window_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive symbols, by prefix sums of a polynomial modulo 2^64."""
    n = len(symbols)
    if n < width:
        return np.empty(0, np.uint64)
    powers = np.full(n, ODD, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * powers, dtype=np.uint64, out=sums[1:])
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    back = np.full(n - width + 1, inverse, np.uint64)
    back[0] = 1
    return mixed((sums[width:] - sums[:-width]) * np.cumprod(back, dtype=np.uint64))

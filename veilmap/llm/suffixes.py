"""Suffix-array deduplication of long byte strings.

Which strings of ``length`` bytes start more than once anywhere? Every such window holds an anchor, the part of half
its length with the least hash; equal windows have equal anchors. Anchors are counted over the whole corpus by the
exchange of ``blocks``. Where an anchor occurs more than once, the run of windows around it, its region, goes to the
shard of the anchor. A shard removes doubles of whole regions, builds the suffix array of what is left by
Larsson-Sadakane refinement, takes common prefixes as Kasai does, and marks every window that shares ``length`` bytes
with its neighbour. The windows of an anchor too frequent for one shard are dealt over all shards by their digests and counted
there. Shards are not merged with each other. Marks go back to the blocks, which cut the bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import tidy

LENGTH = 200
#: Occurrences from which on an anchor's windows are dealt by digest.
FREQUENT = 3_000
SHARD_BYTES = 2 << 20
CHUNK = 1 << 20
SENT = "shard int, block int, kind int, keys binary, sizes binary, data binary"
SENT_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])


def byte_symbols(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64)


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values, by doubling."""
    take, done = (np.minimum if least else np.maximum), 1
    while done < width:
        step = min(done, width - done)
        x = take(x[:-step], x[step:])
        done += step
    return x


# ---------------------------------------------------------------- suffix arrays


def packed8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, first byte first, zeros past the end."""
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order: places of equal rank are refined by the rank h further on, h doubling."""
    n = len(text)
    first = packed8(text)
    sa = np.argsort(first, kind="stable")
    heads = np.r_[True, first[sa][1:] != first[sa][:-1]] if n else np.zeros(0, bool)
    del first
    sa = sa.astype(np.int32)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(heads, np.arange(n, dtype=np.int32), 0))
    active = np.flatnonzero(~(heads & np.r_[heads[1:], True])) if n else np.zeros(0, np.int64)
    h = 8
    while len(active):
        places = sa[active]
        key = rank[places].astype(np.int64) * (n + 2) + rank[np.minimum(places.astype(np.int64) + h, n)] + 1
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        sa[active] = places
        new = np.r_[True, key[1:] != key[:-1]]
        # Ranks change only after all keys of this round are read.
        rank[places] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        active = active[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa


def same_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading bytes, 0 to 8, that two packed numbers share."""
    differ = x ^ y
    top = (differ == 0).view(np.uint8)
    for k in range(1, 8):
        top += (differ < np.uint64(1 << (64 - 8 * k))).view(np.uint8)
    return top


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 16384) -> np.ndarray:
    """For each place, the bytes (up to ``cap``) it shares with the place before it in the suffix array.

    Kasai: going on by one place loses at most one shared byte, so that comparison goes on where it stopped. The text is
    walked in many lanes at once, and eight bytes are compared at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    eight = np.r_[packed8(text), np.zeros(cap + 8, np.uint64)]
    out = np.zeros(n, np.int32)
    lanes = max(1, min(lanes, 2 * n // cap or 1))
    width = -(-n // lanes)
    base = np.arange(lanes) * width
    shared = np.zeros(lanes, np.int64)
    for t in range(width):
        p = base + t
        p = p[: np.searchsorted(p, n)]
        q = before[p].astype(np.int64)
        h = np.maximum(shared[: len(p)] - 1, 0)
        more = same_bytes(eight[p + h], eight[q + h])
        h += more
        go = np.flatnonzero((more == 8) & (h < cap))
        while len(go):
            more = same_bytes(eight[p[go] + h[go]], eight[q[go] + h[go]])
            h[go] += more
            go = go[(more == 8) & (h[go] < cap)]
        # Zeros past the end may have been taken for bytes of the text. The first of all suffixes shares nothing.
        h = np.minimum(h, np.minimum(cap, n - np.maximum(p, q)))
        h[q < 0] = 0
        shared[: len(p)] = out[p] = h
    return out


def repeated_windows(regions: list[bytes], length: int) -> list[np.ndarray]:
    """For each region, which of its windows start elsewhere in these regions too."""
    text = np.frombuffer(b"\xff".join(regions) + b"\xff", np.uint8)  # 255 occurs in no UTF-8 text, so no window spans it
    sa = suffix_array(text)
    shared = common_prefixes(text, sa, length)
    hit = np.zeros(len(text), bool)
    later = shared[sa] >= length
    hit[sa[later]] = True
    hit[sa[:-1][later[1:]]] = True
    out, at = [], 0
    for r in regions:
        out.append(hit[at : at + len(r) - length + 1])
        at += len(r) + 1
    return out


# ---------------------------------------------------------------- blocks


class Anchored:
    """The bytes of a block's documents and, per window inside a document, the hash of its anchor (0: no window)."""

    def __init__(self, texts: list[str | None], length: int):
        self.length, self.half = length, length // 2
        parts = [(t or "").encode() for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        n = max(0, len(self.bytes) - length + 1)
        inside = np.zeros(n + 1, np.int64)
        for e, s in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            if s >= length:
                inside[e - s] += 1
                if e - length + 1 <= n:
                    inside[e - length + 1] -= 1
        self.inside = np.cumsum(inside[:n]) > 0
        self.anchor = np.zeros(n, np.uint64)
        chosen = []
        span, table = length - self.half + 1, byte_symbols(1)
        for lo in range(0, n, CHUNK):
            hi = min(n, lo + CHUNK)
            h = B.window_hashes(table[self.bytes[lo : hi + length - 1]], self.half)
            least = sliding(h, span, True)
            self.anchor[lo:hi] = np.where(self.inside[lo:hi], least, np.uint64(0))
            # Places that are the anchor of some window of this chunk.
            top = sliding(np.r_[np.zeros(span - 1, np.uint64), self.anchor[lo:hi], np.zeros(span - 1, np.uint64)], span, False)
            mine = np.flatnonzero((h == top) & (h > 0))
            chosen.append((lo + mine, h[mine]))
        places = np.concatenate([c[0] for c in chosen]) if chosen else np.zeros(0, np.int64)
        values = np.concatenate([c[1] for c in chosen]) if chosen else np.zeros(0, np.uint64)
        _, once = np.unique(places, return_index=True)  # chunks overlap by a window
        # The least of many hashes are small numbers; spread again, they fill buckets and shards evenly.
        self.anchor = np.where(self.inside, B.mixed(self.anchor), np.uint64(0))
        self.keys, self.counts = np.unique(B.mixed(values[once]), return_counts=True)

    def runs(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows of one repeated anchor: first, one past the last, anchor, its corpus-wide count."""
        a = self.anchor
        if not len(a):
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(0, np.uint64), empty
        # A run ends with its document, too.
        change = np.r_[True, (a[1:] != a[:-1]) | ~self.inside[1:]]
        first = np.flatnonzero(change)
        last = np.r_[first[1:], len(a)]
        own = self.inside[first]
        first, last = first[own], last[own]
        keys = a[first]
        count = totals[np.searchsorted(self.keys, keys)] if len(keys) else np.zeros(0, np.int64)
        stay = count > 1
        return first[stay], last[stay], keys[stay], count[stay]

    def sent(self, totals: np.ndarray, bits: int, frequent: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], list[tuple[int, np.ndarray, np.ndarray]]]:
        """What goes to the shards, the same whenever it is worked out.

        Regions: (shard, firsts, lasts, keys). Digests of windows of frequent anchors: (shard, places, digests).
        """
        first, last, keys, count = self.runs(totals)
        few = count <= frequent
        regions, digests = [], []
        shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
        order = np.flatnonzero(few)[np.argsort(shard[few], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            regions.append((int(shard[part[0]]), first[part], last[part], keys[part]))
        many = np.flatnonzero(~few)
        if len(many):
            places = np.concatenate([np.arange(first[i], last[i]) for i in many])
            one, two = byte_symbols(2), byte_symbols(3)
            pairs = np.empty((len(places), 2), np.uint64)
            at = 0
            for i in many:
                part = self.bytes[first[i] : last[i] + self.length - 1]
                n = last[i] - first[i]
                pairs[at : at + n, 0] = B.window_hashes(one[part], self.length)
                pairs[at : at + n, 1] = B.window_hashes(two[part], self.length)
                at += n
            order = np.lexsort((places, pairs[:, 1], pairs[:, 0]))
            places, pairs = places[order], pairs[order]
            shard = (pairs[:, 0] >> np.uint64(64 - bits)).astype(np.int64)
            for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(shard)) + 1):
                digests.append((int(shard[part[0]]), places[part], pairs[part]))
        return regions, digests


def marks(hits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(hits).tobytes(), 1)


def unmarked(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool)


def shard_regions(rows: list[dict], length: int) -> list[np.ndarray]:
    """Per row (one block's regions), which windows are repeated, all regions of the row in line."""
    held = []  # (anchor, region) by row
    for r in rows:
        data, at, own = zlib.decompress(r["data"]), 0, []
        for key, n in zip(np.frombuffer(r["keys"], np.uint64).tolist(), B.grown(r["sizes"]).tolist(), strict=True):
            own.append((key, data[at : at + n]))
            at += n
        held.append(own)
    times = Counter(x for own in held for x in own)
    open_anchors = {key for (key, _), n in times.items() if n == 1}
    compared = sorted(x for x in times if x[0] in open_anchors)
    found = dict(zip(compared, repeated_windows([x[1] for x in compared], length), strict=True)) if compared else {}
    out = []
    for own in held:
        hits = [found[x] if times[x] == 1 else np.ones(len(x[1]) - length + 1, bool) for x in own]
        out.append(np.concatenate(hits))
    return out


def shard_digests(rows: list[dict]) -> list[np.ndarray]:
    """Per row (one block's sorted digests), which occur again in it or in another row: each list is looked up in the merged one."""
    lists = [np.frombuffer(r["data"], np.uint64).reshape(-1, 2) for r in rows]
    merged = np.concatenate(lists)
    merged = merged[np.lexsort((merged[:, 1], merged[:, 0]))]
    heads = np.flatnonzero(np.r_[True, (merged[1:] != merged[:-1]).any(axis=1)])
    times = np.repeat(np.diff(np.r_[heads, len(merged)]), np.diff(np.r_[heads, len(merged)]))
    out = []
    for x in lists:
        at = np.searchsorted(merged[:, 0], x[:, 0], "left")
        while len(off := np.flatnonzero(merged[at, 1] != x[:, 1])):  # first halves that agree by chance
            at[off] += 1
        out.append(times[at] > 1)
    return out


def in_order(group: pa.Table) -> pa.Table:
    """A block's documents by id and text. Every read of an exchange may bring its rows in another order, and marks come back by place."""
    return group.sort_by([("id", "ascending"), ("text", "ascending")])


def cut(docs: DataFrame, out_schema: str, finish, *, id_col: str, text_col: str, length: int, frequent: int, block_bytes: int, shard_bytes: int) -> DataFrame:
    """Runs the exchanges; ``finish(documents, block, removed)`` makes each block's rows from a mask over all its bytes."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = B.text_bytes(own, "text")
    n_blocks = B.plan_blocks(docs, size, block_bytes)
    bits, shard_bits = B.bucket_bits(docs, size // 5), B.bucket_bits(docs, size, shard_bytes)
    blocked = own.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int"))

    def send_anchors(key: tuple, group: pa.Table) -> pa.Table:
        block = Anchored(group.column("text").to_pylist(), length)
        return B.rows(B.PACKED_SCHEMA, B.packed(key[0].as_py(), 0, block.keys, bits, block.counts))

    def count_anchors(key: tuple, group: pa.Table) -> pa.Table:
        blocks, sizes, keys, counts = B.unpack(group)
        _, of = np.unique(keys, return_inverse=True)
        return B.answers(key[0].as_py(), 0, blocks, sizes, np.bincount(of, counts).astype(np.int64)[of])

    def send_regions(key: tuple, group: pa.Table, back: pa.Table) -> pa.Table:
        number, block = key[0].as_py(), Anchored(in_order(group).column("text").to_pylist(), length)
        regions, digests = block.sent(B.answered(back, 0), shard_bits, frequent)
        data = block.bytes.tobytes()
        made = []
        for shard, first, last, keys in regions:
            texts = [data[a : b + length - 1] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            made.append({"shard": shard, "block": number, "kind": 1, "keys": keys.tobytes(), "sizes": B.shrink(last - first + length - 1), "data": zlib.compress(b"".join(texts), 1)})
        for shard, _, pairs in digests:
            made.append({"shard": shard, "block": number, "kind": 2, "keys": b"", "sizes": b"", "data": pairs.tobytes()})
        return B.rows(SENT_SCHEMA, made)

    def mark(key: tuple, group: pa.Table) -> pa.Table:
        shard, made = key[0].as_py(), []
        rows = group.sort_by("block").to_pylist()
        for kind, work in ((1, lambda r: shard_regions(r, length)), (2, shard_digests)):
            own = [r for r in rows if r["kind"] == kind]
            for r, hits in zip(own, work(own) if own else [], strict=True):
                made.append({"block": r["block"], "kind": kind, "bucket": shard, "answer": marks(hits)})
        del rows
        return B.rows(B.ANSWER_SCHEMA, made)

    def remove(key: tuple, group: pa.Table, back: pa.Table) -> pa.Table:
        group = in_order(group)
        block = Anchored(group.column("text").to_pylist(), length)
        regions, digests = block.sent(B.answered(back, 0), shard_bits, frequent)
        found = {(r["kind"], r["bucket"]): r["answer"] for r in back.filter(pa.compute.greater(back.column("kind"), 0)).to_pylist()}
        hit = np.zeros(len(block.anchor), bool)
        for shard, first, last, _ in regions:
            places = np.repeat(first - np.r_[0, np.cumsum(last - first)[:-1]], last - first) + np.arange(int((last - first).sum()))
            hit[places] = unmarked(found[1, shard], len(places))
        for shard, places, _ in digests:
            hit[places] = unmarked(found[2, shard], len(places))
        change = np.zeros(len(block.bytes) + 1, np.int32)
        starts = np.flatnonzero(hit)
        change[starts] += 1
        change[starts + length] -= 1
        tidy()
        return finish(group, block, np.cumsum(change[:-1]) > 0)

    counted = blocked.groupBy("block").applyInArrow(send_anchors, B.PACKED).groupBy("bucket").applyInArrow(count_anchors, B.ANSWER)
    sent = blocked.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(send_regions, SENT)
    marked = sent.groupBy("shard").applyInArrow(mark, B.ANSWER)
    return blocked.groupBy("block").cogroup(counted.unionByName(marked).groupBy("block")).applyInArrow(remove, out_schema)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, frequent: int = FREQUENT, block_bytes: int = B.BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this text or another;
    matches do not cross documents, and strings are judged on the input. Null and empty texts, and texts shorter than
    ``length``, lose nothing; repeated rows lose everything that is long enough. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(group: pa.Table, block: Anchored, removed: np.ndarray) -> pa.Table:
        n_removed, n_spans, kept = [], [], []
        for end, n in zip(block.ends.tolist(), block.sizes.tolist(), strict=True):
            gone, data = removed[end - n : end], block.bytes[end - n : end]
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            kept.append(hashlib.sha256((data[~gone] if n_removed[-1] else data).tobytes()).hexdigest())
        return pa.table({"id": group.column("id"), "n_bytes": block.sizes, "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    out = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return cut(docs, out, finish, id_col=id_col, text_col=text_col, length=length, frequent=frequent, block_bytes=block_bytes, shard_bytes=shard_bytes)

"""Substring deduplication by words and by bytes, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from veilmap.llm import blocks, spans, suffixes


def order(row):
    return (row[0] is None, row[0] or 0, row[1] is None, row[1] or "")


def word_mask(rows, width):
    seen, out = set(), []
    for r in sorted(rows, key=order):
        w = (r[1] or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone[i : i + width] = True
            seen.add(key)
        out.append((r, w, gone))
    return out


@pytest.mark.parametrize("width,block_bytes", [(20, 1 << 20), (3, 400)])
def test_word_windows(awkward, width, block_bytes):
    docs, rows = awkward
    got = Counter(tuple(r) for r in spans.digests(docs, window=width, block_bytes=block_bytes).collect())
    want = Counter((r[0], len(w), int(g.sum()), hashlib.sha256(b" ".join(x for x, z in zip(w, g) if not z)).hexdigest()) for r, w, g in word_mask(rows, width))
    assert got == want


def test_texts_are_cut_and_columns_stay(awkward):
    docs, rows = awkward
    got = spans.without_repeats(docs, window=5, length_col="n_chars")
    assert got.columns == docs.columns
    want = Counter()
    for r, w, g in word_mask(rows, 5):
        if len(w) and g.all():
            continue
        text = b" ".join(x for x, z in zip(w, g) if not z).decode() if g.any() else r[1]
        want[(r[0], text, *r[2:4], len(text) if g.any() else r[4], *r[5:])] += 1
    assert Counter(tuple(r) for r in got.collect()) == want
    assert spans.digests(docs.limit(0)).count() == spans.without_repeats(docs.limit(0)).count() == 0


def byte_result(rows, length):
    times = Counter(b[i : i + length] for r in rows for b in [(r[1] or "").encode()] for i in range(len(b) - length + 1))
    out = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        n_spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[(r[0], len(b), sum(gone), n_spans, hashlib.sha256(bytes(x for x, z in zip(b, gone) if not z)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length,frequent,block_bytes", [(200, 20_000, 1 << 20), (40, 20_000, 700), (40, 3, 700)])
def test_byte_strings(awkward, length, frequent, block_bytes):
    docs, rows = awkward
    got = suffixes.digests(docs, length=length, frequent=frequent, block_bytes=block_bytes, shard_bytes=3000).collect()
    assert Counter(tuple(r) for r in got) == byte_result(rows, length)
    assert suffixes.digests(docs.limit(0)).count() == 0


def test_byte_strings_of_rows_that_come_in_another_order_each_time(spark, awkward):
    _, rows = awkward

    def turned(batches):
        import random

        import pyarrow as pa

        for batch in batches:
            order = list(range(batch.num_rows))
            random.shuffle(order)
            yield batch.take(pa.array(order))

    kinds = "doc_id long, text string"
    docs = spark.createDataFrame([r[:2] for r in rows], kinds).coalesce(1).mapInArrow(turned, kinds)
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")  # each use of the documents reads them anew
    try:
        got = suffixes.digests(docs, length=40, shard_bytes=3000).collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    assert Counter(tuple(r) for r in got) == byte_result(rows, 40)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(4)
    for n, letters in ((1, 1), (40, 1), (300, 2), (2000, 4), (500, 150)):
        text = rng.integers(1, 1 + letters, n).astype(np.uint8)
        for t in (text, np.tile(text[: max(1, n // 4)], 4)):
            sa, data = suffixes.suffix_array(t), t.tobytes()
            assert [data[i:] for i in sa] == sorted(data[i:] for i in range(len(data)))
            for cap, lanes in ((9, 1), (64, 40)):
                shared = suffixes.common_prefixes(t, sa, cap, lanes)
                for a, b in zip(sa, sa[1:]):
                    k = 0
                    while k < cap and max(a, b) + k < len(data) and data[a + k] == data[b + k]:
                        k += 1
                    assert shared[b] == k


def test_common_prefixes_take_few_steps(monkeypatch):
    calls = []

    def counted(x, y, same=suffixes.same_bytes):
        calls.append(len(x))
        return same(x, y)

    monkeypatch.setattr(suffixes, "same_bytes", counted)
    text = np.random.default_rng(6).integers(1, 90, 100_000).astype(np.uint8)
    text = np.r_[text, text[50_000:], np.uint8(255)]
    sa = suffixes.suffix_array(text)
    shared = suffixes.common_prefixes(text, sa, 200)
    assert (shared == 200).sum() >= 49_000 and shared.max() == 200
    assert len(calls) < 4000 and sum(calls) < 5 * len(text)


def test_window_hashes_follow_content():
    x = np.random.default_rng(1).integers(0, 4, 3000).astype(np.uint64)
    h = blocks.window_hashes(x, 6)
    groups = {}
    for i, v in enumerate(h):
        groups.setdefault(tuple(x[i : i + 6]), set()).add(int(v))
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_small_numbers_survive_packing():
    for x in ([], [0, 255], [256], [1 << 40, 3]):
        assert blocks.grown(blocks.shrink(np.array(x, np.int64))).tolist() == x

"""The index of stored keys: what it opens, repeated batches, merged generations."""

import numpy as np
from pyspark.sql import functions as F

from veilmap.sources import key_index as K
from veilmap.streaming import evidence as X


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


def test_filters_miss_no_key():
    rng = np.random.default_rng(2)
    held, other = rng.integers(-(1 << 63), 1 << 63, (2, 20_000))
    bits = K.filter_of(held)
    assert len(bits) == 30_000 and K.may_hold(bits, held).all() and K.may_hold(bits, other).mean() < 0.01
    assert not K.may_hold(K.filter_of(held[:0]), other).any()


def test_new_keys_open_little_and_old_keys_are_found(spark, tmp_path):
    index = K.KeyIndex(str(tmp_path / "k"), ["id"], buckets=8, merge_every=2)
    assert index.unseen(ids(spark, [1])).count() == 1
    opened, folders = [], []
    for batch in range(6):
        keys = ids(spark, range(batch * 50, batch * 50 + 50))
        opened.append(len(index.suspects(keys, batch)))
        folders.append(8 * len(index.generations(spark, batch)))
        assert index.unseen(keys, batch).count() == 50
        index.add(keys, batch)
    assert sum(opened) <= 0.25 * sum(folders)
    assert index.generations(spark) == [(1, 4, 5), (2, 0, 3)]
    seen = index.unseen(ids(spark, [0, 0, 299, 300, 700, 700, 133]))
    assert sorted(r.id for r in seen.collect()) == [300, 700, 700]
    # One known key opens its own bucket of its own generation, and hardly any other.
    assert len(index.suspects(ids(spark, [4]))) == 1
    # Before batch 3 only the keys of batches 0 to 2 count, whatever has been merged since.
    assert sorted(r.id for r in index.unseen(ids(spark, [149, 150, 10]), 3).collect()) == [150]


def test_repeated_batches_nulls_and_empty_ones(spark, tmp_path):
    index = K.KeyIndex(str(tmp_path / "k"), ["id", "s"], buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "id bigint, s string, extra int")
    index.add(rows((1, "a", 0), (None, None, 0)), 0)
    index.add(rows((1, "a", 0), (None, None, 0)), 0)
    index.add(rows().limit(0), 1)
    assert index.generations(spark) == [(0, 0, 0)]
    left = index.unseen(rows((1, "a", 5), (None, None, 6), (None, "a", 7), (1, None, 8)))
    assert left.columns == ["id", "s", "extra"] and sorted(r.extra for r in left.collect()) == [7, 8]
    assert index.unseen(rows().limit(0)).count() == 0


def test_sink_over_batches_and_a_table_without_an_index(spark, tmp_path):
    base = str(tmp_path)
    for i in range(6):
        ids(spark, [i, i + 1, i + 1, 0]).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    index = K.KeyIndex(f"{base}/index", ["id"], buckets=4, merge_every=2)
    X.run_available(X.append_once(stream, f"{base}/out", f"{base}/cp", ["id"], index=index))
    out = spark.read.parquet(f"{base}/out")
    assert sorted(r.id for r in out.collect()) == list(range(7)) and out.select("batch").distinct().count() > 1
    # The index is lost: it is made anew from the table.
    ids(spark, [3, 99]).coalesce(1).write.mode("append").parquet(f"{base}/in")
    X.run_available(X.append_once(stream, f"{base}/out", f"{base}/cp", ["id"], index=K.KeyIndex(f"{base}/other", ["id"])))
    assert sorted(r.id for r in spark.read.parquet(f"{base}/out").collect()) == [*range(7), 99]
    assert spark.read.parquet(f"{base}/out").where(F.col("id") == 3).count() == 1

"""SQL table functions against the native forms, and the join of a stream with a large table."""

import pytest
from pyspark.sql import functions as F

from veilmap.functions import table_functions
from veilmap.operators import lattice as L
from veilmap.operators import masks as M
from veilmap.streaming import evidence as X


@pytest.fixture
def sql(spark):
    table_functions.register(spark)
    return spark.sql


def test_subset_masks_equal_the_native_ones(spark, sql):
    subjects = spark.range(0, 12).select(F.col("id").alias("subject_id"), F.col("id").cast("int").alias("m"))
    got = sql("SELECT s.subject_id, u.mask FROM {s} s, LATERAL subset_masks(s.m, 6) u", s=subjects).collect()
    want = L.expand_subsets(subjects).select("subject_id", "mask").collect()
    assert sorted(got) == sorted(want)
    assert [r["mask"] for r in sql("SELECT * FROM subset_masks(3, 6) ORDER BY position").collect()] == [1, 2, 4, 3, 5, 6, 7]
    assert sql("SELECT * FROM subset_masks(CAST(NULL AS INT), 6)").count() == 0
    with pytest.raises(Exception, match="whole number"):
        sql("SELECT * FROM subset_masks('three', 6)").collect()
    with pytest.raises(Exception, match="do not fit"):
        sql("SELECT * FROM subset_masks(63, 6)").collect()


def test_mask_rows_equal_the_native_ones(spark, sql):
    rows = [(1, [0, 4], 2, 2), (2, [3, 2, 1, 9, 0, 50], 4, 5), (3, [20], 4, 5), (4, [], 4, 5), (5, [19, 5], 4, 5), (6, [1, 0, 2, 1], 1, 4)]
    masks = spark.createDataFrame(rows, "subject_id int, counts array<int>, h int, w int").withColumns({"cue_idx": F.lit(0), "inst_idx": F.lit(0)})
    got = sql("SELECT k.subject_id, u.y, u.x1, u.x2 FROM {k} k, LATERAL mask_rows(k.counts, k.h, k.w) u", k=masks).collect()
    want = M.split_rows(M.decode(masks)).select("subject_id", "y", "x1", "x2").collect()
    assert sorted(got) == sorted(want) and len(got) > 5
    assert sql("SELECT * FROM mask_rows(array(0, CAST(NULL AS INT)), 1, 1)").count() == 0


def test_static_join_is_the_same_with_salt(spark):
    left = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(left.join(right, "k").select("id", "k", "v").collect())
    for limit in (100, 5):
        got = X.join_static(left, right, ["k"], spread_by=["id"], max_rows=limit)
        assert sorted(got.select("id", "k", "v").collect()) == want

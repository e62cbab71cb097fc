"""Index of the keys that a growing table already holds.

Keys are dealt to a fixed number of buckets by hash. Each batch of keys is one generation: its keys in bucket folders, and a
Bloom filter per bucket. A look-up reads the filters, opens only the (generation, bucket) folders that may hold one of its
keys, and compares the keys themselves there, so that a wrong hit of a filter costs a read and never a result. When
``merge_every`` generations have gathered, they become one of the next tier; a key is rewritten once a tier, and the number of
generations grows with the logarithm of the batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import read_if_there

BITS_PER_KEY = 12
PROBES = 6  # bits set per key: some 0.4 % wrong hits at 12 bits a key
FILTER = "gen string, bucket int, n bigint, bits binary"


def positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key in a filter of ``size`` bits, from the two halves of its hash."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * high[:, None]) % np.uint64(size)).astype(np.int64)


def filter_of(hashes: np.ndarray) -> bytes:
    size = max(64, -(-len(hashes) * BITS_PER_KEY // 8) * 8)
    bits = np.zeros(size, bool)
    bits[positions(hashes, size).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; False is certain."""
    packed = np.frombuffer(bits, np.uint8)
    at = positions(hashes, len(packed) * 8)
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


class KeyIndex:
    """Keys in ``path``. ``buckets`` is fixed by the first batch: choose it so that a bucket's keys fit a task.

    A batch is named by an integer; adding it again replaces it, so a repeated micro-batch does no harm. Batches come in
    ascending order, by one writer. Null key values are equal to each other. Folders of merged generations stay, for a batch
    that is repeated after them; they may be removed once that cannot happen any more.
    """

    def __init__(self, path: str, on: Sequence[str], *, buckets: int = 64, merge_every: int = 8):
        self.path, self.on, self.buckets, self.merge_every = path.rstrip("/"), list(on), buckets, merge_every

    # A generation t<tier>_<a>_<b> holds the batches a to b.
    def _folder(self, gen: str) -> str:
        return f"{self.path}/keys/gen={gen}"

    def _hash(self) -> Column:
        return F.xxhash64(*self.on)

    def _bucket(self, hashed: Column) -> Column:
        return F.pmod(F.shiftrightunsigned(hashed, 40), F.lit(self.buckets)).cast("int")

    def generations(self, spark: SparkSession, before: int | None = None) -> list[tuple[int, int, int]]:
        """(tier, first batch, last batch) of the generations that count, of batches below ``before``.

        The filters of a generation are written after its keys, so a generation without them was never finished. One whose
        batches lie within a higher tier's has been merged.
        """
        filters = read_if_there(spark, f"{self.path}/filters")
        names = [] if filters is None else [r.gen for r in filters.select("gen").distinct().collect()]  # from folder names
        all_of = sorted(tuple(int(x) for x in n[1:].split("_")) for n in names)
        usable = [g for g in all_of if before is None or g[2] < before]
        return [g for g in usable if not any(o[0] > g[0] and o[1] <= g[1] and g[2] <= o[2] for o in usable)]

    @staticmethod
    def _name(gen: tuple[int, int, int]) -> str:
        return "t" + "_".join(map(str, gen))

    def _write(self, keys: DataFrame, gen: str) -> None:
        """The keys of a generation by bucket, then a filter of each bucket."""
        hashed = keys.select(*self.on).distinct().withColumn("__h", self._hash()).withColumn("bucket", self._bucket(F.col("__h")))
        hashed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(gen))
        spark = keys.sparkSession
        done = read_if_there(spark, self._folder(gen))

        def build(key: tuple, group: pa.Table) -> pa.Table:
            hashes = group.column("__h").to_numpy()
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(hashes)], pa.int64()), "bits": pa.array([filter_of(hashes)], pa.binary())})

        made = spark.createDataFrame([], "bucket int, n bigint, bits binary") if done is None or "bucket" not in done.columns else done.select("bucket", "__h").groupBy("bucket").applyInArrow(build, "bucket int, n bigint, bits binary")
        made.write.mode("overwrite").parquet(f"{self.path}/filters/gen={gen}")

    def add(self, keys: DataFrame, batch: int) -> None:
        """Adds the keys of a batch, each of which may be new or not; then merges full tiers."""
        spark = keys.sparkSession
        self._write(keys, self._name((0, batch, batch)))
        tier = 0
        while True:
            same = [g for g in self.generations(spark, batch + 1) if g[0] == tier]
            if len(same) < self.merge_every:
                return
            merged = (tier + 1, same[0][1], same[-1][2])
            parts = [read_if_there(spark, self._folder(self._name(g))) for g in same]
            parts = [p.select(*self.on) for p in parts if p is not None]
            if not parts:
                return
            union = parts[0]
            for p in parts[1:]:
                union = union.unionByName(p)
            self._write(union, self._name(merged))
            tier += 1

    def suspects(self, keys: DataFrame, before: int | None = None) -> list[tuple[str, int]]:
        """(generation, bucket) pairs that may hold one of the keys; at most generations times buckets."""
        spark = keys.sparkSession
        names = [self._name(g) for g in self.generations(spark, before)]
        if not names:
            return []
        filters = spark.read.schema(FILTER).parquet(f"{self.path}/filters").where(F.col("gen").isin(names))
        asked = keys.select(self._hash().alias("h")).distinct().withColumn("bucket", self._bucket(F.col("h")))

        def test(key: tuple, group: pa.Table, held: pa.Table) -> pa.Table:
            hashes = group.column("h").to_numpy()
            slices = [hashes[at : at + (1 << 18)] for at in range(0, len(hashes), 1 << 18)]
            hit = [g for g, b in zip(held.column("gen").to_pylist(), held.column("bits").to_pylist(), strict=True) if any(may_hold(b, s).any() for s in slices)]
            return pa.table({"gen": pa.array(hit, pa.string()), "bucket": pa.array([key[0].as_py()] * len(hit), pa.int32())})

        return [(r.gen, r.bucket) for r in asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(test, "gen string, bucket int").distinct().collect()]

    def unseen(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of ``keys`` whose key is in no batch (below ``before``); repeated rows stay."""
        found = self.suspects(keys, before)
        if not found:
            return keys
        by_gen: dict[str, list[int]] = {}
        for gen, bucket in found:
            by_gen.setdefault(gen, []).append(bucket)
        held = None
        for gen, wanted in sorted(by_gen.items()):
            part = keys.sparkSession.read.parquet(self._folder(gen)).where(F.col("bucket").isin(wanted)).select(*self.on)
            held = part if held is None else held.unionByName(part)
        right = held.distinct().select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(self.on)])
        on = F.lit(True)
        for i, c in enumerate(self.on):
            on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
        return keys.join(right, on, "left_anti")

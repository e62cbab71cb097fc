"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


BUSY = 500
SALTS = 64
#: Edges of a written file.
FILE_ROWS = 100_000


def with_least(edges: DataFrame, least: DataFrame, over: int) -> DataFrame:
    """(a, b, m) of the edges (a, b), with each node's ``m`` from ``least`` (a, m, n); n is the node's number of edges.

    A node of more than ``over`` edges would be one hot key. There are few of them, so they are broadcast, and their edges are
    dealt to salts on the way through the join of the others.
    """
    busy = least.where(F.col("n") > over).select("a", F.col("m").alias("known"))
    dealt = edges.join(F.broadcast(busy), "a", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("known").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("b"), F.lit(SALTS))).cast("int"))
    # n is at least 1, so this is 0, but no constant: the optimizer would make the join one on a alone.
    rest = least.where(F.col("n") <= over).select("a", F.least("n", F.lit(0)).cast("int").alias("salt"), "m")
    return dealt.join(rest, ["a", "salt"], "left").select("a", "b", F.coalesce("known", "m").alias("m"))


def components(edges: DataFrame, *, busy: int = BUSY) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b); the root is the least node of its component.

    Large-star: each node's larger neighbours are tied to its least neighbour. Small-star: its smaller neighbours and
    itself are. Both keep the components; after a few rounds (about the logarithm of the nodes) every component is one
    star. The least neighbour is an aggregate joined back; centres of more than ``busy`` edges are joined by broadcast. That
    limit grows with the table, so that there are never more than 100,000 of them. Edges without an end take no part.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(pairs.where("a <> b").distinct(), "cc")
    mark = None
    n = now.count()
    while True:
        over = max(busy, n // 50_000)  # the degrees of 2n edge ends exceed it at fewer than 100,000 nodes
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = with_least(both.where("b > a"), least, over).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        tied = with_least(large, least, over).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = stored(edges.coalesce(max(1, -(-n // FILE_ROWS))), "cc")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark, n = seen, seen[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

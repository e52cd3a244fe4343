"""Connected components of an edge table, without sending any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the larger (large) or the smaller neighbours of each node on the least node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("u > v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of edges (u, v).

    Alternating large and small stars; each round is checkpointed, and the end is seen from a checksum. Long chains
    need a number of rounds that grows with the logarithm of their length; rounds go on until nothing changes.
    """
    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u", F.lit(1))), F.lit(0))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        edges = checkpoint(_star(_star(edges, large=True), large=False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

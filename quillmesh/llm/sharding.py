"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of doc_id (ties by checksum and size; rows that are alike in all
of them are interchangeable). A four-round Feistel network over Z_a x Z_b, a*b >= n, permutes the numbers;
results outside 0..n-1 go through it again (cycle walking). Position p is row ``p div shards`` of shard
``p mod shards``, so shard and slot are computable from the row number alone, shard counts differ by one
at most (law ``rows``) and every slot is gapless from 0. DataFrame functions only.

Null texts have no bytes and checksum 0; a null doc_id sorts first; an empty table gives no rows;
more columns of the input are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpoint, partitions

ROUND_KEYS = (2654435, 1597334677, 374761393, 668265263)
WALK = 16


def domain(n: int) -> tuple[int, int]:
    """The halves of the network for n rows: the least a with a*a >= n, and the least b with a*b >= n."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    """x div by, in integers."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def _mix(x: Column, key: Column) -> Column:
    low = F.lit(4294967296)
    z = (x * F.lit(2654435769) + key) % low
    z = (z.bitwiseXOR(F.shiftright(z, 15)) * F.lit(1103515245)) % low
    return z.bitwiseXOR(F.shiftright(z, 13))


def feistel(x: Column, n: int) -> Column:
    """One pass of the network over 0..a*b-1."""
    a, b = domain(n)

    def one(state: Column, key: Column) -> Column:
        left = (state["l"] + _mix(state["r"], key)) % F.lit(a)
        right = (state["r"] + _mix(left, key + F.lit(40503))) % F.lit(b)
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct((x % F.lit(a)).alias("l"), _div(x, a).alias("r"))
    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in ROUND_KEYS]), start, one, lambda s: s["l"] + s["r"] * F.lit(a))


def permuted(x: Column, n: int) -> Column:
    """The permutation of 0..n-1. Points outside 0..n-1 number a*b-n, so a walk ends after that many steps and one."""
    a, b = domain(n)
    step = lambda p, _: F.when(p < n, p).otherwise(feistel(p, n))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(WALK, a * b - n + 1))), feistel(x, n), step)
    if a * b - n < WALK:
        return walk
    rest = lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n + 1)), p, step)
    return F.when(walk < n, walk).otherwise(rest(walk))


def numbered(rows: DataFrame, order: list[str], number: str = "row") -> tuple[DataFrame, int]:
    """rows with their place (from 0) in the order of the named columns, and how many there are.

    Ranges of the order are dealt out and checkpointed; what goes to the driver is a count for each range,
    as many as there are shuffle partitions. No task sees more than a range.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(partitions(rows.sparkSession), *order, "_tie").withColumn("_range", F.spark_partition_id())
    ranged = checkpoint(ranged)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_range").alias("_of"), "_n")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    before = counts.select("_of", (F.sum("_n").over(Window.orderBy("_of")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie"))
    out = ranged.withColumn("_local", local).join(F.broadcast(before), F.col("_range") == F.col("_of"))
    return out.withColumn(number, F.col("_before") + F.col("_local") - F.lit(1)).drop("_tie", "_range", "_of", "_n", "_before", "_local"), total


def shard_rows(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, row, position, shard and slot of each document."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + F.lit(8)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    placed = placed.withColumn("position", permuted(F.col("row"), max(n, 1)))
    return placed.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": _div(F.col("position"), shards)})

"""Mergeable sketches: distinct counts, membership, frequencies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- distinct counts: DataSketches HLL ---


def hll(df: DataFrame, keys: Sequence[str], item: str, lg_k: int = 14) -> DataFrame:
    """A HyperLogLog sketch (binary) for each key."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col(item).cast("string"), lg_k).alias("sketch"))


def hll_merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def hll_count(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch"))


# --- membership: a Bloom filter as a table of set positions ---


def bloom_size(n: int, p: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for n items with a false-positive rate of p."""
    m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, math.ceil(m / n * math.log(2)))


def bloom_positions(item: Column, m: int, k: int) -> Column:
    """The k positions of an item, by double hashing."""
    h1, h2 = F.xxhash64(item.cast("string"), F.lit(1)), F.xxhash64(item.cast("string"), F.lit(2))
    # Remainders first, so that sums stay far from overflow.
    a, b = F.pmod(h1, F.lit(m)), F.pmod(h2, F.lit(m))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(a + i * b, F.lit(m)))


def bloom(df: DataFrame, item: str, m: int, k: int) -> DataFrame:
    """Set positions of all items; the union of two filters' rows is the filter of both."""
    return df.select(F.explode(bloom_positions(F.col(item), m, k)).alias("position")).distinct()


def bloom_merge(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.union(f)
    return out.distinct()


def bloom_contains(df: DataFrame, item: str, positions: DataFrame, m: int, k: int) -> DataFrame:
    """``df`` with maybe: whether all positions of the item are set (false: surely not in)."""
    at = df.select(F.col(item)).distinct().withColumn("position", F.explode(bloom_positions(F.col(item), m, k)))
    hit = at.join(positions.withColumn("hit", F.lit(1)), "position", "left").groupBy(item).agg((F.count("hit") == F.count("*")).alias("maybe"))
    return df.join(hit, item, "left")


def bloom_count(positions: DataFrame, m: int, k: int) -> DataFrame:
    """One row: how many items the filter holds, estimated from its set bits."""
    return positions.agg((-(m / k) * F.log(1 - F.count("*") / m)).alias("estimate"))


def sharded_bloom(df: DataFrame, item: str, shards: int, m: int, k: int) -> DataFrame:
    """A filter of ``m`` bits for each shard of items: rows (shard, position); shards grow and are read apart."""
    shard = F.pmod(F.xxhash64(F.col(item).cast("string"), F.lit(3)), F.lit(shards))
    return df.select(shard.alias("shard"), F.explode(bloom_positions(F.col(item), m, k)).alias("position")).distinct()


def sharded_contains(df: DataFrame, item: str, positions: DataFrame, shards: int, m: int, k: int) -> DataFrame:
    """``df`` with maybe, as ``bloom_contains``."""
    shard = F.pmod(F.xxhash64(F.col(item).cast("string"), F.lit(3)), F.lit(shards))
    at = df.select(F.col(item)).distinct().select(item, shard.alias("shard"), F.explode(bloom_positions(F.col(item), m, k)).alias("position"))
    hit = at.join(positions.withColumn("hit", F.lit(1)), ["shard", "position"], "left").groupBy(item).agg((F.count("hit") == F.count("*")).alias("maybe"))
    return df.join(hit, item, "left")


# --- frequencies: a count-min table of cells ---


def cms(df: DataFrame, item: str, width: int = 2000, depth: int = 7, weight: Column | None = None) -> DataFrame:
    """Cells (row, col, n) of a count-min sketch."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda d: F.struct(d.alias("row"), F.pmod(F.xxhash64(F.col(item).cast("string"), d), F.lit(width)).alias("col")))
    return df.select(F.explode(rows).alias("c"), (weight if weight is not None else F.lit(1)).alias("w")).groupBy("c.row", "c.col").agg(F.sum("w").alias("n"))


def cms_merge(*sketches: DataFrame, how: str = "max") -> DataFrame:
    """max: replicas of one stream (idempotent); sum: disjoint shards of a stream."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "col").agg((F.max if how == "max" else F.sum)("n").alias("n"))


def cms_estimate(items: DataFrame, item: str, cells: DataFrame, width: int = 2000, depth: int = 7) -> DataFrame:
    """Distinct items with estimate: the least of their cells, never under the true count."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda d: F.struct(d.alias("row"), F.pmod(F.xxhash64(F.col(item).cast("string"), d), F.lit(width)).alias("col")))
    at = items.select(item).distinct().withColumn("c", F.explode(rows)).select(item, "c.row", "c.col")
    return at.join(cells, ["row", "col"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))

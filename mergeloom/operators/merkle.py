"""Merkle trees over keyed tables, as one table of levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import as_list
from .delta import content


def leaves(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows (key text, hash): the content of each key's row; of rows that share a key text the greatest hash."""
    keys = as_list(key)
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys))
    return df.select(text.alias("key"), content(df, keys).alias("hash")).groupBy("key").agg(F.max("hash").alias("hash"))


def tree(df: DataFrame, key: str | Sequence[str], branching: int = 16, depth: int = 6) -> DataFrame:
    """Rows (level, node, hash, count): level 0 is the root, ``depth`` the buckets of keys.

    A key belongs to the bucket of its hash's first digits in base ``branching``,
    so that trees of different tables have nodes in the same places and a changed
    key changes only its own path; a node's hash is that of its children in order.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(branching**depth))
    lists = leaves(df, key).select(bucket.alias("node"), "key", "hash")
    combine = F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"])), 256).alias("hash")
    level = lists.select("node", F.struct("key", "hash").alias("at"), "hash").groupBy("node").agg(combine, F.count("*").alias("count"))
    out = level.select(F.lit(depth).alias("level"), "node", "hash", "count")
    for up in range(depth - 1, -1, -1):
        level = level.select(F.floor(F.col("node") / branching).cast("long").alias("up"), F.col("node").alias("at"), "hash", "count").groupBy("up").agg(combine, F.sum("count").alias("count")).withColumnRenamed("up", "node")
        out = out.unionByName(level.select(F.lit(up).alias("level"), "node", "hash", "count"))
    return out


def root(df: DataFrame, key: str | Sequence[str], branching: int = 16, depth: int = 6) -> DataFrame:
    """One row with the root's hash and count; none for an empty table."""
    return tree(df, key, branching, depth).where("level = 0").select("hash", "count")


def diff(a: DataFrame, b: DataFrame, key: str | Sequence[str], buckets: int | None = None) -> DataFrame:
    """Keys (as text) that differ: change 'added', 'removed' or 'modified', of a against b.

    Leaves of both sides are dealt by key for their own aggregation, and the join
    finds them so.  With ``buckets`` only leaves of buckets with different contents
    are joined: for tables that differ in few places.
    """
    if buckets is not None:
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
        sums = [leaves(df, key).groupBy(bucket).agg(F.bit_xor(F.xxhash64("key", "hash")).alias(f"h{i}"), F.count("*").alias(f"n{i}")) for i, df in enumerate((a, b))]
        differ = sums[0].join(sums[1], "bucket", "full_outer").where("NOT (h0 <=> h1 AND n0 <=> n1)").select("bucket")
        sides = [leaves(df, key).withColumn("bucket", bucket).join(differ, "bucket", "left_semi").drop("bucket") for df in (a, b)]
    else:
        sides = [leaves(df, key) for df in (a, b)]
    both = sides[0].withColumnRenamed("hash", "old").join(sides[1].withColumnRenamed("hash", "new"), "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("key", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified").alias("change"))


def differing_nodes(a: DataFrame, b: DataFrame, level: int) -> DataFrame:
    """Nodes of a level in which two trees differ: the ranges of keys that remain to be compared."""
    side = lambda t, name: t.where(F.col("level") == level).select("node", F.col("hash").alias(name))
    return side(a, "x").join(side(b, "y"), "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")


def same(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> bool:
    """Whether two tables hold the same keys and rows: two small aggregates, no join."""
    shape = lambda df: leaves(df, key).agg(F.bit_xor(F.xxhash64("key", "hash")).alias("h"), F.count("*").alias("n")).first()
    return shape(a) == shape(b)


def merge(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """For each key the row of the greater content hash."""
    keys = as_list(key)
    rows = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc("__h"))
    return rows.withColumn("__h", content(rows, keys)).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__h", "__n")

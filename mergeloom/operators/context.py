"""Agent memories: facts with side information, merged, filtered, packed and queried."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a memory besides its fact.
SIDECAR = "topic string, source string, confidence double, ts double, access_count bigint, ttl double, tags array<string>, metadata map<string,string>"


def fact_id(fact: Column) -> Column:
    """The first 16 hex digits of the fact's SHA-256."""
    return F.substring(F.sha2(fact, 256), 1, 16)


def memories(df: DataFrame, now: float = 0.0) -> DataFrame:
    """Facts with all side columns and fact_id; what is missing is null, ts of 0 or null is ``now``."""
    out = df
    for part in SIDECAR.split(", "):
        name, kind = part.split(" ", 1)
        out = out.withColumn(name, F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind))
    ts = F.when(F.coalesce(F.col("ts"), F.lit(0.0)) == 0, F.lit(float(now))).otherwise(F.col("ts"))
    return out.withColumn("ts", ts).withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn("access_count", F.coalesce("access_count", F.lit(0))).withColumn("fact_id", fact_id(F.col("fact")))


def merge_sidecars(df: DataFrame) -> DataFrame:
    """One memory for each fact over all rows: greatest topic, source, confidence, time and count; no limit of life beats any; tags and metadata join."""
    tags = df.select("fact_id", F.explode("tags").alias("tag")).groupBy("fact_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    meta = df.select("fact_id", F.explode("metadata").alias("k", "v")).groupBy("fact_id", "k").agg(F.max("v").alias("v")).groupBy("fact_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    one = df.groupBy("fact_id").agg(
        F.max("fact").alias("fact"), F.max("topic").alias("topic"), F.max("source").alias("source"), F.max("confidence").alias("confidence"), F.max("ts").alias("ts"), F.max("access_count").alias("access_count"),
        F.when(F.count_if(F.col("ttl").isNull()) == 0, F.max("ttl")).alias("ttl"),
    )
    return one.join(tags, "fact_id", "left").join(meta, "fact_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def merge_contexts(agents: Sequence[DataFrame], min_confidence: float = 0.0, budget: int | None = None, now: float = 0.0) -> DataFrame:
    """Memories of any number of agents in one aggregation; the ``budget`` most trusted (then by fact), in order of fact."""
    rows = memories(agents[0], now)
    for a in agents[1:]:
        rows = rows.unionByName(memories(a, now), allowMissingColumns=True)
    out = merge_sidecars(rows).where(F.col("confidence") >= min_confidence)
    if budget is not None:
        out = out.orderBy(F.desc("confidence"), "fact").limit(budget)
    return out.orderBy("fact")


def resolve_facts(df: DataFrame, key: str, how: str = "lww", priorities: Sequence[str] = ()) -> DataFrame:
    """One fact for each ``key``: the latest ('lww'), the most trusted ('max_confidence'), all joined ('union'), or of the best source ('priority')."""
    if how == "union":
        return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("fact")), " | ").alias("fact"), F.max("confidence").alias("confidence"), F.max("ts").alias("ts"))
    place = F.array_position(F.array(*(F.lit(p) for p in priorities)).cast("array<string>"), F.col("source"))
    rank = {"lww": F.struct("ts", "confidence", "fact"), "max_confidence": F.struct("confidence", "ts", "fact"), "priority": F.struct(F.when(place > 0, -place).otherwise(F.lit(-(10**6))), F.col("ts"), F.col("fact"))}[how]
    return df.groupBy(key).agg(F.max_by(F.struct("fact", "confidence", "ts", "source"), rank).alias("b")).select(key, "b.*")


def expired(ts: Column, ttl: Column, now: float) -> Column:
    """Whether a memory's time is up; without ttl it never is."""
    return ttl.isNotNull() & (F.lit(float(now)) - ts > ttl)


def evict(df: DataFrame, now: float) -> DataFrame:
    return df.where(~expired(F.col("ts"), F.col("ttl"), now))


def query(df: DataFrame, topic: str | None = None, min_confidence: float | None = None, source: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Memories that fit all of what is asked."""
    out = df
    if topic is not None:
        out = out.where(F.col("topic") == topic)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    if source is not None:
        out = out.where(F.col("source") == source)
    if tags:
        out = out.where(F.size(F.array_except(F.array(*(F.lit(t) for t in tags)), "tags")) == 0)
    return out


def blocks(df: DataFrame, size: int = 1000, buckets: int = 64) -> DataFrame:
    """Memories with block_id: runs of at most ``size`` in order of fact_id within each of ``buckets`` of ids; the id is a hash of the members'."""
    bucket = F.pmod(F.conv(F.substring("fact_id", 1, 8), 16, 10).cast("long"), F.lit(buckets))
    numbered = df.withColumn("bucket", bucket).withColumn("block", F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy("fact_id")) - 1) / size))
    ids = numbered.groupBy("bucket", "block").agg(F.substring(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("fact_id"))), 256), 1, 16).alias("block_id"), F.count("*").alias("block_size"))
    return numbered.join(ids, ["bucket", "block"]).drop("bucket", "block")


def manifest(df: DataFrame) -> DataFrame:
    """One row: facts, sources in order, mean confidence, first and last time."""
    return df.agg(F.count("*").alias("facts"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.round(F.avg("confidence"), 9).alias("quality"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merge_manifests(df: DataFrame, key: str) -> DataFrame:
    """Manifests by key: sources join, every number and time is the greatest."""
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("sources", ",")))))
    return df.groupBy(key).agg(F.max("facts").alias("facts"), F.array_join(sources, ",").alias("sources"), F.max("quality").alias("quality"), F.max("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))

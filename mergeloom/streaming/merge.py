"""Merging streams: upserts into a store, keyed state, ordered merges, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.strategies import MergeSchema
from ..functions.values import as_list
from ..operators.merge import Schema, fold, merge, merge_many
from ..sources.store import MergeStore


def upsert_stream(stream: DataFrame, store: MergeStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Fold every micro-batch into the store.

    Folding is idempotent, so a batch that is run again after a failure changes
    nothing; late rows simply lose, so there is no watermark to set.
    """
    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.ingest(batch)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_by_key(stream: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """The latest value of each key of a stream, for update mode: (key, value, ts); of the same time the greater one stays."""
    best = F.max(F.struct(F.col(ts).cast("double").alias("ts"), F.col(value).alias("value"))).alias("best")
    return stream.groupBy(F.col(key).alias("key")).agg(best).select("key", "best.value", "best.ts")


def distinct_stream(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First rows of each key, remembered for ``delay`` of event time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def merge_streams(a: DataFrame, b: DataFrame, key: str | Sequence[str], schema: Schema = None, timestamp_col: str | None = None) -> DataFrame:
    """Two bounded sources merged by one aggregation (last writer wins by default)."""
    return merge_many([a, b], key, schema, timestamp_col, null_keys="keep")


def unsorted(df: DataFrame, keys: Sequence[str], position: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows that come after one with a greater key, in their group.

    Without a group rows are compared within ranges of ``position``, and the first
    of a range with the last of those before it: a row a range meets in one place.
    """
    keys, names = as_list(keys), df.columns
    if group:
        before = F.lag(F.struct(*keys)).over(Window.partitionBy(*group).orderBy(position))
        return df.withColumn("__before", before).where(F.col("__before") > F.struct(*keys)).drop("__before")
    parts = df.repartitionByRange(position).withColumn("__part", F.spark_partition_id())
    lasts = parts.groupBy("__part").agg(F.max_by(F.struct(*keys), F.col(position)).alias("__last"))
    lasts = lasts.withColumn("__last", F.lag("__last").over(Window.orderBy("__part")))
    within = parts.withColumn("__before", F.lag(F.struct(*keys)).over(Window.partitionBy("__part").orderBy(position)))
    return within.join(F.broadcast(lasts), "__part").where(F.coalesce("__before", "__last") > F.struct(*keys)).select(names)


def merge_sorted(a: DataFrame, b: DataFrame, key: str | Sequence[str], schema: Schema = None, timestamp_col: str | None = None, position: str | None = None) -> DataFrame:
    """Two sorted sources as one in order of key: a sort-merge join, repeated keys paired one to one.

    With ``position``, a column that tells the order of rows, a source that isn't
    in order of key is an error (ValueError), found by reading both beforehand.
    """
    keys = as_list(key)
    for side, df in (("first", a), ("second", b)):
        if position is not None and not unsorted(df, keys, position).isEmpty():
            raise ValueError(f"the {side} source is not in order of {', '.join(keys)}")
    number = lambda df: df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c) for c in df.columns if c not in keys))))
    out = merge(number(a), number(b), [*keys, "__nth"], timestamp_col, schema=MergeSchema.of(schema), on_duplicate="unique")
    return out.orderBy(*keys).drop("__nth")


def stream_stats(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row: rows of both, keys in both, keys in one."""
    keys = as_list(key)
    both = a.groupBy(*keys).agg(F.count("*").alias("n_a")).join(b.groupBy(*keys).agg(F.count("*").alias("n_b")), keys, "full_outer")
    return both.agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_b"), F.count_if(F.col("n_a").isNotNull() & F.col("n_b").isNotNull()).alias("merged"), F.count_if(F.col("n_a").isNull() | F.col("n_b").isNull()).alias("single"))


def delta_stream(stream: DataFrame, store: MergeStore, on_delta, checkpoint: str) -> StreamingQuery:
    """After each micro-batch, call ``on_delta(delta, batch id)`` with what it changed in the store."""
    from ..operators.delta import compute_delta

    def put(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        before = store.read() if store.metadata() else batch.limit(0)
        store.ingest(batch)
        on_delta(compute_delta(before, store.read(), store.keys), number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(df: DataFrame, key: str | Sequence[str], schema: Schema = None, timestamp_col: str | None = None) -> DataFrame:
    return fold(df, as_list(key), schema, timestamp_col)


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream, one file a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

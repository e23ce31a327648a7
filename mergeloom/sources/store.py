"""A table on disk that merges whatever is put into it."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strategies import MergeSchema
from ..functions.values import as_list
from ..operators.merge import Schema, fold, merge_many


class MergeStore:
    """Parquet versions below a folder, each the fold of all that was ingested.

    A version is written whole before the pointer to it is, so a reader or a job
    that dies halfway always finds one that is complete.  The pointer, a small
    Spark-written text file, holds the key, the strategies and the counts.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | Sequence[str] | None = None, schema: Schema = None, timestamp_col: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        stored = self.metadata()
        if stored:
            self.keys, self.rules, self.ts = stored["key"], MergeSchema.from_json(stored["schema"]), stored["timestamp_col"]
        elif key is None:
            raise ValueError("a new store needs a key")
        else:
            self.keys, self.rules, self.ts = as_list(key), MergeSchema.of(schema), timestamp_col

    def _versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/versions")
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if fs.exists(self._hadoop_path(f"{s.getPath().toString()}/_SUCCESS")))

    def _hadoop_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        at = self._hadoop_path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def metadata(self) -> dict:
        """Of the latest version; empty for a new store."""
        found = self._versions()
        if not found:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{found[-1]}", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        found = self._versions()
        if not found:
            raise FileNotFoundError(f"nothing was ingested into {self.path}")
        return self.spark.read.parquet(f"{self.path}/data/{found[-1] if version is None else version}")

    def _commit(self, df: DataFrame, **counts: int) -> dict:
        number = (self._versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/data/{number}")
        meta = {"version": number, "key": self.keys, "schema": self.rules.to_json(), "timestamp_col": self.ts, "rows": self.spark.read.parquet(f"{self.path}/data/{number}").count(), **counts}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/versions/{number}")
        return meta

    def ingest(self, df: DataFrame) -> dict:
        """Fold rows in; rows with a null key are left out.  Returns the new metadata, with new and updated keys."""
        df = df.dropna(subset=self.keys)
        if not self._versions():
            folded = fold(df, self.keys, self.rules, self.ts)
            meta = self._commit(folded, new=0, updated=0)
            return meta | {"new": meta["rows"]}
        old = self.read()
        keys = df.select(*self.keys).distinct()
        counted = keys.join(old.select(*self.keys).withColumn("__old", F.lit(1)), self.keys, "left").agg(F.count_if(F.col("__old").isNull()).alias("new"), F.count("__old").alias("updated")).first()
        return self._commit(merge_many([old, df], self.keys, self.rules, self.ts), new=counted.new, updated=counted.updated)

    def merge_with(self, other: MergeStore) -> dict:
        return self.ingest(other.read())

    def compact(self) -> dict:
        """Drop rows without any cell but the key, and older versions."""
        df = self.read()
        others = [c for c in df.columns if c not in self.keys]
        meta = self._commit(df.where(F.coalesce(*(F.col(c).cast("string") for c in others)).isNotNull()) if others else df)
        for v in self._versions()[:-1]:
            for kind in ("versions", "data"):
                fs, at = self._fs(f"{self.path}/{kind}/{v}")
                fs.delete(at, True)
        return meta

    def to_parquet(self, path: str) -> None:
        self.read().write.mode("overwrite").parquet(path)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, store: str, key: str | Sequence[str], schema: Schema = None, timestamp_col: str | None = None) -> MergeStore:
        out = cls(spark, store, key, schema, timestamp_col)
        out.ingest(spark.read.parquet(path))
        return out


class ClockedTable(MergeStore):
    """A store whose rows carry _ts and _node, and which tells the latest time of each node."""

    def __init__(self, spark: SparkSession, path: str, key: str | Sequence[str] | None = None, schema: Schema = None) -> None:
        super().__init__(spark, path, key, schema, "_ts")

    def merge_insert(self, df: DataFrame, node: str, ts: float) -> dict:
        """Rows of a node at a time; what is there already keeps the later of both times."""
        return self.ingest(df.withColumn("_ts", F.lit(float(ts))).withColumn("_node", F.lit(node)))

    def clock(self) -> DataFrame:
        return self.read().groupBy("_node").agg(F.max("_ts").alias("ts"))

    def sync_from(self, other: ClockedTable) -> dict:
        return self.merge_with(other)

"""Protocol messages as upserts: one stream of records for each name, later emissions win."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import MergeStore

SPEC = {"connectionSpecification": {"type": "object", "required": ["path"], "properties": {"path": {"type": "string"}, "strategies": {"type": "object"}}}}


class RecordDestination:
    """Messages {type, record: {stream, data, emitted_at}} written to a store for each stream."""

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, Sequence[str]], schemas: Mapping[str, T.StructType | str], strategies: Mapping[str, Mapping[str, str]] | None = None) -> None:
        self.spark, self.path, self.keys, self.schemas, self.strategies = spark, path.rstrip("/"), keys, schemas, strategies or {}

    @staticmethod
    def spec() -> dict:
        return SPEC

    def check(self) -> bool:
        """Whether every stream has a key and a schema."""
        return set(self.keys) == set(self.schemas)

    def store(self, stream: str) -> MergeStore:
        return MergeStore(self.spark, f"{self.path}/{stream}", list(self.keys[stream]), self.strategies.get(stream), "_emitted_at")

    def write(self, messages: DataFrame) -> dict[str, dict]:
        """Messages as a column ``value`` of JSON; those that aren't records pass. A record without a key is an error."""
        parsed = messages.select(F.from_json("value", "type string, record struct<stream: string, data: string, emitted_at: double>").alias("m")).where("m.type = 'RECORD'").select("m.record.*")
        out = {}
        for stream, schema in self.schemas.items():
            rows = parsed.where(F.col("stream") == stream).select(F.from_json("data", schema).alias("d"), F.col("emitted_at").alias("_emitted_at")).select("d.*", "_emitted_at")
            lacking = rows.where(" or ".join(f"`{k}` is null" for k in self.keys[stream]))
            if not lacking.isEmpty():
                raise ValueError(f"a record of {stream} has no key")
            if not rows.isEmpty():
                out[stream] = self.store(stream).ingest(rows)
        return out

    def read(self, stream: str) -> DataFrame:
        return self.store(stream).read()

"""Named snapshots and branches of tables, merged and compared."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merkle
from ..functions.values import as_list
from ..operators.merge import Schema, diff, merge, merge_many


class Snapshots:
    """Snapshots by name: frames, or Parquet below ``path`` where they outlive the session."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path
        self.frames: dict[str, DataFrame] = {}
        self.trail: list[tuple[float, str, str]] = []

    def _note(self, what: str, name: str) -> None:
        self.trail.append((datetime.now(UTC).timestamp(), what, name))

    def register(self, name: str, df: DataFrame) -> DataFrame:
        if self.path is not None:
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
            df = self.spark.read.parquet(f"{self.path}/{name}")
        self.frames[name] = df
        self._note("register", name)
        return df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.frames:
            if self.path is None:
                raise KeyError(name)
            self.frames[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self.frames[name]

    def branch(self, name: str, of: str) -> DataFrame:
        self.frames[name] = self[of]
        self._note("branch", f"{name} of {of}")
        return self.frames[name]

    def merge(self, a: str, b: str, key: str | Sequence[str], schema: Schema = None, to: str | None = None) -> DataFrame:
        out = merge(self[a], self[b], key, schema=schema, null_keys="drop")
        self._note("merge", f"{a} and {b}")
        return self.register(to, out) if to else out

    def merge_branches(self, names: Sequence[str], key: str | Sequence[str], schema: Schema = None, timestamp_col: str | None = None, to: str | None = None) -> DataFrame:
        """Any number of branches by one aggregation."""
        out = merge_many([self[n] for n in names], key, schema, timestamp_col)
        self._note("merge", ", ".join(names))
        return self.register(to, out) if to else out

    def update_branch(self, name: str, df: DataFrame) -> DataFrame:
        """The branch's new content; what it was taken from stays."""
        if name not in self.frames and self.path is None:
            raise KeyError(name)
        self._note("update", name)
        return self.register(name, df)

    def resolve_with_sql(self, a: str, b: str, key: str | Sequence[str], rules: dict[str, str], to: str | None = None) -> DataFrame:
        """Two snapshots joined, each conflicting column by an SQL expression over a.<column> and b.<column>."""
        keys = as_list(key)
        x, y = self[a].alias("a"), self[b].alias("b")
        on = reduce(lambda p, q: p & q, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
        names = [*self[a].columns, *(c for c in self[b].columns if c not in self[a].columns)]
        cell = lambda c: f"CASE WHEN a.{c} IS NULL THEN b.{c} WHEN b.{c} IS NULL OR a.{c} <=> b.{c} THEN a.{c} ELSE {rules.get(c, f'b.{c}')} END" if c in self[a].columns and c in self[b].columns else c
        out = x.join(y, on, "full_outer").select(*(F.expr(f"coalesce(a.{c}, b.{c})" if c in keys else cell(c)).alias(c) for c in names))
        self._note("resolve", f"{a} and {b}")
        return self.register(to, out) if to else out

    def changes(self, a: str, b: str, key: str | Sequence[str]) -> DataFrame:
        """Changes from a to b; two aggregates tell first whether there are any."""
        out = diff(self[a], self[b], key)
        return out.limit(0) if merkle.same(self[a], self[b], key) else out

    def audit_trail(self) -> DataFrame:
        return self.spark.createDataFrame(self.trail, "ts double, operation string, name string")

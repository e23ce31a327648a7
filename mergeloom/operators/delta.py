"""Deltas between versions of a keyed table: compute, apply, compose.

A delta is a table of the key, ``_op`` ('added', 'modified', 'removed') and the
new cells (null for removals).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strategies import MergeSchema
from ..functions.values import as_list, last_of_each, ordered
from .merge import Schema, joined

#: So many versions of a table are broadcast.
VERSIONS = 100_000


def content(df: DataFrame, keys: Sequence[str]) -> Column:
    """A hash of all cells but the key's, by name; null differs from the empty text."""
    cells = [F.concat(F.lit(f"{f.name}="), F.coalesce(F.concat(F.lit("+"), ordered(F.col(f.name), f.dataType).cast("string")), F.lit("-"))) for f in sorted(df.schema, key=lambda f: f.name) if f.name not in keys]
    return F.sha2(F.concat_ws("\x1e", *cells), 256)


def compute_delta(old: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """What turns ``old`` into ``new``; rows with a null in the key are left out, of repeated keys the last counts."""
    keys = as_list(key)
    a, b = (last_of_each(df, keys) for df in (old, new))
    both, kinds = joined(a, b, keys)
    same = F.lit(True)
    for c, kind in kinds.items():
        if c not in keys:
            cell = lambda side, df, c=c, kind=kind: ordered(F.col(side)[c], kind) if c in df.columns else F.lit(None)
            same &= cell("a", a).eqNullSafe(cell("b", b))
    op = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~same, "modified")
    cells = [F.coalesce(F.col("a")[k], F.col("b")[k]).alias(k) for k in keys]
    cells += [F.col("b")[c].alias(c) if c in b.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items() if c not in keys]
    return both.select(*cells, op.alias("_op")).where("_op is not null")


def apply_delta(df: DataFrame, delta: DataFrame, key: str | Sequence[str], schema: Schema = None) -> DataFrame:
    """``df`` after the delta, by one join: removed keys go, added rows overwrite, modified ones overwrite or, with ``schema``, merge.

    Rows of ``df`` with a null in the key stay as they are.
    """
    keys, rules = as_list(key), MergeSchema.of(schema)
    both, kinds = joined(df, delta, keys)
    op, zero = F.col("b._op"), F.lit(0.0)
    cells = []
    for c, kind in kinds.items():
        if c == "_op":
            continue
        old = F.col("a")[c] if c in df.columns else F.lit(None).cast(kind)
        new = F.col("b")[c] if c in delta.columns else F.lit(None).cast(kind)
        if schema is not None and c not in keys:
            merged = F.when(old.isNull(), new).when(new.isNull(), old).otherwise(rules[c].pair(old, new, zero, zero, kind).cast(kind))
            new = F.when((op == "modified") & F.col("a").isNotNull(), merged).otherwise(new)
        cells.append(F.when(F.col("b").isNull(), old).otherwise(new).alias(c))
    return both.where(op.isNull() | (op != "removed")).select(*cells)


def compose_deltas(deltas: Sequence[DataFrame], key: str | Sequence[str]) -> DataFrame:
    """One delta for several in a row.

    For each key the last row counts; its operation follows from what was there
    before the first and what is there after the last: added then removed leaves
    nothing but a removal, which is harmless; removed then added is a change.
    """
    keys = as_list(key)
    rows = deltas[0].withColumn("_seq", F.lit(0))
    for i, d in enumerate(deltas[1:], 1):
        rows = rows.unionByName(d.withColumn("_seq", F.lit(i)), allowMissingColumns=True)
    cells = [c for c in rows.columns if c not in (*keys, "_seq", "_op")]
    folded = rows.groupBy(*keys).agg(F.min_by("_op", "_seq").alias("_first"), F.max_by(F.struct("_op", *cells), "_seq").alias("_last"))
    op = F.when(F.col("_last._op") == "removed", "removed").when(F.col("_first") == "added", "added").otherwise("modified")
    return folded.select(*keys, *(F.col("_last")[c].alias(c) for c in cells), op.alias("_op"))


def version_history(states: DataFrame, key: str | Sequence[str], version: str) -> DataFrame:
    """Deltas between consecutive versions that one table holds: the key, version, _op.

    A version has as many rows as the table had, so rows are never dealt by it: up
    to ``VERSIONS`` of them go to every task.
    """
    keys = as_list(key)
    hashed = states.select(*keys, version, F.unhex(content(states.drop(version), keys)).alias("h"))
    versions = states.select(version).distinct()
    few = versions.limit(VERSIONS + 1).count() <= VERSIONS
    versions = versions.withColumn("__next", F.lead(version).over(Window.orderBy(version)))
    order = Window.partitionBy(*keys).orderBy(version)
    seen = hashed.join(F.broadcast(versions) if few else versions, version).withColumn("__before", F.lag(F.struct(version, "h", "__next")).over(order)).withColumn("__after", F.lead(version).over(order))
    added = F.col("__before").isNull() | (F.col("__before.__next") != F.col(version))
    put = F.when(added, "added").when(F.col("__before.h") != F.col("h"), "modified")
    gone = F.col("__next").isNotNull() & (F.col("__after").isNull() | (F.col("__after") != F.col("__next")))
    ops = F.array(F.struct(F.col(version), put.alias("_op")), F.struct(F.col("__next").alias(version), F.when(gone, "removed").alias("_op")))
    return seen.select(*keys, F.explode(ops).alias("__op")).where("__op._op IS NOT NULL").select(*keys, F.col("__op")[version].alias(version), "__op._op")

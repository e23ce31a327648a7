"""Merging versions of keyed tables.

Two versions meet in one full outer join, any number in one union and aggregation;
either way there is one shuffle on the key, and every cell is decided by an
expression that stays within generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strategies import LWW, MergeSchema, Strategy
from ..functions.values import as_list, canonical_keys, last_of_each, null_key, orderable, ordered, seconds
from .schema import widen_type

Schema = MergeSchema | Mapping[str, str | Strategy] | None


def _prepared(df: DataFrame, keys: list[str], on_duplicate: str, order_by, schema: MergeSchema, ts: str | None) -> DataFrame:
    """Rows with a whole key, each key once."""
    if on_duplicate == "last":
        return last_of_each(df, keys, order_by)
    whole = df.where(~null_key(keys))
    if on_duplicate == "fold":
        return fold(whole, keys, schema, ts)
    if on_duplicate == "unique":
        return whole
    raise ValueError("on_duplicate is 'last', 'fold' or 'unique'")


def _kinds(a: DataFrame, b: DataFrame) -> dict[str, T.DataType]:
    """Columns in order, each with a type that holds both sides."""
    kinds = {f.name: f.dataType for f in a.schema}
    for f in b.schema:
        kinds[f.name] = widen_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    return kinds


def joined(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, dict[str, T.DataType]]:
    """The full outer join with columns a.<name> and b.<name> as structs a and b (null where a side has no row).

    Keys also stand beside the structs, under other names, so that Spark sees
    through the projection how a side is dealt and sorted already.
    """
    kinds = _kinds(a, b)

    def side(df: DataFrame, name: str) -> DataFrame:
        at = [(F.col(k) if dict(df.dtypes)[k] == kinds[k].simpleString() else F.col(k).cast(kinds[k])).alias(f"__{name}_{i}") for i, k in enumerate(keys)]
        return df.select(*at, F.struct(*(F.col(c).cast(kinds[c]).alias(c) for c in df.columns)).alias(name))

    on = reduce(lambda x, y: x & y, [F.col(f"__a_{i}") == F.col(f"__b_{i}") for i in range(len(keys))])
    return side(a, "a").join(side(b, "b"), on, "full_outer"), kinds


def _cell(c: str, kind: T.DataType, a: DataFrame, b: DataFrame, decide) -> Column:
    """The merged cell: what one side lacks or has null comes from the other; equal cells stay."""
    if c not in a.columns:
        return F.col("b")[c]
    if c not in b.columns:
        return F.col("a")[c]
    va, vb = F.col("a")[c], F.col("b")[c]
    same = ordered(va, kind).eqNullSafe(ordered(vb, kind))
    return F.when(vb.isNull() | same, va).when(va.isNull(), vb).otherwise(decide(va, vb))


def resolved(name: str, va: Column, vb: Column, ta: Column, tb: Column, kind: T.DataType, rules: MergeSchema, ts: str | None = None) -> Column:
    """Two cells that differ, by the rules of a schema.

    Structs without a strategy of their own merge field by field, each by its name's
    strategy and by the struct's own time stamp; lists merge element by element, and
    what the longer one has more stays; all else is decided whole.
    """
    if isinstance(kind, T.StructType) and name not in rules.columns:
        stamp = lambda v: seconds(v[ts], kind[ts].dataType) if ts and ts in kind.names else F.lit(0.0)
        return F.struct(*(_either(va[f.name], vb[f.name], f.dataType, lambda x, y, f=f: resolved(f.name, x, y, stamp(va), stamp(vb), f.dataType, rules, ts)).alias(f.name) for f in kind))
    if isinstance(kind, T.ArrayType):
        of = kind.elementType
        nested = MergeSchema(rules[name], {}) if not isinstance(of, T.StructType) else MergeSchema(rules.default, {c: s for c, s in rules.columns.items() if c != name})
        return F.zip_with(va, vb, lambda x, y: _either(x, y, of, lambda p, q: resolved(name, p, q, ta, tb, of, nested, ts)))
    return rules[name].pair(va, vb, ta, tb, kind).cast(kind)


def _either(va: Column, vb: Column, kind: T.DataType, decide) -> Column:
    """The cell that is there, the first of equal ones, or what is decided."""
    return F.when(vb.isNull() | ordered(va, kind).eqNullSafe(ordered(vb, kind)), va).when(va.isNull(), vb).otherwise(decide(va, vb))


def merge(
    a: DataFrame, b: DataFrame, key: str | Sequence[str] | None = None, timestamp_col: str | None = None, prefer: str = "latest", schema: Schema = None, dedup: bool = True, *,
    on_duplicate: str = "last", null_keys: str = "keep", order_by: Sequence[str] | None = None, nfc: bool = False, fuzzy_dedup: bool = False, fuzzy_threshold: float = 0.85,
) -> DataFrame:
    """Merge two versions of a table.

    Without a key the rows are appended, each once with ``dedup``.  With one, rows
    of the same key become one row.  A conflicting cell is decided by ``schema``
    if given, else by the later time stamp (column ``timestamp_col``, or ``_ts``
    where both sides have it), else by ``prefer``: 'a', 'b', or 'latest', the
    greater value.  The time stamp itself becomes the later one.  By a schema
    structs merge field by field and lists element by element (``resolved``).

    Rows with a null in their key merge with no other and are kept, or dropped
    with null_keys='drop'.  Of rows that repeat a key within a side the last in
    ``order_by`` counts (all columns by default), or they are folded by the
    schema ('fold'), or taken as they are ('unique', if keys are known to be).
    """
    if key is None:
        both = a.unionByName(b, allowMissingColumns=True)
        out = both.dropDuplicates() if dedup else both
    else:
        keys = as_list(key)
        ts = timestamp_col or ("_ts" if "_ts" in a.columns and "_ts" in b.columns else None)
        rules = MergeSchema.of(schema)
        given = [canonical_keys(df, keys) if nfc else df for df in (a, b)]
        a, b = (_prepared(df, keys, on_duplicate, order_by, rules, ts) for df in given)
        both, kinds = joined(a, b, keys)
        stamp = lambda side, df: seconds(F.col(side)[ts], kinds[ts]) if ts and ts in df.columns else F.lit(0.0)
        ta, tb = stamp("a", a), stamp("b", b)

        def decide(c: str):
            kind = kinds[c]
            if c == ts:
                return lambda va, vb: F.when(tb > ta, vb).otherwise(va)
            if schema is not None:
                return lambda va, vb: resolved(c, va, vb, ta, tb, kind, rules, ts)
            if ts:
                return lambda va, vb: LWW().pair(va, vb, ta, tb, kind)
            if prefer in ("a", "b"):
                return lambda va, vb: va if prefer == "a" else vb
            if prefer != "latest":
                raise ValueError("prefer is 'latest', 'a' or 'b'")
            return lambda va, vb: LWW().pair(va, vb, F.lit(0.0), F.lit(0.0), kind)

        cells = [F.coalesce(F.col("a")[c], F.col("b")[c]).alias(c) if c in keys else _cell(c, kind, a, b, decide(c)).alias(c) for c, kind in kinds.items()]
        out = both.select(*cells)
        if null_keys == "keep":
            # They meet no other row, so they pass by the join; the scan for them skips what has no nulls.
            apart = [df.where(null_key(keys)).select(*(F.col(c).cast(kinds[c]).alias(c) for c in df.columns)) for df in given]
            nulls = apart[0].unionByName(apart[1], allowMissingColumns=True)
            out = out.unionByName(nulls.dropDuplicates() if dedup and all(orderable(f.dataType) for f in nulls.schema) else nulls)
        elif null_keys != "drop":
            raise ValueError("null_keys is 'keep' or 'drop'")
    if fuzzy_dedup:
        from .dedup import fuzzy_rows

        out = fuzzy_rows(out, key, fuzzy_threshold)
    return out


def fold(df: DataFrame, keys: Sequence[str], schema: Schema = None, timestamp_col: str | None = None) -> DataFrame:
    """One row for each key, every other cell folded over all rows by its strategy; null cells never win."""
    rules, kinds = MergeSchema.of(schema), {f.name: f.dataType for f in df.schema}
    ts = seconds(F.col(timestamp_col), kinds[timestamp_col]) if timestamp_col else F.lit(0.0)
    aggs = []
    for c, kind in kinds.items():
        if c in keys:
            continue
        cell = F.max_by(F.col(c), ts) if c == timestamp_col else rules[c].agg(F.col(c), ts, kind).cast(kind)
        aggs.append(cell.alias(c))
    out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    return out.select(*df.columns)


def merge_many(sources: Sequence[DataFrame], key: str | Sequence[str], schema: Schema = None, timestamp_col: str | None = None, *, null_keys: str = "drop") -> DataFrame:
    """Merge any number of versions at once: one union, one aggregation, the result of any order of pairwise merges.

    Every cell competes with its own row's time stamp, so that the result doesn't
    depend on grouping as repeated pairwise merges would.
    """
    keys = as_list(key)
    kinds: dict[str, T.DataType] = {}
    for s in sources:
        for f in s.schema:
            kinds[f.name] = widen_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    same = [s.select(*(F.col(c).cast(kinds[c]).alias(c) for c in s.columns)) for s in sources]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), same)
    folded = fold(rows.where(~null_key(keys)), keys, schema, timestamp_col)
    return folded.unionByName(rows.where(null_key(keys))) if null_keys == "keep" else folded


# --- differences ---


def diff(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """What must change in ``a`` to become ``b``, a row for each change.

    Columns: the key, change ('added', 'removed', 'modified'), field, old, new
    (text).  Rows without a change and rows with a null in the key are left out.
    """
    keys = as_list(key)
    both, kinds = joined(last_of_each(a, keys), last_of_each(b, keys), keys)
    text = lambda side, df, c: ordered(F.col(side)[c], kinds[c]).cast("string") if c in df.columns else F.lit(None).cast("string")
    cells = F.array(*(F.struct(F.lit(c).alias("field"), text("a", a, c).alias("old"), text("b", b, c).alias("new")) for c in kinds if c not in keys))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    changed = F.filter(cells, lambda x: ~x["old"].eqNullSafe(x["new"]))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    rows = both.select(*(F.coalesce(F.col("a")[k], F.col("b")[k]).alias(k) for k in keys), change.alias("change"), F.explode(F.when(F.col("a").isNull() | F.col("b").isNull(), whole).otherwise(changed)).alias("x"))
    return rows.select(*keys, "change", "x.field", "x.old", "x.new")


def diff_summary(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row: added, removed, modified and unchanged keys."""
    keys = as_list(key)
    both, kinds = joined(last_of_each(a, keys), last_of_each(b, keys), keys)
    common = [c for c in kinds if c not in keys and c in a.columns and c in b.columns]
    one_sided = [c for c in kinds if c not in keys and c not in common]
    same = reduce(lambda x, y: x & y, [ordered(F.col("a")[c], kinds[c]).eqNullSafe(ordered(F.col("b")[c], kinds[c])) for c in common], F.lit(True))
    same = reduce(lambda x, y: x & y, [F.col("a" if c in a.columns else "b")[c].isNull() for c in one_sided], same)
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(paired & ~same).alias("modified"), F.count_if(paired & same).alias("unchanged"))


# --- provenance ---


def provenance(a: DataFrame, b: DataFrame, key: str | Sequence[str], schema: Schema = None, timestamp_col: str | None = None) -> DataFrame:
    """How ``merge`` decides each cell, a row for each key and field.

    Columns: the key, origin of the row ('merged', 'unique_a', 'unique_b'), field,
    source ('a_only', 'b_only', 'both_equal', 'conflict_resolved'), strategy,
    winner ('a', 'b', 'both', or 'computed' if the value is neither's), value,
    value_a, value_b (text).  Rows with a null in the key are left out.
    """
    keys, rules = as_list(key), MergeSchema.of(schema)
    a, b = last_of_each(a, keys), last_of_each(b, keys)
    both, kinds = joined(a, b, keys)
    stamp = lambda side, df: seconds(F.col(side)[timestamp_col], kinds[timestamp_col]) if timestamp_col and timestamp_col in df.columns else F.lit(0.0)
    ta, tb = stamp("a", a), stamp("b", b)
    cells = []
    for c, kind in kinds.items():
        if c in keys:
            continue
        rule = LWW() if c == timestamp_col else rules[c]
        va = F.col("a")[c] if c in a.columns else F.lit(None).cast(kind)
        vb = F.col("b")[c] if c in b.columns else F.lit(None).cast(kind)
        value = _cell(c, kind, a, b, lambda x, y, rule=rule, kind=kind: rule.pair(x, y, ta, tb, kind).cast(kind))
        text = lambda x, kind=kind: ordered(x, kind).cast("string")
        equal = text(va).eqNullSafe(text(vb))
        source = F.when(F.col("b").isNull() | (vb.isNull() & va.isNotNull()), "a_only").when(F.col("a").isNull() | (va.isNull() & vb.isNotNull()), "b_only").when(equal, "both_equal").otherwise("conflict_resolved")
        winner = F.when(source == "a_only", "a").when(source == "b_only", "b").when(source == "both_equal", "both").when(text(value).eqNullSafe(text(va)), "a").when(text(value).eqNullSafe(text(vb)), "b").otherwise("computed")
        cells.append(F.struct(F.lit(c).alias("field"), source.alias("source"), F.lit(rule.name).alias("strategy"), winner.alias("winner"), text(value).alias("value"), text(va).alias("value_a"), text(vb).alias("value_b")))
    origin = F.when(F.col("b").isNull(), "unique_a").when(F.col("a").isNull(), "unique_b").otherwise("merged")
    rows = both.select(*(F.coalesce(F.col("a")[k], F.col("b")[k]).alias(k) for k in keys), origin.alias("origin"), F.explode(F.array(*cells)).alias("x"))
    return rows.select(*keys, "origin", "x.*")


def provenance_summary(log: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row: merged, unique and all keys, and cells by source."""
    keys = as_list(key)
    row = lambda origin: F.count_distinct(F.when(F.col("origin") == origin, F.struct(*keys)))
    cell = lambda source: F.count_if(F.col("source") == source)
    return log.agg(row("merged").alias("merged_rows"), row("unique_a").alias("unique_a_rows"), row("unique_b").alias("unique_b_rows"), cell("conflict_resolved").alias("conflicts"), cell("both_equal").alias("agreements"), cell("a_only").alias("only_a"), cell("b_only").alias("only_b"))


def unmerge(merged: DataFrame, log: DataFrame, key: str | Sequence[str], remove: str) -> DataFrame:
    """Take back what side ``remove`` ('a' or 'b') gave to a merge that ``log`` recorded.

    Rows that only it had go; in the others every cell becomes the other side's.
    """
    if remove not in ("a", "b"):
        raise ValueError("remove is 'a' or 'b'")
    keys, keep = as_list(key), "b" if remove == "a" else "a"
    fields = [f for f in merged.schema if f.name not in keys]
    kept = log.where(F.col("origin") != f"unique_{remove}").groupBy(*keys).agg(*(F.max(F.when(F.col("field") == f.name, F.col(f"value_{keep}"))).alias(f.name) for f in fields))
    back = lambda f: F.from_json(F.col(f.name), f.dataType.simpleString()) if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(f.name).cast(f.dataType)
    return kept.select(*(back(f).alias(f.name) if f.name not in keys else F.col(f.name) for f in merged.schema))


def unmerge_delta(delta: DataFrame, log: DataFrame, key: str | Sequence[str], remove: str) -> DataFrame:
    """A delta without the keys that only side ``remove`` had, its other cells as the other side has them."""
    keys, keep = as_list(key), "b" if remove == "a" else "a"
    fields = [f for f in delta.schema if f.name not in [*keys, "_op"]]
    gone = log.where(F.col("origin") == f"unique_{remove}").select(*keys).distinct()
    theirs = log.where("source = 'conflict_resolved'").groupBy(*keys).agg(*(F.max(F.when(F.col("field") == f.name, F.col(f"value_{keep}"))).alias(f"__{f.name}") for f in fields))
    out = delta.join(gone, keys, "left_anti").join(theirs, keys, "left")
    return out.select(*keys, *(F.when(F.col("_op") == "removed", F.col(f.name)).otherwise(F.coalesce(F.col(f"__{f.name}").cast(f.dataType), F.col(f.name))).alias(f.name) for f in fields), "_op")


def export_log(log: DataFrame, path: str, format: str = "jsonl") -> None:
    """A provenance log as files of JSON Lines, CSV or Parquet."""
    from ..sources.files import write_table

    write_table(log, path, format)


def unmerge_residual(restored: DataFrame, log: DataFrame, key: str | Sequence[str], removed: str) -> DataFrame:
    """Keys and fields in which ``restored`` still shows a value that only the removed side had; empty if all is gone."""
    keys = as_list(key)
    fields = [f for f in restored.schema if f.name not in keys]
    cells = restored.select(*keys, F.explode(F.array(*(F.struct(F.lit(f.name).alias("field"), ordered(F.col(f.name), f.dataType).cast("string").alias("now")) for f in fields))).alias("x")).select(*keys, "x.*")
    keep = "b" if removed == "a" else "a"
    theirs = log.where(~F.col(f"value_{keep}").eqNullSafe(F.col(f"value_{removed}"))).select(*keys, "field", F.col(f"value_{removed}").alias("gone"))
    return cells.join(theirs, [*keys, "field"]).where(F.col("now").eqNullSafe(F.col("gone")) & F.col("now").isNotNull())

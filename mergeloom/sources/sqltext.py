"""SQL text of merges, to run as models of a warehouse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def _ts(alias: str, timestamp_col: str | None) -> str:
    return f"coalesce({alias}.{timestamp_col}, 0)" if timestamp_col else "0"


def cell(column: str, strategy: str, timestamp_col: str | None = None) -> str:
    """The expression that decides between a.column and b.column, both present."""
    a, b, ta, tb = f"a.{column}", f"b.{column}", _ts("a", timestamp_col), _ts("b", timestamp_col)
    name, _, argument = strategy.partition(":")
    if name == "lww":
        return f"CASE WHEN {tb} > {ta} OR ({tb} = {ta} AND {b} > {a}) THEN {b} ELSE {a} END"
    if name in ("max", "min"):
        return f"{'greatest' if name == 'max' else 'least'}({a}, {b})"
    if name == "longest":
        return f"CASE WHEN length({b}) > length({a}) OR (length({b}) = length({a}) AND ({tb} > {ta} OR ({tb} = {ta} AND {b} > {a}))) THEN {b} ELSE {a} END"
    if name == "priority":
        levels = [x.strip() for x in argument.split(",") if x.strip()]
        rank = lambda x: "CASE " + " ".join(f"WHEN {x} = '{v}' THEN {i}" for i, v in enumerate(levels, 1)) + " ELSE 0 END"
        return f"CASE WHEN {rank(b)} > {rank(a)} OR ({rank(b)} = {rank(a)} AND {b} > {a}) THEN {b} ELSE {a} END"
    raise ValueError(f"no SQL for the strategy {strategy}")


def merge_sql(left: str, right: str, keys: Sequence[str], columns: Mapping[str, str], timestamp_col: str | None = None) -> str:
    """A full outer join of two relations, every column by its strategy; runs on Spark and DuckDB."""
    out = [f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys]
    for c, s in columns.items():
        out.append(f"CASE WHEN a.{c} IS NULL THEN b.{c} WHEN b.{c} IS NULL OR a.{c} = b.{c} THEN a.{c} ELSE {cell(c, s, timestamp_col)} END AS {c}")
    if timestamp_col:
        out.append(f"greatest(a.{timestamp_col}, b.{timestamp_col}) AS {timestamp_col}")
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"SELECT {', '.join(out)} FROM {left} a FULL OUTER JOIN {right} b ON {on}"


def model(name: str, sources: Sequence[str], keys: Sequence[str], columns: Mapping[str, str], timestamp_col: str | None = None) -> str:
    """A model file that merges sources one after the other."""
    steps, last = [], f"{{{{ ref('{sources[0]}') }}}}"
    for i, s in enumerate(sources[1:], 1):
        steps.append(f"step_{i} AS (\n    {merge_sql(last, f'{{{{ ref({s!r}) }}}}', keys, columns, timestamp_col)}\n)")
        last = f"step_{i}"
    with_ = "WITH " + ",\n".join(steps) + "\n" if steps else ""
    return f"{{{{ config(materialized='table', alias='{name}') }}}}\n{with_}SELECT * FROM {last}\n"


def schema_yml(name: str, keys: Sequence[str], columns: Mapping[str, str]) -> str:
    """The model's description: keys are unique and not null."""
    lines = ["version: 2", "models:", f"  - name: {name}", "    columns:"]
    for k in keys:
        lines += [f"      - name: {k}", "        tests: [not_null" + (", unique]" if len(keys) == 1 else "]")]
    for c, s in columns.items():
        lines += [f"      - name: {c}", f"        description: merged by {s}"]
    return "\n".join(lines) + "\n"

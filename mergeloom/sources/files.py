"""Reading and writing tables by format."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".pq": "parquet", ".orc": "orc", ".arrow": "ipc", ".ipc": "ipc", ".feather": "ipc"}


def detect_format(path: str) -> str:
    """The format by the path's extension."""
    found = FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if found is None:
        raise ValueError(f"can't tell the format of {path}; known extensions are {', '.join(sorted(FORMATS))}")
    return found


def read_table(spark: SparkSession, path: str, format: str | None = None, schema=None) -> DataFrame:
    """CSV (header; types inferred without a schema), JSON (an array or one object), JSON Lines (bad lines are errors), Parquet, ORC, Arrow IPC."""
    kind = format or detect_format(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in ("csv", "tsv"):
        return reader.csv(path, header=True, inferSchema=schema is None, sep="\t" if kind == "tsv" else ",", quote='"', escape='"', multiLine=True)
    if kind == "json":
        return reader.json(path, multiLine=True)
    if kind == "jsonl":
        return reader.option("mode", "FAILFAST").json(path)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    if kind == "ipc":
        return read_ipc(spark, path)
    raise ValueError(f"unknown format {kind}")


def write_table(df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite") -> None:
    """Every format but Arrow IPC is written by all tasks, as a folder."""
    kind = format or detect_format(path)
    writer = df.write.mode(mode)
    if kind in ("csv", "tsv"):
        writer.csv(path, header=True, sep="\t" if kind == "tsv" else ",", quote='"', escape='"')
    elif kind in ("json", "jsonl"):
        writer.json(path)
    elif kind in ("parquet", "orc"):
        writer.format(kind).save(path)
    elif kind == "ipc":
        write_ipc(df, path)
    else:
        raise ValueError(f"unknown format {kind}")


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file, memory-mapped; Spark has no reader for it, so the driver reads it: for small tables."""
    import pyarrow as pa

    with pa.memory_map(path) as source:
        return spark.createDataFrame(pa.ipc.open_file(source).read_all())


def write_ipc(df: DataFrame, path: str) -> None:
    """As one Arrow IPC file, by the driver: for small tables."""
    import pyarrow as pa

    table = df.toArrow()
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)


def merge_ipc(spark: SparkSession, left: str, right: str, key: str, to: str | None = None, **how) -> DataFrame:
    """Two IPC files merged, and written if ``to`` is given."""
    from ..operators.merge import merge

    out = merge(read_ipc(spark, left), read_ipc(spark, right), key, **how)
    if to:
        write_ipc(out, to)
    return out

"""Comparable forms of cell values: time stamps, text, missing numbers, keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)


def as_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def seconds(value: Column, kind: T.DataType) -> Column:
    """A time stamp as seconds since the epoch, double.

    Numbers count as seconds, strings as numbers or ISO-8601 times (UTC unless they
    say otherwise), times as they are; null and what can't be read is 0.
    """
    if isinstance(kind, T.NumericType):
        out = value.cast("double")
    elif isinstance(kind, T.StringType):
        out = F.coalesce(value.try_cast("double"), F.unix_micros(value.try_cast("timestamp")) / 1e6)
    elif isinstance(kind, T.BooleanType):
        out = value.cast("int").cast("double")
    else:
        out = F.unix_micros(value.cast("timestamp")) / 1e6
    return F.coalesce(F.nanvl(out, F.lit(0.0)), F.lit(0.0))


def known(value: Column, kind: T.DataType) -> Column:
    """The value, with NaN as null: NaN loses against every number."""
    return F.when(~F.isnan(value), value) if isinstance(kind, FLOATS) else value


def orderable(kind: T.DataType) -> bool:
    """Whether Spark can order values of the type: not maps and variants, nor what holds them."""
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind)
    return orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def ordered(value: Column, kind: T.DataType) -> Column:
    """A form of the value that Spark can order and compare, for any type."""
    return value if orderable(kind) else F.to_json(value)


def python_text(value: Column, kind: T.DataType) -> Column:
    """The text of str() in Python, for tie-breaks that must compare as text: booleans, whole and plain decimal numbers."""
    if isinstance(kind, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(kind, FLOATS):
        # The JVM's shortest digits are Python's too; they differ in when there is an exponent, and in its form.
        short = value.cast("string")
        mantissa = F.regexp_replace(F.regexp_extract(short, r"^-?(.*)E", 1), r"\.0$", "")
        exponent = F.regexp_extract(short, r"E(-?\d+)$", 1).try_cast("int")
        digits, sign = F.replace(mantissa, F.lit("."), F.lit("")), F.when(value < 0, "-").otherwise("")
        size = F.abs(exponent).cast("string")
        scientific = F.concat(sign, mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
        whole = F.concat(sign, F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0")), F.lit("."), F.when(F.length(digits) > exponent + 1, F.substring(digits, exponent + 2, F.length(digits))).otherwise("0"))
        other = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == -float("inf"), "-inf")
        # Of the least double the JVM writes a digit more.
        other = other.when(F.abs(value) == 5e-324, F.concat(sign, F.lit("5e-324")))
        return other.when(~short.contains("E"), short).when(exponent == -4, F.concat(sign, F.lit("0.000"), digits)).when((exponent > 0) & (exponent < 16), whole).otherwise(scientific)
    return value.cast("string")


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def canonical_text(value: Column) -> Column:
    """Unicode NFC; Spark has no such function, so this is an Arrow function: use it on keys that need it only."""
    return F.pandas_udf(_nfc, "string")(value)


def canonical_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """String keys in NFC, so that composed and decomposed forms meet."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns({k: canonical_text(F.col(k)) for k in keys if k in text})


def null_key(keys: Sequence[str]) -> Column:
    """Whether any part of the key is null."""
    out = F.col(keys[0]).isNull()
    for k in keys[1:]:
        out |= F.col(k).isNull()
    return out


def last_of_each(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """One row for each whole key: the last in the order of ``order_by``, by default of all other columns.

    The window leaves rows dealt and sorted by key, as a join on the key wants
    them; rows with a null in the key are not among them.
    """
    others = [f for f in df.schema if f.name not in keys]
    order = [F.col(c).desc_nulls_last() for c in order_by] if order_by else []
    order += [ordered(F.col(f.name), f.dataType).desc_nulls_last() for f in others]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)])))
    name = "__rank"
    while name in df.columns:
        name += "_"
    return df.where(~null_key(keys)).withColumn(name, rank).where(F.col(name) == 1).drop(name)

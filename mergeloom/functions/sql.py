"""The same rules as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, return type, body.
FUNCTIONS = (
    ("merge_lww", "a STRING, b STRING, ta DOUBLE, tb DOUBLE", "STRING", "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN tb > ta OR (tb = ta AND b > a) THEN b ELSE a END"),
    ("merge_max", "a DOUBLE, b DOUBLE", "DOUBLE", "greatest(nanvl(a, CAST(NULL AS DOUBLE)), nanvl(b, CAST(NULL AS DOUBLE)))"),
    ("merge_min", "a DOUBLE, b DOUBLE", "DOUBLE", "least(nanvl(a, CAST(NULL AS DOUBLE)), nanvl(b, CAST(NULL AS DOUBLE)))"),
    ("merge_union", "a STRING, b STRING", "STRING", "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a = b THEN a ELSE array_join(array_sort(array_distinct(filter(transform(concat(split(a, ','), split(b, ',')), x -> trim(x)), x -> x <> ''))), ',') END"),
    ("merge_longest", "a STRING, b STRING", "STRING", "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN char_length(b) > char_length(a) OR (char_length(b) = char_length(a) AND b > a) THEN b ELSE a END"),
    ("merge_clock", "a MAP<STRING, BIGINT>, b MAP<STRING, BIGINT>", "MAP<STRING, BIGINT>", "map_zip_with(a, b, (k, x, y) -> greatest(coalesce(x, 0), coalesce(y, 0)))"),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, params, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]

"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL for each that SQL can express.

Replicas are derived from the tables by one text for both engines, in which
``{name}`` is a table and ``{epoch}`` seconds since the epoch of an order's date.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.strategies import Concat, LongestWins, LWW, MaxWins, MergeSchema, MinWins, Priority, UnionSet
from .operators import context, dedup, delta, governance, jsonmerge, merkle, model, sketch, state, trust
from .operators import merge as m
from .operators.schema import union_evolved
from .plans.language import MergeLanguage
from .session import shared_dir, ship
from .sources.sqltext import merge_sql
from .streaming import merge as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

A = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, {epoch} AS ts FROM {orders} WHERE o_orderkey % 5 <> 0"
B = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus,
    o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE -100 END AS o_totalprice,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
    {epoch} + ((o_orderkey % 7) - 3) * 86400 AS ts FROM {orders} WHERE o_orderkey % 5 <> 1"""
C = "SELECT o_orderkey, 'O' AS o_orderstatus, o_totalprice, o_orderpriority, {epoch} + 86400 AS ts FROM {orders} WHERE o_orderkey % 4 = 0"
TAGS_A = "SELECT p_partkey, concat(p_brand, ',', p_type) AS tags FROM {part} WHERE p_partkey % 4 <> 0"
TAGS_B = "SELECT p_partkey, concat(p_type, ',', 'x') AS tags FROM {part} WHERE p_partkey % 4 <> 1"
NODES = "SELECT user_id, event_type, user_id % 4 AS node, value, event_id, {epoch_ts} AS ts FROM {events}"
STAFF = "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, concat(c_mktsegment, '-', '%d') AS c_mktsegment FROM {customer} WHERE c_custkey %% 3 <> %d"


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = text.replace("{epoch}", "unix_seconds(cast(o_orderdate AS timestamp))").replace("{epoch_ts}", "unix_micros(cast(ts AS timestamp))")
    return spark.sql(re.sub(r"\{(\w+)\}", lambda x: f"parquet.`{sf_dir}/{x[1]}.parquet`", text))


def duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text.replace("{epoch}", "cast(epoch(o_orderdate) AS bigint)").replace("{epoch_ts}", "epoch_us(ts)"))


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ship(spark), sf_dir)
        if oracle is not None:
            ORACLES[fn.__name__] = duck(oracle)
        return fn

    return add


def sources(*texts: str) -> Callable[[SparkSession, str], list[DataFrame]]:
    return lambda spark, sf_dir: [spark_sql(spark, sf_dir, t) for t in texts]


def cell(c: str, rule: str) -> str:
    return f"CASE WHEN a.{c} IS NULL THEN b.{c} WHEN b.{c} IS NULL OR a.{c} = b.{c} THEN a.{c} ELSE {rule.replace('$', c)} END AS {c}"


def pair(key: str, cells: dict[str, str], a: str = A, b: str = B, more: str = "") -> str:
    keys = key.split(",")
    out = [f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys] + [cell(c, r) for c, r in cells.items()]
    return f"SELECT {', '.join(out)}{more} FROM ({a}) a FULL JOIN ({b}) b ON {' AND '.join(f'a.{k} = b.{k}' for k in keys)}"


BY_TIME = "CASE WHEN b.ts > a.ts OR (b.ts = a.ts AND b.$ > a.$) THEN b.$ ELSE a.$ END"
CELLS = ("o_orderstatus", "o_totalprice", "o_orderpriority")
LATER = ", greatest(a.ts, b.ts) AS ts"
FLAGSHIP = {"o_orderstatus": LWW(), "o_totalprice": MaxWins(), "o_orderpriority": MinWins()}
FLAGSHIP_SQL = {"o_orderstatus": BY_TIME, "o_totalprice": "greatest(a.$, b.$)", "o_orderpriority": "least(a.$, b.$)"}

# --- merges of two versions ---


@query(pair("o_orderkey", FLAGSHIP_SQL, more=LATER))
def merge_flagship(spark, sf_dir):
    a, b = sources(A, B)(spark, sf_dir)
    return m.merge(a, b, "o_orderkey", "ts", schema=FLAGSHIP, on_duplicate="unique")


@query(pair("o_orderkey", {c: BY_TIME for c in CELLS}, more=LATER))
def merge_lww_pair(spark, sf_dir):
    a, b = sources(A, B)(spark, sf_dir)
    return m.merge(a, b, "o_orderkey", "ts")


def _preferred(prefer: str, rule: str) -> None:
    def run(spark, sf_dir):
        a, b = (df.drop("ts") for df in sources(A, B)(spark, sf_dir))
        return m.merge(a, b, "o_orderkey", prefer=prefer)

    run.__name__ = f"merge_prefer_{prefer}"
    query(pair("o_orderkey", {c: rule for c in CELLS}))(run)


_preferred("a", "a.$")
_preferred("b", "b.$")
_preferred("latest", "greatest(a.$, b.$)")


@query(pair("o_orderkey", {"o_orderstatus": "greatest(a.$, b.$)", "o_totalprice": "least(a.$, b.$)", "o_orderpriority": "greatest(a.$, b.$)"}))
def merge_max_min(spark, sf_dir):
    a, b = (df.drop("ts") for df in sources(A, B)(spark, sf_dir))
    return m.merge(a, b, "o_orderkey", schema={"o_orderstatus": "max", "o_totalprice": "min", "o_orderpriority": "max"})


_PARTS = "list_filter(list_transform(string_split(concat(a.$, ',', b.$), ','), lambda x: trim(x)), lambda x: x <> '')"


@query(pair("p_partkey", {"tags": f"array_to_string(list_sort(list_distinct({_PARTS})), ',')"}, TAGS_A, TAGS_B))
def merge_unionset(spark, sf_dir):
    a, b = sources(TAGS_A, TAGS_B)(spark, sf_dir)
    return m.merge(a, b, "p_partkey", schema={"tags": UnionSet()})


@query(pair("p_partkey", {"tags": "CASE WHEN a.$ < b.$ THEN concat(a.$, ' | ', b.$) ELSE concat(b.$, ' | ', a.$) END"}, TAGS_A, TAGS_B))
def merge_concat(spark, sf_dir):
    a, b = sources(TAGS_A, TAGS_B)(spark, sf_dir)
    return m.merge(a, b, "p_partkey", schema={"tags": Concat()})


_RANK = "list_position(['F', 'O', 'P'], %s.$)"


@query(pair("o_orderkey", {"o_orderstatus": f"CASE WHEN {_RANK % 'b'} > {_RANK % 'a'} THEN b.$ ELSE a.$ END"}, f"SELECT o_orderkey, o_orderstatus FROM ({A})", f"SELECT o_orderkey, o_orderstatus FROM ({B})"))
def merge_priority(spark, sf_dir):
    a, b = (df.select("o_orderkey", "o_orderstatus") for df in sources(A, B)(spark, sf_dir))
    return m.merge(a, b, "o_orderkey", schema={"o_orderstatus": Priority(("F", "O", "P"))})


@query(pair("p_partkey", {"tags": "CASE WHEN length(b.$) > length(a.$) OR (length(b.$) = length(a.$) AND b.$ > a.$) THEN b.$ ELSE a.$ END"}, TAGS_A, TAGS_B))
def merge_longest(spark, sf_dir):
    a, b = sources(TAGS_A, TAGS_B)(spark, sf_dir)
    return m.merge(a, b, "p_partkey", schema={"tags": LongestWins()})


@query(pair("o_orderkey", {"o_totalprice": "(a.$ + b.$) / 2"}, f"SELECT o_orderkey, o_totalprice FROM ({A})", f"SELECT o_orderkey, o_totalprice FROM ({B})"))
def merge_custom(spark, sf_dir):
    from .functions.strategies import Custom

    a, b = (df.select("o_orderkey", "o_totalprice") for df in sources(A, B)(spark, sf_dir))
    return m.merge(a, b, "o_orderkey", schema={"o_totalprice": Custom(lambda x, y: (x + y) / 2)})


LINES_A = "SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, min(l_shipmode_) AS mode FROM (SELECT *, l_returnflag AS l_shipmode_ FROM {lineitem} WHERE l_partkey % 3 <> 0) GROUP BY l_orderkey, l_linenumber"
LINES_B = "SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_linestatus) AS mode FROM {lineitem} WHERE l_partkey % 3 <> 1 GROUP BY l_orderkey, l_linenumber"


@query(pair("l_orderkey,l_linenumber", {"l_quantity": "greatest(a.$, b.$)", "mode": "greatest(a.$, b.$)"}, LINES_A, LINES_B))
def merge_composite_key(spark, sf_dir):
    a, b = sources(LINES_A, LINES_B)(spark, sf_dir)
    return m.merge(a, b, ["l_orderkey", "l_linenumber"], schema=MergeSchema(MaxWins()), on_duplicate="unique")


NULLS = "SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS k, o_orderstatus AS s, o_totalprice AS p FROM {orders} WHERE o_orderkey % 3 <> %d"
_LAST = "SELECT k, s, p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, p DESC) AS n FROM (%s) WHERE k IS NOT NULL) WHERE n = 1"


_NULLS_A, _NULLS_B = NULLS.replace("%d", "0"), NULLS.replace("%d", "1")


@query(pair("k", {"s": "greatest(a.$, b.$)", "p": "greatest(a.$, b.$)"}, _LAST.replace("%s", _NULLS_A), _LAST.replace("%s", _NULLS_B)) + f" UNION ALL SELECT DISTINCT k, s, p FROM (SELECT * FROM ({_NULLS_A}) UNION ALL SELECT * FROM ({_NULLS_B})) WHERE k IS NULL")
def merge_nullkeys_dedup(spark, sf_dir):
    a, b = sources(_NULLS_A, _NULLS_B)(spark, sf_dir)
    return m.merge(a, b, "k", order_by=["s", "p"])


@query("SELECT DISTINCT * FROM (SELECT o_custkey, o_orderstatus, o_orderpriority FROM {orders} UNION ALL SELECT o_custkey, o_orderstatus, NULL FROM {orders} WHERE o_orderkey % 2 = 0)")
def append_dedup(spark, sf_dir):
    a = spark_sql(spark, sf_dir, "SELECT o_custkey, o_orderstatus, o_orderpriority FROM {orders}")
    return m.merge(a, spark_sql(spark, sf_dir, "SELECT o_custkey, o_orderstatus FROM {orders} WHERE o_orderkey % 2 = 0"))


@query(pair("o_orderkey", FLAGSHIP_SQL, more=LATER))
def merge_sql_text(spark, sf_dir):
    a, b = sources(A, B)(spark, sf_dir)
    a.createOrReplaceTempView("replica_a")
    b.createOrReplaceTempView("replica_b")
    return spark.sql(merge_sql("replica_a", "replica_b", ["o_orderkey"], {"o_orderstatus": "lww", "o_totalprice": "max", "o_orderpriority": "min"}, "ts"))


@query(pair("o_orderkey", FLAGSHIP_SQL, more=LATER) + " ORDER BY o_orderkey")
def merge_sorted(spark, sf_dir):
    a, b = sources(A, B)(spark, sf_dir)
    return streams.merge_sorted(a, b, "o_orderkey", FLAGSHIP, "ts")


@query(f"SELECT (SELECT count(*) FROM ({A})) AS rows_a, (SELECT count(*) FROM ({B})) AS rows_b, (SELECT count(*) FROM ({A}) a JOIN ({B}) b USING (o_orderkey)) AS merged, (SELECT count(*) FROM ({A}) a FULL JOIN ({B}) b USING (o_orderkey) WHERE a.ts IS NULL OR b.ts IS NULL) AS single")
def stream_stats(spark, sf_dir):
    a, b = sources(A, B)(spark, sf_dir)
    return streams.stream_stats(a, b, "o_orderkey")


# --- merges of many versions ---

_FOLD = """SELECT o_orderkey, arg_max(o_orderstatus, {{'t': ts, 'v': o_orderstatus}}) AS o_orderstatus, max(o_totalprice) AS o_totalprice, min(o_orderpriority) AS o_orderpriority, max(ts) AS ts
FROM ({}) GROUP BY o_orderkey"""


@query(_FOLD.format(f"{A} UNION ALL {B} UNION ALL {C}").replace("{{", "{").replace("}}", "}"))
def merge_many_fold(spark, sf_dir):
    return m.merge_many(sources(A, B, C)(spark, sf_dir), "o_orderkey", FLAGSHIP, "ts")


@query("SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice, max(l_returnflag) AS l_returnflag FROM {lineitem} GROUP BY l_orderkey, l_linenumber")
def fold_duplicates(spark, sf_dir):
    df = spark_sql(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM {lineitem}")
    return m.fold(df, ["l_orderkey", "l_linenumber"], {"l_quantity": "max", "l_extendedprice": "min", "l_returnflag": "lww"})


def _regions(spark, sf_dir, statement):
    ql = MergeLanguage(spark)
    for i, name in enumerate(("east", "west", "south")):
        ql.register(name, spark_sql(spark, sf_dir, STAFF % (i, i)))
    return ql.execute(statement)


_ALL = " UNION ALL ".join(STAFF % (i, i) for i in range(3))


@query(f"SELECT c_custkey, max(c_name) AS c_name, max(c_acctbal) AS c_acctbal, min(c_mktsegment) AS c_mktsegment FROM ({_ALL}) GROUP BY c_custkey")
def language_three_way(spark, sf_dir):
    return _regions(spark, sf_dir, "MERGE east, west, south ON c_custkey STRATEGY c_acctbal = max, c_mktsegment = min")


@query(f"SELECT c_custkey, max(c_name) AS customer, max(c_acctbal) AS c_acctbal, max(c_mktsegment) AS segment FROM ({_ALL}) WHERE (c_acctbal >= 150 AND c_mktsegment LIKE 'BUILD%-1') OR c_name IN ('x', 'y') OR (c_custkey > 700 AND NOT c_acctbal < 0) GROUP BY c_custkey ORDER BY c_custkey LIMIT 50")
def language_where_map_limit(spark, sf_dir):
    return _regions(spark, sf_dir, "MERGE east, west, south ON c_custkey WHERE (c_acctbal >= 150 AND c_mktsegment LIKE 'BUILD%-1') OR c_name IN ('x', 'y') OR (c_custkey > 700 AND NOT c_acctbal < 0) MAP c_name -> customer, c_mktsegment -> segment LIMIT 50")


@query(f"SELECT * FROM (SELECT c_custkey, max(c_name) AS c_name, max(c_acctbal) AS c_acctbal, max(c_mktsegment) AS c_mktsegment FROM ({_ALL}) GROUP BY c_custkey) WHERE c_acctbal > 9000 AND c_mktsegment IS NOT NULL")
def language_having(spark, sf_dir):
    return _regions(spark, sf_dir, "MERGE east, west, south ON c_custkey STRATEGY c_acctbal = max HAVING c_acctbal > 9000 AND c_mktsegment IS NOT NULL")


# --- schemas ---


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment FROM {customer} UNION ALL SELECT s_suppkey, s_name, s_acctbal, s_nationkey, 'none' FROM {supplier}")
def schema_evolve_union(spark, sf_dir):
    a = spark_sql(spark, sf_dir, "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, cast(c_nationkey AS int) AS nation, c_mktsegment AS segment FROM {customer}")
    b = spark_sql(spark, sf_dir, "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, cast(s_nationkey AS bigint) AS nation FROM {supplier}")
    return union_evolved(a, b, defaults={"segment": "none"})


# --- differences, provenance, deltas ---

_TEXT = {"o_orderstatus": "%s.o_orderstatus", "o_orderpriority": "%s.o_orderpriority", "o_custkey": "cast(%s.o_custkey AS varchar)"}
DA = "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM {orders} WHERE o_orderkey % 5 <> 0"
DB = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_custkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS o_custkey FROM {orders} WHERE o_orderkey % 5 <> 1"
_BOTH = f"({DA}) a FULL JOIN ({DB}) b ON a.o_orderkey = b.o_orderkey"
_LONG = " UNION ALL ".join(f"SELECT a.o_orderkey, 'modified' AS change, '{c}' AS field, {t % 'a'} AS old, {t % 'b'} AS new FROM ({DA}) a JOIN ({DB}) b ON a.o_orderkey = b.o_orderkey WHERE {t % 'a'} IS DISTINCT FROM {t % 'b'}" for c, t in _TEXT.items())


@query(f"{_LONG} UNION ALL SELECT coalesce(a.o_orderkey, b.o_orderkey), CASE WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'removed' END, NULL, NULL, NULL FROM {_BOTH} WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL")
def diff_long(spark, sf_dir):
    return m.diff(*sources(DA, DB)(spark, sf_dir), "o_orderkey")


_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in _TEXT)
_PAIRED = "a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL"


@query(f"SELECT count(*) FILTER (a.o_orderkey IS NULL) AS added, count(*) FILTER (b.o_orderkey IS NULL) AS removed, count(*) FILTER ({_PAIRED} AND NOT ({_SAME})) AS modified, count(*) FILTER ({_PAIRED} AND {_SAME}) AS unchanged FROM {_BOTH}")
def diff_summary(spark, sf_dir):
    return m.diff_summary(*sources(DA, DB)(spark, sf_dir), "o_orderkey")


def _traced(c: str, t: str) -> str:
    a, b = t % "a", t % "b"
    source = f"CASE WHEN b.o_orderkey IS NULL OR ({b} IS NULL AND {a} IS NOT NULL) THEN 'a_only' WHEN a.o_orderkey IS NULL OR ({a} IS NULL AND {b} IS NOT NULL) THEN 'b_only' WHEN {a} IS NOT DISTINCT FROM {b} THEN 'both_equal' ELSE 'conflict_resolved' END"
    greater = f"a.{c} >= b.{c}"
    return f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'unique_a' WHEN a.o_orderkey IS NULL THEN 'unique_b' ELSE 'merged' END AS origin, '{c}' AS field, {source} AS source, 'max' AS strategy,
        CASE {source} WHEN 'a_only' THEN 'a' WHEN 'b_only' THEN 'b' WHEN 'both_equal' THEN 'both' ELSE CASE WHEN {greater} THEN 'a' ELSE 'b' END END AS winner, CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL OR {greater} THEN {a} ELSE {b} END AS value, {a} AS value_a, {b} AS value_b FROM {_BOTH}"""


_LOG = " UNION ALL ".join(_traced(c, t) for c, t in _TEXT.items())


def _log(spark, sf_dir):
    return m.provenance(*sources(DA, DB)(spark, sf_dir), "o_orderkey", MergeSchema(MaxWins()))


@query(_LOG)
def provenance_long(spark, sf_dir):
    return _log(spark, sf_dir)


@query(f"SELECT count(DISTINCT o_orderkey) FILTER (origin = 'merged') AS merged_rows, count(DISTINCT o_orderkey) FILTER (origin = 'unique_a') AS unique_a_rows, count(DISTINCT o_orderkey) FILTER (origin = 'unique_b') AS unique_b_rows, count(*) FILTER (source = 'conflict_resolved') AS conflicts, count(*) FILTER (source = 'both_equal') AS agreements, count(*) FILTER (source = 'a_only') AS only_a, count(*) FILTER (source = 'b_only') AS only_b FROM ({_LOG})")
def provenance_summary(spark, sf_dir):
    return m.provenance_summary(_log(spark, sf_dir), "o_orderkey")


@query(DA)
def unmerge_source(spark, sf_dir):
    a, b = sources(DA, DB)(spark, sf_dir)
    merged = m.merge(a, b, "o_orderkey", schema=MergeSchema(MaxWins()))
    return m.unmerge(merged, _log(spark, sf_dir), "o_orderkey", "b")


@query(f"SELECT field, strategy, count(*) AS conflicts, count(*) FILTER (winner = 'a') AS won_a, count(*) FILTER (winner = 'b') AS won_b, count(*) FILTER (winner = 'computed') AS computed FROM ({_LOG}) WHERE source = 'conflict_resolved' GROUP BY ALL")
def conflict_topology(spark, sf_dir):
    return governance.conflict_topology(_log(spark, sf_dir))


@query(f"SELECT fields, count(*) AS keys FROM (SELECT o_orderkey, string_agg(field, ',' ORDER BY field) AS fields FROM ({_LOG}) WHERE source = 'conflict_resolved' GROUP BY 1) GROUP BY 1")
def conflict_clusters(spark, sf_dir):
    return governance.conflict_clusters(_log(spark, sf_dir), "o_orderkey")


_DELTA = f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, b.o_orderstatus, b.o_orderpriority, b.o_custkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS _op FROM {_BOTH} WHERE NOT ({_PAIRED} AND {_SAME})"


@query(_DELTA)
def delta_compute(spark, sf_dir):
    return delta.compute_delta(*sources(DA, DB)(spark, sf_dir), "o_orderkey")


@query(DB)
def delta_apply(spark, sf_dir):
    a, b = sources(DA, DB)(spark, sf_dir)
    return delta.apply_delta(a, delta.compute_delta(a, b, "o_orderkey"), "o_orderkey")


DC = "SELECT o_orderkey, 'O' AS o_orderstatus, o_orderpriority, o_custkey FROM {orders} WHERE o_orderkey % 4 = 0"


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey, c.o_orderkey) AS o_orderkey, c.o_orderstatus, c.o_orderpriority, c.o_custkey, CASE WHEN c.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'modified' END AS _op FROM ({DA}) a FULL JOIN ({DB}) b ON a.o_orderkey = b.o_orderkey FULL JOIN ({DC}) c ON c.o_orderkey = coalesce(a.o_orderkey, b.o_orderkey) WHERE (NOT (({_PAIRED}) AND {_SAME}) AND (a.o_orderkey IS NOT NULL OR b.o_orderkey IS NOT NULL)) OR NOT (b.o_orderkey IS NOT NULL AND c.o_orderkey IS NOT NULL AND b.o_orderstatus IS NOT DISTINCT FROM c.o_orderstatus AND b.o_orderpriority IS NOT DISTINCT FROM c.o_orderpriority AND b.o_custkey IS NOT DISTINCT FROM c.o_custkey) AND (b.o_orderkey IS NOT NULL OR c.o_orderkey IS NOT NULL)")
def delta_compose(spark, sf_dir):
    a, b, c = sources(DA, DB, DC)(spark, sf_dir)
    return delta.compose_deltas([delta.compute_delta(a, b, "o_orderkey"), delta.compute_delta(b, c, "o_orderkey")], "o_orderkey")


@query(f"SELECT cast(coalesce(a.o_orderkey, b.o_orderkey) AS varchar) AS key, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS change FROM {_BOTH} WHERE NOT ({_PAIRED} AND {_SAME})")
def merkle_diff(spark, sf_dir):
    return merkle.diff(*sources(DA, DB)(spark, sf_dir), "o_orderkey")


_CONTENT = "sha256(concat('o_custkey=+', cast(o_custkey AS varchar), chr(30), 'o_orderpriority=', CASE WHEN o_orderpriority IS NULL THEN '-' ELSE '+' || o_orderpriority END, chr(30), 'o_orderstatus=+', o_orderstatus))"


@query(f"SELECT cast(o_orderkey AS varchar) AS key, {_CONTENT} AS hash FROM ({DB})")
def merkle_leaves(spark, sf_dir):
    return merkle.leaves(sources(DB)(spark, sf_dir)[0], "o_orderkey")


@query()
def merkle_root(spark, sf_dir):
    return merkle.root(sources(DB)(spark, sf_dir)[0], "o_orderkey")


# --- deduplication ---


@query("SELECT doc_id, first, doc_id = first AS kept FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(text)) AS first FROM {documents})")
def dedup_exact_docs(spark, sf_dir):
    return dedup.exact(spark_sql(spark, sf_dir, "SELECT doc_id, text FROM {documents}"), "text", "doc_id").select("doc_id", "first", "kept")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY lower(concat(o_custkey, ' | ', o_orderstatus)) ORDER BY o_orderkey) AS n FROM {orders}) WHERE n = 1")
def dedup_records(spark, sf_dir):
    return dedup.records(spark_sql(spark, sf_dir, "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders}"), "o_orderkey", ["o_custkey", "o_orderstatus"])


_NAMES = "SELECT p_partkey, p_name FROM {part}"


@query()
def dedup_fuzzy_dice(spark, sf_dir):
    return dedup.fuzzy(spark_sql(spark, sf_dir, _NAMES), "p_name", "p_partkey", 0.85).select("p_partkey", "first", "kept")


@query()
def dedup_minhash(spark, sf_dir):
    return dedup.minhash(spark_sql(spark, sf_dir, _NAMES), "p_name", "p_partkey", 64, 0.7).select("p_partkey", "first", "kept")


# --- nested values ---


PROPS_A = "SELECT event_id, props, event_type AS tag, event_type AS other FROM {events} WHERE event_id % 5 <> 0"
PROPS_B = "SELECT event_id, props, event_type AS tag, 'seen' AS other FROM {events} WHERE event_id % 5 <> 1"
_K = "CAST({}.props->>'$.k' AS BIGINT)"


@query(f"SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce({_K.format('b')} + 1, {_K.format('a')}) AS k, list_sort(list_distinct(list_filter([a.tag, a.other, b.tag, b.other], lambda x: x IS NOT NULL))) AS tags FROM ({PROPS_A}) a FULL JOIN ({PROPS_B}) b ON a.event_id = b.event_id")
def json_merge_props(spark, sf_dir):
    nested = lambda df, add: df.select("event_id", F.struct((F.from_json("props", "k bigint")["k"] + add).alias("k"), F.array("tag", "other").alias("tags")).alias("doc"))
    a, b = sources(PROPS_A, PROPS_B)(spark, sf_dir)
    merged = jsonmerge.merge_lines(nested(a, 0), nested(b, 1), "event_id")
    return merged.select("event_id", "doc.k", F.array_sort(F.array_distinct("doc.tags")).alias("tags"))


@query(pair("o_orderkey", {"o_orderstatus": "b.$", "o_orderpriority": "b.$", "o_custkey": "b.$"}, DA, DB))
def jsonl_merge(spark, sf_dir):
    return jsonmerge.merge_lines(*sources(DA, DB)(spark, sf_dir), "o_orderkey")


# --- replicated state ---

_COUNTS = "SELECT event_type AS counter, user_id % 4 AS node, count(*) AS n FROM {events} WHERE event_id % {m} <> {r} GROUP BY event_type, user_id % 4"


def _replica(mod: int, rest: int) -> str:
    return _COUNTS.replace("{m}", str(mod)).replace("{r}", str(rest))


@query(f"SELECT counter, sum(n)::BIGINT AS value FROM (SELECT counter, node, max(n) AS n FROM ({_replica(2, 0)} UNION ALL {_replica(3, 1)}) GROUP BY ALL) GROUP BY counter")
def gcounter(spark, sf_dir):
    a, b = sources(_replica(2, 0), _replica(3, 1))(spark, sf_dir)
    return state.gcounter_value(a.unionByName(b))


_SIGNED = "SELECT user_id AS counter, user_id % 4 AS node, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS sign, count(*) AS n FROM {events} GROUP BY ALL"


@query(f"SELECT counter, sum(n * sign)::BIGINT AS value FROM ({_SIGNED}) GROUP BY counter")
def pncounter(spark, sf_dir):
    return state.pncounter_value(spark_sql(spark, sf_dir, _SIGNED))


_BEST = "SELECT user_id, event_type, value, cast(ts AS double) AS ts, node FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, node DESC, value DESC) AS n FROM (%s)) WHERE n = 1"


@query(_BEST.replace("%s", NODES))
def lww_register(spark, sf_dir):
    return state.register_merge(spark_sql(spark, sf_dir, NODES), ["user_id", "event_type"])


@query(f"SELECT r.user_id, r.value, r.ts, r.node FROM (SELECT user_id, value, cast(ts AS double) AS ts, node FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, node DESC, value DESC) AS n FROM ({NODES}) WHERE event_type <> 'error') WHERE n = 1) r LEFT JOIN (SELECT user_id, max(ts) AS gone FROM ({NODES}) WHERE event_type = 'error' GROUP BY user_id) d USING (user_id) WHERE gone IS NULL OR r.ts > gone")
def lww_map(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, NODES)
    return state.lwwmap_merge(rows.where("event_type <> 'error'"), rows.where("event_type = 'error'"), "user_id")


_TAGS = "SELECT user_id AS set, event_type AS element, event_id AS tag FROM {events}"


@query(f"SELECT DISTINCT set, element FROM ({_TAGS}) WHERE NOT (element = 'click' AND tag % 3 <> 0)")
def orset(spark, sf_dir):
    tags = spark_sql(spark, sf_dir, _TAGS)
    return state.orset_elements(tags, tags.where("element = 'click' AND tag % 3 <> 0"))


_CLOCK = "SELECT user_id, user_id % 4 AS node, event_type, count(*) AS n FROM {events} WHERE event_id % {m} <> {r} GROUP BY ALL"


def _clocks(mod: int, rest: int) -> str:
    return _CLOCK.replace("{m}", str(mod)).replace("{r}", str(rest))


@query(f"SELECT user_id, CASE WHEN bool_or(x < y) AND bool_or(x > y) THEN 'concurrent' WHEN bool_or(x < y) THEN 'before' WHEN bool_or(x > y) THEN 'after' ELSE 'equal' END AS relation, sum(greatest(x, y))::BIGINT AS merged FROM (SELECT user_id, event_type, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM ({_clocks(3, 0)}) a FULL JOIN ({_clocks(3, 1)}) b USING (user_id, event_type)) GROUP BY user_id")
def vector_clock_compare(spark, sf_dir):
    a, b = (df.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(c)) for df, c in zip(sources(_clocks(3, 0), _clocks(3, 1))(spark, sf_dir), "ab", strict=True))
    empty = F.create_map().cast("map<string,bigint>")
    both = a.join(b, "user_id", "full_outer").select("user_id", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    total = F.aggregate(F.map_values(state.clock_merge(F.col("a"), F.col("b"))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return both.select("user_id", state.clock_compare(F.col("a"), F.col("b")).alias("relation"), total.alias("merged"))


_GOSSIP = "SELECT user_id AS key, event_type AS value, event_type = 'error' AS tombstone FROM {events}"


@query(f"SELECT key, max(value) AS value FROM ({_GOSSIP}) GROUP BY key")
def gossip_merge(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, _GOSSIP).withColumn("clock", F.create_map(F.col("value"), F.lit(1).cast("bigint")))
    return state.gossip_merge(rows).select("key", "value")


_FACTS = "SELECT user_id AS key, event_type AS value, value AS confidence, concat('agent', cast(user_id % 4 AS string)) AS source_agent, cast({epoch_ts} AS double) AS timestamp FROM {events}"


@query(f"SELECT key, value, confidence, source_agent, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY timestamp DESC, source_agent DESC, confidence DESC, value DESC) AS n FROM ({_FACTS})) WHERE n = 1")
def agent_facts(spark, sf_dir):
    return state.agent_facts(spark_sql(spark, sf_dir, _FACTS))


_SAID = "SELECT conv_id, role AS agent, text AS message, turn AS timestamp FROM {conversations}"


@query(f"SELECT conv_id, agent, message, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY timestamp DESC, agent DESC, message DESC) AS n FROM (SELECT DISTINCT * FROM ({_SAID}))) WHERE n <= 3")
def agent_messages(spark, sf_dir):
    return state.agent_messages(spark_sql(spark, sf_dir, _SAID), ["conv_id"], 3)


# --- sketches ---


@query()
def hll(spark, sf_dir):
    return sketch.hll_count(sketch.hll(spark_sql(spark, sf_dir, "SELECT event_type, user_id FROM {events}"), ["event_type"], "user_id")).select("event_type", "estimate")


@query("SELECT user_id, count(*) AS estimate FROM {events} GROUP BY user_id")
def cms(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, "SELECT user_id FROM {events}")
    # So wide that no two users share all cells: the sketch is then exact.
    return sketch.cms_estimate(rows, "user_id", sketch.cms(rows, "user_id", 1 << 20, 7), 1 << 20, 7)


@query("SELECT c_custkey, c_custkey % 2 = 0 AS maybe FROM {customer}")
def bloom_membership(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, "SELECT c_custkey FROM {customer}")
    bits, hashes = 1 << 28, 4
    return sketch.bloom_contains(rows, "c_custkey", sketch.bloom(rows.where("c_custkey % 2 = 0"), "c_custkey", bits, hashes), bits, hashes)


# --- agent memories ---

_MEMORY = "SELECT d.text AS fact, cast(l.quality AS double) AS confidence, d.source AS source, cast(d.doc_id AS double) + 1 AS ts, d.lang AS topic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"


@query(f"SELECT substr(sha256(fact), 1, 16) AS fact_id, fact, max(topic) AS topic, max(source) AS source, max(confidence) AS confidence, max(ts) AS ts FROM ({_MEMORY}) GROUP BY fact HAVING max(confidence) >= 0.5 ORDER BY confidence DESC, fact LIMIT 100")
def context_merge_budget(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, _MEMORY)
    return context.merge_contexts([rows.where("ts % 2 = 0"), rows.where("ts % 2 = 1")], 0.5, 100).select("fact_id", "fact", "topic", "source", "confidence", "ts")


@query(f"SELECT substr(sha256(fact), 1, 16) AS fact_id, topic, source FROM ({_MEMORY}) WHERE topic = 'fr' AND confidence >= 1")
def context_query(spark, sf_dir):
    return context.query(context.memories(spark_sql(spark, sf_dir, _MEMORY)), topic="fr", min_confidence=1.0).select("fact_id", "topic", "source")


@query(f"SELECT count(*) AS facts, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, round(avg(confidence), 9) AS quality, min(ts) AS first_ts, max(ts) AS last_ts FROM ({_MEMORY})")
def context_manifest(spark, sf_dir):
    return context.manifest(context.memories(spark_sql(spark, sf_dir, _MEMORY)))


# --- trust ---

_DIMS = "list_value(" + ", ".join(f"'{d}'" for d in trust.DIMENSIONS) + ")"
_EVIDENCE = "SELECT user_id % 10 AS peer, CASE event_type WHEN 'click' THEN 'integrity' WHEN 'view' THEN 'causality' WHEN 'error' THEN 'consistency' WHEN 'signup' THEN 'gossip' ELSE 'model' END AS dimension, user_id AS observer, value / 20000 AS evidence FROM {events}"
_TRUST = f"SELECT peer, dimension, CASE WHEN s IS NULL THEN 0.5 ELSE greatest(0, 1 - s) END AS trust FROM (SELECT DISTINCT peer, unnest({_DIMS}) AS dimension FROM ({_EVIDENCE})) LEFT JOIN (SELECT peer, dimension, sum(e) AS s FROM (SELECT peer, dimension, observer, max(evidence) AS e FROM ({_EVIDENCE}) GROUP BY ALL) GROUP BY ALL) USING (peer, dimension)"


def _trusts(spark, sf_dir):
    return trust.trust(spark_sql(spark, sf_dir, _EVIDENCE))


@query(f"SELECT peer, dimension, round(trust, 9) AS trust FROM ({_TRUST})")
def trust_scores(spark, sf_dir):
    return _trusts(spark, sf_dir).withColumn("trust", F.round("trust", 9))


@query(f"SELECT peer, round(t, 9) AS trust, CASE WHEN t > 0.8 THEN 0 WHEN t > 0.4 THEN 1 WHEN t > 0.1 THEN 2 ELSE 3 END AS level FROM (SELECT peer, round(avg(trust), 12) AS t FROM ({_TRUST}) GROUP BY peer)")
def trust_levels(spark, sf_dir):
    return trust.overall(_trusts(spark, sf_dir)).withColumn("trust", F.round("trust", 9))


_ENTRIES = "SELECT event_type AS key, user_id % 10 AS peer, value, cast(event_id AS double) AS ts FROM {events}"
_WEIGHTED = f"SELECT e.*, coalesce(t.trust, 0.5) AS w FROM ({_ENTRIES}) e LEFT JOIN (SELECT user_id AS peer, 0.15 + user_id / 20.0 AS trust FROM range(9) r(user_id)) t USING (peer)"


def _peers(spark):
    return spark.range(9).select(F.col("id").alias("peer"), (0.15 + F.col("id") / 20.0).alias("trust"))


@query(f"SELECT key, value, ts, peer FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts * (1 + 0.1 * w) DESC, w DESC, peer DESC, value DESC) AS n FROM ({_WEIGHTED})) WHERE n = 1")
def trust_lww(spark, sf_dir):
    return trust.trust_lww(spark_sql(spark, sf_dir, _ENTRIES), _peers(spark), "key").select("key", "value", "ts", "peer")


_SPREAD = f"SELECT *, count(*) OVER k AS n, sum(w * value) OVER k / sum(w) OVER k AS mean FROM ({_WEIGHTED}) WINDOW k AS (PARTITION BY key)"


@query(f"SELECT key, round(sum(w * value) / sum(w), 6) AS value, count(*) AS peers FROM (SELECT *, sum(w * (value - mean) ** 2) OVER k / sum(w) OVER k AS var FROM ({_SPREAD}) WINDOW k AS (PARTITION BY key)) WHERE n <= 2 OR var = 0 OR abs(value - mean) <= 3 * sqrt(var) GROUP BY key")
def trust_avg(spark, sf_dir):
    return trust.trust_average(spark_sql(spark, sf_dir, _ENTRIES), _peers(spark), "key").select("key", F.round("value", 6).alias("value"), "peers")


# --- model weights: vectors as models, labels as layers ---

_MODELS = "SELECT vec_id AS model_id, label AS layer, pos, w FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS w FROM {embeddings})"
_BASE = f"SELECT layer, pos, avg(w) AS b FROM ({_MODELS}) GROUP BY ALL"


def _models(spark, sf_dir):
    return model.explode_tensors(spark_sql(spark, sf_dir, "SELECT vec_id AS model_id, label AS layer, embedding AS tensor FROM {embeddings}"))


def _model_base(df):
    return df.groupBy("layer", "pos").agg(F.avg("w").alias("w"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("layer", "pos", F.round("w", 6).alias("w"))


@query(f"SELECT layer, pos, round(avg(w), 6) AS w FROM ({_MODELS}) GROUP BY ALL")
def model_weight_average(spark, sf_dir):
    return _rounded(model.weight_average(_models(spark, sf_dir)))


@query(f"SELECT layer, pos, round(first(b) + 0.5 * sum(w - b), 6) + 0.0 AS w FROM ({_MODELS}) JOIN (SELECT layer, pos, min(w) AS b FROM ({_MODELS}) GROUP BY ALL) USING (layer, pos) GROUP BY ALL")
def model_task_arithmetic(spark, sf_dir):
    df = _models(spark, sf_dir)
    return _rounded(model.task_arithmetic(df, df.groupBy("layer", "pos").agg(F.min("w").alias("w")), 0.5))


_TAU = f"SELECT *, w - b AS t, 1.0 / count(*) OVER (PARTITION BY layer, pos) AS wt FROM ({_MODELS}) JOIN (SELECT layer, pos, min(w) AS b FROM ({_MODELS}) GROUP BY ALL) USING (layer, pos)"


@query(f"SELECT layer, pos, round(first(b) + coalesce(sum(wt * t) FILTER (sign(t) = s AND t <> 0), 0) / greatest(count(*) FILTER (sign(t) = s AND t <> 0), 1), 6) + 0.0 AS w FROM (SELECT layer, pos, b, wt, t, sign(sum(sign(t)) OVER (PARTITION BY layer, pos)) AS s FROM (SELECT layer, pos, b, wt, CASE WHEN abs(t) >= cut THEN t ELSE 0 END AS t FROM ({_TAU}) JOIN (SELECT model_id, layer, quantile_cont(abs(t), 0.8) AS cut FROM ({_TAU}) WHERE t <> 0 GROUP BY ALL) USING (model_id, layer))) GROUP BY ALL")
def model_ties(spark, sf_dir):
    df = _models(spark, sf_dir)
    return _rounded(model.ties(df, df.groupBy("layer", "pos").agg(F.min("w").alias("w"))))


@query(f"SELECT layer, pos, round(sum(w ** 3) / greatest(sum(w ** 2), 1e-12), 6) + 0.0 AS w FROM ({_MODELS}) GROUP BY ALL")
def model_fisher(spark, sf_dir):
    return _rounded(model.fisher(_models(spark, sf_dir)))


@query(f"SELECT layer, pos, round(sum((w ** 2 + 0.01) * w) / greatest(sum(w ** 2 + 0.01), 1e-12), 6) + 0.0 AS w FROM ({_MODELS}) GROUP BY ALL")
def model_regression_mean(spark, sf_dir):
    return _rounded(model.regression_mean(_models(spark, sf_dir)))


@query(f"SELECT layer, pos, round(sum((model_id % 7 + 1) * w) / sum(model_id % 7 + 1), 6) + 0.0 AS w FROM ({_MODELS}) GROUP BY ALL")
def model_fedavg(spark, sf_dir):
    return _rounded(model.fedavg(_models(spark, sf_dir).withColumn("n", F.col("model_id") % 7 + 1)))


@query(f"SELECT layer, pos, round(min_by(w, {{'d': d, 'w': w}}), 6) + 0.0 AS w FROM (SELECT *, abs(w - avg(w) OVER (PARTITION BY layer, pos)) AS d FROM ({_MODELS})) GROUP BY ALL".replace("{{", "{").replace("}}", "}"))
def model_led_merge(spark, sf_dir):
    return _rounded(model.led_merge(_models(spark, sf_dir)))


_VAR = f"SELECT layer, pos, avg(w) AS m, var_pop(w) AS v FROM ({_MODELS}) GROUP BY ALL"
_CUT = f"SELECT layer, v AS cut FROM (SELECT *, count(*) OVER (PARTITION BY layer) AS n, row_number() OVER (PARTITION BY layer ORDER BY v DESC, pos) AS r FROM ({_VAR})) WHERE r = greatest(1, floor(n * 0.1))"


@query(f"SELECT layer, pos, round(CASE WHEN v >= cut THEN 0 ELSE m END, 6) + 0.0 AS w FROM ({_VAR}) JOIN ({_CUT}) USING (layer)")
def model_safe_merge(spark, sf_dir):
    df = _models(spark, sf_dir)
    return _rounded(model.safe_merge(df, df.select("layer", "pos").distinct().withColumn("w", F.lit(0.0))))


@query(f"SELECT layer, round(least(1, avg(v) / greatest(avg(a) ** 2, 1e-12)), 6) AS conflict, round(avg(v), 6) AS variance FROM (SELECT layer, pos, var_pop(w) AS v, avg(abs(w)) AS a FROM ({_MODELS}) GROUP BY ALL) GROUP BY layer")
def conflict_heatmap(spark, sf_dir):
    return model.conflict_heatmap(_models(spark, sf_dir)).select("layer", F.round("conflict", 6).alias("conflict"), F.round("variance", 6).alias("variance"))


@query(f"SELECT layer, round(var_pop(m), 9) AS variance, var_pop(m) > 0.1 AS critical FROM (SELECT layer, model_id, avg(w) AS m FROM ({_MODELS}) GROUP BY ALL) GROUP BY layer")
def model_safety(spark, sf_dir):
    return model.safety(_models(spark, sf_dir)).withColumn("variance", F.round("variance", 9))


@query()
def model_slerp(spark, sf_dir):
    return _rounded(model.slerp(_models(spark, sf_dir)))


@query()
def model_dare_ties(spark, sf_dir):
    df = _models(spark, sf_dir)
    return _rounded(model.dare_ties(df, _model_base(df)))


# --- governance ---

_OPS = "SELECT event_type AS op, value AS ms, user_id AS rows, user_id % 3 AS conflicts, event_type <> 'error' OR event_id % 2 = 0 AS ok FROM {events}"


@query(f"SELECT op, count(*) AS n, round(avg(ms), 6) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, sum(rows)::BIGINT AS rows, sum(conflicts)::BIGINT AS conflicts, round(sum(conflicts) / sum(rows), 9) AS conflict_rate, round(count(*) FILTER (NOT ok) / count(*), 9) AS error_rate FROM ({_OPS}) GROUP BY op")
def metrics_summary(spark, sf_dir):
    out = governance.metrics(spark_sql(spark, sf_dir, _OPS), ["op"])
    return out.withColumns({c: F.round(c, 6) for c in ("avg_ms", "p95_ms")}).withColumns({c: F.round(c, 9) for c in ("conflict_rate", "error_rate")})


_STATS = "SELECT 'o_totalprice' AS field, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM ({}) UNION ALL SELECT 'ts', avg(ts), stddev_pop(ts) FROM ({})"


@query(f"SELECT field, round(x.m, 3) AS mean_before, round(y.m, 3) AS mean_after, abs(y.m - x.m) / x.s > 2 AS drifted FROM ({_STATS.format(A, A)}) x JOIN ({_STATS.format(B, B)}) y USING (field)")
def drift_check(spark, sf_dir):
    a, b = (df.select("o_totalprice", "ts") for df in sources(A, B)(spark, sf_dir))
    return governance.drift(a, b).select("field", F.round("mean_before", 3).alias("mean_before"), F.round("mean_after", 3).alias("mean_after"), "drifted")


_EMAIL = governance.PATTERNS["email"]


@query(f"SELECT 'text' AS field, 'email' AS kind, count(*) FILTER (regexp_matches(text, '{_EMAIL}')) AS rows FROM {{documents}}")
def personal_data_scan(spark, sf_dir):
    return governance.personal_data(spark_sql(spark, sf_dir, "SELECT text FROM {documents}"), patterns={"email": _EMAIL})


@query("SELECT o_orderkey, max(o_totalprice) AS o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM ({a}) UNION ALL SELECT o_orderkey, o_totalprice FROM ({b})) GROUP BY o_orderkey".replace("{a}", A).replace("{b}", B))
def max_register(spark, sf_dir):
    a, b = sources(A, B)(spark, sf_dir)
    return state.max_register(a.unionByName(b), "o_orderkey", "o_totalprice")


EA, EB = (f"SELECT user_id AS key, cast(count(*) AS string) AS value FROM {{events}} WHERE event_id % 3 <> {i} GROUP BY user_id" for i in (0, 1))


@query(f"SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'push' WHEN a.key IS NULL THEN 'pull' ELSE 'both' END AS direction FROM ({EA}) a FULL JOIN ({EB}) b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
def anti_entropy(spark, sf_dir):
    side = lambda df: state.gossip_digest(df.withColumn("clock", F.create_map(F.lit("n"), F.lit(1).cast("bigint"))).withColumn("tombstone", F.lit(False)))
    return state.anti_entropy(*map(side, sources(EA, EB)(spark, sf_dir)))


def _step(old: str, new: str, n: int) -> str:
    same = " AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in ("o_orderstatus", "o_orderpriority", "o_custkey"))
    return f"SELECT coalesce(x.o_orderkey, y.o_orderkey) AS o_orderkey, {n} AS n, CASE WHEN x.o_orderkey IS NULL THEN 'added' WHEN y.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS _op FROM ({old}) x FULL JOIN ({new}) y ON x.o_orderkey = y.o_orderkey WHERE x.o_orderkey IS NULL OR y.o_orderkey IS NULL OR NOT ({same})"


@query(f"SELECT o_orderkey, 1 AS n, 'added' AS _op FROM ({DA}) UNION ALL {_step(DA, DB, 2)} UNION ALL {_step(DB, DC, 3)}")
def version_history(spark, sf_dir):
    states = [df.withColumn("n", F.lit(i)) for i, df in enumerate(sources(DA, DB, DC)(spark, sf_dir), 1)]
    return delta.version_history(states[0].unionByName(states[1]).unionByName(states[2]), "o_orderkey", "n")


@query(f"SELECT count(*) AS rows, count(DISTINCT key) AS keys FROM ({_ENTRIES}) WHERE peer IN (SELECT peer FROM ({_TRUST}) WHERE dimension = 'gossip' AND trust >= 0.4)")
def trust_gate(spark, sf_dir):
    kept = trust.trust_gate(spark_sql(spark, sf_dir, _ENTRIES), _trusts(spark, sf_dir), {"gossip": 0.4})
    return kept.agg(F.count("*").alias("rows"), F.count_distinct("key").alias("keys"))


@query(f"SELECT peer, dimension, round(CASE WHEN s > 0 THEN least(1, greatest(0, trust * n / s)) ELSE trust END, 9) AS trust FROM (SELECT *, sum(trust) OVER d AS s, count(*) OVER d AS n FROM ({_TRUST}) WINDOW d AS (PARTITION BY dimension))")
def trust_normalise(spark, sf_dir):
    return trust.normalise(_trusts(spark, sf_dir)).withColumn("trust", F.round("trust", 9))


_SERIES = "SELECT user_id % 10 AS peer, event_id % 50 AS at, avg(value) AS value FROM {events} GROUP BY ALL"


@query(f"SELECT x.peer AS a, y.peer AS b, round(corr(x.value, y.value), 6) AS corr, count(*) AS n FROM ({_SERIES}) x JOIN ({_SERIES}) y ON x.at = y.at AND x.peer < y.peer GROUP BY ALL")
def trust_collusion(spark, sf_dir):
    return trust.collusion(spark_sql(spark, sf_dir, _SERIES), "peer", "at", "value", -1.0).withColumn("corr", F.round("corr", 6))


@query(f"SELECT key, count(*) FILTER (abs(value) <= 400) AS sized, count(*) FILTER (abs(value - m) <= s) AS near FROM (SELECT *, avg(value) OVER k AS m, stddev_pop(value) OVER k AS s FROM ({_ENTRIES}) WINDOW k AS (PARTITION BY key)) GROUP BY key")
def trust_semantic_checks(spark, sf_dir):
    checked = trust.semantic_checks(spark_sql(spark, sf_dir, _ENTRIES), "key", 400, 1.0)
    return checked.groupBy("key").agg(F.count_if("magnitude_ok").alias("sized"), F.count_if("shift_ok").alias("near"))


@query(f"SELECT key, n, round(max(greatest(abs(i / n - f), abs((i - 1) / n - f))), 6) AS distance FROM (SELECT key, count(*) OVER k AS n, row_number() OVER (PARTITION BY key ORDER BY value) AS i, 1 - exp(-value / avg(value) OVER k) AS f FROM ({_ENTRIES}) WINDOW k AS (PARTITION BY key)) GROUP BY ALL")
def trust_waiting_times(spark, sf_dir):
    return trust.exponential_distance(spark_sql(spark, sf_dir, _ENTRIES), "value", ["key"]).withColumn("distance", F.round("distance", 6))


def _largest(keep: float) -> str:
    return f"SELECT layer, pos, b, wt, CASE WHEN abs(t) >= cut THEN t ELSE 0 END AS t FROM ({_TAU}) JOIN (SELECT model_id, layer, quantile_cont(abs(t), {1 - keep}) AS cut FROM ({_TAU}) GROUP BY ALL) USING (model_id, layer)"


def _least(df):
    return df.groupBy("layer", "pos").agg(F.min("w").alias("w"))


@query(f"SELECT layer, pos, round(first(b) + sum(wt * t), 6) + 0.0 AS w FROM ({_largest(0.25)}) GROUP BY ALL")
def model_breadcrumbs(spark, sf_dir):
    df = _models(spark, sf_dir)
    return _rounded(model.breadcrumbs(df, _least(df), 0.75))


@query(f"SELECT layer, pos, round(b + m * CASE WHEN active > 0 THEN least(n / active, 4) ELSE 1 END, 6) + 0.0 AS w FROM (SELECT *, count(*) OVER k AS n, count(*) FILTER (m <> 0) OVER k AS active FROM (SELECT layer, pos, first(b) AS b, sum(wt * t) AS m FROM ({_largest(0.25)}) GROUP BY ALL) WINDOW k AS (PARTITION BY layer))")
def model_emr(spark, sf_dir):
    df = _models(spark, sf_dir)
    return _rounded(model.emr(df, _least(df), 0.25))


@query(f"SELECT layer, pos, round(0.75 * min(w) + 0.25 * max(w), 6) + 0.0 AS w FROM ({_MODELS}) GROUP BY ALL")
def model_linear(spark, sf_dir):
    df = _models(spark, sf_dir)
    return _rounded(model.linear(_least(df), df.groupBy("layer", "pos").agg(F.max("w").alias("w")), 0.25))


@query(f"SELECT layer, pos, round(first(b) - 0.5 * avg(t), 6) + 0.0 AS w FROM ({_TAU}) GROUP BY ALL")
def model_negative(spark, sf_dir):
    df = _models(spark, sf_dir)
    return _rounded(model.negative(df, _least(df), 0.5))


@query(f"SELECT layer, pos, round(CASE WHEN abs(m - b) > cut THEN b ELSE m END, 6) + 0.0 AS w FROM (SELECT *, quantile_cont(abs(m - b), 0.9) OVER (PARTITION BY layer) AS cut FROM (SELECT layer, pos, avg(w) AS m, first(b) AS b FROM ({_TAU}) GROUP BY ALL))")
def model_split_unlearn(spark, sf_dir):
    df = _models(spark, sf_dir)
    return _rounded(model.split_unlearn(df, _least(df)))


@query(f"SELECT layer, pos, round(avg(w - 0.2 * (w - b)), 6) + 0.0 AS w FROM ({_TAU}) GROUP BY ALL")
def model_fedprox(spark, sf_dir):
    df = _models(spark, sf_dir)
    return _rounded(model.fedprox(df.withColumn("n", F.lit(3)), _least(df), 0.2))


_AGED = f"SELECT *, 0.5 ** (model_id % 4) AS wt FROM ({_MODELS})"


@query(f"SELECT layer, pos, round(sum(wt * w) / (SELECT sum(wt) FROM (SELECT DISTINCT model_id, wt FROM ({_AGED}))), 6) + 0.0 AS w FROM ({_AGED}) GROUP BY ALL")
def model_continual(spark, sf_dir):
    return _rounded(model.continual(_models(spark, sf_dir).withColumn("age", F.col("model_id") % 4), "age", 0.5))


SA, SB = (f"SELECT o_orderkey, o_orderstatus, ts FROM ({t})" for t in (A, B))


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL OR b.ts > a.ts THEN b.o_orderstatus WHEN b.o_orderkey IS NULL OR a.ts > b.ts OR a.o_orderstatus = b.o_orderstatus THEN a.o_orderstatus ELSE 'tie' END AS o_orderstatus FROM ({SA}) a FULL JOIN ({SB}) b ON a.o_orderkey = b.o_orderkey")
def merge_encrypted(spark, sf_dir):
    key = F.lit("0123456789abcdef")
    a, b = (governance.encrypt_columns(df, ["o_orderstatus"], key) for df in sources(SA, SB)(spark, sf_dir))
    out = governance.decrypt_columns(governance.merge_encrypted(a, b, "o_orderkey", "ts", ["o_orderstatus"]), {"o_orderstatus": "string"}, key).drop("ts")
    # At the same time ciphertexts have no order that means anything.
    ties = a.select("o_orderkey", F.col("ts").alias("x"), F.col("o_orderstatus__tag").alias("p")).join(b.select("o_orderkey", F.col("ts").alias("y"), F.col("o_orderstatus__tag").alias("q")), "o_orderkey").where("x = y and p <> q").select("o_orderkey", F.lit(True).alias("tie"))
    return out.join(ties, "o_orderkey", "left").select("o_orderkey", F.when(F.col("tie"), "tie").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query(f"SELECT bucket, count(*) AS facts FROM (SELECT DISTINCT ('0x' || substr(sha256(fact), 1, 8))::BIGINT % 64 AS bucket, fact FROM ({_MEMORY})) GROUP BY bucket")
def context_blocks(spark, sf_dir):
    """Blocks of merged memories; what SQL tells of them is how many facts each bucket has."""
    packed = context.blocks(context.merge_sidecars(context.memories(spark_sql(spark, sf_dir, _MEMORY))), 1000)
    bucket = F.pmod(F.conv(F.substring("fact_id", 1, 8), 16, 10).cast("long"), F.lit(64)).alias("bucket")
    return packed.groupBy(bucket).agg(F.sum(F.lit(1)).alias("facts"))


@query(f"SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM ({A}) GROUP BY o_orderpriority")
def exact_sum(spark, sf_dir):
    return sources(A)(spark, sf_dir)[0].groupBy("o_orderpriority").agg(F.round(trust.exact_sum(F.col("o_totalprice")), 2).alias("total"))


# --- streams ---


@query(_BEST.replace("%s", NODES).replace("SELECT user_id, event_type, value, cast(ts AS double) AS ts, node FROM", "SELECT user_id, event_type, value, ts FROM").replace("ORDER BY ts DESC, node DESC, value DESC", "ORDER BY ts DESC, value DESC"))
def stream_upsert_events(spark, sf_dir):
    """A stream of files, folded batch by batch into a store."""
    import uuid

    from .sources.store import MergeStore

    at = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    rows = spark_sql(spark, sf_dir, NODES).select("user_id", "event_type", "value", "ts")
    rows.repartition(3, "event_type").write.parquet(f"{at}/in")
    store = MergeStore(spark, f"{at}/store", ["user_id", "event_type"], None, "ts")
    streams.upsert_stream(streams.read_events(spark, f"{at}/in", rows.schema), store, f"{at}/state").awaitTermination()
    return store.read()


from . import catalogue_more  # noqa: E402, F401

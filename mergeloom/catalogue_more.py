"""Further queries over the driver's tables: sources and stores, checks, sketches, models, streams.

Where a query checks bounds it returns booleans, which SQL states as true.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalogue as c
from .catalogue import query, sources, spark_sql
from .functions import sql as functions_sql
from .functions.strategies import MergeSchema
from .functions.values import canonical_keys
from .operators import context, dedup, delta, governance, jsonmerge, laws, merkle, model, sketch, state, trust, wire
from .operators import merge as m
from .plans.language import MergeLanguage
from .session import shared_dir
from .sources import files
from .sources.records import RecordDestination
from .sources.snapshots import Snapshots
from .sources.store import ClockedTable, MergeStore
from .streaming import merge as streams


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- files ---

_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM {customer}"


def _round_trip(kind: str) -> None:
    def run(spark, sf_dir):
        df = spark_sql(spark, sf_dir, _CUSTOMERS)
        path = f"{_folder(spark, 'files')}.{kind}"
        if kind in ("arrow", "feather"):
            path = path.removeprefix("file://")
        files.write_table(df, path)
        back = files.read_table(spark, path)
        return back.select(*(F.col(f.name).cast(f.dataType) for f in df.schema))

    run.__name__ = f"source_{kind}"
    query(_CUSTOMERS)(run)


for _kind in ("csv", "tsv", "jsonl", "parquet", "orc"):
    _round_trip(_kind)


@query("SELECT r_regionkey, r_name, r_regionkey + 1 AS n FROM {region}")
def source_ipc_merge(spark, sf_dir):
    """Two Arrow files merged; Spark has no reader for them, so the driver holds these few rows."""
    at = _folder(spark, "ipc").removeprefix("file://")
    region = spark_sql(spark, sf_dir, "SELECT r_regionkey, r_name, r_regionkey AS n FROM {region}")
    files.write_table(region, f"{at}-a.arrow")
    files.write_table(region.withColumn("n", F.col("n") + 1), f"{at}-b.arrow")
    return files.merge_ipc(spark, f"{at}-a.arrow", f"{at}-b.arrow", "r_regionkey", schema={"n": "max"})


# --- stores ---

_FOLDED = c._FOLD.format(f"{c.A} UNION ALL {c.B}").replace("{{", "{").replace("}}", "}")


@query(_FOLDED)
def store_ingest(spark, sf_dir):
    a, b = sources(c.A, c.B)(spark, sf_dir)
    store = MergeStore(spark, _folder(spark, "store"), "o_orderkey", c.FLAGSHIP, "ts")
    store.ingest(a)
    store.ingest(b)
    store.compact()
    return store.read()


@query(f"SELECT (SELECT count(*) FROM ({_FOLDED})) AS rows, (SELECT count(*) FROM ({c.B}) b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({c.A}))) AS new, (SELECT count(*) FROM ({c.B}) b WHERE o_orderkey IN (SELECT o_orderkey FROM ({c.A}))) AS updated")
def store_metadata(spark, sf_dir):
    a, b = sources(c.A, c.B)(spark, sf_dir)
    store = MergeStore(spark, _folder(spark, "store"), "o_orderkey", c.FLAGSHIP, "ts")
    store.ingest(a)
    store.ingest(b)
    found = store.metadata()
    return spark.createDataFrame([tuple(found[k] for k in ("rows", "new", "updated"))], "rows long, new long, updated long")


_PLAIN_A, _PLAIN_B = (f"SELECT o_orderkey, o_orderstatus FROM ({t})" for t in (c.A, c.B))


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, CASE WHEN b.o_orderkey IS NULL THEN 'one' ELSE 'two' END AS _node FROM ({_PLAIN_A}) a FULL JOIN ({_PLAIN_B}) b ON a.o_orderkey = b.o_orderkey")
def clocked_table(spark, sf_dir):
    a, b = sources(_PLAIN_A, _PLAIN_B)(spark, sf_dir)
    one, two = (ClockedTable(spark, _folder(spark, "clocked"), "o_orderkey") for _ in range(2))
    one.merge_insert(a, "one", 1.0)
    two.merge_insert(b, "two", 2.0)
    one.sync_from(two)
    return one.read().drop("_ts")


@query(c.ORACLES["diff_long"])
def snapshot_changes(spark, sf_dir):
    a, b = sources(c.DA, c.DB)(spark, sf_dir)
    kept = Snapshots(spark)
    kept.register("main", a)
    kept.branch("work", "main")
    kept.update_branch("work", b)
    return kept.changes("main", "work", "o_orderkey")


@query(c.pair("o_orderkey", {"o_orderstatus": "least(a.$, b.$)", "o_totalprice": "(a.$ + b.$) / 2"}, *(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM ({t})" for t in (c.A, c.B))))
def snapshot_resolve_sql(spark, sf_dir):
    kept = Snapshots(spark)
    for name, df in zip("ab", sources(c.A, c.B)(spark, sf_dir), strict=True):
        kept.register(name, df.select("o_orderkey", "o_orderstatus", "o_totalprice"))
    return kept.resolve_with_sql("a", "b", "o_orderkey", {"o_orderstatus": "least(a.o_orderstatus, b.o_orderstatus)", "o_totalprice": "(a.o_totalprice + b.o_totalprice) / 2"})


@query(c.ORACLES["merge_many_fold"])
def snapshot_merge_branches(spark, sf_dir):
    kept = Snapshots(spark)
    for name, df in zip("abc", sources(c.A, c.B, c.C)(spark, sf_dir), strict=True):
        kept.register(name, df)
    return kept.merge_branches(["a", "b", "c"], "o_orderkey", c.FLAGSHIP, "ts")


@query("SELECT user_id, value, cast(t AS double) AS _emitted_at FROM (SELECT user_id, value, t, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, value DESC) AS n FROM (SELECT user_id, value, event_id // 7 AS t FROM {events})) WHERE n = 1")
def record_destination(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, "SELECT user_id, value, event_id div 7 AS t FROM {events}")
    record = F.struct(F.lit("seen").alias("stream"), F.to_json(F.struct("user_id", "value")).alias("data"), F.col("t").cast("double").alias("emitted_at"))
    messages = rows.select(F.to_json(F.struct(F.lit("RECORD").alias("type"), record.alias("record"))).alias("value"))
    to = RecordDestination(spark, _folder(spark, "records"), {"seen": ["user_id"]}, {"seen": "user_id long, value double"})
    to.write(messages)
    return to.read("seen")


# --- merges ---


@query(c.pair("o_orderkey", {"o_totalprice": "(a.$ + b.$) / 2"}, *(f"SELECT o_orderkey, o_totalprice FROM ({t})" for t in (c.A, c.B))))
def merge_average(spark, sf_dir):
    a, b = (df.select("o_orderkey", "o_totalprice") for df in sources(c.A, c.B)(spark, sf_dir))
    return m.merge(a, b, "o_orderkey", schema={"o_totalprice": "avg"})


@query(c.ORACLES["merge_flagship"])
def merge_stored_schema(spark, sf_dir):
    a, b = sources(c.A, c.B)(spark, sf_dir)
    return m.merge(a, b, "o_orderkey", "ts", schema=MergeSchema.from_json(MergeSchema.of(c.FLAGSHIP).to_json()))


_NEST_A = "SELECT event_id, event_type AS kind, value AS size, user_id AS x, event_id AS y FROM {events} WHERE event_id % 5 <> 0"
_NEST_B = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'seen' ELSE event_type END AS kind, value - 1 AS size, user_id + 1 AS x, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id - 1 END AS y FROM {events} WHERE event_id % 5 <> 1"
_GREATER = "CASE WHEN a.{0} IS NULL THEN b.{0} WHEN b.{0} IS NULL THEN a.{0} ELSE {1}(a.{0}, b.{0}) END"


@query(f"SELECT coalesce(a.event_id, b.event_id) AS event_id, {_GREATER.format('kind', 'greatest')} AS kind, {_GREATER.format('size', 'least')} AS size, {_GREATER.format('x', 'greatest')} AS x, {_GREATER.format('y', 'greatest')} AS y FROM ({_NEST_A}) a FULL JOIN ({_NEST_B}) b ON a.event_id = b.event_id")
def merge_nested(spark, sf_dir):
    """Structs field by field, lists element by element."""
    nested = lambda df: df.select("event_id", F.struct("kind", "size").alias("doc"), F.array("x", "y").alias("at"))
    out = m.merge(*map(nested, sources(_NEST_A, _NEST_B)(spark, sf_dir)), "event_id", schema={"size": "min"})
    return out.select("event_id", "doc.kind", "doc.size", F.col("at")[0].alias("x"), F.col("at")[1].alias("y"))


@query(f"SELECT {', '.join(f'count(*) FILTER ({x} < {y}) AS {n}' for x, y, n in (('n0', 'n1', 'c_name'), ('a0', 'a1', 'c_acctbal'), ('s0', 's1', 'c_mktsegment')))} FROM (SELECT c_custkey, min(c_name) AS n0, max(c_name) AS n1, min(c_acctbal) AS a0, max(c_acctbal) AS a1, min(c_mktsegment) AS s0, max(c_mktsegment) AS s1 FROM ({c._ALL}) GROUP BY c_custkey)")
def language_conflicts(spark, sf_dir):
    ql = MergeLanguage(spark)
    for i, name in enumerate(("east", "west", "south")):
        ql.register(name, spark_sql(spark, sf_dir, c.STAFF % (i, i)))
    return ql.conflicts("MERGE east, west, south ON c_custkey").groupBy().pivot("field", ["c_name", "c_acctbal", "c_mktsegment"]).agg(F.first("conflicts"))


@query("SELECT true AS sources, true AS strategies, true AS physical")
def language_explain(spark, sf_dir):
    ql = MergeLanguage(spark)
    for i, name in enumerate(("east", "west")):
        ql.register(name, spark_sql(spark, sf_dir, c.STAFF % (i, i)))
    plan = F.col("plan")
    return ql.execute("EXPLAIN MERGE east, west ON c_custkey STRATEGY c_acctbal = max").select(plan.contains("MERGE east, west ON c_custkey").alias("sources"), plan.contains("strategy c_acctbal: max").alias("strategies"), plan.contains("Physical Plan").alias("physical"))


@query(c.ORACLES["merge_lww_pair"])
def functions_in_sql(spark, sf_dir):
    """The rules as SQL functions."""
    functions_sql.register(spark)
    a, b = sources(c.A, c.B)(spark, sf_dir)
    a.createOrReplaceTempView("fa")
    b.createOrReplaceTempView("fb")
    cell = lambda x: f"merge_lww(fa.{x}, fb.{x}, double(fa.ts), double(fb.ts)) AS {x}"
    price = "CASE WHEN fa.o_totalprice IS NULL THEN fb.o_totalprice WHEN fb.o_totalprice IS NULL THEN fa.o_totalprice WHEN fb.ts > fa.ts OR (fb.ts = fa.ts AND fb.o_totalprice > fa.o_totalprice) THEN fb.o_totalprice ELSE fa.o_totalprice END AS o_totalprice"
    return spark.sql(f"SELECT coalesce(fa.o_orderkey, fb.o_orderkey) AS o_orderkey, {cell('o_orderstatus')}, {price}, {cell('o_orderpriority')}, greatest(fa.ts, fb.ts) AS ts FROM fa FULL JOIN fb ON fa.o_orderkey = fb.o_orderkey")


@query("SELECT n_nationkey, n_name || chr(233) AS name FROM {nation}")
def nfc_keys(spark, sf_dir):
    """Composed and decomposed forms of a key meet."""
    rows = spark_sql(spark, sf_dir, "SELECT n_nationkey, n_name FROM {nation}")
    forms = [rows.select("n_nationkey", F.concat("n_name", F.lit(x)).alias("name")) for x in ("é", "é")]
    return canonical_keys(m.merge(*forms, "name", schema={"n_nationkey": "max"}, nfc=True), ["name"]).select("n_nationkey", "name")


# --- laws, audit, access, compliance ---


@query("SELECT unnest(['associative', 'commutative', 'convergent', 'idempotent']) AS law, true AS holds")
def law_checks(spark, sf_dir):
    a, b, d = (df.where("o_orderkey % 10 < 4") for df in sources(c.A, c.B, c.C)(spark, sf_dir))
    found = laws.verify(lambda x, y: m.merge(x, y, "o_orderkey", schema={"o_orderstatus": "max", "o_totalprice": "min", "o_orderpriority": "max", "ts": "max"}), a, b, d)
    return spark.createDataFrame([(x.name, x.holds) for x in found], "law string, holds boolean")


@query("SELECT 0 AS sound, 1 AS forged, true AS output_differs")
def audit_chain(spark, sf_dir):
    a, b = sources(c.A, c.B)(spark, sf_dir)
    log = governance.AuditLog()
    governance.audited_merge(a, b, log, key="o_orderkey", timestamp_col="ts")
    governance.audited_merge(a, a, log, key="o_orderkey", timestamp_col="ts")
    sound = governance.broken_links(log.frame(spark)).count()
    differs = log.entries[0]["output_hash"] != log.entries[1]["output_hash"]
    log.entries[0]["operation"] = "forged"
    return spark.createDataFrame([(sound, governance.broken_links(log.frame(spark)).count(), differs)], "sound int, forged int, output_differs boolean")


@query(c.pair("o_orderkey", {"o_orderstatus": "greatest(a.$, b.$)"}, _PLAIN_A, _PLAIN_B))
def secure_merge(spark, sf_dir):
    a, b = (df.drop("ts") for df in sources(c.A, c.B)(spark, sf_dir))
    policy = governance.Policy(frozenset({"merge"}), allow=frozenset({"o_orderkey", "o_orderstatus", "o_totalprice"}), deny=frozenset({"o_totalprice"}))
    return governance.secure_merge(a, b, policy, key="o_orderkey")


@query("SELECT 'AI' AS framework, 2 AS rules, 1 AS passed, 1 AS failed, false AS compliant UNION ALL SELECT 'GDPR', 3, 1, 2, false UNION ALL SELECT 'HIPAA', 2, 2, 0, true UNION ALL SELECT 'SOX', 2, 0, 2, false")
def compliance_summary(spark, sf_dir):
    return governance.compliance_summary(governance.compliance(spark, {"audit_log": True, "encryption": True, "unmerge": True}))


@query(f"SELECT (SELECT count(*) FROM ({c.DA}) a FULL JOIN ({c.DB}) b ON a.o_orderkey = b.o_orderkey) AS rows_before, (SELECT count(*) FROM ({c.DA})) AS rows_after, 0 AS residual_cells")
def forget_report(spark, sf_dir):
    a, b = sources(c.DA, c.DB)(spark, sf_dir)
    merged = m.merge(a, b, "o_orderkey", schema=MergeSchema.of({}, "max"))
    return governance.forget(merged, m.provenance(a, b, "o_orderkey", MergeSchema.of({}, "max")), "o_orderkey", "b")[1]


@query(f"SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey, 'modified' AS _op FROM ({c.DA}) a WHERE o_orderkey IN (SELECT a.o_orderkey FROM ({c.DA}) a JOIN ({c.DB}) b ON a.o_orderkey = b.o_orderkey WHERE NOT ({c._SAME}) AND b.o_orderpriority IS NOT NULL) UNION ALL SELECT a.o_orderkey, a.o_orderstatus, NULL, a.o_custkey, 'modified' FROM ({c.DA}) a JOIN ({c.DB}) b ON a.o_orderkey = b.o_orderkey WHERE b.o_orderpriority IS NULL UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'removed' FROM ({c.DA}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({c.DB}))")
def unmerge_delta(spark, sf_dir):
    """A delta from a to b with what only b said taken out; what b has no value for stays so."""
    a, b = sources(c.DA, c.DB)(spark, sf_dir)
    return m.unmerge_delta(delta.compute_delta(a, b, "o_orderkey"), m.provenance(a, b, "o_orderkey", MergeSchema.of({}, "max")), "o_orderkey", "b")


@query(f"SELECT x.field AS source, y.field AS target, count(*) AS weight FROM ({c._LOG}) x JOIN ({c._LOG}) y ON x.o_orderkey = y.o_orderkey AND x.field < y.field WHERE x.source = 'conflict_resolved' AND y.source = 'conflict_resolved' GROUP BY ALL")
def conflict_graph(spark, sf_dir):
    return governance.conflict_graph(c._log(spark, sf_dir), "o_orderkey")


@query(f"SELECT o_orderkey, count(*) FILTER (source = 'conflict_resolved') AS conflicts FROM ({c._LOG}) GROUP BY o_orderkey ORDER BY conflicts DESC, o_orderkey LIMIT 25")
def most_conflicted(spark, sf_dir):
    return governance.most_conflicted(c._log(spark, sf_dir), "o_orderkey", 25)


@query(f"SELECT floor(o_orderkey / 1000) * 1000 AS span, field, count(*) AS conflicts FROM ({c._LOG}) WHERE source = 'conflict_resolved' GROUP BY ALL")
def conflict_times(spark, sf_dir):
    keys = sources(c.DA)(spark, sf_dir)[0].select("o_orderkey", F.col("o_orderkey").alias("t"))
    return governance.conflict_times(c._log(spark, sf_dir), keys, "o_orderkey", "t", 1000.0)


@query(f"SELECT op, CASE WHEN e > 0.25 OR r > 0.03 THEN 'unhealthy' WHEN e > 0.2 OR r > 0.024 THEN 'degraded' ELSE 'healthy' END AS status FROM (SELECT op, count(*) FILTER (NOT ok) / count(*) AS e, sum(conflicts) / sum(rows) AS r FROM ({c._OPS}) GROUP BY op)")
def health(spark, sf_dir):
    return governance.health(governance.metrics(spark_sql(spark, sf_dir, c._OPS), ["op"]), 0.25, 0.03).select("op", "status")


@query("SELECT concat('merge_n', chr(123), 'op=\"', op, '\"', chr(125), ' ', count(*)) AS line FROM (" + c._OPS + ") GROUP BY op")
def prometheus(spark, sf_dir):
    return governance.prometheus(governance.metrics(spark_sql(spark, sf_dir, c._OPS), ["op"])).where("line LIKE 'merge_n{%'")


# --- Merkle, wire ---


@query(f"SELECT count(*) AS count, true AS same, true AS differs FROM ({c.DB})")
def merkle_roots(spark, sf_dir):
    a, b = sources(c.DA, c.DB)(spark, sf_dir)
    one, again, other = (merkle.root(df, "o_orderkey").select(F.col("hash").alias(n), F.col("count").alias(f"{n}_count")) for df, n in ((b, "one"), (b.repartition(7), "again"), (a, "other")))
    return one.join(again).join(other).select(F.col("one_count").alias("count"), (F.col("one") == F.col("again")).alias("same"), (F.col("one") != F.col("other")).alias("differs"))


@query(c.ORACLES["merkle_diff"])
def merkle_diff_pruned(spark, sf_dir):
    return merkle.diff(*sources(c.DA, c.DB)(spark, sf_dir), "o_orderkey", buckets=4096)


@query(f"SELECT * EXCLUDE (h, n) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY h DESC) AS n FROM (SELECT *, {c._CONTENT} AS h FROM (SELECT * FROM ({c.DA}) UNION ALL SELECT * FROM ({c.DB})))) WHERE n = 1")
def merkle_merge(spark, sf_dir):
    return merkle.merge(*sources(c.DA, c.DB)(spark, sf_dir), "o_orderkey")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY ALL)")
def wire_round_trip(spark, sf_dir):
    counts = spark_sql(spark, sf_dir, "SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type")
    clocks = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("clock"))
    back = clocks.select("user_id", wire.from_wire(wire.to_wire(F.col("clock")), "map<string,bigint>").alias("clock"))
    return back.select("user_id", F.explode("clock").alias("event_type", "n"))


# --- deduplication ---

_GRAMS = "list_distinct(list_transform(range(1, greatest(length(t), 2)), lambda i: t[i:i + 1]))"


@query(f"WITH named AS (SELECT min(p_partkey) AS id, lower(p_name) AS t FROM {{part}} GROUP BY lower(p_name)), sets AS (SELECT id, {_GRAMS} AS g FROM named) SELECT x.id AS a, y.id AS b FROM sets x JOIN sets y ON x.id < y.id WHERE 2 * len(list_intersect(x.g, y.g)) >= 0.85 * (len(x.g) + len(y.g)) - 1e-9")
def dedup_fuzzy_pairs(spark, sf_dir):
    return dedup.fuzzy_pairs(spark_sql(spark, sf_dir, c._NAMES), "p_name", "p_partkey", 0.85)


@query(f"WITH pairs AS (SELECT p_partkey, lower(x) AS t, lower(y) AS u FROM (SELECT p_partkey, p_name AS x, p_type AS y FROM {{part}})) SELECT p_partkey, round(2 * len(list_intersect({_GRAMS}, {_GRAMS.replace('(t)', '(u)').replace('t[i', 'u[i')})) / (len({_GRAMS}) + len({_GRAMS.replace('(t)', '(u)').replace('t[i', 'u[i')})), 6) AS dice FROM pairs")
def dice_similarity(spark, sf_dir):
    return spark_sql(spark, sf_dir, "SELECT p_partkey, p_name, p_type FROM {part}").select("p_partkey", F.round(dedup.dice(F.col("p_name"), F.col("p_type")), 6).alias("dice"))


@query("SELECT doc_id FROM {documents} WHERE doc_id % 2 = 1 AND lower(text) NOT IN (SELECT lower(text) FROM {documents} WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def dedup_index(spark, sf_dir):
    """Texts that neither of two merged indexes has seen."""
    docs = spark_sql(spark, sf_dir, "SELECT doc_id, text FROM {documents}")
    index = dedup.merge_seen(dedup.seen(docs.where("doc_id % 4 = 0"), "text"), dedup.seen(docs.where("doc_id % 4 = 2"), "text"))
    return dedup.unseen(docs.where("doc_id % 2 = 1"), "text", index).select("doc_id")


# --- state and sketches ---


@query("SELECT key, value, tombstone FROM (SELECT e.key, e.value, e.tombstone, row_number() OVER (PARTITION BY e.key ORDER BY e.value DESC, e.tombstone DESC) AS n FROM (SELECT user_id % 20 AS key, user_id AS node, event_type AS value, event_type = 'error' AS tombstone, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS last FROM {events}) e WHERE nth = last) WHERE n = 1")
def gossip_causal(spark, sf_dir):
    """Every node counts its own events: of a node only the last is not dominated, nodes are concurrent."""
    rows = spark_sql(spark, sf_dir, "SELECT user_id % 20 AS key, user_id AS node, event_type AS value, event_type = 'error' AS tombstone, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS at FROM {events}")
    clocked = rows.select("key", "value", F.create_map(F.col("node").cast("string"), F.col("at").cast("bigint")).alias("clock"), "tombstone")
    return state.gossip_merge(clocked).select("key", "value", "tombstone")


_TWO = "SELECT user_id AS counter, user_id % 4 AS node, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS sign, count(*) AS n FROM {events} WHERE event_id % 3 <> %d GROUP BY ALL"
_TWO_A, _TWO_B = _TWO.replace("%d", "0"), _TWO.replace("%d", "1")


@query(f"SELECT counter, sum(n * sign)::BIGINT AS value FROM (SELECT counter, node, sign, max(n) AS n FROM ({_TWO_A} UNION ALL {_TWO_B}) GROUP BY ALL) GROUP BY counter")
def pncounter_replicas(spark, sf_dir):
    a, b = sources(_TWO_A, _TWO_B)(spark, sf_dir)
    return state.pncounter_value(a.unionByName(b))


_DOTS = "SELECT user_id, max(event_id) FILTER (WHERE event_type = 'click') AS clicks, max(event_id) FILTER (WHERE event_type = 'view') AS views FROM {events} GROUP BY user_id"


@query(f"SELECT user_id, coalesce(clicks, 0) AS clicks, coalesce(views, 0) AS views, views IS NULL OR coalesce(clicks, 0) >= views AS descends FROM ({_DOTS})")
def dotted_clocks(spark, sf_dir):
    kind = "struct<clock:map<string,bigint>,node:string,counter:bigint>"
    empty = F.create_map().cast("map<string,bigint>")
    dot = lambda name, n: F.struct(empty.alias("clock"), F.when(F.col(n).isNotNull(), F.lit(name)).alias("node"), F.col(n).alias("counter")).cast(kind)
    rows = spark_sql(spark, sf_dir, _DOTS)
    merged = state.dotted_merge(dot("c", "clicks"), dot("v", "views"))["clock"]
    at = lambda k: F.coalesce(F.try_element_at(merged, F.lit(k)), F.lit(0)).cast("bigint")
    return rows.select("user_id", at("c").alias("clicks"), at("v").alias("views"), state.dotted_descends(dot("c", "clicks"), dot("c", "views")).alias("descends"))


@query("SELECT model_id, version, hash FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY version DESC, hash) AS n FROM (SELECT user_id AS model_id, event_id % 10 AS version, event_type AS hash, event_id AS tag FROM {events}) WHERE hash <> 'error') WHERE n = 1")
def contributions(spark, sf_dir):
    adds = spark_sql(spark, sf_dir, "SELECT user_id AS model_id, event_id % 10 AS version, event_type AS hash, event_id AS tag FROM {events}")
    return state.contributions(adds, adds.where("hash = 'error'")).select("model_id", "version", "hash")


@query("SELECT event_type, true AS close, true AS merged_close FROM {events} GROUP BY event_type")
def hll_bounds(spark, sf_dir):
    """Estimates, and those of two merged halves, within 3 % of the true count."""
    rows = spark_sql(spark, sf_dir, "SELECT event_type, event_id FROM {events}")
    whole = sketch.hll_count(sketch.hll(rows, ["event_type"], "event_id"))
    halves = sketch.hll(rows.where("event_id % 2 = 0"), ["event_type"], "event_id").unionByName(sketch.hll(rows.where("event_id % 2 = 1"), ["event_type"], "event_id"))
    merged = sketch.hll_count(sketch.hll_merge(halves, ["event_type"])).select("event_type", F.col("estimate").alias("merged"))
    true = rows.groupBy("event_type").agg(F.count_distinct("event_id").alias("n"))
    near = lambda x: F.abs(F.col(x) - F.col("n")) <= 0.03 * F.col("n")
    return whole.join(merged, "event_type").join(true, "event_type").select("event_type", near("estimate").alias("close"), near("merged").alias("merged_close"))


@query("SELECT true AS never_under, true AS mostly_near FROM {region} LIMIT 1")
def cms_bounds(spark, sf_dir):
    """A table far smaller than its items: never under, and on average over by no more than items / width."""
    rows = spark_sql(spark, sf_dir, "SELECT l_partkey FROM {lineitem}")
    width = 500
    estimates = sketch.cms_estimate(rows, "l_partkey", sketch.cms(rows, "l_partkey", width, 5), width, 5)
    off = estimates.join(rows.groupBy("l_partkey").count(), "l_partkey").select((F.col("estimate") - F.col("count")).alias("off"), "count")
    return off.agg((F.min("off") >= 0).alias("never_under"), (F.avg("off") <= F.sum("count") / width).alias("mostly_near"))


def _bounds(spark, sf_dir, contains) -> DataFrame:
    rows = spark_sql(spark, sf_dir, "SELECT c_custkey FROM {customer}")
    found = contains(rows, rows.where("c_custkey % 2 = 0"))
    odd = F.col("c_custkey") % 2 != 0
    return found.agg((F.count_if(~odd & ~F.col("maybe")) == 0).alias("none_missed"), (F.count_if(odd & F.col("maybe")) <= 0.06 * F.count_if(odd) + 3).alias("few_false"))


@query("SELECT true AS none_missed, true AS few_false FROM {region} LIMIT 1")
def bloom_bounds(spark, sf_dir):
    def contains(rows, members):
        bits, hashes = sketch.bloom_size(members.count(), 0.02)
        return sketch.bloom_contains(rows, "c_custkey", sketch.bloom_merge(sketch.bloom(members.where("c_custkey % 4 = 0"), "c_custkey", bits, hashes), sketch.bloom(members.where("c_custkey % 4 = 2"), "c_custkey", bits, hashes)), bits, hashes)

    return _bounds(spark, sf_dir, contains)


@query("SELECT true AS none_missed, true AS few_false FROM {region} LIMIT 1")
def bloom_sharded(spark, sf_dir):
    def contains(rows, members):
        bits, hashes = sketch.bloom_size(members.count() // 8 + 1, 0.01)
        return sketch.sharded_contains(rows, "c_custkey", sketch.sharded_bloom(members, "c_custkey", 8, bits, hashes), 8, bits, hashes)

    return _bounds(spark, sf_dir, contains)


# --- memories ---


@query(f"SELECT topic, fact, confidence, ts, source FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY confidence DESC, ts DESC, fact DESC) AS n FROM ({c._MEMORY})) WHERE n = 1")
def context_resolve(spark, sf_dir):
    return context.resolve_facts(spark_sql(spark, sf_dir, c._MEMORY), "topic", "max_confidence")


@query(f"SELECT topic, count(*) AS alive FROM ({c._MEMORY}) WHERE NOT (topic = 'en' AND 500 - ts > 300) GROUP BY topic")
def context_evict(spark, sf_dir):
    rows = context.memories(spark_sql(spark, sf_dir, c._MEMORY)).withColumn("ttl", F.when(F.col("topic") == "en", 300.0))
    return context.evict(rows, 500.0).groupBy("topic").agg(F.count("*").alias("alive"))


@query(f"SELECT 1 AS k, max(facts) AS facts, max(last_ts) AS last_ts FROM (SELECT topic, count(*) AS facts, max(ts) AS last_ts FROM ({c._MEMORY}) GROUP BY topic)")
def context_manifests(spark, sf_dir):
    rows = context.memories(spark_sql(spark, sf_dir, c._MEMORY))
    each = [context.manifest(rows.where(F.col("topic") == t)) for t in ("en", "de", "fr", "es")]
    return context.merge_manifests(each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).withColumn("k", F.lit(1)), "k").select("k", "facts", "last_ts")


@query("SELECT user_id, event_id, value FROM (SELECT *, min(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS ok FROM {events}) WHERE ok = 1")
def trusted_prefix(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, "SELECT user_id, event_id, value, event_type FROM {events}")
    return trust.trusted_prefix(rows, "event_id", F.col("event_type") != "error", ["user_id"]).select("user_id", "event_id", "value")


# --- models ---

_MEAN_TAU = f"SELECT *, w - b AS t, 1.0 / count(*) OVER (PARTITION BY layer, pos) AS wt FROM ({c._MODELS}) JOIN ({c._BASE}) USING (layer, pos)"


@query(f"SELECT layer, pos, round(first(b) + coalesce(sum(wt * t) FILTER (sign(t) = s AND t <> 0), 0) / greatest(count(*) FILTER (sign(t) = s AND t <> 0), 1), 5) + 0.0 AS w FROM (SELECT layer, pos, b, wt, t, sign(sum(sign(t)) OVER (PARTITION BY layer, pos)) AS s FROM (SELECT layer, pos, b, wt, CASE WHEN abs(t) >= cut THEN t ELSE 0 END AS t FROM ({_MEAN_TAU}) JOIN (SELECT model_id, layer, quantile_cont(abs(t), 0.8) AS cut FROM ({_MEAN_TAU}) WHERE t <> 0 GROUP BY ALL) USING (model_id, layer))) GROUP BY ALL")
def model_ties_signs(spark, sf_dir):
    """Distances from the mean, so that signs are contested."""
    df = c._models(spark, sf_dir)
    return model.ties(df, c._model_base(df)).select("layer", "pos", (F.round("w", 5) + 0.0).alias("w"))


_LOW_HIGH = f"SELECT layer, pos, min(w) AS a, max(w) AS b FROM ({c._MODELS}) GROUP BY ALL"


@query(f"SELECT layer, pos, round((0.5 * na + 0.5 * nb) * (sin(0.5 * o) * a / na + sin(0.5 * o) * b / nb) / sin(o), 6) + 0.0 AS w FROM (SELECT *, acos(d / (na * nb)) AS o FROM (SELECT *, sqrt(sum(a * a) OVER k) AS na, sqrt(sum(b * b) OVER k) AS nb, sum(a * b) OVER k AS d FROM ({_LOW_HIGH}) WINDOW k AS (PARTITION BY layer)))")
def model_slerp_pair(spark, sf_dir):
    df = c._models(spark, sf_dir)
    ends = [df.groupBy("layer", "pos").agg(f("w").alias("w")).withColumn("model_id", F.lit(i)) for i, f in enumerate((F.min, F.max))]
    return c._rounded(model.slerp(ends[0].unionByName(ends[1])))


@query(f"SELECT layer, pos, round(avg((w - m) / greatest(s, 1e-12)) * first(dev) + first(mean), 6) + 0.0 AS w FROM (SELECT *, avg(s) OVER (PARTITION BY layer) AS dev, avg(m) OVER (PARTITION BY layer) AS mean FROM (SELECT *, avg(w) OVER k AS m, stddev_pop(w) OVER k AS s FROM ({c._MODELS}) WINDOW k AS (PARTITION BY layer, model_id))) GROUP BY ALL")
def model_weight_scope(spark, sf_dir):
    return c._rounded(model.weight_scope_alignment(c._models(spark, sf_dir)))


@query(f"SELECT layer, pos, round(b + t - 0.5 * dot * b / bb, 6) + 0.0 AS w FROM (SELECT *, sum(t * b) OVER k AS dot, sum(b * b) OVER k AS bb FROM (SELECT layer, pos, first(b) AS b, avg(t) AS t FROM ({c._TAU}) GROUP BY ALL) WINDOW k AS (PARTITION BY layer))")
def model_dual_projection(spark, sf_dir):
    df = c._models(spark, sf_dir)
    return c._rounded(model.dual_projection(df, c._least(df)))


@query(f"SELECT layer, pos, round((m - mm) / greatest(s, 1e-12) * dev + mean, 6) + 0.0 AS w FROM (SELECT *, avg(m) OVER k AS mm, stddev_pop(m) OVER k AS s FROM (SELECT layer, pos, avg(w) AS m FROM ({c._MODELS}) GROUP BY ALL) WINDOW k AS (PARTITION BY layer)) JOIN (SELECT layer, sqrt(avg(v)) AS dev, avg(m) AS mean FROM (SELECT layer, model_id, var_pop(w) AS v, avg(w) AS m FROM ({c._MODELS}) GROUP BY ALL) GROUP BY layer) USING (layer)")
def model_surgery(spark, sf_dir):
    return c._rounded(model.representation_surgery(c._models(spark, sf_dir), "rescale"))


@query(f"SELECT layer, pos, round(first(b) + avg(CASE WHEN abs(t) >= cut THEN t * sqrt(whole / kept) ELSE 0 END), 6) + 0.0 AS w FROM (SELECT *, sum(t * t) OVER k AS whole, sum(CASE WHEN abs(t) >= cut THEN t * t ELSE 0 END) OVER k AS kept FROM (SELECT * FROM ({c._TAU}) JOIN (SELECT model_id, layer, list_sort(list(abs(t)), 'DESC')[greatest(1, count(*) // 2)] AS cut FROM ({c._TAU}) GROUP BY ALL) USING (model_id, layer)) WINDOW k AS (PARTITION BY layer, model_id)) GROUP BY ALL")
def model_star(spark, sf_dir):
    df = c._models(spark, sf_dir)
    return c._rounded(model.star(df, c._least(df)))


@query(f"SELECT layer, model_id AS dominant FROM (SELECT layer, model_id, row_number() OVER (PARTITION BY layer ORDER BY round(d, 9) DESC, model_id) AS n FROM (SELECT layer, model_id, sum((w - m) ** 2) AS d FROM (SELECT *, avg(w) OVER (PARTITION BY layer, pos) AS m FROM ({c._MODELS})) GROUP BY ALL)) WHERE n = 1")
def model_dominant(spark, sf_dir):
    return model.conflict_heatmap(c._models(spark, sf_dir)).select("layer", "dominant")


# --- streams ---


def _stream(spark, sf_dir, text: str, parts: int = 3):
    at, rows = _folder(spark, "stream"), spark_sql(spark, sf_dir, text)
    rows.repartition(parts).write.parquet(f"{at}/in")
    return at, rows, streams.read_events(spark, f"{at}/in", rows.schema)


@query("SELECT user_id AS key, value, cast(ts AS double) AS ts FROM (SELECT user_id, value, event_id AS ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, value DESC) AS n FROM {events}) WHERE n = 1")
def stream_latest(spark, sf_dir):
    """The state of a stream after its last batch: of each key the latest row of all updates."""
    at, _, stream = _stream(spark, sf_dir, "SELECT user_id, value, event_id AS ts FROM {events}")
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/{n}")
    streams.latest_by_key(stream, "user_id", "value", "ts").writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"{at}/out/*")
    return updates.groupBy("key").agg(F.max(F.struct("ts", "value")).alias("b")).select("key", "b.value", "b.ts")


@query("SELECT DISTINCT user_id, event_type FROM {events}")
def stream_distinct(spark, sf_dir):
    at, rows, stream = _stream(spark, sf_dir, "SELECT user_id, event_type, cast(ts AS timestamp) AS at FROM {events}", 1)
    out = streams.distinct_stream(stream, ["user_id", "event_type"], "at", "10000 days").select("user_id", "event_type")
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(f"{at}/out")


@query("SELECT count(DISTINCT user_id) AS added FROM {events}")
def stream_deltas(spark, sf_dir):
    """A delta after each batch: every key is added once."""
    at, _, stream = _stream(spark, sf_dir, "SELECT user_id, value, event_id AS ts FROM {events}")
    store = MergeStore(spark, f"{at}/store", "user_id", None, "ts")
    put = lambda changed, n: changed.write.mode("overwrite").parquet(f"{at}/out/{n}")
    streams.delta_stream(stream, store, put, f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out/*").agg(F.count_if(F.col("_op") == "added").alias("added"))


@query("SELECT 0 AS in_order, count(*) > 0 AS out_of_order FROM {orders}")
def order_check(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, "SELECT o_orderkey, o_totalprice FROM {orders}")
    sound, broken = streams.unsorted(rows, ["o_orderkey"], "o_orderkey"), streams.unsorted(rows, ["o_totalprice"], "o_orderkey")
    return sound.agg(F.count("*").cast("int").alias("in_order")).join(broken.agg((F.count("*") > 0).alias("out_of_order")))


@query("SELECT event_id, props->>'$.k' AS k, event_type AS tag FROM {events}")
def json_merge_texts(spark, sf_dir):
    """JSON texts without a type merged deeply."""
    rows = spark_sql(spark, sf_dir, "SELECT event_id, props, event_type FROM {events}")
    merged = jsonmerge.merge_json(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("tag"))))
    return rows.select("event_id", F.from_json(merged, T.StructType().add("k", "string").add("tag", "string")).alias("d")).select("event_id", "d.k", "d.tag")

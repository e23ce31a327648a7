"""Language, schemas, dedup, nested values, deltas, state, sketches, governance."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergeloom.operators import context, dedup, delta, governance, jsonmerge, merkle, model, schema, sketch, state, trust
from mergeloom.plans.language import MergeLanguage, LanguageError, parse


@pytest.fixture
def ql(spark):
    q = MergeLanguage(spark)
    q.register("east", spark.createDataFrame([(1, "Ann", 100, "eng"), (2, "Bob", 200, "ops"), (3, "Cy", -5, "")], "id long, name string, salary long, dept string"))
    q.register("west", spark.createDataFrame([(1, "Anna", 150, "eng"), (4, "Di", 90, None)], "id long, name string, salary long, dept string"))
    return q


def test_language(ql, rows):
    assert rows(ql.execute("MERGE east, west ON id STRATEGY salary = max"), "id", "name", "salary") == [(1, "Anna", 150), (2, "Bob", 200), (3, "Cy", -5), (4, "Di", 90)]
    assert rows(ql.execute("merge east, west on id where salary >= 150 strategy salary='min'"), "id") == [(1,), (2,)]
    assert rows(ql.execute("MERGE east, west ON id WHERE salary > -10 AND salary < 0"), "id") == [(3,)]
    assert rows(ql.execute("MERGE east, west ON id WHERE dept IS NULL MAP name -> who"), "id", "who") == [(3, "Cy"), (4, "Di")]
    assert rows(ql.execute("MERGE east, west ON id WHERE name != Bob AND (dept LIKE 'e%' OR dept IN ('ops'))"), "id") == [(1,)]
    assert rows(ql.execute("MERGE east, west ON id LIMIT 2"), "id") == [(1,), (2,)]
    assert "strategy salary: max" in ql.execute("EXPLAIN MERGE east, west ON id STRATEGY salary = max").first().plan
    ql.register_strategy("sum", lambda a, b: a + b)
    assert rows(ql.execute("MERGE east, west ON id STRATEGY salary = custom:sum"), "id", "salary")[0] == (1, 250)
    assert ql.list_sources() == ["east", "west"] and ql.source_info("east")["rows"] == 3


@pytest.mark.parametrize("text", ["MERGE", "MERGE east", "MERGE nowhere, east ON id", "MERGE east, west ON id WHERE", "MERGE east, west ON id WHERE salary ~ 3", "MERGE east, west ON id LIMIT x", "MERGE east, west ON id STRATEGY salary = nope", "MERGE east, west ON id LIMIT 1 LIMIT 2", "MERGE east, west ON nokey"])
def test_language_errors(ql, text):
    with pytest.raises(LanguageError):
        ql.execute(text)


def test_quoted_keywords_are_names():
    st = parse("MERGE a, 'ON' ON \"LIMIT\" MAP x TO 'WHERE'")
    assert (st.sources, st.keys, st.renames) == (["a", "ON"], ["LIMIT"], {"x": "WHERE"})


def test_schema_policies():
    i, l, t, d = T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType()
    a = T.StructType().add("k", i).add("x", t).add("gone", i)
    b = T.StructType().add("k", l).add("x", i).add("new", d)
    names = lambda e: [(f.name, f.dataType.simpleString()) for f in e.schema]
    union = schema.evolve(a, b)
    assert names(union) == [("k", "bigint"), ("x", "string"), ("gone", "int"), ("new", "double")] and not union.compatible
    assert names(schema.evolve(a, b, "intersection")) == [("k", "bigint"), ("x", "string")]
    assert names(schema.evolve(a, b, "left_priority"))[:2] == [("k", "int"), ("x", "string")]
    assert names(schema.evolve(a, b, "right_priority"))[:2] == [("k", "bigint"), ("x", "int")]
    assert schema.evolve(a, b, allow_narrowing=True).compatible
    assert not schema.compatible(a, b) and schema.compatible(a, a)
    assert schema.widen(T.IntegerType(), T.FloatType()) == T.FloatType()


def brute(texts, threshold):
    grams = lambda t: {t} if len(t) < 2 else {t[i : i + 2] for i in range(len(t) - 1)}
    kept, out = [], {}
    for i, t in enumerate(texts):
        g = grams(" ".join(t.lower().split()))
        twin = next((j for j, h in kept if 2 * len(g & h) / (len(g) + len(h)) >= threshold), i)
        if twin == i:
            kept.append((i, g))
        out[i] = twin
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_fuzzy_is_greedy(spark, threshold):
    words = ["The quick brown fox jumps over the lazy dog", "the quick brown fox  jumped over the lazy dog", "THE QUICK BROWN FOX", "something else entirely", "something else entirely!", "a", "", "A", "quick brown foxes jump over lazy dogs"]
    texts = [" ".join(p) for p in itertools.islice(itertools.permutations(["red", "green", "blue", "grey"], 3), 12)] + words
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.kept for r in dedup.fuzzy(df, "t", "id", threshold).collect()}
    assert got == {i: i == j for i, j in brute(texts, threshold).items()}


def test_minhash_is_the_same_everywhere(spark):
    df = spark.createDataFrame([(0, "the quick brown fox jumps"), (1, "the quick brown fox jumped"), (2, "nothing of the sort")], "id long, t string")
    got = [[r.kept for r in dedup.minhash(d, "t", "id", 128, 0.6).orderBy("id").collect()] for d in (df, df.repartition(3))]
    assert got[0] == got[1] == [True, False, True]


def test_components_of_a_long_chain(spark, rows):
    # Ids fall from the middle to both ends, so that the smallest has to pass a second minimum.
    order = [*range(0, 602, 2), *reversed(range(1, 600, 2))]
    links = [(min(x, y), max(x, y)) for x, y in itertools.pairwise(order)] + [(1000, 1001)]
    got = rows(dedup.components(spark.createDataFrame(links, "a long, b long")))
    assert got == sorted(((a, b, 1000 if a >= 1000 else 0) for a, b in links), key=repr)
    assert dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark, rows):
    df = spark.createDataFrame([(0, "A b"), (1, "a B"), (2, "a  b"), (3, None), (4, None), (5, "")], "id long, t string")
    assert rows(dedup.exact(df, "t", "id").where("kept"), "id") == [(0,), (2,), (3,), (5,)]
    recs = spark.createDataFrame([(0, "x", 1), (1, "X", 1), (2, "y", None)], "id long, a string, b long")
    assert rows(dedup.records(recs, "id"), "id") == [(0,), (2,)]
    assert dedup.fuzzy_rows(recs, "id", 0.9).count() == 2


def test_deep_merges(spark):
    kind = "id long, v struct<host: string, port: int, tags: array<string>, m: map<string, int>>"
    a = spark.createDataFrame([(1, ("a", None, ["x", "y"], {"p": 1, "q": 2}))], kind)
    b = spark.createDataFrame([(1, ("b", 80, ["y", "z"], {"q": 3}))], kind)
    v = jsonmerge.merge_lines(a, b, "id").first().v
    assert (v.host, v.port, v.tags, v.m) == ("b", 80, ["x", "y", "z"], {"p": 1, "q": 3})
    assert jsonmerge.merge_documents({"a": {"x": 1, "l": [1]}, "n": None}, {"a": {"x": 2, "l": [1, 2]}, "n": 3}, {"a.x": 5}, {"a.x": 5}) == {"a": {"x": 2, "l": [1, 2]}, "n": 3}
    assert jsonmerge.merge_documents({"x": 1}, {"x": 2}, {"x": 9}, {"x": 5}) == {"x": 1}
    texts = spark.createDataFrame([('{"a": {"b": 1}}', '{"a": {"c": [2]}}'), (None, '{"x": 1}')], "p string, q string")
    assert [r[0] for r in texts.select(jsonmerge.merge_json(F.col("p"), F.col("q"))).collect()] == ['{"a": {"b": 1, "c": [2]}}', '{"x": 1}']
    maps = spark.createDataFrame([({"a": 1, "b": 1}, {"a": 2}, {"a": 9.0}, {"a": 5.0})], "x map<string,int>, y map<string,int>, tx map<string,double>, ty map<string,double>")
    assert maps.select(jsonmerge.merge_maps(*map(F.col, ("x", "y", "tx", "ty")))).first()[0] == {"a": 1, "b": 1}


def test_deltas(spark, rows):
    df = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    v = [df((1, "a"), (2, "b"), (5, None)), df((1, "a2"), (3, "c"), (5, None)), df((3, "d"), (2, "b"), (5, "e"))]
    d1, d2 = delta.compute_delta(v[0], v[1], "k"), delta.compute_delta(v[1], v[2], "k")
    assert rows(d1, "k", "_op") == [(1, "modified"), (2, "removed"), (3, "added")]
    assert rows(delta.apply_delta(v[0], d1, "k")) == rows(v[1])
    assert rows(delta.apply_delta(v[0], delta.compose_deltas([d1, d2], "k"), "k")) == rows(v[2])
    assert rows(delta.apply_delta(v[0], d1, "k", {"v": "min"}), "k", "v")[0] == (1, "a")
    states = v[0].withColumn("n", F.lit(1)).unionByName(v[1].withColumn("n", F.lit(2)))
    assert rows(delta.version_history(states, "k", "n").where("n = 2"), "k", "_op") == [(1, "modified"), (2, "removed"), (3, "added")]


def test_history_is_not_dealt_by_version(spark, rows, monkeypatch):
    states = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 4), (2, "a", 1), (2, "a", 4), (3, None, 2), (3, "", 4)], "k long, v string, n long")
    want = [(1, 1, "added"), (1, 4, "modified"), (2, 1, "added"), (2, 2, "removed"), (2, 4, "added"), (3, 2, "added"), (3, 4, "modified")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = delta.version_history(states, "k", "n")
        assert "SortMergeJoin" not in got._jdf.queryExecution().toString() and rows(got) == want
        monkeypatch.setattr(delta, "VERSIONS", 2)
        assert rows(delta.version_history(states, "k", "n")) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merkle(spark, rows):
    df = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    a, b = df((1, "a"), (2, "b"), (3, "c")), df((2, "b"), (3, "x"), (4, "d"))
    assert rows(merkle.diff(a, b, "k")) == [("1", "removed"), ("3", "modified"), ("4", "added")]
    assert merkle.same(a, a.orderBy(F.desc("k")), "k") and not merkle.same(a, b, "k")
    assert merkle.root(a, "k").first() == merkle.root(a.repartition(3), "k").first() != merkle.root(b, "k").first()
    trees = [merkle.tree(t, "k", 4, 3) for t in (a, b)]
    assert [merkle.differing_nodes(*trees, n).count() for n in (0, 3)] == [1, 3] and merkle.differing_nodes(trees[0], trees[0], 3).count() == 0
    assert rows(merkle.merge(a, b, "k")) == rows(merkle.merge(b, a, "k"))


def test_state(spark, rows):
    clocks = spark.createDataFrame([({"a": 1}, {"a": 2}), ({"a": 2, "b": 0}, {"a": 2}), ({"a": 3}, {"b": 1}), ({"a": 2}, {"a": 1})], "x map<string,bigint>, y map<string,bigint>")
    assert [r[0] for r in clocks.select(state.clock_compare(F.col("x"), F.col("y"))).collect()] == ["before", "equal", "concurrent", "after"]
    assert clocks.select(state.clock_increment(F.col("x"), F.lit("a"))).first()[0] == {"a": 2}
    g = spark.createDataFrame([("k", "z", {"n": 1}, False), ("k", "a", {"n": 2}, False), ("k", "b", {"m": 1}, True)], "key string, value string, clock map<string,bigint>, tombstone boolean")
    assert state.gossip_merge(g).first()[:2] == ("k", "b")
    assert state.gossip_merge(g, "reference").first()[:2] == ("k", "z")
    assert state.gossip_merge(g).first().clock == {"m": 1, "n": 2}
    mine, theirs = g.limit(1), g.where("value = 'a'")
    assert state.apply_entries(mine.where("value = 'z'"), theirs).first().value == "a"
    assert rows(state.anti_entropy(state.gossip_digest(g.where("value='z'")), state.gossip_digest(theirs))) == [("k", "both")]
    with pytest.raises(Exception, match="no negative counts"):
        state.gcounter_value(spark.createDataFrame([("c", "n", -1)], "counter string, node string, n long")).collect()
    dots = spark.createDataFrame([(({"a": 1}, "a", 2), ({"a": 2}, None, None))], "x struct<clock: map<string,bigint>, node: string, counter: bigint>, y struct<clock: map<string,bigint>, node: string, counter: bigint>")
    assert dots.select(state.dotted_descends(F.col("x"), F.col("y")), state.dotted_merge(F.col("x"), F.col("y"))["clock"]).first() == (True, {"a": 2})
    adds = spark.createDataFrame([("m", 1, "h", "t1"), ("m", 2, "z", "t2"), ("m", 2, "a", "t3"), ("n", 1, "q", "t4")], "model_id string, version long, hash string, tag string")
    assert rows(state.contributions(adds, adds.where("tag = 't4'")), "model_id", "tag") == [("m", "t3")]


def most_rows(df):
    """The most rows that one step of the plan made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        todo += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_gossip_meets_few_clocks(spark):
    kind = "key long, value string, clock map<string,bigint>, tombstone boolean"
    chains = [(0, f"{i % 4}-{i:04}", {f"n{i % 4}": i + 1}, False) for i in range(1200)]
    got = state.gossip_merge(spark.createDataFrame(chains, kind))
    assert most_rows(got) <= 2 * len(chains) and got.first().value == "3-1199"
    rng, rows, best = random.Random(3), [], {}
    for key in range(24):
        for _ in range(rng.randint(1, 40)):
            clock = {n: rng.randint(0, (2, 5, 50)[key % 3]) for n in "abcdef"[: 1 + key % 6] if rng.random() < (0.6, 0.9)[key % 2]}
            rows.append((key, f"{rng.choice('xyz')}{rng.randint(0, 99)}", clock, rng.random() < 0.5))
    count = lambda c, n: c.get(n, 0)
    for key, value, clock, gone in rows:
        others = [r[2] for r in rows if r[0] == key]
        if not any(all(count(clock, n) <= count(o, n) for n in clock) and any(count(o, n) > count(clock, n) for n in o) for o in others):
            best[key] = max(best.get(key, ("", False)), (value, gone))
    assert {r.key: (r.value, r.tombstone) for r in state.gossip_merge(spark.createDataFrame(rows, kind)).collect()} == best


def test_sketches(spark):
    df = spark.range(20_000).withColumn("i", F.col("id") % 8000)
    half = [sketch.hll(df.where(f"i % 2 = {r}").withColumn("g", F.lit(1)), ["g"], "i") for r in (0, 1)]
    estimate = sketch.hll_count(sketch.hll_merge(half[0].union(half[1]), ["g"])).first().estimate
    assert abs(estimate - 8000) < 0.03 * 8000
    m, k = sketch.bloom_size(1000, 0.01)
    filled = sketch.bloom(spark.range(1000), "id", m, k)
    out = sketch.bloom_contains(spark.range(5000), "id", filled, m, k)
    assert out.where("id < 1000 and not maybe").count() == 0 and out.where("id >= 1000 and maybe").count() < 100
    assert abs(sketch.bloom_count(filled, m, k).first().estimate - 1000) < 60
    cells = sketch.cms(df, "i")
    true = df.groupBy("i").count()
    off = sketch.cms_estimate(df, "i", cells).join(true, "i").select(F.min(F.col("estimate") - F.col("count")), F.avg(F.col("estimate") - F.col("count"))).first()
    assert off[0] >= 0 and off[1] < 20
    assert sketch.cms_merge(cells, cells).exceptAll(cells).count() == 0


def test_contexts(spark, rows):
    mem = spark.createDataFrame([("f1", 0.9, "s", 5.0, ["b"]), ("f2", 0.2, "s", 5.0, []), ("f1", 0.5, "t", 9.0, ["a"])], "fact string, confidence double, source string, ts double, tags array<string>")
    out = context.merge_contexts([mem.limit(2), mem.where("source = 't'")], 0.3)
    assert rows(out, "fact", "confidence", "source", "ts", "tags") == [("f1", 0.9, "t", 9.0, ["a", "b"])]
    timed = context.memories(mem).withColumn("ttl", F.lit(3.0))
    assert context.evict(timed, 10.0).count() == 1
    assert context.query(context.memories(mem), tags=["b"]).count() == 1
    assert context.blocks(context.memories(mem), 1).select("block_id").distinct().count() == 2
    for how, fact in (("lww", "f1"), ("max_confidence", "f1"), ("union", "f1 | f2"), ("priority", "f1")):
        assert context.resolve_facts(context.memories(mem).withColumn("k", F.lit(1)), "k", how, ["t"]).first().fact == fact


def test_trust(spark, rows):
    ev = spark.createDataFrame([("p", "integrity", "o", 0.3), ("p", "integrity", "o", 0.1), ("p", "integrity", "q", 0.9)], "peer string, dimension string, observer string, evidence double")
    got = {r.dimension: r.trust for r in trust.trust(ev).collect()}
    assert got["integrity"] == 0 and got["gossip"] == 0.5 and len(got) == 6
    peers = spark.createDataFrame([("bad", 0.05), ("ok", 0.9)], "peer string, trust double")
    e = spark.createDataFrame([("k", "bad", 9.0, 9.0), ("k", "ok", 1.0, 1.0)], "key string, peer string, value double, ts double")
    assert trust.trust_lww(e, peers, "key").first().value == 1.0
    assert trust.trust_average(e, peers, "key").first().value == 1.0
    assert trust.trust_gate(e, trust.trust(ev).withColumn("peer", F.lit("ok")), {"gossip": 0.4}).count() == 1


def test_models(spark, rows):
    w = spark.createDataFrame([("m1", "L", 0, 1.0), ("m1", "L", 1, 0.0), ("m2", "L", 0, 0.0), ("m2", "L", 1, 1.0)], "model_id string, layer string, pos int, w double")
    base = w.select("layer", "pos").distinct().withColumn("w", F.lit(0.0))
    got = dict(rows(model.slerp(w), "pos", "w"))
    assert got[0] == pytest.approx(2**-0.5) and got[1] == pytest.approx(2**-0.5)
    for name, (fn, needs) in model.STRATEGIES.items():
        out = fn(w, base) if needs else fn(w)
        assert out.count() == 2, name
    assert model.strategy_of("layer3.attn", {"layer3.attn": "a", "*": "b"}) == "a"
    assert model.strategy_of("layer3", {"1-4": "r", "re:lay": "x"}) == "r"
    assert model.merge_models(w, {"L": "ties"}, base).count() == 2
    v = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert v.select(model.unlearn(F.col("a"), F.col("b"), "negmerge", 0.5)).first()[0] == [0.5, 2.0]


def test_model_limits_are_worked_out_once(spark, rows):
    w = spark.createDataFrame([(m, layer, pos, float((m * 7 + pos * pos) % 11)) for m in range(4) for layer in "KL" for pos in range(20)], "model_id long, layer string, pos int, w double")
    base = w.groupBy("layer", "pos").agg(F.min("w").alias("w")).localCheckpoint()
    for fn in (model.safe_merge, model.ties, model.breadcrumbs, model.emr, model.split_unlearn):
        assert fn(w, base)._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2, fn.__name__


def test_models_of_a_layer_are_read_by_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(model, "BLOCK_BYTES", 100)  # 4 rows of 3 weights
    rng = np.random.default_rng(1)
    w, c, own = rng.normal(size=(9, 3)), rng.normal(size=(2, 9)), model._Models()
    for row in w:
        own.add(np.arange(3), row)
    assert [len(b) for b in own.blocks()] == [4, 4, 1] and (np.array(list(own)) == w).all()
    assert np.allclose(own.mix(c), c @ w) and np.allclose(own.mean(), w.mean(0)) and np.allclose(own.each(lambda b: b.sum(1)), w.sum(1))
    own.add(np.array([1, 5]), np.array([7.0, 8.0]))
    assert own.pos.tolist() == [0, 1, 2, 5] and np.array_equal(list(own), [*(list(r) + [np.nan] for r in w), [np.nan, 7, np.nan, 8]], equal_nan=True)
    df = spark.createDataFrame([(m, layer, pos, float(m + pos)) for m in (2, 10, 1) for layer in ("K", None) for pos in range(3)], "model_id long, layer string, pos int, w double")
    base = df.where("model_id = 1").drop("model_id")
    for name in ("slerp", "dual_projection", "dare_ties", "star", "weight_scope_alignment", "representation_surgery", "dam", "genetic_merge"):
        fn, needs = model.STRATEGIES[name]
        out = fn(df, base) if needs else fn(df)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString(), name
    assert rows(model.dual_projection(df, base, 1.0), "layer", "pos", "w") == [(k, p, pytest.approx(13 / 3 + p)) for k in ("K", None) for p in range(3)]
    with pytest.raises(Exception, match="two weights"):
        model.slerp(df.union(df)).collect()


def test_governance(spark, rows):
    df = spark.createDataFrame([(1, "Ann", "ann@x.org"), (2, None, "none")], "id long, name string, mail string")
    policy = governance.Policy(frozenset({"merge"}), deny=frozenset({"mail"}), most_rows=2)
    assert governance.secure_merge(df, df, policy, key="id").columns == ["id", "name"]
    with pytest.raises(governance.AccessDenied):
        governance.secure_merge(df, df, governance.Policy(), key="id")
    log = governance.AuditLog()
    governance.audited_merge(df, df, log, key="id")
    log.append("read", "x", "y", at=1.0)
    assert governance.broken_links(log.frame(spark)).count() == 0
    log.entries[0]["operation"] = "forged"
    assert governance.broken_links(log.frame(spark)).count() == 1
    assert governance.table_hash(df) == governance.table_hash(df.orderBy(F.desc("id"))) != governance.table_hash(df.limit(1))
    key = F.lit("0123456789abcdef")
    secret = governance.encrypt_columns(df, ["name"], key)
    assert rows(governance.decrypt_columns(governance.rotate_key(secret, {"name": "string"}, key, F.lit("fedcba9876543210")), {"name": "string"}, F.lit("fedcba9876543210"))) == rows(df)
    assert rows(governance.personal_data(df), "field", "kind", "rows") == [("mail", "email", 1)]
    assert {r.status for r in governance.compliance(spark, {"audit_log": True}, "HIPAA").collect()} == {"pass", "fail"}
    ops = spark.createDataFrame([("m", 10.0, 5, 1, True), ("m", 20.0, 5, 0, False)], "op string, ms double, rows long, conflicts long, ok boolean")
    assert governance.health(governance.metrics(ops, ["op"])).first().status == "unhealthy"
    assert governance.prometheus(governance.metrics(ops, ["op"])).count() >= 8
    stamped = [governance.encrypt_columns(df.withColumn("ts", F.lit(t)).withColumn("name", F.lit(n)), ["name"], key) for t, n in ((1.0, "old"), (2.0, "new"))]
    assert {r.name for r in governance.decrypt_columns(governance.merge_encrypted(*stamped, "id", "ts", ["name"]), {"name": "string"}, key).collect()} == {"new"}


def test_adapters_and_stages(spark, rows):
    ad = spark.createDataFrame([("m1", "q", 1, [1.0, 2.0], [3.0, 4.0]), ("m2", "q", 1, [1.0, 2.0], [3.0, 4.0])], "model_id string, module string, rank int, a array<double>, b array<double>")
    for rank in ("max", "min", "mean", "adaptive"):
        r = model.merge_adapters(ad, rank=rank).first()
        assert r["rank"] == 1 and [round(x * y, 6) for x in r.b for y in r.a] == [3.0, 6.0, 4.0, 8.0]
    df = spark.range(3)
    out = model.run_stages({"in": df}, {"c": (["b"], lambda x: x.limit(1)), "b": (["in"], lambda x: x.limit(2))})
    assert out["c"].count() == 1
    with pytest.raises(ValueError, match="wait for"):
        model.run_stages({}, {"a": (["b"], None), "b": (["a"], None)})


def test_model_values(spark, rows):
    """Strategies against the same computed with numpy."""
    import numpy as np

    rng = np.random.default_rng(4)
    w, b = rng.normal(size=(3, 12)), rng.normal(size=12)
    df = spark.createDataFrame([(f"m{i}", "L", p, float(w[i, p])) for i in range(3) for p in range(12)], "model_id string, layer string, pos int, w double")
    base = spark.createDataFrame([("L", p, float(b[p])) for p in range(12)], "layer string, pos int, w double")
    got = lambda out: np.array([x for _, x in sorted((r.pos, r.w) for r in out.collect())])
    taus = w - b

    def star(t, fraction=0.5):
        u, s, v = np.linalg.svd(t.reshape(3, 4), full_matrices=False)
        k = max(1, int(len(s) * fraction))
        return ((u[:, :k] * s[:k]) @ v[:k]).ravel() * np.sqrt((s**2).sum() / (s[:k] ** 2).sum())

    assert np.allclose(got(model.star(df, base, columns=4)), b + np.mean([star(t) for t in taus], axis=0))
    largest = lambda t: np.where(np.abs(t) >= np.sort(np.abs(t))[-6], t, 0)
    assert np.allclose(got(model.star(df, base)), b + np.mean([largest(t) * np.linalg.norm(t) / np.linalg.norm(largest(t)) for t in taus], axis=0))
    parts = [np.linalg.svd(t.reshape(3, 4), full_matrices=False) for t in taus]
    tied = []
    for u, s, v in parts:
        x, _, y = np.linalg.svd(u.T @ parts[0][0])
        tied.append(u @ x @ y @ np.diag(s) @ v)
    tied_ = got(model.svd_knot_tying(df, base, columns=4))
    assert np.allclose(tied_, b + np.mean(tied, axis=0).ravel()) and not np.allclose(tied_, w.mean(0))
    assert np.allclose(got(model.svd_knot_tying(df, base)), w.mean(0))
    one = df.where("model_id = 'm0'")
    full, half = got(model.adarank(one, base, 1.0)), got(model.adarank(one, base, 0.5))
    assert np.allclose(full, w[0]) and 0.5 <= ((half - b) ** 2).sum() / (taus[0] ** 2).sum() < 1
    kept = got(model.dare(one, base, 0.5)) - b
    assert all(np.isclose(k, 0) or np.isclose(k, 2 * t) for k, t in zip(kept, taus[0], strict=True))
    assert np.allclose(got(model.dare(one, base, 0.0)), w[0]) and np.allclose(got(model.della(one, base, 0.0, 0.0)), w[0])
    trimmed = got(model.dare_ties(one, base, 0.0, 0.5)) - b
    assert sorted(np.flatnonzero(trimmed)) == sorted(np.argsort(-np.abs(taus[0]))[:6]) and np.allclose(trimmed[trimmed != 0], taus[0][trimmed != 0])
    for fn in (model.ada_merging, model.dam, model.evolutionary, model.genetic):
        share = np.linalg.lstsq(w.T, got(fn(df)), rcond=None)[0]
        assert np.allclose(share @ w, got(fn(df))) and np.isclose(share.sum(), 1) and (share > -1e-9).all()
    assert np.allclose(got(model.fisher(df)), (w**3).sum(0) / (w**2).sum(0))


def test_gossip_without_one_that_saw_all(spark):
    g = spark.createDataFrame([("k", "a", {"n": 3}, False), ("k", "z", {"n": 2}, False), ("k", "b", {"m": 3}, False), ("k", "c", {"n": 2, "m": 2}, False), ("j", "z", {"n": 1}, False), ("j", "a", {"n": 2, "m": 1}, True)], "key string, value string, clock map<string,bigint>, tombstone boolean")
    assert sorted((r.key, r.value, r.tombstone) for r in state.gossip_merge(g).collect()) == [("j", "a", True), ("k", "c", False)]


def test_order_of_rows(spark):
    from mergeloom.streaming import merge as streams

    a = spark.createDataFrame([(i, i // 2, "x") for i in range(40)], "at long, k long, v string").repartition(5)
    b = a.withColumn("k", F.when(F.col("at") == 20, 3).otherwise(F.col("k")))
    assert streams.unsorted(a, "k", "at").count() == 0
    assert [r["at"] for r in streams.unsorted(b, "k", "at").collect()] == [20]
    assert streams.merge_sorted(a, a, "k", position="at").count() == 40
    with pytest.raises(ValueError, match="second source"):
        streams.merge_sorted(a, b, "k", position="at")

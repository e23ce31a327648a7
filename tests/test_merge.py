import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergeloom.functions.strategies import Concat, Custom, LWW, LongestWins, MaxWins, MergeSchema, MinWins, Priority, UnionSet, strategy
from mergeloom.operators import laws
from mergeloom.operators import merge as m
from mergeloom.operators.governance import forget

S = "id long, name string, score long, _ts double"


def frame(spark, data, schema=S):
    return spark.createDataFrame(data, schema)


def test_time_stamp_then_value(spark, rows):
    a = frame(spark, [(1, "x", 5, 1.0), (2, "x", 5, 1.0), (3, None, 1, 9.0)])
    b = frame(spark, [(1, "a", 9, 2.0), (2, "y", 4, 1.0), (3, "z", None, 1.0), (4, "n", 0, 0.0)])
    assert rows(m.merge(a, b, "id")) == [(1, "a", 9, 2.0), (2, "y", 5, 1.0), (3, "z", 1, 9.0), (4, "n", 0, 0.0)]


@pytest.mark.parametrize(("prefer", "name"), [("a", "x"), ("b", "w"), ("latest", "x")])
def test_preference(spark, rows, prefer, name):
    a, b = frame(spark, [(1, "x")], "id long, name string"), frame(spark, [(1, "w")], "id long, name string")
    assert rows(m.merge(a, b, "id", prefer=prefer)) == [(1, name)]


def test_nan_loses_and_nulls_give_way(spark):
    a, b = frame(spark, [(1, float("nan"), None)], "id long, x double, y double"), frame(spark, [(1, -5.0, 2.0)], "id long, x double, y double")
    for rule in ("lww", "max", "min"):
        for x, y in ((a, b), (b, a)):
            assert m.merge(x, y, "id", schema=MergeSchema.of(None, rule)).first() == (1, -5.0, 2.0)


def test_null_keys_stay_and_repeats_fold(spark, rows):
    a = frame(spark, [(None, "p"), (None, "p"), (1, "a"), (1, "b")], "id long, name string")
    b = frame(spark, [(None, "q"), (1, "0")], "id long, name string")
    assert rows(m.merge(a, b, "id")) == [(1, "b"), (None, "p"), (None, "q")]
    assert rows(m.merge(a, b, "id", null_keys="drop", on_duplicate="fold", schema={"name": "min"})) == [(1, "0")]


def test_no_key_appends(spark, rows):
    a, b = frame(spark, [(1, "x"), (1, "x")], "id long, name string"), frame(spark, [(2,)], "id long")
    assert rows(m.merge(a, b)) == [(1, "x"), (2, None)]
    assert m.merge(a, b, dedup=False).count() == 3


def test_clashing_and_extra_columns(spark, rows):
    a, b = frame(spark, [(1, "x", 1)], "id long, a string, __rank long"), frame(spark, [(1, "y", 2)], "id long, b string, __rank long")
    assert rows(m.merge(a, b, "id", schema={"__rank": "max"}, on_duplicate="unique"), "id", "a", "b", "__rank") == [(1, "x", "y", 2)]


def test_empty_tables(spark):
    a = frame(spark, [], S)
    assert m.merge(a, a, "id").count() == 0
    assert m.merge_many([a, a], "id").count() == 0
    assert m.diff(a, a, "id").count() == 0


def test_types_widen(spark):
    a, b = frame(spark, [(1, 2)], "id int, v int"), frame(spark, [(1, 3)], "id long, v long")
    out = m.merge(a, b, "id", schema={"v": "max"})
    assert dict(out.dtypes) == {"id": "bigint", "v": "bigint"} and out.first() == (1, 3)


def test_nfc_keys(spark):
    a, b = frame(spark, [("\u00e9", 1)], "id string, v long"), frame(spark, [("e\u0301", 2)], "id string, v long")
    assert m.merge(a, b, "id", schema={"v": "max"}, nfc=True).count() == 1
    assert m.merge(a, b, "id", schema={"v": "max"}).count() == 2


LAWFUL = {"lww": LWW(), "max": MaxWins(), "min": MinWins(), "priority": Priority(("a", "b")), "longest": LongestWins()}
#: A value that met no other stays as it came, so grouping can show in these; order can't.
COMMUTATIVE = {"union": UnionSet(), "concat": Concat()}


def versions(spark, rules):
    cells = ["a", "b", "ab", "b,a", "c", None, "a | b"]
    data = [[(i, *[v] * len(rules), 0.0) for i, v in enumerate(cells[k:] + cells[:k])] for k in range(3)]
    return [frame(spark, d, f"id long, {', '.join(f'{r} string' for r in rules)}, _ts double") for d in data]


def test_laws_of_strategies(spark):
    merge = lambda rules: lambda x, y: m.merge(x, y, "id", "_ts", schema=MergeSchema.of(rules), on_duplicate="unique")
    for law in laws.verify(merge(LAWFUL), *versions(spark, LAWFUL)):
        assert law.holds, law
    law = laws.commutative(merge(COMMUTATIVE), *versions(spark, COMMUTATIVE)[:2])
    assert law.holds, law


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.text("abc", max_size=3)), st.integers(0, 2)), max_size=8))
def test_pairwise_is_the_fold(spark, rows, data):
    """With one row's time for one cell, merging in pairs is merging at once."""
    kind = f"id long, {', '.join(f'{r} string' for r in LAWFUL)}, _ts double"
    parts = [frame(spark, [(k, *[v] * len(LAWFUL), float(t)) for k, v, t in data[i::3] if v is not None], kind) for i in range(3)]
    schema = MergeSchema.of(LAWFUL)
    whole = rows(m.merge_many(parts, "id", schema, "_ts"), "id", *LAWFUL)
    folded = [m.fold(p, ["id"], schema, "_ts") for p in parts]
    pairs = m.merge(m.merge(folded[0], folded[1], "id", "_ts", schema=schema, on_duplicate="unique"), folded[2], "id", "_ts", schema=schema, on_duplicate="unique")
    # All but the longest: its ties go by time, and a merged row has the latest time for all its cells.
    assert [r[:5] for r in rows(pairs, "id", *LAWFUL)] == [w[:5] for w in whole]


def test_custom_folds_many(spark, rows):
    parts = [frame(spark, [(1, float(i))], "id long, v double") for i in range(4)]
    assert rows(m.merge_many(parts, "id", {"v": Custom(lambda a, b: a + b)})) == [(1, 6.0)]


def test_schema_round_trip():
    s = MergeSchema.of({"a": "priority:lo,hi", "b": "union:;", "c": "max"}, "longest")
    assert MergeSchema.from_json(s.to_json()) == s
    with pytest.raises(ValueError, match="unknown strategy"):
        strategy("nope")


def test_order_of_replicas_never_tells(spark, rows):
    parts = [frame(spark, [(1, n, i, float(t)), (2, n * 2, i, 0.0)]) for i, (n, t) in enumerate([("x", 1), ("y", 1), ("z", 0)])]
    results = {tuple(rows(m.merge_many(p, "id", {"score": "max"}, "_ts"))) for p in itertools.permutations(parts)}
    assert len(results) == 1


def test_unmerge_and_forget(spark, rows):
    a, b = frame(spark, [(1, "x", 5), (2, "p", 1)], "id long, name string, score long"), frame(spark, [(1, "a", 9), (3, "n", 0)], "id long, name string, score long")
    merged, log = m.merge(a, b, "id", schema=MergeSchema(MaxWins())), m.provenance(a, b, "id", MergeSchema(MaxWins()))
    assert rows(m.unmerge(merged, log, "id", "b")) == rows(a)
    assert rows(m.unmerge(merged, log, "id", "a")) == rows(b)
    out, report = forget(merged, log, "id", "b")
    assert report.first().residual_cells == 0 and m.unmerge_residual(merged, log, "id", "b").count() == 3


def test_verified_decorator(spark):
    one = lambda: tuple(frame(spark, [(1, v)], "id long, v long") for v in (1, 2, 3))
    good = laws.verified(one)(lambda x, y: m.merge(x, y, "id", schema={"v": "max"}))
    assert good(*one()[:2]).first().v == 2
    bad = laws.verified(one)(lambda x, y: m.merge(x, y, "id", prefer="a"))
    with pytest.raises(AssertionError):
        bad(*one()[:2])


def test_plan_has_one_join_and_no_python(spark):
    a, b = frame(spark, [(1, "x", 5, 1.0)]), frame(spark, [(1, "a", 9, 2.0)])
    plan = m.merge(a, b, "id", schema={"name": "longest"}, on_duplicate="unique", null_keys="drop")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" not in plan and plan.count("SortMergeJoin") <= 1


def test_python_text(spark):
    from mergeloom.functions.values import python_text

    values = [0.0, -0.0, 1.0, 0.001, 0.0001, 0.00012345, -0.0005, 1e-5, 1.5e-07, -2.5e-10, 1e7, 12345678.5, 1e15, 123456789012345.6, 1e16, -1.25e16, 1.7976931348623157e308, 5e-324, 1e100, 3.14, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = {r.i: r.t for r in df.select("i", python_text(F.col("v"), T.DoubleType()).alias("t")).collect()}
    assert got == {i: str(v) for i, v in enumerate(values)}


def test_nested_cells(spark):
    kind = "id long, ts double, doc struct<a: long, b: string, inner: struct<c: long>>, items array<long>, rows array<struct<p: long, q: long>>"
    a = spark.createDataFrame([(1, 1.0, (1, "x", (5,)), [1, 9, 3], [(1, 2)])], kind)
    b = spark.createDataFrame([(1, 2.0, (2, None, (4,)), [4, 2], [(3, 1), (7, 7)])], kind)
    row = m.merge(a, b, "id", "ts", schema={"c": "min", "items": "max", "q": "min"}).first()
    assert (row.doc.a, row.doc.b, row.doc.inner.c) == (2, "x", 4)
    assert row["items"] == [4, 9, 3] and [tuple(r) for r in row.rows] == [(3, 1), (7, 7)]
    whole = m.merge(a, b, "id", "ts", schema={"doc": "lww"}).first()
    assert tuple(whole.doc)[:2] == (2, None)

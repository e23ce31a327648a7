import json

import pytest
from pyspark.sql import functions as F

from mergeloom.functions import sql
from mergeloom.sources import files, sqltext
from mergeloom.sources.records import RecordDestination
from mergeloom.sources.snapshots import Snapshots
from mergeloom.sources.store import ClockedTable, MergeStore
from mergeloom.streaming import merge as streams


@pytest.mark.parametrize("name", ["t.csv", "t.tsv", "t.json", "t.jsonl", "t.parquet", "t.orc", "t.arrow"])
def test_round_trips(spark, tmp_path, rows, name):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, None)], "id long, t string")
    path = f"{tmp_path}/{name}"
    files.write_table(df, path, "jsonl" if name == "t.json" else None)
    back = files.read_table(spark, path, "jsonl" if name == "t.json" else None, schema=None if name.endswith("arrow") else df.schema)
    assert rows(back, "id", "t") == rows(df)


def test_formats(spark, tmp_path):
    with pytest.raises(ValueError, match="format"):
        files.detect_format("x.xyz")
    (tmp_path / "one.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_table(spark, f"{tmp_path}/one.json").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnope\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_table(spark, f"{tmp_path}/bad.jsonl", schema="a int").collect()
    df = spark.createDataFrame([(1, 5)], "id long, v long")
    files.write_ipc(df, f"{tmp_path}/a.arrow")
    assert files.merge_ipc(spark, f"{tmp_path}/a.arrow", f"{tmp_path}/a.arrow", "id").count() == 1


def test_store(spark, tmp_path, rows):
    s = MergeStore(spark, f"file://{tmp_path}/s", "id", {"v": "max"})
    one = s.ingest(spark.createDataFrame([(1, 5, None), (None, 9, None)], "id long, v long, t string"))
    assert (one["version"], one["rows"], one["new"]) == (1, 1, 1)
    two = s.ingest(spark.createDataFrame([(1, 3, "x"), (2, 1, None)], "id long, v long, t string"))
    assert (two["new"], two["updated"]) == (1, 1) and rows(s.read()) == [(1, 5, "x"), (2, 1, None)]
    assert s.ingest(s.read())["rows"] == 2
    again = MergeStore(spark, f"file://{tmp_path}/s")
    assert again.rules == s.rules and rows(again.read(1)) == [(1, 5, None)]
    s.ingest(spark.createDataFrame([(3, None, None)], "id long, v long, t string"))
    assert s.compact()["rows"] == 2 and rows(s.read(), "id") == [(1,), (2,)]
    c = ClockedTable(spark, f"file://{tmp_path}/c", "id")
    c.merge_insert(spark.createDataFrame([(1, "a")], "id long, v string"), "n1", 5)
    c.merge_insert(spark.createDataFrame([(1, "b")], "id long, v string"), "n2", 3)
    assert rows(c.read(), "id", "v", "_ts") == [(1, "a", 5.0)] and rows(c.clock()) == [("n1", 5.0)]


def test_snapshots(spark, tmp_path, rows):
    s = Snapshots(spark, f"file://{tmp_path}")
    a, b = spark.createDataFrame([(1, 5), (2, 1)], "id long, v long"), spark.createDataFrame([(1, 7)], "id long, v long")
    s.register("a", a)
    s.register("b", b)
    s.branch("c", "a")
    assert rows(s.changes("a", "b", "id"), "id", "change") == [(1, "modified"), (2, "removed")]
    assert s.changes("a", "c", "id").count() == 0
    assert rows(s.merge("a", "b", "id", {"v": "max"}, "m")) == [(1, 7), (2, 1)] and rows(Snapshots(spark, f"file://{tmp_path}")["m"]) == [(1, 7), (2, 1)]
    assert s.audit_trail().count() == 5


def test_records(spark, tmp_path, rows):
    d = RecordDestination(spark, f"file://{tmp_path}/r", {"users": ["id"]}, {"users": "id long, name string"})
    message = lambda i, n, t: json.dumps({"type": "RECORD", "record": {"stream": "users", "data": json.dumps({"id": i, "name": n}), "emitted_at": t}})
    df = spark.createDataFrame([(message(1, "a", 1.0),), (message(1, "b", 3.0),), (message(1, "c", 2.0),), ('{"type": "LOG"}',)], "value string")
    assert d.check() and d.write(df)["users"]["rows"] == 1
    assert rows(d.read("users"), "id", "name") == [(1, "b")]
    with pytest.raises(ValueError, match="no key"):
        d.write(spark.createDataFrame([(message(None, "x", 1.0),)], "value string"))


def test_sql_text(spark):
    text = sqltext.model("m", ["a", "b", "c"], ["id"], {"v": "max", "t": "priority:lo,hi"}, "ts")
    assert text.count("FULL OUTER JOIN") == 2 and "ref('b')" in text
    assert "unique" in sqltext.schema_yml("m", ["id"], {"v": "max"})
    names = sql.register(spark)
    assert len(names) == 6
    got = spark.sql("SELECT merge_lww('a', 'b', 1, 2), merge_max(1, double('nan')), merge_union('b, a', 'c'), merge_longest('aa', 'b'), merge_clock(map('x', 1L), map('x', 2L, 'y', 1L))").first()
    assert tuple(got) == ("b", 1.0, "a,b,c", "aa", {"x": 2, "y": 1})


def test_streams(spark, tmp_path, rows):
    df = spark.createDataFrame([(i % 3, i, float(i)) for i in range(12)], "k long, v long, ts double")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    store = MergeStore(spark, f"file://{tmp_path}/s", "k", None, "ts")
    streams.upsert_stream(streams.read_events(spark, f"{tmp_path}/in", df.schema), store, f"{tmp_path}/ck").awaitTermination()
    assert rows(store.read(), "k", "v") == [(0, 9), (1, 10), (2, 11)]
    seen = []
    streams.delta_stream(streams.read_events(spark, f"{tmp_path}/in", df.schema), MergeStore(spark, f"file://{tmp_path}/s2", "k", None, "ts"), lambda d, n: seen.append(d.count()), f"{tmp_path}/ck2").awaitTermination()
    assert sum(seen) >= 3
    q = streams.latest_by_key(streams.read_events(spark, f"{tmp_path}/in", df.schema), "k", "v", "ts").writeStream.outputMode("update").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("latest").groupBy("key").agg(F.max("value"))) == [(0, 9), (1, 10), (2, 11)]


def test_sorted_merge(spark, rows):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k long, v string")
    b = spark.createDataFrame([(1, "z"), (2, "y")], "k long, v string")
    assert [tuple(r) for r in streams.merge_sorted(a, b, "k").collect()] == [(1, "z"), (1, "b"), (2, "y"), (3, "c")] or rows(streams.merge_sorted(a, b, "k")) == [(1, "b"), (1, "z"), (2, "y"), (3, "c")]
    jumbled = spark.createDataFrame([(0, 1), (1, 5), (2, 3)], "i long, k long")
    assert rows(streams.unsorted(jumbled, ["k"], "i"), "k") == [(3,)]


def test_command_line(spark, tmp_path, capsys):
    from mergeloom.cli import main

    (tmp_path / "a.csv").write_text("id,v,t\n1,5,x\n2,1,y\n")
    (tmp_path / "b.csv").write_text("id,v,t\n1,7,w\n3,2,z\n")
    a, b = f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"
    run = lambda *args: (main(args, spark), sorted(map(json.loads, capsys.readouterr().out.splitlines()), key=str))[1]
    assert [r["v"] for r in run("merge", a, b, "--key", "id", "--strategy", "v=max")] == [7, 1, 2]
    assert len(run("diff", a, b, "--key", "id")) == 4 and len(run("merkle", a, b, "--key", "id")) == 3
    assert len(run("query", "MERGE a, b ON id WHERE v > 1", "--source", f"a={a}", f"b={b}")) == 2
    assert main(["delta", a, b, "--key", "id", "--out", f"{tmp_path}/d.parquet"], spark) == 0
    assert [r["t"] for r in run("apply", a, f"{tmp_path}/d.parquet", "--key", "id")] == ["w", "z"]
    assert len(run("dedup", a, "--order", "id")) == 2 and len(run("provenance", a, b, "--key", "id")) == 6 and run("scan", a) == []
    assert main(["verify", a, b, a, "--key", "id", "--strategy", "v=max"], spark) == 0


def test_wire(spark):
    from mergeloom.operators import wire

    value = {"a": [1, -2**62, 1.5, None, True, "é"], 2: {"x", "y"}, "b": b"\x00", "n": {}}
    for compress in (False, True):
        data = wire.serialize(value, "map", compress)
        assert wire.deserialize(data) == value and wire.peek(data)["kind"] == "map" and wire.peek(data)["size"] == len(data)
        with pytest.raises(wire.WireError):
            wire.deserialize(data[:-1])
    with pytest.raises(wire.WireError):
        wire.peek(b"nope" + bytes(20))
    df = spark.createDataFrame([({"a": 1},), (None,)], "c map<string,long>")
    assert [r[0] for r in df.select(wire.from_wire(wire.to_wire(F.col("c")), "map<string,bigint>")).collect()] == [{"a": 1}, None]


def test_async(spark):
    import asyncio

    from mergeloom.streaming import aio

    a, b = spark.createDataFrame([(1, 5)], "id long, v long"), spark.createDataFrame([(1, 7), (2, 1)], "id long, v long")

    async def both():
        return await aio.amerge(a, b, "id", schema={"v": "max"}), [len(x) async for x in aio.amerge_stream(a, b, "id", size=1)], [len(x) async for x in aio.amerge_sorted_stream(a, b, "id")]

    rows_, one, two = asyncio.run(both())
    assert sorted(map(tuple, rows_)) == [(1, 7), (2, 1)] and one == [1, 1] and two == [2]

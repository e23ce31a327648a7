"""Replicated state as tables: counters, registers, sets, maps, clocks, gossip, agents.

A state is a table of small facts, and merging any number of replicas is one
aggregation over their union: maxima, latest values, unions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

# --- counters ---


def gcounter_merge(state: DataFrame, counter: str = "counter", node: str = "node", n: str = "n") -> DataFrame:
    """Grow-only counters of all replicas: the greatest count of each node; negative counts are an error."""
    checked = F.when(F.col(n) < 0, F.raise_error(F.lit("a grow-only counter has no negative counts"))).otherwise(F.col(n))
    return state.groupBy(counter, node).agg(F.max(checked).alias(n))


def gcounter_value(state: DataFrame, counter: str = "counter", node: str = "node", n: str = "n") -> DataFrame:
    """The sum over nodes of each counter."""
    return gcounter_merge(state, counter, node, n).groupBy(counter).agg(F.sum(n).alias("value"))


def pncounter_value(state: DataFrame, counter: str = "counter", node: str = "node", sign: str = "sign", n: str = "n") -> DataFrame:
    """Counters with a grow-only half for each sign (1, -1): increments less decrements."""
    halves = state.groupBy(counter, node, sign).agg(F.max(n).alias(n))
    return halves.groupBy(counter).agg(F.sum(F.col(n) * F.col(sign)).alias("value"))


# --- registers, sets, maps ---


def register_merge(state: DataFrame, key: str | Sequence[str], value: str = "value", ts: str = "ts", node: str = "node") -> DataFrame:
    """Last-writer-wins registers: the latest value, at the same time that of the greater node, then the greater value."""
    keys = [key] if isinstance(key, str) else list(key)
    best = F.max(F.struct(F.coalesce(F.col(ts).cast("double"), F.lit(0.0)).alias(ts), F.col(node), F.col(value))).alias("best")
    return state.groupBy(*keys).agg(best).select(*keys, f"best.{value}", f"best.{ts}", f"best.{node}")


def orset_merge(adds: DataFrame, removes: DataFrame | None = None, key: str = "set", element: str = "element", tag: str = "tag") -> DataFrame:
    """Tags of the elements that are in an observed-remove set: all added tags but those seen removed.

    Without ``removes`` tags only ever join, so that a replica which hasn't seen a
    removal brings the element back.
    """
    tags = adds.select(key, element, tag).distinct()
    return tags if removes is None else tags.join(removes.select(key, element, tag).distinct(), [key, element, tag], "left_anti")


def orset_elements(adds: DataFrame, removes: DataFrame | None = None, key: str = "set", element: str = "element", tag: str = "tag") -> DataFrame:
    return orset_merge(adds, removes, key, element, tag).select(key, element).distinct()


def lwwmap_merge(puts: DataFrame, deletes: DataFrame, key: str | Sequence[str], value: str = "value", ts: str = "ts", node: str = "node") -> DataFrame:
    """Live entries of a last-writer-wins map: the register's time is after its latest deletion."""
    keys = [key] if isinstance(key, str) else list(key)
    gone = deletes.groupBy(*keys).agg(F.max(F.col(ts).cast("double")).alias("__gone"))
    return register_merge(puts, keys, value, ts, node).join(gone, keys, "left").where(F.col("__gone").isNull() | (F.col(ts) > F.col("__gone"))).drop("__gone")


# --- clocks: map<string, bigint>, a missing node counts 0 ---


def clock_merge(a: Column, b: Column) -> Column:
    """The greater count of every node."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_increment(clock: Column, node: Column) -> Column:
    one = F.create_map(node, F.coalesce(F.try_element_at(clock, node), F.lit(0)) + 1)
    return F.map_zip_with(clock, one, lambda k, x, y: F.coalesce(y, x))


def clock_compare(a: Column, b: Column) -> Column:
    """'before', 'after', 'equal' or 'concurrent', of a against b."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    less, more = F.exists(pairs, lambda d: d < 0), F.exists(pairs, lambda d: d > 0)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def clock_merge_agg(df: DataFrame, keys: Sequence[str], clock: str = "clock") -> DataFrame:
    """One clock for each key: the greater count of every node over all rows."""
    entries = df.select(*keys, F.explode(clock).alias("__node", "__n")).groupBy(*keys, "__node").agg(F.max("__n").alias("__n"))
    return entries.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__node", "__n")))).alias(clock))


def dotted_merge(a: Column, b: Column) -> Column:
    """Dotted clocks, struct<clock, node, counter>: both dots join the merged clock, and no dot remains."""
    entry = lambda x: F.when(x["node"].isNotNull(), F.create_map(x["node"], x["counter"])).otherwise(F.create_map().cast("map<string,bigint>"))
    merged = clock_merge(clock_merge(a["clock"], entry(a)), clock_merge(b["clock"], entry(b)))
    return F.struct(merged.alias("clock"), F.lit(None).cast("string").alias("node"), F.lit(None).cast("bigint").alias("counter"))


def dotted_descends(a: Column, b: Column) -> Column:
    """Whether a has seen all that b has, its dot included."""
    seen = lambda x: F.when(x["node"].isNotNull(), clock_merge(x["clock"], F.create_map(x["node"], x["counter"]))).otherwise(x["clock"])
    return clock_compare(seen(b), seen(a)).isin("before", "equal")


# --- gossip ---


def _undominated(states: DataFrame, rank: Column) -> DataFrame:
    """Rows (key, best): of each clock that no other of its key dominates, the entry of the greatest rank.

    A clock is dominated if another has at least its count for every node and more
    for one.  What is dominated is so by a clock that isn't, so clocks can go one
    step after another: first those under the highest of the same nodes, then those
    under the highest of the key.  Another that dominates one of the rest stands
    before it in the list, by count, of each of its nodes; so a clock meets the
    first, then the others, only in that of its lists where fewest stand before it.
    """
    kind = states.schema["clock"].dataType
    counts = F.array_sort(F.filter(F.map_entries(F.coalesce("clock", F.create_map().cast(kind))), lambda e: e["value"] > 0))
    height = F.aggregate("c", F.lit(0).cast("decimal(38,0)"), lambda s, e: (s + e["value"]).cast("decimal(38,0)"))
    clocks = states.where("key IS NOT NULL").select("key", counts.alias("c"), F.struct("value", "tombstone").alias("best"), rank.alias("rank")).groupBy("key", "c").agg(F.max_by("best", "rank").alias("best"))
    clocks = clocks.withColumn("height", height).withColumn("nodes", F.transform("c", lambda e: e["key"]))

    def under(c: str, d: str) -> Column:
        short = F.map_zip_with(F.map_from_entries(c), F.map_from_entries(d), lambda _, x, y: F.coalesce(x, F.lit(0)) > F.coalesce(y, F.lit(0)))
        return (F.col(c) != F.col(d)) & ~F.exists(F.map_values(short), lambda more: more)

    first = F.max_by("c", F.struct("height", "c")).alias("d"), F.max("height").alias("h")
    alike = clocks.groupBy("key", "nodes").agg(*first)
    left = clocks.join(alike.select("key", "nodes", "d"), ["key", "nodes"]).where(~under("c", "d")).drop("d", "nodes")
    highest = alike.groupBy("key").agg(F.max_by("d", F.struct("h", "d")).alias("d"))
    left = left.join(highest, "key").where(~under("c", "d")).drop("d").withColumn("id", F.sha2(F.to_json("c"), 256))
    shared_dir(states.sparkSession)
    left = left.checkpoint()

    before = Window.partitionBy("key", "node").orderBy(F.desc("n"), F.desc("height"), "id")
    lists = left.select("key", "id", "height", F.explode("c").alias("e")).select("key", "id", "height", F.col("e.key").alias("node"), F.col("e.value").alias("n")).withColumn("at", F.row_number().over(before))
    shortest = lists.groupBy("key", "id").agg(F.min(F.struct("at", "node")).alias("s")).where("s.at > 1").select("key", "id", "s.node", "s.at")
    others = lists.select("key", "node", F.col("id").alias("other"), F.col("at").alias("of"))

    def dominated(pairs: DataFrame) -> DataFrame:
        both = pairs.join(left.select("key", "id", "c"), ["key", "id"]).join(left.select("key", F.col("id").alias("other"), F.col("c").alias("d")), ["key", "other"])
        return both.where(under("c", "d")).select("key", "id").distinct()

    out = dominated(shortest.join(others.where("of = 1"), ["key", "node"]))
    left = left.join(out, ["key", "id"], "left_anti")
    rest = shortest.where("at > 2").join(out, ["key", "id"], "left_anti").join(others.where("of > 1"), ["key", "node"]).where("of < at")
    return left.join(dominated(rest), ["key", "id"], "left_anti").select("key", "best")


def gossip_merge(states: DataFrame, mode: str = "causal") -> DataFrame:
    """Entries (key, value, clock, tombstone) of all replicas as one for each key; clocks merge to the greatest.

    causal: entries that another's clock dominates are out, the greater value of
    the rest wins.  reference: the greater (value, tombstone) wins even where it is
    dominated.
    """
    rank = F.struct(F.col("value").cast("string").alias("v"), F.col("tombstone"))
    merged = clock_merge_agg(states, ["key"]).withColumnRenamed("clock", "merged")
    if mode == "reference":
        best = states.groupBy("key").agg(F.max_by(F.struct("value", "tombstone"), rank).alias("best"))
    elif mode == "causal":
        best = _undominated(states, rank).groupBy("key").agg(F.max_by("best", F.struct(F.col("best.value").cast("string").alias("v"), F.col("best.tombstone"))).alias("best"))
    else:
        raise ValueError("mode is 'causal' or 'reference'")
    return best.join(merged, "key").select("key", "best.value", F.col("merged").alias("clock"), "best.tombstone")


def gossip_digest(state: DataFrame) -> DataFrame:
    """Keys and hashes of their entries, to find differences without values."""
    entry = F.concat_ws("|", F.coalesce(F.col("value").cast("string"), F.lit("")), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("clock")))), F.col("tombstone").cast("string"))
    return state.select("key", F.sha2(entry, 256).alias("hash"))


def anti_entropy(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Keys that two digests don't share: direction 'push' (mine only), 'pull' (theirs only) or 'both'."""
    both = mine.withColumnRenamed("hash", "m").join(theirs.withColumnRenamed("hash", "t"), "key", "full_outer").where(~F.col("m").eqNullSafe(F.col("t")))
    return both.select("key", F.when(F.col("t").isNull(), "push").when(F.col("m").isNull(), "pull").otherwise("both").alias("direction"))


def apply_entries(mine: DataFrame, entries: DataFrame) -> DataFrame:
    """Take entries over by causality: the later clock wins, concurrent ones by the greater clock as text."""
    a, b = (df.select("key", F.struct("value", "clock", "tombstone").alias(n)) for df, n in ((mine, "a"), (entries, "b")))
    text = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    order = clock_compare(F.col("a.clock"), F.col("b.clock"))
    theirs = F.col("a").isNull() | (order == "before") | ((order == "concurrent") & (text(F.col("b.clock")) >= text(F.col("a.clock"))))
    picked = a.join(b, "key", "full_outer").select("key", F.when(F.col("b").isNull(), F.col("a")).when(theirs, F.col("b")).otherwise(F.col("a")).alias("e"))
    return picked.select("key", "e.value", "e.clock", "e.tombstone")


# --- agents ---


def agent_facts(facts: DataFrame) -> DataFrame:
    """Facts (key, value, confidence, source_agent, timestamp) of all agents: the latest, then the greater agent."""
    best = F.max(F.struct("timestamp", "source_agent", "confidence", "value")).alias("b")
    return facts.groupBy("key").agg(best).select("key", "b.value", "b.confidence", "b.source_agent", "b.timestamp")


def agent_messages(messages: DataFrame, group: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Messages (agent, message, timestamp) each once, by time; of each group the latest ``most``."""
    out = messages.dropDuplicates([*group, "agent", "message", "timestamp"])
    if most is None:
        return out
    latest = Window.partitionBy(*group).orderBy(F.desc("timestamp"), F.desc("agent"), F.desc("message"))
    return out.withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= most).drop("__n")


def shared_knowledge(*agents: DataFrame) -> DataFrame:
    """Facts of several agents as one table."""
    out = agents[0]
    for a in agents[1:]:
        out = out.unionByName(a, allowMissingColumns=True)
    return agent_facts(out)


# --- registries and contributions ---


def max_register(state: DataFrame, key: str, value: str) -> DataFrame:
    """Registers that only rise, such as epochs."""
    return state.groupBy(key).agg(F.max(value).alias(value))


def contributions(adds: DataFrame, removed: DataFrame, id_col: str = "model_id", version: str = "version", content: str = "hash", tag: str = "tag", keep: str = "version") -> DataFrame:
    """One live contribution for each id: of the tags that weren't removed the highest version, then the smaller hash.

    keep: 'version', or 'last' or 'first' by the column ``ts``.
    """
    live = adds.join(removed.select(tag).distinct(), tag, "left_anti")
    order = {"version": [F.desc(version), F.asc(content)], "last": [F.desc("ts"), F.asc(content)], "first": [F.asc("ts"), F.asc(content)]}[keep]
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(*order, F.asc(tag)))
    return live.withColumn("__n", rank).where("__n = 1").drop("__n")

"""Near-duplicate documents by bottom-k sketches.

A document's set holds its distinct word shingles; one hash function orders all
shingles, and a set's sketch is its k smallest hashes.  Two sets of Jaccard
similarity t or more share at least ``least_shared`` of their sketches' values
(surely where the union is short, else but for one pair in a billion), so they
share one of the rarest ``size - least_shared + 1`` values of each sketch.
Inverted lists of only those rarest values therefore find every pair, and
frequent lines and passages, which are the commonest values, make no list unless
they are most of a document.

Pairs are never written out.  Documents that meet in a list, directly or over
others, form a cluster; a cluster is cut into blocks, and a task compares two
blocks: overlaps of sketches, then the estimate from the union's bottom k, then
exact intersections of full sets.  A task returns a spanning forest of the links
it confirmed.

Clusters of more than a block meet hubs first: the documents whose sketch values
are the commonest, that is the middle of a group of near copies, are compared with
all others of the cluster, round by round, until a round links few.  What hubs link
is one class already, so pairs within a class, and lists of one class alone, need
no comparison: near copies that link with a hub cost work in proportion to their
number.  Texts that share values but link with no hub are compared block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize, ship, workspace
from .textbytes import blocks, hash_runs, mix, runs, weights

#: Chance to which a pair at the similarity itself may be missed by the lists.
MISS = 1e-9
#: A block of a cluster holds about so many documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 19
#: Hubs of a cluster in a round; rounds go on while each links so large a part of what is left.
HUBS, PROGRESS = 16, 1 / 8


@lru_cache(maxsize=64)
def binomial_floor(k: int, percent: int, miss: float = MISS) -> int:
    """The most that k draws of this percentage reach but for a chance of ``miss``."""
    p, total, c = percent / 100, 0.0, 0
    while True:
        total += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if total > miss:
            return max(c, 1)
        c += 1


def least_shared(n: int, k: int, percent: int) -> int:
    """Values that the sketch of a set of n shares with that of any set of at least this similarity."""
    union = n * 100 // percent
    if union <= k:  # both sketches are the whole sets
        return max(1, -(-n * percent // 100))
    c = max(binomial_floor(k, percent), k - union * (100 - percent) // 100)
    return min(c, -(-n * percent // 100)) if n <= k else c


def shingle_sets(column: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Words are runs of bytes other than space and \\t to \\r, A-Z lower-cased.
    Fewer words than ``words`` make one shingle of them all; none, no shingle.
    """
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    by = weights(words + 1, 7)
    for i, j, data, offsets in blocks(column):
        starts, stops, bounds = runs(~space[data], offsets)
        hashed = hash_runs(lower[data], starts, stops)
        rolled = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
        for w in range(words):
            rolled += hashed[w : w + len(rolled)] * by[w]
        rolled = mix(rolled)
        for row in range(j - i):
            at, end = bounds[row], bounds[row + 1]
            n = end - at
            if n >= words:
                yield np.unique(rolled[at : end - words + 1])
            elif n:
                yield mix(np.append(hashed[at:end] * by[:n], by[words:] * np.uint64(n)).sum(dtype=np.uint64, keepdims=True))
            else:
                yield np.zeros(0, np.uint64)


def _sketches(k: int, percent: int, words: int):
    from hashlib import blake2b

    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("prefix", pa.int32()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ns, digests, prefixes, sketches = [], [], [], []
            for got in shingle_sets(batch.column(1), words):
                size = min(len(got), k)
                ns.append(len(got))
                digests.append(blake2b(got.tobytes(), digest_size=16).digest())
                prefixes.append(size - least_shared(len(got), k, percent) + 1 if len(got) else 0)
                sketches.append(got[:k].view(np.int64))
            if ns:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], schema=schema)

    return run, "id long, n long, digest binary, prefix int, sketch array<long>"


def _sets(words: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return run, "id long, shingles binary"


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections of a left with a right set, by products of slices of the incidence matrices."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    flat = [np.concatenate(side) if len(side) else np.zeros(0, np.uint64) for side in (left, right)]
    common = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    spots = []
    for values, n in zip(flat, sizes, strict=True):
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        keep = common[at] == values if len(common) else np.zeros(len(values), bool)
        rows = np.repeat(np.arange(len(n)), n)
        order = np.argsort(at[keep], kind="stable")
        spots.append((at[keep][order], rows[keep][order]))
    for first in range(0, len(common), columns):
        parts = []
        for (at, rows), n in zip(spots, sizes, strict=True):
            a, b = np.searchsorted(at, [first, first + columns])
            part = np.zeros((len(n), min(columns, len(common) - first)), np.float32)
            part[rows[a:b], at[a:b] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], k: int, percent: int, self_join: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all sets of at least this similarity: sketches first, then full sets."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    small, large = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
    maybe = 100 * small >= percent * large
    if self_join:
        maybe &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    # So few pairs are decided on the full sets at once; the links are the same.
    if len(left) * len(right) > 64 and maybe.any():
        overlap = shared_counts([s[:k] for s in left], [s[:k] for s in right])
        need = [np.array([least_shared(int(n), k, percent) if n else 1 for n in side]) for side in sizes]
        maybe &= overlap >= np.minimum.outer(*need)
        # At most all that the sketches share is in the union's bottom k, of which the share estimates the similarity.
        union = np.minimum(k, np.minimum(sizes[0], k)[:, None] + np.minimum(sizes[1], k)[None, :] - overlap)
        floor = np.where(union < k, percent * union / 100, binomial_floor(k, percent))
        maybe &= overlap >= floor
    rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    if not len(rows):
        return rows, cols
    inter = shared_counts([left[r] for r in rows], [right[c] for c in cols])
    union = sizes[0][rows][:, None] + sizes[1][cols][None, :] - inter
    at = np.nonzero(maybe[np.ix_(rows, cols)] & (100 * inter >= percent * union))
    return rows[at[0]], cols[at[1]]


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the linked nodes: the smallest id that links a, b (indices into ids) lead to."""
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            break
        root = new
    touched = np.unique(np.concatenate([a, b]))
    return ids[touched], root[touched]


def _compare(k: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        side = table.column("side").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(second) and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        if alone:
            second = first
        if not len(first) or not len(second):
            return schema.empty_table()
        a, b = linked([sets[x] for x in first], [sets[x] for x in second], k, percent, alone)
        node, root = forest(ids, first[a], second[b]) if len(a) else (np.zeros(0, np.int64),) * 2
        keep = node != root
        return pa.table([pa.array(node[keep]), pa.array(root[keep])], schema=schema)

    return run, "a long, b long"


def _parts() -> Column:
    """Blocks that rows of a group with a column n need."""
    return F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("parts")


def _clusters(lists: DataFrame, nodes: DataFrame, at: str) -> DataFrame:
    """Rows (id, n, score, cluster, parts): nodes that meet in lists, directly or over others."""
    heads = materialize(lists.groupBy("value").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").drop("last"), f"{at}/heads")
    found = connected_components(lists.join(heads, "value").where("id != head").select("id", "head"), "id", "head")
    sized = found.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(nodes, "id")
    return materialize(sized.join(sized.groupBy("cluster").agg(_parts()), "cluster").select("id", "n", "score", "cluster", "parts"), f"{at}/members")


def _hub_links(large: DataFrame, sets: DataFrame, k: int, percent: int, at: str) -> list[DataFrame]:
    """Links (a, b) of the hubs of each round with the rest of their clusters."""
    run, schema = _compare(k, percent)
    rounds, left, n = [], large, large.count()
    while n:
        here = f"{at}/hubs-{len(rounds)}"
        # Only the first few of each task's rows of a cluster are shuffled for the ranks.
        ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "id")))
        hubs = ranked.where(F.col("rank") <= HUBS).select("id", "cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
        columns = "cluster", "i", F.lit(-1).alias("j")
        those = sets.join(hubs, "id").select(*columns, F.lit(1).alias("side"), "id", "shingles")
        all_of_them = sets.join(left, "id").withColumn("i", F.expr("pmod(xxhash64(id), parts)")).select(*columns, F.lit(0).alias("side"), "id", "shingles")
        links = materialize(all_of_them.unionByName(those).groupBy("cluster", "i", "j").applyInArrow(run, schema), f"{here}/links")
        rounds.append(links)
        touched = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
        rest = materialize(left.drop("parts").join(touched, "id", "left_anti"), f"{here}/rest")
        # What is left of a cluster and fits a block is left to the blocks.
        left = materialize(rest.join(rest.groupBy("cluster").agg(_parts()).where("parts > 1"), "cluster"), f"{here}/left")
        before, n = n, left.count()
        if before - rest.count() < PROGRESS * before:
            break
    return rounds


def _dealt(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (cluster, i, j, side, id, shingles): every two blocks of a cluster, but those of one class."""
    # Classes of more than a block have blocks of their own, the others share some.
    large = members.groupBy("cluster", "class").agg(F.count("*").alias("count")).where(F.col("count") > BLOCK_DOCS).select("cluster", "class", F.lit(True).alias("own"))
    grouped = members.join(large, ["cluster", "class"], "left").withColumn("group", F.when(F.col("own"), F.col("class")))
    blocks = grouped.groupBy("cluster", "group").agg(_parts())
    before = Window.partitionBy("cluster").orderBy(F.asc_nulls_first("group"))
    blocks = blocks.withColumn("first", F.sum("parts").over(before) - F.col("parts")).withColumn("of", F.sum("parts").over(Window.partitionBy("cluster")))
    placed = grouped.alias("m").join(blocks.alias("b"), (F.col("m.cluster") == F.col("b.cluster")) & F.col("m.group").eqNullSafe(F.col("b.group")))
    placed = placed.select("m.id", "m.cluster", "m.own", "b.first", "b.of", "b.parts", (F.col("b.first") + F.expr("pmod(xxhash64(m.id), b.parts)")).alias("mine"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("of") - 1), lambda x: F.col("own").isNull() | (x < F.col("first")) | (x >= F.col("first") + F.col("parts")))
    pairs = F.transform(others, lambda x: F.struct(F.least(x, "mine").alias("i"), F.greatest(x, "mine").alias("j"), F.when(F.col("mine") > x, 1).otherwise(0).alias("side")))
    wanted = placed.select("id", "cluster", pairs.alias("pairs")).where(F.size("pairs") > 0)
    return sets.join(wanted, "id").select("cluster", "id", "shingles", F.explode("pairs").alias("p")).select("cluster", "p.i", "p.j", "p.side", "id", "shingles")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, k: int = 64) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for each row of ``docs``.

    Links join documents with ``100 * intersection >= percent * union`` of their
    distinct word shingles, confirmed on the full sets.  component_id is the
    smallest id reachable by links, itself included; kept: id = component_id.

    Null and empty texts, and texts without words, have no shingle and link with
    nothing.  Equal sets are one node of the graph.  Rows that repeat an id come
    back each: with equal texts in one component, all kept if the id is its
    smallest, with other texts in the component of their own text.  Rows with a null id are returned with
    component_id and kept null, unlinked.  Further columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    at = workspace(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _sketches(k, percent, words)
    sketches = materialize(texts.mapInArrow(run, schema), f"{at}/sketches")
    full = sketches.where("n > 0 and id is not null")
    classes = materialize(full.groupBy("digest").agg(F.min("id").alias("node")), f"{at}/classes")

    nodes = full.join(classes.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    posts = nodes.select("id", "prefix", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    # Written, so that the joins below have plain exchanges on both sides, whose skewed partitions Spark can split.
    common = materialize(posts.groupBy("value").count().where("count > 1"), f"{at}/common")
    rarest = posts.join(common, "value").groupBy("id").agg(F.max("prefix").alias("prefix"), F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("count", "value"))).alias("found"))
    # The values of one list alone are the rarest, and use up the prefix first.
    room = F.greatest(F.lit(0), F.col("prefix") - (F.col("m") - F.size("found")))
    score = F.aggregate("found", F.lit(0).cast("long"), lambda total, f: total + f["count"])
    lists = materialize(rarest.select("id", score.alias("score"), F.explode(F.slice("found", 1, room)).alias("f")).select("id", "score", F.col("f.value").alias("value")), f"{at}/lists")
    known = nodes.select("id", "n").join(lists.groupBy("id").agg(F.max("score").alias("score")), "id")
    members = _clusters(lists, known, f"{at}/clusters")

    run, schema = _sets(words)
    sets = materialize(texts.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(run, schema), f"{at}/sets")
    rounds = _hub_links(members.where("parts > 1"), sets, k, percent, at)
    blocks = members.where("parts <= 1").select("id", "n", "cluster", F.col("id").alias("class"))
    if rounds:
        hubbed = connected_components(reduce(DataFrame.unionByName, rounds))
        classed = members.where("parts > 1").select("id").distinct().join(hubbed.select(F.col("node").alias("id"), "component"), "id", "left")
        classed = materialize(classed.select("id", F.coalesce("component", "id").alias("class")), f"{at}/classed")
        posted = materialize(lists.join(classed, "id"), f"{at}/posted")
        mixed = materialize(posted.groupBy("value").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("value"), f"{at}/mixed")
        between = _clusters(posted.join(mixed, "value", "left_semi"), known, f"{at}/between").join(classed, "id")
        blocks = blocks.unionByName(between.select("id", "n", "cluster", "class"))
    blocks = materialize(blocks, f"{at}/blocks")
    run, schema = _compare(k, percent)
    links = materialize(_dealt(blocks, sets).groupBy("cluster", "i", "j").applyInArrow(run, schema), f"{at}/links")

    links = reduce(DataFrame.unionByName, rounds, links)
    found = connected_components(links)
    class_of = classes.join(found, "node", "left").select("digest", F.least(F.coalesce("component", "node"), "node").alias("component"))
    labelled = sketches.join(class_of, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    # Empty sets share a digest, but it belongs to no class.
    return labelled.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))

"""Near-duplicate embeddings by tiled comparison along principal axes.

Unit vectors are turned to their principal axes, those of most energy first, and
cut into tiles in the order of the first.  Tasks compare two groups of neighbouring
tiles, and of these two tiles only if their boxes on the leading axes come near enough.  Within a pair of tiles the leading
coordinates are multiplied first; the rest of a product is at most the product of
the suffix norms (Cauchy-Schwarz), so one more coordinate, the suffix norm, makes
the matrix product itself the upper bound.  Pairs below the threshold stop there;
the others take on further coordinates, and the last are decided by the cosine of
the vectors as given, in double precision.

Equal vectors are one node with a count, and a task returns sums of links and a
spanning forest, so that no group of copies is ever written as pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .minhash import forest
from .shared import materialize, ship, workspace

#: Vectors in a tile; rows of a tile multiplied at once; coordinates in the first product; axes of a tile's box.
TILE, STRIP, LEAD, BOX = 4096, 1024, 16, 8
#: Bytes of a group's vectors at most, but for a group of one tile; tasks for each core.
GROUP_BYTES, TASKS = 32 << 20, 2
#: More than the rounding of a single-precision product of unit vectors.
SLACK = 1e-5


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def axes(vectors: DataFrame, d: int) -> np.ndarray:
    """Principal axes of all unit vectors about the origin, as columns, most energy first."""

    def moments(batches):
        total = np.zeros((d, d))
        for batch in batches:
            u = units(np.asarray(batch.column(0).flatten()).reshape(-1, d))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])

    parts = vectors.select("vector").mapInArrow(moments, "m array<double>").select(F.posexplode("m"))
    total = np.zeros(d * d)
    for r in parts.groupBy("pos").agg(F.sum("col").alias("s")).collect():  # d * d rows
        total[r.pos] = r.s
    values, basis = np.linalg.eigh(total.reshape(d, d))
    return np.ascontiguousarray(basis[:, np.argsort(values)[::-1]])


def _project(d: int, basis: np.ndarray, kind: str):
    def run(batches):
        for batch in batches:
            raw = np.asarray(batch.column(2).flatten(), kind).reshape(-1, d)
            lead = units(raw) @ basis[:, 0] if len(raw) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lead), pa.array([r.tobytes() for r in raw], pa.binary())], ["node", "copies", "lead", "raw"])

    return run, "node long, copies long, lead double, raw binary"


def _pack(d: int, basis: np.ndarray, kind: str, tile: int):
    box = min(BOX, d)

    def run(batches):
        held, n = [], 0

        def rows(final: bool):
            nonlocal held, n
            table = pa.Table.from_batches(held).combine_chunks()
            held, n, at = [], 0, 0
            while len(table) - at >= tile or final and at < len(table):
                part = table.slice(at, tile)
                at += len(part)
                data = b"".join(part.column("raw").to_pylist())
                led = units(np.frombuffer(data, kind).reshape(-1, d)) @ basis[:, :box]
                ids, copies = (part.column(c).to_numpy().astype("<i8").tobytes() for c in ("node", "copies"))
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([copies], pa.binary()), pa.array([data], pa.binary()), pa.array([led.min(0)], pa.list_(pa.float64())), pa.array([led.max(0)], pa.list_(pa.float64()))], ["ids", "copies", "raw", "low", "high"])
            if at < len(table):
                held, n = table.slice(at).to_batches(), len(table) - at

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= tile:
                yield from rows(False)
        if n:
            yield from rows(True)

    return run, "ids binary, copies binary, raw binary, low array<double>, high array<double>"


def linked(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row of a, row of b) of unit vectors with a cosine of ``threshold`` or more; with ``same``, row of a < row of b."""
    d = a.shape[1]
    turned = [x @ basis for x in (a, b)]
    energy = [np.cumsum(t[:, ::-1] ** 2, axis=1)[:, ::-1] for t in turned]  # of the coordinates from each on
    norms = [np.sqrt(np.concatenate([e, np.zeros((len(e), 1))], axis=1)) for e in energy]
    k = min(LEAD, d)
    bound = [np.concatenate([t[:, :k], s[:, k : k + 1]], axis=1).astype(np.float32) for t, s in zip(turned, norms, strict=True)]
    rows, cols = [], []
    for first in range(0, len(a), STRIP):
        upper = bound[0][first : first + STRIP] @ bound[1].T
        r, c = np.divmod(np.flatnonzero(upper >= np.float32(threshold - SLACK)), len(b))
        r += first
        if same:
            keep = r < c
            r, c = r[keep], c[keep]
        for at in range(0, len(r), 1 << 17):
            x, y, done = r[at : at + (1 << 17)], c[at : at + (1 << 17)], k
            sums = np.einsum("ij,ij->i", turned[0][x, :k], turned[1][y, :k])
            while done < d and len(x):
                upto = min(d, 2 * done)
                sums += np.einsum("ij,ij->i", turned[0][x, done:upto], turned[1][y, done:upto])
                keep = sums + norms[0][x, upto] * norms[1][y, upto] >= threshold - SLACK
                x, y, sums, done = x[keep], y[keep], sums[keep], upto
            keep = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            rows.append(x[keep])
            cols.append(y[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *cols])


def _compare(d: int, basis: np.ndarray, kind: str, threshold: float, reach: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("tile").to_numpy(), kind="stable")
        tiles = [{c: table.column(c)[int(i)].as_py() for c in ("ids", "copies", "raw", "side", "low", "high")} for i in order]
        for t in tiles:
            t["ids"], t["copies"] = (np.frombuffer(t[c], "<i8") for c in ("ids", "copies"))
            t["unit"] = units(np.frombuffer(t.pop("raw"), kind).reshape(-1, d))
        alone, out = not any(t["side"] for t in tiles), []
        for i, x in enumerate(tiles):
            for y in tiles[i:] if alone else [t for t in tiles if t["side"] > x["side"]]:
                same = x is y
                gap = np.maximum(0, np.maximum(np.array(x["low"]) - y["high"], np.array(y["low"]) - x["high"]))
                if gap @ gap > reach * reach + SLACK:
                    continue
                r, c = linked(x["unit"], y["unit"], basis, threshold, same)
                if not len(r):
                    continue
                counts = [np.bincount(r, y["copies"][c], len(x["ids"])), np.bincount(c, x["copies"][r], len(y["ids"]))]
                both = x["ids"] if same else np.concatenate([x["ids"], y["ids"]])
                links = counts[0] + counts[1] if same else np.concatenate(counts)
                nodes, root = forest(both, r, c if same else c + len(x["ids"]))
                found = dict(zip(nodes.tolist(), root.tolist(), strict=True))
                at = np.flatnonzero(links)
                out.append(pa.table([pa.array(both[at]), pa.array(links[at].astype(np.int64)), pa.array([found[i] for i in both[at].tolist()], pa.int64())], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run, "node long, links long, root long"


def _groups(stats: DataFrame, reach: float) -> DataFrame:
    """Pairs (i, j), i <= j, of groups of tiles of which some two boxes are no further apart than ``reach``; found over cells of the first axis."""
    cell = lambda x: F.floor(x / reach)
    left = stats.select(F.col("group").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"), F.explode(F.sequence(cell(F.col("low")[0]) - 1, cell(F.col("high")[0]) + 1)).alias("cell"))
    right = stats.select(F.col("group").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))).alias("cell"))
    gaps = F.zip_with(F.zip_with("low_i", "high_j", lambda a, b: a - b), F.zip_with("low_j", "high_i", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= reach * reach + SLACK
    return left.join(right, "cell").where(near).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of ``vectors``.

    Two rows link if the cosine of their vectors is ``threshold`` or more (0 <
    threshold <= 1).  n_links counts the other rows linked directly, component_id
    is the smallest id reachable by links, itself included, and kept says whether
    that is the row's own.  Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, vectors of different lengths not with
    each other.  Rows that repeat an id are vectors of their own in one component;
    rows with a null id come back without links, component_id and kept null.
    Further columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    at = workspace(spark, "embeddings")
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    vector = F.col(vec_col) if kind == "<f4" else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).withColumn("usable", usable(F.col("vector")) & F.col("id").isNotNull())
    nodes = materialize(rows.where("usable").groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies")), f"{at}/nodes")
    compared = []
    for r in nodes.groupBy(F.size("vector").alias("d")).count().collect():  # a row for each length of vector
        d, own = r["d"], nodes.where(F.size("vector") == r["d"])
        basis = axes(own, d)
        run, schema = _project(d, basis, kind)
        led = own.select("node", "copies", "vector").mapInArrow(run, schema)
        run, schema = _pack(d, basis, kind, tile)
        packed = led.repartitionByRange(-(-r["count"] // tile), "lead").sortWithinPartitions("lead").mapInArrow(run, schema)
        tiles = materialize(packed.withColumn("tile", F.monotonically_increasing_id()), f"{at}/tiles-{d}")
        reach = float(np.sqrt(max(2 - 2 * threshold, 1e-6)))
        # Tasks compare groups of tiles that lie side by side, so that a tile is sent once for each group, not for each tile.
        n, tasks = -(-r["count"] // tile), TASKS * spark.sparkContext.defaultParallelism
        size = max(1, min(-(-n // int(np.ceil(np.sqrt(2 * tasks)))), GROUP_BYTES // (tile * d * np.dtype(kind).itemsize)))
        tiles = tiles.withColumn("group", F.floor(F.shiftright("tile", 33) / size))
        pairs = materialize(_groups(tiles.select("group", "low", "high"), reach), f"{at}/pairs-{d}")
        body = tiles.select("group", "tile", "ids", "copies", "raw", "low", "high")
        sides = body.join(pairs, F.col("group") == F.col("i")).withColumn("side", F.lit(0)).unionByName(body.join(pairs.where("i < j"), F.col("group") == F.col("j")).withColumn("side", F.lit(1)))
        run, schema = _compare(d, basis, kind, threshold, reach)
        compared.append(materialize(sides.groupBy("i", "j").applyInArrow(run, schema), f"{at}/links-{d}"))
    links = compared[0] if compared else spark.createDataFrame([], "node long, links long, root long")
    for more in compared[1:]:
        links = links.unionByName(more)
    # Equal vectors with several ids meet in their node; a node's other rows are links too.
    found = connected_components(links.select("node", "root"), "node", "root")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = nodes.join(counts, "node", "left").join(found, "node", "left").select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    labelled = rows.withColumn("key", F.when(F.col("usable"), F.col("vector"))).join(classes.withColumnRenamed("vector", "key"), "key", "left")
    component = F.coalesce("component", "id")
    return labelled.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))

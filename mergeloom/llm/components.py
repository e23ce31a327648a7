"""Connected components of a graph held as a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, ship, workspace

#: So many links, 2 MB, are solved by one task; more go through rounds.
TASK_LINKS = 1 << 17


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, component): the smallest node that the links a, b lead to, for every node with a link."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        # Roots hook on to smaller ones, so that no circle comes about, and every path is cut short.
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return ids, ids[root]


def _solve(batches):
    links = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if links:
        node, component = stars(*(np.concatenate(x) for x in zip(*links, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], ["node", "component"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node reachable by ``links`` between longs, for every node with a link.

    Up to ``TASK_LINKS`` distinct links are solved by one task.  For more it alternates the large-star and small-star steps of Kiveris et al. (SoCC 2014):
    the number of links never grows, the number of rounds is logarithmic, and no
    step needs a node's neighbours in one place, only their minimum.  Every round
    is written to the shared folder.  Self-links, repeated links and null ends are
    ignored; no links give an empty table.
    """
    ship(links.sparkSession)
    at = workspace(links.sparkSession, "components")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges = materialize(edges, f"{at}/0")
    if edges.count() <= TASK_LINKS:
        return materialize(edges.coalesce(1).mapInArrow(_solve, "node long, component long"), f"{at}/solved")
    turn = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        turn += 1
        edges = materialize(small.unionByName(parent.select("u", F.col("m").alias("v"))).distinct(), f"{at}/{turn}")
        # Stars only: every node has one parent, and no parent has one.
        if edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

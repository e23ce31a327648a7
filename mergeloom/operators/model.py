"""Merging model weights layer by layer.

Weights are rows (model_id, layer, pos, w), optionally with a base (layer, pos, w).
Most strategies are plain aggregations over positions; those that need a whole
tensor at once (decompositions, seeded masks) run on one layer's array per group.
"""

from __future__ import annotations

import random
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from fnmatch import fnmatchcase
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A limit is taken over a window, not joined from an aggregate of its own: sums of
# doubles differ in their last bits with the order in which rows come, so that what
# is worked out twice need not meet its own limit.

#: Bytes of weights that a task reads at once where it needs all models of a layer, one model at least.
BLOCK_BYTES = 16 << 20
#: Rows of a batch that a task returns.
OUT_ROWS = 100_000
#: Below this a sum of weights counts as none.
TINY = 1e-12


def explode_tensors(df: DataFrame, tensor: str = "tensor", keep: Sequence[str] = ("model_id", "layer")) -> DataFrame:
    """Rows (model_id, layer, pos, w) of arrays."""
    return df.select(*keep, F.posexplode(F.col(tensor).cast("array<double>")).alias("pos", "w"))


def collect_tensors(df: DataFrame, keys: Sequence[str] = ("layer",), value: str = "w") -> DataFrame:
    """Arrays in order of position again."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("tensor"))


def _weighted(df: DataFrame, weights: Mapping | None) -> DataFrame:
    """With column wt: given weights, else 1."""
    if weights is None:
        return df.withColumn("wt", F.lit(1.0))
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
    return df.withColumn("wt", F.coalesce(F.try_element_at(table, F.col("model_id")), F.lit(0.0)))


def _normalised(df: DataFrame, weights: Mapping | None) -> DataFrame:
    """With column wt, of sum 1 over the models of each position."""
    over = Window.partitionBy("layer", "pos")
    return _weighted(df, weights).withColumn("wt", F.col("wt") / F.sum("wt").over(over))


def _deltas(df: DataFrame, base: DataFrame) -> DataFrame:
    """With column t: the distance from the base, and b, the base."""
    return df.join(base.select("layer", "pos", F.col("w").alias("b")), ["layer", "pos"]).withColumn("t", F.col("w") - F.col("b"))


# --- aggregations over positions ---


def weight_average(df: DataFrame, weights: Mapping | None = None) -> DataFrame:
    """The weighted mean."""
    return _weighted(df, weights).groupBy("layer", "pos").agg((F.sum(F.col("wt") * F.col("w")) / F.sum("wt")).alias("w"))


def linear(a: DataFrame, b: DataFrame, t: float = 0.5) -> DataFrame:
    """(1 - t) a + t b."""
    return a.join(b.select("layer", "pos", F.col("w").alias("v")), ["layer", "pos"]).select("layer", "pos", ((1 - t) * F.col("w") + t * F.col("v")).alias("w"))


def task_arithmetic(df: DataFrame, base: DataFrame, scale: float = 1.0, weights: Mapping | None = None) -> DataFrame:
    """The base and the scaled sum of weighted distances from it."""
    return _deltas(_weighted(df, weights), base).groupBy("layer", "pos").agg((F.first("b") + scale * F.sum(F.col("wt") * F.col("t"))).alias("w"))


def _trimmed(df: DataFrame, keep: float, nonzero: bool) -> DataFrame:
    """Distances under their model's and layer's percentile become 0."""
    size = F.abs(F.col("t"))
    cut = F.percentile(F.when(size > 0, size) if nonzero else size, F.lit(1 - keep)).over(Window.partitionBy("model_id", "layer"))
    return df.withColumn("cut", cut).withColumn("t", F.when(size >= F.coalesce("cut", F.lit(0.0)), F.col("t")).otherwise(0.0))


def ties(df: DataFrame, base: DataFrame, density: float = 0.2, weights: Mapping | None = None) -> DataFrame:
    """Trim small distances, elect a sign for each position, average those of that sign: base + sum(w t) / count."""
    rows = _trimmed(_deltas(_normalised(df, weights), base), density, True)
    elected = rows.withColumn("sign", F.signum(F.sum(F.signum("t")).over(Window.partitionBy("layer", "pos"))))
    agree = (F.signum("t") == F.col("sign")) & (F.col("t") != 0)
    return elected.groupBy("layer", "pos").agg((F.first("b") + F.coalesce(F.sum(F.when(agree, F.col("wt") * F.col("t"))), F.lit(0.0)) / F.greatest(F.count_if(agree), F.lit(1))).alias("w"))


def breadcrumbs(df: DataFrame, base: DataFrame, sparsity: float = 0.9, weights: Mapping | None = None) -> DataFrame:
    """Only the largest distances, summed by weight."""
    rows = _trimmed(_deltas(_normalised(df, weights), base), 1 - sparsity, False)
    return rows.groupBy("layer", "pos").agg((F.first("b") + F.sum(F.col("wt") * F.col("t"))).alias("w"))


def emr(df: DataFrame, base: DataFrame, ratio: float = 0.3, weights: Mapping | None = None) -> DataFrame:
    """Elect the largest distances, sum by weight, rescale by size over active positions, 1 / ratio at most."""
    rows = _trimmed(_deltas(_normalised(df, weights), base), ratio, False)
    summed = rows.groupBy("layer", "pos").agg(F.first("b").alias("b"), F.sum(F.col("wt") * F.col("t")).alias("m"))
    over = Window.partitionBy("layer")
    active = F.count_if(F.col("m") != 0).over(over)
    scale = F.when(active > 0, F.least(F.count("*").over(over) / active, F.lit(1 / ratio))).otherwise(1.0)
    return summed.select("layer", "pos", (F.col("b") + F.col("m") * scale).alias("w"))


def fisher(df: DataFrame, information: str | None = None) -> DataFrame:
    """Mean weighted by information, by default the square of the weight itself."""
    f = F.col(information) if information else F.col("w") ** 2
    return df.groupBy("layer", "pos").agg((F.sum(f * F.col("w")) / F.greatest(F.sum(f), F.lit(TINY))).alias("w"))


def regression_mean(df: DataFrame, ridge: float = 0.01) -> DataFrame:
    """Mean weighted by squares and a ridge."""
    f = F.col("w") ** 2 + ridge
    return df.groupBy("layer", "pos").agg((F.sum(f * F.col("w")) / F.greatest(F.sum(f), F.lit(TINY))).alias("w"))


def negative(df: DataFrame, base: DataFrame, alpha: float = 1.0, unlearn: Sequence = ()) -> DataFrame:
    """The base and the mean distance of the models to keep, less alpha times that of those to unlearn (all, if none is named)."""
    rows = _deltas(df, base)
    bad = F.col("model_id").isin(list(unlearn)) if unlearn else F.lit(True)
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("t"))), F.lit(0.0))
    return rows.groupBy("layer", "pos").agg((F.first("b") + mean(~bad) - alpha * mean(bad)).alias("w"))


def split_unlearn(df: DataFrame, base: DataFrame, fraction: float = 0.1) -> DataFrame:
    """The mean, with the fraction of positions furthest from the base put back to it."""
    mean = _deltas(df, base).groupBy("layer", "pos").agg(F.first("b").alias("b"), F.avg("w").alias("m"))
    cut = F.percentile(F.abs(F.col("m") - F.col("b")), F.lit(1 - fraction)).over(Window.partitionBy("layer"))
    return mean.withColumn("cut", cut).select("layer", "pos", F.when(F.abs(F.col("m") - F.col("b")) > F.col("cut"), F.col("b")).otherwise(F.col("m")).alias("w"))


def safe_merge(df: DataFrame, base: DataFrame, fraction: float = 0.1, weights: Mapping | None = None) -> DataFrame:
    """The weighted mean, with the positions of most variance between models kept as in the base."""
    s = _normalised(df, weights).groupBy("layer", "pos").agg(F.sum(F.col("wt") * F.col("w")).alias("m"), F.var_pop("w").alias("v"))
    over = Window.partitionBy("layer")
    ranked = s.withColumn("n", F.count("*").over(over)).withColumn("r", F.row_number().over(over.orderBy(F.desc("v"), "pos"))).withColumn("top", F.max("v").over(over))
    k = F.greatest(F.lit(1), F.floor(F.col("n") * fraction))
    cut = F.max(F.when(F.col("r") == k, F.col("v"))).over(over)
    frozen = (F.col("v") >= F.col("cut")) & (F.col("top") > 0)
    return ranked.withColumn("cut", cut).join(base.select("layer", "pos", F.col("w").alias("b")), ["layer", "pos"]).select("layer", "pos", F.when(frozen, F.col("b")).otherwise(F.col("m")).alias("w"))


def led_merge(df: DataFrame) -> DataFrame:
    """For each position the value nearest the mean, the smaller of two as near."""
    rows = df.withColumn("d", F.abs(F.col("w") - F.avg("w").over(Window.partitionBy("layer", "pos"))))
    return rows.groupBy("layer", "pos").agg(F.min_by("w", F.struct("d", "w")).alias("w"))


def fedavg(df: DataFrame, samples: str = "n") -> DataFrame:
    """Federated average: by each client's number of samples, renormalised for each layer."""
    return df.groupBy("layer", "pos").agg((F.sum(F.col(samples) * F.col("w")) / F.sum(samples)).alias("w"))


def fedprox(df: DataFrame, server: DataFrame, mu: float = 0.01, samples: str = "n") -> DataFrame:
    """Federated average of weights pulled towards the server's: w - mu (w - g)."""
    pulled = df.join(server.select("layer", "pos", F.col("w").alias("g")), ["layer", "pos"]).withColumn("w", F.col("w") - mu * (F.col("w") - F.col("g")))
    return fedavg(pulled, samples)


def continual(df: DataFrame, age: str, budget: float = 0.9, weight: str | None = None) -> DataFrame:
    """Mean of models with weights that fade by ``budget`` for each step of age; normalised over all models."""
    models = df.select("model_id", age, *([weight] if weight else [])).distinct().withColumn("wt", (F.col(weight) if weight else F.lit(1.0)) * F.pow(F.lit(budget), F.col(age)))
    total = models.agg(F.sum("wt").alias("total"))
    return df.join(models.select("model_id", "wt"), "model_id").join(F.broadcast(total)).groupBy("layer", "pos").agg(F.sum(F.col("wt") * F.col("w") / F.col("total")).alias("w"))


def conflict_heatmap(df: DataFrame) -> DataFrame:
    """Rows (layer, conflict, variance, dominant): how much models differ, min(1, mean variance / mean size squared), and which is furthest from the mean."""
    per = df.groupBy("layer", "pos").agg(F.var_pop("w").alias("v"), F.avg(F.abs("w")).alias("a"), F.avg("w").alias("m"))
    score = per.groupBy("layer").agg(F.avg("v").alias("variance"), F.least(F.lit(1.0), F.avg("v") / F.greatest(F.avg("a") ** 2, F.lit(TINY))).alias("conflict"))
    far = df.join(per.select("layer", "pos", "m"), ["layer", "pos"]).groupBy("layer", "model_id").agg(F.sum((F.col("w") - F.col("m")) ** 2).alias("d")).groupBy("layer").agg(F.max_by("model_id", F.struct(F.round("d", 9), -F.col("model_id") if dict(df.dtypes)["model_id"] in ("bigint", "int") else F.col("model_id"))).alias("dominant"))
    return score.join(far, "layer").select("layer", "conflict", "variance", "dominant")


def safety(df: DataFrame, critical: float = 0.1) -> DataFrame:
    """Rows (layer, variance, critical): population variance of the models' layer means."""
    means = df.groupBy("layer", "model_id").agg(F.avg("w").alias("m"))
    return means.groupBy("layer").agg(F.var_pop("m").alias("variance")).withColumn("critical", F.col("variance") > critical)


def safety_risk(layers: DataFrame) -> DataFrame:
    """One row: min(1, 0.7 greatest + 0.3 mean variance)."""
    return layers.agg(F.least(F.lit(1.0), 0.7 * F.max("variance") + 0.3 * F.avg("variance")).alias("risk"))


# --- whole tensors ---


def _spread(w: np.ndarray, pos: np.ndarray, every: np.ndarray) -> np.ndarray:
    wide = np.full(every.size, np.nan)
    wide[np.searchsorted(every, pos)] = w
    return wide


class _Models:
    """The models of one layer, a row of weights each, in order of id; above ``BLOCK_BYTES`` in a file that is read by blocks of rows."""

    def __init__(self) -> None:
        self.file, self.pos, self.n = tempfile.SpooledTemporaryFile(BLOCK_BYTES), None, 0

    def add(self, pos: np.ndarray, w: np.ndarray) -> None:
        if self.pos is None:
            self.pos = pos
        elif not np.array_equal(pos, self.pos):  # what a model lacks is NaN
            every = np.union1d(self.pos, pos)
            if every.size > self.pos.size:
                old, was = self.blocks(), self.pos
                wider = _Models()
                wider.pos = every
                for block in old:
                    for row in block:
                        wider._write(_spread(row, was, every))
                self.file, self.pos = wider.file, every
            w = _spread(w, pos, every)
        self._write(w)

    def _write(self, w: np.ndarray) -> None:
        self.file.seek(8 * self.pos.size * self.n)
        self.file.write(np.ascontiguousarray(w, np.float64))
        self.n += 1

    def blocks(self) -> Iterator[np.ndarray]:
        step = max(1, BLOCK_BYTES // (8 * self.pos.size))
        for at in range(0, self.n, step):
            self.file.seek(8 * self.pos.size * at)
            rows = min(step, self.n - at)
            yield np.frombuffer(self.file.read(8 * self.pos.size * rows)).reshape(rows, -1)

    def __iter__(self) -> Iterator[np.ndarray]:
        return (row for block in self.blocks() for row in block)

    def mean(self) -> np.ndarray:
        return sum(block.sum(0) for block in self.blocks()) / self.n

    def mix(self, c: np.ndarray) -> np.ndarray:
        """``c @ models``."""
        out, at = 0.0, 0
        for block in self.blocks():
            out = out + c[..., at : at + len(block)] @ block
            at += len(block)
        return out

    def each(self, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """A number for each model, by ``fn`` of a block."""
        return np.concatenate([fn(block) for block in self.blocks()])


def _mean(rows: Iterable[np.ndarray]) -> np.ndarray:
    total, n = 0.0, 0
    for row in rows:
        total, n = total + row, n + 1
    return total / n


def _ends(column: pa.Array) -> np.ndarray:
    """Where runs of equal values end."""
    return pc.run_end_encode(column).run_ends.to_numpy()


def _tensors(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(layer, model, positions, weights) of sorted rows."""
    key, parts = None, []

    def whole() -> tuple:
        pos, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        if (pos[1:] == pos[:-1]).any():
            raise ValueError(f"a position of layer {key[0]} has two weights of model {key[1]}")
        return *key, pos, w

    for batch in batches:
        layers, ids = batch.column("layer"), batch.column("model_id")
        pos, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "w"))
        start = 0
        for end in np.union1d(_ends(layers), _ends(ids)) if batch.num_rows else ():
            own = layers[start].as_py(), ids[start].as_py()
            if own != key:
                if parts:
                    yield whole()
                key, parts = own, []
            parts.append((pos[start:end], w[start:end]))
            start = end
    if parts:
        yield whole()


def _per_layer(df: DataFrame, fn: Callable[[_Models, np.ndarray | None], np.ndarray], base: DataFrame | None) -> DataFrame:
    """``fn(models, base)`` for each layer, models in order of id.

    A layer's rows pass one task, sorted: it holds the layer's tensors one by one
    and never all models.
    """
    kind, based = dict(df.dtypes)["layer"], base is not None
    cells = ["layer", *(F.col(c).cast(t).alias(c) for c, t in (("model_id", "string"), ("pos", "long"), ("w", "double")))]
    rows = df.where("model_id IS NOT NULL").select(*cells)
    if based:
        rows = rows.unionByName(base.withColumn("model_id", F.lit(None)).select(*cells))

    def result(layer, models: _Models, b: tuple | None, of: pa.DataType) -> Iterator[pa.RecordBatch]:
        if based:
            pos, w = b or (np.zeros(0), np.zeros(0))
            here = np.isin(pos, models.pos)
            if here.sum() != models.pos.size:
                raise ValueError(f"the base lacks positions of layer {layer}")
            w = w[here]
        out = fn(models, w if based else None)
        for at in range(0, out.size, OUT_ROWS):
            n = min(OUT_ROWS, out.size - at)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(layer, of), n), pa.array(models.pos[at : at + n], pa.int64()), pa.array(out[at : at + n], pa.float64(), from_pandas=True)], ["layer", "pos", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        of = first.schema.field("layer").type
        for layer, tensors in groupby(_tensors(chain([first], batches)), key=lambda t: t[0]):
            models, b = _Models(), None
            for _, model, pos, w in tensors:
                if model is None:
                    b = pos, w
                else:
                    models.add(pos, w)
            if models.n:
                yield from result(layer, models, b, of)

    return rows.repartition("layer").sortWithinPartitions("layer", "model_id", "pos").mapInArrow(run, f"layer {kind}, pos long, w double")


def _slerp(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    if na < TINY or nb < TINY:
        return (1 - t) * a + t * b
    ua, ub = a / na, b / nb
    angle = np.arccos(np.clip(ua @ ub, -1, 1))
    size = (1 - t) * na + t * nb
    if np.sin(angle) < 1e-8:
        return (1 - t) * a + t * b
    return size * (np.sin((1 - t) * angle) * ua + np.sin(t * angle) * ub) / np.sin(angle)


def slerp(df: DataFrame, t: float | None = None) -> DataFrame:
    """Along the arc, model by model in order of id; t by default makes each count the same."""
    def fn(models, _):
        for i, m in enumerate(models):
            out = _slerp(out, m, 1 / (i + 1) if t is None else t) if i else m
        return out

    return _per_layer(df, fn, None)


def _dropped(tau: np.ndarray, drop: float, rng: random.Random) -> np.ndarray:
    keep = np.array([rng.random() >= drop for _ in range(tau.size)])
    return np.where(keep, tau / max(1 - drop, TINY), 0.0)


def dare(df: DataFrame, base: DataFrame, drop: float = 0.5, seed: int = 42) -> DataFrame:
    """Distances dropped at random and rescaled; one seeded generator runs through the models in order of id."""
    def fn(models, b):
        rng = random.Random(seed)
        return b + _mean(_dropped(m - b, drop, rng) for m in models)

    return _per_layer(df, fn, base)


def della(df: DataFrame, base: DataFrame, drop: float = 0.5, spread: float = 0.2, seed: int = 42) -> DataFrame:
    """As dare, but the smaller a distance, the likelier it is dropped."""
    def fn(models, b):
        rng = random.Random(seed)

        def thinned(m):
            tau = m - b
            rank = np.argsort(np.argsort(np.abs(tau))) / max(tau.size - 1, 1)
            p = np.clip(drop + spread * (0.5 - rank), 0, 1 - 1e-6)
            keep = np.array([rng.random() for _ in range(tau.size)]) >= p
            return np.where(keep, tau / (1 - p), 0.0)

        return b + _mean(map(thinned, models))

    return _per_layer(df, fn, base)


def dare_ties(df: DataFrame, base: DataFrame, drop: float = 0.5, density: float = 0.5, seed: int = 42) -> DataFrame:
    """Distances dropped at random, trimmed to the largest ``density`` of what is left, then a sign for each position: the sum of equal shares that agree over their number."""
    def fn(models, b):
        rng = random.Random(seed)
        signs, sums, counts = np.zeros(b.size), np.zeros((2, b.size)), np.zeros((2, b.size))  # of positive and negative distances
        for m in models:
            t = _dropped(m - b, drop, rng)
            left = np.abs(t[t != 0])
            if left.size:
                t[np.abs(t) < np.percentile(left, 100 * (1 - density))] = 0.0
            signs += np.sign(t)
            for i, own in enumerate((t > 0, t < 0)):
                sums[i] += np.where(own, t / models.n, 0.0)
                counts[i] += own
        agreed = lambda x: np.where(signs > 0, x[0], np.where(signs < 0, x[1], 0.0))
        return b + agreed(sums) / np.maximum(agreed(counts), 1)

    return _per_layer(df, fn, base)


def _matrix(x: np.ndarray, columns: int) -> np.ndarray | None:
    """The tensor as a matrix; none for a vector."""
    return x.reshape(-1, columns) if 1 < columns < x.size and x.size % columns == 0 else None


def star(df: DataFrame, base: DataFrame, fraction: float = 0.5, rescale: bool = True, columns: int = 0) -> DataFrame:
    """Distances cut to the largest ``fraction`` of their singular values (of a vector, of its entries), rescaled to the same norm, and averaged."""
    def cut(t):
        m = _matrix(t, columns)
        if m is None:
            out = np.where(np.abs(t) >= np.sort(np.abs(t))[-max(1, int(t.size * fraction))], t, 0.0)
        else:
            u, s, v = np.linalg.svd(m, full_matrices=False)
            k = max(1, int(len(s) * fraction))
            out = ((u[:, :k] * s[:k]) @ v[:k]).ravel()
        size = np.linalg.norm(out)
        return out * (np.linalg.norm(t) / size) if rescale and size > 0 else out

    return _per_layer(df, lambda models, b: b + _mean(cut(m - b) for m in models), base)


def adarank(df: DataFrame, base: DataFrame, energy: float = 0.9, columns: int = 0) -> DataFrame:
    """Distances cut to the least rank (of a vector, number of entries) that holds ``energy`` of the sum of squares, and averaged."""
    def cut(t):
        m = _matrix(t, columns)
        if m is None:
            order = np.argsort(-np.abs(t), kind="stable")
            keep = order[: int(np.searchsorted(np.cumsum(t[order] ** 2), energy * (t**2).sum()) + 1)]
            out = np.zeros_like(t)
            out[keep] = t[keep]
            return out
        u, s, v = np.linalg.svd(m, full_matrices=False)
        k = int(np.searchsorted(np.cumsum(s**2), energy * (s**2).sum()) + 1)
        return ((u[:, :k] * s[:k]) @ v[:k]).ravel()

    return _per_layer(df, lambda models, b: b + _mean(cut(m - b) for m in models), base)


def svd_knot_tying(df: DataFrame, base: DataFrame, columns: int = 0, rank: int | None = None) -> DataFrame:
    """Distances whose left singular vectors are rotated onto the first model's (orthogonal Procrustes), averaged; vectors are averaged as they are."""
    def fn(models, b):
        if _matrix(b, columns) is None:
            return models.mean()
        first = None

        def tied(m):
            nonlocal first
            u, s, v = np.linalg.svd(_matrix(m - b, columns), full_matrices=False)
            u, s, v = u[:, :rank], s[:rank], v[:rank]
            if first is None:
                first = u
            else:
                left, _, right = np.linalg.svd(u.T @ first)
                u = u @ (left @ right)
            return (u * s) @ v

        return b + _mean(map(tied, models)).ravel()

    return _per_layer(df, fn, base)


def weight_scope_alignment(df: DataFrame) -> DataFrame:
    """Models brought to mean 0 and deviation 1, averaged, and scaled back to the mean of means and deviations."""
    def fn(models, _):
        mean, dev = models.each(lambda x: x.mean(1)).mean(), models.each(lambda x: x.std(1)).mean()
        scaled = (((x - x.mean(1, keepdims=True)) / np.maximum(x.std(1, keepdims=True), TINY)).sum(0) for x in models.blocks())
        return sum(scaled) / models.n * dev + mean

    return _per_layer(df, fn, None)


def dual_projection(df: DataFrame, base: DataFrame, plasticity: float = 0.5, columns: int = 0, rank: int = 1) -> DataFrame:
    """Of each distance, the part within the base's main directions by ``plasticity``, the rest in full."""
    def fn(models, b):
        width = columns if _matrix(b, columns) is not None else b.size
        _, _, v = np.linalg.svd(b.reshape(-1, width), full_matrices=False)
        # linear, so the mean distance stands for all
        t, v = (models.mean() - b).reshape(-1, width), v[:rank]
        return b + (t - (1 - plasticity) * (t @ v.T) @ v).ravel()

    return _per_layer(df, fn, base)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ada_merging(df: DataFrame, bins: int = 64, rate: float = 0.01, steps: int = 100) -> DataFrame:
    """Coefficients from the entropy of each model's values (the more peaked, the more), then moved towards models near the merge."""
    def fn(models, _):
        entropy = []
        for m in models:
            p = np.histogram(m, bins)[0] / m.size
            entropy.append(-(p[p > 0] * np.log(p[p > 0])).sum())
        c = _softmax(-np.array(entropy))
        for _ in range(steps):
            mixed = models.mix(c)
            distance = models.each(lambda x, mixed=mixed: ((x - mixed) ** 2).mean(1))
            c = c * (1 - rate * distance / max(distance.sum(), TINY))
            c = c / c.sum()
        return models.mix(c)

    return _per_layer(df, fn, None)


def dam(df: DataFrame, rate: float = 0.01, steps: int = 50) -> DataFrame:
    """Equal coefficients, moved step by step towards the models nearest the merge."""
    def fn(models, _):
        c = np.full(models.n, 1 / models.n)
        for _ in range(steps):
            mixed = models.mix(c)
            near = 1 / (1 + models.each(lambda x, mixed=mixed: np.linalg.norm(x - mixed, axis=1)))
            c = (1 - rate) * c + rate * near / near.sum()
        return models.mix(c)

    return _per_layer(df, fn, None)


def _fitness(merged: np.ndarray) -> float:
    return -float(merged.var())


def evolutionary(df: DataFrame, population: int = 20, generations: int = 50, fitness: Callable[[np.ndarray], float] = _fitness, seed: int = 42) -> DataFrame:
    """Coefficients by evolution: the better half of each generation mutates, the best ever seen merges."""
    def fn(models, _):
        rng = np.random.default_rng(seed)
        crowd, spread = rng.dirichlet(np.ones(models.n), population), 0.3
        best, most = None, None
        for _ in range(max(1, generations)):
            worth = np.array([fitness(x) for x in models.mix(crowd)])
            order = np.argsort(-worth, kind="stable")[: max(1, population // 2)]
            crowd = crowd[order]
            if best is None or worth[order[0]] > most:
                best, most = crowd[0], worth[order[0]]
            young = np.abs(crowd[rng.integers(len(crowd), size=population - len(crowd))] + rng.normal(0, spread, (population - len(crowd), models.n))) + TINY
            crowd, spread = np.concatenate([crowd, young / young.sum(1, keepdims=True)]), spread * 0.97
        return models.mix(best)

    return _per_layer(df, fn, None)


def genetic(df: DataFrame, population: int = 20, generations: int = 50, mutation: float = 0.1, fitness: Callable[[np.ndarray], float] = _fitness, seed: int = 42) -> DataFrame:
    """Coefficients by tournaments, uniform crossover and mutation; the best stays in."""
    def fn(models, _):
        rng, n = np.random.default_rng(seed), models.n
        crowd = rng.dirichlet(np.ones(n), population)
        for _ in range(generations):
            worth = np.array([fitness(x) for x in models.mix(crowd)])
            parents = rng.integers(population, size=(2, population - 1, 2))
            winners = np.where(worth[parents[..., 0]] >= worth[parents[..., 1]], parents[..., 0], parents[..., 1])
            young = np.where(rng.random((population - 1, n)) < 0.5, crowd[winners[0]], crowd[winners[1]])
            young = np.abs(young + np.where(rng.random(young.shape) < mutation, rng.normal(0, mutation, young.shape), 0)) + TINY
            crowd = np.concatenate([crowd[[worth.argmax()]], young / young.sum(1, keepdims=True)])
        return max(models.mix(crowd), key=fitness)

    return _per_layer(df, fn, None)


def representation_surgery(df: DataFrame, method: str = "center", columns: int = 0) -> DataFrame:
    """The mean, its drift put right: to the inputs' mean ('center'), also to their variance ('rescale'), or decorrelated first ('whiten')."""
    def fn(models, _):
        out, mean, dev = models.mean(), models.each(lambda x: x.mean(1)).mean(), np.sqrt(models.each(lambda x: x.var(1)).mean())
        if method == "whiten" and columns and out.size % columns == 0:
            x = (out - out.mean()).reshape(-1, columns)
            values, basis = np.linalg.eigh(np.cov(x.T) + TINY * np.eye(columns))
            out = (x @ basis / np.sqrt(np.maximum(values, TINY)) @ basis.T).ravel()
        if method in ("rescale", "whiten"):
            out = (out - out.mean()) / max(out.std(), TINY) * dev
        return out - out.mean() + mean

    return _per_layer(df, fn, None)


def merge_adapters(df: DataFrame, weights: Mapping | None = None, rank: str = "max") -> DataFrame:
    """Low-rank adapters (model_id, module, rank, a: array (rank x in), b: array (out x rank)) as one for each module.

    The weighted mean of the products b a is factored again by its singular
    values, to the greatest, least or mean rank of the adapters, or to that which
    holds 99 % of its energy ('adaptive').
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.array([1.0 if weights is None else float(weights.get(m, 0.0)) for m in pdf["model_id"]])
        w = w / w.sum()
        total = sum(x * (np.array(b).reshape(-1, r) @ np.array(a).reshape(r, -1)) for x, r, a, b in zip(w, pdf["rank"], pdf["a"], pdf["b"], strict=True))
        u, s, v = np.linalg.svd(total, full_matrices=False)
        ranks = pdf["rank"].to_numpy()
        energy = np.cumsum(s**2) / max((s**2).sum(), TINY)
        k = {"max": ranks.max(), "min": ranks.min(), "mean": round(float(ranks.mean())), "adaptive": int(np.searchsorted(energy, 0.99) + 1)}[rank]
        k = int(min(max(k, 1), len(s)))
        root = np.sqrt(s[:k])
        return pd.DataFrame({"module": [pdf["module"].iloc[0]], "rank": [k], "a": [(root[:, None] * v[:k]).ravel().tolist()], "b": [(u[:, :k] * root).ravel().tolist()]})

    return df.sort("model_id").groupBy("module").applyInPandas(run, "module string, rank int, a array<double>, b array<double>")


def run_stages(frames: Mapping[str, DataFrame], stages: Mapping[str, tuple[Sequence[str], Callable[..., DataFrame]]]) -> dict[str, DataFrame]:
    """Stages {name: (inputs, function)} in an order in which every input comes first; a circle or a name that isn't there is an error."""
    done, waiting = dict(frames), dict(stages)
    while waiting:
        ready = [n for n, (inputs, _) in waiting.items() if all(i in done for i in inputs)]
        if not ready:
            raise ValueError(f"stages wait for each other or for what isn't there: {', '.join(sorted(waiting))}")
        for n in ready:
            inputs, fn = waiting.pop(n)
            done[n] = fn(*(done[i] for i in inputs))
    return done


#: By name: whether the strategy needs a base.
STRATEGIES: dict[str, tuple[Callable[..., DataFrame], bool]] = {
    "weight_average": (weight_average, False), "task_arithmetic": (task_arithmetic, True), "slerp": (slerp, False), "ties": (ties, True), "dare": (dare, True), "della": (della, True), "dare_ties": (dare_ties, True),
    "model_breadcrumbs": (breadcrumbs, True), "emr": (emr, True), "star": (star, True), "svd_knot_tying": (svd_knot_tying, True), "adarank": (adarank, True), "fisher_merge": (fisher, False), "regression_mean": (regression_mean, False),
    "negative_merge": (negative, True), "split_unlearn_merge": (split_unlearn, True), "weight_scope_alignment": (weight_scope_alignment, False), "safe_merge": (safe_merge, True), "led_merge": (led_merge, False), "dual_projection": (dual_projection, True),
    "ada_merging": (ada_merging, False), "dam": (dam, False), "evolutionary_merge": (evolutionary, False), "genetic_merge": (genetic, False), "representation_surgery": (representation_surgery, False),
}


def register_strategy(name: str, fn: Callable[..., DataFrame], needs_base: bool = False) -> None:
    STRATEGIES[name] = (fn, needs_base)


def strategy_of(layer: str, rules: Mapping[str, str], default: str = "weight_average") -> str:
    """A layer's strategy: by its name, else by glob, by range of its number ('3-7'), by regular expression ('re:...')."""
    if layer in rules:
        return rules[layer]
    number = re.search(r"\d+", layer)
    for test in (
        lambda p: any(c in p for c in "*?[") and not p.startswith("re:") and fnmatchcase(layer, p),
        lambda p: bool((m := re.fullmatch(r"(\d+)-(\d+)", p)) and number and int(m[1]) <= int(number[0]) <= int(m[2])),
        lambda p: p.startswith("re:") and bool(re.search(p[3:], layer)),
    ):
        for pattern, name in rules.items():
            if test(pattern):
                return name
    return default


def merge_models(df: DataFrame, rules: Mapping[str, str], base: DataFrame | None = None, default: str = "weight_average") -> DataFrame:
    """Each layer by its strategy; layers are few, so their names are read first."""
    layers = [r[0] for r in df.select("layer").distinct().collect()]
    by: dict[str, list] = {}
    for layer in layers:
        by.setdefault(strategy_of(str(layer), rules, default), []).append(layer)
    out = None
    for name, own in sorted(by.items()):
        fn, needs = STRATEGIES[name]
        part = df.where(F.col("layer").isin(own))
        got = fn(part, base) if needs else fn(part)
        out = got if out is None else out.unionByName(got)
    return out


def unlearn(model: Column, removed: Column, how: str = "surgical", alpha: float = 1.0, share: float = 1.0, scale: float = 1.0) -> Column:
    """Arrays: model - alpha removed ('negmerge'), model - removed ('surgical'), (model - share removed) scale ('proportional')."""
    f = {"negmerge": lambda m, r: m - alpha * r, "surgical": lambda m, r: m - r, "proportional": lambda m, r: (m - share * r) * scale}[how]
    return F.zip_with(model, removed, f)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)

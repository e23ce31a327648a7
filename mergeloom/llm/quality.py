"""Document quality by a regularised quadratic discriminant.

Twenty statistics of a document's bytes and words, transformed towards normality,
are read off in one pass over the text.  For each class a mean and a covariance
are summed over all labelled training rows; the covariance is shrunk towards the
pooled one and that towards its diagonal.  A document's score is the logistic of
the difference of the two Gaussian log-densities, over a temperature, with
Mahalanobis terms from the inverse Cholesky factors, which are computed once.

How much is shrunk and the temperature are chosen by cross-validation within the
training rows: the sums are kept for each fold, so that the models of all folds and
choices come from one pass, and a second adds up their losses on the rows left out.
All sums are of whole numbers, so that they don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, ship, workspace
from .textbytes import blocks, hash_runs, runs

#: Names of the statistics, in order.
STATISTICS = (
    "bytes", "words", "letters", "capitals", "marks", "exclamations", "digits", "lines", "full stops and commas", "word length", "spread of word lengths",
    "words that end in a mark", "words alike their neighbour", "words without a letter", "short words", "capital words", "words seen once", "longest run of one word", "marks in a row", "words a sentence",
)
#: Shares of the pooled covariance in a class's, of the diagonal in the pooled, and divisors of the log-odds (the statistics
#: are not independent draws from Gaussians) to choose from; folds; least variance; statistics are multiples of 1 / UNIT.
SHRINK, DIAGONAL, TEMPERATURE, FOLDS, FLOOR, UNIT = (0.1, 0.3, 0.5, 0.7, 0.9), (0.05, 0.2, 0.5), (1.0, 2.0, 4.0, 8.0, 16.0, 32.0), 5, 1e-4, 1024

_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~!"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def statistics(column: pa.Array) -> Iterator[np.ndarray]:
    """Transformed statistics, a block of texts at a time: one row a text, also for empty ones."""
    for i, j, data, offsets in blocks(column):
        rows, n_bytes = j - i, np.diff(offsets)
        size = np.maximum(n_bytes, 1)

        def share(flag: np.ndarray, offsets=offsets, size=size) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
            return (total[offsets[1:]] - total[offsets[:-1]]) / size

        letter, mark = _LETTER[data], _MARKS[data]
        capital = (data >= 0x41) & (data <= 0x5A)
        starts, stops, bounds = runs(~_SPACE[data], offsets)
        n = np.diff(bounds)
        per = np.maximum(n, 1)
        doc = np.repeat(np.arange(rows), n)
        mean = lambda x: np.bincount(doc, x, rows) / per  # noqa: B023, E731
        length = (stops - starts).astype(float)
        hashed = hash_runs(data, starts, stops)
        alike = np.zeros(len(hashed))
        alike[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
        count = lambda flag: (lambda c: c[stops] - c[starts])(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)]))  # noqa: B023, E731
        letters, capitals = count(letter), count(capital)
        order = np.lexsort((hashed, doc))
        first = np.ones(len(order), bool)
        first[1:] = (hashed[order][1:] != hashed[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        # Runs of equal neighbours: the longest in each text.
        heads = np.flatnonzero(alike == 0)
        longest = np.zeros(rows)
        if len(heads):
            np.maximum.at(longest, doc[heads], np.diff(np.append(heads, len(alike))))
        doubled = np.zeros(len(data), bool)
        doubled[1:] = mark[1:] & mark[:-1]
        ends = np.isin(data[stops - 1], np.frombuffer(b".!?", np.uint8)) if len(stops) else np.zeros(0)
        small = lambda x: np.log(x + 0.005)
        mean_length = mean(length)
        yield np.stack([
            np.log1p(n_bytes), np.log1p(n), small(1 - share(letter)), small(np.bincount(doc, capitals, rows) / np.maximum(np.bincount(doc, letters, rows), 1)),
            small(share(mark)), small(share(data == 0x21)), small(share((data >= 0x30) & (data <= 0x39))), small(share(data == 0x0A) * 20), small(share((data == 0x2E) | (data == 0x2C))),
            np.log1p(mean_length), np.log1p(np.sqrt(np.maximum(mean(length**2) - mean_length**2, 0))), small(mean(mark[stops - 1] if len(stops) else np.zeros(0))), small(mean(alike)), small(mean(letters == 0)),
            small(mean(length <= 3)), small(mean((capitals > 1) & (capitals >= 0.8 * letters))), small(np.bincount(doc[order][first], minlength=rows) / per), np.log1p(longest), small(share(doubled)), np.log1p(n / np.maximum(np.bincount(doc, ends, rows), 1)),
        ], axis=1)


@dataclass
class Discriminant:
    """Two Gaussians: means, inverse Cholesky factors of the covariances, log-determinants and log prior."""

    means: np.ndarray
    whiten: np.ndarray
    log_dets: np.ndarray
    log_prior: np.ndarray
    temperature: float = 1.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for rows of statistics, before the temperature."""
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.whiten[c].T
            density.append(self.log_prior[c] - 0.5 * (self.log_dets[c] + (z * z).sum(1)))
        return density[1] - density[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        return 1 / (1 + np.exp(-np.clip(self.odds(x) / self.temperature, -500, 500)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float, diagonal: float, temperature: float = 1.0) -> Discriminant:
    """From the classes' counts (2), sums (2, d) and sums of outer products (2, d, d); a class without rows takes the other's shape."""
    d, n = sums.shape[1], np.maximum(counts, 1)[:, None]
    if not counts.sum():
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), np.zeros(2))
    means = sums / n
    means[counts == 0] = sums.sum(0) / counts.sum()
    scatter = products - np.einsum("ci,cj->cij", sums, means)
    pooled = scatter[counts > 0].sum(0) / max(counts.sum() - (counts > 0).sum(), 1)
    variance = np.maximum(np.diag(pooled), FLOOR)
    pooled = (1 - diagonal) * pooled + diagonal * np.diag(variance)
    covariance = np.stack([(1 - shrink) * s / max(m - 1, 1) + shrink * pooled if m > d else pooled for s, m in zip(scatter, counts, strict=True)])
    covariance += np.eye(d) * FLOOR
    factors = np.linalg.cholesky(covariance)
    return Discriminant(means, np.linalg.inv(factors), 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1), np.log((counts + 1) / (counts.sum() + 2)), temperature)


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = len(STATISTICS)

    def run(batches):
        for batch in batches:
            got = np.rint(np.concatenate([np.zeros((0, d)), *statistics(batch.column(1))]) * UNIT) / UNIT
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), d).cast(pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, x array<double>")


def _added(rows: DataFrame, size: int, terms) -> np.ndarray:
    """The sum over all rows (fold, label, x) of ``terms(fold, label, x)``, int64 arrays of ``size`` for batches of rows; exact."""
    d = len(STATISTICS)

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            fold, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            total += terms(fold, label, np.asarray(batch.column(2).flatten()).reshape(-1, d))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["m"])

    total = np.zeros(size)
    # As many rows as ``size``, which depends on the model alone.
    for r in rows.select("fold", "label", "x").mapInArrow(run, "m array<long>").select(F.posexplode("m")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect():
        total[r.pos] = float(r.s)
    return total


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products by fold and class."""
    d = len(STATISTICS)
    width = 1 + d + d * d

    def terms(fold, label, x):
        out = np.zeros((FOLDS, 2, width), np.int64)
        whole = np.rint(x * UNIT)
        for f in range(FOLDS):
            for c in (0, 1):
                own = whole[(fold == f) & (label == c)]  # a batch's sums are exact in doubles
                out[f, c] = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()]).astype(np.int64)
        return out.ravel()

    total = _added(rows, FOLDS * 2 * width, terms).reshape(FOLDS, 2, width)
    return total[..., 0], total[..., 1 : 1 + d] / UNIT, total[..., 1 + d :].reshape(FOLDS, 2, d, d) / UNIT**2


def learn(rows: DataFrame) -> Discriminant:
    """The model of all rows (fold, label, x), with the choices of least logarithmic loss on the folds left out; the first of equal ones."""
    moments = _moments(rows)
    choices = [(s, g, t) for s in SHRINK for g in DIAGONAL for t in TEMPERATURE]
    left_out = [[fit(*(m.sum(0) - m[f] for m in moments), s, g) for s in SHRINK for g in DIAGONAL] for f in range(FOLDS)]

    def terms(fold, label, x):
        out = np.zeros((len(left_out[0]), len(TEMPERATURE)), np.int64)
        for f in range(FOLDS):
            own, sign = x[fold == f], np.where(label[fold == f] == 1, -1.0, 1.0)
            for k, model in enumerate(left_out[f]):
                odds = model.odds(own) * sign
                out[k] += [int(np.rint(np.logaddexp(0, np.clip(odds / t, -500, 500)) * 1e6).sum()) for t in TEMPERATURE]
        return out.ravel()

    losses = _added(rows, len(choices), terms)
    return fit(*(m.sum(0) for m in moments), *choices[int(np.argmin(losses))])


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels of the rows that are not held out: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Rows (id, score), one for each row of ``docs``: score is the probability of label 1.

    The model is fitted, and its choices are made, on all rows of ``labels`` with
    label 0 or 1 whose document is in ``docs``; pass only those to be learnt from.  Null and empty texts are
    documents without words and get the score of such; null ids are scored and
    never learnt from; repeated ids are scored row by row.  Without any label
    every score is 0.5.  Further columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    # One pass over the texts: the statistics are small and kept.
    at = workspace(spark, "quality")
    measured = materialize(_measured(docs, id_col, text_col), f"{at}/statistics")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int")
    model = learn(materialize(known.join(measured, "id").select(fold.alias("fold"), "label", "x"), f"{at}/labelled"))

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["id", "score"])

    return measured.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)

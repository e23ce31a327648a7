"""Toxic documents by multiple-instance learning.

A document is a bag of sentences and only the document is labelled.  A sentence's
probability is the logistic of a bias and the weights of its distinct features,
which are words and the beginnings of words, so that inflected and compound forms
count with their stems; the document's is their noisy-or, 1 - prod(1 - p).  Weights are learnt from document
labels through the noisy-or, so that the sentences which carry a label are found
without any label of their own.

The model is fitted on at most ``TRAINING_ROWS`` labelled documents of at most
``TRAINING_BYTES`` together, those of the smallest hashes of their ids; everything is
scored.  The penalty, the number of features and the steps are chosen by
cross-validation within these rows, features of each fold being found without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, ship, workspace
from .textbytes import blocks, hash_runs, runs

#: Labelled documents that the model is fitted on, at most, bytes of one of them and of all; those that choices are made on.
TRAINING_ROWS, LONGEST, TRAINING_BYTES, CHOICE_ROWS = 20_000, 1 << 20, 64 << 20, 3_000
#: Least documents of a feature; bytes of the beginnings of words that are features.
LEAST_DOCS, STEMS = 5, (4, 5, 6)
#: To choose from: L2 penalties of a weight, numbers of features, steps of Adam; folds, and Adam's rate.
PENALTY, VOCABULARY, STEPS, FOLDS, RATE = (1e-6, 1e-5, 1e-4, 1e-3), (256, 1024), (75, 150, 300), 3, 0.1

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n\r"]] = True


@dataclass
class Words:
    """The words of a block of texts."""

    rows: int
    doc: np.ndarray  # of each word
    sentence: np.ndarray  # of each word, numbered through the block
    features: list[tuple[np.ndarray, np.ndarray]]  # (words, hashes) of whole words, then of each length of beginnings
    first: np.ndarray  # of each text, its first sentence; then the number of all
    starts: np.ndarray  # of each word, its first byte within its text
    stops: np.ndarray


def words(column: pa.Array) -> Iterator[Words]:
    """Lower-cased (A-Z) runs of letters, digits and bytes over 0x7F; sentences end at . ! ? and line ends."""
    for i, j, data, offsets in blocks(column):
        starts, stops, bounds = runs(_WORD[data], offsets)
        doc = np.repeat(np.arange(j - i), np.diff(bounds))
        ended = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int64)])[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (ended[1:] != ended[:-1]) | (doc[1:] != doc[:-1])
        sentence = np.cumsum(new) - 1
        per = np.bincount(doc[new], minlength=j - i)
        data = _LOWER[data]
        features = [(np.arange(len(starts)), hash_runs(data, starts, stops, seed=3))]
        for stem in STEMS:
            long = np.flatnonzero(stops - starts >= stem)
            features.append((long, hash_runs(data, starts[long], starts[long] + stem, seed=3 + stem)))
        yield Words(j - i, doc, sentence, features, np.concatenate([[0], np.cumsum(per)]), starts - offsets[:-1][doc], stops - offsets[:-1][doc])


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the bias of a sentence."""

    known: np.ndarray
    weight: np.ndarray
    bias: float

    def look_up(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, index into known) of the distinct known features of each sentence."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = []
        for word, hashed in w.features:
            at = np.searchsorted(self.known, hashed)
            at[at == len(self.known)] = 0
            keep = np.flatnonzero(self.known[at] == hashed)
            pairs.append(w.sentence[word[keep]] * len(self.known) + at[keep])
        return np.divmod(np.unique(np.concatenate(pairs)), len(self.known))

    def sentences(self, w: Words) -> np.ndarray:
        """Log-odds of each sentence."""
        sentence, at = self.look_up(w)
        return self.bias + np.bincount(sentence, self.weight[at], int(w.first[-1])).astype(float)

    def documents(self, w: Words, odds: np.ndarray) -> np.ndarray:
        """The noisy-or of each text's sentences; 0 without sentences."""
        quiet = np.concatenate([[0], np.cumsum(np.logaddexp(0, odds))])
        return -np.expm1(-(quiet[w.first[1:]] - quiet[w.first[:-1]]))


@dataclass
class Bags:
    """Labelled documents: pairs of a sentence and a feature, of each document its first sentence (then the number of all), labels and folds."""

    sentence: np.ndarray
    at: np.ndarray
    first: np.ndarray
    label: np.ndarray
    fold: np.ndarray

    def quiet(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the sentences, and for each document -log P(no sentence is toxic)."""
        odds = theta[-1] + np.bincount(self.sentence, theta[self.at], int(self.first[-1]))
        sums = np.concatenate([[0], np.cumsum(np.logaddexp(0, odds))])
        return odds, sums[self.first[1:]] - sums[self.first[:-1]]

    def where(self, keep: np.ndarray, features: np.ndarray) -> Bags:
        """The documents where ``keep``, with the features in ``features``, numbered as there."""
        n = np.diff(self.first)
        new = np.cumsum(np.repeat(keep, n)) - 1
        to = np.full(int(max(self.at.max(initial=-1), features.max(initial=-1))) + 1, -1)
        to[features] = np.arange(len(features))
        pairs = np.repeat(keep, n)[self.sentence] & (to[self.at] >= 0)
        return Bags(new[self.sentence[pairs]], to[self.at[pairs]], np.concatenate([[0], np.cumsum(n[keep])]), self.label[keep], self.fold[keep])


def train(bags: Bags, v: int, penalty: float, steps: int, seen=None) -> np.ndarray:
    """Weights of ``v`` features and the bias, by full-batch Adam on the log-likelihood of document labels; ``seen(step, theta)`` after each step."""
    n_s, n_d, label = int(bags.first[-1]), len(bags.label), bags.label
    rate = min(max(float(label.mean()), 1e-3), 1 - 1e-3) if n_d else 0.5
    doc = np.repeat(np.arange(n_d), np.diff(bags.first))
    theta = np.zeros(v + 1)
    theta[-1] = np.log(-np.log1p(-rate) / max(n_s / max(n_d, 1), 1))
    m, s = np.zeros(v + 1), np.zeros(v + 1)
    for step in range(1, steps + 1 if n_s else 1):
        odds, quiet = bags.quiet(theta)
        # d loss / d quiet: 1 for label 0; -(1 - P) / P for label 1.
        pull = np.where(label == 1, -1 / np.maximum(np.expm1(np.minimum(quiet, 500)), 1e-9), 1.0)
        slope = np.clip(pull, -1e3, 1)[doc] / (1 + np.exp(-np.clip(odds, -500, 500))) / n_d
        grad = np.append(np.bincount(bags.at, slope[bags.sentence], v), slope.sum()) + penalty * np.append(theta[:-1], 0)
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        if seen is not None:
            seen(step, theta)
    return theta


def losses(bags: Bags, ranked: list[np.ndarray], penalty: float, size: int, fold: int) -> list[float]:
    """Logarithmic losses on a fold after each of ``STEPS`` steps on the others, with the ``size`` first features that are ranked without it."""
    chosen, out = ranked[fold][:size], []
    rest, own = bags.where(bags.fold != fold, chosen), bags.where(bags.fold == fold, chosen)

    def seen(step: int, theta: np.ndarray) -> None:
        if step in STEPS:
            quiet = np.maximum(own.quiet(theta)[1], 1e-9)
            out.append(float(np.where(own.label == 1, -np.log(-np.expm1(-quiet)), quiet).sum()))

    train(rest, len(chosen), penalty, max(STEPS), seen)
    return out or [0.0] * len(STEPS)


def _counts(batches):
    """Rows (word, fold, pos, neg): documents of each label that have the feature."""
    for batch in batches:
        labels, folds = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
        row, parts = 0, []
        for w in words(batch.column(0)):
            label, fold = labels[row : row + w.rows], folds[row : row + w.rows]
            row += w.rows
            for word, hashed in w.features:
                order = np.lexsort((hashed, w.doc[word]))
                h, d = hashed[order], w.doc[word[order]]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                parts.append((h[new], label[d[new]], fold[d[new]]))
        if parts:
            h, y, f = (np.concatenate(x) for x in zip(*parts, strict=True))
            values, at = np.unique(h, return_inverse=True)
            pos, of = (np.bincount(at * FOLDS + f, weight, len(values) * FOLDS).astype(np.int64) for weight in (y, np.ones(len(y))))
            some = np.flatnonzero(of)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)[some // FOLDS]), pa.array((some % FOLDS).astype(np.int32)), pa.array(pos[some]), pa.array((of - pos)[some])], ["word", "fold", "pos", "neg"])


def _ranked(counts: DataFrame, pos: dict[int, int], neg: dict[int, int], without: int | None) -> list[int]:
    """Hashes of the features that tell the labels best in all folds but one, best first."""
    p, n = (sum(v for f, v in x.items() if f != without) for x in (pos, neg))
    if not p or not n:
        return []
    own = [f for f in range(FOLDS) if f != without]
    has = {c: sum((F.col(f"{c}{f}") for f in own), F.lit(0)) for c in ("pos", "neg")}
    share = (F.col("p") + F.col("n")) / (p + n)
    z = (F.col("p") / p - F.col("n") / n) / F.sqrt(share * (1 - share) + 1e-9)
    top = counts.select("word", has["pos"].alias("p"), has["neg"].alias("n")).where(f"p + n >= {LEAST_DOCS}").orderBy(F.abs(z).desc(), "word").limit(max(VOCABULARY))
    return [r.word for r in top.select("word").collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAINING_ROWS) -> Model:
    """Learn from at most ``most`` rows of ``labels`` with label 0 or 1; pass only those to be learnt from.

    Documents of more than ``LONGEST`` bytes aren't learnt from, and in the order of
    the hashes of ids those are whose bytes so far are ``TRAINING_BYTES`` or fewer.
    """
    spark = docs.sparkSession
    ship(spark)
    at = workspace(spark, "toxicity")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    # Bounded by ``most`` small rows, so it can be broadcast.
    chosen = known.withColumn("hash", F.xxhash64("id")).orderBy("hash", "id", "label").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    some = texts.join(F.broadcast(chosen), "id").withColumn("bytes", F.octet_length("text")).where(f"bytes <= {LONGEST}")
    some = materialize(some, f"{at}/some")
    so_far = F.sum("bytes").over(Window.orderBy("hash"))  # over at most ``most`` rows of two numbers, but for repeated ids
    last = some.select("hash", "bytes").groupBy("hash").agg(F.sum("bytes").alias("bytes")).select("hash", so_far.alias("so_far")).where(f"so_far <= {TRAINING_BYTES}").agg(F.max("hash")).first()[0]
    sample = some.where(F.lit(False) if last is None else F.col("hash") <= last).select("text", "label", F.pmod(F.col("hash"), F.lit(FOLDS)).cast("int").alias("fold"), "hash")
    n = {(r["label"], r["fold"]): r["count"] for r in sample.groupBy("label", "fold").count().collect()}
    pos, neg = ({f: n.get((c, f), 0) for f in range(FOLDS)} for c in (1, 0))
    if not sum(pos.values()) or not sum(neg.values()):
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((sum(pos.values()) + 1) / (sum(neg.values()) + 1))))
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in ("pos", "neg") for f in range(FOLDS)]
    counts = sample.select("text", "label", "fold").mapInArrow(_counts, "word long, fold int, pos long, neg long").groupBy("word").agg(F.sum(F.col("pos") + F.col("neg")).alias("all"), *by_fold).where(f"all >= {LEAST_DOCS}")
    counts = materialize(counts, f"{at}/counts")
    ranked = [_ranked(counts, pos, neg, f) for f in (None, *range(FOLDS))]
    hashes = np.unique(np.array([h for r in ranked for h in r], np.int64).view(np.uint64))
    ranked = [np.searchsorted(hashes, np.array(r, np.int64).view(np.uint64)) for r in ranked]
    empty = Model(hashes, np.zeros(len(hashes)), 0.0)

    def found(batches):
        for batch in batches:
            told, row = [batch.column(c).to_pylist() for c in (1, 2, 3)], 0
            for w in words(batch.column(0)):
                sentence, feature = empty.look_up(w)
                ends = np.searchsorted(sentence, w.first)
                spots = [(sentence[x:y] - w.first[d], feature[x:y]) for d, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
                own = [t[row : row + w.rows] for t in told]
                yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.int32()), pa.array(own[1], pa.int32()), pa.array(own[2], pa.int64()), pa.array(np.diff(w.first), pa.int64()), pa.array([x.astype("<i4").tobytes() for x, _ in spots], pa.binary()), pa.array([y.astype("<i2").tobytes() for _, y in spots], pa.binary())], ["label", "fold", "hash", "n", "sentence", "at"])
                row += w.rows

    # Of ``TRAINING_BYTES`` of text no more than its known features.
    rows = sample.mapInArrow(found, "label int, fold int, hash long, n long, sentence binary, at binary").collect()
    rows.sort(key=lambda r: (r.hash, r.label, r.n, bytes(r.at), bytes(r.sentence)))  # sums then don't depend on the order of tasks
    bags, few = _bags(rows), _bags(rows[:CHOICE_ROWS])
    choices = [(p, size) for p in PENALTY for size in VOCABULARY]

    def tried(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                c, f = divmod(k, FOLDS)
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([losses(few, ranked[1:], *choices[c], f)], pa.list_(pa.float64()))], ["choice", "losses"])

    total = np.zeros((len(choices), len(STEPS)))
    for r in sorted(spark.range(0, len(choices) * FOLDS, 1, len(choices) * FOLDS).mapInArrow(tried, "choice long, losses array<double>").collect()):
        total[r.choice] += r.losses
    choice, steps = divmod(int(np.argmin(np.round(total, 6))), len(STEPS))
    penalty, size = choices[choice]
    features = np.sort(ranked[0][:size])
    theta = train(bags.where(np.ones(len(bags.label), bool), features), len(features), penalty, STEPS[steps])
    return Model(hashes[features], theta[:-1], float(theta[-1]))


def _bags(rows: list) -> Bags:
    first = np.concatenate([[0], np.cumsum([r.n for r in rows])]).astype(np.int64)
    sentence = np.concatenate([np.frombuffer(r.sentence, "<i4") + f for r, f in zip(rows, first, strict=False)]).astype(np.int64)
    return Bags(sentence, np.concatenate([np.frombuffer(r.at, "<i2") for r in rows]).astype(np.int64), first, np.array([r.label for r in rows]), np.array([r.fold for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows (id, score, sentences), one for each row of ``docs``.

    score: probability that the document is toxic.  sentences: those with a
    probability of ``least`` or more, as structs of start and stop (bytes of the
    text in UTF-8, from its first to after its last word) and score.  Null and
    empty texts, and texts without words, score 0; repeated ids are scored row by
    row, null ids too.  Further columns are ignored.
    """
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            scores, spans = [np.zeros(0)], []
            for w in words(batch.column(1)):
                odds = model.sentences(w)
                scores.append(model.documents(w, odds))
                spans += located(w, odds, least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores)), pa.array(spans, kind)], ["id", "score", "sentences"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double, sentences array<struct<start: long, stop: long, score: double>>").withColumnRenamed("id", id_col)


def located(w: Words, odds: np.ndarray, least: float) -> list[list[dict]]:
    """For each text the sentences of probability ``least`` or more."""
    out: list[list[dict]] = [[] for _ in range(w.rows)]
    for s in np.flatnonzero(odds >= np.log(least / (1 - least))):
        a, b = np.searchsorted(w.sentence, [s, s + 1])
        out[int(w.doc[a])].append({"start": int(w.starts[a]), "stop": int(w.stops[b - 1]), "score": float(1 / (1 + np.exp(-odds[s])))})
    return out

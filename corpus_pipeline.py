"""A training corpus from ``documents``: quality, toxicity, near-duplicates, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns documents of the same columns; the last returns token ids.
Decisions are about ids: rows that repeat an id share its fate, rows with a null id
are kept.  An empty table gives an empty result with the last stage's columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm import bpe, decontam, minhash, quality, toxicity
from mergeloom.llm.shared import materialize, workspace

#: Documents below the one or at or above the other are rejected; near-duplicates have this similarity in percent.
LEAST_QUALITY, MOST_TOXICITY, SIMILARITY = 0.3, 0.5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = quality.score(docs, quality.training_rows(_table(spark, sf_dir, "labels")))
    return _without(docs, scored.where(F.col("score") < LEAST_QUALITY))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    model = toxicity.fit(docs, quality.training_rows(_table(spark, sf_dir, "labels")))
    return _without(docs, toxicity.score(docs, model).where(F.col("score") >= MOST_TOXICITY))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return _without(docs, minhash.near_duplicates(docs, percent=SIMILARITY).where("not kept"))


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontam.contaminated(docs, _table(spark, sf_dir, "benchmark")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, lang, source, n_tokens, ids, decoded_sha256): token ids, and the digest of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", keep_civil),
    ("MinHash near-dedup", keep_one_of_group),
    ("benchmark decontamination", keep_unleaked),
    ("byte-level BPE", tokenise),
]

#: Fitted models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written and read again before the next."""
    at = workspace(spark, "corpus")
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"{at}/{k}")
    return docs

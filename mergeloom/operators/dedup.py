"""Exact and fuzzy deduplication of rows and texts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import as_list
from ..session import shared_dir


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each row once."""
    return df.dropDuplicates()


def exact(df: DataFrame, text: str | Column, order: str) -> DataFrame:
    """``df`` with kept and first: the first row by ``order`` of each lower-cased text is kept.

    White space tells; null texts are one text.  first is the order of the kept row.
    """
    text = F.col(text) if isinstance(text, str) else text
    same = Window.partitionBy(F.sha2(F.lower(F.coalesce(text, F.lit(""))), 256), text.isNull())
    first = F.min(order).over(same)
    return df.withColumn("first", first).withColumn("kept", F.col(order) == F.col("first"))


def record_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The text of a record: chosen columns joined by ' | ', or all as sorted name=value; null is None."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    if columns:
        return F.concat_ws(" | ", *(text(c) for c in columns))
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{c}="), text(c)) for c in sorted(df.columns)))


def records(df: DataFrame, order: str, columns: Sequence[str] | None = None, threshold: float | None = None) -> DataFrame:
    """Records of which none repeats an earlier one: exactly, or with ``threshold`` by similarity."""
    named = df.withColumn("__text", record_text(df.drop(order) if not columns else df, columns))
    out = exact(named, "__text", order) if threshold is None else fuzzy(named, "__text", order, threshold)
    return out.where("kept").select(df.columns)


def normal(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def bigrams(text: Column) -> Column:
    """The set of character pairs; a shorter text is its own only member."""
    n = F.char_length(text)
    return F.when(n < 2, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))))


def dice(a: Column, b: Column) -> Column:
    """Similarity of two texts by their sets of character pairs."""
    x, y = bigrams(normal(a)), bigrams(normal(b))
    return 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def fuzzy_pairs(df: DataFrame, text: str, order: str, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of order values whose texts have a Dice similarity of ``threshold`` or more.

    Two sets of sizes x <= y can only meet in threshold if they share an element
    among the x - ceil(threshold / (2 - threshold) * x) + 1 rarest of each, so only
    those are joined; the sizes bound partners too.  Equal texts count once.
    """
    sets = df.select(F.col(order).alias("id"), normal(F.col(text)).alias("norm")).groupBy("norm").agg(F.min("id").alias("id")).select("id", bigrams(F.col("norm")).alias("set"))
    sets = sets.withColumn("n", F.size("set"))
    parts = sets.select("id", "n", F.explode("set").alias("gram"))
    common = parts.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = parts.join(common, "gram").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "gram")))
    least = F.ceil(F.lit(threshold / (2 - threshold)) * F.col("n") - 1e-9)
    prefix = ranked.where(F.col("rank") <= F.col("n") - least + 1).select("id", "n", "gram")
    a, b = prefix.alias("a"), prefix.alias("b")
    sized = (F.col("a.n") * threshold <= F.col("b.n") * (2 - threshold)) & (F.col("b.n") * threshold <= F.col("a.n") * (2 - threshold))
    maybe = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id")) & sized).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    full = maybe.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return full.where(2 * F.size(F.array_intersect("x", "y")) >= threshold * (F.size("x") + F.size("y")) - 1e-9).select("a", "b")


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within one component: in order, keep what resembles nothing kept."""
    near: dict = {}
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        near.setdefault(b, []).append(a)
        near.setdefault(a, [])
    kept: dict = {}
    for node in sorted(near):
        twin = min((x for x in near[node] if kept.get(x) == x), default=node)
        kept[node] = twin
    return pd.DataFrame({"id": list(kept), "first": list(kept.values())})


def fuzzy(df: DataFrame, text: str, order: str, threshold: float = 0.85) -> DataFrame:
    """``df`` with kept and first: in order, a row is kept if it resembles no kept one; first is the one it resembles.

    Decisions depend only on rows that are linked, so each component of the links
    is decided by itself.
    """
    norm = normal(F.col(text))
    lead = F.min(order).over(Window.partitionBy(norm))
    pairs = fuzzy_pairs(df, text, order, threshold)
    decided = components(pairs).groupBy("component").applyInPandas(_greedy, f"id {dict(df.dtypes)[order]}, first {dict(df.dtypes)[order]}")
    out = df.withColumn("__lead", lead).join(decided.withColumnRenamed("id", "__lead").withColumnRenamed("first", "__first"), "__lead", "left")
    out = out.withColumn("first", F.coalesce("__first", "__lead")).drop("__first", "__lead")
    return out.withColumn("kept", F.col(order) == F.col("first"))


def components(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the smallest id of their component.

    Large-star and small-star steps (Kiveris et al., SoCC 2014) alternate until only
    stars are left, which takes a logarithmic number of rounds.
    """
    if not pairs.sparkSession.sparkContext.getCheckpointDir():
        pairs.sparkSession.sparkContext.setCheckpointDir(shared_dir(pairs.sparkSession))
    keep = lambda d: d.checkpoint()
    edges = keep(pairs.select("a", "b"))
    stars = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = keep(small.union(parent.select("u", F.col("m").alias("v"))).distinct())
        if stars.groupBy("u").count().where("count > 1").isEmpty() and stars.join(stars.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    # A component's smallest id is the parent of all others, and its own.
    return edges.join(stars.select(F.col("u").alias("a"), F.col("v").alias("component")), "a", "left").select("a", "b", F.coalesce("component", "a").alias("component"))


def fuzzy_rows(df: DataFrame, key: str | Sequence[str], threshold: float = 0.85) -> DataFrame:
    """Rows of a merged table of which none resembles one with a smaller key, in all columns but the first key."""
    keys = as_list(key) if key is not None else []
    others = sorted(c for c in df.columns if c not in keys[:1])
    text = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in others))
    # Keys are unique after a merge, so they are the order; of several columns as text.
    place = F.col(keys[0]) if len(keys) == 1 else F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys or others))
    named = df.withColumn("__text", text).withColumn("__order", place)
    return fuzzy(named, "__text", "__order", threshold).where("kept").select(df.columns)


# --- an index of what was seen ---


def seen(df: DataFrame, text: str | Column) -> DataFrame:
    """The hashes of lower-cased texts, as an index (hash); null texts are one text."""
    text = F.col(text) if isinstance(text, str) else text
    return df.select(F.sha2(F.concat(F.when(text.isNull(), "-").otherwise("+"), F.lower(F.coalesce(text, F.lit("")))), 256).alias("hash")).distinct()


def merge_seen(*indexes: DataFrame) -> DataFrame:
    """The union of indexes, whatever their order."""
    out = indexes[0]
    for i in indexes[1:]:
        out = out.unionByName(i)
    return out.distinct()


def unseen(df: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """Rows whose text no index of other rows holds."""
    named = df.withColumn("__text", F.col(text))
    hashed = named.withColumn("__hash", F.sha2(F.concat(F.when(F.col("__text").isNull(), "-").otherwise("+"), F.lower(F.coalesce("__text", F.lit("")))), 256))
    return hashed.join(index.withColumnRenamed("hash", "__hash"), "__hash", "left_anti").select(df.columns)


# --- MinHash ---


def minhash(df: DataFrame, text: str, order: str, num_hashes: int = 64, threshold: float = 0.5, bands: int | None = None) -> DataFrame:
    """``df`` with kept and first, as ``fuzzy``, by MinHash signatures of character pairs.

    Signatures are ``num_hashes`` minima of seeded hashes, the same in every
    process.  Rows that agree in all of a band's minima are compared by the share
    of equal minima; the number of bands makes a pair at the threshold meet with
    a chance over 99.9 %.
    """
    rows_per_band = next(r for r in range(8, 0, -1) if 1 - (1 - threshold**r) ** (num_hashes // r) > 0.999 or r == 1) if bands is None else num_hashes // bands
    sets = df.select(F.col(order).alias("id"), normal(F.col(text)).alias("norm")).groupBy("norm").agg(F.min("id").alias("id")).select("id", bigrams(F.col("norm")).alias("set"))
    signed = sets.select("id", F.transform(F.sequence(F.lit(1), F.lit(num_hashes)), lambda s: F.array_min(F.transform("set", lambda g: F.xxhash64(g, s)))).alias("sig"))
    keyed = signed.select("id", "sig", F.explode(F.transform(F.sequence(F.lit(0), F.lit(num_hashes // rows_per_band - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows_per_band + 1, rows_per_band)))).alias("band"))
    a, b = keyed.alias("a"), keyed.alias("b")
    same = F.size(F.filter(F.zip_with("a.sig", "b.sig", lambda x, y: x == y), lambda x: x)) / num_hashes
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id"))).where(same >= threshold).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    kind = dict(df.dtypes)[order]
    decided = components(pairs).groupBy("component").applyInPandas(_greedy, f"id {kind}, first {kind}")
    out = df.withColumn("__lead", F.min(order).over(Window.partitionBy(normal(F.col(text))))).join(decided.withColumnRenamed("id", "__lead").withColumnRenamed("first", "__first"), "__lead", "left")
    return out.withColumn("first", F.coalesce("__first", "__lead")).withColumn("kept", F.col(order) == F.col("first")).drop("__lead", "__first")

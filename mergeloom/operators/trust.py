"""Trust from evidence, and merges weighted by it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The dimensions of trust, that of a peer without evidence, and the least that takes part.
DIMENSIONS = ("integrity", "causality", "consistency", "gossip", "model", "context")
NO_EVIDENCE, LEAST_TRUST = 0.5, 0.1
#: Trust over which verification gets lighter, by level.
LEVELS = ((0.8, 0), (0.4, 1), (0.1, 2))


def evidence_merge(evidence: DataFrame) -> DataFrame:
    """Evidence (peer, dimension, observer, evidence) of all replicas: the greatest of each observer."""
    return evidence.groupBy("peer", "dimension", "observer").agg(F.max("evidence").alias("evidence"))


def trust(evidence: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Rows (peer, dimension, trust) for every dimension: 1 less all evidence, at least 0; 0.5 without any."""
    sums = evidence_merge(evidence).groupBy("peer", "dimension").agg(F.sum("evidence").alias("s"))
    every = sums.select("peer").distinct().withColumn("dimension", F.explode(F.array(*(F.lit(d) for d in dimensions))))
    return every.join(sums, ["peer", "dimension"], "left").select("peer", "dimension", F.when(F.col("s").isNull(), NO_EVIDENCE).otherwise(F.greatest(F.lit(0.0), 1 - F.col("s"))).alias("trust"))


def overall(trusts: DataFrame) -> DataFrame:
    """Rows (peer, trust, level): the mean over dimensions and the verification level it asks for."""
    t = F.round(F.avg("trust"), 12)
    level = F.lit(len(LEVELS))
    for bound, n in reversed(LEVELS):
        level = F.when(F.col("trust") > bound, n).otherwise(level)
    return trusts.groupBy("peer").agg(t.alias("trust")).withColumn("level", level)


def normalise(trusts: DataFrame) -> DataFrame:
    """Each dimension scaled so that its sum is the number of peers, kept within 0 and 1."""
    over = Window.partitionBy("dimension")
    total = F.sum("trust").over(over)
    return trusts.withColumn("trust", F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("trust") * F.count("*").over(over) / total))).otherwise(F.col("trust")))


def trust_lww(entries: DataFrame, trusts: DataFrame, key: str, factor: float = 0.1) -> DataFrame:
    """One entry (peer, value, ts) for each key: the latest by ts * (1 + factor * trust) among peers of enough trust, else the most trusted."""
    e = entries.join(trusts.select("peer", "trust"), "peer", "left").withColumn("trust", F.coalesce("trust", F.lit(NO_EVIDENCE)))
    eligible = F.col("trust") >= LEAST_TRUST
    rank = F.struct(eligible.cast("int"), F.when(eligible, F.col("ts") * (1 + factor * F.col("trust"))).otherwise(F.col("trust")), F.col("trust"), F.col("peer"), F.col("value"))
    return e.groupBy(key).agg(F.max_by(F.struct("value", "ts", "peer", "trust"), rank).alias("b")).select(key, "b.*")


def trust_average(entries: DataFrame, trusts: DataFrame, key: str, sigmas: float = 3.0) -> DataFrame:
    """Rows (key, value, peers, confidence): the mean weighted by trust.

    Peers of too little trust are out; with more than two left, so are values more
    than ``sigmas`` weighted deviations from the first mean.  confidence: 1 less
    the concentration of weight.
    """
    e = entries.join(trusts.select("peer", "trust"), "peer", "left").withColumn("w", F.coalesce("trust", F.lit(NO_EVIDENCE))).where(F.col("w") >= LEAST_TRUST)
    over = Window.partitionBy(key)
    mean = F.sum(F.col("w") * F.col("value")).over(over) / F.sum("w").over(over)
    spread = e.withColumn("mean", mean).withColumn("n", F.count("*").over(over)).withColumn("var", F.sum(F.col("w") * (F.col("value") - F.col("mean")) ** 2).over(over) / F.sum("w").over(over))
    inside = spread.where((F.col("n") <= 2) | (F.col("var") == 0) | (F.abs(F.col("value") - F.col("mean")) <= sigmas * F.sqrt("var")))
    return inside.groupBy(key).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"), F.count("*").alias("peers"), (1 - F.sum(F.col("w") ** 2) / F.sum("w") ** 2).alias("confidence"))


def trust_gate(entries: DataFrame, trusts: DataFrame, thresholds: Mapping[str, float], strict: bool = True) -> DataFrame:
    """Entries whose peer reaches the threshold in all dimensions named, or in one without ``strict``."""
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(float(t)).alias("least")) for d, t in thresholds.items()))
    spark = trusts.sparkSession
    asked = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    met = trusts.join(F.broadcast(asked), "dimension").groupBy("peer").agg(F.count_if(F.col("trust") >= F.col("least")).alias("met"))
    return entries.join(met.where(F.col("met") >= (len(thresholds) if strict else 1)), "peer", "left_semi")


def select_strategy(kind: Column) -> Column:
    """'trust_average' for numeric conflicts, 'trust_lww' for all others."""
    return F.when(kind.isin("double", "float", "bigint", "int", "smallint", "tinyint"), "trust_average").otherwise("trust_lww")


def semantic_checks(entries: DataFrame, key: str, most_magnitude: float = 1e6, most_shift: float = 3.0) -> DataFrame:
    """``entries`` with magnitude_ok and shift_ok: size, and distance from the key's mean in its deviations."""
    over = Window.partitionBy(key)
    mean, dev = F.avg("value").over(over), F.stddev_pop("value").over(over)
    return entries.withColumn("magnitude_ok", F.abs("value") <= most_magnitude).withColumn("shift_ok", (dev == 0) | (F.abs(F.col("value") - mean) <= most_shift * dev))


def collusion(series: DataFrame, peer: str, at: str, value: str, least: float = 0.95) -> DataFrame:
    """Pairs of peers whose series correlate at ``least`` or more over the times they share: (a, b, corr, n)."""
    x, y = series.alias("x"), series.alias("y")
    pairs = x.join(y, (F.col(f"x.{at}") == F.col(f"y.{at}")) & (F.col(f"x.{peer}") < F.col(f"y.{peer}")))
    return pairs.groupBy(F.col(f"x.{peer}").alias("a"), F.col(f"y.{peer}").alias("b")).agg(F.corr(f"x.{value}", f"y.{value}").alias("corr"), F.count("*").alias("n")).where(F.col("corr") >= least)


def trusted_prefix(stream: DataFrame, order: str, ok: Column, group: Sequence[str] = ()) -> DataFrame:
    """Rows before the first that isn't ok, in order."""
    so_far = F.min(F.coalesce(ok, F.lit(False)).cast("int")).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return stream.withColumn("__ok", so_far).where("__ok = 1").drop("__ok")


def exponential_distance(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov-Smirnov distance of waiting times from the exponential distribution of their mean: (group, n, distance)."""
    over = Window.partitionBy(*group)
    rows = df.select(*group, F.col(value).cast("double").alias("x")).where("x is not null")
    rows = rows.withColumn("n", F.count("*").over(over)).withColumn("m", F.avg("x").over(over)).withColumn("i", F.row_number().over(over.orderBy("x")))
    model = 1 - F.exp(-F.col("x") / F.col("m"))
    return rows.groupBy(*group).agg(F.max("n").alias("n"), F.max(F.greatest(F.abs(F.col("i") / F.col("n") - model), F.abs((F.col("i") - 1) / F.col("n") - model))).alias("distance"))


def exact_sum(value: Column) -> Column:
    """A sum of doubles that no order changes: of their values to nine decimals."""
    return F.sum(value.cast("decimal(28,9)")).cast("double")

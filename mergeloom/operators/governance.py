"""Access, audit, encryption, compliance, metrics, drift and views of conflicts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import merge

# --- access ---


@dataclass(frozen=True)
class Policy:
    """What a role may do and see."""

    permissions: frozenset[str] = frozenset()
    allow: frozenset[str] | None = None
    deny: frozenset[str] = frozenset()
    most_rows: int | None = None


class AccessDenied(PermissionError):
    pass


def visible(df: DataFrame, policy: Policy) -> DataFrame:
    """The columns that the policy allows and doesn't deny."""
    return df.select(*(c for c in df.columns if c not in policy.deny and (policy.allow is None or c in policy.allow)))


def secure_merge(a: DataFrame, b: DataFrame, policy: Policy, **how) -> DataFrame:
    """``merge`` for a role with the permission 'merge', on the columns it sees; too many rows are refused."""
    if "merge" not in policy.permissions:
        raise AccessDenied("the role may not merge")
    a, b = visible(a, policy), visible(b, policy)
    if policy.most_rows is not None:
        for df in (a, b):
            if df.limit(policy.most_rows + 1).count() > policy.most_rows:
                raise AccessDenied(f"the role may merge {policy.most_rows} rows at most")
    return merge(a, b, **how)


# --- audit ---


def table_hash(df: DataFrame) -> str:
    """A digest of rows in any order: equal tables have equal ones."""
    cells = [F.to_json(F.col(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f.name) for f in df.schema]
    row = df.agg(F.bit_xor(F.xxhash64(*cells, F.lit(0))).alias("x"), F.sum(F.xxhash64(*cells, F.lit(1)).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return hashlib.sha256(f"{row.x}:{row.s}:{row.n}:{','.join(sorted(df.columns))}".encode()).hexdigest()


@dataclass
class AuditLog:
    """Entries chained by hashes: each one's covers the one before."""

    genesis: str = "genesis"
    entries: list[dict] = field(default_factory=list)

    def append(self, operation: str, inputs: str, output: str, at: float | None = None, **details) -> dict:
        at = datetime.now(UTC).timestamp() if at is None else at
        before = self.entries[-1]["entry_hash"] if self.entries else hashlib.sha256(self.genesis.encode()).hexdigest()
        entry = {"seq": len(self.entries), "ts": float(at), "operation": operation, "input_hash": inputs, "output_hash": output, "prev_hash": before, "details": json.dumps(details, sort_keys=True)}
        entry["entry_hash"] = hashlib.sha256(entry_text(entry).encode()).hexdigest()
        self.entries.append(entry)
        return entry

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(e[c] for c in AUDIT_COLUMNS) for e in self.entries], "seq long, ts double, operation string, input_hash string, output_hash string, prev_hash string, details string, entry_hash string")


AUDIT_COLUMNS = ("seq", "ts", "operation", "input_hash", "output_hash", "prev_hash", "details", "entry_hash")


def entry_text(e: Mapping) -> str:
    return ":".join([str(e["seq"]), f"{e['ts']:.6f}", e["operation"], e["input_hash"], e["output_hash"], e["prev_hash"], e["details"]])


def broken_links(log: DataFrame, genesis: str = "genesis") -> DataFrame:
    """Entries whose own hash or link to the one before doesn't hold; none in a sound log."""
    text = F.concat_ws(":", F.col("seq").cast("string"), F.format_string("%.6f", F.col("ts")), "operation", "input_hash", "output_hash", "prev_hash", "details")
    before = F.coalesce(F.lag("entry_hash").over(Window.orderBy("seq")), F.sha2(F.lit(genesis), 256))
    return log.withColumn("before", before).where((F.col("before") != F.col("prev_hash")) | (F.sha2(text, 256) != F.col("entry_hash"))).drop("before")


def audited_merge(a: DataFrame, b: DataFrame, log: AuditLog, **how) -> DataFrame:
    """``merge`` with an entry in the log."""
    out = merge(a, b, **how)
    log.append("merge", f"{table_hash(a)}+{table_hash(b)}", table_hash(out), key=how.get("key"))
    return out


# --- encryption ---


def encrypt_columns(df: DataFrame, columns: Sequence[str], key: Column) -> DataFrame:
    """Columns as AES-GCM ciphertext, and <name>__tag, a keyed digest that equal values share.

    The tag tells equality alone: it has no order, so conflicts on ciphertext must
    be decided by a clear time stamp.
    """
    out = df
    for c in columns:
        text = F.col(c).cast("string")
        out = out.withColumn(f"{c}__tag", F.sha2(F.concat(F.base64(key.cast("binary")), F.lit(f":{c}:"), text), 256)).withColumn(c, F.aes_encrypt(text.cast("binary"), key.cast("binary"), F.lit("GCM")))
    return out


def decrypt_columns(df: DataFrame, kinds: Mapping[str, str], key: Column) -> DataFrame:
    """Columns as they were, cast to their types; tags go."""
    out = df
    for c, kind in kinds.items():
        out = out.withColumn(c, F.aes_decrypt(F.col(c), key.cast("binary"), F.lit("GCM")).cast("string").cast(kind)).drop(f"{c}__tag")
    return out


def rotate_key(df: DataFrame, kinds: Mapping[str, str], old: Column, new: Column) -> DataFrame:
    return encrypt_columns(decrypt_columns(df, kinds, old), list(kinds), new)


def merge_encrypted(a: DataFrame, b: DataFrame, key: str, timestamp_col: str, encrypted: Sequence[str]) -> DataFrame:
    """The later row's ciphertexts win; values whose tags are equal are no conflict."""
    bare = lambda df: df.select(*(c for c in df.columns if c not in encrypted and not c.endswith("__tag")), *(F.struct(F.col(f"{c}__tag").alias("tag"), F.base64(c).alias("data")).alias(c) for c in encrypted))
    out = merge(bare(a), bare(b), key, timestamp_col)
    return out.select(*(c for c in out.columns if c not in encrypted), *(F.unbase64(F.col(c)["data"]).alias(c) for c in encrypted), *(F.col(c)["tag"].alias(f"{c}__tag") for c in encrypted))


# --- compliance ---

#: What personal identifiers look like.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"(?<!\d)(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
    "card": r"(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d)",
    "date": r"(?<!\d)(?:19|20)\d{2}-\d{2}-\d{2}(?!\d)",
}
#: What fields of personal data are called.
FIELD_NAMES = r"(?i)(?:^|_)(?:ssn|dob|birth|mrn|patient|address|phone|email|zip|insurance|diagnosis|name)(?:_|$)"


def personal_data(df: DataFrame, columns: Sequence[str] | None = None, patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """Rows (field, kind, rows): in how many rows a text field has each kind of identifier; all rows are read."""
    text = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    found = df.agg(*(F.count_if(F.col(c).rlike(p)).alias(f"{i}_{k}") for i, c in enumerate(text) for k, p in patterns.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(k).alias("kind"), F.col(f"{i}_{k}").alias("rows")) for i, c in enumerate(text) for k in patterns))
    return found.select(F.explode(rows).alias("x")).select("x.*").where("rows > 0")


_RULES: dict[str, Callable[[Mapping], tuple[str, str]]] = {}


def register_compliance_rule(name: str, rule: Callable[[Mapping], tuple[str, str]]) -> None:
    """``rule(evidence)`` returns (status, description)."""
    _RULES[name] = rule


def _has(*keys: str) -> Callable[[Mapping], tuple[str, str]]:
    return lambda e: ("pass", "evidence is there") if all(e.get(k) for k in keys) else ("fail", "no evidence of " + ", ".join(k for k in keys if not e.get(k)))


for _name, _needed in {
    "AI_ACT_TRANSPARENCY": ("provenance",), "AI_ACT_OVERSIGHT": ("audit_log",), "GDPR_ERASURE": ("unmerge",), "GDPR_ACCESS_CONTROL": ("access_policy",), "GDPR_RECORDS": ("audit_log", "provenance"),
    "HIPAA_ENCRYPTION": ("encryption",), "HIPAA_AUDIT": ("audit_log",), "SOX_INTEGRITY": ("audit_log", "table_hash"), "SOX_SEGREGATION": ("access_policy",),
}.items():
    register_compliance_rule(_name, _has(*_needed))


def compliance(spark: SparkSession, evidence: Mapping, prefix: str = "") -> DataFrame:
    """Rows (rule, status, description) of all rules whose name begins with ``prefix``."""
    return spark.createDataFrame([(n, *r(evidence)) for n, r in sorted(_RULES.items()) if n.startswith(prefix)], "rule string, status string, description string")


def compliance_summary(report: DataFrame) -> DataFrame:
    """Rows (framework, rules, passed, failed, compliant) of a compliance report; a framework is what stands before a rule's first underscore."""
    framework = F.substring_index("rule", "_", 1).alias("framework")
    return report.groupBy(framework).agg(F.count("*").alias("rules"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed")).withColumn("compliant", F.col("failed") == 0)


def forget(merged: DataFrame, log: DataFrame, key: str, side: str) -> tuple[DataFrame, DataFrame]:
    """A side's contribution taken back, and one row that reports it: rows before and after, cells that still show it."""
    from .merge import unmerge, unmerge_residual

    out = unmerge(merged, log, key, side)
    before, after = merged.agg(F.count("*").alias("rows_before")), out.agg(F.count("*").alias("rows_after"))
    return out, before.join(after).join(unmerge_residual(out, log, key, side).agg(F.count("*").alias("residual_cells")))


# --- metrics, drift ---


def metrics(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, durations, conflict and error rates of operations (op, ms, rows, conflicts, ok), over all or by some columns."""
    return events.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"), F.sum("rows").alias("rows"), F.sum("conflicts").alias("conflicts"),
        (F.sum("conflicts") / F.greatest(F.sum("rows"), F.lit(1))).alias("conflict_rate"), (F.count_if(~F.col("ok")) / F.count("*")).alias("error_rate"),
    )


def health(summary: DataFrame, most_errors: float = 0.05, most_conflicts: float = 0.5) -> DataFrame:
    """``metrics`` with status: 'unhealthy' over a limit, 'degraded' over 80 % of it."""
    over = lambda f: (F.col("error_rate") > most_errors * f) | (F.col("conflict_rate") > most_conflicts * f)
    return summary.withColumn("status", F.when(over(1.0), "unhealthy").when(over(0.8), "degraded").otherwise("healthy"))


def prometheus(summary: DataFrame, prefix: str = "merge") -> DataFrame:
    """Lines of the text exposition format, one for each metric and group."""
    numbers = [f.name for f in summary.schema if isinstance(f.dataType, T.NumericType)]
    labels = [f.name for f in summary.schema if isinstance(f.dataType, T.StringType)]
    tag = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.col(c), F.lit('"')) for c in labels)), F.lit("}")) if labels else F.lit("")
    return summary.select(F.explode(F.array(*(F.concat(F.lit(f"{prefix}_{c}"), tag, F.lit(" "), F.col(c).cast("string")) for c in numbers))).alias("line"))


def drift(before: DataFrame, after: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    """Rows (field, mean_before, mean_after, distance, drifted) for numeric fields: how many of its deviations a mean has moved."""
    names = [f.name for f in before.schema if isinstance(f.dataType, T.NumericType) and f.name in after.columns]
    stats = lambda df, tag: df.agg(*(g(F.col(c).cast("double")).alias(f"{tag}{k}_{c}") for c in names for k, g in (("m", F.avg), ("s", F.stddev_pop))))
    both = stats(before, "b").join(stats(after, "a"))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"bm_{c}").alias("mean_before"), F.col(f"am_{c}").alias("mean_after"), F.col(f"bs_{c}").alias("s")) for c in names))
    moved = F.abs(F.col("mean_after") - F.col("mean_before"))
    distance = F.when(F.col("s") > 0, moved / F.col("s")).when(moved > 0, F.lit(float("inf"))).otherwise(0.0)
    return both.select(F.explode(rows).alias("x")).select("x.*").select("field", "mean_before", "mean_after", distance.alias("distance")).withColumn("drifted", F.col("distance") > sensitivity)


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    from .schema import evolve

    return evolve(before.schema, after.schema).changes_frame(before.sparkSession)


# --- conflicts ---


def conflict_topology(log: DataFrame, by: Sequence[str] = ("field", "strategy")) -> DataFrame:
    """Conflicts and how they went, by field and strategy, of a provenance log."""
    hit = log.where("source = 'conflict_resolved'")
    return hit.groupBy(*by).agg(F.count("*").alias("conflicts"), F.count_if(F.col("winner") == "a").alias("won_a"), F.count_if(F.col("winner") == "b").alias("won_b"), F.count_if(F.col("winner") == "computed").alias("computed"))


def conflict_clusters(log: DataFrame, key: str) -> DataFrame:
    """Keys by the set of fields in conflict: (fields, keys)."""
    sets = log.where("source = 'conflict_resolved'").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    return sets.groupBy("fields").agg(F.count("*").alias("keys"))


def conflict_times(log: DataFrame, times: DataFrame, key: str, ts: str, width: float) -> DataFrame:
    """Conflicts by spans of ``width`` seconds of their keys' time (key, ts): (span, field, conflicts)."""
    hit = log.where("source = 'conflict_resolved'").select(key, "field")
    return hit.join(times.select(key, F.col(ts).cast("double").alias("__ts")), key).groupBy((F.floor(F.col("__ts") / width) * width).alias("span"), "field").agg(F.count("*").alias("conflicts"))


def most_conflicted(log: DataFrame, key: str, n: int = 10, least: bool = False) -> DataFrame:
    """The ``n`` keys with most (or least) fields in conflict, then the smallest: (key, conflicts)."""
    per = log.groupBy(key).agg(F.count_if(F.col("source") == "conflict_resolved").alias("conflicts"))
    return per.orderBy(F.col("conflicts").asc() if least else F.col("conflicts").desc(), key).limit(n)


def conflict_graph(log: DataFrame, key: str) -> DataFrame:
    """Links (source, target, weight) between fields that conflict in the same rows, for drawing."""
    hit = log.where("source = 'conflict_resolved'").select(key, "field")
    return hit.alias("x").join(hit.alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.field") < F.col("y.field"))).groupBy(F.col("x.field").alias("source"), F.col("y.field").alias("target")).agg(F.count("*").alias("weight"))

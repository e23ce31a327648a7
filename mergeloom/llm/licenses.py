"""License notices by ordered signature rules.

A document is a stream of lower-cased words.  Each rule is a regular expression
over that stream with a label, a priority and keywords: phrases of which every match
holds one.  Only texts with the most telling word of some keyword are made into a
stream, and of those only rules with that word and a keyword in the stream are tried.  A detection that
lies within another of the same or a higher priority is suppressed, so that of
overlapping signatures the most telling one stays: an SPDX tag before a grant, a
sentence of a license or an address, and those before a bare name.

Everything is Spark's own functions.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, ship, workspace
from .signatures import FAMILIES, NOTICES, TEXTS

#: Words: runs of ASCII digits and letters and of all that isn't ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed phrases and labels, found at every place and never suppressed.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Trust in a detection of each priority, and in a base phrase.
CONFIDENCE, BASE_CONFIDENCE = (0.3, 0.6, 0.9, 1.0), 0.9
_GRANT = r"(?:released|distributed|available|published|provided|covered|redistributed|made available|dual licensed|governed)"
#: The most telling words, and those that tell least: a keyword's word is of the first kind, or else the longest that isn't of the second.
TELLING = ("license", "licence", "licensed", "licenced")
COMMON = set((
    "under the by org com net released distributed available published provided covered redistributed made governed software without document program information see good just only file public general conditions provide personal "
    "private research additional associated authors built commercial contains consent developed distribute distribution documentation evaluation foundation functionality includes independent installing itself obtain "
    "placed portions products prominent protection publication reference shall specifically substantial understood whatever zero advertising agreement academic broadcast collection historical united states "
    "material works network version library object source dedicated additional licenses use page image code person purpose group project text work free terms part parties used product supplied parties package copy organization grant granted derived "
    "this to of in for with what you into and or not be may is are as it that any all has have from on at an a if do s was which its by used no non same site based book called intent freely managed u"
).split())


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[str, ...]
    words: tuple[str, ...]
    pattern: str


def ways(pattern: str) -> set[str]:
    r"""What a match of a pattern holds at least: a string for each choice among its branches.

    Whatever may be left out is left out: \1 stands for whole words that may be there
    or not, \0 for anything.  Knows what the signatures use: literals, sets of
    letters, ``\d``, ``\S``, groups with branches, and after these ``?``, ``*``, ``+``
    or a range.
    """
    at = 0

    def branches() -> list[str]:
        nonlocal at
        out = [[""]]
        while at < len(pattern) and pattern[at] != ")":
            c = pattern[at]
            at += 1
            if c == "|":
                out.append([""])
                continue
            if c == "(":
                at += 2  # ?:
                part = branches()
                at += 1
            elif c == "[":
                end = pattern.index("]", at)
                part, at = list(pattern[at:end]), end + 1
            elif c == "\\":
                at += 1
                part = ["\0"]
            else:
                part = [c]
            after = pattern[at : at + 1]
            if after in ("?", "*"):
                at += 1
                if len(part) == 1 and part[0] in (" ", "e"):
                    part = [*part, ""]  # a word of its own or not, and another spelling
                else:
                    part = ["\1" if all(x[:1] in (" ", "\1") or x[-1:] in (" ", "\1") for x in part) else "\0"]
            elif after in ("+", "{"):
                at = pattern.index("}", at) + 1 if after == "{" else at + 1
                part = ["\0"]
            out[-1] = [x + y for x in out[-1] for y in part]
        return [x for alternative in out for x in alternative]

    return set(branches())


def rule(label: str, priority: int, pattern: str) -> Rule:
    """The rule of a pattern over whole words."""
    keywords, words = set(), set()
    for way in ways(pattern):
        tells = lambda w: w not in COMMON and not w.isdigit()
        keywords.add(max(way.replace("\1", "\0").split("\0"), key=lambda x: (any(tells(w) and w not in TELLING for w in x.split()), len(x))).strip())
        # Without the words that may be left out, those beside them may be one: "gpl 2", "gpl2".
        for between in (" ", ""):
            whole = [w for w in re.sub("\1+", " ", re.sub("(?<=[^ \0\1])\1+(?=[^ \0\1])", between, way)).split() if "\0" not in w]
            words.add(next((w for w in TELLING if w in whole), None) or max(whole, key=lambda w: (tells(w), len(w))))
    return Rule(label, priority, tuple(sorted(keywords)), tuple(sorted(words)), f" {pattern}(?= )")


def rules() -> list[Rule]:
    """All rules in order: base phrases, texts, then the tag, address, grants and name of each family, and notices."""
    out = [rule(label, -1, phrase) for phrase, label in BASE]
    out += [rule(label, 2, pattern) for label, pattern in TEXTS]
    maybe = "(?: licen[cs]e)?"
    for label, name, tag, address in FAMILIES:
        # A name that says so itself needs no such word after it; "mit" alone is German.
        word = maybe if "licen" in name or label.startswith(("cc", "gpl", "lgpl", "agpl")) else r"(?: public)? licen[cs]e"
        out += [
            rule(label, 3, f"spdx license identifier {tag}"),
            rule(label, 2, f"(?:https )?(?:www )?{address}"),
            rule(label, 2, f"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{name}{maybe}(?: terms)?"),
            rule(label, 2, f"{_GRANT} under (?:the )?(?:terms of (?:the )?)?{name}{word}"),
            rule(label, 1, f"{name}{word}(?: version| v)?"),
        ]
    return out + [rule(label, 1, pattern) for label, pattern in NOTICES] + [rule("unknown-license", 0, "licensed under")]


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def matches(words: str, table: list[Rule]) -> Column:
    """array<struct<rule, gaps, lengths>> for the array column ``words``: of each rule with matches the words between them, and in them."""
    by_word: dict[str, list[int]] = {}
    for i, r in enumerate(table):
        for w in r.words:
            by_word.setdefault(w, []).append(i)
    # Constants, which the optimiser reads once; as hundreds of expressions they would take seconds to plan.
    gates = f"from_json({_text(json.dumps(by_word))}, 'map<string, array<int>>')"
    listed = f"from_json({_text(json.dumps([{'rule': i, 'keywords': r.keywords, 'pattern': r.pattern} for i, r in enumerate(table)]))}, 'array<struct<rule: int, keywords: array<string>, pattern: string>>')"
    held = f"array_distinct(transform(filter({words}, w -> lower(w) IN ({', '.join(map(_text, sorted(by_word)))})), w -> lower(w)))"
    stream = f"concat(' ', translate(array_join({words}, ' '), '{UPPER}', '{LOWER}'), ' ')"
    counts = lambda made: f"transform({made}, x -> {_spaces('x')})"
    told = f"transform(array_distinct(flatten(transform(h, w -> element_at({gates}, w)))), i -> get({listed}, i))"
    tried = f"filter({told}, r -> exists(r.keywords, k -> contains(s, k)))"
    found = f"transform({tried}, r -> named_struct('rule', r.rule, 'gaps', {counts('split(s, r.pattern, -1)')}, 'lengths', {counts('regexp_extract_all(s, r.pattern, 0)')}))"
    return F.expr(f"transform(array({held}), h -> IF(size(h) > 0, transform(array({stream}), s -> filter({found}, m -> size(m.lengths) > 0))[0], NULL))[0]")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections), one for each row of ``docs``.

    n_base counts all places of base phrases, first_word and last_word are their
    smallest and largest first words, from 0.  base_labels and labels (those of
    surviving detections too) are distinct, sorted and comma-joined, empty if
    there are none.  score is the trust in the best detection, 0 without any.
    detections: label, start and stop in words, of the survivors in order.

    Null and empty texts have no words.  Repeated and null ids are scanned row by
    row; further columns are ignored; an empty table gives an empty result.  The
    work on a text grows with its length, however many notices it holds.
    """
    spark = docs.sparkSession
    ship(spark)
    table = rules()
    at = workspace(spark, "licenses")
    # ``words`` is used twice and more, so it stays a projection of its own.
    words = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    rows = words.select("id", F.size("words").cast("long").alias("n_words"), matches("words", table).alias("found"), F.monotonically_increasing_id().alias("row"))
    # Kept once, so that detections can be taken apart and meet their row again.
    rows = materialize(rows, f"{at}/rows")

    label, priority, trust = (F.array(*(F.lit(x) for x in xs)) for xs in ([r.label for r in table], [r.priority for r in table], [BASE_CONFIDENCE if r.priority < 0 else CONFIDENCE[r.priority] for r in table]))
    one = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.rule", F.posexplode(F.arrays_zip("f.gaps", "f.lengths")).alias("i", "m")).where("m.lengths IS NOT NULL")
    stop = "cast(sum(m.gaps + m.lengths) OVER (PARTITION BY row, rule ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS long)"
    placed = one.select("row", "rule", F.expr(stop).alias("stop"), "m.lengths").select("row", "rule", (F.col("stop") - F.col("lengths")).alias("start"), "stop")
    each = placed.select("*", label[F.col("rule")].alias("label"), priority[F.col("rule")].alias("priority"), trust[F.col("rule")].alias("trust"))
    # Sorted so, whatever contains a detection comes before it: the farthest stop so far of each priority tells.
    before = "OVER (PARTITION BY row ORDER BY start, stop DESC, priority DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    reach = "CASE priority " + " ".join(f"WHEN {p} THEN max(CASE WHEN priority >= {p} THEN stop END) {before}" for p in range(len(CONFIDENCE))) + " END"
    alive = each.withColumn("reach", F.expr(reach)).where("priority < 0 or reach is null or reach < stop")
    base = F.col("priority") < 0
    summed = alive.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("trust").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "stop", "label", "rule"))).alias("detections"),
    )
    none = F.lit("")
    return rows.join(summed, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "detections",
    )

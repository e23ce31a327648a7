"""Classifiers, leaks, licenses, quotations and the pipeline."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergeloom.llm import decontam, licenses, queries, quality, quotes, signatures, toxicity

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
@pytest.mark.parametrize(("name", "label", "recall", "precision"), [("op7_quality", "quality", 0.95, 0.95), ("op4_toxicity", "toxic", 0.7, 0.8)])
def test_held_out_recall_and_precision(spark, name, label, recall, precision):
    """Of either class, so that no constant passes."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(f"{label} in (0, 1)")
    got = queries.QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    held = [tuple(r) for r in got.where("held_out").join(labels, "doc_id").select(label, "predicted").collect()]
    for c in (0, 1):
        right = held.count((c, c))
        assert right >= recall * sum(t == c for t, _ in held) and right >= precision * sum(p == c for _, p in held)


def test_held_out_labels_change_nothing(spark):
    """Scores with the labels of held-out rows turned round are the same, to the last bit."""
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choices([*plain, "bad", "vile"] if i % 3 == 0 else plain, k=rng.randint(5, 40))) + ("!!! ### 11" if i % 2 else ".")) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = []
    for turned in (0, 1):
        labels = spark.createDataFrame([(i, (i % 2 + turned * (zlib.crc32(str(i).encode()) % 5 == 0)) % 2, (int(i % 3 == 0) + turned * (zlib.crc32(str(i).encode()) % 5 == 0)) % 2) for i, _ in docs], "doc_id long, quality int, toxic int")
        known = quality.training_rows(labels).repartition(1 + turned)
        out.append((sorted(quality.score(df.repartition(2 + turned), known).collect()), sorted(toxicity.score(df, toxicity.fit(df.repartition(2 + turned), known)).select("doc_id", "score").collect())))
    assert out[0] == out[1]


def test_choices_are_those_of_least_loss():
    """A penalty that is too high and features that are noise lose on the folds left out."""
    rng = np.random.default_rng(1)
    n = 240
    label = np.arange(n) % 2
    at = np.where(label == 1, rng.integers(0, 3, n), rng.integers(3, 40, n))
    bags = toxicity.Bags(np.arange(n), at, np.arange(n + 1), label, np.arange(n) // 2 % 3)
    ranked = [np.arange(40)] * 3
    loss = {p: sum(toxicity.losses(bags, ranked, p, 40, f)[-1] for f in range(3)) for p in (1e-4, 10.0)}
    assert loss[1e-4] < 0.5 * loss[10.0]
    few = bags.where(bags.fold == 1, np.array([5, 1]))
    assert len(few.label) == 80 and set(few.at) == {0, 1} and (few.label[few.sentence[few.at == 1]] == 1).all()


ODD = [(1, None), (2, ""), (3, "   "), (4, "!!!"), (5, "word " * 30_000), (6, "\x00é日"), (None, "A null id. Fine."), (1, "again")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in ODD], "doc_id long, text string, score int, label int")


def test_odd_texts_get_scores(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(4, 0, 1), (5, 1, 0), (4, 0, 1), (9, 1, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (none, labels):
        scored = quality.score(odd, known)
        assert scored.count() == len(ODD) and scored.where("score between 0 and 1").count() == len(ODD)
        model = toxicity.fit(odd, known)
        scored = toxicity.score(odd, model)
        assert scored.count() == len(ODD) and scored.where("score between 0 and 1").count() == len(ODD)
        assert {r.score for r in scored.where("doc_id in (2, 3, 4)").collect()} == {0.0}
    assert quality.score(odd.where("false"), labels).count() == 0
    assert toxicity.score(odd.where("false"), toxicity.fit(odd.where("false"), labels)).count() == 0


def test_discriminant_is_the_difference_of_densities():
    rng = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    x = [rng.normal(c, 1 + c, (400, d)) for c in (0, 1)]
    m = quality.fit(np.array([400.0, 400.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]), 0.3, 0.1, 2.0)
    q = rng.normal(0.5, 1, (5, d))
    want = []
    for c in (0, 1):
        cov = np.linalg.inv(m.whiten[c].T @ m.whiten[c])
        diff = q - x[c].mean(0)
        want.append(m.log_prior[c] - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)))
    assert np.allclose(m.scores(q), 1 / (1 + np.exp(-(want[1] - want[0]) / m.temperature)))


def test_statistics_don_t_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["Hello, world! It is.", "", None, "AAA AAA aaa | | 123", "é" * 50, "x\ny\nz"] * 3)
    whole = np.concatenate(list(quality.statistics(texts)))
    single = np.concatenate([np.concatenate(list(quality.statistics(texts.slice(i, 1)))) for i in range(len(texts))])
    assert np.allclose(whole, single) and np.isfinite(whole).all()


def test_toxic_sentences_are_found_from_document_labels(spark):
    rng = random.Random(0)
    plain = [f"word{i}" for i in range(200)]
    docs = []
    for i in range(600):
        sentences = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.randint(2, 10))]
        bad = i % 3 == 0
        if bad:
            sentences.insert(rng.randrange(len(sentences)), "you zorkish grimble " + rng.choice(plain))
        docs.append((i, ". ".join(sentences) + ".", int(bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 400").drop("toxic"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for i, text, bad in docs[400:]:
        assert (got[i].score >= 0.5) == bool(bad)
        for s in got[i].sentences:
            assert "zorkish" in text.encode()[s.start : s.stop].decode()
        assert bool(got[i].sentences) == bool(bad)


def test_the_noisy_or():
    m = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -1.0)
    w = toxicity.Words(3, np.zeros(0), np.zeros(0), [], np.array([0, 2, 2, 5]), np.zeros(0), np.zeros(0))
    odds = np.array([-1.0, 2.0, 0.0, -3.0, 30.0])
    p = 1 / (1 + np.exp(-odds))
    assert np.allclose(m.documents(w, odds), [1 - (1 - p[0]) * (1 - p[1]), 0, 1 - np.prod(1 - p[2:])])


QUESTION = "If Alice buys 12 apples for 3.50 dollars and gives 5 apples to Bob, how many apples does she keep? Answer in 20 minutes."


def test_leaks(spark, rows):
    bench = spark.createDataFrame([(1, QUESTION, 0), (2, "the seven small words here", 0), (3, None, 0), (4, "", 0), (None, "a null item id here", 0)], "item_id long, text string, doc_id int")
    clean = " ".join(f"filler{i}" for i in range(3000))
    docs = [
        (1, f"{clean}. {QUESTION} {clean}"),
        (2, "x " + QUESTION.replace("12", "77").replace("Alice", "Carol").replace("3.50", "9") + " y"),
        (3, QUESTION.replace("12 apples", "40 apples").replace("gives 5", "gives 12")),
        (4, None), (5, ""), (6, "well, the seven SMALL words, here!"), (7, QUESTION.upper()), (None, QUESTION), (8, "If Alice buys 12 apples for 3.50 dollars and " + clean), (9, clean), (1, "again"),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, share int")
    got = rows(decontam.contaminated(df, bench), "doc_id", "item_id", "kind")
    assert got == [(1, 1, "exact"), (2, 1, "re-parameterised"), (3, 1, "re-parameterised"), (6, 2, "exact"), (7, 1, "exact")]
    assert decontam.contaminated(df.where("false"), bench).count() == 0 and decontam.contaminated(df, bench.where("false")).count() == 0


def test_inconsistent_slots_are_no_leak(spark):
    item = "take 5 red balls then add 5 blue balls and finally put 5 green balls into it"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, item.replace("5", "8")), (2, "take 1 red balls then add 2 blue balls and finally put 3 green balls into it")], "doc_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(df, bench).collect()] == [1]


def test_names_that_begin_sentences(spark, rows):
    item = "John has 5 apples. Mary gives John 3 more. How many apples does John have?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("John", "Peter").replace("Mary", "Susan").replace("5", "7").replace("3", "4")
    docs = [
        (1, other), (2, f"He said:\n\"{other}\" (so)"), (3, item), (4, item.lower()), (5, "we know that " + item.replace(". ", ", ").replace("How", "how").replace("John has", "john has")),
        (6, other.replace("Peter 4", "Paul 4").replace("does Peter", "does Ann")), (7, "Peter has 7 pears. Susan takes 4. How many are left?"), (8, item.upper()),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(decontam.contaminated(df, bench), "doc_id", "kind", "share")
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 8]
    assert [g[1] for g in got] == ["re-parameterised"] * 2 + ["exact"] * 4
    assert all(g[2] == 1 for g in got)


def test_one_edited_number_leaves_the_literal_windows(spark, rows):
    item = "put 5 red balls and 5 blue balls into a box that the two girls have carried up the hill and then down to the old mill by the river where 5 boys wait for them"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, item.replace("put 5", "put 6")), (2, item), (3, "put 1 red balls and 2 blue balls into a box")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(decontam.contaminated(df, bench), "doc_id", "n_changed")
    assert got == [(1, 1), (2, 0)]


def test_slots_correspond_both_ways(spark, rows):
    item = "take 5 red balls and 7 blue balls that Alice put on the table next to the ones from Bob and count them all"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    swap = lambda *new: (lambda it: re.sub(r"5|7|Alice|Bob", lambda m: next(it), item))(iter(new))
    df = spark.createDataFrame([(1, swap("3", "3", "Carol", "Carol")), (2, swap("3", "4", "Carol", "Dan")), (3, swap("7", "5", "Bob", "Alice"))], "doc_id long, text string")
    assert rows(decontam.contaminated(df, bench), "doc_id", "n_slots", "n_changed") == [(2, 4, 4), (3, 4, 4)]


QUESTIONS = [
    "If {A} has {1} apples and gives {2} of them to {B}, how many apples does {A} have left at the end of the day?",
    "{A} drives {1} km from home to the office and then {2} km to the gym. How far does {A} drive in a week of five days?",
    "A train leaves the station at {1} o'clock and travels at a speed of {2} km per hour. When will {A} reach the town that is {3} km away?",
    "{A} and {B} share a box of {1} cookies. {B} eats {2} cookies more than {A}. How many cookies does each of them eat?",
    "The recipe needs {1} grams of flour for {2} pancakes. How much flour does {A} need when {B} and {C} come and they want {3} pancakes?",
    "Last summer {A} read {1} pages a day for {2} days. How many pages are in the book that {A} borrowed from {B}?",
    "There are {1} students in the class. The teacher, {A}, puts them into groups of {2}. How many groups are there and who is left over?",
    "{A} earns {1} dollars an hour and works {2} hours a week, while {B} earns {3} dollars an hour. Who earns more in a month?",
    "Wenn {A} {1} Äpfel hat und {B} davon {2} Stück gibt, wie viele Äpfel hat {A} dann noch am Ende des Tages übrig?",
    "{A} fährt {1} km von zu Hause bis zur Arbeit und danach {2} km zum Sport. Wie weit fährt {A} in einer Woche?",
    "Ein Zug fährt um {1} Uhr ab und ist mit {2} km in der Stunde unterwegs. Wann kommt {A} in der Stadt an, die {3} km entfernt ist?",
    "In der Klasse sind {1} Kinder. Die Lehrerin heißt {A} und teilt alle in Gruppen zu je {2} Kindern ein. Wie viele Gruppen gibt es?",
]
PEOPLE = "Alice Bob Carol Dan Erin Frank Grace Heidi Ivan Judy Mallory Niaj Olivia Peggy Rupert Sybil Trent Victor Walter Yusuf Will Rose Mark Jürgen Zoë".split()


def test_recall_of_other_parameters(spark):
    """Each question with other names and numbers, in several spellings, within other text; and no question in text of the same words."""
    rng = random.Random(5)

    def filled(template, people):
        numbers = rng.sample(range(2, 900), 3)
        return re.sub(r"\{(\w)\}", lambda m: people["ABC".index(m[1])] if m[1] in "ABC" else str(numbers[int(m[1]) - 1]), template)

    bench = spark.createDataFrame([(i, filled(q, ["Alice", "Bob", "Carol"])) for i, q in enumerate(QUESTIONS)], "item_id long, text string")
    spoken = [w for q in QUESTIONS for w in re.sub(r"\{\w\}", "", q).split()]
    filler = lambda: " ".join(rng.choices(spoken, k=rng.randint(0, 60)))
    forms = {"as it is": str, "capitals": str.upper, "small": str.lower, "wrapped": lambda x: re.sub(r" (?=\S+ \S+ \S+$)", "\n", x), "quoted": lambda x: f'He asked: "{x}" So'}
    docs, want = [], []
    for form in forms.values():
        for i, q in enumerate(QUESTIONS):
            for _ in range(5):
                want.append((len(docs), i))
                docs.append((len(docs), f"{filler()}. {form(filled(q, rng.sample(PEOPLE[1:], 3)))} {filler()}"))
    clean = [(len(docs) + k, " ".join(rng.choices(spoken + PEOPLE, k=400))) for k in range(200)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), bench).collect()}
    per = len(want) // len(forms)
    recall = {name: sum(w in got for w in want[k * per : (k + 1) * per]) / per for k, name in enumerate(forms)}
    assert min(recall.values()) >= 0.9, recall
    assert got <= set(want)


def test_later_steps_hold_no_literals_of_the_benchmark(spark):
    docs = spark.createDataFrame([(1, "If Anna buys 12 kg of apples for 30 dollars, how much does she pay for each of them?")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "If Bob buys 15 kg of apples for 40 dollars, how much does he pay for each of them?")], "item_id long, text string")
    plan = decontam.contaminated(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert "apples" not in plan and "regexp_extract_all" not in plan


def test_parts_of_a_benchmark(spark, rows, monkeypatch):
    bench = spark.createDataFrame([(i, re.sub(r"\{(\w)\}", "Alice", q)) for i, q in enumerate(QUESTIONS)], "item_id long, text string")
    docs = bench.selectExpr("item_id AS doc_id", "text")
    whole = rows(decontam.contaminated(docs, bench))
    monkeypatch.setattr(decontam, "PART_WINDOWS", 60)
    assert rows(decontam.contaminated(docs, bench)) == whole and len(whole) == len(QUESTIONS)
    monkeypatch.setattr(decontam, "VOCABULARY", 10)
    with pytest.raises(ValueError, match="plain words"):
        decontam.contaminated(docs, bench)


@tables
def test_literal_benchmark_passages_and_no_others(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(i, j) for i, t in docs for j, b in bench if b in t}
    assert {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF).collect()} == want


COMPILED = [(r, re.compile(r.pattern)) for r in licenses.rules()]


def scanned(text):
    """Every rule tried on every text, all pairs of detections compared."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    stream = " " + "".join(w + " " for w in words)
    found = []
    for i, (rule, pattern) in enumerate(COMPILED):
        for hit in pattern.finditer(stream):
            start = stream[: hit.start()].count(" ")
            found.append((start, start + hit[0].count(" "), rule.priority, i))
    base = [f for f in found if f[2] < 0]
    alive = [f for f in found if f[2] >= 0 and not any(g != f and g[2] >= f[2] and g[0] <= f[0] and g[1] >= f[1] and ((g[0], g[1]) != (f[0], f[1]) or g[2] > f[2] or g[3] < f[3]) for g in found)]
    return len(words), base, {COMPILED[f[3]][0].label for f in base + alive}


def digest(texts):
    """What ``scan`` should say of each text."""
    out = []
    for t in texts:
        n, base, labels = scanned(t or "")
        out.append((n, len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None), ",".join(sorted(labels))))
    return out


def scans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in sorted(licenses.scan(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "labels").collect(), key=lambda r: r.doc_id)]


NOTICES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0; under the MIT license", "CC BY-NC 4.0 and cc-by--nc, Licensed under CC BY-NC-SA 4.0 International", "SPDX-License-Identifier: GPL-3.0-or-later",
    "This is free software: GNU Lesser General Public License version 2.1. All rights reserved.", "see https://opensource.org/licenses/BSD-3-Clause", "Copyright (c) 2020 by us, licensed under the new BSD license", "mit der Bahn", "", None, "no words of that kind",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "published under the terms of the Mozilla Public License 2.0, Eclipse Public License v2.0", "Creative Commons Attribution Share-Alike 4.0 licence creativecommons.org/licenses/by-sa", "APACHE LICENSE VERSION 2 apache license version 2",
]


def test_licenses_against_all_pairs(spark):
    df = spark.createDataFrame([(i % 12, t, "x") for i, t in enumerate(NOTICES)] + [(99, " lorem ".join(t or "" for t in NOTICES) * 20, "y")], "doc_id long, text string, labels string")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in licenses.scan(df).collect()), key=repr)
    texts = df.collect()
    assert got == sorted(((r.doc_id, *d) for r, d in zip(texts, digest(r.text for r in texts), strict=True)), key=repr)
    assert licenses.scan(df.where("false")).count() == 0


def sample(pattern, rng):
    """A random string that the pattern matches."""
    at = 0

    def branches():
        nonlocal at
        out = [""]
        while at < len(pattern) and pattern[at] != ")":
            c, at = pattern[at], at + 1
            if c == "|":
                out.append("")
                continue
            if c == "(":
                start = at = at + 2
                branches()
                end, at = at, at + 1
                one = lambda: again(start, end)  # noqa: B023, E731
            elif c == "[":
                end = pattern.index("]", at)
                one, at = (lambda x: lambda: rng.choice(x))(pattern[at:end]), end + 1
            elif c == "\\":
                one, at = (lambda x: lambda: rng.choice("0123456789") if x == "d" else rng.choice(["foo", "a1", "zé"]))(pattern[at]), at + 1
            else:
                one = (lambda x: lambda: x)(c)
            least, most = 1, 1
            if m := re.match(r"\?|\*|\+|\{(\d+)(?:,(\d+))?\}", pattern[at:]):
                at += len(m[0])
                least, most = {"?": (0, 1), "*": (0, 3), "+": (1, 3)}.get(m[0]) or (int(m[1]), int(m[2] or m[1]))
            out[-1] += "".join(one() for _ in range(rng.randint(least, most)))
        return rng.choice(out)

    def again(start, end):
        nonlocal at
        held, at = at, start
        out = branches()
        assert at == end
        at = held
        return out

    return branches()


def test_no_rule_needs_another_rules_words(spark):
    """What any rule matches is found in a text that holds nothing else."""
    rng = random.Random(3)
    texts = []
    for r, _ in COMPILED:
        for _ in range(6):
            texts.append(sample(r.pattern[1:].removesuffix("(?= )"), rng))
            assert re.fullmatch(r.pattern[1:].removesuffix("(?= )"), texts[-1])
    got = scans(spark, texts)
    assert got == digest(texts) and all(g[4] for g in got)


def test_lines_that_licenses_are_known_by(spark):
    lines = {
        "Distributed under the MPL 2.0.": "mpl-2.0", "Released under Apache 2.0.": "apache-2.0", "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa", "CC0 1.0 Universal": "cc0-1.0", "see mozilla.org/MPL/2.0": "mpl-2.0",
        "eclipse.org/legal/epl-v10": "epl-1.0", "joinup.ec.europa.eu/collection/eupl": "eupl-1.2", "scripts.sil.org/OFL": "ofl-1.1", "WTFPL.net": "wtfpl", "mariadb.com/bsl11": "busl-1.1", "Placed into the public domain": "public-domain", "PROPRIETARY AND CONFIDENTIAL": "proprietary",
        "EPL 2.0": "epl-2.0", "CC-BY-ND": "cc-by-nd", "the Software shall be used for Good, not Evil": "json", "Neither the name of Foo Bar Inc. nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
        "under the same terms as Perl itself": "perl", "Café mpl": "mpl", "Tous droits réservés": "all-rights-reserved", "Work of the U.S. Government": "us-government-work", "SPDX-License-Identifier: CC-BY-4.0": "cc-by",
        "example complete account accord": "", "mit der Bahn": "", "a license to drive": "",
    }
    assert [g[4] for g in scans(spark, lines)] == list(lines.values())


def test_many_notices_in_one_text(spark):
    n = 100_000
    text = "under the MIT License. " * n
    began = time.perf_counter()
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (4 * n, n, 0, 4 * (n - 1), "mit")
    assert len(row.detections) >= n and time.perf_counter() - began < 60


def test_rules_are_many_and_by_hand():
    table = licenses.rules()
    assert len(signatures.TEXTS) > 200 and len({r.pattern for r in table}) == len(table)
    assert all(all(r.keywords) and all(r.words) for r in table)


def test_quotations(spark):
    talk = [
        (1, 0, "user", "Shall we meet on Monday?\nBring the papers."),
        (1, 1, "assistant", "> Shall we  meet on monday\nYes."),
        (1, 2, "user", ">> Shall we meet on Monday?\n> Yes.\n\nGood, then.\n"),
        (1, 3, "user", "> Bring the papers.\nI will.\n> never said\n"),
        (2, 0, "user", None), (2, 0, "user", ""), (2, 1, None, "> Yes."), (None, 5, "user", "alone"), (None, 6, "user", "> alone\n"), (3, None, "user", "x"),
    ]
    df = spark.createDataFrame([(*t, "x") for t in talk], "conv_id long, turn long, role string, text string, position string")
    got = {(r.conv_id, r.turn, r.role, r.text): r for r in quotes.link(df).collect()}
    assert quotes.link(df).count() == len(talk)
    one = [next(r for r in got.values() if (r.conv_id, r.turn) == (1, i)) for i in range(4)]
    assert [r.text for r in one] == ["Shall we meet on Monday?\nBring the papers.", "Yes.", "Good, then.", "I will."]
    assert [r.parent_turn for r in one] == [None, 0, 1, 0] and [r.quoted_parent for r in one] == [False, True, True, True]
    # What answers the first message stands before the answer to an answer.
    assert [r.position for r in one] == [0, 1, 3, 2]
    assert [(q.level, q.turn) for q in one[2].quotes] == [(2, 0), (1, 1)]
    assert (one[3].n_quoted, one[3].n_linked) == (2, 1)
    last = got[2, 1, None, ""]
    assert last.quoted_parent is False and last.parent_turn == 0 and last.position == 2
    assert got[None, 6, "user", ""].parent_turn == 5 and got[None, 6, "user", ""].quoted_parent
    assert one[1].formatted == "<|assistant|>\nYes.\n<|end|>"
    assert quotes.link(df.where("false")).count() == 0


def test_passages_in_other_lines(spark):
    long = "I think that the old bridge by the mill will not hold until the spring, and we should close it now."
    talk = [
        (0, long + "\nOk."), (1, "Ok.\nSomething else that nobody quotes at all."), (2, "> I think that the old bridge by\n> the mill will not hold until the spring,\n> and we should close it now.\nAgreed."),
        (3, "> the mill will not hold until the spring\n> \n> and we should CLOSE it now\nWhy?"), (4, "> ok\nFine."), (5, "> the mill will not hold for ever and nobody should cross the river\nNo."),
    ]
    df = spark.createDataFrame([(7, t, "user", x) for t, x in talk], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quotes.link(df).collect()}
    assert [(got[t].n_quoted, got[t].n_linked, [q.turn for q in got[t].quotes]) for t in range(2, 6)] == [(1, 1, [0]), (1, 1, [0]), (1, 1, [1]), (1, 0, [])]
    assert got[3].quotes[0].text == "the mill will not hold until the spring\n\nand we should CLOSE it now"


def talks(n, seed):
    """Messages of a hot and of other conversations that quote earlier ones, re-wrapped or in part."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out, said = [], {}
    for i in range(n):
        conv = 0 if rng.random() < 0.4 else rng.choice([None, *range(1, n // 8)])
        own = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 14))) + rng.choice([".", "!", ""]) for _ in range(rng.randint(1, 4))] + rng.choice([[], ["Yes."], ["a common line that all of them say"]])
        text = list(own)
        if said.get(conv) and rng.random() < 0.6:
            words = re.sub(r"[.!]", "", " ".join(rng.choice(said[conv]))).split()
            words = words[rng.randrange(len(words)) :] if rng.random() < 0.3 else words
            cut = rng.randint(1, len(words))
            mark = rng.choice(["> ", ">", "> > ", ">> "])
            text = [mark + " ".join(words[:cut]), *([mark + " ".join(words[cut:])] if words[cut:] else []), *own]
        said.setdefault(conv, []).append(own)
        out.append((conv, i // 3, rng.choice(["user", "assistant", None]), "\n".join(text)))
    return out


def linked(messages):
    """The same by going through each conversation in order."""
    out, place = [], {}
    words = lambda t: re.sub(r"[^\w]+|_+", " ", t.lower()).split()
    units = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {("=", *w)}
    rank = lambda m: (m[1], m[2] is not None, m[2] or "", hashlib.md5(m[3].encode()).hexdigest())
    for conv in {m[0] for m in messages}:
        latest, rows = {}, sorted((m for m in messages if m[0] == conv), key=rank)
        for at, (_, turn, role, text) in enumerate(rows):
            parts = []
            for line in text.split("\n"):
                marks = re.match(r"[ \t]*((?:>[ \t]?)*)", line)
                level = marks[1].count(">")
                if not parts or parts[-1][0] != level:
                    parts.append((level, []))
                parts[-1][1].append(line[marks.end() :])
            parent, n, quoted = None, 0, []
            for level, ls in parts:
                if level and words(" ".join(ls)):
                    n += 1
                    of = units(words(" ".join(ls)))
                    votes = Counter(latest[u] for u in of if u in latest)
                    best = max(votes, key=lambda s: (votes[s], s), default=None)
                    if best is not None and votes[best] >= 0.5 * len(of):
                        quoted.append((level, rows[best][1]))
                        if level == 1:
                            parent = max(best, -1 if parent is None else parent)
            own = "\n".join(x for level, ls in parts if level == 0 for x in ls)
            w = words(own)
            short = [words(x) for x in own.split("\n") + re.split(r"[.!?\n]+", own)]
            for u in {tuple(w[i : i + 5]) for i in range(len(w) - 4)} | {("=", *x) for x in short if 0 < len(x) < 5}:
                latest[u] = at
            place[conv, at] = (parent if parent is not None else at - 1, turn, role, own.strip("\n"), n, quoted, parent is not None)
        order = sorted(range(len(rows)), key=lambda at: (place[conv, at][0], at))
        for position, at in enumerate(order):
            parent, turn, role, own, n, quoted, known = place[conv, at]
            out.append((conv, turn, role, own, n, tuple(quoted), rows[parent][1] if parent >= 0 else None, known, position))
    return sorted(out, key=repr)


def test_quotations_by_going_through(spark):
    messages = talks(6000, 1)
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted(((r.conv_id, r.turn, r.role, r.text, r.n_quoted, tuple((q.level, q.turn) for q in r.quotes), r.parent_turn, r.quoted_parent, r.position) for r in quotes.link(df).collect()), key=repr)
    assert got == linked(messages)
    assert sum(len(g[5]) for g in got) > 2000 and sum(g[0] == 0 for g in got) > 2000


def test_quotations_in_sql(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame(talks(500, 2), "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op6_quotation_linking(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op6_quotation_linking']})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


@tables
def test_pipeline_keeps_what_each_stage_keeps(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    left = ids(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"], name
        assert ids(docs) < left
        left = ids(docs)
    out = corpus_pipeline.run(spark, SF)
    assert ids(out) == left
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in out.collect())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

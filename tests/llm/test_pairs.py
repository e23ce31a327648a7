"""Near-duplicates of texts and of vectors against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergeloom.llm import components, embed_dedup, minhash
from mergeloom.llm.components import connected_components


def closure(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def check(spark, texts, percent, k=64):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, percent=percent, k=k).collect()}
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    low = closure(range(len(texts)), links)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), low[i], low[i] == i) for i in range(len(texts))}


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(vocabulary, k=12))
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, words))) + (" " + line if rng.random() < 0.5 else ""))
    return out


@pytest.mark.parametrize(("percent", "k"), [(85, 64), (80, 64), (60, 16)])
def test_near_duplicates_are_those_of_brute_force(spark, percent, k):
    check(spark, corpus(percent, 150), percent, k)


def test_defined_results_for_odd_texts(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    texts = [None, "", " \t\n", "one two", "ONE  two", "one two three four five", "one two three four five six", "É x é", "é X é", long, long + " y", "a " * 500, "a " * 700, "nbsp is word", None, "one two"]
    check(spark, texts, 85)


def test_a_large_group_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    base = [f"t{i}" for i in range(80)]
    rng, texts = random.Random(1), []
    for _ in range(70):
        w = list(base)
        for i in rng.sample(range(80), rng.choice([1, 2, 3, 4])):
            w[i] = f"u{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    check(spark, texts + texts[:5], 85)


def near_copies(seed, n, tag="t", edits=(1, 2, 3)):
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = [f"{tag}{i}" for i in range(80)]
        for i in rng.sample(range(80), rng.choice(edits)):
            w[i] = f"u{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_hubs_and_blocks_find_chains_and_groups_that_share_lines(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    monkeypatch.setattr(minhash, "HUBS", 2)
    texts = near_copies(3, 60) + near_copies(4, 40, "s", (1, 4, 6))
    # Both groups and a chain, of which neighbours only are near, share values with the first.
    chain, words = [], [f"t{i}" for i in range(80)]
    for step in range(0, 60, 2):
        words[step : step + 2] = [f"c{step}", f"d{step}"]
        chain.append(" ".join(words))
    check(spark, texts + chain + [" ".join([t, s]) for t, s in zip(near_copies(5, 10), near_copies(6, 10, "s"), strict=True)], 85, 32)


def test_a_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    dealt, plain = [], minhash._dealt

    def counted(*args):
        out = plain(*args)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_dealt", counted)
    check(spark, [" ".join(f"t{i}" for i in range(80)), *near_copies(8, 250, edits=(1,))], 80)
    assert dealt[0] < 251


def test_repeats_nulls_extra_and_empty(spark, rows):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (5, "a b c d e f", None)], "doc_id long, text string, sketch string")
    out = minhash.near_duplicates(df.withColumn("component_id", F.lit(9)).withColumn("id", F.lit(3)))
    assert rows(out) == [(1, 2, 1, True), (1, 2, 1, True), (5, 2, 1, False), (None, 2, None, None)]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_least_shared_is_never_too_high():
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        for n in (1, 2, 5, 10, 20, 27, 28, 40, 63, 64, 65, 100, 300):
            c = minhash.least_shared(n, 64, percent)
            assert 1 <= c <= min(n, 64)
            for _ in range(30):
                union = rng.permutation(10**6)[: max(n, n * 100 // percent)]
                other = union[: max(1, len(union))]
                mine = set(union[:n])
                if len(mine & set(other)) * 100 >= percent * len(mine | set(other)):
                    assert len(set(sorted(mine)[:64]) & set(sorted(other)[:64])) >= c


def test_components(spark, rows):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 200), (7, 7), (None, 3)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "a long, b long"))))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = work()
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_few_links_take_few_jobs(spark, rows, monkeypatch):
    rng = np.random.default_rng(5)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(-300, 300, (280, 2))] + [(1000 + i, 1001 + i) for i in range(60)], "a long, b long")
    few, jobs = jobs_of(spark, "few links", lambda: rows(connected_components(links)))
    assert jobs <= 8  # however many rounds they would take
    monkeypatch.setattr(components, "TASK_LINKS", -1)
    many, more = jobs_of(spark, "many links", lambda: rows(connected_components(links)))
    assert few == many and more > jobs


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        r = rng.random()
        if out and r < 0.3:
            out.append((np.array(out[rng.integers(len(out))]) + rng.normal(0, 0.2 / d**0.5, d)).tolist())
        elif out and r < 0.5:
            out.append(list(out[rng.integers(len(out))]))
        else:
            v = rng.normal(0, 1, d)
            out.append((v / np.linalg.norm(v)).tolist())
    return out


def check_vectors(spark, data, threshold, kind="double", **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(data)], f"vec_id long, embedding array<{kind}>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, threshold=threshold, **more).collect()}
    arrays = [np.array(v, np.float32 if kind == "float" else np.float64).astype(np.float64) if v and None not in v else None for v in data]
    good = [a is not None and np.isfinite(a).all() and a.any() for a in arrays]
    links = []
    for i in range(len(arrays)):
        for j in range(i):
            if good[i] and good[j] and len(arrays[i]) == len(arrays[j]):
                a, b = (x / np.abs(x).max() for x in (arrays[i], arrays[j]))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links.append((i, j))
    low, n = closure(range(len(data)), links), dict.fromkeys(range(len(data)), 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert got == {i: (n[i], low[i], low[i] == i) for i in range(len(data))}


@pytest.mark.parametrize(("d", "kind", "tile"), [(64, "float", 50), (24, "double", 40), (3, "double", 4096)])
def test_vectors_are_those_of_brute_force(spark, d, kind, tile):
    check_vectors(spark, vectors(d, 220, d), 0.95, kind, tile=tile)


@pytest.mark.parametrize("size", [1, 2, 1000])
def test_groups_of_tiles(spark, monkeypatch, size):
    monkeypatch.setattr(embed_dedup, "GROUP_BYTES", size * 16 * 8 * 8)
    monkeypatch.setattr(embed_dedup, "TASKS", 1)
    check_vectors(spark, vectors(7, 150, 8), 0.95, tile=16)


def test_defined_results_for_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    check_vectors(spark, [None, [], [0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [1e200, 0.0], [1e-200, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0, 0.0], [1.0], [-1.0], [1.0, 0.3], [1.0, 0.0]], 0.95)


def test_repeated_and_null_ids(spark, rows):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert rows(embed_dedup.near_duplicates(df)) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, None)]
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0

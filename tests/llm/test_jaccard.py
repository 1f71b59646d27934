"""Groups against all pairs of small sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recengine.llm import jaccard


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=3, percent=90):
    sets = [(i, shingles(t, k)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return sorted((i, len(s), find(i) if s else i) for i, s in sets)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([["new" + str(rng.randrange(99))], [], [w[k], "more"]])
    return " ".join(w)


def fixture(seed, group):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "The"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 30, 60, 61, 150, 400]))] for _ in range(25)]
    texts = [" ".join(b) for b in base] + [edited(rng, b, rng.randint(0, 1 + len(b) // 40)) for b in base for _ in range(2)]
    hot = [rng.choice(vocabulary) for _ in range(130)]
    texts += [edited(rng, hot, rng.randint(0, 4)) for _ in range(group)] + ["a b", "A  b", "a", "", None, " \t", "same same same same same", "same same same"]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize(("seed", "percent", "words"), [(1, 90, 3), (2, 80, 5), (3, 90, 3)])
def test_same_as_all_pairs(spark, seed, percent, words):
    rows = fixture(seed, 60)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, words=words, percent=percent).collect())
    assert got == brute(rows, words, percent)


def test_groups_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "MOST", 1)
    rng = random.Random(9)
    hot = [f"w{k}" for k in range(140)]
    rows = [(k, edited(rng, hot, rng.choice([1, 3, 6, 9]))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 1 < len({c for *_, c in want}) < 80
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()) == want


def test_nulls_repeats_and_empty_tables(spark):
    t = "one two three four five"
    docs = spark.createDataFrame([(None, t), (7, t), (7, t), (9, t.upper()), (None, "alone here now"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()), key=str)
    assert got == sorted([("None", 3, 7), ("7", 3, 7), ("7", 3, 7), ("9", 3, 7), ("None", 1, None), ("3", 0, 3), ("4", 0, 4)], key=str)
    assert jaccard.similar_groups(docs.limit(0)).collect() == []


def test_long_chains_become_one_group(spark):
    links = spark.createDataFrame([(k, k + 1) if k % 3 else (k + 1, k) for k in range(1, 60)], "a long, b long")
    assert {(r.node, r.label) for r in jaccard.components(links).collect()} == {(k, 1) for k in range(1, 61)}


@pytest.mark.parametrize("percent", [55, 70])
def test_lower_similarity_reaches_the_next_band(spark, percent):
    words = [f"w{k}" for k in range(400)]
    rows = [(k * 10 + j, " ".join([*words[: n + 2], *(f"x{k}_{j}_{i}" for i in range(j * n // 12))])) for k, n in enumerate((20, 44, 58, 61, 80, 97)) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, percent=percent).collect()) == brute(rows, 3, percent)


def test_hot_keys_over_several_runs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LISTED", 50)
    monkeypatch.setattr(jaccard, "RANGE", 300)
    rows = fixture(4, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for percent, words in ((90, 3), (80, 5)):
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, words=words, percent=percent).collect()) == brute(rows, words, percent)


def test_lists_survive_packing():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 1000):
        keys = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        nodes, lone = rng.integers(-(2**62), 2**62, n) if n > 2 else rng.integers(5, 9, n), rng.integers(0, 256, n)
        for got, want in zip(jaccard.unpacked(jaccard.packed(keys, nodes, lone)), (keys, nodes, lone), strict=True):
            assert (got == want).all()


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    sizes = [1, 3, 200, 256, 257, 600, 700, 1100, 2500]
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes]
    row, full = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    folds = [np.array(x.as_py(), np.int64).view(np.uint64) for x in jaccard.folded(row, full, np.array([len(x) for x in sets]))]
    assert [len(f) * 64 for f in folds] == [256, 256, 256, 256, 512, 1024, 1024, 2048, 4096]
    for f, x in zip(folds, sets, strict=True):
        for words in (4, len(f)):
            plain = np.zeros(words * 64, int)
            np.add.at(plain, (x & np.uint64(words * 64 - 1)).astype(int), 1)
            assert (np.packbits((plain & 1).astype(np.uint8)).view(np.uint64) == jaccard._halved(f, words)).all()


def test_long_texts_and_words_whose_polynomials_agree(spark):
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    long = " ".join(f"w{k % 70_000}" for k in range(300_000))
    rows = [(1, x), (2, y), (3, x + " b c d"), (4, y + " b c d"), (5, long), (6, long + " tail of it")]
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}


def test_blocks_are_compared_without_a_row_for_each_node_and_block(spark, monkeypatch):
    """200 nodes of one key in blocks of 4 are 50 blocks: the tables that are compared have 200 rows, not 200 for each of 50 blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    seen = []
    plain = jaccard.kept
    monkeypatch.setattr(jaccard, "kept", lambda df, rows=None: seen.append(df._jdf.queryExecution().analyzed().toString()) or plain(df, rows))
    docs = spark.createDataFrame([(k, " ".join([f"w{j}" for j in range(150)] + [f"x{k}_{j}" for j in range(5)])) for k in range(200)], "doc_id long, text string")
    crowd = plain(docs.select(F.lit(1).cast("long").alias("key"), F.col("doc_id").alias("node")))
    labels = plain(docs.where("doc_id < 0").select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label")))
    found = jaccard._unsettled(docs, crowd, labels, 3, 90, 1000)
    assert {(r.a, r.b) for r in found.collect()} == {(a, b) for a in range(200) for b in range(a + 1, 200)}
    assert not any("Generate explode(sequence(" in x for x in seen)

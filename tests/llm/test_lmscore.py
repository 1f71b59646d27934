"""Scores against the same model by plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recengine.llm import lmscore as lm
from recengine.llm import toxicity


def tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def fixture(n=120):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)] + ["É", "the", "The", "x" * 40]
    line = lambda: rng.choice([" ", "\n", "\t "]).join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 30)))
    same = line()
    return [(k, rng.choice([line(), line(), same])) for k in range(n)] + [(900, None), (901, ""), (None, "the w0"), (7, "twice the"), (7, "twice the")]


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_same_as_dictionaries(spark, shard):
    rows = fixture()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = lm.score(spark, docs, toxicity.remainder("doc_id", 7) != 2, shard=shard).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    uni, bi, tri = Counter(), Counter(), Counter()
    begun = 0
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            begun += 1
            uni.update(w)
            bi.update(zip(["<", *w], w))
            tri.update(zip(["<", *w], w, w[1:]))
    n, v = sum(uni.values()), len(uni)
    flat = lambda x: (uni[x] + 1) / (n + v + 1)
    context = lambda u: begun if u == "<" else uni[u]
    power = lambda c: int(math.log2(c)) + 1
    stand_in = lambda u, x: (bi[u, x] / context(u) * context(u) + 4 * flat(x)) / (context(u) + 4)
    two, three = {}, {}
    for k in range(1, lm.CLASSES):
        table = [sum(c * math.log((1 - w) * (c - 1) / (context(u) - 1) + w * flat(x)) for (u, x), c in bi.items() if context(u) > 1 and power(context(u)) == k) for w in lm.GRID]
        two[k] = lm.GRID[int(np.argmax(np.round(table, 3)))] if any(table) else 0.9
        table = [sum(c * math.log((1 - w) * (c - 1) / (bi[u, x] - 1) + w * stand_in(x, y)) for (u, x, y), c in tri.items() if bi[u, x] > 1 and power(bi[u, x]) == k) for w in lm.GRID]
        three[k] = lm.GRID[int(np.argmax(np.round(table, 3)))] if any(table) else 0.9

    def second(u, x):
        c = context(u)
        b = two[power(c)] if c else 1.0
        return (1 - b) * bi[u, x] / max(c, 1) + b * flat(x)

    def third(u, x, y):
        c = bi[u, x]
        a = three[power(c)] if c else 1.0
        return (1 - a) * tri[u, x, y] / max(c, 1) + a * second(x, y)

    vocabulary = [*uni, "never seen"]
    assert abs(sum(second("w0", y) for y in vocabulary) - 1) < 1e-9 and abs(sum(third("<", "w0", y) for y in vocabulary) - 1) < 1e-9
    want = []
    for i, t in rows:
        w = tokens(t)
        s = math.log10(second("<", w[0])) + sum(math.log10(third(*x)) for x in zip(["<", *w], w, w[1:]))
        want.append((str(i), held(i), len(w), sum(uni[x] > 0 for x in w), n, round(sum(math.log10(flat(x)) for x in w), 6), round(s, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(spark, docs, F.lit(False)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert lm.score(spark, docs.limit(0), F.lit(True)).collect() == []


def test_lists_survive_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        counts = rng.choice([0, 1, 2, 254, 255, 256, 70_000, 2**40], len(keys))
        k, c = lm.unpacked(lm.packed(keys, counts))
        assert (k == keys).all() and (c == counts).all()


def test_states_arcs_and_failure_arcs():
    """The carried state is the longest context that training has, at every step."""
    texts = ["a b c a b", "b c x", "a b d", "q q"]
    train = np.array([True, True, False, False])
    data, offsets = lm._text.buffer(pa.array(texts, pa.large_string()))
    shard = lm.Shard(data, offsets, train, 50)
    counts = shard.own()
    a = lm.Automaton(shard, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), 2)
    built = a.built(np.full((2, lm.CLASSES), 0.5))
    assert len(built["fail"]) == len(built["fail_to"]) == len(built["order"]) == 2 + len(counts[0]) + len(counts[1])
    assert len(built["exists"]) == len(built["log"]) == len(built["to"]) == sum(map(len, counts))
    # "a b" and then "d": no arc from the pair, none from the word, so two failure arcs and the word's own
    pair, word = int(shard.at[1][shard.begin[2] + 1]), int(shard.at[0][shard.begin[2] + 1])
    state = int(built["to"][len(counts[0]) + pair])
    assert built["order"][state] == 2 and built["fail_to"][state] == word + 1 and built["fail_to"][word + 1] == 0
    d = int(shard.at[0][shard.begin[2] + 2])
    assert counts[0][d] == 0 and built["to"][d] == 0
    # a text of words that training does not have goes through the state without history alone
    assert abs(a.traverse(np.full((2, lm.CLASSES), 0.5))[0][3] - (np.log10(0.5 * a.flat[shard.at[0][shard.begin[3]]]) + np.log10(a.flat[shard.at[0][shard.begin[3]]]) + np.log10(a.flat[shard.at[0][shard.begin[3] + 2]]))) < 1e-9


def test_held_out_text_is_likelier_under_longer_contexts(spark):
    rng = random.Random(1)
    phrases = [" ".join(f"w{rng.randrange(200)}" for _ in range(6)) for _ in range(40)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(phrases, k=8))) for k in range(300)], "doc_id long, text string")
    out = lm.score(spark, docs, toxicity.remainder("doc_id", 7) != 2).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b").first()
    assert out.s > out.b + 1


def test_words_whose_polynomials_agree_and_a_very_long_text(spark):
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    long = " ".join(f"w{k % 3000}" for k in range(400_000))
    docs = spark.createDataFrame([(1, x), (2, y), (3, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(spark, docs, F.col("doc_id") != 2).collect()}
    assert (got[1].n_known, got[2].n_known, got[3].n_tokens, got[3].n_known) == (2, 1, 400_001, 400_001)
    assert got[3].score > got[3].base_score

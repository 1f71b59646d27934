"""Against a brute-force search for every window in every text."""

import random
import re

from recengine.llm import decontaminate as dec

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench, size=13):
    windows = []
    for i, t in bench:
        w = WORD.findall(low(t))
        m = min(size, len(w))
        windows += [(i, w[j : j + m]) for j in range(len(w) - m + 1) if m]
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, items = set(), set()
        for i, x in windows:
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit |= set(range(j, j + len(x)))
                    items |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(3)
    vocabulary = ["a", "b", "Été", "C3", "x", "yy", "日本"]
    text = lambda n, v=vocabulary: "".join(rng.choice(v) + rng.choice([" ", "-", ". ", "\x00"]) for _ in range(n))
    bench = [(k, text(rng.choice([1, 3, 5, 9, 14, 30]), vocabulary + ["z", "q"])) for k in range(8)] + [(8, None), (9, ""), (10, "... --"), (3, "yy x yy x A"), (None, "b b b b b")]
    docs = [(k, text(rng.choice([0, 1, 4, 40, 200]))) for k in range(40)] + [(40, None), (41, "  "), (42, bench[4][1] + "!"), (42, bench[4][1] + "!"), (None, "b B b b b, b")]
    return docs, bench


def got(out):
    return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in out.collect()), key=str)


def test_same_as_brute_force(spark):
    docs, bench = fixture()
    d = spark.createDataFrame([(*x, "clash", 7) for x in docs], "doc_id long, text string, spans string, n_chars int").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    for words, block in ((13, 1 << 20), (4, 1 << 20), (4, 40)):
        out = dec.decontaminate(spark, d, b, words=words, block=block)
        assert out.columns[:3] == ["doc_id", "text", "n_chars"]
        assert got(out) == brute(docs, bench, words)


def test_spans_cover_the_hit_words(spark):
    d = spark.createDataFrame([(1, "é z a  b-c z a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "A b c"), (2, "c z")], "item_id long, text string")
    r = dec.decontaminate(spark, d, b).collect()[0]
    assert (r.spans, r.n_hit, r["items"]) == ("4:18", 7, ["1", "2"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert got(dec.decontaminate(spark, d, none)) == [(1, 2, 0, [])]
    assert got(dec.decontaminate(spark, d.limit(0), none)) == []


def test_words_that_share_a_sum_of_powers(spark):
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    docs, bench = [(1, f"{x} end"), (2, f"{y} end"), (3, f"{y} end {x} end")], [(1, f"{x} end")]
    out = dec.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert got(out) == brute(docs, bench) == [(1, 2, 2, ["1"]), (2, 2, 0, []), (3, 4, 2, ["1"])]


def test_words_that_share_a_hash_are_compared(monkeypatch):
    import numpy as np
    import pyarrow as pa

    windows = dec.Windows([("1", "alpha beta"), ("2", "beta gamma")], 2)
    real = dec._text.hashed
    monkeypatch.setattr(dec._text, "hashed", lambda d, s, e, seed=0: np.where(d[s] == ord("x"), windows.alphabet[0], real(d, s, e, seed)))
    shard = dec.Shard(*dec._text.buffer(pa.array(["xlpha beta", "xeta gamma alpha beta", "alpha xeta"], pa.large_string())))
    shard.search(windows)
    assert shard.columns()["n_hit"] == [0, 2, 0]


def test_very_long_text(spark):
    passage = " ".join(f"word{k}" for k in range(40))
    text = "filler text of many words, " * 150_000 + passage + " and more" * 100_000
    d = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    r = next(r for r in dec.decontaminate(spark, d, spark.createDataFrame([(5, passage)], "item_id long, text string")).collect() if r.doc_id == 1)
    assert (r.n_words, r.n_hit, r["items"]) == (950_040, 40, ["5"])

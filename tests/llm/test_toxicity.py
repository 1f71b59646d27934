"""Held-out accuracy on planted words, features against a plain loop, and odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from recengine.llm import _text, toxicity

BAD = ["gronk", "vilefoo", "Schlümp"]


def plain_ngrams(t):
    """The distinct n-grams of 3 to 6 characters."""
    low = re.sub(r"[\x20\x09-\x0D]", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {low[i : i + n] for n in (3, 4, 5, 6) for i in range(len(low) - n + 1)}


def plain_fit(rows):
    """Scaled logistic regression over the n-grams themselves (no buckets): plain gradient descent on the kernel form until it stands still."""
    sets = [plain_ngrams(t) for t, _ in rows]
    y = np.array([k for _, k in rows], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    toxic, other = Counter(g for s, k in zip(sets, y) if k for g in s), Counter(g for s, k in zip(sets, y) if not k for g in s)

    def scale(g):
        a, b = toxic[g], other[g]
        ratio = math.log((a + 1) / (n1 + 2)) - math.log((b + 1) / (n0 + 2))
        n, expected = n1 + n0, (a + b) * n1 / (n1 + n0)
        return (a - expected) / math.sqrt(max(expected * n0 / n * (1 - (a + b) / n), 0.25) + 1) * math.sqrt(abs(ratio))

    square = {g: scale(g) ** 2 for g in {*toxic, *other}}
    kernel = np.array([[sum(square[g] for g in s & t) for t in sets] for s in sets])
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    r, bias = np.zeros(len(y)), 0.0
    for _ in range(200):  # Newton steps on coefficients of rows: (K W + penalty) r = -gradient
        z = kernel @ r + bias
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        w = np.maximum(weight * p * (1 - p), 1e-12)
        off = weight * (p - y)
        a = np.zeros((len(y) + 1, len(y) + 1))
        a[:-1, :-1], a[:-1, -1], a[-1, :-1], a[-1, -1] = w[:, None] * kernel + 0.1 * np.eye(len(y)), w, w @ kernel, w.sum()
        step = np.linalg.solve(a, -np.append(off + 0.1 * r, off.sum()))
        r, bias = r + 0.5 * step[:-1], bias + 0.5 * step[-1]
        if abs(step).max() < 1e-7:
            break
    table = Counter()
    for s, x in zip(sets, r):
        for g in s:
            table[g] += x * square[g]
    return table, bias


def plain_score(model, t):
    return 1 / (1 + math.exp(-max(-500, min(500, model[1] + sum(model[0].get(g, 0.0) for g in plain_ngrams(t))))))


def test_same_as_a_plain_classifier(spark):
    rows = planted(150, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i % 3], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(spark, docs, toxicity.train(spark, docs, labels)).collect()}
    model = plain_fit([(t, k) for i, t, k in rows if i % 3])
    want = {i: plain_score(model, t) for i, t in [*((i, t) for i, t, _ in rows), (900, None), (901, "")]}
    assert max(abs(got[i] - want[i]) for i in want) < 0.02  # buckets that two n-grams share, and where the iterations stop


def planted(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéoñ") for _ in range(rng.randint(2, 8)))
    out = []
    for k in range(n):
        w = [word() for _ in range(rng.choice([3, 40, 200]))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ".", "s"]))
        out.append((k, " ".join(w), int(toxic)))
    return out


def test_ngrams_are_those_of_each_text():
    texts = ["abcdefg", "", "Éa\tb", "xy", "日本語テキスト"]
    data, offsets = _text.buffer(pa.array(texts, pa.large_string()))
    alone = []
    for t in texts:
        d, o = _text.buffer(pa.array([t], pa.large_string()))
        alone.append(np.frombuffer(toxicity.present(d, o)[0], "<i4").tolist())
    together = [np.frombuffer(b, "<i4").tolist() for b in toxicity.present(data, offsets)]
    assert together == alone
    for t, found in zip(texts, together, strict=True):
        assert len(found) == len({t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)})


def test_held_out_accuracy(spark):
    rows = planted(900, 1)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, k, 1) for i, _, k in rows] + [(5, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(spark, docs, labels.where(toxicity.remainder("doc_id", 5) != 0))
    out = toxicity.score(spark, docs, model).where(toxicity.remainder("doc_id", 5) == 0).collect()
    truth = {i: k for i, _, k in rows}
    assert len(out) > 100 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "ab"), (2, "x" * 300_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(spark, docs, toxicity.train(spark, docs, none))
    assert {(r.score, r.predicted) for r in out.collect()} == {(0.25, 0)}
    assert toxicity.score(spark, docs.limit(0), toxicity.train(spark, docs.limit(0), none)).collect() == []


def test_wide_vocabulary_in_several_scripts():
    rng = random.Random(3)
    scripts = ["abcdefghijklmnoprstuvz", "абвгдежзиклмнопрст", "áéíóúñüabcdelmnors", "αβγδεζηθικλμνοπρστ"]
    word = lambda a, lo, hi: "".join(rng.choice(a) for _ in range(rng.randint(lo, hi)))
    plain, bad = [[word(a, 4, 9) for _ in range(1500)] for a in scripts], [[word(a, 6, 10) for _ in range(100)] for a in scripts]

    def text(toxic):
        k = rng.choices(range(4), [6, 2, 1, 1])[0]
        words = rng.choices(plain[k], [1 / (j + 1) for j in range(1500)], k=rng.choice([30, 120]))
        for b in rng.choices(bad[k], [1 / (j + 5) for j in range(100)], k=3 * toxic):
            words.insert(rng.randrange(len(words)), b)
        return " ".join(words)

    def rows(n):
        texts, out = [text(k % 2) for k in range(n)], []
        for k in range(0, n, 50):
            out += toxicity.present(*_text.buffer(pa.array(texts[k : k + 50], pa.large_string())))
        return [(k, b, k % 2) for k, b in enumerate(out)]

    fitted = rows(2 * toxicity.SAMPLE)
    weights, bias = toxicity.fit(iter(fitted))
    lean = np.zeros(1 << toxicity.BITS, int)
    for _, b, label in fitted:
        lean[np.frombuffer(b, "<i4")] += 2 * label - 1
    assert np.count_nonzero(lean) > 100_000 and weights[lean != 0].all()
    held = rows(600)
    got = np.array([weights[np.frombuffer(b, "<i4")].sum() + bias >= 0 for _, b, _ in held])
    label = np.array([k for *_, k in held]) == 1
    assert got[label].mean() >= 0.88 and got[~label].mean() <= 0.05

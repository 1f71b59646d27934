"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios (NB-SVM style).

Features: which n-grams of 3 to 6 characters a text has (A-Z lower-cased, white space as a blank), hashed into ``2 ** BITS``
buckets. A bucket's value is the geometric mean of its log-count ratio between toxic and other training texts and of how many
standard deviations its count is off; a logistic regression with an L2 penalty is fitted on the scaled features. Every bucket
that training texts have gets a weight, unless toxic and other ones have it equally often. The table of weights (8 MB) is sent to the workers, and every whole text is scored
where it is read.

Fitted on a bounded sample of labelled rows: ``SAMPLE`` of either label, the first by a hash of the id. Their buckets lie in a
file of the driver, from which the fit takes a row at a time.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.llm import _text

ORDERS = (3, 4, 5, 6)
BITS = 21
SAMPLE = 1500
#: Bytes of texts whose n-grams are held at once; a longer text is held alone.
CHUNK = 1 << 18
_K = _text.mixed(np.arange(1, 12, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (row, bucket) of every n-gram; n-grams do not reach over a text's end."""
    low = _text.LOWER[data]
    low[~_text.SOLID[low]] = 32
    chars = np.frombuffer(low.tobytes().decode().encode("utf-32-le"), np.uint32)
    ends = _text.points(data)[offsets]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(ends))
    wide = chars.astype(np.uint64)
    total = None
    for n in range(1, ORDERS[-1] + 1):
        if len(chars) < n:
            return
        part = wide[n - 1 :] * _K[n]
        total = part if total is None else total[: len(part)] + part
        if n in ORDERS:
            whole = row[n - 1 :] == row[: len(row) - n + 1]
            bucket = ((total * _K[0] ^ (total >> np.uint64(29))) * _K[n]) >> np.uint64(64 - BITS)
            yield row[: len(whole)][whole], bucket[whole].astype(np.int32)


def present(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The distinct buckets of each text, as little-endian 32-bit integers."""
    n = len(offsets) - 1
    found = [r.astype(np.int64) << BITS | b for r, b in ngrams(data, offsets)]
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    cut = np.searchsorted(pairs, np.arange(n + 1) << BITS)
    low = (pairs & ((1 << BITS) - 1)).astype("<i4")
    return [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fit(rows: Iterable[tuple[int, bytes, int]], *, rounds: int = 60, penalty: float = 0.1, history: int = 6) -> tuple[np.ndarray, float]:
    """The weight of every bucket (scale times coefficient) and the bias, from (id, distinct buckets, label).

    Coefficients are sums of the rows' features, and so is every step of L-BFGS from 0: a vector is held as a number for each row
    (and its products with all rows), not for each bucket.
    """
    size = 1 << BITS
    counts = {0: np.zeros(size, np.float32), 1: np.zeros(size, np.float32)}
    with tempfile.TemporaryFile() as file:
        index, end = [], 0
        for i, buckets, label in rows:
            counts[label][np.frombuffer(buckets, "<i4")] += 1
            index.append((i, end, end + len(buckets) // 4, label))
            end += file.write(buckets) // 4
        file.flush()
        index.sort()
        y = np.array([label for *_, label in index], float)
        n1, n0 = float(y.sum()), float(len(y) - y.sum())
        if not n1 or not n0:
            prior = (n1 + 1) / (n1 + n0 + 4)
            return np.zeros(size, np.float32), math.log(prior / (1 - prior))
        found = np.asarray(np.memmap(file, "<i4", "r")) if end else np.zeros(0, np.int32)
        square = _scale(counts[1], counts[0], n1, n0)
        square *= square

        def summed(by_row: np.ndarray) -> np.ndarray:
            out = np.zeros(size)
            for (_, a, b, _), x in zip(index, by_row, strict=True):
                out[found[a:b]] += x
            return out * square

        def products(by_row: np.ndarray) -> np.ndarray:
            table = summed(by_row)
            return np.array([table[found[a:b]].sum() for _, a, b, _ in index])

        balance = np.where(y > 0, 0.5 / n1, 0.5 / n0)

        def loss(at: _Point) -> float:
            z = at.z + at.bias
            return float(balance @ np.where(y > 0, np.logaddexp(0, -z), np.logaddexp(0, z)) + penalty / 2 * (at.rows @ at.z))

        def gradient(at: _Point) -> _Point:
            off = (1 / (1 + np.exp(-np.clip(at.z + at.bias, -500, 500))) - y) * balance
            return _Point(off + penalty * at.rows, products(off) + penalty * at.z, off.sum())

        at = _Point(np.zeros(len(y)), np.zeros(len(y)), 0.0)
        f, g, steps = loss(at), gradient(at), []
        for _ in range(rounds):
            way, used = g, []
            for s, c in reversed(steps):
                used.append((way @ s) / (s @ c))
                way = way.plus(c, -used[-1])
            s, c = steps[-1] if steps else (g, g)
            way = way.plus(way, (s @ c) / (c @ c) - 1 if steps else 1 / max(1e-12, math.sqrt(g @ g)) - 1)
            for (s, c), u in zip(steps, reversed(used), strict=True):
                way = way.plus(s, u - (way @ c) / (s @ c))
            size_of, slope = 1.0, way @ g
            while (new := loss(at.plus(way, -size_of))) > f - 1e-4 * size_of * slope and size_of > 1e-6:
                size_of /= 2
            if f - new < 1e-5 * f:
                break
            after = at.plus(way, -size_of)
            turned = gradient(after)
            s, c = after.plus(at, -1), turned.plus(g, -1)
            steps = [*steps, (s, c)][-history:] if s @ c > 1e-14 else steps
            at, f, g = after, new, turned
        return summed(at.rows).astype(np.float32), float(at.bias)


class _Point:
    """A vector of coefficients as a sum of the rows' features, its products with every row, and a bias."""

    def __init__(self, rows: np.ndarray, z: np.ndarray, bias: float):
        self.rows, self.z, self.bias = rows, z, bias

    def __matmul__(self, other: _Point) -> float:
        return float(self.rows @ other.z + self.bias * other.bias)

    def plus(self, other: _Point, times: float) -> _Point:
        return _Point(self.rows + times * other.rows, self.z + times * other.z, self.bias + times * other.bias)


def _scale(toxic: np.ndarray, other: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Each bucket's scale from the numbers of toxic and other texts that have it; 0 only where ratio or deviation is 0."""
    ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((other + 1) / (n0 + 2))
    n, seen = n1 + n0, toxic + other
    expected = seen * (n1 / n)
    return ((toxic - expected) / np.sqrt(np.maximum(expected * (n0 / n) * (1 - seen / n), 0.25) + 1) * np.sqrt(np.abs(ratio))).astype(float)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fits on ``sample`` rows of either label at most; ``labels`` (doc_id, toxic) must hold training rows only. Null labels are
    passed over; of an id's labels 1 wins. Of rows that share an id, the one with the greatest text is learned from, so that the bound holds.
    Only the sample's texts reach the driver, as hashed n-grams, 1/16 of them at a time."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("_label"))
    order = F.xxhash64(F.lit(7), "doc_id"), F.col("doc_id")
    some = known.where("_label = 1").orderBy(*order).limit(sample).unionByName(known.where("_label = 0").orderBy(*order).limit(sample))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "_label").agg(F.max("text").alias("text"))
    rows = _text.appended(texts.repartition(16, "doc_id"), {"_buckets": "binary"}, lambda data, offsets: {"_buckets": present(data, offsets)}, stored=True, chunk=CHUNK)
    return fit((r["doc_id"], bytes(r["_buckets"]), r["_label"]) for r in rows.toLocalIterator())


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5). Null and empty texts have no n-gram and get the bias's score."""
    sent = spark.sparkContext.broadcast(model)

    def work(data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
        (table, bias), n = sent.value, len(offsets) - 1
        found = [(np.searchsorted(row, np.arange(n + 1)), bucket) for row, bucket in ngrams(data, offsets)]
        z = np.full(n, bias)
        last = np.empty(1 << BITS, np.int32)
        for k in range(n):
            if buckets := [b[cut[k] : cut[k + 1]] for cut, b in found]:
                own = np.concatenate(buckets)
                place = np.arange(len(own), dtype=np.int32)
                last[own] = place  # of equal buckets one counts
                z[k] += table[own[last[own] == place]].sum(dtype=float)
        s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return _text.appended(docs, {"score": "double", "predicted": "int"}, work, chunk=CHUNK)


def remainder(doc_id: object, of: int) -> object:
    """crc32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of



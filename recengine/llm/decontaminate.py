"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of about ``SHARD`` bytes. Its words become symbols of the benchmark's alphabet; words
that no benchmark text has, and document ends, part the shard into stretches, and a stretch shorter than the shortest
window can hold no occurrence. The rest is suffix-sorted (prefix doubling on the suffixes that still tie), its
Burrows-Wheeler transform is kept in a wavelet matrix, and all windows of the benchmark are searched backwards together:
each step narrows their row ranges by two ranks. Occurrences are located by walking back to a sampled suffix position, and
the spans they cover are merged per document.

Shards are indexed where their rows are read: no shuffle. The benchmark is a set of queries that may have any size: tasks write
its windows to the shared folder in blocks of about ``BLOCK`` bytes of text, and a task that reads documents takes one block after
another, so that its memory is bounded by a few shards and one block. Words are found by hashes and compared byte by byte.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.llm import _text
from recengine.llm.shared import folder, get, kept, put

WORDS = 13
SHARD = 2 << 20
BLOCK = 4 << 20
SAMPLE = 8


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo[i]..hi[i]-1, and i of each."""
    size = hi - lo
    who = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + lo[who], who


def suffixes(x: np.ndarray, marks: int) -> np.ndarray:
    """The suffix array of x, in which 0 occurs ``marks`` times, ends x, and counts as a smaller symbol at each earlier place."""
    n = len(x)
    key = np.where(x == 0, np.cumsum(x == 0) - 1, x.astype(np.int64) + marks)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    size = np.diff(np.r_[first, n])
    active = order[np.repeat(size > 1, size)]
    step = 1
    while len(active):
        key = rank[active] * n + rank[np.minimum(active + step, n - 1)]
        o = np.argsort(key, kind="stable")
        active, key = active[o], key[o]
        old = rank[active]
        begins = np.r_[True, np.diff(key) > 0]
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.r_[True, np.diff(old) > 0], at, 0))
        place = np.maximum.accumulate(np.where(begins, at, 0))
        rank[active] = old + place - group
        edge = np.flatnonzero(begins)
        size = np.diff(np.r_[edge, len(active)])
        active = active[np.repeat(size > 1, size)]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Wavelet:
    """Symbols in a wavelet matrix; ``rank`` and access for many places at once."""

    def __init__(self, x: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.n, self.zeros, self.none = len(x), [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (x >> level) & 1
            before = np.zeros(len(x) + 1, np.int32)
            np.cumsum(bit == 0, out=before[1:])
            self.zeros.append(before)
            self.none.append(int(before[-1]))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            zero = self.zeros[k][place]
            place = np.where((symbol >> level) & 1, self.none[k] + place - zero, zero)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many of the first ``place`` symbols equal ``symbol``."""
        return self._down(symbol, place) - self.start[symbol]

    def symbol(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.int64)
        for k in range(self.bits):
            zero = self.zeros[k][place]
            bit = (self.zeros[k][place + 1] == zero).astype(np.int64)
            place = np.where(bit, self.none[k] + place - zero, zero)
            out = out * 2 + bit
        return out


class Index:
    """FM-index of x (symbols 1..symbols-1; 0 parts stretches and ends x)."""

    def __init__(self, x: np.ndarray, symbols: int):
        marks = int((x == 0).sum())
        suffix = suffixes(x, marks)
        last = x[suffix - 1]
        self.wavelet = Wavelet(last, symbols)
        self.first = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(x, minlength=symbols), out=self.first[1:])
        kept = (suffix % SAMPLE == 0) | (last == 0)
        self.sampled = kept
        self.at = np.cumsum(kept) - 1
        self.places = suffix[kept]

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns, one a row of ``words``; empty where there is no occurrence."""
        lo, hi = self.first[words[:, -1]].copy(), self.first[words[:, -1] + 1].copy()
        alive = np.flatnonzero(lo < hi)
        for j in range(words.shape[1] - 2, -1, -1):
            c = words[alive, j]
            lo[alive] = self.first[c] + self.wavelet.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.wavelet.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in ``rows``: at most SAMPLE - 1 steps back to a sampled one."""
        out, steps, todo, row = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(todo):
            done = self.sampled[row]
            out[todo[done]] = self.places[self.at[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            c = self.wavelet.symbol(row)
            row = self.first[c] + self.wavelet.rank(c, row)
            steps += 1
        return out


class Windows:
    """The windows of a block of benchmark texts, each distinct one once, with the items that have it."""

    def __init__(self, items: list[tuple[str | None, str | None]], words: int):
        data, offsets = _text.buffer(pa.array([t or "" for _, t in items], pa.large_string()))
        self.data = _text.LOWER[data]
        starts, ends, rows = _text.cut(self.data, offsets, _text.ALNUM)
        for self.seed in range(64):  # until no two different words share a hash
            self.alphabet, first, symbol = _text.distinct(_text.hashed(self.data, starts, ends, self.seed))
            self.at, self.size = starts[first], (ends - starts)[first]
            if (self.size[symbol] == ends - starts).all() and _text.same(self.data, starts, self.data, self.at[symbol], ends - starts).all():
                break
        symbol = (symbol + 1).astype(np.int32)
        self.names = sorted({i for i, _ in items if i is not None})
        place = {x: k + 1 for k, x in enumerate(self.names)}
        number = np.array([place.get(i, 0) for i, _ in items], np.int64)
        edge = np.searchsorted(rows, np.arange(len(items) + 1))
        length = np.minimum(np.diff(edge), words)
        #: By length: the distinct windows, and per window its items as a slice of a flat array.
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == size)
            begin, who = _ranges(edge[own], edge[own + 1] - size + 1)
            distinct, which = np.unique(symbol[begin[:, None] + np.arange(size)], axis=0, return_inverse=True)
            pair = np.unique(which.ravel() * (len(self.names) + 1) + number[own[who]])
            pair = pair[pair % (len(self.names) + 1) > 0]
            cut = np.searchsorted(pair // (len(self.names) + 1), np.arange(len(distinct) + 1))
            self.by[size] = distinct, cut, pair % (len(self.names) + 1) - 1
        self.shortest = min(self.by, default=0)

    def symbols(self, shard: Shard) -> np.ndarray:
        """The symbol of each word of a shard, 0 for words that no text of the block has."""
        hashes = _text.hashed(shard.low, shard.starts, shard.ends, self.seed)
        at = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        maybe = np.flatnonzero((self.alphabet[at] == hashes) & (self.size[at] == shard.ends - shard.starts))
        maybe = maybe[_text.same(shard.low, shard.starts[maybe], self.data, self.at[at[maybe]], self.size[at[maybe]])]
        out = np.zeros(len(hashes), np.int64)
        out[maybe] = at[maybe] + 1
        return out


class Shard:
    """The words of a run of texts, and which of them the windows of all blocks so far hit."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.low = data, offsets, _text.LOWER[data]
        self.starts, self.ends, self.rows = _text.cut(self.low, offsets, _text.ALNUM)
        self.hit = np.zeros(len(self.starts), bool)
        self.items: dict[int, set[str]] = {}

    def search(self, windows: Windows) -> None:
        if not windows.by or not len(self.starts):
            return
        rows, symbol = self.rows, windows.symbols(self)
        known = symbol > 0
        new = known & np.r_[True, ~known[:-1] | (rows[1:] != rows[:-1])]
        stretch = np.cumsum(new) - 1
        word = np.flatnonzero(known)
        long = np.bincount(stretch[word], minlength=1)[stretch[word]] >= windows.shortest
        word = word[long]
        if not len(word):
            return
        ends_here = np.r_[stretch[word][1:] != stretch[word][:-1], True]
        place = np.arange(len(word)) + np.cumsum(ends_here) - ends_here
        x = np.zeros(len(word) + int(ends_here.sum()), np.int64)
        origin = np.zeros(len(x), np.int64)
        x[place], origin[place] = symbol[word], word
        index = Index(x, len(windows.alphabet) + 1)
        cover = np.zeros(len(self.starts) + 1, np.int64)
        for size, (patterns, cut, items) in windows.by.items():
            lo, hi = index.search(patterns)
            found, who = _ranges(lo, hi)
            if not len(found):
                continue
            begin = origin[index.locate(found)]
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + size, -1)
            pair = np.unique(rows[begin] * len(patterns) + who)
            at, which = _ranges(cut[pair % len(patterns)], cut[pair % len(patterns) + 1])
            for r, item in zip((pair // len(patterns))[which].tolist(), items[at].tolist(), strict=True):
                self.items.setdefault(r, set()).add(windows.names[item])
        self.hit |= np.cumsum(cover[:-1]) > 0

    def columns(self) -> dict[str, list]:
        """Words, hit words, items and merged spans (code points) of each text."""
        n, rows, hit = len(self.offsets) - 1, self.rows, self.hit
        spans: dict[int, list[str]] = {}
        if hit.any():
            at = _text.points(self.data)
            first = hit & np.r_[True, ~hit[:-1] | (rows[1:] != rows[:-1])]
            last = hit & np.r_[~hit[1:] | (rows[1:] != rows[:-1]), True]
            for r, a, b in zip(rows[first].tolist(), self.starts[first], self.ends[last], strict=True):
                spans.setdefault(r, []).append(f"{at[a] - at[self.offsets[r]]}:{at[b] - at[self.offsets[r]]}")
        return {
            "n_words": _text.counted(rows, n).tolist(), "n_hit": _text.counted(rows[hit], n).tolist(),
            "items": [sorted(self.items.get(k, ())) for k in range(n)], "spans": [",".join(spans.get(k, ())) for k in range(n)],
        }


def _blocks(spark: SparkSession, benchmark: DataFrame, words: int, limit: int) -> list[str]:
    """Writes the windows of the benchmark's rows to the shared folder, in blocks of about ``limit`` bytes of text; their paths.

    The tasks that read the rows make the blocks; the driver gets a path for each of them.
    """
    where = f"{folder(spark)}/recengine/windows-{uuid.uuid4().hex}"
    rows = kept(benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, size, number = TaskContext.get().partitionId(), [], 0, 0

        def done() -> pa.RecordBatch:
            put(path := f"{where}/{part}-{number}", pickle.dumps(Windows(block, words), protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        for batch in batches:
            for row in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                block.append(row)
                size += len(row[1] or "")
                if size >= limit:
                    yield done()
                    block, size, number = [], 0, number + 1
        if block:
            yield done()

    return sorted(r["path"] for r in rows.coalesce(max(1, total // (8 * limit))).mapInArrow(_text.trimmed(task), "path string").collect())


def _windows(path: str) -> Windows:
    """A block's windows; a worker keeps those it used last."""
    if not _LAST or _LAST[0] != path:
        _LAST[:] = path, pickle.loads(get(path))
    return _LAST[1]


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, words: int = WORDS, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids of the items with occurring windows), spans ("start:end", code points).

    A null or empty text has no words: 0, 0, [], "". A null or empty item has no window; an item without id hits but is not
    listed; rows of one item_id count as one item. Repeated documents are each judged. A text longer than a shard is a shard of its own.
    Columns of ``docs`` that have a result's name give way. An empty benchmark hits nothing.
    """
    paths = _blocks(spark, benchmark, words, block)

    def work(data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
        parts = [Shard(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in _text.runs(offsets, shard)]
        for path in paths:
            windows = _windows(path)
            for p in parts:
                p.search(windows)
        out: dict[str, list] = {"n_words": [], "n_hit": [], "items": [], "spans": []}
        for p in parts:
            for c, x in p.columns().items():
                out[c] += x
        return out

    columns = {"n_words": "long", "n_hit": "long", "items": "array<string>", "spans": "string"}
    # with several blocks, some shards share the reading of each
    return _text.appended(docs, columns, work, chunk=shard if len(paths) < 2 else 8 * shard)


#: The path of a worker's latest block and its windows.
_LAST: list = []


def contaminated(share: int = 20) -> object:
    """The rule: at least one of ``share`` words is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))

"""N-gram Jaccard join by parity sketches, and the groups that its links make.

A text's distinct word shingles are hashed; a shingle flips one bit of the text's sketch, so the Hamming distance of two
sketches is at most the size of their symmetric difference. Two sets of a and b shingles with similarity s or more differ in at
most (a + b)(1 - s) / (1 + s) of them, and so a sketch of one 64-bit word more than that has a word to which none of these belongs:
the pair has the same shingles there. A word's key is the XOR of its shingles' full hashes. Keys are joined within bands of
sizes (a text near a band's upper end also stands in the next). Pairs that join go on if the Hamming distance of their sketches, folded
to FOLD bits, allows the similarity, and are then verified on the full sets.

Sketches have more words than that, so that a linked pair agrees in several: as many as are spare, and one. So each text may leave
as many words out as it has spare ones, if all texts leave out by one order of keys (as in prefix filtering): empty words first, which say
nothing, and then the keys that most texts have.

Equal sets are one node, joined no further. A map task lists its nodes' keys sorted and packed, a list for each range of keys, and the
lists of a range meet in one task, which tells how many nodes a key has; of nodes of one map task with the same key only the first is
listed, and the others follow the key by a join that Spark can split. Keys that two nodes share give that pair. A key with more
nodes ties them to its first one. Nodes that verified links have put into one component are settled. What a key still holds of different
components is compared in blocks: a task gets two blocks of a key's nodes, holds their folded sketches against each other bit-parallel, and gives
for each node the first few partners of other components that pass. They are verified on the sets; if there were more, what the new links
have not joined is looked at again with more partners. So no link between components is missed, and a group of copies never
becomes all its pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.llm import _text
from recengine.llm.shared import bounded, folder, get, kept, put, written

WORDS, PERCENT = 3, 90
#: The least ratio of one band's sizes to those of the band before; 100 / percent if that is more, so that linked sets are in one band or two neighbouring ones.
RATIO = 1.3
#: Keys that a map task holds before it lists them; shingles whose keys are one range of keys, at least (more with the square root
#: of all shingles, so that lists stay long) and at most.
LISTED, RANGE, WIDEST = 1 << 18, 1 << 18, 1 << 23
#: One word of a sketch is spare for so many that are needed.
SPARE = 4
#: The fewest bits of a folded sketch, and texts for which bits are counted at once.
FOLD, ROWS_AT_ONCE = 256, 4000
#: Comparing a pair's sketches or sets is worth as much of a task as writing so many rows.
PER = 64
#: A block of a key's nodes that is compared: about so many.
BLOCK = 512
#: Partners of a node in another block that are verified in a first round.
MOST = 64
_K = _text.mixed(np.arange(1, 40, dtype=np.uint64)) | np.uint64(1)
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of a run of texts, in order of both."""
    low = _text.LOWER[data]
    starts, ends, rows = _text.cut(low, offsets, _text.SOLID)
    h = _text.hashed(low, starts, ends)
    size = np.bincount(rows, minlength=len(offsets) - 1)
    short = (size > 0) & (size < words)
    whole = np.zeros(0, _U)
    if short.any():  # all words of a text with fewer, as one
        first = np.cumsum(size) - size
        whole = size[short].astype(_U) * _K[0]
        for k in range(words - 1):
            has = size[short] > k
            whole[has] += h[first[short][has] + k] * _K[k + 1]
    n = max(0, len(h) - words + 1)
    total = np.zeros(n, _U)
    for k in range(words):
        total += h[k : k + n] * _K[k + 1]
    inside = rows[:n] == rows[words - 1 : words - 1 + n]
    row = np.concatenate([rows[:n][inside], np.flatnonzero(short)])
    full = _text.mixed(np.concatenate([total[inside], whole]))
    order = np.argsort(row.astype(_U) << _U(40) | full >> _U(24), kind="stable")
    row, full = row[order], full[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (full[1:] != full[:-1])] if len(row) else np.zeros(0, bool)
    return row[new], full[new]


def _schema(columns: str) -> T.StructType:
    return T._parse_datatype_string(columns)


class Bands:
    """Sizes in bands; a band's number of sketch words, one more than the differences of a linked pair in it."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("a similarity of 50 to 100 percent")
        self.percent, self.low, self.ratio = percent, [1], max(RATIO, 100 / percent)

    def reach(self, size: int) -> None:
        while self.low[-1] <= size * 2 * 100 // self.percent + 2:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * self.ratio)))

    def of(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bands of the sizes; of all bands the words of a sketch and how many of them are spare; whether a linked text may be in the next band."""
        self.reach(int(size.max(initial=1)))
        low = np.array(self.low)
        band = np.searchsorted(low, size, "right") - 1
        most = low[1:] - 1
        needed = 2 * most * (100 - self.percent) // (100 + self.percent) + 1
        spare = np.where(needed < 3, 0, 1 + needed // SPARE)
        return band, needed + spare, spare, size * 100 // self.percent >= low[np.minimum(band + 1, len(low) - 1)]


class Layout:
    """Where the shingles of the texts in ``take`` fall in sketches of their ``band``: words laid end to end, texts in order."""

    def __init__(self, row: np.ndarray, full: np.ndarray, band: np.ndarray, parts: np.ndarray, take: np.ndarray):
        self.take, self.band = take, band
        self.own = np.where(take, parts[band], 0)
        base = np.cumsum(self.own) - self.own
        mine = take[row]
        self.row, self.full = row[mine], full[mine]
        part = ((self.full >> _U(32)) * self.own[self.row].astype(_U) >> _U(32)).astype(np.int64) + base[self.row]
        self.begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        self.word, self.base = part[self.begin], base

    def _xor(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(int(self.own.sum()), _U)
        if len(self.begin):
            out[self.word] = np.bitwise_xor.reduceat(values, self.begin)
        return out

    def keys(self, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, key): a key for each word that has shingles; empty words too if the text has more of them than are spare. The
        last bit of a key is that of its band, the one before tells an empty word's. And for each text, how many more of its keys it may leave out."""
        full = self._xor(self.full)
        of = np.repeat(np.arange(len(self.own)), self.own)
        empty = np.ones(len(full), bool)
        empty[self.word] = False
        blank = np.bincount(of[empty], minlength=len(self.own))
        given = ~empty | (blank > spare[self.band])[of]
        place = (np.arange(len(full)) - self.base[of]).astype(_U) | self.band[of].astype(_U) << _U(48)
        keys = _text.mixed(full ^ _text.mixed(place + _U(1))) & ~_U(3) | empty.astype(_U) << _U(1) | (self.band[of] & 1).astype(_U)
        return of[given], keys[given], np.where(blank > spare[self.band], spare[self.band], spare[self.band] - blank)


def _layouts(row: np.ndarray, full: np.ndarray, n: int, bands: Bands) -> tuple[np.ndarray, np.ndarray, Layout, Layout, np.ndarray]:
    size = _text.counted(row, n)
    band, parts, spare, next_too = bands.of(np.maximum(size, 1))
    after = np.minimum(band + 1, len(parts) - 1)
    return size, band, Layout(row, full, band, parts, size > 0), Layout(row, full, after, parts, (size > 0) & next_too), spare


def _digested(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and 128 bits that tell sets apart."""

    def work(data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
        n = len(offsets) - 1
        row, full = shingles(data, offsets, words)
        size = _text.counted(row, n)
        one, two = np.zeros(n, _U), np.zeros(n, _U)
        if len(row):
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            one[size > 0], two[size > 0] = np.add.reduceat(full, begin), np.bitwise_xor.reduceat(_text.mixed(full + _U(99)), begin)
        return {"n_shingles": size, "_one": one.view(np.int64), "_two": two.view(np.int64)}

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return _text.appended(slim, {"n_shingles": "long", "_one": "long", "_two": "long"}, work, stored=True)


def _narrow(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8")[:, 0]


def packed(keys: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys in ascending order with their nodes and counts (at most 255 is told): differences, in as many bytes as the largest needs."""
    step, low = np.diff(keys, prepend=keys[:1]), int(nodes.min())
    above = nodes.astype(_U) - np.int64(low).astype(_U)
    w, v = (max(1, (int(x.max()).bit_length() + 7) // 8) for x in (step, above))
    return np.array([len(keys), keys[0], w, np.int64(low).astype(_U), v], "<u8").tobytes() + _narrow(step, w) + _narrow(above, v) + np.minimum(counts, 255).astype(np.uint8).tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, first, w, low, v = np.frombuffer(raw, "<u8", 5)
    n, w, v = int(n), int(w), int(v)
    keys = np.cumsum(_wide(raw, 40, n, w), dtype=_U) + first
    nodes = (_wide(raw, 40 + n * w, n, v) + low).view(np.int64)
    return keys, nodes, np.frombuffer(raw, np.uint8, n, 40 + n * (w + v)).astype(np.int64)


def _ranges(number: int) -> np.ndarray:
    """Where each of ``number`` equal ranges of keys begins."""
    return np.array([(k << 64) // number for k in range(number)], _U)


def _lists(docs: DataFrame, nodes: DataFrame, words: int, percent: int, number: int) -> DataFrame:
    """Rows (range, list) of the keys of ``nodes``: for each run of nodes and each range a list of keys with the first of the run's nodes that
    have it and how many do. The others are in lists of range -1; lists of range -2 have nodes and how many keys they may leave out."""
    bands = Bands(percent)

    def listed(keys: list[np.ndarray], owners: list[np.ndarray], allowed: list[np.ndarray]) -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[new], node[new]
        first = np.r_[True, key[1:] != key[:-1]]
        count = np.diff(np.r_[np.flatnonzero(first), len(key)])
        rest = ~first
        who, may = np.concatenate(allowed, axis=1)
        order = np.argsort(who.view(_U))
        out = [(-2, packed(who[order].view(_U), may[order], np.zeros(len(who))))]
        out += [(-1, packed(key[rest], node[rest], np.zeros(int(rest.sum()))))] if rest.any() else []
        key, node = key[first], node[first]
        cut = np.r_[np.searchsorted(key, _ranges(number)), len(key)]
        out += [(k, packed(key[a:b], node[a:b], count[a:b])) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["range", "list"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, allowed, held = [], [], [], 0
        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            data, offsets = _text.buffer(batch.column("text"))
            for lo, hi in _text.runs(offsets):
                row, full = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                _, band, here, after, spare = _layouts(row, full, hi - lo, bands)
                may = np.zeros((2, hi - lo), np.int64)
                for k, layout in enumerate((here, after)):
                    of, key, left = layout.keys(spare)
                    keys.append(key)
                    owners.append(node[lo:hi][of])
                    may[(band + k) & 1, np.arange(hi - lo)] = left
                    held += len(key)
                allowed.append(np.stack([node[lo:hi], may[0] << 32 | may[1]]))
                if held > LISTED:
                    yield listed(keys, owners, allowed)
                    keys, owners, allowed, held = [], [], [], 0
        if held:
            yield listed(keys, owners, allowed)

    some = _of(nodes, docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")), "node")
    return written(some, _text.trimmed(task), _schema("range int, list binary"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists in order of their ranges: for each key of several nodes the runs' first nodes and how many nodes have it, and a row without node
    if a run has further ones. One range is held at a time."""
    now, held = None, []
    for batch in batches:
        for at, raw in zip(batch.column("range").to_pylist(), batch.column("list"), strict=True):
            if at != now and held:
                yield from _counted(held)
                held = []
            now = at
            held.append(unpacked(raw.as_py()))
    if held:
        yield from _counted(held)


def _counted(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    keys, nodes, counts = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.argsort(keys)
    keys, nodes, counts = keys[order], nodes[order], counts[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[begin, len(keys)])
    total = np.add.reduceat(counts, begin)
    some = np.repeat(total > 1, size)
    more = np.flatnonzero(total > size)
    key = np.concatenate([keys[some], keys[begin[more]]]).view(np.int64)
    node = pa.array(np.concatenate([nodes[some], np.zeros(len(more), np.int64)]), pa.int64(), mask=np.r_[np.zeros(int(some.sum()), bool), np.ones(len(more), bool)])
    freq = np.concatenate([np.repeat(total, size)[some], total[more]])
    for k in range(0, len(key), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 10_000]), node.slice(k, 10_000), pa.array(freq[k : k + 10_000])], names=["key", "node", "freq"])


def _rows(lists: DataFrame, kind: int, columns: str) -> DataFrame:
    """The (key, node) of the lists of range ``kind`` as rows."""
    names = columns.replace(" long", "").split(", ")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("list").to_pylist():
                key, node, _ = unpacked(raw)
                for k in range(0, len(key), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 10_000].view(np.int64)), pa.array(node[k : k + 10_000])], names=names)

    return written(lists.where(F.col("range") == kind).select("list"), _text.trimmed(task), _schema(columns))


def shared_keys(docs: DataFrame, nodes: DataFrame, words: int, percent: int, total: int) -> DataFrame:
    """(key, node): for each node its keys that others have too, less those that it may leave out, the most frequent ones."""
    lists = _lists(docs, nodes, words, percent, max(1, total // min(WIDEST, max(RANGE, 16 * math.isqrt(total)))))
    dealt = lists.where("range >= 0").repartition("range").sortWithinPartitions("range")
    met = written(dealt, _text.trimmed(_met), _schema("key long, node long, freq long"))
    # the other nodes of a run: plain scans of two written tables, so that Spark can split a hot key
    follow = _rows(lists, -1, "key long, node long").join(met.where("node IS NULL").select("key", "freq"), "key")
    may = _rows(lists, -2, "node long, may long")
    members = met.where("node IS NOT NULL").unionByName(follow.select("key", "node", "freq")).join(bounded(may), "node")
    odd = F.col("key").bitwiseAND(1)
    left = F.when(odd == 0, F.shiftright("may", 32)).otherwise(F.col("may").bitwiseAND((1 << 32) - 1))
    place = F.row_number().over(Window.partitionBy("node", odd).orderBy(F.col("key").bitwiseAND(2).desc(), F.col("freq").desc(), "key"))
    return kept(members.withColumn("_place", place).where(F.col("_place") > left).select("key", "node"))


def folded(row: np.ndarray, full: np.ndarray, size: np.ndarray) -> pa.Array:
    """A parity sketch for each text, of as many bits as the power of two above its shingles: no two differ in more bits than their
    sets in shingles. One twice as wide becomes one of half the bits by the XOR of its halves."""
    n = len(size)
    wide = FOLD * np.left_shift(1, np.ceil(np.log2(np.maximum(size / FOLD, 1))).astype(np.int64))
    begin = np.r_[0, np.cumsum(wide // 64)]
    out = np.zeros(int(begin[-1]), np.int64)
    for bits in np.unique(wide).tolist():
        own = np.flatnonzero(wide == bits)
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        at = place[row]
        for a in range(0, len(own), max(1, ROWS_AT_ONCE * FOLD // bits)):
            part = own[a : a + max(1, ROWS_AT_ONCE * FOLD // bits)]
            inside = (at >= a) & (at < a + len(part))
            odd = np.bincount((at[inside] - a) * bits + (full[inside] & _U(bits - 1)).astype(np.int64), minlength=len(part) * bits) & 1
            sketch = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(part), -1)
            out[(begin[part][:, None] + np.arange(bits // 64)).ravel()] = sketch.ravel()
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(out))


def _folds(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, n, fold: the candidates' sizes and folded sketches."""

    def work(data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
        n = len(offsets) - 1
        row, full = shingles(data, offsets, words)
        size = _text.counted(row, n)
        return {"n": size.astype(np.int32), "fold": folded(row, full, size)}

    some = _of(nodes, docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text")), "node")
    return _text.appended(some, {"n": "int", "fold": "array<bigint>"}, work, stored=True)


def _alike(a_n: Column, b_n: Column, a_fold: Column, b_fold: Column, percent: int) -> Column:
    """Whether sizes and folded sketches allow the similarity; sizes within a factor of two have sketches as wide or twice as wide."""
    half = lambda f: F.zip_with(F.slice(f, 1, (F.size(f) / 2).cast("int")), F.slice(f, (F.size(f) / 2).cast("int") + 1, (F.size(f) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    x = F.when(F.size(a_fold) > F.size(b_fold), half(a_fold)).otherwise(a_fold)
    y = F.when(F.size(b_fold) > F.size(a_fold), half(b_fold)).otherwise(b_fold)
    distance = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0).cast("int"), lambda s, p: s + p)
    sizes = 100 * F.least(a_n, b_n) >= percent * F.greatest(a_n, b_n)
    return F.when(sizes, distance * (100 + percent) <= (a_n + b_n) * (100 - percent)).otherwise(False)


def _of(nodes: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """The rows of ``table`` whose ``name`` is among ``nodes`` (a kept table)."""
    return table.join(bounded(nodes.withColumnRenamed("node", name)), name, "left_semi")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The shingle sets of the documents that are candidates: node, set."""

    def work(data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
        row, full = shingles(data, offsets, words)
        cut = np.searchsorted(row, np.arange(len(offsets)))
        return {"set": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(full.view(np.int64)))}

    some = _of(nodes, docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text")), "node")
    return _text.appended(some, {"set": "array<bigint>"}, work, stored=True)


def _nodes(pairs: DataFrame, rows: int) -> DataFrame:
    return kept(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), 2 * rows)


def _joined(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the values of b and then of a: hubs stand as a, whose side Spark can split."""
    right = values.select(F.col("node").alias("b"), *(F.col(c).alias(f"_b{c}") for c in values.columns if c != "node"))
    left = values.select(F.col("node").alias("a"), *(F.col(c).alias(f"_a{c}") for c in values.columns if c != "node"))
    return pairs.join(right, "b").join(left, "a")


def _linked(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets are similar: first by sizes and folded sketches, which are all that travels with a pair; what passes by its sets."""
    n = pairs.count()
    near = _joined(pairs, _folds(docs, _nodes(pairs, n), words))
    close = kept(near.where(_alike(*map(F.col, ("_an", "_bn", "_afold", "_bfold")), percent)).select("a", "b"), PER * n)
    return _verified(docs, close, words, percent)


def _verified(docs: DataFrame, close: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of ``close`` whose sets are similar."""
    m = close.count()
    both = _joined(close, _sets(docs, _nodes(close, m), words))
    shared = F.size(F.array_intersect("_aset", "_bset"))
    return kept(both.where(100 * shared >= percent * (F.size("_aset") + F.size("_bset") - shared)).select("a", "b"), PER * m)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node that ``links`` (a, b) has; a label is the smallest node that can be reached.

    Each round, every node goes to its smallest neighbour or itself, and once on from there; links are drawn between those, and
    the ones that have become loops are gone. A round at least halves the nodes that still have links.
    """
    n = links.count()
    edges = kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), n)
    labels = None
    while labels is None or (n := edges.count()):
        both = edges.union(edges.select("b", "a"))
        near = kept(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("to")), 2 * n)
        step = kept(near.join(bounded(near.select(F.col("node").alias("to"), F.col("to").alias("_on")), 2 * n), "to").select("node", F.col("_on").alias("to")), 2 * n)
        if labels is None:
            labels, reached = step.select("node", F.col("to").alias("label")), 2 * n
        else:
            labels = kept(labels.join(bounded(step.select(F.col("node").alias("label"), "to"), 2 * n), "label", "left").select("node", F.coalesce("to", "label").alias("label")), reached)
        at = lambda c: bounded(step.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")), 2 * n)  # noqa: B023, E731
        ends = edges.join(at("a"), "a").join(at("b"), "b")
        edges = kept(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a < b").distinct(), n)
    return labels


def _halved(fold: np.ndarray, words: int) -> np.ndarray:
    while len(fold) > words:
        fold = fold[: len(fold) // 2] ^ fold[len(fold) // 2 :]
    return fold


def _compared(percent: int, most: int):
    """The nodes of two blocks, or of one, key by key: pairs of different components whose folded sketches allow the similarity, each once.
    Of a node's partners under a key the first ``most`` are given, and ``cut`` tells if there are more."""

    def task(table: pa.Table) -> pa.Table:
        key, node, size, label, block = (table.column(c).to_numpy() for c in ("key", "node", "n", "label", "_block"))
        low, high = table.column("_low")[0].as_py(), table.column("_high")[0].as_py()
        folds = [x.values.to_numpy().view(_U) for x in table.column("fold")]
        order = np.argsort(key, kind="stable")
        out: set[tuple[int, int]] = set()
        cut = False
        for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            left, right = rows[block[rows] == low], rows[block[rows] == high]
            if not len(left) or not len(right):
                continue
            least = min(len(folds[k]) for k in rows)
            words = np.array([_halved(folds[k], least) for k in right])
            for k, i in enumerate(left):
                some = np.flatnonzero((label[right] != label[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i])))
                some = some[some > k] if low == high else some
                apart = np.bitwise_count(words[some] ^ _halved(folds[i], least)).sum(axis=1, dtype=np.int64)
                near = right[some[apart * (100 + percent) <= (size[right[some]] + size[i]) * (100 - percent)]]
                cut |= len(near) > most
                out.update((min(x, int(node[i])), max(x, int(node[i]))) for x in node[near[:most]].tolist())
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64()), "cut": pa.array([cut] * len(out), pa.bool_())})

    return task


def _between(placed: DataFrame, compare: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``compare`` for each two blocks, or one with itself, of those with the same first node and number of blocks."""
    spark = placed.sparkSession
    where = f"{folder(spark)}/recengine/{uuid.uuid4().hex}"

    def file(table: pa.Table) -> pa.Table:
        first, blocks, block = (table.column(c)[0].as_py() for c in ("first", "_blocks", "_block"))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        put(path := f"{where}/{first}-{blocks}-{block}", sink.getvalue())
        return pa.table({"first": [first], "_blocks": [blocks], "_block": [block], "path": [path]})

    files = kept(placed.groupBy("first", "_blocks", "_block").applyInArrow(file, "first long, _blocks long, _block long, path string"))
    right = files.select("first", "_blocks", F.col("_block").alias("_high"), F.col("path").alias("_with"))
    both = files.withColumnRenamed("_block", "_low").join(right, ["first", "_blocks"]).where("_low <= _high")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda path: pa.ipc.open_stream(get(path)).read_all()
        for batch in batches:
            for low, high, one, two in zip(*(batch.column(c).to_pylist() for c in ("_low", "_high", "path", "_with")), strict=True):
                table = read(one) if low == high else pa.concat_tables([read(one), read(two)])
                table = table.append_column("_low", pa.array([low] * len(table), pa.int64())).append_column("_high", pa.array([high] * len(table), pa.int64()))
                yield from compare(table).combine_chunks().to_batches()

    # a row is a comparison of two blocks: dealt by number, as its size in bytes says nothing of its work
    dealt = both.select("_low", "_high", "path", "_with").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "_with")
    return dealt.mapInArrow(_text.trimmed(task), "a long, b long, cut boolean")


def _unsettled(docs: DataFrame, crowd: DataFrame, labels: DataFrame, words: int, percent: int, most: int) -> DataFrame | None:
    """Pairs (a, b, cut) of different components that keys of several nodes (``crowd``: key, node) still hold and sketches allow; None if no key holds two.

    Keys with the same nodes count once, and keys with the same first node and as many blocks meet in the same tasks, so that a pair that shares many keys is given
    once. Nodes travel once: keys of one block are compared where they meet, and of larger ones each block becomes a file, which the tasks of its pairs of
    blocks read. So the rows are as many as the nodes, and those of pairs as many as (k / BLOCK) squared / 2 for a key of k nodes; no task holds more than two blocks.
    """
    told = kept(crowd.join(bounded(labels), "node", "left").withColumn("label", F.coalesce("label", "node")))
    mark = F.xxhash64("node")
    held = told.groupBy("key").agg(F.min("label").alias("_x"), F.max("label").alias("_y"), F.count(F.lit(1)).alias("_k"), F.min("node").alias("first"), F.bit_xor(mark).alias("_one"), F.bit_xor(F.xxhash64(mark)).alias("_two"))
    single = held.where("_x < _y").groupBy("_k", "first", "_one", "_two").agg(F.min("key").alias("key"))
    open_ = kept(single.select("key", "first", F.ceil(F.col("_k") / BLOCK).alias("_blocks")))
    if open_.isEmpty():
        return None
    members = kept(told.join(bounded(open_), "key"))
    values = _folds(docs, kept(members.select("node").distinct()), words)
    placed = members.join(values, "node").withColumn("_block", F.pmod(F.xxhash64("node"), "_blocks"))
    compare = _compared(percent, most)
    alone = placed.where("_blocks = 1").withColumn("_low", F.lit(0).cast("long")).withColumn("_high", F.lit(0).cast("long"))
    found = alone.groupBy("first").applyInArrow(compare, "a long, b long, cut boolean")
    if not open_.where("_blocks > 1").isEmpty():
        found = found.unionByName(_between(placed.where("_blocks > 1"), compare))
    found = kept(found)
    return kept(found.groupBy("a", "b").agg(F.max("cut").alias("cut")), found.count())


def similar_groups(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id that links of ``percent`` % reach).

    A text of fewer than ``words`` words is one shingle; null, empty and blank texts have none and link with nothing. Rows that
    share an id are judged each by its text; sets with the same smallest id are one node. Rows without id join the group of
    an equal set that has one, else component_id is null. An empty table stays empty; other columns are not looked at.
    """
    rows = _digested(docs, words)
    full = rows.where("n_shingles > 0")
    every = rows.count()
    classes = kept(full.groupBy("_one", "_two").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("_n")), every)
    x = classes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n")).first()
    nodes = kept(classes.where("node IS NOT NULL").select("node").distinct(), x["n"])
    keyed = shared_keys(docs, nodes, words, percent, x["total"])
    m = keyed.count()
    met = kept(keyed.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), m)
    pairs = kept(keyed.join(bounded(met), "key").where("a < node").select("a", F.col("node").alias("b")).distinct(), m)
    labels = components(_linked(docs, pairs, words, percent))
    crowd, most = kept(keyed.join(bounded(met.where("_n > 2").select("key")), "key"), m), MOST
    while (near := _unsettled(docs, crowd, labels, words, percent, most)) is not None:
        links = _verified(docs, near.select("a", "b"), words, percent)
        if not links.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))
        if near.where("cut").isEmpty():
            break
        most *= 8  # what was cut is looked at again, without the components that these links have joined
    ranked = classes.join(bounded(labels), "node", "left").select("_one", "_two", F.coalesce("label", "node").alias("component_id"))
    whole = rows.select("doc_id", "n_shingles", "_one", "_two").join(kept(ranked, x["n"]), ["_one", "_two"], "left")
    return whole.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

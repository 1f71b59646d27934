"""Exact duplicates by Patricia-trie owners.

A text is normalised (white space deleted) and belongs to the partition of its length's band and some bits of its content's hash. Each
map task inserts the full byte strings of its rows into compressed radix tries, one a partition, whose terminal nodes hold the owner
(the row that stays so far: most code points, then smallest id), so that a group of copies leaves a task as one entry however
many they are. When the tries hold too much, the largest are handed on. Entries of a partition meet in one task in order of their
bytes; so all that later entries can change is the path to the last one: every subtree beside it is closed, and is written out and
dropped. At any time one path is in memory. Last, rows learn their group's owner by a join on the normalised text's digest, in
which Spark can split a hot group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.llm import _text

SPACE = bytes([32, *range(9, 14)])
#: When a task's tries hold this many bytes of text, the largest are handed on until half is left.
HELD = 24 << 20
#: Bits of a text's hash that its partition has; sizes to the power of two are a band.
BITS = 8
_INT = pa.int64()


class Trie:
    """A compressed radix trie over byte strings; a terminal node holds a value."""

    __slots__ = ("edges", "value")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Trie]] = {}
        self.value = None

    def at(self, key: bytes) -> Trie:
        """The terminal node of ``key``, put in if it is new."""
        node, i = self, 0
        while i < len(key):
            edge = node.edges.get(key[i])
            if edge is None:
                child = Trie()
                node.edges[key[i]] = key[i:], child
                return child
            label, child = edge
            if key.startswith(label, i):
                node, i = child, i + len(label)
                continue
            same = _shared(label, key[i : i + len(label)])
            middle = Trie()
            middle.edges[label[same]] = label[same:], child
            node.edges[key[i]] = label[:same], middle
            node, i = middle, i + same
        return node

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        todo = [(b"", self)]
        while todo:
            key, node = todo.pop()
            if node.value is not None:
                yield key, node.value
            todo += [(key + label, child) for label, child in node.edges.values()]


def _shared(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _better(a: tuple, b: tuple) -> tuple:
    """Of two owners (code points, id, rows): the one that stays, with the rows of both. Null ids come last."""
    first = a if (-a[0], a[1] is None, a[1] or 0) <= (-b[0], b[1] is None, b[1] or 0) else b
    return first[0], first[1], a[2] + b[2]


def _partition(key: bytes) -> int:
    """The band of the length (a power of two) above ``BITS`` bits of a hash of the content."""
    return len(key).bit_length() << BITS | hashlib.blake2b(key, digest_size=2).digest()[0] & (1 << BITS) - 1


_OWNERS = "part int, key binary, points long, id long, n long"


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: from (id, text) to an entry for each different text, or several if its trie was handed on meanwhile."""
    tries: dict[int, Trie] = {}
    held: dict[int, int] = {}
    total = 0
    for batch in batches:
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_py() or ""
            key = raw.encode().translate(None, SPACE)
            part = _partition(key)
            trie = tries.setdefault(part, Trie())
            node, mine = trie.at(key), (len(raw), i, 1)
            if node.value is None:
                held[part] = held.get(part, 0) + len(key)
                total += len(key)
            node.value = _better(node.value, mine) if node.value else mine
            if total > HELD:
                large = []
                for p in sorted(held, key=held.get, reverse=True):
                    if total <= HELD // 2:
                        break
                    large.append((p, tries.pop(p)))
                    total -= held.pop(p)
                yield from _written(large)
    yield from _written(tries.items())


def _written(tries: Iterable[tuple[int, Trie]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for part, trie in tries:
        for key, (points, i, n) in trie.terminals():
            rows.append((part, key, points, i, n))
            size += len(key)
            if size > 4 << 20:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary() if k == 1 else _INT) for k, c in enumerate(cols)], names=["part", "key", "points", "id", "n"])


class Spilled:
    """A trie that gets its keys in ascending order: ``put`` gives back the terminal nodes of the subtrees that the new key closes.

    What is held is the path of the last key: labels of edges from the root down, and the value at the end of each.
    """

    def __init__(self):
        self.path: list[list] = []  # [label, value], the key is the labels one after another

    def put(self, key: bytes, value: tuple) -> list[tuple[bytes, tuple]]:
        out, at, k = [], 0, 0
        while k < len(self.path) and key.startswith(self.path[k][0], at):
            at += len(self.path[k][0])
            k += 1
        if k < len(self.path):
            same = _shared(self.path[k][0], key[at : at + len(self.path[k][0])])
            out = self._closed(k)
            if same:  # the edge is split; its upper part stays open
                self.path.append([key[at : at + same], None])
                at += same
        if at < len(key) or not self.path:
            self.path.append([key[at:], value])
        else:
            last = self.path[-1]
            last[1] = _better(last[1], value) if last[1] else value
        return out

    def _closed(self, k: int) -> list[tuple[bytes, tuple]]:
        """Takes the path from its k-th edge on away; its terminal nodes, from the bottom."""
        out = []
        whole = b"".join(label for label, _ in self.path)
        while len(self.path) > k:
            label, value = self.path.pop()
            if value is not None:
                out.append((whole, value))
            whole = whole[: len(whole) - len(label)]
        return out

    def rest(self) -> list[tuple[bytes, tuple]]:
        return self._closed(0)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: entries in order of partition and key; a partition's last path goes when the next begins."""
    now, trie, out = None, Spilled(), []

    def done(closed: list[tuple[bytes, tuple]]) -> None:
        out.extend((hashlib.sha256(key).digest(), i, n) for key, (_, i, n) in closed)

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], _INT), pa.array([x[2] for x in out], _INT)], names=["digest", "keep_id", "group_size"])

    for b in batches:
        columns = [b.column(k).to_pylist() for k in (0, 2, 3, 4)]
        for k, (part, points, i, n) in enumerate(zip(*columns, strict=True)):
            if part != now:
                done(trie.rest())
                now = part
            done(trie.put(b.column(1)[k].as_py(), (points, i, n)))
        if len(out) >= 10_000:
            yield batch()
            out.clear()
    done(trie.rest())
    yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, hashlib.sha256((t.as_py() or "").encode().translate(None, SPACE)).digest()) for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], _INT), pa.array([x[1] for x in rows], pa.binary())], names=["id", "digest"])


def owners(docs: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of every different normalised text of ``docs`` (doc_id, text).

    A task's entries of one text are one row, so a group of copies reaches its partition as at most a row for each time that a map task
    hands its trie on.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_text.trimmed(_owners), _OWNERS)
    # a partition may part further by its keys: each task then has some of its subtrees
    dealt = found.repartition("part", F.pmod(F.xxhash64("key"), F.lit(64))).sortWithinPartitions("part", "key")
    return dealt.mapInArrow(_text.trimmed(_merged), "digest binary, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text in UTF-8).

    Null and empty texts, and those of white space alone, are equal. Rows that repeat an id are rows of their group: each
    counts, and each of those with the owner's id is kept. Null ids lose ties; a group of null ids only has none to keep
    and keeps all its rows. An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_text.trimmed(_digests), "id long, digest binary")
    out = rows.join(owners(docs), "digest")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

"""Token ids in Arrow's file format, as equal-length sequences with masks.

Documents are dealt to tasks by ranges of doc_id and sorted. A task encodes its texts, lays the ids end to end (an end id after
each document) and writes one file of record batches with two fixed-size lists: ``ids`` (unsigned 16 or 32 bits) and ``mask``
(false on the padding of the last sequence). Sequence k of a file is element k modulo BATCH of batch k div BATCH, so a reader that
maps the file gets any of them without copying or decoding. A second file says where each document begins.
A file gets its name when it is whole; a task that runs again writes the same bytes under the same name.

Encoding goes piece by piece: the tokenizer's pre-tokens hold neither white space nor letters beside punctuation or digits, so
a text's ids are those of its pieces, and a piece that came before is not encoded again (``test_tokens`` holds this against
encoding whole texts).
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recengine.llm import _text
from recengine.llm.shared import folder, kept, store

LENGTH = 2048
BATCH = 64
END = 2
#: Bytes of pieces whose ids a worker remembers before it starts anew.
REMEMBERED = 4 << 20


#: Bytes of pieces: 1 letters (and lead bytes of two-byte Latin letters), 2 ASCII punctuation but the apostrophe, 3 digits, 0 all else.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 2
_CLASS[48:58] = 3


def pieces(data: np.ndarray, offsets: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of pieces that are encoded alike wherever they stand, and each byte's class.

    Pieces end at white space, and ``within`` words where letters, punctuation and digits meet: there, every pre-token ends.
    """
    starts, ends, rows = _text.cut(data, offsets, _text.SOLID)
    kind = _CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    if len(lead):
        next_ = data[lead + 1]  # no letters: the signs of times and division, and capital I with a dot, which becomes a letter and a mark
        sign = (data[lead] == 0xC3) & ((next_ == 0x97) | (next_ == 0xB7)) | (data[lead] == 0xC4) & (next_ == 0xB0)
        kind[lead[sign]] = 0
        kind[lead[~sign] + 1] = 1
    if within and len(data):
        new = np.zeros(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        new[starts] = True
        begin = np.flatnonzero(new)
        word = np.searchsorted(starts, begin, "right") - 1
        inside = (word >= 0) & (begin < ends[word])
        begin, word = begin[inside], word[inside]
        last = np.r_[word[1:] != word[:-1], True] if len(word) else np.zeros(0, bool)
        stop = np.where(last, ends[word], np.r_[begin[1:], 0])
        return begin, stop, rows[word], kind
    return starts, ends, rows, kind


def _visible() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 as it is, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, each followed by ``end``. Ids of pieces that came before are looked up in sorted arrays.

    Pieces of letters alone are one pre-token, so the library's model gets them at once; all others go its whole way. Pieces are
    found by a hash and then compared byte by byte; where two share a hash, the run's texts are encoded whole.
    """

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.model, self.visible = self.tokenizer.model, _visible()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        steps = json.loads(self.tokenizer.to_str())
        kinds = [x.get("type") for y in (steps["normalizer"], steps["pre_tokenizer"]) for x in [*(y or {}).get("normalizers", []), *(y or {}).get("pretokenizers", [])]]
        #: Whether the tokenizer lower-cases, parts words as ``pieces`` does and maps bytes; any other parts at white space only.
        self.parts = kinds == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in str(steps["pre_tokenizer"]).replace("\\\\", "\\")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([self.end], self.kind)
        #: The pieces' own bytes.
        self.raw, self.raw_begin, self.raw_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, raw: list[bytes], letters: list[bool]) -> list[list[int]]:
        out: list = [None] * len(raw)
        whole = []
        for k, (piece, own) in enumerate(zip(raw, letters, strict=True)):
            if own:
                text = piece.decode().lower()
                out[k] = [t.id for t in self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(self.visible))]
            else:
                whole.append(k)
        for k, e in zip(whole, self.tokenizer.encode_batch_fast([raw[k].decode() for k in whole], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = offsets.tolist()
        ids = [[*e.ids, self.end] for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.kind), np.array([len(x) for x in ids], np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts and, for each text, how many of them are its own."""
        raw = data.tobytes()
        # a special token's string is one whatever stands beside it; a mark may join a small letter but not its capital
        within = self.parts and b"<|" not in raw
        low = _text.LOWER[data] if within and not ((data == 0xCC) | (data == 0xCD)).any() else data
        starts, ends, rows, kind = pieces(data, offsets, within)
        hashes = _text.hashed(low, starts, ends, seed=int(not within))
        words, first, which = _text.distinct(hashes)
        own = ends - starts
        if len(self.raw) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, words)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == words if len(self.keys) else np.zeros(len(words), bool)
        old, new = np.flatnonzero(known), np.flatnonzero(~known)
        if not (_alike(low, starts, own, low, starts[first][which], own[first][which]) and _alike(low, starts[first[old]], own[first[old]], self.raw, self.raw_begin[at[old]], self.raw_size[at[old]])):
            return self._whole(raw, offsets)
        if len(new):
            other = np.zeros(len(data) + 1, np.int32)
            np.cumsum(kind != 1, out=other[1:])
            a, b = starts[first[new]], ends[first[new]]
            letters = (other[a] == other[b]) & within
            made = self._encoded([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], letters.tolist())
            size = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.fromiter(chain.from_iterable(made), self.kind, int(size.sum()))
            self.begin = np.insert(self.begin, at[new], len(self.pool) + np.cumsum(size) - size)
            self.size = np.insert(self.size, at[new], size)
            self.keys = np.insert(self.keys, at[new], words[new])
            self.raw_begin = np.insert(self.raw_begin, at[new], len(self.raw) + np.cumsum(b - a) - (b - a))
            self.raw_size = np.insert(self.raw_size, at[new], b - a)
            self.raw = np.concatenate([self.raw, *(low[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True))])
            self.pool = np.concatenate([self.pool, flat])
        place = np.searchsorted(self.keys, words)
        size, begin = self.size[place], self.begin[place]
        # the pieces of each text and then its end: one more piece, that stands first in the pool
        at = np.searchsorted(rows, np.arange(len(offsets) - 1), "right")
        piece_size = np.insert(size[which], at, 1)
        piece_begin = np.insert(begin[which], at, 0)
        owner = np.insert(rows, at, np.arange(len(offsets) - 1))
        index = np.arange(int(piece_size.sum())) + np.repeat(piece_begin - (np.cumsum(piece_size) - piece_size), piece_size)
        return self.pool[index], np.bincount(owner, piece_size, len(offsets) - 1).astype(np.int64)


def _alike(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> bool:
    return bool((a_size == b_size).all() and _text.same(a, a_at, b, b_at, a_size).all())


class Sequences:
    """Writes ids as sequences of ``length`` to an Arrow file, a batch of ``BATCH`` at a time."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, kind: type, length: int):
        self.fs, self.path, self.kind, self.length, self.rest, self.n = fs, path, kind, length, np.zeros(0, kind), 0
        self.open = f"{path}.{uuid.uuid4().hex}"
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = fs.open_output_stream(self.open)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = self.length * BATCH
        done = len(self.rest) // whole * whole
        for a in range(0, done, whole):
            self._write(self.rest[a : a + whole], whole)
        self.rest = self.rest[done:].copy()

    def _write(self, ids: np.ndarray, own: int) -> None:
        mask = pa.array(np.arange(len(ids)) < own)
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            own = len(self.rest)
            self._write(np.concatenate([self.rest, np.zeros(-own % self.length, self.kind)]), own)
        self.writer.close()
        self.sink.close()
        self.fs.move(self.open, self.path)


def write(spark: SparkSession, docs: DataFrame, where: str, tokenizer: str, *, length: int = LENGTH, end: int = END) -> DataFrame:
    """Writes ``docs`` (doc_id, text) below ``where``; a row for each file: part, path, n_docs, n_tokens.

    Documents stand in ascending doc_id order over all files (null ids first; rows that share an id in order of a hash of
    their texts). A null or empty text is an end id alone. An empty table writes no file.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_tie", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    # many rows without id, or of one id and text, still part into several ranges
    dealt = ordered.repartitionByRange("doc_id", "_tie", "_place").sortWithinPartitions("doc_id", "_tie").drop("_tie", "_place")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if not _LAST or _LAST[0] != (tokenizer, end):
            _LAST[:] = (tokenizer, end), Encoder(tokenizer, end)
        encode, out, found = _LAST[1], None, []
        part = TaskContext.get().partitionId()
        fs, base = store(where)
        path = f"{base}/part-{part:07d}"
        for batch in batches:
            data, offsets = _text.buffer(batch.column("text"))
            for lo, hi in _text.runs(offsets):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = Sequences(fs, f"{path}.arrow", encode.kind, length)
                ids, sizes = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found.append(pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(out.n + np.cumsum(sizes) - sizes), pa.array(sizes)], names=["doc_id", "begin", "n_tokens"]))
                out.add(ids)
        if out is None:
            return
        out.close()
        index = pa.Table.from_batches(found)
        with fs.open_output_stream(opened := f"{path}.index.{uuid.uuid4().hex}") as sink, pa.ipc.new_file(sink, index.schema) as w:
            w.write_table(index)
        fs.move(opened, f"{path}.index.arrow")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"part-{part:07d}"]), pa.array([len(index)], pa.int64()), pa.array([out.n], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    return kept(dealt.mapInArrow(_text.trimmed(task), "part long, path string, n_docs long, n_tokens long"))


def read(spark: SparkSession, files: DataFrame, where: str) -> DataFrame:
    """Each document of the files that ``write`` returned: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    number = files.count()
    dealt = files.withColumn("start", F.coalesce(before, F.lit(0))).select("path", "start").repartition(max(1, number))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                yield from documents(where, name, start)

    return dealt.mapInArrow(_text.trimmed(task), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _opened(fs: pa.fs.FileSystem, path: str) -> pa.NativeFile:
    return pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, pa.Array]:
    """Sequence k of an opened file and its mask, without a copy."""
    batch = reader.get_batch(k // BATCH)
    ids, mask, length, k = batch.column(0), batch.column(1), batch.column(0).type.list_size, k % BATCH
    return ids.values.to_numpy(zero_copy_only=True)[k * length : (k + 1) * length], mask.values.slice(k * length, length)


def documents(where: str, name: str, start: int) -> Iterator[pa.RecordBatch]:
    fs, base = store(where)
    with _opened(fs, f"{base}/{name}.index.arrow") as f:
        index = pa.ipc.open_file(f).read_all()
    begin, size = index.column("begin").to_numpy(), index.column("n_tokens").to_numpy()
    with _opened(fs, f"{base}/{name}.arrow") as f:
        reader = pa.ipc.open_file(f)
        batches, number, whole = {}, reader.num_record_batches, None
        sums = np.zeros(len(begin), np.int64)
        for k, (a, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
            crc, at = 0, a
            while at < a + n:  # a document lies in one batch or in some that follow each other
                if whole is None:
                    whole = len(reader.get_batch(0)) * reader.schema.field(0).type.list_size
                j = at // whole
                if j not in batches:
                    batches = {j: reader.get_batch(min(j, number - 1)).column(0).values.to_numpy(zero_copy_only=True)}
                piece = batches[j][at - j * whole : a + n - j * whole]
                crc, at = zlib.crc32(piece.astype("<u4").tobytes(), crc), at + len(piece)
            sums[k] = crc
    for lo in range(0, len(begin), 10_000):
        part = index.slice(lo, 10_000)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array(begin[lo : lo + 10_000] + start), pa.array(size[lo : lo + 10_000]), pa.array(sums[lo : lo + 10_000])], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, *, where: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """``read(write(...))`` in a new folder of the shared one, or below ``where``."""
    where = where or f"{folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read(spark, write(spark, docs, where, tokenizer, length=length, end=end), where)


#: A worker's latest tokenizer.
_LAST: list = []

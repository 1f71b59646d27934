"""Vectorised text work on Arrow buffers, shared by the operators that run in Python workers.

A worker gets Arrow batches. ``runs`` cuts a batch into runs of rows of about ``CHUNK`` bytes, so the numpy arrays of a
step stay small however many rows a batch has; a longer text is a run of its own. All byte-level work is on the
UTF-8 buffer itself; texts become Python strings only where a regular expression needs them.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.llm.shared import written

CHUNK = 1 << 20
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SEED, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
#: A byte string longer than this is hashed as a whole, not block by block together with others.
LONG = 256

#: A-Z to a-z on UTF-8 bytes; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space (0x20, 0x09-0x0D).
SOLID = np.ones(256, bool)
SOLID[[32, *range(9, 14)]] = False
#: Bytes of words of digits, letters and everything beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the rows' offsets in them; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes, or of a single row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def cut(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal stretch of bytes with ``inside``; none reaches over a row's end."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    mask = inside[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    after[-1], after[:-1] = False, mask[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset of ``data`` on, as one number (zeros behind the end); nothing is copied but ``data``."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))


def _blocks(eights: np.ndarray, starts: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """Bytes ``at`` .. ``at`` + 8 of the byte strings, zeros beyond their ends."""
    over = np.clip(8 - (size - at), 0, 7).astype(_U) * _U(8)
    return eights[starts + at] & (~_U(0) >> over)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte string data[start:end], the same wherever it stands.

    Each block of eight bytes goes through a full mix of 64 bits before the next comes in, so that no sums of blocks cancel out; strings
    of up to eight bytes and the same length never collide. What must tell strings apart for certain compares them (``same``).
    """
    size = ends - starts
    out = np.full(len(starts), _SEED + _U(seed), _U)
    eights = _eights(data)
    at, todo = 0, np.flatnonzero(size <= LONG)
    while len(todo):
        out[todo] = mixed((out[todo] ^ _blocks(eights, starts[todo], size[todo], at)) * _STEP)
        at += 8
        todo = todo[size[todo] > at]
    for k in np.flatnonzero(size > LONG):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return mixed(out + size.astype(_U))


def same(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes of ``a`` from ``a_at`` on are those of ``b`` from ``b_at`` on."""
    out = np.ones(len(size), bool)
    x, y = _eights(a), _eights(b)
    at, todo = 0, np.flatnonzero((size <= LONG) & (size > 0))
    while len(todo):
        out[todo] &= _blocks(x, a_at[todo], size[todo], at) == _blocks(y, b_at[todo], size[todo], at)
        at += 8
        todo = todo[size[todo] > at]
    for k in np.flatnonzero(size > LONG):
        out[k] = np.array_equal(a[a_at[k] : a_at[k] + size[k]], b[b_at[k] : b_at[k] + size[k]])
    return out


def trimmed(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` of a Python worker, which gives its free memory back to the system when the task ends: workers are used again, and
    what one operator needed at its height would else stay with the next one's."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            _trim()

    return run


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values, where each occurs first, and the number of the value at each place (np.unique sorts far slower if it is asked for places)."""
    values, which = np.unique(x, return_inverse=True)
    first = np.empty(len(values), np.int64)
    first[which[::-1]] = np.arange(len(x) - 1, -1, -1)
    return values, first, which


def points(data: np.ndarray) -> np.ndarray:
    """For each byte offset 0..len, the number of code points that begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def counted(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def appended(
    docs: DataFrame, columns: dict[str, str], work: Callable[[np.ndarray, np.ndarray], dict[str, object]] | None = None, *, text: str = "text", chunk: int = CHUNK, strings: Callable[[], Callable[[list[str]], dict[str, object]]] | None = None, needs: list[str] = [], stored: bool = False,
) -> DataFrame:
    """``docs`` with ``columns`` (name: SQL type) computed from its texts, run by run, without a shuffle.

    ``work`` gets the bytes and offsets of a run of rows, or ``strings()`` makes a function of the texts as strings;
    both give a column of values by name. A column of ``docs`` with the name of a new one gives way to it.
    Null and empty texts are both handed over as empty. ``needs`` names further columns that ``work`` gets by name. ``stored``: the
    result, without the texts, is written to the shared folder.
    """
    lower = {c.lower() for c in columns}
    keep = [c for c in dict.fromkeys(docs.columns) if c.lower() not in lower]
    named = docs.select(*(docs[f"`{c}`"].alias(f"_{i}") for i, c in enumerate(keep)), docs[f"`{text}`"].cast("string").alias("_text"), *(docs[f"`{c}`"].alias(f"_need_{c}") for c in needs))
    fields = [T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(keep) if c != text]
    schema = T.StructType([*fields, *([] if stored else [T.StructField("_text", T.StringType())]), *(T.StructField(f"+{c}", T._parse_datatype_string(t)) for c, t in columns.items())])
    named = named.drop(*(f"_{i}" for i, c in enumerate(keep) if c == text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        made = strings() if strings else None
        for batch in batches:
            data, offsets = buffer(batch.column("_text"))
            for lo, hi in runs(offsets, chunk):
                part = batch.slice(lo, hi - lo)
                more = [part.column(f"_need_{c}") for c in needs]
                if made:
                    new = made([x or "" for x in part.column("_text").to_pylist()], *more)
                else:
                    new = work(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], *more)
                arrays = [part.column(f.name) if not f.name.startswith("+") else pa.array(new[f.name[1:]], target.field(f.name).type) for f in schema.fields]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, target, strict=True)], schema=target)

    out = written(named, trimmed(run), schema) if stored else named.mapInArrow(trimmed(run), schema)
    back = {c: F.col("_text" if c == text else f"_{i}") for i, c in enumerate(keep) if not (stored and c == text)}
    return out.select(*(x.alias(c) for c, x in back.items()), *(F.col(f"`+{c}`").alias(c) for c in columns))

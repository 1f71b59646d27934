"""Language-model scores by a weighted backoff automaton whose counts are gathered from the whole corpus.

The model is an interpolated trigram: P(w | u v) = (1 - a) c(uvw) / c(uv) + a P(w | v), P(w | v) = (1 - b) c(vw) / c(v) + b P(w), over
P(w) = (c(w) + 1) / (N + V + 1). As an automaton, every context that training has is a state: word pairs, words, and none. A state has an
arc for each continuation that was seen, with its smoothed probability, to the longest context that the text then ends in, and a
failure arc of weight a or b to its shorter context. A text is traversed once from left to right: the state is carried from token to
token, and arcs' logarithms add up.

a and b depend on how often the context was seen (a power of two), and are those of ``GRID`` under which the training tokens, each left
out of the counts in turn, are likeliest; while a is chosen, b is 4 / (4 + c(v)), so that one reading gives both.

No task holds the model. A shard (about ``SHARD`` bytes of consecutive rows) lists its distinct words, pairs and triples with its own
training counts; buckets of a hash's upper bits add them up over all shards and send each shard the totals of its own list: the part
of the automaton that its texts can reach. The parts are files in the shared folder. Then each shard is read again:
once to choose the weights, once to be traversed. Lists travel as sorted hashes in packed differences: 64 bits for words, and for pairs and
triples 20 more than the corpus has bits in its number of bytes, so that at any size about one in a million is mistaken for another.
Shards and buckets grow with the square root of the corpus from ``SHARD`` to ``MOST``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.llm import _text
from recengine.llm.shared import folder, get, kept, put

SHARD, MOST = 4 << 20, 8 << 20
GRID = (0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999)
CLASSES = 48
_U = np.uint64
_BEGIN, _END = _text.mixed(np.array([0x5EED1, 0x5EED2], _U))
_K = _text.mixed(np.array([71, 72, 73, 74, 75], _U)) | _U(1)
#: Kinds of lists: words, pairs, triples.
KINDS = "wpt"


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys and their counts: differences in as many bytes as the largest needs, counts in one, larger ones behind."""
    if not len(keys):
        return b""
    step = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    head = np.array([len(keys), keys[0], width], _U).tobytes()
    body = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return head + body + _counts(counts)


def _counts(counts: np.ndarray) -> bytes:
    big = counts >= 255
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<u8").tobytes()


def _uncounted(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = np.frombuffer(raw, "<u8", len(big), n)
    return out


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not raw:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    n, first, width = (int(x) for x in np.frombuffer(raw, _U, 3))
    step = np.zeros((n, 8), np.uint8)
    step[:, :width] = np.frombuffer(raw, np.uint8, n * width, 24).reshape(n, width)
    return np.cumsum(step.view("<u8")[:, 0], dtype=_U) + _U(first), _uncounted(raw[24 + n * width :], n)


class Shard:
    """Tokens of a run of texts: each word and then an end, and the distinct words, pairs and triples among them.

    ``key[k]`` are the distinct hashes of n-grams of k + 1 tokens, ``at[k]`` the number of the one that ends at each place (-1: none does,
    as the text has not begun so many tokens before; a text's first token has a pair, with the beginning). ``before[k]`` is the number
    among ``key[k - 1]`` of an n-gram's context, one beyond the last for the beginning; ``after[k]`` the one of its last k tokens.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, train: np.ndarray, bits: int):
        low = _text.LOWER[data]
        starts, ends, rows = _text.cut(low, offsets, _text.SOLID)
        n = len(offsets) - 1
        at = np.searchsorted(rows, np.arange(n), "right")
        token = np.insert(_text.hashed(low, starts, ends), at, _END)
        self.row = np.insert(rows, at, np.arange(n))
        self.size = np.bincount(self.row, minlength=n)
        self.begin = np.cumsum(self.size) - self.size
        self.train = train[self.row]
        one = np.empty_like(token)
        one[1:] = token[:-1]
        one[self.begin] = _BEGIN
        pair = _text.mixed(one * _K[0] + token * _K[1])
        follows = np.ones(len(token), bool)
        follows[self.begin] = False
        third = np.flatnonzero(follows)
        triple = _text.mixed(pair[third - 1] * _K[2] + token[third] * _K[3])
        cut = _U(64 - bits)
        words, first, word = _text.distinct(token)
        pairs, first2, pair = _text.distinct(pair >> cut)
        triples, first3, triple = _text.distinct(triple >> cut)
        self.key, self.width = (words, pairs, triples), (64, bits, bits)
        deep = np.full(len(token), -1, np.int64)
        deep[third] = triple
        self.at = (word, pair, deep)
        before = np.full(len(token), len(words), np.int64)
        before[third] = word[third - 1]
        self.before = (None, before[first2], pair[third - 1][first3])
        self.after = (None, word[first2], pair[third][first3])

    def own(self) -> list[np.ndarray]:
        """Training counts of this shard's words, pairs and triples."""
        return [np.bincount(x[self.train & (x >= 0)], minlength=len(y)).astype(np.int64) for x, y in zip(self.at, self.key, strict=True)]


def _class(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


class Automaton:
    """The states and arcs a shard can reach. ``total`` and ``kinds``: training tokens and their distinct number; ``begun``: texts."""

    def __init__(self, shard: Shard, counts: list[np.ndarray], total: int, kinds: int, begun: int):
        self.shard, self.counts = shard, counts
        self.flat = (counts[0] + 1) / (total + kinds + 1)
        self.context = None, np.append(counts[0], begun)[shard.before[1]], counts[1][shard.before[2]]
        self.begun = begun

    def left_out(self) -> np.ndarray:
        """[order, class of context, weight]: the log-likelihood of this shard's training tokens, each without itself."""
        out = np.zeros((2, CLASSES, len(GRID)))
        lower = self.flat
        own = self.shard.own()
        for k in (1, 2):
            context, n = self.context[k], own[k]
            below = lower[self.shard.after[k]]
            some = (n > 0) & (context > 1)
            seen, kind = (self.counts[k][some] - 1) / (context[some] - 1), _class(context[some])
            for g, w in enumerate(GRID):
                out[k - 1, :, g] = np.bincount(kind, n[some] * np.log((1 - w) * seen + w * below[some]), CLASSES)
            w = 4 / (4 + np.maximum(context, 0))
            lower = (1 - w) * self.counts[k] / np.maximum(context, 1) + w * below
        return out

    def built(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Arcs, numbered as words, pairs and triples one after another: whether they exist, log10 probability, state after them. States: 0
        without history, then words, the beginning, pairs: log10 weight of their failure arc and the state it leads to; order."""
        s, (words, pairs, triples) = self.shard, self.counts
        probability = [self.flat]
        for k in (1, 2):
            context = self.context[k]
            w = np.where(context > 0, weights[k - 1][_class(context)], 1.0)
            probability.append((1 - w) * self.counts[k] / np.maximum(context, 1) + w * probability[-1][s.after[k]])
        word_state = np.where(words > 0, np.arange(len(words)) + 1, 0)
        pair_state = len(words) + 2 + np.arange(len(pairs))
        fail = [np.zeros(1), np.log10(weights[0][_class(np.append(words, self.begun))]), np.log10(weights[1][_class(pairs)])]
        return {
            "exists": np.concatenate([np.ones(len(words), bool), pairs > 0, triples > 0]), "log": np.log10(np.concatenate(probability)),
            "to": np.concatenate([word_state, pair_state, pair_state[s.after[2]]]), "fail": np.concatenate(fail),
            "fail_to": np.concatenate([np.zeros(len(words) + 2, np.int64), word_state[s.after[1]]]),
            "order": np.repeat(np.array([0, 1, 2]), [1, len(words) + 1, len(pairs)]),
        }

    def traverse(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the automaton's log10 probability, that of words alone, and how many tokens training has.

        All texts of the shard take their next step together, the longest ones first, so that those still going are the first ones.
        """
        s, n, a = self.shard, len(self.shard.size), self.built(weights)
        first = np.cumsum([0, len(self.counts[0]), len(self.counts[1])])
        arc_at = np.stack([x + f for x, f in zip(s.at, first, strict=True)])
        exists, log, to, fail, fail_to, order = (a[k] for k in ("exists", "log", "to", "fail", "fail_to", "order"))
        longest = np.argsort(-s.size, kind="stable")
        begin, size = s.begin[longest], s.size[longest]
        state = np.full(n, len(self.counts[0]) + 1 if self.begun else 0)
        score = np.zeros(n)
        for t in range(int(size.max(initial=0))):
            going = int(np.searchsorted(-size, -t, "left"))
            at, now = begin[:going] + t, state[:going]
            arc = arc_at[order[now], at]
            lost = np.flatnonzero(~exists[arc])
            while len(lost):
                score[lost] += fail[now[lost]]
                now[lost] = fail_to[now[lost]]
                arc[lost] = arc_at[order[now[lost]], at[lost]]
                lost = lost[~exists[arc[lost]]]
            score[:going] += log[arc]
            state[:going] = to[arc]
        out = np.empty(n)
        out[longest] = score
        return out, np.bincount(s.row, np.log10(self.flat)[s.at[0]], n), np.bincount(s.row, (self.counts[0] > 0)[s.at[0]], n)


def _shards(batches: Iterator[pa.RecordBatch], limit: int, width: int) -> Iterator[tuple[str, pa.Array, np.ndarray, Shard]]:
    """A task's rows in shards of about ``limit`` bytes: name, ids, training marks and tokens. The same at every run over the same rows."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    size = 0

    def shard():
        data = np.concatenate([x for _, x, _ in held])
        lengths = np.concatenate([np.diff(o) for *_, o in held])
        train = np.concatenate([b.column("_train").to_numpy(zero_copy_only=False) for b, *_ in held]).astype(bool)
        ids = pa.concat_arrays([b.column("doc_id") for b, *_ in held])
        return f"{part}-{number}", ids, train, Shard(data, np.r_[0, np.cumsum(lengths)], train, width)

    for batch in batches:
        data, offsets = _text.buffer(batch.column("_text"))
        for lo, hi in _text.runs(offsets, limit):
            held.append((batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            size += int(offsets[hi] - offsets[lo])
            if size >= limit:
                yield shard()
                held, size, number = [], 0, number + 1
    if held:
        yield shard()


def _listed(limit: int, bits: int, width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, train, s in _shards(batches, limit, width):
            out = []
            for kind, keys, counts, wide in zip(KINDS, s.key, s.own(), s.width, strict=True):
                cut = np.searchsorted(keys, np.arange(1 << bits, dtype=_U) << _U(wide - bits)) if bits else np.zeros(1, np.int64)
                for k, (a, b) in enumerate(zip(cut, np.r_[cut[1:], len(keys)], strict=True)):
                    if b > a:
                        out.append((kind, k, name, packed(keys[a:b], counts[a:b])))
            # texts that begin in training, as a count of its own
            out.append(("b", 0, name, np.array([train.sum()], "<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out]), pa.array([x[3] for x in out], pa.binary())], names=["kind", "bucket", "shard", "list"])

    return task


def _added(table: pa.Table) -> pa.Table:
    """A bucket's lists from all shards: each gets the totals of its own; and the bucket's own sums for shard ""."""
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    shards, lists = table.column("shard").to_pylist(), table.column("list").to_pylist()
    if kind == "b":
        rows = [("", 0, sum(int(np.frombuffer(x, "<u8")[0]) for x in lists), b"")]
    else:
        each = [unpacked(x) for x in lists]
        _, which = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
        total = np.bincount(which, np.concatenate([c for _, c in each])).astype(np.int64)
        cut = np.cumsum([0, *(len(k) for k, _ in each)])
        rows = [(s, b - a, 0, _counts(total[which[a:b]])) for s, a, b in zip(shards, cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        rows.append(("", int((total > 0).sum()), int(total.sum()), b""))
    return pa.table({"kind": pa.array([kind] * len(rows)), "bucket": pa.array([bucket] * len(rows), pa.int32()), "shard": pa.array([r[0] for r in rows]), "n": pa.array([r[1] for r in rows], pa.int64()), "total": pa.array([r[2] for r in rows], pa.int64()), "counts": pa.array([r[3] for r in rows], pa.binary())})


def _stored(where: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (shard, kind, bucket): a file for each shard; sums go on as rows."""
        now, parts, sums = None, {k: [] for k in KINDS}, {}

        def done():
            if now:
                arrays = [np.concatenate([np.zeros(0, np.int64), *parts[k]]) for k in KINDS]
                put(f"{where}/{now}", b"".join(len(a).to_bytes(8, "little") + len(x := _counts(a)).to_bytes(8, "little") + x for a in arrays))

        for b in batches:
            for kind, shard, n, total, counts in zip(*(b.column(c).to_pylist() for c in ("kind", "shard", "n", "total", "counts")), strict=True):
                if not shard:
                    x = sums.get(kind, (0, 0))
                    sums[kind] = x[0] + n, x[1] + total
                    continue
                if shard != now:
                    done()
                    now, parts = shard, {k: [] for k in KINDS}
                parts[kind].append(_uncounted(counts, n))
        done()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.int64())], names=["kind", "n", "total"])

    return task


def _reached(where: str, name: str, shard: Shard, sums: tuple[int, int, int]) -> Automaton:
    raw, at, counts = get(f"{where}/{name}"), 0, []
    for keys in shard.key:
        n, size = int.from_bytes(raw[at : at + 8], "little"), int.from_bytes(raw[at + 8 : at + 16], "little")
        if n != len(keys):
            raise RuntimeError(f"shard {name} was read as other rows than before; the input changed under the query")
        counts.append(_uncounted(raw[at + 16 : at + 16 + size], n))
        at += 16 + size
    return Automaton(shard, counts, *sums)


def score(spark: SparkSession, docs: DataFrame, train: object, *, shard: int = SHARD, scanned: bool = False) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score, held_out.

    ``train`` is a boolean column: the rows that counts are gathered from (null: not). Null and empty texts are an end alone. Repeated
    rows each count and are each scored. Without training rows both scores are 0. An empty table gives an empty result. Other columns are
    not looked at. ``scanned``: ``docs`` is a plain scan of files, whose rows come in the same partitions and order each
    time; anything else is written to the shared folder first.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(train, F.lit(False)).alias("_train"), F.col("text").cast("string").alias("_text"))
    rows = rows if scanned else kept(rows)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("n")).first()["n"]
    limit = max(shard, min(2 * shard if shard < SHARD else MOST, math.isqrt(2048 * total)))
    bits, width = max(0, (total // limit).bit_length()), min(60, max(total, 1).bit_length() + 20)
    where = f"{folder(spark)}/recengine/lm-{uuid.uuid4().hex}"
    lists = rows.mapInArrow(_text.trimmed(_listed(limit, bits, width)), "kind string, bucket int, shard string, list binary")
    added = lists.groupBy("kind", "bucket").applyInArrow(_added, "kind string, bucket int, shard string, n long, total long, counts binary")
    # sums of buckets, of which there is one for each, stand under "" and are dealt by bucket
    dealt = added.repartition(F.when(F.col("shard") == "", F.col("bucket").cast("string")).otherwise(F.concat(F.lit("s"), "shard"))).sortWithinPartitions("shard", "kind", "bucket")
    summed = {r["kind"]: (r["n"], r["t"]) for r in kept(dealt.mapInArrow(_text.trimmed(_stored(where)), "kind string, n long, total long")).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("t")).collect()}
    sums = summed.get("w", (0, 0))[1], summed.get("w", (0, 0))[0], summed.get("b", (0, 0))[1]

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, CLASSES, len(GRID)))
        for name, _, _, s in _shards(batches, limit, width):
            out += _reached(where, name, s, sums).left_out()
        k, c, g = np.indices(out.shape).reshape(3, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(g), pa.array(out.ravel())], names=["order", "class", "weight", "sum"])

    # a few hundred numbers, whatever the corpus
    best = rows.mapInArrow(_text.trimmed(likely), "order int, class int, weight int, sum double").groupBy("order", "class", "weight").agg(F.sum("sum").alias("sum")).collect()
    table = np.zeros((2, CLASSES, len(GRID)))
    for r in best:
        table[r["order"], r["class"], r["weight"]] = round(r["sum"], 3)
    weights = np.array(GRID)[table.argmax(axis=2)]
    weights[~table.any(axis=2)] = 0.9

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, train, s in _shards(batches, limit, width):
            full, plain, known = _reached(where, name, s, sums).traverse(weights)
            for lo in range(0, len(ids), 10_000):
                part = slice(lo, lo + 10_000)
                yield pa.RecordBatch.from_arrays([ids[part], pa.array(~train[part]), pa.array(s.size[part].astype(np.int64)), pa.array(known[part].astype(np.int64)), pa.array(np.full(len(ids[part]), sums[0], np.int64)), pa.array(plain[part]), pa.array(full[part])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_text.trimmed(scored), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Recommenders: popularity, item neighbours, exact top-n by vectors, ALS with fold-in, re-ranking."""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recengine.functions.vectors import unit
from recengine.operators.prepare import PAIR, pairs, plays, with_last
from recengine.operators.tables import folder, get, kept, put

#: Vectors of one side are read in blocks of at most this many bytes.
BLOCK = 64 << 20


def popularity(listens: DataFrame, count: str = "users", window_days: float | None = None) -> DataFrame:
    """track_id, score: distinct users or listens, in the last ``window_days`` (start excluded) or in all."""
    if window_days is not None:
        listens = with_last(listens).where(F.col("timestamp") > F.col("_now") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_days * 86400.0)))
    score = F.count(F.lit(1)) if count == "listens" else F.countDistinct("user_id")
    return listens.groupBy("track_id").agg(score.cast("double").alias("score"))


def popular_unseen(scores: DataFrame, seen: DataFrame, n: int, users: DataFrame | None = None) -> DataFrame:
    """The ``n`` best tracks that each user has not played.

    Only the ranking's head counts: as many places as ``n`` and the most tracks that a user has played. Of a user only the places of their
    tracks in it matter: the n first numbers that are none of them are the places to show, found without a join of users and tracks.
    """
    pairs_ = seen.select(*PAIR).distinct()
    most = pairs_.groupBy("user_id").agg(F.count(F.lit(1)).alias("_h")).agg((F.coalesce(F.max("_h"), F.lit(0)) + n).alias("_most"))
    per = scores.where("score > 0").groupBy("score").agg(F.count(F.lit(1)).alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = per.withColumn("_before", before).join(F.broadcast(most)).where(F.col("_before") < F.col("_most")).drop("_m")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("score").orderBy("track_id"))
    head = kept(scores.join(level, "score").withColumn("place", place).where(F.col("place") <= F.col("_most")).select("track_id", "score", "place"))
    mine = pairs_.join(head.select("track_id", "place"), "track_id").groupBy("user_id").agg(F.array_sort(F.collect_list("place")).alias("_s"))
    everyone = (pairs_ if users is None else users).select("user_id").distinct().join(mine, "user_id", "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<bigint>")))
    last = F.aggregate("_s", F.lit(n).cast("long"), lambda p, s: F.when(s <= p, p + 1).otherwise(p))
    free = F.slice(F.array_except(F.sequence(F.lit(1).cast("long"), last), "_s"), 1, n)
    return everyone.select("user_id", F.explode(free).alias("place")).join(head, "place").select("user_id", "track_id", "score")


#: Tracks of a user that are joined with each other in one group of rows; a user with more is several groups.
CHUNK = 1024


def item_neighbours(listens: DataFrame, k: int) -> DataFrame:
    """item, neighbour, similarity: the cosine of their listeners (1 a pair); an item is its own neighbour and takes one of k places.

    Co-occurrence is a self join on the user: as many rows as the sum of squares of users' tracks, which is the matrix product. A
    user's tracks are dealt over chunks, and each pair of chunks is a key of its own, so that no key has more than CHUNK squared pairs.
    """
    p = pairs(listens)
    size = p.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    chunks = p.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_c"))
    dealt = p.join(chunks, "user_id").withColumn("_own", F.pmod(F.xxhash64("track_id"), "_c")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)))
    a = dealt.select("user_id", F.col("_own").alias("_x"), F.col("_other").alias("_y"), F.col("track_id").alias("item"))
    b = dealt.select("user_id", F.col("_other").alias("_x"), F.col("_own").alias("_y"), F.col("track_id").alias("neighbour"))
    together = a.join(b, ["user_id", "_x", "_y"]).groupBy("item", "neighbour").agg(F.count(F.lit(1)).alias("both"))
    a, b = size.select(F.col("track_id").alias("item"), F.col("n").alias("_a")), size.select(F.col("track_id").alias("neighbour"), F.col("n").alias("_b"))
    sim = together.join(a, "item").join(b, "neighbour").withColumn("similarity", F.col("both") / F.sqrt(F.col("_a") * F.col("_b")))
    order = Window.partitionBy("item").orderBy(F.round("similarity", 9).desc(), "neighbour")
    return sim.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("item", "neighbour", "similarity", "place")


def knn_unseen(listens: DataFrame, neighbours: DataFrame, n: int) -> DataFrame:
    """Unseen tracks by the sum of their similarity to the user's tracks."""
    p = pairs(listens)
    scored = p.join(neighbours, p["track_id"] == neighbours["item"]).groupBy("user_id", F.col("neighbour").alias("t")).agg(F.sum("similarity").alias("score"))
    fresh = scored.withColumnRenamed("t", "track_id").join(p, PAIR, "left_anti").where("score > 0")
    return first_n(fresh, n)


def first_n(recs: DataFrame, n: int) -> DataFrame:
    """The first n by score, ties (at nine places) by track."""
    order = Window.partitionBy("user_id").orderBy(F.round("score", 9).desc(), "track_id")
    return recs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_unseen(users: DataFrame, tracks: DataFrame, seen: DataFrame, n: int, *, only: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """user_id, track_id, score, rank: the n tracks with the highest dot product that the user has not played.

    ``users`` (user_id, vec), ``tracks`` (track_id, vec). Tasks write the tracks to the shared folder in blocks of at most ``block`` bytes; one
    pass over the users holds runs of them against one block after another and carries their n best along, so a task holds a run and
    a block, however many tracks there are, and users are never multiplied by tracks as rows.
    """
    t = tracks.select("track_id", "vec") if only is None else tracks.select("track_id", "vec").join(only.select("track_id").distinct(), "track_id", "left_semi")
    return _searched(users, t, seen, n, nearest, block)


def folded_unseen(listens: DataFrame, tracks: DataFrame, n: int, *, made: Callable[[np.ndarray], np.ndarray] | None = None, block: int = BLOCK) -> DataFrame:
    """What ``top_unseen`` gives for users folded in from ``listens``: each is the direction of the average of the unit vectors of their tracks.

    A user's tracks travel once, as ids: the task that searches for the user adds up their vectors from the blocks that it searches, so
    no vector is shuffled for a pair. A user without a track that has a vector gets no list. ``made`` gives the vectors of rows of ``vec``, if
    these are not the vectors themselves.
    """
    paths = _blocks(listens.sparkSession, tracks.select("track_id", "vec"), block, made)
    least = max(RUN, min(4 * RUN, (32 << 20) // (16 * n)))  # every run reads all blocks
    dealt = listens.select(*PAIR).repartition(4 * listens.sparkSession.sparkContext.defaultParallelism, "user_id")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[Asked]:
        for run in _histories(batches, least):
            who = run.column("user_id").dictionary_encode("encode")
            owner, had = who.indices.to_numpy().astype(np.int64), run.column("track_id")
            vecs, found = _directions(owner, had, map(_block, reversed(paths)), len(who.dictionary))
            some = np.flatnonzero(found)
            if len(some):
                inside = found[owner] > 0
                yield who.dictionary.take(pa.array(some)), vecs[some], np.searchsorted(some, owner[inside]), had.filter(pa.array(inside))

    return _listed(dealt.distinct().sortWithinPartitions("user_id"), asked, paths, tracks, n, nearest)


def _searched(users: DataFrame, tracks: DataFrame, seen: DataFrame, n: int, search: Search, block: int) -> DataFrame:
    """user_id, track_id, score, rank by ``search``, which gets runs of users and the tracks' block files."""
    paths = _blocks(users.sparkSession, tracks, block)
    history = seen.groupBy("user_id").agg(F.collect_set("track_id").alias("_seen"))
    # each user costs as much as all tracks have places: as many tasks as keep all cores busy to the end, which sizes in bytes would not give
    rows = users.select("user_id", "vec").join(history, "user_id", "left").repartition(4 * users.sparkSession.sparkContext.defaultParallelism, "user_id")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[Asked]:
        for run in _runs(batches, RUN if len(paths) > 1 else 1):
            had = run.column("_seen")
            yield run.column("user_id"), _matrix(run.column("vec")), pc.list_parent_indices(had).to_numpy(), pc.list_flatten(had)

    return _listed(rows, asked, paths, tracks, n, search)


#: Users, their vectors, and (user's number, track) for what they have.
Asked = tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]


def _listed(rows: DataFrame, asked: Callable[[Iterator[pa.RecordBatch]], Iterator[Asked]], paths: list[str], tracks: DataFrame, n: int, search: Search) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for users, vecs, who, had in asked(batches):
            names: list[pa.Array] = []

            def blocks(names: list[pa.Array] = names) -> Iterator[Block]:
                for path in paths:  # in order of track_id, so that of equal scores the earlier place is the smaller id
                    names.append((b := _block(path)).ids)
                    yield b

            best, where = search(vecs, who, had, blocks(), n)
            some = np.isfinite(best)
            if not some.any():
                continue
            rank = np.broadcast_to(np.arange(1, n + 1, dtype=np.int32), best.shape)
            whose = users.take(pa.array(np.repeat(np.arange(len(users)), some.sum(axis=1))))
            yield pa.RecordBatch.from_arrays([whose, pa.concat_arrays(names).take(pa.array(where[some])), pa.array(best[some]), pa.array(rank[some])], names=["user_id", "track_id", "score", "rank"])

    return rows.mapInArrow(task, f"user_id {dict(rows.dtypes)['user_id']}, track_id {dict(tracks.dtypes)['track_id']}, score double, rank int")


#: Users that are held against all blocks together, if there are several, and bytes of their rows.
RUN, RUN_BYTES = 8192, 32 << 20
#: Users and distinct vectors whose products are looked at together while users have no n tracks; vectors at once after that; places that are put in order together.
TILE, NARROW, HELD = (1024, 4096), 256, 1 << 14


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    held, size, room = [], 0, 0
    for b in batches:
        if len(b):
            held.append(b)
            size += len(b)
            room += b.nbytes
        if held and (size >= least or room >= RUN_BYTES):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, room = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _histories(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows in order of user_id that end where a user's rows end."""
    held, users, room, most = [], 0, 0, RUN_BYTES
    for b in batches:
        if len(b):
            held.append(b)
            users += len(b.column("user_id").unique())
            room += b.nbytes
        if held and (users >= least or room >= most):
            run = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            number = run.column("user_id").dictionary_encode("encode").indices.to_numpy()
            if cut := int(np.searchsorted(number, number[-1])):
                yield run.slice(0, cut)
            held, users, room = [run.slice(cut)], 1, run.slice(cut).nbytes
            most = max(RUN_BYTES, 2 * room)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    size = pc.min_max(pc.list_value_length(lists)).as_py()
    if lists.null_count or size["min"] != size["max"]:
        raise ValueError("vectors have to be there and to have one length")
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), size["min"])


@dataclass
class Block:
    """Tracks in order of their ids. Equal vectors are one row of ``matrix``: ``of`` has the row of each track, ``members`` the tracks of row k from ``begin[k]``."""

    ids: pa.Array
    matrix: np.ndarray
    of: np.ndarray

    def __post_init__(self) -> None:
        alike = len(self.matrix) < len(self.of)  # else every track has a row of its own, in their order
        self.members = np.argsort(self.of, kind="stable") if alike else self.of
        self.begin = np.r_[0, np.cumsum(np.bincount(self.of, minlength=len(self.matrix)))]
        self.longest = float(np.sqrt(np.einsum("ij,ij->i", self.matrix, self.matrix)).max(initial=0.0))
        self.short: np.ndarray | None = self.matrix.astype(np.float32) if self.longest < 1e15 else None


Search = Callable[[np.ndarray, np.ndarray, pa.Array, Iterator[Block], int], tuple[np.ndarray, np.ndarray]]


def _blocks(spark: SparkSession, tracks: DataFrame, limit: int, made: Callable[[np.ndarray], np.ndarray] | None = None) -> list[str]:
    """Files of (ids, distinct vectors, which is whose) in order of track_id, each of at most about ``limit`` bytes with its ids. The driver gets their names."""
    where = f"{folder(spark)}/vectors-{uuid.uuid4().hex}"
    kind = {"bigint": pa.int64(), "int": pa.int32()}.get(dict(tracks.dtypes)["track_id"], pa.string())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids, vecs, size, number = TaskContext.get().partitionId(), [], [], 0, 0

        def done() -> pa.RecordBatch:
            put(path := f"{where}/{part}-{number}-{size}", pickle.dumps((pa.concat_arrays(ids), *_distinct(np.concatenate(vecs))), protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int32()), pa.array([number], pa.int32())], names=["path", "part", "number"])

        for batch in batches:
            if not len(batch):
                continue
            named, rows = batch.column("track_id").cast(kind), _matrix(batch.column("vec"))
            rows = made(rows) if made else rows
            most, low = -(-limit // (8 * rows.shape[1] + 128)), 0
            while low < len(batch):
                high = min(len(batch), low + most - size)
                ids.append(named.slice(low, high - low))
                vecs.append(rows[low:high])
                size, low = size + high - low, high
                if size >= most:
                    yield done()
                    ids, vecs, size, number = [], [], 0, number + 1
        if ids:
            yield done()

    dealt = tracks.repartitionByRange("track_id").sortWithinPartitions("track_id")
    found = dealt.mapInArrow(task, "path string, part int, number int").collect()
    return [r["path"] for r in sorted(found, key=lambda r: (r["part"], r["number"]))]


def _distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, in the order in which they first come, and which of them each row is."""
    vectors = vectors + 0.0  # one zero
    _, first, of = np.unique(vectors.view(f"V{8 * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.argsort(first)
    turn = np.empty_like(order)
    turn[order] = np.arange(len(order))
    return vectors[first[order]], turn[of.ravel()]


def _block(path: str) -> Block:
    """A block; a worker keeps the one it used last."""
    if not _LAST or _LAST[0] != path:
        _LAST.clear()
        _LAST[:] = path, Block(*pickle.loads(get(path)))
    return _LAST[1]


_LAST: list = []


def _held(who: np.ndarray, had: pa.Array, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Of (``who``, ``had``) those in the block, each with its place there; an id that is there several times is as many rows."""
    at = pc.index_in(had, value_set=b.ids, skip_nulls=True)
    mine = at.is_valid().to_numpy(zero_copy_only=False)
    owner, at = who[mine].astype(np.int64), at.drop_null().to_numpy().astype(np.int64)
    number = b.ids.dictionary_encode("encode").indices.to_numpy()
    if len(number) and number[-1] + 1 < len(number):
        size = np.bincount(number)[number[at]]
        owner, at = np.repeat(owner, size), np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    return owner, at


#: Vectors that are added up together.
ADDED = 1 << 14


def _directions(owner: np.ndarray, had: pa.Array, blocks: Iterator[Block], users: int) -> tuple[np.ndarray, np.ndarray]:
    """Per user the direction of the sum of the unit vectors of what they have, and of how many; ``owner`` is in order."""
    total, found = np.zeros((users, 0)), np.zeros(users, np.int64)
    for b in blocks:
        if not total.shape[1]:
            total = np.zeros((users, b.matrix.shape[1]))
        whose, at = _held(owner, had, b)
        found += np.bincount(whose, minlength=users)
        for low in range(0, len(at), ADDED):
            rows, mine = b.matrix[b.of[at[low : low + ADDED]]], whose[low : low + ADDED]
            start = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            total[mine[start]] += np.add.reduceat(unit_rows(rows), start)
    return unit_rows(total), found


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; an all-zero one stays zero."""
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def nearest(wanted: np.ndarray, who: np.ndarray, had: pa.Array, blocks: Iterator[Block], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, place among all tracks) of the n best of each row of ``wanted``, without those that it has (``who`` has ``had``); -inf where there are fewer.

    Scores are rounded to 12 places, ordered by nine and then by place. Products in single precision, with a bound on their error, tell which tracks
    may be among the n best so far; only those are computed in double precision and put in order, some thousands at once. Equal vectors are computed once.

    Users that are averages lie near one direction, their lead. Tracks come in order of their part along it, and as a product is that of the parts along the
    lead plus at most that of the lengths across it, most users need no product with tracks far down: nothing that may count is left out.
    """
    best, where = np.full((len(wanted), n), -np.inf), np.full((len(wanted), n), -1)
    length, slim = np.sqrt((wanted**2).sum(axis=1)), wanted.astype(np.float32) if np.abs(wanted).max(initial=0.0) < 1e15 else None
    lead = _lead(wanted, length) if slim is not None else None
    along = across = np.zeros(0)
    if lead is not None:
        along = wanted @ lead
        across = _across(length, along)
    room = {k: (np.empty(TILE[0] * NARROW, k), np.empty(TILE[0] * NARROW, bool)) for k in (np.float32, np.float64)}  # pages that are not touched cost nothing
    first = 0
    for b in blocks:
        single = slim is not None and b.short is not None
        rows_, columns = (slim, b.short) if single else (wanted, b.matrix)
        order, place, led = np.arange(len(columns)), b.members[b.begin[:-1]], lead is not None and single
        down = beside = slack = np.zeros(0)
        if led:
            down = b.matrix @ lead
            order = np.argsort(-down, kind="stable")
            beside = _across(np.sqrt(np.einsum("ij,ij->i", b.matrix, b.matrix)), down)[order]
            down, columns, place, slack = down[order], columns[order], place[order], 1e-12 * length * b.longest
        error = (wanted.shape[1] + 8) * 2.0**-23 * length * b.longest + 1e-30
        owner, at = _held(who, had, b)
        taken, few = np.sort(owner * len(b.ids) + at), np.bincount(owner, minlength=len(wanted))
        for low in range(0, len(wanted), TILE[0]):
            part = slice(low, low + TILE[0])
            own = taken[slice(*np.searchsorted(taken, [low * len(b.ids), (low + TILE[0]) * len(b.ids)]))] - low * len(b.ids)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            left = held = 0
            floor = None
            while left < len(columns):
                if floor is None:
                    worst = np.round(best[part, -1], 9)
                    floor = worst - error[part] - np.abs(worst) * 2.0**-23
                    new = np.flatnonzero(np.isneginf(worst))
                right = min(len(columns), left + (NARROW if not len(new) else TILE[1] if not led else max(TILE[1] // 4, 4 * (n + int(few[part].max())))))
                later = where[part, -1] < first + place[left:right].min()  # of ties the earlier place stays, so what comes later has to be above
                limit = floor + np.where(later, 4e-10, -1e-9)
                limit[~np.isfinite(limit)] = -np.inf
                x, y = rows_[part], columns[left:right]
                some = None
                if len(new):
                    product = x @ y.T
                    if (k := n + int(few[part][new].max())) < product.shape[1]:
                        limit[new] = np.partition(product[new], product.shape[1] - k, axis=1)[:, product.shape[1] - k] - 2 * error[part][new]
                        limit[~np.isfinite(limit)] = -np.inf
                    hit = product >= limit[:, None].astype(product.dtype)
                else:
                    if led:
                        most = np.maximum(along[part] * down[left], along[part] * down[right - 1]) + across[part] * beside[left:right].max() + slack[part]
                        if len(some := np.flatnonzero(~(most < limit))) < len(x):
                            x, limit = x[some], limit[some]
                        else:
                            some = None
                    product, hit = (z[: len(x) * len(y)].reshape(len(x), len(y)) for z in room[x.dtype.type])
                    np.greater_equal(np.matmul(x, y.T, out=product), limit[:, None].astype(product.dtype), out=hit)
                row, column = _places(hit)
                found.append((row if some is None else some[row], order[column + left]))
                held, left = held + len(row), right
                if len(new) or held >= HELD or left >= len(columns):
                    row, column = (np.concatenate(z) for z in zip(*found, strict=True))
                    found, held, floor = [], 0, None
                    for cut in range(0, len(row), 1 << 16):
                        r, c = row[cut : cut + (1 << 16)], column[cut : cut + (1 << 16)]
                        score = np.round(np.einsum("ij,ij->i", wanted[part][r], b.matrix[c]), 12)
                        rounded, last = np.round(score, 9), np.round(best[part, -1], 9)[r]
                        counts = np.isfinite(score) & ((rounded > last) | (rounded == last) & (first + b.members[b.begin[c]] < where[part, -1][r]))
                        _merged(best[part], where[part], r[counts], c[counts], score[counts], b, few[part], own, first)
        first += len(b.ids)
    return best, where


def _lead(vectors: np.ndarray, length: np.ndarray) -> np.ndarray | None:
    """The direction of the average, if the vectors are near enough to it for a bound by it to leave something out."""
    mean = vectors.mean(axis=0) if len(vectors) else np.zeros(0)
    size = float(np.sqrt(mean @ mean))
    return mean / size if size > 0.5 * length.mean() else None


def _across(length: np.ndarray, along: np.ndarray) -> np.ndarray:
    """At least the length across the lead, with room for what rounding takes."""
    return np.sqrt(np.maximum(length**2 - along**2, 0.0) + 1e-12 * length**2)


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` where nearly nothing is: eight at a time."""
    flat, rest = hit.ravel(), hit.size % 8
    eights = np.flatnonzero(flat[: hit.size - rest].view(np.uint64) != 0) * 8
    among = np.flatnonzero(flat[(eights[:, None] + np.arange(8)).ravel()]) if len(eights) else eights
    at = np.concatenate([eights[among >> 3] + (among & 7), hit.size - rest + np.flatnonzero(flat[hit.size - rest :])])
    return np.divmod(at, hit.shape[1])


def _merged(best: np.ndarray, where: np.ndarray, row: np.ndarray, column: np.ndarray, score: np.ndarray, b: Block, few: np.ndarray, taken: np.ndarray, first: int) -> None:
    """Puts the tracks of distinct vectors, with their scores, among the n best; of equal vectors as many tracks as can count are looked at."""
    if not len(row):
        return
    n = best.shape[1]
    size = np.minimum(b.begin[column + 1] - b.begin[column], n + few[row])
    start = np.cumsum(size) - size
    place = b.members[np.arange(int(size.sum())) + np.repeat(b.begin[column] - start, size)]
    row, score = np.repeat(row, size), np.repeat(score, size)
    if len(taken):
        key = row * len(b.ids) + place
        fresh = taken[np.minimum(np.searchsorted(taken, key), len(taken) - 1)] != key
        row, score, place = row[fresh], score[fresh], place[fresh]
    some = np.unique(row)
    old = np.isfinite(best[some])
    row = np.concatenate([np.repeat(some, old.sum(axis=1)), row])
    score = np.concatenate([best[some][old], score])
    place = np.concatenate([where[some][old], place + first])
    order = np.lexsort((place, -np.round(score, 9), row))
    row, score, place = row[order], score[order], place[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    top = rank < n
    best[some], where[some] = -np.inf, -1
    best[row[top], rank[top]], where[row[top], rank[top]] = score[top], place[top]


def plainly(wanted: np.ndarray, who: np.ndarray, had: pa.Array, blocks: Iterator[Block], n: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``nearest`` gives, from all products in double precision: every row's scores are selected from and sorted by themselves."""
    best, where = np.full((len(wanted), n), -np.inf), np.full((len(wanted), n), -1)
    first = 0
    for b in blocks:
        owner, at = _held(who, had, b)
        for low in range(0, len(wanted), 32):
            scores = np.round(wanted[low : low + 32] @ b.matrix[b.of].T, 12)
            inside = (owner >= low) & (owner < low + 32)
            scores[owner[inside] - low, at[inside]] = -np.inf
            for k, x in enumerate(scores, low):
                every, places = np.concatenate([best[k], x]), np.concatenate([where[k], np.arange(first, first + len(x))])
                rounded = np.round(every, 9)
                some = np.flatnonzero(rounded >= np.partition(rounded, len(rounded) - n)[len(rounded) - n])
                order = some[np.lexsort((places[some], -rounded[some]))][:n]
                best[k], where[k] = every[order], places[order]
        first += len(b.ids)
    return best, where


def agreement(lists: DataFrame, users: DataFrame, tracks: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """One row: the share of ``lists`` (user_id, track_id, rank) that are those of plain sorting, for the ``users`` (user_id, vec) of a small check.

    All products are formed, a few users by a block at a time; users are never multiplied by tracks as rows, so nothing of that size reaches a disk.
    """
    plain = _searched(users, tracks.select("track_id", "vec"), seen.join(users.select("user_id"), "user_id", "left_semi"), n, plainly, BLOCK)
    both = plain.select(*PAIR, F.col("rank").alias("_r")).join(lists.select(*PAIR, "rank"), PAIR, "left")
    return both.agg(F.avg(F.coalesce((F.col("rank") == F.col("_r")).cast("double"), F.lit(0.0))).alias("agreement"))


def random_vectors(ids: DataFrame, column: str, dim: int, seed: str) -> DataFrame:
    """column, vec: normal numbers that depend on id and seed alone (Box-Muller on 32 bits of md5): scores with no information at all."""
    u = lambda k: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(column).cast("string"), F.lit(str(k)))), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    normal = lambda k: F.sqrt(-2 * F.log(u(2 * k))) * F.cos(2 * math.pi * u(2 * k + 1))
    return ids.select(column).distinct().select(column, F.array(*(normal(k) for k in range(dim))).alias("vec"))


def similar_tracks(tracks: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """track_id, other, score: the n nearest other tracks of each wanted one by cosine."""
    unit_ = tracks.select("track_id", unit("vec").alias("vec"))
    asked = unit_.join(wanted.select("track_id").distinct(), "track_id", "left_semi").withColumnRenamed("track_id", "user_id")
    itself = wanted.select(F.col("track_id").alias("user_id"), "track_id").distinct()
    return top_unseen(asked, unit_, itself, n).select(F.col("user_id").alias("track_id"), F.col("track_id").alias("other"), "score", "rank")


def als(listens: DataFrame, factors: int, regularisation: float, alpha: float, rounds: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Implicit ALS with confidence alpha * log(1 + plays): (user_id, vec) and (track_id, vec).

    Each half step solves every row's normal equations in the executors from the other side's Gram matrix (factors x factors,
    summed in the map tasks) and the vectors of the row's own cells, which a join brings: neither side is ever broadcast.
    """
    cells = kept(plays(listens).select(*PAIR, (F.lit(alpha) * F.col("log_plays")).alias("c")))
    tracks = kept(cells.select("track_id").distinct().withColumn("vec", F.array(*(F.lit(0.1) * ((F.xxhash64(F.lit(seed + k), "track_id").bitwiseAND((1 << 32) - 1)) / F.lit(float(1 << 31)) - 1) for k in range(factors)))))
    users = tracks
    for _ in range(rounds):
        users = kept(_solved(cells, tracks, "track_id", "user_id", factors, regularisation))
        tracks = kept(_solved(cells, users, "user_id", "track_id", factors, regularisation))
    return users, tracks


def gram(vectors: DataFrame, factors: int) -> np.ndarray:
    one = vectors.agg(F.array(*(F.sum(F.col("vec")[i] * F.col("vec")[j]) for i in range(factors) for j in range(factors)))).first()[0]
    return np.array(one, float).reshape(factors, factors)


def _solved(cells: DataFrame, fixed: DataFrame, on: str, by: str, factors: int, regularisation: float) -> DataFrame:
    return fold_in(cells.join(fixed, on), by, gram(fixed, factors), regularisation)


def fold_in(cells: DataFrame, by: str, whole: np.ndarray, regularisation: float) -> DataFrame:
    """(by, vec): x of (Y'Y + rI + Yu'(C - I)Yu) x = Yu'C1 for each ``by`` of ``cells`` (by, c, vec), where ``whole`` is Y'Y.

    What a row needs of its cells is a factors x factors matrix and a vector, which are sums: they are added up in the map tasks
    first, so a row with very many cells is no more work for its last task than any other.
    """
    factors = len(whole)
    v, c = F.col("vec"), F.col("c")
    upper = [(i, j) for i in range(factors) for j in range(i, factors)]
    sums = cells.groupBy(by).agg(F.array(*(F.sum((c - 1) * v[i] * v[j]) for i, j in upper)).alias("a"), F.array(*(F.sum(c * v[i]) for i in range(factors))).alias("b"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns = np.array(upper).T
        for batch in batches:
            a = np.zeros((len(batch), factors, factors))
            if len(batch):
                a[:, rows, columns] = a[:, columns, rows] = np.array(batch.column("a").to_pylist(), float)
                x = np.linalg.solve(whole + regularisation * np.eye(factors) + a, np.array(batch.column("b").to_pylist(), float)[:, :, None])[:, :, 0]
                yield pa.RecordBatch.from_arrays([batch.column(by), pa.array(x.tolist(), pa.list_(pa.float64()))], names=[by, "vec"])

    return sums.mapInArrow(task, f"{by} {dict(sums.dtypes)[by]}, vec array<double>")


def pool(rows: DataFrame, top: int, known_artist: int) -> Column:
    """The candidates to reorder: the first ``top``, and of those below the first ``known_artist`` by an artist the user has played."""
    below = (F.col("tt_rank") > top) & (F.coalesce("artist_tracks", F.lit(0.0)) > 0)
    running = F.sum(below.cast("int")).over(Window.partitionBy("user_id").orderBy("tt_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (F.col("tt_rank") <= top) | (below & (running <= known_artist))


def training_rows(rows: DataFrame, in_pool: Column) -> DataFrame:
    """Pool rows of the users who have a positive among them."""
    inside = rows.withColumn("_in", in_pool).where("_in").drop("_in")
    return inside.withColumn("_any", F.max("label").over(Window.partitionBy("user_id"))).where("_any = 1").drop("_any")


def rerank(rows: DataFrame, model: str, in_pool: Column) -> DataFrame:
    """Final lists: pool rows by the model (ties in retrieval order), then the rest in retrieval order; the score is minus the place."""
    marked = rows.withColumn("_in", in_pool)
    key = F.when(F.col("_in"), 0).otherwise(1), F.when(F.col("_in"), -F.col(model)).asc_nulls_last(), "tt_rank"
    return marked.select(*PAIR, (-F.row_number().over(Window.partitionBy("user_id").orderBy(*key))).cast("double").alias("score"))

"""The ranking snapshot: 25 columns for each user and candidate, as of the last listen of a history."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recengine.operators import recommend
from recengine.operators.prepare import PAIR, pairs
from recengine.operators.tables import blocks, get, kept

#: The snapshot's columns.
FEATURES = [
    "tt_rank", "tt_z", "als_rank", "als_z", "track_listeners", "track_listeners_recent", "track_listeners_short", "track_recent_share",
    "track_discovery_rate", "user_tracks", "user_plays_recent", "user_new_share", "user_mainstream", "user_days_since_last", "recent_affinity",
    "sim_audio", "sim_lyrics", "sim_genres", "pop_gap", "artist_tracks", "artist_play_share", "artist_days_since", "artist_catalog_share",
    "album_tracks", "artist_listeners",
]
DAY = 86_400_000_000  # microseconds


def micros(at: Column | str) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.unix_micros(at.cast("timestamp"))


def first_last(history: DataFrame) -> DataFrame:
    """user_id, track_id, first, last (microseconds) and plays."""
    return history.groupBy(*PAIR).agg(F.min(micros("timestamp")).alias("first"), F.max(micros("timestamp")).alias("last"), F.count(F.lit(1)).alias("plays"))


def population(history: DataFrame) -> DataFrame:
    """One row: now, the time of the last listen in microseconds."""
    return history.agg(F.max(micros("timestamp")).alias("now"))


def track_stats(p: DataFrame, now: DataFrame, recent: int, short: int) -> DataFrame:
    """Per track, from first_last: listeners in all, lately (last play after the start), this week; shares; percentile."""
    x = p.join(F.broadcast(now))
    after = lambda c, days: F.count_if(F.col(c) > F.col("now") - days * DAY)
    t = x.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), after("last", recent).alias("r"), after("last", short).alias("s"), after("first", recent).alias("f"))
    # the share of tracks with no more listeners, by distinct counts: the ordered pass is not over tracks
    per = t.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    pct = per.select("n", (F.sum("m").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("m").over(Window.partitionBy())).alias("track_pct"))
    return t.join(F.broadcast(pct), "n").select(
        "track_id", F.log1p("n").alias("track_listeners"), F.log1p("r").alias("track_listeners_recent"), F.log1p("s").alias("track_listeners_short"),
        (F.col("r") / F.col("n")).alias("track_recent_share"), F.try_divide("f", "r").alias("track_discovery_rate"), "track_pct", F.col("n").alias("listeners"),
    )


def user_stats(p: DataFrame, history: DataFrame, now: DataFrame, pct: DataFrame, recent: int) -> DataFrame:
    """Per user, from first_last and the listens themselves."""
    x = p.join(pct.select("track_id", "track_pct"), "track_id").join(F.broadcast(now))
    after = lambda c: F.count_if(F.col(c) > F.col("now") - recent * DAY)
    u = x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), after("last").alias("r"), after("first").alias("f"), F.avg("track_pct").alias("user_mainstream"), F.max("last").alias("l"), F.max("now").alias("now"))
    lately = history.join(F.broadcast(now)).where(micros("timestamp") > F.col("now") - recent * DAY).groupBy("user_id").agg(F.count(F.lit(1)).alias("_p"))
    return u.join(lately, "user_id", "left").select(
        "user_id", F.log1p("n").alias("user_tracks"), F.log1p(F.coalesce("_p", F.lit(0))).alias("user_plays_recent"), F.try_divide("f", "r").alias("user_new_share"),
        "user_mainstream", ((F.col("now") - F.col("l")) / DAY).alias("user_days_since_last"),
    )


def artist_stats(p: DataFrame, tracks: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(user_id, artist, ...) and (user_id, album, ...) of what users have played, and (artist, ...) of who plays it."""
    x = p.join(tracks.select("track_id", "artist", "album"), "track_id")
    everything = p.groupBy("user_id").agg(F.sum("plays").alias("_all"))
    catalog = tracks.groupBy("artist").agg(F.count(F.lit(1)).alias("_catalog"))
    by_artist = x.groupBy("user_id", "artist").agg(F.count(F.lit(1)).alias("_n"), F.sum("plays").alias("_p"), F.max("last").alias("_l"))
    own = by_artist.join(everything, "user_id").join(catalog, "artist").join(F.broadcast(now)).select(
        "user_id", "artist", F.log1p("_n").alias("artist_tracks"), (F.col("_p") / F.col("_all")).alias("artist_play_share"),
        ((F.col("now") - F.col("_l")) / DAY).alias("artist_days_since"), (F.col("_n") / F.col("_catalog")).alias("artist_catalog_share"),
    )
    albums = x.groupBy("user_id", "album").agg(F.log1p(F.count(F.lit(1))).alias("album_tracks"))
    fans = by_artist.groupBy("artist").agg(F.log1p(F.count(F.lit(1))).alias("artist_listeners"))
    return own, albums, fans


def zscore(value: str, sample: bool = False) -> Column:
    """Within a user's rows: (x - mean) / deviation of the population (or of a sample); a constant or single value gives 0."""
    w = Window.partitionBy("user_id")
    sd = (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(F.lit(0.0))


def snapshot(candidates: DataFrame, history: DataFrame, tracks: DataFrame, vectors: DataFrame, als_users: DataFrame | None, dims: dict[str, int], *, recent: int = 28, short: int = 7, labels: DataFrame | None = None, everyone: DataFrame | None = None, trained: int | None = None) -> DataFrame:
    """``candidates`` (user_id, track_id, score, rank) with the 25 features, and label if ``labels`` (listens to come) are given.

    ``vectors``: track_id, tt, als, audio, lyrics, genres. ``als_users``: if None, the direction of the average of a user's tracks. ``everyone``: all listens,
    if ``history`` has those of some users only; then a user's rows are what they would be among everyone's. ``trained``: only the first so many places
    of users with a positive among them. Missing values are null.

    A user's plays, candidates and labels travel once, as ids and a few numbers, to the task that has the user; what it needs to know of tracks, and
    their vectors, it reads from block files, one after another, so that no row travels with a vector or again for each join.
    """
    spark, all_ = candidates.sparkSession, history if everyone is None else everyone
    now = population(all_).first()[0] or 0
    at = spark.range(1).select(F.lit(now).cast("long").alias("now"))
    # a row for each pair that was played: written once, read by every statistic
    played = history.groupBy(*PAIR).agg(
        F.min(micros("timestamp")).alias("first"), F.max(micros("timestamp")).alias("last"), F.count(F.lit(1)).alias("plays"), F.count_if(micros("timestamp") > now - recent * DAY).alias("lately"),
    )
    p = kept(played)
    p_all = p if everyone is None else kept(first_last(all_))
    paths = _track_blocks(p_all, track_stats(p_all, at, recent, short), tracks, vectors)
    every = [F.concat("tt", "als", "audio", "lyrics", "genres").alias("vec")]
    sides = recommend._blocks(spark, vectors.select("track_id", *every), recommend.BLOCK)
    none, kind = F.lit(None).cast("array<double>"), dict(candidates.dtypes)
    row = lambda df, k, track="track_id", a=0, b=0, c=0, d=0, x=0.0, vec=none: df.select("user_id", F.lit(k).cast("tinyint").alias("kind"), F.col(track).alias("track_id"), *(F.col(v).cast("long").alias(n) if isinstance(v, str) else F.lit(v).cast("long").alias(n) for n, v in (("a", a), ("b", b), ("c", c), ("d", d))), (F.col(x).cast("double") if isinstance(x, str) else F.lit(x)).alias("x"), vec.alias("vec"))
    rows = row(p, 0, a="first", b="last", c="plays", d="lately").unionByName(row(candidates, 1, a="rank", x="score"))
    if labels is not None:
        rows = rows.unionByName(row(pairs(labels), 2))
    if als_users is not None:
        rows = rows.unionByName(row(als_users.withColumn("track_id", F.lit(None).cast(kind["track_id"])), 3, vec=F.col("vec")))
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(tasks, "user_id").sortWithinPartitions("user_id")
    folded, after = als_users is None, now - recent * DAY

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in recommend._histories(batches, recommend.RUN):
            yield from _featured(run, paths, sides, dims, now, after, folded, trained)

    made = dealt.mapInArrow(task, f"user_id {kind['user_id']}, track_id {kind['track_id']}, " + ", ".join(f"{f} {_WHOLE.get(f, 'double')}" for f in FEATURES) + ", label int")
    return made.withColumn("tt_rank", F.col("tt_rank").cast(kind["rank"])).select(*PAIR, *FEATURES, *(["label"] if labels is not None else []))


_WHOLE = {"tt_rank": "long", "als_rank": "int"}
#: Tracks of a block file of what is known of tracks; candidates whose vectors are looked at together.
TRACKS, TOGETHER = 1 << 17, 1 << 13
_KNOWN = ["track_listeners", "track_listeners_recent", "track_listeners_short", "track_recent_share", "track_discovery_rate", "track_pct", "_catalog", "artist_listeners"]


def _track_blocks(p: DataFrame, stats: DataFrame, tracks: DataFrame, vectors: DataFrame) -> list[str]:
    """Files of what is known of the tracks that were played or may be candidates, in order of track_id: artist, album, statistics."""
    named = tracks.select("track_id", "artist", "album")
    catalog = tracks.groupBy("artist").agg(F.count(F.lit(1)).cast("double").alias("_catalog"))
    # a user counts once for an artist, whatever they played of theirs
    fans = p.select(*PAIR).join(named.select("track_id", "artist"), "track_id").select("user_id", "artist").distinct().groupBy("artist").agg(F.log1p(F.count(F.lit(1))).alias("artist_listeners"))
    stats = kept(stats)
    needed = vectors.select("track_id").unionByName(stats.select("track_id")).distinct()
    mine = named.join(needed, "track_id", "left_semi").withColumn("_listed", F.lit(True))
    x = mine.join(stats, "track_id", "full_outer").join(catalog, "artist", "left").join(fans, "artist", "left")
    return blocks(x.select("track_id", "artist", "album", F.coalesce("_listed", F.lit(False)).alias("_listed"), *_KNOWN), "track_id", TRACKS)


@dataclass
class _Known:
    ids: pa.Array
    rows: pa.RecordBatch


def _each(paths: list[str], load: Callable) -> Iterator:
    """Blocks; a worker keeps the one it used last of a kind, and the next run goes the other way."""
    for path in sorted(paths, key=lambda p: p != _LAST.get(load, (None,))[0]):
        if _LAST.get(load, (None,))[0] != path:
            _LAST.pop(load, None)
            _LAST[load] = path, load(path)
        yield _LAST[load][1]


_LAST: dict = {}


def _known(path: str) -> _Known:
    rows = pa.ipc.open_stream(get(path)).read_all().combine_chunks().to_batches()[0]
    return _Known(rows.column("track_id"), rows)


@dataclass
class _Sides:
    ids: pa.Array
    matrix: np.ndarray
    of: np.ndarray


def _sides(path: str) -> _Sides:
    return _Sides(*pickle.loads(get(path)))


def _codes(texts: list[pa.Array]) -> np.ndarray:
    """A number for each distinct text, -1 where there is none."""
    if not texts:
        return np.zeros(0, np.int64)
    return pa.concat_arrays(texts).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _groups(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (owner, code) as ordered numbers, and which of them each is."""
    return np.unique((owner << 32) + code + 1, return_inverse=True)


def _among(keys: np.ndarray, owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where (owner, code) are in ``keys``, and whether; no code is in none."""
    wanted = (owner << 32) + code + 1
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) & (code >= 0) if len(keys) else np.zeros(len(wanted), bool)


def _in_order_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows' products, added from the first place to the last, so that equal rows have equal ones."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _standard(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """``zscore`` of rows in order of owner; taken from the first value, equal values have no deviation at all."""
    if not len(x):
        return x
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[start, len(x)])
    d = x - np.repeat(x[start], size)
    d = d - np.repeat(np.add.reduceat(d, start) / size, size)
    sd = np.repeat(np.sqrt(np.add.reduceat(d * d, start) / size), size)
    return np.divide(d, sd, out=np.zeros_like(d), where=sd > 0)


def _featured(run: pa.RecordBatch, paths: list[str], sides: list[str], dims: dict[str, int], now: int, after: int, folded: bool, trained: int | None) -> Iterator[pa.RecordBatch]:
    """The snapshot of a run of users, whose rows are there in order of user_id."""
    who = run.column("user_id").dictionary_encode("encode")
    users, owner, kind, ids = len(who.dictionary), who.indices.to_numpy().astype(np.int64), run.column("kind").to_numpy(), run.column("track_id")
    a, last, plays, lately, score = (run.column(c).to_numpy() for c in ("a", "b", "c", "d", "x"))
    play, cand = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if not len(cand):
        return
    # what is known of tracks
    either = np.flatnonzero(kind < 2)
    found: list[tuple] = []
    for b in _each(paths, _known):
        row, at = recommend._held(either, ids.take(pa.array(either)), b)
        some = b.rows.take(pa.array(at))
        found.append((row, some.column("artist"), some.column("album"), some.column("_listed").to_numpy(zero_copy_only=False), np.stack([some.column(c).to_numpy(zero_copy_only=False) for c in _KNOWN], axis=1)))
    if not found:
        return
    row, listed, known = (np.concatenate([f[k] for f in found]) for k in (0, 3, 4))
    artist, album = _codes([f[1] for f in found]), _codes([f[2] for f in found])
    del found
    count = lambda x, w=None: np.bincount(x, w, users)
    # users, from what they played
    mine = kind[row] == 0
    pct = known[:, _KNOWN.index("track_pct")]
    once = np.unique(row[mine & ~np.isnan(pct)], return_index=True)
    at, share = once[0], pct[mine & ~np.isnan(pct)][once[1]]
    o = owner[at]
    n, r, f = count(o), count(o[last[at] > after]), count(o[a[at] > after])
    latest = np.full(users, np.iinfo(np.int64).min)
    np.maximum.at(latest, o, last[at])
    with np.errstate(invalid="ignore", divide="ignore"):
        user = {
            "user_tracks": np.where(n > 0, np.log1p(n), np.nan), "user_plays_recent": np.where(n > 0, np.log1p(count(owner[play], lately[play])), np.nan), "user_new_share": np.where(r > 0, f / r, np.nan),
            "user_mainstream": count(o, share) / n, "user_days_since_last": np.where(n > 0, (now - np.where(n > 0, latest, 0)) / DAY, np.nan),
        }
    everything = count(owner[play], plays[play])
    x = mine & listed
    at, o = row[x], owner[row[x]]
    keys, which = _groups(o, artist[x])
    own_n, own_p, own_last = np.bincount(which, minlength=len(keys)), np.bincount(which, plays[at], len(keys)), np.full(len(keys), np.iinfo(np.int64).min)
    np.maximum.at(own_last, which, last[at])
    album_keys, which = _groups(o, album[x])
    album_n = np.bincount(which, minlength=len(album_keys))
    # users' directions
    parts, low = {}, 0
    total: np.ndarray | None = None
    recent_n, any_ = np.zeros(users), np.zeros(users, bool)
    for b in _each(sides, _sides):
        if total is None:
            width = b.matrix.shape[1]
            for name in ("tt", "als", "audio", "lyrics", "genres"):
                size = dims.get(name) if name != "als" else width - sum(dims[k] for k in ("tt", "audio", "lyrics", "genres"))
                parts[name] = slice(low, low := low + size)
            total = np.zeros((users, width))
        at, place = recommend._held(play, ids.take(pa.array(play)), b)
        for cut in range(0, len(at), TOGETHER):
            rows, vec = at[cut : cut + TOGETHER], b.matrix[b.of[place[cut : cut + TOGETHER]]]
            new, o = last[rows] > after, owner[rows]
            for name, part in parts.items():
                vec[:, part] = recommend.unit_rows(vec[:, part])
            vec[:, parts["tt"]] *= new[:, None]
            start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            total[o[start]] += np.add.reduceat(vec, start)
            recent_n += count(o, new)
            any_[o] = True
    if total is None:
        return
    for part in parts.values():
        total[:, part] = recommend.unit_rows(total[:, part])
    als = np.where(any_[:, None], total[:, parts["als"]], np.nan)
    if not folded:
        als = np.full_like(als, np.nan)
        given = np.flatnonzero(kind == 3)
        if len(given):
            als[owner[given]] = recommend._matrix(run.column("vec").take(pa.array(given)))
    # candidates that the catalogue has, and their products with their users' directions
    c = np.flatnonzero((kind[row] == 1) & listed)
    c = c[np.argsort(row[c], kind="stable")]
    had, out = ids.take(pa.array(row[c])), []
    for b in _each(sides, _sides):
        at, place = recommend._held(np.arange(len(c)), had, b)
        for cut in range(0, len(at), TOGETHER):
            some, vec = at[cut : cut + TOGETHER], b.matrix[b.of[place[cut : cut + TOGETHER]]]
            o = owner[row[c[some]]]
            values = [some.astype(float), _in_order_dot(vec[:, parts["als"]], als[o])]
            for name in ("tt", "audio", "lyrics", "genres"):
                v = vec[:, parts[name]]
                there = any_[o] & (recent_n[o] > 0 if name == "tt" else (v != 0).any(axis=1))
                values.append(np.where(there, _in_order_dot(recommend.unit_rows(v), total[o, parts[name]]), np.nan))
            out.append(np.stack(values, axis=1))
    if not out:
        return
    product = np.concatenate(out)
    product = product[np.argsort(product[:, 0], kind="stable")]
    c = c[product[:, 0].astype(np.int64)]
    at, o = row[c], owner[row[c]]
    rank, second = a[at], product[:, 1]
    order = np.lexsort((rank, -np.round(second, 9), o))
    place = np.empty(len(c), np.int64)
    place[order] = np.arange(len(c)) - np.searchsorted(o, o) + 1
    which, has = _among(keys, o, artist[c])
    take = lambda x, w, h, none: np.where(h, x[w], none) if len(x) else np.full(len(h), none)
    album_at, album_has = _among(album_keys, o, album[c])
    k = known[c]
    feature = dict(zip(_KNOWN, k.T, strict=True)) | {name: v[o] for name, v in user.items()}
    with np.errstate(invalid="ignore", divide="ignore"):
        feature |= {
            "tt_rank": rank, "tt_z": _standard(score[at], o), "als_rank": place.astype(np.int32), "als_z": np.where(np.isnan(second), 0.0, _standard(second, o)),
            "recent_affinity": product[:, 2], "sim_audio": product[:, 3], "sim_lyrics": product[:, 4], "sim_genres": product[:, 5],
            "pop_gap": feature["track_pct"] - feature["user_mainstream"], "artist_tracks": take(np.log1p(own_n), which, has, 0.0),
            "artist_play_share": np.where(has, take(own_p, which, has, 0.0) / everything[o], 0.0), "artist_days_since": take((now - own_last) / DAY, which, has, np.nan),
            "artist_catalog_share": np.where(has, take(own_n, which, has, 0.0) / feature["_catalog"], 0.0), "album_tracks": take(np.log1p(album_n), album_at, album_has, 0.0),
            "artist_listeners": np.nan_to_num(feature["artist_listeners"], nan=0.0),
        }
    code = pa.concat_arrays([ids.take(pa.array(at)), ids.filter(pa.array(kind == 2))]).dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    key = np.concatenate([o, owner[kind == 2]]) * (len(code) + 1) + code
    label = np.isin(key[: len(at)], key[len(at) :])
    rows = np.arange(len(at))
    if trained is not None:
        inside = rank <= trained
        rows = np.flatnonzero(inside & (count(o[inside & label])[o] > 0))
    for cut in range(0, len(rows), TRACKS):
        s = rows[cut : cut + TRACKS]
        columns = [who.dictionary.take(pa.array(o[s])), ids.take(pa.array(at[s])), *(pa.array(feature[f][s], from_pandas=True) for f in FEATURES), pa.array(label[s].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=[*PAIR, *FEATURES, "label"])


def drift(snapshots: dict[str, DataFrame]) -> DataFrame:
    """feature, and its mean in each snapshot (missing values aside)."""
    rows = None
    for name, s in snapshots.items():
        one = s.agg(*(F.avg(f).alias(f) for f in FEATURES)).select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias(name)) for f in FEATURES))).alias("x")).select("x.*")
        rows = one if rows is None else rows.join(one, "feature")
    return rows


def summary(s: DataFrame) -> DataFrame:
    """Rows, users, positives, positive rate and users with a positive."""
    return s.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("users"), F.sum("label").alias("positives"), F.avg("label").alias("rate"), F.countDistinct(F.when(F.col("label") == 1, F.col("user_id"))).alias("users_with"))



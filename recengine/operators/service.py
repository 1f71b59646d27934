"""The two-stage service over batches of listeners: retrieve, featurise, score, reorder, present; known, new, and with a form's answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.operators import features, questionnaire, recommend, serving
from recengine.operators.prepare import PAIR, pairs
from recengine.operators.tables import kept

#: The mainstream question's answers and the thirds they name.
MAINSTREAM = {"deep cuts": 0, "in between": 1, "mainstream": 2}


@dataclass
class Service:
    """Everything a request needs. ``model`` scores the snapshot's rows; ``explained`` gives (..., feature, value, contribution) of some of them."""

    listens: DataFrame  # user_id, track_id, timestamp
    tracks: DataFrame  # track_id, title, artist, album
    vectors: DataFrame  # track_id, tt, als, audio, lyrics, genres
    dims: dict[str, int]
    tt_users: DataFrame  # user_id, vec: learned
    als_users: DataFrame
    model: Column | None = None
    explained: Callable[[DataFrame], DataFrame] | None = None
    candidates: int = 1000
    reordered: int = 500
    recent: int = 28
    short: int = 7
    half_life: float | None = None
    said: int = 3

    def tt(self) -> DataFrame:
        return self.vectors.select("track_id", F.col("tt").alias("vec"))

    def als(self) -> DataFrame:
        return self.vectors.select("track_id", F.col("als").alias("vec"))


def user_vectors(s: Service, history: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(two-tower, second model) vectors: the learned ones of users who have them, those of all others folded in from their listens."""
    out = []
    for learned, tracks, dim in ((s.tt_users, s.tt(), s.dims["tt"]), (s.als_users, s.als(), s.dims.get("als", 16))):
        known = learned.join(users.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "vec")
        others = history.join(learned.select("user_id"), "user_id", "left_anti")
        out.append(known.unionByName(serving.fold_in_users(others, tracks, dim, s.half_life)))
    return out[0], out[1]


def lists_for(s: Service, history: DataFrame, users: DataFrame, *, stages: str = "both", seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lists, candidates) of ``users`` with ``history``: user_id, track_id, score, rank; "retrieval" leaves the candidates' order as it is."""
    tt, als = user_vectors(s, history, users)
    found = recommend.top_unseen(tt, s.tt(), pairs(history) if seen is None else seen, s.candidates)
    if stages == "retrieval" or s.model is None:
        return found, found.withColumn("tt_rank", F.col("rank"))
    rows = kept(features.snapshot(found, history, s.tracks, s.vectors, als, s.dims, recent=s.recent, short=s.short, everyone=s.listens))
    lists = recommend.rerank(rows.withColumn("model", s.model), "model", F.col("tt_rank") <= s.reordered)
    return lists.withColumn("rank", (-F.col("score")).cast("int")), rows


def present(s: Service, lists: DataFrame, rows: DataFrame, k: int, explain: bool) -> DataFrame:
    """user_id, track_id, rank, retrieval_rank, title, artist, reasons (null unless asked for): each user's first k places."""
    top = lists.where(F.col("rank") <= serving.checked(k)).select(*PAIR, "rank").join(rows.select(*PAIR, F.col("tt_rank").alias("retrieval_rank")), PAIR)
    out = top.join(s.tracks.select("track_id", "title", "artist"), "track_id", "left")
    if explain and s.explained is not None:
        said = serving.reasons(s.explained(rows.join(top.select(*PAIR), PAIR, "left_semi")), s.said, s.recent, s.short)
        out = out.join(said, PAIR, "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    else:
        out = out.withColumn("reasons", F.lit(None).cast("array<string>"))
    return out.select(*PAIR, "rank", "retrieval_rank", "title", "artist", "reasons")


def _some(df: DataFrame, column: str) -> list:
    return [r[0] for r in df.select(column).limit(10).collect()]


def for_users(s: Service, users: DataFrame, k: int, *, explain: bool = False, stages: str = "both") -> DataFrame:
    """Places for known listeners; KeyError if there are others among them."""
    wanted = users.select("user_id").distinct()
    if unknown := _some(wanted.join(s.tt_users, "user_id", "left_anti"), "user_id"):
        raise KeyError(f"unknown listeners: {unknown}")
    history = s.listens.join(wanted, "user_id", "left_semi")
    return present(s, *lists_for(s, history, wanted, stages=stages), k, explain)


def for_new(s: Service, plays: DataFrame, now: Column, k: int, *, explain: bool = False, stages: str = "both") -> tuple[DataFrame, DataFrame]:
    """(places, unknown) for listeners that no model knows, from plays (user_id, track_id, timestamp or null, place: the order they came in).

    ``unknown``: user_id, track_id, place of tracks that the catalogue does not have, each where it first came. ValueError if somebody has no other.
    """
    listens, _ = serving.new_listens(plays, now, s.vectors)
    known = kept(listens.select(*PAIR, "timestamp"))
    if lost := _some(plays.select("user_id").distinct().join(known, "user_id", "left_anti"), "user_id"):
        raise ValueError(f"none of the tracks is in the catalogue, for listeners {lost}")
    missing = plays.join(s.vectors.select("track_id"), "track_id", "left_anti").groupBy(*PAIR).agg(F.min("place").alias("place"))
    return present(s, *lists_for(s, known, known.select("user_id"), stages=stages), k, explain), missing


def for_answers(s: Service, forms: DataFrame, now: Column, k: int, *, profiles: DataFrame, bands: DataFrame, by_artist: DataFrame, track_genres: list, names: DataFrame, neighbours: int, per_artist: int, explain: bool = False, stages: str = "both") -> tuple[DataFrame, DataFrame]:
    """(places, unknown) for listeners with a form (user_id, artists, genres: arrays of names; mainstream: an answer or null).

    Artists come first: the catalogue's most listened tracks of those named stand in for listens, and genres count no more. Else genres
    go to the known listeners with the closest profiles (of the third that the mainstream answer names), whose mean vector retrieves.
    ``profiles`` (user_id, genre, weight) and ``bands`` (user_id, band) are of known listeners, ``by_artist`` from
    ``questionnaire.most_listened``, ``names`` (genre, name). ``unknown``: user_id, kind, name, place. ValueError if nothing that somebody names is known.
    """
    asked = lambda c: forms.select("user_id", F.posexplode(c).alias("place", "name"))
    by_kind = {}
    unknown = None
    for kind, column, catalog in (("artist", "artists", by_artist.select(F.col("group").alias("name"), F.col("group").cast("string").alias("code"))), ("genre", "genres", names.select("name", F.col("genre").cast("string").alias("code")))):
        keyed = catalog.select(questionnaire.name_key(F.col("name")).alias("_k"), "code").distinct()
        one = asked(column).withColumn("_k", questionnaire.name_key(F.col("name")))
        by_kind[kind] = kept(one.join(keyed, "_k").select("user_id", "code").distinct())
        lost = one.join(keyed, "_k", "left_anti").groupBy("user_id", F.lit(kind).alias("kind"), "name").agg(F.min("place").alias("place"))
        unknown = lost if unknown is None else unknown.unionByName(lost)
    everyone = by_kind["artist"].select("user_id").union(by_kind["genre"].select("user_id")).distinct()
    if lost := _some(forms.join(everyone, "user_id", "left_anti"), "user_id"):
        raise ValueError(f"none of the artists or genres named is in the catalogue, for listeners {lost}")
    picks = by_kind["artist"].select("user_id", F.col("code").alias("group"))
    seeds = questionnaire.seed_tracks(picks, by_artist, per_artist).withColumn("timestamp", now).withColumn("place", F.lit(0))
    first = for_new(s, kept(seeds.select(*PAIR, "timestamp", "place")), now, k, explain=explain, stages=stages)[0].withColumn("used", F.lit("artists"))
    answers = by_kind["genre"].join(picks.select("user_id"), "user_id", "left_anti").select("user_id", F.col("code").cast("long").alias("genre"), F.lit(1.0).alias("weight"))
    third = F.create_map(*(F.lit(x) for kv in MAINSTREAM.items() for x in kv))
    answers = kept(answers.join(forms.select("user_id", third[F.col("mainstream")].alias("band")), "user_id"))
    known = profiles.join(bands, "user_id").withColumnRenamed("user_id", "other").join(s.tt_users.withColumnRenamed("user_id", "other"), "other")
    look = lambda some, band: questionnaire.look_alikes(some, known, s.dims["tt"], neighbours, track_genres, band=band)
    vec = look(answers.where("band IS NULL").drop("band"), False).unionByName(look(answers.where("band IS NOT NULL"), True))
    none = vec.select("user_id", F.lit("").alias("track_id")).limit(0)
    found = recommend.top_unseen(vec, s.tt(), none, s.candidates)
    second = present(s, found, found.withColumn("tt_rank", F.col("rank")), k, False).withColumn("used", F.lit("genres"))
    return first.unionByName(second), unknown

"""Requests as batches: known and new listeners, similar tracks, answers; titles and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recengine.functions.vectors import mean_direction
from recengine.operators.prepare import PAIR, pairs
from recengine.operators.recommend import similar_tracks, top_unseen
from recengine.operators.tables import placed

MAX_K = 100


def checked(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")
    return k


def recent_stretch(listens: DataFrame, n: int) -> DataFrame:
    """Each user's latest listens that hold n distinct tracks: those after the last play of the (n + 1)-th most recent track, or all."""
    last = listens.groupBy(*PAIR).agg(F.max("timestamp").alias("_l"))
    w = Window.partitionBy("user_id").orderBy(F.col("_l").desc(), "track_id")
    cut = last.withColumn("_p", F.row_number().over(w)).where(F.col("_p") == n + 1).select("user_id", F.col("_l").alias("_cut"))
    return listens.join(cut, "user_id", "left").where(F.col("_cut").isNull() | (F.col("timestamp") > F.col("_cut"))).drop("_cut")


def recent_tracks(listens: DataFrame, n: int) -> DataFrame:
    """The n tracks that each user played last, latest first (ties by track)."""
    last = listens.groupBy(*PAIR).agg(F.max("timestamp").alias("last"))
    w = Window.partitionBy("user_id").orderBy(F.col("last").desc(), "track_id")
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def recency_weights(listens: DataFrame, half_life: float) -> DataFrame:
    """Per pair 0.5 to the power (place - 1) / half_life, where tracks last played at the same time share a place."""
    last = listens.groupBy(*PAIR).agg(F.max("timestamp").alias("_l"))
    place = F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.col("_l").desc()))
    return last.withColumn("place", place).select(*PAIR, "place", F.pow(F.lit(0.5), (F.col("place") - 1) / F.lit(float(half_life))).alias("weight"))


def fold_in_users(listens: DataFrame, tracks: DataFrame, dim: int, half_life: float | None = None) -> DataFrame:
    """user_id, vec: the direction of the average of a user's tracks, lately played ones heavier if ``half_life`` is given."""
    vec = tracks.select("track_id", F.col("vec"))
    if half_life is None:
        return mean_direction(pairs(listens), vec, "vec", dim)
    known = listens.join(vec.select("track_id"), "track_id", "left_semi")  # tracks without a vector take no place
    return mean_direction(recency_weights(known, half_life), vec, "vec", dim, weight="weight")


def new_listens(plays: DataFrame, now: Column, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plays of new listeners as listens (a missing time is now), and the (user_id, track_id) that the catalogue does not have.

    A play after now is an error.
    """
    timed = plays.withColumn("timestamp", F.coalesce("timestamp", now))
    legal = F.when(F.col("timestamp") > now, F.raise_error(F.lit("a listen lies in the future"))).otherwise(F.col("timestamp"))
    timed = timed.withColumn("timestamp", legal)
    known = catalog.select("track_id").distinct()
    return timed.join(known, "track_id", "left_semi"), pairs(timed.join(known, "track_id", "left_anti"))


def recommend_new(plays: DataFrame, tracks: DataFrame, dim: int, k: int, half_life: float | None = None) -> DataFrame:
    """Lists for listeners the models have not seen: folded in from their listens, then the k best tracks they have not played."""
    return top_unseen(fold_in_users(plays, tracks, dim, half_life), tracks, pairs(plays), checked(k))


def recommend_known(users: DataFrame, tracks: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    return top_unseen(users, tracks, seen, checked(k))


def similar(tracks: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    return similar_tracks(tracks, wanted, checked(k))


def present(lists: DataFrame, tracks: DataFrame, retrieval: DataFrame, k: int) -> DataFrame:
    """The first k places with retrieval rank, title and artist, as a user sees them."""
    top = lists.where(F.col("rank") <= k)
    return top.join(retrieval.select(*PAIR, F.col("rank").alias("retrieval_rank")), PAIR, "left").join(tracks.select("track_id", "title", "artist"), "track_id").select(*PAIR, "rank", "retrieval_rank", "title", "artist")


def genres(tracks: DataFrame) -> DataFrame:
    return tracks.select("genre").distinct()


def health(listens: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row: what the service holds."""
    users = listens.agg(F.lit("ok").alias("status"), F.countDistinct("user_id").alias("users"))
    return users.join(F.broadcast(tracks.agg(F.count(F.lit(1)).alias("tracks"), F.max(F.size("vec")).alias("dim"))))


def genre_shares(listens: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per genre: listens, their share of all, tracks, artists."""
    per = listens.join(tracks, "track_id").groupBy("genre").agg(F.count(F.lit(1)).alias("listens"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("artist").alias("artists"))
    return per.withColumn("share", F.col("listens") / F.sum("listens").over(Window.partitionBy()))


def genre_group(genres: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The group of a track's first genre label: the first rule with a keyword in it, else "other"."""
    first = F.lower(F.regexp_replace(F.split(genres, ",")[0], r"^\s+|\s+$", ""))
    out: Column | None = None
    for name, words in rules:
        has = F.lit(False)
        for w in words:
            has = has | F.contains(first, F.lit(w))
        out = F.when(has, name) if out is None else out.when(has, name)
    return F.lit("other") if out is None else out.otherwise("other")


def replaced(column: Column, names: dict[str, str], default: str) -> Column:
    """The name that ``names`` has for a value; ``default`` for all others and for null."""
    pairs_ = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs_)[column], F.lit(default)) if pairs_ else F.lit(default)


def coded(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a code, from 0 in order of the distinct values of ``column``; null has none."""
    values = placed(rows.where(F.col(column).isNotNull()).select(column).distinct(), column).select(column, (F.col("place") - 1).alias("code"))
    return rows.join(values, column, "left")


def utc(text: Column) -> Column:
    """A time as text, with an offset, with Z, or without (then it is UTC already), as a timestamp without zone in UTC."""
    zoned = text.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$")
    local = F.try_to_timestamp(F.when(zoned, text)).cast("timestamp_ntz")  # in the session's zone
    return F.coalesce(F.convert_timezone(F.current_timezone(), F.lit("UTC"), local), F.when(~zoned, text).try_cast("timestamp_ntz"))


#: What the service says of a feature. {v} stands for its value, written as the second entry names; {recent} and {short} for days.
TEXTS = {
    "tt_rank": ("the retrieval model's number {v} candidate for them", "whole"),
    "tt_z": ("its retrieval score is {v} standard deviations from their average candidate", "signed"),
    "als_rank": ("a second model, ALS, puts it at number {v} of their candidates", "whole"),
    "als_z": ("its ALS score is {v} standard deviations from their average candidate", "signed"),
    "track_listeners": ("{v} in all", "listener"),
    "track_listeners_recent": ("{v} in the last {recent} days", "listener"),
    "track_listeners_short": ("{v} in the last {short} days", "listener"),
    "track_recent_share": ("{v} of its listeners played it in the last {recent} days", "percent"),
    "track_discovery_rate": ("{v} of its recent listeners were hearing it for the first time", "percent"),
    "recent_affinity": ("close to what they played in the last {recent} days", ""),
    "sim_audio": ("it sounds like what they have played", ""),
    "sim_lyrics": ("its lyrics are close to what they have played", ""),
    "sim_genres": ("its genres match what they have played", ""),
    "pop_gap": ("{v} popular than what they usually play", "compared"),
    "artist_tracks": ("has played {v} by this artist", "other track"),
    "artist_play_share": ("{v} of their plays are by this artist", "percent"),
    "artist_days_since": ("{v}", "ago"),
    "artist_catalog_share": ("has played {v} of this artist's tracks", "percent"),
    "album_tracks": ("has played {v} from this album", "track"),
    "artist_listeners": ("{v} play this artist", "listener"),
}
#: Of a feature without a value, and of all features of the listener alone.
MISSING = {
    "artist_days_since": "has never played this artist",
    "recent_affinity": "has played nothing in the last {recent} days to compare it with",
    "sim_lyrics": "it has no lyrics on file",
}
LISTENER = "how this listener listens in general"


def _numbered(n: Column, noun: str) -> Column:
    return F.format_string("%s " + noun + "%s", F.format_number(n, 0), F.when(n == 1, "").otherwise("s"))


def _written(value: Column, how: str) -> Column:
    """A feature's value in the form that ``TEXTS`` names; any other name is a noun that is counted (the feature is the log of 1 and the count)."""
    days = F.bround(value).cast("long")
    forms = {
        "": F.lit(""),
        "whole": value.cast("long").cast("string"),
        "signed": F.format_string("%+.1f", value),
        "percent": F.format_string("%d%%", F.bround(value * 100).cast("long")),
        "compared": F.when(value > 0, "more").otherwise("less"),
        "ago": F.when(days == 0, "played this artist within the last day").otherwise(F.format_string("last played this artist %s ago", _numbered(days, "day"))),
    }
    return forms[how] if how in forms else _numbered(F.round(F.expm1(value)).cast("long"), how)


def reason(feature: Column, value: Column, recent: int, short: int) -> Column:
    """One feature's value in words; what a service says about a place in a list."""
    days = {"recent": recent, "short": short}
    out = F.when(feature.startswith("user_"), F.lit(LISTENER))
    for name, text in MISSING.items():
        out = out.when((feature == name) & value.isNull(), F.lit(text.format(**days)))
    out = out.when(value.isNull(), F.concat(F.lit("no value for "), feature))
    for name, (text, how) in TEXTS.items():
        out = out.when(feature == name, F.replace(F.lit(text.format(v="{v}", **days)), F.lit("{v}"), _written(value, how)))
    return out


def reasons(contributions: DataFrame, n: int, recent: int, short: int) -> DataFrame:
    """user_id, track_id, reasons: of (…, feature, value, contribution) the n largest positive contributions in words, each text once."""
    said = contributions.where("contribution > 0").withColumn("_t", reason(F.col("feature"), F.col("value"), recent, short))
    once = said.groupBy(*PAIR, "_t").agg(F.max("contribution").alias("_c"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_c")).alias("c"), F.col("_t").alias("t"))))
    return once.groupBy(*PAIR).agg(F.slice(F.transform(listed, lambda x: x["t"]), 1, n).alias("reasons"))

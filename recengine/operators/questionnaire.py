"""Listeners without listens: what they answer, and lists from answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recengine.functions.vectors import array_sum, unit
from recengine.operators.prepare import PAIR
from recengine.operators.recommend import top_unseen


def name_key(c):
    """Names are matched without outer white space and without case; the sharp s is two, as in upper case."""
    return F.replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit("ß"), F.lit("ss"))


def taste(pairs: DataFrame, track_genres: DataFrame, pct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, genre, weight): a user's tracks' genre weights (track_id, genre, weight) added up; (user_id, mainstream): the mean percentile."""
    profile = pairs.join(track_genres, "track_id").groupBy("user_id", "genre").agg(F.sum("weight").alias("weight"))
    return profile, pairs.join(pct, "track_id").groupBy("user_id").agg(F.avg("pct").alias("mainstream"))


def strongest(profile: DataFrame, n: int) -> DataFrame:
    """Each user's n genres with the most weight (ties by genre); none without weight."""
    w = Window.partitionBy("user_id").orderBy(F.round("weight", 9).desc(), "genre")
    return profile.where("weight > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("user_id", "genre", "place")


def thirds(values: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """``values`` with band 0, 1 or 2: the third of ``known`` a value falls in; one on a cut is in the lower."""
    cuts = known.agg(F.percentile(column, F.lit(1 / 3)).alias("_a"), F.percentile(column, F.lit(2 / 3)).alias("_b"))
    v = F.col(column)
    return values.join(F.broadcast(cuts)).withColumn("band", F.when(v <= F.col("_a"), 0).when(v <= F.col("_b"), 1).otherwise(2)).drop("_a", "_b")


def favourites(listens: DataFrame, tracks: DataFrame, n: int, column: str = "artist") -> DataFrame:
    """Each user's n most played artists, ties by name."""
    plays = listens.join(tracks.select("track_id", F.col(column).alias("group")), "track_id").groupBy("user_id", "group").agg(F.count(F.lit(1)).alias("_p"))
    w = Window.partitionBy("user_id").orderBy(F.col("_p").desc(), "group")
    return plays.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("user_id", "group", "place")


def most_listened(groups: DataFrame, listeners: DataFrame) -> DataFrame:
    """Each group's tracks from the most listeners down, with their place; ties by track, tracks without a group in none."""
    w = Window.partitionBy("group").orderBy(F.col("listeners").desc(), "track_id")
    return groups.where("`group` IS NOT NULL").join(listeners, "track_id").withColumn("place", F.row_number().over(w)).select("group", "track_id", "place")


def seed_tracks(picks: DataFrame, ranked: DataFrame, per: int) -> DataFrame:
    """Listens that stand in for answers: the first ``per`` tracks of each group that a user names, each once."""
    return picks.select("user_id", "group").join(ranked.where(F.col("place") <= per), "group").select(*PAIR).distinct()


def matched(names: DataFrame, catalog: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Names (user_id, name) that the catalogue has, with every spelling they match; and those it does not have."""
    known = catalog.select(F.col(column).alias("group"), name_key(F.col(column)).alias("_k")).distinct()
    asked = names.withColumn("_k", name_key(F.col("name")))
    return asked.join(known, "_k").select("user_id", "name", "group"), asked.join(known, "_k", "left_anti").select("user_id", "name")


def look_alikes(answers: DataFrame, known: DataFrame, dim: int, k: int, genres: list, *, band: bool = False) -> DataFrame:
    """user_id and the direction of the mean vector of the k known users with the closest profiles (cosine above 0, ties to the lower id).

    ``answers`` (user_id, genre, weight), ``known`` (other, genre, weight, vec). Profiles are vectors over ``genres`` (their list is small), and known
    users are searched as tracks are, in blocks: no join of users and users. ``band``: both sides have a band, and known users of the
    same one count.
    """
    def profile(df: DataFrame, by: str) -> DataFrame:
        vec = F.array(*(F.coalesce(F.sum(F.when(F.col("genre") == g, F.col("weight"))), F.lit(0.0)) for g in genres))
        return df.groupBy(by, *(["band"] if band else [])).agg(vec.alias("vec")).withColumn("vec", unit("vec"))

    a, b = profile(answers, "user_id"), profile(known, "other").withColumnRenamed("other", "track_id")
    none = a.select("user_id", F.lit(None).cast(dict(b.dtypes)["track_id"]).alias("track_id")).limit(0)
    if band:
        parts = [top_unseen(a.where(F.col("band") == x), b.where(F.col("band") == x), none, k) for x in (0, 1, 2)]
        near = parts[0].unionByName(parts[1]).unionByName(parts[2])
    else:
        near = top_unseen(a, b, none, k)
    near = near.where("score > 0").select("user_id", F.col("track_id").alias("other"))
    vec = known.select("other", "vec").dropDuplicates(["other"])
    return array_sum(near.join(vec, "other"), ["user_id"], "vec", dim).select("user_id", unit("vec").alias("vec"))


def combined(a: DataFrame, b: DataFrame) -> DataFrame:
    """The direction of the sum of two users' vectors."""
    joined = a.join(b.withColumnRenamed("vec", "_b"), "user_id")
    return joined.select("user_id", unit(F.zip_with("vec", "_b", lambda x, y: x + y)).alias("vec"))



"""Vectors as arrays of doubles, inside generated code: no Python in the hot path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """The sum of products, from the first place to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str) -> Column:
    """Scaled to length 1; an all-zero vector stays zero. The vector and its length are bound once, not computed for each place."""
    scaled = lambda x, n: F.transform(x, lambda y: F.when(n > 0, y / n).otherwise(F.lit(0.0)))
    return F.transform(F.array(v), lambda x: F.transform(F.array(norm(x)), lambda n: scaled(x, n))[0])[0]


def has_direction(v: Column | str) -> Column:
    return F.exists(v, lambda x: x != 0)


def array_sum(df: DataFrame, by: list[str], vec: str, dim: int, weight: Column | None = None) -> DataFrame:
    """Per group the (weighted) sum of vectors of ``dim`` places, summed in the map tasks first; nothing is exploded."""
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*by).agg(F.array(*(F.sum(F.col(vec)[k] * w) for k in range(dim))).alias(vec))


def mean_direction(played: DataFrame, tracks: DataFrame, vec: str, dim: int, *, weight: str | None = None) -> DataFrame:
    """user_id and the direction of the (weighted) average of the unit vectors of the tracks in ``played`` (user_id, track_id)."""
    scaled = tracks.select("track_id", unit(vec).alias(vec))
    joined = played.join(scaled, "track_id")
    summed = array_sum(joined, ["user_id"], vec, dim, None if weight is None else F.col(weight))
    return summed.select("user_id", unit(vec).alias(vec))


def column_zscore(df: DataFrame, vec: str, dim: int, measured: Column | None = None) -> DataFrame:
    """Each place standardised by mean and population deviation over the rows with ``measured``; a constant place is only centred."""
    on = F.lit(True) if measured is None else measured
    stats = df.agg(
        F.array(*(F.avg(F.when(on, F.col(vec)[k])) for k in range(dim))).alias("_mean"),
        F.array(*(F.stddev_pop(F.when(on, F.col(vec)[k])) for k in range(dim))).alias("_sd"),
    )  # one row
    sd = F.transform("_sd", lambda s: F.when(s > 0, s).otherwise(F.lit(1.0)))
    z = F.zip_with(F.zip_with(vec, "_mean", lambda x, m: x - m), sd, lambda x, s: x / s)
    return df.join(F.broadcast(stats)).withColumn(vec, z).drop("_mean", "_sd")


def content_blocks(df: DataFrame, audio: int, lyrics: int) -> DataFrame:
    """Audio standardised; lyrics standardised over the rows that have them, the others zero, with has_lyrics; genres of length 1."""
    has = has_direction("lyrics")
    out = column_zscore(df.withColumn("has_lyrics", has.cast("double")), "audio", audio)
    out = column_zscore(out, "lyrics", lyrics, F.col("has_lyrics") > 0)
    return out.withColumn("lyrics", F.when(F.col("has_lyrics") > 0, F.col("lyrics")).otherwise(F.array_repeat(F.lit(0.0), lyrics))).withColumn("genres", unit("genres"))

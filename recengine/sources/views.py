"""Logical tables of the domain over the driver's tables: listens (user_id, track_id, timestamp), tracks, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(number, width: int):
    """A number as text, zeros before it up to ``width`` digits; a longer one stays whole."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def listens_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listens: the key in ``props`` is the track, padded so that text order is numeric order."""
    # text that is no more than a whole number under this key, which is nearly all, is cut out; all other goes through the parser
    number = F.substr("props", F.lit(7), F.length("props") - 7)
    plain = F.col("props").startswith('{"k": ') & F.col("props").endswith("}") & F.length("props").between(8, 25) & (F.translate(number, "0123456789", "") == "") & ((F.length(number) == 1) | ~number.startswith("0"))
    key = F.when(plain, padded(number, 3)).otherwise(padded(F.get_json_object("props", "$.k"), 3))
    return table(spark, sf_dir, "events").select("user_id", key.alias("track_id"), F.col("ts").alias("timestamp"))


def listens_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as listens: sparse, with many equal times."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("timestamp"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", padded(F.col("l_partkey"), 8).alias("track_id"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("user_id", "track_id", "timestamp")


def tracks(spark: SparkSession, sf_dir: str, width: int = 3) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        padded(F.col("p_partkey"), width).alias("track_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        F.concat_ws(" / ", "p_brand", "p_type").alias("album"), F.col("p_type").alias("genre"), F.col("p_size").alias("year"),
    )


def vectors(spark: SparkSession, sf_dir: str, width: int = 3) -> DataFrame:
    """track_id, tt (64 dimensions), als (the first 16, a second model's stand-in), and content blocks audio, lyrics, genres."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("tt"))
    lyrics = F.when(F.col("vec_id") % 7 == 0, F.array_repeat(F.lit(0.0), 16)).otherwise(F.slice("tt", 33, 16))
    return v.select(
        padded(F.col("vec_id"), width).alias("track_id"), "tt", F.slice("tt", 1, 16).alias("als"), F.slice("tt", 1, 32).alias("audio"),
        lyrics.alias("lyrics"), F.transform(F.slice("tt", 49, 16), F.abs).alias("genres"),
    )

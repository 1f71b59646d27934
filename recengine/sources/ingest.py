"""Files in and out: listens and features as TSV (also bz2), metadata, sorted Parquet, vector tables and bundles."""

from __future__ import annotations

import hashlib
import json
import shutil
import urllib.request
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.operators.prepare import PAIR

FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """path, size and md5 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.md5("content").alias("md5"))


def fetch(url: str, target: Path, md5: str, tries: int = 2, block: int = 1 << 20) -> Path:
    """A file from a server to the driver's machine, as the source of what Spark then reads: what an earlier try left is gone on from, and a file that
    has another digest is loaded anew, ``tries`` times in all. A file that is there and right is left alone."""
    part = target.with_name(f"{target.name}.part")

    def digest(path: Path) -> str:
        with path.open("rb") as f:
            return hashlib.file_digest(f, "md5").hexdigest()

    if target.exists() and digest(target) == md5:
        return target
    for _ in range(tries):
        start = part.stat().st_size if part.exists() else 0
        request = urllib.request.Request(url, headers={"Range": f"bytes={start}-"} if start else {})
        with urllib.request.urlopen(request) as answer, part.open("ab" if start and answer.status == 206 else "wb") as out:
            shutil.copyfileobj(answer, out, block)
        if digest(part) == md5:
            return part.replace(target)
        part.unlink()
    raise ValueError(f"{url} does not have the digest {md5}")


def sniff(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """(has a header, times are epoch numbers) from the first two lines: three columns, or ValueError; a header's third field has no digit first."""
    lines = [r[0].split("\t") for r in spark.read.text(path).limit(2).collect()]
    if not lines or any(len(x) != 3 for x in lines):
        raise ValueError("expected three tab-separated columns")
    header = not lines[0][2][:1].isdigit()
    if header and len(lines) < 2:
        raise ValueError("no row below the header")
    return header, lines[1 if header else 0][2].strip().isdigit()


def parsed_time(text: Column, epoch: bool) -> Column:
    """Epoch numbers of more than 11 digits are milliseconds; other texts are tried in three formats."""
    if epoch:
        n = text.cast("long")
        return F.to_timestamp_ntz(F.date_format(F.when(F.length(text) > 11, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n)), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS)).cast("timestamp_ntz")


def read_listens(spark: SparkSession, path: str) -> DataFrame:
    """user_id, track_id, timestamp of a TSV of listens, compressed or not (bz2 is split between tasks)."""
    header, epoch = sniff(spark, path)
    raw = spark.read.csv(path, sep="\t", header=header, schema="user_id string, track_id string, timestamp string", quote="", mode="FAILFAST", enforceSchema=True)
    return raw.select(F.col("user_id").cast("long").alias("user_id"), "track_id", parsed_time(F.col("timestamp"), epoch).alias("timestamp"))


def write_listens(listens: DataFrame, path: str) -> None:
    """Parquet dealt by ranges of users and sorted by (user, time): a user's rows are a few row groups, found by their statistics."""
    listens.repartitionByRange("user_id").sortWithinPartitions("user_id", "timestamp").write.option("compression", "zstd").option("parquet.block.row.count.limit", "100000").mode("overwrite").parquet(path)


def convert_listens(spark: SparkSession, source: str, target: str) -> int:
    """Reads a TSV of listens, writes it as Parquet, and returns the rows written."""
    write_listens(read_listens(spark, source), target)
    return spark.read.parquet(target).count()


def read_features(spark: SparkSession, path: str, ids: DataFrame, name: str) -> DataFrame:
    """track_id and a vector of the other columns of a feature TSV with a header, for exactly ``ids``; a missing id is an error."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    first, *rest = raw.columns
    table = raw.select(F.col(f"`{first}`").alias("track_id"), F.array(*(F.col(f"`{c}`").cast("double") for c in rest)).alias(name))
    return complete(ids.select("track_id").join(table, "track_id", "left"), name)


def complete(rows: DataFrame, column: str) -> DataFrame:
    """Fails, when it is run, on a row without ``column``."""
    return rows.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.concat(F.lit(f"no {column} for "), F.col("track_id")))).otherwise(F.col(column)))


def feature_names(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False).columns[1:]


def feature_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct values of a file's first column, without blanks."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    return raw.select(F.trim(F.col(f"`{raw.columns[0]}`")).alias("track_id")).where(F.length("track_id") > 0).distinct()


def read_metadata(spark: SparkSession, information: str, genres: str, lang: str, metadata: str) -> DataFrame:
    """track_id, title, artist, album, year, lang, genres from four TSVs without a quote character, joined on id; ids stay texts."""
    tsv = lambda p: spark.read.csv(p, sep="\t", header=True, quote="", inferSchema=False)
    joined = tsv(information).join(tsv(genres).select("id", "genres"), "id").join(tsv(lang).select("id", "lang"), "id").join(tsv(metadata).select("id", "release"), "id")
    return joined.select(F.col("id").alias("track_id"), F.col("song").alias("title"), "artist", F.col("album_name").alias("album"), F.col("release").try_cast("int").alias("year"), "lang", "genres")


def same_ids(a: DataFrame, b: DataFrame, column: str) -> bool:
    """Whether two tables hold exactly the same ids."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.join(y, column, "left_anti").isEmpty() and y.join(x, column, "left_anti").isEmpty()


def write_vectors(vectors: DataFrame, path: str, meta: dict, column: str = "track_id") -> None:
    """Vectors by id, in order of the ids, and what is to be known of them; repeated ids and vectors of several lengths are refused."""
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(column).alias("ids"), F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    if seen["n"] != seen["ids"] or seen["a"] != seen["b"]:
        raise ValueError("vectors need ids of their own and one length")
    vectors.select(column, "vec").repartitionByRange(column).sortWithinPartitions(column).write.mode("overwrite").parquet(f"{path}/vectors")
    whole = {**meta, "rows": seen["n"], "dim": seen["a"], "id": column}
    vectors.sparkSession.createDataFrame([(json.dumps(whole, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/vectors"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def bundle_meta(listens: DataFrame, settings: dict) -> dict:
    """What a service needs to know besides its tables: the time of the last listen (its now) and how much there is."""
    x = listens.agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("now"), F.count(F.lit(1)).alias("listens"), F.countDistinct("user_id").alias("users")).first()
    return {**settings, **x.asDict()}


def write_bundle(path: str, tables: dict[str, DataFrame], meta: dict) -> None:
    """A directory of Parquet tables and a JSON of settings: what a service needs. Vectors must be of exactly the catalogue's tracks."""
    if "tracks" in tables and "track_vectors" in tables and not same_ids(tables["tracks"], tables["track_vectors"], "track_id"):
        raise ValueError("the vectors are not of the catalogue's tracks")
    if "listens" in tables and "user_vectors" in tables and not tables["user_vectors"].join(tables["listens"], "user_id", "left_anti").isEmpty():
        raise ValueError("there are vectors of users without listens")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if name == "listens":
            write_listens(df, f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_bundle(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, json.loads(spark.read.text(f"{path}/meta").first()[0])


def user_listens(bundle: dict[str, DataFrame], users: DataFrame) -> DataFrame:
    return bundle["listens"].join(F.broadcast(users) if users.count() <= 100_000 else users, "user_id", "left_semi").select(*PAIR, "timestamp")

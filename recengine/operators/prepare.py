"""Listens: calendar windows, light users, temporal splits, interactions and the audit of a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["user_id", "track_id"]
SPLITS = ("retrieval_train", "ranker_train", "val", "test")


def months_before(end: Column, months: int) -> Column:
    """``months`` calendar months earlier at the same time of day; the day is clamped to the month's last."""
    return end - F.make_ym_interval(F.lit(0), F.lit(months))


def with_last(listens: DataFrame, name: str = "_now") -> DataFrame:
    """``listens`` with the time of the last of them: an aggregate of one row, joined without a shuffle of the listens."""
    return listens.join(F.broadcast(listens.agg(F.max("timestamp").alias(name))))


def window_users(listens: DataFrame, months: int, least: int) -> DataFrame:
    """Listens in the last ``months`` (start excluded, end included) of users with ``least`` or more of them there."""
    inside = with_last(listens).where(F.col("timestamp") > months_before(F.col("_now"), months)).drop("_now")
    heavy = inside.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("user_id")
    return inside.join(heavy, "user_id", "left_semi")


def sample_users(listens: DataFrame, n: int, seed: str) -> DataFrame:
    """Whole users: the ``n`` first by a digest of id and seed, the same on any engine."""
    chosen = listens.select("user_id").distinct().orderBy(F.md5(F.concat(F.col("user_id").cast("string"), F.lit(seed)))).limit(n)
    return listens.join(chosen, "user_id", "left_semi")


def with_split(listens: DataFrame, test_days: float, val_days: float, ranker_days: float) -> DataFrame:
    """``listens`` with the slice of time they fall in, counted back from the last; a listen on a boundary is in the earlier slice."""
    back = lambda days: F.col("_now") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0))
    at = F.col("timestamp")
    split = (
        F.when(at <= back(test_days + val_days + ranker_days), SPLITS[0]).when(at <= back(test_days + val_days), SPLITS[1]).when(at <= back(test_days), SPLITS[2]).otherwise(SPLITS[3])
    )
    return with_last(listens).withColumn("split", split).drop("_now")


def only_train(listens: DataFrame, splits: list[str]) -> DataFrame:
    """Listens of the named training slices; any other name is refused."""
    if other := set(splits) - set(SPLITS[:2]):
        raise ValueError(f"not training data: {sorted(other)}")
    return listens.where(F.col("split").isin(splits))


def pairs(listens: DataFrame) -> DataFrame:
    return listens.select(*PAIR).distinct()


def plays(listens: DataFrame) -> DataFrame:
    """One row for each user and track with the number of plays and the weights 1 and log(1 + plays)."""
    counted = listens.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("plays"))
    return counted.withColumn("binary", F.lit(1.0)).withColumn("log_plays", F.log1p("plays"))


def training_pairs(listens: DataFrame, weighting: str = "pairs", excluded: DataFrame | None = None) -> DataFrame:
    """Training pairs with their weight and the log of their track's share of all weight; excluded tracks go first."""
    kept = listens if excluded is None else listens.join(excluded, "track_id", "left_anti")
    p = plays(kept)
    p = p.select(*PAIR, (F.col("binary") if weighting == "pairs" else F.col("log_plays")).alias("weight"))
    share = p.groupBy("track_id").agg(F.sum("weight").alias("_t"))
    total = p.agg(F.sum("weight").alias("_all"))
    q = share.join(F.broadcast(total)).select("track_id", F.log(F.greatest(F.col("_t") / F.col("_all"), F.lit(1e-12))).alias("log_q"))
    return p.join(q, "track_id").select(*PAIR, "weight", "log_q")


def gini(counts: DataFrame, value: str) -> DataFrame:
    """One row: sum of (2i - n - 1) v_i over n times the sum of v, in ascending order of v; 0 if there is nothing.

    Equal values are one row with how often they occur, so the ordered pass is over distinct values, not rows.
    """
    per = counts.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the ranks of m equal values after b others sum to m * b + m (m + 1) / 2
    ranked = per.withColumn("r", F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("v") * F.col("r")).alias("vr"), F.sum(F.col("v") * F.col("m")).alias("vm"), F.sum("m").alias("n"))
    value_ = (2 * F.col("vr") - (F.col("n") + 1) * F.col("vm")) / (F.col("n") * F.col("vm"))
    return sums.select(F.when(F.coalesce("vm", F.lit(0.0)) > 0, value_).otherwise(0.0).alias("gini"))


def audit_size(listens: DataFrame) -> DataFrame:
    """listens, users, tracks, distinct pairs, density of the matrix, share of repeated listens."""
    p = listens.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    a = p.agg(F.sum("n").alias("listens"), F.countDistinct("user_id").alias("users"), F.countDistinct("track_id").alias("tracks"), F.count(F.lit(1)).alias("pairs"))
    return a.withColumn("density", F.try_divide(F.col("pairs"), F.col("users") * F.col("tracks"))).withColumn("repeat_share", 1 - F.try_divide("pairs", "listens"))


def audit_users(listens: DataFrame) -> DataFrame:
    """Mean, median and quantiles of listens and of distinct tracks per user."""
    u = listens.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("track_id").alias("t"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return u.agg(F.avg("n").alias("mean_listens"), q("n", 0.1).alias("p10_listens"), q("n", 0.5).alias("median_listens"), q("n", 0.9).alias("p90_listens"), F.avg("t").alias("mean_tracks"), q("t", 0.5).alias("median_tracks"))


def audit_months(listens: DataFrame) -> DataFrame:
    return listens.groupBy(F.date_trunc("MONTH", "timestamp").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("listens"), F.countDistinct("user_id").alias("users"))


def audit_top_share(listens: DataFrame, share: float = 0.01, few: int = 5) -> DataFrame:
    """Share of listens that go to the top ``share`` of tracks (at least one, rounded half to even), and of tracks under ``few`` listens.

    Tracks with equally many listens are one row of the ordered pass; of those at the edge as many count as there are places left.
    """
    t = listens.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    per = t.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = per.agg(F.greatest(F.lit(1), F.bround(share * F.sum("m")).cast("int")).alias("_head"))
    inside = F.greatest(F.lit(0), F.least(F.col("m"), F.col("_head") - F.col("_before")))
    ranked = per.withColumn("_before", before).join(F.broadcast(head))
    return ranked.agg((F.sum(inside * F.col("n")) / F.sum(F.col("n") * F.col("m"))).alias("top_share"), (F.sum(F.when(F.col("n") < few, F.col("m")).otherwise(0)) / F.sum("m")).alias("under_few"))


def audit_coverage(listens: DataFrame, features: DataFrame) -> DataFrame:
    """Share of tracks and of listens that a feature table (track_id) covers."""
    t = listens.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).join(features.select("track_id", F.lit(1).alias("_has")).distinct(), "track_id", "left")
    has = F.coalesce("_has", F.lit(0))
    return t.agg(F.avg(has).alias("tracks"), (F.sum(has * F.col("n")) / F.sum("n")).alias("listens"))


def audit_files(listens: DataFrame, files: dict[str, DataFrame | None]) -> DataFrame:
    """A row for each feature file: name, missing, and the shares it covers; one that is not there (None) has no shares."""
    out = None
    for name, features in sorted(files.items()):
        if features is None:
            one = listens.sparkSession.range(1).select(F.lit(name).alias("file"), F.lit(True).alias("missing"), F.lit(None).cast("double").alias("tracks"), F.lit(None).cast("double").alias("listens"))
        else:
            one = audit_coverage(listens, features).select(F.lit(name).alias("file"), F.lit(False).alias("missing"), "tracks", "listens")
        out = one if out is None else out.unionByName(one)
    return out


def prepared(listens: DataFrame, months: int, least: int, n: int, seed: str) -> tuple[DataFrame, dict]:
    """A sample of ``n`` users with ``least`` listens or more in the last ``months``, by user and time, and what became of the rest.

    Nobody eligible is an error; fewer than ``n`` are all taken.
    """
    eligible = window_users(listens, months, least)
    sample = sample_users(eligible, n, seed)
    count = lambda df: df.agg(F.count(F.lit(1)).alias("listens"), F.countDistinct("user_id").alias("users"), F.countDistinct("track_id").alias("tracks")).first().asDict()
    meta = {"raw": count(listens), "eligible": count(eligible), "sample": count(sample)}
    if not meta["eligible"]["users"]:
        raise ValueError(f"no user has {least} listens in the last {months} months")
    return sample.repartitionByRange("user_id", "timestamp").sortWithinPartitions("user_id", "timestamp"), meta

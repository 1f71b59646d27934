"""Ranking evaluation: who is relevant, recall, NDCG, coverage, groups, comparison of lists."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recengine.operators.prepare import PAIR, pairs
from recengine.operators.tables import kept


def relevant(history: DataFrame, holdout: DataFrame) -> DataFrame:
    """Distinct pairs of the holdout that are not in the history."""
    return pairs(holdout).join(pairs(history), PAIR, "left_anti")


def best_first(recs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Lists with their ranks: seen tracks go before the cut, a repeated pair counts once with its best score, ties by track."""
    r = recs.groupBy(*PAIR).agg(F.max("score").alias("score"))
    r = r if seen is None else r.join(seen, PAIR, "left_anti")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("score").desc(), "track_id")))


def ranked_hits(recs: DataFrame, rel: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """The first ``most`` places of the lists of users who have something relevant, each place with hit 0 or 1."""
    users = rel.select("user_id").distinct()
    lists = best_first(recs.join(users, "user_id", "left_semi"), seen).where(F.col("rank") <= most)
    return lists.join(rel.withColumn("_hit", F.lit(1.0)), PAIR, "left").withColumn("hit", F.coalesce("_hit", F.lit(0.0))).drop("_hit")


def per_user(recs: DataFrame, rel: DataFrame, seen: DataFrame, ks: list[int]) -> DataFrame:
    """user_id, n_rel, recall_k, ndcg_k and n_k for every user with a relevant track; one without a list scores 0."""
    return scored(ranked_hits(recs, rel, seen, max(ks)), rel, ks)


def ideal(k: int) -> Column:
    """The most that a list of ``k`` places can gain where ``n_rel`` tracks are relevant."""
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))


def scored(hits: DataFrame, rel: DataFrame, ks: list[int]) -> DataFrame:
    """``per_user`` from ranked hits."""
    top = lambda k, x: F.sum(F.when(F.col("rank") <= k, x))
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    got = hits.groupBy("user_id").agg(*(c for k in ks for c in (top(k, F.col("hit")).alias(f"_h{k}"), top(k, gain).alias(f"_d{k}"), top(k, F.lit(1)).alias(f"_n{k}"))))
    users = rel.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rel")).join(got, "user_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return users.select("user_id", "n_rel", *(c for k in ks for c in ((zero(f"_h{k}") / F.col("n_rel")).alias(f"recall_{k}"), (zero(f"_d{k}") / ideal(k)).alias(f"ndcg_{k}"), F.coalesce(F.col(f"_n{k}"), F.lit(0)).cast("long").alias(f"n_{k}"))))


def metrics(recs: DataFrame, rel: DataFrame, seen: DataFrame, catalog: DataFrame, ks: list[int]) -> DataFrame:
    """A row for each k: means of recall and NDCG, coverage of the catalogue, share of short lists, users."""
    hits = kept(ranked_hits(recs, rel, seen, max(ks)))  # places times users: written once, read for the users and for the coverage
    users = scored(hits, rel, ks)
    shown = hits.agg(*(F.countDistinct(F.when(F.col("rank") <= k, F.col("track_id"))).alias(f"_s{k}") for k in ks))
    means = users.agg(F.count(F.lit(1)).alias("_u"), *(c for k in ks for c in (F.avg(f"recall_{k}").alias(f"_r{k}"), F.avg(f"ndcg_{k}").alias(f"_g{k}"), F.avg((F.col(f"n_{k}") < k).cast("double")).alias(f"_x{k}"))))
    size = catalog.select("track_id").distinct().agg(F.count(F.lit(1)).alias("_all"))
    one = means.join(F.broadcast(shown)).join(F.broadcast(size))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_r{k}").alias("recall"), F.col(f"_g{k}").alias("ndcg"), F.try_divide(f"_s{k}", "_all").alias("coverage"), F.col(f"_x{k}").alias("short"), F.col("_u").alias("users")) for k in ks)))
    return one.select(rows.alias("r")).select("r.*")


def only_tracks(tracks: DataFrame, recs: DataFrame, rel: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists, relevant pairs and the catalogue as if the tracks of a subset were all there are."""
    t = tracks.select("track_id").distinct()
    return recs.join(t, "track_id", "left_semi"), rel.join(t, "track_id", "left_semi"), t


def breakdown(recs: DataFrame, rel: DataFrame, seen: DataFrame, ks: list[int], k: int, groups: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a bias analysis needs and no label: "lists" (each scored user's first k places), "users" (their scores), and for each grouping
    "found " and its name: what its groups' tracks make up of the relevant pairs and how many of those are found."""
    hits = kept(ranked_hits(recs, rel, seen, max([*ks, k])))
    found = {f"found {name}": group_recall(hits, rel, g, k) for name, g in groups.items()}
    return {"lists": hits.where(F.col("rank") <= k).select(*PAIR, "rank"), "users": scored(hits, rel, ks), **found}


def group_recall(hits: DataFrame, rel: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Per track group (none: "no group"): relevant pairs, their share of all, share found in the first k."""
    found = hits.where((F.col("rank") <= k) & (F.col("hit") > 0)).select(*PAIR, F.lit(1.0).alias("_f"))
    r = rel.join(groups.select("track_id", "group"), "track_id", "left").join(found, PAIR, "left").withColumn("group", F.coalesce("group", F.lit("no group")))
    per = r.groupBy("group").agg(F.count(F.lit(1)).alias("relevant"), F.avg(F.coalesce("_f", F.lit(0.0))).alias("found"))
    return per.withColumn("share", F.col("relevant") / F.sum("relevant").over(Window.partitionBy()))


def truth_summary(rel: DataFrame, catalog: DataFrame) -> DataFrame:
    per = rel.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    a = per.agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("pairs"), F.percentile("n", F.lit(0.5)).alias("median"))
    t = rel.agg(F.countDistinct("track_id").alias("tracks"))
    c = catalog.agg(F.countDistinct("track_id").alias("catalog"))
    return a.join(F.broadcast(t)).join(F.broadcast(c))


def same_top(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of users of ``a`` whose first k places hold the same tracks in the same order in ``b``."""
    top = lambda x, name: best_first(x).where(F.col("rank") <= k).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "track_id"))).alias(name))
    return top(a, "x").join(top(b, "y"), "user_id", "left").agg(F.avg(F.coalesce((F.col("x") == F.col("y")).cast("double"), F.lit(0.0))).alias("same"))


def known_share(recs: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Share of the first k places that hold a track the user has played."""
    top = best_first(recs).where(F.col("rank") <= k)
    return top.join(seen.select(*PAIR, F.lit(1.0).alias("_s")).distinct(), PAIR, "left").agg(F.avg(F.coalesce("_s", F.lit(0.0))).alias("known"))


def paired_bootstrap(difference: np.ndarray, resamples: int = 2000, seed: int = 42) -> tuple[float, float, float]:
    """Mean of per-user differences with a 95 % interval of its resampled means (users stay paired, linear quantiles)."""
    rng = np.random.default_rng(seed)
    n = len(difference)
    means = np.fromiter((difference[rng.integers(0, n, n)].mean() for _ in range(resamples)), float, resamples)
    low, high = np.quantile(means, [0.025, 0.975])
    return float(difference.mean()), float(low), float(high)


#: The chances that a Poisson variable of mean 1 is at most 0, 1, 2, ... 9, in steps of 2^-32.
_POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(10)]


def resampled(users: DataFrame, values: list[str], by: list[str], resamples: int = 2000, seed: int = 42) -> DataFrame:
    """by, metric, users, mean, low, high: the means of ``values`` over users, per group of ``by``, with a 95 % bootstrap interval.

    A Poisson bootstrap: a user counts a Poisson(1) number of times in each resample, the same for all values, so that values stay paired.
    The number comes from 32 bits of md5(seed:user:resample / 4); no user is collected, and sums per resample start in the map tasks.
    """
    drawn = users.withColumn("_four", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // 4)))).withColumn("_digest", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string"), F.col("_four").cast("string"))))
    part = drawn.withColumn("_part", F.explode(F.array(*map(F.lit, range(4))))).withColumn("_b", F.col("_four") * 4 + F.col("_part")).where(F.col("_b") < resamples)
    u = F.conv(F.substring(F.col("_digest"), F.col("_part") * 8 + 1, F.lit(8)), 16, 10).cast("long")
    part = part.withColumn("_u", u).withColumn("_w", sum((F.when(F.col("_u") >= c, 1).otherwise(0) for c in _POISSON[1:]), F.when(F.col("_u") >= _POISSON[0], 1).otherwise(0)))
    means = part.groupBy(*by, "_b").agg(*(F.try_divide(F.sum(F.col(v) * F.col("_w")), F.sum("_w")).alias(v) for v in values))
    long = lambda df, extra, names: df.select(*by, *extra, F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).alias("x")) for v in names))).alias("_m")).select(*by, *extra, "_m.*")
    interval = long(means, [], values).groupBy(*by, "metric").agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))
    plain = long(users.groupBy(*by).agg(F.count(F.lit(1)).alias("users"), *(F.avg(v).alias(v) for v in values)), ["users"], values).withColumnRenamed("x", "mean")
    return plain.join(interval, [*by, "metric"])


def poisson_bootstrap(users: DataFrame, value: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Mean and interval of one value over all users."""
    return resampled(users, [value], [], resamples, seed).select("low", "high", "mean")


def difference(a: DataFrame, b: DataFrame, metrics: list[str], resamples: int = 2000, seed: int = 42) -> DataFrame:
    """metric, users, mean, low, high of a's scores less b's (``per_user`` of either), over the users that both have."""
    other = b.select("user_id", *(F.col(m).alias(f"_{m}") for m in metrics))
    gaps = a.join(other, "user_id").select("user_id", *((F.col(m) - F.col(f"_{m}")).alias(m) for m in metrics))
    return resampled(kept(gaps), metrics, [], resamples, seed)


def group_means(users: DataFrame, groups: DataFrame, value: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Per user group: users, the mean of ``value``, and its interval from resampling the group's users."""
    return resampled(kept(users.join(groups, "user_id").select("user_id", "group", value)), [value], ["group"], resamples, seed).drop("metric")

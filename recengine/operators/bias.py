"""Popularity bias and fairness: groups, exposure, concentration, and a popularity penalty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recengine.operators.evaluate import best_first, group_means
from recengine.operators.features import zscore
from recengine.operators.prepare import PAIR, gini
from recengine.operators.tables import placed

NO_GROUP, SMALL = "no group", "small genres"


def _named(index, names: list[str]):
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def popularity_groups(listeners: DataFrame, names: list[str]) -> DataFrame:
    """track_id, group, pct: from most to fewest ``listeners``, groups of equal shares of all listeners; a track is where its share starts.

    Two levels: tracks with the same number of listeners are one row of the ordered pass, and places among them are counted within.
    """
    per = listeners.groupBy("listeners").agg(F.count(F.lit(1)).alias("m"))
    down, up = Window.orderBy(F.col("listeners").desc()), Window.orderBy("listeners")
    before = F.coalesce(F.sum(F.col("listeners") * F.col("m")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).withColumn("_below", F.sum("m").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per = per.withColumn("_all", F.sum(F.col("listeners") * F.col("m")).over(Window.partitionBy())).withColumn("_n", F.sum("m").over(Window.partitionBy()))
    place = F.row_number().over(Window.partitionBy("listeners").orderBy("track_id")) - 1
    t = listeners.join(F.broadcast(per), "listeners").withColumn("_share", (F.col("_before") + place * F.col("listeners")) / F.col("_all"))
    g = len(names)
    return t.select("track_id", _named(F.least(F.floor(F.col("_share") * g), F.lit(g - 1)), names).alias("group"), (F.col("_below") / F.col("_n")).alias("pct"))


def listener_groups(mainstream: DataFrame, names: list[str]) -> DataFrame:
    """user_id, group: equal groups by how mainstream users are, least first (ties by user): place * groups div users."""
    rounded = mainstream.select("user_id", F.round("mainstream", 12).alias("_m"))
    ranked = placed(rounded, "_m", "user_id")
    n = mainstream.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(F.broadcast(n)).select("user_id", _named(F.floor((F.col("place") - 1) * len(names) / F.col("_n")), names).alias("group"))


def genre_groups(plays: DataFrame, track_genre: DataFrame, least: int) -> DataFrame:
    """user_id, group: the genre with most of a user's plays (ties by name); genres of fewer than ``least`` users are pooled."""
    per = plays.join(track_genre, "track_id").groupBy("user_id", "group").agg(F.sum("plays").alias("_p"))
    top = per.groupBy("user_id").agg(F.min(F.struct((-F.col("_p")).alias("p"), "group")).alias("x")).select("user_id", "x.group")
    size = top.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    return top.join(F.broadcast(size), "group").select("user_id", F.when(F.col("_n") >= least, F.col("group")).otherwise(F.lit(SMALL)).alias("group"))


def exposure(recs: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Per track group its share of the first k places; places without a group count too."""
    top = best_first(recs).where(F.col("rank") <= k).join(groups.select("track_id", "group"), "track_id", "left")
    per = top.groupBy(F.coalesce("group", F.lit(NO_GROUP)).alias("group")).agg(F.count(F.lit(1)).alias("slots"))
    return per.withColumn("share", F.col("slots") / F.sum("slots").over(Window.partitionBy()))


def concentration(recs: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """Coverage and Gini of places over the whole catalogue, tracks never shown included."""
    shown = best_first(recs).where(F.col("rank") <= k).groupBy("track_id").agg(F.count(F.lit(1)).alias("_s"))
    every = catalog.select("track_id").distinct().join(shown, "track_id", "left").select(F.coalesce("_s", F.lit(0)).alias("slots"))
    return every.agg(F.avg((F.col("slots") > 0).cast("double")).alias("coverage")).join(F.broadcast(gini(every, "slots")))


def exposure_ratio(recs: DataFrame, discoveries: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Per group its share of places over its share of what users discover by themselves."""
    shown = exposure(recs, groups, k).select("group", F.col("share").alias("shown"))
    found = discoveries.join(groups.select("track_id", "group"), "track_id", "left").groupBy(F.coalesce("group", F.lit(NO_GROUP)).alias("group")).agg(F.count(F.lit(1)).alias("_n"))
    found = found.select("group", (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias("discovered"))
    return shown.join(found, "group").withColumn("ratio", F.try_divide("shown", "discovered"))


def mean_percentile(recs: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    return best_first(recs).where(F.col("rank") <= k).join(groups, "track_id").agg(F.avg("pct").alias("pct"))


def penalised(recs: DataFrame, listeners: DataFrame, strength: float) -> DataFrame:
    """Scores less ``strength`` times popularity (log listeners), both standardised within the user by the sample deviation."""
    x = recs.join(listeners, "track_id").withColumn("_pop", F.log("listeners"))
    z = x.withColumn("_z", zscore("score", sample=True)).withColumn("_p", zscore("_pop", sample=True))
    return z.select(*PAIR, (F.col("_z") - F.lit(strength) * F.col("_p")).alias("score"))


def chosen_strength(sweep: DataFrame, loss: float) -> DataFrame:
    """Of rows (strength, metric) the largest strength whose metric is at least (1 - loss) times that of strength 0."""
    base = sweep.where("strength = 0").agg(F.max("metric").alias("_base"))
    return sweep.join(F.broadcast(base)).where(F.col("metric") >= F.col("_base") * (1 - loss)).agg(F.max("strength").alias("strength"))


def measures(got: dict[str, DataFrame], track_groups: dict[str, DataFrame], pct: DataFrame, user_groups: dict[str, DataFrame], catalog: DataFrame, k: int, resamples: int = 2000) -> DataFrame:
    """measure, group, value: all that is said of one model, from ``evaluate.breakdown``: its NDCG, how its places are spread over track groups and
    the catalogue, their mean percentile, what it finds per track group, and its NDCG per user group with an interval."""
    lists = got["lists"].withColumn("score", -F.col("rank"))
    row = lambda df, measure, group, value: df.select(F.lit(measure).alias("measure"), group.alias("group"), value.cast("double").alias("value"))
    spread = concentration(lists, catalog, k)
    out = [row(got["users"].agg(F.avg(f"ndcg_{k}").alias("x")), "ndcg", F.lit(""), F.col("x")), row(mean_percentile(lists, pct, k), "percentile", F.lit(""), F.col("pct"))]
    out += [row(spread, c, F.lit(""), F.col(c)) for c in ("coverage", "gini")]
    for name, g in track_groups.items():
        out.append(row(exposure(lists, g, k), f"places by {name}", F.col("group"), F.col("share")))
        out += [row(got[f"found {name}"], f"{c} by {name}", F.col("group"), F.col(c)) for c in ("relevant", "share", "found")]
    for name, g in user_groups.items():
        means = group_means(got["users"], g, f"ndcg_{k}", resamples)
        out += [row(means, f"{c} by {name}", F.col("group"), F.col(c)) for c in ("users", "mean", "low", "high")]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole

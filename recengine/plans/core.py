"""Queries of the relational core: preparation, splits, audit, evaluation, baselines, bias, serving, questionnaire."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.catalog import query
from recengine.functions.vectors import column_zscore, content_blocks, unit
from recengine.operators import bias, evaluate, prepare, questionnaire, recommend, serving
from recengine.operators.prepare import PAIR
from recengine.operators.tables import kept
from recengine.plans.sqltext import text
from recengine.sources import views

S = SparkSession


def split_ev(spark: S, sf: str) -> DataFrame:
    return prepare.with_split(views.listens_ev(spark, sf), 3, 3, 6)


def slices(spark: S, sf: str) -> DataFrame:
    """Who played what in which slice, each once, written: the events are read and their keys parsed once, however many parts of a plan ask for it."""
    return kept(split_ev(spark, sf).select(*PAIR, "split").distinct())


def train(spark: S, sf: str, s: DataFrame | None = None) -> DataFrame:
    return prepare.only_train(split_ev(spark, sf) if s is None else s, ["retrieval_train", "ranker_train"])


def truth(spark: S, sf: str, which: str = "val", s: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relevant, seen, catalogue): the history of val is the training slices, that of test those and val; the catalogue is training tracks."""
    s = split_ev(spark, sf) if s is None else s
    t = prepare.only_train(s, ["retrieval_train", "ranker_train"])
    history = t if which == "val" else s.where("split <> 'test'")
    return evaluate.relevant(history, s.where(F.col("split") == which)), prepare.pairs(history), t.select("track_id").distinct()


def popular(spark: S, sf: str, n: int = 10, s: DataFrame | None = None) -> DataFrame:
    t = train(spark, sf, s)
    return recommend.popular_unseen(recommend.popularity(t), prepare.pairs(t), n)


def tt_vectors(spark: S, sf: str) -> DataFrame:
    return views.vectors(spark, sf).select("track_id", F.col("tt").alias("vec"))


def tt_users(spark: S, sf: str) -> DataFrame:
    return serving.fold_in_users(train(spark, sf), tt_vectors(spark, sf), 64)


def tt_lists(spark: S, sf: str, n: int = 20, s: DataFrame | None = None) -> DataFrame:
    played = kept(prepare.pairs(train(spark, sf, s)))  # written once, read for the users' vectors and for what they have played
    v = tt_vectors(spark, sf)
    return recommend.top_unseen(serving.fold_in_users(played, v, 64), v, played, n)


def listeners(spark: S, sf: str, s: DataFrame | None = None) -> DataFrame:
    return recommend.popularity(train(spark, sf, s)).select("track_id", F.col("score").cast("long").alias("listeners"))


def groups(spark: S, sf: str, s: DataFrame | None = None) -> DataFrame:
    return bias.popularity_groups(listeners(spark, sf, s), ["head", "middle", "tail"])


# --- preparation ------------------------------------------------------------------------------------------------------


@query(text("li", """SELECT count(*) AS listens, count(DISTINCT user_id) AS users, count(DISTINCT track_id) AS tracks FROM (SELECT * FROM li, (SELECT max("timestamp") AS m FROM li) WHERE "timestamp" > m - INTERVAL 13 MONTH
    QUALIFY count(*) OVER (PARTITION BY user_id) >= 10)"""))
def prepare_window_users(spark: S, sf: str) -> DataFrame:
    inside = prepare.window_users(views.listens_li(spark, sf), 13, 10)
    return inside.agg(F.count(F.lit(1)).alias("listens"), F.countDistinct("user_id").alias("users"), F.countDistinct("track_id").alias("tracks"))


@query(text("li", """SELECT user_id, count(*) AS listens FROM li WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM li) ORDER BY md5(user_id::VARCHAR || '42') LIMIT 50) GROUP BY 1"""))
def prepare_sample_users(spark: S, sf: str) -> DataFrame:
    return prepare.sample_users(views.listens_li(spark, sf), 50, "42").groupBy("user_id").agg(F.count(F.lit(1)).alias("listens"))


@query("""SELECT n, (TIMESTAMP '2020-03-31 10:11:12' - to_months(n::INTEGER))::VARCHAR AS at FROM range(1, 14) t(n)""")
def months_before(spark: S, sf: str) -> DataFrame:
    at = F.lit("2020-03-31 10:11:12").cast("timestamp_ntz")
    return spark.range(1, 14).select(F.col("id").alias("n"), (at - F.make_ym_interval(F.lit(0), F.col("id").cast("int"))).cast("string").alias("at"))


@query(text("sp", "SELECT split, count(*) AS listens, count(DISTINCT user_id) AS users, count(DISTINCT track_id) AS tracks FROM sp GROUP BY 1"))
def split_counts(spark: S, sf: str) -> DataFrame:
    return split_ev(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("listens"), F.countDistinct("user_id").alias("users"), F.countDistinct("track_id").alias("tracks"))


@query(text("tr", "SELECT user_id, track_id, count(*) AS plays, ln(1 + count(*)) AS log_plays FROM tr GROUP BY 1, 2"), doubles="log_plays")
def plays_pairs(spark: S, sf: str) -> DataFrame:
    return prepare.plays(train(spark, sf)).drop("binary")


@query(text("tr part_", """SELECT user_id, track_id, w AS weight, ln(greatest(sum(w) OVER (PARTITION BY track_id) / sum(w) OVER (), 1e-12)) AS log_q
    FROM (SELECT user_id, track_id, ln(1 + count(*)) AS w FROM tr WHERE track_id NOT IN (SELECT track_id FROM part_ WHERE genre = 'SMALL') GROUP BY 1, 2)"""), doubles="weight log_q")
def training_pairs_logq(spark: S, sf: str) -> DataFrame:
    return prepare.training_pairs(train(spark, sf), "log_plays", views.tracks(spark, sf).where("genre = 'SMALL'").select("track_id"))


# --- audit ------------------------------------------------------------------------------------------------------------


@query(text("li", """SELECT count(*) AS listens, count(DISTINCT user_id) AS users, count(DISTINCT track_id) AS tracks, count(DISTINCT (user_id, track_id)) AS pairs,
    count(DISTINCT (user_id, track_id)) / (count(DISTINCT user_id) * count(DISTINCT track_id)) AS density, 1 - count(DISTINCT (user_id, track_id)) / count(*) AS repeat_share FROM li"""), doubles="density repeat_share")
def audit_size(spark: S, sf: str) -> DataFrame:
    return prepare.audit_size(views.listens_li(spark, sf))


@query(text("li", """SELECT avg(n) AS mean_listens, quantile_cont(n, 0.1) AS p10_listens, quantile_cont(n, 0.5) AS median_listens, quantile_cont(n, 0.9) AS p90_listens, avg(t) AS mean_tracks, quantile_cont(t, 0.5) AS median_tracks
    FROM (SELECT user_id, count(*) AS n, count(DISTINCT track_id) AS t FROM li GROUP BY 1)"""), doubles="mean_listens p10_listens median_listens p90_listens mean_tracks median_tracks")
def audit_user_quantiles(spark: S, sf: str) -> DataFrame:
    return prepare.audit_users(views.listens_li(spark, sf))


@query(text("li", """SELECT date_trunc('month', "timestamp")::DATE::VARCHAR AS month, count(*) AS listens, count(DISTINCT user_id) AS users FROM li GROUP BY 1"""))
def audit_monthly(spark: S, sf: str) -> DataFrame:
    return prepare.audit_months(views.listens_li(spark, sf)).withColumn("month", F.col("month").cast("string"))


@query(text("li", """SELECT sum((2 * i - n - 1) * v) / (max(n) * sum(v)) AS gini FROM (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM (SELECT track_id, count(*) AS v FROM li GROUP BY 1))"""), doubles="gini")
def audit_gini(spark: S, sf: str) -> DataFrame:
    return prepare.gini(views.listens_li(spark, sf).groupBy("track_id").agg(F.count(F.lit(1)).alias("n")), "n")


@query(text("li", """SELECT sum(v) FILTER (r <= greatest(1, round_even(0.01 * n, 0))) / sum(v) AS top_share, avg((v < 20)::INT) AS under_few
    FROM (SELECT v, row_number() OVER (ORDER BY v DESC, track_id) AS r, count(*) OVER () AS n FROM (SELECT track_id, count(*) AS v FROM li GROUP BY 1))"""), doubles="top_share under_few")
def audit_top1pct(spark: S, sf: str) -> DataFrame:
    return prepare.audit_top_share(views.listens_li(spark, sf), few=20)


@query(text("li", """SELECT avg(h) AS tracks, sum(h * n) / sum(n) AS listens FROM (SELECT count(*) AS n, (track_id IN (SELECT lpad(vec_id::VARCHAR, 8, '0') FROM embeddings))::INT AS h FROM li GROUP BY track_id)"""), doubles="tracks listens")
def audit_coverage(spark: S, sf: str) -> DataFrame:
    return prepare.audit_coverage(views.listens_li(spark, sf), views.vectors(spark, sf, 8))


# --- evaluation -------------------------------------------------------------------------------------------------------


@query(text("rel", "SELECT * FROM rel"))
def relevant_val(spark: S, sf: str) -> DataFrame:
    return truth(spark, sf)[0]


@query(text("sp", "SELECT DISTINCT user_id, track_id FROM sp WHERE split = 'test' EXCEPT SELECT user_id, track_id FROM sp WHERE split <> 'test'"))
def relevant_test(spark: S, sf: str) -> DataFrame:
    return truth(spark, sf, "test")[0]


@query(text("rel nrel cat", "SELECT count(*) AS users, sum(n_rel) AS pairs, quantile_cont(n_rel, 0.5) AS median, (SELECT count(DISTINCT track_id) FROM rel) AS tracks, (SELECT count(*) FROM cat) AS catalog FROM nrel"), doubles="median", longs="pairs")
def truth_summary(spark: S, sf: str) -> DataFrame:
    rel, _, catalog = truth(spark, sf)
    return evaluate.truth_summary(rel, catalog)


_METRICS = """SELECT k, avg(h / n_rel) AS recall, avg(d / ideal) AS ndcg, max(c) AS coverage, avg((n < k)::INT) AS short, count(*) AS users FROM (
    SELECT k, n_rel, ideal, coalesce(sum(hit) FILTER ("rank" <= k), 0) AS h, coalesce(sum(hit / log2("rank" + 1)) FILTER ("rank" <= k), 0) AS d, count(*) FILTER ("rank" <= k) AS n,
        (SELECT count(DISTINCT track_id) FROM hit x WHERE x."rank" <= k) / (SELECT count(*) FROM cat) AS c
    FROM nrel CROSS JOIN (VALUES (5), (10)) t(k) JOIN ideal ON m = least(k, n_rel) LEFT JOIN hit USING (user_id) GROUP BY user_id, k, n_rel, ideal) GROUP BY k"""


@query(text("hit cat ideal", _METRICS), doubles="recall ndcg coverage short", longs="k")
def eval_popularity(spark: S, sf: str) -> DataFrame:
    rel, seen, catalog = truth(spark, sf)
    return evaluate.metrics(popular(spark, sf), rel, seen, catalog, [5, 10])


@query(text("hit ideal", """SELECT user_id, n_rel, coalesce(sum(hit), 0) / n_rel AS recall_10, coalesce(sum(hit / log2("rank" + 1)), 0) / max(ideal) AS ndcg_10, count("rank") AS n_10
    FROM nrel JOIN ideal ON m = least(10, n_rel) LEFT JOIN hit USING (user_id) GROUP BY 1, 2"""), doubles="recall_10 ndcg_10")
def eval_per_user(spark: S, sf: str) -> DataFrame:
    rel, seen, _ = truth(spark, sf)
    return evaluate.per_user(popular(spark, sf), rel, seen, [10])


@query(text("hit rel grp", """SELECT coalesce("group", 'no group') AS "group", count(*) AS relevant, avg(coalesce(hit, 0)) AS found, count(*) / sum(count(*)) OVER () AS share
    FROM rel LEFT JOIN grp USING (track_id) LEFT JOIN hit USING (user_id, track_id) GROUP BY 1"""), doubles="found share")
def eval_group_recall(spark: S, sf: str) -> DataFrame:
    rel, seen, _ = truth(spark, sf)
    return evaluate.group_recall(evaluate.ranked_hits(popular(spark, sf), rel, seen, 10), rel, groups(spark, sf), 10)


@query(text("poprecs rel part_", """SELECT count(*) AS users, avg(h / n) AS recall FROM (SELECT user_id, count(*) AS n, coalesce(sum(hit), 0) AS h FROM (SELECT user_id, track_id FROM rel JOIN part_ USING (track_id) WHERE genre = 'ECONOMY') LEFT JOIN
    (SELECT user_id, track_id, 1 AS hit FROM poprecs JOIN part_ USING (track_id) WHERE genre = 'ECONOMY') USING (user_id, track_id) GROUP BY 1)"""), doubles="recall")
def eval_only_tracks(spark: S, sf: str) -> DataFrame:
    rel, seen, _ = truth(spark, sf)
    recs, some, _ = evaluate.only_tracks(views.tracks(spark, sf).where("genre = 'ECONOMY'"), popular(spark, sf), rel)
    return evaluate.per_user(recs, some, seen, [10]).agg(F.count(F.lit(1)).alias("users"), F.avg("recall_10").alias("recall"))


@query(text("hit", 'SELECT user_id, track_id, "rank", hit FROM hit'), doubles="hit", longs='"rank"')
def eval_hits(spark: S, sf: str) -> DataFrame:
    rel, seen, _ = truth(spark, sf)
    return evaluate.ranked_hits(popular(spark, sf), rel, seen, 10).select(*PAIR, "rank", "hit")


@query(text("tops poprecs", """SELECT avg(coalesce((x = y)::INT, 0)) AS same FROM (SELECT user_id, list(track_id ORDER BY "rank") AS x FROM poprecs WHERE "rank" <= 1 GROUP BY 1) LEFT JOIN
    (SELECT user_id, list(track_id ORDER BY "rank") AS y FROM tops WHERE "rank" <= 1 GROUP BY 1) USING (user_id)"""), doubles="same")
def eval_same_top(spark: S, sf: str) -> DataFrame:
    return evaluate.same_top(popular(spark, sf), tt_lists(spark, sf).select(*PAIR, "score"), 1)


@query(text("pop usr seen", """SELECT avg(((user_id, track_id) IN (SELECT (user_id, track_id) FROM seen))::INT) AS known FROM usr, (SELECT track_id FROM pop ORDER BY score DESC, track_id LIMIT 10)"""), doubles="known")
def eval_known_share(spark: S, sf: str) -> DataFrame:
    t = train(spark, sf)
    same = recommend.popular_unseen(recommend.popularity(t), prepare.pairs(t).limit(0), 10, users=t)
    return evaluate.known_share(same, prepare.pairs(t), 10)


@query(text("tr", """SELECT user_id, track_id, max(s) AS score, row_number() OVER (PARTITION BY user_id ORDER BY max(s) DESC, track_id) AS "rank" FROM (SELECT user_id, track_id, hour("timestamp") AS s FROM tr) GROUP BY 1, 2"""), longs="score")
def eval_dedupe_best(spark: S, sf: str) -> DataFrame:
    return evaluate.best_first(train(spark, sf).select(*PAIR, F.hour("timestamp").cast("long").alias("score")))


#: The chances that a Poisson variable of mean 1 is at most 0, 1, ... 9, in steps of 2^-32, as sums of comparisons in SQL.
_TIMES = " + ".join(f"(u >= {c})::INT" for c in evaluate._POISSON)
_DRAWS = f"""draws AS (SELECT user_id, b, {_TIMES} AS w FROM (SELECT user_id, f * 4 + p AS b, ('0x' || substr(md5('42:' || user_id || ':' || f), (p * 8 + 1)::INT, 8))::BIGINT AS u
    FROM (SELECT DISTINCT user_id FROM x), range(500) t(f), range(4) s(p)))"""


def _interval(by: str = "") -> str:
    """SQL for users, mean, low and high of v per metric, from x (user_id, metric, v and the columns ``by``)."""
    g = f"{by}, " if by else ""
    return f"""{_DRAWS}, means AS (SELECT {g}metric, b, sum(v * w) / nullif(sum(w), 0) AS m FROM x JOIN draws USING (user_id) GROUP BY {g}metric, b)
    SELECT * FROM (SELECT {g}metric, count(*) AS users, avg(v) AS mean FROM x GROUP BY {g}metric) JOIN (SELECT {g}metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY {g}metric) USING ({g}metric)"""


def _scores(lists: str, name: str) -> str:
    """SQL for each scored user's recall and ndcg at 5 and 10 on a list, long: user_id, metric, v."""
    return f"""{name}h AS (SELECT p.user_id, "rank", (r.track_id IS NOT NULL)::INT::DOUBLE AS hit FROM {lists} p JOIN nrel USING (user_id) LEFT JOIN rel r USING (user_id, track_id)),
    {name} AS (SELECT user_id, unnest([{{'metric': 'recall_' || k, 'v': coalesce(sum(hit) FILTER ("rank" <= k), 0) / n_rel}}, {{'metric': 'ndcg_' || k, 'v': coalesce(sum(hit / log2("rank" + 1)) FILTER ("rank" <= k), 0) / max(ideal)}}], recursive := true)
        FROM nrel CROSS JOIN (VALUES (5), (10)) t(k) JOIN ideal ON m = least(k, n_rel) LEFT JOIN {name}h USING (user_id) GROUP BY user_id, k, n_rel)"""


_GAPS = text("tops poprecs rel nrel ideal", "").rstrip() + ", " + _scores("tops", "one") + ", " + _scores("poprecs", "two") + ", x AS (SELECT user_id, metric, one.v - two.v AS v FROM one JOIN two USING (user_id, metric))"


def tt_and_popular(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    s = slices(spark, sf)
    rel, seen, _ = truth(spark, sf, s=s)
    return evaluate.per_user(tt_lists(spark, sf, s=s).select(*PAIR, "score"), rel, seen, [5, 10]), evaluate.per_user(popular(spark, sf, s=s), rel, seen, [5, 10])


@query(_GAPS + ", " + _interval(), doubles="mean low high")
def eval_difference(spark: S, sf: str) -> DataFrame:
    """Recall and NDCG of the vectors' lists less those of popularity, with bootstrap intervals."""
    return evaluate.difference(*tt_and_popular(spark, sf), ["recall_5", "recall_10", "ndcg_5", "ndcg_10"])


@query(_GAPS + ", " + _interval().replace("SELECT * FROM (SELECT", "SELECT mean, low, high FROM (SELECT", 1) + " WHERE metric = 'ndcg_10'", doubles="mean low high")
def eval_bootstrap(spark: S, sf: str) -> DataFrame:
    """Difference of NDCG between two lists with a Poisson-bootstrap interval."""
    a, b = tt_and_popular(spark, sf)
    gaps = a.select("user_id", F.col("ndcg_10").alias("_a")).join(b.select("user_id", F.col("ndcg_10").alias("_b")), "user_id")
    return evaluate.poisson_bootstrap(gaps.select("user_id", (F.col("_a") - F.col("_b")).alias("d")), "d")


_FOUND = """SELECT '{0}' AS grouping_, coalesce({1}, 'no group') AS "group", count(*) AS relevant, count(*) / sum(count(*)) OVER () AS share, avg(coalesce(hit, 0)) AS found FROM rel LEFT JOIN {2} USING (track_id) LEFT JOIN hit USING (user_id, track_id) GROUP BY 2"""


@query(text("hit rel grp part_", _FOUND.format("popularity", '"group"', "grp") + " UNION ALL " + _FOUND.format("genre", "genre", "part_")), doubles="share found")
def eval_breakdown(spark: S, sf: str) -> DataFrame:
    """What two groupings' tracks make up of the relevant pairs and how many of those popularity finds."""
    rel, seen, _ = truth(spark, sf)
    both = {"popularity": groups(spark, sf), "genre": views.tracks(spark, sf).select("track_id", F.col("genre").alias("group"))}
    got = evaluate.breakdown(popular(spark, sf), rel, seen, [10], 10, both)
    frames = [got[f"found {g}"].withColumn("grouping_", F.lit(g)) for g in both]
    return frames[0].unionByName(frames[1])


# --- baselines --------------------------------------------------------------------------------------------------------


@query(text("pop", "SELECT * FROM pop"), doubles="score")
def pop_users(spark: S, sf: str) -> DataFrame:
    return recommend.popularity(train(spark, sf))


@query(text("tr", """SELECT track_id, count(*)::DOUBLE AS score FROM tr, (SELECT max("timestamp") AS m FROM tr) WHERE "timestamp" > m - INTERVAL 7 DAY GROUP BY 1"""), doubles="score")
def pop_listens_window(spark: S, sf: str) -> DataFrame:
    return recommend.popularity(train(spark, sf), "listens", 7)


@query(text("poprecs", "SELECT user_id, track_id, score FROM poprecs"), doubles="score")
def pop_recs(spark: S, sf: str) -> DataFrame:
    return popular(spark, sf)


_KNN = """nb AS (SELECT * FROM (SELECT a.track_id AS item, b.track_id AS neighbour, count(*) / sqrt(max(x.listeners) * max(y.listeners)) AS similarity,
    row_number() OVER (PARTITION BY a.track_id ORDER BY round(count(*) / sqrt(max(x.listeners) * max(y.listeners)), 9) DESC, b.track_id) AS place
    FROM seen a JOIN seen b USING (user_id) JOIN lst x ON x.track_id = a.track_id JOIN lst y ON y.track_id = b.track_id GROUP BY 1, 2) WHERE place <= 10)"""


@query(text("seen lst", "").rstrip() + ", " + _KNN + " SELECT * FROM nb", doubles="similarity")
def knn_neighbours(spark: S, sf: str) -> DataFrame:
    return recommend.item_neighbours(train(spark, sf), 10)


@query(text("seen lst", "").rstrip() + ", " + _KNN + """ SELECT * FROM (SELECT user_id, neighbour AS track_id, sum(similarity) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(sum(similarity), 9) DESC, neighbour) AS "rank"
    FROM seen JOIN nb ON item = track_id WHERE (user_id, neighbour) NOT IN (SELECT (user_id, track_id) FROM seen) GROUP BY 1, 2) WHERE "rank" <= 10""", doubles="score")
def knn_recs(spark: S, sf: str) -> DataFrame:
    t = train(spark, sf)
    return recommend.knn_unseen(t, recommend.item_neighbours(t, 10), 10)


# --- vectors ----------------------------------------------------------------------------------------------------------


@query(text("uemb", "SELECT track_id, k, u[k] AS x FROM uemb, range(1, 65) t(k)"), doubles="x")
def vec_unit(spark: S, sf: str) -> DataFrame:
    return tt_vectors(spark, sf).select("track_id", F.posexplode(unit("vec")).alias("k", "x")).withColumn("k", F.col("k").cast("long") + 1)


@query(text("user_", "SELECT user_id, k, vec[k] AS x FROM user_, range(1, 65) t(k)"), doubles="x")
def vec_mean_direction(spark: S, sf: str) -> DataFrame:
    return tt_users(spark, sf).select("user_id", F.posexplode("vec").alias("k", "x")).withColumn("k", F.col("k").cast("long") + 1)


@query(text("tops", "SELECT * FROM tops"), doubles="score")
def vec_topk_unseen(spark: S, sf: str) -> DataFrame:
    return tt_lists(spark, sf)


@query(text("uemb", """SELECT * FROM (SELECT a.track_id, b.track_id AS other, list_dot_product(a.u, b.u) AS score, row_number() OVER (PARTITION BY a.track_id ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, b.track_id) AS "rank"
    FROM uemb a, uemb b WHERE a.track_id <> b.track_id) WHERE "rank" <= 5"""), doubles="score")
def vec_similar_tracks(spark: S, sf: str) -> DataFrame:
    v = tt_vectors(spark, sf)
    return recommend.similar_tracks(v, v, 5)


@query(text("emb", """SELECT track_id, k, (tt[k] - avg(tt[k]) OVER w) / CASE WHEN stddev_pop(tt[k]) OVER w > 0 THEN stddev_pop(tt[k]) OVER w ELSE 1 END AS x FROM emb, range(1, 65) t(k) WINDOW w AS (PARTITION BY k)"""), doubles="x")
def vec_zscore(spark: S, sf: str) -> DataFrame:
    z = column_zscore(tt_vectors(spark, sf), "vec", 64)
    return z.select("track_id", F.posexplode("vec").alias("k", "x")).withColumn("k", F.col("k").cast("long") + 1)


@query(text("blk", """SELECT track_id, max(h) AS has_lyrics, sum(x) AS total, sum(x * x) AS squares FROM (SELECT track_id, h, CASE WHEN h = 0 THEN 0 ELSE (x - m) / CASE WHEN s > 0 THEN s ELSE 1 END END AS x FROM
    (SELECT track_id, h, x, avg(x) FILTER (h = 1) OVER (PARTITION BY k) AS m, stddev_pop(x) FILTER (h = 1) OVER (PARTITION BY k) AS s FROM
    (SELECT track_id, k, lyrics[k] AS x, (list_dot_product(lyrics, lyrics) > 0)::INT::DOUBLE AS h FROM blk, range(1, 17) t(k)))) GROUP BY 1"""), doubles="has_lyrics total squares")
def vec_content_blocks(spark: S, sf: str) -> DataFrame:
    c = content_blocks(views.vectors(spark, sf), 32, 16)
    add = lambda f: F.aggregate("lyrics", F.lit(0.0), lambda s, x: s + f(x))
    return c.select("track_id", "has_lyrics", add(lambda x: x).alias("total"), add(lambda x: x * x).alias("squares"))


# --- bias -------------------------------------------------------------------------------------------------------------


@query(text("grp", "SELECT * FROM grp"), doubles="pct")
def bias_pop_groups(spark: S, sf: str) -> DataFrame:
    return groups(spark, sf)


@query(text("grp seen", """SELECT user_id, CASE (row_number() OVER (ORDER BY round(avg(pct), 12), user_id) - 1) * 3 // count(*) OVER () WHEN 0 THEN 'niche' WHEN 1 THEN 'middle' ELSE 'mainstream' END AS "group" FROM seen JOIN grp USING (track_id) GROUP BY 1"""))
def bias_listener_groups(spark: S, sf: str) -> DataFrame:
    m = prepare.pairs(train(spark, sf)).join(groups(spark, sf), "track_id").groupBy("user_id").agg(F.avg("pct").alias("mainstream"))
    return bias.listener_groups(m, ["niche", "middle", "mainstream"])


@query(text("tr part_", """SELECT user_id, CASE WHEN count(*) OVER (PARTITION BY g) >= 20 THEN g ELSE 'small genres' END AS "group" FROM
    (SELECT user_id, arg_min(genre, (-n, genre)) AS g FROM (SELECT user_id, genre, count(*) AS n FROM tr JOIN part_ USING (track_id) GROUP BY 1, 2) GROUP BY 1)"""))
def bias_genre_groups(spark: S, sf: str) -> DataFrame:
    return bias.genre_groups(prepare.plays(train(spark, sf)), views.tracks(spark, sf).select("track_id", F.col("genre").alias("group")), 20)


@query(text("tops grp", """SELECT coalesce("group", 'no group') AS "group", count(*) AS slots, count(*) / sum(count(*)) OVER () AS share FROM tops LEFT JOIN grp USING (track_id) WHERE "rank" <= 10 GROUP BY 1"""), doubles="share")
def bias_exposure(spark: S, sf: str) -> DataFrame:
    return bias.exposure(tt_lists(spark, sf), groups(spark, sf), 10)


@query(text("tops cat", """SELECT avg((v > 0)::INT) AS coverage, sum((2 * i - n - 1) * v) / (max(n) * sum(v)) AS gini FROM (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM
    (SELECT track_id, count("rank") AS v FROM cat LEFT JOIN (SELECT * FROM tops WHERE "rank" <= 10) USING (track_id) GROUP BY 1))"""), doubles="coverage gini")
def bias_concentration(spark: S, sf: str) -> DataFrame:
    return bias.concentration(tt_lists(spark, sf), truth(spark, sf)[2], 10)


@query(text("tops grp rel", """SELECT "group", shown, discovered, shown / discovered AS ratio FROM (SELECT coalesce("group", 'no group') AS "group", count(*) / sum(count(*)) OVER () AS shown FROM tops LEFT JOIN grp USING (track_id) WHERE "rank" <= 10 GROUP BY 1)
    JOIN (SELECT coalesce("group", 'no group') AS "group", count(*) / sum(count(*)) OVER () AS discovered FROM rel LEFT JOIN grp USING (track_id) GROUP BY 1) USING ("group")"""), doubles="shown discovered ratio")
def bias_ratio(spark: S, sf: str) -> DataFrame:
    s = slices(spark, sf)
    return bias.exposure_ratio(tt_lists(spark, sf, s=s), truth(spark, sf, s=s)[0], groups(spark, sf, s), 10)


_PENALTY = """z AS (SELECT user_id, track_id, coalesce((score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0), 0) AS a, coalesce((ln(listeners) - avg(ln(listeners)) OVER w) / nullif(stddev_samp(ln(listeners)) OVER w, 0), 0) AS b
    FROM tops JOIN lst USING (track_id) WINDOW w AS (PARTITION BY user_id))"""


@query(text("tops lst", "").rstrip() + ", " + _PENALTY + " SELECT user_id, track_id, a - 0.3 * b AS score FROM z", doubles="score")
def bias_penalised(spark: S, sf: str) -> DataFrame:
    s = slices(spark, sf)
    return bias.penalised(tt_lists(spark, sf, s=s).select(*PAIR, "score"), listeners(spark, sf, s), 0.3)


@query(text("tops lst grp", "").rstrip() + ", " + _PENALTY + """ SELECT s AS strength, avg(("group" = 'tail')::INT) AS tail, avg(pct) AS pct FROM (SELECT s, track_id, row_number() OVER (PARTITION BY s, user_id ORDER BY round(a - s * b, 9) DESC, track_id) AS r
    FROM z, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) t(s)) JOIN grp USING (track_id) WHERE r <= 10 GROUP BY 1""", doubles="strength tail pct")
def bias_lambda_sweep(spark: S, sf: str) -> DataFrame:
    # each strength reads all three: written once
    lists, l, g = kept(tt_lists(spark, sf).select(*PAIR, "score")), kept(listeners(spark, sf)), kept(groups(spark, sf))
    out = None
    for s in (0.0, 0.1, 0.5, 1.0):
        one = recommend.first_n(bias.penalised(lists, l, s), 10).join(g, "track_id").agg(F.lit(s).alias("strength"), F.avg((F.col("group") == "tail").cast("double")).alias("tail"), F.avg("pct").alias("pct"))
        out = one if out is None else out.unionByName(one)
    return out


# --- serving and questionnaire ----------------------------------------------------------------------------------------


@query(text("tr", """SELECT user_id, track_id, epoch_us("timestamp") AS at FROM tr LEFT JOIN (SELECT user_id, l AS cut FROM (SELECT user_id, track_id, max("timestamp") AS l, row_number() OVER (PARTITION BY user_id ORDER BY max("timestamp") DESC, track_id) AS p
    FROM tr GROUP BY 1, 2) WHERE p = 6) USING (user_id) WHERE cut IS NULL OR "timestamp" > cut"""))
def recent_stretch(spark: S, sf: str) -> DataFrame:
    return serving.recent_stretch(train(spark, sf).drop("split"), 5).select(*PAIR, F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"))


@query(text("tr", """SELECT user_id, track_id, place, 0.5 ** ((place - 1) / 10) AS weight FROM (SELECT user_id, track_id, dense_rank() OVER (PARTITION BY user_id ORDER BY max("timestamp") DESC) AS place FROM tr GROUP BY 1, 2)"""), doubles="weight")
def recency_weights(spark: S, sf: str) -> DataFrame:
    return serving.recency_weights(train(spark, sf), 10)


@query(text("tr", """SELECT user_id, track_id, place FROM (SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY max("timestamp") DESC, track_id) AS place FROM tr GROUP BY 1, 2) WHERE place <= 5"""))
def serve_recent_tracks(spark: S, sf: str) -> DataFrame:
    return serving.recent_tracks(train(spark, sf), 5).select(*PAIR, "place")


@query(text("tops part_", """SELECT user_id, track_id, "rank", "rank" AS retrieval_rank, title, artist FROM tops JOIN part_ USING (track_id) WHERE "rank" <= 10"""))
def serve_known(spark: S, sf: str) -> DataFrame:
    lists = serving.recommend_known(tt_users(spark, sf), tt_vectors(spark, sf), prepare.pairs(train(spark, sf)), 20)
    return serving.present(lists, views.tracks(spark, sf), lists, 10)


#: The ordered words that put a track's first genre label into a group.
GENRE_RULES = [
    ("metal", ["metal", "grindcore", "deathcore", "djent"]),
    ("hip hop", ["hip hop", "hip-hop", "rap", "grime"]),
    ("punk and hardcore", ["punk", "core", "emo", "ska"]),
    ("electronic", ["electro", "tronica", "house", "techno", "trance", "dubstep", "ambient", "edm", "drum and bass", "idm", "downtempo", "trip hop", "synth", "dance", "chillwave", "industrial", "vaporwave", "ebm"]),
    ("folk and country", ["folk", "country", "singer-songwriter", "americana", "bluegrass", "acoustic"]),
    ("soul, r&b and funk", ["soul", "r&b", "rnb", "funk", "motown", "disco"]),
    ("jazz and blues", ["jazz", "blues", "swing", "bossa"]),
    ("classical and soundtrack", ["classical", "soundtrack", "score", "opera", "piano", "orchestra"]),
    ("latin, reggae and world", ["latin", "reggae", "mpb", "samba", "sertanejo", "forro", "world", "afro", "brazil", "pagode", "dub"]),
    ("rock", ["rock", "grunge", "shoegaze", "psychedelic", "new wave", "britpop", "post-"]),
    ("pop", ["pop"]),
]


def _rules_sql(label: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({label}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in GENRE_RULES) + " ELSE 'other' END"


_LABELS = ["Deathcore, pop", " post-rock", "Hip-Hop / Rap", "zydeco", "J-Pop", "", "Trip Hop", "Piano Rock"]


@query("SELECT l AS label, " + _rules_sql("lower(trim(split_part(l, ',', 1)))") + ' AS "group" FROM (VALUES ' + ", ".join(f"('{x}')" for x in _LABELS) + ") t(l)")
def meta_genre_rules(spark: S, sf: str) -> DataFrame:
    labels = spark.createDataFrame([(x,) for x in _LABELS], "label string")
    return labels.select("label", serving.genre_group(F.col("label"), GENRE_RULES).alias("group"))


@query("""SELECT l AS label, CASE WHEN contains(f, 'eco') OR contains(f, 'small') THEN 'a' WHEN contains(f, 'medium') OR contains(f, 'l') THEN 'b' ELSE 'other' END AS "group", count(*) AS n
    FROM (SELECT p_type AS l, lower(trim(split_part(p_type || ', ' || p_name, ',', 1))) AS f FROM part) GROUP BY 1, 2""")
def meta_genre_group(spark: S, sf: str) -> DataFrame:
    p = views.table(spark, sf, "part")
    g = serving.genre_group(F.concat("p_type", F.lit(", "), "p_name"), [("a", ["eco", "small"]), ("b", ["medium", "l"])])
    return p.groupBy(F.col("p_type").alias("label"), g.alias("group")).agg(F.count(F.lit(1)).alias("n"))


@query(text("tr part_", """SELECT * FROM (SELECT user_id, artist AS "group", row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, artist) AS place FROM tr JOIN part_ USING (track_id) GROUP BY 1, 2) WHERE place <= 3"""))
def q_favourites(spark: S, sf: str) -> DataFrame:
    return questionnaire.favourites(train(spark, sf), views.tracks(spark, sf), 3)


_TASTE = "taste AS (SELECT user_id, k AS genre, sum(genres[k]) AS weight FROM seen JOIN blk USING (track_id), range(1, 17) t(k) GROUP BY 1, 2)"


def track_genres(spark: S, sf: str) -> DataFrame:
    return views.vectors(spark, sf).select("track_id", F.posexplode("genres").alias("genre", "weight")).withColumn("genre", F.col("genre").cast("long") + 1)


@query(text("seen blk", "").rstrip() + ", " + _TASTE + " SELECT * FROM (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, genre) AS place FROM taste WHERE weight > 0) WHERE place <= 3")
def q_strongest(spark: S, sf: str) -> DataFrame:
    return questionnaire.strongest(questionnaire.taste(prepare.pairs(train(spark, sf)), track_genres(spark, sf), groups(spark, sf))[0], 3)


@query(text("seen grp", """SELECT user_id, mainstream, CASE WHEN mainstream <= quantile_cont(mainstream, 1/3) OVER () THEN 0 WHEN mainstream <= quantile_cont(mainstream, 2/3) OVER () THEN 1 ELSE 2 END AS band FROM
    (SELECT user_id, round(avg(pct), 9) AS mainstream FROM seen JOIN grp USING (track_id) GROUP BY 1)"""), doubles="mainstream", longs="band")
def q_thirds(spark: S, sf: str) -> DataFrame:
    m = questionnaire.taste(prepare.pairs(train(spark, sf)), track_genres(spark, sf), groups(spark, sf))[1].withColumn("mainstream", F.round("mainstream", 9))
    return questionnaire.thirds(m, m, "mainstream")


@query(text("lst part_", 'SELECT artist AS "group", track_id, row_number() OVER (PARTITION BY artist ORDER BY listeners DESC, track_id) AS place FROM part_ JOIN lst USING (track_id)'))
def q_most_listened(spark: S, sf: str) -> DataFrame:
    return questionnaire.most_listened(views.tracks(spark, sf).select(F.col("artist").alias("group"), "track_id"), listeners(spark, sf))


@query(text("tr lst part_", """SELECT DISTINCT user_id, m.track_id FROM (SELECT user_id, artist, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, artist) AS place FROM tr JOIN part_ USING (track_id) GROUP BY 1, 2) f
    JOIN (SELECT artist, track_id, row_number() OVER (PARTITION BY artist ORDER BY listeners DESC, track_id) AS place FROM part_ JOIN lst USING (track_id)) m USING (artist) WHERE f.place <= 3 AND m.place <= 2"""))
def q_seed_tracks(spark: S, sf: str) -> DataFrame:
    return questionnaire.seed_tracks(q_favourites(spark, sf), q_most_listened(spark, sf), 2)


@query(text("seen blk user_", "").rstrip() + ", " + _TASTE + """, st AS (SELECT user_id, genre FROM (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, genre) AS place FROM taste WHERE weight > 0) WHERE place <= 3),
    ln_ AS (SELECT user_id, sqrt(sum(weight * weight)) AS l FROM taste GROUP BY 1), cn AS (SELECT user_id, sqrt(count(*)) AS l FROM st GROUP BY 1),
    sim AS (SELECT st.user_id, t.user_id AS other, row_number() OVER (PARTITION BY st.user_id ORDER BY round(sum(weight / ln_.l / cn.l), 9) DESC, t.user_id) AS place FROM st JOIN taste t USING (genre) JOIN ln_ ON ln_.user_id = t.user_id JOIN cn ON cn.user_id = st.user_id GROUP BY 1, 2)
    SELECT user_id, k, x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS x FROM (SELECT sim.user_id, k, sum(vec[k]) AS x FROM sim JOIN user_ u ON u.user_id = other, range(1, 65) t(k) WHERE place <= 5 GROUP BY 1, 2)""", doubles="x")
def q_look_alikes(spark: S, sf: str) -> DataFrame:
    profile = questionnaire.taste(prepare.pairs(train(spark, sf)), track_genres(spark, sf), groups(spark, sf))[0]
    answers = questionnaire.strongest(profile, 3).select("user_id", "genre", F.lit(1.0).alias("weight"))
    known = profile.withColumnRenamed("user_id", "other").join(tt_users(spark, sf).withColumnRenamed("user_id", "other"), "other")
    alike = questionnaire.look_alikes(answers, known, 64, 5, list(range(1, 17)))
    return alike.select("user_id", F.posexplode("vec").alias("k", "x")).withColumn("k", F.col("k").cast("long") + 1)


_LISTENERS = """(SELECT user_id, CASE (row_number() OVER (ORDER BY round(avg(pct), 12), user_id) - 1) * 3 // count(*) OVER () WHEN 0 THEN 'niche' WHEN 1 THEN 'middle' ELSE 'mainstream' END AS "group" FROM seen JOIN grp USING (track_id) GROUP BY 1)"""


@query(text("hit ideal grp seen", "").rstrip() + f""", x AS (SELECT user_id, "group", 'ndcg' AS metric, coalesce(sum(hit / log2("rank" + 1)), 0) / max(ideal) AS v FROM nrel JOIN ideal ON m = least(10, n_rel) JOIN {_LISTENERS} USING (user_id) LEFT JOIN hit USING (user_id) GROUP BY 1, 2), """
    + _interval('"group"').replace("SELECT * FROM (SELECT", "SELECT * EXCLUDE (metric) FROM (SELECT", 1), doubles="mean low high")
def bias_group_means(spark: S, sf: str) -> DataFrame:
    rel, seen, _ = truth(spark, sf)
    users = evaluate.per_user(popular(spark, sf), rel, seen, [10])
    return evaluate.group_means(users, bias_listener_groups(spark, sf), "ndcg_10")


@query(text("tops grp", 'SELECT avg(pct) AS pct FROM tops JOIN grp USING (track_id) WHERE "rank" <= 10'), doubles="pct")
def bias_mean_percentile(spark: S, sf: str) -> DataFrame:
    return bias.mean_percentile(tt_lists(spark, sf), groups(spark, sf), 10)


_VAL = """vp AS (SELECT DISTINCT user_id, track_id FROM sp WHERE split = 'val'), vs AS (SELECT user_id, k, sum(u[k]) AS x FROM vp JOIN uemb USING (track_id), range(1, 65) t(k) GROUP BY 1, 2),
    vu AS (SELECT user_id, list_transform(list(x ORDER BY k), lambda y: y / sqrt(sum(x * x))) AS vec FROM vs GROUP BY 1)"""


@query(text("sp uemb emb", "").rstrip() + ", " + _VAL.replace("list_transform(list(x ORDER BY k), lambda y: y / sqrt(sum(x * x))) AS vec", "list(x ORDER BY k) AS v0, sqrt(sum(x * x)) AS n") + """ SELECT * FROM (SELECT user_id, track_id, list_dot_product(v0, tt) / n AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(list_dot_product(v0, tt) / n, 9) DESC, track_id) AS "rank"
    FROM vu, emb WHERE (user_id, track_id) NOT IN (SELECT (user_id, track_id) FROM vp)) WHERE "rank" <= 10""", doubles="score")
def serve_new(spark: S, sf: str) -> DataFrame:
    """Listeners known by their validation listens alone: folded in, then the best tracks they have not played."""
    plays = split_ev(spark, sf).where("split = 'val'")
    return serving.recommend_new(plays, tt_vectors(spark, sf), 64, 10)


def content_rows(blocks: np.ndarray) -> np.ndarray:
    """Audio, lyrics and genres side by side: the blocks scaled to length 1 each, then the rows."""
    return recommend.unit_rows(np.concatenate([recommend.unit_rows(x) for x in np.split(blocks, [32, 48], axis=1)], axis=1))


@query(text("blk seen", "").rstrip() + """, u1 AS (SELECT track_id, list_concat(list_concat(list_transform(audio, lambda x: x / sqrt(list_dot_product(audio, audio))), CASE WHEN list_dot_product(lyrics, lyrics) > 0 THEN list_transform(lyrics, lambda x: x / sqrt(list_dot_product(lyrics, lyrics))) ELSE lyrics END), list_transform(genres, lambda x: x / sqrt(list_dot_product(genres, genres)))) AS v FROM blk),
    u2 AS (SELECT track_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u1), us AS (SELECT user_id, k, sum(v[k]) AS x FROM seen JOIN u2 USING (track_id), range(1, 65) t(k) GROUP BY 1, 2), uu AS (SELECT user_id, list(x ORDER BY k) AS v0, sqrt(sum(x * x)) AS n FROM us GROUP BY 1)
    SELECT * FROM (SELECT user_id, track_id, list_dot_product(v0, v) / n AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(list_dot_product(v0, v) / n, 9) DESC, track_id) AS "rank" FROM uu, u2 WHERE (user_id, track_id) NOT IN (SELECT (user_id, track_id) FROM seen)) WHERE "rank" <= 10""", doubles="score")
def vec_content_sim(spark: S, sf: str) -> DataFrame:
    blocks = views.vectors(spark, sf).select("track_id", F.concat("audio", "lyrics", "genres").alias("vec"))
    return recommend.folded_unseen(train(spark, sf), blocks, 10, made=content_rows)


@query(text("part_", "SELECT DISTINCT genre FROM part_"))
def serve_genres(spark: S, sf: str) -> DataFrame:
    return serving.genres(views.tracks(spark, sf))


@query(text("tr emb", "SELECT 'ok' AS status, (SELECT count(DISTINCT user_id) FROM tr) AS users, (SELECT count(*) FROM emb) AS tracks, 64::BIGINT AS dim"))
def serve_health(spark: S, sf: str) -> DataFrame:
    return serving.health(train(spark, sf), tt_vectors(spark, sf))


@query(text("tr part_", """SELECT genre, count(*) AS listens, count(*) / sum(count(*)) OVER () AS share, count(DISTINCT track_id) AS tracks, count(DISTINCT artist) AS artists FROM tr JOIN part_ USING (track_id) GROUP BY 1"""), doubles="share")
def meta_genre_shares(spark: S, sf: str) -> DataFrame:
    return serving.genre_shares(train(spark, sf), views.tracks(spark, sf))


# --- the rest of the inventory ------------------------------------------------------------------------------------------


@query(text("li", """SELECT * FROM (SELECT 'raw' AS stage, count(*) AS listens, count(DISTINCT user_id) AS users, count(DISTINCT track_id) AS tracks FROM li UNION ALL
    SELECT 'eligible', count(*), count(DISTINCT user_id), count(DISTINCT track_id) FROM (SELECT * FROM li, (SELECT max("timestamp") AS m FROM li) WHERE "timestamp" > m - INTERVAL 13 MONTH QUALIFY count(*) OVER (PARTITION BY user_id) >= 10) UNION ALL
    SELECT 'sample', count(*), count(DISTINCT user_id), count(DISTINCT track_id) FROM (SELECT * FROM (SELECT * FROM li, (SELECT max("timestamp") AS m FROM li) WHERE "timestamp" > m - INTERVAL 13 MONTH QUALIFY count(*) OVER (PARTITION BY user_id) >= 10)
        QUALIFY dense_rank() OVER (ORDER BY md5(user_id::VARCHAR || '42')) <= 20))"""))
def prepare_meta(spark: S, sf: str) -> DataFrame:
    _, meta = prepare.prepared(views.listens_li(spark, sf), 13, 10, 20, "42")
    return spark.createDataFrame([(k, v["listens"], v["users"], v["tracks"]) for k, v in meta.items()], "stage string, listens long, users long, tracks long")


@query(text("li", """SELECT 'embeddings' AS file, false AS missing, sum(h) / count(*) AS tracks, sum(h * n) / sum(n) AS listens FROM (SELECT count(*) AS n, (track_id IN (SELECT lpad(vec_id::VARCHAR, 8, '0') FROM embeddings))::INT AS h FROM li GROUP BY track_id)
    UNION ALL SELECT 'lyrics', true, NULL, NULL"""), doubles="tracks listens")
def audit_files(spark: S, sf: str) -> DataFrame:
    return prepare.audit_files(views.listens_li(spark, sf), {"embeddings": views.vectors(spark, sf, 8), "lyrics": None})


@query(text("part_", "SELECT track_id, dense_rank() OVER (ORDER BY artist) - 1 AS code FROM part_"))
def track_codes(spark: S, sf: str) -> DataFrame:
    """Artists as numbers from 0 in order of their names."""
    return serving.coded(views.tracks(spark, sf), "artist").select("track_id", "code")


@query("""SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'fr' WHEN 'GERMANY' THEN 'de' ELSE 'other' END AS lang FROM nation""", longs="n_nationkey")
def meta_replaced(spark: S, sf: str) -> DataFrame:
    return views.table(spark, sf, "nation").select("n_nationkey", serving.replaced(F.col("n_name"), {"FRANCE": "fr", "GERMANY": "de"}, "other").alias("lang"))


@query(text("tr", """SELECT user_id, strftime(max("timestamp"), '%-d %b %Y') AS day FROM tr GROUP BY 1"""))
def serve_last_day(spark: S, sf: str) -> DataFrame:
    return train(spark, sf).groupBy("user_id").agg(F.date_format(F.max("timestamp"), "d MMM yyyy").alias("day"))


_STAMPS = ("2020-03-01T10:00:00+02:00", "2020-03-01T10:00:00Z", "2020-12-31T23:30:00-01:30", "2020-03-01 10:00:00")


@query("SELECT t AS given, (CASE WHEN regexp_matches(t, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN t::TIMESTAMPTZ AT TIME ZONE 'UTC' ELSE t::TIMESTAMP END)::VARCHAR AS at FROM (VALUES " + ", ".join(f"('{t}')" for t in _STAMPS) + ") v(t)")
def utc_times(spark: S, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in _STAMPS], "given string")
    return rows.select("given", serving.utc(F.col("given")).cast("string").alias("at"))


@query(text("usr", """SELECT user_id, k, sqrt(-2 * ln((('0x' || substr(md5('7:' || user_id || ':' || (2 * k)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) * cos(2 * pi() * ((('0x' || substr(md5('7:' || user_id || ':' || (2 * k + 1)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) AS x
    FROM usr, range(8) t(k)"""), doubles="x")
def vec_random(spark: S, sf: str) -> DataFrame:
    v = recommend.random_vectors(train(spark, sf), "user_id", 8, "7")
    return v.select("user_id", F.posexplode("vec").alias("k", "x")).withColumn("k", F.col("k").cast("long"))


@query("SELECT 1.0::DOUBLE AS agreement", doubles="agreement")
def vec_agreement(spark: S, sf: str) -> DataFrame:
    """The blocked search against plain sorting, for the users whose id 10 divides."""
    users, seen = tt_users(spark, sf).where("user_id % 10 = 0"), prepare.pairs(train(spark, sf))
    return recommend.agreement(recommend.top_unseen(users, tt_vectors(spark, sf), seen, 20, block=8192), users, tt_vectors(spark, sf), seen, 20)


_HELD = """held AS (SELECT track_id FROM cat ORDER BY md5(track_id || '42') LIMIT 20), cs AS (SELECT user_id, k, sum(u[k]) AS x FROM seen JOIN uemb USING (track_id), range(1, 65) t(k) WHERE track_id NOT IN (SELECT track_id FROM held) GROUP BY 1, 2),
    cv AS (SELECT user_id, list(x ORDER BY k) AS v0, sqrt(sum(x * x)) AS n FROM cs GROUP BY 1),
    cold AS (SELECT * FROM (SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY round(list_dot_product(v0, tt) / n, 9) DESC, track_id) AS "rank" FROM cv, emb JOIN held USING (track_id) WHERE (user_id, track_id) NOT IN (SELECT (user_id, track_id) FROM seen)) WHERE "rank" <= 10),
    hrel AS (SELECT * FROM rel JOIN held USING (track_id)), hn AS (SELECT user_id, count(*) AS n_rel FROM hrel GROUP BY 1), hh AS (SELECT c.user_id, c.track_id, c."rank", (r.track_id IS NOT NULL)::INT AS hit FROM cold c JOIN hn USING (user_id) LEFT JOIN hrel r USING (user_id, track_id))"""


@query(text("cat seen uemb emb rel ideal", "").rstrip() + ", " + _HELD + """ SELECT 10 AS k, avg(h / n_rel) AS recall, avg(d / ideal) AS ndcg, max(c) AS coverage, avg((n < 10)::INT) AS short, count(*) AS users FROM (SELECT n_rel, ideal, coalesce(sum(hit), 0) AS h, coalesce(sum(hit / log2("rank" + 1)), 0) AS d, count("rank") AS n,
    (SELECT count(DISTINCT track_id) / 20 FROM hh) AS c FROM hn JOIN ideal ON m = least(10, n_rel) LEFT JOIN hh USING (user_id) GROUP BY user_id, n_rel, ideal)""", doubles="recall ndcg coverage short", longs="k")
def cold_scores(spark: S, sf: str) -> DataFrame:
    """Tracks that no model saw: only they are recommended, relevant, and the catalogue."""
    from recengine.operators import holdout

    t = train(spark, sf)
    held = holdout.held_out(t, "track_id", 0.2, "42")
    users = serving.fold_in_users(holdout.without(t, held, "track_id"), tt_vectors(spark, sf), 64)
    rel, seen, _ = truth(spark, sf)
    recs = recommend.top_unseen(users, tt_vectors(spark, sf), seen, 10, only=held).select(*PAIR, "score")
    recs, some, catalog = evaluate.only_tracks(held, recs, rel)
    return evaluate.metrics(recs, some, seen, catalog, [10])


@query(text("tops lst grp", "").rstrip() + ", " + _PENALTY + """, sweep AS (SELECT s AS strength, avg(pct) AS metric FROM (SELECT s, track_id, row_number() OVER (PARTITION BY s, user_id ORDER BY round(a - s * b, 9) DESC, track_id) AS r
    FROM z, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) t(s)) JOIN grp USING (track_id) WHERE r <= 10 GROUP BY 1) SELECT max(strength) AS strength FROM sweep WHERE round(metric, 9) >= (SELECT round(metric, 9) FROM sweep WHERE strength = 0) * 0.8""", doubles="strength")
def bias_chosen(spark: S, sf: str) -> DataFrame:
    """The strongest penalty that keeps the mean percentile within a fifth."""
    return bias.chosen_strength(bias_lambda_sweep(spark, sf).select("strength", F.round("pct", 9).alias("metric")), 0.2)


_MEASURES = """th AS (SELECT t.user_id, t.track_id, t."rank", (r.track_id IS NOT NULL)::INT::DOUBLE AS hit FROM tops t JOIN nrel USING (user_id) LEFT JOIN rel r USING (user_id, track_id) WHERE t."rank" <= 10),
    slots AS (SELECT track_id, count("rank") AS v FROM cat LEFT JOIN th USING (track_id) GROUP BY 1), found AS (SELECT coalesce("group", 'no group') AS g, count(*) AS relevant, count(*) / sum(count(*)) OVER () AS share, avg(coalesce(hit, 0)) AS found FROM rel LEFT JOIN grp USING (track_id) LEFT JOIN th USING (user_id, track_id) GROUP BY 1)
    SELECT 'ndcg' AS measure, '' AS "group", avg(x) AS value FROM (SELECT coalesce(sum(hit / log2("rank" + 1)), 0) / max(ideal) AS x FROM nrel JOIN ideal ON m = least(10, n_rel) LEFT JOIN th USING (user_id) GROUP BY user_id)
    UNION ALL SELECT 'percentile', '', avg(pct) FROM th JOIN grp USING (track_id) UNION ALL SELECT 'coverage', '', avg((v > 0)::INT) FROM slots
    UNION ALL SELECT 'gini', '', sum((2 * i - n - 1) * v) / (max(n) * sum(v)) FROM (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM slots)
    UNION ALL SELECT 'places by popularity', coalesce("group", 'no group'), count(*) / sum(count(*)) OVER () FROM th LEFT JOIN grp USING (track_id) GROUP BY 2
    UNION ALL SELECT 'relevant by popularity', g, relevant FROM found UNION ALL SELECT 'share by popularity', g, share FROM found UNION ALL SELECT 'found by popularity', g, found FROM found"""


@query(text("tops nrel rel cat grp ideal", "").rstrip() + ", " + _MEASURES, doubles="value")
def bias_measures(spark: S, sf: str) -> DataFrame:
    """All measures of the vectors' lists but the intervals of user groups (``bias_group_means`` has those)."""
    s = slices(spark, sf)
    rel, seen, catalog = truth(spark, sf, s=s)
    g = groups(spark, sf, s)
    got = evaluate.breakdown(tt_lists(spark, sf, s=s).select(*PAIR, "score"), rel, seen, [10], 10, {"popularity": g})
    return bias.measures(got, {"popularity": g}, g, {}, catalog, 10)


@query(text("seen blk user_ grp", "").rstrip() + ", " + _TASTE + """, st AS (SELECT user_id, genre FROM (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, genre) AS place FROM taste WHERE weight > 0) WHERE place <= 3),
    bd AS (SELECT user_id, CASE WHEN m <= quantile_cont(m, 1/3) OVER () THEN 0 WHEN m <= quantile_cont(m, 2/3) OVER () THEN 1 ELSE 2 END AS band FROM (SELECT user_id, round(avg(pct), 9) AS m FROM seen JOIN grp USING (track_id) GROUP BY 1)),
    ln_ AS (SELECT user_id, sqrt(sum(weight * weight)) AS l FROM taste GROUP BY 1), cn AS (SELECT user_id, sqrt(count(*)) AS l FROM st GROUP BY 1),
    sim AS (SELECT st.user_id, t.user_id AS other, row_number() OVER (PARTITION BY st.user_id ORDER BY round(sum(weight / ln_.l / cn.l), 9) DESC, t.user_id) AS place FROM st JOIN bd x ON x.user_id = st.user_id JOIN taste t USING (genre) JOIN bd y ON y.user_id = t.user_id AND x.band = y.band JOIN ln_ ON ln_.user_id = t.user_id JOIN cn ON cn.user_id = st.user_id GROUP BY 1, 2)
    SELECT user_id, k, x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS x FROM (SELECT sim.user_id, k, sum(vec[k]) AS x FROM sim JOIN user_ u ON u.user_id = other, range(1, 65) t(k) WHERE place <= 3 GROUP BY 1, 2)""", doubles="x")
def q_look_alikes_band(spark: S, sf: str) -> DataFrame:
    """As ``q_look_alikes``, among known listeners of the same third of the mainstream."""
    profile = questionnaire.taste(prepare.pairs(train(spark, sf)), track_genres(spark, sf), groups(spark, sf))[0]
    bands = q_thirds(spark, sf).select("user_id", "band")
    answers = questionnaire.strongest(profile, 3).select("user_id", "genre", F.lit(1.0).alias("weight")).join(bands, "user_id")
    known = profile.join(bands, "user_id").withColumnRenamed("user_id", "other").join(tt_users(spark, sf).withColumnRenamed("user_id", "other"), "other")
    alike = questionnaire.look_alikes(answers, known, 64, 3, list(range(1, 17)), band=True)
    return alike.select("user_id", F.posexplode("vec").alias("k", "x")).withColumn("k", F.col("k").cast("long") + 1)

"""Queries of the snapshot, re-ranking, hold-outs and fitted models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.catalog import query
from recengine.operators import evaluate, features, holdout, prepare, questionnaire, recommend, service, serving, trees, twotower
from recengine.operators.prepare import PAIR
from recengine.operators.tables import kept, scratch
from recengine.plans import core
from recengine.plans.sqltext import text
from recengine.sources import views

S = SparkSession
DIMS = {"tt": 64, "audio": 32, "lyrics": 16, "genres": 16}


def snapshot(spark: S, sf: str, labelled: bool = False) -> DataFrame:
    """Candidates are the 20 best unseen tracks by the folded-in vectors; the second model is the same on the first 16 dimensions."""
    s = kept(core.split_ev(spark, sf).where("split <> 'test'"))  # read and parsed once for lists, vectors, statistics and labels
    t = core.train(spark, sf, s)
    v = views.vectors(spark, sf)
    als = serving.fold_in_users(t, v.select("track_id", F.col("als").alias("vec")), 16)
    labels = s.where("split = 'val'") if labelled else None
    catalog = views.tracks(spark, sf)
    return features.snapshot(core.tt_lists(spark, sf, s=s), t, catalog, v, als, DIMS, labels=labels)


@query(text("fl", "SELECT * FROM fl"))
def first_last(spark: S, sf: str) -> DataFrame:
    p = features.first_last(core.train(spark, sf))
    return p.select(*PAIR, F.col("first").alias("f"), F.col("last").alias("l"), "plays")


_TRACK = """SELECT track_id, ln(1 + n) AS track_listeners, ln(1 + r) AS track_listeners_recent, ln(1 + s) AS track_listeners_short, r / n AS track_recent_share,
    CASE WHEN r > 0 THEN fr / r END AS track_discovery_rate, cume_dist() OVER (ORDER BY n) AS track_pct, n AS listeners FROM tstat"""


@query(text("tstat", _TRACK), doubles="track_listeners track_listeners_recent track_listeners_short track_recent_share track_discovery_rate track_pct")
def feat_track(spark: S, sf: str) -> DataFrame:
    t = core.train(spark, sf)
    return features.track_stats(features.first_last(t), features.population(t), 28, 7)


_USER = """SELECT user_id, ln(1 + count(*)) AS user_tracks, ln(1 + max(p)) AS user_plays_recent, CASE WHEN count(*) FILTER (l > now - 5 * 86400000000) > 0 THEN count(*) FILTER (f > now - 5 * 86400000000) / count(*) FILTER (l > now - 5 * 86400000000) END AS user_new_share,
    avg(track_pct) AS user_mainstream, (max(now) - max(l)) / 86400000000 AS user_days_since_last FROM fl JOIN (SELECT track_id, cume_dist() OVER (ORDER BY n) AS track_pct FROM tstat) USING (track_id), now_,
    (SELECT user_id AS u, count(*) FILTER (epoch_us("timestamp") > now - 5 * 86400000000) AS p FROM tr, now_ GROUP BY 1) WHERE u = user_id GROUP BY user_id"""


@query(text("tstat fl now_ tr", _USER), doubles="user_tracks user_plays_recent user_new_share user_mainstream user_days_since_last")
def feat_user(spark: S, sf: str) -> DataFrame:
    t = core.train(spark, sf)
    p, now = features.first_last(t), features.population(t)
    return features.user_stats(p, t, now, features.track_stats(p, now, 28, 7), 5)


@query(text("fl now_ part_", """SELECT user_id, artist, ln(1 + count(*)) AS artist_tracks, sum(plays) / max(a) AS artist_play_share, (max(now) - max(l)) / 86400000000 AS artist_days_since, count(*) / max(c) AS artist_catalog_share
    FROM fl JOIN part_ USING (track_id) JOIN (SELECT user_id, sum(plays) AS a FROM fl GROUP BY 1) USING (user_id) JOIN (SELECT artist, count(*) AS c FROM part_ GROUP BY 1) USING (artist), now_ GROUP BY 1, 2"""), doubles="artist_tracks artist_play_share artist_days_since artist_catalog_share")
def feat_artist(spark: S, sf: str) -> DataFrame:
    t = core.train(spark, sf)
    return features.artist_stats(features.first_last(t), views.tracks(spark, sf), features.population(t))[0]


_SNAP = """ub AS (SELECT track_id, tt, als, list_transform(tt, lambda x: x / sqrt(list_dot_product(tt, tt))) AS u, audio, lyrics, genres, sqrt(list_dot_product(audio, audio)) AS na, sqrt(list_dot_product(lyrics, lyrics)) AS nl, sqrt(list_dot_product(genres, genres)) AS ng,
        sqrt(list_dot_product(als, als)) AS ns FROM blk),
    pl AS (SELECT user_id, k, sum(CASE WHEN l > now - 28 * 86400000000 THEN u[k] ELSE 0 END) AS t, sum(CASE WHEN na > 0 AND k <= 32 THEN audio[k] / na ELSE 0 END) AS a, sum(CASE WHEN nl > 0 AND k <= 16 THEN lyrics[k] / nl ELSE 0 END) AS y,
        sum(CASE WHEN ng > 0 AND k <= 16 THEN genres[k] / ng ELSE 0 END) AS g, sum(CASE WHEN ns > 0 AND k <= 16 THEN als[k] / ns ELSE 0 END) AS s FROM fl JOIN ub USING (track_id), range(1, 65) t(k), now_ GROUP BY 1, 2),
    me AS (SELECT user_id, list(t ORDER BY k) AS t, list(a ORDER BY k)[1:32] AS a, list(y ORDER BY k)[1:16] AS y, list(g ORDER BY k)[1:16] AS g, list(s ORDER BY k)[1:16] AS s FROM pl GROUP BY 1),
    c0 AS (SELECT p.user_id, p.track_id, p."rank" AS tt_rank, p.score, list_dot_product(me.s, als) / sqrt(list_dot_product(me.s, me.s)) AS als_score, list_dot_product(me.t, u) / sqrt(list_dot_product(me.t, me.t)) AS recent_affinity,
        CASE WHEN na > 0 THEN list_dot_product(me.a, audio) / na / sqrt(list_dot_product(me.a, me.a)) END AS sim_audio, CASE WHEN nl > 0 THEN list_dot_product(me.y, lyrics) / nl / sqrt(list_dot_product(me.y, me.y)) END AS sim_lyrics,
        CASE WHEN ng > 0 THEN list_dot_product(me.g, genres) / ng / sqrt(list_dot_product(me.g, me.g)) END AS sim_genres, artist, album FROM tops p JOIN ub USING (track_id) JOIN part_ USING (track_id) JOIN me USING (user_id)),
    ts AS (""" + _TRACK + """), us AS (""" + _USER.replace("now - 5 *", "now - 28 *") + """),
    ar AS (SELECT user_id, artist, ln(1 + count(*)) AS artist_tracks, sum(plays) / max(a) AS artist_play_share, (max(now) - max(l)) / 86400000000 AS artist_days_since, count(*) / max(c) AS artist_catalog_share
        FROM fl JOIN part_ USING (track_id) JOIN (SELECT user_id, sum(plays) AS a FROM fl GROUP BY 1) USING (user_id) JOIN (SELECT artist, count(*) AS c FROM part_ GROUP BY 1) USING (artist), now_ GROUP BY 1, 2),
    al AS (SELECT user_id, album, ln(1 + count(*)) AS album_tracks FROM fl JOIN part_ USING (track_id) GROUP BY 1, 2),
    fn AS (SELECT artist, ln(1 + count(DISTINCT user_id)) AS artist_listeners FROM fl JOIN part_ USING (track_id) GROUP BY 1),
    snap AS (SELECT user_id, track_id, tt_rank, coalesce((score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0), 0) AS tt_z, row_number() OVER (PARTITION BY user_id ORDER BY round(als_score, 9) DESC, tt_rank) AS als_rank,
        coalesce((als_score - avg(als_score) OVER w) / nullif(stddev_pop(als_score) OVER w, 0), 0) AS als_z, track_listeners, track_listeners_recent, track_listeners_short, track_recent_share, track_discovery_rate,
        user_tracks, user_plays_recent, user_new_share, user_mainstream, user_days_since_last, recent_affinity, sim_audio, sim_lyrics, sim_genres, track_pct - user_mainstream AS pop_gap,
        coalesce(artist_tracks, 0) AS artist_tracks, coalesce(artist_play_share, 0) AS artist_play_share, artist_days_since, coalesce(artist_catalog_share, 0) AS artist_catalog_share, coalesce(album_tracks, 0) AS album_tracks, coalesce(artist_listeners, 0) AS artist_listeners
        FROM c0 LEFT JOIN ts USING (track_id) LEFT JOIN us USING (user_id) LEFT JOIN ar USING (user_id, artist) LEFT JOIN al USING (user_id, album) LEFT JOIN fn USING (artist) WINDOW w AS (PARTITION BY user_id))"""
_SNAP_TEXT = text("blk tops part_ tstat fl now_ tr", "").rstrip() + ", " + _SNAP
_DOUBLES = " ".join(f for f in features.FEATURES if f not in ("tt_rank", "als_rank"))


@query(_SNAP_TEXT + " SELECT * FROM snap", doubles=_DOUBLES)
def snapshot_infer(spark: S, sf: str) -> DataFrame:
    return snapshot(spark, sf)


_LABELLED = _SNAP_TEXT.rstrip() + """, lab AS (SELECT snap.*, (v.track_id IS NOT NULL)::INT AS label FROM snap LEFT JOIN (SELECT DISTINCT user_id, track_id FROM sp WHERE split = 'val') v USING (user_id, track_id))"""


@query(_LABELLED + " SELECT count(*) AS rows, count(DISTINCT user_id) AS users, sum(label) AS positives, avg(label) AS rate, count(DISTINCT user_id) FILTER (label = 1) AS users_with FROM lab", doubles="rate", longs="positives")
def snapshot_train_summary(spark: S, sf: str) -> DataFrame:
    return features.summary(snapshot(spark, sf, labelled=True))


@query(_SNAP_TEXT + " SELECT feature, avg(x) AS infer FROM (UNPIVOT (SELECT COLUMNS(* EXCLUDE (user_id, track_id))::DOUBLE FROM snap) ON COLUMNS(*) INTO NAME feature VALUE x) GROUP BY 1", doubles="infer")
def feature_drift(spark: S, sf: str) -> DataFrame:
    return features.drift({"infer": snapshot(spark, sf)})


_LINEAR = "(0.5 * tt_z + 0.3 * als_z + 0.2 * coalesce(pop_gap, 0) + 0.1 * artist_tracks)"
_POOL = """pl_ AS (SELECT *, tt_rank <= 5 OR (below AND sum(below::INT) OVER (PARTITION BY user_id ORDER BY tt_rank ROWS UNBOUNDED PRECEDING) <= 3) AS in_pool FROM (SELECT *, tt_rank > 5 AND artist_tracks > 0.7 AS below FROM snap))"""


def linear() -> object:
    return 0.5 * F.col("tt_z") + 0.3 * F.col("als_z") + 0.2 * F.coalesce("pop_gap", F.lit(0.0)) + 0.1 * F.col("artist_tracks")


def known_pool(rows: DataFrame) -> DataFrame:
    strict = rows.withColumn("_at", F.col("artist_tracks")).withColumn("artist_tracks", F.when(F.col("_at") > 0.7, F.col("_at")).otherwise(0.0))
    return strict.withColumn("in_pool", recommend.pool(strict, 5, 3)).withColumn("artist_tracks", F.col("_at")).drop("_at")


@query(_SNAP_TEXT.rstrip() + ", " + _POOL + " SELECT user_id, track_id, tt_rank FROM pl_ WHERE in_pool")
def pool_known_artist(spark: S, sf: str) -> DataFrame:
    return known_pool(snapshot(spark, sf)).where("in_pool").select(*PAIR, "tt_rank")


@query(_LABELLED + " SELECT user_id, track_id FROM lab WHERE tt_rank <= 10 QUALIFY max(label) OVER (PARTITION BY user_id) = 1")
def training_rows(spark: S, sf: str) -> DataFrame:
    return recommend.training_rows(snapshot(spark, sf, labelled=True), F.col("tt_rank") <= 10).select(*PAIR)


@query(_SNAP_TEXT.rstrip() + f""", m AS (SELECT *, round({_LINEAR}, 9) AS m FROM snap) SELECT user_id, track_id, -row_number() OVER (PARTITION BY user_id ORDER BY (tt_rank > 10)::INT, CASE WHEN tt_rank <= 10 THEN -m END, tt_rank)::DOUBLE AS score FROM m""", doubles="score")
def rerank_top_n(spark: S, sf: str) -> DataFrame:
    return recommend.rerank(snapshot(spark, sf).withColumn("model", F.round(linear(), 9)), "model", F.col("tt_rank") <= 10)


@query(_SNAP_TEXT.rstrip() + ", " + _POOL + f""" SELECT user_id, track_id, -row_number() OVER (PARTITION BY user_id ORDER BY (NOT in_pool)::INT, CASE WHEN in_pool THEN -round({_LINEAR}, 9) END, tt_rank)::DOUBLE AS score FROM pl_""", doubles="score")
def rerank_pool(spark: S, sf: str) -> DataFrame:
    rows = known_pool(snapshot(spark, sf)).withColumn("model", F.round(linear(), 9))
    return recommend.rerank(rows, "model", F.col("in_pool"))


@query(text("seen cat", """SELECT user_id, count(*) AS pairs FROM seen WHERE track_id NOT IN (SELECT track_id FROM cat ORDER BY md5(track_id || '42') LIMIT 20) GROUP BY 1"""))
def cold_holdout(spark: S, sf: str) -> DataFrame:
    t = core.train(spark, sf)
    return prepare.pairs(holdout.without(t, holdout.held_out(t, "track_id", 0.2, "42"), "track_id")).groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"))


@query(text("tr usr", """SELECT count(*) AS listens, count(DISTINCT user_id) AS users FROM tr WHERE user_id NOT IN (SELECT user_id FROM usr ORDER BY md5(user_id::VARCHAR || '7') LIMIT (SELECT round_even(0.1 * count(*), 0)::BIGINT FROM usr))"""))
def newcomer_holdout(spark: S, sf: str) -> DataFrame:
    t = core.train(spark, sf)
    kept = holdout.without(t, holdout.held_out(t, "user_id", 0.1, "7"), "user_id")
    return kept.agg(F.count(F.lit(1)).alias("listens"), F.countDistinct("user_id").alias("users"))


@query()
def als_exact(spark: S, sf: str) -> DataFrame:
    """Ten best unseen tracks by exact implicit ALS."""
    t = core.train(spark, sf)
    users, tracks = recommend.als(t, 8, 0.1, 10.0, 3)
    return recommend.top_unseen(users, tracks, prepare.pairs(t), 10)


@query()
def als_fold_in(spark: S, sf: str) -> DataFrame:
    """Users' factors from their own cells alone, the tracks' factors being the embeddings' first 8 places."""
    tracks = core.tt_vectors(spark, sf).select("track_id", F.slice("vec", 1, 8).alias("vec"))
    cells = prepare.plays(core.train(spark, sf)).select(*PAIR, (10 * F.col("log_plays")).alias("c")).join(tracks, "track_id")
    return recommend.fold_in(cells, "user_id", recommend.gram(tracks, 8), 0.1).select("user_id", F.posexplode("vec").alias("k", "x"))


@query(text("tr emb", """SELECT user_id, k, CASE k WHEN 0 THEN (q * e - r * d) / (p * q - r * r) ELSE (p * d - r * e) / (p * q - r * r) END AS x FROM (
    SELECT user_id, max(g00) + 0.1 + sum((c - 1) * y0 * y0) AS p, max(g11) + 0.1 + sum((c - 1) * y1 * y1) AS q, max(g01) + sum((c - 1) * y0 * y1) AS r, sum(c * y0) AS e, sum(c * y1) AS d
    FROM (SELECT user_id, track_id, 10 * ln(1 + count(*)) AS c FROM tr GROUP BY 1, 2) JOIN (SELECT track_id, tt[1] AS y0, tt[2] AS y1 FROM emb) USING (track_id),
        (SELECT sum(tt[1] * tt[1]) AS g00, sum(tt[1] * tt[2]) AS g01, sum(tt[2] * tt[2]) AS g11 FROM emb) GROUP BY user_id), range(2) t(k)"""), doubles="x")
def als_fold_in_two(spark: S, sf: str) -> DataFrame:
    """As ``als_fold_in``, with two factors, whose equations SQL can solve."""
    tracks = core.tt_vectors(spark, sf).select("track_id", F.slice("vec", 1, 2).alias("vec"))
    cells = prepare.plays(core.train(spark, sf)).select(*PAIR, (10 * F.col("log_plays")).alias("c")).join(tracks, "track_id")
    return recommend.fold_in(cells, "user_id", recommend.gram(tracks, 2), 0.1).select("user_id", F.posexplode("vec").alias("k", "x")).withColumn("k", F.col("k").cast("long"))


def _candidates(spark: S, sf: str, s: DataFrame, splits: list[str], labels: str, n: int, trained: int | None = None) -> DataFrame:
    """The snapshot as of the end of ``splits``, over n candidates a user, labelled by what they first play in the slice that follows. ``s``: listens with their slice, a written table."""
    t, v = s.where(F.col("split").isin(splits)), views.vectors(spark, sf)
    lists = recommend.folded_unseen(t, core.tt_vectors(spark, sf), n)
    return kept(features.snapshot(lists, t, views.tracks(spark, sf), v, None, DIMS, labels=s.where(F.col("split") == labels), trained=trained))


#: What the registered rankers use; the README says how that compares.
CANDIDATES, TREES, EVERY, DEPTH = 50, 6, 2, 3


def _ranked(spark: S, sf: str, objective: str) -> tuple[DataFrame, list[trees.Tree], list[str]]:
    """Trees on all 25 features, trained as of the first slice on what the second brought, their number chosen by NDCG on the third."""
    s = kept(core.split_ev(spark, sf))  # read and parsed once for both snapshots, their labels and what is relevant
    with scratch(spark):  # of the training snapshot, its tables and blocks only the trees stay
        train = _candidates(spark, sf, s, ["retrieval_train"], "ranker_train", CANDIDATES, trained=CANDIDATES)
        fitted = trees.fit(train, features.FEATURES, objective=objective, trees=TREES, depth=DEPTH, subsample=0.8, colsample=0.8, mean=True)
    rows = _candidates(spark, sf, s, ["retrieval_train", "ranker_train"], "val", CANDIDATES)
    best, _ = trees.staged_ndcg(fitted, features.FEATURES, rows, EVERY, 10, F.col("tt_rank") <= CANDIDATES, core.truth(spark, sf, s=s)[0])
    return rows, fitted[:best], features.FEATURES


@query()
def ranker_lambda(spark: S, sf: str) -> DataFrame:
    rows, fitted, names = _ranked(spark, sf, "ndcg")
    return recommend.rerank(rows.withColumn("model", trees.predicted(fitted, names)), "model", F.col("tt_rank") <= CANDIDATES)


@query()
def ranker_logistic(spark: S, sf: str) -> DataFrame:
    rows, fitted, names = _ranked(spark, sf, "logistic")
    return recommend.rerank(rows.withColumn("model", trees.predicted(fitted, names)), "model", F.col("tt_rank") <= CANDIDATES)


@query()
def tree_shap(spark: S, sf: str) -> DataFrame:
    """Mean absolute contribution of each feature over 2000 candidate rows, the first by a digest."""
    rows, fitted, names = _ranked(spark, sf, "logistic")
    return trees.importance(trees.contributions(trees.sampled(rows, 2000, "42"), fitted, names))


@query()
def serve_reasons(spark: S, sf: str) -> DataFrame:
    rows, fitted, names = _ranked(spark, sf, "logistic")
    return serving.reasons(trees.contributions(rows.where("tt_rank <= 3"), fitted, names), 2, 28, 7).select(*PAIR, F.concat_ws("; ", "reasons").alias("reasons"))


@query()
def twotower_fit(spark: S, sf: str) -> DataFrame:
    """Ten best unseen tracks by two fitted towers, the track's one of embeddings and content."""
    t = core.train(spark, sf)
    p = prepare.training_pairs(t, "log_plays")
    users = [r[0] for r in t.select("user_id").distinct().orderBy("user_id").collect()]
    v = views.vectors(spark, sf).join(t.select("track_id").distinct(), "track_id", "left_semi").select("track_id", F.concat("audio", "lyrics", "genres").alias("x")).orderBy("track_id").collect()
    model, _ = twotower.fit(p, users, [r["track_id"] for r in v], epochs=2, content=np.array([r["x"] for r in v], float), hidden=32, weighted=True)
    frame = lambda ids, vecs, name, kind: spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, np.round(vecs, 9), strict=True)], f"{name} {kind}, vec array<double>")
    return recommend.top_unseen(frame(users, model.user_vectors(), "user_id", "long"), frame([r["track_id"] for r in v], model.track_vectors(), "track_id", "string"), prepare.pairs(t), 10)


# --- the service --------------------------------------------------------------------------------------------------------


def served(spark: S, sf: str) -> service.Service:
    """The two-stage service over the training listens; a linear score stands for the ranker, so that SQL can follow."""
    t, v = kept(core.train(spark, sf)), views.vectors(spark, sf)
    tt, als = (kept(serving.fold_in_users(t, v.select("track_id", F.col(x).alias("vec")), dim)) for x, dim in (("tt", 64), ("als", 16)))  # a request reads them several times
    return service.Service(t, views.tracks(spark, sf), v, DIMS | {"als": 16}, tt, als, model=F.round(linear(), 9), candidates=20, reordered=10)


@query(_SNAP_TEXT.rstrip() + f""", m AS (SELECT *, round({_LINEAR}, 9) AS m FROM snap) SELECT user_id, track_id, "rank", tt_rank AS retrieval_rank, title, artist FROM
    (SELECT user_id, track_id, tt_rank, row_number() OVER (PARTITION BY user_id ORDER BY (tt_rank > 10)::INT, CASE WHEN tt_rank <= 10 THEN -m END, tt_rank) AS "rank" FROM m) JOIN part_ USING (track_id) WHERE "rank" <= 5""")
def serve_two_stage(spark: S, sf: str) -> DataFrame:
    s = served(spark, sf)
    return service.for_users(s, s.tt_users, 5).drop("reasons")


#: Forms: (listener, artists, genres, the mainstream question's answer).
FORMS = [(-1, ["Brand#11", " brand#12 ", "Nobody"], ["3"], None), (-2, [], ["3", " 5", "zydeco"], None), (-3, ["no such artist"], ["16"], "mainstream")]


@query(text("lst part_ emb uemb seen blk user_ grp", "").rstrip() + ", " + core._TASTE + """, bd AS (SELECT user_id, CASE WHEN m <= quantile_cont(m, 1/3) OVER () THEN 0 WHEN m <= quantile_cont(m, 2/3) OVER () THEN 1 ELSE 2 END AS band FROM (SELECT user_id, round(avg(pct), 9) AS m FROM seen JOIN grp USING (track_id) GROUP BY 1)),
    sd AS (SELECT DISTINCT -1 AS user_id, track_id FROM (SELECT artist, track_id, row_number() OVER (PARTITION BY artist ORDER BY listeners DESC, track_id) AS place FROM part_ JOIN lst USING (track_id)) WHERE artist IN ('Brand#11', 'Brand#12') AND place <= 2),
    an AS (SELECT * FROM (VALUES (-2, 3, NULL), (-2, 5, NULL), (-3, 16, 2)) t(user_id, genre, want)), ln_ AS (SELECT user_id, sqrt(sum(weight * weight)) AS l FROM taste GROUP BY 1), cn AS (SELECT user_id, sqrt(count(*)) AS l FROM an GROUP BY 1),
    sim AS (SELECT an.user_id, t.user_id AS other, row_number() OVER (PARTITION BY an.user_id ORDER BY round(sum(weight / ln_.l / cn.l), 9) DESC, t.user_id) AS place FROM an JOIN taste t USING (genre) JOIN bd y ON y.user_id = t.user_id JOIN ln_ ON ln_.user_id = t.user_id JOIN cn ON cn.user_id = an.user_id
        WHERE want IS NULL OR want = band GROUP BY 1, 2),
    raw AS (SELECT sim.user_id, k, sum(vec[k]) AS x FROM sim JOIN user_ u ON u.user_id = other, range(1, 65) t(k) WHERE place <= 5 GROUP BY 1, 2 UNION ALL SELECT user_id, k, sum(u[k]) AS x FROM sd JOIN uemb USING (track_id), range(1, 65) t(k) GROUP BY 1, 2),
    vc AS (SELECT user_id, list(x ORDER BY k) AS v0, sqrt(sum(x * x)) AS n FROM raw GROUP BY 1)
    SELECT user_id, track_id, "rank", "rank" AS retrieval_rank, title, artist, CASE user_id WHEN -1 THEN 'artists' ELSE 'genres' END AS used FROM (SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY round(list_dot_product(v0, tt) / n, 9) DESC, track_id) AS "rank"
        FROM vc, emb WHERE (user_id, track_id) NOT IN (SELECT (user_id, track_id) FROM sd)) LEFT JOIN part_ USING (track_id) WHERE "rank" <= 5""", longs="user_id")
def serve_onboarding(spark: S, sf: str) -> DataFrame:
    s = served(spark, sf)
    forms = spark.createDataFrame(FORMS, "user_id long, artists array<string>, genres array<string>, mainstream string")
    profiles = questionnaire.taste(prepare.pairs(s.listens), core.track_genres(spark, sf), core.groups(spark, sf))[0]
    by_artist = questionnaire.most_listened(s.tracks.select(F.col("artist").alias("group"), "track_id"), core.listeners(spark, sf))
    names = spark.range(1, 17).select(F.col("id").alias("genre"), F.col("id").cast("string").alias("name"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    places, _ = service.for_answers(s, forms, now, 5, profiles=profiles, bands=core.q_thirds(spark, sf).select("user_id", "band"), by_artist=by_artist, track_genres=list(range(1, 17)), names=names, neighbours=5, per_artist=2, stages="retrieval")
    return places.drop("reasons")


# --- pools --------------------------------------------------------------------------------------------------------------

POOLS = [(5, 0), (5, 3), (10, 0)]


@query(_SNAP_TEXT.rstrip() + ", " + " UNION ALL ".join(f"SELECT '{top}+{known}' AS pool, median(n) AS size FROM (SELECT user_id, count(*) FILTER (tt_rank <= {top} OR (below AND place <= {known})) AS n FROM (SELECT *, sum(below::INT) OVER (PARTITION BY user_id ORDER BY tt_rank ROWS UNBOUNDED PRECEDING) AS place FROM (SELECT *, tt_rank > {top} AND artist_tracks > 0 AS below FROM snap)) GROUP BY 1)" for top, known in POOLS).replace("SELECT", "sizes AS (SELECT", 1) + ") SELECT * FROM sizes", doubles="size")
def pool_sizes(spark: S, sf: str) -> DataFrame:
    """How many candidates a user's pool has, in the middle, for each choice of pool."""
    rows = kept(snapshot(spark, sf).select("user_id", "tt_rank", "artist_tracks"))
    out = None
    for top, known in POOLS:
        one = rows.withColumn("_in", recommend.pool(rows, top, known).cast("int")).groupBy("user_id").agg(F.sum("_in").alias("n")).agg(F.percentile("n", F.lit(0.5)).alias("size")).select(F.lit(f"{top}+{known}").alias("pool"), "size")
        out = one if out is None else out.unionByName(one)
    return out

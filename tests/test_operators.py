"""Hand-checked tables for the operators."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from recengine.functions import vectors
from recengine.operators import bias, evaluate, features, holdout, prepare, questionnaire, recommend, reporting, service, serving, tables, trees, twotower

T0 = datetime(2020, 3, 1)


def listens(spark, rows):
    """(user, track[, days before T0])"""
    full = [(u, t, T0 - timedelta(days=(r[0] if r else 0))) for u, t, *r in rows]
    return spark.createDataFrame(full, "user_id long, track_id string, timestamp timestamp_ntz")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "user_id long, track_id string")


def recs(spark, rows):
    return spark.createDataFrame(rows, "user_id long, track_id string, score double")


def test_relevant_is_new_and_distinct(spark):
    history, later = pairs(spark, [(5, "p"), (6, "q"), (6, "r")]), pairs(spark, [(5, "p"), (5, "s"), (6, "t"), (6, "t"), (7, "q")])
    assert sorted(tuple(r) for r in evaluate.relevant(history, later).collect()) == [(5, "s"), (6, "t"), (7, "q")]


#: Listener 10 has three tracks to find and a list of four; listener 11 has one, which is not in a list of two.
WANTED = [(10, "m"), (10, "n"), (10, "o"), (11, "w")]
SHOWN = [(10, "m", 5.0), (10, "z", 4.0), (10, "o", 3.0), (10, "n", 2.0), (11, "v", 2.0), (11, "u", 1.0)]
THREE = 1 + 1 / math.log2(3) + 0.5  # the best that three places can hold


def test_metrics(spark):
    catalog = spark.createDataFrame([(c,) for c in "mnouvwyz"], "track_id string")
    none = pairs(spark, [])
    at = {r.k: r for r in evaluate.metrics(recs(spark, SHOWN), pairs(spark, WANTED), none, catalog, [1, 3]).collect()}
    assert [round(x, 6) for x in (at[1].recall, at[1].ndcg, at[1].coverage, at[1].short)] == [round(1 / 6, 6), 0.5, 0.25, 0.0]
    assert [round(x, 6) for x in (at[3].recall, at[3].ndcg, at[3].coverage, at[3].short)] == [round(1 / 3, 6), round(1.5 / THREE / 2, 6), 0.625, 0.5] and at[3].users == 2
    # what was heard goes before the cut; a repeated pair counts once, with its best score; who has no list scores 0
    heard = evaluate.metrics(recs(spark, SHOWN), pairs(spark, WANTED), pairs(spark, [(10, "z")]), catalog, [3]).first()
    assert (heard.recall, heard.ndcg) == (0.5, 0.5)
    twice = evaluate.metrics(recs(spark, [*SHOWN, (10, "n", 9.0)]), pairs(spark, [*WANTED, (12, "m")]), none, catalog, [3]).first()
    assert (round(twice.recall, 6), round(twice.ndcg, 6), twice.users) == (round(2 / 9, 6), round((1 + 1 / math.log2(3)) / THREE / 3, 6), 3)


def test_group_recall_and_breakdown(spark):
    groups = spark.createDataFrame([("m", "old"), ("n", "old"), ("w", "new"), ("z", "new")], "track_id string, group string")
    hits = evaluate.ranked_hits(recs(spark, SHOWN), pairs(spark, WANTED), pairs(spark, []), 3)
    want = {"old": (2, 0.5, 0.5), "new": (1, 0.25, 0.0), "no group": (1, 0.25, 1.0)}
    assert {r.group: (r.relevant, r.share, r.found) for r in evaluate.group_recall(hits, pairs(spark, WANTED), groups, 3).collect()} == want
    got = evaluate.breakdown(recs(spark, SHOWN), pairs(spark, WANTED), pairs(spark, []), [1], 3, {"age": groups})
    assert {r.group: (r.relevant, r.share, r.found) for r in got["found age"].collect()} == want
    assert sorted((r.user_id, r["rank"], r.track_id) for r in got["lists"].collect()) == [(10, 1, "m"), (10, 2, "z"), (10, 3, "o"), (11, 1, "v"), (11, 2, "u")] and "hit" not in got["lists"].columns
    assert {r.user_id: r.recall_1 for r in got["users"].collect()} == {10: 1 / 3, 11: 0.0}


def test_only_some_tracks_count(spark):
    some, rel, catalog = evaluate.only_tracks(spark.createDataFrame([("m",), ("v",), ("m",)], "track_id string"), recs(spark, SHOWN), pairs(spark, WANTED))
    r = evaluate.metrics(some, rel, pairs(spark, []), catalog, [2]).first()
    assert (r.recall, r.coverage, r.short, r.users) == (1.0, 0.5, 1.0, 1)


def test_bootstrap_of_a_constant_and_of_opposites():
    assert evaluate.paired_bootstrap(np.full(30, -0.25)) == (-0.25, -0.25, -0.25)
    mean, low, high = evaluate.paired_bootstrap(np.array([3.0, -3.0] * 200))
    assert mean == 0 and abs(high - 1.96 * 3 / 20) < 0.05 and abs(low + high) < 0.05


def test_resampled_means(spark):
    x = np.random.default_rng(1).normal(0.1, 1, 300)
    users = spark.createDataFrame([(k, float(v), 2 * float(v), "ab"[k % 2]) for k, v in enumerate(x)], "user_id long, d double, e double, group string")
    got = {r.metric: r for r in evaluate.resampled(users, ["d", "e"], []).collect()}
    mean, low, high = evaluate.paired_bootstrap(x)
    assert abs(got["d"].mean - mean) < 1e-9 and abs(got["d"].low - low) < 0.015 and abs(got["d"].high - high) < 0.015
    assert abs(got["e"].low - 2 * got["d"].low) < 1e-9  # values of a user stay together
    per = {r.group: r for r in evaluate.group_means(users.drop("group"), users.select("user_id", "group"), "d").collect()}
    for g, part in (("a", x[::2]), ("b", x[1::2])):
        mean, low, high = evaluate.paired_bootstrap(part)
        assert per[g].users == 150 and abs(per[g].mean - mean) < 1e-9 and abs(per[g].low - low) < 0.03 and abs(per[g].high - high) < 0.03
    flat = evaluate.poisson_bootstrap(spark.createDataFrame([(k, 0.75) for k in range(9)], "user_id long, d double"), "d", resamples=50).first()
    assert (flat.low, flat.mean, flat.high) == (0.75, 0.75, 0.75)


def test_difference_is_of_users_that_both_have(spark):
    a = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.25, 0.0), (3, 9.0, 9.0)], "user_id long, recall_5 double, ndcg_5 double")
    b = spark.createDataFrame([(1, 0.25, 0.5), (2, 0.5, 0.5), (4, 7.0, 7.0)], "user_id long, recall_5 double, ndcg_5 double")
    got = {r.metric: (r.users, r.mean) for r in evaluate.difference(a, b, ["recall_5", "ndcg_5"], 40).collect()}
    assert got == {"recall_5": (2, 0.0), "ndcg_5": (2, 0.0)}


def test_same_top_and_known_share(spark):
    a = recs(spark, [(4, "k", 5.0), (4, "l", 4.0), (5, "k", 1.0), (6, "l", 2.0), (6, "k", 1.0)])
    b = recs(spark, [(4, "k", 0.2), (4, "l", 0.1), (5, "l", 1.0)])
    assert round(evaluate.same_top(a, b, 2).first()[0], 6) == round(1 / 3, 6)
    assert evaluate.known_share(a, pairs(spark, [(4, "l"), (6, "l")]), 2).first()[0] == 0.4


def test_split_boundaries_go_to_the_earlier_slice(spark):
    at = [13, 12, 12 - 1 / 86400, 6, 6 - 1 / 86400, 3, 3 - 1 / 86400, 0]
    out = prepare.with_split(listens(spark, [(1, str(k), d) for k, d in enumerate(at)]), 3, 3, 6)
    got = [r.split for r in out.orderBy(F.col("track_id")).collect()]
    assert got == ["retrieval_train"] * 2 + ["ranker_train"] * 2 + ["val"] * 2 + ["test"] * 2
    with pytest.raises(ValueError):
        prepare.only_train(out, ["val"])


def test_months_before_clamps_the_day(spark):
    row = spark.range(1).select(prepare.months_before(F.lit("2020-03-31 10:00:00").cast("timestamp_ntz"), 1).cast("string"), prepare.months_before(F.lit("2020-03-20 00:00:00").cast("timestamp_ntz"), 13).cast("string")).first()
    assert list(row) == ["2020-02-29 10:00:00", "2019-02-20 00:00:00"]


def test_audit(spark):
    seven = listens(spark, [(8, "x"), (8, "x"), (8, "x"), (8, "y"), (9, "x"), (9, "z"), (9, "z")])
    r = prepare.audit_size(seven).first()
    assert (r.listens, r.users, r.tracks, r.pairs, round(r.repeat_share, 6), round(r.density, 6)) == (7, 2, 3, 4, round(3 / 7, 6), round(4 / 6, 6))
    top = prepare.audit_top_share(seven, 0.5, 3).first()  # half of three tracks, rounded to even, are two: four and two listens
    assert (round(top.top_share, 6), round(top.under_few, 6)) == (round(6 / 7, 6), round(2 / 3, 6))
    v = spark.createDataFrame([(1,), (1,), (4,)], "v long")  # 2 (1 + 2 + 12) / (3 * 6) - 4 / 3
    assert round(prepare.gini(v, "v").first()[0], 9) == round(1 / 3, 9)
    assert prepare.gini(v.withColumn("v", F.lit(0)), "v").first()[0] == 0 == prepare.gini(v.limit(0), "v").first()[0]


def test_a_missing_file_is_a_row_of_the_audit(spark):
    p = listens(spark, [(1, "x"), (2, "x"), (2, "y"), (2, "z")])
    got = {r.file: (r.missing, r.tracks, r.listens) for r in prepare.audit_files(p, {"b": p.where("track_id = 'x'").select("track_id"), "a": None}).collect()}
    assert got == {"a": (True, None, None), "b": (False, 1 / 3, 0.5)}


def test_prepared_sample_and_nobody_eligible(spark):
    p = listens(spark, [(u, f"t{k}", k) for u in range(6) for k in range(u + 1)])
    sample, meta = prepare.prepared(p, 1, 3, 2, "s")
    users = {r.user_id for r in sample.collect()}
    assert len(users) == 2 <= min(users) and meta["eligible"]["users"] == 4 and meta["raw"] == {"listens": 21, "users": 6, "tracks": 6}
    assert meta["sample"]["listens"] == sum(u + 1 for u in users)
    with pytest.raises(ValueError, match="no user"):
        prepare.prepared(p, 1, 99, 2, "s")


def test_popularity(spark):
    # q: three listeners long ago; r: one listener six times this week; s: two listeners, one of them ten days ago
    p = listens(spark, [(21, "q", 90), (22, "q", 80), (23, "q", 70), *[(21, "r", d) for d in range(1, 7)], (22, "s", 10), (23, "s", 2)])
    scores = lambda **k: {r.track_id: r.score for r in recommend.popularity(p, **k).collect()}
    assert scores() == {"q": 3, "r": 1, "s": 2}
    assert scores(count="listens") == {"q": 3, "r": 6, "s": 2}
    assert scores(window_days=7) == {"r": 1, "s": 1}
    out = recommend.popular_unseen(recommend.popularity(p), prepare.pairs(p), 2)
    assert sorted(tuple(r) for r in out.collect()) == [(21, "s", 2.0), (22, "r", 1.0), (23, "r", 1.0)]
    fresh = recommend.popular_unseen(recommend.popularity(p), prepare.pairs(p).where("user_id = 21"), 2, users=spark.createDataFrame([(21,), (99,)], "user_id long"))
    assert sorted(tuple(r) for r in fresh.collect()) == [(21, "s", 2.0), (99, "q", 3.0), (99, "s", 2.0)]


def test_popular_unseen_as_by_sorting(spark):
    import random

    rng = random.Random(4)
    p = prepare.pairs(listens(spark, [(u, f"t{rng.randrange(30):02}") for u in range(12) for _ in range(rng.randrange(1, 25))]))
    scores = recommend.popularity(p)
    rank = [r.track_id for r in scores.orderBy(F.col("score").desc(), "track_id").collect()]
    seen = {}
    for r in p.collect():
        seen.setdefault(r.user_id, set()).add(r.track_id)
    want = sorted((u, t) for u, had in seen.items() for t in [t for t in rank if t not in had][:4])
    assert sorted((r.user_id, r.track_id) for r in recommend.popular_unseen(scores, p, 4).collect()) == want


def test_total_order_over_several_tasks(spark):
    rows = spark.range(500).selectExpr("id", "id * 7 % 13 AS x").repartition(5)
    got = sorted((r.x, r.id, r.place) for r in tables.placed(rows, "x", "id").collect())
    assert [r[2] for r in got] == list(range(1, 501))


def test_item_neighbours_count_themselves(spark, monkeypatch):
    p = listens(spark, [(31, "d"), (31, "e"), (31, "f"), (32, "d"), (32, "e"), (33, "d"), (34, "f")])
    want = {("d", "d"): 1.0, ("d", "e"): round(2 / 6**0.5, 6), ("e", "e"): 1.0, ("e", "d"): round(2 / 6**0.5, 6), ("f", "f"): 1.0, ("f", "e"): 0.5}
    for chunk in (1024, 1):  # however a listener's tracks are dealt
        monkeypatch.setattr(recommend, "CHUNK", chunk)
        assert {(r.item, r.neighbour): round(r.similarity, 6) for r in recommend.item_neighbours(p, 2).collect()} == want


def test_top_unseen_in_blocks_and_subsets(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "user_id long, vec array<double>")
    tracks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0])], "track_id string, vec array<double>")
    seen = pairs(spark, [(1, "a"), (2, "x")])
    for block in (1 << 20, 16):
        out = recommend.top_unseen(users, tracks, seen, 2, block=block).collect()
        assert sorted((r.user_id, r["rank"], r.track_id) for r in out) == [(1, 1, "b"), (1, 2, "c"), (2, 1, "c"), (2, 2, "b")]
    only = recommend.top_unseen(users, tracks, seen, 2, only=tracks.where("track_id = 'a'")).collect()
    assert [(r.user_id, r.track_id) for r in only] == [(2, "a")]


def test_fold_in_als(spark):
    cells = spark.createDataFrame([(1, "a", 3.0, [2.0]), (1, "b", 2.0, [1.0]), (2, "c", 5.0, [0.0])], "user_id long, track_id string, c double, vec array<double>")
    out = {r.user_id: r.vec[0] for r in recommend.fold_in(cells, "user_id", np.array([[5.0]]), 0.5).collect()}
    assert math.isclose(out[1], (3 * 2 + 2 * 1) / (5 + 0.5 + 2 * 4 + 1 * 1)) and out[2] == 0


def test_als_fits_better_than_chance(spark):
    p = listens(spark, [(u, f"{'x' if u % 2 else 'y'}{t}") for u in range(20) for t in range(8) if (u + t) % 4])
    users, tracks = recommend.als(p, 4, 0.1, 10.0, 4)
    best = recommend.top_unseen(users, tracks, prepare.pairs(p), 1).collect()
    assert sum(r.track_id[0] == ("x" if r.user_id % 2 else "y") for r in best) >= 18


def test_vectors(spark):
    v = spark.createDataFrame([("a", [2.0, -1.0, 2.0]), ("z", [0.0, 0.0, 0.0])], "track_id string, vec array<double>")
    assert [[round(x, 9) for x in r[0]] for r in v.select(vectors.unit("vec")).collect()] == [[round(2 / 3, 9), round(-1 / 3, 9), round(2 / 3, 9)], [0.0, 0.0, 0.0]]
    z = vectors.column_zscore(spark.createDataFrame([("a", [2.0, 7.0]), ("b", [2.0, 7.0]), ("c", [8.0, 7.0])], "track_id string, vec array<double>"), "vec", 2)
    assert sorted([round(x, 6) for x in r.vec] for r in z.collect()) == [[round(-(0.5**0.5), 6), 0.0]] * 2 + [[round(2**0.5, 6), 0.0]]


def test_recency_and_recent(spark):
    p = listens(spark, [(1, "a", 1), (1, "b", 2), (1, "c", 1), (1, "a", 9), (1, "d", 5)])
    w = {r.track_id: (r.place, r.weight) for r in serving.recency_weights(p, 1).collect()}
    assert w == {"a": (1, 1.0), "c": (1, 1.0), "b": (2, 0.5), "d": (3, 0.25)}
    assert sorted(r.track_id for r in serving.recent_stretch(p, 3).collect()) == ["a", "b", "c"]
    assert serving.recent_stretch(p, 9).count() == 5


def test_new_listens(spark):
    now = F.lit("2020-03-01 00:00:00").cast("timestamp_ntz")
    plays = spark.createDataFrame([(-1, "a", None), (-1, "q", None)], "user_id long, track_id string, timestamp timestamp_ntz")
    catalog = spark.createDataFrame([("a",)], "track_id string")
    known, unknown = serving.new_listens(plays, now, catalog)
    assert known.first().timestamp == T0 and unknown.first().track_id == "q"
    with pytest.raises(Exception, match="future"):
        serving.new_listens(listens(spark, [(-1, "a", -1)]), now, catalog)[0].collect()
    with pytest.raises(ValueError):
        serving.checked(0)


def test_reasons(spark):
    rows = [("tt_rank", 3.0, 0.5), ("artist_tracks", math.log1p(2), 0.4), ("user_tracks", 1.0, 0.3), ("user_plays_recent", 1.0, 0.2), ("sim_lyrics", None, 0.1), ("pop_gap", -0.1, -1.0), ("artist_days_since", 1.2, 0.05)]
    c = spark.createDataFrame([(1, "a", *r) for r in rows], "user_id long, track_id string, feature string, value double, contribution double")
    said = serving.reasons(c, 9, 28, 7).first().reasons
    assert said == ["the retrieval model's number 3 candidate for them", "has played 2 other tracks by this artist", "how this listener listens in general", "it has no lyrics on file", "last played this artist 1 day ago"]


def test_genre_group(spark):
    from recengine.plans.core import GENRE_RULES

    g = spark.createDataFrame([("Melodic Metalcore, pop",), ("  Psychedelic Folk ",), ("throat singing",), ("Dub Techno",)], "g string").select(serving.genre_group(F.col("g"), GENRE_RULES))
    assert [r[0] for r in g.collect()] == ["metal", "folk and country", "other", "electronic"]


def test_popularity_groups(spark):
    # 20 listeners in all: shares begin at 0, 9, 13, 17 and 19 of 20
    l = spark.createDataFrame([("g", 9), ("h", 4), ("i", 4), ("j", 2), ("k", 1)], "track_id string, listeners long")
    got = {r.track_id: (r.group, r.pct) for r in bias.popularity_groups(l, ["top", "low"]).collect()}
    assert got == {"g": ("top", 1.0), "h": ("top", 0.8), "i": ("low", 0.8), "j": ("low", 0.4), "k": ("low", 0.2)}


def test_listener_groups_are_equal_and_ties_go_by_user(spark):
    m = spark.createDataFrame([(u, x) for u, x in ((1, 0.5), (2, 0.1), (3, 0.5), (4, 0.9), (5, 0.5))], "user_id long, mainstream double")
    assert {r.user_id: r.group for r in bias.listener_groups(m, ["low", "high"]).collect()} == {2: "low", 1: "low", 3: "low", 5: "high", 4: "high"}


def test_measures_and_the_chosen_penalty(spark):
    catalog = spark.createDataFrame([(c,) for c in "mnouvwyz"], "track_id string")
    groups = spark.createDataFrame([(c, "old" if c < "o" else "new", 0.5) for c in "mnouvwyz"], "track_id string, group string, pct double")
    got = evaluate.breakdown(recs(spark, SHOWN), pairs(spark, WANTED), pairs(spark, []), [3], 3, {"age": groups.drop("pct")})
    users = spark.createDataFrame([(10, "a"), (11, "b")], "user_id long, group string")
    out = {(r.measure, r.group): r.value for r in bias.measures(got, {"age": groups.drop("pct")}, groups, {"kind": users}, catalog, 3, resamples=20).collect()}
    assert round(out["ndcg", ""], 6) == round(1.5 / THREE / 2, 6) and out["percentile", ""] == 0.5 and out["coverage", ""] == 0.625
    assert out["places by age", "old"] == 0.2 and out["found by age", "old"] == 0.5 and out["users by kind", "a"] == 1 and out["low by kind", "b"] == 0
    sweep = spark.createDataFrame([(0.0, 1.0), (0.2, 0.98), (0.4, 0.96), (0.8, 0.5), (1.6, 0.97)], "strength double, metric double")
    assert bias.chosen_strength(sweep, 0.05).first()[0] == 1.6 and bias.chosen_strength(sweep.where("strength < 1"), 0.03).first()[0] == 0.2

def test_exposure_and_concentration(spark):
    r = recs(spark, [(u, t, s) for u in (1, 2, 3) for t, s in (("p", 3.0), ("q" if u < 3 else "r", 2.0), ("s", 1.0))])
    groups = spark.createDataFrame([("p", "big"), ("q", "small")], "track_id string, group string")
    assert {x.group: round(x.share, 6) for x in bias.exposure(r, groups, 2).collect()} == {"big": 0.5, "small": round(1 / 3, 6), "no group": round(1 / 6, 6)}
    c = bias.concentration(r, spark.createDataFrame([(x,) for x in "pqrst"], "track_id string"), 2).first()  # places 0, 0, 1, 2, 3
    assert (c.coverage, round(c.gini, 6)) == (0.6, round((2 * (3 * 1 + 4 * 2 + 5 * 3) - 6 * 6) / (5 * 6), 6))


def test_penalised(spark):
    r = recs(spark, [(7, "i", 8.0), (7, "j", 6.0), (8, "j", 4.0), (8, "k", 4.0), (9, "i", 1.0)])
    l = spark.createDataFrame([("i", 50), ("j", 5), ("k", 2)], "track_id string, listeners long")
    half = 0.5**0.5  # what either of two values is from their mean, in sample deviations
    for strength in (0.0, 0.5, 3.0):
        got = {(x.user_id, x.track_id): round(x.score, 9) for x in bias.penalised(r, l, strength).collect()}
        want = {(7, "i"): half - strength * half, (7, "j"): strength * half - half, (8, "j"): -strength * half, (8, "k"): strength * half, (9, "i"): 0.0}
        assert got == {k: round(v, 9) for k, v in want.items()}


def test_pool_training_rows_rerank(spark):
    rows = spark.createDataFrame([(u, f"t{k}", k, float(k % 2), int(u == 1 and k == 2), float(-k)) for u in (1, 2) for k in range(1, 7)], "user_id long, track_id string, tt_rank int, artist_tracks double, label int, model double")
    pool = recommend.pool(rows, 2, 1)
    assert [r.tt_rank for r in rows.where("user_id = 1").select("tt_rank", pool.alias("p")).where("p").orderBy("tt_rank").collect()] == [1, 2, 3]
    assert {r.user_id for r in recommend.training_rows(rows, pool).collect()} == {1}
    order = [r.track_id for r in recommend.rerank(rows.where("user_id = 1").withColumn("model", F.col("tt_rank").cast("double")), "model", F.col("tt_rank") <= 3).orderBy(F.col("score").desc()).collect()]
    assert order == ["t3", "t2", "t1", "t4", "t5", "t6"]


def test_snapshot_of_one_user_is_the_same_among_all(spark):
    from recengine.plans import core, models
    from recengine.sources import views

    sf = "/root/testdata/sf0.001"
    whole = models.snapshot(spark, sf).where("user_id = 3").orderBy("track_id").collect()
    t, v = core.train(spark, sf), views.vectors(spark, sf)
    als = serving.fold_in_users(t, v.select("track_id", F.col("als").alias("vec")), 16)
    own = features.snapshot(core.tt_lists(spark, sf).where("user_id = 3"), t.where("user_id = 3"), views.tracks(spark, sf), v, als, models.DIMS, everyone=t).orderBy("track_id").collect()
    assert len(whole) == len(own) > 0
    for a, b in zip(whole, own, strict=True):
        for f in features.FEATURES:
            assert (a[f] is None) == (b[f] is None) and (a[f] is None or abs(a[f] - b[f]) < 1e-9), f


def test_ranker_learns_a_signal_and_shap_adds_up(spark):
    rng = np.random.default_rng(1)
    rows = [(u, f"t{k}", k, float(x := rng.normal()), float(rng.normal()), int(x > 0.8)) for u in range(60) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "user_id long, track_id string, tt_rank int, signal double, noise double, label int")
    for objective in ("ndcg", "logistic"):
        fitted = trees.fit(df, ["signal", "noise"], objective=objective, trees=4, depth=2, eta=0.5)
        scored = df.withColumn("model", trees.predicted(fitted, ["signal", "noise"]))
        means = {r.label: r.m for r in scored.groupBy("label").agg(F.avg("model").alias("m")).collect()}
        assert means[1] > means[0] + 0.2
        c = trees.contributions(df.limit(20), fitted, ["signal", "noise"]).groupBy("user_id", "track_id").agg(F.sum("contribution").alias("c")).join(scored, ["user_id", "track_id"])
        assert c.where(F.abs(F.col("c") - F.col("model")) > 1e-9).count() == 0
        top = trees.importance(trees.contributions(df, fitted, ["signal", "noise"])).orderBy(F.col("importance").desc()).first()
        assert top.feature == "signal"


def test_tower_loss_and_gradient():
    rng = np.random.default_rng(0)
    u, t = twotower.unit(rng.normal(size=(4, 3))), twotower.unit(rng.normal(size=(4, 3)))
    ids, q = np.array([0, 1, 1, 2]), np.log([0.2, 0.3, 0.3, 0.2])
    loss, du, _ = twotower.softmax_loss(u, t, ids, q, 0.5)
    s = u @ t.T / 0.5 - q
    s[1, 2] = s[2, 1] = -np.inf  # the same track elsewhere in the batch is no wrong answer
    assert math.isclose(loss, float(np.mean([np.log(np.exp(s[i]).sum()) - s[i, i] for i in range(4)])))
    h = 1e-6
    moved = u.copy()
    moved[0, 1] += h
    assert math.isclose((twotower.softmax_loss(moved, t, ids, q, 0.5)[0] - loss) / h, du[0, 1], rel_tol=1e-3)


def test_staged_search_tries_nothing_twice_and_keeps_the_first():
    runs = []
    best, tried = twotower.search([{"a": [1, 2]}, {"a": [2], "b": [0, 5]}], {"a": 0, "b": 0}, lambda s: runs.append(s) or min(s["a"], 2) + (s["b"] > 9))
    assert best == {"a": 2, "b": 0} and len(runs) == 3 == len(tried)


def test_questionnaire(spark):
    profile = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (1, 2, 0.0), (2, 2, 1.0)], "user_id long, genre long, weight double")
    assert sorted((r.user_id, r.genre) for r in questionnaire.strongest(profile, 3).collect()) == [(1, 0), (1, 1), (2, 2)]
    v = spark.createDataFrame([(k, float(k)) for k in range(4)], "user_id long, x double")
    assert [r.band for r in questionnaire.thirds(v, v, "x").orderBy("user_id").collect()] == [0, 0, 1, 2]
    names = spark.createDataFrame([(1, " ABBA "), (1, "nobody")], "user_id long, name string")
    known, unknown = questionnaire.matched(names, spark.createDataFrame([("Abba",), ("ABBA",)], "artist string"), "artist")
    assert sorted(r.group for r in known.collect()) == ["ABBA", "Abba"] and [r.name for r in unknown.collect()] == ["nobody"]


def test_hold_outs_are_whole_and_repeatable(spark):
    p = listens(spark, [(u, f"t{u % 7}") for u in range(40)])
    a, b = (sorted(r.user_id for r in holdout.held_out(p, "user_id", 0.1, "s").collect()) for _ in range(2))
    assert a == b and len(a) == 4
    assert holdout.without(p, holdout.held_out(p, "user_id", 0.1, "s"), "user_id").count() == 36


def walked(tree, x, known):
    """What a tree gives on average if the features in ``known`` are known: a walk that follows those and averages by cover over others."""

    def at(node):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        a, b = tree.left[node], tree.right[node]
        if f in known:
            return at(a if (tree.missing_left[node] if math.isnan(x[f]) else x[f] <= tree.threshold[node]) else b)
        return (tree.cover[a] * at(a) + tree.cover[b] * at(b)) / (tree.cover[a] + tree.cover[b])

    return at(0)


def random_tree(rng, depth, features):
    tree = trees.Tree()

    def grow(node, depth, cover):
        if depth == 0 or rng.random() < 0.15:
            return
        tree.feature[node], tree.threshold[node], tree.missing_left[node] = int(rng.integers(features)), float(rng.normal()), bool(rng.integers(2))
        share = rng.uniform(0.1, 0.9)
        tree.left[node] = tree.add(float(rng.normal()), cover * share)
        grow(tree.left[node], depth - 1, cover * share)
        tree.right[node] = tree.add(float(rng.normal()), cover * (1 - share))
        grow(tree.right[node], depth - 1, cover * (1 - share))

    grow(tree.add(0.0, 100.0), depth, 100.0)
    return tree


def test_shapley_values_by_their_definition():
    from itertools import combinations

    rng = np.random.default_rng(8)
    for _ in range(12):
        tree, x = random_tree(rng, 4, 4), rng.normal(size=(5, 4))
        x[rng.random(x.shape) < 0.2] = np.nan
        got = trees.Paths(tree).contributions(x)
        for row, c in zip(x, got, strict=True):
            assert abs(c[-1] - walked(tree, row, set())) < 1e-9 and abs(c.sum() - walked(tree, row, {0, 1, 2, 3})) < 1e-9
            for f in range(4):
                others = [g for g in range(4) if g != f]
                want = sum(math.factorial(n) * math.factorial(3 - n) / 24 * (walked(tree, row, {*s, f}) - walked(tree, row, set(s))) for n in range(4) for s in combinations(others, n))
                assert abs(c[f] - want) < 1e-9


def test_booster_options(spark):
    rng = np.random.default_rng(2)
    rows = [(u, f"t{k}", k, float(x := rng.normal()), float(rng.normal()), int(x > 0.8)) for u in range(40) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "user_id long, track_id string, tt_rank int, signal double, noise double, label int")
    few = trees.fit(df, ["tt_rank", "signal", "noise"], trees=3, depth=1, subsample=0.5, colsample=0.34, seed=3, mean=True, least=1e-4)
    again = trees.fit(df, ["tt_rank", "signal", "noise"], trees=3, depth=1, subsample=0.5, colsample=0.34, seed=3, mean=True, least=1e-4)
    assert [t.feature[0] for t in few] == [t.feature[0] for t in again] and len({t.feature[0] for t in few}) > 1  # one feature a tree, drawn
    fitted = trees.fit(df, ["signal", "noise"], objective="logistic", trees=4, depth=2, eta=0.5)
    best, seen = trees.staged(fitted, ["signal", "noise"], df, 2, lambda scored: scored.agg(F.corr("model", "label")).first()[0])
    assert [n for n, _ in seen] == [2, 4] and best in (2, 4)
    assert trees.staged(fitted, ["signal", "noise"], df, 2, lambda scored: 1.0)[0] == 2  # a tie goes to fewer trees
    found = trees.contributions(trees.sampled(df, 1, "x"), fitted, ["signal", "noise"])
    sizes = [abs(r.contribution) for r in trees.explained(found).collect()]
    assert len(sizes) == 2 and sizes == sorted(sizes, reverse=True)
    assert trees.ablated({"a": ["x", "y"], "b": ["z"]}, lambda names: len(names)) == [("a", 1), ("b", 2)]


def test_mean_pairs_divide_a_user_s_gradient(spark):
    rows = [(1, "a", 1, 1, 0.0), (1, "b", 2, 0, 0.0), (1, "c", 3, 0, 0.0)]
    df = spark.createDataFrame(rows, "user_id long, track_id string, tt_rank int, label int, _score double")
    plain, mean = ({r.track_id: r["_g"] for r in trees.gradients(df, "ndcg", mean=m).collect()} for m in (False, True))
    assert all(math.isclose(plain[t], 2 * mean[t]) for t in "abc") and abs(sum(plain.values())) < 1e-12 and plain["a"] < 0


def test_towers_learn_from_ids_from_content_and_by_weight(spark):
    rng = np.random.default_rng(3)
    rows = [(u, f"t{t:02}", 1.0 + (u + t) % 3, -3.0) for u in range(30) for t in range(20) if t % 2 == u % 2 and rng.random() < 0.7]
    pairs_ = spark.createDataFrame(rows, "user_id long, track_id string, weight double, log_q double")
    users, items = list(range(30)), [f"t{t:02}" for t in range(20)]
    side = np.array([[t % 2, 1 - t % 2, 1.0] for t in range(20)], float)
    for options in ({}, {"content": side, "hidden": 8}, {"content": side, "hidden": 8, "use_id": False}, {"weighted": True}):
        model, losses = twotower.fit(pairs_, users, items, dim=6, epochs=6, batch=64, **options)
        score = model.user_vectors() @ model.track_vectors().T
        own = np.array([[u % 2 == t % 2 for t in range(20)] for u in range(30)])
        assert losses[-1] < losses[0] and score[own].mean() > score[~own].mean() + 0.3, options
    stop, losses = twotower.fit(pairs_, users, items, dim=4, epochs=9, batch=64, patience=1, measure=lambda m, n=iter([0.5, 0.4, 0.9]): next(n))
    assert len(losses) == 2  # the second epoch was no better
    with pytest.raises(ValueError):
        twotower.fit(pairs_, users, items, use_id=False)


def test_content_network_s_gradient():
    rng = np.random.default_rng(4)
    c = twotower.Content.drawn(rng.normal(size=(5, 3)), 4, 2, rng)
    rows, d = np.array([0, 2, 2]), rng.normal(size=(3, 2))
    out, hidden = c.forward(rows)
    for x, g in zip(c.parameters(), c.backward(rows, hidden, d), strict=True):
        at = tuple(0 for _ in x.shape)
        x[at] += 1e-6
        moved = ((c.forward(rows)[0] - out) * d).sum() / 1e-6
        x[at] -= 1e-6
        assert abs(moved - g[at]) < 1e-4


def test_weighted_draws_come_as_often_as_their_weight(spark):
    coded = spark.range(400).selectExpr("cast(id as int) AS u", "0 AS t", "0.0 AS log_q", "IF(id % 2 = 0, 3.0D, 1.0D) AS weight")
    drawn = np.concatenate([b[0] for b in twotower.batches(coded, 64, 1, True)])
    assert 1.3 < (drawn % 2 == 0).sum() / 200 < 1.7 and 0.4 < (drawn % 2 == 1).sum() / 200 < 0.6
    assert len(np.concatenate([b[0] for b in twotower.batches(coded, 64, 1, False)])) == 400


def test_reports():
    assert reporting.stable_json({"b": [1 / 3], "a": 2}) == '{\n  "b": [\n    0.3333333333\n  ],\n  "a": 2\n}\n'
    assert reporting.markdown([{"x": 0.5, "y": "a|b"}, {"x": None}], ["x", "y"]) == "| x | y |\n| --- | --- |\n| 0.5000 | a\\|b |\n|  |  |\n"
    made = reporting.page(f"<script>const d = {reporting.SLOT};</script>", {"t": "</script>\u2028x"})
    assert made.count("</script>") == 1 and "\\u2028" in made
    with pytest.raises(ValueError):
        reporting.page("no slot", {})
    rows = [{"title": "Blue Train", "artist": "Coltrane"}, {"title": "So What", "artist": "Davis"}]
    assert reporting.matching(rows, " blue COL", ["title", "artist"]) == rows[:1] and reporting.matching(rows, "", ["title"]) == rows
    assert reporting.bars([("a<b", 2.0), ("c", -1.0)], "t").count("<rect") == 2


def test_small_results_only(spark):
    assert reporting.records(spark.range(2).selectExpr("id", "struct(id AS x) AS s")) == [{"id": 0, "s": {"x": 0}}, {"id": 1, "s": {"x": 1}}]
    with pytest.raises(ValueError):
        reporting.records(spark.range(5), most=4)


def test_vectors_from_seeds_and_codes(spark):
    ids = spark.range(2000).selectExpr("id AS user_id")
    x = np.array([r.vec for r in recommend.random_vectors(ids, "user_id", 3, "s").collect()])
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05
    same, other = ({r.user_id: r.vec for r in recommend.random_vectors(d, "user_id", 2, s).collect()} for d, s in ((ids.limit(5).repartition(3), "s"), (ids.limit(5), "t")))
    assert all(same[k] == {r.user_id: r.vec for r in recommend.random_vectors(ids, "user_id", 2, "s").where("user_id < 5").collect()}[k] != other[k] for k in same)
    tracks_ = spark.createDataFrame([("a", "Z"), ("b", "M"), ("c", None), ("d", "Z")], "track_id string, artist string")
    assert {r.track_id: r.code for r in serving.coded(tracks_, "artist").collect()} == {"a": 1, "b": 0, "c": None, "d": 1}
    assert [r[0] for r in tracks_.select(serving.replaced(F.col("artist"), {"Z": "zed"}, "?")).collect()] == ["zed", "?", "?", "zed"]



def _split(ids, vectors_, cuts):
    """Vectors in blocks that end at ``cuts``."""
    import pyarrow as pa

    return (recommend.Block(pa.array(ids[a:b]), *recommend._distinct(vectors_[a:b])) for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True))


def test_agreement_makes_no_rows_of_users_by_tracks(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "user_id long, vec array<double>")
    tracks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0])], "track_id string, vec array<double>")
    lists = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "c", 1), (2, "b", 2)], "user_id long, track_id string, rank int")
    found = recommend.agreement(lists, users, tracks, pairs(spark, [(1, "a"), (2, "x")]), 2)
    assert found.first().agreement == 0.75  # the second place of listener 1 is c
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan


def test_nearest_orders_ties_and_copies_as_plain_sorting(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    monkeypatch.setattr(recommend, "TILE", (3, 4))
    for trial in range(60):
        d, m, size, n = (int(rng.integers(1, k)) for k in (5, 12, 80, 9))
        tracks = rng.integers(-1, 2, (size, d)).astype(float) if trial % 2 else rng.normal(size=(size, d))[rng.integers(0, size, size)]
        users = rng.integers(-1, 2, (m, d)).astype(float) if trial % 2 else rng.normal(size=(m, d))
        ids, cuts = [f"{k:03}" for k in range(size)], sorted({int(k) for k in rng.integers(1, size, 2)} if size > 1 else [])
        who, what = np.nonzero(rng.random((m, size)) < 0.3)
        scores = np.round(users @ tracks.T, 12)
        scores[who, what] = -np.inf
        want = [[int(j) for j in np.lexsort((np.arange(size), -np.round(x, 9))) if np.isfinite(x[j])][:n] for x in scores]
        for search in (recommend.nearest, recommend.plainly):
            best, where = search(users, who, pa.array([ids[k] for k in what], pa.string()), _split(ids, tracks, cuts), n)
            assert [w[np.isfinite(b)].tolist() for b, w in zip(best, where, strict=True)] == want


def test_nearest_does_not_sort_what_cannot_count():
    """The search costs a few times the plain products, not the sorting of all scores, which is some forty times."""
    import time

    import pyarrow as pa

    rng = np.random.default_rng(5)
    users, tracks = rng.normal(size=(512, 64)), rng.normal(size=(40_000, 64))
    ids = [f"{k:05}" for k in range(len(tracks))]
    block, none = next(_split(ids, tracks, [])), np.array([], np.int64)

    def took(work):
        at = time.process_time()
        work()
        return time.process_time() - at

    plain = min(took(lambda: users @ tracks.T) for _ in range(3))
    assert min(took(lambda: recommend.nearest(users, none, pa.array([], pa.string()), iter([block]), 20)) for _ in range(3)) < 12 * plain


def _searches(spark, name):
    """How often the plan of a registered query holds the search of all tracks, written tables aside."""
    from recengine import catalog

    return catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_penalty_sweep_searches_once(spark):
    assert _searches(spark, "bias_chosen") == 0  # the lists are a written table, which all strengths read


def test_service_folds_users_in_once(spark):
    from recengine.plans import models

    s = models.served(spark, "/root/testdata/sf0.001")
    for table in (s.tt_users, s.als_users, s.listens):
        assert "Aggregate" not in table._jdf.queryExecution().optimizedPlan().toString() and "get_json_object" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_holds_places_back_and_finds_the_same(monkeypatch):
    """After the first tile places are put in order some thousands at once, and whatever is held back, ties and copies come as from plain sorting."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    merged, calls = recommend._merged, []
    monkeypatch.setattr(recommend, "_merged", lambda *a: (calls.append(1), merged(*a))[1])
    users, tracks = rng.normal(size=(1024, 16)), rng.normal(size=(16_384, 16))
    none = np.array([], np.int64), pa.array([], pa.string())
    got = recommend.nearest(users, *none, _split([f"{k:05}" for k in range(16_384)], tracks, []), 5)
    assert len(calls) < 8  # four tiles of 4096 tracks by four of 256 users are sixteen
    monkeypatch.setattr(recommend, "TILE", (7, 8))
    for narrow, held in ((1, 1), (3, 5), (8, 1000)):
        monkeypatch.setattr(recommend, "NARROW", narrow)
        monkeypatch.setattr(recommend, "HELD", held)
        ids, coarse = [f"{k:03}" for k in range(120)], rng.integers(-1, 2, (120, 3)).astype(float)
        asked = rng.integers(-1, 2, (20, 3)).astype(float)
        who, what = np.nonzero(rng.random((20, 120)) < 0.1)
        had = pa.array([ids[k] for k in what], pa.string())
        a, b = (search(asked, who, had, _split(ids, coarse, [50, 51]), 6) for search in (recommend.nearest, recommend.plainly))
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    some = recommend.plainly(users[:40], *none, _split([f"{k:05}" for k in range(16_384)], tracks, []), 5)
    assert (got[1][:40] == some[1]).all()


def test_search_is_dealt_over_several_tasks_a_core(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "user_id long, vec array<double>")
    tracks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "track_id string, vec array<double>")
    found = recommend.top_unseen(users, tracks, pairs(spark, [(1, "a")]), 1)
    assert found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.user_id, r.track_id) for r in found.collect()) == [(1, "b"), (2, "b")]


def test_folded_users_are_searched_as_by_joins(spark):
    """Users folded in by the search have the lists of users folded in by joins; in blocks, in runs that cut no user, with repeated plays, unknown tracks and zero vectors."""
    rng = np.random.default_rng(17)
    tracks = spark.createDataFrame([(f"{k:02}", [0.0] * 6 if k % 13 == 0 else [float(x) for x in rng.integers(-2, 4, 6)]) for k in range(60)], "track_id string, vec array<double>")
    played = [(int(u), f"{k:02}") for u in range(40) for k in rng.integers(0, 70, int(rng.integers(1, 30)))] + [(90, "65"), (91, "00"), (92, "00"), (92, "03")]
    listens_ = pairs(spark, played)
    want = recommend.top_unseen(serving.fold_in_users(listens_, tracks, 6), tracks, prepare.pairs(listens_), 5)
    found = recommend.folded_unseen(listens_, tracks, 5, block=1200)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "sum(" not in plan  # no vector travels for a pair
    rows = lambda df: sorted((r.user_id, r["rank"], r.track_id, round(r.score, 9)) for r in df.collect())
    assert rows(found) == rows(want) and {r[0] for r in rows(found)} == {*range(40), 91, 92}
    doubled = recommend.folded_unseen(listens_, tracks.select("track_id", F.transform("vec", lambda x: x / 2).alias("vec")), 5, made=lambda v: 2 * v)
    assert rows(doubled) == rows(want)


def test_histories_end_where_a_user_ends(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(recommend, "RUN_BYTES", 200)
    users = np.repeat([3, 4, 7, 8, 9], [2, 50, 1, 1, 4])
    batches = [pa.RecordBatch.from_arrays([pa.array(users[k : k + 3]), pa.array([str(x) for x in range(k, min(k + 3, len(users)))])], names=["user_id", "track_id"]) for k in range(0, len(users), 3)]
    for least in (1, 2, 100):
        runs = list(recommend._histories(iter(batches), least))
        assert [x for r in runs for x in r.column("track_id").to_pylist()] == [str(x) for x in range(len(users))]
        seen = [set(r.column("user_id").to_pylist()) for r in runs]
        assert sum(map(len, seen)) == 5 and len(runs) > 1


def test_an_id_that_is_there_twice_counts_twice():
    import pyarrow as pa

    block = recommend.Block(pa.array(["a", "b", "b", "c"]), *recommend._distinct(np.array([[1.0, 0], [0, 2], [0, 3], [1, 1]])))
    vecs, found = recommend._directions(np.array([0, 0, 1]), pa.array(["a", "b", "x"]), iter([block]), 2)
    assert found.tolist() == [3, 0] and np.allclose(vecs, [[1 / math.sqrt(5), 2 / math.sqrt(5)], [0, 0]])
    _, where = recommend.nearest(vecs[:1], np.array([0]), pa.array(["b"]), iter([block]), 4)
    assert where.tolist() == [[3, 0, -1, -1]]


def _cone(rng, users, tracks, d=64):
    lead = np.r_[3.0, np.zeros(d - 1)]
    return recommend.unit_rows(lead + rng.normal(size=(users, d)) * 0.06), recommend.unit_rows(lead * 0.2 + rng.normal(size=(tracks, d)) * 0.15)


def test_nearest_by_a_lead_is_plain_sorting(monkeypatch):
    """Tracks in order of their part along the users' lead, and users left out by it, change no list; nor do ties, copies and a user without direction."""
    import pyarrow as pa

    rng = np.random.default_rng(23)
    monkeypatch.setattr(recommend, "TILE", (7, 8))
    for trial in range(20):
        monkeypatch.setattr(recommend, "NARROW", (1, 3, 8)[trial % 3])
        users, tracks = _cone(rng, 30, 150, (2, 5, 64)[trial % 3])
        if trial % 2:
            users, tracks = np.round(users * 3), np.round(tracks * 4)
        users[4] = 0
        tracks[60:70] = tracks[:10]
        who, what = np.nonzero(rng.random((30, 150)) < 0.1)
        ids = [f"{k:03}" for k in range(150)]
        had = pa.array([ids[k] for k in what], pa.string())
        a, b = (search(users, who, had, _split(ids, tracks, [70, 71]), 6) for search in (recommend.nearest, recommend.plainly))
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_nearest_leaves_out_what_the_lead_excludes(monkeypatch):
    import pyarrow as pa

    users, tracks = _cone(np.random.default_rng(29), 1024, 40_000)
    formed, places = [], recommend._places
    monkeypatch.setattr(recommend, "_places", lambda hit: (formed.append(hit.size), places(hit))[1])
    recommend.nearest(users, np.array([], np.int64), pa.array([], pa.string()), _split([f"{k:05}" for k in range(len(tracks))], tracks, []), 10)
    assert sum(formed) < 0.6 * len(users) * len(tracks)


def test_a_ranker_writes_its_rows_once_and_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(u, f"t{k}", k, *(float(x) if x > -1.5 else None for x in rng.normal(size=6)), int(rng.random() < 0.2)) for u in range(200) for k in range(1, 21)]
    names = [f"f{k}" for k in range(6)]
    df = spark.createDataFrame(rows, "user_id long, track_id string, tt_rank int, " + ", ".join(f"{f} double" for f in names) + ", label int")
    written, kept_ = [], trees.kept
    monkeypatch.setattr(tables, "folder", lambda _: f"file://{tmp_path}/recengine")
    monkeypatch.setattr(trees, "kept", lambda x: written.append(x) or kept_(x))
    one, two = (trees.fit(df, names, trees=5, depth=2, eta=0.5, least=0.1, subsample=0.7, mean=True, bins=bins) for bins in (32, 300))
    assert len(written) == 2 and not list((tmp_path / "recengine").iterdir())  # the bins of each, and no copy for each tree
    monkeypatch.setattr(trees, "FOLDED", 2)
    folded = trees.fit(df, names, trees=5, depth=2, eta=0.5, least=0.1, subsample=0.7, mean=True)
    assert len(written) == 5 and not list((tmp_path / "recengine").iterdir())
    assert [t.feature for t in folded] == [t.feature for t in one] and np.allclose([x for t in folded for x in t.value], [x for t in one for x in t.value])
    assert max(x.max() for x in map(np.array, (t.feature for t in two))) >= 0
    once = df.where(F.pmod(F.xxhash64(F.lit(0), F.lit(3), "user_id", "track_id"), F.lit(1 << 20)) < int(0.7 * (1 << 20))).count()
    drawn = df.groupBy("user_id").agg(F.collect_list("track_id").alias("track_id")).select(F.explode(trees._drawn(0, 3, 0.7)).alias("d"))
    assert drawn.where("d").count() == once  # the draw is by row and tree
    # gradients of packed rows are those of the window form
    score = rng.normal(size=len(rows)).round(1)
    with_score = spark.createDataFrame([(r[0], r[1], r[2], r[-1], float(s)) for r, s in zip(rows, score, strict=True)], "user_id long, track_id string, tt_rank int, label int, _score double")
    for mean in (False, True):
        want = trees.gradients(with_score, "ndcg", mean=mean).orderBy("user_id", "tt_rank").select("_g", "_h").collect()
        for pairs_ in (1 << 20, 50):
            monkeypatch.setattr(trees, "PAIRS", pairs_)
            g, h = trees._lambdas(np.full(200, 20), score, np.array([r[-1] for r in rows]), np.array([float(r[2]) for r in rows]), mean)
            assert np.allclose(g, [r[0] for r in want], atol=1e-12) and np.allclose(h, [r[1] for r in want], atol=1e-12)


def test_stages_by_ndcg_are_those_of_the_lists(spark):
    rng = np.random.default_rng(6)
    rows = [(u, f"t{k:02}", k, float(x := rng.normal()), float(rng.normal()), int(x + rng.normal() > 1.2)) for u in range(40) for k in range(1, 16)]
    df = spark.createDataFrame(rows, "user_id long, track_id string, tt_rank int, signal double, noise double, label int")
    fitted = trees.fit(df, ["signal", "noise"], trees=4, depth=2, eta=0.5, least=0.1)
    rel = df.where("label = 1").select("user_id", "track_id").union(spark.createDataFrame([(u, "far") for u in range(30, 44)], "user_id long, track_id string"))
    pool = F.col("tt_rank") <= 12
    measure = lambda scored: evaluate.per_user(recommend.rerank(scored, "model", pool), rel, rel.limit(0), [10]).agg(F.avg("ndcg_10")).first()[0]
    (best, seen), (got, found) = trees.staged(fitted, ["signal", "noise"], df, 2, measure), trees.staged_ndcg(fitted, ["signal", "noise"], df, 2, 10, pool, rel)
    assert best == got and [n for n, _ in seen] == [n for n, _ in found] and np.allclose([x for _, x in seen], [x for _, x in found])


def test_a_snapshot_s_rows_travel_once_and_without_vectors(spark):
    rng = np.random.default_rng(7)
    hist = listens(spark, [(u, f"t{t}") for u in range(12) for t in range(9) if (u * 7 + t * 5) % 4 == 0])
    tracks = spark.createDataFrame([(f"t{t}", f"a{t % 3}" if t != 8 else None, f"b{t % 4}") for t in range(9)], "track_id string, artist string, album string")
    v = spark.createDataFrame([(f"t{t}", *(rng.normal(size=k).tolist() for k in (4, 3, 2, 2, 3))) for t in range(9) if t != 7], "track_id string, tt array<double>, als array<double>, audio array<double>, lyrics array<double>, genres array<double>")
    found = spark.createDataFrame([(u, f"t{t}", 1.0 - t / 10, t + 1) for u in range(13) for t in range(9)], "user_id long, track_id string, score double, rank int")
    got = features.snapshot(found, hist, tracks, v, None, {"tt": 4, "audio": 2, "lyrics": 2, "genres": 3})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    rows = {(r.user_id, r.track_id): r for r in got.collect()}
    assert len(rows) == 13 * 8 and all(rows[12, t].user_tracks is None and rows[12, t].als_z == 0.0 and rows[12, t].sim_audio is None and rows[12, t].artist_tracks == 0.0 for t in ("t0", "t8"))
    given = features.snapshot(found, hist, tracks, v, serving.fold_in_users(hist, v.select("track_id", F.col("als").alias("vec")), 3), {"tt": 4, "audio": 2, "lyrics": 2, "genres": 3})
    for r in given.collect():
        for f in features.FEATURES:
            a, b = r[f], rows[r.user_id, r.track_id][f]
            assert a is None and b is None or abs(a - b) < 1e-9, f
    labels = listens(spark, [(u, f"t{t}") for u in (2, 5) for t in (u, 8)])
    some = features.snapshot(found, hist, tracks, v, None, {"tt": 4, "audio": 2, "lyrics": 2, "genres": 3}, labels=labels, trained=5)
    assert sorted((r.user_id, r.track_id, r.label) for r in some.collect()) == sorted((2, f"t{t}", int(t == 2)) for t in range(5))  # t5 is the sixth place


def test_a_written_table_leaves_no_shuffle_behind(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().length()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = files()
    tables.kept(df)
    assert files() <= before


def test_a_ranker_keeps_nothing_of_its_training_snapshot(spark, tmp_path, monkeypatch):
    from recengine.plans import models

    monkeypatch.setattr(models, "_candidates", lambda spark, *_, trained=None, **__: tables.kept(spark.range(8).selectExpr("id AS user_id", "'t' AS track_id", "1 AS tt_rank", "cast(id % 2 AS int) AS label", *(f"1.0D * id AS {f}" for f in features.FEATURES if f != "tt_rank"))))
    monkeypatch.setattr(tables, "folder", lambda _: "/".join([f"file://{tmp_path}", *tables._INNER]))
    rows, fitted, _ = models._ranked(spark, "/root/testdata/sf0.001", "logistic")
    assert len(fitted) in (2, 4, 6) and rows.count() == 8
    assert len(list(tmp_path.iterdir())) == 2  # the listens with their slices, and the rows to be ranked

"""The two-stage service on a small catalogue: who is known, what is refused, and what a form gives."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recengine.operators import questionnaire, service

def now():
    return F.lit("2021-06-10 00:00:00").cast("timestamp_ntz")


@pytest.fixture(scope="module")
def small(spark):
    """Six tracks in two directions; listeners 1 and 2 like the first, 3 and 4 the second."""
    tracks = spark.createDataFrame([(f"t{k}", f"Song {k}", f"Artist {k // 2}", f"Album {k // 2}") for k in range(6)], "track_id string, title string, artist string, album string")
    rows = []
    for k in range(6):
        x = [1.0, 0.1 * k] if k < 3 else [0.1 * k, 1.0]
        rows.append((f"t{k}", x, x, x, x, x))
    vectors = spark.createDataFrame(rows, "track_id string, " + ", ".join(f"{c} array<double>" for c in ("tt", "als", "audio", "lyrics", "genres")))
    plays = [(1, "t0"), (1, "t1"), (2, "t1"), (2, "t2"), (3, "t3"), (3, "t4"), (4, "t4"), (4, "t5")]
    listens = spark.createDataFrame([(u, t, datetime(2021, 6, 1 + u)) for u, t in plays], "user_id long, track_id string, timestamp timestamp_ntz")
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 1.0])], "user_id long, vec array<double>")
    return service.Service(listens, tracks, vectors, {"tt": 2, "als": 2, "audio": 2, "lyrics": 2, "genres": 2}, users, users, model=-F.col("tt_rank").cast("double"), candidates=4, reordered=4)


def test_known_listeners_in_two_stages(spark, small):
    ids = spark.createDataFrame([(1,), (3,)], "user_id long")
    out = service.for_users(small, ids, 2).collect()
    got = {(r.user_id, r["rank"]): (r.track_id, r.retrieval_rank, r.title, r.artist, r.reasons) for r in out}
    assert got[1, 1] == ("t2", 1, "Song 2", "Artist 1", None) and got[3, 1][0] == "t5" and len(got) == 4
    backwards = service.Service(**{**small.__dict__, "model": F.col("tt_rank").cast("double")})
    turned = {(r.user_id, r["rank"]): r.retrieval_rank for r in service.for_users(backwards, ids, 2).collect()}
    assert turned == {(1, 1): 4, (1, 2): 3, (3, 1): 4, (3, 2): 3}
    assert {(r.user_id, r["rank"]): r.track_id for r in service.for_users(backwards, ids, 2, stages="retrieval").collect()} == {k: v[0] for k, v in got.items()}
    with pytest.raises(KeyError, match="77"):
        service.for_users(small, spark.createDataFrame([(1,), (77,)], "user_id long"), 2)
    with pytest.raises(ValueError):
        service.for_users(small, ids, 0)


def test_reasons_come_with_places(spark, small):
    def explained(rows):
        return rows.select("user_id", "track_id", F.lit("tt_rank").alias("feature"), F.col("tt_rank").cast("double").alias("value"), F.lit(1.0).alias("contribution"))

    s = service.Service(**{**small.__dict__, "explained": explained})
    first = service.for_users(s, spark.createDataFrame([(2,)], "user_id long"), 1, explain=True).first()
    assert first.reasons == ["the retrieval model's number 1 candidate for them"]


def test_new_listeners(spark, small):
    plays = spark.createDataFrame([(-1, "zz", None, 2), (-1, "t3", None, 0), (-1, "qq", None, 1), (-1, "zz", None, 3)], "user_id long, track_id string, timestamp timestamp_ntz, place int")
    places, unknown = service.for_new(small, plays, now(), 2)
    assert [r.track_id for r in places.orderBy("rank").collect()] == ["t5", "t4"]
    assert [r.track_id for r in unknown.orderBy("place").collect()] == ["qq", "zz"]
    with pytest.raises(ValueError, match="-2"):
        service.for_new(small, plays.unionByName(plays.limit(1).withColumn("user_id", F.lit(-2).cast("long")).withColumn("track_id", F.lit("nowhere"))), now(), 2)


def test_forms(spark, small):
    listeners = small.listens.groupBy("track_id").agg(F.countDistinct("user_id").alias("listeners"))
    by_artist = questionnaire.most_listened(small.tracks.select(F.col("artist").alias("group"), "track_id"), listeners)
    profiles = spark.createDataFrame([(1, 0, 2.0), (2, 0, 1.0), (2, 1, 0.1), (3, 1, 3.0), (4, 1, 1.0), (4, 0, 0.5)], "user_id long, genre long, weight double")
    bands = spark.createDataFrame([(1, 0), (2, 2), (3, 0), (4, 2)], "user_id long, band int")
    names = spark.createDataFrame([(0, "Folk"), (1, "Straße")], "genre long, name string")
    answer = lambda rows: service.for_answers(small, spark.createDataFrame(rows, "user_id long, artists array<string>, genres array<string>, mainstream string"), now(), 2, profiles=profiles, bands=bands, by_artist=by_artist, track_genres=[0, 1], names=names, neighbours=1, per_artist=1)
    places, unknown = answer([(-1, ["who", " artist 2 ", "who"], ["folk"], None), (-2, [], ["STRASSE ", "polka"], None), (-3, ["nobody"], ["straße"], "mainstream")])
    got = {}
    for r in places.collect():
        got.setdefault((r.user_id, r.used), {})[r["rank"]] = r.track_id
    assert got == {(-1, "artists"): {1: "t5", 2: "t3"}, (-2, "genres"): {1: "t3", 2: "t4"}, (-3, "genres"): {1: "t5", 2: "t4"}}
    assert sorted((r.user_id, r.kind, r.name) for r in unknown.collect()) == [(-3, "artist", "nobody"), (-2, "genre", "polka"), (-1, "artist", "who")]
    with pytest.raises(ValueError, match="-9"):
        answer([(-9, ["who"], [], None), (-1, ["Artist 0"], [], None)])

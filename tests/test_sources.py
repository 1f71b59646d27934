"""Files and streams."""

import bz2

import pytest
from pyspark.sql import functions as F

from recengine.sources import ingest
from recengine.streaming import listens as streams


def put(path, text):
    path.write_bytes(bz2.compress(text.encode()) if path.suffix == ".bz2" else text.encode())
    return str(path)


@pytest.mark.parametrize(("name", "head", "times"), [("a.tsv.bz2", "user_id\ttrack_id\ttimestamp\n", ("2020-01-02 03:04:05", "2020-01-02 03:04")), ("b.tsv", "", ("1577934245", "1577934240")), ("c.tsv", "", ("1577934245000", "1577934240000")), ("d.tsv", "u\tt\tts\n", ("2020-01-02T03:04:05", "2020-01-02T03:04:00"))])
def test_listens_in_all_formats(spark, tmp_path, name, head, times):
    path = put(tmp_path / name, head + f"7\t007\t{times[0]}\n8\t\"q\t{times[1]}\n")
    rows = sorted((r.user_id, r.track_id, str(r.timestamp)) for r in ingest.read_listens(spark, path).collect())
    assert rows == [(7, "007", "2020-01-02 03:04:05"), (8, '"q', "2020-01-02 03:04:00")]
    assert ingest.convert_listens(spark, path, str(tmp_path / "out")) == 2


def test_other_files_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        ingest.sniff(spark, put(tmp_path / "x.tsv", "1\t2\n"))


def test_features_and_metadata(spark, tmp_path):
    path = put(tmp_path / "f.tsv.bz2", "id\tx\ty\n01\t1\t2\n02\t3\t4\n")
    ids = spark.createDataFrame([("02",), ("01",)], "track_id string")
    assert {r.track_id: r.v for r in ingest.read_features(spark, path, ids, "v").collect()} == {"01": [1.0, 2.0], "02": [3.0, 4.0]}
    assert ingest.feature_names(spark, path) == ["x", "y"] and ingest.feature_ids(spark, path).count() == 2
    with pytest.raises(Exception, match="no v for 03"):
        ingest.read_features(spark, path, spark.createDataFrame([("03",)], "track_id string"), "v").collect()
    files = [put(tmp_path / n, t) for n, t in (("i", 'id\tartist\tsong\talbum_name\n01\tA "B"\tS\\x\tL\n'), ("g", "id\tgenres\n01\trock, pop\n"), ("l", "id\tlang\n01\ten\n"), ("m", "id\tspotify_id\tpopularity\trelease\n01\tq\t3\t1999\n"))]
    r = ingest.read_metadata(spark, *files).first()
    assert (r.track_id, r.title, r.artist, r.album, r.year, r.lang, r.genres) == ("01", "S\\x", 'A "B"', "L", 1999, "en", "rock, pop")


def test_bundle_round_trip(spark, tmp_path):
    tracks = spark.createDataFrame([("a",), ("b",)], "track_id string")
    ingest.write_bundle(str(tmp_path / "b"), {"tracks": tracks, "track_vectors": tracks.withColumn("vec", F.array(F.lit(1.0)))}, {"dim": 1})
    tables, meta = ingest.read_bundle(spark, str(tmp_path / "b"), ["tracks"])
    assert tables["tracks"].count() == 2 and meta == {"dim": 1}
    with pytest.raises(ValueError):
        ingest.write_bundle(str(tmp_path / "c"), {"tracks": tracks, "track_vectors": tracks.limit(1)}, {})


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), 100)
    q = streams.daily_listens(stream, "60 days").writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(listens) FROM daily").first()[0] == events.count()
    q = streams.first_plays(streams.read_events(spark, str(tmp_path / "in"), 100), "60 days").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM firsts").first()[0] == events.select("user_id", F.get_json_object("props", "$.k")).distinct().count()


def test_a_file_is_fetched_resumed_and_checked(tmp_path):
    import hashlib
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    whole, asked = bytes(range(256)) * 40, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            start = int(self.headers.get("Range", "bytes=0-")[6:-1])
            asked.append(start)
            self.send_response(206 if start else 200)
            self.end_headers()
            self.wfile.write(whole[start:])

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, md5, target = f"http://127.0.0.1:{server.server_port}/x", hashlib.md5(whole).hexdigest(), tmp_path / "x.bin"
    (tmp_path / "x.bin.part").write_bytes(whole[:1000])
    assert ingest.fetch(url, target, md5).read_bytes() == whole and asked == [1000]
    ingest.fetch(url, target, md5)
    assert asked == [1000]  # right already
    (tmp_path / "y.bin.part").write_bytes(b"wrong")
    assert ingest.fetch(url, tmp_path / "y.bin", md5).read_bytes() == whole and asked == [1000, 5, 0]
    with pytest.raises(ValueError, match="digest"):
        ingest.fetch(url, tmp_path / "z.bin", "0" * 32)
    server.shutdown()


def test_vector_store(spark, tmp_path):
    v = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [3.0, 4.0])], "track_id string, vec array<double>")
    ingest.write_vectors(v, str(tmp_path / "v"), {"model": "m"})
    back, meta = ingest.read_vectors(spark, str(tmp_path / "v"))
    assert sorted((r.track_id, r.vec) for r in back.collect()) == [("a", [3.0, 4.0]), ("b", [1.0, 2.0])]
    assert meta == {"model": "m", "rows": 2, "dim": 2, "id": "track_id"}
    for bad in (v.unionByName(v), spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], v.schema)):
        with pytest.raises(ValueError):
            ingest.write_vectors(bad, str(tmp_path / "w"), {})


def test_checksum_and_bundle_meta(spark, tmp_path):
    import hashlib

    (tmp_path / "f").write_bytes(b"abc")
    r = ingest.checksum(spark, str(tmp_path / "f")).first()
    assert (r["size"], r.md5) == (3, hashlib.md5(b"abc").hexdigest())
    listens = spark.sql("SELECT * FROM VALUES (1L, 'a', TIMESTAMP_NTZ'2021-01-02 03:04:05'), (2L, 'a', TIMESTAMP_NTZ'2020-01-01 00:00:00') AS t(user_id, track_id, timestamp)")
    meta = ingest.bundle_meta(listens, {"recent": 28})
    assert meta == {"recent": 28, "now": "2021-01-02 03:04:05.000000", "listens": 2, "users": 2}
    tables = {"listens": listens, "user_vectors": spark.createDataFrame([(1, [1.0]), (9, [1.0])], "user_id long, vec array<double>")}
    with pytest.raises(ValueError, match="without listens"):
        ingest.write_bundle(str(tmp_path / "b"), tables, meta)
    ingest.write_bundle(str(tmp_path / "b"), {**tables, "user_vectors": tables["user_vectors"].where("user_id = 1")}, meta)
    back, again = ingest.read_bundle(spark, str(tmp_path / "b"), ["listens", "user_vectors"])
    assert again == meta and ingest.user_listens(back, spark.createDataFrame([(2,)], "user_id long")).count() == 1


def test_keys_of_events_are_those_of_the_parser(spark, tmp_path):
    """What is cut out without the parser is what the parser gives, whatever the text looks like."""
    from pyspark.sql import functions as F
    from recengine.sources import views

    texts = ['{"k": 7}', '{"k": 0}', '{"k": 07}', '{"k": 12345}', '{"k": }', '{"k": "7"}', '{"k": 1.5}', '{"k": -3}', '{"k": 1e3}', '{"k":7}', '{"k": 7, "j": 1}', '{"j": 2}', "", "{", '{"k": 7', None, '{"k": 12345678901234567890}', '{"k": null}', '{"k": {"a": 1}}', '{"k":  7}', '{"k": 7 }', '{"k": ١}']
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "user_id long, props string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    whole = spark.read.parquet(f"{tmp_path}/events.parquet").select("user_id", views.padded(F.get_json_object("props", "$.k"), 3).alias("track_id"))
    got = {r.user_id: r.track_id for r in views.listens_ev(spark, str(tmp_path)).collect()}
    assert got == {r.user_id: r.track_id for r in whole.collect()} and got[0] == "007" and got[3] == "12345"


def test_bias_and_difference_read_the_events_once(spark, monkeypatch):
    from recengine.plans import core
    from recengine.sources import views

    read, listens = [], views.listens_ev
    monkeypatch.setattr(views, "listens_ev", lambda *a: (read.append(1), listens(*a))[1])
    for name in ("bias_ratio", "bias_penalised", "bias_measures", "eval_difference"):
        read.clear()
        found = getattr(core, name)(spark, "/root/testdata/sf0.001")
        assert len(read) == 1, name
        assert "events.parquet" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_snapshots_and_rankers_read_the_events_once(spark, monkeypatch):
    from recengine.plans import models
    from recengine.sources import views

    read, listens = [], views.listens_ev
    monkeypatch.setattr(views, "listens_ev", lambda *a: (read.append(1), listens(*a))[1])
    monkeypatch.setattr(models, "TREES", 2)
    for build in (models.training_rows, models.rerank_top_n, models.ranker_logistic):
        read.clear()
        found = build(spark, "/root/testdata/sf0.001")
        assert len(read) == 1, build.__name__
        assert "events.parquet" not in found._jdf.queryExecution().optimizedPlan().toString()

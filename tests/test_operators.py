"""Queue, library and ranking operators on small tables."""

import pytest
from pyspark.sql import functions as F

from setloom.operators import library, queueing, ranking
from setloom.plans.queries import lib
from setloom.sources import files, plist
from setloom.streaming import plays


def queue(spark, ids, q=1):
    return spark.createDataFrame([(q, i, x) for i, x in enumerate(ids)], "queue_id long, pos long, track_id string")


def ids(df):
    return [r["track_id"] for r in df.orderBy("queue_id", "pos").collect()]


def test_queue_semantics(spark):
    q = queueing.appended(queue(spark, []), queue(spark, ["x", "y", "x", "z", "y"]))
    assert ids(q) == ["x", "y", "z"]
    assert ids(queueing.appended(q, queue(spark, ["y", "w"]))) == ["x", "y", "z", "w"]
    assert ids(queueing.moved(q, 0, 2)) == ["y", "z", "x"]
    assert ids(queueing.moved(q, 2, 0)) == ["z", "x", "y"]
    assert ids(queueing.moved(q, 0, 5)) == ["x", "y", "z"]
    head = spark.createDataFrame([(1, "z")], "queue_id long, track_id string")
    assert ids(queueing.inserted_head(q, head)) == ["z", "x", "y"]
    played = spark.createDataFrame([(1, "x"), (1, "y")], "queue_id long, track_id string")
    assert ids(queueing.drained(q, played, head.withColumn("track_id", F.lit("x")))) == ["x", "z"]
    assert queueing.next_unplayed(q, played).first()["track_id"] == "z"
    assert queueing.next_unplayed(q, q).count() == 0


def test_sorts_are_stable_both_ways(spark):
    df = spark.createDataFrame([(0, "b", None), (1, "a", 5.0), (2, "c", 5.0), (3, "d", 0.0)], "ord long, track_id string, bpm double")
    order = lambda x: [r["track_id"] for r in x.collect()]
    assert order(library.sorted_by(df, "bpm", True)) == ["a", "c", "b", "d"]
    assert order(library.sorted_by(df, "bpm")) == ["b", "d", "a", "c"]


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "track_id string, v int, ord int")
    new = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 2)], "track_id string, v int, ord int")
    assert {(r["track_id"], r["v"]) for r in library.upsert(t, new, "track_id").collect()} == {("a", 1), ("b", 4), ("c", 5)}
    (left,) = library.delete_cascade(t.where("track_id = 'a'"), t)
    assert [r["track_id"] for r in left.collect()] == ["b"]


def test_bulk_edit_blank_changes_nothing(spark):
    t = spark.createDataFrame([("a", "x", "g"), ("b", "y", None)], "track_id string, artist string, genre string")
    out = library.bulk_edit(t, t.where("track_id = 'b'"), {"artist": "  ", "genre": " h "})
    assert {tuple(r) for r in out.select("track_id", "artist", "genre").collect()} == {("a", "x", "g"), ("b", "y", "h")}


def test_filter_is_literal(spark):
    t = spark.createDataFrame([("a%b", "x"), ("axb", None)], "title string, genre string")
    assert [r["title"] for r in library.filtered(t, "A%", ("title", "genre")).collect()] == ["a%b"]
    assert library.filtered(t, "  ", ("title",)).count() == 2


def test_reorder_keeps_members(spark, sf):
    from setloom.plans.queries import members

    m = members(spark, sf)
    out = ranking.smart_reorder(m, "queue_id")
    assert out.count() == m.count() == out.dropDuplicates(["queue_id", "track_id"]).count()
    assert out.groupBy("queue_id").agg(F.max("place").alias("last"), F.count("*").alias("n")).where("last <> n - 1").count() == 0


def test_hub_means_are_those_of_sql(spark, tmp_path):
    """Queues whose mean lies on half of the last decimal shown, and of the last one kept."""
    import duckdb

    import __spark_entry__ as entry

    queues = {
        20753: [(2, 3817), (2, 6718), (5, 1863), (6, 6835), (7, 12532), (7, 11947)],
        84184: [(1, 4046), (2, 1933), (3, 6490), (5, 3977), (6, 12514), (7, 16314)],
        108968: [(1, 659), (1, 10712), (5, 8326), (5, 19711), (6, 45), (6, 6545)],
    }
    lines = [(q, n, p) for q, rows in queues.items() for n, p in rows]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE l AS SELECT * FROM (VALUES {', '.join(map(str, lines))}) v(q, n, p)")
    con.execute(f"COPY (SELECT q::BIGINT AS l_orderkey, n AS l_linenumber, p::BIGINT AS l_partkey, 1 AS l_suppkey, 1.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, DATE '2000-01-01' AS l_shipdate FROM l) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"COPY (SELECT p::BIGINT AS p_partkey, concat('name ', p) AS p_name, concat('brand ', p) AS p_brand, 1 AS p_size, concat('type ', p) AS p_type FROM l) TO '{tmp_path}/part.parquet'")
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(f"SELECT queue_id, track_id, mean FROM ({entry.oracle_sql()['hub_seed']})").fetchall()
    got = entry.queries()["hub_seed"](spark, str(tmp_path)).select("queue_id", "track_id", "mean").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_hub_means_add_from_the_end(spark, monkeypatch):
    """Whatever order the scores arrive in: their sum from the start would round to 0.403639661."""
    scores = [0.306676252, 0.30582399, 0.60223471, 0.39982369]
    rows = [(1, 0, i + 1, "x", f"y{i}", s) for i, s in enumerate(scores)]
    for arrival in (rows, rows[::-1]):
        pairs = spark.createDataFrame(arrival, "queue_id long, a_pos long, b_pos long, a string, b string, score double").coalesce(1)
        monkeypatch.setattr(ranking, "pair_scores", lambda members, group, pairs=pairs: pairs)
        assert [tuple(r) for r in ranking.hub_seed(None, "queue_id").collect()] == [(1, "x", 0.40363966)]


def test_reorder_bounds_a_queue(spark, sf, monkeypatch):
    from setloom.plans.queries import members

    monkeypatch.setattr(ranking, "MOST_QUEUED", 2)
    with pytest.raises(Exception, match="more than 2 tracks in queue"):
        ranking.smart_reorder(members(spark, sf), "queue_id").count()


def test_empty_pool_picks_nothing(spark, sf):
    rows = lib(spark, sf)
    scored = ranking.scored(rows.limit(0), ranking.current_row(rows, "t7"), None)
    assert ranking.pick_next(scored).count() == 0


def test_rank_plan_broadcasts_one_row_and_takes_ordered(spark, sf):
    from setloom.plans.queries import rank_candidates

    plan = rank_candidates(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "Arrow" not in plan


def test_scan_and_rows(spark, tmp_path):
    for name in ("a.mp3", "B.FLAC", "c.Mp3", "d.oPuS", "e.mp3x", ".x.mp3", "note.txt", "sub/_c.ogg", ".hid/d.mp3"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(name.encode())
    found = files.scan(spark, f"file:{tmp_path}")
    names = sorted(r["path"].rsplit("/", 1)[1] for r in found.collect())
    assert names == ["B.FLAC", "a.mp3", "c.Mp3", "d.oPuS"]
    rows = files.track_rows(found, 5).orderBy("title").collect()
    assert [(r["title"], r["artist"], r["mime"]) for r in rows] == [("B", "Unknown Artist", "audio/flac"), ("a", "Unknown Artist", "audio/mpeg"), ("c", "Unknown Artist", "audio/mpeg"), ("d", "Unknown Artist", "audio/opus")]
    assert all(r["file_hash"] == r["track_id"][:16] for r in rows)


def test_rename_collisions(spark):
    t = spark.createDataFrame([("1", "/m/a.mp3", "x"), ("2", "/m/b.mp3", "x"), ("3", "/m/c.mp3", "d"), ("4", "/m/d.mp3", "d")], "track_id string, file_path string, title string")
    out = {r["track_id"]: r["status"] for r in files.rename_plan(t, F.col("title")).collect()}
    assert out == {"1": "collision", "2": "collision", "3": "collision", "4": "unchanged"}


def test_plist_library(spark, tmp_path):
    import plistlib

    tracks = {"1": {"Location": "file:///m/a%20b.mp3", "Kind": "MPEG audio file", "Name": "A", "Total Time": 2500}, "2": {"Location": "http://x", "Kind": "MPEG audio file"}, "3": {"Kind": "MPEG audio file"}, "4": {"Location": "file:///m/old.mp3", "Kind": "MPEG audio file"}, "5": {"Location": "file:///m/v.mov", "Kind": "QuickTime movie"}}
    (tmp_path / "Library.xml").write_bytes(plistlib.dumps({"Tracks": tracks}))
    known = spark.createDataFrame([("/m/old.mp3",)], "file_path string")
    out = plist.importable(plist.read_libraries(spark, f"file:{tmp_path}"), known).collect()
    assert [(r["file_path"], r["title"], r["duration_sec"], r["file_hash"]) for r in out] == [("/m/a b.mp3", "A", 2.5, "itunes:1")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.sql("SELECT id AS event_id, timestamp_seconds(1700000000 + id * 37) AS ts, concat('k', id % 3) AS event_type, CAST(id AS DOUBLE) AS value FROM range(500)")
    events.write.parquet(str(tmp_path / "in"))
    live = plays.windowed_plays(plays.read_plays(spark, str(tmp_path / "in"), events))
    q = live.writeStream.format("memory").queryName("plays_out").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("plays_out").collect()}
    assert got == {tuple(r) for r in plays.windowed_plays(events).collect()}


def test_repeats_dropped_from_stream(spark, tmp_path):
    events = spark.sql("SELECT id % 50 AS event_id, timestamp_seconds(1700000000 + id) AS ts FROM range(100)")
    events.write.parquet(str(tmp_path / "in"))
    live = plays.distinct_plays(plays.read_plays(spark, str(tmp_path / "in"), events))
    plays.append_to_history(live, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_tags_of_scanned_files(spark, tmp_path):
    from setloom.functions import codecs

    utf16 = codecs.standard_tag(b"audio", {"title": "Tïtle", "artist": "Ärtist", "genre": "House", "album": "中", "year": "1999", "comment": "c"})
    frame = lambda name, body, v: name + (codecs.to_synchsafe(len(body)) if v == 4 else len(body).to_bytes(4, "big")) + b"\0\0" + body
    old = frame(b"TIT2", b"\0T\xefle\0second", 3) + frame(b"TPE2", b"\x02" + "Bänd".encode("utf-16-be"), 3) + frame(b"TLEN", b"\x002500", 3)
    new = frame(b"TPE1", b"\x03One\0Two", 4) + frame(b"TCON", b"\x09bad", 4)
    for name, data in (("a", utf16), ("b", b"ID3\x03\0\0" + codecs.to_synchsafe(len(old)) + old + b"x"), ("c", b"ID3\x04\0\0" + codecs.to_synchsafe(len(new)) + new), ("d", b"ID3\x03")):
        (tmp_path / f"{name}.mp3").write_bytes(data)
    rows = {r["file_path"][-5]: r for r in files.track_rows(files.scan(spark, f"file:{tmp_path}"), 5).collect()}
    got = {k: (r["title"], r["artist"], r["album"], r["genre"], r["duration_sec"]) for k, r in rows.items()}
    assert got == {"a": ("Tïtle", "Ärtist", "中", "House", 0.0), "b": ("Tïle", "Bänd", None, None, 2.5), "c": ("c", "One", None, None, 0.0), "d": ("d", "Unknown Artist", None, None, 0.0)}
    again = codecs.standard_tag(utf16, {"title": "New"})
    assert codecs.read_text(again) == {"TIT2": ["New"]} and again.endswith(b"audio") and codecs.read_text(utf16)["TYER"] == ["1999"]


def test_merging_keeps_what_features_do_not_say(spark):
    from setloom.sources import catalog

    a = spark.createDataFrame([("x", 100.0, "1A", 0.2, 0.3, 0.4, "partial", 0.7, 0.9), ("y", 101.0, "2A", 0.2, 0.3, 0.4, "partial", 0.7, 0.8)], "track_id string, bpm double, camelot string, energy_mean double, bpm_confidence double, key_confidence double, quality string, first_beat double, energy_peak double")
    f = spark.createDataFrame([("x", 120.0, "8A", 0.5, -6.0, 90.0), ("z", 125.0, "9A", 0.9, -5.0, 6.0)], "track_id string, f_bpm double, f_camelot string, f_energy double, f_loudness double, duration_sec double")
    out = {r["track_id"]: r for r in catalog.merged(a, f).collect()}
    assert (out["x"]["energy_peak"], out["y"]["energy_peak"], out["z"]["energy_peak"]) == (0.9, 0.8, 1.0)
    assert (out["x"]["bpm_confidence"], out["x"]["key_confidence"], out["y"]["bpm_confidence"], out["x"]["first_beat"]) == (0.95, 0.9, 0.3, 0.7)
    assert (out["z"]["mix_in"], out["z"]["mix_out"], out["z"]["first_beat"], out["z"]["rms_db"], out["z"]["is_stable"]) == (6.0, 0.0, 0.0, -5.0, True)


def test_tag_writes_report_errors(spark):
    rows = [("/a.mp3", b"\xff\xfb", 120.0, [0.5, 1.0], [0.5]), ("/b.flac", b"x", 120.0, [], []), ("/c.mp3", b"\xff", None, [], [])]
    df = spark.createDataFrame(rows, "path string, content binary, bpm double, beats array<double>, cues array<double>")
    out = {r["path"]: r for r in files.tag_writes(df).collect()}
    assert [out[p]["status"] for p in ("/a.mp3", "/b.flac")] == ["ok", "skipped"]
    back = spark.createDataFrame([(out["/a.mp3"]["content"],)], "content binary").select(files.tag_tempo("content").alias("t")).first()["t"]
    assert (back["bpm"], back["first_beat"]) == (120.0, 0.5)


def test_resync_flag(spark):
    from setloom.operators.resync import resync_plan

    lib_ = spark.createDataFrame([("a", "/x 90.mp3", "x 90", 120.0, 0.1, "unreliable", 60.0)], "track_id string, file_path string, title string, bpm double, first_beat double, quality string, duration_sec double")
    tags = spark.createDataFrame([("a", 120.01, 0.1)], "track_id string, tag_bpm double, tag_first double")
    assert resync_plan(lib_, tags).first()["source"] == "name"
    assert resync_plan(lib_, tags, False).first()["source"] == "unchanged"
    moved = spark.createDataFrame([("a", 120.0, 0.2)], "track_id string, tag_bpm double, tag_first double")
    assert tuple(resync_plan(lib_, moved).first())[1:5] == ("tag", 120.0, 0.2, "partial")

"""Registered queries of the store, selections, queues, names and tags, with SQL for DuckDB beside each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.functions import camelot, codecs, text
from setloom.operators import dedupe, library, queueing, ranking
from setloom.plans.fixtures import duck, load
from setloom.plans.queries import (
    CLEAN, COLLAPSE, LIB, NEEDLE, NOW_MS, ORACLE, PAIRS_SQL, QUEUE_SQL, SESSION, SESSION_SQL, TOTAL, TWINS, lib, members, parts_sql, query, r6, session_rows,
)
from setloom.sources import catalog, files, plist

# ---- store ----------------------------------------------------------------------------------------

PLAYLISTS = "SELECT queue_id AS playlist_id, CAST(1700000000000 + (queue_id * 7919) % 1009 * 60000 AS BIGINT) AS updated_at, CAST(count(*) AS BIGINT) AS tracks FROM {queue} GROUP BY queue_id"


@query(f"WITH {duck('queue')} SELECT * FROM ({PLAYLISTS.format(queue='queue')}) ORDER BY updated_at DESC, playlist_id DESC")
def playlist_listing(spark, sf):
    return library.listed_playlists(spark.sql(PLAYLISTS, queue=load(spark, sf, "queue")))


@query(f"WITH {duck('queue')} SELECT * FROM ({PLAYLISTS.format(queue='queue')}) WHERE playlist_id % 3 <> 0")
def playlist_delete(spark, sf):
    kept = spark.sql(PLAYLISTS, queue=load(spark, sf, "queue"))
    return library.without_playlists(kept, kept.where("playlist_id % 3 = 0"))


STORES = ("tracks", "analyses", "history", "queue")


@query("SELECT unnest(['tracks', 'analyses', 'history', 'queue']) AS store, 0::BIGINT AS n")
def store_clear(spark, sf):
    empty = library.cleared(*[load(spark, sf, s) for s in STORES])
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(s).alias("store"), "n") for s, t in zip(STORES, empty)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(f"WITH {duck('tracks')} SELECT track_id, CASE WHEN ord % 3 = 0 THEN 'Unknown' ELSE title END AS title, CASE WHEN ord % 3 = 0 THEN '' ELSE coalesce(genre, '') END AS genre FROM tracks")
def inline_edit(spark, sf):
    typed = lambda c: F.when(F.col("ord") % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col(c), F.lit(" ")))
    return load(spark, sf, "tracks").select("track_id", library.edited_text("title", typed("title")).alias("title"), library.edited_text("genre", typed("genre")).alias("genre"))


ASKED = "SELECT CASE WHEN ord % 3 = 0 THEN concat(file_path, '~') ELSE file_path END AS file_path FROM {tracks}"


@query(f"WITH {duck('tracks')} SELECT file_path, file_path IN (SELECT file_path FROM tracks) AS known FROM ({ASKED.format(tracks='tracks')})")
def path_lookup(spark, sf):
    tracks = load(spark, sf, "tracks")
    return library.known_paths(spark.sql(ASKED, tracks=tracks), tracks)


EXTENSIONS_SQL = "\\.(" + "|".join(text.AUDIO_EXTENSIONS) + ")$"
LISTED = "SELECT concat(file_path, CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN '.OPUS' WHEN 2 THEN '.txt' ELSE '.Mp3' END) AS path FROM {tracks}"


@query(f"WITH {duck('tracks')} SELECT path FROM ({LISTED.format(tracks='tracks')}) WHERE regexp_matches(lower(path), '{EXTENSIONS_SQL}')")
def file_list(spark, sf):
    return files.file_list(spark, spark.sql(LISTED, tracks=load(spark, sf, "tracks")))


NAME_SQL = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')"


@query(f"WITH {duck('tracks')} SELECT sha1(file_path) AS track_id, file_path, concat('native:', right(file_path, 32)) AS file_hash, {NAME_SQL.format('file_path')} AS title, 'Unknown Artist' AS artist, 0.0::DOUBLE AS duration_sec FROM tracks")
def native_import(spark, sf):
    return files.native_rows(load(spark, sf, "tracks").select(F.col("file_path").alias("path")), NOW_MS).drop("added_at")


REGISTERED = "SELECT track_id, CASE WHEN ord % 5 = 0 THEN 'path' ELSE 'file' END AS kind, file_path AS path FROM {tracks} WHERE ord % 5 < 2"
HANDLES = "SELECT track_id, concat(file_path, '.aac') AS path, ord % 3 <> 0 AS readable FROM {tracks} WHERE ord % 5 < 4"


@query(f"""WITH {duck('tracks')}, r AS ({REGISTERED.format(tracks='tracks')}), h AS ({HANDLES.format(tracks='tracks')}),
s AS (SELECT t.track_id, CASE WHEN r.kind IS NOT NULL THEN r.kind WHEN h.readable THEN 'handle' END AS source, CASE WHEN r.kind IS NOT NULL THEN r.path WHEN h.readable THEN h.path END AS path FROM tracks t LEFT JOIN r USING (track_id) LEFT JOIN h USING (track_id))
SELECT track_id, source, path, CASE WHEN path LIKE '%.mp3' THEN 'audio/mpeg' WHEN path LIKE '%.flac' THEN 'audio/flac' WHEN path LIKE '%.aac' THEN 'audio/mp4' END AS mime FROM s""")
def resolve_sources(spark, sf):
    tracks = load(spark, sf, "tracks")
    return files.resolved(tracks, spark.sql(REGISTERED, tracks=tracks), spark.sql(HANDLES, tracks=tracks))


#: Entries as a library file has them: some without an address, of another kind, known, missing, or with an encoded address.
ENTRIES = """SELECT CAST(ord AS STRING) AS key, CASE ord % 7 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN concat('http://', title) ELSE concat('file://', CASE WHEN ord % 2 = 0 THEN 'localhost' ELSE '' END, '/itl/', replace(title, ' ', '%20'), '+', CAST(ord AS STRING), '.mp3') END AS location,
 CASE ord % 5 WHEN 0 THEN 'MPEG audio file' WHEN 1 THEN 'QuickTime movie file' WHEN 2 THEN '' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'Purchased AAC audio file' END AS kind,
 CASE WHEN ord % 4 = 0 THEN CAST(NULL AS STRING) ELSE title END AS name, CASE WHEN ord % 3 = 0 THEN artist ELSE CAST(NULL AS STRING) END AS artist, CASE WHEN ord % 3 = 1 THEN artist ELSE CAST(NULL AS STRING) END AS album_artist,
 album, genre, CAST(duration_sec * 1000 AS BIGINT) AS total_ms, CASE WHEN ord % 2 = 0 THEN file_hash ELSE CAST(NULL AS STRING) END AS persistent_id FROM {tracks}"""
THERE = "SELECT concat('/itl/', title, '+', CAST(ord AS STRING), '.mp3') AS file_path FROM {tracks} WHERE ord % 11 <> 0"
KINDS_SQL = "^(" + "|".join(plist.AUDIO_KINDS) + ")"


@query(f"""WITH {duck('tracks')}, e AS ({ENTRIES.format(tracks='tracks')}), x AS ({THERE.format(tracks='tracks')}),
p AS (SELECT *, replace(regexp_replace(location, '^file://(localhost)?', ''), '%20', ' ') AS file_path FROM e WHERE location LIKE 'file://%' AND (coalesce(kind, '') = '' OR regexp_matches(kind, '{KINDS_SQL}')))
SELECT sha1(file_path) AS track_id, file_path, concat('itunes:', coalesce(persistent_id, key)) AS file_hash, coalesce(name, regexp_extract(file_path, '([^/]*)$', 1)) AS title, coalesce(artist, album_artist, 'Unknown Artist') AS artist, album, genre, total_ms / 1000.0::DOUBLE AS duration_sec
FROM p WHERE file_path IN (SELECT file_path FROM x) AND file_path NOT IN (SELECT file_path FROM tracks)""")
def library_file_import(spark, sf):
    tracks = load(spark, sf, "tracks")
    return plist.importable(spark.sql(ENTRIES, tracks=tracks), tracks, spark.sql(THERE, tracks=tracks))


@query("SELECT '/home/u/Music/iTunes/iTunes Library.xml' AS path")
def library_file_choice(spark, sf):
    listed = spark.createDataFrame([(f"/home/{u}/{p}",) for u, p in (("u", plist.LIBRARY_FILES[2]), ("u", plist.LIBRARY_FILES[1]), ("v", plist.LIBRARY_FILES[0]))], "path string")
    return plist.library_file(listed, "/home/u/")


SORTS = {"artist": "''", "album": "''", "genre": "''", "camelot": "''", "energy_mean": "0.0::DOUBLE", "duration_sec": "0.0::DOUBLE"}


def _register_sort(column: str, default: str) -> None:
    def run(spark, sf):
        return library.sorted_by(lib(spark, sf), column).select("track_id", library.sort_key(column).alias("key"))

    run.__name__ = f"library_sort_{column}"
    query(f"{LIB} SELECT track_id, coalesce({column}, {default}) AS key FROM lib ORDER BY key, ord")(run)


for _column, _default in SORTS.items():
    _register_sort(_column, _default)


@query(f"{LIB} SELECT track_id, title FROM lib WHERE quality IS NOT NULL AND (contains(lower(title), '{NEEDLE}') OR contains(lower(artist), '{NEEDLE}'))")
def add_sheet_filter(spark, sf):
    return library.addable(lib(spark, sf), NEEDLE.upper()).select("track_id", "title")


SELECTED = "SELECT track_id FROM {tracks} WHERE ord % 4 = 0"
CLICKED = "SELECT track_id FROM {tracks} WHERE ord % 6 = 0"


@query(f"WITH {duck('tracks')} SELECT track_id FROM tracks WHERE (ord % 4 = 0) <> (ord % 6 = 0)")
def selection_toggle(spark, sf):
    tracks = load(spark, sf, "tracks")
    return library.toggled(spark.sql(SELECTED, tracks=tracks), spark.sql(CLICKED, tracks=tracks))


@query(f"WITH {duck('tracks')} SELECT 'some' AS before, track_id FROM tracks")
def selection_toggle_all(spark, sf):
    tracks = load(spark, sf, "tracks")
    chosen = lambda some, name: library.toggled_all(some, tracks).select(F.lit(name).alias("before"), "track_id")
    return chosen(spark.sql(SELECTED, tracks=tracks), "some").unionByName(chosen(tracks, "all"))


@query(f"{LIB} SELECT track_id, CASE WHEN s >= 60 THEN concat((floor(s)::BIGINT // 60)::VARCHAR, ':', lpad((floor(s)::BIGINT % 60)::VARCHAR, 2, '0')) ELSE concat(ceil(s)::BIGINT::VARCHAR, 's') END AS left_text FROM (SELECT track_id, duration_sec * coalesce(energy_mean, 0.5) AS s FROM lib)")
def countdown_text(spark, sf):
    return lib(spark, sf).select("track_id", text.countdown(F.col("duration_sec") * F.coalesce("energy_mean", F.lit(0.5))).alias("left_text"))


@query(f"""{LIB}, r AS (SELECT track_id, regexp_extract(file_path, '([^/]*)$', 1) AS old, {COLLAPSE.format(CLEAN.format("coalesce(genre, '')"))} AS clean FROM lib),
n AS (SELECT *, CASE WHEN clean = '' THEN old ELSE concat(clean, regexp_extract(old, '^.+?((\\.[^.]*)?)$', 1)) END AS new_name FROM r)
SELECT track_id, new_name, new_name <> old AS changed, CASE WHEN clean = '' THEN 'template rendered empty (missing tags?)' END AS reason FROM n""")
def rename_by_genre(spark, sf):
    preview = text.rename_preview(F.col("file_path"), text.rendered(" {Genre} ", {"genre": F.col("genre")}))
    return lib(spark, sf).select("track_id", preview.alias("p")).select("track_id", "p.*")


# ---- duplicates -----------------------------------------------------------------------------------

PLACED = ORACLE["probable_duplicates"].rsplit("SELECT track_id, key, anchor", 1)[0]
CLUSTERS = """SELECT 'exact' AS kind, file_hash AS cluster, track_id, n FROM exact WHERE n >= 2
UNION ALL SELECT 'probable', concat(key, '#', anchor), track_id, n FROM placed WHERE n >= 2"""


@query(f"{PLACED} {CLUSTERS}")
def duplicate_clusters(spark, sf):
    return dedupe.duplicate_clusters(spark.sql(TWINS, tracks=load(spark, sf, "tracks"))).select("kind", "cluster", "track_id", "n")


@query(f"{PLACED}, c AS ({CLUSTERS}) SELECT kind, count(DISTINCT cluster) AS clusters, count(*) AS tracks FROM c GROUP BY kind")
def duplicate_cluster_counts(spark, sf):
    return dedupe.cluster_counts(spark.sql(TWINS, tracks=load(spark, sf, "tracks")))


# ---- queues ---------------------------------------------------------------------------------------

#: Ids to be added, played or put in front: other tracks by arithmetic on the queue's own, with repeats.
BATCH = "SELECT queue_id, pos, concat('t', CAST((queue_id * 7 + pos * 3) % 120 + 1 AS STRING)) AS track_id FROM {queue}"


@query(f"""{QUEUE_SQL}, b AS ({BATCH.format(queue='queue')}), every AS (SELECT queue_id, 0 AS part, pos, track_id FROM d UNION ALL SELECT queue_id, 1, pos, track_id FROM b),
f AS (SELECT queue_id, track_id, min(part * 1000000 + pos) AS first_at FROM every GROUP BY ALL) SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY first_at) - 1 AS pos, track_id FROM f""")
def queue_append(spark, sf):
    queue = load(spark, sf, "queue")
    return queueing.appended(queueing.deduped(queue), spark.sql(BATCH, queue=queue))


@query(f"{QUEUE_SQL}, b AS ({BATCH.format(queue='queue')}) SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY pos) - 1 AS pos, track_id FROM d WHERE (queue_id, track_id) NOT IN (SELECT queue_id, track_id FROM b)")
def queue_remove(spark, sf):
    queue = load(spark, sf, "queue")
    return queueing.removed(queueing.deduped(queue), spark.sql(BATCH, queue=queue))


@query(f"{QUEUE_SQL} SELECT queue_id, 'head' AS part, 0::BIGINT AS pos, track_id FROM d WHERE pos = 0 UNION ALL SELECT queue_id, 'rest', pos - 1, track_id FROM d WHERE pos > 0")
def queue_pop(spark, sf):
    heads, rest = queueing.popped(queueing.deduped(load(spark, sf, "queue")))
    return heads.select("queue_id", F.lit("head").alias("part"), F.lit(0).cast("long").alias("pos"), "track_id").unionByName(rest.select("queue_id", F.lit("rest").alias("part"), "pos", "track_id"))


HEADS = "SELECT queue_id, max(track_id) AS track_id FROM {queue} WHERE queue_id % 2 = 0 GROUP BY queue_id"


@query(f"""{QUEUE_SQL}, h AS ({HEADS.format(queue='queue')}), every AS (SELECT queue_id, -1 AS pos, track_id FROM h UNION ALL SELECT queue_id, pos, track_id FROM d WHERE (queue_id, track_id) NOT IN (SELECT queue_id, track_id FROM h))
SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY pos) - 1 AS pos, track_id FROM every""")
def queue_play_next(spark, sf):
    queue = load(spark, sf, "queue")
    return queueing.inserted_head(queueing.deduped(queue), spark.sql(HEADS, queue=queue))


@query(f"""{QUEUE_SQL}, {duck('history')}, c AS ({HEADS.format(queue='queue')}) SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY pos) - 1 AS pos, track_id FROM d
WHERE track_id NOT IN (SELECT track_id FROM history WHERE session_id = {SESSION}) OR (queue_id, track_id) IN (SELECT queue_id, track_id FROM c)""")
def queue_drain(spark, sf):
    queue = load(spark, sf, "queue")
    heard = load(spark, sf, "history").where(F.col("session_id") == SESSION).select("track_id").distinct()
    played = queueing.deduped(queue).join(heard, "track_id", "left_semi").select("queue_id", "track_id")
    return queueing.drained(queueing.deduped(queue), played, spark.sql(HEADS, queue=queue))


# ---- what to play ---------------------------------------------------------------------------------

TIERS = f"""tiers AS (SELECT *, row_number() OVER (ORDER BY p_recency < 1 DESC, score DESC, ord) AS u, row_number() OVER (ORDER BY p_recency < 1 AND abs(coalesce(bpm, 120) - coalesce(cur_bpm, 120)) < 12 DESC, score DESC, ord) AS c, row_number() OVER (ORDER BY score DESC, ord) AS f FROM {{pool}}),
pick AS (SELECT 0 AS o, 'normal' AS mode, * FROM tiers WHERE u = 1 AND p_recency < 1 AND score >= 0.55 UNION ALL SELECT 1, 'relaxed-bpm', * FROM tiers WHERE c = 1 AND p_recency < 1 AND abs(coalesce(bpm, 120) - coalesce(cur_bpm, 120)) < 12 UNION ALL SELECT 2, 'forced', * FROM tiers WHERE f = 1)"""


@query(f"{SESSION_SQL}, pool AS (SELECT * FROM scored WHERE track_id NOT IN (SELECT track_id FROM history WHERE session_id = {SESSION})), {TIERS.format(pool='pool')} SELECT mode, track_id, round(score, 6) AS score FROM pick ORDER BY o LIMIT 1")
def next_recommended(spark, sf):
    heard = load(spark, sf, "history").where(F.col("session_id") == SESSION)
    return ranking.pick_next(ranking.unheard(session_rows(spark, sf), heard)).select("mode", "track_id", r6(F.col("score"), "score"))


@query(f"{SESSION_SQL}, pool AS (SELECT s.* FROM scored s JOIN lib USING (track_id) WHERE lib.quality IS NOT NULL), {TIERS.format(pool='pool')} SELECT 'pick' AS source, track_id FROM pick ORDER BY o LIMIT 1")
def next_track_pick(spark, sf):
    """A queue whose tracks all have been played: the pick, of analysed tracks, is next."""
    queue = queueing.deduped(load(spark, sf, "queue"))
    return ranking.next_track(queueing.next_unplayed(queue, queue), ranking.pick_next(session_rows(spark, sf).where("quality is not null")))


@query(f"{SESSION_SQL}, {duck('queue')} SELECT track_id, round(score, 6) AS score FROM scored WHERE track_id NOT IN (SELECT track_id FROM queue WHERE queue_id = (SELECT min(queue_id) FROM queue)) ORDER BY scored.score DESC, ord LIMIT 8")
def top_candidates(spark, sf):
    queue = load(spark, sf, "queue")
    queued = queue.join(F.broadcast(queue.agg(F.min("queue_id").alias("queue_id"))), "queue_id")
    return ranking.top(session_rows(spark, sf).join(queued.select("track_id").distinct(), "track_id", "left_anti"), 8).select("track_id", r6(F.col("score"), "score"))


ANCHORS = "SELECT DISTINCT queue_id, concat('t', CAST(queue_id % 150 + 1 AS STRING)) AS track_id FROM {queue}"
ANCHOR_PARTS = ", ".join(f"{v} AS p_{k}" for k, v in parts_sql("a.", "b.", "CASE WHEN a.artist = b.artist THEN 1 ELSE 0 END", "CASE WHEN coalesce(a.genre, '') <> '' AND a.genre = b.genre THEN 1 ELSE 0 END", "CASE WHEN a.track_id = b.track_id THEN 1.0 ELSE 0.0 END").items())


@query(f"""{PAIRS_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, anchors AS ({ANCHORS.format(queue='queue')}),
after AS (SELECT b.queue_id, b.track_id, b.pos, {ANCHOR_PARTS} FROM anchors n JOIN lib a ON a.track_id = n.track_id AND a.quality IS NOT NULL JOIN m b ON b.queue_id = n.queue_id),
anchored AS (SELECT queue_id, track_id FROM (SELECT *, {TOTAL} AS score FROM after) QUALIFY row_number() OVER (PARTITION BY queue_id ORDER BY score DESC, pos) = 1),
start AS (SELECT h.queue_id, coalesce(a.track_id, h.track_id) AS track_id FROM hub h LEFT JOIN anchored a USING (queue_id)),
ways AS MATERIALIZED (SELECT queue_id, a, list({{'b': b, 's': score}} ORDER BY score DESC, b_pos) AS nexts FROM pairs GROUP BY ALL),
walk AS (SELECT queue_id, track_id AS here, [track_id] AS done, 0 AS place FROM start
 UNION ALL SELECT queue_id, nb, list_append(done, nb), place + 1 FROM (SELECT w.queue_id, w.done, w.place, list_filter(y.nexts, lambda x: NOT list_contains(w.done, x.b))[1].b AS nb FROM walk w JOIN ways y ON y.queue_id = w.queue_id AND y.a = w.here) WHERE nb IS NOT NULL)
SELECT queue_id, place, here AS track_id FROM walk UNION ALL SELECT queue_id, 0, track_id FROM m QUALIFY count(*) OVER (PARTITION BY queue_id) = 1""")
def smart_reorder_anchored(spark, sf):
    anchors = spark.sql(ANCHORS, queue=load(spark, sf, "queue")).join(lib(spark, sf).where("quality is not null"), "track_id")
    return ranking.smart_reorder(members(spark, sf), "queue_id", anchors)


# ---- catalog and tags -----------------------------------------------------------------------------

HIT_IDS = "SELECT track_id, concat('c', CAST(ord % 500 AS STRING)) AS hit_id FROM {tracks}"
HIT_FEATURES = "SELECT concat('c', CAST(i AS STRING)) AS hit_id, CAST(i % 14 - 1 AS INT) AS key, CAST(i % 2 AS INT) AS mode, CAST(80 + i % 70 AS DOUBLE) AS tempo, CAST(i % 13 AS DOUBLE) / CAST(10 AS DOUBLE) AS energy, CAST(-i % 20 AS DOUBLE) AS loudness FROM {ids} WHERE i % 9 <> 4"
WHEEL_SQL = "CASE concat(CASE WHEN key BETWEEN 0 AND 11 THEN key ELSE 0 END, CASE WHEN mode = 1 THEN 'major' ELSE 'minor' END) " + " ".join(f"WHEN '{i}{scale}' THEN '{camelot.WHEEL[p + " " + scale]}'" for i, p in enumerate(camelot.PITCHES) for scale in ("major", "minor")) + " END"


@query(f"""WITH {duck('tracks')}, f AS ({HIT_FEATURES.format(ids='range(500) t(i)')})
SELECT track_id, hit_id, f.hit_id IS NOT NULL AS found, tempo AS bpm, CASE WHEN f.hit_id IS NOT NULL THEN {WHEEL_SQL} END AS camelot, CASE WHEN energy IS NOT NULL THEN round(greatest(0.0, least(1.0, energy)), 6) END AS energy_mean, loudness AS rms_db
FROM ({HIT_IDS.format(tracks='tracks')}) t LEFT JOIN f USING (hit_id)""")
def catalog_features(spark, sf):
    features = spark.sql(HIT_FEATURES, ids=spark.range(500).toDF("i"))
    out = catalog.feature_rows(spark.sql(HIT_IDS, tracks=load(spark, sf, "tracks")), features)
    return out.select("track_id", "hit_id", "found", "bpm", "camelot", r6(F.col("energy_mean"), "energy_mean"), "rms_db")


#: Files to be written: an mp3 of a few bytes, some with an older tag; one kind without a tempo fails.
WRITES = """SELECT file_path AS path, CASE WHEN ord % 2 = 0 THEN encode('audio', 'UTF-8') ELSE concat(X'494433030000000000155449543200000005000000004F6C6420', X'0000000000', encode('audio', 'UTF-8')) END AS content,
 CASE WHEN ord % 19 = 3 THEN CAST(NULL AS DOUBLE) ELSE bpm END AS bpm, array(CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE)) AS beats, array(CAST(8 AS DOUBLE)) AS cues, title, CASE WHEN ord % 4 = 0 THEN CAST(NULL AS STRING) ELSE artist END AS artist,
 album, genre, camelot, file_path LIKE '/%' AS writable FROM {lib} WHERE bpm IS NOT NULL"""
WRITTEN_SQL = f"{LIB}, w AS (SELECT *, ord % 19 <> 3 AS good FROM lib WHERE bpm IS NOT NULL), s AS (SELECT *, CASE WHEN NOT ends_with(lower(file_path), '.mp3') THEN 'skipped' WHEN good THEN 'ok' ELSE 'failed' END AS status FROM w)"


def _writes(spark, sf) -> DataFrame:
    return files.tag_writes(spark.sql(WRITES, lib=lib(spark, sf)))


@query(f"{WRITTEN_SQL} SELECT file_path AS path, status, CASE WHEN status = 'ok' THEN CASE WHEN file_path LIKE '/%' THEN 'in-place' ELSE 'download' END END AS mode, CASE WHEN status = 'ok' THEN round(round(bpm, 2), 6) END AS tag_bpm, CASE WHEN status = 'ok' THEN floor(bpm + 0.5)::BIGINT::VARCHAR END AS frame_bpm, CASE WHEN status = 'ok' THEN camelot END AS camelot FROM s")
def tag_writes(spark, sf):
    frames = files.text_frames("content")
    return _writes(spark, sf).withColumn("f", frames).select(
        "path", "status", "mode", r6(files.tag_tempo("content")["bpm"], "tag_bpm"), F.try_element_at("f", F.lit("TBPM")).alias("frame_bpm"), F.try_element_at("f", F.lit("TXXX:CAMELOT")).alias("camelot"),
    )


@query(f"{WRITTEN_SQL} SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, CASE WHEN count(DISTINCT file_path LIKE '/%') FILTER (status = 'ok') = 1 THEN 'in-place' END AS mode FROM s")
def tag_write_summary(spark, sf):
    return files.write_summary(_writes(spark, sf))


@query(f"{WRITTEN_SQL} SELECT file_path, title, CASE WHEN ord % 4 = 0 THEN 'Unknown Artist' ELSE artist END AS artist, album, genre, 'audio/mpeg' AS mime FROM s WHERE status = 'ok'")
def tagged_track_rows(spark, sf):
    written = _writes(spark, sf).where("status = 'ok'")
    return files.track_rows(written, NOW_MS).select("file_path", "title", "artist", "album", "genre", "mime")


def _round_trip(rows: DataFrame, one, schema: str) -> DataFrame:
    """``one(row)`` of each row, beside its track_id."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(r.track_id, *one(r)) for r in pdf.itertuples()], columns=names)

    return rows.mapInPandas(run, schema)


@query(f"{LIB} SELECT track_id, round(bpm, 2) AS bpm, 0.0::DOUBLE AS auto_gain, round(integrated_lufs, 3) AS gain FROM lib WHERE bpm IS NOT NULL")
def autotags_codec(spark, sf):
    def one(r):
        found = codecs.decode_autotags(codecs.encode_autotags(r.bpm, 0.0, r.integrated_lufs))
        return found["bpm"], found["auto_gain"], found["gain"]

    return _round_trip(lib(spark, sf).where("bpm is not null").select("track_id", "bpm", "integrated_lufs"), one, "track_id string, bpm double, auto_gain double, gain double")


@query(f"""{LIB}, b AS (SELECT track_id, bpm, first_beat, ord % 30 + 1 AS n FROM lib WHERE bpm IS NOT NULL), m AS (SELECT track_id, bpm, first_beat, n, unnest(list_distinct(list_append(range(0, n, 8), n - 1))) AS i FROM b)
SELECT track_id, count(*) AS markers, round(min(first_beat + i * 0.5)::FLOAT::DOUBLE, 6) AS first, round(max(first_beat + i * 0.5)::FLOAT::DOUBLE, 6) AS last, round(any_value(bpm)::FLOAT::DOUBLE, 4) AS bpm FROM m GROUP BY track_id""")
def beat_grid_codec(spark, sf):
    def one(r):
        found = codecs.decode_beat_grid(codecs.encode_beat_grid([r.first_beat + 0.5 * i for i in range(r.ord % 30 + 1)], r.bpm))
        return len(found["positions"]), found["positions"][0], found["positions"][-1], found["bpm"]

    out = _round_trip(lib(spark, sf).where("bpm is not null").select("track_id", "ord", "bpm", "first_beat"), one, "track_id string, markers long, first double, last double, bpm double")
    return out.select("track_id", "markers", r6(F.col("first"), "first"), r6(F.col("last"), "last"), F.round("bpm", 4).alias("bpm"))


MARKS = "SELECT track_id, ord, i, CAST((ord * 37 + i * 7919) % 180000 AS BIGINT) AS ms FROM {tracks}, {numbers}"


@query(f"WITH {duck('tracks')}, c AS ({MARKS.format(tracks='tracks', numbers='range(8) n(i)')}) SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY ms, i) - 1 AS place, i AS cue, ms, ['CC0000', 'CC4400', 'CC8800', '88CC00', '00CC44', '00CCCC', '0044CC', '8800CC'][i + 1] AS color, concat('cue ', i) AS name FROM c")
def marker_codec(spark, sf):
    def one(r):
        cues = [{"index": i, "position_ms": (r.ord * 37 + i * 7919) % 180000, "name": f"cue {i}"} for i in range(8)]
        return ([(c["index"], c["position_ms"], f"{c['color']:06X}", c["name"]) for c in codecs.decode_markers(codecs.encode_markers(cues))["cues"]],)

    out = _round_trip(load(spark, sf, "tracks").select("track_id", "ord"), one, "track_id string, cues array<struct<cue:long,ms:long,color:string,name:string>>")
    return out.select("track_id", F.posexplode("cues").alias("place", "c")).select("track_id", F.col("place").cast("long").alias("place"), "c.*")


@query(f"WITH {duck('tracks')} SELECT track_id, 2::BIGINT AS frames, sha1(encode(title)) AS first, sha1(encode(artist)) AS second, true AS audio_kept FROM tracks")
def frame_codec(spark, sf):
    """Two frames injected one after the other into a file, read back, with the audio behind them unchanged."""
    from hashlib import sha1

    def one(r):
        file = codecs.inject_geob(codecs.inject_geob(b"\xff\xfbaudio", {"first": r.title.encode()}), {"second": r.artist.encode()})
        found = codecs.read_geob(file)
        return len(found), sha1(found["first"]).hexdigest(), sha1(found["second"]).hexdigest(), file.endswith(b"\xff\xfbaudio")

    return _round_trip(load(spark, sf, "tracks").select("track_id", "title", "artist"), one, "track_id string, frames long, first string, second string, audio_kept boolean")

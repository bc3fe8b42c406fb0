"""The registered queries: each applies an operator to a whole driver table, with SQL for DuckDB beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.functions import camelot, text, timeline
from setloom.functions import scoring as S
from setloom.operators import audio, dedupe, library, queueing, ranking, resync, series
from setloom.plans.fixtures import duck, load
from setloom.sources import catalog, files
from setloom.streaming import plays as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CURRENT, SESSION, NEEDLE, TEMPLATE = "t7", 1, "an", "{artist} - {title} [{camelot}] {key} {bpm} {year}"
NOW_MS = 1_800_000_000_000


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(c: Column, name: str) -> Column:
    # adding zero turns -0.0 into 0.0
    return (S.rounded(c, 6) + F.lit(0.0)).alias(name)


def lib(spark: SparkSession, sf: str) -> DataFrame:
    return library.analyzed(load(spark, sf, "tracks"), load(spark, sf, "analyses"))


LIB = f"WITH {duck('tracks', 'analyses')}, lib AS (SELECT t.*, a.* EXCLUDE (track_id) FROM tracks t LEFT JOIN analyses a USING (track_id))"

# ---- library -------------------------------------------------------------------------------------


@query(f"{LIB} SELECT track_id, title, artist, genre, bpm, camelot, quality, added_at FROM lib")
def library_listing(spark, sf):
    return library.listing(load(spark, sf, "tracks"), load(spark, sf, "analyses")).select("track_id", "title", "artist", "genre", "bpm", "camelot", "quality", "added_at")


@query(f"{LIB} SELECT track_id, title FROM lib WHERE contains(lower(title), '{NEEDLE}') OR contains(lower(artist), '{NEEDLE}') OR coalesce(contains(lower(album), '{NEEDLE}'), false) OR coalesce(contains(lower(genre), '{NEEDLE}'), false) OR coalesce(contains(lower(camelot), '{NEEDLE}'), false)")
def library_filter(spark, sf):
    return library.filtered(lib(spark, sf), f" {NEEDLE.upper()} ").select("track_id", "title")


@query(f"{LIB} SELECT track_id, coalesce(bpm, 0.0) AS bpm FROM lib ORDER BY bpm DESC, ord")
def library_sort_bpm(spark, sf):
    return library.sorted_by(lib(spark, sf), "bpm", True).select("track_id", F.coalesce("bpm", F.lit(0.0)).alias("bpm"))


@query(f"{LIB} SELECT track_id, title FROM lib ORDER BY title, ord")
def library_sort_title(spark, sf):
    return library.sorted_by(lib(spark, sf), "title").select("track_id", "title")


@query(f"{LIB} SELECT track_id, added_at FROM lib ORDER BY added_at DESC, ord")
def library_sort_added(spark, sf):
    return library.sorted_by(lib(spark, sf), "added_at", True).select("track_id", "added_at")


@query(f"{LIB} SELECT coalesce(quality, 'none') AS status, count(*) AS n FROM lib GROUP BY ALL")
def status_counts(spark, sf):
    return library.status_counts(lib(spark, sf))


INCOMING = "SELECT CASE WHEN ord % 5 = 0 THEN concat('/new', file_path) WHEN ord % 7 = 0 THEN concat(file_path, '.txt') WHEN ord % 11 = 0 THEN concat('/.cache', file_path) ELSE file_path END AS file_path FROM {tracks}"


@query(f"""WITH {duck('tracks')}, incoming AS ({INCOMING.format(tracks='tracks')})
SELECT i.file_path, CASE WHEN NOT regexp_matches(lower(i.file_path), '\\.(mp3|wav|flac|aiff|aif|m4a|aac|ogg|opus)$') OR regexp_matches(i.file_path, '(^|/)\\.[^/]') THEN 'ignored'
  WHEN t.file_path IS NOT NULL THEN 'skipped' ELSE 'added' END AS status FROM incoming i LEFT JOIN (SELECT DISTINCT file_path FROM tracks) t ON i.file_path = t.file_path""")
def import_anti_join(spark, sf):
    tracks = load(spark, sf, "tracks")
    return library.import_plan(spark.sql(INCOMING, tracks=tracks), tracks)


@query(f"WITH {duck('tracks', 'history')} SELECT track_id, artist, CASE WHEN track_id IN (SELECT track_id FROM history) THEN 'House' ELSE genre END AS genre FROM tracks")
def bulk_edit(spark, sf):
    return library.bulk_edit(load(spark, sf, "tracks"), load(spark, sf, "history"), {"genre": " House ", "artist": " "}).select("track_id", "artist", "genre")


@query(f"WITH {duck('tracks', 'analyses')} SELECT track_id, file_path FROM tracks WHERE track_id NOT IN (SELECT track_id FROM analyses WHERE quality = 'good') AND file_path NOT LIKE '/%'")
def orphan_tracks(spark, sf):
    files = load(spark, sf, "analyses").where("quality = 'good'").select("track_id")
    return library.orphans(load(spark, sf, "tracks"), files).select("track_id", "file_path")


@query("SELECT doc_id, sha1(encode(text)[1:262144]) AS content_id, substr(sha1(encode(text)[1:262144]), 1, 16) AS file_hash FROM documents")
def content_id(spark, sf):
    sha = library.content_id(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", sha.alias("content_id"), F.left(sha, F.lit(16)).alias("file_hash"))


@query(f"{LIB} SELECT track_id, concat((floor(duration_sec)::BIGINT // 60)::VARCHAR, ':', lpad((floor(duration_sec)::BIGINT % 60)::VARCHAR, 2, '0')) AS length, floor(energy_mean * 10 + 0.5)::BIGINT AS energy, concat((({NOW_MS} - added_at) // 86400000)::VARCHAR, 'd') AS age, regexp_extract(file_path, '([^/]*/[^/]*)$', 1) AS short_path FROM lib")
def display_columns(spark, sf):
    return lib(spark, sf).select("track_id", text.minutes(F.col("duration_sec")).alias("length"), timeline.js_round(F.col("energy_mean") * 10).alias("energy"), text.age(F.col("added_at"), F.lit(NOW_MS)).alias("age"), text.short_path(F.col("file_path")).alias("short_path"))


# ---- duplicates and names ------------------------------------------------------------------------

EXACT = "exact AS (SELECT track_id, file_hash, count(*) OVER (PARTITION BY file_hash) AS n FROM tracks WHERE coalesce(file_hash, '') <> '')"


@query(f"WITH {duck('tracks')}, {EXACT} SELECT track_id, file_hash, n, concat('identical file hash (', left(file_hash, 10), '…)') AS reason FROM exact WHERE n >= 2")
def exact_duplicates(spark, sf):
    return dedupe.exact_duplicates(load(spark, sf, "tracks"))


#: Titles of few words repeat, as a library's do: the first word of the name for the title.
TWINS = "SELECT track_id, file_hash, regexp_extract(title, '^([^ ]+)', 1) AS title, artist, duration_sec FROM {tracks}"


@query(f"""WITH RECURSIVE {duck('tracks')}, {EXACT}, twins AS ({TWINS.format(tracks='tracks')}),
keyed AS (SELECT track_id, duration_sec, concat(trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')), '|', trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) AS key
  FROM twins WHERE track_id NOT IN (SELECT track_id FROM exact WHERE n >= 2)),
d AS (SELECT key, duration_sec, row_number() OVER (PARTITION BY key ORDER BY duration_sec) AS i FROM (SELECT DISTINCT key, duration_sec FROM keyed)),
walk AS (SELECT key, duration_sec, i, duration_sec AS anchor FROM d WHERE i = 1
  UNION ALL SELECT d.key, d.duration_sec, d.i, CASE WHEN d.duration_sec - w.anchor > 2 THEN d.duration_sec ELSE w.anchor END FROM walk w JOIN d ON d.key = w.key AND d.i = w.i + 1),
placed AS (SELECT k.track_id, k.key, w.anchor, count(*) OVER (PARTITION BY k.key, w.anchor) AS n FROM keyed k JOIN walk w ON k.key = w.key AND k.duration_sec = w.duration_sec)
SELECT track_id, key, anchor, n, concat('same title & artist (', left(key, 40), '), duration within 2s') AS reason FROM placed WHERE n >= 2""")
def probable_duplicates(spark, sf):
    return dedupe.probable_duplicates(spark.sql(TWINS, tracks=load(spark, sf, "tracks")))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '\\(.*?\\)|\\[.*?\\]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def normalize_key(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.match_text(F.col("text")).alias("key"))


@query("""SELECT doc_id, concat('track:', trim(regexp_replace(regexp_replace(regexp_replace(text, '\\(.*?\\)|\\[.*?\\]', '', 'g'), '\\s+-\\s+.*', '', 'g'), '(?i)\\s+feat\\..*', '', 'g')), ' artist:', source) AS query FROM documents""")
def search_query_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.search_query(F.col("text"), F.col("source")).alias("query"))


HITS = """SELECT track_id, 1 AS rank, concat('c', track_id, '-1') AS hit_id, concat(title, ' (Remastered)') AS hit_title, artist AS hit_artist, duration_sec + 5 AS hit_seconds FROM {tracks} WHERE ord % 4 <> 0
UNION ALL SELECT track_id, 2, concat('c', track_id, '-2'), regexp_extract(title, '^([^ ]+ [^ ]+)', 1), CASE WHEN ord % 3 = 0 THEN 'Somebody' ELSE artist END, duration_sec FROM {tracks}"""
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '\\(.*?\\)|\\[.*?\\]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
WORDS = "list_distinct(list_filter(string_split(" + NORM + ", ' '), lambda w: w <> ''))"
OVERLAP = "len(list_intersect(" + WORDS + ", " + WORDS.replace("{0}", "{1}") + "))::DOUBLE / greatest(len(" + WORDS + "), len(" + WORDS.replace("{0}", "{1}") + "))"


@query(f"""WITH {duck('tracks')}, hits AS ({HITS.format(tracks='tracks')}),
scored AS (SELECT t.track_id, rank, hit_id, round(0.6 * {OVERLAP.format('title', 'hit_title')} + 0.3 * {OVERLAP.format('artist', 'hit_artist')} + 0.1 * greatest(0.0, 1 - abs(hit_seconds - duration_sec) / 10), 9) AS score FROM tracks t JOIN hits h ON t.track_id = h.track_id),
best AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, rank) AS k FROM scored)
SELECT track_id, hit_id, round(score, 6) AS score FROM best WHERE k = 1 AND score >= 0.55""")
def catalog_match(spark, sf):
    tracks = load(spark, sf, "tracks")
    hits = spark.sql(HITS, tracks=tracks).withColumn("hit_artists", F.array("hit_artist")).drop("hit_artist")
    return catalog.best_hits(tracks, hits).select("track_id", "hit_id", r6(F.col("score"), "score"))


FEATURES = "SELECT track_id, CAST(90 + ord % 60 AS DOUBLE) AS f_bpm, '8A' AS f_camelot, CAST(ord % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS f_energy, CAST(-ord % 30 AS DOUBLE) AS f_loudness, duration_sec FROM {tracks} WHERE ord % 3 = 0"
ANALYSED = "SELECT *, energy_mean * CAST(0.5 AS DOUBLE) AS energy_peak, CAST(4 AS DOUBLE) AS mix_in FROM {analyses}"


@query(f"""WITH {duck('tracks', 'analyses')}, f AS ({FEATURES.format(tracks='tracks')}), a AS ({ANALYSED.format(analyses='analyses')})
SELECT coalesce(a.track_id, f.track_id) AS track_id, coalesce(f_bpm, bpm) AS bpm, coalesce(f_camelot, camelot) AS camelot, round(coalesce(f_energy, energy_mean), 6) AS energy_mean,
  CASE WHEN f_bpm IS NOT NULL THEN 0.95 ELSE bpm_confidence END::DOUBLE AS bpm_confidence, CASE WHEN f_bpm IS NOT NULL THEN 0.9 ELSE key_confidence END::DOUBLE AS key_confidence, CASE WHEN f_bpm IS NOT NULL THEN 'good' ELSE quality END AS quality,
  CASE WHEN a.track_id IS NULL THEN 0.0 ELSE first_beat END::DOUBLE AS first_beat, f_loudness AS rms_db, round(CASE WHEN a.track_id IS NULL THEN least(1.0, 1.2 * f_energy) ELSE energy_peak END, 6)::DOUBLE AS energy_peak,
  CASE WHEN a.track_id IS NULL THEN least(8.0, duration_sec) ELSE mix_in END::DOUBLE AS mix_in, CASE WHEN a.track_id IS NULL THEN greatest(0.0, duration_sec - 16) END::DOUBLE AS mix_out, CASE WHEN f_bpm IS NOT NULL THEN 'catalog' ELSE 'audio' END AS origin
FROM a FULL JOIN f ON a.track_id = f.track_id""")
def catalog_merge(spark, sf):
    analyses = spark.sql(ANALYSED, analyses=load(spark, sf, "analyses"))
    out = catalog.merged(analyses, spark.sql(FEATURES, tracks=load(spark, sf, "tracks")))
    return out.select("track_id", "bpm", "camelot", r6(F.col("energy_mean"), "energy_mean"), "bpm_confidence", "key_confidence", "quality", "first_beat", "rms_db", r6(F.col("energy_peak"), "energy_peak"), "mix_in", "mix_out", "origin")


BASE = "trim(regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1'))"
NAMED = """named AS (SELECT *, CASE WHEN b1 BETWEEN 60 AND 200 THEN b1 WHEN b2 BETWEEN 60 AND 200 THEN b2 WHEN b3 BETWEEN 60 AND 200 THEN b3 END AS n_bpm,
  CASE WHEN b1 BETWEEN 60 AND 200 THEN 'bpm-suffix' WHEN b2 BETWEEN 60 AND 200 THEN 'bracket' WHEN b3 BETWEEN 60 AND 200 THEN 'trailing' END AS n_source,
  CASE WHEN b1 BETWEEN 60 AND 200 THEN 1.0::DOUBLE WHEN b2 BETWEEN 60 AND 200 THEN 0.95::DOUBLE WHEN b3 BETWEEN 60 AND 200 THEN 0.9::DOUBLE END AS n_conf
 FROM (SELECT *, TRY_CAST(regexp_extract(base, '(?i)(^|[^0-9.])([0-9]{2,3})\\s*bpm\\b', 2) AS INTEGER) AS b1, TRY_CAST(regexp_extract(base, '[\\[(]([0-9]{2,3})[\\])]\\s*$', 1) AS INTEGER) AS b2,
   TRY_CAST(regexp_extract(base, '\\s([0-9]{2,3})\\s*$', 1) AS INTEGER) AS b3 FROM (SELECT *, BASE AS base FROM SOURCE)))"""


@query(f"WITH {duck('tracks')}, {NAMED.replace('BASE', BASE.format('file_path')).replace('SOURCE', 'tracks')} SELECT track_id, n_bpm AS bpm, n_source AS source, n_conf AS confidence FROM named")
def bpm_from_name(spark, sf):
    named = text.bpm_from_name(F.col("file_path"))
    return load(spark, sf, "tracks").select("track_id", named["bpm"].alias("bpm"), named["source"].alias("source"), named["confidence"].alias("confidence"))


RECONCILED = """CASE WHEN n_bpm IS NULL THEN bpm_confidence WHEN abs(bpm / n_bpm - 1) <= 0.04 OR abs(bpm / n_bpm - 2) <= 0.08 OR abs(bpm / n_bpm - 0.5) <= 0.02 OR abs(bpm / n_bpm - 1.5) <= 0.06
  OR abs(bpm / n_bpm - 2.0::DOUBLE / 3.0::DOUBLE) <= 0.04 * 2.0::DOUBLE / 3.0::DOUBLE THEN greatest(n_conf, bpm_confidence) ELSE n_conf * 0.7 END"""


@query(f"{LIB}, {NAMED.replace('BASE', BASE.format('file_path')).replace('SOURCE', 'lib')} SELECT track_id, coalesce(n_bpm::DOUBLE, bpm) AS bpm, round({RECONCILED}, 6) AS confidence, CASE WHEN n_bpm IS NULL THEN 'audio' ELSE 'name' END AS source FROM named WHERE bpm IS NOT NULL")
def reconcile_bpm(spark, sf):
    out = text.reconciled(text.bpm_from_name(F.col("file_path")), F.col("bpm"), F.col("bpm_confidence"))
    return lib(spark, sf).where("bpm is not null").select("track_id", out["bpm"].alias("bpm"), r6(out["confidence"], "confidence"), out["source"].alias("source"))


@query(f"{LIB}, {NAMED.replace('BASE', BASE.format('concat(file_path, chr(32), title)')).replace('SOURCE', 'lib')} SELECT track_id, n_bpm::DOUBLE AS bpm, CASE WHEN quality = 'unreliable' THEN 'partial' ELSE quality END AS quality FROM named WHERE bpm IS NOT NULL AND n_bpm IS NOT NULL AND abs(n_bpm - bpm) >= 0.75")
def resync_from_name(spark, sf):
    hint = text.bpm_from_name(F.concat_ws(" ", "file_path", "title"))
    rows = lib(spark, sf).withColumn("named", hint).where("bpm is not null and named is not null").where(F.abs(F.col("named.bpm") - F.col("bpm")) >= 0.75)
    return rows.select("track_id", F.col("named.bpm").cast("double").alias("bpm"), F.when(F.col("quality") == "unreliable", "partial").otherwise(F.col("quality")).alias("quality"))


SHORT = "CASE camelot " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(camelot.SHORT_KEYS.items())) + " ELSE '' END"
CLEAN = "trim(regexp_replace(regexp_replace({0}, '[/\\\\:*?\"<>|]', '_', 'g'), '\\s+', ' ', 'g'))"
COLLAPSE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '\\s*[-_·]\\s*[-_·]', ' -', 'g'), '\\[\\s*\\]', '', 'g'), '\\(\\s*\\)', '', 'g'), '\\s{{2,}}', ' ', 'g'), '\\s+([)\\]}}])', '\\1', 'g'), '([(\\[{{])\\s+', '\\1', 'g'))"


@query(f"""{LIB}, r AS (SELECT *, concat({CLEAN.format('artist')}, ' - ', {CLEAN.format('title')}, ' [', coalesce(camelot, ''), '] ', {SHORT}, ' ', coalesce(floor(bpm + 0.5)::BIGINT::VARCHAR, ''), ' ') AS n, regexp_extract(file_path, '([^/]*)$', 1) AS old FROM lib),
c AS (SELECT *, {COLLAPSE.format('n')} AS clean FROM r)
SELECT track_id, CASE WHEN clean = '' THEN old ELSE concat(clean, regexp_extract(old, '^.+?((\\.[^.]*)?)$', 1)) END AS new_name, CASE WHEN clean = '' THEN false ELSE concat(clean, regexp_extract(old, '^.+?((\\.[^.]*)?)$', 1)) <> old END AS changed FROM c""")
def rename_preview(spark, sf):
    rows = lib(spark, sf)
    name = text.new_name(F.col("file_path"), text.rendered(TEMPLATE, {c: F.col(c) for c in ("artist", "title", "genre", "bpm", "camelot")}))
    return rows.select("track_id", name.alias("new_name"), (name != text.basename(F.col("file_path"))).alias("changed"))


@query(f"{LIB} SELECT track_id, camelot, {SHORT} AS key_text FROM lib")
def camelot_key_text(spark, sf):
    return lib(spark, sf).select("track_id", "camelot", camelot.key_text(F.col("camelot")).alias("key_text"))


@query("SELECT page_id, CASE WHEN starts_with(u, 'spotify:track:') THEN u WHEN regexp_matches(u, 'open\\.spotify\\.com/(?:intl-\\w+/)?track/[a-zA-Z0-9]+') THEN concat('spotify:track:', regexp_extract(u, 'open\\.spotify\\.com/(?:intl-\\w+/)?track/([a-zA-Z0-9]+)', 1)) WHEN regexp_matches(u, '^[a-zA-Z0-9]{22}$') THEN concat('spotify:track:', u) END AS uri FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://open.spotify.com/intl-de/track/', md5(url)) WHEN 1 THEN left(md5(url), 22) WHEN 2 THEN concat('spotify:track:', page_id) ELSE url END AS u FROM pages)")
def uri_normalize(spark, sf):
    digest = F.md5(F.col("url").cast("binary"))
    kind = F.col("page_id") % 4
    made = F.when(kind == 0, F.concat(F.lit("https://open.spotify.com/intl-de/track/"), digest)).when(kind == 1, F.left(digest, F.lit(22))).when(kind == 2, F.concat(F.lit("spotify:track:"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return load(spark, sf, "pages").select("page_id", text.track_uri(made).alias("uri"))


# ---- scoring and ranking -------------------------------------------------------------------------

COMPAT = "CASE WHEN {0} = {1} THEN 1.0 WHEN right({0}, 1) = right({1}, 1) AND least(abs({0}[:-2]::INT - {1}[:-2]::INT), 12 - abs({0}[:-2]::INT - {1}[:-2]::INT)) = 1 THEN 0.9 WHEN {0}[:-2]::INT = {1}[:-2]::INT THEN 0.85 ELSE 0.25 END::DOUBLE"


@query(f"WITH k AS (SELECT concat(n, l) AS c FROM range(1, 13) t(n), (VALUES ('A'), ('B')) v(l)) SELECT a.c AS a, b.c AS b, {COMPAT.format('a.c', 'b.c')} AS score FROM k a, k b")
def key_compatibility_matrix(spark, sf):
    codes = spark.range(1, 13).select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("l"), "id").select(F.concat("id", "l").alias("c"))
    pairs = codes.select(F.col("c").alias("a")).crossJoin(F.broadcast(codes.select(F.col("c").alias("b"))))
    return pairs.select("a", "b", camelot.compatibility(F.col("a"), F.col("b")).alias("score"))


def bpm_sql(a: str, b: str) -> str:
    bell = lambda x: f"exp(-((({x}) - coalesce({a}, 120.0)) ** 2) / 18.0)"
    return f"greatest({bell(f'coalesce({b}, 120.0)')}, {bell(f'coalesce({b}, 120.0) * 2')}, {bell(f'coalesce({b}, 120.0) / 2')})"


def parts_sql(a: str, b: str, same_artist: str, same_genre: str, recency: str) -> dict[str, str]:
    return {
        "bpm": bpm_sql(f"{a}bpm", f"{b}bpm"),
        "key": f"CASE WHEN {a}camelot IS NULL OR {b}camelot IS NULL OR {a}key_confidence < 0.3 OR {b}key_confidence < 0.3 THEN 0.5 ELSE {COMPAT.format(f'{a}camelot', f'{b}camelot')} END::DOUBLE",
        "energy": f"greatest(0.0, 1 - abs(coalesce({b}energy_mean, 0.5) - 0.5) * 1.5)::DOUBLE",
        "variety": f"greatest(0.0, 1 - 0.3 * ({same_artist}) - 0.1 * ({same_genre}))::DOUBLE",
        "quality": f"CASE {b}quality WHEN 'good' THEN 1.0 WHEN 'partial' THEN 0.6 WHEN 'unreliable' THEN 0.3 ELSE 0.0 END::DOUBLE",
        "recency": f"({recency})::DOUBLE",
    }


TOTAL = "round(0.35::DOUBLE * p_bpm + 0.2::DOUBLE * p_key + 0.2::DOUBLE * p_energy + 0.1::DOUBLE * p_variety + 0.1::DOUBLE * p_quality - 0.5::DOUBLE * p_recency, 9)"


@query(f"{LIB} SELECT l.track_id, round({bpm_sql('c.bpm', 'l.bpm')}, 6) AS score FROM lib l, (SELECT bpm FROM lib WHERE track_id = '{CURRENT}') c")
def bpm_score_pairs(spark, sf):
    rows = lib(spark, sf)
    current = rows.where(F.col("track_id") == CURRENT).select(F.col("bpm").alias("cur"))
    return rows.crossJoin(F.broadcast(current)).select("track_id", r6(S.bpm_score(F.col("cur"), F.col("bpm")), "score"))


def session_rows(spark: SparkSession, sf: str, session: int = SESSION) -> DataFrame:
    """All candidates scored after CURRENT with one session's plays as history."""
    rows = lib(spark, sf)
    plays = load(spark, sf, "history").where(F.col("session_id") == session)
    tracks = load(spark, sf, "tracks")
    past = plays.join(tracks.select("track_id", "artist", "genre"), "track_id")
    return ranking.scored(rows, ranking.current_row(rows, CURRENT, past), ranking.distances(plays, tracks))


SESSION_SQL = f"""{LIB}, {duck('history')}, past AS (SELECT h.pos, l.track_id, l.artist, l.genre, row_number() OVER (ORDER BY h.pos DESC) - 1 AS back FROM history h JOIN lib l USING (track_id) WHERE session_id = {SESSION}),
far AS (SELECT track_id, min(back) AS distance FROM past GROUP BY ALL),
parts AS (SELECT b.track_id, b.ord, b.bpm, a.bpm AS cur_bpm, {', '.join(f'{v} AS p_{k}' for k, v in parts_sql('a.', 'b.', "SELECT count(*) FROM past p WHERE back < 5 AND p.artist = b.artist", "SELECT count(*) FROM past p WHERE back < 5 AND coalesce(p.genre, '') <> '' AND p.genre = b.genre", "CASE WHEN distance < 20 THEN 1.0 WHEN distance < 50 THEN 0.3 ELSE 0.0 END").items())}
  FROM lib b LEFT JOIN far USING (track_id), (SELECT * FROM lib WHERE track_id = '{CURRENT}') a WHERE b.track_id <> '{CURRENT}'),
scored AS (SELECT *, {TOTAL} AS score FROM parts)"""


@query(f"{SESSION_SQL} SELECT track_id, round(score, 6) AS score, {', '.join(f'round(p_{k}, 6) AS {k}' for k in ranking.PARTS)} FROM scored ORDER BY scored.score DESC, ord LIMIT 10")
def rank_candidates(spark, sf):
    return ranking.top(session_rows(spark, sf), 10).select("track_id", r6(F.col("score"), "score"), *[r6(F.col(f"part_{k}"), k) for k in ranking.PARTS])


@query(f"{SESSION_SQL} SELECT track_id, round(score, 6) AS score FROM scored")
def score_library(spark, sf):
    return session_rows(spark, sf).select("track_id", r6(F.col("score"), "score"))


@query(f"""{SESSION_SQL}, tiers AS (SELECT *, row_number() OVER (ORDER BY p_recency < 1 DESC, score DESC, ord) AS u, row_number() OVER (ORDER BY p_recency < 1 AND abs(coalesce(bpm, 120) - coalesce(cur_bpm, 120)) < 12 DESC, score DESC, ord) AS c, row_number() OVER (ORDER BY score DESC, ord) AS f FROM scored),
pick AS (SELECT 'normal' AS mode, * FROM tiers WHERE u = 1 AND p_recency < 1 AND score >= 0.55 UNION ALL SELECT 'relaxed-bpm', * FROM tiers WHERE c = 1 AND p_recency < 1 AND abs(coalesce(bpm, 120) - coalesce(cur_bpm, 120)) < 12 UNION ALL SELECT 'forced', * FROM tiers WHERE f = 1)
SELECT mode, track_id, round(score, 6) AS score FROM pick ORDER BY CASE mode WHEN 'normal' THEN 0 WHEN 'relaxed-bpm' THEN 1 ELSE 2 END LIMIT 1""")
def pick_next_tiers(spark, sf):
    return ranking.pick_next(session_rows(spark, sf)).select("mode", "track_id", r6(F.col("score"), "score"))


@query(f"""{LIB}, {duck('history')}, past AS (SELECT session_id, track_id, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) - 1 AS back FROM history JOIN (SELECT track_id FROM lib) USING (track_id))
SELECT session_id, track_id, min(back) AS distance, CASE WHEN min(back) < 20 THEN 1.0 WHEN min(back) < 50 THEN 0.3 ELSE 0.0 END::DOUBLE AS penalty FROM past GROUP BY session_id, track_id""")
def recency_penalty(spark, sf):
    out = ranking.distances(load(spark, sf, "history"), load(spark, sf, "tracks"))
    return out.select("session_id", "track_id", F.col("distance").cast("long").alias("distance"), S.recency_penalty(F.col("distance")).alias("penalty"))


@query(f"""WITH {duck('tracks', 'history')}, past AS (SELECT session_id, t.artist, t.genre, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS back FROM history h JOIN tracks t USING (track_id)),
cur AS (SELECT artist, genre FROM tracks WHERE track_id = '{CURRENT}')
SELECT session_id, round(greatest(0.0, 1 - 0.3 * count(*) FILTER (back <= 5 AND past.artist = cur.artist) - 0.1 * count(*) FILTER (back <= 5 AND coalesce(past.genre, '') <> '' AND past.genre = cur.genre))::DOUBLE, 6) AS variety FROM past, cur GROUP BY session_id""")
def variety_score(spark, sf):
    tracks = load(spark, sf, "tracks")
    context = ranking.recent_context(load(spark, sf, "history"), tracks)
    current = tracks.where(F.col("track_id") == CURRENT).select("artist", "genre")
    same = ranking.same_counts(F.col("last5"), F.col("artist"), F.col("genre"))
    return context.crossJoin(F.broadcast(current)).select("session_id", r6(S.variety_score(*same), "variety"))


@query(f"""{LIB}, {duck('queue')}, q AS (SELECT * FROM queue WHERE queue_id = (SELECT min(queue_id) FROM queue)),
past AS (SELECT q.pos, l.track_id, l.artist, l.genre, row_number() OVER (ORDER BY q.pos DESC) - 1 AS back FROM q JOIN lib l USING (track_id)), far AS (SELECT track_id, min(back) AS distance FROM past GROUP BY ALL),
cur AS (SELECT l.* FROM lib l JOIN past p USING (track_id) WHERE back = 0),
parts AS (SELECT b.track_id, b.ord, {', '.join(f'{v} AS p_{k}' for k, v in parts_sql('a.', 'b.', "SELECT count(*) FROM past p WHERE back < 5 AND p.artist = b.artist", "SELECT count(*) FROM past p WHERE back < 5 AND coalesce(p.genre, '') <> '' AND p.genre = b.genre", "0.0").items())}
  FROM lib b, cur a WHERE b.quality IS NOT NULL AND b.track_id NOT IN (SELECT track_id FROM q)), scored AS (SELECT *, {TOTAL} AS score FROM parts)
SELECT track_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, ord LIMIT 8""")
def suggestions(spark, sf):
    rows, queue = lib(spark, sf), load(spark, sf, "queue")
    first = queue.agg(F.min("queue_id").alias("queue_id"))
    mine = queue.join(F.broadcast(first), "queue_id")
    past = mine.join(rows.select("track_id", "artist", "genre"), "track_id")
    last = past.agg(F.max_by("track_id", "pos").alias("track_id"))
    current = rows.join(F.broadcast(last), "track_id").select(F.col("track_id").alias("cur_id"), F.col("bpm").alias("cur_bpm"), F.col("camelot").alias("cur_camelot"), F.col("key_confidence").alias("cur_key_confidence"))
    five = past.orderBy(F.desc("pos")).limit(5).agg(F.collect_list(F.struct("artist", "genre")).alias("last5"))
    pool = rows.where("quality is not null").join(mine.select("track_id"), "track_id", "left_anti")
    return ranking.top(ranking.scored(pool, current.crossJoin(F.broadcast(five)), None), 8).select("track_id", r6(F.col("score"), "score"))


@query(f"""{LIB}, {duck('queue')}, s AS (SELECT q.queue_id, q.pos, l.*, lag(l.track_id) OVER w AS a_id, lag(l.bpm) OVER w AS a_bpm, lag(l.camelot) OVER w AS a_camelot, lag(l.key_confidence) OVER w AS a_key_confidence, lag(l.quality) OVER w AS a_quality FROM queue q JOIN lib l USING (track_id) WINDOW w AS (PARTITION BY q.queue_id ORDER BY q.pos)),
parts AS (SELECT s.*, {', '.join(f'{v} AS p_{k}' for k, v in parts_sql('s.a_', 's.', '0', '0', '0.0').items())} FROM s)
SELECT queue_id, pos, track_id, CASE WHEN a_quality IS NOT NULL AND quality IS NOT NULL THEN round(least(greatest({TOTAL} / 0.95, 0.0), 1.0), 6) END AS match FROM parts""")
def queue_match_score(spark, sf):
    return ranking.queue_scores(load(spark, sf, "queue"), lib(spark, sf)).select("queue_id", "pos", "track_id", r6(F.col("match"), "match"))


PAIRS_SQL = f"""{LIB}, {duck('queue')}, firsts AS (SELECT queue_id, track_id, min(pos) AS seen FROM queue GROUP BY ALL), d AS (SELECT queue_id, track_id, row_number() OVER (PARTITION BY queue_id ORDER BY seen) - 1 AS pos FROM firsts),
m AS (SELECT d.queue_id, d.pos, l.* FROM d JOIN lib l USING (track_id) WHERE l.quality IS NOT NULL),
parts AS (SELECT a.queue_id, a.track_id AS a, b.track_id AS b, a.pos AS a_pos, b.pos AS b_pos, {', '.join(f'{v} AS p_{k}' for k, v in parts_sql('a.', 'b.', 'CASE WHEN a.artist = b.artist THEN 1 ELSE 0 END', "CASE WHEN coalesce(a.genre, '') <> '' AND a.genre = b.genre THEN 1 ELSE 0 END", '0.0').items())} FROM m a JOIN m b ON a.queue_id = b.queue_id AND a.pos <> b.pos),
pairs AS (SELECT *, {TOTAL} AS score FROM parts), hubs AS (SELECT queue_id, a, a_pos, round(avg(score), 9) AS mean FROM pairs GROUP BY queue_id, a, a_pos),
hub AS (SELECT queue_id, a AS track_id, mean FROM hubs QUALIFY row_number() OVER (PARTITION BY queue_id ORDER BY mean DESC, a_pos) = 1)"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    return queueing.deduped(load(spark, sf, "queue")).join(lib(spark, sf).where("quality is not null"), "track_id")


@query(f"{PAIRS_SQL} SELECT queue_id, track_id, round(mean, 6) AS mean FROM hub")
def hub_seed(spark, sf):
    return ranking.hub_seed(members(spark, sf), "queue_id").select("queue_id", "track_id", r6(F.col("mean"), "mean"))


@query(f"""{PAIRS_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, ways AS MATERIALIZED (SELECT queue_id, a, list({{'b': b, 's': score}} ORDER BY score DESC, b_pos) AS nexts FROM pairs GROUP BY ALL),
walk AS (SELECT queue_id, track_id AS here, [track_id] AS done, 0 AS place FROM hub
 UNION ALL SELECT queue_id, nb, list_append(done, nb), place + 1 FROM (SELECT w.queue_id, w.done, w.place, list_filter(y.nexts, lambda x: NOT list_contains(w.done, x.b))[1].b AS nb FROM walk w JOIN ways y ON y.queue_id = w.queue_id AND y.a = w.here) WHERE nb IS NOT NULL)
SELECT queue_id, place, here AS track_id FROM walk UNION ALL SELECT queue_id, 0, track_id FROM m QUALIFY count(*) OVER (PARTITION BY queue_id) = 1""")
def smart_reorder(spark, sf):
    return ranking.smart_reorder(members(spark, sf), "queue_id")


# ---- queues and playlists ------------------------------------------------------------------------

QUEUE_SQL = f"WITH {duck('queue')}, firsts AS (SELECT queue_id, track_id, min(pos) AS seen FROM queue GROUP BY ALL), d AS (SELECT queue_id, track_id, row_number() OVER (PARTITION BY queue_id ORDER BY seen) - 1 AS pos FROM firsts)"


@query(f"{QUEUE_SQL} SELECT queue_id, pos, track_id FROM d")
def queue_dedupe(spark, sf):
    return queueing.deduped(load(spark, sf, "queue"))


@query(f"{QUEUE_SQL}, {duck('history')} SELECT queue_id, arg_min(track_id, pos) AS track_id, min(pos) AS pos FROM d WHERE track_id NOT IN (SELECT track_id FROM history) GROUP BY queue_id")
def queue_next_unplayed(spark, sf):
    return queueing.next_unplayed(queueing.deduped(load(spark, sf, "queue")), load(spark, sf, "history"))


@query(f"{QUEUE_SQL} SELECT queue_id, CASE WHEN n <= 2 THEN pos WHEN pos = 0 THEN 2 WHEN pos <= 2 THEN pos - 1 ELSE pos END AS pos, track_id FROM (SELECT *, count(*) OVER (PARTITION BY queue_id) AS n FROM d)")
def queue_move(spark, sf):
    return queueing.moved(queueing.deduped(load(spark, sf, "queue")), 0, 2)


@query(f"{QUEUE_SQL}, {duck('tracks')} SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY pos) - 1 AS pos, track_id FROM d WHERE track_id IN (SELECT track_id FROM tracks WHERE genre IS NOT NULL)")
def playlist_load(spark, sf):
    saved = library.saved_playlist(queueing.deduped(load(spark, sf, "queue")), "queue_id")
    return library.loaded_playlist(saved, load(spark, sf, "tracks").where("genre is not null"), "queue_id")


# ---- series --------------------------------------------------------------------------------------

H = f"WITH {duck('history')}"


def plays(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "history")


@query(f"{H} SELECT session_id, pos, round(coalesce(greatest(0.0, value - lag(value) OVER (PARTITION BY session_id ORDER BY pos)), 0.0), 6) AS onset FROM history")
def onset_envelope(spark, sf):
    return series.onsets(plays(spark, sf), "session_id").select("session_id", "pos", r6(F.col("onset"), "onset"))


@query(f"{H} SELECT session_id, pos, round(greatest(0.0, value - avg(value) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING)), 6) AS above FROM history")
def local_mean_normalize(spark, sf):
    return series.above_local_mean(plays(spark, sf), "session_id", 16).select("session_id", "pos", r6(F.col("above"), "above"))


@query(f"{H} SELECT session_id, pos, value FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM history WINDOW w AS (PARTITION BY session_id ORDER BY pos)) WHERE value > a AND value > b")
def local_peaks(spark, sf):
    return series.local_peaks(plays(spark, sf), "session_id").select("session_id", "pos", "value")


ACF = "acf AS (SELECT session_id, k AS lag, coalesce((SELECT avg(a.value * b.value) FROM history a JOIN history b ON b.session_id = a.session_id AND b.pos = a.pos + k WHERE a.session_id = s.session_id), 0.0) AS acf FROM (SELECT DISTINCT session_id FROM history) s, range({0}, {1}) r(k))"


@query(f"{H}, {ACF.format(1, 9)} SELECT session_id, lag, round(acf, 6) AS acf FROM acf")
def autocorrelation(spark, sf):
    return series.autocorrelation(plays(spark, sf), "session_id", 1, 8).select("session_id", F.col("lag").cast("long").alias("lag"), r6(F.col("acf"), "acf"))


@query(f"""{H}, {ACF.format(2, 9)}, a AS (SELECT session_id, lag, acf, (SELECT acf FROM acf y WHERE y.session_id = x.session_id AND y.lag = x.lag * 2) AS a2, (SELECT acf FROM acf y WHERE y.session_id = x.session_id AND y.lag = x.lag * 3) AS a3,
 (SELECT acf FROM acf y WHERE y.session_id = x.session_id AND y.lag = x.lag * 4) AS a4, (SELECT acf FROM acf y WHERE y.session_id = x.session_id AND y.lag = floor(x.lag / 2.0 + 0.5)) AS ah FROM acf x)
SELECT session_id, lag, 480.0::DOUBLE / lag AS bpm, round((acf + 0.5 * coalesce(a2, 0) + 0.33 * coalesce(a3, 0) + 0.25 * coalesce(a4, 0)) / CASE WHEN floor(lag / 2.0 + 0.5) >= 2 THEN 1 + 1.6 * greatest(0.0, ah / greatest(1e-9, acf)) ELSE 1 END * (0.75 + 0.25 * exp(-(ln(480.0 / lag / 125.0) ** 2) / (2 * 0.35 * 0.35))), 6) AS score FROM a""")
def acf_tempo_score(spark, sf):
    out = series.tempo_scores(plays(spark, sf), "session_id", 8.0, 2, 8)
    return out.select("session_id", F.col("lag").cast("long").alias("lag"), "bpm", r6(F.col("score"), "score"))


@query(f"{H} SELECT session_id, value AS median FROM (SELECT session_id, value, row_number() OVER (PARTITION BY session_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS n FROM history) WHERE r = n // 2")
def upper_median(spark, sf):
    return series.upper_median(plays(spark, sf), "session_id")


@query(f"{H}, g AS (SELECT session_id, pos * 0.5 + value / 1000 AS beat FROM history), d AS (SELECT *, beat - lag(beat) OVER (PARTITION BY session_id ORDER BY beat) AS gap FROM g) SELECT session_id, count(*) AS beats, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap) / avg(gap), 6) AS variation, coalesce(count(*) >= 8 AND stddev_pop(gap) / avg(gap) < 0.05, false) AS is_stable FROM d GROUP BY session_id")
def beat_stability(spark, sf):
    beats = plays(spark, sf).withColumn("beat", F.col("pos") * 0.5 + F.col("value") / 1000)
    return series.stability(beats, "session_id").select("session_id", "beats", r6(F.col("mean_gap"), "mean_gap"), r6(F.col("variation"), "variation"), "is_stable")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / greatest(1, len(embedding))), 6) AS rms, round(20 * log10(greatest(1e-9, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / greatest(1, len(embedding))))), 6) AS db FROM embeddings")
def frame_rms(spark, sf):
    rms = series.frame_rms(F.col("embedding"))
    return load(spark, sf, "embeddings").select("vec_id", r6(rms, "rms"), r6(timeline.decibels(rms), "db"))


@query("WITH p AS (SELECT vec_id, b, max(abs(embedding[b * 8 + j + 1]::DOUBLE)) AS m FROM embeddings, range(8) t(b), range(8) u(j) GROUP BY ALL) SELECT vec_id, b AS bin, round(m / max(m) OVER (PARTITION BY vec_id), 6) AS peak FROM p")
def peaks_norm(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", F.posexplode(series.block_peaks(F.col("embedding"), 8)).alias("bin", "peak")).select("vec_id", F.col("bin").cast("long").alias("bin"), r6(F.col("peak"), "peak"))


@query(f"{H}, b AS (SELECT session_id, pos // 4 AS bar, least(1.0, 2 * sqrt(avg(value * value / 1e6))) AS level FROM history GROUP BY ALL HAVING count(*) = 4), p AS (SELECT *, max(level) OVER (PARTITION BY session_id) AS peak FROM b) SELECT session_id, round(any_value(peak), 6) AS peak, min(bar) AS first_bar, max(bar) AS last_bar FROM p WHERE level >= 0.45 * peak GROUP BY session_id")
def bar_energy(spark, sf):
    levels = series.bars(plays(spark, sf).withColumn("value", F.col("value") / 1000), "session_id")
    return series.loud_bars(levels, "session_id").select("session_id", r6(F.col("peak"), "peak"), "first_bar", "last_bar")


BLOCKS = "SELECT session_id, pos, CAST((pos * 7919 + session_id) % 900 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(95 AS DOUBLE) AS lufs FROM {history}"


@query(f"""{H}, blocks AS ({BLOCKS.format(history='history')}), loud AS (SELECT * FROM blocks WHERE lufs >= -70), m AS (SELECT session_id, -0.691 + 10 * log10(greatest(1e-12, avg(pow(10, (lufs + 0.691) / 10)))) AS m FROM loud GROUP BY ALL),
g AS (SELECT session_id, -0.691 + 10 * log10(greatest(1e-12, avg(pow(10, (lufs + 0.691) / 10)))) AS integrated FROM loud JOIN m USING (session_id) WHERE lufs >= m - 10 GROUP BY ALL)
SELECT session_id, round(integrated, 6) AS integrated, round(coalesce(-14 - integrated, 0.0), 6) AS gain FROM (SELECT DISTINCT session_id FROM blocks) LEFT JOIN g USING (session_id)""")
def loudness_gate(spark, sf):
    blocks = spark.sql(BLOCKS, history=plays(spark, sf))
    return series.gated_loudness(blocks, "session_id").select("session_id", r6(F.col("integrated"), "integrated"), r6(F.col("gain"), "gain"))


# ---- tempo, grid and transitions -----------------------------------------------------------------


def snap_sql(fraction: str) -> str:
    return f"floor(bpm * {fraction} + 0.5) / ({fraction})"


BAND = "0.025::DOUBLE * bpm * bpm / 1920"
FINE = "SELECT track_id, bpm + CAST((ord * 37) % 19 AS DOUBLE) / CAST(1000 AS DOUBLE) - CAST(0.009 AS DOUBLE) AS bpm FROM {lib} WHERE bpm IS NOT NULL"


@query(f"""{LIB}, fine AS ({FINE.format(lib='lib')}), s AS (SELECT track_id, bpm, {BAND} AS d, {snap_sql('1.0::DOUBLE')} AS s1, {snap_sql('2.0::DOUBLE')} AS s2, {snap_sql('(2.0::DOUBLE/3.0::DOUBLE)')} AS s23, {snap_sql('3.0::DOUBLE')} AS s3, {snap_sql('12.0::DOUBLE')} AS s12 FROM fine)
SELECT track_id, round(CASE WHEN abs(s1 - bpm) < d THEN s1 WHEN bpm < 85 AND abs(s2 - bpm) < d THEN s2 WHEN bpm > 127 AND abs(s23 - bpm) < d THEN s23 WHEN abs(s3 - bpm) < d THEN s3 WHEN abs(s12 - bpm) < d THEN s12 ELSE bpm END, 6) AS bpm FROM s""")
def tempo_snap(spark, sf):
    fine = spark.sql(FINE, lib=lib(spark, sf))
    band = timeline.tempo_band(F.col("bpm"))
    return fine.select("track_id", r6(timeline.snap_tempo(band["low"], F.col("bpm"), band["high"]), "bpm"))


@query(f"{LIB} SELECT track_id, round(bpm - {BAND}, 6) AS low, round(bpm + {BAND}, 6) AS high FROM lib WHERE bpm IS NOT NULL")
def uncertainty_band(spark, sf):
    band = timeline.tempo_band(F.col("bpm"))
    return lib(spark, sf).where("bpm is not null").select("track_id", r6(band["low"], "low"), r6(band["high"], "high"))


def gridded(spark: SparkSession, sf: str) -> DataFrame:
    return lib(spark, sf).where("bpm is not null").withColumn("beats", series.beat_times(F.col("first_beat"), F.col("bpm"), F.col("duration_sec")))


GRID = f"{LIB}, beats AS (SELECT track_id, title, file_path, bpm, duration_sec, first_beat, i, first_beat + i * 60 / bpm AS beat FROM (SELECT *, unnest(range(greatest(ceil((duration_sec - first_beat) * bpm / 60), 0)::BIGINT)) AS i FROM lib WHERE bpm IS NOT NULL))"


@query(f"{GRID} SELECT track_id, i AS idx, round(beat + 1e-7, 6) AS beat, i % 4 = 0 AS is_downbeat FROM beats")
def beat_grid(spark, sf):
    rows = gridded(spark, sf).select("track_id", F.posexplode("beats").alias("idx", "beat"))
    return rows.select("track_id", F.col("idx").cast("long").alias("idx"), r6(F.col("beat") + 1e-7, "beat"), (F.col("idx") % 4 == 0).alias("is_downbeat"))


@query(f"{GRID} SELECT track_id, count(*) FILTER (i % 4 = 0) AS downbeats, round(max(beat) FILTER (i % 4 = 0), 6) AS last FROM beats GROUP BY ALL")
def downbeats(spark, sf):
    down = series.downbeats(F.col("beats"))
    return gridded(spark, sf).select("track_id", F.size(down).cast("long").alias("downbeats"), r6(F.array_max(down), "last"))


@query(f"{GRID} SELECT track_id, round(beat, 6) AS at FROM beats WHERE i % 4 = 0 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY abs(beat - duration_sec / 3), beat) = 1")
def nearest_downbeat(spark, sf):
    return gridded(spark, sf).select("track_id", r6(timeline.nearest_downbeat(series.downbeats(F.col("beats")), F.col("duration_sec") / 3), "at"))


@query(f"{GRID}, n AS (SELECT track_id, any_value(duration_sec) / 3 AS p, any_value(bpm) AS bpm, min(beat) FILTER (i % 4 = 0 AND beat >= duration_sec / 3 + 0.05) AS s FROM beats GROUP BY ALL) SELECT track_id, round(CASE WHEN s - p <= 240 / bpm + 0.05 THEN s ELSE p + 0.05 END, 6) AS at FROM n")
def next_downbeat(spark, sf):
    return gridded(spark, sf).select("track_id", r6(timeline.next_downbeat(series.downbeats(F.col("beats")), F.col("duration_sec") / 3, F.col("bpm")), "at"))


@query(f"""{LIB}, c AS (SELECT *, 60 / bpm AS beat, regexp_matches(concat_ws(' ', title, file_path), '(?i)\\b(dj[\\s._-]*beats?|dj[\\s._-]*edit)\\b') AS edit FROM lib WHERE bpm IS NOT NULL)
SELECT track_id, round(CASE WHEN edit THEN first_beat ELSE 8.0 END, 6) AS mix_in, round(CASE WHEN edit THEN greatest(first_beat + 12 * beat, duration_sec - 8 * beat) ELSE duration_sec - 16 END, 6) AS mix_out,
 round(CASE WHEN edit THEN first_beat ELSE 0.0 END, 6) AS intro_start, round(CASE WHEN edit THEN first_beat + 8 * beat ELSE 8.0 END, 6) AS intro_end, round(CASE WHEN edit THEN greatest(first_beat + 12 * beat, duration_sec - 8 * beat) ELSE duration_sec - 16 END, 6) AS outro_start, duration_sec AS outro_end FROM c""")
def effective_cues(spark, sf):
    rows = lib(spark, sf).where("bpm is not null")
    cues = timeline.effective_cues(F.col("title"), F.col("file_path"), F.col("bpm"), F.col("first_beat"), F.col("duration_sec"), F.lit(8.0), F.col("duration_sec") - 16)
    return rows.select("track_id", *[r6(cues[c], c) for c in ("mix_in", "mix_out", "intro_start", "intro_end", "outro_start", "outro_end")])


RATIO = "CASE WHEN r > 1.4 THEN CASE WHEN r / 2 > 1.4 THEN r / 4 ELSE r / 2 END WHEN r < 0.7 THEN CASE WHEN r * 2 < 0.7 THEN r * 4 ELSE r * 2 END ELSE r END"


@query(f"""{LIB}, f AS (SELECT track_id, duration_sec, bpm, 120 / bpm AS r FROM lib WHERE bpm IS NOT NULL), g AS (SELECT *, {RATIO} AS ratio, least(greatest(3840 / bpm, 8.0), 40.0) AS fade, least(greatest(3840 / bpm, 6.0), 20.0) AS planned FROM f)
SELECT track_id, round(fade, 6) AS fade, round(planned, 6) AS planned, round(CASE WHEN abs(ratio - 1) <= 0.06 THEN ratio ELSE 1.0 END, 6) AS stretch, round(duration_sec - 16 - planned - 0.7, 6) AS trigger_at,
 round(CASE WHEN fade >= 5 AND abs(ratio - 1) <= 0.06 THEN least(60 / bpm, fade * 0.12) END, 6) AS bass_length, round(CASE WHEN abs(CASE WHEN abs(ratio - 1) <= 0.06 THEN ratio ELSE 1.0 END - 1) > 0.002 THEN least(10.0, greatest(5.0, 0.6 * fade)) END, 6) AS glide FROM g""")
def fade_plan(spark, sf):
    rows = lib(spark, sf).where("bpm is not null")
    ratio = timeline.folded_ratio(F.lit(120.0), F.col("bpm"))
    fade, planned, applied = timeline.fade_seconds(F.col("bpm")), timeline.fade_seconds(F.col("bpm"), timeline.PLANNED_FADE), timeline.stretch(ratio)
    return rows.select(
        "track_id", r6(fade, "fade"), r6(planned, "planned"), r6(applied, "stretch"), r6(timeline.mix_trigger(F.col("duration_sec") - 16, planned), "trigger_at"),
        r6(timeline.bass_swap(fade, ratio, F.col("bpm"))["length"], "bass_length"), r6(timeline.release_glide(applied, fade), "glide"),
    )


@query(f"{LIB}, f AS (SELECT track_id, 128 / bpm AS r FROM lib WHERE bpm IS NOT NULL) SELECT track_id, round({RATIO}, 6) AS ratio, abs({RATIO} - 1) <= 0.08 AS ok FROM f")
def sync_plan(spark, sf):
    ratio = timeline.folded_ratio(F.lit(128.0), F.col("bpm"))
    return lib(spark, sf).where("bpm is not null").select("track_id", r6(ratio, "ratio"), timeline.can_sync(ratio).alias("ok"))


@query(f"""{LIB}, f AS (SELECT track_id, 60 / bpm AS p, duration_sec / 3 - first_beat AS x, duration_sec / 5 AS y FROM lib WHERE bpm IS NOT NULL), g AS (SELECT track_id, p, (y / 0.5 - floor(y / 0.5)) - (x / p - floor(x / p)) + 0.5 AS z FROM f)
SELECT track_id, round((z - floor(z) - 0.5) * p, 6) AS shift FROM g""")
def phase_align(spark, sf):
    period = 60 / F.col("bpm")
    shift = timeline.phase_correction(F.col("duration_sec") / 3, F.col("first_beat"), period, F.col("duration_sec") / 5, F.lit(0.0), F.lit(0.5))
    return lib(spark, sf).where("bpm is not null").select("track_id", r6(shift, "shift"))


@query(f"""{LIB}, f AS (SELECT track_id, bpm / 120 AS r, duration_sec / 10 AS d, duration_sec / 8 AS e FROM lib WHERE bpm IS NOT NULL)
SELECT track_id, round(CASE WHEN abs(ln(1 / r)) < 1e-9 THEN r * d ELSE r * d / ln(1 / r) * (exp(ln(1 / r)) - 1) END + (e - d), 6) AS played FROM f""")
def rate_integral(spark, sf):
    out = timeline.ramp_integral(F.col("bpm") / 120, F.lit(1.0), F.col("duration_sec") / 10, F.col("duration_sec") / 8)
    return lib(spark, sf).where("bpm is not null").select("track_id", r6(out, "played"))


@query(f"{LIB} SELECT track_id, round(pow(10.0, least(greatest(-14 - integrated_lufs, -12.0), 0.0) / 20), 6) AS gain FROM lib WHERE integrated_lufs IS NOT NULL")
def playback_gain(spark, sf):
    return lib(spark, sf).where("integrated_lufs is not null").select("track_id", r6(timeline.playback_gain(F.col("integrated_lufs")), "gain"))


def _profiles() -> list[tuple[int, list[float]]]:
    from setloom.functions.dsp import MAJOR, MINOR

    return [(2 * s + m, [p[(i - s) % 12] for i in range(12)]) for s in range(12) for m, p in enumerate((MAJOR, MINOR))]


def _correlation_sql() -> str:
    rows = ", ".join(f"({i}, [{', '.join(f'{x}::DOUBLE' for x in p)}])" for i, p in _profiles())
    names = ", ".join(f"'{x}'" for x in camelot.PITCHES)
    return f"""WITH p(i, w) AS (VALUES {rows}), b AS (SELECT vec_id, list_transform(range(12), lambda j: list_sum(list_transform(range(j, len(embedding), 12), lambda k: abs(embedding[k + 1]::DOUBLE)))) AS e FROM embeddings),
s AS (SELECT vec_id, i, list_sum(list_transform(range(12), lambda j: e[j + 1] * w[j + 1])) / greatest(1e-9, sqrt(list_sum(list_transform(e, lambda x: x * x)) * list_sum(list_transform(w, lambda x: x * x)))) AS c FROM b, p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, i) AS k, lead(c) OVER (PARTITION BY vec_id ORDER BY c DESC, i) AS second FROM s)
SELECT vec_id, [{names}][i // 2 + 1] AS root, CASE WHEN i % 2 = 0 THEN 'major' ELSE 'minor' END AS scale, round(least(1.0, greatest(0.0, 2 * (c - second))), 6) AS confidence FROM r WHERE k = 1"""


@query(_correlation_sql())
def key_correlation(spark, sf):
    chroma = F.col("chroma")
    norm = F.aggregate(chroma, F.lit(0.0), lambda s, x: s + x * x)
    scores = []
    for i, p in _profiles():
        dot = F.aggregate(F.zip_with(chroma, F.array(*map(F.lit, p)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        scores.append(F.struct((dot / F.greatest(F.lit(1e-9), F.sqrt(norm * F.lit(sum(x * x for x in p))))).alias("c"), F.lit(-i).alias("i")))
    folded = load(spark, sf, "embeddings").select("vec_id", series.pitch_classes(F.col("embedding")).alias("chroma"))
    ranked = folded.select("vec_id", F.reverse(F.array_sort(F.array(*scores))).alias("s"))
    at, lead = -F.col("s")[0]["i"], F.col("s")[0]["c"] - F.col("s")[1]["c"]
    return ranked.select("vec_id", F.element_at(F.array(*map(F.lit, camelot.PITCHES)), (F.floor(at / 2) + 1).cast("int")).alias("root"), F.when(at % 2 == 0, "major").otherwise("minor").alias("scale"), r6(S.clamp01(2 * lead), "confidence"))


# ---- flows: resync, policy, enrichment, store ------------------------------------------------------

TAGS = "SELECT track_id, bpm + CAST(ord % 3 AS DOUBLE) * CAST(0.04 AS DOUBLE) AS tag_bpm, first_beat AS tag_first FROM {lib} WHERE bpm IS NOT NULL AND ord % 2 = 0"


@query(f"""{LIB}, tags AS ({TAGS.format(lib='lib')}), {NAMED.replace('BASE', BASE.format('concat(file_path, chr(32), title)')).replace('SOURCE', 'lib')},
r AS (SELECT n.*, t.tag_bpm, t.tag_bpm IS NOT NULL AND abs(t.tag_bpm - n.bpm) >= 0.05 AS by_tag FROM named n LEFT JOIN tags t USING (track_id) WHERE n.bpm IS NOT NULL AND lower(file_path) LIKE '%.mp3'),
p AS (SELECT *, CASE WHEN by_tag THEN 'tag' WHEN coalesce(abs(n_bpm - bpm) >= 0.75, false) THEN 'name' ELSE 'unchanged' END AS source FROM r)
SELECT track_id, source, round(CASE source WHEN 'tag' THEN tag_bpm WHEN 'name' THEN n_bpm ELSE bpm END, 6) AS bpm, CASE WHEN source <> 'unchanged' AND quality = 'unreliable' THEN 'partial' ELSE quality END AS quality FROM p""")
def resync_library(spark, sf):
    rows = lib(spark, sf)
    return resync.resync_plan(rows, spark.sql(TAGS, lib=rows)).select("track_id", "source", r6(F.col("bpm"), "bpm"), "quality")


@query(f"{QUEUE_SQL}, {duck('history')} SELECT 'queue' AS source, arg_min(track_id, pos) AS track_id FROM d WHERE queue_id = (SELECT min(queue_id) FROM queue) AND track_id NOT IN (SELECT track_id FROM history WHERE session_id = {SESSION}) HAVING count(*) > 0")
def next_track_policy(spark, sf):
    queue = queueing.deduped(load(spark, sf, "queue"))
    mine = queue.join(F.broadcast(queue.agg(F.min("queue_id").alias("queue_id"))), "queue_id")
    played = load(spark, sf, "history").where(F.col("session_id") == SESSION)
    return ranking.next_track(queueing.next_unplayed(mine, played), ranking.pick_next(session_rows(spark, sf)))


@query(f"{LIB}, {duck('queue')} SELECT track_id FROM lib WHERE quality IS NOT NULL AND track_id NOT IN (SELECT track_id FROM queue WHERE pos = 0)")
def selectable_rows(spark, sf):
    return ranking.selectable(lib(spark, sf), load(spark, sf, "queue").where("pos = 0")).select("track_id")


@query(f"""WITH {duck('tracks')}, hits AS ({HITS.format(tracks='tracks')}), cached AS (SELECT track_id, concat('k', track_id) AS hit_id FROM tracks WHERE genre IS NULL),
scored AS (SELECT t.track_id, rank, h.hit_id, round(0.6 * {OVERLAP.format('title', 'hit_title')} + 0.3 * {OVERLAP.format('artist', 'hit_artist')} + 0.1 * greatest(0.0, 1 - abs(hit_seconds - duration_sec) / 10), 9) AS score FROM tracks t JOIN hits h ON t.track_id = h.track_id WHERE genre IS NOT NULL),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, rank) = 1)
SELECT CASE WHEN c.hit_id IS NOT NULL OR b.score >= 0.55 THEN 'matched' ELSE 'unmatched' END AS status, count(*) AS n FROM tracks t LEFT JOIN cached c USING (track_id) LEFT JOIN best b USING (track_id) GROUP BY ALL""")
def enrichment_counts(spark, sf):
    tracks = load(spark, sf, "tracks")
    hits = spark.sql(HITS, tracks=tracks).withColumn("hit_artists", F.array("hit_artist")).drop("hit_artist")
    cached = tracks.where("genre is null").select("track_id", F.concat(F.lit("k"), "track_id").alias("hit_id"))
    return catalog.enrichment_status(tracks, hits, cached).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {duck('tracks')}, n AS (SELECT *, row_number() OVER (ORDER BY added_at DESC, ord) AS r FROM tracks), e AS (SELECT min(r) AS lo, max(r) AS hi FROM n WHERE track_id IN ('t5', 't90')) SELECT track_id FROM n, e WHERE r BETWEEN lo AND hi")
def range_selection(spark, sf):
    return library.range_selection(load(spark, sf, "tracks"), "t5", "t90").select("track_id")


@query(f"WITH {duck('tracks', 'history')} SELECT track_id, CASE WHEN track_id IN (SELECT track_id FROM history) THEN 'edited' ELSE title END AS title FROM tracks WHERE genre IS NOT NULL")
def store_changes(spark, sf):
    tracks, plays_ = load(spark, sf, "tracks"), load(spark, sf, "history")
    changed = tracks.join(plays_.select("track_id").distinct(), "track_id", "left_semi").withColumn("title", F.lit("edited"))
    (kept,) = library.delete_cascade(tracks.where("genre is null"), library.upsert(tracks, changed, "track_id"))
    return kept.select("track_id", "title")


@query(f"""{LIB}, r AS (SELECT track_id, file_path AS old_path, concat(regexp_extract(file_path, '^(.*/)?[^/]*$', 1), {CLEAN.format('title')}, regexp_extract(file_path, '(\\.[^./]*)$', 1)) AS new_path FROM lib)
SELECT track_id, old_path, new_path, CASE WHEN new_path = old_path THEN 'unchanged' WHEN count(*) FILTER (new_path <> old_path) OVER (PARTITION BY new_path) > 1 OR new_path IN (SELECT old_path FROM r) THEN 'collision' ELSE 'rename' END AS status FROM r""")
def rename_collisions(spark, sf):
    return files.rename_plan(lib(spark, sf), text.rendered("{title}", {"title": F.col("title")}))


@query(f"{LIB} SELECT track_id, round(cos(greatest(least(energy_mean, 1.0), 0.0) * pi() / 2), 6) AS \"left\", round(sin(greatest(least(energy_mean, 1.0), 0.0) * pi() / 2), 6) AS \"right\", round(greatest(least(integrated_lufs + 14, 6.0), -26.0), 6) AS gain_db FROM lib WHERE bpm IS NOT NULL")
def mixer_controls(spark, sf):
    fader = timeline.crossfader(F.col("energy_mean"))
    gains = timeline.controls(F.lit(1.0), F.col("integrated_lufs") + 14, F.lit(0.0))
    return lib(spark, sf).where("bpm is not null").select("track_id", r6(fader["left"], "left"), r6(fader["right"], "right"), r6(gains["gain_db"], "gain_db"))


# ---- audio: a generated click track for each nation, whose number sets the tempo -------------------


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    ids = load(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("track_id"), (F.lit(84.0) + 4 * F.col("n_nationkey")).alias("bpm"))
    return audio.analyze(audio.click_tracks(ids.repartition(8, "track_id")))


@query()
def analyze_track(spark, sf):
    out = analysed(spark, sf)
    return out.select(
        "track_id", r6(F.col("bpm"), "bpm"), F.size("beats").alias("beats"), "is_stable", F.col("key.camelot").alias("camelot"), r6(F.col("energy.mean"), "energy"),
        r6(F.col("cues.mix_in"), "mix_in"), r6(F.col("cues.mix_out"), "mix_out"), r6(F.col("integrated_lufs"), "lufs"), F.sha1("overview").alias("overview"), "quality",
    )


@query()
def tag_roundtrip(spark, sf):
    return audio.tag_round_trip(analysed(spark, sf))


# ---- streaming: the same windowed aggregate that the stream computes --------------------------------


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS plays, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def windowed_plays(spark, sf):
    return stream.windowed_plays(load(spark, sf, "events")).select("start", "event_type", "plays", r6(F.col("mean"), "mean"))

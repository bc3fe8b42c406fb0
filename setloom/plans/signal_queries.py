"""Registered queries of signals and the mixer's timeline in table form, with SQL for DuckDB beside each."""

from __future__ import annotations

from pyspark.sql import functions as F

from setloom.functions import dsp, timeline
from setloom.operators import series
from setloom.plans.fixtures import duck, load
from setloom.plans.queries import H, LIB, lib, plays, query, r6

FRAME = 16


@query(f"{H} SELECT session_id, pos // {FRAME} AS frame, round(sqrt(avg(value * value)), 6) AS rms FROM history GROUP BY ALL HAVING count(*) = {FRAME}")
def energy_frames(spark, sf):
    return series.tumbling_rms(plays(spark, sf), "session_id", FRAME).select("session_id", "frame", r6(F.col("rms"), "rms"))


#: A beat every 3.7 positions, so that bars begin between values.
BEATS = "SELECT session_id, i AS idx, CAST(i AS DOUBLE) * CAST(3.7 AS DOUBLE) + CAST(session_id % 5 AS DOUBLE) AS beat FROM (SELECT session_id, max(pos) AS n FROM {history} GROUP BY session_id), {numbers} WHERE i * 3 <= n"


@query(f"""{H}, b AS ({BEATS.format(history='history', numbers='range(64) t(i)')}), bars AS (SELECT a.session_id, a.idx // 4 AS bar, a.beat AS low, z.beat AS high FROM b a JOIN b z ON z.session_id = a.session_id AND z.idx = a.idx + 4 WHERE a.idx % 4 = 0)
SELECT session_id, bar, round(sqrt(avg(value * value)), 6) AS level FROM bars JOIN history USING (session_id) WHERE pos >= low AND pos < high GROUP BY ALL""")
def beat_bar_levels(spark, sf):
    history = plays(spark, sf)
    beats = spark.sql(BEATS, history=history, numbers=spark.range(64).toDF("i"))
    return series.beat_bars(history, beats, "session_id", "pos").select("session_id", F.col("bar").cast("long").alias("bar"), r6(F.col("level"), "level"))


@query(f"""{H}, n AS (SELECT session_id, pos, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM history WINDOW w AS (PARTITION BY session_id ORDER BY pos)), s AS (SELECT *, 0.5 * (a - b) / nullif(a - 2 * value + b, 0) AS shift FROM n WHERE value > a AND value > b)
SELECT session_id, pos, round(pos + CASE WHEN abs(shift) <= 0.5 THEN shift ELSE 0.0 END, 6) AS place FROM s""")
def parabolic_peaks(spark, sf):
    return series.parabolic_peaks(plays(spark, sf), "session_id").select("session_id", "pos", r6(F.col("place"), "place"))


@query("SELECT vec_id, i AS sample, round((embedding[i + 1]::DOUBLE + embedding[i + 1 + len(embedding) // 2]::DOUBLE) / 2, 6) AS value FROM (SELECT *, unnest(range(len(embedding) // 2)) AS i FROM embeddings)")
def mono_mix(spark, sf):
    half = F.floor(F.size("embedding") / 2).cast("int")
    mixed = series.mixed_down(F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, half))
    rows = load(spark, sf, "embeddings").select("vec_id", F.posexplode(mixed).alias("sample", "value"))
    return rows.select("vec_id", F.col("sample").cast("long").alias("sample"), r6(F.col("value"), "value"))


RATIO = 1.6


@query(f"""SELECT vec_id, i AS sample, round(a + (coalesce(b, a) - a) * (x - floor(x)), 6) AS value FROM (SELECT vec_id, i, x, embedding[floor(x)::INT + 1]::DOUBLE AS a, embedding[floor(x)::INT + 2]::DOUBLE AS b
 FROM (SELECT vec_id, embedding, i, i * {RATIO}::DOUBLE AS x FROM (SELECT *, unnest(range(floor(len(embedding) / {RATIO}::DOUBLE)::BIGINT)) AS i FROM embeddings)))""")
def linear_resample(spark, sf):
    rows = load(spark, sf, "embeddings").select("vec_id", F.posexplode(series.resampled(F.col("embedding"), RATIO)).alias("sample", "value"))
    return rows.select("vec_id", F.col("sample").cast("long").alias("sample"), r6(F.col("value"), "value"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range({dsp.DISPLAY_BARS}), lambda i: (i + 1) * least(greatest(embedding[(floor(i * len(embedding) / {dsp.DISPLAY_BARS}.0::DOUBLE) + 1)::INT]::DOUBLE, 0.0), 1.0))), 5) AS weighted FROM embeddings")
def display_bars(spark, sf):
    bars = series.display_bars(F.col("embedding"), dsp.DISPLAY_BARS)
    total = F.aggregate(F.transform(bars, lambda x, i: (i + 1) * x), F.lit(0.0), lambda s, x: s + x)
    return load(spark, sf, "embeddings").select("vec_id", (F.round(total, 5) + F.lit(0.0)).alias("weighted"))


@query("SELECT vec_id, j AS pitch_class, round(list_sum(list_transform(range(j, len(embedding), 12), lambda k: abs(embedding[k + 1]::DOUBLE))), 6) AS weight FROM embeddings, range(12) t(j)")
def pitch_classes(spark, sf):
    rows = load(spark, sf, "embeddings").select("vec_id", F.posexplode(series.pitch_classes(F.col("embedding"))).alias("pitch_class", "weight"))
    return rows.select("vec_id", F.col("pitch_class").cast("long").alias("pitch_class"), r6(F.col("weight"), "weight"))


# ---- timeline -------------------------------------------------------------------------------------

SEGMENTS = """SELECT track_id, duration_sec / 40 AS start, bpm / 120 AS rate, duration_sec / 3 AS now, duration_sec / 10 AS s1, duration_sec / 10 + 4 AS e1, duration_sec / 5 AS s2, duration_sec / 5 + duration_sec * energy_mean / 4 AS e2, energy_mean + CAST(0.5 AS DOUBLE) AS r1 FROM {lib} WHERE bpm IS NOT NULL"""


def _ramp(a: str, b: str, length: str, t: str) -> str:
    k = f"ln(({b}) / ({a}))"
    return f"CASE WHEN ({length}) <= 0 OR abs({k}) < 1e-9 THEN ({a}) * least({t}, {length}) ELSE ({a}) * ({length}) / {k} * (exp({k} * least({t}, {length}) / ({length})) - 1) END"


@query(f"""{LIB}, s AS ({SEGMENTS.format(lib='lib')})
SELECT track_id, round((s1 - start) * rate + {_ramp('rate', 'r1', 'e1 - s1', 'now - s1')} + (s2 - e1) * r1 + {_ramp('r1', '1.0::DOUBLE', 'e2 - s2', 'now - s2')} + greatest(now - e2, 0), 6) AS played,
 round((duration_sec_5 - start) * rate, 6) AS early FROM (SELECT *, start + 1 AS duration_sec_5 FROM s)""")
def rate_segments(spark, sf):
    rows = spark.sql(SEGMENTS, lib=lib(spark, sf))
    one = F.struct(F.col("s1").alias("start"), F.col("e1").alias("end"), F.col("rate").alias("from"), F.col("r1").alias("to"))
    two = F.struct(F.col("s2").alias("start"), F.col("e2").alias("end"), F.col("r1").alias("from"), F.lit(1.0).alias("to"))
    at = lambda now: timeline.played_seconds(F.col("start"), F.col("rate"), F.array(two, one), now)
    return rows.select("track_id", r6(at(F.col("now")), "played"), r6(at(F.col("start") + 1), "early"))


@query(f"{LIB} SELECT track_id, round(1 + least(greatest(integrated_lufs, -8.0), 8.0) / 100, 6) AS rate FROM lib WHERE integrated_lufs IS NOT NULL")
def pitch_fader(spark, sf):
    return lib(spark, sf).where("integrated_lufs is not null").select("track_id", r6(timeline.pitch_rate(F.col("integrated_lufs")), "rate"))


@query("SELECT i AS point, round(cos(i * pi() / 2 / 511), 6) AS fade_out, round(sin(i * pi() / 2 / 511), 6) AS fade_in FROM range(512) t(i)")
def equal_power_curve(spark, sf):
    curve = spark.range(1).select(F.posexplode(timeline.equal_power()).alias("point", "c"))
    return curve.select(F.col("point").cast("long").alias("point"), r6(F.col("c.fade_out"), "fade_out"), r6(F.col("c.fade_in"), "fade_in"))


@query(f"WITH {duck('tracks')} SELECT track_id, sha1(concat(encode(title), encode('|'), encode(artist))) AS joined FROM tracks")
def byte_concat(spark, sf):
    parts = [F.col("title").cast("binary"), F.lit("|").cast("binary"), F.col("artist").cast("binary")]
    return load(spark, sf, "tracks").select("track_id", F.sha1(F.concat(*parts)).alias("joined"))

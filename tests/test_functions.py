"""Column functions against hand-written cases."""

import random

import pytest
from pyspark.sql import functions as F

from setloom.functions import camelot, scoring, text, timeline
from setloom.functions.dsp import snapped_tempo
from setloom.operators import dedupe, series

NAMES = [
    ("Artist - Song (Dj Beats) 81.mp3", 81),
    ("Song [128].mp3", 128),
    ("Song (96).flac", 96),
    ("Song 128 BPM.mp3", 128),
    ("Song 140bpm remix.mp3", 140),
    ("/music/x/Some Track 105.wav", 105),
    ("Song 250.mp3", None),
    ("Song 12.mp3", None),
    ("Song99.mp3", None),
    ("01 Song.mp3", None),
    ("Song 3.128 bpm.mp3", None),
    ("Song [250] 128 bpm.mp3", 128),
]


def column(spark, rows, schema, out):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(out.alias("o")).collect()]


def test_bpm_from_name(spark):
    got = column(spark, [(n,) for n, _ in NAMES], "n string", text.bpm_from_name(F.col("n"))["bpm"])
    assert got == [b for _, b in NAMES]
    assert column(spark, [("01 Song.mp3",), ("99 - Song.mp3",)], "n string", text.bpm_from_name(F.col("n"), True)["bpm"]) == [None, 99]


def test_reconcile(spark):
    rows = [("x 81", 157.0, 0.4), ("x", 128.4, 0.8), ("x 100", 200.0, 0.95)]
    out = text.reconciled(text.bpm_from_name(F.col("n")), F.col("b"), F.col("c"))
    got = [(r["bpm"], round(r["confidence"], 6), r["source"]) for r in column(spark, rows, "n string, b double, c double", out)]
    assert got == [(81.0, 0.9, "name"), (128.4, 0.8, "audio"), (100.0, 0.95, "name")]


def test_match_text(spark):
    rows = [("Beyoncé (Live) [Remix] — Déjà  Vu",), ("øßœ",), ("",), (None,)]
    assert column(spark, rows, "t string", text.match_text(F.col("t"))) == ["beyonce deja vu", "", "", None]


def test_camelot(spark):
    rows = [("8A", "8A"), ("8A", "9A"), ("12B", "1B"), ("8A", "8B"), ("8A", "3A"), ("1A", "7A"), (None, "1A")]
    assert column(spark, rows, "a string, b string", camelot.compatibility(F.col("a"), F.col("b"))) == [1.0, 0.9, 0.9, 0.85, 0.25, 0.25, None]
    assert column(spark, [("Db", "major"), (" A ", "minor"), (None, "major")], "r string, s string", camelot.to_camelot(camelot.normalize_root(F.col("r")), F.col("s"))) == ["3B", "8A", None]
    with pytest.raises(Exception, match="unknown key"):
        column(spark, [("H", "major")], "r string, s string", camelot.to_camelot(F.col("r"), F.col("s")))


def test_anchored_durations(spark):
    out = dedupe.anchors(F.col("d"))["anchor"]
    assert column(spark, [([100.0, 102.0, 104.0],), ([1.0],), ([],)], "d array<double>", out) == [[100.0, 100.0, 104.0], [1.0], []]


def test_ratio_fold(spark):
    rows = [(140.0, 70.0), (70.0, 140.0), (128.0, 124.0), (128.0, 30.0), (30.0, 128.0)]

    def fold(a, b):
        r = a / b
        while r > 1.4:
            r /= 2
        while r < 0.7:
            r *= 2
        return r

    assert column(spark, rows, "a double, b double", timeline.folded_ratio(F.col("a"), F.col("b"))) == pytest.approx([fold(*r) for r in rows])


def test_rounding_goes_up(spark):
    assert column(spark, [(-2.5,), (2.5,), (-0.4,)], "x double", timeline.js_round(F.col("x"))) == [-2, 3, 0]


def test_snap_ladder(spark):
    rows = [(127.9, 128.02, 128.2), (80.4, 80.48, 80.6), (140.6, 140.99, 141.0), (99.98, 99.99, 99.995), (0.0, 10.2, 11.0)]
    got = column(spark, rows, "a double, b double, c double", timeline.snap_tempo(F.col("a"), F.col("b"), F.col("c")))
    assert got == pytest.approx([snapped_tempo(*r) for r in rows]) and got[:2] == [128.0, 80.5] and got[3:] == [99.99, 10.2]


def test_rounded_as_sql_on_doubles(spark):
    """0.5017185 lies just below the half once scaled; Spark's own round takes it up."""
    import duckdb

    values = [0.5017185, -0.5017185, 0.0000005, 2.5, -2.5, 0.1234565, 1e12 + 0.1, 0.0, None]
    want = [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    assert column(spark, [(v,) for v in values], "x double", scoring.rounded(F.col("x"), 6)) == want
    assert want[:2] == [0.501718, -0.501718]


def test_ramp_integral(spark):
    rows = [(1.05, 1.0, 8.0, 4.0), (0.95, 1.0, 5.0, 5.0), (1.0, 1.0, 5.0, 9.0), (1.06, 1.0, 10.0, 14.0), (0.9, 1.1, 3.0, 1.0)]

    def brute(a, b, d, e, n=200_000):
        dt = e / n
        return sum((a * (b / a) ** min(1.0, (i + 0.5) * dt / d)) * dt for i in range(n))

    got = column(spark, rows, "a double, b double, d double, e double", timeline.ramp_integral(*[F.col(c) for c in "abde"]))
    assert got == pytest.approx([brute(*r) for r in rows], abs=1e-6)


def test_phase_is_shortest(spark):
    r = random.Random(5)
    rows = [(r.uniform(0, 60), r.uniform(0, 1), r.uniform(0.3, 0.7), r.uniform(0, 60), r.uniform(0, 1), r.uniform(0.3, 0.7)) for _ in range(50)]
    got = column(spark, rows, ", ".join(f"c{i} double" for i in range(6)), timeline.phase_correction(*[F.col(f"c{i}") for i in range(6)]))
    for (p, f, d, q, g, e), shift in zip(rows, got):
        assert abs(shift) <= d / 2 + 1e-9
        mine, other = ((p + shift - f) / d) % 1, ((q - g) / e) % 1
        assert min(abs(mine - other), 1 - abs(mine - other)) < 1e-6


def test_phase_of_half_a_beat_has_the_sign_of_sql(spark):
    """Tracks 5200 and 11128 of sf0.1 stand half a beat apart from the other grid."""
    import duckdb

    rows = [(90.0, 0.3, 100.0), (102.0, 0.25, 123.2)]
    sql = "SELECT (z - floor(z) - 0.5) * p FROM (SELECT p, (y / 0.5 - floor(y / 0.5)) - (x / p - floor(x / p)) + 0.5 AS z FROM (SELECT 60 / ?::DOUBLE AS p, ?::DOUBLE / 3 - ?::DOUBLE AS x, ?::DOUBLE / 5 AS y))"
    want = [duckdb.execute(sql, [bpm, seconds, first, seconds]).fetchone()[0] for seconds, first, bpm in rows]
    shift = timeline.phase_correction(F.col("seconds") / 3, F.col("first"), 60 / F.col("bpm"), F.col("seconds") / 5, F.lit(0.0), F.lit(0.5))
    assert column(spark, rows, "seconds double, first double, bpm double", shift) == want
    assert all(x < 0 for x in want)


def test_block_peaks_drop_the_remainder(spark):
    assert column(spark, [([1.0, -2.0, 0.5, 0.25, 9.0],)], "x array<double>", series.block_peaks(F.col("x"), 2)) == [[1.0, 0.25]]


def test_track_uri(spark):
    rows = [("spotify:track:abc",), ("https://open.spotify.com/intl-de/track/XyZ1?si=3",), ("a" * 22,), ("a" * 21,), ("",), (None,)]
    assert column(spark, rows, "u string", text.track_uri(F.col("u"))) == ["spotify:track:abc", "spotify:track:XyZ1", "spotify:track:" + "a" * 22, None, None, None]


def test_file_url_keeps_plus(spark):
    assert column(spark, [("file://localhost/a%20b+c.mp3",), ("http://x",)], "u string", text.file_url_path(F.col("u"))) == ["/a b+c.mp3", None]


def test_names(spark):
    rows = [("/a/b.c.mp3",), (".hidden",), ("noext",)]
    assert column(spark, rows, "p string", text.extension(text.basename(F.col("p")))) == [".mp3", "", ""]
    assert column(spark, [("A  -  - B [] ( )",)], "p string", text.collapsed(F.col("p"))) == ["A - B"]

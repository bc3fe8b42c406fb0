"""A music catalog as lookup tables: search hits, features, matching, and merging into analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.functions.camelot import PITCHES, to_camelot
from setloom.functions.text import match_score, match_text
from setloom.functions.timeline import between

# Fixed values.
ACCEPT, CATALOG_BPM_CONFIDENCE, CATALOG_KEY_CONFIDENCE = 0.55, 0.95, 0.9


def best_hits(tracks: DataFrame, hits: DataFrame) -> DataFrame:
    """(track_id, hit_id, score) of each track's best hit of 0.55 or more, the first of equals.

    ``hits(track_id, rank, hit_id, hit_title, hit_artists, hit_seconds)`` has a few rows a
    track, so the match is an equi-join and a partial maximum, never a product.
    """
    rows = tracks.join(hits, "track_id").withColumns({"t": match_text(F.col("title")), "a": match_text(F.col("artist")), "ht": match_text(F.col("hit_title"))})
    lists = hits.select("track_id", "rank", F.explode("hit_artists").alias("x")).withColumn("x", match_text(F.col("x")))
    joined = lists.groupBy("track_id", "rank").agg(F.collect_list("x").alias("artists"))
    full = rows.join(joined, ["track_id", "rank"], "left").withColumn("artists", F.coalesce("artists", F.array().cast("array<string>")))
    score = F.round(match_score(F.col("t"), F.col("a"), F.col("duration_sec"), F.col("ht"), F.col("artists"), F.col("hit_seconds")), 9)
    best = full.withColumn("score", score).groupBy("track_id").agg(F.max_by(F.struct("hit_id", "score"), F.struct("score", (-F.col("rank")).alias("r"))).alias("b"))
    return best.select("track_id", "b.*").where(F.col("score") >= ACCEPT)


def features_analysis(key: Column, mode: Column, tempo: Column, energy: Column, loudness: Column) -> dict[str, Column]:
    """Analysis columns from catalog features; a key outside 0 to 11 counts as C."""
    names = F.array(*[F.lit(p) for p in PITCHES])
    root = F.element_at(names, F.when(key.between(0, 11), key + 1).otherwise(1).cast("int"))
    return {"bpm": tempo, "camelot": to_camelot(root, F.when(mode == 1, "major").otherwise("minor")), "energy_mean": between(energy, 0.0, 1.0), "rms_db": loudness}


def merged(analyses: DataFrame, features: DataFrame) -> DataFrame:
    """Analyses with the catalog's tempo, key, energy and loudness; grid, peak and cues are kept as they were.

    ``features(track_id, f_bpm, f_camelot, f_energy, f_loudness, duration_sec)``: what has
    features gets their confidences (tempo .95, key .9) and counts as good. A track without an
    analysis gets a minimal one: a stable grid from 0 without beats, a peak of 1.2 times the
    energy, cues 8 s from the start and 16 s from the end. Columns that ``analyses`` lacks are null there.
    """
    kept = ("energy_peak", "rms_db", "mix_in", "mix_out", "intro_end", "outro_start", "is_stable")
    types = {"is_stable": "boolean"}
    whole = analyses.select("*", *[F.lit(None).cast(types.get(c, "double")).alias(c) for c in kept if c not in analyses.columns])
    both = whole.join(features, "track_id", "full")
    new, has = F.col("quality").isNull(), F.col("f_bpm").isNotNull()
    head, tail = F.least(F.lit(8.0), F.col("duration_sec")), F.greatest(F.lit(0.0), F.col("duration_sec") - 16)
    pick = lambda f, own: F.when(has, f).otherwise(F.col(own)).alias(own)
    fresh = lambda value, own: F.when(new, value).otherwise(F.col(own)).alias(own)
    return both.select(
        "track_id", pick(F.col("f_bpm"), "bpm"), pick(F.col("f_camelot"), "camelot"), pick(F.col("f_energy"), "energy_mean"), pick(F.col("f_loudness"), "rms_db"),
        pick(F.lit(CATALOG_BPM_CONFIDENCE), "bpm_confidence"), pick(F.lit(CATALOG_KEY_CONFIDENCE), "key_confidence"), pick(F.lit("good"), "quality"),
        fresh(F.lit(0.0), "first_beat"), fresh(F.lit(True), "is_stable"), fresh(F.least(F.lit(1.0), 1.2 * F.col("f_energy")), "energy_peak"),
        fresh(head, "mix_in"), fresh(head, "intro_end"), fresh(tail, "mix_out"), fresh(tail, "outro_start"), F.when(has, "catalog").otherwise("audio").alias("origin"),
    )


def feature_rows(ids: DataFrame, features: DataFrame) -> DataFrame:
    """(track_id, hit_id) of ``ids`` with the features of its hit, all null where the catalog has none.

    ``features(hit_id, key, mode, tempo, energy, loudness)``.
    """
    known = features.select("hit_id", F.lit(True).alias("_known"), *[c.alias(n) for n, c in features_analysis(*map(F.col, ("key", "mode", "tempo", "energy", "loudness"))).items()])
    return ids.join(known, "hit_id", "left").withColumn("found", F.coalesce("_known", F.lit(False))).drop("_known")


def enrichment_status(tracks: DataFrame, hits: DataFrame, cached: DataFrame) -> DataFrame:
    """(track_id, hit_id, status): a cached id counts as matched without a search; then the best hit; else unmatched."""
    known = tracks.join(cached.select("track_id", F.col("hit_id").alias("cached_id")), "track_id", "left")
    found = best_hits(known.where("cached_id is null"), hits).select("track_id", "hit_id")
    rows = known.join(found, "track_id", "left")
    hit = F.coalesce("cached_id", "hit_id")
    return rows.select("track_id", hit.alias("hit_id"), F.when(hit.isNotNull(), "matched").otherwise("unmatched").alias("status"))

"""Duplicate tracks: equal hashes, then equal names with durations close to an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.functions.text import duplicate_key

TOLERANCE_SECONDS = 2.0


def exact_duplicates(tracks: DataFrame) -> DataFrame:
    """Tracks that share a hash: track_id, file_hash, n, reason. Counts meet rows by a join, so no group is collected."""
    some = tracks.where(F.coalesce("file_hash", F.lit("")) != "")
    many = some.groupBy("file_hash").agg(F.count("*").alias("n")).where("n >= 2")
    reason = F.concat(F.lit("identical file hash ("), F.left("file_hash", F.lit(10)), F.lit("…)"))
    return some.join(many, "file_hash").select("track_id", "file_hash", "n", reason.alias("reason"))


def anchors(durations: Column, tolerance: float = TOLERANCE_SECONDS) -> Column:
    """For sorted distinct durations, array of struct(duration, anchor): a new anchor beyond ``tolerance`` of the last anchor."""
    start = F.array().cast("array<struct<duration:double,anchor:double>>")

    def step(done: Column, d: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))["anchor"]
        anchor = F.when(last.isNull() | (d - last > tolerance), d).otherwise(last)
        return F.concat(done, F.array(F.struct(d.alias("duration"), anchor.alias("anchor"))))

    return F.aggregate(durations, start, step)


def probable_duplicates(tracks: DataFrame, tolerance: float = TOLERANCE_SECONDS) -> DataFrame:
    """Tracks of equal title and artist whose durations share an anchor: track_id, key, anchor, n, reason.

    Exact duplicates are out. The fold runs over a key's distinct durations, whose number a
    playing time bounds, however many tracks share the key.
    """
    rest = tracks.join(exact_duplicates(tracks).select("track_id"), "track_id", "left_anti")
    keyed = rest.select("track_id", duplicate_key(F.col("title"), F.col("artist")).alias("key"), F.col("duration_sec").cast("double").alias("duration")).where("key <> ''")
    lengths = keyed.groupBy("key").agg(F.array_sort(F.collect_set("duration")).alias("d"))
    anchored = lengths.select("key", F.inline(anchors(F.col("d"), tolerance)))
    placed = keyed.join(anchored, ["key", "duration"])
    many = placed.groupBy("key", "anchor").agg(F.count("*").alias("n")).where("n >= 2")
    reason = F.concat(F.lit("same title & artist ("), F.left("key", F.lit(40)), F.lit("), duration within 2s"))
    return placed.join(many, ["key", "anchor"]).select("track_id", "key", "anchor", "n", reason.alias("reason"))


def duplicate_clusters(tracks: DataFrame) -> DataFrame:
    """Both kinds, exact first."""
    exact = exact_duplicates(tracks).select(F.lit("exact").alias("kind"), F.col("file_hash").alias("cluster"), "track_id", "n", "reason")
    probable = probable_duplicates(tracks).select(F.lit("probable").alias("kind"), F.concat("key", F.lit("#"), F.col("anchor").cast("string")).alias("cluster"), "track_id", "n", "reason")
    return exact.unionByName(probable).orderBy("kind", "cluster", "track_id")


def cluster_counts(tracks: DataFrame) -> DataFrame:
    """(kind, clusters, tracks): how many clusters of each kind, and the sum of their sizes."""
    exact = exact_duplicates(tracks).select(F.lit("exact").alias("kind"), F.struct("file_hash", F.lit(None).cast("double")).alias("cluster"))
    probable = probable_duplicates(tracks).select(F.lit("probable").alias("kind"), F.struct("key", "anchor").alias("cluster"))
    sizes = exact.groupBy("kind", "cluster").agg(F.count("*").alias("n")).union(probable.groupBy("kind", "cluster").agg(F.count("*").alias("n")))
    return sizes.groupBy("kind").agg(F.count("*").alias("clusters"), F.sum("n").alias("tracks"))

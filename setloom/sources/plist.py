"""External library files in property-list XML, a row a track."""

from __future__ import annotations

import plistlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.functions.text import file_url_path

# The kinds that count as audio, and where a library file may be below a home folder, first come first served.
AUDIO_KINDS = ["MPEG audio file", "AAC audio file", "Apple Lossless audio file", "WAV audio file", "AIFF audio file", "Purchased AAC audio file"]
LIBRARY_FILES = ["Music/iTunes/iTunes Music Library.xml", "Music/iTunes/iTunes Library.xml", "Music/Music/Library.xml"]
AUDIO_KIND = "^(" + "|".join(AUDIO_KINDS) + ")"
SCHEMA = "library string, key string, location string, kind string, name string, artist string, album_artist string, album string, genre string, total_ms long, bpm double, persistent_id string"


def read_libraries(spark: SparkSession, root: str) -> DataFrame:
    """Every track entry of the library files; a file is one task's, its rows are streamed out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                tracks = plistlib.loads(bytes(content)).get("Tracks", {})
                rows = [(path, str(k), t.get("Location"), t.get("Kind"), t.get("Name"), t.get("Artist"), t.get("Album Artist"), t.get("Album"), t.get("Genre"), t.get("Total Time"), t.get("BPM"), t.get("Persistent ID")) for k, t in tracks.items()]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)


def library_file(listed: DataFrame, home: str) -> DataFrame:
    """The one row of ``listed(path)`` that is the library file of a home folder, if it has one."""
    rank = F.array_position(F.array(*[F.lit(f"{home.rstrip('/')}/{p}") for p in LIBRARY_FILES]), F.col("path"))
    return listed.where(rank > 0).agg(F.min_by("path", rank).alias("path")).where("path is not null")


def importable(entries: DataFrame, tracks: DataFrame, files: DataFrame | None = None, kind: str = AUDIO_KIND) -> DataFrame:
    """New library rows: entries with a file address, an audio kind or none, and a path the library does not have.

    With ``files(file_path)``, the files that exist, only those. Of entries with one path the first by key counts.
    """
    path = file_url_path(F.col("location"))
    audio = (F.coalesce("kind", F.lit("")) == "") | F.col("kind").rlike(kind)
    good = entries.where((F.coalesce("location", F.lit("")) != "") & audio).withColumn("file_path", path).where("file_path is not null")
    fresh = good.join(tracks.select("file_path"), "file_path", "left_anti")
    if files is not None:
        fresh = fresh.join(files.select("file_path").distinct(), "file_path", "left_semi")
    fresh = fresh.groupBy("file_path").agg(F.min_by(F.struct(*[F.col(c) for c in fresh.columns if c != "file_path"]), "key").alias("e")).select("file_path", "e.*")
    return fresh.select(
        F.sha1(F.col("file_path").cast("binary")).alias("track_id"), "file_path", F.concat(F.lit("itunes:"), F.coalesce("persistent_id", "key")).alias("file_hash"),
        F.coalesce("name", F.element_at(F.split("file_path", "/"), -1)).alias("title"), F.coalesce("artist", "album_artist", F.lit("Unknown Artist")).alias("artist"), "album", "genre",
        (F.coalesce("total_ms", F.lit(0)) / 1000).alias("duration_sec"),
    )

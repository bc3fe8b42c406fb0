"""Files as tables: directory scans, file lists, tag frames, rename and tag-write plans."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setloom.functions import codecs
from setloom.functions.text import AUDIO_EXTENSIONS, basename, is_audio, is_hidden, new_name
from setloom.operators.library import content_id, native_hash

# Fixed values.
MIME = {"mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac", "aiff": "audio/aiff", "aif": "audio/aiff", "m4a": "audio/mp4", "aac": "audio/mp4", "ogg": "audio/ogg", "opus": "audio/opus"}


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path, content, length) of the audio files below ``root``, hidden files and folders left out.

    Spark lists no file whose name begins with an underscore, and none without a byte.
    Without ``content`` the column is not read, only listed.
    """
    pattern = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in AUDIO_EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    below = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    out = files.where(is_audio(F.col("path")) & ~is_hidden(below))
    return out.select("path", "length", *(["content"] if content else []))


def file_list(spark: SparkSession, paths: DataFrame) -> DataFrame:
    return paths.where(is_audio(basename(F.col("path"))))


def title_of(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def track_rows(files: DataFrame, now_ms: int) -> DataFrame:
    """Library rows of scanned files: the id is a content hash; what the tag says replaces what the name does.

    Of several artists or genres the first counts; a file whose tag can't be read keeps its name's defaults.
    """
    sha = content_id(F.col("content"))
    first = lambda frame: F.try_element_at(F.col("tags"), F.lit(frame))
    tagged = files.withColumn("tags", text_frames("content"))
    return tagged.select(
        sha.alias("track_id"), F.col("path").alias("file_path"), F.left(sha, F.lit(16)).alias("file_hash"), F.coalesce(first("TIT2"), title_of(F.col("path"))).alias("title"),
        F.coalesce(first("TPE1"), first("TPE2"), F.lit("Unknown Artist")).alias("artist"), first("TALB").alias("album"), first("TCON").alias("genre"),
        F.coalesce(F.try_divide(first("TLEN").try_cast("double"), F.lit(1000.0)), F.lit(0.0)).alias("duration_sec"), F.lit(44100).alias("sample_rate"), F.lit(2).alias("channels"),
        F.lit(now_ms).cast("long").alias("added_at"), mime_of(F.col("path")).alias("mime"),
    )


def native_rows(paths: DataFrame, now_ms: int) -> DataFrame:
    """Library rows of paths alone; the id is a hash of the path, so an import repeats itself."""
    path = F.col("path")
    return paths.select(F.sha1(path.cast("binary")).alias("track_id"), path.alias("file_path"), native_hash(path).alias("file_hash"), title_of(path).alias("title"), F.lit("Unknown Artist").alias("artist"), F.lit(0.0).alias("duration_sec"), F.lit(now_ms).cast("long").alias("added_at"))


def mime_of(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))), F.lit("application/octet-stream"))


def resolved(tracks: DataFrame, registered: DataFrame, handles: DataFrame) -> DataFrame:
    """(track_id, source, path, mime) of each track's bytes: a path or file it was registered with, else a stored handle.

    ``registered(track_id, kind, path)`` has kind path or file; ``handles(track_id, path,
    readable)``. source is null where there is neither, or the handle may not be read.
    """
    stored = handles.select("track_id", F.col("path").alias("h_path"), "readable")
    rows = tracks.select("track_id").join(registered, "track_id", "left").join(stored, "track_id", "left")
    by_handle = F.col("kind").isNull() & F.coalesce("readable", F.lit(False))
    path = F.when(by_handle, F.col("h_path")).otherwise(F.col("path"))
    return rows.select("track_id", F.when(by_handle, "handle").otherwise(F.col("kind")).alias("source"), path.alias("path"), F.when(path.isNotNull(), mime_of(path)).alias("mime"))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def text_frames(content: pd.Series) -> pd.Series:
    """The first string of each text frame."""
    return content.map(lambda b: {k: v[0] for k, v in codecs.read_text(bytes(b)).items() if v} if b is not None else None)


@F.pandas_udf(T.MapType(T.StringType(), T.BinaryType()))
def geob_frames(content: pd.Series) -> pd.Series:
    return content.map(lambda b: codecs.read_geob(bytes(b)) if b is not None else None)


@F.pandas_udf(T.StructType([T.StructField("bpm", T.DoubleType()), T.StructField("first_beat", T.DoubleType())]))
def tag_tempo(content: pd.Series) -> pd.DataFrame:
    """Tempo and anchor stored in a file's tag; null without either."""
    rows = []
    for b in content:
        frames = codecs.read_geob(bytes(b)) if b is not None else {}
        tags = codecs.decode_autotags(frames.get(codecs.AUTOTAGS, b""))
        grid = codecs.decode_beat_grid(frames.get(codecs.BEATGRID, b""))
        rows.append((tags["bpm"] if tags else grid["bpm"] if grid else None, grid["positions"][0] if grid else None))
    return pd.DataFrame(rows, columns=["bpm", "first_beat"])


def tag_writes(files: DataFrame) -> DataFrame:
    """``files(path, content, bpm, beats, cues)`` with the new content: (path, content, status, error, mode).

    The fields title, artist, album, genre, year, key, comment and camelot are written where
    ``files`` has them, null ones left out; with one of them the tag is a new one. The tempo is
    a frame too then, rounded, halves up. Only mp3 files are written; an error is a row, not a failure.
    mode is in-place for a file that may be written (``writable``, else all), download for others.
    """
    fields = [c for c in codecs.FIELD_FRAMES if c != "bpm" and c in files.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if not r.path.lower().endswith(".mp3"):
                    rows.append((r.path, None, "skipped", None, None))
                    continue
                try:
                    content = bytes(r.content)
                    edits = {c: str(v) for c in fields if (v := getattr(r, c)) is not None}
                    if fields:
                        content = codecs.standard_tag(content, edits | {"bpm": str(math.floor(float(r.bpm) + 0.5))})
                    cues = [dict(index=i, position_ms=1000 * float(c)) for i, c in enumerate(r.cues if r.cues is not None else [])]
                    frames = codecs.payloads(float(r.bpm), [float(b) for b in r.beats], cues)
                    rows.append((r.path, codecs.inject_geob(content, frames), "ok", None, "in-place" if r.writable else "download"))
                except Exception as e:  # noqa: BLE001  a broken file is reported and the batch goes on
                    rows.append((r.path, None, "failed", str(e), None))
            yield pd.DataFrame(rows, columns=["path", "content", "status", "error", "mode"])

    writable = F.col("writable") if "writable" in files.columns else F.lit(True)
    chosen = files.select("path", "content", "bpm", "beats", "cues", *fields, F.coalesce(writable, F.lit(False)).alias("writable"))
    return chosen.mapInPandas(run, "path string, content binary, status string, error string, mode string")


def write_summary(writes: DataFrame) -> DataFrame:
    """One row: how many were written, failed and skipped, and the mode if all written ones share it."""
    count = lambda status: F.count_if(F.col("status") == status).alias(status)
    return writes.agg(count("ok"), count("failed"), count("skipped"), F.when(F.min("mode") == F.max("mode"), F.min("mode")).alias("mode"))


def rename_plan(tracks: DataFrame, rendered: Column) -> DataFrame:
    """(track_id, old_path, new_path, status): unchanged, collision (the target exists or is wanted twice) or rename."""
    name = new_name(F.col("file_path"), rendered)
    folder = F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1)
    plan = tracks.select("track_id", F.col("file_path").alias("old_path"), F.concat(folder, name).alias("new_path"))
    wanted = plan.where("new_path <> old_path").groupBy("new_path").agg(F.count("*").alias("n"))
    taken = tracks.select(F.col("file_path").alias("new_path"), F.lit(True).alias("taken")).distinct()
    rows = plan.join(wanted, "new_path", "left").join(taken, "new_path", "left")
    clash = (F.col("n") > 1) | F.col("taken")
    return rows.select("track_id", "old_path", "new_path", F.when(F.col("new_path") == F.col("old_path"), "unchanged").when(clash, "collision").otherwise("rename").alias("status"))

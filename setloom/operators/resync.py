"""Bringing stored tempos in line with tags and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.functions.text import bpm_from_name
from setloom.operators.series import beat_times

# What counts as a change.
TAG_BPM, TAG_ANCHOR, NAME_BPM = 0.05, 0.01, 0.75


def resync_plan(library: DataFrame, tags: DataFrame, name_overrides_equal_tag: bool = True) -> DataFrame:
    """(track_id, source, bpm, first_beat, quality): one row for each analysed mp3; source is tag, name or unchanged.

    ``tags(track_id, tag_bpm, tag_first)``. A tag that differs wins. A tag that equals what is
    stored leaves the decision to the name, unless ``name_overrides_equal_tag`` is off.
    """
    rows = library.where(F.lower("file_path").endswith(".mp3") & F.col("bpm").isNotNull()).join(tags, "track_id", "left")
    moved = (F.abs(F.col("tag_bpm") - F.col("bpm")) >= TAG_BPM) | (F.abs(F.col("tag_first") - F.col("first_beat")) >= TAG_ANCHOR)
    by_tag = F.col("tag_bpm").isNotNull() & F.coalesce(moved, F.lit(False))
    named = bpm_from_name(F.concat_ws(" ", "file_path", "title"))["bpm"]
    allowed = F.lit(True) if name_overrides_equal_tag else F.col("tag_bpm").isNull()
    by_name = ~by_tag & allowed & F.coalesce(F.abs(named - F.col("bpm")) >= NAME_BPM, F.lit(False))
    source = F.when(by_tag, "tag").when(by_name, "name").otherwise("unchanged")
    bpm = F.when(by_tag, F.col("tag_bpm")).when(by_name, named.cast("double")).otherwise(F.col("bpm"))
    first = F.when(by_tag, F.coalesce("tag_first", "first_beat")).otherwise(F.col("first_beat"))
    better = F.when((by_tag | by_name) & (F.col("quality") == "unreliable"), "partial").otherwise(F.col("quality"))
    return rows.select("track_id", source.alias("source"), bpm.alias("bpm"), first.alias("first_beat"), better.alias("quality"), "duration_sec")


def rebuilt_grids(plan: DataFrame) -> DataFrame:
    """Changed rows of a plan with their new beats."""
    return plan.where("source <> 'unchanged'").withColumn("beats", beat_times(F.col("first_beat"), F.col("bpm"), F.col("duration_sec")))

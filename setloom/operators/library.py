"""Library store and library queries: listing, filters, sorts, edits, imports, playlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setloom.functions.text import is_audio, is_hidden, matches

SORT_DEFAULTS = {"title": "", "artist": "", "album": "", "genre": "", "camelot": "", "bpm": 0.0, "energy_mean": 0.0, "duration_sec": 0.0, "added_at": 0}


def analyzed(tracks: DataFrame, analyses: DataFrame) -> DataFrame:
    """Every track with its analysis, if it has one."""
    return tracks.join(analyses, "track_id", "left")


def listing(tracks: DataFrame, analyses: DataFrame) -> DataFrame:
    return analyzed(tracks, analyses).orderBy(F.desc_nulls_last("added_at"), "ord")


def filtered(df: DataFrame, needle: str, columns: tuple[str, ...] = ("title", "artist", "album", "genre", "camelot")) -> DataFrame:
    return df.where(matches(needle, *[F.col(c) for c in columns]))


def addable(df: DataFrame, needle: str) -> DataFrame:
    """What a set may take: analysed tracks whose title or artist has the needle."""
    return filtered(df.where(F.col("quality").isNotNull()), needle, ("title", "artist"))


def sort_key(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(SORT_DEFAULTS[column]))


def sorted_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Ties keep their order, also when descending; missing text sorts as empty, a missing number as 0."""
    key = sort_key(column)
    if isinstance(SORT_DEFAULTS[column], str):
        key = F.collate(key, "UNICODE")
    return df.orderBy(key.desc() if descending else key.asc(), "ord")


def status_counts(df: DataFrame) -> DataFrame:
    """Tracks by quality; those without an analysis count as 'none'."""
    return df.groupBy(F.coalesce("quality", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


def import_plan(incoming: DataFrame, tracks: DataFrame, path: str = "file_path") -> DataFrame:
    """``incoming`` with status: ignored (hidden or no audio name), skipped (path known), added.

    The known paths come by an equi-join on a hash-partitioned key, not by a lookup per row.
    """
    known = tracks.select(F.col(path).alias("_known")).distinct()
    seen = incoming.join(known, incoming[path] == F.col("_known"), "left")
    usable = is_audio(F.col(path)) & ~is_hidden(F.col(path))
    return seen.withColumn("status", F.when(~usable, "ignored").when(F.col("_known").isNotNull(), "skipped").otherwise("added")).drop("_known")


def content_id(content: Column) -> Column:
    """Hex SHA-1 of the first 256 KiB."""
    return F.sha1(F.substring(content.cast("binary"), 1, 262144))


def native_hash(path: Column) -> Column:
    """The hash of tracks imported by path: a tag and the last 32 characters."""
    return F.concat(F.lit("native:"), F.right(path, F.lit(32)))


def edited_text(column: str, value: Column) -> Column:
    """What an inline edit stores: trimmed; an empty title or artist becomes Unknown."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(text == "", F.lit("Unknown" if column in ("title", "artist") else "")).otherwise(text)


def edited(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.withColumn(column, edited_text(column, F.lit(value)))


def bulk_edit(df: DataFrame, selected: DataFrame, patch: dict[str, str], key: str = "track_id") -> DataFrame:
    """Set the patch's columns on selected rows; a blank value changes nothing."""
    chosen = selected.select(key).distinct().withColumn("_chosen", F.lit(True))
    out = df.join(chosen, key, "left")
    for column, value in patch.items():
        if value.strip():
            out = out.withColumn(column, F.when(F.col("_chosen"), F.lit(value.strip())).otherwise(F.col(column)))
    return out.drop("_chosen")


def orphans(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Tracks without a file whose path is not absolute."""
    return tracks.join(files, "track_id", "left_anti").where(~F.col("file_path").startswith("/"))


def upsert(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` replace those of equal key; of several with one key the last by ``ord`` counts."""
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "ord").alias("_r")).select("_r.*")
    return df.join(latest, key, "left_anti").unionByName(latest, allowMissingColumns=True)


def delete_cascade(keys: DataFrame, *tables: DataFrame, key: str = "track_id") -> list[DataFrame]:
    return [t.join(keys.select(key).distinct(), key, "left_anti") for t in tables]


def cleared(*tables: DataFrame) -> list[DataFrame]:
    """The stores without their rows, schemas kept; written over the stores they clear them."""
    return [t.where(F.lit(False)) for t in tables]


def known_paths(paths: DataFrame, tracks: DataFrame, path: str = "file_path") -> DataFrame:
    """``paths`` with known: whether the library has a track of that path."""
    have = tracks.select(path).distinct().withColumn("known", F.lit(True))
    return paths.join(have, path, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def toggled(selection: DataFrame, ids: DataFrame) -> DataFrame:
    """(track_id) of either but not both: what was selected no longer is, what wasn't is."""
    both = selection.select("track_id", F.lit(1).alias("w")).unionByName(ids.select("track_id", F.lit(2).alias("w")))
    return both.groupBy("track_id").agg(F.bit_or("w").alias("w")).where("w < 3").select("track_id")


def toggled_all(selection: DataFrame, tracks: DataFrame) -> DataFrame:
    """Every track, or none if as many are selected already; two counts meet as one row each."""
    counts = selection.agg(F.count("*").alias("n")).crossJoin(F.broadcast(tracks.agg(F.count("*").alias("m"))))
    return tracks.select("track_id").crossJoin(F.broadcast(counts)).where("n <> m").select("track_id")


def range_selection(df: DataFrame, first: str, last: str) -> DataFrame:
    """Rows between two ids in store order (newest first), whichever comes first."""
    ends = df.where(F.col("track_id").isin(first, last)).agg(F.min(F.struct(-F.col("added_at"), "ord")).alias("lo"), F.max(F.struct(-F.col("added_at"), "ord")).alias("hi"))
    at = F.struct(-F.col("added_at"), F.col("ord"))
    return df.crossJoin(F.broadcast(ends)).where((at >= F.col("lo")) & (at <= F.col("hi"))).drop("lo", "hi")


def resolve_ids(listed: DataFrame, tracks: DataFrame, group: str) -> DataFrame:
    """Listed ids that the library still has, in order: (group, pos, track_id)."""
    return listed.join(tracks.select("track_id"), "track_id", "left_semi").select(group, "pos", "track_id")


def saved_playlist(queue: DataFrame, group: str) -> DataFrame:
    """(group, track_ids) in queue order; an empty queue makes no playlist."""
    return queue.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "track_id"))), lambda x: x["track_id"]).alias("track_ids"))


def listed_playlists(playlists: DataFrame) -> DataFrame:
    """The latest changed first; of equal times the higher key."""
    return playlists.orderBy(F.desc("updated_at"), F.desc("playlist_id"))


def without_playlists(playlists: DataFrame, gone: DataFrame) -> DataFrame:
    return playlists.join(gone.select("playlist_id").distinct(), "playlist_id", "left_anti")


def loaded_playlist(playlists: DataFrame, tracks: DataFrame, group: str) -> DataFrame:
    listed = playlists.select(group, F.posexplode("track_ids").alias("pos", "track_id"))
    kept = resolve_ids(listed, tracks, group)
    place = F.row_number().over(W.partitionBy(group).orderBy("pos")) - 1
    return kept.withColumn("pos", place.cast("long"))

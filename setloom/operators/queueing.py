"""Queue set semantics: keyed rows (queue_id, pos, track_id) with unique ids and dense positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def renumbered(df: DataFrame, order: list[Column | str], group: str = "queue_id") -> DataFrame:
    place = F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1
    return df.select(group, place.cast("long").alias("pos"), "track_id")


def appended(queue: DataFrame, batch: DataFrame, group: str = "queue_id") -> DataFrame:
    """Ids of ``batch`` behind the queue; those already there, or earlier in the batch, are left out."""
    rows = queue.select(group, F.lit(0).alias("part"), "pos", "track_id").unionByName(batch.select(group, F.lit(1).alias("part"), "pos", "track_id"))
    first = rows.groupBy(group, "track_id").agg(F.min(F.struct("part", "pos")).alias("at"))
    return renumbered(first, ["at.part", "at.pos"], group)


def deduped(queue: DataFrame, group: str = "queue_id") -> DataFrame:
    first = queue.groupBy(group, "track_id").agg(F.min("pos").alias("at"))
    return renumbered(first, ["at"], group)


def removed(queue: DataFrame, ids: DataFrame, group: str = "queue_id") -> DataFrame:
    return renumbered(queue.join(ids, [group, "track_id"], "left_anti"), ["pos"], group)


def moved(queue: DataFrame, source: int, target: int, group: str = "queue_id") -> DataFrame:
    """The id at ``source`` goes to ``target``; what lies between shifts by one. Positions outside the queue change nothing."""
    sizes = queue.groupBy(group).agg(F.count("*").alias("n"))
    rows = queue.join(sizes, group)
    step = 1 if source < target else -1
    low, high = min(source, target), max(source, target)
    shifted = F.when(F.col("n") <= high, F.col("pos")).when(F.col("pos") == source, F.lit(target)).when(F.col("pos").between(low, high), F.col("pos") - step).otherwise(F.col("pos"))
    return rows.select(group, shifted.cast("long").alias("pos"), "track_id")


def inserted_head(queue: DataFrame, heads: DataFrame, group: str = "queue_id") -> DataFrame:
    """``heads(group, track_id)`` in front, and not again behind."""
    rest = queue.join(heads, [group, "track_id"], "left_anti").select(group, F.lit(1).alias("part"), "pos", "track_id")
    front = heads.select(group, F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), "track_id")
    return renumbered(front.unionByName(rest), ["part", "pos"], group)


def drained(queue: DataFrame, played: DataFrame, current: DataFrame, group: str = "queue_id") -> DataFrame:
    """Without the played ids, but with the current one."""
    gone = played.join(current, [group, "track_id"], "left_anti")
    return removed(queue, gone, group)


def popped(queue: DataFrame, group: str = "queue_id") -> tuple[DataFrame, DataFrame]:
    """The heads (group, track_id), and the queues without them."""
    heads = queue.where("pos = 0").select(group, "track_id")
    rest = queue.where("pos > 0").select(group, (F.col("pos") - 1).alias("pos"), "track_id")
    return heads, rest


def next_unplayed(queue: DataFrame, played: DataFrame, group: str = "queue_id") -> DataFrame:
    """The first id of each queue that is not among ``played(track_id)``; none if all are."""
    left = queue.join(played.select("track_id").distinct(), "track_id", "left_anti")
    return left.groupBy(group).agg(F.min_by("track_id", "pos").alias("track_id"), F.min("pos").alias("pos"))

"""What to play next: scores against a current track, tiers, suggestions, queue order.

The current track and its history are one row, whatever the library's size: it is broadcast,
the candidates are scored in one projection, and the best few come from a partial top-k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setloom.functions import scoring as S

#: Tracks of one queue that are put in order together.
MOST_QUEUED = 2000
PARTS = ("bpm", "key", "energy", "variety", "quality", "recency")


def recent_context(history: DataFrame, tracks: DataFrame, session: str = "session_id") -> DataFrame:
    """Per session: the last five artists and genres, the last position of every track, and the number of plays.

    Plays of tracks outside ``tracks`` don't count and shorten distances.
    """
    kept = history.join(tracks.select("track_id", "artist", "genre"), "track_id")
    place = kept.withColumn("pos", F.row_number().over(W.partitionBy(session).orderBy("pos")) - 1)
    last = W.partitionBy(session).orderBy(F.desc("pos"))
    five = place.withColumn("back", F.row_number().over(last) - 1)
    return five.groupBy(session).agg(
        F.collect_list(F.when(F.col("back") < 5, F.struct("artist", "genre"))).alias("last5"),
        F.count("*").alias("plays"),
    )


def distances(history: DataFrame, tracks: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, track_id, distance): plays since the last one of the track; 0 is the latest."""
    kept = history.join(tracks.select("track_id"), "track_id", "left_semi")
    back = F.row_number().over(W.partitionBy(session).orderBy(F.desc("pos"))) - 1
    return kept.withColumn("back", back).groupBy(session, "track_id").agg(F.min("back").alias("distance"))


def same_counts(last5: Column, artist: Column, genre: Column) -> tuple[Column, Column]:
    same_artist = F.size(F.filter(last5, lambda x: x["artist"] == artist))
    same_genre = F.size(F.filter(last5, lambda x: (F.coalesce(x["genre"], F.lit("")) != "") & (x["genre"] == genre)))
    return same_artist, same_genre


def scored(candidates: DataFrame, current: DataFrame, distance: DataFrame | None, target: float = 0.5) -> DataFrame:
    """``candidates`` (analysed library rows) with the six parts and score against the one row of ``current``.

    ``current`` has cur_id, cur_bpm, cur_camelot, cur_key_confidence and last5; ``distance``
    has track_id and distance, without it nothing was played.
    """
    rows = candidates.crossJoin(F.broadcast(current)).where("track_id <> cur_id")
    rows = rows.withColumn("distance", F.lit(None).cast("long")) if distance is None else rows.join(distance.select("track_id", "distance"), "track_id", "left")
    artist, genre = same_counts(F.col("last5"), F.col("artist"), F.col("genre"))
    parts = {
        "bpm": S.bpm_score(F.col("cur_bpm"), F.col("bpm")),
        "key": S.key_score(F.col("cur_camelot"), F.col("cur_key_confidence"), F.col("camelot"), F.col("key_confidence")),
        "energy": S.energy_score(F.col("energy_mean"), F.lit(target)),
        "variety": S.variety_score(artist, genre),
        "quality": S.quality_score(F.col("quality")),
        "recency": S.recency_penalty(F.col("distance")),
    }
    out = rows.withColumns({f"part_{k}": v for k, v in parts.items()})
    # ranks are decided on nine decimals and the order of the library, so that no last bit can swap a tie
    return out.withColumn("score", F.round(S.total({k: F.col(f"part_{k}") for k in PARTS}), 9))


def current_row(library: DataFrame, track_id: str, history: DataFrame | None = None) -> DataFrame:
    """The one row of ``current`` for ``scored``; ``history(pos, artist, genre)`` ends with the latest play."""
    chosen = library.where(F.col("track_id") == track_id).select(
        F.col("track_id").alias("cur_id"), F.col("bpm").alias("cur_bpm"), F.col("camelot").alias("cur_camelot"), F.col("key_confidence").alias("cur_key_confidence")
    )
    if history is None:
        return chosen.withColumn("last5", F.array().cast("array<struct<artist:string,genre:string>>"))
    last = history.orderBy(F.desc("pos")).limit(5).agg(F.collect_list(F.struct("artist", "genre")).alias("last5"))
    return chosen.crossJoin(F.broadcast(last))


def top(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "ord").limit(k)


def pick_next(rows: DataFrame) -> DataFrame:
    """One row: the normal, relaxed-bpm or forced choice with mode and reason; an empty pool gives none.

    Each tier is the best by (score, order) under its condition: three maxima in one aggregate.
    """
    best = F.struct(F.col("score").alias("s"), (-F.col("ord")).alias("o"))
    row = F.struct("track_id", "score", *[f"part_{k}" for k in PARTS])
    usable = F.col("part_recency") < 1
    close = usable & (F.abs(F.coalesce("bpm", F.lit(S.DEFAULT_BPM)) - F.coalesce("cur_bpm", F.lit(S.DEFAULT_BPM))) < S.RELAXED_BPM)
    tiers = rows.agg(
        F.max_by(F.when(usable, row), F.when(usable, best)).alias("normal"),
        F.max_by(F.when(close, row), F.when(close, best)).alias("relaxed"),
        F.max_by(row, best).alias("forced"),
    )
    accepted = F.col("normal.score") >= S.ACCEPT
    mode = F.when(accepted, "normal").when(F.col("relaxed").isNotNull(), "relaxed-bpm").otherwise("forced")
    picked = F.when(accepted, F.col("normal")).when(F.col("relaxed").isNotNull(), F.col("relaxed")).otherwise(F.col("forced"))
    out = tiers.where("forced is not null").select(mode.alias("mode"), picked.alias("p")).select("mode", "p.*")
    return out.withColumn("reason", S.reason(F.col("mode"), {k: F.col(f"part_{k}") for k in PARTS}))


def pair_score(a: str, b: str) -> Column:
    """The score of row b after row a with an empty history but a: for columns prefixed a_ and b_."""
    col = lambda p, c: F.col(f"{p}{c}")
    same_artist = F.when(col(a, "artist") == col(b, "artist"), 1).otherwise(0)
    same_genre = F.when((F.coalesce(col(a, "genre"), F.lit("")) != "") & (col(a, "genre") == col(b, "genre")), 1).otherwise(0)
    parts = {
        "bpm": S.bpm_score(col(a, "bpm"), col(b, "bpm")),
        "key": S.key_score(col(a, "camelot"), col(a, "key_confidence"), col(b, "camelot"), col(b, "key_confidence")),
        "energy": S.energy_score(col(b, "energy_mean"), F.lit(0.5)),
        "variety": S.variety_score(same_artist, same_genre),
        "quality": S.quality_score(col(b, "quality")),
        "recency": F.when(col(a, "track_id") == col(b, "track_id"), 1.0).otherwise(0.0),
    }
    return F.round(S.total(parts), 9)


FIELDS = ("track_id", "artist", "genre", "bpm", "camelot", "key_confidence", "energy_mean", "quality")


def prefixed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in FIELDS])


def queue_scores(queue: DataFrame, library: DataFrame, group: str = "queue_id") -> DataFrame:
    """Each queued track's match with the one before it, from 0 to 1; null if either lacks an analysis."""
    rows = queue.join(library, "track_id")
    before = W.partitionBy(group).orderBy("pos")
    lagged = rows.withColumns({f"a_{c}": F.lag(c).over(before) for c in FIELDS}).withColumns({f"b_{c}": F.col(c) for c in FIELDS})
    lagged = lagged.withColumn("a_artist", F.lit(None).cast("string")).withColumn("a_genre", F.lit(None).cast("string"))  # no history
    # with no history the previous track does not count as played
    score = pair_score("a_", "b_") + F.when(F.col("a_track_id") == F.col("b_track_id"), S.WEIGHTS["recency"]).otherwise(0.0)
    known = F.col("a_quality").isNotNull() & F.col("b_quality").isNotNull()
    return lagged.select(group, "pos", "track_id", F.when(known, S.queue_match(score)).alias("match"))


def pair_scores(members: DataFrame, group: str) -> DataFrame:
    """(group, a, b, a_ord, b_ord, score) for ordered pairs within one queue, never across the library."""
    a, b = prefixed(members, "a_", group, F.col("pos").alias("a_pos")), prefixed(members, "b_", group, F.col("pos").alias("b_pos"))
    return a.join(b, group).where("a_pos <> b_pos").select(group, "a_pos", "b_pos", F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), pair_score("a_", "b_").alias("score"))


def hub_seed(members: DataFrame, group: str) -> DataFrame:
    """The member of each queue with the highest mean score towards the others; the earliest of equals.

    Scores are added from the queue's end to its start, as SQL's hash join meets them: the last bit
    of a sum decides means that lie on half of the ninth decimal, so no order of arrival may.
    """
    others = F.collect_list(F.when(F.col("score").isNotNull(), F.struct("b_pos", "score")))
    rows = pair_scores(members, group).groupBy(group, "a", "a_pos").agg(F.sort_array(others, False).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x["score"])
    means = rows.select(group, "a", "a_pos", S.rounded(F.try_divide(total, F.size("p")), 9).alias("mean"))
    return means.groupBy(group).agg(F.max_by("a", F.struct("mean", (-F.col("a_pos")).alias("o"))).alias("track_id"), F.max("mean").alias("mean"))


def smart_reorder(members: DataFrame, group: str, anchors: DataFrame | None = None) -> DataFrame:
    """Greedy order of each queue: (group, place, track_id); each next one is the best after the one before, the earliest of equals.

    It starts with the best after the queue's row of ``anchors`` (group and the columns of a
    track), or without one with the hub, as ``hub_seed`` has it. A queue of one track stays as it
    is. Scores are column expressions; a queue's are then one matrix in one row, walked in time
    n^2, many queues a batch. A queue is a person's list: one beyond MOST_QUEUED tracks is an error.
    """
    listed = members.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "track_id"))).alias("m"))
    too_long = F.raise_error(F.concat(F.lit(f"more than {MOST_QUEUED} tracks in queue "), F.col(group).cast("string"))).cast("long")
    sizes = members.groupBy(group).agg(F.count("*").alias("n")).select(group, F.when(F.col("n") > MOST_QUEUED, too_long).otherwise(F.col("n")).alias("n"))
    some = members.join(sizes.where("n > 1").select(group), group)
    pairs = pair_scores(some, group).groupBy(group).agg(F.collect_list(F.struct("a_pos", "b_pos", "score")).alias("p"))
    rows = listed.join(pairs, group, "left")
    if anchors is None:
        rows = rows.withColumn("anchored", F.lit(None).cast("string"))
    else:
        after = prefixed(anchors, "a_", group).join(prefixed(members, "b_", group, F.col("pos").alias("b_pos")), group)
        best = after.groupBy(group).agg(F.max_by("b_track_id", F.struct(pair_score("a_", "b_").alias("s"), (-F.col("b_pos")).alias("o"))).alias("anchored"))
        rows = rows.join(best, group, "left")

    def order(places: np.ndarray, a_pos: np.ndarray, b_pos: np.ndarray, score: np.ndarray, first: int | None) -> list[int]:
        n = len(places)
        if n == 1:
            return [0]
        matrix = np.full((n, n), -np.inf)
        matrix[np.searchsorted(places, a_pos), np.searchsorted(places, b_pos)] = score
        if first is None:
            means = np.where(np.isinf(matrix), 0.0, matrix)[:, ::-1].cumsum(axis=1)[:, -1] / (n - 1)  # added one by one from the end, as in hub_seed
            first = int(np.floor(means * 1e9 + 0.5).argmax())
        out = [first]
        while len(out) < n:
            matrix[:, out[-1]] = -np.inf
            out.append(int(matrix[out[-1]].argmax()))
        return out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, p = batch.column("m"), pc.fill_null(pc.list_value_length(batch.column("p")), 0).to_numpy()
            ids, places = m.flatten().field("track_id").to_pylist(), m.flatten().field("pos").to_numpy()
            flat = batch.column("p").flatten()
            a_pos, b_pos, score = (flat.field(c).to_numpy() for c in ("a_pos", "b_pos", "score"))
            ends, after = np.cumsum(pc.list_value_length(m).to_numpy()), np.cumsum(p)
            which, place, track = [], [], []
            for k, (end, pair, anchored) in enumerate(zip(ends.tolist(), after.tolist(), batch.column("anchored").to_pylist())):
                own, low = ids[ends[k - 1] if k else 0 : end], pair - p[k]
                walked = order(places[end - len(own) : end], a_pos[low:pair], b_pos[low:pair], score[low:pair], None if anchored is None else own.index(anchored))
                which += [k] * len(own)
                place += range(len(own))
                track += [own[i] for i in walked]
            yield pa.record_batch([batch.column(0).take(pa.array(which, pa.int64())), pa.array(place, pa.int32()), pa.array(track, pa.string())], names=[group, "place", "track_id"])

    kind = members.schema[group].dataType.simpleString()
    return rows.select(group, "m", "p", "anchored").mapInArrow(walk, f"`{group}` {kind}, place int, track_id string")


def unheard(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Scored candidates that the history does not hold at all: the pool of a recommendation on demand."""
    return rows.join(history.select("track_id").distinct(), "track_id", "left_anti")


def next_track(queued: DataFrame, picked: DataFrame) -> DataFrame:
    """One row (source, track_id): the first queued and unplayed track, else the pick; none without either."""
    both = queued.select(F.lit(0).alias("tier"), F.lit("queue").alias("source"), "track_id").unionByName(picked.select(F.lit(1).alias("tier"), F.lit("pick").alias("source"), "track_id"))
    return both.agg(F.min(F.struct("tier", "source", "track_id")).alias("r")).where("r is not null").select("r.source", "r.track_id")


def selectable(library: DataFrame, queue: DataFrame) -> DataFrame:
    """Analysed tracks that are not queued yet."""
    return library.where(F.col("quality").isNotNull()).join(queue.select("track_id").distinct(), "track_id", "left_anti")

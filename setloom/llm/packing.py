"""Packing documents into fixed-size sequences by non-negative least squares over length patterns.

Only a histogram of lengths, at most ``capacity`` rows, reaches the driver. There, patterns
of up to three lengths get repeat counts by non-negative least squares, the counts are
rounded down and made exact on true lengths, and what remains is packed best-fit, in counts.
The plan is a table of rank ranges per length; every piece finds its sequence by its rank
among the pieces of its length, in one broadcast lookup. No task sees all rows of a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import Written, by_bytes, running
from setloom.llm.tokens import BATCH_BYTES, parts

CAPACITY, END_ID = 4096, 1
#: Classes of length for the patterns that are fitted.
CLASSES = 64


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that nearly minimises |patterns' x - histogram|, by multiplicative updates; patterns (p, classes)."""
    a = patterns.T.astype(float)
    target = a.T @ histogram
    gram = a.T @ a
    x = np.full(len(patterns), histogram.sum() / max(1, patterns.sum()))
    for _ in range(steps):
        x *= target / np.maximum(gram @ x, 1e-12)
    return x


def length_patterns(edges: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per class (p, classes): every two classes that fit at their longest, with the longest third that
    still fits; patterns that would leave a whole class of room are left out."""
    n, out = len(edges), []
    for i in range(n):
        for j in range(i, n):
            if edges[i] + edges[j] > capacity:
                continue
            room = capacity - edges[i] - edges[j]
            k = np.searchsorted(edges, room, "right") - 1
            row = np.zeros(n)
            row[i] += 1
            row[j] += 1
            if k >= 0:
                row[k] += 1
                room -= edges[k]
            if room < capacity // CLASSES and (k < 0 or k >= j):
                out.append(row)
    return np.array(out) if out else np.zeros((0, n))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the sequences that hold exactly the pieces of the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    done: list[tuple[int, tuple[int, ...]]] = []
    if left[capacity]:
        done.append((int(left[capacity]), (capacity,)))
        left[capacity] = 0
    open_: dict[tuple[int, ...], int] = {}
    step = -(-capacity // CLASSES)
    class_of = np.minimum((np.arange(capacity + 1) - 1) // step, CLASSES - 1)
    used = np.unique(class_of[np.flatnonzero(left)])
    if len(used):
        edges = np.minimum((used + 1) * step, capacity)
        patterns = length_patterns(edges, capacity)
        sizes = np.array([left[class_of == c].sum() for c in used], float)
        if len(patterns):
            counts = np.floor(fit_counts(patterns, sizes)).astype(np.int64)
            for p in np.argsort(-counts, kind="stable"):
                classes = [c for c, m in zip(used[::-1], patterns[p][::-1].astype(int)) for _ in range(m)]
                todo = int(counts[p])
                while todo > 0:
                    take: list[int] = []
                    room = capacity
                    for i, c in enumerate(classes):
                        # the last may be longer than its class: the closest fit to the room that is left
                        low, high = c * step + 1, room if i + 1 == len(classes) else min((c + 1) * step, room)
                        have = left[low : high + 1].copy()
                        for t in take:
                            if low <= t <= high:
                                have[t - low] -= 1
                        found = np.flatnonzero(have > 0)
                        if not len(found):
                            break
                        take.append(low + int(found[-1]))
                        room -= take[-1]
                    if len(take) < len(classes):
                        break
                    lengths, many = np.unique(take, return_counts=True)
                    n = min(todo, int((left[lengths] // many).min()))
                    left[lengths] -= n * many
                    key = tuple(take)
                    open_[key] = open_.get(key, 0) + n
                    todo -= n
    # residuals: longest first, each into the fullest open sequence that has room
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((lengths, n))

    for lengths, n in open_.items():
        put(lengths, n)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                    n %= each
                else:
                    put((length,) * n, 1)
                    n = 0
                continue
            room = rooms[at]
            lengths, m = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            fit = max(1, min(room // length, n // m if n >= m else 1))
            take = min(m, n // fit)
            if m > take:
                put(lengths, m - take)
            put(lengths + (length,) * fit, take)
            n -= take * fit
    return done + [(n, lengths) for group in by_room.values() for lengths, n in group]


def ranges(sequences: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the pieces of each length go by rank."""
    out, at, first = [], {}, 0
    for n, lengths in sequences:
        offset = 0
        for length in lengths:
            rank = at.get(length, 0)
            out.append((length, rank, rank + n, first, offset))
            at[length] = rank + n
            offset += length
        first += n
    return out


def pieces(df: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): token ids, an end id, cut into pieces of ``capacity``."""
    kind = df.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def cut(texts: pa.Array, first: int) -> np.ndarray:
        """(row, piece, start, length, crc) of the pieces of some rows, the first of which is ``first``."""
        ids, sizes = parts(tokenizer, False).encode(texts)
        view, ends = memoryview(ids.tobytes()), np.cumsum(sizes)
        many = sizes // capacity + 1  # the end id is a token more
        row = np.repeat(np.arange(len(sizes)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        length = np.minimum(sizes[row] + 1 - start, capacity)
        whole = start + length <= sizes[row]  # without the end id
        low = (ends - sizes)[row] + start
        high = low + length - ~whole
        crc = [zlib.crc32(view[4 * a : 4 * b]) if w else zlib.crc32(end, zlib.crc32(view[4 * a : 4 * b])) for a, b, w in zip(low.tolist(), high.tolist(), whole.tolist())]
        return np.stack([row + first, piece, start, length, np.array(crc, np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for part in by_bytes(batch, 1, BATCH_BYTES):
                which, piece, start, length, crc = cut(part.column(1), first)
                first += part.num_rows
                yield pa.record_batch([batch.column(0).take(pa.array(which)), *map(pa.array, (piece.astype(np.int32), start, length, crc))], names=[id_col, "piece", "start", "length", "ids_crc32"])

    chosen = df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Place every document's pieces in sequences of at most ``capacity`` tokens.

    Returns per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset. A null
    or empty text is the end id alone; a null id and repeated rows are documents like any
    other; equal lengths are interchangeable, so which of them shares a sequence is set by a
    hash and the id; an empty table gives an empty one; other columns are not read. Tokens
    are counted once: the pieces are written, then the histogram and the ranks read them.
    """
    spark = df.sparkSession
    cut = Written(pieces(df, tokenizer, text, id_col, capacity), "pieces").df
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = ranges(plan(histogram, capacity))
    where = spark.createDataFrame(
        pa.table({n: pa.array([r[i] for r in table], pa.int64()) for i, n in enumerate(("length", "low", "high", "first", "offset"))})
    )
    spin = F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(1 << 32))
    ranked = running(cut.withColumn("_one", F.lit(1).cast("long")).withColumn("_spin", spin), ["length"], "_spin", [id_col, "piece", "ids_crc32"], "_one", "rank")
    # at most a few ranges a pattern and length: bounded by the capacity, not by the rows
    placed = ranked.join(F.broadcast(where.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")

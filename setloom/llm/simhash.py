"""SimHash fingerprints and exact Hamming-radius linking by BK-trees.

Scale: fingerprints come from one narrow pass over the texts. Distinct fingerprints only
are linked. Two of them within ``radius`` bits agree on at least k of radius + k equal bit
blocks, so each fingerprint goes to one shard for every choice of k blocks, and a BK-tree
of each shard finds its links; k grows with the number of fingerprints so that a shard
stays small. The method names broadcast shard trees: a broadcast passes through the driver
and all trees together hold all fingerprints, which grow with the corpus. So the fingerprints
of a shard meet by a shuffle, and each shard's tree is built and searched in the task that
holds the shard. Links leave a shard as spanning edges, fewer than its members. A full shard is
dealt again by its members' other bits, in the same way, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import Scratch, Written, arrow_rows, components, sorted_groups

SEED = 42
#: Members beyond which a shard is dealt again, and the blocks of its other bits that must agree.
FULL, AGAIN = 4096, 2


def fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash of word shingles; 0 without a word."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return int.from_bytes(xxh64_digest(b" ".join(words), SEED))
    buffer = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - width + 1].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        some = starts[at : at + (1 << 16)]
        digests = b"".join([xxh64_digest(buffer[a:b], SEED) for a, b in zip(some, ends[at + width - 1 : at + width - 1 + len(some)].tolist())])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes())


def fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4) -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed long. Null text counts as empty: 0."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return arrow_rows(df, [F.col(id_col), F.col(text).cast("string")], run, f"`{id_col}` {kind}, fp long")


class BKTree:
    """A BK-tree over distinct integers: a child hangs at its Hamming distance to the parent.

    ``take(x)`` removes and returns every member within the radius of x, following only
    edges within the radius of the distance at hand and only into subtrees with members left.
    """

    def __init__(self, values: list[int], radius: int):
        self.values, self.radius = values, radius
        self.up = [-1] * len(values)
        self.edges: list[dict[int, int]] = [{} for _ in values]
        self.left = [1] * len(values)
        self.gone = [False] * len(values)
        for i in range(1, len(values)):
            at, x = 0, values[i]
            while True:
                d = (values[at] ^ x).bit_count()
                self.left[at] += 1
                child = self.edges[at].get(d)
                if child is None:
                    self.edges[at][d] = i
                    self.up[i] = at
                    break
                at = child

    def remove(self, i: int) -> None:
        self.gone[i] = True
        while i >= 0:
            self.left[i] -= 1
            i = self.up[i]

    def take(self, x: int) -> list[int]:
        values, edges, left, gone, radius = self.values, self.edges, self.left, self.gone, self.radius
        found, stack = [], [0] if left[0] else []
        while stack:
            i = stack.pop()
            d = (values[i] ^ x).bit_count()
            if d <= radius and not gone[i]:
                found.append(i)
            if e := edges[i]:
                if len(e) <= 2 * radius + 1:
                    stack += [c for k, c in e.items() if -radius <= k - d <= radius and left[c]]
                else:
                    stack += [c for k in range(d - radius, d + radius + 1) if (c := e.get(k)) is not None and left[c]]
        for i in found:
            self.remove(i)
        return found


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that join what links of at most ``radius`` bits join, fewer than the values."""
    if len(values) == 2:
        a, b = values
        return [(a, b)] if (a ^ b).bit_count() <= radius else []
    tree, out = BKTree(values, radius), []
    for i, x in enumerate(values):
        if tree.gone[i]:
            continue
        tree.remove(i)
        front = [x]
        while front:
            y = front.pop()
            for j in tree.take(y):
                out.append((y, values[j]))
                front.append(values[j])
    return out


def block_choices(n: int, radius: int, most: int = 64) -> list[list[tuple[int, int]]]:
    """Choices of bit blocks (shift, width) to shard by: the fewest for which random shards have about ``most`` members."""
    for k in range(1, 9):
        blocks, at = [], 0
        for i in range(radius + k):
            width = (64 * (i + 1)) // (radius + k) - at
            blocks.append((at, width))
            at += width
        if n <= most << (64 * k // (radius + k)):
            break
    return [list(c) for c in combinations(blocks, k)]


def deal_again(choices: list[list[tuple[int, int]]], radius: int):
    """Shards of the members (choice, key, fp) of full shards: by every choice of AGAIN of radius + AGAIN blocks of the bits left.

    What agrees on a choice's blocks differs in the others alone, in at most ``radius`` bits, so
    two of those blocks agree too.
    """
    rests = []
    for blocks in choices:
        used = {s + i for s, w in blocks for i in range(w)}
        rests.append(np.array_split(np.array([i for i in range(64) if i not in used]), radius + AGAIN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("choice").to_numpy()
            for c in np.unique(of).tolist():
                some = batch.take(pa.array(np.flatnonzero(of == c)))
                fp, key = some.column("fp").to_numpy().view(np.uint64), some.column("key").to_numpy().view(np.uint64)
                parts = []
                for bits in rests[c]:
                    part = np.zeros(len(fp), np.uint64)
                    for i in bits.tolist():
                        part = part << np.uint64(1) | fp >> np.uint64(i) & np.uint64(1)
                    parts.append(part)
                for k, chosen in enumerate(combinations(range(len(parts)), AGAIN)):
                    mixed = key.copy()
                    for i in chosen:
                        mixed = (mixed ^ parts[i]) * np.uint64(0x9E3779B97F4A7C15)
                        mixed ^= mixed >> np.uint64(29)
                    choice = pa.array(np.full(len(fp), len(choices) * (k + 1) + c, np.int32))
                    yield pa.record_batch([choice, pa.array(mixed.view(np.int64)), some.column("fp")], names=["choice", "key", "fp"])

    return run


def hamming_components(fps: DataFrame, radius: int, scratch: Scratch | None = None) -> DataFrame:
    """(fp, root) of every fingerprint of ``fps(fp)`` that links with another one; root is one of its component.

    ``scratch`` holds the tables that are written meanwhile.
    """
    scratch = scratch or Scratch()
    distinct = fps.select("fp").distinct()
    choices = block_choices(distinct.count(), radius)
    keys = []
    for i, blocks in enumerate(choices):
        key, used = F.lit(0).cast("long"), 0
        for shift, width in blocks:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key, used = key.bitwiseOR(F.shiftleft(part, used)), used + width
        keys.append(F.struct(F.lit(i).alias("choice"), key.alias("key")))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[int] = []
        v: list[int] = []
        for group in sorted_groups(batches, ["choice", "key"]):
            if group.num_rows > 1:
                values = group.column("fp").to_numpy().view(np.uint64).tolist()
                for a, b in spanning_links(values, radius):
                    u.append(a)
                    v.append(b)
            if len(u) > 100_000:
                yield edges(u, v)
                u, v = [], []
        yield edges(u, v)

    def edges(u: list[int], v: list[int]) -> pa.RecordBatch:
        signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)]
        return pa.record_batch(signed, names=["u", "v"])

    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("s")).select("s.choice", "s.key", "fp")
    full = scratch.write(dealt.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > FULL).select("choice", "key"), "full-shards")
    if not full.isEmpty():
        again = dealt.join(full, ["choice", "key"], "left_semi").select("choice", "key", "fp").mapInArrow(deal_again(choices, radius), "choice int, key long, fp long")
        dealt = dealt.join(full, ["choice", "key"], "left_anti").select("choice", "key", "fp").unionByName(again)
    dealt = dealt.repartition("choice", "key").sortWithinPartitions("choice", "key")
    links = scratch.write(dealt.mapInArrow(link, "u long, v long"), "shard-links")
    return components(links, scratch).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def simhash_components(df: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """Near-duplicate components: documents whose fingerprints differ in at most ``radius`` bits, transitively.

    Returns a row per row of ``df``: (id_col, fingerprint as 16 hex digits, component_id: the
    least id reachable, its own included). Texts without a word (null, empty, white space)
    have fingerprint zero and link with each other. A null id keeps its row and takes part,
    but is never the least; a component of null ids only has a null component_id. Repeated
    rows and ties share a component. An empty table gives an empty one; other columns are not read.
    """
    docs = Written(fingerprints(df.select(id_col, text), text, id_col, width), "fingerprints")
    nodes = docs.df.groupBy("fp").agg(F.min(id_col).alias("rep"))
    scratch = Scratch()
    linked = scratch.write(hamming_components(docs.df, radius, scratch), "fp-components")
    rooted = nodes.join(linked, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.where("root <> fp or rep is null").select("root").distinct()  # roots with more than their own fingerprint
    many = rooted.join(least, "root", "left_semi")
    roots = many.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_many = many.join(roots, "root").select("fp", "component_id")
    of_one = rooted.join(least, "root", "left_anti").select("fp", F.col("rep").alias("component_id"))
    by_fp = Written(of_one.unionByName(of_many), "fp-ids").df
    scratch.drop()
    return docs.df.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")



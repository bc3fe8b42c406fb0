"""Near-duplicate removal by SimHash candidates and exact shingle similarity.

At a Jaccard similarity of 0.8, 64-bit fingerprints of real texts differ in up to 17 bits,
which no pigeonhole sharding reaches, and shards by sampled bits need ever more tables as the
corpus grows. So this stage takes 128-bit fingerprints and deals them into shards by bands of
min-wise samples of the shingles: BANDS of them at any size. What lies within ``RADIUS`` bits in
a shard's BK-tree joins into coarse groups, and every link inside a coarse group is decided by
the exact Jaccard similarity of the shingle sets. Exact copies collapse first, so a group of
copies costs one member.

Full shards and large groups are split. A full shard's members are also dealt by longer keys,
and any shard that is full is searched in parts that share a few hub members. A large coarse
group is compared in blocks that share hubs; what that leaves apart from the group's largest
component, nothing in a group of near copies, is then compared with every other member. Only
spanning links leave a task.

Fingerprints of few shingles spread wider than RADIUS. So texts of up to SHORT shingles also
meet exactly: sets of that similarity share one of the first shingles, in the order of their
digests, that a set has beyond the overlap it needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import Scratch, Written, components, sorted_groups
from setloom.llm.simhash import SEED, spanning_links

#: Of 128 bits: random texts differ in 64 +- 6, texts of similarity 0.8 in about 20 +- 4.
BITS, RADIUS = 128, 31
#: Sets of similarity s agree on a band's minima with chance s to the power BAND_ROWS: at 0.8 in one band of all with 0.994.
BANDS, BAND_ROWS = 17, 6
#: Members of a shard that one task searches; the bands and minima more of a full shard's longer keys.
FULL, MORE_BANDS, MORE_ROWS = 4096, 6, 4
#: Members that all parts of a shard or blocks of a group share.
HUBS = 4
#: Members of a coarse group, and shingles of them all, that are compared with each other in one task.
BLOCK, BLOCK_SHINGLES = 1000, 1 << 20
#: Shingles up to which a text meets every similar one, whatever the fingerprints.
SHORT = 16


def shingle_digests(text: str | None, width: int) -> np.ndarray:
    """Digests (n, 16) of the distinct word shingles; the whole sequence if it is shorter; none without a word."""
    from xxhash import xxh128_digest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty((0, 16), np.uint8)
    shingles = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.frombuffer(b"".join([xxh128_digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 16)


def gram_set(digests: np.ndarray) -> np.ndarray:
    return np.sort(np.ascontiguousarray(digests[:, :8]).view(np.uint64).ravel())


def wide_fingerprint(digests: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.int64)
    for at in range(0, len(digests), 1 << 15):
        bits += np.unpackbits(digests[at : at + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * bits > len(digests)).tobytes()


#: Odd factors: the order of the products is a random order of the digests, another one for each factor.
FACTORS = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(grams: np.ndarray) -> np.ndarray:
    """Upper halves of the least products of a set's digests, one for each factor."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):
        np.minimum(least, (grams[at : at + 512, None] * FACTORS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(samples: np.ndarray, bands: list[list[int]], seed: np.ndarray | int = 0) -> np.ndarray:
    """(n, bands) keys that mix the named columns of ``samples`` (n, minima) and a seed a row."""
    out = np.empty((len(samples), len(bands)), np.uint64)
    for t, columns in enumerate(bands):
        mixed = np.zeros(len(samples), np.uint64) + np.asarray(seed).astype(np.uint64) + np.uint64(t + 1)
        for c in columns:
            mixed = (mixed ^ samples[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        out[:, t] = mixed
    return out.view(np.int64)


def bands_of() -> list[list[int]]:
    return [list(range(t * BAND_ROWS, (t + 1) * BAND_ROWS)) for t in range(BANDS)]


def more_bands(band: int) -> list[list[int]]:
    """The minima that lengthen a band's key: of other bands, as all of this one's are alike in a shard of it."""
    total, first = BANDS * BAND_ROWS, (band + 1) * BAND_ROWS
    return [[(first + s * MORE_ROWS + j) % total for j in range(MORE_ROWS)] for s in range(MORE_BANDS)]


def _classes(width: int, most: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            same, fps, samples, first, sizes = [], [], [], [], []
            for t in batch.column("text"):
                text = t.as_py()
                words = (text or "").encode().lower().split()
                same.append(xxh3_128_digest(b" ".join(words)))
                d = shingle_digests(text, width)
                grams = gram_set(d)
                fps.append(wide_fingerprint(d))
                samples.append(minima(grams).tobytes() if len(d) else None)
                first.append(grams[: len(d) - math.ceil(similarity * len(d) - 1e-9) + 1].view(np.int64).tolist() if 0 < len(d) <= most else None)
                sizes.append(len(d))
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64())
            yield pa.record_batch([batch.column("row"), *map(pa.array, (same, fps, samples, first, sizes), kinds)], names=["row", "same", "fp", "minima", "first", "size"])

    return run


def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, band, node, fp): each node under its key in every band."""
    for batch in batches:
        n = batch.num_rows
        samples = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(n, -1)
        keys = band_keys(samples, bands_of())
        for t in range(BANDS):
            yield pa.record_batch([pa.array(keys[:, t]), pa.array(np.full(n, t, np.int32)), batch.column("node"), batch.column("fp")], names=["key", "band", "node", "fp"])


def deal_longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``deal``, for the members (key, band, node, fp, minima) of full shards: under the band's longer keys."""
    for batch in batches:
        of = batch.column("band").to_numpy()
        for band in np.unique(of).tolist():
            some = batch.take(pa.array(np.flatnonzero(of == band)))
            samples = np.frombuffer(b"".join(some.column("minima").to_pylist()), np.uint32).reshape(some.num_rows, -1)
            keys = band_keys(samples, more_bands(band), some.column("key").to_numpy())
            for t in range(MORE_BANDS):
                yield pa.record_batch([pa.array(keys[:, t]), some.column("band"), some.column("node"), some.column("fp")], names=["key", "band", "node", "fp"])


def _spin(s: int) -> Column:
    return F.xxhash64("node", F.lit(s))


def hubs_of() -> Column:
    """An aggregate: the least hashes of a group's nodes, by which its hubs are known."""
    return F.array(*[F.min(_spin(s)) for s in range(HUBS)])


def in_parts(group: str, many: str) -> Column:
    """The parts of its group that a member goes to: one by its hash, or all for a hub."""
    own = F.pmod(F.xxhash64("node", group), F.col(many)).cast("int")
    is_hub = F.arrays_overlap(F.array(*[_spin(s) for s in range(HUBS)]), F.col("hubs"))
    return F.when((F.col(many) > 1) & is_hub, F.sequence(F.lit(0), F.col(many) - 1)).otherwise(F.array(own))


def coarse_groups(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of ``nodes(node, fp, minima)`` with another fingerprint within RADIUS bits in a shard.

    ``scratch`` holds the tables that are written meanwhile.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[int] = []
        v: list[int] = []
        for group in sorted_groups(batches, ["key", "part"]):
            if group.num_rows > 1:
                node_of: dict[int, int] = {}
                for node, fp in zip(group.column("node").to_pylist(), group.column("fp").to_pylist()):
                    x = int.from_bytes(fp)
                    if (other := node_of.setdefault(x, node)) != node:
                        u.append(node)
                        v.append(other)
                for a, b in spanning_links(list(node_of), RADIUS) if len(node_of) > 1 else ():
                    u.append(node_of[a])
                    v.append(node_of[b])
            if len(u) > 100_000:
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def split(dealt: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(key, part, node, fp) of all shards, and the full ones' keys with their parts, if there are any."""
        counts = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FULL)
        many = scratch.write(counts.select("key", F.ceil(F.col("n") / F.lit(FULL)).cast("int").alias("parts")), "full-shards")
        if many.isEmpty():
            return dealt.select("key", F.lit(0).alias("part"), "node", "fp"), None
        hubs = dealt.join(many.select("key"), "key", "left_semi").groupBy("key").agg(hubs_of().alias("hubs"))
        many = scratch.write(many.join(hubs, "key"), "full-shard-hubs")
        some = dealt.join(many, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        return some.select("key", F.explode(in_parts("key", "parts")).alias("part"), "node", "fp"), many

    shards = "key long, band int, node long, fp binary"
    dealt = nodes.mapInArrow(deal, shards)
    every, many = split(dealt)
    if many is not None:
        crowded = scratch.write(dealt.join(many.select("key"), "key", "left_semi").select("key", "band", "node"), "crowded")
        longer = crowded.join(nodes, "node").select("key", "band", "node", "fp", "minima").mapInArrow(deal_longer, shards)
        every = every.unionByName(split(longer)[0])
    every = every.repartition("key", "part").sortWithinPartitions("key", "part")
    return components(scratch.write(every.mapInArrow(link, "u long, v long"), "shard-links"), scratch)


def overlaps(grams: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many members each set of ``rows`` has in common with each of ``columns``."""
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, which, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    often = times > 1  # what one set alone has counts in no overlap
    owner, which = owner[often[which]], (np.cumsum(often) - 1)[which[often[which]]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for low in range(0, int(often.sum()), 2048):
        a, b = np.searchsorted(which, (low, low + 2048))
        have = np.zeros((len(grams), 2048), np.float32)
        have[owner[a:b], which[a:b] - low] = 1
        out += have[rows] @ have[columns].T
    return out


def similar_links(nodes: list[int], grams: list[np.ndarray], similarity: float, label: np.ndarray | None = None, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of the pairs whose shingle sets have Jaccard similarity of ``similarity`` or more.

    With ``left``, of the pairs of a member there with one that isn't. Members of equal ``label``
    are joined already, and no link between them is given.
    """
    size = np.array([len(g) for g in grams], np.int64)
    label = np.arange(len(nodes)) if label is None else np.unique(label, return_inverse=True)[1]
    rows = np.arange(len(nodes)) if left is None else np.flatnonzero(left)
    columns = rows if left is None else np.flatnonzero(~left)
    out: list[tuple[int, int]] = []
    both = overlaps(grams, rows, columns) if len(rows) * len(columns) > 64 else None
    for k, i in enumerate(rows.tolist()):
        apart = label[columns] != label[i]
        if both is None:
            fits = np.minimum(size[columns], size[i]) >= similarity * np.maximum(size[columns], size[i])
            some = np.flatnonzero(apart & fits)
            common = np.array([len(np.intersect1d(grams[i], grams[columns[c]], assume_unique=True)) for c in some.tolist()], np.int64)
        else:
            some = np.flatnonzero(apart)
            common = both[k, some].astype(np.int64)
        for j in columns[some[common >= similarity * (size[i] + size[columns[some]] - common)]].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((nodes[i], nodes[j]))
    return out


def group_links(members: DataFrame, texts: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (u, v) that join what ``similarity`` joins inside each group of ``members(component, node, size)``.

    A group is dealt in blocks, each with the group's hubs. Where it has several, the members
    that this leaves outside its largest component are compared with all members of other
    blocks too, so no pair of different components stays uncompared.
    """
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), blocks.alias("blocks"), hubs_of().alias("hubs"))
    sizes = scratch.write(sizes.where("n > 1").select("component", "blocks", "hubs"), "group-sizes")
    placed = members.join(sizes, "component")

    def with_grams(rows: DataFrame, columns: str) -> DataFrame:
        names = [c.split()[0] for c in columns.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [gram_set(shingle_digests(t.as_py(), width)).tobytes() for t in batch.column("text")]
                yield pa.record_batch([*[batch.column(c) for c in names], pa.array(sets, pa.binary())], names=[*names, "grams"])

        return rows.join(texts, "node").select(*names, "text").mapInArrow(run, f"{columns}, grams binary")

    def pairs(rows: DataFrame, parts: list[str]) -> DataFrame:
        """Links of ``rows(component, *parts, node, label, side, grams)``; a null side is on both."""

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in sorted_groups(batches, ["component", *parts]):
                grams = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
                label, side = group.column("label").to_numpy(), group.column("side")
                left = None if side.null_count else np.array(side.to_pylist(), bool)
                found = similar_links(group.column("node").to_pylist(), grams, similarity, label, left) if len(grams) > 1 else []
                component = pa.array([group.column("component")[0].as_py()] * len(found), pa.int64())
                yield pa.record_batch([component, *[pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]], names=["component", "u", "v"])

        dealt = rows.repartition("component", *parts).sortWithinPartitions("component", *parts)
        return dealt.mapInArrow(link, "component long, u long, v long")

    at = placed.withColumn("at", in_parts("component", "blocks"))
    some = with_grams(at, "component long, node long, at array<int>").select("component", F.explode("at").alias("i"), "node", F.col("node").alias("label"), F.lit(None).cast("boolean").alias("side"), "grams")
    first = scratch.write(pairs(some, ["i"]), "block-links")
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return first.select("u", "v")
    joined = components(first.join(large.select("component"), "component", "left_semi").select("u", "v"), scratch).select("node", F.col("component").alias("label"))
    labelled = scratch.write(placed.where("blocks > 1").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    major = labelled.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("major"))
    minor = labelled.join(major, "component").where("label <> major")
    counts = minor.groupBy("component").agg(blocks.alias("others"), F.max("major").alias("major"))
    dealt = labelled.join(counts, "component")
    own, other = (F.pmod(F.xxhash64("node", F.lit(s)), F.col(c)).cast("int") for s, c in ((0, "blocks"), (1, "others")))
    rest = with_grams(dealt.select("component", "node", "label", "blocks", "others", own.alias("b"), F.when(F.col("label") != F.col("major"), other).alias("o")), "component long, node long, label long, blocks int, others int, b int, o int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rest.select("component", F.col("b").alias("i"), spread("others").alias("j"), "node", "label", F.lit(True).alias("side"), "grams")
    right = rest.where("o is not null").select("component", spread("blocks").alias("i"), F.col("o").alias("j"), "node", "label", F.lit(False).alias("side"), "grams")
    second = scratch.write(pairs(left.unionByName(right), ["i", "j"]), "rest-links")
    return first.select("u", "v").unionByName(second.select("u", "v"))


def near_duplicate_groups(df: DataFrame, row: str, text: str, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, group): rows of one group are equal texts or linked by similarity; group is its least row.

    ``row`` is a unique, non-null long.
    """
    slim = df.select(F.col(row).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    found = slim.mapInArrow(_classes(width, math.floor(SHORT / similarity), similarity), "row long, same binary, fp binary, minima binary, first array<long>, size long")
    each = Written(found, "wide-fingerprints").df
    kept = ["fp", "minima", "first", "size"]
    nodes = Written(each.groupBy("same").agg(F.min("row").alias("node"), *[F.first(c).alias(c) for c in kept]), "text-classes").df
    scratch = Scratch()
    # texts without a word are copies of each other and of nothing else
    coarse = coarse_groups(nodes.where("minima is not null").select("node", "fp", "minima"), scratch).join(nodes.select("node", "size"), "node")
    short = nodes.select(F.explode("first").alias("component"), "node", "size")
    members = scratch.write(coarse.select("component", "node", "size").unionByName(short), "coarse")
    links = group_links(members, slim.withColumnRenamed("row", "node"), width, similarity, scratch)
    linked = Written(components(links, scratch), "similar").df
    scratch.drop()
    group_of = nodes.select("same", "node").join(linked, "node", "left").select("same", F.coalesce("component", "node").alias("group"))
    return each.select("row", "same").join(group_of, "same").select("row", "group")


def drop_near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``df`` with one row of each near-duplicate group: the one of least (id, text), null ids last.

    Rows link when their ``width``-word shingle sets, A-Z lower-cased, have a Jaccard
    similarity of ``similarity`` or more; equal word sequences always link; groups are
    transitive. Texts without a word (null, empty, white space) form one group. Repeated
    rows are copies. All columns come back, whatever their names but ``_setloom_row``; an empty table stays empty.
    """
    # a row number is stable only once written; the id's order, not the number's, decides who stays
    rows = Written(df.select("*", F.monotonically_increasing_id().alias("_setloom_row")), "rows").df
    ids = rows.select(F.col("_setloom_row").alias("row"), F.col(f"`{id_col}`").alias("id"))
    groups = near_duplicate_groups(rows, "_setloom_row", text, width, similarity)
    best = groups.join(ids, "row").groupBy("group").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("_setloom_row"))
    return rows.join(best.select("_setloom_row"), "_setloom_row", "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])

"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

On unit vectors, cosine c is distance sqrt(2 - 2c). A table buckets vectors by a few
quantised random projections; the numbers of projections and tables follow from the largest
label, so that buckets stay small and a pair at the threshold is met in some table with
probability RECALL. Equal vectors are one node. A pair that meets in several tables counts
in the first only, which each side tells from the other's keys, so links are counted without
being listed. Large buckets are compared block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import Scratch, Written, components, sorted_groups

COSINE, RECALL, WIDTH = 0.93, 0.99, 1.0
#: Expected unrelated members of a bucket, which one matrix product compares, and members compared in one task.
BUCKET, BLOCK = 512, 1024


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection of width ``width`` puts two vectors at ``distance`` in one cell (Datar et al. 2004)."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def sizing(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(projections a table, tables) for labels of at most n vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n, 2) / BUCKET) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))


def _links(x: np.ndarray, keys: np.ndarray, table: int, weight: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float):
    """Weighted link counts and spanning edges of the pairs left x right at ``cosine`` or more that first meet here."""
    n = len(x)
    counts = np.zeros(n, np.int64)
    label = np.arange(n)
    edges: list[tuple[int, int]] = []
    for i in left.tolist():
        near = right[x[right] @ x[i] >= cosine]
        near = near[near != i]
        if table:
            near = near[~(keys[near, :table] == keys[i, :table]).any(1)]
        if not len(near):
            continue
        counts[i] += weight[near].sum()
        counts[near] += weight[i]
        fresh = near[label[near] != label[i]]
        while len(fresh):
            j = int(fresh[0])
            edges.append((i, j))
            label[label == label[j]] = label[i]
            fresh = fresh[label[fresh] != label[i]]
    return counts, edges


def near_duplicates(df: DataFrame, vector: str = "embedding", label: str = "label", id_col: str = "vec_id", cosine: float = COSINE) -> DataFrame:
    """(id_col, n_links, component_id, kept): links at cosine ``cosine`` or more between vectors of equal label.

    n_links counts the other vectors linked directly, component_id is the least id reachable
    (its own included), kept marks the rows whose id it is. Cosines are exact, in double
    precision; none below the threshold links. Vectors that are null, empty, zero, or hold
    null or non-finite components, and null labels, link with nothing; vectors of different
    lengths don't link. Equal vectors with one label link. A null id keeps its row and counts
    as a partner, but is never the least. Repeated rows are vectors of their own. An empty
    table gives an empty one; other columns are not read. Ids are longs.
    """
    spark = df.sparkSession
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are equal components
    same = F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x))
    rows = Written(rows.select("id", "label", F.when(fit, same).alias("v")), "vectors").df
    valid = rows.where("v is not null").withColumn("node", F.xxhash64("label", "v"))
    scratch = Scratch()
    nodes = scratch.write(valid.groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("weight"), F.min("id").alias("rep")), "distinct-vectors")
    most = nodes.groupBy("label", F.size("v").alias("d")).agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()
    sizes = {r["d"]: sizing(r["n"], cosine) for r in most}  # a row for each length of vector
    spins: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keyed(x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        k, many = sizes[d]
        if d not in spins:
            rng = np.random.Generator(np.random.PCG64(42))
            spins[d] = (rng.standard_normal((d, k * many)), rng.uniform(0, WIDTH, k * many))
        a, b = spins[d]
        cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), many, k)
        mixed = np.zeros((len(x), many), np.uint64)
        for j in range(k):
            mixed = (mixed ^ cells[:, :, j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return mixed.view(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column("v")])
            for d in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == d))
                node, lab, weight = (batch.column(c).take(at) for c in ("node", "label", "weight"))
                x = np.array(batch.column("v").take(at).flatten(), np.float64).reshape(-1, d)
                keys = keyed(x / _norm(x)) & 0xFFFFFFFF
                narrow = x.astype(np.float32)
                exact = (narrow == x).all(axis=1)  # most embeddings are floats: half the bytes, nothing lost
                raw = pa.array([(a if e else b).tobytes() for a, b, e in zip(narrow, x, exact)], pa.binary())
                short = keys.astype(np.uint32)
                for t in range(keys.shape[1]):
                    earlier = pa.array([r.tobytes() for r in short[:, :t]], pa.binary())  # what tells whether a pair has met before
                    yield pa.record_batch([lab, pa.array([t * 65536 + d] * len(at), pa.int64()), pa.array(keys[:, t]), node, weight, raw, earlier], names=["label", "table", "key", "node", "weight", "x", "keys"])

    dealt = nodes.select("label", "node", "weight", "v").mapInArrow(deal, "label string, table long, key long, node long, weight long, x binary, keys binary")
    dealt = scratch.write(dealt, "buckets")
    bucket = ["label", "table", "key"]
    # written, so that its size is known: most often it is tiny and Spark may broadcast it, sparing the wide rows a shuffle
    large = dealt.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    blocks = scratch.write(large.select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-buckets")
    some = dealt.join(blocks, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    some = some.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = some.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select(F.xxhash64(*bucket).alias("g"), F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "table", "node", "weight", "x", "keys")
    paired = paired.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["g", "i", "j"]):
            if group.num_rows == 1:
                continue
            d = group.column("table")[0].as_py() % 65536
            x = np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * d else np.float64) for b in group.column("x").to_pylist()]).astype(np.float64)
            x = x / _norm(x)
            keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint32).reshape(group.num_rows, group.column("table")[0].as_py() // 65536)
            node, weight, b = (group.column(c).to_numpy() for c in ("node", "weight", "b"))
            i, j, table = group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("table")[0].as_py() // 65536
            counts = np.zeros(len(x), np.int64)
            edges: list[tuple[int, int]] = []
            if i != j:
                counts, edges = _links(x, keys, table, weight, np.flatnonzero(b == i), np.flatnonzero(b == j), cosine)
            else:
                counts, edges = _within(x, keys, table, weight, cosine)
            at = np.flatnonzero(counts)
            u, w = (pa.array([int(node[e[k]]) for e in edges], pa.int64()) for k in (0, 1))
            zero = pa.array(np.zeros(len(edges), np.int64))
            yield pa.record_batch([pa.array(node[at]), pa.array([None] * len(at), pa.int64()), pa.array(counts[at])], names=["u", "v", "links"])
            yield pa.record_batch([u, w, zero], names=["u", "v", "links"])

    found = scratch.write(paired.select("g", "i", "j", "b", "table", "node", "weight", "x", "keys").mapInArrow(check, "u long, v long, links long"), "links")
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.where("v is not null").select("u", "v"), scratch)
    info = nodes.select("node", "weight", "rep").join(links, "node", "left").join(joined, "node", "left")
    info = info.withColumn("root", F.coalesce("component", "node"))
    least = info.groupBy("root").agg(F.min("rep").alias("component_id"))
    info = Written(info.join(least, "root").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "vector-components").df
    scratch.drop()
    out = valid.select("id", "node").join(info, "node").select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _norm(x: np.ndarray) -> np.ndarray:
    """Lengths, safe for components whose squares over- or underflow."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    return scale * np.sqrt(((x / scale) ** 2).sum(axis=1, keepdims=True))


def _within(x: np.ndarray, keys: np.ndarray, table: int, weight: np.ndarray, cosine: float):
    """As ``_links`` for all pairs of one block, each once."""
    n = len(x)
    near = np.triu(x @ x.T >= cosine, 1)
    counts, edges, label = np.zeros(n, np.int64), [], np.arange(n)
    for i in np.flatnonzero(near.any(1)).tolist():
        js = np.flatnonzero(near[i])
        if table:
            js = js[~(keys[js, :table] == keys[i, :table]).any(1)]
        if not len(js):
            continue
        counts[i] += weight[js].sum()
        counts[js] += weight[i]
        fresh = js[label[js] != label[i]]
        while len(fresh):
            j = int(fresh[0])
            edges.append((i, j))
            label[label == label[j]] = label[i]
            fresh = fresh[label[fresh] != label[i]]
    return counts, edges

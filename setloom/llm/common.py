"""Shared helpers: table access, lineage cuts, components, grouped streaming."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="setloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of an Arrow batch while a table is written: texts are long, and both sides of the pipe hold a batch.
BATCH_ROWS = 2000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Written:
    """A table written to the shared folder: it cuts lineage and outlives any executor."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/setloom/{name}-{uuid.uuid4().hex}"
        with small_batches(self.spark):
            df.write.parquet(self.path)
        jvm = self.spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)
        self._schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only once nothing lazy still reads them."""
        self._fs.delete(self._path, True)


class Scratch:
    """Written tables that are deleted together, once what needs them has been written itself."""

    def __init__(self) -> None:
        self.held: list[Written] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(Written(df, name))
        return self.held[-1].df

    def drop(self) -> None:
        while self.held:
            self.held.pop().drop()


def write_out(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_rows(df: DataFrame, columns: Iterable[Column | str], fn: Callable, schema: str) -> DataFrame:
    """mapInArrow over the chosen columns only, so that nothing else is read or shipped to Python."""
    return df.select(*columns).mapInArrow(fn, schema)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``most`` bytes of a text column each; a longer text stands alone."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys out of batches that are sorted by the keys; a group may cross batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of the edges of one partition, in runs of bounded size."""
    at: dict[int, int] = {}
    up: dict[int, int] = at

    def find(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(p, p)
            x = up[x]
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(up) if (r := find(x)) != x]
        u, v = zip(*pairs) if pairs else ((), ())
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 200_000:
            yield flush()
            up.clear()
    yield flush()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the least node reachable.

    The result reads a written table, which ``scratch`` holds if it is given. Edges that come
    from a Python function should be written first: two Python stages in one task take two workers' memory.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Each round is a
    partial aggregate and a join of narrow rows, written to the shared folder; links stay
    on the executors and the driver sees two numbers a round.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = Written(edges.mapInArrow(_local_forest, "u long, v long").distinct(), "edges")
    mark = lambda w: w.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    seen = mark(now)
    while seen[0]:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v")
        following = Written(small.mapInArrow(_local_forest, "u long, v long").distinct(), "edges")
        then = mark(following)
        now.drop()
        now = following
        if then == seen:
            break
        seen = then
    if scratch is not None:
        scratch.held.append(now)
    # a fixed point is a set of stars: every node points at the least of its component
    leaves = now.df.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)




def running(df: DataFrame, group: list[str], spin: str, order: list[str], measure: str, name: str, per_bucket: int = 1024) -> DataFrame:
    """Add ``name``: the sum of ``measure`` over the rows before this one in its ``group``, by (spin, order).

    ``spin`` is a hash in 0..2^32-1. A group's rows are dealt to about rows / per_bucket
    ranges of it; a window runs inside each range only, and the running sums of the ranges,
    a table smaller by per_bucket, give the start of each. So no task sorts a hot group, and
    the result does not depend on per_bucket. Number of groups: bounded by the caller
    (lengths up to a capacity, sources up to a period), so the table of group sizes may be
    broadcast; group columns are not null. Rows equal in spin, order and measure are
    interchangeable.
    """
    sizes = df.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(per_bucket)).cast("long").alias("_b"))
    dealt = df.join(F.broadcast(sizes), group).withColumn("_k", F.shiftright(F.col(spin) * F.col("_b"), 32)).drop("_b")
    each = dealt.groupBy(*group, "_k").agg(F.sum(measure).alias("_c"))
    before = W.partitionBy(*group).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    starts = each.select(*group, "_k", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    inside = W.partitionBy(*group, "_k").orderBy(spin, *order).rowsBetween(W.unboundedPreceding, -1)
    local = dealt.withColumn("_l", F.coalesce(F.sum(measure).over(inside), F.lit(0)))
    return local.join(starts, [*group, "_k"]).withColumn(name, F.col("_s") + F.col("_l")).drop("_k", "_s", "_l")

"""Placing documents in shards by a permutation-filled lookup table.

The table has a prime number of slots. Each shard has its own permutation of the slots, from
two hashes of its name; shards take turns, each claiming the first free slot of its
permutation, until the table is full. A document's hash names a slot. The table has a fixed
size, so it is broadcast, and a document is placed by one lookup without a shuffle. When a
shard leaves, few slots change hands.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime of more than 100 slots a shard.
SLOTS, SHARDS = 2053, 16


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def fill(names: list[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot."""
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)) or not 0 < len(set(names)) == len(names) <= slots:
        raise ValueError("the table needs a prime number of slots and distinct shards, at most one a slot")
    hashes = [md5(n.encode()).hexdigest() for n in names]
    offset = [int(h[:8], 16) % slots for h in hashes]
    skip = [int(h[8:16], 16) % (slots - 1) + 1 for h in hashes]
    following = [0] * len(names)
    owner: list[str | None] = [None] * slots
    for turn in range(slots):
        i = turn % len(names)
        while owner[at := (offset[i] + following[i] * skip[i]) % slots] is not None:
            following[i] += 1
        owner[at] = names[i]
        following[i] += 1
    return owner


def key_slot(key: Column, slots: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, names: list[str] | None = None, slots: int = SLOTS, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default the id) with slot and shard, a row for each row of ``df``.

    The key is the id as text; a null id is keyed by the text instead (null: empty), so such
    rows spread. Equal keys share a shard. Columns that clash with slot and shard are not
    kept unless named in ``keep``. An empty table gives an empty one.
    """
    table = fill(names or shard_names(), slots)
    owners = df.sparkSession.createDataFrame(list(enumerate(table)), "slot long, shard string")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep or [id_col]]).alias("row"), key_slot(key, slots).alias("slot"))
    return rows.join(F.broadcast(owners), "slot").select("row.*", "slot", "shard")


def unused(name: str, columns: list[str]) -> str:
    """``name``, or that with as many underscores behind it as keep it from clashing with ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def write_shards(df: DataFrame, path: str, names: list[str] | None = None, slots: int = SLOTS, id_col: str = "doc_id", text: str = "text", files: int = 8) -> str:
    """Write ``df`` as Parquet, a folder a shard; a shard's rows are salted over ``files`` tasks.

    Returns the folders' column, ``shard`` or, where ``df`` has one, that with an underscore.
    All columns of ``df`` are written, whatever their names. Rows without an id are keyed by text.
    """
    folder = unused("shard", df.columns)
    salt = unused("salt", [*df.columns, folder])
    rows = [f"_{i}" for i in range(len(df.columns))]
    plain = df.toDF(*rows)
    placed = place(plain, names, slots, rows[df.columns.index(id_col)], rows[df.columns.index(text)], keep=rows).drop("slot")
    salted = placed.withColumn("salt", F.pmod(F.xxhash64(*rows), F.lit(files))).toDF(*df.columns, folder, salt)
    salted.repartition(folder, salt).drop(salt).write.partitionBy(folder).parquet(path)
    return folder

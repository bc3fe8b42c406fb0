"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's documents, in hashed order, form a stream that is cut into blocks of bytes. With
integer shares a that sum to W, block i of a source may start at slot floor(i W / a) and is
due before slot ceil((i + 1) W / a). Earliest deadline first over released blocks keeps
every source within one block of its share at every slot, and the schedule repeats after W
slots. So one period is scheduled, over the table of sources, and every document finds its
slot by arithmetic. Sources that run out start again (epochs) until every source has been
placed whole once: no document is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setloom.llm.common import Written, running

#: Default weights: a source's bytes to this power, so small sources gain without many repeats.
TEMPER = 0.8
PERIOD, BLOCK_BYTES = 1000, 1 << 16
#: Repeats of a row that one task makes.
EPOCHS = 64


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def shares(sizes: DataFrame, targets: DataFrame | None, period: int) -> DataFrame:
    """``sizes(src, total)`` with a, the integer share of each source, at least 1.

    Weights of a source that ``targets(src, w)`` repeats add up; a missing or null one is zero.
    One that is negative, infinite or no number is an error. If all are zero, all are equal.
    """
    if targets is None:
        weighted = sizes.withColumn("w", F.pow(F.col("total").cast("double"), F.lit(TEMPER)))
    else:
        w = F.col("w").cast("double")
        bad = F.isnan(w) | (w < 0) | (w == float("inf"))
        checked = F.when(bad, F.raise_error(F.concat(F.lit("no weight: "), w.cast("string"))).cast("double")).otherwise(F.coalesce(w, F.lit(0.0)))
        weighted = sizes.join(targets.groupBy("src").agg(F.sum(checked).alias("w")), "src", "left").fillna({"w": 0.0})
    every = W.partitionBy(F.lit(0))
    part = F.when(F.sum("w").over(every) > 0, F.col("w") / F.nullif(F.sum("w").over(every), F.lit(0.0))).otherwise(F.lit(1.0) / F.count("*").over(every))
    quota = F.floor(part * F.lit(period)).cast("long")
    return weighted.select("src", "total", F.greatest(quota, F.lit(1).cast("long")).alias("a"))


def schedule(shared: DataFrame) -> DataFrame:
    """(src, a, total, period, slots): the slots of one period that earliest deadline first gives each source.

    ``shared`` has a row a source, at most as many as the period; the fold runs over the
    period's slots in one row, whatever the number of documents.
    """
    listed = shared.agg(F.array_sort(F.collect_list(F.struct("src", "a", "total"))).alias("s"))
    listed = listed.select("s", F.aggregate("s", F.lit(0).cast("long"), lambda x, y: x + y["a"]).alias("period")).where("period > 0")
    period = F.col("period")

    def step(state: Column, t: Column) -> Column:
        def urgency(source: Column, i: Column) -> Column:
            nth = F.element_at(state["next"], (i + 1).cast("int"))
            released = _div(nth * period, source["a"]) <= t
            deadline = F.ceil((nth + 1) * period / source["a"]).cast("long")
            return F.when(released, F.struct(deadline.alias("d"), i.cast("int").alias("i")))

        first = F.array_min(F.transform("s", urgency))["i"]
        return F.struct(
            F.transform(state["next"], lambda n, i: F.when(i == first, n + 1).otherwise(n)).alias("next"),
            F.concat(state["out"], F.array(first)).alias("out"),
        )

    start = F.struct(F.transform("s", lambda _: F.lit(0).cast("long")).alias("next"), F.array().cast("array<int>").alias("out"))
    run = F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1), start, step, lambda x: x["out"])
    slots = listed.select("s", "period", run.alias("out")).select("s", "period", F.posexplode("out").alias("slot", "i"))
    by_source = slots.groupBy("i", "period").agg(F.array_sort(F.collect_list("slot")).alias("slots"), F.first("s").alias("s"))
    return by_source.select(F.element_at("s", F.col("i") + 1).alias("x"), "period", "slots").select("x.src", "x.a", "x.total", "period", "slots")


def horizon(plan: DataFrame, block_bytes: int) -> DataFrame:
    """The plan with blocks (of one epoch) and placed (blocks in all), up to the slot by which every source was whole once."""
    sized = plan.withColumn("blocks", F.ceil(F.col("total") / F.lit(block_bytes)).cast("long"))
    end = sized.withColumn("end", _slot(F.col("blocks") - 1) + 1).withColumn("end", F.max("end").over(W.partitionBy(F.lit(0))))
    rest = F.size(F.filter("slots", lambda x: x < F.pmod("end", "period")))
    return end.withColumn("placed", _div(F.col("end"), F.col("period")) * F.col("a") + rest).drop("end")


def _slot(nth: Column) -> Column:
    return _div(nth, F.col("a")) * F.col("period") + F.element_at("slots", (F.pmod(nth, F.col("a")) + 1).cast("int"))


def mix(
    df: DataFrame,
    targets: DataFrame | None = None,
    source: str = "source",
    text: str = "text",
    id_col: str = "doc_id",
    period: int = PERIOD,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
    placement: bool = True,
    most_repeats: int | None = None,
) -> DataFrame:
    """Columns ``keep`` (default id and source) with epoch, block and slot for every placement of a row.

    Without ``placement`` the kept columns come alone, whatever their names.

    Order the result by (slot, epoch, block) to read the mixture: block counts the blocks of
    the row's source, slot the blocks of all. ``targets(source, weight)`` sets the weights;
    a source without one, or with a weight of zero, gets the least share, one of ``period``, and
    none is dropped; repeated targets add up; a negative, infinite or undefined weight raises.
    Without targets, weights are bytes to the power TEMPER. A source far smaller than its share
    repeats often; ``most_repeats`` raises where one would be placed more often than that. There may be at most ``period``
    sources: the table of sources is broadcast under that bound, and more raise an error.
    A null source is a source of its own, apart from the empty name. A null or empty text
    weighs one byte. Repeated rows are placed each; ties in the hashed order are equal rows.
    An empty table gives an empty one. Columns may have any names.
    """
    keep = keep or [id_col, source]
    name = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(f"`{c}`").cast("string")), F.lit("n"))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("|"), body).cast("binary"))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        name(source).alias("src"),
        F.greatest(F.octet_length(body), F.lit(1)).cast("long").alias("bytes"),
        digest.alias("digest"),
    ).withColumn("spin", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
    sizes = rows.groupBy("src").agg(F.sum("bytes").alias("total"))
    bound = sizes.select("*", F.count("*").over(W.partitionBy(F.lit(0))).alias("n")).select(
        "src", F.when(F.col("n") <= period, F.col("total")).otherwise(F.raise_error(F.lit(f"more than {period} sources: raise the period"))).alias("total")
    )
    wanted = None if targets is None else targets.select(name(targets.columns[0]).alias("src"), F.col(f"`{targets.columns[1]}`").alias("w"))
    plan = horizon(schedule(shares(bound, wanted, period)), block_bytes)
    if most_repeats is not None:
        many = F.col("placed") > F.col("blocks") * F.lit(most_repeats)
        plan = plan.withColumn("placed", F.when(many, F.raise_error(F.concat(F.lit(f"more than {most_repeats} repeats of source "), F.substring("src", 2, 1 << 30))).cast("long")).otherwise(F.col("placed")))
    plan = Written(plan, "mixture").df  # a row a source, read by both branches below
    first_block = _div(F.col("start"), F.lit(block_bytes))
    last = _div(F.col("placed") - 1 - first_block, F.col("blocks"))

    def placed(some: DataFrame) -> DataFrame:
        return running(some, ["src"], "spin", ["digest"], "bytes", "start").join(F.broadcast(plan), "src").withColumn("last", last)

    # the rows of a source that repeats often go to several tasks before they are repeated
    often = F.broadcast(plan.where(F.col("placed") > F.col("blocks") * EPOCHS).select("src"))
    few = placed(rows.join(often, "src", "left_anti")).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    spans = placed(rows.join(often, "src", "left_semi")).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), "last", F.lit(EPOCHS).cast("long"))))
    many = spans.repartition("digest", "from").withColumn("epoch", F.explode(F.sequence("from", F.least(F.col("from") + (EPOCHS - 1), "last")))).drop("from")
    nth = F.col("epoch") * F.col("blocks") + first_block
    where = ["epoch", nth.alias("block"), _slot(nth).alias("slot")] if placement else []
    return few.unionByName(many).select(F.col("row.*"), *where)

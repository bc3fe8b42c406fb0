"""Envelope series (series, pos, value): onsets, local means, peaks, autocorrelation, gates.

Every operator is a window or aggregate over a series; none gathers a series into one value
except where its lags or bars, few by nature, are the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setloom.functions.dsp import HARMONICS


def _by(series: str):
    return W.partitionBy(series).orderBy("pos")


def onsets(df: DataFrame, series: str, value: str = "value") -> DataFrame:
    """Positive first differences; 0 at the start."""
    return df.withColumn("onset", F.coalesce(F.greatest(F.lit(0.0), F.col(value) - F.lag(value).over(_by(series))), F.lit(0.0)))


def above_local_mean(df: DataFrame, series: str, frames: int, value: str = "value") -> DataFrame:
    half = max(1, frames // 2)
    mean = F.avg(value).over(_by(series).rowsBetween(-half, half - 1))
    return df.withColumn("above", F.greatest(F.lit(0.0), F.col(value) - mean))


def local_peaks(df: DataFrame, series: str, value: str = "value") -> DataFrame:
    """Rows above both neighbours."""
    w = _by(series)
    return df.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)}).where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b"))).drop("_a", "_b")


def autocorrelation(df: DataFrame, series: str, low: int, high: int, value: str = "value") -> DataFrame:
    """(series, lag, acf): mean product over the overlap, for the lags low to high; one sort of each series, no self-join."""
    w = _by(series)
    led = df.select(series, F.col(value).alias("x"), *[F.lead(value, k).over(w).alias(f"l{k}") for k in range(low, high + 1)])
    sums = led.groupBy(series).agg(*[F.avg(F.col("x") * F.col(f"l{k}")).alias(f"c{k}") for k in range(low, high + 1)])
    long = sums.select(series, F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("acf")) for k in range(low, high + 1)])))
    return long.withColumn("acf", F.coalesce("acf", F.lit(0.0)))


def tempo_scores(df: DataFrame, series: str, fps: float, low: int, high: int, value: str = "value") -> DataFrame:
    """(series, lag, bpm, score): harmonics up to the last lag, the sub-harmonic divisor, the prior at 125."""
    acf = autocorrelation(df, series, low, high, value).groupBy(series).agg(F.map_from_entries(F.collect_list(F.struct("lag", "acf"))).alias("m"))
    lag = F.col("lag")
    rows = acf.select(series, "m", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag"))
    at = lambda k: F.try_element_at("m", k.cast("int"))
    harmonic = reduce(lambda s, hw: s + F.when(lag * hw[0] <= high, hw[1] * at(lag * hw[0])).otherwise(0.0), enumerate(HARMONICS, 1), F.lit(0.0))
    half = F.floor(lag / 2 + 0.5)
    ratio = at(half) / F.greatest(F.lit(1e-9), at(lag))
    divided = F.when(half >= low, harmonic / (1 + 1.6 * F.greatest(F.lit(0.0), ratio))).otherwise(harmonic)
    bpm = 60 * fps / lag
    off = F.ln(bpm / 125)
    prior = F.exp(-(off * off) / (2 * 0.35 * 0.35))
    return rows.select(series, "lag", bpm.alias("bpm"), (divided * (0.75 + 0.25 * prior)).alias("score"))


def upper_median(df: DataFrame, group: str, value: str = "value") -> DataFrame:
    """The element at floor(n / 2) of the sorted values."""
    ranked = df.select(group, value, (F.row_number().over(W.partitionBy(group).orderBy(value)) - 1).alias("r"), F.count("*").over(W.partitionBy(group)).alias("n"))
    return ranked.where(F.col("r") == F.floor(F.col("n") / 2)).select(group, F.col(value).alias("median"))


def stability(beats: DataFrame, group: str, time: str = "beat") -> DataFrame:
    """(group, beats, mean_gap, variation, is_stable): eight beats at least, variation under 5 %."""
    gaps = beats.withColumn("gap", F.col(time) - F.lag(time).over(W.partitionBy(group).orderBy(time)))
    out = gaps.groupBy(group).agg(F.count("*").alias("beats"), F.avg("gap").alias("mean_gap"), (F.stddev_pop("gap") / F.avg("gap")).alias("variation"))
    return out.withColumn("is_stable", F.coalesce((F.col("beats") >= 8) & (F.col("variation") < 0.05), F.lit(False)))


def frame_rms(frame: Column) -> Column:
    total = F.aggregate(frame, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.sqrt(total / F.greatest(F.lit(1), F.size(frame)))


def block_peaks(frame: Column, bins: int) -> Column:
    """Maximum magnitudes of equal blocks over their maximum; what fills no block is left out."""
    size = F.floor(F.size(frame) / bins).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.array_max(F.transform(F.slice(frame, (i * size + 1).cast("int"), size), lambda x: F.abs(x.cast("double")))))
    top = F.array_max(each)
    return F.transform(each, lambda x: F.when(top > 0, x / top).otherwise(x))


def bars(df: DataFrame, series: str, frames: int = 4, value: str = "value") -> DataFrame:
    """(series, bar, level): twice the RMS of tumbling bars, between 0 and 1; an incomplete bar is left out."""
    each = df.groupBy(series, F.floor(F.col("pos") / frames).alias("bar")).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return each.where(F.col("n") == frames).select(series, "bar", F.least(F.lit(1.0), 2 * F.col("rms")).alias("level"))


def loud_bars(levels: DataFrame, series: str) -> DataFrame:
    """(series, peak, first_bar, last_bar): the first and last bar of 45 % of the peak."""
    peak = levels.groupBy(series).agg(F.max("level").alias("peak"))
    loud = levels.join(peak, series).where(F.col("level") >= 0.45 * F.col("peak"))
    return loud.groupBy(series, "peak").agg(F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


def energy_mean(lufs: Column) -> Column:
    return -0.691 + 10 * F.log10(F.greatest(F.lit(1e-12), F.avg(F.pow(F.lit(10.0), (lufs + 0.691) / 10))))


def gated_loudness(blocks: DataFrame, group: str, lufs: str = "lufs", target: float = -14.0) -> DataFrame:
    """(group, lufs, gain): blocks of -70 and more, then those within 10 of their mean; two aggregates and a join back."""
    loud = blocks.where(F.col(lufs) >= -70)
    first = loud.groupBy(group).agg(energy_mean(F.col(lufs)).alias("m"))
    second = loud.join(first, group).where(F.col(lufs) >= F.col("m") - 10).groupBy(group).agg(energy_mean(F.col(lufs)).alias("integrated"))
    every = blocks.select(group).distinct().join(second, group, "left")
    return every.select(group, "integrated", F.coalesce(target - F.col("integrated"), F.lit(0.0)).alias("gain"))


def beat_times(first: Column, bpm: Column, seconds: Column) -> Column:
    """Beats from first, a period apart, before the end."""
    n = F.greatest(F.ceil((seconds - first) * bpm / 60), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: first + i * 60 / bpm)).otherwise(F.array().cast("array<double>"))


def downbeats(beats: Column) -> Column:
    return F.filter(beats, lambda x, i: i % 4 == 0)


def tumbling_rms(df: DataFrame, series: str, frames: int, value: str = "value") -> DataFrame:
    """(series, frame, rms) of consecutive frames of a fixed size; an incomplete one is left out."""
    each = df.groupBy(series, F.floor(F.col("pos") / frames).alias("frame")).agg(F.count("*").alias("n"), F.avg(F.col(value) * F.col(value)).alias("power"))
    return each.where(F.col("n") == frames).select(series, "frame", F.sqrt("power").alias("rms"))


def beat_bars(df: DataFrame, beats: DataFrame, series: str, time: str = "time", value: str = "value") -> DataFrame:
    """(series, bar, level): RMS of the values from each fourth beat up to the next such one.

    ``beats(series, idx, beat)``. Both sides are one sorted sequence a series: a value takes the
    bar that began last, so no range join is needed. Values before the first bar or from the end
    of the last whole bar on are in none; a bar without values is left out.
    """
    last = beats.groupBy(series).agg(F.max("idx").alias("last"))
    marks = beats.where("idx % 4 = 0").join(last, series).select(series, F.col("beat").alias("at"), F.lit(0).alias("side"), F.when(F.col("idx") + 4 <= F.col("last"), F.floor(F.col("idx") / 4)).otherwise(-1).alias("bar"), F.lit(None).cast("double").alias("x"))
    values = df.select(series, F.col(time).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("bar"), F.col(value).cast("double").alias("x"))
    held = F.last("bar", ignorenulls=True).over(W.partitionBy(series).orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0))
    placed = marks.unionByName(values).withColumn("bar", held).where("side = 1 and bar >= 0")
    return placed.groupBy(series, "bar").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("level"))


def parabolic_peaks(df: DataFrame, series: str, value: str = "value") -> DataFrame:
    """Local peaks with place: between samples by the parabola through its neighbours, the sample itself where that fit fails."""
    w = _by(series)
    rows = df.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)})
    top = rows.where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")))
    shift = 0.5 * (F.col("_a") - F.col("_b")) / F.nullif(F.col("_a") - 2 * F.col(value) + F.col("_b"), F.lit(0.0))
    return top.withColumn("place", F.col("pos") + F.when(F.abs(shift) <= 0.5, shift).otherwise(0.0)).drop("_a", "_b")


def mixed_down(left: Column, right: Column) -> Column:
    """The mean of two channels, as long as the first."""
    both = F.zip_with(left, F.slice(right, F.lit(1), F.greatest(F.size(left), F.lit(1))), lambda a, b: (a.cast("double") + F.coalesce(b.cast("double"), F.lit(0.0))) / 2)
    return both


def resampled(frame: Column, ratio: float) -> Column:
    """Linear interpolation every ``ratio`` samples; behind the last sample its value holds."""
    n = F.floor(F.size(frame) / ratio).cast("int")

    def at(i: Column) -> Column:
        x = i * F.lit(float(ratio))
        low = F.floor(x).cast("int")
        a = F.element_at(frame, low + 1).cast("double")
        b = F.coalesce(F.try_element_at(frame, low + 2).cast("double"), a)
        return a + (b - a) * (x - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def display_bars(peaks: Column, n: int) -> Column:
    """``n`` of the peaks, evenly spaced, within 0 and 1."""
    at = lambda i: F.element_at(peaks, (F.floor(i * F.size(peaks) / n) + 1).cast("int")).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(F.greatest(at(i), F.lit(0.0)), F.lit(1.0)))


def pitch_classes(spectrum: Column) -> Column:
    """Magnitudes folded to twelve classes by place."""
    terms = lambda c: F.filter(spectrum, lambda _, i: i % 12 == c)
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda c: F.aggregate(terms(c), F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))))

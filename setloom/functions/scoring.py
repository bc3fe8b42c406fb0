"""How well a candidate follows the current track: one projection, no UDF, inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from setloom.functions.camelot import compatibility

# Default weights, and what stands in for missing analyses.
WEIGHTS = {"bpm": 0.35, "key": 0.20, "energy": 0.20, "variety": 0.10, "quality": 0.10, "recency": 0.50}
DEFAULT_BPM, DEFAULT_ENERGY, NEUTRAL_KEY, TRUSTED_KEY = 120.0, 0.5, 0.5, 0.3
QUALITY = {"good": 1.0, "partial": 0.6, "unreliable": 0.3}
ACCEPT, RELAXED_BPM = 0.55, 12.0


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def rounded(x: Column, digits: int) -> Column:
    """A double to so many decimals as SQL on doubles has it: scaled, halves away from zero, scaled back.

    Spark's ``round`` takes the shortest decimal text for the value, so that a double which lies
    just below a half when scaled goes up there and down in SQL.
    """
    scale = F.lit(10.0**digits)
    return F.round(x * scale) / scale


def bpm_score(current: Column, candidate: Column, sigma: float = 3.0) -> Column:
    """The best of the tempo, its double and its half under a Gaussian."""
    cur, cand = F.coalesce(current, F.lit(DEFAULT_BPM)), F.coalesce(candidate, F.lit(DEFAULT_BPM))
    bell = lambda b: F.exp(-((b - cur) * (b - cur)) / F.lit(2 * sigma * sigma))
    return F.greatest(bell(cand), bell(cand * 2), bell(cand / 2))


def key_score(a: Column, a_confidence: Column, b: Column, b_confidence: Column) -> Column:
    unsure = a.isNull() | b.isNull() | (F.coalesce(a_confidence, F.lit(0.0)) < TRUSTED_KEY) | (F.coalesce(b_confidence, F.lit(0.0)) < TRUSTED_KEY)
    return F.when(unsure, NEUTRAL_KEY).otherwise(compatibility(a, b))


def energy_score(mean: Column, target: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(F.coalesce(mean, F.lit(DEFAULT_ENERGY)) - target) * 1.5)


def quality_score(quality: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, value in QUALITY.items():
        out = out.when(quality == name, value)
    return out.otherwise(0.0)


def variety_score(same_artist: Column, same_genre: Column) -> Column:
    """From the counts among the last five plays; a track without a genre shares none."""
    return F.greatest(F.lit(0.0), 1 - 0.3 * same_artist - 0.1 * same_genre)


def recency_penalty(distance: Column) -> Column:
    """By plays since the last one of this track; null: never played."""
    return F.when(distance < 20, 1.0).when(distance < 50, 0.3).otherwise(0.0)


def total(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    plus = sum((parts[k] * weights[k] for k in ("bpm", "key", "energy", "variety", "quality")), F.lit(0.0))
    return plus - parts["recency"] * weights["recency"]


def queue_match(score: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """A score as a share of the best possible, between 0 and 1."""
    best = sum(weights[k] for k in ("bpm", "key", "energy", "variety", "quality"))
    return clamp01(score / max(0.1, best))


def reason(mode: Column, parts: dict[str, Column]) -> Column:
    two = lambda c: F.format_string("%.2f", c)
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), two(parts[k])) for k in ("bpm", "key", "energy", "variety", "quality")])
    late = F.when(parts["recency"] > 0, F.concat(F.lit(", recency_penalty="), two(parts["recency"]))).otherwise("")
    return F.concat(mode, F.lit(": "), shown, late)

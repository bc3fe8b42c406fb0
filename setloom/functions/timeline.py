"""Tempo and timeline arithmetic of a transition, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SAFE_STRETCH, SYNC_LIMIT, LEAD_SECONDS, FADE_BEATS, TARGET_LUFS = 0.06, 0.08, 0.05, 64, -14.0
ENGINE_FADE, PLANNED_FADE = (8.0, 40.0), (6.0, 20.0)
DRUM_EDIT = r"(?i)\b(dj[\s._-]*beats?|dj[\s._-]*edit)\b"
AUDIBLE_PHASE_SECONDS = 0.025
#: Fractions of a beat a minute that a tempo snaps to, the roundest first, with the tempos they are for (None: all): below, above.
TEMPO_LADDER = [(1, None, None), (2, 85, None), (2 / 3, None, 127), (3, None, None), (12, None, None)]


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def between(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def folded_ratio(a: Column, b: Column) -> Column:
    """a / b halved while above 1.4, then doubled while below 0.7, in closed form."""
    r = a / b
    halvings = F.greatest(F.lit(0), F.ceil(F.log2(r / 1.4)))
    down = r / F.pow(F.lit(2.0), halvings)
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(0.7 / down)))
    return F.when(r > 0, down * F.pow(F.lit(2.0), doublings))


def stretch(ratio: Column) -> Column:
    """The ratio if it is close enough to 1 to be applied, else 1."""
    return F.when(F.abs(ratio - 1) <= SAFE_STRETCH, ratio).otherwise(1.0)


def can_sync(ratio: Column) -> Column:
    return F.abs(ratio - 1) <= SYNC_LIMIT


def fade_seconds(bpm: Column, bounds: tuple[float, float] = ENGINE_FADE, beats: int = FADE_BEATS) -> Column:
    return between(beats * 60 / bpm, *bounds)


def next_downbeat(downbeats: Column, position: Column, bpm: Column, lead: float = LEAD_SECONDS) -> Column:
    """Where a fade starts: the next downbeat within four beats, else just ahead of the position."""
    at = F.array_min(F.filter(downbeats, lambda d: d >= position + lead))
    return F.when(at - position <= 4 * 60 / bpm + lead, at).otherwise(position + lead)


def nearest_downbeat(downbeats: Column, time: Column) -> Column:
    """The closest; of two as close the earlier."""
    return F.array_min(F.transform(downbeats, lambda d: F.struct(F.abs(d - time).alias("gap"), d.alias("at"))))["at"]


def equal_power(points: int = 512) -> Column:
    """array of struct(fade_out, fade_in): cosine and sine over a quarter turn."""
    x = lambda i: i * (math.pi / 2) / (points - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(F.cos(x(i)).alias("fade_out"), F.sin(x(i)).alias("fade_in")))


def bass_swap(fade: Column, ratio: Column, bpm: Column) -> Column:
    """struct(middle, length) of the bass exchange, or null for short fades and unsafe ratios."""
    return F.when((fade >= 5) & (F.abs(ratio - 1) <= SAFE_STRETCH), F.struct((fade * 0.5).alias("middle"), F.least(60 / bpm, fade * 0.12).alias("length")))


def release_glide(ratio: Column, fade: Column) -> Column:
    """Seconds over which a stretched track returns to its own tempo, or null if it is there."""
    return F.when(F.abs(ratio - 1) > 0.002, F.least(F.lit(10.0), F.greatest(F.lit(5.0), 0.6 * fade)))


def phase_correction(position: Column, first: Column, period: Column, other_position: Column, other_first: Column, other_period: Column) -> Column:
    """The shortest signed shift, in seconds of the first track, that aligns its beat phase with the other's.

    Phases are the fractions of the elapsed beats, as in SQL: remainders of the seconds differ from
    them in the last bits, which give half a beat the other sign.
    """
    fraction = lambda x: x - F.floor(x)
    mine = fraction((position - first) / period)
    other = fraction((other_position - other_first) / other_period)
    return (fraction(other - mine + 0.5) - 0.5) * period


def ramp_integral(start: Column, end: Column, length: Column, elapsed: Column) -> Column:
    """Track seconds played in ``elapsed`` seconds while the rate goes exponentially from start to end, then holds."""
    t = F.least(F.greatest(elapsed, F.lit(0.0)), length)
    k = F.ln(end / start)
    ramp = F.when((length <= 0) | (F.abs(k) < 1e-9), start * t).otherwise(start * length / k * (F.exp(k * t / length) - 1))
    return ramp + end * F.greatest(elapsed - length, F.lit(0.0))


def glide_rate(start: Column, end: Column, length: Column, elapsed: Column) -> Column:
    x = F.when(length > 0, between(elapsed / length, 0.0, 1.0)).otherwise(1.0)
    return start * F.pow(end / start, x)


def played_seconds(start: Column, rate: Column, segments: Column, now: Column) -> Column:
    """Track seconds from ``start`` to ``now`` at ``rate``, which each of ``segments`` changes exponentially.

    ``segments`` is an array of struct(start, end, from, to) without overlaps, in any order;
    between and behind them the rate holds. One fold over the sorted array.
    """
    begin = F.struct(start.alias("at"), rate.alias("rate"), F.lit(0.0).alias("done"))

    def step(state: Column, s: Column) -> Column:
        held = F.greatest(F.least(s["start"], now) - state["at"], F.lit(0.0)) * state["rate"]
        begun = s["start"] < now
        ramp = ramp_integral(s["from"], s["to"], s["end"] - s["start"], F.least(s["end"], now) - s["start"])
        return F.struct(
            F.greatest(state["at"], F.least(F.when(begun, s["end"]).otherwise(s["start"]), now)).alias("at"), F.when(begun, s["to"]).otherwise(state["rate"]).alias("rate"),
            (state["done"] + held + F.when(begun, ramp).otherwise(0.0)).alias("done"),
        )

    return F.aggregate(F.array_sort(segments), begin, step, lambda x: x["done"] + F.greatest(now - x["at"], F.lit(0.0)) * x["rate"])


def pitch_rate(percent: Column) -> Column:
    """The playback rate of a pitch fader, whose travel is 8 percent either way."""
    return 1 + between(percent, -8.0, 8.0) / 100


def playback_gain(lufs: Column, target: float = TARGET_LUFS) -> Column:
    """Linear gain that only ever cuts, by 12 dB at most."""
    return F.pow(F.lit(10.0), between(target - lufs, -12.0, 0.0) / 20)


def is_drum_edit(title: Column, path: Column) -> Column:
    return F.concat_ws(" ", title, path).rlike(DRUM_EDIT)


def effective_cues(title: Column, path: Column, bpm: Column, first: Column, seconds: Column, mix_in: Column, mix_out: Column) -> Column:
    """struct(mix_in, mix_out, intro_start, intro_end, outro_start, outro_end).

    Eight beats at either end of a drum edit, else the stored cues, which bound the intro and
    the outro too; null without an analysis.
    """
    tempo = F.when(F.coalesce(bpm, F.lit(0.0)) == 0, 120.0).otherwise(bpm)
    beat, begin = 60 / tempo, F.coalesce(first, F.lit(0.0))
    out = F.greatest(begin + 12 * beat, seconds - 8 * beat)

    def cues(mix_in: Column, mix_out: Column, intro: Column, intro_end: Column) -> Column:
        return F.struct(mix_in.alias("mix_in"), mix_out.alias("mix_out"), intro.alias("intro_start"), intro_end.alias("intro_end"), mix_out.alias("outro_start"), seconds.alias("outro_end"))

    return F.when(is_drum_edit(title, path), cues(begin, out, begin, begin + 8 * beat)).otherwise(cues(mix_in, mix_out, F.lit(0.0), mix_in))


def mix_trigger(mix_out: Column, fade: Column) -> Column:
    return mix_out - fade - 0.7


def snap_tempo(low: Column, center: Column, high: Column) -> Column:
    """The first tempo of TEMPO_LADDER strictly inside (low, high), else the center."""

    def snap(fraction: float, below: float | None, above: float | None) -> Column:
        x = js_round(center * fraction) / fraction
        fits = (x > low) & (x < high)
        fits = fits if below is None else fits & (center < below)
        return F.when(fits if above is None else fits & (center > above), x)

    usable = (low > 0) & (center > 0) & (high > 0)
    ladder = F.coalesce(*[snap(*step) for step in TEMPO_LADDER], center)
    return F.when(usable, ladder).otherwise(center)


def tempo_band(bpm: Column, beats: int = 32, tolerance: float = AUDIBLE_PHASE_SECONDS) -> Column:
    """struct(low, high): tempos that stay within ``tolerance`` of it over ``beats`` beats."""
    delta = F.when(bpm > 0, tolerance * bpm * bpm / (beats * 60)).otherwise(0.0)
    return F.struct((bpm - delta).alias("low"), (bpm + delta).alias("high"))


def decibels(amplitude: Column) -> Column:
    return 20 * F.log10(F.greatest(F.lit(1e-9), amplitude))


def quality_label(bpm_confidence: Column, stable: Column, key_confidence: Column) -> Column:
    return F.when((bpm_confidence < 0.3) | ~stable, "unreliable").when((bpm_confidence < 0.55) | (key_confidence < 0.25), "partial").otherwise("good")


def controls(master: Column, gain_db: Column, pitch_percent: Column) -> Column:
    """struct(master, gain_db, pitch_percent) within what the mixer allows."""
    return F.struct(between(master, 0.0, 1.0).alias("master"), between(gain_db, -26.0, 6.0).alias("gain_db"), between(pitch_percent, -8.0, 8.0).alias("pitch_percent"))


def crossfader(position: Column) -> Column:
    """struct(left, right): equal-power gains for a position between 0 and 1."""
    x = between(position, 0.0, 1.0) * (math.pi / 2)
    return F.struct(F.cos(x).alias("left"), F.sin(x).alias("right"))

"""Audio analytics on numpy arrays: one track at a time, for Arrow functions.

Envelopes and spectra are stored in 32 bits and summed in 64, as the published thresholds assume.
"""

from __future__ import annotations

import math

import numpy as np

from setloom.functions.camelot import PITCHES, WHEEL
from setloom.functions.timeline import TEMPO_LADDER

# Rates, tempo range, tolerances, key profiles (Krumhansl and Schmuckler).
RATE, ENVELOPE_WINDOW, FLUX_FRAME, FLUX_HOP = 22050, 256, 1024, 256
MIN_BPM, MAX_BPM, RAYLEIGH_BPM, TIGHTNESS = 60, 200, 120, 100.0
PHASE_ERROR, PHASE_ERROR_SUM, MOST_OUTLIERS, REGION_BEATS, COVERAGE = 0.025, 0.1, 1, 16, 0.5
HARMONICS = [1, 0.5, 0.33, 0.25]
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.6, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
TARGET_LUFS, ABSOLUTE_GATE, RELATIVE_GATE = -14.0, -70.0, -10.0
OVERVIEW_COLUMNS, OVERVIEW_BANDS, PEAK_BINS, DISPLAY_BARS = 240, 16, 512, 220
#: Samples that a filter takes at once.
FILTER_BLOCK = 128


def clamp01(x: float) -> float:
    return max(0.0, min(1.0, x))


def js_round(x):
    return np.floor(np.asarray(x) + 0.5).astype(int)


def mono(channels: list[np.ndarray]) -> np.ndarray:
    if not len(channels):
        return np.zeros(0, np.float32)
    n = len(channels[0])
    return np.mean([np.pad(c[:n], (0, n - len(c[:n]))) for c in channels], axis=0, dtype=np.float64).astype(np.float32)


def resampled(x: np.ndarray, rate: float, to: float) -> np.ndarray:
    """Linear interpolation at floor(n to / rate) points."""
    if rate == to or not len(x):
        return x
    at = np.arange(int(len(x) * to / rate)) * (rate / to)
    left = np.minimum(at.astype(int), len(x) - 1)
    right = np.minimum(left + 1, len(x) - 1)
    return (x[left] + (x[right].astype(float) - x[left]) * (at - left)).astype(np.float32)


def rms(x: np.ndarray) -> float:
    return math.sqrt(float(np.square(x, dtype=np.float64).sum()) / max(1, len(x)))


def decibels(a: float) -> float:
    return 20 * math.log10(max(1e-9, a))


def energy_envelope(x: np.ndarray, window: int = ENVELOPE_WINDOW) -> np.ndarray:
    whole = x[: len(x) // window * window].reshape(-1, window)
    return np.sqrt(np.square(whole, dtype=np.float64).mean(axis=1)).astype(np.float32)


def onset_envelope(envelope: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.diff(envelope, prepend=envelope[:1])).astype(np.float32)


def lags(fps: float, low: float = MIN_BPM, high: float = MAX_BPM) -> tuple[int, int]:
    return int(60 / high * fps), math.ceil(60 / low * fps)


def parabolic(values: np.ndarray, at: int, low: int, high: int) -> float:
    """A peak's place between samples; the sample itself at the edges or when the fit leaves it by half a step."""
    if not low < at < high:
        return float(at)
    a, b, c = (float(v) for v in values[at - 1 : at + 2])
    curve = a - 2 * b + c
    shift = 0.5 * (a - c) / curve if curve else 0.0
    return at + shift if abs(shift) <= 0.5 else float(at)


def tempo_from_onsets(onsets: np.ndarray, fps: float) -> tuple[float, float]:
    """(bpm, confidence) by overlap-normalised autocorrelation, harmonics, a sub-harmonic penalty and a prior at 125."""
    low, high = lags(fps)
    low = max(2, low)
    if high >= len(onsets):
        return 120.0, 0.0
    x = onsets.astype(float)
    acf = np.zeros(high + 1, np.float32)
    acf[low:] = [np.dot(x[:-k], x[k:]) / (len(x) - k) for k in range(low, high + 1)]
    wide, lag = acf.astype(float), np.arange(low, high + 1)
    score = np.zeros(len(lag))
    for h, w in enumerate(HARMONICS, 1):
        ok = lag * h <= high
        score[ok] += w * wide[lag[ok] * h]
    half = js_round(lag / 2)
    ratio = wide[half] / np.maximum(1e-9, wide[lag])
    score = np.where(half >= low, score / (1 + 1.6 * np.maximum(0, ratio)), score)
    prior = np.exp(-np.log(60 * fps / lag / 125) ** 2 / (2 * 0.35**2))
    scores = np.zeros(high + 1, np.float32)
    scores[low:] = score * (0.75 + 0.25 * prior)
    peak = low + int(scores[low:].argmax())
    median = float(np.sort(scores[low:])[len(lag) // 2])
    return 60 * fps / parabolic(scores, peak, low, high), clamp01((float(scores[peak]) / max(1e-9, median) - 1) / 4)


def first_beat(onsets: np.ndarray, fps: float, bpm: float, teeth: int = 16, seconds: float = 4) -> float:
    """The phase whose comb of ``teeth`` beats gathers most onset."""
    n = min(len(onsets), int(fps * seconds))
    if not n:
        return 0.0
    at = js_round(np.arange(n)[:, None] + np.arange(teeth) * (60 / bpm * fps))
    sums = np.where(at < len(onsets), onsets[np.minimum(at, len(onsets) - 1)], 0).sum(axis=1, dtype=np.float64)
    return int(sums.argmax()) / fps


def beat_grid(first: float, bpm: float, seconds: float) -> np.ndarray:
    """Beats from ``first`` up to the end, by repeated addition of the period."""
    n = max(0, math.ceil((seconds - first) * bpm / 60) + 2)
    at = np.cumsum(np.r_[first, np.full(n, 60 / bpm)])
    return at[at < seconds]


def is_stable(beats: np.ndarray) -> bool:
    if len(beats) < 8:
        return False
    gaps = np.diff(beats)
    return bool(gaps.std() / gaps.mean() < 0.05)


def upper_median(values: np.ndarray) -> float:
    return float(np.sort(values)[len(values) // 2])


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def magnitudes(frames: np.ndarray, size: int) -> np.ndarray:
    return np.abs(np.fft.rfft(frames * hann(size), axis=-1))[..., : size // 2]


def spectral_flux(x: np.ndarray, size: int = FLUX_FRAME, hop: int = FLUX_HOP) -> np.ndarray:
    """Sum of the positive change of log magnitudes between frames; the first frame has none."""
    n = max(0, (len(x) - size) // hop)
    out = np.zeros(n, np.float32)
    last = None
    for a in range(0, n, 512):
        b = min(n, a + 512)
        frames = np.stack([x[i * hop : i * hop + size] for i in range(a, b)])
        log = np.log1p(1000 * magnitudes(frames, size)).astype(np.float32)
        rows = log if last is None else np.vstack([last, log])
        rise = np.maximum(0, np.diff(rows, axis=0)).sum(axis=1, dtype=np.float64)
        out[b - len(rise) : b] = rise
        last = log[-1:]
    return out


def above_local_mean(envelope: np.ndarray, frames: int) -> np.ndarray:
    half, n = max(1, frames // 2), len(envelope)
    total = np.r_[0.0, np.cumsum(envelope, dtype=np.float64)]
    a, b = np.maximum(0, np.arange(n) - half), np.minimum(n, np.arange(n) + half)
    return np.maximum(0, envelope - (total[b] - total[a]) / np.maximum(1, b - a)).astype(np.float32)


def rayleigh_tempos(onsets: np.ndarray, fps: float) -> tuple[float, float, list[float]]:
    """(bpm, confidence, further candidates): the five highest local maxima of the weighted autocorrelation."""
    low, high = lags(fps)
    lag = np.arange(low, high + 1)
    x = onsets.astype(float)
    acf = np.array([np.dot(x[: len(x) - k], x[k:]) if k < len(x) else 0.0 for k in lag], np.float32)
    variance = (60 / RAYLEIGH_BPM * fps) ** 2 / 2
    weighted = (acf * (lag / variance) * np.exp(-(lag**2) / (2 * variance))).astype(np.float32)
    inner = weighted[1:-1]
    peaks = np.flatnonzero((inner > weighted[:-2]) & (inner > weighted[2:])) + 1
    peaks = peaks[np.argsort(-weighted[peaks], kind="stable")][:5]
    if not len(peaks):
        return 120.0, 0.0, []
    mean = float(weighted.mean(dtype=np.float64))
    tempos = (60 * fps / lag[peaks]).tolist()
    return tempos[0], clamp01((float(weighted[peaks[0]]) / max(1e-9, mean) - 1) / 4), tempos[1:]


def track_beats(onsets: np.ndarray, fps: float, bpm: float) -> tuple[np.ndarray, float]:
    """Beat times and mean score by dynamic programming (Ellis 2007) around one tempo."""
    n, period = len(onsets), 60 / bpm * fps
    if not n:
        return np.zeros(0), -math.inf
    low = max(1, int(0.5 * period))
    back = np.arange(low, max(low + 1, math.ceil(2 * period)) + 1)
    cost = TIGHTNESS * np.log(back / period) ** 2
    best, link = np.zeros(n, np.float32), np.full(n, -1)
    for t in range(n):
        m = min(len(back), t - low + 1)
        if m <= 0:
            best[t] = onsets[t]
            continue
        options = best[t - back[:m]] - cost[:m]
        i = int(options.argmax())
        best[t], link[t] = onsets[t] + options[i], t - back[i]
    start = max(0, n - math.ceil(2 * period))
    at = end = start + int(best[start:].argmax())
    frames = []
    while at >= 0:
        frames.append(at)
        at = link[at]
    return np.array(frames[::-1]) / fps, float(best[end]) / len(frames)


def detect_tempo(x: np.ndarray, rate: float) -> dict:
    """The detector on its own: of the three likeliest tempos the one whose beats score best."""
    fps = rate / FLUX_HOP
    onsets = above_local_mean(spectral_flux(x), int(fps * 4))
    bpm, confidence, more = rayleigh_tempos(onsets, fps)
    tracked = [(track_beats(onsets, fps, b), b) for b in [bpm, *more[:2]]]
    (beats, _), bpm = max(tracked, key=lambda r: r[0][1])
    if len(beats) >= 8 and (middle := upper_median(np.diff(beats))) > 0:
        bpm = float(js_round(60 / middle * 100)) / 100
    return {"bpm": bpm, "confidence": confidence, "beats": beats, "first": first_beat(onsets, fps, bpm), "stable": is_stable(beats), "onsets": onsets, "fps": fps}


def _constant(beats: np.ndarray) -> bool:
    """Whether equal spacing from the first beat to the last explains all between, within the phase tolerances."""
    n = len(beats) - 1
    mean = (beats[-1] - beats[0]) / n
    error = beats[0] + mean * np.arange(1, n + 1) - beats[1:]
    wrong = np.abs(error) > PHASE_ERROR
    if wrong[0] or wrong.sum() > MOST_OUTLIERS or np.abs(np.cumsum(error)).max() > PHASE_ERROR_SUM:
        return False
    border = abs(beats[1] - beats[0] + beats[-1] - beats[-2] - 2 * mean) if n > 2 else 0.0
    return border < PHASE_ERROR / 2


def constant_regions(beats: np.ndarray) -> list[tuple[float, float, int]]:
    """(first beat, beat length, beats) of successive longest constant stretches."""
    out, left = [], 0
    while left < len(beats) - 1:
        # what the first beat and the borders alone rule out needs no look at the beats between
        ends = np.arange(left + 1, len(beats))
        mean = (beats[ends] - beats[left]) / (ends - left)
        border = np.where(ends - left > 2, np.abs(beats[left + 1] - beats[left] + beats[ends] - beats[ends - 1] - 2 * mean), 0.0)
        fits = (np.abs(beats[left] + mean - beats[left + 1]) <= PHASE_ERROR * (1 + 1e-9)) & (border < PHASE_ERROR / 2 * (1 + 1e-9))
        right = next((r for r in ends[fits][::-1].tolist() if _constant(beats[left : r + 1])), None)
        if right is None:
            left += 1
            continue
        out.append((float(beats[left]), float(beats[right] - beats[left]) / (right - left), right - left))
        left = right
    return out


def snapped_tempo(low: float, center: float, high: float) -> float:
    if not all(math.isfinite(v) and v > 0 for v in (low, center, high)):
        return center
    for fraction, below, above in TEMPO_LADDER:
        x = math.floor(center * fraction + 0.5) / fraction
        if low < x < high and (below is None or center < below) and (above is None or center > above):
            return x
    return center


def tempo_band(bpm: float, beats: int = 32, tolerance: float = PHASE_ERROR) -> tuple[float, float]:
    delta = tolerance * bpm * bpm / (beats * 60) if math.isfinite(bpm) and bpm > 0 else 0.0
    return bpm - delta, bpm + delta


def constant_tempo(beats: np.ndarray) -> tuple[float, float, float] | None:
    """(bpm, first beat, coverage) of the longest constant stretch, or None if it explains less than half."""
    regions = constant_regions(beats) if len(beats) >= REGION_BEATS else []
    if not regions:
        return None
    first, length, n = max(regions, key=lambda r: r[2])
    low, high = tempo_band(60 / length)
    bpm = snapped_tempo(low, 60 / length, high)
    coverage = n / max(1, len(beats) - 1)
    return (bpm, first % (60 / bpm), coverage) if coverage >= COVERAGE else None


def chroma(x: np.ndarray, rate: float, block: int = 4096, step: int = 2048) -> np.ndarray:
    """Energy of twelve pitch classes over four octaves from C3, normalised to a maximum of 1."""
    notes = 48 + np.arange(12)[:, None] + 12 * np.arange(4)
    k = np.floor(0.5 + block * 440 * 2.0 ** ((notes - 69) / 12) / rate)
    basis = np.exp(-2j * np.pi * k.ravel()[:, None] * np.arange(block) / block)
    starts = range(0, max(0, len(x) - block), step)
    total = np.zeros(48)
    window = hann(block)
    for a in range(0, len(starts), 256):
        frames = np.stack([x[s : s + block] for s in starts[a : a + 256]]) * window
        total += np.abs(frames @ basis.T).sum(axis=0)
    out = total.reshape(12, 4).sum(axis=1)
    return (out / out.max() if out.max() > 0 else out).astype(np.float32)


def key_of(chroma_bins: np.ndarray) -> dict:
    """The best of 24 rotated profiles; confidence is twice its lead over the runner-up."""
    c = np.asarray(chroma_bins, float)
    turned = np.stack([np.roll(c, -s) for s in range(12)])
    scores = []
    for profile in (np.array(MAJOR), np.array(MINOR)):
        scores.append(turned @ profile / max(1e-9, math.sqrt(float(c @ c) * float(profile @ profile))))
    flat = np.stack(scores, axis=1).ravel()
    at = int(flat.argmax())
    root, scale = PITCHES[at // 2], ("major", "minor")[at % 2]
    lead = flat[at] - np.sort(flat)[-2]
    return {"root": root, "scale": scale, "camelot": WHEEL[f"{root} {scale}"], "confidence": clamp01(2 * float(lead))}


def _biquad(x: np.ndarray, b: tuple[float, float, float], a: tuple[float, float]) -> np.ndarray:
    """A second-order filter, block by block: what a block's input gives is one product with the impulse
    response, and only the two values that cross to the next block are carried in a loop."""
    if not len(x):
        return np.zeros(0, np.float32)
    a1, a2 = a
    feed = np.convolve(x.astype(float), b)[: len(x)]
    n = -(-len(feed) // FILTER_BLOCK)
    impulse = [1.0, -a1]
    while len(impulse) < FILTER_BLOCK + 2:
        impulse.append(-a1 * impulse[-1] - a2 * impulse[-2])
    h = np.array(impulse)
    lag = np.arange(FILTER_BLOCK)[:, None] - np.arange(FILTER_BLOCK)
    own = np.pad(feed, (0, n * FILTER_BLOCK - len(feed))).reshape(n, FILTER_BLOCK) @ np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0).T
    # the response to the two values before a block: the last one, and the one before it
    one, two = h[1 : FILTER_BLOCK + 1], -a2 * h[:FILTER_BLOCK]
    carried, y1, y2 = np.zeros((n, 2)), 0.0, 0.0
    for i, (u, v) in enumerate(zip(own[:, -1].tolist(), own[:, -2].tolist())):
        carried[i] = y1, y2
        y1, y2 = u + one[-1] * y1 + two[-1] * y2, v + one[-2] * y1 + two[-2] * y2
    return (own + carried @ np.stack([one, two])).ravel()[: len(feed)].astype(np.float32)


def k_weighting(rate: float) -> list[tuple[tuple[float, float, float], tuple[float, float]]]:
    """The two filters of ITU-R BS.1770 for any rate, from their analog parameters; at 48 kHz the standard's own values."""
    k = math.tan(math.pi * 1681.974450955533 / rate)
    q, high = 0.7071752369554196, 10 ** (3.999843853973347 / 20)
    band = high**0.4996667741545416
    n = 1 + k / q + k * k
    shelf = ((high + band * k / q + k * k) / n, 2 * (k * k - high) / n, (high - band * k / q + k * k) / n), (2 * (k * k - 1) / n, (1 - k / q + k * k) / n)
    k, q = math.tan(math.pi * 38.13547087602444 / rate), 0.5003270373238773
    n = 1 + k / q + k * k
    return [shelf, ((1.0, -2.0, 1.0), (2 * (k * k - 1) / n, (1 - k / q + k * k) / n))]


def _mean_lufs(blocks: np.ndarray) -> float:
    return -0.691 + 10 * math.log10(max(1e-12, float(np.mean(10 ** ((blocks + 0.691) / 10)))))


def loudness(channels: list[np.ndarray], rate: float, target: float = TARGET_LUFS) -> tuple[float, float]:
    """(integrated LUFS, gain to the target): 400 ms blocks every 100 ms, gated at -70 and 10 below the mean.

    Silence has -inf and no gain; a clip of less than a block its RMS less 3 dB.
    """
    block = int(0.4 * rate)
    hop = int(block * 0.25)
    if not len(channels) or len(channels[0]) < block:
        whole = np.concatenate(channels) if len(channels) else np.zeros(0)
        rough = decibels(rms(whole)) - 3
        return rough, target - rough
    power = np.zeros((len(channels[0]) - block) // hop + 1)
    for c in channels:
        for b, a in k_weighting(rate):
            c = _biquad(c, b, a)
        total = np.r_[0.0, np.cumsum(np.square(c, dtype=np.float64))]
        at = np.arange(len(power)) * hop
        power += (total[at + block] - total[at]) / block
    blocks = -0.691 + 10 * np.log10(np.maximum(1e-12, power))
    blocks = blocks[blocks >= ABSOLUTE_GATE]
    if not len(blocks):
        return -math.inf, 0.0
    mean = _mean_lufs(blocks)
    gated = blocks[blocks >= mean + RELATIVE_GATE]
    out = _mean_lufs(gated) if len(gated) else mean
    return out, target - out


def energy_profile(x: np.ndarray, beats: np.ndarray, rate: float = RATE) -> dict:
    whole = rms(x)
    if len(beats) < 8:
        return {"mean": clamp01(2 * whole), "peak": clamp01(2 * whole), "per_bar": [], "rms_db": decibels(whole)}
    edges = (beats * rate).astype(int)
    bars = [rms(x[edges[i] : edges[i + 4]]) for i in range(0, len(beats) - 4, 4) if edges[i + 4] > edges[i]]
    return {"mean": clamp01(2 * sum(bars) / max(1, len(bars))), "peak": clamp01(2 * max(bars, default=0)), "per_bar": [clamp01(2 * b) for b in bars], "rms_db": decibels(whole)}


def cue_points(energy: dict, beats: np.ndarray, downbeats: np.ndarray, seconds: float) -> dict:
    """Mix-in at the first and mix-out at the last bar of 45 % of the peak, on the nearest downbeat."""
    bars = np.array(energy["per_bar"])
    if not len(bars) or not len(downbeats):
        start, end = min(8.0, seconds), max(0.0, seconds - 16)
    else:
        loud = np.flatnonzero(bars >= 0.45 * energy["peak"])
        first, last = (loud[0], loud[-1]) if len(loud) else (0, len(bars) - 1)
        start, end = (nearest(downbeats, float(beats[min(len(beats) - 1, 4 * b)])) for b in (first, last))
    return {"intro_start": 0.0, "intro_end": start, "outro_start": end, "outro_end": seconds, "mix_in": start, "mix_out": end}


def nearest(downbeats: np.ndarray, time: float) -> float:
    return float(downbeats[np.abs(np.asarray(downbeats) - time).argmin()])


def peaks(x: np.ndarray, bins: int = PEAK_BINS) -> list[float]:
    """Maximum magnitudes of equal blocks over their maximum; samples that fill no block are left out."""
    n = len(x) // bins
    if not n:
        return [0.0] * bins
    out = np.abs(x[: n * bins]).reshape(bins, n).max(axis=1).astype(float)
    return (out / out.max() if out.max() > 0 else out).tolist()


def overview(x: np.ndarray, rate: float) -> bytes:
    """A picture of 240 columns and 16 log-spaced bands as bytes, after a header of two."""
    out = np.zeros(OVERVIEW_COLUMNS * OVERVIEW_BANDS)
    head = bytes((1, 5))
    if len(x) >= FLUX_FRAME:
        size, half = FLUX_FRAME, FLUX_FRAME // 2
        edges = 40 * (rate / 2 / 40) ** (np.arange(OVERVIEW_BANDS + 1) / OVERVIEW_BANDS)
        bins = np.clip(np.floor(edges * size / rate).astype(int), 1, half)
        column = len(x) // OVERVIEW_COLUMNS
        for c in range(OVERVIEW_COLUMNS):
            starts = [s for k in range(max(1, column // half)) if (s := c * column + k * half) + size <= len(x)]
            if starts:
                total = np.r_[0.0, np.cumsum(magnitudes(np.stack([x[s : s + size] for s in starts]), size).mean(axis=0))]
                bands = (total[bins[1:]] - total[bins[:-1]]) / np.maximum(1, np.diff(bins))
                out[c * OVERVIEW_BANDS : (c + 1) * OVERVIEW_BANDS] = np.log1p(50 * bands)
        if out.max() > 0:
            out = np.minimum(255, out * 255 / (0.95 * out.max()))
    return head + js_round(out).astype(np.uint8).tobytes()


def display_bars(values: list[float], n: int = DISPLAY_BARS) -> list[float]:
    """``n`` of the peaks, evenly spaced; without peaks a swell with a fixed jitter."""
    if values:
        return [clamp01(values[int(i * len(values) / n)]) for i in range(n)]
    # The swell and its jitter.
    swell = [0.35 + 0.55 * math.sin(i / max(1, n - 1) * math.pi) for i in range(n)]
    return [clamp01(s + 0.12 * math.fmod(math.sin(i * 12.9898) * 43758.5453, 1.0)) for i, s in enumerate(swell)]


def quality_label(bpm_confidence: float, stable: bool, key_confidence: float) -> str:
    if bpm_confidence < 0.3 or not stable:
        return "unreliable"
    return "partial" if bpm_confidence < 0.55 or key_confidence < 0.25 else "good"


def analyze(channels: list[np.ndarray], rate: float, seconds: float, named: tuple[float, float] | None = None, tag: tuple[float, float] | None = None) -> dict:
    """The whole analysis of one track. ``named``: (bpm, confidence) from its name; ``tag``: (bpm, first beat) stored in it.

    Tempo: the tag's, else the name's, else the audio's. The spectral flux is computed once.
    """
    x = resampled(mono(channels), rate, RATE)
    found = detect_tempo(x, RATE)
    prior, _ = tempo_from_onsets(onset_envelope(energy_envelope(x)), RATE / ENVELOPE_WINDOW)
    beats, _ = track_beats(found["onsets"], found["fps"], prior)
    ironed = constant_tempo(beats)
    audio = ironed[0] if ironed else prior
    confidence = max(found["confidence"], min(1.0, ironed[2])) if ironed else found["confidence"]
    real = beats if ironed else found["beats"]
    bpm = audio
    if named:
        ratio = audio / named[0]
        agrees = any(abs(ratio - t) <= 0.04 * t for t in (1, 2, 0.5, 1.5, 2 / 3))
        bpm, confidence = float(named[0]), max(named[1], confidence) if agrees else 0.7 * named[1]
    if tag:
        bpm, confidence = tag[0], 1.0
        grid = beat_grid(tag[1], bpm, seconds)
    elif ironed and bpm == audio:
        grid = beat_grid(ironed[1], bpm, seconds)
    elif len(real) >= 16:
        grid = real
    else:
        grid = beat_grid(found["first"], bpm, seconds)
    downbeats, stable = grid[::4], is_stable(grid)
    key = key_of(chroma(x, RATE))
    energy = energy_profile(x, grid)
    lufs, gain = loudness(channels, rate)
    return {
        "bpm": bpm, "bpm_confidence": confidence, "first_beat": float(grid[0]) if len(grid) else 0.0, "beats": grid.tolist(), "downbeats": downbeats.tolist(),
        "is_stable": True if tag else found["stable"] or stable, "key": key, "energy": energy, "cues": cue_points(energy, grid, downbeats, seconds), "waveform": peaks(x),
        "integrated_lufs": lufs, "suggested_gain_db": gain, "overview": overview(x, RATE), "quality": quality_label(confidence, stable, key["confidence"]),
    }


def snap_beats(onsets: np.ndarray, fps: float, bpm: float, first: float, share: float = 0.12) -> tuple[np.ndarray, float]:
    """Beats that follow onsets: each prediction moves to the strongest onset within a share of the beat; (beats, fraction hit)."""
    period, at, out, hits = 60 / bpm * fps, first * fps, [], 0
    floor = float(onsets.mean()) if len(onsets) else 0.0
    while at < len(onsets):
        reach = share * period
        low, high = max(0, math.ceil(at - reach)), min(len(onsets) - 1, int(at + reach))
        if high >= low and onsets[i := low + int(onsets[low : high + 1].argmax())] > floor:
            hits += 1
            place = parabolic(onsets, i, 0, len(onsets) - 1)
            if out:
                period = 0.85 * period + 0.15 * (place - out[-1])
            at = place
        out.append(at)
        at += period
    return np.array(out) / fps, hits / max(1, len(out))

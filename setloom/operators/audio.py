"""Track analysis over PCM rows: one Arrow stage, a track a row, nothing shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from setloom.functions import codecs, dsp

ANALYSIS = (
    "track_id string, bpm double, bpm_confidence double, first_beat double, beats array<double>, downbeats array<double>, is_stable boolean, "
    "key struct<root:string,scale:string,camelot:string,confidence:double>, energy struct<mean:double,peak:double,per_bar:array<double>,rms_db:double>, "
    "cues struct<intro_start:double,intro_end:double,outro_start:double,outro_end:double,mix_in:double,mix_out:double>, "
    "waveform array<double>, integrated_lufs double, suggested_gain_db double, overview binary, quality string"
)
#: Rows are large: few of them should share an Arrow batch.
BATCH_ROWS = "16"


def click_track(bpm: float, seconds: float = 20.0, seed: int = 42, rate: int = dsp.RATE, jitter: float = 0.0) -> np.ndarray:
    """Decaying 60 Hz clicks on the beat over faint noise, from a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = rng.uniform(-0.005, 0.005, int(seconds * rate)).astype(np.float32)
    k = np.arange(1800)
    click = (0.8 * np.sin(2 * np.pi * 60 * k / rate) * np.exp(-k / 500)).astype(np.float32)
    for t in np.arange(0.25, seconds, 60 / bpm):
        at = int((t + rng.normal(0, jitter) if jitter else t) * rate)
        part = click[: max(0, len(out) - at)]
        out[at : at + len(part)] += part
    return out


def click_tracks(ids: DataFrame, seconds: float = 20.0) -> DataFrame:
    """(track_id, sample_rate, duration_sec, channels) for ``ids(track_id, bpm)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame([{"track_id": r.track_id, "sample_rate": dsp.RATE, "duration_sec": seconds, "channels": [click_track(r.bpm, seconds)]}])

    return ids.select("track_id", "bpm").mapInPandas(run, "track_id string, sample_rate int, duration_sec double, channels array<array<float>>")


def _channels(value) -> list[np.ndarray]:
    return [np.asarray(c, np.float32) for c in (value if value is not None else [])]


def analyze(pcm: DataFrame) -> DataFrame:
    """``pcm(track_id, sample_rate, duration_sec, channels)`` and optionally name_bpm, name_confidence, tag_bpm, tag_first; the analysis of each track."""
    columns = [c for c in ("track_id", "sample_rate", "duration_sec", "channels", "name_bpm", "name_confidence", "tag_bpm", "tag_first") if c in pcm.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                pair = lambda a, b: None if r.get(a) is None or pd.isna(r[a]) else (float(r[a]), float(r.get(b) or 0.0))
                found = dsp.analyze(_channels(r["channels"]), r["sample_rate"], r["duration_sec"], pair("name_bpm", "name_confidence"), pair("tag_bpm", "tag_first"))
                yield pd.DataFrame([{"track_id": r["track_id"], **found}])

    return pcm.select(*columns).mapInPandas(run, ANALYSIS)


def tag_round_trip(analysed: DataFrame) -> DataFrame:
    """(track_id, bpm, markers, first_position, cues, bytes): what reading a written tag gives back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                cues = [{"index": i, "position_ms": 1000 * t} for i, t in enumerate((r.mix_in, r.mix_out))]
                file = codecs.inject_geob(b"\xff\xfb\x90\x00", codecs.payloads(r.bpm, list(r.beats), cues, 0.0, r.overview))
                frames = codecs.read_geob(file)
                grid = codecs.decode_beat_grid(frames.get(codecs.BEATGRID, b""))
                marks = codecs.decode_markers(frames[codecs.MARKERS])
                rows.append((r.track_id, codecs.decode_autotags(frames[codecs.AUTOTAGS])["bpm"], len(grid["positions"]) if grid else 0, grid["positions"][0] if grid else None, [c["position_ms"] for c in marks["cues"]], len(file)))
            yield pd.DataFrame(rows, columns=["track_id", "bpm", "markers", "first_position", "cues", "bytes"])

    chosen = analysed.selectExpr("track_id", "bpm", "beats", "cues.mix_in", "cues.mix_out", "overview")
    return chosen.mapInPandas(run, "track_id string, bpm double, markers long, first_position double, cues array<long>, bytes long")

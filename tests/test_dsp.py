"""Audio analytics on seeded click tracks, and codecs by round trip and literal bytes."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from setloom.functions import codecs, dsp
from setloom.operators.audio import click_track


@pytest.mark.parametrize("bpm", [92, 124, 140])
def test_tempo(bpm):
    out = dsp.analyze([click_track(bpm, 40)], dsp.RATE, 40.0)
    assert abs(out["bpm"] - bpm) < 0.5
    gaps = np.diff(out["beats"])
    assert np.allclose(gaps, 60 / out["bpm"], atol=0.05) and set(out["downbeats"]) <= set(out["beats"])
    assert len(out["waveform"]) == 512 and 0 <= out["cues"]["mix_in"] <= out["cues"]["mix_out"] <= 40


def test_precedence():
    x = click_track(120, 20)
    assert dsp.analyze([x], dsp.RATE, 20.0, named=(96, 0.9))["bpm"] == 96
    tagged = dsp.analyze([x], dsp.RATE, 20.0, named=(96, 0.9), tag=(106.62, 0.3886))
    assert tagged["bpm"] == 106.62 and tagged["beats"][0] == 0.3886 and tagged["bpm_confidence"] == 1


def test_filters_are_the_standard_at_48k():
    (b, a), (b2, a2) = dsp.k_weighting(48000)
    assert b == pytest.approx((1.53512485958697, -2.69169618940638, 1.19839281085285), abs=1e-9)
    assert a == pytest.approx((-1.69065929318241, 0.73248077421585), abs=1e-9)
    assert a2 == pytest.approx((-1.99004745483398, 0.99007225036621), abs=1e-9)


def test_loudness_of_a_sine():
    x = np.sin(2 * np.pi * 997 * np.arange(3 * 48000) / 48000).astype(np.float32)
    assert dsp.loudness([x], 48000)[0] == pytest.approx(-3.01, abs=0.05)
    assert dsp.loudness([np.zeros(48000, np.float32)], 48000) == (-math.inf, 0.0)


def test_key_of_a_chord():
    c = np.zeros(12)
    c[[0, 4, 7]] = 1
    assert dsp.key_of(c)["camelot"] == "8B"
    t = np.arange(3 * dsp.RATE) / dsp.RATE
    x = sum(np.sin(2 * np.pi * 440 * 2 ** ((m - 69) / 12) * t) for m in (57, 60, 64)).astype(np.float32)
    assert dsp.key_of(dsp.chroma(x, dsp.RATE))["camelot"] == "8A"


def test_filter_blocks_equal_the_recurrence():
    rng = np.random.default_rng(1)
    for rate in (8000, 44100, 48000):
        for n in (0, 1, 2, 127, 128, 129, 5000):
            x = rng.standard_normal(n).astype(np.float32)
            for b, a in dsp.k_weighting(rate):
                feed, y = np.convolve(x.astype(float), b)[:n] if n else np.zeros(0), [0.0, 0.0]
                for f in feed:
                    y.append(f - a[0] * y[-1] - a[1] * y[-2])
                assert np.allclose(dsp._biquad(x, b, a), y[2:], rtol=1e-5, atol=1e-6)


def test_regions_equal_trying_every_end():
    rng = np.random.default_rng(3)
    for noise in (0.0, 0.004, 0.02, 0.1):
        beats = np.cumsum(0.5 + noise * rng.standard_normal(90))
        out, left = [], 0
        while left < len(beats) - 1:
            right = next((r for r in range(len(beats) - 1, left, -1) if dsp._constant(beats[left : r + 1])), None)
            if right is None:
                left += 1
                continue
            out.append((float(beats[left]), float(beats[right] - beats[left]) / (right - left), right - left))
            left = right
        assert dsp.constant_regions(beats) == out


def test_display_bars():
    bars = dsp.display_bars([])
    assert len(bars) == 220 and min(bars) >= 0 and max(bars) <= 1 and bars[0] == 0.35
    assert dsp.display_bars([0.5, 2.0, -1.0], 6) == [0.5, 0.5, 1.0, 1.0, 0.0, 0.0]


def test_constant_regions():
    beats = np.r_[np.arange(40) * 0.5, 19.5 + np.arange(1, 20) * 0.48]
    regions = dsp.constant_regions(beats)
    assert regions[0][1] == pytest.approx(0.5, abs=1e-3) and regions[0][2] >= 38
    assert dsp.constant_tempo(np.arange(40) * 0.5)[0] == 120
    assert dsp.constant_tempo(np.arange(10) * 0.5) is None


def test_short_and_empty():
    assert dsp.tempo_from_onsets(np.zeros(10, np.float32), 86.0) == (120.0, 0.0)
    out = dsp.analyze([np.zeros(100, np.float32)], dsp.RATE, 0.005)
    assert out["quality"] == "unreliable" and len(out["overview"]) == 2 + 240 * 16
    assert dsp.upper_median(np.array([4, 1, 3, 2])) == 3


def test_literal_bytes():
    assert codecs.encode_autotags(128, -1.5, 0) == b"\x01\x01128.00\x00-1.500\x000.000\x00"
    assert codecs.encode_beat_grid([], 120) == b"\x01\x00\x00\x00\x00\x00\x37"
    assert codecs.encode_beat_grid([0.5], 120) == b"\x01\x00\x00\x00\x00\x01" + b"\x3f\x00\x00\x00\x42\xf0\x00\x00" + b"\x37"
    assert len(codecs.encode_markers()) == 470
    assert codecs.decode_autotags(b"") is None and codecs.decode_beat_grid(b"\x01\x00\x00\x00\x00\x09") is None


cue = st.builds(lambda i, p, n, c: {"index": i, "position_ms": p, "name": n, "color": c}, st.integers(0, 7), st.integers(0, 2**31), st.text(st.characters(blacklist_characters="\0", blacklist_categories=("Cs",)), max_size=8), st.integers(0, 0xFFFFFF))


@settings(max_examples=50, deadline=None)
@given(st.lists(cue, max_size=8), st.booleans())
def test_markers_round_trip(cues, locked):
    out = codecs.decode_markers(codecs.encode_markers(cues, locked=locked))
    assert out["locked"] is locked and out["cues"] == sorted(cues, key=lambda c: c["position_ms"])


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=40), st.lists(st.binary(max_size=30), min_size=1, max_size=3), st.sampled_from([3, 4]))
def test_frames_round_trip(audio, data, version):
    audio = b"\xff" + audio
    once = codecs.inject_geob(audio, {"d0": b"old"})
    if version == 4:
        body = codecs.encode_geob("d0", b"old", 4)
        once = b"ID3\x04\0\0" + codecs.to_synchsafe(len(body)) + body + audio
    twice = codecs.inject_geob(once, {f"d{i}": d for i, d in enumerate(data)})
    assert codecs.read_geob(twice) == {f"d{i}": d for i, d in enumerate(data)} and twice.endswith(audio)


def test_snapping_tracker_follows_onsets():
    x = click_track(120, 20)
    onsets = dsp.onset_envelope(dsp.energy_envelope(x))
    beats, hit = dsp.snap_beats(onsets, dsp.RATE / dsp.ENVELOPE_WINDOW, 121.0, 0.25)
    assert hit > 0.9 and np.median(np.diff(beats)) == pytest.approx(0.5, abs=0.01)


def test_first_beat_and_grid():
    fps = dsp.RATE / dsp.ENVELOPE_WINDOW
    onsets = dsp.onset_envelope(dsp.energy_envelope(click_track(100, 20)))
    assert dsp.first_beat(onsets, fps, 100) % 0.6 == pytest.approx(0.25, abs=0.03)
    assert dsp.beat_grid(0.5, 120, 2.0).tolist() == [0.5, 1.0, 1.5]
    assert len(dsp.display_bars([0.1] * 512)) == 220 == len(dsp.display_bars([]))


def test_resampling_and_mixdown():
    assert dsp.resampled(np.array([0.0, 1.0, 2.0, 3.0], np.float32), 2, 1).tolist() == [0.0, 2.0]
    assert dsp.mono([np.array([1.0, 3.0]), np.array([3.0, 5.0])]).tolist() == [2.0, 4.0]
    assert dsp.peaks(np.zeros(10)) == [0.0] * 512

"""Spikes do not depend on segments; waveforms, alignment and groups of channels beside plain NumPy."""

import numpy as np
import pytest

from pulsegrid.operators import spikes

C = spikes.Detection(10_000.0, before=8, behind=14, dead=16, least=4.0, most=60.0)


def made(seed, n, sign=-1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, n)
    shape = np.diff(np.exp(-((np.arange(-12, 13) / 3.0) ** 2)))
    for at in rng.integers(30, n - 40, n // 150):
        x[at : at + len(shape)] += sign * 30 * shape[::-1]
    x[n // 2 : n // 2 + 4] += 4000  # an artifact
    return x


def rows_of(channels, size=32):
    return [("r", name, k // size, x[k : k + size].tolist()) for name, x in channels.items() for k in range(0, len(x), size)]


def by_hand(x, c):
    """The rule over a whole channel in one go."""
    d, kept = spikes.band_passed(x, c.detect, c), spikes.band_passed(x, c.keep, c)
    limit, top = (m * np.median(np.abs(v)) / 0.6745 for m, v in ((c.least, d), (c.most, kept)))
    out, dead = [], 0
    for i in range(c.before + 1, len(x) - c.behind - 2 - c.reach):
        if -d[i] > limit and i >= dead:
            j = int(np.argmin(kept[i : i + c.reach]))
            if j == 0 and not (kept[i + 1 : i + 1 + c.reach] < limit).any():
                continue
            peak = i + j
            dead = peak + c.dead
            if np.abs(kept[peak - c.before : peak + c.behind + 1]).max() < top:
                out.append((peak, kept[peak - c.before - 1 : peak + c.behind + 3]))
    return out


@pytest.mark.parametrize("segment_blocks", [3, 40, 100_000])
def test_spikes_do_not_depend_on_segments(spark, segment_blocks):
    channels = {"a": made(1, 4000), "b": made(2, 2500)}
    df = spark.createDataFrame(rows_of(channels), "run_id string, channel string, block_no long, samples array<double>")
    got = spikes.amplitude_spikes(df, C, segment_blocks, 32).orderBy("channel", "peak").toPandas()
    assert len(got) > 10
    for name, x in channels.items():
        want, own = by_hand(x, C), got[got.channel == name]
        assert own.peak.tolist() == [p for p, _ in want]
        assert np.allclose(np.stack(own["wave"]), spikes.aligned(np.stack([w for _, w in want]), C), atol=1e-5)


def test_splines_pass_their_points_and_follow_cubics():
    m = spikes.spline_matrix(9, 4)
    t = np.arange(1, 10)
    cubic = 2 - t + 0.5 * t**2 - 0.1 * t**3
    at = np.arange(1, 37) / 4
    assert np.allclose(m @ cubic, 2 - at + 0.5 * at**2 - 0.1 * at**3)
    y = np.random.default_rng(1).normal(size=9)
    assert np.allclose((m @ y)[3::4], y)
    # a peak between samples comes to the same place in each waveform
    c = spikes.Detection(10_000.0, before=6, behind=8, dead=10, factor=8)
    waves = np.stack([-np.exp(-(((np.arange(18) - 7 - s) / 2.5) ** 2)) for s in (-0.5, -0.2, 0.0, 0.3, 0.5)])
    fine = spikes.aligned(waves, c)
    assert fine.shape == (5, 14) and np.abs(fine - fine[2]).max() < 0.03 < np.abs(waves[:, 2:-2] - waves[2, 2:-2]).max()


@pytest.mark.parametrize("polarity", ["pos", "both"])
def test_other_polarities(spark, polarity):
    x = made(4, 3000, 1)
    c = spikes.Detection(10_000.0, before=8, behind=14, dead=16, least=4.0, most=60.0, polarity=polarity, factor=1)
    df = spark.createDataFrame(rows_of({"a": x}), "run_id string, channel string, block_no long, samples array<double>")
    got = [spikes.amplitude_spikes(df, c, n, 32).orderBy("peak").toPandas() for n in (5, 1000)]
    assert len(got[0]) > 5 and got[0].peak.tolist() == got[1].peak.tolist() and (np.diff(got[0].peak) >= c.dead).all()
    kept = spikes.band_passed(x, c.keep, c)
    for peak, wave in zip(got[0].peak, got[0]["wave"]):
        assert np.allclose(wave, kept[peak - c.before + 1 : peak + c.behind + 1], atol=1e-6)


def test_groups_of_channels_share_events(spark):
    channels = {"a": made(1, 3000), "b": made(5, 3000), "c": made(6, 3000)}
    df = spark.createDataFrame(rows_of(channels), "run_id string, channel string, block_no long, samples array<double>")
    groups = spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("r", "c", 2)], "run_id string, channel string, polytrode int")
    got = spikes.polytrode_spikes(df, groups, C, 5, 7, 32).where("polytrode = 1").orderBy("peak").toPandas()
    segments = spikes.filtered_segments(df, C, 1000, 32)
    single = spikes.detect(segments, spikes.noise_levels(segments, C), C).where("channel <> 'c'").toPandas()
    events = np.unique(single.peak)
    events = events[np.append(np.diff(events) >= C.dead, True)]
    assert got.peak.tolist() == events.tolist()
    kept = [spikes.band_passed(channels[k], C.keep, C) for k in "ab"]
    for peak, waves in zip(got.peak, got.waves):
        for x, w in zip(kept, waves):
            if peak + C.behind + 5 < 3000:
                assert np.allclose(w, x[peak - C.before - 5 + 1 : peak + C.behind + 5 + 1], atol=1e-6)


def test_short_channels_have_no_spikes(spark):
    df = spark.createDataFrame([("r", "a", 0, [1.0, 2.0])], "run_id string, channel string, block_no long, samples array<double>")
    assert spikes.amplitude_spikes(df, C, 5, 32).collect() == []

import numpy as np
import pytest

from pulsegrid.operators import signals as sig
from pulsegrid.operators import spikes
from pulsegrid.sources import acquisition as acq
from pulsegrid.sources import writers

RATE = 1000.0


def blocks(spark, signals, per=128):
    rows = [("r", c, k, x[k * per : (k + 1) * per].tolist()) for c, x in signals.items() for k in range(len(x) // per)]
    return spark.createDataFrame(rows, "run_id string, channel string, block_no long, samples array<double>")


def events(spark, onsets):
    return spark.createDataFrame([("r", k, int(o)) for k, o in enumerate(onsets)], "run_id string, event_number long, onset_sample long")


def test_epochs_by_slicing(spark):
    x = np.random.default_rng(0).normal(size=128 * 12)
    onsets = [3, 60, 500, 1100, 1530]
    got = {r.event_number: r for r in sig.epochs(blocks(spark, {"A": x}), events(spark, onsets), -50, 100, 40).collect()}
    assert sorted(got) == [1, 2, 3]  # the first and the last leave the recording
    for k in got:
        lo = max(0, onsets[k] - 90)
        assert np.allclose(got[k].x, x[lo : onsets[k] + 140]) and got[k].zero == onsets[k] - lo
    holed = blocks(spark, {"A": x}).where("block_no <> 4")
    assert sorted(r.event_number for r in sig.epochs(holed, events(spark, onsets), -50, 100, 0).collect()) == [1, 3]


def test_sine_power_and_null_change(spark):
    t = np.arange(128 * 160) / RATE
    x = 100 * np.sin(2 * np.pi * 10 * t)
    onsets = np.arange(2000, 18000, 1500)
    got = sig.event_power(blocks(spark, {"A": x}), events(spark, onsets), RATE, {"alpha": (8, 13)}, {"base": (-500, -100), "post": (100, 500)}, (-5, 5), 500).toPandas()
    assert len(got) == 2 * len(onsets)
    assert got.power_uv2.mean() == pytest.approx(5000, rel=0.05)
    noise = np.random.default_rng(1).normal(0, 10, 128 * 400)
    got = sig.event_power(blocks(spark, {"A": noise}), events(spark, np.arange(2000, 48000, 1200)), RATE, {"b": (10, 40)}, {"base": (-500, -100), "post": (100, 500)}, (-5, 5), 500).toPandas()
    wide = got.pivot(index="event_number", columns="win", values="power_uv2")
    assert abs((10 * np.log10(wide.post / wide.base)).mean()) < 0.6


def test_recovery_is_analytic(spark):
    rng, x, onsets = np.random.default_rng(2), np.random.default_rng(2).normal(0, 1, 128 * 500), np.arange(2000, 60000, 3000)
    for o in onsets:
        x[o : o + 1000] += 5000 * np.exp(-np.arange(1000) / RATE * 1000 / 30)
    y = np.zeros(len(x)) + rng.normal(0, 1, len(x))
    z = x.copy()
    for o in onsets:
        z[o : o + 1000] += 5000
    got = sig.event_recovery(blocks(spark, {"A": x, "B": y, "C": z}), events(spark, onsets), RATE, (-500, -10), 900, 50, 5.0, 100.0).toPandas()
    a = got[got.channel == "A"]
    assert len(a) == len(onsets) and not a.censored.any()
    assert np.allclose(a.recovery_ms, 30 * np.log(50), atol=2.5)
    assert (got[got.channel == "B"].recovery_ms == 0).all() and got[got.channel == "C"].censored.all()


def test_spikes_are_found(spark):
    rate, rng = 20000.0, np.random.default_rng(3)
    x, at = rng.normal(0, 5, 128 * 800), np.arange(1000, 100000, 2500)
    shape = -120 * np.exp(-((np.arange(-20, 21) / 5.0) ** 2))
    for k in at:
        x[k - 20 : k + 21] += shape
    c = spikes.Detection(rate, dead=60, least=6.0, factor=1)
    got = spikes.amplitude_spikes(blocks(spark, {"A": x}), c).toPandas()
    near = [np.abs(got.peak - k).min() for k in at]
    assert max(near) <= 3 and len(got) == len(at) and len(got.wave[0]) == c.before + c.behind


def test_from_file_to_band_power(spark, tmp_path):
    n = 128 * 200
    t = np.arange(n) / 2000.0
    codes = np.round(100 * np.sin(2 * np.pi * 10 * t) / 0.195 + 32768).astype(np.uint16)[None, :]
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "a.rhs").write_bytes(writers.stim_file(codes, np.zeros_like(codes), ["A-1"], rate=2000.0))
    spark.dataSource.register(acq.RecordingSource)
    df = spark.read.format("recording").option("path", str(tmp_path)).load()
    got = sig.spectra(sig.channel_arrays(df), 2000.0, 2000, {"alpha": (8, 13)}).first()
    assert got.power_uv2 == pytest.approx(5000, rel=0.05)

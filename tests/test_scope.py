"""Captures: seeking by bytes, pulses, phases and clock offsets against what is planted."""

import os
import tempfile

import numpy as np
import pytest

from pulsegrid.operators import scope
from pulsegrid.sources import captures


class Made:
    """A file of equal lines that is never written: line k has time 1000 + k / 100."""

    def __init__(self, size):
        self.size, self.reads, self.bytes = size, 0, 0

    def __call__(self, at, n):
        n = min(n, max(0, self.size - at))
        self.reads, self.bytes = self.reads + 1, self.bytes + n
        first = at // 32
        text = b"".join(f"{1000 + k / 100:15.3f} 1.0 2.0 3.0".encode().ljust(31) + b"\n" for k in range(first, (at + n) // 32 + 1))
        return text[at - 32 * first :][:n]


def test_a_large_file_is_sought_by_some_probes():
    made = Made(256 << 20)
    wanted = 1000 + 5_000_000 / 100
    at = captures.seek(made, 0, made.size, wanted)
    assert at <= 32 * 5_000_000 < at + 2 * captures.NEAR and made.reads <= 40 and made.bytes < 1 << 17
    line = next(x for x in captures.lines(made, at, made.size) if captures.numbers(x)[0] >= wanted)
    assert captures.numbers(line)[0] == wanted


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 1 << 20])
def test_splits_give_each_line_once(spark, split):
    rng = np.random.default_rng(3)
    times = 500 + np.cumsum(rng.choice([0.001, 0.02], 60))
    folder = tempfile.mkdtemp()
    body = "time a b lead\n" + "".join(f"{t:.3f} 1 2 {k}\n" for k, t in enumerate(times)) + "broken line\n"
    with open(f"{folder}/500.txt", "w") as f:
        f.write(body.rstrip("\n"))
    open(f"{folder}/900.txt", "w").close()
    with open(f"{folder}/999.txt", "w") as f:
        f.write("1000.0 1 2 3\n")
    lo, hi = times[13] - 1e-4, times[40] + 1e-4
    got = sorted(r.lead for r in captures.scope_capture(spark, folder, float(lo), float(hi), split).collect())
    assert got == list(range(13, 41))
    assert captures.scope_capture(spark, folder, 0, 1e9, split).count() == 61
    assert os.path.exists(folder)


def square(t, edges, width, gap, lead):
    """The voltage of biphasic current squares: ramps up and down again."""
    v = np.zeros_like(t)
    for e in edges:
        up, down = (t >= e) & (t < e + width), (t >= e + width + gap) & (t < e + 2 * width + gap)
        v[up] += lead * (t[up] - e) / width
        v[(t >= e + width) & (t < e + width + gap)] += lead
        v[down] += lead * (1 - 2 * (t[down] - e - width - gap) / width)
        tail = t >= e + 2 * width + gap
        v[tail] -= lead * np.exp(-(t[tail] - e - 2 * width - gap) / 0.05)
    return v


@pytest.mark.parametrize("lead", [1, -1])
def test_planted_offset_and_lead_are_found(spark, lead):
    rng = np.random.default_rng(5)
    onset, start, period, width, gap, delta = 1_700_000_100.0, 1_700_000_000.0, 5.55, 0.3, 0.1, 1.7
    edges = onset + period * np.arange(6)
    steps = rng.choice([0.001, 0.004, 0.012], 12_000)
    t = onset - 4 + np.cumsum(steps)
    v = 20 * square(t, edges, width, gap, lead) + rng.normal(0, 0.1, len(t))
    samples = spark.createDataFrame([("r", float(a), float(b)) for a, b in zip(t, v)] + [("few", onset, 1.0)], "run_id string, epoch_s double, lead double")
    runs = spark.createDataFrame([("r", onset, 6, width, 4.5), ("few", onset, 6, width, 4.5)], "run_id string, onset_s double, n_expected int, width_s double, interval_s double")
    pulses = scope.scope_pulses(samples, runs).cache()
    got = pulses.orderBy("pulse").toPandas()
    assert len(got) == 6 and np.allclose(got.edge_s, edges, atol=0.06) and list(got.pulse) == list(range(6))
    told = {r.run_id: r for r in scope.scope_summary(pulses, runs).collect()}
    assert told["r"].n_pulses == 6 and told["r"].period_s == pytest.approx(period, abs=0.02) and told["r"].issues == ""
    assert told["few"].issues == "no_pulses"
    shape = scope.phase_summary(scope.pulse_phases(samples, runs, pulses)).first()
    assert shape.lead == lead and shape.phase1_s == pytest.approx(width, abs=0.12) and shape.phase2_s == pytest.approx(width, abs=0.06)
    assert shape.envelope_s == pytest.approx(2 * width + gap, abs=0.06)
    bin_s, n = 0.02, 7_500
    z = rng.normal(0, 0.5, n)
    for e in edges - start + delta:
        z[int(round(e / bin_s)) : int(round((e + 0.5) / bin_s))] += 4
    envelope = spark.createDataFrame([("r", k, float(x)) for k, x in enumerate(z)], "run_id string, bin long, z double")
    started = pulses.selectExpr("run_id", "pulse", f"edge_s - {start} AS start_s")
    found = scope.clock_offsets(envelope, started, bin_s).collect()
    assert len(found) == 1 and found[0].aligned and found[0].delta_s == pytest.approx(delta, abs=0.06)
    length = spark.createDataFrame([("r", 120.0)], "run_id string, duration_s double")
    inside = scope.aligned_onsets(started, scope.clock_offsets(envelope, started, bin_s), length).orderBy("pulse").toPandas()
    assert len(inside) == 4 and np.allclose(inside.onset_s, (edges - start + delta)[:4], atol=0.1)
    flat = envelope.selectExpr("run_id", "bin", "1D AS z")
    assert [r.aligned for r in scope.clock_offsets(flat, started, bin_s).collect()] == [False]
    pulses.unpersist()


def test_noise_has_no_pulses(spark):
    rng = np.random.default_rng(2)
    samples = spark.createDataFrame([("n", 100 + 0.01 * k, float(x)) for k, x in enumerate(rng.normal(size=3000))], "run_id string, epoch_s double, lead double")
    runs = spark.createDataFrame([("n", 105.0, 4, 0.3, 4.0)], "run_id string, onset_s double, n_expected int, width_s double, interval_s double")
    assert scope.scope_pulses(samples, runs).collect() == []


def test_pulses_on_one_ramp_are_numbered_by_their_ends(spark):
    def trace(k):
        v = 0.3 * np.sin(np.arange(900.0) + k) * 0.01
        v[200:560] = 4  # above the low floor throughout
        v[220:250] = v[400 + k % 50 : 500 + k % 50] = 10
        return v

    rows = [(k, 100 + 0.01 * j, float(x)) for k in range(40) for j, x in enumerate(trace(k))]
    samples = spark.createDataFrame(rows, "run_id int, epoch_s double, lead double").repartition(7)
    runs = spark.createDataFrame([(k, 101.0, 2, 0.3, 1.0) for k in range(40)], "run_id int, onset_s double, n_expected int, width_s double, interval_s double")
    found = scope.scope_pulses(samples, runs, scope.Capture())
    got = found.orderBy("run_id", "pulse").toPandas()
    assert len(got) == 80 and got.groupby("run_id").edge_s.nunique().eq(1).all()
    assert list(got.pulse) == [0, 1] * 40 and (got.width_s[1::2].values > got.width_s[::2].values).all()

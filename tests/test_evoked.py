"""Evoked responses, pulse trains, tails and resampling beside NumPy and planted truths."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import evoked, regression, resampling, signals, tails
from test_signals import blocks, events

RATE = 2000.0
P = evoked.Protocol(period=259.0)


def train(rng, amplitude=300.0, n=50, seconds=30, rate=RATE, seed_rhythm=60.0):
    """Noise, a slow rhythm, and pulses of 5 ms with a response of 20 ms behind each, every 259 ms from 10 s on."""
    t = np.arange(int(seconds * rate) // 128 * 128) / rate
    x = rng.normal(0, 20, len(t)) + seed_rhythm * np.sin(2 * np.pi * 4 * t)
    onsets = np.round((10 + 0.259 * np.arange(n)) * rate).astype(int)
    onsets = onsets[onsets + 200 < len(x)]
    for o in onsets:
        x[o : o + int(0.005 * rate)] += amplitude
        k = np.arange(int(0.04 * rate))
        x[o + len(k) // 4 : o + len(k) // 4 + len(k)] -= amplitude / 2 * np.exp(-(((k - len(k) / 2) / (len(k) / 8)) ** 2))
    return x, onsets


def test_pulse_responses_by_slicing(spark):
    x, onsets = train(np.random.default_rng(1))
    b, e = blocks(spark, {"A": x}), events(spark, [5, *onsets])  # the first leaves the recording
    got = evoked.pulse_responses(b, e, RATE, P).toPandas().set_index("event_number").sort_index()
    assert len(got) == len(onsets)
    for k, o in enumerate(onsets, 1):
        base = x[o - 40 : o]
        r = x[o : o + 100] - base.mean()
        row = got.loc[k]
        assert row.range_uv == pytest.approx(np.ptp(r)) and row.latency_ms == np.argmax(np.abs(r)) / 2
        assert row.during_uv == pytest.approx(np.ptp(r[:12])) and row.post_uv == pytest.approx(np.ptp(r[12:]))
        assert row.post_latency_ms == (12 + np.argmax(np.abs(r[12:]))) / 2 and row["tail"] == pytest.approx((r[10:] ** 2).sum() / (r**2).sum())
        assert row.baseline_sd == pytest.approx(base.std()) and row.gap_uv == pytest.approx(np.ptp(x[o + 300 : o + 500]))
    s = evoked.evoked_summary(evoked.pulse_responses(b, e, RATE, P)).first()
    assert s.n_pulses == len(onsets) and s.range_uv == pytest.approx(got.range_uv.median()) and s.snr == pytest.approx(got.range_uv.median() / got.gap_uv.median())
    w = evoked.mean_waveforms(b, e, RATE, P).first()
    want = np.mean([x[o - 40 : o + 100] - x[o - 40 : o].mean() for o in onsets], 0)
    assert w.n_pulses == len(onsets) and np.allclose(w.waveform, want)
    assert evoked.Protocol(period=5000.0, response=1000.0).gap() == (4890.0, 4990.0) and P.gap() == (150.0, 250.0)


def test_equal_magnitudes_are_the_first(spark):
    # baselines whose mean is rounded: magnitudes that are equal differ in their last bits
    rows = [(k, [b + d - (a + b) / 2 for d in (0.0, (a - b))]) for k, (a, b) in enumerate([(0.1, 0.7), (29.27, 2.11), (122.79, 0.03), (1.13, 8.41)])]
    rows += [(9, [1.0, -3.0, 2.0]), (10, [0.0, 0.0]), (11, [])]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    assert any(abs(x[0]) != abs(x[1]) for _, x in rows[:4])
    for x in (F.col("x"), F.reverse("x")):
        got = {r.k: r.i for r in df.select("k", evoked._first_largest(x).alias("i")).collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 1, 10: 0, 11: None}


def test_latencies_are_of_the_largest_doubles(spark):
    # two values lie equally far from the baseline but for its rounding, which takes the second one in either order
    p = evoked.Protocol(period=100.0, pre=4.0, response=5.0, pulse=2.0, guard=0.0)
    rows = [([37.29, 5.3, 82.35, 113.96], 27.61, 91.84), ([62.71, 35.87, 63.21, 22.01], 19.22, 72.68), ([17.18, 25.31, 41.44, 30.25], 19.49, 37.6)]
    for base, a, z in rows:
        near = round(sum(base) / 4, 2)
        for part in ([near, near, a, z, z], [near, near, z, a, z]):
            x = np.array([*base, *part])
            r = np.abs(x[4:] - (((x[0] + x[1]) + x[2]) + x[3]) / 4)
            df = spark.createDataFrame([("r", "A", 0, x.tolist())], "run_id string, channel string, block_no long, samples array<double>")
            responses = evoked.pulse_responses(df, events(spark, [4]), 1000.0, p, 16)
            got, summary = responses.first(), evoked.evoked_summary(responses).first()
            assert (summary.latency_ms, summary.post_latency_ms) == ((3, 3) if part[2] == a else (2, 2))
            assert (got.latency_ms, got.post_latency_ms) == (np.argmax(r), 2 + np.argmax(r[2:])) == ((3, 3) if part[2] == a else (2, 2))


def test_peaks_of_a_planted_response(spark):
    x, onsets = train(np.random.default_rng(2), amplitude=400.0)
    b, e = blocks(spark, {"A": x, "B": np.random.default_rng(3).normal(0, 20, len(x))}), events(spark, onsets)
    summary = evoked.evoked_summary(evoked.pulse_responses(b, e, RATE, P))
    found = evoked.peaks(evoked.mean_waveforms(b, e, RATE, P).join(summary.select("run_id", "channel", "baseline_sd"), ["run_id", "channel"]), RATE, P)
    a = found.where("channel = 'A' AND label = 'N1'").first()
    assert a.latency_ms == pytest.approx(30, abs=2) and a.amplitude_uv == pytest.approx(-200, abs=30) and not a.edge_suspect
    per = evoked.peak_summary(evoked.peak_trials(b, e, found, RATE, P), summary, P).toPandas().set_index(["channel", "label"])
    n1 = per.loc["A", "N1"]
    assert n1.n == len(onsets) and n1.present and n1.adaptation == pytest.approx(1, abs=0.5) and n1.amplitude_uv == pytest.approx(-215, abs=40)
    assert not per[per.index.get_level_values(0) == "B"].present.any()


def test_trains_are_recovered(spark):
    rng = np.random.default_rng(4)
    x, onsets = train(rng)
    y, _ = train(rng, amplitude=200.0)
    got = evoked.recover_trains(blocks(spark, {"A": x, "B": y}), RATE).first()
    assert got.ok and got.n_pulses == 50 and np.abs(np.array(got.onsets_s) - onsets / RATE).max() <= 0.005
    assert got.period_s == pytest.approx(0.259, abs=0.001) and got.comb_z > 5 and got.issues == ""
    none = evoked.recover_trains(blocks(spark, {"A": train(rng, amplitude=0.0, seed_rhythm=0.0)[0]}), RATE).first()
    assert not none.ok and "weak comb" in none.issues.split("|")
    short = evoked.recover_trains(blocks(spark, {"A": x[: 128 * 60]}), RATE).first()
    assert short.issues == "recording too short" and short.n_pulses == 0


def test_train_gap_and_lasting_changes(spark):
    rng = np.random.default_rng(5)
    n = int(60 * RATE) // 128 * 128
    t = np.arange(n) / RATE
    on = (t >= 20) & (t < 33)
    x = rng.normal(0, 20, n) + 30 * np.sin(2 * np.pi * 45 * t) * (1 + on) + 10.0 * (t > 34) + 40 * np.sin(2 * np.pi * np.where(t < 33, 3.0, 6.0) * t)
    onsets = np.round((20 + 0.259 * np.arange(50)) * RATE).astype(int)
    b, e = blocks(spark, {"A": x}), events(spark, onsets)
    bands = {"gamma": (30.0, 60.0), "high": (100.0, 300.0), "slow": (1.0, 8.0)}
    trains = spark.createDataFrame([("r", 40000, 66000, 1 / 0.259)], "run_id string, train_start long, train_stop long, rate_hz double")
    got = {r.band: r.db for r in evoked.train_band_change(b, trains, RATE, bands).collect()}
    assert got["gamma"] == pytest.approx(20 * np.log10(2), abs=1.5) and abs(got["high"]) < 1
    gap = {r.band: r.db for r in evoked.gap_band_change(b, e, RATE, P, bands).collect()}
    assert gap["gamma"] == pytest.approx(20 * np.log10(2), abs=2) and abs(gap["high"]) < 1 and "slow" not in gap
    post = evoked.post_train_change(b, trains, RATE).first()
    assert post.level_change == pytest.approx(10, abs=1) and post.rhythm_before_hz == 3 and post.rhythm_after_hz == 6 and abs(post.sd_db) < 1
    late = trains.selectExpr("run_id", "train_start + 60000 AS train_start", "train_stop + 60000 AS train_stop")
    assert evoked.post_train_change(b, late, RATE).count() == 0


def test_welch_in_segments_equals_the_kernel(spark):
    from pulsegrid.functions import dsp

    x = np.random.default_rng(6).normal(size=128 * 40)
    spans = spark.createDataFrame([("r", "s", 100, 4100)], "run_id string, name string, start long, stop long")
    got = evoked.densities(blocks(spark, {"A": x}), spans, RATE, 512, 0.0, 1000.0).toPandas().sort_values("hz")
    f, p = dsp.welch(x[100:4100], RATE, 512)
    assert np.allclose(got.hz, f) and np.allclose(got.density, p)


def test_centre_drift_and_clean_spans(spark):
    x = np.random.default_rng(7).normal(size=128 * 40)
    onsets = [3, 500, 1800]
    got = evoked.local_centre(blocks(spark, {"A": x}), events(spark, onsets), -90, -10).toPandas().set_index("event_number")
    for k in (1, 2):
        seg = x[onsets[k] - 90 : onsets[k] - 10]
        assert got.centre[k] == pytest.approx(seg.mean()) and got.drift[k] == pytest.approx(np.polyfit(np.arange(80), seg, 1)[0] * 79)
    runs = spark.createDataFrame([("r", 4000, 4500, 5120), ("s", 1500, 2000, 9000), ("t", 100, 200, 1500), ("u", 100, 4000, 5120)], "run_id string, first_onset long, last_onset long, n_samples long")
    spans = {r.run_id: (r.source, r.start, r.stop) for r in evoked.clean_spans(runs, 1000.0).collect()}
    assert spans == {"r": ("pre-train", 1000, 3500), "s": ("pre-train", 500, 1000)}
    sd = evoked.span_deviation(blocks(spark, {"A": x}), evoked.clean_spans(runs, 1000.0)).first()
    assert sd.n == 2500 and sd.sd == pytest.approx(x[1000:3500].std(ddof=1))


def test_tails_are_fitted_and_subtracted(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 3, 128 * 300)
    onsets = np.arange(2000, 30000, 4000)
    t = np.arange(1900) / RATE * 1000
    for o in onsets:
        x[o + 1 : o + 1900] += -20000 * np.exp(-t[1:1900] / 5) + 3000 * np.exp(-t[1:1900] / 150)
    x = np.clip(x, -6389, 6389)
    from pyspark.sql import functions as F

    from pulsegrid.operators import gating

    df = blocks(spark, {"A": x})
    samples = df.select("run_id", "channel", "block_no", F.posexplode("samples").alias("k", "v"))
    rails = gating.rails(samples, ["run_id", "channel"], ["block_no", "k"], "v", 2.0, 5, 6389.0)
    fits = tails.tail_fits(df, events(spark, onsets), RATE, rails, start_ms=40.0)
    got = fits.toPandas()
    assert got.railed.all() and got.fit_ok.all() and (got.tail_sign == -1).all()
    assert np.allclose(got.tau_ms, 150, rtol=0.05) and (got.after_ms < 60).all() and (got.before_ms > 300).all()
    s = tails.tail_summary(fits, ["channel"], 136.5).first()
    assert s.n_fits == len(onsets) and s.same_sign == 0 and s.tau_ratio == pytest.approx(150 / 136.5, rel=0.05) and s.left < 0.25


def test_tails_of_slow_recordings_are_fitted(spark):
    # 39 samples a pulse: a tenth of them would be too few for a fit
    x = np.random.default_rng(12).normal(0, 0.5, 800)
    onsets = np.arange(40, 720, 80)
    for k, o in enumerate(onsets):
        x[o + 1 : o + 60] += (-1) ** k * 900 * np.exp(-np.arange(59) * 10 / 80)
    df = blocks(spark, {"A": x})
    rails = spark.createDataFrame([("r", "A", None, None)], "run_id string, channel string, pos_level double, neg_level double")
    got = tails.tail_fits(df, events(spark, onsets), 100.0, rails, (-100.0, 0.0), 400.0, 10.0, 30.0, 3.0, 20.0).toPandas()
    assert len(got) == len(onsets) and got.fit_ok.all() and not got.railed.any() and (got.tail_sign == 1).all()
    assert np.allclose(got.tau_ms, 80, rtol=0.05) and (got.after_ms < 30).all() and (got.before_ms > 250).all()


def test_highpass_is_inverted_across_blocks(spark):
    from pulsegrid.functions import dsp

    x = np.cumsum(np.random.default_rng(9).normal(0, 5, 128 * 12))
    y = dsp.one_pole_highpass(x, 6, start=0.0)
    got = tails.without_highpass(blocks(spark, {"A": y, "B": -y}), 6).toPandas().sort_values("block_no")
    assert np.allclose(np.concatenate(got[got.channel == "A"].samples.tolist()), x, atol=1e-6)


def test_medians_are_resampled_by_rank(spark):
    rng = np.random.default_rng(10)
    rows = [("odd", float(v)) for v in rng.normal(size=101)] + [("even", float(v)) for v in rng.exponential(size=40)] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in resampling.median_intervals(df, ["g"], "v", 4000).collect()}
    assert sorted(map(tuple, resampling.median_intervals(df.repartition(7), ["g"], "v", 4000).collect())) == sorted(map(tuple, got.values()))
    assert set(got) == {"odd", "even", "one"} and (got["one"].lo, got["one"].hi) == (2.0, 2.0)
    for g in ("odd", "even"):
        x = np.array([v for k, v in rows if k == g])
        want = np.quantile(np.median(x[rng.integers(len(x), size=(8000, len(x)))], 1), [0.025, 0.975])
        assert (got[g].lo, got[g].hi) == pytest.approx(tuple(want), abs=0.06) and got[g].median == pytest.approx(np.median(x))


def test_medians_of_small_groups_are_resampled_at_once(spark):
    """Pairs of middle places as often as in all resamples; groups of any size, those of a null key too, have rows."""
    for m in (1, 2, 3, 4, 5):
        seen = collections.Counter(tuple(sorted(x)[k] for k in ((m - 1) // 2, m // 2)) for x in itertools.product(range(m), repeat=m))
        first, second, upto = resampling._middles(m)
        assert {(a, b): n / m**m for (a, b), n in seen.items()} == pytest.approx(
            {(a, b): p for a, b, p in zip(first.tolist(), second.tolist(), np.diff(upto, prepend=0)) if p}
        )
    rng = np.random.default_rng(12)
    sizes = {None: 7, "": 1, "a": 64, "b": 65, "c": 6}
    rows = [(g, h, float(v)) for g, m in sizes.items() for h in (None, 1) for v in rng.normal(size=m)]
    rows += [(None, 2, float(v)) for v in rng.normal(size=70)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    got = {(r.g, r.h): r for r in resampling.median_intervals(df, ["g", "h"], "v", 3000).collect()}
    assert set(got) == {(g, h) for g, h, _ in rows}
    for key, r in got.items():
        x = np.array([v for g, h, v in rows if (g, h) == key])
        want = np.quantile(np.median(x[rng.integers(len(x), size=(8000, len(x)))], 1), [0.025, 0.975])
        assert r.n == len(x) and r.median == pytest.approx(np.median(x)) and (r.lo, r.hi) == pytest.approx(tuple(want), abs=0.25)


def test_means_are_resampled_in_parts(spark):
    rng = np.random.default_rng(11)
    rows = [(k, "a" if k % 2 else "b", float(np.exp(rng.normal())), float(np.exp(rng.normal(0.3)))) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, base double, post double")
    got = {r.g: r for r in resampling.paired_db_intervals(df, ["g"], "base", "post", ["id"], 800).collect()}
    again = {r.g: r for r in resampling.paired_db_intervals(df.repartition(5), ["g"], "base", "post", ["id"], 800).collect()}
    for g in "ab":
        db = np.array([10 * np.log10(p / b) for _, k, b, p in rows if k == g])
        want = np.quantile(db[rng.integers(len(db), size=(4000, len(db)))].mean(1), [0.025, 0.975])
        assert (got[g].lo, got[g].hi) == pytest.approx(tuple(want), abs=0.2) and got[g].mean_db == pytest.approx(db.mean())
        assert got[g].lo == pytest.approx(again[g].lo) and got[g].n_pairs == 300
    side = resampling.independent_db_intervals(df.selectExpr("id", "0 AS k", "g", "base"), ["k"], "base", F.col("g") == "a", ["id"], 400).first()
    assert side.lo < side.db < side.hi


def test_fake_onsets_keep_their_distance(spark):
    df = spark.createDataFrame([("a", 0, 1000), ("a", 5000, 9000), ("b", 10, 30)], "c string, start long, end long")
    got = resampling.fake_onsets(df, ["c"], 30, 50).toPandas()
    a = np.sort(got[got.c == "a"].onset.to_numpy())
    assert len(a) == 30 and np.diff(a).min() >= 50 and (((a < 1000) & (a >= 0)) | ((a >= 5000) & (a < 9000))).all()
    assert (got.c == "b").sum() == 1


def test_robust_regression_by_hand(spark):
    rng = np.random.default_rng(12)
    x, z = rng.normal(size=300), rng.normal(size=300)
    y = 1 + 2 * x - 0.5 * z + rng.normal(size=300) * (1 + np.abs(x))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, z, y)] + [(None, 1.0, 1.0)], "x double, z double, y double")
    got = {r.term: r for r in regression.covariate_regression(df, [], "y", ["x", "z"]).collect()}
    m = np.column_stack([np.ones(300), x, z])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    inv = np.linalg.inv(m.T @ m)
    se = np.sqrt(np.diag(inv @ (m.T * (y - m @ beta) ** 2) @ m @ inv) * 300 / 297)
    for k, term in enumerate(("intercept", "x", "z")):
        assert got[term].estimate == pytest.approx(beta[k]) and got[term].se == pytest.approx(se[k]) and got[term].n == 300


def test_dose_response_prefers_what_is_planted(spark):
    rng = np.random.default_rng(13)
    rows = [(c, float(i), float((300 / (1 + np.exp(-(i - 80) / 20)) if c == "s" else 2 * i) + rng.normal(0, 10))) for c in "sl" for i in (10, 25, 50, 75, 100, 150, 200, 250) for _ in range(40)]
    df = spark.createDataFrame([*rows, ("few", 1.0, 1.0)], "c string, i double, y double")
    got = {r.c: r for r in regression.amplitude_response(df, ["c"], "i", "y").collect()}
    assert got["s"].preferred == "sigmoid" and got["s"].sigmoid_i50 == pytest.approx(80, abs=8) and not got["s"].artifact
    assert got["l"].artifact and got["l"].origin_m == pytest.approx(2, rel=0.02) and got["few"].preferred == "insufficient"


def test_gentle_highpass_across_blocks(spark):
    rng = np.random.default_rng(3)
    x = 500 + np.cumsum(rng.normal(0, 5, 128 * 7 + 40))
    got = tails.gentle_highpass(blocks(spark, {"A": x, "B": -x}), 3.0, RATE).toPandas().sort_values("block_no")
    k = np.tan(np.pi * 3.0 / RATE)
    y, before, last = [], x[0], 0.0
    for v in x:
        last = (1 - k) / (1 + k) * last + (v - before) / (1 + k)
        before = v
        y.append(last)
    for name, sign in (("A", 1), ("B", -1)):
        own = np.concatenate(got[got.channel == name].samples.tolist())
        assert np.allclose(own, sign * np.array(y)[: len(own)], atol=1e-8) and len(own) >= 128 * 7


def test_recovery_without_the_recorders_highpass(spark):
    """A step that the recorder's high-pass turned into a long tail is short again."""
    from pulsegrid.functions import dsp

    rng = np.random.default_rng(4)
    x = rng.normal(0, 2, 128 * 120)
    onsets = np.arange(3000, 12000, 2500)
    for o in onsets:
        x[o : o + 60] += 3000
    y = dsp.one_pole_highpass(x, 7, start=0.0)
    args = (events(spark, onsets), RATE)
    before = signals.event_recovery(blocks(spark, {"A": y}), *args, (-200.0, -20.0), 1500.0, 20.0, 4.0, 100.0).toPandas()
    after = tails.inverse_recovery(blocks(spark, {"A": y}), *args, 7, None, (-200.0, -20.0), 1500.0, 20.0, 4.0, 100.0).toPandas()
    assert len(after) == len(onsets) and (after.recovery_ms < 90).all() and (before.recovery_ms > 150).all()

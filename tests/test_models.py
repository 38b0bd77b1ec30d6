"""Normality tests, models across channels and bootstrap intervals beside plain NumPy."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import stats
from pulsegrid.operators import models, regression, resampling, waveforms


def test_shapiro_of_published_weights():
    """Eleven weights of men from Shapiro and Wilk (1965)."""
    w, p = stats.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.7888, abs=2e-4) and p == pytest.approx(0.0067, abs=3e-4)
    assert stats.shapiro_wilk([1.0, 2.0, 3.0]) == (pytest.approx(1.0), pytest.approx(1.0))
    assert all(map(math.isnan, stats.shapiro_wilk([2.0, 2.0, 2.0, 2.0]) + stats.shapiro_wilk([1.0])))
    for n in (4, 5, 6, 11, 12, 500):
        a = stats.shapiro_weights(n)
        assert a @ a == pytest.approx(1) and np.allclose(a, -a[::-1])


@pytest.mark.parametrize("n", [3, 5, 8, 30, 400])
def test_shapiro_rejects_normal_samples_at_its_level(n):
    rng = np.random.default_rng(n)
    p = np.array([stats.shapiro_wilk(rng.normal(size=n))[1] for _ in range(1500)])
    assert abs((p < 0.1).mean() - 0.1) < 0.03
    if n >= 30:
        assert np.mean([stats.shapiro_wilk(rng.lognormal(size=n))[1] < 0.05 for _ in range(100)]) > 0.9


def test_scale_follows_the_test(spark):
    rng = np.random.default_rng(2)
    rows = [("log", float(v)) for v in rng.lognormal(1, 1, 300)] + [("raw", float(v)) for v in rng.normal(50, 1, 300)]
    rows += [("neg", float(v)) for v in rng.normal(0, 1, 50)] + [("few", 1.0), ("few", 2.0), ("same", 3.0), ("same", 3.0), ("same", 3.0), ("few", None), ("few", float("nan"))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i long, g string, v double")
    got = {r.g: r for r in models.normality_checks(df, ["g"], "v", ["i"]).collect()}
    assert [got[g].scale for g in ("log", "neg", "few")] == ["log", "raw_only", "insufficient"] and got["same"].p is None
    raw = np.array([v for g, v in rows if g == "log"])
    assert got["log"].p == pytest.approx(stats.shapiro_wilk(raw)[1]) and got["log"].p_log == pytest.approx(stats.shapiro_wilk(np.log10(raw))[1])
    assert got["log"].skew == pytest.approx(((raw - raw.mean()) ** 3).mean() / raw.std() ** 3)
    small = models.normality_checks(df, ["g"], "v", ["i"], sample=40).where("g = 'log'").first()
    assert small.n == 300 and small.p != got["log"].p
    points = models.quantile_points(df, ["g"], "v").where("g = 'raw'").orderBy("place").toPandas()
    assert (np.diff(points["ordered"]) >= 0).all() and np.allclose(points["theoretical"], -points["theoretical"][::-1])
    assert stats.normal_cdf(points["theoretical"].to_numpy()[-1]) == pytest.approx(0.5 ** (1 / 300))


def planted(groups, each, spread, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        u = rng.normal(0, spread)
        for _ in range(each + g % 3):
            x = rng.normal(g * 0.1)
            rows.append((f"c{g:02d}", float(x), float(2 + 3 * x + u + rng.normal())))
    return rows


def dense_restricted_likelihood(rows, ratio):
    """The same likelihood from the whole covariance matrix."""
    g = np.array([r[0] for r in rows])
    x = np.column_stack([np.ones(len(rows)), [r[1] for r in rows]])
    y = np.array([r[2] for r in rows])
    v = np.eye(len(rows)) + ratio * (g[:, None] == g[None, :])
    inv = np.linalg.inv(v)
    a = x.T @ inv @ x
    beta = np.linalg.solve(a, x.T @ inv @ y)
    rest = (y - x @ beta) @ inv @ (y - x @ beta)
    m = len(rows) - 2
    return m * np.log(rest / m) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], beta, rest / m


def test_random_intercept_beside_dense_matrices(spark):
    rows = planted(12, 8, 2.0)
    df = spark.createDataFrame([("all", *r) for r in rows] + [("one", "a", 1.0, 2.0), ("one", "a", 2.0, 2.5), ("all", "c00", None, 1.0)], "k string, g string, x double, y double")
    got = {r.term: r for r in models.random_intercept(df, ["k"], "y", ["x"], "g").collect()}
    best = min((dense_restricted_likelihood(rows, r)[0], r) for r in np.exp(np.linspace(-6, 6, 4001)))
    _, beta, residual = dense_restricted_likelihood(rows, best[1])
    assert got["intercept"].estimate == pytest.approx(beta[0], rel=1e-3) and got["x"].estimate == pytest.approx(beta[1], rel=1e-4)
    assert got["x"].group_variance == pytest.approx(best[1] * residual, rel=1e-2) and got["x"].n_obs == len(rows) and got["x"].n_groups == 12
    assert got["x"].lo < 3 < got["x"].hi and got["x"].p < 1e-6 and got["x"].method == "random_intercept" and len(got) == 2


def test_no_variance_between_groups(spark):
    df = spark.createDataFrame(planted(6, 10, 0.0, 8), "g string, x double, y double")
    got = {r.term: r for r in models.random_intercept(df.withColumn("k", F.lit(1)), ["k"], "y", ["x"], "g").collect()}
    assert 0 <= got["x"].group_variance < 0.3 and got["x"].estimate == pytest.approx(3, abs=0.3)


def test_fixed_groups_beside_dummies(spark):
    rows = planted(5, 12, 3.0, 5)
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "k int, i long, g string, x double, y double")
    got = {r.term: r for r in models.fixed_groups(df, ["k"], "y", ["x"], "g", ["i"], 300).collect()}
    names = sorted({r[0] for r in rows})
    m = np.column_stack([np.ones(len(rows)), [r[1] for r in rows], *[[r[0] == g for r in rows] for g in names[1:]]]).astype(float)
    beta = np.linalg.lstsq(m, np.array([r[2] for r in rows]), rcond=None)[0]
    assert got["intercept"].estimate == pytest.approx(beta[0]) and got["x"].estimate == pytest.approx(beta[1])
    rest = np.array([r[2] for r in rows]) - m @ beta
    se = math.sqrt(rest @ rest / (len(rows) - 6) * np.linalg.inv(m.T @ m)[1, 1])
    assert got["x"].hi - got["x"].lo == pytest.approx(2 * 1.96 * se, rel=0.35)


def covered(lo, hi, truth):
    return np.mean([a <= truth <= b for a, b in zip(lo, hi)])


def test_intervals_cover_what_is_planted(spark):
    """300 groups each: 95 % intervals hold the truth about as often; rho of a normal pair of correlation r is known."""
    rng = np.random.default_rng(11)
    rows, r = [], 0.6
    for g in range(300):
        for k in range(60):
            x, e = rng.normal(size=2)
            rows.append((g, k, k % 4, float(x), float(0.5 * x + e + (k % 4)), float(r * x + math.sqrt(1 - r * r) * e), bool(rng.random() < 0.3)))
    df = spark.createDataFrame(rows, "g int, i long, run int, x double, y double, z double, hit boolean").cache()
    keys, ids = ["g"], ["g", "i"]
    share = resampling.fraction_intervals(df, keys, F.col("hit"), ids, 300).toPandas()
    assert 0.9 <= covered(share.lo, share.hi, 0.3) <= 0.99
    apart = resampling.difference_intervals(df, keys, "y", F.col("run") < 2, ids, 300).toPandas()
    assert 0.9 <= covered(apart.lo, apart.hi, 2.0) <= 0.99
    ranks = resampling.spearman_intervals(df, keys, "x", "z", ids, 300).toPandas()
    assert 0.89 <= covered(ranks.lo, ranks.hi, 6 / math.pi * math.asin(r / 2)) <= 0.99
    slope = resampling.slope_intervals(df.withColumn("y", F.col("y") - F.col("run")), keys, "x", "y", ["run"], ids, 300).toPandas()
    assert 0.89 <= covered(slope.lo, slope.hi, 0.5) <= 0.99
    one = [t for t in rows if t[0] == 7]
    line = np.polyfit([t[3] for t in one], [t[4] - t[2] for t in one], 1)
    own = slope[slope.g == 7].iloc[0]
    assert own.slope == pytest.approx(line[0]) and own.intercept == pytest.approx(line[1]) and own.n == 60
    middle = resampling.median_intervals(df, keys, "x", 400).toPandas()
    assert 0.88 <= covered(middle.lo, middle.hi, 0.0) <= 0.99
    df.unpersist()


def test_rank_intervals_of_ties_beside_ranking_each_resample(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 400).astype(float)
    y = np.round(x + rng.normal(0, 2, 400))
    df = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "g int, i long, x double, y double")
    got = resampling.spearman_intervals(df, ["g"], "x", "y", ["i"], 800).first()

    def ranks(v):
        _, where, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[where]

    def rho(k):
        return np.corrcoef(ranks(x[k]), ranks(y[k]))[0, 1]

    draws = [rho(rng.integers(0, 400, 400)) for _ in range(800)]
    assert got.rho == pytest.approx(rho(np.arange(400))) and got.n == 400
    assert got.hi - got.lo == pytest.approx(np.subtract(*np.percentile(draws, [97.5, 2.5])), rel=0.15)


def test_resamples_keep_strata(spark):
    df = spark.createDataFrame([(1, k, k % 3 if k < 20 else 9, float(k)) for k in range(21)], "g int, i long, s int, v double")
    got = resampling.stratified_draws(df, ["g"], ["s"], {"v": F.col("v"), "one": F.lit(1.0)}, ["i"], 200).collect()
    assert len(got) == 200 and all(r.w == 21 and r.one == pytest.approx(21) for r in got)
    assert np.mean([r.v for r in got]) == pytest.approx(210, rel=0.03)


def test_half_way_currents(spark):
    rng = np.random.default_rng(13)
    rows = [(c, float(i), float((300 / (1 + np.exp(-(i - 80) / 20)) if c == "s" else 2 * i) + rng.normal(0, 20))) for c in "sl" for i in (10, 25, 50, 75, 100, 150, 200, 250) for _ in range(30)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate([*rows, ("few", 1.0, 1.0)])], "k long, c string, i double, y double")
    got = {r.c: r for r in regression.i50_intervals(df, ["c"], "i", "y", ["k"], 200).collect()}
    assert set(got) == {"s", "l"} and got["s"].lo < 80 < got["s"].hi and got["s"].hi - got["s"].lo < 20 and got["s"].converged == 1
    assert got["s"].i50 == pytest.approx(80, abs=8)


def test_fake_onsets_follow_their_draws(spark):
    pieces = [("a", 0, 40), ("a", 100, 400), ("b", 5, 6), ("c", 9, 9), ("d", 0, 10**6)]
    df = spark.createDataFrame(pieces, "c string, start long, end long")
    got = {}
    for r in resampling.fake_onsets(df, ["c"], 25, 10).collect():
        got.setdefault(r.c, []).append(r.onset)
    assert len(got["a"]) >= 15 and got["b"] == [5] and "c" not in got and len(got["d"]) == 25
    for c, own in got.items():
        own.sort()
        assert all(b - a >= 10 for a, b in zip(own, own[1:]))
        assert all(any(x == c and s <= o < e for x, s, e in pieces) for o in own)
    # greedy by time would fill the front: half the places of a wide interval lie in either half
    many = spark.createDataFrame([(f"r{k}", 0, 1000) for k in range(200)], "c string, start long, end long")
    onsets = np.array([r.onset for r in resampling.fake_onsets(many, ["c"], 3, 200).collect()])
    assert len(onsets) == 600 and abs(onsets.mean() - 500) < 25


def test_pseudo_onsets(spark):
    df = spark.createDataFrame([("a", 100), ("b", 12), ("c", 30)], "c string, n_samples long")
    got = sorted((r.c, r.event_number, r.onset) for r in resampling.pseudo_onsets(df, ["c"], 5, 8, 20).collect())
    assert got == [("a", 0, 5), ("a", 1, 25), ("a", 2, 45), ("a", 3, 65), ("a", 4, 85), ("c", 0, 5)]
    assert [r.onset for r in resampling.pseudo_onsets(df, ["c"], 5, 7, 20).where("c = 'b'").collect()] == []
    moved = resampling.pseudo_onsets(df, ["c"], 5, 8, 20, jitter=6, most=3).where("c = 'a'").orderBy("event_number").collect()
    assert len(moved) == 3 and all(0 <= r.onset - (5 + 20 * r.event_number) <= 6 for r in moved)


def test_draws_are_one_row_a_group(spark):
    rows = [(i, None if i % 7 == 6 else i % 7, float(i % 11)) for i in range(700)]
    df = spark.createDataFrame(rows, "i long, g long, v double").repartition(9)
    sums = resampling.draw_sums(df, ["g"], {"s": F.col("v")}, ["i"], 40)
    got = {r.g: r for r in sums.collect()}
    assert sums.count() == len(got) == 7  # whatever the number of partitions that a group's rows lie in
    hashes = dict(df.select("i", F.xxhash64(F.lit(0), "i").alias("h")).collect())
    for g in (None, 0, 5):
        own = [r for r in rows if r[1] == g]
        weights = resampling._poisson(np.array([hashes[r[0]] for r in own]), np.arange(40))
        assert np.allclose(got[g].w, weights.sum(0)) and np.allclose(got[g].s, np.array([r[2] for r in own]) @ weights)
    whole = resampling.draw_sums(df, [], {"s": F.col("v")}, ["i"], 40).collect()
    assert len(whole) == 1 and np.allclose(whole[0].w, sum(np.array(r.w) for r in got.values()))


def test_fixed_groups_take_many_groups(spark):
    df = spark.range(12000).select(F.lit("k").alias("k"), "id", (F.col("id") % 4000).alias("g"), F.rand(3).alias("x"))
    df = df.withColumn("y", 2 * F.col("x") + F.col("g") + F.lit(0.0))
    began = time.time()
    got = {r.term: r for r in models.fixed_groups(df, ["k"], "y", ["x"], "g", ["id"], 30).collect()}
    assert time.time() - began < 60  # was squared in groups times draws
    assert abs(got["x"].estimate - 2) < 1e-6 and got["x"].n_groups == 4000 and got["x"].lo <= 2 + 1e-6 and got["x"].hi >= 2 - 1e-6


def test_fake_onsets_never_broadcast_their_draws(spark):
    df = spark.range(2).select(F.col("id").alias("c"), F.lit(0).cast("long").alias("start"), (F.col("id") * 500 + 500).alias("end"))  # known to be small
    plan = resampling.fake_onsets(df, ["c"], 30, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_channel_pairs_by_cells(spark):
    rng = np.random.default_rng(4)
    rows = [(int(c), int(t)) for c, t in zip(rng.integers(0, 12, 600), rng.integers(0, 4000, 600))] + [(20, int(t)) for t in rng.integers(0, 4000, 200)]
    df = spark.createDataFrame(rows, "c long, t long")
    want = Counter((i, j, (b - a) // 10) for i, a in rows for j, b in rows if i < j and abs(b - a) <= 60)
    for chunk in (100, 5000):  # with and without a channel that fills more than a chunk
        got = waveforms.channel_pairs(df, "c", "t", 60, 10, chunk).collect()
        assert {(r.i, r.j, r.bin): r.n for r in got} == want and len(got) == len(want)


def test_moments_tell_the_scale(spark):
    groups = {"few": [1.0, 2.0], "other": [-1.0, 2.0, 3.0], "log": [1.0, 10.0, 100.0, 1000.0], "raw": [1.0, 2.0, 3.0, 4.0]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double")
    got = {r.g: r.scale for r in regression.moments(df, ["g"], "v").collect()}
    assert got == {"few": "insufficient", "other": "raw (non-positive values present)", "log": "log", "raw": "raw"}


def test_blocks_of_channels_are_shuffled_packed(spark):
    x = np.array([0, 5, -7, 1 << 62, -(1 << 62), 3])
    assert np.array_equal(waveforms.unpack(waveforms.pack(x), len(x)), x) and len(waveforms.pack(np.arange(20000) % 100)) < 20000
    rng = np.random.default_rng(5)
    rows = [(int(c) * 1_000_003 - 9_000_000, int(t)) for c, t in zip(rng.integers(0, 60, 1200), rng.integers(-30000, 30000, 1200))]
    df = spark.createDataFrame(rows, "c long, t long")
    want = Counter((i, j, (b - a) // 70) for i, a in rows for j, b in rows if i < j and abs(b - a) <= 400)
    got = waveforms.channel_pairs(df, "c", "t", 400, 70, 40)  # 30 pieces, in 24 blocks
    found = got.collect()
    assert {(r.i, r.j, r.bin): r.n for r in found} == want and len(found) == len(want)
    # blocks are put together before they are copied
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("explode") < plan.rindex("FlatMapGroupsInArrow")

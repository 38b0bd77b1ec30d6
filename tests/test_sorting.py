"""Waveform classes: components, forced membership, features and chosen clusters beside plain NumPy."""

import collections
import math

import numpy as np
import pytest

from pulsegrid.operators import sorting, waveforms


def shaped(seed=2, n=400, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, dims)) * 4
    mixes = rng.normal(size=(3, dims, dims)) + 2 * np.eye(dims)
    cls = rng.integers(0, 3, n)
    x = centres[cls] + np.einsum("nij,nj->ni", mixes[cls], rng.normal(size=(n, dims))) * 0.3
    return x, cls + 1


def frame(spark, x, cls):
    return spark.createDataFrame([(k, int(c), v.tolist()) for k, (c, v) in enumerate(zip(cls, x))], "id long, class long, w array<double>").repartition(5)


def test_principal_components(spark):
    x, cls = shaped()
    got = sorting.principal_components(frame(spark, x, cls), "w", "id", 3).orderBy("id").toPandas()
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    v = v[:3] * np.sign(v[:3][np.arange(3), np.abs(v[:3]).argmax(1)])[:, None]
    assert np.allclose(np.stack(got["scores"]), (x - x.mean(0)) @ v.T)
    empty = frame(spark, x[:1], cls[:1])
    assert sorting.principal_components(empty, "w", "id").collect() == []


@pytest.mark.parametrize("how", ["likelihood", "mahalanobis"])
def test_forced_by_shape(spark, how):
    x, cls = shaped()
    y, truth = shaped(3, 150)
    y = np.concatenate([y, [np.full(6, 90.0)]])
    labelled = np.concatenate([x, x[:2]]), np.append(cls, [9, 0])  # a class of one member has no shape, class 0 is none
    got = {r.id: r for r in sorting.force_by_shape(frame(spark, y, np.zeros(len(y), int)), frame(spark, *labelled), "class", "w", "id", how, 2.0).collect()}
    for k, v in enumerate(y):
        best = []
        for c in (1, 2, 3):
            own = x[cls == c]
            inv, d = np.linalg.inv(np.cov(own.T)), v - own.mean(0)
            square = d @ inv @ d
            inside = math.sqrt(np.mean([(o - own.mean(0)) @ inv @ (o - own.mean(0)) for o in own]))
            if how == "likelihood":
                best.append((square / 2 - 0.5 * np.linalg.slogdet(inv)[1], c, c))
            else:
                best.append((math.sqrt(square), c, c if math.sqrt(square) < 2.0 * inside else 0))
        d, _, c = min(best)
        assert got[k]["class"] == c and got[k].distance == pytest.approx(d)
    assert how == "likelihood" or got[150]["class"] == 0
    with pytest.raises(ValueError):
        sorting.force_by_shape(frame(spark, y, np.zeros(len(y), int)), frame(spark, x, cls), "class", "w", "id", "other")


@pytest.mark.parametrize("chunk", [50, 10_000])
def test_forced_by_neighbours(spark, chunk):
    x, cls = shaped(5, 300)
    y, _ = shaped(6, 60)
    y = np.concatenate([y, [np.full(6, 90.0)]])
    got = {r.id: r for r in sorting.force_by_neighbours(frame(spark, y, np.zeros(len(y), int)), frame(spark, x, cls), "class", "w", "id", 7, 5, 0.4, chunk).collect()}
    reach = 0.4 * math.sqrt(x.var(0).sum())
    for k, v in enumerate(y):
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = np.lexsort((cls, d))[:7]
        votes = collections.Counter(cls[order[d[order] < reach]].tolist())
        n, c = max(((n, -c) for c, n in votes.items()), default=(0, 0))
        assert (got[k].votes, got[k]["class"]) == (n, -c if n >= 5 else 0)


def test_neighbours_are_sought_in_near_boxes_only(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(900, 4)), rng.normal(5, 0.1, (400, 4)), np.repeat(rng.normal(size=(3, 4)), 60, 0)])  # loose, tight, repeated
    cls = rng.integers(1, 5, len(x))
    df = frame(spark, x, cls)
    cells = sorting.cells_of(df.select("w"), sorting.gram_sums(df, None, "w")[0], 40)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert len(cells.lows) > 30
    away = cells.away(cells.turned(x))
    at = cells.first[cells.of(cells.turned(x))]
    assert (away[:, at] <= d + 1e-9).all() and (away[np.arange(len(x)), at] < 1e-12).all()
    near = np.sort(d, 1)[:, 4]
    assert (away <= near[:, None] + 1e-9).mean() < 0.35  # most boxes are never met
    y = np.concatenate([x[::3], rng.normal(3, 2, (40, 4)), [[np.nan, 0, 0, 0], [np.inf, 0, 0, 0]]])
    got = {r.id: r for r in sorting.force_by_neighbours(frame(spark, y, np.zeros(len(y), int)), df, "class", "w", "id", 5, 3, 0.5, 40).collect()}
    reach = 0.5 * math.sqrt(x.var(0).sum())
    assert len(got) == len(y)
    for k, v in enumerate(y):
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = np.lexsort((cls, d))[:5]
        votes = collections.Counter(cls[order[d[order] < reach]].tolist())
        n, c = max(((n, -c) for c, n in votes.items()), default=(0, 0))
        assert (got[k].votes, got[k]["class"]) == (n, -c if n >= 3 else 0)
    same = sorting.force_by_neighbours(df, frame(spark, np.ones((9, 4)), np.ones(9, int)), "class", "w", "id", 5, 3, 1.0)
    assert {(r.votes, r["class"]) for r in same.collect()} == {(0, 0)}


def test_scores_are_gaps_to_the_normal_distribution(spark):
    rng = np.random.default_rng(4)
    features = {0: rng.normal(size=500), 1: rng.exponential(size=500), 2: np.round(rng.normal(size=500)), 3: rng.normal(size=8)}
    df = spark.createDataFrame([(p, float(v)) for p, own in features.items() for v in own], "place int, y double")
    for ranges in (1, 7, 64):
        got = {r.place: r for r in waveforms.spread_score(df, "place", "y", 3.0, ranges=ranges).collect()}
        for p, own in features.items():
            v = np.sort(own[np.abs(own - own.mean()) < 3 * own.std(ddof=1)])
            z = (v - v.mean()) / v.std(ddof=1)
            normal = np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in z])
            up, low = np.searchsorted(v, v, "right") / len(v), np.searchsorted(v, v, "left") / len(v)
            want = max(np.abs(up - normal).max(), np.abs(low - normal).max()) if len(v) > 10 else 0
            assert got[p].score == pytest.approx(want, abs=1e-12) and got[p].n == len(v)


def knee_by_hand(scores, most, least, nd=10):
    a = np.sort(scores)[-most:]
    d = (a[nd - 1 :] - a[: len(a) - nd + 1]) / a.max() * len(a) / nd
    above = np.flatnonzero(d >= 1) + 1
    step = np.diff(above)
    if len(step) < 2:
        return least
    smooth = np.convolve(step, np.ones(3) / 3, "same")
    smooth[0], smooth[-1] = step[0], step[-1]
    hit = np.flatnonzero(np.isclose(smooth[1:], 1))
    if not len(hit):
        return least
    return int(min(most, max(least, most - (above[hit[0]] + nd // 2) + 1)))


def test_ranges_are_cut_by_exact_counts(spark):
    rng = np.random.default_rng(8)
    values = {0: rng.normal(size=400), 1: np.round(rng.exponential(5, 300)), 2: np.full(5, 2.5), 3: np.array([1e300, 0.0, 1.0, 1.0, np.inf, np.nan, -3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "g int, y double").repartition(5)
    got = waveforms.ranked(df, "g", "y", 8)
    assert "percentile_approx" not in got._jdf.queryExecution().toString()  # merges by order of arrival, so differs when computed again
    for k, vs in values.items():
        rows = sorted((np.nan_to_num(r.y, nan=np.inf, posinf=1.7e308), r.lower, r.upper) for r in got.where(f"g = {k}").collect())
        vs = np.sort(np.nan_to_num(vs, nan=np.inf, posinf=1.7e308))
        assert len(rows) == len(vs)
        for v, lower, upper in rows:
            assert lower == pytest.approx((vs < v).mean()) and upper == pytest.approx((vs <= v).mean())


def test_features_above_the_knee(spark):
    rng = np.random.default_rng(6)
    seen = set()
    for trial in range(12):
        scores = np.concatenate([rng.random(40) * 0.05, 0.05 + rng.random(24) * (trial / 12)])
        df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(scores)], "place int, score double")
        got = waveforms.knee_features(df, "place", 50, 4).collect()
        n = knee_by_hand(scores, 50, 4)
        assert {r.n_features for r in got} == {n} and [r.place for r in sorted(got, key=lambda r: r.from_top)] == sorted(range(64), key=lambda k: (-scores[k], -k))[:n]
        seen.add(n)
    assert len(seen) > 1


def chosen_by_hand(tree, members, least, overlap, share):
    steps, sizes = sorted({s for s, _, _ in tree}), {(s, c): n for s, c, n in tree}
    clusters = sorted({c for _, c, _ in tree})
    elbow = None
    for a, b in zip(steps, steps[1:]):
        growth = max([0] + [sizes[b, c] - sizes[a, c] for c in clusters if c > 1])
        if (sizes[b, 1] + growth) / sizes[a, 1] < share:
            elbow = b
            break
    up = {}
    for i, s in enumerate(steps[:-1]):
        if elbow is not None and s >= elbow:
            break
        hits = [c for c in clusters if sizes[s, c] >= least and (i == 0 or sizes[s, c] - sizes[steps[i - 1], c] > least)]
        up[s] = [c for c in clusters if hits and c <= max(hits)]
    kept = [(s, c) for s in up for c in up[s]]
    of = collections.defaultdict(set)
    for s, c, i in members:
        of[s, c].add(i)
    for s, c in sorted(kept, reverse=True):
        if (s, c) in kept:
            kept = [k for k in kept if k[0] >= s or len(of[k] & of[s, c]) < overlap * min(len(of[k]), len(of[s, c]))]
    return sorted(kept)


def test_clusters_of_a_tree(spark):
    rng = np.random.default_rng(8)
    seen = set()
    for share in (0.0, 0.6, 0.9):
        n = 300
        assigned = [np.ones(n, int)]
        for _ in range(7):
            own = assigned[-1].copy()
            move = rng.choice(n, 60, False)
            own[move] = rng.integers(1, 5, 60)
            assigned.append(own)
        members = [(s, int(c), i) for s, own in enumerate(assigned) for i, c in enumerate(own)]
        count = collections.Counter((s, c) for s, c, _ in members)
        tree = [(s, c, count[s, c]) for s in range(8) for c in range(1, 5)]
        a = spark.createDataFrame(tree, "step int, cluster int, size long")
        b = spark.createDataFrame(members, "step int, cluster int, id long")
        got = sorted(tuple(r) for r in waveforms.chosen_clusters(a, b, 8, 0.5, share).collect())
        want = chosen_by_hand(tree, members, 8, 0.5, share)
        assert got == want
        seen.add(len(want))
    assert len(seen) > 1

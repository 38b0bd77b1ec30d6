"""Greedy dead times beside a plain walk, whatever the segments."""

import random

import pytest

from pulsegrid.operators import carry


def walk(rows, least):
    kept, last = [], {}
    for key, t, tie in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] or "", r[1], r[2])):
        if key not in last or t - last[key] >= least:
            kept.append((key, t, tie))
            last[key] = t
    return sorted(kept, key=repr)


@pytest.mark.parametrize("segment", [10, 13, 50, 1000, None])
def test_dead_times_do_not_depend_on_segments(spark, segment):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-300, 900), k) for k in range(700)] + [("c", 5, 1), ("c", 5, 0), ("d", None, 2)]
    rows += [("e", 9 * k, k) for k in range(200)] + [("f", 11 * k, k) for k in range(200)]
    df = spark.createDataFrame(rows, "channel string, t long, id long")
    got = sorted((tuple(r) for r in carry.refractory(df, ["channel"], "t", "id", 10, segment).collect()), key=repr)
    assert got == walk(rows, 10)


def test_dead_times_of_doubles_and_two_keys(spark):
    rng = random.Random(5)
    rows = [(k % 2, "x" if k % 3 else "y", rng.random() * 40, k) for k in range(600)]
    df = spark.createDataFrame(rows, "run int, channel string, t double, id long")
    got = sorted(tuple(r) for r in carry.refractory(df, ["run", "channel"], "t", "id", 0.75, 2.5).collect())
    want = walk([(f"{a}{b}", t, k) for a, b, t, k in rows], 0.75)
    assert [(f"{a}{b}", t, k) for a, b, t, k in got] == sorted(want)


def test_dead_times_of_nothing_and_short_segments(spark):
    df = spark.createDataFrame([], "channel string, t long, id long")
    assert carry.refractory(df, ["channel"], "t", "id", 10).collect() == []
    with pytest.raises(ValueError):
        carry.refractory(df, ["channel"], "t", "id", 10, 9)


@pytest.mark.parametrize("segment", [30, 77, None])
def test_dead_times_of_their_own(spark, segment):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), t, k, t + rng.randint(0, 30)) for k, t in enumerate(rng.choices(range(-200, 800), k=600))]
    df = spark.createDataFrame(rows, "channel string, t long, id long, until long")
    want, dead = [], {}
    for c, t, k, u in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if t >= dead.get(c, t):
            want.append((c, t, k, u))
            dead[c] = u
    assert sorted(tuple(r) for r in carry.refractory(df, ["channel"], "t", "id", 30, segment, "until").collect()) == sorted(want)

"""Bootstrap intervals: ranks are drawn, not values, and means, slopes and rank correlations are sums over weighted rows.

What a task holds of a group is bounded by the number of draws. Ranks themselves come from windows over a group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .carry import borders, sorted_groups


def _fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _seed(key: tuple, seed: int) -> int:
    return zlib.crc32("|".join(map(str, key)).encode()) + seed


#: Groups of up to this many values are resampled many at once.
SMALL = 64


@lru_cache(None)
def _middles(m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of middle places (from 0, equal for odd m) of a resample of m values out of m, and their cumulated
    probabilities."""
    low = (m + 1) // 2
    # resamples whose value at the middle lies at rank r or before
    upto = [sum(comb(m, k) * r**k * (m - r) ** (m - k) for k in range(low, m + 1)) for r in range(m + 1)]
    pairs = []
    for a in range(1, m + 1):
        apart = {}
        if m % 2 == 0:
            first = comb(m, low) * (a**low - (a - 1) ** low)
            apart = {b: first * ((m - b + 1) ** low - (m - b) ** low) for b in range(a + 1, m + 1)}
        pairs += [(a, a, upto[a] - upto[a - 1] - sum(apart.values())), *((a, b, w) for b, w in apart.items())]
    sums, total = [], 0
    for *_, w in pairs:
        total += w
        sums.append(total / m**m)
    return np.array([p[0] for p in pairs]) - 1, np.array([p[1] for p in pairs]) - 1, np.array(sums)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Whether keys of a equal those of b, which are named __k_...; nulls equal each other."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"__k_{k}"]) for k in keys])


def median_intervals(df: DataFrame, keys: list[str], value: str, n: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """keys, n, median, lo, hi: each group's median and the percentile bootstrap interval of it.

    The median of a resample of m values is the value at a rank whose distribution depends on m alone: the middle order
    statistics of m uniform draws. So only ranks are drawn, `n` pairs for each group, and looked up among the ranked
    values. Groups of up to SMALL values are one row each with all of them, and the pairs of all groups of a size in a
    batch are drawn at once, from the probabilities of each pair. A group's draws depend on its keys and the seed only.
    Nulls do not count; groups without values have no rows.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    group = Window.partitionBy(*keys)
    ranked = known.withColumn("__r", F.row_number().over(group.orderBy("__v"))).withColumn("__n", F.count("*").over(group))
    few = ranked.where(F.col("__n") <= SMALL).groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("__held"))
    ranked = ranked.where(F.col("__n") > SMALL)
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("__v", 0.5).alias("median"))

    lead = _fields(df, keys)
    schema = lead + ", n long, median double, lo double, hi double"

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("__held")
            sizes, values = np.diff(held.offsets.to_numpy()).astype(int), held.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            rows = zip(*(batch.column(k).to_pylist() for k in keys)) if keys else [()] * len(sizes)
            seeds = np.array([_seed(key, seed) for key in rows], np.int64)
            out = np.empty((3, len(sizes)))
            for m in np.unique(sizes):
                first, second, upto = _middles(int(m))
                own = np.flatnonzero(sizes == m)
                step = max(1, WEIGHTS_AT_ONCE // n)
                for some in (own[lo : lo + step] for lo in range(0, len(own), step)):
                    place = np.searchsorted(upto, _uniforms(seeds[some], np.arange(n)), "right")
                    base = starts[some][:, None]
                    medians = 0.5 * values[base + first[place]] + 0.5 * values[base + second[place]]
                    out[0, some] = 0.5 * values[starts[some] + (m - 1) // 2] + 0.5 * values[starts[some] + m // 2]
                    out[1:, some] = np.percentile(medians, [50 * alpha, 100 - 50 * alpha], axis=1)
            cols = [*(batch.column(k) for k in keys), pa.array(sizes, pa.int64()), *map(pa.array, out)]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "n", "median", "lo", "hi"])

    def ranks(key: tuple, m: int) -> np.ndarray:
        """(2, n): the two middle ranks of each resample, equal for odd m."""
        rng = np.random.default_rng(_seed(key, seed))
        low = (m + 1) // 2
        u = rng.beta(low, m - low + 1, n)
        # the next order statistic, given this one
        after = u + (1 - u) * rng.beta(1, m - low, n) if m % 2 == 0 else u
        return np.clip(np.ceil(m * np.stack([u, after])), 1, m).astype(int)

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[[*keys, "n"]].itertuples(index=False)
            yield batch[keys].assign(__r=[np.unique(ranks(tuple(key), m)) for *key, m in rows])

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = []
            for (*key, m), held in zip(batch[[*keys, "n"]].itertuples(index=False), batch["__held"]):
                at, values = (np.array([h[c] for h in held]) for c in ("__r", "__v"))
                order = np.argsort(at)
                medians = values[order][np.searchsorted(at[order], ranks(tuple(key), m))].mean(0)
                ends.append(np.percentile(medians, [50 * alpha, 100 - 50 * alpha]))
            lo, hi = np.array(ends).T if ends else ([], [])
            yield batch[[*keys, "n", "median"]].assign(lo=lo, hi=hi)

    asked = sizes.select(*keys, "n").mapInPandas(wanted, lead + ", __r array<int>").select(*keys, F.explode("__r").alias("__r"))
    # as many values a group as there are distinct ranks, at most 2 n
    asked = asked.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__r").alias("__asked"))
    met = ranked.join(asked, _same(ranked, asked, keys) & (ranked["__r"] == asked["__asked"]))
    held = met.groupBy(*keys).agg(F.collect_list(F.struct("__r", "__v")).alias("__held"))
    held = held.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__held")
    told = sizes.join(held, _same(sizes, held, keys)).select(*keys, "n", "median", "__held").mapInPandas(look_up, schema)
    return few.mapInArrow(at_once, schema).unionByName(told)


def _uniforms(rows: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Uniform numbers from 0 to 1 (rows, draws) that depend on a row's hash and the draw only."""
    with np.errstate(over="ignore"):
        h = rows.astype(np.uint64)[:, None] + draws.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)) / float(1 << 53)


def _poisson(rows: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Poisson(1) weights (rows, draws) that depend on a row's hash and the draw only."""
    cdf = np.cumsum(np.exp(-1.0) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8, 9]))
    return np.searchsorted(cdf, _uniforms(rows, draws)).astype(float)


#: Weights (rows times draws) that a task holds at once.
WEIGHTS_AT_ONCE = 1 << 21


def _lists(values: np.ndarray) -> pa.Array:
    """A list column with a row for each row of values."""
    rows, n = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * n, pa.int32()), pa.array(values.ravel()))


def draw_sums(df: DataFrame, keys: list[str], terms: dict[str, Column], row_id: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """keys, w and the weighted sums of each term as arrays with an entry for each of `n` resamples, one row a group: every
    row weighs an own Poisson(1) count in each resample.

    Rows are dealt by their group first, so a task hands on one row for each group that it holds; where a group fills
    several partitions their sums are added once more. A task holds the sums of one group and of a slice of rows. row_id:
    columns that tell rows of a group apart; draws depend on them and the seed only. Rows with a null in any term do not
    count.
    """
    summed = ["w", *terms]
    held = [c.cast("double").alias(f"__{name}") for name, c in terms.items()]
    rows = df.select(*keys, *held, F.xxhash64(F.lit(seed), *row_id).alias("__h")).dropna(subset=[f"__{x}" for x in terms])

    def runs(table: pa.Table) -> np.ndarray:
        """The first rows of groups, and the number of rows."""
        return np.concatenate([[0], borders(table, keys) if keys else [], [table.num_rows]]).astype(int)

    def told(table: pa.Table, at: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
        groups = [table.column(k).take(pa.array(at)).combine_chunks() for k in keys]
        groups = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in groups]
        return pa.RecordBatch.from_arrays([*groups, *map(_lists, sums)], [*keys, *summed])

    def folded(slices: Iterator[tuple[pa.Table, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        """Sums of whole groups from rows sorted by group and the sums of each of their groups."""
        last, carried = None, None
        for table, sums in slices:
            at = runs(table)[:-1]
            if last is not None:
                if keys and len(borders(pa.concat_tables([last, table.select(keys).slice(0, 1)]), keys)):
                    yield told(last, np.zeros(1, int), carried)
                else:
                    for s, c in zip(sums, carried):
                        s[0] += c[0]
            if len(at) > 1:
                yield told(table, at[:-1], [s[:-1] for s in sums])
            last, carried = table.select(keys).slice(int(at[-1]), 1), [s[-1:].copy() for s in sums]
        if carried is not None:
            yield told(last, np.zeros(1, int), carried)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices():
            step = max(1, WEIGHTS_AT_ONCE // max(n, 1))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    table = pa.Table.from_batches([batch.slice(lo, step)])
                    first = runs(table)[:-1]
                    weights = _poisson(table.column("__h").to_numpy(), np.arange(n))
                    values = [table.column(f"__{x}").to_numpy()[:, None] * weights for x in summed[1:]]
                    yield table, [np.add.reduceat(v, first) for v in (weights, *values)]

        yield from folded(slices())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices():
            step = max(1, WEIGHTS_AT_ONCE // max(n, 1))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    table = pa.Table.from_batches([batch.slice(lo, step)]).combine_chunks()
                    first = runs(table)[:-1]
                    flat = [pa.concat_arrays(table.column(x).chunks).flatten().to_numpy().reshape(-1, n) for x in summed]
                    yield table, [np.add.reduceat(v, first) for v in flat]

        yield from folded(slices())

    schema = (_fields(df, keys) + ", " if keys else "") + ", ".join(f"`{x}` array<double>" for x in summed)
    if not keys:
        return rows.mapInArrow(weigh, schema).coalesce(1).mapInArrow(merge, schema)
    partial = rows.hint("rebalance", *keys).sortWithinPartitions(*keys).mapInArrow(weigh, schema)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, schema)


def sum_draws(df: DataFrame, keys: list[str], terms: dict[str, Column], row_id: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """`draw_sums` with a row for each draw of each group: keys, draw, w and the sums."""
    names = ["w", *terms]
    each = draw_sums(df, keys, terms, row_id, n, seed).select(*keys, F.posexplode(F.arrays_zip(*names)).alias("draw", "__s"))
    return each.select(*keys, F.col("draw").cast("long").alias("draw"), *[F.col("__s")[x].alias(x) for x in names])


def stratified_draws(
    df: DataFrame, keys: list[str], stratum: list[str], terms: dict[str, Column], row_id: list[str], n: int = 1000, seed: int = 0
) -> DataFrame:
    """keys, draw, w and the sums of each term over resamples that keep every stratum's number of rows.

    A stratum's sums are scaled by its number of rows over the weight that it drew; one that drew nothing counts with
    its rows as they are, so no resample loses a stratum.
    """
    good = F.lit(True)
    for c in terms.values():
        good &= c.isNotNull()
    plain = df.where(good).groupBy(*keys, *stratum).agg(F.count("*").alias("__n"), *[F.sum(c.cast("double")).alias(f"__{x}") for x, c in terms.items()])
    drawn = sum_draws(df, [*keys, *stratum], terms, row_id, n, seed).join(plain, [*keys, *stratum])
    scaled = [F.sum(F.when(F.col("w") > 0, F.col(x) * F.col("__n") / F.col("w")).otherwise(F.col(f"__{x}"))).alias(x) for x in terms]
    return drawn.groupBy(*keys, "draw").agg(F.sum("__n").alias("w"), *scaled)


def mean_draws(df: DataFrame, keys: list[str], value: str, row_id: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """keys, means: means of `n` resamples of each group as an array, null for a resample without rows; nulls do not count."""
    sums = draw_sums(df, keys, {"s": F.col(value)}, row_id, n, seed)
    return sums.select(*keys, F.zip_with("s", "w", lambda s, w: F.when(w > 0, s / w)).alias("means"))


def interval(draws: DataFrame, keys: list[str], value: Column, alpha: float = 0.05) -> DataFrame:
    return draws.groupBy(*keys).agg(F.percentile(value, alpha / 2).alias("lo"), F.percentile(value, 1 - alpha / 2).alias("hi"))


def array_interval(draws: DataFrame, keys: list[str], values: Column, alpha: float = 0.05) -> DataFrame:
    """keys, lo, hi: the same of groups whose draws are an array (nulls do not count); no rows for those without draws."""
    known = draws.select(*keys, F.sort_array(F.array_compact(values)).alias("__v")).where(F.size("__v") > 0)

    def at(p: float) -> Column:
        place = p * (F.size("__v") - 1)
        low = F.floor(place).cast("int")
        a, b = F.get("__v", low), F.get("__v", F.ceil(place).cast("int"))
        return a + (place - low) * (b - a)

    return known.select(*keys, at(alpha / 2).alias("lo"), at(1 - alpha / 2).alias("hi"))


def paired_db_intervals(df: DataFrame, keys: list[str], base: str, post: str, row_id: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """keys, n_pairs, median_db, mean_db, lo, hi, contains_zero: mean change of pairs in dB and its bootstrap interval over
    pairs; pairs with a value that is not positive do not count."""
    db = F.when((F.col(base) > 0) & (F.col(post) > 0), 10 * F.log10(F.col(post) / F.col(base)))
    rows = df.withColumn("__db", db)
    per = rows.groupBy(*keys).agg(F.count("__db").alias("n_pairs"), F.percentile("__db", 0.5).alias("median_db"), F.avg("__db").alias("mean_db"))
    both = per.join(array_interval(mean_draws(rows, keys, "__db", row_id, n, seed), keys, F.col("means")), keys, "left")
    return both.withColumn("contains_zero", F.coalesce((F.col("lo") <= 0) & (F.col("hi") >= 0), F.lit(False)))


def independent_db_intervals(df: DataFrame, keys: list[str], value: str, first: Column, row_id: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """keys, db, lo, hi: dB of the mean of the other rows over that of the first ones, either side resampled by itself; only
    positive values count, groups without both sides have no rows."""
    good = df.where(F.col(value) > 0)
    sides = [good.where(first), good.where(~first)]
    means = [x.groupBy(*keys).agg(F.avg(value).alias(f"m{k}")) for k, x in enumerate(sides)]
    draws = [mean_draws(x, keys, value, row_id, n, seed + k).withColumnRenamed("means", f"d{k}") for k, x in enumerate(sides)]
    found = array_interval(draws[0].join(draws[1], keys), keys, F.zip_with("d0", "d1", lambda a, b: 10 * F.log10(b / a)))
    point = means[0].join(means[1], keys).select(*keys, (10 * F.log10(F.col("m1") / F.col("m0"))).alias("db"))
    return point.join(found, keys)


def fraction_intervals(df: DataFrame, keys: list[str], flag: Column, row_id: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """keys, n, fraction, lo, hi: share of flagged rows and its bootstrap interval; null flags do not count."""
    rows = df.withColumn("__f", flag.cast("double"))
    per = rows.groupBy(*keys).agg(F.count("__f").alias("n"), F.avg("__f").alias("fraction"))
    return per.where("n > 0").join(array_interval(mean_draws(rows, keys, "__f", row_id, n, seed), keys, F.col("means")), keys, "left")


def difference_intervals(df: DataFrame, keys: list[str], value: str, first: Column, row_id: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """keys, difference, lo, hi: mean of the other rows less that of the first ones, either side resampled by itself; groups
    without both sides have no rows."""
    sides = [df.where(first), df.where(~first)]
    means = [x.groupBy(*keys).agg(F.avg(value).alias(f"m{k}")).dropna(subset=[f"m{k}"]) for k, x in enumerate(sides)]
    draws = [mean_draws(x, keys, value, row_id, n, seed + k).withColumnRenamed("means", f"d{k}") for k, x in enumerate(sides)]
    found = array_interval(draws[0].join(draws[1], keys), keys, F.zip_with("d0", "d1", lambda a, b: b - a))
    return means[0].join(means[1], keys).select(*keys, (F.col("m1") - F.col("m0")).alias("difference")).join(found, keys)


def slope_intervals(
    df: DataFrame, keys: list[str], x: str, y: str, stratum: list[str], row_id: list[str], n: int = 1000, seed: int = 0
) -> DataFrame:
    """keys, n, slope, intercept, lo, hi: least squares of y on x and the interval of the slope over resamples of the rows
    within each stratum (a run); groups with one x have no rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    centre = rows.groupBy(*keys).agg(
        F.avg(x).alias("__x"), F.avg(y).alias("__y"), F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    ).where(F.col("slope").isNotNull())
    near = rows.join(centre.select(*keys, "__x", "__y"), keys)
    dx, dy = F.col(x) - F.col("__x"), F.col(y) - F.col("__y")
    sums = stratified_draws(near, keys, stratum, {"x": dx, "y": dy, "xx": dx * dx, "xy": dx * dy}, row_id, n, seed)
    spread = F.col("w") * F.col("xx") - F.col("x") * F.col("x")
    slope = F.when(spread > 0, (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / spread)
    return centre.drop("__x", "__y").join(interval(sums, keys, slope), keys, "left")


def spearman_intervals(df: DataFrame, keys: list[str], x: str, y: str, row_id: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """keys, n, rho, lo, hi: rank correlation and the interval of it over resamples of pairs; under three pairs no rows.

    Resampling moves the ranks too. To first order a row adds 12 ((u - 1/2)(v - 1/2) + A + B) to it, with u and v its
    middle ranks over n, A the mean over all rows of v - 1/2 where x is larger (ties half), and B the same the other way;
    so resamples are means of these numbers, as for any mean, and no resample is ranked.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    group, whole = Window.partitionBy(*keys), (Window.unboundedPreceding, Window.unboundedFollowing)

    def middle(c: str) -> Column:
        w = group.orderBy(c)
        return (F.rank().over(w) + (F.count("*").over(group.partitionBy(*keys, c)) - 1) / 2 - F.lit(0.5)) / F.col("__n")

    def above(c: str, other: str) -> Column:
        """Sum of other over the rows with larger c, and half of those with equal c."""
        same = F.sum(other).over(Window.partitionBy(*keys, c))
        larger = F.sum(other).over(group.orderBy(F.desc(c)).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - same
        return (larger + same / 2) / F.col("__n")

    ranked = rows.withColumn("__n", F.count("*").over(group.rowsBetween(*whole))).where("__n >= 3")
    ranked = ranked.withColumns({"__u": middle(x) - 0.5, "__v": middle(y) - 0.5})
    effect = 12 * (F.col("__u") * F.col("__v") + above(x, "__v") + above(y, "__u"))
    ranked = ranked.withColumn("__e", effect)
    per = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("__u", "__v").alias("rho"), F.avg("__e").alias("__m"))
    draws = mean_draws(ranked, keys, "__e", row_id, n, seed).join(per, keys)
    # ties take from the ranks' spread; the effect is on the scale of untied ranks
    moved = F.transform("means", lambda m: F.when(m.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("rho") + m - F.col("__m")))))
    found = array_interval(draws, keys, moved)
    return per.drop("__m").join(found, keys, "left")


def fake_onsets(intervals: DataFrame, keys: list[str], n: int, apart: int, seed: int = 0, attempts: int = 50) -> DataFrame:
    """keys, onset: up to n places drawn evenly from the union of each channel's intervals (start, end), at least `apart`
    from each other.

    Draws follow one another as they are made: one that comes too close to any that is kept is rejected, and up to
    `attempts` times n are made. Draws are hashes of keys, seed and number, laid along the intervals' summed length. A
    channel's kept places, n at most, are all that a task holds of it.
    """
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end") - F.col("start")
    laid = intervals.where(length > 0).withColumn("__from", F.coalesce(F.sum(length).over(w), F.lit(0)))
    total = laid.groupBy(*keys).agg(F.sum(length).alias("__total"))
    draws = total.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(attempts * n - 1))))
    at = F.pmod(F.xxhash64(F.lit(seed), *keys, "__k"), F.col("__total"))
    draws = draws.select(*keys, "__k", at.alias("__at"))
    pieces = laid.select(*[F.col(k).alias(f"__{k}") for k in keys], "start", "__from", (F.col("__from") + length).alias("__to"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__at") >= F.col("__from"), F.col("__at") < F.col("__to")]
    # draws are many for each channel, which Spark's estimate does not see: they are dealt, never broadcast
    placed = draws.join(pieces.hint("merge"), on).select(*keys, (F.col("start") + F.col("__at") - F.col("__from")).alias("onset"), "__k")

    def reject(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by channel, in the order of the draws."""
        for table, cuts in sorted_groups(batches, keys):
            onsets, kept = table.column("onset").to_pylist(), []
            for a, b in zip(cuts, cuts[1:]):
                held: list[int] = []
                for i in range(a, b):
                    if len(held) == n:
                        break
                    k = bisect_left(held, onsets[i])
                    if (k == 0 or onsets[i] - held[k - 1] >= apart) and (k == len(held) or held[k] - onsets[i] >= apart):
                        held.insert(k, onsets[i])
                        kept.append(i)
            yield from table.select([*keys, "onset"]).take(pa.array(kept, pa.int64())).to_batches()

    dealt = placed.repartition(*keys).sortWithinPartitions(*keys, "__k")
    return dealt.mapInArrow(reject, placed.select(*keys, "onset").schema)


def pseudo_onsets(
    runs: DataFrame, keys: list[str], before: int, behind: int, step: int, jitter: int = 0, most: int | None = None, seed: int = 0
) -> DataFrame:
    """keys, event_number, onset: places of runs without pulses (keys, n_samples) that keep `before` samples in front and
    `behind` samples from there on inside the recording, `step` apart, each moved by up to `jitter` samples; the first
    `most` of them."""
    last = F.col("n_samples") - behind  # excluded
    places = F.sequence(F.lit(before).cast("long"), last - 1, F.lit(step).cast("long"))
    placed = runs.where(last > before).select(*keys, last.alias("__last"), F.posexplode(places).alias("event_number", "onset"))
    if most is not None:
        placed = placed.where(F.col("event_number") < most)
    moved = F.col("onset") + (F.pmod(F.xxhash64(F.lit(seed), *keys, "event_number"), F.lit(jitter + 1)) if jitter else F.lit(0))
    return placed.select(*keys, F.col("event_number").cast("long").alias("event_number"), F.least(moved, F.col("__last") - 1).alias("onset"))

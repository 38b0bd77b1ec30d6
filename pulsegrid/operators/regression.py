"""Regression in plain aggregates: least squares, through the origin, log-log, additive, model choice, robust checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dsp
from .carry import sorted_groups
from .pairing import theil_sen
from .resampling import draw_sums


def ols(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """slope, intercept, r2, n per group; null with fewer than `least` points or one x."""
    per = df.groupBy(*keys).agg(
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"),
    )
    good = (F.col("n") >= least) & (F.col("sxx") > 0)
    return per.select(*keys, "n", *[F.when(good, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


def through_origin(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """slope = sum(xy) / sum(xx) per group and its residual sum of squares."""
    per = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy")
    )
    slope = F.when((F.col("n") >= 2) & (F.col("sxx") > 0), F.col("sxy") / F.col("sxx"))
    return per.withColumn("slope", slope).withColumn("rss", F.col("syy") - F.col("slope") * F.col("sxy")).select(*keys, "n", "slope", "rss")


def model_choice(df: DataFrame, keys: list[str], x: str, y: str, within: float = 2.0) -> DataFrame:
    """AIC and BIC of the line and of the line through the origin, the better by AIC, and whether the origin's is within
    `within` of it (then the response may be an artifact proportional to the current)."""
    per = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"),
        F.regr_syy(y, x).alias("cyy"), F.regr_sxy(y, x).alias("cxy"), F.regr_sxx(y, x).alias("cxx"),
    )
    per = per.where("n >= 4 AND cxx > 0")
    n = F.col("n")
    line = F.col("cyy") - F.col("cxy") * F.col("cxy") / F.col("cxx")
    origin = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")

    def criterion(rss: Column, k: int, weight: Column) -> Column:
        return F.when(rss > 0, n * F.ln(rss / n) + k * weight)

    two, log_n = F.lit(2.0), F.ln(n)
    scored = per.select(
        *keys, "n", criterion(line, 2, two).alias("aic_line"), criterion(origin, 1, two).alias("aic_origin"),
        criterion(line, 2, log_n).alias("bic_line"), criterion(origin, 1, log_n).alias("bic_origin"),
    )
    best = F.when(F.col("aic_origin") <= F.col("aic_line"), "origin").otherwise("line")
    return scored.withColumn("best", best).withColumn("artifact", F.col("aic_origin") - F.least("aic_origin", "aic_line") <= within)


def log_log(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares of ln y on ln x; rows that are not positive are left out and counted."""
    logs = df.withColumn("lx", F.when((F.col(x) > 0) & (F.col(y) > 0), F.ln(x))).withColumn("ly", F.when((F.col(x) > 0) & (F.col(y) > 0), F.ln(y)))
    per = logs.groupBy(*keys).agg(
        F.count("lx").alias("n"), F.count_if(F.col("lx").isNull()).alias("n_excluded"), F.regr_slope("ly", "lx").alias("slope"),
        F.regr_intercept("ly", "lx").alias("intercept"), F.regr_r2("ly", "lx").alias("r2"),
    )
    return per


def additive(df: DataFrame, keys: list[str], run: str, tau: str, y: str) -> DataFrame:
    """y = a tau + b over trials, with R2 against the runs' medians."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, tau).alias("a"), F.regr_intercept(y, tau).alias("b"))
    runs = df.groupBy(*keys, run).agg(F.percentile(y, 0.5).alias("median"), F.avg(tau).alias("tau"))
    both = runs.join(fit, keys)
    residual = F.col("median") - F.col("a") * F.col("tau") - F.col("b")
    return both.groupBy(*keys).agg(
        F.first("a").alias("a"), F.first("b").alias("b"), F.count("*").alias("n_runs"),
        (1 - F.sum(residual * residual) / F.when(F.var_pop("median") > 0, F.var_pop("median") * F.count("*"))).alias("r2"),
    )


def decade_mislabels(points: DataFrame, keys: list[str], label: str, x: str, y: str) -> DataFrame:
    """Points whose response says that their amplitude is off by a power of ten.

    A robust log-log line of |x| (median of pair slopes, median intercept) is laid through each group of at least four
    usable points at three levels. A point is suspect when its residual is over max(0.3, 0.5 |slope|) and a shift by one
    decade, up (1) or down (-1), brings it within 0.15 of the line. Other points have shift 0, unusable ones no residual.
    Flags never change the data.
    """
    usable = (F.abs(x) > 0) & (F.col(y) > 0)
    logs = points.withColumn("__lx", F.when(usable, F.log10(F.abs(x)))).withColumn("__ly", F.when(usable, F.log10(y)))
    good = logs.where("__lx IS NOT NULL")
    enough = good.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.round("__lx", 6)).alias("levels")).where("n >= 4 AND levels >= 3")
    slopes = theil_sen(good, keys, "__lx", "__ly").drop("n_pairs").join(enough.select(*keys), keys)
    level = good.join(slopes, keys).groupBy(*keys).agg(
        F.percentile(F.col("__ly") - F.col("slope") * F.col("__lx"), 0.5).alias("level"), F.first("slope").alias("slope")
    )
    placed = logs.join(level, keys, "left").withColumn("residual", F.col("__ly") - F.col("slope") * F.col("__lx") - F.col("level"))
    far = F.abs("residual") > F.greatest(F.lit(0.3), 0.5 * F.abs("slope"))
    up, down = F.abs(F.col("residual") - F.col("slope")), F.abs(F.col("residual") + F.col("slope"))
    shift = F.when(far & (F.least(up, down) < 0.15), F.when(up < down, 1).otherwise(-1)).otherwise(0)
    return placed.select(*keys, label, "residual", shift.alias("shift"), (shift != 0).alias("suspect"))


def decade_votes(flags: DataFrame, run: str, channel: str) -> DataFrame:
    """Per run: whether at least half of its tested channels agree on the same shift, and which (0: none).

    flags: run, channel, residual, shift as from `decade_mislabels`; a channel is tested when it has a residual anywhere.
    """
    # one row a channel, sent to the runs: a window over a channel would be all of its runs in one task
    on = flags.where(F.col("residual").isNotNull()).select(channel).distinct().withColumn("__on", F.lit(True))
    tested = flags.join(F.broadcast(on), channel, "left")
    tally = flags.where("shift <> 0").groupBy(run, "shift").agg(F.count_distinct(channel).alias("n"))
    best = tally.groupBy(run).agg(F.max_by("shift", F.struct("n", "shift")).alias("shift"), F.max("n").alias("n_agree"))
    per = tested.groupBy(run).agg(F.count_distinct(F.when(F.col("__on"), F.col(channel))).alias("n_tested")).join(best, run, "left")
    passed = F.coalesce((F.col("n_agree") > 0) & (2 * F.col("n_agree") >= F.col("n_tested")), F.lit(False))
    return per.select(
        run, F.coalesce("n_agree", F.lit(0)).alias("n_agree"), "n_tested", passed.alias("suspect"),
        F.when(passed, F.col("shift")).otherwise(0).alias("shift"),
    )


def sweep_evidence(df: DataFrame, keys: list[str], current: str, response: str) -> DataFrame:
    """A response that grows with |current| through the origin, and its asymmetry between the polarities; groups with
    under three points are left out."""
    x, known = F.abs(current), F.col(current).isNotNull() & F.col(response).isNotNull()
    per = df.where(known).groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.regr_slope(F.col(response), x).alias("slope"),
        F.regr_intercept(F.col(response), x).alias("intercept"), F.regr_r2(F.col(response), x).alias("r2"),
        (F.max(response) - F.min(response)).alias("span"), F.avg(F.when(F.col(current) > 0, F.col(response))).alias("plus"),
        F.avg(F.when(F.col(current) < 0, F.col(response))).alias("minus"),
    )
    straight = (F.col("r2") > 0.95) & (F.col("span") > 0) & (F.abs("intercept") < 0.15 * F.col("span"))
    mean = 0.5 * (F.col("plus") + F.col("minus"))
    return per.where("n_points >= 3").select(
        *keys, "n_points", "slope", "intercept", "r2", F.coalesce(straight, F.lit(False)).alias("through_origin"),
        F.when(mean > 0, F.abs(F.col("plus") - F.col("minus")) / mean).alias("asymmetry"),
    )


def run_evidence(
    df: DataFrame, latency: str, tail: str, post_latency: str, during: str, post: str, n_peaks: str, width_ms: float = 5.0
) -> DataFrame:
    """Signs of an artifact in a run: a peak within 1.5 ms of the onset, at most 30 % of the energy behind the pulse (both:
    suspicion 1, one: 0.5), a later peak within 1.5 ms of the pulse's end, and how much larger the response is during the
    pulse. Unknown values are no signs."""
    def sign(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    fast, stops = sign(F.col(latency) <= 1.5), sign(F.col(tail) <= 0.30)
    return (
        df.withColumn("fast_latency", fast)
        .withColumn("stops_with_pulse", stops)
        .withColumn("suspicion", (fast.cast("int") + stops.cast("int")) / 2)
        .withColumn("fast_latency_post", sign(F.col(post_latency) - width_ms <= 1.5))
        .withColumn("coupling_ratio", F.when(F.col(post) > 0, F.col(during) / F.col(post)))
        .withColumn("post_response", sign(F.col(n_peaks) > 0))
    )


def slope_verdict(df: DataFrame, low: str, high: str, band: float = 0.25, widest: float = 1.0) -> DataFrame:
    """What the confidence interval of a log-log slope says: proportional (~1), flat, or neither.

    ~1: the interval lies within 1 +- band, or holds 1 and not 0 and is narrower than `widest`; flat: it lies within
    +- band, or holds 0 and not 1.
    """
    lo, hi = F.col(low), F.col(high)
    one, zero = (lo <= 1) & (hi >= 1), (lo <= 0) & (hi >= 0)
    near_one, near_zero = (lo >= 1 - band) & (hi <= 1 + band), (lo >= -band) & (hi <= band)
    verdict = (
        F.when(lo.isNull() | hi.isNull(), "insufficient")
        .when(near_one | (one & ~zero & (hi - lo < widest)), "~1")
        .when(near_zero | (zero & ~one), "flat")
        .otherwise("intermediate")
    )
    return df.withColumn("verdict", verdict)


def usable_runs(
    trials: DataFrame, keys: list[str], y: str, floor: Column, drift: Column, censor: float = 850.0, margin: float = 1.0,
    most_drift: float = 25.0, most_share: float = 0.5, least: int = 3,
) -> DataFrame:
    """Per run (the keys) its median and why its trials are left out of slope fits ('': they are not)."""
    per = trials.groupBy(*keys).agg(
        F.percentile(y, 0.5).alias("median"), F.max(floor).alias("floor"), F.count("*").alias("n"),
        F.avg((F.abs(drift) > most_drift).cast("int")).alias("drifting"),
    )
    reason = (
        F.when(F.col("median") >= censor, "censored").when(F.col("median") <= F.col("floor") + margin, "hardware_floor")
        .when(F.col("drifting") > most_share, "drifting").when(F.col("n") < least, "few_trials").otherwise("")
    )
    return per.select(*keys, "median", "n", reason.alias("excluded"))


def floor_clause(runs: DataFrame, keys: list[str], tau: str, recovery: str, tie: str) -> DataFrame:
    """The two runs of shortest time constant of each group: how recovery and time constant grow between them, and whether
    recovery rests on a floor (time constant at least twice, recovery under 1.3 times)."""
    w = Window.partitionBy(*keys).orderBy(tau, tie)
    first = runs.where(F.col(recovery).isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    at = lambda c, k: F.max(F.when(F.col("rn") == k, F.col(c)))
    per = first.groupBy(*keys).agg(F.count("*").alias("n"), *[at(c, k).alias(f"{n}{k}") for c, n in ((tau, "tau"), (recovery, "recovery")) for k in (1, 2)])
    per = per.where("n = 2").withColumn("recovery_ratio", F.when(F.col("recovery1") > 0, F.col("recovery2") / F.col("recovery1")))
    per = per.withColumn("tau_ratio", F.when(F.col("tau1") > 0, F.col("tau2") / F.col("tau1")))
    rests = F.coalesce((F.col("tau_ratio") >= 2) & (F.col("recovery_ratio") < 1.3), F.lit(False))
    return per.select(*keys, F.col("recovery1").alias("shortest_recovery"), "recovery_ratio", "tau_ratio", rests.alias("floor"))


def zero_rail_reach(runs: DataFrame, keys: list[str], upper: str, share: str, least: float = 0.95) -> DataFrame:
    """Per channel the widest upper cutoff at which enough trials are free of rails (null: none), and whether it is already
    the widest ones of all (`always`: 7000 Hz or more), a narrower one (`reaches`) or `never`."""
    per = runs.groupBy(*keys).agg(F.max(F.when(F.col(share) >= least, F.col(upper))).alias("reach_hz"))
    kind = F.when(F.col("reach_hz").isNull(), "never").when(F.col("reach_hz") >= 7000, "always").otherwise("reaches")
    return per.withColumn("reach", kind)


def recommendation(
    runs: DataFrame, keys: list[str], run: str, recovery: str, noise: str, upper: str, censored: str, reference: Column,
    factor: float = 2.0, least_upper: float = 300.0,
) -> DataFrame:
    """Settings ranked by recovery, then noise, with place 1 for the one to recommend; null for those not eligible.

    Eligible: noise up to `factor` times that of the reference setting (the first such run; without one the group's
    median), upper cutoff wide enough, under half of the trials censored. Runs without a recovery are left out.
    """
    known = runs.where(F.col(recovery).isNotNull())
    at = known.withColumn("__ref", F.coalesce(reference, F.lit(False)))
    limit = at.groupBy(*keys).agg(
        F.min_by(F.col(noise), F.struct(~F.col("__ref"), F.col(run))).alias("ref"), F.bool_or("__ref").alias("any"),
        F.percentile(noise, 0.5).alias("median"),
    )
    limit = limit.select(*keys, F.when(F.col("any"), F.col("ref")).otherwise(F.col("median")).alias("reference_noise"))
    ok = (F.col(noise) <= factor * F.col("reference_noise")) & (F.col(upper) >= least_upper) & (F.col(censored) < 0.5)
    ranked = at.join(limit, keys).withColumn("eligible", F.coalesce(ok, F.lit(False)))
    w = Window.partitionBy(*keys, "eligible").orderBy(recovery, noise, run)
    place = F.when(F.col("eligible"), F.row_number().over(w))
    return ranked.withColumn("place", place).withColumnRenamed("__ref", "is_reference")


def pareto(df: DataFrame, keys: list[str], cost: str, gain: str, tie: str) -> DataFrame:
    """Rows that no other row of the group beats: none costs less and gains at least as much."""
    w = Window.partitionBy(*keys).orderBy(cost, F.desc(gain), tie)
    best = F.max(gain).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__best", best).where(F.col("__best").isNull() | (F.col(gain) > F.col("__best"))).drop("__best")


def residual_covariates(df: DataFrame, keys: list[str], covariate: str, residual: str, least: int = 10) -> DataFrame:
    """Correlation and slope of residuals on ln covariate in groups of more than `least` rows."""
    logs = df.where(F.col(covariate) > 0).withColumn("lc", F.ln(covariate))
    per = logs.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("lc", residual).alias("r"), F.regr_slope(residual, "lc").alias("slope"))
    return per.where(F.col("n") > least)


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts, the skewness of values and of the logarithms of positive ones, and the scale to analyse them on by these:
    insufficient (fewer than three values), raw where some are not positive, log where that is less skewed, else raw."""
    logs = df.withColumn("__log", F.when(F.col(value) > 0, F.log10(value)))
    per = logs.groupBy(*keys).agg(
        F.count(value).alias("n"), F.count_if(F.col(value) <= 0).alias("n_nonpositive"), F.skewness(value).alias("skew"), F.skewness("__log").alias("log_skew")
    )
    scale = (
        F.when(F.col("n") < 3, "insufficient").when(F.col("n_nonpositive") > 0, "raw (non-positive values present)")
        .when(F.abs("log_skew") < F.abs("skew"), "log").otherwise("raw")
    )
    return per.withColumn("scale", scale)


def dose_levels(df: DataFrame, keys: list[str], current: str, response: str) -> DataFrame:
    """keys, x, n, mean, within, top: the trials of each distinct current; squares within a current do not depend on the
    curve that is fitted."""
    known = df.where(F.col(current).isNotNull() & F.col(response).isNotNull())
    return known.groupBy(*keys, F.col(current).cast("double").alias("x")).agg(
        F.count("*").cast("double").alias("n"), F.avg(response).alias("mean"), (F.var_pop(response) * F.count("*")).alias("within"),
        F.max(response).cast("double").alias("top"),
    )


DOSE_FIELDS = (
    "n_trials long, n_currents long, linear_m double, linear_c double, linear_aic double, linear_bic double, origin_m double, "
    "origin_aic double, origin_bic double, sigmoid_amax double, sigmoid_i50 double, sigmoid_k double, sigmoid_aic double, "
    "sigmoid_bic double, preferred string, preferred_bic string, artifact boolean"
)


def amplitude_response(df: DataFrame, keys: list[str], current: str, response: str) -> DataFrame:
    """A line, a line through the origin and a bounded sigmoid fitted to each group's responses, with AIC, BIC, the
    preferred one, and whether the origin's line is within 2 AIC of it (the sign of an artifact).

    Groups are summed by current first, so the sigmoid is fitted to one row for each distinct current, and all groups of a
    batch are fitted at once. Fewer than four trials or three currents are insufficient.
    """
    levels = dose_levels(df, keys, current, response)
    lead = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [c.split()[0] for c in DOSE_FIELDS.split(", ")]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in sorted_groups(batches, keys):
            x, n, mean, within, top = (table.column(c).to_numpy() for c in ("x", "n", "mean", "within", "top"))
            groups = [(x[a:b], n[a:b], mean[a:b], float(within[a:b].sum()), float(top[a:b].max())) for a, b in zip(cuts, cuts[1:])]
            rows = [(int(g[1].sum()), len(g[0]), *found) for g, found in zip(groups, dsp.dose_models_of(groups))]
            out = table.select(keys).take(pa.array(cuts[:-1]))
            for name, values in zip(names, zip(*rows)):
                out = out.append_column(name, pa.array(values))
            yield from out.combine_chunks().to_batches()

    return levels.repartition(*keys).sortWithinPartitions(*keys, "x").mapInArrow(fit, f"{lead}, {DOSE_FIELDS}")


def i50_intervals(
    df: DataFrame, keys: list[str], current: str, response: str, row_id: list[str], n: int = 1000, seed: int = 0
) -> DataFrame:
    """keys, i50, lo, hi, converged: the sigmoid's half-way current and the interval of it over resamples within each
    current, with the share of resamples whose fit ended; groups without a sigmoid have no rows.

    A resample is the mean of each current's weighed trials; its fit begins at the one of all trials, and all resamples of
    a group are fitted at once.
    """
    levels = dose_levels(df, keys, current, response)
    known = df.where(F.col(current).isNotNull() & F.col(response).isNotNull()).withColumn("x", F.col(current).cast("double"))
    drawn = draw_sums(known, [*keys, "x"], {"s": F.col(response)}, row_id, n, seed)
    drawn = drawn.select(*keys, "x", F.zip_with("s", "w", lambda s, w: F.when(w > 0, s / w)).alias("draws"))
    both = levels.join(drawn, [*keys, "x"])
    lead = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in sorted_groups(batches, keys):
            cols = [table.column(c).to_numpy() for c in ("x", "n", "mean", "within", "top")]
            groups = [(*(c[a:b] for c in cols[:3]), 0.0, float(cols[4][a:b].max()) if cols[4][a:b].max() > 0 else 1.0) for a, b in zip(cuts, cuts[1:])]
            enough = [g for g, own in enumerate(groups) if len(own[0]) >= 3 and own[1].sum() >= 4]
            best = dsp.best_sigmoids([groups[g] for g in enough])
            drawn = pa.concat_arrays(table.column("draws").chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            rows = []
            for i, (p, _) in sorted(best.items()):
                x, count, mean, _, top = groups[enough[i]]
                lo, hi, *_ = dsp.sigmoid_bounds(x, top)
                own = drawn[cuts[enough[i]] : cuts[enough[i]] + len(x)].T
                means = np.where(np.isnan(own), mean, own)  # a current that drew nothing keeps its trials as they are
                many = [np.repeat(a[None], n, 0) for a in (x, np.sqrt(count) / top, p, lo, hi)]
                got, cost = dsp.fit_sigmoids(many[0], means, *many[1:], rounds=40)
                ended = np.isfinite(cost)
                rows.append((cuts[enough[i]], float(p[1]), *np.percentile(got[ended, 1], [2.5, 97.5]).tolist(), float(ended.mean())))
            out = table.select(keys).take(pa.array([r[0] for r in rows], pa.int64()))
            for k, name in enumerate(("i50", "lo", "hi", "converged")):
                out = out.append_column(name, pa.array([r[k + 1] for r in rows], pa.float64()))
            yield from out.combine_chunks().to_batches()

    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "x")
    return dealt.mapInArrow(fit, f"{lead}, i50 double, lo double, hi double, converged double")


#: Fits that are sent to every task.
MOST_BROADCAST = 1000


def covariate_regression(df: DataFrame, keys: list[str], y: str, terms: list[str]) -> DataFrame:
    """Least squares of y on several terms with heteroscedasticity-robust (HC1) standard errors, per group.

    Two passes of sums: the normal equations, then the residual-weighted ones; tasks add products up, and only a matrix of
    (terms + 1) squared numbers for each group is solved. keys, term, estimate, se, lo, hi, n; groups that cannot be
    solved have no rows.
    """
    if not keys:
        return covariate_regression(df.withColumn("__all", F.lit(0)), ["__all"], y, terms).drop("__all")
    cols = ["__one", *terms]
    rows = df.dropna(subset=[y, *terms]).select(*keys, F.col(y).cast("double").alias(y), *[F.col(c).cast("double").alias(c) for c in terms])
    rows = rows.withColumn("__one", F.lit(1.0))
    products = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *products, *[F.sum(F.col(a) * F.col(y)).alias(f"v{i}") for i, a in enumerate(cols)])
    m = len(cols)
    shape = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                g = np.array([[r[f"g{i}_{j}"] for j in range(m)] for i in range(m)], float)
                if r["n"] <= m or np.linalg.matrix_rank(g) < m:
                    continue
                out.append((*[r[k] for k in keys], np.linalg.solve(g, [r[f"v{i}"] for i in range(m)]).tolist(), np.linalg.inv(g).ravel().tolist(), r["n"]))
            yield pd.DataFrame(out, columns=[*keys, "beta", "inverse", "n_rows"])

    solved = sums.mapInPandas(solve, shape + ", beta array<double>, inverse array<double>, n_rows long")
    # where groups are few their fits go to the rows: dealt by group, all rows would lie in as few tasks
    few = sums.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    fitted = rows.join(F.broadcast(solved) if few else solved, keys)
    residual = F.col(y) - sum((F.col("beta")[i] * F.col(c) for i, c in enumerate(cols)), F.lit(0.0))
    fitted = fitted.withColumn("__e2", residual * residual)
    meat = [F.sum(F.col("__e2") * F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]
    both = fitted.groupBy(*keys).agg(F.first("beta").alias("beta"), F.first("inverse").alias("inverse"), F.first("n_rows").alias("n"), *meat)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                inv = np.array(r["inverse"], float).reshape(m, m)
                mid = np.array([[r[f"m{i}_{j}"] for j in range(m)] for i in range(m)], float)
                se = np.sqrt(np.diag(inv @ mid @ inv) * r["n"] / (r["n"] - m))
                for i, name in enumerate(["intercept", *terms]):
                    b = float(r["beta"][i])
                    out.append((*[r[k] for k in keys], name, b, float(se[i]), b - 1.959964 * se[i], b + 1.959964 * se[i], int(r["n"])))
            yield pd.DataFrame(out, columns=[*keys, "term", "estimate", "se", "lo", "hi", "n"])

    return both.mapInPandas(spread, shape + ", term string, estimate double, se double, lo double, hi double, n long")

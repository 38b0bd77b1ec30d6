"""Session-level operators: selection of channels and runs, enrichment, comparisons, sweeps over settings, verdicts."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pairing import inside


def healthy_channels(df: DataFrame, ohms: str, limit: float = 1e6) -> DataFrame:
    """Rows of channels whose impedance is known and at most the limit."""
    return df.where(F.coalesce(F.col(ohms), F.lit(float("inf"))) <= limit)


def drop_open_channels(df: DataFrame, measured: DataFrame, channel: str, ohms: str, limit: float) -> DataFrame:
    """Rows without the channels that exceeded the limit in any run."""
    opened = measured.groupBy(channel).agg(F.max(ohms).alias("z")).where(F.col("z") > limit)
    return df.join(opened, channel, "left_anti")


def by_terms(df: DataFrame, name: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows whose name holds any of include (all where it is empty) and none of exclude, whatever the case."""
    low = F.lower(name)
    has = lambda terms: F.greatest(*[low.contains(t.lower()).cast("int") for t in terms], F.lit(0)) == 1
    keep = has(include) if include else F.lit(True)
    return df.where(keep & ~has(exclude)) if exclude else df.where(keep)


def slice_window(df: DataFrame, t: str, lo: int, hi: int) -> DataFrame:
    """Half-open: lo <= t < hi."""
    return df.where((F.col(t) >= lo) & (F.col(t) < hi))


def amplitude_mask(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Closed: low <= value <= high."""
    return df.where(F.col(value).between(low, high))


def contact_distance(channel: Column, stim: Column, pitch_um: float) -> Column:
    return F.abs(channel - stim) * pitch_um


def common_length(df: DataFrame, keys: list[str], side: str, order: list[str]) -> DataFrame:
    """Baseline and post rows of equal number per group: the baseline's end, the post window's start.

    side is base or post; order runs forward in time.
    """
    w = Window.partitionBy(*keys, side)
    n = F.least(F.count_if(F.col(side) == "base").over(Window.partitionBy(*keys)), F.count_if(F.col(side) == "post").over(Window.partitionBy(*keys)))
    placed = df.withColumn("__n", n).withColumn("__up", F.row_number().over(w.orderBy(*order))).withColumn("__total", F.count("*").over(w))
    keep = F.when(F.col(side) == "base", F.col("__up") > F.col("__total") - F.col("__n")).otherwise(F.col("__up") <= F.col("__n"))
    return placed.where(keep).drop("__n", "__up", "__total")


def within_epoch(df: DataFrame, keys: list[str], retained: Column, base: str, post: str) -> DataFrame:
    """Paired dB of retained trials per condition, with how many were left out."""
    db = F.when(retained & (F.col(base) > 0) & (F.col(post) > 0), 10 * F.log10(F.col(post) / F.col(base)))
    return df.withColumn("db", db).groupBy(*keys).agg(
        F.count("db").alias("n_pairs"), (F.count("*") - F.count("db")).alias("n_dropped"), F.percentile("db", 0.5).alias("median_db"), F.avg("db").alias("mean_db")
    )


def versus_reference(df: DataFrame, reference: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """dB of the mean of each group over the mean of as many reference rows, the first ones in order."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    placed = reference.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ref = placed.join(n.select(*keys, "n"), keys).where("rn <= n").groupBy(*keys).agg(F.avg(value).alias("ref_mean"), F.count("*").alias("n_ref"))
    both = n.join(ref, keys)
    return both.withColumn("db", F.when((F.col("mean") > 0) & (F.col("ref_mean") > 0), 10 * F.log10(F.col("mean") / F.col("ref_mean"))))


def noise_floor(df: DataFrame, keys: list[str], value: str, ohms: str) -> DataFrame:
    """Quantiles of a channel's noise and its median over the root of the impedance in kiloohms."""
    per = df.groupBy(*keys).agg(
        F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.75).alias("q75"), F.first(ohms, ignorenulls=True).alias("z")
    )
    return per.withColumn("per_root_kohm", F.when(F.col("z") > 0, F.col("median") / F.sqrt(F.col("z") / 1000))).drop("z")


def fraction(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_true")).withColumn("fraction", F.col("n_true") / F.col("n"))


@dataclass(frozen=True)
class Arm:
    """One arm of a sweep: the setting that varies, and what the others must be (0: off)."""

    name: str
    knob: str
    constant: dict[str, float]


#: The settings of a run, in Hz, and the arms of the bandwidth sweep (fixed values).
KNOBS = ("lower", "dsp", "upper")
ARMS = (
    Arm("A", "lower", {"dsp": 0.0, "upper": 7500.0}),
    Arm("B", "dsp", {"lower": 0.1, "upper": 7500.0}),
    Arm("C", "upper", {"lower": 1.0, "dsp": 0.0}),
)
#: Settings are the same within a factor of 1.25, replicates within one of 1.02.
SAME, REPLICATE = math.log(1.25), math.log(1.02)


def log_close(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two settings are the same within a factor exp(tolerance); off (not positive) is only like off."""
    off = (a <= 0) & (b <= 0)
    return F.when((a <= 0) | (b <= 0), off).otherwise(F.abs(F.ln(a / b)) <= tolerance)


def assign_arms(runs: DataFrame, arms: tuple[Arm, ...] = ARMS, tolerance: float = SAME) -> DataFrame:
    """Rows of runs once for each arm whose constants their settings meet: arm, knob (its name) and knob_value."""
    def entry(arm: Arm) -> Column:
        met = [log_close(F.col(k), F.lit(float(v)), tolerance) for k, v in arm.constant.items()]
        row = F.struct(F.lit(arm.name).alias("arm"), F.lit(arm.knob).alias("knob"), F.col(arm.knob).cast("double").alias("knob_value"))
        return F.when(reduce(lambda a, b: a & b, met, F.lit(True)), row)

    return runs.withColumn("__a", F.explode(F.array_compact(F.array(*map(entry, arms))))).select(*runs.columns, "__a.*")


def replicates(rows: DataFrame, run: str, tolerance: float = REPLICATE) -> DataFrame:
    """Rows of `assign_arms` with a letter for the runs of an arm whose settings are the same ('' where there is one only; a
    number beyond z).

    Along the distinct values of an arm a group goes on as long as a value is like the group's first one.
    """
    def step(acc: Column, x: Column) -> Column:
        return F.when(log_close(F.element_at(acc, -1), x, tolerance), acc).otherwise(F.array_append(acc, x))

    values = rows.groupBy("arm").agg(F.array_sort(F.collect_set("knob_value")).alias("v"))
    heads = values.select("arm", F.aggregate(F.slice("v", 2, 1 << 30), F.slice("v", 1, 1), step).alias("heads"))
    placed = rows.join(heads, "arm").withColumn("__head", F.array_max(F.filter("heads", lambda h: h <= F.col("knob_value"))))
    same = Window.partitionBy("arm", "__head")
    place = F.row_number().over(same.orderBy("knob_value", run))
    letter = F.when(F.count("*").over(same) > 1, F.when(place <= 26, F.char(F.lit(96) + place)).otherwise(place.cast("string")))
    return placed.withColumn("replicate", F.coalesce(letter, F.lit(""))).drop("heads", "__head")


def duplicates(rows: DataFrame, run: str, policy: str) -> DataFrame:
    """All rows (both), or of each arm's replicates only the first or last run; other runs stay."""
    if policy == "both":
        return rows
    pick = F.min if policy == "first" else F.max
    kept = pick(F.when(F.col("replicate") != "", F.col(run))).over(Window.partitionBy("arm"))
    return rows.withColumn("__kept", kept).where((F.col("replicate") == "") | (F.col(run) == F.col("__kept"))).drop("__kept")


def one_knob(rows: DataFrame, run: str, exact: list[str], knobs: tuple[str, ...] = KNOBS, tolerance: float = SAME) -> DataFrame:
    """Per arm: what differs from its first run though it should not (settings within a factor, others exactly; whether the
    filter is on may differ where one run has it off), and whether the arm's own setting varies."""
    w = Window.partitionBy("arm").orderBy(run).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = [*dict.fromkeys([*knobs, *exact])]
    firsts = rows.select("*", *[F.first(c).over(w).alias(f"__{c}") for c in names])
    differs = {k: (F.col("knob") != k) & ~log_close(F.col(k), F.col(f"__{k}"), tolerance) for k in knobs}
    for c in exact:
        other = ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        differs[c] = other & (F.col("knob") == "dsp") & (F.least("dsp", "__dsp") > 0) if c == "dsp_enabled" else other
    level = F.when(F.col("knob_value") > 0, F.round(F.ln("knob_value"), 3)).otherwise(-99.0)
    per = firsts.groupBy("arm").agg(
        F.count("*").alias("n_runs"),
        F.concat_ws("|", *[F.when(F.count_if(F.coalesce(d, F.lit(True))) > 0, F.lit(c)) for c, d in differs.items()]).alias("violations"),
        F.count_distinct(level).alias("n_levels"),
    )
    return per.withColumn("ok", (F.col("violations") == "") & (F.col("n_levels") > 1))


def single_valued(df: DataFrame, session: str, setting: str) -> DataFrame:
    """Sorted distinct values of a setting per session (as text) and whether there is one only."""
    per = df.groupBy(session).agg(F.array_sort(F.collect_set(F.round(setting, 6))).alias("v"))
    return per.select(session, F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("distinct_values"), (F.size("v") == 1).alias("single"))


def diagnosis(df: DataFrame, near: float = 0.2, spread: float = 20.0, collapse: float = 0.25, longer: float = 1.1) -> DataFrame:
    """What sets the recovery, from one row of evidence each: origin, and qualifiers joined by |.

    tau_ratio: fitted over the filter's time constant; same_sign: share of tails on the rail's side; f1, f2: recovery after
    the fitted tail is subtracted, after the filter is inverted, over the one before; amplitude_dev, impedance_dev,
    other_dev: largest deviation of a group's median from the pooled one in percent (null: no groups); current_shift,
    other_shift: percent over the observed range by regression; dead_shorter: whether recovery is shorter post mortem.
    Groups decide on invariance where there are any, else the regression does.

    Origins: filter (opposite sign, the filter's own tau whatever the condition, gone with the tail), mixed_condition (the
    same, but tau depends on the condition), mixed_biological (same sign, shorter post mortem), front_end (same sign
    otherwise), electrode (only impedance matters), mixed (the rest).
    """
    def most(*names: str) -> Column:
        return F.greatest(*[F.abs(n) for n in names])

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    invariant = sure(F.coalesce(most("amplitude_dev", "impedance_dev", "other_dev"), most("current_shift", "other_shift")) <= spread)
    of_filter, opposite = sure(F.abs(F.col("tau_ratio") - 1) <= near), F.col("same_sign") < 0.5
    depends = {
        "current": sure(F.abs("current_shift") > spread) | sure(F.col("amplitude_dev") > spread),
        "impedance": sure(F.col("impedance_dev") > spread),
        "filter_shortens": sure(F.col("f2") > longer),
    }
    same = F.when(sure(F.col("dead_shorter")), "mixed_biological").otherwise("front_end")
    by_tau = F.when(~invariant, "mixed_condition").when(sure(F.col("f1") <= collapse), "filter")
    rest = F.when(depends["impedance"] & ~depends["current"], "electrode").otherwise("mixed")
    origin = F.when(~opposite, same).otherwise(F.coalesce(F.when(of_filter, by_tau), rest))
    told = F.concat_ws("|", *[F.when(c, F.lit(k)) for k, c in depends.items()])
    return df.withColumns({
        "invariant": invariant, "tail_fraction": 1 - F.col("f1"), "dsp_fraction": 1 - F.col("f2"), "origin": origin,
        "qualifiers": F.when(origin == "front_end", told).otherwise(F.lit("")),
    })


def largest_deviation(df: DataFrame, keys: list[str], group: str, value: str, least: int = 10) -> DataFrame:
    """Largest deviation in percent of a group's median from that of all rows of the keys; groups of at least `least`."""
    pooled = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("all"))
    per = df.groupBy(*keys, group).agg(F.percentile(value, 0.5).alias("m"), F.count("*").alias("n")).where(F.col("n") >= least)
    both = per.join(pooled.where(F.col("all") > 0), keys)
    return both.groupBy(*keys).agg((100 * F.max(F.abs(F.col("m") / F.col("all") - 1))).alias("deviation"))


def exit_time(v: Column, threshold: float, exit_ms: Column, tau_ms: Column) -> Column:
    """Predicted recovery: leaving the rail, then the decay to the threshold; null when it starts below."""
    return F.when(v > threshold, exit_ms + tau_ms * F.ln(v / threshold))


def chunks(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Events split into parts of at most `most`."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("part", F.ceil(rn / most))


def rename_plan(df: DataFrame, name: str, target: str, tie: str) -> DataFrame:
    """What would be renamed to what: status, and __2, __3 ... behind names that several would take."""
    none = df.where(F.col(target).isNull()).withColumn("status", F.lit("skip")).withColumn("new_name", F.lit(None).cast("string"))
    place = F.row_number().over(Window.partitionBy(target).orderBy(tie))
    status = F.when(F.col(target) == F.col(name), "already_named").otherwise("rename")
    new = F.when(F.col("place") > 1, F.concat(F.col(target), F.lit("__"), F.col("place").cast("string"))).otherwise(F.col(target))
    some = df.where(F.col(target).isNotNull()).withColumn("place", place).withColumn("status", status).withColumn("new_name", new)
    return some.drop("place").unionByName(none)


def gap_free(epochs: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """Epochs (start, end; whole numbers) without a gap (gap_at) strictly inside."""
    spans = epochs.select(key, "start", "end", (F.col("start") + 1).alias("__lo")).distinct()
    holed = inside(spans, gaps.select(key, "gap_at").distinct(), key, "__lo", "end", "gap_at", how="left_semi")
    return epochs.join(holed.select(key, "start", "end"), [key, "start", "end"], "left_anti").select(*epochs.columns)


def diagnosis_runs(blocked: DataFrame) -> DataFrame:
    """Runs with blocks (see gating.blocks) and whether they serve a diagnosis: included ones of single pulses at least 0.3 s
    apart, without compliance faults; `left_out` says why not."""
    c = F.col
    single = (c("status") == "ok") & (c("n_detected") > 0) & c("block").isin("block1", "block2") & F.coalesce(c("ipi_s") >= 0.3, F.lit(True))
    keep = c("included") & ~c("compliance") & single
    why = (
        F.when(keep, "").when(c("exclusion_reason") != "", c("exclusion_reason")).when(c("n_detected") == 0, "no_stim")
        .when(~single, "paired_or_train").otherwise("excluded")
    )
    return blocked.withColumn("keep", keep).withColumn("left_out", why)


def polarity_override(df: DataFrame, amplitude: str, lead_sign: str, flags: str) -> DataFrame:
    """df with the amplitude's sign taken from the measured leading phase where that is known (not 0) and another one; flags
    tell of it."""
    other = F.coalesce((F.col(lead_sign) != 0) & (F.signum(amplitude) != F.col(lead_sign)), F.lit(False))
    told = F.concat_ws("|", F.when(F.col(flags) != "", F.col(flags)), F.lit("polarity_from_scope"))
    return df.withColumn(flags, F.when(other, told).otherwise(F.col(flags))).withColumn(
        amplitude, F.when(other, F.col(lead_sign) * F.abs(amplitude)).otherwise(F.col(amplitude))
    )


def recovery_table(df: DataFrame, keys: list[str], recovery: str, rail: str, censored: Column, drift: str) -> DataFrame:
    """Per condition (keys; a contact group or a synthetic family may be one): recovery's quartiles, median rail time, and the
    shares of censored, rail-free and drifting trials."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.percentile(recovery, p).alias(n) for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))],
        F.percentile(rail, 0.5).alias("median_rail"), F.count_if(censored).alias("n_censored"), share(censored).alias("censored"),
        share(F.col(rail) <= 0).alias("zero_rail"), share(F.abs(drift) > 25).alias("drifting"), F.percentile(F.abs(drift), 0.5).alias("median_drift"),
    )


def annotate_retained(frame: DataFrame, trials: DataFrame, keys: list[str], window: str) -> DataFrame:
    """frame with retained: in the early and late windows what the trials (unique by keys) say, false where there is no
    trial; true in all others."""
    known = trials.select(*keys, "retained_early", "retained_late")
    value = F.when(F.col(window) == "early", F.col("retained_early")).when(F.col(window) == "late", F.col("retained_late")).otherwise(True)
    return frame.join(known, keys, "left").withColumn("retained", F.coalesce(value, F.lit(False))).drop("retained_early", "retained_late")


def slice_bounds(runs: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """runs (n_samples, rate_hz) with the half-open sample range of a time window, clamped to the recording; runs that end
    before it starts have none, and `error` says so."""
    late = F.lit(start_s) >= F.col("n_samples") / F.col("rate_hz")
    lo = F.greatest(F.lit(0), F.floor(start_s * F.col("rate_hz"))).cast("long")
    hi = F.least(F.col("n_samples"), F.ceil(end_s * F.col("rate_hz"))).cast("long")
    return runs.select(
        *runs.columns, F.when(~late, lo).alias("lo"), F.when(~late, hi).alias("hi"),
        F.when(late, "starts after the recording ends").otherwise("").alias("error"),
    )

"""Pulse timing from an external capture: pulses in its trace, their phases, and the clock offset to the recording."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Capture:
    """Times in seconds: before the onset, and between active samples of one pulse; shares of the largest deviation, and
    robust deviations, that a pulse and the foot of its ramp reach; share of the labelled width that a pulse has; periods
    beyond the labelled one by this share are told."""

    pre: float = 5.0
    merge: float = 1.0
    high: float = 0.5
    high_sd: float = 6.0
    low: float = 0.05
    low_sd: float = 3.0
    least_width: float = 0.1
    period_off: float = 0.2


def windowed(samples: DataFrame, runs: DataFrame, c: Capture = Capture()) -> DataFrame:
    """The samples (run_id, epoch_s, lead) of each run's window; runs: run_id, onset_s, n_expected, width_s, interval_s."""
    until = F.col("onset_s") + F.col("n_expected") * (F.col("width_s") + F.col("interval_s")) * 1.5 + 10.0
    within = (F.col("epoch_s") >= F.col("onset_s") - c.pre) & (F.col("epoch_s") <= until)
    return samples.join(runs, "run_id").where(within)


def scope_pulses(samples: DataFrame, runs: DataFrame, c: Capture = Capture()) -> DataFrame:
    """run_id, pulse (from 0), edge_s, width_s of the pulses in each run's capture.

    A sample is active when it deviates from the run's median by a share of the near-largest deviation and by enough robust
    deviations. Active samples less than `merge` apart are one pulse, three at least. The trace ramps under a current step,
    so a pulse begins where the samples before it, without a gap, last rise from the low floor. Runs of fewer than ten
    samples have none.
    """
    own = Window.partitionBy("run_id")
    rows = windowed(samples, runs, c).withColumns({"centre": F.percentile("lead", 0.5).over(own), "n": F.count("*").over(own)})
    rows = rows.where("n >= 10").drop("n").withColumn("deviation", F.abs(F.col("lead") - F.col("centre")))
    # over the run's rows that are there: no join of them with what comes of them, each of which would sort both once more
    rows = rows.withColumns({"half": F.percentile("deviation", 0.5).over(own), "top": F.percentile("deviation", 0.995).over(own)})
    rows = rows.withColumn("sd", 1.4826 * F.percentile(F.abs(F.col("deviation") - F.col("half")), 0.5).over(own))
    high = F.greatest(c.high * F.col("top"), c.high_sd * F.col("sd"))
    low = F.greatest(c.low * F.col("top"), c.low_sd * F.col("sd"))
    by_time = Window.partitionBy("run_id").orderBy("epoch_s")
    gap = F.col("epoch_s") - F.lag("epoch_s").over(by_time)
    # a chain is what a walk back over neighbours above the low floor cannot leave
    cut = F.coalesce((gap >= c.merge) | ~F.lag("above").over(by_time), F.lit(True))
    rows = rows.withColumn("above", F.col("deviation") > low).withColumn("active", F.col("deviation") > high)
    rows = rows.withColumn("chain", F.sum(cut.cast("int")).over(by_time))
    rows = rows.withColumn("foot", F.min("epoch_s").over(Window.partitionBy("run_id", "chain")))
    active = rows.where("active")
    fresh = F.coalesce(F.col("epoch_s") - F.lag("epoch_s").over(by_time) > c.merge, F.lit(True))
    active = active.withColumn("part", F.sum(fresh.cast("int")).over(by_time))
    found = active.groupBy("run_id", "part").agg(
        F.count("*").alias("n"), F.min_by("foot", "epoch_s").alias("edge_s"), F.max("epoch_s").alias("last_s"), F.first("width_s").alias("labelled"),
    )
    found = found.withColumn("width_s", F.col("last_s") - F.col("edge_s")).where((F.col("n") >= 3) & (F.col("width_s") >= c.least_width * F.col("labelled")))
    # pulses on one ramp have the same edge
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("edge_s", "last_s")) - 1
    return found.select("run_id", place.alias("pulse"), "edge_s", "width_s")


def scope_summary(pulses: DataFrame, runs: DataFrame, c: Capture = Capture()) -> DataFrame:
    """run_id, n_pulses, period_s, issues of every run: count, period (what is measured counts, not the label)."""
    step = F.col("edge_s") - F.lag("edge_s").over(Window.partitionBy("run_id").orderBy("edge_s"))
    per = pulses.withColumn("step", step).groupBy("run_id").agg(F.count("*").alias("n"), F.percentile("step", 0.5).alias("period_s"))
    labelled = F.col("width_s") + F.col("interval_s")
    off = (labelled > 0) & (F.abs(F.col("period_s") - labelled) > c.period_off * labelled)
    told = runs.join(per, "run_id", "left").withColumn("n_pulses", F.coalesce("n", F.lit(0)))
    issues = F.concat_ws("|", F.when(F.col("n_pulses") == 0, "no_pulses").when(F.col("n_pulses") != F.col("n_expected"), "count_differs"), F.when(off, "period_differs"))
    return told.select("run_id", "n_pulses", "period_s", issues.alias("issues"))


@dataclass(frozen=True)
class Phases:
    """Fixed values of the analysis of a pulse, times in seconds: the grid and how many of its points are averaged; how far
    a pulse is looked at before its edge and behind it (at least, and in labelled widths); how early its first extreme may
    lie and how late its second phase may end; the share of the near-steepest slope that a phase has."""

    grid: float = 0.005
    smooth: int = 9
    before: float = 0.3
    behind: float = 1.5
    widths: float = 6.0
    slack: float = 0.05
    steep: float = 0.35


def pulse_phases(samples: DataFrame, runs: DataFrame, pulses: DataFrame, c: Capture = Capture(), p: Phases = Phases()) -> DataFrame:
    """run_id, pulse, lead (1: the positive phase comes first), phase1_s, gap_s, phase2_s, envelope_s of each pulse.

    The trace is a voltage: a current step is a ramp, so phases are told by its extremes and by the last span of opposite
    slope before the second one. Each pulse's samples are put on the run's even grid, smoothed and differentiated; a group
    is one pulse. Pulses whose first extreme lies before the edge have no row.
    """
    span, margin = F.greatest(F.lit(p.behind), p.widths * F.col("labelled")), 100 * p.grid
    begin = windowed(samples, runs, c).groupBy("run_id").agg(F.min("epoch_s").alias("origin"), F.first("width_s").alias("labelled"))
    about = pulses.join(begin, "run_id").withColumn("from", F.col("edge_s") - p.before - margin).withColumn("to", F.col("edge_s") + span + margin)
    own = windowed(samples, runs, c).select("run_id", "epoch_s", "lead").join(about, "run_id")
    own = own.where((F.col("epoch_s") >= F.col("from")) & (F.col("epoch_s") <= F.col("to")))
    own = own.groupBy("run_id", "pulse", "edge_s", "origin", span.alias("span")).agg(F.array_sort(F.collect_list(F.struct("epoch_s", "lead"))).alias("x"))
    names = ("lead", "phase1_s", "gap_s", "phase2_s", "envelope_s")

    def segment(batches):
        for batch in batches:
            found: list[tuple] = []
            for k, row in enumerate(batch.select(["edge_s", "origin", "span", "x"]).to_pylist()):
                trace = np.array([(r["epoch_s"], r["lead"]) for r in row["x"]]).T
                told = phases_of(*trace, row["edge_s"], row["origin"], row["span"], p)
                found += [(k, *told)] if told else []
            kept = batch.select(["run_id", "pulse"]).take(pa.array([f[0] for f in found], pa.int64()))
            kinds = [pa.int32(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([f[i + 1] for f in found], t) for i, t in enumerate(kinds))], ["run_id", "pulse", *names])

    kind = pulses.schema["pulse"].dataType.simpleString()
    run = pulses.schema["run_id"].dataType.simpleString()
    return own.mapInArrow(segment, f"run_id {run}, pulse {kind}, lead int, phase1_s double, gap_s double, phase2_s double, envelope_s double")


def phases_of(times, trace, edge: float, origin: float, span: float, p: Phases) -> tuple | None:
    """lead, phase1, gap, phase2, envelope of one pulse; None where nothing can be told."""
    if len(times) < 4:
        return None
    steps = np.arange(int(np.ceil((times[0] - origin) / p.grid)), int((times[-1] - origin) / p.grid) + 1)
    rim = p.smooth // 2 + 1  # what smoothing sees only half of is left out
    if len(steps) < 2 * rim + 3:
        return None
    even = origin + p.grid * steps
    level = np.convolve(np.interp(even, times, trace), np.full(p.smooth, 1 / p.smooth), mode="same")[rim:-rim]
    even = even[rim:-rim] - edge  # from here on seconds behind the edge
    slope = np.gradient(level, even)
    seen = (even >= -p.before) & (even <= span)
    if not seen.any():
        return None
    quiet = level[seen & (even < 0)]
    height = level[seen] - (np.median(quiet) if len(quiet) else level[seen][0])
    even, slope = even[seen], slope[seen]
    extremes = {1: float(even[height.argmax()]), -1: float(even[height.argmin()])}
    lead = 1 if extremes[1] < extremes[-1] else -1
    first, second = sorted(extremes.values())
    if first <= -p.slack:
        return None
    back = -lead * slope > p.steep * np.percentile(np.abs(slope), 99)
    turned = even[back & (even > first) & (even <= second + p.slack)]
    turn = float(turned[0]) if len(turned) else None
    return lead, first, None if turn is None else turn - first, None if turn is None else second - turn, second


def phase_summary(phases: DataFrame) -> DataFrame:
    """run_id, lead (the majority's, 0 for a tie) and the medians of its pulses."""
    middle = [F.percentile(c, 0.5).alias(c) for c in ("phase1_s", "gap_s", "phase2_s", "envelope_s")]
    return phases.groupBy("run_id").agg(F.sign(F.sum("lead")).cast("int").alias("lead"), *middle)


def clock_offsets(
    envelope: DataFrame, pulses: DataFrame, bin_s: float, window_s: float = 5.0, edge_s: float = 0.1, around_s: Column | float = 0.5,
    least_z: float = 3.0,
) -> DataFrame:
    """run_id, delta_s, z, aligned: the offset that puts a run's pulses (run_id, start_s, seconds from the recording's
    start by another clock) onto the rises of its envelope (run_id, bin, z).

    Each offset of -window_s .. window_s, a bin apart, scores the mean contrast at its pulses: the mean of the envelope
    from 0.2 to 1.8 edge_s behind an edge less the one as far before it. These means are sums over rows of bins, computed
    once; pulses meet them by bin. z compares the best score with those more than around_s away from it. Runs of whose
    scores fewer than ten are that far away, or that are flat there, have no z and are not aligned.
    """
    inner = max(1, round(0.2 * edge_s / bin_s))
    outer = max(inner + 1, round(1.8 * edge_s / bin_s))
    offsets = int(np.ceil((2 * window_s + bin_s) / bin_s - 1e-9))
    w = Window.partitionBy("run_id").orderBy("bin")
    whole = Window.partitionBy("run_id")
    after, before = F.avg("z").over(w.rowsBetween(inner, outer - 1)), F.avg("z").over(w.rowsBetween(-outer, -inner - 1))
    inside = (F.col("place") >= outer) & (F.col("place") + outer < F.col("n"))
    bins = envelope.withColumn("place", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole))
    bins = bins.withColumn("contrast", after - before).where(inside).select("run_id", F.col("place").alias("at"), "contrast")
    first = F.bround((F.col("start_s") - window_s) / bin_s).cast("long")
    tried = pulses.select("run_id", first.alias("first"), F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))).alias("k"))
    tried = tried.select("run_id", "k", (F.col("first") + F.col("k")).alias("at"))
    met = tried.join(bins, ["run_id", "at"]).groupBy("run_id", "k").agg(F.avg("contrast").alias("score"))
    every = pulses.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))).alias("k"))
    scores = every.join(met, ["run_id", "k"], "left").select("run_id", "k", F.coalesce("score", F.lit(0.0)).alias("score"))
    best = scores.groupBy("run_id").agg(F.max(F.struct("score", -F.col("k"))).alias("b")).select("run_id", F.col("b.score").alias("top"), (-F.col("b.col2")).alias("best"))
    far = scores.join(best, "run_id").where(F.abs(F.col("k") - F.col("best")) * bin_s > around_s)
    rest = far.groupBy("run_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    z = F.when((F.col("n") >= 10) & (F.col("sd") > 0), (F.col("top") - F.col("mean")) / F.col("sd"))
    told = best.join(rest, "run_id", "left").select("run_id", (F.col("best") * bin_s - window_s).alias("delta_s"), z.alias("z"))
    return told.withColumn("aligned", F.coalesce(F.col("z") >= least_z, F.lit(False)))


def aligned_onsets(pulses: DataFrame, offsets: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, pulse, onset_s of the pulses inside the recording, by the offset of aligned runs; runs: run_id, duration_s."""
    moved = pulses.join(offsets.where("aligned"), "run_id").join(runs, "run_id")
    onset = F.col("start_s") + F.col("delta_s")
    return moved.where((onset >= 0) & (onset < F.col("duration_s"))).select("run_id", "pulse", onset.alias("onset_s"))

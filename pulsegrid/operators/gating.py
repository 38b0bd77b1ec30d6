"""Gating: event summaries, validation, blocks, condition windows and retention of trials."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pairing import inside
from .sequence import islands


def argmax_channel(df: DataFrame, run: list[str], channel: str, flag: Column) -> DataFrame:
    """Per run the channel with most flagged samples (ties: the first) and the first one with any."""
    counts = df.groupBy(*run, channel).agg(F.count_if(flag).alias("n"))
    return counts.groupBy(*run).agg(
        F.max_by(channel, F.struct("n", -F.col(channel))).alias("most_channel"),
        F.min(F.when(F.col("n") > 0, F.col(channel))).alias("first_channel"),
        F.max("n").alias("most_n"),
    )


def modal(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The commonest value of each group, of equals the first seen in the order of tie."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(tie).alias("seen"))
    best = F.max_by(value, F.struct("n", -F.col("seen")))
    return counts.groupBy(*keys).agg(best.alias("mode"), F.max("n").alias("n_mode"))


@dataclass(frozen=True)
class Gates:
    """What gates trials and conditions; times in milliseconds. The defaults are fixed values of the analysis."""

    quantile: float = 0.9
    margin: float = 5.0
    epoch_end: float = 900.0
    post_length: float = 300.0
    post_start_max: float = 300.0
    early: float = 50.0
    late_start: float = 400.0
    min_trials: int = 20


def condition_windows(
    trials: DataFrame, keys: list[str], recovery: str, censored: Column, dirty: Column, floor: Column, gates: Gates = Gates()
) -> DataFrame:
    """Per condition: counts, quantiles of all recoveries, the window behind the artifact and a verdict.

    The window starts behind the chosen quantile and its margin, not before the hardware floor (a column that is constant
    in a condition) and not behind the epoch's end. early_ok: the window starts soon enough, enough trials are blanked
    before it, and the median is early; late_only: the late window is free in enough trials; unusable otherwise.
    """
    per = trials.groupBy(*keys).agg(
        F.count("*").alias("n_trials"), F.count_if(censored).alias("n_censored"), F.count_if(dirty).alias("n_contaminated"),
        *[F.percentile(recovery, p).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75, 0.9)],
        F.percentile(recovery, gates.quantile).alias("recovery_q"), F.max(recovery).alias("recovery_max"), F.max(floor).alias("floor"),
    )
    behind = F.col("recovery_q") + gates.margin
    start = F.when(F.col("recovery_q").isNotNull(), F.least(F.greatest(behind, F.col("floor")), F.lit(gates.epoch_end)))
    per = per.withColumn("post_start", start).withColumn(
        "post_end", F.when(F.col("post_start").isNotNull(), F.least(F.col("post_start") + gates.post_length, F.lit(gates.epoch_end)))
    )
    kept = retained(trials, per, keys, recovery, censored, dirty, gates).groupBy(*keys).agg(
        F.count_if("retained_early").alias("n_retained_early"), F.count_if("retained_late").alias("n_retained_late")
    )
    early = (
        (F.col("post_start") <= gates.post_start_max)
        & (F.col("post_end") > F.col("post_start"))
        & (F.col("n_retained_early") >= gates.min_trials)
        & (F.col("p50") <= gates.early)
    )
    late = (behind < gates.late_start) & (F.col("n_retained_late") >= gates.min_trials)
    verdict = F.when(early, "early_ok").when(late, "late_only").otherwise("unusable")
    return per.join(kept, keys).withColumn("verdict", verdict)


def retained(
    trials: DataFrame, windows: DataFrame, keys: list[str], recovery: str, censored: Column, dirty: Column, gates: Gates = Gates()
) -> DataFrame:
    """trials with retained_early, retained_late and the first reason that applies for a rejection.

    A trial is blanked up to its recovery and the margin; one whose condition has no window is rejected for its recovery.
    """
    joined = trials.join(windows.select(*keys, "post_start"), keys, "left")
    clean, blank_end = ~censored & ~dirty, F.col(recovery) + gates.margin
    early = clean & F.coalesce(blank_end <= F.col("post_start"), F.lit(False))
    reason = F.when(censored, "censored").when(dirty, "baseline_contaminated").when(early, "").otherwise("recovery_after_post_start")
    return joined.select(
        *trials.columns,
        early.alias("retained_early"),
        (clean & F.coalesce(blank_end < gates.late_start, F.lit(False))).alias("retained_late"),
        reason.alias("reject_reason"),
    )


def event_summary(
    samples: DataFrame, pulses: DataFrame, key: str, compliance_tail: int, settle_tail: int, tick: float = 1.0
) -> DataFrame:
    """Per pulse (start, exclusive end): largest magnitude, sign and length of the first phase (in ticks), whether the
    compliance flag is set up to compliance_tail behind the end, and the end of the last settle flag up to settle_tail
    behind the start (-1: none). samples: key, t, amplitude, compliance, settle.
    """
    stop = F.greatest(F.col("end") + compliance_tail, F.col("start") + settle_tail)
    found = inside(pulses.withColumn("__stop", stop), samples, key, "start", "__stop", "t")
    within, t = F.col("t") < F.col("end"), F.col("t")
    sign = F.signum("amplitude")
    first = found.groupBy(key, "start", "end").agg(
        F.count(F.when(within, 1)).alias("n_samples"),
        F.max(F.when(within, F.abs("amplitude"))).alias("max_amplitude"),
        F.min_by(F.when(within, sign), F.when(within, t)).alias("first_sign"),
        F.min(F.when(within & (sign > 0), t)).alias("up"), F.min(F.when(within & (sign < 0), t)).alias("down"),
        F.min(F.when(within & (sign == 0), t)).alias("rest"),
        F.coalesce(F.bool_or(F.col("compliance") & (t < F.col("end") + compliance_tail)), F.lit(False)).alias("compliance"),
        F.max(F.when(F.col("settle") & (t < F.col("start") + settle_tail), t)).alias("settled"),
    )
    # the first phase ends where another sign begins
    other = F.least(F.when(F.col("first_sign") > 0, F.col("down")).otherwise(F.col("up")), F.col("rest"), F.col("end"))
    phase = F.when(F.col("first_sign") == 0, 0.0).otherwise((other - F.col("start")) * tick)
    return first.select(
        key, "start", "end", "n_samples", "max_amplitude", F.col("first_sign").cast("int").alias("first_sign"),
        phase.alias("first_phase"), "compliance", F.coalesce(F.col("settled") + 1, F.lit(-1)).alias("settle_end"),
    )


def hardware_floor(df: DataFrame, keys: list[str], width: str, settle: str, fallback: Column, least: float) -> DataFrame:
    """max(least, median pulse width, median settle time or the settings' one)."""
    settled = F.coalesce(F.percentile(settle, 0.5), F.first(fallback))
    return df.groupBy(*keys).agg(F.greatest(F.lit(least), F.percentile(width, 0.5), settled).alias("floor"))


def _named(*reasons: tuple[str, Column]) -> Column:
    """The names of the conditions that hold, in order, joined by |."""
    return F.concat_ws("|", *[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons])


def validation(runs: DataFrame) -> DataFrame:
    """runs with status, commanded pulses, checks of the count, charge, and what does not fit, named in `warnings`.

    runs: error, has_settings, settings_rate, rate, n_detected, n_trains, pulses_per_trigger, folder_pulses, amplitude,
    phase (both measured), first_sign, compliance_bit, gaps, amplitude_settings, amplitude_folder, phase_settings,
    phase_folder, polarity_settings, step, impedance_missing. The measured values count; others only give warnings.
    """
    c = F.col
    ok = c("error").isNull() & (c("n_detected") > 0)
    status = F.when(c("error").isNotNull(), "error").when(c("n_detected") > 0, "ok").otherwise("no_stim")
    by_settings = c("has_settings") & (F.coalesce(c("pulses_per_trigger"), F.lit(0)) > 0)
    commanded = F.when(ok & by_settings, c("pulses_per_trigger") * F.greatest(c("n_trains"), F.lit(1))).when(ok, c("folder_pulses"))
    checked = runs.withColumn("status", status).withColumn("n_commanded", commanded.cast("double"))
    few = c("n_detected") < c("n_commanded")
    flag = F.when(ok, c("compliance_bit") | F.coalesce(few, F.lit(False))).otherwise(False)
    step, wide = F.coalesce(c("step"), F.lit(2.0)), 1.5e6 / c("rate")
    expected = F.when(F.lower("polarity_settings").startswith("negative"), -1).when(c("polarity_settings") != "", 1)
    live = c("error").isNull()
    warnings = _named(
        ("no_settings", live & ~c("has_settings")),
        ("rate_differs", live & c("has_settings") & (c("settings_rate") > 0) & (F.abs(c("settings_rate") - c("rate")) > 0.5)),
        ("count_from_folder", ok & ~by_settings & c("folder_pulses").isNotNull()),
        ("fewer_than_commanded", ok & few), ("more_than_commanded", ok & (c("n_detected") > c("n_commanded"))),
        ("amplitude_settings", ok & (F.abs(c("amplitude_settings") - c("amplitude")) > step)),
        ("amplitude_folder", ok & (F.abs(c("amplitude_folder") - c("amplitude")) > step)),
        ("phase_settings", ok & (F.abs(c("phase_settings") - c("phase")) > wide)),
        ("phase_folder", ok & (F.abs(c("phase_folder") - c("phase")) > wide)),
        ("polarity", ok & (c("first_sign") != 0) & (expected != c("first_sign"))),
        ("gaps", live & (c("gaps") > 0)), ("no_impedance", live & c("impedance_missing")),
    )
    return (
        checked.withColumn("count_match", F.when(c("n_commanded").isNotNull(), c("n_commanded") == c("n_detected")))
        .withColumn("compliance", flag)
        .withColumn("charge_nc", F.when(ok, c("amplitude") * c("phase") * 1e-3))
        .withColumn("warnings", warnings)
    )


def with_rails(checked: DataFrame, rails: DataFrame) -> DataFrame:
    """checked (as from `validation`) with rail_percent (the largest of the run's channels, 0 without any), n_railed, and
    flat:NAME for every constant channel in warnings. rails: run_id, channel, percent, railed, flat, as from `rails`."""
    per = rails.groupBy("run_id").agg(
        F.max("percent").alias("rail_percent"), F.count_if("railed").alias("n_railed"),
        F.array_sort(F.collect_list(F.when(F.col("flat"), F.concat(F.lit("flat:"), F.col("channel").cast("string"))))).alias("__flat"),
    )
    told = F.concat_ws("|", F.when(F.col("warnings") != "", F.col("warnings")), F.array_join("__flat", "|"))
    told = F.when(F.size("__flat") > 0, told).otherwise(F.col("warnings"))
    joined = checked.join(per, "run_id", "left").withColumn("warnings", told).drop("__flat")
    return joined.fillna({"rail_percent": 0.0, "n_railed": 0})


def paired_pulses() -> Column:
    """Runs of pulse pairs: commanded as such within 200 ms, or found less than 200 ms apart."""
    told = F.coalesce((F.col("pulses_per_trigger") <= 2) & (F.col("train_period_ms") <= 200), F.lit(False))
    return (F.col("n_detected") >= 2) & (told | F.coalesce(F.col("ipi_s") < 0.2, F.lit(False)))


def blocks(runs: DataFrame, session: str) -> DataFrame:
    """Validated runs (run_id, manifest_block, manifest_include, train_period_ms, ipi_s beside `validation`'s columns) with
    block, in_block1 to 3, included and exclusion_reason.

    Of the runs with single pulses, those within 10 us of the modal phase (rounded to 10 us) are block1, others block2;
    block1 runs within 2 uA of block2's modal amplitude (rounded) are in block2 as well. Of equally common values the one
    seen first by run_id counts. A manifest's block replaces that; its include decides over all reasons.
    """
    c = F.col
    marked = runs.withColumn("__pair", paired_pulses())
    single = (c("status") == "ok") & ~c("__pair") & c("phase").isNotNull()
    phases = modal(marked.where(single).withColumn("__p", F.bround(c("phase") / 10) * 10), [session], "__p", "run_id")
    marked = marked.join(phases.select(session, c("mode").alias("__phase")), session, "left")
    ladder = F.coalesce(single & (F.abs(c("phase") - c("__phase")) <= 10), F.lit(False))
    marked = marked.withColumn("__ladder", ladder).withColumn("__sweep", F.coalesce(single, F.lit(False)) & ~ladder)
    amps = modal(marked.where("__sweep").withColumn("__a", F.bround("amplitude")), [session], "__a", "run_id")
    marked = marked.join(amps.select(session, c("mode").alias("__amp")), session, "left")
    also = c("__ladder") & F.coalesce(F.abs(F.bround("amplitude") - c("__amp")) <= 2, F.lit(False))
    block = (
        F.when(c("status") == "error", "error").when((c("status") == "no_stim") | (c("n_detected") == 0), "baseline")
        .when(c("__pair"), "block3").when(c("__ladder"), "block1").when(c("__sweep"), "block2").otherwise("other")
    )
    named = F.lower(F.trim(F.coalesce("manifest_block", F.lit(""))))
    found = marked.withColumn("block", F.when(named != "", named).otherwise(block))
    found = (
        found.withColumn("in_block1", c("block").contains("block1"))
        .withColumn("in_block2", c("block").contains("block2") | ((named == "") & also))
        .withColumn("in_block3", c("block") == "block3")
    )
    include = F.lower(F.trim(F.coalesce("manifest_include", F.lit(""))))
    reasons = _named(
        ("error", c("status") == "error"), ("block3", c("block") == "block3"), ("compliance", c("compliance")),
        ("count_mismatch", ~c("compliance") & (c("status") == "ok") & ~c("count_match")),
        ("manifest", include.isin("0", "false", "no", "exclude")),
    )
    found = found.withColumn("exclusion_reason", F.when(include.isin("1", "true", "yes", "include"), "").otherwise(reasons))
    kept = (c("exclusion_reason") == "") & c("status").isin("ok", "no_stim")
    return found.withColumn("included", kept).drop("__pair", "__phase", "__ladder", "__sweep", "__amp")


def stim_channel(counts: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """Per run the stimulation channel and what disagrees with it.

    counts: run, channel, n_nonzero; runs: run, configured, settings_channel, settings_channels (how many), folder_channel.
    The configured channel counts where it is recorded, else the one with most nonzero samples (ties: the first by name).
    """
    c = F.col
    most = counts.where("n_nonzero > 0").groupBy(run).agg(F.min_by("channel", F.struct(-c("n_nonzero"), "channel")).alias("detected"))
    known = counts.select(run, c("channel").alias("configured"), F.lit(True).alias("recorded")).distinct()
    both = runs.join(most, run, "left").join(known, [run, "configured"], "left")
    wanted = c("configured").isNotNull() & F.coalesce("recorded", F.lit(False))
    both = both.withColumn("choice", F.when(wanted, c("configured")).otherwise(c("detected")))
    warnings = _named(
        ("configured_not_recorded", c("configured").isNotNull() & c("recorded").isNull()),
        ("configured_differs", wanted & (c("detected") != c("configured"))),
        ("settings_differ", c("settings_channel") != c("choice")), ("several_in_settings", c("settings_channels") > 1),
        ("folder_differs", c("folder_channel") != c("choice")),
    )
    return both.select(run, "detected", "choice", warnings.alias("warnings"))


def baseline_choice(runs: DataFrame, session: str, named: Column, recording: Column, baseline: Column) -> DataFrame:
    """Per session the named run, else a baseline labelled as recording, else any baseline; the smallest run_id of equals."""
    rank = F.when(named, 0).when(baseline & recording, 1).when(baseline, 2)
    return (
        runs.withColumn("rank", rank)
        .where(F.col("rank").isNotNull())
        .groupBy(session)
        .agg(F.min_by("run_id", F.struct("rank", "run_id")).alias("baseline_run"))
    )


def override(base: DataFrame, manifest: DataFrame, key: str, value: str) -> DataFrame:
    """base with value taken from the manifest where it has one; manifest keys are unique."""
    over = manifest.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return base.join(over, F.col(key) == F.col("__k"), "left").withColumn(value, F.coalesce("__v", value)).drop("__k", "__v")


def rails(
    df: DataFrame, keys: list[str], order: list[str], value: str, tolerance: float, least: int, full_scale: float, tick: float = 1.0
) -> DataFrame:
    """Per channel what its extremes say of saturation: samples within tolerance of the largest or smallest value, in runs
    of at least `least`, are railed. Levels are null on a side without such a run; a constant channel is flat, not railed.
    """
    w = Window.partitionBy(*keys)
    levelled = df.withColumn("__top", F.max(value).over(w)).withColumn("__low", F.min(value).over(w))
    near = {"pos": F.col(value) >= F.col("__top") - tolerance, "neg": F.col(value) <= F.col("__low") + tolerance}
    sides = []
    for side, flag in near.items():
        runs = islands(levelled, keys, order, flag).groupBy(*keys).agg(
            F.max("length").alias(f"{side}_longest"), F.count_if(F.col("length") >= least).alias(f"{side}_n"),
            F.coalesce(F.sum(F.when(F.col("length") >= least, F.col("length"))), F.lit(0)).alias(f"{side}_railed"),
        )
        sides.append(runs)
    total = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(value).alias("top"), F.min(value).alias("low"))
    both = total.join(sides[0], keys).join(sides[1], keys)
    up, down, flat = F.col("pos_n") > 0, F.col("neg_n") > 0, F.col("top") == F.col("low")
    return both.select(
        *keys, F.when(up, F.col("top")).alias("pos_level"), F.when(down, F.col("low")).alias("neg_level"),
        (F.col("pos_longest") * tick).alias("pos_longest"), (F.col("neg_longest") * tick).alias("neg_longest"),
        (F.col("pos_n") + F.col("neg_n")).alias("n_episodes"),
        (100.0 * (F.col("pos_railed") + F.col("neg_railed")) / F.col("n")).alias("percent"),
        ((up | down) & ~flat).alias("railed"), flat.alias("flat"),
        ((up & (F.col("top") >= 0.98 * full_scale)) | (down & (-F.col("low") >= 0.98 * full_scale))).alias("at_full_scale"),
    )

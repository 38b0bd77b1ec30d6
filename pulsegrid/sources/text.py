"""Text sources of a session: settings files, impedance tables, manifests and captures of a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settings(spark: SparkSession, path: str) -> DataFrame:
    """One row a settings.xml: run_id, the first stimulating channel and its values, how many there are, and the recording's
    own settings; unreadable files give nulls. A setting is looked for in the general section first, then at the root."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    good = F.when(F.col("value").rlike(r"^\s*<") & F.col("value").rlike(r">\s*$"), F.col("value"))

    def at(xpath: str) -> Column:
        hit = F.xpath_string(good, F.lit(xpath))
        return F.when(hit != "", hit)

    def general(name: str) -> Column:
        return F.coalesce(at(f"//GeneralConfig/@{name}"), at(f"/*/@{name}"))

    on = "//*[@StimEnabled='True' or @StimEnabled='true' or @StimEnabled='1']"
    first = f"({on})[1]"
    yes = lambda c: F.lower(c).isin("true", "1", "yes")
    return raw.select(
        F.element_at(F.split("file", "/"), -2).alias("run_id"),
        at(f"{first}/@NativeChannelName").alias("stim_channel"),
        F.xpath_int(good, F.lit(f"count({on})")).alias("n_stim_channels"),
        at(f"{first}/@FirstPhaseAmplitudeMicroAmps").cast("double").alias("amplitude_ua"),
        at(f"{first}/@FirstPhaseDurationMicroseconds").cast("double").alias("phase_us"),
        at(f"{first}/@NumberOfStimPulses").cast("long").alias("n_pulses"),
        at(f"{first}/@Polarity").alias("polarity"), at(f"{first}/@PulseOrTrain").alias("pulse_or_train"),
        at(f"{first}/@PulseTrainPeriodMicroseconds").cast("double").alias("train_period_us"),
        yes(at(f"{first}/@EnableAmpSettle")).alias("amp_settle"), at(f"{first}/@PostStimAmpSettleMicroseconds").cast("double").alias("post_settle_us"),
        yes(at(f"{first}/@EnableChargeRecovery")).alias("charge_recovery"),
        general("StimStepSizeMicroAmps").cast("double").alias("step_ua"), general("SampleRateHertz").cast("double").alias("sample_rate_hz"),
    )


def spike_times(spark: SparkSession, path: str) -> DataFrame:
    """file, t: the numbers of ASCII files of spike times, one a line; other lines go."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.expr("try_cast(trim(value) as double)").alias("t"))
    return rows.where(F.col("t").isNotNull())


def impedances(spark: SparkSession, path: str) -> DataFrame:
    """channel, ohms, degrees of a CSV whose header names channel, magnitude and phase in its own words."""
    df = spark.read.csv(path, header=True)

    def named(*words: str) -> Column:
        for c in df.columns:
            if any(w in c.lower() for w in words):
                return F.col(f"`{c}`")
        return F.lit(None)

    return df.select(
        F.trim(named("channel name", "channel number", "channel")).alias("channel"),
        named("magnitude").cast("double").alias("ohms"), named("phase").cast("double").alias("degrees"),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """run_id, block, include of a manifest CSV; include is true where it is left out."""
    df = spark.read.csv(path, header=True)
    include = F.lower(F.trim("include")).isin("1", "true", "yes") if "include" in df.columns else F.lit(True)
    return df.select(F.trim("run_id").alias("run_id"), F.trim("block").alias("block"), F.coalesce(include, F.lit(True)).alias("include"))


def onset(spark: SparkSession, path: str) -> DataFrame:
    """file, onset_s: the first pulse_onset_epoch_s= of key=value files."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    hit = F.regexp_extract("value", r"pulse_onset_epoch_s\s*=\s*([0-9.eE+-]+)", 1)
    return raw.select("file", F.when(hit != "", hit).cast("double").alias("onset_s"))

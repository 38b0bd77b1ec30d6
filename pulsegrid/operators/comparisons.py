"""Secondary comparisons of trials: across amplitude, by charge, over distance, drift, and how much was delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .resampling import median_intervals, spearman_intervals
from .summaries import first_vs_last


def across_amplitude(trials: DataFrame, keys: list[str], amplitude: str, value: str, about: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """keys, amplitude, n, median, lo, hi and the columns of about (the smallest of each) for each level of amplitude."""
    told = trials.groupBy(*keys, amplitude).agg(*[F.min(c).alias(c) for c in about])
    return median_intervals(trials, [*keys, amplitude], value, n, seed=seed).join(told, [*keys, amplitude])


def charge_dependence(trials: DataFrame, runs: DataFrame, keys: list[str], value: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """keys (run_id among them), n, median, lo, hi, amplitude, phase, charge_nc (amplitude in uA times phase in us) of the
    trials of each run; runs: run_id, amplitude, phase."""
    per = median_intervals(trials, keys, value, n, seed=seed)
    return per.join(runs.select("run_id", "amplitude", "phase"), "run_id").withColumn("charge_nc", F.col("amplitude") * F.col("phase") * 1e-3)


def spatial_decay(across: DataFrame, keys: list[str], distance: str, row_id: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """across (as from `across_amplitude`) with the rank correlation of the medians with distance in each group and its
    interval; null for groups of fewer than three places."""
    found = spearman_intervals(across, keys, distance, "median", row_id, n, seed)
    return across.join(found.select(*keys, "rho", F.col("lo").alias("rho_lo"), F.col("hi").alias("rho_hi")), keys, "left")


def drift(trials: DataFrame, keys: list[str], order: list[str], value: str, n: int, window: str = "window") -> DataFrame:
    """keys, window and first against last n trials: of the early window where a group has any there, else of the late one."""
    early = F.max(F.col(window) == "early").over(Window.partitionBy(*keys))
    chosen = trials.withColumn("__early", early).where(F.col(window) == F.when(F.col("__early"), "early").otherwise("late"))
    return first_vs_last(chosen, [*keys, window], order, value, n)


def delivered(runs: DataFrame) -> DataFrame:
    """run_id, n_commanded, n_detected, compliance, delivered_fraction of runs with pulses, as from gating.validation."""
    share = F.when(F.col("n_commanded") > 0, F.col("n_detected") / F.col("n_commanded"))
    return runs.where(F.col("n_detected") > 0).select("run_id", "n_commanded", "n_detected", "compliance", share.alias("delivered_fraction"))


def as_json(df: DataFrame, *columns: str) -> Column:
    """A JSON text of the columns, nulls included; NaN and infinite numbers are null."""
    kinds = dict(df.dtypes)

    def clean(c: str) -> Column:
        if kinds[c] not in ("double", "float"):
            return F.col(f"`{c}`").alias(c)
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(f"`{c}`")).alias(c)

    return F.to_json(F.struct(*[clean(c) for c in columns]), {"ignoreNullFields": "false"})

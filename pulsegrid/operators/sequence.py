"""Sequence operators: gaps, islands, merging, trains, neighbours and windows along an ordered channel.

All take the columns that name a channel (`keys`) and the order within it; each is one shuffle on the keys, shared by
all windows over the same keys and order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def along(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: list[str], order: list[str]) -> WindowSpec:
    return along(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def timestamp_gaps(df: DataFrame, keys: list[str], t: str, order: list[str], step: int) -> DataFrame:
    """Per channel: samples, gaps (a step over `step`), and time lost in them."""
    jump = F.col(t) - F.lag(t).over(along(keys, order))
    return (
        df.withColumn("jump", jump)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_samples"),
            F.count_if(F.col("jump") > step).alias("n_gaps"),
            F.coalesce(F.sum(F.when(F.col("jump") > step, F.col("jump") - step)), F.lit(0)).alias("lost"),
        )
    )


def islands(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Runs of flagged rows: first index, end index (exclusive, from 0) and length."""
    w = along(keys, order)
    marked = df.withColumn("idx", F.row_number().over(w) - 1).withColumn("on", flag)
    runs = marked.where("on").withColumn("island", F.col("idx") - F.row_number().over(w))
    return (
        runs.groupBy(*keys, "island")
        .agg(F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_idx"), F.count("*").alias("length"))
        .drop("island")
    )


def longest_island(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Per channel its longest run, the earliest of equals."""
    found = islands(df, keys, order, flag)
    best = F.max_by(F.struct("start_idx", "length"), F.struct("length", -F.col("start_idx")))
    return found.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.start_idx", "b.length")


def merge_intervals(
    df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, tie: str | None = None, last_end: bool = False
) -> DataFrame:
    """Intervals joined while start - end so far <= gap; with last_end the end of the interval before counts alone."""
    order = [start, end] + ([tie] if tie else [])
    w = along(keys, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lag(end).over(w) if last_end else F.max(end).over(before)
    fresh = F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0)
    grouped = df.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(so_far(keys, order)))
    return (
        grouped.groupBy(*keys, "part")
        .agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n_merged"))
        .drop("part")
    )


def clean_intervals(df: DataFrame, keys: list[str], start: str, end: str, lo: str, hi: str, guard: int, least: int = 1) -> DataFrame:
    """What is free of intervals within lo..hi of each channel, a guard away from them and from both ends of the channel;
    parts shorter than `least` are left out."""
    w = along(keys, [start, end])
    reach = F.greatest(F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col(lo)), F.col(lo))
    opened = df.select(*keys, (reach + guard).alias("start"), (F.col(start) - guard).alias("end"))
    tail = df.groupBy(*keys).agg((F.greatest(F.max(end), F.max(lo)) + guard).alias("start"), (F.max(hi) - guard).alias("end"))
    return opened.unionByName(tail).where(F.col("end") - F.col("start") >= least)


def first_constant_run(df: DataFrame, keys: list[str], order: list[str], sign: Column) -> DataFrame:
    """Per channel the sign of its first row and how many rows keep it."""
    w = along(keys, order)
    marked = df.withColumn("sign", sign).withColumn("idx", F.row_number().over(w) - 1)
    marked = marked.withColumn("first_sign", F.first("sign").over(w))
    other = F.min(F.when(F.col("sign") != F.col("first_sign"), F.col("idx")))
    return marked.groupBy(*keys).agg(
        F.max("first_sign").alias("first_sign"), F.coalesce(other, F.count("*")).alias("run_length")
    )


def trains(df: DataFrame, keys: list[str], t: str, order: list[str], factor: float = 5.0, period: Column | None = None) -> DataFrame:
    """Rows with train_index: a gap over `factor` times the commanded period begins another train; where that is unknown
    (null or not positive) the channel's median gap stands for it."""
    gapped = df.withColumn("gap", F.col(t) - F.lag(t).over(along(keys, order)))
    usual = F.percentile("gap", 0.5).over(Window.partitionBy(*keys))
    if period is not None:
        usual = F.when(period > 0, period).otherwise(usual)
    cut = F.when(F.col("gap") > factor * F.col("usual_gap"), 1).otherwise(0)
    return (
        gapped.withColumn("usual_gap", usual)
        .withColumn("cut", cut)
        .withColumn("train_index", F.sum("cut").over(so_far(keys, order)))
        .drop("cut")
    )


def first_train_count(df: DataFrame, keys: list[str], t: str, order: list[str], least: int, factor: float) -> DataFrame:
    """Per channel the events before the first gap over max(least, factor * median gap)."""
    gapped = df.withColumn("gap", F.col(t) - F.lag(t).over(along(keys, order)))
    limit = F.greatest(F.lit(float(least)), factor * F.percentile("gap", 0.5).over(Window.partitionBy(*keys)))
    over = F.when(F.col("gap") > F.col("limit"), 1).otherwise(0)
    passed = gapped.withColumn("limit", limit).withColumn("over", over).withColumn("n_over", F.sum("over").over(so_far(keys, order)))
    return passed.groupBy(*keys).agg(F.count_if(F.col("n_over") == 0).alias("first_train"), F.count("*").alias("n_events"))


def next_event(df: DataFrame, keys: list[str], t: str, order: list[str], stop: Column) -> DataFrame:
    """Rows with end: the next row's time, or stop."""
    return df.withColumn("end", F.coalesce(F.lead(t).over(along(keys, order)), stop))


def drop_close_pairs(df: DataFrame, keys: list[str], t: str, order: list[str], least: int) -> DataFrame:
    """Rows without the earlier of any neighbours closer than `least`."""
    ahead = F.lead(t).over(along(keys, order)) - F.col(t)
    return df.withColumn("ahead", ahead).where(F.col("ahead").isNull() | (F.col("ahead") >= least)).drop("ahead")


def percent_vs_first(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows with first_value, the channel's first non-null value, and percent change against it."""
    first = F.first(value, ignorenulls=True).over(along(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    change = F.when(F.col("first_value") != 0, 100 * (F.col(value) - F.col("first_value")) / F.col("first_value"))
    return df.withColumn("first_value", first).withColumn("percent", change)


def sliding_means(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, step: int) -> DataFrame:
    """Means of windows of `size` rows that begin every `step` rows; only full windows."""
    w = along(keys, order)
    return (
        df.withColumn("idx", F.row_number().over(w) - 1)
        .withColumn("mean", F.avg(value).over(w.rowsBetween(0, size - 1)))
        .withColumn("n", F.count(value).over(w.rowsBetween(0, size - 1)))
        .where((F.col("n") == size) & (F.col("idx") % step == 0))
        .select(*keys, F.col("idx").alias("start_idx"), "mean")
    )


def backward_chunks(df: DataFrame, keys: list[str], t: str, origin: str, length: int, value: str) -> DataFrame:
    """Mean and count of the samples before an origin, in chunks of `length` counted backwards."""
    k = F.floor((F.col(origin) - F.col(t) - 1) / length)
    before = df.where(F.col(t) < F.col(origin)).withColumn("chunk", k.cast("long"))
    return before.groupBy(*keys, "chunk").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def running_offset(df: DataFrame, keys: list[str], order: list[str], length: str) -> DataFrame:
    """Rows with offset: the lengths of all rows before."""
    before = along(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def ranked_peaks(df: DataFrame, keys: list[str], height: str, t: str, tie: str, most: int) -> DataFrame:
    """The `most` highest rows of a channel, named P1, P2, ... by time."""
    by_height = Window.partitionBy(*keys).orderBy(F.desc(height), tie)
    top = df.withColumn("place", F.row_number().over(by_height)).where(F.col("place") <= most)
    by_time = Window.partitionBy(*keys).orderBy(t, tie)
    return top.withColumn("peak", F.concat(F.lit("P"), F.row_number().over(by_time).cast("string")))


def recovery(df: DataFrame, keys: list[str], order: list[str], above: Column, quiet: int) -> DataFrame:
    """Per channel the last row above before the first `quiet` rows below, and whether there is none such (censored).

    recovery_idx is -1 when the channel starts quiet, and the last index when it never becomes quiet.
    """
    w = along(keys, order)
    marked = df.withColumn("idx", F.row_number().over(w) - 1).withColumn("over", F.when(above, 1).otherwise(0))
    ahead = w.rowsBetween(0, quiet - 1)
    marked = marked.withColumn("loud", F.sum("over").over(ahead)).withColumn("n", F.count("*").over(ahead))
    per = marked.groupBy(*keys).agg(
        F.min(F.when((F.col("loud") == 0) & (F.col("n") == quiet), F.col("idx"))).alias("calm_idx"),
        F.max("idx").alias("last_idx"),
    )
    return per.select(
        *keys,
        F.coalesce(F.col("calm_idx") - 1, F.col("last_idx")).alias("recovery_idx"),
        F.col("calm_idx").isNull().alias("censored"),
    )


def run_scan(blocks: DataFrame, per_block: int) -> DataFrame:
    """Per run (blocks of one or more channels: run_id, block_no, file_no, t0): files, samples, where each file begins, and
    how often a block's time does not follow the one before, within files and at their joins."""
    one = blocks.select("run_id", "block_no", "file_no", "t0").distinct()
    w = Window.partitionBy("run_id").orderBy("block_no")
    placed = one.withColumn("gap", F.col("t0") - F.lag("t0").over(w) != per_block).withColumn("join", F.col("file_no") != F.lag("file_no").over(w))
    begins = F.collect_list(F.when(F.coalesce("join", F.lit(True)), F.col("block_no") * per_block))
    return placed.groupBy("run_id").agg(
        F.count_distinct("file_no").alias("n_files"), (F.count("*") * per_block).alias("n_samples"), F.array_sort(begins).alias("file_boundaries"),
        F.count_if("gap").alias("n_gaps"), F.count_if(F.col("gap") & F.col("join")).alias("n_gaps_at_joins"),
    )

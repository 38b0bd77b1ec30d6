"""Summaries: grouping sets, quantile tables, comparisons, envelopes, histograms and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dealing import dealt


def quantile_row(value: str) -> list[Column]:
    return [F.count(value).alias("n"), F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.5).alias("median"),
            F.percentile(value, 0.75).alias("q75")]


def tertile_limits(df: DataFrame, value: str) -> DataFrame:
    """One row: the limits of low and mid (33.3 and 66.7 percent), and whether there are three distinct values."""
    return df.agg(
        F.percentile(value, 0.333).alias("low"), F.percentile(value, 0.667).alias("mid"), (F.count_distinct(value) >= 3).alias("enough")
    )


def tertiles(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with low, mid or high by the table's own limits; all where there are fewer than three distinct values."""
    limits = F.broadcast(tertile_limits(df, value).withColumn("__one", F.lit(1)))  # a single row
    band = F.when(~F.col("enough"), "all").when(F.col(value) <= F.col("low"), "low").when(F.col(value) <= F.col("mid"), "mid")
    return df.withColumn("__one", F.lit(1)).join(limits, "__one").withColumn(name, band.otherwise("high")).drop("low", "mid", "enough", "__one")


def grouping_summary(df: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Quantiles over several groupings in one pass over the data, as one long table; `level` names the grouping.

    Equal values are counted in each grouping first, before anything is shuffled; quantiles are of the counts, so a group
    holds its distinct values, not its rows.
    """
    names = sorted({c for s in sets for c in s})
    cols = [F.col(c) for c in names]
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    counted = df.groupBy(*cols, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    grouped = counted.groupingSets([[*[F.col(c) for c in s], F.col("__v")] for s in sets], *cols, F.col("__v"))
    counted = grouped.agg(F.sum("__n").alias("__n"), F.when(level == "", "pooled").otherwise(level).alias("level"))
    quantiles = [F.percentile("__v", p, F.col("__n")).alias(n) for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]
    total = F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__n"))), F.lit(0)).alias("n")
    return counted.groupBy(*cols, "level").agg(total, *quantiles)


def first_vs_last(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Medians of the first and last n rows; groups under 2n rows are parted in halves, of which the last gets the odd row."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    half = F.greatest(F.lit(1), F.floor(F.col("total") / 2))
    few = F.col("total") < 2 * n
    first = F.col("rn") <= F.when(few, half).otherwise(n)
    last = F.col("rn") > F.when(few, half).otherwise(F.col("total") - n)
    return (
        placed.groupBy(*keys)
        .agg(
            F.count_if(first).alias("n_first"), F.count_if(last).alias("n_last"),
            F.percentile(F.when(first, F.col(value)), 0.5).alias("first_median"),
            F.percentile(F.when(last, F.col(value)), 0.5).alias("last_median"),
        )
        .withColumn("change", F.col("last_median") - F.col("first_median"))
    )


def robust_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with z = (value - median) / (1.4826 MAD), or over the standard deviation, or 1, where that is zero."""
    w = Window.partitionBy(*keys)
    centred = df.withColumn("centre", F.percentile(value, 0.5).over(w)).withColumn("sd", F.coalesce(F.stddev_pop(value).over(w), F.lit(0.0)))
    dev = centred.withColumn("mad", 1.4826 * F.percentile(F.abs(F.col(value) - F.col("centre")), 0.5).over(w))
    scale = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return dev.withColumn("z", (F.col(value) - F.col("centre")) / scale).drop("centre", "sd", "mad")


def envelope(df: DataFrame, keys: list[str], order: list[str], value: str, max_points: int, keep: Column | None = None) -> DataFrame:
    """Minimum and maximum of bins of ceil(n / max(2, max_points // 2)) rows; only kept rows count, empty bins go."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("idx", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count("*").over(w))
    size = F.ceil(F.col("total") / max(2, max_points // 2))
    binned = placed.withColumn("bin", F.floor(F.col("idx") / size))
    if keep is not None:
        binned = binned.where(keep)
    return binned.groupBy(*keys, "bin").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def rms_envelope(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Root mean squares of full, non-overlapping windows."""
    placed = df.withColumn("bin", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / width))
    return (
        placed.groupBy(*keys, "bin")
        .agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count("*").alias("n"))
        .where(F.col("n") == width)
        .drop("n")
    )


def isi_histogram(df: DataFrame, keys: list[str], t: str, tie: str, width: int, bins: int) -> DataFrame:
    """Share of the gaps between neighbours by bins around multiples of width; the outer bins take the tails."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t, tie))
    k = F.least(F.greatest(F.floor((F.col("gap") + width // 2) / width), F.lit(0)), F.lit(bins - 1))
    counts = df.withColumn("gap", gap).where("gap IS NOT NULL").groupBy(*keys, k.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def ecdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn("fraction", F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)))


def before_after(df: DataFrame, keys: list[str], before: Column, value: str) -> DataFrame:
    """Medians on either side and the fraction of the first that the second is."""
    return (
        df.groupBy(*keys)
        .agg(F.percentile(F.when(before, F.col(value)), 0.5).alias("before"), F.percentile(F.when(~before, F.col(value)), 0.5).alias("after"))
        .withColumn("fraction", F.when(F.col("before") != 0, F.col("after") / F.col("before")))
    )


def live_vs_dead(df: DataFrame, keys: list[str], live: Column, value: str) -> DataFrame:
    """Medians, difference and ratio in conditions that both groups have."""
    per = df.groupBy(*keys).agg(
        F.percentile(F.when(live, F.col(value)), 0.5).alias("live"), F.percentile(F.when(~live, F.col(value)), 0.5).alias("dead")
    )
    both = per.where("live IS NOT NULL AND dead IS NOT NULL")
    return both.withColumn("difference", F.col("live") - F.col("dead")).withColumn("ratio", F.when(F.col("dead") != 0, F.col("live") / F.col("dead")))


def common_values(df: DataFrame, keys: list[str], value: str, width: float, least: int) -> DataFrame:
    """Values clustered by round(value / width); clusters of at least `least`, with their medians."""
    return (
        df.groupBy(*keys, F.bround(F.col(value) / width).cast("long").alias("cluster"))
        .agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("median"))
        .where(F.col("n") >= least)
    )


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties, and the number of points."""
    df = dealt(df.select(*dict.fromkeys([*keys, x, y])), keys)

    def ranks(c: str) -> Column:
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2

    ranked = df.withColumn("rx", ranks(x)).withColumn("ry", ranks(y))
    return ranked.groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def power_rows(df: DataFrame, keys: list[str], base: str, post: str) -> DataFrame:
    """Means, dB of the means' ratio, percent change, and the standard error of paired dB (null under two pairs)."""
    db = F.when((F.col(base) > 0) & (F.col(post) > 0), 10 * F.log10(F.col(post) / F.col(base)))
    per = df.withColumn("db", db).groupBy(*keys).agg(
        F.avg(base).alias("base_mean"), F.avg(post).alias("post_mean"), F.count("db").alias("n"), F.stddev_samp("db").alias("sd"),
        F.avg("db").alias("mean_db"),
    )
    ratio = F.col("post_mean") / F.col("base_mean")
    return per.select(
        *keys, "base_mean", "post_mean", "mean_db",
        F.when((F.col("base_mean") > 0) & (F.col("post_mean") > 0), 10 * F.log10(ratio)).alias("db_of_means"),
        F.when(F.col("base_mean") != 0, 100 * (ratio - 1)).alias("percent"),
        F.when(F.col("n") >= 2, F.col("sd") / F.sqrt("n")).alias("sem"),
    )

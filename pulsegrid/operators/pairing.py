"""Joins by key and by time: pairing of windows, neighbours in an interval, as-of and nearest matches.

Time joins are equi-joins on the channel and, for bounded spans, on time buckets of the span's size, so no channel is
squared: each row meets the rows of its own and the neighbouring buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucketed(df: DataFrame, t: str, size: int, name: str, reach: int = 0) -> DataFrame:
    """df with its time bucket; with reach once for each of the buckets up to `reach` away."""
    own = F.floor(F.col(t) / size)
    if not reach:
        return df.withColumn(name, own)
    return df.withColumn(name, F.explode(F.sequence(own - reach, own + reach)))


def within(a: DataFrame, b: DataFrame, key: str, ta: str, tb: str, lo: int, hi: int) -> DataFrame:
    """Pairs of rows of a and b (no common names but key) with lo <= tb - ta < hi; a's key stays."""
    size = max(hi, -lo, 1)
    left = bucketed(a, ta, size, "__bucket", 1)
    right = bucketed(b, tb, size, "__bucket_b").withColumnRenamed(key, "__key_b")
    delta = F.col(tb) - F.col(ta)
    on = (F.col(key) == F.col("__key_b")) & (F.col("__bucket") == F.col("__bucket_b")) & (delta >= lo) & (delta < hi)
    return left.join(right, on).drop("__bucket", "__bucket_b", "__key_b")


def inside(spans: DataFrame, points: DataFrame, key: str, start: str, stop: str, t: str, size: int | None = None, how: str = "left") -> DataFrame:
    """Spans (half-open, whole numbers) with the points in them (no common names but key): each span names the buckets
    that it covers, so a point meets the spans of its own bucket only. Spans without points stay, with nulls.

    size: length of a bucket; by default about that of the longest span, which one aggregate finds.
    """
    if size is None:
        size = max(1, spans.agg(F.max(F.col(stop) - F.col(start))).first()[0] or 1)
    last = F.floor((F.greatest(F.col(stop), F.col(start) + 1) - 1) / size)
    left = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / size), last)))
    right = bucketed(points, t, size, "__bucket_p").withColumnRenamed(key, "__key_p")
    on = (
        (F.col(key) == F.col("__key_p")) & (F.col("__bucket") == F.col("__bucket_p"))
        & (F.col(t) >= F.col(start)) & (F.col(t) < F.col(stop))
    )
    return left.join(right, on, how).drop("__bucket", "__bucket_p", "__key_p")


def paired_change(samples: DataFrame, marks: DataFrame, span: int) -> DataFrame:
    """Per channel: event-locked change from the span before markers to the equally long one from them on.

    samples: channel, t, value; marks: channel, mark_id, mark_t. Mean squares of both windows are paired by marker; only
    markers with both count, the others are dropped. dB = 10 log10(post / base), null where either is not positive.
    """
    near = within(marks, samples.select("channel", "t", "value"), "channel", "mark_t", "t", -span, span)
    side = F.col("t") >= F.col("mark_t")
    power = near.groupBy("channel", "mark_id").agg(
        F.avg(F.when(~side, F.col("value") * F.col("value"))).alias("base"),
        F.avg(F.when(side, F.col("value") * F.col("value"))).alias("post"),
    )
    both = F.col("base").isNotNull() & F.col("post").isNotNull()
    db = F.when((F.col("base") > 0) & (F.col("post") > 0), 10 * F.log10(F.col("post") / F.col("base")))
    per = (
        power.withColumn("db", F.when(both, db))
        .groupBy("channel")
        .agg(
            F.count_if(both).alias("n_pairs"),
            F.avg("db").alias("mean_db"),
            F.percentile("db", 0.5).alias("median_db"),
        )
    )
    totals = marks.groupBy(F.col("channel").alias("mark_channel")).agg(F.count("*").alias("n_marks"))
    joined = totals.join(per, F.col("mark_channel") == F.col("channel"), "left")
    pairs = F.coalesce("n_pairs", F.lit(0))
    return joined.select(
        F.col("mark_channel").alias("channel"), pairs.alias("n_pairs"), (F.col("n_marks") - pairs).alias("n_dropped"),
        "mean_db", "median_db",
    )


def unique_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and side (both, only_a, only_b) over two tables with unique keys; a repeated key raises an error."""
    left = a.groupBy(*keys).agg(F.count("*").alias("n_a"))
    right = b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    both = left.join(right, keys, "full")
    twice = (F.coalesce("n_a", F.lit(0)) > 1) | (F.coalesce("n_b", F.lit(0)) > 1)
    side = F.when(twice, F.raise_error(F.lit("keys are not unique"))).otherwise(
        F.when(F.col("n_b").isNull(), "only_a").when(F.col("n_a").isNull(), "only_b").otherwise("both")
    )
    return both.select(*keys, side.alias("side"))


def contaminated(df: DataFrame, keys: list[str], t: str, tie: str, recovery: str, baseline: int) -> DataFrame:
    """Rows with contaminated: the predecessor recovers later than the row's baseline begins; false without one."""
    w = Window.partitionBy(*keys).orderBy(t, tie)
    spacing = F.col(t) - F.lag(t).over(w)
    late = F.lag(recovery).over(w) > spacing - abs(baseline)
    return df.withColumn("contaminated", F.coalesce(late, F.lit(False)))


def neighbours(marks: DataFrame, lo: int, hi: int) -> DataFrame:
    """channel, mark_id, n_before, n_after: other markers within [lo, hi) of each marker."""
    other = marks.select("channel", F.col("mark_id").alias("other_id"), F.col("mark_t").alias("other_t"))
    near = within(marks, other, "channel", "mark_t", "other_t", lo, hi).where(F.col("mark_id") != F.col("other_id"))
    counts = near.groupBy("channel", "mark_id").agg(
        F.count_if(F.col("other_t") < F.col("mark_t")).alias("n_before"),
        F.count_if(F.col("other_t") >= F.col("mark_t")).alias("n_after"),
    )
    joined = marks.select("channel", "mark_id").join(counts, ["channel", "mark_id"], "left")
    return joined.fillna(0, ["n_before", "n_after"])


def without_overlap(a: DataFrame, b: DataFrame, key: str, span: int) -> DataFrame:
    """Rows of a (key, start, end) that overlap no row of b (key, b_start, b_end); no interval is longer than span."""
    left = a.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor(F.col("end") / span))))
    right = b.select(F.col(key).alias("__key_b"), "b_start", "b_end").withColumn(
        "__bucket_b", F.explode(F.sequence(F.floor(F.col("b_start") / span), F.floor(F.col("b_end") / span)))
    )
    hit = left.join(
        right,
        (F.col(key) == F.col("__key_b")) & (F.col("__bucket") == F.col("__bucket_b"))
        & (F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start")),
        "left_semi",
    )
    return a.join(hit.select(key, "start", "end").distinct(), [key, "start", "end"], "left_anti")


def clipped(epochs: DataFrame, blanks: DataFrame, key: str, lo: int, hi: int, before: int, after: int) -> DataFrame:
    """Blank windows around pulses (b_t) within the span lo..hi of epochs (mark_t), cut to the span, in its time."""
    near = within(epochs, blanks, key, "mark_t", "b_t", lo - after, hi + before)
    rel = F.col("b_t") - F.col("mark_t")
    start, end = F.greatest(rel - before, F.lit(lo)), F.least(rel + after, F.lit(hi))
    return near.select(key, "mark_id", "b_id", start.alias("blank_start"), end.alias("blank_end")).where(
        F.col("blank_end") > F.col("blank_start")
    )


def as_of(a: DataFrame, b: DataFrame, key: str, ta: str, tb: str) -> DataFrame:
    """Rows of a with b_id and b_t of the latest row of b (key, b_id, tb) not later than ta; null without one.

    Both sides are merged along time and the last b is carried forward: one shuffle, no join.
    """
    mark = F.struct(F.col(tb).alias("b_t"), F.col("b_id"))
    left = a.withColumn("__t", F.col(ta)).withColumn("__b", F.lit(None).cast(b.select(mark).schema[0].dataType))
    right = b.select(key, F.col(tb).alias("__t"), mark.alias("__b"))
    w = Window.partitionBy(key).orderBy("__t", F.col("__b").isNull(), F.col("__b.b_id"))
    carried = F.last("__b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = left.withColumn("__is_a", F.lit(True)).unionByName(right.withColumn("__is_a", F.lit(False)), allowMissingColumns=True)
    found = both.withColumn("__found", carried).where("__is_a")
    return found.select(*a.columns, F.col("__found.b_id").alias("b_id"), F.col("__found.b_t").alias("b_t"))


def containing_span(a: DataFrame, spans: DataFrame, key: str, ta: str, slack: int) -> DataFrame:
    """Rows of a with b_id and b_start of the latest-starting span (key, b_id, b_start, b_end) that holds ta, up to `slack`
    outside of it at either end; null without one; of equal starts the smaller b_id."""
    wide = spans.select(key, "b_id", "b_start", (F.col("b_start") - slack).alias("__lo"), (F.col("b_end") + slack + 1).alias("__hi"))
    points = a.select(key, F.col(ta).alias("__at")).distinct()
    met = inside(wide, points, key, "__lo", "__hi", "__at", how="inner")
    best = met.groupBy(F.col(key).alias("__k"), "__at").agg(F.min_by(F.struct("b_id", "b_start"), F.struct(-F.col("b_start"), "b_id")).alias("b"))
    joined = a.join(best, (F.col(key) == F.col("__k")) & (F.col(ta) == F.col("__at")), "left")
    return joined.select(*a.columns, F.col("b.b_id").alias("b_id"), F.col("b.b_start").alias("b_start"))


def nearest(teeth: DataFrame, samples: DataFrame, key: str, reach: int) -> DataFrame:
    """For each tooth (key, tooth_id, tooth_t) the highest sample (sample_id, sample_t, height) within reach."""
    near = within(teeth, samples, key, "tooth_t", "sample_t", -reach, reach + 1)
    best = F.max_by(F.struct("sample_id", "sample_t"), F.struct("height", -F.col("sample_id")))
    return near.groupBy(key, "tooth_id").agg(best.alias("b")).select(key, "tooth_id", "b.sample_id", "b.sample_t")


def pair_counts(a: DataFrame, b: DataFrame, key: str, ta: str, tb: str, reach: int, width: int, where: Column) -> DataFrame:
    """Histogram of tb - ta within ±reach in bins of `width`, over pairs for which `where` holds."""
    near = within(a, b, key, ta, tb, -reach, reach + 1).where(where)
    return near.groupBy(F.floor((F.col(tb) - F.col(ta)) / width).alias("bin")).agg(F.count("*").alias("n"))


def theil_sen(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median of the slopes of all pairs of points with different x, and the number of such pairs.

    Equal points are counted first, and pairs of distinct ones weigh as many pairs as they stand for, so a group grows
    with the square of its distinct points only.
    """
    counted = points.groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    a, b = (counted.select(*keys, *[F.col(c).alias(f"{c}{k}") for c in ("x", "y", "n")]) for k in (1, 2))
    pairs = a.join(b, keys).where(F.col("x1") < F.col("x2"))
    slope, weight = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")), F.col("n1") * F.col("n2")
    return pairs.groupBy(*keys).agg(F.percentile(slope, 0.5, weight).alias("slope"), F.sum(weight).alias("n_pairs"))

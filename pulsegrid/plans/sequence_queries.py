"""Sequence operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import carry
from ..operators import sequence as seq
from .bindings import DAY, HOUR, MARKERS, SIGNAL, markers, signal
from .query import Query

KEYS, ORDER = ["channel"], ["t", "event_id"]
WIDTH = 6 * HOUR


def pulses(spark, sf_dir):
    """Markers as intervals; their widths follow their values."""
    width = F.lit(WIDTH) + F.col("event_id") % 5 * HOUR
    return markers(spark, sf_dir).select("channel", "event_id", F.col("t").alias("start"), (F.col("t") + width).alias("end"))


PULSES = MARKERS + f", p AS (SELECT channel, event_id, t AS start, t + {WIDTH} + event_id % 5 * {HOUR} AS stop FROM m)"


ISLANDS = (
    SIGNAL
    + """, i AS (
  SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t, event_id) - 1 AS idx FROM s
), g AS (
  SELECT *, idx - row_number() OVER (PARTITION BY channel ORDER BY t, event_id) AS island FROM i WHERE value > 50
), r AS (
  SELECT channel, min(idx) AS start_idx, max(idx) + 1 AS end_idx, count(*) AS length FROM g GROUP BY channel, island
)"""
)


def high(df=None):
    return F.col("value") > 50


def _merge_sql(gap: int, last_end: bool) -> str:
    reach = (
        "lag(stop) OVER w" if last_end
        else "max(stop) OVER (PARTITION BY channel ORDER BY start, stop, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    return f"""WITH {PULSES}, f AS (
  SELECT *, {reach} AS reach FROM p WINDOW w AS (PARTITION BY channel ORDER BY start, stop, event_id)
), n AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > {gap} THEN 1 ELSE 0 END)
    OVER (PARTITION BY channel ORDER BY start, stop, event_id ROWS UNBOUNDED PRECEDING) AS part FROM f
)
SELECT channel, min(start) AS "start", max(stop) AS "end", count(*) AS n_merged FROM n GROUP BY channel, part"""


QUERIES = {
    "timestamp_gaps": Query(
        lambda s, d: seq.timestamp_gaps(signal(s, d), KEYS, "t", ORDER, HOUR),
        f"""WITH {SIGNAL}, j AS (
  SELECT channel, t - lag(t) OVER (PARTITION BY channel ORDER BY t, event_id) AS jump FROM s
)
SELECT channel, count(*) AS n_samples, count(*) FILTER (WHERE jump > {HOUR}) AS n_gaps,
       CAST(coalesce(sum(jump - {HOUR}) FILTER (WHERE jump > {HOUR}), 0) AS BIGINT) AS lost
FROM j GROUP BY channel""",
    ),
    "nonzero_runs": Query(
        lambda s, d: seq.islands(signal(s, d), KEYS, ORDER, high()),
        f"WITH {ISLANDS} SELECT channel, start_idx, end_idx, length FROM r",
    ),
    "longest_run": Query(
        lambda s, d: seq.longest_island(signal(s, d), KEYS, ORDER, high()),
        f"""WITH {ISLANDS}
SELECT channel, start_idx, length FROM r
QUALIFY row_number() OVER (PARTITION BY channel ORDER BY length DESC, start_idx) = 1""",
    ),
    "merge_runs_within_gap": Query(
        lambda s, d: seq.merge_intervals(pulses(s, d), KEYS, "start", "end", DAY, "event_id"), _merge_sql(DAY, False)
    ),
    "merge_touching_windows": Query(
        lambda s, d: seq.merge_intervals(pulses(s, d), KEYS, "start", "end", 0, "event_id"), _merge_sql(0, False)
    ),
    "merge_by_last_end": Query(
        lambda s, d: seq.merge_intervals(pulses(s, d), KEYS, "start", "end", 12 * HOUR, "event_id", last_end=True),
        _merge_sql(12 * HOUR, True),
    ),
    "clean_intervals": Query(
        lambda s, d: seq.clean_intervals(
            seq.merge_intervals(pulses(s, d), KEYS, "start", "end", 0, "event_id")
            .withColumn("lo", F.min("start").over(seq.Window.partitionBy("channel")) - DAY)
            .withColumn("hi", F.max("end").over(seq.Window.partitionBy("channel")) + DAY),
            KEYS, "start", "end", "lo", "hi", HOUR, 2 * HOUR,
        ),
        "WITH mm AS (" + _merge_sql(0, False) + f"""), b AS (
  SELECT channel, "start" AS a, "end" AS z, min("start") OVER (PARTITION BY channel) - {DAY} AS lo,
         max("end") OVER (PARTITION BY channel) + {DAY} AS hi FROM mm
), o AS (
  SELECT channel, coalesce(max(z) OVER (PARTITION BY channel ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) + {HOUR} AS x,
         a - {HOUR} AS y FROM b
  UNION ALL SELECT channel, max(z) + {HOUR}, max(hi) - {HOUR} FROM b GROUP BY channel
)
SELECT channel, x AS "start", y AS "end" FROM o WHERE y - x >= {2 * HOUR}""",
    ),
    "first_constant_sign_run": Query(
        lambda s, d: seq.first_constant_run(signal(s, d), KEYS, ORDER, F.when(high(), 1).otherwise(-1)),
        f"""WITH {SIGNAL}, i AS (
  SELECT channel, CASE WHEN value > 50 THEN 1 ELSE -1 END AS sign,
         row_number() OVER (PARTITION BY channel ORDER BY t, event_id) - 1 AS idx FROM s
), f AS (SELECT *, first_value(sign) OVER (PARTITION BY channel ORDER BY idx) AS first_sign FROM i)
SELECT channel, max(first_sign) AS first_sign,
       coalesce(min(idx) FILTER (WHERE sign <> first_sign), count(*)) AS run_length FROM f GROUP BY channel""",
    ),
    "train_split": Query(
        lambda s, d: seq.trains(markers(s, d), KEYS, "t", ORDER, 3.0)
        .groupBy("channel", "train_index")
        .agg(F.count("*").alias("n_pulses"), F.min("t").alias("first_t"), F.max("t").alias("last_t")),
        f"""WITH {MARKERS}, g AS (
  SELECT *, t - lag(t) OVER (PARTITION BY channel ORDER BY t, event_id) AS gap FROM m
), u AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY channel) AS usual FROM g
), n AS (
  SELECT *, sum(CASE WHEN gap > 3.0 * usual THEN 1 ELSE 0 END)
    OVER (PARTITION BY channel ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS train_index FROM u
)
SELECT channel, CAST(train_index AS BIGINT) AS train_index, count(*) AS n_pulses, min(t) AS first_t, max(t) AS last_t
FROM n GROUP BY channel, train_index""",
    ),
    "first_train_count": Query(
        lambda s, d: seq.first_train_count(markers(s, d), KEYS, "t", ORDER, DAY, 3.0),
        f"""WITH {MARKERS}, g AS (
  SELECT *, t - lag(t) OVER (PARTITION BY channel ORDER BY t, event_id) AS gap FROM m
), u AS (SELECT *, greatest({DAY}.0, 3.0 * quantile_cont(gap, 0.5) OVER (PARTITION BY channel)) AS lim FROM g
), n AS (
  SELECT *, sum(CASE WHEN gap > lim THEN 1 ELSE 0 END)
    OVER (PARTITION BY channel ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n_over FROM u
)
SELECT channel, count(*) FILTER (WHERE n_over = 0) AS first_train, count(*) AS n_events FROM n GROUP BY channel""",
    ),
    "event_to_next_event": Query(
        lambda s, d: seq.next_event(markers(s, d), KEYS, "t", ORDER, F.col("t") + DAY).select("channel", "event_id", "t", "end"),
        f"""WITH {MARKERS}
SELECT channel, event_id, t, coalesce(lead(t) OVER (PARTITION BY channel ORDER BY t, event_id), t + {DAY}) AS "end" FROM m""",
    ),
    "polytrode_pair_dedup": Query(
        lambda s, d: seq.drop_close_pairs(signal(s, d), KEYS, "t", ORDER, 6 * HOUR).select("channel", "event_id", "t"),
        f"""WITH {SIGNAL}, a AS (
  SELECT *, lead(t) OVER (PARTITION BY channel ORDER BY t, event_id) - t AS ahead FROM s
)
SELECT channel, event_id, t FROM a WHERE ahead IS NULL OR ahead >= {6 * HOUR}""",
    ),
    "refractory_greedy": Query(
        lambda s, d: carry.refractory(signal(s, d), KEYS, "t", "event_id", DAY),
        f"""WITH RECURSIVE {SIGNAL}, o AS (
  SELECT channel, t, event_id, row_number() OVER (PARTITION BY channel ORDER BY t, event_id) AS k FROM s
), w AS (
  SELECT channel, k, t AS last, true AS keep FROM o WHERE k = 1
  UNION ALL
  SELECT o.channel, o.k, CASE WHEN o.t - w.last >= {DAY} THEN o.t ELSE w.last END, o.t - w.last >= {DAY}
  FROM w JOIN o ON o.channel = w.channel AND o.k = w.k + 1
)
SELECT o.channel, o.t, o.event_id FROM w JOIN o USING (channel, k) WHERE keep""",
    ),
    "percent_vs_first": Query(
        lambda s, d: seq.percent_vs_first(signal(s, d), KEYS, ORDER, "value").select(
            "channel", "event_id", "first_value", F.round("percent", 6).alias("percent")
        ),
        f"""WITH {SIGNAL}, f AS (
  SELECT *, first_value(value IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_value FROM s
)
SELECT channel, event_id, first_value,
       CASE WHEN first_value <> 0 THEN round(100 * (value - first_value) / first_value, 6) END AS percent FROM f""",
    ),
    "sliding_window_means": Query(
        lambda s, d: seq.sliding_means(signal(s, d), KEYS, ORDER, "value", 8, 4).withColumn("mean", F.round("mean", 6)),
        f"""WITH {SIGNAL}, w AS (
  SELECT channel, row_number() OVER o - 1 AS start_idx,
         avg(value) OVER (PARTITION BY channel ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS mean,
         count(value) OVER (PARTITION BY channel ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n
  FROM s WINDOW o AS (PARTITION BY channel ORDER BY t, event_id)
)
SELECT channel, start_idx, round(mean, 6) AS mean FROM w WHERE n = 8 AND start_idx % 4 = 0""",
    ),
    "baseline_chunks_backwards": Query(
        lambda s, d: seq.backward_chunks(
            signal(s, d).withColumn("origin", F.max(F.when(F.col("kind") == "error", F.col("t"))).over(seq.Window.partitionBy("channel"))),
            KEYS, "t", "origin", 7 * DAY, "value",
        ).withColumn("mean", F.round("mean", 6)),
        f"""WITH {SIGNAL}, o AS (SELECT *, max(t) FILTER (WHERE kind = 'error') OVER (PARTITION BY channel) AS origin FROM s)
SELECT channel, (origin - t - 1) // {7 * DAY} AS chunk, round(avg(value), 6) AS mean, count(*) AS n
FROM o WHERE t < origin GROUP BY channel, chunk""",
    ),
    "cumulative_time_offset": Query(
        lambda s, d: seq.running_offset(
            signal(s, d).select("channel", F.col("event_id").alias("file_no"), (F.col("event_id") % 7 + 1).alias("length")),
            KEYS, ["file_no"], "length",
        ),
        """SELECT user_id AS channel, event_id AS file_no, event_id % 7 + 1 AS length,
       CAST(coalesce(sum(event_id % 7 + 1) OVER (PARTITION BY user_id ORDER BY event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM events""",
    ),
    "ranked_peaks": Query(
        lambda s, d: seq.ranked_peaks(signal(s, d), KEYS, "value", "t", "event_id", 5).select("channel", "event_id", "value", "peak"),
        f"""WITH {SIGNAL}, k AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY channel ORDER BY value DESC, event_id) <= 5
)
SELECT channel, event_id, value, 'P' || row_number() OVER (PARTITION BY channel ORDER BY t, event_id) AS peak FROM k""",
    ),
    "recovery_scan": Query(
        lambda s, d: seq.recovery(signal(s, d), KEYS, ORDER, F.col("value") > 80, 6),
        f"""WITH {SIGNAL}, i AS (
  SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY t, event_id) - 1 AS idx,
         sum(CASE WHEN value > 80 THEN 1 ELSE 0 END) OVER w AS loud, count(*) OVER w AS n
  FROM s WINDOW w AS (PARTITION BY channel ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)
), c AS (SELECT channel, min(idx) FILTER (WHERE loud = 0 AND n = 6) AS calm, max(idx) AS last FROM i GROUP BY channel)
SELECT channel, coalesce(calm - 1, last) AS recovery_idx, calm IS NULL AS censored FROM c""",
    ),
}

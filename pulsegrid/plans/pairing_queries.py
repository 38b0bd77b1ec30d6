"""Pairing operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairing as pair
from ..operators.dealing import dealt
from .bindings import DAY, HOUR, MARKERS, SIGNAL, TRIALS, load, markers, signal, trials
from .query import Query


def marks(s, d):
    return markers(s, d).select("channel", F.col("event_id").alias("mark_id"), F.col("t").alias("mark_t"))


def quiet(s, d):
    return signal(s, d).where(F.col("kind") != "error")


def rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


def first_trials(s, d, side: int):
    """One row for each run and event number that has a retained trial in the window before (0) or behind (1) its pulse."""
    t = trials(s, d)
    own = t.where(F.col("tax") > 0.01 if side == 0 else F.col("discount") > 0.01).select("run_id", "event_number")
    return dealt(own, ["run_id", "event_number"], t).distinct()


QUERIES = {
    "paired_event_locked_change": Query(
        lambda s, d: rounded(pair.paired_change(quiet(s, d), marks(s, d), DAY), "mean_db", "median_db"),
        f"""WITH {MARKERS}, n AS (
  SELECT m.channel, m.event_id AS mark_id, s.t >= m.t AS post, s.value * s.value AS sq
  FROM m JOIN s ON s.channel = m.channel AND s.kind <> 'error' AND s.t - m.t >= -{DAY} AND s.t - m.t < {DAY}
), p AS (
  SELECT channel, mark_id, avg(sq) FILTER (WHERE NOT post) AS base, avg(sq) FILTER (WHERE post) AS post FROM n GROUP BY ALL
), q AS (
  SELECT *, CASE WHEN base > 0 AND post > 0 THEN 10 * log10(post / base) END AS db FROM p WHERE base IS NOT NULL AND post IS NOT NULL
), c AS (SELECT channel, count(*) AS n_marks FROM m GROUP BY channel
), a AS (SELECT channel, count(*) AS n_pairs, avg(db) AS mean_db, quantile_cont(db, 0.5) AS median_db FROM q GROUP BY channel)
SELECT c.channel, coalesce(n_pairs, 0) AS n_pairs, n_marks - coalesce(n_pairs, 0) AS n_dropped,
       round(mean_db, 6) AS mean_db, round(median_db, 6) AS median_db
FROM c LEFT JOIN a USING (channel)""",
    ),
    "unique_key_pairing": Query(
        lambda s, d: pair.unique_pairs(first_trials(s, d, 0), first_trials(s, d, 1), ["run_id", "event_number"]),
        f"""WITH {TRIALS}, a AS (SELECT DISTINCT run_id, event_number FROM tr WHERE tax > 0.01
), b AS (SELECT DISTINCT run_id, event_number FROM tr WHERE discount > 0.01)
SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.event_number, b.event_number) AS event_number,
       CASE WHEN b.run_id IS NULL THEN 'only_a' WHEN a.run_id IS NULL THEN 'only_b' ELSE 'both' END AS side
FROM a FULL JOIN b ON a.run_id = b.run_id AND a.event_number = b.event_number""",
    ),
    "baseline_contamination": Query(
        lambda s, d: pair.contaminated(
            markers(s, d).withColumn("recovery", F.when(F.col("event_id") % 4 != 0, (F.col("value") * HOUR).cast("long"))),
            ["channel"], "t", "event_id", "recovery", 6 * HOUR,
        ).select("channel", "event_id", "contaminated"),
        f"""WITH {MARKERS}, r AS (
  SELECT *, CASE WHEN event_id % 4 <> 0 THEN CAST(trunc(value * {HOUR}) AS BIGINT) END AS recovery FROM m
)
SELECT channel, event_id, coalesce(lag(recovery) OVER w > t - lag(t) OVER w - {6 * HOUR}, false) AS contaminated
FROM r WINDOW w AS (PARTITION BY channel ORDER BY t, event_id)""",
    ),
    "neighbour_pulses": Query(
        lambda s, d: pair.neighbours(marks(s, d), -3 * DAY, 2 * DAY),
        f"""WITH {MARKERS}
SELECT a.channel, a.event_id AS mark_id,
       count(b.event_id) FILTER (WHERE b.t < a.t) AS n_before, count(b.event_id) FILTER (WHERE b.t >= a.t) AS n_after
FROM m a LEFT JOIN m b ON b.channel = a.channel AND b.event_id <> a.event_id
  AND b.t - a.t >= -{3 * DAY} AND b.t - a.t < {2 * DAY}
GROUP BY ALL""",
    ),
    "fake_epochs_without_overlap": Query(
        lambda s, d: pair.without_overlap(
            quiet(s, d).select("channel", "event_id", (F.col("t") - HOUR).alias("start"), (F.col("t") + DAY).alias("end")),
            markers(s, d).select("channel", (F.col("t") - HOUR).alias("b_start"), (F.col("t") + 12 * HOUR).alias("b_end")),
            "channel", 2 * DAY,
        ),
        f"""WITH {MARKERS}, a AS (
  SELECT channel, event_id, t - {HOUR} AS start, t + {DAY} AS stop FROM s WHERE kind <> 'error'
)
SELECT channel, event_id, start AS "start", stop AS "end" FROM a
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.channel = a.channel AND a.start < m.t + {12 * HOUR} AND a.stop > m.t - {HOUR})""",
    ),
    "pulse_blanks_clipped_to_epoch": Query(
        lambda s, d: pair.clipped(
            marks(s, d), quiet(s, d).where("kind = 'purchase'").select("channel", F.col("event_id").alias("b_id"), F.col("t").alias("b_t")),
            "channel", -DAY, DAY, HOUR, 3 * HOUR,
        ),
        f"""WITH {MARKERS}, c AS (
  SELECT m.channel, m.event_id AS mark_id, s.event_id AS b_id, greatest(s.t - m.t - {HOUR}, -{DAY}) AS blank_start,
         least(s.t - m.t + {3 * HOUR}, {DAY}) AS blank_end
  FROM m JOIN s ON s.channel = m.channel AND s.kind = 'purchase'
    AND s.t - m.t >= -{DAY + 3 * HOUR} AND s.t - m.t < {DAY + HOUR}
)
SELECT * FROM c WHERE blank_end > blank_start""",
    ),
    "asof_latest": Query(
        lambda s, d: pair.as_of(
            marks(s, d), quiet(s, d).where("kind = 'view'").select("channel", F.col("event_id").alias("b_id"), F.col("t").alias("cap_t")),
            "channel", "mark_t", "cap_t",
        ).select("channel", "mark_id", "b_id", "b_t"),
        f"""WITH {MARKERS}, v AS (SELECT channel, event_id, t FROM s WHERE kind = 'view')
SELECT m.channel, m.event_id AS mark_id, arg_max(v.event_id, (v.t, v.event_id)) AS b_id, max(v.t) AS b_t
FROM m LEFT JOIN v ON v.channel = m.channel AND v.t <= m.t GROUP BY ALL""",
    ),
    "asof_capture_for_onset": Query(
        lambda s, d: pair.containing_span(
            marks(s, d), quiet(s, d).where("kind = 'view'").select("channel", F.col("event_id").alias("b_id"), F.col("t").alias("b_start"), (F.col("t") + F.col("event_id") % 4 * DAY).alias("b_end")),
            "channel", "mark_t", HOUR).select("channel", "mark_id", "b_id", "b_start"),
        f"""WITH {MARKERS}, v AS (SELECT channel, event_id, t, t + event_id % 4 * {DAY} AS stop FROM s WHERE kind = 'view'
), j AS (SELECT m.channel, m.event_id AS mark_id, arg_min(v.event_id, (-v.t, v.event_id)) AS b_id, max(v.t) AS b_start
  FROM m JOIN v ON v.channel = m.channel AND m.t >= v.t - {HOUR} AND m.t <= v.stop + {HOUR} GROUP BY ALL)
SELECT m.channel, m.event_id AS mark_id, b_id, b_start FROM m LEFT JOIN j ON j.channel = m.channel AND j.mark_id = m.event_id""",
    ),
    "comb_snap_nearest": Query(
        lambda s, d: pair.nearest(
            markers(s, d).select("channel", F.col("event_id").alias("tooth_id"), F.col("t").alias("tooth_t")),
            quiet(s, d).select("channel", F.col("event_id").alias("sample_id"), F.col("t").alias("sample_t"), F.col("value").alias("height")),
            "channel", DAY,
        ),
        f"""WITH {MARKERS}
SELECT m.channel, m.event_id AS tooth_id, arg_max(s.event_id, (s.value, -s.event_id)) AS sample_id,
       arg_max(s.t, (s.value, -s.event_id)) AS sample_t
FROM m JOIN s ON s.channel = m.channel AND s.kind <> 'error' AND abs(s.t - m.t) <= {DAY} GROUP BY ALL""",
    ),
    "cross_correlogram": Query(
        lambda s, d: pair.pair_counts(
            markers(s, d).select("channel", F.col("t").alias("ta")), quiet(s, d).select("channel", F.col("t").alias("tb")),
            "channel", "ta", "tb", 2 * DAY, 2 * HOUR, F.lit(True),
        ),
        f"""WITH {MARKERS}
SELECT CAST(floor((s.t - m.t) / {2 * HOUR}) AS BIGINT) AS bin, count(*) AS n
FROM m JOIN s ON s.channel = m.channel AND s.kind <> 'error' AND abs(s.t - m.t) <= {2 * DAY} GROUP BY bin""",
    ),
    "theil_sen_slopes": Query(
        lambda s, d: rounded(
            pair.theil_sen(
                load(s, d, "orders").select(F.col("o_custkey").alias("channel"),
                                            F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("x"), (F.col("o_totalprice") * 86400).alias("y")),
                ["channel"], "x", "y",
            ), "slope",
        ),
        """WITH o AS (SELECT o_custkey AS channel, o_orderkey AS i, CAST(epoch(o_orderdate) AS DOUBLE) AS x, o_totalprice * 86400 AS y FROM orders)
SELECT a.channel, round(quantile_cont((b.y - a.y) / (b.x - a.x), 0.5), 6) AS slope, count(*) AS n_pairs
FROM o a JOIN o b ON a.channel = b.channel AND a.i < b.i AND a.x <> b.x GROUP BY a.channel""",
    ),
    "matched_conditions": Query(
        lambda s, d: trials(s, d).where("band = 'O'").select("contact", "win").intersect(trials(s, d).where("band = 'F'").select("contact", "win")),
        f"WITH {TRIALS} SELECT contact, win FROM tr WHERE band = 'O' INTERSECT SELECT contact, win FROM tr WHERE band = 'F'",
    ),
    "missing_channels": Query(
        lambda s, d: load(s, d, "part").select(F.col("p_partkey").alias("channel")).join(
            load(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("channel")), "channel", "left_anti"),
        "SELECT p_partkey AS channel FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    ),
}

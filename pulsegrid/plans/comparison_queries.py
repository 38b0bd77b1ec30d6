"""Secondary comparisons on the driver's tables: trials of contacts as channels, quantities as amplitudes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparisons as comp
from ..operators import gating as gate
from .bindings import TRIALS, trials
from .query import Query
from .summary_queries import RUNS, runs, six

WINDOWED = TRIALS + """, wt AS (SELECT *, CASE WHEN win = 'A' AND contact % 3 <> 0 THEN 'early' WHEN win = 'R' THEN 'late' ELSE 'baseline' END AS wn FROM tr)"""


def windowed(s, d):
    early = (F.col("win") == "A") & (F.col("contact") % 3 != 0)
    return trials(s, d).withColumn("window", F.when(early, "early").when(F.col("win") == "R", "late").otherwise("baseline"))


def across(s, d):
    t = trials(s, d).withColumns({"level": (F.floor(F.col("response") / 10) * 10).cast("int"), "distance_um": F.col("contact") % 37 * 100.0})
    return comp.across_amplitude(t, ["contact"], "level", "metric", ["distance_um"], 100)


ACROSS = TRIALS + """, ac AS (SELECT contact, CAST(floor(response / 10) * 10 AS INT) AS level, count(*) AS n, quantile_cont(metric, 0.5) AS median, contact % 37 * 100.0 AS distance_um
  FROM tr GROUP BY contact, CAST(floor(response / 10) * 10 AS INT))"""

QUERIES = {
    "across_amplitude_intervals": Query(
        lambda s, d: six(across(s, d).select("contact", "level", "n", "median", "distance_um", F.expr("lo <= median AND median <= hi").alias("around"))),
        f"WITH {ACROSS} SELECT contact, level, n, round(median, 6) AS median, distance_um, true AS around FROM ac",
    ),
    "spatial_decay": Query(
        lambda s, d: six(comp.spatial_decay(across(s, d), ["level"], "distance_um", ["contact", "level"], 50).select("contact", "level", "median", "rho", F.expr("rho_lo <= rho AND rho <= rho_hi").alias("around"))),
        f"""WITH {ACROSS}, rk AS (SELECT *, rank() OVER (PARTITION BY level ORDER BY distance_um) + (count(*) OVER (PARTITION BY level, distance_um) - 1) / 2.0 AS a,
       rank() OVER (PARTITION BY level ORDER BY median) + (count(*) OVER (PARTITION BY level, median) - 1) / 2.0 AS b FROM ac
), rh AS (SELECT level, corr(a, b) AS rho FROM rk GROUP BY level HAVING count(*) >= 3)
SELECT contact, level, round(median, 6) AS median, round(rho, 6) AS rho, CASE WHEN rho IS NOT NULL THEN true END AS around FROM ac LEFT JOIN rh USING (level)""",
    ),
    "charge_dependence": Query(
        lambda s, d: six(comp.charge_dependence(trials(s, d), trials(s, d).groupBy("run_id").agg(F.max("response").alias("amplitude"), (F.count("*") * 100).alias("phase")), ["run_id", "band"], "metric", 50)
                         .select("run_id", "band", "n", "median", "charge_nc", F.expr("lo <= median AND median <= hi").alias("around"))),
        f"""WITH {TRIALS}, r AS (SELECT run_id, max(response) * count(*) * 100 * 1e-3 AS charge_nc FROM tr GROUP BY run_id)
SELECT run_id, band, count(*) AS n, round(quantile_cont(metric, 0.5), 6) AS median, round(any_value(charge_nc), 6) AS charge_nc, true AS around FROM tr JOIN r USING (run_id) GROUP BY run_id, band""",
    ),
    "drift_early_else_late": Query(
        lambda s, d: six(comp.drift(windowed(s, d), ["contact", "band"], ["run_id", "event_number", "part"], "metric", 5)),
        f"""WITH {WINDOWED}, e AS (SELECT *, bool_or(wn = 'early') OVER (PARTITION BY contact, band) AS has FROM wt
), p AS (SELECT contact, band, wn, metric, row_number() OVER (PARTITION BY contact, band ORDER BY run_id, event_number, part) AS rn, count(*) OVER (PARTITION BY contact, band) AS total
  FROM e WHERE wn = CASE WHEN has THEN 'early' ELSE 'late' END
), f AS (SELECT *, rn <= CASE WHEN total < 10 THEN greatest(1, total // 2) ELSE 5 END AS head, rn > CASE WHEN total < 10 THEN greatest(1, total // 2) ELSE total - 5 END AS tail FROM p
), q AS (SELECT contact, band, wn, count(*) FILTER (WHERE head) AS n_first, count(*) FILTER (WHERE tail) AS n_last, quantile_cont(metric, 0.5) FILTER (WHERE head) AS a,
                quantile_cont(metric, 0.5) FILTER (WHERE tail) AS b FROM f GROUP BY contact, band, wn)
SELECT contact, band, wn AS "window", n_first, n_last, round(a, 6) AS first_median, round(b, 6) AS last_median, round(b - a, 6) AS change FROM q""",
    ),
    "delivered_fractions": Query(
        lambda s, d: six(comp.delivered(gate.validation(runs(s, d)))),
        f"""WITH {RUNS} SELECT run_id, n_commanded, n_detected, compliance, round(CASE WHEN n_commanded > 0 THEN n_detected / n_commanded END, 6) AS delivered_fraction FROM va WHERE n_detected > 0""",
    ),
    "run_metadata_json": Query(
        lambda s, d: gate.validation(runs(s, d)).withColumn("detected", F.col("n_detected").cast("long")).transform(
            lambda v: v.select("run_id", comp.as_json(v, "run_id", "status", "detected", "compliance", "count_match", "warnings").alias("json"))),
        f"""WITH {RUNS} SELECT run_id, CAST(to_json({{'run_id': run_id, 'status': status, 'detected': CAST(n_detected AS BIGINT), 'compliance': compliance, 'count_match': count_match, 'warnings': warnings}}) AS VARCHAR) AS json FROM va""",
    ),
}

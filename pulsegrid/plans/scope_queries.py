"""Captures and clock offsets on the driver's tables: a channel is a capture in hours, and an envelope a bin a sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scope
from .bindings import SIGNAL, signal
from .query import Query
from .signal_queries import SAMPLES, numbered
from .summary_queries import six

HOURS = scope.Capture(pre=200.0, merge=300.0, high=0.4, high_sd=1.0, low_sd=0.5)


def captured(s, d):
    return signal(s, d).select(F.col("channel").alias("run_id"), (F.col("t") / 3.6e9).alias("epoch_s"), F.col("value").alias("lead"))


def runs(s, d):
    first = captured(s, d).groupBy("run_id").agg((F.min("epoch_s") + 100).alias("onset_s"))
    return first.withColumns({"n_expected": F.lit(30), "width_s": F.lit(24.0), "interval_s": F.lit(96.0)})


def found(s, d):
    return scope.scope_pulses(captured(s, d), runs(s, d), HOURS)


def markers_of(s, d):
    return numbered(s, d).where("kind = 'error'").select("run_id", (F.col("idx") / 100).alias("start_s"))


PULSES = SIGNAL + """, r AS (SELECT channel AS run_id, min(t / 36e8) + 100 AS onset FROM s GROUP BY channel
), w AS (SELECT run_id, t / 36e8 AS e, value AS lead FROM s JOIN r ON channel = run_id WHERE t / 36e8 >= onset - 200 AND t / 36e8 <= onset + 30 * 120e0 * 15e-1 + 10
), c AS (SELECT run_id, quantile_cont(lead, 0.5) AS m FROM w GROUP BY run_id HAVING count(*) >= 10
), dv AS (SELECT run_id, e, abs(lead - m) AS dev FROM w JOIN c USING (run_id)
), sp AS (SELECT run_id, quantile_cont(dev, 0.5) AS half, quantile_cont(dev, 0.995) AS top FROM dv GROUP BY run_id
), md AS (SELECT run_id, any_value(top) AS top, 14826e-4 * quantile_cont(abs(dev - half), 0.5) AS sd FROM dv JOIN sp USING (run_id) GROUP BY run_id
), l AS (SELECT run_id, e, dev > greatest(5e-2 * top, 5e-1 * sd) AS above, dev > greatest(4e-1 * top, sd) AS active FROM dv JOIN md USING (run_id)
), ch AS (SELECT *, sum(CASE WHEN coalesce(e - le >= 300 OR NOT la, true) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY e) AS chain
  FROM (SELECT *, lag(e) OVER (PARTITION BY run_id ORDER BY e) AS le, lag(above) OVER (PARTITION BY run_id ORDER BY e) AS la FROM l)
), f AS (SELECT *, min(e) OVER (PARTITION BY run_id, chain) AS foot FROM ch
), a AS (SELECT *, sum(CASE WHEN coalesce(e - pe > 300, true) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY e) AS part
  FROM (SELECT *, lag(e) OVER (PARTITION BY run_id ORDER BY e) AS pe FROM f WHERE active)
), g AS (SELECT run_id, arg_min(foot, e) AS edge, max(e) AS z FROM a GROUP BY run_id, part HAVING count(*) >= 3
), pu AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY edge) - 1 AS pulse, edge AS edge_s, z - edge AS width_s FROM g WHERE z - edge >= 1e-1 * 24)"""

QUERIES = {
    "scope_pulses": Query(
        lambda s, d: six(found(s, d)),
        f"WITH {PULSES} SELECT run_id, CAST(pulse AS INT) AS pulse, round(edge_s, 6) AS edge_s, round(width_s, 6) AS width_s FROM pu",
    ),
    "scope_summary": Query(
        lambda s, d: six(scope.scope_summary(found(s, d), runs(s, d), HOURS)),
        f"""WITH {PULSES}, p AS (SELECT run_id, count(*) AS n, quantile_cont(step, 0.5) AS period
  FROM (SELECT run_id, edge_s - lag(edge_s) OVER (PARTITION BY run_id ORDER BY edge_s) AS step FROM pu) GROUP BY run_id)
SELECT run_id, coalesce(n, 0) AS n_pulses, round(period, 6) AS period_s, concat_ws('|', CASE WHEN n IS NULL THEN 'no_pulses' WHEN n <> 30 THEN 'count_differs' END,
       CASE WHEN abs(period - 120) > 24 THEN 'period_differs' END) AS issues FROM r LEFT JOIN p USING (run_id)""",
    ),
    "scope_clock_offsets": Query(
        lambda s, d: six(scope.clock_offsets(numbered(s, d).select("run_id", F.col("idx").alias("bin"), F.col("value").alias("z")), markers_of(s, d), 0.01, 0.05, 0.01, 0.005, 1.5)),
        f"""WITH {SAMPLES}, b AS (SELECT run_id, idx AS "at", lead(value, 1) OVER w - lag(value, 2) OVER w AS contrast, idx, total FROM i WINDOW w AS (PARTITION BY run_id ORDER BY idx)
), ok AS (SELECT * FROM b WHERE idx >= 2 AND idx + 2 < total
), tr AS (SELECT o.run_id, k, onset - 5 + k AS "at" FROM o, range(0, 11) AS r(k)
), sc AS (SELECT tr.run_id, k, coalesce(avg(contrast), 0) AS score FROM tr LEFT JOIN ok ON ok.run_id = tr.run_id AND ok."at" = tr."at" GROUP BY tr.run_id, k
), be AS (SELECT run_id, max(score) AS top, arg_max(k, (score, -k)) AS best FROM sc GROUP BY run_id
), fa AS (SELECT sc.run_id, avg(score) AS m, stddev_pop(score) AS sd, count(*) AS n FROM sc JOIN be USING (run_id) WHERE k <> best GROUP BY sc.run_id
), zz AS (SELECT be.run_id, best * 1e-2 - 5e-2 AS delta_s, CASE WHEN n >= 10 AND sd > 0 THEN (top - m) / sd END AS z FROM be LEFT JOIN fa USING (run_id))
SELECT run_id, round(delta_s, 6) + 0.0 AS delta_s, round(z, 6) AS z, coalesce(z >= 15e-1, false) AS aligned FROM zz""",
    ),
    "scope_pulse_phases": Query(lambda s, d: six(scope.phase_summary(scope.pulse_phases(
        captured(s, d), runs(s, d), found(s, d), HOURS, scope.Phases(grid=4.0, before=24.0, behind=48.0, slack=4.0))))),
}

"""Session-level operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gating as gate
from ..operators import regression as reg
from ..operators import sequence as seq
from ..operators import session as ses
from .bindings import DAY, HOUR, MARKERS, SIGNAL, TRIALS, load, markers, signal, trials
from .query import Query
from .summary_queries import BLOCKS, runs, six


def suppliers(s, d):
    return load(s, d, "supplier").select(F.col("s_suppkey").alias("contact"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 200).alias("ohms"), "s_name")


def trial_powers(s, d):
    return trials(s, d).select("run_id", "event_number", "contact", "band", "win", (F.col("discount") + 0.01).alias("base"), (F.col("tax") + 0.01).alias("post"), (F.col("response") > 10).alias("ok"))


def sweep(s, d):
    """Parts as runs of a sweep: three settings, the arms' own among them, and what must not differ."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    dsp = F.when(k % 3 == 1, size / 8).otherwise(0.0)
    return load(s, d, "part").select(
        k.alias("run_id"), F.when(k % 3 == 1, 0.1 + k % 2 * F.lit(0.01)).when(k % 3 == 2, 1.0).otherwise(size * size / 10).alias("lower"), dsp.alias("dsp"),
        F.when(k % 3 == 2, size * 150).otherwise(7500.0 + k % 4 * 100).alias("upper"), (dsp > 0).alias("dsp_enabled"),
        (k % 400 == 399).alias("amp_settle"), F.lit(30000.0).alias("rate"),
    )


def evidence(s, d):
    """Trials as evidence of what sets the recovery, one row for each contact and window."""
    t, c = trials(s, d), F.col
    groups = ses.largest_deviation(t, ["contact", "win"], "band", "response").withColumnRenamed("deviation", "amplitude_dev")
    per = t.groupBy("contact", "win").agg(
        (F.avg("response") / 25).alias("tau_ratio"), F.avg((c("band") == "O").cast("int")).alias("same_sign"), (F.avg("discount") * 5).alias("f1"),
        (F.avg("tax") * 27).alias("f2"), F.when(c("contact") % 3 == 0, (F.avg("tax") * 1000 - 40) * 5).alias("impedance_dev"),
    )
    per = per.withColumn("current_shift", F.when(c("contact") % 5 == 0, 30.0)).withColumn("dead_shorter", c("contact") % 4 == 0)
    return per.withColumn("other_dev", F.lit(None).cast("double")).withColumn("other_shift", F.lit(None).cast("double")).join(groups, ["contact", "win"], "left")


def placed(s, d):
    return ses.replicates(ses.assign_arms(sweep(s, d)), "run_id")


def _close(a: str, b: str, t: str = "1.25") -> str:
    return f"CASE WHEN {a} <= 0 OR {b} <= 0 THEN {a} <= 0 AND {b} <= 0 ELSE abs(ln({a} / {b})) <= ln({t}) END"


SWEEP = f"""sw AS (
  SELECT p_partkey AS run_id, CASE WHEN p_partkey % 3 = 1 THEN 1e-1 + p_partkey % 2 * 1e-2 WHEN p_partkey % 3 = 2 THEN 1e0 ELSE CAST(p_size AS DOUBLE) * p_size / 10 END AS lower,
         CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size AS DOUBLE) / 8 ELSE 0e0 END AS dsp,
         CASE WHEN p_partkey % 3 = 2 THEN p_size * 15e1 ELSE 75e2 + p_partkey % 4 * 100 END AS upper, p_partkey % 3 = 1 AND p_size > 0 AS dsp_enabled,
         p_partkey % 400 = 399 AS amp_settle, 3e4 AS rate FROM part
), aa AS (
  SELECT *, 'A' AS arm, 'lower' AS knob, lower AS knob_value FROM sw WHERE {_close("dsp", "0e0")} AND {_close("upper", "75e2")}
  UNION ALL SELECT *, 'B', 'dsp', dsp FROM sw WHERE {_close("lower", "1e-1")} AND {_close("upper", "75e2")}
  UNION ALL SELECT *, 'C', 'upper', upper FROM sw WHERE {_close("lower", "1e0")} AND {_close("dsp", "0e0")}
)"""
PLACED = SWEEP + f""", hd AS (
  SELECT arm, min(knob_value) AS head FROM aa GROUP BY arm
  UNION ALL
  SELECT hd.arm, (SELECT min(knob_value) FROM aa WHERE aa.arm = hd.arm AND aa.knob_value > hd.head AND NOT {_close("hd.head", "aa.knob_value", "1.02")}) FROM hd WHERE hd.head IS NOT NULL
), ph AS (
  SELECT aa.*, (SELECT max(head) FROM hd WHERE hd.arm = aa.arm AND head <= knob_value) AS head FROM aa
), pl AS (
  SELECT *, CASE WHEN count(*) OVER w = 1 THEN '' WHEN row_number() OVER v <= 26 THEN chr(CAST(96 + row_number() OVER v AS INT)) ELSE CAST(row_number() OVER v AS VARCHAR) END AS replicate FROM ph
  WINDOW w AS (PARTITION BY arm, head), v AS (PARTITION BY arm, head ORDER BY knob_value, run_id)
)"""

def log_slopes(s, d):
    """Log-log slopes of a trial's metric on its response, with the limits of least squares."""
    y, x = F.ln("metric"), F.ln("response")
    per = trials(s, d).where("metric > 0 AND response > 0").groupBy("contact", "win").agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    error = F.when(F.col("n") > 2, F.sqrt(F.greatest(F.lit(0.0), F.col("syy") / F.col("sxx") - F.col("b") * F.col("b")) / (F.col("n") - 2)))
    return per.withColumn("lo", F.col("b") - 1.96 * error).withColumn("hi", F.col("b") + 1.96 * error)


QUERIES = {
    "healthy_channels": Query(
        lambda s, d: ses.healthy_channels(suppliers(s, d), "ohms").select("contact", "ohms"),
        "SELECT s_suppkey AS contact, s_acctbal * 200 AS ohms FROM supplier WHERE s_acctbal > 0 AND s_acctbal * 200 <= 1e6",
    ),
    "open_channels_dropped": Query(
        lambda s, d: ses.drop_open_channels(trials(s, d).select("run_id", "event_number", "contact"), trials(s, d).select("contact", F.col("metric").alias("z")), "contact", "z", 104861.0),
        f"WITH {TRIALS} SELECT run_id, event_number, contact FROM tr WHERE contact NOT IN (SELECT contact FROM tr GROUP BY contact HAVING max(metric) > 104861)",
    ),
    "wiring_terms": Query(
        lambda s, d: ses.by_terms(load(s, d, "part").select("p_partkey", "p_type"), "p_type", ["ECO", "medium", "small"], ["small"]),
        "SELECT p_partkey, p_type FROM part WHERE (contains(lower(p_type), 'eco') OR contains(lower(p_type), 'medium')) AND NOT contains(lower(p_type), 'small')",
    ),
    "window_slice_and_mask": Query(
        lambda s, d: ses.amplitude_mask(ses.slice_window(signal(s, d), "event_id", 100, 5000), "value", 20.0, 60.0).select("channel", "event_id", "value"),
        f"WITH {SIGNAL} SELECT channel, event_id, value FROM s WHERE event_id >= 100 AND event_id < 5000 AND value BETWEEN 20 AND 60",
    ),
    "distance_enrichment": Query(
        lambda s, d: six(trials(s, d).select("run_id", "event_number", "contact", ses.contact_distance(F.col("contact"), F.col("run_id") % 32, 25.0).alias("distance_um")).join(
            suppliers(s, d).select("contact", "ohms"), "contact", "left")),
        f"""WITH {TRIALS} SELECT run_id, event_number, contact, abs(contact - run_id % 32) * 25.0 AS distance_um, round(CASE WHEN s_acctbal > 0 THEN s_acctbal * 200 END, 6) AS ohms
FROM tr LEFT JOIN supplier ON s_suppkey = contact""",
    ),
    "equal_length_windows": Query(
        lambda s, d: ses.common_length(signal(s, d).withColumn("side", F.when(F.col("kind").isin("view", "click"), "base").otherwise("post")), ["channel"], "side", ["t", "event_id"]).select("channel", "event_id", "side"),
        f"""WITH {SIGNAL}, p AS (SELECT *, CASE WHEN kind IN ('view', 'click') THEN 'base' ELSE 'post' END AS side FROM s
), n AS (SELECT *, least(count(*) FILTER (WHERE side = 'base') OVER (PARTITION BY channel), count(*) FILTER (WHERE side = 'post') OVER (PARTITION BY channel)) AS n,
         row_number() OVER (PARTITION BY channel, side ORDER BY t, event_id) AS up, count(*) OVER (PARTITION BY channel, side) AS total FROM p)
SELECT channel, event_id, side FROM n WHERE CASE WHEN side = 'base' THEN up > total - n ELSE up <= n END""",
    ),
    "comparison_within_epoch": Query(
        lambda s, d: six(ses.within_epoch(trial_powers(s, d), ["contact", "band", "win"], F.col("ok"), "base", "post")),
        f"""WITH {TRIALS}, x AS (SELECT contact, band, win, CASE WHEN response > 10 THEN 10 * log10((tax + 0.01) / (discount + 0.01)) END AS db FROM tr)
SELECT contact, band, win, count(db) AS n_pairs, count(*) - count(db) AS n_dropped, round(quantile_cont(db, 0.5), 6) + 0.0 AS median_db, round(avg(db), 6) + 0.0 AS mean_db FROM x GROUP BY contact, band, win""",
    ),
    "comparison_block_vs_baseline": Query(
        lambda s, d: six(ses.versus_reference(trials(s, d).where("band = 'F'"), trials(s, d).where("band = 'O'"), ["contact"], "metric", ["run_id", "event_number", "part", "metric"])),
        f"""WITH {TRIALS}, n AS (SELECT contact, count(*) AS n, avg(metric) AS mean FROM tr WHERE band = 'F' GROUP BY contact
), p AS (SELECT contact, metric, row_number() OVER (PARTITION BY contact ORDER BY run_id, event_number, part, metric) AS rn FROM tr WHERE band = 'O'
), r AS (SELECT contact, avg(metric) AS ref_mean, count(*) AS n_ref FROM p JOIN n USING (contact) WHERE rn <= n GROUP BY contact)
SELECT contact, n, round(mean, 6) AS mean, round(ref_mean, 6) AS ref_mean, n_ref, round(10 * log10(mean / ref_mean), 6) + 0.0 AS db FROM n JOIN r USING (contact)""",
    ),
    "comparison_across_amplitude": Query(
        lambda s, d: six(trials(s, d).where("response > 10").groupBy("contact", F.floor(F.col("response") / 10).alias("amplitude"), "band").agg(F.percentile("metric", 0.5).alias("median"), F.count("*").alias("n"))),
        f"WITH {TRIALS} SELECT contact, CAST(floor(response / 10) AS BIGINT) AS amplitude, band, round(quantile_cont(metric, 0.5), 6) AS median, count(*) AS n FROM tr WHERE response > 10 GROUP BY ALL",
    ),
    "noise_floor": Query(
        lambda s, d: six(ses.noise_floor(trials(s, d).join(suppliers(s, d), "contact", "left"), ["contact"], "response", "ohms")),
        f"""WITH {TRIALS}, j AS (SELECT contact, response, CASE WHEN s_acctbal > 0 THEN s_acctbal * 200 END AS z FROM tr LEFT JOIN supplier ON s_suppkey = contact
), q AS (SELECT contact, quantile_cont(response, 0.25) AS q25, quantile_cont(response, 0.5) AS m, quantile_cont(response, 0.75) AS q75, first(z) AS z FROM j GROUP BY contact)
SELECT contact, round(q25, 6) AS q25, round(m, 6) AS median, round(q75, 6) AS q75, round(CASE WHEN z > 0 THEN m / sqrt(z / 1000) END, 6) AS per_root_kohm FROM q""",
    ),
    "compliance_fraction": Query(
        lambda s, d: six(ses.fraction(trials(s, d), ["contact", "win"], F.col("tax") >= 0.06)),
        f"WITH {TRIALS} SELECT contact, win, count(*) AS n, count(*) FILTER (WHERE tax >= 0.06) AS n_true, round(count(*) FILTER (WHERE tax >= 0.06) / count(*), 6) AS fraction FROM tr GROUP BY contact, win",
    ),
    "arm_assignment": Query(
        lambda s, d: ses.assign_arms(sweep(s, d)).select("run_id", "arm", "knob", "knob_value"),
        f"WITH {SWEEP} SELECT run_id, arm, knob, knob_value FROM aa",
    ),
    "arm_replicates": Query(
        lambda s, d: placed(s, d).select("run_id", "arm", "knob_value", "replicate"),
        f"WITH RECURSIVE {PLACED} SELECT run_id, arm, knob_value, replicate FROM pl",
    ),
    "duplicate_policy_last": Query(
        lambda s, d: ses.duplicates(placed(s, d), "run_id", "last").select("run_id", "arm", "knob_value"),
        f"""WITH RECURSIVE {PLACED}, kp AS (SELECT *, max(run_id) FILTER (WHERE replicate <> '') OVER (PARTITION BY arm) AS kept FROM pl)
SELECT run_id, arm, knob_value FROM kp WHERE replicate = '' OR run_id = kept""",
    ),
    "one_knob_check": Query(
        lambda s, d: ses.one_knob(ses.assign_arms(sweep(s, d)), "run_id", ["rate", "amp_settle", "dsp_enabled"]),
        f"""WITH {SWEEP}, f AS (
  SELECT *, first_value(lower) OVER w AS fl, first_value(dsp) OVER w AS fd, first_value(upper) OVER w AS fu, first_value(rate) OVER w AS fr, first_value(amp_settle) OVER w AS fa,
         first_value(dsp_enabled) OVER w AS fe FROM aa WINDOW w AS (PARTITION BY arm ORDER BY run_id)
), g AS (
  SELECT arm, count(*) AS n_runs, concat_ws('|', CASE WHEN bool_or(knob <> 'lower' AND NOT ({_close("lower", "fl")})) THEN 'lower' END, CASE WHEN bool_or(knob <> 'dsp' AND NOT ({_close("dsp", "fd")})) THEN 'dsp' END,
           CASE WHEN bool_or(knob <> 'upper' AND NOT ({_close("upper", "fu")})) THEN 'upper' END, CASE WHEN bool_or(rate <> fr) THEN 'rate' END,
           CASE WHEN bool_or(amp_settle <> fa) THEN 'amp_settle' END, CASE WHEN bool_or(knob = 'dsp' AND dsp_enabled <> fe AND least(dsp, fd) > 0) THEN 'dsp_enabled' END) AS violations,
         count(DISTINCT CASE WHEN knob_value > 0 THEN round(ln(knob_value), 3) ELSE -99 END) AS n_levels FROM f GROUP BY arm)
SELECT arm, n_runs, violations, n_levels, violations = '' AND n_levels > 1 AS ok FROM g""",
    ),
    "session_settings": Query(
        lambda s, d: ses.single_valued(trials(s, d).withColumn("half", F.bround(F.col("response") / 25) * 0.5), "run_id", "half"),
        f"""WITH {TRIALS}, v AS (SELECT DISTINCT run_id, round_even(response / 25, 0) * 0.5 AS h FROM tr)
SELECT run_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS distinct_values, count(*) = 1 AS single FROM v GROUP BY run_id""",
    ),
    "diagnosis_labels": Query(
        lambda s, d: six(ses.diagnosis(evidence(s, d)).select("contact", "win", "invariant", "tail_fraction", "dsp_fraction", "origin", "qualifiers")),
        f"""WITH {TRIALS}, p AS (SELECT contact, win, quantile_cont(response, 0.5) AS al FROM tr GROUP BY contact, win
), b AS (SELECT contact, win, band, quantile_cont(response, 0.5) AS m FROM tr GROUP BY ALL HAVING count(*) >= 10
), dv AS (SELECT contact, win, 100 * max(abs(m / al - 1)) AS dev FROM b JOIN p USING (contact, win) GROUP BY ALL
), g AS (
  SELECT contact, win, avg(response) / 25 AS r, avg(CASE WHEN band = 'O' THEN 1 ELSE 0 END) AS s, avg(discount) * 5 AS f1, avg(tax) * 27 AS f2,
         CASE WHEN contact % 3 = 0 THEN (avg(tax) * 1000 - 40) * 5 END AS idev, CASE WHEN contact % 5 = 0 THEN 30e0 END AS cs, contact % 4 = 0 AS ds FROM tr GROUP BY contact, win
), e AS (SELECT g.*, dev FROM g LEFT JOIN dv USING (contact, win)
), i AS (SELECT *, CASE WHEN greatest(abs(dev), abs(idev)) IS NOT NULL THEN greatest(abs(dev), abs(idev)) <= 20 WHEN cs IS NOT NULL THEN abs(cs) <= 20 ELSE false END AS inv,
         abs(r - 1) <= 0.2 AS mt, s < 0.5 AS op, coalesce(abs(cs) > 20, false) OR coalesce(dev > 20, false) AS cu, coalesce(idev > 20, false) AS im FROM e)
SELECT contact, win, inv AS invariant, round(1 - f1, 6) AS tail_fraction, round(1 - f2, 6) AS dsp_fraction,
       CASE WHEN NOT op AND ds THEN 'mixed_biological' WHEN NOT op THEN 'front_end' WHEN mt AND NOT inv THEN 'mixed_condition'
            WHEN mt AND f1 <= 0.25 THEN 'filter' WHEN im AND NOT cu THEN 'electrode' ELSE 'mixed' END AS origin,
       CASE WHEN NOT op AND NOT ds THEN concat_ws('|', CASE WHEN cu THEN 'current' END, CASE WHEN im THEN 'impedance' END,
            CASE WHEN f2 > 1.1 THEN 'filter_shortens' END) ELSE '' END AS qualifiers FROM i""",
    ),
    "decomposition_prediction": Query(
        lambda s, d: six(trials(s, d).select("run_id", "event_number", "contact", "part", ses.exit_time(F.col("metric") / 10, 100.0, F.col("discount") * 100, F.col("response")).alias("predicted_ms")), "predicted_ms"),
        f"WITH {TRIALS} SELECT run_id, event_number, contact, part, round(CASE WHEN metric / 10 > 100 THEN discount * 100 + response * ln(metric / 10 / 100) END, 6) AS predicted_ms FROM tr",
    ),
    "slope_verdicts": Query(
        lambda s, d: six(reg.slope_verdict(log_slopes(s, d), "lo", "hi").select("contact", "win", "lo", "hi", "verdict")),
        f"""WITH {TRIALS}, l AS (SELECT contact, win, ln(metric) AS y, ln(response) AS x FROM tr WHERE metric > 0 AND response > 0
), r AS (SELECT contact, win, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM l GROUP BY contact, win
), i AS (SELECT contact, win, b - 196e-2 * e AS lo, b + 196e-2 * e AS hi FROM (SELECT *, CASE WHEN n > 2 THEN sqrt(greatest(0, syy / sxx - b * b) / (n - 2)) END AS e FROM r))
SELECT contact, win, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo IS NULL OR hi IS NULL THEN 'insufficient'
  WHEN lo >= 0.75 AND hi <= 1.25 OR lo <= 1 AND hi >= 1 AND NOT (lo <= 0 AND hi >= 0) AND hi - lo < 1 THEN '~1'
  WHEN lo >= -0.25 AND hi <= 0.25 OR lo <= 0 AND hi >= 0 AND NOT (lo <= 1 AND hi >= 1) THEN 'flat' ELSE 'intermediate' END AS verdict FROM i""",
    ),
    "event_chunks": Query(
        lambda s, d: ses.chunks(markers(s, d), ["channel"], ["t", "event_id"], 5).groupBy("channel", "part").agg(F.count("*").alias("n"), F.min("t").alias("first_t")),
        f"""WITH {MARKERS}, c AS (SELECT channel, t, (row_number() OVER (PARTITION BY channel ORDER BY t, event_id) + 4) // 5 AS part FROM m)
SELECT channel, part, count(*) AS n, min(t) AS first_t FROM c GROUP BY channel, part""",
    ),
    "rename_plan": Query(
        lambda s, d: ses.rename_plan(load(s, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).when(F.col("p_partkey") % 5 != 1, F.col("p_brand")).alias("target")), "p_name", "target", "p_partkey").select("p_partkey", "status", "new_name"),
        """WITH t AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 5 <> 1 THEN p_brand END AS target FROM part
), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p_partkey) AS place FROM t)
SELECT p_partkey, CASE WHEN target IS NULL THEN 'skip' WHEN target = p_name THEN 'already_named' ELSE 'rename' END AS status,
       CASE WHEN target IS NOT NULL AND place > 1 THEN target || '__' || place ELSE target END AS new_name FROM r""",
    ),
    "epochs_without_gaps": Query(
        lambda s, d: ses.gap_free(
            markers(s, d).select("channel", "event_id", (F.col("t") - DAY).alias("start"), (F.col("t") + DAY).alias("end")),
            signal(s, d).withColumn("j", F.col("t") - F.lag("t").over(seq.along(["channel"], ["t", "event_id"]))).where(F.col("j") > 18 * HOUR).select("channel", F.col("t").alias("gap_at")), "channel"),
        f"""WITH {MARKERS}, g AS (SELECT channel, t AS gap_at, t - lag(t) OVER (PARTITION BY channel ORDER BY t, event_id) AS j FROM s)
SELECT channel, event_id, t - {DAY} AS "start", t + {DAY} AS "end" FROM m
WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.channel = m.channel AND j > {18 * HOUR} AND gap_at > m.t - {DAY} AND gap_at < m.t + {DAY})""",
    ),
    "diagnosis_run_selection": Query(
        lambda s, d: ses.diagnosis_runs(gate.blocks(gate.validation(runs(s, d)), "session")).select("session", "run_id", "keep", "left_out"),
        f"""WITH {BLOCKS}, f AS (SELECT *, exclusion_reason = '' AND status IN ('ok', 'no_stim') AS included,
  status = 'ok' AND n_detected > 0 AND block IN ('block1', 'block2') AND ipi_s >= 0.3 AS single FROM b4
), k AS (SELECT *, included AND NOT compliance AND single AS keep FROM f)
SELECT session, run_id, keep, CASE WHEN keep THEN '' WHEN exclusion_reason <> '' THEN exclusion_reason WHEN n_detected = 0 THEN 'no_stim' WHEN NOT single THEN 'paired_or_train' ELSE 'excluded' END AS left_out FROM k""",
    ),
    "polarity_override": Query(
        lambda s, d: ses.polarity_override(load(s, d, "part").select("p_partkey", (F.col("p_size") - 25).cast("double").alias("amplitude"), F.when(F.col("p_partkey") % 5 != 4, (F.col("p_partkey") % 3 - 1).cast("int")).alias("lead"),
                                                                     F.when(F.col("p_partkey") % 2 == 0, "unsure").otherwise("").alias("flags")), "amplitude", "lead", "flags"),
        """WITH x AS (SELECT p_partkey, CAST(p_size - 25 AS DOUBLE) AS amplitude, CASE WHEN p_partkey % 5 <> 4 THEN CAST(p_partkey % 3 - 1 AS INT) END AS lead, CASE WHEN p_partkey % 2 = 0 THEN 'unsure' ELSE '' END AS flags FROM part
), y AS (SELECT *, coalesce(lead <> 0 AND sign(amplitude) <> lead, false) AS other FROM x)
SELECT p_partkey, CASE WHEN other THEN lead * abs(amplitude) ELSE amplitude END AS amplitude, lead,
       CASE WHEN NOT other THEN flags WHEN flags <> '' THEN flags || '|polarity_from_scope' ELSE 'polarity_from_scope' END AS flags FROM y""",
    ),
    "recovery_by_contact_group": Query(
        lambda s, d: six(ses.recovery_table(
            trials(s, d).select("win", F.when(F.col("contact") % 10 == 0, "stim").otherwise("recording").alias("contacts"), F.col("response"), (F.col("discount") * 100 - 2).alias("rail"), (F.col("metric") / 1000 - 40).alias("drift")),
            ["win", "contacts"], "response", "rail", F.col("response") >= 49, "drift")),
        f"""WITH {TRIALS}, x AS (SELECT win, CASE WHEN contact % 10 = 0 THEN 'stim' ELSE 'recording' END AS contacts, response, discount * 100 - 2 AS rail, metric / 1000 - 40 AS drift FROM tr)
SELECT win, contacts, count(*) AS n, round(quantile_cont(response, 0.25), 6) AS q25, round(quantile_cont(response, 0.5), 6) AS median, round(quantile_cont(response, 0.75), 6) AS q75,
       round(quantile_cont(rail, 0.5), 6) AS median_rail, count(*) FILTER (WHERE response >= 49) AS n_censored, round(count(*) FILTER (WHERE response >= 49) / count(*), 6) AS censored,
       round(count(*) FILTER (WHERE rail <= 0) / count(*), 6) AS zero_rail, round(count(*) FILTER (WHERE abs(drift) > 25) / count(*), 6) AS drifting, round(quantile_cont(abs(drift), 0.5), 6) AS median_drift
FROM x GROUP BY win, contacts""",
    ),
    "retained_annotation": Query(
        lambda s, d: ses.annotate_retained(
            trials(s, d).select("run_id", "event_number", "part", F.when(F.col("win") == "A", "early").when(F.col("win") == "R", "late").otherwise("baseline").alias("window")),
            trials(s, d).groupBy("run_id", "event_number").agg((F.max("response") > 20).alias("retained_early"), (F.min("discount") < 0.05).alias("retained_late")), ["run_id", "event_number"], "window"),
        f"""WITH {TRIALS}, k AS (SELECT run_id, event_number, max(response) > 20 AS e, min(discount) < 0.05 AS l FROM tr GROUP BY ALL)
SELECT tr.run_id, tr.event_number, part, CASE WHEN win = 'A' THEN 'early' WHEN win = 'R' THEN 'late' ELSE 'baseline' END AS "window",
       CASE WHEN win = 'A' THEN coalesce(e, false) WHEN win = 'R' THEN coalesce(l, false) ELSE true END AS retained FROM tr LEFT JOIN k ON k.run_id = tr.run_id AND k.event_number = tr.event_number""",
    ),
    "time_slice_bounds": Query(
        lambda s, d: ses.slice_bounds(load(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5000).alias("n_samples"), F.lit(100.0).alias("rate_hz")), 12.345, 33.333),
        """WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 5000 AS n_samples, 1e2 AS rate_hz FROM orders)
SELECT *, CASE WHEN 12.345 < n_samples / rate_hz THEN 1234 END AS lo, CASE WHEN 12.345 < n_samples / rate_hz THEN least(n_samples, 3334) END AS hi,
       CASE WHEN 12.345 < n_samples / rate_hz THEN '' ELSE 'starts after the recording ends' END AS error FROM r""",
    ),
    "half_even_samples": Query(
        lambda s, d: trials(s, d).select("run_id", "event_number", "part", F.bround(F.col("response") * 30.0 * F.col("discount")).cast("long").alias("sample")).distinct(),
        f"WITH {TRIALS} SELECT DISTINCT run_id, event_number, part, CAST(round_even(response * 3e1 * discount, 0) AS BIGINT) AS sample FROM tr",
    ),
}

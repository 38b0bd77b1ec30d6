"""Gating and summary operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gating as gate
from ..operators import summaries as summ
from .bindings import DAY, HOUR, MARKERS, SIGNAL, TRIALS, load, markers, signal, trials
from .query import Query


def six(df, *cols):
    """Doubles rounded to six places, all of them unless named."""
    picked = cols or [c for c, kind in df.dtypes if kind == "double"]
    return df.select(*[F.round(c, 6).alias(c) if c in picked else F.col(f"`{c}`") for c in df.columns])


# trials as recoveries: milliseconds 10..500 by quantity, censored at the top, contaminated by discount
GATES = gate.Gates(quantile=0.8, margin=5.0, epoch_end=480.0, post_length=200.0, post_start_max=420.0, early=250.0, late_start=410.0, min_trials=20)

RECOVERY = TRIALS + """, rc AS (
  SELECT *, response * 10 AS recovery, response >= 49 AS censored, discount >= 0.09 AS dirty, contact % 3 * 150.0 + 1 AS fl FROM tr
), qu AS (
  SELECT contact, band, count(*) AS n_trials, count(*) FILTER (WHERE censored) AS n_censored, count(*) FILTER (WHERE dirty) AS n_contaminated,
         quantile_cont(recovery, 0.25) AS p25, quantile_cont(recovery, 0.5) AS p50, quantile_cont(recovery, 0.75) AS p75,
         quantile_cont(recovery, 0.9) AS p90, quantile_cont(recovery, 0.8) AS recovery_q, max(recovery) AS recovery_max, max(fl) AS floor
  FROM rc GROUP BY contact, band
), ps AS (SELECT *, least(greatest(recovery_q + 5, floor), 480) AS post_start FROM qu
), pe AS (SELECT *, least(post_start + 200, 480) AS post_end FROM ps
), rt AS (
  SELECT rc.*, NOT censored AND NOT dirty AND recovery + 5 <= post_start AS retained_early,
         NOT censored AND NOT dirty AND recovery + 5 < 410 AS retained_late FROM rc JOIN pe USING (contact, band)
), kp AS (
  SELECT contact, band, count(*) FILTER (WHERE retained_early) AS n_retained_early, count(*) FILTER (WHERE retained_late) AS n_retained_late
  FROM rt GROUP BY contact, band
), cv AS (
  SELECT pe.*, n_retained_early, n_retained_late,
         CASE WHEN post_start <= 420 AND post_end > post_start AND n_retained_early >= 20 AND p50 <= 250 THEN 'early_ok'
              WHEN recovery_q + 5 < 410 AND n_retained_late >= 20 THEN 'late_only' ELSE 'unusable' END AS verdict
  FROM pe JOIN kp USING (contact, band)
)"""


def usable():
    return F.col("censored"), F.col("dirty")


def recoveries(s, d):
    return trials(s, d).select(
        "run_id", "event_number", "contact", "band", "part", (F.col("response") * 10).alias("recovery"),
        (F.col("response") >= 49).alias("censored"), (F.col("discount") >= 0.09).alias("dirty"),
    )


def windows(s, d):
    return gate.condition_windows(recoveries(s, d), ["contact", "band"], "recovery", *usable(), F.col("contact") % 3 * 150.0 + 1, GATES)


def runs(s, d):
    """Orders as runs: what was found, what settings, folder and manifest say."""
    k, c = F.col("o_orderkey"), F.col
    found = F.when(k % 11 == 0, 0).otherwise(20 - F.when(k % 7 == 0, 4).otherwise(0) + F.when(k % 19 == 0, 1).otherwise(0))
    amplitude = F.floor(c("o_totalprice") / 50000).cast("double") * 10 + k % 4 * F.lit(0.4)
    phase = 200.0 + F.when(k % 3 == 0, 100.0).otherwise(0.0) + k % 6 * F.lit(1.5)
    base = load(s, d, "orders").select(
        c("o_custkey").alias("session"), k.alias("run_id"), c("o_orderpriority").alias("label"), found.alias("n_detected"),
        amplitude.alias("amplitude"), phase.alias("phase"),
    )
    k = c("run_id")
    return base.select(
        "*", F.when(k % 37 == 0, "unreadable").alias("error"), (k % 5 != 0).alias("has_settings"), F.lit(30000.0).alias("rate"),
        F.when(k % 41 == 0, 30001.0).otherwise(30000.0).alias("settings_rate"), F.when(k % 13 == 0, 10).otherwise(1).alias("n_trains"),
        F.when(k % 5 != 0, F.when(k % 13 == 0, 2).otherwise(20)).alias("pulses_per_trigger"), F.when(k % 10 == 0, 20).alias("folder_pulses"),
        F.when(k % 13 == 0, 0.1).otherwise(1.0).alias("ipi_s"), F.when(k % 26 == 0, 150.0).otherwise(1000.0).alias("train_period_ms"),
        (k % 31 == 0).alias("compliance_bit"), F.when(k % 43 == 0, 2).otherwise(0).alias("gaps"), F.when(k % 3 == 0, 1).otherwise(-1).alias("first_sign"),
        F.when(k % 2 == 0, "NegativeFirst").when(k % 7 == 1, "").otherwise("PositiveFirst").alias("polarity_settings"),
        F.when(k % 6 != 0, 2.0).alias("step"), (c("amplitude") + k % 9 * F.lit(0.5)).alias("amplitude_settings"),
        (c("amplitude") - k % 8 * F.lit(0.4)).alias("amplitude_folder"), (c("phase") + k % 12 * F.lit(5.0)).alias("phase_settings"),
        F.when(k % 4 != 0, c("phase") - k % 13 * F.lit(5.0)).alias("phase_folder"), (k % 29 == 0).alias("impedance_missing"),
        F.when(k % 17 == 0, "Block2").when(k % 51 == 1, " ").alias("manifest_block"), F.when(k % 34 == 0, "no").when(k % 23 == 0, "Yes").alias("manifest_include"),
    )


RUNS = """r0 AS (
  SELECT o_custkey AS session, o_orderkey AS run_id, o_orderkey AS k, o_orderpriority AS label,
         CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 20 - CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 0 END + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END END AS n_detected,
         floor(o_totalprice / 50000) * 10 + o_orderkey % 4 * 4e-1 AS amplitude,
         2e2 + CASE WHEN o_orderkey % 3 = 0 THEN 1e2 ELSE 0e0 END + o_orderkey % 6 * 15e-1 AS phase
  FROM orders
), ru AS (
  SELECT *, CASE WHEN k % 37 = 0 THEN 'unreadable' END AS error, k % 5 <> 0 AS has_settings, 3e4 AS rate,
         CASE WHEN k % 41 = 0 THEN 30001e0 ELSE 3e4 END AS settings_rate, CASE WHEN k % 13 = 0 THEN 10 ELSE 1 END AS n_trains,
         CASE WHEN k % 5 = 0 THEN NULL WHEN k % 13 = 0 THEN 2 ELSE 20 END AS pulses_per_trigger, CASE WHEN k % 10 = 0 THEN 20 END AS folder_pulses,
         CASE WHEN k % 13 = 0 THEN 1e-1 ELSE 1e0 END AS ipi_s, CASE WHEN k % 26 = 0 THEN 150e0 ELSE 1e3 END AS train_period_ms,
         k % 31 = 0 AS compliance_bit, CASE WHEN k % 43 = 0 THEN 2 ELSE 0 END AS gaps, CASE WHEN k % 3 = 0 THEN 1 ELSE -1 END AS first_sign,
         CASE WHEN k % 2 = 0 THEN -1 WHEN k % 7 <> 1 THEN 1 END AS expected, CASE WHEN k % 6 <> 0 THEN 2e0 END AS step,
         amplitude + k % 9 * 5e-1 AS amplitude_settings, amplitude - k % 8 * 4e-1 AS amplitude_folder, phase + k % 12 * 5e0 AS phase_settings,
         CASE WHEN k % 4 <> 0 THEN phase - k % 13 * 5e0 END AS phase_folder, k % 29 = 0 AS impedance_missing,
         CASE WHEN k % 17 = 0 THEN 'block2' ELSE '' END AS named, CASE WHEN k % 34 = 0 THEN 'no' WHEN k % 23 = 0 THEN 'yes' ELSE '' END AS include
  FROM r0
), v0 AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN n_detected > 0 THEN 'ok' ELSE 'no_stim' END AS status, error IS NULL AND n_detected > 0 AS ok,
         has_settings AND coalesce(pulses_per_trigger, 0) > 0 AS by_settings FROM ru
), v1 AS (
  SELECT *, CAST(CASE WHEN ok AND by_settings THEN pulses_per_trigger * greatest(n_trains, 1) WHEN ok THEN folder_pulses END AS DOUBLE) AS n_commanded FROM v0
), va AS (
  SELECT *, n_commanded = n_detected AS count_match, ok AND (compliance_bit OR coalesce(n_detected < n_commanded, false)) AS compliance,
         CASE WHEN ok THEN amplitude * phase * 1e-3 END AS charge_nc,
         concat_ws('|', CASE WHEN error IS NULL AND NOT has_settings THEN 'no_settings' END,
           CASE WHEN error IS NULL AND has_settings AND abs(settings_rate - rate) > 0.5 THEN 'rate_differs' END,
           CASE WHEN ok AND NOT by_settings AND folder_pulses IS NOT NULL THEN 'count_from_folder' END,
           CASE WHEN ok AND n_detected < n_commanded THEN 'fewer_than_commanded' END, CASE WHEN ok AND n_detected > n_commanded THEN 'more_than_commanded' END,
           CASE WHEN ok AND abs(amplitude_settings - amplitude) > coalesce(step, 2e0) THEN 'amplitude_settings' END,
           CASE WHEN ok AND abs(amplitude_folder - amplitude) > coalesce(step, 2e0) THEN 'amplitude_folder' END,
           CASE WHEN ok AND abs(phase_settings - phase) > 15e5 / rate THEN 'phase_settings' END,
           CASE WHEN ok AND abs(phase_folder - phase) > 15e5 / rate THEN 'phase_folder' END,
           CASE WHEN ok AND expected <> first_sign THEN 'polarity' END, CASE WHEN error IS NULL AND gaps > 0 THEN 'gaps' END,
           CASE WHEN error IS NULL AND impedance_missing THEN 'no_impedance' END) AS warnings
  FROM v1
)"""
BLOCKS = RUNS + """, b0 AS (
  SELECT *, n_detected >= 2 AND (coalesce(pulses_per_trigger <= 2 AND train_period_ms <= 200, false) OR ipi_s < 0.2) AS pair FROM va
), b1 AS (SELECT *, status = 'ok' AND NOT pair AS single FROM b0
), pc AS (SELECT session, round_even(phase / 10, 0) * 10 AS p, count(*) AS n, min(run_id) AS seen FROM b1 WHERE single GROUP BY ALL
), pm AS (SELECT session, arg_max(p, (n, -seen)) AS usual FROM pc GROUP BY session
), b2 AS (SELECT b1.*, single AND abs(phase - usual) <= 10 AS ladder FROM b1 LEFT JOIN pm USING (session)
), ac AS (SELECT session, round_even(amplitude, 0) AS a, count(*) AS n, min(run_id) AS seen FROM b2 WHERE single AND NOT ladder GROUP BY ALL
), am AS (SELECT session, arg_max(a, (n, -seen)) AS sweep FROM ac GROUP BY session
), b3 AS (
  SELECT b2.*, coalesce(ladder AND abs(round_even(amplitude, 0) - sweep) <= 2, false) AS also,
         CASE WHEN named <> '' THEN named WHEN status = 'error' THEN 'error' WHEN status = 'no_stim' THEN 'baseline' WHEN pair THEN 'block3'
              WHEN ladder THEN 'block1' WHEN single THEN 'block2' ELSE 'other' END AS block
  FROM b2 LEFT JOIN am USING (session)
), b4 AS (
  SELECT *, CASE WHEN include = 'yes' THEN '' ELSE concat_ws('|', CASE WHEN status = 'error' THEN 'error' END, CASE WHEN block = 'block3' THEN 'block3' END,
         CASE WHEN compliance THEN 'compliance' WHEN status = 'ok' AND NOT count_match THEN 'count_mismatch' END, CASE WHEN include = 'no' THEN 'manifest' END) END AS exclusion_reason
  FROM b3
)"""


def tau(s, d):
    """Trials with covariates for the grouping summary."""
    li = trials(s, d)
    sup = load(s, d, "supplier").select(F.col("s_suppkey").alias("contact"), "s_acctbal", "s_nationkey")
    return summ.tertiles(li.join(sup, "contact"), "s_acctbal", "tertile")


TAU = TRIALS + """, jn AS (SELECT tr.*, s_acctbal, s_nationkey FROM tr JOIN supplier ON s_suppkey = contact
), lim AS (SELECT quantile_cont(s_acctbal, 0.333) AS low, quantile_cont(s_acctbal, 0.667) AS mid FROM jn
), ta AS (SELECT jn.*, CASE WHEN s_acctbal <= low THEN 'low' WHEN s_acctbal <= mid THEN 'mid' ELSE 'high' END AS tertile FROM jn, lim)"""

ENVELOPE = SIGNAL + """, pl AS (
  SELECT channel, value, row_number() OVER (PARTITION BY channel ORDER BY t, event_id) - 1 AS idx, count(*) OVER (PARTITION BY channel) AS total FROM s
), bn AS (SELECT *, idx // CAST(ceil(total / 10.0) AS BIGINT) AS bin FROM pl)"""

QUERIES = {
    "stim_channel_most_and_first": Query(
        lambda s, d: gate.argmax_channel(trials(s, d), ["win", "band"], "contact", F.col("response") > 45),
        f"""WITH {TRIALS}, c AS (SELECT win, band, contact, count(*) FILTER (WHERE response > 45) AS n FROM tr GROUP BY ALL)
SELECT win, band, arg_max(contact, (n, -contact)) AS most_channel, min(contact) FILTER (WHERE n > 0) AS first_channel, max(n) AS most_n
FROM c GROUP BY win, band""",
    ),
    "modal_value": Query(
        lambda s, d: gate.modal(trials(s, d), ["contact"], "response", "run_id"),
        f"""WITH {TRIALS}, c AS (SELECT contact, response, count(*) AS n, min(run_id) AS seen FROM tr GROUP BY ALL)
SELECT contact, arg_max(response, (n, -seen, response)) AS mode, max(n) AS n_mode FROM c GROUP BY contact""",
    ),
    "condition_windows": Query(
        lambda s, d: six(windows(s, d)),
        f"""WITH {RECOVERY}
SELECT contact, band, n_trials, n_censored, n_contaminated, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75,
       round(p90, 6) AS p90, round(recovery_q, 6) AS recovery_q, round(recovery_max, 6) AS recovery_max, round(floor, 6) AS floor,
       round(post_start, 6) AS post_start, round(post_end, 6) AS post_end, n_retained_early, n_retained_late, verdict FROM cv""",
    ),
    "retained_trials": Query(
        lambda s, d: gate.retained(recoveries(s, d), windows(s, d), ["contact", "band"], "recovery", *usable(), GATES),
        f"""WITH {RECOVERY}
SELECT run_id, event_number, contact, band, part, recovery, censored, dirty, retained_early, retained_late,
       CASE WHEN censored THEN 'censored' WHEN dirty THEN 'baseline_contaminated' WHEN retained_early THEN '' ELSE 'recovery_after_post_start' END AS reject_reason
FROM rt""",
    ),
    "event_detection_summary": Query(
        lambda s, d: gate.event_summary(
            signal(s, d).select("channel", "t", (F.col("value") - 50).alias("amplitude"), (F.col("kind") == "purchase").alias("compliance"), (F.col("kind") == "click").alias("settle")),
            markers(s, d).select("channel", F.col("t").alias("start"), (F.col("t") + 12 * HOUR).alias("end")), "channel", DAY, 2 * DAY),
        f"""WITH {MARKERS}, f AS (
  SELECT m.channel, m.t AS a, m.t + {12 * HOUR} AS z, s.t, s.value - 50 AS v, s.kind FROM m JOIN s ON s.channel = m.channel AND s.t >= m.t AND s.t < m.t + {2 * DAY}
), g AS (
  SELECT channel, a, z, count(*) FILTER (WHERE t < z) AS n_samples, max(abs(v)) FILTER (WHERE t < z) AS max_amplitude, arg_min(sign(v), t) FILTER (WHERE t < z) AS fs,
         min(t) FILTER (WHERE t < z AND v > 0) AS up, min(t) FILTER (WHERE t < z AND v < 0) AS down, min(t) FILTER (WHERE t < z AND v = 0) AS rest,
         coalesce(bool_or(kind = 'purchase' AND t < z + {DAY}), false) AS compliance, max(t) FILTER (WHERE kind = 'click') AS settled FROM f GROUP BY channel, a, z
)
SELECT channel, a AS "start", z AS "end", n_samples, max_amplitude, CAST(fs AS INT) AS first_sign,
       CAST(CASE WHEN fs = 0 THEN 0 ELSE least(CASE WHEN fs > 0 THEN down ELSE up END, rest, z) - a END AS DOUBLE) AS first_phase, compliance, coalesce(settled + 1, -1) AS settle_end FROM g""",
    ),
    "hardware_floor": Query(
        lambda s, d: six(gate.hardware_floor(
            trials(s, d).withColumn("settle", F.when(F.col("tax") > 0.02, F.col("tax") * 100)), ["contact", "band", "win"], "discount", "settle", F.lit(4.5), 1.0)),
        f"""WITH {TRIALS}
SELECT contact, band, win, round(greatest(1.0, quantile_cont(discount, 0.5),
  coalesce(quantile_cont(CASE WHEN tax > 0.02 THEN tax * 100 END, 0.5), 4.5)), 6) AS floor FROM tr GROUP BY contact, band, win""",
    ),
    "run_validation": Query(
        lambda s, d: six(gate.validation(runs(s, d)).select("run_id", "status", "n_commanded", "count_match", "compliance", "charge_nc", "warnings"), "charge_nc"),
        f"WITH {RUNS} SELECT run_id, status, n_commanded, count_match, compliance, round(charge_nc, 6) AS charge_nc, warnings FROM va",
    ),
    "run_validation_rails": Query(
        lambda s, d: six(gate.with_rails(gate.validation(runs(s, d)), gate.rails(
            trials(s, d).withColumn("channel", F.col("band")), ["run_id", "channel"], ["event_number", "part"], "response", 5.0, 2, 50.0))
            .select("run_id", "status", "rail_percent", "n_railed", "warnings")),
        f"""WITH {TRIALS}, {RUNS}, w AS (SELECT run_id, band, response AS v, row_number() OVER (PARTITION BY run_id, band ORDER BY event_number, part) AS idx,
       max(response) OVER (PARTITION BY run_id, band) AS top, min(response) OVER (PARTITION BY run_id, band) AS low FROM tr
), u AS (SELECT run_id, band, idx, 'p' AS side FROM w WHERE v >= top - 5 UNION ALL SELECT run_id, band, idx, 'n' FROM w WHERE v <= low + 5
), gi AS (SELECT *, idx - row_number() OVER (PARTITION BY run_id, band, side ORDER BY idx) AS island FROM u
), le AS (SELECT run_id, band, side, island, count(*) AS len FROM gi GROUP BY ALL
), ra AS (SELECT run_id, band, coalesce(sum(len) FILTER (WHERE len >= 2), 0) AS railed FROM le GROUP BY run_id, band
), pc AS (SELECT w.run_id, w.band, 100.0 * any_value(railed) / count(*) AS pct, any_value(railed) > 0 AND any_value(top) <> any_value(low) AS is_railed, any_value(top) = any_value(low) AS flat
          FROM w JOIN ra ON ra.run_id = w.run_id AND ra.band = w.band GROUP BY w.run_id, w.band
), pr AS (SELECT run_id, max(pct) AS pct, count(*) FILTER (WHERE is_railed) AS n_railed, string_agg('flat:' || band, '|' ORDER BY band) FILTER (WHERE flat) AS flats FROM pc GROUP BY run_id)
SELECT va.run_id, status, round(coalesce(pct, 0), 6) AS rail_percent, coalesce(n_railed, 0) AS n_railed,
       CASE WHEN flats IS NULL THEN warnings WHEN warnings = '' THEN flats ELSE warnings || '|' || flats END AS warnings FROM va LEFT JOIN pr USING (run_id)""",
    ),
    "block_assignment": Query(
        lambda s, d: gate.blocks(gate.validation(runs(s, d)), "session").select("session", "run_id", "block", "in_block1", "in_block2", "in_block3", "exclusion_reason", "included"),
        f"""WITH {BLOCKS}
SELECT session, run_id, block, contains(block, 'block1') AS in_block1, contains(block, 'block2') OR (named = '' AND also) AS in_block2, block = 'block3' AS in_block3,
       exclusion_reason, exclusion_reason = '' AND status IN ('ok', 'no_stim') AS included FROM b4""",
    ),
    "stim_channel_resolution": Query(
        lambda s, d: gate.stim_channel(
            trials(s, d).groupBy("run_id", F.col("contact").alias("channel")).agg(F.count_if(F.col("response") > 20).alias("n_nonzero")),
            load(s, d, "orders").select(
                F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 100 + 1).alias("configured"),
                F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 50 + 1).alias("settings_channel"), (F.col("o_orderkey") % 2 + 1).alias("settings_channels"),
                F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 90 + 1).alias("folder_channel")), "run_id"),
        f"""WITH {TRIALS}, c AS (SELECT run_id, contact AS channel, count(*) FILTER (WHERE response > 20) AS n FROM tr GROUP BY ALL
), m AS (SELECT run_id, arg_min(channel, (-n, channel)) AS detected FROM c WHERE n > 0 GROUP BY run_id
), r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 100 + 1 END AS configured, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 50 + 1 END AS sc,
                o_orderkey % 2 + 1 AS sn, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 90 + 1 END AS fc FROM orders
), x AS (SELECT r.*, detected, EXISTS (SELECT 1 FROM c WHERE c.run_id = r.run_id AND c.channel = r.configured) AS recorded FROM r LEFT JOIN m USING (run_id)
), y AS (SELECT *, CASE WHEN recorded THEN configured ELSE detected END AS choice FROM x)
SELECT run_id, detected, choice, concat_ws('|', CASE WHEN configured IS NOT NULL AND NOT recorded THEN 'configured_not_recorded' END,
  CASE WHEN recorded AND detected <> configured THEN 'configured_differs' END, CASE WHEN sc <> choice THEN 'settings_differ' END,
  CASE WHEN sn > 1 THEN 'several_in_settings' END, CASE WHEN fc <> choice THEN 'folder_differs' END) AS warnings FROM y""",
    ),
    "baseline_run_choice": Query(
        lambda s, d: gate.baseline_choice(runs(s, d), "session", F.col("run_id") % 97 == 0, F.col("label") == "1-URGENT", (F.col("n_detected") == 0) | (F.col("n_trains") > 1)),
        f"""WITH {RUNS}, k AS (
  SELECT *, CASE WHEN run_id % 97 = 0 THEN 0 WHEN (n_detected = 0 OR n_trains > 1) AND label = '1-URGENT' THEN 1 WHEN n_detected = 0 OR n_trains > 1 THEN 2 END AS r FROM ru
)
SELECT session, arg_min(run_id, (r, run_id)) AS baseline_run FROM k WHERE r IS NOT NULL GROUP BY session""",
    ),
    "manifest_override": Query(
        lambda s, d: gate.override(
            load(s, d, "documents").select("doc_id", F.lit(1).alias("quality"), "lang"), load(s, d, "labels").select("doc_id", "quality"), "doc_id", "quality"),
        "SELECT d.doc_id, coalesce(l.quality, 1) AS quality, lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "rail_episodes": Query(
        lambda s, d: six(gate.rails(signal(s, d), ["channel"], ["t", "event_id"], "value", 12.0, 2, 99.0)),
        f"""WITH {SIGNAL}, w AS (
  SELECT channel, value, row_number() OVER (PARTITION BY channel ORDER BY t, event_id) AS idx, max(value) OVER (PARTITION BY channel) AS top, min(value) OVER (PARTITION BY channel) AS low FROM s
), u AS (SELECT channel, idx, 'p' AS side FROM w WHERE value >= top - 12 UNION ALL SELECT channel, idx, 'n' FROM w WHERE value <= low + 12
), g AS (SELECT channel, side, idx - row_number() OVER (PARTITION BY channel, side ORDER BY idx) AS island FROM u
), r AS (SELECT channel, side, island, count(*) AS len FROM g GROUP BY ALL
), a AS (
  SELECT channel, max(len) FILTER (WHERE side = 'p') AS pl, max(len) FILTER (WHERE side = 'n') AS nl, count(*) FILTER (WHERE side = 'p' AND len >= 2) AS pn,
         count(*) FILTER (WHERE side = 'n' AND len >= 2) AS nn, coalesce(sum(len) FILTER (WHERE len >= 2), 0) AS railed FROM r GROUP BY channel
), t AS (SELECT channel, count(*) AS n, max(value) AS top, min(value) AS low FROM s GROUP BY channel)
SELECT channel, round(CASE WHEN pn > 0 THEN top END, 6) AS pos_level, round(CASE WHEN nn > 0 THEN low END, 6) AS neg_level, CAST(pl AS DOUBLE) AS pos_longest,
       CAST(nl AS DOUBLE) AS neg_longest, pn + nn AS n_episodes, round(100.0 * railed / n, 6) AS percent, (pn > 0 OR nn > 0) AND top <> low AS railed, top = low AS flat,
       (pn > 0 AND top >= 0.98 * 99) OR (nn > 0 AND -low >= 0.98 * 99) AS at_full_scale FROM t JOIN a USING (channel)""",
    ),
    "grouping_set_summary": Query(
        lambda s, d: six(summ.grouping_summary(tau(s, d), [[], ["win"], ["win", "band"], ["contact"], ["tertile"], ["s_nationkey"]], "response")),
        f"""WITH {TAU}
SELECT win, band, contact, tertile, s_nationkey, count(response) AS n, round(quantile_cont(response, 0.25), 6) AS q25,
       round(quantile_cont(response, 0.5), 6) AS median, round(quantile_cont(response, 0.75), 6) AS q75,
       CASE WHEN grouping(win) = 1 AND grouping(contact) = 1 AND grouping(tertile) = 1 AND grouping(s_nationkey) = 1 THEN 'pooled'
            ELSE concat_ws('+', CASE WHEN grouping(band) = 0 THEN 'band' END, CASE WHEN grouping(contact) = 0 THEN 'contact' END,
                 CASE WHEN grouping(s_nationkey) = 0 THEN 's_nationkey' END, CASE WHEN grouping(tertile) = 0 THEN 'tertile' END,
                 CASE WHEN grouping(win) = 0 THEN 'win' END) END AS level
FROM ta GROUP BY GROUPING SETS ((), (win), (win, band), (contact), (tertile), (s_nationkey))""",
    ),
    "drift_first_vs_last": Query(
        lambda s, d: six(summ.first_vs_last(signal(s, d), ["channel"], ["t", "event_id"], "value", 10)),
        f"""WITH {SIGNAL}, p AS (
  SELECT channel, value, row_number() OVER (PARTITION BY channel ORDER BY t, event_id) AS rn, count(*) OVER (PARTITION BY channel) AS total FROM s
), f AS (SELECT channel, value, rn <= CASE WHEN total < 20 THEN greatest(1, total // 2) ELSE 10 END AS head, rn > CASE WHEN total < 20 THEN greatest(1, total // 2) ELSE total - 10 END AS tail FROM p
), q AS (SELECT channel, count(*) FILTER (WHERE head) AS n_first, count(*) FILTER (WHERE tail) AS n_last, quantile_cont(value, 0.5) FILTER (WHERE head) AS a,
                quantile_cont(value, 0.5) FILTER (WHERE tail) AS b FROM f GROUP BY channel)
SELECT channel, n_first, n_last, round(a, 6) AS first_median, round(b, 6) AS last_median, round(b - a, 6) AS change FROM q""",
    ),
    "robust_z": Query(
        lambda s, d: six(summ.robust_z(signal(s, d), ["channel"], "value").select("channel", "event_id", "z"), "z"),
        f"""WITH {SIGNAL}, c AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY channel) AS centre, stddev_pop(value) OVER (PARTITION BY channel) AS sd FROM s
), m AS (SELECT *, 1.4826 * quantile_cont(abs(value - centre), 0.5) OVER (PARTITION BY channel) AS mad FROM c)
SELECT channel, event_id, round((value - centre) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z FROM m""",
    ),
    "min_max_envelope": Query(
        lambda s, d: summ.envelope(signal(s, d), ["channel"], ["t", "event_id"], "value", 20),
        f"WITH {ENVELOPE} SELECT channel, bin, min(value) AS low, max(value) AS high FROM bn GROUP BY channel, bin",
    ),
    "masked_envelope": Query(
        lambda s, d: summ.envelope(signal(s, d), ["channel"], ["t", "event_id"], "value", 20, F.col("value").between(20, 80)),
        f"WITH {ENVELOPE} SELECT channel, bin, min(value) AS low, max(value) AS high FROM bn WHERE value BETWEEN 20 AND 80 GROUP BY channel, bin",
    ),
    "rms_envelope": Query(
        lambda s, d: six(summ.rms_envelope(signal(s, d), ["channel"], ["t", "event_id"], "value", 8)),
        f"""WITH {SIGNAL}, b AS (SELECT channel, value, (row_number() OVER (PARTITION BY channel ORDER BY t, event_id) - 1) // 8 AS bin FROM s)
SELECT channel, bin, round(sqrt(avg(value * value)), 6) AS rms FROM b GROUP BY channel, bin HAVING count(*) = 8""",
    ),
    "isi_histogram": Query(
        lambda s, d: six(summ.isi_histogram(signal(s, d), ["channel"], "t", "event_id", 6 * HOUR, 20)),
        f"""WITH {SIGNAL}, g AS (SELECT channel, t - lag(t) OVER (PARTITION BY channel ORDER BY t, event_id) AS gap FROM s
), b AS (SELECT channel, least(greatest((gap + {3 * HOUR}) // {6 * HOUR}, 0), 19) AS bin, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL)
SELECT channel, bin, n, round(n / sum(n) OVER (PARTITION BY channel), 6) AS share FROM b""",
    ),
    "ecdf": Query(
        lambda s, d: six(summ.ecdf(signal(s, d), ["kind"], "value").select("kind", "event_id", "fraction")),
        f"WITH {SIGNAL} SELECT kind, event_id, round(cume_dist() OVER (PARTITION BY kind ORDER BY value), 6) AS fraction FROM s",
    ),
    "before_after": Query(
        lambda s, d: six(summ.before_after(signal(s, d), ["channel"], F.col("kind") == "view", "value")),
        f"""WITH {SIGNAL}, q AS (SELECT channel, quantile_cont(value, 0.5) FILTER (WHERE kind = 'view') AS a, quantile_cont(value, 0.5) FILTER (WHERE kind <> 'view') AS b FROM s GROUP BY channel)
SELECT channel, round(a, 6) AS "before", round(b, 6) AS "after", round(CASE WHEN a <> 0 THEN b / a END, 6) AS fraction FROM q""",
    ),
    "live_vs_dead": Query(
        lambda s, d: six(summ.live_vs_dead(trials(s, d), ["contact", "win"], F.col("band") == "O", "response")),
        f"""WITH {TRIALS}, q AS (SELECT contact, win, quantile_cont(response, 0.5) FILTER (WHERE band = 'O') AS a, quantile_cont(response, 0.5) FILTER (WHERE band <> 'O') AS b FROM tr GROUP BY contact, win)
SELECT contact, win, round(a, 6) AS live, round(b, 6) AS dead, round(a - b, 6) AS difference, round(CASE WHEN b <> 0 THEN a / b END, 6) AS ratio
FROM q WHERE a IS NOT NULL AND b IS NOT NULL""",
    ),
    "session_periods": Query(
        lambda s, d: six(summ.common_values(trials(s, d), ["win"], "metric", 2000.0, 2)),
        f"""WITH {TRIALS} SELECT win, CAST(round_even(metric / 2000.0, 0) AS BIGINT) AS cluster, count(*) AS n, round(quantile_cont(metric, 0.5), 6) AS median
FROM tr GROUP BY win, cluster HAVING count(*) >= 2""",
    ),
    "spearman": Query(
        lambda s, d: six(summ.spearman(trials(s, d), ["contact"], "response", "metric")),
        f"""WITH {TRIALS}, r AS (
  SELECT contact, rank() OVER (PARTITION BY contact ORDER BY response) + (count(*) OVER (PARTITION BY contact, response) - 1) / 2 AS rx,
         rank() OVER (PARTITION BY contact ORDER BY metric) + (count(*) OVER (PARTITION BY contact, metric) - 1) / 2 AS ry FROM tr
) SELECT contact, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY contact""",
    ),
    "power_rows": Query(
        lambda s, d: six(summ.power_rows(trials(s, d).withColumn("base", F.col("discount") + 0.01).withColumn("post", F.col("tax") + 0.01), ["contact", "band"], "base", "post")),
        f"""WITH {TRIALS}, p AS (SELECT contact, band, discount + 0.01 AS base, tax + 0.01 AS post FROM tr
), q AS (SELECT contact, band, avg(base) AS a, avg(post) AS b, count(*) AS n, stddev_samp(10 * log10(post / base)) AS sd, avg(10 * log10(post / base)) AS m FROM p GROUP BY contact, band)
SELECT contact, band, round(a, 6) AS base_mean, round(b, 6) AS post_mean, round(m, 6) AS mean_db, round(10 * log10(b / a), 6) AS db_of_means,
       round(100 * (b / a - 1), 6) AS percent, round(CASE WHEN n >= 2 THEN sd / sqrt(n) END, 6) AS sem FROM q""",
    ),
    "bands_pivoted": Query(
        lambda s, d: six(trials(s, d).groupBy("contact").pivot("win", ["A", "N", "R"]).agg(F.avg("response"))),
        f"""WITH {TRIALS} SELECT contact, round(avg(response) FILTER (WHERE win = 'A'), 6) AS "A", round(avg(response) FILTER (WHERE win = 'N'), 6) AS "N",
  round(avg(response) FILTER (WHERE win = 'R'), 6) AS "R" FROM tr GROUP BY contact""",
    ),
}

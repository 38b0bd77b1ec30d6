"""Signal operators on the driver's tables: each channel is a run whose values are an evenly sampled signal of small
blocks, and its markers are the pulses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evoked, gating, resampling, spikes, tails
from ..operators import signals as sig
from .bindings import DAY, HOUR, SIGNAL, TRIALS, signal, trials
from .query import Query
from .summary_queries import six

BLOCK = 8
RATE = 100.0
BANDS = {"low": (2.0, 8.0), "high": (10.0, 30.0)}
#: Windows in milliseconds that suit signals of some dozens of samples at 100 Hz.
PROTOCOL = evoked.Protocol(period=150.0, pre=40.0, response=90.0, pulse=20.0, guard=10.0, gap_start=100.0, gap_end=140.0, peak_lowpass_hz=0.0, search=10.0)


def numbered(s, d):
    w = Window.partitionBy("channel").orderBy("t", "event_id")
    return signal(s, d).withColumn("idx", F.row_number().over(w) - 1).withColumn("run_id", F.col("channel").cast("string"))


def blocks(s, d):
    """run_id, channel, block_no, samples; a run's last block may be shorter."""
    n = numbered(s, d).withColumn("block_no", F.floor(F.col("idx") / BLOCK).cast("long"))
    per = n.groupBy("run_id", "block_no").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("v"))
    return per.select("run_id", F.lit("value").alias("channel"), "block_no", F.transform("v", lambda r: r["value"]).alias("samples"))


#: Spikes of channels of some dozens of samples.
SPIKES = spikes.Detection(1000.0, (100.0, 400.0), (100.0, 400.0), 1, 2, 3, 4, 1.0, 50.0)


def trodes(s, d):
    """Channels as polytrodes of four: four neighbouring channels are a run."""
    own = blocks(s, d).select("run_id", "block_no", "samples")
    number = F.col("run_id").cast("long")
    return own.select(F.floor(number / 4).cast("string").alias("run_id"), (number % 4).cast("string").alias("channel"), "block_no", "samples")


def onsets(s, d):
    """The markers of each run as pulses."""
    m = numbered(s, d).where("kind = 'error'")
    return m.select("run_id", F.col("event_id").alias("event_number"), F.col("idx").cast("long").alias("onset_sample"))


def spans(s, d):
    """First and last marker of each run as its train."""
    return onsets(s, d).groupBy("run_id").agg(F.min("onset_sample").alias("train_start"), (F.max("onset_sample") + 1).alias("train_stop"), F.lit(9.0).alias("rate_hz"))


SAMPLES = SIGNAL + """, i AS (
  SELECT CAST(channel AS VARCHAR) AS run_id, event_id, kind, value, row_number() OVER (PARTITION BY channel ORDER BY t, event_id) - 1 AS idx, count(*) OVER (PARTITION BY channel) AS total FROM s
), o AS (SELECT run_id, event_id AS event_number, idx AS onset, total FROM i WHERE kind = 'error')"""
# the responses of PROTOCOL: 4 samples before, 9 behind, a pulse of 2, the part behind it from the third on, the gap 10..13
RESPONSES = SAMPLES + """, e AS (
  SELECT o.run_id, event_number, idx - onset AS k, value, avg(value) FILTER (WHERE idx < onset) OVER (PARTITION BY o.run_id, event_number) AS base
  FROM o JOIN i ON i.run_id = o.run_id AND idx >= onset - 4 AND idx < onset + 9 WHERE onset >= 4 AND onset + 9 <= o.total
), r AS (SELECT *, value - base AS v FROM e
), g AS (
  SELECT o.run_id, event_number, max(value) - min(value) AS gap_uv FROM o JOIN i ON i.run_id = o.run_id AND idx >= onset + 10 AND idx < onset + 14
  WHERE onset + 14 <= o.total GROUP BY o.run_id, event_number
), pr AS (
  SELECT run_id, event_number, max(v) FILTER (WHERE k >= 0) - min(v) FILTER (WHERE k >= 0) AS range_uv,
         arg_max(k, (abs(v), -k)) FILTER (WHERE k >= 0) * 10.0 AS latency_ms, max(v) FILTER (WHERE k BETWEEN 0 AND 2) - min(v) FILTER (WHERE k BETWEEN 0 AND 2) AS during_uv,
         max(v) FILTER (WHERE k >= 3) - min(v) FILTER (WHERE k >= 3) AS post_uv, arg_max(k, (abs(v), -k)) FILTER (WHERE k >= 3) * 10.0 AS post_latency_ms,
         sum(v * v) FILTER (WHERE k >= 2) / sum(v * v) FILTER (WHERE k >= 0) AS tail, stddev_pop(value) FILTER (WHERE k < 0) AS baseline_sd FROM r GROUP BY run_id, event_number
), pg AS (SELECT pr.*, gap_uv FROM pr LEFT JOIN g USING (run_id, event_number))"""


def responses(s, d):
    return evoked.pulse_responses(blocks(s, d), onsets(s, d), RATE, PROTOCOL, BLOCK)


def found_peaks(s, d):
    w = evoked.mean_waveforms(blocks(s, d), onsets(s, d), RATE, PROTOCOL, BLOCK)
    return evoked.peaks(w.join(evoked.evoked_summary(responses(s, d)).select("run_id", "channel", "baseline_sd"), ["run_id", "channel"]), RATE, PROTOCOL)


def fake_places(s, d):
    """Fake onsets with the distance to the one before and whether they lie inside their channel's span."""
    ends = signal(s, d).groupBy("channel").agg((F.min("t") + HOUR).alias("start"), (F.max("t") - HOUR).alias("end"))
    placed = resampling.fake_onsets(ends, ["channel"], 20, 6 * HOUR).join(ends, "channel")
    before = F.lag("onset").over(Window.partitionBy("channel").orderBy("onset"))
    return placed.withColumn("apart", F.col("onset") - before).withColumn("inside", (F.col("onset") >= F.col("start")) & (F.col("onset") < F.col("end")))


QUERIES = {
    "epoch_extraction": Query(
        lambda s, d: six(sig.epochs(blocks(s, d), onsets(s, d), -4, 9, 0, BLOCK).select(
            "run_id", "event_number", "zero", F.size("x").alias("n"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))),
        f"""WITH {SAMPLES}
SELECT o.run_id, event_number, 4 AS zero, CAST(count(*) AS INT) AS n, round(sum(value), 6) AS total
FROM o JOIN i ON i.run_id = o.run_id AND idx >= onset - 4 AND idx < onset + 9 WHERE onset >= 4 AND onset + 9 <= o.total GROUP BY o.run_id, event_number""",
    ),
    "pulse_responses": Query(
        lambda s, d: six(responses(s, d).drop("channel")),
        f"""WITH {RESPONSES} SELECT run_id, event_number, round(range_uv, 6) AS range_uv, latency_ms, round(during_uv, 6) AS during_uv, round(post_uv, 6) AS post_uv, post_latency_ms,
       round(tail, 6) AS tail, round(baseline_sd, 6) AS baseline_sd, round(gap_uv, 6) AS gap_uv FROM pg""",
    ),
    "evoked_summary": Query(
        lambda s, d: six(evoked.evoked_summary(responses(s, d)).select("run_id", "n_pulses", "range_uv", "range_iqr", "latency_ms", "post_iqr", "tail", "gap_uv", "snr")),
        f"""WITH {RESPONSES}, q AS (SELECT run_id, count(*) AS n_pulses, quantile_cont(range_uv, 0.5) AS ra, quantile_cont(range_uv, 0.75) - quantile_cont(range_uv, 0.25) AS ri,
  quantile_cont(latency_ms, 0.5) AS la, quantile_cont(post_uv, 0.75) - quantile_cont(post_uv, 0.25) AS pi, quantile_cont(tail, 0.5) AS ta, quantile_cont(gap_uv, 0.5) AS ga FROM pg GROUP BY run_id)
SELECT run_id, n_pulses, round(ra, 6) AS range_uv, round(ri, 6) AS range_iqr, round(la, 6) AS latency_ms, round(pi, 6) AS post_iqr, round(ta, 6) AS tail, round(ga, 6) AS gap_uv,
       round(CASE WHEN ga <> 0 THEN ra / ga END, 6) AS snr FROM q""",
    ),
    "mean_waveforms": Query(
        lambda s, d: six(evoked.mean_waveforms(blocks(s, d), onsets(s, d), RATE, PROTOCOL, BLOCK).select("run_id", "n_pulses", F.posexplode("waveform").alias("k", "mean"))
                         .select("run_id", "n_pulses", "k", (F.col("mean") * F.col("n_pulses")).alias("total"))),
        f"""WITH {RESPONSES} SELECT run_id, count(*) AS n_pulses, CAST(k + 4 AS INT) AS k, round(sum(v), 6) + 0.0 AS total FROM r GROUP BY run_id, k""",
    ),
    "evoked_peaks": Query(lambda s, d: six(found_peaks(s, d))),
    "evoked_peak_summary": Query(lambda s, d: six(evoked.peak_summary(
        evoked.peak_trials(blocks(s, d), onsets(s, d), found_peaks(s, d), RATE, PROTOCOL, BLOCK), evoked.evoked_summary(responses(s, d)), PROTOCOL))),
    "local_centre_and_drift": Query(
        lambda s, d: six(evoked.local_centre(blocks(s, d), onsets(s, d), -6, -1, BLOCK).drop("channel")),
        f"""WITH {SAMPLES} SELECT o.run_id, event_number, round(avg(value), 6) AS centre, round(regr_slope(value, idx) * 4, 6) + 0.0 AS drift
FROM o JOIN i ON i.run_id = o.run_id AND idx >= onset - 6 AND idx < onset - 1 WHERE onset >= 6 GROUP BY o.run_id, event_number""",
    ),
    "clean_span_deviation": Query(
        lambda s, d: six(evoked.span_deviation(blocks(s, d), evoked.clean_spans(
            spans(s, d).join(numbered(s, d).groupBy("run_id").agg(F.count("*").alias("n_samples")), "run_id").select("run_id", F.col("train_start").alias("first_onset"), (F.col("train_stop") - 1).alias("last_onset"), "n_samples"),
            RATE, 0.01, 0.02, 0.03, 0.02), BLOCK).drop("channel")),
        f"""WITH {SAMPLES}, tr AS (SELECT run_id, min(onset) AS a, max(onset) AS z, any_value(total) AS n FROM o GROUP BY run_id
), sp AS (SELECT run_id, CASE WHEN a - 2 - CASE WHEN a - 2 - 1 >= 3 THEN 1 ELSE greatest(0, a - 5) END >= 3 THEN 'pre-train' ELSE 'post-train' END AS source,
                 CASE WHEN a - 2 - 1 >= 3 THEN 1 ELSE greatest(0, a - 5) END AS b, a - 2 AS e, z + 2 AS c, n FROM tr
), sq AS (SELECT run_id, source, CASE WHEN source = 'pre-train' THEN b ELSE c END AS "start", CASE WHEN source = 'pre-train' THEN e ELSE n END AS stop FROM sp)
SELECT sq.run_id, source, "start", stop, count(*) AS n, round(stddev_samp(value), 6) AS sd FROM sq JOIN i ON i.run_id = sq.run_id AND idx >= "start" AND idx < stop
WHERE stop - "start" >= 3 GROUP BY sq.run_id, source, "start", stop""",
    ),
    "train_band_change": Query(lambda s, d: six(evoked.train_band_change(
        blocks(s, d), numbered(s, d).groupBy("run_id").agg(F.floor(F.count("*") / 2).alias("train_start"), F.count("*").alias("train_stop"), F.lit(1.7).alias("rate_hz")), 8.0,
        {"slow": (0.5, 1.5), "fast": (2.0, 3.9)}, 4.0, BLOCK))),
    "gap_band_change": Query(lambda s, d: six(evoked.gap_band_change(blocks(s, d), onsets(s, d), RATE, evoked.Protocol(period=425.0), {"high": (10.0, 30.0)}, BLOCK))),
    "post_train_change": Query(lambda s, d: six(evoked.post_train_change(blocks(s, d), onsets(s, d).select(
        "run_id", F.col("onset_sample").alias("train_start"), (F.col("onset_sample") + 1).alias("train_stop")).groupBy("run_id").agg(F.percentile_approx("train_start", 0.5).alias("train_start"),
        (F.percentile_approx("train_start", 0.5) + 1).alias("train_stop")), RATE, 0.02, 0.33, BLOCK))),
    "pulse_train_recovery": Query(lambda s, d: six(evoked.recover_trains(blocks(s, d), RATE, evoked.Comb(5, 20.0, 0.1, 10.0, 0.05, 0.3), BLOCK).drop("onsets_s"))),
    "tail_fits": Query(lambda s, d: six(tails.tail_fits(
        blocks(s, d), onsets(s, d), RATE, gating.rails(numbered(s, d), ["run_id"], ["idx"], "value", 12.0, 2, 99.0).withColumn("channel", F.lit("value")),
        (-50.0, 0.0), 400.0, 10.0, 30.0, block_size=BLOCK))),
    "highpass_removed": Query(
        lambda s, d: six(tails.without_highpass(blocks(s, d), 4, 95.0).select("run_id", "block_no", F.posexplode("samples").alias("k", "x"))),
        f"""WITH {SAMPLES}, c AS (SELECT run_id, idx, value / (1 - 625e-4) AS y, coalesce(sum(CASE WHEN abs(value) >= 95 THEN 0e0 ELSE value END)
  OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS b FROM i)
SELECT run_id, idx // {BLOCK} AS block_no, CAST(idx % {BLOCK} AS INT) AS k, round(y + 625e-4 / (1 - 625e-4) * b, 6) AS x FROM c""",
    ),
    "gentle_highpass": Query(
        lambda s, d: six(tails.gentle_highpass(blocks(s, d), 5.0, RATE).select("run_id", "block_no", F.posexplode("samples").alias("k", "y"))),
        f"""WITH {SAMPLES}, c AS (SELECT tan(pi() * 5 / 1e2) AS t), g AS (SELECT 1 / (1 + t) AS gain, (1 - t) / (1 + t) AS fade FROM c
), st AS (SELECT run_id, idx, value - coalesce(lag(value) OVER (PARTITION BY run_id ORDER BY idx), value) AS step FROM i)
SELECT a.run_id, a.idx // {BLOCK} AS block_no, CAST(a.idx % {BLOCK} AS INT) AS k, round(sum(gain * pow(fade, a.idx - b.idx) * b.step), 6) + 0.0 AS y
FROM st a JOIN st b ON a.run_id = b.run_id AND b.idx <= a.idx, g GROUP BY a.run_id, a.idx""",
    ),
    "inverse_filter_recovery": Query(lambda s, d: six(tails.inverse_recovery(blocks(s, d), onsets(s, d), RATE, 4, 95.0, (-50.0, 0.0), 100.0, 30.0, 2.0, 1.0, 1.0, BLOCK))),
    "event_band_power": Query(
        lambda s, d: six(sig.event_power(blocks(s, d), onsets(s, d), RATE, BANDS, {"base": (-50.0, 0.0), "post": (0.0, 50.0)}, (-10.0, 10.0), 80.0, 2, BLOCK)),
    ),
    "event_recovery_kernel": Query(
        lambda s, d: six(sig.event_recovery(blocks(s, d), onsets(s, d), RATE, (-50.0, 0.0), 100.0, 30.0, 2.0, 1.0, BLOCK)),
        f"""WITH {SAMPLES}, e AS (
  SELECT o.run_id, event_number, idx - onset AS k, value FROM o JOIN i ON i.run_id = o.run_id AND idx >= onset - 5 AND idx < onset + 10 WHERE onset >= 5 AND onset + 10 <= o.total
), b AS (SELECT run_id, event_number, avg(value) AS m, stddev_samp(value) AS sd, greatest(2 * stddev_samp(value), 1) AS lim FROM e WHERE k < 0 GROUP BY run_id, event_number
), a AS (SELECT run_id, event_number, k, abs(value - m) > lim AS above FROM e JOIN b USING (run_id, event_number) WHERE k >= 0
), w AS (SELECT *, sum(CASE WHEN above THEN 1 ELSE 0 END) OVER q AS loud, count(*) OVER q AS n FROM a
  WINDOW q AS (PARTITION BY run_id, event_number ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
), c AS (SELECT run_id, event_number, min(k) FILTER (WHERE loud = 0 AND n = 3) AS calm FROM w GROUP BY run_id, event_number
), r AS (SELECT a.run_id, a.event_number, any_value(calm) AS calm, max(k) FILTER (WHERE above AND k < calm) AS last FROM a JOIN c ON c.run_id = a.run_id AND c.event_number = a.event_number GROUP BY a.run_id, a.event_number)
SELECT run_id, 'value' AS channel, event_number, round(sd, 6) AS baseline_sd_uv, round(lim, 6) AS threshold_uv,
       CASE WHEN calm IS NULL THEN 100e0 ELSE coalesce(last + 1, 0) * 10e0 END AS recovery_ms, calm IS NULL AS censored FROM r JOIN b USING (run_id, event_number)""",
    ),
    "welch_band_power": Query(lambda s, d: six(sig.spectra(sig.channel_arrays(blocks(s, d)), RATE, 32, BANDS, 5.0))),
    "spike_detection": Query(lambda s, d: spikes.amplitude_spikes(blocks(s, d), SPIKES, 4, BLOCK).drop("wave")),
    "polytrode_spikes": Query(lambda s, d: spikes.polytrode_spikes(
        trodes(s, d), trodes(s, d).select("run_id", "channel").distinct().withColumn("polytrode", F.lit(1)), SPIKES, 2, 4, BLOCK).drop("waves")),
    "noise_levels": Query(lambda s, d: six(spikes.noise_levels(spikes.filtered_segments(blocks(s, d), SPIKES, 4, BLOCK), SPIKES))),
    "bootstrap_medians": Query(
        lambda s, d: six(resampling.median_intervals(signal(s, d), ["channel", "kind"], "value", 200).select("channel", "kind", "n", "median", F.expr("lo <= median AND median <= hi").alias("around"))),
        f"WITH {SIGNAL} SELECT channel, kind, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, true AS around FROM s GROUP BY channel, kind HAVING count(value) > 0",
    ),
    "paired_db_intervals": Query(
        lambda s, d: six(resampling.paired_db_intervals(
            trials(s, d).select("contact", "run_id", "event_number", "part", (F.col("discount") + 0.01).alias("base"), (F.col("tax") + 0.01).alias("post")), ["contact"], "base", "post", ["run_id", "event_number", "part"], 200)
            .select("contact", "n_pairs", "median_db", "mean_db", F.expr("lo <= mean_db AND mean_db <= hi").alias("around"))),
        f"""WITH {TRIALS}, c AS (SELECT contact, 10 * log10((tax + 1e-2) / (discount + 1e-2)) AS db FROM tr)
SELECT contact, count(*) AS n_pairs, round(quantile_cont(db, 0.5), 6) AS median_db, round(avg(db), 6) AS mean_db, true AS around FROM c GROUP BY contact""",
    ),
    "fake_onsets": Query(
        lambda s, d: fake_places(s, d).groupBy("channel").agg((F.count("*") <= 20).alias("few_enough"), (F.coalesce(F.min("apart"), F.lit(DAY)) >= 6 * HOUR).alias("apart"), F.bool_and("inside").alias("inside")),
        f"""WITH {SIGNAL}, g AS (SELECT channel FROM s GROUP BY channel HAVING max(t) - min(t) > {2 * HOUR}) SELECT channel, true AS few_enough, true AS apart, true AS inside FROM g""",
    ),
    "pseudo_onsets": Query(
        lambda s, d: resampling.pseudo_onsets(numbered(s, d).groupBy("run_id").agg(F.count("*").alias("n_samples")), ["run_id"], 4, 9, 6, most=8),
        f"""WITH {SAMPLES}, n AS (SELECT DISTINCT run_id, total FROM i)
SELECT run_id, k AS event_number, 4 + 6 * k AS onset FROM n, range(0, 8) AS r(k) WHERE 4 + 6 * k < total - 9""",
    ),
    "prepost_power": Query(lambda s, d: six(evoked.prepost_power(
        blocks(s, d), numbered(s, d).groupBy("run_id").agg(F.floor(F.count("*") * 0.45).alias("first_stim"), F.floor(F.count("*") * 0.5).alias("last_stim"), F.count("*").alias("n_samples")),
        RATE, BANDS, 0.1, 0.05, 0.02, 0.3, 2, 100, BLOCK))),
    "shuffle_summary": Query(lambda s, d: six(resampling.paired_db_intervals(
        sig.event_power(blocks(s, d), resampling.fake_onsets(numbered(s, d).groupBy("run_id").agg(F.lit(8).cast("long").alias("start"), (F.count("*") - 8).alias("end")), ["run_id"], 10, 5)
                        .select("run_id", F.col("onset").alias("event_number"), F.col("onset").alias("onset_sample")), RATE, {"high": (10.0, 30.0)}, {"base": (-50.0, 0.0), "post": (0.0, 50.0)}, (-10.0, 10.0), 80.0, 2, BLOCK)
        .groupBy("run_id", "band", "event_number").pivot("win", ["base", "post"]).agg(F.first("power_uv2")), ["run_id", "band"], "base", "post", ["event_number"], 200))),
}

"""Regression, text, word and waveform operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, words
from ..operators import models, resampling, sorting
from ..operators import regression as reg
from ..operators import waveforms as wave
from ..operators.dealing import dealt
from .bindings import HOUR, SIGNAL, TRIALS, load, markers, signal, trials
from .query import Query
from .summary_queries import six


def doses(s, d):
    """Trials with a dose: current and response."""
    p = load(s, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("double").alias("current"))
    return trials(s, d).join(p, "part")


DOSES = TRIALS + ", ds AS (SELECT tr.*, CAST(p_size AS DOUBLE) AS current FROM tr JOIN part ON p_partkey = part)"


#: What tells trials apart.
TRIAL_ID = ["run_id", "event_number", "part"]


def shifted(s, d):
    """Trials whose metric, v, is not positive everywhere."""
    return trials(s, d).withColumn("v", F.when(F.col("contact") % 10 == 0, F.col("metric") - 2000).otherwise(F.col("metric")))


SHIFTED = TRIALS + """, t2 AS (SELECT contact, CASE WHEN contact % 10 = 0 THEN metric - 2000 ELSE metric END AS v FROM tr
), c AS (SELECT *, CASE WHEN v > 0 THEN log10(v) END AS l, avg(v) OVER w AS m, avg(CASE WHEN v > 0 THEN log10(v) END) OVER w AS lm FROM t2 WINDOW w AS (PARTITION BY contact)"""


def logged(s, d):
    """Doses and responses as logarithms."""
    return doses(s, d).where("response > 0").withColumn("ly", F.ln("response")).withColumn("log_current", F.ln("current"))


def folders(s, d):
    """Run folder names made from parts."""
    k = F.col("p_partkey")
    return load(s, d, "part").select(
        k.alias("id"),
        F.concat(
            F.lit("step"), (k % 9).cast("string"), F.lit("_2608"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("_"),
            F.lpad((k % 24).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("36 A-"),
            F.lpad((k % 32).cast("string"), 3, "0"), F.lit(" stim "), F.when(k % 2 == 0, "cathodic").otherwise("anodic"), F.lit(" first "),
            (k % 5 * 100 + 100).cast("string"), F.lit("us "), (k % 7 * 10).cast("string"), F.lit("uA 1Hz "), (k % 50 + 1).cast("string"),
            F.lit(" pulses"), F.when(k % 6 == 0, " RP comp").otherwise(""),
        ).alias("name"),
    )


FOLDERS = """fo AS (
  SELECT p_partkey AS id, 'step' || p_partkey % 9 || '_2608' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') || '_' ||
         lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') || '36 A-' ||
         lpad(CAST(p_partkey % 32 AS VARCHAR), 3, '0') || ' stim ' || CASE WHEN p_partkey % 2 = 0 THEN 'cathodic' ELSE 'anodic' END || ' first ' ||
         (p_partkey % 5 * 100 + 100) || 'us ' || (p_partkey % 7 * 10) || 'uA 1Hz ' || (p_partkey % 50 + 1) || ' pulses' ||
         CASE WHEN p_partkey % 6 = 0 THEN ' RP comp' ELSE '' END AS name
  FROM part
)"""


def amplitude_tokens(s, d):
    k = F.col("p_partkey")
    token = F.when(k % 4 == 0, F.concat(F.lit("a "), (k % 10).cast("string"), F.lit("_5mA"))).when(
        k % 4 == 1, F.concat(F.lit("0"), (k % 9 + 1).cast("string"), F.lit("mA"))).when(k % 4 == 2, F.concat(F.lit("-"), (k % 10).cast("string"), F.lit(".25 mA"))).otherwise("none")
    return load(s, d, "part").select(k.alias("id"), token.alias("token"))


def channel_texts(s, d):
    k = F.col("p_partkey")
    first, last = F.lpad((k % 20 + 3).cast("string"), 3, "0"), F.lpad((k % 7 + 10).cast("string"), 2, "0")
    text = F.when(k % 3 == 0, F.concat(F.lit("A-"), first, F.lit("-"), last)).when(k % 3 == 1, F.concat(F.lit("A-"), first, F.lit(" to A-"), last)).otherwise(F.concat(F.lit("A-"), first))
    return load(s, d, "part").select(k.alias("id"), text.alias("text"))


def labelled_amplitudes(s, d):
    """Responses of three channels of about 2000 times the amplitude, ten times that or a tenth for some runs and channels."""
    k, c = F.col("o_orderkey"), F.col("channel")
    amplitude = k % 6 + 1
    factor = F.when((k % 23 == 0) & (c <= 1 + k % 3), 20000.0).when((k % 29 == 0) & (c > 1), 200.0).otherwise(2000.0)
    rows = load(s, d, "orders").withColumn("channel", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return rows.select(
        F.col("o_custkey").alias("wiring"), "channel", k.alias("run_id"),
        F.when(k % 17 != 0, amplitude.cast("double") * F.when(k % 2 == 0, -1).otherwise(1)).alias("x"),
        (amplitude * factor + F.col("o_totalprice") / 1000).alias("y"),
    )


def flags(s, d):
    return reg.decade_mislabels(labelled_amplitudes(s, d), ["wiring", "channel"], "run_id", "x", "y")


FLAGS = """o AS (
  SELECT o_custkey AS wiring, o_orderkey AS run_id, c.channel, log10(CAST(o_orderkey % 6 + 1 AS DOUBLE)) AS lx, o_orderkey % 17 <> 0 AS good,
         log10((o_orderkey % 6 + 1) * CASE WHEN o_orderkey % 23 = 0 AND c.channel <= 1 + o_orderkey % 3 THEN 2e4 WHEN o_orderkey % 29 = 0 AND c.channel > 1 THEN 2e2 ELSE 2e3 END + o_totalprice / 1000) AS ly
  FROM orders, range(1, 4) c(channel)
), en AS (SELECT wiring, channel FROM o WHERE good GROUP BY ALL HAVING count(*) >= 4 AND count(DISTINCT round(lx, 6)) >= 3
), ts AS (
  SELECT a.wiring, a.channel, quantile_cont((b.ly - a.ly) / (b.lx - a.lx), 0.5) AS slope
  FROM o a JOIN o b ON a.wiring = b.wiring AND a.channel = b.channel AND a.lx < b.lx AND a.good AND b.good GROUP BY ALL
), lv AS (
  SELECT o.wiring, o.channel, first(slope) AS slope, quantile_cont(ly - slope * lx, 0.5) AS level
  FROM o JOIN ts ON ts.wiring = o.wiring AND ts.channel = o.channel JOIN en ON en.wiring = o.wiring AND en.channel = o.channel WHERE good GROUP BY ALL
), rs AS (
  SELECT o.wiring, o.channel, run_id, slope, CASE WHEN good THEN ly - slope * lx - level END AS res FROM o LEFT JOIN lv ON lv.wiring = o.wiring AND lv.channel = o.channel
), fl AS (
  SELECT wiring, channel, run_id, res, CASE WHEN abs(res) > greatest(0.3, 0.5 * abs(slope)) AND least(abs(res - slope), abs(res + slope)) < 0.15
         THEN CASE WHEN abs(res - slope) < abs(res + slope) THEN 1 ELSE -1 END ELSE 0 END AS shift FROM rs
)"""


def spikes(s, d):
    return load(s, d, "embeddings").select("vec_id", (F.col("label") + 1).alias("class"), F.col("embedding").cast("array<double>").alias("w"))


SPIKES = "sp AS (SELECT vec_id, label + 1 AS class, CAST(embedding AS DOUBLE[]) AS w FROM embeddings)"
POINTS = SPIKES + """, pt AS (SELECT vec_id, class, k - 1 AS place, w[k] AS y FROM (SELECT vec_id, class, w, unnest(range(1, len(w) + 1)) AS k FROM sp))
, tm AS (SELECT class, place, avg(y) AS m, var_pop(y) AS v FROM pt GROUP BY class, place)
, tp AS (SELECT class, list(m ORDER BY place) AS centre, sqrt(sum(v)) AS radius FROM tm GROUP BY class)"""

def folded(s, d):
    """Waveforms of four points, the sums of every fourth one."""
    sums = [sum(F.element_at("w", 4 * j + k + 1) for j in range(16)) for k in range(4)]
    return spikes(s, d).select("vec_id", "class", F.array(*sums).alias("w"))


FOLDED = SPIKES + ", fd AS (SELECT vec_id, class, [" + ", ".join("+".join(f"w[{4 * j + k + 1}]" for j in range(16)) for k in range(4)) + "] AS f FROM sp)"


def temperature_tree(s, d):
    """Trials as spikes whose cluster depends on the step, and the sizes of these clusters."""
    t = trials(s, d).select(F.concat_ws("-", "run_id", "event_number", "part").alias("id"), "response", "contact", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("step"))
    members = t.withColumn("cluster", F.when(F.col("response") > 8 * F.col("step"), 1).otherwise(2 + F.col("contact") % F.greatest("step", F.lit(1))).cast("int"))
    tree = members.groupBy("step", "cluster").agg(F.count("*").alias("size"))
    every = tree.select("step").distinct().crossJoin(F.broadcast(tree.select("cluster").distinct()))  # steps times clusters
    return every.join(tree, ["step", "cluster"], "left").withColumn("size", F.coalesce("size", F.lit(0))), members.select("step", "cluster", "id")


#: Levels of the wavelet transform.
LEVELS = 4


def _haar() -> str:
    """Wavelet coefficients: the last approximation, then details from coarse to fine."""
    out = SPIKES + ", a0 AS (SELECT vec_id, k - 1 AS i, w[k] AS a, len(w) AS n FROM (SELECT vec_id, w, unnest(range(1, len(w) + 1)) AS k FROM sp))"
    for lev in range(LEVELS):
        out += f""", a{lev + 1} AS (
  SELECT x.vec_id, x.i // 2 AS i, (x.a + y.a) * 0.7071067811865476 AS a, (x.a - y.a) * 0.7071067811865476 AS d, x.n // 2 AS n
  FROM a{lev} x JOIN a{lev} y ON y.vec_id = x.vec_id AND y.i = x.i + 1 WHERE x.i % 2 = 0)"""
    details = "".join(f" UNION ALL SELECT vec_id, n + i, d FROM a{lev}" for lev in range(LEVELS, 0, -1))
    return out + f", co AS (SELECT vec_id, i AS place, a AS y FROM a{LEVELS}{details})"


def _normal(z: str) -> str:
    acc = "1"
    for k in range(wave.NORMAL_TERMS, 0, -1):
        acc = f"(1 + {z} * {z} / {2 * k + 1}.0 * {acc})"
    return f"(0.5 + {z} * {acc} * exp(-{z} * {z} / 2) / sqrt(2 * pi()))"


HAAR = _haar()
SCORES = HAAR + f""", k1 AS (SELECT *, avg(y) OVER (PARTITION BY place) AS m, stddev_samp(y) OVER (PARTITION BY place) AS s FROM co
), k2 AS (SELECT vec_id, place, y, avg(y) OVER (PARTITION BY place) AS m, stddev_samp(y) OVER (PARTITION BY place) AS s FROM k1 WHERE abs(y - m) < 3 * s
), k3 AS (
  SELECT place, (y - m) / s AS z, cume_dist() OVER (PARTITION BY place ORDER BY y) AS up,
         (rank() OVER (PARTITION BY place ORDER BY y) - 1) / count(*) OVER (PARTITION BY place) AS lo FROM k2 WHERE s > 0
), k4 AS (SELECT *, {_normal("z")} AS nd FROM k3)
, ks AS (SELECT place, CASE WHEN count(*) > 10 THEN max(greatest(abs(up - nd), abs(lo - nd))) ELSE 0 END AS score, count(*) AS n FROM k4 GROUP BY place)"""


def scores(s, d):
    return wave.spread_score(wave.haar_features(spikes(s, d), "vec_id", "w", LEVELS), "place", "y", 3.0)


QUERIES = {
    "ols_fits": Query(
        lambda s, d: six(reg.ols(doses(s, d), ["contact", "band"], "current", "response")),
        f"""WITH {DOSES} SELECT contact, band, count(*) AS n, round(regr_slope(response, current), 6) AS slope,
  round(regr_intercept(response, current), 6) AS intercept, round(regr_r2(response, current), 6) AS r2 FROM ds GROUP BY contact, band
HAVING count(*) >= 3""",
    ),
    "through_origin_fits": Query(
        lambda s, d: six(reg.through_origin(doses(s, d), ["contact"], "current", "response")),
        f"""WITH {DOSES}, a AS (SELECT contact, count(*) AS n, sum(current * response) AS xy, sum(current * current) AS xx, sum(response * response) AS yy FROM ds GROUP BY contact)
SELECT contact, n, round(xy / xx, 6) AS slope, round(yy - xy / xx * xy, 6) AS rss FROM a""",
    ),
    "model_choice": Query(
        lambda s, d: six(reg.model_choice(doses(s, d), ["contact", "band"], "current", "response")),
        f"""WITH {DOSES}, a AS (
  SELECT contact, band, count(*) AS n, sum(response * response) - sum(current * response) * sum(current * response) / sum(current * current) AS ro,
         regr_syy(response, current) - regr_sxy(response, current) * regr_sxy(response, current) / regr_sxx(response, current) AS rl FROM ds GROUP BY contact, band HAVING count(*) >= 4
), b AS (SELECT contact, band, n, n * ln(rl / n) + 4 AS al, n * ln(ro / n) + 2 AS ao, n * ln(rl / n) + 2 * ln(n) AS bl, n * ln(ro / n) + ln(n) AS bo FROM a)
SELECT contact, band, n, round(al, 6) AS aic_line, round(ao, 6) AS aic_origin, round(bl, 6) AS bic_line, round(bo, 6) AS bic_origin,
       CASE WHEN ao <= al THEN 'origin' ELSE 'line' END AS best, ao - least(ao, al) <= 2 AS artifact FROM b""",
    ),
    "log_log_slopes": Query(
        lambda s, d: six(reg.log_log(doses(s, d).withColumn("x", F.col("current") - 2), ["contact"], "x", "response")),
        f"""WITH {DOSES}, l AS (SELECT contact, CASE WHEN current > 2 AND response > 0 THEN ln(current - 2) END AS lx, CASE WHEN current > 2 AND response > 0 THEN ln(response) END AS ly FROM ds)
SELECT contact, count(lx) AS n, count(*) FILTER (WHERE lx IS NULL) AS n_excluded, round(regr_slope(ly, lx), 6) AS slope,
       round(regr_intercept(ly, lx), 6) AS intercept, round(regr_r2(ly, lx), 6) AS r2 FROM l GROUP BY contact""",
    ),
    "additive_recovery_fit": Query(
        lambda s, d: six(reg.additive(doses(s, d), ["contact"], "part", "current", "response")),
        f"""WITH {DOSES}, f AS (SELECT contact, regr_slope(response, current) AS a, regr_intercept(response, current) AS b FROM ds GROUP BY contact
), r AS (SELECT contact, part, quantile_cont(response, 0.5) AS med, avg(current) AS tau FROM ds GROUP BY contact, part)
SELECT contact, round(first(a), 6) AS a, round(first(b), 6) AS b, count(*) AS n_runs,
       round(1 - sum((med - a * tau - b) * (med - a * tau - b)) / CASE WHEN var_pop(med) > 0 THEN var_pop(med) * count(*) END, 6) AS r2
FROM r JOIN f USING (contact) GROUP BY contact""",
    ),
    "decade_mislabel_flags": Query(
        lambda s, d: six(flags(s, d)),
        f"WITH {FLAGS} SELECT wiring, channel, run_id, round(res, 6) + 0.0 AS residual, shift, shift <> 0 AS suspect FROM fl",
    ),
    "decade_mislabel_votes": Query(
        lambda s, d: reg.decade_votes(flags(s, d), "run_id", "channel"),
        f"""WITH {FLAGS}, td AS (SELECT channel FROM fl GROUP BY channel HAVING count(res) > 0
), tl AS (SELECT run_id, shift, count(DISTINCT channel) AS n FROM fl WHERE shift <> 0 GROUP BY ALL
), bs AS (SELECT run_id, arg_max(shift, (n, shift)) AS shift, max(n) AS n FROM tl GROUP BY run_id
), pr AS (SELECT run_id, count(DISTINCT channel) FILTER (WHERE channel IN (SELECT channel FROM td)) AS n_tested FROM fl GROUP BY run_id)
SELECT run_id, coalesce(n, 0) AS n_agree, n_tested, coalesce(2 * n >= n_tested, false) AS suspect, CASE WHEN 2 * n >= n_tested THEN shift ELSE 0 END AS shift
FROM pr LEFT JOIN bs USING (run_id)""",
    ),
    "sweep_evidence": Query(
        lambda s, d: six(reg.sweep_evidence(doses(s, d).withColumn("signed", F.when(F.col("band") == "O", F.col("current")).otherwise(-F.col("current"))), ["contact", "win"], "signed", "response")),
        f"""WITH {DOSES}, e AS (SELECT contact, win, count(*) AS n, regr_slope(response, current) AS sl, regr_intercept(response, current) AS b, regr_r2(response, current) AS r2,
  max(response) - min(response) AS span, avg(response) FILTER (WHERE band = 'O') AS plus, avg(response) FILTER (WHERE band <> 'O') AS minus FROM ds GROUP BY contact, win)
SELECT contact, win, n AS n_points, round(sl, 6) AS slope, round(b, 6) AS intercept, round(r2, 6) AS r2, coalesce(r2 > 0.95 AND span > 0 AND abs(b) < 0.15 * span, false) AS through_origin,
       round(CASE WHEN plus + minus > 0 THEN abs(plus - minus) / (0.5 * (plus + minus)) END, 6) AS asymmetry FROM e WHERE n >= 3""",
    ),
    "run_evidence": Query(
        lambda s, d: six(reg.run_evidence(trials(s, d).select(
            "run_id", "event_number", "contact", "metric", (F.col("response") / 10).alias("latency"), F.when(F.col("discount") > 0, F.col("discount") * 5).alias("tail"),
            (F.col("response") / 5).alias("later"), F.col("metric").alias("during"), (F.col("tax") * 100).alias("post"), (F.col("event_number") - 1).alias("peaks")),
            "latency", "tail", "later", "during", "post", "peaks").drop("latency", "tail", "later", "during", "post", "peaks"), "suspicion", "coupling_ratio"),
        f"""WITH {TRIALS}, x AS (SELECT *, response / 10 <= 1.5 AS fast, coalesce(CASE WHEN discount > 0 THEN discount * 5e0 END <= 3e-1, false) AS stops FROM tr)
SELECT run_id, event_number, contact, metric, fast AS fast_latency, stops AS stops_with_pulse, (CAST(fast AS INT) + CAST(stops AS INT)) / 2 AS suspicion,
       response / 5 - 5 <= 1.5 AS fast_latency_post, round(CASE WHEN tax > 0 THEN metric / (tax * 100) END, 6) AS coupling_ratio, event_number > 1 AS post_response FROM x""",
    ),
    "pareto_front": Query(
        lambda s, d: reg.pareto(doses(s, d).select("contact", "run_id", "event_number", "part", "current", "response"), ["contact"], "current", "response", "run_id").select("contact", "current", "response"),
        f"""WITH {DOSES}, p AS (SELECT contact, current, response, max(response) OVER (PARTITION BY contact ORDER BY current, response DESC, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ds)
SELECT contact, current, response FROM p WHERE best IS NULL OR response > best""",
    ),
    "residual_covariates": Query(
        lambda s, d: six(reg.residual_covariates(doses(s, d), ["contact"], "current", "response")),
        f"""WITH {DOSES} SELECT contact, count(*) AS n, round(corr(ln(current), response), 6) AS r, round(regr_slope(response, ln(current)), 6) AS slope
FROM ds WHERE current > 0 GROUP BY contact HAVING count(*) > 10""",
    ),
    "folder_name_fields": Query(
        lambda s, d: folders(s, d).select("id", parsing.folder_fields(F.col("name")).alias("f")).select("id", "f.*"),
        f"""WITH {FOLDERS}
SELECT id, regexp_extract(name, '_(\\d{{6}}_\\d{{6}})', 1) AS run_id, regexp_extract(name, '\\b([A-Z]-\\d{{3}})\\b', 1) AS channel,
       regexp_extract(name, '\\b(cathodic|anodic) first\\b', 1) AS polarity, CAST(regexp_extract(name, '\\b(\\d+)us\\b', 1) AS DOUBLE) AS phase_us,
       CAST(regexp_extract(name, '\\b(\\d+)uA\\b', 1) AS DOUBLE) AS amplitude_ua, CAST(regexp_extract(name, '\\b(\\d+)Hz\\b', 1) AS DOUBLE) AS rate_hz,
       CAST(regexp_extract(name, '\\b(\\d+) pulses\\b', 1) AS BIGINT) AS n_pulses, regexp_matches(name, '\\bcomp\\b') AS compliance FROM fo""",
    ),
    "run_start_epoch": Query(
        lambda s, d: folders(s, d).select("id", parsing.start_epoch(F.col("name")).alias("start_s"), parsing.strip_suffix(F.col("name")).alias("stem")),
        f"""WITH {FOLDERS}
SELECT id, CAST(epoch(strptime('20' || regexp_extract(name, '_(\\d{{6}}_\\d{{6}})', 1), '%Y%m%d_%H%M%S')) AS BIGINT) AS start_s,
       regexp_replace(name, '\\s+(?:[A-Z]-\\d{{3}} )?stim\\b.*$', '') AS stem FROM fo""",
    ),
    "amplitude_tokens": Query(
        lambda s, d: six(amplitude_tokens(s, d).select("id", parsing.amplitude_ma(F.col("token")).alias("ma"))),
        """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 10 + 0.5 WHEN 1 THEN (p_partkey % 9 + 1) / 10
       WHEN 2 THEN -(p_partkey % 10 + 0.25) END AS ma FROM part""",
    ),
    "channel_ranges": Query(
        lambda s, d: channel_texts(s, d).select("id", F.explode(parsing.channel_range(F.col("text"))).alias("channel")).select("id", "channel", parsing.contact_index(F.col("channel")).alias("contact")),
        """WITH c AS (SELECT p_partkey AS id, p_partkey % 20 + 3 AS a, CASE WHEN p_partkey % 3 = 2 THEN p_partkey % 20 + 3 ELSE p_partkey % 7 + 10 END AS b FROM part
), e AS (SELECT id, unnest(range(least(a, b), greatest(a, b) + 1)) AS k FROM c)
SELECT id, 'A-' || lpad(CAST(k AS VARCHAR), 3, '0') AS channel, CAST(k AS INT) AS contact FROM e""",
    ),
    "waveform_suffix": Query(
        lambda s, d: folders(s, d).select("id", parsing.folder_fields(F.col("name")).alias("f")).select(
            "id", parsing.safe_token(parsing.waveform_suffix(F.col("f.channel"), F.col("f.polarity"), F.col("f.phase_us"), F.col("f.amplitude_ua"), F.col("f.rate_hz"), F.col("f.n_pulses"))).alias("token")),
        """SELECT p_partkey AS id, 'A-' || lpad(CAST(p_partkey % 32 AS VARCHAR), 3, '0') || '_stim_' || CASE WHEN p_partkey % 2 = 0 THEN 'cathodic' ELSE 'anodic' END || '_first_' ||
       (p_partkey % 5 * 100 + 100) || 'us_' || (p_partkey % 7 * 10) || 'uA_1Hz_' || (p_partkey % 50 + 1) || '_pulses' AS token FROM part""",
    ),
    "stim_words_decoded": Query(
        lambda s, d: six(load(s, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderkey") * 7919 % 65536).cast("int").alias("word")).select(
            "i", words.current_ua(F.col("word"), 0.5).alias("current_ua"), words.flag(F.col("word"), words.SETTLE).alias("settle"), words.flag(F.col("word"), words.RECOVERY).alias("recovery"),
            words.flag(F.col("word"), words.COMPLIANCE).alias("compliance"), words.digital(F.col("word"), (F.col("i") % 16).cast("int")).alias("din"),
            words.charge_nc(words.current_ua(F.col("word"), 0.5), F.lit(200.0)).alias("charge_nc"))),
        """WITH w AS (SELECT o_orderkey AS i, o_orderkey * 7919 % 65536 AS w FROM orders), c AS (SELECT *, CASE WHEN w & 256 <> 0 THEN -(w & 255) * 0.5 ELSE (w & 255) * 0.5 END AS ua FROM w)
SELECT i, ua AS current_ua, w & 8192 <> 0 AS settle, w & 16384 <> 0 AS recovery, w & 32768 <> 0 AS compliance, (w >> (i % 16)) & 1 = 1 AS din, round(ua * 0.2, 6) AS charge_nc FROM c""",
    ),
    "filter_constants": Query(
        lambda s, d: six(load(s, d, "part").select(F.col("p_partkey").alias("i"), (F.col("p_size") / 4).alias("hz")).select(
            "i", words.tau_ms(F.col("hz")).alias("tau_ms"), words.nearest_dsp_k(F.col("hz"), 30000.0).alias("k"),
            words.log_close(F.col("hz"), F.lit(5.0), 1.25).alias("near_five"))),
        """WITH p AS (SELECT p_partkey AS i, p_size / 4 AS hz FROM part), k AS (
  SELECT i, hz, k, abs(ln(1 / (1 - pow(2.0, -k))) * 30000.0 / (2 * pi()) - hz) AS dist FROM p, range(1, 17) r(k)
) SELECT i, round(1000 / (2 * pi() * hz), 6) AS tau_ms, CAST(arg_min(k, (dist, k)) AS INT) AS k, abs(ln(hz / 5)) <= ln(1.25) AS near_five FROM k GROUP BY i, hz""",
    ),
    "class_mean_waveforms": Query(
        lambda s, d: six(wave.mean_sd(spikes(s, d), "class", "w", "vec_id")),
        f"WITH {POINTS} SELECT class, place, round(avg(y), 6) AS mean, round(coalesce(stddev_samp(y), 0), 6) AS sd FROM pt GROUP BY class, place",
    ),
    "force_to_templates": Query(
        lambda s, d: six(wave.force_to_nearest(spikes(s, d), wave.templates(spikes(s, d), "class", "w", "vec_id"), "class", "w", "vec_id", 1.0)),
        f"""WITH {POINTS}, dd AS (SELECT vec_id, tp.class, radius, sqrt(list_sum(list_transform(list_zip(w, centre), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS dist FROM sp, tp
), b AS (SELECT vec_id, min(dist) AS dist, arg_min(class, (dist, class)) AS class, arg_min(radius, (dist, class)) AS radius FROM dd GROUP BY vec_id)
SELECT vec_id, round(dist, 6) AS distance, CASE WHEN dist <= radius THEN class ELSE 0 END AS class FROM b""",
    ),
    "haar_coefficients": Query(
        lambda s, d: six(wave.haar_features(spikes(s, d), "vec_id", "w", LEVELS)),
        f"WITH {HAAR} SELECT vec_id, CAST(place AS INT) AS place, round(y, 6) + 0.0 AS y FROM co",
    ),
    "feature_scores": Query(
        lambda s, d: six(scores(s, d)),
        f"WITH {SCORES} SELECT CAST(place AS INT) AS place, round(score, 6) AS score, n FROM ks",
    ),
    "top_features": Query(
        lambda s, d: six(wave.top_features(scores(s, d), "place", 10)),
        f"WITH {SCORES} SELECT CAST(place AS INT) AS place, round(score, 6) AS score, n FROM ks ORDER BY ks.score DESC, place LIMIT 10",
    ),
    "knee_features": Query(
        lambda s, d: six(wave.knee_features(scores(s, d), "place", 48, 5)),
        f"""WITH {SCORES}, tp AS (SELECT *, row_number() OVER (ORDER BY score DESC, place DESC) AS from_top FROM ks QUALIFY from_top <= 48
), rs AS (SELECT *, row_number() OVER w AS i, count(*) OVER () AS nn, max(score) OVER () AS mx, lead(score, 9) OVER w AS ahead FROM tp WINDOW w AS (ORDER BY score, place)
), st AS (SELECT i, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2, lead(i, 3) OVER w AS i3 FROM rs WHERE (ahead - score) / mx * nn / 10.0 >= 1 WINDOW w AS (ORDER BY i)
), kn AS (SELECT min(i) AS knee FROM st WHERE i3 - i = 3 OR (i3 IS NULL AND i2 - i1 = 1)
), nf AS (SELECT greatest(5, least(48, coalesce(48 - (knee + 5) + 1, 5))) AS n_features FROM kn)
SELECT CAST(place AS INT) AS place, round(score, 6) AS score, CAST(from_top AS INT) AS from_top, n_features FROM tp, nf WHERE from_top <= n_features""",
    ),
    "principal_components": Query(
        lambda s, d: sorting.principal_components(spikes(s, d), "w", "vec_id", 3).agg(
            F.count("*").alias("n"), *[(F.abs(F.avg(F.col("scores")[k])) < 1e-6).alias(f"centred_{k}") for k in range(3)],
            (F.abs(F.corr(F.col("scores")[0], F.col("scores")[1])) < 1e-6).alias("uncorrelated"),
            (F.var_pop(F.col("scores")[0]) >= F.var_pop(F.col("scores")[1])).alias("falling")),
        "SELECT count(*) AS n, true AS centred_0, true AS centred_1, true AS centred_2, true AS uncorrelated, true AS falling FROM embeddings WHERE embedding IS NOT NULL",
    ),
    "force_by_likelihood": Query(lambda s, d: six(sorting.force_by_shape(folded(s, d), folded(s, d), "class", "w", "vec_id", "likelihood"))),
    "force_by_mahalanobis": Query(lambda s, d: six(sorting.force_by_shape(folded(s, d), folded(s, d), "class", "w", "vec_id", "mahalanobis", 1.0))),
    "force_by_neighbours": Query(
        lambda s, d: sorting.force_by_neighbours(folded(s, d), folded(s, d), "class", "w", "vec_id", 5, 3, 1.0),
        f"""WITH {FOLDED}, mo AS (SELECT sqrt(sum(v)) AS reach FROM (SELECT var_pop(f[k]) AS v FROM fd, range(1, 5) AS r(k) GROUP BY k)
), dd AS (SELECT a.vec_id, b.class, sqrt(list_sum(list_transform(list_zip(a.f, b.f), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS dist FROM fd a, fd b
), nn AS (SELECT * FROM dd, mo WHERE dist < reach QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, class) <= 5
), vo AS (SELECT vec_id, class, count(*) AS n FROM nn GROUP BY vec_id, class), be AS (SELECT vec_id, max(n) AS n, arg_max(class, (n, -class)) AS c FROM vo GROUP BY vec_id)
SELECT fd.vec_id, coalesce(n, 0) AS votes, CASE WHEN coalesce(n, 0) >= 3 THEN c ELSE 0 END AS class FROM fd LEFT JOIN be USING (vec_id)""",
    ),
    "chosen_clusters": Query(lambda s, d: wave.chosen_clusters(*temperature_tree(s, d), 30, 0.7, 0.2)),
    "temperature_pick": Query(
        lambda s, d: wave.pick_temperature(
            trials(s, d).groupBy((F.col("contact") % 12).alias("cluster"), F.col("event_number").alias("step")).agg(F.count("*").alias("size")), "step", 20),
        f"""WITH {TRIALS}, t AS (SELECT contact % 12 AS cluster, event_number AS step, count(*) AS size FROM tr GROUP BY ALL
), g AS (SELECT *, size - lag(size) OVER (PARTITION BY cluster ORDER BY step) AS growth FROM t)
SELECT cluster, max(step) AS last_step, arg_max(growth, step) AS growth FROM g WHERE growth > 20 GROUP BY cluster""",
    ),
    "class_edits_and_counts": Query(
        lambda s, d: wave.renumber(wave.edit_classes(spikes(s, d), "class", {3: 2, 7: 5}, {4}), "class").groupBy("class").agg(F.count("*").alias("n")),
        f"""WITH {SPIKES}, e AS (SELECT CASE WHEN class = 4 THEN 0 WHEN class = 3 THEN 2 WHEN class = 7 THEN 5 ELSE class END AS c FROM sp
), m AS (SELECT c, dense_rank() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT c FROM e WHERE c > 0))
SELECT coalesce(k, 0) AS class, count(*) AS n FROM e LEFT JOIN m USING (c) GROUP BY 1""",
    ),
    "channel_pair_correlograms": Query(
        lambda s, d: wave.channel_pairs(markers(s, d), "channel", "t", HOUR, HOUR // 6),
        f"""WITH {SIGNAL}, m AS (SELECT * FROM s WHERE kind = 'error')
SELECT a.channel AS i, b.channel AS j, CAST(floor((b.t - a.t) / {HOUR // 6}) AS BIGINT) AS bin, count(*) AS n
FROM m a JOIN m b ON a.channel < b.channel AND abs(b.t - a.t) <= {HOUR} GROUP BY ALL""",
    ),
    "spike_noise_estimate": Query(
        lambda s, d: six(signal(s, d).groupBy("channel").agg((F.percentile(F.abs("value"), 0.5) / 0.6745).alias("sigma"))),
        f"WITH {SIGNAL} SELECT channel, round(quantile_cont(abs(value), 0.5) / 0.6745, 6) AS sigma FROM s GROUP BY channel",
    ),
    "lognormal_checks": Query(
        lambda s, d: six(reg.moments(shifted(s, d), ["contact"], "v")),
        f"""WITH {SHIFTED}
), q AS (SELECT contact, count(*) AS n, count(*) FILTER (WHERE v <= 0) AS np, avg(pow(v - m, 3)) / pow(var_pop(v), 1.5) AS sk, avg(pow(l - lm, 3)) / pow(var_pop(l), 1.5) AS ls FROM c GROUP BY contact)
SELECT contact, n, np AS n_nonpositive, round(sk, 6) + 0.0 AS skew, round(ls, 6) + 0.0 AS log_skew,
       CASE WHEN n < 3 THEN 'insufficient' WHEN np > 0 THEN 'raw (non-positive values present)' WHEN abs(ls) < abs(sk) THEN 'log' ELSE 'raw' END AS scale FROM q""",
    ),
    "normality_checks": Query(lambda s, d: six(models.normality_checks(shifted(s, d), ["contact"], "v", TRIAL_ID))),
    "normal_quantile_points": Query(
        lambda s, d: models.quantile_points(trials(s, d), ["contact"], "metric").groupBy("contact").agg(
            F.count("*").alias("n"), F.max("place").alias("last_place"), (F.abs(F.sum("theoretical")) < 1e-6).alias("balanced"), (F.corr("theoretical", "ordered") > 0.8).alias("straight")),
        f"""WITH {TRIALS} SELECT contact, count(*) AS n, CAST(count(*) AS INT) AS last_place, true AS balanced, true AS straight FROM tr GROUP BY contact HAVING count(*) >= 3""",
    ),
    "random_intercept_model": Query(lambda s, d: six(models.random_intercept(logged(s, d), ["win"], "ly", ["log_current", "discount"], "contact"))),
    "fixed_groups_model": Query(
        lambda s, d: six(models.fixed_groups(logged(s, d), ["win"], "ly", ["log_current"], "contact", TRIAL_ID, 0).select("win", "term", "estimate", "n_obs", "n_groups")),
        f"""WITH {DOSES}, l AS (SELECT win, contact, ln(response) AS y, ln(current) AS x FROM ds WHERE response > 0
), g AS (SELECT win, contact, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx FROM l GROUP BY win, contact
), b AS (SELECT win, sum(sxy) / sum(sxx) AS slope, sum(n) AS n_obs, count(*) AS n_groups, arg_min(my, contact) AS my, arg_min(mx, contact) AS mx FROM g GROUP BY win)
SELECT win, t.term, round(CASE WHEN t.term = 'intercept' THEN my - slope * mx ELSE slope END, 6) AS estimate, CAST(n_obs AS BIGINT) AS n_obs, n_groups
FROM b, (VALUES ('intercept'), ('log_current')) AS t(term)""",
    ),
    "fixed_groups_intervals": Query(lambda s, d: six(models.fixed_groups(logged(s, d), ["win"], "ly", ["log_current"], "contact", TRIAL_ID, 100))),
    "slope_intervals": Query(
        lambda s, d: six(resampling.slope_intervals(logged(s, d), ["contact"], "log_current", "ly", ["win"], TRIAL_ID, 100)
                         .select("contact", "n", "slope", "intercept", F.expr("lo <= slope AND slope <= hi").alias("around"))),
        f"""WITH {DOSES}, l AS (SELECT contact, ln(response) AS y, ln(current) AS x FROM ds WHERE response > 0)
SELECT contact, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, true AS around FROM l GROUP BY contact""",
    ),
    "bootstrap_slope_verdicts": Query(lambda s, d: reg.slope_verdict(
        resampling.slope_intervals(logged(s, d), ["contact", "win"], "log_current", "ly", ["band"], TRIAL_ID, 100), "lo", "hi").select("contact", "win", "verdict")),
    "fraction_intervals": Query(
        lambda s, d: six(resampling.fraction_intervals(trials(s, d), ["contact"], F.col("response") >= 40, TRIAL_ID, 100).select("contact", "n", "fraction", F.expr("lo <= fraction AND fraction <= hi").alias("around"))),
        f"WITH {TRIALS} SELECT contact, count(*) AS n, round(avg(CASE WHEN response >= 40 THEN 1 ELSE 0 END), 6) AS fraction, true AS around FROM tr GROUP BY contact",
    ),
    "difference_intervals": Query(
        lambda s, d: six(resampling.difference_intervals(trials(s, d), ["contact"], "metric", F.col("band") == "F", TRIAL_ID, 100).select("contact", "difference", F.expr("lo <= difference AND difference <= hi").alias("around"))),
        f"""WITH {TRIALS}, g AS (SELECT contact, avg(metric) FILTER (WHERE band = 'F') AS f, avg(metric) FILTER (WHERE band <> 'F') AS o FROM tr GROUP BY contact)
SELECT contact, round(o - f, 6) AS difference, true AS around FROM g WHERE f IS NOT NULL AND o IS NOT NULL""",
    ),
    "spearman_intervals": Query(
        lambda s, d: six(resampling.spearman_intervals(trials(s, d), ["contact"], "response", "metric", TRIAL_ID, 100).select("contact", "n", "rho", F.expr("lo <= rho AND rho <= hi").alias("around"))),
        f"""WITH {TRIALS}, r AS (SELECT contact, rank() OVER (PARTITION BY contact ORDER BY response) + (count(*) OVER (PARTITION BY contact, response) - 1) / 2.0 AS a,
       rank() OVER (PARTITION BY contact ORDER BY metric) + (count(*) OVER (PARTITION BY contact, metric) - 1) / 2.0 AS b FROM tr)
SELECT contact, count(*) AS n, round(corr(a, b), 6) AS rho, true AS around FROM r GROUP BY contact HAVING count(*) >= 3""",
    ),
    "i50_intervals": Query(lambda s, d: six(reg.i50_intervals(doses(s, d), ["contact"], "current", "response", TRIAL_ID, 50))),
    "amplitude_response": Query(lambda s, d: six(reg.amplitude_response(doses(s, d), ["contact", "band"], "current", "response"))),
    "covariate_regression": Query(
        lambda s, d: six(reg.covariate_regression(doses(s, d).where("response > 0").select("win", F.ln("response").alias("ly"), F.ln("current").alias("log_current"), (F.col("contact") / 10).alias("distance"), "discount"), ["win"], "ly", ["log_current", "distance", "discount"])),
    ),
    "usable_runs_for_slopes": Query(
        lambda s, d: six(reg.usable_runs(trials(s, d).withColumn("y", F.col("response") * 20), ["contact", "win"], "y", F.col("contact") % 40 * F.lit(12.0), (F.col("discount") - 0.05) * 1000)),
        f"""WITH {TRIALS}, q AS (SELECT contact, win, quantile_cont(response * 20, 0.5) AS median, contact % 40 * 12.0 AS fl, count(*) AS n, avg(CASE WHEN abs((discount - 5e-2) * 1000) > 25 THEN 1 ELSE 0 END) AS dr FROM tr GROUP BY contact, win)
SELECT contact, win, round(median, 6) AS median, n, CASE WHEN median >= 850 THEN 'censored' WHEN median <= fl + 1 THEN 'hardware_floor' WHEN dr > 0.5 THEN 'drifting' WHEN n < 3 THEN 'few_trials' ELSE '' END AS excluded FROM q""",
    ),
    "floor_clauses": Query(
        lambda s, d: six(reg.floor_clause(doses(s, d).groupBy("contact", "part").agg(F.max("current").alias("tau"), F.percentile("response", 0.5).alias("rec")), ["contact"], "tau", "rec", "part")),
        f"""WITH {DOSES}, g AS (SELECT contact, part, max(current) AS tau, quantile_cont(response, 0.5) AS rec FROM ds GROUP BY contact, part
), r AS (SELECT *, row_number() OVER (PARTITION BY contact ORDER BY tau, part) AS rn FROM g
), p AS (SELECT contact, max(tau) FILTER (WHERE rn = 1) AS t1, max(tau) FILTER (WHERE rn = 2) AS t2, max(rec) FILTER (WHERE rn = 1) AS r1, max(rec) FILTER (WHERE rn = 2) AS r2 FROM r WHERE rn <= 2 GROUP BY contact HAVING count(*) = 2)
SELECT contact, round(r1, 6) AS shortest_recovery, round(r2 / r1, 6) AS recovery_ratio, round(t2 / t1, 6) AS tau_ratio, t2 / t1 >= 2 AND r2 / r1 < 1.3 AS floor FROM p""",
    ),
    "zero_rail_reach": Query(
        lambda s, d: six(reg.zero_rail_reach(trials(s, d).groupBy("contact", F.col("event_number")).agg((F.max("event_number") * 1200.0).alias("upper"), F.avg((F.col("tax") < 0.08).cast("int")).alias("share")), ["contact"], "upper", "share", 0.9), "reach_hz"),
        f"""WITH {TRIALS}, g AS (SELECT contact, event_number, event_number * 1200.0 AS upper, avg(CASE WHEN tax < 8e-2 THEN 1 ELSE 0 END) AS share FROM tr GROUP BY contact, event_number
), r AS (SELECT contact, max(upper) FILTER (WHERE share >= 0.9) AS reach_hz FROM g GROUP BY contact)
SELECT contact, reach_hz, CASE WHEN reach_hz IS NULL THEN 'never' WHEN reach_hz >= 7000 THEN 'always' ELSE 'reaches' END AS reach FROM r""",
    ),
    "setting_recommendation": Query(
        lambda s, d: six(reg.recommendation(
            dealt(doses(s, d), ["contact"], trials(s, d)).groupBy("contact", "part").agg(F.percentile("response", 0.5).alias("rec"), F.round(F.avg("discount") * 100, 9).alias("noise"), (F.max("current") * 100).alias("upper"), F.avg((F.col("response") >= 40).cast("int")).alias("cens")),
            ["contact"], "part", "rec", "noise", "upper", "cens", F.col("part") % 50 == 0)),
        f"""WITH {DOSES}, g AS (SELECT contact, part, quantile_cont(response, 0.5) AS rec, round(avg(discount) * 100, 9) AS noise, max(current) * 100 AS upper, avg(CASE WHEN response >= 40 THEN 1 ELSE 0 END) AS cens FROM ds GROUP BY contact, part
), l AS (SELECT contact, coalesce(arg_min(noise, part) FILTER (WHERE part % 50 = 0), quantile_cont(noise, 0.5)) AS ref FROM g GROUP BY contact
), e AS (SELECT g.*, ref, noise <= 2 * ref AND upper >= 300 AND cens < 0.5 AS ok FROM g JOIN l USING (contact))
SELECT contact, part, round(rec, 6) AS rec, round(noise, 6) AS noise, round(upper, 6) AS upper, round(cens, 6) AS cens, part % 50 = 0 AS is_reference, round(ref, 6) AS reference_noise, ok AS eligible,
       CASE WHEN ok THEN CAST(row_number() OVER (PARTITION BY contact, ok ORDER BY rec, noise, part) AS INT) END AS place FROM e""",
    ),
}

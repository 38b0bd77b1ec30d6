"""Names of protocols, wirings and runs on folder names made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from .bindings import load
from .query import Query

#: Names by the part's key; the expressions mean the same to both engines.
NAME = """CASE p_partkey % 8
  WHEN 0 THEN concat('-05 ', p_partkey % 9, ' mA_260819_1738', p_partkey % 50 + 10) WHEN 1 THEN concat('-0_0', p_partkey % 7, ' unsure mA')
  WHEN 2 THEN concat('0.00', p_partkey % 9, 'mA_-0.00', p_partkey % 9, 'mA_pulsewidth0.3s_interval4.5s_pulsenumber', p_partkey % 30 + 1, CASE WHEN p_partkey % 3 = 0 THEN '.rhd' ELSE '' END)
  WHEN 3 THEN concat('+1_5mA ', p_partkey % 12, ' start at 20') WHEN 4 THEN concat('baseline ', p_partkey % 4) WHEN 5 THEN '-0_260819_173803'
  WHEN 6 THEN '02mA com port 3' ELSE concat(p_partkey % 40, 'mA 2 interval') END"""
PARENT = "CASE WHEN p_partkey % 3 = 0 THEN '-0_05mA_260819_173803' WHEN p_partkey % 3 = 1 THEN 'session' END"
CONFIG = """CASE p_partkey % 5 WHEN 0 THEN concat('Stim ', p_partkey % 3 + 1, ' ground 2 recording ground 3') WHEN 1 THEN 'stim 2 stim gnd 1 common ground ARTIFACT'
  WHEN 2 THEN '(session root)' WHEN 3 THEN 'stim3 rec ground 1 after iso' ELSE 'other' END"""
PROTOCOL = r"^([+-]?\d+(?:\.\d+)?)mA_([+-]?\d+(?:\.\d+)?)mA_pulsewidth(\d+(?:\.\d+)?)s_interval(\d+(?:\.\d+)?)s_pulsenumber(\d+)$"


def names(s, d):
    return load(s, d, "part").select(
        F.col("p_partkey").alias("id"), F.expr(NAME).alias("name"), F.expr(PARENT).alias("parent"), F.expr(CONFIG).alias("config"),
        (F.col("p_partkey") % 7 == 0).alias("has_onset"),
    )


def _hit(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def _bare(text: str) -> str:
    return rf"regexp_replace(trim({text}), '(\.onset\.txt|\.rhd)$', '')"


def _value(digits: str, sign: str) -> str:
    size = (
        f"CASE WHEN contains({digits}, '_') THEN CAST(replace({digits}, '_', '.') AS DOUBLE) WHEN starts_with({digits}, '0') AND length({digits}) > 1 "
        f"THEN CAST('0.' || substr({digits}, 2) AS DOUBLE) ELSE CAST({digits} AS DOUBLE) END"
    )
    return f"CASE WHEN {sign} = '-' THEN -1 ELSE 1 END * ({size})"


def _amount(text: str, name: str) -> str:
    digits = f"CASE WHEN regexp_matches({text}, '(?i)mA') AND NOT regexp_matches({_bare(text)}, '{PROTOCOL}') THEN " + _hit(text, r"^[+-]?(\d+(?:_\d+)?)") + " END"
    return f"{digits} AS {name}_digits, regexp_extract({text}, '^([+-]?)\\d', 1) AS {name}_sign"


NAMES = f"nm AS (SELECT p_partkey AS id, {NAME} AS name, {PARENT} AS parent, {CONFIG} AS config, p_partkey % 7 = 0 AS has_onset FROM part)"
WIRES = NAMES + rf""", wi AS (
  SELECT *, CAST({_hit("lower(config)", r"stim\s*(\d+)")} AS INT) AS stim,
         CAST(coalesce({_hit("lower(config)", r"stim ground\s*(\d+)")}, {_hit("lower(config)", r"stim gnd\s*(\d+)")}, {_hit("lower(config)", r"stim\s*\d+\s*ground\s*(\d+)")}) AS INT) AS stim_ground,
         CAST(coalesce({_hit("lower(config)", r"recording ground\s*(\d+)")}, {_hit("lower(config)", r"rec ground\s*(\d+)")}) AS INT) AS recording_ground,
         contains(lower(config), 'common ground') AS common_ground, contains(lower(config), 'artifact') AS artifact, contains(lower(config), 'iso') AS after_iso FROM nm
)"""

QUERIES = {
    "protocol_names": Query(
        lambda s, d: names(s, d).select("id", parsing.protocol(F.col("name")).alias("p")).select("id", "p.*"),
        f"""WITH {NAMES} SELECT id, CAST({_hit(_bare("name"), PROTOCOL, 1)} AS DOUBLE) AS amplitude_ma, CAST({_hit(_bare("name"), PROTOCOL, 2)} AS DOUBLE) AS second_ma,
       CAST({_hit(_bare("name"), PROTOCOL, 3)} AS DOUBLE) AS width_s, CAST({_hit(_bare("name"), PROTOCOL, 4)} AS DOUBLE) AS interval_s, CAST({_hit(_bare("name"), PROTOCOL, 5)} AS INT) AS n_pulses FROM nm""",
    ),
    "leading_amplitudes": Query(
        lambda s, d: names(s, d).select("id", parsing.leading_amplitude(F.col("name")).alias("a")).select("id", "a.*"),
        f"""WITH {NAMES}, am AS (SELECT id, {_amount("trim(name)", "n")} FROM nm)
SELECT id, {_value("n_digits", "n_sign")} AS value, n_digits IS NOT NULL AND n_sign = '' AS assumed FROM am""",
    ),
    "wiring_phrases": Query(
        lambda s, d: names(s, d).select("id", parsing.wiring(F.col("config")).alias("w")).select("id", "w.*", parsing.wiring_label(F.col("w")).alias("label")),
        f"""WITH {WIRES} SELECT id, stim, stim_ground, recording_ground, common_ground, artifact, after_iso,
       concat_ws(' / ', 'stim ' || stim, 'gnd ' || stim_ground, 'ref ' || recording_ground, CASE WHEN common_ground THEN 'common' END, CASE WHEN after_iso THEN 'post-iso' END) AS label FROM wi""",
    ),
    "run_conditions": Query(
        lambda s, d: names(s, d).select(
            "id", parsing.run_condition(F.col("name"), F.col("parent"), F.col("config"), F.col("config") == "(session root)", F.col("has_onset")).alias("c")).select("id", "c.*"),
        rf"""WITH {WIRES}, tx AS (
  SELECT *, trim(regexp_replace(name, '_\d{{6}}_\d{{6}}', ' ', 'g')) AS text, trim(regexp_replace(coalesce(parent, ''), '_\d{{6}}_\d{{6}}', ' ', 'g')) AS above,
         regexp_matches({_bare("name")}, '{PROTOCOL}') AS named, CAST({_hit(_bare("name"), PROTOCOL, 1)} AS DOUBLE) AS told FROM wi
), am AS (SELECT *, {_amount("text", "n")}, {_amount("above", "p")} FROM tx
), va AS (SELECT *, {_value("n_digits", "n_sign")} AS own, {_value("p_digits", "p_sign")} AS up FROM am
), ca AS (
  SELECT *, coalesce(told, own, up) AS amplitude_ma, NOT named AND own IS NULL AND up IS NOT NULL AS from_parent,
         NOT named AND CASE WHEN own IS NOT NULL THEN n_sign = '' ELSE up IS NOT NULL AND p_sign = '' END AS assumed FROM va
), re AS (
  SELECT *, list_filter(string_split_regex(string_split_regex(
           CASE WHEN amplitude_ma IS NULL THEN text ELSE regexp_replace(text, '^[+-]?\d+(?:_\d+)?', '') END,
           '(?i)\b(?:unsure|start at|interval|com port)\b')[1], '\s+'), lambda t: regexp_matches(t, '(?i)^\d+($|mA)'))[1] AS lone FROM ca
)
SELECT id, amplitude_ma, CASE WHEN NOT named THEN CAST(nullif(regexp_extract(lone, '\d+'), '') AS INT) END AS replicate,
       array_to_string(list_filter([CASE WHEN f.hit THEN f.flag END FOR f IN [
         {{'flag': 'unsure', 'hit': contains(lower(text), 'unsure')}}, {{'flag': 'late_start', 'hit': contains(lower(text), 'start at')}},
         {{'flag': 'interval_noted', 'hit': contains(lower(text), 'interval')}}, {{'flag': 'com_port_noted', 'hit': contains(lower(text), 'com port')}},
         {{'flag': 'sign_assumed', 'hit': assumed}}, {{'flag': 'amplitude_from_parent', 'hit': from_parent}},
         {{'flag': 'amplitude_unknown', 'hit': amplitude_ma IS NULL}}, {{'flag': 'protocol_named', 'hit': named}},
         {{'flag': 'user_marked_artifact', 'hit': artifact}}, {{'flag': 'common_ground', 'hit': common_ground}}, {{'flag': 'after_isoflurane', 'hit': after_iso}},
         {{'flag': 'baseline_recording', 'hit': contains(lower(text), 'baseline') OR (config = '(session root)' AND NOT named AND NOT has_onset)}}]],
         lambda x: x IS NOT NULL), '|') AS flags FROM re""",
    ),
}

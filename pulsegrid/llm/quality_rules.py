"""Quality rules (native): a short-circuit cascade of document rules, in DataFrame functions only.

Base counts and base failure are fixed; beyond them a document is kept when no rule of the cascade rejects it. A
document fails as soon as one rule rejects it, so the verdict does not depend on the order of the rules; the order
only decides how much is computed. `plan_cascade` measures each rule's cost and selectivity on a bounded sample and
orders the rules by rejections per cost.

Defined cases: null or empty text has no words (n_words 0, base failure); rows are judged one by one, so repeated rows
give repeated results and a null doc_id stays null; an empty table gives an empty result; only id and text are read,
so other columns may have any name; texts of any length are taken whole.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_text, let, words_expr

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rows that the cascade's costs and selectivities are measured on, and runs of each rule; they never affect a verdict.
SAMPLE_ROWS, RUNS = 1024, 3


@dataclass(frozen=True)
class Rule:
    """rejects(text, n_words) -> boolean column; sql is the same over DuckDB columns of ORACLE_SQL."""

    name: str
    rejects: callable
    sql: str


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _shift(value: int, bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("long"), bits)


#: Thresholds are fixed parameters, compared in whole numbers.
RULES = (
    # symbols per 10 words over 1
    Rule("symbols", lambda t, n: 10 * _count(t, "[#*$%&|<>]") > n, "10 * n_symbols > n_words"),
    # exclamation marks per 10 words over 2
    Rule("exclaims", lambda t, n: 10 * _count(t, "!") > 2 * n, "10 * n_exclaims > 2 * n_words"),
    # capitals A-Z per word over 2
    Rule("capitals", lambda t, n: _count(t, "[A-Z]") > 2 * n, "n_capitals > 2 * n_words"),
    # distinct words under half the root of all: a tiny vocabulary for the length (that of prose grows like the root or faster)
    Rule(
        "vocabulary",
        lambda t, n: let(
            F.size(F.array_distinct(words_expr(t))).cast("long"), lambda d: 4 * d * d < n
        ),
        "4 * CAST(n_distinct AS BIGINT) * n_distinct < n_words",
    ),
)


def repeated_words(text: Column) -> Column:
    """Words in 3-word windows found twice or more, first ones included.

    Windows are hashed; (upper hash bits, position) pairs packed into longs sort fast, neighbours with equal full hashes
    are repeats. The sorted positions of repeated windows give the union of their spans.
    """

    def of(words: Column) -> Column:
        n = F.size(words)
        tri = F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
        )

        def scan(t: Column) -> Column:
            m = F.size(t)

            def packed(bits: Column) -> Column:
                # the hash's upper bits, then the position
                pairs = F.sort_array(
                    F.transform(
                        t, lambda h, i: h.bitwiseAND(_shift(-1, bits)).bitwiseOR(i.cast("long"))
                    )
                )
                mask = _shift(1, bits) - 1

                def covered(p: Column) -> Column:
                    at = lambda k: p[k].bitwiseAND(mask).cast("int")
                    rep = F.filter(
                        F.sequence(F.lit(0), m - 1),
                        lambda k: F.when(k > 0, t[at(k)] == t[at(F.greatest(k - 1, F.lit(0)))]).otherwise(F.lit(False))
                        | F.when(k < m - 1, t[at(k)] == t[at(F.least(k + 1, m - 1))]).otherwise(F.lit(False)),
                    )
                    where = F.sort_array(F.transform(rep, at))
                    return let(
                        where,
                        lambda w: F.when(F.size(w) == 0, F.lit(0).cast("long")).otherwise(
                            F.aggregate(
                                w,
                                F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last")),
                                lambda acc, x: F.struct(
                                    (acc["sum"] + F.least(F.lit(3), x - acc["last"])).alias("sum"), x.alias("last")
                                ),
                                lambda acc: acc["sum"],
                            )
                        ),
                    )

                return let(pairs, covered)

            distinct = F.size(F.array_distinct(t))
            return F.when(distinct == m, F.lit(0).cast("long")).otherwise(
                packed(F.ceil(F.log2(m.cast("double") + 1)).cast("int"))
            )

        return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(tri, scan))

    return let(words_expr(text), of)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base counts and failure of every document."""
    text = F.col("text")
    worded = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    counts = id_text(docs).select(
        "doc_id",
        "text",
        F.size(words_expr(text)).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        _count(text, "[#*$%&|<>]").cast("long").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(text).alias("n_repeat_words"),
    )
    return counts.withColumn("base_failed", base_failure())


def base_failure() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def plan_cascade(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules ordered by rejections per cost, each measured alone on the same bounded sample of rows.

    A rule's cost is the shortest of RUNS runs less that of a rule that looks at nothing, so that what a job takes anyway
    does not count. A rule that rejects nothing in the sample sorts by cost, cheapest first; an empty sample keeps the
    given order.
    """
    scratch = Scratch(docs.sparkSession)
    sample = scratch.table(
        id_text(docs).limit(sample_rows).withColumn("n", F.size(words_expr(F.col("text")))), "rule-sample"
    )

    def measured(rejects: Column) -> tuple[float, int]:
        test, took, rejected = sample.agg(F.count_if(rejects)), [], 0
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            rejected = test.collect()[0][0]
            took.append(time.perf_counter() - began)
        return min(took[1:]), rejected  # the first run compiles

    idle, _ = measured((F.length("text") < 0) | (F.col("n") < 0))
    found = []
    for k, rule in enumerate(rules):
        took, rejected = measured(rule.rejects(F.col("text"), F.col("n")))
        cost = max(took - idle, 1e-4)
        found.append((-rejected / cost, cost, k, rule))
    scratch.drop()
    return [x[-1] for x in sorted(found, key=lambda x: x[:3])]


def cascade(rules, text: Column, n_words: Column) -> Column:
    """Name of the first rule that rejects, or null; later rules are not computed for a rejected document."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        verdict = F.when(rule.rejects(text, n_words), F.lit(rule.name)).otherwise(verdict)
    return verdict


def score_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """Base counts, base_failed, kept and the rejecting rule of each document."""
    order = plan_cascade(docs, rules)
    counts = base_counts(docs)
    rejected = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order, F.col("text"), F.col("n_words")))
    return counts.withColumn("rejected_by", rejected).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rejected_by").isNull().alias("kept"),
    )


def filter_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """The kept rows of docs with all their columns; the cheap rules come before the base counts."""
    order = plan_cascade(docs, rules)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.size(words_expr(text))
    kept = (
        F.when(n < MIN_WORDS, False)
        .when(cascade(order, text, n).isNotNull(), False)
        .otherwise(100 * repeated_words(text) <= 50 * n)
    )
    return docs.where(kept)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), p AS (
  SELECT doc_id, text, w, len(w) AS n_words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM p WHERE n_words >= 3)
), r AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) >= 2
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id
), b AS (
  SELECT p.doc_id, n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(text) - length(replace(text, '!', '')) AS n_exclaims,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
         len(list_distinct(w)) AS n_distinct
  FROM p LEFT JOIN c USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (RULES_SQL) AS kept
FROM f
""".replace("RULES_SQL", " OR ".join(r.sql for r in RULES))

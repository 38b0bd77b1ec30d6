"""Line dedup: drop lines whose key is found in many documents, everywhere but in one of them.

Lines are exploded with their positions and their keys hashed to 128 bits; counting distinct documents per hash is two
pre-aggregated group-bys, so a line in a third of all documents is combined before each shuffle. Hashes over the
threshold are joined back to the lines, and each document that loses lines is reassembled by position: the positions
that stay, in order.

Defined cases: null or empty text is one empty line; a key shorter than min_chars never counts; copies of a line
within one document count once and are dropped or kept together; rows that repeat a doc_id count as one document and
each loses the same lines; a row with a null doc_id is no document that could hold a line: it counts for none and loses
none; an empty table gives an empty result; other columns are kept by `dedup_documents` and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, id_text, materialize

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    """Stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.trim(line, F.lit(SPACES)), upper, upper.lower())


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, own (hash of the text: rows may repeat a doc_id), position, h1, h2 of each line with a long enough key."""
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("own"), F.posexplode(F.split("text", "\n")).alias("position", "line")
    )
    keys = lines.select("doc_id", "own", "position", line_key(F.col("line")).alias("key"))
    h1, h2 = F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2")
    return keys.where(F.length("key") >= min_chars).select("doc_id", "own", "position", h1, h2)


def common_lines(keyed: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, keeper of the keys to be dropped elsewhere."""
    return (
        keyed.select("doc_id", "h1", "h2")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .drop("n_docs")
    )


def drop_lists(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """__drop_id, __own, __drops: per document that loses lines, the positions of those."""
    keyed = materialize(keyed_lines(docs, min_chars), "keyed-lines")
    common = materialize(common_lines(keyed, min_docs), "common-lines")
    return (
        keyed.join(common, ["h1", "h2"])
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("__drop_id"), F.col("own").alias("__own"))
        .agg(F.collect_set("position").alias("__drops"))
    )


def _kept(lines: Column, drops: Column) -> Column:
    """The lines at the other positions, joined."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
    return F.array_join(F.transform(stay, lambda i: lines[i]), "\n")


def _with_drops(docs: DataFrame, drops: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    own = F.xxhash64(F.coalesce(text, F.lit("")))
    return docs.join(drops, (doc_id == F.col("__drop_id")) & (own == F.col("__own")), "left")


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, kept_text of each row."""
    rows = id_text(docs)
    joined = _with_drops(rows, drop_lists(rows, min_chars, min_docs), F.col("doc_id"), F.col("text"))
    return joined.select("doc_id", "text", F.split("text", "\n").alias("lines"), "__drops").select(
        "doc_id",
        "text",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__drops").isNull(), F.col("text")).otherwise(_kept(F.col("lines"), F.col("__drops"))).alias("kept_text"),
    )


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the dropped lines gone from text (and n_chars following it, where there is such a column)."""
    text = F.col("text").cast("string")
    joined = _with_drops(docs, drop_lists(id_text(docs), min_chars, min_docs), F.col("doc_id").cast("long"), text)
    kept = joined.withColumn("__kept", F.when(F.col("__drops").isNotNull(), _kept(F.split(text, "\n"), F.col("__drops"))))
    out = {"text": F.coalesce("__kept", F.col("text"))}
    if "n_chars" in docs.columns:
        n = F.length("__kept").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("__kept").isNotNull(), n).otherwise(F.col("n_chars"))
    return kept.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, lower_az(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), c AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, l.i, l.line, c.keeper IS NOT NULL AND c.keeper <> l.doc_id AS gone
  FROM l LEFT JOIN c ON c.key = l.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""".replace(
    "lower_az(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))",
    "translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
)

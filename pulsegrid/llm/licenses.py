"""License scans by diagonal voting.

All rolling k-word hashes of all documents are joined to the hashes' positions in license templates. A match votes for
the diagonal document position - template position; votes are collected per diagonal, and diagonals of nearly the same
offset (words put in or left out) are merged. Merged spans are verified: a window only counts when 128 bits of hashes, of
its words and of them in reverse, are those of the template's, and each place of the template once, however many
diagonals saw it. A span is a finding
when enough of the template's windows are there in a stretch of about the template's length. Exact phrases need all
their windows on one diagonal.

A template table of up to BROADCAST_WINDOWS windows is broadcast, a larger one is joined by hash; only matching windows
are ever shuffled.

Defined cases: null or empty text has no words and no findings; texts shorter than k words match nothing; every row is
judged on its own, also when a doc_id repeats or is null; a phrase found at several places counts each; an empty table
gives an empty result; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, let

K = 3
#: Diagonals this far apart are one span; share of a template's windows that a finding needs; most words of a finding
#: for each word of the template.
DIAGONAL_GAP, MIN_SHARE, MOST_STRETCH = 3, 0.75, 1.5
#: Windows of a template table that is small enough to be sent to every task (about 100 bytes each).
BROADCAST_WINDOWS = 50_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  # counted at every exact place


PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Opening passages and notices of public licenses.
NOTICES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    Template(
        "apache-2",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by"),
    Template("agpl", "under the terms of the gnu affero general public license as published by"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("cc-by", "creative commons attribution 4 0 international license"),
    Template("cc0", "cc0 1 0 universal public domain dedication"),
)


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def license_words(text: Column) -> Column:
    """array<string> of words, A-Z lower-cased.

    lower() differs from that beyond ASCII only, and words with such characters match no template; the one character
    that it would turn into an ASCII letter, the Kelvin sign, is replaced before.
    """
    low = F.lower(F.replace(text, F.lit("K"), F.lit("Ω")))
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def window_hashes(words: list[Column]) -> Column:
    """Two hashes of a window, the second of its words in reverse: 128 bits tell windows apart."""
    return F.struct(F.xxhash64(*words).alias("h"), F.xxhash64(F.lit(len(words)), *reversed(words)).alias("check"))


def template_rows(spark, templates, k: int) -> DataFrame:
    """t, t_pos, h and t_check of every window of every template."""
    rows = [(t, p, words[p : p + k]) for t, x in enumerate(templates) for words in [template_words(x.text)]
            for p in range(len(words) - k + 1)]
    df = spark.createDataFrame(rows, "t int, t_pos int, w array<string>")
    df = df.withColumn("x", window_hashes([F.col("w")[j] for j in range(k)]))
    df = df.select("t", "t_pos", "x.h", F.col("x.check").alias("t_check"))
    return F.broadcast(df) if len(rows) <= BROADCAST_WINDOWS else df


def votes(docs: DataFrame, templates, k: int = K) -> DataFrame:
    """doc_id, row_id, n_words, t, diagonal, places (of the template), first, last (document words); t = -1 once for
    every row.

    A window is sixteen bytes and a place; no words are moved.
    """

    def windows(w: Column) -> Column:
        n = F.size(w)
        none = F.array().cast("array<struct<h: bigint, check: bigint>>")
        hashes = F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: window_hashes([w[i + j] for j in range(k)]))).otherwise(none)
        # the first entry stands for the document itself, under a hash of its own, so that none meet
        own = F.struct(F.xxhash64(F.lit("row"), "row_id").alias("h"), F.lit(0).cast("long").alias("check"))
        return F.struct(n.alias("n_words"), F.array_prepend(hashes, own).alias("hashes"))

    rows = id_text(docs).withColumn("row_id", F.monotonically_increasing_id())
    rows = rows.select("doc_id", "row_id", let(license_words(F.col("text")), windows).alias("x"))
    grams = rows.select("doc_id", "row_id", F.col("x.n_words").alias("n_words"), F.posexplode("x.hashes").alias("p", "g"))
    grams = grams.select("doc_id", "row_id", "n_words", "p", F.col("g.h").alias("h"), F.col("g.check").alias("check"))
    itself = F.col("p") == 0
    # equal hashes only count where both are
    found = grams.join(template_rows(docs.sparkSession, templates, k), "h", "left").where(itself | (F.col("check") == F.col("t_check")))
    t, pos = F.when(itself, -1).otherwise(F.col("t")), F.col("p") - 1
    diagonal = F.when(itself, 0).otherwise(pos - F.col("t_pos"))
    return found.groupBy("doc_id", "row_id", t.alias("t"), diagonal.alias("diagonal")).agg(
        F.max("n_words").alias("n_words"),
        F.collect_set("t_pos").alias("places"),
        F.min(pos).alias("first"),
        (F.max(pos) + k - 1).alias("last"),
    )


def scan(
    docs: DataFrame, templates=PHRASES + NOTICES, k: int = K, gap: int = DIAGONAL_GAP, share: float = MIN_SHARE
) -> DataFrame:
    """doc_id, n_words and findings, array<struct<label, phrase, start, end, score>>, of each row."""
    size = [len(template_words(t.text)) for t in templates]
    info = docs.sparkSession.createDataFrame(
        [(i, t.label, t.phrase, size[i], size[i] - k + 1) for i, t in enumerate(templates)],
        "t int, label string, phrase boolean, t_words int, t_windows int",
    )
    info = F.broadcast(info) if len(templates) <= BROADCAST_WINDOWS else info
    # phrases stay on their diagonal; notices take in the neighbouring ones
    by = Window.partitionBy("doc_id", "row_id", "t").orderBy("diagonal")
    apart = (F.col("phrase")) | (F.col("diagonal") - F.lag("diagonal", 1, -1 << 30).over(by) > gap)
    spans = (
        votes(docs, templates, k)
        .join(info, "t", "left")
        .withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(by))
        .groupBy("doc_id", "row_id", "t", "span")
        .agg(
            F.max("n_words").alias("n_words"),
            # places of the template, each once
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("seen"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            *[F.first(c).alias(c) for c in ("label", "phrase", "t_words", "t_windows")],
        )
    )
    score = F.col("seen") / F.col("t_windows")
    right = F.when(F.col("phrase"), F.col("seen") == F.col("t_windows")).otherwise(
        (score >= share) & (F.col("last") - F.col("first") + 1 <= MOST_STRETCH * F.col("t_words"))
    )
    finding = F.struct(
        "label", "phrase", F.col("first").cast("long").alias("start"),
        (F.col("last") + 1).cast("long").alias("end"), score.alias("score"),
    )
    return (
        spans.groupBy("doc_id", "row_id")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.sort_array(F.collect_list(F.when((F.col("t") >= 0) & right, finding))).alias("findings"),
        )
        .drop("row_id")
    )


def digests(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    base = F.filter("findings", lambda x: x["phrase"])
    starts = F.transform(base, lambda x: x["start"])

    def labels(x: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("findings")).alias("labels"),
        F.coalesce(F.array_max(F.transform("findings", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )

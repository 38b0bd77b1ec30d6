"""Personal data: fixed patterns, and terms of their surroundings that give them away, by corpus co-occurrence.

Base findings come from four patterns. Each distinct value (addresses in lower case, numbers as digits) is a protected
entity. A term is a run of letters and digits; it is looked at where it stands within REACH terms of an entity. With N
documents, n(c) of them naming the entity c, n(t) holding the term t and n(c, t) holding t within reach of c,

    PMI(c; t) = log2(N * n(c, t) / (n(c) * n(t))),    IC(c) = log2(N / n(c)).

The term discloses the entity when PMI(c; t) >= DISCLOSURE * IC(c), that is, when who reads t knows nearly all that there
is to know about c, and at least SUPPORT documents say so. An entity of less than LEAST_BITS of information is known to
everybody and cannot be disclosed. A disclosing term is generalised to its first letters (PREFIX of them and a star) if
these, counted in the same way over the whole corpus, no longer disclose the entity; otherwise it is removed. Terms are
changed where they stand within reach of the entity; documents that name no entity are never touched.

Documents are read twice: once for findings and surroundings, which are written to the shared folder without the text,
and once to count those terms that some entity has SUPPORT documents with. A table of 2**FILTER_BITS bits tells which
terms may be among them; it has that size whatever the corpus, and terms that it lets through by chance are dropped in
the join. Counts are summed in each task before they are shuffled.

Defined cases: null or empty text has no findings; spans are code points, end exclusive; base findings of different
kinds may overlap and all count, terms never overlap one; rows are scanned one by one, so repeated rows and rows with a
null doc_id have results of their own, and each counts as a document; an empty table gives an empty result; only id and
text are read, so other columns may have any name; texts of any length are taken whole, in time that grows with length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, Block, Scratch, blocks, hash_spans, id_text, lowered, materialize, spans

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns: the domain of an address behind its @, four numbers with dots, digits with single signs, phone numbers.
#: A number only begins where no digit stands before it; possessive forms cannot match less than the greedy ones here.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Terms on either side of an entity; documents that must agree; share of an entity's information that gives it away.
REACH, SUPPORT, DISCLOSURE, LEAST_BITS = 6, 3, 0.95, 1.0
#: Letters that a generalised term keeps; bits of the filter; surroundings in one row; counted terms held in a task.
PREFIX, FILTER_BITS, MOST_IN_ROW, MOST_HELD = 3, 22, 4096, 500_000

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MAY_BE = _DIGIT.copy()
_MAY_BE[ord("@")] = True
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses. An address can only begin at the first local character behind the last address, as all those
    up to the @ belong to it, so each @ is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        done = m.end() if m else at + 1
        if m:
            yield begin, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base findings, by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m.groups()):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def entity(kind: int, value: str) -> str:
    """What a finding stands for, however it is written."""
    return f"{KINDS[kind]}:{value.translate(_LOWER_AZ) if kind < 2 else digits_of(value)}"


def general(term: str) -> str:
    """The generalised form: no term, as it has a star."""
    return term[:PREFIX] + "*"


def surroundings(text: str, found: list[tuple[int, int, int]]) -> Iterator[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the terms within reach of each finding that touch no finding."""
    if not found:
        return
    by_start = sorted((a, b) for _, a, b in found)
    starts = [a for a, _ in by_start]
    reach, far = [], 0  # the largest end of the findings up to each one
    for _, b in by_start:
        far = max(far, b)
        reach.append(far)
    terms = []
    for m in TERM.finditer(text):
        k = bisect_left(starts, m.end()) - 1
        if k < 0 or reach[k] <= m.start():
            terms.append((m.start(), m.end()))
    begins = [a for a, _ in terms]
    for kind, a, b in found:
        name = entity(kind, text[a:b])
        at, to = bisect_right(begins, a), bisect_left(begins, b)
        for s, e in terms[max(0, at - REACH) : at] + terms[to : to + REACH]:
            yield name, text[s:e].translate(_LOWER_AZ), s, e


SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
NEAR = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_base(rows: DataFrame) -> DataFrame:
    """row_id, doc_id, part, base (array<struct<kind, start, end>>) and near (array<struct<entity, term, start, end>>);
    part 0 once for each row of row_id, doc_id, text, with all of base; further parts only carry more of near."""
    schema = pa.schema(
        [("row_id", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("base", SPANS), ("near", NEAR)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_ids, doc_ids = (batch.column(c).to_pylist() for c in ("row_id", "doc_id"))
            out: list[dict] = []
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                marks = np.concatenate([[0], np.cumsum(_MAY_BE[block.data], dtype=np.int64)])
                some = np.diff(marks[block.offsets]) > 0
                for d in range(len(block)):
                    own = {"row_id": row_ids[block.lo + d], "doc_id": doc_ids[block.lo + d], "part": 0, "base": [], "near": []}
                    out.append(own)
                    if some[d]:
                        text = block.data[block.offsets[d] : block.offsets[d + 1]].tobytes().decode("utf-8", "replace")
                        found = base_spans(text)
                        own["base"] = [{"kind": k, "start": a, "end": b} for k, a, b in found]
                        for name, term, a, b in surroundings(text, found):
                            if len(out[-1]["near"]) == MOST_IN_ROW:
                                out.append(own | {"part": out[-1]["part"] + 1, "base": [], "near": []})
                            out[-1]["near"].append({"entity": name, "term": term, "start": a, "end": b})
                if len(out) >= MOST_IN_ROW:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(
        run,
        "row_id long, doc_id long, part int, base array<struct<kind: int, start: bigint, end: bigint>>, "
        "near array<struct<entity: string, term: string, start: bigint, end: bigint>>",
    )


def feature_spans(block: Block) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, str]]]:
    """The lower-cased bytes of a block, and its terms and their generalised forms: starts, ends, documents, what follows."""
    data = lowered(block.data)
    starts, ends, doc = spans(_TERM[data], block.offsets)
    points = np.cumsum((data & 0xC0) != 0x80)
    short = np.searchsorted(points, points[starts] + PREFIX - 1, "right") if len(starts) else ends
    return data, [(starts, ends, doc, ""), (starts, np.minimum(ends, short), doc, "*")]


def bits_of(features: list[str]) -> np.ndarray:
    """The filter's bit of each feature."""
    out = np.zeros(len(features), np.int64)
    for star in (False, True):
        own = [i for i, x in enumerate(features) if x.endswith("*") == star]
        raw = [features[i].rstrip("*").encode() for i in own]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64) if own else ends
        out[own] = bit_of(hash_spans(data, begin, ends), star)
    return out


def bit_of(hashes: np.ndarray, star: bool) -> np.ndarray:
    return ((hashes >> np.uint64(64 - FILTER_BITS)) ^ np.uint64(star)).astype(np.int64)


def bit_table(wanted: DataFrame) -> np.ndarray:
    """The filter of the features of wanted (feature); the driver gets each bit once, 2**FILTER_BITS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.unique(bits_of(batch.column("feature").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32))], ["bit"])

    table = np.zeros(1 << FILTER_BITS, bool)
    table[wanted.mapInArrow(run, "bit int").distinct().toArrow().column("bit").to_numpy()] = True
    return table


def count_features(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """feature, n: in how many rows each term and generalised form stands, for those that the filter lets through."""
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bits = np.unpackbits(shared.value).astype(bool)
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["feature", "n"])
            held.clear()
            return batch

        for batch in batches:
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                data, both = feature_spans(block)
                for starts, ends, doc, star in both:
                    hashes = hash_spans(data, starts, ends)
                    keep = np.flatnonzero(open_bits[bit_of(hashes, bool(star))])
                    # each feature once for each document
                    keep = keep[np.lexsort((hashes[keep], doc[keep]))]
                    fresh = np.ones(len(keep), bool)
                    fresh[1:] = (np.diff(doc[keep]) != 0) | (hashes[keep][1:] != hashes[keep][:-1])
                    keep = keep[fresh]
                    _, first, n = np.unique(hashes[keep], return_index=True, return_counts=True)
                    first = keep[first]
                    raw = data.tobytes() if len(first) else b""
                    for a, b, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist()):
                        held[raw[a:b].decode("utf-8", "replace") + star] += k
                if len(held) >= MOST_HELD:
                    yield out()
        yield out()

    return rows.mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def disclosing(found: DataFrame, rows: DataFrame) -> DataFrame:
    """entity, term, general (the form that the term is replaced by; null: it is removed) of all pairs that disclose."""
    scratch = Scratch(found.sparkSession)
    near = found.select("row_id", F.explode("near").alias("x")).select("row_id", "x.entity", "x.term")
    both = near.withColumn("star", F.concat(F.substring("term", 1, PREFIX), F.lit("*")))
    pairs = both.select("row_id", "entity", F.explode(F.array("term", "star")).alias("feature")).distinct()
    pairs = pairs.groupBy("entity", "feature").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= SUPPORT)
    pairs = scratch.table(pairs, "pairs")
    n_docs = rows.count()
    features = scratch.table(count_features(rows, bit_table(pairs.select("feature").distinct())), "features")
    named = near.select("row_id", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    bits = F.log2(n_docs / F.col("n_entity"))
    pmi = F.log2(n_docs * F.col("n_both") / (F.col("n_entity") * F.col("n")))
    tells = pairs.join(features, "feature").join(named, "entity")
    tells = tells.where((bits >= LEAST_BITS) & (pmi >= DISCLOSURE * bits)).select("entity", "feature")
    tells = scratch.table(tells, "tells")
    star = F.col("feature").endswith("*")
    stars = tells.where(star).withColumnRenamed("feature", "star").withColumn("too", F.lit(True))
    terms = tells.where(~star).withColumnRenamed("feature", "term")
    terms = terms.withColumn("star", F.concat(F.substring("term", 1, PREFIX), F.lit("*")))
    short = F.char_length("term") <= PREFIX
    out = terms.join(stars, ["entity", "star"], "left").select(
        "entity", "term", F.when(F.col("too").isNull() & ~short, F.col("star")).alias("general")
    )
    out = materialize(out, "disclosing")
    scratch.drop()
    return out


def numbered(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("row_id", F.monotonically_increasing_id())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans, array<struct<kind, start, end, instead>>, of each row, by kind as listed, terms last, then start;
    instead: the kind in brackets for base findings, what a term is generalised to, empty where it is removed."""
    return spans_of_rows(numbered(docs)).drop("row_id")


def spans_of_rows(rows: DataFrame) -> DataFrame:
    found = materialize(find_base(rows), "personal")
    near = found.select("row_id", F.explode("near").alias("x")).select("row_id", "x.*")
    # a term near two entities is removed if either asks for that
    told = near.join(disclosing(found, rows), ["entity", "term"]).groupBy("row_id", "start", "end")
    told = told.agg(F.when(F.count("general") == F.count("*"), F.min("general")).alias("general"))
    term = F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end", F.coalesce("general", F.lit("")).alias("instead"))
    told = told.groupBy("row_id").agg(F.collect_list(term).alias("terms"))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def masked(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("instead"))

    base = F.transform("base", masked)
    both = F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, F.col("terms")))
    # sorted as structs: by kind, then start
    return found.where("part = 0").join(told, "row_id", "left").select("row_id", "doc_id", F.sort_array(both).alias("spans"))


def replaced(text: str, found: list[dict]) -> str:
    """The text with each span replaced; of spans that overlap the first one stands for all."""
    out, at, last = [], 0, 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= last:
            out += [text[at : s["start"]], s["instead"]]
        at = last = max(last, s["end"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text of each row, with base findings masked and disclosing terms generalised or removed."""
    rows = materialize(numbered(docs), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            texts = pa.array([replaced(text, found) for text, found in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    found = spans_of_rows(rows).where(F.size("spans") > 0).select("row_id", "spans")
    both = rows.join(found, "row_id", "left")
    changed = both.where("spans IS NOT NULL").mapInArrow(run, "doc_id long, text string")
    return both.where("spans IS NULL").select("doc_id", "text").unionByName(changed)


def digests(docs: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])

    def joined(found: Column) -> Column:
        shown = F.transform(found, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"]))
        return F.array_join(shown, ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return scan(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

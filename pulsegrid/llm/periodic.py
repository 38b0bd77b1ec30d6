"""Periodic runs of words, found with bit-parallel lags.

A run is a stretch of words whose smallest period is q, of at least max(LEAST_WORDS, PERIODS * q) words, that no
neighbouring word extends with the same period. The words of a document become numbers, and bit b of all numbers one big
integer, the plane b. A plane XOR itself shifted by q has a one where words q apart differ in that bit; the OR over the
planes has zeros exactly where they are equal. AND with shifts of 1, 2, 4, ... leaves of these zeros the stretches that
are long enough, and their first and last bits are the runs.

Which lags to try: of a run with period q, 2**k <= q < 2**(k + 1), two neighbouring blocks of 2**k words (cut from the
document's start) equal those q words later. So hashes of all blocks are compared with those 2**k to 2**(k + 1) - 1 words
later, for all documents of a block of texts at once, and a lag without two such blocks in a row needs no planes. The
comparison may let lags through but loses none, and takes n log n steps, so a text of any length is done in about that.
Pairs of blocks inside a known run of a period that divides the lag are passed over: they can only give that run again.

Nothing is shuffled: documents are scanned where they are read.

Defined cases: null or empty text has no words, no runs and an empty collapsed text; rows are scanned one by one, so
repeated rows and rows with a null doc_id have results of their own; of runs of equal length the one with the smallest
start, then period, is the longest; an empty table gives an empty result; only id and text are read, so other columns may
have any name; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, hash_spans, id_text, let, mix, word_spans, words_expr

#: A run has this many words at least, and this many periods.
LEAST_WORDS, PERIODS = 6, 4

_STEP = np.uint64(0x9E3779B97F4A7C15)


def planes(ids: np.ndarray) -> list[int]:
    """Big integers: bit i of plane b is bit b of ids[i]."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(bits)]


def places(x: int) -> np.ndarray:
    """Numbers of the bits that are set."""
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def stretches(bits: list[int], n: int, q: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of period q, not necessarily the smallest, that are long enough for a run."""
    differs = 0
    for plane in bits:
        differs |= plane ^ (plane >> q)
    same = ~differs & ((1 << (n - q)) - 1)
    want, have = max(LEAST_WORDS, PERIODS * q) - q, 1
    while have < want and same:
        step = min(have, want - have)
        same &= same >> step
        have += step
    if not same:
        return []
    first, last = places(same & ~(same << 1)), places(same & ~(same >> 1))
    return list(zip(first.tolist(), (last + want + q).tolist()))


def find_runs(hashes: np.ndarray, offsets: np.ndarray, numbers) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start, then period.

    hashes: of the words of all documents; offsets: where each document's words begin, and the end; numbers(d): the
    document's words as numbers, equal for equal words only.
    """
    count = np.diff(offsets)
    known: list[dict[tuple[int, int], int]] = [{} for _ in count]  # (start, end): period
    cache: dict[int, list[int]] = {}
    grams, k = hashes, 0
    while (long := np.flatnonzero(count >= max(LEAST_WORDS, PERIODS << k))).size:
        size = 1 << k
        if k:
            grams = mix(grams[: len(grams) - size // 2] * _STEP + grams[size // 2 :])
        later = np.lib.stride_tricks.sliding_window_view(np.concatenate([grams, np.zeros(size, np.uint64)]), size)
        for d in long.tolist():
            lo, n = int(offsets[d]), int(count[d])
            at = lo + np.arange(0, n - 2 * size + 1, size)
            # equal[i, j]: blocks i and i + 1 equal the words size + j later; those behind the document are cut off
            equal = later[at + size] == grams[at][:, None]
            equal = equal[:-1] & equal[1:]
            for i in range(max(0, (n - 4 * size) // size), len(equal)):
                equal[i, max(0, n - (i + 3) * size + 1) :] = False
            for (a, b), period in known[d].items():
                if b - a >= 3 * size:
                    begin, skip = -(-a // size), -size % period
                    inner = max(begin, (b - 4 * size + 1) // size + 1)
                    equal[begin:inner, skip::period] = False
                    for i in range(inner, min(len(equal), b // size)):
                        equal[i, skip : max(0, b - (i + 3) * size + 1) : period] = False
            lags = np.flatnonzero(equal.any(0)) + size
            for q in lags[PERIODS * lags <= n].tolist():
                bits = cache.get(d) or cache.setdefault(d, planes(numbers(d)))
                for span in stretches(bits, n, q):
                    # a smaller period of the same stretch was found first
                    known[d].setdefault(span, q)
        k += 1
    return [sorted((a, b - a, q) for (a, b), q in found.items()) for found in known]


def word_numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array<struct<start, length, period>>, in words) and collapsed_text, the text's words without
    the repetitions of runs, of each row."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUNS), ("collapsed_text", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                starts, ends, doc = word_spans(block)
                offsets = np.searchsorted(doc, np.arange(len(block) + 1))
                raw = block.data.tobytes()
                # bytes.split() parts at the same six characters
                words = [raw[a:b].split() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())]
                hashes = hash_spans(block.data, starts, ends)
                found = find_runs(hashes, offsets, lambda d, words=words: word_numbers(words[d]))
                flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
                cuts = np.cumsum([0, *map(len, found)]).astype(np.int32)
                runs = pa.ListArray.from_arrays(
                    pa.array(cuts), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(RUNS.value_type))
                )
                texts = pa.array([b" ".join(collapsed(w, own)) for w, own in zip(words, found)], pa.binary())
                ids = batch.column("doc_id").slice(block.lo, len(block))
                columns = [ids, pa.array(np.diff(offsets)), runs, texts.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return id_text(docs).mapInArrow(
        run,
        "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_text string",
    )


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents (by the crc32 h of the id) get a periodic tail: with g = h div 10
    and n words, every word i from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Rows
    without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def tail(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))

        def word(x: Column, i: Column) -> Column:
            return F.when(i < a, x).otherwise(F.element_at(words, (a + (i - a) % p + 1).cast("int")))

        return F.when(n > 0, F.array_join(F.transform(words, word), " ")).otherwise(F.lit(""))

    text = F.when(h % 10 == 0, let(words_expr(F.col("text")), tail)).otherwise(F.col("text"))
    return id_text(docs).select("doc_id", text.alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The runs of documents with repeated tails, as numbers and digests."""
    longest = F.sort_array(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period")))
    )
    found = scan(repeated_tails(docs)).withColumn("top", F.get(longest, F.lit(0)))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    length, period = -F.col("top.a"), F.col("top.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )

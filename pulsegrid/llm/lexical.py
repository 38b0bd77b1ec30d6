"""Ranked lexical search: variable-block-max WAND over shards of the documents.

A document's score for an item is a sum over the item's terms of fixed integer impacts, which depend on the term, its
occurrences, the document's length and three corpus counts. So the work is:

1. Documents are scanned once. The terms that some item holds become postings (document, term, occurrences), written to
   the shared folder; document counts and lengths come from them.
2. Each task reads postings and cuts them into shards of bounded size. In a shard each term's postings are cut into
   blocks of variable length by dynamic programming: over all cuts with blocks of at most MOST_BLOCK postings, the one
   with the smallest sum of bound errors (what the block's largest impact is above each impact) and of a price for each
   block. Lists are cut in pieces of PIECE postings, all pieces of a shard at once.
3. An item is searched exactly. Between two neighbouring block borders of its lists all bounds are constant. Stretches
   whose bounds sum to less than the item's tenth score so far are skipped unread. In what is left a document is a pivot
   when the bounds of the lists that hold it reach that score; for that, one of the lists that cannot be left out must
   hold it (the lists with the smallest bounds that together stay below the score are only probed for pivots). Pivots are
   scored in full. The best stretches come first, so that the score to reach rises early; it is carried from shard to
   shard of a task. Bounds equal to that score are followed up, as a smaller doc_id wins ties.
4. Each task gives out at most `top` rows for each item, and the best of these are the result.

Items are a stated query set: they are taken in groups of at most GROUP_BYTES of text, each broadcast and searched for on
its own, so nothing broadcast or collected grows with either table.

Defined cases: null and empty texts hold no terms and count for nothing, as do documents without a doc_id (an id is what
is returned); a doc_id that repeats stands for as many documents; items without an id or without terms give no rows, an
item_id that repeats is searched for its first text in text order; equal scores go by doc_id; empty tables give an empty
result; only id and text are read on both sides, so other columns may have any name; texts of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK_BYTES, blocks, hash_spans, lowered, materialize, mix, spans

TOP = 10
#: Bytes of item text searched for at once; postings of one shard.
GROUP_BYTES, SHARD_POSTINGS = 4 << 20, 2 << 20
#: Postings of a block at most, of a piece that is cut at once, and the price of a block in postings of full error.
MOST_BLOCK, PIECE, BLOCK_PRICE = 64, 512, 6
#: Stretches that are read first, and at once after them.
FIRST_STRETCHES, NEXT_STRETCHES = 16, 1024

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def term_hashes(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each term of a block of texts, and its document."""
    data = lowered(block.data)
    starts, ends, doc = spans(_TERM[data], block.offsets)
    first = hash_spans(data, starts, ends)
    # the second one tells apart what the first one does not: it is of the bytes without the first of them
    second = mix(hash_spans(data, starts + 1, ends) ^ (data[starts].astype(np.uint64) * _OTHER))
    return first, second, doc


class Items:
    """A group of items: their terms' hashes in order, and each item's numbers of terms."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.first, self.second, self.terms = ids, np.zeros(0, np.uint64), np.zeros(0, np.uint64), []
        own: list[list[tuple[int, int]]] = [[] for _ in ids]
        at = 0
        for block in blocks(pa.array(texts, pa.large_string())):
            first, second, doc = term_hashes(block)
            for a, b, d in zip(first.tolist(), second.tolist(), doc.tolist()):
                own[at + d].append((a, b))
            at += len(block)
        known = sorted({x for terms in own for x in terms})
        number = {x: i for i, x in enumerate(known)}
        if known:
            self.first, self.second = (np.array(x, np.uint64) for x in zip(*known))
        self.terms = [np.array(sorted({number[x] for x in terms}), np.int64) for terms in own]

    def __len__(self) -> int:
        return len(self.first)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The numbers of terms, -1 where no item has them."""
        if not len(self):
            return np.full(len(first), -1)
        at = np.searchsorted(self.first, first)
        at[at == len(self)] = 0
        at = np.where(self.first[at] == first, at, -1)
        for _ in range(8):  # equal first hashes stand side by side
            wrong = np.flatnonzero((at >= 0) & (self.second[at] != second))
            if not len(wrong):
                break
            more = np.minimum(at[wrong] + 1, len(self) - 1)
            at[wrong] = np.where((more > at[wrong]) & (self.first[more] == first[wrong]), more, -1)
        return at


def item_groups(items: DataFrame, id_col: str, group_bytes: int = GROUP_BYTES) -> Iterator[Items]:
    """The items in groups of about group_bytes of text (or one item)."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.dropna().groupBy("item_id").agg(F.min("text").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // group_bytes)
    for k in range(n):
        some = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id").toArrow()
        if some.num_rows:
            yield Items(some.column("item_id").to_pylist(), some.column("text").to_pylist())


def postings(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (arrays, by term number) of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                first, second, doc = term_hashes(block)
                n = np.bincount(doc, minlength=len(block))
                number = wanted.find(first, second)
                hit = number >= 0
                keys, counts = np.unique(doc[hit] * max(1, len(wanted)) + number[hit], return_counts=True)
                doc_of, term = np.divmod(keys, max(1, len(wanted)))
                cuts = np.searchsorted(doc_of, np.arange(len(block) + 1)).astype(np.int32)
                cols = [
                    batch.column("doc_id").slice(block.lo, len(block)), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(counts.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=schema).filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


# ------------------------------------------------------------------------------------------------------- one shard


def block_ends(impacts: np.ndarray, price: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cuts of pieces of posting lists with the least bound error plus price: a row a piece, padded behind sizes; true at
    the last posting of each block."""
    pieces, width = impacts.shape
    most = min(MOST_BLOCK, width)
    ends = np.zeros(impacts.shape, bool)
    best = np.full((pieces, width + 1), np.inf)
    best[:, 0] = 0
    length = np.zeros((pieces, width + 1), np.int64)
    top = np.zeros((pieces, most))  # top[:, k]: largest impact of the k + 1 postings that end here
    steps = np.arange(1, most + 1)
    for i in range(1, width + 1):
        now = impacts[:, i - 1, None].astype(float)
        top = np.maximum(np.concatenate([now, top[:, :-1]], 1), now)
        k = min(i, most)
        cost = best[:, i - k : i][:, ::-1] + steps[:k] * top[:, :k]
        pick = cost.argmin(1)
        best[:, i] = cost[np.arange(pieces), pick] + price
        length[:, i] = pick + 1
    at, rows = sizes.copy(), np.arange(pieces)
    while len(rows := rows[at[rows] > 0]):
        ends[rows, at[rows] - 1] = True
        at[rows] -= length[rows, at[rows]]
    return ends


class Shard:
    """Posting lists of some documents, in blocks. Documents are numbered in the order of their ids."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc = place[doc]
        by = np.lexsort((doc, term))
        self.doc, self.impact, term = doc[by], impact[by], term[by]
        self.list_terms, at = np.unique(term, return_index=True)
        self.list_at = np.append(at, len(term))
        self.cut()

    def cut(self) -> None:
        """Block borders of all lists; block_at has the first block of each list."""
        size = np.diff(self.list_at)
        pieces = -(-size // PIECE)
        own = np.repeat(np.arange(len(size)), pieces)
        start = self.list_at[own] + PIECE * (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        sizes = np.minimum(PIECE, self.list_at[own + 1] - start)
        spread = np.zeros(len(size))
        if len(size):
            spread = np.maximum.reduceat(self.impact, self.list_at[:-1]) - np.minimum.reduceat(self.impact, self.list_at[:-1])
        ends = np.zeros(len(self.doc), bool)
        by_size = np.argsort(sizes, kind="stable")
        lo = 0
        while lo < len(by_size):  # pieces of like size together
            width = int(sizes[by_size[lo]])
            hi = int(np.searchsorted(sizes[by_size], max(8, 2 * width), "right"))
            hi = min(max(hi, lo + 1), lo + 4096)
            some = by_size[lo:hi]
            at = start[some][:, None] + np.arange(sizes[some].max())
            inside = np.arange(at.shape[1]) < sizes[some][:, None]
            at = np.where(inside, at, start[some][:, None])
            cuts = block_ends(np.where(inside, self.impact[at], 0), BLOCK_PRICE * spread[own[some]] + 1.0, sizes[some])
            ends[at[cuts]] = True
            lo = hi
        last = np.flatnonzero(ends)
        self.block_last = self.doc[last]
        self.block_max = np.maximum.reduceat(self.impact, np.append(0, last[:-1] + 1)) if len(last) else self.impact
        self.block_at = np.searchsorted(last, self.list_at)

    def search(self, terms: np.ndarray, found: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
        """The best (-score, doc_id) of found and of this shard."""
        at = np.searchsorted(self.list_terms, terms)
        lists = at[np.append(self.list_terms, -1)[at] == terms]
        if not len(lists):
            return found
        parts = [slice(self.block_at[x], self.block_at[x + 1]) for x in lists.tolist()]
        border = np.unique(np.concatenate([self.block_last[p] for p in parts]))
        # bounds[i, j]: of list i for the documents behind border j - 1, up to border j
        bounds = np.zeros((len(lists), len(border)), np.int64)
        for i, p in enumerate(parts):
            k = np.searchsorted(border, self.block_last[p][-1], "right")
            bounds[i, :k] = self.block_max[p][np.searchsorted(self.block_last[p], border[:k])]
        total = bounds.sum(0)
        begin = np.append(0, border[:-1] + 1)
        left = np.argsort(-total, kind="stable")
        many = FIRST_STRETCHES
        while len(left):
            least = -found[-1][0] if len(found) >= top else 1
            left = left[total[left] >= least]
            some, left = left[:many], left[many:]
            many = NEXT_STRETCHES
            if len(some):
                some = np.sort(some)
                found = sorted(found + self.pivots(lists, bounds[:, some], begin[some], border[some], least))[:top]
        return found

    def may_be_pivots(self, lists, bounds, begin, end, least) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some stretches, and their stretches, that a list holds which cannot be left out."""
        # the smallest bounds of a stretch that stay below least together make no pivot
        order = np.argsort(bounds, 0, kind="stable")
        below = np.cumsum(np.take_along_axis(bounds, order, 0), 0) < least
        spare = np.zeros(bounds.shape, bool)
        np.put_along_axis(spare, order, below, 0)
        docs, stretch = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(~spare.all(1)).tolist():
            held = self.doc[self.list_at[lists[i]] : self.list_at[lists[i] + 1]]
            own = np.flatnonzero(~spare[i])
            lo, hi = np.searchsorted(held, begin[own]), np.searchsorted(held, end[own], "right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            docs.append(held[at])
            stretch.append(np.repeat(own, n))
        found, at = np.unique(np.concatenate(docs), return_index=True)
        return found, np.concatenate(stretch)[at]

    def pivots(self, lists, bounds, begin, end, least) -> list[tuple[int, int]]:
        """(-score, doc_id) of the documents of some stretches whose lists' bounds reach least, and whose score does."""
        docs, stretch = self.may_be_pivots(lists, bounds, begin, end, least)
        reach, score = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for i, x in enumerate(lists.tolist()):
            lo, hi = self.list_at[x], self.list_at[x + 1]
            at = np.minimum(np.searchsorted(self.doc[lo:hi], docs), hi - lo - 1) + lo
            here = self.doc[at] == docs
            reach += np.where(here, bounds[i, stretch], 0)
            score += np.where(here, self.impact[at], 0)
        best = np.flatnonzero((reach >= least) & (score >= least))
        return list(zip((-score[best]).tolist(), self.ids[docs[best]].tolist()))


def shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int, most: int) -> Iterator[Shard]:
    """The postings of a task as shards of about `most` postings."""

    def build(parts) -> Shard:
        ids, n, size, term, count = (np.concatenate(x) for x in zip(*parts))
        doc = np.repeat(np.arange(len(ids)), size)
        m = 10 + 90 * n * n_docs // n_terms
        impact = weights[term] * (1_000_000_000 * count // (1000 * count + 8 * m[doc]))
        keep = impact > 0
        return Shard(ids, doc[keep], term[keep], impact[keep])

    parts, held = [], 0
    for batch in batches:
        terms, counts = batch.column("terms"), batch.column("counts")
        offsets = terms.offsets.to_numpy()
        flat = [x.values.to_numpy().astype(np.int64) for x in (terms, counts)]
        ids, n = (batch.column(c).to_numpy() for c in ("doc_id", "n"))
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most - held, "right")) - 1)
            hi = min(hi, len(ids))
            parts.append((ids[lo:hi], n[lo:hi], np.diff(offsets[lo : hi + 1]), *(x[offsets[lo] : offsets[hi]] for x in flat)))
            held += int(offsets[hi] - offsets[lo])
            lo = hi
            if held >= most:
                yield build(parts)
                parts, held = [], 0
    if parts:
        yield build(parts)


def search_group(docs: DataFrame, items: Items, top: int, most: int) -> DataFrame:
    """item_id, doc_id, score: the best documents of each task."""
    spark = docs.sparkSession
    index = materialize(postings(docs, items), "postings")
    n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
    held = index.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # at most a row for each term
    holding = np.zeros(len(items), np.int64)
    holding[held.column("t").to_numpy()] = held.column("count").to_numpy()
    weights = np.array([weight(n_docs, x) for x in holding.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((items.ids, items.terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, weights = shared.value
        found: list[list[tuple[int, int]]] = [[] for _ in ids]
        for shard in shards(batches, weights, n_docs, n_terms, most):
            for i, own in enumerate(terms):
                found[i] = shard.search(own, found[i], top)
        rows = [(item, doc, -score) for item, own in zip(ids, found) for score, doc in own]
        cols = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "item_id", shard_postings: int = SHARD_POSTINGS
) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0, highest first."""
    groups = [search_group(docs, group, top, shard_postings) for group in item_groups(items, id_col)]
    none = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    found = reduce(DataFrame.unionByName, groups) if groups else none
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
all_docs AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM len),
w AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM tf, all_docs GROUP BY term, n_docs),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN len USING (doc_id), all_docs GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from features of it and its neighbours and from the labels next to it. Forward and
backward passes give each line's marginal probability; the mean of the marginals of a document's lines, weighted by
their lengths and calibrated, is its quality. The field is trained by maximum likelihood on a bounded sample of labelled
documents, whole ones, whose lines all take the document's label. A fifth of the sample is kept out of that and serves
to calibrate. Only the text is a feature.

Features are counted for all lines of a block of texts at once; chains of a block run side by side.

Defined cases: null or empty text is one empty line and has a score like any other; rows that repeat a doc_id are
scored one by one; rows with a null doc_id are scored, with held_out null; of contradicting labels of a doc_id the
commoner counts, 1 in a tie, null labels do not; without training labels of both kinds every score is 0.5; an empty
table gives an empty result; only id, text and the label are read, so other columns may have any name; texts of any
length are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, hash_spans, id_text, mix, rolling, word_spans

#: Labelled documents of the sample at most, lines of all of them together at most, and passes over them.
SAMPLE_DOCS, SAMPLE_LINES, STEPS = 4000, 100_000, 150
#: Of the sampled documents every so manieth only calibrates.
CALIBRATE_EVERY = 5
FOLDS, THRESHOLD = 5, 0.3
L2 = 1e-3

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _HIGH, _STOP = range(7)
_TABLES = np.zeros((7, 256), np.int32)
_TABLES[_UPPER, 65:91] = 1
_TABLES[_LOWER, 97:123] = 1
_TABLES[_DIGIT, 48:58] = 1
_TABLES[_SYMBOL, list(b"#*$%&|<>")] = 1
_TABLES[_BANG, ord("!")] = 1
_TABLES[_HIGH, 128:] = 1
_TABLES[_STOP, list(b".,;:?")] = 1
N_OWN = 12
#: Own features of a line, the line before, the line behind, whether there are such, and a constant.
N_FEATURES = 3 * N_OWN + 3


def lines_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and documents of the \\n-split lines of a block, in order."""
    feeds = np.flatnonzero(block.data == 10)
    n = len(block)
    feed_doc = np.searchsorted(block.offsets, feeds, "right") - 1
    doc = np.concatenate([np.arange(n), feed_doc])
    starts = np.concatenate([block.offsets[:-1], feeds + 1])
    ends = np.concatenate([block.offsets[1:], feeds])
    return starts[np.lexsort((starts, doc))], ends[np.lexsort((ends, doc))], np.sort(doc, kind="stable")


def line_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """documents, features (lines, N_FEATURES) and lengths in bytes of the lines of a block."""
    starts, ends, doc = lines_of(block)
    n = len(starts)

    def within(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[block.data], dtype=np.int64)])
        return (total[ends] - total[starts]).astype(float)

    upper, lower, digits, symbols, bangs, high, stops = (within(t) for t in _TABLES)
    w_start, w_end, w_doc = word_spans(block)
    line = np.searchsorted(starts, w_start, "right") - 1
    # starts of empty lines coincide with nothing that has words, but equal starts must name the last line
    words = np.bincount(line, minlength=n).astype(float)
    letters_in = np.bincount(line, (w_end - w_start).astype(float), minlength=n)
    hashes = hash_spans(block.data, w_start, w_end)
    echo, looped, fresh = np.zeros(n), np.zeros(n), np.zeros(len(block))
    if len(hashes):
        same = np.zeros(len(hashes))
        same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        echo = np.bincount(line, same, minlength=n)
        own = mix(hashes + w_doc.astype(np.uint64))
        fresh = np.bincount(w_doc[np.unique(own, return_index=True)[1]], minlength=len(block)).astype(float)
        tri = rolling(hashes, 3)
        if len(tri):
            inside = w_doc[2:] == w_doc[:-2]
            keyed = mix(tri[inside] + w_doc[:-2][inside].astype(np.uint64))
            _, back, counts = np.unique(keyed, return_inverse=True, return_counts=True)
            looped = np.bincount(line[:-2][inside], (counts[back] > 1).astype(float), minlength=n)
    doc_words = np.bincount(w_doc, minlength=len(block)).astype(float)
    whole = mix(hash_spans(block.data, starts, ends) + doc.astype(np.uint64))
    _, first = np.unique(whole, return_index=True)
    seen = np.ones(n)
    seen[first] = 0
    seen[words == 0] = 0
    size = (ends - starts).astype(float)
    per_word = 1 / np.maximum(words, 1)
    letters = np.maximum(upper + lower + high, 1)
    variety = np.log1p(fresh) / np.maximum(np.log1p(doc_words), 1e-9)
    x = np.stack(
        [
            np.log1p(words) / 5,
            upper / letters,
            digits / np.maximum(size, 1),
            np.minimum(symbols * per_word, 3) / 3,
            np.minimum(bangs * per_word, 2) / 2,
            np.minimum(letters_in * per_word, 20) / 10,
            echo * per_word,
            looped * per_word,
            seen,
            high / np.maximum(size, 1),
            np.minimum(stops * per_word, 1),
            np.where(doc_words[doc] > 0, variety[doc], 1.0),
        ],
        1,
    )
    before, behind = np.zeros((n, 1)), np.zeros((n, 1))
    before[1:, 0] = doc[1:] == doc[:-1]
    behind[:-1, 0] = before[1:, 0]
    prev, following = np.roll(x, 1, 0) * before, np.roll(x, -1, 0) * behind
    return doc, np.concatenate([x, prev, following, before, behind, np.ones((n, 1))], 1), size


@dataclass
class Field:
    """weights of label 1's score of a line; transitions between the labels (rows: from); scores of first labels.

    scale calibrates a document's mean marginal: slope and intercept of its log odds.
    """

    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)


def chains(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """documents by falling length, their first lines, and their lengths; doc is sorted."""
    ids, starts, lengths = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(-lengths, kind="stable")
    return ids[order], starts[order], lengths[order]


def marginals(field: Field, doc: np.ndarray, x: np.ndarray, pairs: bool = False):
    """Probability of label 1 of each line; with pairs also summed pair probabilities and log normalisers."""
    score = np.clip(x @ field.weights, -30, 30)
    e = np.stack([np.ones_like(score), np.exp(score)], 1)
    a = np.exp(field.transitions)
    _, starts, lengths = chains(doc)
    n_live = np.searchsorted(-lengths, -np.arange(1, lengths.max() + 1), "right") if len(lengths) else []
    alpha, beta, norm = np.empty_like(e), np.ones_like(e), np.empty(len(e))
    now = None
    for t, k in enumerate(n_live):
        at = starts[:k] + t
        now = (np.exp(field.first) if t == 0 else now[:k] @ a) * e[at]
        total = now.sum(1)
        now = now / total[:, None]
        alpha[at], norm[at] = now, total
    for t in range(len(n_live) - 2, -1, -1):
        at = starts[: n_live[t + 1]] + t
        back = (e[at + 1] * beta[at + 1]) @ a.T
        beta[at] = back / norm[at + 1][:, None]
    both = alpha * beta
    p = both[:, 1] / both.sum(1)
    if not pairs:
        return p
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    joint = alpha[inner][:, :, None] * a * (e[inner + 1] * beta[inner + 1])[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return p, joint.sum(0), np.log(norm).sum(), both[starts] / both[starts].sum(1, keepdims=True)


def train(doc: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum likelihood with Adam; doc is sorted, y is each line's label."""
    f = Field(np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros(2))
    params = [f.weights, f.transitions, f.first]
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
    _, starts, _ = chains(doc)
    seen_first = np.array([(y[starts] == 0).sum(), (y[starts] == 1).sum()], float)
    n = len(y)
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        p, joint, _, head = marginals(f, doc, x, True)
        grads = [x.T @ (p - y) / n, (joint - seen_pairs) / n, (head.sum(0) - seen_first) / n]
        for q, g, a, b in zip(params, grads, m, v):
            g = g + L2 * q
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return f


def mean_log_odds(field: Field, doc: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean marginal of each document 0..n-1 that doc names."""
    weight = size + 1e-6  # empty lines count where there is nothing else
    p = np.bincount(doc, marginals(field, doc, x) * weight) / np.bincount(doc, weight)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on log odds, by Newton steps with a little shrinkage towards (1, 0)."""
    u, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        gradient = u.T @ (p - y) + (w - [1.0, 0.0])
        w = w - np.linalg.solve((u * (p * (1 - p) + 1e-9)[:, None]).T @ u + np.eye(2), gradient)
    return max(float(w[0]), 0.05), float(w[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def training_sample(
    rows: DataFrame, labels: DataFrame, label: str, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES
) -> DataFrame:
    """doc_id, y of the sampled documents: the labelled ones of the smallest id hashes outside the held-out fold, as long
    as their lines together stay within the bound."""
    truth = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_docs)
    )
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sizes = rows.join(F.broadcast(truth), "doc_id").groupBy("doc_id", "y").agg(F.sum(n_lines).alias("n"))
    picked, held = [], 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # one short row for each sampled document
        if held + r.n <= sample_lines:
            picked.append((r.doc_id, r.y))
            held += r.n
    return rows.sparkSession.createDataFrame(picked, "doc_id long, y double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Field | None:
    """A field trained on labelled documents outside the held-out fold; None where one label is missing."""
    texts = id_text(docs)
    rows = texts.join(F.broadcast(training_sample(texts, labels, label)), "doc_id")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, ids = batch.column("y").to_numpy(), batch.column("doc_id").to_numpy()
            for block in blocks(batch.column("text")):
                doc, x, length = line_features(block)
                start = np.unique(doc, return_index=True)[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[block.lo + doc]), pa.array(np.arange(len(doc)) - start[doc]), pa.array(y[block.lo + doc]),
                        pa.array(length),
                        pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), N_FEATURES).cast(pa.list_(pa.float32())),
                    ],
                    ["doc_id", "place", "y", "size", "x"],
                )

    found = rows.mapInArrow(look, "doc_id long, place long, y double, size double, x array<float>").toArrow()
    ids, place, y, size = (found.column(c).to_numpy() for c in ("doc_id", "place", "y", "size"))
    if not len(y) or y.min() == y.max():
        return None
    x = found.column("x").combine_chunks().values.to_numpy().astype(float).reshape(len(y), N_FEATURES)
    order = np.lexsort((place, ids))
    ids, x, y, size = ids[order], x[order], y[order], size[order]
    # every CALIBRATE_EVERY-th document of either label, in the order of id hashes, only calibrates
    last = np.zeros(len(y), bool)
    for label in (0.0, 1.0):
        own = sorted(np.unique(ids[y == label]).tolist(), key=lambda i: (zlib.crc32(str(i).encode()), i))
        if len(own) < 2:
            return None
        last |= np.isin(ids, own[::CALIBRATE_EVERY]) & (y == label)
    fitted = ~last
    field = train(np.unique(ids[fitted], return_inverse=True)[1], x[fitted], y[fitted])
    _, first, doc = np.unique(ids[last], return_index=True, return_inverse=True)
    field.scale = calibrate(mean_log_odds(field, doc, x[last], size[last]), y[last][first])
    return field


def quality(field: Field | None, block: Block) -> np.ndarray:
    """The score of each document of a block."""
    if field is None:
        return np.full(len(block), 0.5)
    doc, x, size = line_features(block)
    slope, intercept = field.scale
    return 1 / (1 + np.exp(-(slope * mean_log_odds(field, doc, x, size) + intercept)))


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [quality(shared.value, block) for block in blocks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"]
            )

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )

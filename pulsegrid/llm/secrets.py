"""Secret scans: base patterns, and a character convolutional network over every candidate and its context.

Base findings come from three fixed patterns. The network looks at every candidate, a run of token characters that may
be a key, with the characters around it, and adds spans that its calibrated score puts above the threshold. It is
trained on the labelled findings of all documents: the values of base matches are positive, also under other key names
and quoting and with values of other alphabets; candidates that touch no base match are negative, as are values whose
letters spell words. Documents are dealt to three parts: one trains, one calibrates, one sets the threshold, which is
the highest that still finds RECALL of that part's positives; findings that are no candidate count as missed.

Training goes in rounds. Windows are dealt to shards by their hashes, each task goes on from the same network over a
shard of its own, and the mean of what the shards came to begins the next round. Calibration and threshold use counts of
all windows by their logits, in steps of 1 / GRID. The driver gets sums and counts, never a window.

Candidates are found with NumPy on the bytes of a block of texts; patterns run only where their words or bytes occur.
All of a candidate is read, in overlapping stretches of which the best score counts.

Defined cases: null or empty text has no spans; spans are code points, end exclusive; overlapping base matches of
different kinds all count; an added span never overlaps a base one; rows are scanned one by one, so repeated rows and
rows with a null doc_id give results of their own (those without an id are not trained on); where one of the three parts
has no positive or no negative nothing is added; where so many findings are no candidates that RECALL cannot be had, all
candidates that score as the lowest positive does are taken, with a warning; an empty table gives an empty result; only id and text are read, so other
columns may have any name; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, Block, Scratch, blocks, id_text, spans

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
OTHER_NAMES = ("pwd", "auth", "credential", "access_key", "private_key", "client_id", "bearer", "signature")

ALPHABETS = (
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
)

#: Candidates are at least this long, and from this length on whatever they consist of.
LEAST_CANDIDATE, ANY_CANDIDATE = 8, 24
#: Recall to keep.
RECALL = 0.99
#: Characters seen before a stretch of a candidate, of it, and behind it.
BEFORE, INSIDE, BEHIND = 24, 40, 8
#: Bytes from one stretch of a longer candidate to the next.
STEP = 20
WIDTH, FILTERS, HIDDEN = 5, 16, 16
#: Rounds of training, passes of each one over all windows, and about how many of these a shard has.
ROUNDS, EPOCHS, SHARD = 4, 3, 4096
#: Steps of a logit in which windows are counted, and the logit at which counting ends on either side.
GRID, FAR = 256, 64

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_DIGIT, _UPPER, _LETTER_LOWER = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58], _UPPER[65:91], _LETTER_LOWER[97:123] = True, True, True

#: Classes of characters that the network tells apart.
_CLASS = np.full(256, 9)
for _chars, _k in (("0123456789", 1), ("abcdef", 2), ("ghijklmnopqrstuvwxyz", 3), ("ABCDEF", 4),
                   ("GHIJKLMNOPQRSTUVWXYZ", 5), ("=:", 6), ("\"'`", 7), ("+/_-.", 8), (" \n\t", 10), ("()[]{}<>", 11)):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASSES = 12


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base findings, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in KEY_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda x: (x[0], x[2]))


def long_runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int):
    """starts, ends, documents of the runs of at least `least` bytes of a table."""
    starts, ends, doc = spans(table[data], offsets)
    keep = ends - starts >= least
    return starts[keep], ends[keep], doc[keep]


def candidates(data: np.ndarray, offsets: np.ndarray):
    """starts, ends, documents (bytes) of runs that may be keys: with digits, with a capital behind a small letter, or
    very long."""
    starts, ends, doc = long_runs(data, offsets, _TOKEN, LEAST_CANDIDATE)
    if not len(starts):
        return starts, ends, doc
    mark = _DIGIT[data]
    mark[1:] |= _UPPER[data[1:]] & _LETTER_LOWER[data[:-1]]
    marks = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    # a mark on the first character tells of the character before the run
    keep = (marks[ends] > marks[starts + 1]) | _DIGIT[data[starts]] | (ends - starts >= ANY_CANDIDATE)
    return starts[keep], ends[keep], doc[keep]


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Character classes (n, BEFORE + INSIDE + BEHIND) of candidates and context; 0 outside the text lo..hi."""
    n, size = len(starts), len(data)
    head = np.arange(-BEFORE, INSIDE)
    at = starts[:, None] + head
    ok = (at >= lo[:, None]) & (at < ends[:, None])
    tail_at = ends[:, None] + np.arange(BEHIND)
    tail_ok = tail_at < hi[:, None]
    at, ok = np.concatenate([at, tail_at], 1), np.concatenate([ok, tail_ok], 1)
    out = np.zeros((n, BEFORE + INSIDE + BEHIND), np.int64)
    if size:
        out = np.where(ok, _CLASS[data[np.clip(at, 0, size - 1)]], 0)
    return out


def stretches(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends of overlapping stretches of at most INSIDE bytes that cover every candidate, and whose each one is."""
    n = 1 + np.maximum(0, -(-(ends - starts - INSIDE) // STEP))
    own = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    # the last one ends with its candidate
    at = np.maximum(starts[own], np.minimum(starts[own] + k * STEP, ends[own] - INSIDE))
    return at, np.minimum(at + INSIDE, ends[own]), own


def best_scores(net: Network, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The best score of the stretches of each candidate."""
    at, to, own = stretches(starts, ends)
    best = np.zeros(len(starts))
    for a in range(0, len(at), 20_000):
        k = own[a : a + 20_000]
        np.maximum.at(best, k, net.scores(windows(data, at[a : a + 20_000], to[a : a + 20_000], lo[k], hi[k])))
    return best


@dataclass
class Network:
    """One convolution over classes, maximum and mean over positions, one hidden layer, a calibrated logit."""

    kernel: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    scale: np.ndarray  # slope, intercept
    threshold: float = 1.0
    #: Shares of the threshold's part: positives found, and of what is found what is positive.
    recall: float = 0.0
    precision: float = 0.0
    #: Windows of each part.
    learned: tuple[int, ...] = (0, 0, 0)

    def forward(self, x: np.ndarray):
        eye = np.eye(_CLASSES)
        cols = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)  # n, positions, WIDTH
        hot = eye[cols].reshape(*cols.shape[:2], WIDTH * _CLASSES)
        conv = np.maximum(hot @ self.kernel + self.bias, 0)
        top = conv.argmax(1)
        pooled = np.concatenate([conv.max(1), conv.mean(1)], 1)
        hid = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return hot, conv, top, pooled, hid, hid @ self.out[:-1] + self.out[-1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[lo : lo + 2000])[-1] for lo in range(0, len(x), 2000)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return self.calibrated(self.logits(x))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))


PARTS = TRAIN, CALIBRATE, THRESHOLD = 0, 1, 2


def part_of(doc_id: int) -> int:
    """The part of the sample that a document is dealt to: six tenths train, two calibrate, two set the threshold."""
    fold = zlib.crc32(str(doc_id).encode()) % 10
    return CALIBRATE if fold < 2 else THRESHOLD if fold < 4 else TRAIN


SHAPES = ((WIDTH * _CLASSES, FILTERS), (FILTERS,), (2 * FILTERS, HIDDEN), (HIDDEN,), (HIDDEN + 1,))
SIZE = sum(int(np.prod(s)) for s in SHAPES)


def start(seed: int) -> np.ndarray:
    """The state that training begins with: weights, and Adam's two moments of each, one behind the other."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.2, s) if k % 2 == 0 else np.zeros(s) for k, s in enumerate(SHAPES)]
    return np.concatenate([*(w.ravel() for w in weights), np.zeros(2 * SIZE)])


def unpacked(flat: np.ndarray) -> list[np.ndarray]:
    """Views of a vector in the shapes of the weights."""
    cuts = np.cumsum([int(np.prod(s)) for s in SHAPES])[:-1]
    return [part.reshape(s) for part, s in zip(np.split(flat, cuts), SHAPES)]


def network(state: np.ndarray) -> Network:
    return Network(*unpacked(state[:SIZE]), np.array([1.0, 0.0]))


def learn(state: np.ndarray, x: np.ndarray, y: np.ndarray, turn: int, rng: np.random.Generator) -> np.ndarray:
    """The state after one round over some windows: Adam on the logistic loss, from the given state on."""
    state = state.copy()
    net, params, m, v = network(state), *(unpacked(state[k * SIZE : (k + 1) * SIZE]) for k in range(3))
    rest = np.arange(len(x))
    step = turn * EPOCHS * -(-len(rest) // 128)
    for _ in range(EPOCHS):
        rng.shuffle(rest)
        for lo in range(0, len(rest), 128):
            k = rest[lo : lo + 128]
            hot, conv, top, pooled, hid, z = net.forward(x[k])
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k]) / len(k)
            g_out = np.concatenate([hid.T @ dz, [dz.sum()]])
            dh = np.outer(dz, net.out[:-1]) * (hid > 0)
            dp = dh @ net.hidden.T
            dconv = np.repeat(dp[:, None, FILTERS:] / conv.shape[1], conv.shape[1], 1)
            rows, cols = np.indices(top.shape)
            dconv[rows, top, cols] += dp[:, :FILTERS]
            dconv *= conv > 0
            grads = [np.tensordot(hot, dconv, ([0, 1], [0, 1])), dconv.sum((0, 1)), pooled.T @ dh, dh.sum(0), g_out]
            step += 1
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return state


def steps_of(z: np.ndarray) -> np.ndarray:
    """The step of 1 / GRID that a logit lies in, those beyond FAR in the outermost ones."""
    return np.clip(np.floor(z * GRID), -FAR * GRID, FAR * GRID).astype(np.int64)


def settle(net: Network, part: np.ndarray, y: np.ndarray, step: np.ndarray, n: np.ndarray, missed: int) -> None:
    """Calibrates a network and sets its threshold, given the counts n of windows by part, label and step of the logit;
    missed: positives of the threshold's part that are no candidates."""
    own = part == CALIBRATE
    z, t, w = (step[own] + 0.5) / GRID, y[own], n[own] / n[own].sum()
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling, with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a -= 0.05 * (((p - t) * z * w).sum() + 0.001 * a)
        b -= 0.05 * ((p - t) * w).sum()
    net.scale = np.array([max(a, 0.05), b])
    own = part == THRESHOLD
    step, t, n = step[own], y[own], n[own]
    good, held = (x[t == 1][np.argsort(step[t == 1], kind="stable")] for x in (step, n))
    n_good = int(held.sum())
    # the highest threshold that keeps RECALL of the positives; what was missed already is part of what may be missed
    spare = int((1 - RECALL) * (n_good + missed)) - missed
    if spare < 0:
        warnings.warn(f"{missed} of {n_good + missed} findings are no candidates: a recall of {RECALL} is out of reach", stacklevel=2)
    least = int(good[np.searchsorted(np.cumsum(held), max(0, min(spare, n_good - 1)), "right")])
    # all of a step counts, also where a logit on its edge is rounded; the lowest step has no lower edge
    edge = net.calibrated(np.array([least / GRID]))[0] * (1 - 1e-12)
    net.threshold = float(edge) if least > -FAR * GRID else 0.0
    found = step >= least
    net.recall = float((n * t)[found].sum() / max(1, n_good + missed))
    net.precision = float((n * t)[found].sum() / max(1, n[found].sum()))


def train(x: np.ndarray, y: np.ndarray, part: np.ndarray, missed: int = 0, seed: int = 7) -> Network:
    """What `fit` does, over arrays in one process and as one shard."""
    state = start(seed)
    for turn in range(ROUNDS):
        state = learn(state, x[part == TRAIN], y[part == TRAIN], turn, np.random.default_rng([seed, turn, 0]))
    net = network(state)
    settle(net, part, y, steps_of(net.logits(x)), np.ones(len(x), np.int64), missed)
    net.learned = tuple(int((part == p).sum()) for p in PARTS)
    return net


def code_point_bytes(data: np.ndarray) -> np.ndarray:
    """The byte at which each code point begins, and the number of bytes."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


class Touching:
    """Tells which spans touch one of some others, in steps that grow with their logarithm."""

    def __init__(self, others: np.ndarray):
        """others: rows of start, end."""
        others = others[np.argsort(others[:, 0], kind="stable")]
        self.starts, self.far = others[:, 0], np.append(-1, np.maximum.accumulate(others[:, 1]))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        # of the others that begin before the end, the one that reaches farthest
        return self.far[np.searchsorted(self.starts, ends)] > starts


def labelled(text: str, rng: np.random.Generator) -> list[tuple[float, bytes | None]]:
    """Labels and windows of the candidates of a text, with positives under other names and in plain context; a positive
    that is no candidate has no window. Takes time in proportion to the text and to its findings."""
    out: list[tuple[float, bytes | None]] = []

    def add(text: str, want: list[tuple[int, int]]) -> None:
        """want: code point spans of positives; all other candidates are negative."""
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = candidates(data, np.array([0, len(data)]))
        edge = code_point_bytes(data)[np.array(want, np.int64).reshape(-1, 2)]
        met = Touching(np.stack([starts, ends], 1)).of(edge[:, 0], edge[:, 1])
        out.extend([(1.0, None)] * int((~met & (edge[:, 1] - edge[:, 0] >= LEAST_CANDIDATE)).sum()))
        if not len(starts):
            return
        starts, ends, _ = stretches(starts, ends)
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(data))
        seen = windows(data, starts, ends, lo, hi).astype(np.uint8)
        out.extend(zip(Touching(edge).of(starts, ends).astype(float).tolist(), (w.tobytes() for w in seen)))

    found = base_spans(text)
    add(text, [(a, b) for a, b, _ in found])
    words = [m[0] for m in islice(re.finditer(r"[a-z]{3,}", text), 6)] or ["plain"]
    for a, b, kind in found:
        value = ASSIGN.match(text, a, b)[2] if kind == 0 else text[a:b]
        letters = ALPHABETS[rng.integers(len(ALPHABETS))]
        drawn = "".join(letters[j] for j in rng.integers(len(letters), size=max(16, len(value))))
        for shown_value in (value, drawn):  # as found, and of other letters
            name = OTHER_NAMES[rng.integers(len(OTHER_NAMES))]
            sign = (" = ", ": ", "=", ' = "')[rng.integers(4)]
            head = text[max(0, a - 60) : a] + name + sign
            add(head + shown_value + text[b : b + 20], [(len(head), len(head) + len(shown_value))])
        # the same place with words in the value's stead
        add(text[max(0, a - 60) : a] + "-".join(words) + "-2024" + text[b : b + 20], [])
        add(text[max(0, a - 60) : a] + "".join(w.capitalize() for w in words[:3]) + text[b : b + 20], [])
    return out


def seen_windows(x) -> np.ndarray:
    """The windows of an Arrow column of binaries."""
    return np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, BEFORE + INSIDE + BEHIND).astype(np.int64)


def fit(docs: DataFrame, seed: int = 7) -> Network | None:
    """A network trained on the candidates of all documents; None where a part of them lacks a label.

    Shards are dealt by hashes and sorted, and their means are of exact sums, so the network does not depend on how the
    table lies in files. The driver gets the sums of the state's values, and counts of logits by steps.
    """
    rows = id_text(docs).where("doc_id IS NOT NULL")
    names = ["doc_id", "k", "part", "y", "x"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                some = may_have_base(block).union(candidates(block.data, block.offsets)[2].tolist())
                for d in sorted(some):
                    text = block.data[block.offsets[d] : block.offsets[d + 1]].tobytes().decode("utf-8", "replace")
                    doc_id = ids[block.lo + d].as_py()
                    found = labelled(text, np.random.default_rng([seed, zlib.crc32(text.encode())]))
                    for lo in range(0, len(found), 5000):
                        few = found[lo : lo + 5000]
                        cols = [
                            pa.array([doc_id] * len(few), pa.int64()), pa.array(range(lo, lo + len(few)), pa.int64()),
                            pa.array([part_of(doc_id)] * len(few), pa.int32()),
                            pa.array([y for y, _ in few], pa.float64()), pa.array([w for _, w in few], pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays(cols, names)

    scratch = Scratch(docs.sparkSession)
    seen = scratch.table(rows.mapInArrow(look, "doc_id long, k long, part int, y double, x binary"), "candidates")
    here = F.col("x").isNotNull()
    counts = {(r.part, r.y, r.here): r["count"] for r in seen.groupBy("part", "y", here.alias("here")).count().collect()}
    if any((p, label, True) not in counts for p in PARTS for label in (0, 1)):
        scratch.drop()
        return None
    learned = tuple(counts[p, 0, True] + counts[p, 1, True] for p in PARTS)
    shards = max(1, round(learned[TRAIN] / SHARD))
    h = F.xxhash64("doc_id", "k", "x")
    own = seen.where(here & (F.col("part") == TRAIN)).select(*names, h.alias("h"), F.pmod(h, F.lit(shards)).alias("shard"))
    own = own.repartition(shards, "shard")

    def rounds(state: np.ndarray, turn: int):
        def one(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("h", "doc_id", "k", "x", "y")]))
            rng = np.random.default_rng([seed, turn, key[0].as_py()])
            new = learn(state, seen_windows(rows.column("x")), rows.column("y").to_numpy(), turn, rng)
            return pa.table({"j": pa.array(range(len(new)), pa.int32()), "v": new})

        return one

    state = start(seed)
    for turn in range(ROUNDS):
        after = own.groupBy("shard").applyInArrow(rounds(state, turn), "j int, v double")
        # decimals add up to the same in any order
        sums = after.groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,18)")).cast("double").alias("v"), F.count("*").alias("n"))
        for r in sums.collect():
            state[r.j] = r.v / r.n
    net = network(state)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = pa.array(steps_of(net.logits(seen_windows(batch.column("x")))))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("y"), step], ["part", "y", "step"])

    marked = seen.where(here & (F.col("part") != TRAIN)).mapInArrow(mark, "part int, y double, step long")
    got = marked.groupBy("part", "y", "step").count().toArrow().sort_by([(c, "ascending") for c in ("part", "y", "step")])
    scratch.drop()
    settle(net, *(got.column(c).to_numpy() for c in ("part", "y", "step", "count")), counts.get((THRESHOLD, 1, False), 0))
    net.learned = learned
    return net


def may_have_base(block: Block) -> set[int]:
    """Documents of a block with bytes that a base finding has: runs of hex digits, key words, access key marks."""
    offsets = block.offsets
    found = set(long_runs(block.data, offsets, _HEX, LEAST["hex"])[2].tolist())
    low = block.data.tobytes().lower()  # ASCII letters only
    for word in (*(w.encode() for w in KEY_WORDS), b"akia"):
        at = low.find(word)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            found.add(d)
            at = low.find(word, int(offsets[d + 1]))
    return found


def scan_texts(col, net: Network | None) -> Iterator[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of all spans of each text of an Arrow column, by start, then kind as listed."""
    for block in blocks(col, BLOCK_BYTES):
        data, offsets = block.data, block.offsets
        raw = data.tobytes()
        base: list[list[tuple[int, int, str, float]]] = [[] for _ in range(len(block))]
        look = may_have_base(block)
        starts, ends, doc = candidates(data, offsets)
        picked = np.zeros(0)
        if net is not None and len(starts):
            picked = best_scores(net, data, starts, ends, offsets[doc], offsets[doc + 1])
            keep = picked >= net.threshold
            starts, ends, doc, picked = starts[keep], ends[keep], doc[keep], picked[keep]
            look.update(doc.tolist())
        else:
            starts = ends = doc = np.zeros(0, np.int64)
        cuts = np.searchsorted(doc, np.arange(len(block) + 1))
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points before each byte
        for d in sorted(look):
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            text = raw[lo:hi].decode("utf-8", "replace")
            found = [(a, b, KINDS[k], 1.0) for a, b, k in base_spans(text)]
            some = slice(cuts[d], cuts[d + 1])
            a, b = points[starts[some]] - points[lo], points[ends[some]] - points[lo]
            free = ~Touching(np.array([x[:2] for x in found], np.int64).reshape(-1, 2)).of(a, b)
            found += [(x, y, "model", z) for x, y, z in zip(a[free].tolist(), b[free].tolist(), picked[some][free].tolist())]
            order = {k: i for i, k in enumerate((*KINDS, "model"))}
            base[d] = sorted(found, key=lambda s: (s[0], order[s[2]]))
        yield from base


def joined(found: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in found)


def scan(docs: DataFrame, net: Network | None = None, fitted: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_model of each row."""
    rows = id_text(docs)
    net = net if fitted else fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()),
              ("spans", pa.string()), ("n_model", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            cols[0] = batch.column("doc_id")
            for found in scan_texts(batch.column("text"), shared.value):
                own = [s for s in found if s[2] != "model"]
                for k, kind in enumerate(KINDS):
                    cols[1 + k].append(sum(s[2] == kind for s in own))
                cols[4].append(hashlib.sha256(joined(own).encode()).hexdigest())
                cols[5].append(joined(found))
                cols[6].append(len(found) - len(own))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    return rows.mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"
    )


MASK = "[secret]"


def mask(text: str, found: list[tuple[int, int, str, float]]) -> str:
    """The text with each span, overlapping ones together, replaced by the mask."""
    out, at, last = [], 0, -1
    for a, b, _, _ in sorted(found):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with every span of text masked (and n_chars following it, where there is such a column)."""
    net = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    follow = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            changed = {}
            for i, found in enumerate(scan_texts(batch.column("text"), shared.value)):
                if found:
                    texts[i] = mask(texts[i], found)
                    changed[i] = len(texts[i])
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            if follow and changed:
                at = batch.schema.get_field_index("n_chars")
                kind = batch.schema.field(at).type
                sizes = batch.column(at).to_pylist()
                for i, n in changed.items():
                    sizes[i] = n
                batch = batch.set_column(at, "n_chars", pa.array(sizes, kind))
            yield batch

    texted = docs.withColumn("text", F.col("text").cast("string"))
    return texted.mapInArrow(run, texted.schema)

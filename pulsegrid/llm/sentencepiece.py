"""SentencePiece encoding and decoding: one pass over a text, driven by an Aho-Corasick automaton of the pieces.

At each position the automaton's output links name the pieces that end there, and each one relaxes the best score of
its end (Viterbi); of equally good ones the longest wins; a character that is no piece may be passed at the unknown
score, as its bytes' pieces. This is what a unigram model means by encoding, and what `encode_documents` and the query
give for any model.

Pair-merge models are decoded by their library in another way, which sums of scores do not express. For them there is
a second answer (`merged=True`; further columns of the query), whose ids equal the library's. Short parts are merged
pair by pair, the best-scored first. Long ones, for which that is quadratic, take one pass over the output links: of the
pieces that end at a position the one is taken that stays when it and the piece before it are merged; exactly one
passes, and the pieces found are those that merging the whole part gives.

No piece has the word mark behind another character, so a text falls apart before each run of marks (and around line
feeds where no piece has them), and its parts are segmented one by one, each distinct one once per worker (up to a
bound).

The pieces and scores are those of a public vocabulary file; nothing is trained here.

Defined cases: null or empty text encodes to no ids and decodes to empty; rows are encoded one by one, so repeated
rows give repeated results, and a null doc_id stays null; an empty table gives an empty result; only id and text are
read, so other columns may have any name; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Parts of texts whose ids a worker process remembers, and the characters of one that is remembered.
CACHE_PARTS, SHORT = 600_000, 64
#: The unknown score is this much below the worst piece.
UNKNOWN_BELOW = 10.0

UNIGRAM, PAIR_MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a serialised protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], int]:
    """(piece, score, type) of each id of a model file, and the model's type."""
    found, kind = [], UNIGRAM
    for number, value in _fields(data):
        if number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 1:
            f = dict(_fields(value))
            score = float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0
            found.append((f[1].decode(), score, f.get(3, NORMAL)))
    return found, kind


class Encoder:
    """Segments texts into ids; a worker process has one for each model."""

    def __init__(self, path: str, most: int = CACHE_PARTS):
        import ahocorasick

        with open(path, "rb") as f:
            self.pieces, self.kind = read_model(f.read())
        self.auto = ahocorasick.Automaton()
        for k, (piece, score, kind) in enumerate(self.pieces):
            if kind in (NORMAL, USER):
                self.auto.add_word(piece, (len(piece), score, k))
        self.auto.make_automaton()
        self.scores = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        self.single = {p for p in self.scores if len(p) == 1}
        self.ids = {p: k for k, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        normal = [s for _, s, kind in self.pieces if kind == NORMAL]
        self.unknown = min(normal) - UNKNOWN_BELOW
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown_id = next(k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        # characters that no piece has part a text as well
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.scores))
        self.parts = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.caches: dict[bool, dict[str, bytes]] = {False: {}, True: {}}
        self.both: dict[str, tuple[bytes, bytes]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.most = most

    def segment(self, part: str, merged: bool = False) -> list[int]:
        if merged and len(part) <= SHORT:
            return self._short_merge(part)
        back = self._merges(part) if merged else self._viterbi(part)
        ids: list[int] = []
        end = len(part)
        while end:
            start, k = back[end]
            if k >= 0:
                ids.append(k)
            else:
                ids += [self.byte_ids.get(b, self.unknown_id) for b in reversed(part[start:end].encode())]
            end = start
        return ids[::-1]

    def _short_merge(self, part: str) -> list[int]:
        """Ids once the best-scored pair of neighbours has been merged, the leftmost of equals, until no pair is a piece."""
        parts, score, none = list(part), self.scores.get, float("-inf")
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
        out, known = [], self.ids.get
        for x in parts:
            k = known(x)
            if k is None:
                out += [self.byte_ids.get(b, self.unknown_id) for b in x.encode()]
            else:
                out.append(k)
        return out

    def _merges(self, part: str) -> list[tuple[int, int]]:
        """(start, id) of the piece that ends at each position when the text up to it is merged."""
        n = len(part)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0
        for end, (length, _, k) in self.auto.iter(part):
            end += 1
            while done < end - 1:  # positions at which nothing passed end in a character that is no piece
                done += 1
                if back[done] == (0, -1):
                    back[done] = (done - 1, -1)
            if back[end] == (0, -1):
                start = end - length
                before = part[back[start][0] : start]
                if self._stay(before, part[start:end]):
                    back[end] = (start, k)
        while done < n:
            done += 1
            if back[done] == (0, -1):
                back[done] = (done - 1, -1)
        return back

    def _stay(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b gives a and b again; a may be empty."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self._merge(a + b) == ([a, b] if a else [b])
            if len(self.pairs) > 4 * self.most:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def _merge(self, text: str) -> list[str]:
        """The best-scored pair of neighbours is merged, the leftmost of equals, until no pair is a piece."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            options = [(scores[x], -i) for i, x in enumerate(map(str.__add__, parts, parts[1:])) if x in scores]
            if not options:
                break
            i = -max(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _viterbi(self, part: str) -> list[tuple[int, int]]:
        """(start, id) of the last piece of the best-scored segmentation up to each position."""
        n = len(part)
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        back = [(0, -1)] * (n + 1)  # id -1: an unknown character
        strange = not self.single.issuperset(part)
        at = 0  # positions below are final
        for end, (length, score, k) in self.auto.iter(part):  # by end; at each end the longest first
            end += 1
            while strange and at < end - 1:
                at += 1
                self._pass_unknown(part, best, back, at)
            start = end - length
            total = best[start] + score
            if total > best[end]:
                best[end], back[end] = total, (start, k)
        while strange and at < n:
            at += 1
            self._pass_unknown(part, best, back, at)
        return back

    def _pass_unknown(self, part: str, best: list[float], back: list, end: int) -> None:
        """A character that is no piece by itself may be passed as unknown."""
        if part[end - 1] not in self.single and best[end - 1] + self.unknown > best[end]:
            best[end], back[end] = best[end - 1] + self.unknown, (end - 1, -1)

    def split(self, text: str) -> list[str]:
        """The parts of a text, each to be segmented alone."""
        return self.parts.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str, merged: bool = False) -> bytes:
        """Little-endian 32-bit ids of a text."""
        return self.encode_parts(self.split(text), merged)

    def encode_parts(self, parts: list[str], merged: bool = False) -> bytes:
        cache = self.caches[merged]
        found = list(map(cache.get, parts))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    part = parts[i]
                    ids = found[i] = cache.get(part) or array("I", self.segment(part, merged)).tobytes()
                    if len(cache) < self.most and len(part) <= SHORT:
                        cache[part] = ids
        return b"".join(found)

    def encode_both(self, parts: list[str]) -> tuple[bytes, bytes]:
        """Both encodings of parts, looked up together."""
        cache = self.both
        found = list(map(cache.get, parts))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    part = parts[i]
                    ids = cache.get(part)
                    if ids is None:
                        ids = tuple(array("I", self.segment(part, m)).tobytes() for m in (False, True))
                        if len(cache) < self.most and len(part) <= SHORT:
                            cache[part] = ids
                    found[i] = ids
        return b"".join([x for x, _ in found]), b"".join([x for _, x in found])

    @property
    def id_bytes(self) -> list[bytes]:
        found = []
        for piece, _, kind in self.pieces:
            if kind == BYTE:
                found.append(bytes([int(piece[3:5], 16)]))
            elif kind in (NORMAL, USER):
                found.append(piece.replace(MARK, " ").encode())
            else:
                found.append(b"")
        return found


class Decoder:
    def __init__(self, pieces: list[bytes]):
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids, without the mark put before it."""
        k = np.frombuffer(ids, "<u4")
        lengths = self.lengths[k]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return ""
        at = np.arange(ends[-1]) + np.repeat(self.starts[k] - (ends - lengths), lengths)
        return self.data[at].tobytes().decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def tools(path: str) -> tuple[Encoder, Decoder]:
    encoder = Encoder(path)
    return encoder, Decoder(encoder.id_bytes)


def encode_documents(docs: DataFrame, path: str | None = None, merged: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) of each row; merged: a pair-merge model's own encoding."""
    path = path or model_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = tools(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                found = [np.frombuffer(encoder.encode(t or "", merged), "<i4") for t in some.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                values = np.concatenate(found) if found else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), ids], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows of doc_id and ids."""
    path = path or model_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = tools(path)
        for batch in batches:
            texts = [
                decoder.decode(np.array(ids.values, "<u4").tobytes() if ids.is_valid else b"")
                for ids in batch.column("ids")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and the SHA-256 of the text decoded from the ids again; merged_n_ids, merged_crc32: of a
    pair-merge model's own encoding (null for other models)."""
    path = path or model_path()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()),
         ("merged_n_ids", pa.int64()), ("merged_crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = tools(path)
        for batch in batches:
            rows: list[tuple] = []
            for lo in range(0, batch.num_rows, 500):
                for text in batch.column("text").slice(lo, 500).to_pylist():
                    parts = encoder.split(text or "")
                    if encoder.kind == PAIR_MERGES:
                        ids, again = encoder.encode_both(parts)
                    else:
                        ids, again = encoder.encode_parts(parts), None
                    rows.append((
                        len(ids) // 4, zlib.crc32(ids), hashlib.sha256(decoder.decode(ids).encode()).hexdigest(),
                        None if again is None else len(again) // 4, None if again is None else zlib.crc32(again),
                    ))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema
            )

    names = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, merged_n_ids long, merged_crc32 long"
    return id_text(docs).mapInArrow(run, names)

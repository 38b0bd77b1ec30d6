"""Best-fit packing: documents become token pieces, and pieces are packed into sequences of bounded length.

Hierarchical residual packing. Pieces (five numbers each, no text) are dealt evenly into groups of bounded size, so
that every group holds long and short pieces of all parts of the table. Each group packs its own pieces best-fit,
longest first, and emits the bins that are nearly full; its underfull bins are items of the next round, in which the
residues of several groups meet in one, and so on up a tree to one last group. A bin carries its pieces (at most as
many as it has tokens), so no join is needed to place them.

Best-fit leaves a group at most one bin that is half full or less, and two bins over half never fit together. So in
each later round a group gets at most `fan_in` bins that can join another one, and from any subtree at most so many
others are joined in a round. Of its bins over half a group therefore hands on the `fan_in` emptiest for each round
to come: whatever fits into a fuller one fits into these, so no merge is lost, and no group grows with the input.

Defined cases: null or empty text is the single end token; a document longer than the capacity is cut into pieces of
exactly the capacity and one rest; ties between equally long items are broken by doc_id and piece; repeated rows are
packed as often as they occur, and so are rows with a null doc_id; an empty table gives an empty result; only id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: A bin with this share of the capacity left or less leaves the tree.
FULL_WITHIN = 1 / 64
#: Groups whose residues meet in one group of the next round.
FAN_IN = 8
#: Distinct words whose ids a worker process remembers.
CACHE_WORDS = 500_000

#: Pieces of a group of the first round.
GROUP_PIECES = 16_384

PIECE = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>"
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("offset", pa.int64())]
)
BINS = pa.schema(
    [("grp", pa.int64()), ("part", pa.int64()), ("done", pa.bool_()), ("used", pa.int64()),
     ("members", pa.list_(pa.struct(list(PIECES))))]
)
PIECE_TYPES = [("doc_id", "long"), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")]
BIN = f"grp long, part long, done boolean, used long, members array<{PIECE}>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Little-endian 32-bit ids of words, filled from the tokenizer as words turn up.

    The tokenizer's pre-tokens never cross a space or a line feed and both are dropped, so a text's ids are those of
    its chunks between them, one after another. A chunk of Latin letters and punctuation behind them is two
    pre-tokens; the letters are looked up in lower case, as the tokenizer takes them, and many new ones are encoded as
    one text, in which the last token of each word is one that ends words. Such letters are already composed, so the
    merges are all that the tokenizer has to do for them.
    """

    #: ASCII punctuation but for the apostrophe, which can begin a pre-token of letters.
    TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.most, self.tails = most, {"": b""}
        tokenizer = Tokenizer.from_file(path)
        self.encode = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        merges = Tokenizer(tokenizer.model)
        merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.merge = lambda texts: [x.ids for x in merges.encode_batch_fast(texts, add_special_tokens=False)]
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, k in tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")

    def learn(self, words: list[str]) -> None:
        for word, ids in zip(words, self.encode(words)):
            self[word] = np.array(ids, "<u4").tobytes()

    def letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters."""
        runs, out = [words[lo : lo + 1000] for lo in range(0, len(words), 1000)], {}
        for run, ids in zip(runs, self.merge([" ".join(run) for run in runs])):
            ids = np.array(ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(run):
                raise ValueError("words and word ends differ")
            data, at = ids.tobytes(), 0
            for word, end in zip(run, (4 * cuts).tolist()):
                out[word] = data[at:end]
                at = end
        return out

    def fill(self, new: set[str]) -> None:
        """Makes self hold the new chunks."""
        simple, other = [], []
        for word in new:
            core = word.rstrip(self.TAIL)
            if core.isalpha() and (core.isascii() or max(core) <= "ÿ"):
                simple.append((word, core.lower(), word[len(core) :]))
            else:
                other.append(word)
        self.learn(other)
        letters, ends = self.letters(list({x[1] for x in simple})), self.tails
        tails = list({x[2] for x in simple}.difference(self.tails))
        for tail, ids in zip(tails, self.encode(tails)):
            self.tails[tail] = np.array(ids, "<u4").tobytes()
        for word, core, tail in simple:
            self[word] = letters[core] + ends[tail]

    def of(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        found = [list(map(self.get, words)) for words in split]
        gaps = [[i for i, ids in enumerate(x) if ids is None] if None in x else [] for x in found]
        new = {words[i] for words, at in zip(split, gaps) for i in at}
        self.fill(new)
        for words, ids, at in zip(split, found, gaps):
            for i in at:
                ids[i] = self[words[i]]
        if len(self) > self.most:  # the words known longest are the commonest
            for word in new:
                del self[word]
        if len(self.tails) > 100_000:
            self.tails = {"": b""}
        return [b"".join(ids) for ids in found]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker process."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            rows: list[tuple] = []
            ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo in range(0, len(ids_of), 256):
                some = texts.slice(lo, 256).to_pylist()
                for doc_id, ids in zip(ids_of[lo : lo + 256], words.of(some)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return id_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the items of each bin: longest items first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space left, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        if left > sizes[i]:
            insort(room, (left - sizes[i], b))
    return bins


def _pack_round(
    grp: int, used: np.ndarray, members: pa.LargeListArray, capacity: int, joins: int
) -> pa.RecordBatch:
    """Items (tokens used, pieces with their places in them) into bins of the BIN schema, finished or not.

    joins: how many bins over half full later rounds can join with others at most; 0 in the last one.
    """
    offsets = np.asarray(members.offsets)
    counts, starts = np.diff(offsets), offsets[:-1]
    flat = members.values
    head = flat.take(pa.array(starts))
    ids = pc.fill_null(head.field("doc_id"), -(1 << 63)).to_numpy(zero_copy_only=False)
    order = np.lexsort((head.field("piece").to_numpy(zero_copy_only=False), ids, -used))
    groups = best_fit(used[order].tolist(), capacity)
    items = order[np.fromiter((i for g in groups for i in g), np.int64, len(order))]
    per_bin = np.array([len(g) for g in groups], np.int64)
    # where an item begins in its bin
    ends = np.cumsum(used[items])
    first = np.cumsum(per_bin) - per_bin
    begin = ends - used[items] - np.repeat((ends - used[items])[first], per_bin)
    full = np.add.reduceat(used[items], first) if len(groups) else np.zeros(0, np.int64)
    # an item's pieces follow one another
    n = counts[items]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[items], n)
    pieces_ = flat.take(pa.array(at))
    place = pieces_.field("offset").to_numpy(zero_copy_only=False) + np.repeat(begin, n)
    fields = [pa.array(place) if f.name == "offset" else pieces_.field(f.name) for f in PIECES]
    own = pa.StructArray.from_arrays(fields, fields=list(PIECES))
    bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(n, first))]) if len(groups) else np.zeros(1, np.int64)

    done = np.full(len(groups), not joins) | (capacity - full <= capacity * FULL_WITHIN)
    rest = np.flatnonzero(~done)
    rest = rest[np.argsort(full[rest], kind="stable")]
    done[rest[joins + int((2 * full[rest] <= capacity).sum()) :]] = True
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(groups), grp)), pa.array(np.arange(len(groups))), pa.array(done), pa.array(full, pa.int64()),
            pa.LargeListArray.from_arrays(pa.array(bounds), own).cast(BINS.field("members").type),
        ],
        schema=BINS,
    )


def _first_round(batches: Iterator[pa.RecordBatch], capacity: int, joins: int) -> Iterator[pa.RecordBatch]:
    """Best-fit over all pieces of a group, which is a partition."""
    from pyspark import TaskContext

    grp = TaskContext.get().partitionId()
    table = pa.Table.from_batches(batches, schema=pa.schema(list(PIECES)[:-1])).combine_chunks()
    if not table.num_rows:
        return
    zero = pa.array(np.zeros(table.num_rows, np.int64))
    cols = [table.column(f.name).chunk(0) for f in list(PIECES)[:-1]]
    single = pa.StructArray.from_arrays([*cols, zero], fields=list(PIECES))
    members = pa.LargeListArray.from_arrays(pa.array(np.arange(table.num_rows + 1)), single)
    yield _pack_round(grp, table.column("length").to_numpy(), members, capacity, joins)


def _later_round(items: pa.Table, capacity: int, joins: int) -> pa.Table:
    """Best-fit over the bins that the groups below handed on."""
    members = items.column("members").combine_chunks()
    members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
    members = pa.LargeListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(members).to_numpy())])), members.flatten()
    )
    grp = items.column("grp")[0].as_py()
    return pa.Table.from_batches([_pack_round(grp, items.column("used").to_numpy(), members, capacity, joins)])


def rounds_above(groups: int, fan_in: int) -> int:
    """Rounds from so many groups to a single one, that one's included."""
    n = 0
    while groups > 1:
        groups, n = -(-groups // fan_in), n + 1
    return n


def pack(items: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset; items as from `pieces`."""
    items = materialize(items.select(*[F.col(f).cast(t) for f, t in PIECE_TYPES]), "pieces")
    width = max(1, -(-items.count() // group_pieces))
    # dealt in turn, not by a key, so that all groups are alike whatever rows repeat
    dealt = items.repartition(width)
    joins = fan_in * rounds_above(width, fan_in)
    packed = materialize(dealt.mapInArrow(lambda batches: _first_round(batches, capacity, joins), BIN), "packed-0")
    finished = [packed.where("done")]
    rest = packed.where("not done")
    while width > 1:
        width = -(-width // fan_in)
        left = fan_in * rounds_above(width, fan_in)
        merged = rest.withColumn("grp", F.floor(F.col("grp") / fan_in).cast("long"))
        packed = materialize(
            merged.groupBy("grp").applyInArrow(lambda x: _later_round(x, capacity, left), BIN),
            f"packed-{len(finished)}",
        )
        finished.append(packed.where("done"))
        rest = packed.where("not done")
    bins = None
    for k, df in enumerate(finished):
        # a bin's number: its round, its group and its place in the group
        number = F.lit(k << 58).bitwiseOR(F.shiftleft("grp", 32)).bitwiseOR(F.col("part"))
        df = df.select(number.alias("sequence_id"), F.explode("members").alias("m"))
        bins = df if bins is None else bins.unionByName(df)
    return bins.select(*[f"m.{c}" for c in PIECES.names[:-1]], "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path or tokenizer_path(), capacity), capacity)

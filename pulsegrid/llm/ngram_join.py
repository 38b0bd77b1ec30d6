"""N-gram Jaccard join: documents whose sets of word n-grams are similar, as a blocked sparse product.

The document by n-gram incidence is multiplied with its transpose only where a pair can reach the bound. Documents with
equal sets are one class. A class's n-grams are put in one global order, commonest last, and only a prefix of them is
kept: two classes with Jaccard similarity of at least `percent` share an n-gram of both prefixes. Posting lists are the
n-grams that several classes have in their prefixes.

Only components of links are wanted, so no list is squared into rows:

1. Each list links its classes to one of them, the one with fewest rarer n-grams (its pivot). Overlap counts are
   accumulated for each pair, pairs below the bound that sizes and places set are dropped, and each class is compared
   with its likeliest pivot on whole sets. The components of these links follow.
2. Lists that still hold several components are cut into cells of bounded size. Inside a cell pairs of different
   components are dropped by sizes and places, then by parity sketches of their sets (the number of differing bits never
   exceeds the symmetric difference). Classes of the pairs that stay are joined into candidate groups; a cell gives out
   at most one row for each of its rows.
3. Candidate groups are cut into blocks of classes. Each pair of blocks is multiplied: overlap counts accumulate n-gram
   by n-gram, pairs below the bound of their sizes are discarded, and components that a link joins come out as a
   spanning forest.

Every pair that could join two components is looked at in step 2 or 3, so components are exact. The order of n-grams
only decides how much is compared, never what is found. It uses document counts of the n-grams that tasks saw twice or
more; the commonest HEAVY of them are broadcast (16 bytes each).

Defined cases: null or empty texts, and texts without words, have an empty set, link with nothing and are their own
component; with fewer words than n the whole sequence is the one n-gram; rows that repeat a doc_id give repeated rows,
and the doc_id is linked as each of its texts is; a row with a null doc_id links like any other but never names a
component (component_id is null where all its rows have null ids), and `keep_one` keeps it; an empty table gives an
empty result; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, files_for, hash_spans, id_text, lowered, mix, rolling, word_spans
from .components import connected_components

N, PERCENT = 5, 80
#: N-grams whose counts are broadcast to order prefixes.
HEAVY = 200_000
#: Distinct sets of a task whose n-grams are counted together, and n-grams of those, about.
COUNT_SETS, HELD_GRAMS = 20_000, 2_500_000
#: Rows of a list in one cell, about; classes and n-grams of a block; pairs of a cell looked at together.
CELL_ROWS, BLOCK_CLASSES, BLOCK_GRAMS, PAIRS = 4096, 256, 1_000_000, 1 << 20
#: Bits of the sketch of a set: about one a member.
LEAST_BITS, MOST_BITS = 256, 2048

PROFILE = pa.schema(
    [("doc_id", pa.int64()), ("member", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("size", pa.int64()),
     ("sketch", pa.binary()), ("sets", pa.int64())]
)


def gram_sets(col, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of an Arrow column, in order."""
    for block in blocks(col):
        data = lowered(block.data)
        starts, ends, doc = word_spans(block)
        words = hash_spans(data, starts, ends)
        cuts = np.searchsorted(doc, np.arange(len(block) + 1))
        grams = rolling(words, n)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield rolling(words[lo:hi], hi - lo)
            else:
                yield np.zeros(0, np.uint64)


#: Seeds of the two fingerprints of a set.
KEY, CHECK = 7, 8


def set_key(grams: np.ndarray, seed: int = KEY) -> int:
    """A 64-bit fingerprint of a set, as a signed number; the set's size is part of it."""
    total = np.add.reduce(mix(grams + np.uint64(seed)), dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(len(grams))).view(np.int64)[0])


@dataclass(frozen=True)
class Keys:
    """Names of classes: the first fingerprint of a set, cut to so many bits, or the whole second one where different
    sets share the first."""

    bits: int = 64
    clashing: frozenset[int] = frozenset()

    def first(self, grams: np.ndarray) -> int:
        return set_key(grams) >> (64 - self.bits)

    def of(self, grams: np.ndarray) -> int:
        key = self.first(grams)
        return set_key(grams, CHECK) if key in self.clashing else key


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the members of a set that fall on each of a power of two of bits."""
    bits = min(max(LEAST_BITS, 1 << (len(grams) - 1).bit_length()), MOST_BITS) if len(grams) else LEAST_BITS
    at = (mix(grams ^ np.uint64(0x5DEECE66D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)


def profile(docs: DataFrame, n: int, keys_of: Keys) -> DataFrame:
    """doc_id, member (hash of the text), key, check, size and sketch of every row; sets is null.

    Also rows with sets: key is an n-gram that so many sets in part of a task have.
    """

    def count(sets: list[np.ndarray]) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(sets), return_counts=True)
        grams, counts = grams[counts > 1], counts[counts > 1]
        null = pa.nulls(len(grams), pa.int64())
        return _batch(PROFILE, null, null, grams.view(np.int64), null, null, pa.nulls(len(grams), pa.binary()), counts)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            keys, checks, sizes, sketches = [], [], [], []
            for grams in gram_sets(batch.column("text"), n):
                key = keys_of.first(grams)
                keys.append(key)
                checks.append(set_key(grams, CHECK))
                sizes.append(len(grams))
                sketches.append(sketch(grams))
                if key not in seen and len(grams):
                    seen.add(key)
                    sets.append(grams)
                    held += len(grams)
                if held > HELD_GRAMS or len(sets) >= COUNT_SETS:
                    yield count(sets)
                    sets, held, seen = [], 0, set()
            null = pa.nulls(len(keys), pa.int64())
            yield _batch(PROFILE, batch.column("doc_id"), batch.column("member"), keys, checks, sizes, sketches, null)
        if sets:
            yield count(sets)

    return docs.mapInArrow(
        look, "doc_id long, member long, key long, check long, size long, sketch binary, sets long"
    )


def heavy_grams(profiled: DataFrame, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the n-grams seen in the most sets."""
    top = (
        profiled.where("sets IS NOT NULL")
        .groupBy("key")
        .agg(F.sum("sets").alias("n"))
        .orderBy(F.desc("n"), "key")
        .limit(most)
        .toArrow()
    )
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top.column("n").to_numpy()[order]


def prefix_length(size: int, percent: int) -> int:
    """A set shares at least ceil(percent/100 * size) members with any set similar enough."""
    return size - -(-percent * size // 100) + 1


LISTED = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])


def prefixes(
    docs: DataFrame, n: int, percent: int, heavy: tuple[np.ndarray, np.ndarray], keys_of: Keys
) -> DataFrame:
    """gram, key, size, place, known: prefix members of each class, their places in the global order, and whether they
    are known to be common."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    schema = LISTED.append(pa.field("known", pa.bool_()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            out: list[np.ndarray] = []
            known: list[np.ndarray] = []
            keys, sizes, lengths = [], [], []
            for grams in gram_sets(batch.column("text"), n):
                size = len(grams)
                key = keys_of.of(grams)
                if not size or key in seen:
                    continue
                seen.add(key)
                take = prefix_length(size, percent)
                weight = np.zeros(size, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                    weight = np.where(common[at] == grams, counts[at], 0)
                    if weight.any():
                        order = np.lexsort((grams, weight))
                        grams, weight = grams[order], weight[order]
                out.append(grams[:take])
                known.append(weight[:take] > 0)
                keys.append(key)
                sizes.append(size)
                lengths.append(take)
            if out:
                yield _batch(
                    schema,
                    np.concatenate(out).view(np.int64),
                    np.repeat(np.array(keys, np.int64), lengths),
                    np.repeat(np.array(sizes, np.int32), lengths),
                    np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]),
                    np.concatenate(known),
                )

    return docs.mapInArrow(look, "gram long, key long, size int, place int, known boolean")


def postings(prefixed: DataFrame) -> DataFrame:
    """The rows of prefixed whose n-gram is in the prefixes of several classes, each once.

    Rows are sorted by n-gram and streamed past their neighbours. Known common n-grams skip that: their lists may be
    long, and they are combined by hash aggregation instead.
    """
    schema = LISTED

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, and whether it has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, key = batch.column("gram").to_numpy(), batch.column("key").to_numpy()
            size, place = batch.column("size").to_numpy(), batch.column("place").to_numpy()
            if last is not None:
                gram, key = np.r_[last[0], gram], np.r_[last[1], key]
                size, place = np.r_[last[2], size], np.r_[last[3], place]
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
            given = last is not None and last[4]
            gram, key, size, place = gram[fresh], key[fresh], size[fresh], place[fresh]
            same = gram[1:] == gram[:-1]
            keep = np.zeros(len(gram), bool)
            keep[1:] |= same
            keep[:-1] |= same
            told = bool(keep[-1]) or (len(gram) == 1 and given)
            if given:
                keep[0] = False
            last = (gram[-1], key[-1], size[-1], place[-1], told)
            yield _batch(schema, gram[keep], key[keep], size[keep], place[keep])

    names = "gram long, key long, size int, place int"
    # a known n-gram's rows are dealt out by class, so that no task gets them all
    salt = F.when(F.col("known"), F.pmod(F.col("key"), F.lit(4096))).otherwise(F.lit(0))
    dealt = prefixed.repartition(F.col("gram"), salt).sortWithinPartitions("known", "gram", "key")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of known n-grams once each, of the others when repeated; the others come first."""
        rest: list[pa.RecordBatch] = []
        before = None

        def unknown() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = batch.column("known").to_numpy(zero_copy_only=False)
                first = int(np.searchsorted(known, True))
                if first < len(known):
                    rest.append(batch.slice(first))
                if first:
                    yield batch.slice(0, first)
                if first < len(known):
                    return

        yield from repeated(unknown())
        for batch in chain(rest, batches):
            if batch.num_rows:
                before, out = once(batch, before)
                yield out

    def once(batch: pa.RecordBatch, before: tuple[int, int] | None) -> tuple[tuple[int, int], pa.RecordBatch]:
        gram, key = batch.column("gram").to_numpy(), batch.column("key").to_numpy()
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
        if before is not None:
            fresh[0] = (gram[0], key[0]) != before
        cols = [batch.column(c).to_numpy()[fresh] for c in ("gram", "key", "size", "place")]
        return (gram[-1], key[-1]), _batch(schema, *cols)

    return dealt.mapInArrow(split, names)


def enough(shared, size_a, size_b, percent: int):
    """Whether so many shared members make two sets similar enough; columns or numbers."""
    return 100 * shared >= percent * (size_a + size_b - shared)


def bounded_pairs(products: DataFrame, percent: int) -> DataFrame:
    """a, b, shared of the pairs that can still be similar, from one row for each shared prefix member.

    Beyond the last shared prefix member a pair can share no more than what either set has left.
    """
    totals = products.groupBy("key", "a", "b").agg(
        F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.count("*").alias("shared"),
        F.max("place_a").alias("place_a"), F.max("place_b").alias("place_b"),
    )
    left = F.least(F.col("size_a") - F.col("place_a") - 1, F.col("size_b") - F.col("place_b") - 1)
    most = F.col("shared") + left
    return totals.where(enough(most, F.col("size_a"), F.col("size_b"), percent)).select("key", "a", "b", "shared")


def reachable(x: str, y: str, percent: int):
    """Whether a shared n-gram of x and y can be one of those by which a pair of their sizes must meet.

    The sizes must be near enough, and similar sets share at least `least` members, so one of the first
    size - least + 1 of either.
    """
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    least = F.ceil(percent * (a + b) / (100.0 + percent) - 1e-9)
    near = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    return near & (F.col(f"{x}.place") <= a - least) & (F.col(f"{y}.place") <= b - least)


def sides(left: str, right: str) -> list:
    """a, b with a < b, and size and place of either."""
    first = F.col(f"{left}.key") < F.col(f"{right}.key")

    def pick(field: str, swap: bool):
        x, y = F.col(f"{left}.{field}"), F.col(f"{right}.{field}")
        return F.when(first, y if swap else x).otherwise(x if swap else y)

    return [
        pick("key", False).alias("a"), pick("key", True).alias("b"),
        pick("size", False).alias("size_a"), pick("size", True).alias("size_b"),
        pick("place", False).alias("place_a"), pick("place", True).alias("place_b"),
    ]


def sets_of(docs: DataFrame, classes: DataFrame, keys: DataFrame, n: int, keys_of: Keys) -> DataFrame:
    """key, grams of the classes (key, hash of the text of one member) that keys names."""
    schema = pa.schema([("key", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                sets = list(gram_sets(batch.column("text").slice(lo, 500), n))
                yield _batch(schema, [keys_of.of(x) for x in sets], [x.view(np.int64) for x in sets])

    wanted = classes.join(keys.distinct(), "key", "left_semi").select("member").distinct()
    return docs.join(wanted, "member", "left_semi").mapInArrow(look, "key long, grams array<long>").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, compared on their whole sets."""
    with_a = pairs.select("a", "b").join(sets.select(F.col("key").alias("a"), F.col("grams").alias("grams_a")), "a")
    with_b = with_a.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("grams_b")), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return with_b.where(enough(shared, F.size("grams_a"), F.size("grams_b"), percent)).select("a", "b")


# ------------------------------------------------------------------------------------------- cells and candidates


def placed_lists(lists: DataFrame, found: DataFrame, scratch: Scratch, files: int) -> DataFrame:
    """The rows of lists that hold several components, with each class's component, the list's largest component, and
    how many rows it and the list have."""
    placed = lists.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    tally = placed.groupBy("gram", "component").agg(F.count("*").alias("n"))
    largest = tally.groupBy("gram").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"),
        F.sum("n").alias("total"), F.count("*").alias("parts"),
    )
    largest = scratch.table(largest.where("parts > 1").drop("parts"), "largest", files)
    return placed.join(largest, "gram")


def _halves(mine: Column, own: Column) -> Column:
    """Structs (i, j, part) of the pairs of a chunk with each of `own` chunks of the same rows."""
    return F.transform(
        F.sequence(F.lit(0).cast("long"), own - 1),
        lambda k: F.struct(
            F.least(mine, k).alias("i"), F.greatest(mine, k).alias("j"), F.when(mine > k, 1).otherwise(0).alias("part")
        ),
    )


def list_cells(mixed: DataFrame, cell_rows: int) -> DataFrame:
    """Rows of mixed once for each cell that they are in: (gram, i, j) and the part of it.

    A list of up to cell_rows rows is one cell. Of a longer one the rows outside the largest component meet each other
    and the rest in chunks; rows of the largest component need not meet each other.
    """
    other = F.col("component") != F.col("main")
    half = max(1, cell_rows // 2)
    n_other = F.ceil((F.col("total") - F.col("n_main")) / half).cast("long")
    n_main = F.ceil(F.col("n_main") / half).cast("long")
    mine = F.pmod(F.xxhash64("key"), F.when(other, n_other).otherwise(n_main))
    to_main = F.transform(
        F.sequence(F.lit(0).cast("long"), n_main - 1),
        lambda k: F.struct(mine.alias("i"), (-1 - k).alias("j"), F.lit(0).alias("part")),
    )
    to_other = F.transform(
        F.sequence(F.lit(0).cast("long"), n_other - 1),
        lambda k: F.struct(k.alias("i"), (-1 - mine).alias("j"), F.lit(1).alias("part")),
    )
    zero = F.lit(0).cast("long")
    one = F.array(F.struct(zero.alias("i"), zero.alias("j"), F.lit(0).alias("part")))
    cells = F.when(F.col("total") <= cell_rows, one).when(other, F.concat(_halves(mine, n_other), to_main)).otherwise(to_other)
    return mixed.select("gram", "key", "size", "place", "component", F.explode(cells).alias("c")).select(
        "gram", "c.i", "c.j", "c.part", "key", "size", "place", "component"
    )


def whole_cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by names, cut anew so that no cell is in two of them."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]).combine_chunks() if held is not None else now
        same = np.ones(now.num_rows - 1, bool)
        for name in names:
            x = now.column(name).to_numpy()
            same &= x[1:] == x[:-1]
        edges = np.flatnonzero(~same)
        cut = int(edges[-1]) + 1 if len(edges) else 0
        if cut:
            yield now.slice(0, cut)
        held = now.slice(cut)
    if held is not None:
        yield held


def ragged_pairs(ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) with x < y < ends[x], all of them, at most about `most` at once."""
    n = np.maximum(ends - np.arange(len(ends)) - 1, 0)
    total = np.concatenate([[0], np.cumsum(n)])
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        x = np.repeat(np.arange(lo, hi), n[lo:hi])
        if len(x):
            yield x, x + 1 + np.arange(len(x)) - (total[x] - total[lo])
        lo = hi


def merged_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each a node of the group, its own label) after x and y have been joined too."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def folded(sketches: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """64-bit words of each sketch, and for each number of words: the rows' places in, and the matrix of the sketches
    of at least so many, folded to it."""
    col = sketches.combine_chunks() if isinstance(sketches, pa.ChunkedArray) else sketches
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].copy().view(np.uint64)
    starts, words = (off[:-1] - off[0]) // 8, (off[1:] - off[:-1]) // 8
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows = np.zeros(0, np.int64)
    above = np.zeros((0, 2), np.uint64)
    for w in sorted(set(words.tolist()), reverse=True):
        while above.shape[1] > w:  # fold, and halves of sizes that no row has
            half = above.shape[1] // 2
            above = above[:, :half] ^ above[:, half:]
        own = np.flatnonzero(words == w)
        fresh = data[starts[own][:, None] + np.arange(w)]
        above = np.concatenate([above, fresh]) if len(rows) else fresh
        rows = np.concatenate([rows, own])
        place = np.full(len(words), -1)
        place[rows] = np.arange(len(rows))
        levels[w] = (place, above)
    return words, levels


def sketches_near(x: np.ndarray, y: np.ndarray, size: np.ndarray, words, levels, percent: int) -> np.ndarray:
    """Whether the sketches of rows x and y allow so small a symmetric difference as similar sets have."""
    ok = np.zeros(len(x), bool)
    least = np.minimum(words[x], words[y])
    for w, (place, matrix) in levels.items():
        at = np.flatnonzero(least == w)
        for lo in range(0, len(at), 1 << 17):
            k = at[lo : lo + (1 << 17)]
            bits = np.bitwise_count(matrix[place[x[k]]] ^ matrix[place[y[k]]]).sum(1, dtype=np.int64)
            # shared = (total - difference) / 2 and union = (total + difference) / 2
            ok[k] = (100 + percent) * bits <= (100 - percent) * (size[x[k]] + size[y[k]])
    return ok


def near_in_cells(table: pa.Table, percent: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Keys a, b that join the classes of the pairs of different components that can be similar, a < b by row."""
    gram, i, j, part, key, size, place, component = (
        table.column(c).to_numpy() for c in ("gram", "i", "j", "part", "key", "size", "place", "component")
    )
    n = len(key)
    size, place = size.astype(np.int64), place.astype(np.int64)
    edge = np.flatnonzero((gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    bounds = np.concatenate([edge, [n]])
    ends = bounds[np.searchsorted(bounds, np.arange(n), "right")]
    words, levels = folded(table.column("sketch"))
    label = np.arange(n)
    for x, y in ragged_pairs(ends, pairs):
        a, b = size[x], size[y]
        least = -(-percent * (a + b) // (100 + percent))  # members that similar sets of these sizes share
        keep = (component[x] != component[y]) & ((i[x] == j[x]) | (part[x] != part[y]))
        keep &= (least <= np.minimum(a, b)) & (place[x] <= a - least) & (place[y] <= b - least)
        x, y = x[keep], y[keep]
        if len(x):
            near = sketches_near(x, y, size, words, levels, percent)
            label = merged_labels(label, x[near], y[near])
    own = np.flatnonzero(label != np.arange(n))
    return key[label[own]], key[own]


def near_classes(mixed: DataFrame, sketches: DataFrame, percent: int, cell_rows: int) -> DataFrame:
    """a, b: edges that join all classes of which a pair of different components can still be similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches, ["gram", "i", "j"]):
            yield _batch(schema, *near_in_cells(table, percent))

    cells = list_cells(mixed, cell_rows).join(sketches, "key")
    dealt = cells.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    return dealt.mapInArrow(look, "a long, b long").distinct()


# ------------------------------------------------------------------------------------------------ block products


def overlaps(grams: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams each row of left shares with each row of right."""
    off = np.frombuffer(grams.buffers()[1], np.int64)[grams.offset : grams.offset + len(grams) + 1]
    values = grams.values.to_numpy()[off[0] : off[-1]]
    row = np.repeat(np.arange(len(grams)), np.diff(off))
    _, code, seen = np.unique(values, return_inverse=True, return_counts=True)
    row, code = row[seen[code] > 1], np.cumsum(seen > 1)[code[seen[code] > 1]] - 1
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    place = np.full((2, len(grams)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.int64)
    step = 2048
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        at = slice(*np.searchsorted(code, [lo, lo + step]))
        sides = []
        for side, n in ((0, len(left)), (1, len(right))):
            r, c = place[side, row[at]], code[at] - lo
            x = np.zeros((n, step), np.float32)
            x[r[r >= 0], c[r >= 0]] = 1
            sides.append(x)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def linked_components(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """a, b: components of a pair of blocks that links join, as a forest."""
    part, component = table.column("part").to_numpy(), table.column("component").to_numpy()
    grams = table.column("grams").combine_chunks()
    grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
    grams = grams.cast(pa.large_list(pa.int64()))
    size = np.diff(np.frombuffer(grams.buffers()[1], np.int64)[grams.offset : grams.offset + len(grams) + 1])
    diagonal = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    left = np.arange(len(part)) if diagonal else np.flatnonzero(part == 0)
    right = left if diagonal else np.flatnonzero(part == 1)
    shared = overlaps(grams, left, right)
    links = enough(shared, size[left][:, None], size[right][None, :], percent)
    names, code = np.unique(component, return_inverse=True)
    x, y = np.nonzero(links & (code[left][:, None] != code[right][None, :]))
    label = merged_labels(np.arange(len(names)), code[left[x]], code[right[y]])
    own = np.flatnonzero(label != np.arange(len(names)))
    return names[label[own]], names[own]


def block_products(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of components that links join; groups has key, component and the candidate group of classes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def look(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(schema, *linked_components(table, percent))])

    full = groups.join(sets, "key")
    sizes = groups.join(sets.select("key", F.size("grams").alias("n_grams")), "key").groupBy("candidate").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("long").alias("n")
    )
    mine = F.pmod(F.xxhash64("key"), F.col("n"))
    cells = full.join(sizes, "candidate").select(
        "candidate", "component", "grams", F.explode(_halves(mine, F.col("n"))).alias("c")
    )
    cells = cells.select("candidate", "c.i", "c.j", "c.part", "component", "grams")
    return cells.groupBy("candidate", "i", "j").applyInArrow(look, "a long, b long").distinct()


# --------------------------------------------------------------------------------------------------- components


def class_components(
    docs: DataFrame, profiled: DataFrame, n: int, percent: int, keys_of: Keys, scratch: Scratch
) -> tuple[DataFrame, DataFrame | None]:
    """node, component of the classes that link with their pivot; node, component of those components that link."""
    heavy = heavy_grams(profiled)
    classes = profiled.where("sets IS NULL AND size > 0").groupBy("key").agg(
        F.min("member").alias("member"), F.first("sketch").alias("sketch")
    )
    lists = scratch.table(postings(prefixes(docs, n, percent, heavy, keys_of)), "postings")
    files = files_for(lists.count())
    # every class of a list with the list's pivot
    row = F.struct("place", "key", "size")
    pivots = lists.groupBy("gram").agg(F.min(row).alias("x"), F.count("*").alias("n")).where("n > 1")
    pivots = scratch.table(pivots.select("gram", "x"), "pivots", files)
    star = (
        lists.withColumn("y", row)
        .join(pivots, "gram")
        .where(F.col("x.key") != F.col("y.key"))
        .where(reachable("x", "y", percent))
        .select(F.col("y.key").alias("key"), *sides("x", "y"))
    )
    # each class with its likeliest pivot; a pair's products are not complete here, so all else is left to the cells
    star = bounded_pairs(star, percent).groupBy("key").agg(F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("p"))
    tried = scratch.table(star.select("p.a", "p.b").distinct(), "pairs", files)
    keys = tried.select(F.col("a").alias("key")).unionByName(tried.select(F.col("b").alias("key")))
    sets = scratch.table(sets_of(docs, classes, keys, n, keys_of), "gram-sets")
    found = connected_components(verified(tried, sets, percent), scratch)
    # classes of different components that share a list
    mixed = placed_lists(lists, found, scratch, files)
    near = scratch.table(near_classes(mixed, classes.select("key", "sketch"), percent, CELL_ROWS), "near", files)
    if near.isEmpty():
        return found, None
    groups = connected_components(near, scratch).select(F.col("node").alias("key"), F.col("component").alias("candidate"))
    groups = groups.join(found.withColumnRenamed("node", "key"), "key", "left")
    groups = scratch.table(groups.withColumn("component", F.coalesce("component", "key")), "groups", files)
    sets = scratch.table(sets_of(docs, classes, groups.select("key"), n, keys_of), "gram-sets")
    return found, connected_components(block_products(groups, sets, percent), scratch)


def distinct_profile(rows: DataFrame, n: int, keys_of: Keys, scratch: Scratch) -> tuple[DataFrame, Keys]:
    """The profile of rows, and how its keys are made: no two different sets have the same.

    Sets are told apart by both fingerprints, 128 bits. Where the first one clashes, the second one becomes the key, and
    the text is not read again. Of s sets about s * s / 2**65 pairs clash, three of 10**10 sets and 27,000 of 10**12: so
    many keys the driver holds.
    """
    profiled = scratch.table(profile(rows, n, keys_of), "profile")
    named = profiled.where("sets IS NULL").groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b"))
    clashing = named.where("a <> b").select("key").toArrow().column("key").to_pylist()
    if clashing:
        shared = profiled.sparkSession.createDataFrame([(k, True) for k in clashing], "key long, both boolean")
        key = F.when(F.col("sets").isNull() & F.col("both"), F.col("check")).otherwise(F.col("key"))
        renamed = profiled.join(F.broadcast(shared), "key", "left").withColumn("key", key).select(*profiled.columns)
        profiled = scratch.table(renamed, "profile")
    return profiled, replace(keys_of, clashing=frozenset(clashing))


def link_documents(docs: DataFrame, n: int = N, percent: int = PERCENT, keys_of: Keys = Keys()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = id_text(docs).withColumn("member", F.xxhash64("text"))
    profiled, keys_of = distinct_profile(rows, n, keys_of, scratch)
    found, joined = class_components(rows, profiled, n, percent, keys_of, scratch)
    members = profiled.where("sets IS NULL").select("doc_id", "key", "size")
    members = members.join(found.withColumnRenamed("node", "key"), "key", "left")
    # classes that link with nothing still join their own copies; empty sets join nothing
    members = members.withColumn("component", F.coalesce("component", "key"))
    if joined is not None:
        above = joined.select(F.col("node").alias("component"), F.col("component").alias("above"))
        members = members.join(above, "component", "left").withColumn("component", F.coalesce("above", "component"))
    least = members.where("size > 0").groupBy(F.col("component").alias("least_of")).agg(F.min("doc_id").alias("component_id"))
    least = scratch.table(least, "least")
    scratch.drop(profiled, found, least, *([] if joined is None else [joined]))
    named = members.join(least, F.col("component") == F.col("least_of"), "left")
    return named.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are the smallest of their group, with all their columns; rows without an id stay."""
    lost = link_documents(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, F.col("doc_id").cast("long") == F.col("__lost"), "left_anti")

"""Approximate nearest neighbours by inner product: stable projections indexed by a kd-tree.

Largest inner product is smallest distance after every vector gets one more component that makes all lengths equal
(and queries a zero there). The lengthened vectors are projected to a few dimensions with a Gaussian (2-stable) matrix,
so a squared projected distance is the true one times a chi-square variable. The upper part of the kd-tree deals all
vectors to blocks, the lower part is one tree in each block; both are built once and written. A query visits the
leaves of its nearest block by their projected distance, and verifies their points on the original vectors; the search
stops once the chi-square test says that a point nearer than the current last neighbour would, with probability
`confidence`, have been seen. The same test then tells which other blocks the query must visit. How many these are is up
to the data: on tight groups few, on vectors without structure nearly all, and then queries times blocks are shuffled
(the query's vector each time), which is the cost of an exact answer in blocks and bounds what the search can cost.
Where rounding could decide which vector is the last to be kept, correctly rounded products do, and ids among equals.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null
id; vectors of different lengths are searched apart; a query's own row never counts, other rows with the same vector do;
rows that repeat a vec_id count once (the first vector in order of its values); fewer than k candidates give as many
rows; ties go to the smaller vec_id; an empty table gives an empty result; only id and vector are read, so other columns
may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

K, QUERY_EVERY = 20, 20
#: Projected dimensions (even), points of a leaf, probability of the stopping test.
DIMENSIONS, LEAF, CONFIDENCE = 8, 64, 0.8
#: Vectors of a block, about; queries that meet a block in one task; projections that the planes are fitted on.
BLOCK_VECTORS, BLOCK_QUERIES, SAMPLE = 8192, 2048, 1 << 18
#: Distances of queries to boxes of blocks that a task holds at once.
BOX_CELLS = 1 << 21
SEED = 11


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<double>), dim of the vectors that take part, one row an id."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def chi_square_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """For even m."""
    h = np.minimum(x, 1e6) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, m // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


class Splits:
    """The upper part of a kd-tree over projections: planes that part space into blocks of about equal numbers of points."""

    def __init__(self, sample: np.ndarray, blocks: int):
        self.axis, self.value, self.child = [], [], []
        self.blocks = 0
        self._part(sample, max(1, blocks))
        self.axis, self.value, self.child = np.array(self.axis, int), np.array(self.value, float), np.array(self.child, int)

    def _part(self, points: np.ndarray, blocks: int) -> int:
        """A node's number; a leaf's is -1 - its block."""
        if blocks == 1 or len(points) < 2:
            self.blocks += 1
            return -self.blocks
        axis = int(np.argmax(points.max(0) - points.min(0)))
        order = np.argsort(points[:, axis], kind="stable")
        cut = max(1, len(points) * (blocks // 2) // blocks)
        node = len(self.axis)
        self.axis.append(axis)
        self.value.append(points[order[cut], axis])
        self.child.append((0, 0))
        self.child[node] = (
            self._part(points[order[:cut]], blocks // 2), self._part(points[order[cut:]], blocks - blocks // 2)
        )
        return node

    def of(self, points: np.ndarray) -> np.ndarray:
        """The block of each point."""
        node = np.full(len(points), 0 if len(self.axis) else -1)
        while (live := np.flatnonzero(node >= 0)).size:
            k = node[live]
            node[live] = self.child[k, (points[live, self.axis[k]] >= self.value[k]).astype(int)]
        return -1 - node


def leaves_of(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The leaf of each point in the lower part of the kd-tree, that of one block."""
    out, n, todo = np.zeros(len(points), np.int32), 0, [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out[rows] = n
            n += 1
            continue
        own = points[rows]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        half = len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        q = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[:, d] - q, q - high[:, d]), 0) ** 2
    return out


def projection(dim: int, dims: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Gaussian rows for the components of a vector, and one for the component that lengthens it."""
    return np.random.default_rng([seed, dim]).normal(size=(dim + 1, dims))


def projected(x: np.ndarray, longest: float) -> np.ndarray:
    """Projections of vectors that are lengthened to the same length."""
    matrix = projection(x.shape[1])
    rest = np.sqrt(np.maximum(longest - (x**2).sum(1), 0))
    return x @ matrix[:-1] + np.outer(rest, matrix[-1])


def passes(ahead: np.ndarray, last: np.ndarray, dims: int, confidence: float) -> np.ndarray:
    """The stopping test: whether a point nearer than `last` would, with that probability, lie nearer than `ahead` when
    projected (both squared)."""
    return np.isfinite(last) & (chi_square_cdf(ahead / np.maximum(last, 1e-12), dims) >= confidence)


def exact_scores(q: np.ndarray, rows: np.ndarray) -> list[float]:
    """Correctly rounded inner products of one vector with some."""
    return [math.fsum(p) for p in (rows * q).tolist()]


def search(
    ids: np.ndarray, x: np.ndarray, leaf: np.ndarray, query_ids: np.ndarray, q: np.ndarray, known: np.ndarray,
    longest: float, k: int = K, confidence: float = CONFIDENCE,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """query ids, vector ids and scores of each query's best k of a block, by score, then id, and how many points were
    verified.

    leaf: each vector's leaf; known: the score of the last neighbour that a query has already (-inf: too few);
    longest: the largest squared length of all vectors, so that all blocks lengthen alike.
    """
    distinct, first, where = np.unique(x, axis=0, return_index=True, return_inverse=True)
    order = np.lexsort((ids, where.ravel()))
    copies = np.split(ids[order], np.flatnonzero(np.diff(where.ravel()[order])) + 1)
    copies = [c[: k + 1] for c in copies]
    points = projected(distinct, longest)
    own_leaf = leaf[first]
    order = np.argsort(own_leaf, kind="stable")
    leaves = np.split(order, np.flatnonzero(np.diff(own_leaf[order])) + 1)
    low, high = (np.array([f(points[r], 0) for r in leaves]) for f in (np.min, np.max))
    boxes = box_distances(q @ projection(x.shape[1])[:-1], low, high)
    visit = np.argsort(boxes, axis=1, kind="stable")
    n, dims = len(q), points.shape[1]
    base = (q**2).sum(1) + longest  # squared distance = base - 2 * inner product
    slack = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((q**2).sum(1) * longest)  # bounds the rounding of two products
    width = k + 1  # one more for the query's own row
    kept_score = np.full((n, width), -np.inf)
    kept_row = np.full((n, width), -1)
    live, seen = np.arange(n), 0
    for turn in range(len(leaves)):
        # distance of the last neighbour that would be returned; infinite while there are too few
        worst = np.maximum(np.sort(kept_score[live], axis=1)[:, 0], known[live])
        last = np.where(np.isfinite(worst), np.maximum(base[live] - 2 * worst, 1e-12), np.inf)
        live = live[~passes(boxes[live, visit[live, turn]], last, dims, confidence)]
        if not len(live):
            break
        at = visit[live, turn]
        by = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[by])) + 1
        for own in np.split(live[by], edges):
            rows = leaves[visit[own[0], turn]]
            seen += len(own) * len(rows)
            scores = q[own] @ distinct[rows].T
            all_scores = np.concatenate([kept_score[own], scores], 1)
            all_rows = np.concatenate([kept_row[own], np.broadcast_to(rows, scores.shape)], 1)
            top = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
            kept_score[own] = np.take_along_axis(all_scores, top, 1)
            kept_row[own] = np.take_along_axis(all_rows, top, 1)
            # where rounding may decide which one is last, exact scores and then ids do
            near = all_scores >= kept_score[own].min(1, keepdims=True) - slack[own][:, None]
            for j in np.flatnonzero((near & (all_rows >= 0)).sum(1) > width).tolist():
                rows_j = all_rows[j, near[j] & (all_rows[j] >= 0)]
                exact = exact_scores(q[own[j]], distinct[rows_j])
                order = sorted(range(len(rows_j)), key=lambda r: (-exact[r], copies[rows_j[r]][0]))[:width]
                kept_row[own[j]], kept_score[own[j]] = rows_j[order], np.array(exact)[order]
    out_q, out_v, out_s = [], [], []
    for i in range(n):
        rows = kept_row[i][kept_row[i] >= 0]
        scores = exact_scores(q[i], distinct[rows])
        found = [(-s, int(c)) for s, r in zip(scores, rows) for c in copies[r] if c != query_ids[i]]
        found.sort()
        for s, c in found[:k]:
            out_q.append(query_ids[i])
            out_v.append(c)
            out_s.append(-s)
    return np.array(out_q, np.int64), np.array(out_v, np.int64), np.array(out_s, float), seen


def _matrix(col) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _by_dim(batch: pa.RecordBatch, most: int = 1 << 30) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the number of components, at most `most` at once."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        for lo in range(0, len(rows), most):
            yield dim, batch.take(pa.array(rows[lo : lo + most]))


@dataclass
class Index:
    """rows: dim, block, leaf, vec_id, v of every vector; splits, boxes and longest by the number of components."""

    rows: DataFrame
    splits: dict[int, Splits]
    boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    longest: dict[int, float]


def build_index(vectors: DataFrame, k: int, block_vectors: int = BLOCK_VECTORS, sample: int = SAMPLE) -> Index:
    """Vectors (vec_id, v, dim) dealt to blocks by planes in the projected space, each block to leaves, all written once.

    Of equal vectors the k + 1 smallest ids are kept: a query never needs more. Planes come from a bounded sample of
    projections; boxes are the exact bounds of all vectors of a block. The driver holds about 200 bytes for each block.
    """
    spark = vectors.sparkSession
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    kept = vectors.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k + 1).drop("__n")
    kept = materialize(kept, "vectors-kept")
    squares = F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)
    shape = {r.dim: r for r in kept.groupBy("dim").agg(F.count("*").alias("n"), F.max(squares).alias("longest")).collect()}
    longest = {d: r.longest for d, r in shape.items()}

    def lists(p: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _by_dim(batch):
                p = projected(_matrix(own.column("v")), longest[dim])
                yield pa.RecordBatch.from_arrays([own.column("dim"), own.column("vec_id"), lists(p)], ["dim", "vec_id", "p"])

    # the projections of the smallest id hashes, as many for each block
    share = {d: -(-r.n // block_vectors) for d, r in shape.items()}
    some = kept.select("dim", "vec_id", "v").mapInArrow(project, "dim int, vec_id long, p array<double>")
    some = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(sample, 64 * sum(share.values()))))
    drawn = {d: _matrix(b.column("p")) for d, b in _by_dim(some.select("dim", "p").toArrow().combine_chunks().to_batches()[0])} if shape else {}
    splits = {d: Splits(drawn.get(d, np.zeros((0, DIMENSIONS))), n) for d, n in share.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _by_dim(batch):
                p = projected(_matrix(own.column("v")), longest[dim])
                block = pa.array(splits[dim].of(p), pa.int32())
                cols = [own.column(c) for c in ("dim", "vec_id", "v")]
                yield pa.RecordBatch.from_arrays([*cols, block, lists(p)], ["dim", "vec_id", "v", "block", "p"])

    def grow(table: pa.Table) -> pa.Table:
        leaf = pa.array(leaves_of(_matrix(table.column("p"))), pa.int32())
        return table.append_column("leaf", leaf).select(["dim", "block", "leaf", "vec_id", "v", "p"])

    names = "dim int, vec_id long, v array<double>, block int, p array<double>"
    dealt = kept.select("dim", "vec_id", "v").mapInArrow(deal, names)
    leafed = dealt.groupBy("dim", "block").applyInArrow(
        grow, "dim int, block int, leaf int, vec_id long, v array<double>, p array<double>"
    )
    rows = materialize(leafed, "vector-index")
    ends = [f(F.col("p")[d]).alias(f"{n}{d}") for d in range(DIMENSIONS) for n, f in (("low", F.min), ("high", F.max))]
    found = rows.groupBy("dim", "block").agg(*ends).orderBy("dim", "block").collect()
    boxes = {
        d: tuple(
            np.array([v for r in found if r.dim == d for v in ([r.block] if name == "block" else [[r[f"{name}{i}"] for i in range(DIMENSIONS)]])])
            for name in ("block", "low", "high")
        )
        for d in shape
    }
    return Index(rows.drop("p"), splits, boxes, longest)


def _visit(index: Index, asked: DataFrame, block_queries: int, k: int, confidence: float) -> DataFrame:
    """query_id, vec_id, score from rows of asked (dim, block, query_id, q, known): queries meet the leaves of a block."""
    # a block that very many queries ask is copied for each chunk of them
    parts = asked.groupBy("dim", "block").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("parts"))
    sized = asked.join(parts, ["dim", "block"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    copied = index.rows.join(parts, ["dim", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    longest = index.longest
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x = _matrix(left.column("v"))
        found = search(
            left.column("vec_id").to_numpy(), x, left.column("leaf").to_numpy(), right.column("query_id").to_numpy(),
            _matrix(right.column("q")), right.column("known").to_numpy(), longest[x.shape[1]], k, confidence,
        )
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)

    keys = ["dim", "block", "part"]
    sides = copied.select(*keys, "leaf", "vec_id", "v").groupBy(*keys).cogroup(sized.select(*keys, "query_id", "q", "known").groupBy(*keys))
    return sides.applyInArrow(pair, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, confidence: float = CONFIDENCE,
    block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score; vectors and queries are rows of vec_id, v, dim as from `usable`.

    Each query first visits the block nearest to it. What it finds there tells, by the stopping test, which other blocks
    can still hold neighbours; only to these it is sent.
    """
    index = build_index(vectors, k, block_vectors)
    boxes, longest = index.boxes, index.longest
    at_once = max(1, BOX_CELLS // max(1, *(len(b) for b, _, _ in boxes.values()), 1))  # queries that meet all boxes

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _by_dim(batch, at_once):
                if dim not in boxes:
                    continue
                block, low, high = boxes[dim]
                near = box_distances(_matrix(own.column("v")) @ projection(dim)[:-1], low, high).argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [own.column("dim"), pa.array(block[near], pa.int32()), own.column("vec_id"), own.column("v")],
                    ["dim", "block", "query_id", "q"],
                )

    shape = "dim int, block int, query_id long, q array<double>"
    asked = materialize(queries.select("dim", "vec_id", "v").mapInArrow(home, shape), "vector-queries")
    none = F.lit(float("-inf"))
    first = materialize(_visit(index, asked.withColumn("known", none), block_queries, k, confidence), "nearest-first")
    known = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    known = known.select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(none).alias("known"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _by_dim(batch, at_once):
                block, low, high = boxes[dim]
                q = _matrix(own.column("q"))
                away = box_distances(q @ projection(dim)[:-1], low, high)
                score = own.column("known").to_numpy()
                last = np.where(np.isfinite(score), (q**2).sum(1) + longest[dim] - 2 * score, np.inf)
                go = ~passes(away, last[:, None], low.shape[1], confidence)
                go &= block[None, :] != own.column("block").to_numpy()[:, None]
                i, j = np.nonzero(go)
                for lo in range(0, len(i), 4096):
                    rows = own.take(pa.array(i[lo : lo + 4096]))
                    at = pa.array(block[j[lo : lo + 4096]], pa.int32())
                    cols = [rows.column("dim"), at, *(rows.column(c) for c in ("query_id", "q", "known"))]
                    yield pa.RecordBatch.from_arrays(cols, ["dim", "block", "query_id", "q", "known"])

    asked = asked.join(known, "query_id", "left").withColumn("known", F.coalesce("known", none))
    more = materialize(asked.mapInArrow(others, shape + ", known double"), "vector-queries")
    found = first.unionByName(_visit(index, more, block_queries, k, confidence))
    return best(found, k).select("query_id", "rank", "vec_id", "score")


def search_table(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY, k: int = K,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """The k nearest other rows of every row whose id is divisible by `every`."""
    vectors = materialize(usable(table, id_col, vector_col), "vectors")
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), k, confidence)

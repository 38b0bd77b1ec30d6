"""Models of waveform classes from sums that tasks add up: principal components, Gaussian classes, neighbour votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Classes and numbers (classes times squared length) of models that are sent to every task: 64 MB.
MOST_CLASSES, MOST_NUMBERS = 10_000, 8 << 20
#: Classified waveforms that a task compares with at once, and waveforms that are compared with them.
CHUNK, ROWS_AT_ONCE = 4096, 256
#: Axes along which space is cut into cells, and those of the cells' boxes.
CUT_AXES, BOX_AXES = 3, 8
#: Waveforms of a slice, about, and slices where they are few.
SLICE_ROWS, LEAST_SLICES = 1 << 16, 8
#: More than the share of squared lengths that rounding takes from squared distances.
ROUNDING = 1e-12


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def gram_sums(df: DataFrame, cls: str | None, wave: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of the waveforms of each class (0: of all, where cls is None).

    A task adds up its rows and hands on one row a class; the driver holds classes times squared length numbers, at most
    MOST_NUMBERS. Nulls do not count; lengths are equal.
    """
    rows = df.where(F.col(wave).isNotNull()).select(
        (F.col(cls) if cls else F.lit(0)).cast("long").alias("c"), F.col(wave).cast("array<double>").alias("w")
    )
    shape = rows.agg(F.count_distinct("c").alias("classes"), F.max(F.size("w")).alias("size"), F.min(F.size("w")).alias("least")).first()
    if not shape["classes"]:
        return {}
    if shape["size"] != shape["least"]:
        raise ValueError("waveforms of different lengths")
    size = shape["size"]
    if shape["classes"] > MOST_CLASSES or shape["classes"] * size * size > MOST_NUMBERS:
        raise ValueError("too many classes for models that every task holds")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            c, x = batch.column("c").to_numpy(), matrix(batch.column("w"))
            x = np.column_stack([np.ones(len(x)), x])
            for k in np.unique(c).tolist():
                own = x[c == k]
                held[k] = held.get(k, 0) + own.T @ own
        if held:
            sums = pa.array([v.ravel().tolist() for v in held.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), sums], ["c", "g"])

    out: dict[int, np.ndarray] = {}
    added = rows.mapInArrow(add, "c long, g array<double>").select("c", F.posexplode("g").alias("k", "v")).groupBy("c", "k").agg(F.sum("v").alias("v"))
    for r in added.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("g")).collect():
        out[r.c] = np.array([x["v"] for x in r.g]).reshape(size + 1, size + 1)
    return {k: (float(g[0, 0]), g[0, 1:], g[1:, 1:]) for k, g in sorted(out.items())}


def covariance(n: float, s: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Over n - 1."""
    return (g - np.outer(s, s) / n) / (n - 1)


def principal_components(df: DataFrame, wave: str, id_col: str, most: int = 10) -> DataFrame:
    """id, scores (array<double>): the waveforms on their first principal components, of the largest variance first.

    A component's sign is the one that makes its largest weight positive, so results do not depend on the solver.
    """
    sums = gram_sums(df, None, wave)
    if not sums or sums[0][0] < 2:
        return df.select(id_col, F.lit(None).cast("array<double>").alias("scores")).limit(0)
    n, s, g = sums[0]
    values, vectors = np.linalg.eigh(covariance(n, s, g))
    vectors = vectors[:, np.argsort(-values, kind="stable")[:most]]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    centre = s / n

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = (matrix(batch.column("w")) - centre) @ vectors
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.tolist(), pa.list_(pa.float64()))], [id_col, "scores"])

    rows = df.where(F.col(wave).isNotNull()).select(id_col, F.col(wave).cast("array<double>").alias("w"))
    return rows.mapInArrow(project, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, scores array<double>")


def force_by_shape(df: DataFrame, labelled: DataFrame, cls: str, wave: str, id_col: str, how: str, factor: float = 3.0) -> DataFrame:
    """id, distance, class of waveforms by the Gaussian of each class of labelled ones (class > 0).

    how: likelihood takes the class of the largest density (distance: minus its logarithm but for a constant); mahalanobis
    the nearest one, 0 unless that lies within factor times the root of the mean squared distance of the class's own. That
    mean is known from counts: length times (n - 1) / n. Ties go to the smaller class. Classes whose covariance has no
    inverse (too few members) are left out; without any all rows get class 0.
    """
    if how not in ("likelihood", "mahalanobis"):
        raise ValueError(f"unknown way {how}")
    shapes = []
    for c, (n, s, g) in gram_sums(labelled.where(F.col(cls) > 0), cls, wave).items():
        cov = covariance(n, s, g) if n > 1 else np.zeros_like(g)
        if np.linalg.matrix_rank(cov, hermitian=True) == len(s):
            root = np.linalg.cholesky(cov)
            shapes.append((c, s / n, np.linalg.inv(root), float(np.log(np.diag(root)).sum()), factor * np.sqrt(len(s) * (n - 1) / n)))
    shared = df.sparkSession.sparkContext.broadcast(shapes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("w"))
            best, found = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
            for c, centre, inverse, log_root, limit in shapes:
                square = (((x - centre) @ inverse.T) ** 2).sum(1)
                far = square / 2 + log_root if how == "likelihood" else np.sqrt(square)
                nearer = far < best
                best[nearer] = far[nearer]
                found[nearer] = c if how == "likelihood" else np.where(far[nearer] < limit, c, 0)
            shown = pa.array(best, pa.float64(), mask=~np.isfinite(best))
            yield pa.RecordBatch.from_arrays([batch.column(0), shown, pa.array(found)], [id_col, "distance", "class"])

    rows = df.where(F.col(wave).isNotNull()).select(id_col, F.col(wave).cast("array<double>").alias("w"))
    return rows.mapInArrow(score, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, distance double, class long")


class Cells:
    """Boxes of space with about equally many rows each: along the axes of the largest variances space is cut into strips
    again and again. Cells that hold more than `chunk` rows have several parts."""

    def __init__(self, centre: np.ndarray, axes: np.ndarray, cuts: list[np.ndarray]):
        self.centre, self.axes, self.cuts = centre, axes, cuts
        self.first, self.parts = np.zeros(1, int), np.ones(1, int)
        self.lows = self.highs = np.zeros((1, 0))

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.axes

    def of(self, z: np.ndarray) -> np.ndarray:
        """Cells of rows as `turned` gives them."""
        cell = np.zeros(len(z), np.int64)
        for axis, cuts in enumerate(self.cuts):
            cell = cell * (cuts.shape[1] + 1) + (z[:, axis, None] > cuts[cell]).sum(1)
        return cell

    def away(self, z: np.ndarray) -> np.ndarray:
        """Squared distances to the boxes of all parts, at most the true ones but for rounding."""
        far = np.zeros((len(z), len(self.lows)))
        for axis in range(self.lows.shape[1]):
            v = z[:, axis, None]
            far += np.maximum(np.maximum(self.lows[:, axis] - v, v - self.highs[:, axis]), 0) ** 2
        return far


def cells_of(rows: DataFrame, sums: tuple[float, np.ndarray, np.ndarray], chunk: int) -> Cells:
    """Cells of rows (w) of about `chunk` each; sums: as of `gram_sums`."""
    n, s, g = sums
    values, vectors = np.linalg.eigh(covariance(n, s, g))
    axes = vectors[:, np.argsort(-values, kind="stable")[:BOX_AXES]]
    levels = min(CUT_AXES, len(s))
    strips = max(1, int(np.ceil((n / chunk) ** (1 / levels) - 1e-9)))
    cells = Cells(s / n, axes, [])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = cells.turned(matrix(batch.column("w")))
            yield pa.RecordBatch.from_arrays([pa.array(cells.of(z)), pa.array(z[:, len(cells.cuts)])], ["cell", "v"])

    for level in range(levels if strips > 1 else 0):
        # results do not depend on where space is cut, so the borders need not be exact
        border = F.percentile_approx("v", [k / strips for k in range(1, strips)], 2000)
        cuts = np.full((strips**level, strips - 1), np.inf)
        for r in rows.mapInArrow(placed, "cell long, v double").groupBy("cell").agg(border.alias("b")).collect():
            cuts[r.cell] = r.b
        cells.cuts = [*cells.cuts, cuts]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = cells.turned(matrix(batch.column("w")))
            order = np.argsort(cell := cells.of(z), kind="stable")
            own, first, many = np.unique(cell[order], return_index=True, return_counts=True)
            if len(own):
                low, high = (f.reduceat(z[order], first, 0).tolist() for f in (np.minimum, np.maximum))
                cols = [pa.array(own), pa.array(many), *(pa.array(v, pa.list_(pa.float64())) for v in (low, high))]
                yield pa.RecordBatch.from_arrays(cols, ["cell", "n", "lo", "hi"])

    edge = F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "e")
    found = rows.mapInArrow(bounds, "cell long, n long, lo array<double>, hi array<double>").select("cell", "n", edge)
    found = found.groupBy("cell", "axis").agg(F.sum("n").alias("n"), F.min("e.lo").alias("lo"), F.max("e.hi").alias("hi")).orderBy("cell", "axis").collect()
    own = np.array([r.cell for r in found[:: axes.shape[1]]])
    parts = -(-np.array([r.n for r in found[:: axes.shape[1]]]) // chunk)
    cells.first, cells.parts = np.zeros(strips ** len(cells.cuts), int), np.ones(strips ** len(cells.cuts), int)
    cells.first[own], cells.parts[own] = np.cumsum(parts) - parts, parts
    cells.lows, cells.highs = (np.repeat(np.array([r[c] for r in found]).reshape(len(own), -1), parts, 0) for c in ("lo", "hi"))
    return cells


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows by products, and for each row of x how far these may be off."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    return xx[:, None] + yy - 2 * (x @ y.T), ROUNDING * (xx + yy.max())


def force_by_neighbours(
    df: DataFrame, labelled: DataFrame, cls: str, wave: str, id_col: str, k: int = 10, least: int = 10, factor: float = 3.0, chunk: int = CHUNK
) -> DataFrame:
    """id, votes, class: the commonest class among the k nearest labelled waveforms that lie within factor times the root of
    their summed variances (over n), 0 where fewer than `least` of them agree; ties go to the smaller class.

    Labelled waveforms are dealt to boxes of space, in parts of about `chunk`. A waveform first meets a part of the nearest
    box, whose k-th distance (or the limit) bounds its own; then every part whose box is within that bound, and only its k
    nearest of each are handed on. Distances of products only leave out what is surely too far. Ties of distance go to the
    smaller class.
    """
    rows = df.where(F.col(wave).isNotNull()).select(F.col(id_col).alias("id"), F.col(wave).cast("array<double>").alias("w"))
    sums = gram_sums(labelled, None, wave)
    n, s, g = sums[0] if sums else (0.0, np.zeros(1), np.zeros((1, 1)))
    reach = factor * float(np.sqrt(np.trace(g / n - np.outer(s, s) / n / n))) if n else 0.0
    if not reach > 0:  # nothing is nearer
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("votes"), F.lit(0).cast("long").alias("class"))
    apart = [F.col(id_col).alias("own_id")] if id_col in labelled.columns else []
    own = labelled.where(F.col(wave).isNotNull()).select(F.col(cls).cast("long").alias("c"), F.col(wave).cast("array<double>").alias("w"), *apart)
    own = own.select("c", "w", F.xxhash64(*own.columns).alias("h"))
    cells = cells_of(own.select("w"), sums[0], chunk)
    limit = reach * reach * (1 + ROUNDING)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells.of(cells.turned(matrix(batch.column("w"))))
            place = batch.column("h").to_numpy() % cells.parts[cell]
            part = (cells.first[cell] + place).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("w"), pa.array(part), pa.array(place == 0)], ["c", "w", "part", "leads"])

    kind = df.schema[id_col].dataType.simpleString()

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, part = matrix(batch.column("w")), [np.zeros(0, int)]
            for lo in range(0, len(x), ROWS_AT_ONCE):
                part.append(cells.away(cells.turned(x[lo : lo + ROWS_AT_ONCE])).argmin(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(part).astype(np.int32))], [*batch.schema.names, "part"])

    def bounded(left: pa.Table, right: pa.Table) -> pa.Table:
        """The parts that each waveform of a group must meet, by its k-th distance to the group's labelled ones."""
        bound, met, ends = [np.zeros(0)], [np.zeros(0, np.int32)], [np.zeros(1, int)]
        if left.num_rows:
            x = matrix(left.column("w").combine_chunks()) - cells.centre
            y = matrix(right.column("w").combine_chunks()) - cells.centre if right.num_rows else np.zeros((0, x.shape[1]))
            for lo in range(0, len(x), ROWS_AT_ONCE):
                q = x[lo : lo + ROWS_AT_ONCE]
                b = np.full(len(q), limit)
                if len(y) >= k:
                    d, off = squares(q, y)
                    b = np.minimum(np.maximum(np.partition(d, k - 1, 1)[:, k - 1], 0) + 2 * off, limit)
                    b = np.where(np.isfinite(off), b, np.nan)
                i, j = np.nonzero(cells.away(q @ cells.axes) <= (b + ROUNDING * (q * q).sum(1))[:, None] * (1 + ROUNDING))
                bound.append(b)
                met.append(j.astype(np.int32))
                ends.append(np.searchsorted(i, np.arange(len(q)), "right") + ends[-1][-1])
        parts = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(met)))
        return pa.table({"id": left.column("id"), "w": left.column("w"), "bound": pa.array(np.concatenate(bound)), "parts": parts})

    id_type = rows.schema["id"].dataType

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        ids: list = []
        far: list = []
        classes: list = []
        if left.num_rows and right.num_rows:
            x, y = (matrix(t.column("w").combine_chunks()) for t in (left, right))
            c, names, bound = right.column("c").to_numpy(), left.column("id").to_pylist(), left.column("bound").to_numpy()
            for lo in range(0, len(x), ROWS_AT_ONCE):
                q = x[lo : lo + ROWS_AT_ONCE]
                d, off = squares(q - cells.centre, y - cells.centre)
                edge = bound[lo : lo + ROWS_AT_ONCE] + off
                many = np.flatnonzero((d <= edge[:, None]).sum(1) > 4 * k)
                if len(many) and len(y) > k:  # those beyond the k-th distance are out
                    edge[many] = np.minimum(edge[many], np.partition(d[many], k - 1, 1)[:, k - 1] + 2 * off[many])
                i, j = np.nonzero(d <= edge[:, None])
                d = np.sqrt(((q[i] - y[j]) ** 2).sum(1))
                i, j, d = i[d < reach], j[d < reach], d[d < reach]
                order = np.lexsort((c[j], d, i))
                i, j, d = i[order], j[order], d[order]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                ids += [names[lo + r] for r in i[kept].tolist()]
                far += d[kept].tolist()
                classes += c[j[kept]].tolist()
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.table({"id": pa.array(ids, to_arrow_type(id_type)), "d": pa.array(far, pa.float64()), "c": pa.array(classes, pa.int64())})

    # a part's waveforms are dealt on, so that no group holds them all
    slices = max(LEAST_SLICES, -(-rows.count() // SLICE_ROWS)) if len(cells.lows) > 1 else LEAST_SLICES * 8
    sliced = lambda t: t.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    dealt = own.mapInArrow(tagged, "c long, w array<double>, part int, leads boolean").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    if len(cells.lows) > 1:
        home = sliced(rows.mapInArrow(homes, f"id {kind}, w array<double>, part int"))
        # the parts of a cell are alike: the first one tells a bound
        asked = home.groupBy("part", "slice").cogroup(dealt.where("leads").groupBy("part", "slice")).applyInArrow(bounded, f"id {kind}, w array<double>, bound double, parts array<int>")
        asked = sliced(asked.select("id", "w", "bound", F.explode("parts").alias("part")))
    else:
        asked = sliced(rows.select("id", "w", F.lit(limit).alias("bound"), F.lit(0).alias("part")))
    met = asked.groupBy("part", "slice").cogroup(dealt.groupBy("part", "slice")).applyInArrow(near, f"id {kind}, d double, c long")
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "c"))
    votes = met.withColumn("place", place).where(F.col("place") <= k).groupBy("id", "c").agg(F.count("*").alias("n"))
    won = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("c")).alias("c"))).alias("b"))
    told = rows.select("id").join(won, "id", "left")
    n_votes = F.coalesce("b.n", F.lit(0))
    return told.select(F.col("id").alias(id_col), n_votes.alias("votes"), F.when(n_votes >= least, -F.col("b.c")).otherwise(F.lit(0)).alias("class"))

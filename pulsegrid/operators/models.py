"""Distribution checks and models across channels, from bounded samples or from sums that tasks add up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import stats
from .carry import sorted_groups
from .resampling import draw_sums

#: Values that a normality test sees of a group.
SAMPLE = 5000


def _lead(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def normality_checks(df: DataFrame, keys: list[str], value: str, row_id: list[str], sample: int = SAMPLE) -> DataFrame:
    """keys, n, n_nonpositive, skew, log_skew, p, p_log, scale: Shapiro-Wilk p and skewness of values and of the logarithms
    of the positive ones, and the scale to analyse them on.

    Scales: insufficient (fewer than three values), raw_only (some are not positive), log where it is nearer to normal by
    either measure, else raw. The tests see the `sample` values of the smallest row hashes; counts are of all. Nulls and
    values that are not finite do not count.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*keys, x.alias("__v"), F.xxhash64(*row_id).alias("__h"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("__v") <= 0).alias("n_nonpositive"))

    def drawn(rows: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("__h", "__v"))
        return rows.withColumn("__k", place).where(F.col("__k") <= sample).groupBy(*keys).agg(F.collect_list("__v").alias(name))

    logs = rows.where("__v > 0").withColumn("__v", F.log10("__v"))
    both = counts.join(drawn(rows, "__raw"), keys).join(drawn(logs, "__log"), keys, "left")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("skew", "log_skew", "p", "p_log", "scale")}
            n, other = (batch.column(c).to_pylist() for c in ("n", "n_nonpositive"))
            for k in range(batch.num_rows):
                raw, log = (np.array(batch.column(c)[k].as_py() or [], float) for c in ("__raw", "__log"))
                skews = [stats.skewness(v) if len(v) >= 3 else np.nan for v in (raw, log)]
                ps = [stats.shapiro_wilk(v)[1] for v in (raw, log)]
                nearer = np.isfinite(ps[1]) and (not ps[1] <= ps[0] or abs(skews[1]) < abs(skews[0]))
                scale = "insufficient" if n[k] < 3 else "raw_only" if other[k] else "log" if nearer else "raw"
                for c, v in zip(cols, (*skews, *ps, scale)):
                    cols[c].append(v if isinstance(v, str) or v == v else None)
            kept = [batch.column(c) for c in (*keys, "n", "n_nonpositive")]
            more = [pa.array(v, pa.string() if c == "scale" else pa.float64()) for c, v in cols.items()]
            yield pa.RecordBatch.from_arrays([*kept, *more], [*keys, "n", "n_nonpositive", *cols])

    return both.mapInArrow(
        test, _lead(df, keys) + ", n long, n_nonpositive long, skew double, log_skew double, p double, p_log double, scale string"
    )


def quantile_points(df: DataFrame, keys: list[str], value: str, log: bool = False) -> DataFrame:
    """keys, place, theoretical, ordered: each value beside the normal quantile of its place's median; groups of fewer than
    three values have no rows. With log the logarithms of positive values."""
    x = F.when(F.col(value) > 0, F.log10(value)) if log else F.col(value).cast("double")
    by = Window.partitionBy(*keys)
    rows = df.select(*keys, x.alias("ordered")).where("ordered IS NOT NULL")
    rows = rows.withColumn("place", F.row_number().over(by.orderBy("ordered"))).withColumn("__n", F.count("*").over(by)).where("__n >= 3")
    n, i = F.col("__n"), F.col("place")
    last = F.pow(F.lit(0.5), 1 / n)
    middle = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))

    @F.arrow_udf("double")
    def quantile(p: pa.Array) -> pa.Array:
        return pa.array(stats.normal_quantile(p.to_numpy()))

    return rows.select(*keys, "place", quantile(middle).alias("theoretical"), "ordered")


def _products(terms: list[str]) -> list[tuple[str, str]]:
    """Pairs of columns whose products are summed: one (the intercept) and the terms with one another and with y."""
    columns = ["1", *terms]
    return [(a, b) for i, a in enumerate(columns) for b in columns[i:]] + [(a, "y") for a in columns] + [("y", "y")]


def _sums(values: dict[tuple[str, str], np.ndarray], terms: list[str]) -> tuple[np.ndarray, ...]:
    columns = ["1", *terms]
    get = lambda a, b: values[a, b] if (a, b) in values else values[b, a]
    sxx = np.stack([np.stack([get(a, b) for b in columns], -1) for a in columns], -2)
    sxy = np.stack([values[a, "y"] for a in columns], -1)
    return sxx, sxy, values["y", "y"]


FIELDS = (
    "term string, estimate double, lo double, hi double, p double, group_variance double, n_obs long, n_groups long, converged boolean, method string"
)


def random_intercept(df: DataFrame, keys: list[str], y: str, terms: list[str], group: str) -> DataFrame:
    """A row for each term (and the intercept) of y on terms with a random intercept for each group: estimate, 95 %
    interval, p, variance between groups; restricted maximum likelihood.

    Tasks add up products; what is solved is one row of sums for each group. keys with fewer than two groups, or whose
    terms are not independent, have no rows; rows with a null do not count.
    """
    rows = df.dropna(subset=[y, *terms, group])
    pairs = _products(terms)
    col = lambda c: F.lit(1.0) if c == "1" else F.col(y if c == "y" else c).cast("double")
    sums = rows.groupBy(*keys, group).agg(*[F.sum(col(a) * col(b)).alias(f"__{k}") for k, (a, b) in enumerate(pairs)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in sorted_groups(batches, keys):
            out: list[tuple] = []
            for a, b in zip(cuts, cuts[1:]):
                values = {p: table.column(f"__{k}").to_numpy()[a:b] for k, p in enumerate(pairs)}
                sxx, sxy, syy = _sums(values, terms)
                found = stats.random_intercept(sxx[:, 0, 0], sxx[:, 0, :], sxx, sxy[:, 0], sxy, syy) if b - a > 1 else None
                if found is None:
                    continue
                for k, term in enumerate(["intercept", *terms]):
                    e, se = float(found["beta"][k]), float(found["se"][k])
                    p = float(2 * stats.normal_cdf(np.array(-abs(e) / se))) if se > 0 else None
                    edge = float(stats.normal_quantile(np.array(0.975))) * se
                    out.append((a, term, e, e - edge, e + edge, p, found["group_variance"], int(sxx[:, 0, 0].sum()), b - a, found["converged"], "random_intercept"))
            yield from _rows(table, keys, out)

    return sums.repartition(*keys).sortWithinPartitions(*keys, group).mapInArrow(solve, f"{_lead(df, keys)}, {FIELDS}")


def _rows(table: pa.Table, keys: list[str], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of keys (of the row that each of rows names first) and FIELDS."""
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
    out = table.select(keys).take(pa.array([r[0] for r in rows], pa.int64()))
    for k, field in enumerate(FIELDS.split(", ")):
        name, kind = field.split()
        out = out.append_column(name, pa.array([r[k + 1] for r in rows], kinds[kind]))
    yield from out.combine_chunks().to_batches()


def fixed_groups(df: DataFrame, keys: list[str], y: str, terms: list[str], group: str, row_id: list[str], n: int = 200, seed: int = 0) -> DataFrame:
    """The same rows by least squares with a level for each group instead, and intervals over resamples of rows.

    The intercept is the level of the group that comes first. Levels are eliminated by each group's own sums: a task adds
    what is left of its groups up and hands on one row for each key, with an entry for each resample; so no matrix and no
    task grows with the number of groups. A resample without the first group, or without a solution, is left out.
    """
    rows = df.dropna(subset=[y, *terms, group])
    pairs = _products(terms)
    col = lambda c: F.lit(1.0) if c == "1" else F.col(y if c == "y" else c).cast("double")
    products = {f"__{k}": col(a) * col(b) for k, (a, b) in enumerate(pairs)}
    names = [*keys, group, *products]
    # the rows as they are come first, then the resamples
    sums = rows.groupBy(*keys, group).agg(*[F.sum(c).alias(x) for x, c in products.items()]).select(*keys, group, *[F.array(x).alias(x) for x in products])
    if n:
        drawn = draw_sums(rows, [*keys, group], products, row_id, n, seed).select(*keys, group, *[F.col(x).alias(f"d{x}") for x in products])
        sums = sums.join(drawn, [*keys, group]).select(*keys, group, *[F.concat(x, f"d{x}").alias(x) for x in products])
    m, size = len(terms), n + 1

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each key the eliminated sums of its groups, and the sums of the first of them; a slice of groups at once."""
        held: dict[tuple, list] = {}
        step = max(1, (1 << 18) // size)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                own = batch.slice(lo, step)
                values = {p: own.column(f"__{k}").flatten().to_numpy().reshape(-1, size) for k, p in enumerate(pairs)}
                sxx, sxy, _ = _sums(values, terms)
                count = sxx[..., 0, 0]
                safe = np.where(count > 0, count, 1)
                within = sxx[..., 1:, 1:] - sxx[..., 0, 1:, None] * sxx[..., 0, None, 1:] / safe[..., None, None]
                against = sxy[..., 1:] - sxx[..., 0, 1:] * (sxy[..., 0] / safe)[..., None]
                within[count <= 0], against[count <= 0] = 0.0, 0.0
                found = own.select(keys).to_pylist()
                of: dict[tuple, list[int]] = {}
                for i, r in enumerate(found):
                    of.setdefault(tuple(r[k] for k in keys), []).append(i)
                named = own.column(group).to_pylist()
                for key, at in of.items():
                    f = min(at, key=lambda i: named[i])
                    level = np.concatenate([sxx[f, :, 0, :], sxy[f, :, :1]], 1)
                    more = [named[f], level, within[at].sum(0), against[at].sum(0), len(at), int(count[at, 0].sum())]
                    if key in held:
                        was = held[key]
                        head = was[:2] if was[0] <= more[0] else more[:2]
                        more = [*head, *[a + b for a, b in zip(was[2:], more[2:])]]
                    held[key] = more
        if held:
            lists = lambda k: pa.array([v[k].ravel().tolist() for v in held.values()], pa.list_(pa.float64()))
            columns = [pa.array([k[i] for k in held], key_types[i]) for i in range(len(keys))]
            columns += [pa.array([v[0] for v in held.values()], group_type), lists(1), lists(2), lists(3)]
            columns += [pa.array([v[k] for v in held.values()], pa.int64()) for k in (4, 5)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "__group", "__level", "__within", "__against", "__groups", "__obs"])

    key_types = [to_arrow_type(df.schema[k].dataType) for k in keys]
    group_type = to_arrow_type(df.schema[group].dataType)
    kept = f"__group {df.schema[group].dataType.simpleString()}, __level array<double>, __within array<double>, __against array<double>, __groups long, __obs long"
    parts = sums.select(*names).mapInArrow(reduce, f"{_lead(df, keys)}, {kept}")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in sorted_groups(batches, keys):
            out: list[tuple] = []
            get = lambda c, *shape: pa.concat_arrays(table.column(c).chunks).flatten().to_numpy().reshape(-1, size, *shape)
            levels, within, against = get("__level", m + 2), get("__within", m, m), get("__against", m)
            groups, obs = table.column("__groups").to_numpy(), table.column("__obs").to_numpy()
            for a, b in zip(cuts, cuts[1:]):
                first, total, other = levels[a], within[a:b].sum(0), against[a:b].sum(0)  # sorted by the first group
                found = {}
                for d in range(size):
                    count = first[d, 0]
                    if count <= 0 or np.linalg.matrix_rank(total[d]) < m:
                        continue
                    slopes = np.linalg.solve(total[d], other[d])
                    found[d] = np.append((first[d, -1] - first[d, 1 : m + 1] @ slopes) / count, slopes)
                if groups[a:b].sum() < 2 or 0 not in found:
                    continue
                draws = np.array([v for d, v in found.items() if d > 0])
                for k, term in enumerate(["intercept", *terms]):
                    lo, hi = np.percentile(draws[:, k], [2.5, 97.5]).tolist() if len(draws) else (None, None)
                    out.append((a, term, float(found[0][k]), lo, hi, None, None, int(obs[a:b].sum()), int(groups[a:b].sum()), True, "fixed_groups"))
            yield from _rows(table, keys, out)

    return parts.repartition(*keys).sortWithinPartitions(*keys, "__group").mapInArrow(solve, f"{_lead(df, keys)}, {FIELDS}")

"""Greedy rules along a channel, worked out in time segments whose state is carried from one to the next.

A channel's rows are dealt to segments of time, so a channel of any length is many groups. What a segment does depends on
what came before only through one number, so each segment first gives out how that number leaves it for each way in which
it may come in. These short rows are chained channel by channel, and then every segment knows its own beginning.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dead times in a segment.
SEGMENT_DEAD_TIMES = 4096


def borders(table: pa.Table, names: list[str]) -> np.ndarray:
    """Row numbers at which another group begins, the first row's not; nulls are equal."""
    n = table.num_rows
    fresh = np.zeros(max(0, n - 1), bool)
    for name in names:
        col = table.column(name).combine_chunks()
        a, b = col.slice(0, n - 1), col.slice(1)
        fresh |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        fresh |= pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(fresh) + 1


def sorted_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by names as tables of whole groups, with the borders of these (first and last included)."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        cuts = borders(now, names)
        if len(cuts):
            yield now.slice(0, int(cuts[-1])).combine_chunks(), [0, *cuts.tolist()]
            held = now.slice(int(cuts[-1]))
        else:
            held = now
    if held is not None:
        yield held.combine_chunks(), [0, held.num_rows]


def following(times: np.ndarray, until: np.ndarray) -> np.ndarray:
    """For each row the first one at or behind the end of its dead time; the number of rows where there is none."""
    return np.maximum(np.searchsorted(times, until, "left"), np.arange(len(times)) + 1)


def ways_through(times: np.ndarray, until: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """How dead time leaves a segment: (t, out) such that with dead time until b the first t at or behind b tells its out;
    where there is none, b itself leaves. An earlier row's dead time ends at most `most` behind the first row."""
    n = len(times)
    end = np.where((hop := following(times, until)) < n, hop, np.arange(n))
    while not np.array_equal(further := end[end], end):
        end = further
    some = min(n, int(np.searchsorted(times, times[0] + most, "left")) + 1)
    out = until[end[:some]]
    last = np.append(np.flatnonzero(out[1:] != out[:-1]), some - 1)
    return times[last], out[last]


def refractory(
    df: DataFrame, keys: list[str], t: str, tie: str, least: int | float, segment: int | float | None = None, until: str | None = None
) -> DataFrame:
    """keys, t, tie (and until) of the rows kept greedily: each at least `least` after the last kept one of its channel.

    until: a column with the end of a row's own dead time instead, not before its time and at most `least` behind it.
    segment: the time that a segment spans, at least `least`. Rows without a time are left out; equal times go by tie;
    null keys are a channel of their own.
    """
    span = segment or SEGMENT_DEAD_TIMES * least
    if span < least:
        raise ValueError("a segment spans at least one dead time")
    names, part = [*keys, t, tie, *([until] if until else [])], [*keys, "__part"]

    def ends(table: pa.Table) -> np.ndarray:
        return table.column(until).to_numpy() if until else table.column(t).to_numpy() + least

    kind = df.schema[t].dataType.simpleString()
    rows = df.select(*names).where(F.col(t).isNotNull()).withColumn("__part", F.floor(F.col(t) / F.lit(span)).cast("long"))
    placed = rows.repartition(*part)
    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in sorted_groups(batches, part):
            times, dead = table.column(t).to_numpy(), ends(table)
            found = [ways_through(times[a:b], dead[a:b], least) for a, b in zip(cuts, cuts[1:])]
            first = table.select(part).take(pa.array(cuts[:-1])).combine_chunks()
            for i, name in enumerate(("__t", "__out")):
                first = first.append_column(name, pa.array([f[i].tolist() for f in found], pa.list_(table.schema.field(t).type)))
            yield from first.to_batches()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in sorted_groups(batches, keys):
            at, out = table.column("__t").to_pylist(), table.column("__out").to_pylist()
            entry: list = []
            for a, b in zip(cuts, cuts[1:]):
                dead = None
                for i in range(a, b):
                    entry.append(dead)
                    k = 0 if dead is None else bisect_left(at[i], dead)
                    dead = out[i][k] if k < len(out[i]) else dead
            shown = table.select(part).append_column("__dead", pa.array(entry, table.schema.field("__t").type.value_type))
            yield from shown.to_batches()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in sorted_groups(batches, part):
            times, dead, own_end = table.column(t).to_numpy(), table.column("__dead").to_pylist(), ends(table)
            kept = []
            for a, b in zip(cuts, cuts[1:]):
                own = times[a:b]
                hop = following(own, own_end[a:b]).tolist()
                i = 0 if dead[a] is None else int(np.searchsorted(own, dead[a], "left"))
                while i < b - a:
                    kept.append(a + i)
                    i = hop[i]
            yield from table.select(names).take(pa.array(kept, pa.int64())).to_batches()

    told = placed.sortWithinPartitions(*part, t, tie).mapInArrow(
        ways, f"{key_types}, `__part` long, `__t` array<{kind}>, `__out` array<{kind}>"
    )
    entries = told.repartition(*keys).sortWithinPartitions(*part).mapInArrow(chain, f"{key_types}, `__part` long, `__dead` {kind}")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in part]
    joined = placed.alias("r").join(entries.alias("e"), same).select(*[F.col(f"r.{c}") for c in (*names, "__part")], "__dead")
    dealt = joined.repartition(*part).sortWithinPartitions(*part, t, tie)
    return dealt.mapInArrow(keep, rows.select(*names).schema)

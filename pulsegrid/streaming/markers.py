"""Streaming forms of the sequence operators: trains of markers by merge gap, and open pulses across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trains(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """start, end, n of each channel's trains: markers with less than `gap` between neighbours, late ones up to `late`.

    The same plan runs over tables; on a stream a train is given out once the watermark has passed it.
    """
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = marked.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("end"))
    return grouped.select(key, F.col("w.start").alias("start"), "end", "n")


PULSE = "channel string, start_sample long, end_sample long, max_ua double"
STATE = "next_sample long, start long, max_ua double"


def pulses(samples: DataFrame, gap: int, idle_ms: int | None = None) -> DataFrame:
    """Pulses of stim samples (channel, sample, ua), nonzero runs joined across micro-batches.

    The state of a channel is its open pulse; samples arrive in order within a channel. A pulse is given out when a
    sample follows more than `gap` later, or a zero sample closes it; with idle_ms also when nothing has come from its
    channel for so long, and the channel's state goes with it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        after, start, top = state.get if state.exists else (-1, -1, 0.0)
        out = []
        if state.hasTimedOut:
            if start >= 0:
                out.append((key[0], start, after, top))
            state.remove()
        else:
            for frame in frames:
                for sample, ua in frame.sort_values("sample")[["sample", "ua"]].itertuples(index=False):
                    if start >= 0 and (ua == 0 or sample - after > gap):
                        out.append((key[0], start, after, top))
                        start, top = -1, 0.0
                    if ua != 0:
                        start, top, after = (sample if start < 0 else start), max(top, abs(ua)), sample + 1
            state.update((int(after), int(start), float(top)))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["channel", "start_sample", "end_sample", "max_ua"])

    wait = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return samples.groupBy("channel").applyInPandasWithState(step, PULSE, STATE, "append", wait)

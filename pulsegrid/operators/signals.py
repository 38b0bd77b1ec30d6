"""Array work on epochs and channels: filtering, band power and recovery by grouped functions.

Epochs are gathered from the blocks that they need. Whole-channel work goes by segments of a set number of blocks, so no
group grows with the length of a recording. Each kernel is a small function of arrays, see functions.dsp.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp


#: Blocks of a segment: five minutes at 30 kHz.
SEGMENT_BLOCKS = 70_313


def channel_arrays(blocks: DataFrame, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """run_id, channel, segment, x: the samples of each segment of a channel in order, from rows of block_no, samples."""
    segment = F.floor(F.col("block_no") / segment_blocks).alias("segment")
    gathered = blocks.groupBy("run_id", "channel", segment).agg(F.sort_array(F.collect_list(F.struct("block_no", "samples"))).alias("b"))
    return gathered.select("run_id", "channel", "segment", F.flatten(F.transform("b", lambda r: r["samples"])).alias("x"))


def epochs(blocks: DataFrame, events: DataFrame, lo: int, hi: int, pad: int = 0, block_size: int = 128) -> DataFrame:
    """run_id, channel, event_number, zero, x: samples lo-pad..hi+pad around each event (run_id, event_number, onset_sample).

    Each event names the blocks that it needs, so only those are joined and a group is one epoch, however long the
    recording. Padding that leaves the recording is missing from x (zero tells where the event is); events whose core
    lo..hi leaves it, or that lack a block, are dropped.
    """
    first, last = F.col("onset_sample") + lo - pad, F.col("onset_sample") + hi + pad
    need = events.select(
        "run_id", "event_number", "onset_sample",
        F.explode(F.sequence(F.greatest(F.floor(first / block_size), F.lit(0)), F.floor((last - 1) / block_size))).alias("block_no"),
    )
    found = (
        blocks.select("run_id", "channel", "block_no", "samples")
        .join(need, ["run_id", "block_no"])
        .groupBy("run_id", "channel", "event_number", "onset_sample")
        .agg(F.sort_array(F.collect_list(F.struct("block_no", "samples"))).alias("b"))
    )
    x = F.flatten(F.transform("b", lambda r: r["samples"]))
    found = found.withColumn("x", x).withColumn("start", F.col("b")[0]["block_no"] * block_size).withColumn("stop", F.col("start") + F.size("x"))
    whole = F.element_at("b", -1)["block_no"] - F.col("b")[0]["block_no"] + 1 == F.size("b")
    inside = (F.col("start") <= F.col("onset_sample") + lo) & (F.col("stop") >= F.col("onset_sample") + hi)
    begin = F.greatest(first, F.col("start"))
    return found.where(whole & inside).select(
        "run_id", "channel", "event_number", (F.col("onset_sample") - begin).cast("int").alias("zero"),
        F.slice("x", (begin - F.col("start") + 1).cast("int"), (F.least(last, F.col("stop")) - begin).cast("int")).alias("x"),
    )


def per_batch(arrays: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel's rows for each batch of rows of arrays (epochs or channels)."""

    def run(batches):
        for batch in batches:
            if len(batch):
                got = kernel(batch)
                if len(got):
                    yield got

    return arrays.mapInPandas(run, schema)


def per_row(arrays: DataFrame, kernel: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """kernel's rows, in the order of schema, for each row of arrays (epochs or channels); a batch's rows go out together."""
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batch: pd.DataFrame) -> pd.DataFrame:
        columns = [batch[c].tolist() for c in batch.columns]
        return pd.DataFrame([out for row in zip(*columns) for out in kernel(dict(zip(batch.columns, row)))], columns=names)

    return per_batch(arrays, rows, schema)


#: Numbers that a batch of epochs is filtered in at once.
NUMBERS_AT_ONCE = 1 << 21


def padded(batch: pd.DataFrame, before: int, behind: int):
    """Rows of a batch and their epochs as rows of a matrix, each with `before` samples in front of its event and `behind`
    from there on, reflected where the recording ends; a slice of them at once."""
    step = max(1, NUMBERS_AT_ONCE // (before + behind))
    for lo in range(0, len(batch), step):
        own, rows = batch.iloc[lo : lo + step], []
        for x, zero in zip(own["x"], own["zero"]):
            x, lacking = np.asarray(x, float), (before - int(zero), behind - (len(x) - int(zero)))
            rows.append(np.pad(x, lacking, mode="reflect") if any(lacking) else x)
        yield own, np.stack(rows)


TRIAL_POWER = "run_id string, channel string, event_number long, band string, win string, power_uv2 double"


def event_power(
    blocks: DataFrame, events: DataFrame, rate_hz: float, bands: dict[str, tuple[float, float]], windows: dict[str, tuple[float, float]],
    blank_ms: tuple[float, float], pad_ms: float, order: int = 4, block_size: int = 128,
) -> DataFrame:
    """Mean squares of each band and window (half-open, ms) around each event.

    Epochs are padded (reflected where the recording ends), blanked around the event, filtered and cut to the windows.
    """
    at = lambda ms: dsp.half_even(ms * rate_hz / 1000)
    spans = [*windows.values(), blank_ms]
    lo, hi, pad = min(at(a) for a, _ in spans), max(at(b) for _, b in spans), at(pad_ms)
    names = [c.split()[0] for c in TRIAL_POWER.split(", ")]

    def kernel(batch: pd.DataFrame) -> pd.DataFrame:
        out, zero = [], pad - lo
        for own, x in padded(batch, zero, pad + hi):
            y = np.stack([dsp.blank(r, [(zero + at(blank_ms[0]), zero + at(blank_ms[1]))]) for r in x])
            for band, (f1, f2) in bands.items():
                z = dsp.sosfiltfilt(dsp.butter_sos(order, f1, f2, rate_hz), y)
                for name, (a, b) in windows.items():
                    power = (z[:, zero + at(a) : zero + at(b)] ** 2).mean(1)
                    out.append(own[["run_id", "channel", "event_number"]].assign(band=band, win=name, power_uv2=power))
        return pd.concat(out)[names]

    return per_batch(epochs(blocks, events, lo, hi, pad, block_size), kernel, TRIAL_POWER)


RECOVERY = "run_id string, channel string, event_number long, baseline_sd_uv double, threshold_uv double, recovery_ms double, censored boolean"


def event_recovery(
    blocks: DataFrame, events: DataFrame, rate_hz: float, baseline_ms: tuple[float, float], span_ms: float, quiet_ms: float, k: float,
    floor_uv: float, block_size: int = 128,
) -> DataFrame:
    """Time after each event from which the channel stays within its threshold for quiet_ms.

    The threshold is k baseline deviations (n - 1), at least floor_uv; an epoch that never settles is censored at its end.
    """
    at = lambda ms: dsp.half_even(ms * rate_hz / 1000)
    quiet = max(1, at(quiet_ms))

    def kernel(row: dict) -> list[tuple]:
        x, zero = np.asarray(row["x"], float), int(row["zero"])
        base = x[: zero + at(baseline_ms[1])]
        sd = float(base.std(ddof=1)) if len(base) > 1 else 0.0
        limit = max(k * sd, floor_uv)
        above = np.abs(x[zero:] - base.mean()) > limit
        total = np.concatenate([[0], np.cumsum(above)])
        calm = np.flatnonzero(total[quiet:] == total[:-quiet])
        if len(calm):
            before = np.flatnonzero(above[: calm[0]])
            time, censored = (before[-1] + 1 if len(before) else 0) / rate_hz * 1000, False
        else:
            time, censored = len(above) / rate_hz * 1000, True
        return [(row["run_id"], row["channel"], row["event_number"], sd, limit, float(time), censored)]

    return per_row(epochs(blocks, events, at(baseline_ms[0]), at(span_ms), 0, block_size), kernel, RECOVERY)


def spectra(arrays: DataFrame, rate_hz: float, nperseg: int, bands: dict[str, tuple[float, float]], comb_hz: float | None = None) -> DataFrame:
    """run_id, channel, segment, band, power_uv2 from Welch spectra: a band's power, or with a comb the mean density of its
    bins that are not near a harmonic."""

    def kernel(row: dict) -> list[tuple]:
        f, p = dsp.welch(np.asarray(row["x"], float), rate_hz, nperseg)
        value = lambda lo, hi: dsp.band_mean(f, p, lo, hi, comb_hz) if comb_hz else dsp.band_power(f, p, lo, hi)
        return [(row["run_id"], row["channel"], row["segment"], b, value(lo, hi) if len(f) else None) for b, (lo, hi) in bands.items()]

    return per_row(arrays, kernel, "run_id string, channel string, segment long, band string, power_uv2 double")

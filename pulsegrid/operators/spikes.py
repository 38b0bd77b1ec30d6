"""Spike detection by amplitude on channels of any length: the same spikes whatever the length of the segments.

A channel is filtered in segments that overlap by enough for the filter to settle, so a sample's value does not depend on
where segments begin. Noise levels are medians over the whole channel, counted on rounded values; dead times are carried
from segment to segment (see carry). Waveforms are cut from the overlap where a spike lies near a border.

Filters are Butterworth band passes run forth and back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from .carry import refractory
from .sequence import drop_close_pairs


@dataclass(frozen=True)
class Detection:
    """rate_hz; bands in Hz in which spikes are detected and kept; filter order; samples of a waveform before and behind
    its peak and of dead time; noise levels that a spike exceeds and that an artifact exceeds; neg, pos or both; points put
    into each step before a waveform is aligned (1: none); the unit to which amplitudes are rounded for medians."""

    rate_hz: float
    detect: tuple[float, float] = (300.0, 3000.0)
    keep: tuple[float, float] = (300.0, 3000.0)
    order: int = 2
    before: int = 20
    behind: int = 44
    dead: int = 45
    least: float = 5.0
    most: float = 50.0
    polarity: str = "neg"
    factor: int = 5
    unit: float = 1e-3

    @property
    def reach(self) -> int:
        """Samples behind a crossing in which its peak lies."""
        return max(1, self.dead // 2)

    @property
    def margin(self) -> int:
        return self.before + self.behind + self.dead + 4

    @property
    def settle(self) -> int:
        """Samples after which a filter has forgotten where it began: twelve periods of the lowest edge."""
        return int(np.ceil(12 * self.rate_hz / min(self.detect[0], self.keep[0])))


def band_passed(x: np.ndarray, band: tuple[float, float], c: Detection) -> np.ndarray:
    return dsp.sosfiltfilt(dsp.butter_sos(c.order, band[0], min(band[1], 0.45 * c.rate_hz), c.rate_hz), x)


KEYS = ["run_id", "channel"]
FILTERED = "run_id string, channel string, segment long, start long, core_lo long, core_hi long, total long, detected array<double>, kept array<double>"


def filtered_segments(blocks: DataFrame, c: Detection, segment_blocks: int, block_size: int = 128) -> DataFrame:
    """run_id, channel, segment, start (sample of the first value), core_lo, core_hi, total (samples of the channel), and the
    filtered values detected and kept of each segment with a margin of Detection.margin samples on either side.

    blocks: run_id, channel, block_no, samples, all of block_size but the last. A block goes to its own segment and to those
    whose overlap it lies in.
    """
    overlap = -(-(c.settle + c.margin) // block_size)
    n = blocks.groupBy(*KEYS).agg(F.max(F.struct("block_no", F.size("samples").alias("n"))).alias("m"))
    total = n.select(*KEYS, (F.col("m.block_no") * block_size + F.col("m.n")).cast("long").alias("total"))
    last = F.floor((F.col("block_no") + overlap) / segment_blocks)
    first = F.greatest(F.lit(0), F.floor((F.col("block_no") - overlap) / segment_blocks))
    dealt = blocks.select(*KEYS, "block_no", "samples", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("segment"))
    held = dealt.groupBy(*KEYS, "segment").agg(F.sort_array(F.collect_list(F.struct("block_no", "samples"))).alias("b")).join(total, KEYS)
    held = held.where(F.col("segment") * segment_blocks * block_size < F.col("total"))
    rows = held.select(
        F.col("run_id").cast("string").alias("run_id"), F.col("channel").cast("string").alias("channel"), "segment", "total",
        (F.col("b")[0]["block_no"] * block_size).cast("long").alias("start"), F.flatten(F.transform("b", lambda r: r["samples"])).cast("array<double>").alias("x"),
    )
    length = segment_blocks * block_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                segment, total, start = (row.column(name)[0].as_py() for name in ("segment", "total", "start"))
                x = row.column("x")[0].values.to_numpy(zero_copy_only=False)
                lo, hi = segment * length, min(total, (segment + 1) * length)
                a, b = max(0, lo - c.margin - start), min(len(x), hi + c.margin - start)
                try:
                    both = [band_passed(x, band, c)[a:b] for band in (c.detect, c.keep)]
                except ValueError:  # too short to be filtered
                    continue
                numbers = [pa.array([v], pa.int64()) for v in (segment, start + a, lo, hi, total)]
                yield pa.RecordBatch.from_arrays(
                    [row.column("run_id"), row.column("channel"), *numbers, *(pa.array([v.tolist()], pa.list_(pa.float64())) for v in both)],
                    ["run_id", "channel", "segment", "start", "core_lo", "core_hi", "total", "detected", "kept"],
                )

    return rows.mapInArrow(run, FILTERED)


def noise_levels(segments: DataFrame, c: Detection) -> DataFrame:
    """run_id, channel, detect_sd, keep_sd: median of the absolute filtered values over 0.6745, of the whole channel.

    Values are rounded to c.unit and counted in each segment, so a channel's median is of counted values.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, lo, hi = (batch.column(name)[k].as_py() for name in ("start", "core_lo", "core_hi"))
                for band in ("detected", "kept"):
                    x = batch.column(band)[k].values.to_numpy(zero_copy_only=False)[lo - start : hi - start]
                    q, n = np.unique(np.rint(np.abs(x) / c.unit).astype(np.int64), return_counts=True)
                    names = [pa.array([batch.column(key)[k].as_py()] * len(q), pa.string()) for key in KEYS]
                    yield pa.RecordBatch.from_arrays([*names, pa.array([band] * len(q), pa.string()), pa.array(q), pa.array(n)], [*KEYS, "band", "q", "n"])

    counted = segments.mapInArrow(count, "run_id string, channel string, band string, q long, n long").groupBy(*KEYS, "band", "q").agg(F.sum("n").alias("n"))
    middle = counted.groupBy(*KEYS, "band").agg((F.percentile("q", 0.5, F.col("n")) * c.unit / 0.6745).alias("sd"))
    return middle.groupBy(*KEYS).agg(
        F.max(F.when(F.col("band") == "detected", F.col("sd"))).alias("detect_sd"), F.max(F.when(F.col("band") == "kept", F.col("sd"))).alias("keep_sd")
    )


def crossings(x: np.ndarray, kept: np.ndarray, limit: float, c: Detection, start: int, lo: int, hi: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of lo..hi beyond the limit, and the peak of each within reach; those that are their own peak with no further
    sample beyond the limit are left out. Samples too near the channel's ends for a waveform do not count.

    With negative spikes the further samples are those below the positive limit, as the rule that this follows has it.
    """
    sign = {"neg": -x, "pos": x, "both": np.abs(x)}[c.polarity]
    shape = {"neg": -kept, "pos": kept, "both": np.abs(kept)}[c.polarity]
    further = {"neg": kept < limit, "pos": kept > limit, "both": np.abs(kept) > limit}[c.polarity]
    first, last = max(lo, c.before + 1), min(hi, total - c.behind - 2 - c.reach)
    at = np.flatnonzero(sign[max(0, first - start) : max(0, last - start)] > limit) + max(0, first - start)
    if not len(at):
        return at, at
    windows = np.lib.stride_tricks.sliding_window_view(shape, c.reach)[at]
    peak = at + windows.argmax(1)
    more = np.concatenate([[0], np.cumsum(further)])
    alone = (peak == at) & (more[at + c.reach + 1] == more[at + 1])
    return at[~alone] + start, peak[~alone] + start


@lru_cache(maxsize=8)
def spline_matrix(n: int, factor: int) -> np.ndarray:
    """Values at 1/factor, 2/factor, ... n of the cubic spline without knots at the second and last but one of points 1..n,
    as a matrix over the points' values."""
    # second derivatives at the points are linear in the values
    a, b = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1 / 6, 4 / 6, 1 / 6
        b[i, i - 1 : i + 2] = 1, -2, 1
    a[0, :3] = a[-1, -3:] = 1, -2, 1
    curve = np.linalg.solve(a, b)
    at = np.arange(1, n * factor + 1) / factor
    k = np.clip(at.astype(int), 1, n - 1) - 1
    u = (at - 1 - k)[:, None]
    one = np.eye(n)
    return (1 - u) * one[k] + u * one[k + 1] + ((1 - u) ** 3 - (1 - u)) / 6 * curve[k] + (u**3 - u) / 6 * curve[k + 1]


def aligned(waves: np.ndarray, c: Detection) -> np.ndarray:
    """Waveforms of before + behind samples from rows with two more on either side, moved to the peak between samples."""
    if c.factor <= 1:
        return waves[:, 2:-2]
    fine = waves @ spline_matrix(waves.shape[1], c.factor).T
    lo, hi = (c.before + 1) * c.factor, (c.before + 3) * c.factor  # numbered from 1, two samples in front
    part = fine[:, lo - 1 : hi]
    peak = {"neg": (-part).argmax(1), "pos": part.argmax(1), "both": np.abs(part).argmax(1)}[c.polarity] + lo
    at = peak[:, None] - c.before * c.factor + c.factor * np.arange(1, c.before + c.behind + 1)
    return np.take_along_axis(fine, at - 1, 1)


def detect(segments: DataFrame, noise: DataFrame, c: Detection, segment: int | None = None) -> DataFrame:
    """run_id, channel, peak: the samples at which spikes have their peaks, a dead time apart."""
    shape = segments.join(noise, KEYS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, lo, hi, total, sd = (batch.column(name)[k].as_py() for name in ("start", "core_lo", "core_hi", "total", "detect_sd"))
                x, kept = (batch.column(band)[k].values.to_numpy(zero_copy_only=False) for band in ("detected", "kept"))
                at, peak = crossings(x, kept, c.least * sd, c, start, lo, hi, total)
                names = [pa.array([batch.column(key)[k].as_py()] * len(at), pa.string()) for key in KEYS]
                yield pa.RecordBatch.from_arrays([*names, pa.array(at, pa.int64()), pa.array(peak, pa.int64()), pa.array(peak + c.dead, pa.int64())], [*KEYS, "at", "peak", "until"])

    found = shape.mapInArrow(find, "run_id string, channel string, at long, peak long, until long")
    return refractory(found, KEYS, "at", "peak", c.dead + c.reach, segment, "until").select(*KEYS, "peak")


def cut_waveforms(segments: DataFrame, peaks: DataFrame, lead: int, tail: int) -> DataFrame:
    """run_id, channel, peak, wave: the kept band from `lead` samples before each peak to `tail` behind it, from the segment
    that the peak is in; zeros beyond the channel."""
    length = F.col("core_hi") - F.col("core_lo")
    inside = peaks.join(segments.select(*KEYS, "segment", "core_lo", "core_hi"), KEYS).where((F.col("peak") >= F.col("core_lo")) & (F.col("peak") < F.col("core_hi")) & (length > 0))
    held = inside.groupBy(*KEYS, "segment").agg(F.sort_array(F.collect_list("peak")).alias("peaks"))
    both = segments.select(*KEYS, "segment", "start", "kept").join(held, [*KEYS, "segment"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, x = batch.column("start")[k].as_py(), batch.column("kept")[k].values.to_numpy(zero_copy_only=False)
                peaks = batch.column("peaks")[k].values.to_numpy()
                padded = np.concatenate([np.zeros(lead), x, np.zeros(tail + 1)])
                for lo in range(0, len(peaks), 2000):
                    own = peaks[lo : lo + 2000]
                    waves = padded[(own - start)[:, None] + np.arange(lead + tail + 1)]
                    names = [pa.array([batch.column(key)[k].as_py()] * len(own), pa.string()) for key in KEYS]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(own), pa.array(waves.tolist(), pa.list_(pa.float64()))], [*KEYS, "peak", "wave"])

    return both.mapInArrow(cut, "run_id string, channel string, peak long, wave array<double>")


def amplitude_spikes(blocks: DataFrame, c: Detection, segment_blocks: int = 70_313, block_size: int = 128) -> DataFrame:
    """run_id, channel, peak, wave of every spike whose waveform stays below the artifact limit."""
    segments = filtered_segments(blocks, c, segment_blocks, block_size)
    noise = noise_levels(segments, c)
    waves = cut_waveforms(segments, detect(segments, noise, c), c.before + 1, c.behind + 2).join(noise, KEYS)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("wave").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            good = np.abs(x[:, 1:-2]).max(1) < c.most * batch.column("keep_sd").to_numpy()
            kept = batch.select([*KEYS, "peak"]).filter(pa.array(good))
            got = aligned(x[good], c) if good.any() else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(got.tolist(), pa.list_(pa.float64()))], [*KEYS, "peak", "wave"])

    return waves.mapInArrow(finish, "run_id string, channel string, peak long, wave array<double>")


def polytrode_spikes(
    blocks: DataFrame, groups: DataFrame, c: Detection, slack: int = 10, segment_blocks: int = 70_313, block_size: int = 128
) -> DataFrame:
    """run_id, polytrode, peak, waves (array of a waveform for each channel, by name) of groups of channels (run_id, channel,
    polytrode): spikes of any channel, of two closer than the dead time the later one, cut from all channels with `slack`
    samples more on either side."""
    segments = filtered_segments(blocks, c, segment_blocks, block_size)
    found = detect(segments, noise_levels(segments, c), c).join(groups, KEYS).select("run_id", "polytrode", "peak").distinct()
    one = drop_close_pairs(found, ["run_id", "polytrode"], "peak", ["peak"], c.dead)
    every = one.join(groups, ["run_id", "polytrode"])
    waves = cut_waveforms(segments, every.select(*KEYS, "peak"), c.before + slack - 1, c.behind + slack)
    shown = waves.join(groups, KEYS).groupBy("run_id", "polytrode", "peak").agg(F.array_sort(F.collect_list(F.struct("channel", "wave"))).alias("w"))
    return shown.select("run_id", "polytrode", "peak", F.transform("w", lambda x: x["wave"]).alias("waves"))

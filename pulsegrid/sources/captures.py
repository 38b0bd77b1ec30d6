"""ASCII captures with monotone absolute times as a splittable source that seeks to the wanted times.

A line is four numbers of which the first is the time. A filter on epoch_s is pushed into the source: each split of a file
looks for its first wanted line by bisection on byte offsets, a line a probe, and stops reading behind the last one, so a
window costs some forty probes and itself, not the file. Files named by their first time (digits only) that begin behind
the window, and empty files, are not opened at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

#: Bytes of a split; what is read in one go; bytes at which bisection ends, and of a line at most.
SPLIT, CHUNK, NEAR, LINE = 64 << 20, 1 << 16, 1 << 16, 512
COLUMNS = ("epoch_s", "ch1", "ch2", "lead")


def numbers(line: bytes) -> list[float] | None:
    """The four numbers of a line; None for any other."""
    parts = line.split()
    if len(parts) != 4:
        return None
    try:
        return [float(p) for p in parts]
    except ValueError:
        return None


def first_line(read_at: Callable[[int, int], bytes], lo: int, hi: int) -> tuple[int, float] | None:
    """Where the first whole line of numbers behind byte lo, before hi, begins, and its time."""
    at, skip = max(0, lo - 1), lo > 0  # a line that begins at lo is whole: the byte before it is a line end
    while at < hi:
        block = read_at(at, 2 * LINE)
        if not block:
            return None
        begin = 0
        if skip:
            begin = block.find(b"\n") + 1
            if not begin:
                at += len(block)
                continue
            skip = False
        end = block.find(b"\n", begin)
        whole = end >= 0 or len(block) < 2 * LINE
        if at + begin >= hi:
            return None
        if whole and (found := numbers(block[begin : end if end >= 0 else len(block)])):
            return at + begin, found[0]
        if whole:
            at += (end + 1) if end >= 0 else len(block)
        else:
            at, skip = at + begin + 1, True
    return None


def seek(read_at: Callable[[int, int], bytes], lo: int, hi: int, wanted: float) -> int:
    """A byte at or before the first line of lo..hi whose time reaches `wanted`, at most about NEAR before it."""
    while hi - lo > NEAR:
        middle = (lo + hi) // 2
        found = first_line(read_at, middle, hi)
        if found is None or found[1] >= wanted:
            hi = middle
        else:
            lo = middle
    return lo


def lines(read_at: Callable[[int, int], bytes], lo: int, hi: int) -> Iterator[bytes]:
    """The lines that begin in lo..hi, whole."""
    at, rest, drop = max(0, lo - 1), b"", lo > 0
    begin = at
    while block := read_at(at, CHUNK):
        at += len(block)
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for part in parts:
            if not drop and begin >= hi:
                return
            if not drop:
                yield part
            begin, drop = begin + len(part) + 1, False
    if rest and not drop and begin < hi:
        yield rest


@dataclass
class CaptureSplit(InputPartition):
    path: str
    lo: int
    hi: int


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))
        self.lo, self.hi = float("-inf"), float("inf")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds of epoch_s; Spark checks all filters again, as a bound is only where reading begins and ends."""
        for f in filters:
            if getattr(f, "attribute", None) == ("epoch_s",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.lo = max(self.lo, float(f.value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.hi = min(self.hi, float(f.value))
            yield f

    def partitions(self) -> list[CaptureSplit]:
        files, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(root))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            stem = f.base_name.removesuffix(".txt")
            if f.type != pafs.FileType.File or not f.base_name.endswith(".txt") or not f.size:
                continue
            if stem.isdigit() and float(stem) > self.hi:
                continue
            out += [CaptureSplit(f.path, lo, min(lo + self.split, f.size)) for lo in range(0, f.size, self.split)]
        return out or [CaptureSplit("", 0, 0)]

    def read(self, part: CaptureSplit) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        files = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        with files.open_input_file(part.path) as f:
            size = f.size()

            def read_at(at: int, n: int) -> bytes:
                return f.read_at(min(n, max(0, size - at)), at)

            rows: list[list[float]] = []
            for line in lines(read_at, seek(read_at, part.lo, part.hi, self.lo), part.hi):
                found = numbers(line)
                if found is None or found[0] < self.lo:
                    continue
                if found[0] > self.hi:
                    break
                rows.append(found)
                if len(rows) == 10_000:
                    yield self.batch(part.path, rows)
                    rows = []
            if rows:
                yield self.batch(part.path, rows)

    @staticmethod
    def batch(path: str, rows: list[list[float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(c) for c in zip(*rows))], ["file", *COLUMNS])


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scope_capture"

    def schema(self) -> str:
        return "file string, " + ", ".join(f"{c} double" for c in COLUMNS)

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def scope_capture(spark: SparkSession, path: str, lo: float, hi: float, split_bytes: int = SPLIT) -> DataFrame:
    """file, epoch_s, ch1, ch2, lead of the captures in a folder (or one file) with lo <= epoch_s < hi; lines that are not
    four numbers are left out."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
    df = spark.read.format("scope_capture").option("path", path).option("splitbytes", str(split_bytes)).load()
    return df.where((df["epoch_s"] >= lo) & (df["epoch_s"] < hi))

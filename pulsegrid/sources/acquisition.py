"""Binary recordings as a Spark data source: stim/record files (rhs) and record-only files (rhd).

A header names the enabled channels; the data are blocks of a fixed number of samples. Files are cut into ranges of
blocks, one partition each, so a long recording is read by many tasks; a row is one channel's samples of one block.
Only the wanted channels and stream are decoded.

    spark.dataSource.register(RecordingSource)
    spark.read.format("recording").option("path", folder).option("stream", "amplifier").load()

Streams: amplifier (microvolts, with stim words where the file has them), aux, supply, temperature, adc, din, dout.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the formats.
MAGIC_STIM, MAGIC_RECORD = 0xD69127AC, 0xC6912702
AMPLIFIER, AUX, SUPPLY, ADC, DIGITAL_IN, DIGITAL_OUT = 0, 1, 2, 3, 4, 5
STIM_ADC, STIM_DAC, STIM_DIN, STIM_DOUT = 3, 4, 5, 6
AMPLIFIER_UV, AUX_V, SUPPLY_V, TEMPERATURE_C = 0.195, 37.4e-6, 74.8e-6, 0.01
ADC_V = {1: (152.59e-6, 32768), 13: (312.5e-6, 32768)}
ADC_V_ELSE = (50.354e-6, 0)
STIM_ADC_V = (312.5e-6, 32768)

#: Blocks of one partition.
BLOCKS_PER_TASK = 2000


@dataclass
class Channel:
    name: str
    order: int
    kind: int
    impedance: float
    phase: float


@dataclass
class Header:
    stim: bool
    version: tuple[int, int]
    rate_hz: float
    fields: dict
    channels: list[Channel]
    size: int
    per_block: int
    dc_saved: bool = False
    n_temperature: int = 0
    board_mode: int = 0
    layout: list = field(default_factory=list)

    def of(self, kind: int) -> list[Channel]:
        return [c for c in self.channels if c.kind == kind]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.layout)


class _Walk:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        value = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return value[0] if len(value) == 1 else value

    def text(self) -> str:
        n = self.take("I")
        if n == 0xFFFFFFFF:
            return ""
        if n > len(self.data) - self.at:
            raise ValueError("a text of the header leaves the file")
        out = self.data[self.at : self.at + n].decode("utf-16-le")
        self.at += n
        return out


def parse_header(data: bytes) -> Header:
    """Header of either format; anything else raises ValueError."""
    w = _Walk(data)
    magic = w.take("I")
    if magic not in (MAGIC_STIM, MAGIC_RECORD):
        raise ValueError(f"not a recording: it begins with {magic:#010x}")
    stim = magic == MAGIC_STIM
    version = w.take("hh")
    rate = w.take("f")
    names = ["dsp_enabled", "dsp_cutoff_hz", "lower_hz", *(["lower_settle_hz"] if stim else []), "upper_hz"]
    f = dict(zip(names, w.take("h" + "f" * (len(names) - 1))))
    wanted = ["dsp_cutoff_wanted_hz", "lower_wanted_hz", *(["lower_settle_wanted_hz"] if stim else []), "upper_wanted_hz"]
    f |= dict(zip(wanted, w.take("f" * len(wanted))))
    f["notch_mode"] = w.take("h")
    f["impedance_test_wanted_hz"], f["impedance_test_hz"] = w.take("ff")
    if stim:
        f["settle_mode"], f["charge_recovery_mode"] = w.take("hh")
        f["stim_step_a"], f["recovery_limit_a"], f["recovery_target_v"] = w.take("fff")
    f["notes"] = [w.text() for _ in range(3)]
    dc, n_temp, mode = False, 0, 0
    if stim:
        dc = bool(w.take("h"))
        mode = w.take("h")
        f["reference"] = w.text()
    else:
        n_temp = w.take("h") if version >= (1, 1) else 0
        mode = w.take("h") if version >= (1, 3) else 0
        f["reference"] = w.text() if version[0] >= 2 else ""
    channels = []
    for _ in range(w.take("h")):
        w.text(), w.text()
        enabled, n, _ = w.take("hhh")
        for _ in range(n if n > 0 and enabled > 0 else 0):  # a disabled group has no records of channels
            native, _ = w.text(), w.text()
            order, _, kind, on, _ = w.take("hhhhh")
            w.take("hh" if stim else "h")
            w.take("hhhh")
            impedance, phase = w.take("ff")
            if kind not in range(7 if stim else 6) or stim and kind in (1, 2):
                raise ValueError(f"channel {native} has the unknown type {kind}")
            if on:
                channels.append(Channel(native, order, kind, impedance, phase))
    n = 128 if stim or version[0] >= 2 else 60
    h = Header(stim, version, rate, f, channels, w.at, n, dc, n_temp, mode)
    stamp = "<i4" if stim or version >= (1, 2) else "<u4"
    h.layout = [("t", stamp, (n,))]

    def add(name: str, count: int, kind: str, size: int) -> None:
        if count:
            h.layout.append((name, kind, (int(count), size)))

    add("amp", len(h.of(AMPLIFIER)), "<u2", n)
    if stim:
        add("dc", len(h.of(AMPLIFIER)) if dc else 0, "<u2", n)
        add("stim", len(h.of(AMPLIFIER)), "<u2", n)
        add("adc", len(h.of(STIM_ADC)), "<u2", n)
        add("dac", len(h.of(STIM_DAC)), "<u2", n)
        add("din", bool(h.of(STIM_DIN)), "<u2", n)
        add("dout", bool(h.of(STIM_DOUT)), "<u2", n)
    else:
        add("aux", len(h.of(AUX)), "<u2", n // 4)
        add("supply", len(h.of(SUPPLY)), "<u2", 1)
        add("temperature", n_temp, "<i2", 1)
        add("adc", len(h.of(ADC)), "<u2", n)
        add("din", bool(h.of(DIGITAL_IN)), "<u2", n)
        add("dout", bool(h.of(DIGITAL_OUT)), "<u2", n)
    return h


def n_blocks(h: Header, file_size: int) -> int:
    """Blocks of a file; a part of a block at its end raises ValueError."""
    left = file_size - h.size
    if left % h.dtype.itemsize:
        raise ValueError("the data are not a whole number of blocks")
    return left // h.dtype.itemsize


def stream_names(h: Header, stream: str) -> list[str]:
    digital = {"din": STIM_DIN if h.stim else DIGITAL_IN, "dout": STIM_DOUT if h.stim else DIGITAL_OUT}
    kinds = {"amplifier": AMPLIFIER, "aux": AUX, "supply": SUPPLY, "adc": STIM_ADC if h.stim else ADC, **digital}
    if stream == "temperature":
        return [f"T{i + 1}" for i in range(h.n_temperature)]
    return [c.name for c in h.of(kinds[stream])] if not (h.stim and stream in ("aux", "supply")) else []


def stream_values(h: Header, blocks: np.ndarray, stream: str) -> np.ndarray:
    """(blocks, channels, samples) in physical units."""
    if stream == "amplifier":
        return (blocks["amp"].astype(np.int32) - 32768).astype(np.float32) * np.float32(AMPLIFIER_UV)
    if stream in ("aux", "supply", "temperature"):
        scale = {"aux": AUX_V, "supply": SUPPLY_V, "temperature": TEMPERATURE_C}[stream]
        return blocks[stream].astype(np.float32) * np.float32(scale)
    if stream == "adc":
        scale, zero = STIM_ADC_V if h.stim else ADC_V.get(h.board_mode, ADC_V_ELSE)
        return ((blocks["adc"].astype(np.int32) - zero) * scale).astype(np.float32)
    kind = {"din": STIM_DIN if h.stim else DIGITAL_IN, "dout": STIM_DOUT if h.stim else DIGITAL_OUT}[stream]
    bits = np.array([c.order for c in h.of(kind)])
    return ((blocks[stream] >> bits[None, :, None]) & 1).astype(np.float32)


def folder_of(path: str) -> str:
    """The folder that holds a file: its files are one run."""
    return path.rstrip("/").rpartition("/")[0]


def run_name(path: str, root: str) -> str:
    """A file's folder as seen from root, so that folders of one name under different parents stay apart; the last part of
    it for a file in root itself, or where root is the file."""
    folder, top = (x.partition("://")[2] if "://" in x else x.removeprefix("file:") for x in (folder_of(path), root.rstrip("/")))
    below = folder[len(top) :].strip("/") if folder.startswith(top) else ""
    return below or folder.rpartition("/")[2]


@dataclass
class Blocks(InputPartition):
    path: str
    file_no: int
    first_block: int  # of the run
    lo: int
    hi: int


def open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def header_of(path: str) -> tuple[Header, int]:
    """A file's header and size; only its first bytes are read, more while the header needs them."""
    store, name = open_store(path)
    with store.open_input_file(name) as f:
        size, n = f.size(), 1 << 16
        while True:
            try:
                return parse_header(f.read_at(min(n, size), 0)), size
            except (struct.error, ValueError):
                if n >= size:
                    raise
                n *= 8


def find_files(path: str, pattern: str = r"\.(rhs|rhd)$") -> list[str]:
    """Files of a folder and the folders below, or the file itself; where a run has both kinds the stim one counts."""
    from pyarrow import fs

    store, name = open_store(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [path]
    scheme = path[: path.index(name)] if name in path else "file://"
    found = store.get_file_info(fs.FileSelector(name, recursive=True))
    files = sorted(scheme + f.path for f in found if f.type == fs.FileType.File and re.search(pattern, f.path))
    stim = {folder_of(f) for f in files if f.endswith(".rhs")}
    return [f for f in files if f.endswith(".rhs") or folder_of(f) not in stim]


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.stream = options["path"], options.get("stream", "amplifier")
        self.wanted = [c.strip() for c in options.get("channels", "").split(",") if c.strip()]
        self.per_task = int(options.get("blocksPerTask", BLOCKS_PER_TASK))

    def partitions(self) -> list[Blocks]:
        """Headers are read once here: every file of a run must have the same channels and rate."""
        parts, runs = [], {}
        for path in find_files(self.path):
            h, size = header_of(path)
            names = stream_names(h, self.stream)
            run = runs.setdefault(folder_of(path), {"names": names, "rate": round(h.rate_hz, 9), "blocks": 0, "files": 0})
            if (names, round(h.rate_hz, 9)) != (run["names"], run["rate"]):
                raise ValueError(f"{path}: channels or rate differ from the run's other files")
            missing = [c for c in self.wanted if c not in names]
            if missing:
                raise ValueError(f"{path}: no channel {', '.join(missing)}; there are {', '.join(names)}")
            n = n_blocks(h, size)
            for lo in range(0, n, self.per_task):
                parts.append(Blocks(path, run["files"], run["blocks"], lo, min(n, lo + self.per_task)))
            run["blocks"] += n
            run["files"] += 1
        return parts or [Blocks("", 0, 0, 0, 0)]

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        h, _ = header_of(part.path)
        names = stream_names(h, self.stream)
        picked = [names.index(c) for c in self.wanted] if self.wanted else list(range(len(names)))
        if not picked:
            return
        store, name = open_store(part.path)
        with store.open_input_file(name) as f:
            item = h.dtype.itemsize
            for lo in range(part.lo, part.hi, 200):
                n = min(200, part.hi - lo)
                blocks = np.frombuffer(f.read_at(n * item, h.size + lo * item), h.dtype)
                values = stream_values(h, blocks, self.stream)[:, picked]
                flat, size = values.reshape(-1), values.shape[2]
                rows = n * len(picked)
                offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * size)
                has_words = h.stim and self.stream == "amplifier"
                words = blocks["stim"][:, picked].astype(np.int32).reshape(-1) if has_words else None
                none = pa.nulls(rows, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([run_name(part.path, self.path)] * rows),
                        pa.array([names[i] for i in picked] * n),
                        pa.array(np.repeat(part.first_block + np.arange(lo, lo + n), len(picked))),
                        pa.array(np.full(rows, part.file_no, np.int32)),
                        pa.array(np.repeat(blocks["t"][:, 0].astype(np.int64), len(picked))),
                        pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32())),
                        pa.ListArray.from_arrays(offsets, pa.array(words)) if has_words else none,
                    ],
                    ["run_id", "channel", "block_no", "file_no", "t0", "samples", "stim_words"],
                )


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return "run_id string, channel string, block_no long, file_no int, t0 long, samples array<float>, stim_words array<int>"

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options, schema)


@dataclass
class OneFile(InputPartition):
    path: str


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[OneFile]:
        return [OneFile(p) for p in find_files(self.path)] or [OneFile("")]

    def read(self, part: OneFile) -> Iterator[tuple]:
        if not part.path:
            return
        h, size = header_of(part.path)
        amp = h.of(AMPLIFIER)
        f = h.fields
        yield (
            run_name(part.path, self.path), part.path, "rhs" if h.stim else "rhd", float(h.rate_hz), n_blocks(h, size) * h.per_block,
            [c.name for c in amp], {c.name: float(c.impedance) for c in amp}, bool(f["dsp_enabled"]), float(f["dsp_cutoff_hz"]),
            float(f["lower_hz"]), float(f["upper_hz"]), float(f.get("stim_step_a", 0.0)) * 1e6,
        )


class HeaderSource(DataSource):
    """One row a file: its settings, without reading data."""

    @classmethod
    def name(cls) -> str:
        return "recording_header"

    def schema(self) -> str:
        return (
            "run_id string, path string, format string, sample_rate_hz double, n_samples long, channels array<string>, "
            "impedance_ohms map<string,double>, dsp_enabled boolean, dsp_cutoff_hz double, lower_hz double, upper_hz double, "
            "stim_step_ua double"
        )

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)

"""Writers of recordings, for fixtures and round trips."""

from __future__ import annotations

import struct

import numpy as np

from .acquisition import MAGIC_RECORD, MAGIC_STIM, parse_header


def _text(s: str) -> bytes:
    data = s.encode("utf-16-le")
    return struct.pack("<I", len(data)) + data if s else struct.pack("<I", 0xFFFFFFFF)


def _channel(name: str, order: int, kind: int, stim: bool, on: bool = True, impedance: float = 1e5, phase: float = -60.0) -> bytes:
    out = _text(name) + _text(name) + struct.pack("<hhhhh", order, order, kind, on, order)
    out += struct.pack("<hh" if stim else "<h", *([0, 0] if stim else [0]))
    return out + struct.pack("<hhhhff", 0, 0, 0, 0, impedance, phase)


def _groups(channels: list[bytes], disabled: int = 0) -> bytes:
    """One group of channels; before it an empty one that is disabled though it tells of `disabled` channels."""
    off = _text("Port Z") + _text("Z") + struct.pack("<hhh", 0, disabled, disabled) if disabled else b""
    own = _text("Port A") + _text("A") + struct.pack("<hhh", 1, len(channels), len(channels)) + b"".join(channels)
    return struct.pack("<h", 1 + bool(disabled)) + off + own


def _assemble(header: bytes, n: int, streams: dict[str, np.ndarray], t0: int) -> bytes:
    h = parse_header(header)
    per, dt = h.per_block, h.dtype
    if n % per:
        raise ValueError("samples must fill whole blocks")
    blocks = np.zeros(n // per, dt)
    blocks["t"] = (t0 + np.arange(n)).reshape(-1, per)
    for name, values in streams.items():
        if name in dt.names:
            size = dt[name].shape[1]
            blocks[name] = values.reshape(len(values), -1, size).transpose(1, 0, 2)
    return header + blocks.tobytes()


def stim_file(codes: np.ndarray, words: np.ndarray, names: list[str], rate: float = 30000.0, step_a: float = 1e-6, t0: int = 0,
              impedances: list[float] | None = None, dsp: tuple[bool, float] = (True, 1.0), lower: float = 7.5, upper: float = 7500.0, disabled: int = 0) -> bytes:
    """A stim/record file of amplifier codes and stim words, both (channels, samples) of whole 128-sample blocks."""
    head = struct.pack("<Ihhf", MAGIC_STIM, 3, 0, rate) + struct.pack("<hffff", dsp[0], dsp[1], lower, 1000.0, upper)
    head += struct.pack("<ffff", dsp[1], lower, 1000.0, upper) + struct.pack("<hff", 0, 1000.0, 1000.0)
    head += struct.pack("<hhfff", 0, 0, step_a, 1e-9, 0.0) + _text("") * 3 + struct.pack("<hh", 0, 0) + _text("")
    z = impedances or [1e5] * len(names)
    head += _groups([_channel(c, i, 0, True, True, z[i]) for i, c in enumerate(names)], disabled)
    return _assemble(head, codes.shape[1], {"amp": codes, "stim": words}, t0)


def record_file(streams: dict[str, np.ndarray], names: dict[str, list[tuple[str, int]]], n: int, rate: float = 30000.0,
                version: tuple[int, int] = (3, 0), n_temperature: int = 0, board_mode: int = 0, t0: int = 0) -> bytes:
    """A record-only file; names: (name, native order) for amp, aux, supply, adc, din and dout."""
    head = struct.pack("<Ihhf", MAGIC_RECORD, *version, rate) + struct.pack("<hfff", 1, 1.0, 0.1, 7500.0)
    head += struct.pack("<fff", 1.0, 0.1, 7500.0) + struct.pack("<hff", 0, 1000.0, 1000.0) + _text("") * 3
    head += struct.pack("<h", n_temperature) if version >= (1, 1) else b""
    head += struct.pack("<h", board_mode) if version >= (1, 3) else b""
    head += _text("") if version[0] >= 2 else b""
    kinds = {"amp": 0, "aux": 1, "supply": 2, "adc": 3, "din": 4, "dout": 5}
    channels = [_channel(c, o, kinds[s], False) for s in kinds for c, o in names.get(s, [])]
    return _assemble(head + _groups(channels), n, streams, t0)

"""Stimulation words and filter constants: bits into columns, sample codes into volts, poles into times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed bits of a stimulation word.
MAGNITUDE, SIGN, SETTLE, RECOVERY, COMPLIANCE = 0x00FF, 0x0100, 0x2000, 0x4000, 0x8000


def flag(word: Column, mask: int) -> Column:
    return word.bitwiseAND(F.lit(mask)) != 0


def current_ua(word: Column, step_ua: float) -> Column:
    """Bits 0-7 are steps, bit 8 the sign (set: negative)."""
    size = word.bitwiseAND(F.lit(MAGNITUDE)).cast("double") * step_ua
    return F.when(flag(word, SIGN), -size).otherwise(size)


def amplifier_uv(code: Column) -> Column:
    return ((code - 32768).cast("float") * F.lit(0.195).cast("float")).cast("float")


def board_adc_v(code: Column, mode: Column) -> Column:
    """Volts of a board input; modes 1 and 13 are centred."""
    return (
        F.when(mode == 1, 152.59e-6 * (code - 32768)).when(mode == 13, 312.5e-6 * (code - 32768)).otherwise(50.354e-6 * code)
    )


def digital(word: Column, bit: Column) -> Column:
    return F.call_function("shiftright", word, bit).bitwiseAND(F.lit(1)) == 1


def charge_nc(current: Column, phase_us: Column) -> Column:
    return current * phase_us * 1e-3


def tau_ms(cutoff_hz: Column) -> Column:
    return F.when(cutoff_hz > 0, 1000 / (2 * math.pi * cutoff_hz))


def dsp_cutoff_hz(k: Column, rate_hz: float) -> Column:
    """Cutoff of the one-pole offset filter with coefficient 2^-k."""
    return F.ln(1 / (1 - F.pow(F.lit(2.0), -k))) * rate_hz / (2 * math.pi)


def nearest_dsp_k(cutoff_hz: Column, rate_hz: float) -> Column:
    """The k of 1..16 whose cutoff is nearest, the smaller of equals."""
    options = F.array(*[F.struct(F.abs(dsp_cutoff_hz(F.lit(float(k)), rate_hz) - cutoff_hz).alias("d"), F.lit(k).alias("k")) for k in range(1, 17)])
    return F.array_min(options)["k"]


def log_close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within a factor; both not positive counts as equal."""
    both = (a > 0) & (b > 0)
    return F.when(both, F.abs(F.ln(F.when(both, a / b))) <= math.log(tolerance)).otherwise((a <= 0) & (b <= 0))

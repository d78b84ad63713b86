"""Coherent dedispersion."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishflow.config import Config
from dishflow.functions.scalars import complex_mul, fraction

#: Fixed value: dispersion constant in MHz^2 pc^-1 cm^3 s.
DISPERSION = 4.148808e3


def delay(f: Column | float, f_c: Column | float, dm: Column | float) -> Column | float:
    """Seconds by which f lags f_c."""
    return -DISPERSION * dm * (1 / (f * f) - 1 / (f_c * f_c))


def max_delay(c: Config) -> float:
    return delay(c.freq_top, c.freq_low, c.dm)


def reserved_samples(c: Config) -> int:
    """Samples at a segment's end that the dispersion spoils and the next segment reads again: what is left is a multiple
    of twice the channels. 0 if that would leave nothing, or if reserving is off."""
    if not c.reserve_sample:
        return 0
    least = 2 * math.floor(max_delay(c) * c.sample_rate + 0.5)
    keep = (c.input_count - least) // (2 * c.channel_count) * 2 * c.channel_count
    return c.input_count - keep if 0 < keep <= c.input_count else 0


def turns(f: Column, f_c: float, dm: float) -> Column:
    """Phase in turns by which a bin is moved back."""
    d = (f - F.lit(f_c)) / F.lit(f_c)
    return F.lit(DISPERSION * 1e6 * dm) / f * d * d


def turns_with_delay(f: Column, f_c: float, dm: float) -> Column:
    """As turns, with the delay at f_c left in: their difference is linear in f."""
    return F.lit(DISPERSION * 1e6 * dm) * (1 / (f * f) - F.lit(1 / f_c**2)) * f


def phase_factor(k: Column) -> tuple[Column, Column]:
    angle = fraction(k) * (-2 * math.pi)
    return F.cos(angle), F.sin(angle)


def dedisperse(df: DataFrame, bins: int, freq_low: float, bandwidth: float, dm: float, bin_col: str = "k") -> DataFrame:
    """Long form: every bin times its phase factor; a column expression, so no join."""
    f = F.lit(freq_low) + F.col(bin_col) * (bandwidth / bins)
    re, im = complex_mul(F.col("re"), F.col("im"), *phase_factor(turns(f, freq_low + bandwidth, dm)))
    return df.withColumns({"re": re, "im": im})


def factors(bins: int, freq_low: float, bandwidth: float, dm: float) -> np.ndarray:
    return phases(np.arange(bins), bins, freq_low, bandwidth, dm)


def phases(k: np.ndarray, bins: int, freq_low: float, bandwidth: float, dm: float) -> np.ndarray:
    """Phase factors of bins k."""
    f, f_c = freq_low + k * (bandwidth / bins), freq_low + bandwidth
    turned = DISPERSION * 1e6 * dm / f * ((f - f_c) / f_c) ** 2
    return np.exp(-2j * np.pi * np.fmod(turned, 1.0))

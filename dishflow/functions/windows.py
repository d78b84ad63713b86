"""Tapers: generalised cosine sums over position i of n samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HANN = (0.5, 0.5)
HAMMING = (25 / 46, 21 / 46)
RECTANGLE = (1.0,)


def cosine_sum(i: Column, n: int, a: Sequence[float]) -> Column:
    """sum over k of (-1)^k a_k cos(2 pi k i / (n-1))."""
    out = F.lit(float(a[0]))
    for k, x in enumerate(a[1:], 1):
        out = out + F.lit((-1) ** k * float(x)) * F.cos(i * (2 * math.pi * k) / (n - 1))
    return out


def coefficients(n: int, a: Sequence[float]) -> np.ndarray:
    i = np.arange(n)
    return sum((-1) ** k * x * np.cos(2 * np.pi * k * i / (n - 1)) for k, x in enumerate(a)) * np.ones(n)

"""Excision of interference: what is hit becomes 0, rows stay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dishflow.functions.scalars import power


def _masked(df: DataFrame, hit: Column, scale: Column | float = 1.0) -> DataFrame:
    """SQL's unknown counts as no hit: what can't be judged stays."""
    bad = F.coalesce(hit, F.lit(False))
    return df.withColumns({c: F.when(bad, F.lit(0.0)).otherwise(F.col(c) * scale) for c in ("re", "im")})


def zap_average(df: DataFrame, threshold: float, by: tuple[str, ...] = ("seg",), normalise: tuple[int, int] | None = None) -> DataFrame:
    """Bins whose power exceeds threshold times the segment's mean become 0; with normalise = (bins, channels) the others
    are scaled by sqrt(channels) / bins. The power of a bin is a column, the mean a window over the segment."""
    p = power(F.col("re"), F.col("im"))
    scale = math.sqrt(normalise[1]) / normalise[0] if normalise else 1.0
    return _masked(df, p > threshold * F.avg(p).over(Window.partitionBy(*by)), scale)


def parse_zap_list(text: str) -> list[tuple[float, float]]:
    """"11-12, 15-90" to pairs; what isn't two numbers is skipped."""
    out = []
    for item in text.split(","):
        ends = [x for x in item.split("-") if x.strip()]
        if len(ends) == 2:
            out.append((float(ends[0]), float(ends[1])))
    return out


def zap_ends(item: Column) -> Column:
    """The numbers of one item of a band list that is a column."""
    parts = F.filter(F.split(item, "-"), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.trim(x).try_cast("double"))


def zap_bins(pairs: list[tuple[float, float]], n: int, freq_low: float, bandwidth: float) -> list[tuple[int, int]]:
    """Inclusive bins of frequency ranges; a range that leaves the band is skipped as a whole."""
    out = []
    for a, b in pairs:
        if (b - a < 0) != (bandwidth < 0):
            a, b = b, a
        ends = [math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1) for x in ((f - freq_low) / bandwidth * (n - 1) for f in (a, b))]
        if 0 <= ends[0] <= ends[1] < n:
            out.append((ends[0], ends[1]))
    return out


def zap_ranges(df: DataFrame, bins: list[tuple[int, int]], bin_col: str = "k") -> DataFrame:
    """Listed bins become 0. The list is configuration, so it is part of the expression."""
    hit = F.lit(False)
    for a, b in bins:
        hit = hit | F.col(bin_col).between(a, b)
    return _masked(df, hit)


def kurtosis_limits(threshold: float, m: int) -> tuple[float, float]:
    a, b = (t * (m - 1) / (m + 1) + 1 for t in (threshold, 2 - threshold))
    return min(a, b), max(a, b)


def spectral_kurtosis(sum_p: Column, sum_p2: Column, m: int) -> Column:
    """Null for a channel without power: it is 0 already."""
    return F.try_divide(m * sum_p2, sum_p * sum_p)


def zap_kurtosis(df: DataFrame, threshold: float, m: int, by: tuple[str, ...] = ("seg", "chan"), normalise: bool = False) -> DataFrame:
    """Channels whose spectral kurtosis over m time samples leaves the limits become 0; both sums come from one window.
    normalise: kept channels are divided by their mean amplitude."""
    p = power(F.col("re"), F.col("im"))
    own = Window.partitionBy(*by)
    low, high = kurtosis_limits(threshold, m)
    found = df.withColumn("sk", spectral_kurtosis(F.sum(p).over(own), F.sum(p * p).over(own), m))
    if normalise:
        found = found.withColumn("amp", F.avg(F.sqrt(p)).over(own))
        found = found.withColumns({c: F.coalesce(F.try_divide(F.col(c), F.col("amp")), F.lit(0.0)) for c in ("re", "im")}).drop("amp")
    return _masked(found, (F.col("sk") > high) | (F.col("sk") < low)).drop("sk")


def zero_channels(df: DataFrame) -> DataFrame:
    """seg, zeros: channels whose first time sample has no power."""
    p = power(F.col("re"), F.col("im"))
    return df.groupBy("seg").agg(F.sum(F.when((F.col("tm") == 0) & (p == 0), 1).otherwise(0)).cast("long").alias("zeros"))


def enough_channels(df: DataFrame, channels: int, most: float) -> DataFrame:
    """Segments of which fewer than most * channels are zero, counted by a window: the rows are not made twice."""
    silent = F.when((F.col("tm") == 0) & (power(F.col("re"), F.col("im")) == 0), 1).otherwise(0)
    return df.withColumn("zeros", F.sum(silent).over(Window.partitionBy("seg"))).where(F.col("zeros") < most * channels).drop("zeros")

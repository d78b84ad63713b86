"""From a dynamic spectrum to detections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dishflow.config import Config
from dishflow.functions.scalars import power
from dishflow.operators.dedisperse import factors, reserved_samples
from dishflow.operators.kernels import stacked_kernel
from dishflow.operators.rfi import kurtosis_limits, parse_zap_list, zap_bins


def map_reduce(df: DataFrame, by: list[str], mapped: Column, name: str = "total") -> DataFrame:
    """Sum of a mapped value in each group; Spark adds up partial sums before the shuffle."""
    return df.groupBy(*by).agg(F.sum(mapped).alias(name))


def time_series(df: DataFrame, keep: int | None = None) -> DataFrame:
    """seg, tm, y: power summed over the channels, for the first `keep` time samples."""
    some = df if keep is None else df.where(F.col("tm") < keep)
    return some.groupBy("seg", "tm").agg(F.sum(power(F.col("re"), F.col("im"))).alias("y"))


def without_baseline(series: DataFrame) -> DataFrame:
    return series.withColumn("y", F.col("y") - F.avg("y").over(Window.partitionBy("seg")))


def boxcar(series: DataFrame, lengths: list[int], n: int) -> DataFrame:
    """seg, boxcar, tm, y: for length 1 the series itself; for b the sums of y[tm+1..tm+b], so the window at the very
    beginning is left out. One running sum serves all lengths: a sum is the difference of two of its values."""
    order = Window.partitionBy("seg").orderBy("tm")
    total = series.withColumn("s", F.sum("y").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = [b for b in lengths if b == 1 or b < n]
    sums = [F.struct(F.lit(b).alias("boxcar"), (F.col("y") if b == 1 else F.lead("s", b).over(order) - F.col("s")).alias("y")) for b in lengths]
    found = total.select("seg", "tm", F.array(*sums).alias("all")).select("seg", "tm", F.inline("all"))
    return found.where("y is not null").select("seg", "boxcar", "tm", "y")


def count_signal(series: DataFrame, snr: float, by: tuple[str, ...] = ("seg", "boxcar")) -> DataFrame:
    """by, rms, peak, hits: hits are values above snr times the root mean square about 0."""
    rms = F.sqrt(F.avg(F.col("y") * F.col("y")).over(Window.partitionBy(*by)))
    return series.withColumn("rms", rms).groupBy(*by).agg(F.first("rms").alias("rms"), F.max("y").alias("peak"), F.count_if(F.col("y") > snr * F.col("rms")).alias("hits"))


def running_mean_1bit(df: DataFrame, n: int, w: int, by: str = "chan", pos: str = "i", value: str = "x") -> DataFrame:
    """by, pos, bit: whether a value exceeds the mean of the w values from it on; the series goes on as its mirror image."""
    mirror = df.where(F.col(pos) >= n - w).select(by, (2 * n - 1 - F.col(pos)).alias(pos), value)
    frame = Window.partitionBy(by).orderBy(pos).rowsBetween(0, w - 1)
    found = df.select(by, pos, value).unionByName(mirror).withColumn("mean", F.avg(value).over(frame))
    return found.where(F.col(pos) < n).select(by, pos, (F.col(value) > F.col("mean")).cast("int").alias("bit"))


def cleaned_spectra(x: np.ndarray, c: Config, zapped: list[tuple[int, int]]) -> np.ndarray:
    """Dynamic spectra (rows, channels, tm) of samples (rows, n), dedispersed; what is zapped is 0."""
    bins, channels = c.bins, min(c.channel_count, c.bins)
    z = np.fft.rfft(x, axis=1)[:, :bins]
    p = z.real**2 + z.imag**2
    z = np.where(p > c.average_threshold * p.mean(axis=1, keepdims=True), 0, z * (np.sqrt(channels) / bins))
    for a, b in zapped:
        z[:, a : b + 1] = 0
    z *= factors(bins, c.freq_low, c.bandwidth, c.dm)
    y = z.reshape(len(z), channels, -1)
    length = y.shape[2]
    y = np.fft.ifft(y, axis=2) * length
    p = y.real**2 + y.imag**2
    sums, squares = p.sum(axis=2), (p * p).sum(axis=2)
    low, high = kurtosis_limits(c.kurtosis_threshold, length)
    with np.errstate(invalid="ignore", divide="ignore"):
        sk = length * squares / (sums * sums)
        y[(sk > high) | (sk < low)] = 0
    return y


def cleaned_series(spectra: np.ndarray, c: Config, reserved: int) -> np.ndarray:
    """Time series (rows, tm) without their mean; rows with too many zapped channels are NaN."""
    channels, length = spectra.shape[1:]
    p = spectra.real**2 + spectra.imag**2
    series = p.sum(axis=1)[:, : length - reserved // channels or length]
    series = series - series.mean(axis=1, keepdims=True)
    series[(p[:, :, 0] == 0).sum(axis=1) >= c.channel_threshold * channels] = np.nan
    return series


def boxcar_series(y: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths 1, 2, 4, ... and the sums of so many samples after each one (length 1: the samples)."""
    n, total, b = y.shape[1], np.cumsum(y, axis=1), 1
    while b == 1 or b < n and b <= most:
        yield b, y if b == 1 else total[:, b:] - total[:, :-b]
        b *= 2


def pulse_search(segments: DataFrame, c: Config) -> DataFrame:
    """seg, boxcar, rms, peak, hits for segments (seg, x), without a shuffle: transforms, excision, dedispersion and the
    search run on Arrow batches, and a few numbers a segment leave them. Segments that fail the channel gate give no rows."""
    zapped = zap_bins(parse_zap_list(c.zap_list), c.bins, c.freq_low, c.bandwidth)
    reserved = reserved_samples(c)

    def fn(x: np.ndarray) -> tuple[np.ndarray, ...]:
        out = []
        for b, v in boxcar_series(cleaned_series(cleaned_spectra(x, c, zapped), c, reserved), c.max_boxcar):
            rms = np.sqrt((v * v).mean(axis=1))
            out.append(np.stack([np.full(len(v), float(b)), rms, v.max(axis=1), (v > c.snr_threshold * rms[:, None]).sum(axis=1)], axis=1))
        return (np.concatenate(out, axis=1),)

    found = stacked_kernel(segments, ["seg"], ["x"], ["v"], fn)
    at = F.explode(F.sequence(F.lit(0), (F.size("v") / 4).cast("int") - 1)).alias("i")
    cell = lambda k: F.get("v", F.col("i") * 4 + k)
    rows = found.select("seg", "v", at).select("seg", cell(0).cast("int").alias("boxcar"), cell(1).alias("rms"), cell(2).alias("peak"), cell(3).cast("long").alias("hits"))
    return rows.where(~F.isnan("rms"))

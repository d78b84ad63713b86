"""Transforms of segments: arrays in, arrays out, no shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from dishflow.functions.windows import coefficients
from dishflow.operators.kernels import stacked_kernel


def _parts(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(z.real), np.ascontiguousarray(z.imag)


def rfft(df: DataFrame, key: str = "seg", x: str = "x", window: tuple[float, ...] | None = None) -> DataFrame:
    """key, re, im: n real samples to n/2 bins, unnormalised, without the Nyquist bin."""

    def fn(a: np.ndarray):
        w = coefficients(a.shape[1], window) if window else 1.0
        return _parts(np.fft.rfft(a * w, axis=1)[:, : a.shape[1] // 2])

    return stacked_kernel(df, [key], [x], ["re", "im"], fn)


def fft(df: DataFrame, key: str = "seg", inverse: bool = False, batch: int | None = None) -> DataFrame:
    """key, re, im: unnormalised transform of each row, or of each run of `batch` numbers in it."""

    def fn(re: np.ndarray, im: np.ndarray):
        z = (re + 1j * im).reshape(len(re), -1, batch or re.shape[1])
        out = np.fft.ifft(z, axis=2) * z.shape[2] if inverse else np.fft.fft(z, axis=2)
        return _parts(out.reshape(len(re), -1))

    return stacked_kernel(df, [key], ["re", "im"], ["re", "im"], fn)


def irfft(df: DataFrame, key: str = "seg") -> DataFrame:
    """key, x: the real samples whose rfft this is (the Nyquist bin counts as 0), times their number."""

    def fn(re: np.ndarray, im: np.ndarray):
        n = 2 * re.shape[1]
        return (np.fft.irfft(np.pad(re + 1j * im, ((0, 0), (0, 1))), n, axis=1) * n,)

    return stacked_kernel(df, [key], ["re", "im"], ["x"], fn)


def waterfall(df: DataFrame, channels: int, key: str = "seg") -> DataFrame:
    """key, re, im: bins as [channel][bin], each channel transformed back to its time samples, unnormalised."""

    def fn(re: np.ndarray, im: np.ndarray):
        c = min(channels, re.shape[1])
        z = (re + 1j * im).reshape(len(re), c, -1)
        return _parts((np.fft.ifft(z, axis=2) * z.shape[2]).reshape(len(re), -1))

    return stacked_kernel(df, [key], ["re", "im"], ["re", "im"], fn)


def refft(df: DataFrame, channels: int, reserved: int = 0, key: str = "seg") -> DataFrame:
    """key, re, im: the whole spectrum transformed back, reserved/2 numbers cut off its end, and short forward
    transforms of `channels` numbers each: [time][channel]."""

    def fn(re: np.ndarray, im: np.ndarray):
        z = np.fft.ifft(re + 1j * im, axis=1) * re.shape[1]
        keep = (re.shape[1] - reserved // 2) // channels * channels
        return _parts(np.fft.fft(z[:, :keep].reshape(len(re), -1, channels), axis=2).reshape(len(re), -1))

    return stacked_kernel(df, [key], ["re", "im"], ["re", "im"], fn)


def cross_correlate(df: DataFrame, key: str = "seg", a: str = "a", b: str = "b") -> DataFrame:
    """key, r: modulus of the circular cross correlation of two series of n samples, n/2 lags."""

    def fn(x: np.ndarray, y: np.ndarray):
        n = x.shape[1]
        f, g = (np.fft.rfft(v, axis=1)[:, : n // 2] for v in (x, y))
        return (np.abs(np.fft.ifft(f * np.conj(g) * n**-1.5, axis=1) * (n // 2)),)

    return stacked_kernel(df, [key], [a, b], ["r"], fn)

"""Segments in chunk rows against the same segments in one row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishflow import config
from dishflow.operators import dedisperse, detect
from dishflow.operators import long_segments as L


def noisy(n: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(100, 20, n)
    x[n // 3 : n // 3 + 40] += 300
    return x + 40 * np.cos(2 * np.pi * 37 * np.arange(n) / n)


def stream(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pos long, x double")


@pytest.mark.parametrize(("n", "rows", "block", "gather"), [(16, 4, 64, 32), (4096, 64, 8, 1), (4096, 8, 64, 4), (2048, 128, 4, 2)])
def test_spectrum(spark, n, rows, block, gather):
    x = noisy(2 * n)
    lay = L.Layout(n, rows, block, gather)
    chunks = L.chunk_rows(stream(spark, x), lay)
    assert chunks.count() == 2 * rows and chunks.select(F.max(F.size("x"))).first()[0] == n // rows
    got = np.zeros((2, n // 2), complex)
    power = np.zeros(2)
    for r in L.spectrum(chunks, lay).collect():
        got[r.seg, r.row :: rows] = np.array(r.re) + 1j * np.array(r.im)
        power[r.seg] += r.power
    want = np.fft.rfft(x.reshape(2, n), axis=1)[:, : n // 2]
    assert np.allclose(got, want) and np.allclose(power, (np.abs(want) ** 2).sum(axis=1))
    some = [0, 1, n // 4 + 1, n // 2 - 1]
    for r in L.bins_of(L.spectrum(chunks, lay), lay, some).collect():
        assert r.k in some and np.isclose(r.re + 1j * r.im, want[r.seg, r.k])


def test_layout():
    assert (L.layout(1 << 28).rows, L.layout(1 << 28).cols) == (1 << 14, 1 << 14) and L.layout(1 << 11).rows == 32
    assert [L.power_of_two(n) for n in (1, 16, 17, 1000)] == [16, 16, 32, 1024]
    for n, rows in ((1000, 8), (16, 8), (16, 1), (64, 12)):
        with pytest.raises(ValueError, match="powers of two"):
            L.Layout(n, rows)


@pytest.mark.parametrize(("channels", "rows", "gather", "chunk"), [(16, 32, 4, 8), (64, 128, 32, 5), (4, 16, 1, 1000)])
def test_search_equals_that_of_one_row(spark, channels, rows, gather, chunk):
    """With reserved samples, overlapping segments, zapped bands and boxcars that reach over several chunks."""
    n = 4096
    c = config.Config(input_count=n, channel_count=channels, dm=3e-5, average_threshold=8.0, kurtosis_threshold=1.5, snr_threshold=2.0, max_boxcar=32, zap_list="1100-1110, 1300-1301", channel_threshold=0.99)
    reserved = dedisperse.reserved_samples(c)
    assert reserved > 0
    step = n - reserved
    x = noisy(step * 2 + n, 3)
    lay = L.Layout(n, rows, 16, gather)
    got = {(r.seg, r.boxcar): (r.rms, r.peak, r.hits) for r in L.pulse_search(L.chunk_rows(stream(spark, x), lay, step), lay, c, chunk).collect()}
    whole = spark.createDataFrame([(i, x[i * step : i * step + n].tolist()) for i in range(3)] + [(3, x[3 * step :].tolist() + [0.0] * (n - len(x) + 3 * step))], "seg long, x array<double>")
    want = {(r.seg, r.boxcar): (r.rms, r.peak, r.hits) for r in detect.pulse_search(whole, c).collect()}
    assert got.keys() == want.keys() and len(got) > 3
    for k, v in want.items():
        assert np.allclose(got[k], v), k


def test_boxcars_over_borders(spark):
    y = np.random.default_rng(8).normal(size=103)
    for size in (10, 103, 1, 64):
        rows = [(0, p, y[a : a + size].tolist()) for p, a in enumerate(range(0, len(y), size))]
        got = {r.boxcar: (r.rms, r.peak, r.hits) for r in L.boxcars(spark.createDataFrame(rows, "seg long, part int, y array<double>"), [1, 2, 16, 64, 128], 1.0).collect()}
        for b in (1, 2, 16, 64):
            v = y if b == 1 else np.array([y[t + 1 : t + b + 1].sum() for t in range(len(y) - b)])
            rms = np.sqrt((v * v).mean())
            assert np.allclose(got[b], (rms, v.max(), (v > rms).sum()))
        assert set(got) == {1, 2, 16, 64}


def test_channel_gate_and_size(spark):
    c = config.Config(input_count=1024, channel_count=8, dm=0.0, reserve_sample=False, average_threshold=1e-9)
    lay = L.layout(1024)
    chunks = L.chunk_rows(stream(spark, noisy(1024)), lay)
    assert L.pulse_search(chunks, lay, c).count() == 0  # all bins are zapped, so no channel is left
    with pytest.raises(ValueError, match="input_count"):
        L.pulse_search(chunks, L.layout(2048), c)

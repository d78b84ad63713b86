"""Literal fixtures, numpy oracles and what SQL doesn't reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishflow import config, formats
from dishflow.functions.windows import HAMMING, coefficients, cosine_sum
from dishflow.operators import capture, dedisperse, detect, fourier, packets, resample, rfi, unpack

BYTES = np.array([0b01100011, 0b10110110, 0b00001000, 0b10011101], np.uint8)


@pytest.mark.parametrize(
    ("bits", "want"),
    [
        (1, "0 1 1 0 0 0 1 1 1 0 1 1 0 1 1 0 0 0 0 0 1 0 0 0 1 0 0 1 1 1 0 1"),
        (2, "1 2 0 3 2 3 1 2 0 0 2 0 2 1 3 1"),
        (4, "6 3 11 6 0 8 9 13"),
        (8, "99 182 8 157"),
        (-8, "99 -74 8 -99"),
    ],
)
def test_decode(bits, want):
    assert unpack.decode(BYTES, bits).tolist() == [int(x) for x in want.split()]


def test_random_bytes_by_bit_width():
    raw = np.random.default_rng(0).integers(0, 256, 4096).astype(np.uint8)
    for bits in (1, 2, 4):
        want = [(b >> (8 - bits * (i + 1))) & ((1 << bits) - 1) for b in raw.tolist() for i in range(8 // bits)]
        assert unpack.decode(raw, bits).tolist() == want


def test_interleaving():
    x = np.arange(16)
    split = {k: [y.tolist() for y in f(x)] for k, f in unpack.SPLITS.items()}
    assert split["1212"] == [list(range(0, 16, 2)), list(range(1, 16, 2))]
    assert split["1122"] == [[0, 1, 4, 5, 8, 9, 12, 13], [2, 3, 6, 7, 10, 11, 14, 15]]
    assert split["word2"] == [[0, 1, 2, 3, 8, 9, 10, 11], [4, 5, 6, 7, 12, 13, 14, 15]]
    assert split["word4_xor"] == [list(range(128 + 4 * i, 132 + 4 * i)) for i in range(4)]
    assert unpack.SPLITS["word4_xor"](np.array([-1, -128, 0, 127] * 4, np.int8))[0].tolist() == [-129, -256, 128, 255]


def test_taper(spark):
    want = [0.08, 0.11976909, 0.23219992, 0.39785218, 0.58808309, 0.77, 0.91214782, 0.9899479]
    got = [r.w for r in spark.range(16).select("id", cosine_sum(F.col("id"), 16, (0.54, 0.46)).alias("w")).orderBy("id").collect()]
    assert np.allclose(got, want + want[::-1], atol=1e-6)
    assert np.allclose(coefficients(16, HAMMING)[:8], [25 / 46 - (0.54 - e) / 0.46 * 21 / 46 for e in want], atol=1e-6)


@pytest.mark.parametrize("n", [32, 4096])
def test_transforms(spark, n):
    rng = np.random.default_rng(n)
    x = rng.uniform(-1, 1, (3, n))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "seg long, x array<double>")
    got = {r.seg: np.array(r.re) + 1j * np.array(r.im) for r in fourier.rfft(df).collect()}
    for i in range(3):
        assert np.allclose(got[i], np.fft.rfft(x[i])[: n // 2])
    back = {r.seg: r for r in fourier.waterfall(fourier.rfft(df), 8).collect()}
    for i in range(3):
        assert np.allclose(np.array(back[i].re) + 1j * np.array(back[i].im), (np.fft.ifft(got[i].reshape(8, -1), axis=1) * (n // 16)).ravel())


def test_zap_list():
    pairs = rfi.parse_zap_list("11-12, 15-90, 233-235, 1176-1177, x, 7")
    assert pairs == [(11, 12), (15, 90), (233, 235), (1176, 1177)]
    bins = rfi.zap_bins(pairs, 1500, 0, 1499)
    assert bins == [(11, 12), (15, 90), (233, 235), (1176, 1177)] and sum(b - a + 1 for a, b in bins) == 83
    assert rfi.zap_bins([(1490, 1510)], 1500, 0, 1499) == [] and rfi.parse_zap_list("") == []
    assert rfi.zap_bins([(1405, 1410)], 64, 1437, -64) == [(27, 32)]


def test_kurtosis(spark):
    rng = np.random.default_rng(1)
    m = 1024
    noise = rng.normal(size=m) + 1j * rng.normal(size=m)
    tone = np.ones(m) + 0j
    spike = np.where(np.arange(m) == 7, 100, 1e-3) + 0j
    chans = [noise, tone, spike, np.zeros(m)]
    rows = [(0, c, t, float(z.real), float(z.imag)) for c, zs in enumerate(chans) for t, z in enumerate(zs)]
    out = rfi.zap_kurtosis(spark.createDataFrame(rows, "seg long, chan long, tm long, re double, im double"), 1.1, m)
    power = {r.chan: r.p for r in out.groupBy("chan").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("p")).collect()}
    assert power[0] > 0 and power[1] == power[2] == power[3] == 0


def test_resample_1d(spark):
    for p, n_out, want in (([1, 3, 4, 0, 2], 3, [9 / 20, 15 / 20, 6 / 20]), ([17, 25], 3, [17 / 42, 21 / 42, 25 / 42])):
        df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(p)], "k long, pos long, p double")
        out = resample.normalise_average(resample.resample_1d(df, ["k"], "pos", "p", len(p), n_out), ["k"]).orderBy("out").collect()
        assert np.allclose([r.v for r in out], want, atol=1e-5)


def test_pixmap(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-0.1,), (1.1,)], "v double").select(resample.pixmap(F.col("v")).alias("c"))
    assert [r.c for r in df.collect()] == [0xFF1F1E33, 0xFF33E1F1, 0xFFE0E1CC, 0xFFE0E1CC]


def test_phase_factor_has_norm_one(spark):
    f = F.lit(1000.0) + F.col("id") * 0.5
    re, im = dedisperse.phase_factor(dedisperse.turns(f, 1500.0, 56.778))
    assert spark.range(1000).select(F.max(F.abs(re * re + im * im - 1)).alias("d")).first().d < 1e-12


def test_reserved_samples():
    c = config.Config(input_count=1 << 20, channel_count=64, dm=0.0)
    assert dedisperse.reserved_samples(c) == 0
    c = config.Config(input_count=1 << 20, channel_count=64, dm=0.1, sample_rate=1e9)
    kept = (1 << 20) - dedisperse.reserved_samples(c)
    assert kept % 128 == 0 and (1 << 20) - kept >= 2 * round(dedisperse.max_delay(c) * c.sample_rate)


@pytest.mark.parametrize("dm", [20.0, 0.0])
def test_pulse_is_found_at_its_dispersion(spark, dm):
    n, channels, true_dm = 8192, 16, 20.0
    c = config.Config(input_count=n, channel_count=channels, dm=dm, average_threshold=1e9, kurtosis_threshold=1e9, snr_threshold=8.0, max_boxcar=4, reserve_sample=False, sample_rate=1e9)
    rng = np.random.default_rng(3)
    spectrum = np.fft.rfft(60 * (np.arange(n) == n // 2).astype(float))[: n // 2] / dedisperse.factors(n // 2, c.freq_low, c.bandwidth, true_dm)
    x = np.fft.irfft(np.append(spectrum, 0), n) + rng.normal(size=n)
    df = spark.createDataFrame([(0, x.tolist())], "seg long, x array<double>")
    hits = sum(r.hits for r in detect.pulse_search(df, c).collect())
    assert (hits > 0) == (dm == true_dm)


def test_boxcar_finds_width_and_misses_the_first_sample(spark):
    y = [0.0] * 64
    y[20:28] = [5.0] * 8
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(y)], "seg long, tm long, y double")
    peak = {r.boxcar: r.p for r in detect.boxcar(df, [1, 2, 4, 8, 16], 64).groupBy("boxcar").agg(F.max("y").alias("p")).collect()}
    assert peak == {1: 5.0, 2: 10.0, 4: 20.0, 8: 40.0, 16: 40.0}
    first = spark.createDataFrame([(0, i, 9.0 if i == 0 else 0.0) for i in range(16)], "seg long, tm long, y double")
    assert {r.boxcar: r.p for r in detect.boxcar(first, [1, 2], 16).groupBy("boxcar").agg(F.max("y").alias("p")).collect()} == {1: 9.0, 2: 0.0}


def test_running_mean_against_the_loop(spark):
    n, w = 200, 8
    x = np.random.default_rng(5).integers(0, 100, n).astype(float)
    ext, mean, want = np.append(x, x[::-1][:w]), x[:w].mean(), []
    for i in range(n):
        want.append(int(x[i] > mean))
        mean += (ext[i + w] - ext[i]) / w
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x.tolist())], "chan long, i long, x double")
    assert [r.bit for r in detect.running_mean_1bit(df, n, w).orderBy("i").collect()] == want


def test_packets(spark):
    df = spark.createDataFrame([(c, c % 7 + 1) for c in (5, 6, 8, 8, 12, 3, 20)], "counter long, b long")
    rows = {(r.block, r.slot): r.b for r in packets.blocks(df, 4, 5).collect()}
    assert rows == {(0, 0): 6, (0, 1): 7, (0, 2): 0, (0, 3): 2, (1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 6, (3, 0): 0, (3, 1): 0, (3, 2): 0, (3, 3): 7}
    stats = {r.block: (r.received, r.lost) for r in packets.loss_statistics(df, 4, 5).collect()}
    assert stats == {0: (3, 1), 1: (1, 3), 3: (1, 3)}
    filled = packets.gap_filled(df.where("counter > 3").distinct(), [], "b", span=4).orderBy("counter").collect()
    assert [r.counter for r in filled] == list(range(5, 21)) and filled[2].b == 0


def test_capture_window(spark):
    w = 100
    rows = [(1, 1000, True), (2, 1099, False), (3, 1100, False), (4, 901, False), (5, 900, False), (6, 1150, False)]
    df = spark.createDataFrame(rows, "id long, ts long, has_signal boolean")
    assert {r.id for r in capture.captured(df, w).collect()} == {1, 2, 4}
    assert {r.id for r in capture.captured(df, w, real_time=False).collect()} == {1}


def test_correlation_peak(spark):
    n, d = 4096, 64
    x = np.random.default_rng(2).integers(0, 256, n).astype(float)
    df = spark.createDataFrame([(0, x.tolist(), np.roll(x, d).tolist())], "seg long, a array<double>, b array<double>")
    r = np.array(fourier.cross_correlate(df).first().r)
    assert np.argmax(r[1:]) + 1 == n // 2 - d // 2


@pytest.mark.parametrize(("text", "want"), [("2 ** 30", 2**30), ("1000 * 1e6", 1e9), ("1405 + (64 / 2)", 1437), ("128 * 1e6", 128e6), ("-478.80", -478.8), ("-64", -64)])
def test_expressions(text, want):
    assert config.evaluate(text) == want


def test_configuration_layers():
    text = "input_count = 2 ** 11 # samples\n# dm = 3\ndm = 56.7\nfreq_low = 1405 + (64 / 2)\nchannel_count = 8\n"
    c = config.load({"dm": "1 + 1"}, config.parse_file(text), {"unknown": "1"})
    assert (c.input_count, c.dm, c.freq_low) == (2048, 2.0, 1437.0)
    with pytest.raises(ValueError):
        config.evaluate("__import__('os')")
    with pytest.raises(ValueError):
        config.Config(input_count=100, channel_count=8)


def test_formats():
    assert formats.lookup("counter64_1pol") is formats.lookup("counter64") and formats.lookup("vdif_2pol").payload_bytes == 8192
    with pytest.raises(ValueError):
        formats.lookup("nothing")


def test_mjd_and_dms(spark):
    from dishflow.functions import scalars as X

    r = spark.range(1).select(X.mjd(F.lit(0.0)).alias("m"), X.sigproc_dms(F.lit(-12.5)).alias("d"), X.bit_reverse(F.lit(1), 4).alias("b")).first()
    assert math.isclose(r.m, 40587.0) and math.isclose(r.d, -123000.0) and r.b == 8

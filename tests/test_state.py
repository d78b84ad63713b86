"""State from span to span, band lists as tables, gaps of any length, samples in SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishflow.operators import detect, packets, state, unpack


def loop(x, w, ave=None):
    """Bits and the mean behind the series, one value after the other."""
    ave = x[:w].mean() if ave is None else ave
    ext, bits = np.append(x, x[::-1][:w]), []
    for i in range(len(x)):
        bits.append(int(x[i] > ave))
        ave += (ext[i + w] - ext[i]) / w
    return bits, ave


def spans_of(spark, series, cuts):
    rows = [(c, n, x[a:b].tolist()) for c, x in series.items() for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(x)], strict=True))]
    return spark.createDataFrame(rows, "chan long, span long, x array<double>").repartition(3)


@pytest.mark.parametrize("cuts", [[], [8], [100], [9, 17, 60, 192 - 8], list(range(8, 190, 8))])
def test_state_passes_from_span_to_span(spark, cuts):
    w = 8
    series = {c: np.random.default_rng(c).integers(0, 100, 192).astype(float) for c in range(3)}
    got = {}
    for r in state.carried_mean_1bit(spans_of(spark, series, cuts), w).orderBy("chan", "span").collect():
        own = got.setdefault(r.chan, [[], 0.0])
        assert r.first == len(own[0])
        own[0] += r.bits
        own[1] = r.ave
    whole = spark.createDataFrame([(c, i, v) for c, x in series.items() for i, v in enumerate(x.tolist())], "chan long, i long, x double")
    one_row = {c: [r.bit for r in detect.running_mean_1bit(whole, 192, w).where(F.col("chan") == c).orderBy("i").collect()] for c in series}
    for c, x in series.items():
        bits, ave = loop(x, w)
        assert got[c][0] == bits == one_row[c] and np.isclose(got[c][1], ave)


def test_the_mean_is_carried_into_the_next_series(spark):
    w, series = 4, {0: np.arange(40.0) % 7, 1: np.arange(40.0)[::-1]}
    one = state.carried_mean_1bit(spans_of(spark, series, [12, 20]), w)
    last = one.where("span = 2").select("chan", "ave")
    two = state.carried_mean_1bit(spans_of(spark, series, [30]), w, last).orderBy("chan", "span").collect()
    for c, x in series.items():
        bits, ave = loop(x, w, loop(x, w)[1])
        assert sum((r.bits for r in two if r.chan == c), []) == bits and np.isclose([r.ave for r in two if r.chan == c][-1], ave)


def test_ranges_as_a_table(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), a, a + rng.randrange(-2, 40)) for a in (rng.randrange(200) for _ in range(60))] + [(7, 0, 10**9), (7, 5, 9)]
    held = {s: {k for t, a, b in rows if t == s for k in range(max(0, a), min(b, 199) + 1)} for s in range(9)}
    ranges = spark.createDataFrame(rows[:-2], "seg long, lo long, hi long")
    merged = state.merged_ranges(ranges).orderBy("seg", "lo").collect()
    assert all(a.seg != b.seg or a.hi + 1 < b.lo for a, b in zip(merged, merged[1:], strict=False))
    spectrum = spark.range(9 * 200).select(F.expr("id div 200").alias("seg"), (F.col("id") % 200).alias("k"), F.lit(1.0).alias("re"), F.lit(2.0).alias("im"))
    for width in (1, 7, 64):
        out = state.zap_table(spectrum, ranges, width=width).collect()
        assert len(out) == 9 * 200
        for r in out:
            want = (0.0, 0.0) if r.k in (held[r.seg] if r.seg < 7 else ()) else (1.0, 2.0)
            assert (r.re, r.im) == want
    plan = state.zap_table(spectrum, ranges)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_frequency_ranges(spark):
    df = spark.createDataFrame([(0, 11.0, 12.0), (0, 90.0, 15.0), (0, 1490.0, 1510.0), (0, -3.0, 5.0)], "seg long, f_lo double, f_hi double")
    assert sorted((r.lo, r.hi) for r in state.range_bins(df, 1500, 0, 1499).collect()) == [(11, 12), (15, 90)]
    assert [(r.lo, r.hi) for r in state.range_bins(df.select("seg", F.lit(1405.0).alias("f_lo"), F.lit(1410.0).alias("f_hi")).limit(1), 64, 1437, -64).collect()] == [(27, 32)]


def test_gaps_of_any_length(spark):
    df = spark.createDataFrame([(1, 3, 9), (1, 4, 9), (1, 10_000, 9), (1, 5_000_000, 9), (2, 7, 9)], "s long, counter long, b long")
    found = {(r.s, r.counter): r.gap for r in packets.gaps(df, ["s"], span=100).collect()}
    assert found == {(1, 3): 0, (1, 4): 0, (1, 10_000): 9_995, (1, 5_000_000): 4_989_999, (2, 7): 0}
    filled = packets.gap_filled(df, ["s"], "b", span=1000)
    r = filled.where("s = 1").agg(F.count("b"), F.countDistinct("counter"), F.sum("b"), F.min("counter"), F.max("counter")).first()
    assert tuple(r) == (4_999_998, 4_999_998, 36, 3, 5_000_000)


@pytest.mark.parametrize(("bits", "name"), [(1, "simple"), (8, "counter64_2pol"), (-8, "counter64_2pol"), (-8, "vdif_2pol"), (-8, "vdif_4pol"), (16, "simple"), (32, "simple")])
def test_samples_in_sql(spark, bits, name):
    rng = np.random.default_rng(5)
    raw = [(i, rng.normal(size=3 * i).astype("<f4").tobytes() if bits == 32 else rng.integers(0, 256, 21 * i).astype(np.uint8).tobytes()) for i in range(4)]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in raw], "doc_id long, raw binary")
    unpack.register_unpack(spark)
    rows = spark.sql("SELECT * FROM unpack_samples(TABLE({t}) PARTITION BY doc_id)", t=df.withColumns({"bits": F.lit(bits), "format": F.lit(name)})).collect()
    want = {(r.doc_id, r.stream): r.x for r in unpack.unpack_format(df, "doc_id", "raw", bits, name).collect() if r.x}
    got = {}
    for r in sorted(rows, key=lambda r: r.place):
        got.setdefault((r.doc_id, r.stream), []).append(r.x)
    assert got == want
    if bits != 32:
        digest = {(r.doc_id, r.stream): (r.n, r.total) for r in unpack.unpack_digest(df, "doc_id", "raw", bits, unpack.format_split(bits, name)).collect()}
        assert digest == {k: (len(v), int(sum(v))) for k, v in want.items()}

"""Queries over segments of many rows: all events are one segment, or a few that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dishflow.config import Config
from dishflow.functions.scalars import r6
from dishflow.jobs.catalogue import r3
from dishflow.operators import dedisperse, detect, rfi
from dishflow.operators import long_segments as L
from dishflow.sources.tables import samples

CHANNELS = 16
SETTINGS = {"channel_count": CHANNELS, "dm": 3e-5, "average_threshold": 5.0, "kurtosis_threshold": 3.0, "snr_threshold": 2.0, "max_boxcar": 8, "zap_list": "1100-1110", "channel_threshold": 0.95}
_C = Config(input_count=1024, **SETTINGS)  # the whole stream is padded, which raises kurtosis
_LEAST = 2 * int(dedisperse.max_delay(_C) * _C.sample_rate + 0.5)
_ZAP = rfi.parse_zap_list(_C.zap_list)


def whole_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, L.Layout]:
    """All events as one segment of the next power of two, in chunk rows of about the root of its size."""
    s = samples(spark, sf_dir, 1).select(F.col("seg").alias("pos"), "x")
    lay = L.layout(L.power_of_two(s.agg(F.max("pos")).first()[0] + 1))
    return L.chunk_rows(s, lay), lay


#: m: n = a * b samples. The same sums as in Spark's steps 1 and 2, which are two short ones in place of n for each bin.
S_WHOLE = """e AS (SELECT event_id AS pos, ((round(value * 100)::BIGINT) % 256)::DOUBLE AS x FROM events),
    lg AS (SELECT greatest(4, ceil(log2(max(pos) + 1)))::INTEGER AS g FROM e), m AS (SELECT (1::BIGINT << g) AS n, (1::BIGINT << (g // 2)) AS a, (1::BIGINT << (g - g // 2)) AS b FROM lg)"""
S_BINS = f"""{S_WHOLE}, one AS (SELECT pos % b AS c, k1, sum(x * cos(2 * pi() * ((pos // b * k1) % a) / a)) AS re, sum(-x * sin(2 * pi() * ((pos // b * k1) % a) / a)) AS im FROM e, m, range((SELECT a FROM m)) t(k1) GROUP BY 1, 2),
    f AS (SELECT k1 + a * k2 AS k, sum(re * cos(2 * pi() * ((c * (k1 + a * k2)) % n) / n) + im * sin(2 * pi() * ((c * (k1 + a * k2)) % n) / n)) AS re,
                 sum(im * cos(2 * pi() * ((c * (k1 + a * k2)) % n) / n) - re * sin(2 * pi() * ((c * (k1 + a * k2)) % n) / n)) AS im FROM one, m, range((SELECT b // 2 FROM m)) t(k2) GROUP BY 1)"""
_BAND = " OR ".join(f"k BETWEEN round(({lo} - {_C.freq_low}) / {_C.bandwidth} * (n // 2 - 1)) AND round(({hi} - {_C.freq_low}) / {_C.bandwidth} * (n // 2 - 1))" for lo, hi in _ZAP)
_FR = f"({_C.freq_low} + k * {_C.bandwidth} / (n // 2))"
_TURNS = f"({dedisperse.DISPERSION} * 1e6 * {_C.dm} / {_FR} * (({_FR} - {_C.freq_top}) / {_C.freq_top}) * (({_FR} - {_C.freq_top}) / {_C.freq_top}))"
S_CHANNELS = f"""{S_BINS}, z AS (SELECT k, n, n // {2 * CHANNELS} AS len, CASE WHEN re * re + im * im > {_C.average_threshold} * avg(re * re + im * im) OVER () OR {_BAND} THEN 0 ELSE sqrt({CHANNELS}) / (n // 2) END AS f, re, im FROM f, m),
    h AS (SELECT k, n, len, f, re, im, cos(-2 * pi() * ({_TURNS} % 1.0)) AS c, sin(-2 * pi() * ({_TURNS} % 1.0)) AS q FROM z),
    d AS (SELECT k, len, f * (re * c - im * q) AS re, f * (re * q + im * c) AS im FROM h),
    w AS (SELECT k // len AS chan, tm, any_value(len) AS len, sum(re * cos(2 * pi() * ((k % len) * tm % len) / len) - im * sin(2 * pi() * ((k % len) * tm % len) / len)) AS re,
                 sum(re * sin(2 * pi() * ((k % len) * tm % len) / len) + im * cos(2 * pi() * ((k % len) * tm % len) / len)) AS im FROM d, range((SELECT n // {2 * CHANNELS} FROM m)) t(tm) GROUP BY 1, 2)"""
S_SEARCH = f"""{S_CHANNELS}, u AS (SELECT chan, tm, len, re * re + im * im AS p FROM w),
    v AS (SELECT chan, tm, len, p, CASE WHEN sum(p) OVER c = 0 THEN NULL ELSE len * sum(p * p) OVER c / (sum(p) OVER c * sum(p) OVER c) END AS sk FROM u WINDOW c AS (PARTITION BY chan)),
    y AS (SELECT chan, tm, CASE WHEN sk > {_C.kurtosis_threshold} * (len - 1) / (len + 1) + 1 OR sk < {2 - _C.kurtosis_threshold} * (len - 1) / (len + 1) + 1 THEN 0 ELSE p END AS p FROM v),
    r AS (SELECT n // {2 * CHANNELS} - (n - (n - {_LEAST}) // {2 * CHANNELS} * {2 * CHANNELS}) // {CHANNELS} AS keep FROM m),
    o AS (SELECT tm, sum(p) AS y FROM y, r WHERE tm < keep AND (SELECT count(*) FROM y WHERE tm = 0 AND p = 0) < {_C.channel_threshold * CHANNELS!r} GROUP BY tm),
    ts AS (SELECT tm, y - avg(y) OVER () AS y FROM o), bx AS (""" + " UNION ALL ".join(
    "SELECT 1 AS boxcar, tm, y FROM ts" if b == 1 else f"SELECT {b} AS boxcar, tm, sum(y) OVER (ORDER BY tm ROWS BETWEEN 1 FOLLOWING AND {b} FOLLOWING) AS y FROM ts QUALIFY tm < (SELECT keep FROM r) - {b}" for b in (1, 2, 4, 8)
) + ")"


def long_segment_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some bins of the spectrum of the whole stream."""
    chunks, lay = whole_stream(spark, sf_dir)
    found = L.bins_of(L.spectrum(chunks, lay), lay, [i * (lay.n // 2 - 1) // 17 for i in range(18)])
    return found.select("k", (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


def long_segment_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of each channel and its first and last samples, cleaned and dedispersed."""
    chunks, lay = whole_stream(spark, sf_dir)
    spectra = L.channels_of(L.spectrum(chunks, lay), lay, Config(input_count=lay.n, **SETTINGS))
    p = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    return spectra.select("chan", r3(F.aggregate(p, F.lit(0.0), lambda a, v: a + v)).alias("p"), r6(F.get("re", F.lit(0))).alias("first_re"), r6(F.get("im", F.size("im") - 1)).alias("last_im"))


def long_pulse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over the whole stream as one segment, without the samples that dispersion spoils."""
    chunks, lay = whole_stream(spark, sf_dir)
    found = L.pulse_search(chunks, lay, Config(input_count=lay.n, **SETTINGS))
    return found.select("boxcar", r3(F.col("rms")).alias("rms"), r3(F.col("peak")).alias("peak"), "hits")


OVERLAP = Config(input_count=512, **SETTINGS | {"kurtosis_threshold": 1.6})
RESERVED = dedisperse.reserved_samples(OVERLAP)


def reserved_pulse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in one row each that read what dispersion spoils again: each begins where the good samples of the last end."""
    s = samples(spark, sf_dir, 1).select(F.col("seg").alias("pos"), "x")
    lay = L.layout(OVERLAP.input_count, 2)
    chunks = L.chunk_rows(s, lay, OVERLAP.input_count - RESERVED)
    halves = F.transform(F.array_sort(F.collect_list(F.struct((F.col("row") % 2).alias("half"), "x"))), lambda h: h["x"])
    # a segment whose second half lies behind the last sample is padded
    whole = F.slice(F.concat(F.flatten(halves), F.array_repeat(F.lit(0.0), lay.cols)), 1, lay.n)
    found = detect.pulse_search(chunks.groupBy(F.expr("row div 2").alias("seg")).agg(whole.alias("x")), OVERLAP)
    return found.select("seg", "boxcar", r3(F.col("rms")).alias("rms"), r3(F.col("peak")).alias("peak"), "hits")


_N, _BINS, _LEN = OVERLAP.input_count, OVERLAP.bins, OVERLAP.bins // CHANNELS
_KEEP = _LEN - RESERVED // CHANNELS
_LO, _HI = rfi.kurtosis_limits(OVERLAP.kurtosis_threshold, _LEN)
_Z = " OR ".join(f"k BETWEEN {a} AND {b}" for a, b in rfi.zap_bins(_ZAP, _BINS, OVERLAP.freq_low, OVERLAP.bandwidth))
_FRO = f"({_C.freq_low} + k * {_C.bandwidth / _BINS!r})"
_TURNO = _TURNS.replace(_FR, _FRO)
S_RESERVED = f"""e AS (SELECT event_id AS pos, ((round(value * 100)::BIGINT) % 256)::DOUBLE AS x FROM events),
    s AS (SELECT pos // {_N - RESERVED} - i AS seg, pos - (pos // {_N - RESERVED} - i) * {_N - RESERVED} AS pos, x FROM e, range({-(-_N // (_N - RESERVED))}) t(i) WHERE pos // {_N - RESERVED} - i >= 0 AND pos - (pos // {_N - RESERVED} - i) * {_N - RESERVED} < {_N}),
    f AS (SELECT seg, k, sum(x * cos(2 * pi() * ((k * pos) % {_N}) / {_N})) AS re, sum(-x * sin(2 * pi() * ((k * pos) % {_N}) / {_N})) AS im FROM s, range({_BINS}) t(k) GROUP BY 1, 2),
    z AS (SELECT seg, k, CASE WHEN re * re + im * im > {_C.average_threshold} * avg(re * re + im * im) OVER (PARTITION BY seg) OR {_Z} THEN 0 ELSE sqrt({CHANNELS}) / {_BINS} END AS f, re, im FROM f),
    h AS (SELECT seg, k, f, re, im, cos(-2 * pi() * ({_TURNO} % 1.0)) AS c, sin(-2 * pi() * ({_TURNO} % 1.0)) AS q FROM z), d AS (SELECT seg, k, f * (re * c - im * q) AS re, f * (re * q + im * c) AS im FROM h),
    w AS (SELECT seg, k // {_LEN} AS chan, tm, sum(re * cos(2 * pi() * ((k % {_LEN}) * tm % {_LEN}) / {_LEN}) - im * sin(2 * pi() * ((k % {_LEN}) * tm % {_LEN}) / {_LEN})) AS re,
                 sum(re * sin(2 * pi() * ((k % {_LEN}) * tm % {_LEN}) / {_LEN}) + im * cos(2 * pi() * ((k % {_LEN}) * tm % {_LEN}) / {_LEN})) AS im FROM d, range({_LEN}) t(tm) GROUP BY 1, 2, 3),
    u AS (SELECT seg, chan, tm, re * re + im * im AS p FROM w),
    v AS (SELECT seg, chan, tm, p, CASE WHEN sum(p) OVER c = 0 THEN NULL ELSE {_LEN} * sum(p * p) OVER c / (sum(p) OVER c * sum(p) OVER c) END AS sk FROM u WINDOW c AS (PARTITION BY seg, chan)),
    y AS (SELECT seg, chan, tm, CASE WHEN sk > {_HI!r} OR sk < {_LO!r} THEN 0 ELSE p END AS p FROM v),
    ok AS (SELECT seg FROM y GROUP BY seg HAVING sum(CASE WHEN tm = 0 AND p = 0 THEN 1 ELSE 0 END) < {_C.channel_threshold * CHANNELS!r}),
    o AS (SELECT seg, tm, sum(p) AS y FROM y WHERE tm < {_KEEP} AND seg IN (SELECT seg FROM ok) GROUP BY 1, 2), ts AS (SELECT seg, tm, y - avg(y) OVER (PARTITION BY seg) AS y FROM o), bx AS (""" + " UNION ALL ".join(
    "SELECT seg, 1 AS boxcar, tm, y FROM ts" if b == 1 else f"SELECT seg, {b} AS boxcar, tm, sum(y) OVER (PARTITION BY seg ORDER BY tm ROWS BETWEEN 1 FOLLOWING AND {b} FOLLOWING) AS y FROM ts QUALIFY tm < {_KEEP - b}" for b in (1, 2, 4, 8) if b < _KEEP
) + ")"
_STATS = "round(any_value(rms), 3) + 0.0 AS rms, round(max(y), 3) + 0.0 AS peak, sum(CASE WHEN y > {snr} * rms THEN 1 ELSE 0 END)::BIGINT AS hits".format(snr=_C.snr_threshold)

QUERIES = {f.__name__: f for f in (long_segment_bins, long_segment_waterfall, long_pulse_search, reserved_pulse_search)}
SQL = {
    "long_segment_bins": f"""WITH {S_WHOLE}, w AS (SELECT DISTINCT i * (n // 2 - 1) // 17 AS k FROM m, range(18) t(i))
        SELECT k, round(sum(x * cos(2 * pi() * ((k * pos) % n) / n)), 3) + 0.0 AS re, round(sum(-x * sin(2 * pi() * ((k * pos) % n) / n)), 3) + 0.0 AS im FROM e, m, w GROUP BY k""",
    "long_segment_waterfall": f"""WITH {S_CHANNELS} SELECT chan, round(sum(re * re + im * im), 3) + 0.0 AS p, round(sum(CASE WHEN tm = 0 THEN re ELSE 0 END), 6) + 0.0 AS first_re, round(sum(CASE WHEN tm = len - 1 THEN im ELSE 0 END), 6) + 0.0 AS last_im FROM w GROUP BY chan""",
    "long_pulse_search": f"WITH {S_SEARCH}, g AS (SELECT *, sqrt(avg(y * y) OVER (PARTITION BY boxcar)) AS rms FROM bx) SELECT boxcar::INTEGER AS boxcar, {_STATS} FROM g GROUP BY boxcar",
    "reserved_pulse_search": f"WITH {S_RESERVED}, g AS (SELECT *, sqrt(avg(y * y) OVER (PARTITION BY seg, boxcar)) AS rms FROM bx) SELECT seg, boxcar::INTEGER AS boxcar, {_STATS} FROM g GROUP BY seg, boxcar",
}

"""Registered queries of the signal operators, each beside SQL that says the same in joins and sums."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dishflow.config import Config
from dishflow.functions import scalars as X
from dishflow.functions.scalars import r6
from dishflow.functions.windows import HAMMING, HANN, cosine_sum
from dishflow.operators import capture, dedisperse, detect, fourier, headers, packets, resample, rfi, unpack
from dishflow.sources.tables import documents_bytes, samples, segments, table, vectors
from dishflow.sources.tables import packets as packet_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Of the queries over events.
N, CHANNELS = 256, 8
BINS, LENGTH = N // 2, N // 2 // CHANNELS
CONFIG = Config(input_count=N, channel_count=CHANNELS, dm=0.05, average_threshold=5.0, kurtosis_threshold=1.6, snr_threshold=2.0, max_boxcar=8, reserve_sample=False, zap_list="1100-1110", channel_threshold=0.9)
_PI = "pi()"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- SQL building blocks ---------------------------------------------------------------------------------------------
S_SAMPLES = f"s AS (SELECT event_id // {N} AS seg, event_id % {N} AS pos, ((round(value * 100)::BIGINT) % 256)::DOUBLE AS x FROM events)"
S_SPECTRUM = f"""{S_SAMPLES}, f AS (SELECT seg, k, sum(x * cos(-2 * pi() * ((k * pos) % {N}) / {N})) AS re, sum(x * sin(-2 * pi() * ((k * pos) % {N}) / {N})) AS im
    FROM s, range({BINS}) t(k) GROUP BY seg, k)"""
_LO, _HI = rfi.kurtosis_limits(CONFIG.kurtosis_threshold, LENGTH)
_ZAP = rfi.zap_bins(rfi.parse_zap_list(CONFIG.zap_list), BINS, CONFIG.freq_low, CONFIG.bandwidth)
_TURNS = "({d} * 1e6 * {dm} / fr * ((fr - {fc}) / {fc}) * ((fr - {fc}) / {fc}))".format(d=dedisperse.DISPERSION, dm=CONFIG.dm, fc=CONFIG.freq_top)
S_CLEAN = f"""{S_SPECTRUM}, a AS (SELECT *, re * re + im * im AS p, avg(re * re + im * im) OVER (PARTITION BY seg) AS m FROM f),
    z AS (SELECT seg, k, CASE WHEN p > {CONFIG.average_threshold} * m OR {" OR ".join(f"k BETWEEN {a} AND {b}" for a, b in _ZAP)} THEN 0 ELSE re * {math.sqrt(CHANNELS) / BINS!r} END AS re,
                 CASE WHEN p > {CONFIG.average_threshold} * m OR {" OR ".join(f"k BETWEEN {a} AND {b}" for a, b in _ZAP)} THEN 0 ELSE im * {math.sqrt(CHANNELS) / BINS!r} END AS im FROM a),
    g AS (SELECT *, {CONFIG.freq_low} + k * {CONFIG.bandwidth / BINS!r} AS fr FROM z),
    h AS (SELECT *, cos(-2 * pi() * ({_TURNS} % 1.0)) AS c, sin(-2 * pi() * ({_TURNS} % 1.0)) AS q FROM g),
    d AS (SELECT seg, k, re * c - im * q AS re, re * q + im * c AS im FROM h)"""
S_WATER = f"""{S_CLEAN}, w AS (SELECT seg, k // {LENGTH} AS chan, tm, sum(re * cos(2 * pi() * ((k % {LENGTH}) * tm % {LENGTH}) / {LENGTH}) - im * sin(2 * pi() * ((k % {LENGTH}) * tm % {LENGTH}) / {LENGTH})) AS re,
        sum(re * sin(2 * pi() * ((k % {LENGTH}) * tm % {LENGTH}) / {LENGTH}) + im * cos(2 * pi() * ((k % {LENGTH}) * tm % {LENGTH}) / {LENGTH})) AS im
    FROM d, range({LENGTH}) t(tm) GROUP BY seg, k // {LENGTH}, tm)"""
S_KURT = f"""{S_WATER}, u AS (SELECT *, re * re + im * im AS p FROM w),
    v AS (SELECT *, CASE WHEN sum(p) OVER c = 0 THEN NULL ELSE {LENGTH} * sum(p * p) OVER c / (sum(p) OVER c * sum(p) OVER c) END AS sk FROM u WINDOW c AS (PARTITION BY seg, chan)),
    y AS (SELECT seg, chan, tm, CASE WHEN sk > {_HI!r} OR sk < {_LO!r} THEN 0 ELSE p END AS p FROM v)"""
S_SERIES = f"""{S_KURT}, ok AS (SELECT seg FROM y GROUP BY seg HAVING sum(CASE WHEN tm = 0 AND p = 0 THEN 1 ELSE 0 END) < {CONFIG.channel_threshold * CHANNELS!r}),
    t0 AS (SELECT seg, tm, sum(p) AS y FROM y WHERE seg IN (SELECT seg FROM ok) GROUP BY seg, tm), ts AS (SELECT seg, tm, y - avg(y) OVER (PARTITION BY seg) AS y FROM t0)"""
S_BOX = S_SERIES + ", bx AS (" + " UNION ALL ".join(
    f"SELECT seg, 1 AS boxcar, tm, y FROM ts" if b == 1 else f"SELECT seg, {b} AS boxcar, tm, sum(y) OVER (PARTITION BY seg ORDER BY tm ROWS BETWEEN 1 FOLLOWING AND {b} FOLLOWING) AS y FROM ts QUALIFY tm < {LENGTH - b}" for b in (1, 2, 4, 8)
) + ")"


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _r3(x: str) -> str:
    """For sums of powers, which are large."""
    return f"round({x}, 3) + 0.0"


def r3(x: Column) -> Column:
    return F.round(x, 3) + F.lit(0.0)


# --- Spark building blocks -------------------------------------------------------------------------------------------
def segment_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(samples(spark, sf_dir, N), N)


def to_long(df: DataFrame, name: str = "k", key: str = "seg") -> DataFrame:
    return df.select(key, F.posexplode(F.arrays_zip("re", "im")).alias("p", "z")).select(key, F.col("p").cast("long").alias(name), "z.re", "z.im")


def to_segments(df: DataFrame) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct("k", "re", "im")))
    return df.groupBy("seg").agg(cells.alias("c")).select("seg", F.transform("c", lambda z: z["re"]).alias("re"), F.transform("c", lambda z: z["im"]).alias("im"))


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(fourier.rfft(segment_form(spark, sf_dir)))


def dynamic_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seg, chan, tm, re, im, piece by piece: what pulse_search does in one kernel."""
    clean = rfi.zap_ranges(rfi.zap_average(spectrum(spark, sf_dir), CONFIG.average_threshold, normalise=(BINS, CHANNELS)), _ZAP)
    moved = dedisperse.dedisperse(clean, BINS, CONFIG.freq_low, CONFIG.bandwidth, CONFIG.dm)
    long = to_long(fourier.waterfall(to_segments(moved), CHANNELS))
    return long.select("seg", F.floor(F.col("k") / LENGTH).cast("long").alias("chan"), (F.col("k") % LENGTH).alias("tm"), "re", "im")


def cleaned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rfi.zap_kurtosis(dynamic_spectrum(spark, sf_dir), CONFIG.kurtosis_threshold, LENGTH)
    good = rfi.enough_channels(kept, CHANNELS, CONFIG.channel_threshold)
    return detect.without_baseline(detect.time_series(good))


# --- scan ------------------------------------------------------------------------------------------------------------
@query(f"WITH {S_SAMPLES} SELECT seg, count(*) AS n, sum(x) AS total, max(pos) AS last_pos FROM s GROUP BY seg")
def segment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir, N).groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.max("pos").alias("last_pos"))


_STEP, _SIZE = 192, 256


@query(f"""WITH e AS (SELECT event_id, ((round(value * 100)::BIGINT) % 256)::DOUBLE AS x FROM events),
    o AS (SELECT event_id // {_STEP} - i AS seg, event_id, x FROM e, range(2) t(i))
    SELECT seg, count(*) AS n, sum(x * (event_id - seg * {_STEP} + 1)) AS checksum FROM o WHERE seg >= 0 AND event_id - seg * {_STEP} < {_SIZE} GROUP BY seg""")
def segment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 256 samples every 192: a sample lists the segments that hold it."""
    x = (F.round(F.col("value") * 100).cast("long") % 256).cast("double")
    e = table(spark, sf_dir, "events").select("event_id", x.alias("x"))
    last = F.floor(F.col("event_id") / _STEP).cast("long")
    both = e.withColumn("seg", F.explode(F.filter(F.sequence(last - 1, last), lambda s: (s >= 0) & (F.col("event_id") - s * _STEP < _SIZE))))
    return both.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * (F.col("event_id") - F.col("seg") * _STEP + 1)).alias("checksum"))


# --- packets ---------------------------------------------------------------------------------------------------------
S_PACKETS = "p AS (SELECT event_id AS counter, (round(value * 100)::BIGINT) % 256 AS b FROM events WHERE event_id % 97 <> 13)"
_BLOCK, _FIRST = 64, 5


@query(f"""WITH {S_PACKETS}, o AS (SELECT (counter - {_FIRST}) // {_BLOCK} AS block, (counter - {_FIRST}) % {_BLOCK} AS slot, b FROM p WHERE counter >= {_FIRST})
    SELECT d.block, r.slot::BIGINT AS slot, coalesce(o.b, 0)::BIGINT AS b FROM (SELECT DISTINCT block FROM o) d CROSS JOIN range({_BLOCK}) r(slot) LEFT JOIN o ON o.block = d.block AND o.slot = r.slot""")
def packet_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.blocks(packet_rows(spark, sf_dir), _BLOCK, _FIRST).select("block", "slot", "b")


@query(f"""WITH e AS (SELECT event_id // 3 AS counter, event_id, (round(value * 100)::BIGINT) % 256 AS b FROM events WHERE event_id // 3 % 97 <> 13 AND event_id // 3 >= {_FIRST}),
    o AS (SELECT (counter - {_FIRST}) // {_BLOCK} AS block, (counter - {_FIRST}) % {_BLOCK} AS slot, arg_max(b, event_id) AS b FROM e GROUP BY 1, 2)
    SELECT d.block, r.slot::BIGINT AS slot, coalesce(o.b, 0)::BIGINT AS b FROM (SELECT DISTINCT block FROM o) d CROSS JOIN range({_BLOCK}) r(slot) LEFT JOIN o ON o.block = d.block AND o.slot = r.slot""")
def packet_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counter comes three times; the packet that arrives last stays."""
    x = F.round(F.col("value") * 100).cast("long") % 256
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).cast("long").alias("counter"), F.col("event_id").alias("at"), x.alias("b")).where("counter % 97 <> 13")
    return packets.blocks(rows, _BLOCK, _FIRST, arrival="at").select("block", "slot", "b")


@query(f"""WITH {S_PACKETS}, e AS (SELECT min(counter) AS a, max(counter) AS z FROM p)
    SELECT r.c AS counter, coalesce(p.b, 0)::BIGINT AS b FROM e, range((SELECT a FROM e), (SELECT z FROM e) + 1) r(c) LEFT JOIN p ON p.counter = r.c""")
def packet_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.gap_filled(packet_rows(spark, sf_dir), [], "b")


@query(f"""WITH {S_PACKETS}, o AS (SELECT (counter - {_FIRST}) // {_BLOCK} AS block, count(DISTINCT counter) AS received FROM p WHERE counter >= {_FIRST} GROUP BY 1)
    SELECT block, received, {_BLOCK} - received AS lost, {_r(f"({_BLOCK} - received) / {_BLOCK}.0")} AS rate,
    {_r(f"(sum({_BLOCK} - received) OVER w)::DOUBLE / (sum({_BLOCK}) OVER w)")} AS total_rate FROM o WINDOW w AS (ORDER BY block)""")
def packet_loss_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = packets.loss_statistics(packet_rows(spark, sf_dir), _BLOCK, _FIRST)
    return s.select("block", "received", F.col("lost").cast("long").alias("lost"), r6(F.col("rate")).alias("rate"), r6(F.col("total_rate")).alias("total_rate"))


_VDIF_SQL = {"l_orderkey": 0, "l_partkey": 1, "l_suppkey": 2, "l_linenumber": 3}


@query(f"""SELECT l_orderkey, l_linenumber, {", ".join(f"(l_{('orderkey', 'partkey', 'suppkey', 'linenumber')[w]}::BIGINT * 2654435761 % 4294967296 >> {a} & {(1 << n) - 1})::BIGINT AS {k}" for k, (w, a, n) in packets.VDIF.items() if w < 4)} FROM lineitem""")
def vdif_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    words = [F.col(c).cast("long") * 2654435761 % 4294967296 for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")] + [F.lit(0).cast("long")] * 4
    return t.select("l_orderkey", "l_linenumber", *(x.alias(k) for k, x in packets.vdif_fields(words).items() if packets.VDIF[k][0] < 4))


@query("""SELECT doc_id, list_sum(list_transform(range(8), lambda i: (('0x' || substr(hex(encode(text)), (2 * i + 1)::INT, 2))::BIGINT & CASE WHEN i = 7 THEN 127 ELSE 255 END) << (8 * i)::INT))::BIGINT AS counter,
    greatest(octet_length(encode(text)) - 8, 0)::BIGINT AS payload_bytes FROM documents WHERE octet_length(encode(text)) >= 8""")
def packet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as packets with a 64-bit counter in front; its top bit is cleared, as counters never reach it."""
    d = documents_bytes(spark, sf_dir).where(F.octet_length("raw") >= 8)
    top = F.concat(F.expr("substring(raw, 1, 7)"), F.unhex(F.lpad(F.hex(X.byte_at(F.col("raw"), 7).bitwiseAND(F.lit(127))), 2, "0")))
    p = packets.parse(d.withColumn("raw8", top), "raw8", 8)
    return p.select("doc_id", "counter", (F.octet_length("raw") - 8).cast("long").alias("payload_bytes"))


# --- unpack ----------------------------------------------------------------------------------------------------------
S_BYTES = "l AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents), b AS (SELECT doc_id, generate_subscripts(h, 1) - 1 AS i, ('0x' || unnest(h))::INT AS v FROM l)"


def _digest_sql(rows: str, more: str = "") -> str:
    return f"WITH {S_BYTES}{more} SELECT doc_id, stream::INTEGER AS stream, count(*) AS n, sum(v)::BIGINT AS total, sum((p % 251 + 1) * v)::BIGINT AS checksum FROM ({rows}) GROUP BY doc_id, stream"


def _register_unpack() -> None:
    signed = ", c AS (SELECT doc_id, i, CASE WHEN v >= 128 THEN v - 256 ELSE v END AS v FROM b), m AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id)"
    i16 = ", e AS (SELECT doc_id, i // 2 AS p, sum(CASE WHEN i % 2 = 0 THEN v ELSE 256 * v END) AS u, count(*) AS c FROM b GROUP BY doc_id, i // 2)"
    cases = {
        **{f"unpack_u{n}": (n, "", f"SELECT doc_id, 0 AS stream, i * {8 // n} + j AS p, (v >> (8 - {n} * (j + 1))::INT) & {(1 << n) - 1} AS v FROM b, range({8 // n}) t(j)", "") for n in (1, 2, 4)},
        "unpack_i8": (-8, "", "SELECT doc_id, 0 AS stream, i AS p, v FROM c", signed),
        "unpack_i16": (-16, "", "SELECT doc_id, 0 AS stream, p, CASE WHEN u >= 32768 THEN u - 65536 ELSE u END AS v FROM e WHERE c = 2", i16),
        "unpack_u16": (16, "", "SELECT doc_id, 0 AS stream, p, u AS v FROM e WHERE c = 2", i16),
        "deinterleave_1212": (8, "1212", "SELECT b.doc_id, i % 2 AS stream, i // 2 AS p, v FROM b JOIN m USING (doc_id) WHERE i < n // 2 * 2", signed),
        "deinterleave_1122": (-8, "1122", "SELECT c.doc_id, i % 4 // 2 AS stream, 2 * (i // 4) + i % 2 AS p, v FROM c JOIN m USING (doc_id) WHERE i < n // 4 * 4", signed),
        "deinterleave_word2": (-8, "word2", "SELECT c.doc_id, i % 8 // 4 AS stream, 4 * (i // 8) + i % 4 AS p, v FROM c JOIN m USING (doc_id) WHERE i < n // 8 * 8", signed),
        "deinterleave_word4_xor": (-8, "word4_xor", "SELECT c.doc_id, i % 16 // 4 AS stream, 4 * (i // 16) + i % 4 AS p, CASE WHEN v >= 0 THEN v + 128 ELSE v - 128 END AS v FROM c JOIN m USING (doc_id) WHERE i < n // 16 * 16", signed),
    }
    for name, (bits, how, rows, more) in cases.items():
        QUERIES[name] = lambda spark, sf_dir, bits=bits, how=how: unpack.unpack_digest(documents_bytes(spark, sf_dir), "doc_id", "raw", bits, how)
        SQL[name] = _digest_sql(rows, more)


_register_unpack()


# --- taper -----------------------------------------------------------------------------------------------------------
def _window(coefficients: tuple[float, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = samples(spark, sf_dir, N).withColumn("w", cosine_sum(F.col("pos"), N, coefficients))
        return w.groupBy("seg").agg(r6(F.sum(F.col("x") * F.col("w"))).alias("tapered"), r6(F.sum("w")).alias("total_weight"))

    return run


for _name, _a in (("window_hann", HANN), ("window_hamming", HAMMING)):
    QUERIES[_name] = _window(_a)
    SQL[_name] = f"WITH {S_SAMPLES}, t AS (SELECT *, {_a[0]!r} - {_a[1]!r} * cos(2 * pi() * pos / {N - 1}) AS w FROM s) SELECT seg, {_r('sum(x * w)')} AS tapered, {_r('sum(w)')} AS total_weight FROM t GROUP BY seg"


@query(f"""WITH {S_SAMPLES}, t AS (SELECT *, {HAMMING[0]!r} - {HAMMING[1]!r} * cos(2 * pi() * pos / {N - 1}) AS w FROM s)
    SELECT seg, pos, {_r("x * w")} AS applied, {_r("x * w / w")} AS removed FROM t""")
def window_apply_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = cosine_sum(F.col("pos"), N, HAMMING)
    t = samples(spark, sf_dir, N).withColumn("a", F.col("x") * w)
    return t.select("seg", "pos", r6(F.col("a")).alias("applied"), r6(F.coalesce(F.try_divide(F.col("a"), w), F.lit(0.0))).alias("removed"))


# --- transforms ------------------------------------------------------------------------------------------------------
@query(f"WITH {S_SPECTRUM} SELECT seg, k::BIGINT AS k, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM f")
def rfft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum(spark, sf_dir).select("seg", "k", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


S_COMPLEX = "v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT vec_id, i // 2 AS j, sum(CASE WHEN i % 2 = 0 THEN x ELSE 0 END) AS re, sum(CASE WHEN i % 2 = 1 THEN x ELSE 0 END) AS im FROM v GROUP BY vec_id, i // 2)"


def _complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, re, im: embeddings as 32 complex numbers."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    every = lambda o: F.transform(F.sequence(F.lit(0), (F.size("e") / 2).cast("int") - 1), lambda i: F.get("e", 2 * i + o))
    return e.select("vec_id", every(0).alias("re"), every(1).alias("im"))


def _dft_sql(sign: str, n: int = 32, src: str = "c", key: str = "vec_id") -> str:
    a = f"({sign}2 * pi() * ((k * j) % {n}) / {n})"
    return f"SELECT {key}, k, sum(re * cos{a} - im * sin{a}) AS re, sum(re * sin{a} + im * cos{a}) AS im FROM {src}, range({n}) t(k) GROUP BY {key}, k"


def _rounded(df: DataFrame, key: str = "vec_id") -> DataFrame:
    return to_long(df, key=key).select(key, "k", r6(F.col("re")).alias("re"), r6(F.col("im")).alias("im"))


for _name, _sign, _inverse in (("c2c_forward", "-", False), ("c2c_backward", "", True)):
    QUERIES[_name] = lambda spark, sf_dir, inverse=_inverse: _rounded(fourier.fft(_complex(spark, sf_dir), "vec_id", inverse=inverse))
    SQL[_name] = f"WITH {S_COMPLEX}, o AS ({_dft_sql(_sign)}) SELECT vec_id, k::BIGINT AS k, {_r('re')} AS re, {_r('im')} AS im FROM o"


@query(f"""WITH {S_COMPLEX}, t AS ({_dft_sql("")}), u AS (SELECT vec_id, k // 8 AS row_no, k % 8 AS j, re, im FROM t),
    o AS (SELECT vec_id, row_no, k, sum(re * cos(-2 * pi() * ((k * j) % 8) / 8) - im * sin(-2 * pi() * ((k * j) % 8) / 8)) AS re, sum(re * sin(-2 * pi() * ((k * j) % 8) / 8) + im * cos(-2 * pi() * ((k * j) % 8) / 8)) AS im FROM u, range(8) r(k) GROUP BY vec_id, row_no, k)
    SELECT vec_id, (8 * row_no + k)::BIGINT AS k, {_r("re")} AS re, {_r("im")} AS im FROM o""")
def ifft_refft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fourier.refft(_complex(spark, sf_dir), 8, key="vec_id"))


@query(f"""WITH {S_COMPLEX} SELECT vec_id, m::BIGINT AS k, {_r("sum(CASE WHEN j = 0 THEN re ELSE 2 * (re * cos(2 * pi() * ((m * j) % 64) / 64) - im * sin(2 * pi() * ((m * j) % 64) / 64)) END)")} AS x FROM c, range(64) t(m) GROUP BY vec_id, m""")
def c2r(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fourier.irfft(_complex(spark, sf_dir), "vec_id")
    return x.select("vec_id", F.posexplode("x").alias("k", "x")).select("vec_id", F.col("k").cast("long").alias("k"), r6(F.col("x")).alias("x"))


@query(f"WITH {S_WATER} SELECT seg, chan::BIGINT AS chan, tm::BIGINT AS tm, {_r3('re')} AS re, {_r3('im')} AS im FROM w")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamic_spectrum(spark, sf_dir).select("seg", "chan", "tm", r3(F.col("re")).alias("re"), r3(F.col("im")).alias("im"))


@query("SELECT event_id, list_sum(list_transform(range(16), lambda i: ((event_id % 65536) >> i::INT & 1) << (15 - i)::INT))::BIGINT AS reversed FROM events")
def bit_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.bit_reverse(F.col("event_id") % 65536, 16).alias("reversed"))


# --- excision --------------------------------------------------------------------------------------------------------
@query(f"""WITH {S_SPECTRUM}, a AS (SELECT *, re * re + im * im > {CONFIG.average_threshold} * avg(re * re + im * im) OVER (PARTITION BY seg) AS hit FROM f)
    SELECT seg, k::BIGINT AS k, {_r(f"CASE WHEN hit THEN 0 ELSE re * {math.sqrt(CHANNELS) / BINS!r} END")} AS re, {_r(f"CASE WHEN hit THEN 0 ELSE im * {math.sqrt(CHANNELS) / BINS!r} END")} AS im FROM a""")
def rfi_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = rfi.zap_average(spectrum(spark, sf_dir), CONFIG.average_threshold, normalise=(BINS, CHANNELS))
    return z.select("seg", "k", r6(F.col("re")).alias("re"), r6(F.col("im")).alias("im"))


@query(f"""WITH {S_SPECTRUM}, a AS (SELECT *, re * re + im * im > {CONFIG.average_threshold} * avg(re * re + im * im) OVER (PARTITION BY seg) AS hit FROM f)
    SELECT seg, k::BIGINT AS k, CASE WHEN hit THEN 0 ELSE round(re, 4) + 0.0 END AS re, CASE WHEN hit THEN 0 ELSE round(im, 4) + 0.0 END AS im FROM a""")
def rfi_average_unscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = rfi.zap_average(spectrum(spark, sf_dir), CONFIG.average_threshold)
    return z.select("seg", "k", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query(f"""WITH {S_SPECTRUM} SELECT seg, k::BIGINT AS k, CASE WHEN {" OR ".join(f"k BETWEEN {a} AND {b}" for a, b in _ZAP)} THEN 0 ELSE round(re, 4) + 0.0 END AS re FROM f""")
def rfi_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = rfi.zap_ranges(spectrum(spark, sf_dir), _ZAP)
    return z.select("seg", "k", (F.round("re", 4) + 0.0).alias("re"))


@query(f"""WITH {S_KURT} SELECT seg, chan::BIGINT AS chan, tm::BIGINT AS tm, {_r3("p")} AS p FROM y""")
def rfi_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = rfi.zap_kurtosis(dynamic_spectrum(spark, sf_dir), CONFIG.kurtosis_threshold, LENGTH)
    return z.select("seg", "chan", "tm", r3(X.power(F.col("re"), F.col("im"))).alias("p"))


@query(f"""WITH {S_WATER}, u AS (SELECT *, re * re + im * im AS p FROM w),
    v AS (SELECT *, CASE WHEN sum(p) OVER c = 0 THEN NULL ELSE {LENGTH} * sum(p * p) OVER c / (sum(p) OVER c * sum(p) OVER c) END AS sk, avg(sqrt(p)) OVER c AS amp FROM u WINDOW c AS (PARTITION BY seg, chan))
    SELECT seg, chan::BIGINT AS chan, tm::BIGINT AS tm, {_r(f"CASE WHEN sk > {_HI!r} OR sk < {_LO!r} OR amp = 0 THEN 0 ELSE re / amp END")} AS re FROM v""")
def rfi_kurtosis_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = rfi.zap_kurtosis(dynamic_spectrum(spark, sf_dir), CONFIG.kurtosis_threshold, LENGTH, normalise=True)
    return z.select("seg", "chan", "tm", r6(F.col("re")).alias("re"))


@query(f"WITH {S_KURT} SELECT seg, sum(CASE WHEN tm = 0 AND p = 0 THEN 1 ELSE 0 END)::BIGINT AS zeros FROM y GROUP BY seg")
def zero_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfi.zero_channels(rfi.zap_kurtosis(dynamic_spectrum(spark, sf_dir), CONFIG.kurtosis_threshold, LENGTH))


# --- dedispersion ----------------------------------------------------------------------------------------------------
_F = "(1000 + (event_id % 5000) * 0.1)"


@query(f"SELECT event_id, round(-4148.808 * 56.778 * (1 / ({_F} * {_F}) - 1 / 2250000.0), 9) + 0.0 AS delay FROM events")
def delay_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.lit(1000.0) + (F.col("event_id") % 5000) * F.lit(0.1)
    return table(spark, sf_dir, "events").select("event_id", (F.round(dedisperse.delay(f, F.lit(1500.0), 56.778), 9) + 0.0).alias("delay"))


def _phase(turns: Callable[[Column, float, float], Column]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        re, im = dedisperse.phase_factor(turns(F.lit(1000.0) + (F.col("event_id") % 5000) * F.lit(0.1), 1500.0, 0.05))
        return table(spark, sf_dir, "events").select("event_id", (F.round(re, 4) + 0.0).alias("re"), (F.round(im, 4) + 0.0).alias("im"))

    return run


QUERIES["phase_factor"], QUERIES["phase_factor_v1"] = _phase(dedisperse.turns), _phase(dedisperse.turns_with_delay)
for _name, _k in (("phase_factor", f"4148.808e6 * 0.05 / {_F} * (({_F} - 1500) / 1500) * (({_F} - 1500) / 1500)"), ("phase_factor_v1", f"4148.808e6 * 0.05 * (1 / ({_F} * {_F}) - 1 / 2250000.0) * {_F}")):
    SQL[_name] = f"WITH p AS (SELECT event_id, ({_k}) % 1.0 AS t FROM events) SELECT event_id, round(cos(-2 * pi() * t), 4) + 0.0 AS re, round(sin(-2 * pi() * t), 4) + 0.0 AS im FROM p"


@query(f"WITH {S_CLEAN} SELECT seg, k::BIGINT AS k, {_r3('re')} AS re, {_r3('im')} AS im FROM d")
def dedisperse_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = rfi.zap_ranges(rfi.zap_average(spectrum(spark, sf_dir), CONFIG.average_threshold, normalise=(BINS, CHANNELS)), _ZAP)
    d = dedisperse.dedisperse(clean, BINS, CONFIG.freq_low, CONFIG.bandwidth, CONFIG.dm)
    return d.select("seg", "k", r3(F.col("re")).alias("re"), r3(F.col("im")).alias("im"))


# --- reductions and search -------------------------------------------------------------------------------------------
@query(f"WITH {S_SAMPLES} SELECT seg, {_r('sum(sin(x))')} AS total, {_r('avg(sin(x))')} AS mean FROM s GROUP BY seg")
def map_sum_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir, N).groupBy("seg").agg(r6(F.sum(F.sin("x"))).alias("total"), r6(F.avg(F.sin("x"))).alias("mean"))


@query("SELECT l_orderkey % 1307 AS batch, round(sum(l_extendedprice), 2) AS s1, round(sum(l_quantity * l_quantity), 2) AS s2, count(*) AS n FROM lineitem GROUP BY 1")
def segmented_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sums in one pass, segments of any length."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 1307).alias("batch"))
    return t.agg(F.round(F.sum("l_extendedprice"), 2).alias("s1"), F.round(F.sum(F.col("l_quantity") * F.col("l_quantity")), 2).alias("s2"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {S_SAMPLES} SELECT seg, pos, sum(x) OVER (PARTITION BY seg ORDER BY pos) AS total FROM s")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return samples(spark, sf_dir, N).select("seg", "pos", F.sum("x").over(order).alias("total"))


@query(f"WITH {S_KURT} SELECT seg, tm::BIGINT AS tm, {_r3('sum(p)')} AS y FROM y GROUP BY seg, tm")
def time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = rfi.zap_kurtosis(dynamic_spectrum(spark, sf_dir), CONFIG.kurtosis_threshold, LENGTH)
    return detect.time_series(z).select("seg", "tm", r3(F.col("y")).alias("y"))


@query(f"WITH {S_SERIES} SELECT seg, tm::BIGINT AS tm, {_r3('y')} AS y FROM ts")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_series(spark, sf_dir).select("seg", "tm", r3(F.col("y")).alias("y"))


@query(f"WITH {S_SAMPLES}, t AS (SELECT seg, x - avg(x) OVER (PARTITION BY seg) AS y FROM s), r AS (SELECT *, sqrt(avg(y * y) OVER (PARTITION BY seg)) AS rms FROM t) SELECT seg, {_r('any_value(rms)')} AS rms, {_r('max(y)')} AS peak, sum(CASE WHEN y > 1.5 * rms THEN 1 ELSE 0 END)::BIGINT AS hits FROM r GROUP BY seg")
def count_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = detect.without_baseline(samples(spark, sf_dir, N).withColumnRenamed("x", "y"))
    return detect.count_signal(series, 1.5, ("seg",)).select("seg", r6(F.col("rms")).alias("rms"), r6(F.col("peak")).alias("peak"), "hits")


@query(f"WITH {S_BOX} SELECT seg, boxcar::INTEGER AS boxcar, tm::BIGINT AS tm, {_r3('y')} AS y FROM bx")
def boxcar_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = detect.boxcar(cleaned_series(spark, sf_dir), [1, 2, 4, 8], LENGTH)
    return b.select("seg", F.col("boxcar").cast("int").alias("boxcar"), "tm", r3(F.col("y")).alias("y"))


@query(f"""WITH {S_BOX}, r AS (SELECT *, sqrt(avg(y * y) OVER (PARTITION BY seg, boxcar)) AS rms FROM bx)
    SELECT seg, boxcar::INTEGER AS boxcar, {_r3("any_value(rms)")} AS rms, {_r3("max(y)")} AS peak, sum(CASE WHEN y > {CONFIG.snr_threshold} * rms THEN 1 ELSE 0 END)::BIGINT AS hits FROM r GROUP BY seg, boxcar""")
def pulse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.pulse_search(segment_form(spark, sf_dir), CONFIG)
    return found.select("seg", "boxcar", r3(F.col("rms")).alias("rms"), r3(F.col("peak")).alias("peak"), "hits")


@query("""WITH s AS (SELECT event_id // 1000 AS chan, event_id % 1000 AS i, (round(value * 100)::BIGINT) % 256 AS x FROM events),
    e AS (SELECT * FROM s UNION ALL SELECT chan, 1999 - i, x FROM s WHERE i >= 992),
    m AS (SELECT chan, i, x, avg(x) OVER (PARTITION BY chan ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS mean FROM e)
    SELECT chan, i, (CASE WHEN x > mean THEN 1 ELSE 0 END)::INTEGER AS bit FROM m WHERE i < 1000""")
def running_mean_1bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, 1000).withColumnsRenamed({"seg": "chan", "pos": "i"})
    return detect.running_mean_1bit(s, 1000, 8)


# --- display ---------------------------------------------------------------------------------------------------------
S_VEC = "v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"""WITH {S_VEC}, o AS (SELECT *, greatest(0, least(i + 1, (oo + 1) * 64 / 24.0) - greatest(i, oo * 64 / 24.0)) AS w FROM v, range(24) t(oo))
    SELECT vec_id, oo::INTEGER AS "out", {_r("sum(w * x * x)")} AS v FROM o WHERE w > 1e-9 GROUP BY vec_id, oo""")
def area_resample_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("p", F.col("x") * F.col("x"))
    return resample.resample_1d(v, ["vec_id"], "pos", "p", 64, 24).select("vec_id", F.col("out").cast("int").alias("out"), r6(F.col("v")).alias("v"))


def _image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.floor(F.col("pos") / 8).cast("long").alias("y"), (F.col("pos") % 8).alias("x"), (F.col("x") * F.col("x")).alias("p"))


S_AREA = f"""{S_VEC}, g AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, x * x AS p FROM v),
    o1 AS (SELECT vec_id, oy, x, sum(greatest(0, least(y + 1, (oy + 1) * 8 / 3.0) - greatest(y, oy * 8 / 3.0)) * p) AS p FROM g, range(3) t(oy) GROUP BY vec_id, oy, x)"""


@query(f"WITH {S_AREA} SELECT vec_id, oy::INTEGER AS oy, ox::INTEGER AS ox, {_r('sum(greatest(0, least(x + 1, (ox + 1) * 8 / 5.0) - greatest(x, ox * 8 / 5.0)) * p)')} AS v FROM o1, range(5) t(ox) GROUP BY vec_id, oy, ox")
def resample_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample_area(_image(spark, sf_dir), ["vec_id"], "p", (8, 3), (8, 5)).select("vec_id", "oy", "ox", r6(F.col("v")).alias("v"))


@query(f"""WITH {S_AREA}, n AS (SELECT ox, ox * 8 / 5.0 AS a, floor(ox * 8 / 5.0) AS l, least(floor(ox * 8 / 5.0) + 1, 7) AS r FROM range(5) t(ox))
    SELECT vec_id, oy::INTEGER AS oy, ox::INTEGER AS ox, {_r("sum((CASE WHEN x = l THEN 1 - (a - l) ELSE 0 END + CASE WHEN x = r THEN a - l ELSE 0 END) * p)")} AS v FROM o1 JOIN n ON x = l OR x = r GROUP BY vec_id, oy, ox""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample_linear(_image(spark, sf_dir), ["vec_id"], "p", (8, 3), (8, 5)).select("vec_id", "oy", "ox", r6(F.col("v")).alias("v"))


@query(f"WITH {S_VEC} SELECT vec_id, i::BIGINT AS pos, {_r('x * x / (2 * avg(x * x) OVER (PARTITION BY vec_id))')} AS v FROM v")
def normalise_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("vec_id", "pos", (F.col("x") * F.col("x")).alias("v"))
    return resample.normalise_average(v, ["vec_id"]).select("vec_id", "pos", r6(F.col("v")).alias("v"))


_A, _B = X.color(resample.COLOR_0), X.color(resample.COLOR_1)
S_MIX = " + ".join(f"floor((1 - v) * {_A >> s & 255} + v * {_B >> s & 255})::BIGINT * {1 << s}" for s in (16, 8, 0))
_VALUE = "(((round(value * 100)::BIGINT) % 120) - 10) / 100.0"


@query(f"WITH t AS (SELECT event_id, ({_VALUE})::DOUBLE AS v FROM events) SELECT event_id, CASE WHEN v >= 0 AND v <= 1 THEN 4278190080 + {S_MIX} ELSE {X.color(resample.COLOR_OUT)} END::BIGINT AS argb FROM t")
def pixmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.round(F.col("value") * 100).cast("long") % 120 - 10) / F.lit(100.0)
    return table(spark, sf_dir, "events").select("event_id", resample.pixmap(v).alias("argb"))


@query("""WITH p AS (SELECT event_id, event_id * 2654435761 % 4294967296 AS c FROM events)
    SELECT event_id, (c >> 24 & 255)::BIGINT AS a, (c >> 16 & 255)::BIGINT AS r, (c >> 8 & 255)::BIGINT AS g, (c & 255)::BIGINT AS b, c::BIGINT AS packed FROM p""")
def argb_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2654435761 % 4294967296).alias("c"))
    f = p.select("event_id", *(X.argb_field(F.col("c"), s).alias(n) for n, s in (("a", 24), ("r", 16), ("g", 8), ("b", 0))))
    return f.withColumn("packed", X.argb(F.col("a"), F.col("r"), F.col("g"), F.col("b")))


@query(f"WITH {S_WATER} SELECT seg, (chan // 2)::BIGINT AS cz, (tm // 4)::BIGINT AS tz, {_r3('sum(re * re + im * im)')} AS p FROM w GROUP BY 1, 2, 3")
def spectrum_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dynamic_spectrum(spark, sf_dir).groupBy("seg", F.floor(F.col("chan") / 2).cast("long").alias("cz"), F.floor(F.col("tm") / 4).cast("long").alias("tz"))
    return d.agg(r3(F.sum(X.power(F.col("re"), F.col("im")))).alias("p"))


@query("SELECT user_id, arg_max(event_id, ts) AS latest FROM events GROUP BY user_id")
def latest_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("latest"))


# --- joins, sinks, scalars, flow -------------------------------------------------------------------------------------
@query(f"""WITH {S_VEC}, f AS (SELECT vec_id, k, sum(x * cos(-2 * pi() * ((k * i) % 64) / 64)) AS re, sum(x * sin(-2 * pi() * ((k * i) % 64) / 64)) AS im FROM v, range(32) t(k) GROUP BY vec_id, k),
    q AS (SELECT a.vec_id, a.k AS j, (a.re * b.re + a.im * b.im) / 512 AS re, (a.im * b.re - a.re * b.im) / 512 AS im FROM f a JOIN f b ON b.vec_id = a.vec_id + 1 AND a.k = b.k WHERE a.vec_id % 2 = 0),
    o AS ({_dft_sql("", 32, "q")}) SELECT vec_id, k::BIGINT AS lag, {_r("sqrt(re * re + im * im)")} AS r FROM o""")
def cross_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 2i and 2i+1 as two streams of the same segment: an equal join, then one kernel."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pairs = e.where("vec_id % 2 = 0").select("vec_id", F.col("e").alias("a")).join(e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b")), "vec_id")
    r = fourier.cross_correlate(pairs, "vec_id").select("vec_id", F.posexplode("r").alias("lag", "r"))
    return r.select("vec_id", F.col("lag").cast("long").alias("lag"), r6(F.col("r")).alias("r"))


_W = 30_000_000


@query(f"""WITH e AS (SELECT event_id, epoch_us(ts) AS ts, value > 150 AS has_signal FROM events)
    SELECT event_id FROM e WHERE EXISTS (SELECT 1 FROM e p WHERE p.has_signal AND abs(p.ts - e.ts) < {_W})""")
def capture_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("value") > 150).alias("has_signal"))
    return capture.captured(e, _W).select("event_id")


@query(f"WITH {S_SAMPLES}, n AS (SELECT seg, count(*) AS n FROM s GROUP BY seg) SELECT seg, (n - 64)::BIGINT AS bytes_kept, (sum(n - 64) OVER (ORDER BY seg) - (n - 64))::BIGINT AS byte_offset FROM n WHERE n > 64")
def record_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each segment that a continuous recording keeps, and where they begin in the file."""
    n = samples(spark, sf_dir, N).groupBy("seg").agg((F.count(F.lit(1)) - 64).alias("bytes_kept")).where("bytes_kept > 0")
    return packets.running_totals(n, ["bytes_kept"], "seg").select("seg", "bytes_kept", (F.col("upto_bytes_kept") - F.col("bytes_kept")).alias("byte_offset"))


@query("SELECT event_id, coalesce(nullif(user_id, 0), epoch_us(ts))::VARCHAR || '.bin' AS file_name FROM events WHERE value > 150")
def capture_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are named by the packet counter, or by time where there is none."""
    t = table(spark, sf_dir, "events").where("value > 150")
    name = F.coalesce(F.when(F.col("user_id") != 0, F.col("user_id")), F.unix_micros(F.col("ts").cast("timestamp")))
    return t.select("event_id", F.concat(name.cast("string"), F.lit(".bin")).alias("file_name"))


@query(f"""WITH {S_COMPLEX} SELECT vec_id, j::BIGINT AS j, {_r("re * re + im * im")} AS norm, {_r("sqrt(re * re + im * im)")} AS modulus, {_r("-im")} AS conj_im, {_r("re * re - im * im")} AS sq_re, {_r("2 * re * im")} AS sq_im FROM c""")
def complex_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = to_long(_complex(spark, sf_dir), "j", "vec_id")
    re, im = F.col("re"), F.col("im")
    sq_re, sq_im = X.complex_mul(re, im, re, im)
    return z.select("vec_id", "j", r6(X.power(re, im)).alias("norm"), r6(X.complex_abs(re, im)).alias("modulus"), r6(-im).alias("conj_im"), r6(sq_re).alias("sq_re"), r6(sq_im).alias("sq_im"))


@query(f"WITH t AS (SELECT event_id, value * 3 - 100 AS v FROM events) SELECT event_id, {_r('CASE WHEN v < 0 THEN ceil(v) ELSE floor(v) END')} AS whole, {_r('v % 1.0')} AS part FROM t")
def modf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") * 3 - 100
    return table(spark, sf_dir, "events").select("event_id", r6(X.truncated(v)).alias("whole"), r6(X.fraction(v)).alias("part"))


@query("SELECT event_id, round(epoch_us(ts) * 1000.0::DOUBLE / 86400e9 + 2440587.5 - 2400000.5, 6) AS mjd, ((event_id + 6) // 7)::BIGINT AS groups_of_7 FROM events")
def mjd(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * F.lit(1000.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(X.mjd(ns), 6).alias("mjd"), X.divide_up(F.col("event_id"), 7).alias("groups_of_7"))


@query(f"""WITH t AS (SELECT event_id, value - 50 AS v, floor(abs(value - 50)) AS d, abs(value - 50) - floor(abs(value - 50)) AS f FROM events)
    SELECT event_id, round(sign(v) * (d * 10000 + floor(f * 60) * 100 + (f * 60 - floor(f * 60)) * 60), 4) + 0.0 AS dms FROM t""")
def sigproc_dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.round(X.sigproc_dms(F.col("value") - 50), 4) + 0.0).alias("dms"))


@query("SELECT event_type, sum(n)::BIGINT AS n, round(sum(v), 2) AS v FROM (SELECT event_type, 1 AS n, value AS v FROM events WHERE value > 50 UNION ALL SELECT event_type, 1, 0 FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def tee_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One input, two consumers, one output."""
    e = table(spark, sf_dir, "events")
    a = e.where("value > 50").select("event_type", F.col("value").alias("v"))
    b = e.where("event_id % 2 = 0").select("event_type", F.lit(0.0).alias("v"))
    return a.unionByName(b).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("v"))


@query(f"WITH {S_SAMPLES}, t AS (SELECT seg, pos, x * ({HANN[0]} - {HANN[1]} * cos(2 * pi() * pos / {N - 1})) AS x FROM s), m AS (SELECT *, x - avg(x) OVER (PARTITION BY seg) AS y FROM t) SELECT seg, {_r('sqrt(avg(y * y))')} AS rms FROM m GROUP BY seg")
def compose_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of transforms."""
    taper = lambda d: d.withColumn("y", F.col("x") * cosine_sum(F.col("pos"), N, HANN))
    rms = lambda d: d.groupBy("seg").agg(r6(F.sqrt(F.avg(F.col("y") * F.col("y")))).alias("rms"))
    return samples(spark, sf_dir, N).transform(taper).transform(detect.without_baseline).transform(rms)


# --- more of the same ------------------------------------------------------------------------------------------------
@query("""WITH t AS (SELECT p_partkey, p_size || '-' || (p_size + 3) || ', ' || p_size || ', ' || (p_partkey % 90) || ' -' || (p_partkey % 90 + 7) AS l FROM part),
    i AS (SELECT p_partkey, unnest(string_split(l, ',')) AS item FROM t), e AS (SELECT p_partkey, list_filter(string_split(item, '-'), lambda x: trim(x) <> '') AS ends FROM i)
    SELECT p_partkey, trim(ends[1])::DOUBLE AS lo, trim(ends[2])::DOUBLE AS hi FROM e WHERE len(ends) = 2""")
def zap_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band lists in a column: items that aren't two numbers are skipped."""
    text = F.concat_ws("", F.col("p_size"), F.lit("-"), F.col("p_size") + 3, F.lit(", "), F.col("p_size"), F.lit(", "), F.col("p_partkey") % 90, F.lit(" -"), F.col("p_partkey") % 90 + 7)
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(text, ",")).alias("item")).withColumn("ends", rfi.zap_ends(F.col("item")))
    return found.where(F.size("ends") == 2).select("p_partkey", F.col("ends")[0].alias("lo"), F.col("ends")[1].alias("hi"))


@query("SELECT p_partkey, (4278190080 + p_partkey * 7919 % 16777216)::BIGINT AS argb FROM part")
def color_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#rrggbb texts as opaque ARGB."""
    text = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")))
    return table(spark, sf_dir, "part").withColumn("color", text).select("p_partkey", X.color_column(F.col("color")).alias("argb"))


@query("""WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) > 0 AS alive FROM embeddings), g AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, alive FROM v),
    n AS (SELECT a.vec_id, a.y, a.x, a.alive, sum(CASE WHEN b.alive THEN 1 ELSE 0 END) AS n FROM g a JOIN g b ON a.vec_id = b.vec_id AND (b.y - a.y + 8) % 8 IN (0, 1, 7) AND (b.x - a.x + 8) % 8 IN (0, 1, 7) AND NOT (a.y = b.y AND a.x = b.x) GROUP BY ALL)
    SELECT vec_id, y::BIGINT AS y, x::BIGINT AS x, (n = 3 OR (alive AND n = 2)) AS alive FROM n""")
def life_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of B3/S23 on a torus: every live cell tells its neighbours, the counts meet the cells."""
    cells = vectors(spark, sf_dir).select("vec_id", F.floor(F.col("pos") / 8).cast("long").alias("y"), (F.col("pos") % 8).alias("x"), (F.col("x") > 0).alias("alive"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]))
    told = cells.where("alive").select("vec_id", "y", "x", around.alias("o")).select("vec_id", F.pmod(F.col("y") + F.col("o.dy"), F.lit(8)).alias("y"), F.pmod(F.col("x") + F.col("o.dx"), F.lit(8)).alias("x"))
    counts = told.groupBy("vec_id", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    next_ = (F.col("n") == 3) | (F.col("alive") & (F.col("n") == 2))
    return cells.join(counts, ["vec_id", "y", "x"], "left").select("vec_id", "y", "x", F.coalesce(next_, F.lit(False)).alias("alive"))


@query("""SELECT s_suppkey, '0B000000' || hex('source_name') || lpad(hex(length(s_name)), 2, '0') || '000000' || hex(s_name) AS header FROM supplier""")
def sigproc_header_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header entry for each name: strings with their length, a little-endian 32-bit integer, before them."""
    made = headers.header_entries(table(spark, sf_dir, "supplier"), "s_suppkey", "source_name", "s_name")
    return made.select("s_suppkey", F.hex("entry").alias("header"))


@query(f"WITH {S_BYTES} SELECT doc_id, count(*) AS n, sum(v)::BIGINT AS total FROM b WHERE i >= 16 GROUP BY doc_id")
def header_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples behind a header of 16 bytes."""
    d = documents_bytes(spark, sf_dir).where(F.octet_length("raw") > 16).select("doc_id", F.expr("substring(raw, 17)").alias("raw"))
    return unpack.unpack_digest(d, "doc_id", "raw", 8).select("doc_id", "n", "total")

"""Queries over formats by name, floats, band lists as tables, state from span to span, and a table function in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dishflow import config
from dishflow.functions import scalars as X
from dishflow.functions.scalars import r6
from dishflow.jobs.catalogue import BINS, CONFIG, S_AREA, S_BYTES, S_MIX, S_SPECTRUM, spectrum
from dishflow.operators import packets, resample, state, unpack
from dishflow.sources.tables import documents_bytes, samples, table

#: As in a configuration file: values are expressions.
SETTINGS = "input_bits = 2 ** 3 # of a sample\nformat = vdif_2pol\nfreq_low = 1405 + (64 / 2)\nbandwidth = -64\n"
_LOADED = config.load({"input_bits": "-(2 ** 3)"}, config.parse_file(SETTINGS))


def unpack_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout and width of samples come from the configuration: signed bytes of two polarisations, four and four."""
    return unpack.unpack_digest(documents_bytes(spark, sf_dir), "doc_id", "raw", _LOADED.input_bits, unpack.format_split(_LOADED.input_bits, _LOADED.format))


def unpack_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function, called from SQL over partitions of a table."""
    unpack.register_unpack(spark)
    rows = documents_bytes(spark, sf_dir).select("doc_id", "raw", F.lit(8).alias("bits"), F.lit("counter64_2pol").alias("format"))
    return spark.sql(
        """SELECT doc_id, stream, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, CAST(sum((place % 251 + 1) * x) AS BIGINT) AS checksum
        FROM unpack_samples(TABLE({rows}) PARTITION BY doc_id) GROUP BY doc_id, stream""",
        rows=rows,
    )


def _packed(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """key, raw: arrays v of numbers as little-endian floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.values.to_numpy(zero_copy_only=False).astype(f"<f{bits // 8}").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[key, "raw"])

    return rows.select(key, "v").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, raw binary")


def _floats(bits: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Prices as packed floats of that many bits, and back."""
        t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_extendedprice").cast("double").alias("v")).alias("c"))
        own = t.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["v"]).alias("v"))
        found = unpack.unpack(_packed(own, "l_orderkey", bits), "l_orderkey", "raw", bits).select("l_orderkey", F.posexplode("x").alias("place", "x"))
        return found.select("l_orderkey", F.col("place").cast("long").alias("place"), F.round("x", 4).alias("x"))

    return run


def vdif_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 63-bit counter in words 6 and 7 of a header."""
    t = table(spark, sf_dir, "lineitem")
    words = [F.lit(0).cast("long")] * 6 + [F.col(c).cast("long") * 2654435761 % 4294967296 for c in ("l_orderkey", "l_partkey")]
    return t.select("l_orderkey", "l_linenumber", packets.vdif_counter(words).alias("counter"))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seg, f_lo, f_hi: up to five bands of each segment, from orders: some overlap, some are reversed, some leave the band."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    lo = F.lit(CONFIG.freq_low - 20) + F.col("o_orderkey") * 37 % 540
    return o.select((F.col("o_orderkey") % 41).alias("seg"), lo.cast("double").alias("f_lo"), (lo + F.col("o_custkey") % 23 - 4).cast("double").alias("f_hi")).where("seg % 4 <> 1 AND f_lo % 11 < 2")


def zap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment has its own list of bands, in a table."""
    bins = state.range_bins(_ranges(spark, sf_dir), BINS, CONFIG.freq_low, CONFIG.bandwidth)
    z = state.zap_table(spectrum(spark, sf_dir), bins, width=16)
    return z.select("seg", "k", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


_W, _CHAN = 8, 1000


def carried_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running mean over spans of unequal length, whose state passes from one to the next."""
    s = samples(spark, sf_dir, _CHAN).select(F.col("seg").alias("chan"), "pos", "x", F.floor(F.sqrt(F.col("pos") / 40)).cast("long").alias("span"))
    spans = s.groupBy("chan", "span").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("x"))
    bits = state.carried_mean_1bit(spans, _W)
    return bits.select("chan", "first", F.posexplode("bits").alias("p", "bit")).select("chan", (F.col("first") + F.col("p")).alias("i"), F.col("bit").cast("int").alias("bit"))


def image_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 images: resampled by area, scaled to their mean, coloured."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    cells = v.select("vec_id", F.floor(F.col("pos") / 8).cast("long").alias("y"), (F.col("pos") % 8).cast("long").alias("x"), (F.col("v").cast("double") * F.col("v").cast("double")).alias("p"))
    small = resample.resample_area(cells, ["vec_id"], "p", (8, 3), (8, 5))
    scaled = resample.normalise_average(small, ["vec_id"])
    return scaled.select("vec_id", "oy", "ox", r6(F.col("v")).alias("v"), resample.pixmap(F.round("v", 6)).alias("argb"))


QUERIES = {f.__name__: f for f in (unpack_by_format, unpack_in_sql, vdif_counter, zap_table, carried_mean, image_chain)}
QUERIES |= {"unpack_f32": _floats(32), "unpack_f64": _floats(64)}
_SIGNED = "c AS (SELECT doc_id, i, CASE WHEN v >= 128 THEN v - 256 ELSE v END AS v FROM b), m AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id)"
_FLOATS = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS place, round(l_extendedprice{cast}, 4) AS x FROM lineitem"
SQL = {
    "unpack_by_format": f"""WITH {S_BYTES}, {_SIGNED} SELECT doc_id, stream::INTEGER AS stream, count(*) AS n, sum(v)::BIGINT AS total, sum((p % 251 + 1) * v)::BIGINT AS checksum
        FROM (SELECT c.doc_id, i % 8 // 4 AS stream, 4 * (i // 8) + i % 4 AS p, v FROM c JOIN m USING (doc_id) WHERE i < n // 8 * 8) GROUP BY doc_id, stream""",
    "unpack_in_sql": f"""WITH {S_BYTES}, {_SIGNED} SELECT doc_id, stream::INTEGER AS stream, count(*) AS n, sum(v)::BIGINT AS total, sum((p % 251 + 1) * v)::BIGINT AS checksum
        FROM (SELECT b.doc_id, i % 2 AS stream, i // 2 AS p, v FROM b JOIN m USING (doc_id) WHERE i < n // 2 * 2) GROUP BY doc_id, stream""",
    "unpack_f32": _FLOATS.format(cast="::REAL::DOUBLE"),
    "unpack_f64": _FLOATS.format(cast="::DOUBLE"),
    "vdif_counter": "SELECT l_orderkey, l_linenumber, (l_orderkey::BIGINT * 2654435761 % 4294967296 + ((l_partkey::BIGINT * 2654435761 % 4294967296) & 2147483647) * 4294967296)::BIGINT AS counter FROM lineitem",
    "zap_table": f"""WITH {S_SPECTRUM}, o AS (SELECT o_orderkey % 41 AS seg, ({CONFIG.freq_low - 20} + o_orderkey * 37 % 540)::DOUBLE AS lo, ({CONFIG.freq_low - 20} + o_orderkey * 37 % 540 + o_custkey % 23 - 4)::DOUBLE AS hi FROM orders WHERE o_orderkey % 3 <> 0),
        r AS (SELECT DISTINCT seg, least(round((lo - {CONFIG.freq_low}) / {CONFIG.bandwidth} * {BINS - 1}), round((hi - {CONFIG.freq_low}) / {CONFIG.bandwidth} * {BINS - 1})) AS a, greatest(round((lo - {CONFIG.freq_low}) / {CONFIG.bandwidth} * {BINS - 1}), round((hi - {CONFIG.freq_low}) / {CONFIG.bandwidth} * {BINS - 1})) AS z
            FROM o WHERE seg % 4 <> 1 AND lo % 11 < 2),
        h AS (SELECT DISTINCT seg, k FROM r, range({BINS}) t(k) WHERE a >= 0 AND z < {BINS} AND k BETWEEN a AND z)
        SELECT f.seg, f.k::BIGINT AS k, CASE WHEN h.k IS NULL THEN round(re, 4) + 0.0 ELSE 0 END AS re, CASE WHEN h.k IS NULL THEN round(im, 4) + 0.0 ELSE 0 END AS im FROM f LEFT JOIN h ON h.seg = f.seg AND h.k = f.k""",
    "carried_mean": f"""WITH s AS (SELECT event_id // {_CHAN} AS chan, event_id % {_CHAN} AS i, (round(value * 100)::BIGINT) % 256 AS x FROM events), n AS (SELECT chan, max(i) + 1 AS n FROM s GROUP BY chan),
        e AS (SELECT chan, i, x FROM s UNION ALL SELECT chan, 2 * n - 1 - i, x FROM s JOIN n USING (chan) WHERE i >= n - {_W}), m AS (SELECT chan, i, x, avg(x) OVER (PARTITION BY chan ORDER BY i ROWS BETWEEN CURRENT ROW AND {_W - 1} FOLLOWING) AS mean FROM e)
        SELECT chan, i, (CASE WHEN x > mean THEN 1 ELSE 0 END)::INTEGER AS bit FROM m JOIN n USING (chan) WHERE i < n""",
    "image_chain": f"""WITH {S_AREA}, o2 AS (SELECT vec_id, oy, ox, sum(greatest(0, least(x + 1, (ox + 1) * 8 / 5.0) - greatest(x, ox * 8 / 5.0)) * p) AS p FROM o1, range(5) t(ox) GROUP BY vec_id, oy, ox),
        o3 AS (SELECT vec_id, oy, ox, avg(p) OVER (PARTITION BY vec_id) AS m, p FROM o2), o4 AS (SELECT vec_id, oy, ox, round(CASE WHEN m > 1.1920929e-07 THEN p / (2 * m) ELSE p END, 6) + 0.0 AS v FROM o3)
        SELECT vec_id, oy::INTEGER AS oy, ox::INTEGER AS ox, v, (CASE WHEN v >= 0 AND v <= 1 THEN 4278190080 + {S_MIX} ELSE {X.color(resample.COLOR_OUT)} END)::BIGINT AS argb FROM o4""",
}

"""Queries that write files to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dishflow.jobs.catalogue import CONFIG, N, S_BOX, S_SAMPLES, segment_form
from dishflow.operators import capture, captures, detect
from dishflow.sources import capture_sink
from dishflow.sources.baseband import BasebandSource
from dishflow.sources.store import shared_folder
from dishflow.sources.tables import samples

WINDOW = 300  # of the capture policy, in samples: a positive's neighbours are kept too
KEPT, FILE_SEGMENTS = 64, 4  # bytes that a segment reads again; segments of a file of a recording
HEADER, FILE, STEP, SIZE = 16, 1500, 192, 256  # of stored baseband files: bytes before the samples, samples, and segments read


def _bytes(values: Column) -> Column:
    """An array of numbers below 256 as bytes."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def _in_order(name: str, order: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda c: c[value]).alias(name)


def captured_folder(spark: SparkSession, sf_dir: str) -> str:
    """Writes what the search over the events captures; the folder that holds its files."""
    segs = segment_form(spark, sf_dir)
    hits = detect.pulse_search(segs, CONFIG).where("hits > 0").groupBy("seg").agg(F.array_sort(F.collect_set("boxcar")).alias("boxcars"))
    works = segs.join(hits, "seg", "left").select((F.col("seg") * N).alias("counter"), (F.col("seg") * N).alias("ts"), "x", "boxcars", F.col("boxcars").isNotNull().alias("has_signal"))
    folder = shared_folder(spark, "captures")
    capture_sink.save(captures.capture_pieces(capture.captured(works, WINDOW), CONFIG), folder)
    return folder


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """file, content: of none, if no name matches."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _counter() -> Column:
    return F.substring_index("file", ".", 1).cast("long")


def capture_bin_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captured samples as they lie in the store."""
    found = _files(spark, captured_folder(spark, sf_dir), "*.bin")
    return found.select("file", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def capture_npy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of each channel of the captured spectra, from their files."""
    found = captures.spectra_of_files(_files(spark, captured_folder(spark, sf_dir), "*.npy"))
    p = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda a, v: a + v)
    return found.select(_counter().alias("counter"), "chan", F.size("re").cast("long").alias("n"), (F.round(p, 3) + 0.0).alias("p"))


def capture_tim_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time series of boxcars with a signal, from their files."""
    found = captures.series_of_files(_files(spark, captured_folder(spark, sf_dir), "*.tim"))
    at = found.select(_counter().alias("counter"), F.split("file", r"\.")[1].cast("int").alias("boxcar"), F.posexplode("y").alias("tm", "y"))
    return at.select("counter", "boxcar", F.col("tm").cast("long").alias("tm"), (F.round("y", 3) + 0.0).alias("y"))


def record_all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording of all segments, in files of four."""
    raw = samples(spark, sf_dir, N).groupBy("seg").agg(_in_order("x", "pos", "x")).select("seg", _bytes(F.col("x")).alias("raw"))
    folder = shared_folder(spark, "recording")
    capture_sink.save(captures.recording_pieces(raw, N, KEPT, FILE_SEGMENTS), folder)
    return _files(spark, folder, "*.bin").select("file", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def baseband_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseband files with a header in the store, read as segments that overlap."""
    pieces = samples(spark, sf_dir, FILE).select(F.col("seg").alias("part"), F.col("pos"), "x").withColumn("piece", F.expr("pos div 500"))
    data = pieces.groupBy("part", "piece").agg(_in_order("x", "pos", "x")).select("part", "piece", _bytes(F.col("x")).alias("data"))
    name = F.concat(F.lpad(F.col("part").cast("string"), 10, "0"), F.lit(".bin"))
    head = data.where("piece = 0").select(name.alias("file"), F.lit(0).cast("long").alias("at"), F.expr(f"cast(repeat('H', {HEADER}) as binary)").alias("data"))
    folder = shared_folder(spark, "baseband")
    capture_sink.save(head.unionByName(data.select(name.alias("file"), (F.col("piece") * 500 + HEADER).alias("at"), "data")), folder)
    spark.dataSource.register(BasebandSource)
    found = spark.read.format("baseband").options(path=folder, segment_bytes=SIZE, reserved_bytes=SIZE - STEP, offset_bytes=HEADER, per_partition=4).load()
    return found.select(F.substring(F.element_at(F.split("file", "/"), -1), 1, 10).cast("long").alias("part"), F.col("seg").cast("long").alias("seg"), F.octet_length("raw").cast("long").alias("bytes"), F.sha2("raw", 256).alias("sha256"))


_HEX = "lpad(hex(x::UTINYINT), 2, '0')"
S_CAUGHT = f"""{S_BOX}, rm AS (SELECT *, sqrt(avg(y * y) OVER (PARTITION BY seg, boxcar)) AS rms FROM bx), hit AS (SELECT DISTINCT seg, boxcar FROM rm WHERE y > {CONFIG.snr_threshold} * rms),
    caught AS (SELECT DISTINCT s.seg FROM s WHERE EXISTS (SELECT 1 FROM hit WHERE abs(hit.seg - s.seg) * {N} < {WINDOW}))"""
QUERIES = {f.__name__: f for f in (capture_bin_files, capture_npy_files, capture_tim_files, record_all_files, baseband_store)}
SQL = {
    "capture_bin_files": f"""WITH {S_CAUGHT}, fl AS (SELECT c.seg, r.pos, coalesce(s.x, 0)::BIGINT AS x FROM caught c CROSS JOIN range({N}) r(pos) LEFT JOIN s ON s.seg = c.seg AND s.pos = r.pos)
        SELECT (seg * {N})::VARCHAR || '.bin' AS file, count(*) AS bytes, sha256(unhex(string_agg({_HEX}, '' ORDER BY pos))) AS sha256 FROM fl GROUP BY seg""",
    "capture_npy_files": f"""WITH {S_CAUGHT} SELECT seg * {N} AS counter, chan::BIGINT AS chan, count(*) AS n, round(sum(CASE WHEN y.p = 0 THEN 0 ELSE re::REAL::DOUBLE * re::REAL + im::REAL::DOUBLE * im::REAL END), 3) + 0.0 AS p
        FROM y JOIN w USING (seg, chan, tm) WHERE seg IN (SELECT seg FROM caught) GROUP BY seg, chan""",
    "capture_tim_files": f"""WITH {S_CAUGHT} SELECT bx.seg * {N} AS counter, bx.boxcar::INTEGER AS boxcar, tm::BIGINT AS tm, round(y::REAL::DOUBLE, 3) + 0.0 AS y FROM bx JOIN hit ON hit.seg = bx.seg AND hit.boxcar = bx.boxcar""",
    "record_all_files": f"""WITH {S_SAMPLES}, n AS (SELECT seg, pos, x::BIGINT AS x, max(pos) OVER (PARTITION BY seg) + 1 AS size FROM s), k AS (SELECT seg, pos, x FROM n WHERE pos < size - {KEPT})
        SELECT lpad((seg // {FILE_SEGMENTS} * {FILE_SEGMENTS * (N - KEPT)})::VARCHAR, 20, '0') || '.bin' AS file, count(*) AS bytes, sha256(unhex(string_agg({_HEX}, '' ORDER BY seg, pos))) AS sha256 FROM k GROUP BY seg // {FILE_SEGMENTS}""",
    "baseband_store": f"""WITH e AS (SELECT event_id // {FILE} AS part, event_id % {FILE} AS pos, (round(value * 100)::BIGINT) % 256 AS x FROM events), f AS (SELECT part, max(pos) + 1 AS size FROM e GROUP BY part),
        g AS (SELECT part, seg FROM f, range({FILE // STEP + 2}) r(seg) WHERE seg = 0 OR seg <= (size - {SIZE} + {STEP - 1}) // {STEP} AND size > {SIZE}),
        c AS (SELECT g.part, g.seg, r.i, coalesce(e.x, 0)::BIGINT AS x FROM g CROSS JOIN range({SIZE}) r(i) LEFT JOIN e ON e.part = g.part AND e.pos = g.seg * {STEP} + r.i)
        SELECT part, seg, count(*) AS bytes, sha256(unhex(string_agg({_HEX}, '' ORDER BY i))) AS sha256 FROM c GROUP BY part, seg""",
}

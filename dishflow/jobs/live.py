"""Streaming queries: table rows as packets that arrive file by file, run until all are read, results as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dishflow.functions.scalars import r6
from dishflow.jobs.catalogue import CONFIG, S_PACKETS, r3, segment_form
from dishflow.jobs.catalogue import SQL as BATCH_SQL
from dishflow.operators import detect
from dishflow.sources.capture_sink import CaptureSink
from dishflow.sources.packet_files import PacketFiles
from dishflow.sources.store import file_system, shared_folder, sizes
from dishflow.sources.tables import packets, table
from dishflow.streaming.blocks import assembled, captured, captured_across, received, recording

ARRIVALS, FILES = 4, 4  # micro-batches of a replay, and files of each
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


class Replay:
    """rows as a recorder's folder: files in the given order lie ready and get their names in the folder as time goes on."""

    def __init__(self, rows: DataFrame, order: str, arrivals: int = ARRIVALS) -> None:
        self.spark, self.schema, self.arrivals = rows.sparkSession, rows.schema, arrivals
        base = shared_folder(self.spark, "packets")
        self.ready, self.live, self.shown = f"{base}/ready", f"{base}/live", 0
        rows.repartitionByRange(arrivals * FILES, order).sortWithinPartitions(order).write.parquet(self.ready)
        system, path = file_system(self.live)
        system.create_dir(path)
        self.files = [x for x in sizes(self.ready) if x.endswith(".parquet")]

    def stream(self) -> DataFrame:
        self.spark.dataSource.register(PacketFiles)
        return self.spark.readStream.format("packet_files").schema(self.schema).option("path", self.live).load()

    def arrive(self) -> None:
        """The next files get their names."""
        system, path = file_system(self.live)
        some = self.files[self.shown : self.shown + max(1, -(-len(self.files) // self.arrivals))]
        for i, file in enumerate(some, self.shown):
            system.move(file, f"{path}/{i:08d}.parquet")
        self.shown += len(some)

    @property
    def over(self) -> bool:
        return self.shown == len(self.files)


def run(stream: DataFrame, *replays: Replay, sink: str = "parquet", folder: str | None = None, arrivals: int | None = None) -> str:
    """Runs a stream while its files arrive (all of them, or so many arrivals); the folder that it has written to. Called
    again with that folder it goes on where it ended."""
    spark, folder = stream.sparkSession, folder or shared_folder(stream.sparkSession, "stream")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format(sink).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").start()
    finally:
        spark.conf.set(STATE_STORE, before)
    try:
        done = 0
        while done != arrivals and not all(r.over for r in replays):
            for r in replays:
                r.arrive()
            query.processAllAvailable()
            done += 1
    finally:
        query.stop()
    return folder


def result(stream: DataFrame, *replays: Replay) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{run(stream, *replays)}/out")


_SIZE, _FIRST, _STREAMS, _WINDOW = 64, 5, 16, 30_000_000
_LATE = 1500  # places by which every 50th packet comes late
_BYTES, _JUMP = 40, 1_000_000_000  # of the continuous receiver's blocks; counters that all streams skip at one place
_DAY = 86_400_000


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, arrival, counter, b, us: packets of 16 streams, in turn, one a second."""
    rows = packets(spark, sf_dir)
    late = F.when(F.col("counter") % 50 == 7, _LATE).otherwise(0)
    return rows.select(
        (F.col("counter") % _STREAMS).alias("stream_id"), (F.col("counter") + late).alias("arrival"), F.floor(F.col("counter") / _STREAMS).cast("long").alias("counter"), "b", ((F.col("counter") + late) * 1_000_000).alias("us")
    )


def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all streams, the last ones closed by time; some packets come too late for theirs."""
    rows = _arriving(spark, sf_dir)
    beat = rows.agg((F.max("arrival") + 1).alias("arrival")).select(F.lit(-1).cast("long").alias("stream_id"), "arrival", F.lit(0).cast("long").alias("counter"), F.lit(0).cast("long").alias("b"), (F.col("arrival") * 1_000_000 + 3 * _DAY * 1000).alias("us"))
    replay = Replay(rows.unionByName(beat.where("arrival is not null")), "arrival")
    timed = replay.stream().withColumn("ts", F.timestamp_micros("us"))
    return result(assembled(timed, _SIZE, _FIRST, timeout=_DAY, delay="1 hour"), replay)


def _payloads(spark: SparkSession, sf_dir: str, jump: int) -> DataFrame:
    """stream_id, arrival, counter, data (three bytes) of the packets; counters skip `jump` after the 20th."""
    byte = lambda x: F.lpad(F.hex(x % 256), 2, "0")
    rows = packets(spark, sf_dir).withColumn("n", F.floor(F.col("counter") / _STREAMS).cast("long"))
    return rows.select(
        (F.col("counter") % _STREAMS).alias("stream_id"), F.col("counter").alias("arrival"), (F.col("n") + F.when(F.col("n") > 20, jump).otherwise(0)).alias("counter"), F.unhex(F.concat(byte(F.col("b")), byte(F.col("b") * 7), byte(F.col("n")))).alias("data")
    )


def _digest(data: str) -> list:
    """n, total, checksum of some bytes."""
    hexed = F.regexp_extract_all(F.hex(data), F.lit("(..)"), 0)
    values = F.transform(hexed, lambda h: F.conv(h, 16, 10).cast("long"))
    weighed = F.transform(values, lambda v, i: v * (i + 1))
    return [F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v).alias(k) for k, x in (("total", values), ("checksum", weighed))]


def stream_receiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams' bytes in blocks that payloads don't fit; a gap of a thousand million packets is one row a stream."""
    replay = Replay(_payloads(spark, sf_dir, _JUMP), "arrival")
    return result(received(replay.stream(), _BYTES), replay).select("stream_id", "block", "blocks", *(F.coalesce(x, F.lit(0)).cast("long").alias(k) for k, x in zip(("total", "checksum"), _digest("data"), strict=True)))


def stream_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of the streams that an interrupted query has written, block by block."""
    replay = Replay(_payloads(spark, sf_dir, 0), "arrival")
    spark.dataSource.register(CaptureSink)
    make = lambda: recording(received(replay.stream(), _BYTES), _BYTES)
    folder = run(make(), replay, sink="captures", arrivals=2)
    run(make(), replay, sink="captures", folder=folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(f"{folder}/out").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    cut = F.explode(F.sequence(F.lit(0), (F.octet_length("content") / _BYTES).cast("int") - 1)).alias("i")
    first = (F.substring_index(F.substring_index("file", ".", 1), "-", -1).cast("long") / _BYTES).cast("long")
    rows = files.select(F.substring_index("file", "-", 1).cast("long").alias("stream_id"), first.alias("first"), "content", cut)
    rows = rows.select("stream_id", (F.col("first") + F.col("i")).alias("block"), F.expr(f"substring(content, i * {_BYTES} + 1, {_BYTES})").alias("data"))
    return rows.select("stream_id", "block", *_digest("data"))


def stream_pulse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch search over micro-batches of segments: it holds no state and needs no shuffle."""
    replay = Replay(segment_form(spark, sf_dir), "seg")
    found = result(detect.pulse_search(replay.stream(), CONFIG), replay)
    return found.select("seg", "boxcar", r3(F.col("rms")).alias("rms"), r3(F.col("peak")).alias("peak"), "hits")


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select((F.col("event_id") % _STREAMS).alias("stream_id"), F.col("event_id").alias("id"), ts.alias("ts"), (F.col("value") > 150).alias("has_signal"))


def stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    replay = Replay(_works(spark, sf_dir), "ts")
    return result(captured(replay.stream(), _WINDOW), replay).select(F.col("id").alias("event_id"))


def stream_capture_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal in one stream captures what the others saw at that time."""
    replay = Replay(_works(spark, sf_dir), "ts")
    timed = lambda: replay.stream().withColumn("at", F.timestamp_micros("ts"))
    return result(captured_across(timed(), timed().where("has_signal"), _WINDOW, "1 minute"), replay).select(F.col("id").alias("event_id"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows with a watermark; those that the watermark has passed."""
    e = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")
    replay = Replay(e, "us")
    timed = replay.stream().withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "10 minutes")
    windows = timed.groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return result(windows, replay).select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", r6(F.col("v")).alias("v"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (stream_blocks, stream_receiver, stream_recording, stream_pulse_search, stream_capture, stream_capture_across, stream_windows)
}


def _bytes_sql(jump: int) -> str:
    """y: bytes v at places p of each stream; z: how many bytes a stream has."""
    n = f"counter // {_STREAMS} + CASE WHEN counter // {_STREAMS} > 20 THEN {jump} ELSE 0 END"
    return f"""{S_PACKETS}, q AS (SELECT counter % {_STREAMS} AS stream_id, {n} AS c, counter // {_STREAMS} AS m, b FROM p), f AS (SELECT stream_id, min(c) AS first, 3 * (max(c) - min(c) + 1) AS bytes FROM q GROUP BY 1),
        y AS (SELECT q.stream_id, 3 * (c - first) + i AS p, CASE i WHEN 0 THEN b WHEN 1 THEN b * 7 % 256 ELSE m % 256 END AS v, bytes FROM q JOIN f USING (stream_id), range(3) r(i)),
        k AS (SELECT stream_id, p // {_BYTES} AS block, sum(v)::BIGINT AS total, sum((p % {_BYTES} + 1) * v)::BIGINT AS checksum, any_value(bytes) AS bytes FROM y GROUP BY 1, 2)"""


SQL: dict[str, str] = {
    "stream_blocks": f"""WITH {S_PACKETS}, q AS (SELECT counter % {_STREAMS} AS stream_id, counter // {_STREAMS} - {_FIRST} AS c, b, counter + CASE WHEN counter % 50 = 7 THEN {_LATE} ELSE 0 END AS arrival FROM p WHERE counter // {_STREAMS} >= {_FIRST}),
        h AS (SELECT *, max(c // {_SIZE}) OVER (PARTITION BY stream_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS open FROM q)
        SELECT stream_id, open AS block, count(*) FILTER (WHERE c // {_SIZE} = open) AS received, coalesce(sum(b) FILTER (WHERE c // {_SIZE} = open), 0)::BIGINT AS total,
               coalesce(sum((c % {_SIZE} + 1) * b) FILTER (WHERE c // {_SIZE} = open), 0)::BIGINT AS checksum, count(*) FILTER (WHERE c // {_SIZE} < open) AS late FROM h GROUP BY 1, 2""",
    "stream_receiver": f"""WITH {_bytes_sql(_JUMP)}, g AS (SELECT stream_id, block, lead(block) OVER (PARTITION BY stream_id ORDER BY block) - block - 1 AS missing FROM k)
        SELECT stream_id, block, 1::BIGINT AS blocks, total, checksum FROM k WHERE (block + 1) * {_BYTES} <= bytes UNION ALL SELECT stream_id, block + 1, missing, 0, 0 FROM g WHERE missing > 0""",
    "stream_recording": f"WITH {_bytes_sql(0)} SELECT stream_id, block, total, checksum FROM k WHERE (block + 1) * {_BYTES} <= bytes",
    "stream_windows": """WITH e AS (SELECT epoch_us(ts) AS t, event_type, value FROM events), w AS (SELECT t // 300000000 * 300000000 AS start_us, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS v FROM e GROUP BY 1, 2)
        SELECT start_us, event_type, n, v FROM w WHERE start_us + 300000000 <= (SELECT max(t) FROM e) - 600000000""",
    "stream_pulse_search": BATCH_SQL["pulse_search"],
    "stream_capture_across": BATCH_SQL["capture_policy"],
    "stream_capture": f"""WITH e AS (SELECT event_id, event_id % {_STREAMS} AS s, epoch_us(ts) AS ts, value > 150 AS has_signal FROM events)
        SELECT event_id FROM e WHERE EXISTS (SELECT 1 FROM e p WHERE p.has_signal AND p.s = e.s AND abs(p.ts - e.ts) < {_WINDOW})""",
}

"""Token ids in binary shards that serve single short documents.

A shard is one binary value: a header with the hash of the dictionary, an index (document, offset, number of tokens)
and a zstandard frame for each document, compressed by itself with a dictionary that all shards share. Shards are
written with Spark's own writer, which commits whole tasks and reaches every store that the session reaches.

Layout of a shard, little-endian: 8 bytes magic; uint8 id width; 32 bytes SHA-256 of the dictionary; uint32 number of
documents n; n times int64 doc_id; n bytes, 1 where doc_id is null; n+1 times uint64 frame offset; n times uint32
number of tokens; the frames.

Defined cases: null and empty texts are a document that holds the end id alone; documents with a null doc_id come
last; rows with one doc_id follow each other; an empty table gives no shards; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dishflow.llm.common import documents, materialise, scratch_dir, shuffle_partitions
from dishflow.llm.tokens import encoded

MAGIC = b"DFTOKEN1"
#: The dictionary serves short documents: it is trained on so many whole ones of at most so many bytes of text.
SAMPLE_ROWS, SHORT_BYTES, DICTIONARY_BYTES = 512, 65536, 112640
SHARD_ROWS, SHARD_BYTES = 4096, 16_000_000
BROADCAST_ROWS = 500_000  # shards whose places (16 bytes each) are broadcast; more are joined by shuffle


def write_shard(doc_ids: list[int | None], counts: list[int], frames: list[bytes], dictionary: bytes, width: int) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).astype("<u8")
    known = np.array([0 if x is None else x for x in doc_ids], "<i8")
    null = bytes(x is None for x in doc_ids)
    head = MAGIC + struct.pack("<B32sI", width, hashlib.sha256(dictionary).digest(), len(frames))
    return b"".join([head, known.tobytes(), null, offsets.tobytes(), np.array(counts, "<u4").tobytes(), *frames])


class Shard:
    """Reads single documents of a shard by their place, or all of them."""

    def __init__(self, data: bytes, dictionary: bytes) -> None:
        self.width, digest, n = struct.unpack_from("<B32sI", data, 8)
        if data[:8] != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this dictionary")
        at = 45
        ids, at = np.frombuffer(data, "<i8", n, at), at + 8 * n
        null, at = data[at : at + n], at + n
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.offsets, at = np.frombuffer(data, "<u8", n + 1, at), at + 8 * (n + 1)
        self.counts, at = np.frombuffer(data, "<u4", n, at), at + 4 * n
        self.frames = memoryview(data)[at:]
        self.reader = zstandard.ZstdDecompressor(dict_data=_prepared(dictionary))

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, place: int) -> np.ndarray:
        a, b = (int(x) for x in self.offsets[place : place + 2])
        return np.frombuffer(self.reader.decompress(self.frames[a:b], max_output_size=self.width * int(self.counts[place])), f"<u{self.width}").astype("<u4")


def _prepared(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """From the serialised arrays of whole short documents (SHORT_BYTES): SAMPLE_ROWS of those that a hash selects all
    over the table. It sets the compression ratio only, never what is read back. Too small a sample serves as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in encoded(batches, tokenizer, end_id, width):
            yield pa.RecordBatch.from_arrays([pa.array([bytes(ids)], pa.binary())], names=["sample"])

    every = max(1, docs.count() // (4 * SAMPLE_ROWS))  # so that few rows of a task are compared
    hashed = docs.where(F.octet_length("text") <= SHORT_BYTES).withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = hashed.where(F.pmod("h", F.lit(every)) == 0).orderBy("h", "doc_id").limit(SAMPLE_ROWS).select("doc_id", "text")
    samples = [r.sample for r in chosen.mapInArrow(run, "sample binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Shards in ascending doc_id order under path/shards, their dictionary under path/dictionary. width: bytes of an id."""
    spark = docs.sparkSession
    own = documents(docs, id_col, text_col)
    dictionary = train_dictionary(own, tokenizer, end_id, width)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    # ranges of doc_id with about as many rows each; their bounds come from the doc_id column alone
    parts = shuffle_partitions(spark)
    cuts, known, rows = own.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts), F.count("doc_id"), F.count(F.lit(1))).first()
    bounds, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    # a doc_id that is a bound several times, and rows without one, have several ranges
    first = np.concatenate([[0], np.cumsum(times)])
    nulls = max(1, -(-(rows - known) * parts // max(1, rows)))

    def part_of(doc_id: int | None, frame: bytes) -> int:
        if doc_id is None:
            return int(first[-1]) + 1 + zlib.crc32(frame) % nulls
        at = int(np.searchsorted(bounds, doc_id))
        same = at < len(bounds) and bounds[at] == doc_id
        return int(first[at]) + (zlib.crc32(frame) % int(times[at]) if same else 0)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=_prepared(dictionary), write_content_size=True)
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, counts, frames = zip(*rows, strict=True)
            part = [part_of(x, frame) for x, frame in zip(ids, frames, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["part", "doc_id", "n_tokens", "frame"])

        for doc_id, ids in encoded(batches, tokenizer, end_id, width):
            rows.append((doc_id, len(ids) // width, packer.compress(ids)))
            size += len(rows[-1][2])
            if size > 4_000_000 or len(rows) == 2000:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, frames, size = [], [], [], 0
        no = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            data = write_shard(ids, counts, frames, dictionary, width)
            return pa.RecordBatch.from_arrays([pa.array([no]), pa.array([len(ids)]), pa.array([sum(counts)]), pa.array([data], pa.binary())], names=["shard", "n_docs", "n_tokens", "data"])

        for batch in batches:
            for doc_id, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                counts.append(n)
                frames.append(frame)
                size += len(frame)
                if len(ids) == SHARD_ROWS or size > SHARD_BYTES:
                    yield flush()
                    ids, counts, frames, size, no = [], [], [], 0, no + 1
        if ids:
            yield flush()

    framed = own.mapInArrow(compress, "part int, doc_id long, n_tokens long, frame binary")
    dealt = framed.repartitionById(int(first[-1]) + 1 + nulls, F.col("part")).drop("part")
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "n_tokens", "frame")
    dealt.mapInArrow(assemble, "shard long, n_docs long, n_tokens long, data binary").write.option("compression", "uncompressed").parquet(f"{path}/shards")


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit): a row for each document."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    shards = spark.read.parquet(f"{path}/shards")
    # a row for each few thousand documents: small enough to be numbered in one task at any size
    begins = materialise(shards.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("before")))
    begins = F.broadcast(begins) if begins.count() <= BROADCAST_ROWS else begins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_py(), dictionary)
                starts = before + np.concatenate([[0], np.cumsum(shard.counts.astype(np.int64))])
                for i in range(0, len(shard), 256):
                    some = range(i, min(i + 256, len(shard)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[i : i + 256], pa.int64()), pa.array(starts[some.start : some.stop]), pa.array(shard.counts[some.start : some.stop].astype(np.int64)), pa.array([shard.ids(k).tobytes() for k in some], pa.large_binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return shards.join(begins, "shard").select("before", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(spark, path: str) -> DataFrame:
    """What a check of the files needs: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    path = f"{scratch_dir(docs.sparkSession)}/dishflow-tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id)
    return token_digests(docs.sparkSession, path)

"""Exact dedup by a Golomb-coded fingerprint exchange.

Each task fingerprints its documents, and for every owner (a range of the hash space) sends the sorted distinct
hashes of a chunk as Golomb-Rice code. Owners decode, find the hashes that more than one chunk has and answer
with a bitmap for each chunk. Only flagged documents (suspects) are read again and shuffled with their texts: each is
compared byte by byte with one text of its digest. What differs from it although the digests are equal forms groups by
its bytes, so a result never rests on hashes alone.

Defined cases: null text counts as empty; a null doc_id sorts after all others; of repeated rows with one doc_id
and equal text exactly one stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishflow.llm.common import documents, materialise, shuffle_partitions, text_rows

COPIES = 1 << 12  # equal rows of one doc_id that are listed at once
SPACES = b" \t\n\r\x0b\x0c"


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space (kept at either end)."""
    words = text.split()
    if not words:
        return b" " if text else b""
    head = b" " if text[:1] in SPACES else b""
    tail = b" " if text[-1:] in SPACES else b""
    return head + b" ".join(words) + tail


def golomb_encode(hashes: np.ndarray) -> bytes:
    """Golomb-Rice code of ascending distinct uint64; quotients in unary and remainders lie in two bit streams."""
    n = len(hashes)
    if n == 0:
        return np.uint32(0).tobytes()
    deltas = np.diff(hashes)
    span = int(hashes[-1]) - int(hashes[0])
    r = max(0, (span // max(1, n - 1)).bit_length() - 1)
    ends = np.cumsum((deltas >> np.uint64(r)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n > 1 else 0, np.uint8)
    unary[ends] = 1
    low = (deltas[:, None] >> np.arange(r, dtype=np.uint64)) & np.uint64(1)
    unary_bytes = np.packbits(unary).tobytes()
    head = np.array([n, r, len(unary_bytes)], np.uint32).tobytes() + hashes[:1].astype(np.uint64).tobytes()
    return head + unary_bytes + np.packbits(low.astype(np.uint8)).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    if n == 0:
        return np.empty(0, np.uint64)
    _, r, size = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    base = np.frombuffer(data, np.uint64, 1, 12)
    unary = np.unpackbits(np.frombuffer(data, np.uint8, size, 20))
    ends = np.flatnonzero(unary)[: n - 1]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=20 + size), count=(n - 1) * r).reshape(n - 1, r)
    low = (bits.astype(np.uint64) << np.arange(r, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.concatenate([base, base + np.cumsum((quotients.astype(np.uint64) << np.uint64(r)) + low, dtype=np.uint64)])


SENT = "chunk long, owner int, doc_ids array<long>, digests binary, hash_no array<int>, repeated binary, payload binary"


def _send(owners: int, chunk_rows: int, digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests = [], []
        chunk = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            blob = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
            hashes = np.ascontiguousarray(blob[:, :8]).view(">u8").ravel().astype(np.uint64)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            owner = (((hashes >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            cols: list[list] = [[] for _ in range(7)]
            for a, b in zip(cuts, [*cuts[1:], len(hashes)], strict=True):
                distinct, no, counts = np.unique(hashes[a:b], return_inverse=True, return_counts=True)
                row = (chunk, int(owner[a]), [ids[i] for i in order[a:b]], blob[order[a:b]].tobytes(), no.astype(np.int32), np.packbits(counts > 1).tobytes(), golomb_encode(distinct))
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["chunk", "owner", "doc_ids", "digests", "hash_no", "repeated", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_rows(batch), strict=True):
                ids.append(doc_id)
                digests.append(digest(normalised(text)))
                if len(ids) == chunk_rows:
                    yield flush()
                    ids, digests = [], []
                    chunk += 1
        if ids:
            yield flush()

    return run


def _answer(group: pa.Table) -> pa.Table:
    """What one owner has received: which hashes of each chunk does another chunk have too?"""
    sent = [golomb_decode(x) for x in group.column("payload").to_pylist()]
    everything = np.sort(np.concatenate(sent))
    twice = everything[1:][everything[1:] == everything[:-1]]
    bitmaps = [np.packbits(np.isin(x, twice)).tobytes() for x in sent]
    return pa.table({"chunk": group.column("chunk"), "owner": group.column("owner"), "bitmap": pa.array(bitmaps, pa.binary())})


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            no = np.array(row["hash_no"], np.int64)
            bits = [np.unpackbits(np.frombuffer(row[k], np.uint8)) for k in ("repeated", "bitmap")]
            n = len(no)
            digests = np.frombuffer(row["digests"], np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([digests[32 * i : 32 * i + 32].tobytes() for i in range(n)], pa.binary()),
                    pa.array((bits[0][no] | bits[1][no]).astype(bool)),
                ],
                names=["doc_id", "digest", "suspect"],
            )


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _texts(digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                own = [normalised(x) for x in text_rows(some)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([digest(x) for x in own], pa.binary()), pa.array(own, pa.binary())], names=["doc_id", "digest", "bytes"])

    return run


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = 65536, owner_hashes: int = 500_000, broadcast_digests: int = 500_000, broadcast_bytes: int = 32_000_000, digest: Callable[[bytes], bytes] = sha256
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs. Up to broadcast_digests digests of
    suspects (32 bytes each) and groups, and broadcast_bytes of their texts, are broadcast to the rows of suspects; more of
    them meet the rows in a shuffle, whose large partitions Spark splits."""
    spark = docs.sparkSession
    own = documents(docs, id_col, text_col)
    owners = max(shuffle_partitions(spark), -(-docs.count() // owner_hashes))
    # a chunk's rows hold a document's number and digest for each owner; chunk numbers hold once they are written
    sent = materialise(own.mapInArrow(_send(owners, chunk_rows, digest), SENT))
    answers = sent.select("chunk", "owner", "payload").groupBy("owner").applyInArrow(_answer, "chunk long, owner int, bitmap binary")
    rows = materialise(sent.drop("payload").join(answers, ["chunk", "owner"]).mapInArrow(_flagged, "doc_id long, digest binary, suspect boolean"))
    flagged = materialise(rows.where("suspect").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    few = F.broadcast(flagged) if flagged.count() <= broadcast_digests else flagged
    # written first: Spark splits large partitions, as a large group makes, only of joins of plain inputs
    suspects = materialise(own.mapInArrow(_texts(digest), "doc_id long, digest binary, bytes binary").join(few, "digest", "left_semi"))
    chosen = materialise(suspects.groupBy("digest").agg(F.min("bytes").alias("chosen")))
    texts = chosen.agg(F.sum(F.octet_length("chosen") + 64)).first()[0] or 0
    chosen = F.broadcast(chosen) if texts <= broadcast_bytes else chosen
    # null: the bytes are those of the chosen text; else they stand for themselves
    form = F.when(F.col("bytes") != F.col("chosen"), F.col("bytes"))
    # equal rows of one doc_id are counted, so that rows need no names of their own
    members = materialise(suspects.join(chosen, "digest").select("doc_id", "digest", form.alias("form")).groupBy("digest", "form", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    groups = materialise(members.groupBy("digest", "form").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size")).select(F.col("digest").alias("of"), F.col("form").alias("as"), "keep_id", "group_size"))
    n_groups, other = groups.agg(F.count(F.lit(1)), F.sum(F.octet_length("as"))).first()
    groups = F.broadcast(groups) if n_groups <= broadcast_digests and (other or 0) <= broadcast_bytes else groups
    verified = members.join(groups, (F.col("digest") == F.col("of")) & F.col("form").eqNullSafe(F.col("as")))
    # a row for each of n equal rows, in steps, so that no row holds a long array
    verified = verified.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(COPIES).cast("long"))))
    verified = verified.withColumn("nth", F.explode(F.sequence("from", F.least("n", F.col("from") + COPIES - 1))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    hexed = F.lower(F.hex("digest")).alias("text_sha256")
    alone = rows.join(few, "digest", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    return alone.unionByName(verified.select("doc_id", "keep_id", "group_size", kept.alias("kept"), hexed))

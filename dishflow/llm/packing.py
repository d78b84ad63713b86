"""Best-fit packing planned on the length histogram.

Texts become pieces of at most `capacity` tokens. The histogram of piece lengths (at most `capacity` rows) goes to the
driver, where best-fit decreasing runs over counts: one step fills a whole run of equal bins with items of one length.
The plan says which ranks of a length go to which run of sequences at which offset; pieces take their slots by a join
on length and rank. The plan's size depends on the capacity, not on the corpus: runs of bins number at most three for
each length, and a run that takes length L keeps less than half its space, so it is touched log2(capacity) times at most.

Defined cases: null and empty texts are a document of the end id alone; repeated rows are packed each; a null doc_id is
packed like any other; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dishflow.llm.common import documents, materialise, shuffle_partitions
from dishflow.llm.tokens import encoded

RANK_ROWS = 20_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc_id, view in encoded(batches, tokenizer, end_id):
            for no, (start, n) in enumerate(cut(len(view) // 4, capacity)):
                own = view[4 * start : 4 * (start + n)]
                rows.append((doc_id, no, start, n, zlib.crc32(own)) + (bytes(own),) * with_ids)
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, items in a sequence, offset of the first item)."""
    runs: dict[int, list[tuple[int, int]]] = {}  # space left: runs of sequences (first, number)
    spaces: list[int] = []  # the keys of runs, ascending
    plan, sequences = [], 0

    def leave(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in runs:
                insort(spaces, space)
            runs.setdefault(space, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = runs[space].pop()
                if not runs[space]:
                    del runs[space], spaces[at]
            else:
                space, first = capacity, sequences
                n = -(-(count - rank) // (capacity // length))
                sequences += n
            each = space // length
            full, rest = min(n, (count - rank) // each), 0
            if full < n:
                rest = count - rank - full * each
            took = full * each + rest
            plan.append((length, rank, rank + took, first, each, capacity - space))
            rank += took
            leave(space - each * length, first, full)
            if rest:
                leave(space - rest * length, first + full, 1)
            used = full + (rest > 0)
            leave(space, first + used, n - used)
    return plan


def pack(piece_rows: DataFrame, capacity: int = 2048, rank_rows: int = RANK_ROWS) -> DataFrame:
    """piece_rows with sequence_id and offset. Reads piece_rows several times: pass what is written already."""
    spark = piece_rows.sparkSession
    histogram = {r.length: r.n for r in piece_rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(best_fit_plan(histogram, capacity), "plan_length long, rank_from long, rank_to long, first_sequence long, each long, first_offset long")
    # ranks within a length: numbers within hash parts of it, after the sizes of the parts before
    parts = max(shuffle_partitions(spark), -(-sum(histogram.values()) // rank_rows))
    dealt = piece_rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("no", F.row_number().over(order) - 1).join(before, ["length", "part"]).withColumn("rank", F.col("no") + F.col("before"))
    slot = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = ranked.join(F.broadcast(plan), slot)  # the plan is bounded by the capacity, see above
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        *piece_rows.columns,
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(materialise(pieces(docs, tokenizer, end_id, capacity, with_ids)), capacity)

"""Which windows of each document occur elsewhere: exact at any size, by joins on paths (see paths.py).

1. Every document's paths are listed; a minimiser that occurs once has nothing to share, so only the others go on.
2. Equal paths are compacted to one row with their number of occurrences and smallest document. Where all paths of a
   minimiser are equal the path doesn't branch, and all its windows occur exactly where it does.
3. Branching paths (the ends of shared passages, edits) are fetched from the text at one source coordinate each and
   split into blocks of windows at fixed distances from the minimiser; equal blocks are compacted like paths, and only
   blocks that still differ are split into windows.
4. What was found for a path goes to each of its occurrences, and a document's texts meet its spans in the end.

Counts and smallest documents are partial aggregates and every join has one row a key on one side, so a passage that a
third of all documents hold is spread over tasks like any other rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishflow.llm.common import documents, materialise, result_of, text_rows
from dishflow.llm.paths import TOKENS, U, Hashes, mixed, paths
from dishflow.llm.unitigs import compacted

LAST_ID = (1 << 63) - 1  # stands for a null doc_id: no document is after it
BLOCK = 16
#: path = 44 bits of hash, 10 bits: number of windows, 10 bits: distance of the minimiser from the first window.
FIELD = (1 << 10) - 1
LISTED = ["least", "path", "d", "t", "start"]
LISTED_TYPES = ", ".join(f"{x} long" for x in LISTED)


@dataclass(frozen=True)
class Kind:
    """tokens: words or bytes; window: tokens of a passage that counts; anchor: tokens of a minimiser's stretch; sources:
    runs also name the row and place of their first occurrence; mask: hash bits that are used (fewer: collisions, for tests)."""

    tokens: str
    window: int
    anchor: int
    sources: bool = False
    mask: int = -1

    def __post_init__(self) -> None:
        if not 0 < self.window - self.anchor + 1 <= min(self.window, FIELD):
            raise ValueError("a path has at most as many windows as a window has tokens, and 1023")


def listed(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TOKENS[kind.tokens]
        unpack = zstandard.ZstdDecompressor()
        with np.errstate(over="ignore"):
            for batch in batches:
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                rows = 0
                for d, t, packed in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), strict=True):
                    own = tokens(unpack.decompress(packed.as_py()))
                    if len(own) < kind.window:
                        continue
                    least, h, start, n, off = paths(own, kind.window, kind.anchor)
                    least &= kind.mask
                    path = ((h & kind.mask) >> 20 << 20) | n << 10 | -off
                    for col, x in zip(cols, (least, path, np.full(len(h), d), np.full(len(h), t), start), strict=True):
                        col.append(x)
                    rows += len(h)
                    if rows > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=LISTED)
                        cols, rows = [[], [], [], [], []], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=LISTED)

    return run


def _blocks(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the asked paths, with a hash for each window: least, block, hash, path, first (window of the path), ws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TOKENS[kind.tokens]
        unpack = zstandard.ZstdDecompressor()
        with np.errstate(over="ignore"):
            for batch in batches:
                for packed, asked in zip(batch.column(0), batch.column(1), strict=True):
                    hashes = Hashes(tokens(unpack.decompress(packed.as_py())))
                    flat = asked.values
                    least, path, start = (flat.field(i).to_numpy() for i in range(3))
                    n, off = path >> 10 & FIELD, path & FIELD
                    # windows of all asked paths, one after the other
                    ends = np.cumsum(n)
                    of = np.repeat(np.arange(len(n)), n)
                    j = np.arange(int(ends[-1])) - (ends - n)[of]
                    w = hashes.of(start[of] + j, kind.window) & U(kind.mask % (1 << 64))
                    no = (j - off[of]) // BLOCK  # distance from the minimiser, the same in every path that has it
                    cut = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(no, prepend=0) != 0))
                    stop = np.append(cut[1:], len(w))
                    size = (stop - cut).astype(U)
                    h = mixed(w[cut] ^ mixed(w[stop - 1] + size)).view(np.int64) & kind.mask
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(least[of[cut]]), pa.array(no[cut].astype(np.int32)), pa.array(h), pa.array(path[of[cut]]), pa.array(j[cut].astype(np.int32)),
                            pa.ListArray.from_arrays(pa.array(np.append(cut, len(w)).astype(np.int32)), pa.array(w.view(np.int64))),
                        ],
                        names=["least", "block", "hash", "path", "first", "ws"],
                    )

    return run


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, d, t, z: texts as zstandard frames, which halves what shuffles write. t is a number of the row, fixed by
    being written: neither equal doc_ids (d: with a number for null) nor equal texts make two rows one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            frames = pa.array([packer.compress(x) for x in text_rows(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], frames], names=["doc_id", "d", "z"])

    own = documents(docs).select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("d"), "text")
    packed = own.mapInArrow(run, "doc_id long, d long, z binary")
    return materialise(packed.select("doc_id", "d", F.monotonically_increasing_id().alias("t"), "z"))


def repeated(texts: DataFrame, kind: Kind) -> DataFrame:
    """d, t (row), start, runs: for each occurrence of a path that shares windows, the runs (from, to, n, d) of its windows,
    with their number of occurrences in texts and the smallest document among them. start: the path's first window.
    With kind.sources, runs also have src and at, the row and first window of their first occurrence there, and paths that
    always follow each other are one (see unitigs.py)."""

    def recurring() -> DataFrame:
        every = materialise(texts.select("d", "t", "z").mapInArrow(listed(kind), LISTED_TYPES))
        # what is joined with many rows of a key is written first: Spark splits large partitions only of joins of plain inputs
        twice = materialise(every.groupBy("least").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("least"))
        return every.join(twice, "least", "left_semi")

    def first(at: Column) -> Column:
        """The first occurrence (o: of a path) as runs keep it; at: its first window."""
        return F.struct("o.d", F.col("o.t").alias("src"), at.alias("at")) if kind.sources else F.struct("o.d")

    def run(a: Column, b: Column) -> Column:
        return F.struct(a.cast("int").alias("from"), b.cast("int").alias("to"), F.col("n"), *(F.col(f"o.{c}") for c in (["d", "src", "at"] if kind.sources else ["d"])))

    some = result_of(texts.sparkSession, recurring)
    own = materialise(some.groupBy("least", "path").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "start")).alias("o")))
    branches = materialise(own.groupBy("least").agg(F.count(F.lit(1)).alias("paths")))
    known = own.join(branches, "least")
    straight = known.where("paths = 1 and n > 1").withColumn("o", first(F.col("o.start"))).select("least", "path", F.array(run(F.lit(0), width())).alias("runs"))

    sources = known.where("paths > 1").select("o.t", F.struct("least", "path", "o.start").alias("one"))
    fetched = texts.join(sources.groupBy("t").agg(F.collect_list("one").alias("asked")), "t").select("z", "asked").mapInArrow(_blocks(kind), "least long, block int, hash long, path long, first int, ws array<long>")
    blocks = materialise(fetched)
    sized = blocks.select("least", "block", "hash", "path", "first", F.size("ws").alias("size")).join(own, ["least", "path"])
    sized = sized.withColumn("o", first(F.col("o.start") + F.col("first")))
    alike = materialise(sized.groupBy("least", "block", "hash").agg(F.sum("n").alias("n"), F.min("o").alias("o"), F.min("path").alias("chosen")))
    split = materialise(alike.groupBy("least", "block").agg(F.count(F.lit(1)).alias("forms")))
    forms = materialise(alike.join(split, ["least", "block"]))
    whole = sized.drop("n", "o").join(forms.where("forms = 1 and n > 1"), ["least", "block", "hash"])
    whole = whole.select("least", "path", run(F.col("first"), F.col("first") + F.col("size")).alias("run"))
    open_ = forms.where("forms > 1").select("least", "block", "hash", "n", "o", "chosen")
    if kind.sources:
        # each path counts for itself, so that blocks of one hash that differ all the same miss nothing
        opened = blocks.join(open_.select("least", "block", "hash"), ["least", "block", "hash"]).join(own, ["least", "path"])
        opened = opened.withColumn("o", first(F.col("o.start") + F.col("first"))).select("least", "path", "first", "n", "o", F.posexplode("ws").alias("i", "w"))
        opened = opened.withColumn("o", F.struct("o.d", "o.src", (F.col("o.at") + F.col("i")).alias("at")))
    else:
        # a form's count and document stand at the path that was chosen for it
        stands = [F.when(F.col("path") == F.col("chosen"), F.col(c)).alias(c) for c in ("n", "o")]
        opened = blocks.join(open_, ["least", "block", "hash"]).select("least", "path", "first", *stands, F.posexplode("ws").alias("i", "w"))
    windows = materialise(opened.select("least", "path", (F.col("first") + F.col("i")).alias("place"), "w", "n", "o"))
    same = materialise(windows.where("n is not null").groupBy("least", "w").agg(F.sum("n").alias("n"), F.min("o").alias("o")).where("n > 1"))
    place = F.col("place")
    single = windows.select("least", "path", "place", "w").join(same, ["least", "w"]).select("least", "path", run(place, place + 1).alias("run"))
    branching = whole.unionByName(single).groupBy("least", "path").agg(_joined(F.collect_list("run"), kind).alias("runs"))
    found = materialise(straight.unionByName(branching))
    if kind.sources:
        found = compacted(some, own, found, width())
    return some.join(found, ["least", "path"]).select("d", "t", "start", "runs")


def width() -> Column:
    """Number of windows of a path."""
    return (F.col("path").bitwiseAND(F.lit(FIELD << 10)) / (1 << 10)).cast("int")


def _joined(runs: Column, kind: Kind) -> Column:
    """Runs in order; what continues a run of the same document (or source) becomes part of it (n: the smaller one)."""
    kept = ["d", "src", "at"] if kind.sources else ["d"]

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["from"].alias("from"), r["to"].alias("to"), F.least(last["n"], r["n"]).alias("n"), *(last[c].alias(c) for c in kept))
        fits = (last["to"] == r["from"]) & (last["d"] == r["d"])
        if kind.sources:
            fits &= (last["src"] == r["src"]) & (last["at"] - last["from"] == r["at"] - r["from"])
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(runs), F.filter(runs, lambda r: F.lit(False)), add)


def spans(shared: DataFrame, counts: Callable[[Column], Column], kind: Kind) -> DataFrame:
    """t, spans (from, to): tokens of each row that windows cover which counts(run) selects. Spans may overlap."""
    kept = F.filter("runs", counts)
    cover = F.transform(kept, lambda r: F.struct((F.col("start") + r["from"]).alias("from"), (F.col("start") + r["to"] + (kind.window - 1)).alias("to")))
    some = shared.select("t", cover.alias("cover")).where(F.size("cover") > 0)
    return some.groupBy("t").agg(F.flatten(F.collect_set("cover")).alias("spans"))


def merged(found: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans (rows from, to) that cover what found covers; touching ones become one."""
    if not len(found):
        return found.reshape(0, 2)
    found = found[np.argsort(found[:, 0], kind="stable")]
    reach = np.maximum.accumulate(found[:, 1])
    first = np.append(True, found[1:, 0] > reach[:-1])
    return np.stack([found[first, 0], reach[np.append(np.flatnonzero(first)[1:] - 1, len(found) - 1)]], axis=1)

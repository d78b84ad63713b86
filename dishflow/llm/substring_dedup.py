"""Substring dedup by de Bruijn compaction.

Windows of 50 words are the edges of a graph of token k-mers. Runs of edges of one document that share a minimiser are its
first paths: equal ones become one row, and where they branch, their text is fetched at its source coordinate and split
until only equal parts are left (repeats.py). Paths that always follow each other have no branch between them and are
compacted to their chain's head by joins and pointer doubling (unitigs.py). What is found so are hashes; each repeated
stretch is therefore compared word by word with the text at its source coordinates. Windows of stretches that differ from
their source are compared as texts, with all windows of the same minimiser. So a removal never rests on hashes alone.

Defined cases: null and empty texts have no words; documents below 50 words lose nothing; a null doc_id counts as the
largest; rows that share a doc_id take nothing from each other; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishflow.llm.common import materialise, result_of
from dishflow.llm.paths import paths, word_tokens
from dishflow.llm.repeats import FIELD, LISTED_TYPES, Kind, listed, merged, packed_texts, repeated

ANCHOR = 20
PIECE = 64  # words of a source that are sent together
SPANS = "array<struct<from:long,to:long>>"
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept", pa.binary())])
CHECKED = pa.schema([("t", pa.int64()), ("spans", OUT.field("spans").type), ("failed", pa.list_(pa.int64()))])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked pieces of each text: src, piece, words."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for src, packed, asked in zip(*(batch.column(c) for c in ("t", "z", "asked")), strict=True):
            words = unpack.decompress(packed.as_py()).split()
            numbers = asked.values.to_numpy()
            sent = [b" ".join(words[PIECE * i : PIECE * (i + 1)]) for i in numbers.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([src.as_py()] * len(sent), pa.int64()), pa.array(numbers), pa.array(sent, pa.binary())], names=["src", "piece", "words"])


def _compared(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """t, spans: words of windows that are those of a smaller document, word by word; failed: minimisers of all windows in
    stretches that aren't those of their source."""

    def stretches(parts: list[tuple], bad: set) -> tuple[list[tuple], list[int]]:
        """What holds of parts (line, drop, from, to, equal) where some line isn't equal throughout: spans, minimisers."""
        lines = defaultdict(list)
        for line, *part in parts:
            lines[line].append(part)
        spans, failed = [(a, b) for line, drop, a, b, _ in parts if drop and line not in bad], []
        for line in bad:
            equal = merged(np.array([(a, b) for _, a, b, same in lines[line] if same], np.int64).reshape(-1, 2))
            if lines[line][0][0]:
                spans += [(a, b) for a, b in equal.tolist() if b - a >= kind.window]
            failed += merged(np.array([(a, b) for _, a, b, _ in lines[line]], np.int64)).tolist()
        return spans, failed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            column = batch.column("claims")
            ends, flat = column.offsets.to_pylist(), column.values
            src, shift, drop, piece, sent = (flat.field(c).to_pylist() for c in ("src", "shift", "drop", "piece", "words"))
            parts = flat.field("parts")
            part_ends = parts.offsets.to_pylist()
            lo, hi = (parts.values.field(i).to_pylist() for i in (0, 1))
            for no, (t, packed) in enumerate(zip(batch.column("t").to_pylist(), batch.column("z"), strict=True)):
                words = unpack.decompress(packed.as_py()).split()
                found, bad = [], set()
                for i in range(ends[no], ends[no + 1]):
                    theirs, away, base, line = sent[i].split(b" "), shift[i], PIECE * piece[i], (src[i], shift[i])
                    for j in range(part_ends[i], part_ends[i + 1]):
                        a, b = lo[j], hi[j]
                        same = words[a - away : b - away] == theirs[a - base : b - base]
                        found.append((line, drop[i], a - away, b - away, same))
                        if not same:
                            bad.add(line)
                spans, failed = stretches(found, bad) if bad else ([(a, b) for _, drops, a, b, _ in found if drops], [])
                least: set[int] = set()
                for a, b in failed:
                    with np.errstate(over="ignore"):
                        least.update((paths(word_tokens(b" ".join(words[a:b])), kind.window, kind.anchor)[0] & kind.mask).tolist())
                spans = merged(np.array(spans, np.int64).reshape(-1, 2)).tolist()
                rows.append((t, [{"from": a, "to": b} for a, b in spans], sorted(least)))
            if rows:
                yield _rows(CHECKED, rows)

    return run


def _checked(texts: DataFrame, shared: DataFrame, kind: Kind) -> DataFrame:
    """t, spans, failed of each row that has repeated windows and isn't itself their source."""
    run = F.col("run")
    runs = shared.select("d", "t", "start", F.explode("runs").alias("run"))
    claims = runs.select("t", run["src"].alias("src"), (run["at"] - F.col("start") - run["from"]).alias("shift"), (run["d"] < F.col("d")).alias("drop"), run["at"].alias("a"), (run["at"] + run["to"] - run["from"] + (kind.window - 1)).alias("b"))
    number = lambda c: F.floor(c / PIECE)
    cut = claims.where("t != src or shift != 0").withColumn("piece", F.explode(F.sequence(number(F.col("a")), number(F.col("b") - 1))))
    part = F.struct(F.greatest("a", F.col("piece") * PIECE).alias("lo"), F.least("b", (F.col("piece") + 1) * PIECE).alias("hi"))
    asked = materialise(cut.groupBy("t", "src", "shift", "drop", "piece").agg(F.collect_set(part).alias("parts")))
    wanted = asked.select("src", "piece").distinct().groupBy(F.col("src").alias("t")).agg(F.collect_list("piece").alias("asked"))
    pieces = materialise(texts.join(wanted, "t").select("t", "z", "asked").mapInArrow(_pieces, "src long, piece long, words binary"))
    with_words = asked.join(pieces, ["src", "piece"]).groupBy("t").agg(F.collect_list(F.struct("src", "shift", "drop", "piece", "parts", "words")).alias("claims"))
    return materialise(texts.join(with_words, "t").select("t", "z", "claims").mapInArrow(_compared(kind), f"t long, spans {SPANS}, failed array<long>"))


def _by_words(texts: DataFrame, least: DataFrame, kind: Kind) -> DataFrame:
    """t, spans: windows of these minimisers that start in a smaller document too, compared as texts."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for d, t, packed, asked in zip(*(batch.column(c) for c in ("d", "t", "z", "asked")), strict=True):
                words = unpack.decompress(packed.as_py()).split()
                for one in asked.as_py():
                    at = range(one["start"], one["start"] + (one["path"] >> 10 & FIELD))
                    own = [b" ".join(words[i : i + kind.window]) for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array([d.as_py()] * len(at)), pa.array([t.as_py()] * len(at)), pa.array(list(at), pa.int64()), pa.array(own, pa.binary())], names=["d", "t", "at", "words"])

    every = texts.select("d", "t", "z").mapInArrow(listed(kind), LISTED_TYPES).join(least, "least", "left_semi")
    asked = every.groupBy("t").agg(F.collect_list(F.struct("path", "start")).alias("asked"))
    own = materialise(texts.join(asked, "t").select("d", "t", "z", "asked").mapInArrow(windows, "d long, t long, at long, words binary"))
    first = materialise(own.groupBy("words").agg(F.min("d").alias("first")))
    cover = F.struct(F.col("at").alias("from"), (F.col("at") + kind.window).alias("to"))
    return own.join(first, "words").where("first < d").groupBy("t").agg(F.collect_list(cover).alias("spans"))


def repeated_spans(texts: DataFrame, kind: Kind) -> DataFrame:
    """t, spans: words that windows of smaller documents cover. Spans may overlap."""
    checked = _checked(texts, repeated(texts, kind), kind)
    failed = materialise(checked.select(F.explode("failed").alias("least")).distinct())
    sure = checked.select("t", "spans").where(F.size("spans") > 0)
    if failed.isEmpty():
        return sure
    return sure.unionByName(_by_words(texts, failed, kind)).groupBy("t").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def drop_repeated_passages(docs: DataFrame, window: int = 50, anchor: int = ANCHOR, mask: int = -1) -> DataFrame:
    """doc_id, n_words, n_removed, spans (words removed), kept (binary: what is left, joined by single spaces). mask: bits
    of hashes that are used; with fewer the result is the same, and takes longer."""
    kind = Kind("words", window, anchor, sources=True, mask=mask)
    texts = packed_texts(docs)
    earlier = result_of(docs.sparkSession, lambda: repeated_spans(texts, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                some = batch.slice(i, 500)
                for doc_id, packed, found in zip(*(some.column(c) for c in ("doc_id", "z", "spans")), strict=True):
                    words = unpack.decompress(packed.as_py()).split()
                    gone = np.empty((0, 2), np.int64)
                    if found.is_valid:
                        gone = merged(np.stack([found.values.field(k).to_numpy() for k in (0, 1)], axis=1))
                    edges = [0, *gone.ravel().tolist(), len(words)]
                    kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                    rows.append((doc_id.as_py(), len(words), len(words) - len(kept), [{"from": a, "to": b} for a, b in gone.tolist()], b" ".join(kept)))
                yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, r, strict=True)) for r in rows], schema=OUT)

    return texts.join(earlier, "t", "left").select("doc_id", "z", "spans").mapInArrow(run, f"doc_id long, n_words long, n_removed long, spans {SPANS}, kept binary")

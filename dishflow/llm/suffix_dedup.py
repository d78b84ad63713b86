"""Removal of every byte that a 400-byte string covers which also starts anywhere else.

The method named for this operator, external induced suffix sorting, sorts every suffix of the corpus through
disk-backed queues; the README says with figures why it doesn't fit here. Instead suffixes are only compared where they
can share 400 bytes: windows of 400 bytes that have the same minimiser meet in joins, whole runs of them at first, and
blocks and single windows where runs differ (see repeats.py). The result is that of the sorted suffixes: a byte goes if
it lies in a window whose string has two or more places in the corpus.

Defined cases: null and empty texts have no bytes; texts below 400 bytes lose nothing; rows that repeat a document are
places of their own; a null doc_id is like any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from dishflow.llm.common import result_of
from dishflow.llm.repeats import Kind, merged, packed_texts, repeated, spans

ANCHOR = 256
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept", pa.binary())])


def drop_repeated_bytes(docs: DataFrame, window: int = 400, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept (binary: the bytes that are left)."""
    kind = Kind("bytes", window, anchor)
    texts = packed_texts(docs)
    elsewhere = result_of(docs.sparkSession, lambda: spans(repeated(texts, kind), lambda r: r["n"] > 1, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                some = batch.slice(i, 500)
                for doc_id, packed, found in zip(*(some.column(c) for c in ("doc_id", "z", "spans")), strict=True):
                    data = unpack.decompress(packed.as_py())
                    gone = np.empty((0, 2), np.int64)
                    if found.is_valid:
                        gone = merged(np.stack([found.values.field(k).to_numpy() for k in (0, 1)], axis=1))
                    edges = [0, *gone.ravel().tolist(), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((doc_id.as_py(), len(data), len(data) - len(kept), [{"from": a, "to": b} for a, b in gone.tolist()], kept))
                yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, r, strict=True)) for r in rows], schema=OUT)

    return texts.join(elsewhere, "t", "left").select("doc_id", "z", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept binary")

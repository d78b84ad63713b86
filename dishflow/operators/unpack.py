"""Packed words to samples, and interleaved streams apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dishflow.formats import lookup
from dishflow.operators.kernels import bytes_kernel

_DTYPES = {8: "u1", -8: "i1", 16: "<u2", -16: "<i2", 32: "<f4", 64: "<f8"}


def decode(raw: np.ndarray, bits: int) -> np.ndarray:
    """1, 2 and 4 bits: unsigned, the most significant first; negative numbers of bits: signed. A rest of bytes that
    makes no whole sample is left out."""
    if bits in (1, 2, 4):
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        return ((raw[:, None] >> shifts) & ((1 << bits) - 1)).ravel()
    kind = np.dtype(_DTYPES[bits])
    return raw[: len(raw) // kind.itemsize * kind.itemsize].view(kind)


def _words(x: np.ndarray, streams: int) -> list[np.ndarray]:
    x = x[: len(x) // (4 * streams) * (4 * streams)].reshape(-1, streams, 4)
    return [x[:, i].ravel() for i in range(streams)]


#: Each splits the samples of one buffer; a rest that is no whole group is left out.
SPLITS: dict[str, Callable[[np.ndarray], list[np.ndarray]]] = {
    "": lambda x: [x],
    "1212": lambda x: [x[: len(x) // 2 * 2][i::2] for i in (0, 1)],
    "1122": lambda x: [x[: len(x) // 4 * 4].reshape(-1, 2, 2)[:, i].ravel() for i in (0, 1)],
    "word2": lambda x: _words(x, 2),
    # samples are signed; flipping the top bit of the widened number moves them by 128
    "word4_xor": lambda x: [np.where(y >= 0, y.astype(np.int64) + 128, y.astype(np.int64) - 128) for y in _words(x, 4)],
}


def unpack(df: DataFrame, key: str, raw: str, bits: int, interleave: str = "") -> DataFrame:
    """key, stream, x: the samples of each row's bytes."""
    split = SPLITS[interleave]
    return bytes_kernel(df, key, raw, lambda b: split(decode(b, bits)))


def format_split(bits: int, name: str) -> str:
    """By format name. Two polarisations come in pairs of equal ones only for signed bytes, else sample by sample."""
    how = lookup(name).interleave
    return "1212" if how == "1122" and bits != -8 else how


def unpack_format(df: DataFrame, key: str, raw: str, bits: int, name: str) -> DataFrame:
    return unpack(df, key, raw, bits, format_split(bits, name))


def unpack_digest(df: DataFrame, key: str, raw: str, bits: int, interleave: str = "") -> DataFrame:
    """key, stream, n, total, checksum (value times place % 251 + 1) of each row's samples, summed where they are unpacked.
    Streams without samples give no row."""
    split = SPLITS[interleave]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for stream, x in enumerate(split(decode(np.frombuffer(data.as_py() or b"", np.uint8), bits))):
                    if len(x):
                        v = x.astype(np.int64)
                        rows.append((k, stream, len(v), int(v.sum()), int(((np.arange(len(v)) % 251 + 1) * v).sum())))
            if rows:
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[key, "stream", "n", "total", "checksum"])

    return df.select(key, raw).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, stream int, n long, total long, checksum long")


UNPACKED = "doc_id long, stream int, place long, x double"


class UnpackTable:
    """SQL's unpack_samples(TABLE(...) PARTITION BY ...): a row for each sample of rows (doc_id, raw, bits, format)."""

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc_id, raw, bits, name in zip(*(table.column(table.schema.get_field_index(c)) for c in ("doc_id", "raw", "bits", "format")), strict=True):
            streams = SPLITS[format_split(bits.as_py(), name.as_py())](decode(np.frombuffer(raw.as_py() or b"", np.uint8), bits.as_py()))
            for stream, x in enumerate(streams):
                cols = [np.full(len(x), doc_id.as_py(), np.int64), np.full(len(x), stream, np.int32), np.arange(len(x)), x.astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "stream", "place", "x"])


def register_unpack(spark: SparkSession) -> None:
    spark.udtf.register("unpack_samples", F.arrow_udtf(UnpackTable, returnType=UNPACKED))

"""Byte layouts of what a capture writes: array files, time series, filterbank headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def npy_bytes(re: np.ndarray, im: np.ndarray, channels: int) -> bytes:
    """A dynamic spectrum as an .npy file: complex64, (channels, times)."""
    import io

    out = io.BytesIO()
    np.save(out, (np.asarray(re) + 1j * np.asarray(im)).astype("<c8").reshape(channels, -1))
    return out.getvalue()


def tim_bytes(series: np.ndarray) -> bytes:
    """A time series as raw 32-bit floats."""
    return np.asarray(series, "<f4").tobytes()


def header_string(text: str) -> bytes:
    raw = text.encode()
    return struct.pack("<i", len(raw)) + raw


def header_entry(key: str, value: int | float | str) -> bytes:
    """A key and its value as a 32-bit integer, a double or a string with its length before it."""
    body = header_string(value) if isinstance(value, str) else struct.pack("<i", value) if isinstance(value, int) else struct.pack("<d", value)
    return header_string(key) + body


def filterbank_header(entries: dict[str, int | float | str]) -> bytes:
    return header_string("HEADER_START") + b"".join(header_entry(k, v) for k, v in entries.items()) + header_string("HEADER_END")


def header_entries(rows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """key, entry (binary): the header entry of `name` with each row's value; a null value gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [header_entry(name, "" if v is None else v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[key, "entry"])

    return rows.select(key, value).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, entry binary")

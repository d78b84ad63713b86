"""Arrow batches to numpy and back, for the operators that expressions can't state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _rows(col: pa.Array) -> list[np.ndarray]:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    offsets = col.offsets.to_numpy() - col.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _lists(rows: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if len(rows) else np.empty(0)).cast(kind))


def stacked_kernel(df: DataFrame, keep: Sequence[str], arrays: Sequence[str], out: Sequence[str], fn: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """Columns `keep` as they are and arrays `out` of doubles: fn gets each of `arrays` stacked to (rows, n), one call for
    all rows of a batch that have the same length, and returns as many stacked arrays (rows, m)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [_rows(batch.column(batch.schema.get_field_index(c))) for c in arrays]
            sizes = np.array([len(x) for x in cols[0]], np.int64)
            found: list[list] = [[None] * batch.num_rows for _ in out]
            for n in np.unique(sizes):
                which = np.flatnonzero(sizes == n)
                for col, got in zip(found, fn(*(np.stack([c[i] for i in which]).astype(float) for c in cols)), strict=True):
                    for i, x in zip(which, got, strict=True):
                        col[i] = x
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(_lists(x, pa.float64()) for x in found)], names=[*keep, *out])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), *(f"{c} array<double>" for c in out)])
    return df.select(*keep, *arrays).mapInArrow(run, schema)


def bytes_kernel(df: DataFrame, key: str, raw: str, fn: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """key, stream, x (array of doubles): fn makes the samples of each stream from the bytes of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                keys, streams, rows = [], [], []
                some = batch.slice(at, 64)
                for k, data in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                    for i, x in enumerate(fn(np.frombuffer(data.as_py() or b"", np.uint8))):
                        keys.append(k)
                        streams.append(i)
                        rows.append(x.astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(streams, pa.int32()), _lists(rows, pa.float64())], names=[key, "stream", "x"])

    return df.select(key, raw).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, stream int, x array<double>")

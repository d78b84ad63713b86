"""What a capture keeps of a segment, as pieces of files (file, at, data), and what is read back from such files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishflow.config import Config
from dishflow.operators import detect
from dishflow.operators.dedisperse import reserved_samples
from dishflow.operators.headers import npy_bytes, tim_bytes
from dishflow.operators.rfi import parse_zap_list, zap_bins
from dishflow.sources.capture_sink import PIECES


def capture_pieces(caught: DataFrame, c: Config) -> DataFrame:
    """Of caught segments (counter, x, boxcars): their samples as bytes (<counter>.bin), the cleaned spectrum
    (<counter>.0.npy) and the series of each of boxcars (<counter>.<boxcar>.tim)."""
    zapped, reserved = zap_bins(parse_zap_list(c.zap_list), c.bins, c.freq_low, c.bandwidth), reserved_samples(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counter, x, boxcars in zip(*batch.columns, strict=True):
                x = x.values.to_numpy()[None]
                spectra = detect.cleaned_spectra(x, c, zapped)
                series = dict(detect.boxcar_series(detect.cleaned_series(spectra, c, reserved), c.max_boxcar))
                files = {f"{counter}.bin": x[0].astype(np.uint8).tobytes(), f"{counter}.0.npy": npy_bytes(spectra[0].real, spectra[0].imag, spectra.shape[1])}
                files |= {f"{counter}.{b}.tim": tim_bytes(series[b][0]) for b in boxcars.as_py() or ()}
                yield pa.RecordBatch.from_arrays([pa.array(files.keys(), pa.string()), pa.array([0] * len(files), pa.int64()), pa.array(files.values(), pa.binary())], names=["file", "at", "data"])

    return caught.select(F.col("counter").cast("string"), "x", "boxcars").mapInArrow(run, PIECES)


def recording_pieces(segments: DataFrame, segment_bytes: int, reserved: int, each: int) -> DataFrame:
    """Every segment (seg, raw; only the last one of a stream may be shorter) without the bytes that the next one reads
    again, `each` segments a file: files are named by their first byte's place, and one after the other they are the stream."""
    step = segment_bytes - reserved
    kept = segments.select("seg", F.expr(f"substring(raw, 1, octet_length(raw) - {reserved})").alias("data")).where(F.octet_length("data") > 0)
    first = F.expr(f"seg div {each}") * each
    name = F.concat(F.lpad((first * step).cast("string"), 20, "0"), F.lit(".bin"))
    return kept.select(name.alias("file"), ((F.col("seg") - first) * step).alias("at"), "data")


def spectra_of_files(files: DataFrame) -> DataFrame:
    """file, chan, re, im of .npy files (file, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*batch.columns, strict=True):
                z = np.load(io.BytesIO(content.as_py()))
                cols = [pa.array([file.as_py()] * len(z)), pa.array(range(len(z)), pa.int64()), *(pa.array(v.astype(float).tolist(), pa.list_(pa.float64())) for v in (z.real, z.imag))]
                yield pa.RecordBatch.from_arrays(cols, names=["file", "chan", "re", "im"])

    return files.select("file", "content").mapInArrow(run, "file string, chan long, re array<double>, im array<double>")


def series_of_files(files: DataFrame) -> DataFrame:
    """file, y of .tim files (file, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = [np.frombuffer(x.as_py(), "<f4").astype(float) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.list_(pa.float64()))], names=["file", "y"])

    return files.select("file", "content").mapInArrow(run, "file string, y array<double>")

"""A sink for files of raw bytes: captures, spectra, time series and recordings.

    spark.dataSource.register(CaptureSink)
    pieces.repartition(n, "file").sortWithinPartitions("file", "at").write.format("captures").mode("append").save(uri)

Rows are pieces of files (file, at, data): a file's pieces come together and in order, and are written as they come, so a
file may be larger than memory; what no piece covers is a fault or, with option holes, zeros. Tasks write below _temporary and report what they wrote; files get their names
only when all tasks have ended, by renames, so a killed or repeated task leaves no half file and a failed write none at
all. Mode append refuses names that exist, overwrite replaces files of the same names.

As a streaming sink, which fills holes, every batch is committed once: its number is noted in _commits after its files have their names. A
batch that runs again after a failure writes the same names, or nothing if it was noted. File names must follow from the
rows alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from dishflow.sources.store import file_system

PIECES = "file string, at long, data binary"


@dataclass
class Staged(WriterCommitMessage):
    """Files of one task: name, where it lies, bytes."""

    files: list[tuple[str, str, int]] = field(default_factory=list)


class _Stage:
    """What tasks and the driver do with one write."""

    def __init__(self, uri: str, holes: bool = False) -> None:
        self.uri, self.holes, self.run = uri.rstrip("/"), holes, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        system, base = file_system(self.uri)
        folder = f"{base}/_temporary/{self.run}/{uuid.uuid4().hex}"  # an attempt's own
        done, out, name, at = Staged(), None, "", 0
        try:
            for batch in batches:
                for file, begins, data in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("file", "at", "data")), strict=True):
                    file, begins, data = file.as_py(), begins.as_py(), data.as_py() or b""
                    if file != name or not name:
                        self._named(file, done)
                        if out:
                            out.close()
                            done.files.append((name, f"{folder}/{name}", at))
                        system.create_dir(folder)
                        out, name, at = system.open_output_stream(f"{folder}/{file}"), file, 0
                    while self.holes and begins > at:
                        at += out.write(bytes(min(begins - at, 1 << 20)))
                    if begins != at:
                        raise ValueError(f"{name}: a piece at {begins} follows {at} bytes")
                    out.write(data)
                    at += len(data)
        finally:
            if out:
                out.close()
        if name:
            done.files.append((name, f"{folder}/{name}", at))
        return done

    @staticmethod
    def _named(file: str | None, done: Staged) -> None:
        if not file or "/" in file or file[0] in "_.":
            raise ValueError(f"not a file name: {file!r}")
        if any(file == x[0] for x in done.files):
            raise ValueError(f"{file}: its pieces don't come together")

    def publish(self, messages: list[Staged | None], replace: bool) -> None:
        system, base = file_system(self.uri)
        files = [x for m in messages if m for x in m.files]
        names = [x[0] for x in files]
        if len(set(names)) < len(names):
            raise ValueError("pieces of one file were in several tasks")
        there = [x for x in system.get_file_info([f"{base}/{n}" for n in names]) if x.type != fs.FileType.NotFound] if names else []
        if there and not replace:
            raise FileExistsError(there[0].path)
        for x in there:
            system.delete_file(x.path)
        for name, lies, _ in files:
            system.move(lies, f"{base}/{name}")
        self.clear()

    def clear(self) -> None:
        system, base = file_system(self.uri)
        if system.get_file_info(f"{base}/_temporary/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/_temporary/{self.run}")


class CaptureWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool, holes: bool = False) -> None:
        self.stage, self.overwrite = _Stage(uri, holes), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.stage.write(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.stage.publish(messages, self.overwrite)

    def abort(self, messages: list[Staged | None]) -> None:
        self.stage.clear()


class CaptureStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, uri: str, holes: bool = True) -> None:
        self.stage = _Stage(uri, holes)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.stage.write(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        system, base = file_system(self.stage.uri)
        note = f"{base}/_commits/{batchId}"
        if system.get_file_info(note).type == fs.FileType.NotFound:
            self.stage.publish(messages, replace=True)
            system.create_dir(f"{base}/_commits")
            with system.open_output_stream(note) as out:
                out.write("".join(f"{n} {size}\n" for m in messages if m for n, _, size in m.files).encode())
        else:
            self.stage.clear()

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.stage.clear()


class CaptureSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], overwrite, self.options.get("holes", "false").lower() == "true")

    def streamWriter(self, schema, overwrite: bool) -> CaptureStreamWriter:  # noqa: N802
        return CaptureStreamWriter(self.options["path"])


def save(pieces: DataFrame, uri: str, mode: str = "append") -> None:
    """Writes pieces (file, at, data), in any order, as files below uri."""
    spark = pieces.sparkSession
    spark.dataSource.register(CaptureSink)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select("file", "at", "data").repartition(n, "file").sortWithinPartitions("file", "at")
    dealt.write.format("captures").mode(mode).save(uri)

"""Baseband files as a Spark data source: one row for each segment, segments may overlap.

    spark.dataSource.register(BasebandSource)
    spark.read.format("baseband").option("path", "/data/x.bin").option("segment_bytes", 4096).option("reserved_bytes", 512).load()

Options: path (comma-separated files or folders in any store that store.file_system reaches), segment_bytes, reserved_bytes (read again by the next
segment), offset_bytes (header to skip), per_partition (segments of a task), emit_trailing_zero_segment (as recorders
that notice a file's end only by a short read: a file of exactly k segments gives k + 1). The last segment is padded
with zeros. Segment borders follow from the sizes that the store tells, and tasks read only the bytes of their segments, so
every segment can be read by any task again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dishflow.sources.store import file_system, sizes

SCHEMA = "file string, seg bigint, start bigint, raw binary"


def segment_count(size: int, segment: int, reserved: int, trailing: bool = False) -> int:
    """Segments of a file of `size` bytes behind its header."""
    if size <= 0:
        return 0
    step = segment - reserved
    if trailing:
        return 1 if size < segment else (size - segment) // step + 2
    return 1 if size <= segment else -(-(size - segment) // step) + 1


@dataclass
class Segments(InputPartition):
    file: str
    first: int
    last: int


class BasebandReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = [x.strip() for x in options["path"].split(",")]
        self.segment, self.reserved = int(options["segment_bytes"]), int(options.get("reserved_bytes", 0))
        self.offset, self.each = int(options.get("offset_bytes", 0)), int(options.get("per_partition", 64))
        self.trailing = options.get("emit_trailing_zero_segment", "false").lower() == "true"
        if not 0 <= self.reserved < self.segment:
            raise ValueError("reserved_bytes must be below segment_bytes")

    def partitions(self) -> list[Segments]:
        out = []
        for uri in self.files:
            for file, size in sizes(uri).items():
                n = segment_count(size - self.offset, self.segment, self.reserved, self.trailing)
                file = uri if uri.endswith(file) else f"{uri.rstrip('/')}/{file.rsplit('/', 1)[-1]}"
                out += [Segments(file, a, min(n, a + self.each)) for a in range(0, n, self.each)]
        return out

    def read(self, partition: Segments) -> Iterator[pa.RecordBatch]:
        system, path = file_system(partition.file)
        with system.open_input_file(path) as f:
            for seg in range(partition.first, partition.last):
                start = self.offset + seg * (self.segment - self.reserved)
                raw = f.read_at(self.segment, start).ljust(self.segment, b"\0")
                yield pa.RecordBatch.from_arrays([pa.array([partition.file]), pa.array([seg]), pa.array([start]), pa.array([raw], pa.binary())], names=["file", "seg", "start", "raw"])


class BasebandSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "baseband"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BasebandReader:
        return BasebandReader(dict(self.options))

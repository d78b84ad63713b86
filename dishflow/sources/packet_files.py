"""Packets that a recorder drops into a folder, as a stream.

    spark.dataSource.register(PacketFiles)
    spark.readStream.format("packet_files").schema(s).option("path", uri).load()

The folder's Parquet files are the stream, in the order of their names; a file must be complete when its name appears and
never change, as after a rename, and names must grow. An offset is the last file's name, so it means the same after a
restart and in a listing that was made while files arrived; every file of a batch is a partition of its own, read in Arrow
batches. The folder lies in any store that store.file_system reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from dishflow.sources.store import file_system, sizes


@dataclass
class PacketFile(InputPartition):
    path: str


class PacketReader(DataSourceStreamReader):
    def __init__(self, uri: str, schema) -> None:
        self.uri, self.schema = uri, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"last": max(self._files(), default="")}

    def partitions(self, start: dict, end: dict) -> list[PacketFile]:
        return [PacketFile(path) for name, path in sorted(self._files().items()) if start["last"] < name <= end["last"]]

    def read(self, partition: PacketFile) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(self.schema)
        system, _ = file_system(self.uri)
        with system.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=10_000, columns=kind.names):
                cols = [batch.column(batch.schema.get_field_index(x.name)).cast(x.type) for x in kind]
                yield pa.RecordBatch.from_arrays(cols, schema=kind)

    def _files(self) -> dict[str, str]:
        return {x.rsplit("/", 1)[-1]: x for x in sizes(self.uri) if x.endswith(".parquet")}


class PacketFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packet_files"

    def streamReader(self, schema) -> PacketReader:  # noqa: N802
        return PacketReader(self.options["path"], schema)

"""The folder that driver and executors share, and files in any store that Spark's file systems reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local one only where it is unset in local mode (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="dishflow-")
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what is used twice is made once, and lost executors cost no rerun."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """What reads and writes a path, and the path there: file:, hdfs: (through libhdfs), s3:, gs: and plain absolute paths.
    Python workers use it; they have no JVM of their own."""
    return fs.FileSystem.from_uri(uri)


def sizes(uri: str) -> dict[str, int]:
    """Bytes of a file, or of each file right in a folder but those whose names begin with _ or a dot; in order of names."""
    system, path = file_system(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path))
    return {x.path: x.size for x in sorted(found, key=lambda x: x.path) if x.is_file and (info.is_file or x.base_name[:1] not in "_.")}

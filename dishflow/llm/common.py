"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = 5_500_000  # below what the token encoder takes at once, so that it gets whole batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where it names none and runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="dishflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_scopes: list[list[str]] = []  # paths that results are written to, for each result_of that is being made


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_batches(spark: SparkSession, size: int = ARROW_BYTES) -> AbstractContextManager[None]:
    """What runs within sends Python workers batches of about that many bytes: both sides hold several copies of one."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def row_reader(spark: SparkSession) -> AbstractContextManager[None]:
    """What runs within reads Parquet row by row, not 4,096 rows at a time, whatever their size."""
    return _setting(spark, "spark.sql.parquet.enableVectorizedReader", "false")


def materialise(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/dishflow-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    with arrow_batches(df.sparkSession):
        df.write.options(compression="zstd", **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def result_of(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make(), written; the tables that it has written on its way are deleted then."""
    inner: list[str] = []
    _scopes.append(inner)
    try:
        made = make()
        _scopes.pop()
        done = materialise(made)
    finally:
        if _scopes and _scopes[-1] is inner:
            _scopes.pop()
        for name in inner:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id BIGINT, text STRING (null: empty), whatever else df carries."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_rows(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of each text, without decoding."""
    col = batch.column(batch.schema.get_field_index(name))
    for x in col.cast(pa.large_binary()):
        yield x.as_py() or b""


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

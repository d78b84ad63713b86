"""Tables as signals: the conventions by which stored tables stand for telescope data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dishflow.operators.kernels import stacked_kernel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, n: int = 256) -> DataFrame:
    """seg, pos, x: events as one stream of 8-bit samples in segments of n."""
    x = (F.round(F.col("value") * 100).cast("long") % 256).cast("double")
    return table(spark, sf_dir, "events").select(F.expr(f"event_id div {n}").alias("seg"), (F.col("event_id") % n).alias("pos"), x.alias("x"))


def segments(long_rows: DataFrame, n: int, key: str = "seg", pos: str = "pos", value: str = "x") -> DataFrame:
    """key, x: one array of n doubles a segment; positions that have no row are 0. Rows come in any order: a segment's
    values are scattered to their places in numpy."""

    def fn(p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray]:
        out = np.zeros((len(p), n))
        out[np.arange(len(p))[:, None], p.astype(np.int64)] = v
        return (out,)

    cells = long_rows.groupBy(key).agg(F.collect_list(F.struct(F.col(pos).cast("double").alias("p"), F.col(value).alias("v"))).alias("c"))
    grouped = cells.select(key, F.transform("c", lambda z: z["p"]).alias("p"), F.transform("c", lambda z: z["v"]).alias("v"))
    return stacked_kernel(grouped, [key], ["p", "v"], ["x"], fn)


def documents_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw: texts as packed words of a digitiser."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, pos, x (64 components)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("x"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counter, b: one byte a packet; every packet whose counter leaves 13 by 97 is lost."""
    x = F.round(F.col("value") * 100).cast("long") % 256
    return table(spark, sf_dir, "events").where("event_id % 97 <> 13").select(F.col("event_id").alias("counter"), x.alias("b"))

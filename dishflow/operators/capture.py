"""Which segments are kept: those with a signal, and those near one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_ns(input_count: int, sample_rate: float) -> int:
    """Fixed value: 0.45 of a segment's time."""
    return int(0.45e9 * input_count / sample_rate)


def captured(works: DataFrame, window: int, real_time: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """works (..., ts, has_signal) that are written. Real time: also those strictly within `window` of a positive. Positives
    are put into buckets of the window's width and announced to both neighbours, so the join is on equality; each bucket
    keeps only its first and last positive, which decide for all."""
    if not real_time:
        return works.where("has_signal")
    bucket = F.floor(F.col("ts") / window)
    ends = works.where("has_signal").groupBy(*keys, bucket.alias("b")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    near = ends.select(*keys, F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("bucket"), "lo", "hi")
    at = works.withColumn("bucket", bucket)
    inside = (F.abs(F.col("n.lo") - F.col("w.ts")) < window) | (F.abs(F.col("n.hi") - F.col("w.ts")) < window)
    on = F.col("w.bucket") == F.col("n.bucket")
    for k in keys:
        on = on & (F.col(f"w.{k}") == F.col(f"n.{k}"))
    return at.alias("w").join(near.alias("n"), on & inside, "left_semi").drop("bucket")

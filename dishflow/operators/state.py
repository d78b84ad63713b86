"""Running state that passes from span to span, and band lists that come as tables: joins on equality only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carried_mean_1bit(spans: DataFrame, w: int, start: DataFrame | None = None, by: str = "chan") -> DataFrame:
    """by, span, first, bits, ave: whether each value of a series exceeds its running mean. spans (by, span, x): consecutive
    stretches of each series of any lengths of at least w; the series goes on as its mirror image. The mean begins as that
    of the first w values, or as `start` (by, ave) has it from an earlier series, and moves by (entering - leaving) / w.
    ave: the mean behind a span, which the next one begins with; behind the last it is what a later series starts with.

    Two facts of each span make its state: the sum by which the mean moves, and how many values it has. Prefix sums over
    spans (a row each) give every span the mean at its beginning, so spans are judged side by side."""
    order = Window.partitionBy(by).orderBy("span")
    # each span sees the first w values of the next one; the last sees its own end, mirrored
    seen = spans.select(by, "span", "x", F.lead(F.slice("x", 1, w)).over(order).alias("next"), F.first(F.slice("x", 1, w)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("head"), F.size("x").cast("long").alias("n"))
    ahead = F.coalesce("next", F.reverse(F.slice("x", F.size("x") - w + 1, F.lit(w))))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    moved = total(ahead) - total(F.slice("x", 1, w))  # entering minus leaving, summed: what is in both cancels
    known = seen.select(by, "span", "x", ahead.alias("ahead"), "n", moved.alias("moved"), (total("head") / w).alias("own"))
    if start is not None:
        known = known.join(start.select(by, F.col("ave").alias("given")), by, "left").withColumn("own", F.coalesce("given", "own"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = known.select(by, "span", "x", "ahead", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), (F.col("own") + F.coalesce(F.sum("moved").over(before), F.lit(0.0)) / w).alias("ave"))
    names = [by, "span", "first", "bits", "ave"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, ends = [], []
            for x, ahead, ave in zip(batch.column(3), batch.column(4), batch.column(5).to_numpy(), strict=True):
                own = x.values.to_numpy()
                entering = np.append(own[w:], ahead.values.to_numpy())[: len(own)]
                means = ave + np.append(0.0, np.cumsum(entering - own)) / w
                bits.append((own > means[:-1]).astype(np.int32))
                ends.append(means[-1])
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(bits, pa.list_(pa.int32())), pa.array(ends, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = dict(spans.dtypes)
    return placed.select(by, "span", "first", "x", "ahead", "ave").mapInArrow(run, f"{by} {kinds[by]}, span {kinds['span']}, first long, bits array<int>, ave double")


def merged_ranges(ranges: DataFrame, by: str = "seg") -> DataFrame:
    """by, lo, hi: disjoint ranges that cover the same whole numbers as those of a table (by, lo, hi, both inclusive)."""
    order = Window.partitionBy(by).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = ranges.where("lo <= hi").select(by, "lo", "hi", F.when(F.col("lo") <= reach + 1, 0).otherwise(1).alias("opens"))
    numbered = opens.withColumn("no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("no")


def range_bins(ranges: DataFrame, n: int, freq_low: float, bandwidth: float, by: str = "seg") -> DataFrame:
    """by, lo, hi (bins): of frequency ranges (by, f_lo, f_hi) in any order; a range that leaves the band is skipped."""
    bins = [F.round((F.col(f) - freq_low) / bandwidth * (n - 1)).cast("long") for f in ("f_lo", "f_hi")]
    found = ranges.select(by, F.least(*bins).alias("lo"), F.greatest(*bins).alias("hi"))
    return found.where((F.col("lo") >= 0) & (F.col("hi") < n))


def zap_table(spectrum: DataFrame, ranges: DataFrame, by: str = "seg", bin_col: str = "k", width: int = 64) -> DataFrame:
    """Bins of a spectrum (by, k, re, im) that ranges (by, lo, hi) of their segment hold become 0. Ranges are merged, so that
    a bin meets one at most, and cut at multiples of `width`: the join is on the segment and the bin's stretch."""
    cut = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("stretch")
    pieces = merged_ranges(ranges, by).select(F.col(by).alias("of"), "lo", "hi", cut)
    at = spectrum.withColumn("stretch", F.floor(F.col(bin_col) / width)).alias("s")
    on = (F.col(f"s.{by}") == F.col("r.of")) & (F.col("s.stretch") == F.col("r.stretch")) & F.col(f"s.{bin_col}").between(F.col("r.lo"), F.col("r.hi"))
    joined = at.join(pieces.alias("r"), on, "left")
    hit = F.col("r.lo").isNotNull()
    return joined.select(*(F.when(hit, F.lit(0.0)).otherwise(F.col(f"s.{c}")).alias(c) if c in ("re", "im") else F.col(f"s.{c}") for c in spectrum.columns))

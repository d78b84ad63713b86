"""Area resampling, normalisation and colour maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dishflow.functions.scalars import argb, color

#: The display's colours for 0, for 1 and for what lies outside.
COLOR_0, COLOR_1, COLOR_OUT = "#1f1e33", "#33e1f1", "#e0e1cc"


def area_weights(df: DataFrame, axis: str, n_in: int, n_out: int, out: str) -> DataFrame:
    """Rows for every output cell that an input cell overlaps, with the overlap (in input cells) multiplied into
    `weight`. An input cell lists its output cells itself (at most n_out/n_in + 2 of them), so no range join is needed."""
    ratio = n_in / n_out
    low, high = F.col(axis).cast("double"), F.col(axis) + F.lit(1.0)
    first = F.floor(low / ratio).cast("int")
    last = F.least(F.ceil(high / ratio).cast("int") - 1, F.lit(n_out - 1))
    cells = df.withColumn(out, F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), F.greatest(last, first))))
    overlap = F.least(high, (F.col(out) + 1) * F.lit(ratio)) - F.greatest(low, F.col(out) * F.lit(ratio))
    weight = overlap * F.col("weight") if "weight" in df.columns else overlap
    return cells.withColumn("weight", weight).where((F.col(out) < n_out) & (overlap > 1e-9))


def resample_1d(df: DataFrame, by: list[str], axis: str, value: str, n_in: int, n_out: int) -> DataFrame:
    """by, out, v: overlap-weighted sums."""
    return area_weights(df, axis, n_in, n_out, "out").groupBy(*by, "out").agg(F.sum(F.col("weight") * F.col(value)).alias("v"))


def resample_area(df: DataFrame, by: list[str], value: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """by, oy, ox, v. df: by, y, x, value. One axis after the other, so each step multiplies rows by few and sums them up."""
    once = area_weights(df, "y", *rows, "oy").groupBy(*by, "oy", "x").agg(F.sum(F.col("weight") * F.col(value)).alias("v"))
    return area_weights(once, "x", *cols, "ox").groupBy(*by, "oy", "ox").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))


def resample_linear(df: DataFrame, by: list[str], value: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """by, oy, ox, v: area along y, linear interpolation along x; the neighbour right of the last column is the last."""
    once = area_weights(df, "y", *rows, "oy").groupBy(*by, "oy", "x").agg(F.sum(F.col("weight") * F.col(value)).alias("v"))
    n_in, n_out = cols
    ratio = n_in / n_out
    ox = F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_out - 1)), lambda o: (F.floor(o * F.lit(ratio)) == F.col("x")) | (F.least(F.floor(o * F.lit(ratio)) + 1, F.lit(n_in - 1)) == F.col("x")))).alias("ox")
    near = once.select("*", ox)
    at = F.col("ox") * F.lit(ratio)
    left = F.floor(at)
    share = at - left
    weight = F.when(F.col("x") == left, 1 - share).otherwise(F.lit(0.0)) + F.when(F.col("x") == F.least(left + 1, F.lit(n_in - 1)), share).otherwise(F.lit(0.0))
    return near.groupBy(*by, "oy", "ox").agg(F.sum(weight * F.col("v")).alias("v"))


def normalise_average(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Value over twice its mean, where the mean is above the smallest step of a float."""
    mean = F.avg(value).over(Window.partitionBy(*by))
    return df.withColumn(value, F.when(mean > 1.1920929e-07, F.col(value) / (2 * mean)).otherwise(F.col(value)))


def pixmap(v: Column, c0: str = COLOR_0, c1: str = COLOR_1, out: str = COLOR_OUT) -> Column:
    """ARGB of values 0..1 between two colours, components cut to whole numbers."""
    a, b = color(c0), color(c1)
    mixed = [F.floor((1 - v) * F.lit(float(a >> s & 255)) + v * F.lit(float(b >> s & 255))).cast("long") for s in (16, 8, 0)]
    return F.when((v >= 0) & (v <= 1), argb(F.lit(255).cast("long"), *mixed)).otherwise(F.lit(color(out)).cast("long"))

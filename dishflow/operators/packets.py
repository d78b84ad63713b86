"""Packets to blocks of samples; counters, gaps, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dishflow.functions.scalars import little_endian

#: VDIF header fields as word, first bit, number of bits.
VDIF = {
    "seconds": (0, 0, 30), "legacy": (0, 30, 1), "invalid": (0, 31, 1), "frame": (1, 0, 24), "epoch": (1, 24, 6), "length_8": (2, 0, 24), "log2_channels": (2, 24, 5),
    "version": (2, 29, 3), "station": (3, 0, 16), "thread": (3, 16, 10), "bits_1": (3, 26, 5), "complex": (3, 31, 1), "user_0": (4, 0, 24), "edv": (4, 24, 8),
}


def bit_field(word: Column, first: int, bits: int) -> Column:
    return F.shiftright(word, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def vdif_fields(words: list[Column]) -> dict[str, Column]:
    """Header fields of unsigned 32-bit words."""
    return {k: bit_field(words[w], a, n) for k, (w, a, n) in VDIF.items()}


def vdif_counter(words: list[Column]) -> Column:
    return words[6] + F.shiftleft(words[7].bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), 32)


def parse(df: DataFrame, raw: str, header: int, counter_at: int = 0) -> DataFrame:
    """counter (little-endian, 8 bytes) and payload of each packet."""
    return df.withColumn("counter", little_endian(F.col(raw), counter_at, 8)).withColumn("payload", F.expr(f"substring({raw}, {header + 1})"))


def gaps(df: DataFrame, by: list[str], counter: str = "counter", span: int = 4096) -> DataFrame:
    """df with gap: packets missing right before each one; the first of a stream misses none. Neighbours are looked for
    within spans of counters and at their borders (a row a span), so that one long stream uses many tasks."""
    spanned = df.withColumn("span", F.floor(F.col(counter) / span).cast("long"))
    inner = Window.partitionBy(*by, "span").orderBy(counter)
    edges = spanned.groupBy(*by, "span").agg(F.max(counter).alias("last"))
    border = edges.withColumn("before", F.lag("last").over(Window.partitionBy(*by).orderBy("span"))).select(*by, "span", "before")
    known = spanned.withColumn("own", F.lag(counter).over(inner)).join(border, [*by, "span"])
    return known.select(*df.columns, F.coalesce(F.col(counter) - F.coalesce("own", "before") - 1, F.lit(0)).cast("long").alias("gap"))


def gap_filled(df: DataFrame, by: list[str], value: str, span: int = 4096) -> DataFrame:
    """by, counter, value: a row for every counter between a stream's first and last, 0 where a packet is missing. A gap is
    cut into pieces of `span` counters before it is filled, so that no row holds a long one."""
    ends = gaps(df, by, span=span).where("gap > 0").select(*by, (F.col("counter") - F.col("gap")).alias("first"), (F.col("counter") - 1).alias("last"))
    pieces = ends.select(*by, "last", F.explode(F.sequence("first", "last", F.lit(span).cast("long"))).alias("first"))
    missing = F.explode(F.sequence("first", F.least("last", F.col("first") + span - 1))).alias("counter")
    zeros = pieces.select(*by, missing, F.lit(0).cast(dict(df.dtypes)[value]).alias(value))
    return df.select(*by, "counter", value).unionByName(zeros)


def running_totals(df: DataFrame, values: list[str], order: str, span: int = 4096) -> DataFrame:
    """df with upto_<value> for each of values: sums over rows up to this one by `order` (a whole number). Sums run within
    spans of `order`; what comes before a span is added to it, so only one row a span is summed in one task."""
    spanned = df.withColumn("span", F.floor(F.col(order) / span).cast("long"))
    sums = spanned.groupBy("span").agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("span", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"before_{v}") for v in values))
    inner = Window.partitionBy("span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    within = spanned.withColumns({f"upto_{v}": F.sum(v).over(inner) for v in values}).join(before, "span")
    return within.select(*df.columns, *((F.col(f"upto_{v}") + F.col(f"before_{v}")).alias(f"upto_{v}") for v in values))


def blocks(df: DataFrame, size: int, first: int, by: list[str] = [], value: str = "b", arrival: str | None = None) -> DataFrame:  # noqa: B006
    """by, block, slot, value: every slot of each block that has a packet. Packets before `first` are stale and dropped, of
    equal counters that of the last `arrival` stays (without such a column: the largest value, as rows have no order), slots
    without a packet are 0. Only blocks that occur are expanded."""
    last = F.max_by(value, arrival) if arrival else F.max(value)
    own = df.where(F.col("counter") >= first).groupBy(*by, "counter").agg(last.alias(value))
    placed = own.withColumn("block", F.floor((F.col("counter") - first) / size).cast("long")).withColumn("slot", (F.col("counter") - first) % size)
    slots = placed.select(*by, "block").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    return slots.join(placed.drop("counter"), [*by, "block", "slot"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def loss_statistics(df: DataFrame, size: int, first: int) -> DataFrame:
    """block, received, lost, rate, total_rate: of distinct counters in each block, and of all blocks up to it."""
    got = df.where(F.col("counter") >= first).groupBy(F.floor((F.col("counter") - first) / size).cast("long").alias("block")).agg(F.countDistinct("counter").alias("received"))
    lost = running_totals(got.withColumn("lost", size - F.col("received")).withColumn("size", F.lit(size).cast("long")), ["lost", "size"], "block")
    return lost.select("block", "received", "lost", (F.col("lost") / size).alias("rate"), (F.col("upto_lost") / F.col("upto_size")).alias("total_rate"))

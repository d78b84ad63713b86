"""Mixing sources to target weights along a curriculum whose weights change over training time.

A source's weight is piecewise linear in time 0..1. Its integral sets the source's share of the words of the mix; a
target stops at `most` times the source's size and the excess goes to the others by weight (water filling, solved with
prefix sums over the sources sorted by the level at which they fill up). A source is read in hash order, pass after
pass, until its target is met; a document's place in that sequence, inverted through the integrated weight, is its
position in training. Everything is DataFrame expressions; the running sums are numbered within hash parts of a source
after the sums of the parts before, so a source of any size is spread over many tasks.

Defined cases: null text has size 0; the null source is a source of its own, sorted last; documents without words take
part with 0 words; repeated rows are documents of their own; an empty table gives an empty result; rows are
ordered by a hash of doc_id and text, so a null or repeated doc_id is like any other; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dishflow.llm.common import materialise, shuffle_partitions

WORDS = r"[^\x20\x09-\x0D]+"
PART_ROWS = 20_000
#: Weights at evenly spaced times for sources in order, repeated; their integrals are 3, 1 and 2.
CURRICULUM = ((4.5, 3.0, 1.5), (0.5, 1.0, 1.5), (2.0, 1.0, 4.0))


def segments(weights: Sequence[float]) -> list[tuple[float, float, float, float, float]]:
    """(time from, weight there, slope, area before, area after) between the knots."""
    step, area, out = 1 / (len(weights) - 1), 0.0, []
    for i, (a, b) in enumerate(zip(weights, weights[1:], strict=False)):
        out.append((i * step, float(a), (b - a) / step, area, area := area + (a + b) / 2 * step))
    return out


def targets(sizes: DataFrame, curriculum: Sequence[Sequence[float]], share: float, most: float) -> DataFrame:
    """source, source_size, target, segments of each source. sizes: source, size; the work is on one row a source."""
    spark = sizes.sparkSession
    classes = spark.createDataFrame(
        [(i, segments(w)) for i, w in enumerate(curriculum)], "class int, segments array<struct<t:double,w:double,slope:double,before:double,after:double>>"
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("class", ((F.row_number().over(by_name) - 1) % len(curriculum)).cast("int")).join(F.broadcast(classes), "class")
    weighed = ranked.withColumn("weight", F.element_at("segments", -1)["after"]).withColumn("full", most * F.col("source_size")).withColumn("level", F.col("full") / F.col("weight"))
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    left = share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    tried = weighed.withColumn("tried", left / F.greatest(weight_left, F.col("weight")))
    # sources fill up in the order of their levels; the first that doesn't sets the level of all that remain
    level = F.min(F.when(F.col("level") > F.col("tried"), F.struct("level", "tried"))).over(all_rows)["tried"]
    found = tried.withColumn("common", level)
    target = F.when(F.col("common").isNull() | (F.col("level") <= F.col("common")), F.col("full")).otherwise(F.col("common") * F.col("weight"))
    return found.select("source", "source_size", target.alias("target"), "segments")


def position(part: Column, segments_: Column) -> Column:
    """The time by which a source has had this part (0..1) of its demand: the inverse of its integrated weight."""
    need = part * F.element_at(segments_, -1)["after"]
    at = F.coalesce(F.element_at(F.filter(segments_, lambda s: s["before"] <= need), -1), segments_[0])
    rest = F.greatest(need - at["before"], F.lit(0.0))
    root = at["w"] + F.sqrt(F.greatest(at["w"] * at["w"] + 2 * at["slope"] * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), at["t"] + F.coalesce(F.try_divide(2 * rest, root), F.lit(0.0)))


def mix(docs: DataFrame, curriculum: Sequence[Sequence[float]] = CURRICULUM, share: float = 1.5, most: float = 2.0, keys: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, uses (pass, words, whole, position), and the columns in keys.

    words: how many a pass takes, cut at the target; whole: whether the middle of the document lies before the target,
    for those who take whole documents only. share: words of the mix for each word of docs.
    """
    spark = docs.sparkSession
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text", F.lit(7)).alias("h"), *keys))
    goals = materialise(targets(sized, curriculum, share, most))
    parts = max(shuffle_partitions(spark), -(-sized.count() // PART_ROWS))
    hashed = sized.withColumn("part", F.floor(F.pmod("h", F.lit(1 << 40)) * parts / (1 << 40)).cast("int"))
    sums = hashed.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = hashed.withColumn("upto", F.sum("size").over(within)).join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    start = F.col("before") + F.col("upto") - F.col("size")
    goal = goals.withColumnRenamed("source", "s")
    known = placed.withColumn("start", start).drop("s", "p").join(goal, F.col("source").eqNullSafe(F.col("s")))
    words_in = F.round("target").cast("long")

    def use(i: Column) -> Column:
        begin = i * F.col("source_size") + F.col("start")
        middle = begin + F.col("size") / 2
        return F.struct(
            i.cast("int").alias("pass"),
            F.greatest(F.lit(0), F.least(F.col("size"), words_in - begin)).cast("long").alias("words"),
            (middle <= F.col("target")).alias("whole"),
            position(F.coalesce(F.try_divide(F.least(middle, F.col("target")), F.col("target")), F.lit(0.0)), F.col("segments")).alias("position"),
        )

    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))) - 1, F.lit(0)).cast("int"))
    uses = F.filter(F.transform(passes, use), lambda u: (u["words"] > 0) | u["whole"])
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + u["words"])
    return known.withColumn("uses", uses).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "uses", *keys)


def training_order(mixed: DataFrame, whole: bool = False) -> DataFrame:
    """A row for each use of a document (with `whole`: of a whole one), sorted by its position in training."""
    used = mixed.withColumn("use", F.explode("uses")).drop("uses")
    used = used.where("use.whole" if whole else "use.words > 0").select("*", F.col("use.position").alias("position")).drop("use")
    return used.repartitionByRange(shuffle_partitions(mixed.sparkSession), "position", "doc_id").sortWithinPartitions("position", "doc_id")

"""Stages of the corpus pipeline: documents in, documents out (the last: packed pieces).

A doc_id names a document. Defined cases: rows that share a doc_id but not their text are told apart where the operator
does so (quality, exact dedup, mixing); the near-dedup stage numbers rows, so one row of a group stays whatever the ids.
Rows with a null doc_id or text take part in every stage; an empty table passes through; further columns pass through
unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dishflow.llm.common import materialise, result_of, shuffle_partitions, table, text_rows
from dishflow.llm.exact_dedup import exact_dedup, normalised
from dishflow.llm.mixing import mix
from dishflow.llm.near_copies import near_copies
from dishflow.llm.packing import pack_documents
from dishflow.llm.quality import keep_accepted


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but for those whose quality the classifier predicts as 0."""
    return keep_accepted(docs, table(spark, sf_dir, "labels"))


def _numbered(rows: DataFrame, by: list[str], nth: str, docs: DataFrame) -> DataFrame:
    """rows with nth (from 1) among those of equal `by`, in an order that all of their columns decide, so that a task that
    runs again numbers them alike; rows that are equal throughout may change places."""
    order = [F.col(c) for c, t in docs.dtypes if "map<" not in t and t != "variant"]
    return rows.withColumn(nth, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the row that exact dedup keeps; of several rows with its doc_id and text, one. Only rows that
    repeat both, which are few, are numbered; the others aren't shuffled for it."""
    digest, nth, kept_id, kept_digest, copies = (_free(docs, c) for c in ("digest", "nth", "kept_id", "kept_digest", "copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([hashlib.sha256(normalised(x)).digest() for x in text_rows(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, digest])

    result = materialise(exact_dedup(docs))
    named = lambda d: d.select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(kept_digest))
    # rows of the kept document: of most there is one
    alike = result.where("doc_id IS NOT DISTINCT FROM keep_id AND group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias(copies))
    alike = materialise(named(alike.where(F.col(copies) > 1)))
    kept = materialise(named(result.where("kept")))
    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(digest, T.BinaryType())]))
    on = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest))
    same = F.col("one." + kept_id).eqNullSafe(F.col("two." + kept_id)) & (F.col("one." + kept_digest) == F.col("two." + kept_digest))
    once = rows.join(kept.alias("one").join(alike.alias("two"), same, "left_anti"), on, "left_semi")
    many = _numbered(rows.join(alike, on, "left_semi"), ["doc_id", digest], nth, docs).where(F.col(nth) == 1)
    return once.select(*docs.columns).unionByName(many.select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (similarity of five-word shingles 0.8 or more, over chains of links): that
    of the smallest doc_id, null last. op1's three words and 3 of 64 bits are its own contract and don't bind the stage."""
    row = _free(docs, "row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    near = result_of(spark, lambda: near_copies(numbered.select(F.col(row).alias("row"), "doc_id", "text")))
    stays = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best")).select("best.row")
    gone = materialise(near.select("row").join(stays, "row", "left_anti").withColumnRenamed("row", row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, in the order of training. Few rows repeat both doc_id and text: only
    those are numbered, to share out their uses; the texts of all others meet their uses in one shuffle."""
    inner = ("text_hash", "nth", "m_id", "m_text", "m_uses", "m_nth", "m_use", "a_id", "a_text", "copies")
    text, nth, m_id, m_text, m_uses, m_nth, m_use, a_id, a_text, copies = (_free(docs, c) for c in inner)
    rows = docs.withColumn(text, F.xxhash64("text"))
    mixed = result_of(spark, lambda: mix(rows, keys=[text]).select(F.col("doc_id").alias(m_id), F.col(text).alias(m_text), F.filter("uses", lambda u: u["whole"]).alias(m_uses)))
    alike = mixed.groupBy(m_id, m_text).agg(F.count(F.lit(1)).alias(copies)).where(F.col(copies) > 1)
    alike = materialise(alike.select(F.col(m_id).alias(a_id), F.col(m_text).alias(a_text)))
    repeated = F.col(m_id).eqNullSafe(F.col(a_id)) & (F.col(m_text) == F.col(a_text))
    on = F.col("doc_id").eqNullSafe(F.col(m_id)) & (F.col(text) == F.col(m_text))
    once = rows.join(mixed.where(F.size(m_uses) > 0).join(alike, repeated, "left_anti"), on).select(*docs.columns, m_uses)
    many = mixed.join(alike, repeated, "left_semi").withColumn(m_nth, F.row_number().over(Window.partitionBy(m_id, m_text).orderBy(m_uses)))
    own = rows.join(alike, F.col("doc_id").eqNullSafe(F.col(a_id)) & (F.col(text) == F.col(a_text)), "left_semi")
    shared = _numbered(own, ["doc_id", text], nth, docs).join(many, on & (F.col(nth) == F.col(m_nth))).select(*docs.columns, m_uses)
    used = once.unionByName(shared).select("*", F.explode(m_uses).alias(m_use))
    place = F.col(m_use)["position"]
    ordered = used.repartitionByRange(shuffle_partitions(spark), place, "doc_id").sortWithinPartitions(place, "doc_id")
    return ordered.select(*docs.columns)


def pack_tokens(tokenizer: str):
    def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """Pieces of at most 2,048 tokens with their sequence and offset."""
        return pack_documents(docs, tokenizer, end_id=0, capacity=2048)

    return pack_sequences

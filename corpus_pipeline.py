"""From raw documents to packed training sequences; counted as part of dishflow.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dishflow.llm.common import materialise, table
from dishflow.llm.stages import drop_copies, drop_near_copies, drop_rejected, mix_sources, pack_tokens

STAGES = [
    ("quality classifier", drop_rejected),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_tokens(public_tokenizers.path("byte_bpe_50k.json"))),
]

#: SQL has no byte-level BPE, no discriminant and no connected components; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

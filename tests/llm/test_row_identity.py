"""Many different texts under one doc_id or none: rows are told apart whatever hashes say."""

import random

import pytest
from pyspark.sql import functions as F

from dishflow.llm.repeats import packed_texts
from dishflow.llm.substring_dedup import drop_repeated_passages
from dishflow.llm.suffix_dedup import drop_repeated_bytes
from tests.llm.test_dedup import passages, strings


def rows():
    rng = random.Random(11)
    words = [f"v{i}" for i in range(400)]
    shared = rng.choices(words, k=60)
    out = [(i, " ".join(rng.choices(words, k=i) + shared)) for i in (1, 2)]
    for doc_id in (None, 7):
        out += [(doc_id, " ".join(rng.choices(words, k=n) + (shared if n % 2 else []) + rng.choices(words, k=50 - n))) for n in range(20)]
    return out + out[-3:]


@pytest.fixture
def same_hash(monkeypatch):
    """Every text has the same hash in Spark, as some have by chance among very many."""
    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.lit(5))


def test_rows_are_numbered(spark):
    texts = packed_texts(spark.createDataFrame(rows(), "doc_id long, text string").repartition(3))
    assert texts.select("t").distinct().count() == len(rows())


def test_passages_of_rows_with_one_id(spark, same_hash):
    got = drop_repeated_passages(spark.createDataFrame(rows(), "doc_id long, text string").repartition(3), 30, 12)
    found = sorted(str((a, b, c, bytes(e))) for a, b, c, e in got.select("doc_id", "n_words", "n_removed", "kept").collect())
    assert found == sorted(passages(rows(), 30))


def test_bytes_of_rows_with_one_id(spark, same_hash):
    got = drop_repeated_bytes(spark.createDataFrame(rows(), "doc_id long, text string").repartition(3), 60, 25)
    found = sorted(str((a, b, c, e, bytes(f))) for a, b, c, e, f in got.select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept").collect())
    assert found == sorted(strings(rows(), 60))

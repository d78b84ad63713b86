from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use inside, as further columns of the input.
CLASH = ["fp", "digest", "keep_id", "kept", "size", "part", "target", "least", "path", "d", "t", "z", "spans", "piece", "length", "sequence_id", "score", "x", "component_id", "nth", "uses"]


def odd_rows() -> list[tuple]:
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "δέλτα", "e", "\x0b", "日本", "ww"]
    passage = " ".join(rng.choice(words) for _ in range(80))
    texts = ["", None, " ", "\n\t ", "one", "two words", passage, passage, passage.upper(), passage + " end", "start " + passage, "A  b\tc", "a b c", " lead", "trail \n", "<|endoftext|> x", "x" * 500, "y " * 700, "nul\x00byte", "\x85next line"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(20)]
    rows = [(i, t, "en", rng.choice(["s1", "s2", "S3", None])) for i, t in enumerate(texts)]
    rows += [(None, passage, None, None), (None, None, None, None), (3, "other text of id 3", "en", "s1")]
    rows += rows[4:8]  # repeated rows
    rows.append((10**15, " ".join(rng.choice(words) for _ in range(30_000)), "en", "s2"))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

"""Each stage of the pipeline on its own input, against brute force, and the whole run."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from dishflow.llm import exact_dedup, mixing, near_copies, quality, simhash_dedup, stages
from dishflow.llm.common import materialise
from dishflow.llm.quality import classify
from tests.llm.test_near_copies import groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF)))
    return out


def test_stages(spark, steps):
    docs, good, once, far, mixed, packed = steps
    for x in (good, once, far, mixed):
        assert x.columns == docs.columns
    bad = {r.doc_id for r in classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").collect()}
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - bad
    first = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(first.values())
    rows = sorted(once.collect(), key=lambda r: r.doc_id)
    label = groups([r.text for r in rows])  # five words, similarity 0.8: op1's three words and bits bind its query only
    assert sorted(r.doc_id for r in far.collect()) == sorted({rows[label.index(v)].doc_id for v in label})
    uses = Counter(r.doc_id for r in mixed.collect())
    assert set(uses) <= {r.doc_id for r in far.collect()} and max(uses.values()) <= 2
    assert {r.doc_id: r.n for r in packed.where("piece = 0").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()} == uses


def test_odd_rows_pass(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES:
        odd, empty = (materialise(stage(spark, x, SF)) for x in (odd, empty))
    assert odd.count() > 0 and empty.count() == 0


def test_stages_bear_any_column_name(spark):
    """Every name that a stage uses inside, as a further column of its input; null and repeated rows."""
    names = set(re.findall(r'"([a-z_]+)"', "".join(open(m.__file__).read() for m in (stages, mixing, exact_dedup, quality, near_copies, simhash_dedup)))) - {"doc_id", "text", "lang", "source", "n_chars"}
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "a  b c d e f", "s"), (None, "x y z", None), (None, "x y z", None), (None, "x  y z", "t"), (3, None, "s"), (4, "", None), (4, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in sorted(names)})
    assert {"m_uses", "kept_id", "a_text", "root"} <= set(docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        assert docs.count() > 0 and (name == "best-fit packing" or set(names) <= set(docs.columns)), name


def test_equal_rows_are_numbered_alike(spark):
    """Of rows with one id and text that differ in other columns, the one that stays doesn't depend on their order."""
    rows = [(None, "a b", "en", "s1"), (None, "a  b", "de", "s2"), (None, "a b", "fr", None), (7, "a b", "xx", "s3"), (7, "a b", "aa", "s3"), (9, "c", "en", None), (9, "c", "de", None)]
    kept = set()
    for turn in range(3):
        some = rows[turn:] + rows[:turn]
        kept.add(str(sorted(map(str, stages.drop_copies(spark, spark.createDataFrame(some, "doc_id long, text string, lang string, source string").repartition(turn + 1), SF).collect()))))
    assert len(kept) == 1 and "aa" in kept.pop()


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", k)[0] for k in __spark_entry__.queries() if k.startswith("op")}
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", ["op2_topk", "op3_chat_format", "op6_substring_dedup", "op10_exact_dedup"])
def test_query_equals_sql(spark, duck, sf, name):
    from tests.conftest import same_rows

    same_rows(__spark_entry__.queries()[name](spark, sf), duck.sql(__spark_entry__.oracle_sql()[name]))

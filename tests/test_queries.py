"""Every signal query against its SQL."""

import pytest

from dishflow.jobs import catalogue, files, live, long, more
from tests.conftest import same_rows


QUERIES, SQL = catalogue.QUERIES | more.QUERIES | long.QUERIES | files.QUERIES | live.QUERIES, catalogue.SQL | more.SQL | long.SQL | files.SQL | live.SQL


@pytest.mark.parametrize("name", [k for k in QUERIES if k in SQL])
def test_query_equals_sql(spark, duck, sf, name):
    same_rows(QUERIES[name](spark, sf), duck.sql(SQL[name]))


def test_stream_windows_equal_batch(spark, sf):
    from pyspark.sql import functions as F

    got = {(r.start_us, r.event_type): r.n for r in live.stream_windows(spark, sf).collect()}
    e = spark.read.parquet(f"{sf}/events.parquet")
    want = e.groupBy(F.window(F.col("ts").cast("timestamp"), "5 minutes"), "event_type").count().select(F.unix_micros("window.start").alias("s"), "event_type", "count")
    want = {(r.s, r.event_type): r["count"] for r in want.collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Queries that do their whole job, or say that they couldn't."""
import pytest
from loam.plans import registry
from loam.sources import paged

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_a_question_is_guarded_to_its_end(spark, tmp_path):
    rows = [(1, 17, "user", "a " * 900 + "then drop table t"), (1, 17 + 25, "user", "a " * 900), (1, 17 + 50, "user", "b")]  # the attack that is added to each is none
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.allowed, r.flags, r.truncated) for r in registry.QUERIES["guarded_questions"](spark, str(tmp_path)).collect()}
    assert got == {17: (False, "sql_payload", True), 42: (True, "", True), 67: (True, "", False)}
    assert "substr(text" not in registry.ORACLE["guarded_questions"]


@pytest.mark.parametrize(("feed", "said"), [("down", "OSError: down"), ("cut", "EOFError: 6 rows of ")])
def test_a_feed_that_fails_is_no_result(spark, monkeypatch, feed, said):
    real = paged.scan
    monkeypatch.setattr(paged, "scan", lambda spark, **options: real(spark, **{**options, "fetcher": f"tests.failing_feed:{feed}"}))
    with pytest.raises(Exception, match=said):
        registry.QUERIES["paged_scan"](spark, SF).collect()


def test_pages_beyond_the_most_are_told(spark):
    options = {"fetcher": "loam.sources.paged:from_table", "path": f"{SF}/orders.parquet", "key": "o_orderkey", "time": "o_orderdate", "since": "1990-01-01", "until": "2030-01-01", "days": "20000", "size": "100"}
    n = spark.read.parquet(options["path"]).count()
    rows = paged.scan(spark, pages="3", **options)
    assert rows.where(F.col("id").isNotNull()).count() == 300 < n and [r.error for r in paged.failures(rows).collect()] == ["EOFError: more than 3 pages from 1990-01-01 to 2030-01-01"]
    rows = paged.scan(spark, pages=str(-(-n // 100)), errors="raise", **options)
    assert rows.where(F.col("id").isNotNull()).count() == n and paged.failures(rows).isEmpty()

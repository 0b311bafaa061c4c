"""The paged source: rows and requests; the content sink: failed tasks, repeated batches."""
import glob
import json
import os

import pytest
from loam.sources import paged, sink

from pyspark.sql import functions as F
from tests.paged_fixture import ROWS


def requests(log):
    return [json.loads(x) for f in os.listdir(log) for x in open(f"{log}/{f}")]


def scan(spark, log, name="index_pages", **options):
    os.makedirs(log, exist_ok=True)
    return paged.scan(spark, fetcher=f"tests.paged_fixture:{name}", log=str(log), **{"since": "2024-01-01", "until": "2024-10-01", "size": "20", **options})


def test_pages_of_windows(spark, tmp_path):
    got = scan(spark, tmp_path / "a", days="100").collect()
    assert sorted((r.id, r.at, r.raw_text) for r in got) == ROWS and {r.error for r in got} == {None}
    made = requests(tmp_path / "a")
    windows = {(r["start"], r["end"]) for r in made}
    assert windows == {("2024-01-01", "2024-04-10"), ("2024-04-10", "2024-07-19"), ("2024-07-19", "2024-10-01")}
    of = {w: sum(w[0] <= at[:10] < w[1] for _, at, _ in ROWS) for w in windows}
    assert {w: sum((r["start"], r["end"]) == w for r in made) for w in windows} == {w: -(-n // 20) for w, n in of.items()}


def test_a_cursor_stops_below_since(spark, tmp_path):
    got = scan(spark, tmp_path / "a", "cursor_pages", order="desc", since="2024-08-20").collect()
    want = {r for r in ROWS if r[1][:10] >= "2024-08-20"}
    assert {(r.id, r.at, r.raw_text) for r in got} == want
    assert len(requests(tmp_path / "a")) == len(want) // 20 + 1 < len(ROWS) // 20


def test_queries_share_what_was_seen_and_one_may_fail(spark, tmp_path):
    rows = scan(spark, tmp_path / "a", days="400", queries='["even", "broken", "all"]')
    got = rows.collect()
    assert sorted(r.id for r in got if r.id) == [r[0] for r in ROWS]
    assert {r.query: sum(x.query == r.query for x in got) for r in got} == {"even": 125, "broken": 1, "all": 125}
    assert [(r.query, r.error, r.n) for r in paged.failures(rows).collect()] == [("broken", "OSError: down", 1)]
    twice = rows.union(rows.withColumn("at", F.lit("2023-01-01T00:00:00")))
    assert sorted(map(tuple, paged.entries(twice).collect())) == ROWS


def test_filters_reach_the_fetcher(spark, tmp_path):
    got = scan(spark, tmp_path / "a").where("id in ('id007', 'id100', 'nobody')").collect()
    assert sorted(r.id for r in got) == ["id007", "id100"]
    assert requests(tmp_path / "a") == [{"ids": ["id007", "id100", "nobody"]}]
    assert [r.id for r in scan(spark, tmp_path / "b").where("id = 'id003' and raw_text like '%3%'").collect()] == ["id003"]
    assert requests(tmp_path / "b") == [{"ids": ["id003"]}]
    # a bound within a day narrows the days and stays with Spark
    got = scan(spark, tmp_path / "c", days="400").where("at >= '2024-03-05T04:00:00' and at < '2024-03-20T02:00:00'").collect()
    assert {r.id for r in got} == {i for i, at, _ in ROWS if "2024-03-05T04:00:00" <= at < "2024-03-20T02:00:00"}
    assert {(r["start"], r["end"]) for r in requests(tmp_path / "c")} == {("2024-03-05", "2024-03-21")}
    plan = scan(spark, tmp_path / "d").where("id = 'id003' and at > '2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "> 2024-01-01" in plan and "id003" not in plan  # what the feed answers in full isn't asked again


def rows(spark, values):
    return spark.createDataFrame(values, "sha256 string, n long")


def test_rows_are_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    sink.insert(rows(spark, [(f"h{i}", i) for i in range(100)] + [("h1", 1), (None, 7), (None, 7)]), path, buckets=4)
    sink.insert(rows(spark, [(f"h{i}", -i) for i in range(90, 120)]), path, buckets=4)
    sink.insert(rows(spark, [("h5", 0)]), path, buckets=4)
    want = [(f"h{i}", i if i < 100 else -i) for i in range(120)] + [(None, 7)]
    assert sorted(map(tuple, sink.stored(spark, path, "sha256 string, n long").collect()), key=repr) == sorted(want, key=repr)
    assert sink.manifest(path)["version"] == 3
    with pytest.raises(Exception, match="several tasks"):
        rows(spark, [("x1", 1), ("x2", 2), ("x1", 1), ("x2", 2)]).repartition(4).write.format("content").options(path=path, buckets="1").mode("append").save()
    assert sink.stored(spark, path, "sha256 string, n long").count() == 121
    assert len(glob.glob(f"{path}/data/*")) == sum(map(len, sink.manifest(path)["files"].values()))


def test_a_failed_task_leaves_no_row(spark, tmp_path):
    path = str(tmp_path / "t")
    sink.insert(rows(spark, [("a", 1)]), path, buckets=4)
    bad = rows(spark, [(f"b{i}", i) for i in range(40)]).withColumn("n", F.when(F.col("n") == 33, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        sink.insert(bad, path, buckets=4)
    assert sink.manifest(path)["version"] == 1
    assert [tuple(r) for r in sink.stored(spark, path, "sha256 string, n long").collect()] == [("a", 1)]
    sink.insert(rows(spark, [("a", 5), ("c", 2)]), path, buckets=4)
    assert sorted(map(tuple, sink.stored(spark, path, "sha256 string, n long").collect())) == [("a", 1), ("c", 2)]


def test_a_repeated_batch_leaves_no_row(spark, tmp_path):
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    for n in range(3):
        rows(spark, [(f"h{i}", n) for i in range(n * 5, n * 5 + 10)]).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("sha256 string, n long").option("maxFilesPerTrigger", 1).parquet(source)
    sink.insert_stream(stream(), path, f"{tmp_path}/c", "s").awaitTermination()
    first = sorted(map(tuple, sink.stored(spark, path, "sha256 string, n long").collect()))
    assert [k for k, _ in first] == sorted(f"h{i}" for i in range(20)) and sink.manifest(path)["version"] == 3
    # the checkpoint is lost: batches come again under the same numbers
    sink.insert_stream(stream(), path, f"{tmp_path}/c2", "s").awaitTermination()
    assert sorted(map(tuple, sink.stored(spark, path, "sha256 string, n long").collect())) == first and sink.manifest(path)["version"] == 3


def test_a_table_feed_makes_rows_of_what_is_asked_alone(monkeypatch):
    from loam.sources import paged

    made, tuples = [], paged._tuples

    def counted(table, *args):
        made.append(table.num_rows)
        return tuples(table, *args)
    monkeypatch.setattr(paged, "_tuples", counted)
    options = {"path": "/root/testdata/sf0.001/orders.parquet", "key": "o_orderkey", "time": "o_orderdate"}
    found = paged.from_table({"ids": ["7", "70", "none"]}, options)["rows"]
    assert sorted(r[0] for r in found) == ["7", "70"] and sum(made) == 2
    made.clear()
    whole = paged.from_table({"start": "1990-01-01", "end": "2030-01-01", "offset": 0, "size": 10**6}, options)
    page = paged.from_table({"start": "1990-01-01", "end": "2030-01-01", "offset": 20, "size": 10}, options)
    assert page["rows"] == whole["rows"][20:30] == sorted(whole["rows"], key=lambda r: (r[1], r[0]))[20:30] and made == [whole["total"], 10] and whole["total"] > 1000

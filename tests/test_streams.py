"""Keyed tables, their crashes and repeats, and state of streams."""
import glob
import os
import random
import time

import pytest
from loam.plans import registry
from loam.sources.keyed import Conflict, KeyedTable, merge_stream
from loam.streaming import state

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def least(old, batch):
    both = batch if old is None else old.unionByName(batch)
    return both.groupBy("k").agg(F.min("v").alias("v"), F.max("w").alias("w"))


def rows(spark, values):
    return spark.createDataFrame(values, "k string, v long, w long")


def held(table, version=None):
    return {r.k: (r.v, r.w) for r in table.read(version).collect()}


def files(path):
    return {f: os.path.getsize(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k", buckets=8, keep=5)
    assert table.merge(rows(spark, [(f"k{i}", i, i) for i in range(400)]), least) == 1
    before = files(f"{tmp_path}/t")
    assert table.merge(rows(spark, [("k7", -1, 9), ("k7", -3, 2)]), least) == 2
    new = {f: n for f, n in files(f"{tmp_path}/t").items() if f not in before}
    assert len(new) == 1 and sum(new.values()) < sum(before.values()) / 4
    assert held(table) == {f"k{i}": (i, i) for i in range(400) if i != 7} | {"k7": (-3, 9)}
    assert held(table, 1)["k7"] == (7, 7)
    # a key is read from its bucket
    assert [(r.k, r.v) for r in table.lookup(["k7"]).collect()] == [("k7", -3)]
    assert len(table.lookup(["k7"]).inputFiles()) == 1 and len(table.read().inputFiles()) == 8


def test_only_new_rows_are_written(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k", buckets=4, keep=9)
    table.insert_if_absent(rows(spark, [(f"k{i}", i, 0) for i in range(300)] + [("k0", 5, 5)]), order=[F.asc("v")])
    before = files(f"{tmp_path}/t")
    table.insert_if_absent(rows(spark, [(f"k{i}", -1, 0) for i in range(300)] + [("new", 3, 1), ("new", 2, 1)]), order=[F.asc("v")])
    assert sum(files(f"{tmp_path}/t").values()) - sum(before.values()) < sum(before.values()) / 3
    assert held(table) == {f"k{i}": (i, 0) for i in range(300)} | {"new": (2, 1)}
    # nothing new: a version without a file
    at = files(f"{tmp_path}/t")
    table.insert_if_absent(rows(spark, [("new", 0, 0)]))
    assert files(f"{tmp_path}/t") == at and table.merge(rows(spark, []), least) is None


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    count = lambda old, batch: (batch if old is None else old.unionByName(batch)).groupBy("k").agg(F.sum("v").alias("v"), F.max("w").alias("w"))
    table = KeyedTable(spark, f"{tmp_path}/t", "k")
    batch = rows(spark, [("a", 1, 1), ("b", 2, 2)])
    assert table.merge(batch, count, ("s", 0)) == 1
    assert table.merge(batch, count, ("s", 0)) is None and table.insert_if_absent(batch, ("s", 0)) is None
    assert table.merge(batch, count, ("other", 0)) == 2
    assert held(table) == {"a": (2, 1), "b": (4, 2)}


def test_a_crash_between_writing_and_switching(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"{tmp_path}/t", "k")
    table.merge(rows(spark, [("a", 1, 1)]), least)
    good = files(f"{tmp_path}/t")

    def crash(*args):
        raise OSError("lost")
    monkeypatch.setattr(table, "_switch", crash)
    with pytest.raises(OSError):
        table.merge(rows(spark, [("a", 0, 0), ("b", 0, 0)]), least)
    monkeypatch.undo()
    assert held(table) == {"a": (1, 1)} and len(files(f"{tmp_path}/t")) > len(good)
    assert table.sweep() == 0  # too young: another writer may be at work
    assert table.sweep(older_s=-1) == 2 and files(f"{tmp_path}/t") == good
    assert table.merge(rows(spark, [("b", 5, 5)]), least) == 2 and held(table) == {"a": (1, 1), "b": (5, 5)}


def test_of_two_writers_one_wins(spark, tmp_path):
    table, other = (KeyedTable(spark, f"{tmp_path}/t", "k") for _ in range(2))
    table.merge(rows(spark, [("a", 1, 1)]), least)

    def slow(old, batch):
        other.merge(rows(spark, [("b", 1, 1)]), least)
        return least(old, batch)
    with pytest.raises(Conflict):
        table.merge(rows(spark, [("c", 1, 1)]), slow)
    assert held(table) == {"a": (1, 1), "b": (1, 1)}


def test_old_versions_go_and_buckets_split(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k", buckets=2, keep=2)
    for n in range(5):
        table.merge(rows(spark, [(f"k{i}", n, n) for i in range(50)]), least)
    assert table.versions() == [4, 5] and len(files(f"{tmp_path}/t")) == 4
    table.split(3)
    assert table.manifest()["buckets"] == 6 and held(table) == {f"k{i}": (0, 4) for i in range(50)}
    table.merge(rows(spark, [("k3", -7, 0), (None, 1, 1)]), least)
    assert held(table)["k3"] == (-7, 4) and held(table)[None] == (1, 1)


def test_a_lost_checkpoint_starts_again_and_ends_alike(spark, tmp_path):
    source = f"{tmp_path}/in"
    table = KeyedTable(spark, f"{tmp_path}/t", "k")
    want = {}
    for n in range(3):
        batch = [(f"k{(i * 7 + n) % 20}", (i * 13 + n) % 31, n) for i in range(30)]
        rows(spark, batch).coalesce(1).write.mode("append").parquet(source)
        for k, v, w in batch:
            a, b = want.get(k, (99, -1))
            want[k] = (min(a, v), max(b, w))
    stream = lambda: spark.readStream.schema("k string, v long, w long").option("maxFilesPerTrigger", 1).parquet(source)
    merge_stream(stream(), table, f"{tmp_path}/c1", least).awaitTermination()
    assert held(table) == want and table.versions()[-1] == 3
    merge_stream(stream(), table, f"{tmp_path}/c1", least).awaitTermination()
    assert table.versions()[-1] == 3
    merge_stream(stream(), table, f"{tmp_path}/c2", least).awaitTermination()  # c1 is lost
    assert held(table) == want and table.versions()[-1] == 6


def to_end(stream, mode, at):
    got = []
    stream.writeStream.foreachBatch(lambda b, n: got.append([r.asDict() for r in b.collect()])).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return got


def test_late_rows_are_put_in_order(spark, tmp_path):
    rng = random.Random(3)
    events = [(f"u{rng.randrange(3)}", 3600 * i, i, rng.random() < 0.6) for i in range(90)]
    shuffled = sorted(events, key=lambda e: e[2] + rng.uniform(0, 12))  # up to twelve hours late
    kind = "user string, s long, nth long, bad boolean"
    for n in range(6):
        spark.createDataFrame(shuffled[n * 15:n * 15 + 15] + shuffled[:1] * (n == 5), kind).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(kind + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = to_end(state.streaks(stream, "user", "ts", "nth", F.col("bad"), "12 hours"), "update", f"{tmp_path}/c")
    last = {r["user"]: (r["now"], r["longest"]) for batch in out for r in batch}
    for user in ("u0", "u1", "u2"):
        now = longest = 0
        for _, _, _, bad in sorted((e for e in events if e[0] == user), key=lambda e: e[1]):
            now = now + 1 if bad else 0
            longest = max(longest, now)
        assert last[user] == (now, longest)


def test_answers_expire(spark, tmp_path):
    # else batches without rows, in which the clock alone moves, go on for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    asked = f"{tmp_path}/asked"

    def fetch(x):
        if x == "bad":
            raise OSError("down")
        with open(f"{asked}-{x}", "a") as f:
            f.write(".")
        return x.upper()

    def ask(ttl_s, *what):
        at = f"{tmp_path}/{ttl_s}"
        spark.createDataFrame([("s", x) for x in what], "source string, url string").coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("source string, url string").parquet(f"{at}/in")
        return sorted((r["url"], r["answer"], r["hit"], bool(r["error"])) for b in to_end(state.answers(stream, "source", "url", fetch, ttl_s), "update", f"{at}/c") for r in b)
    assert ask(600, "a", "b", "a", "bad") == [("a", "A", False, False), ("a", "A", True, False), ("b", "B", False, False), ("bad", None, False, True)]
    assert ask(600, "a", "bad") == [("a", "A", True, False), ("bad", None, False, True)]
    assert os.path.getsize(f"{asked}-a") == 1
    assert ask(1, "b") == [("b", "B", False, False)]
    time.sleep(1)
    assert ask(1, "b") == [("b", "B", False, False)] and os.path.getsize(f"{asked}-b") == 3
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_expiring_answers_are_counted_by_event_time(spark):
    got = {r.user_id: (r.hits, r.misses) for r in registry.QUERIES["stream_expiring_answers"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        until, hits, misses = want.get(r.user_id, (None, 0, 0))
        if until is not None and r.ts < until:
            want[r.user_id] = (until, hits + 1, misses)
        else:
            import datetime
            want[r.user_id] = (r.ts + datetime.timedelta(seconds=3600), hits, misses + 1)
    assert got == {k: v[1:] for k, v in want.items()}

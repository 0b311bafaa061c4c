"""Interval and substring joins against brute force."""
import random

from loam.functions import packages
from loam.operators import ranges

from pyspark.sql import functions as F


def test_cover_is_exact_and_short(spark):
    rows = [(a, b) for a in range(0, 20) for b in range(-1, 33)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", ranges.cover(F.col("a"), F.col("b"), F.lit(6)).alias("c"))
    for r in df.collect():
        held = [x for n in r.c for x in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(held) == list(range(r.a, r.b + 1)) and len(r.c) <= 12


def test_points_in_intervals(spark):
    rng = random.Random(5)
    points = [(rng.choice("abc"), rng.randrange(40), i) for i in range(150)] + [(None, 3, 900), ("a", None, 901), ("only", 5, 902)] + [("a", 7, 903)] * 3
    ends = lambda: rng.choice([None, rng.randrange(-5, 50)])
    intervals = [(rng.choice("abcx"), ends(), ends(), rng.random() < 0.5, rng.random() < 0.5, i) for i in range(120)] + [(None, None, None, True, True, 800), ("a", 9, 3, True, True, 801), ("a", 5, 5, True, False, 802), ("a", 7, 7, True, True, 803)]
    p = spark.createDataFrame(points, "k string, at int, p long").repartition(3)
    i = spark.createDataFrame(intervals, "k string, low int, high int, low_in boolean, high_in boolean, i long").repartition(3)
    got = sorted((r.p, r.i) for r in ranges.within(p, i, "k", "at", "low", "high", "low_in", "high_in").collect())
    inside = lambda x, lo, hi, a, b: (lo is None or x > lo or (a and x == lo)) and (hi is None or x < hi or (b and x == hi))
    want = sorted((n, j) for k, x, n in points for q, lo, hi, a, b, j in intervals if k is not None and k == q and x is not None and inside(x, lo, hi, a, b))
    assert got == want
    assert ranges.within(p.where("false"), i, "k", "at", "low", "high", "low_in", "high_in").collect() == []
    assert ranges.within(p, i.where("false"), "k", "at", "low", "high", "low_in", "high_in").collect() == []


def test_intervals_of_a_payload(spark):
    payload = '{"affected":[{"ranges":[{"events":[{"introduced":"0"},{"fixed":"1.2"},{"introduced":"2.0"},{"last_affected":"2.5"}]},{"events":[{"introduced":"3"}]}]}]}'
    got = spark.range(1).select(packages.osv_intervals(F.lit(payload)).alias("x"), packages.osv_intervals(F.lit("{}")).alias("y")).head()
    assert [tuple(r) for r in got.x] == [(None, "1.2", False), ("2.0", "2.5", True), ("3", None, True)] and got.y == []


def test_names_that_fit(spark):
    left = ["Acme", " acme corp ", "ab", "x", "", None, "ünï", "aaaa", "Acme"]
    right = ["ACME", "acme corporation", "cab", "cabx", "xyz", " ", "münïx", "aaa", "none"]
    pairs, empty = ranges.fuzzy_join(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b")
    low = lambda xs: {x.strip().lower() for x in xs if x and x.strip()}
    assert sorted(map(tuple, pairs.collect())) == sorted((x, y) for x in low(left) for y in low(right) if x in y or y in x)
    assert {r.side: r.n for r in empty.collect()} == {"left": 2, "right": 1}

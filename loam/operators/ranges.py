"""Joins that aren't on equal keys, made into such: points in intervals by dyadic nodes, texts within texts by their rarest gram."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .leaders import numbered


def cover(low: Column, high: Column, levels: Column) -> Column:
    """The fewest dyadic nodes (level, node) that make up the whole numbers from low to high: node k of level l holds those from k * 2**l on. Two a level at most."""
    kind = "array<struct<level:int,node:bigint>>"
    one = lambda level, node: F.array(F.struct(level.cast("int").alias("level"), node.alias("node")))
    none = F.expr(f"cast(array() as {kind})")

    def step(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        open_ = a <= b
        left, right = open_ & (a % 2 == 1), open_ & (b % 2 == 0)
        lone = left & right & (a == b)
        a2, b2 = F.when(left, a + 1).otherwise(a), F.when(right, b - 1).otherwise(b)
        nodes = F.concat(state["nodes"], F.when(left, one(level, a)).otherwise(none), F.when(right & ~lone, one(level, b)).otherwise(none))
        done = ~open_ | (a2 > b2)
        return F.struct(F.when(done, F.lit(1).cast("long")).otherwise(F.shiftright(a2, 1)).alias("a"), F.when(done, F.lit(0).cast("long")).otherwise(F.shiftright(b2, 1)).alias("b"), nodes.cast(kind).alias("nodes"))
    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), none.alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), levels.cast("int")), start, step, lambda s: s["nodes"])


def within(points: DataFrame, intervals: DataFrame, key: str, at: str, low: str, high: str, low_in: str, high_in: str) -> DataFrame:
    """Pairs of points (key, at, ...) and intervals (key, low, high, low_in, high_in, ...) of equal key with at between low and high; `at` and the ends are of one type that can be ordered, a null end is open, and
    the last two columns say whether an end belongs to its interval. Other columns of both must differ in name; rows without a key or a point meet nothing.

    All points and ends are numbered once in the order of (key, value), which makes intervals of whole numbers of them. A point then stands at the nodes above it, an interval at the few dyadic nodes that make it up, and the two
    meet at one node if they meet at all: an equality join, whose rows are the result's. Levels are as many as a key's values need, so points of small keys have few rows, and no key is gathered in a task."""
    points, intervals = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()), intervals.where(F.col(key).isNotNull())
    values = points.select(key, F.col(at).alias("_v")).union(intervals.select(key, low)).union(intervals.select(key, high)).where("_v is not null").distinct()
    ranked = written(numbered(values, [F.asc(key), F.asc("_v")], "_n"), "values")
    spans = ranked.groupBy(key).agg(F.min("_n").alias("_from"), F.max("_n").alias("_to")).withColumn("_levels", F.ceil(F.log2(F.col("_to") - F.col("_from") + 1)).cast("int"))
    of = lambda name: ranked.select(key, F.col("_v").alias(name), F.col("_n").alias(f"_{name}"))
    # places count from the key's first value, so that its levels are enough
    p = points.join(of(at), [key, at]).join(spans, key).withColumn("_place", F.col(f"_{at}") - F.col("_from"))
    levels = F.transform(F.sequence(F.lit(0), F.col("_levels")), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", F.col("_place"), level).alias("node")))
    p = p.select(*points.columns, F.explode(levels).alias("_node"))
    i = intervals.join(of(low), [key, low], "left").join(of(high), [key, high], "left").join(spans, key)
    a = F.coalesce(F.col(f"_{low}") + F.when(F.col(low_in), 0).otherwise(1), F.col("_from")) - F.col("_from")
    b = F.coalesce(F.col(f"_{high}") - F.when(F.col(high_in), 0).otherwise(1), F.col("_to")) - F.col("_from")
    i = i.select(*intervals.columns, F.explode(cover(a, b, F.col("_levels"))).alias("_node"))
    return p.join(i, [key, "_node"]).drop("_node")


#: More runs than a needle can have.
_PLACES = 1 << 31


def grams(c: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.expr("cast(array() as array<string>)"))


def parts_of(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): each pair of needles (needle) and texts (text), both distinct and not empty, of which the first is part of the second.

    Texts stand in an inverted table under their runs of one, two and three characters. A needle is looked up under one run of its own alone, of three characters or as many as it has: the one that the fewest texts
    have, so frequent runs are hardly used; what is found is verified. A needle with a run that no text has meets nothing."""
    c = F.col("text")
    table = written(texts.select("text", F.explode(F.concat(grams(c, 1), grams(c, 2), grams(c, 3))).alias("gram")), "grams")
    n = F.col("needle")
    own = F.when(F.length(n) >= 3, grams(n, 3)).otherwise(F.array(n))
    known = needles.select("needle", F.posexplode(own).alias("at", "gram")).join(table.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    # the least number and the place of its run in one integer, so that a task holds a number for each needle and sorts no runs; -1 is a run that no text has
    least = F.min(F.coalesce(F.col("n") * _PLACES + F.col("at"), F.lit(-1))).alias("least")
    rarest = known.groupBy("needle").agg(least).where("least >= 0").select("needle", F.get(own, (F.col("least") % _PLACES).cast("int")).alias("gram"))
    return rarest.join(table, "gram").where(F.contains("text", F.col("needle"))).select("needle", "text")


def fuzzy_join(left: DataFrame, right: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Names that fit whatever their case and outer blanks: equal, or one part of the other. (a, b) for each pair of distinct lower-case names, and (side, n): how many rows of a side have no name and so fit every
    row of the other, which are not written out. Join the pairs back to the rows of both sides by the lower-case names."""
    name = lambda c: F.lower(F.trim(c))
    # names are read as needles and as texts, so they are written
    own = lambda df, c: written(df.select(name(F.col(c)).alias("name")).where("name is not null and name <> ''").distinct(), "names")
    as_ = lambda df, to: df.select(F.col("name").alias(to))
    lefts, rights = own(left, a), own(right, b)
    inside = parts_of(as_(lefts, "needle"), as_(rights, "text")).select(F.col("needle").alias(a), F.col("text").alias(b))
    # equal names are among the first pairs, and neither side has a pair twice
    around = parts_of(as_(rights, "needle"), as_(lefts, "text")).where("needle <> text").select(F.col("text").alias(a), F.col("needle").alias(b))
    empty = lambda df, c, side: df.where(F.coalesce(name(F.col(c)), F.lit("")) == "").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return inside.union(around), empty(left, a, "left").union(empty(right, b, "right"))

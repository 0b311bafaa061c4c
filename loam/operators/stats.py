"""Counts, trends, quality reports, histograms, alerts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def fixed_counts(df: DataFrame, label: Column, keys: list[str]) -> DataFrame:
    """(label, n): every key, with 0 where it has no row; blank or null counts as `unknown`, which shows only if it has rows; other labels stay."""
    low = F.lower(F.trim(label))
    got = df.groupBy(F.when(low.isNull() | (low == ""), "unknown").otherwise(low).alias("label")).agg(F.count("*").alias("n"))
    dim = df.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return got.join(F.broadcast(dim), got.label == dim.key, "full").select(F.coalesce("label", "key").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def exploded_counts(df: DataFrame, values: Column) -> DataFrame:
    """(label, n) over the elements of an array column; blanks go, repeats count."""
    rows = df.select(F.explode(values).alias("label")).select(F.lower(F.trim("label")).alias("label"))
    return rows.where("label <> ''").groupBy("label").agg(F.count("*").alias("n"))


def daily(df: DataFrame, ts: Column, since: str, until: str) -> DataFrame:
    """(day, n) for each day of the closed range, 0 where nothing happened; a reversed range is empty."""
    spark = df.sparkSession
    days = spark.range(1).select(F.explode(F.when(F.lit(since) <= F.lit(until), F.sequence(F.to_date(F.lit(since)), F.greatest(F.to_date(F.lit(since)), F.to_date(F.lit(until))))).otherwise(F.expr("cast(array() as array<date>)"))).alias("day"))
    got = df.select(F.to_date(ts).alias("d")).where((F.col("d") >= F.lit(since).cast("date")) & (F.col("d") <= F.lit(until).cast("date"))).groupBy("d").agg(F.count("*").alias("n"))
    return days.join(got, F.col("day") == F.col("d"), "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def quality(df: DataFrame, source: str, ok: Column, fields: dict[str, Column]) -> DataFrame:
    """Per source: rows, good rows, and how many good rows have each field."""
    hits = [F.count_if(ok & c).alias(f"has_{k}") for k, c in fields.items()]
    return df.groupBy(source).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), *hits)


def histogram(df: DataFrame, value: Column, bounds: list[float], by: list[str]) -> DataFrame:
    """Cumulative counts per bound, and the count; negatives count as 0."""
    v = F.greatest(value, F.lit(0.0))
    return df.groupBy(*by).agg(*(F.count_if(v <= b).alias(f"le_{i}") for i, b in enumerate(bounds)), F.count(v).alias("n"))


def histogram_quantile(hist: DataFrame, bounds: list[float], q: float) -> Column:
    """The least bound whose cumulative count reaches max(1, q n); the counts are cumulative already."""
    need = F.greatest(F.lit(1.0), q * F.col("n"))
    out = F.when(F.col("le_0") >= need, bounds[0])
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(F.col(f"le_{i}") >= need, b)
    return out


def failure_ratio(failed: Column, done: Column) -> Column:
    """Ten-thousandths of failed / (done + failed), 1 at most."""
    return F.floor(F.least(F.lit(1.0), F.coalesce(F.try_divide(failed, done + failed), F.lit(0.0))) * 10000 + 0.5).cast("long")


def failure_streaks(df: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """(key, longest): the longest run of failures of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.row_number().over(w) - F.sum(F.when(failed, 1).otherwise(0)).over(w)
    runs = df.withColumn("_failed", failed).withColumn("_island", island).where("_failed").groupBy(key, "_island").agg(F.count("*").alias("_n"))
    return runs.groupBy(key).agg(F.max("_n").alias("longest"))


def cursor(runs: DataFrame, source: str, finished: str, good: Column) -> DataFrame:
    """The last successful end of each source."""
    return runs.groupBy(source).agg(F.max(F.when(good, F.col(finished))).alias("last_run_at"))


def counted_ends(df: DataFrame, key: str, c: str) -> DataFrame:
    """(key, n, first, last): how many rows a key has, and its least and greatest text; keys aren't null. A least text makes a task sort all its rows, a least integer doesn't: rows are narrowed first
    to those whose leading seven bytes, as an integer, are a key's least or greatest."""
    head = F.conv(F.rpad(F.substring(F.hex(F.substring(c, 1, 7)), 1, 14), 14, "0"), 16, 10).cast("long")
    rows = written(df.select(key, c, head.alias("_head")), "rows")
    ends = written(rows.groupBy(key).agg(F.count("*").alias("n"), F.min("_head").alias("_low"), F.max("_head").alias("_high")), "ends")
    near = rows.join(ends, key).where(F.col("_low").isNull() | (F.col("_head") == F.col("_low")) | (F.col("_head") == F.col("_high")))
    return near.groupBy(key).agg(F.first("n").alias("n"), F.min(c).alias("first"), F.max(c).alias("last"))

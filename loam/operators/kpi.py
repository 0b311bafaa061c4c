"""Dashboards: bundles of counts, rates, counters and gauges, usage and health."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """Ten-thousandths of part / whole; 0 of nothing."""
    return F.floor(F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)) * 10000 + 0.5).cast("long")


def bundle(df: DataFrame, ts: Column, critical: Column, source: Column) -> DataFrame:
    """One row: rows, critical ones, sources, and those of the last 24 hours of the data."""
    last = df.agg(F.max(ts).alias("_last"))
    rows = df.select(ts.alias("_ts"), critical.alias("_critical"), source.alias("_source")).crossJoin(F.broadcast(last))  # one row
    return rows.agg(F.count("*").alias("total"), F.count_if("_critical").alias("critical"), F.count_distinct("_source").alias("sources"), F.count_if(F.col("_ts") >= F.col("_last") - F.expr("interval 24 hours")).alias("new_24h"))


def completeness(per_source: DataFrame, fields: list[str]) -> DataFrame:
    """Rates of each source from its counts n_ok, n_failed and has_<field>."""
    return per_source.select("source", rate(F.col("n_ok"), F.col("n_ok") + F.col("n_failed")).alias("success"), *(rate(F.col(f"has_{f}"), F.col("n_ok")).alias(f) for f in fields))


def summary(per_source: DataFrame, fields: list[str], declared: list[str]) -> DataFrame:
    """One row over all sources: totals, completeness weighted by good rows, the share of declared sources that have any, and those that have none, as declared."""
    have = F.collect_set(F.when(F.col("n_ok") > 0, F.col("source")))
    names = F.array(*map(F.lit, declared))
    rows = per_source.agg(F.sum("n_ok").alias("n_ok"), F.sum("n_failed").alias("n_failed"), *(F.sum(f"has_{f}").alias(f"has_{f}") for f in fields), have.alias("_have"))
    missing = F.array_except(names, F.col("_have"))
    return rows.select("n_ok", "n_failed", *(rate(F.col(f"has_{f}"), F.col("n_ok")).alias(f) for f in fields), rate(F.size(names) - F.size(missing), F.lit(len(declared))).alias("coverage"), F.array_join(missing, ",").alias("missing"))


def counters(df: DataFrame, name: Column, labels: Column, value: Column) -> DataFrame:
    """(name, labels, total) by name and labels, and (name, null, total) across labels."""
    rows = df.select(name.alias("name"), labels.alias("labels"), value.alias("value"))
    return rows.groupingSets([["name", "labels"], ["name"]], "name", "labels").agg(F.sum("value").alias("total"), F.grouping("labels").cast("int").alias("all_labels"))


def gauges(df: DataFrame, name: Column, value: Column, order: Column) -> DataFrame:
    """The last value of each name."""
    return df.groupBy(name.alias("name")).agg(F.max_by(value, order).alias("value"))


def usage(df: DataFrame, model: Column, hit: Column, prompt: Column, completion: Column) -> DataFrame:
    """Calls, cache hits and tokens of each model."""
    return df.groupBy(model.alias("model")).agg(F.count("*").alias("calls"), F.count_if(hit).alias("hits"), F.sum(prompt).alias("prompt"), F.sum(completion).alias("completion"))


def health(df: DataFrame, system: str, hard: Column, up: Column) -> DataFrame:
    """error if a hard dependency is down, degraded if any isn't up, else ok."""
    return df.groupBy(system).agg(F.when(F.bool_or(hard & ~up), "error").when(F.bool_or(~up), "degraded").otherwise("ok").alias("status"))


def latency(df: DataFrame, by: str, value: Column) -> DataFrame:
    """Count, total, mean, quantiles, maximum and rows a second of each group; times in thousandths."""
    milli = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    v = value.cast("double")
    total = F.sum(v.cast("decimal(28,6)")).cast("double")
    return df.groupBy(by).agg(F.count(v).alias("n"), milli(total).alias("total"), milli(total / F.count(v)).alias("mean"), milli(F.percentile(v, 0.5)).alias("p50"), milli(F.percentile(v, 0.95)).alias("p95"), milli(F.max(v)).alias("most"), milli(F.try_divide(F.count(v), total)).alias("rate"))


def alerts(df: DataFrame, ratios: dict[str, Column], streak: Column, most: int = 2000, longest: int = 3) -> DataFrame:
    """(alert) names for each row: ratios (ten-thousandths) above a threshold, and long streaks."""
    found = [F.when(c > most, F.lit(k)) for k, c in ratios.items()] + [F.when(streak >= longest, F.lit("streak"))]
    return df.withColumn("alerts", F.array_join(F.filter(F.array(*found), lambda x: x.isNotNull()), ","))

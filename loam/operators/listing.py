"""Lists of records: filters, pages with totals, lookups and work queues."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_values(values: str | list[str] | None) -> list[str]:
    """Values of a filter: one or many, trimmed, without empty ones, once each in order."""
    rows = [] if values is None else [values] if isinstance(values, str) else values
    return list(dict.fromkeys(x.strip() for x in rows if x and x.strip()))


def contains_any(array: Column, values: list[str]) -> Column:
    """Whether an array holds one of the values, whatever the case."""
    return F.arrays_overlap(F.transform(array, lambda x: F.lower(x)), F.array(*(F.lit(v.lower()) for v in values)))


def keyword(q: str, *columns: Column) -> Column:
    """Whether a text is part of any column, literally, whatever the case."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.strip().lower())) for c in columns))


def high_risk(kev: Column, severity: Column) -> Column:
    return F.coalesce(kev, F.lit(False)) | F.coalesce(F.upper(severity).isin("CRITICAL", "HIGH"), F.lit(False))


def criteria(severity: list[str] | None = None, source: list[str] | None = None, since: Column | None = None, until: Column | None = None, kev: bool | None = None, q: str | None = None,
             columns: dict[str, Column] | None = None) -> Column:
    """All given criteria at once; what isn't given doesn't count. columns: severity, sources, timeline, kev and texts (an array) by name."""
    c = columns or {}
    parts = [F.lit(True)]
    if severity := filter_values(severity):
        parts.append(F.upper(c["severity"]).isin(*(s.upper() for s in severity)))
    if source := filter_values(source):
        parts.append(contains_any(c["sources"], source))
    if since is not None:
        parts.append(c["timeline"] >= since)
    if until is not None:
        parts.append(c["timeline"] <= until)
    if kev is not None:
        parts.append(F.coalesce(c["kev"], F.lit(False)) == kev)
    if q and q.strip():
        parts.append(F.exists(c["texts"], lambda t: F.contains(F.lower(t), F.lit(q.strip().lower()))))
    return reduce(lambda a, b: a & b, parts)


def having(df: DataFrame, key: str, others: DataFrame, has: bool | None) -> DataFrame:
    """Rows with (True), without (False) or whatever (None) a partner in others."""
    return df if has is None else df.join(others.select(key), key, "left_semi" if has else "left_anti")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order, and in each row how many rows there are in all."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def versioned(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """The row of an id; where there is none, that of the id without its vN."""
    bare = F.regexp_replace(F.lit(wanted.strip()), "v[0-9]+$", "")
    rows = df.where((F.col(column) == wanted.strip()) | (F.col(column) == bare))
    return rows.orderBy((F.col(column) != wanted.strip()).cast("int"), column).limit(1)


def work_queue(facts: DataFrame, done: DataFrame, key: str, order: list[Column], limit: int, where: Column | None = None) -> DataFrame:
    """The first facts without a finished row."""
    rows = facts if where is None else facts.where(where)
    return rows.join(done.select(key), key, "left_anti").orderBy(*order).limit(limit)


def retry_queue(df: DataFrame, status: Column, tries: Column, most: int = 3) -> DataFrame:
    """Rows that need a human, with what becomes of them: another try, or none after `most`."""
    return df.where(status == "needs_human").withColumn("next", F.when(tries < most, "retry").otherwise("permanently_failed"))


def looked_up(ids: DataFrame, facts: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Values by a list of ids; what isn't there gets a default."""
    rows = ids.select(key).join(facts.select(key, *defaults), key, "left")
    return rows.select(key, *(F.coalesce(F.col(c), v).alias(c) for c, v in defaults.items()))


def gold(facts: DataFrame, rows: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The last row of each key whose fact exists, and the rows that are refused."""
    from .resolve import pick

    known = facts.select(key).distinct()
    return pick(rows.join(known, key, "left_semi"), [key], order), rows.join(known, key, "left_anti")

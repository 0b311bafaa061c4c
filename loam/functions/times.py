"""Times: parsing, days and windows."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(c: Column) -> Column:
    """ISO forms with - or /, Z or an offset, and epoch seconds; null where nothing fits."""
    c = F.replace(F.trim(c), F.lit("/"), F.lit("-"))
    # most times are longer than that, and need no pattern (which a line end may follow)
    epoch = F.when((F.length(c) <= 13) & F.regexp_like(c, F.lit(r"^\d{9,11}$")), c).cast("long")
    return F.coalesce(F.timestamp_seconds(epoch), F.try_to_timestamp(c))


def timeline(published: Column, normalized: Column) -> Column:
    """The one clock to sort and filter by."""
    return F.coalesce(published, normalized)


def windows(since: Column, until: Column, days: int = 120) -> Column:
    """Array of half-open (start, end) ranges of at most `days`, the last one cut at until."""
    starts = F.filter(F.sequence(since, until, F.expr(f"interval {days} days")), lambda s: s < until)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + F.expr(f"interval {days} days"), until).alias("end")))

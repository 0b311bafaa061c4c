"""Queries that run as streams over the events, in micro-batches of some files each, to their end."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve, stats
from ..session import scratch
from ..sources.keyed import KeyedTable, merge_stream
from ..streaming import incremental, state
from .queries import ORACLE, query, t


def _events(spark, d, twice: bool = False):
    """The events by quarters of their ids, a micro-batch each, in order; with twice, all once more after that."""
    path, files = scratch(spark, "events"), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    rows = t(spark, d, "events")
    bounds = rows.select(F.percentile_approx("event_id", [0.25, 0.5, 0.75]).alias("q")).head().q
    for n in range(4 + 4 * twice):
        lo, hi = [None, *bounds][n % 4], [*bounds, None][n % 4]
        part = rows.where((F.lit(True) if lo is None else F.col("event_id") > lo) & (F.lit(True) if hi is None else F.col("event_id") <= hi))
        part.repartition(files).write.parquet(f"{path}/{n}")
    return incremental.read_files(spark, f"{path}/*", f"{d}/events.parquet", files)


@query("""select date_trunc('day', ts)::date as day, count(*) as n from events group by 1""")
def stream_daily_counts(spark, d):
    """Counts by event time; each update of a day replaces the one before."""
    out = incremental.to_the_end(incremental.daily_counts(_events(spark, d), "ts", "60 days"), "update")
    return out.groupBy("day").agg(F.max_by("n", "_batch").alias("n"))


@query("""select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n, count(*) filter (where event_type = 'error') as n_failed, cast(floor(least(1.0, count(*) filter (where event_type = 'error')::double / count(*)) * 10000 + 0.5) as bigint) as ratio from events group by 1""")
def stream_failure_windows(spark, d):
    out = incremental.to_the_end(incremental.failure_windows(_events(spark, d), "ts", "event_type = 'error'", late="60 days"), "update")
    last = out.groupBy("start").agg(F.max_by(F.struct("n", "n_failed"), "_batch").alias("x")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "x.*")
    return last.withColumn("ratio", stats.failure_ratio(F.col("n_failed"), F.col("n") - F.col("n_failed")))


@query("select event_id, user_id from events")
def stream_dedupe(spark, d):
    """Every event comes twice and stays once; append mode."""
    return incremental.to_the_end(incremental.dedupe(_events(spark, d, twice=True), "event_id", "ts", "60 days"), "append").select("event_id", "user_id")


@query(ORACLE["failure_streaks"])
def stream_failure_streaks(spark, d):
    """Every event comes twice and counts once, in the order of its time."""
    out = incremental.to_the_end(state.streaks(_events(spark, d, twice=True), "user_id", "ts", "event_id", F.col("event_type") == "error", "60 days"), "update")
    return out.groupBy("user_id").agg(F.max_by("longest", "_batch").alias("longest")).where("longest > 0")


@query("""with recursive r as (select user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
w as (select user_id, i, us + 3600000000 as until, 0::bigint as hits, 1::bigint as misses from r where i = 1
union all select r.user_id, r.i, case when us < until then until else us + 3600000000 end, hits + (us < until)::bigint, misses + (us >= until)::bigint from w join r on r.user_id = w.user_id and r.i = w.i + 1)
select user_id, max(hits) as hits, max(misses) as misses from w group by 1""")
def stream_expiring_answers(spark, d):
    """What a cache of an hour would have answered each user's events."""
    out = incremental.to_the_end(state.expiring(_events(spark, d), "user_id", "ts", "event_id", state.CATALOGUE_S, "60 days"), "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("hits", "misses"), "_batch").alias("x")).select("user_id", "x.*")


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, count(*) as n from events group by 1")
def stream_keyed_merge(spark, d):
    """A table of the last event of each user, merged batch by batch into the buckets that a batch touches."""
    def merge(old, batch):
        new = batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"))
        both = new if old is None else old.unionByName(new)
        return both.groupBy("user_id").agg(F.max("last").alias("last"), F.sum("n").alias("n"))

    target = scratch(spark, "merged")
    table = KeyedTable(spark, f"{target}/table", "user_id")
    merge_stream(_events(spark, d), table, f"{target}/checkpoint", merge).awaitTermination()
    return table.read().select("user_id", "last.event_id", "n")


@query("select event_type || ':' || user_id as sha, min(event_id) as first_id from events group by 1")
def stream_insert_if_absent(spark, d):
    """Bronze rows by content key, batch by batch: a key that is stored already stays as it is, and only new rows are written."""
    target = scratch(spark, "bronze")
    table = KeyedTable(spark, f"{target}/table", "sha")
    rows = _events(spark, d).select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("sha"), F.col("event_id").alias("first_id"))
    merge_stream(rows, table, f"{target}/checkpoint", order=[F.asc("first_id")]).awaitTermination()
    return table.read()


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where user_id in (3, 5, 8)) where n = 1")
def bucket_lookup(spark, d):
    """The rows of asked keys, read from their buckets of a keyed table alone."""
    table = KeyedTable(spark, f"{scratch(spark, 'keyed')}/table", "user_id")
    table.merge(t(spark, d, "events"), lambda old, batch: resolve.pick(batch, ["user_id"], [F.desc("ts"), F.desc("event_id")]))
    return table.lookup([3, 5, 8]).select("user_id", "event_id", "event_type")

"""Queries on lists, lookups, work queues and dashboards."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render
from ..operators import kpi, listing, resolve
from .queries import query, t


@query("""with r as (select * from orders where upper(o_orderpriority) in ('1-URGENT', '2-HIGH', '5-LOW') and o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1997-12-31' and (o_orderstatus = 'F') = true and contains(lower(o_orderpriority), 'h')
and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R'))
select o_orderkey, o_orderpriority, (select count(*) from r) as total from r order by o_orderdate desc, o_orderkey limit 25 offset 5""")
def list_page_with_total(spark, d):
    o = t(spark, d, "orders")
    columns = {"severity": F.col("o_orderpriority"), "sources": F.array("o_orderstatus"), "timeline": F.col("o_orderdate"), "kev": F.col("o_orderstatus") == "F", "texts": F.array("o_orderpriority")}
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = o.where(listing.criteria(severity=["1-urgent", " 2-high ", "5-LOW"], source=["F", "o", "P"], since=day("1995-01-01"), until=day("1997-12-31"), kev=True, q=" H", columns=columns))
    hit = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return listing.page(listing.having(rows, "o_orderkey", hit, True), [F.desc("o_orderdate"), F.asc("o_orderkey")], 25, 5).select("o_orderkey", "o_orderpriority", "total")


@query("select doc_id from documents where list_contains([lower(source), lower(lang)], 'src1') or list_contains([lower(source), lower(lang)], 'de')")
def array_contains_any(spark, d):
    return t(spark, d, "documents").where(listing.contains_any(F.array("source", "lang"), listing.filter_values(["SRC1", " de ", "", "SRC1"]))).select("doc_id")


@query("select c_custkey from customer where contains(lower(c_name), '0_1') or contains(lower(c_mktsegment), '0_1') or contains(lower(c_name), '01') or contains(lower(c_mktsegment), '01')")
def keyword_substring(spark, d):
    c = t(spark, d, "customer")
    return c.where(listing.keyword("0_1", F.col("c_name"), F.col("c_mktsegment")) | listing.keyword(" 01 ", F.col("c_name"), F.col("c_mktsegment"))).select("c_custkey")


@query("select c_custkey, c_acctbal from customer where upper(trim(c_name)) = 'CUSTOMER#000000007'")
def point_lookup(spark, d):
    return t(spark, d, "customer").where(F.upper(F.trim("c_name")) == F.upper(F.trim(F.lit(" customer#000000007 ")))).select("c_custkey", "c_acctbal")


@query("select '12v3' as asked, p_partkey as found from part where p_partkey = 12 union all select '13', p_partkey from part where p_partkey = 13")
def versioned_lookup(spark, d):
    ids = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_partkey")
    one = lambda x: listing.versioned(ids, "id", x).select(F.lit(x).alias("asked"), F.col("p_partkey").alias("found"))
    return one("12v3").union(one("13"))


@query("""select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') order by o_orderdate desc, o_orderkey limit 40""")
def work_queue(spark, d):
    done = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    severity = F.regexp_extract("o_orderpriority", "^[0-9]-(.*)$", 1)
    high = listing.high_risk(severity == "URGENT", severity)
    return listing.work_queue(t(spark, d, "orders"), done, "o_orderkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], 40, high).select("o_orderkey")


@query("select o_orderkey, case when n < 3 then 'retry' else 'permanently_failed' end as next from orders join (select l_orderkey, count(*) filter (where l_tax > 0.04) as n from lineitem group by 1) on l_orderkey = o_orderkey where o_orderstatus = 'P'")
def retry_queue(spark, d):
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_tax") > 0.04).alias("n"))
    rows = t(spark, d, "orders").join(n, "o_orderkey")
    return listing.retry_queue(rows, F.when(F.col("o_orderstatus") == "P", "needs_human").otherwise("auto_pass"), F.col("n")).select("o_orderkey", "next")


@query("select o_orderkey from orders where o_orderstatus = 'P' order by o_orderdate, o_orderkey limit 30")
def ids_by_status(spark, d):
    return t(spark, d, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(30).select("o_orderkey")


@query("select doc_id, quality from documents left join labels using (doc_id) order by quality desc nulls last, n_chars desc, doc_id limit 60")
def nulls_last_sort(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return rows.orderBy(F.desc_nulls_last("quality"), F.desc("n_chars"), "doc_id").limit(60).select("doc_id", "quality")


@query("select c_custkey, coalesce(n, 0) as n, coalesce(last, '-') as last from customer left join (select o_custkey, count(*) as n, max(o_orderpriority) as last from orders group by 1) on o_custkey = c_custkey where c_custkey % 2 = 0")
def batched_lookup(spark, d):
    ids = t(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey")
    facts = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("last"))
    return listing.looked_up(ids, facts, "c_custkey", {"n": F.lit(0), "last": F.lit("-")})


@query("""with g as (select *, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_quantity desc) as n from lineitem)
select l_orderkey, l_linenumber, 'kept' as state from g where n = 1 and l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F') union all select l_orderkey, l_linenumber, 'refused' from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'F')""")
def gold_sink(spark, d):
    facts = t(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    order = [F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    kept, refused = listing.gold(facts, t(spark, d, "lineitem"), "l_orderkey", order)
    return kept.select("l_orderkey", "l_linenumber", F.lit("kept").alias("state")).union(refused.select("l_orderkey", "l_linenumber", F.lit("refused")))


@query("select count(*) as total, count(*) filter (where event_type = 'error') as critical, count(distinct user_id) as sources, count(*) filter (where ts >= (select max(ts) from events) - interval 24 hour) as new_24h from events")
def kpi_bundle(spark, d):
    return kpi.bundle(t(spark, d, "events"), F.col("ts"), F.col("event_type") == "error", F.col("user_id"))


_PER_SOURCE = """p as (select source, count(*) filter (where n_chars >= 100) as n_ok, count(*) filter (where n_chars < 100) as n_failed, count(*) filter (where n_chars >= 100 and lang = 'en') as has_en, count(*) filter (where n_chars >= 100 and contains(text, '@')) as has_mail from documents group by 1)"""
_R = lambda a, b: f"cast(floor(coalesce({a}::double / nullif({b}, 0), 0) * 10000 + 0.5) as bigint)"


def _per_source(spark, d):
    ok = F.col("n_chars") >= 100
    return t(spark, d, "documents").groupBy("source").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.count_if(ok & (F.col("lang") == "en")).alias("has_en"), F.count_if(ok & F.contains("text", F.lit("@"))).alias("has_mail"))


@query(f"with {_PER_SOURCE} select source, {_R('n_ok', '(n_ok + n_failed)')} as success, {_R('has_en', 'n_ok')} as en, {_R('has_mail', 'n_ok')} as mail from p")
def quality_rates(spark, d):
    return kpi.completeness(_per_source(spark, d), ["en", "mail"])


_DECLARED = ["src0", "src1", "src2", "nowhere", "elsewhere"]


@query(f"""with {_PER_SOURCE}, m as (select coalesce(string_agg(x, ',' order by i), '') as missing, count(x) as n from (values ('src0', 0), ('src1', 1), ('src2', 2), ('nowhere', 3), ('elsewhere', 4)) v(x, i) where x not in (select source from p where n_ok > 0))
select cast(sum(n_ok) as bigint) as n_ok, cast(sum(n_failed) as bigint) as n_failed, {_R('sum(has_en)', 'sum(n_ok)')} as en, {_R('sum(has_mail)', 'sum(n_ok)')} as mail, (select {_R('(5 - n)', '5')} from m) as coverage, (select missing from m) as missing from p""")
def quality_summary(spark, d):
    return kpi.summary(_per_source(spark, d), ["en", "mail"], _DECLARED)


@query("select x as missing from (select unnest(['src0', 'src1', 'nowhere']) as x) where x not in (select source from documents)")
def coverage_difference(spark, d):
    declared = spark.createDataFrame([(x,) for x in ("src0", "src1", "nowhere")], "missing string")
    return declared.join(t(spark, d, "documents").select(F.col("source").alias("missing")), "missing", "left_anti")


@query("""select event_type as name, user_id as labels, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total, grouping(user_id)::int as all_labels from events group by grouping sets ((event_type, user_id), (event_type))""")
def metric_counters(spark, d):
    return kpi.counters(t(spark, d, "events"), F.col("event_type"), F.col("user_id"), F.get_json_object("props", "$.k").cast("long"))


@query("select event_type as name, arg_max(value, (ts, event_id)) as value from events group by 1")
def metric_gauges(spark, d):
    return kpi.gauges(t(spark, d, "events"), F.col("event_type"), F.col("value"), F.struct("ts", "event_id"))


@query("select event_type as model, count(*) as calls, count(*) filter (where value < 50) as hits, cast(sum(user_id) as bigint) as prompt, cast(sum(event_id % 7) as bigint) as completion from events group by 1")
def token_usage(spark, d):
    return kpi.usage(t(spark, d, "events"), F.col("event_type"), F.col("value") < 50, F.col("user_id"), F.col("event_id") % 7)


@query("""select user_id, case when bool_or(event_type = 'error' and value > 150) then 'error' when bool_or(value > 150) then 'degraded' else 'ok' end as status from events group by 1""")
def health_rollup(spark, d):
    return kpi.health(t(spark, d, "events"), "user_id", F.col("event_type") == "error", ~(F.col("value") > 150))


@query("""select event_type, count(value) as n, cast(floor(s * 1000 + 0.5) as bigint) as total, cast(floor(s / count(value) * 1000 + 0.5) as bigint) as mean, cast(floor(quantile_cont(value, 0.5) * 1000 + 0.5) as bigint) as p50, cast(floor(quantile_cont(value, 0.95) * 1000 + 0.5) as bigint) as p95, cast(floor(max(value) * 1000 + 0.5) as bigint) as most, cast(floor(count(value) / s * 1000 + 0.5) as bigint) as rate
from (select *, cast(sum(cast(value as decimal(28,6))) over (partition by event_type) as double) as s from events) group by event_type, s""")
def latency_summary(spark, d):
    return kpi.latency(t(spark, d, "events"), "event_type", F.col("value"))


@query("""with g as (select user_id, count(*) filter (where event_type = 'error') as f, count(*) as n, count(*) filter (where value > 100) as h from events group by 1)
select user_id, concat_ws(',', case when floor(f::double / n * 10000 + 0.5) > 2000 then 'collect' end, case when floor(h::double / n * 10000 + 0.5) > 2000 then 'enrich' end, case when f >= 3 then 'streak' end) as alerts from g""")
def threshold_alerts(spark, d):
    g = t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("f"), F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("h"))
    return kpi.alerts(g, {"collect": kpi.rate(F.col("f"), F.col("n")), "enrich": kpi.rate(F.col("h"), F.col("n"))}, F.col("f")).select("user_id", "alerts")


@query("""select event_type, 'events_total{kind="' || event_type || '",user="' || user_id || '"} ' || count(*) as line from events group by event_type, user_id""")
def prometheus_text(spark, d):
    g = t(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    return g.select("event_type", render.prometheus_line(F.lit("events_total"), labels, F.col("n")).alias("line"))


@query("""with n(label) as (values ('customer'), ('part'), ('asset')), g as (select 'customer' as label, count(distinct o_custkey) as n from orders union all select 'part', count(distinct l_partkey) from lineitem)
select n.label, coalesce(g.n, 0) as n from n left join g using (label)""")
def node_counts(spark, d):
    labels = spark.createDataFrame([(x,) for x in ("customer", "part", "asset")], "label string")
    o, l = t(spark, d, "orders").select(F.lit("customer").alias("label"), F.col("o_custkey").alias("k")), t(spark, d, "lineitem").select(F.lit("part").alias("label"), F.col("l_partkey").alias("k"))
    g = o.union(l).distinct().groupBy("label").agg(F.count("*").alias("n"))
    return labels.join(g, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


@query("""with old as (select o_orderkey // 2 % 50 as name, count(*) as n, max(o_orderpriority) as owner from orders where o_orderkey % 2 = 0 group by 1), new as (select o_orderkey // 2 % 60 + 10 as name, count(*) as n, max(o_orderstatus) as state from orders where o_orderkey % 2 = 1 group by 1)
select coalesce(old.name, new.name) as name, coalesce(new.n, old.n) as n, concat_ws(';', 'owner=' || old.owner, 'state=' || new.state) as meta, case when old.name is null then 'inserted' when new.name is null then 'kept' else 'updated' end as action from old full join new on old.name = new.name""")
def source_registry_sync(spark, d):
    o = t(spark, d, "orders").withColumn("half", F.expr("o_orderkey div 2"))
    old = o.where("o_orderkey % 2 = 0").groupBy((F.col("half") % 50).alias("name")).agg(F.count("*").alias("n"), F.create_map(F.lit("owner"), F.max("o_orderpriority")).alias("meta"))
    new = o.where("o_orderkey % 2 = 1").groupBy((F.col("half") % 60 + 10).alias("name")).agg(F.count("*").alias("n"), F.create_map(F.lit("state"), F.max("o_orderstatus")).alias("meta"))
    return resolve.sync_registry(old, new, "name").select("name", "n", render.flat_text(F.col("meta")).alias("meta"), "action")


@query("""select o_orderkey, concat_ws(';', 'date=' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), case when o_orderkey % 2 = 0 then 'flag=true' end, 'list=b,a', 'set=a,b') as metadata from orders""")
def metadata_flatten(spark, d):
    k = F.col("o_orderkey") % 2 == 0
    m = F.create_map(F.lit("list"), F.array_join(F.array(F.lit("b"), F.lit("a")), ","), F.lit("set"), F.array_join(F.array_sort(F.array(F.lit("b"), F.lit("a"))), ","), F.lit("date"), render.iso(F.col("o_orderdate")), F.lit("flag"), F.when(k, F.lit("true")))
    return t(spark, d, "orders").select("o_orderkey", render.flat_text(F.map_filter(m, lambda _, v: v.isNotNull())).alias("metadata"))


@query("select l_partkey, arg_max(l_suppkey, (l_orderkey, l_linenumber, l_suppkey, l_quantity)) as last_supplier, min(l_orderkey) as first_order from lineitem group by 1")
def vector_sink_last_at_first_place(spark, d):
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return t(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_suppkey", order).alias("last_supplier"), F.min("l_orderkey").alias("first_order"))


@query("""with b as (select sha256(text) as h, min(doc_id) as doc_id, max(n_chars) as trust, max(doc_id) as seen from documents group by 1) select h as content_hash, doc_id, trust, seen from b""")
def evidence_sink(spark, d):
    rows = t(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id", "n_chars")
    return resolve.keyed_refresh(rows, "content_hash", F.col("doc_id"), ["doc_id"], {"trust": F.max("n_chars"), "seen": F.max("doc_id")})

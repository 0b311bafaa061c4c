"""Queries through the functions of loam.api."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from .queries import ORACLE, graph_edges, graph_nodes, query, t

_F = """f as (select 'V-' || lpad(o_orderkey::varchar, 7, '0') as vuln_id, (['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', null])[o_orderkey % 5 + 1] as severity, o_orderstatus as source, case when o_orderkey % 7 > 0 then o_orderdate end as published, o_orderkey % 6 = 0 as kev, o_orderpriority as title, o_orderkey from orders)"""


def _facts(spark, d):
    k = F.col("o_orderkey")
    severity = F.get(F.array(*map(F.lit, ["CRITICAL", "HIGH", "MEDIUM", "LOW", None])), (k % 5).cast("int"))
    return t(spark, d, "orders").select(F.concat(F.lit("V-"), F.lpad(k.cast("string"), 7, "0")).alias("vuln_id"), severity.alias("severity"), F.array("o_orderstatus").alias("sources"), F.when(k % 7 > 0, F.col("o_orderdate").cast("timestamp")).alias("published_at"), F.lit("1999-01-01").cast("timestamp").alias("normalized_at"),
                                        (k % 6 == 0).alias("kev"), F.col("o_orderpriority").alias("title"), F.lit("d").alias("description"), k.alias("o_orderkey"))


@query(f"""with {_F}, r as (select * from f where severity in ('HIGH', 'CRITICAL') and source in ('F', 'P') and coalesce(published, timestamp '1999-01-01') >= timestamp '1996-01-01' and not kev and contains(lower(title), 'ur') and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R'))
select vuln_id, (select count(*) from r) as total from r order by coalesce(published, timestamp '1999-01-01') desc, vuln_id limit 30 offset 3""")
def api_vulnerabilities(spark, d):
    gold = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("V-"), F.lpad(F.col("l_orderkey").cast("string"), 7, "0")).alias("vuln_id"), F.array(F.lit("x")).alias("exploits"))
    return api.vulnerabilities(_facts(spark, d), gold, ["high", "critical"], ["f", "p"], days=3, since="1996-01-01", kev=False, has_poc=True, q="UR", limit=30, offset=3).select("vuln_id", "total")


@query(f"with {_F} select vuln_id, severity, o_orderpriority as level from f left join (select o_orderkey as k, o_orderpriority from orders where o_orderkey % 2 = 0) on k = o_orderkey where o_orderkey in (10, 11) and vuln_id = 'V-0000010'")
def api_vulnerability(spark, d):
    gold = t(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("V-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("vuln_id"), F.col("o_orderpriority").alias("level"))
    return api.vulnerability(_facts(spark, d), gold, " v-0000010 ").select("vuln_id", "severity", "level")


@query(f"""with {_F} select 'severity:' || coalesce(lower(severity), 'unknown') as name, count(*) as n from f group by 1 union all select 'source:' || lower(source), count(*) from f group by 1 union all select 'total', count(*) from f union all select 'critical', count(*) from f where severity = 'CRITICAL'
union all select 'trend', count(*) from f where coalesce(published, timestamp '1999-01-01') >= timestamp '1996-01-01' and coalesce(published, timestamp '1999-01-01') < timestamp '1997-01-01'""")
def api_stats(spark, d):
    out = api.dashboard(_facts(spark, d), "1996-01-01", "1996-12-31")
    named = lambda df, prefix: df.select(F.concat(F.lit(prefix), "label").alias("name"), "n")
    k = out["kpi"]
    return named(out["severity"], "severity:").union(named(out["sources"], "source:")).union(k.select(F.lit("total"), "total")).union(k.select(F.lit("critical"), "critical")).union(out["trend"].agg(F.sum("n").alias("n")).select(F.lit("trend"), "n"))


@query(f"""with e as ({ORACLE['graph_edges']}), x as (select relation, dst as key from e where src = '3' union select relation, src from e where dst = '3') select '3' as centre, relation, x.key, label from x left join ({ORACLE['graph_nodes']}) n on n.key = x.key order by label nulls first, key, relation limit 50""")
def api_graph(spark, d):
    return api.graph_of(graph_nodes(spark, d), graph_edges(spark, d), "3", 50)


@query("""with s as (select doc_id, cast(floor((contains(lower(text), 'tion')::int + contains(lower(text), 'the')::int) * 10000.0::double / 2 + 0.5) as bigint) as score from documents), k as (select *, row_number() over (order by score desc, doc_id) as n from s where score > 0 order by score desc, doc_id limit 5)
select 'the tion' as question, 'general' as intent, 'vector,fulltext,graph,multi_hop' as plan, string_agg('- ' || doc_id || ' ' || score, chr(10) order by n) as answer, array_to_string(list(doc_id order by n)[1:3], ',') as citations from k""")
def api_ask(spark, d):
    return api.ask(spark, "the tion", t(spark, d, "documents"), "doc_id", "text")

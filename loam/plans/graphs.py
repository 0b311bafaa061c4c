"""Queries on the property graph."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import packages, render, text
from ..operators import extract, graph
from ..session import spread
from .queries import ORACLE, graph_edges, graph_nodes, query, t

_EDGES = ORACLE["graph_edges"]


@query(f"""with e as ({_EDGES}), x as (select relation, dst as key from e where src = '17' union select relation, src from e where dst = '17'), n as ({ORACLE['graph_nodes']})
select '17' as centre, relation, x.key, label from x join n on n.key = x.key where label in ('customer', 'part') order by label, key, relation limit 200""")
def neighbourhood(spark, d):
    return graph.neighbourhood("17", graph_edges(spark, d), graph_nodes(spark, d), ["customer", "part"])


@query("""with p as (select distinct l_orderkey, l_suppkey from lineitem where l_returnflag = 'R') select o_custkey::varchar as src, coalesce(string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar), '') as names from orders left join p on l_orderkey = o_orderkey group by 1""")
def affected_assets(spark, d):
    first = t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("src"), F.col("o_orderkey").alias("dst"))
    second = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").cast("string").alias("dst")).distinct()
    return graph.reached(first, second).select("src", F.array_join("names", ",").alias("names"))


@query("select distinct l_orderkey from lineitem where l_partkey in (3, 5, 8)")
def technique_reverse_lookup(spark, d):
    return t(spark, d, "lineitem").where(F.col("l_partkey").isin(3, 5, 8)).select("l_orderkey").distinct()


@query("select distinct l_orderkey as src from lineitem join part on l_partkey = p_partkey where p_partkey::varchar = 'cold widget' or lower(p_name) = 'cold widget'")
def component_siblings(spark, d):
    nodes = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("name"))
    edges = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    return graph.by_key_or_name(nodes, edges, " Cold Widget ")


@query("""select p_partkey, (['brand#1', 'BRAND', 'acme', ' '])[p_partkey % 4 + 1] as vendor, case p_partkey % 4 when 2 then contains(lower(p_brand), 'acme') when 0 then contains(lower(p_brand), 'brand#1') or contains('brand#1', lower(p_brand)) else true end as fits from part""")
def vendor_fuzzy_match(spark, d):
    vendor = F.element_at(F.array(*map(F.lit, ["brand#1", "BRAND", "acme", " "])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", vendor.alias("vendor"), packages.vendor_consistent(vendor, F.array("p_brand")).alias("fits"))


_LINES = """l as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, p_name, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b, p_brand from lineitem join part on p_partkey = l_partkey),
f as (select l_orderkey, arg_min(p_name, (l_linenumber, l_partkey, l_suppkey, l_quantity)) as about from l group by 1)"""


@query(f"""with {_LINES}, c as (select distinct l_orderkey, l_partkey::varchar as key, a, b, about, case when l_returnflag = 'R' then 0.5 else 1.0 end as conf, p_brand = 'Brand#5' as hits from l join f using (l_orderkey)),
m as (select l_orderkey, key, max(conf) as conf, bool_or(a in (split_part(about, ' ', 1), split_part(about, ' ', 2)) or (b in (split_part(about, ' ', 1), split_part(about, ' ', 2)) and b <> 'widget')) as related, bool_or(hits) as hits from c group by 1, 2),
e as (select *, bool_or(related) over (partition by l_orderkey) as any_r, case when related then conf else conf * 0.5 end as eff from m),
r as (select *, row_number() over (partition by l_orderkey order by eff desc, hits desc, key) as rank from e where related or not any_r)
select l_orderkey, key, cast(eff * 100 as bigint) as effective, cast(rank as integer) as rank from r where rank <= 5""")
def component_selection(spark, d):
    l = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    about = l.groupBy("l_orderkey").agg(F.min_by("p_name", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("about"))
    rows = l.join(about, "l_orderkey").withColumn("hit", F.col("p_brand") == "Brand#5")
    generic = ["widget"]
    rows = rows.withColumn("related", graph.related(text.graph_tokens(F.col("p_name"), generic), text.graph_tokens(F.col("about"), generic)))
    rows = rows.groupBy("l_orderkey", F.col("l_partkey").cast("string").alias("key")).agg(F.max(F.when(F.col("l_returnflag") == "R", 0.5).otherwise(1.0)).alias("conf"), F.bool_or("related").alias("related"), F.bool_or("hit").alias("hit"))
    out = graph.select_components(rows, "l_orderkey", "key", F.col("conf"), F.col("related"), F.col("hit"))
    return out.select("l_orderkey", "key", F.rint(F.col("effective") * 100).cast("long").alias("effective"), "rank")


@query("""select l_orderkey, key, cast(rank as integer) as rank from (select l_orderkey, l_suppkey::varchar as key, row_number() over (partition by l_orderkey order by max(l_discount) desc, l_suppkey::varchar) as rank from lineitem group by l_orderkey, l_suppkey) where rank <= 2""")
def top_assets(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_suppkey").cast("string").alias("key")).agg(F.max("l_discount").alias("confidence"))
    return graph.top_per_group(rows, "l_orderkey", [F.desc("confidence"), F.asc("key")], 2).drop("confidence")


@query("select page_id, page_id % 3 = 0 or regexp_matches(lower(trim(url)), '/commit/|/patch|/pull/|/releases/|advisor') as patch from (select page_id, url || case when page_id % 5 = 1 then '/Commit/1' else '' end as url from pages)")
def patch_predicate(spark, d):
    u = F.concat("url", F.when(F.col("page_id") % 5 == 1, "/Commit/1").otherwise(""))
    return t(spark, d, "pages").select("page_id", graph.is_patch(u, F.when(F.col("page_id") % 3 == 0, F.array(F.lit(" PATCH "))).otherwise(F.array(F.lit("misc")))).alias("patch"))


@query("select o_orderkey, concat_ws(';', 'id=' || o_orderkey, case when o_orderstatus <> 'F' then 'status=' || o_orderstatus end) as props from orders")
def property_prune(spark, d):
    m = F.create_map(F.lit("status"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise(""), F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    return t(spark, d, "orders").select("o_orderkey", render.flat_text(graph.prune_properties(m)).alias("props"))


@query("select 'affects' as relation, 'v' || l_orderkey as src, 'vulnerability' as src_label, 'c' || l_partkey as dst, 'component' as dst_label from lineitem")
def edge_orientation(spark, d):
    v, c, even = F.concat(F.lit("v"), F.col("l_orderkey").cast("string")), F.concat(F.lit("c"), F.col("l_partkey").cast("string")), F.col("l_linenumber") % 2 == 0
    label = lambda first: F.when(even == first, "vulnerability").otherwise("component")
    rows = t(spark, d, "lineitem").select(F.lit("affects").alias("relation"), F.when(even, v).otherwise(c).alias("src"), label(True).alias("src_label"), F.when(even, c).otherwise(v).alias("dst"), label(False).alias("dst_label"))
    return graph.oriented(rows, {"affects": "vulnerability"})


@query("""with r as (select l_orderkey as src, 'holds' as relation, l_partkey as dst from lineitem) select distinct src, relation, dst, (select count(*) >= 50 from r) as truncated from r""")
def subgraph_mapping(spark, d):
    """What is around all orders, as the rows of one answer."""
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.lit("holds").alias("relation"), F.col("l_partkey").alias("dst"))
    return graph.mapped_subgraph(rows, 50)


@query("""with l as (select l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as n from lineitem)
select l_orderkey as src, 'affects' as relation, 'p' || l_partkey as dst from l where n <= 5 union select l_orderkey, 'affects', 's' || l_suppkey from l where n <= 5 union select l_orderkey, 'fixed_by', 'u' || l_partkey from l where n <= 5 and l_returnflag = 'R'""")
def facts_only_subgraph(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))), 1, 5).alias("x"))
    part = lambda c, sign: F.transform("x", lambda r: F.struct(F.lit("affects").alias("relation"), F.concat(F.lit(sign), r[c].cast("string")).alias("dst")))
    patches = F.transform(F.filter("x", lambda r: graph.is_patch(F.lit("x"), F.array(F.when(r["l_returnflag"] == "R", "patch").otherwise("misc")))), lambda r: F.struct(F.lit("fixed_by").alias("relation"), F.concat(F.lit("u"), r["l_partkey"].cast("string")).alias("dst")))
    # an order is one row here, so what repeats repeats within it
    return rows.select(F.col("l_orderkey").alias("src"), F.explode(F.array_distinct(F.concat(part("l_partkey", "p"), part("l_suppkey", "s"), patches))).alias("e")).select("src", "e.relation", "e.dst")


@query(f"""with n as ({ORACLE['graph_nodes']}), k as (select * from n order by label <> 'customer', label, key limit 120), e as ({_EDGES})
select relation, src, dst from e where src in (select key from k) and dst in (select key from k)""")
def graph_overview_edges(spark, d):
    return graph.overview(graph_nodes(spark, d), graph_edges(spark, d), "customer", 120)[1]


@query("""select l_partkey, l_orderkey, l_linenumber from (select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by coalesce(case when l_returnflag <> 'N' then l_discount end, 0) desc, l_orderkey, l_linenumber, l_suppkey, l_quantity) as n from lineitem) where n <= 4""")
def prune_excess_edges(spark, d):
    e = t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", F.when(F.col("l_returnflag") != "N", F.col("l_discount")).alias("conf"))
    return graph.prune_excess(e, "l_partkey", F.col("conf"), [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")], 4).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""with o as (select l_partkey::varchar as key, 'linenumber' as p, l_linenumber::varchar as v, (l_orderkey, l_linenumber, l_suppkey, l_quantity) as k from lineitem union all select l_partkey::varchar, 'flag', l_returnflag, (l_orderkey, l_linenumber, l_suppkey, l_quantity) from lineitem where l_returnflag <> 'N')
select key, string_agg(p || '=' || v, ';' order by p) as props from (select key, p, arg_max(v, k) as v from o group by 1, 2) group by 1""")
def graph_sink_later_props_win(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("key"), F.create_map(F.lit("linenumber"), F.col("l_linenumber").cast("string"), F.lit("flag"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("props"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("o"))
    return graph.merged_properties(rows, ["key"], "props", F.col("o")).select("key", render.flat_text(F.col("props")).alias("props"))


@query("""select l_orderkey, string_agg(l_partkey::varchar, ' ' order by l_linenumber, l_partkey, l_suppkey, l_quantity) as steps, string_agg(l_suppkey::varchar, ' ' order by l_discount desc, l_suppkey, l_linenumber, l_partkey, l_quantity) as papers from lineitem group by 1""")
def attack_chain_and_papers(spark, d):
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    papers = F.array_sort(F.collect_list(F.struct((-F.col("l_discount")).alias("d"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity"))))
    join = lambda xs, c: F.array_join(F.transform(xs, lambda x: x[c].cast("string")), " ")
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(join(steps, "l_partkey").alias("steps"), join(papers, "l_suppkey").alias("papers"))


@query("""select o_custkey, o_orderkey, arg_max(l_suppkey, (l_linenumber, l_partkey, l_suppkey, l_quantity)) as verified from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' group by 1, 2""")
def exploit_dedupe(spark, d):
    l = t(spark, d, "lineitem").where("l_returnflag = 'R'")
    return t(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.max_by("l_suppkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("verified"))


@query("""select row_number() over (order by label, key)::int as n, label, key from (select distinct l_returnflag as label, l_partkey as key from lineitem) qualify n <= 40""")
def nodes_in_order(spark, d):
    from pyspark.sql import Window

    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_partkey").alias("key")).distinct().orderBy("label", "key").limit(40)
    return rows.withColumn("n", F.row_number().over(Window.orderBy("label", "key")))  # 40 rows


#: Records that a task makes nodes and edges of: about 200 MB of sorted rows at most.
_RECORDS_A_TASK = 50_000


def _enriched(spark, d):
    """A record for each part, with all kinds of what enrichment adds."""
    n, lit = F.col("p_size").cast("string"), F.lit
    obj = lambda **c: F.struct(*((v if isinstance(v, F.Column) else lit(v)).alias(k) for k, v in c.items()))
    none = lit(None).cast("string")
    brand, name = F.replace(F.lower("p_brand"), lit("#"), lit("")), F.replace("p_name", lit(" "), lit("_"))
    empty = F.array().cast("array<string>")
    return spread(t(spark, d, "part"), "p_partkey", each=_RECORDS_A_TASK).select(
        F.concat(lit("CVE-"), F.col("p_partkey").cast("string")).alias("vuln_id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"),
        F.array(obj(vendor=brand, product=name, version_start_incl=none, version_start_excl=none, version_end_incl=none, version_end_excl=n)).alias("cpe_matches"),
        F.array(obj(name=F.col("p_type"), asset_type="product", vendor=F.col("p_brand"), version_range=none, ecosystem=none, confidence=0.9)).alias("affected_assets"),
        F.array(obj(paper_id=F.concat(lit("paper"), n), relation="method", confidence=0.5, evidence_refs=empty)).alias("related_papers"),
        F.array(obj(order=1, technique_id=F.concat(lit(" t"), (F.col("p_size") + 1000).cast("string")), tactic="t", stage="s", description="d", preconditions=empty)).alias("attack_steps"),
        F.array(obj(url=F.concat(F.when(F.col("p_partkey") % 2 == 0, "https://x/patches/").otherwise("https://x/news/"), F.col("p_partkey").cast("string")), source="nvd", tags=empty)).alias("references"))


_RECORDS = "p as (select 'CVE-' || p_partkey as v, *, replace(lower(p_brand), '#', '') as b, replace(p_name, ' ', '_') as m, replace(lower(p_brand), '#', '') || ':' || replace(p_name, ' ', '_') as k from part)"


@query(f"""with {_RECORDS} select 'Vulnerability' as label, v as key, 'cve_id=' || v || ';description=' || p_type || ';title=' || p_name as props from p
union all select 'Component', k, arg_min('confidence=1.0;effective_confidence=1.0;key=' || k || ';name=' || m || ';relevance=text;vendor=' || b || ';version_range=<' || p_size || ';vulnerable=true', v) from p group by k
union all select 'Asset', 'product:' || p_type, arg_min('asset_type=product;confidence=0.9;key=product:' || p_type || ';name=' || p_type || ';vendor=' || p_brand, v) from p group by p_type
union all select distinct 'Paper', 'paper' || p_size, 'paper_id=paper' || p_size || ';relation=method' from p union all select distinct 'AttackTechnique', 'T' || (p_size + 1000), 'description=d;order=1;stage=s;tactic=t;technique_id=T' || (p_size + 1000) from p
union all select 'Patch', 'https://x/patches/' || p_partkey, 'source=nvd;url=https://x/patches/' || p_partkey from p where p_partkey % 2 = 0""")
def graph_extract_nodes(spark, d):
    nodes, _ = extract.graph(_enriched(spark, d))
    return nodes.select("label", "key", render.flat_text(F.col("properties")).alias("props"))


@query(f"""with {_RECORDS} select 'AFFECTS' as relation, v as start_key, k as end_key, 'version_range=<' || p_size as props from p
union all select distinct 'INSTALLED_ON', k, 'product:' || p_type, 'confidence=0.9;derived_from=cve-cooccurrence' from p union all select 'RELATED_TO', v, 'paper' || p_size, 'confidence=0.5;relation=method' from p
union all select 'EXPLOITS', v, 'T' || (p_size + 1000), 'order=1;stage=s;tactic=t' from p union all select 'FIXED_BY', v, 'https://x/patches/' || p_partkey, 'source=nvd' from p where p_partkey % 2 = 0""")
def graph_extract_edges(spark, d):
    _, edges = extract.graph(_enriched(spark, d))
    return edges.select("relation", "start_key", "end_key", render.flat_text(F.col("properties")).alias("props"))

"""Queries on offline enrichment and on what joins facts with it."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embed, enrich, outputs, packages
from ..operators import graph, retrieve, stats
from .queries import _BOUNDS, query, t

_STOP = ["the", "and", "large", "small"]


@query("""with w as (select p_partkey, list_distinct(list_filter(['cwe-' || (p_partkey % 9 + 20), lower(replace(p_brand, '#', '-')), 'v2.1', lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2)), 'buffer_1', 'overflow'], lambda x: length(x) > 2 and x not in ('the', 'and', 'large', 'small'))) as w from part) select p_partkey, n, has from
(select p_partkey, least(len(w), 6) as n, list_contains(w, 'buffer_1') as has from w)""")
def paper_keyword_count(spark, d):
    p = t(spark, d, "part")
    words = enrich.paper_keywords(F.array(F.concat(F.lit("CWE-"), (F.col("p_partkey") % 9 + 20).cast("string"))), F.array(F.concat(F.lit("npm:"), F.replace("p_brand", F.lit("#"), F.lit("-")))), F.concat_ws(" ", "p_name", F.lit("v2.1")), F.lit("the flaw of buffer_1 overflow"), _STOP)
    return p.select("p_partkey", words.alias("w")).select("p_partkey", F.size("w").cast("long").alias("n"), F.array_contains("w", "buffer_1").alias("has"))


@query("""select p_partkey, concat_ws(' ', 'cwe-' || (p_partkey % 9 + 20), lower(replace(p_brand, '#', '-')), 'v2.1', 'buffer_1') as keywords from part""")
def paper_keywords(spark, d):
    words = enrich.paper_keywords(F.array(F.concat(F.lit("CWE-"), (F.col("p_partkey") % 9 + 20).cast("string"))), F.array(F.concat(F.lit("npm:"), F.replace("p_brand", F.lit("#"), F.lit("-")))), F.lit("the v2.1"), F.lit("flaws of buffer_1 and a"), [*_STOP, "flaws"])
    return t(spark, d, "part").select("p_partkey", F.array_join(words, " ").alias("keywords"))


@query("select o_orderkey, case when 300 + 50 * (o_orderkey % 8) >= 400 then least(600, 300 + 50 * (o_orderkey % 8)) end as confidence from orders")
def paper_links(spark, d):
    n = (F.col("o_orderkey") % 8).cast("int")
    matched = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))
    return t(spark, d, "orders").select("o_orderkey", enrich.paper_link(matched).alias("confidence"))


@query("""with l as (select l_orderkey, (['none', 'poc', 'functional', 'high'])[l_linenumber % 4 + 1] as m, l_linenumber % 4 as level, l_returnflag = 'R' as v, l_discount as r, (['github', 'other'])[l_suppkey % 2 + 1] as s, l_partkey || '/' || l_suppkey || '/' || l_quantity as u from lineitem)
select l_orderkey, arg_min(u, (-level, not v, -r, case s when 'github' then -0.8 else -0.5 end, u)) as best, cast(floor(least(1.0, count(*) / 2.0::double) * 100 + 0.5) as bigint) as strength from l group by 1""")
def exploit_rank(spark, d):
    at = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    e = F.struct(at(["github", "other"], "l_suppkey").alias("source"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string")).alias("url"), at(enrich.MATURITY, "l_linenumber").alias("maturity"), F.col("l_discount").alias("reliability"), (F.col("l_returnflag") == "R").alias("verified"))
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(e).alias("es"))
    return rows.select("l_orderkey", F.get(enrich.ranked_exploits(F.col("es"), {"github": 0.8}), F.lit(0))["url"].alias("best"), enrich.poc_strength(F.size("es")).alias("strength"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then '' else concat_ws(' ', 'CVE-' || o_orderkey, case when o_orderkey % 2 = 0 then 'https://p/' || o_orderkey end) end as evidence from orders""")
def external_evidence(spark, d):
    k = F.col("o_orderkey").cast("string")
    link = lambda tag, url: F.struct(url.alias("url"), F.array(F.lit(tag)).alias("tags"))
    refs = F.array(link("misc", F.lit("https://m/")), F.when(F.col("o_orderkey") % 2 == 0, link("Patch", F.concat(F.lit("https://p/"), k))).otherwise(link("misc", F.lit("x"))))
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("CVE-"), k).alias("id"), refs.alias("references")).alias("cve"))).alias("vulnerabilities")))
    wanted = F.concat(F.lit("cve-"), F.when(F.col("o_orderkey") % 3 == 0, "other").otherwise(k))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(enrich.nvd_evidence(payload, wanted), lambda x: x["locator"]), " ").alias("evidence"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then o_orderpriority end as remediation, case when o_orderkey % 3 = 2 then 'needs_human' else o_orderstatus end as review_status, case when o_orderkey % 3 = 2 then 0 else 7 end as confidence, o_orderkey % 3 = 2 as degraded from orders""")
def output_repair(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("remediation"), F.col("o_orderstatus").alias("review_status"), F.lit(7).alias("confidence"))
    return enrich.repaired(rows, F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 3 == 1)


@query("select p_partkey, case when p_size >= 30 then p_size when p_size + 10 >= 30 then p_size + 10 else p_size + 20 end as confidence from part")
def feedback_loop(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.col("p_size").alias("confidence"))
    return enrich.bounded_loop(rows, lambda df, _: df.withColumn("confidence", F.col("confidence") + 10), "confidence", 30)


@query("select distinct o_orderkey, l_partkey as technique from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F' and l_partkey in (1, 2, 3)")
def technique_inner_join(spark, d):
    chains = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("steps"))
    rows = t(spark, d, "orders").where("o_orderstatus = 'F'").join(chains, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", F.explode("steps").alias("technique")).where(F.col("technique").isin(1, 2, 3))


@query("""with c as (select distinct l_orderkey, l_partkey from lineitem), a as (select l_orderkey, l_suppkey, max(l_discount) as conf from lineitem group by 1, 2)
select l_orderkey, l_partkey, l_suppkey from (select c.l_orderkey, l_partkey, l_suppkey, row_number() over (partition by c.l_orderkey, l_partkey order by conf desc, l_suppkey) as n from c join a using (l_orderkey)) where n <= 2""")
def component_asset_edges(spark, d):
    """Components and assets of the same vulnerability; the assets are cut first, so no group multiplies."""
    l = t(spark, d, "lineitem")
    assets = graph.top_per_group(l.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_discount").alias("conf")), "l_orderkey", [F.desc("conf"), F.asc("l_suppkey")], 2).drop("rank", "conf")
    return l.select("l_orderkey", "l_partkey").distinct().join(assets, "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey")


@query("""select 'id' as kind, l_orderkey from lineitem where l_orderkey in (5, 6) union select 'component', l_orderkey from lineitem join part on p_partkey = l_partkey where contains(lower(p_name), 'cold') union select 'technique', l_orderkey from lineitem where l_suppkey in (1, 2)""")
def graph_route(spark, d):
    l = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ask = lambda kind, **e: retrieve.graph_route(l, "l_orderkey", F.col("p_name"), F.col("l_suppkey"), **e).select(F.lit(kind).alias("kind"), "l_orderkey")
    return ask("id", ids=[5, 6], components=["cold"]).union(ask("component", components=["Cold"], techniques=[1])).union(ask("technique", techniques=[1, 2]))


@query(f"select event_type, cast(round(sum(cast(greatest(value, 0) as decimal(18,4))) * 100) as bigint) as total, {', '.join(f'count(*) filter (where greatest(value, 0) <= {b}) as le_{i}' for i, b in enumerate(_BOUNDS))}, count(value) as n from events group by 1")
def histogram_with_sum(spark, d):
    e = t(spark, d, "events")
    h = stats.histogram(e, F.col("value"), _BOUNDS, ["event_type"])
    s = e.groupBy("event_type").agg(F.round(F.sum(F.greatest(F.col("value"), F.lit(0.0)).cast("decimal(18,4)")) * 100).cast("long").alias("total"))
    return h.join(s, "event_type")


def _pocs(key: int) -> list[dict]:
    if key % 5 == 4:
        raise OSError("no answer")
    return [{"url": f"https://x/{key}/{i}"} for i in range(key % 3)]


@query("select p_partkey, 'https://x/' || p_partkey || '/' || i as url from part, range(3) r(i) where p_partkey % 5 <> 4 and i < p_partkey % 3")
def injected_search(spark, d):
    """Rows from an injected function, which fails for every fifth key."""
    return enrich.fetched(t(spark, d, "part"), "p_partkey", _pocs, "url string")


@query("select p_partkey, 'OSError: no answer' as error from part where p_partkey % 5 = 4")
def injected_failures(spark, d):
    """The side output: keys that couldn't be fetched, and why."""
    rows = enrich.fetched(t(spark, d, "part"), "p_partkey", _pocs, "url string", "error")
    return rows.where("error is not null").select("p_partkey", "error")


@query("""select l_partkey, case when l_partkey % 2 = 0 then 'stored' else 'new' end as value, case when l_partkey % 2 = 0 then count(*) + 1 else 0 end as hits from lineitem group by 1""")
def answer_cache(spark, d):
    asked = t(spark, d, "lineitem").select("l_partkey")
    cache = asked.where("l_partkey % 2 = 0").distinct().select("l_partkey", F.lit("stored").alias("value"), F.lit(1).cast("long").alias("hits"))
    answers, after = enrich.cached(asked, cache, "l_partkey", lambda rows: rows.withColumn("value", F.lit("new")))
    return answers.join(after.select("l_partkey", "hits"), "l_partkey")


@query("select o_orderkey, o_orderstatus = 'F' or lower(o_orderpriority) in ('high', 'critical') or o_orderkey % 2 = 0 as smart from orders")
def model_gate(spark, d):
    from ..functions import attack

    level = F.when(F.col("o_orderkey") % 2 == 0, "High").otherwise(F.col("o_orderpriority"))
    return t(spark, d, "orders").select("o_orderkey", attack.needs_smart_model(F.col("o_orderstatus") == "F", level).alias("smart"))


@query("select p_partkey, 'Brand: ' || p_brand || chr(10) || 'Affected: ' || lower(replace(p_brand, '#', '')) || ':' || replace(p_name, ' ', '_') || ' ==' || p_size || chr(10) || 'Risk: ' || p_type as body from part")
def remediation_index_text(spark, d):
    from ..functions import render

    m = packages.parse_cpe(F.concat(F.lit("cpe:2.3:a:"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(":"), F.col("p_size").cast("string"), F.lit(":*:*:*:*:*:*:*")))
    body = render.labelled([("Brand", F.col("p_brand")), ("Fixed", F.lit(None).cast("string")), ("Affected", F.array_join(packages.affected_versions(F.array(m)), "; ")), ("Links", F.lit("")), ("Risk", F.col("p_type"))])
    return t(spark, d, "part").select("p_partkey", body.alias("body"))


@query(f"""select doc_id, {" || ' ' || ".join(f"cast(length(text) - length(replace(text, '{v}', '')) as varchar)" for v in "aeiou")} as counts, 0 as fell_back from documents""")
def semantic_embedding(spark, d):
    """Documents through a model that each worker makes once, in batches."""
    e = embed.embedder("semantic", 5, embed.vowels, 128)(F.col("text"))
    rows = t(spark, d, "documents").select("doc_id", e.alias("e"))
    return rows.select("doc_id", F.array_join(F.transform("e.embedding", lambda x: x.cast("long").cast("string")), " ").alias("counts"), "e.fell_back")


_CASES = """case o_orderkey % 9 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 2 when 7 then 3 when 8 then 1 end"""


@query(f"""with a as (select o_orderkey, o_orderkey % 9 as kind, {_CASES} as attempts from orders)
select o_orderkey, 'V-' || o_orderkey as vuln_id, case when attempts < 3 then 'revised' else 'needs_human' end as review_status, case when attempts < 3 then 5 else 0 end as tenths, case when kind = 0 then '{{"confidence":0.5,"summary":"s"}}' end as remediation, attempts, attempts - 1 as notes
from a where kind not in (5, 6)""")
def output_ladder(spark, d):
    """Outputs of nine kinds: whole, with a broken remediation, without a confidence, with an unknown field, with a broken snapshot, cut off, without an id, with an unknown status, without a remediation."""
    k = F.col("o_orderkey") % 9
    body = lambda rest: F.concat(F.lit('{"vuln_id": "V-'), F.col("o_orderkey").cast("string"), F.lit('", '), F.lit(rest))
    good = '"review_status": "revised", "confidence": 0.5'
    raw = (F.when(k == 0, body(good + ', "remediation": {"summary": "s", "confidence": 0.5}}')).when(k == 1, body(good + ', "remediation": {"summary": "", "confidence": 3}}')).when(k == 2, body('"review_status": "revised", "errors": []}'))
           .when(k == 3, body(good + ', "made_up": 1}')).when(k == 4, body(good + ', "remediation_json": "{broken"}')).when(k == 5, body(good)).when(k == 6, F.lit("{" + good + "}")).when(k == 7, body('"review_status": "sure", "confidence": "0.5"}')).otherwise(body('"review_status": "revised", "confidence": "0.5"}')))
    used, _ = outputs.repaired_outputs(t(spark, d, "orders").select("o_orderkey", raw.alias("raw")), "raw")
    return used.select("o_orderkey", "vuln_id", "review_status", F.rint(F.col("confidence") * 10).cast("int").alias("tenths"), "remediation", "attempts", F.size("notes").alias("notes"))


@query("""select o_orderkey, case when o_orderkey % 9 = 5 then 'not JSON' else 'vuln_id: missing' end as notes from orders where o_orderkey % 9 in (5, 6)""")
def output_refused(spark, d):
    """The side output: texts that are no JSON, or name no record."""
    k = F.col("o_orderkey") % 9
    raw = F.when(k == 5, '{"vuln_id": "V", "confidence": 0.5').when(k == 6, '{"confidence": 0.5}').otherwise('{"vuln_id": "V", "confidence": 0.5}')
    _, refused = outputs.repaired_outputs(t(spark, d, "orders").select("o_orderkey", raw.alias("raw")), "raw")
    return refused.select("o_orderkey", F.array_join("notes", "; ").alias("notes"))

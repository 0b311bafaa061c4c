"""Queries on feeds: scans, normalization and merges of payloads that are built from the fixture tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import packages, text
from ..operators import ranges, resolve, stats
from ..session import scratch, spread, written
from ..sources import feeds, paged, sink
from .queries import query, t


#: Payloads that a task makes and reads: some ten seconds of work.
_PAYLOADS_A_TASK = 100_000


def _payloads(spark, d):
    """A payload of one of five kinds for each order."""
    o = spread(t(spark, d, "orders"), "o_orderkey", each=_PAYLOADS_A_TASK).withColumns({"k": F.col("o_orderkey"), "day": F.date_format("o_orderdate", "yyyy-MM-dd")})
    cve, n = F.concat(F.lit("CVE-2024-"), (F.floor(F.col("k") / 5) + 10000).cast("string")), F.col("k").cast("string")
    said = F.concat(F.lit("Flaw <b>in</b>  "), F.col("o_orderpriority"))
    obj = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    lit = F.lit
    nvd = obj(cve=obj(id=F.lower(cve), published=F.concat("day", lit("T01:02:03.500")), lastModified=F.concat("day", lit("T05:00:00Z")), descriptions=F.array(obj(lang=lit("es"), value=lit("otra")), obj(lang=lit("en"), value=said)), weaknesses=F.array(obj(description=F.array(obj(value=lit("CWE-79")), obj(value=lit("NVD-CWE-noinfo"))))),
                      references=F.array(obj(url=F.concat(lit("https://a.org/patch/"), n)), obj(url=F.concat(lit("https://a.org/patch/"), n, lit("/?x=1"))))))
    osv = obj(id=F.concat(lit("PYSEC-2024-"), n), summary=lit("Short"), details=said, published=F.col("day"), modified=F.concat("day", lit("T09:00:00+00:00")), aliases=F.array(cve, lit("ghsa-2345-6789-cfgh")), references=F.array(obj(url=F.concat(lit("https://o.org/"), n))), affected=F.array(obj(package=obj(ecosystem=lit("PIP"), name=F.concat(lit("p"), n)))))
    ghsa = obj(ghsaId=F.concat(lit("GHSA-23ch-mpq4-r"), (F.col("k") % 8 + 2).cast("string"), lit("vw")), summary=said, publishedAt=F.concat("day", lit("T00:00:00Z")), identifiers=F.array(obj(type=lit("CVE"), value=cve)), cwes=obj(nodes=F.array(obj(cweId=lit("cwe-22")))), references=F.array(obj(url=F.concat(lit("https://g.org/"), n))))
    kev = obj(cveID=cve, vulnerabilityName=lit("Known one"), dateAdded=F.col("day"), shortDescription=said, notes=F.concat(lit("https://k.org/"), n), cwes=F.array(lit("CWE-78"), lit("CWE-78")))
    epss = obj(cve=cve, epss=F.concat(lit("0."), (F.col("k") % 10).cast("string")), percentile=lit("0.5"), date=F.col("day"))
    raw = F.when(F.col("k") % 5 == 0, F.to_json(nvd)).when(F.col("k") % 5 == 1, F.to_json(osv)).when(F.col("k") % 5 == 2, F.to_json(ghsa)).when(F.col("k") % 5 == 3, F.to_json(kev)).otherwise(F.to_json(epss))
    # a payload is made once, not again wherever it is read
    rows = feeds.staged(o, {"raw_text": raw})
    return rows.select("k", "raw_text", F.when(F.col("k") % 7 == 0, F.concat(lit("https://row.org/"), n)).alias("url"))


_P = """p as (select o_orderkey as k, o_orderkey % 5 as kind, 'CVE-2024-' || (o_orderkey // 5 + 10000) as cve, strftime(o_orderdate, '%Y-%m-%d') as day, 'Flaw in ' || o_orderpriority as said, case when o_orderkey % 7 = 0 then ' https://row.org/' || o_orderkey else '' end as own, 'GHSA-23CH-MPQ4-R' || (o_orderkey % 8 + 2) || 'VW' as g from orders),
s as (select k, kind, cve, (['nvd', 'osv', 'ghsa', 'kev', 'epss'])[kind + 1] as source, case kind when 1 then 'PYSEC-2024-' || k when 2 then 'GHSA-23ch-mpq4-r' || (k % 8 + 2) || 'vw' else cve end as vuln_id, case kind when 1 then 'Short' when 2 then said when 3 then 'Known one' end as title, case when kind < 4 then said end as description,
case kind when 0 then 'CWE-79' when 1 then cve || ',GHSA-2345-6789-CFGH' when 2 then cve || ',CWE-22' when 3 then 'CWE-78' else '' end as aliases, case kind when 0 then 'CWE-79' when 2 then 'CWE-22' when 3 then 'CWE-78' else '' end as cwe_ids,
trim(case kind when 0 then 'https://a.org/patch/' || k || ' https://a.org/patch/' || k || '/?x=1' when 1 then 'https://o.org/' || k when 2 then 'https://g.org/' || k when 3 then 'https://k.org/' || k else '' end || own) as links, kind = 3 as kev, case when kind = 4 then k % 10 end as epss10,
case kind when 0 then day || ' 01:02:03' when 4 then null else day || ' 00:00:00' end as published, case kind when 0 then day || ' 05:00:00' when 1 then day || ' 09:00:00' else day || ' 00:00:00' end as modified, case when kind = 1 then 'PyPI:p' || k else '' end as packages from p)"""


@query(f"with {_P} select k, source, vuln_id, title, description, case when kind < 4 then 'en' end as lang, aliases, cwe_ids, links, kev, epss10, published, modified, packages from s")
def record_normalizer(spark, d):
    join = lambda c, by=",": F.array_join(c, by)
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    n = feeds.parsed(_payloads(spark, d))
    return n.select("k", "source", "vuln_id", "title", "description", "lang", join("aliases").alias("aliases"), join("cwe_ids").alias("cwe_ids"), join("references", " ").alias("links"), "kev", F.rint(F.col("epss_score") * 10).cast("long").alias("epss10"), at("published_at").alias("published"), at("modified_at").alias("modified"), join("ecosystem_packages").alias("packages"))


@query(f"""with {_P}, g as (select cve as vuln_id, string_agg(source, ',' order by source) as sources, bool_or(kev) as kev, cast(max(epss10) as bigint) as epss10, min(published) as published, max(modified) as modified, arg_min(description, (-length(description), published is null, published, vuln_id)) filter (where description is not null) as description,
arg_min(title, (published is null, published, vuln_id)) filter (where title is not null) as title from s group by 1) select * from g""")
def cross_source_merge(spark, d):
    m = feeds.merge_sources(feeds.normalize(_payloads(spark, d)))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return m.select("vuln_id", F.array_join("sources", ",").alias("sources"), "kev", F.rint(F.col("epss_score") * 10).cast("long").alias("epss10"), at("published_at").alias("published"), at("modified_at").alias("modified"), "description", "title")


@query(f"""with {_P}, l as (select cve, unnest(string_split(links, ' ')) as u from s where links <> ''), k as (select distinct cve, lower(regexp_replace(regexp_replace(u, '[?#].*$', ''), '/+$', '')) as u from l)
select s.cve as vuln_id, coalesce(max(n), 0) as n_links, count(distinct nullif(cwe_ids, '')) as n_cwe, count(*) filter (where packages <> '') as n_packages from s left join (select cve, count(*) as n from k group by 1) using (cve) group by 1""")
def merged_lists(spark, d):
    m = feeds.merge_sources(feeds.normalize(_payloads(spark, d)))
    size = lambda c: F.size(c).cast("long")
    return m.select("vuln_id", size("references").alias("n_links"), size("cwe_ids").alias("n_cwe"), size("ecosystem_packages").alias("n_packages"))


@query("""select case when o_orderkey % 3 = 0 then 'CVE-2024-' || (10000 + o_orderkey) when o_orderkey % 3 = 1 then 'CVE-2023-' || (10000 + o_orderkey) else 'OTHER-' || o_orderkey end as key, o_orderkey from orders""")
def primary_keys(spark, d):
    k = F.col("o_orderkey")
    n = (k + 10000).cast("string")
    ident = F.when(k % 3 == 0, F.concat(F.lit(" cve-2024-"), n)).otherwise(F.concat(F.lit("other-"), k.cast("string")))
    aliases = F.when(k % 3 == 1, F.array(F.lit("GHSA-x"), F.concat(F.lit("cve-2023-"), n))).otherwise(F.array(F.lit("GHSA-x")))
    return t(spark, d, "orders").select(feeds.primary_key(ident, aliases).alias("key"), "o_orderkey")


@query("""select 'CVE-' || (o_orderkey % 300) as id, min(strftime(o_orderdate, '%Y-%m-%d')) as published from orders group by 1""")
def nvd_scan_pages(spark, d):
    item = F.struct(F.struct(F.concat(F.lit("CVE-"), (F.col("o_orderkey") % 300).cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published")).alias("cve"))
    pages = t(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(item).alias("vulnerabilities"))).alias("raw_text"))
    return feeds.nvd_scan(pages).select("id", "published")


@query("""select distinct o_orderkey % 200 as id from orders where o_orderdate >= timestamp '1997-01-01'""")
def osv_scan_since(spark, d):
    rows = t(spark, d, "orders").select((F.col("o_orderkey") % 200).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))
    return feeds.since_scan(rows, F.col("id"), [F.lit(None).cast("string"), F.col("modified")], F.lit("1997-01-01").cast("timestamp")).select("id")


@query("select o_orderkey from orders where o_orderkey % 4 = 0 or o_orderdate >= timestamp '1998-01-01'")
def epss_scan_since(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return feeds.since_scan(rows, F.col("o_orderkey"), [F.col("date")], F.lit("1998-01-01").cast("timestamp"), keep_undated=True).select("o_orderkey")


@query("select o_custkey, count(*) filter (where o_orderdate >= timestamp '1996-06-01' and o_orderkey % 4 > 0) as n from orders group by 1")
def kev_scan_since(spark, d):
    item = F.struct(F.col("o_orderkey").alias("cveID"), F.when(F.col("o_orderkey") % 4 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dateAdded"))
    pages = t(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(item).alias("vulnerabilities"))).alias("raw_text"))
    return pages.select("o_custkey", F.size(feeds.catalogue_scan(F.col("raw_text"), F.lit("1996-06-01").cast("timestamp"))).cast("long").alias("n"))


@query("select p_partkey from part where p_partkey % 3 = 0 and (contains(lower(p_name), 'cold') or contains(lower(p_type), 'econ'))")
def ghsa_filter(spark, d):
    payload = F.to_json(F.struct(F.col("p_name").alias("summary"), F.lit(None).cast("string").alias("description"), F.struct(F.array(F.struct(F.struct(F.when(F.col("p_partkey") % 3 == 0, "npm").otherwise("go").alias("ecosystem"), F.col("p_type").alias("name")).alias("package"))).alias("nodes")).alias("vulnerabilities")))
    return t(spark, d, "part").where(feeds.matches_filters(payload, ["NPM", "pip"], ["cold", "econ"])).select("p_partkey")


@query("select p_partkey, case lower(p_brand) when 'brand#1' then 'org/one' else 'org/two' end as repo from part where lower(p_brand) in ('brand#1', 'brand#2')")
def vendor_repo_assignment(spark, d):
    repos = spark.createDataFrame([("brand#1", "org/one"), ("BRAND#2", "org/two")], "package string, repo string")
    return feeds.assigned(t(spark, d, "part"), "p_brand", repos).select("p_partkey", "repo")


@query("select o_orderkey, '2404.' || (10000 + o_orderkey) as base, case when o_orderkey % 2 = 0 then 'v' || (1 + o_orderkey % 3) end as version from orders")
def arxiv_ids(spark, d):
    c = F.concat(F.when(F.col("o_orderkey") % 3 == 0, " http://arxiv.org/abs/").otherwise(""), F.lit("2404."), (F.col("o_orderkey") + 10000).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("v"), (F.col("o_orderkey") % 3 + 1).cast("string"))).otherwise(""))
    return t(spark, d, "orders").select("o_orderkey", feeds.arxiv_id(c).alias("x")).select("o_orderkey", "x.base", "x.version")


@query(r"select item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as abstract from benchmark")
def inverted_abstract(spark, d):
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    rows = t(spark, d, "benchmark").select("item_id", F.posexplode(words).alias("p", "w")).groupBy("item_id", "w").agg(F.collect_list("p").alias("ps"))
    index = rows.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("i"))
    return index.select("item_id", feeds.abstract(F.col("i")).alias("abstract"))


@query("select page_id, case when length('blog:' || url) <= 40 then 'blog:' || url else 'blog:' || substr(sha256(url), 1, 20) end as id from pages")
def stable_source_ids(spark, d):
    return t(spark, d, "pages").select("page_id", feeds.stable_id("blog", F.concat(F.lit(" "), F.col("url")), 40).alias("id"))


@query("""select event_id, '{"a":{"c":[1,2],"d":"é"},"b":' || json_extract_string(props, '$.k') || '}' as canonical from events""")
def canonical_json(spark, d):
    raw = F.concat(F.lit('{ "b" : '), F.get_json_object("props", "$.k"), F.lit(', "a": {"d": "é", "c": [1, 2]}}'))
    return t(spark, d, "events").select("event_id", feeds.canonical_json(raw).alias("canonical"))


@query("""select page_id, page_id || ':' || n as id, 'T ' || n as title, 'https://x.example/' || n as link, case when n = 1 then '2024-04-02 08:00:00' end as published, 'S & ' || n as summary from pages, (values (1), (2)) v(n)""")
def feed_parse(spark, d):
    k = F.col("page_id").cast("string")
    rss = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:dc="u"><channel><title>c</title><item><title>T\n 1</title><link>https://x.example/1</link><guid>'), k, F.lit(":1</guid><pubDate>Tue, 02 Apr 2024 10:00:00 +0200</pubDate><description>S &amp; 1</description></item><item><dc:x>y</dc:x><title>T 2</title><link>https://x.example/2</link><guid>"), k, F.lit(":2</guid><description>S &amp; 2</description></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>'), k, F.lit(':1</id><title>T 1</title><link href="https://x.example/1"/><published>2024-04-02T08:00:00Z</published><summary>S &amp; 1</summary></entry><entry><id>'), k, F.lit(':2</id><title>T 2</title><link href="https://x.example/2"/><summary>S &amp; 2</summary></entry></feed>'))
    rows = t(spark, d, "pages").select("page_id", F.explode(feeds.feed_entries(F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom))).alias("e"))
    return rows.select("page_id", "e.id", "e.title", "e.link", F.date_format("e.published", "yyyy-MM-dd HH:mm:ss").alias("published"), "e.summary")


@query("""select item_id, 'p' || item_id as paper_id, case when item_id % 2 = 0 then 'T' else 'D' end as title, strftime(date '2024-01-01' + cast(item_id as integer), '%Y-%m-%d') as day from benchmark""")
def paper_projection(spark, d):
    k = F.col("item_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")), "yyyy-MM-dd")
    arxiv = F.to_json(F.struct(F.concat(F.lit("http://arxiv.org/abs/p"), k.cast("string"), F.lit("v2")).alias("id"), F.lit("T").alias("title"), day.alias("published")))
    alex = F.to_json(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.lit("D").alias("display_name"), day.alias("publication_date")))
    bronze = t(spark, d, "benchmark").select(F.when(k % 2 == 0, arxiv).otherwise(alex).alias("raw_text"), F.when(k % 2 == 0, "arxiv").otherwise("openalex").alias("source"), k.cast("string").alias("source_id"))
    return feeds.papers(bronze).select(F.regexp_extract("paper_id", "([0-9]+)$", 1).cast("long").alias("item_id"), "paper_id", "title", F.date_format("published", "yyyy-MM-dd").alias("day"))


@query("select sha256(text) as sha256, 'docs' as source, substr(sha256('docs:' || sha256(text)), 1, 32) as trace_id, count(*) as n from documents group by text")
def bronze_rows(spark, d):
    rows = feeds.bronze_rows(t(spark, d, "documents").select(F.col("text").alias("raw_text")), "docs", F.lit("2024-01-01").cast("timestamp"))
    return rows.groupBy("sha256", "source", "trace_id").agg(F.count("*").alias("n"))


@query("select * from (values ('2024-05-05', 'explicit'), ('2024-01-01', 'full'), ('2024-12-28', 'days'), ('2024-11-11', 'last'), ('2024-12-24', 'default')) v(since, rule)")
def cursor_rules(spark, d):
    f = feeds.resolve_since
    rows = [(f("2024-05-05", True, 3, "2024-11-11"), "explicit"), (f(None, True, 3, "2024-11-11"), "full"), (f(None, False, 3, "2024-11-11"), "days"), (f(last_success="2024-11-11"), "last"), (f(), "default")]
    return spark.createDataFrame(rows, "since string, rule string")


@query("select o_orderpriority as source, count(*) as n, count(*) filter (where o_orderkey % 6 = 5) as failed from orders group by 1")
def batch_normalize_counts(spark, d):
    raw = F.when(F.col("o_orderkey") % 6 == 5, F.lit('{"nothing": 1}')).otherwise(F.concat(F.lit('{"cve": {"id": "CVE-2024-'), (F.col("o_orderkey") + 10000).cast("string"), F.lit('"}}')))
    rows = t(spark, d, "orders").select("o_orderpriority", raw.alias("raw_text"))
    return feeds.parsed(rows).groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("vuln_id").isNull()).alias("failed"))


@query("""select l_partkey, string_agg(a, ',' order by a) as products from (select distinct l_partkey, l_suppkey::varchar as a from lineitem qualify dense_rank() over (partition by l_partkey order by l_suppkey::varchar) <= 10) group by 1""")
def asset_inventory(spark, d):
    """Products by an inventory that is a table; unknown ones would get a placeholder."""
    inventory = t(spark, d, "lineitem").select(F.col("l_partkey").alias("product"), F.col("l_suppkey").cast("string").alias("asset")).distinct()
    asked = t(spark, d, "lineitem").select(F.col("l_partkey").alias("product")).distinct()
    return resolve.mapped_assets(asked, inventory, "product").groupBy(F.col("product").alias("l_partkey")).agg(F.array_join(F.array_sort(F.collect_set("asset")), ",").alias("products"))


@query("""with a as (select p_partkey, case when p_partkey % 2 = 0 then p_brand end as asset from part) select p_partkey, coalesce(asset, 'unknown:' || p_partkey) as asset, case when asset is null then 35 else 90 end as confidence from a""")
def asset_mapping(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("product"), "p_brand")
    out = resolve.mapped_assets(p.select("product"), p.where("product % 2 = 0").select("product", F.col("p_brand").alias("asset")), "product")
    return out.select(F.col("product").alias("p_partkey"), "asset", F.rint(F.col("confidence") * 100).cast("int").alias("confidence"))


@query("select cast(o_orderkey as varchar) as id, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def paged_scan(spark, d):
    """All orders from a feed that serves them in pages by windows of their time; a window that can't be read in full ends the query."""
    span = t(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.date_add(F.max("o_orderdate").cast("date"), 1).alias("b")).head()
    rows = paged.scan(spark, fetcher="loam.sources.paged:from_table", path=f"{d}/orders.parquet", key="o_orderkey", time="o_orderdate", since=str(span.a), until=str(span.b), size="1000", errors="raise")
    return paged.entries(rows).select("id", F.substring("at", 1, 10).alias("day"))


@query("select cast(o_orderkey as varchar) as id, strftime(o_orderdate, '%Y-%m-%d') as day from orders where o_orderkey in (7, 70, 700)")
def paged_point_lookup(spark, d):
    """Asked ids go to the feed."""
    rows = paged.scan(spark, fetcher="loam.sources.paged:from_table", path=f"{d}/orders.parquet", key="o_orderkey", time="o_orderdate", since="1990-01-01", until="2000-01-01")
    return paged.entries(rows.where(F.col("id").isin("7", "70", "700"))).select("id", F.substring("at", 1, 10).alias("day"))


@query("select sha256(text) as sha256, min(doc_id) as doc_id from documents where text is not null group by 1")
def content_sink_once(spark, d):
    """Documents by content hash in a sink: those with an even id, then all; what is stored stays."""
    path = scratch(spark, "sink")
    rows = t(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    first = rows.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    sink.insert(first.where("doc_id % 2 = 0"), path)
    sink.insert(first, path)
    return sink.stored(spark, path, "sha256 string, doc_id long")


@query("""with v as (select distinct p_brand, l_linenumber || '.' || cast(l_quantity as int) || case when l_linenumber % 3 = 0 then '.1' else '' end as version from lineitem join part on p_partkey = l_partkey),
k as (select *, list_transform(string_split(version, '.'), lambda x: x::bigint) as vk from v),
r as (select p_partkey as id, p_brand, case when p_partkey % 4 > 0 then [p_size::bigint] end as low, case p_partkey % 3 when 0 then [p_size + 1::bigint, 20] when 1 then [p_size + 1::bigint, 5, 1] end as high, p_partkey % 3 = 0 as high_in from part
union all select p_partkey, p_brand, [6::bigint, p_size], null, true from part)
select id, version, count(*) as n from k join r using (p_brand) where coalesce(vk >= low, true) and coalesce(vk < high or (high_in and vk = high), true) group by all""")
def version_membership(spark, d):
    """Versions that a package has been seen in, in the affected ranges of advisories on it."""
    seen = F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, ".1").otherwise(""))
    p = t(spark, d, "part")
    versions = t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", seen.alias("version")).distinct()
    n = lambda k, end: F.concat((F.col("p_size") + k).cast("string"), F.lit(end))
    event = lambda **e: F.struct(*(e.get(k, F.lit(None).cast("string")).alias(k) for k in ("introduced", "fixed", "last_affected")))
    third = F.col("p_partkey") % 3
    first = F.array(event(introduced=F.when(F.col("p_partkey") % 4 > 0, n(0, "")).otherwise("0")), event(fixed=F.when(third == 1, n(1, ".5.1")), last_affected=F.when(third == 0, n(1, ".20"))))
    second = F.array(event(introduced=F.concat(F.lit("6."), F.col("p_size").cast("string"))))
    ranges_ = F.array(F.struct(first.alias("events")), F.struct(second.alias("events")))
    payload = F.to_json(F.struct(F.array(F.struct(ranges_.alias("ranges"))).alias("affected")))
    key = lambda c, to: F.when(c.isNotNull(), packages.version_key(c)).alias(to)
    own = F.transform(packages.osv_intervals(payload), lambda r: F.struct(F.col("p_brand"), key(r["low"], "low"), key(r["high"], "high"), r["high_in"].alias("high_in")))
    affected = spread(p, "p_partkey", each=_PAYLOADS_A_TASK).select(F.col("p_partkey").alias("id"), own.alias("r")).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("ranges"))
    return _in_ranges(versions.withColumn("at", packages.version_key(F.col("version"))), written(affected, "affected"))


def _in_ranges(versions, affected):
    """(id, version, n): in how many of an advisory's ranges a version lies. Advisories with the same ranges are looked up once, and what is found joins back to them, so no pair of a range and a version is shuffled for each advisory."""
    sets = affected.select("ranges").distinct().select("ranges", F.inline("ranges")).withColumn("low_in", F.lit(True))
    found = ranges.within(versions, sets, "p_brand", "at", "low", "high", "low_in", "high_in").groupBy("ranges", "version").agg(F.count("*").alias("n"))
    return affected.join(found, "ranges").select("id", "version", "n")


@query("""with v as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as vendor from benchmark), c as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as component from documents)
select vendor, count(*) as n, min(component) as first, max(component) as last from v join c on contains(component, vendor) or contains(vendor, component) group by 1""")
def fuzzy_vendor_join(spark, d):
    """Every name of one table beside all names of another that it fits: equal, or one part of the other."""
    own = lambda table, to: t(spark, d, table).select(F.explode(text.tokens(F.col("text"))).alias(to))
    pairs, _ = ranges.fuzzy_join(own("benchmark", "vendor"), own("documents", "component"), "vendor", "component")
    return stats.counted_ends(pairs, "vendor", "component")


@query()
def similar_merge(spark, d):
    """Documents as records that no CVE id names: those with near-duplicate texts merge into the first of them, whose aliases are the others."""
    payload = F.to_json(F.struct(F.concat(F.lit("PYSEC-2024-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"), F.col("text").alias("details"), F.array().cast("array<string>").alias("aliases")))
    silver = feeds.normalize(feeds.staged(t(spark, d, "documents").where("text is not null"), {"raw_text": payload}).select("raw_text"))
    return feeds.merge_sources(silver, similar=True).select("vuln_id", F.size("aliases").alias("n_aliases"))


@query("""with c as (select l_orderkey, l_linenumber, p_name || ' ' || l_suppkey as asset, case l_linenumber % 3 when 0 then p_brand when 1 then 'Brand #1' end as vendor, cast(l_quantity as int) % 5 as confidence, case when l_partkey % 2 = 0 then 'Ring' else 'widget' end as product, case when l_suppkey % 4 > 0 then 'brand#1' || (l_suppkey % 3) end as product_vendor from lineitem join part on p_partkey = l_partkey),
n as (select *, lower(asset) as a, lower(product) as p, replace(lower(coalesce(vendor, '')), ' ', '') as v, replace(lower(coalesce(product_vendor, '')), ' ', '') as w from c),
k as (select * from n where v = '' or w = '' or contains(v, w) or contains(w, v) or contains(a, p) or contains(p, a))
select l_orderkey, asset, vendor, confidence, rank from (select *, cast(row_number() over (partition by l_orderkey order by confidence desc, contains(a, p) desc, a, vendor nulls last, asset) as integer) as rank from k) where rank <= 3""")
def asset_admission(spark, d):
    """Assets of an inventory that are let in for a record's product, the most relevant first."""
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = rows.select("l_orderkey", F.concat_ws(" ", "p_name", F.col("l_suppkey").cast("string")).alias("asset"), F.when(F.col("l_linenumber") % 3 == 0, F.col("p_brand")).when(F.col("l_linenumber") % 3 == 1, "Brand #1").alias("vendor"), (F.col("l_quantity").cast("int") % 5).alias("confidence"),
                    F.when(F.col("l_partkey") % 2 == 0, "Ring").otherwise("widget").alias("product"), F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("brand#1"), (F.col("l_suppkey") % 3).cast("string"))).alias("product_vendor"))
    return resolve.selected_assets(c, "l_orderkey", "asset", "vendor", "confidence", "product", "product_vendor", 3).select("l_orderkey", "asset", "vendor", "confidence", "rank")

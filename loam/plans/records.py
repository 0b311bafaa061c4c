"""Queries on record normalization: packages, vectors, chains, texts for indexes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attack, cvss, packages, render, text, times, urls
from .queries import ORACLE, _vectors, query, t

_CPE = """c as (select p_partkey as id, lower(replace(p_brand, '#', '')) as vendor, replace(p_name, ' ', '_') as product, p_size || '.' || (p_partkey % 7) as v, p_partkey % 5 as k from part)"""


def _cpes(spark, d):
    p = t(spark, d, "part")
    k = F.col("p_partkey") % 5
    vendor, product = F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.replace("p_name", F.lit(" "), F.lit("_"))
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"))
    criteria = F.concat(F.lit(" cpe:2.3:a:"), F.when(k == 2, "*").otherwise(vendor), F.lit(":"), product, F.lit(":"), F.when(k == 0, "*").when(k == 1, "-").otherwise(v), F.lit(":*:*:*:*:*:*:* "))
    return p.select(F.col("p_partkey").alias("id"), packages.parse_cpe(criteria, F.when(k == 0, v)).alias("m"))


@query(f"with {_CPE} select id, case when k <> 2 then vendor end as vendor, case when k <> 2 then product end as product, case k when 2 then null when 0 then '<' || v when 1 then '*' else '==' || v end as versions from c")
def cpe_parse(spark, d):
    return _cpes(spark, d).select("id", "m.vendor", "m.product", F.when(F.col("m").isNotNull(), packages.version_range(F.col("m"))).alias("versions"))


def _configurations(spark, d):
    """A payload for each order: one node for each line, the last line's first when read."""
    l = t(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    criteria = F.concat(F.lit("cpe:2.3:a:v"), (F.col("l_partkey") % 3).cast("string"), F.lit(":p"), (F.col("l_suppkey") % 2).cast("string"), F.when(q % 3 == 0, ":*").otherwise(F.concat(F.lit(":"), (q % 4).cast("string"))), F.lit(":*:*:*:*:*:*:*"))
    node = F.struct(F.array(F.struct((F.col("l_returnflag") != "R").alias("vulnerable"), criteria.alias("criteria"), F.when(q % 6 == 0, F.concat((q % 5).cast("string"), F.lit(".9"))).alias("versionEndExcluding"))).alias("cpeMatch"))
    rows = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", node.alias("node")))).alias("ns"))
    return rows.select("l_orderkey", F.to_json(F.struct(F.array(F.struct(F.transform("ns", lambda x: x["node"]).alias("nodes"))).alias("configurations"))).alias("payload"))


@query("""with l as (select l_orderkey, l_linenumber as n, l_partkey, l_suppkey, l_quantity, 'v' || (l_partkey % 3) as vendor, 'p' || (l_suppkey % 2) as product, cast(l_quantity as int) as q from lineitem where l_returnflag <> 'R'),
m as (select *, case when q % 3 <> 0 then (q % 4)::varchar end as exact, case when q % 3 = 0 and q % 6 = 0 then (q % 5) || '.9' end as fin from l),
r as (select l_orderkey, n, l_partkey, l_suppkey, l_quantity, vendor || ':' || product || ' ' || case when exact is not null then '==' || exact when fin is not null then '<' || fin else '*' end as said,
row_number() over (partition by l_orderkey, vendor, product, coalesce(fin, '') order by n desc, l_partkey desc, l_suppkey desc, l_quantity desc) as nth from m),
o as (select l_orderkey, said, row_number() over (partition by l_orderkey, said order by n desc, l_partkey desc, l_suppkey desc, l_quantity desc) as again, n, l_partkey, l_suppkey, l_quantity from r where nth = 1)
select k.l_orderkey, coalesce(v, '') as versions from (select distinct l_orderkey from lineitem) k left join (select l_orderkey, string_agg(said, '; ' order by n desc, l_partkey desc, l_suppkey desc, l_quantity desc) as v from o where again = 1 group by 1) g on g.l_orderkey = k.l_orderkey""")
def affected_versions_of_payloads(spark, d):
    return _configurations(spark, d).select("l_orderkey", F.array_join(packages.affected_versions(packages.cpe_matches(F.col("payload"))), "; ").alias("versions"))


@query("""with p as (select p_partkey as id, (['PIP', 'npm', 'go', ' Maven ', 'zig'])[p_partkey % 5 + 1] as e, (['PyPI', 'npm', 'Go', 'Maven', 'zig'])[p_partkey % 5 + 1] as c, replace(p_name, ' ', '-') as n from part)
select id, array_to_string(list_distinct_in_order, ',') as packages from (select id, case when id % 2 = 0 then [c || ':' || n] else [c || ':' || n, 'crates.io:' || n] end as list_distinct_in_order from p)""")
def ecosystem_packages(spark, d):
    p = t(spark, d, "part")
    eco = F.element_at(F.array(*map(F.lit, ["PIP", "npm", "go", " Maven ", "zig"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    pack = lambda e: F.struct(F.struct(e.alias("ecosystem"), name.alias("name")).alias("package"))
    payload = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.array(pack(eco), pack(eco)).alias("affected")))).otherwise(F.to_json(F.struct(F.array(pack(eco)).alias("affected"), F.struct(F.array(pack(F.lit("rust")), pack(eco)).alias("nodes")).alias("vulnerabilities"))))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(packages.packages(payload), ",").alias("packages"))


@query("""with v as (select l_orderkey, l_linenumber, l_linenumber || '.' || cast(l_quantity as int) || case when l_linenumber % 3 = 0 then '.1' else '' end as a, case when l_suppkey % 7 = 0 then 'x1' else (l_suppkey % 8) || '.' || (l_partkey % 50) end as b from lineitem),
k as (select *, list_transform(string_split(a, '.'), lambda x: try_cast(x as bigint)) as ka, list_transform(string_split(b, '.'), lambda x: try_cast(x as bigint)) as kb from v)
select l_orderkey, l_linenumber, case when (case when list_contains(list_transform(kb, lambda x: x is null), true) then [0::bigint] else kb end) < ka then 1 else 0 end as newer from k""")
def version_compare(spark, d):
    a = F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, ".1").otherwise(""))
    b = F.when(F.col("l_suppkey") % 7 == 0, "x1").otherwise(F.concat((F.col("l_suppkey") % 8).cast("string"), F.lit("."), (F.col("l_partkey") % 50).cast("string")))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(packages.version_key(b) < packages.version_key(a), 1).otherwise(0).alias("newer"))


@query("""select p_partkey as id, '>=' || p_size || ',' || case when p_partkey % 3 = 0 then '<=' || (p_size + 1) || '.0' else '<' || (p_size + 2) || '.0-rc1' end as bounds from part""")
def osv_version_bounds(spark, d):
    n = lambda k, end: F.concat((F.col("p_size") + k).cast("string"), F.lit(end))
    third = F.col("p_partkey") % 3 == 0
    event = lambda **e: F.struct(*(e.get(k, F.lit(None).cast("string")).alias(k) for k in ("introduced", "fixed", "last_affected")))
    events = F.array(event(introduced=n(0, "")), event(fixed=F.when(~third, n(2, ".0-rc1")), last_affected=F.when(third, n(1, ".0"))), event(fixed=F.lit("not yet")))
    payload = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(events.alias("events"))).alias("ranges"))).alias("affected")))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(packages.osv_bounds(payload), ",").alias("bounds"))


_SEV10 = "(case when s >= 90 then 'CRITICAL' when s >= 70 then 'HIGH' when s >= 40 then 'MEDIUM' when s > 0 then 'LOW' else 'NONE' end)"
_SEV10_2 = "(case when s >= 70 then 'HIGH' when s >= 40 then 'MEDIUM' else 'LOW' end)"


@query(f"""with v3 as ({ORACLE['cvss_v3_score']}), v2 as ({ORACLE['cvss_v2_score']}),
a as (select id, '3.1' as version, case when id % 4 = 0 then 55 else score10 end as s from v3), b as (select id, '2.0' as version, score10 as s from v2)
select id, version, cast(s as bigint) as score10, {_SEV10} as severity from a union all select id, version, cast(s as bigint), {_SEV10_2} from b""")
def cvss_parse(spark, d):
    v = _vectors(spark, d)
    three = v.select("id", cvss.parse(F.concat(F.lit(" "), F.lower("v3")), F.when(F.col("id") % 4 == 0, 5.5)).alias("p"))
    two = v.select("id", cvss.parse(F.col("v2")).alias("p"))
    return three.union(two).select("id", "p.version", F.rint(F.col("p.base_score") * 10).cast("long").alias("score10"), "p.severity")


@query(f"""with v3 as ({ORACLE['cvss_v3_score']}), v2 as ({ORACLE['cvss_v2_score']}), x as (select id, v3.score10 as a, v2.score10 as b from v3 join v2 using (id))
select id, case when id % 2 = 0 then '2.0,3.1' else '3.1' end as versions, case when id % 2 = 0 and b > a then case when b >= 70 then 'HIGH' when b >= 40 then 'MEDIUM' else 'LOW' end else {_SEV10.replace('s ', 'a ')} end as severity from x""")
def cvss_collection(spark, d):
    data = lambda v: F.array(F.struct(F.struct(v.alias("vectorString")).alias("cvssData")), F.struct(F.struct(F.lit("CVSS:3.1/AV:X").alias("vectorString")).alias("cvssData")))
    even = F.to_json(F.struct(F.struct(F.struct(data(F.col("v2")).alias("cvssMetricV2"), data(F.col("v3")).alias("cvssMetricV31")).alias("metrics")).alias("cve")))
    odd = F.to_json(F.struct(F.struct(F.col("v3").alias("vectorString"), F.lit(0.0).alias("score")).alias("cvss"), F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.col("v3").alias("score"))).alias("severity")))
    found = cvss.collect(F.when(F.col("id") % 2 == 0, even).otherwise(odd))
    return _vectors(spark, d).select("id", found.alias("v")).select("id", F.array_join(F.transform("v", lambda x: x["version"]), ",").alias("versions"), cvss.set_severity(F.col("v")).alias("severity"))


@query(f"""with v3 as ({ORACLE['cvss_v3_score']}), x as (select id, score10 as s, score10 + id % 4 as given, (['low', 'MEDIUM', 'HIGH', 'CRITICAL'])[id % 4 + 1] as declared from v3)
select id, given - s > 1 as inconsistent, upper(declared) <> {_SEV10.replace('s ', 'given ')} as differs, false as needs from x""")
def cvss_consistency(spark, d):
    v = _vectors(spark, d).select("id", "v3", cvss.score_v3(F.col("v3")).alias("score"))
    given = F.rint(F.col("score") * 10 + F.col("id") % 4) / 10.0
    vectors = F.array(F.struct(F.lit("3.1").alias("version"), F.col("v3").alias("vector"), given.alias("base_score"), cvss.severity(F.lit("3.1"), given).alias("severity")))
    declared = F.element_at(F.array(*map(F.lit, ["low", "MEDIUM", "HIGH", "CRITICAL"])), (F.col("id") % 4 + 1).cast("int"))
    return v.select("id", vectors.alias("v"), declared.alias("declared")).select("id", cvss.inconsistent(F.col("v")).alias("inconsistent"), cvss.severity_differs(F.col("declared"), F.col("v")).alias("differs"), cvss.needs_inference(F.col("v"), F.lit("x")).alias("needs"))


_WEAK = ["CWE-22", "CWE-78", "cwe-89 ", "CWE-400", "CWE-1", "CWE-918", "CWE-2"]
_WEAK_SQL = f"({_WEAK!r})[(l_partkey + l_suppkey) % {len(_WEAK)} + 1]"


def _weaknesses(spark, d):
    w = F.element_at(F.array(*map(F.lit, _WEAK)), ((F.col("l_partkey") + F.col("l_suppkey")) % len(_WEAK) + 1).cast("int"))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "w"))).alias("ws"))
    return rows.select("l_orderkey", F.transform("ws", lambda x: x["w"]).alias("ws"))


@query(f"""with m(w, technique, tactic) as (values {','.join(f"('{w}','{x}','{y}')" for w, x, y, _ in attack.BY_WEAKNESS)}),
l as (select l_orderkey, l_linenumber, {_WEAK_SQL} as w from lineitem),
s as (select l_orderkey, technique, tactic, row_number() over (partition by l_orderkey order by l_linenumber, l.w) as n from l join m on upper(trim(l.w)) = m.w)
select l_orderkey, string_agg(n || ':' || technique || ':' || tactic, ' ' order by n) as chain from s group by 1""")
def attack_fallback_chain(spark, d):
    rows = _weaknesses(spark, d).select("l_orderkey", attack.fallback_chain(F.col("ws")).alias("c")).where("c is not null")
    return rows.select("l_orderkey", F.array_join(F.transform("c", lambda s: F.concat_ws(":", s["step"].cast("string"), s["technique_id"], s["tactic"])), " ").alias("chain"))


@query("""with l as (select l_orderkey, l_linenumber as n, l_partkey as p, ' t1' || lpad((l_partkey % 1000)::varchar, 3, '0') || (['', '.001', '.01', ' '])[l_partkey % 4 + 1] as technique, (['Execution', 'initial-access', 'nowhere', ' impact '])[l_suppkey % 4 + 1] as tactic from lineitem),
g as (select l_orderkey, upper(trim(technique)) as technique, lower(trim(tactic)) as tactic, row_number() over (partition by l_orderkey order by n, p, l.tactic) as k from l where l.p % 4 <> 2 and l.tactic <> 'nowhere')
select l_orderkey, string_agg(k || ':' || technique || ':' || tactic, ' ' order by k) as chain from g where k <= 6 group by 1""")
def chain_sanitize(spark, d):
    technique = F.concat(F.lit(" t1"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.element_at(F.array(*map(F.lit, ["", ".001", ".01", " "])), (F.col("l_partkey") % 4 + 1).cast("int")))
    tactic = F.element_at(F.array(*map(F.lit, ["Execution", "initial-access", "nowhere", " impact "])), (F.col("l_suppkey") % 4 + 1).cast("int"))
    rows = t(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber"), F.col("l_partkey"), tactic.alias("tactic"), technique.alias("technique_id"), F.lit("Exploitation").alias("stage")).alias("s"))
    rows = rows.groupBy("l_orderkey").agg(attack.sanitize_chain(F.array_sort(F.collect_list("s"))).alias("c")).where("size(c) > 0")
    return rows.select("l_orderkey", F.array_join(F.transform("c", lambda s: F.concat_ws(":", s["step"].cast("string"), s["technique_id"], s["tactic"])), " ").alias("chain"))


@query("""with x as (select o_orderkey, (['Initial  Access', 'COMMAND_AND_CONTROL', 'privilege-escalation', ' Impact'])[o_orderkey % 4 + 1] as a, (['None (unauthenticated)', 'Root', 'a low one', 'whatever', ''])[o_orderkey % 5 + 1] as p, 'net; ' || o_orderstatus || chr(10) || ' ; key' as c from orders)
select o_orderkey, (['initial-access', 'command-and-control', 'privilege-escalation', 'impact'])[o_orderkey % 4 + 1] as tactic, (['none', 'high', 'low', 'unknown', 'unknown'])[o_orderkey % 5 + 1] as privileges, array_to_string(list_filter(list_transform(string_split_regex(c, '[;\n]'), lambda s: trim(s)), lambda s: s <> ''), ',') as preconditions from x""")
def chain_normalizers(spark, d):
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    c = F.concat(F.lit("net; "), F.col("o_orderstatus"), F.lit("\n ; key"))
    return t(spark, d, "orders").select("o_orderkey", attack.tactic(at(["Initial  Access", "COMMAND_AND_CONTROL", "privilege-escalation", " Impact"])).alias("tactic"), attack.privileges(at(["None (unauthenticated)", "Root", "a low one", "whatever", ""])).alias("privileges"), F.array_join(attack.preconditions(c), ",").alias("preconditions"))


@query("""select o_orderkey, substr('CVE-2024-' || (10000 + o_orderkey) || case when o_orderkey % 3 > 0 then ' ' || o_orderpriority else '' end
|| case when o_orderkey % 2 = 0 or o_orderstatus <> 'P' or o_orderkey % 5 = 0 then chr(10) else '' end
|| concat_ws(' | ', case when o_orderkey % 2 = 0 then 'CWE: CWE-22, CWE-78' end, case when o_orderstatus <> 'P' then 'Severity: ' || o_orderstatus end, case when o_orderkey % 5 = 0 then 'CISA KEV: exploited in the wild' end)
|| chr(10) || repeat(o_orderstatus || ' text ', 700), 1, 4000) as body from orders""")
def index_text(spark, d):
    k = F.col("o_orderkey")
    body = render.vuln_text(F.concat(F.lit("CVE-2024-"), (k + 10000).cast("string")), F.when(k % 3 > 0, F.col("o_orderpriority")), F.when(k % 2 == 0, F.array(F.lit("CWE-22"), F.lit("CWE-78"))).otherwise(F.expr("cast(array() as array<string>)")),
                            F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.expr("cast(array() as array<string>)"), k % 5 == 0, F.concat(F.repeat(F.concat("o_orderstatus", F.lit(" text ")), F.lit(700))))
    return t(spark, d, "orders").select("o_orderkey", body.alias("body"))


@query("""select o_orderkey, concat_ws(';', 'cve_id=' || o_orderkey, case when o_orderkey % 3 = 0 then 'kev=true' end, case when o_orderkey % 2 = 0 then 'published_at=' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end, case when o_orderstatus <> 'P' then 'severity=' || o_orderstatus end, case when o_orderkey % 4 > 0 then 'source=ghsa,nvd' end) as metadata from orders""")
def index_metadata(spark, d):
    k = F.col("o_orderkey")
    sources = F.when(k % 4 > 0, F.array(F.lit("nvd"), F.lit("ghsa"))).otherwise(F.expr("cast(array() as array<string>)"))
    m = render.index_metadata(k.cast("string"), sources, F.when(k % 2 == 0, F.col("o_orderdate")), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(""), k % 3 == 0)
    return t(spark, d, "orders").select("o_orderkey", render.flat_text(m).alias("metadata"))


@query("""with l as (select l_orderkey, l_linenumber as n, l_partkey as p, l_suppkey as s, 'https://v.example/' || (['patch', 'Advisory', 'blog', 'x'])[l_partkey % 4 + 1] || '/' || (l_suppkey % 3) as url, l_returnflag = 'R' as tagged from lineitem),
g as (select *, bool_or(tagged) over (partition by l_orderkey) as any_tag from l), c as (select * from g where case when any_tag then tagged else regexp_matches(lower(url), 'patch|advisory|security') end),
u as (select l_orderkey, url, min((n, p, s)) as first from c group by 1, 2), r as (select *, row_number() over (partition by l_orderkey order by first) as k from u)
select o.l_orderkey, coalesce(links, '') as links from (select distinct l_orderkey from lineitem) o left join (select l_orderkey, string_agg(url, ' ' order by k) as links from r where k <= 5 group by 1) x on x.l_orderkey = o.l_orderkey""")
def patch_links(spark, d):
    url = F.concat(F.lit("https://v.example/"), F.element_at(F.array(*map(F.lit, ["patch", "Advisory", "blog", "x"])), (F.col("l_partkey") % 4 + 1).cast("int")), F.lit("/"), (F.col("l_suppkey") % 3).cast("string"))
    ref = F.struct("l_linenumber", "l_partkey", "l_suppkey", url.alias("url"), F.when(F.col("l_returnflag") == "R", F.array(F.lit(" Patch "))).otherwise(F.array(F.lit("misc"))).alias("tags"))
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(ref)).alias("refs"))
    return rows.select("l_orderkey", F.array_join(render.patch_links(F.col("refs")), " ").alias("links"))


@query("""with p as (select l_orderkey, array_agg(distinct p_name order by p_name) as names, bool_or(l_returnflag = 'R') as kev from lineitem join part on l_partkey = p_partkey group by 1)
select l_orderkey, array_to_string(list_concat(list_transform(names[1:2], lambda x: 'Upgrade ' || x || ' to the fixed release'), case when kev then ['Known to be exploited: patch first or take the exposed part offline'] else [] end, ['Limit network exposure to trusted peers']), '|') as mitigations,
array_to_string(list_filter(['u1', 'u2', 'u3'], lambda u: u <> 'u2'), ',') as links from p""")
def remediation_template(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_name").alias("names"), F.bool_or(F.col("l_returnflag") == "R").alias("kev"))
    links = render.allowed_links(F.array(*map(F.lit, ["u1", "u2", "u3"])), F.array(*map(F.lit, ["u3", "u1"])))
    return rows.select("l_orderkey", F.array_join(render.mitigations(F.col("names"), F.col("kev")), "|").alias("mitigations"), F.array_join(links, ",").alias("links"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'CVE-2024-' || (10000 + o_orderkey) when 1 then 'GHSA-abcd-' || o_orderkey when 2 then 'MY_FEED-p-' || o_orderkey || '-' || upper(substr(sha256('https://h.example/p/' || o_orderkey || '?q=1'), 1, 10)) end as key, o_orderkey % 4 = 0 as cve from orders""")
def key_folding(spark, d):
    k = F.col("o_orderkey")
    n = k.cast("string")
    c = F.when(k % 4 == 0, F.concat(F.lit(" cve-2024-"), (k + 10000).cast("string"))).when(k % 4 == 1, F.concat(F.lit("GHSA-abcd-"), n)).when(k % 4 == 2, F.concat(F.lit("https://h.example/p/"), n, F.lit("?q=1"))).otherwise("  ")
    return t(spark, d, "orders").select("o_orderkey", text.vuln_key(c, "my feed").alias("key"), F.coalesce(text.is_cve(c), F.lit(False)).alias("cve"))


@query("""with x as (select conv_id, turn, text || ' cve-2024-' || (1000 + turn) || ' and CVE-2024-' || (1000 + turn) || ', GHSA-23ch-mpq4-r' || (2 + conv_id % 8) || 'vw xCWE-1 CWE-' || conv_id || ' CVE-2023-0' as s from conversations)
select conv_id, turn, array_to_string(list_filter(['CVE-2024-' || (1000 + turn)], lambda v: true), ',') as cves, 'GHSA-23ch-mpq4-r' || (2 + conv_id % 8) || 'vw,CWE-' || conv_id as aliases from x""")
def identifiers_in_text(spark, d):
    n, m = (F.col("turn") + 1000).cast("string"), F.col("conv_id").cast("string")
    s = F.concat(F.col("text"), F.lit(" cve-2024-"), n, F.lit(" and CVE-2024-"), n, F.lit(", GHSA-23ch-mpq4-r"), (F.col("conv_id") % 8 + 2).cast("string"), F.lit("vw xCWE-1 CWE-"), m, F.lit(" CVE-2023-0"))
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.cve_ids(s), ",").alias("cves"), F.array_join(text.aliases(s), ",").alias("aliases"))


@query("""select event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as a, strftime(date_trunc('second', ts), '%Y-%m-%d 00:00:00') as b, cast(floor(epoch(ts)) as bigint) as c, null::bigint as n from events""")
def datetime_parse(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    back = lambda c: F.date_format(times.parse_time(c), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", back(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("a"), back(F.date_format("ts", "yyyy/MM/dd")).alias("b"), F.unix_seconds(times.parse_time(F.unix_seconds("ts").cast("string"))).alias("c"), F.unix_seconds(times.parse_time(F.lit("soon"))).alias("n"))


@query("""with u as (select page_id, lower(url || case when page_id % 3 = 0 then '/commit/1' when page_id % 3 = 1 then '/exploit-poc' else '' end) as u from pages)
select page_id, concat_ws(',', case when regexp_matches(u, 'patch|commit|advisory|release') then 'patch' end, case when regexp_matches(u, 'exploit|poc|metasploit') then 'exploit' end) as tags from u""")
def reference_tagging(spark, d):
    u = F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, "/commit/1").when(F.col("page_id") % 3 == 1, "/exploit-poc").otherwise(""))
    return t(spark, d, "pages").select("page_id", F.array_join(urls.reference_tags(u), ",").alias("tags"))


@query("""select doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)[1:20], ' ') as hash_tokens from documents""")
def hash_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(F.slice(text.hash_tokens(F.col("text")), 1, 20), " ").alias("hash_tokens"))


@query("""with w as (select doc_id, unnest(string_split_regex(lower(text), '[^0-9a-z一-龥]+')) as x from documents), g as (select distinct doc_id, case when length(regexp_replace(x, '[0-9]+$', '')) >= 3 then regexp_replace(x, '[0-9]+$', '') else x end as x from w where length(x) >= 2 and not regexp_full_match(x, '[0-9]+') and x not in ('the', 'and'))
select d.doc_id, coalesce(n, 0) as n, coalesce(least_, '') as least from documents d left join (select doc_id, count(*) as n, min(x) as least_ from g group by 1) k on k.doc_id = d.doc_id""")
def graph_tokens(spark, d):
    found = text.graph_tokens(F.col("text"), ["the", "and"])
    return t(spark, d, "documents").select("doc_id", found.alias("f")).select("doc_id", F.size("f").cast("long").alias("n"), F.coalesce(F.array_min("f"), F.lit("")).alias("least"))

"""Queries on questions, retrieval routes, fusion, evidence and answers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions as q
from ..functions import hashing, text
from ..operators import cells, postings, retrieve
from ..session import scratch
from .queries import _WORDS, ORACLE, query, t

_ASKED = [
    "How to fix CVE-2024-12345", "attack chain via T1059.004 of Palo Alto Networks", "which assets have it installed", "critical and high severity from nvd in the last 7 days", "is it exploited in the wild", "hello there",
    "upgrade to what, cve-2023-1000 or CVE-2023-1001", "risk score of last year osv", "inventory and kill chain", "epss of log4j:core", "patched in which release, vendor advisory please",
]
_ASK = f"({_ASKED!r})[(conv_id * 3 + turn) % {len(_ASKED)} + 1]"
_Q = f"q as (select conv_id, turn, {_ASK} as s, lower({_ASK}) as l, replace(lower({_ASK}), ' ', '') as b from conversations)"


def _any(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(l, '{w.lower()}') or contains(b, '{w.lower().replace(' ', '')}')" for w in words) + ")"


def _case(table: dict[str, list[str]], other: str) -> str:
    return "case " + " ".join(f"when {_any(ws)} then '{k}'" for k, ws in table.items()) + f" else '{other}' end"


def _list(pairs: list[tuple[str, str]]) -> str:
    return "concat_ws(','," + ", ".join(f"case when {c} then '{k}' end" for c, k in pairs) + ")"


def _questions(spark, d):
    s = F.element_at(F.array(*map(F.lit, _ASKED)), ((F.col("conv_id") * 3 + F.col("turn")) % len(_ASKED) + 1).cast("int"))
    return t(spark, d, "conversations").select("conv_id", "turn", s.alias("s"))


@query(f"""with {_Q} select conv_id, turn, {_case(q.INTENTS, 'general')} as intent, {_case(q.TIME_WORDS, 'all')} as time_range, {_list([(_any(ws), k) for k, ws in q.SEVERITY_WORDS.items()])} as severities, {_list([(f"contains(l, '{x}')", x) for x in q.SOURCES])} as sources, {_any(q.KEV_WORDS)} as kev_only from q""")
def question_rules(spark, d):
    s = F.col("s")
    return _questions(spark, d).select("conv_id", "turn", q.intent(s).alias("intent"), q.time_range(s).alias("time_range"), F.array_join(q.severities(s), ",").alias("severities"), F.array_join(q.sources(s), ",").alias("sources"), q.kev_only(s).alias("kev_only"))


_ENT = r"""e as (select conv_id, turn, s, l, b, list_distinct(list_transform(regexp_extract_all(s, '(?i)\bCVE-\d{4}-\d{4,}\b'), lambda x: upper(x))) as c, list_distinct(regexp_extract_all(s, '\bT\d{4}(?:\.\d{3})?\b')) as k, list_distinct(regexp_extract_all(s, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b')) as v from q)"""


@query(f"""with {_Q}, {_ENT}, i as (select *, {_case(q.INTENTS, 'general')} as i, {_case(q.TIME_WORDS, 'all')} <> 'all' or {_any([w for ws in q.SEVERITY_WORDS.values() for w in ws])} or {' or '.join(f"contains(l, '{x}')" for x in q.SOURCES)} or {_any(q.KEV_WORDS)} as f from e)
select conv_id, turn, array_to_string(list_sort(c), ',') as cves, array_to_string(k, ',') as techniques, array_to_string(v, ',') as vendors, cast(least(85, 30 + (len(c) > 0)::int * 20 + (len(k) > 0)::int * 10 + (len(v) > 0)::int * 10 + (i <> 'general')::int * 10 + f::int * 10) as integer) as confidence,
replace(case i {' '.join(f"when '{k}' then '{','.join(r)}'" for k, r in q.PLANS.items())} end, case when len(c) = 1 then ',fulltext' else '-' end, '') as plan, case when i = 'remediation' or {_any(q.INTENTS['remediation'])} then 'vulns,remediation' else 'vulns' end as collections from i""")
def question_entities_and_plan(spark, d):
    s = F.col("s")
    rows = _questions(spark, d).withColumn("i", q.intent(s)).withColumn("c", text.cve_ids(s))
    join = lambda c: F.array_join(c, ",")
    return rows.select("conv_id", "turn", join(F.array_sort("c")).alias("cves"), join(q.techniques(s)).alias("techniques"), join(q.vendors(s)).alias("vendors"), q.rule_confidence(s).cast("int").alias("confidence"), join(q.plan(F.col("i"), F.col("c"))).alias("plan"), join(q.collections(s, F.col("i"))).alias("collections"))


def _needed_sql(fact: str) -> str:
    by_intent = [k for k, facts in q.NEEDED.items() if fact in facts]
    words = _any([w for ws, facts in q.ASKED if fact in facts for w in ws])
    return f"(i in ({','.join(map(repr, by_intent))}) or {words})" if by_intent else words


def _present_sql(fact: str) -> str:
    extra = {"affected_components": f" or regexp_matches(u, '{q.COMPONENT}')", "attack_techniques": r" or regexp_matches(u, '\bT\d{4}(?:\.\d{3})?\b')"}
    return "(" + " or ".join(f"contains(l, '{m}')" for m in q.MARKERS[fact]) + extra.get(fact, "") + ")"


@query(f"""with {_Q}, i as (select *, {_case(q.INTENTS, 'general')} as i, regexp_replace(l, 'https?://\\S+', ' ', 'g') as u from q),
r as (select conv_id, turn, {_list([(_needed_sql(f), f) for f in q.FACTS])} as needed, {_list([(_present_sql(f), f) for f in q.FACTS])} as present from i),
m as (select *, array_to_string(list_filter(string_split(needed, ','), lambda x: x <> '' and not contains(',' || present || ',', ',' || x || ',')), ',') as missing from r)
select conv_id, turn, needed, present, missing, case when needed <> '' then missing = '' else turn % 2 = 0 end as enough from m""")
def evidence_gaps(spark, d):
    s = F.col("s")
    rows = _questions(spark, d).select("conv_id", "turn", q.needed_facts(s, q.intent(s)).alias("needed"), q.facts_in_text(s).alias("present"))
    ok = q.enough(F.col("needed"), F.col("present"), F.when(F.col("turn") % 2 == 0, 1).otherwise(0), F.lit(1))
    join = lambda c: F.array_join(c, ",")
    return rows.select("conv_id", "turn", join("needed").alias("needed"), join("present").alias("present"), join(F.array_except("needed", "present")).alias("missing"), ok.alias("enough"))


@query("""select conv_id, turn, case when turn % 4 = 0 then 0 else cast(floor((0.5 + 0.5 * least(1.0, (turn % 4)::double / (1 + conv_id % 3))) * (case when turn % 2 = 0 then 0.6 else 1.0 end)::double * (case when conv_id % 2 = 0 then 0.6 else 1.0 end)::double * 10000 + 0.5) as bigint) end as confidence from conversations""")
def answer_confidence(spark, d):
    c = q.answer_confidence((F.col("turn") % 4).cast("double"), (F.col("conv_id") % 3 + 1).cast("double"), F.col("turn") % 2 == 0, F.col("conv_id") % 2 == 0)
    return t(spark, d, "conversations").select("conv_id", "turn", c.alias("confidence"))


_SOME = [v for v in range(30, 400) if v % 3]


@query(f"select vec_id, label from embeddings where label in (0, 2, 5) and vec_id >= 40 and vec_id in ({','.join(map(str, _SOME))})")
def metadata_filter(spark, d):
    filters = retrieve.with_ids({"label": {"$in": [0, 2, 5]}, "vec_id": {"$gte": 40}}, "vec_id", _SOME)
    return t(spark, d, "embeddings").where(retrieve.where(filters)).select("vec_id", "label")


_COS = "cast(floor(greatest(0, least(1, list_cosine_similarity(cast(embedding as double[]), cast(v as double[])))) * 10000 + 0.5) as bigint)"


@query(f"""with q as (select embedding as v from embeddings where vec_id = 0), s as (select vec_id, label, {_COS} as score from embeddings, q where label in (0, 1, 2))
select vec_id, label as collection, score from s qualify row_number() over (partition by label order by score desc, vec_id) <= 4""")
def vector_route(spark, d):
    e = t(spark, d, "embeddings").withColumnRenamed("label", "collection")
    return retrieve.vector_route(e, "vec_id", "embedding", "collection", [0, 1, 2], e.where("vec_id = 0").select("embedding"), 4)


@query("select doc_id, case when doc_id % 3 = 0 then 'cve:CVE-' || doc_id when doc_id % 3 = 1 then 'paper:' || source else doc_id::varchar end as entity from documents")
def entity_keys(spark, d):
    k = F.col("doc_id")
    return t(spark, d, "documents").select("doc_id", retrieve.entity_key(F.when(k % 3 == 0, F.concat(F.lit("cve-"), k.cast("string"))), F.when(k % 3 == 1, F.col("source")), k.cast("string")).alias("entity"))


@query(f"""with f as (select doc_id::varchar as doc_id, score from ({ORACLE['fulltext_topk']})), w as (select doc_id::varchar as doc_id, score from ({ORACLE['keyword_search_sum']}) order by score desc, doc_id::varchar limit 40),
r as (select d.source as entity, f.doc_id, d.n_chars as len, 'fulltext' as source, 0 as route, 1.0::double as w, row_number() over (order by score desc, f.doc_id) as rank from f join documents d on d.doc_id::varchar = f.doc_id
union all select d.source, w.doc_id, d.n_chars, 'keyword', 1, 0.5::double, row_number() over (order by score desc, w.doc_id) from w join documents d on d.doc_id::varchar = w.doc_id),
b as (select entity, route, cast(first(w) / (60 + min(rank)) as decimal(20,12)) as part, arg_min((source, doc_id), (-len, doc_id, source)) as rep, min((-len, doc_id, source)) as k from r group by 1, 2),
g as (select entity, cast(floor(cast(sum(part) as double) * 1000000 + 0.5) as bigint) as rrf, count(*) as routes, arg_min(rep, k) as rep from b group by 1)
select entity, rrf, routes, rep[1] as source, rep[2] as doc_id from g order by rrf desc, source, doc_id limit 10""")
def rrf_with_representatives(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("entity"), F.col("text").alias("content"), "text")
    full = retrieve.fulltext(t(spark, d, "documents"), "doc_id", "text", _WORDS, 50).withColumn("doc_id", F.col("doc_id").cast("string"))
    words = retrieve.keyword_sum(docs, "doc_id", "text", ["ing", "est"]).orderBy(F.desc("score"), "doc_id").limit(40)
    route = lambda df, name: df.join(docs.drop("text"), "doc_id").withColumn("source", F.lit(name))
    return retrieve.fuse([(route(full, "fulltext"), 1.0), (route(words, "keyword"), 0.5)])


@query(f"""with f as ({ORACLE['rrf_fusion']}) select id, rrf + case when id % 2 = 0 then 500000 else 0 end as rrf from f""")
def entity_boost(spark, d):
    from .queries import rrf_fusion

    return retrieve.boost(rrf_fusion(spark, d), F.col("id") % 2 == 0).select("id", "rrf")


@query(f"""with f as ({ORACLE['fulltext_topk']}) select doc_id, score, 1 as n_failed from f""")
def route_dispatch(spark, d):
    """A plan with a route that fails: the rest answer, and the failed one is counted."""
    def broken():
        raise OSError("no vectors")
    routes = {"vector": broken, "fulltext": lambda: retrieve.fulltext(t(spark, d, "documents"), "doc_id", "text", _WORDS, 50)}
    found, failed = retrieve.hybrid(routes, ["vector"], {"vector": "fulltext"})
    return found[0].withColumn("n_failed", F.lit(len(failed)))


@query("""with s as (select doc_id, cast(floor(((contains(lower(text), 'tion'))::int + (contains(lower(text), 'the'))::int) * 10000.0::double / 2 + 0.5) as bigint) as score from documents where doc_id in (1, 5, 9, 12, 20, 33)) select * from s where score > 0 order by score desc, doc_id limit 3""")
def fulltext_in_ids(spark, d):
    docs = t(spark, d, "documents").where(F.col("doc_id").isin(1, 5, 9, 12, 20, 33))
    return retrieve.fulltext(docs, "doc_id", "text", ["tion", "the"], 3)


@query("""with v as (select distinct l_orderkey, l_partkey from lineitem where l_orderkey < 200), a as (select distinct p_partkey, p_brand from part where p_size < 25), p as (select distinct l_orderkey::varchar as vuln, concat_ws(' > ', l_orderkey::varchar, l_partkey::varchar, p_brand) as path, case when p_brand is null then 1 else 2 end as hops from v left join a on p_partkey = l_partkey)
select *, case when max(hops) over (partition by vuln) = 2 then 10000 else 5000 end as score from p""")
def multi_hop_paths(spark, d):
    l = t(spark, d, "lineitem").where("l_orderkey < 200")
    vulns = l.select(F.col("l_orderkey").cast("string").alias("vuln")).distinct()
    components = l.select(F.col("l_orderkey").cast("string").alias("vuln"), F.col("l_partkey").cast("string").alias("component")).distinct()
    assets = t(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").cast("string").alias("component"), F.col("p_brand").alias("asset")).distinct()
    return retrieve.asset_paths(vulns, components, assets)


@query("""select l_partkey, arg_max(l_suppkey, (l_discount, -l_orderkey, -l_linenumber, -l_suppkey)) as winner, count(distinct l_suppkey) as n_sources, count(distinct l_suppkey) > 1 as corroborated from lineitem group by 1""")
def conflict_resolution(spark, d):
    order = F.col("l_orderkey") * 1000000000 + F.col("l_linenumber") * 100000000 + F.col("l_suppkey")
    return retrieve.resolve_conflicts(t(spark, d, "lineitem"), "l_partkey", "l_suppkey", F.col("l_discount"), order)


@query("select l_orderkey, l_linenumber from lineitem where cast(l_discount * 100000 as bigint) >= 6000 and l_partkey = l_suppkey")
def evidence_accept(spark, d):
    ok = retrieve.accepted(F.rint(F.col("l_discount") * 100000).cast("long"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return t(spark, d, "lineitem").where(ok).select("l_orderkey", "l_linenumber")


@query("select doc_id from documents where contains(lower(text), 'tion') or contains(lower(text), 'und') order by source, n_chars desc, doc_id limit 5")
def gap_filter_rank(spark, d):
    facts = F.filter(F.array(F.when(F.contains(F.lower("text"), F.lit("tion")), F.lit("a")), F.when(F.contains(F.lower("text"), F.lit("und")), F.lit("b"))), lambda x: x.isNotNull())
    return retrieve.gap_evidence(t(spark, d, "documents"), facts, F.array(F.lit("a"), F.lit("b")), [F.asc("source"), F.desc("n_chars"), F.asc("doc_id")]).select("doc_id")


@query("select doc_id from documents left join labels using (doc_id) where quality is null or quality = 1")
def relevance_filter(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return rows.where(retrieve.relevant(F.col("quality").cast("string"), ["1"])).select("doc_id")


_STEPS = """r as (select user_id, event_id, value, (['vector', 'graph', 'fulltext', 'multi_hop', 'other'])[event_id % 5 + 1] as route from events), k as (select *, row_number() over (partition by user_id order by case route when 'graph' then 1 when 'multi_hop' then 2 when 'fulltext' then 3 when 'vector' then 4 else 99 end, value desc, event_id) as step from r)"""


def _steps(spark, d, most):
    route = F.element_at(F.array(*map(F.lit, ["vector", "graph", "fulltext", "multi_hop", "other"])), (F.col("event_id") % 5 + 1).cast("int"))
    return retrieve.offline_steps(t(spark, d, "events").withColumn("route", route), "user_id", "route", "value", "event_id", most)


@query(f"with {_STEPS} select user_id, cast(step as integer) as step, route, event_id from k where step <= 2")
def offline_reasoning(spark, d):
    return _steps(spark, d, 2).select("user_id", "step", "route", "event_id")


@query(f"""with {_STEPS}, a as (select user_id, string_agg('- ' || event_type || ' ' || k.event_id, chr(10) order by step) as answer, list(k.event_id % 3 order by step) as c from k join events using (event_id, user_id) where step <= 5 group by 1)
select user_id, answer || case when user_id % 2 = 0 then chr(10) || 'No fixed version is known.' else '' end as answer, array_to_string(list_filter(list_transform(range(1, len(c) + 1), lambda i: case when list_position(c, c[i]) = i then c[i] end), lambda x: x is not null), ',') as citations from a""")
def offline_answer(spark, d):
    out = retrieve.offline_answer(_steps(spark, d, 5), "user_id", "step", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")), (F.col("event_id") % 3).cast("string"))
    missing = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("fixed_version"))).otherwise(F.array(F.lit("kev")))
    return out.select("user_id", retrieve.gap_notice(F.col("answer"), missing, "No fixed version is known.").alias("answer"), "citations")


@query(f"""with s as ({ORACLE['keyword_search_sum']}) select doc_id, score, n_chars from s join documents using (doc_id) order by score desc, n_chars desc, doc_id limit 20""")
def keyword_papers(spark, d):
    return retrieve.keyword_papers(t(spark, d, "documents"), "doc_id", "text", "n_chars", ["ing", "est"], 20)


@query("""select p_partkey, contains(lower(p_name), 'widget') or contains(lower(p_brand), 'widget') as by_product, contains(lower('npm:' || p_type), 'eco') as by_package from part""")
def component_match(spark, d):
    from ..functions import packages

    m = F.array(F.struct(F.col("p_name").alias("product"), F.col("p_brand").alias("vendor")))
    none = F.expr("cast(array() as array<struct<product:string,vendor:string>>)")
    return t(spark, d, "part").select("p_partkey", packages.component_matches(F.lit(" Widget "), m, F.expr("cast(array() as array<string>)")).alias("by_product"), packages.component_matches(F.lit("ECO"), none, F.array(F.concat(F.lit("npm:"), F.col("p_type")))).alias("by_package"))


@query("""select l_orderkey, l_linenumber, cast(round(s / n * 1000) as bigint) as trust, case when c >= 700 and k = 0 then 'auto_pass' when c >= 700 then 'revised' else 'needs_human' end as status, cast(c as bigint) as confidence from
(select *, cast(floor(greatest(0.0::double, least(1.0::double, (0.4::double * d1 + case when q then 0.25::double * 0.5 else 0 end) / (0.4::double + case when q then 0.25 else 0 end::double) - least(0.4::double, 0.1::double * k))) * 1000 + 0.5) as bigint) as c from
(select l_orderkey, l_linenumber, l_linenumber % 3 as k, (cast(l_quantity as int) % 11) / 10.0::double as d1, l_returnflag = 'R' as q, case when l_returnflag = 'R' then 2.4 else 0.9 + 0.5 end::double as s, case when l_returnflag = 'R' then 3 else 2 end as n from lineitem))""")
def trust_confidence_review(spark, d):
    from ..functions import scoring

    sources = F.when(F.col("l_returnflag") == "R", F.array(*map(F.lit, ["nvd", "nvd", "other"]))).otherwise(F.array(*map(F.lit, ["nvd", "kev"])))
    weights = {"nvd": 0.9, "other": 0.6}
    trust = scoring.trust_score(sources, weights)
    k = F.col("l_linenumber") % 3
    c = scoring.confidence([(0.4, (F.col("l_quantity").cast("int") % 11) / 10.0), (0.25, F.when(F.col("l_returnflag") == "R", 0.5))], k)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", trust.alias("trust"), scoring.review_status(c, k).alias("status"), c.alias("confidence"))


_QUESTIONS = """q as (select conv_id, (list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: {'l': -length(x), 't': x})))[1:3]) as w from (select conv_id, arg_min(text, turn) as text from conversations where role = 'user' group by 1)),
a as (select conv_id, unnest(list_transform(w, lambda x: x.t)) as word, len(w) as n from q)"""


@query(f"""with {_QUESTIONS}, t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents), p as (select word, token from (select distinct word from a) join (select distinct token from t) on contains(token, word)),
h as (select distinct word, doc_id from p join t using (token)), s as (select conv_id, doc_id, cast(floor(count(*) / any_value(n)::double * 10000 + 0.5) as bigint) as score from a join h using (word) group by 1, 2)
select conv_id, doc_id, score from s qualify row_number() over (partition by conv_id order by score desc, doc_id) <= 10""")
def fulltext_batch(spark, d):
    """The first question of every conversation, by its three longest words, in one plan over an index of the documents that was added to in two batches."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    index = postings.Postings(spark, scratch(spark, "postings"), "doc_id")
    for n in (0, 1):
        index.add(docs.where(F.col("doc_id") % 2 == n), "text", ("documents", n))
    first = t(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    longest = F.slice(F.array_sort(F.array_distinct(F.transform(text.tokens(F.col("text")), lambda x: F.struct((-F.length(x)).alias("l"), x.alias("t"))))), 1, 3)
    return index.search(first.select("conv_id", F.transform(longest, lambda x: x["t"]).alias("words")), "conv_id", "words", 10)


@query("""with p as (select q.vec_id as question, v.vec_id, cast(floor(greatest(0, least(1, list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[])))) * 10000 + 0.5) as bigint) as score from embeddings q, embeddings v where q.vec_id % 20 = 0)
select question, vec_id, score from p qualify row_number() over (partition by question order by score desc, vec_id) <= 10""")
def vector_batch(spark, d):
    """The ten nearest vectors of every twentieth one, all at once."""
    e = t(spark, d, "embeddings")
    return cells.Cells(e, "vec_id", "embedding").search(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "question"), "question", "embedding", 10)


@query()
def vector_questions(spark, d):
    """Every turn of the conversations beside the five nearest documents, by hashed embeddings."""
    docs = t(spark, d, "documents").select("doc_id", hashing.hash_embedding(F.col("text"), 64).alias("v"))
    asked = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("asked"), hashing.hash_embedding(F.col("text"), 64).alias("v"))
    return cells.Cells(docs, "doc_id", "v").search(asked, "asked", "v", 5)

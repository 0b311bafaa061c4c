"""The graph of enriched records: nodes and edges of every kind with their properties.

A record is turned into arrays of nodes and edges in one projection, so nothing is joined; a record has few of each (components and links to assets are limited by rank). Nodes that several records name are merged
by (label, key), edges by their ends, the first record's properties first.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packages, text
from ..functions.cvss import let

#: Components of a record, assets that each of them is linked to, and characters of a description that are kept.
COMPONENTS, ASSETS, DESCRIBED = 5, 50, 600
#: Confidence of components by CPE and by package, what an unrelated one's is multiplied by, and what says that a link was inferred.
BY_CPE, BY_PACKAGE, UNRELATED, INFERRED = 1.0, 0.5, 0.5, "cve-cooccurrence"
#: Tags and parts of links that tell a patch or an advisory.
PATCH_TAGS = ["patch", "advisory", "vendor-advisory", "fix", "mitigation"]
PATCH_LINKS = ["/security/advisories/", "/advisories/", "/security-bulletin", "/support/security", "security.paloaltonetworks.com", "msrc.microsoft.com", "/patches/"]
#: Words that tell what a weakness concerns.
HINTS = {
    "CWE-20": ["input", "validation", "parse", "parser", "request", "parameter"], "CWE-22": ["path", "file", "filesystem", "upload", "storage", "traversal", "directory"], "CWE-77": ["command", "shell", "exec", "system", "cmd", "bash", "sh"],
    "CWE-78": ["command", "shell", "exec", "system", "cmd", "bash", "sh", "os"], "CWE-79": ["browser", "web", "html", "javascript", "template", "script", "dom"], "CWE-89": ["sql", "database", "db", "mysql", "postgres", "query", "orm"],
    "CWE-94": ["script", "eval", "expression", "template", "interpreter"], "CWE-287": ["auth", "authentication", "login", "sso", "identity", "oauth", "token"], "CWE-306": ["auth", "authentication", "login", "admin", "identity"],
    "CWE-352": ["csrf", "token", "session", "cookie", "browser", "web"], "CWE-400": ["memory", "resource", "cpu", "dos", "exhaustion", "cache"], "CWE-434": ["upload", "file", "storage", "media", "attachment"],
    "CWE-502": ["serialize", "deserialize", "pickle", "java", "object", "jndi", "lookup", "log"], "CWE-611": ["xml", "parser", "entity", "soap"], "CWE-787": ["buffer", "memory", "heap", "stack", "kernel", "driver"],
    "CWE-918": ["url", "http", "client", "proxy", "fetch", "request"], "CWE-917": ["expression", "language", "jndi", "ldap", "lookup", "log", "log4j", "el"], "CWE-1336": ["template", "engine", "render", "expression", "log", "log4j"],
}
#: Words that tell no component.
GENERIC = (
    "the and for with that this from are was has have all any via not can its may when which into using used other before after along against been being who why how than then them they their there these those such also 但 以及 可以 通过 "
    "score cve security vulnerability vulnerabilities remote code user users attacker attackers allow allows allowed allowing affected affects impact issue issues vendor product system systems control controlled execute executed executes enable enabled "
    "disable disabled remove removed require requires required contain contains include includes permit permits cause causes lead leads result results perform performs load loads loaded read reads write writes access send sends receive receives process "
    "handle handles specific related invalid valid arbitrary complete completely default version versions message messages parameter parameters endpoint endpoints functionality behavior release releases excluding exclude without instead however note notes "
    "certain multiple possible easily service services server servers platform common collector engine manager framework library suite appliance virtual"
).split()
#: What records look like: the columns of a merged record and those that enrichment adds. Columns that a frame lacks count as null.
RECORD = {
    "vuln_id": "string", "title": "string", "description": "string", "severity": "string", "kev": "boolean", "epss_score": "double", "risk_score": "double", "risk_level": "string", "confidence": "double", "review_status": "string", "sources": "array<string>",
    "aliases": "array<string>", "cwe_ids": "array<string>", "affected_versions": "array<string>", "trace_ids": "array<string>", "published_at": "timestamp", "enriched_at": "timestamp", "cpe_matches": f"array<{packages.MATCH}>", "ecosystem_packages": "array<string>",
    "affected_assets": "array<struct<name:string,asset_type:string,vendor:string,version_range:string,ecosystem:string,confidence:double>>", "related_papers": "array<struct<paper_id:string,relation:string,confidence:double,evidence_refs:array<string>>>",
    "attack_steps": "array<struct<order:int,technique_id:string,tactic:string,stage:string,description:string,preconditions:array<string>>>", "references": "array<struct<url:string,source:string,tags:array<string>>>",
}
_MAP = "map<string,string>"


def patch_reference(url: Column, tags: Column) -> Column:
    """Whether a link is a patch or an advisory, by a tag or by its address."""
    low = F.lower(F.trim(url))
    return F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)).isin(*PATCH_TAGS)) | F.exists(F.array(*map(F.lit, PATCH_LINKS)), lambda m: F.contains(low, m))


def _properties(**values: Column) -> Column:
    """What is there, as texts; lists as JSON. Nulls and empty lists go."""
    pairs = F.map_from_arrays(F.array(*(F.lit(k) for k in values)), F.array(*(v.cast("string") for v in values.values())))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _listed(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.to_json(c))


def _range(m: Column) -> Column:
    sign = lambda by, c: F.concat(F.lit(by), F.nullif(c, F.lit("")))
    return F.nullif(F.concat_ws(", ", sign(">=", m["version_start_incl"]), sign(">", m["version_start_excl"]), sign("<=", m["version_end_incl"]), sign("<", m["version_end_excl"])), F.lit(""))


def _tokens(c: Column) -> Column:
    return text.graph_tokens(c, GENERIC)


def components(matches: Column, identifiers: Column, title: Column, description: Column, weaknesses: Column, vendors: Column, most: int = COMPONENTS) -> Column:
    """The components of a record, the best first: by CPE and by package, one of each key; by confidence, halved where neither the record's text nor its weaknesses name it, those of an asset's vendor first, then by key.
    If any is related, the others go."""
    kind = "struct<key:string,name:string,vendor:string,ecosystem:string,version_range:string,confidence:double>"
    null = F.lit(None).cast("string")
    own = lambda key, name, vendor, eco, rng, conf: F.struct(key.alias("key"), name.alias("name"), vendor.alias("vendor"), eco.alias("ecosystem"), rng.alias("version_range"), F.lit(conf).alias("confidence")).cast(kind)
    by_cpe = F.transform(matches, lambda m: own(F.concat(m["vendor"], F.lit(":"), m["product"]), m["product"], m["vendor"], null, _range(m), BY_CPE))

    def by_package(i: Column) -> Column:
        at = F.instr(F.trim(i), ":")
        split = (at > 1) & (at < F.length(F.trim(i)))
        return own(i, F.when(split, F.substring(F.trim(i), at + 1, F.length(F.trim(i)))).otherwise(F.trim(i)), null, F.when(split, F.substring(F.trim(i), F.lit(1), at - 1)), null, BY_PACKAGE)
    named = F.filter(F.transform(identifiers, by_package), lambda c: c["name"] != "")
    every = packages.distinct_by(F.concat(F.coalesce(by_cpe, F.array().cast(f"array<{kind}>")), F.coalesce(named, F.array().cast(f"array<{kind}>"))), kind, "key")
    table = F.create_map(*(x for k, ws in HINTS.items() for x in (F.lit(k), F.array(*(F.lit(w) for w in ws if w not in GENERIC)))))
    # each value that several expressions use is worked out once
    facts = F.struct(_tokens(F.concat_ws(" ", title, description)).alias("said"), F.flatten(F.filter(F.transform(weaknesses, lambda w: F.try_element_at(table, F.upper(F.trim(w)))), lambda x: x.isNotNull())).alias("hinted"),
                     F.transform(vendors, lambda v: F.lower(F.trim(v))).alias("vendors"))

    def judged(c: Column, known: Column) -> Column:
        vendor = F.lower(F.trim(F.coalesce(c["vendor"], F.lit(""))))
        fits = let(vendor, lambda own_: (own_ != "") & F.coalesce(F.exists(known["vendors"], lambda v: (v != "") & (F.contains(v, own_) | F.contains(own_, v))), F.lit(False)))
        words = _tokens(F.concat_ws(" ", c["name"], c["vendor"], F.replace(c["key"], F.lit(":"), F.lit(" "))))
        why = let(words, lambda w: F.when(F.arrays_overlap(w, known["said"]), "text").when(F.coalesce(F.arrays_overlap(w, known["hinted"]), F.lit(False)), "cwe").otherwise("none"))

        def ranked(y: Column) -> Column:
            effective = F.when(y == "none", c["confidence"] * UNRELATED).otherwise(c["confidence"])
            return F.struct((-effective).alias("first"), (~fits).alias("other"), c["key"].alias("key"), y.alias("relevance"), c.alias("c"))
        return let(why, ranked)
    related = lambda rows: let(F.filter(rows, lambda r: r["relevance"] != "none"), lambda found: F.when(F.size(found) > 0, found).otherwise(rows))
    return F.slice(let(F.array_sort(let(facts, lambda known: F.transform(every, lambda c: judged(c, known)))), related), 1, most)


def graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, key, properties) and (relation, start_label, start_key, end_label, end_key, properties) of enriched records. A technique's key is in upper case; papers, techniques and links without a key make nothing."""
    c = lambda name: F.col(name)
    rows = records.select(*((F.col(k) if k in records.columns else F.lit(None)).cast(v).alias(k) for k, v in RECORD.items())).where("vuln_id is not null")
    vendors = F.transform("affected_assets", lambda a: a["vendor"])
    rows = rows.withColumn("parts", components(c("cpe_matches"), c("ecosystem_packages"), c("title"), c("description"), c("cwe_ids"), F.filter(vendors, lambda v: v.isNotNull())))
    asset_key = lambda a: F.concat(a["asset_type"], F.lit(":"), a["name"])
    named = F.filter("affected_assets", lambda a: asset_key(a).isNotNull())
    best = F.slice(F.array_sort(F.transform(packages.distinct_by(F.transform(named, lambda a: F.struct(asset_key(a).alias("key"), a["confidence"].alias("confidence"))), "struct<key:string,confidence:double>", "key"),
                                            lambda a: F.struct((-F.coalesce(a["confidence"], F.lit(0.0))).alias("first"), a["key"].alias("key"), a["confidence"].alias("confidence")))), 1, ASSETS)
    steps = F.filter("attack_steps", lambda s: F.trim(s["technique_id"]) != "")
    technique = lambda s: F.upper(F.trim(s["technique_id"]))
    papers = F.filter("related_papers", lambda p: p["paper_id"].isNotNull())
    patches = F.filter("references", lambda r: (F.coalesce(r["url"], F.lit("")) != "") & patch_reference(r["url"], r["tags"]))

    node = lambda label, key, props: F.struct(F.lit(label).alias("label"), key.alias("key"), props.cast(_MAP).alias("properties"))
    record = _properties(cve_id=c("vuln_id"), title=c("title"), severity=c("severity"), kev=c("kev"), epss_score=c("epss_score"), risk_score=c("risk_score"), risk_level=c("risk_level"), confidence=c("confidence"), review_status=c("review_status"), sources=_listed(c("sources")), aliases=_listed(c("aliases")),
                         cwe_ids=_listed(c("cwe_ids")), affected_versions=_listed(c("affected_versions")), trace_ids=_listed(c("trace_ids")), published_at=c("published_at"), enriched_at=c("enriched_at"), description=F.substring(F.coalesce("description", F.lit("")), 1, DESCRIBED))
    kinds = [
        F.array(node("Vulnerability", c("vuln_id"), record)),
        F.transform("parts", lambda p: node("Component", p["key"], _properties(key=p["key"], name=p["c"]["name"], vendor=p["c"]["vendor"], ecosystem=p["c"]["ecosystem"], version_range=p["c"]["version_range"], vulnerable=F.lit(True), confidence=p["c"]["confidence"], relevance=p["relevance"], effective_confidence=-p["first"]))),
        F.transform(named, lambda a: node("Asset", asset_key(a), _properties(key=asset_key(a), name=a["name"], asset_type=a["asset_type"], vendor=a["vendor"], version_range=a["version_range"], ecosystem=a["ecosystem"], confidence=a["confidence"]))),
        F.transform(papers, lambda p: node("Paper", p["paper_id"], _properties(paper_id=p["paper_id"], relation=p["relation"]))),
        F.transform(steps, lambda s: node("AttackTechnique", technique(s), _properties(technique_id=technique(s), tactic=s["tactic"], stage=s["stage"], description=s["description"], order=s["order"]))),
        F.transform(patches, lambda r: node("Patch", r["url"], _properties(url=r["url"], source=r["source"], tags=_listed(r["tags"])))),
    ]
    no_nodes = F.array().cast(f"array<struct<label:string,key:string,properties:{_MAP}>>")
    every = F.concat(*(F.coalesce(k, no_nodes) for k in kinds))
    # within a record the first of equals counts, over records the one with the least id
    nodes = rows.select("vuln_id", F.posexplode(every).alias("nth", "n")).select("vuln_id", "nth", "n.*")
    nodes = nodes.groupBy("label", "key").agg(F.min_by("properties", F.struct("vuln_id", "nth")).alias("properties"))

    edge = lambda relation, a, start, b, end, props: F.struct(F.lit(relation).alias("relation"), F.lit(a).alias("start_label"), start.alias("start_key"), F.lit(b).alias("end_label"), end.alias("end_key"), props.cast(_MAP).alias("properties"))
    v = c("vuln_id")
    links = [
        F.transform("parts", lambda p: edge("AFFECTS", "Vulnerability", v, "Component", p["key"], _properties(version_range=p["c"]["version_range"]))),
        F.flatten(F.transform("parts", lambda p: F.transform(best, lambda a: edge("INSTALLED_ON", "Component", p["key"], "Asset", a["key"], _properties(derived_from=F.lit(INFERRED), confidence=a["confidence"]))))),
        F.transform(papers, lambda p: edge("RELATED_TO", "Vulnerability", v, "Paper", p["paper_id"], _properties(relation=p["relation"], confidence=p["confidence"], evidence_refs=_listed(p["evidence_refs"])))),
        F.transform(steps, lambda s: edge("EXPLOITS", "Vulnerability", v, "AttackTechnique", technique(s), _properties(order=s["order"], tactic=s["tactic"], stage=s["stage"], preconditions=_listed(s["preconditions"])))),
        F.transform(patches, lambda r: edge("FIXED_BY", "Vulnerability", v, "Patch", r["url"], _properties(tags=_listed(r["tags"]), source=r["source"]))),
    ]
    no_edges = F.array().cast(f"array<struct<relation:string,start_label:string,start_key:string,end_label:string,end_key:string,properties:{_MAP}>>")
    edges = rows.select("vuln_id", F.posexplode(F.concat(*(F.coalesce(k, no_edges) for k in links))).alias("nth", "e")).select("vuln_id", "nth", "e.*")
    ends = ["relation", "start_label", "start_key", "end_label", "end_key"]
    return nodes, edges.groupBy(*ends).agg(F.min_by("properties", F.struct("vuln_id", "nth")).alias("properties"))

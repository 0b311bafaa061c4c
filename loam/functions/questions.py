"""Questions: intent, filters, entities and route plans by rules; facts that evidence holds and lacks."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cve_ids

#: Words that tell an intent, in order of priority.
INTENTS = {
    "remediation": ["修复建议", "如何修复", "怎么修", "补丁", "缓解", "处置", "升级到", "remediat", "patch", "mitigat", "workaround", "fix"],
    "attack_chain": ["攻击链", "攻击路径", "利用链", "利用步骤", "如何利用", "横向移动", "attack chain", "kill chain", "exploit chain"],
    "asset_lookup": ["资产", "哪些系统", "哪些设备", "安装在", "装了", "影响面", "asset", "installed", "inventory", "affected systems"],
    "vuln_lookup": ["漏洞", "影响版本", "严重", "cvss", "cve-", "vulnerab", "severity", "risk score"],
}
#: Words of severities, from low to high, of time ranges, of known exploitation, and names of sources.
SEVERITY_WORDS = {"NONE": ["无风险", "none"], "LOW": ["低危", "low"], "MEDIUM": ["中危", "中风险", "medium"], "HIGH": ["高危", "高风", "high"], "CRITICAL": ["严重", "极危", "critical", "9.0 以上"]}
TIME_WORDS = {
    "recent_7d": ["最近7天", "近7天", "最近一周", "近一周", "本周", "last 7 days"], "recent_30d": ["最近30天", "近30天", "最近一个月", "近一个月", "近一月", "last 30 days"],
    "recent_90d": ["最近90天", "近90天", "最近三个月", "近三个月", "近三月"], "year": ["今年", "近一年", "最近一年", "近12个月", "last year"],
}
KEV_WORDS = ["kev", "已知被利用", "在野", "已被利用", "exploited in the wild"]
SOURCES = ["nvd", "osv", "ghsa", "kev", "epss", "arxiv", "openalex"]
#: Retrieval routes by intent.
PLANS = {
    "vuln_lookup": ["vector", "fulltext", "graph"], "asset_lookup": ["graph", "multi_hop", "fulltext"], "attack_chain": ["graph", "multi_hop", "vector"],
    "remediation": ["vector", "fulltext", "graph"], "general": ["vector", "fulltext", "graph", "multi_hop"],
}
#: Facts in order, those that an intent needs, words that ask for them, and words that show them.
FACTS = ["fixed_version", "vendor_advisory", "affected_components", "affected_versions", "attack_techniques", "kev", "epss"]
NEEDED = {"remediation": ["fixed_version", "vendor_advisory"], "asset_lookup": ["affected_components", "affected_versions"], "attack_chain": ["attack_techniques"]}
ASKED = [
    (["修复", "升级", "补丁", "缓解", "处置", "fixed", "fix version", "upgrade", "patch", "mitigat", "remediat"], ["fixed_version", "vendor_advisory"]),
    (["资产", "哪些系统", "哪些设备", "影响面", "受影响", "installed", "asset", "affected system", "inventory"], ["affected_components", "affected_versions"]),
    (["攻击链", "攻击路径", "利用链", "利用步骤", "横向移动", "attack chain", "kill chain", "exploit chain"], ["attack_techniques"]),
    (["在野", "被利用", "是否已被", "kev", "epss", "exploited in the wild", "in the wild", "actively exploited"], ["kev", "epss"]),
]
MARKERS = {
    "fixed_version": ["修复版本", "已修复", "修复于", "升级到", "升级至", "fixed version", "fixed in", "fixed by", "firstpatchedversion", "patched in", "upgrade to"],
    "vendor_advisory": ["官方补丁", "厂商公告", "安全公告", "补丁链接", "vendor advisory", "security advisory", "security bulletin", "advisory"],
    "affected_components": ["受影响组件", "受影响资产", "组件:", "组件：", "component"],
    "affected_versions": ["受影响版本", "影响版本", "affected version", "vulnerableversionrange", "affected:"],
    "attack_techniques": ["攻击技术", "attack technique", "att&ck", "mitre"],
    "kev": ["cisa kev", "known exploited", "在野利用", "已知被利用"],
    "epss": ["epss"],
}
TECHNIQUE = r"\bT\d{4}(?:\.\d{3})?\b"
VENDOR = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b"
COMPONENT = r"[a-z0-9][a-z0-9._-]{1,40}:[a-z0-9][a-z0-9._-]{1,40}"


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether any word is part of the text, whatever its case and blanks."""
    low = F.lower(c)
    bare = F.replace(low, F.lit(" "), F.lit(""))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w.lower())) | F.contains(bare, F.lit(w.lower().replace(" ", ""))) for w in words))


def _chosen(pairs: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in pairs)), lambda x: x.isNotNull())


def intent(c: Column) -> Column:
    out = F
    for name, words in INTENTS.items():
        out = out.when(contains_any(c, words), name)
    return out.otherwise("general")


def time_range(c: Column) -> Column:
    out = F
    for name, words in TIME_WORDS.items():
        out = out.when(contains_any(c, words), name)
    return out.otherwise("all")


def severities(c: Column) -> Column:
    return _chosen([(contains_any(c, words), name) for name, words in SEVERITY_WORDS.items()])


def sources(c: Column) -> Column:
    return _chosen([(F.contains(F.lower(c), F.lit(s)), s) for s in SOURCES])


def kev_only(c: Column) -> Column:
    return contains_any(c, KEV_WORDS)


def techniques(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(TECHNIQUE), F.lit(0)))


def vendors(c: Column, most: int = 10) -> Column:
    """Runs of two to four capitalised words."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(VENDOR), F.lit(0))), 1, most)


def plan(intent_of: Column, ids: Column | None = None) -> Column:
    """The routes of an intent; one definite id makes the full text needless."""
    table = F.create_map(*(x for k, routes in PLANS.items() for x in (F.lit(k), F.array(*map(F.lit, routes)))))
    routes = F.coalesce(F.try_element_at(table, intent_of), F.array(*map(F.lit, PLANS["general"])))
    return routes if ids is None else F.when(F.size(F.array_distinct(ids)) == 1, F.array_remove(routes, "fulltext")).otherwise(routes)


def collections(c: Column, intent_of: Column) -> Column:
    """Vector collections: the remediation one joins on that intent or its words."""
    return F.when((intent_of == "remediation") | contains_any(c, INTENTS["remediation"]), F.array(F.lit("vulns"), F.lit("remediation"))).otherwise(F.array(F.lit("vulns")))


def rule_confidence(c: Column) -> Column:
    """Hundredths: 30 and 20 for an id, ten each for techniques, vendors, an intent and a filter; 85 at most."""
    on = lambda x, n: F.when(x, n).otherwise(0)
    filtered = (time_range(c) != "all") | (F.size(severities(c)) > 0) | (F.size(sources(c)) > 0) | kev_only(c)
    return F.least(F.lit(85), 30 + on(F.size(cve_ids(c)) > 0, 20) + on(F.size(techniques(c)) > 0, 10) + on(F.size(vendors(c)) > 0, 10) + on(intent(c) != "general", 10) + on(filtered, 10))


def needed_facts(c: Column, intent_of: Column) -> Column:
    """Facts that the intent or the words of a question ask for, in order."""
    def asked(fact: str) -> Column:
        by_intent = [k for k, facts in NEEDED.items() if fact in facts]
        by_words = [w for words, facts in ASKED if fact in facts for w in words]
        return (intent_of.isin(*by_intent) if by_intent else F.lit(False)) | contains_any(c, by_words)
    return _chosen([(asked(f), f) for f in FACTS])


def facts_in_text(c: Column) -> Column:
    """Facts that a text shows: by marker words, or a vendor:product token or technique outside links."""
    low = F.lower(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(low, r"https?://\S+", " ")
    marked = lambda f: reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in MARKERS[f]))
    extra = {"affected_components": F.regexp_like(bare, F.lit(COMPONENT)), "attack_techniques": F.regexp_like(bare, F.lit(r"\bT\d{4}(?:\.\d{3})?\b"))}
    return _chosen([(marked(f) | extra[f] if f in extra else marked(f), f) for f in FACTS])


def enough(required: Column, present: Column, n_evidence: Column, n_entities: Column) -> Column:
    """No needed fact is missing; where none is needed, there is evidence or nothing to look for."""
    return F.when(F.size(required) > 0, F.size(F.array_except(required, present)) == 0).otherwise((n_evidence > 0) | (n_entities == 0))


def answer_confidence(n_cited: Column, n_claims: Column, degraded: Column, partial: Column) -> Column:
    """Ten-thousandths: half and half the share of cited claims, six tenths of that each for a degraded and a partial answer; 0 without citations."""
    ratio = F.coalesce(F.try_divide(n_cited, n_claims), F.lit(0.0))
    whole = (0.5 + 0.5 * F.least(F.lit(1.0), ratio)) * F.when(degraded, 0.6).otherwise(1.0) * F.when(partial, 0.6).otherwise(1.0)
    return F.when(n_cited > 0, F.floor(whole * 10000 + 0.5)).otherwise(0).cast("long")

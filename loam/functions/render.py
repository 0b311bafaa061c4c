"""Texts and flat metadata for indexes, remediation templates, and metric lines."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS, MOST_LINKS, MOST_MITIGATIONS = 4000, 5, 5
#: Tags of patches and advisories, and marks of their links.
PATCH_TAGS = ["advisory", "fix", "mitigation", "patch", "release", "release notes", "vendor advisory"]
PATCH_MARKS = "patch|advisory|security"


def clip(c: Column, most: int = MOST_CHARS) -> Column:
    return F.substring(c, 1, most)


def vuln_text(vuln_id: Column, title: Column, weaknesses: Column, severity: Column, affected: Column, kev: Column, description: Column) -> Column:
    """Header, facts between bars and description, each on a line of its own where there is one."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    some = lambda label, c, sep: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, sep)))
    facts = F.concat_ws(" | ", some("CWE: ", weaknesses, ", "), F.concat(F.lit("Severity: "), blank(severity)), some("Affected: ", affected, "; "), F.when(kev, F.lit("CISA KEV: exploited in the wild")))
    return clip(F.concat_ws("\n", blank(F.concat_ws(" ", vuln_id, blank(title))), blank(facts), blank(description)))


def labelled(lines: list[tuple[str, Column]]) -> Column:
    """A line for each label that has a text, cut at MOST_CHARS."""
    return clip(F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), F.nullif(F.trim(c), F.lit(""))) for label, c in lines)))


def index_metadata(vuln_id: Column, sources: Column, published: Column, severity: Column, kev: Column) -> Column:
    """Map of flat texts; a missing value has no key."""
    entries = F.create_map(F.lit("cve_id"), vuln_id, F.lit("source"), F.when(F.size(sources) > 0, F.array_join(F.array_sort(sources), ",")), F.lit("published_at"), iso(published), F.lit("severity"), F.nullif(severity, F.lit("")), F.lit("kev"), F.when(kev, F.lit("true")))
    return F.map_filter(entries, lambda k, v: v.isNotNull())


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def flat_text(m: Column) -> Column:
    """key=value of a map, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def patch_links(references: Column, most: int = MOST_LINKS) -> Column:
    """Links with a patch tag; only if there is none, those whose words look like it. references: array of (url, tags)."""
    tagged = F.filter(references, lambda r: F.exists(r["tags"], lambda t: F.lower(F.trim(t)).isin(*PATCH_TAGS)))
    looks = F.filter(references, lambda r: F.regexp_like(F.lower(r["url"]), F.lit(PATCH_MARKS)))
    chosen = F.when(F.size(tagged) > 0, tagged).otherwise(looks)
    return F.slice(F.array_distinct(F.transform(chosen, lambda r: r["url"])), 1, most)


def mitigations(products: Column, kev: Column, most: int = MOST_MITIGATIONS) -> Column:
    """The offline template: an upgrade for each of the first two products by name, a note on known exploitation, and one on exposure."""
    upgrades = F.transform(F.slice(F.array_sort(F.array_distinct(products)), 1, 2), lambda p: F.concat(F.lit("Upgrade "), p, F.lit(" to the fixed release")))
    none = F.expr("cast(array() as array<string>)")
    return F.slice(F.concat(upgrades, F.when(kev, F.array(F.lit("Known to be exploited: patch first or take the exposed part offline"))).otherwise(none), F.array(F.lit("Limit network exposure to trusted peers"))), 1, most)


def allowed_links(links: Column, references: Column) -> Column:
    """Links that are among the references, in their order."""
    return F.filter(links, lambda u: F.array_contains(references, u))


def prometheus_line(name: Column, labels: Column, value: Column) -> Column:
    """name{k="v",...} value, labels (a map) by key."""
    inside = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return F.concat(name, F.when(inside != "", F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(""), F.lit(" "), value.cast("string"))

"""Affected products: CPE names, version ranges, packages and their ecosystems."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ecosystem names of one feed and those that all others use.
ECOSYSTEMS = {
    "PIP": "PyPI", "PYPI": "PyPI", "NPM": "npm", "RUBYGEMS": "RubyGems", "GO": "Go", "MAVEN": "Maven", "NUGET": "NuGet", "COMPOSER": "Packagist", "CARGO": "crates.io", "RUST": "crates.io",
}
MATCH = "struct<vendor:string,product:string,version_start_incl:string,version_start_excl:string,version_end_incl:string,version_end_excl:string>"


def parse_cpe(criteria: Column, end_excl: Column | None = None) -> Column:
    """A CPE 2.3 name as (vendor, product, versions): an exact version is a closed range, else only the given first fixed version counts. Null without a definite vendor and product."""
    part = F.split(F.trim(criteria), ":")
    at = lambda i: F.get(part, F.lit(i))
    definite = lambda c: c.isNotNull() & ~c.isin("", "*")
    exact = F.when(definite(at(5)) & (at(5) != "-"), at(5))
    none = F.lit(None).cast("string")
    fixed = none if end_excl is None else end_excl
    made = F.struct(at(3).alias("vendor"), at(4).alias("product"), exact.alias("version_start_incl"), none.alias("version_start_excl"), exact.alias("version_end_incl"), F.when(exact.isNull(), fixed).alias("version_end_excl"))
    return F.when((at(0) == "cpe") & (at(1) == "2.3") & at(2).isin("a", "h", "o") & definite(at(3)) & definite(at(4)), made)


def distinct_by(items: Column, kind: str, *keys: str) -> Column:
    """The first element of each key, in order."""
    same = lambda x, y: F.lit(True) if not keys else _all(x[k].eqNullSafe(y[k]) for k in keys)
    return F.aggregate(items, F.expr(f"cast(array() as array<{kind}>)"), lambda acc, x: F.when(F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def cpe_matches(payload: Column, get: Callable[[Column, str], Column] = F.get_json_object) -> Column:
    """The matches of a payload's configurations, the last node first, one for each vendor, product and first fixed version; those marked as not vulnerable go."""
    nodes = "array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string,versionEndExcluding:string>>>>>>"
    config = F.from_json(F.coalesce(get(payload, "$.cve.configurations"), get(payload, "$.configurations")), nodes)
    every = F.flatten(F.reverse(F.flatten(F.transform(config, lambda c: F.transform(c["nodes"], lambda n: n["cpeMatch"])))))
    parsed = F.transform(F.filter(every, lambda m: F.coalesce(m["vulnerable"], F.lit(True))), lambda m: parse_cpe(m["criteria"], m["versionEndExcluding"]).cast(MATCH))
    return F.coalesce(distinct_by(F.filter(parsed, lambda m: m.isNotNull()), MATCH, "vendor", "product", "version_end_excl"), F.expr(f"cast(array() as array<{MATCH}>)"))


def version_range(m: Column) -> Column:
    """==v, >=a, <b, or * where both ends are open."""
    exact = (m["version_start_incl"] == m["version_end_incl"]) & m["version_end_excl"].isNull()
    low = F.coalesce(F.concat(F.lit(">="), m["version_start_incl"]), F.concat(F.lit(">"), m["version_start_excl"]))
    high = F.coalesce(F.concat(F.lit("<"), m["version_end_excl"]), F.concat(F.lit("<="), m["version_end_incl"]))
    return F.when(F.coalesce(exact, F.lit(False)), F.concat(F.lit("=="), m["version_start_incl"])).when(F.coalesce(low, high).isNull(), F.lit("*")).otherwise(F.concat_ws(", ", low, high))


def affected_versions(matches: Column) -> Column:
    return F.array_distinct(F.transform(matches, lambda m: F.concat(m["vendor"], F.lit(":"), m["product"], F.lit(" "), version_range(m))))


def ecosystem(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in ECOSYSTEMS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(c))), F.trim(c))


def packages(payload: Column, get: Callable[[Column, str], Column] = F.get_json_object) -> Column:
    """Ecosystem:name of all packages that a payload lists, in either of two shapes, once each."""
    affected = F.from_json(get(payload, "$.affected"), "array<struct<package:struct<ecosystem:string,name:string>>>")
    nodes = F.from_json(get(payload, "$.vulnerabilities.nodes"), "array<struct<package:struct<ecosystem:string,name:string>>>")
    none = F.expr("cast(array() as array<struct<package:struct<ecosystem:string,name:string>>>)")
    every = F.filter(F.concat(F.coalesce(affected, none), F.coalesce(nodes, none)), lambda x: F.trim(F.coalesce(x["package"]["name"], F.lit(""))) != "")
    name = lambda p: F.concat_ws(":", F.nullif(ecosystem(p["ecosystem"]), F.lit("")), F.trim(p["name"]))
    return F.array_distinct(F.transform(every, lambda x: name(x["package"])))


def version_key(v: Column) -> Column:
    """Dotted numbers as an array that compares as versions do; anything else is [0]."""
    parts = F.transform(F.split(F.trim(v), "\\."), lambda x: F.when(F.regexp_like(x, F.lit("^[0-9]{1,18}$")), x).cast("long"))
    return F.when(v.isNull() | F.exists(parts, lambda x: x.isNull()), F.array(F.lit(0).cast("long"))).otherwise(parts)


def osv_bounds(payload: Column) -> Column:
    """Texts of the introduced, last affected and fixed versions of a payload's ranges, in order, once each."""
    kind = "array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
    ranges = F.from_json(F.get_json_object(payload, "$.affected"), kind)
    events = F.flatten(F.flatten(F.transform(ranges, lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    # a version has a digit and no blank
    good = lambda c: F.when(F.regexp_like(c, F.lit(r"^[0-9A-Za-z][0-9A-Za-z.+_-]*$")) & F.regexp_like(c, F.lit("[0-9]")), c)
    said = F.transform(events, lambda e: F.filter(F.array(F.concat(F.lit(">="), good(e["introduced"])), F.concat(F.lit("<="), good(e["last_affected"])), F.concat(F.lit("<"), good(e["fixed"]))), lambda x: x.isNotNull()))
    return F.coalesce(F.array_distinct(F.flatten(said)), F.expr("cast(array() as array<string>)"))


def osv_intervals(payload: Column) -> Column:
    """(low, high, high_in) as texts of each affected interval of a payload's ranges: from an introduced version to the fixed one (not in it) or last affected one (in it) that comes next, or without an end; introduced 0 is an open beginning."""
    kind = "array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
    ranges = F.flatten(F.transform(F.from_json(F.get_json_object(payload, "$.affected"), kind), lambda a: a["ranges"]))

    def of_range(r: Column) -> Column:
        events = r["events"]
        at = F.filter(F.transform(events, lambda e, i: F.struct(e["introduced"].alias("low"), F.get(events, i + 1).alias("next"))), lambda x: x["low"].isNotNull())
        return F.transform(at, lambda x: F.struct(F.when(F.trim(x["low"]) != "0", F.trim(x["low"])).alias("low"), F.trim(F.coalesce(x["next"]["fixed"], x["next"]["last_affected"])).alias("high"), x["next"]["fixed"].isNull().alias("high_in")))
    return F.coalesce(F.flatten(F.transform(ranges, of_range)), F.expr("cast(array() as array<struct<low:string,high:string,high_in:boolean>>)"))


def component_matches(needle: Column, matches: Column, names: Column) -> Column:
    """Whether a needle is part of a product, a vendor or a package name."""
    low = F.lower(F.trim(needle))
    return (low != "") & (F.exists(matches, lambda m: F.contains(F.lower(m["product"]), low) | F.contains(F.lower(m["vendor"]), low)) | F.exists(names, lambda n: F.contains(F.lower(n), low)))


def vendor_consistent(vendor: Column, others: Column) -> Column:
    """Equal or part of one another, whatever the case; without others every vendor fits."""
    low = F.lower(F.trim(vendor))
    one = lambda o: F.contains(low, o) | F.contains(o, low)
    return (F.size(others) == 0) | (low == "") | F.exists(F.transform(others, lambda o: F.lower(F.trim(o))), one)

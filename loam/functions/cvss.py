"""CVSS vectors, scores and severities, by the public FIRST formulas."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the CVSS 3.x standard.
V3 = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27}, "PR_CHANGED": {"N": 0.85, "L": 0.68, "H": 0.5}, "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
}
#: Fixed values of the CVSS 2.0 standard.
V2 = {"AV": {"L": 0.395, "A": 0.646, "N": 1.0}, "AC": {"H": 0.35, "M": 0.61, "L": 0.71}, "AU": {"M": 0.45, "S": 0.56, "N": 0.704}, "CIA": {"N": 0.0, "P": 0.275, "C": 0.66}}
SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


NAMES = ["AV", "AC", "PR", "UI", "S", "C", "I", "A", "AU"]
#: The metric lists of a payload, from the newest version on.
METRICS = ["cvssMetricV40", "cvssMetricV4", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2"]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def metric(vector: Column, name: str) -> Column:
    """The last value of a metric; null where it is missing or no single word."""
    return F.nullif(F.regexp_extract(F.upper(vector), f".*(?:^|/){name}:([A-Z]+)(?:/|$)", 1), F.lit(""))


def prefix(vector: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(vector), r"^CVSS:([0-9.]+)", 1), F.lit(""))


def metrics(vector: Column) -> Column:
    """Struct of the base metrics of either version."""
    return F.struct(*(metric(vector, m).alias(m) for m in NAMES))


def _number(value: Column, numbers: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in numbers.items() for x in kv)), value)


def version(vector: Column) -> Column:
    v3 = lambda m: reduce(lambda a, b: a & b, (m[x].isNotNull() for x in ("AV", "AC", "PR", "UI", "S")))
    return let(F.struct(prefix(vector).alias("prefix"), *(metric(vector, m).alias(m) for m in NAMES)), lambda m: F.when(m["prefix"].isin("3.0", "3.1", "4.0"), m["prefix"]).when(m["AU"].isNotNull(), F.lit("2.0")).when(v3(m), F.lit("3.1")))


def roundup(x: Column) -> Column:
    """Least tenth that isn't below x, by scaled integers."""
    scaled = F.rint(x * 100000).cast("long")
    return F.when(scaled % 10000 == 0, scaled / 100000.0).otherwise((F.floor(scaled / 10000) + 1) / 10.0)


def score_v3(vector: Column) -> Column:
    """Base score of a 3.x vector; null where a metric is missing or wrong."""
    def numbers(m: Column) -> Column:
        pr = F.when(m["S"] == "C", _number(m["PR"], V3["PR_CHANGED"])).otherwise(_number(m["PR"], V3["PR"]))
        isc = 1 - reduce(lambda a, b: a * b, (1 - _number(m[x], V3["CIA"]) for x in "CIA"))
        ease = 8.22 * _number(m["AV"], V3["AV"]) * _number(m["AC"], V3["AC"]) * pr * _number(m["UI"], V3["UI"])
        return F.struct(m["S"].alias("s"), isc.alias("isc"), ease.alias("ease"))

    def impact(n: Column) -> Column:
        changed = 7.52 * (n["isc"] - 0.029) - 3.25 * F.pow(n["isc"] - 0.02, 15)
        return F.struct(n["s"].alias("s"), n["ease"].alias("ease"), F.when(n["s"] == "C", changed).when(n["s"] == "U", 6.42 * n["isc"]).alias("impact"))

    def base(n: Column) -> Column:
        both = n["impact"] + n["ease"]
        return F.when(both.isNull(), F.lit(None)).when(n["impact"] <= 0, 0.0).otherwise(roundup(F.least(F.when(n["s"] == "C", 1.08 * both).otherwise(both), F.lit(10.0))))

    return let(metrics(vector), lambda m: let(numbers(m), lambda n: let(impact(n), base)))


def score_v2(vector: Column) -> Column:
    """Base score of a 2.0 vector; null where a metric is missing or wrong."""
    def base(m: Column) -> Column:
        impact = 10.41 * (1 - reduce(lambda a, b: a * b, (1 - _number(m[x], V2["CIA"]) for x in "CIA")))
        ease = 20 * _number(m["AV"], V2["AV"]) * _number(m["AC"], V2["AC"]) * _number(m["AU"], V2["AU"])
        return let(impact, lambda i: F.floor((0.6 * i + 0.4 * ease - 1.5) * F.when(i == 0, 0.0).otherwise(1.176) * 10 + 0.5) / 10.0)
    return let(metrics(vector), base)


def severity(ver: Column, score: Column) -> Column:
    v2 = F.when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score.isNotNull(), "LOW")
    v3 = F.when(score == 0, "NONE").when(score < 4, "LOW").when(score < 7, "MEDIUM").when(score < 9, "HIGH").when(score.isNotNull(), "CRITICAL")
    return F.when(ver == "2.0", v2).otherwise(v3)


def rank(sev: Column) -> Column:
    return reduce(lambda acc, i: acc.when(F.upper(sev) == SEVERITIES[i], i), range(1, 5), F.when(F.upper(sev) == "NONE", 0))


def set_severity(vectors: Column) -> Column:
    """Severity of the vector with the highest (base_score, version)."""
    return F.array_max(F.transform(vectors, lambda v: F.struct(v["base_score"], v["version"], v["severity"])))["severity"]


def merge_severity(severities: Column) -> Column:
    """The highest of declared severities by rank."""
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.array_max(F.transform(severities, rank)) + 1)


VECTOR = "struct<version:string,vector:string,base_score:double,severity:string>"


def parse(vector: Column, given: Column | None = None) -> Column:
    """(version, vector, base_score, severity) of a vector: the given score, else the computed one, to one place; null where there is neither or no version fits. Version 4 needs a given score."""
    given = F.lit(None).cast("double") if given is None else given.cast("double")
    text = F.upper(F.trim(vector))

    def with_version(x: Column) -> Column:
        computed = F.when(x["v"] == "2.0", score_v2(x["t"])).when(x["v"].isin("3.0", "3.1"), score_v3(x["t"]))
        score = F.floor(F.coalesce(x["g"], computed) * 10 + 0.5) / 10.0
        return let(F.struct(x["v"].alias("version"), x["t"].alias("vector"), score.alias("base_score")), lambda y: F.when(y["version"].isNotNull() & y["base_score"].isNotNull(), F.struct(y["version"].alias("version"), y["vector"].alias("vector"), y["base_score"].alias("base_score"), severity(y["version"], y["base_score"]).alias("severity"))))

    return let(F.struct(version(text).alias("v"), text.alias("t"), given.alias("g")), with_version)


def collect(payload: Column, get: Callable[[Column, str], Column] = F.get_json_object) -> Column:
    """All vectors of a payload: its metric lists from the newest version on, a single cvss object (whose score 0 counts as none), and a list of severities; distinct, by version. Broken ones go."""
    metric_list = "array<struct<cvssData:struct<vectorString:string,baseScore:double>>>"
    pair = lambda vector, given: F.struct(vector.alias("v"), given.cast("double").alias("g"))
    no_pairs = F.expr("cast(array() as array<struct<v:string,g:double>>)")
    parts = []
    for key in METRICS:
        rows = F.from_json(F.coalesce(get(payload, f"$.cve.metrics.{key}"), get(payload, f"$.metrics.{key}")), metric_list)
        parts.append(F.transform(rows, lambda x: pair(x["cvssData"]["vectorString"], x["cvssData"]["baseScore"])))
    single = get(payload, "$.cvss.vectorString")
    parts.append(F.when(single.isNotNull(), F.array(pair(single, F.nullif(get(payload, "$.cvss.score").cast("double"), F.lit(0.0))))))
    listed = F.from_json(get(payload, "$.severity"), "array<struct<type:string,score:string>>")
    parts.append(F.transform(listed, lambda x: pair(x["score"], F.lit(None))))
    none = F.expr(f"cast(array() as array<{VECTOR}>)")
    every = F.filter(F.transform(F.flatten(F.array(*(F.coalesce(x, no_pairs) for x in parts))), lambda x: parse(x["v"], x["g"])), lambda x: x.isNotNull())
    once = F.aggregate(every, none, lambda acc, x: F.when(F.exists(acc, lambda y: (y["version"] == x["version"]) & (y["vector"] == x["vector"])), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_sort(once, lambda a, b: F.when(a["version"] < b["version"], -1).when(a["version"] > b["version"], 1).otherwise(0))


def inconsistent(vectors: Column) -> Column:
    """Whether a vector's score is more than a tenth from what its metrics give, or can't be computed; version 4 isn't looked at."""
    def off(x: Column) -> Column:
        computed = F.when(x["version"] == "2.0", score_v2(x["vector"])).otherwise(score_v3(x["vector"]))
        return (x["version"] != "4.0") & let(computed, lambda c: c.isNull() | (F.rint(F.abs(c - x["base_score"]) * 100) > 10))
    return F.exists(vectors, off)


def severity_differs(declared: Column, vectors: Column) -> Column:
    """Whether a declared severity isn't the highest of the vectors'."""
    return F.when((F.size(vectors) == 0) | declared.isNull(), False).otherwise(F.upper(declared) != merge_severity(F.transform(vectors, lambda v: v["severity"])))


def needs_inference(vectors: Column, description: Column) -> Column:
    return (F.size(vectors) == 0) & (F.trim(F.coalesce(description, F.lit(""))) != "")

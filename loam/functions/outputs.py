"""Outputs of models as JSON texts: strict checks on parsed variants, and repair by dropping what can't be trusted."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEEDS_HUMAN = "needs_human"


@dataclass(frozen=True)
class Field:
    """A field of a strict object: its kind (text, number, texts or any), whether it must be there, the bounds of a number, the least length of a text, and the values that a text may have."""

    name: str
    kind: str = "text"
    required: bool = False
    low: float | None = None
    high: float | None = None
    least: int = 0
    among: tuple[str, ...] = ()


#: What a remediation and the whole output of an enrichment consist of.
REMEDIATION = [Field("summary", required=True, least=1), Field("fixed_versions", "texts"), Field("mitigations", "texts"), Field("patch_urls", "texts"), Field("confidence", "number", low=0, high=1), Field("evidence_refs", "texts")]
STATUS = Field("review_status", among=("auto_pass", "revised", NEEDS_HUMAN, "permanently_failed"))
CONFIDENCE = Field("confidence", "number", True, 0, 1)
OUTPUT = [Field("schema_version"), Field("vuln_id", required=True, least=1), Field("errors", "texts"), Field("remediation", "any"), Field("remediation_json", "any")]


def _kind(v: Column) -> Column:
    return F.when(F.is_variant_null(v), F.lit("VOID")).otherwise(F.schema_of_variant(v))


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def text_at(v: Column, name: str) -> Column:
    """A field as text: null where there is none or it isn't a text."""
    x = _at(v, name)
    return F.when(_kind(x) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def violations(v: Column, fields: list[Field], others: list[str] | None = None) -> Column:
    """What is wrong with a variant that should be an object of these fields, and of `others` without a check: name and fault of each, sorted. Numbers may be written as texts."""
    found = []
    for f in fields:
        x = _at(v, f.name)
        kind, there = _kind(x), x.isNotNull() & ~F.coalesce(F.is_variant_null(x), F.lit(False))
        fault = F.when(~there, F.lit("missing") if f.required else F.lit(None).cast("string"))
        if f.kind == "text":
            s = F.try_variant_get(v, f"$.{f.name}", "string")
            fault = fault.when(kind != "STRING", "kind").when(F.length(s) < f.least, "short")
            if f.among:
                fault = fault.when(~s.isin(*f.among), "value")
        elif f.kind == "number":
            n = F.try_variant_get(v, f"$.{f.name}", "double")
            fault = fault.when(n.isNull() | F.isnan(n), "kind")
            for bad in [n < f.low] * (f.low is not None) + [n > f.high] * (f.high is not None):
                fault = fault.when(bad, "range")
        elif f.kind == "texts":
            fault = fault.when(~kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), "kind")
        found.append(F.concat(F.lit(f"{f.name}: "), fault))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    known = F.array(*map(F.lit, [*(f.name for f in fields), *(others or [])]))
    unknown = F.transform(F.array_except(keys, known), lambda k: F.concat(k, F.lit(": unknown")))
    whole = F.array_sort(F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), unknown))
    return F.when(v.isNull(), F.array(F.lit("not JSON"))).when(keys.isNull(), F.array(F.lit("no object"))).otherwise(whole)


def repaired_outputs(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """Outputs as they can be used, and those that can't be used at all.

    A text that is valid stays as it is. Else its remediation goes; if that isn't enough, its status becomes needs_human and its confidence 0; if it still isn't valid, the same and it is degraded. Nothing is made up.
    The first frame has the other columns of df, vuln_id, review_status, confidence, remediation (a text of JSON), attempts (of three, the one that was valid, 4 if degraded) and notes, what was wrong at each failed one.
    The second has the rows that are no JSON object or name no vuln_id, with notes."""
    rows = df.withColumn("_v", F.try_parse_json(F.trim(raw)))
    v = F.col("_v")
    names = [f.name for f in (STATUS, CONFIDENCE)]
    # a snapshot is a text of JSON, the remediation itself an object
    snapshot = F.try_parse_json(text_at(v, "remediation_json"))
    there = lambda c: _at(v, c).isNotNull() & ~F.coalesce(F.is_variant_null(_at(v, c)), F.lit(False))
    named = lambda prefix, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{prefix}."), x))
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumns({"_rest": violations(v, OUTPUT, names), "_judged": F.when(v.isNotNull(), violations(v, [STATUS, CONFIDENCE], [f.name for f in OUTPUT])).otherwise(none),
                             "_advice": F.concat(F.when(there("remediation"), named("remediation", violations(_at(v, "remediation"), REMEDIATION))).otherwise(none), F.when(there("remediation_json"), named("remediation_json", violations(snapshot, REMEDIATION))).otherwise(none))})
    # unknown fields are told once
    rows = rows.withColumn("_judged", F.array_except("_judged", "_rest"))
    usable = text_at(v, "vuln_id").isNotNull() & (F.length(text_at(v, "vuln_id")) > 0)
    refused = rows.where(~F.coalesce(usable, F.lit(False))).select(*df.columns, F.col("_rest").alias("notes"))
    attempt = F.when((F.size("_rest") == 0) & (F.size("_judged") == 0), F.when(F.size("_advice") == 0, 1).otherwise(2)).when(F.size("_rest") == 0, 3).otherwise(4)
    whole = F.array_join(F.concat("_rest", "_judged", "_advice"), "; ")
    bare = F.array_join(F.concat("_rest", "_judged"), "; ")
    good = rows.where(usable).withColumn("attempts", attempt)
    notes = F.filter(F.array(F.when(F.col("attempts") > 1, whole), F.when(F.col("attempts") > 2, bare), F.when(F.col("attempts") > 3, F.array_join("_rest", "; "))), lambda x: x.isNotNull())
    kept = F.col("attempts") < 3
    return good.select(*df.columns, text_at(v, "vuln_id").alias("vuln_id"), F.when(kept, F.coalesce(text_at(v, "review_status"), F.lit("auto_pass"))).otherwise(NEEDS_HUMAN).alias("review_status"),
                       F.when(kept, F.try_variant_get(v, "$.confidence", "double")).otherwise(0.0).alias("confidence"), F.when((F.col("attempts") == 1) & there("remediation"), F.to_json(_at(v, "remediation"))).alias("remediation"),
                       "attempts", notes.alias("notes")), refused

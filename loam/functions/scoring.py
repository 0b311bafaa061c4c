"""Risk, trust and confidence scores."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two(x: Column) -> Column:
    """Hundredths, half up."""
    return F.floor(x * 100 + 0.5).cast("long")


def risk_score(cvss: Column, epss: Column, kev: Column, exploits: Column) -> Column:
    """Hundredths of 0 to 100: 45 severity, 25 exploit likelihood, 15 known exploited, 15 actionable exploits."""
    part = lambda weight, x: two(weight * F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    return F.least(F.lit(10000), part(45, cvss / 10) + part(25, epss) + F.when(kev, 1500).otherwise(0) + part(15, exploits / 2))


def risk_level(hundredths: Column) -> Column:
    return F.when(hundredths >= 8500, "critical").when(hundredths >= 7000, "high").when(hundredths >= 4000, "medium").otherwise("low")


def confidence(parts: list[tuple[float, Column]], conflicts: Column) -> Column:
    """Thousandths: weighted mean of the parts that are present, less a tenth for each conflict (0.4 at most)."""
    total = sum((F.when(c.isNotNull(), F.lit(w) * c).otherwise(0.0) for w, c in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for w, c in parts), F.lit(0.0))
    mean = F.when(weight > 0, total / weight).otherwise(0.0)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean - F.least(F.lit(0.4), 0.1 * conflicts))) * 1000 + 0.5).cast("long")


def evidence_score(base: Column, corroborated: Column, authority: Column, mismatch: Column, no_fact: Column) -> Column:
    """Ten-thousandths."""
    on = lambda c, x: F.when(c, x).otherwise(0.0)
    raw = 0.7 * base + on(corroborated, 0.2) + on(authority, 0.1) - on(mismatch, 0.25) - on(no_fact, 0.1)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * 10000 + 0.5).cast("long")


def trust_score(sources: Column, weights: dict[str, float], default: float = 0.5) -> Column:
    """Thousandths: mean weight over the listed sources, repeats included."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    total = F.aggregate(sources, F.lit(0.0), lambda acc, s: acc + F.coalesce(F.try_element_at(table, s), F.lit(default)))
    return F.when(F.size(sources) > 0, F.floor(total / F.size(sources) * 1000 + 0.5)).otherwise(0).cast("long")


def review_status(thousandths: Column, conflicts: Column, threshold: int = 700) -> Column:
    return F.when((thousandths >= threshold) & (conflicts == 0), "auto_pass").when(thousandths >= threshold, "revised").otherwise("needs_human")

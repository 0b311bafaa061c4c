"""Offline enrichment: paper keywords, exploit ranks, evidence from payloads, and the repair of outputs."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

MATURITY = ["none", "poc", "functional", "high"]
MOST_KEYWORDS, LONG_WORD = 6, 6


def _words(c: Column, least: int, stopwords: list[str]) -> Column:
    """Words of a text, once each, technical ones (with a digit, dot, hyphen or underscore) first."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9_.-]*"), F.lit(0)), lambda w: F.regexp_replace(F.lower(w), r"^[._-]+|[._-]+$", ""))
    good = F.array_except(F.array_distinct(F.filter(found, lambda w: F.length(w) >= least)), F.array(*map(F.lit, stopwords)))
    technical = lambda w: F.regexp_like(w, F.lit("[-_.0-9]"))
    return F.concat(F.filter(good, technical), F.filter(good, lambda w: ~technical(w)))


def paper_keywords(weaknesses: Column, components: Column, title: Column, description: Column, stopwords: list[str], most: int = MOST_KEYWORDS) -> Column:
    """Weaknesses, then the last part of component names, words of the title and long words of the description; without stop words and short ones."""
    every = F.concat(F.transform(weaknesses, lambda w: F.lower(F.trim(w))), F.transform(components, lambda c: F.lower(F.trim(F.element_at(F.split(c, ":"), -1)))), _words(title, 3, stopwords), _words(description, LONG_WORD, stopwords))
    kept = F.array_except(F.array_distinct(F.filter(every, lambda w: F.length(w) > 2)), F.array(*map(F.lit, stopwords)))
    return F.slice(kept, 1, most)


def paper_link(matched: Column, most: int = MOST_KEYWORDS, least: int = 400) -> Column:
    """Thousandths of confidence in a link by the share of keywords that matched, 600 at most; null below the least."""
    c = F.least(F.lit(600), F.floor((0.3 + 0.3 * F.least(F.lit(1.0), F.size(matched) / F.lit(float(most)))) * 1000 + 0.5)).cast("long")
    return F.when(c >= least, c)


def ranked_exploits(exploits: Column, trust: dict[str, float], default: float = 0.5) -> Column:
    """(source, url, maturity, reliability, verified) by maturity, verified, reliability, trust in the source, and url."""
    table = F.create_map(*(F.lit(x) for kv in trust.items() for x in kv))
    level = lambda e: -F.array_position(F.array(*map(F.lit, MATURITY)), e["maturity"])
    keyed = F.transform(exploits, lambda e: F.struct(level(e).alias("m"), F.when(e["verified"], 0).otherwise(1).alias("v"), (-e["reliability"]).alias("r"), (-F.coalesce(F.try_element_at(table, F.lower(F.trim(e["source"]))), F.lit(default))).alias("t"), e["url"].alias("u"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def poc_strength(n: Column) -> Column:
    """Hundredths: half for one actionable exploit, all for two."""
    return F.floor(F.least(F.lit(1.0), n / 2.0) * 100 + 0.5).cast("long")


def nvd_evidence(payload: Column, wanted: Column, most: int = 5) -> Column:
    """(kind, locator) from a lookup's payload: the entry itself, then links to patches and advisories; empty if the entry is about another id."""
    kind = "array<struct<url:string,tags:array<string>>>"
    cve = F.get_json_object(payload, "$.vulnerabilities[0].cve.id")
    links = F.coalesce(F.from_json(F.get_json_object(payload, "$.vulnerabilities[0].cve.references"), kind), F.expr(f"cast(array() as {kind})"))
    patches = F.filter(links, lambda r: F.exists(F.coalesce(r["tags"], F.array(F.lit(""))), lambda t: F.lower(t).isin("patch", "vendor advisory")))
    every = F.concat(F.array(F.struct(F.lit("entry").alias("kind"), cve.alias("locator"))), F.transform(patches, lambda r: F.struct(F.lit("link").alias("kind"), r["url"].alias("locator"))))
    return F.when(F.upper(F.trim(cve)) == F.upper(F.trim(wanted)), F.slice(every, 1, most)).otherwise(F.expr("cast(array() as array<struct<kind:string,locator:string>>)"))


def repaired(df: DataFrame, valid: Column, valid_without: Column) -> DataFrame:
    """Outputs that hold as they are; those that hold without their remediation lose it; all others are marked for a human with confidence 0."""
    step = F.when(valid, 0).when(valid_without, 1).otherwise(2)
    rows = df.withColumn("_step", step)
    return rows.withColumns({"remediation": F.when(F.col("_step") == 0, F.col("remediation")), "review_status": F.when(F.col("_step") == 2, "needs_human").otherwise(F.col("review_status")), "confidence": F.when(F.col("_step") == 2, 0).otherwise(F.col("confidence")), "degraded": F.col("_step") == 2}).drop("_step")


def bounded_loop(df: DataFrame, better: Callable[[DataFrame, int], DataFrame], confidence: str, least: float, rounds: int = 2) -> DataFrame:
    """Rows whose confidence is too low go through better(rows, round) again, `rounds` times at most; the others stay as they are."""
    done, rest = None, df
    for n in range(1, rounds + 1):
        good = rest.where(F.col(confidence) >= least)
        done = good if done is None else done.unionByName(good)
        rest = better(rest.where(F.coalesce(F.col(confidence) < least, F.lit(True))), n)
    return rest if done is None else done.unionByName(rest)


def fetched(df: DataFrame, key: str, fetch: Callable[[str], list[dict]], schema: str, error: str | None = None) -> DataFrame:
    """Rows that an injected function finds for each key, such as exploits, papers or assets: the only place that may leave the cluster. A key that fails gives no row, or with a name for a column of errors one that tells why;
    write such rows before both parts are taken, else everything is fetched twice."""
    schema = f"{schema}, {error} string" if error else schema
    names = [c.split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k in frame[key]:
                try:
                    rows += [{key: k, **r} for r in fetch(k)]
                except Exception as e:  # noqa: BLE001  whatever the source fails by, other keys go on
                    rows += [{key: k, error: f"{type(e).__name__}: {e}"}] if error else []
            yield pd.DataFrame(rows, columns=[key, *names])

    kind = dict(df.dtypes)[key]
    return df.select(key).distinct().mapInPandas(run, f"{key} {kind}, {schema}")


def cached(asked: DataFrame, cache: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Answers by key from a cache (key, value, hits) and from answer(rows) for the others; and the cache with its counts raised.
    Keys meet the cache in one join, whose rows are written, and so are new answers: both results are read from these tables, so nothing is joined or answered twice."""
    wanted = asked.groupBy(key).agg(F.count("*").alias("_n"))
    met = written(wanted.join(cache.select(key, "value", "hits", F.lit(True).alias("_known")), key, "full"), "met")
    known = met.where("_known")
    new = written(answer(met.where("_known is null").select(key)).select(key, "value"), "answered")
    hits = known.select(key, "value", (F.col("hits") + F.coalesce("_n", F.lit(0))).alias("hits"))
    return known.where("_n is not null").select(key, "value").unionByName(new), hits.unionByName(new.select(key, "value", F.lit(0).cast("long").alias("hits")))


def embedded(df: DataFrame, body: str, embed: Callable[[Column], Column] | None = None, fallback: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with an embedding by a pluggable expression (a pandas UDF around a model), or by hashed tokens where there is none."""
    from .hashing import hash_embedding

    return df.withColumn("embedding", (embed or fallback or hash_embedding)(F.col(body)))

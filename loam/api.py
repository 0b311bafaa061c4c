"""What the reference serves over HTTP, as functions from tables to DataFrames. Tables: facts and gold (vulnerabilities and their enrichment by vuln_id), nodes and edges, papers, documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import questions, times
from .operators import graph, kpi, listing, retrieve, stats


def vulnerabilities(facts: DataFrame, gold: DataFrame | None = None, severity: list[str] | None = None, source: list[str] | None = None, days: int | None = None, since: str | None = None, kev: bool | None = None, has_poc: bool | None = None,
                    q: str | None = None, limit: int = 20, offset: int = 0, now: str | None = None) -> DataFrame:
    """One page of facts in order of their timeline, with the total. since goes before days; limits are 1 to 100."""
    unknown = {s.upper() for s in listing.filter_values(severity)} - {"NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"}
    if unknown or not 1 <= limit <= 100:
        raise ValueError(f"no such severity or limit: {sorted(unknown)} {limit}")
    begin = F.lit(since).cast("timestamp") if since else None if days is None else F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    timeline = times.timeline(F.col("published_at"), F.col("normalized_at"))
    columns = {"severity": F.col("severity"), "sources": F.col("sources"), "timeline": timeline, "kev": F.col("kev"), "texts": F.array("vuln_id", "title", "description")}
    rows = facts.where(listing.criteria(severity=severity, source=source, since=begin, kev=kev, q=q, columns=columns))
    if has_poc is not None:
        rows = listing.having(rows, "vuln_id", gold.where(F.size("exploits") > 0), has_poc)
    return listing.page(rows, [F.desc(timeline), F.asc("vuln_id")], limit, offset)


def vulnerability(facts: DataFrame, gold: DataFrame, vuln_id: str) -> DataFrame:
    """One fact and what enrichment knows about it."""
    key = vuln_id.strip().upper()
    return facts.where(F.col("vuln_id") == key).join(gold, "vuln_id", "left")


def dashboard(facts: DataFrame, since: str, until: str) -> dict[str, DataFrame]:
    """Counts, distributions and the daily trend."""
    timeline = times.timeline(F.col("published_at"), F.col("normalized_at"))
    return {
        "kpi": kpi.bundle(facts, timeline, F.col("severity") == "CRITICAL", F.element_at("sources", 1)),
        "severity": stats.fixed_counts(facts, F.col("severity"), ["critical", "high", "medium", "low"]),
        "sources": stats.exploded_counts(facts, F.col("sources")),
        "trend": stats.daily(facts, timeline, since, until),
    }


def graph_overview(nodes: DataFrame, edges: DataFrame, most: int = 300) -> tuple[DataFrame, DataFrame]:
    return graph.overview(nodes, edges, "vulnerability", most)


def graph_of(nodes: DataFrame, edges: DataFrame, key: str, limit: int = 200) -> DataFrame:
    return graph.neighbourhood(key, edges, nodes, None, limit)


def data_quality(per_source: DataFrame, fields: list[str], declared: list[str]) -> DataFrame:
    return kpi.summary(per_source, fields, declared)


def paper(papers: DataFrame, paper_id: str) -> DataFrame:
    return listing.versioned(papers, "paper_id", paper_id)


def ask(spark: SparkSession, question: str, documents: DataFrame, key: str, body: str, k: int = 5) -> DataFrame:
    """(question, intent, plan, answer, citations) by rules and full text: the offline answer."""
    from .functions import text

    q = spark.range(1).select(F.lit(question).alias("question")).withColumn("intent", questions.intent(F.col("question")))
    words = spark.range(1).select(text.query_keywords(F.lit(question)).alias("w")).head().w  # one row
    found = retrieve.fulltext(documents, key, body, words, k) if words else documents.select(key, F.lit(0).alias("score")).limit(0)
    steps = retrieve.offline_steps(found.withColumns({"question": F.lit(question), "route": F.lit("fulltext")}), "question", "route", "score", key, k)
    answer = retrieve.offline_answer(steps, "question", "step", F.concat_ws(" ", F.col(key).cast("string"), F.col("score").cast("string")), F.col(key).cast("string"))
    return q.join(answer, "question", "left").withColumn("plan", F.array_join(questions.plan(F.col("intent")), ","))

"""Retrieval routes, rank fusion and evidence checks."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import written


def fulltext(df: DataFrame, key: str, body: str, query: list[str], k: int) -> DataFrame:
    """(key, score): the k texts that hold most keywords, scores in ten-thousandths."""
    return df.select(key, text.fulltext_score(F.col(body), query).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_top(df: DataFrame, key: str, vector: str, query: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(key, score): the k vectors with the highest cosine to the one row of query (its first column), scores clamped to 0..1, in ten-thousandths. Without a query there is no row."""
    rows = (df.where(where) if where is not None else df).select(key, vector)
    asked = query.limit(1).select(F.col(query.columns[0]).alias("_q"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col(vector), F.col("_q"))))
    return rows.crossJoin(F.broadcast(asked)).select(key, F.floor(score * 10000 + 0.5).cast("long").alias("score")).orderBy(F.desc("score"), key).limit(k)  # one row is broadcast


#: Rows of a route that count in a fusion: what is ranked in one task has this bound.
DEPTH = 1000


def best_of(route: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    return route.orderBy(F.desc("score"), key).limit(depth)


def rrf(routes: list[tuple[DataFrame, float]], key: str, k: int = 60, top: int = 10, depth: int = DEPTH) -> DataFrame:
    """Reciprocal rank fusion of routes (key, score), in millionths. A route counts to its first `depth` rows."""
    ranked = [best_of(df, key, depth).select(key, (F.lit(w) / (k + F.row_number().over(Window.orderBy(F.desc("score"), key)))).alias("part"), F.lit(i).alias("route")) for i, (df, w) in enumerate(routes)]
    both = reduce(DataFrame.unionByName, ranked)
    score = F.floor(F.sum(F.col("part").cast("decimal(20,12)")).cast("double") * 1000000 + 0.5).cast("long")
    return both.groupBy(key).agg(score.alias("rrf"), F.count("*").alias("routes")).orderBy(F.desc("rrf"), key).limit(top)


def boost(df: DataFrame, wanted: Column, by: int = 500000) -> DataFrame:
    """Rows that name a wanted entity gain half a point."""
    return df.withColumn("rrf", F.col("rrf") + F.when(wanted, by).otherwise(0))


def keyword_sum(df: DataFrame, key: str, body: str, words: list[str]) -> DataFrame:
    """(key, score): texts that hold all words, scored by how many distinct tokens each word is part of."""
    found = F.array_distinct(text.tokens(F.col(body)))
    holding = lambda w: F.size(F.filter(found, lambda t: F.contains(t, F.lit(w))))
    hits = [holding(w) for w in words]
    every = reduce(lambda a, b: a & b, (h > 0 for h in hits))
    return df.where(every).select(key, reduce(lambda a, b: a + b, hits).cast("long").alias("score"))


def evidence_gap(present: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), present)


def where(filters: dict) -> Column:
    """A predicate from {field: value}, {field: {"$in": [...]}}, {field: {"$gte": x}} and {"$and": [...]}; no filter is true."""
    parts = []
    for field, rule in filters.items():
        if field == "$and":
            parts += [where(x) for x in rule]
        elif isinstance(rule, dict):
            for op, value in rule.items():
                parts.append({"$in": lambda c, v: c.isin(*v), "$gte": lambda c, v: c >= F.lit(v)}[op](F.col(field), value))
        else:
            parts.append(F.col(field) == F.lit(rule))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def with_ids(filters: dict, field: str, ids: list[str]) -> dict:
    """The filters and one more on ids: equal to the only one, or one of many."""
    if not ids:
        return filters
    clause = {field: ids[0] if len(ids) == 1 else {"$in": ids}}
    return {"$and": [filters, clause]} if filters else clause


def vector_route(df: DataFrame, key: str, vector: str, collection: str, collections: list[str], query: DataFrame, k: int, filters: dict | None = None) -> DataFrame:
    """(key, collection, score): the k best of each collection, merged by score, then key."""
    rows = df.where(where(filters or {}) & F.col(collection).isin(*collections))
    asked = query.limit(1).select(F.col(query.columns[0]).alias("_q"))
    score = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col(vector), F.col("_q")))) * 10000 + 0.5).cast("long")
    scored = rows.select(key, collection, vector).crossJoin(F.broadcast(asked)).select(key, collection, score.alias("score"))  # one row is broadcast
    nth = F.row_number().over(Window.partitionBy(collection).orderBy(F.desc("score"), key))
    return scored.withColumn("_n", nth).where(F.col("_n") <= k).drop("_n").orderBy(F.desc("score"), key)


def entity_key(cve: Column, paper: Column, doc: Column) -> Column:
    """What a result is about: a vulnerability, else a paper, else the document itself."""
    return F.coalesce(F.concat(F.lit("cve:"), F.upper(cve)), F.concat(F.lit("paper:"), paper), doc)


def fuse(routes: list[tuple[DataFrame, float]], k: int = 60, top: int = 10, depth: int = DEPTH) -> DataFrame:
    """(entity, rrf, routes, source, doc_id): fusion of routes (entity, doc_id, content, source, score) by rank, in millionths. An entity is represented by its longest content, then the first doc_id.
    Within a route only an entity's best rank counts, and a route counts to its first `depth` rows."""
    ranked = []
    for i, (df, weight) in enumerate(routes):
        rows = best_of(df, "doc_id", depth).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # `depth` rows
        ranked.append(rows.select("entity", "doc_id", "content", "source", "_rank", F.lit(weight).alias("_w"), F.lit(i).alias("_route")))
    rows = reduce(DataFrame.unionByName, ranked)
    best = rows.groupBy("entity", "_route").agg((F.first("_w") / (max(1, k) + F.min("_rank"))).cast("decimal(20,12)").alias("part"), F.min(F.struct((-F.length("content")).alias("l"), "doc_id", "source")).alias("r"))
    out = best.groupBy("entity").agg(F.floor(F.sum("part").cast("double") * 1000000 + 0.5).cast("long").alias("rrf"), F.count("*").alias("routes"), F.min("r").alias("r"))
    return out.select("entity", "rrf", "routes", "r.source", "r.doc_id").orderBy(F.desc("rrf"), "source", "doc_id").limit(top)


def hybrid(routes: dict[str, Callable[[], DataFrame]], plan: list[str], fallback: dict[str, str] | None = None) -> tuple[list[DataFrame], list[str]]:
    """The routes of a plan, each run on its own to a written table of its results: one that fails, in its making or in a task, is left out and named, and its fallback joins if it isn't in the plan already."""
    found, failed = {}, []
    todo = list(plan)
    while todo:
        name = todo.pop(0)
        if name in found:
            continue
        try:
            found[name] = written(routes[name](), name)
        except Exception:  # noqa: BLE001  whatever a route fails by, the others go on
            failed.append(name)
            other = (fallback or {}).get(name)
            if other and other not in found and other not in todo and other not in failed:
                todo.append(other)
    return list(found.values()), failed


def asset_paths(vulns: DataFrame, components: DataFrame, assets: DataFrame) -> DataFrame:
    """(vuln, path, hops, score): vulnerability, component and asset in one line, or the first two where no asset follows; two hops score 10000, one 5000."""
    rows = vulns.join(components, "vuln").join(assets, "component", "left")
    path = F.concat_ws(" > ", "vuln", "component", "asset")
    return rows.select("vuln", path.alias("path"), F.when(F.col("asset").isNull(), 1).otherwise(2).alias("hops")).distinct().withColumn("score", F.when(F.max("hops").over(Window.partitionBy("vuln")) == 2, 10000).otherwise(5000))


def resolve_conflicts(df: DataFrame, fact: str, source: str, trust: Column, order: Column) -> DataFrame:
    """One row per fact: the source of highest trust, then first in order, how many sources there are and whether that is more than one."""
    return df.groupBy(fact).agg(F.max_by(source, F.struct(trust.alias("t"), (-order).alias("o"))).alias("winner"), F.count_distinct(source).alias("n_sources")).withColumn("corroborated", F.col("n_sources") > 1)


def accepted(score: Column, cve: Column, wanted: Column, least: int = 6000) -> Column:
    """Whether evidence (score in ten-thousandths) is good enough and about the wanted id."""
    return (score >= least) & F.coalesce(F.upper(cve) == F.upper(wanted), F.lit(False))


def gap_evidence(df: DataFrame, facts: Column, missing: Column, order: list[Column], limit: int = 5) -> DataFrame:
    """The first items that cover a missing fact."""
    return df.where(F.arrays_overlap(facts, missing)).orderBy(*order).limit(limit)


def relevant(cve: Column, wanted: list[str]) -> Column:
    """Rows about another id go; rows without one stay."""
    return cve.isNull() | F.upper(cve).isin(*(w.upper() for w in wanted)) if wanted else F.lit(True)


#: Routes from the most to the least exact.
PRIORITY = ["graph", "multi_hop", "fulltext", "vector"]


def offline_steps(df: DataFrame, question: str, route: str, score: str, key: str, most: int = 2) -> DataFrame:
    """The first results of each question by route, score and key, as numbered steps."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col(route)), F.lit(99))
    place = F.when(place == 0, 99).otherwise(place)
    nth = F.row_number().over(Window.partitionBy(question).orderBy(place, F.desc(score), key))
    return df.withColumn("step", nth).where(F.col("step") <= most)


def offline_answer(steps: DataFrame, question: str, order: str, line: Column, cite: Column, lines: int = 5, cites: int = 3) -> DataFrame:
    """(question, answer, citations): the first lines of each question and the distinct citations among them."""
    rows = steps.where(F.col(order) <= lines).groupBy(question).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"), cite.alias("c")))).alias("x"))  # `lines` rows each
    return rows.select(question, F.array_join(F.transform("x", lambda r: F.concat(F.lit("- "), r["l"])), "\n").alias("answer"), F.array_join(F.slice(F.array_distinct(F.transform("x", lambda r: r["c"])), 1, cites), ",").alias("citations"))


def gap_notice(answer: Column, missing: Column, notice: str) -> Column:
    """The answer, with a fixed sentence where the fixed version is missing and isn't said to be yet."""
    return F.when(F.array_contains(missing, "fixed_version") & ~F.contains(answer, F.lit(notice)), F.concat_ws("\n", answer, F.lit(notice))).otherwise(answer)


def keyword_papers(df: DataFrame, key: str, body: str, published: str, words: list[str], k: int) -> DataFrame:
    """keyword_sum in the order of a result list: score, then the latest, then key."""
    rows = keyword_sum(df, key, body, words).join(df.select(key, published), key)
    return rows.orderBy(F.desc("score"), F.desc_nulls_last(published), key).limit(k)


def graph_route(df: DataFrame, key: str, name: Column, technique: Column, ids: list | None = None, components: list[str] | None = None, techniques: list | None = None, most: int = 3) -> DataFrame:
    """Distinct keys by the first kind of entity that a question names: ids, else parts of component names, else techniques; `most` of them."""
    if ids:
        rows = df.where(F.col(key).isin(*ids[:most]))
    elif components:
        rows = df.where(reduce(lambda a, b: a | b, (F.contains(F.lower(name), F.lit(c.strip().lower())) for c in components[:most])))
    elif techniques:
        rows = df.where(technique.isin(*techniques[:most]))
    else:
        rows = df.limit(0)
    return rows.select(key).distinct()

"""Property graph: extraction, bounded paths, overview, pruning."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def nodes(parts: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(label, key) of all parts, once each."""
    out = None
    for label, df, key in parts:
        rows = df.select(F.lit(label).alias("label"), key.cast("string").alias("key")).where("key is not null")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def edges(parts: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """(relation, src, dst) of all parts, once each."""
    out = None
    for relation, df, src, dst in parts:
        rows = df.select(F.lit(relation).alias("relation"), src.cast("string").alias("src"), dst.cast("string").alias("dst")).where("src is not null and dst is not null")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, mid, dst) along two relations; a first hop without a second keeps a null end."""
    return first.select("src", F.col("dst").alias("mid")).join(second.select(F.col("src").alias("mid"), F.col("dst")), "mid", "left").select("src", "mid", "dst")


def heavy(df: DataFrame, key: str, shared: str, most: int) -> DataFrame:
    """(shared, key, n): the members of each value with more than `most` keys and their number, a row per key; any two of a value are siblings."""
    once = df.select(key, shared).distinct()
    large = once.groupBy(shared).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return once.join(large, shared).select(shared, key, "n")


def members(df: DataFrame, key: str, shared: str) -> DataFrame:
    """(shared, key, first, n): the keys of each value that at least two share, with the least of them and their number. Any two keys of a value are siblings, so no pair is lost and none is written out."""
    once = df.select(key, shared).where(f"{key} is not null and {shared} is not null").distinct()
    groups = once.groupBy(shared).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    return once.join(groups, shared).select(shared, key, "first", "n")


def siblings_of(asked: DataFrame, df: DataFrame, key: str, shared: str, order: list[Column]) -> DataFrame:
    """(key, shared, sibling): for the asked keys all others with the same value; a key without siblings keeps nulls."""
    once = df.select(key, shared).distinct()
    mine = asked.select(key).join(once, key, "left")
    others = once.select(F.col(shared).alias("_s"), F.col(key).alias("sibling"))
    return mine.join(others, (F.col(shared) == F.col("_s")) & (F.col(key) != F.col("sibling")), "left").select(key, shared, "sibling").orderBy(*order)


def neighbourhood(centre: str, edge_rows: DataFrame, node_rows: DataFrame, labels: list[str] | None = None, limit: int = 200) -> DataFrame:
    """(centre, relation, key, label): neighbours of a node over edges of either direction, of some labels, in order of key; a node without any keeps one row of nulls."""
    out = edge_rows.where(F.col("src") == centre).select("relation", F.col("dst").alias("key"))
    into = edge_rows.where(F.col("dst") == centre).select("relation", F.col("src").alias("key"))
    found = out.union(into).distinct().join(node_rows, "key", "left")
    found = found if labels is None else found.where(F.col("label").isin(*labels))
    found = found.orderBy("label", "key", "relation").limit(limit)
    one = edge_rows.sparkSession.range(1).select(F.lit(centre).alias("centre"))
    return one.join(found.withColumn("centre", F.lit(centre)), "centre", "left").select("centre", "relation", "key", "label")


def reached(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, names): the distinct ends of two hops, in order; a start without any keeps an empty list."""
    return two_hops(first, second).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("names"))


def by_key_or_name(node_rows: DataFrame, edge_rows: DataFrame, wanted: str) -> DataFrame:
    """Sources of edges to nodes whose key or name is the wanted one."""
    low = wanted.strip().lower()
    hit = node_rows.where((F.lower("key") == low) | (F.lower("name") == low)).select(F.col("key").alias("dst"))
    return edge_rows.join(hit, "dst", "left_semi").select("src").distinct()


def related(component: Column, text: Column) -> Column:
    """Whether two sets of graph tokens meet."""
    return F.arrays_overlap(component, text)


def select_components(df: DataFrame, vuln: str, key: str, confidence: Column, is_related: Column, hits_asset: Column, k: int = 5) -> DataFrame:
    """(vuln, key, effective, rank): the k best of each vulnerability by confidence (halved where nothing relates it), asset vendors first, then key; related ones only, if there are any."""
    rows = df.select(vuln, key, is_related.alias("_r"), hits_asset.alias("_h"), F.when(is_related, confidence).otherwise(confidence * 0.5).alias("effective"))
    rows = rows.withColumn("_any", F.max("_r").over(Window.partitionBy(vuln))).where("_r or not _any")
    return top_per_group(rows, vuln, [F.desc("effective"), F.desc("_h"), F.asc(key)], k).select(vuln, key, "effective", "rank")


def merged_properties(df: DataFrame, keys: list[str], properties: str, order: Column) -> DataFrame:
    """One row per key: properties of all rows, later ones first, without nulls."""
    rows = df.select(*keys, F.explode(F.map_filter(properties, lambda _, v: v.isNotNull())).alias("_p", "_v"), order.alias("_o"))
    last = rows.groupBy(*keys, "_p").agg(F.max_by("_v", "_o").alias("_v"))
    props = last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_p", "_v")))).alias(properties))
    return df.select(*keys).distinct().join(props, keys, "left").select(*keys, F.coalesce(properties, F.expr("cast(map() as map<string,string>)")).alias(properties))


def prune_properties(m: Column) -> Column:
    """Without nulls and empty texts."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))


def oriented(edge_rows: DataFrame, starts: dict[str, str]) -> DataFrame:
    """Edges (relation, src, src_label, dst, dst_label) turned so that they begin at the label that their relation begins at."""
    table = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))
    turn = (F.try_element_at(table, F.col("relation")) == F.col("dst_label")) & (F.col("src_label") != F.col("dst_label"))
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a)
    return edge_rows.select("relation", swap("src", "dst"), swap("src_label", "dst_label"), swap("dst", "src"), swap("dst_label", "src_label"))


def mapped_subgraph(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (src, relation, dst) of one neighbourhood query as distinct edges in order, and whether the limit cut them."""
    n = rows.agg((F.count("*") >= limit).alias("truncated"))
    return rows.distinct().orderBy("src", "relation", "dst").crossJoin(F.broadcast(n))  # one row


def prune_excess(edge_rows: DataFrame, group: str, confidence: Column, tie: list[Column], k: int, missing: float = 0.0) -> DataFrame:
    """The k most certain edges of each group; a missing confidence counts as given."""
    return top_per_group(edge_rows.withColumn("_c", F.coalesce(confidence, F.lit(missing))), group, [F.desc("_c"), *tie], k).drop("_c", "rank")


def is_patch(url: Column, tags: Column) -> Column:
    return F.exists(tags, lambda t: F.lower(F.trim(t)).isin("advisory", "fix", "mitigation", "patch", "release", "release notes", "vendor advisory")) | F.regexp_like(F.lower(F.trim(url)), F.lit("/commit/|/patch|/pull/|/releases/|advisor"))


def overview(node_rows: DataFrame, edge_rows: DataFrame, first: str, most: int) -> tuple[DataFrame, DataFrame]:
    """At most `most` nodes, those of one label first, and the edges between them."""
    kept = node_rows.orderBy(F.col("label") != first, "label", "key").limit(most)
    ends = kept.select("key")
    return kept, edge_rows.join(ends.withColumnRenamed("key", "src"), "src", "left_semi").join(ends.withColumnRenamed("key", "dst"), "dst", "left_semi")


def prune(edge_rows: DataFrame, confidence: Column, least: float) -> DataFrame:
    return edge_rows.where(F.coalesce(confidence, F.lit(0.0)) >= least)


def orphans(node_rows: DataFrame, edge_rows: DataFrame, key: str, dst: str) -> DataFrame:
    """Nodes without an incoming edge."""
    return node_rows.join(edge_rows.select(F.col(dst).alias(key)), key, "left_anti")

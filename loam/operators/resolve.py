"""Entity resolution: keys, merges, first and last by key, near duplicates."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, text


def pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def merge_groups(df: DataFrame, key: str, order: list[str], longest: str, firsts: list[str], lists: list[str], lows: list[str], highs: list[str]) -> DataFrame:
    """One row per key: longest text, first non-null values, sorted distinct lists, least and greatest values. Every aggregate is combined before the shuffle."""
    rank = F.struct(*order)
    # the first of the longest: the least negative length, then the order itself
    out = [F.min_by(longest, F.when(F.col(longest).isNotNull(), F.struct((-F.length(longest)).alias("_l"), *(F.col(o) for o in order)))).alias(longest)]
    out += [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in firsts]
    out += [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s") for c in lists]
    out += [F.min(c).alias(f"min_{c}") for c in lows] + [F.max(c).alias(f"max_{c}") for c in highs] + [F.count("*").alias("n")]
    return df.groupBy(key).agg(*out)


def upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Rows of old and new by key; rules say for each column which wins: old, new (where not null), min or max."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    how = {"old": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))), "new": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))), "min": F.min, "max": F.max}
    return both.groupBy(key).agg(*(how[r](c).alias(c) for c, r in rules.items()), (F.max("_new") * 2 + F.lit(1) - F.min("_new")).alias("_state"))


def sync_registry(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, n, meta, action) of two registries: new counts win, maps are merged key by key with the new value first. Repeated names in one registry are an error of the caller."""
    both = old.select(key, F.col("n").alias("n_old"), F.col("meta").alias("m_old")).join(new.select(key, F.col("n").alias("n_new"), F.col("meta").alias("m_new")), key, "full")
    none = F.expr("cast(map() as map<string,string>)")
    m_old, m_new = F.coalesce("m_old", none), F.coalesce("m_new", none)
    meta = F.map_concat(F.map_filter(m_old, lambda k, _: ~F.map_contains_key(m_new, k)), m_new)
    action = F.when(F.col("n_old").isNull(), "inserted").when(F.col("n_new").isNull(), "kept").otherwise("updated")
    return both.select(key, F.coalesce("n_new", "n_old").alias("n"), meta.alias("meta"), action.alias("action"))


def keyed_refresh(df: DataFrame, key: str, order: Column, firsts: list[str], refreshed: dict[str, Column]) -> DataFrame:
    """One row per key: of the first row by order what stays, and aggregates that are refreshed."""
    return df.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in firsts), *(v.alias(k) for k, v in refreshed.items()))


def insert_if_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose content key isn't stored, once each."""
    return new.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def simhash60(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, fingerprint): 60-bit SimHash on md5 tokens. A text's tokens lie in one task, so they are summed there and one row of sums travels, never a token."""
    rows = df.select(key, F.explode(text.tokens(F.col(body))).alias("t")).select(key, hashing.token_weight(F.col("t")).alias("h"))
    sums = rows.groupBy(key).agg(*(F.sum(F.shiftright("h", i).bitwiseAND(1) * 2 - 1).alias(f"b{i}") for i in range(60)))
    bits = F.transform(F.array(*(f"b{i}" for i in range(60))), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return sums.select(key, F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a + x).alias("fingerprint"))


def print_classes(prints: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint): each fingerprint once, with the least key that has it."""
    return prints.groupBy("fingerprint").agg(F.min(key).alias(key)).select(key, "fingerprint")


def near_pairs(prints: DataFrame, key: str, most: int, bits: int = 60) -> DataFrame:
    """Pairs (a, b, distance) of distinct fingerprints that differ in at most `most` bits. The bits are cut in most + 3 bands, of which three at least are equal then, so a pair shares the
    values of some three bands; they are half the bits, so few others meet."""
    bands = most + 3
    cuts = [round(i * bits / bands) for i in range(bands + 1)]
    band = [F.shiftright("fingerprint", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    keys = F.array(*(F.struct(F.lit(n).alias("n"), *(band[i].alias(f"v{j}") for j, i in enumerate(three))) for n, three in enumerate(combinations(range(bands), 3))))
    rows = prints.select(key, "fingerprint", F.explode(keys).alias("band"))
    a, b = rows.select(F.col(key).alias("a"), F.col("fingerprint").alias("fa"), "band"), rows.select(F.col(key).alias("b"), F.col("fingerprint").alias("fb"), "band")
    pairs = a.join(b, "band").where((F.col("a") < F.col("b")) & (hashing.hamming(F.col("fa"), F.col("fb")) <= most))
    return pairs.select("a", "b", hashing.hamming(F.col("fa"), F.col("fb")).alias("distance")).distinct()


def mapped_assets(products: DataFrame, inventory: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(key, asset, confidence): up to `most` assets of each product from an inventory (key, asset), at 0.9; a product that it doesn't know gets a placeholder at 0.35."""
    rows = products.join(inventory, key, "left").withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("asset"))).where(F.col("_nth") <= most)
    return rows.select(key, F.coalesce("asset", F.concat(F.lit("unknown:"), F.col(key).cast("string"))).alias("asset"), F.when(F.col("asset").isNull(), 0.35).otherwise(0.9).alias("confidence"))


def vendor_fits(asset: Column, product: Column) -> Column:
    """Whether two vendors are one: equal or part of one another, whatever case and blanks; one that isn't given speaks against nothing."""
    low = lambda c: F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit(""))
    a, b = low(asset), low(product)
    return (a == "") | (b == "") | F.contains(a, b) | F.contains(b, a)


def selected_assets(candidates: DataFrame, record: str, asset: str, vendor: str, confidence: str, product: str, product_vendor: str, most: int = 10) -> DataFrame:
    """candidates with a rank: up to `most` assets of each record whose vendor fits the product's, or whose name and the product's are part of one another; by confidence, those with the product in their name first, then by name."""
    name, needle = F.lower(F.trim(asset)), F.lower(F.trim(F.coalesce(product, F.lit(""))))
    named = (needle != "") & (F.contains(name, needle) | F.contains(needle, name))
    kept = candidates.where(vendor_fits(F.col(vendor), F.col(product_vendor)) | named)
    hit = (needle != "") & F.contains(name, needle)
    nth = F.row_number().over(Window.partitionBy(record).orderBy(F.desc(confidence), F.desc(hit), name, F.asc_nulls_last(vendor), F.asc_nulls_last(asset)))
    return kept.withColumn("rank", nth).where(F.col("rank") <= most)

"""Mixing sources to target weights by Sainte-Laguë apportionment, in built-in functions only.

Each source's documents are dealt to shards by a seeded hash, and a shard lays its documents, in seeded order, on a line of words that
is cut into blocks of equal size. Blocks are seats: the total of the targets in blocks is apportioned to sources by highest
quotients target / (2 k + 1), and each source's seats to its shards in the same way by their sizes. A shard then takes its quota
of blocks from a seeded starting block on, around its line and as often as needed. What a document gives follows from the overlap of
its words with that range, so no block is ever a row.

Highest quotients without listing all seats: rounding size * seats / total gives the allocation of nearly the right number of seats; the few seats missing
or too many are settled by ranking only the quotients next to it.

Shards number about 8192 at most and hold 65536 words at least, so no window holds a whole source at scale.

Defined cases: a null or empty text has size 0 and gives nothing; repeated rows count each; null is a source of its own, last;
a null doc_id is a document; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table

#: Words in a block; words in a shard at least; shards at most, about; times that a source's words may be taken.
BLOCK, SHARD_WORDS, SHARDS, MOST = 16, 65_536, 8192, 3
SEED = 17


def targets(sizes: DataFrame, weights: list[int], most: int = MOST) -> DataFrame:
    """(source, source_size, target) from sizes (source, source_size): weights repeat along the sources by code point, null last; targets stop at most times the size
    and what is over goes to the others by weight. In order of size / weight, the sources that stop come first, so sums along that order tell where stopping ends."""
    # one row per source from here on
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("stop", most * F.col("source_size"))
    line = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumns({"total": F.sum("source_size").over(every), "before": F.coalesce(F.sum("stop").over(line), F.lit(0)), "rest": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(line), F.lit(0))})
    rows = rows.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    # the first source that doesn't stop sets the level of all that follow
    free = rows.where(F.col("stop") >= F.col("level") * F.col("weight")).select(F.min_by("level", F.struct(F.col("stop") / F.col("weight"), F.col("before"))).alias("share"))
    rows = rows.crossJoin(F.broadcast(free))  # one value
    target = F.when(F.col("stop") >= F.col("share") * F.col("weight"), F.col("share") * F.col("weight")).otherwise(F.col("stop").cast("double"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def sainte_lague(rows: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """rows with `quota`: the integer seats of each key within its group by highest quotients votes / (2 k + 1). Ties go to the smaller key."""
    whole = Window.partitionBy(*group)
    rows = rows.withColumn("_all", F.sum(F.col(votes).cast("double")).over(whole))
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all") * F.col(seats)).otherwise(F.lit(0.0))
    rows = rows.withColumn("_near", F.floor(share + 0.5).cast("long")).withColumn("_miss", F.col(seats) - F.sum("_near").over(whole))
    # the quotients of the seats next to each allocation: moving the divisor until |miss| seats more or less are given changes a key by its share of
    # |miss| and of one seat for each key (what rounding can hide), and by one of its own
    keys = F.count("*").over(whole)
    reach = F.least(F.abs("_miss"), F.floor(F.try_divide(F.col(votes), F.col("_all")) * (F.abs("_miss") + F.col("_keys"))).cast("long") + 2)
    rows = rows.withColumn("_keys", keys)
    seat = F.when(F.col("_miss") > 0, F.sequence(F.col("_near"), F.col("_near") + reach - 1)).when(F.col("_miss") < 0, F.sequence(F.greatest(F.col("_near") - reach, F.lit(0)), F.greatest(F.col("_near") - 1, F.lit(0))))
    open_ = rows.where((F.col("_miss") != 0) & (F.col(votes) > 0) & ((F.col("_miss") > 0) | (F.col("_near") > 0))).select(*group, key, "_miss", votes, F.explode(seat).alias("_seat"))
    quotient = F.col(votes) / (2 * F.col("_seat") + 1)
    sign = F.signum("_miss")
    nth = F.row_number().over(Window.partitionBy(*group).orderBy((-sign * quotient), F.col(key).isNull(), key, F.when(sign > 0, F.col("_seat")).otherwise(-F.col("_seat"))))
    settled = open_.withColumn("_nth", nth).where(F.col("_nth") <= F.abs("_miss")).groupBy(*group, key).agg(F.sum(sign).cast("long").alias("_more"))
    settled = settled.withColumnsRenamed({x: f"_{x}_" for x in [*group, key]})
    same = [rows[x].eqNullSafe(settled[f"_{x}_"]) for x in [*group, key]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    out = rows.join(settled, on, "left").withColumn("quota", F.col("_near") + F.coalesce("_more", F.lit(0)))
    return out.drop("_all", "_near", "_miss", "_more", "_keys", *(f"_{x}_" for x in [*group, key]))


def n_words(text: Column) -> Column:
    """Number of runs without white space: what is left of a text when each run becomes one letter and white space goes."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


def mix(docs: DataFrame, weights: list[int], block: int = BLOCK, seed: int = SEED, size: Column | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, text_key, source, size, source_size, target, taken."""
    text_key = F.xxhash64(F.col("text").cast("string"))
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text_key.alias("text_key"), (n_words(F.col("text")) if size is None else size).alias("size"))
    sized = materialize(sized, "sized")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    every = Window.partitionBy()
    sources = sources.withColumn("total", F.sum("source_size").over(every)).withColumn("seats", F.round(F.col("total") / block).cast("long"))
    sources = sainte_lague(sources.withColumn("g", F.lit(1)), ["g"], "source", "target", "seats").drop("g")
    words = F.greatest(F.lit(SHARD_WORDS), F.ceil(F.col("total") / SHARDS))
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / words)).cast("long"))
    sources = materialize(sources.select("source", "source_size", "target", "quota", "shards"), "sources")
    own = sources.select(F.col("source").alias("s"), "source_size", "target", "shards", F.col("quota").alias("seats"))
    dealt = sized.join(own, sized.source.eqNullSafe(own.s)).withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "text_key"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_key"), F.col("shards"))).drop("s", "shards")
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    shards = sainte_lague(shards, ["source"], "shard", "shard_size", "seats")
    take = F.least(F.col("quota") * block, MOST * F.col("shard_size"))
    begin = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block))) * block
    shards = shards.select(F.col("source").alias("s"), F.col("shard").alias("h"), "shard_size", take.alias("take"), begin.alias("begin"))
    rows = dealt.join(shards, dealt.source.eqNullSafe(shards.s) & (dealt.shard == shards.h))
    line = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("hi", F.sum("size").over(line)).withColumn("lo", F.col("hi") - F.col("size"))
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("take") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    over = F.col("take") - whole * F.col("shard_size")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("hi"), b) - F.greatest(F.col("lo"), a))
    part = overlap(F.col("begin"), F.col("begin") + over) + overlap(F.col("begin") - F.col("shard_size"), F.col("begin") + over - F.col("shard_size"))
    return rows.select("doc_id", "text_key", "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def op9_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all documents to the weights 1, 2, 3."""
    return mix(table(spark, sf_dir, "documents"), [1, 2, 3]).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_apportion": op9_apportion}
ORACLE: dict[str, str] = {}

"""Leader clustering of 64-bit fingerprints: in order of key, a row joins the first leader within a number of bits, else leads.

Leaders are the lexicographically first maximal independent set of the graph of near fingerprints, so no walk is needed. Distinct fingerprints are numbered in order and taken in prefixes that double.
A prefix is held against all leaders found so far; a row that is near to some has its first leader then, for all later ones have higher numbers. The rows left over are held against each other, and rounds
of joins over the near pairs settle them: a row leads once no earlier near row is open, and a row near to a new leader can't lead. On keys in an order that has nothing to do with likeness, both
prefixes and rounds are logarithmic in number.

Rows meet in blocks of BLOCK fingerprints, a pair of blocks a row of a join, so tasks are even and near pairs alone come out. At 15 of 64 bits no table of sampled bits keeps pairs apart that aren't near (a
pair at 15 bits shares 12 sampled bits in 3 of 100 cases), while leaders are few however many rows there are: each excludes one in 85,000 of all fingerprints. So every row meets each earlier leader
once, exactly, and nothing is missed.

Rows, leaders and pairs stay in written tables; the driver sees counts and block numbers.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Fingerprints in the first prefix and in a block.
FIRST, BLOCK = 1 << 14, 1 << 13


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """df with each row's place from 0 in a total order: sorted by ranges, written, and counted from the rows of the ranges before. One number a range comes to the driver."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before, bases = 0, []
    for r in sorted(dealt.groupBy(part.alias("_part")).count().collect(), key=lambda r: r["_part"]):
        bases.append((r["_part"], before))
        before += r["count"]
    known = F.broadcast(df.sparkSession.createDataFrame(bases, "_part long, _before long"))
    return dealt.withColumn("_part", part).join(known, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def _pack(size: int):
    def run(batches):
        ns, prints, made = np.zeros(0, np.int64), np.zeros(0, np.int64), TaskContext.get().partitionId() << 33
        row = lambda a, b: pa.RecordBatch.from_arrays([pa.array([made]), pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["block", "ns", "prints"])
        for batch in batches:
            ns, prints = np.concatenate([ns, batch.column(0).to_numpy()]), np.concatenate([prints, batch.column(1).to_numpy()])
            while len(ns) >= size:
                yield row(ns[:size], prints[:size])
                ns, prints, made = ns[size:], prints[size:], made + 1
        if len(ns):
            yield row(ns, prints)
    return run


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, list[int]]:
    """rows (n, fingerprint) in blocks of at most `size`, written, and the numbers of the blocks."""
    blocks = written(rows.select("n", "fingerprint").mapInArrow(_pack(size), "block long, ns binary, prints binary"), "blocks")
    return blocks, sorted(r.block for r in blocks.select("block").collect())


def _met(left: DataFrame, right: DataFrame, numbers: list[int], triangle: bool) -> DataFrame:
    """Every block of left beside each block of right; in a triangle, beside those of no lower number."""
    to = F.array(*map(F.lit, numbers))
    to = F.filter(to, lambda b: b >= F.col("block")) if triangle else to
    a = left.select(F.col("block").alias("a"), F.col("ns").alias("a_ns"), F.col("prints").alias("a_prints"), F.explode(to).alias("block"))
    return a.join(right, "block")


def _each(batches):
    for batch in batches:
        cols = {f: batch.column(batch.schema.get_field_index(f)).to_pylist() for f in ("a", "block", "a_ns", "a_prints", "ns", "prints")}
        for a, b, ns, prints, ms, others in zip(*cols.values(), strict=True):
            read = lambda x, kind: np.frombuffer(x, kind)
            yield a, b, read(ns, np.int64), read(prints, np.uint64), read(ms, np.int64), read(others, np.uint64)


def _pairs(threshold: int):
    """(u, v) for near rows, u the earlier one."""
    def run(batches):
        for a, b, ns, prints, ms, others in _each(batches):
            for lo in range(0, len(ns), 64):
                i, j = np.nonzero(np.bitwise_count(prints[lo:lo + 64, None] ^ others[None, :]) <= threshold)
                u, v = ns[lo + i], ms[j]
                keep = u < v if a == b else u != v
                u, v = u[keep], v[keep]
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])
    return run


def _first(threshold: int):
    """(n, leader): the first near leader of each row that has one in the block."""
    def run(batches):
        for _, _, ns, prints, ms, others in _each(batches):
            order = np.argsort(ms)
            ms, others = ms[order], others[order]
            for lo in range(0, len(ns), 64):
                near = np.bitwise_count(prints[lo:lo + 64, None] ^ others[None, :]) <= threshold
                hit = np.flatnonzero(near.any(1))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(ns[lo + hit]), pa.array(ms[near[hit].argmax(1)])], ["n", "leader"])
    return run


def independent(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes (n) of the lexicographically first maximal independent set under pairs (u, v), u < v: rounds of joins until no node is open."""
    found, edges = [], pairs
    open_ = nodes.select("n")
    while True:
        leads = written(open_.join(edges.select(F.col("v").alias("n")).distinct(), "n", "left_anti"), "leads")
        found.append(leads)
        ruled_out = edges.join(leads, edges.u == leads.n).select(F.col("v").alias("n")).distinct()
        open_ = written(open_.join(leads, "n", "left_anti").join(ruled_out, "n", "left_anti"), "open")
        if open_.isEmpty():
            return reduce(DataFrame.union, found)
        edges = written(edges.join(open_.select(F.col("n").alias("u")), "u", "left_semi").join(open_.select(F.col("n").alias("v")), "v", "left_semi").select("u", "v"), "edges")


def leader_clusters(prints: DataFrame, key: str, threshold: int, first: int = FIRST, block: int = BLOCK) -> DataFrame:
    """(key, leader) of prints (key, fingerprint), one row for each row. Keys are of any type that can be ordered, null ones come last; equal fingerprints share their first row's leader.
    A null fingerprint is near to nothing: its row leads itself."""
    rows = written(prints.select(F.col(key).alias("k"), "fingerprint"), "prints")  # they are read twice, and are dear to make
    distinct = rows.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("k").alias("at"))
    ranked = numbered(distinct, [F.asc_nulls_last("at"), F.asc("fingerprint")])
    # the prefix of a row is known by its number: 0 below first, then doubling
    prefix = F.when(F.col("n") < first, 0).otherwise(F.floor(F.log2(F.col("n") / first)) + 1).cast("int")
    ranked = written(ranked.withColumn("prefix", prefix), "prefixes", "prefix")
    leaders, done = None, []
    for at in sorted(r.prefix for r in ranked.select("prefix").distinct().collect()):
        own = ranked.where(F.col("prefix") == at).select("n", "fingerprint")
        if leaders is not None:
            known, numbers = _blocks(leaders, block)
            mine, _ = _blocks(own, block)
            hits = _met(mine, known, numbers, False).mapInArrow(_first(threshold), "n long, leader long")
            hits = written(hits.groupBy("n").agg(F.min("leader").alias("leader")), "hits")
            done.append(hits)
            own = written(own.join(hits, "n", "left_anti"), "left")
        mine, numbers = _blocks(own, block)
        if not numbers:
            continue
        near = written(_met(mine, mine, numbers, True).mapInArrow(_pairs(threshold), "u long, v long"), "near")
        leads = written(independent(own, near), "leads")
        joined = near.join(leads.withColumnRenamed("n", "u"), "u").groupBy(F.col("v").alias("n")).agg(F.min("u").alias("leader"))
        done += [leads.select("n", F.col("n").alias("leader")), written(joined, "joined")]
        new = own.join(leads, "n", "left_semi")
        leaders = written(new if leaders is None else leaders.union(new), "leaders")
    lone = rows.where("fingerprint is null").select(F.col("k").alias(key), F.col("k").alias("leader"))
    if not done:
        return lone
    settled = reduce(DataFrame.union, done)
    of = settled.join(ranked.select("n", "fingerprint"), "n").join(ranked.select(F.col("n").alias("leader"), F.col("at").alias("leader_at")), "leader").select("fingerprint", "leader_at")
    return rows.join(written(of, "settled"), "fingerprint").select(F.col("k").alias(key), F.col("leader_at").alias("leader")).union(lone)

"""Exact ranked lexical search with variable-block-max WAND.

An inverted index is built by shards: a shard is a block of about SHARD bytes of text whose postings stay together, so indexing shuffles nothing. The number of documents, their length and the
document frequencies of the asked terms are sums over shards. Then each shard searches for itself and the best of all shards are ranked per item; Spark cuts each task's rows to k before they are shuffled.

In a shard every asked term's postings are cut into blocks of their own lengths. Dynamic programming chooses the boundaries that minimise the bound error, the sum of what a block's greatest impact
overstates its postings by, plus COST for each block; it works on units of UNIT postings and blocks of at most WIDEST units, for all lists of a shard at a time.

A search takes an item's terms by falling greatest contribution. With the k-th best score as threshold, a term and all later ones are skipped when their greatest contributions together can't reach it, a block
when its own greatest impact and the later terms' can't, and a document when the greatest impacts of the blocks that it lies in can't (the pivot test of WAND, taken for many documents at once).
What is left is scored in full. Bounds equal to the threshold stay, so ties are exact.

Items are dealt into chunks of about QUERY_TERMS distinct terms; one chunk at a time is collected and sent to the shards, so what is sent doesn't grow with the items.

Defined cases: a null or empty text, or one without terms, counts nowhere and is never found; an item without terms, or whose terms occur nowhere, has no rows; rows of one item_id are one item with the terms of all of them;
a null item_id is an item; a null doc_id comes last among equal scores; repeated rows are documents each, and equal ones are ranked in any order, which gives the same rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext as vt
from .feature_dictionary import word_array
from .shared import materialize, table

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD = 16 << 20
#: Postings in a unit, units in a block at most, and what a block costs in the greatest impact of its list.
UNIT, WIDEST, COST = 8, 16, 2.0
#: Distinct (item, term) rows that a chunk of items has, about.
QUERY_TERMS = 200_000
_INDEX = "shard long, term string, n_docs int, docs array<int>, tfs array<int>, ids array<long>, sizes array<long>"
_NAMES = [f.split()[0] for f in _INDEX.split(", ")]


def _list(flat: pa.Array | np.ndarray, spans: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), flat if isinstance(flat, pa.Array) else pa.array(flat))


def _index(batches):
    made = 0
    for batch in batches:
        for lo, hi, data, offs in vt.slices(batch.column(1), SHARD):
            shard, made, k = (TaskContext.get().partitionId() << 33) + made, made + 1, hi - lo
            words, doc = word_array(vt.LOWER[data], offs)
            coded = words.dictionary_encode()
            terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, tfs = np.unique(code * k + doc, return_counts=True)
            spans = np.searchsorted(pairs, np.arange(len(terms) + 1) * k)
            null = lambda kind, n: pa.nulls(n, pa.list_(kind))
            one = np.array([0, k])
            ids = batch.column(0).slice(lo, k)
            yield pa.RecordBatch.from_arrays([
                pa.array([shard]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), null(pa.int32(), 1), null(pa.int32(), 1), _list(pa.concat_arrays([ids]), one), _list(np.bincount(doc, minlength=k), one)], _NAMES)
            # some terms at a time: a batch is a few MB
            for a in range(0, len(terms), 20_000):
                b = min(a + 20_000, len(terms))
                n, cut, at = b - a, slice(spans[a], spans[b]), spans[a:b + 1] - spans[a]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, shard)), terms.slice(a, n).cast(pa.string()), pa.array(np.diff(at).astype(np.int32)), _list((pairs[cut] % k).astype(np.int32), at), _list(tfs[cut].astype(np.int32), at),
                    null(pa.int64(), n), null(pa.int64(), n)], _NAMES)


def index(docs: DataFrame) -> DataFrame:
    """The written index of docs (doc_id, text): for each shard a row with ids and sizes (terms of each document), and a row for each term with the numbers of its documents and how often it occurs in each."""
    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_index, _INDEX), "index")


def cut_blocks(impacts: np.ndarray, spans: np.ndarray) -> list[np.ndarray]:
    """For each list impacts[spans[i]:spans[i + 1]] the places where its blocks end, by dynamic programming."""
    sizes = np.diff(spans)
    units = -(-sizes // UNIT)
    ends: list[np.ndarray] = [np.array([n]) for n in sizes.tolist()]
    kinds = np.ceil(np.log2(np.maximum(units, 1))).astype(int)
    for kind in np.unique(kinds[units > 1]).tolist():
        of = np.flatnonzero((kinds == kind) & (units > 1))
        most, n = int(units[of].max()), len(of)
        top, upto, count = np.zeros((most, n)), np.zeros((most + 1, n)), np.zeros((most + 1, n))
        for j, i in enumerate(of.tolist()):
            own, starts = impacts[spans[i]:spans[i + 1]], np.arange(0, sizes[i], UNIT)
            u = len(starts)
            top[:u, j] = np.maximum.reduceat(own, starts)
            upto[1:u + 1, j] = np.cumsum(np.add.reduceat(own, starts))
            count[1:u + 1, j] = np.minimum(starts + UNIT, sizes[i])
        cost = COST * top.max(0)
        least, back = np.zeros((most + 1, n)), np.zeros((most + 1, n), np.int8)
        for end in range(1, most + 1):
            best, high = np.full(n, np.inf), np.zeros(n)
            for wide in range(1, min(WIDEST, end) + 1):
                start = end - wide
                high = np.maximum(high, top[start])
                error = least[start] + cost + high * (count[end] - count[start]) - (upto[end] - upto[start])
                better = error < best
                best = np.where(better, error, best)
                back[end][better] = wide
            least[end] = best
        for j, i in enumerate(of.tolist()):
            at, cuts = int(units[i]), []
            while at:
                cuts.append(min(at * UNIT, int(sizes[i])))
                at -= int(back[at, j])
            ends[i] = np.array(cuts[::-1])
    return ends


class Postings:
    """One term in a shard: documents in order, their impacts times the term's weight, and per block the last document and the greatest of these."""

    def __init__(self, docs: np.ndarray, values: np.ndarray, ends: np.ndarray):
        self.docs, self.values, self.ends = docs, values, ends
        self.last = docs[ends - 1]
        self.high = np.maximum.reduceat(values, np.concatenate([[0], ends[:-1]]))
        self.most = int(self.high.max())

    def bound(self, docs: np.ndarray) -> np.ndarray:
        """The greatest value of the block that each document lies in."""
        at = np.searchsorted(self.last, docs)
        return np.where(at < len(self.last), self.high[np.minimum(at, len(self.last) - 1)], 0)

    def value(self, docs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[at] == docs, self.values[at], 0)


def best(terms: list[tuple[Postings, int]], k: int, seen: np.ndarray, stamp: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the k best, by falling score, then by order. terms: postings with how often the item has them; seen: a number for each document, which `stamp` isn't among."""
    terms = sorted(terms, key=lambda t: -t[0].most * t[1])
    most = [p.most * times for p, times in terms]
    rest = np.cumsum(most[::-1])[::-1].tolist() + [0]
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for r, (p, times) in enumerate(terms):
        if rest[r] < least:
            break
        own = p.high * times + rest[r + 1]
        live = own >= least
        if live.all():
            found, score = p.docs, p.values * times
        else:
            keep = np.repeat(live, np.diff(p.ends, prepend=0))
            found, score = p.docs[keep], p.values[keep] * times
        new = seen[found] != stamp
        found, score = found[new], score[new]
        seen[found] = stamp
        if least > 1 and len(found) > 64:
            limit = score + rest[r + 1]
            for s in range(r + 1, len(terms)):
                limit += terms[s][0].bound(found) * terms[s][1] - most[s]
                keep = limit >= least
                if not keep.all():
                    found, score, limit = found[keep], score[keep], limit[keep]
                if len(found) <= 64:
                    break
        for q, n in terms[r + 1:]:
            score = score + q.value(found) * n
        hit = score >= least
        docs, scores = np.concatenate([docs, found[hit]]), np.concatenate([scores, score[hit]])
        if len(docs) > k:
            first = np.lexsort((order[docs], -scores))[:k]
            docs, scores = docs[first], scores[first]
        if len(docs) == k:
            least = max(least, int(scores.min()))
    first = np.lexsort((order[docs], -scores))[:k]
    return docs[first], scores[first]


def impacts(tf: np.ndarray, size: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 12 m), where m is 75 + (25 size documents) div total."""
    if 25 * int(size.max(initial=0)) * documents < 1 << 62:
        m = 75 + 25 * size * documents // total
    else:
        m = np.array([75 + 25 * int(x) * documents // total for x in size], object)
        m = np.minimum(m, 1 << 58).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _search(items: list[tuple[int | None, list[int], list[int]]], documents: int, total: int, k: int):
    def run(rows: pa.Table, shards: pa.Table) -> pa.Table:
        ids, sizes = shards["ids"].combine_chunks().flatten(), shards["sizes"].combine_chunks().flatten().to_numpy()
        order = np.argsort(np.argsort(ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        rows = rows.combine_chunks()
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows:
            flat = lambda c: rows[c].combine_chunks()
            docs, tfs = flat("docs"), flat("tfs").flatten().to_numpy().astype(np.int64)
            spans = np.asarray(docs.offsets).astype(np.int64)
            spans, docs = spans - spans[0], docs.flatten().to_numpy().astype(np.int64)
            impact = impacts(tfs, sizes[docs], documents, total)
            ends = cut_blocks(impact.astype(float), spans)
            weight, number = flat("weight").to_numpy(), flat("number").to_pylist()
            # a weight of 0 adds nothing to any score
            terms = {t: Postings(docs[a:b], impact[a:b] * w, e) for t, a, b, w, e in zip(number, spans[:-1].tolist(), spans[1:].tolist(), weight.tolist(), ends, strict=True) if w > 0}
            seen = np.full(len(sizes), -1, np.int64)
            for stamp, (item, of, times) in enumerate(items):
                found, score = best([(terms[t], n) for t, n in zip(of, times, strict=True) if t in terms], k, seen, stamp, order)
                out[0].extend([item] * len(found))
                out[1].append(found)
                out[2].append(score)
        whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"item_id": pa.array(out[0], pa.int64()), "doc_id": ids.take(pa.array(whole(out[1]))).cast(pa.int64()), "score": pa.array(whole(out[2]), pa.int64())})
    return run


def _terms(batches):
    for batch in batches:
        for lo, hi, data, offs in vt.slices(batch.column(1)):
            words, doc = word_array(vt.LOWER[data], offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), words.cast(pa.string())], ["item_id", "term"])


def search(index: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for each item (item_id, text)."""
    spark = index.sparkSession
    shards, postings = index.where("term is null").select("shard", "ids", "sizes"), index.where("term is not null")
    whole = shards.agg(F.sum(F.size(F.filter("sizes", lambda n: n > 0))), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).head()
    documents, total = int(whole[0] or 0), int(whole[1] or 0)
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_terms, "item_id long, term string")
    asked = materialize(asked.groupBy("item_id", "term").agg(F.count("*").alias("times")), "asked")
    chunks = -(-asked.count() // QUERY_TERMS) if documents else 0
    found = None
    for chunk in range(chunks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == chunk).collect()  # about QUERY_TERMS rows
        number: dict[str, int] = {}
        of: dict[int | None, tuple[list[int], list[int]]] = {}
        for r in rows:
            terms, times = of.setdefault(r.item_id, ([], []))
            terms.append(number.setdefault(r.term, len(number)))
            times.append(r.times)
        if not number:
            continue
        names = materialize(spark.createDataFrame(list(number.items()), "term string, number int"), "names")
        held = postings.select("term", "n_docs").join(names, "term").groupBy("term", "number").agg(F.sum("n_docs").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df").cast("double") + 1)))
        weighed = materialize(held.select("term", "number", weight.cast("long").alias("weight")), "weighed")
        met = postings.select("shard", "term", "docs", "tfs").join(weighed, "term").select(F.col("shard").alias("of_shard"), "number", "weight", "docs", "tfs")
        each = met.groupBy("of_shard").cogroup(shards.groupBy("shard")).applyInArrow(_search([(i, *x) for i, x in of.items()], documents, total, k), "item_id long, doc_id long, score long")
        part = each if chunks == 1 else materialize(each, "found")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for each benchmark item."""
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 20)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERIES = {"op13_block_max_search": op13_block_max_search}
ORACLE = {"op13_block_max_search": f"""
with d as (select row_number() over () as row, doc_id, {_TERMS} as ts from documents), q as (select item_id, unnest({_TERMS}) as term from benchmark), i as (select item_id, term, count(*) as times from q group by all),
s as (select count(*) as n_docs, sum(len(ts))::bigint as total from d where len(ts) > 0), p as (select row, term, count(*) as tf from (select row, unnest(ts) as term from d) where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, s group by term, n_docs),
m as (select row, doc_id, 100 - 25 + (25 * len(ts)::bigint * n_docs) // total as m from d, s where len(ts) > 0),
x as (select item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from i join p using (term) join w using (term) join m using (row) group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last, row) as rank, doc_id, score from x where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 20
"""}

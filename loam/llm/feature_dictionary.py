"""Target-distribution importance resampling with a dictionary of distinct features.

Features are runs of 1 to `most` consecutive words, hashed into buckets. Every distinct feature string of the corpus and of the target stands once in a dictionary
with its two counts, is hashed there once, and the counts are summed by bucket. A bucket's gain is how much likelier the target holds it than the corpus; gains are joined back
to the documents' feature counts and summed to a weight. Gumbel noise made from doc_id turns weights into a draw without replacement: the highest scores stay.

Texts are counted in blocks of about BLOCK bytes: a block lists its distinct features once, and its documents keep numbers into that list with how often each occurs. So what travels is a row for
each distinct feature of a block, not one for each document that holds it, and the frequent features are no hot keys: a feature has one row a block. Gains go back to the block by number.
The dictionary is never collected or broadcast; the BUCKETS gains are broadcast, whatever the input.

Ranks come from a sort by ranges of score, one row a range giving the ranks before it; no task sees all rows.

Defined cases: a null or empty text or one without words has weight 0 and no features; documents with under `least` words are scored but never drawn; repeated rows count each, in the corpus and in the draw,
and rows equal in score and doc_id are ranked in the order of their blocks; a null doc_id is hashed as the empty text and comes last among equal scores; an empty target has T = 0, an empty corpus gives no rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as vt
from .shared import materialize, table

BUCKETS, SEED = 10_000, "2024"
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 8 << 20
#: Bytes of no word once A-Z is lower-cased: ASCII but digits and a-z.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[:0x80] = True
SEPARATOR[ord("0"):ord("9") + 1] = False
SEPARATOR[ord("a"):ord("z") + 1] = False
_ROW = "block long, row int, doc_id long, n_words long, n_features long, numbers array<int>, times array<int>, features array<string>, totals array<long>"


def word_array(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased bytes as one string array, and the text of each."""
    starts, ends, doc = vt.words(data, offs, SEPARATOR)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    inside = data[~SEPARATOR[data]]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(inside))]), doc


def runs(words: pa.Array, doc: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray]:
    """All runs of 1 to most words within a text, joined by blanks, and the text of each."""
    found, of, longer = [words], [doc], words
    for n in range(2, most + 1):
        if len(words) < n:
            break
        longer = pc.binary_join_element_wise(longer[:-1], words[n - 1:], pa.scalar(" ", pa.large_string()))
        whole = doc[n - 1:] == doc[:len(doc) - n + 1]
        found.append(longer.filter(pa.array(whole)))
        of.append(doc[:len(doc) - n + 1][whole])
    return (pa.concat_arrays(found), np.concatenate(of)) if len(found) > 1 else (words, doc)


def _count(most: int):
    def run(batches):
        made = 0
        for batch in batches:
            for lo, hi, data, offs in vt.slices(batch.column(1), BLOCK):
                block, made, k = (TaskContext.get().partitionId() << 33) + made, made + 1, hi - lo
                words, doc = word_array(vt.LOWER[data], offs)
                feats, of = runs(words, doc, most)
                coded = feats.dictionary_encode()
                names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pairs, times = np.unique(of * max(1, len(names)) + code, return_counts=True)
                spans = np.searchsorted(pairs, np.arange(k + 1) * max(1, len(names))).astype(np.int32)
                numbers = (pairs % max(1, len(names))).astype(np.int32)
                totals = np.bincount(code, minlength=len(names))
                lists = lambda flat, spans=spans: pa.ListArray.from_arrays(pa.array(spans), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(k, block)), pa.array(np.arange(lo, hi, dtype=np.int32)), batch.column(0).slice(lo, k), pa.array(np.bincount(doc, minlength=k)), pa.array(np.bincount(of, minlength=k)),
                    lists(numbers), lists(times), pa.nulls(k, pa.list_(pa.string())), pa.nulls(k, pa.list_(pa.int64()))], [f.split()[0] for f in _ROW.split(", ")])
                if len(names):
                    one = lambda flat: pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
                    null = lambda kind: pa.nulls(1, kind)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block]), null(pa.int32()), null(pa.int64()), null(pa.int64()), null(pa.int64()), null(pa.list_(pa.int32())), null(pa.list_(pa.int32())), one(names.cast(pa.string())), one(pa.array(totals))],
                        [f.split()[0] for f in _ROW.split(", ")])
    return run


def counted(docs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text), written once: (block, row, doc_id, n_words, n_features, numbers, times), and (of_block, number, feature, total)."""
    both = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count(most), _ROW), "counted")
    listed = both.where("features is not null").select("block", F.posexplode(F.arrays_zip("features", "totals")).alias("number", "f"))
    return both.where("features is null").drop("features", "totals"), listed.select(F.col("block").alias("of_block"), "number", F.col("f.features").alias("feature"), F.col("f.totals").alias("total"))


def dictionary(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(feature, bucket, s, t): every distinct feature once, with its bucket and its counts in corpus and target, both (feature, total)."""
    none = F.lit(0).cast("long")
    both = corpus.select("feature", F.col("total").alias("s"), none.alias("t")).union(target.select("feature", none, F.col("total")))
    return both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).select("feature", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int").alias("bucket"), "s", "t")


def gains(words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of a dictionary: floor(1000 ln of how much likelier the target holds the bucket), each side with one added to every bucket."""
    sums = words.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))  # `buckets` rows at most
    whole = words.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    gain = F.floor(1000 * F.log((d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))))
    return sums.join(F.broadcast(whole)).select("bucket", gain.cast("long").alias("gain"))  # whole is one row


def _weigh(rows: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one block with their weights, from the gains of its features by number."""
    gain = np.zeros(found.num_rows, np.int64)
    gain[found["number"].to_numpy()] = found["gain"].to_numpy()
    rows = rows.combine_chunks()
    numbers, times = rows["numbers"].combine_chunks(), rows["times"].combine_chunks()
    numbers, times = (x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else x for x in (numbers, times))
    spans = np.asarray(numbers.offsets)[:len(numbers) + 1] if len(numbers) else np.zeros(1, np.int64)
    parts = gain[np.asarray(numbers.flatten())] * np.asarray(times.flatten()).astype(np.int64) if len(numbers) else np.zeros(0, np.int64)
    weight = vt.sums_by(parts, spans - spans[0])
    return rows.select(["doc_id", "n_words", "n_features", "block", "row"]).append_column("weight", pa.array(weight, pa.int64()))


def weights(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, block, row, weight) of docs (doc_id, text), towards the texts of target (text)."""
    rows, listed = counted(docs, most)
    _, wanted = counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), most)
    words = materialize(dictionary(listed, wanted, buckets), "dictionary")
    valued = words.where("s > 0").join(F.broadcast(gains(words, buckets)), "bucket").select("feature", "gain")  # `buckets` rows at most
    found = listed.join(valued, "feature").select("of_block", "number", "gain")
    return rows.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_weigh, "doc_id long, n_words long, n_features long, block long, row int, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in a total order: sorted by ranges, written, and counted from the rows of the ranges before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "placed")
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()  # one row a range
    before, base = 0, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        base.append((r["_part"], before))
        before += r["n"]
    bases = F.broadcast(df.sparkSession.createDataFrame(base, "_part long, _before long"))
    return dealt.withColumn("_part", part).join(bases, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, most: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs: `percent` of the documents with at least `least` words are drawn and have a rank."""
    scored = materialize(weights(docs, target, most, buckets), "weights").withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "fit": F.col("n_words") >= least})
    draw = percent * scored.where("fit").count() // 100
    ordered = placed(scored, [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("block"), F.asc("row")])
    return ordered.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("place") <= draw), F.col("place")).alias("rank"))


def op12_feature_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's words."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_BYTES = "list_transform(range(1, 2 * strlen(w) + 1, 2), lambda i: cast('0x' || substr(hex(encode(w)), i, 2) as bigint))"
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op12_feature_dictionary": op12_feature_dictionary}
ORACLE = {"op12_feature_dictionary": f"""
with c as (select list(list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as crc from range(256) r(n)),
d as (select row_number() over () as row, doc_id, coalesce({_WORDS}, []) as ws from documents),
dw as (select row, unnest(ws) as w from d), bw as (select unnest({_WORDS}) as w from benchmark),
n as (select w, sum(s) as s, sum(t) as t from (select w, 1 as s, 0 as t from dw union all select w, 0, 1 from bw) group by 1),
b as (select w, s, t, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda h, x: xor(h >> 8, crc[(xor(h, x) & 255) + 1])), 4294967295) % 10000 as bucket from n, c),
g as (select bucket, cast(floor(1000 * ln((sum(t)::double + 1) * ((select sum(s)::double from b) + 10000) / ((sum(s)::double + 1) * ((select sum(t)::double from b) + 10000)))) as bigint) as gain from b group by 1),
x as (select row, sum(gain) as weight from dw join b using (w) join g using (bucket) group by 1),
s as (select d.row, doc_id, cast(len(ws) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight from d left join x on d.row = x.row),
k as (select *, weight + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score from s),
r as (select row, row_number() over (order by score desc, doc_id nulls last, row) as rank from k where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * (select count(*) from r) // 100 then rank end as rank from k left join r using (row)
"""}

"""Exact top-k inner products with norm buckets.

Vectors are grouped by length into buckets and packed into blocks. A task meets one block of queries with one lane of candidate blocks, the
longest first, and keeps the k best of each query. With the k-th best score as threshold t, a bucket of lengths up to l can only help a query q where
the cosine reaches t / (|q| l): beyond 1 the bucket is skipped. Otherwise a high local threshold prunes by coordinates (on the query's largest coordinate, a candidate's must lie
in the interval that the cosine allows), a low one by length alone; what is left is verified by integer products.

Blocks are rows, so nothing is paired vector by vector, and every block is bounded. All query blocks first meet the few blocks of longest vectors, which gives thresholds
that all lanes start from; then each query block meets, once, each other candidate block whose longest vector can still matter to one of its queries.

Scores are exact: products and sums that fit a double's 53 bits are taken in doubles, larger ones in integers without bound.

Defined cases: vectors that are null, empty or hold null, NaN or infinite components take no part, nor does a null vec_id; components beyond 64 bits after scaling are held at its ends, and so is a
score in the result (its rank is by the whole value of up to 38 digits, then ties go by vec_id); vectors of another number of components than a query's are no candidates of it;
ties go to the smaller vec_id; a repeated vec_id is a candidate once for each row, but not for its own id; other columns are ignored.
"""
from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table

#: Vectors in a block, queries in a block, lanes of candidate blocks for each query block, buckets for each doubling of length, blocks of longest vectors that all queries meet first.
BLOCK, QUERIES_IN_BLOCK, LANES, BUCKETS, FIRST = 4096, 8192, 48, 4, 4
#: Local cosine threshold from which coordinates prune.
HIGH = 0.8


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v, dims, bucket) of the valid vectors; bucket is larger for shorter vectors."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    bad = (F.size("x") == 0) | F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~bad)
    v = F.transform("x", lambda c: F.floor(c * scale).cast("long"))
    square = F.aggregate(v, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    bucket = F.lit(2000) - F.floor(F.log2(F.greatest(square, F.lit(1.0))) / 2 * BUCKETS)
    return rows.select("vec_id", v.alias("v"), F.size("x").alias("dims"), bucket.cast("int").alias("bucket"))


def _pack(most: int):
    """Rows of one bucket and number of components in blocks of at most `most`, with their greatest length."""
    def run(batches):
        held: dict[tuple[int, int], list[tuple[int, list[int]]]] = {}

        def block(key):
            rows = held.pop(key)
            ids, v = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).reshape(len(rows), key[1])
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([float(lengths(v).max())]), pa.array([ids.tobytes()]), pa.array([v.tobytes()])], ["bucket", "dims", "longest", "ids", "v"])

        for batch in batches:
            for i, v, dims, bucket in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                held.setdefault((bucket, dims), []).append((i, v))
                if len(held[bucket, dims]) >= most:
                    yield block((bucket, dims))
        for key in sorted(held):
            yield block(key)
    return run


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(float) ** 2).sum(1))


def _large(v: np.ndarray) -> float:
    return float(np.abs(v.astype(float)).max(initial=0))


class _Best:
    """The k best of each query of a block: lists of (-score, id, new), so the first is the best; new is 0 for what was found before this block of queries began. Floors are doubles a little too low rather than too high."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.norm, self.large = lengths(v), _large(v)
        self.focus = np.abs(v.astype(float)).argmax(1)
        self.got: list[list[tuple[int, int, int]]] = [[] for _ in ids]
        self.floor = np.full(len(v), -np.inf)

    def start(self, got: list[list[tuple[int, int, int]]]) -> None:
        for q, rows in enumerate(got):
            self._keep(q, rows)

    def need(self) -> float:
        """The least length that a vector must have to matter to any query."""
        with np.errstate(divide="ignore", invalid="ignore"):
            each = np.where(self.floor > 0, np.where(self.norm > 0, self.floor / self.norm, np.inf), 0.0)
        return float(each.min(initial=np.inf)) * (1 - 1e-9)

    def _keep(self, q: int, rows: list[tuple[int, int, int]]) -> None:
        self.got[q] = sorted([*self.got[q], *rows])[:self.k]
        if len(self.got[q]) == self.k:
            low = float(-self.got[q][-1][0])
            self.floor[q] = low - abs(low) * 1e-12

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        norm = lengths(v)
        longest = norm.max(initial=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(np.isfinite(self.floor), np.where(self.norm * longest > 0, self.floor / (self.norm * longest), np.where(self.floor > 0, 2.0, -1.0)), -1.0)
        rest = np.flatnonzero(local <= 1 + 1e-9)
        if not len(rest):
            return
        wide = rest[local[rest] < HIGH]
        for lo in range(0, len(wide), 256):
            q = wide[lo:lo + 256]
            # length pruning for the whole slice: the least length that any of its queries needs
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where((self.floor[q] > 0) & (self.norm[q] > 0), self.floor[q] / self.norm[q], 0).min()
            self._verify(q, np.flatnonzero(norm >= need * (1 - 1e-9)), ids, v)
        unit = v / np.maximum(norm, 1e-300)[:, None]
        for q in rest[local[rest] >= HIGH].tolist():
            f, t = self.focus[q], min(1.0, local[q])
            x = self.v[q, f] / max(self.norm[q], 1e-300)
            spread = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(max(0.0, 1 - x * x)) + 1e-9
            c = np.flatnonzero((unit[:, f] >= t * x - spread if x >= 0 else unit[:, f] <= t * x + spread) | (norm == 0))
            self._verify(np.array([q]), c, ids, v)

    def _verify(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        if not len(c):
            return
        if self.large * _large(v[c]) * v.shape[1] < 2.0 ** 53:
            score = self.v[q].astype(float) @ v[c].astype(float).T
            rough = score
        else:
            score = self.v[q].astype(object) @ v[c].astype(object).T
            rough = score.astype(float)
        own = self.ids[q][:, None] == ids[c][None, :]
        hits = (rough >= self.floor[q][:, None]) & ~own
        for j in np.flatnonzero(hits.any(1)).tolist():
            hit = np.flatnonzero(hits[j])
            if len(hit) > 4 * self.k:  # more than k above the k-th best: the others can't stay
                cut = np.partition(rough[j][hit], len(hit) - self.k)[len(hit) - self.k]
                hit = hit[rough[j][hit] >= cut - abs(cut) * 1e-12]
            self._keep(q[j], [(-int(s), int(i), 1) for s, i in zip(score[j][hit].tolist(), ids[c][hit].tolist(), strict=True)])


_ENDS, _DIGITS = (-(1 << 63), (1 << 63) - 1), 10 ** 38 - 1


def _search(k: int):
    """The blocks of a (qblock, lane), queries first: (query_id, vec_id, whole score as text). Lane 0 also hands on what was found before."""
    def run(batches):
        best, at = None, None

        def rows():
            out = [(q, i, str(max(-_DIGITS, min(_DIGITS, -s)))) for q, got in zip(best.ids.tolist(), best.got, strict=True) for s, i, new in got if new or at[1] == 0]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["query_id", "vec_id", "whole"])

        for batch in batches:
            for q, lane, dims, ids, v, got in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("qblock", "lane", "dims", "ids", "v", "got")), strict=True):
                ids, v = np.frombuffer(ids, np.int64), np.frombuffer(v, np.int64).reshape(-1, dims)
                if got is not None:
                    if best:
                        yield rows()
                    best, at = _Best(ids, v, k), (q, lane)
                    best.start([[(-int(s), i, 0) for i, s in x] for x in json.loads(got)])
                elif at == (q, lane):
                    best.meet(ids, v)
        if best:
            yield rows()
    return run


def _first(k: int):
    """A query block and one of the blocks of longest vectors: the query block with what it found there and what its vectors must be as long as."""
    def run(batches):
        for batch in batches:
            for q, dims, ids, v, cids, cv in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("qblock", "dims", "ids", "v", "c_ids", "c_v")), strict=True):
                best = _Best(np.frombuffer(ids, np.int64), np.frombuffer(v, np.int64).reshape(-1, dims), k)
                best.meet(np.frombuffer(cids, np.int64), np.frombuffer(cv, np.int64).reshape(-1, dims))
                got = json.dumps([[(i, str(-s)) for s, i, _ in x] for x in best.got])
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([best.need()]), pa.array([got])], ["qblock", "need", "got"])
    return run


def _join_first(k: int):
    """Lists of one query block's finds in several blocks as one."""
    def run(batches):
        for batch in batches:
            for q, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lists = [json.loads(x) for x in found]
                best = [sorted(((int(s), i) for one in lists for i, s in one[n]), key=lambda r: (-r[0], r[1]))[:k] for n in range(len(lists[0]))]
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([json.dumps([[(i, str(s)) for s, i in x] for x in best])])], ["qblock", "got"])
    return run


def top_k(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row whose vec_id is divisible by `every`."""
    block = "bucket int, dims int, longest double, ids binary, v binary"
    rows = quantized(vectors)
    blocks = materialize(rows.mapInArrow(_pack(BLOCK), block).withColumn("number", F.monotonically_increasing_id()), "blocks")
    asking = rows.where(F.col("vec_id") % every == 0)
    # queries of all lengths share blocks, so few blocks meet the candidates
    tasks = max(1, -(-asking.count() // QUERIES_IN_BLOCK))
    queries = materialize(asking.withColumn("bucket", F.lit(0)).coalesce(tasks).mapInArrow(_pack(QUERIES_IN_BLOCK), block).select(F.monotonically_increasing_id().alias("qblock"), "dims", "ids", "v"), "queries")
    nth = F.row_number().over(Window.partitionBy("dims").orderBy("bucket", F.desc("longest"), "number"))
    first = materialize(blocks.select("number", "dims", "bucket", "longest").withColumn("nth", nth).where(F.col("nth") <= FIRST).select("number", F.col("dims").alias("d")), "first")
    pairs = queries.select("qblock", F.col("dims").alias("d")).join(first, "d").select("qblock", "number")  # numbers alone
    probes = pairs.join(blocks.select("number", F.col("ids").alias("c_ids"), F.col("v").alias("c_v")), "number")
    primed = probes.join(queries, "qblock").select("qblock", "dims", "ids", "v", "c_ids", "c_v").mapInArrow(_first(k), "qblock long, need double, got string")
    primed = materialize(primed, "primed").groupBy("qblock").agg(F.collect_list("got").alias("found"), F.max("need").alias("need"))  # FIRST rows each
    gots = primed.select("qblock", "found").mapInArrow(_join_first(k), "qblock long, got string").join(primed.select("qblock", "need"), "qblock")
    queries = materialize(queries.join(gots, "qblock"), "queries")
    spread = queries.select("qblock", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"), F.lit(-1).alias("bucket"), "dims", "ids", "v", "got")
    # each candidate block that may matter goes to one lane of every query block of its number of components
    ids = queries.select("qblock", F.col("dims").alias("d"), "need")
    pairs = blocks.select("number", "dims", "longest").join(first.select("number"), "number", "left_anti").join(ids, (F.col("dims") == F.col("d")) & (F.col("longest") >= F.col("need"))).select("number", "qblock")
    met = pairs.join(blocks, "number").select("qblock", F.pmod(F.xxhash64("number"), F.lit(LANES)).cast("int").alias("lane"), "bucket", "dims", "ids", "v", F.lit(None).cast("string").alias("got"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.unionByName(met).repartition(parts, "qblock", "lane").sortWithinPartitions("qblock", "lane", "bucket")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, whole string")
    score = F.col("whole").cast("decimal(38,0)")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id"))
    ranked = found.withColumn("exact", score).withColumn("rank", rank).where(F.col("rank") <= k)
    held = F.least(F.greatest("exact", F.lit(str(_ENDS[0])).cast("decimal(38,0)")), F.lit(str(_ENDS[1])).cast("decimal(38,0)"))
    return ranked.select("query_id", "rank", "vec_id", held.cast("long").alias("score"))


def op10_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best for every fiftieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), 5, 50)


QUERIES = {"op10_norm_buckets": op10_norm_buckets}
ORACLE = {"op10_norm_buckets": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""}

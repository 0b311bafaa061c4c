"""Exact cosine search of many questions at once over vectors in cells.

Cells are the nearest of some centres, found by spherical k-means on a bounded sample. Within a cell vectors are ordered by their angle to the centre and cut into blocks, so a block is a ring with a least and a greatest angle.
No vector of a ring is nearer to a question than the question's own angle to the centre differs from the ring's (angles obey the triangle inequality). Questions are put into rings of their own, batches.

Batches and rings are dealt into groups, and each group of batches meets each group of rings in one place of a grid: a task holds the batches there, sees the rings one by one and keeps the best of each question, which are
what to beat; a ring is passed over by each question for which it can't hold better ones or equal ones. So the answer is that of brute force, whatever the centres are, and what travels is the rings once for each group of batches and the
batches once for each group of rings, not a ring for each batch. A batch meets a ring in single precision first, in which a product takes a third of the time; what could be among the best by its largest error is worked out in double precision.

A question starts from what its best in a part of the sample are alike at least, so that no group of rings begins with nothing to beat. The sample is SAMPLE vectors at most and the centres CELLS: both are bounded, whatever the input. Rings and batches are rows of bounded size, a cell that holds a third of all vectors is many rows, and a group of batches holds about HELD bytes.

Vectors and questions that are null, of length 0, or hold null or no number take no part, nor do vectors of another length than the centres.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Vectors that the centres are fitted to at most, centres at most, rounds of k-means, vectors in a ring, questions in a batch.
SAMPLE, CELLS, ROUNDS, RING, BATCH = 20_000, 64, 8, 2048, 256
#: Vectors of the sample that questions start from, at most.
SEEN = 4096
#: Bytes of vectors in a group of batches, about, and places of the grid for each core.
HELD, PLACES = 1 << 27, 8
#: What angles and scores may be off by.
EPS = 1e-9


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) with v of doubles, of rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("key"), v.alias("v")).where("key is not null and v is not null")
    return rows.where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _unit(rows: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither vanish nor overflow
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def sample(vectors: DataFrame, seed: int = 7) -> np.ndarray:
    """The SAMPLE rows of least hash of vectors (key, v), at unit length; those of the most frequent length among them."""
    got = vectors.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(SAMPLE).collect()  # SAMPLE rows at most
    if not got:
        return np.zeros((0, 0))
    sizes, n = np.unique([len(r.v) for r in got], return_counts=True)
    return _unit(np.array([r.v for r in got if len(r.v) == sizes[n.argmax()]]))


def centres(x: np.ndarray, cells: int = CELLS, seed: int = 7) -> np.ndarray:
    """Unit centres of unit vectors, by spherical k-means."""
    if not len(x):
        return x
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = np.abs(sums).max(1) > EPS
        c[full] = _unit(sums[full])
    return np.unique(c, axis=0)


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of `dims` numbers as unit vectors, and which they are."""
    at = np.flatnonzero(np.asarray(column.value_lengths()) == dims)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float)
    return (_unit(flat.reshape(-1, dims)) if len(at) else np.zeros((0, dims))), at


def _angles(c: np.ndarray):
    def run(batches):
        for batch in batches:
            x, at = _matrix(batch.column(1), c.shape[1])
            if len(at):
                cos = x @ c.T
                near = cos.argmax(1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * c.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(np.arccos(np.clip(cos[np.arange(len(at)), near], -1, 1))), batch.column(0).take(pa.array(at)), flat], ["cell", "angle", "key", "v"])
    return run


_RING = "cell int, ring long, low double, high double, keys binary, vectors binary"


def _rings(size: int):
    """Sorted rows of a cell after another in rings of at most `size`."""
    def run(batches):
        made, cell, held = TaskContext.get().partitionId() << 33, None, []

        def ring():
            nonlocal made, held
            angles, keys, v = (np.concatenate(x) for x in zip(*held, strict=True))
            made, held = made + 1, []
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([made - 1]), pa.array([angles.min()]), pa.array([angles.max()]), pa.array([keys.tobytes()]), pa.array([v.tobytes()])], ["cell", "ring", "low", "high", "keys", "vectors"])

        for batch in batches:
            cells, angles, keys = (batch.column(i).to_numpy() for i in range(3))
            v = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            at = 0
            while at < batch.num_rows:
                if held and (cells[at] != cell or sum(len(h[0]) for h in held) >= size):
                    yield ring()
                cell = int(cells[at])
                room = size - sum(len(h[0]) for h in held)
                end = min(at + room, at + int(np.argmax(np.append(cells[at:] != cell, True))))
                held.append((angles[at:end], keys[at:end], v[at:end]))
                at = end
        if held:
            yield ring()
    return run


class Cells:
    """An index of vectors by a column key of whole numbers."""

    def __init__(self, vectors: DataFrame, key: str, vector: str, cells: int = CELLS, ring: int = RING):
        # written as they are: a condition would make them again, should they be made by a function
        rows = _valid(written(vectors.select(key, vector), "vectors"), key, vector)
        self.key, self.spark, self.sample = key, vectors.sparkSession, sample(rows)
        self.centres = centres(self.sample, cells)
        self.rings = self._in_rings(rows, ring, "rings")

    def _in_rings(self, rows: DataFrame, size: int, name: str) -> DataFrame:
        """Rows (key, v) in rings of at most `size`, written. Equal vectors come in order of key."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.mapInArrow(_angles(self.centres), "cell int, angle double, key long, v array<double>") if len(self.centres) else rows.where("false").select(F.lit(0).alias("cell"), F.lit(0.0).alias("angle"), "key", "v")
        return written(placed.repartitionByRange(parts, "cell", "angle", "key").sortWithinPartitions("cell", "angle", "key").mapInArrow(_rings(size), _RING), name)

    def search(self, questions: DataFrame, question: str, vector: str, k: int, batch: int = BATCH, held: int = HELD) -> DataFrame:
        """(question, key, score): the k vectors of highest cosine for each question, clamped to 0..1, in ten-thousandths, equal ones by key."""
        schema = f"{question} long, {self.key} long, score long"
        if not len(self.centres):
            return self.spark.createDataFrame([], schema)
        asked = self._in_rings(_valid(written(questions.select(question, vector), "questions"), question, vector), batch, "batches")
        best = self._dealt(asked, held).mapInArrow(_best(k, self.centres, self.sample[:SEEN].astype(np.float32)), "batch long, at int, id long, key long, score long")
        nth = F.row_number().over(Window.partitionBy("batch", "at").orderBy(F.desc("score"), "key"))
        return best.withColumn("nth", nth).where(F.col("nth") <= k).select(F.col("id").alias(question), F.col("key").alias(self.key), "score")

    def _dealt(self, asked: DataFrame, held: int) -> DataFrame:
        """Batches (kind 0) and rings (kind 1) dealt to the places of the grid, in order."""
        size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("vectors")), F.lit(0)).alias("bytes")).head()
        places = PLACES * self.spark.sparkContext.defaultParallelism
        across = max(1, -(-size.bytes // held), min(size.n, round(places**0.5)))
        down = max(1, min(self.rings.count(), -(-places // across)))
        group = lambda n: F.pmod(F.xxhash64("ring"), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        a = asked.select("*", F.lit(0).alias("kind"), group(across).alias("q"), every(down).alias("r"))
        b = self.rings.select("*", F.lit(1).alias("kind"), every(across).alias("q"), group(down).alias("r"))
        grid = a.unionByName(b).withColumn("place", F.col("q") * down + F.col("r")).drop("q", "r")
        return grid.repartitionByRange(across * down, "place").sortWithinPartitions("place", "kind", "ring")


class _Batch:
    """Questions and the k best of each so far; a score of -1 stands for none."""

    def __init__(self, number: int, ids: np.ndarray, x: np.ndarray, k: int, c: np.ndarray, seen: np.ndarray):
        """seen: some of the vectors that will be met in one place or another, in single precision."""
        self.number, self.ids, self.x, self.single, self.k = number, ids, x, x.astype(np.float32), k
        # of a product of unit vectors in single precision, whatever the order of its sum
        self.off = EPS + (x.shape[1] + 8) * 2.0**-24
        self.angles = np.arccos(np.clip(c @ x.T, -1, 1))
        self.scores, self.keys = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), -np.inf)
        if len(seen) >= 16 * k:
            # the best of each of k parts: k vectors are that near
            cos = (self.single @ seen[:len(seen) // k * k].T).reshape(len(ids), k, -1).max(2).min(1)
            score = np.floor(np.clip(cos - self.off, 0, 1) * 10000 + 0.5)
            self.floor = np.where(score <= 0, -np.inf, (score - 0.5) / 10000)
        self.least = self.floor.copy()

    def meet(self, cell: int, low: float, high: float, keys: np.ndarray, others: np.ndarray, single: np.ndarray, rank: np.ndarray) -> None:
        """rank: the places of the keys in descending order, so that of equal scores the least key is the highest number. single: the others in single precision."""
        miss = np.maximum(self.angles[cell] - high, low - self.angles[cell])
        here = np.flatnonzero(np.cos(np.maximum(miss - EPS, 0)) >= self.least - EPS)
        if not len(here):
            return
        cos, least = self.single[here] @ single.T, (self.least[here] - self.off).astype(np.float32)
        at = np.flatnonzero(cos.max(1) >= least)
        if not len(at):
            return
        may, at = cos[at] >= least[at, None], here[at]
        many = may.sum(1) * 4 > len(keys)
        if many.any():
            self._all(at[many], keys, others, rank)
        if not many.all():
            row, col = np.divmod(np.flatnonzero(may[~many] if many.any() else may), len(keys))
            self._some(at[~many][row], col, keys, others)

    def _all(self, at: np.ndarray, keys: np.ndarray, others: np.ndarray, rank: np.ndarray) -> None:
        """Some questions beside all of a ring."""
        score = np.floor(np.clip(self.x[at] @ others.T, 0, 1) * 10000 + 0.5).astype(np.int64)
        n = len(keys)
        top = np.argpartition(score * n + rank, n - self.k, 1)[:, n - self.k:] if n > self.k else np.broadcast_to(np.arange(n), score.shape)
        scores = np.concatenate([self.scores[at], np.take_along_axis(score, top, 1)], 1)
        found = np.concatenate([self.keys[at], keys[top]], 1)
        order = np.lexsort((found, -scores), axis=-1)[:, :self.k]
        self._keep(at, np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1))

    def _some(self, row: np.ndarray, col: np.ndarray, keys: np.ndarray, others: np.ndarray) -> None:
        """Pairs of a question and one of a ring, by question."""
        score = np.floor(np.clip(np.einsum("ij,ij->i", self.x[row], others[col]), 0, 1) * 10000 + 0.5).astype(np.int64)
        at = np.unique(row)
        rows, scores, found = np.concatenate([np.repeat(at, self.k), row]), np.concatenate([self.scores[at].ravel(), score]), np.concatenate([self.keys[at].ravel(), keys[col]])
        order = np.lexsort((found, -scores, rows))
        first = np.searchsorted(rows[order], at)
        order = order[first[:, None] + np.arange(self.k)]  # a question has k already
        self._keep(at, scores[order], found[order])

    def _keep(self, at: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        self.scores[at], self.keys[at] = scores, keys
        # a score of 0 holds all angles from a right one on
        self.least[at] = np.maximum(self.floor[at], np.where(scores[:, -1] <= 0, -np.inf, (scores[:, -1] - 0.5) / 10000))

    def rows(self) -> pa.RecordBatch:
        row, nth = np.nonzero(self.scores >= 0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), self.number)), pa.array(row.astype(np.int32)), pa.array(self.ids[row]), pa.array(self.keys[row, nth]), pa.array(self.scores[row, nth])], ["batch", "at", "id", "key", "score"])


def _columns(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(batch.schema.get_field_index(n)) for n in names), strict=True)


def _best(k: int, c: np.ndarray, seen: np.ndarray):
    """Rows of a place after another, its batches before its rings."""
    dims = c.shape[1]

    def run(batches):
        place, held = None, []
        for batch in batches:
            for p, kind, ring, cell, low, high, keys, vectors in _columns(batch, "place", "kind", "ring", "cell", "low", "high", "keys", "vectors"):
                if p.as_py() != place:
                    yield from (b.rows() for b in held)
                    place, held = p.as_py(), []
                keys, x = np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(vectors.as_buffer()).reshape(-1, dims)
                if kind.as_py() == 0:
                    held.append(_Batch(ring.as_py(), keys.copy(), x.copy(), k, c, seen))
                    continue
                rank = np.empty(len(keys), np.int64)
                rank[np.argsort(keys, kind="stable")[::-1]] = np.arange(len(keys))
                single = x.astype(np.float32)
                for b in held:
                    b.meet(cell.as_py(), low.as_py(), high.as_py(), keys, x, single, rank)
        yield from (b.rows() for b in held)
    return run

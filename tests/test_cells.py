"""Vectors in cells: what is made once, and what single precision may not lose."""
import numpy as np
import pytest
from loam.operators import cells

from pyspark.sql import functions as F


def test_vectors_of_a_function_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(n):
        made.add(1)
        return [float(n % 7), float(n % 3), 1.0]

    rows = lambda n: spark.range(n).select("id", vector("id").alias("v"))
    got = cells.Cells(rows(60), "id", "v").search(rows(20).withColumnRenamed("id", "q"), "q", "v", 3).collect()
    assert len(got) == 60 and made.value == 60 + 20


@pytest.mark.parametrize("starts", [True, False])
def test_single_precision_loses_nothing(monkeypatch, starts):
    rng = np.random.default_rng(8)
    base = cells._unit(rng.normal(size=(40, 64)))
    # copies that differ beyond single precision, at scores that differ by rounding
    others = cells._unit(np.repeat(base, 60, 0) + 1e-8 * rng.normal(size=(2400, 64)))
    keys = rng.permutation(2400)
    others = others[rng.permutation(2400)]
    asked = cells._unit(np.concatenate([base[:20] + 0.1 * rng.normal(size=(20, 64)), -base[:3], base[:3]]))
    c, k, dense = base[:4], 5, []
    real = cells._Batch._all
    monkeypatch.setattr(cells._Batch, "_all", lambda self, at, *rest: (dense.append(len(at)), real(self, at, *rest)))
    batch = cells._Batch(0, np.arange(26), asked, k, c, (others if starts else others[:0]).astype(np.float32))
    angles = np.arccos(np.clip(others @ c.T, -1, 1))
    near = angles.argmin(1)
    for cell in range(4):
        at = np.flatnonzero(near == cell)
        for part in np.array_split(at[np.argsort(angles[at, cell])], 6):
            rank = np.empty(len(part), np.int64)
            rank[np.argsort(keys[part])[::-1]] = np.arange(len(part))
            batch.meet(cell, angles[part, cell].min(), angles[part, cell].max(), keys[part], others[part], others[part].astype(np.float32), rank)
    score = np.floor(np.clip(asked @ others.T, 0, 1) * 10000 + 0.5).astype(np.int64)
    want = [sorted(zip((-row).tolist(), keys.tolist(), strict=True))[:k] for row in score]
    rows = batch.rows().to_pydict()
    got = [[] for _ in asked]
    for at, key, s in zip(rows["at"], rows["key"], rows["score"], strict=True):
        got[at].append((-s, key))
    assert [sorted(x) for x in got] == want
    assert bool(dense) and (not starts or sum(dense) < 24 * len(asked) / 4)

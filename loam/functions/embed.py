"""Embedders: a model that is made once in each Python worker and sees texts in batches, with hashed vectors where it fails."""
from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from .hashing import hash_embedding, hashed_vectors

#: From texts to one row of numbers each.
Model = Callable[[list[str]], np.ndarray]
_RESULT = StructType([StructField("embedding", ArrayType(FloatType())), StructField("fell_back", IntegerType())])


def semantic(load: Callable[[], Model], dim: int, batch_size: int = 64) -> Callable[[Column], Column]:
    """An embedder around the model that load() makes: (embedding, fell_back). A batch whose call fails, or gives anything but one finite vector of `dim` numbers for each text, gets hashed vectors and says so; so does every
    batch of a worker whose model can't be made. A null text is embedded as an empty one."""
    def make():
        try:
            model = load()
        except Exception:  # noqa: BLE001  whatever a model fails by, texts are embedded
            model = None

        def predict(texts: np.ndarray) -> dict[str, np.ndarray]:
            given = ["" if t is None else str(t) for t in np.asarray(texts, object).ravel().tolist()]
            try:
                out = np.asarray(model(given), np.float32)
                good = out.shape == (len(given), dim) and bool(np.isfinite(out).all())
            except Exception:  # noqa: BLE001
                good = False
            if not good:
                out = hashed_vectors(pd.Series(given), dim)
            return {"embedding": out, "fell_back": np.full(len(given), int(not good), np.int32)}
        return predict
    udf = predict_batch_udf(make, return_type=_RESULT, batch_size=batch_size)
    return lambda c: udf(F.coalesce(c, F.lit("")))


def embedder(kind: str, dim: int, load: Callable[[], Model] | None = None, batch_size: int = 64) -> Callable[[Column], Column]:
    """The embedder of a name: `semantic` where a model is given, else `hash`; both give (embedding, fell_back)."""
    if kind not in ("semantic", "hash"):
        raise ValueError(f"no embedder is called {kind}")
    if kind == "semantic" and load:
        return semantic(load, dim, batch_size)
    return lambda c: F.struct(hash_embedding(c, dim).alias("embedding"), F.lit(int(kind == "semantic")).alias("fell_back"))


def vowels() -> Model:
    """A toy model: how often each of five letters occurs."""
    return lambda texts: np.array([[len(re.findall(v, t)) for v in "aeiou"] for t in texts], float).reshape(-1, 5)

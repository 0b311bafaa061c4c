"""Embedders that fail, and the checks and repair of model outputs."""
import json
import os

import numpy as np
import pytest
from loam.functions import embed, hashing, outputs

from pyspark.sql import functions as F


def test_a_model_is_made_once_and_may_fail(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(texts):
            if "bad" in texts:
                raise OSError("down")
            if "odd" in texts:
                return np.zeros((len(texts), 2))
            return np.array([[len(t), 1, float("nan") if t == "nan" else 2] for t in texts], float)
        return model
    texts = ["a", "bb", None, "", "bad", "c", "odd", "dddd", "nan", "e", "ff", "g"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(1).sortWithinPartitions("i")
    got = {r.i: (list(r.e.embedding), r.e.fell_back) for r in df.select("i", embed.embedder("semantic", 3, load, 2)(F.col("s")).alias("e")).collect()}
    # batches of two: those with a text that breaks the model fall back, the others don't
    broken = {4, 5, 6, 7, 8, 9}
    hashed = {r.i: list(r.v) for r in df.select("i", hashing.hash_embedding(F.coalesce("s", F.lit("")), 3).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ((hashed[i], 1) if i in broken else ([len(t or ""), 1.0, 2.0], 0))
    assert len(open(log).read().split()) == len(set(open(log).read().split())) == 1

    def never():
        raise ImportError("no model here")
    assert {r.e.fell_back for r in df.select(embed.embedder("semantic", 3, never)(F.col("s")).alias("e")).collect()} == {1}
    assert {r.e.fell_back for r in df.select(embed.embedder("hash", 3)(F.col("s")).alias("e")).collect()} == {0}
    assert {r.e.fell_back for r in df.select(embed.embedder("semantic", 3)(F.col("s")).alias("e")).collect()} == {1}
    with pytest.raises(ValueError):
        embed.embedder("other", 3)


def test_what_is_wrong_with_a_text(spark):
    cases = {
        '{"summary": "x"}': [], '{"summary": ""}': ["summary: short"], '{"summary": 3}': ["summary: kind"], "{}": ["summary: missing"], '{"summary": null}': ["summary: missing"],
        '{"summary": "x", "confidence": 1.5}': ["confidence: range"], '{"summary": "x", "confidence": "0.5"}': [], '{"summary": "x", "confidence": "much"}': ["confidence: kind"], '{"summary": "x", "confidence": -1}': ["confidence: range"],
        '{"summary": "x", "mitigations": ["a", "b"], "patch_urls": []}': [], '{"summary": "x", "mitigations": [1]}': ["mitigations: kind"], '{"summary": "x", "mitigations": "a"}': ["mitigations: kind"],
        '{"summary": "x", "b": 1, "a": {}}': ["a: unknown", "b: unknown"], "[1]": ["no object"], '"text"': ["no object"], "{broken": ["not JSON"], "": ["not JSON"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.x for r in df.select("raw", outputs.violations(F.try_parse_json("raw"), outputs.REMEDIATION).alias("x")).collect()}
    assert got == cases


def test_outputs_lose_only_what_is_wrong(spark):
    base = {"vuln_id": "V", "review_status": "revised", "confidence": 0.9}
    advice = {"summary": "s"}
    cases = [
        ({**base, "remediation": advice, "remediation_json": json.dumps(advice)}, (1, "revised", 0.9, True, 0)), ({**base, "remediation_json": '{"summary": 1}'}, (2, "revised", 0.9, False, 1)), ({**base, "remediation": {"summary": "s", "x": 1}}, (2, "revised", 0.9, False, 1)),
        ({**base, "confidence": 7}, (3, "needs_human", 0.0, False, 2)), ({**base, "confidence": 7, "remediation": advice}, (3, "needs_human", 0.0, False, 2)), ({**base, "errors": "none"}, (4, "needs_human", 0.0, False, 3)), ({"vuln_id": "V", "confidence": 0.2}, (1, "auto_pass", 0.2, False, 0)),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(90, "nothing"), (91, None), (92, '{"vuln_id": ""}'), (93, '{"vuln_id": 5}')], "i int, raw string")
    used, refused = outputs.repaired_outputs(df, "raw")
    got = {r.i: (r.attempts, r.review_status, r.confidence, r.remediation is not None, len(r.notes)) for r in used.collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert {r.i: r.notes[0] for r in refused.collect()} == {90: "not JSON", 91: "not JSON", 92: "vuln_id: short", 93: "vuln_id: kind"}

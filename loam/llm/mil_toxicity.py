"""Toxicity by multiple-instance learning.

Only documents carry labels. Each sentence gets a logistic score from words and word beginnings, known by 64-bit hashes, and a
document's score is the noisy-or of its sentences, 1 - prod(1 - p). Weights are trained on the document likelihood,
so the sentences that explain a label are found on the way and are located in the result.

Labels are learned from a bounded sample: at most SAMPLE labelled documents of the two classes, those with the least hash of doc_id, and FIT_BYTES of
their text (in that order, those that still fit). Scoring covers every text.

Defined cases: a null or empty text scores 0; without labels of both classes every text scores 0; repeated rows count once in the sample and each in the result;
of several texts of one doc_id the sample takes the one with the least hash; a doc_id with both labels teaches nothing; a null doc_id is scored; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as vt
from .shared import table

#: Labelled documents that the fit reads at most: clean and toxic.
SAMPLE = (3000, 1500)
#: Bytes of text that the fit collects at most.
FIT_BYTES = 48 << 20
#: Bytes in the beginnings of a word.
HEADS = (4, 5)
#: Documents that must hold a feature before it gets a weight.
SEEN = 8
#: Bytes of text that the fit holds features of at a time.
SLICE = 1 << 18
CUT = 0.7
#: Log-odds of a sentence without weighted words before the fit, and at most after it: thousands of such sentences must stay clean.
BIAS = -10.0
#: Weights below this are dropped.
LIGHT = 1.0
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The feature hashes and the sentence of each word, and the text of each sentence. Sentences without words don't count."""
    low = vt.LOWER[data]
    starts, ends, doc = vt.words(low, offs, vt.NON_LETTER)
    whole = vt.hashes(low, starts, ends)
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_END[data], out=stops[1:])
    new = np.ones(len(starts), bool)
    new[1:] = (stops[starts[1:]] != stops[starts[:-1]]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    feats = np.stack([whole, *(vt.hashes(low, starts, np.minimum(ends, starts + k)) ^ np.uint64(k << 56) for k in HEADS)])
    first = np.flatnonzero(new)
    return feats, sentence, doc[first] if len(first) else np.zeros(0, np.int64), starts[first] if len(first) else np.zeros(0, np.int64)


def _noisy_or(p: np.ndarray, spans: np.ndarray) -> np.ndarray:
    return -np.expm1(vt.sums_by(np.log1p(-np.minimum(p, 1 - 1e-12)), spans))


Model = tuple[np.ndarray, np.ndarray, float]


def fit_weights(texts: list[str | None], labels: np.ndarray, rounds: int = 80) -> Model:
    """Sorted hashes of the features that matter and their weights, by full-batch Adam with shrinkage on the noisy-or likelihood."""
    n = len(texts)
    none = np.zeros(0, np.uint64), np.zeros(0), BIAS
    if len(set(labels.tolist())) < 2:
        return none
    every = pa.array(texts, pa.string())
    seen = []
    for _, _, data, offs in vt.slices(every, SLICE):
        feats, sentence, of_text, _ = features(data, offs)
        key, text = feats.ravel(), np.tile(of_text[sentence], len(feats))
        order = np.lexsort((text, key))
        key, text = key[order], text[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        seen.append(key[first])
    names, times = np.unique(np.concatenate(seen), return_counts=True)
    names = names[times >= SEEN]
    del seen
    if not len(names):
        return none
    # a second pass over the texts costs less memory than all features of the first
    parts, docs, sentences = [], [], 0
    for lo, _, data, offs in vt.slices(every, SLICE):
        feats, sentence, of_text, _ = features(data, offs)
        flat, of = feats.ravel(), np.tile(sentence, len(feats))
        place = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        keep = names[place] == flat
        parts.append((place[keep].astype(np.int32), (of[keep] + sentences).astype(np.int32)))
        docs.append((of_text + lo).astype(np.int32))
        sentences += len(of_text)
    doc = np.concatenate(docs)
    spans = vt.text_spans(doc, n)
    w, b = np.zeros(len(names)), BIAS
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for i in range(1, rounds + 1):
        z = np.clip(b + sum(np.bincount(of, w[flat], minlength=len(doc)) for flat, of in parts), -30, 30)
        p = 1 / (1 + np.exp(-z))
        whole = np.clip(_noisy_or(p, spans), 1e-9, 1 - 1e-9)
        g = (weight * np.where(labels == 1, -(1 - whole) / whole, 1.0))[doc] * p
        gw = sum(np.bincount(flat, g[of], minlength=len(names)) for flat, of in parts)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        rate = 0.5
        scale = rate / (np.sqrt(v / (1 - 0.99 ** i)) + 2e-4)
        w -= scale * m / (1 - 0.9 ** i)
        w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(scale * 5e-4, 0.5))
        gb = float(g.sum())
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        b = min(BIAS, b - 0.05 * mb / (1 - 0.9 ** i) / (np.sqrt(vb / (1 - 0.99 ** i)) + 1e-4))
    w[np.abs(w) < LIGHT] = 0  # else very long sentences add up what common words got by chance
    return names[w != 0], w[w != 0], b


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from docs (doc_id, text) and labels (doc_id, toxic)."""
    labels = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).where("toxic = high").drop("high")
    picked = [labels.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[k]) for k in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most sum(SAMPLE) rows
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sample, "doc_id").withColumns({"key": F.xxhash64("text"), "bytes": F.coalesce(F.octet_length("text"), F.lit(0))})
    # one text a document, the sizes first: sum(SAMPLE) short rows at most
    found = rows.groupBy("doc_id").agg(F.min("key").alias("key"), F.min_by("bytes", "key").alias("bytes"), F.first("toxic").alias("toxic")).select("doc_id", "key", "bytes", F.xxhash64("doc_id").alias("place")).collect()
    kept, room = [], FIT_BYTES
    for r in sorted(found, key=lambda r: (r.place, r.doc_id)):
        if r.bytes <= room:
            kept.append((r.doc_id, r.key))
            room -= r.bytes
    if not kept:
        return fit_weights([], np.zeros(0, np.int64))
    kept = F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id long, key long"))
    got = sorted(rows.join(kept, ["doc_id", "key"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect())  # FIT_BYTES of text at most
    return fit_weights([r.text for r in got], np.array([r.toxic for r in got], np.int64))


def _weights(model: Model, hashes: np.ndarray) -> np.ndarray:
    """The weight of each feature; few match the small table of low bits and are looked up."""
    names, w, _ = model
    out = np.zeros(len(hashes))
    if len(names):
        maybe = np.zeros(1 << 16, bool)
        maybe[(names & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(names, hashes[at]), len(names) - 1)
        out[at] = np.where(names[place] == hashes[at], w[place], 0)
    return out


def _score(model: Model):

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in vt.slices(batch.column(1)):
                feats, sentence, doc, at = features(data, offs)
                both = sum(_weights(model, x) for x in feats)
                z = np.clip(model[2] + np.bincount(sentence, both, minlength=len(doc)), -30, 30)
                p = 1 / (1 + np.exp(-z)) if len(doc) else np.zeros(0)
                score = np.clip(_noisy_or(p, vt.text_spans(doc, hi - lo)), 0, 1)
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                where: list[list[int]] = [[] for _ in range(hi - lo)]
                for s in np.flatnonzero(p >= 0.5).tolist():
                    where[doc[s]].append(int(chars[at[s]] - chars[offs[doc[s]]]))
                cut = lambda c: c.slice(lo, hi - lo)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([cut(batch.column(0)), cut(batch.column(2)), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(where, pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "sentences"])
    return run


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences): sentences holds the first character of each offending sentence."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out")).mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int, sentences array<long>")


def _clean(model: Model):
    run_score = _score(model)

    def run(batches):
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(batch.schema.get_field_index("text")), pa.nulls(batch.num_rows, pa.bool_())], ["doc_id", "text", "held_out"])
            flags = [x.column(3).to_numpy() for x in run_score(iter([rows]))]
            yield batch.filter(pa.array(np.concatenate(flags) == 0)) if flags else batch
    return run


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text isn't predicted toxic, in one pass without a join."""
    return docs.mapInArrow(_clean(model), docs.schema)


def held_out_third() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole documents, learned from labels outside the held-out third."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels.where(~held_out_third())), held_out_third())


QUERIES = {"op2_mil_toxicity": op2_mil_toxicity}
ORACLE: dict[str, str] = {}

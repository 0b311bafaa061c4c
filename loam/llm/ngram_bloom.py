"""Language identification with a bit-sliced Bloom filter of n-grams.

One array of masks serves all languages: bit l of a slot belongs to the filter of language l, so and-ing the slots of an
n-gram returns every language that holds it. A slot has as many 64-bit masks as the languages need. A text gets the popcount of each language over its n-grams, corrected for the
filter's false-positive rate. Counts come from all training texts; the filter's size is a parameter and bounds what
reaches the driver and the workers.

Defined cases: a null text or one without letters is `und` with score 0; without any training row every text is `und`; a text without a known n-gram gets the first
language by name, with score 0, and so do ties; a language without an n-gram of its own that occurs LEAST times is never predicted; a null doc_id is
not held out and not learned from; repeated rows count each; other columns are ignored.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext as vt
from .shared import materialize, table

#: Bytes in an n-gram, slots of the filter, and slots for each n-gram.
GRAM, SLOTS, PROBES = 4, 1 << 20, 4
#: An n-gram belongs to a language where it is seen so often, and at this share of its highest relative frequency.
LEAST, SHARE = 5, 0.25


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of lower-cased text with anything but letters as one blank, and the text number of each."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.where(vt.NON_LETTER[data], 32, vt.LOWER[data]).astype(np.uint64)
    n = len(data) - GRAM + 1
    gram = np.zeros(n, np.uint64)
    blank = np.zeros(n, bool)
    for j in range(GRAM):
        gram = (gram << np.uint64(8)) | data[j:n + j]
        if j:
            blank |= (data[j:n + j] == 32) & (data[j - 1:n + j - 1] == 32)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    keep = ~blank & (doc[:n] == doc[GRAM - 1:])
    return gram[keep], doc[:n][keep]


def _slots(gram: np.ndarray) -> list[np.ndarray]:
    return [(vt.mix(gram + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1)) & np.uint64(SLOTS - 1)).astype(np.int64) for j in range(PROBES)]


def _lower(texts: pa.Array) -> pa.Array:
    return pa.array([x if x is None else x.lower() for x in texts.to_pylist()], pa.string())


def _count(batches):
    held: dict[str, list] = {}

    def merged(parts):
        keys, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([y for _, y in parts]).astype(float)).astype(np.int64)

    for batch in batches:
        lang = np.array(batch.column(1).to_pylist(), object)
        for name in sorted(set(lang)):
            for _, _, data, offs in vt.slices(_lower(batch.column(0).filter(pa.array(lang == name)))):
                held.setdefault(name, []).append(np.unique(_grams(data, offs)[0], return_counts=True))
                if len(held[name]) > 16:
                    held[name] = [merged(held[name])]
    for name, parts in held.items():
        keys, n = merged(parts)
        for lo in range(0, len(keys), 10_000):
            k = keys[lo:lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n[lo:lo + 10_000])], ["lang", "gram", "n"])


def _place(batches):
    for batch in batches:
        gram = batch.column(0).to_numpy().view(np.uint64)
        for at in _slots(gram):
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["slot", "bit"])


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and slots (a row of masks for each 64 of them) from rows (text, lang) with lang."""
    counts = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.where(F.col("n") >= LEAST).join(total, "lang").withColumn("rate", F.col("n") / F.col("total"))
    own = rate.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("top"))
    own = materialize(own.select("lang", "gram"), "own")
    names = sorted(r.lang for r in own.select("lang").distinct().collect())
    slots = np.zeros((max(1, -(-len(names) // 64)), SLOTS), np.uint64)
    if names:
        bit = F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1
        filled = own.select("gram", bit.cast("long").alias("bit")).mapInArrow(_place, "slot long, bit long").groupBy("slot", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
        got = filled.toArrow()  # at most SLOTS rows for each 64 languages
        slots[got["word"].to_numpy(), got["slot"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return names, slots


def _predict(names: list[str], slots: np.ndarray):
    wrong = [float(((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** PROBES for i in range(len(names))]

    def run(batches):
        for batch in batches:
            texts = _lower(batch.column(1))
            for lo, hi, data, offs in vt.slices(texts):
                gram, doc = _grams(data, offs)
                probes = _slots(gram)
                masks = [reduce(np.bitwise_and, (word[at] for at in probes)) for word in slots]
                spans = vt.text_spans(doc, hi - lo)
                n = np.diff(spans)
                hits = np.zeros((max(1, len(names)), hi - lo))
                for i, fp in enumerate(wrong):
                    found = vt.sums_by(((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64), spans)
                    hits[i] = np.maximum(0, (found - n * fp) / (1 - fp)) if fp < 1 else 0
                best, total = hits.argmax(0), hits.sum(0)
                has = np.array([x is not None and any(map(str.isalpha, x)) for x in texts.slice(lo, hi - lo).to_pylist()])
                score = np.where(has & (total > 0), hits.max(0) / np.maximum(total, 1e-300), 0.0)
                pred = [names[b] if h and names else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out")).mapInArrow(_predict(*model), "doc_id long, held_out boolean, lang_pred string, score double")


def op1_ngram_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of whole documents, learned from those outside the held-out fourth."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return predict(docs, fit(docs.where(F.col("doc_id").isNotNull() & ~held & F.col("lang").isNotNull())), held)


QUERIES = {"op1_ngram_bloom": op1_ngram_bloom}
ORACLE: dict[str, str] = {}

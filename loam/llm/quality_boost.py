"""Quality by histogram gradient-boosted trees over document statistics.

One pass works out statistics of every whole text. Trees are grown on binned statistics of labelled documents: each level of a tree takes gradients and curvatures by (node, statistic, bin) in one
histogram and splits every node where the logistic loss falls most. The trees are then flattened into arrays, in which a leaf is a node that leads to itself, so that all trees of many documents
are walked at once by numpy indexing, a step for each level.

Labels are learned from at most SAMPLE labelled documents, those with the least hash of doc_id; of them only the statistics, FEATURES numbers each, come to the driver. Scoring covers every text.

Defined cases: a null or empty text has statistics of 0 and is scored by them; without labels every text scores 0.5, with labels of one class alone the share of that class with one row of each added; repeated rows count once
in the sample and each in the result; of several texts of one doc_id the sample takes the one with the least hash; a doc_id with both labels teaches nothing; a null doc_id is scored and teaches nothing; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as vt
from .shared import table

#: Labelled documents that the fit reads at most.
SAMPLE = 20_000
#: Bins of a statistic, trees, levels, shrinkage, least curvature of a leaf, and what is added to curvatures.
BINS, TREES, LEVELS, RATE, LEAST, RIDGE = 64, 80, 4, 0.15, 2.0, 1.0
CUT = 0.7
FEATURES = 24
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _LOUD, _STOP, _BRACKET, _DIGIT = _bytes("#*$%&<>@~^=+"), _bytes("!?"), _bytes(".,;:"), _bytes("(){}[]/\\\"'_-"), _bytes("0123456789")
_UPPER, _LETTER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ~vt.NON_LETTER


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """FEATURES numbers for each text of a slice."""
    k = len(offs) - 1
    starts, ends, doc = vt.words(data, offs)
    spans = vt.text_spans(doc, k)
    n, size = np.diff(spans), np.diff(offs)
    words, chars = np.maximum(n, 1), np.maximum(size, 1)
    count = lambda mask: vt.sums_by(mask.astype(np.int64), offs)
    of_words = lambda mask: vt.sums_by(mask.astype(np.int64), spans)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    long = lead[ends] - lead[starts]
    newline = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=newline[1:])
    h = vt.hashes(data, starts, ends)
    # lines as sums over their words
    line = newline[starts] + doc
    first = np.ones(len(starts), bool)
    first[1:] = line[1:] != line[:-1]
    at = np.flatnonzero(first)
    bounds = np.append(at, len(starts))
    nth = np.arange(len(starts)) - np.repeat(at, np.diff(bounds)) if len(starts) else np.zeros(0, np.int64)
    key = vt.sums_by(vt.mix(h + nth.astype(np.uint64) * _STEP[0]).view(np.int64), bounds).view(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    of_line, line_words = doc[at], np.diff(bounds)
    own = vt.mix(key + of_line.astype(np.uint64) * _STEP[1])
    order = np.argsort(own, kind="stable")
    again = np.zeros(len(own), bool)
    again[order[1:]] = own[order][1:] == own[order][:-1]
    line_spans = np.searchsorted(of_line, np.arange(k + 1))
    lines = np.maximum(np.diff(line_spans), 1)
    of_lines = lambda x: vt.sums_by(x.astype(np.int64), line_spans)
    closed = np.isin(data[ends[bounds[1:] - 1] - 1], [ord(c) for c in ".!?"]) if len(at) else np.zeros(0, bool)
    # distinct words and how often each occurs
    pair = vt.mix(h + doc.astype(np.uint64) * _STEP[2])
    order = np.argsort(pair, kind="stable")
    new = np.ones(len(pair), bool)
    new[1:] = pair[order][1:] != pair[order][:-1]
    place = np.flatnonzero(new)
    times = np.diff(np.append(place, len(pair)))
    owner = doc[order[place]] if len(place) else np.zeros(0, np.int64)
    distinct = np.bincount(owner, minlength=k)
    most = np.zeros(k)
    np.maximum.at(most, owner, times)
    bits = np.bincount(owner, times * np.log(np.maximum(times, 1)), minlength=k)
    # words in three-word windows that the text has twice
    repeat = np.zeros(len(h), bool)
    if len(h) >= 3:
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        window = vt.mix(vt.mix(h[:-2] * _STEP[0] + h[1:-1] * _STEP[1] + h[2:] * _STEP[2])[inside] + doc[inside].astype(np.uint64) * _STEP[0])
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(inside), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(3):
            repeat[inside[twice] + j] = True
    symbol_end = _SYMBOL[data[ends - 1]] | _LOUD[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    stutter = np.zeros(len(h), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    upper, letters = count(_UPPER[data]), np.maximum(count(_LETTER[data]), 1)
    mean = of_words(long) / words
    square = np.maximum(of_words(long * long) / words - mean * mean, 0)
    out = [np.log1p(n), np.log1p(size), mean, np.sqrt(square), count(_SYMBOL[data]) / words, count(data == ord("|")) / words, count(_LOUD[data]) / words, count(_STOP[data]) / words, count(_BRACKET[data]) / words,
           upper / letters, count(_DIGIT[data]) / chars, count(data >= 0x80) / chars, count(vt.WHITE[data]) / chars, n / lines, of_lines(again) / lines, of_lines(again * line_words) / words, of_lines(closed) / lines,
           of_words(repeat) / words, distinct / words, most / words, np.log(words) - bits / words, of_words(_UPPER[data[starts]] if len(starts) else symbol_end) / words, of_words(symbol_end) / words, of_words(long <= 3) / words + of_words(stutter)]
    return np.stack(out, 1).astype(float)


Model = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]


def grow(x: np.ndarray, y: np.ndarray) -> Model:
    """Flattened trees: for each node its statistic, the value above which the right child follows, the left child (the right one comes after it) and the value; the roots; and the log-odds to begin with."""
    n, none = len(y), np.zeros(0, np.int64)
    prior = np.log((y.sum() + 1) / (n - y.sum() + 1)) if n else 0.0
    if not 0 < y.sum() < n:
        return none, np.zeros(0), none, np.zeros(0), none, float(prior)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(FEATURES)]
    bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    slot = np.arange(FEATURES) * BINS + bins
    z = np.full(n, prior)
    feature, above, left, value, roots = [], [], [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, c = p - y, p * (1 - p)
        root = len(feature)
        roots.append(root)
        at, open_ = np.zeros(n, np.int64), [root]
        feature.append(0), above.append(np.inf), left.append(root), value.append(0.0)
        for level in range(LEVELS + 1):
            width = len(open_)
            live = np.flatnonzero(at >= 0)
            place = (at[live, None] * (FEATURES * BINS) + slot[live]).ravel()
            hist = lambda w, place=place, live=live, width=width: np.bincount(place, np.repeat(w[live], FEATURES), width * FEATURES * BINS).reshape(width, FEATURES, BINS)
            gs, cs = hist(g), hist(c)
            all_g, all_c = gs[:, 0].sum(1), cs[:, 0].sum(1)
            for i, node in enumerate(open_):
                value[node] = float(-RATE * all_g[i] / (all_c[i] + RIDGE))
            if level == LEVELS:
                break
            lg, lc = np.cumsum(gs, 2), np.cumsum(cs, 2)
            rg, rc = all_g[:, None, None] - lg, all_c[:, None, None] - lc
            gain = lg * lg / (lc + RIDGE) + rg * rg / (rc + RIDGE) - (all_g * all_g / (all_c + RIDGE))[:, None, None]
            gain[(lc < LEAST) | (rc < LEAST)] = 0
            gain = gain.reshape(width, -1)
            split = gain.argmax(1)
            to, next_ = np.full((width, 2), -1), []
            for i, node in enumerate(open_):
                if gain[i, split[i]] > 1e-6:
                    f, b = divmod(int(split[i]), BINS)
                    feature[node], above[node], left[node] = f, float(edges[f][b]), len(feature)
                    for side in (0, 1):
                        to[i, side] = len(next_)
                        next_.append(len(feature))
                        feature.append(0), above.append(np.inf), left.append(len(feature) - 1), value.append(0.0)
            own = at[live]
            f, b = np.divmod(split[own], BINS)
            at[live] = to[own, (bins[live, f] > b).astype(int)]
            open_ = next_
            if not open_:
                break
        model = np.array(feature), np.array(above), np.array(left), np.array(value), np.array(roots[-1:]), 0.0
        z = z + log_odds(model, x)
    return np.array(feature), np.array(above), np.array(left), np.array(value), np.array(roots), float(prior)


def log_odds(model: Model, x: np.ndarray) -> np.ndarray:
    """All trees of all rows, a level a step; leaves lead to themselves."""
    feature, above, left, value, roots, prior = model
    out = np.full(len(x), prior)
    for lo in range(0, len(x), 4096):
        rows = x[lo:lo + 4096]
        at = np.tile(roots, (len(rows), 1))
        for _ in range(LEVELS):
            at = left[at] + (np.take_along_axis(rows, feature[at], 1) > above[at])
        out[lo:lo + 4096] += value[at].sum(1) if len(roots) else 0
    return out


def _statistics(batches):
    for batch in batches:
        for lo, hi, data, offs in vt.slices(batch.column(2)):
            x = statistics(data, offs)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), flat], ["doc_id", "key", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from docs (doc_id, text) and labels (doc_id, quality)."""
    labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high")).where("quality = high").drop("high")
    known = docs.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    sample = F.broadcast(labels.join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string")).join(sample.select("doc_id"), "doc_id", "left_semi")
    rows = rows.mapInArrow(_statistics, "doc_id long, key long, x array<double>").groupBy("doc_id").agg(F.min_by("x", "key").alias("x"))
    got = sorted(rows.join(sample, "doc_id").select("doc_id", "quality", "x").collect())  # SAMPLE rows of FEATURES numbers at most
    return grow(np.array([r.x for r in got]).reshape(-1, FEATURES), np.array([r.quality for r in got], float))


def _score(model: Model):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in vt.slices(batch.column(1)):
                p = 1 / (1 + np.exp(-np.clip(log_odds(model, statistics(data, offs)), -700, 700)))
                cut = lambda c: c.slice(lo, hi - lo)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([cut(batch.column(0)), cut(batch.column(2)), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return run


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out")).mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def held_out_quarter() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op11_quality_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of whole documents, learned from labels outside the held-out quarter."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels.where(~held_out_quarter())), held_out_quarter())


QUERIES = {"op11_quality_boost": op11_quality_boost}
ORACLE: dict[str, str] = {}

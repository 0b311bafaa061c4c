"""Quality rules with an isolation forest over their statistics.

One pass computes rule statistics of every text. Trees split a bounded, hash-chosen sample of the rows at random; documents that random splits
isolate after a short path are anomalies. An anomaly's profile is the statistic that lies farthest from its middle, and on which side. For each profile
the score from which documents are refused is calibrated on all rows with a quality label: the lowest cut above which labelled rows are nearly all bad.

Trees see TREES * PSI rows at most (that is what an isolation forest is); the middles and spreads of the statistics, scoring and calibration cover all rows.

Defined cases: a null or empty text has no words and fails; without labels no document is refused by the forest; repeated rows count each, as do the labels of
a doc_id that has both; a null doc_id is passed on; a sample's ties go by doc_id, then by its counts; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as vt
from .shared import materialize, table

TREES, PSI, SEED = 100, 256, 23
#: A cut is taken where this share of the labelled rows above it is bad; bins of the calibration; labelled rows above a cut at least.
PRECISION, BINS, LEAST = 0.95, 1000, 10
FEWEST_WORDS, REPEATED_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = 7
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _stats(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi, data, offs in vt.slices(batch.column(1)):
            k = hi - lo
            starts, ends, doc = vt.words(data, offs)
            spans = vt.text_spans(doc, k)
            count = lambda mask: vt.sums_by(mask.astype(np.int64), offs)  # noqa: E731, B023
            n = np.diff(spans)
            chars = count(~vt.WHITE[data] & ((data & 0xC0) != 0x80))
            h = vt.hashes(data, starts, ends)
            repeat = np.zeros(len(h), bool)
            if len(h) >= 3:
                window = vt.mix(h[:-2] * _STEP[0] + h[1:-1] * _STEP[1] + h[2:] * _STEP[2])
                inside = np.flatnonzero(doc[:-2] == doc[2:])
                key = vt.mix(window[inside] + doc[inside].astype(np.uint64) * _STEP[0])
                h2 = vt.mix(vt.second_hashes(data, starts, ends))
                check = vt.mix(h2[:-2] * _STEP[0] + h2[1:-1] * _STEP[1] + h2[2:] * _STEP[2])[inside]
                order = np.lexsort((check, key))
                same = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
                twice = np.zeros(len(inside), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                for j in range(3):
                    repeat[inside[twice] + j] = True
            repeats = vt.sums_by(repeat.astype(np.int64), spans)
            dups = np.array([_dup_lines(x or "") for x in texts[lo:hi]], np.int64)
            symbols, lines = count(_SYMBOL[data]), count(data == 10) + 1
            per = np.maximum(n, 1)
            size = np.maximum(np.diff(offs), 1)
            feats = np.stack([chars / per, symbols / per, dups / lines, repeats / per, count(_UPPER[data]) / size, count(_PUNCT[data]) / per, count(_DIGIT[data]) / size], 1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * FEATURES, pa.int32()), pa.array(feats.ravel()))
            cut = lambda c: c.slice(lo, hi - lo)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([cut(batch.column(0)), pa.array(n), pa.array(chars), pa.array(symbols), pa.array(dups), pa.array(repeats), flat], ["doc_id", *STATS, "features"])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features) of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_stats, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>")


def _depth(n: float) -> float:
    """Mean path length of a search among n rows."""
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else max(0.0, n - 1)


def grow(sample: np.ndarray, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Trees as arrays (feature or -1, split or path length, left child; the right one follows it)."""
    rng, trees = np.random.default_rng(seed), []
    for t in range(TREES):
        rows = sample[t::TREES][:PSI]
        feature, value, child = [], [], []
        todo = [(rows, 0)]
        most = int(np.ceil(np.log2(max(2, len(rows)))))
        at = 0
        while at < len(todo):
            x, depth = todo[at]
            wide = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
            if depth >= most or len(wide) == 0:
                feature.append(-1), value.append(depth + _depth(len(x))), child.append(0)
            else:
                f = int(rng.choice(wide))
                cut = rng.uniform(x[:, f].min(), x[:, f].max())
                feature.append(f), value.append(cut), child.append(len(todo))
                todo += [(x[x[:, f] < cut], depth + 1), (x[x[:, f] >= cut], depth + 1)]
            at += 1
        trees.append((np.array(feature), np.array(value), np.array(child)))
    return trees


def anomaly(trees, x: np.ndarray, psi: int) -> np.ndarray:
    """2 ** (-mean path / expected path) for each row."""
    total = np.zeros(len(x))
    for feature, value, child in trees:
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            open_ = np.flatnonzero(f >= 0)
            if not len(open_):
                break
            here = at[open_]
            at[open_] = child[here] + (x[open_, f[open_]] >= value[here])
        total += value[at]
    return 2.0 ** (-total / len(trees) / max(1e-9, _depth(psi)))


def _anomalies(trees, psi: int, middle: np.ndarray, spread: np.ndarray):
    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(6).flatten()).reshape(-1, FEATURES)
            z = (x - middle) / spread
            far = np.abs(z).argmax(1) if len(z) else np.zeros(0, np.int64)
            profile = 2 * far + (z[np.arange(len(z)), far] > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(anomaly(trees, x, psi)), pa.array(profile.astype(np.int32))], ["doc_id", *STATS, "anomaly", "profile"])
    return run


def calibrate(scored: DataFrame, labels: DataFrame) -> list[float]:
    """For each profile the lowest cut above which labelled rows are bad to PRECISION, from a histogram of BINS bins; 2 if there is none."""
    bin_ = F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")
    rows = scored.join(labels, "doc_id").groupBy("profile", bin_).agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count("*").alias("n")).collect()  # 2 * FEATURES * BINS rows at most
    cuts = [2.0] * (2 * FEATURES)
    for profile in range(2 * FEATURES):
        bad = n = 0
        for r in sorted((r for r in rows if r.profile == profile), key=lambda r: -r.bin):
            bad, n = bad + r.bad, n + r.n
            if n >= LEAST and bad >= PRECISION * n:
                cuts[profile] = r.bin / BINS
    return cuts


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): statistics, anomaly, base_failed, kept. labels: (doc_id, quality)."""
    stats = materialize(statistics(docs), "stats")
    fair = stats.where((F.col("n_words") >= FEWEST_WORDS) & (100 * F.col("n_repeat_words") <= REPEATED_PERCENT * F.col("n_words")))
    # rows with low hashes, half more than needed, so that no task sends a full sample of its own to the driver
    rank = F.xxhash64(F.lit(SEED), "doc_id", "n_words", "word_chars")
    share = min(1.0, 1.5 * TREES * PSI / max(1, fair.count()))
    low = fair.where(F.pmod(rank, F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = low.select("features").orderBy(F.pmod(rank, F.lit(1 << 30)), "doc_id", "n_words", "word_chars").limit(TREES * PSI).collect()
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, anomaly double, profile int"
    if sample:
        x = np.array([r.features for r in sample])
        psi = min(PSI, max(2, len(x) // TREES))
        trees = grow(x)
        spread = fair.agg(*(F.percentile_approx(F.col("features")[i], [0.1, 0.5, 0.9], 10_000).alias(f"q{i}") for i in range(FEATURES))).head()
        low, middle, high = np.array(spread).T
        scored = materialize(stats.mapInArrow(_anomalies(trees, psi, middle, np.maximum(high - low, 1e-3)), schema), "anomalies")
        labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)").distinct()
        failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
        cuts = calibrate(scored.where(~failed), labels)
    else:
        scored, cuts = stats.select("doc_id", *STATS, F.lit(0.0).alias("anomaly"), F.lit(0).alias("profile")), [2.0]
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    cut = F.element_at(F.array(*map(F.lit, cuts)), F.col("profile") + 1)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < cut))


def op7_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdicts of whole documents."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_rule_forest": op7_rule_forest}
ORACLE: dict[str, str] = {}

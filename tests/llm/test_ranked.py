"""Quality trees, feature dictionary and block-max search against plain versions, and their defined cases."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from loam.llm import block_max_search, feature_dictionary, quality_boost, registry
from loam.llm import vectext as vt

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("name", ["op12_feature_dictionary", "op13_block_max_search"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLE[name])
    names = [x[0] for x in want.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


# quality


def test_quality_query(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op11_quality_boost"](spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert set(got) == {d["doc_id"] for d in docs}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    tested = [i for i, r in got.items() if r.held_out and labels.get(i) is not None]
    assert sum(got[i].predicted == labels[i] for i in tested) >= 0.9 * len(tested)


def test_flat_trees_walk_as_plain_ones():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, quality_boost.FEATURES)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 5] + x[:, 7] > 0)).astype(float)
    model = quality_boost.grow(x, y)
    feature, above, left, value, roots, prior = model

    def walk(row):
        total = prior
        for at in roots.tolist():
            while left[at] != at:
                at = left[at] + int(row[feature[at]] > above[at])
            total += value[at]
        return total

    got = quality_boost.log_odds(model, x)
    assert np.allclose(got, [walk(r) for r in x])
    assert ((got > 0) == (y == 1)).mean() > 0.95
    assert len(roots) == quality_boost.TREES and len(feature) <= quality_boost.TREES * (2 ** (quality_boost.LEVELS + 1) - 1)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, size=(300, quality_boost.FEATURES)).astype(float)
    y = (rng.random(300) < 0.2 + 0.6 * (x[:, 3] > 4)).astype(float)
    feature, above, *_, prior = quality_boost.grow(x, y)
    p = 1 / (1 + math.exp(-prior))
    g, c = p - y, np.full(300, p * (1 - p))
    part = lambda s: g[s].sum() ** 2 / (c[s].sum() + quality_boost.RIDGE)
    gains = {(f, cut): part(x[:, f] <= cut) + part(x[:, f] > cut) for f in range(quality_boost.FEATURES) for cut in range(8) if min(c[x[:, f] <= cut].sum(), c[x[:, f] > cut].sum()) >= quality_boost.LEAST}
    assert (feature[0], above[0]) == max(gains, key=gains.get)


def test_statistics_against_plain_counts():
    texts = ["", None, " \n\t", "One two three four.\nOne two three four.\nLast | line!", "a " * 50, "é" * 70 + " ÄÖ 12", "x#\ny$\nx#\n\nThe end."]
    got = quality_boost.statistics(*vt.buffers(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = max(1, len(ws))
        lines = [x.split() for x in t.split("\n") if x.split()]
        windows = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
        repeated = {i + j for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for j in range(3)}
        counts = Counter(ws)
        plain = {0: math.log1p(len(ws)), 1: math.log1p(len(t.encode())), 2: sum(map(len, ws)) / n, 4: sum(c in "#*$%&<>@~^=+" for c in t) / n, 5: t.count("|") / n, 13: len(ws) / max(1, len(lines)),
                 14: (len(lines) - len({tuple(x) for x in lines})) / max(1, len(lines)), 17: len(repeated) / n, 18: len(counts) / n, 19: max(counts.values(), default=0) / n,
                 20: math.log(n) - sum(c * math.log(c) for c in counts.values()) / n, 21: sum("A" <= w[0] <= "Z" for w in ws) / n}
        for f, v in plain.items():
            assert abs(row[f] - v) < 1e-9, (t, f)
    many = quality_boost.statistics(*vt.buffers(pa.array(texts * 3)))
    assert np.allclose(many, np.concatenate([got] * 3))


def test_quality_cases(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_boost, "SAMPLE", 3)
    monkeypatch.setattr(quality_boost, "grow", lambda x, y: seen.append((x, y.tolist())))
    rows = [(0, "good words here")] * 5 + [(1, "bad | words"), (1, "other words of one id"), (2, None), (9, "both labels"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(7)).withColumn("x", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (2, 0), (9, 0), (9, 1), (5, 1), (None, 1), (3, None)], "doc_id long, quality int")
    quality_boost.fit(docs, labels)
    assert seen[0][0].shape == (3, quality_boost.FEATURES) and sorted(seen[0][1]) == [0, 0, 1]  # doc 5 has no text and takes no place
    monkeypatch.undo()
    none = labels.where("false")
    scored = quality_boost.score(docs, quality_boost.fit(docs, none), F.lit(False)).collect()
    assert len(scored) == len(rows) and {r.score for r in scored} == {0.5}
    one = quality_boost.score(docs, quality_boost.fit(docs, labels.where("doc_id = 0")), F.lit(False)).collect()
    assert {round(r.score, 6) for r in one} == {round(2 / 3, 6)}
    assert quality_boost.score(docs.where("false"), quality_boost.fit(docs.where("false"), labels), F.lit(False)).collect() == []
    long = spark.createDataFrame([(1, "word " * 400_000), (2, "w" * 2_000_000)], "doc_id long, text string")
    assert len(quality_boost.score(long, quality_boost.fit(docs, labels), F.lit(False)).collect()) == 2


# resampling


def plain_resample(docs, target, percent, least, most, buckets):
    def feats(text):
        ws = words(text)
        return [" ".join(ws[i:i + n]) for n in range(1, most + 1) for i in range(len(ws) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in feats(x)), Counter(bucket(f) for x in target for f in feats(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in feats(x))
        out.append([i, len(feats(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = Counter((tuple(r), n) for n, r in enumerate(fit[:percent * len(fit) // 100], 1))
    rest = Counter(tuple(r) for r in out) - Counter(r for r, _ in ranks)
    return sorted([(*r[:4], n) for r, n in ranks] + [(*r[:4], None) for r in rest.elements()], key=repr)


@pytest.mark.parametrize(("most", "block"), [(1, 8 << 20), (3, 300)])
def test_resampling_against_a_plain_version(spark, monkeypatch, most, block):
    monkeypatch.setattr(feature_dictionary, "BLOCK", block)
    rng = random.Random(4)
    vocabulary = ["Éa", "漢字", "ab", "c3", "The", "x", "longer-word", "y_z", "zz top", "\x7fq"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(120)]
    docs += [docs[3]] * 70 + [(None, docs[4][1]), (None, None), (7, docs[5][1]), (200, None), (201, ""), (202, "!? \n"), (203, "w" * 100_000)]
    target = ["the x ab", None, "", "漢字 ab ab c3"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "block": F.lit("clash"), "rank": F.lit(None).cast("int")}).repartition(5)
    for wanted in (target, []):
        got = feature_dictionary.resample(df, spark.createDataFrame([(0, x) for x in wanted], "item_id long, text string"), 30, 5, most, 64)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(docs, wanted, 30, 5, most, 64)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert feature_dictionary.resample(none, spark.createDataFrame([(0, "a b")], "item_id long, text string")).collect() == []
    got = feature_dictionary.resample(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string"), none.select("text")).collect()
    assert [(r.n_features, r.weight, r["rank"]) for r in got] == [(0, 0, None)] * 2


def test_places_are_those_of_one_sort(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 20), i) for i in range(500)]
    got = feature_dictionary.placed(spark.createDataFrame(rows, "a long, b long").repartition(7), [F.desc("a"), F.asc("b")]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r.place for r in got) == list(range(1, 501))


# search


def plain_search(docs, items, k):
    texts = [(i, Counter(words(x))) for i, x in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n_docs, total = len(texts), sum(n for *_, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    asked = {}
    for i, x in items:
        asked.setdefault(i, Counter()).update(words(x))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in texts:
            m = 100 - 25 + 25 * n * n_docs // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "terms"), [(16 << 20, 200_000), (2000, 40)])
def test_search_against_a_plain_version(spark, monkeypatch, shard, terms):
    monkeypatch.setattr(block_max_search, "SHARD", shard)
    monkeypatch.setattr(block_max_search, "QUERY_TERMS", terms)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weight, k=rng.randint(1, 80)))) for i in range(700)]
    docs += [docs[5]] * 60 + [(1000 + i, docs[6][1]) for i in range(40)] + [(None, docs[8][1]), (None, None), (2000, ""), (2001, "?!"), (2002, "w299 " * 3000), (2003, "Ünï w1 W1")]
    items = [(i, " ".join(rng.choices(vocabulary, weight, k=rng.randint(1, 30)))) for i in range(30)]
    items += [(50, docs[6][1]), (51, None), (52, ""), (53, "nowhere found"), (54, "w299 w299"), (55, "Ünï"), (56, "w7"), (56, "w8 w8"), (None, "w20")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "term": F.lit("clash"), "shard": F.lit(2)}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = block_max_search.search(block_max_search.index(df), asked, 7)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(docs, items, 7)


def test_search_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item = lambda df: df.withColumnRenamed("doc_id", "item_id")
    for docs, items in ((none, some), (some, none), (spark.createDataFrame([(1, None)], "doc_id long, text string"), some)):
        assert block_max_search.search(block_max_search.index(docs), item(items), 3).collect() == []


def test_blocks_are_the_cheapest():
    rng = np.random.default_rng(2)
    sizes = [1, 5, 8, 9, 40, 100, 333]
    spans = np.concatenate([[0], np.cumsum(sizes)])
    impacts = rng.integers(1, 1000, spans[-1]).astype(float)
    impacts[200:260] *= 10
    unit, widest = block_max_search.UNIT, block_max_search.WIDEST

    def price(own, ends):
        starts = [0, *ends[:-1]]
        return sum(own[a:b].max() * (b - a) - own[a:b].sum() + block_max_search.COST * own.max() for a, b in zip(starts, ends, strict=True))

    for i, ends in enumerate(block_max_search.cut_blocks(impacts, spans)):
        own = impacts[spans[i]:spans[i + 1]]
        cuts = [*range(unit, len(own), unit), len(own)]
        assert ends[-1] == len(own) and set(ends.tolist()) <= set(cuts)
        least, prior = {0: 0.0}, [0, *cuts]
        for j, end in enumerate(prior[1:], 1):
            least[end] = min(least[a] + price(own, [len(own)]) * 0 + own[a:end].max() * (end - a) - own[a:end].sum() + block_max_search.COST * own.max() for a in prior[max(0, j - widest):j])
        assert abs(price(own, ends.tolist()) - least[len(own)]) < 1e-6


def test_search_skips_blocks(monkeypatch):
    # one document has all that is asked: most others are never scored
    rng = np.random.default_rng(1)
    n, made = 20_000, []
    lists = [(np.sort(rng.choice(n, 6000, replace=False)), rng.integers(1, 100, 6000)) for _ in range(6)]
    rare = (np.array([17, 4000]), np.array([5000, 4000]))
    terms = []
    for docs, values in [rare, *lists]:
        ends = block_max_search.cut_blocks(values.astype(float), np.array([0, len(values)]))[0]
        terms.append((block_max_search.Postings(docs, values.astype(np.int64), ends), 1))
    plain = np.zeros(n, np.int64)
    for docs, values in [rare, *lists]:
        plain[docs] += values
    value = block_max_search.Postings.value
    monkeypatch.setattr(block_max_search.Postings, "value", lambda self, docs: made.append(len(docs)) or value(self, docs))
    docs, scores = block_max_search.best(terms, 2, np.full(n, -1, np.int64), 0, np.arange(n))
    assert docs.tolist() == np.lexsort((np.arange(n), -plain))[:2].tolist() and scores.tolist() == sorted(plain.tolist())[-2:][::-1]
    assert sum(made) < 100


def test_impacts_beyond_64_bits():
    tf, size = np.array([1, 7]), np.array([1 << 31, 5])
    documents, total = 1 << 40, (1 << 41) + 3
    want = [1000000000 * t // (1000 * t + 12 * (75 + 25 * s * documents // total)) for t, s in zip(tf.tolist(), size.tolist(), strict=True)]
    assert block_max_search.impacts(tf, size, documents, total).tolist() == want

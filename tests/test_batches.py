"""Many questions at once over postings and cells, against brute force."""
import numpy as np
import pytest
from loam.operators import cells, postings, retrieve
from loam.plans import registry

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plain(vectors, questions, k):
    out = []
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    for q, a in questions:
        if q is None or not good(a):
            continue
        rows = []
        for i, b in vectors:
            if i is not None and good(b) and len(b) == len(a):
                x, y = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
                cos = np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))
                rows.append((-int(np.floor(min(1, max(0, cos)) * 10000 + 0.5)), i))
        out += [(q, i, -s) for s, i in sorted(rows)[:k]]
    return sorted(out)


@pytest.mark.parametrize(("n", "ring", "batch"), [(400, 16, 8), (400, 2048, 256)])
def test_cells_are_exact(spark, n, ring, batch):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(6, 5))
    vectors = [(i, (middle[i % 6] + 0.2 * rng.normal(size=5)).round(3).tolist()) for i in range(n)]
    vectors += [(n + i, vectors[3][1]) for i in range(130)]  # a third are copies
    vectors += [(9000, None), (9001, []), (9002, [0.0] * 5), (9003, [1.0, None, 0.0, 0.0, 0.0]), (9004, [float("nan")] * 5), (9005, [1.0, 2.0]), (None, [1.0] * 5), (9006, [1e200, 0.0, 0.0, 0.0, 1e200])]
    questions = [(i, v) for i, v in vectors if i is not None and i % 7 == 0] + [(8000, [-x for x in vectors[0][1]]), (8001, rng.normal(size=5).tolist()), (8002, None), (8003, [1e-200, 0.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(vectors, "i long, v array<double>").repartition(4)
    q = spark.createDataFrame(questions, "q long, v array<double>").repartition(3)
    got = cells.Cells(v, "i", "v", cells=9, ring=ring).search(q, "q", "v", 6, batch=batch).collect()
    assert sorted(map(tuple, got)) == plain(vectors, questions, 6)
    assert cells.Cells(v.where("false"), "i", "v").search(q, "q", "v", 3).collect() == []


def test_rings_travel_for_groups_of_batches(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(900)], "i long, v array<double>").repartition(4)
    index = cells.Cells(rows, "i", "v", cells=4, ring=10)
    asked = index._in_rings(cells._valid(rows, "i", "v"), 10, "batches")
    places = cells.PLACES * spark.sparkContext.defaultParallelism
    # every ring beside every batch would be 8100 rows at least
    assert index._dealt(asked, cells.HELD).count() <= (asked.count() + index.rings.count()) * (places**0.5 + 2) < 8100


def test_questions_of_conversations(spark):
    from loam.functions import hashing

    got = sorted(map(tuple, registry.QUERIES["vector_questions"](spark, SF).collect()))
    docs = [(r.doc_id, r.v) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", hashing.hash_embedding(F.col("text"), 64).alias("v")).collect()]
    asked = [(r.a, r.v) for r in spark.read.parquet(f"{SF}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("a"), hashing.hash_embedding(F.col("text"), 64).alias("v")).collect()]
    assert got == plain(docs, asked, 5)


def test_postings_answer_as_a_scan_does(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = postings.Postings(spark, str(tmp_path / "i"), "doc_id", buckets=8)
    index.add(docs.where("doc_id < 90"), "text")
    index.add(docs.where("doc_id >= 60"), "text", ("d", 0))  # some are indexed already
    index.add(docs.where("doc_id >= 60"), "text", ("d", 0))
    asked = [(1, ["tion", "the", "quell", "ment"]), (2, ["a"]), (3, ["nowhereatall"]), (4, ["th", "nowhere"]), (5, []), (6, ["the", "the", None, ""]), (7, ["é"])]
    got = index.search(spark.createDataFrame(asked, "q int, words array<string>"), "q", "words", 20).collect()
    for q, words in asked:
        words = list(dict.fromkeys(w for w in words if w))
        want = [tuple(r) for r in retrieve.fulltext(docs, "doc_id", "text", words, 20).collect()] if words else []
        assert sorted((r.doc_id, r.score) for r in got if r.q == q) == sorted(want)


def test_postings_finish_a_batch_that_failed(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (None, "x"), (3, None)], "doc_id long, text string")
    index = postings.Postings(spark, str(tmp_path / "i"), "doc_id", buckets=2)
    append = index.grams.append

    def lost(*args):
        raise OSError("lost")
    monkeypatch.setattr(index.grams, "append", lost)
    with pytest.raises(OSError):
        index.add(docs, "text", ("d", 0))
    monkeypatch.setattr(index.grams, "append", append)
    index.add(docs, "text", ("d", 0))
    got = index.search(spark.createDataFrame([(1, ["bet", "gam"])], "q int, words array<string>"), "q", "words", 5).collect()
    assert sorted((r.doc_id, r.score) for r in got) == [(1, 5000), (2, 10000)]
    assert index.postings.read().count() == 4 and len(index.postings.read_for(spark.createDataFrame([("alpha",)], "w string")).inputFiles()) == 1


def test_postings_of_frequent_words(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("the and "), F.when(F.col("id") % 3 == 0, "for ").otherwise(""), F.col("id").cast("string")).alias("text"))
    index = postings.Postings(spark, str(tmp_path / "i"), "doc_id", buckets=4)
    index.add(docs, "text")
    asked = spark.range(300).select(F.col("id").alias("q"), F.array(F.lit("the"), F.lit("for"), F.lit("an")).alias("words"))
    out = index.search(asked, "q", "words", 5)
    assert sorted(map(tuple, out.collect())) == [(q, d, 10000) for q in range(300) for d in (0, 3, 6, 9, 12)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_shards_count_as_a_scan_does(k):
    rng = np.random.default_rng(k)
    ws, docs = rng.integers(0, 9, 900), rng.integers(0, 80, 900) * 7
    shard = postings._Shard([ws[:500], ws[500:]], [docs[:500], docs[500:]])
    for of in (3, 30000):
        for asked in ([1], [1, 2, 5], [0, 99, 3, 4], [77]):
            n = {d: len({w for w, x in zip(ws, docs, strict=True) if x == d and w in asked}) for d in set(docs.tolist())}
            want = sorted(((-int(np.floor(c / of * 10000 + 0.5)), d) for d, c in n.items() if c))[:k]
            place, score = shard.best(asked, of, k)
            assert list(zip((-score).tolist(), shard.docs[place].tolist(), strict=True)) == want

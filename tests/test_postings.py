"""Postings asked by many questions: what is made on the way, and the same answers in blocks of any size."""
import numpy as np
import pyarrow as pa
import pytest
from loam.operators import postings

from pyspark.sql import functions as F


def plain(docs, words, k):
    """docs: the tokens of each; words: distinct ones of a question."""
    held = {d: sum(any(w in t for t in ts) for w in words) for d, ts in docs.items()}
    return sorted((-int(np.floor(n / len(words) * 10000 + 0.5)), d) for d, n in held.items() if n)[:k]


def test_no_row_for_a_word_and_what_holds_it(spark, tmp_path, monkeypatch):
    made, real = {}, postings.written

    def written(df, name, *by):
        out = real(df, name, *by)
        made.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(postings, "written", written)
    monkeypatch.setattr(postings, "FEW", 100, raising=False)
    docs = spark.range(300).select("id", F.concat(F.lit("abcdefghijklmnopqrstuvwxyz"), F.col("id").cast("string")).alias("text"))
    index = postings.Postings(spark, str(tmp_path / "i"), "id", buckets=2)
    index.add(docs, "text")
    made.clear()
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [letters[a:b] for a in range(26) for b in range(a + 1, 27)]
    asked = [(q, [words[q], words[-1 - q], str(q)]) for q in range(len(words))]
    got = index.search(spark.createDataFrame(asked, "q long, words array<string>"), "q", "words", 2).collect()
    held = {d: [f"{letters}{d}"] for d in range(300)}
    assert sorted((r.q, -r.score, r.id) for r in got) == sorted((q, *x) for q, ws in asked for x in plain(held, dict.fromkeys(ws), 2))
    # 300 tokens and documents, each of which holds every word: nothing grows with words times these
    assert max(n for ns in made.values() for n in ns) <= max(len(words), 300)


@pytest.mark.parametrize(("few", "at_once", "block"), [(0, 3, 64), (0, 1 << 16, 1 << 26), (1000, 1 << 16, 1 << 12)])
def test_blocks_of_any_size_answer_the_same(monkeypatch, few, at_once, block):
    for name, value in (("FEW", few), ("AT_ONCE", at_once), ("HELD", block)):
        monkeypatch.setattr(postings, name, value)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("ab1"), n))
    docs = {int(d) * 3: list(dict.fromkeys(word(rng.integers(1, 45 if d == 5 else 7)) for _ in range(rng.integers(0, 9)))) for d in range(150)}
    asked = [list(dict.fromkeys(word(rng.integers(1, 4)) for _ in range(n))) for n in rng.integers(1, 6, 60)] + [["zz"], ["a", "zz"], [word(n % 5 + 1) + "" for n in range(30)]]
    asked = [list(dict.fromkeys(ws)) for ws in asked]
    of = [len(ws) for ws in asked]
    said = [" ".join(w for w in ws) for ws in asked]
    batch = lambda **c: pa.RecordBatch.from_pydict(c, pa.schema([("of", pa.int32()), ("said", pa.string()), ("doc", pa.int64()), ("asks", pa.int64())]))
    rows = [(t, d) for d, ts in docs.items() for t in ts]
    rng.shuffle(rows)
    rows = [(str(t), int(d)) for t, d in rows]
    batches = [batch(of=[0] * len(x), said=[t for t, _ in x], doc=[d for _, d in x], asks=[None] * len(x)) for x in (rows[:200], rows[200:])]
    n = len(asked)
    batches += [batch(of=of[i:i + 7], said=said[i:i + 7], doc=[None] * len(of[i:i + 7]), asks=list(range(i, min(n, i + 7)))) for i in range(0, n, 7)]
    for k in (1, 4, 200):
        got = [r for b in postings._best(k)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted((q, -s, d) for q, d, s in got) == sorted((q, *x) for q, ws in enumerate(asked) for x in plain(docs, ws, k))
    assert list(postings._best(3)(iter(batches[2:]))) == []


def test_the_least_text_of_a_key_is_indexed(spark, tmp_path):
    index = postings.Postings(spark, str(tmp_path / "i"), "id", buckets=2)
    index.add(spark.createDataFrame([(1, "beta"), (1, "alpha"), (1, None), (2, None), (2, None), (3, "gamma"), (None, "x"), (None, "y")], "id long, text string"), "text")
    assert sorted(map(tuple, index.postings.read().collect())) == [("alpha", 1), ("gamma", 3)] and index.docs.read().count() == 3

"""The registered queries on the smallest tables against plain versions, and methods that SQL can't express against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from loam.llm import apportion, mil_toxicity, ngram_bloom, norm_buckets, pitman_yor, registry, rule_forest, secret_ownership
from loam.llm import vectext as vt

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def run(spark, name):
    return {r.doc_id: r for r in registry.QUERIES[name](spark, SF).collect()}


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def test_language_query(spark, docs):
    got = run(spark, "op1_ngram_bloom")
    assert set(got) == set(docs)
    assert all(r.held_out == held(i, 4, 2) and 0 <= r.score <= 1 for i, r in got.items())
    tested = [i for i, r in got.items() if r.held_out and docs[i]["lang"]]
    assert sum(got[i].lang_pred == docs[i]["lang"] for i in tested) >= 0.9 * len(tested)


def plain_grams(text):
    low = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in text.lower().encode())
    return [low[i:i + 4] for i in range(len(low) - 3) if b"  " not in low[i:i + 4]]


def test_language_against_exact_sets(spark):
    # 70 languages need two masks a slot
    rng = random.Random(7)
    rows = []
    for n in range(70):
        words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(8)]
        rows += [(f"l{n:02}", " ".join(rng.choices(words, k=40))) for _ in range(4)]
    model = ngram_bloom.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model[0]) == 70 and model[1].shape[0] == 2
    counts = defaultdict(Counter)
    for lang, text in rows:
        counts[lang].update(plain_grams(text))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    top = Counter()
    for lang, c in counts.items():
        for g, n in c.items():
            if n >= ngram_bloom.LEAST:
                top[g] = max(top[g], n / total[lang])
    own = {lang: {g for g, n in c.items() if n >= ngram_bloom.LEAST and n / total[lang] >= ngram_bloom.SHARE * top[g]} for lang, c in counts.items()}
    texts = [(i, t) for i, (_, t) in enumerate(rows[::4])] + [(900, None), (901, "123"), (902, "")]
    got = {r.doc_id: r for r in ngram_bloom.predict(spark.createDataFrame(texts, "doc_id long, text string"), model, F.lit(False)).collect()}
    for i, text in texts[:70]:
        hits = {lang: sum(g in own[lang] for g in plain_grams(text)) for lang in own}
        best = max(hits, key=lambda x: (hits[x], x))
        assert got[i].lang_pred == best and abs(got[i].score - hits[best] / sum(hits.values())) < 0.05
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3


def plain_toxicity(model, text):
    names, w, b = model
    weight = dict(zip(names.tolist(), w.tolist(), strict=True))

    def one(word, n):
        data = np.frombuffer(word, np.uint8)
        return int(vt.hashes(data, np.array([0]), np.array([min(n, len(word))]))[0])

    keep = 1.0
    for sentence in re.split(rb"[.!?\n]", (text or "").encode()):
        words = re.findall(rb"[a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in sentence))
        if words:
            z = b + sum(weight.get(one(x, len(x)), 0) + sum(weight.get(one(x, k) ^ (k << 56), 0) for k in mil_toxicity.HEADS) for x in words)
            keep *= 1 - min(1 / (1 + math.exp(-max(-30, min(30, z)))), 1 - 1e-12)
    return 1 - keep


def test_toxicity_query_against_a_plain_scorer(spark, docs):
    got = run(spark, "op2_mil_toxicity")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = mil_toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels.where(~mil_toxicity.held_out_third()))
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == held(i, 3, 1) and r.predicted == int(r.score >= 0.7)
        assert abs(r.score - plain_toxicity(model, docs[i]["text"])) < 1e-6


def test_toxicity_sample_counts_documents(spark, monkeypatch):
    # ten rows of one clean document don't push the toxic ones out; doc 9 has both labels
    monkeypatch.setattr(mil_toxicity, "SAMPLE", (3, 3))
    seen = []
    monkeypatch.setattr(mil_toxicity, "fit_weights", lambda texts, labels: seen.append((texts, labels.tolist())))
    rows = [(0, "clean words")] * 10 + [(1, "vile words"), (1, "other words"), (2, None), (9, "both")]
    labels = spark.createDataFrame([(0, 0), (1, 1), (1, 1), (2, 1), (9, 0), (9, 1)], "doc_id long, toxic int")
    mil_toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    (texts, marks), = seen
    assert len(texts) == 3 and sorted(marks) == [0, 1, 1] and texts.count("clean words") == 1
    monkeypatch.setattr(mil_toxicity, "FIT_BYTES", 11)
    mil_toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert sum(len(t or "") for t in seen[1][0]) <= 11


def test_token_query(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, at, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, run(spark, "op3_orc_tokens")
    for i in sorted(docs):
        ids = [*tok.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def plain_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end(), "assign", m[2]) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access", m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def plain_live(value):
    return len(set(value)) >= 8 and re.search("[0-9]", value) and re.search("[A-Za-z]", value) and not re.search(secret_ownership.PLACEHOLDER, value)


def check_secrets(got, rows):
    owners, spans = defaultdict(set), {}
    for i, text, source in rows:
        text = text or ""
        base = plain_spans(text)
        free = [(m.start(), 3, m.end(), "token", m[0]) for m in re.finditer(secret_ownership.TOKEN, text) if plain_live(m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and not any(m.start() < y[2] and y[0] < m.end() for y in base)]
        spans[i] = base, free
        for x in base + free:
            owners[x[4]].add(source)
    for i, _, _ in rows:
        base, free = spans[i]
        added = [x for x in free if plain_live(x[4]) and len(owners[x[4]]) < secret_ownership.OWNERS]
        said = lambda xs: ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in xs)
        r = got[i]
        kinds = Counter(x[3] for x in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(said(base).encode()).hexdigest() and r.spans == said(sorted(base + added))
        assert r.n_live == len({x for x in base + free if plain_live(x[4]) and len(owners[x[4]]) < secret_ownership.OWNERS})
        assert r.n_examples == len({x for x in base + free if len(owners[x[4]]) >= secret_ownership.OWNERS})


def test_secret_query(spark, docs):
    check_secrets(run(spark, "op5_secret_ownership"), [(i, r["text"], r["source"]) for i, r in docs.items()])


def test_secrets_with_hundreds_of_matches(spark, tmp_path):
    rng = random.Random(4)
    pool = ["".join(rng.choices("ABCDEFabcdef0123456789Gh", k=30)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice([f"é password={rng.choice(pool)[:8]}", rng.choice(pool), "0123456789abcdef" * 2, "AKIA" + "Z9" * 9, "漏洞"]) for _ in range(rng.choice([3, 900]))), f"s{i % 5}") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    check_secrets({r.doc_id: r for r in secret_ownership.op5_secret_ownership(spark, str(tmp_path)).collect()}, rows)


def test_mask_keeps_columns_of_any_name(spark):
    value = "Qz7Lm2Xv9Kp4Rt8Wn3Yb6Hd1"
    names = ["spans", "d", "k", "k_", "row", "key", "text_key", "value_key", "span"]
    rows = spark.createDataFrame([(1, f"see {value} here", "a"), (2, None, "b"), (None, f"{value} alone", "a")], "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in names})
    got = secret_ownership.mask(rows)
    assert got.columns == rows.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "see [SECRET] here", 2: None, None: "[SECRET] alone"}
    assert all(r[c] == c for r in got.collect() for c in names)


def test_language_model_query(spark, docs):
    got = run(spark, "op6_pitman_yor")
    lower = {i: i + 32 for i in range(65, 91)}
    toks = {i: [*WORD.findall((r["text"] or "").translate(lower)), None] for i, r in docs.items()}
    count = Counter(w for i, t in toks.items() for w in t if not held(i, 7, 2))
    n, v = sum(count.values()), len(count)
    for i, r in got.items():
        t = toks[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 7, 2), len(t), sum(count[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
    out = [i for i in docs if held(i, 7, 2)]
    # perplexity on what wasn't learned from is below that of add-one counts
    assert sum(got[i].score for i in out) > sum(got[i].base_score for i in out)
    assert pitman_yor.SAMPLES == 2


def plain_paths(tree, x):
    feature, value, child = tree
    at = 0
    while feature[at] >= 0:
        at = child[at] + int(x[feature[at]] >= value[at])
    return value[at]


def test_rule_query(spark, docs):
    got = run(spark, "op7_rule_forest")
    for i, r in got.items():
        text = docs[i]["text"] or ""
        w = WORD.findall(text)
        triples = Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = {k + j for k in range(len(w) - 2) if triples[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_forest_verdicts_against_a_plain_forest(spark):
    # rare shouting documents are labelled bad, all others good
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 10 == 0
        words = ["".join(rng.choices("ABCDEFGH" if bad else "abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 120))]
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    train, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in rule_forest.judge(train, labels).collect()}
    stats = {r.doc_id: np.array(r.features) for r in rule_forest.statistics(train).collect()}
    x = np.array([stats[i] for i in range(400)])
    trees = rule_forest.grow(x)
    plain = [2.0 ** (-sum(plain_paths(t, r) for t in trees) / len(trees) / rule_forest._depth(4)) for r in x[:20]]
    assert np.allclose(plain, rule_forest.anomaly(trees, x[:20], 4))
    # the verdict is the lowest cut of the profile above which labelled rows are bad
    mark = {r.doc_id: r.quality for r in labels.collect()}
    by = defaultdict(list)
    for i, q in mark.items():
        by[got[i].profile].append((int(got[i].anomaly * rule_forest.BINS), q))
    for i, r in got.items():
        cut = 2.0
        for b in sorted({b for b, _ in by[r.profile]}, reverse=True):
            above = [q for c, q in by[r.profile] if c >= b]
            if len(above) >= rule_forest.LEAST and above.count(0) >= rule_forest.PRECISION * len(above):
                cut = b / rule_forest.BINS
        assert r.kept == (r.anomaly < cut)
    assert sum(not got[i].kept for i in range(0, 400, 10)) >= 30 and all(got[i].kept for i in range(400) if i % 10)


def test_bpe_query(spark, docs):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in run(spark, "op8_tree_bpe").items():
        text = docs[i]["text"] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    stopped = {}
    while True:
        free = [s for s in names if s not in stopped]
        left = sum(sizes.values()) - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free} if free else {}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in over}


def test_mix_query(spark, docs):
    got = run(spark, "op9_apportion")
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in docs.items()}
    total = Counter()
    for i, r in docs.items():
        total[r["source"]] += size[i]
    want, taken = plain_targets(dict(total)), Counter()
    for i, r in got.items():
        s = docs[i]["source"]
        assert (r.size, r.source_size) == (size[i], total[s]) and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - t) <= max(32, 0.02 * t) for s, t in want.items())
    assert {i: r.taken for i, r in got.items()} == {i: r.taken for i, r in run(spark, "op9_apportion").items()}


def test_seats_of_many_keys(spark):
    rng = random.Random(11)
    votes = [rng.choice([0, 1, 1, 2, 3, 1000, 7.5]) for _ in range(300)]
    for seats in (1, 40, 333, 5000):
        won = [0] * len(votes)
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[i] += 1
        rows = spark.createDataFrame([(1, i, float(v), seats) for i, v in enumerate(votes)], "g int, s int, v double, seats long")
        assert {r.s: r.quota for r in apportion.sainte_lague(rows, ["g"], "s", "v", "seats").collect()} == dict(enumerate(won))


def test_norm_bucket_query(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{SF}/embeddings.parquet'")
    want = {(q, r): (v, s) for q, r, v, s in con.sql(norm_buckets.ORACLE["op10_norm_buckets"]).fetchall()}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in registry.QUERIES["op10_norm_buckets"](spark, SF).collect()} == want


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one two three four five six seven", "en", "a", 33), (1, "one two three four five six seven", "en", "a", 33), (2, None, None, None, None), (None, "x " * 3000, "en", "b", 6000), (3, "", "en", "a", 0), (None, None, None, None, None), (4, "漏洞 é", "zh", None, 4)]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            want = {"toxicity": n, "near_duplicates": max(0, n - 1), "secrets": max(0, n - 1)}.get(name)
            assert want is None or docs.count() == want
            assert name == "encoding" or docs.columns == corpus_pipeline.COLUMNS
        assert {r.doc_id for r in docs.collect()} <= {1, 2, 3, 4, None}


def test_word_hash_lanes(spark):
    words = [b"a", b"b", b"a\0", b"abcdefgh", b"abcdefghi", b"x" * 64, b"x" * 65, b"x" * 5000]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    both = {(int(x), int(y)) for x, y in zip(vt.hashes(data, ends - [len(w) for w in words], ends), vt.hashes(data, ends - [len(w) for w in words], ends, 1), strict=True)}
    assert len(both) == len(words) and all(x != y for x, y in both)
    assert pa.array([1]).type == pa.int64()


def test_pipeline_against_plain_stages(spark):
    import base64

    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from tests.llm.test_operators import plain_components

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = mil_toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in docs.collect()}
    marked = {r.doc_id for r in labels.where("toxic = 1").collect()}
    one = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    clean = {i for i, r in rows.items() if plain_toxicity(model, r.text) < 0.7} - marked
    assert {r.doc_id for r in one.collect()} == clean
    two = corpus_pipeline.drop_near_duplicates(spark, one, SF).cache()
    ordered = sorted(clean)
    parent = plain_components([rows[i].text for i in ordered], 5)
    assert sorted(r.doc_id for r in two.collect()) == [ordered[n] for n, p in enumerate(parent) if n == p]
    left = {r.doc_id: r for r in two.collect()}
    three = corpus_pipeline.mask_secrets(spark, two, SF).cache()
    owners, spans = defaultdict(set), {}
    for i, r in left.items():
        text = r.text or ""
        base = plain_spans(text)
        free = [(m.start(), 3, m.end(), "token", m[0]) for m in re.finditer(secret_ownership.TOKEN, text) if plain_live(m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and not any(m.start() < y[2] and y[0] < m.end() for y in base)]
        spans[i] = sorted(base + free)
        for x in spans[i]:
            owners[x[4]].add(r.source)
    masked = {r.doc_id: r.text for r in three.collect()}
    for i, r in left.items():
        out, at = "", 0
        for a, _, b, _, value in spans[i]:
            if len(owners[value]) < secret_ownership.OWNERS:
                if a >= at:
                    out += (r.text or "")[at:a] + "[SECRET]"
                at = max(at, b)
        assert masked[i] == (r.text if r.text is None else out + r.text[at:])
    four = corpus_pipeline.mix_sources(spark, three, SF).cache()
    size = {i: len(WORD.findall(x or "")) for i, x in masked.items()}
    total, taken = Counter(), Counter()
    for i in left:
        total[left[i].source] += size[i]
    times = Counter(r.doc_id for r in four.collect())
    for i, n in times.items():
        taken[left[i].source] += n * size[i]
    # whole documents only: off by half a document each at most
    for s, want in plain_targets(dict(total)).items():
        assert abs(taken[s] - want) <= 32 + sum(size[i] for i in left if left[i].source == s) / 2 and max(times.values()) <= 3
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(enc.encode_ordinary(r.text or ""))) for r in four.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.encode(spark, four, SF).collect()) == want

"""Every fixture query against its SQL in DuckDB."""
import duckdb
import pytest

from loam.operators import graph, leaders, resolve
from loam.plans import registry

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as from '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    if name not in registry.ORACLE:
        assert rows
        return
    want = con.sql(registry.ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    assert rows == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in want.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def plain_leaders(rows, threshold):
    want, found = {}, []
    for k, f in rows:
        hit = next((x for x, g in found if f is not None and ((f ^ g) % (1 << 64)).bit_count() <= threshold), None)
        want[k] = k if hit is None else hit
        if hit is None and f is not None:
            found.append((k, f))
    return want


def test_leader_clusters_walk_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.fingerprint) for r in resolve.simhash60(docs, "doc_id", "text").collect())
    want = plain_leaders(rows, 15)
    assert {r.doc_id: r.leader for r in registry.QUERIES["leader_clusters"](spark, SF).collect()} == want
    got = leaders.leader_clusters(spark.createDataFrame(rows, "doc_id long, fingerprint long"), "doc_id", 15, first=20, block=16)
    assert {r.doc_id: r.leader for r in got.collect()} == want


def test_leaders_depend_on_order(spark):
    # a chain in order, where a round settles a few; repeated and null fingerprints; keys that are texts
    import random

    rng = random.Random(6)
    prints, at = [], 0
    for _ in range(40):
        at ^= 1 << rng.randrange(64)
        prints.append(at - (1 << 64) if at >> 63 else at)
    prints += prints[:7] + [rng.getrandbits(63) for _ in range(30)] + [None, None]
    rows = [(f"k{i:03}", p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "key string, fingerprint long").repartition(3)
    for first in (9, 1000):
        assert {r.key: r.leader for r in leaders.leader_clusters(df, "key", 3, first=first, block=16).collect()} == plain_leaders(rows, 3)
    assert leaders.leader_clusters(df.where("false"), "key", 3).collect() == []


def test_similar_merge_against_a_plain_walk(spark):
    from loam.functions import hashing, text
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    said = F.coalesce(F.nullif(F.trim(text.clean_text(F.col("text"))), F.lit("")), F.concat(F.lit("PYSEC-2024-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")))
    rows = sorted((r.doc_id, r.f) for r in docs.select("doc_id", hashing.simhash64(said).alias("f")).collect())
    want = plain_leaders(rows, 15)
    got = {r.vuln_id: r.n_aliases for r in registry.QUERIES["similar_merge"](spark, SF).collect()}
    assert set(got) == {f"PYSEC-2024-{k:012}" for k in want.values()}
    assert sum(got.values()) >= len(rows) - len(got)  # texts may name other ids as well


def test_membership_loses_no_link(spark):
    rows = [(i, 1) for i in range(5)] + [(i, 2) for i in range(3, 6)] + [(0, 1), (9, 3), (7, None)]
    df = spark.createDataFrame(rows, "k long, v long")
    members = [tuple(r) for r in graph.members(df, "k", "v").collect()]
    got = {(v, a, b) for v, a, *_ in members for w, b, *_ in members if v == w and a != b}
    assert got == {(v, a, b) for a, v in rows for b, w in rows if v is not None and v == w and a != b}
    assert all((first, n) == (min(a for w, a, *_ in members if w == v), sum(w == v for w, *_ in members)) for v, _, first, n in members)
    assert sorted(tuple(r) for r in graph.heavy(df, "k", "v", 3).collect()) == [(1, i, 5) for i in range(5)]


def test_near_pairs_miss_none(spark):
    import random

    rng = random.Random(2)
    prints = [rng.getrandbits(60) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(60), rng.randint(0, 5))) for p in prints for _ in range(3)]
    rows = list({p: i for i, p in enumerate(prints)}.items())
    got = {(r.a, r.b): r.distance for r in resolve.near_pairs(spark.createDataFrame([(i, p) for p, i in rows], "k long, fingerprint long"), "k", 3).collect()}
    want = {(min(i, j), max(i, j)): (p ^ q).bit_count() for p, i in rows for q, j in rows if i < j and (p ^ q).bit_count() <= 3}
    assert got == want


def test_hashes_against_plain_ones(spark):
    import hashlib
    import math

    from pyspark.sql import functions as F

    from loam.functions import hashing

    texts = ["the cat the dog", "", None, "漏洞库 a1 b", "x " * 500, "ab cd ef " * 40000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", hashing.simhash64("s").alias("h"), hashing.hash_embedding(F.col("s"), 16).alias("e"))
    number = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
    for r in df.collect():
        bits = [sum(1 if number(t) >> b & 1 else -1 for t in hashing.plain_tokens(texts[r.i])) for b in range(64)]
        assert r.h % (1 << 64) == sum(1 << b for b in range(64) if bits[b] > 0)
        v = [0.0] * 16
        for t in hashing.python_hash_tokens(texts[r.i]):
            v[number(t) % 16] += 1 if number(t) & 1 else -1
        n = math.sqrt(sum(x * x for x in v))
        assert all(abs(x - (y / n if n else 0)) < 1e-5 for x, y in zip(r.e, v, strict=True))


def test_feed_rows_that_are_refused(spark):
    from loam.sources import feeds

    rows = [('{"nothing": 1}', "nvd", None), ("not json", "nvd", "x1"), ('{"cve": {"id": "CVE-2024-1234"}}', "nvd", None)]
    bronze = spark.createDataFrame(rows, "raw_text string, source string, source_id string")
    assert [r.raw_text for r in feeds.rejects(bronze).collect()] == ['{"nothing": 1}']
    assert sorted(r.vuln_id for r in feeds.normalize(bronze).collect()) == ["CVE-2024-1234", "x1"]


def test_hybrid_isolates_failures(spark):
    from loam.operators import retrieve

    def broken():
        raise OSError("down")
    found, failed = retrieve.hybrid({"vector": broken, "fulltext": lambda: spark.range(2), "graph": broken}, ["vector", "graph"], {"vector": "fulltext"})
    assert [f.count() for f in found] == [2] and failed == ["vector", "graph"]
    # a route may also fail in a task
    late = lambda: spark.range(3).withColumn("id", F.when(F.col("id") == 1, F.raise_error(F.lit("down")).cast("long")).otherwise(F.col("id")))
    found, failed = retrieve.hybrid({"vector": late, "fulltext": lambda: spark.range(2), "graph": lambda: spark.range(5)}, ["vector", "graph"], {"vector": "fulltext"})
    assert sorted(f.count() for f in found) == [2, 5] and failed == ["vector"]


def test_fusion_ranks_a_bounded_part_of_a_route(spark):
    from loam.operators import retrieve

    long = spark.range(50).select("id", (100 - F.col("id")).alias("score"))
    got = retrieve.rrf([(long, 1.0)], "id", k=60, top=100, depth=7).collect()
    assert [r.id for r in got] == list(range(7)) and got[0].rrf == 16393


def test_api_refuses_what_it_does_not_know(spark):
    from loam import api

    for bad in ({"severity": ["urgent"]}, {"limit": 101}):
        with pytest.raises(ValueError):
            api.vulnerabilities(None, **bad)


def test_similar_records_without_an_id_merge(spark):
    from loam.sources import feeds

    words = " ".join(f"word{i}" for i in range(60))
    osv = lambda i, said: f'{{"id": "PYSEC-2024-{i}", "details": "{said}", "aliases": []}}'
    rows = [(osv(1, words),), (osv(2, words + " more"),), (osv(3, "something else " + "entirely different here " * 9),), ('{"cve": {"id": "CVE-2024-1111", "descriptions": [{"lang": "en", "value": "' + words + '"}]}}',)]
    silver = feeds.normalize(spark.createDataFrame(rows, "raw_text string"))
    got = {r.vuln_id: sorted(r.aliases) for r in feeds.merge_sources(silver, similar=True).collect()}
    assert got == {"CVE-2024-1111": [], "PYSEC-2024-1": ["PYSEC-2024-2"], "PYSEC-2024-3": []}
    assert feeds.merge_sources(silver).count() == 4


def test_subgraph_of_all_orders(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_partkey").distinct()
    got = registry.QUERIES["subgraph_mapping"](spark, "/root/testdata/sf0.001")
    assert got.select("src", "dst").exceptAll(rows).isEmpty() and rows.exceptAll(got.select("src", "dst")).isEmpty()


def test_simhash_moves_no_tokens(spark):
    docs = spark.range(40).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: (i * F.col("id")).cast("string")), " ").alias("text"))
    plan = resolve.simhash60(docs, "id", "text")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2  # sums within a task, then one row of sums a task and text


def test_facts_are_distinct_within_an_order(spark):
    out = registry.QUERIES["facts_only_subgraph"](spark, SF)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert out.count() == out.distinct().count() and "HashAggregate" not in plan.replace("ObjectHashAggregate", "")

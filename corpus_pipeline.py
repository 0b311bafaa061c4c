"""A corpus pipeline of five stages, each written and read again as the next one's documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import apportion, mil_toxicity, minhash_forest, secret_ownership, tree_bpe
from loam.llm.shared import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't predict toxic; a document labelled toxic goes as well."""
    labels = table(spark, sf_dir, "labels")
    kept = mil_toxicity.keep_clean(docs, mil_toxicity.fit(docs, labels))
    # a written table of ids has a known size: while it is small the texts stay in place, else they are shuffled once
    marked = materialize(labels.where("toxic = 1").select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct(), "marked")
    return kept.join(marked, "doc_id", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the least doc_id, and of several texts of that doc_id one. Rows without doc_id stay."""
    return minhash_forest.keep_one(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with live-looking credentials masked; widely copied examples stay readable."""
    return secret_ownership.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: each whole pass is a row, and a part of at least half the document one more. Rows that agree in doc_id and text share what they got evenly."""
    mixed = apportion.mix(docs, [1, 2, 3])
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0))
    mixed = mixed.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.floor(F.avg(times) + 0.5).cast("int").alias("times")).where("times > 0")
    rows = docs.withColumn("k_", F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(mixed, rows.doc_id.eqNullSafe(mixed.d) & (rows.k_ == mixed.k))
    return rows.withColumn("i", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    import public_tokenizers

    return tree_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("encoding", encode)]
#: Noisy-or training, MinHash orders, seeded shares and BPE can't be told in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

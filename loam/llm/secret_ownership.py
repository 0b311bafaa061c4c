"""Secret scans with corpus-wide ownership frequency, in built-in functions only.

A scan finds base spans (assignments, access keys, hexadecimal strings) and further random-looking tokens. Every candidate's hash is
counted over the corpus: in how many documents (repositories) and how many sources (owners) it occurs. A value that
many owners share is a copied example; one that few own and that looks random is taken as live. Live tokens
outside the base spans are added to the spans; base spans stay.

Positions are code points, end exclusive. They come from splitting a text at the matches: lengths of pieces and matches add up, CHUNK matches at a time, so a text
full of matches costs no square of their number.

Defined cases: a null or empty text has no spans; repeated rows give repeated results and count as one repository; a null source is an owner
of its own; a null doc_id is passed on and its values count for one repository; very long texts are scanned whole; a value that a third of all rows hold is joined in SALTS parts; other columns are ignored by the scan and kept by the mask, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The shortest lengths are part of the patterns where a match can't fail in another way.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+_-])[A-Za-z0-9+_-]{24,}"
#: Words that mark placeholders.
PLACEHOLDER = r"(?i)example|sample|dummy|test|changeme|your|xxxx|0000|1234"
#: A value of so many owners is a copied example.
OWNERS = 3
#: Matches of a text that are worked on together; parts of each value in the join with its owners.
CHUNK, SALTS = 256, 16
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _spans(text: Column, pattern: str, kind: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches; group's length decides whether a match counts."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), hits.alias("hit"), values.alias("value"))
    rows = F.filter(rows, lambda x: x["hit"].isNotNull())
    part = lambda k: F.slice(rows, k * CHUNK + 1, F.lit(CHUNK))
    parts = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int"))
    length = lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: a + F.length(x["piece"]) + F.length(x["hit"]))
    begins = F.aggregate(F.transform(parts, length), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    none = F.expr(f"cast(array() as {_SPAN})")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + F.length(x["piece"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).cast(_SPAN).alias("out"))

    # most texts have no match and skip the loop
    whole = lambda k: F.aggregate(part(k), F.struct(F.element_at(begins, k + 1).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    found = F.when(F.size(hits) > 0, F.flatten(F.transform(parts, whole))).otherwise(none)
    return F.filter(found, lambda x: F.length(x["value"]) >= least) if least else found


def live_looking(value: Column) -> Column:
    """Random-looking: enough different characters, digits among letters, and no placeholder word."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (different >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, base, tokens) of docs (doc_id, text, source): all candidate spans of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text.alias("text"))
    t = F.col("text")
    rows = rows.select("doc_id", "source", F.xxhash64("text").alias("text_key"), _spans(t, ASSIGN, "assign", 0, 2, 6).alias("assign"), _spans(t, ACCESS, "access", 1).alias("access"), _spans(t, HEX, "hex", 2).alias("hex"),
                       F.filter(_spans(t, TOKEN, "token", 3), lambda x: live_looking(x["value"]) & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]")).alias("tokens"))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.withColumn("base", base)
    # sorted by start: a chunk with its bounds is looked into only where a token may overlap it
    chunk = lambda k: F.slice("base", k * CHUNK + 1, F.lit(CHUNK))
    bounds = F.transform(F.sequence(F.lit(0), F.floor((F.size("base") - 1) / CHUNK).cast("int")), lambda k: F.struct(chunk(k)[0]["start"].alias("lo"), F.array_max(F.transform(chunk(k), lambda y: y["end"])).alias("hi"), chunk(k).alias("spans")))
    rows = rows.withColumn("chunks", F.when((F.size("base") > 0) & (F.size("tokens") > 0), bounds))
    inside = lambda x, y, lo, hi: (x["start"] < y[hi]) & (y[lo] < x["end"])
    free = F.when(F.col("chunks").isNull(), F.col("tokens")).otherwise(F.filter("tokens", lambda x: ~F.exists("chunks", lambda c: inside(x, c, "lo", "hi") & F.exists(c["spans"], lambda y: inside(x, y, "start", "end")))))
    base = F.col("base")
    return rows.select("doc_id", "source", "text_key", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), base.alias("base"), free.alias("tokens"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_key, n_docs, n_owners) from candidates (value_key, source, doc_id): each step counts what it has before it shuffles."""
    once = candidates.select("value_key", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("none"), "doc_id").distinct()
    owned = once.groupBy("value_key", "source", "none").agg(F.count("*").alias("n"))
    return owned.groupBy("value_key").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_owners"))


def owned(each: DataFrame) -> DataFrame:
    """each (value_key, doc_id, ...) with n_docs and n_owners of its value. Every value's counts are there once for each part, so rows of one value spread over SALTS tasks."""
    counts = ownership(each).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int")).join(counts, ["value_key", "salt"]).drop("salt")


def find_secrets(docs: DataFrame, owners: int = OWNERS) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_assign, n_access, n_hex, base, added, n_live, n_examples. base and added are spans."""
    found = materialize(scan(docs), "secrets")
    each = found.select("doc_id", "source", "text_key", F.explode(F.concat("base", "tokens")).alias("span"))
    each = each.select("doc_id", "source", "text_key", "span", F.md5(F.col("span.value").cast("binary")).alias("value_key"))
    judged = owned(each)
    live = live_looking(F.col("span.value")) & (F.col("n_owners") < owners)
    one = judged.select("doc_id", "text_key", "span", live.alias("live"), (F.col("n_owners") >= owners).alias("example")).distinct()
    added = F.collect_list(F.when(F.col("live") & (F.col("span.kind") == "token"), F.col("span")))
    each = one.groupBy("doc_id", "text_key").agg(added.alias("added"), F.count_if("live").alias("n_live"), F.count_if("example").alias("n_examples"))
    each = each.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    out = found.join(each, found.doc_id.eqNullSafe(each.d) & (found.text_key == each.k), "left")
    return out.select("doc_id", "text_key", "n_assign", "n_access", "n_hex", "base", F.coalesce("added", F.expr(f"cast(array() as {_SPAN})")).alias("added"), *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n_live", "n_examples")))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with each run of overlapping spans (sorted) replaced by a mask."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]), F.lit(mask))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(x["start"] >= acc["pos"], new).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))).otherwise(text)


def mask(docs: DataFrame, owners: int = OWNERS) -> DataFrame:
    """docs with live-looking secrets masked in text: values that fewer than `owners` sources have."""
    found = scan(docs)
    each = materialize(found.where((F.size("base") > 0) | (F.size("tokens") > 0)).select("doc_id", "source", "text_key", F.explode(F.concat("base", "tokens")).alias("span")), "secrets")
    each = each.withColumn("value_key", F.md5(F.col("span.value").cast("binary")))
    judged = owned(each).where(F.col("n_owners") < owners)
    # every document with such spans, once
    spans = judged.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    # the document's columns travel as one, so none of their names can clash
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    rows = rows.join(spans, F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    text = F.when(F.size("spans") > 0, redact(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text")).alias("text")
    return rows.select(*(text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of whole documents: base spans as a digest, and all spans."""
    out = find_secrets(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "added"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"), "n_live", "n_examples")


QUERIES = {"op5_secret_ownership": op5_secret_ownership}
ORACLE: dict[str, str] = {}

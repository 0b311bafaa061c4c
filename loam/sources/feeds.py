"""Feed payloads: file readers, per-source field expressions, and a data source for paged feeds with an injected fetcher."""
from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import cvss, hashing, packages, text, times, urls
from ..operators import leaders, resolve
from ..session import written

BRONZE = "sha256 string, source string, source_id string, url string, title string, raw_text string, published_at timestamp, fetched_at timestamp"
_g = F.get_json_object


def read_bronze(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Lines of JSON as bronze rows, keyed by the hash of their text; broken lines are dropped."""
    rows = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    return bronze_rows(rows.select(F.col("value").alias("raw_text")), source)


def bronze_rows(df: DataFrame, source: str, fetched_at: Column | None = None) -> DataFrame:
    """raw_text (and what else df has) with its content hash, its source, a trace id that follows from both, and when it was fetched."""
    digest = F.sha2("raw_text", 256)
    return df.withColumns({"sha256": digest, "source": F.lit(source), "trace_id": F.substring(F.sha2(F.concat_ws(":", F.lit(source), digest), 256), 1, 32), "fetched_at": F.current_timestamp() if fetched_at is None else fetched_at})


def write_bronze(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("source").parquet(path)


def canonical_json(c: Column) -> Column:
    """The same JSON with sorted keys and no blanks between; null where it is broken."""
    return F.to_json(F.try_parse_json(c))


#: The fields that normalization reads: of a payload, of its parts, and of a part's metrics.
_FIELDS = ["advisory", "affected", "aliases", "configurations", "cve", "cveID", "cvss", "cwes", "date", "dateAdded", "datePublished", "description", "descriptions", "details", "epss", "ghsaId", "id", "identifiers", "lastModified", "metrics", "modified", "notes", "percentile", "pubDate",
           "publication_date", "published", "publishedAt", "published_at", "references", "severity", "shortDescription", "summary", "updated", "updatedAt", "vulnerabilities", "vulnerabilityName", "weaknesses"]
_PARTS = {"advisory": ["publishedAt"], "cve": ["configurations", "descriptions", "id", "lastModified", "metrics", "published", "references", "weaknesses"], "cvss": ["score", "vectorString"], "cwes": ["nodes"], "metrics": cvss.METRICS, "vulnerabilities": ["nodes"]}


def _struct(text_: Column, names: list[str]) -> Column:
    return F.from_json(text_, ", ".join(f"`{n}` string" for n in names))


def _read(_: Column, path: str) -> Column:
    """A path of the payload that `parsed` has read: the text of what is there."""
    keys = path[2:].split(".")
    return F.col("_json")[keys[0]] if len(keys) == 1 else F.col(f"_{keys[0]}")[keys[1]] if len(keys) == 2 else F.col("_cve_metrics")[keys[2]]


def detect_source(raw: Column, get: Callable[[Column, str], Column] = F.get_json_object) -> Column:
    """The kind of a payload by the keys that it has."""
    has = lambda p: get(raw, p).isNotNull()
    return (F.when(has("$.ghsaId"), "ghsa").when(has("$.cveID") | has("$.vulnerabilityName"), "kev").when(has("$.epss") & has("$.cve"), "epss").when(has("$.aliases") | has("$.details"), "osv")
            .when(has("$.cve") | has("$.lastModified"), "nvd"))


def _texts(raw: Column, path: str) -> Column:
    return F.coalesce(F.from_json(_read(raw, path), "array<string>"), _no_texts())


def _no_texts() -> Column:
    return F.expr("cast(array() as array<string>)")


def _each(raw: Column, paths: list[str], field: str) -> Column:
    """field of each object of the first list that is there."""
    lists = F.coalesce(*(F.from_json(_read(raw, p), f"array<struct<{field}:string>>") for p in paths))
    return F.filter(F.coalesce(F.transform(lists, lambda x: x[field]), _no_texts()), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")


def published_at(raw: Column, kind: Column, given: Column | None = None, get: Callable[[Column, str], Column] = F.get_json_object) -> Column:
    """When the source published it: paths of the source, then general ones, then what the row was given; never the date of a model, and null rather than a guess."""
    own = {"nvd": ["$.cve.published", "$.published"], "osv": ["$.published"], "ghsa": ["$.publishedAt"], "vendor_github": ["$.advisory.publishedAt", "$.publishedAt"], "kev": ["$.dateAdded"], "rss_blog": ["$.published", "$.pubDate", "$.updated"]}
    general = ["published", "publishedAt", "published_at", "publication_date", "datePublished", "pubDate", "dateAdded", "advisory.publishedAt"]
    first = F.coalesce(*(F.when(kind == k, times.parse_time(get(raw, p))) for k, ps in own.items() for p in ps))
    found = F.coalesce(first, *(times.parse_time(get(raw, f"$.{p}")) for p in general), *([] if given is None else [given]))
    return F.when(kind != "epss", found)


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are worked out right here: filters and projections above don't put their expressions in again, as they would for a plain projection."""
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def parsed(bronze: DataFrame, raw: str = "raw_text") -> DataFrame:
    """bronze with the common fields of the five payload kinds; vuln_id is null where a payload has none. What a payload lacks comes from the row's source_id and url, if there are such columns.
    The JSON is read once into one struct of texts, and its parts once each; each step is a projection of its own."""
    text_ = lambda c: F.nullif(F.trim(c), F.lit(""))
    none, r = F.lit(None).cast("string"), F.col(raw)
    own = lambda c: F.col(c) if c in bronze.columns else none
    kind = F.col("_kind")
    by = lambda **paths: F.coalesce(*(F.when(kind == k, F.coalesce(*(text_(_read(r, p)) for p in ps))) for k, ps in paths.items()))
    listed = lambda **lists: F.coalesce(*(F.when(kind == k, c) for k, c in lists.items()), _no_texts())
    said = F.from_json(F.coalesce(_read(r, "$.cve.descriptions"), _read(r, "$.descriptions")), "array<struct<lang:string,value:string>>")
    weak = F.from_json(F.coalesce(_read(r, "$.cve.weaknesses"), _read(r, "$.weaknesses")), "array<struct<description:array<struct<value:string>>>>")
    rows = staged(bronze, {"_json": _struct(r, _FIELDS)})
    rows = staged(rows, {f"_{part}": _struct(F.col("_json")[part], names) for part, names in _PARTS.items()})
    rows = staged(rows, {"_cve_metrics": _struct(F.col("_cve")["metrics"], cvss.METRICS)})
    rows = staged(rows, {"_kind": F.coalesce(own("source"), detect_source(r, _read))})
    rows = staged(rows, {"_id": text_(own("source_id")), "_url": text_(own("url")), "_said": F.filter(said, lambda x: F.coalesce(F.trim(x["value"]), F.lit("")) != ""), "_identifiers": _each(r, ["$.identifiers"], "value")})
    english = F.get(F.filter("_said", lambda x: x["lang"] == "en"), F.lit(0))["value"]
    rows = staged(rows, {
        "_ident": F.coalesce(by(nvd=["$.cve.id", "$.id"], osv=["$.id"], ghsa=["$.ghsaId"], kev=["$.cveID"], epss=["$.cve"]), F.when(kind == "ghsa", F.get("_identifiers", F.lit(0))), F.col("_id")),
        "_described": F.coalesce(F.when(kind == "nvd", F.coalesce(english, F.get("_said", F.lit(0))["value"])), by(osv=["$.details", "$.summary"], ghsa=["$.description", "$.summary"], kev=["$.shortDescription"]), F.when(kind.isNull(), r)),
        "_title": by(osv=["$.summary"], ghsa=["$.summary"], kev=["$.vulnerabilityName"]), "_published": published_at(r, kind, get=_read),
        "_modified": by(nvd=["$.cve.lastModified", "$.lastModified"], osv=["$.modified"], ghsa=["$.updatedAt"], kev=["$.dateAdded"], epss=["$.date"]),
        "_weak": listed(nvd=F.flatten(F.transform(weak, lambda w: F.transform(w["description"], lambda x: x["value"]))), ghsa=_each(r, ["$.cwes.nodes"], "cweId"), kev=_texts(r, "$.cwes")),
        "_links": listed(nvd=_each(r, ["$.cve.references", "$.references"], "url"), osv=_each(r, ["$.references"], "url"), ghsa=_each(r, ["$.references"], "url"), kev=F.filter(F.array(by(kev=["$.notes"])), lambda x: x.isNotNull())),
        "_aliases": listed(osv=_texts(r, "$.aliases"), ghsa=F.col("_identifiers")),
    })
    rows = staged(rows, {"vuln_id": text.vuln_key(F.col("_ident"), F.coalesce(kind, F.lit(""))), "_text": text_(text.clean_text(F.col("_described"))), "title": text_(text.clean_text(F.col("_title")))})
    upper = lambda xs: F.array_distinct(F.transform(xs, lambda x: F.upper(F.trim(x))))
    named = (F.col("vuln_id"), F.col("_text"), F.col("title"))
    aliases = F.concat(text.cve_ids(*named), F.col("_aliases"), text.aliases(*named, r), F.filter(F.array("_id"), lambda x: x.isNotNull()))
    number = lambda path: F.when(kind == "epss", _read(r, path)).try_cast("double")
    rows = rows.withColumns({
        "source": kind, "description": F.coalesce("_text", "title", "_id"), "lang": F.when(F.col("_text").isNotNull(), text.ascii_lang(F.col("_text"))), "aliases": F.filter(upper(aliases), lambda x: x.isNotNull() & (x != "")),
        "cwe_ids": F.filter(upper(F.col("_weak")), lambda x: F.startswith(x, F.lit("CWE-"))), "kev": F.coalesce(kind == "kev", F.lit(False)), "epss_score": number("$.epss"), "epss_percentile": number("$.percentile"),
        "cvss": cvss.collect(r, _read), "cpe_matches": packages.cpe_matches(r, _read), "ecosystem_packages": packages.packages(r, _read), "references": F.array_distinct(F.concat("_links", F.filter(F.array("_url"), lambda x: x.isNotNull()))),
        "published_at": F.col("_published"), "modified_at": F.coalesce(times.parse_time(F.col("_modified")), "_published"),
    })
    rows = rows.withColumns({"aliases": F.array_remove("aliases", F.upper("vuln_id")), "severity": cvss.set_severity(F.col("cvss")), "affected_versions": packages.affected_versions(F.col("cpe_matches"))})
    return rows.drop(*(c for c in rows.columns if c.startswith("_") and c not in bronze.columns))


SILVER = ["vuln_id", "source", "title", "description", "lang", "aliases", "cwe_ids", "kev", "epss_score", "epss_percentile", "cvss", "cpe_matches", "ecosystem_packages", "references", "published_at", "modified_at", "severity", "affected_versions"]


def normalize(bronze: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Silver rows of bronze payloads; rows without an id are dropped (see `rejects`). A missing publish time stays null."""
    return parsed(bronze, raw).where("vuln_id is not null").select(*SILVER)


def rejects(bronze: DataFrame, raw: str = "raw_text") -> DataFrame:
    """The bronze rows that give no silver row."""
    return parsed(bronze, raw).where("vuln_id is null").select(*bronze.columns)


def primary_key(vuln_id: Column, aliases: Column) -> Column:
    """The CVE id of a record: its own, else the first among its aliases, else its id in upper case."""
    other = F.get(F.filter(aliases, lambda a: text.is_cve(a)), F.lit(0))
    return F.when(text.is_cve(vuln_id), F.upper(F.trim(vuln_id))).otherwise(F.coalesce(F.upper(F.trim(other)), F.upper(F.trim(vuln_id))))


def cluster_keys(silver: DataFrame, threshold: int = 15) -> DataFrame:
    """(id, key): records that no CVE id names, by near-duplicate descriptions: in order of id, a record takes the key of the first leader whose SimHash is within threshold bits, else its own."""
    key = primary_key(F.col("vuln_id"), F.col("aliases"))
    rows = silver.select(key.alias("id"), "description").where(~text.is_cve(F.col("id")))
    longest = rows.groupBy("id").agg(F.max_by("description", F.struct(F.length("description"), "description")).alias("description"))
    return leaders.leader_clusters(longest.select("id", hashing.simhash64("description").alias("fingerprint")), "id", threshold).select("id", F.col("leader").alias("key"))


def merge_sources(silver: DataFrame, similar: bool = False) -> DataFrame:
    """One row per primary key over all sources, whatever the order of rows; with similar, records without a CVE id also merge where their descriptions are near-duplicates. Records count by
    (published missing, published, id): the longest description (the first of equals), the first title, lists in order without repeats (links by their normal form), the highest severity, any kev,
    the highest scores, the first published and last modified time."""
    if similar:
        silver = written(silver, "silver")  # it is read for the clusters and for the merge
    order = F.struct(F.col("published_at").isNull().alias("n"), F.col("published_at").alias("p"), F.col("vuln_id").alias("v"), F.col("source").alias("s"))
    rows = silver.withColumns({"key": primary_key(F.col("vuln_id"), F.col("aliases")), "o": order})
    if similar:
        other = cluster_keys(silver).select(F.col("id").alias("_id"), F.col("key").alias("_key"))
        rows = rows.join(other, F.col("key") == F.col("_id"), "left").withColumn("key", F.coalesce("_key", "key")).drop("_id", "_key")
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(c).alias("x")))), lambda r: r["x"]))  # noqa: E731  a key has few records
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("o")))
    longest = F.min_by("description", F.when(F.col("description").isNotNull(), F.struct((-F.length("description")).alias("l"), "o")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("o", "vuln_id"))), lambda r: F.upper(r["vuln_id"]))
    once = lambda xs: F.array_distinct(F.transform(xs, lambda x: F.upper(x)))
    out = rows.groupBy("key").agg(
        first("title").alias("title"), longest.alias("description"), F.array_remove(once(F.concat(ordered("aliases"), ids)), F.first("key")).alias("aliases"), once(ordered("cwe_ids")).alias("cwe_ids"),
        ordered("cvss").alias("cvss"), ordered("cpe_matches").alias("cpe_matches"), F.array_distinct(ordered("ecosystem_packages")).alias("ecosystem_packages"), ordered("references").alias("references"),
        F.max(cvss.rank(F.col("severity"))).alias("rank"), F.bool_or("kev").alias("kev"), F.max("epss_score").alias("epss_score"), F.max("epss_percentile").alias("epss_percentile"),
        F.min("published_at").alias("published_at"), F.max("modified_at").alias("modified_at"), F.array_sort(F.collect_set("source")).alias("sources")).withColumnRenamed("key", "vuln_id")
    by_version = lambda a, b: F.when(a["version"] < b["version"], -1).when(a["version"] > b["version"], 1).otherwise(0)
    vectors = F.array_sort(packages.distinct_by(F.col("cvss"), cvss.VECTOR, "version", "vector"), by_version)
    matches = packages.distinct_by(F.col("cpe_matches"), packages.MATCH, "vendor", "product", "version_end_excl", "version_start_incl")
    links = F.transform(packages.distinct_by(F.transform("references", lambda u: F.struct(urls.normalize_url(u).alias("k"), u.alias("u"))), "struct<k:string,u:string>", "k"), lambda x: x["u"])
    out = out.withColumns({"cvss": vectors, "cpe_matches": matches, "references": links})
    rank = F.greatest("rank", cvss.rank(cvss.set_severity(F.col("cvss"))))
    return out.withColumns({"severity": F.element_at(F.array(*map(F.lit, cvss.SEVERITIES)), rank + 1), "affected_versions": packages.affected_versions(F.col("cpe_matches"))}).drop("rank")


# scans: pages of a feed as they come, with what an incremental fetch keeps


def nvd_scan(pages: DataFrame, raw: str = "raw_text") -> DataFrame:
    """(id, published, payload) of pages with a list of vulnerabilities: of each id the row published first, date and payload of one row; the latest published come first."""
    item = F.explode(F.from_json(_g(F.col(raw), "$.vulnerabilities"), "array<string>")).alias("payload")
    rows = pages.select(item).select(_g(F.col("payload"), "$.cve.id").alias("id"), _g(F.col("payload"), "$.cve.published").alias("published"), "payload").where("id is not null")
    first = F.min(F.struct(F.col("published").isNull().alias("undated"), "published", "payload")).alias("first")
    return rows.groupBy("id").agg(first).select("id", "first.published", "first.payload").orderBy(F.desc_nulls_last("published"), "id")


def since_scan(rows: DataFrame, key: Column, stamps: list[Column], since: Column, keep_undated: bool = False) -> DataFrame:
    """Rows whose first readable time isn't before since, once per key; rows without one go, or stay if asked."""
    at = F.coalesce(*(times.parse_time(s) for s in stamps))
    kept = rows.withColumns({"_key": key, "_at": at}).where((F.col("_at") >= since) | (F.col("_at").isNull() if keep_undated else F.lit(False)))
    return kept.dropDuplicates(["_key"]).drop("_key", "_at")


def catalogue_scan(raw: Column, since: Column) -> Column:
    """Entries of a whole catalogue that were added on or after since; those without a date go."""
    return F.filter(F.from_json(_g(raw, "$.vulnerabilities"), "array<string>"), lambda x: F.coalesce(times.parse_time(_g(x, "$.dateAdded")) >= since, F.lit(False)))


def matches_filters(payload: Column, ecosystems: list[str], keywords: list[str]) -> Column:
    """Whether a package is of one of the ecosystems and a keyword occurs in summary, description or package names."""
    rows = F.coalesce(F.from_json(_g(payload, "$.vulnerabilities.nodes"), "array<struct<package:struct<ecosystem:string,name:string>>>"), F.expr("cast(array() as array<struct<package:struct<ecosystem:string,name:string>>>)"))
    known = F.exists(rows, lambda x: F.coalesce(F.upper(x["package"]["ecosystem"]).isin(*(e.upper() for e in ecosystems)), F.lit(False)))
    said = F.lower(F.concat_ws(" ", _g(payload, "$.summary"), _g(payload, "$.description"), F.array_join(F.transform(rows, lambda x: x["package"]["name"]), " ")))
    return known & F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(said, k))


def assigned(advisories: DataFrame, package: str, repos: DataFrame) -> DataFrame:
    """Advisories with the monitored repository of their package; others go. repos: (package, repo)."""
    return advisories.join(repos.select(F.col("package").alias("_p"), "repo"), F.lower(F.col(package)) == F.lower("_p")).drop("_p")


def arxiv_id(c: Column) -> Column:
    """(base, version) of an id or link; the version is null where there is none."""
    bare = F.trim(F.regexp_replace(F.trim(c), "^.*/abs/", ""))
    return F.struct(F.regexp_replace(bare, r"(?<=[0-9])v[0-9]+$", "").alias("base"), F.nullif(F.regexp_extract(bare, r"[0-9](v[0-9]+)$", 1), F.lit("")).alias("version"))


def abstract(index: Column) -> Column:
    """The text of an inverted index, a map from word to places."""
    words = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " ")


def stable_id(feed: str, identifier: Column, most: int = 64) -> Column:
    """feed:identifier, or feed and twenty digits of its hash where that is too long."""
    whole = F.concat(F.lit(f"{feed}:"), F.trim(identifier))
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.lit(f"{feed}:"), F.substring(F.sha2(F.trim(identifier), 256), 1, 20)))


def feed_date(c: Column) -> Column:
    """A time as feeds write it: RFC 822, else ISO."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(?:GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), times.parse_time(c))


def feed_entries(xml: Column) -> Column:
    """(id, title, link, published, summary) of each entry of an Atom or RSS document."""
    squash = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    atom = F.regexp_like(xml, F.lit(r"(?s)^\s*(?:<\?[^>]*>\s*)?(?:<!--.*?-->\s*)?<feed\b"))
    # one entry at a time, so that an element that one entry lacks doesn't shift those of others; prefixes of names go
    bare = F.regexp_replace(F.regexp_replace(xml, r"<(/?)[A-Za-z]+:", "<$1"), r"\sxmlns(?::[A-Za-z]+)?=\"[^\"]*\"", "")
    entries = F.regexp_extract_all(bare, F.lit(r"(?s)<(?:entry|item)\b.*?</(?:entry|item)>"), F.lit(0))

    def one(x: Column) -> Column:
        get = lambda *paths: F.coalesce(*(squash(F.xpath_string(x, F.lit(p))) for p in paths))
        link = F.when(atom, get("/entry/link/@href")).otherwise(get("/item/link"))
        return F.struct(F.coalesce(get("/entry/id", "/item/guid"), link).alias("id"), get("/*/title").alias("title"), link.alias("link"), feed_date(get("/entry/published", "/entry/updated", "/item/pubDate", "/item/date")).alias("published"), get("/entry/summary", "/entry/content", "/item/description").alias("summary"))
    return F.transform(entries, one)


def papers(bronze: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Papers as a view over bronze rows of paper sources: (paper_id, title, abstract, published, url)."""
    r = F.col(raw)
    ident = arxiv_id(F.coalesce(_g(r, "$.id"), F.col("source_id")))
    return bronze.where(F.col("source").isin("arxiv", "openalex")).select(ident["base"].alias("paper_id"), F.coalesce(_g(r, "$.title"), _g(r, "$.display_name")).alias("title"), F.coalesce(_g(r, "$.summary"), abstract(F.from_json(_g(r, "$.abstract_inverted_index"), "map<string,array<int>>"))).alias("abstract"), times.parse_time(F.coalesce(_g(r, "$.published"), _g(r, "$.publication_date"))).alias("published"), F.coalesce(_g(r, "$.link"), _g(r, "$.id")).alias("url"))


def resolve_since(explicit: str | None = None, full: bool = False, days: int | None = None, last_success: str | None = None, default_days: int = 7, now: str = "2024-12-31", first: str = "2024-01-01") -> str:
    """Where an incremental run begins: what is asked for, else all, else so many days, else the last success, else the default days."""
    back = lambda n: (dt.date.fromisoformat(now[:10]) - dt.timedelta(days=n)).isoformat()
    return explicit or (first if full else back(days) if days is not None else last_success or back(default_days))


class FeedWindow(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


class FeedSource(DataSource):
    """format("feed"): one partition per window of the range, rows from a fetcher(start, end) -> iterable of JSON texts.

    The fetcher is looked up as module:function in the option `fetcher`, so nothing reaches a network unless one is given.
    """

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "source string, raw_text string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStream(self.options)


def feed_windows(start: str, end: str, days: int) -> list[FeedWindow]:
    at, end_, step, out = dt.date.fromisoformat(start), dt.date.fromisoformat(end), dt.timedelta(days=days), []
    while at < end_:
        out.append(FeedWindow(at.isoformat(), min(at + step, end_).isoformat()))
        at += step
    return out


def fetched_rows(options: dict[str, str], window: FeedWindow) -> Iterator[tuple[str, str]]:
    module, _, name = options["fetcher"].partition(":")
    fetch: Callable = getattr(importlib.import_module(module), name)
    for row in fetch(window.start, window.end):
        yield options.get("source", ""), row


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[FeedWindow]:
        return feed_windows(self.options["since"], self.options["until"], int(self.options.get("days", 120)))

    def read(self, partition: FeedWindow) -> Iterator[tuple[str, str]]:
        return fetched_rows(self.options, partition)


class FeedStream(DataSourceStreamReader):
    """The same windows as a stream: the offset is the day that is fetched up to (`until`, or today), so a checkpoint is the cursor of an incremental run, and a batch that failed is fetched again."""

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"at": self.options["since"]}

    def latestOffset(self) -> dict:
        return {"at": self.options.get("until") or dt.date.today().isoformat()}

    def partitions(self, start: dict, end: dict) -> list[FeedWindow]:
        return feed_windows(start["at"], end["at"], int(self.options.get("days", 120)))

    def read(self, partition: FeedWindow) -> Iterator[tuple[str, str]]:
        return fetched_rows(self.options, partition)

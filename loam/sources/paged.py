"""Feeds that answer in pages, as a data source that pages inside a partition, asks for no more than the query needs, and says what failed.

format("pages") reads with a fetcher, named as module:function in the option `fetcher`, so nothing reaches a network unless one is given. fetcher(request, options) answers a request, a dict with
`query`, `start` and `end` (days), `offset`, `cursor` and `size`, or with `ids` alone, by a dict with `rows`, a list of (id, at, raw_text), and `next` (the next cursor, or None at the end) or `total`.
"""
from __future__ import annotations

import datetime as dt
import functools
import importlib
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Ids asked for in one partition.
IDS = 100


class PagedSource(DataSource):
    """Options: fetcher, since and until (days), days (of a window, 120), size (of a page, 100), pages (at most in a window and query, 10000), queries (a JSON list), order ("desc" where a feed has the latest first and knows no windows), errors ("raise" where a request that fails should end the read).

    Columns: query, id, at, raw_text, error. A row with an error stands for a query whose request failed, or whose pages end before all that the feed says it has; the other queries go on."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "query string, id string, at string, raw_text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class Pages(InputPartition):
    def __init__(self, start: str, end: str, ids: list[str] | None = None):
        self.start, self.end, self.ids = start, end, ids


def _day(x: object) -> str:
    return str(x)[:10]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.since, self.until = options["since"], options.get("until") or dt.date.today().isoformat()
        self.ids: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ids go to the fetcher whole. Bounds of `at` narrow the days that are asked for and stay with Spark for the rest of a day."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("id",):
                asked = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.ids = [x for x in dict.fromkeys(asked) if x is not None and (self.ids is None or x in self.ids)]
                continue
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("at",):
                self.since = max(self.since, _day(f.value))
            if isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("at",):
                self.until = min(self.until, (dt.date.fromisoformat(_day(f.value)) + dt.timedelta(days=1)).isoformat())
            yield f

    def partitions(self) -> list[Pages]:
        if self.ids is not None:
            return [Pages(self.since, self.until, self.ids[i:i + IDS]) for i in range(0, len(self.ids), IDS)]
        at, end, out = dt.date.fromisoformat(self.since), dt.date.fromisoformat(self.until), []
        step = dt.timedelta(days=int(self.options.get("days", 120)))
        if self.options.get("order") == "desc":
            return [Pages(self.since, self.until)] if at < end else []
        while at < end:
            out.append(Pages(at.isoformat(), min(at + step, end).isoformat()))
            at += step
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        module, _, name = self.options["fetcher"].partition(":")
        fetch = functools.partial(getattr(importlib.import_module(module), name), options=self.options)
        if partition.ids is not None:
            wanted = set(partition.ids)
            try:
                found = {row[0]: row for row in fetch({"ids": partition.ids})["rows"] if row[0] in wanted}
                yield from ((None, *row, None) for row in found.values())
            except Exception as e:  # noqa: BLE001  told in its row
                yield None, None, None, None, self._told(e)
            return
        seen: set[str] = set()
        for query in json.loads(self.options.get("queries") or "[null]"):
            try:
                for row in self._rows(fetch, partition, query):
                    if row[0] not in seen:
                        seen.add(row[0])
                        yield query, *row, None
            except Exception as e:  # noqa: BLE001  one query that fails doesn't end the others
                yield query, None, None, None, self._told(e)

    def _told(self, e: Exception) -> str:
        if self.options.get("errors") == "raise":
            raise e
        return f"{type(e).__name__}: {e}"

    def _rows(self, fetch, window: Pages, query: str | None) -> Iterator[tuple[str, str, str]]:
        size, offset, cursor, latest_first = int(self.options.get("size", 100)), 0, None, self.options.get("order") == "desc"
        most = int(self.options.get("pages", 10_000))
        for _ in range(most):
            page = fetch({"query": query, "start": window.start, "end": window.end, "offset": offset, "cursor": cursor, "size": size})
            rows = page["rows"]
            for row in rows:
                if latest_first and row[1] is not None and _day(row[1]) < window.start:
                    return
                if not latest_first or row[1] is None or _day(row[1]) < window.end:
                    yield tuple(row)
            offset += len(rows)
            if "next" in page:
                cursor = page["next"]
                if not cursor or not rows:
                    return
            elif "total" in page:
                if offset >= page["total"]:
                    return
                if not rows:
                    raise EOFError(f"{offset} rows of {page['total']} from {window.start} to {window.end}")
            elif len(rows) < size:
                return
        raise EOFError(f"more than {most} pages from {window.start} to {window.end}")


def scan(spark: SparkSession, **options: str) -> DataFrame:
    """The rows of a paged feed, with filters pushed to it. It is fetched again each time it is read: write it, then take `entries` and `failures`."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format("pages").options(**options).load()


def entries(rows: DataFrame) -> DataFrame:
    """(id, at, raw_text): each id once over all windows and queries, its latest row, date and payload of one row."""
    best = F.max(F.struct(F.col("at").isNotNull().alias("dated"), "at", "raw_text")).alias("best")
    return rows.where("error is null and id is not null").groupBy("id").agg(best).select("id", "best.at", "best.raw_text")


def failures(rows: DataFrame) -> DataFrame:
    """(query, error, n): what couldn't be fetched, in how many windows."""
    return rows.where("error is not null").groupBy("query", "error").agg(F.count("*").alias("n"))


def _tuples(table, key: str, at: str) -> list[tuple[str, str, str]]:
    return [(str(r[key]), r[at].isoformat(), json.dumps({k: v.isoformat() if isinstance(v, dt.datetime) else v for k, v in r.items()}, sort_keys=True)) for r in table.to_pylist()]


def _dataset(path: str):
    import pyarrow.dataset as ds

    # columns aren't read ahead, which would hold the whole file
    return ds.dataset(path, format=ds.ParquetFileFormat(default_fragment_scan_options=ds.ParquetFragmentScanOptions(pre_buffer=False)))


#: How pyarrow scans: few batches at a time.
_SCAN = {"batch_readahead": 2, "fragment_readahead": 1, "use_threads": False}


@functools.lru_cache(1)
def _window(path: str, key: str, at: str, start: str, end: str):
    """The rows of a window by time and id, as an Arrow table; pages of it become rows."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    data = _dataset(path)
    kind = data.schema.field(at).type
    if pa.types.is_timestamp(kind) and kind.tz is None or pa.types.is_date(kind):
        low, high = (pa.scalar(dt.datetime.fromisoformat(d)).cast(kind) for d in (start, end))
        kept = (ds.field(at) >= low) & (ds.field(at) < high)
    else:
        day = pc.strftime(ds.field(at), format="%Y-%m-%d")
        kept = (day >= start) & (day < end)
    table = data.to_table(filter=kept, **_SCAN)
    order = pc.sort_indices(pa.table({"at": table[at], "id": table[key].cast(pa.string())}), sort_keys=[("at", "ascending"), ("id", "ascending")])
    return table.take(order).combine_chunks()


def _asked(path: str, key: str, at: str, ids: list[str]) -> list[tuple[str, str, str]]:
    """The rows of some ids, found batch by batch."""
    import pyarrow as pa
    import pyarrow.dataset as ds

    data, wanted = _dataset(path), set(ids)
    kind = data.schema.field(key).type
    plain = pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind)
    batches = data.to_batches(filter=ds.field(key).cast(pa.string()).isin(ids) if plain else None, **_SCAN)
    return sorted((r for b in batches for r in _tuples(b, key, at) if r[0] in wanted), key=lambda r: (r[1], r[0]))


def from_table(request: dict, options: dict) -> dict:
    """A fetcher over a parquet table in a store that pyarrow opens: options path, key and time. It serves a window's rows by time in pages, and asked ids. A worker holds one window as an Arrow table, and of asked ids only their rows."""
    where = options["path"], options["key"], options["time"]
    if "ids" in request:
        return {"rows": _asked(*where, request["ids"])}
    table = _window(*where, request["start"], request["end"])
    return {"rows": _tuples(table.slice(request["offset"], request["size"]), *where[1:]), "total": table.num_rows}

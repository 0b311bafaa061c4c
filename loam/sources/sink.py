"""A sink for rows that are known by the hash of their content: format("content") writes a row once, whatever fails or comes again.

Every task writes files of its own, one for each bucket of keys, with the rows whose key isn't stored yet; its message to the driver names them. A commit makes a new manifest of all files, written aside and
moved into place, so rows of a failed task or batch are never seen: an abort removes their files. A streaming batch that comes again is known by its number. One job writes to a sink at a time.

Rows of one bucket must come in one task, else two tasks could write one key: `insert` deals them so, and a commit refuses other rows.
"""
from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """The files of a task by bucket."""

    files: dict[int, str]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest(path: str) -> dict:
    """The last version of a sink: its files by bucket, and the last batch of each stream."""
    store, root = _open(path)
    found = [int(f.base_name[9:-5]) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("manifest-") and f.base_name.endswith(".json")]
    if not found:
        return {"version": 0, "files": {}, "batches": {}}
    with store.open_input_stream(f"{root}/manifest-{max(found)}.json") as f:
        return json.loads(f.read())


class _Sink:
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.key, self.buckets = schema, options["path"], options.get("key", "sha256"), int(options.get("buckets", 16))
        self.stream = options.get("stream", "")
        self.stored = manifest(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(f"{root}/data")
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in iterator:
            keys = batch.column(batch.schema.get_field_index(self.key))
            bucket = pa.array([zlib.crc32(k.encode()) % self.buckets if k is not None else 0 for k in keys.to_pylist()], pa.int32())
            for b in pc.unique(bucket).to_pylist():
                held.setdefault(b, []).append(batch.filter(pc.equal(bucket, b)))
        files = {}
        for b, batches in held.items():
            rows = pa.Table.from_batches(batches)
            known = [pq.read_table(f"{root}/data/{f}", columns=[self.key], filesystem=store)[self.key] for f in self.stored["files"].get(str(b), [])]
            if known:
                rows = rows.filter(pc.invert(pc.is_in(rows[self.key], pa.chunked_array([c for k in known for c in k.chunks], rows[self.key].type))))
            # the first of each key
            nth = pa.array(range(rows.num_rows), pa.int64())
            first = rows.select([self.key]).append_column("nth", nth).group_by(self.key).aggregate([("nth", "min")])["nth_min"]
            rows = rows.take(pc.sort_indices(first).take(pa.array([], pa.int64())) if not rows.num_rows else pc.take(first, pc.sort_indices(first)))
            if rows.num_rows:
                files[b] = f"{b}-{uuid.uuid4().hex}.parquet"
                pq.write_table(rows, f"{root}/data/{files[b]}", filesystem=store)
        return Written(files)

    def _commit(self, messages: list[Written | None], batch: int | None) -> None:
        now = manifest(self.path)
        named = [m for m in messages if m]
        if batch is not None and now["batches"].get(self.stream, -1) >= batch:
            self._remove(messages)
            return
        of = [b for m in named for b in m.files]
        if len(of) != len(set(of)):
            self._remove(messages)
            raise ValueError(f"rows of one bucket came in several tasks: repartition by crc32({self.key}) % {self.buckets}, as insert does")
        if now["version"] != self.stored["version"]:
            self._remove(messages)
            raise ValueError(f"{self.path} was written by another job meanwhile")
        files = {**now["files"]}
        for m in named:
            for b, f in m.files.items():
                files[str(b)] = [*files.get(str(b), []), f]
        new = {"version": now["version"] + 1, "files": files, "batches": {**now["batches"], **({self.stream: batch} if batch is not None else {})}}
        store, root = _open(self.path)
        store.create_dir(root)
        aside = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as f:
            f.write(json.dumps(new).encode())
        store.move(aside, f"{root}/manifest-{new['version']}.json")

    def _remove(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        for m in messages:
            for f in (m.files.values() if m else ()):
                store.delete_file(f"{root}/data/{f}")


class ContentWriter(_Sink, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, None)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(messages)


class ContentStreamWriter(_Sink, DataSourceStreamArrowWriter):
    """Each batch looks at what is stored when its tasks begin, so `stored` is read again there."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        self.stored = manifest(self.path)
        return super().write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.stored = manifest(self.path)
        self._commit(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._remove(messages)


class ContentSink(DataSource):
    """Options: path (of a store that pyarrow opens and all executors share), key (sha256), buckets (16), stream (what a stream's batches are counted by)."""

    @classmethod
    def name(cls) -> str:
        return "content"

    def writer(self, schema: StructType, overwrite: bool) -> ContentWriter:
        if overwrite:
            raise ValueError("a content sink is only added to")
        return ContentWriter(schema, dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> ContentStreamWriter:
        return ContentStreamWriter(schema, dict(self.options))


def _dealt(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.repartition(buckets, F.coalesce(F.crc32(F.col(key).cast("binary")), F.lit(0)) % buckets)


def insert(rows: DataFrame, path: str, key: str = "sha256", buckets: int = 16) -> None:
    """Adds the rows whose key isn't in the sink, once each."""
    rows.sparkSession.dataSource.register(ContentSink)
    _dealt(rows, key, buckets).write.format("content").options(path=path, key=key, buckets=str(buckets)).mode("append").save()


def insert_stream(rows: DataFrame, path: str, checkpoint: str, stream: str, key: str = "sha256", buckets: int = 16) -> StreamingQuery:
    """The same for every batch of a stream, to its end."""
    rows.sparkSession.dataSource.register(ContentSink)
    return (_dealt(rows, key, buckets).writeStream.format("content").options(path=path, key=key, buckets=str(buckets), stream=stream, checkpointLocation=checkpoint)
            .trigger(availableNow=True).start())


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the last version of a sink."""
    files = [f"{path}/data/{f}" for fs_ in manifest(path)["files"].values() for f in fs_]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)

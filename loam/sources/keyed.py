"""A table of rows by key in buckets, with versions: a batch rewrites the buckets that its keys fall into, or adds to them, and nothing else.

A folder of the table holds `data`, where every batch writes its buckets below a name of its own, and `manifests`, one small file a version: the key, the number of buckets, for each bucket the folders
that make it up, and the last batch of each stream. A version exists once its manifest is renamed into place, which fails if another writer was first; so readers see all of a batch or nothing,
a batch that fails between writing and switching leaves only files that no version names, and a batch that comes again is known by its number and left out.
"""
from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import resolve


class Conflict(Exception):
    """Another writer has made the version first; the batch can be merged again."""


class KeyedTable:
    """A table at `path` by the column `key`. `buckets` counts for a new table only; `keep` versions stay readable."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16, keep: int = 2):
        self.spark, self.path, self.key, self.keep = spark, path.rstrip("/"), key, keep
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop(self.path).getFileSystem(self._conf)
        self._new = {"version": 0, "key": key, "buckets": buckets, "schema": None, "folders": {}, "applied": {}}

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        at = self._hadoop(f"{self.path}/manifests")
        if not self._fs.exists(at):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version, or the last one, consists of."""
        found = self.versions()
        if not found:
            return self._new
        stream = self._fs.open(self._hadoop(f"{self.path}/manifests/{found[-1] if version is None else version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _folders(self, folders: Iterable[str], schema: dict, columns: list[str] | None = None) -> DataFrame:
        kind = StructType.fromJson(schema)
        paths = [f"{self.path}/data/{f}" for f in folders]
        rows = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows.select(*columns) if columns else rows

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the last one."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError(f"nothing has been written to {self.path}")
        return self._folders((f for fs in m["folders"].values() for f in fs), m["schema"])

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys, read from their buckets alone."""
        m = self.manifest()
        if m["schema"] is None:
            raise ValueError(f"nothing has been written to {self.path}")
        kind = StructType.fromJson(m["schema"])[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType().add(self.key, kind))
        of = {str(r.b) for r in asked.select(self._bucket(m["buckets"]).alias("b")).distinct().collect()}
        return self._folders((f for b in sorted(of) for f in m["folders"].get(b, [])), m["schema"]).where(F.col(self.key).isin(*keys))

    def read_for(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in a table of one column, from their buckets alone."""
        return self.read_near(keys).join(self._asked(keys), self.key, "left_semi")

    def read_near(self, keys: DataFrame) -> DataFrame:
        """All rows of the buckets that the keys in a table of one column fall into, for a join that picks the keys' own."""
        m = self.manifest()
        if m["schema"] is None:
            raise ValueError(f"nothing has been written to {self.path}")
        return self._folders((f for b in self._touched(self._asked(keys), m["buckets"]) for f in m["folders"].get(b, [])), m["schema"])

    def _asked(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.col(keys.columns[0]).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()

    def _write(self, rows: DataFrame, buckets: int, touched: int) -> dict[str, str]:
        """Writes rows by bucket below a new name: the folder of each bucket that got rows."""
        name = uuid.uuid4().hex
        dealt = rows.withColumn("_bucket", self._bucket(buckets)).repartition(max(1, touched), "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        return self._made(name)

    def _made(self, name: str) -> dict[str, str]:
        found = (x.getPath().getName() for x in self._fs.listStatus(self._hadoop(f"{self.path}/data/{name}")) if x.isDirectory())
        return {n.partition("=")[2]: f"{name}/{n}" for n in found if n.startswith("_bucket=")}

    def _switch(self, old: dict, folders: dict[str, list[str]], schema: StructType, token: tuple[str, int] | None, buckets: int) -> int:
        """Makes the next version, or raises Conflict if it's there already."""
        new = {**old, "version": old["version"] + 1, "folders": folders, "buckets": buckets, "schema": json.loads(schema.json()), "applied": {**old["applied"], **({token[0]: token[1]} if token else {})}}
        draft = self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, self._hadoop(f"{self.path}/manifests/{new['version']}.json"), never)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {new['version']} of {self.path} is there already") from e
            raise
        self._forget(new)
        return new["version"]

    def _forget(self, last: dict) -> None:
        """Removes versions beyond `keep` and the folders that only they name."""
        found = self.versions()
        old, kept = found[:-self.keep], found[-self.keep:]
        if not old:
            return
        named = lambda v: {f for fs in (last if v == last["version"] else self.manifest(v))["folders"].values() for f in fs}
        still = set().union(*map(named, kept))
        for v in old:
            for f in named(v) - still:
                self._fs.delete(self._hadoop(f"{self.path}/data/{f}"), True)
            self._fs.delete(self._hadoop(f"{self.path}/manifests/{v}.json"), False)

    def sweep(self, older_s: float = 86_400) -> int:
        """Removes what failed batches have left: folders that no version names, once they are `older_s` old. Returns how many went."""
        still = {f for v in self.versions() for fs in self.manifest(v)["folders"].values() for f in fs}
        gone = 0
        at = self._hadoop(f"{self.path}/data")
        for batch in self._fs.listStatus(at) if self._fs.exists(at) else []:
            name = batch.getPath().getName()
            if time.time() - batch.getModificationTime() / 1000 < older_s:
                continue
            inside = [x.getPath().getName() for x in self._fs.listStatus(batch.getPath()) if x.isDirectory()]
            for n in inside:
                if f"{name}/{n}" not in still:
                    gone += self._fs.delete(self._hadoop(f"{self.path}/data/{name}/{n}"), True)
            if not any(f"{name}/{n}" in still for n in inside):
                self._fs.delete(batch.getPath(), True)
        return gone

    def _known(self, m: dict, token: tuple[str, int] | None) -> bool:
        return token is not None and m["applied"].get(token[0], -1) >= token[1]

    def _touched(self, batch: DataFrame, buckets: int) -> list[str]:
        return sorted(str(r.b) for r in batch.select(self._bucket(buckets).alias("b")).distinct().collect())  # `buckets` numbers at most

    def merge(self, batch: DataFrame, how: Callable[[DataFrame | None, DataFrame], DataFrame], token: tuple[str, int] | None = None) -> int | None:
        """Rewrites the buckets of the batch's keys as how(their rows or None, batch), which must keep the keys that it is given. token is the batch's stream and number.
        Returns the version, or None if the batch has been merged before or is empty."""
        m = self.manifest()
        if self._known(m, token):
            return None
        touched = self._touched(batch, m["buckets"])
        if not touched:
            return None
        there = [f for b in touched for f in m["folders"].get(b, [])]
        rows = how(self._folders(there, m["schema"]) if there else None, batch)
        made = self._write(rows, m["buckets"], len(touched))
        folders = {b: fs for b, fs in m["folders"].items() if b not in touched} | {b: [f] for b, f in made.items()}
        return self._switch(m, folders, rows.schema, token, m["buckets"])

    def insert_if_absent(self, batch: DataFrame, token: tuple[str, int] | None = None, order: list[Column] | None = None) -> int | None:
        """Adds the rows of the batch whose key isn't there, the first by order of each, or any: of the stored rows only keys are read, and only new rows are written."""
        m = self.manifest()
        if self._known(m, token):
            return None
        touched = self._touched(batch, m["buckets"])
        if not touched:
            return None
        there = [f for b in touched for f in m["folders"].get(b, [])]
        new = resolve.pick(batch, [self.key], order) if order else batch.dropDuplicates([self.key])
        if there:
            new = new.join(self._folders(there, m["schema"], [self.key]), self.key, "left_anti").select(*StructType.fromJson(m["schema"]).names)
        made = self._write(new, m["buckets"], len(touched))
        folders = {b: [*m["folders"].get(b, []), *([made[b]] if b in made else [])] for b in {*m["folders"], *made}}
        return self._switch(m, folders, StructType.fromJson(m["schema"]) if m["schema"] else new.schema, token, m["buckets"])

    def append(self, batch: DataFrame, token: tuple[str, int] | None = None) -> int | None:
        """Adds all rows of the batch, for tables with many rows of a key. A bucket that has many of them is written by several tasks."""
        m = self.manifest()
        if self._known(m, token):
            return None
        name = uuid.uuid4().hex
        batch.withColumn("_bucket", self._bucket(m["buckets"])).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        made = self._made(name)
        folders = {b: [*m["folders"].get(b, []), *([made[b]] if b in made else [])] for b in {*m["folders"], *made}}
        return self._switch(m, folders, batch.schema, token, m["buckets"])

    def split(self, times: int = 2) -> int | None:
        """Deals every bucket into `times` ones, and each into one folder: for a table that has outgrown its buckets, or has many small files."""
        m = self.manifest()
        if m["schema"] is None:
            return None
        rows = self.read()
        made = self._write(rows, m["buckets"] * times, m["buckets"] * times)
        return self._switch(m, {b: [f] for b, f in made.items()}, rows.schema, None, m["buckets"] * times)


def merge_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, how: Callable[[DataFrame | None, DataFrame], DataFrame] | None = None, order: list[Column] | None = None):
    """Merges each micro-batch into the table by `how`, or inserts what is absent (the first by order of each key). A batch that Spark runs again is left out by its number. A new checkpoint is a stream of its own and starts from
    the first row: merges that give the same for rows that come twice (least, greatest, first, union) bring the table to the same rows again."""
    def step(batch: DataFrame, number: int) -> None:
        token = (batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint, number)
        batch = batch.persist()
        try:
            table.insert_if_absent(batch, token, order) if how is None else table.merge(batch, how, token)
        finally:
            batch.unpersist()
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Token ids in ORC files that readers can split by stripe and prune by metadata.

Documents are dealt out by ranges of doc_id (and a hash of the text, where one doc_id has many rows) and sorted, so each file holds one range, stripes have narrow
min/max statistics, and the row index and a Bloom filter on doc_id answer point reads. Ids are integer run-length
encoded by the ORC writer. Offsets need no pass over the whole order: each file carries running sums of
its own, and one row per file gives the base.

The tokenizer drops white space, so words between ASCII white space are encoded one by one and remembered per worker by hash, with a second one for long words and the length for others.

Defined cases: a null text is empty and gets the end id alone; rows with equal doc_id follow each other by a hash of their
text, then the text, and may lie in several files; a null doc_id sorts first; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext as vt
from .shared import new_path, table

#: Words that a worker remembers at most before it starts anew; bounds memory, not results.
REMEMBERED = 1_500_000
_memories: dict[str, Memory] = {}


class Memory:
    """Ids of the words seen so far, by two word hashes: a large sorted part and a small recent one."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.parts = [[np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in range(2)]
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def _find(self, keys: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Place and number of ids of each key, place -1 where it isn't known; and whether any key is known with another second hash."""
        place, count, odd = np.full(len(keys), -1), np.zeros(len(keys), np.int64), False
        for known, second, start, n in self.parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                odd |= bool((second[at[hit]] != seconds[hit]).any())
                place[hit], count[hit] = start[at[hit]], n[at[hit]]
        return place, count, odd

    def _learn(self, keys: np.ndarray, seconds: np.ndarray, words: list[str]) -> None:
        starts, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for lo in range(0, len(words), 1000):
            part = words[lo:lo + 1000]
            enc = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, offsets = np.array(enc.ids, "<u4"), np.array(enc.offsets, np.int64).reshape(-1, 2)[:, 0]
            heads = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            n = np.bincount(np.searchsorted(heads, offsets, "right") - 1, minlength=len(part))
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), "<u4")])
            self.flat[self.used:self.used + len(ids)] = ids
            counts[lo:lo + 1000], starts[lo:lo + 1000] = n, self.used + np.cumsum(n) - n
            self.used += len(ids)
        recent = [np.concatenate(x) for x in zip(self.parts[1], (keys, seconds, starts, counts), strict=True)]
        if len(recent[0]) > 150_000:
            recent = [np.concatenate(x) for x in zip(self.parts[0], recent, strict=True)]
            order = np.argsort(recent[0])
            self.parts = [[x[order] for x in recent], [x[:0] for x in recent]]
        else:
            order = np.argsort(recent[0])
            self.parts[1] = [x[order] for x in recent]

    def ids(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an end id after each, and the number of each text."""
        if sum(len(x[0]) for x in self.parts) > REMEMBERED:
            self.clear()
        starts, ends, doc = vt.words(data, offs)
        second = vt.second_hashes(data, starts, ends)
        keys, first, of = np.unique(vt.hashes(data, starts, ends), return_index=True, return_inverse=True)
        place, _, odd = self._find(keys, second[first])
        if odd or (second[first][of] != second).any():
            return self._plain(data, offs, end_id)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(keys[new], second[first[new]], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        place, count, _ = self._find(keys, second[first])
        n = count[of]
        before = np.cumsum(n) - n
        total = int(n.sum())
        out = np.full(total + len(offs) - 1, end_id, "<u4")
        out[np.arange(total) + np.repeat(doc, n)] = self.flat[np.arange(total) + np.repeat(place[of] - before, n)]
        return out, np.bincount(doc, n, minlength=len(offs) - 1).astype(np.int64) + 1


    def _plain(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same without the memory, for texts with words that share a hash."""
        raw = data.tobytes()
        out = [[*self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, end_id] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return np.array([i for x in out for i in x], "<u4"), np.array([len(x) for x in out], np.int64)


def memory(path: str) -> Memory:
    if path not in _memories:
        _memories[path] = Memory(path)
    return _memories[path]


def _encode(path: str, end_id: int):
    def run(batches):
        part, at, known = TaskContext.get().partitionId(), 0, memory(path)
        for batch in batches:
            for lo, hi, data, offs in vt.slices(batch.column(1), 2 << 20):
                found, n = known.ids(data, offs, end_id)
                starts = np.concatenate([[0], np.cumsum(n)])
                ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(len(n), part)), pa.array(at + starts[:-1]), pa.array(n), ids], ["doc_id", "part", "at", "n_tokens", "ids"])
                at += int(starts[-1])
    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, stripe_mb: int = 64) -> None:
    """Writes (doc_id, part, at, n_tokens, ids) of docs (doc_id, text) to ORC files at path, in ascending order of doc_id."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns({"text_key": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    # rows that agree in doc_id and text may still go to several ranges, in any order
    ordered = rows.repartitionByRange(parts, "doc_id", "text_key", "row").sortWithinPartitions("doc_id", "text_key", "text").select("doc_id", "text")
    rows = ordered.mapInArrow(_encode(vocabulary, end_id), "doc_id long, part long, at long, n_tokens long, ids array<int>")
    rows.write.options(**{
        "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
        "orc.stripe.size": str(stripe_mb << 20), "compression": "zstd",
    }).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before."""
    rows = spark.read.schema("doc_id long, part long, at long, n_tokens long, ids array<int>").orc(path)
    # one row per file
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = sums.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Point reads: the filter reaches the file, stripe and row-group statistics and the Bloom filter."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def _crc(batches):
    for batch in batches:
        lists = batch.column(3)
        values, offs = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole documents, written to ORC and read back."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op3_orc_tokens": op3_orc_tokens}
ORACLE: dict[str, str] = {}

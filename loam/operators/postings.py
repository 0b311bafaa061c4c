"""An inverted index of texts on disk: questions whose keywords may be parts of tokens are answered, many at a time, from the matching postings alone.

Four keyed tables, added to batch by batch: the documents that are indexed, the distinct tokens, the runs of one to three characters of each token, and the postings (token, document). A keyword finds its tokens through its rarest run,
the tokens their documents; of each table only the buckets of what is asked are read. Frequent tokens and runs are spread over files by size. More than FEW words fall into all buckets, and their tokens aren't looked for: postings are read whole.

Documents of the tokens are dealt into shards that a task holds, and every shard answers every question with its own k best: it finds the words in its tokens, and the documents of a word are bits. So neither a row for each word and each token or document that holds it,
nor one for each question and each such document is ever made; what travels is the postings once, and each question once for each shard.
"""
from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import spread, written
from ..sources.keyed import KeyedTable
from .ranges import grams

#: Rows (token, document) in a shard, about, and shards for each core.
SHARD, SHARDS = 4_000_000, 3
#: Words whose tokens are looked for, at most; questions that a shard looks for at once; bytes of a block of its documents by word, about; words of a question that are counted in bits.
FEW, AT_ONCE, HELD, SHORT = 1000, 1 << 16, 1 << 26, 16


class Postings:
    """An index below `path` of texts by the column `key`."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        table = lambda name, by: KeyedTable(spark, f"{path}/{name}", by, buckets)
        self.spark, self.key = spark, key
        self.docs, self.tokens, self.grams, self.postings = table("docs", key), table("tokens", "token"), table("grams", "gram"), table("postings", "token")

    def add(self, df: DataFrame, body: str, batch: tuple[str, int] | None = None) -> None:
        """Indexes the rows whose key isn't indexed yet, the least text of each. With a batch's stream and number a batch that failed half-way is finished when it comes again, and one that is done is left out."""
        rows = spread(df.select(self.key, F.col(body).alias("body")).where(F.col(self.key).isNotNull()))
        # texts are sorted for keys that come twice alone
        twice = written(rows.groupBy(self.key).count().where("count > 1").select(self.key), "twice")
        if not twice.isEmpty():
            rows = rows.join(twice, self.key, "left_anti").unionByName(rows.join(twice, self.key, "left_semi").groupBy(self.key).agg(F.min("body").alias("body")))
        if self.docs.versions():
            # documents go in last: those of a batch that failed on the way aren't there yet
            rows = rows.join(self.docs.read().select(self.key), self.key, "left_anti")
        found = written(rows.select(self.key, F.explode(F.array_distinct(text.tokens(F.col("body")))).alias("token")), "tokens")
        new = found.select("token").distinct()
        if self.tokens.versions():
            new = new.join(self.tokens.read(), "token", "left_anti")
        new = written(new, "new")
        self.postings.append(found.select("token", self.key), batch)
        self.grams.append(new.select(F.explode(F.concat(*(grams(F.col("token"), n) for n in (1, 2, 3)))).alias("gram"), "token"), batch)
        self.tokens.insert_if_absent(new, batch)
        self.docs.insert_if_absent(rows.select(self.key), batch)

    def tokens_of(self, words: DataFrame) -> DataFrame:
        """(word, token): the tokens that each word (word, distinct) is part of."""
        w = F.col("word")
        asked = words.select("word", F.explode(F.when(F.length(w) >= 3, grams(w, 3)).otherwise(F.array(w))).alias("gram"))
        there = self.grams.read_for(asked.select("gram"))
        known = asked.join(there.groupBy("gram").agg(F.count_distinct("token").alias("n")), "gram", "left")
        rarest = known.groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_or(F.col("n").isNull()).alias("nowhere")).where("not nowhere")
        return rarest.join(there, "gram").where(F.contains("token", w)).select("word", "token").distinct()

    def search(self, questions: DataFrame, question: str, words: str, k: int) -> DataFrame:
        """(question, key, score): for each question (question, words) the k documents that hold most of its distinct words as parts of tokens, in ten-thousandths, equal ones by key."""
        asked = questions.select(question, F.array_distinct(F.filter(words, lambda w: F.coalesce(w, F.lit("")) != "")).alias("w"))
        each = asked.select(question, F.size("w").alias("of"), F.explode("w").alias("word")).distinct()
        # other words are part of no token
        per = written(each.groupBy(question).agg(F.first("of").alias("of"), F.array_join(F.collect_list(F.when(F.regexp_like("word", F.lit("^[a-z0-9]+$")), F.col("word"))), " ").alias("words")), "words")
        words_ = per.select(F.explode(F.split("words", " ")).alias("word")).where("word <> ''").distinct()
        rows = self.postings.read()
        if words_.limit(FEW + 1).count() <= FEW:
            held = written(self.tokens_of(words_).select("token").distinct(), "held")
            rows = written(self.postings.read_near(held).join(held, "token", "left_semi"), "rows")
        shards = max(SHARDS * self.spark.sparkContext.defaultParallelism, -(-rows.count() // SHARD))
        kinds = dict(questions.dtypes)[question], dict(rows.dtypes)[self.key]
        null = lambda kind: F.lit(None).cast(kind)
        # one column of text for both: a column of lists would cost more than all others, where it is null too
        a = rows.select(F.pmod(F.xxhash64(self.key), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("of"), F.col("token").alias("said"), F.col(self.key).alias("doc"), null(kinds[0]).alias("asks"))
        b = per.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "of", F.col("words").alias("said"), null(kinds[1]).alias("doc"), F.col(question).alias("asks"))
        dealt = a.unionByName(b).repartitionById(shards, F.col("shard")).sortWithinPartitions("of")
        best = dealt.drop("shard").mapInArrow(_best(k), f"asks {kinds[0]}, doc {kinds[1]}, score long")
        nth = F.row_number().over(Window.partitionBy("asks").orderBy(F.desc("score"), "doc"))
        return best.withColumn("nth", nth).where(F.col("nth") <= k).select(F.col("asks").alias(question), F.col("doc").alias(self.key), "score")


class _Shard:
    """The documents of each word, as places in the order of their keys."""

    def __init__(self, ws: list[np.ndarray], docs: list[np.ndarray]):
        self.docs, place = np.unique(np.concatenate(docs), return_inverse=True)
        words, word = np.unique(np.concatenate(ws), return_inverse=True)
        pairs = np.unique(word * len(self.docs) + place)
        word, self.places = np.divmod(pairs, len(self.docs))
        self.ends = np.searchsorted(word, np.arange(len(words) + 1))
        self.number = {w: i for i, w in enumerate(words.tolist())}
        self.counts = np.zeros(len(self.docs), np.uint16)

    def best(self, ws: list[int], of: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k documents that hold most of the words, those of equal scores in order."""
        numbers = [self.number[w] for w in ws if w in self.number]
        lists = [self.places[self.ends[i]:self.ends[i + 1]] for i in numbers]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.floor(np.arange(len(lists) + 1) / of * 10000 + 0.5).astype(np.int64)
        if len(lists) == 1:
            at = lists[0][:k]
            return at, np.full(len(at), score[1])
        if sum(map(len, lists)) * 8 < len(self.docs):
            at, n = np.unique(np.concatenate(lists), return_counts=True)
        else:
            self.counts[:] = 0
            for x in lists:
                self.counts[x] += 1
            at, c = [], len(lists)
            # equal scores together, the highest first, until there are k
            while c > 0 and sum(map(len, at)) < k:
                low = int(np.searchsorted(score, score[c]))
                at.append(np.flatnonzero((self.counts >= max(1, low)) & (self.counts <= c))[:k])
                c = low - 1
            at = np.concatenate(at)
            n = self.counts[at]
        order = np.lexsort((at, -score[n]))[:k]
        return at[order], score[n[order]]


class _Tokens:
    """The documents of each token of a shard, as places in the order of their keys, and the words that are part of tokens."""

    def __init__(self, tokens: pa.ChunkedArray, docs: pa.ChunkedArray):
        self.docs, place = np.unique(docs.to_numpy(), return_inverse=True)
        coded = tokens.combine_chunks().dictionary_encode()
        self.tokens, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.places = place[order].astype(np.int32)
        self.ends = np.searchsorted(code[order], np.arange(len(self.tokens) + 1))

    def parts(self, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that hold each word, those of word i from ends[i] to ends[i + 1]. Runs of a token are looked up among the words, so a token costs the same for any number of them."""
        lengths, found, many = sorted({len(w) for w in words}), array("i"), np.zeros(len(self.tokens), np.int32)
        runs = lambda n: (slice(at, at + length) for length in lengths if length <= n for at in range(n - length + 1))
        usual = [list(runs(n)) for n in range(33)]
        for i, t in enumerate(self.tokens):
            here = [words[w] for run in (usual[len(t)] if len(t) < len(usual) else runs(len(t))) if (w := t[run]) in words]
            found.extend(here)
            many[i] = len(here)
        word = np.array(found, np.int32)
        order = np.argsort(word, kind="stable")
        token = np.repeat(np.arange(len(many), dtype=np.int32), many)[order]
        return token, np.searchsorted(word[order], np.arange(len(words) + 1))

    def held(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of some tokens, one after another, and how many each has."""
        n = self.ends[token + 1] - self.ends[token]
        return self.places[np.arange(n.sum()) + np.repeat(self.ends[token] - (np.cumsum(n) - n), n)], n

    def bits(self, token: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
        """A row of bits for each word, in which the places of its documents are set."""
        wide = -(-len(self.docs) // 64) * 64
        there = np.zeros((len(words), wide), np.bool_)
        n = ends[words + 1] - ends[words]
        mine = token[np.arange(n.sum()) + np.repeat(ends[words] - (np.cumsum(n) - n), n)]
        row = np.repeat(np.arange(len(words)) * wide, n)
        # places of a part of the tokens at once: a common word has many
        held = self.ends[mine + 1] - self.ends[mine]
        for lo, hi in _cut(np.cumsum(held), HELD // 16):
            places, many = self.held(mine[lo:hi])
            there.ravel()[np.repeat(row[lo:hi], many) + places] = True
        return np.packbits(there, axis=1, bitorder="little").view("<u8")


def _cut(sums: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges that make up `most` each, or hold one element."""
    out, lo = [], 0
    while lo < len(sums):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + most, "right")))
        out.append((lo, hi))
        lo = hi
    return out


def _first(bits: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the first `most` bits that are set in each row."""
    n = np.bitwise_count(bits)
    before = np.cumsum(n, axis=1, dtype=np.int32) - n
    row, at = np.nonzero((n > 0) & (before < most[:, None]))
    i, bit = np.nonzero((bits[row, at][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    row, place = row[i], at[i] * 64 + bit
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    kept = nth < most[row]
    return row[kept], place[kept]


def _top(words: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and counts of the k documents that hold most words for each question, those of equal counts in order. asked: for each question rows of `words`, the last of which is empty."""
    least = []  # by count, the documents that hold so many words or more
    for held in (words[asked[:, j]] for j in range(asked.shape[1])):
        least.append(least[-1] & held if least else held.copy())
        for c in range(len(least) - 2, 0, -1):
            least[c] |= least[c - 1] & held
        if len(least) > 1:
            least[0] |= held
    room, out = np.full(len(asked), k), []
    for c in range(len(least), 0, -1):
        open_ = np.flatnonzero(room)
        here = least[c - 1][open_] & ~least[c][open_] if c < len(least) else least[c - 1][open_]
        row, place = _first(here, room[open_])
        room -= np.bincount(open_[row], minlength=len(room))
        out.append((open_[row], place, np.full(len(row), c)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _answers(shard: _Tokens, of: np.ndarray, asked: list[list[str]], k: int):
    """Rows (question, place, score) of the k best of each question."""
    words: dict[str, int] = {}
    numbers = [[words.setdefault(w, len(words)) for w in ws] for ws in asked]
    token, ends = shard.parts(words)
    there = np.diff(ends) > 0
    numbers = [[w for w in ws if there[w]] for ws in numbers]
    many = np.array([len(ws) for ws in numbers])
    for q in np.flatnonzero((many > 0) & (of > SHORT)).tolist():
        # one question of many words: its documents are counted
        held = [shard.held(token[ends[w]:ends[w + 1]])[0] for w in numbers[q]]
        own = _Shard([np.full(len(x), w) for w, x in zip(numbers[q], held, strict=True)], held)
        place, score = own.best(numbers[q], int(of[q]), k)
        yield np.full(len(place), q), own.docs[place], score
    short = np.flatnonzero((many > 0) & (of <= SHORT))
    for lo, hi in _cut(np.cumsum(many[short]), max(1, HELD // max(64, len(shard.docs)))):
        here = short[lo:hi]
        own = np.unique(np.concatenate([numbers[q] for q in here]))
        bits = shard.bits(token, ends, own)
        rows = np.full((len(here), many[here].max()), len(own))
        for i, q in enumerate(here):
            rows[i, :many[q]] = np.searchsorted(own, numbers[q])
        row, place, count = _top(np.vstack([bits, np.zeros_like(bits[:1])]), rows, k)
        yield here[row], place, np.floor(count / of[here[row]] * 10000 + 0.5).astype(np.int64)


def _best(k: int):
    """A shard's documents before its questions."""
    def run(batches):
        schema, shard, held, asked = None, None, [], []

        def answered():
            nonlocal shard, held, asked
            if shard is None and held:
                # what the batches hold is let go first
                columns = [pa.chunked_array([b.column(i) for b in held]) for i in (0, 1)]
                held = []
                shard = _Tokens(*columns)
            table, asked = pa.Table.from_batches(asked), []
            if shard is None:
                return  # a shard without documents
            for q, place, score in _answers(shard, table["of"].to_numpy(), [ws.split() for ws in table["said"].to_pylist()], k):
                if len(q):
                    yield pa.RecordBatch.from_arrays([table["asks"].combine_chunks().take(pa.array(q)), pa.array(shard.docs[place], schema.field("doc").type), pa.array(score)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([("asks", batch.schema.field("asks").type), ("doc", batch.schema.field("doc").type), ("score", pa.int64())])
            docs = int(np.searchsorted(batch.column("of").to_numpy(), 1))
            if docs:
                held.append(batch.slice(0, docs).select(["said", "doc"]))
            if docs < batch.num_rows:
                asked.append(batch.slice(docs).select(["asks", "of", "said"]))
                if sum(b.num_rows for b in asked) >= AT_ONCE:
                    yield from answered()
        if asked:
            yield from answered()
    return run

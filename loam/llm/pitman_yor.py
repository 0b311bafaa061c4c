"""Language-model scoring with a hierarchical Pitman-Yor model over words.

Each word is drawn in the restaurant of the word before it (or of a text's start). These context restaurants share one parent, the unigram restaurant, whose base is uniform over
the known words and one unknown: a table that a word opens in a context restaurant is a customer of the parent. Seating is sampled by Gibbs: in each sweep every customer of every
dish is seated anew, one after another, given the other dishes' tables of the sweep before. Discounts are learned from the words that came once and twice, the
strength of either level is sampled from its posterior over a grid given the seating. Predictive probabilities are averaged over the last SAMPLES sweeps.

Data flow: texts become blocks of bounded size, each a list of its words and a stream of places in it. Blocks ask word buckets for counts and context buckets for pairs, with
distinct words and pairs only, so traffic doesn't grow with repeats inside a block. A context's pairs lie in one bucket; contexts of over a thousandth of all tokens (a thousand at most) are dealt
over several by the word that follows, and their totals pass through the driver. A pair that occurs once needs no sampling, so sweeps work on the few that occur more often: context buckets
send the tables that words opened to word buckets, which send the words' counts at the root back. Buckets number by input bytes, so none grows with the input.

Words are known by 64-bit hashes, bytes of one length up to eight never by the same one. Two words back are no contexts here: distinct triples would nearly double what is shuffled, which
the disk budget doesn't hold.

Defined cases: a null or empty text is one end token; repeated rows count each; a null doc_id is not held out and is learned from; without training rows every word is unknown; very long texts are blocks of their own; other columns are ignored.
"""
from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as vt
from .shared import materialize, release, table

SWEEPS, SAMPLES, SEED = 5, 2, 29
#: Bytes of text in a block and for each bucket, about; a context is hot from one in so many tokens on.
BLOCK_BYTES, BUCKET_BYTES, HOT = 10 << 20, 16 << 20, 1000
#: Strengths to sample from.
GRID = [0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0]
#: Customers of a dish that are seated in step with those of other dishes; later ones by the waiting time to the next new table, which has the same distribution.
IN_STEP = 2048
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

_PARTS = ["a", "b", "c", "d", "e", "f"]
_ROWS = "kind string, bucket int, block string, part int, a binary, b binary, c binary, d binary, e binary, f binary, sums array<double>"
_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.string()), ("part", pa.int32()), *((x, pa.binary()) for x in _PARTS), ("sums", pa.list_(pa.float64()))])


def _pack(x: np.ndarray) -> bytes:
    """Type, length and bytes by place, so equal high bytes lie together."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return f"{x.dtype.str} {len(x)}\n".encode() + (pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def _unpack(raw: bytes) -> np.ndarray:
    head, _, body = raw.partition(b"\n")
    kind, n = head.decode().split()
    kind, n = np.dtype(kind), int(n)
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(body, n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=x.dtype.type(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    x = _unpack(raw)
    return np.cumsum(x, dtype=x.dtype)


def _row(kind: str, bucket: int = 0, block: str | None = None, part: int = 0, sums=None, **parts: bytes) -> dict:
    return {"kind": kind, "bucket": int(bucket), "block": block, "part": int(part), "sums": None if sums is None else [float(x) for x in sums], **{x: parts.get(x) for x in _PARTS}}


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _SCHEMA)


def _batches(rows: list[dict]):
    return _table(rows).to_batches()


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the least unsigned type that holds them."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the number of each text."""
    low = vt.LOWER[data]
    starts, ends, doc = vt.words(low, offs)
    n = np.bincount(doc, minlength=len(offs) - 1).astype(np.int64) + 1
    word = np.full(int(n.sum()), _END, np.uint64)
    word[np.arange(len(starts)) + doc] = vt.hashes(low, starts, ends)
    return word, n


def _blocks(batches):
    held: list[tuple] = []
    size = 0

    def block():
        ids, out, n, word = (np.concatenate(x) for x in zip(*held, strict=True))
        words, of, times = np.unique(word, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        held.clear()
        return _batches([_row("block", block=uuid.uuid4().hex, a=_pack(ids), b=_pack(np.where(out, -n, n)), c=_pack(words[order]), d=_pack(_small(place[of])), sums=[size])])

    for batch in batches:
        ids = pa.array(batch.column(0)).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)
        out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, offs in vt.slices(batch.column(1)):
            word, n = _tokens(data, offs)
            held.append((ids[lo:hi], out[lo:hi], n, word))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from block()
                size = 0
    if held:
        yield from block()


class _Block:
    """A block's words and distinct pairs, in the same order whenever it is read."""

    def __init__(self, row: dict, buckets: int, hot: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, n, self.words, stream = (_unpack(row[x]) for x in "abcd")
        self.n, self.out, self.stream = np.abs(n), n < 0, stream.astype(np.int32)
        self.learned = np.repeat(~self.out, self.n)
        self.buckets, self.hot = buckets, hot

    def asks(self):
        """Words by bucket and hash: order of the words, and bounds of the buckets."""
        at = _word_bucket(self.words, self.buckets)
        order = np.lexsort((self.words, at))
        return order, np.searchsorted(at[order], np.arange(self.buckets + 1)).tolist()

    def pairs(self):
        """Distinct pairs by bucket, context and word: context and word of each (as hashes and as places), number of each token's pair, and bounds of the buckets."""
        k = len(self.words)
        key = np.empty(len(self.stream), np.int64)
        key[1:] = self.stream[:-1]
        key[np.cumsum(self.n) - self.n] = k
        key *= k + 1
        key += self.stream
        key, of = np.unique(key, return_inverse=True)
        u, w = key // (k + 1), key % (k + 1)
        named = np.append(self.words, _START)
        uh, wh = named[u], named[w]
        salt = np.zeros(len(u), np.uint64)
        hot, spread = self.hot
        if len(hot):
            place = np.minimum(np.searchsorted(hot, uh), len(hot) - 1)
            is_hot = hot[place] == uh
            salt[is_hot] = vt.mix(wh[is_hot]) % spread[place[is_hot]]
        at = (vt.mix(uh + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((wh, uh, at))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        return u[order], w[order], uh[order], wh[order], place[of], np.searchsorted(at[order], np.arange(self.buckets + 1)).tolist()


def _firsts(x: np.ndarray) -> np.ndarray:
    """Places where a run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _ask_words(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, buckets)
                times = np.bincount(b.stream[b.learned], minlength=len(b.words))
                order, cuts = b.asks()
                yield from _batches([_row("ask", i, row["block"], a=_pack_sorted(b.words[order[lo:hi]]), b=_pack(_small(times[order[lo:hi]]))) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo])
    return run


def _vocabulary(key, rows):
    """A bucket's words and training counts, and for each block the places of its words."""
    rows = rows.to_pylist()
    asked = [_unpack_sorted(r["a"]) for r in rows]
    words, of = np.unique(np.concatenate(asked), return_inverse=True)
    count = np.bincount(of, np.concatenate([_unpack(r["b"]) for r in rows]).astype(float)).astype(np.int64)
    cuts = np.cumsum([0, *map(len, asked)])
    bucket = key[0].as_py()
    return _table([_row("vocabulary", bucket, a=_pack_sorted(words), b=_pack(_small(count)), sums=[count.sum(), (count > 0).sum()]),
                   *(_row("ask", bucket, r["block"], a=_pack_sorted(_small(of[lo:hi]))) for r, lo, hi in zip(rows, cuts[:-1], cuts[1:], strict=True))])


def _often(least: float):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, n = _unpack_sorted(row["a"]), _unpack(row["b"]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words[n > least].view(np.int64)), pa.array(n[n > least])], ["word", "n"])
    return run


def _ask_pairs(buckets: int, hot):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, buckets, hot)
                _, _, uh, wh, of, cuts = b.pairs()
                times = np.bincount(of[b.learned], minlength=len(uh))
                for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if hi > lo:
                        first = _firsts(uh[lo:hi])
                        names, place = np.unique(wh[lo:hi], return_inverse=True)
                        yield from _batches([_row("pairs", i, row["block"], a=_pack_sorted(uh[lo:hi][first]), b=_pack(_small(np.diff(np.append(first, hi - lo)))), c=_pack_sorted(names), d=_pack(_small(place)), e=_pack(_small(times[lo:hi])))])
    return run


def _restaurants(buckets: int, hot_words: np.ndarray):
    """A bucket's context restaurants from all blocks' pairs, and answers to the blocks that seating doesn't change."""
    def run(key, rows):
        rows, bucket = rows.to_pylist(), key[0].as_py()
        heads = [_unpack_sorted(r["a"]) for r in rows]
        sizes = [_unpack(r["b"]).astype(np.int64) for r in rows]
        u = np.concatenate([np.repeat(h, s) for h, s in zip(heads, sizes, strict=True)])
        w = np.concatenate([_unpack_sorted(r["c"])[_unpack(r["d"])] for r in rows])
        times = np.concatenate([_unpack(r["e"]).astype(np.int64) for r in rows])
        order = np.lexsort((w, u))
        new = np.concatenate([[True], (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])])
        of = np.empty(len(u), np.int64)
        of[order] = np.cumsum(new) - 1
        c = np.bincount(of, times).astype(np.int64)
        u, w = u[order][new], w[order][new]
        cuts = np.cumsum([0, *(int(s.sum()) for s in sizes)])
        out = [_row("count", bucket, r["block"], a=_pack(_small(c[of[lo:hi]]))) for r, lo, hi in zip(rows, cuts[:-1], cuts[1:], strict=True)]
        seated = c > 0
        names, context = np.unique(u[seated], return_inverse=True)
        customers = np.bincount(context, c[seated], minlength=len(names)).astype(np.int64)
        dishes = np.bincount(context, minlength=len(names)).astype(np.int64)
        place = np.minimum(np.searchsorted(hot_words, names), max(0, len(hot_words) - 1))
        hot = np.where(hot_words[place] == names, place + 1, 0) if len(hot_words) else np.zeros(len(names), np.int64)
        again = c[seated] > 1
        # words by bucket and hash, with the number of contexts that they occur in; wanted are those of pairs that are sampled
        sw = w[seated]
        words, word = np.unique(sw, return_inverse=True)
        line = np.lexsort((words, _word_bucket(words, buckets)))
        back = np.empty(len(line), np.int64)
        back[line] = np.arange(len(line))
        word, words = back[word], words[line]
        contexts = np.bincount(word, minlength=len(words))
        wanted = np.bincount(word[again], minlength=len(words)) > 0
        number = np.cumsum(wanted) - 1
        edge = np.searchsorted(_word_bucket(words, buckets), np.arange(buckets + 1))
        per = np.add.reduceat(np.append(wanted, False).astype(np.int64), np.minimum(edge[:-1], len(wanted))) * (np.diff(edge) > 0) if len(wanted) else np.zeros(buckets, np.int64)
        for i in np.flatnonzero(np.diff(edge)).tolist():
            lo, hi = edge[i], edge[i + 1]
            out.append(_row("words", i, part=bucket, a=_pack_sorted(words[lo:hi]), b=_pack(_small(contexts[lo:hi])), c=_pack(wanted[lo:hi].astype(np.uint8))))
        sums = np.zeros(3 + 2 * len(hot_words))
        sums[:3] = dishes.sum(), (c == 1).sum(), (c == 2).sum()
        np.add.at(sums, 2 + hot[hot > 0], customers[hot > 0])
        np.add.at(sums, 2 + len(hot_words) + hot[hot > 0], dishes[hot > 0])
        out.append(_row("restaurants", bucket, a=_pack(_small(customers)), b=_pack(_small(dishes)), c=_pack(_small(hot)), d=_pack(_small(context[again])), e=_pack(_small(number[word[again]])), f=_pack(np.concatenate([per, c[seated][again]])), sums=sums))
        # what a block asks after each sampling: its contexts, and its pairs that are sampled
        active = np.full(len(c), -1)
        active[np.flatnonzero(seated)[again]] = np.arange(int(again.sum()))
        for r, head, lo, hi in zip(rows, heads, cuts[:-1], cuts[1:], strict=True):
            at = np.minimum(np.searchsorted(names, head), max(0, len(names) - 1))
            known = names[at] == head if len(names) else np.zeros(len(head), bool)
            mine = active[of[lo:hi]]
            out.append(_row("ask", bucket, r["block"], a=_pack(_small(np.where(known, at + 1, 0))), b=_pack(_small(mine[mine >= 0]))))
        return _table(out)
    return run


def _root(key, known, sent):
    """How many contexts each word of a bucket occurs in, and where the words lie that each context bucket wants."""
    words = _unpack_sorted(next(r["a"] for r in known.to_pylist() if r["kind"] == "vocabulary"))
    bucket, contexts, out = key[0].as_py(), np.zeros(len(words), np.int64), []
    for r in sent.to_pylist():
        at = np.searchsorted(words, _unpack_sorted(r["a"]))
        contexts[at] += _unpack(r["b"])
        out.append(_row("want", bucket, part=r["part"], a=_pack_sorted(_small(at[_unpack(r["c"]) > 0]))))
    return _table([_row("root", bucket, a=_pack(_small(contexts)), sums=[contexts.sum(), (contexts > 0).sum(), (contexts == 1).sum(), (contexts == 2).sum()]), *out])


def seat(c: np.ndarray, new: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of each dish with c customers, seated one after another: the next one opens a table with the odds `new` against the seated c' - discount * t."""
    t = np.ones(len(c), np.int64)
    order = np.argsort(-c, kind="stable")
    sizes = c[order]
    for n in range(1, min(IN_STEP, int(c.max(initial=0)))):
        live = order[:int(np.searchsorted(-sizes, -n, "left"))]
        t[live] += rng.random(len(live)) * (new[live] + n - discount * t[live]) < new[live]
    for i in order[:int(np.searchsorted(-sizes, -IN_STEP, "left"))].tolist():
        t[i] = _seat_late(int(c[i]), float(new[i]), discount, IN_STEP, int(t[i]), rng)
    return t


def _seat_late(c: int, new: float, discount: float, n: int, t: int, rng) -> int:
    """The tables of one dish, from n customers at t tables on: the customers until the next new table are drawn at once."""
    while n < c:
        x = n - discount * t
        least = math.log(1 - rng.random())
        whole = math.lgamma(x + new) - math.lgamma(x)
        log_none = lambda m: whole + math.lgamma(x + m) - math.lgamma(x + m + new)  # noqa: E731, B023  that m more open none
        if log_none(c - n) > least:
            break
        lo, hi = 0, c - n  # the first m with log_none(m) <= least
        guess = x * math.expm1(min(700.0, -least / max(new, 1e-300)))
        for m in (int(min(hi - 1, guess * 0.98)), int(min(hi - 1, guess * 1.02 + 2))):
            if lo < m < hi:
                lo, hi = (m, hi) if log_none(m) > least else (lo, m)
        while hi - lo > 1:
            m = (lo + hi) // 2
            lo, hi = (m, hi) if log_none(m) > least else (lo, m)
        n, t = n + hi, t + 1
    return t


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series after ten steps up."""
    z = x + 10.0
    out = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z ** 3)
    return out - sum(np.log(x + i) for i in range(10))


def seating_log(c: np.ndarray, t: np.ndarray, d: float, weight: np.ndarray, grid: list[float]) -> np.ndarray:
    """For each strength of the grid the log-likelihood, up to what doesn't depend on it, of restaurants with c customers at t tables."""
    out = []
    for s in grid:
        out.append(float(((lgamma(s / d + t) - lgamma(np.full(1, s / d + 1)) + (t - 1) * math.log(d) - lgamma(s + c) + lgamma(np.full(1, s + 1.0))) * weight).sum()))
    return np.array(out)


class Level:
    """Strength, discount and totals of one level at one time."""

    def __init__(self, strength: float, discount: float, customers: float, tables: float):
        self.strength, self.discount, self.customers, self.tables = strength, discount, customers, tables

    def back(self) -> float:
        """What the root leaves to its base."""
        return (self.strength + self.discount * self.tables) / (self.strength + self.customers)


def _root_sweep(root: Level, n_words: int, number: int):
    """Customers and tables at the root, and what each context bucket wants of them: customers - discount * tables."""
    def run(key, known, sent):
        bucket, known = key[0].as_py(), known.to_pylist()
        c = _unpack(next(r["a"] for r in known if r["kind"] == "root")).astype(np.int64)
        want = {r["part"]: _unpack_sorted(r["a"]) for r in known if r["kind"] == "want"}
        for r in sent.to_pylist():
            c[want[r["part"]]] += _unpack(r["a"])
        t, seated = np.zeros(len(c), np.int64), np.flatnonzero(c)
        odds = (root.strength + root.discount * root.tables) / (n_words + 1)
        t[seated] = seat(c[seated], np.full(len(seated), odds), root.discount, np.random.default_rng([SEED, number, bucket, 0]))
        rest = (c - root.discount * t).astype(np.float32)
        return _table([_row("state", bucket, part=number, a=_pack(_small(c)), b=_pack(_small(t)), sums=[c.sum(), t.sum(), (c == 1).sum(), (c == 2).sum()]), *(_row("down", part, part=bucket, a=_pack(rest[at])) for part, at in want.items() if len(at))])
    return run


def _tables_of(restaurants: dict, t: np.ndarray, hot_tables: np.ndarray) -> np.ndarray:
    """Tables of each context of a bucket; those of hot contexts are known from all buckets."""
    dishes, hot, context = (_unpack(restaurants[x]).astype(np.int64) for x in "bcd")
    total = dishes + np.bincount(context, t - 1, minlength=len(dishes)).astype(np.int64)
    return np.where(hot > 0, hot_tables[hot - 1], total) if len(hot_tables) else total


def _context_sweep(level: Level, root: Level, n_words: int, hot_tables: np.ndarray, buckets: int, number: int, grid: list[float]):
    def run(key, known, sent):
        bucket, known = key[0].as_py(), known.to_pylist()
        mine = next(r for r in known if r["kind"] == "restaurants")
        customers, dishes, hot, context, wanted = (_unpack(mine[x]).astype(np.int64) for x in "abcde")
        per, c = np.split(_unpack(mine["f"]), [buckets])
        before = next((_unpack(r["a"]).astype(np.int64) for r in known if r["kind"] == "tables"), np.ones(len(c), np.int64))
        rest = [_unpack(r["a"]).astype(float) for r in sorted(sent.to_pylist(), key=lambda r: r["part"])]
        base = np.concatenate([*rest, np.zeros(0)]) / (root.strength + root.customers) + root.back() / (n_words + 1)
        odds = (level.strength + level.discount * _tables_of(mine, before, hot_tables))[context] * base[wanted]
        t = seat(c, odds, level.discount, np.random.default_rng([SEED, number, bucket, 1]))
        more = np.bincount(wanted, t - 1, minlength=int(per.sum())).astype(np.int64)
        total = dishes + np.bincount(context, t - 1, minlength=len(dishes)).astype(np.int64)
        sums = np.zeros(1 + len(hot_tables) + len(grid))
        sums[0] = total.sum()
        np.add.at(sums, hot[hot > 0], total[hot > 0])
        kinds, weight = np.unique((customers << 32 | total)[hot == 0], return_counts=True)
        sums[1 + len(hot_tables):] = seating_log((kinds >> 32).astype(float), (kinds & 0xFFFFFFFF).astype(float), level.discount, weight, grid)
        ends = np.cumsum(per)
        return _table([_row("tables", bucket, part=number, a=_pack(_small(t)), sums=sums), *(_row("up", i, part=bucket, a=_pack(_small(more[ends[i] - per[i]:ends[i]]))) for i in np.flatnonzero(per).tolist())])
    return run


def _word_answers(roots: dict[int, Level]):
    """For each block's words their training counts and, for each sample, customers - discount * tables at the root."""
    def run(key, known, states):
        known = known.to_pylist()
        count = _unpack(next(r["b"] for r in known if r["kind"] == "vocabulary"))
        rest = {r["part"]: (_unpack(r["a"]) - roots[r["part"]].discount * _unpack(r["b"])).astype(np.float32) for r in states.to_pylist()}
        out = []
        for r in known:
            if r["kind"] == "ask":
                at = _unpack_sorted(r["a"])
                out.append(_row("words", key[0].as_py(), r["block"], a=_pack(count[at]), b=_pack(np.concatenate([rest[s][at] for s in roots]))))
        return _table(out)
    return run


def _context_answers(hot_customers: np.ndarray, hot_tables: dict[int, np.ndarray]):
    """For each block's contexts their customers and, for each sample, their tables; and the tables of its pairs that are sampled."""
    def run(key, known, states):
        known = known.to_pylist()
        mine = next(r for r in known if r["kind"] == "restaurants")
        customers, hot = (_unpack(mine[x]).astype(np.int64) for x in "ac")
        if len(hot_customers):
            customers = np.where(hot > 0, hot_customers[hot - 1], customers)
        found = {r["part"]: _unpack(r["a"]).astype(np.int64) for r in states.to_pylist()}
        total = {s: np.append(0, _tables_of(mine, found[s], hot_tables[s])) for s in hot_tables}
        customers, out = np.append(0, customers), []
        for r in known:
            if r["kind"] == "ask":
                at, pairs = _unpack(r["a"]), _unpack(r["b"])
                out.append(_row("contexts", key[0].as_py(), r["block"], a=_pack(_small(customers[at])), b=_pack(_small(np.concatenate([total[s][at] for s in hot_tables]))), c=_pack(_small(np.concatenate([found[s][pairs] for s in hot_tables])))))
        return _table(out)
    return run


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(buckets: int, hot, levels: list[tuple[Level, Level]], n_all: int, n_words: int):
    """A block's documents from its stream and the answers to its words, contexts and pairs."""
    def run(key, rows):
        rows = rows.to_pylist()
        by = {(r["kind"], r["bucket"]): r for r in rows}
        b = _Block(by["block", 0], buckets, hot)
        k, samples = len(b.words), len(levels)
        order, cuts = b.asks()
        count, rest = np.zeros(k, np.int64), np.zeros((samples, k))
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if hi > lo:
                r = by["words", i]
                count[order[lo:hi]], rest[:, order[lo:hi]] = _unpack(r["a"]), _unpack(r["b"]).reshape(samples, -1)
        u, w, uh, _, of, cuts = b.pairs()
        own, customers = np.zeros(len(u), np.int64), np.zeros(len(u))
        own_tables, tables = np.ones((samples, len(u)), np.float32), np.zeros((samples, len(u)), np.float32)
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if hi > lo:
                r, first = by["contexts", i], _firsts(uh[lo:hi])
                group = np.cumsum(np.bincount(first, minlength=hi - lo)) - 1
                own[lo:hi] = _unpack(by["count", i]["a"])
                customers[lo:hi] = _unpack(r["a"])[group]
                tables[:, lo:hi] = _unpack(r["b"]).reshape(samples, -1)[:, group]
                again = lo + np.flatnonzero(own[lo:hi] > 1)
                own_tables[:, again] = _unpack(r["c"]).reshape(samples, -1)
        p = np.zeros(len(u))
        for s, (level, root) in enumerate(levels):
            base = rest[s] / (root.strength + root.customers) + root.back() / (n_words + 1)
            p += (np.maximum(own - level.discount * own_tables[s], 0) * (own > 0) + (level.strength + level.discount * tables[s]) * base[w]) / (level.strength + customers)
        logp, plain = np.log10(p / samples)[of], np.log10((count + 1) / (n_all + n_words + 1))[b.stream]
        at = np.cumsum(b.n) - b.n
        none = b.ids == np.iinfo(np.int64).min
        add = lambda x: np.add.reduceat(x, at) if len(at) else x
        return pa.table({"doc_id": pa.array(b.ids, mask=none), "held_out": b.out, "n_tokens": b.n, "n_known": add((count[b.stream] > 0).astype(np.int64)), "train_tokens": np.full(len(b.ids), n_all), "base_score": add(plain), "score": add(logp)})
    return run


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / max(1.0, once + 2 * twice), 0.05, 0.95))


def _draw(grid: list[float], logs: np.ndarray, rng) -> float:
    """A strength of the grid by its posterior."""
    p = np.exp(logs - logs.max())
    return grid[int(rng.choice(len(grid), p=p / p.sum()))]


def score(docs: DataFrame, held_out: Column, grid: list[float] = GRID) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out"))
    blocks = materialize(rows.mapInArrow(_blocks, _ROWS), "blocks")
    total = lambda df, kind: np.sum([r.sums for r in df.where(F.col("kind") == kind).select("sums").collect()] or [[0.0] * 99], axis=0)  # noqa: E731  one short row per bucket or block
    buckets = max(1, round(total(blocks, "block")[0] / BUCKET_BYTES))
    asked = blocks.mapInArrow(_ask_words(buckets), _ROWS)
    words = materialize(asked.groupBy("bucket").applyInArrow(_vocabulary, _ROWS), "words")
    n_all, n_words = (int(x) for x in total(words, "vocabulary")[:2])
    often = {np.int64(r.word).astype(np.uint64): r.n for r in words.where("kind = 'vocabulary'").mapInArrow(_often(n_all / HOT), "word long, n long").collect()}  # HOT rows at most
    if _END in often:
        often[_START] = often[_END]  # as many starts as ends
    hot_words = np.sort(np.array(list(often), np.uint64))
    hot = hot_words, np.array([min(buckets, -(-often[x] * HOT // max(1, n_all))) for x in hot_words], np.uint64)
    pairs = blocks.mapInArrow(_ask_pairs(buckets, hot), _ROWS)
    built = materialize(pairs.groupBy("bucket").applyInArrow(_restaurants(buckets, hot_words), _ROWS), "restaurants")
    release(spark)
    together = lambda left, right: left.groupBy("bucket").cogroup(right.groupBy("bucket"))
    root_rows = materialize(together(words.where("kind = 'vocabulary'"), built.where("kind = 'words'")).applyInArrow(_root, _ROWS), "root")
    sums, k = total(built, "restaurants"), len(hot_words)
    discount = _discount(sums[1], sums[2])
    hot_customers, hot_tables = sums[3:3 + k], sums[3 + k:3 + 2 * k]
    c0, t0, once, twice = total(root_rows, "root")[:4]
    level, root = Level(1.0, discount, n_all, sums[0]), Level(1.0, _discount(once, twice), c0, t0)
    rng = np.random.default_rng(SEED)
    restaurants = built.where("kind = 'restaurants'")
    up = built.where("kind = 'none'")
    tables, kept, states, seatings = up, [], [], []
    for number in range(SWEEPS):
        state = materialize(together(root_rows, up).applyInArrow(_root_sweep(root, n_words, number), _ROWS), "state")
        c0, t0, once, twice = total(state, "state")[:4]
        now = Level(root.strength, root.discount, c0, t0)
        swept = materialize(together(restaurants.union(tables), state.where("kind = 'down'")).applyInArrow(_context_sweep(level, now, n_words, hot_tables, buckets, number, grid), _ROWS), "tables")
        tables, up, sums = swept.where("kind = 'tables'"), swept.where("kind = 'up'"), total(swept, "tables")
        hot_tables = sums[1:1 + k]
        after = Level(level.strength, discount, n_all, sums[0])
        if number >= SWEEPS - SAMPLES:
            kept.append((number, after, now, hot_tables))
            states.append(state.where("kind = 'state'"))
            seatings.append(tables)
        logs = sums[1 + k:1 + k + len(grid)] + (seating_log(hot_customers, hot_tables, discount, np.ones(k), grid) if k else 0)
        level = Level(_draw(grid, logs, rng), discount, n_all, sums[0])
        root = Level(_draw(grid, seating_log(np.array([max(c0, 1.0)]), np.array([max(t0, 1.0)]), root.discount, np.ones(1), grid), rng), _discount(once, twice), c0, t0)
    states, seatings = (x[0].union(x[1]) if len(x) == 2 else x[0] for x in (states, seatings))
    release(spark)
    answers = together(words, states).applyInArrow(_word_answers({n: r for n, _, r, _ in kept}), _ROWS)
    more = together(restaurants.union(built.where("kind = 'ask'")), seatings).applyInArrow(_context_answers(hot_customers, {n: h for n, _, _, h in kept}), _ROWS)
    every = blocks.union(built.where("kind = 'count'")).union(answers).union(more)
    return every.groupBy("block").applyInArrow(_score(buckets, hot, [(x, r) for _, x, r, _ in kept], n_all, n_words), _OUT)


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole documents, learned from all but the held-out seventh."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score(table(spark, sf_dir, "documents"), held)


QUERIES = {"op6_pitman_yor": op6_pitman_yor}
ORACLE: dict[str, str] = {}

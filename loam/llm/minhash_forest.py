"""Near-duplicate components by an LSH forest over MinHash signatures.

Plan: one pass hashes every text to its set of word shingles, a 128-bit key of the set and a
one-permutation MinHash signature. Equal sets collapse to one class first, so groups of copies cost one
row each. Every class then enters TREES sorted orders, each over its own order of signature values. A range
partitioning by the whole sort key keeps any dense region spread over tasks. Depth adapts to the region: where at most RUN classes
share four values they all meet; in a denser run the order goes on by up to DEPTH values and each class meets its longest-common-prefix neighbours.
The most frequent meetings are verified on full sets and give the first components.

Dense runs, and runs that may go on in another task, then get an exact completion wherever they still hold more than one component. Their sets are joined
on their rarest shingles: in an order by frequency, two sets that are alike enough share a shingle among the first few of both, whose places bound
the overlap. Copies that are not linked differ in rare shingles, so they don't meet and candidates grow with rows; rows of one component don't meet either.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing. Rows are nodes by their text: rows that
repeat a doc_id each get the component of their own text, and a row is kept if its doc_id is that component's least. A null doc_id links nothing, gets a null component and is kept;
very long texts and ties need no rule of their own; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext as vt
from .shared import materialize, table

VALUES, TREES, DEPTH = 128, 32, 12
#: Runs of so many classes give all their pairs; larger ones give neighbours, and the rest by rare shingles.
RUN = 48
#: Partners of each class that are verified first.
FIRST = 2
#: Shingles with counts that tasks look up in memory; more of them are joined instead, with the same result.
FREQUENT = 500_000
_STEPS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: For each value, the order in which filled values are looked for when it is empty.
_FILL = np.stack([np.random.default_rng(100 + i).permutation(VALUES) for i in range(VALUES)])
#: For each tree, the values it sorts by: four of its own, then eight of others.
_ORDER = np.stack([np.concatenate([np.arange(t * 4, t * 4 + 4), np.random.default_rng(500 + t).permutation(np.delete(np.arange(VALUES), range(t * 4, t * 4 + 4)))[:DEPTH - 4]]) for t in range(TREES)])


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles."""
    for lo, hi, data, offs in vt.slices(texts):
        data = vt.LOWER[data]
        starts, ends, doc = vt.words(data, offs)
        h = vt.hashes(data, starts, ends)
        spans = vt.text_spans(doc, hi - lo)
        runs = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for j in range(width if len(runs) else 0):
            runs += h[j:len(runs) + j] * _STEPS[j]
        runs = vt.mix(runs)
        for a, b in zip(spans[:-1].tolist(), spans[1:].tolist(), strict=True):
            if b - a >= width:
                found = np.sort(runs[a:b - width + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif b > a:
                yield vt.mix(np.array([(h[a:b] * _STEPS[:b - a]).sum(dtype=np.uint64) ^ np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted set: the least hash of each of VALUES bins; an empty bin takes that of the first filled bin in its own fixed order."""
    bins = (found >> np.uint64(57)).astype(np.int64)
    first = np.concatenate([[0], 1 + np.flatnonzero(bins[1:] != bins[:-1])])
    sig, filled = np.zeros(VALUES, np.uint64), np.zeros(VALUES, bool)
    sig[bins[first]], filled[bins[first]] = vt.mix(found[first]), True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _FILL[empty]
        sig[empty] = sig[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return sig


def _sign(width: int):
    def run(batches):
        for batch in batches:
            ids, n, k1, k2, sigs = batch.column(0), [], [], [], []
            for found in shingle_sets(batch.column(1), width):
                n.append(len(found))
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                k1.append(int.from_bytes(digest[:8], "little", signed=True))
                k2.append(int.from_bytes(digest[8:], "little", signed=True))
                sigs.append((signature(found) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "text_key", "n_shingles", "k1", "k2", "sig"])
    return run


KEYS = [f"v{i}" for i in range(DEPTH // 4)]


def _grow(batches):
    """Each class in each tree's order: every key holds four values, tie a spread of equal ones."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, VALUES).astype(np.uint64)
        for t in range(TREES):
            v = sig[:, _ORDER[t]]
            keys = [sum(v[:, 4 * part + j] << np.uint64(48 - 16 * j) for j in range(4)) for part in range(len(KEYS))]
            tie = vt.mix(ids.view(np.uint64) + _STEPS[t])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int8)), *(pa.array(k.view(np.int64)) for k in keys), pa.array(tie.view(np.int64)), pa.array(ids)], ["tree", *KEYS, "tie", "id"])


def _candidates(batches):
    """Over one range of the sorted trees: (a, b, null, true) for all pairs of small runs, (a, b, null, false) for neighbours in dense ones.
    Dense runs, and those at either end of a piece, name their members as (id, null, run, null); pieces of a run share its name."""
    rest: list[np.ndarray] = []

    def pairs(x: np.ndarray, y: np.ndarray, sure: bool):
        keep = x != y
        x, y = x[keep], y[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64()), pa.array(np.full(len(x), sure))], ["a", "b", "run", "sure"])

    def emit(rows: np.ndarray, begins: bool, ends: bool):
        ids = rows[:, -1]
        same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
        cuts = np.concatenate([[0], 1 + np.flatnonzero(~same), [len(rows)]])
        size = np.diff(cuts)
        run = np.repeat(np.arange(len(size)), size)
        dense = size > RUN
        for step in range(1, int(size[~dense].max(initial=1))):
            at = np.flatnonzero((run[step:] == run[:-step]) & ~dense[run[step:]])
            yield pairs(ids[at], ids[at + step], True)
        for step in (1, 2):
            # neighbours; those two apart only if they share more than the run does
            at = np.flatnonzero((run[step:] == run[:-step]) & dense[run[step:]])
            if step == 2:
                at = at[(rows[at, 2].view(np.uint64) >> np.uint64(48)) == (rows[at + 2, 2].view(np.uint64) >> np.uint64(48))]
            if len(at):
                yield pairs(ids[at], ids[at + step], False)
        named = dense.copy()
        named[0] |= begins
        named[-1] |= ends
        rows = rows[np.repeat(named, size)]
        if len(rows):
            name = vt.mix(vt.mix(rows[:, 0].astype(np.uint64)) ^ rows[:, 1].astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, -1]), pa.nulls(len(rows), pa.int64()), pa.array(name), pa.nulls(len(rows), pa.bool_())], ["a", "b", "run", "sure"])

    begins = True
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)], 1)
        if not len(rows):
            continue
        rows = np.concatenate([*rest, rows])
        last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        # an open run waits for its end; a long one is handed on in pieces of one name that overlap by a row
        if len(rows) - cut > 200_000:
            yield from emit(rows, begins, True)
            rest, begins = [rows[-1:]], True
        else:
            if cut:
                yield from emit(rows[:cut], begins, False)
                begins = False
            rest = [rows[cut:]]
    if rest:
        yield from emit(np.concatenate(rest), begins, True)


def likely(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures agree as often as those of sets at the threshold do but once in some 10**7 cases, and the sizes allow it."""
    x, y = (np.frombuffer(b"".join(v), np.uint16).reshape(-1, VALUES) for v in (a, b))
    # values that differ from each other come from different bins only
    bins = VALUES * -np.expm1(-np.minimum(na, nb) / VALUES)
    t = percent / 100
    need = np.where(np.minimum(na, nb) < 64, 0, t - 5.5 * np.sqrt(t * (1 - t) / bins))
    return ((x == y).mean(1) >= need) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _likely(percent: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = likely(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))
    return run


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _verify(width: int, percent: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                keep = [alike(x, y, percent) for x, y in zip(shingle_sets(part.column(2), width), shingle_sets(part.column(3), width), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def links(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(width, percent), "a long, b long")


def _stars(batches):
    """A star for each component of a piece of the edges, which is never larger than the piece."""
    def settle(x: np.ndarray, y: np.ndarray):
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        u, v, label = at[:len(x)], at[len(x):], np.arange(len(nodes))
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        out = label != np.arange(len(nodes))
        return nodes[out], nodes[label[out]]

    x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        x, y = (np.concatenate([v, batch.column(i).to_numpy(zero_copy_only=False)]) for i, v in enumerate((x, y)))
        if len(x) > 1_000_000:
            x, y = settle(x, y)
            if len(x) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
                x, y = x[:0], y[:0]
    if len(x):
        x, y = settle(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each node of the edges (a, b) the least id that it reaches. Pieces of the edges become stars first; labels spread to neighbours and jump to the label of their label; each round is a written table."""
    stars = edges.mapInArrow(_stars, "a long, b long")
    both = materialize(stars.select(F.col("a").alias("x"), F.col("b").alias("y")).union(stars.select("b", "a")), "edges")
    label = materialize(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "label")
    while True:
        near = both.join(label, both.y == label.id).groupBy("x").agg(F.min("component").alias("near"))
        step = label.join(near, label.id == near.x).select("id", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = label.select(F.col("id").alias("c"), F.col("component").alias("far"))
        new = step.join(jump, "c", "left").select("id", F.least("c", "far").alias("component"), "old")
        new = materialize(new, "label")
        label = new.select("id", "component")
        if not new.where("component < old").limit(1).count():
            return label


def _sets(width: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in shingle_sets(batch.column(3), width)], pa.binary())], ["id", "component", "n", "set"])
    return run


def _tally(batches):
    for batch in batches:
        if batch.num_rows:
            token, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "times"])


def _tokens(batches):
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([i] * (len(raw) // 8), pa.int64()), pa.array(np.frombuffer(raw, np.int64))], ["id", "token"])


def first_places(n: int, percent: int) -> tuple[int, int]:
    """How many of the rarest shingles of a set of n must be looked at: where its partner is no smaller, and where it is no larger."""
    return n + (-2 * percent * n // (100 + percent)) + 1, n + (-percent * n // 100) + 1


ENTRY = "token long, place int, short boolean, id long, component long, n long"


def _entries(percent: int):
    """Prefix entries of rows (id, component, n, tokens): tokens are the shared ones from rare to frequent; all others come before them."""
    def rows(ids, comps, sizes, tokens):
        out = []
        for i, c, n, x in zip(ids, comps, sizes, tokens, strict=True):
            small, most = first_places(n, percent)
            place = np.arange(n - len(x), max(n - len(x), min(n, most)))
            out.append((x[:len(place)].view(np.int64), place, place < small, np.full(len(place), i), np.full(len(place), c), np.full(len(place), n)))
        token, place, short, i, c, n = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(place.astype(np.int32)), pa.array(short), pa.array(i), pa.array(c), pa.array(n)], ["token", "place", "short", "id", "component", "n"])
    return rows


def _ranked_here(names: np.ndarray, times: np.ndarray, percent: int):
    """Prefix entries of rows (id, component, n, set) by counts in memory: names are sorted."""
    def order(raw: bytes) -> np.ndarray:
        x = np.frombuffer(raw, np.uint64)
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        x, t = x[names[at] == x], times[at[names[at] == x]]
        return x[np.lexsort((x.view(np.int64), t))]

    def run(batches):
        for batch in batches:
            if batch.num_rows and len(names):
                ids, comps, n, raw = (c.to_pylist() for c in batch.columns)
                yield _entries(percent)(ids, comps, n, [order(x) for x in raw])
    return run


def _ranked_lists(percent: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ids, comps, n, tokens = (c.to_pylist() for c in batch.columns)
                yield _entries(percent)(ids, comps, n, [np.array(x, np.int64) for x in tokens])
    return run


def prefixes(sets: DataFrame, percent: int, in_memory: int = FREQUENT) -> DataFrame:
    """Of each row (id, component, n, set) its rarest shingles, as far as a partner must share one, without those that no other row has."""
    shared = materialize(sets.select("set").mapInArrow(_tally, "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).where("times > 1"), "shared")
    if shared.count() <= in_memory:
        got = shared.toArrow()  # in_memory rows at most
        order = np.argsort(got["token"].to_numpy().view(np.uint64))
        return sets.mapInArrow(_ranked_here(got["token"].to_numpy().view(np.uint64)[order], got["times"].to_numpy()[order], percent), ENTRY)
    tokens = sets.select("id", "set").mapInArrow(_tokens, "id long, token long")
    lists = tokens.join(shared, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("l"))  # a list is no longer than its text
    return sets.drop("set").join(lists, "id").select("id", "component", "n", F.col("l.token").alias("tokens")).mapInArrow(_ranked_lists(percent), ENTRY)


def meet_by_rare(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows of different components that share an early shingle and may be alike enough by size and place.
    In each shingle's group the rows outside its largest component look for partners among all. What is joined on a shingle is written first, so that Spark can split the rows of a frequent one."""
    count = entries.groupBy("token", "component").agg(F.count("*").alias("k"))
    largest = count.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    largest = materialize(largest, "largest")
    x = entries.join(largest, "token").where("component <> largest").select("token", *(F.col(c).alias(f"x_{c}") for c in ("place", "short", "id", "component", "n")), "largest")
    x = materialize(x, "apart")
    before = (F.col("x_n") < F.col("n")) | ((F.col("x_n") == F.col("n")) & (F.col("x_id") < F.col("id")))
    once = (F.col("component") == F.col("largest")) | (F.col("x_id") < F.col("id"))
    sizes = 100 * F.least("x_n", "n") >= percent * F.greatest("x_n", "n")
    places = (100 + percent) * F.least(F.col("x_n") - F.col("x_place"), F.col("n") - F.col("place")) >= percent * (F.col("x_n") + F.col("n"))
    y = entries.withColumnRenamed("token", "t")
    met = x.join(y, (F.col("token") == F.col("t")) & (F.col("x_component") != F.col("component")) & once & F.when(before, F.col("x_short")).otherwise(F.col("short")) & sizes & places)
    return met.select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")).distinct()


def _verify_sets(percent: int):
    def run(batches):
        for batch in batches:
            keep = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def links_of_sets(sets: DataFrame, percent: int, in_memory: int = FREQUENT) -> DataFrame:
    """All links (a, b) between different components of rows (id, component, n, set)."""
    pairs = materialize(meet_by_rare(materialize(prefixes(sets, percent, in_memory), "prefixes"), percent), "rare")
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_verify_sets(percent), "a long, b long")


def placed_by(classes: DataFrame, found: DataFrame) -> DataFrame:
    """The classes with their components; one without links is its own."""
    return classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components (id, component) after further links (a, b): components of components."""
    if not more.limit(1).count():
        return found
    a, b = found.select(F.col("id").alias("a"), F.col("component").alias("a_of")), found.select(F.col("id").alias("b"), F.col("component").alias("b_of"))
    name = lambda c: F.coalesce(F.col(c + "_of"), F.col(c)).alias(c)
    whole = components(more.join(a, "a", "left").join(b, "b", "left").select(name("a"), name("b")).where("a <> b")).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    # a component that was a single row so far has no row in found
    every = found.join(whole, "component", "full")
    return materialize(every.select(F.coalesce("id", "component").alias("id"), F.coalesce("whole", "component").alias("component")).distinct(), "components")


def grouped(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_key, n_shingles, whole (the number of its component; null without shingles or doc_id), component_id."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))
    signed = materialize(docs.select("doc_id", "text", "text_key").mapInArrow(_sign(width), "doc_id long, text_key long, n_shingles long, k1 long, k2 long, sig binary"), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n"))
    # the numbers are written, so they stay
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "rep.doc_id", "rep.text_key", "sig", "n", "k1", "k2"), "classes")
    trees = classes.select("id", "sig").mapInArrow(_grow, f"tree byte, {', '.join(k + ' long' for k in KEYS)}, tie long, id long")
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", *KEYS, "tie"]
    ordered = trees.repartitionByRange(shuffles, *order).sortWithinPartitions(*order)
    # a pair of similarity 0.8 meets in at least two of the trees but once in about 10**6
    met = materialize(ordered.mapInArrow(_candidates, "a long, b long, run long, sure boolean").groupBy("a", "b", "run").agg(F.count("*").alias("trees"), F.bool_or("sure").alias("sure")), "pairs")
    pairs, dense = met.where("run is null").select("a", "b", "trees", "sure"), met.where("run is not null").select("run", F.col("a").alias("id"))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(dense.select("id")).distinct().join(classes.select("id", "doc_id", "text_key"), "id")
    texts = materialize(docs.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("id", "text"), "texts")
    best = Window.partitionBy("x").orderBy(F.desc("trees"), "y")
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "trees").union(pairs.select("b", "a", "trees"))
    first = both.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= FIRST).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = components(materialize(links(texts, first, width, percent), "links"))
    # what the first round left: pairs of two components. Sure pairs inside mixed runs are left to the completion, neighbours join most of what belongs together before it
    placed = placed_by(classes, found)
    runs = dense.join(placed.select("id", "component"), "id")
    mixed = materialize(runs.groupBy("run").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("run"), "mixed_runs")
    inside = materialize(runs.join(mixed, "run").select("id").distinct(), "mixed")
    placed = placed.join(inside.withColumn("mixed", F.lit(True)), "id", "left").select("id", "n", "sig", "component", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    side = lambda s: placed.select(*(F.col(c).alias(c + s) for c in placed.columns))
    rest = pairs.join(side("_a"), F.col("a") == F.col("id_a")).join(side("_b"), F.col("b") == F.col("id_b")).where("component_a <> component_b and not (sure and mixed_a and mixed_b)")
    rest = materialize(rest.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(_likely(percent), "a long, b long"), "rest")
    found = merged(found, materialize(links(texts, rest, width, percent), "links"))
    sets = inside.join(placed_by(classes, found).select("id", "component", "n"), "id").join(texts, "id").select("id", "component", "n", "text")
    sets = materialize(sets.mapInArrow(_sets(width), "id long, component long, n long, set binary"), "sets")
    found = merged(found, materialize(links_of_sets(sets, percent), "links"))
    named = materialize(placed_by(classes, found).select("doc_id", "k1", "k2", F.col("component").alias("whole")), "named")
    named = named.join(materialize(named.groupBy("whole").agg(F.min("doc_id").alias("least")), "least"), "whole")
    out = signed.join(named.select("k1", "k2", "whole", "least"), ["k1", "k2"], "left")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "text_key", "n_shingles", F.when(own, F.col("whole")).alias("whole"), component.alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    return grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text and others) with one row of each group of near-duplicates: of its least doc_id, the text with the least hash. Rows without doc_id or words all stay."""
    rows = grouped(docs, width, percent)
    texts = materialize(rows.where("whole is not null").groupBy("whole", "doc_id", "text_key").agg(F.count("*").alias("rows")), "texts")
    stays = materialize(texts.groupBy("whole").agg(F.min(F.struct("doc_id", "text_key")).alias("one")), "stays")
    # only what goes, and what stays but is there more than once, meets the documents
    odd = texts.join(stays, "whole").withColumn("goes", F.struct("doc_id", "text_key") != F.col("one")).where("goes or rows > 1").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "goes")
    every = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64(F.col("text").cast("string")).alias("_k"))
    met = every.join(odd, (F.col("_d") == F.col("_doc")) & (F.col("_k") == F.col("_key")), "left").where("goes is null or not goes")
    # rows that are there once have a number of their own
    met = met.withColumn("_n", F.when(F.col("goes").isNull(), F.monotonically_increasing_id())).dropDuplicates(["_d", "_k", "_n"])
    return met.select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of whole documents on 4-word shingles at 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


QUERIES = {"op4_minhash_forest": op4_minhash_forest}
ORACLE: dict[str, str] = {}

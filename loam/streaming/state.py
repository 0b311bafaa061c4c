"""Keyed state of streams: rows of a key in the order of their time, and answers that expire.

Both run as transformWithStateInPandas on RocksDB, so state is bounded by disk and is recovered from the checkpoint when an executor is lost.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that a snapshot, a checked link and a catalogue stay good.
SNAPSHOT_S, LINK_S, CATALOGUE_S = 300, 600, 3600


def _on_rocks(spark: SparkSession) -> None:
    """State with several variables needs RocksDB; a store that a session has chosen itself stays."""
    if "RocksDB" not in (spark.conf.get(_STORE, "") or ""):
        spark.conf.set(_STORE, _ROCKS)


class _InOrder(StatefulProcessor):
    """Rows wait in list state until the watermark has passed them, the rows of a batch as one element of arrays; a timer then settles them in order into the value state. A key is read and written once a batch."""

    def __init__(self, key: str, values: list[str], kinds: str, state: str, start: tuple, step: Callable[[tuple, tuple], tuple]):
        self.key, self.values, self.kinds, self.state, self.start, self.step = key, values, kinds, state, start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", self.state)
        self.waiting = handle.getListState("waiting", self.kinds)

    def _so_far(self) -> tuple:
        found = self.settled.get()
        return self.start if found is None else tuple(found)

    def _waiting(self) -> dict[tuple, tuple]:
        """Rows by time and order; of rows that agree in both the one that came last."""
        held: dict[tuple, tuple] = {}
        for at, nth, *values in self.waiting.get():
            held.update(zip(zip(at, nth, strict=True), zip(at, *values, strict=True), strict=True))
        return held

    @staticmethod
    def _element(rows: dict[tuple, tuple]) -> tuple:
        return (*map(list, zip(*rows, strict=True)), *map(list, list(zip(*rows.values(), strict=True))[1:]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: dict[tuple, tuple] = {}
        for frame in rows:
            if frame.empty:  # a key that only has a timer to run
                continue
            at, nth, *values = (frame[c].tolist() for c in ("event_at", "event_nth", *self.values))
            at = [int(x) for x in at]
            came.update(zip(zip(at, map(int, nth), strict=True), zip(at, *values, strict=True), strict=True))
        if not came:
            return
        # a millisecond is not before any time within it
        self.handle.registerTimer(-(-max(came)[0] // 1000))
        held = self._waiting()
        fresh = {k: row for k, row in came.items() if held.get(k) != row}
        if fresh:
            self.waiting.appendValue(self._element(fresh))
        state = self._so_far()
        for _, row in sorted((held | fresh).items()):
            state = self.step(state, row)
        yield pd.DataFrame([(key[0], *state)], columns=[self.key, *(f.split()[0] for f in self.state.split(", "))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held, state = self._waiting(), self._so_far()
        for _, row in sorted((k, row) for k, row in held.items() if k[0] <= upto):
            state = self.step(state, row)
        left = {k: row for k, row in held.items() if k[0] > upto}
        if left:
            self.waiting.put([self._element(left)])
        else:
            self.waiting.clear()
        self.settled.update(state)
        yield from ()  # what the batch of the rows gave out holds them already

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, ts: str, order: str, values: dict[str, Column], state: str, start: tuple, step: Callable[[tuple, tuple], tuple], late: str = "2 days") -> DataFrame:
    """(key, state) for each key of a batch: step(state, (time in microseconds, *values)) over all rows of the key so far, by time and then order, however they came within `late`.
    Rows that the watermark has passed are settled and leave the state; later ones are dropped by Spark; rows that agree in key, time and order count once."""
    _on_rocks(stream.sparkSession)
    rows = stream.select(F.col(key), F.col(ts).cast("timestamp").alias("event_time"), F.col(order).cast("long").alias("event_nth"), *(v.alias(k) for k, v in values.items())).withWatermark("event_time", late)
    rows = rows.withColumn("event_at", F.unix_micros("event_time"))
    kinds = ", ".join(f"{to} array<{dict(rows.dtypes)[c]}>" for to, c in {"at": "event_at", "nth": "event_nth", **{k: k for k in values}}.items())
    processor = _InOrder(key, list(values), kinds, state, start, step)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {dict(stream.dtypes)[key]}, {state}", "Update", "EventTime")


def _streak(state: tuple, row: tuple) -> tuple:
    now = state[0] + 1 if row[1] else 0
    return now, max(state[1], now)


def streaks(stream: DataFrame, key: str, ts: str, order: str, failed: Column, late: str = "2 days") -> DataFrame:
    """(key, now, longest): the run of failures that a key is in and its longest one so far."""
    return in_order(stream, key, ts, order, {"failed": F.coalesce(failed, F.lit(False))}, "now long, longest long", (0, 0), _streak, late)


def expiring(stream: DataFrame, key: str, ts: str, order: str, ttl_s: float = SNAPSHOT_S, late: str = "2 days") -> DataFrame:
    """(key, until, hits, misses): what a cache with a time to live would have answered. A request is a hit while what the last miss fetched is less than ttl_s old; a hit doesn't renew it. until is in microseconds."""
    long = int(ttl_s * 1_000_000)

    def step(state: tuple, row: tuple) -> tuple:
        until, hits, misses = state
        return (until, hits + 1, misses) if row[0] < until else (row[0] + long, hits, misses + 1)
    return in_order(stream, key, ts, order, {}, "until long, hits long, misses long", (-(1 << 62), 0, 0), step, late)


class _Answers(StatefulProcessor):
    def __init__(self, key: str, asked: str, fetch: Callable[[str], str], ttl_s: float):
        self.key, self.asked, self.fetch, self.ttl_s = key, asked, fetch, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("answers", "asked string", "answer string", ttlDurationMs=int(self.ttl_s * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if frame.empty:
                continue
            out = []
            for asked in frame[self.asked]:
                hit, answer, error = bool(self.known.containsKey((asked,))), None, None
                if hit:
                    answer = self.known.getValue((asked,))[0]
                else:
                    try:
                        answer = self.fetch(asked)
                        self.known.updateValue((asked,), (answer,))
                    except Exception as e:  # noqa: BLE001  a failed fetch is told in its row and isn't kept
                        error = f"{type(e).__name__}: {e}"
                out.append((key[0], asked, answer, hit, error))
            yield pd.DataFrame(out, columns=[self.key, self.asked, "answer", "hit", "error"]).astype({"answer": object, "error": object})

    def close(self) -> None:
        pass


def answers(stream: DataFrame, key: str, asked: str, fetch: Callable[[str], str], ttl_s: float = LINK_S) -> DataFrame:
    """(key, asked, answer, hit, error) for each row that asks: an answer is fetched once and kept in the key's state for ttl_s seconds of the clock, then forgotten by the store.
    key deals the work; rows that ask the same must share it. As the clock moves without rows, the stream ends by itself only where batches without rows are turned off."""
    _on_rocks(stream.sparkSession)
    kinds = dict(stream.dtypes)
    return stream.select(key, asked).groupBy(key).transformWithStateInPandas(_Answers(key, asked, fetch, ttl_s), f"{key} {kinds[key]}, {asked} string, answer string, hit boolean, error string", "Update", "ProcessingTime")


"""Streams with state of their own: ops that wait for their entity, and notifications that are told together.

Both need Spark's RocksDB state store (start them within ``rocksdb``); their state is a few rows for each open key, and it outlives a
restart with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contentlake.operators.delivery import WINDOW_MS

OP = "field string, val double, lamport long, device_id string, seq long"
RELEASED = f"entity_id long, {OP}, tries int"
COLUMNS = [c.split()[0] for c in OP.split(", ")]


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that these streams need, for those that start within."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


class Parking(StatefulProcessor):
    """Ops of an entity that hasn't arrived are parked; the entity's row releases them, and later ops pass at once. ``tries`` counts
    how often a parked entity was asked for in vain: by a batch with ops of it, and, where ``retry_ms`` is given, by a timer that
    waits longer each time. An entity's own state is one small row."""

    def __init__(self, retry_ms: int | None = None):
        self.retry_ms = retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parked = handle.getListState("parked", OP)
        self.known = handle.getValueState("known", "arrived boolean, tries int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        arrived, tries = self.known.get() if self.known.exists() else (False, 0)
        came, ops = False, []  # one batch's rows of one entity
        for r in rows:
            if r["kind"] == "op":
                ops.append(tuple(r[c] for c in COLUMNS))
            else:
                came = True
        if arrived:
            yield from self._released(key, ops, 0)
            return
        if came:
            yield from self._released(key, self.parked.get() if self.parked.exists() else [], tries)
            self.parked.clear()
            self.known.update((True, tries))
            if self.retry_ms:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            yield from self._released(key, ops, 0)
            return
        if self.retry_ms and not self.known.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)
        self.known.update((False, tries + 1))
        self.parked.appendList(ops)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        _, tries = self.known.get()
        self.known.update((False, tries + 1))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms * 2 ** min(tries + 1, 6))
        return iter(())

    def close(self) -> None:
        pass

    def _released(self, key, ops: Iterable[tuple], tries: int) -> Iterator[Row]:
        for op in ops:
            yield Row(entity_id=key[0], **dict(zip(COLUMNS, op, strict=True)), tries=tries)


def released(ops: DataFrame, entities: DataFrame, retry_ms: int | None = None) -> DataFrame:
    """Ops (entity_id, field, val, lamport, device_id, seq) whose entity (entity_id) has arrived, each when both are there, and
    how often it was asked for in vain. Both are streams, in any order. With ``retry_ms`` the stream runs on by its timers: it
    isn't one for a trigger that ends when all is read."""
    columns = ["entity_id", *(c.split()[0] for c in OP.split(", "))]
    kinds = dict(c.split() for c in OP.split(", "))
    rows = ops.select(*columns, F.lit("op").alias("kind"))
    arrivals = entities.select("entity_id", *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()), F.lit("entity").alias("kind"))
    return rows.unionByName(arrivals).groupBy("entity_id").transformWithState(Parking(retry_ms), RELEASED, "Append", "ProcessingTime" if retry_ms else "None")


BUCKET = "key string, bucket long, count long, first_ts_ms long, first_pos long"


class Coalescing(StatefulProcessor):
    """A bucket opens with a key's first notification and takes those within the window of its first time; it is told when a later
    one opens the next, or when event time has passed its end. The state is one row for each key: its open bucket, or the last number."""

    def __init__(self, window_ms: int = WINDOW_MS):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "bucket long, count long, first_ts_ms long, first_pos long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0] is None:
            return  # a tick, which only moves the time
        bucket, count, first, place = self.open.get() if self.open.exists() else (0, 0, 0, 0)
        closed = []
        fresh = pd.concat(list(rows)).sort_values("pos")  # one batch's rows of one key
        for pos, ts in zip(fresh["pos"].tolist(), fresh["ts_ms"].tolist(), strict=True):
            if count and abs(ts - first) <= self.window_ms:
                count += 1
                continue
            if count:
                closed.append((key[0], bucket, count, first, place))
            bucket, count, first, place = bucket + 1, 1, ts, pos
        self.open.update((bucket, count, first, place))
        self._wake(first + self.window_ms + 1)
        if closed:
            yield pd.DataFrame(closed, columns=[c.split()[0] for c in BUCKET.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bucket, count, first, place = self.open.get()
        if count and timerValues.getCurrentWatermarkInMs() > first + self.window_ms:
            self.open.update((bucket, 0, 0, 0))
            yield pd.DataFrame([(key[0], bucket, count, first, place)], columns=[c.split()[0] for c in BUCKET.split(", ")])

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)


def coalesced(rows: DataFrame, delay: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """Closed buckets of a stream of notifications (key, pos, ts_ms), in order of pos from batch to batch; times are out of
    order by ``delay`` at most. Rows without a key are ticks: they close what they are later than."""
    timed = rows.select("key", "pos", "ts_ms", F.timestamp_millis("ts_ms").alias("at")).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(Coalescing(window_ms), BUCKET, "Append", "EventTime")

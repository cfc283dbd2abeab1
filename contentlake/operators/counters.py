"""Counters that are kept up to date: unread counts moved by what a batch changes, and outcomes counted in passing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

OUTCOMES = ("applied", "ignored", "pending", "error")


def unread_changes(entries: DataFrame, state: DataFrame, writes: DataFrame) -> DataFrame:
    """(feed_id, unread): by how much a batch of writes (entry_id, is_read; one row an entry) moves each feed's count.

    Only rows of the batch meet the tables. An entry without a state row isn't unread; writes of unknown entries move nothing.
    """
    rows = writes.select("entry_id", F.col("is_read").alias("_now")).join(entries.select("entry_id", "feed_id"), "entry_id")
    rows = rows.join(state.select("entry_id", F.col("is_read").alias("_was")), "entry_id", "left")
    unread = lambda c: F.coalesce((~F.col(c)).cast("long"), F.lit(0))
    return rows.groupBy("feed_id").agg(F.sum(unread("_now") - unread("_was")).alias("unread")).filter("unread <> 0")


def folder_changes(changes: DataFrame, feeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(folder_id, unread): changes of feeds, carried to their folders and all above (``pairs``: a closure of folders)."""
    own = changes.join(feeds.select("feed_id", "folder_id"), "feed_id").groupBy("folder_id").agg(F.sum("unread").alias("unread"))
    return pairs.join(own, "folder_id").groupBy(F.col("ancestor").alias("folder_id")).agg(F.sum("unread").alias("unread"))


def moved(counts: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Counts after changes; a key without a count starts at 0."""
    return counts.select(key, "unread").unionByName(changes.select(key, "unread")).groupBy(key).agg(F.sum("unread").alias("unread"))


def observed(rows: DataFrame, name: str, column: str = "outcome", values: Sequence[str] = OUTCOMES) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that has the number of each value once they have been written: no pass of its own."""
    watch = Observation(name)
    return rows.observe(watch, *(F.count_if(F.col(column) == v).alias(v) for v in values)), watch


def observed_stream(rows: DataFrame, name: str, column: str = "outcome", values: Sequence[str] = OUTCOMES) -> DataFrame:
    """A stream whose progress carries the number of each value in each batch, for ``BatchCounts``."""
    return rows.observe(name, *(F.count_if(F.col(column) == v).alias(v) for v in values))


class BatchCounts(StreamingQueryListener):
    """Hands the observed counts of each batch to ``told`` (query id, batch, counts)."""

    def __init__(self, name: str, told: Callable[[str, int, dict], None]):
        self.name, self.told = name, told

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.told(str(event.progress.id), event.progress.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

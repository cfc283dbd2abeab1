"""Table functions for SQL: feeds that a page announces, buckets of notifications.

``register`` names them for a session: ``page_feeds(html, url)`` stands behind LATERAL, with a row's values;
``notification_buckets(TABLE(t) PARTITION BY key ORDER BY pos)`` takes a table with the columns key, pos and ts_ms, each key in order, and
gives them with their bucket's number; the state is one number.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from contentlake.operators.delivery import WINDOW_MS
from contentlake.sources import feeds


@udtf(returnType="candidate string, rank int")
class PageFeeds:
    """Addresses that a page announces as its feeds, best first; none for a null page."""

    def eval(self, html: str, url: str) -> Iterator[tuple[str, int]]:
        for rank, address in enumerate(feeds.discover(html or "", url or "")):
            yield address, rank


@udtf
class NotificationBuckets:
    """The table's columns and ``bucket``. A bucket opens with a key's first row and takes those within the window of its first time."""

    def __init__(self):
        self.first, self.bucket = None, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, window_ms: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable or not {"key", "pos", "ts_ms"} <= set(table.dataType.names):
            raise ValueError("notification_buckets takes a table with the columns key, pos and ts_ms")
        return AnalyzeResult(StructType([*table.dataType.fields]).add("bucket", LongType()))

    def eval(self, row: Row, window_ms: int = WINDOW_MS) -> Iterator[tuple]:
        if self.first is None or abs(row["ts_ms"] - self.first) > window_ms:
            self.first, self.bucket = row["ts_ms"], self.bucket + 1
        yield (*row, self.bucket)


def register(spark: SparkSession) -> list[str]:
    functions = {"page_feeds": PageFeeds, "notification_buckets": NotificationBuckets}
    for name, function in functions.items():
        spark.udtf.register(name, function)
    return sorted(functions)

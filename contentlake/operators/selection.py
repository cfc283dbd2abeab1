"""Selections: a declarative question, compiled to one DataFrame plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlake.operators import search
from contentlake.operators.tree import descendants, values

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Selection:
    """All given conditions hold together; folders and feeds are one condition, a union. None means unset."""

    entry_ids: Sequence[int] | None = None
    feed_ids: Sequence[str] | None = None
    folder_ids: Sequence[str] | None = None
    tags: Sequence[str] | None = None
    query: str | None = None
    unread_only: bool = False
    starred_only: bool = False
    since_ms: int | None = None
    until_ms: int | None = None
    limit: int | None = None
    offset: int = 0


def select_entries(archive, wanted: Selection) -> DataFrame:
    """Entries with their state, newest first, ties by id.

    Entries without a state row don't appear. A folder without feeds selects nothing. Tags match once, however many
    of them an entry has; tombstones don't count. Ids become filters that reach the scan; folders and tags are
    semi-joins; the page is a top-k, so no full sort is done.
    """
    rows = archive.entries
    if wanted.entry_ids is not None:
        rows = rows.filter(F.col("entry_id").isin(list(wanted.entry_ids)))
    if wanted.since_ms is not None:
        rows = rows.filter(F.col("published_at_ms") >= wanted.since_ms)
    if wanted.until_ms is not None:
        rows = rows.filter(F.col("published_at_ms") <= wanted.until_ms)
    if wanted.folder_ids is not None:
        feeds = archive.feeds.join(descendants(archive.folders, list(wanted.folder_ids)), "folder_id", "left_semi").select("feed_id")
        if wanted.feed_ids is not None:
            feeds = feeds.union(values(archive.spark, wanted.feed_ids, "feed_id"))
        rows = rows.join(feeds, "feed_id", "left_semi")
    elif wanted.feed_ids is not None:
        rows = rows.filter(F.col("feed_id").isin(list(wanted.feed_ids)))
    if wanted.tags is not None:
        tagged = archive.entry_tags.filter(~F.col("deleted") & F.col("tag").isin(list(wanted.tags)))
        rows = rows.join(tagged, "entry_id", "left_semi")
    if wanted.query is not None:
        rows = rows.join(search.match(archive, wanted.query), "entry_id", "left_semi")
    state = archive.entry_state
    if wanted.unread_only:
        state = state.filter(~F.col("is_read"))
    if wanted.starred_only:
        state = state.filter("starred")
    rows = rows.join(state, "entry_id")
    if wanted.limit is not None or wanted.offset:
        rows = rows.orderBy(F.desc("published_at_ms"), "entry_id")
        if wanted.offset:
            rows = rows.offset(wanted.offset)
        if wanted.limit is not None:
            rows = rows.limit(wanted.limit)
    return rows


@dataclass(frozen=True)
class SavedSearch:
    """A named selection with a window of days that slides with ``now_ms``."""

    name: str
    selection: Selection
    days: int | None = None

    def at(self, now_ms: int) -> Selection:
        return self.selection if self.days is None else replace(self.selection, since_ms=now_ms - self.days * DAY_MS)


def next_page(rows: DataFrame, last_published_ms: int, last_id: int, limit: int) -> DataFrame:
    """The page after a known last row: a range condition instead of an offset."""
    older = (F.col("published_at_ms") < last_published_ms) | ((F.col("published_at_ms") == last_published_ms) & (F.col("entry_id") > last_id))
    return rows.filter(older).orderBy(F.desc("published_at_ms"), "entry_id").limit(limit)

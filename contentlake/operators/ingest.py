"""Ingest: identity, change detection, duplicates, merge, bookkeeping of feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60
WATCH_FLOOR = 1800
#: Keys of passages are sent to all tasks up to so many passages.
FEW = 500_000


def first_in_document(items: DataFrame) -> DataFrame:
    """Items of a parsed document without those whose guid an earlier one has."""
    order = Window.partitionBy("feed_id", "guid_hash").orderBy("pos")
    return items.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def classify(batch: DataFrame, archive: DataFrame) -> DataFrame:
    """Each incoming entry with ``action``: insert (its guid is new in its feed), update (other content) or skip."""
    known = archive.select("feed_id", "guid_hash", F.col("entry_id").alias("existing_id"), F.col("content_hash").alias("old_hash"))
    action = F.when(F.col("existing_id").isNull(), "insert").when(~F.col("content_hash").eqNullSafe(F.col("old_hash")), "update").otherwise("skip")
    return batch.join(known, ["feed_id", "guid_hash"], "left").withColumn("action", action).drop("old_hash")


def duplicates(entries: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """(entry_id, duplicate_of): the first other entry of another feed with the same content.

    Within one table an entry points to the smallest id of its content; all are kept. A content that very many
    entries share is a minimum per task before the shuffle.
    """
    base = entries if archive is None else archive
    first = base.filter("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min(F.struct("entry_id", "feed_id")).alias("f"))
    pairs = entries.join(first, "content_hash").filter((F.col("entry_id") != F.col("f.entry_id")) & (F.col("feed_id") != F.col("f.feed_id")))
    return pairs.select("entry_id", F.col("f.entry_id").alias("duplicate_of"))


def merge(archive: DataFrame, classified: DataFrame) -> DataFrame:
    """The archive with inserts added and all content columns of updated entries replaced.

    There is no table format with MERGE here: the result is written beside the old table and swapped in.
    """
    columns = archive.columns
    fresh = classified.filter("action = 'insert'").select(*columns)
    changed = classified.filter("action = 'update'").select(F.col("existing_id").alias("entry_id"), *(c for c in columns if c != "entry_id")).select(*columns)
    kept = archive.join(changed.select("entry_id"), "entry_id", "left_anti").select(*columns)
    return kept.unionByName(changed).unionByName(fresh)


def refresh(archive: DataFrame, batch: DataFrame, hooks: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(new archive, classified batch) for one micro-batch; hooks transform new entries before they are merged."""
    classified = classify(first_in_document(batch), archive)
    for hook in hooks:
        classified = hook(classified)
    return merge(archive, classified), classified


def summary(classified: DataFrame) -> DataFrame:
    """Per feed: new, updated and skipped entries."""
    return classified.groupBy("feed_id").agg(*(F.count_if(F.col("action") == a).alias(n) for a, n in (("insert", "new"), ("update", "updated"), ("skip", "skipped"))))


def next_interval(current: Column, default: Column, errors: Column, changed: Column, watched: Column, most: int = 86_400, jitter: Column | None = None) -> Column:
    """Seconds until the next fetch: doubling after errors, halving after news, growing by half otherwise."""
    least = F.greatest(F.lit(MINUTE), default, F.when(watched, F.lit(WATCH_FLOOR)).otherwise(F.lit(0)))
    failed = least * F.pow(F.lit(2.0), F.least(errors - 1, F.lit(6)))
    calm = F.when(changed, F.greatest(least.cast("double"), current * 0.5)).otherwise(current * 1.5)
    wanted = F.when(errors > 0, failed).otherwise(calm)
    held = F.greatest(least.cast("double"), F.least(wanted, F.lit(float(most))))
    if jitter is not None:
        held = held * (1 + jitter)
    floor = F.when(watched, F.lit(float(WATCH_FLOOR))).otherwise(F.lit(float(MINUTE)))
    return F.floor(F.least(F.greatest(held, floor), F.lit(most * 1.1))).cast("long")


def bookkeeping(feeds: DataFrame, results: DataFrame, now_ms: int) -> DataFrame:
    """Feeds after a fetch: errors counted or reset, interval and next fetch moved, last error cut to 500 characters.

    results: feed_id, status (ok, not_modified, error), new (entries), error. Feeds without a result stay.
    """
    failed, fetched = F.col("status") == "error", F.col("status").isNotNull()
    errors = F.when(~fetched, F.col("error_count")).when(failed, F.col("error_count") + 1).otherwise(0)
    rows = feeds.join(results, "feed_id", "left").withColumn("_errors", errors)
    interval = next_interval(F.col("interval_s").cast("double"), F.col("default_s"), F.col("_errors"), F.coalesce("new", F.lit(0)) > 0, F.col("watched"))
    rows = rows.withColumn("interval_s", F.when(fetched, interval).otherwise(F.col("interval_s")))
    rows = rows.withColumn("next_fetch_ms", F.when(fetched, F.lit(now_ms) + F.col("interval_s") * 1000).otherwise(F.col("next_fetch_ms")))
    return rows.withColumn("last_error", F.when(failed, F.substring(F.coalesce("error", F.lit("")), 1, 500))).withColumn("error_count", F.col("_errors")).drop("_errors", "status", "new", "error")


def due(feeds: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Enabled live feeds whose time has come, longest waiting first."""
    ready = F.col("enabled") & ~F.col("deleted") & (F.coalesce("next_fetch_ms", F.lit(0)) <= now_ms)
    return feeds.filter(ready).orderBy("next_fetch_ms", "feed_id").limit(limit)


def fill_blanks(row: Column, channel: Column) -> Column:
    """A feed's own value if it has one, else the channel's."""
    return F.coalesce(F.nullif(row, F.lit("")), channel)


def changed_since_last(observations: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Observations that differ from the one before of their key; the first always counts."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return observations.withColumn("_before", before).filter(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def plausible_time(candidate: Column, fetched_ms: Column | int, ahead_ms: int = 86_400_000) -> Column:
    """A time after the epoch and at most a day ahead of the fetch; else the fetch's."""
    fetched = F.lit(fetched_ms) if isinstance(fetched_ms, int) else fetched_ms
    return F.when((candidate > 0) & (candidate <= fetched + ahead_ms), candidate).otherwise(fetched)


def syndicated(entries: DataFrame, passages: DataFrame, words: int = 8) -> DataFrame:
    """(entry_id, item_id) of entries that contain a whole passage of at least ``words`` words.

    Instead of comparing everything, both sides are keyed by windows of words: the passage's words from the second on,
    which stand between white space in any text that contains it, whatever touches its ends, must be a window of the
    entry. Only such pairs are compared in full. The passages' keys are sent to all tasks if they are few enough.
    """
    inner = words - 2
    split = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    p = passages.select("item_id", F.col("text").alias("passage"), split("text").alias("_w")).filter(F.size("_w") >= words)
    p = p.select("item_id", "passage", F.xxhash64(F.array_join(F.slice("_w", 2, inner), " ")).alias("k"))
    wanted = p.select("k").distinct()
    wanted = F.broadcast(wanted) if passages.count() <= FEW else wanted
    e = entries.select("entry_id", split("body_text").alias("_w")).filter(F.size("_w") >= inner)
    keys = F.transform(F.sequence(F.lit(1), F.size("_w") - (inner - 1)), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, inner), " ")))
    hits = e.select("entry_id", F.explode(F.array_distinct(keys)).alias("k")).join(wanted, "k", "left_semi").join(p, "k")
    return hits.join(entries.select("entry_id", "body_text"), "entry_id").filter(F.contains("body_text", "passage")).select("entry_id", "item_id").distinct()

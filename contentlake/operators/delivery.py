"""Notifications, batching and grouping for export."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_MS = 300_000


def coalesce_notifications(rows: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Bucket number of each notification (key, pos, ts_ms, ...), per key in order of arrival (pos).

    A bucket opens with the first notification; a later one joins if it lies within the window of the bucket's first
    time, earlier or later, else it opens the next. Unlike a session, a bucket doesn't stretch. The state is one
    number per key, so rows stream through a sorted partition: a key with very many rows is never held whole.
    """

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, bucket = None, 0, 0
        for batch in batches:
            out = []
            for k, ts in zip(batch["key"], batch["ts_ms"], strict=True):
                if k != key:
                    key, first, bucket = k, ts, 1
                elif abs(ts - first) > window_ms:
                    first, bucket = ts, bucket + 1
                out.append(bucket)
            yield batch.assign(bucket=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", bucket long"
    return rows.repartition("key").sortWithinPartitions("key", "pos").mapInPandas(assign, schema)


def merged_notifications(bucketed: DataFrame, lines: int = 5) -> DataFrame:
    """One row per bucket: count, first title and time, highest priority, tags in order, first lines and how many more."""
    # only the first lines and each tag's first row need to come together; the rest is counted
    rows = bucketed.withColumn("_place", F.row_number().over(Window.partitionBy("key", "bucket").orderBy("pos")))
    rows = rows.withColumn("_tag_place", F.row_number().over(Window.partitionBy("key", "bucket", "tag").orderBy("pos")))
    groups = rows.groupBy("key", "bucket").agg(
        F.count("*").alias("count"),
        F.min_by("title", "pos").alias("title"),
        F.min_by("ts_ms", "pos").alias("first_ts_ms"),
        F.max("priority").alias("priority"),
        F.sort_array(F.collect_list(F.when(F.col("_place") <= lines, F.struct("pos", "body")))).alias("items"),
        F.sort_array(F.collect_list(F.when(F.col("_tag_place") == 1, F.struct("pos", "tag")))).alias("tags"),
    )
    body = F.array_join(F.col("items.body"), "\n")
    more = F.when(F.col("count") > lines, F.concat(F.lit("\n… "), (F.col("count") - lines).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return groups.select("key", "bucket", "count", "title", "first_ts_ms", "priority", F.col("tags.tag").alias("tags"), F.concat(body, more).alias("body"))


def article_weight(text: Column, images: Column | int = 0) -> Column:
    """What an article adds to a mail, in bytes: text compresses, images don't."""
    return (F.octet_length(text) * 0.35).cast("long") + (F.lit(images) if isinstance(images, int) else images) + 2048


def mail_budget(limit: int, growth: float = 1.40, overhead: int = 65_536) -> int:
    return max(int(limit / growth) - overhead, 1)


def greedy_batches(rows: DataFrame, budget: int, by: str = "feed_id", order: tuple[str, ...] = ("pos",), weight: str = "weight") -> DataFrame:
    """Rows with ``batch``: in order, a batch ends before the row that would take it over the budget.

    A batch holds at least one row. State is two numbers per group, and rows stream through sorted partitions.
    """

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, batch = None, 0, 0
        for frame in batches:
            out = []
            for g, w in zip(frame[by], frame[weight], strict=True):
                if g != group:
                    group, held, batch = g, w, 1
                elif held + w > budget:
                    held, batch = w, batch + 1
                else:
                    held += w
                out.append(batch)
            yield frame.assign(batch=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch long"
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInPandas(assign, schema)


def halve(count: int, size_of, limit: int, depth: int = 8) -> list[tuple[int, int]]:
    """Ranges of items to send, halved while one is too large; a single item is sent anyhow."""

    def split(a: int, b: int, left: int) -> list[tuple[int, int]]:
        if b - a <= 1 or left == 0 or size_of(a, b) <= limit:
            return [(a, b)]
        middle = (a + b) // 2
        return split(a, middle, left - 1) + split(middle, b, left - 1)

    return split(0, count, depth) if count else []


def halved(rows: DataFrame, limit: int, by: str = "feed_id", order: str = "pos", weight: str = "weight", depth: int = 8) -> DataFrame:
    """Rows with ``part``: a group over the limit is cut in the middle, and so are its halves, ``depth`` times at most; a
    single row goes anyhow.

    Each round tells by sums which parts to cut, so nothing but sums of a part meets in one task. A part's name is its
    path of halves. Rows need their place in the group (from 0) as ``order``.
    """
    rows = rows.withColumns({"part": F.lit(""), "_at": F.col(order).cast("long")})
    for _ in range(depth):
        large = rows.groupBy(by, "part").agg(F.sum(weight).alias("_w"), F.min("_at").alias("_a"), F.count("*").alias("_n")).filter((F.col("_w") > limit) & (F.col("_n") > 1))
        cut = large.select(by, "part", (F.col("_a") + F.floor(F.col("_n") / 2)).alias("_middle"))
        half = F.when(F.col("_middle").isNull(), F.lit("")).when(F.col("_at") < F.col("_middle"), F.lit("a")).otherwise(F.lit("b"))
        rows = rows.join(cut, [by, "part"], "left").withColumn("part", F.concat("part", half)).drop("_middle")
    return rows.drop("_at")


def sections(picked: DataFrame, title: Column) -> DataFrame:
    """Section order (by lower-cased name) and place in it (newest first) of picked entries; nameless ones last name Others."""
    name = F.coalesce(F.nullif(title, F.lit("")), F.lit("Others"))
    rows = picked.withColumn("section", name)
    names = rows.select("section").distinct().withColumn("section_no", F.row_number().over(Window.orderBy(F.lower("section"), "section")))  # a row per section
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("published_at_ms"), "entry_id"))
    return rows.withColumn("place", place).join(names, "section")


def numbered_stems(rows: DataFrame, stem: str = "stem", order: tuple[str, ...] = ("published_at_ms", "entry_id")) -> DataFrame:
    """File names: the stem for its first entry, then stem-2, stem-3 and so on."""
    n = F.row_number().over(Window.partitionBy(stem).orderBy(*order))
    return rows.withColumn("_n", n).withColumn("file_name", F.when(F.col("_n") == 1, F.col(stem)).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def next_unread(rows: DataFrame, by: str, order: tuple[str, ...], read: str = "is_read", id_col: str = "entry_id") -> DataFrame:
    """Each row with the id of the next unread one after it."""
    after = Window.partitionBy(by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("next_unread_id", F.first(F.when(~F.col(read), F.col(id_col)), ignorenulls=True).over(after))


def claim(jobs: DataFrame) -> DataFrame:
    """The oldest pending job of each target, as running."""
    first = jobs.filter("status = 'pending'").groupBy("target").agg(F.min_by(F.struct(*jobs.columns), F.struct("created_ms", "job_id")).alias("j"))
    return first.select("j.*").withColumn("status", F.lit("running"))


def union_ids(explicit: DataFrame, selected: DataFrame) -> DataFrame:
    """Explicit ids in their order, then selected ones that aren't among them: (entry_id, pos)."""
    both = explicit.select("entry_id", F.lit(0).alias("part"), "pos").unionByName(selected.select("entry_id", F.lit(1).alias("part"), "pos"))
    return both.groupBy("entry_id").agg(F.min(F.struct("part", "pos")).alias("at")).select("entry_id", "at.part", "at.pos")

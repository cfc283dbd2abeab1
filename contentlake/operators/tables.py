"""Table changes as DataFrames: upserts, journal, outbox, bodies, tombstones.

Without a table format that merges, a change is a new DataFrame: write it beside the old table and swap it in
(``contentlake.sinks.exports.swap_in``), or append it where a table only grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges within which a batch of changes is numbered.
PARTS = 64


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows, with rows of a key that ``new`` has replaced by those."""
    return old.join(new.select(*key), list(key), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def fan_out(entries: DataFrame) -> dict[str, DataFrame]:
    """What a batch of new entries adds to each table: metadata, bodies, and the default state."""
    return {
        "entries": entries.drop("body_html", "body_text"),
        "entry_bodies": entries.select("entry_id", *(c for c in ("body_html", "body_text") if c in entries.columns)),
        "entry_state": entries.select("entry_id", F.lit(False).alias("is_read"), F.lit(False).alias("starred")),
    }


def journal(changes: DataFrame, device: str, clock: int, last_seq: int, now_ms: int) -> DataFrame:
    """Changes (entity_id, field, val, pos) as rows of the change log: each ticks the clock and takes the next seq.

    Numbers follow pos. Changes are numbered within ranges of it, after how many lie in the ranges before.
    """
    edges = sorted(set(changes.approxQuantile("pos", [k / PARTS for k in range(1, PARTS)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("pos"))) if edges else F.lit(0)
    rows = changes.withColumn("_part", part)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))  # a row per range
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy("pos"))).join(F.broadcast(starts), "_part")
    n = F.col("_before") + F.col("_place")
    return rows.select((F.lit(last_seq) + n).cast("long").alias("seq"), F.lit(device).alias("device_id"), (F.lit(clock) + n).cast("long").alias("lamport"), "entity_id", "field", "val", F.lit(now_ms).alias("ts_ms"))


def acknowledged(outbox: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The outbox without what the hub has confirmed."""
    return outbox.join(confirmed.select("seq"), "seq", "left_anti")


def replace_bodies(bodies: DataFrame, fetched: DataFrame, now_ms: int) -> DataFrame:
    """Bodies (entry_id, body_text, full_text_at) with longer fetched texts in place of shorter ones."""
    rows = bodies.join(fetched.select("entry_id", F.col("body_text").alias("_new")), "entry_id", "left")
    better = F.length("_new") > F.coalesce(F.length("body_text"), F.lit(0))
    return rows.select("entry_id", F.when(better, F.col("_new")).otherwise(F.col("body_text")).alias("body_text"), F.when(better, F.lit(now_ms)).otherwise(F.col("full_text_at")).alias("full_text_at"))


def missing_bodies(page: DataFrame, bodies: DataFrame) -> DataFrame:
    """Entries of a page whose body isn't here yet: what a read-through cache has to fetch."""
    return page.join(bodies.filter("body_text IS NOT NULL").select("entry_id"), "entry_id", "left_anti")


def mark_read(page: DataFrame) -> DataFrame:
    """A write per loaded row, read or not."""
    return page.select(F.col("entry_id").alias("entity_id"), F.lit("read").alias("field"), F.lit("true").alias("val"), F.col("entry_id").alias("pos"))


def tombstoned(rows: DataFrame, gone: Column) -> DataFrame:
    """Soft delete: rows stay, marked."""
    return rows.withColumn("deleted", F.coalesce("deleted", F.lit(False)) | F.coalesce(gone, F.lit(False)))


def ready(parked: DataFrame, arrived: DataFrame) -> DataFrame:
    """Parked ops whose entry has arrived: the op's id is the entry's, or the entry's with ``:`` and a tag."""
    entry = F.split_part("entity_id", F.lit(":"), F.lit(1))
    return parked.withColumn("entry_id", entry).join(arrived.select("entry_id"), "entry_id", "left_semi").drop("entry_id")


def emptied(rows: DataFrame) -> DataFrame:
    """A replica's table after a wipe: its columns, no rows."""
    return rows.limit(0)


def wiped(replica: dict[str, DataFrame], device: str = "device", cursor: str = "last_seq") -> dict[str, DataFrame]:
    """A replica's tables after a wipe: all without rows but its own device's, whose pull cursor starts anew."""
    return {name: rows.withColumn(cursor, F.lit(0).cast(rows.schema[cursor].dataType)) if name == device else emptied(rows) for name, rows in replica.items()}

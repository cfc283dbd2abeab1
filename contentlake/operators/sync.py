"""Replication: change logs, last-writer-wins, scopes, deltas, snapshots, compaction, clocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentlake.operators.tree import descendants, values

DAY_MS = 86_400_000
KEY = ("entity_id", "field")


def clock(*more: str) -> Column:
    """Order of writes: the larger Lamport time, then the larger device id; at equal clocks the first one stays."""
    return F.struct("lamport", "device_id", -F.col("seq"), *more)


def resolve(ops: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The winning write of each key: key columns, val, lamport, device_id, seq.

    A maximum is summed up before the shuffle, so a key with very many writes is one row per task.
    """
    best = F.max(clock("val")).alias("w")
    return ops.groupBy(*key).agg(best).select(*key, F.col("w.val").alias("val"), "w.lamport", "w.device_id", (-F.col("w.col3")).alias("seq"))


def state_rows(ops: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row per entity with a column per field, by last writer; null where a field was never written."""
    picks = [F.max(F.when(F.col("field") == f, clock("val"))).getField("val").alias(f) for f in fields]
    return ops.groupBy("entity_id").agg(*picks)


def element_set(ops: DataFrame) -> DataFrame:
    """Live (entity_id, field) elements of a set whose writes say whether the element is deleted (val)."""
    return resolve(ops).filter(~F.col("val").cast("boolean")).select(*KEY)


def outcomes(ops: DataFrame, entities: DataFrame, fields: Sequence[str], applied: DataFrame | None = None) -> DataFrame:
    """Each op with its outcome: error (unknown field), pending (unknown entity), ignored (its clock loses), applied.

    An op loses to any earlier one of its key with the same or a larger clock, and to ``applied`` (a resolved
    state), if given.
    """
    before = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.struct("lamport", "device_id")
    known = entities.select(F.col("entity_id").alias("known_id")).distinct()
    rows = ops.join(known, F.col("entity_id") == F.col("known_id"), "left")
    valid = F.col("field").isin(list(fields)) & F.col("known_id").isNotNull()
    best = F.max(F.when(valid, mine)).over(before)
    rows = rows.withColumn("best", best)
    if applied is not None:
        held = applied.select(*KEY, F.struct("lamport", "device_id").alias("held"))
        rows = rows.join(held, list(KEY), "left").withColumn("best", F.greatest("best", "held")).drop("held")
    outcome = (
        F.when(~F.col("field").isin(list(fields)), "error")
        .when(F.col("known_id").isNull(), "pending")
        .when(F.col("best").isNotNull() & (mine <= F.col("best")), "ignored")
        .otherwise("applied")
    )
    return rows.withColumn("outcome", outcome).drop("known_id", "best")


def parked(ops: DataFrame, entities: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Valid ops whose entity isn't known yet, each once (by key and clock)."""
    orphans = ops.filter(F.col("field").isin(list(fields))).join(entities.select("entity_id").distinct(), "entity_id", "left_anti")
    return orphans.groupBy(*KEY, "lamport", "device_id").agg(F.min("seq").alias("seq"), F.min_by("val", "seq").alias("val"))


def replay(pending: DataFrame, arrived: DataFrame, state: DataFrame) -> DataFrame:
    """State after the parked ops of arrived entities have been applied to it: the winners per key."""
    ready = pending.join(arrived.select("entity_id").distinct(), "entity_id", "left_semi")
    columns = [*KEY, "val", "lamport", "device_id", "seq"]
    return resolve(ready.select(*columns).unionByName(state.select(*columns)))


@dataclass(frozen=True)
class Scope:
    """What a device keeps: feeds (of folders, with all below, and given ones; None: all), and which entries."""

    days: int | None = None
    include_starred: bool = True
    include_unread: bool = True
    folder_ids: Sequence[str] | None = None
    feed_ids: Sequence[str] | None = None
    max_entries: int | None = 5000  # None: all


def scope_feeds(archive, scope: Scope) -> DataFrame | None:
    """feed_id in scope; None if all are."""
    if scope.folder_ids is None and scope.feed_ids is None:
        return None
    feeds = values(archive.spark, scope.feed_ids or [], "feed_id")
    if scope.folder_ids is not None:
        feeds = feeds.union(archive.feeds.join(descendants(archive.folders, list(scope.folder_ids)), "folder_id", "left_semi").select("feed_id"))
    return feeds.distinct()


def in_scope(archive, scope: Scope, now_ms: int, read: Column | None = None, starred: Column | None = None, more: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """Entries with ``in_scope``: the test of a single entry, where no state counts as unread and unstarred.

    ``read`` and ``starred`` replace the state's values, to ask what held before an op. ``more`` names further such
    tests, with their replacements, as columns of the same pass.
    """
    rows = archive.entries.join(archive.entry_state, "entry_id", "left")
    feeds = scope_feeds(archive, scope)
    rows = rows.withColumn("_in", F.lit(True)) if feeds is None else rows.join(feeds.withColumn("_in", F.lit(True)), "feed_id", "left")

    def test(read: Column | None = None, starred: Column | None = None) -> Column:
        hit = F.lit(scope.days is None)
        if scope.days is not None:
            hit = hit | (F.col("published_at_ms") >= now_ms - scope.days * DAY_MS)
        if scope.include_starred:
            hit = hit | (F.coalesce("starred", F.lit(False)) if starred is None else starred)
        if scope.include_unread:
            hit = hit | ~(F.coalesce("is_read", F.lit(False)) if read is None else read)
        return hit & F.coalesce("_in", F.lit(False))

    tests = {"in_scope": test(read, starred)} | {name: test(**given) for name, given in (more or {}).items()}
    return rows.withColumns(tests).drop("_in")


def scope_list(archive, scope: Scope, now_ms: int) -> DataFrame:
    """The ids of entries in scope; the newest ``max_entries`` if that is set.

    Here a missing state is neither read nor unread, and without days only the flags count.
    """
    rows = archive.entries.join(archive.entry_state, "entry_id", "left")
    feeds = scope_feeds(archive, scope)
    if feeds is not None:
        rows = rows.join(feeds, "feed_id", "left_semi")
    tests = []
    if scope.days is not None:
        tests.append(F.col("published_at_ms") >= now_ms - scope.days * DAY_MS)
    if scope.include_starred:
        tests.append(F.col("starred"))
    if scope.include_unread:
        tests.append(~F.col("is_read"))
    if tests:
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        rows = rows.filter(hit)
    rows = rows.select("entry_id", "published_at_ms")
    return rows if scope.max_entries is None else rows.orderBy(F.desc("published_at_ms"), "entry_id").limit(scope.max_entries)


def delta(archive, ops: DataFrame, scope: Scope, now_ms: int) -> DataFrame:
    """Ops that a device gets: those on its entries, and those that took an entry out of its scope.

    ``ops`` has entity ('entry' or a structural one), entity_id, field ('read', 'starred', other) and val. Structural
    ops and ops on unknown entries pass. A read or starred op also passes if its entry was in scope with that field's
    opposite.
    """
    unread, unstarred = ~F.coalesce("is_read", F.lit(False)), ~F.coalesce("starred", F.lit(False))
    rows = in_scope(archive, scope, now_ms, more={"read_in": {"read": unread}, "star_in": {"starred": unstarred}})
    base = rows.select(F.col("entry_id").alias("entity_id"), F.col("in_scope").alias("now_in"), "read_in", "star_in")
    rows = ops.join(base, "entity_id", "left")
    passes = (F.col("entity") != "entry") | F.col("now_in").isNull() | F.col("now_in") | ((F.col("field") == "read") & F.col("read_in")) | ((F.col("field") == "starred") & F.col("star_in"))
    return rows.filter(passes).select(*ops.columns)


def pull(ops: DataFrame, cursor: int, limit: int, device: str) -> DataFrame:
    """A page of the log after a cursor, without the device's own ops, with the next cursor and whether more follows.

    The page is cut before own ops go, so the cursor always moves on. One row more than the page tells of more.
    """
    ahead = ops.filter(F.col("seq") > cursor).orderBy("seq").limit(limit + 1)
    numbered = ahead.withColumn("place", F.row_number().over(Window.orderBy("seq")))  # limit + 1 rows
    whole = Window.partitionBy()
    page = numbered.withColumn("has_more", F.count("*").over(whole) > limit).filter(F.col("place") <= limit)
    page = page.withColumn("next_cursor", F.max("seq").over(whole))
    return page.filter(F.col("device_id") != device).drop("place")


def observe(ops: DataFrame, start: int = 0, by: str = "device_id") -> DataFrame:
    """The receiver's Lamport clock after each op of a stream: max(own, op's) + 1, per ``by``.

    Without a loop: after n ops it is n plus the larger of the start and the largest of (op i's clock - i + 1).
    """
    order = Window.partitionBy(by).orderBy("seq")
    n = F.row_number().over(order)
    rows = ops.withColumn("n", n)
    best = F.max(F.col("lamport") - F.col("n") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("local_clock", F.col("n") + F.greatest(F.lit(start), best)).drop("n")


def slowest_cursor(clients: DataFrame, ops: DataFrame, now_ms: int, expiry_days: int = 90) -> DataFrame:
    """One row, keep_seq: the least cursor of clients seen lately; the log's end if there is none."""
    live = clients.filter(F.col("last_seen_ms") >= now_ms - expiry_days * DAY_MS).agg(F.min("last_seq").alias("c"))
    return live.crossJoin(ops.agg(F.max("seq").alias("m"))).select(F.coalesce("c", "m").alias("keep_seq"))  # one row each


def compacted(ops: DataFrame, keep_seq: int, before_ms: int | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """The log without writes up to ``keep_seq`` (and before a time) that a later such write of their key replaces."""
    if keep_seq <= 0:
        return ops
    old = F.col("seq") <= keep_seq
    if before_ms is not None:
        old = old & (F.col("ts_ms") < before_ms)
    last = ops.filter(old).groupBy(*key).agg(F.max("seq").alias("seq")).select("seq")
    return ops.filter(~old).unionByName(ops.filter(old).join(last, "seq", "left_semi"))


def log_stats(ops: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Ops, first and last seq, distinct keys, and how many ops a compaction could remove."""
    keys = ops.groupBy(*key).agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    return keys.agg(F.sum("n").alias("ops"), F.min("lo").alias("min_seq"), F.max("hi").alias("max_seq"), F.count("*").alias("keys")).withColumn("compactable", F.greatest(F.coalesce(F.col("ops"), F.lit(0)) - F.col("keys"), F.lit(0)))


def snapshot_chunks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (entry_id, published_at_ms) numbered newest first into chunks of ``size``, from 0.

    Numbering doesn't sort everything into one task: rows are counted per published day, days are few, and a row's
    place is its day's start plus its place within the day.
    """
    day = F.floor(F.col("published_at_ms") / DAY_MS)
    rows = rows.withColumn("_day", day)
    ahead = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_day").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_day").orderBy(F.desc("published_at_ms"), "entry_id"))
    return rows.withColumn("_place", place).join(starts, "_day").withColumn("chunk", F.floor((F.col("_start") + F.col("_place") - 1) / size)).drop("_day", "_place", "_start")


def snapshot_merge(local: DataFrame, incoming: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of both states by clock: an import never overwrites a newer local write."""
    columns = [*key, "val", "lamport", "device_id", "seq"]
    return resolve(local.select(*columns).unionByName(incoming.select(*columns)), key)


def outbox_batch(ops: DataFrame, device: str, limit: int = 500) -> DataFrame:
    """The oldest of a device's ops, in order."""
    return ops.filter(F.col("device_id") == device).orderBy("seq").limit(limit)


def stubs(ops: DataFrame, entities: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Rows for entities that ops name but no table has: written fields where there are any, defaults elsewhere."""
    unseen = ops.join(entities.select("entity_id").distinct(), "entity_id", "left_anti")
    rows = state_rows(unseen, list(defaults))
    return rows.select("entity_id", *(F.coalesce(F.col(f), d).alias(f) for f, d in defaults.items()))

"""Queries on replication, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.bindings import DAY_MS, EPOCH_MS, HOUR_MS, NOW_MS, Archive, sql
from contentlake.operators import counters, sync, variants
from contentlake.operators.sync import Scope
from contentlake.shared import saved, shared
from contentlake.streaming import jobs, stateful

Q, SQL = {}, {}
FIELDS = ["view", "click", "signup", "purchase"]  # 'error' stands for a field that no table has


def query(oracle: str | None = None, more: str = ""):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Archive(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        Q[f.__name__] = run
        if oracle:
            SQL[f.__name__] = sql(oracle, more)
        return f

    return add


def winners(table: str, where: str = "TRUE") -> str:
    return f"""SELECT entity_id, field, val, lamport, device_id, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY lamport DESC, device_id DESC, seq) AS n FROM {table} WHERE {where}) x WHERE n = 1"""


def known(a: Archive) -> DataFrame:
    """Entities that exist here: two of three."""
    return a.ops.select("entity_id").distinct().filter("entity_id % 3 <> 0")


@query(winners("ops"))
def lww_resolve(a: Archive) -> DataFrame:
    return sync.resolve(a.ops)


@query(winners("tied_ops"))
def lww_tie(a: Archive) -> DataFrame:
    """Clocks tie: the larger device id wins, and of one device the first op."""
    return sync.resolve(a.tied_ops)


PIVOT = ", ".join(f"max(CASE WHEN field = '{f}' THEN val END) AS {f}" for f in FIELDS)


@query(f"SELECT entity_id, {PIVOT} FROM ({winners('tied_ops')}) w GROUP BY entity_id")
def lww_state_pivot(a: Archive) -> DataFrame:
    return sync.state_rows(a.tied_ops, FIELDS)


@query(f"SELECT entity_id, field FROM ({winners('tied_ops')}) w WHERE NOT (CAST(floor(val) AS BIGINT) % 2 = 0)")
def tag_element_set(a: Archive) -> DataFrame:
    """A set of tags: a write says whether the tag is deleted."""
    return sync.element_set(a.tied_ops.withColumn("val", F.floor("val") % 2 == 0))


OUTCOME = """oc AS (
  SELECT o.*, CASE WHEN field NOT IN ('view', 'click', 'signup', 'purchase') THEN 'error' WHEN entity_id % 3 = 0 THEN 'pending'
    WHEN EXISTS (SELECT 1 FROM tied_ops p WHERE p.entity_id = o.entity_id AND p.field = o.field AND p.seq < o.seq AND (p.lamport > o.lamport OR (p.lamport = o.lamport AND p.device_id >= o.device_id))) THEN 'ignored'
    ELSE 'applied' END AS outcome FROM tied_ops o
)"""


@query("SELECT outcome, count(*) AS n FROM oc GROUP BY outcome", OUTCOME)
def op_outcomes(a: Archive) -> DataFrame:
    return sync.outcomes(a.tied_ops, known(a), FIELDS).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT outcome, count(*) AS n FROM oc GROUP BY outcome", OUTCOME)
def op_outcomes_observed(a: Archive) -> DataFrame:
    """The counts of a batch of ops, taken while its outcomes are written."""
    rows, watch = counters.observed(sync.outcomes(a.tied_ops, known(a), FIELDS), "outcomes")
    rows.select("seq", "outcome").write.parquet(shared(a.spark, "outcomes"))
    counts = [(k, n) for k, n in watch.get.items() if n]
    return a.spark.createDataFrame(counts, "outcome string, n long")  # as many rows as there are outcomes


JSON = """CASE seq % 4 WHEN 0 THEN CASE WHEN seq % 8 = 0 THEN 'true' ELSE 'false' END WHEN 1 THEN '"text ' || CAST(seq AS VARCHAR{n}) || '"' WHEN 2 THEN CAST(seq AS VARCHAR{n}) ELSE 'null' END"""
JSON_SQL = JSON.format(n="")


@query(f"""SELECT entity_id, field, CASE json_type(j) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'text' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, CAST(j AS JSON) ->> '$' AS val, seq FROM (
  SELECT *, CAST({JSON_SQL} AS JSON) AS j, row_number() OVER (PARTITION BY entity_id, field ORDER BY lamport DESC, device_id DESC, seq) AS n FROM tied_ops) x WHERE n = 1""")
def variant_values(a: Archive) -> DataFrame:
    """Last writer of values of four kinds, stored as VARIANT in between."""
    ops = a.tied_ops.drop("val").withColumn("json", F.expr(JSON.format(n="(20)")))
    state = saved(variants.resolve(variants.typed(ops)), "variants")
    return state.select("entity_id", "field", variants.kind(F.col("val")).alias("kind"), variants.as_text(F.col("val")).alias("val"), "seq")


@query("""SELECT device_id, CASE WHEN last_seq % 3 <> 0 THEN CAST(last_seq % 90 AS INTEGER) END AS days, last_seq % 2 = 0 AS starred, unnest(['R' || CAST(last_seq % 5 AS VARCHAR), 'N' || CAST(last_seq % 25 AS VARCHAR)]) AS folder_id FROM sync_clients""")
def variant_scopes(a: Archive) -> DataFrame:
    """Scopes of clients, given as JSON documents."""
    days = F.when(F.col("last_seq") % 3 != 0, F.concat(F.lit('"days": '), (F.col("last_seq") % 90).cast("string"), F.lit(", "))).otherwise(F.lit(""))
    spec = F.concat(F.lit("{"), days, F.lit('"starred": '), (F.col("last_seq") % 2 == 0).cast("string"), F.lit(', "folders": ["R'), (F.col("last_seq") % 5).cast("string"), F.lit('", "N'), (F.col("last_seq") % 25).cast("string"), F.lit('"]}'))
    return variants.scope_folders(a.sync_clients.select("device_id", F.parse_json(spec).alias("spec")))


@query("SELECT seq, outcome FROM oc", OUTCOME)
def op_outcome_rows(a: Archive) -> DataFrame:
    return sync.outcomes(a.tied_ops, known(a), FIELDS).select("seq", "outcome")


@query("SELECT seq, field FROM ops WHERE field NOT IN ('view', 'click', 'signup', 'purchase')")
def field_whitelist(a: Archive) -> DataFrame:
    """Ops on fields that no table has: the dead letters."""
    return a.ops.filter(~F.col("field").isin(FIELDS)).select("seq", "field")


@query("SELECT entity_id, field, lamport, device_id, min(seq) AS seq FROM tied_ops WHERE field <> 'error' AND entity_id % 3 = 0 GROUP BY entity_id, field, lamport, device_id")
def pending_orphans(a: Archive) -> DataFrame:
    return sync.parked(a.tied_ops, known(a), FIELDS).select("entity_id", "field", "lamport", "device_id", "seq")


@query(winners("tied_ops", "field <> 'error' AND (entity_id % 3 <> 0 OR entity_id % 2 = 0)"))
def pending_replay(a: Archive) -> DataFrame:
    """State once half of the missing entities have arrived."""
    ops = a.tied_ops.filter(F.col("field").isin(FIELDS))
    pending = sync.parked(ops, known(a), FIELDS)
    arrived = ops.select("entity_id").distinct().filter("entity_id % 3 = 0 AND entity_id % 2 = 0")
    return sync.replay(pending, arrived, sync.resolve(ops.join(known(a), "entity_id", "left_semi")))


@query(winners("tied_ops", "field <> 'error' AND (entity_id % 3 <> 0 OR entity_id % 2 = 0)"))
def stream_parking(a: Archive) -> DataFrame:
    """The same rows from a stream in which ops wait for entities that arrive later or never."""
    at = shared(a.spark, "parking")
    ops = a.tied_ops.filter(F.col("field").isin(FIELDS)).select("entity_id", "field", F.col("val").cast("double").alias("val"), "lamport", "device_id", "seq")
    arrived = ops.select("entity_id").distinct().filter("entity_id % 3 <> 0 OR entity_id % 2 = 0")
    ops.repartitionByRange(3, "seq").write.parquet(f"{at}/ops")
    arrived.repartition(2, "entity_id").write.parquet(f"{at}/entities")
    with stateful.rocksdb(a.spark):
        stream = stateful.released(*(jobs.read_log(a.spark, f"{at}/{n}", rows.schema) for n, rows in (("ops", ops), ("entities", arrived))))
        return sync.resolve(jobs.run_once(stream, "released", "append", f"{at}/state"))


@query(f"SELECT entity_id, coalesce(max(CASE WHEN field = 'view' THEN val END), 0) AS view, coalesce(max(CASE WHEN field = 'click' THEN val END), -1) AS click FROM ({winners('tied_ops', 'entity_id % 3 = 0')}) w GROUP BY entity_id")
def structural_stubs(a: Archive) -> DataFrame:
    """Rows for entities that only ops name."""
    return sync.stubs(a.tied_ops, known(a), {"view": F.lit(0.0), "click": F.lit(-1.0)})


LIST = f"FROM entries e LEFT JOIN entry_state s ON e.entry_id = s.entry_id WHERE e.published_at_ms >= {NOW_MS - 20 * DAY_MS} OR s.starred OR NOT s.is_read"
BELOW = """below AS (
  SELECT folder_id FROM folders WHERE folder_id = 'R2'
  UNION SELECT f.folder_id FROM folders f JOIN below b ON f.parent_id = b.folder_id
), scoped AS (
  SELECT feed_id FROM feeds WHERE folder_id IN (SELECT folder_id FROM below) UNION SELECT 'src1'
)"""
SCOPE = Scope(days=20, folder_ids=["R2"], feed_ids=["src1"])


@query(f"SELECT e.entry_id, e.published_at_ms {LIST} ORDER BY e.published_at_ms DESC, e.entry_id LIMIT 5000")
def scope_entries(a: Archive) -> DataFrame:
    return sync.scope_list(a, Scope(days=20), NOW_MS)


@query("SELECT e.entry_id, e.published_at_ms FROM entries e LEFT JOIN entry_state s ON e.entry_id = s.entry_id WHERE s.starred OR NOT s.is_read ORDER BY e.published_at_ms DESC, e.entry_id LIMIT 300")
def scope_entries_undated(a: Archive) -> DataFrame:
    """Without days only the flags count."""
    return sync.scope_list(a, Scope(max_entries=300), NOW_MS)


@query("SELECT feed_id FROM scoped", BELOW)
def scope_feeds(a: Archive) -> DataFrame:
    return sync.scope_feeds(a, SCOPE)


TEST = f"e.feed_id IN (SELECT feed_id FROM scoped) AND (e.published_at_ms >= {NOW_MS - 20 * DAY_MS} OR {{star}} OR NOT {{read}})"
READ, STAR = "coalesce(s.is_read, FALSE)", "coalesce(s.starred, FALSE)"


@query(f"SELECT e.entry_id, {TEST.format(read=READ, star=STAR)} AS in_scope FROM entries e LEFT JOIN entry_state s ON e.entry_id = s.entry_id", BELOW)
def scope_membership(a: Archive) -> DataFrame:
    return sync.in_scope(a, SCOPE, NOW_MS).select("entry_id", "in_scope")


KINDS = "CASE seq % 4 WHEN 0 THEN 'feed' ELSE 'entry' END AS entity, CASE WHEN seq % 4 = 1 THEN 'read' WHEN seq % 4 = 2 THEN 'starred' ELSE 'title' END AS kind"


@query(
    f"""SELECT o.seq FROM (SELECT seq, seq % 1500 AS entry_id, {KINDS} FROM ops) o
LEFT JOIN (SELECT e.entry_id, {TEST.format(read=READ, star=STAR)} AS now_in, {TEST.format(read=f'(NOT {READ})', star=STAR)} AS read_in, {TEST.format(read=READ, star=f'(NOT {STAR})')} AS star_in
  FROM entries e LEFT JOIN entry_state s ON e.entry_id = s.entry_id) t ON o.entry_id = t.entry_id
WHERE o.entity <> 'entry' OR t.entry_id IS NULL OR t.now_in OR (o.kind = 'read' AND t.read_in) OR (o.kind = 'starred' AND t.star_in)""",
    BELOW,
)
def scope_delta(a: Archive) -> DataFrame:
    """What a device with a scope is sent, ops that take an entry out of it included."""
    part = F.col("seq") % 4
    kind = F.when(part == 1, "read").when(part == 2, "starred").otherwise("title")
    ops = a.ops.select("seq", (F.col("seq") % 1500).alias("entity_id"), F.when(part == 0, "feed").otherwise("entry").alias("entity"), kind.alias("field"), "val")
    return sync.delta(a, ops, SCOPE, NOW_MS).select("seq")


@query("""SELECT seq, device_id, has_more, next_cursor FROM (
  SELECT seq, device_id, (SELECT count(*) FROM ops WHERE seq > 1000) > 500 AS has_more, max(seq) OVER () AS next_cursor FROM (SELECT * FROM ops WHERE seq > 1000 ORDER BY seq LIMIT 500) p) x WHERE device_id <> '7'""")
def pull_page(a: Archive) -> DataFrame:
    return sync.pull(a.ops, 1000, 500, "7").select("seq", "device_id", "has_more", "next_cursor")


@query("SELECT seq, entity_id, field FROM ops WHERE device_id = '7' ORDER BY seq LIMIT 50")
def outbox_batch(a: Archive) -> DataFrame:
    return sync.outbox_batch(a.ops, "7", 50).select("seq", "entity_id", "field")


@query("""SELECT seq, n + greatest(0, max(lamport - n + 1) OVER (PARTITION BY device_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS local_clock
FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq) AS n FROM ops) x""")
def lamport_observe(a: Archive) -> DataFrame:
    return sync.observe(a.ops).select("seq", "local_clock")


KEEP = f"coalesce((SELECT min(last_seq) FROM sync_clients WHERE last_seen_ms >= {NOW_MS - 90 * DAY_MS}), (SELECT max(seq) FROM ops))"


@query(f"SELECT {KEEP} AS keep_seq")
def min_client_seq(a: Archive) -> DataFrame:
    return sync.slowest_cursor(a.sync_clients, a.ops, NOW_MS)


OLD = f"seq <= 6000 AND ts_ms < {EPOCH_MS + 600 * HOUR_MS}"
LAST = f"SELECT max(seq) FROM ops WHERE {OLD} GROUP BY entity_id, field"


@query(f"SELECT seq FROM ops WHERE NOT ({OLD}) OR seq IN ({LAST})")
def compaction_keep(a: Archive) -> DataFrame:
    return sync.compacted(a.ops, 6000, EPOCH_MS + 600 * HOUR_MS).select("seq")


@query(f"""SELECT seq, entity_id, field FROM ops WHERE seq > (SELECT {KEEP}) OR seq IN (SELECT max(seq) FROM ops WHERE seq <= (SELECT {KEEP}) GROUP BY entity_id, field)""")
def log_compacted(a: Archive) -> DataFrame:
    """The stored log after the nightly job: what lies below the slowest client's cursor is one write for each key."""
    path = f"{shared(a.spark, 'log')}/ops"
    a.ops.write.parquet(path)
    jobs.compact_log(a.spark, path, a.sync_clients, a.ops.schema, NOW_MS)
    return a.spark.read.schema(a.ops.schema).parquet(path).select("seq", "entity_id", "field")


@query(f"""SELECT device_id AS task, due_ms FROM (
  SELECT device_id, CASE WHEN last_seq % 2 = 0 THEN last_seen_ms + 86400000 ELSE CASE WHEN {NOW_MS - NOW_MS % DAY_MS} + 11820000 <= {NOW_MS} THEN {NOW_MS - NOW_MS % DAY_MS} + 11820000 ELSE {NOW_MS - NOW_MS % DAY_MS} + 11820000 - 86400000 END END AS due_ms, last_seen_ms, last_seq FROM sync_clients) x
WHERE due_ms <= {NOW_MS} AND (last_seq % 2 = 0 OR due_ms > last_seen_ms) AND last_seq % 7 <> 0""")
def due_tasks(a: Archive) -> DataFrame:
    """Tasks of devices, every day or daily at 3:17, that are due; those that run aren't."""
    even = F.col("last_seq") % 2 == 0
    tasks = a.sync_clients.select(F.col("device_id").alias("task"), F.when(even, F.lit(86_400_000)).alias("every_ms"), F.lit(11_820_000).alias("at_ms"), F.col("last_seen_ms").alias("last_ms"), (F.col("last_seq") % 7 == 0).alias("running"))
    return jobs.due_runs(tasks, NOW_MS)


@query(f"SELECT count(*) AS deleted FROM ops WHERE {OLD} AND seq NOT IN ({LAST})")
def compaction_deleted(a: Archive) -> DataFrame:
    kept = sync.compacted(a.ops, 6000, EPOCH_MS + 600 * HOUR_MS).select("seq")
    return a.ops.join(kept, "seq", "left_anti").agg(F.count("*").alias("deleted"))


@query("SELECT count(*) AS ops, min(seq) AS min_seq, max(seq) AS max_seq, count(DISTINCT (entity_id, field)) AS keys, greatest(count(*) - count(DISTINCT (entity_id, field)), 0) AS compactable FROM ops")
def changelog_stats(a: Archive) -> DataFrame:
    return sync.log_stats(a.ops)


@query("""SELECT device_id, count(*) AS ops, max(lamport) AS lamport, min(seq) AS first_seq FROM ops GROUP BY device_id""")
def device_summary(a: Archive) -> DataFrame:
    return a.ops.groupBy("device_id").agg(F.count("*").alias("ops"), F.max("lamport").alias("lamport"), F.min("seq").alias("first_seq"))


@query(f"""SELECT (SELECT count(*) FROM folders) AS folders, (SELECT count(*) FROM feeds) AS feeds, (SELECT count(*) {LIST}) AS entries,
  (SELECT count(*) FROM entry_tags t WHERE t.entry_id IN (SELECT e.entry_id {LIST})) AS tags, (SELECT max(seq) FROM ops) AS cursor""")
def snapshot_counts(a: Archive) -> DataFrame:
    """What a snapshot for a scope holds: structure whole, entries and their tags in scope, the log's end."""
    entries = sync.scope_list(a, Scope(days=20, max_entries=None), NOW_MS)
    tags = a.entry_tags.join(entries.select("entry_id"), "entry_id", "left_semi")
    one = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  one row each
    return one(a.folders, "folders").crossJoin(one(a.feeds, "feeds")).crossJoin(one(entries, "entries")).crossJoin(one(tags, "tags")).crossJoin(a.ops.agg(F.max("seq").alias("cursor")))


@query("SELECT entry_id, CAST(floor((row_number() OVER (ORDER BY published_at_ms DESC, entry_id) - 1) / 70) AS BIGINT) AS chunk FROM entries")
def snapshot_chunks(a: Archive) -> DataFrame:
    return sync.snapshot_chunks(a.entries.select("entry_id", "published_at_ms"), 70).select("entry_id", "chunk")


@query(winners("tied_ops", "field <> 'error'"))
def snapshot_merge(a: Archive) -> DataFrame:
    """Two replicas' states merged by clock."""
    ops = a.tied_ops.filter("field <> 'error'")
    return sync.snapshot_merge(sync.resolve(ops.filter("seq % 2 = 0")), sync.resolve(ops.filter("seq % 2 = 1")))

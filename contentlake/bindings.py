"""The archive's tables, bound to the test tables.

``Archive`` gives each table of the model as a DataFrame; ``PRELUDE`` states the same definitions as SQL for the
oracle. Times are epoch milliseconds in UTC; nothing reads a clock: ``now_ms`` is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MS = 1_704_067_200_000
HOUR_MS, DAY_MS = 3_600_000, 86_400_000
NOW_MS = EPOCH_MS + 1000 * HOUR_MS


@dataclass
class Archive:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def folders(self) -> DataFrame:
        """(folder_id, parent_id, name): regions are roots, nations their children."""
        roots = self.table("region").select(F.concat(F.lit("R"), "r_regionkey").alias("folder_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
        children = self.table("nation").select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), "n_name")
        return roots.union(children)

    @cached_property
    def feeds(self) -> DataFrame:
        """(feed_id, folder_id, title, custom_title, url): one per source."""
        number = F.substring("feed_id", 4, 10).cast("int")
        return (
            self.table("documents").select(F.col("source").alias("feed_id")).distinct()
            .select("feed_id", F.concat(F.lit("N"), (number % 25).cast("string")).alias("folder_id"), F.concat(F.lit("Feed "), "feed_id").alias("title"),
                    F.when(number % 3 == 0, F.concat(F.lit("My "), "feed_id")).otherwise(F.lit("")).alias("custom_title"), F.concat(F.lit("https://"), "feed_id", F.lit(".example.org/feed")).alias("url"))
        )

    @cached_property
    def entries(self) -> DataFrame:
        """(entry_id, feed_id, title, body_text, lang, published_at_ms, content_hash)."""
        return self.table("documents").select(
            F.col("doc_id").alias("entry_id"), F.col("source").alias("feed_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("body_text"), "lang", (F.lit(EPOCH_MS) + F.col("doc_id") * HOUR_MS).alias("published_at_ms"),
            F.sha2(F.trim(F.lower("text")), 256).alias("content_hash"),
        )

    @cached_property
    def entry_state(self) -> DataFrame:
        """(entry_id, is_read, starred); not every entry has a row."""
        return self.table("labels").select(F.col("doc_id").alias("entry_id"), (F.col("quality") == 0).alias("is_read"), (F.col("toxic") == 1).alias("starred"))

    @cached_property
    def entry_tags(self) -> DataFrame:
        """(entry_id, tag, deleted): the language, and 'long' for long texts; every seventh entry's are tombstones."""
        docs = self.table("documents")
        gone = (F.col("doc_id") % 7 == 0).alias("deleted")
        return docs.select(F.col("doc_id").alias("entry_id"), F.col("lang").alias("tag"), gone).union(docs.filter("n_chars > 3000").select("doc_id", F.lit("long"), gone))

    @cached_property
    def ops(self) -> DataFrame:
        """(seq, device_id, lamport, entity_id, field, val, ts_ms): the change log."""
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        return self.table("events").select(
            F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("device_id"), F.floor(ms / HOUR_MS).cast("long").alias("lamport"),
            F.col("user_id").alias("entity_id"), F.col("event_type").alias("field"), F.col("value").alias("val"), ms.alias("ts_ms"),
        )

    @cached_property
    def tied_ops(self) -> DataFrame:
        """The log with coarse clocks and five devices, so that clocks tie."""
        return self.ops.withColumns({"lamport": F.floor(F.col("lamport") / 24).cast("long"), "device_id": (F.col("device_id").cast("int") % 5).cast("string")})

    @cached_property
    def sync_clients(self) -> DataFrame:
        """(device_id, last_seq, last_seen_ms)."""
        return self.ops.groupBy("device_id").agg((F.min("seq") + 5000).alias("last_seq"), (F.max("lamport") * HOUR_MS).alias("last_seen_ms"))


PRELUDE = f"""
folders AS (
  SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS folder_id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name FROM region
  UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR), n_name FROM nation
), feeds AS (
  SELECT source AS feed_id, 'N' || CAST(CAST(substr(source, 4) AS INTEGER) % 25 AS VARCHAR) AS folder_id, 'Feed ' || source AS title,
         CASE WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 0 THEN 'My ' || source ELSE '' END AS custom_title,
         'https://' || source || '.example.org/feed' AS url
  FROM (SELECT DISTINCT source FROM documents) s
), entries AS (
  SELECT doc_id AS entry_id, source AS feed_id, split_part(text, chr(10), 1) AS title, text AS body_text, lang,
         {EPOCH_MS} + doc_id * {HOUR_MS} AS published_at_ms, sha256(trim(lower(text))) AS content_hash
  FROM documents
), entry_state AS (
  SELECT doc_id AS entry_id, quality = 0 AS is_read, toxic = 1 AS starred FROM labels
), entry_tags AS (
  SELECT doc_id AS entry_id, lang AS tag, doc_id % 7 = 0 AS deleted FROM documents
  UNION ALL SELECT doc_id, 'long', doc_id % 7 = 0 FROM documents WHERE n_chars > 3000
), ops AS (
  SELECT event_id AS seq, json_extract_string(props, '$.k') AS device_id, (epoch_us(ts) // 1000) // {HOUR_MS} AS lamport,
         user_id AS entity_id, event_type AS field, value AS val, epoch_us(ts) // 1000 AS ts_ms
  FROM events
), tied_ops AS (
  SELECT seq, CAST(CAST(device_id AS INTEGER) % 5 AS VARCHAR) AS device_id, lamport // 24 AS lamport, entity_id, field, val, ts_ms FROM ops
), sync_clients AS (
  SELECT device_id, min(seq) + 5000 AS last_seq, max(lamport) * {HOUR_MS} AS last_seen_ms FROM ops GROUP BY device_id
)"""


def sql(body: str, more: str = "") -> str:
    """An oracle query over the archive's tables; ``more`` are further common table expressions."""
    return f"WITH RECURSIVE {PRELUDE.strip()}{', ' + more.strip() if more else ''}\n{body.strip()}"

"""Queries on what surrounds ingest: encodings, frames, hooks, new feeds, templates, channels; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.bindings import Archive, sql
from contentlake.functions import packed
from contentlake.functions import text as T
from contentlake.operators import ingest
from contentlake.plans.archive_queries import batches
from contentlake.shared import shared
from contentlake.sinks import exports
from contentlake.sources import feeds, pages
from contentlake.streaming import jobs

Q, SQL = {}, {}


def query(oracle: str, more: str = ""):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Archive(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        Q[f.__name__], SQL[f.__name__] = run, sql(oracle, more)
        return f

    return add


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'utf-16be' WHEN 1 THEN 'utf-16le' ELSE 'utf-8' END AS charset, sha256(CASE page_id % 3 WHEN 1 THEN '<?xml version=\"1.0\" encoding=\"utf-16le\"?>' ELSE '' END || html) AS digest FROM pages")
def page_decoded(a: Archive) -> DataFrame:
    """Whole pages as bytes of three encodings, which a header, the header over a declaration, and the page's own meta element tell."""
    part, html = F.col("page_id") % 3, F.col("html")
    text = F.concat(F.when(part == 1, F.lit('<?xml version="1.0" encoding="utf-16le"?>')).otherwise(F.lit("")), html)
    content = F.when(part == 0, F.encode(text, "UTF-16BE")).when(part == 1, F.encode(text, "UTF-16LE")).otherwise(F.encode(text, "UTF-8"))
    header = F.when(part == 0, "text/html; charset=UTF-16BE").when(part == 1, 'text/html; charset="utf-16le"').otherwise(F.lit(None))
    rows = a.table("pages").select("page_id", content.alias("content"), header.alias("header"))
    rows = rows.withColumn("charset", pages.charset_of(F.col("content"), F.col("header")))
    return rows.select("page_id", "charset", F.sha2(pages.decoded("content", "charset"), 256).alias("digest"))


@query("SELECT entry_id, sha256(body_text) AS digest, TRUE AS smaller FROM entries WHERE strlen(body_text) > 200")
def body_frames(a: Archive) -> DataFrame:
    """Bodies stored as frames, and read again; long ones are smaller than before."""
    rows = a.entries.filter("octet_length(body_text) > 200").select("entry_id", "body_text", packed.compressed(F.col("body_text")).alias("frame"))
    return rows.select("entry_id", F.sha2(packed.decompressed(F.col("frame")), 256).alias("digest"), (F.octet_length("frame") < F.octet_length("body_text")).alias("smaller"))


@query("""SELECT entry_id, feed_id, CASE WHEN entry_id % 2 = 1 THEN 'hooked ' || content_hash WHEN entry_id % 12 = 0 THEN 'edited' ELSE content_hash END AS content_hash FROM entries""")
def refresh_hooked(a: Archive) -> DataFrame:
    """A refresh whose hook changes new entries before they are merged; the new table is swapped in for the old one."""
    old, batch = batches(a)
    at = f"{shared(a.spark, 'refresh')}/entries"
    exports.swap_in(old, at)

    def hook(classified: DataFrame) -> DataFrame:
        return classified.withColumn("content_hash", F.when(F.col("action") == "insert", F.concat(F.lit("hooked "), "content_hash")).otherwise(F.col("content_hash")))

    stored = a.spark.read.parquet(at)
    after, _ = ingest.refresh(stored, batch.withColumn("pos", F.lit(0)), (hook,))
    exports.swap_in(after, at)
    return a.spark.read.parquet(at).select("entry_id", "feed_id", "content_hash")


@query("SELECT url FROM (SELECT DISTINCT url FROM feeds WHERE CAST(substr(feed_id, 4) AS INTEGER) % 2 = 1) x")
def feeds_added(a: Archive) -> DataFrame:
    """Addresses to subscribe to, each asked for twice; those that are there already stay as they are."""
    number = F.substring("feed_id", 4, 10).cast("int")
    return feeds.new_feeds(a.feeds.union(a.feeds), a.feeds.filter(number % 2 == 0)).select("url")


@query("SELECT entry_id, feed_id || '/' || lang || ' - ' || title || '.md' AS name FROM entries")
def note_names(a: Archive) -> DataFrame:
    """File names by a user's template."""
    name = exports.fill_template("{{feed}}/{{lang}} - {{title}}.md", feed=F.col("feed_id"), lang=F.col("lang"), title=F.col("title"))
    return a.entries.select("entry_id", name.alias("name"))


@query("SELECT channel, seq FROM ops CROSS JOIN (SELECT unnest(['mail', 'push']) AS channel) c WHERE field = 'purchase'")
def channels_told(a: Archive) -> DataFrame:
    """Ops of one kind to three channels by a stream of batches; the one that fails doesn't keep them from the others."""
    at = shared(a.spark, "channels")
    rows = a.ops.filter("field = 'purchase'").select("seq")
    rows.repartition(3).write.parquet(f"{at}/ops")

    def channel(name: str):
        def send(batch: DataFrame) -> None:
            batch.select(F.lit(name).alias("channel"), "seq").write.mode("append").parquet(f"{at}/told")

        return send

    def broken(batch: DataFrame) -> None:
        raise ConnectionError("no answer")

    log = jobs.read_log(a.spark, f"{at}/ops", rows.schema, files=2)
    jobs.apply_batches(log, exports.fan_out([channel("mail"), broken, channel("push")]), f"{at}/state").awaitTermination()
    return a.spark.read.schema("channel string, seq long").parquet(f"{at}/told")


@query("""SELECT seq, CASE WHEN seq % 5 = 0 THEN kind WHEN kind = 'ValueError' THEN said ELSE kind || ': ' || said END AS error FROM (
  SELECT seq, CASE WHEN field = 'error' THEN 'ValueError' ELSE 'TimeoutError' END AS kind, 'op ' || CAST(seq AS VARCHAR) || ' failed' AS said FROM ops) x""")
def error_texts(a: Archive) -> DataFrame:
    """What is shown of failures: with or without a message, of kinds that word it for users and others."""
    kind = F.when(F.col("field") == "error", "ValueError").otherwise("TimeoutError")
    said = F.when(F.col("seq") % 5 == 0, " ").otherwise(F.concat(F.lit(" op "), F.col("seq").cast("string"), F.lit(" failed ")))
    return a.ops.select("seq", T.error_text(kind, said).alias("error"))

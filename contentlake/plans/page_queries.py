"""Queries on pages, feeds, exports and streams; with SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.bindings import DAY_MS, NOW_MS, Archive, sql
from contentlake.functions import html as H
from contentlake.functions import tables
from contentlake.functions import text as T
from contentlake.operators import delivery, sync
from contentlake.operators.selection import Selection, select_entries
from contentlake.plans.archive_queries import BUCKETS, BUDGET, MAILS, alerts, picked
from contentlake.plans.sync_queries import winners
from contentlake.shared import shared
from contentlake.sinks import exports
from contentlake.sources import datasource, feeds, pages
from contentlake.streaming import jobs

Q, SQL = {}, {}


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


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_title(a: Archive) -> DataFrame:
    return a.table("pages").select("page_id", H.page_title(F.col("html")).alias("title"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(a: Archive) -> DataFrame:
    return a.table("pages").select("page_id", F.explode(H.page_links(F.col("html"))).alias("href"))


ROUGH = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""SELECT page_id, regexp_matches(html, '(?is)<div[^>]+id=["''](root|app|__next)["''][^>]*>\\s*</div>') OR (length({ROUGH}) < 600 AND len(regexp_extract_all(html, '(?i)<script')) >= 3) AS scripted, CAST(length({ROUGH}) AS INTEGER) AS text_length
FROM (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN '<div id="app"> </div>' || html WHEN page_id % 6 = 1 THEN html || '<script></script><SCRIPT></SCRIPT>' ELSE html END AS html FROM pages) p""")
def page_js_detect(a: Archive) -> DataFrame:
    """Some pages are turned into script shells; those are to be found."""
    part, html = F.col("page_id") % 6, F.col("html")
    made = F.when(part == 0, F.concat(F.lit('<div id="app"> </div>'), html)).when(part == 1, F.concat(html, F.lit("<script></script><SCRIPT></SCRIPT>"))).otherwise(html)
    rows = a.table("pages").select("page_id", made.alias("html")).withColumn("n", F.length(H.rough_text(F.col("html"))))
    return rows.select("page_id", H.looks_scripted(F.col("html"), F.col("n")).alias("scripted"), F.col("n").alias("text_length"))


HOST = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
PLACES = "[" + ", ".join(f"'{p}'" for p in feeds.COMMON_PATHS) + "]"


@query(f"""SELECT url, candidate, CAST(rank AS INTEGER) AS rank FROM (
  SELECT url, unnest(c) AS candidate, unnest(range(len(c))) AS rank FROM (
    SELECT url, list_concat(['https://feeds.example.org/' || CAST(page_id AS VARCHAR) || '.xml', {HOST} || '/all'], list_transform({PLACES}, lambda p: {HOST} || p)) AS c FROM pages) x) y""")
def page_feed_links(a: Archive) -> DataFrame:
    """Announced feeds before common places; pages get two announcements."""
    links = F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/all"><link rel="alternate" type="application/atom+xml" href="https://feeds.example.org/'), F.col("page_id").cast("string"), F.lit('.xml"><link rel="alternate" type="text/html" href="/no">'))
    return feeds.candidates(a.table("pages").select("url", F.concat(links, "html").alias("html"))).select("url", "candidate", "rank")


@query(f"""SELECT url, candidate, CAST(rank AS INTEGER) AS rank FROM (
  SELECT url, unnest(['https://feeds.example.org/' || CAST(page_id AS VARCHAR) || '.xml', {HOST} || '/all']) AS candidate, unnest([0, 1]) AS rank FROM pages) x""")
def lateral_feed_links(a: Archive) -> DataFrame:
    """Announced feeds of pages by a table function in SQL."""
    tables.register(a.spark)
    links = F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/all"><link rel="alternate" type="application/atom+xml" href="https://feeds.example.org/'), F.col("page_id").cast("string"), F.lit('.xml">'))
    return a.spark.sql("SELECT p.url, f.candidate, f.rank FROM {pages} p, LATERAL page_feeds(p.html, p.url) f", pages=a.table("pages").select("url", F.concat(links, "html").alias("html")))


@query("SELECT key, bucket, count(*) AS count, min(ts_ms) AS first_ts_ms, min(pos) AS first_pos FROM fold GROUP BY key, bucket", BUCKETS)
def notify_table_function(a: Archive) -> DataFrame:
    """Buckets of notifications by a table function over each key in order."""
    tables.register(a.spark)
    text = """SELECT key, bucket, count(*) AS count, min(ts_ms) AS first_ts_ms, min(pos) AS first_pos
    FROM notification_buckets(TABLE({alerts}) PARTITION BY key ORDER BY pos) GROUP BY key, bucket"""
    return a.spark.sql(text, alerts=alerts(a).select("key", "pos", "ts_ms"))


@query("""SELECT url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, 'ok' AS status, CAST(strlen(html) AS BIGINT) AS size FROM pages""")
def pages_by_host(a: Archive) -> DataFrame:
    """All pages through the data source, hosts dealt to its connections; bodies from the table."""
    datasource.register(a.spark)
    rows = a.spark.read.format("pages").options(path=f"{a.sf_dir}/pages.parquet", opener="table", connections=8).load()
    return rows.select("url", "host", "status", F.octet_length("content").cast("long").alias("size"))


@query(winners("ops"))
def stream_change_log(a: Archive) -> DataFrame:
    """Last writer per key from a stream whose offset is the log's seq; read in two runs, as after a restart."""
    datasource.register(a.spark)
    at, edge = shared(a.spark, "changes"), a.ops.agg(F.max("seq")).first()[0] or 0
    for k, part in enumerate((F.col("seq") <= edge // 2, F.col("seq") > edge // 2)):
        a.ops.filter(part).write.parquet(f"{at}/log/part={k}")
        log = a.spark.readStream.format("change_log").schema(a.ops.schema).options(path=f"{at}/log", limit=5000).load()
        rows = jobs.run_once(log, "pulled", "append", f"{at}/state")
    return sync.resolve(rows)


@query("SELECT page_id, NOT contains(html, '<script') AS had_none, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs, FALSE AS active FROM pages")
def page_sanitize(a: Archive) -> DataFrame:
    """Nothing active is left, and every paragraph is."""
    clean = H.html_sanitised(F.col("html"), F.col("url"))
    rows = a.table("pages").select("page_id", "html", clean.alias("clean"))
    return rows.select("page_id", (~F.contains("html", F.lit("<script"))).alias("had_none"), F.size(F.regexp_extract_all("clean", F.lit("(<p>)"), F.lit(1))).cast("long").alias("paragraphs"), F.col("clean").rlike(r"(?i)<script|<style|javascript:| on\w+=").alias("active"))


@query()
def page_text(a: Archive) -> DataFrame:
    return a.table("pages").select("page_id", H.html_text(F.col("html")).alias("text"))


@query()
def page_main_text(a: Archive) -> DataFrame:
    """The article of a page, taken where it is longer than what the feed would give."""
    rows = a.table("pages").select("page_id", H.html_main_text(F.col("html")).alias("main"), F.substring(H.rough_text(F.col("html")), 1, 300).alias("feed_body"))
    return rows.select("page_id", F.when(F.length("main") > F.length("feed_body"), F.col("main")).otherwise(F.col("feed_body")).alias("text"))


@query("SELECT page_id, CAST(pos AS INTEGER) AS pos, title, url FROM (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS title, unnest(list_transform(h, lambda x: o || x)) AS url FROM (SELECT page_id, regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1) AS l, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1) AS h, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o FROM pages) x) y")
def page_scrape(a: Archive) -> DataFrame:
    """Items of each page's list, by selector, with absolute links."""
    return pages.scraped(a.table("pages"), pages.Scrape(item="nav > ul > li"), NOW_MS).select("page_id", "pos", "title", "url")


@query()
def page_articles(a: Archive) -> DataFrame:
    return pages.scraped(a.table("pages"), pages.Scrape(item="article", title="h1", link="a[href]"), NOW_MS)


@query("SELECT page_id, visit FROM (SELECT page_id, unnest(CASE WHEN page_id % 4 = 0 THEN [1, 3] ELSE [1] END) AS visit FROM pages) x")
def page_watch(a: Archive) -> DataFrame:
    """Three visits to each page: a changing footer is ignored, a changed article of every fourth page is seen."""
    p = a.table("pages").select("page_id", "html", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("visit"))
    counter = F.concat(F.lit("<footer>Visit "), F.col("visit").cast("string"), F.lit(" "))
    html = F.replace(F.col("html"), F.lit("<footer>"), counter)
    changed = F.when((F.col("visit") == 3) & (F.col("page_id") % 4 == 0), F.replace(html, F.lit("<article>"), F.lit("<article><p>New</p>"))).otherwise(html)
    return pages.watch(pages.zone_hashes(p.withColumn("html", changed), "body", "footer")).select("page_id", "visit")


@query()
def selector_guess(a: Archive) -> DataFrame:
    return pages.guess_selectors(pages.elements(a.table("pages")))


NUMBERED = "SELECT entry_id, feed_id, title, body_text, published_at_ms, row_number() OVER (PARTITION BY feed_id ORDER BY published_at_ms DESC, entry_id) - 1 AS n FROM entries"


@query(f"SELECT feed_id, n // 40 AS page, CAST(n % 40 AS INTEGER) AS pos, 'https://' || feed_id || '.example.org/' || CAST(entry_id AS VARCHAR) AS url, published_at_ms AS published_ms, sha256(feed_id || chr(0) || CAST(entry_id AS VARCHAR)) AS guid_hash FROM ({NUMBERED}) x")
def feed_parse(a: Archive) -> DataFrame:
    """RSS documents of 40 entries each, written from the whole archive, and read back once the newest entry is out: one that
    lay more than a day ahead of its reading would get the time of that."""
    newest = a.entries.agg(F.max("published_at_ms")).first()[0]
    parsed = feeds.parse_feeds(feeds.rss_documents(a.entries, 40), max(NOW_MS, newest or 0))
    return feeds.feed_entries(parsed).select("feed_id", "page", "pos", "url", F.col("published_ms"), "guid_hash")


@query("SELECT f.feed_id, f.url, d.name AS folder FROM feeds f JOIN folders d ON f.folder_id = d.folder_id")
def opml_roundtrip(a: Archive) -> DataFrame:
    """Each folder's feeds as OPML outlines, and read again."""
    rows = a.feeds.join(a.folders.select("folder_id", F.col("name").alias("folder")), "folder_id")
    found = feeds.read_outlines(feeds.opml_documents(rows.select("folder", "url", F.col("feed_id").alias("title"))))
    return found.select(F.col("title").alias("feed_id"), "url", "folder")


@query()
def epub_build(a: Archive) -> DataFrame:
    """A magazine of the newest unread entries."""
    rows = picked(a).select(F.lit("Unread").alias("issue"), "section_no", "place", "section", "title", T.meta_line(F.col("section"), T.iso_date(F.col("published_at_ms"))).alias("meta"), F.col("body_text").alias("text"))
    return exports.issues(rows).select("issue", "articles", F.octet_length("book").alias("bytes"), F.sha2("book", 256).alias("sha256"))


@query()
def note_markdown(a: Archive) -> DataFrame:
    rows = select_entries(a, Selection(starred_only=True)).join(a.feeds.select("feed_id", F.col("title").alias("feed_title")), "feed_id")
    rows = rows.withColumns({"url": F.concat(F.lit("https://example.org/"), F.col("entry_id").cast("string")), "author": F.lit("")})
    return exports.notes(rows, exports.note_body(F.col("body_text")), F.array("lang", F.lit("# to read")), NOW_MS)


@query(
    """SELECT batch, 'Feed ' || feed_id || CASE WHEN max(batch) OVER (PARTITION BY feed_id) > 1 THEN ' (' || CAST(batch AS VARCHAR) || '/' || CAST(max(batch) OVER (PARTITION BY feed_id) AS VARCHAR) || ')' ELSE '' END AS subject,
  'feed-' || feed_id || CASE WHEN max(batch) OVER (PARTITION BY feed_id) > 1 THEN '-' || CAST(batch AS VARCHAR) ELSE '' END AS stem, entry_ids
FROM (SELECT feed_id, batch, string_agg(CAST(entry_id AS VARCHAR), ',' ORDER BY entry_id) AS entry_ids FROM pk GROUP BY feed_id, batch) x""",
    MAILS.replace(str(BUDGET), str(delivery.mail_budget(140_000))),
)
def mail_deliveries(a: Archive) -> DataFrame:
    """Each feed's articles as numbered mails."""
    rows = a.entries.select("feed_id", F.col("entry_id").alias("pos"), "entry_id", delivery.article_weight(F.col("body_text")).alias("weight"))
    mails = exports.deliveries(delivery.greedy_batches(rows, delivery.mail_budget(140_000)), F.concat(F.lit("Feed "), "feed_id"))
    return mails.withColumn("entry_ids", F.array_join(F.col("entry_ids").cast("array<string>"), ","))


# streams


@query(winners("ops").replace(", seq FROM", " FROM"))
def stream_lww(a: Archive) -> DataFrame:
    """Last writer per key, kept up to date by a stream over the log's files."""
    at = shared(a.spark, "log")
    a.ops.repartitionByRange(4, "seq").write.parquet(f"{at}/ops")
    rows = jobs.read_log(a.spark, f"{at}/ops", a.ops.schema, files=2)
    return jobs.run_once(jobs.stream_winners(rows), f"lww_{uuid.uuid4().hex}", "complete", f"{at}/state")


@query("SELECT DISTINCT entity_id, field FROM ops")
def stream_dedup(a: Archive) -> DataFrame:
    at = shared(a.spark, "dedup")
    rows = a.ops.withColumn("ts", F.timestamp_millis("ts_ms"))
    rows.repartitionByRange(3, "seq").write.parquet(f"{at}/ops")
    stream = jobs.stream_first(jobs.read_log(a.spark, f"{at}/ops", rows.schema, files=1), ["entity_id", "field"], "ts", "400 days")
    return jobs.run_once(stream.select("entity_id", "field"), f"dedup_{uuid.uuid4().hex}", "append", f"{at}/state")


@query("""SELECT user_id AS entity_id, event_id AS visit, event_type AS seen FROM (
  SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) x WHERE before IS NULL OR before <> event_type""")
def stream_watch(a: Archive) -> DataFrame:
    """Changes against the last visit, with state kept between batches; equal to the batch window."""
    at = shared(a.spark, "watch")
    visits = a.table("events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("visit"), F.col("event_type").alias("seen"))
    visits.repartition("entity_id").write.parquet(f"{at}/visits")  # a key's visits lie in one file, so no batch breaks their order
    files = jobs.share_of_files(a.spark, f"{at}/visits", 4)  # each batch opens the state of all keys: batches don't grow with the input
    stream = jobs.stream_changes(jobs.read_log(a.spark, f"{at}/visits", visits.schema, files), "entity_id", "visit", "seen")
    return jobs.run_once(stream, f"watch_{uuid.uuid4().hex}", "append", f"{at}/state")


@query(f"SELECT make_timestamp(((epoch_us(ts) // 1000) // {DAY_MS}) * {DAY_MS} * 1000) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(a: Archive) -> DataFrame:
    """Ops per day and kind; windows are final once the watermark has passed, so the result is read in update form."""
    at = shared(a.spark, "windows")
    rows = a.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.write.parquet(f"{at}/rows")
    stream = jobs.windowed_counts(jobs.read_log(a.spark, f"{at}/rows", rows.schema, files=100), "ts", "1 day", "1 day", "event_type")
    return jobs.run_once(stream, f"windows_{uuid.uuid4().hex}", "complete", f"{at}/state").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")

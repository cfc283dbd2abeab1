"""Queries on the archive: selections, search, counts, listings, ingest, delivery; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.bindings import DAY_MS, NOW_MS, Archive, sql
from contentlake.functions import text as T
from contentlake.operators import counters, delivery, ingest, partitioned, ranking, search
from contentlake.operators.selection import SavedSearch, Selection, next_page, select_entries
from contentlake.operators.tree import closure, rollup
from contentlake.shared import shared
from contentlake.streaming import jobs, stateful

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


BELOW = """below AS (
  SELECT folder_id FROM folders WHERE folder_id = 'R1'
  UNION SELECT f.folder_id FROM folders f JOIN below b ON f.parent_id = b.folder_id
)"""
ENTRY = ("entry_id", "feed_id", "published_at_ms", "is_read", "starred")
FIELDS = ", ".join(f"{'s' if c in ('is_read', 'starred') else 'e'}.{c}" for c in ENTRY)
NEWEST = "ORDER BY e.published_at_ms DESC, e.entry_id"
BASE = f"SELECT {FIELDS} FROM entries e JOIN entry_state s ON e.entry_id = s.entry_id"


@query(f"{BASE} JOIN feeds f ON e.feed_id = f.feed_id WHERE NOT s.is_read AND f.folder_id IN (SELECT folder_id FROM below) {NEWEST} LIMIT 50", BELOW)
def sel_folder_unread(a: Archive) -> DataFrame:
    """The newest unread entries below a folder."""
    return select_entries(a, Selection(folder_ids=["R1"], unread_only=True, limit=50)).select(*ENTRY)


@query(f"{BASE} WHERE e.feed_id IN ('src3', 'src7') {NEWEST} LIMIT 200")
def sel_feed(a: Archive) -> DataFrame:
    return select_entries(a, Selection(feed_ids=["src3", "src7"], limit=200)).select(*ENTRY)


@query(f"{BASE} WHERE e.entry_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def sel_ids(a: Archive) -> DataFrame:
    return select_entries(a, Selection(entry_ids=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89])).select(*ENTRY)


@query(f"{BASE} WHERE s.starred")
def sel_starred(a: Archive) -> DataFrame:
    return select_entries(a, Selection(starred_only=True)).select(*ENTRY)


@query(f"{BASE} WHERE e.published_at_ms BETWEEN {NOW_MS - 30 * DAY_MS} AND {NOW_MS - 10 * DAY_MS}")
def sel_date_range(a: Archive) -> DataFrame:
    return select_entries(a, Selection(since_ms=NOW_MS - 30 * DAY_MS, until_ms=NOW_MS - 10 * DAY_MS)).select(*ENTRY)


@query(f"{BASE} {NEWEST} LIMIT 100 OFFSET 100")
def sel_page_offset(a: Archive) -> DataFrame:
    return select_entries(a, Selection(limit=100, offset=100)).select(*ENTRY)


@query(f"{BASE} WHERE e.published_at_ms < {NOW_MS - 20 * DAY_MS} OR (e.published_at_ms = {NOW_MS - 20 * DAY_MS} AND e.entry_id > 520) {NEWEST} LIMIT 100")
def sel_page_keyset(a: Archive) -> DataFrame:
    return next_page(select_entries(a, Selection()), NOW_MS - 20 * DAY_MS, 520, 100).select(*ENTRY)


@query(f"{BASE} WHERE e.entry_id IN (SELECT entry_id FROM entry_tags WHERE NOT deleted AND tag IN ('en', 'long'))")
def sel_tag_any(a: Archive) -> DataFrame:
    return select_entries(a, Selection(tags=["en", "long"])).select(*ENTRY)


@query(f"{BASE} JOIN feeds f ON e.feed_id = f.feed_id WHERE f.folder_id IN (SELECT folder_id FROM below) OR e.feed_id IN ('src0', 'src19')", BELOW)
def sel_folder_and_feeds(a: Archive) -> DataFrame:
    """Folders and feeds together are a union."""
    return select_entries(a, Selection(folder_ids=["R1"], feed_ids=["src0", "src19"])).select(*ENTRY)


TOKENS = r"""toks AS (
  SELECT entry_id, c.col AS col, regexp_extract_all(trim(replace(lower(strip_accents(coalesce(c.t, ''))), 'ß', 'ss')), '[\p{L}\p{N}]+') AS w
  FROM (SELECT entry_id, unnest([{'col': 'title', 't': title}, {'col': 'body', 't': body_text}]) AS c FROM entries) x
), post AS (
  SELECT entry_id, col, unnest(w) AS term, unnest(range(len(w))) AS pos FROM toks
)"""
TERM = "SELECT DISTINCT entry_id FROM post WHERE term = '{}'"


@query(f"{BASE} WHERE e.entry_id IN (SELECT entry_id FROM post WHERE term = 'ereron') AND NOT s.is_read {NEWEST} LIMIT 100", TOKENS)
def sel_query(a: Archive) -> DataFrame:
    """Full text as one of a selection's conditions; the order stays by date."""
    return select_entries(a, Selection(query="ereron", unread_only=True, limit=100)).select(*ENTRY)


@query(f"{BASE} WHERE NOT s.is_read AND e.published_at_ms >= {NOW_MS - 14 * DAY_MS} {NEWEST} LIMIT 100")
def saved_search_window(a: Archive) -> DataFrame:
    return select_entries(a, SavedSearch("fortnight", Selection(unread_only=True, limit=100), days=14).at(NOW_MS)).select(*ENTRY)


@query("SELECT e.entry_id, e.feed_id FROM entries e WHERE contains(lower(e.title), 'then') OR contains(lower(e.body_text), 'then')")
def like_search(a: Archive) -> DataFrame:
    return search.contains(a.entries, " then ", ("title", "body_text")).select("entry_id", "feed_id")


@query("SELECT e.entry_id FROM entries e JOIN feeds f ON e.feed_id = f.feed_id WHERE f.folder_id = 'N3'")
def sel_folder_direct(a: Archive) -> DataFrame:
    """The small client's filter: a folder's own feeds only."""
    return a.entries.join(a.feeds.filter("folder_id = 'N3'"), "feed_id", "left_semi").select("entry_id")


def fts(name: str, text: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.match(Archive(spark, sf_dir), text)

    Q[name], SQL[name] = run, sql(oracle, TOKENS)


fts("fts_match_and", "then with", f"{TERM.format('then')} INTERSECT {TERM.format('with')}")
fts("fts_match_or", "ereron OR una", f"{TERM.format('ereron')} UNION {TERM.format('una')}")
fts("fts_match_not", "the NOT with", f"{TERM.format('the')} EXCEPT {TERM.format('with')}")
fts("fts_phrase", '"of the"', "SELECT DISTINCT a.entry_id FROM post a JOIN post b ON a.entry_id = b.entry_id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
@query("SELECT DISTINCT a.entry_id FROM post a JOIN post b ON a.entry_id = b.entry_id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = 'of' AND starts_with(b.term, 'th')", TOKENS)
def fts_stored(a: Archive) -> DataFrame:
    """A phrase in a stored index: written for two thirds of the entries, brought up to date with the others, and read where
    the phrase's terms lie."""

    class Part:
        def __init__(self, rows: DataFrame):
            self.entries = rows

    old, late = Part(a.entries.filter("entry_id % 3 <> 0")), Part(a.entries.filter("entry_id % 3 = 0"))
    first = search.write_index(search.postings(old), shared(a.spark, "index"))
    index = search.appended_index(first, late, shared(a.spark, "index"))
    return search.match(a, '"of th"*', index)


fts("fts_prefix", "erer*", "SELECT DISTINCT entry_id FROM post WHERE starts_with(term, 'erer')")
fts("fts_column", "title:the", "SELECT DISTINCT entry_id FROM post WHERE term = 'the' AND col = 'title'")
fts("fts_first", "^the", "SELECT DISTINCT entry_id FROM post WHERE term = 'the' AND pos = 0")
fts("fts_near", "NEAR(with that, 3)", "SELECT DISTINCT a.entry_id FROM post a JOIN post b ON a.entry_id = b.entry_id AND a.col = b.col WHERE a.term = 'with' AND b.term = 'that' AND abs(a.pos - b.pos) - 1 <= 3")


@query(
    """SELECT entry_id, round(rank, 6) AS rank FROM (
  SELECT t.entry_id, -sum(greatest(1e-6, ln((z.n - d.df + 0.5) / (d.df + 0.5))) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.len / z.mean))) AS rank
  FROM (SELECT entry_id, term, count(*) AS tf FROM post WHERE term IN ('ereron', 'una', 'then', 'nicht') GROUP BY entry_id, term) t
  JOIN (SELECT term, count(DISTINCT entry_id) AS df FROM post GROUP BY term) d ON t.term = d.term
  JOIN (SELECT entry_id, sum(len(w)) AS len FROM toks GROUP BY entry_id) l ON t.entry_id = l.entry_id
  CROSS JOIN (SELECT count(DISTINCT entry_id) AS n, sum(len(w)) / count(DISTINCT entry_id) AS mean FROM toks) z
  GROUP BY t.entry_id ORDER BY rank, t.entry_id LIMIT 50) x""",
    TOKENS,
)
def bm25_topk(a: Archive) -> DataFrame:
    """The best entries from a stored index, of whose blocks only those are read that can hold one."""
    index = ranking.write_ranked(a, shared(a.spark, "ranked"))
    return ranking.search(index, ["ereron", "una", "then", "nicht"], 50).select("entry_id", F.round("rank", 6).alias("rank"))


CLOSURE = """tree AS (
  SELECT folder_id AS ancestor, folder_id FROM folders
  UNION SELECT t.ancestor, f.folder_id FROM folders f JOIN tree t ON f.parent_id = t.folder_id
)"""


@query("SELECT ancestor, folder_id FROM tree", CLOSURE)
def folder_closure(a: Archive) -> DataFrame:
    return closure(a.folders)


def unread(a: Archive) -> DataFrame:
    return a.entries.join(a.entry_state.filter(~F.col("is_read")), "entry_id").groupBy("feed_id").agg(F.count("*").alias("unread"))


UNREAD = "SELECT e.feed_id, count(*) AS unread FROM entries e JOIN entry_state s ON e.entry_id = s.entry_id WHERE NOT s.is_read GROUP BY e.feed_id"


@query(UNREAD)
def unread_by_feed(a: Archive) -> DataFrame:
    return unread(a)


@query(
    f"""SELECT t.ancestor AS folder_id, CAST(coalesce(sum(u.unread), 0) AS BIGINT) AS unread
FROM tree t LEFT JOIN (SELECT f.folder_id, sum(x.unread) AS unread FROM ({UNREAD}) x JOIN feeds f ON x.feed_id = f.feed_id GROUP BY f.folder_id) u ON t.folder_id = u.folder_id
GROUP BY t.ancestor""",
    CLOSURE,
)
def folder_unread_rollup(a: Archive) -> DataFrame:
    """A folder's unread entries and those of all below."""
    own = unread(a).join(a.feeds, "feed_id").groupBy("folder_id").agg(F.sum("unread").alias("unread"))
    return rollup(a.folders, own, "unread")


@query(
    f"""SELECT t.ancestor AS folder_id, CAST(coalesce(sum(u.unread), 0) AS BIGINT) AS unread
FROM tree t LEFT JOIN (SELECT f.folder_id, sum(x.unread) AS unread FROM ({UNREAD}) x JOIN feeds f ON x.feed_id = f.feed_id GROUP BY f.folder_id) u ON t.folder_id = u.folder_id
GROUP BY t.ancestor""",
    CLOSURE,
)
def folder_unread_maintained(a: Archive) -> DataFrame:
    """The same counts, kept: counted once on an older state, then moved by two batches of changes."""
    now = a.entry_state.select("entry_id", "is_read")
    before = now.filter("entry_id % 5 <> 0").withColumn("is_read", F.when(F.col("entry_id") % 2 == 0, ~F.col("is_read")).otherwise(F.col("is_read")))
    pairs, places = closure(a.folders), a.entries.select("entry_id", "feed_id")
    old = before.filter("NOT is_read").join(places, "entry_id").join(a.feeds, "feed_id").groupBy("folder_id").agg(F.count("*").alias("unread"))
    counts = pairs.join(old, "folder_id", "left").groupBy(F.col("ancestor").alias("folder_id")).agg(F.coalesce(F.sum("unread"), F.lit(0)).alias("unread"))
    for batch in (now.filter("entry_id % 2 = 0 AND entry_id % 5 <> 0"), now.filter("entry_id % 5 = 0")):
        changes = counters.unread_changes(places, before, batch)
        counts = counters.moved(counts, counters.folder_changes(changes, a.feeds, pairs), "folder_id")
    return counts


@query(f"SELECT f.folder_id, CAST(sum(x.unread) AS BIGINT) AS unread FROM ({UNREAD}) x JOIN feeds f ON x.feed_id = f.feed_id GROUP BY f.folder_id")
def folder_unread_direct(a: Archive) -> DataFrame:
    """The small client's count: own feeds only."""
    return unread(a).join(a.feeds, "feed_id").groupBy("folder_id").agg(F.sum("unread").alias("unread"))


@query("""SELECT count(*) AS entries, count(DISTINCT e.feed_id) AS feeds, CAST(count_if(NOT s.is_read) AS BIGINT) AS unread, CAST(count_if(s.starred) AS BIGINT) AS starred,
  count(*) - count(s.is_read) AS stateless FROM entries e LEFT JOIN entry_state s ON e.entry_id = s.entry_id""")
def archive_stats(a: Archive) -> DataFrame:
    rows = a.entries.join(a.entry_state, "entry_id", "left")
    return rows.agg(F.count("*").alias("entries"), F.countDistinct("feed_id").alias("feeds"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if("starred").alias("starred"), (F.count("*") - F.count("is_read")).alias("stateless"))


@query("SELECT feed_id, CAST(sum(strlen(body_text)) AS BIGINT) AS raw_bytes, count(*) AS entries, round(sum(strlen(body_text)) / greatest(count(*), 1), 6) AS mean_bytes FROM entries GROUP BY feed_id")
def storage_stats(a: Archive) -> DataFrame:
    size = F.sum(F.octet_length("body_text").cast("long"))
    return a.entries.groupBy("feed_id").agg(size.alias("raw_bytes"), F.count("*").alias("entries"), F.round(size / F.greatest(F.count("*"), F.lit(1)), 6).alias("mean_bytes"))


@query("SELECT feed_id, count(*) AS entries, max(published_at_ms) AS newest_ms FROM entries GROUP BY feed_id")
def entries_per_feed(a: Archive) -> DataFrame:
    return a.entries.groupBy("feed_id").agg(F.count("*").alias("entries"), F.max("published_at_ms").alias("newest_ms"))


@query(f"""SELECT f.feed_id, coalesce(nullif(f.custom_title, ''), nullif(f.title, ''), f.url) AS display_title, f.folder_id, d.name AS folder_name, coalesce(u.unread, 0) AS unread
FROM feeds f LEFT JOIN folders d ON f.folder_id = d.folder_id LEFT JOIN ({UNREAD}) u ON f.feed_id = u.feed_id""")
def feed_listing(a: Archive) -> DataFrame:
    rows = a.feeds.join(a.folders.select("folder_id", F.col("name").alias("folder_name")), "folder_id", "left").join(unread(a), "feed_id", "left")
    return rows.select("feed_id", T.display_title(F.col("custom_title"), F.col("title"), F.col("url")).alias("display_title"), "folder_id", "folder_name", F.coalesce("unread", F.lit(0)).alias("unread")).orderBy("display_title", "feed_id")


def tag_lists(a: Archive) -> DataFrame:
    return a.entry_tags.filter(~F.col("deleted")).groupBy("entry_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))


TAGS = "SELECT entry_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM entry_tags WHERE NOT deleted GROUP BY entry_id"


@query(f"SELECT e.entry_id, e.title, s.is_read, s.starred, coalesce(t.tags, '') AS tags FROM entries e JOIN entry_state s ON e.entry_id = s.entry_id LEFT JOIN ({TAGS}) t ON e.entry_id = t.entry_id {NEWEST} LIMIT 100")
def entry_list_with_tags(a: Archive) -> DataFrame:
    """The page is cut first; only its rows meet the tags."""
    page = select_entries(a, Selection(limit=100))
    return page.join(tag_lists(a), "entry_id", "left").select("entry_id", "title", "is_read", "starred", F.coalesce("tags", F.lit("")).alias("tags"))


@query(f"SELECT e.entry_id, e.title, e.body_text, f.title AS feed_title, s.is_read, coalesce(t.tags, '') AS tags FROM entries e JOIN entry_state s ON e.entry_id = s.entry_id JOIN feeds f ON e.feed_id = f.feed_id LEFT JOIN ({TAGS}) t ON e.entry_id = t.entry_id WHERE s.starred")
def entry_detail(a: Archive) -> DataFrame:
    rows = select_entries(a, Selection(starred_only=True)).join(a.feeds.select("feed_id", F.col("title").alias("feed_title")), "feed_id").join(tag_lists(a), "entry_id", "left")
    return rows.select("entry_id", "title", "body_text", "feed_title", "is_read", F.coalesce("tags", F.lit("")).alias("tags"))


@query("SELECT t.tag, count(*) AS entries, CAST(count_if(t.deleted) AS BIGINT) AS tombstones FROM entry_tags t GROUP BY t.tag")
def tag_counts(a: Archive) -> DataFrame:
    return a.entry_tags.groupBy("tag").agg(F.count("*").alias("entries"), F.count_if("deleted").alias("tombstones"))


@query("SELECT p.folder_id, string_agg(c.folder_id, ',' ORDER BY c.name) AS children, count(*) AS n FROM folders p JOIN folders c ON c.parent_id = p.folder_id GROUP BY p.folder_id")
def tree_grouping(a: Archive) -> DataFrame:
    c = a.folders.filter("parent_id IS NOT NULL")
    return c.groupBy(F.col("parent_id").alias("folder_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "folder_id"))), lambda x: x["folder_id"]), ",").alias("children"), F.count("*").alias("n"))


# ingest


@query("""SELECT e.entry_id, f.entry_id AS duplicate_of FROM entries e JOIN (
  SELECT content_hash, arg_min({'e': entry_id, 'f': feed_id}, entry_id) AS x, min(entry_id) AS entry_id FROM entries GROUP BY content_hash) f ON e.content_hash = f.content_hash
WHERE e.entry_id <> f.entry_id AND e.feed_id <> f.x.f""")
def dup_cross_feed(a: Archive) -> DataFrame:
    return ingest.duplicates(a.entries)


def batches(a: Archive) -> tuple[DataFrame, DataFrame]:
    """An archive of half the entries, and a batch: a third of those again (some edited), and the other half."""
    rows = a.entries.select("entry_id", "feed_id", F.sha2(F.col("entry_id").cast("string"), 256).alias("guid_hash"), "content_hash")
    old = rows.filter("entry_id % 2 = 0")
    edited = F.when((F.col("entry_id") % 12 == 0), F.lit("edited")).otherwise(F.col("content_hash"))
    return old, rows.filter("entry_id % 2 = 1 OR entry_id % 3 = 0").withColumn("content_hash", edited)


ACTION = "CASE WHEN entry_id % 2 = 1 THEN 'insert' WHEN entry_id % 12 = 0 THEN 'update' ELSE 'skip' END"


@query(f"SELECT entry_id, feed_id, {ACTION} AS action FROM entries WHERE entry_id % 2 = 1 OR entry_id % 3 = 0")
def ingest_classify(a: Archive) -> DataFrame:
    old, batch = batches(a)
    return ingest.classify(batch, old).select("entry_id", "feed_id", "action")


@query(f"""SELECT feed_id, CAST(count_if(act = 'insert') AS BIGINT) AS new, CAST(count_if(act = 'update') AS BIGINT) AS updated, CAST(count_if(act = 'skip') AS BIGINT) AS skipped
FROM (SELECT feed_id, {ACTION} AS act FROM entries WHERE entry_id % 2 = 1 OR entry_id % 3 = 0) x GROUP BY feed_id""")
def ingest_summary(a: Archive) -> DataFrame:
    old, batch = batches(a)
    return ingest.summary(ingest.classify(batch, old))


@query("SELECT entry_id, feed_id, CASE WHEN entry_id % 12 = 0 THEN 'edited' ELSE content_hash END AS content_hash FROM entries")
def ingest_merge(a: Archive) -> DataFrame:
    """The archive after the batch: inserts added, edits in place."""
    old, batch = batches(a)
    return ingest.merge(old, ingest.classify(batch, old)).select("entry_id", "feed_id", "content_hash")


def stored(a: Archive) -> tuple[partitioned.PartitionedArchive, DataFrame]:
    """The archive of ``batches`` in partitions, and its batch."""
    times = a.entries.select("entry_id", "published_at_ms")
    old, batch = (rows.join(times, "entry_id") for rows in batches(a))
    return partitioned.create(old, shared(a.spark, "archive")), batch


@query(f"SELECT entry_id, feed_id, {ACTION} AS action FROM entries WHERE entry_id % 2 = 1 OR entry_id % 3 = 0")
def ingest_filtered(a: Archive) -> DataFrame:
    """The batch classified against filters of known keys, and against the slots of keys that may be known."""
    return partitioned.classify(*stored(a)).select("entry_id", "feed_id", "action")


@query(f"""SELECT entry_id, feed_id, CASE WHEN entry_id % 12 = 0 THEN 'edited' ELSE content_hash END AS content_hash, published_at_ms // {DAY_MS} AS day FROM entries""")
def merge_by_partition(a: Archive) -> DataFrame:
    """The archive after the batch, which wrote only the partitions that it touched; applied twice, as after a failure."""
    archive, batch = stored(a)
    partitioned.apply(archive, batch)
    partitioned.apply(archive, batch)
    return archive.entries.select("entry_id", "feed_id", "content_hash", "day")


@query("""SELECT entry_id, feed_id, pos FROM (SELECT entry_id, feed_id, entry_id // 20 AS pos, row_number() OVER (PARTITION BY feed_id, content_hash ORDER BY entry_id // 20, entry_id) AS n FROM entries) x WHERE n = 1""")
def indoc_guid_dedup(a: Archive) -> DataFrame:
    items = a.entries.select("entry_id", "feed_id", F.col("content_hash").alias("guid_hash"), F.struct(F.floor(F.col("entry_id") / 20).alias("p"), "entry_id").alias("pos"))
    return ingest.first_in_document(items).select("entry_id", "feed_id", F.col("pos.p").alias("pos"))


@query("""SELECT user_id AS entity_id, event_id AS visit, event_type AS seen FROM (
  SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) x WHERE before IS NULL OR before <> event_type""")
def content_changed(a: Archive) -> DataFrame:
    visits = a.table("events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("visit"), F.col("event_type").alias("seen"))
    return ingest.changed_since_last(visits, "entity_id", "visit", "seen")


@query("SELECT e.entry_id, b.item_id FROM entries e JOIN benchmark b ON contains(e.body_text, b.text) WHERE len(string_split(trim(regexp_replace(b.text, '\\s+', ' ', 'g')), ' ')) >= 8")
def syndication_contains(a: Archive) -> DataFrame:
    return ingest.syndicated(a.entries, a.table("benchmark"))


def fetch_log(a: Archive) -> tuple[DataFrame, DataFrame]:
    number = F.substring("feed_id", 4, 10).cast("int")
    feeds = a.feeds.select("feed_id", (number % 4).alias("error_count"), (F.lit(600) + number * 300).alias("interval_s"), F.lit(1800).alias("default_s"), (number % 5 == 0).alias("watched"), (F.lit(NOW_MS) - number * 60_000 + 400_000).alias("next_fetch_ms"), (number % 6 != 1).alias("enabled"), (number % 9 == 8).alias("deleted"))
    status = F.when(number % 4 == 1, "error").when(number % 4 == 2, "not_modified").otherwise("ok")
    results = a.entries.groupBy("feed_id").agg(F.count_if(F.col("entry_id") % 50 == 0).alias("fresh"))
    return feeds, results.filter(number % 7 != 3).select("feed_id", status.alias("status"), F.when(status == "ok", F.col("fresh")).otherwise(0).alias("new"), F.when(status == "error", F.lit("HTTP 500")).alias("error"))


FETCHES = """fx AS (SELECT feed_id, CAST(substr(feed_id, 4) AS INTEGER) AS n FROM feeds), fr AS (
  SELECT x.feed_id, x.n, (x.n % 7 <> 3) AS fetched, x.n % 4 = 1 AS failed, x.n % 4 AS e0, 600 + x.n * 300 AS i0, x.n % 5 = 0 AS watched,
         CASE WHEN x.n % 4 IN (0, 3) THEN (SELECT count(*) FROM entries e WHERE e.feed_id = x.feed_id AND e.entry_id % 50 = 0) ELSE 0 END AS fresh FROM fx x
), fi AS (
  SELECT *, CASE WHEN NOT fetched THEN e0 WHEN failed THEN e0 + 1 ELSE 0 END AS e1,
    CASE WHEN failed THEN 1800 * pow(2, least(e0, 6)) WHEN fresh > 0 THEN greatest(1800, i0 * 0.5) ELSE i0 * 1.5 END AS w FROM fr
)"""


@query(
    f"""SELECT feed_id, CAST(e1 AS INTEGER) AS error_count, CAST(CASE WHEN fetched THEN floor(greatest(1800, least(w, 86400))) ELSE i0 END AS BIGINT) AS interval_s,
  CAST(CASE WHEN fetched THEN {NOW_MS} + CAST(floor(greatest(1800, least(w, 86400))) AS BIGINT) * 1000 ELSE {NOW_MS} - n * 60000 + 400000 END AS BIGINT) AS next_fetch_ms,
  CASE WHEN fetched AND failed THEN 'HTTP 500' END AS last_error FROM fi""",
    FETCHES,
)
def feed_bookkeeping(a: Archive) -> DataFrame:
    """Intervals and errors after a round of fetches."""
    feeds, results = fetch_log(a)
    return ingest.bookkeeping(feeds, results, NOW_MS).select("feed_id", F.col("error_count").cast("int").alias("error_count"), F.col("interval_s").cast("long").alias("interval_s"), F.col("next_fetch_ms").cast("long").alias("next_fetch_ms"), "last_error")


@query(f"SELECT feed_id, CAST({NOW_MS} - n * 60000 + 400000 AS BIGINT) AS next_fetch_ms FROM fx WHERE n % 6 <> 1 AND n % 9 <> 8 AND {NOW_MS} - n * 60000 + 400000 <= {NOW_MS} ORDER BY 2, 1 LIMIT 10", FETCHES)
def due_feeds(a: Archive) -> DataFrame:
    return ingest.due(fetch_log(a)[0], NOW_MS, 10).select("feed_id", F.col("next_fetch_ms").cast("long").alias("next_fetch_ms"))


# delivery


def alerts(a: Archive) -> DataFrame:
    return a.ops.select(F.col("field").alias("key"), F.col("seq").alias("pos"), "ts_ms", F.concat(F.lit("Rule "), "field").alias("title"), F.concat(F.lit("op "), F.col("seq").cast("string")).alias("body"), (F.col("seq") % 5).alias("priority"), F.col("device_id").alias("tag"))


BUCKETS = """ord AS (
  SELECT field AS key, seq AS pos, ts_ms, device_id AS tag, row_number() OVER (PARTITION BY field ORDER BY seq) AS n FROM ops
), fold AS (
  SELECT key, n, pos, ts_ms, ts_ms AS first, CAST(1 AS BIGINT) AS bucket FROM ord WHERE n = 1
  UNION ALL
  SELECT o.key, o.n, o.pos, o.ts_ms, CASE WHEN abs(o.ts_ms - f.first) > 300000 THEN o.ts_ms ELSE f.first END, CASE WHEN abs(o.ts_ms - f.first) > 300000 THEN f.bucket + 1 ELSE f.bucket END
  FROM fold f JOIN ord o ON o.key = f.key AND o.n = f.n + 1
)"""


@query("SELECT key, bucket, count(*) AS count, min(ts_ms) AS first_ts_ms, min(pos) AS first_pos FROM fold GROUP BY key, bucket", BUCKETS)
def notify_coalesce(a: Archive) -> DataFrame:
    """Buckets anchored at their first notification."""
    rows = delivery.coalesce_notifications(alerts(a))
    return rows.groupBy("key", "bucket").agg(F.count("*").alias("count"), F.min("ts_ms").alias("first_ts_ms"), F.min("pos").alias("first_pos"))


@query("SELECT key, bucket, count(*) AS count, min(ts_ms) AS first_ts_ms, min(pos) AS first_pos FROM fold GROUP BY key, bucket", BUCKETS)
def stream_coalesce(a: Archive) -> DataFrame:
    """The same buckets from a stream, told as event time passes their ends; a tick at the end closes the last."""
    at, rows = shared(a.spark, "told"), alerts(a).select("key", "pos", "ts_ms")
    rows.repartition(2, "key").write.parquet(f"{at}/rows")  # a key's rows lie in one file, so no batch breaks their order
    rows.agg(F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("pos"), (F.max("ts_ms") + 500 * DAY_MS).alias("ts_ms")).write.mode("append").parquet(f"{at}/rows")
    with stateful.rocksdb(a.spark):
        stream = stateful.coalesced(jobs.read_log(a.spark, f"{at}/rows", rows.schema), "400 days")
        return jobs.run_once(stream, "told", "append", f"{at}/state")


@query(
    """SELECT key, bucket, CAST(max(count) AS BIGINT) AS count, 'Rule ' || key AS title, max(first_ts_ms) AS first_ts_ms, max(priority) AS priority,
  string_agg('op ' || CAST(pos AS VARCHAR), chr(10) ORDER BY pos) || CASE WHEN max(count) > 5 THEN chr(10) || '… ' || CAST(max(count) - 5 AS VARCHAR) || ' more' ELSE '' END AS body
FROM (SELECT key, bucket, pos, count(*) OVER (PARTITION BY key, bucket) AS count, min(ts_ms) OVER (PARTITION BY key, bucket) AS first_ts_ms, max(pos % 5) OVER (PARTITION BY key, bucket) AS priority, row_number() OVER (PARTITION BY key, bucket ORDER BY pos) AS k FROM fold) x
WHERE k <= 5 GROUP BY key, bucket""",
    BUCKETS,
)
def notify_merged(a: Archive) -> DataFrame:
    rows = delivery.merged_notifications(delivery.coalesce_notifications(alerts(a)))
    return rows.select("key", "bucket", "count", "title", "first_ts_ms", "priority", "body")


BUDGET = delivery.mail_budget(200_000)
MAILS = f"""art AS (
  SELECT feed_id, entry_id, CAST(floor(strlen(body_text) * CAST(0.35 AS DOUBLE)) AS BIGINT) + 2048 AS weight, row_number() OVER (PARTITION BY feed_id ORDER BY entry_id) AS n FROM entries
), pk AS (
  SELECT feed_id, entry_id, n, weight, weight AS held, CAST(1 AS BIGINT) AS batch FROM art WHERE n = 1
  UNION ALL
  SELECT a.feed_id, a.entry_id, a.n, a.weight, CASE WHEN p.held + a.weight > {BUDGET} THEN a.weight ELSE p.held + a.weight END, CASE WHEN p.held + a.weight > {BUDGET} THEN p.batch + 1 ELSE p.batch END
  FROM pk p JOIN art a ON a.feed_id = p.feed_id AND a.n = p.n + 1
)"""


@query("SELECT feed_id, entry_id, weight, batch FROM pk", MAILS)
def email_batches(a: Archive) -> DataFrame:
    """Articles of each feed in mails of bounded size."""
    rows = a.entries.select("feed_id", "entry_id", delivery.article_weight(F.col("body_text")).alias("weight"))
    return delivery.greedy_batches(rows, BUDGET, "feed_id", ("entry_id",))


PICKED = """picked AS (
  SELECT e.entry_id, coalesce(nullif(f.custom_title, ''), nullif(f.title, ''), f.url) AS section, e.published_at_ms, e.title, e.body_text
  FROM entries e JOIN entry_state s ON e.entry_id = s.entry_id JOIN feeds f ON e.feed_id = f.feed_id WHERE NOT s.is_read ORDER BY e.published_at_ms DESC, e.entry_id LIMIT 60
)"""


def picked(a: Archive) -> DataFrame:
    rows = select_entries(a, Selection(unread_only=True, limit=60)).join(a.feeds.select("feed_id", T.display_title(F.col("custom_title"), F.col("title"), F.col("url")).alias("feed_title")), "feed_id")
    return delivery.sections(rows, F.col("feed_title"))


@query("SELECT section, CAST(dense_rank() OVER (ORDER BY lower(section), section) AS INTEGER) AS section_no, CAST(row_number() OVER (PARTITION BY section ORDER BY published_at_ms DESC, entry_id) AS INTEGER) AS place, entry_id FROM picked", PICKED)
def magazine_sections(a: Archive) -> DataFrame:
    return picked(a).select("section", "section_no", "place", "entry_id")


@query("SELECT count(*) AS articles, CAST(sum(w) AS BIGINT) AS words, CAST(CASE WHEN sum(w) = 0 THEN 0 ELSE greatest(1, ceil(sum(w) / 220)) END AS BIGINT) AS minutes FROM (SELECT len(list_filter(string_split_regex(body_text, '\\s+'), lambda x: x <> '')) AS w FROM picked) y", PICKED)
def magazine_stats(a: Archive) -> DataFrame:
    rows = picked(a).agg(F.count("*").alias("articles"), F.sum(T.count_words(F.col("body_text"))).cast("long").alias("words"))
    return rows.select("articles", "words", T.reading_minutes(F.col("words")).alias("minutes"))


@query("""SELECT entry_id, CASE WHEN n = 1 THEN stem ELSE stem || '-' || CAST(n AS VARCHAR) END AS file_name FROM (
  SELECT entry_id, lang || '-' || feed_id AS stem, row_number() OVER (PARTITION BY lang, feed_id ORDER BY published_at_ms, entry_id) AS n FROM entries) x""")
def filename_dedupe(a: Archive) -> DataFrame:
    return delivery.numbered_stems(a.entries.withColumn("stem", F.concat_ws("-", "lang", "feed_id"))).select("entry_id", "file_name")


@query("""SELECT entry_id, feed_id, next_unread_id FROM (
  SELECT e.entry_id, e.feed_id, first_value(CASE WHEN NOT s.is_read THEN e.entry_id END IGNORE NULLS) OVER (PARTITION BY e.feed_id ORDER BY e.published_at_ms DESC, e.entry_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_unread_id
  FROM entries e JOIN entry_state s ON e.entry_id = s.entry_id) x""")
def next_unread(a: Archive) -> DataFrame:
    rows = a.entries.join(a.entry_state, "entry_id").withColumn("newest", -F.col("published_at_ms"))
    return delivery.next_unread(rows, "feed_id", ("newest", "entry_id")).select("entry_id", "feed_id", "next_unread_id")


@query("SELECT e.entry_id, 'read' AS field, 'true' AS val FROM entries e JOIN entry_state s ON e.entry_id = s.entry_id WHERE e.feed_id = 'src3' AND NOT s.is_read")
def mark_feed_read(a: Archive) -> DataFrame:
    """The writes that mark a feed read."""
    return select_entries(a, Selection(feed_ids=["src3"], unread_only=True)).select("entry_id", F.lit("read").alias("field"), F.lit("true").alias("val"))


@query("SELECT entry_id, CAST(min(part) AS INTEGER) AS part FROM (SELECT entry_id, 0 AS part FROM entries WHERE entry_id % 97 = 0 UNION ALL SELECT entry_id, 1 FROM entry_state WHERE starred) x GROUP BY entry_id")
def export_ids(a: Archive) -> DataFrame:
    """Explicit ids, then selected ones that aren't among them."""
    explicit = a.entries.filter("entry_id % 97 = 0").select("entry_id", F.col("entry_id").alias("pos"))
    return delivery.union_ids(explicit, a.entry_state.filter("starred").select("entry_id", F.col("entry_id").alias("pos"))).select("entry_id", "part")


@query(f"SELECT e.entry_id, concat_ws(' · ', nullif(f.custom_title, ''), nullif(e.lang, ''), strftime(make_timestamp(e.published_at_ms * 1000), '%Y-%m-%d')) AS line FROM entries e JOIN feeds f ON e.feed_id = f.feed_id")
def meta_line(a: Archive) -> DataFrame:
    return a.entries.join(a.feeds.select("feed_id", "custom_title"), "feed_id").select("entry_id", T.meta_line(F.col("custom_title"), F.col("lang"), T.iso_date(F.col("published_at_ms"))).alias("line"))


@query("""SELECT target, job_id, status FROM (SELECT event_type AS target, event_id AS job_id, 'running' AS status, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events WHERE user_id % 3 <> 0) x WHERE n = 1""")
def job_claim(a: Archive) -> DataFrame:
    """The oldest pending export of each target."""
    jobs = a.ops.select(F.col("seq").alias("job_id"), F.col("field").alias("target"), F.col("ts_ms").alias("created_ms"), F.when(F.col("entity_id") % 3 == 0, "done").otherwise("pending").alias("status"))
    return delivery.claim(jobs).select("target", "job_id", "status")


@query("""SELECT c.conv_id, c.turn, (SELECT min(n.turn) FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn > c.turn AND n.role = 'user') AS next_user_turn FROM conversations c""")
def next_turn(a: Archive) -> DataFrame:
    """Next-unread on conversations: the next turn of the user."""
    rows = a.table("conversations").withColumn("seen", F.col("role") != "user")
    return delivery.next_unread(rows, "conv_id", ("turn",), "seen", "turn").select("conv_id", "turn", F.col("next_unread_id").alias("next_user_turn"))



"""Queries on table changes and on what is left of the scalar functions, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contentlake.bindings import NOW_MS, Archive, sql
from contentlake.functions import hashing as H
from contentlake.functions import html
from contentlake.functions import text as T
from contentlake.functions.sql import register
from contentlake.operators import delivery, tables
from contentlake.operators.selection import Selection, select_entries

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


PAGE = "SELECT e.entry_id FROM entries e JOIN entry_state s ON e.entry_id = s.entry_id ORDER BY e.published_at_ms DESC, e.entry_id LIMIT 80"


@query("SELECT entry_id, CASE WHEN entry_id % 4 = 0 THEN TRUE ELSE is_read END AS is_read, starred FROM entry_state UNION ALL SELECT entry_id, TRUE, FALSE FROM entries WHERE entry_id % 4 = 0 AND entry_id NOT IN (SELECT entry_id FROM entry_state)")
def state_upsert(a: Archive) -> DataFrame:
    """Every fourth entry is marked read, whether it has a state or not."""
    held = a.entry_state.select("entry_id", "starred")
    new = a.entries.filter("entry_id % 4 = 0").select("entry_id").join(held, "entry_id", "left").select("entry_id", F.lit(True).alias("is_read"), F.coalesce("starred", F.lit(False)).alias("starred"))
    return tables.upsert(a.entry_state, new, ["entry_id"])


@query("SELECT entry_id, FALSE AS is_read, FALSE AS starred FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM entry_state)")
def insert_defaults(a: Archive) -> DataFrame:
    """The state that entries start with that have none yet."""
    return tables.fan_out(a.entries.join(a.entry_state.select("entry_id"), "entry_id", "left_anti"))["entry_state"]


@query(f"SELECT 5000 + row_number() OVER (ORDER BY entry_id) AS seq, 'd1' AS device_id, 70 + row_number() OVER (ORDER BY entry_id) AS lamport, entry_id AS entity_id, 'read' AS field, 'true' AS val, {NOW_MS} AS ts_ms FROM ({PAGE}) p")
def journal_append(a: Archive) -> DataFrame:
    """A loaded page marked read, as rows of the change log."""
    page = select_entries(a, Selection(limit=80))
    return tables.journal(tables.mark_read(page), "d1", 70, 5000, NOW_MS)


@query("SELECT seq, entity_id FROM ops WHERE device_id = '9' AND seq >= 2000")
def outbox_clear(a: Archive) -> DataFrame:
    mine = a.ops.filter("device_id = '9'")
    return tables.acknowledged(mine, mine.filter("seq < 2000")).select("seq", "entity_id")


@query("SELECT count(*) AS waiting, count(DISTINCT entity_id) AS entities FROM ops WHERE device_id = '9'")
def outbox_count(a: Archive) -> DataFrame:
    return a.ops.filter("device_id = '9'").agg(F.count("*").alias("waiting"), F.countDistinct("entity_id").alias("entities"))


@query(f"SELECT entry_id FROM ({PAGE}) p WHERE entry_id % 3 <> 0")
def body_cache_missing(a: Archive) -> DataFrame:
    bodies = a.entries.filter("entry_id % 3 = 0").select("entry_id", "body_text")
    return tables.missing_bodies(select_entries(a, Selection(limit=80)), bodies).select("entry_id")


@query(f"SELECT entry_id, length(CASE WHEN entry_id % 2 = 0 AND length(body_text) > 500 THEN body_text ELSE substr(body_text, 1, 500) END) AS chars, CASE WHEN entry_id % 2 = 0 AND length(body_text) > 500 THEN {NOW_MS} END AS full_text_at FROM entries")
def body_replace(a: Archive) -> DataFrame:
    """Short bodies give way to longer fetched ones."""
    short = a.entries.select("entry_id", F.substring("body_text", 1, 500).alias("body_text"), F.lit(None).cast("long").alias("full_text_at"))
    done = tables.replace_bodies(short, a.entries.filter("entry_id % 2 = 0").select("entry_id", "body_text"), NOW_MS)
    return done.select("entry_id", F.length("body_text").cast("long").alias("chars"), F.col("full_text_at").cast("long").alias("full_text_at"))


@query("SELECT seq FROM ops WHERE entity_id % 3 = 0 AND entity_id % 2 = 0")
def pending_prefix(a: Archive) -> DataFrame:
    """Parked tag ops carry entry and tag in one id."""
    parked = a.ops.filter("entity_id % 3 = 0").select("seq", F.concat(F.col("entity_id").cast("string"), F.when(F.col("seq") % 2 == 0, F.lit(":tag")).otherwise(F.lit(""))).alias("entity_id"))
    arrived = a.ops.filter("entity_id % 2 = 0").select(F.col("entity_id").cast("string").alias("entry_id")).distinct()
    return tables.ready(parked, arrived).select("seq")


@query("SELECT entry_id, tag, deleted OR tag = 'long' AS deleted FROM entry_tags")
def tag_tombstones(a: Archive) -> DataFrame:
    return tables.tombstoned(a.entry_tags, F.col("tag") == "long")


@query("SELECT entry_id, CAST(day(t) AS VARCHAR) || ' ' || list_extract(['de enero', 'de febrero', 'de marzo', 'de abril', 'de mayo', 'de junio', 'de julio', 'de agosto', 'de septiembre', 'de octubre', 'de noviembre', 'de diciembre'], month(t)) || ' ' || CAST(year(t) AS VARCHAR) AS day FROM (SELECT entry_id, make_timestamp(published_at_ms * 1000) AS t FROM entries) x")
def long_dates(a: Archive) -> DataFrame:
    months = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
    return a.entries.select("entry_id", T.long_date(F.col("published_at_ms"), [f"de {m}" for m in months]).alias("day"))


@query("SELECT page_id, substr(sha1(url), 1, 16) AS asset FROM pages")
def asset_names(a: Archive) -> DataFrame:
    return a.table("pages").select("page_id", H.asset_name(F.col("url")).alias("asset"))


@query("SELECT entry_id, trim(replace(lower(strip_accents(title)), 'ß', 'ss')) AS folded FROM entries")
def sql_functions(a: Archive) -> DataFrame:
    """The registered functions in a SQL text."""
    register(a.spark)
    return a.spark.sql("SELECT entry_id, fold(title) AS folded FROM {rows}", rows=a.entries)


@query("SELECT page_id, unnest([regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a.png', regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/b.png']) AS image FROM pages")
def page_images(a: Archive) -> DataFrame:
    """Addresses of images in cleaned pages, each once."""
    clean = html.html_article(F.concat(F.col("html"), F.lit('<img data-src="/a.png"><img src="/b.png"><img src="/b.png"><img src="/track/pixel.gif">')), F.col("url"))
    rows = a.table("pages").select("page_id", "url", clean.alias("clean"))
    return rows.select("page_id", F.explode(html.html_images(F.col("clean"), F.col("url"))).alias("image"))


@query("SELECT entry_id, is_read, starred FROM entry_state WHERE FALSE")
def replica_wiped(a: Archive) -> DataFrame:
    """A replica's table after a wipe."""
    return tables.emptied(a.entry_state).select("entry_id", "is_read", "starred")


@query("""SELECT c.device_id, CAST(0 AS BIGINT) AS last_seq, c.last_seen_ms, CAST(n.n AS BIGINT) AS rows_before, CAST(0 AS BIGINT) AS rows_after
FROM sync_clients c CROSS JOIN (SELECT (SELECT count(*) FROM entries) + (SELECT count(*) FROM entry_state) + (SELECT count(*) FROM entry_tags) + (SELECT count(*) FROM ops) AS n) n""")
def replica_reset(a: Archive) -> DataFrame:
    """A wiped replica: rows of its tables before and after, beside its devices, which stay with new cursors."""
    replica = {"entries": a.entries, "entry_state": a.entry_state, "entry_tags": a.entry_tags, "ops": a.ops, "device": a.sync_clients}
    after = tables.wiped(replica)
    total = lambda ts, name: reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")) for k, t in ts.items() if k != "device")).agg(F.sum("n").alias(name))
    return after["device"].crossJoin(F.broadcast(total(replica, "rows_before"))).crossJoin(F.broadcast(total(after, "rows_after")))  # one row each


LIMIT = 30_000
WEIGHTS = "art AS (SELECT feed_id, entry_id, entry_id % 16 AS g, CAST(floor(strlen(body_text) * CAST(0.35 AS DOUBLE)) AS BIGINT) + 2048 AS weight, row_number() OVER (PARTITION BY feed_id, entry_id % 16 ORDER BY entry_id) - 1 AS pos FROM entries), p0 AS (SELECT *, '' AS part FROM art)"
ROUND = """, p{n} AS (SELECT p.feed_id, p.entry_id, p.g, p.weight, p.pos, p.part || CASE WHEN l.m IS NULL THEN '' WHEN p.pos < l.m THEN 'a' ELSE 'b' END AS part
  FROM p{k} p LEFT JOIN (SELECT feed_id, g, part, min(pos) + count(*) // 2 AS m FROM p{k} GROUP BY feed_id, g, part HAVING sum(weight) > {limit} AND count(*) > 1) l ON p.feed_id = l.feed_id AND p.g = l.g AND p.part = l.part)"""


@query("SELECT feed_id, entry_id, part FROM p3", WEIGHTS + "".join(ROUND.format(n=k + 1, k=k, limit=LIMIT) for k in range(3)))
def email_halving(a: Archive) -> DataFrame:
    """Mails that turned out too large, cut into halves three times at most."""
    group = F.concat("feed_id", F.lit("/"), (F.col("entry_id") % 16).cast("string"))
    rows = a.entries.select("feed_id", "entry_id", group.alias("mail"), delivery.article_weight(F.col("body_text")).alias("weight"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("mail").orderBy("entry_id")) - 1)
    return delivery.halved(rows, LIMIT, "mail", depth=3).select("feed_id", "entry_id", "part")

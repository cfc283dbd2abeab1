"""Queries on scalar functions and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.bindings import EPOCH_MS, Archive, sql
from contentlake.functions import hashing as H
from contentlake.functions import text as T
from contentlake.operators import ingest, rules

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


FOLD = "trim(replace(lower(strip_accents({})), 'ß', 'ss'))"


@query(f"SELECT entry_id, {FOLD.format('title')} AS folded FROM entries")
def text_fold(a: Archive) -> DataFrame:
    return a.entries.select("entry_id", T.fold(F.col("title")).alias("folded"))


@query(f"SELECT entry_id, {FOLD.format('title')} AS folded FROM entries")
def text_fold_exact(a: Archive) -> DataFrame:
    """Folding for any script: a vectorised function."""
    return a.entries.select("entry_id", T.fold_exact(F.col("title")).alias("folded"))


ONE = "trim(regexp_replace(body_text, '\\s+', ' ', 'g'))"


@query(f"""SELECT entry_id, CASE WHEN length(x) <= 120 THEN x ELSE regexp_replace(CASE WHEN instr(reverse(h), ' ') > 0 AND 120 - instr(reverse(h), ' ') > 72 THEN substr(h, 1, CAST(120 - instr(reverse(h), ' ') AS BIGINT)) ELSE h END, '[ ,;:.\\-]+$', '') || '…' END AS summary
FROM (SELECT entry_id, x, substr(x, 1, 120) AS h FROM (SELECT entry_id, {ONE} AS x FROM entries) y) z""")
def text_truncate(a: Archive) -> DataFrame:
    return a.entries.select("entry_id", T.truncate(T.one_line(F.col("body_text")), 120).alias("summary"))


@query("SELECT entry_id, CAST(n AS INTEGER) AS words, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, ceil(n / 220)) END AS BIGINT) AS minutes FROM (SELECT entry_id, len(list_filter(string_split_regex(body_text, '\\s+'), lambda x: x <> '')) AS n FROM entries) y")
def text_wordcount(a: Archive) -> DataFrame:
    words = T.count_words(F.col("body_text"))
    return a.entries.select("entry_id", words.alias("words"), T.reading_minutes(words).alias("minutes"))


@query(f"""SELECT entry_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (
  SELECT entry_id, regexp_replace(substr(regexp_replace(regexp_replace({FOLD.format('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS s FROM entries) y""")
def text_slug(a: Archive) -> DataFrame:
    return a.entries.select("entry_id", T.slug(F.col("title")).alias("slug"))


@query("SELECT entry_id, regexp_replace(regexp_replace(regexp_replace(trim(t), '^#+', ''), '\\s+', '-', 'g'), '[^\\pL\\pM\\pN_/-]', '-', 'g') AS tag FROM (SELECT entry_id, '# ' || title AS t FROM entries) y")
def text_tag_name(a: Archive) -> DataFrame:
    return a.entries.select("entry_id", T.tag_name(F.concat(F.lit("# "), "title")).alias("tag"))


@query("SELECT entry_id, CASE WHEN regexp_full_match(t, '[\\x00-\\x7F]*') THEN t ELSE '=?UTF-8?B?' || base64(encode(t)) || '?=' END AS header FROM (SELECT entry_id, title AS t FROM entries) y")
def text_mail_header(a: Archive) -> DataFrame:
    return a.entries.select("entry_id", T.encoded_header(F.col("title")).alias("header"))


MARKS = " OR ".join(f"ends_with(t, '{m}')" for m in T.MORE)
TAIL = "regexp_replace(lower(right(regexp_replace(body_text, '\\s+$', ''), 80)), '[\\s»>]+$', '')"


@query(f"SELECT entry_id, ({MARKS}) AS cut, (b = '' OR length(b) < 800 OR {MARKS}) AS needed FROM (SELECT entry_id, trim(body_text) AS b0, body_text AS b, {TAIL} AS t FROM (SELECT entry_id, CASE WHEN entry_id % 5 = 0 THEN body_text || ' Read more »' ELSE body_text END AS body_text FROM entries) w) y")
def truncated_tail(a: Archive) -> DataFrame:
    text = F.when(F.col("entry_id") % 5 == 0, F.concat(F.col("body_text"), F.lit(" Read more »"))).otherwise(F.col("body_text"))
    return a.entries.select("entry_id", T.is_truncated(text).alias("cut"), T.needs_full_text(F.lit("https://example.org"), text, F.lit(False)).alias("needed"))


@query("SELECT entry_id, sha256(feed_id || chr(0) || CAST(entry_id AS VARCHAR)) AS guid_hash FROM entries")
def hash_guid(a: Archive) -> DataFrame:
    return a.entries.select("entry_id", H.guid_hash(F.col("feed_id"), F.col("entry_id").cast("string")).alias("guid_hash"))


@query("SELECT entry_id, sha256(replace(lower(trim(title)), 'ß', 'ss') || chr(0) || replace(lower(trim(body_text)), 'ß', 'ss') || chr(0)) AS hash FROM entries")
def hash_content(a: Archive) -> DataFrame:
    return a.entries.select("entry_id", H.content_hash(F.col("title"), F.col("body_text")).alias("hash"))


@query("""SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN 'g' || CAST(entry_id AS VARCHAR) WHEN entry_id % 3 = 1 THEN 'https://example.org/' || CAST(entry_id AS VARCHAR)
  ELSE sha256(replace(lower(trim(title)), 'ß', 'ss') || chr(0) || replace(lower(trim(substr(body_text, 1, 200))), 'ß', 'ss') || chr(0)) END AS guid FROM entries""")
def stable_guid(a: Archive) -> DataFrame:
    part = F.col("entry_id") % 3
    given = F.when(part == 0, F.concat(F.lit(" g"), F.col("entry_id").cast("string"))).otherwise(F.lit(" "))
    url = F.when(part == 1, F.concat(F.lit("https://example.org/"), F.col("entry_id").cast("string"))).otherwise(F.lit(""))
    return a.entries.select("entry_id", H.stable_guid(given, url, F.col("title"), F.substring("body_text", 1, 200)).alias("guid"))


@query("SELECT entry_id, published_at_ms AS ms FROM entries")
def ulid_time(a: Archive) -> DataFrame:
    """Sortable ids made from entries' times give those times back."""
    made = a.entries.select("entry_id", H.id_of(F.col("published_at_ms"), F.col("content_hash")).alias("ulid"))
    return made.select("entry_id", H.id_time_ms(F.col("ulid")).alias("ms"))


@query("SELECT entry_id, strftime(make_timestamp(published_at_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(make_timestamp(published_at_ms * 1000), '%Y-%m-%d') AS day FROM entries")
def iso_dates(a: Archive) -> DataFrame:
    return a.entries.select("entry_id", T.iso_time(F.col("published_at_ms")).alias("iso"), T.iso_date(F.col("published_at_ms")).alias("day"))


@query(f"SELECT entry_id, CASE WHEN c > 0 AND c <= {EPOCH_MS + 40 * 86_400_000} + 86400000 THEN c ELSE {EPOCH_MS + 40 * 86_400_000} END AS ms FROM (SELECT entry_id, CASE WHEN entry_id % 9 = 0 THEN -5 WHEN entry_id % 9 = 1 THEN published_at_ms * 3 ELSE published_at_ms END AS c FROM entries) y")
def plausible_dates(a: Archive) -> DataFrame:
    part = F.col("entry_id") % 9
    given = F.when(part == 0, F.lit(-5)).when(part == 1, F.col("published_at_ms") * 3).otherwise(F.col("published_at_ms"))
    return a.entries.select("entry_id", ingest.plausible_time(given, EPOCH_MS + 40 * 86_400_000).alias("ms"))


@query("""SELECT event_id, CAST(floor(least(greatest(greatest(lo, least(w, 86400)), CASE WHEN watched THEN 1800 ELSE 60 END), 95040)) AS BIGINT) AS interval_s FROM (
  SELECT event_id, watched, lo, CASE WHEN e > 0 THEN lo * pow(2, least(e - 1, 6)) WHEN changed THEN greatest(lo, cur * CAST(0.5 AS DOUBLE)) ELSE cur * CAST(1.5 AS DOUBLE) END AS w FROM (
  SELECT event_id, event_type = 'view' AS watched, greatest(60, user_id % 7 * 600, CASE WHEN event_type = 'view' THEN 1800 ELSE 0 END) AS lo,
    CASE WHEN event_type = 'error' THEN event_id % 9 + 1 ELSE 0 END AS e, event_type = 'click' AS changed, CAST(user_id * 100 + 60 AS DOUBLE) AS cur FROM events) a) b""")
def adaptive_interval(a: Archive) -> DataFrame:
    e, kind = a.table("events"), F.col("event_type")
    errors = F.when(kind == "error", F.col("event_id") % 9 + 1).otherwise(F.lit(0))
    interval = ingest.next_interval((F.col("user_id") * 100 + 60).cast("double"), F.col("user_id") % 7 * 600, errors, kind == "click", kind == "view")
    return e.select("event_id", interval.alias("interval_s"))


# rules

RULES = """
rules:
  - name: Thens
    when:
      all: [{field: title, op: contains, value: THEN}]
    then: [{tag: then}, {notify: true}]
  - name: Pattern
    when:
      any:
        - {field: content, op: regex, value: "stion?wh"}
        - {field: title, op: starts_with, value: "Él"}
      none: [{field: lang, op: equals, value: es}]
    then: [star, {export: reader}]
  - name: Long ones stop
    when:
      all: [{field: content, op: gt, value: 5000}]
      none: [{field: content, op: contains, value: "|"}]
    then: [{tag: long-read}, stop, {tag: never}]
  - name: Off
    enabled: false
    then: [star]
  - name: Folder
    scope: {folders: [N3, n4], feeds: ["my SRC6"]}
    when: {any: [{all: [{field: title, op: ends_with, value: "."}]}, {field: feed, op: contains, value: "feed src"}]}
    then: [mark_read]
  - name: Tagged
    scope: {tags: [LONG]}
    then: [{untag: long}, {notify: Long}]
"""

RULE_SQL = f"""base AS (
  SELECT e.*, f.folder_id, f.custom_title, coalesce(nullif(f.custom_title, ''), nullif(f.title, ''), f.url) AS feed_name, {FOLD.format('e.title')} AS ft, {FOLD.format('e.body_text')} AS fb
  FROM entries e LEFT JOIN feeds f ON e.feed_id = f.feed_id
), hits AS (
  SELECT entry_id, contains(ft, 'then') AS h0,
    (regexp_matches(body_text, '(?i)stion?wh') OR starts_with(ft, 'el')) AND NOT lang = 'es' AS h1,
    length(body_text) > 5000 AND NOT contains(fb, '|') AS h2,
    (folder_id = 'N3' OR {FOLD.format('(SELECT name FROM folders d WHERE d.folder_id = base.folder_id)')} = 'n4' OR lower(custom_title) = 'my src6') AND (ends_with(ft, '.') OR contains(lower(feed_name), 'feed src')) AS h3,
    entry_id IN (SELECT entry_id FROM entry_tags WHERE NOT deleted AND tag = 'long') AS h4 FROM base
), acts AS (
  SELECT entry_id, 'Thens' AS rule, 'tag' AS action, 'then' AS value FROM hits WHERE h0
  UNION ALL SELECT entry_id, 'Thens', 'notify', 'true' FROM hits WHERE h0
  UNION ALL SELECT entry_id, 'Pattern', 'star', 'true' FROM hits WHERE h1
  UNION ALL SELECT entry_id, 'Pattern', 'export', 'reader' FROM hits WHERE h1
  UNION ALL SELECT entry_id, 'Long ones stop', 'tag', 'long-read' FROM hits WHERE h2
  UNION ALL SELECT entry_id, 'Folder', 'mark_read', 'true' FROM hits WHERE h3 AND NOT h2
  UNION ALL SELECT entry_id, 'Tagged', 'untag', 'long' FROM hits WHERE h4 AND NOT h2
  UNION ALL SELECT entry_id, 'Tagged', 'notify', 'Long' FROM hits WHERE h4 AND NOT h2
)"""


def evaluated(a: Archive) -> DataFrame:
    return rules.evaluate(rules.candidates(a), rules.read_rules(RULES))


@query("SELECT entry_id, rule, action, value FROM acts", RULE_SQL)
def rule_actions(a: Archive) -> DataFrame:
    return rules.effects(evaluated(a)).select("entry_id", "rule", "action", "value")


@query("SELECT (SELECT count(*) FROM entries) AS reviewed, (SELECT count(DISTINCT entry_id) FROM acts) AS affected", RULE_SQL)
def rule_backfill_summary(a: Archive) -> DataFrame:
    return rules.backfill_summary(evaluated(a))


@query("SELECT DISTINCT entry_id, CASE action WHEN 'star' THEN 'starred' WHEN 'mark_read' THEN 'read' ELSE action END AS field, value AS val FROM acts WHERE action IN ('star', 'mark_read', 'tag', 'untag')", RULE_SQL)
def rule_ops(a: Archive) -> DataFrame:
    """What rules write to the change log."""
    return rules.as_ops(rules.effects(evaluated(a)))


@query("SELECT a.entry_id, a.rule, CASE WHEN a.value = 'true' THEN a.rule ELSE a.value END AS title, e.title AS body FROM acts a JOIN entries e ON a.entry_id = e.entry_id WHERE a.action = 'notify'", RULE_SQL)
def rule_notifications(a: Archive) -> DataFrame:
    return rules.notifications(rules.effects(evaluated(a)), a.entries).select("entry_id", "rule", "title", "body")


@query("SELECT value AS target, count(DISTINCT entry_id) AS entries, min(entry_id) AS first_id FROM acts WHERE action = 'export' GROUP BY value", RULE_SQL)
def rule_exports(a: Archive) -> DataFrame:
    jobs = rules.export_jobs(rules.effects(evaluated(a)))
    return jobs.groupBy("target").agg(F.count("*").alias("entries"), F.min("entry_id").alias("first_id"))


@query("SELECT entry_id, rule, action, value FROM acts", RULE_SQL)
def rules_written_and_read(a: Archive) -> DataFrame:
    """Rules do the same after they were written as YAML and read again."""
    again = rules.read_rules(rules.write_rules(rules.read_rules(RULES)))
    return rules.effects(rules.evaluate(rules.candidates(a), again)).select("entry_id", "rule", "action", "value")


@query("SELECT feed_id, CASE WHEN custom_title <> '' THEN custom_title ELSE title END AS title, url AS site FROM feeds")
def feed_fill_blanks(a: Archive) -> DataFrame:
    """What a channel says fills only what a feed leaves blank."""
    return a.feeds.select("feed_id", ingest.fill_blanks(F.col("custom_title"), F.col("title")).alias("title"), ingest.fill_blanks(F.lit(""), F.col("url")).alias("site"))


def single(name: str, text: str, oracle: str, more: str = RULE_SQL) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = rules.evaluate(rules.candidates(Archive(spark, sf_dir)), rules.read_rules(text))
        return done.filter(F.size("rules") > 0).select("entry_id")

    Q[name], SQL[name] = run, sql(oracle, more)


single("rule_contains", "[{name: r, when: {all: [{field: any, op: contains, value: 'EREŔON'}]}, then: [star]}]", "SELECT entry_id FROM base WHERE contains(ft || ' ' || chr(10) || fb, 'ereron')")
single("rule_regex", "[{name: r, when: {all: [{field: content, op: regex, value: '(of|and) (?P<x>the|in)'}]}, then: [star]}]", "SELECT entry_id FROM base WHERE regexp_matches(body_text, '(?i)(of|and) (the|in)')")
single("rule_case", "[{name: r, when: {all: [{field: content, op: contains, value: 'The', case_sensitive: true}]}, then: [star]}]", "SELECT entry_id FROM base WHERE contains(body_text, 'The')")
single("rule_length", "[{name: r, when: {all: [{field: content, op: lt, value: '300'}]}, then: [star]}]", "SELECT entry_id FROM base WHERE length(body_text) < 300")
single("rule_groups", "[{name: r, when: {any: [{all: [{field: lang, op: equals, value: de}, {field: content, op: gt, value: 900}]}, {none: [{field: content, op: contains, value: e}]}], none: [{field: title, op: contains, value: und}]}, then: [star]}]", "SELECT entry_id FROM base WHERE ((lang = 'de' AND length(body_text) > 900) OR NOT contains(fb, 'e')) AND NOT contains(ft, 'und')")
single("rule_scope", "[{name: r, scope: {feeds: [src2, 'FEED src3'], tags: [es]}, then: [star]}]", "SELECT entry_id FROM base WHERE feed_id IN ('src2', 'src3') OR entry_id IN (SELECT entry_id FROM entry_tags WHERE NOT deleted AND tag = 'es')")
single("rule_stop", "[{name: a, when: {all: [{field: lang, op: equals, value: en}]}, then: [stop]}, {name: b, then: [star]}]", "SELECT entry_id FROM base WHERE lang <> 'en'")

"""Scalar functions, HTML, feeds and pages against plain Python."""

import unicodedata
import zipfile
from io import BytesIO

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contentlake.functions import html as H
from contentlake.functions import text as T
from contentlake.operators import delivery, ingest, rules
from contentlake.sinks.exports import epub, fill_template
from contentlake.sources import feeds, pages


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_fold_text(text):
    want = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold().strip()
    assert T.fold_text(text) == want


def test_fold_fast_equals_exact(spark):
    texts = ["Straße", "ENERGÍA ", None, "", "Ça va? Ñandú", "  a  b "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.fold(F.col("t")), T.fold_exact(F.col("t"))).collect()
    assert [r[0] for r in got] == [r[1] for r in got] == [T.fold_text(t) for t in texts]


def test_truncate_and_collapse(spark):
    texts = ["short", "word " * 30, "x" * 50, "ends here, and - more words follow now"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.truncate(F.col("t"), 20)).collect()]
    assert got == [feeds.one_line(t, 20) if len(t) > 20 and t == " ".join(t.split()) else w for t, w in zip(texts, got, strict=True)]
    assert got[0] == "short" and got[1] == "word word word word…" and got[2] == "x" * 20 + "…" and got[3] == "ends here, and…"
    assert spark.range(1).select(T.collapse(F.lit(" a \t b \n\n  \n c "))).first()[0] == "a b\nc"


@pytest.mark.parametrize("raw,want", [("a/b:c", "a-b-c"), ('say "hi"', "say hi"), ("...", "untitled"), ("é" * 300, None), ("tab\there", "tabhere")])
def test_file_stem(spark, raw, want):
    got = spark.range(1).select(T.file_stem(F.lit(raw))).first()[0]
    assert len(got.encode()) <= 200 and (want is None or got == want)


def test_sanitise():
    got = H.sanitise('<p onclick="x()">a<script>evil()</script><a href="/b" style="c">d</a><img src="p.gif" width="1" height="1"><img src="ok.png"><a href=" java\nscript:x">e</a><!-- c --></p>', "https://h.org/x/")
    assert got == '<p>a<a href="https://h.org/b" style="c">d</a><img src="https://h.org/x/ok.png"><a>e</a></p>'
    assert H.sanitise(None) == "" and H.plain_text("a &amp; b") == "a &amp; b" and H.plain_text("<p>a</p><p>b  c</p>") == "a\nb c"


def test_markdown():
    got = H.markdown('<h2>T</h2><p>a <b>b</b> <a href="u">l</a></p><ul><li>x</li><li>y</li></ul><pre><code class="language-py">z = 1</code></pre>')
    assert got == "## T\n\na **b** [l](u)\n\n- x\n- y\n\n```py\nz = 1\n```"


RSS = b"""<?xml version="1.0"?><rss version="2.0"><channel><title>C</title><link>https://s.org/</link>
<item><title>One &amp; two</title><guid isPermaLink="false">g1</guid><link>/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><author>x@y.z (Ann)</author><description><![CDATA[<p>Hi<script>x</script></p><img src="t.gif" width="1">]]></description></item>
<item><title>Two</title><guid>g1</guid><pubDate>never</pubDate><description>plain</description><enclosure url="/a.mp3" type="audio/mpeg"/></item>
<item><title>Three</title><pubDate>Fri, 01 Jan 2099 00:00:00 GMT</pubDate></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>Á</title><link href="https://s.org/"/><entry><title>É</title><id>tag:1</id><link href="/e"/><updated>2024-01-02T00:00:00Z</updated><author><name>Bea</name></author><content type="html">&lt;a href="/x"&gt;y&lt;/a&gt;</content></entry></feed>'


def test_rss():
    now = 1_704_200_000_000
    feed = feeds.read_feed(RSS, "https://f.org/feed", now)
    one, two, three = feed["items"]
    assert feed["title"] == "C" and feed["is_feed"] and not feed["bozo"]
    assert (one["title"], one["guid"], one["url"], one["published_ms"], one["body"]) == ("One & two", "g1", "https://s.org/1", 1_704_103_200_000, "<p>Hi</p>")
    assert "Ann" in one["author"] and two["published_ms"] == three["published_ms"] == now and two["enclosure_url"] == "https://s.org/a.mp3"


def test_atom_and_broken():
    feed = feeds.read_feed(ATOM, "https://f.org/", 1_800_000_000_000)
    e = feed["items"][0]
    assert (e["author"], e["url"], e["body"], e["guid"]) == ("Bea", "https://s.org/e", '<a href="https://s.org/x">y</a>', "tag:1")
    broken = feeds.read_feed(RSS[: RSS.index(b"<item><title>Three")], "", 0)
    assert broken["bozo"] and len(broken["items"]) == 2
    assert feeds.read_feed(None)["items"] == [] and not feeds.read_feed(b"<html><body></body></html>")["is_feed"]


def test_first_guid_of_a_document_wins(spark):
    docs = spark.createDataFrame([("f", "https://f.org/", bytearray(RSS))], "feed_id string, url string, content binary")
    got = feeds.feed_entries(feeds.parse_feeds(docs, 1_704_200_000_000)).orderBy("pos").collect()
    assert [r["title"] for r in got] == ["One & two", "Three"]


def test_discover():
    page = '<link rel="alternate" type="application/json" href="/all"><link rel="alternate" type="application/rss+xml" href="/r.xml"><link rel="alternate" type="text/html" href="/n"><link rel="alternate" type="application/rss+xml" href="/r.xml">'
    assert feeds.discover(page, "https://h.org/") == ["https://h.org/r.xml", "https://h.org/all"]


def test_opml_round_trip():
    folders = [{"folder_id": 1, "parent_id": None, "name": "Dev"}, {"folder_id": 2, "parent_id": 1, "name": "Rust & co"}]
    text = feeds.write_opml(folders, [{"url": "https://a.org/?x=1&y=2", "title": "A", "folder_id": 2}, {"url": "u", "title": "B", "folder_id": None}])
    got = feeds.read_opml(text)
    assert got.folders == [{"name": "Dev", "parent": None}, {"name": "Rust & co", "parent": "Dev"}]
    assert got.feeds == [{"url": "https://a.org/?x=1&y=2", "title": "A", "folder": "Rust & co"}, {"url": "u", "title": "B", "folder": None}]


LISTING = '<ul class="menu"><li><a href="/m">Menu</a></li><li><a href="/n">News</a></li></ul>' + "".join(
    f'<article class="post"><h2 class="entry-title"><a href="/p{k}">A long enough title {k}</a></h2><time datetime="2024-01-0{k}T00:00:00Z">x</time><p class="excerpt">Text {k}</p><span class="author">Ann</span></article>' for k in (1, 2, 3)
)


def test_scrape_and_guess(spark):
    got = pages.scrape(LISTING, pages.Scrape("article.post"), "https://h.org/", 1_800_000_000_000)
    assert [i["url"] for i in got["items"]] == ["https://h.org/p1", "https://h.org/p2", "https://h.org/p3"]
    assert got["items"][0] == {"title": "A long enough title 1", "url": "https://h.org/p1", "summary": "Text 1", "author": "Ann", "published_ms": 1_704_067_200_000}
    assert pages.scrape(LISTING, pages.Scrape("div.card"))["error"] == "no match"
    assert pages.scrape("<div id=root></div><script></script>", pages.Scrape("article"))["error"] == "filled in by scripts"
    assert pages.scrape(LISTING, pages.Scrape("a[["))["error"].startswith("invalid selector")
    guess = pages.guess_selectors(pages.elements(spark.createDataFrame([(1, LISTING)], "page_id int, html string"))).collect()
    assert (guess[0]["signature"], guess[0]["count"]) == ("article.post", 3) and all("menu" not in g["signature"] for g in guess)


def test_watch(spark):
    page = '<main id="c"><ul><li>a</li></ul></main><footer>{}</footer>'
    rows = [(1, 1, page.format(1)), (1, 2, page.format(2)), (1, 3, page.format(3).replace("<li>a", "<li>b")), (1, 4, None)]
    seen = pages.watch(pages.zone_hashes(spark.createDataFrame(rows, "page_id int, visit int, html string"), "main", "footer")).orderBy("visit")
    assert [r["visit"] for r in seen.collect()] == [1, 3, 4]


def test_charset(spark):
    rows = [(bytearray("<meta charset=latin1>é".encode("latin-1")), None), (bytearray('<?xml encoding="utf-8"?>é'.encode()), None), (bytearray(b"\xff"), "text/html; charset=nope")]
    df = spark.createDataFrame(rows, "content binary, header string")
    got = [r[0] for r in df.select(pages.decoded("content", pages.charset_of(F.col("content"), F.col("header")))).collect()]
    assert got[0].endswith("é") and got[1].endswith("é") and got[2] == "ÿ"


def test_fetch_is_data(spark):
    def get(url, headers):
        if "boom" in url:
            raise OSError("down")
        return (304, {}, []) if headers else (200, {"ETag": "e"}, [b"x" * 10, b"y" * 10])

    rows = [("a", "u", "", ""), ("b", "u", "tag", ""), ("c", "boom", "", "")]
    got = {r["feed_id"]: r for r in pages.fetch(spark.createDataFrame(rows, "feed_id string, url string, etag string, modified string"), get, 2, 100).collect()}
    assert [got[k]["status"] for k in "abc"] == ["ok", "not_modified", "error"] and "down" in got["c"]["error"]
    big = pages.fetch(spark.createDataFrame(rows[:1], "feed_id string, url string, etag string, modified string"), get, 1, 15).first()
    assert big["status"] == "error" and big["content"] is None


def test_epub_opens():
    book = zipfile.ZipFile(BytesIO(epub("Issue", [{"section": "S", "title": "T <x>", "meta": "m", "text": "a\nb"}])))
    assert book.namelist()[0] == "mimetype" and book.read("mimetype") == b"application/epub+zip"
    assert b"T &lt;x&gt;" in book.read("OEBPS/nav.xhtml") and b"<p>b</p>" in book.read("OEBPS/text/a00000.xhtml")


def test_template(spark):
    assert spark.range(1).select(fill_template("{{a}}-{{b}}", a=F.lit("x"), b=F.lit(None).cast("string"))).first()[0] == "x-"


def test_halving():
    assert delivery.halve(4, lambda a, b: (b - a) * 10, 20) == [(0, 2), (2, 4)]
    assert delivery.halve(1, lambda a, b: 99, 1) == [(0, 1)] and delivery.halve(0, None, 1) == []


def test_mail_batches_keep_all(spark):
    rows = spark.createDataFrame([("f", k, 30_000) for k in range(6)], "feed_id string, pos int, weight int")
    got = delivery.greedy_batches(rows, 40_000).collect()
    assert len(got) == 6 and max(r["batch"] for r in got) == 6


def test_forty_notifications_become_one(spark):
    rows = spark.createDataFrame([("k", k, 1000 * k, f"t{k}", f"b{k}", k % 3, "x") for k in range(40)], "key string, pos int, ts_ms long, title string, body string, priority int, tag string")
    got = delivery.merged_notifications(delivery.coalesce_notifications(rows)).collect()
    assert len(got) == 1 and got[0]["count"] == 40 and got[0]["title"] == "t0" and got[0]["priority"] == 2 and got[0]["body"].endswith("… 35 more") and got[0]["tags"] == ["x"]


def test_rules_yaml_round_trip_and_checks():
    text = "rules:\n- name: a\n  when: {any: [{field: title, op: regex, value: x+}]}\n  then: [notify, {tag: t}]\n- name: b\n  enabled: false\n  then: [{stop: true}]\n"
    read = rules.read_rules(text)
    assert rules.read_rules(rules.write_rules(read)) == read
    for bad in ("[{name: a, when: {all: [{field: nope, value: x}]}}]", "[{name: a, when: {all: [{field: title, op: regex, value: '('}]}}]", "[{name: a, then: [fly]}]", "[{name: a, what: 1}]"):
        with pytest.raises(rules.RuleError):
            rules.read_rules(bad)


@pytest.mark.parametrize("current,errors,changed,watched,want", [(3600, 0, True, False, 1800), (3600, 0, False, False, 5400), (3600, 3, False, False, 7200), (600, 0, True, True, 1800), (80_000, 0, False, False, 86_400), (600, 20, False, False, 86_400)])
def test_interval(spark, current, errors, changed, watched, want):
    got = spark.range(1).select(ingest.next_interval(F.lit(float(current)), F.lit(1800), F.lit(errors), F.lit(changed), F.lit(watched))).first()[0]
    assert got == want


def test_mails_carry_the_entries_of_all_feeds(spark):
    from contentlake.plans.page_queries import Q

    mails = Q["mail_deliveries"](spark, "/root/testdata/sf0.001").collect()
    entries = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sent = sorted(e for m in mails for e in m["entry_ids"])
    assert sent == sorted(r["doc_id"] for r in entries.select("doc_id").collect())
    stems = [m["stem"] for m in mails]
    assert len(stems) == len(set(stems)) and len({s.split("-")[1] for s in stems}) == entries.select("source").distinct().count()


def test_parsed_feeds_keep_the_times_of_late_entries(spark, tmp_path):
    from contentlake.bindings import EPOCH_MS, HOUR_MS
    from contentlake.plans.page_queries import Q

    rows = [(k, f"text {k}", "en", "src1", 6) for k in (0, 900, 1100, 50_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["published_ms"] for r in Q["feed_parse"](spark, str(tmp_path)).collect()) == [EPOCH_MS + r[0] * HOUR_MS for r in rows]


@pytest.mark.parametrize("name", ["page_images", "page_text", "page_scrape", "page_articles"])
def test_pages_reach_python_in_small_batches(spark, name):
    from contentlake.plans.registry import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_an_appended_index_holds_what_an_updated_one_does(spark, tmp_path):
    from contentlake.operators import search

    class Part:
        def __init__(self, rows):
            self.entries = spark.createDataFrame(rows, "entry_id long, title string, body_text string")

    first = search.write_index(search.postings(Part([(1, "of the", "old of that"), (2, "x", "of this"), (3, None, "of them")])), f"{tmp_path}/a")
    late, gone = Part([(1, "new", "words"), (4, "y", "of those")]), spark.createDataFrame([(3,)], "entry_id long")
    got = search.appended_index(first, late, f"{tmp_path}/b", gone)
    rows = lambda df: sorted(tuple(r) for r in df.select("entry_id", "col", "pos", "term").collect())
    assert rows(got) == rows(search.updated_index(first, late, gone))
    assert sorted(r[0] for r in search.match(None, '"of th"*', got).collect()) == [2, 4]

"""Feeds: RSS and Atom documents to entries, discovery of feeds in pages, lists of feeds (OPML)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from contentlake.functions.hashing import content_hash, guid_hash
from contentlake.functions.html import absolute, parse, plain_text, sanitise

#: Types that announce a feed, and where feeds often lie.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json", "application/json", "application/xml", "text/xml")
COMMON_PATHS = ("/feed", "/feed/", "/rss", "/rss.xml", "/feed.xml", "/atom.xml", "/index.xml", "/feed.json", "/?feed=rss2", "/blog/feed", "/news/rss")
AHEAD_MS = 86_400_000
ITEM = "struct<pos:int,guid:string,url:string,title:string,author:string,summary:string,body:string,published_ms:bigint,updated_ms:bigint,enclosure_url:string,enclosure_type:string>"
FEED = f"struct<title:string,site_url:string,is_feed:boolean,bozo:boolean,items:array<{ITEM}>>"


def read_time(text: str | None) -> int | None:
    """Milliseconds of a mail-style or ISO date; None if it is neither."""
    if not text or not text.strip():
        return None
    try:
        when = parsedate_to_datetime(text.strip())
    except (TypeError, ValueError, IndexError):
        try:
            when = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
        except ValueError:
            return None
    try:
        return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() * 1000)
    except (OverflowError, ValueError):
        return None


def plausible(times: list[int | None], fetched_ms: int) -> int:
    return next((t for t in times if t is not None and 0 < t <= fetched_ms + AHEAD_MS), fetched_ms)


def _name(tag) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def _texts(node: ET.Element, *names: str) -> list[str]:
    found = []
    for name in names:
        for c in node:
            if _name(c.tag) == name:
                inner = "".join(ET.tostring(x, encoding="unicode") for x in c) if c.get("type") == "xhtml" else ""
                text = inner or "".join(c.itertext())
                if text.strip():
                    found.append(text)
    return found


def _first(node: ET.Element, *names: str) -> str:
    return next(iter(_texts(node, *names)), "").strip()


def _links(node: ET.Element) -> list[dict]:
    return [{"href": c.get("href") or (c.text or "").strip(), "rel": c.get("rel", ""), "type": c.get("type", "")} for c in node if _name(c.tag) == "link"]


def one_line(text: str, limit: int = 500) -> str:
    text = " ".join(text.split())
    if len(text) <= limit:
        return text
    head = text[:limit]
    blank = head.rfind(" ")
    return (head[:blank] if blank > 0.6 * limit else head).rstrip(" ,;:.-") + "…"


def read_item(node: ET.Element, pos: int, base: str, fetched_ms: int) -> dict:
    """A normalised entry; the guid is the document's id, else the link, else empty (then content decides)."""
    links = _links(node)
    link = next((x["href"] for x in links if x["rel"] in ("", "alternate") and x["href"]), next((x["href"] for x in links if x["href"]), ""))
    url = absolute(link, base)
    bodies = _texts(node, "encoded", "content", "summary", "description")
    body = max(bodies, key=len, default="")  # the first of the longest
    title = one_line(plain_text(_first(node, "title")), 1000)
    summary = next((t for s in _texts(node, "summary", "description", "subtitle") if (t := plain_text(s))), "") or plain_text(body)
    author = next((c for c in node if _name(c.tag) == "author"), None)
    author = ((_first(author, "name") or (author.text or "").strip()) if author is not None else "") or _first(node, "creator", "contributor")
    enclosure = next(((c.get("url") or c.get("href"), c.get("type", "")) for c in node if _name(c.tag) in ("enclosure", "content") and c.get("url") or _name(c.tag) == "link" and c.get("rel") == "enclosure"), ("", ""))
    published = plausible([read_time(_first(node, n)) for n in ("published", "pubdate", "date", "created", "updated")], fetched_ms)
    updated = read_time(_first(node, "updated", "modified"))
    return {
        "pos": pos, "guid": _first(node, "id") or _first(node, "guid") or url, "url": url, "title": title, "author": author[:200], "summary": one_line(summary), "body": sanitise(body, url or base),
        "published_ms": published, "updated_ms": updated if updated is not None and updated >= published else None, "enclosure_url": absolute(enclosure[0] or "", base), "enclosure_type": enclosure[1],
    }


def read_feed(data: bytes | str | None, base: str = "", fetched_ms: int = 0) -> dict:
    """Channel and entries of a document. A document that breaks off gives what came before, marked ``bozo``."""
    out: dict = {"title": "", "site_url": "", "is_feed": False, "bozo": False, "items": []}
    parser = ET.XMLPullParser(["start", "end"])
    nodes: list[ET.Element] = []
    try:
        parser.feed(data or b"")
        parser.close()
    except ET.ParseError:
        out["bozo"] = True
    root = None
    try:
        for event, node in parser.read_events():
            if event == "start" and root is None:
                root = node
            elif event == "end" and _name(node.tag) in ("item", "entry"):
                nodes.append(node)
    except ET.ParseError:
        out["bozo"] = True
    if root is None:
        return out
    channel = next((c for c in root if _name(c.tag) == "channel"), root)
    out["title"] = _first(channel, "title")
    out["site_url"] = next((x["href"] for x in _links(channel) if x["rel"] in ("", "alternate") and x["href"]), "")
    site = absolute(out["site_url"], base) or base
    for k, node in enumerate(nodes):
        out["items"].append(read_item(node, k, site, fetched_ms))
    out["is_feed"] = _name(root.tag) in ("rss", "feed", "rdf") or bool(nodes)
    return out


def parse_feeds(documents: DataFrame, fetched_ms: int) -> DataFrame:
    """Documents (url, content, and what tells them apart) with ``feed`` in place of address and content."""

    @F.pandas_udf(FEED)
    def feed(content: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_feed(c, u or "", fetched_ms) for c, u in zip(content, url, strict=True)], columns=["title", "site_url", "is_feed", "bozo", "items"])

    keys = [c for c in documents.columns if c not in ("url", "content")]
    return documents.select(*keys, feed(F.col("content"), F.col("url")).alias("feed"))


def feed_entries(parsed: DataFrame) -> DataFrame:
    """A row per entry with its hashes; of entries with one guid in a document the first stays."""
    keys = [c for c in parsed.columns if c != "feed"]
    items = parsed.select(*keys, F.explode("feed.items").alias("i")).select(*keys, "i.*")
    guid = F.when(F.col("guid") == "", content_hash(F.col("title"), F.substring("body", 1, 200))).otherwise(F.col("guid"))
    hashed = items.withColumn("guid_hash", guid_hash(F.col("feed_id"), guid)).withColumn("content_hash", content_hash(F.col("title"), F.col("body")))
    first = hashed.groupBy(*keys, "guid_hash").agg(F.min("pos").alias("pos"))
    return hashed.join(first, [*keys, "guid_hash", "pos"], "left_semi")


def rss_documents(entries: DataFrame, per_document: int) -> DataFrame:
    """(feed_id, page, url, content): RSS documents of all entries, newest first, so many in each, written by Spark.

    An entry's place in its feed is the number of entries of later days plus its place within its day, so that no task
    sorts a whole feed.
    """
    day = F.floor(F.col("published_at_ms") / AHEAD_MS)
    rows = entries.withColumn("_day", day)
    ahead = Window.partitionBy("feed_id").orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("feed_id", "_day").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("feed_id", "_day").orderBy(F.desc("published_at_ms"), "entry_id"))
    item = F.concat(
        F.lit("<item><title>"), _escaped("title"), F.lit('</title><guid isPermaLink="false">'), F.col("entry_id").cast("string"), F.lit("</guid><link>/"), F.col("entry_id").cast("string"), F.lit("</link><pubDate>"),
        F.date_format(F.timestamp_millis("published_at_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate><description>"), _escaped("body_text"), F.lit("</description></item>"),
    )
    placed = rows.select("feed_id", "_day", within.alias("_within"), item.alias("item")).join(starts, ["feed_id", "_day"])
    n = F.col("_start") + F.col("_within") - 1
    placed = placed.select("feed_id", F.floor(n / per_document).alias("page"), n.alias("n"), "item")
    grouped = placed.groupBy("feed_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]), "").alias("items"))
    url = F.concat(F.lit("https://"), "feed_id", F.lit(".example.org/feed"))
    return grouped.select("feed_id", "page", url.alias("url"), F.concat(F.lit('<rss version="2.0"><channel><title>'), "feed_id", F.lit("</title>"), "items", F.lit("</channel></rss>")).alias("content"))


def _escaped(name: str) -> Column:
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.replace(F.replace(F.replace(bare, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def discover(html: str | None, base: str) -> list[str]:
    """Feeds that a page announces, absolute, each once, those that look like feed files first."""
    found = []
    for node in parse(html).walk():
        rel = node.attrs.get("rel", "").lower().split()
        if node.tag == "link" and set(rel) & {"alternate", "feed"} and node.attrs.get("type", "").lower().strip() in FEED_TYPES and node.attrs.get("href"):
            found.append(absolute(node.attrs["href"], base))
    return sorted(dict.fromkeys(found), key=lambda u: not re.search(r"\.xml|\.rss|\.atom|/rss|/atom", u))


@F.pandas_udf(ArrayType(StringType()))
def discovered(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([discover(h, b or "") for h, b in zip(html, base, strict=True)], dtype=object)


def candidates(pages: DataFrame) -> DataFrame:
    """(url, candidate, rank): announced feeds, then common places on the page's host; a fetch tries them in order."""
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    places = F.transform(F.array(*(F.lit(p) for p in COMMON_PATHS)), lambda p: F.concat(origin, p))
    return pages.select("url", F.posexplode(F.array_distinct(F.concat(discovered("html", "url"), places))).alias("rank", "candidate"))


@dataclass
class Outline:
    feeds: list[dict] = field(default_factory=list)
    folders: list[dict] = field(default_factory=list)


def read_opml(text: str) -> Outline:
    """Folders and feeds of an outline. A titled outline without address is a folder, known by its name anywhere."""
    out, names = Outline(), {}

    def walk(node: ET.Element, folder: str | None) -> Iterator[None]:
        for c in node:
            if _name(c.tag) != "outline":
                continue
            title, url = (c.get("title") or c.get("text") or "").strip(), c.get("xmlUrl")
            inner = folder
            if url:
                out.feeds.append({"url": url, "title": title or url, "folder": folder})
            elif title:
                if title not in names:
                    names[title] = folder
                    out.folders.append({"name": title, "parent": folder})
                inner = title
            yield from walk(c, inner)
        yield

    body = next((n for n in ET.fromstring(text) if _name(n.tag) == "body"), None)
    if body is not None:
        for _ in walk(body, None):
            pass
    return out


def write_opml(folders: list[dict], feeds: list[dict], title: str = "Subscriptions") -> str:
    """Nested outlines: folders (folder_id, parent_id, name), feeds (url, title, folder_id)."""
    below: dict = {}
    for f in sorted(folders, key=lambda f: f["name"]):
        below.setdefault(f["parent_id"], []).append(f)
    inside: dict = {}
    for f in sorted(feeds, key=lambda f: f["title"]):
        inside.setdefault(f["folder_id"], []).append(f)

    def write(parent, depth: int) -> str:
        pad = "  " * depth
        out = "".join(f'{pad}<outline text="{escape(f["name"])}" title="{escape(f["name"])}">\n{write(f["folder_id"], depth + 1)}{pad}</outline>\n' for f in below.get(parent, []))
        return out + "".join(f'{pad}<outline type="rss" text="{escape(f["title"])}" title="{escape(f["title"])}" xmlUrl="{escape(f["url"])}"/>\n' for f in inside.get(parent, []))

    return f'<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head><title>{escape(title)}</title></head>\n  <body>\n{write(None, 2)}  </body>\n</opml>\n'


def opml_documents(feeds: DataFrame, parts: int = 64) -> DataFrame:
    """(content): outlines of feeds (folder, url, title) by folder, written by Spark; a large folder takes several."""
    quoted = lambda c: F.replace(_escaped(c), F.lit('"'), F.lit("&quot;"))
    line = F.concat(F.lit('<outline type="rss" text="'), quoted("title"), F.lit('" title="'), quoted("title"), F.lit('" xmlUrl="'), quoted("url"), F.lit('"/>'))
    rows = feeds.select("folder", F.pmod(F.xxhash64("url"), F.lit(parts)).alias("part"), "title", line.alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("title", "line"))), lambda x: x["line"]), "")
    name = quoted("folder")
    whole = F.concat(F.lit('<opml version="2.0"><body><outline text="'), name, F.lit('" title="'), name, F.lit('">'), "body", F.lit("</outline></body></opml>"))
    return rows.groupBy("folder", "part").agg(body.alias("body")).select(whole.alias("content"))


def read_outlines(documents: DataFrame) -> DataFrame:
    """(folder, url, title) of the feeds of all documents (content)."""

    @F.pandas_udf("array<struct<folder:string,url:string,title:string>>")
    def outlines(content: pd.Series) -> pd.Series:
        return pd.Series([[{k: f[k] for k in ("folder", "url", "title")} for f in read_opml(c).feeds] for c in content], dtype=object)

    return documents.select(F.explode(outlines("content")).alias("f")).select("f.*")


def new_feeds(found: DataFrame, known: DataFrame) -> DataFrame:
    """Imported feeds whose address isn't subscribed yet; of repeats the first."""
    return found.dropDuplicates(["url"]).join(known.select("url"), "url", "left_anti")

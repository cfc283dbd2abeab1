"""Pages as sources: listings scraped by selectors, watched zones, guessed selectors, fetching."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from contentlake.functions.hashing import guid_hash
from contentlake.functions.html import Node, absolute, parse, plain_text
from contentlake.sources.feeds import plausible, read_time

CONTAINERS = ("article", "li", "div", "section", "tr")
ITEM = "struct<title:string,url:string,summary:string,author:string,published_ms:bigint>"


class SelectorError(ValueError):
    """The selector can't be read."""


_SIMPLE = re.compile(r"^([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[~|^$*]?=(?:\"[^\"]*\"|'[^']*'|[^\]]*))?\])*)$")


def _matcher(simple: str) -> Callable[[Node], bool]:
    m = _SIMPLE.match(simple)
    if not m or not simple:
        raise SelectorError(f"cannot read selector part {simple!r}")
    tag, tests = m[1], re.findall(r"([.#])([\w-]+)|\[([\w-]+)(?:([~|^$*]?)=(?:\"([^\"]*)\"|'([^']*)'|([^\]]*)))?\]", m[2] or "")

    def fits(node: Node) -> bool:
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        for kind, name, attr, how, *values in tests:
            if kind == "." and name not in node.classes or kind == "#" and node.attrs.get("id") != name:
                return False
            if attr:
                want, have = next((v for v in values if v), ""), node.attrs.get(attr)
                if have is None:
                    return False
                if want and not {"": have == want, "~": want in have.split(), "^": have.startswith(want), "$": have.endswith(want), "*": want in have, "|": have == want or have.startswith(f"{want}-")}[how]:
                    return False
        return True

    return fits


def select(root: Node, selector: str) -> list[Node]:
    """Nodes in document order that fit: commas, descendants, ``>`` children, tag, .class, #id, [attribute]."""
    ways = []
    for way in selector.split(","):
        parts = re.sub(r"\s*>\s*", " > ", way.strip()).split()
        if not parts:
            raise SelectorError(f"empty selector in {selector!r}")
        steps, child = [], False
        for p in parts:
            if p == ">":
                child = True
            else:
                steps.append((_matcher(p), child))
                child = False
        ways.append(steps)

    def fits(node: Node, steps: list) -> bool:
        if not steps[-1][0](node):
            return False
        if len(steps) == 1:
            return True
        above = node.parent
        while above is not None and above.tag != "#root":
            if fits(above, steps[:-1]):
                return True
            if steps[-1][1]:
                return False
            above = above.parent
        return False

    return [n for n in root.walk() if any(fits(n, s) for s in ways)]


@dataclass(frozen=True)
class Scrape:
    """Selectors of a listing: ``item`` and, within an item, what differs from the usual places."""

    item: str
    title: str = ""
    link: str = ""
    summary: str = ""
    author: str = ""
    date: str = ""
    limit: int = 50


def likely_title(text: str) -> bool:
    return 8 <= len(text) <= 300


def _link(node: Node, base: str, selector: str = "") -> str:
    anchors = [n for n in ([node] if node.tag == "a" and not selector else select(node, selector) if selector else [n for n in node.walk() if n.tag == "a"])]
    usable = [n for n in anchors if n.attrs.get("href") and not n.attrs["href"].strip().lower().startswith(("#", "javascript:", "mailto:"))]
    best = max(usable, key=lambda n: len(n.text()), default=None)
    return absolute(best.attrs["href"], base) if best else ""


def _title(node: Node, selector: str) -> str:
    if selector:
        return next((t for n in select(node, selector) if (t := n.text())), "")
    heads = [n for n in node.walk() if re.fullmatch(r"h[1-6]", n.tag) or any("title" in c.lower() for c in n.classes)]
    found = next((t for n in heads if likely_title(t := n.text())), "")
    return found or max((n.text() for n in node.walk() if n.tag == "a"), key=len, default="") or node.text()


def _time(node: Node, selector: str, fetched_ms: int) -> int:
    places = select(node, selector) if selector else [n for n in node.walk() if n.tag == "time"]
    times = [read_time(v) for n in places for v in (n.attrs.get("datetime"), n.attrs.get("content"), n.text()) if v]
    return plausible(times, fetched_ms)


def scrape(html: str | None, config: Scrape, base: str = "", fetched_ms: int = 0) -> dict:
    """{items, error}: error tells a page without matches, one that scripts fill in, and matches without titles."""
    root = parse(html)
    try:
        nodes = select(root, config.item)[: config.limit]
        items = []
        for n in nodes:
            title = _title(n, config.title)
            if not title:
                continue
            summary = next((t for s in (select(n, config.summary) if config.summary else [x for x in n.walk() if x.tag == "p"]) if (t := s.text())), "")
            author = next((t for s in (select(n, config.author) if config.author else [x for x in n.walk() if "author" in x.classes]) if (t := s.text())), "")
            items.append({"title": title, "url": _link(n, base, config.link), "summary": summary, "author": author, "published_ms": _time(n, config.date, fetched_ms)})
    except SelectorError as e:
        return {"items": [], "error": f"invalid selector: {e}"}
    if nodes and not items:
        return {"items": [], "error": "no titles"}
    if not nodes:
        text, scripts = plain_text(html), sum(n.tag == "script" for n in root.walk())
        shell = any(n.attrs.get("id") in ("root", "app", "__next") and not n.text() for n in root.walk())
        return {"items": [], "error": "filled in by scripts" if shell or len(text) < 600 and scripts >= 3 else "no match"}
    return {"items": items, "error": None}


def scraped(pages: DataFrame, config: Scrape, fetched_ms: int) -> DataFrame:
    """(page_id, pos, title, url, summary, author, published_ms) of every item; a page with an error has none."""

    # a hundred rows at a time: see functions.html
    run = F.udf(lambda html, url: scrape(html, config, url or "", fetched_ms), f"struct<items:array<{ITEM}>,error:string>", useArrow=False)
    rows = pages.select("page_id", run("html", "url").alias("r"))
    return rows.select("page_id", F.posexplode("r.items").alias("pos", "i")).select("page_id", "pos", "i.*")


def scrape_guid(feed: Column, url: Column, title: Column, published_ms: Column) -> Column:
    return guid_hash(feed, F.when(url != "", url).otherwise(F.concat_ws("|", title, published_ms.cast("string"))))


def zone_hash(html: str | None, selector: str = "", ignored: str = "", mode: str = "text") -> str:
    """sha256 of a zone's text (or markup's text and addresses), white space collapsed, ignored parts left out."""
    root = parse(html)
    zones = select(root, selector) if selector else [root]
    out = []

    def read(node: Node, skipped: set[int]) -> None:
        for c in node.children:
            if isinstance(c, str):
                out.append(c)
            elif id(c) not in skipped and c.tag not in ("script", "style"):
                if mode == "html":
                    out.append(f"<{c.tag} {' '.join(f'{k}={v}' for k, v in sorted(c.attrs.items()))}>")
                read(c, skipped)

    for zone in zones:
        read(zone, {id(n) for n in select(zone, ignored)} if ignored else set())
        out.append("\n")
    return hashlib.sha256(" ".join(" ".join(out).split()).encode()).hexdigest()


def zone_hashes(pages: DataFrame, selector: str = "", ignored: str = "", mode: str = "text") -> DataFrame:
    """The table with ``zone_hash``."""

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: zone_hash(h, selector, ignored, mode), na_action=None)

    return pages.withColumn("zone_hash", run("html"))


def watch(visits: DataFrame, key: str = "page_id", order: str = "visit", value: str = "zone_hash") -> DataFrame:
    """Visits that saw something else than the visit before; the first always counts."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return visits.withColumn("_before", before).filter(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def signature(node: Node) -> str:
    """Tag and its first two telling classes; a list's child without any is named by its parent."""
    telling = sorted(c for c in node.classes if not (re.search(r"\d{3}", c) or re.fullmatch(r"[a-z]{1,2}", c) or "--" in c or re.search(r"__\w{5}", c)))[:2]
    if telling:
        return ".".join([node.tag, *telling])
    if node.parent is not None and node.tag in ("li", "tr"):
        above = sorted(node.parent.classes)[:1]
        return f"{'.'.join([node.parent.tag, *above])} > {node.tag}"
    return node.tag


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, pos, signature, has_link, has_title, has_date) of every container element."""

    @F.pandas_udf("array<struct<signature:string,has_link:boolean,has_title:boolean,has_date:boolean>>")
    def run(html: pd.Series) -> pd.Series:
        out = []
        for h in html:
            rows = []
            for n in parse(h).walk():
                if n.tag in CONTAINERS:
                    inner = list(n.walk())
                    rows.append((signature(n), any(x.tag == "a" for x in inner), likely_title(_title(n, "")), any(x.tag == "time" for x in inner)))
            out.append([{"signature": a, "has_link": b, "has_title": c, "has_date": d} for a, b, c, d in rows])
        return pd.Series(out, dtype=object)

    return pages.select("page_id", F.posexplode(run("html")).alias("pos", "e")).select("page_id", "pos", "e.*")


def guess_selectors(found: DataFrame, least: int = 3, best: int = 4, looked_at: int = 20) -> DataFrame:
    """(page_id, rank, signature, count, score): repeated elements that look like a listing."""
    order = Window.partitionBy("page_id", "signature").orderBy("pos")
    rows = found.withColumn("n", F.row_number().over(order))
    share = lambda c: F.avg(F.when(F.col("n") <= looked_at, F.col(c).cast("int")))
    groups = rows.groupBy("page_id", "signature").agg(F.count("*").alias("count"), share("has_link").alias("l"), share("has_title").alias("t"), share("has_date").alias("d"))
    base = 2 * F.col("l") + 3 * F.col("t") + F.col("d")
    scored = groups.filter((F.col("count") >= least) & (F.col("t") > 0)).withColumn("score", base * (F.least("count", F.lit(30)) / 30 + 0.5))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "signature"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= best).select("page_id", "rank", "signature", "count", "score")


def charset_of(content: Column, header: Column) -> Column:
    """Encoding by header, XML declaration, meta element; else utf-8."""
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    by_header = F.regexp_extract(F.coalesce(header, F.lit("")), r"(?i)charset=[\"']?([\w-]+)", 1)
    by_xml = F.regexp_extract(F.substring(head, 1, 512), r"""(?i)<\?xml[^>]*encoding=["']([\w-]+)""", 1)
    by_meta = F.regexp_extract(head, r"""(?i)<meta[^>]*charset=["']?([\w-]+)""", 1)
    return F.lower(F.coalesce(F.nullif(by_header, F.lit("")), F.nullif(by_xml, F.lit("")), F.nullif(by_meta, F.lit("")), F.lit("utf-8")))


@F.pandas_udf(StringType())
def decoded(content: pd.Series, charset: pd.Series) -> pd.Series:
    """Text of bytes: by the given encoding, else UTF-8, else Latin-1."""

    def one(data: bytes | None, name: str) -> str | None:
        for c in (name, "utf-8"):
            try:
                return None if data is None else data.decode(c)
            except (LookupError, UnicodeDecodeError):
                continue
        return data.decode("latin-1")

    return pd.Series([one(d, c or "utf-8") for d, c in zip(content, charset, strict=True)], dtype=object)


@dataclass(frozen=True)
class Fetched:
    feed_id: str
    status: str
    http: int
    content: bytes | None
    etag: str
    modified: str
    error: str


def fetch(feeds: DataFrame, get: Callable[[str, dict], tuple[int, dict, Iterator[bytes]]], parallel: int = 16, most: int = 8 * 1024 * 1024) -> DataFrame:
    """Fetch results of feeds (feed_id, url, etag, modified): status is data, an error is a row.

    ``get`` opens an address with headers and gives code, headers and chunks. A body over ``most`` bytes is dropped as
    soon as it is seen to be.
    """

    def one(row) -> Fetched:
        headers = ({"If-None-Match": row.etag} if row.etag else {}) | ({"If-Modified-Since": row.modified} if row.modified else {})
        try:
            code, got, chunks = get(row.url, headers)
            tags = (got.get("ETag", ""), got.get("Last-Modified", ""))
            if code == 304:
                return Fetched(row.feed_id, "not_modified", code, None, *tags, "")
            if code >= 400:
                return Fetched(row.feed_id, "error", code, None, *tags, f"HTTP {code}")
            body = b""
            for chunk in chunks:
                body += chunk
                if len(body) > most:
                    return Fetched(row.feed_id, "error", code, None, *tags, f"larger than {most} bytes")
            return Fetched(row.feed_id, "ok", code, body, *tags, "")
        except Exception as e:  # whatever a host does, the other feeds go on
            return Fetched(row.feed_id, "error", 0, None, "", "", f"{type(e).__name__}: {e}"[:500])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([asdict(one(r)) for r in batch.itertuples(index=False)], columns=list(Fetched.__dataclass_fields__))

    return feeds.select("feed_id", "url", "etag", "modified").repartition(parallel).mapInPandas(run, "feed_id string, status string, http int, content binary, etag string, modified string, error string")

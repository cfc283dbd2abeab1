"""HTML: one small tolerant tree over the standard parser, and functions on it as vectorised columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without content, elements and attributes that readers never get, attributes that hold
#: addresses, what those mustn't begin with, and the style of a picture that only counts readers.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKED = frozenset("script style iframe object embed form input button noscript link meta base applet frame frameset".split())
BLOCKED_ATTRIBUTES = frozenset("srcdoc formaction background ping".split())
ADDRESSES = frozenset("href src poster action".split())
SCHEMES = ("javascript:", "vbscript:", "data:text/html")
ONE_PIXEL = re.compile(r"(width|height)\s*:\s*[01](\.\d+)?\s*(px)?", re.IGNORECASE)
CLOSED_BY = {"p": frozenset("p div ul ol table section article h1 h2 h3 h4 blockquote pre footer".split()), "li": frozenset(["li"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"])}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order, however deep."""
        ahead = [c for c in reversed(self.children) if isinstance(c, Node)]
        while ahead:
            node = ahead.pop()
            yield node
            ahead += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        ahead = self.children[::-1]
        while ahead:
            c = ahead.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in skip:
                ahead += c.children[::-1]

    def text(self) -> str:
        return " ".join("".join(self.strings(BLOCKED)).split())

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY.get(self.at.tag, ()) and self.at.parent:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """A tree for any input; what isn't well formed ends up somewhere."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def absolute(url: str, base: str) -> str:
    """Joined to the base, unless it has a scheme of its own."""
    url = (url or "").strip()
    if not url or "://" in url or url.split(":")[0].lower() in ("mailto", "tel", "data"):
        return url
    return urljoin(base or "", url)


def plain_text(html: str | None) -> str:
    """Text nodes on lines of their own, white space collapsed, blocked elements and blank lines gone.

    Input without markup is only collapsed; its entities stay.
    """
    if not html:
        return ""
    joined = html if "<" not in html else "\n".join(parse(html).strings(BLOCKED))
    lines = (re.sub(r"[ \t\r\f\v]+", " ", line).strip() for line in joined.split("\n"))
    return "\n".join(line for line in lines if line)


def _tiny(node: Node, most: int) -> bool:
    """A picture of hardly any size, or without an address."""
    size = [node.attrs.get(k, "").strip().rstrip("px").strip() for k in ("width", "height")]
    return any(v.isdigit() and int(v) <= most for v in size) or bool(ONE_PIXEL.search(node.attrs.get("style", ""))) or not node.attrs.get("src")


def markup(root: Node, attributes: Callable[[Node], dict[str, str] | None]) -> str:
    """What lies below a node, written with the attributes that a function keeps; None leaves a node out."""
    out: list[str] = []
    ahead: list[Node | str | tuple[str]] = root.children[::-1]
    while ahead:
        c = ahead.pop()
        if isinstance(c, tuple):
            out.append(c[0])
        elif isinstance(c, str):
            out.append(escape(c, quote=False))
        elif (kept := attributes(c)) is not None:
            opened = "".join(f' {k}="{escape(v)}"' for k, v in kept.items())
            out.append(f"<{c.tag}{opened}>")
            if c.tag not in VOID:
                ahead.append((f"</{c.tag}>",))
                ahead += c.children[::-1]
    return "".join(out)


def sanitise(html: str | None, base: str = "") -> str:
    """Markup without active content, comments, event handlers, script links and tracking pixels; links absolute."""

    def safe(node: Node) -> dict[str, str] | None:
        if node.tag in BLOCKED or node.tag == "img" and _tiny(node, 1):
            return None
        kept = {}
        for k, v in node.attrs.items():
            if k.startswith("on") or k in BLOCKED_ATTRIBUTES:
                continue
            if k in ADDRESSES:
                if re.sub(r"\s", "", v).lower().startswith(SCHEMES):
                    continue
                v = absolute(v, base) if base and v.strip() else v
            kept[k] = v
        return kept

    return markup(parse(html), safe).strip() if html and html.strip() else ""


#: What exported articles don't carry.
EXPORT_DROPPED = BLOCKED | frozenset("select textarea svg nav aside footer header video audio canvas dialog template".split())
TRACKERS = re.compile(r"(?i)(/pixel|beacon|/track|doubleclick|feedburner\.com/~r|stats\.)")


def clean_article(html: str | None, base: str = "") -> str:
    """Markup for export: like ``sanitise``, with lazy images resolved, trackers, small images and empty blocks gone."""
    root = parse(html)
    for node in reversed([root, *root.walk()]):  # what lies deeper comes first
        kept: list[Node | str] = []
        for c in node.children:
            if isinstance(c, Node):
                if c.tag in EXPORT_DROPPED:
                    continue
                if c.tag == "img":
                    lazy = c.attrs.get("data-src") or c.attrs.get("data-lazy-src") or c.attrs.get("data-original")
                    c.attrs["src"] = lazy or c.attrs.get("src", "")
                    if _tiny(c, 2) or TRACKERS.search(c.attrs["src"]):
                        continue
                if c.tag in ("p", "div", "span", "section", "figure") and not any(isinstance(x, Node) or x.strip() for x in c.children):
                    continue
            kept.append(c)
        node.children = kept
    carried = ("href", "src", "alt", "title", "colspan", "rowspan")
    return markup(root, lambda n: {k: absolute(v, base) if k in ("href", "src") else v for k, v in n.attrs.items() if k in carried})


def image_urls(html: str | None, base: str = "") -> list[str]:
    """Absolute addresses of images, each once, in order."""
    found = (absolute(n.attrs.get("src", ""), base) for n in parse(html).walk() if n.tag == "img")
    return list(dict.fromkeys(u for u in found if u))


def markdown(html: str | None) -> str:
    """Markdown with # headings, - bullets, fenced code with its language, links and images."""
    out: list[str] = []

    def inline(node: Node) -> str:
        """The node's content on one line; what lies deeper is written first."""
        done: dict[int, str] = {}
        for n in reversed([node, *node.walk()]):
            text = []
            for c in n.children:
                if isinstance(c, str):
                    text.append(re.sub(r"\s+", " ", c))
                    continue
                inner = done.pop(id(c))
                if c.tag in BLOCKED:
                    continue
                if c.tag in ("b", "strong"):
                    text.append(f"**{inner.strip()}**")
                elif c.tag in ("i", "em"):
                    text.append(f"*{inner.strip()}*")
                elif c.tag == "code":
                    text.append(f"`{inner}`")
                elif c.tag == "a" and c.attrs.get("href"):
                    text.append(f"[{inner.strip()}]({c.attrs['href']})")
                elif c.tag == "img":
                    text.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
                elif c.tag == "br":
                    text.append("  \n")
                else:
                    text.append(inner)
            done[id(n)] = "".join(text)
        return done[id(node)]

    run: list[Node | str] = []

    def flush() -> None:
        if run:
            holder = Node("#run")
            holder.children = list(run)
            if text := inline(holder).strip():
                out.append(text)
            run.clear()

    ahead: list[Node | str | None] = parse(html).children[::-1]
    while ahead:
        c = ahead.pop()
        if isinstance(c, str) or c is not None and c.tag in ("a", "b", "strong", "i", "em", "code", "img", "br", "span"):
            run.append(c)
            continue
        flush()
        if c is None or c.tag in BLOCKED:
            continue
        if re.fullmatch(r"h[1-6]", c.tag):
            out.append("#" * int(c.tag[1]) + " " + inline(c).strip())
        elif c.tag == "pre":
            code = next((n for n in c.walk() if n.tag == "code"), c)
            language = next((k[9:] for k in code.classes + c.classes if k.startswith("language-")), "")
            out.append(f"```{language}\n" + "".join(c.strings()).strip("\n") + "\n```")
        elif c.tag in ("ul", "ol"):
            items = [x for x in c.children if isinstance(x, Node) and x.tag == "li"]
            out.append("\n".join(f"{f'{k}.' if c.tag == 'ol' else '-'} {inline(x).strip()}" for k, x in enumerate(items, 1)))
        elif c.tag == "blockquote":
            out.append("\n".join(f"> {line}" for line in inline(c).strip().split("\n")))
        elif c.tag == "p":
            if text := inline(c).strip():
                out.append(text)
        else:
            ahead += [None, *c.children[::-1]]  # None: the block's end
    flush()
    return "\n\n".join(out)


def main_text(html: str | None) -> str:
    """The page's article: the element whose own paragraphs hold most text, less what is links."""
    best, most = None, 0.0
    for node in parse(html).walk():
        if node.tag not in ("article", "main", "section", "div", "body", "td"):
            continue
        size = 0.0
        for c in node.children:
            if isinstance(c, Node) and c.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "ul", "ol"):
                text = c.text()
                linked = sum(len(n.text()) for n in c.walk() if n.tag == "a")
                size += len(text) - linked
        if size > most:
            best, most = node, size
    return "" if best is None else "\n".join(t for c in best.children if isinstance(c, Node) and c.tag not in ("nav", "footer", "aside", "header") and (t := c.text()))


def _column(function, kind: str = "string"):
    """A function of a page and one more value. Rows go to Python a hundred at a time, not in Arrow's batches of thousands: pages are
    long, and what a task holds of them mustn't grow with its share."""
    per_row = F.udf(function, kind, useArrow=False)
    per_row.__name__ = function.__name__
    return per_row


def html_text(html: Column) -> Column:
    return _column(lambda h, _: plain_text(h))(html, html)


def html_sanitised(html: Column, base: Column) -> Column:
    return _column(lambda h, b: sanitise(h, b or ""))(html, base)


def html_article(html: Column, base: Column) -> Column:
    return _column(lambda h, b: clean_article(h, b or ""))(html, base)


def html_markdown(html: Column) -> Column:
    return _column(lambda h, _: markdown(h))(html, html)


def html_main_text(html: Column) -> Column:
    return _column(lambda h, _: main_text(h))(html, html)


def html_images(html: Column, base: Column) -> Column:
    return _column(lambda h, b: image_urls(h, b or ""), "array<string>")(html, base)


# What Catalyst can do itself, without a tree:


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))


def looks_scripted(html: Column, text_length: Column) -> Column:
    """A page that scripts fill in: an empty mount point, or hardly any text and three scripts or more."""
    empty = html.rlike(r"""(?is)<div[^>]+id=["'](?:root|app|__next)["'][^>]*>\s*</div>""")
    return empty | ((text_length < 600) & (F.size(F.regexp_extract_all(html, F.lit(r"(?i)(<script)"), F.lit(1))) >= 3))


def rough_text(html: Column) -> Column:
    """Text by patterns: for lengths and searches where exact structure doesn't matter."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))

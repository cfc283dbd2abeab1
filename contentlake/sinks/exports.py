"""Exports: notes, magazines as EPUB, deliveries, change logs, snapshots."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.functions import text as T
from contentlake.functions.html import html_markdown
from contentlake.operators.delivery import numbered_stems

STAMP = (2024, 1, 1, 0, 0, 0)  # files inside an issue carry no clock time


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def notes(entries: DataFrame, body: Column, tags: Column, created_ms: int) -> DataFrame:
    """(entry_id, path, content): a Markdown note with front matter per entry.

    entries: entry_id, title, url, feed_title, author, published_at_ms. Notes of one name are numbered; entries of one
    address are one note, the newest.
    """
    rows = entries.withColumns({"_body": body, "_tags": F.transform(tags, T.tag_name), "stem": T.file_stem(F.col("title"))})
    newest = rows.groupBy(F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(F.concat(F.lit("id:"), F.col("entry_id").cast("string"))).alias("_source")).agg(F.max_by(F.struct(*rows.columns), F.struct("published_at_ms", "entry_id")).alias("r"))
    named = numbered_stems(newest.select("r.*"))
    listed = lambda c: F.when(F.size(c) == 0, F.lit("[]")).otherwise(F.concat(F.lit("\n  - "), F.array_join(c, "\n  - ")))
    front = F.concat(
        F.lit("---\ntitle: "), _quoted(F.col("title")), F.lit("\nsource: "), _quoted(F.coalesce("url", F.lit(""))), F.lit("\nfeed: "), _quoted(F.col("feed_title")), F.lit("\nauthor: "), _quoted(F.col("author")),
        F.lit("\npublished: "), T.iso_date(F.col("published_at_ms")), F.lit("\ncreated: "), T.iso_date(F.lit(created_ms)), F.lit("\ntags: "), listed(F.col("_tags")), F.lit("\naliases: "), listed(F.array(_quoted(F.col("title")))), F.lit("\n---\n\n"),
    )
    content = F.concat(front, F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("_body"), F.lit("\n"))
    return named.select("entry_id", F.concat("file_name", F.lit(".md")).alias("path"), content.alias("content"))


def note_body(html: Column) -> Column:
    return html_markdown(html)


def fill_template(template: str, **values: Column) -> Column:
    """A user's template: {{name}} becomes the column of that name."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return out


def _page(title: str, body: str, language: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{language}"><head><title>{escape(title)}</title></head><body>{body}</body></html>'


def epub(issue: str, articles: Sequence[dict], language: str = "en", identifier: str = "") -> bytes:
    """An EPUB 3 book with a nested table of contents (and its older form): articles have section, title, meta, text."""
    files, sections = {}, {}
    for k, a in enumerate(articles):
        name = f"text/a{k:05d}.xhtml"
        body = "".join(f"<p>{escape(line)}</p>" for line in a["text"].split("\n") if line.strip())
        files[name] = _page(a["title"], f'<h1>{escape(a["title"])}</h1><p class="meta">{escape(a["meta"])}</p>{body}', language)
        sections.setdefault(a["section"], []).append((name, a["title"]))
    toc = "".join(f"<li><span>{escape(s)}</span><ol>" + "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, t in items) + "</ol></li>" for s, items in sections.items())
    nav = _page(issue, f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><h1>{escape(issue)}</h1><ol>{toc}</ol></nav>', language)
    points = "".join(f'<navPoint id="n{k}" playOrder="{k}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for k, (n, t) in enumerate((x for items in sections.values() for x in items), 1))
    ncx = f'<?xml version="1.0" encoding="UTF-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{escape(identifier or issue)}"/></head><docTitle><text>{escape(issue)}</text></docTitle><navMap>{points}</navMap></ncx>'
    cover = _page(issue, f"<h1>{escape(issue)}</h1>", language)
    items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(files))
    spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(files)))
    opf = (
        f'<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">{escape(identifier or issue)}</dc:identifier>'
        f'<dc:title>{escape(issue)}</dc:title><dc:language>{language}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
        f'<item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/>{items}</manifest><spine toc="ncx"><itemref idref="cover"/>{spine}</spine></package>'
    )
    container = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", STAMP), "application/epub+zip", zipfile.ZIP_STORED)
        for name, data in {"META-INF/container.xml": container, "OEBPS/content.opf": opf, "OEBPS/nav.xhtml": nav, "OEBPS/toc.ncx": ncx, "OEBPS/cover.xhtml": cover} .items():
            z.writestr(zipfile.ZipInfo(name, STAMP), data, zipfile.ZIP_DEFLATED)
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(f"OEBPS/{name}", STAMP), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def issues(articles: DataFrame) -> DataFrame:
    """(issue, articles, book): an EPUB for each issue of (issue, section_no, place, section, title, meta, text).

    An issue has as many articles as a magazine allows, so it fits a task.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["section_no", "place"])
        issue = pdf["issue"].iloc[0]
        return pd.DataFrame({"issue": [issue], "articles": [len(pdf)], "book": [epub(issue, pdf[["section", "title", "meta", "text"]].to_dict("records"))]})

    return articles.groupBy("issue").applyInPandas(build, "issue string, articles long, book binary")


def deliveries(batched: DataFrame, subject: Column, by: str = "feed_id") -> DataFrame:
    """(batch, subject, stem, entry_ids): mails for batches (by, batch, entry_id, pos); numbered if a group has several."""
    groups = batched.groupBy(by, "batch").agg(F.sort_array(F.collect_list(F.struct("pos", "entry_id"))).alias("e"))
    rows = groups.join(batched.groupBy(by).agg(F.max("batch").alias("of")), by)
    some = F.col("of") > 1
    number = F.concat(F.lit(" ("), F.col("batch").cast("string"), F.lit("/"), F.col("of").cast("string"), F.lit(")"))
    return rows.select("batch", F.concat(subject, F.when(some, number).otherwise(F.lit(""))).alias("subject"), F.concat(T.slug(subject), F.when(some, F.concat(F.lit("-"), F.col("batch").cast("string"))).otherwise(F.lit(""))).alias("stem"), F.col("e.entry_id").alias("entry_ids"))


def fan_out(channels: Sequence[Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands a batch to every channel; one that fails doesn't stop the others."""

    def send(batch: DataFrame, _: int) -> None:
        batch.persist()
        failed = []
        for channel in channels:
            try:
                channel(batch)
            except Exception as e:  # reported once all channels had their turn
                failed.append(f"{getattr(channel, '__name__', channel)}: {e}")
        batch.unpersist()
        if len(failed) == len(channels) and failed:
            raise RuntimeError("; ".join(failed))

    return send


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def read_snapshot(spark, names: Sequence[str], path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def swap_in(df: DataFrame, path: str) -> None:
    """Write a table beside the old one and put it in its place: readers see one or the other."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old, at = (jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in (".new", ".old", ""))
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    files.delete(old, True)
    if files.exists(at):
        files.rename(at, old)
    files.rename(new, at)
    files.delete(old, True)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_texts(rows: DataFrame, folder: str) -> None:
    """Files (path, content) in a folder that all executors see; each task writes its own."""

    def write(part: Iterator) -> None:
        import pathlib

        for r in part:
            at = pathlib.Path(folder, r["path"])
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(r["content"], encoding="utf-8")

    rows.select("path", "content").foreachPartition(write)

"""Expected rows of what SQL can't express: texts, articles, guessed listings and notes of pages."""

import pytest
from pyspark.sql import functions as F

from contentlake.functions import html as H
from contentlake.sinks import exports
from contentlake.sources import pages

STORY = '<article class="post"><h2><a href="/{0}">{1} story of the day</a></h2><time datetime="2024-02-0{2}T00:00:00Z">then</time><p>{3}</p></article>'
TEXTS = ("Alpha &amp; beta, with enough words to be an article of some length, I should think.", "Gamma <b>delta</b>, again with enough words to be taken for one of some length.", "Epsilon, and still enough words to be taken for an article of some length.")
PAGE = '<html><head><title>T</title><style>p{}</style><script>x("</p>")</script></head><body><nav><a href="/n">nav</a></nav>' + "".join(STORY.format(n.lower(), n, k + 3, t) for k, (n, t) in enumerate(zip(("First", "Second", "Third"), TEXTS, strict=True))) + "</body></html>"
PLAIN = ("Alpha & beta, with enough words to be an article of some length, I should think.", "Gamma delta, again with enough words to be taken for one of some length.", "Epsilon, and still enough words to be taken for an article of some length.")
DAY_MS, THIRD_OF_FEBRUARY = 86_400_000, 1_706_918_400_000


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, "https://e.org/x", PAGE), (2, "https://e.org/y", None), (3, "https://e.org/z", "")], "page_id long, url string, html string")


def test_texts(page):
    found = {r["page_id"]: r["t"] for r in page.select("page_id", H.html_text(F.col("html")).alias("t")).collect()}
    assert found[1].split("\n") == ["T", "nav", "First story of the day", "then", PLAIN[0], "Second story of the day", "then", "Gamma", "delta", ", again with enough words to be taken for one of some length.", "Third story of the day", "then", PLAIN[2]]
    assert not found[2] and not found[3]


def test_articles_of_a_listing(page):
    found = pages.scraped(page.filter("page_id = 1"), pages.Scrape(item="article", title="h2", link="a[href]"), THIRD_OF_FEBRUARY + 30 * DAY_MS).collect()
    want = [(1, k, f"{n} story of the day", f"https://e.org/{n.lower()}", PLAIN[k], "", THIRD_OF_FEBRUARY + k * DAY_MS) for k, n in enumerate(("First", "Second", "Third"))]
    assert [tuple(r) for r in found] == want


def test_a_guessed_listing(page):
    found = pages.guess_selectors(pages.elements(page)).collect()
    assert [(r["page_id"], r["rank"], r["signature"], r["count"], round(r["score"], 9)) for r in found] == [(1, 1, "article.post", 3, round((2 + 3 + 1) * (3 / 30 + 0.5), 9))]


def test_the_article_of_a_page(page):
    body = " ".join(f"word{k}, and more" for k in range(60))
    html = f"<body><nav><a href='/a'>a</a><a href='/b'>b</a></nav><div><p>{body}</p></div><footer>end</footer></body>"
    got = page.filter("page_id = 1").select(H.html_main_text(F.lit(html))).first()[0]
    assert got == body


def test_notes(spark):
    made = spark.range(1).select(exports.note_body(F.lit('<h1>A</h1><p>b <em>c</em></p><ul><li>x</li></ul><pre><code class="language-py">1</code></pre>'))).first()[0]
    assert made == "# A\n\nb *c*\n\n- x\n\n```py\n1\n```"

"""Folding over all of Unicode, markup of any depth, and what reaches a reader."""

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from contentlake.functions import html as H
from contentlake.functions.text import fold, fold_text
from contentlake.operators import ingest, rules, search, tables
from contentlake.sources import feeds


def test_fold_equals_fold_text_for_every_character(spark):
    signs = [chr(k) for k in range(1, sys.maxunicode + 1) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) != "Cn"]
    r = random.Random(1)
    texts = ["x".join(signs[k : k + 200]) for k in range(0, len(signs), 200)] + ["".join(r.choices(signs[:3000], k=30)) for _ in range(300)]
    texts += ["Žluťoučký kůň", "Ősz", "źdźbło", "Tiếng Việt", "İstanbul", "각 가", "…½ ﬁ Ⅷ", "   x　", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold(F.col("t")).alias("f")).collect()
    wrong = [(r["t"], r["f"]) for r in rows if r["f"] != fold_text(r["t"])]
    assert not wrong, [(x, fold_text(x[0])) for x in wrong[:3]]


@pytest.mark.parametrize("title,word", [("Žluťoučký kůň", "zlutoucky"), ("Őszi szél", "OSZI"), ("Żółta łódź", "zołta"), ("Tiếng Việt", "tieng viet")])
def test_rules_and_search_fold_alike(spark, title, word):
    class Archive:
        entries = spark.createDataFrame([(1, title, ""), (2, "other", title), (3, "none", "")], "entry_id long, title string, body_text string")

    rows = Archive.entries.withColumns({c: F.lit("") for c in ("author", "url", "lang", "feed_custom", "feed_title", "feed_url")})
    rule = rules.Rule("r", rules.Group(all=[rules.Condition("any", "contains", word)]), (("star", "true"),))
    done = rules.evaluate(rows, [rule]).filter(F.size("rules") > 0)
    assert {r[0] for r in done.collect()} == {1, 2} == {r[0] for r in search.match(Archive, word).collect()}


def test_content_falls_back_to_the_summary(spark):
    rows = spark.createDataFrame([(1, "", "zebra"), (2, "body", "zebra"), (3, None, "zebra")], "entry_id long, body_text string, summary string")
    rows = rows.withColumns({c: F.lit("") for c in ("title", "author", "url", "lang", "feed_custom", "feed_title", "feed_url")})
    rule = rules.Rule("r", rules.Group(all=[rules.Condition("content", "equals", "zebra")]), (("star", "true"),))
    assert {r[0] for r in rules.evaluate(rows, [rule]).filter(F.size("rules") > 0).collect()} == {1, 3}


def test_passages_are_found_whatever_touches_their_ends(spark):
    passage = "one two three four five six seven eight"
    bodies = [passage, f'He said: "{passage}"', f"({passage}, and more", f"pre{passage}fix", "one two three four five six seven", passage.replace("four", "4")]
    entries = spark.createDataFrame(list(enumerate(bodies)), "entry_id long, body_text string")
    passages = spark.createDataFrame([(7, passage), (8, passage + " nine"), (9, "too short")], "item_id long, text string")
    assert {tuple(r) for r in ingest.syndicated(entries, passages).collect()} == {(k, 7) for k in range(4)}


def test_markup_of_any_depth():
    deep = "<div>" * 100_000 + "<b>x</b>" + "</div>" * 100_000
    assert H.plain_text(deep) == "x" and H.markdown(deep) == "**x**" and H.image_urls(deep) == [] and H.main_text(deep) == ""
    assert H.sanitise(deep).count("<div>") == 100_000 and H.clean_article(deep).count("<div>") == 100_000


@pytest.mark.parametrize("tag", sorted(H.BLOCKED))
def test_blocked_elements_go_with_what_they_hold(tag):
    inner = "" if tag in H.VOID else f"gone</{tag}>"
    got = H.sanitise(f"<p>a</p><{tag}>{inner}<p>b</p>")
    assert tag not in got.replace("base", tag if tag == "base" else "") and "gone" not in got and "<p>a</p>" in got


@pytest.mark.parametrize("attribute", ["onclick", "ONLOAD", "srcdoc", "formaction", "background", "ping"])
def test_blocked_attributes_go(attribute):
    assert H.sanitise(f'<p {attribute}="x" style="color:red" class="c" id="i" srcset="s">t</p>') == '<p style="color:red" class="c" id="i" srcset="s">t</p>'


@pytest.mark.parametrize("attribute", ["href", "src", "poster", "action"])
@pytest.mark.parametrize("scheme", ["javascript:x", " JavaScript:x", "vbscript:x", "data:text/html,x", "java\nscript:x"])
def test_addresses_that_run_go(attribute, scheme):
    assert H.sanitise(f'<a {attribute}="{scheme}">t</a>') == "<a>t</a>"
    assert H.sanitise(f'<a {attribute}="/x">t</a>', "https://a.org/b") == f'<a {attribute}="https://a.org/x">t</a>'


def test_tracking_pictures_go():
    kept = '<img src="/a" width="40">'
    gone = ['<img src="/a" width="1">', '<img src="/a" height="0px">', '<img src="/a" style="width: 1px">', "<img alt='x'>"]
    assert H.sanitise(kept + "".join(gone) + "<!-- note -->") == kept


def test_journal_numbers_follow_pos(spark):
    pos = random.Random(3).sample(range(10_000), 700)
    changes = spark.createDataFrame([(f"e{p}", "read", "true", p) for p in pos], "entity_id string, field string, val string, pos long").repartition(5)
    got = {r["entity_id"]: (r["seq"], r["lamport"]) for r in tables.journal(changes, "d", 10, 100, 0).collect()}
    assert got == {f"e{p}": (101 + k, 11 + k) for k, p in enumerate(sorted(pos))}
    assert tables.journal(changes.limit(0), "d", 1, 1, 0).count() == 0


def test_outlines_by_folder(spark):
    rows = [(f"f{k % 3} & co", f'https://x.org/?a={k}&b="{k}"', f"<t{k}>") for k in range(40)]
    df = spark.createDataFrame(rows, "folder string, url string, title string")
    got = feeds.read_outlines(feeds.opml_documents(df, 4)).collect()
    assert sorted((r["folder"], r["url"], r["title"]) for r in got) == sorted(rows)


def test_an_updated_index_equals_a_new_one(spark, tmp_path):
    class Archive:
        def __init__(self, rows):
            self.entries = spark.createDataFrame(rows, "entry_id long, title string, body_text string")

    old = Archive([(1, "Žlutý kůň", "of the sea"), (2, "of the", "x of that"), (3, None, "of a")])
    new = Archive([(2, "other", "words"), (4, "of the", None)])
    whole = Archive([(1, "Žlutý kůň", "of the sea"), (2, "other", "words"), (4, "of the", None)])
    index = search.write_index(search.postings(old), str(tmp_path / "a"))
    gone = spark.createDataFrame([(3,)], "entry_id long")
    index = search.write_index(search.updated_index(index, new, gone), str(tmp_path / "b"))
    assert sorted(map(tuple, index.drop("shelf").collect())) == sorted(map(tuple, search.postings(whole).collect()))
    for query in ('"of the"', "zlut*", "of NOT sea", "o*", "title: other OR kun"):
        assert sorted(search.match(whole, query, index).collect()) == sorted(search.match(whole, query).collect())
    plan = search.match(whole, "zluty", index)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shelf" in plan.split("PartitionFilters: [")[1].split("]")[0]

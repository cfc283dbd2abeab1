"""Ranking on a stored index, folding once."""

import random

import pytest
from pyspark.sql import functions as F

from contentlake.operators import ranking, rules, search


def archive_of(spark, rows):
    class Archive:
        entries = spark.createDataFrame(rows, "entry_id long, title string, body_text string")

    return Archive


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    r = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(r.choices(words, k=3)), " ".join(r.choices(words, k=r.choice([5, 30, 200, 900])) + ["rare"] * (k % 97 == 0) * r.randint(1, 5))) for k in range(1500)]
    archive = archive_of(spark, [*rows, (5000, None, None), (5001, "", "")])
    return archive, ranking.write_ranked(archive, str(tmp_path_factory.mktemp("ranked")), per_block=16)


@pytest.mark.parametrize("words,limit", [(["rare"], 5), (["rare", "w3"], 10), (["w1", "w2", "w3"], 20), (["absent"], 5), (["rare"], 100), ([], 3)])
def test_ranked_search_equals_ranking_of_all(large, words, limit):
    archive, index = large
    found = [(r["entry_id"], round(r["rank"], 9)) for r in ranking.search(index, words, limit).collect()]
    assert found == [(r["entry_id"], round(r["rank"], 9)) for r in search.search(archive, words, limit).collect()]


def test_blocks_are_skipped_and_texts_not_read(large):
    _, index = large
    _, blocks = ranking.reaching(index, ["rare", "w3"], 5)
    _, every = ranking.bounds(index, ["rare", "w3"])
    assert blocks.count() < every.count() / 3
    plan = ranking.search(index, ["rare", "w3"], 5)._jdf.queryExecution().toString()
    assert "body_text" not in plan and "title" not in plan and "PartitionFilters: [shelf" in plan


def test_empty_archive(spark, tmp_path):
    index = ranking.write_ranked(archive_of(spark, []), str(tmp_path))
    assert ranking.search(index, ["a"], 3).collect() == []


def folds(df) -> int:
    """How often the plan translates a text by the large table (once in each fold)."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("translate(")


def test_only_named_fields_are_folded_and_each_once(spark):
    rows = spark.createDataFrame([(1, "Été", "Corps à corps", "ann")], "entry_id long, title string, body_text string, author string")
    rows = rows.withColumns({c: F.lit("x") for c in ("url", "lang", "feed_custom", "feed_title", "feed_url", "feed_id", "folder_id", "folder_name")})
    one = lambda f, v: rules.Rule(f + v, rules.Group(all=[rules.Condition(f, "contains", v)]), (("star", "true"),))
    single = folds(rules.evaluate(rows, [one("title", "e")]))
    assert single and folds(rules.evaluate(rows, [one("title", "e"), one("title", "t"), one("title", "z")])) == single
    assert folds(rules.evaluate(rows, [one("title", "e"), one("content", "t")])) == 2 * single
    assert folds(rules.evaluate(rows, [one("title", "e"), one("content", "t"), one("author", "a"), one("any", "ete \ncorps")])) == 3 * single
    assert folds(rules.evaluate(rows, [rules.Rule("r", rules.Group(all=[rules.Condition("title", "regex", "t")]), (("star", "true"),))])) == 0
    got = rules.evaluate(rows, [one("any", "ete \ncorps a corps \nann")]).first()
    assert got["rules"] == ["anyete \ncorps a corps \nann"]


def test_a_frequent_word_is_dealt_by_block(spark, tmp_path):
    rows = [(k, "all", "all " * (1 + k % 3) + f"only{k}") for k in range(600)]
    index = ranking.write_ranked(archive_of(spark, rows), str(tmp_path), per_block=16, per_task=200)
    found = index.postings.filter("term = 'all'")
    assert found.select(F.input_file_name()).distinct().count() > 4
    assert found.count() == found.select("block").distinct().count() and found.agg(F.sum("held"), F.sum(F.size("entries"))).first()[:] == (600, 600)
    assert index.terms.filter("term IN ('all', 'only7')").select("term", "df").sort("term").collect() == [("all", 600), ("only7", 1)]

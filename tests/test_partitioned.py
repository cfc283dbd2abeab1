"""The partitioned archive: a batch writes the partitions that it touches, and no others."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from contentlake.operators import ingest, partitioned

SCHEMA = "entry_id long, feed_id string, guid_hash string, content_hash string, published_at_ms long, title string"


def row(k, feed="f1", day=0, text="a", guid=None):
    return (k, feed, guid or f"g{k}", text, day * partitioned.DAY_MS if day is not None else None, f"title {k}")


@pytest.fixture
def archive(spark, tmp_path):
    rows = [row(k, f"f{k % 5}", k % 6) for k in range(60)] + [(100, None, None, "n", None, "no key")]
    return partitioned.create(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "archive"))


def files(archive, table="entries"):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{archive.path}/{table}/**/*.parquet", recursive=True)}


def state(archive):
    return sorted((tuple(r) for r in archive.entries.select("entry_id", "feed_id", "guid_hash", "content_hash", "published_at_ms", "title").collect()), key=repr)


def test_a_batch_writes_what_it_touches_and_no_more(spark, archive):
    before, old = files(archive), state(archive)
    batch = spark.createDataFrame([row(7, "f2", 1, "edited"), row(500, "f2", 1), row(13, "f3", 1), row(12, "f2", 0)], SCHEMA)
    done = {r["entry_id"]: r["action"] for r in partitioned.apply(archive, batch).collect()}
    assert done == {7: "update", 500: "insert", 13: "skip", 12: "skip"}
    after = files(archive)
    assert len(set(before) - set(after)) == 1 and len(set(after) - set(before)) == 1  # one partition, one file
    assert all(before[p] == after[p] for p in set(before) & set(after))
    assert state(archive) == sorted([x for x in old if x[0] != 7] + [row(7, "f2", 1, "edited"), row(500, "f2", 1)], key=repr)


def test_a_repeated_batch_changes_nothing(spark, archive):
    batch = spark.createDataFrame([row(7, "f2", 1, "edited"), row(500, "f2", 9)], SCHEMA)
    partitioned.apply(archive, batch)
    once, held = state(archive), {t: files(archive, t) for t in ("entries", "keys", "filters")}
    assert {r["action"] for r in partitioned.apply(archive, batch).collect()} == {"skip"}
    assert state(archive) == once and {t: files(archive, t) for t in held} == held


def test_a_moved_entry_leaves_its_old_partition(spark, archive):
    assert partitioned.apply(archive, spark.createDataFrame([row(7, "f2", 40, "edited")], SCHEMA)).first()["action"] == "update"
    assert [x[4] for x in state(archive) if x[0] == 7] == [40 * partitioned.DAY_MS]
    alone = spark.createDataFrame([row(7, "f2", 41, "again")], SCHEMA)
    partitioned.apply(archive, alone)  # its partition of day 40 is empty now
    assert [x[4] for x in state(archive) if x[0] == 7] == [41 * partitioned.DAY_MS]


def test_a_failure_between_tables_is_mended_by_the_same_batch(spark, archive, monkeypatch):
    batch = spark.createDataFrame([row(7, "f2", 1, "edited"), row(500, "f2", 1)], SCHEMA)
    real, calls = partitioned._replace, []

    def failing(rows, path, by):
        calls.append(path)
        if path.endswith("keys"):
            raise RuntimeError("executor lost")
        real(rows, path, by)

    monkeypatch.setattr(partitioned, "_replace", failing)
    with pytest.raises(RuntimeError):
        partitioned.apply(archive, batch)
    monkeypatch.setattr(partitioned, "_replace", real)
    partitioned.apply(archive, batch)
    assert [x for x in state(archive) if x[0] in (7, 500)] == sorted([row(7, "f2", 1, "edited"), row(500, "f2", 1)], key=repr) and len(state(archive)) == 62


def test_false_alarms_are_resolved_and_certain_inserts_meet_no_key(spark, archive, monkeypatch):
    news = spark.createDataFrame([row(k, "f9", 3) for k in range(1000, 1300)], SCHEMA)
    maybe = partitioned.maybe_known(archive, partitioned._placed(news)).filter("maybe").count()
    assert maybe < 10
    monkeypatch.setattr(partitioned, "_is_set", lambda bits, bit: F.lit(True))  # every key a false alarm
    assert {r["action"] for r in partitioned.classify(archive, news).collect()} == {"insert"}
    monkeypatch.undo()
    plan = partitioned.classify(archive, spark.createDataFrame([row(7, "f2", 1)], SCHEMA))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and plan.count("slot#") and " IN (" not in plan.split("PartitionFilters")[1][:40]


def test_equal_to_the_merge_of_whole_tables_with_odd_rows(spark, archive):
    batch = spark.createDataFrame([row(k, f"f{k % 5}", k % 6, "x" if k % 7 else "a") for k in range(30, 90)] + [(101, None, None, "other", None, "t"), row(700, "f1", None), row(701, "f1", 2, guid="g700")], SCHEMA)
    old = spark.createDataFrame(archive.entries.drop("day", "bucket").collect(), SCHEMA)
    partitioned.apply(archive, batch)
    fold = lambda df: df.withColumns({c: F.coalesce(c, F.lit("~")) for c in ("feed_id", "guid_hash")})
    one = batch.filter("entry_id <> 701")  # same key as 700
    want = ingest.merge(fold(old), ingest.classify(fold(one), fold(old)))
    assert sorted((r["entry_id"], r["content_hash"]) for r in want.collect()) == sorted((x[0], x[3]) for x in state(archive))


def test_empty_batch(spark, archive):
    before = files(archive)
    assert partitioned.apply(archive, spark.createDataFrame([], SCHEMA)).collect() == [] and files(archive) == before


def test_partitions_grow_with_the_rows_and_not_with_the_days(spark, tmp_path):
    rows = spark.range(6000).selectExpr("id AS entry_id", "concat('f', id % 5) AS feed_id", "cast(id AS string) AS guid_hash", "'a' AS content_hash", f"id DIV 5 * {partitioned.DAY_MS} AS published_at_ms", "'t' AS title")
    held = partitioned.create(rows, str(tmp_path / "many"), per_partition=100)
    assert held.span_days == 128 and len(files(held)) <= 60 and held.entries.count() == 6000  # 1,200 days of 5 rows
    assert held.entries.filter(f"day <> published_at_ms DIV {partitioned.DAY_MS}").count() == 0
    partitioned.apply(held, spark.createDataFrame([row(7, "f2", 900, "edited", guid="7"), row(9000, "f2", 900)], SCHEMA))
    assert len(files(held)) <= 60 and held.entries.count() == 6001
    assert held.entries.filter("entry_id = 7").select("day", "content_hash").collect() == [(900, "edited")]


def test_spans_of_one_day_empty_and_fill(spark, tmp_path):
    held = partitioned.create(spark.createDataFrame([row(k, "f1", k // 3) for k in range(9)], SCHEMA), str(tmp_path / "days"), per_partition=3)
    assert held.span_days == 1 and len(files(held)) == 3
    partitioned.apply(held, spark.createDataFrame([row(k, "f1", 40, "moved") for k in range(3)], SCHEMA))
    assert len(files(held)) == 3 and sorted(r[0] for r in held.entries.select("day").distinct().collect()) == [1, 2, 40]


def test_a_small_archive_of_many_days_has_few_files(spark):
    from contentlake.bindings import Archive
    from contentlake.plans.archive_queries import stored

    held, batch = stored(Archive(spark, "/root/testdata/sf0.01"))
    assert held.entries.select("day").distinct().count() > 40 and len(held.entries.inputFiles()) <= partitioned.BUCKETS
    assert partitioned.classify(held, batch).filter("action = 'insert'").count() == 500

"""Streams with state against the batch operators, for any order and cut into batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from contentlake.operators import delivery, sync
from contentlake.streaming import jobs, stateful

OPS = "entity_id long, field string, val double, lamport long, device_id string, seq long"


@pytest.fixture(autouse=True)
def store(spark):
    with stateful.rocksdb(spark):
        yield


def written(spark, rows, schema, path, cuts):
    edges = [0, *cuts, len(rows)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{path}")


def ops_of(seed):
    r = random.Random(seed)
    return [(r.randint(1, 12), r.choice(["read", "starred"]), float(r.randint(0, 9)), r.randint(1, 20), r.choice("ab"), k) for k in range(80)]


@pytest.mark.parametrize("seed", [1, 2])
def test_parked_ops_are_released_in_any_order_and_after_a_restart(spark, tmp_path, seed):
    r, ops = random.Random(seed), ops_of(seed)
    arrived = [(k,) for k in range(1, 9)]
    shuffled = r.sample(ops, len(ops))
    r.shuffle(arrived)
    at = f"file://{tmp_path}"
    half = r.randint(10, 60)
    written(spark, shuffled[:half], OPS, f"{at}/ops", [r.randint(1, half - 1)])
    written(spark, arrived[:3], "entity_id long", f"{at}/entities", [1])

    def run():
        ops_, entities = (jobs.read_log(spark, f"{at}/{n}", s) for n, s in (("ops", OPS), ("entities", "entity_id long")))
        return jobs.run_once(stateful.released(ops_, entities), "released", "append", f"{at}/checkpoint")

    run()
    written(spark, shuffled[half:], OPS, f"{at}/ops", [])
    written(spark, arrived[3:], "entity_id long", f"{at}/entities", [2])
    found = run()  # goes on from the checkpoint
    columns = ["entity_id", "field", "val", "lamport", "device_id", "seq"]
    assert sorted(tuple(x) for x in found.select(*columns).collect()) == sorted(x for x in ops if x[0] < 9)
    everything = spark.createDataFrame(ops, OPS)
    known = spark.createDataFrame([(k,) for k in range(1, 9)], "entity_id long")
    want = sync.replay(sync.parked(everything, known.limit(0), ["read", "starred"]), known, everything.limit(0))
    pick = ["entity_id", "field", "val", "lamport", "device_id"]
    assert sorted(map(tuple, sync.resolve(found).select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))


def test_timers_count_tries(spark, tmp_path):
    at = f"file://{tmp_path}"
    written(spark, ops_of(1)[:5], OPS, f"{at}/ops", [])
    written(spark, [(99,)], "entity_id long", f"{at}/entities", [])
    ops, entities = (jobs.read_log(spark, f"{at}/{n}", s) for n, s in (("ops", OPS), ("entities", "entity_id long")))
    query = stateful.released(ops, entities, 100).writeStream.outputMode("append").option("checkpointLocation", f"{at}/c").format("parquet").option("path", f"{at}/out").start()
    try:
        until = time.time() + 60
        while (query.lastProgress or {"batchId": 0})["batchId"] < 4 and time.time() < until:
            time.sleep(0.5)
        written(spark, [(k,) for k in range(1, 13)], "entity_id long", f"{at}/entities", [])
        found, until = [], time.time() + 60
        while len(found) < 5 and time.time() < until:
            time.sleep(1)
            found = spark.read.schema(stateful.RELEASED).parquet(f"{at}/out").collect()
    finally:
        query.stop()
    assert len(found) == 5 and all(r["tries"] > 1 for r in found)


@pytest.mark.parametrize("cuts", [[], [10, 50], [1, 2, 3, 119]])
def test_buckets_of_a_stream_equal_those_of_a_table(spark, tmp_path, cuts):
    r = random.Random(4)
    ts, rows = 1_000_000, []
    for pos in range(120):
        ts += r.choice([0, 1000, 60_000, 200_000, 400_000])
        rows.append((r.choice("xyz"), pos, ts - r.choice([0, 0, 5000])))
    at = f"file://{tmp_path}"
    schema = "key string, pos long, ts_ms long"
    written(spark, rows, schema, f"{at}/rows", cuts)
    stream = lambda: stateful.coalesced(jobs.read_log(spark, f"{at}/rows", schema), "10 minutes")
    early = jobs.run_once(stream(), "told", "append", f"{at}/checkpoint")
    table = delivery.coalesce_notifications(spark.createDataFrame(rows, schema)).groupBy("key", "bucket").agg(F.count("*").alias("count"), F.min_by("ts_ms", "pos").alias("first_ts_ms"), F.min("pos").alias("first_pos"))
    want = sorted(map(tuple, table.collect()))
    assert early.count() < len(want)  # the last ones are open
    written(spark, [(None, 0, ts + 10_000_000)], schema, f"{at}/rows", [])
    assert sorted(map(tuple, jobs.run_once(stream(), "told", "append", f"{at}/checkpoint").select("key", "bucket", "count", "first_ts_ms", "first_pos").collect())) == want


def test_a_restart_without_news_gives_the_last_result(spark, tmp_path):
    at = f"file://{tmp_path}"
    written(spark, ops_of(3), OPS, f"{at}/ops", [])
    run = lambda: jobs.run_once(jobs.stream_winners(jobs.read_log(spark, f"{at}/ops", OPS)), "winners", "complete", f"{at}/checkpoint")
    first = sorted(map(tuple, run().collect()))
    assert first and sorted(map(tuple, run().collect())) == first


def test_parked_ops_pass_as_rows_without_a_frame_for_each_entity(spark, tmp_path):
    ops = "entity_id long, field string, val double, lamport long, device_id string, seq long"
    (tmp_path / "ops").mkdir()
    (tmp_path / "entities").mkdir()
    plan = stateful.released(jobs.read_log(spark, f"{tmp_path}/ops", ops), jobs.read_log(spark, f"{tmp_path}/entities", "entity_id long"))._jdf.queryExecution().toString()
    assert "TransformWithStateInPySpark" in plan and "TransformWithStateInPandas" not in plan


def test_watching_takes_few_batches_however_many_files(spark, tmp_path):
    rows = [(k % 7, k, "ab"[k // 7 % 3 == 0]) for k in range(210)]
    written(spark, sorted(rows), "entity_id long, visit long, seen string", f"file://{tmp_path}/visits", range(30, 210, 30))  # a file per key
    files = jobs.share_of_files(spark, f"file://{tmp_path}/visits", 3)
    assert files == 3
    stream = jobs.stream_changes(jobs.read_log(spark, f"file://{tmp_path}/visits", "entity_id long, visit long, seen string", files), "entity_id", "visit", "seen")
    found = jobs.run_once(stream, "watched", "append", f"file://{tmp_path}/state")
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) == 3
    want = [(e, v, s) for e, v, s in rows if v < 7 or s != "ab"[(v - 7) // 7 % 3 == 0]]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)

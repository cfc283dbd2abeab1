"""Counters kept up to date, counts in passing, values of any kind."""

import random

import pytest
from pyspark.sql import functions as F

from contentlake.operators import counters, sync, variants
from contentlake.operators.tree import closure, rollup

OPS = "entity_id long, field string, json string, lamport long, device_id string, seq long"


@pytest.mark.parametrize("seed", [1, 2])
def test_unread_counts_after_any_writes(spark, seed):
    r = random.Random(seed)
    entries = spark.createDataFrame([(k, f"f{k % 4}") for k in range(40)], "entry_id long, feed_id string")
    feeds = spark.createDataFrame([(f"f{k}", f"d{k % 3}") for k in range(4)], "feed_id string, folder_id string")
    folders = spark.createDataFrame([("d0", None), ("d1", "d0"), ("d2", "d1"), ("d9", None)], "folder_id string, parent_id string")
    state = {k: r.random() < 0.5 for k in range(25)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "entry_id long, is_read boolean")
    own = lambda s: frame(s).filter("NOT is_read").join(entries, "entry_id").join(feeds, "feed_id").groupBy("folder_id").agg(F.count("*").alias("unread"))
    pairs = closure(folders)
    counts = rollup(folders, own(state), "unread")
    for _ in range(3):
        batch = {k: r.random() < 0.5 for k in r.sample(range(45), 12)}  # some are of no entry
        changes = counters.unread_changes(entries, frame(state), frame(batch))
        counts = spark.createDataFrame(counters.moved(counts, counters.folder_changes(changes, feeds, pairs), "folder_id").collect(), "folder_id string, unread long")
        state |= {k: v for k, v in batch.items() if k < 40}
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, rollup(folders, own(state), "unread").collect()))
    assert counters.unread_changes(entries, frame(state), frame(state)).count() == 0


def test_outcomes_are_counted_in_one_pass(spark):
    rows = spark.createDataFrame([(k, "applied" if k % 3 else "error") for k in range(10)], "seq long, outcome string")
    watched, watch = counters.observed(rows, "one")
    assert watched.count() == 10 and watch.get == {"applied": 6, "ignored": 0, "pending": 0, "error": 4}
    assert watched._jdf.queryExecution().executedPlan().toString().count("Scan") <= 1


def test_counts_of_a_stream_s_batches(spark, tmp_path):
    schema, told = "seq long, outcome string", []
    for part in ([(1, "applied"), (2, "error")], [(3, "pending")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = counters.BatchCounts("outcomes", lambda _, batch, n: told.append((batch, n)))
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = counters.observed_stream(rows, "outcomes").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    total = {k: sum(n[k] for _, n in told) for k in counters.OUTCOMES}
    assert total == {"applied": 1, "ignored": 0, "pending": 1, "error": 1}


def test_values_of_any_kind(spark):
    ops = [(1, "read", "true", 1, "a", 1), (1, "read", "false", 2, "a", 2), (1, "title", '"x"', 5, "a", 3), (1, "title", "null", 5, "b", 4), (2, "n", "1.5", 1, "a", 5), (2, "bad", "{", 1, "a", 6), (2, "none", None, 1, "a", 7)]
    found = variants.resolve(variants.typed(spark.createDataFrame(ops, OPS)))
    got = {(r[0], r[1]): (r[2], r[3]) for r in found.select("entity_id", "field", variants.kind(F.col("val")), variants.as_text(F.col("val"))).collect()}
    assert got == {(1, "read"): ("boolean", "false"), (1, "title"): ("null", None), (2, "n"): ("number", "1.5"), (2, "bad"): ("null", None), (2, "none"): ("null", None)}
    text = sync.resolve(spark.createDataFrame(ops, OPS).withColumnRenamed("json", "val"))
    assert {(r["entity_id"], r["field"], r["seq"]) for r in text.collect()} == {(r["entity_id"], r["field"], r["seq"]) for r in found.collect()}


def test_scopes_of_other_kinds(spark):
    specs = ['{"days": 3, "folders": ["a", "b"]}', '{"days": "soon", "starred": true, "folders": ["c"]}', "{}"]
    rows = spark.createDataFrame([(str(k), s) for k, s in enumerate(specs)], "device_id string, json string").select("device_id", F.parse_json("json").alias("spec"))
    assert sorted(map(tuple, variants.scope_folders(rows).collect()), key=repr) == [("0", 3, None, "a"), ("0", 3, None, "b"), ("1", None, True, "c")]

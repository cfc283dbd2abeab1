"""Algebra of replication: order and repetition of ops don't matter; clocks decide."""

import random

from pyspark.sql import functions as F

from contentlake.operators import search, sync
from contentlake.operators.tree import closure, descendants, rollup

SCHEMA = "seq long, device_id string, lamport long, entity_id long, field string, val string, ts_ms long"
OPS = [(k, "ab"[k % 2], k // 3, k % 4, "xy"[k % 2], f"v{k}", k) for k in range(60)]


def state(df):
    return sorted(map(tuple, sync.resolve(df).select("entity_id", "field", "val").collect()))


def test_order_and_repetition_do_not_matter(spark):
    want = state(spark.createDataFrame(OPS, SCHEMA))
    best = {}
    for seq, device, lamport, entity, field, val, _ in OPS:
        key = (entity, field)
        if key not in best or (lamport, device) > best[key][:2]:
            best[key] = (lamport, device, val)
    assert want == sorted((*k, v[2]) for k, v in best.items())
    for seed in range(2):
        mixed = OPS + random.Random(seed).sample(OPS, 20)
        random.Random(seed).shuffle(mixed)
        assert state(spark.createDataFrame(mixed, SCHEMA)) == want


def test_merging_states_equals_state_of_all(spark):
    df = spark.createDataFrame(OPS, SCHEMA)
    parts = sync.resolve(df.filter("seq < 30")), sync.resolve(df.filter("seq >= 30"))
    for a, b in (parts, parts[::-1]):
        assert sorted(map(tuple, sync.snapshot_merge(a, b).select("entity_id", "field", "val").collect())) == state(df)


def test_compaction_keeps_the_state(spark):
    df = spark.createDataFrame([(k, "a", k, k % 4, "x", str(k), k) for k in range(60)], SCHEMA)
    small = sync.compacted(df, 40)
    assert state(small) == state(df) and small.count() == 4 + 19 and sync.compacted(df, 0).count() == 60


def test_outcomes(spark):
    rows = [(1, "a", 5, 1, "x", "p", 0), (2, "b", 5, 1, "x", "q", 0), (3, "a", 5, 1, "x", "late", 0), (4, "a", 1, 9, "x", "o", 0), (5, "a", 9, 1, "bad", "e", 0)]
    got = {r["seq"]: r["outcome"] for r in sync.outcomes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1,)], "entity_id long"), ["x"]).collect()}
    assert got == {1: "applied", 2: "applied", 3: "ignored", 4: "pending", 5: "error"}


def test_lamport(spark):
    clocks = [3, 1, 10, 2, 2]
    rows = [(k, "a", c, 1, "x", "", 0) for k, c in enumerate(clocks)]
    got = [r["local_clock"] for r in sync.observe(spark.createDataFrame(rows, SCHEMA), start=2).orderBy("seq").collect()]
    own, want = 2, []
    for c in clocks:
        own = max(own, c) + 1
        want.append(own)
    assert got == want


def test_deep_tree_with_a_cycle(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "x"), ("lost", "none")]
    folders = spark.createDataFrame(rows, "folder_id string, parent_id string")
    pairs = {tuple(r) for r in closure(folders).collect()}
    assert {d for a, d in pairs if a == "a"} == set("abcde") and {d for a, d in pairs if a == "x"} == {"x", "y"} and ("lost", "lost") in pairs
    assert {r[0] for r in descendants(folders, ["c", "x", "none"]).collect()} == {"c", "d", "e", "x", "y", "none", "lost"}
    own = spark.createDataFrame([("c", 3), ("e", 5)], "folder_id string, unread int")
    got = {r["folder_id"]: r["unread"] for r in rollup(folders, own, "unread").collect()}
    assert got["a"] == 8 and got["d"] == 5 and got["lost"] == 0


def test_pull_moves_past_own_ops(spark):
    df = spark.createDataFrame([(k, "me", k, 1, "x", "", 0) for k in range(1, 4)] + [(4, "you", 4, 1, "x", "", 0)], SCHEMA)
    got = sync.pull(df, 0, 4, "me").collect()
    assert len(got) == 1 and got[0]["next_cursor"] == 4 and not got[0]["has_more"]


def test_query_language():
    assert search.read_query('a b OR "c d" NOT e*') == ("or", ("and", ("phrase", ["a"], False, False), ("phrase", ["b"], False, False)), ("not", ("phrase", ["c", "d"], False, False), ("phrase", ["e"], True, False)))
    assert search.read_query("-title:x")[1] == ["body"] and search.read_query("{title body}: Éa")[2] == ("phrase", ["ea"], False, False)
    for bad in ("(a", "AND", "nope:a", "^", "a )"):
        try:
            search.read_query(bad)
        except search.QueryError:
            continue
        raise AssertionError(bad)


def test_bm25_equals_sqlite(spark):
    import sqlite3
    from types import SimpleNamespace

    docs = [(1, "red fox", "the quick red fox jumps"), (2, "dog", "the lazy dog and the fox"), (3, "none", "nothing here at all"), (4, "fox fox", "fox"), (5, "bird", "red red bird"), (6, "more", "words to fill"), (7, "even", "more words")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, body)")
    con.executemany("insert into f(rowid, title, body) values (?, ?, ?)", docs)
    want = dict(con.execute("select rowid, rank from f where f match 'fox OR red' order by rank").fetchall())
    archive = SimpleNamespace(entries=spark.createDataFrame(docs, "entry_id long, title string, body_text string"))
    got = {r["entry_id"]: r["rank"] for r in search.bm25(archive, ["fox", "red"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    for q in ("fox NOT red", "red fox", '"red fox"', "NEAR(quick fox, 1)", "title: fox", "fo*", "^the", "fox OR bird AND red"):
        rows = {r[0] for r in con.execute("select rowid from f where f match ?", (q,))}
        assert {r[0] for r in search.match(archive, q).collect()} == rows, q


def test_filter_reaches_the_scan(spark):
    from contentlake.bindings import Archive
    from contentlake.operators.selection import Selection, select_entries

    plan = select_entries(Archive(spark, "/root/testdata/sf0.001"), Selection(feed_ids=["src3"])).select("entry_id", "feed_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in plan or "In(source, [src3])" in plan
    assert "n_chars" not in plan and "text" not in plan.split("ReadSchema: ")[1].split(">")[0]


def test_streams_equal_batches(spark, tmp_path):
    from contentlake.streaming import jobs

    df = spark.createDataFrame(OPS, SCHEMA)
    df.repartition(5).write.parquet(str(tmp_path / "ops"))
    stream = jobs.stream_winners(jobs.read_log(spark, str(tmp_path / "ops"), df.schema))
    got = jobs.run_once(stream, "winners_test", "complete", str(tmp_path / "state"))
    assert sorted(map(tuple, got.select("entity_id", "field", "val").collect())) == sorted(map(tuple, sync.resolve(df).select("entity_id", "field", "val").collect()))
    assert df.filter(F.col("seq") < 0).count() == 0

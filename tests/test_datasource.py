"""Sources of Spark's Python API against a server on this machine, and table functions."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from contentlake.functions import tables
from contentlake.operators import delivery
from contentlake.sources import datasource
from contentlake.streaming import jobs

OPS = [(k, "d", k, k % 3, "read", float(k), k) for k in range(1, 26)]


@pytest.fixture(scope="module")
def server():
    seen = {"open": 0, "most": 0, "head": 12}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            with lock:
                seen["open"] += 1
                seen["most"] = max(seen["most"], seen["open"])
            try:
                self.answer()
            finally:
                with lock:
                    seen["open"] -= 1

        def answer(self):
            path, _, query = self.path.partition("?")
            asked = dict(x.split("=") for x in query.split("&") if x)
            if path == "/log/head":
                return self.send(200, json.dumps(seen["head"]).encode())
            if path == "/log":
                names = [c.split()[0] for c in datasource.OP.split(", ")]
                page = [dict(zip(names, op, strict=True)) for op in OPS if int(asked["since"]) < op[0] <= seen["head"]][: int(asked["limit"])]
                return self.send(200, json.dumps(page).encode())
            if path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/ok")
                self.end_headers()
                return None
            if path == "/same" and self.headers.get("If-None-Match") == "v1":
                return self.send(304, b"")
            if path == "/gone":
                return self.send(410, b"")
            return self.send(200, b"x" * 5000 if path == "/large" else b"hello")

        def send(self, code, body):
            self.send_response(code)
            self.send_header("ETag", "v1")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    web = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}", seen
    web.shutdown()


def test_pages_are_fetched_by_host(spark, server, tmp_path):
    base, seen = server
    rows = [(f"{base}/{p}", tag) for p, tag in (("ok", None), ("same", "v1"), ("same2", "v1"), ("gone", None), ("large", None), ("moved", None))]
    rows += [("http://127.0.0.1:1/", None), (None, None), ("nonsense", None)]
    spark.createDataFrame(rows, "url string, etag string").repartition(2).write.parquet(f"{tmp_path}/addresses")
    datasource.register(spark)
    seen["most"] = 0
    found = spark.read.format("pages").options(path=f"{tmp_path}/addresses", connections=3, most=1000, timeout=5).load().collect()
    status = {(r["url"] or "").rsplit("/", 1)[-1]: (r["status"], r["http"], bytes(r["content"] or b"")) for r in found if (r["url"] or "").startswith(base)}
    assert status["ok"] == status["moved"] == ("ok", 200, b"hello") and status["gone"] == ("error", 410, b"") and status["large"] == ("error", 200, b"")
    assert status["same"] == ("not_modified", 304, b"") and len(found) == 9 and sum(r["status"] == "error" for r in found) == 5
    assert seen["most"] <= 2  # all of one host are one partition's; a redirect opens while its cause closes


def test_a_log_by_pages_of_a_service(spark, server, tmp_path):
    base, seen = server
    datasource.register(spark)
    seen["head"] = 12
    read = lambda **more: spark.read.format("change_log").options(url=f"{base}/log", limit=5, **more).load()
    assert sorted(r["seq"] for r in read().collect()) == list(range(1, 13)) and sorted(r["seq"] for r in read(since=10).collect()) == [11, 12]
    stream = lambda: jobs.run_once(spark.readStream.format("change_log").options(url=f"{base}/log", limit=5).load(), "ops", "append", f"{tmp_path}/c")
    assert sorted(r["seq"] for r in stream().collect()) == list(range(1, 13))
    seen["head"] = 25
    assert sorted(map(tuple, stream().collect())) == OPS  # from the offset on, each once
    assert sorted(map(tuple, stream().collect())) == OPS


def test_a_log_in_files_survives_a_restart(spark, tmp_path):
    datasource.register(spark)

    def run():
        return sorted(map(tuple, jobs.run_once(spark.readStream.format("change_log").options(path=f"{tmp_path}/log", limit=4).load(), "ops", "append", f"{tmp_path}/c").collect()))

    for part in (OPS[:7], OPS[7:8], OPS[8:]):
        spark.createDataFrame(part, datasource.OP).write.mode("append").parquet(f"{tmp_path}/log")
        run()
    assert run() == OPS
    assert spark.read.format("change_log").options(path=f"{tmp_path}/none").load().count() == 0


def test_table_functions(spark):
    tables.register(spark)
    pages = spark.createDataFrame([("http://a.b/x", '<link rel="alternate" type="application/rss+xml" href="f.xml">'), ("http://a.b/y", None)], "url string, html string")
    found = spark.sql("SELECT p.url, f.* FROM {p} p, LATERAL page_feeds(p.html, p.url) f", p=pages).collect()
    assert [tuple(r) for r in found] == [("http://a.b/x", "http://a.b/f.xml", 0)]
    rows = spark.createDataFrame([("a", k, k * 100_000, "note") for k in range(12)] + [("b", 1, 5, "n")], "key string, pos long, ts_ms long, note string")
    got = spark.sql("SELECT * FROM notification_buckets(TABLE({r}) PARTITION BY key ORDER BY pos)", r=rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, delivery.coalesce_notifications(rows).collect()))
    with pytest.raises(Exception, match="key, pos and ts_ms"):
        spark.sql("SELECT * FROM notification_buckets(TABLE({r}))", r=rows.select(F.col("key"))).collect()


def test_pages_leave_the_reader_in_batches_of_bounded_size(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [{"url": f"https://h{k % 3}.org/{k}" if k else None, "html": f"{k} " + "x" * 60_000} for k in range(400)]
    pq.write_table(pa.Table.from_pylist(rows), f"{tmp_path}/pages.parquet")
    reader = datasource.PagesReader({"path": f"{tmp_path}/pages.parquet", "opener": "table", "connections": "2"})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(batches) > 3 and all(b.num_rows <= datasource.ROWS and b.nbytes < datasource.BYTES + 100_000 for b in batches)
    got = {r["url"]: r["content"] for b in batches for r in b.to_pylist()}
    assert got == {r["url"]: r["html"].encode() if r["url"] else None for r in rows}

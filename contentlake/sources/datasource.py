"""Data sources of Spark's Python API: ``pages`` fetches addresses by host, ``change_log`` reads a log from a cursor.

``pages``: options ``path`` (Parquet files with ``url``, and ``etag``, ``modified`` where known), ``connections`` (16: partitions, each of
which fetches one address after the other, and so the bound on open connections; all addresses of a host are in one partition, so that a
host sees one at a time), ``most`` (bytes of a body) and ``opener``: ``http``, or ``table``, which replays the column ``html``
of the files (each connection reads that column once). A row for each address; what a host does wrong is a row with an error. A null address is one, too.

``change_log``: options ``path`` (a folder of Parquet files with ``seq`` and the columns of the given schema) or ``url`` (a service that
answers ``?since=<seq>&limit=<n>`` with a JSON list of ops in order of seq, and ``/head`` with the last seq), and ``limit`` (2000: ops of a
page). As a stream its offset is the last seq, so a checkpoint is a cursor; a batch's pages are read side by side. Ops that are appended
with a seq below the offset are never read: a log's seq only grows. As a batch it reads all after ``since`` (0).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FETCHED = "url string, host string, status string, http int, content binary, etag string, modified string, error string"
ROW = pa.schema([(n, {"int": pa.int32(), "binary": pa.binary()}.get(kind, pa.string())) for n, kind in (c.split() for c in FETCHED.split(", "))])
#: Rows and bytes of bodies of a batch that leaves the reader of pages.
ROWS, BYTES = 256, 8 << 20
OP = "seq long, device_id string, lamport long, entity_id long, field string, val double, ts_ms long"


def local(path: str) -> str:
    return path.removeprefix("file://")


class Part(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROW, strict=True)], schema=ROW)


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.opener = local(options["path"]), options.get("opener", "http")
        self.connections, self.most, self.wait = int(options.get("connections", 16)), int(options.get("most", 8 << 20)), float(options.get("timeout", 30))

    def partitions(self) -> list[Part]:
        return [Part(k, self.connections) for k in range(self.connections)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """Batches end with a row that takes them over some bytes, and files are read a few rows at a time, whatever a row group holds."""
        found, size = [], 0
        for row in self._rows():
            url = row["url"]
            host = (urlsplit(url).hostname or "") if url else ""
            if zlib.crc32(host.encode()) % partition.last == partition.first:
                found.append((url, host, *self._fetched(row)))
                size += len(found[-1][4] or b"")
                if len(found) == ROWS or size > BYTES:
                    yield _batch(found)
                    found, size = [], 0
        if found:
            yield _batch(found)

    def _rows(self) -> Iterator[dict]:
        files = ds.dataset(self.path)
        columns = [c for c in ("url", "etag", "modified", "html") if c in files.schema.names and (c != "html" or self.opener == "table")]
        for piece in files.get_fragments():
            with files.filesystem.open_input_file(piece.path) as held:
                for batch in pq.ParquetFile(held, pre_buffer=False, buffer_size=1 << 20).iter_batches(batch_size=ROWS // 4, columns=columns):
                    yield from batch.to_pylist()

    def _fetched(self, row: dict) -> tuple:
        if not row["url"]:
            return "error", 0, None, "", "", "no address"
        if self.opener == "table":
            return self._body(200, (row["html"] or "").encode(), "", "")
        asked = {"If-None-Match": row.get("etag"), "If-Modified-Since": row.get("modified")}
        try:
            with urlopen(Request(row["url"], headers={k: v for k, v in asked.items() if v}), timeout=self.wait) as got:
                return self._body(got.status, got.read(self.most + 1), got.headers.get("ETag", ""), got.headers.get("Last-Modified", ""))
        except HTTPError as e:
            tags = (e.headers.get("ETag") or "", e.headers.get("Last-Modified") or "")
            return ("not_modified", 304, None, *tags, "") if e.code == 304 else ("error", e.code, None, *tags, f"HTTP {e.code}")
        except Exception as e:  # whatever a host does, the other addresses go on
            return "error", 0, None, "", "", f"{type(e).__name__}: {e}"[:500]

    def _body(self, code: int, body: bytes, etag: str, modified: str) -> tuple:
        if len(body) > self.most:
            return "error", code, None, etag, modified, f"larger than {self.most} bytes"
        return "ok", code, body, etag, modified, ""


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagesReader(dict(self.options))


class Log:
    """What readers of a log need of it: the last seq, and a page of ops."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.url, self.limit = local(options.get("path", "")), options.get("url", "").rstrip("/"), int(options.get("limit", 2000))
        self.names = [f.name for f in schema.fields]

    def last(self) -> int:
        if self.url:
            with urlopen(f"{self.url}/head", timeout=30) as got:
                return int(json.load(got))
        try:
            files = ds.dataset(self.path, format="parquet")
        except FileNotFoundError:
            return 0
        found = 0
        for piece in files.get_fragments():  # footers alone: each row group states its largest seq
            meta = piece.metadata
            at = meta.schema.names.index("seq")
            for k in range(meta.num_row_groups):
                if meta.row_group(k).num_rows:
                    found = max(found, meta.row_group(k).column(at).statistics.max)
        return found

    def pages(self, since: int, last: int) -> list[Part]:
        return [Part(k, min(k + self.limit, last)) for k in range(since, last, self.limit)]

    def ops(self, part: Part) -> Iterator[pa.RecordBatch] | Iterator[tuple]:
        if self.url:
            since = part.first
            while since < part.last:
                with urlopen(f"{self.url}?since={since}&limit={self.limit}", timeout=30) as got:
                    found = [op for op in json.load(got) if op["seq"] <= part.last]
                yield from (tuple(op.get(n) for n in self.names) for op in found)
                since = found[-1]["seq"] if len(found) == self.limit else part.last
            return
        seq = ds.field("seq")
        yield from ds.dataset(self.path, format="parquet").to_batches(columns=self.names, filter=(seq > part.first) & (seq <= part.last))


class LogReader(DataSourceReader):
    def __init__(self, log: Log, since: int):
        self.log, self.since = log, since

    def partitions(self) -> list[Part]:
        return self.log.pages(self.since, self.log.last()) or [Part(0, 0)]

    def read(self, partition: Part):
        if partition.last > partition.first:
            yield from self.log.ops(partition)


class LogStream(DataSourceStreamReader):
    def __init__(self, log: Log, since: int):
        self.log, self.since = log, since

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"seq": max(self.log.last(), self.since)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.log.pages(start["seq"], end["seq"]) or [Part(0, 0)]

    def read(self, partition: Part):
        if partition.last > partition.first:
            yield from self.log.ops(partition)


class ChangeLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return OP

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(Log(dict(self.options), schema), int(self.options.get("since", 0)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LogStream(Log(dict(self.options), schema), int(self.options.get("since", 0)))


def register(spark: SparkSession) -> None:
    """Both sources for ``spark.read.format(...)`` and ``spark.readStream.format(...)``."""
    spark.dataSource.register(Pages)
    spark.dataSource.register(ChangeLog)

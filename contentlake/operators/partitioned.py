"""An archive laid out in partitions, of which a batch touches only those that it changes.

Three tables lie below one folder. ``entries`` has the rows, by span of days of publication and bucket of feed; a span has as many days
as give its partitions some thousand rows each, so that files grow in number with the rows and not with the days. ``keys`` has one
small row for each entry (feed_id, guid_hash, entry_id, content_hash, day, bucket), by slot, a hash of feed and guid.
``filters`` has a Bloom filter of each slot's keys, in segments of 32,768 bits that Spark's bitmap aggregate builds.

A batch first asks the filters: a key that isn't in its slot's filter is certainly new and never meets the archive. Of the
other keys, slots that hold none aren't read; an exact join with the slots that may tells false alarms from known
entries. Then the partitions of new entries, of changed ones and of where those lay before are written anew, from a copy beside the
archive, and replaced in one commit each; all others stay as they are. A batch that is applied again, whole or after a failure at any
point, leaves the same rows.

Cases: rows with a null feed, guid or time are entries like others (null equals null); of rows of one key in a batch the one of
the least entry_id counts; a batch without rows writes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contentlake.shared import saved

DAY_MS = 86_400_000
#: Buckets of feeds, slots of keys, bits that a key sets in its filter, bits of a segment, keys of a segment.
BUCKETS, SLOTS, BITS, SEGMENT, PER_SEGMENT = 8, 16, 4, 32_768, 3_000
#: Rows of a partition on average, at least; a span has a power of two of days, up to this one.
PER_PARTITION, LONGEST = 10_000, 15
KEY = ("feed_id", "guid_hash")


@dataclass(frozen=True)
class PartitionedArchive:
    spark: SparkSession
    path: str
    entries_schema: str
    segments: int
    span_days: int

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def stored(self) -> DataFrame:
        """The entries with the span that they lie in."""
        return self._table("entries", f"{self.entries_schema}, day long, span long, bucket int")

    @property
    def entries(self) -> DataFrame:
        return self.stored.drop("span")

    def span(self, day: str) -> Column:
        return F.floor(F.col(day) / self.span_days).cast("long")

    @property
    def keys(self) -> DataFrame:
        return self._table("keys", "feed_id string, guid_hash string, entry_id long, content_hash string, day long, bucket int, slot int")

    @property
    def filters(self) -> DataFrame:
        return self._table("filters", "segment long, bits binary, slot int")


def _placed(rows: DataFrame) -> DataFrame:
    """With day and bucket of the row, and the slot of its key."""
    return rows.withColumns({
        "day": F.coalesce(F.floor(F.col("published_at_ms") / DAY_MS), F.lit(-1)).cast("long"),
        "bucket": F.pmod(F.xxhash64("feed_id"), F.lit(BUCKETS)).cast("int"),
        "slot": F.pmod(F.xxhash64(*KEY), F.lit(SLOTS)).cast("int"),
    })


def _bits(segments: int) -> Column:
    """The places of a key's bits in its slot's filter."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(k), *KEY), F.lit(segments * SEGMENT)) for k in range(BITS)))


def _filter_rows(keys: DataFrame, segments: int) -> DataFrame:
    at = keys.select("slot", F.explode(_bits(segments)).alias("bit"))
    return at.groupBy("slot", F.floor(F.col("bit") / SEGMENT).alias("segment")).agg(F.bitmap_construct_agg(F.col("bit") % SEGMENT).alias("bits")).select("segment", "bits", "slot")


def _replace(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write whole partitions in place of those of the same values; others stay. One file for each."""
    rows = saved(rows, "partitions")  # what is replaced may be what was read
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _span_days(held: DataFrame, most: int) -> int:
    """The shortest span that gives no more than ``most`` partitions, of days and buckets that hold rows; else the longest."""
    spans = held.select("bucket", F.posexplode(F.array(*(F.floor(F.col("day") / (1 << k)) for k in range(LONGEST + 1)))).alias("k", "span"))
    parts = {r["k"]: r["n"] for r in spans.distinct().groupBy("k").agg(F.count("*").alias("n")).collect()}  # a number per length
    return 1 << next((k for k in sorted(parts) if parts[k] <= most), LONGEST)


def create(rows: DataFrame, path: str, per_partition: int = PER_PARTITION) -> PartitionedArchive:
    """A new archive of entries with at least entry_id, feed_id, guid_hash, content_hash and published_at_ms."""
    placed = saved(_placed(rows), "placed")
    held = saved(placed.groupBy("day", "bucket").agg(F.count("*").alias("n")), "days")
    total = held.agg(F.sum("n")).first()[0] or 0
    segments = max(1, -(-total // (SLOTS * PER_SEGMENT)))
    archive = PartitionedArchive(rows.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), segments, _span_days(held, total // per_partition))
    placed.drop("slot").withColumn("span", archive.span("day")).repartition("span", "bucket").write.partitionBy("span", "bucket").parquet(f"{path}/entries")
    placed.select(*KEY, "entry_id", "content_hash", "day", "bucket", "slot").repartition("slot").write.partitionBy("slot").parquet(f"{path}/keys")
    _filter_rows(archive.keys, segments).repartition("slot").write.partitionBy("slot").parquet(f"{path}/filters")
    return archive


def _is_set(bits: Column, bit: Column) -> Column:
    """The bit of a segment; the lowest of a byte comes first."""
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (bit % 8).cast("int") + 1)) != 0, F.lit(False))


def maybe_known(archive: PartitionedArchive, batch: DataFrame) -> DataFrame:
    """Rows of a placed batch, with ``maybe``: whether the filters let their key be in the archive. Filters are small: a
    segment of 4 KB for some thousand keys; each bit meets the one segment that it lies in."""
    rows = batch.withColumn("_row", F.monotonically_increasing_id())
    rows = saved(rows, "batch")
    asked = rows.select("_row", "slot", F.explode(_bits(archive.segments)).alias("bit")).withColumn("segment", F.floor(F.col("bit") / SEGMENT))
    asked = asked.join(archive.filters, ["slot", "segment"], "left")
    found = asked.groupBy("_row").agg(F.every(_is_set(F.col("bits"), F.col("bit") % SEGMENT)).alias("maybe"))
    return rows.join(found, "_row").drop("_row")


def classify(archive: PartitionedArchive, batch: DataFrame) -> DataFrame:
    """The batch with ``action`` (insert, update, skip), ``existing_id`` and where the known entry lies (old_day, old_bucket)."""
    first = Window.partitionBy(*KEY).orderBy("entry_id")
    one = batch.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    rows = saved(maybe_known(archive, _placed(one)), "maybe")
    slots = [r["slot"] for r in rows.filter("maybe").select("slot").distinct().collect()]  # SLOTS at most
    known = archive.keys.filter(F.col("slot").isin(slots)).select("slot", F.col("feed_id").alias("_feed"), F.col("guid_hash").alias("_guid"), F.col("entry_id").alias("existing_id"), F.col("content_hash").alias("old_hash"), F.col("day").alias("old_day"), F.col("bucket").alias("old_bucket"))
    new = rows.filter("NOT maybe").drop("maybe")
    same = (F.col("b.slot") == F.col("k.slot")) & F.col("b.feed_id").eqNullSafe(F.col("k._feed")) & F.col("b.guid_hash").eqNullSafe(F.col("k._guid"))
    met = rows.filter("maybe").drop("maybe").alias("b").join(known.alias("k"), same, "left").select("b.*", "existing_id", "old_hash", "old_day", "old_bucket")
    every = met.unionByName(new, allowMissingColumns=True)
    action = F.when(F.col("existing_id").isNull(), "insert").when(~F.col("content_hash").eqNullSafe(F.col("old_hash")), "update").otherwise("skip")
    return every.withColumn("action", action).drop("old_hash")


def apply(archive: PartitionedArchive, batch: DataFrame) -> DataFrame:
    """Merge a batch into the archive; returns it classified. Only partitions with new, changed or moved entries are written."""
    done = saved(classify(archive, batch), "classified")
    changes = done.filter("action <> 'skip'").withColumn("entry_id", F.coalesce("existing_id", "entry_id"))
    touched = changes.select(archive.span("day"), "bucket").union(changes.filter("existing_id IS NOT NULL").select(archive.span("old_day"), "old_bucket")).distinct()
    places = [(r[0], r[1]) for r in touched.collect()]  # at most the archive's partitions and the batch's spans
    if not places:
        return done
    columns = archive.stored.columns
    by_bucket = [(F.col("bucket") == b) & F.col("span").isin([d for d, x in places if x == b]) for b in sorted({x for _, x in places})]
    here = by_bucket[0]
    for more in by_bucket[1:]:
        here = here | more
    kept = archive.stored.filter(here).join(changes.select("entry_id"), "entry_id", "left_anti").select(*columns)
    # a partition that a change has emptied leaves nothing to replace it by: its old rows go as they come back elsewhere
    after = saved(kept.unionByName(changes.withColumn("span", archive.span("day")).select(*columns)), "after")
    left = {(r[0], r[1]) for r in after.select("span", "bucket").distinct().collect()}
    _replace(after, f"{archive.path}/entries", ["span", "bucket"])
    for span, bucket in set(places) - left:
        jvm = archive.spark.sparkContext._jvm
        gone = jvm.org.apache.hadoop.fs.Path(f"{archive.path}/entries/span={span}/bucket={bucket}")
        gone.getFileSystem(archive.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    slots = [r["slot"] for r in changes.select("slot").distinct().collect()]
    keys = changes.select(*KEY, "entry_id", "content_hash", "day", "bucket", "slot")
    old = archive.keys.filter(F.col("slot").isin(slots)).join(keys.select("entry_id"), "entry_id", "left_anti").select(*keys.columns)
    _replace(old.unionByName(keys), f"{archive.path}/keys", ["slot"])
    fresh = [r["slot"] for r in done.filter("action = 'insert'").select("slot").distinct().collect()]
    if fresh:
        _replace(_filter_rows(archive.keys.filter(F.col("slot").isin(fresh)), archive.segments), f"{archive.path}/filters", ["slot"])
    return done

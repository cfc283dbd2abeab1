"""Shared helpers: fold predicates, shared scratch tables, bounded training samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word pattern ``[^\x20\x09-\x0D]+`` sees it; ``bytes.split()`` splits on the same set.
WHITE = b" \t\n\x0b\x0c\r"
#: Tables of a few numbers a row are sent to all tasks up to so many rows; larger ones are joined in salted shuffles.
BROADCAST_ROWS, SALTS = 2_000_000, 32


def dealt(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs in ``where`` with the places where it does, in order."""
    order = np.argsort(where, kind="stable")
    edge = np.flatnonzero(np.diff(where[order], prepend=-1, append=-1))
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        yield int(where[order[i]]), order[i:j]


def spread_join(rows: DataFrame, unique: DataFrame, key: str | list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join on a key that ``rows`` may hold very often and ``unique`` holds once: no task gets all rows of a key."""
    if unique.count() <= most:
        return rows.join(F.broadcast(unique), key, how)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).alias("_salt")
    salted = unique.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    keys = [key] if isinstance(key, str) else key
    return rows.select("*", salt).join(salted, [*keys, "_salt"], how).drop("_salt")


def frequent_join(rows: DataFrame, other: DataFrame, key: str, most: int = 20_000, counted: DataFrame | None = None) -> DataFrame:
    """Join on a key that some rows may have very often: each such key's rows are dealt into parts of about ``most``, and what
    ``other`` (wide rows, say) has for it goes to each part. Keys that more than ``most`` rows have are few: a ``most``-th of the rows.
    A caller that has each key's number of ``_rows`` passes it as ``counted``."""
    counted = rows.groupBy(key).agg(F.count("*").alias("_rows")) if counted is None else counted
    often = counted.select(key, F.ceil(F.col("_rows") / most).cast("int").alias("_parts")).filter("_parts > 1")
    found = often.count()
    if not 0 < found <= BROADCAST_ROWS:
        return rows.join(other, key)
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))).cast("int")
    dealt_rows = rows.join(F.broadcast(often), key, "left").withColumn("_part", part).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    spread = other.join(F.broadcast(often), key, "left").withColumn("_part", copies).drop("_parts")
    return dealt_rows.join(spread, [key, "_part"]).drop("_part")


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(mod))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


class Scratch:
    """Intermediate tables in the folder that every executor can read.

    The folder is ``spark.checkpoint.dir``; only where that is unset on a single machine (tests) a temporary
    folder is made. On a cluster an unset folder is an error: no other place is known to be shared. A saved table cuts the lineage, so that a lost executor costs no more than the
    stage that was running.
    """

    _local: str = ""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or Scratch._local
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = Scratch._local = f"file://{tempfile.mkdtemp(prefix='contentlake-')}"
        self.base = f"{base.rstrip('/')}/contentlake-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self, *kept: DataFrame) -> None:
        """Delete all that lies in the folder but the given tables, which a result still reads."""
        jvm, stays = self.spark.sparkContext._jvm, {t._scratch_path.rsplit("/", 1)[1] for t in kept}
        base = jvm.org.apache.hadoop.fs.Path(self.base)
        files = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.listStatus(base):
            if found.getPath().getName() not in stays:
                files.delete(found.getPath(), True)


#: Characters of the longest text that a classifier's sample takes in: with the bound on rows it bounds what the driver holds.
LONGEST = 60_000


def labelled_sample(docs: DataFrame, labelled: DataFrame, label: str, bound: int, salt: str, longest: int = LONGEST, halves: bool = False) -> list[tuple[str, object]]:
    """At most ``bound`` labelled ids in the order of a salted hash, each with one text of at most ``longest`` characters.

    Only ids pass through the top-k; the texts are then fetched with a broadcast of those ids, whose number is
    bounded. Rows with a null id, label or text are left out; of several labels of one id the largest counts, of
    several texts the smallest. Rows are sorted, so that the same data give the same model. With ``halves`` ids with a label
above 0 come first, up to half of the bound, so that a rare label isn't rare in the sample.
    """
    ids = labelled.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    first = lambda some, n: some.orderBy(F.xxhash64(F.concat(F.lit(salt), F.col("doc_id").cast("string"))), "doc_id").limit(n).collect()
    if halves:
        found = first(ids.filter("y > 0"), bound // 2)
        found += first(ids.filter("y <= 0"), bound - len(found))
    else:
        found = first(ids, bound)
    chosen = docs.sparkSession.createDataFrame(found, ids.schema)
    rows = docs.select("doc_id", "text").filter(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts can be long: hand Python fewer rows at a time, whatever the session's default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

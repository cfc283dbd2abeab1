"""Structured Streaming forms of replication, deduplication and watching, and the refresh loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contentlake.operators.sync import KEY, clock, compacted, slowest_cursor
from contentlake.sinks.exports import swap_in

DAY_MS = 86_400_000


def read_log(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A log's files as a stream; its checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def share_of_files(spark: SparkSession, path: str, batches: int) -> int:
    """How many files of a log a batch takes, so that all of them make no more than so many batches, however many there are."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return max(1, -(-sum(f.getPath().getName().endswith(".parquet") for f in files) // batches))


def stream_winners(ops: DataFrame) -> DataFrame:
    """Last writer per key, as a running aggregate (update or complete mode)."""
    return ops.groupBy(*KEY).agg(F.max(clock("val")).alias("w")).select(*KEY, F.col("w.val").alias("val"), "w.lamport", "w.device_id")


def stream_first(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows of a key that came first; state of a key goes once the watermark has passed it."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_changes(visits: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Visits that saw another value than the one before of their key; the state is one value per key.

    Batches are to follow each other in ``order``; a batch's visits of one key are sorted together.
    """
    schema = f"{key} long, {order} long, {value} string"

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = [r for f in frames for r in zip(f[order].tolist(), f[value].tolist(), strict=True)]  # one batch's rows of one key
        rows.sort(key=itemgetter(0))
        out = []
        for at, now in rows:
            if now != last:
                out.append((group[0], at, now))
                last = now
        state.update((last,))
        if out:
            yield pd.DataFrame(out, columns=[key, order, value])

    return visits.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(rows: DataFrame, time: str, delay: str, width: str, by: str) -> DataFrame:
    """Counts per window of time; late rows are let in for ``delay``."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, through the stream into files beside the checkpoint, and read from those.

    Only new rows are written in append mode; in complete mode every batch writes the whole result to a folder of its
    own, so that a repeated batch replaces itself, and the last one counts.
    """
    spark, out = df.sparkSession, f"{checkpoint.rstrip('/')}-{name}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def whole(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    writer.foreachBatch(whole).start().awaitTermination()
    # the last batch may be one of an earlier run, where a restart found nothing new
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(x.getPath().getName()) for x in files.listStatus(folder)] if files.exists(folder) else []
    return spark.read.schema(df.schema).parquet(f"{out}/{max(done)}") if done else spark.createDataFrame([], df.schema)


def apply_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a function on every micro-batch; a batch's number lets it tell a repetition after a failure."""
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_runs(tasks: DataFrame, now_ms: int) -> DataFrame:
    """(task, due_ms) of the tasks (task, every_ms, at_ms, last_ms, running) that are to run now, once however often they were missed.

    A task runs ``every_ms``, or, where that is null, daily at ``at_ms`` after midnight (UTC); never while it is running.
    """
    last = F.coalesce("last_ms", F.lit(0))
    today = F.lit(now_ms - now_ms % DAY_MS) + F.col("at_ms")
    daily = F.when(today <= now_ms, today).otherwise(today - DAY_MS)
    due = F.when(F.col("every_ms").isNotNull(), last + F.col("every_ms")).otherwise(F.when(daily > last, daily))
    return tasks.withColumn("due_ms", due).filter((F.col("due_ms") <= now_ms) & ~F.coalesce("running", F.lit(False))).select("task", "due_ms")


def compact_log(spark: SparkSession, path: str, clients: DataFrame, schema, now_ms: int, before_ms: int | None = None) -> None:
    """The stored log without what no client needs any more; readers see the old log or the new one."""
    log = spark.read.schema(schema).parquet(path)
    keep = slowest_cursor(clients, log, now_ms).first()[0]
    swap_in(compacted(log, keep or 0, before_ms), path)

"""Ranked search on a stored index: postings in blocks of entries, with the largest weight of each term in each block.

An index is two tables below one folder. ``lengths`` (entry_id, length, block) has a row for each entry, ``postings``
(shelf, term, block, entries, most, held) one for each term of each block: its entries, each with what BM25 makes of the term's
count before the term's weight, the largest such part, and their number. ``blocks`` is ``postings`` without the entries, which aren't
read for it, and ``terms`` (shelf, term, df) the sums of those numbers. Entries of like length share blocks, so that the largest
part is close to the others.

Building moves the entries' tokens once, block by block, and counts a block's tokens as numbers in Arrow batches. All that its
rows say is made where it lies, so no word, however frequent, gathers in one task, and no single token is a row of a shuffle.

A query first reads ``blocks``: a block's bound is the sum of its terms' largest parts, weighted. The k blocks
of the highest bounds give a k-th score, and only blocks whose bound reaches that score are read.
No text is read, and no block's number passes through the driver: only the k-th score does.

Nulls: a null title or text is empty; entries without a token have a length of 0 and count in the mean. An empty archive
gives an index that finds nothing. Equal scores are ordered by entry_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.functions.text import bound_once
from contentlake.operators.search import B, K1, LEAST_IDF, SHELVES, shelf, tokens, words_of
from contentlake.shared import saved

#: Entries of a block, and its tokens at most, about.
PER_BLOCK, PER_BLOCK_TOKENS = 512, 1_000_000
#: Tokens of a task that builds postings, about; the most such tasks, as each writes a file for each shelf.
PER_TASK, TASKS = 2_000_000, 128
TABLES = {
    "lengths": "entry_id {id}, length int, block long",
    "postings": "term string, block long, entries array<struct<entry_id:{id},part:double>>, most double, held long, shelf int",
}


@dataclass(frozen=True)
class RankedIndex:
    lengths: DataFrame
    postings: DataFrame

    @property
    def blocks(self) -> DataFrame:
        """(shelf, term, block, most, held)."""
        return self.postings.drop("entries")

    @property
    def terms(self) -> DataFrame:
        """(shelf, term, df)."""
        return self.blocks.groupBy("shelf", "term").agg(F.sum("held").alias("df"))


def tokenised(archive) -> DataFrame:
    """(entry_id, t, length): the tokens of title and body, and how many they are; folded once, then kept."""
    both = F.concat(*(tokens(F.coalesce(c, F.lit(""))) for c in ("title", "body_text")))
    return saved(archive.entries.select("entry_id", bound_once(both, lambda t: F.struct(t.alias("t"), F.size(t).alias("length"))).alias("x")).select("entry_id", "x.t", "x.length"), "tokens")


def _band(length: Column) -> Column:
    return F.floor(2 * F.log2(length + 1)).cast("long")


@contextmanager
def _few_rows(spark: SparkSession, rows: int = 200) -> Iterator[None]:
    """Token lists can be long: what runs within hands Python few of them at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _block_lists(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """Rows (block, entry_id, length, t) that lie together by block, to a row (term, block, entries, most, held) for each term of each block."""
    block, pieces = None, []
    for batch in batches:
        at = batch["block"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for i, j in zip(edges, edges[1:], strict=False):
            if i < j:
                if pieces and at[i] != block:
                    yield from _lists(block, pieces, mean)
                    pieces = []
                block = at[i]
                pieces.append(batch.slice(i, j - i))
    if pieces:
        yield from _lists(block, pieces, mean)


def _lists(block: int, pieces: list[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """One block's rows; its tokens are numbered, and equal pairs of number and entry counted."""
    rows = pa.Table.from_batches(pieces).combine_chunks()
    n, length, ids = len(rows), rows["length"].to_numpy(), rows["entry_id"].combine_chunks()
    tokens = pa.concat_arrays([c.flatten() for c in rows["t"].chunks]).dictionary_encode()
    if not len(tokens):
        return
    pair, tf = np.unique(tokens.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), length), return_counts=True)
    word, row = pair // n, pair % n
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    entries = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(part)], ["entry_id", "part"])
    columns = [
        tokens.dictionary.take(pa.array(word[first])),
        pa.array(np.full(len(first), block, np.int64)),
        pa.ListArray.from_arrays(pa.array(np.append(first, len(pair)), pa.int32()), entries),
        pa.array(np.maximum.reduceat(part, first)),
        pa.array(np.diff(np.append(first, len(pair)))),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["term", "block", "entries", "most", "held"])


def write_ranked(archive, path: str, per_block: int = PER_BLOCK, per_task: int = PER_TASK) -> RankedIndex:
    """The index of an archive's entries, written below ``path``."""
    lists = tokenised(archive)
    spark, id_type = lists.sparkSession, lists.schema["entry_id"].dataType.simpleString()
    sized = lists.withColumn("band", _band(F.col("length")))
    # entries of a band of lengths are dealt to as many blocks as the band needs; a row for each band, two for each bit of lengths
    parts = F.ceil(F.greatest(F.count("*") / per_block, F.sum("length") / PER_BLOCK_TOKENS))
    bands = sized.groupBy("band").agg(parts.alias("parts"), F.count("*").alias("n"), F.sum("length").alias("sum"))
    bands = saved(bands.coalesce(1), "bands")
    block = (F.col("band") * F.lit(1 << 40) + F.pmod(F.xxhash64("entry_id"), "parts")).alias("block")
    placed = sized.join(F.broadcast(bands.select("band", "parts")), "band").select("entry_id", "length", block, "t")
    placed.drop("t").write.parquet(f"{path}/lengths")
    total = bands.agg(F.coalesce(F.sum("sum"), F.lit(0)).alias("tokens"), F.greatest(F.sum("sum") / F.sum("n"), F.lit(1e-9)).alias("mean")).first()
    tasks = min(TASKS, total["tokens"] // per_task + 1)
    together = placed.repartition(tasks, "block").sortWithinPartitions("block").select("block", "entry_id", "length", "t")
    held = together.mapInArrow(partial(_block_lists, mean=total["mean"]), TABLES["postings"].format(id=id_type).removesuffix(", shelf int"))
    rows = held.withColumn("shelf", shelf(F.col("term")))
    with _few_rows(spark):
        rows.sortWithinPartitions("shelf", "term", "block").write.partitionBy("shelf").parquet(f"{path}/postings")
    return read_ranked(spark, path, id_type)


def _read(spark: SparkSession, path: str, name: str, id_type: str) -> DataFrame:
    return spark.read.schema(TABLES[name].format(id=id_type)).parquet(f"{path}/{name}")


def read_ranked(spark: SparkSession, path: str, id_type: str = "bigint") -> RankedIndex:
    return RankedIndex(*(_read(spark, path, name, id_type) for name in TABLES))


def _of(words: list[str], rows: DataFrame) -> DataFrame:
    """Rows of the query's words, from their shelves alone."""
    words = sorted({w for x in words for w in words_of(x)})
    shelves = F.explode(F.array(*(shelf(F.lit(w)) for w in words)) if words else F.array().cast("array<int>"))
    places = [r["s"] for r in rows.sparkSession.range(1).select(shelves.alias("s")).distinct().collect()]  # a number per word
    return rows.filter(F.col("shelf").isin(places) & F.col("term").isin(words))


def bounds(index: RankedIndex, words: list[str]) -> tuple[DataFrame, DataFrame]:
    """(term, idf) of the words that the index has, and (block, bound) of the blocks that hold any."""
    n = index.lengths.agg(F.count("*").alias("n"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = _of(words, index.terms).crossJoin(F.broadcast(n)).select("term", idf.alias("idf"))  # a row per word, and one
    parts = _of(words, index.blocks).join(F.broadcast(weights), "term")
    return weights, parts.groupBy("block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))


def scored(index: RankedIndex, words: list[str], weights: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(entry_id, rank) of the entries that hold a word, in the given blocks or in all; the lower, the better."""
    hits = _of(words, index.postings)
    if blocks is not None:
        hits = hits.join(blocks.select("block"), "block", "left_semi")
    hits = hits.select("term", F.inline("entries"))
    return hits.join(F.broadcast(weights), "term").groupBy("entry_id").agg((-F.sum(F.col("idf") * F.col("part"))).alias("rank"))


def reaching(index: RankedIndex, words: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The words' weights, and the blocks that can hold one of the ``limit`` best entries."""
    weights, found = bounds(index, words)
    found = saved(found, "bounds")
    # the best entry of each of `limit` blocks is at most this far down
    first = found.orderBy(F.desc("bound"), "block").limit(limit)
    last = scored(index, words, weights, first).orderBy("rank", "entry_id").limit(limit).agg(F.count("*").alias("n"), F.max("rank").alias("rank")).first()
    if last["n"] < limit:
        return weights, found
    return weights, found.filter(F.col("bound") >= -last["rank"] - 1e-9)


def search(index: RankedIndex, words: list[str], limit: int) -> DataFrame:
    """The best entries by rank, ties by id; blocks that can't hold one aren't read."""
    weights, blocks = reaching(index, words, limit)
    return scored(index, words, weights, blocks).orderBy("rank", "entry_id").limit(limit)

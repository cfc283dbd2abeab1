"""Ranked lexical search turned round: documents stream through an index of the items that ask for them.

The index maps each term of the items to the items that hold it and how often. It is made of the items alone, is sent to
all tasks, and has a bound: items with more than ``entries`` (item, term) pairs are dealt into blocks, each with an index and a
pass of its own. One pass cuts every whole text into terms and keeps, packed, how often each term of the index occurs;
from that come the number of documents, their terms, and the documents that hold each term. A second pass streams those
counts through the index: a document's terms add to the scores of the items that hold them, and each item has a heap of its ``k`` best
documents so far. A task hands on its heaps alone, and one top-k per item merges those of all tasks.

A term is a maximal run of letters or digits of ASCII or of any other characters, A-Z lower-cased. All is done in 64-bit
integers but for a term's weight, floor(1000 ln((2N+2) / (2df+1))).

Cases: a null or empty text holds no term, and isn't one of the N documents; an item without a term, or with none that a document
holds, has no rows; equal rows of items count once, rows of one id with different texts are items of their own; rows of documents
with equal or null ids are documents of their own (equal scores: by id, null last); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentlake.llm.common import Scratch, small_batches

#: Results of an item; (item, term) pairs of an index.
BEST, ENTRIES = 20, 1_000_000
#: Bytes to what terms are made of: letters lower-case, all other signs of ASCII blank.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: The order of ids in heaps: what has no id comes last.
LAST = 1 << 63


def terms(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


class Index:
    """Items by term: for term t the items ``item[start[t]:start[t + 1]]`` and how often each holds it."""

    def __init__(self, items: list[str]):
        found: dict[bytes, list[tuple[int, int]]] = {}
        for k, text in enumerate(items):
            for term, times in Counter(terms(text.encode())).items():
                found.setdefault(term, []).append((k, times))
        self.items, self.number = len(items), {t: k for k, t in enumerate(found)}
        self.start = np.cumsum([0, *map(len, found.values())])
        self.item = np.array([k for x in found.values() for k, _ in x], np.int64)
        self.times = np.array([n for x in found.values() for _, n in x], np.int64)


def counted(index: Index):
    """(doc_id, text) to (doc_id, n, terms, counts): the index's terms of a text, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.value.number
        for batch in batches:
            size, which, often = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms(text or b"")
                held = Counter(k for k in map(number.get, words) if k is not None)
                size.append(len(words))
                which.append(np.fromiter(held.keys(), np.int32, len(held)).tobytes())
                often.append(np.fromiter(held.values(), np.int32, len(held)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(which, pa.binary()), pa.array(often, pa.binary())], ["doc_id", "n", "terms", "counts"])

    return run


def holders(size: int):
    """Packed terms to (term, df), added up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held], pa.int64())], ["term", "df"])

    return run


def streamed(index: Index, weight, documents: int, total: int, k: int):
    """Packed counts to (item, doc_id, score): the heaps of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, w = index.value, weight.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in range(x.items)]
        least = np.zeros(x.items, np.int64)  # a score has to reach this, and be above 0
        for batch in batches:
            for doc, n, which, often in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not which:
                    continue
                t, tf = np.frombuffer(which, np.int32), np.frombuffer(often, np.int32).astype(np.int64)
                value = w[t] * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n * documents // total)))
                sizes = x.start[t + 1] - x.start[t]
                at = np.arange(sizes.sum()) + np.repeat(x.start[t] - np.cumsum(sizes) + sizes, sizes)
                scores = np.zeros(x.items, np.int64)
                np.add.at(scores, x.item[at], x.times[at] * np.repeat(value, sizes))
                for i in np.flatnonzero((scores >= least) & (scores > 0)).tolist():
                    own = (int(scores[i]), -(LAST if doc is None else doc))
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], own)
                    else:
                        heapq.heappushpop(heaps[i], own)
                    if len(heaps[i]) == k:
                        least[i] = heaps[i][0][0]
        rows = [(i, None if d == -LAST else -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _block(items: list, docs: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(item_id, doc_id, score) of the best documents of each task, for a block of items."""
    spark = docs.sparkSession
    index = Index([r["text"] for r in items])
    sent = spark.sparkContext.broadcast(index)
    counts = scratch.save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted(sent), "doc_id long, n long, terms binary, counts binary"), "counts")
    of = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
    weight = np.zeros(len(index.number), np.int64)
    for r in counts.select("terms").mapInArrow(holders(len(weight)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per term of the index
        weight[r["term"]] = math.floor(1000 * math.log((2 * of["documents"] + 2) / (2 * r["df"] + 1)))
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item int, item_id long")
    best = counts.mapInArrow(streamed(sent, spark.sparkContext.broadcast(weight), of["documents"], max(1, of["total"] or 0), k), "item int, doc_id long, score long")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("item").alias("own"), "doc_id", "score")  # as many names as the index has items


def ranked(items: DataFrame, docs: DataFrame, k: int = BEST, entries: int = ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    items = items.select(F.col("item_id").cast("long"), "text").filter(F.col("text").isNotNull()).distinct()
    pairs = items.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    blocks = -(-pairs // entries) or 1
    out = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # a block, of bounded size
        found = _block(own, docs, scratch, k).withColumn("block", F.lit(b))
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("block", "own").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

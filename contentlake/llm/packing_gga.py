"""Best-fit packing by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences of their own. All others are
dealt by a hash into shards of bounded size, and each shard is packed by several islands: a population of
packings evolves by a crossover that injects whole well-filled bins of one parent into the other, removes the
bins that hold a document twice and best-fits what they displaced. Between epochs each island sends its best
packing to its neighbour. What lies in a shard's loosely filled bins is packed again together with that of other
shards, until one shard is left, so no shard leaves half-empty sequences behind. A population that has reached
the lower bound (all tokens over the capacity, rounded up) stops.

Shards, islands and migration are rows of DataFrames: more input means more shards, not larger tasks.

Defined cases: null and empty texts are one piece that holds the closing id alone; long texts are cut into full
pieces, the last may be shorter; repeated rows are packed as often as they occur; tables without rows give none;
further columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlake.llm.common import Scratch, small_batches

CAPACITY, CLOSING, SHARD, ISLANDS, EPOCHS, LOOSE = 4096, 1, 8192, 2, 2, 0.985


#: Words of these signs alone fall into runs of letters, single digits and runs of other signs, and no normalisation but
#: that of case concerns them.
PLAIN, PIECE = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: What the tokenizer takes for one token wherever it stands in a text, even within a word.
WHOLE = (b"<|startoftext|>", b"<|endoftext|>")
#: The model's sign of each byte: the byte's own if it can be seen, else one beyond 255, in order.
SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
SIGNS = dict(zip([*SEEN, *(b for b in range(256) if b not in SEEN)], [*SEEN, *range(256, 512 - len(SEEN))], strict=True))


class WordCoder(dict):
    """Token ids of a text by a tokenizer that drops white space: words between ASCII white space are looked up.

    But for the names of its added tokens, no token and no normalisation of this tokenizer crosses ASCII white space,
    so a text's ids are those of its words in turn; nor does it tell A from a. Texts with such a name are encoded as they
    stand. A plain word is encoded by its pieces, for which the model is enough, another one by the whole tokenizer.
    Words seen first stay in memory (here) up to a bound; others are kept for a while.
    """

    def __init__(self, path: str, bound: int = 800_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.coder = Tokenizer.from_file(path)
        self.recent: dict[bytes, bytes] = {}
        self.bound = bound

    def encoded(self, text: str) -> bytes:
        return array("I", self.coder.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.recent.get(word)
        if ids is None:
            text = word.decode().lower()
            if not PLAIN.fullmatch(text):
                ids = self.encoded(word.decode())
            elif len(pieces := PIECE.findall(text)) > 1:
                ids = b"".join([self[p.encode()] for p in pieces])
            else:
                ids = array("I", [t.id for t in self.coder.model.tokenize(text.encode().decode("latin-1").translate(SIGNS))]).tobytes()
            if len(self) < self.bound:
                self[word] = ids
            else:
                if len(self.recent) >= self.bound:
                    self.recent.clear()
                self.recent[word] = ids
        return ids

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for t in texts:
            data = t.encode().lower()
            if WHOLE[0] in data or WHOLE[1] in data:
                yield self.encoded(t)
            else:
                yield b"".join(map(self.__getitem__, data.split()))


@lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, closing = word_coder(path), np.array([CLOSING], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), coder.ids([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                data += closing
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(part) // 4, crc32(part)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by free space; the fullest that still takes a size is found in a bit mask."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_free = capacity, 0, [[] for _ in range(capacity + 1)]

    def put(self, number: int, free: int) -> None:
        self.by_free[free].append(number)
        self.mask |= 1 << free

    def take(self, size: int) -> tuple[int, int] | None:
        above = self.mask >> size
        if not above:
            return None
        free = size + (above & -above).bit_length() - 1
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        return number, free


def best_fit(sizes: np.ndarray, order: np.ndarray, genome: np.ndarray, fills: list[int], capacity: int) -> None:
    """Put the items of ``order`` into the fullest bins that take them, in that order; changes genome and fills."""
    bins = Bins(capacity)
    for number, fill in enumerate(fills):
        if fill < capacity:
            bins.put(number, capacity - fill)
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        found = bins.take(size)
        number, free = found if found else (len(fills), capacity)
        if not found:
            fills.append(0)
        genome[item] = number
        fills[number] += size
        if free > size:
            bins.put(number, free - size)


def fills_of(sizes: np.ndarray, genome: np.ndarray) -> np.ndarray:
    return np.bincount(genome, sizes).astype(np.int64)


def fitness(sizes: np.ndarray, genome: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; of as many, the fuller the full ones."""
    fills = fills_of(sizes, genome)
    return -len(fills), float(((fills / capacity) ** 2).sum())


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, r: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of b enter a; bins of a that share a document with them go; the rest is best-fitted."""
    fills = fills_of(sizes, b)
    chosen = (r.random(len(fills)) < r.random() * 0.3) & (fills >= np.quantile(fills, 0.25))
    entering = chosen[b]
    gone = np.zeros(a.max() + 1, bool)
    gone[a[entering]] = True
    gone[np.argsort(fills_of(sizes, a), kind="stable")[: r.integers(1, 13)]] = True  # a mutation: the emptiest bins are dissolved
    staying = ~gone[a] & ~entering
    child = np.full(len(a), -1, np.int64)
    _, child[staying] = np.unique(a[staying], return_inverse=True)
    kept = child.max() + 1 if staying.any() else 0
    if entering.any():
        child[entering] = kept + np.unique(b[entering], return_inverse=True)[1]
    placed = child >= 0
    new = np.bincount(child[placed], sizes[placed]).astype(int).tolist() if placed.any() else []
    free = np.flatnonzero(~placed)
    best_fit(sizes, free[np.argsort(-sizes[free], kind="stable")], child, new, capacity)
    return child


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, members: int, seed: int) -> list[np.ndarray]:
    """The best ``members`` packings after so many generations, best first."""
    r = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // capacity)
    while len(population) < members:
        noise = 1 + (0.0 if seed % ISLANDS == 0 and not population else 0.2) * r.random(len(sizes))
        genome, fills = np.zeros(len(sizes), np.int64), []
        best_fit(sizes, np.argsort(-sizes * noise, kind="stable"), genome, fills, capacity)
        population.append(genome)
        if len(fills) == bound:
            break
    rank = lambda g: fitness(sizes, g, capacity)
    population = sorted(population, key=rank, reverse=True)
    for _ in range(generations):
        if population[0].max() + 1 <= bound or len(population) < 2:
            break
        one, two = r.choice(len(population), 2, replace=False)
        population = sorted([*population, crossover(sizes, population[one], population[two], capacity, r), crossover(sizes, population[two], population[one], capacity, r)], key=rank, reverse=True)[:members]
    return population


def offsets(sizes: np.ndarray, genome: np.ndarray) -> np.ndarray:
    """Place of each item in its bin, gapless from 0."""
    order = np.argsort(genome, kind="stable")
    end = np.cumsum(sizes[order])
    start = end - sizes[order]
    first = np.flatnonzero(np.diff(genome[order], prepend=-1))
    out = np.empty(len(sizes), np.int64)
    out[order] = start - np.repeat(start[first], np.diff(np.append(first, len(order))))
    return out


def pack_shards(items: DataFrame, scratch: Scratch, shards: int, capacity: int, generations: int, members: int, level: int) -> DataFrame:
    """uid, length, bin (unique in the level), fill and offset for items with uid and length."""
    shard = F.pmod(F.xxhash64(F.lit(level), "uid"), F.lit(shards)).cast("int").alias("shard")
    rows = items.select(shard, F.struct("uid", "length").alias("item")).groupBy("shard").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.uid").alias("uids"), F.col("items.length").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("population"), F.lit(None).cast("array<int>").alias("guest"))

    def epoch(number: int):
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                grown = []
                for row in batch.itertuples(index=False):
                    sizes = np.asarray(row.sizes, np.int64)
                    start = [] if row.population is None else [np.asarray(g, np.int64) for g in row.population]
                    start += [] if row.guest is None else [np.asarray(row.guest, np.int64)]
                    grown.append([g.tolist() for g in evolve(sizes, start, capacity, generations, members, ISLANDS * (row.shard * EPOCHS + number) + row.island)])
                yield batch.assign(population=grown, guest=None)

        return step

    schema = rows.schema
    for number in range(EPOCHS):
        rows = rows.repartition(F.col("shard"), F.col("island")).mapInPandas(epoch(number), schema)
        rows = scratch.save(rows, f"islands-{level}-{number}")
        if number < EPOCHS - 1:
            elite = rows.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("elite"))
            rows = rows.drop("guest").join(elite, ["shard", "island"]).withColumnRenamed("elite", "guest").select(*schema.names)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sizes, genome = np.asarray(row.sizes, np.int64), np.asarray(row.genome, np.int64)
                yield pd.DataFrame({"uid": row.uids, "length": sizes, "bin": row.shard * (1 << 24) + genome, "fill": fills_of(sizes, genome)[genome], "offset": offsets(sizes, genome)})

    genome = F.col("population")[0]
    fewest = F.struct(F.array_max(genome), F.col("island"))  # fewest bins, then the first island
    best = rows.groupBy("shard").agg(F.min_by(F.struct("uids", "sizes", genome.alias("genome")), fewest).alias("best"))
    return best.select("shard", "best.*").mapInPandas(finish, "uid long, length long, bin long, fill long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, shard: int = SHARD, generations: int = 60, members: int = 8) -> DataFrame:
    """Every piece of every document with the sequence that holds it and its place there."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.save(pieces(docs, path, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = cut.filter(F.col("length") == capacity).select("uid", F.lit(0).cast("long").alias("offset"), F.col("uid").alias("sequence_id"))
    items, done, kept, level = cut.filter(F.col("length") < capacity).select("uid", "length"), [full], [cut], 0
    while True:
        count = items.count()
        shards = max(1, -(-count // shard))
        level += 1
        packed = scratch.save(pack_shards(items, scratch, shards, capacity, generations, members, level), f"packed-{level}")
        kept.append(packed)
        loose = F.col("fill") < F.lit(LOOSE) * capacity
        left = packed.filter(loose).count() if shards > 1 else 0
        again = 0 < 2 * left <= count  # else these sizes fill no better, however they are dealt
        done.append((packed.filter(~loose) if again else packed).select("uid", "offset", (-F.col("bin") * 64 - level).alias("sequence_id")))
        if not again:
            break
        items = packed.filter(loose).select("uid", "length")
    scratch.clear(*kept)
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return cut.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""LM scoring by Katz back-off over word pairs.

Model. Tokens are a text's words and one end. All words of the training rows are told apart, however many; one
unseen word more stands for all others. Pair counts are discounted by Good and Turing up to count ``DISCOUNTED``; a
context keeps one count in reserve. What the seen successors of a context leave over goes to all others in proportion
to their unigram probability, with a weight that makes each context's probabilities add up to exactly 1. (A context
that every word has followed has nothing to back off to; its reserve stays unused.)

Work. One pass counts words. A second cuts the rows into chunks of about ``FLUSH`` tokens, kept as rows of a bucketed
table. A chunk sends each of its different pairs once, with how often its training rows have it, to a bucket of bounded
size: by the pair's context and, for contexts larger than a share of a bucket, by its successor. A bucket adds up, returns its
part of the context table, and to each chunk the counts of what it sent, in that order. Once discounts and back-off weights
are known, each chunk meets its counts and scores its rows. What travels grows with the chunks' different pairs alone, however
many buckets there are, and a pair or text that occurs everywhere comes once a chunk.

Only the ``NUMBERED`` most frequent words have numbers. A pair with another word travels as two 64-bit keys: dealt by
its second word if that has no number (whose count is then the bucket's own sum), else by its first. What follows a
word without a number is gathered by that word once more, where chunks ask for its back-off weight.

Driver and broadcasts hold counts and weights of the numbered words only. All counts are exact (of 64-bit hashes of
words).

Defined cases: null and empty texts are the end alone; texts of any length are read whole; repeated rows count
as often as they occur and are each scored; without training rows every score is 0; tables without rows give
none; further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.llm.common import Scratch, small_batches

NUMBERED, DISCOUNTED, BUCKET, FLUSH, SAMPLED, WIDTH = 1 << 18, 5, 2_000_000, 1_000_000, 128, 5
END = b"\n"  # no word holds one

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) ^ (x.astype(np.uint64) >> np.uint64(32))) * _M1
    return x ^ (x >> np.uint64(29))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


START = signed(xxhash.xxh3_64_intdigest(b" "))  # before a text; no word is a space


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def count_words(texts: DataFrame) -> DataFrame:
    """(h, c): every word's hash and count."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            hashes = [signed(xxhash.xxh3_64_intdigest(w)) for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(list(counts.values()), pa.int64())], ["h", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in tokens_of(text):
                    counts[w] = counts.get(w, 0) + 1
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return texts.mapInArrow(tally, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Words:
    """The frequent words: their hashes in order, and their counts. Numbers: a frequent word's place; ``rare`` for any
    other; ``start`` as the context of a first token."""

    def __init__(self, table: DataFrame, bound: int):
        level = F.least("c", F.lit(65_536)).alias("level")
        steps = table.groupBy(level).agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).orderBy(F.desc("level")).collect()
        self.tokens, self.types = sum(s["tokens"] for s in steps), sum(s["words"] for s in steps)
        least, held = 65_537, 0
        for s in steps:
            if held + s["words"] > bound:
                break
            held, least = held + s["words"], s["level"]
        frequent = table.filter(F.col("c") >= least).toArrow()  # at most ``bound`` words
        h, c = frequent["h"].to_numpy(), frequent["c"].to_numpy()
        order = np.argsort(h)
        self.hashes, self.counts = h[order], c[order]
        self.rare, self.start = len(h), len(h) + 1
        self.rare_tokens = self.tokens - int(c.sum())

    def finish(self, texts: int) -> None:
        """Context counts and unigram probabilities by number."""
        self.context = np.concatenate([self.counts, [0, texts]]).astype(np.float64)
        self.low = np.concatenate([self.counts, [1]]) / (self.tokens + 1)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashes."""
        hashes = np.append(self.hashes, np.int64(0))
        k = np.searchsorted(self.hashes, h)
        return np.where(h == START, self.start, np.where((k < self.rare) & (hashes[k] == h), k, self.rare))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = signed(xxhash.xxh3_64_intdigest(word))
        return got


def hashed(texts: list[str | None], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, text by text, and how many each text has."""
    tokens = [tokens_of(t) for t in texts]
    run = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.int64, int(run.sum())), run


def before(x: np.ndarray, run: np.ndarray, first: int) -> np.ndarray:
    """What stands before each token; ``first`` at a text's beginning."""
    out = np.concatenate([[first], x[:-1]])
    out[np.cumsum(run) - run] = first
    return out


def planes(x: np.ndarray, width: int = 0) -> bytes:
    """The rows' bytes (the first ``width`` of each), place by place: ordered or small numbers compress well so."""
    x = np.ascontiguousarray(x)
    own = x.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return x.view(np.uint8).reshape(len(x), own)[:, : width or own].T.tobytes()


def numbers(parts: Iterator[bytes], kind, width: int = 0) -> np.ndarray:
    """What ``planes`` has packed, part after part."""
    size = np.dtype(kind).itemsize
    raw = [np.frombuffer(p, np.uint8).reshape(width or size, -1).T for p in parts]
    out = np.zeros((sum(map(len, raw)), size), np.uint8)
    if raw:
        np.concatenate(raw, out=out[:, : width or size])
    return out.view(kind).ravel()


#: What a chunk holds of a row: its id, whether it is learned from, and its number of tokens.
OWN = np.dtype([("doc", "<i8"), ("null", "?"), ("learn", "?"), ("n", "<i8")])
PAIR, FOLLOWER = np.dtype([("left", "<i8"), ("right", "<i8")]), np.dtype([("count", "<u4"), ("unigram", "<u4")])
CHUNKS = "chunk long, own binary, tokens binary, odd binary"
SHARES = "bucket int, chunk long, keys binary, learned binary"
PARTS = "kind int, bucket int, chunk long, a binary, b binary"


def cut(docs: DataFrame, shared) -> DataFrame:
    """Rows of (doc_id, text, learn) as chunks: the rows' data, their tokens, and the hashes of words without number,
    which tokens name by their places from ``start + 1``."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, made = shared.value, Hashes(), TaskContext.get().partitionId() << 32

        def out(docs: list, texts: list, learn: list) -> pa.RecordBatch:
            h, run = hashed(texts, known)
            own = np.zeros(len(run), OWN)
            own["doc"], own["null"], own["learn"], own["n"] = [d or 0 for d in docs], [d is None for d in docs], learn, run
            token = words.places(h)
            unnumbered = token == words.rare
            odd, place = np.unique(h[unnumbered], return_inverse=True)
            token[unnumbered] = words.start + 1 + place
            row = (made, own.tobytes(), pa.compress(planes(token.astype(np.uint32)), "zstd", asbytes=True), odd.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), *3 * [pa.binary()]), strict=True)], ["chunk", "own", "tokens", "odd"])

        held, size_held = ([], [], []), 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for to, value in zip(held, row, strict=True):
                    to.append(value)
                size_held += 1 + len(row[1] or "") // 6
                if size_held >= FLUSH:
                    yield out(*held)
                    held, size_held, made = ([], [], []), 0, made + 1
        if held[0]:
            yield out(*held)

    return docs.select(F.col("doc_id").cast("long"), "text", "learn").mapInArrow(chunks, CHUNKS)


class Deal:
    """The bucket of a pair: of two numbers; of two words of which the second has none; of a first that has none. And
    the bucket of ``words`` without number, where their back-off weights are told."""

    def __init__(self, words: Words, buckets: int, rare_buckets: int, size: int):
        self.words, self.buckets, self.rare_buckets, self.size = words, buckets, rare_buckets, size

    def odd(self, h: np.ndarray) -> np.ndarray:
        return (mixed(h.view(np.uint64)) % np.uint64(self.rare_buckets)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray, odd: np.ndarray) -> np.ndarray:
        first = self.words.start + 1
        pieces = np.maximum(1, np.ceil(self.words.context / (self.size / 4))).astype(np.uint64)
        to, left, right = np.empty(len(a), np.int64), a >= first, b >= first
        both = ~left & ~right
        salt = mixed(b[both]) % pieces[a[both]]
        to[both] = mixed(a[both].astype(np.uint64) * np.uint64(1 << 20) + salt) % np.uint64(self.buckets)
        to[right] = self.buckets + self.odd(odd[b[right] - first])
        left &= ~right
        to[left] = self.buckets + self.rare_buckets + self.odd(odd[a[left] - first])
        return to


class Chunk:
    """A chunk's tokens: ``a`` and ``b`` are its different pairs in the order of their buckets ``to``, ``place`` says
    which of them each token ends."""

    def __init__(self, own: bytes, tokens: bytes, odd: bytes, words: Words):
        self.words, self.own, self.odd = words, np.frombuffer(own, OWN), np.frombuffer(odd, np.int64)
        raw = pa.decompress(tokens, 4 * int(self.own["n"].sum()), "zstd", asbytes=True)
        self.token = numbers([raw], np.uint32).astype(np.int64)
        self.at = np.repeat(np.arange(len(self.own)), self.own["n"])

    def pair_up(self, deal: Deal) -> None:
        top = self.words.start + 1 + len(self.odd)
        key, place = np.unique(before(self.token, self.own["n"], self.words.start) * top + self.token, return_inverse=True)
        a, b = key // top, key % top
        to = deal.pairs(a, b, self.odd)
        order = np.argsort(to, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.a, self.b, self.to, self.place = a[order], b[order], to[order], rank[place]

    def shares(self, deal: Deal) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, keys, how often training rows have them) for each bucket that the chunk has pairs of."""
        first = self.words.start + 1
        learned = np.bincount(self.place, self.own["learn"][self.at], len(self.a)).astype(np.uint32)
        whole = np.concatenate([np.arange(first), self.odd])
        for i, j in slices(self.to):
            a, b, to = self.a[i:j], self.b[i:j], int(self.to[i])
            keys = planes(a * first + b, WIDTH) if to < deal.buckets else planes(np.stack([whole[a], whole[b]], 1))
            yield to, keys, planes(learned[i:j])

    def asked(self, deal: Deal) -> tuple[np.ndarray, np.ndarray]:
        """The words without number that rows which aren't learned from have, in the order of their buckets, and those."""
        first = self.words.start + 1
        of = np.unique(self.token[~self.own["learn"][self.at] & (self.token >= first)]) - first
        to = deal.odd(self.odd[of])
        order = np.argsort(to, kind="stable")
        return of[order], to[order]


def slices(ordered: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(ordered, prepend=-1, append=-1))
    return zip(edge[:-1], edge[1:], strict=True)


def from_chunks(table: DataFrame, shared, rows_of: Callable[[int, Chunk], list[tuple]], schema: str) -> DataFrame:
    """Rows that are made of each chunk."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = rows_of(chunk, Chunk(*held, shared.value))
                for k in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 256], strict=True), types, strict=True)], names)

    return table.select("chunk", "own", "tokens", "odd").mapInArrow(made, schema)


def count_bucket(bucket: int, group: pd.DataFrame, words: Words) -> list[tuple]:
    """A bucket's parts: counts of counts (0), contexts (1), and each chunk's counts (2)."""
    pair, place = np.unique(numbers(group["keys"], np.int64, WIDTH), return_inverse=True)
    count = np.bincount(place, numbers(group["learned"], np.uint32), len(pair)).astype(np.int64)
    met = count > 0
    a, b = pair[met] // (words.start + 1), pair[met] % (words.start + 1)
    out = [(0, bucket, 0, levels_of(count), b"")]
    if len(a):
        out.append((1, bucket, 0, *context_part(a, words.low[b], count[met])))
    sent = np.cumsum([0, *(len(x) // 4 for x in group["learned"])])
    return out + [(2, bucket, chunk, planes(count[place[i:j]].astype(np.uint32)), b"") for chunk, i, j in zip(group["chunk"], sent[:-1], sent[1:], strict=True)]


def count_unnumbered(bucket: int, group: pd.DataFrame, words: Words, by_word: bool, deal: Deal) -> list[tuple]:
    """A bucket of pairs with a word that has no number, of all pairs with their second word (or their first).

    Parts as of other buckets, with the second words' counts beside those of pairs, for contexts that have a number; what
    training rows have after other contexts is dealt by them (9).
    """
    key = numbers(group["keys"], PAIR)
    order = np.lexsort((key["left"], key["right"]))
    left, right = key["left"][order], key["right"][order]
    new_word = np.append(True, right[1:] != right[:-1])
    new = new_word | np.append(True, left[1:] != left[:-1])
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    left, right = left[new], right[new]
    count = np.bincount(place, numbers(group["learned"], np.uint32), len(left)).astype(np.int64)
    if by_word:
        word = np.cumsum(new_word[new]) - 1
        unigram = np.bincount(word, count).astype(np.int64)[word]
    else:
        unigram = words.counts[right]
    met, numbered = count > 0, (left >= 0) & (left <= words.start)
    out = [(0, bucket, 0, levels_of(count), b"")]
    if (some := met & numbered).any():
        out.append((1, bucket, 0, *context_part(left[some], np.maximum(unigram[some], 1) / (words.tokens + 1), count[some])))
    late = np.flatnonzero(met & ~numbered)
    to = deal.odd(left[late])
    order = np.lexsort((left[late], to))
    for i, j in slices(to[order]):
        of = late[order[i:j]]
        out.append((9, int(to[order[i]]), 0, planes(left[of]), planes(np.stack([count[of], unigram[of]], 1).astype(np.uint32))))
    sent = np.cumsum([0, *(len(x) // 4 for x in group["learned"])])
    for chunk, i, j in zip(group["chunk"], sent[:-1], sent[1:], strict=True):
        which = place[i:j]
        out.append((2, bucket, chunk, planes(count[which].astype(np.uint32)), planes(unigram[which].astype(np.uint32)) if by_word else b""))
    return out


def levels_of(count: np.ndarray) -> bytes:
    """How many pairs have each count."""
    return np.bincount(np.minimum(count[count > 0], DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2].tobytes()


def context_part(a: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes]:
    """Per context: types of count 1 to DISCOUNTED, tokens of larger counts, unigram mass of what follows it."""
    each, columns = context_sums(a, low, count)
    return each.astype(np.int64).tobytes(), columns.tobytes()


def context_sums(a: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, place = np.unique(a, return_inverse=True)
    columns = [np.bincount(place, count == r, len(each)) for r in range(1, DISCOUNTED + 1)]
    columns += [np.bincount(place, np.where(count > DISCOUNTED, count, 0), len(each)), np.bincount(place, low, len(each))]
    return each, np.stack(columns, 1)


def back_off(held: np.ndarray, context: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 back-off weights of contexts, from their sums and counts."""
    r = np.arange(1, DISCOUNTED + 1)
    spent = (held[:, :DISCOUNTED] @ (d[1:] * r) + held[:, DISCOUNTED]) / (context + 1)
    rest = 1 - held[:, DISCOUNTED + 1]
    alpha = np.where(rest > 1e-12, (1 - spent) / np.maximum(rest, 1e-12), 1.0)
    return np.log10(np.maximum(alpha, 1e-300))


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing factors of counts 0 to DISCOUNTED (0 unused); n: counts of counts. Half a count off where the
    counts of counts allow no estimate."""
    d = np.array([1.0] + [(r - 0.5) / r for r in range(1, DISCOUNTED + 1)])
    if n[1] > 0:
        most = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        for r in range(1, DISCOUNTED + 1):
            if n[r] > 0 and most < 1:
                factor = ((r + 1) * n[r + 1] / n[r] / r - most) / (1 - most)
                if 0 < factor < 1:
                    d[r] = factor
    return d


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(docs: DataFrame, learn: Column, size: int = BUCKET, numbered: int = NUMBERED, sampled: int = SAMPLED) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; learns from rows where ``learn``.

    A task's bucket holds about ``size`` pairs; ``numbered`` words have numbers. ``sampled`` is for older callers and changes
    nothing: dealing needs no sample of the rows any more.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    counted = scratch.save(count_words(docs.filter("learn").select("text")), "words")
    words = Words(counted, numbered)
    end = signed(xxhash.xxh3_64_intdigest(END))
    ends = counted.filter(F.col("h") == end).collect()
    words.finish(ends[0]["c"] if ends else 0)
    scratch.drop(counted)
    length = F.octet_length(F.coalesce("text", F.lit(""))) + 6
    sizes = docs.agg(F.sum(length).alias("all"), F.sum(F.when(F.col("learn"), length)).alias("learned")).first()
    per_byte = words.tokens / sizes["learned"] if words.tokens else 1 / 6
    total = int((sizes["all"] or 0) * per_byte) + 1  # tokens of all rows, about
    rare = total * (words.rare_tokens / words.tokens if words.tokens else 1) + max(0, total - words.tokens) / 8
    buckets, rare_buckets = -(-total // size), int(rare * 4 / 3 / max(1, size // 8)) + 1  # keys with hashes are longer
    shared = spark.sparkContext.broadcast(words)
    name = f"contentlake_chunks_{uuid.uuid4().hex}"
    chunks = cut(docs, shared).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    chunks.option("path", f"{scratch.base}/chunks").option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)

    def dealt() -> Deal:
        return Deal(shared.value, buckets, rare_buckets, size)

    def shares(chunk: int, held: Chunk) -> list[tuple]:
        deal = dealt()
        held.pair_up(deal)
        return [(to, chunk, keys, learned) for to, keys, learned in held.shares(deal)]

    def reduce_bucket(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(key[0])
        if bucket < buckets:
            rows = count_bucket(bucket, group, shared.value)
        else:
            rows = count_unnumbered(bucket, group, shared.value, bucket < buckets + rare_buckets, dealt())
        return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "a", "b"])

    parts = scratch.save(from_chunks(table, shared, shares, SHARES).groupBy("bucket").applyInPandas(reduce_bucket, PARTS), "parts")
    _, alpha, d = weights(parts, words)
    model = spark.sparkContext.broadcast((alpha, d))

    def ask(chunk: int, held: Chunk) -> list[tuple]:
        of, to = held.asked(dealt())
        return [(11, int(to[i]), chunk, planes(held.odd[of[i:j]]), b"") for i, j in slices(to)]

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        """Back-off weights of the words that chunks ask for; the group has all that follows these words."""
        asks, known = group[group["kind"] == 11], group[group["kind"] == 9]
        each, place = np.unique(numbers(asks["a"], np.int64), return_inverse=True)
        left, after = numbers(known["a"], np.int64), numbers(known["b"], FOLLOWER)
        at = np.searchsorted(each, left)
        some = np.append(each, 0)[at] == left
        some &= at < len(each)
        at, count, low = at[some], after["count"][some].astype(np.int64), np.maximum(after["unigram"][some], 1) / (shared.value.tokens + 1)
        held = np.zeros((len(each), DISCOUNTED + 2))
        met, sums = context_sums(at, low, count)
        held[met] = sums
        told = back_off(held, np.bincount(at, count, len(each)), model.value[1])[place]
        sent = np.cumsum([0, *(len(x) // 8 for x in asks["a"])])
        return asks.assign(a=[told[i:j].tobytes() for i, j in zip(sent[:-1], sent[1:], strict=True)])

    def score(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        return score_chunk(rows, counts, shared.value, *model.value, dealt())

    asked = from_chunks(table, shared, ask, PARTS).unionByName(parts.filter("kind = 9"))
    answers = parts.filter("kind = 2").unionByName(asked.groupBy("bucket").applyInPandas(answer, PARTS))
    out = scratch.save(table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, RESULT), "scores")
    spark.sql(f"DROP TABLE {name}")
    scratch.clear(out)
    return out


def score_chunk(rows: pd.DataFrame, counts: pd.DataFrame, words: Words, alpha: np.ndarray, d: np.ndarray, deal: Deal) -> pd.DataFrame:
    """The result's rows of a chunk, from the counts of its pairs and the weights that it asked for."""
    held = Chunk(*rows.iloc[0][["own", "tokens", "odd"]], words)
    held.pair_up(deal)
    counts = counts.sort_values("bucket")
    paired, told = counts[counts["kind"] == 2], counts[counts["kind"] == 11]
    c, first = numbers(paired["a"], np.uint32).astype(np.int64), words.start + 1
    unigram, back = np.zeros(len(held.odd), np.int64), np.zeros(len(held.odd))
    unigram[held.b[held.b >= first] - first] = numbers(paired["b"], np.uint32)
    back[held.asked(deal)[0]] = np.frombuffer(b"".join(told["a"]))
    seen = np.concatenate([words.counts, [0, 0], unigram])
    context = np.concatenate([words.context, unigram])[held.a]
    low = np.maximum(seen[held.b], 1) / (words.tokens + 1)
    factor = np.append(d, 1.0)[np.minimum(c, DISCOUNTED + 1)]
    value = np.where(c > 0, np.log10(np.maximum(c, 1) * factor) - np.log10(context + 1), np.concatenate([alpha, back])[held.a] + np.log10(low))
    add = lambda x: np.bincount(held.at, x, len(held.own))
    whole = float(np.log10(words.tokens + words.types + 1))
    return pd.DataFrame(
        {
            "doc_id": pd.arrays.IntegerArray(held.own["doc"].copy(), held.own["null"].copy()),
            "held_out": ~held.own["learn"],
            "n_tokens": held.own["n"],
            "n_known": add(seen[held.token] > 0).astype(np.int64),
            "train_tokens": words.tokens,
            "base_score": add(np.log10(seen[held.token] + 1.0)) - held.own["n"] * whole,
            "score": add(value[held.place]),
        }
    )


def weights(parts: DataFrame, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of counts, log10 back-off weights by context, and discount factors."""
    names = [f"x{k}" for k in range(DISCOUNTED + 2)]

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([np.frombuffer(a, np.int64) for a in batch["a"]], columns=names)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"], strict=True):
                yield pd.DataFrame(np.frombuffer(b).reshape(-1, len(names)), columns=names).assign(context=np.frombuffer(a, np.int64))

    total = parts.filter("kind = 0").select("a").mapInPandas(levels, ", ".join(f"{x} long" for x in names)).agg(*(F.sum(x).alias(x) for x in names)).first()
    n = np.array([total[x] or 0 for x in names], float)
    flat = parts.filter("kind = 1").select("a", "b").mapInPandas(contexts, ", ".join(f"{x} double" for x in names) + ", context long")
    table = flat.groupBy("context").agg(*(F.sum(x).alias(x) for x in names)).toArrow()  # at most a row per frequent word
    held = np.zeros((words.rare + 2, len(names)))
    held[table["context"].to_numpy()] = np.stack([table[x].to_numpy() for x in names], 1)
    d = discounts(n)
    return n, back_off(held, words.context, d), d

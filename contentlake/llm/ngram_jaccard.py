"""N-gram Jaccard join by PartEnum signatures.

A text's set is that of its distinct five-word shingles. Two texts link when 100 * |intersection| >= 75 * |union|.

1. Documents with equal sets are one class; only classes are compared, and members get their class's result.
2. A class of which more than a quarter of all shingles are its own alone can't link: a partner shares at least
   three quarters. Own shingles are counted on a fixed share of the shingle domain, which can only understate
   them. The step is repeated on all shingles among the classes that are left.
3. PartEnum: a band of set sizes up to e has a Hamming limit k = 2e/7 (|r| + |s| over 7 is the largest difference
   of linked sets). The shingle domain is hashed into n1 groups of n2 parts, 2 * n1 > k. A pair within the limit
   differs in at most one part of some group, so it agrees on one of the group's subsets of n2 - 1 parts; the
   hash of a subset's shingles is a signature. Sets near the top of a band give signatures in the next band too.
   Subsets without shingles are left out, unless a set fills so few groups that such a one could be all that a
   pair agrees on (2 * groups with two filled parts <= n / 3); then it gives those as well. Small sets have groups
   of one part, and more of them.
4. A bucket's leader is the class with the smallest share of shingles of its own: of a group of near copies that
   is one close to what they were copied from. Every class of a bucket is compared with its leader, unless a bound
   rules a link out; a leader's cluster is all of those classes. Pairs that share a signature are in one cluster, at least.
5. Links between leaders and members make first components. A further link joins two of them; its end x in the component
   with fewer classes asks. What x shares with the nearest leader L that it doesn't link to is known (or measured now, if L is likely to be near), so a
   partner too large to link by that alone has a shingle of x outside L; of the m such shingles that other classes
   have, it has at least t, hence one of the m - t + 1 rarest. Smaller partners are sought by the rarest shingles of x
   as a whole. Both are joins on shingles, within the sizes that can link, across components only; what they find is
   bounded and compared. So each pair that shares a signature has been compared, ruled out, or is connected anyhow: no
   link is lost, and a large group of near copies costs links in proportion to its size.

All comparisons are exact (of 64-bit hashes of shingles).

Defined cases: null, empty and wordless texts have an empty set, link with nothing and are components of their
own; texts with fewer than five words are one shingle; texts of any length are read whole; repeated rows are a
class; a null doc_id never names a component that has another id; tables without rows give none; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentlake.llm.common import BROADCAST_ROWS, Scratch, dealt, frequent_join, small_batches, spread_join
from contentlake.llm.components import components

WORDS, PERCENT = 5, 75
#: Share of the shingle domain on which own shingles are counted first.
SHARE = 0.4
#: Parts of a group and how many may differ; numbers of a bucket, and shingles of a task before it hands them on.
PARTS, DIFFER, BUCKET, FLUSH = 3, 1, 3_000_000, 400_000
#: Bins of the last bound.
BINS = 256

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, known: WordHash, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word windows; A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(w))
    s = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        s = mixed(s + w[k : len(w) - size + 1 + k])
    return np.unique(s)


def shingle_sets(texts: list[str | None], known: WordHash, width: int = WORDS) -> list[np.ndarray]:
    """``shingles`` of each text, with the windows of all texts hashed at once."""
    words = [(t or "").encode().lower().split() for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    w = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(lens.sum()))
    first = np.cumsum(lens) - lens
    windows = np.maximum(lens - width + 1, 0)
    end = np.cumsum(windows)
    at = np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - windows), windows)
    s = np.full(len(at), width, np.uint64)
    for k in range(width):
        s = mixed(s + w[at + k])
    out = []
    for n, i, j, k in zip(lens.tolist(), (end - windows).tolist(), end.tolist(), first.tolist(), strict=True):
        if n >= width:
            part = s[i:j]
            part.sort()
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        else:
            short = np.full(min(n, 1), n, np.uint64)
            for x in w[k : k + n]:
                short = mixed(short + x)
            out.append(short)
    return out


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def portions(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts in order, in lists of so many characters (or of one text)."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t or "") > most:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t or "")
    if part:
        yield part


KEYS = "bucket int, keys binary, who binary, runs binary"


#: A shingle that more sets of one pack have is known to be shared, and isn't dealt out to be counted.
COMMON = 64


def ends(keys: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which places hold a key with the least or the greatest of its names: two of each key at most."""
    order = np.lexsort((names, keys))
    new = np.diff(keys[order], prepend=~keys[order[:1]]) != 0 if len(keys) else np.zeros(0, bool)
    out = np.zeros(len(keys), bool)
    out[order[new | np.append(new[1:], True)]] = True
    return out


def packed(sets: list[np.ndarray], names: np.ndarray, buckets: int, deals: int | None = None) -> Iterator[pa.RecordBatch]:
    """Shingles dealt by themselves into buckets: a row has a bucket's shingles, set by set; whose; how many of each.

    However many sets share a shingle, few of a pack are dealt to its bucket. Without ``deals`` only the least and the greatest
    set of each shingle count. With it, a shingle that over COMMON sets of the pack have goes straight back to them: rows of
    a negative bucket (-1 less the class's deal) have shingles, whose, and counts that say that all others are rarer."""
    keys = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    rows = []
    if deals is None:
        kept = ends(keys, names[owner])
    else:
        _, place, often = np.unique(keys, return_inverse=True, return_counts=True)
        often = often[place]
        kept = often <= COMMON
        who, key, n = names[owner[~kept]], keys[~kept], (often[~kept] + (1 << 30)).astype(np.int32)
        for to, at in dealt((mixed(who.view(np.uint64)) % np.uint64(deals)).astype(np.int64)):
            rows.append((-1 - to, key[at].tobytes(), who[at].tobytes(), n[at].tobytes()))
    keys, owner = keys[kept], owner[kept]
    where = (mixed(keys + _M2) % np.uint64(buckets)).astype(np.int64)
    for bucket, at in dealt(where):
        new = np.flatnonzero(np.diff(owner[at], prepend=-1))
        rows.append((bucket, keys[at].tobytes(), names[owner[at][new]].tobytes(), np.diff(np.append(new, len(at))).astype(np.int32).tobytes()))
    for k in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "who", "runs"])


CUT = "ids array<long>, sizes array<long>, classes array<long>, " + KEYS


def cut(docs: DataFrame, buckets: int, flush: int = FLUSH) -> DataFrame:
    """One pass over all texts: rows of profiles (ids, sizes and classes) and rows of packed shingles, of the share of
    the domain that step 2 counts on. A task packs a text that it has met before only once."""
    kinds = [pa.list_(pa.int64())] * 3 + [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in CUT.split(", ")]

    def rows(columns: list, count: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(count, t) if c is None else c for c, t in zip(columns, kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met, limit = WordHash(), {}, np.uint64(int(SHARE * 2**64))
        held, owners, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for b in packed(held, np.array(owners, np.int64), buckets):
                yield rows([None] * 3 + b.columns, b.num_rows)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            marks = [xxhash.xxh3_128_digest((t or "").encode()) for t in texts]
            new = {m: t for m, t in zip(marks, texts, strict=True) if m not in met}
            if len(met) > 100_000:
                met = {m: met[m] for m in marks if m in met}
            fresh = iter(new)
            for part in portions(list(new.values())):
                for s in shingle_sets(part, known):
                    name = set_hash(s) if len(s) else None
                    met[next(fresh)] = (len(s), name)
                    if name is not None:
                        held.append(s[: np.searchsorted(s, limit)])
                        owners.append(name)
                        size += len(held[-1])
                    if size >= flush:
                        yield from out()
                        held, owners, size = [], [], 0
            if len(texts):
                found = [met[m] for m in marks]
                profile = [[batch.column(0).cast(pa.int64()).to_pylist()], [[n for n, _ in found]], [[c for _, c in found]]]
                yield rows([pa.array(p, pa.list_(pa.int64())) for p in profile] + [None] * 4, 1)
        if held:
            yield from out()

    return docs.select("doc_id", "text").mapInArrow(work, CUT)


def profiles(cuts: DataFrame) -> DataFrame:
    """doc_id, n and cls of every row: the set's size and hash (null if empty)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([c.flatten() for c in batch.columns], ["doc_id", "n", "cls"])

    return cuts.filter("ids IS NOT NULL").select("ids", "sizes", "classes").mapInArrow(unpack, "doc_id long, n long, cls long")


def numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The bytes of all rows of a binary column, one after the other, as numbers; they aren't copied row by row."""
    parts = []
    for c in column.chunks:
        _, offsets, held = c.buffers()
        edge = np.frombuffer(offsets, np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else [0, 0]
        parts.append(np.frombuffer(held, np.uint8)[edge[0] : edge[-1]].view(kind) if edge[-1] > edge[0] else np.zeros(0, kind))
    return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, kind)])


def sorted_keys(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's packed shingles, sorted; whose; where each different one begins, and how many rows it has."""
    key, owner = numbers(group["keys"], np.uint64), np.repeat(numbers(group["who"], np.int64), numbers(group["runs"], np.int32))
    order = np.argsort(key)
    key = key[order]  # one after the other: each frees what it was sorted from
    owner = owner[order]
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    return key, owner, first, np.diff(first, append=len(key))


def by_deal(owner: np.ndarray, deals: int) -> Iterator[tuple[int, np.ndarray]]:
    return dealt((mixed(owner.view(np.uint64)) % np.uint64(deals)).astype(np.int32))


def table(schema: str, *columns: list) -> pa.Table:
    """Columns by Spark's names of their types."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: c if isinstance(c, pa.Array) else pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


COUNTS, RARE = "deal int, who binary, counts binary", "deal int, who binary, keys binary, counts binary"


def alone_in(shares: DataFrame, deals: int) -> DataFrame:
    """(cls, alone): how many of the packed shingles no other class has.

    A class with shingles of its own has a row in each bucket that holds one, so what is summed up grows with classes times
    buckets as long as that is less than the shingles; ``deals`` is to follow it."""

    def count(group: pa.Table) -> pa.Table:
        _, owner, first, _ = sorted_keys(group)
        least, most = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
        names, counts = np.unique(least[least == most], return_counts=True)
        rows = [(to, names[at].tobytes(), counts[at].astype(np.int32).tobytes()) for to, at in by_deal(names, deals)]
        return table(COUNTS, *zip(*rows, strict=True)) if rows else table(COUNTS, [], [], [])

    def total(group: pa.Table) -> pa.Table:
        names, counts = numbers(group["who"], np.int64), numbers(group["counts"], np.int32)
        order = np.argsort(names)
        names, counts = names[order], counts[order]
        first = np.flatnonzero(np.diff(names, prepend=~names[:1]) != 0)
        return table("cls long, alone long", names[first], np.add.reduceat(counts, first, dtype=np.int64))

    found = shares.groupBy("bucket").applyInArrow(count, COUNTS)
    return found.groupBy("deal").applyInArrow(total, "cls long, alone long")


def rarity(shares: DataFrame, deals: int) -> DataFrame:
    """(cls, h): the shingles of a packed set that other classes have too, the rarest first."""

    def count(group: pa.Table) -> pa.Table:
        key, owner, _, often = sorted_keys(group)
        shared = np.repeat(often > 1, often)
        key, owner, often = key[shared], owner[shared], np.repeat(often[often > 1], often[often > 1]).astype(np.int32)
        rows = [(to, owner[at].tobytes(), key[at].tobytes(), often[at].tobytes()) for to, at in by_deal(owner, deals)]
        return table(RARE, *zip(*rows, strict=True)) if rows else table(RARE, [], [], [], [])

    def gather(group: pa.Table) -> pa.Table:
        owner, key, often = (numbers(group[c], t) for c, t in (("who", np.int64), ("keys", np.int64), ("counts", np.int32)))
        order = np.lexsort((key, often, owner))
        owner, key = owner[order], key[order]
        first = np.flatnonzero(np.diff(owner, prepend=~owner[:1]) != 0)
        return pa.table({"cls": owner[first], "h": pa.ListArray.from_arrays(np.append(first, len(key)).astype(np.int32), key)})

    found = shares.filter("bucket >= 0").groupBy("bucket").applyInArrow(count, RARE)
    found = found.unionByName(shares.filter("bucket < 0").select((-1 - F.col("bucket")).alias("deal"), "who", "keys", F.col("runs").alias("counts")))
    return found.groupBy("deal").applyInArrow(gather, "cls long, h array<long>")


def linkable(classes: DataFrame, alone: DataFrame) -> DataFrame:
    """Classes (cls, n, ...) without those that have over a quarter of their shingles to themselves (alone)."""
    with_counts = classes.join(alone, "cls", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    return with_counts.filter(few_alone())


def few_alone() -> Column:
    return 100 * F.col("alone") <= (100 - PERCENT) * F.col("n")


def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cls and its whole set, from the text of the class's representative."""
    wanted = classes.select(F.col("rep").alias("doc_id"), "cls")
    if classes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    chosen = docs.select("doc_id", "text").join(wanted, "doc_id")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            names = iter(batch.column(1).to_pylist())
            for part in portions(batch.column(0).to_pylist()):
                sets = [(c, s) for s, c in zip(shingle_sets(part, known), names, strict=False) if len(s) and set_hash(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sets], pa.int64()), lists([s for _, s in sets])], ["cls", "s"])

    return chosen.select("text", "cls").mapInArrow(whole, "cls long, s array<long>")


def lists(sets: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The sets of a list column."""
    edge, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]


def pack_sets(sets: DataFrame, buckets: int, deals: int, flush: int = FLUSH) -> DataFrame:
    """All shingles of kept sets (cls, s), packed; classes are dealt into ``deals``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, size = [], [], 0
        for batch in batches:
            for name, s in zip(batch.column(0).to_pylist(), arrays(batch.column(1)), strict=True):
                held.append(s)
                owners.append(name)
                size += len(s)
                if size >= flush:
                    yield from packed(held, np.array(owners, np.int64), buckets, deals)
                    held, owners, size = [], [], 0
        if held:
            yield from packed(held, np.array(owners, np.int64), buckets, deals)

    return sets.select("cls", "s").mapInArrow(work, KEYS)


def bands_of(n: int) -> list[int]:
    """Bands in which a set of this size gives signatures; band b holds sizes up to 8 * 2**b, over half of that."""
    band = 0
    while 8 << band < n:
        band += 1
    return [band, band + 1] if PERCENT * (8 << band) < 100 * n else [band]


def scheme(band: int) -> tuple[int, int, int]:
    """Groups, parts of a group, and parts that may differ, for the sizes of a band."""
    top = 8 << band
    if top <= 32:  # with few shingles a group is one part, and there are more groups
        return top + 16, 1, 0
    return max((2 * top // 7) // (DIFFER + 1) + 1, top // 5 + 8), PARTS, DIFFER


def signatures(s: np.ndarray) -> np.ndarray:
    """PartEnum signatures of one set."""
    out, x = [], mixed(s.astype(np.uint64))
    spread = mixed(x + _M1)
    for band in bands_of(len(s)):
        groups, parts, differ = scheme(band)
        part = (x % np.uint64(groups * parts)).astype(np.int64)
        sums = np.zeros(groups * parts, np.uint64)
        np.add.at(sums, part, spread)
        held = np.bincount(part, minlength=groups * parts).reshape(groups, parts) > 0
        sums = sums.reshape(groups, parts)
        rich = int((held.sum(1) > differ).sum())
        few = (differ + 1) * rich <= len(s) // 3
        for subset in combinations(range(parts), parts - differ):
            value = mixed(np.arange(groups, dtype=np.uint64) * np.uint64(64) + np.uint64((band << 40) + sum(1 << p for p in subset)))
            for p in subset:
                value = mixed(value + sums[:, p])
            out.append(value if few else value[held[:, list(subset)].any(1)])
    return np.concatenate(out)


MEMBERS = "bucket int, sigs binary, own binary, who binary"


def members(sets: DataFrame, buckets: int, salts: int, flush: int = FLUSH) -> DataFrame:
    """Every signature of every set (cls, alone, s), dealt by signature, and by class where one task couldn't hold all
    classes; own: thousandths of shingles that no other class has."""

    def enumerate_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, names, owns, size = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            count = [len(f) for f in found]
            sig, who, own = np.concatenate(found), np.repeat(np.array(names, np.int64), count), np.repeat(np.array(owns, np.int16), count)
            where = (mixed(sig + _M2) % np.uint64(buckets)) * np.uint64(salts) + mixed(who.view(np.uint64)) % np.uint64(salts)
            rows = [(bucket, sig[at].tobytes(), own[at].tobytes(), who[at].tobytes()) for bucket, at in dealt(where.astype(np.int64))]
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "sigs", "own", "who"])

        for batch in batches:
            for name, own, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), arrays(batch.column(2)), strict=True):
                found.append(signatures(s))
                names.append(name)
                owns.append(own)
                size += len(found[-1])
                if size >= flush:
                    yield from out()
                    found, names, owns, size = [], [], [], 0
        if found:
            yield from out()

    own = (1000 * F.col("alone") / F.size("s")).cast("int").alias("own")
    return sets.select("cls", own, "s").mapInArrow(enumerate_parts, MEMBERS)


def led(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's signatures, shares and classes, sorted; where a signature begins, and which one each row has."""
    sig, own, who = (numbers(group[c], t) for c, t in (("sigs", np.int64), ("own", np.int16), ("who", np.int64)))
    order = np.lexsort((who, own, sig))
    sig, own, who = sig[order], own[order], who[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
    return sig, own, who, np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1


PAIR, LOCAL = "lead long, cls long", "part int, sig long, own int, cls long"


def pairs_of(lead: np.ndarray, who: np.ndarray) -> pa.Table:
    two = lead != who
    pair = np.unique(np.stack([lead[two], who[two]], 1), axis=0)
    return table(PAIR, pair[:, 0], pair[:, 1])


def leader_pairs(every: DataFrame, salts: int) -> DataFrame:
    """Pairs (lead, cls): each class of a bucket with the bucket's leader, each pair once."""

    def whole(group: pa.Table) -> pa.Table:
        _, _, who, first, place = led(group)
        return pairs_of(who[first][place], who)

    if salts == 1:  # a task's classes are few enough for every signature
        return every.groupBy("bucket").applyInArrow(whole, PAIR).distinct()

    def local(group: pa.Table) -> pa.Table:
        sig, own, who, first, _ = led(group)
        return table(LOCAL, np.full(len(first), group["bucket"][0].as_py() // salts), sig[first], own[first], who[first])

    def joined(group: pa.Table, leaders: pa.Table) -> pa.Table:
        sig, _, who, _, _ = led(group)
        leaders = leaders.sort_by("sig")
        return pairs_of(leaders["lead"].to_numpy()[np.searchsorted(leaders["sig"].to_numpy(), sig)], who) if len(sig) else pairs_of(who, who)

    leaders = every.groupBy("bucket").applyInArrow(local, LOCAL).groupBy("part", "sig").agg(F.min(F.struct("own", "cls"))["cls"].alias("lead"))
    leaders = leaders.select(F.explode(F.sequence(F.col("part") * salts, F.col("part") * salts + salts - 1)).alias("bucket"), "sig", "lead")
    return every.groupBy("bucket").cogroup(leaders.groupBy("bucket")).applyInArrow(joined, PAIR).distinct()


def measured(pairs: DataFrame, sets: DataFrame, a: str = "lead", b: str = "cls") -> DataFrame:
    """The pairs with i, the size of their intersection. Each pair carries one set to where the other is."""
    both = frequent_join(pairs, sets.select(F.col("cls").alias(a), F.col("s").alias("_a")), a)
    both = both.join(sets.select(F.col("cls").alias(b), F.col("s").alias("_b")), b)
    return both.select(a, b, F.size(F.array_intersect("_a", "_b")).alias("i"))


def enough(common: Column, sizes: Column) -> Column:
    """Do sets of together ``sizes`` shingles link if they share ``common``?"""
    return (100 + PERCENT) * common >= PERCENT * sizes


def bins(sets: DataFrame) -> DataFrame:
    """cls, n, held (shingles that other classes have too) and counts over hashed bins."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), (mixed(lists.values.to_numpy(zero_copy_only=False).view(np.uint64) + _M2) % np.uint64(BINS)).astype(np.int64)
            rows = [np.bincount(flat[i:j], minlength=BINS) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            values = pa.ListArray.from_arrays(np.arange(0, BINS * len(rows) + 1, BINS, dtype=np.int32), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), values], ["cls", "n", "held", "bins"])

    n = F.size("s").cast("long")
    return sets.select("cls", n.alias("n"), (n - F.col("alone")).alias("held"), "s").mapInArrow(count, "cls long, n long, held long, bins array<int>")


def possible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (lead, cls) with ``sizes``, ``open`` (whether sizes, shared shingles and bins allow a link), and the bound
    by bins (null if it isn't needed to rule out a link)."""
    side = lambda name, mark, *of: facts.select(F.col("cls").alias(name), *(F.col(c).alias(f"{mark}_{c}") for c in of))
    rows = frequent_join(pairs, side("lead", "x", "n", "held"), "lead").join(side("cls", "y", "n", "held"), "cls")
    sizes = F.col("x_n") + F.col("y_n")
    fits = (100 * F.least("x_n", "y_n") >= PERCENT * F.greatest("x_n", "y_n")) & enough(F.least("x_held", "y_held"), sizes)
    rows = rows.select("lead", "cls", sizes.alias("sizes"), fits.alias("open"))
    closer = frequent_join(rows.filter("open"), side("lead", "x", "bins"), "lead").join(side("cls", "y", "bins"), "cls").select("lead", "cls", "sizes", binned("x_bins", "y_bins").alias("bound"))
    closed = rows.filter("NOT open").select("lead", "cls", "sizes", F.lit(None).cast("int").alias("bound"), "open")
    return closed.unionByName(closer.withColumn("open", enough(F.col("bound"), F.col("sizes"))))


def binned(a: str, b: str) -> Column:
    """The sum of lesser counts over the bins: two sets share no more."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda t, c: t + c)


def late_pairs(cluster: DataFrame, facts: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (lead, cls) of classes of different labels, for links that no leader shows (step 5).

    cluster: lead, cls, i (null if it wasn't measured), bound, linked (to the lead). facts: cls, n, held, label, mass.
    sets: cls and its shingles that other classes have too, the rarest first.
    """
    itself = cluster.select("lead").distinct().select("lead", F.col("lead").alias("cls"))
    rows = scratch.save(cluster.select("lead", "cls").unionByName(itself).join(facts.select("cls", "n", "held", "label", "mass"), "cls"), "rows")
    least = scratch.save(rows.groupBy("lead").agg(F.min("n").alias("least")), "least")
    low = F.greatest("least", F.ceil(F.col("n") * PERCENT / 100))
    rows = spread_join(rows, least, "lead").withColumn("lo", low).filter(enough(F.col("held"), F.col("n") + F.col("lo")))
    heaviest = rows.groupBy("lead").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.max(F.struct("mass", "label"))["label"].alias("top"))
    several = scratch.save(heaviest.filter("l <> m").select("lead", "top"), "several")
    askers = spread_join(rows, several, "lead").filter("label <> top").groupBy("cls").agg(F.min("lo").alias("lo"))
    askers = scratch.save(askers, "askers")
    near = cluster.filter("NOT linked AND i IS NOT NULL").groupBy("cls").agg(F.max(F.struct("i", "lead")).alias("near"))
    likely = cluster.join(askers.join(near, "cls", "left_anti").join(facts.select("cls", "n"), "cls"), "cls").filter("i IS NULL AND 2 * bound >= n")
    likely = measured(likely.groupBy("cls").agg(F.max(F.struct("bound", "lead"))["lead"].alias("lead")), sets)
    near = near.unionByName(likely.select("cls", F.struct(F.col("i"), "lead").alias("near")))
    asks = askers.join(near, "cls", "left").join(facts.select("cls", "n", "held", "label", "mass"), "cls")
    asks = asks.select("cls", "n", "label", "mass", "lo", F.coalesce("near.i", F.lit(0)).cast("long").alias("i"), "near.lead", F.expr(f"{100 + PERCENT} * held div {PERCENT} - n").alias("most"))
    asks = scratch.save(asks.withColumn("inside", F.expr(f"{100 + PERCENT} * i div {PERCENT} - n")), "asks")
    beyond = asks.withColumn("lo", F.greatest("lo", F.col("inside") + 1))
    within = asks.filter("inside >= lo").select("cls", "n", "label", "mass", "lo", F.lit(0).cast("long").alias("i"), F.lit(None).cast("long").alias("lead"), F.least("most", "inside").alias("most"))
    asks = beyond.drop("inside").unionByName(within).filter("lo <= most")
    asks = scratch.save(asks, "asks")
    leads = scratch.save(asks.filter("lead IS NOT NULL").select("lead").distinct(), "leads")
    theirs = spread_join(sets.select(F.col("cls").alias("lead"), F.col("s").alias("ls")), leads, "lead")
    fewest = F.ceil((F.col("n") + F.col("lo")) * PERCENT / (100 + PERCENT)) - F.col("i")
    mine = asks.select("cls", "lo", "most", "label", "mass", "lead", fewest.cast("int").alias("fewest"))
    asked = spread_join(sets.select("cls", "s"), mine, "cls").join(theirs, "lead", "left")
    asked = asked.withColumn("s", F.array_except("s", F.coalesce("ls", F.array().cast("array<long>")))).filter("size(s) >= fewest")
    rarest = F.explode(F.slice("s", F.lit(1), F.size("s") - F.col("fewest") + 1)).alias("e")
    asked = scratch.save(asked.select("cls", "lo", "most", "label", "mass", rarest), "asked")
    wanted = scratch.save(asked.select("e").distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    there = sets.select(F.col("cls").alias("y"), F.explode("s").alias("e")).join(wanted, "e")
    there = spread_join(there, facts.select(F.col("cls").alias("y"), F.col("n").alias("y_n"), F.col("label").alias("y_label"), F.col("mass").alias("y_mass")), "y")
    # a shingle that one component alone has, on both sides, links nothing
    there = scratch.save(there, "there")
    holders = there.groupBy("e").agg(F.min("y_label").alias("from_label"), F.max("y_label").alias("to_label"))
    asked = asked.join(holders, "e").filter("label <> from_label OR label <> to_label").drop("from_label", "to_label")
    found = frequent_join(scratch.save(asked, "open"), there, "e", 2_000).filter("(y_mass > mass OR y_mass = mass AND y_label > label) AND y_n BETWEEN lo AND most")
    return found.select(F.least("cls", "y").alias("lead"), F.greatest("cls", "y").alias("cls")).distinct()


def labelled(facts: DataFrame, labels: DataFrame, node: str = "cls") -> DataFrame:
    """facts with the label of each class; its own name if it has none."""
    known = labels.select(F.col("node").alias(node), F.col("label").alias("_label"))
    return spread_join(facts, known, node, "left").withColumn("label", F.coalesce("_label", node)).drop("_label")


def near_copies(docs: DataFrame, bucket: int = BUCKET, most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row. A task holds about ``bucket`` numbers and ``most`` classes; a shingle,
    a signature or a count comes with its class, so it is two.

    A component is named by its smallest id that isn't null; documents that all lack an id have a null one, linked or not.
    """
    small_batches(docs.sparkSession, 1000)
    scratch = Scratch(docs.sparkSession)
    parts = lambda n: max(1, -(-int(n) // bucket))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = parts(2 * size * SHARE / 6)
    cuts = scratch.save(cut(docs, buckets), "cuts")
    slim = scratch.save(profiles(cuts), "slim")
    classes = scratch.save(slim.filter("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("rep")), "classes")
    deals = parts(2 * min(classes.count() * buckets, size * SHARE / 6))
    left = scratch.save(linkable(classes, alone_in(cuts.filter("bucket IS NOT NULL").select("bucket", "keys", "who", "runs"), deals)), "left")
    scratch.drop(cuts)
    sets = scratch.save(sets_of(docs, left).dropDuplicates(["cls"]).withColumn("n", F.size("s")), "sets")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = scratch.save(pack_sets(sets, parts(2 * total), parts(2 * total)), "shares")
    kept = sets.join(rarity(shares, parts(2 * total)), "cls").withColumn("alone", F.col("n") - F.size("h"))
    kept = scratch.save(kept.filter(few_alone()).select("cls", "alone", "s", "h"), "kept")
    scratch.drop(sets, shares)
    sets, held, salts = kept, kept.select("cls", F.col("h").alias("s")), max(1, -(-kept.count() // most))
    every = members(sets, parts(4 * total), salts)
    every = scratch.save(every, "members") if salts > 1 else every
    pairs = scratch.save(leader_pairs(every, salts), "pairs")
    facts = scratch.save(bins(sets), "facts")
    pairs = scratch.save(possible(pairs, facts), "possible")
    found = measured(pairs.filter("open").select("lead", "cls"), held).join(pairs, ["lead", "cls"])
    closed = pairs.filter("NOT open").select("lead", "cls", F.lit(None).cast("int").alias("i"), "bound", F.lit(False).alias("linked"))
    cluster = scratch.save(found.select("lead", "cls", "i", "bound", enough(F.col("i"), F.col("sizes")).alias("linked")).unionByName(closed), "cluster")
    labels = scratch.save(components(cluster.filter("linked").select(F.col("lead").alias("a"), F.col("cls").alias("b")), scratch), "labels")
    facts = labelled(facts, labels)
    mass = scratch.save(facts.groupBy("label").agg(F.count("*").alias("mass")), "mass")
    facts = scratch.save(spread_join(facts, mass, "label"), "labelled")
    late = scratch.save(possible(scratch.save(late_pairs(cluster, facts, held, scratch), "late"), facts), "late")
    late = measured(late.filter("open").select("lead", "cls"), held).join(late, ["lead", "cls"]).filter(enough(F.col("i"), F.col("sizes")))
    side = lambda name, to: facts.select(F.col("cls").alias(name), F.col("label").alias(to))
    links = late.join(side("lead", "a"), "lead").join(side("cls", "b"), "cls").select("a", "b")
    more = scratch.save(components(links, scratch), "more")
    named = labelled(labelled(classes.select("cls", "rep"), labels).withColumnRenamed("label", "first"), more, "first")
    smallest = scratch.save(named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")).filter("size > 1").drop("size"), "smallest")
    of_class = spread_join(named, smallest, "label", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"))
    return spread_join(slim, scratch.save(of_class, "of_class"), "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

"""Full-text search: an inverted index as a DataFrame, match expressions as joins on it, BM25 ranking.

A query is a small expression: words side by side or joined by AND, OR, NOT and brackets; ``"a phrase"``;
``prefix*``; ``^first`` word of a column; ``column:`` or ``{a b}:`` before a part, with ``-`` for all other columns;
``NEAR(a b, 5)``. It is read into nested tuples, and each tuple becomes a semi-join, union or anti-join. Postings
are filtered to the query's words before anything is shuffled.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.functions.text import bound_once, fold, fold_text
from contentlake.shared import saved

COLUMNS = ("title", "body")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Parts of a stored index.
SHELVES = 64
PIECE = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\*?)|([(){}:^,+-])|([^\s"(){}:^,+*-]+)(\*?))')


class QueryError(ValueError):
    """The query isn't an expression of this language."""


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold_text(text))


def postings(archive) -> DataFrame:
    """(entry_id, col, pos, term). The outer explode keeps Spark from running the folding once more in a filter on its size."""
    texts = F.array(F.struct(F.lit("title").alias("col"), F.col("title").alias("text")), F.struct(F.lit("body").alias("col"), F.col("body_text").alias("text")))
    columns = archive.entries.select("entry_id", F.explode(texts).alias("c"))
    return columns.select("entry_id", "c.col", F.posexplode_outer(tokens(F.col("c.text"))).alias("pos", "term")).filter("term IS NOT NULL")


def shelf(term: Column) -> Column:
    """The part of a stored index where a term lies: by its first two characters, so that prefixes are pruned too."""
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(SHELVES)).cast("int")


def write_index(found: DataFrame, path: str) -> DataFrame:
    """Postings (see ``postings``), stored by shelf and sorted by term, and read back."""
    found.withColumn("shelf", shelf(F.col("term"))).repartition("shelf", F.pmod(F.xxhash64("term", "entry_id"), F.lit(4))).sortWithinPartitions("term").write.partitionBy("shelf").parquet(path)
    return found.sparkSession.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in found.schema)}, shelf int").parquet(path)


def updated_index(index: DataFrame, batch, gone: DataFrame | None = None) -> DataFrame:
    """Postings after a batch of new or changed entries (an archive of those) and of removed ones (entry_id): what
    ``postings`` of the whole archive gives."""
    touched = batch.entries.select("entry_id") if gone is None else batch.entries.select("entry_id").unionByName(gone.select("entry_id"))
    return index.select("entry_id", "col", "pos", "term").join(touched, "entry_id", "left_anti").unionByName(postings(batch))


def appended_index(index: DataFrame, batch, path: str, gone: DataFrame | None = None) -> DataFrame:
    """What ``updated_index`` gives, without writing the old postings anew: those of the batch are stored beside them, and old ones of
    changed and removed entries are left out where a query reads its terms."""
    touched = batch.entries.select("entry_id") if gone is None else batch.entries.select("entry_id").unionByName(gone.select("entry_id"))
    return index.join(touched, "entry_id", "left_anti").unionByName(write_index(postings(batch), path))


class _Reader:
    def __init__(self, query: str):
        self.items, at = [], 0
        query = query.rstrip()
        while at < len(query):
            m = PIECE.match(query, at)
            if not m:
                raise QueryError(f"cannot read {query[at:]!r}")
            quoted, star, sign, word, word_star = m.groups()
            if sign:
                self.items.append(("sign", sign))
            elif word in ("AND", "OR", "NOT"):
                self.items.append(("op", word))
            else:
                self.items.append(("text", (word if quoted is None else quoted.replace('""', '"'), bool(star or word_star), quoted is None)))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else (None, None)

    def take(self, sign: str | None = None) -> tuple:
        item = self.peek()
        if item[0] is None or sign and item != ("sign", sign):
            raise QueryError(f"expected {sign or 'more'}")
        self.at += 1
        return item

    def chain(self, op: str, part):
        left = part()
        while self.peek() == ("op", op):
            self.at += 1
            left = (op.lower(), left, part())
        return left

    def either(self):
        return self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.run)))

    def run(self):
        """Parts side by side all have to match."""
        left = self.part()
        while self.peek()[0] == "text" or self.peek() in (("sign", "("), ("sign", "^"), ("sign", "{"), ("sign", "-")):
            left = ("and", left, self.part())
        return left

    def part(self):
        columns = self.columns()
        if columns is not None:
            return ("in", columns, self.part())
        if self.peek() == ("sign", "("):
            self.take("(")
            inner = self.either()
            self.take(")")
            return inner
        kind, value = self.peek()
        if kind == "text" and value[0] == "NEAR" and value[2] and self.peek(1) == ("sign", "("):
            return self.near()
        first = self.peek() == ("sign", "^")
        if first:
            self.take("^")
        return self.phrase(first)

    def columns(self):
        other = self.peek() == ("sign", "-")
        ahead = int(other)
        if self.peek(ahead) == ("sign", "{"):
            self.at += ahead + 1
            names = []
            while self.peek()[0] == "text":
                names.append(self.take()[1][0].lower())
            self.take("}")
        elif self.peek(ahead)[0] == "text" and self.peek(ahead + 1) == ("sign", ":"):
            names = [self.peek(ahead)[1][0].lower()]
            self.at += ahead + 1
        elif other:
            raise QueryError("a column must follow -")
        else:
            return None
        self.take(":")
        if unknown := set(names) - set(COLUMNS):
            raise QueryError(f"no such column: {sorted(unknown)}")
        return [c for c in COLUMNS if (c in names) != other]

    def phrase(self, first: bool):
        kind, value = self.take()
        if kind != "text":
            raise QueryError(f"unexpected {value}")
        words, prefix = words_of(value[0]), value[1]
        while self.peek() == ("sign", "+"):
            self.take("+")
            more = self.take()[1]
            words, prefix = words + words_of(more[0]), more[1]
        if not words:
            raise QueryError("a part without letters or digits")
        return ("phrase", words, prefix, first)

    def near(self):
        self.take()
        self.take("(")
        parts, gap = [], 10
        while self.peek()[0] == "text":
            parts.append(self.phrase(False))
        if self.peek() == ("sign", ","):
            self.take(",")
            gap = int(self.take()[1][0])
        self.take(")")
        return ("near", parts, gap)


def read_query(query: str) -> tuple:
    reader = _Reader(query)
    tree = reader.either()
    if reader.at < len(reader.items):
        raise QueryError(f"unexpected {reader.peek()[1]}")
    return tree


def vocabulary(tree: tuple) -> tuple[set[str], set[str]]:
    """Whole words and prefixes of an expression."""
    if tree[0] == "phrase":
        return (set(tree[1][:-1]), {tree[1][-1]}) if tree[2] else (set(tree[1]), set())
    parts = tree[1] if tree[0] == "near" else tree[2:] if tree[0] == "in" else tree[1:]
    found = [vocabulary(p) for p in parts]
    return set().union(*(f[0] for f in found)), set().union(*(f[1] for f in found))


def _places(tree: tuple, index: DataFrame, columns: list[str]) -> DataFrame:
    """(entry_id, col, pos, last) of each occurrence of a phrase."""
    _, words, prefix, first = tree
    hits = None
    for k, word in enumerate(words):
        last = k == len(words) - 1
        here = index.filter(F.col("col").isin(columns) & (F.startswith("term", F.lit(word)) if prefix and last else F.col("term") == word))
        here = here.select("entry_id", "col", (F.col("pos") - k).alias("pos"))
        hits = here if hits is None else hits.join(here, ["entry_id", "col", "pos"], "left_semi")
    if first:
        hits = hits.filter("pos = 0")
    return hits.withColumn("last", F.col("pos") + len(words) - 1)


def _ids(tree: tuple, index: DataFrame, columns: list[str]) -> DataFrame:
    kind = tree[0]
    if kind == "phrase":
        return _places(tree, index, columns).select("entry_id").distinct()
    if kind == "in":
        return _ids(tree[2], index, [c for c in columns if c in tree[1]])
    if kind == "near":
        parts = [_places(p, index, columns) for p in tree[1]]
        joined = reduce(lambda a, b: a.join(b, ["entry_id", "col"]), (p.select("entry_id", "col", F.col("pos").alias(f"p{k}"), F.col("last").alias(f"l{k}")) for k, p in enumerate(parts)))
        if len(parts) > 1:  # tokens between the end of the first and the start of the last
            starts, ends = (F.greatest(*(F.col(f"p{k}") for k in range(len(parts)))), F.least(*(F.col(f"l{k}") for k in range(len(parts)))))
            joined = joined.filter(starts - ends - 1 <= tree[2])
        return joined.select("entry_id").distinct()
    left, right = (_ids(t, index, columns) for t in tree[1:])
    if kind == "or":
        return left.union(right).distinct()
    return left.join(right, "entry_id", "left_semi" if kind == "and" else "left_anti")


def match(archive, query: str, index: DataFrame | None = None) -> DataFrame:
    """entry_id of the entries that match; with a stored index only its shelves of the query's terms are read. Without
    one, texts are folded once: the postings of the query's terms are kept where several parts read them."""
    tree = read_query(query)
    words, prefixes = vocabulary(tree)
    wanted = F.col("term").isin(sorted(words))
    for p in sorted(prefixes):
        wanted = wanted | F.startswith("term", F.lit(p))
    if index is None:
        found = postings(archive).filter(wanted)
        return _ids(tree, found if len(words) + len(prefixes) == 1 else saved(found, "postings"), list(COLUMNS))
    if all(len(p) > 1 for p in prefixes):  # else the terms may lie anywhere
        spark = index.sparkSession
        starts = sorted(words | prefixes)
        places = spark.range(1).select(F.explode(F.array(*(shelf(F.lit(x)) for x in starts))).alias("s")).distinct().collect()  # a number per word of the query
        index = index.filter(F.col("shelf").isin([r["s"] for r in places]))
    return _ids(tree, index.filter(wanted), list(COLUMNS))


def bm25(archive, words: list[str]) -> DataFrame:
    """(entry_id, rank) of entries that hold any of the words; the lower the rank, the better.

    One pass over the texts gives lengths and matching terms of each entry, which are kept; ``ranking`` answers from a
    stored index instead.
    """
    words = sorted({w for x in words for w in words_of(x)})
    both = F.concat(tokens(F.coalesce("title", F.lit(""))), tokens(F.coalesce("body_text", F.lit(""))))
    lists = archive.entries.select("entry_id", bound_once(both, lambda t: F.struct(F.size(t).alias("length"), F.filter(t, lambda w: w.isin(words)).alias("t"))).alias("x"))
    lists = saved(lists.select("entry_id", "x.length", "x.t"), "words")
    sizes = lists.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = lists.select("entry_id", "length", F.explode("t").alias("term"))
    counts = hits.groupBy("entry_id", "length", "term").agg(F.count("*").alias("tf"))
    held = counts.groupBy("term").agg(F.count("*").alias("df"))
    scored = counts.join(F.broadcast(held), "term").crossJoin(F.broadcast(sizes))  # one row per query word, and one
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy("entry_id").agg((-F.sum(part)).alias("rank"))


def search(archive, words: list[str], limit: int) -> DataFrame:
    """The best entries by rank, ties by id."""
    return bm25(archive, words).orderBy("rank", "entry_id").limit(limit)


def contains(rows: DataFrame, pattern: str, columns: tuple[str, ...] = ("title",)) -> DataFrame:
    """Case-insensitive substring search; blanks around the pattern don't count, an empty one matches all."""
    bare = pattern.strip().lower()
    hit = reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(bare)) for c in columns))
    return rows.filter(hit)


def idf_of(n: int, df: int) -> float:
    """The weight of a word, for checks."""
    return max(LEAST_IDF, math.log((n - df + 0.5) / (df + 0.5)))

"""Removal of repeated passages by suffix arrays: every byte covered by a string of ``WINDOW`` bytes that starts elsewhere too.

A window of 400 bytes has an anchor: the leftmost of its 16-byte grams with the least hash. It depends on the window's bytes alone,
so equal windows have equal anchors at equal distances, and the windows of a text fall into runs of one anchor and one
range of distances. All windows of a run hold its core, the bytes between the last start and the first end that the
range allows; equal windows have equal cores. So:

1. Equal texts become one text with a count. Texts are held once, in a table bucketed by their hash.
2. Each run leaves a row with the hashes of its core and of its whole piece of text. Runs whose core is nowhere else are gone
   after one count per core, added up within tasks first. Runs whose core always comes in one and the same piece are repeats.
3. What is left are cores that come in different pieces. A core's pieces, its bytes as one symbol, are joined to a
   string whose suffixes are sorted by ``suffix_array``; a window is a repeat if its suffix shares a window's length with a neighbour.
4. A core with more than ``most`` different pieces is never sorted at once: one of each of its pieces is halved by distance, so
   that their cores hold more of the context, and the halves go through 2 and 3 again; after seven halvings a run is one
   window, and core and piece are the same. So a task's string is bounded, whatever a passage's number of copies.
5. Repeats are joined to spans per text, and cut.

``suffix_array`` is the linear grouping construction: suffixes are grouped by a prefix that grows to their longest Lyndon
prefix; groups are gone through in descending order, each of them lengthening the prefixes of the suffixes that its members' pointers
to the previous smaller suffix name; then the groups' places are filled in the order of the suffixes that follow those prefixes,
without renaming or recursion.

Cases: a null text is empty; texts shorter than a window keep all bytes; rows with a null or repeated id are rows like others, and
equal rows each have their result (all bytes of a text that occurs twice are repeats); an empty table gives an empty
result. Other columns are ignored. Texts may be of any length: they are gone through in segments.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.llm.common import Scratch, frequent_join, small_batches

WINDOW, GRAM = 400, 16
#: Grams of a window; windows of a run; different pieces of a core that are sorted at once.
GRAMS, RUN, MOST = WINDOW - GRAM + 1, 65, 256
#: Bytes that are hashed at once; rows of a core that one task takes when they are joined.
SEGMENT, FREQUENT = 1 << 21, 10_000
RUNS = "th binary, pos int, far int, near int, lo int, hi int, key long, piece long"


def suffix_array(s: str) -> list[int]:
    """The starts of the suffixes of ``s`` in ascending order; its last character must be less than all others."""
    n, kinds = len(s), sorted(set(s))
    number = {c: k for k, c in enumerate(kinds)}
    group = [number[c] for c in s]
    members: list[list[int]] = [[] for _ in kinds]
    for i, g in enumerate(group):
        members[g].append(i)
    upper, lower = list(range(1, len(kinds) + 1)), list(range(-1, len(kinds) - 1))
    upper[-1] = -1
    done, previous, order = bytearray(n), [-1] * n, []
    at = len(kinds) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        for i in own:
            done[i] = 1
        longer: dict[int, dict[int, list[int]]] = {}  # group -> times that the prefix follows -> members
        last, times = -1, 0
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p == last:
                times += 1
                continue
            if last >= 0:
                longer.setdefault(group[last], {}).setdefault(times, []).append(last)
            last, times = p, 1
        if last >= 0:
            longer.setdefault(group[last], {}).setdefault(times, []).append(last)
        for below, by_times in longer.items():
            for times in sorted(by_times):  # the more often the prefix follows, the higher
                new, above = len(members), upper[below]
                members.append(by_times[times])
                for i in by_times[times]:
                    group[i] = new
                upper.append(above)
                lower.append(below)
                upper[below] = new
                if above >= 0:
                    lower[above] = new
                below = new
        members[at] = own
        order.append(at)
        at = lower[at]
    place, k = [0] * len(members), 0
    for g in reversed(order):
        place[g] = k
        k += len(members[g])
    out, placed = [0] * n, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = group[i]
            out[place[g]] = i
            place[g] += 1
            i = previous[i]
    return out


def anchors(data: np.ndarray) -> np.ndarray:
    """For each start of a window in ``data`` (bytes) the place of its anchor, less the start."""
    count = len(data) - GRAM + 1
    words = np.lib.stride_tricks.sliding_window_view(data, 8).view("<u8").ravel() if len(data) >= 8 else np.zeros(0, np.uint64)
    grams = words[:count] * np.uint64(0x9E3779B97F4A7C15) ^ (words[8 : 8 + count] + np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0x94D049BB133111EB)
    grams &= np.uint64(0xFFFFFFFFFF000000)  # a segment has less than 2^24 bytes: the place breaks ties to the left
    grams |= np.arange(count, dtype=np.uint64)
    # least of GRAMS values from each place on: the least from there to its block's end, and from the next block's start
    padded = np.full(-(-count // GRAMS) * GRAMS, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:count] = grams
    blocks = padded.reshape(-1, GRAMS)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    starts = count - GRAMS + 1
    least = np.minimum(ahead[:starts], behind[GRAMS - 1 : GRAMS - 1 + starts])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64) - np.arange(starts)


def hashed(data, pos: int, far: int, near: int, lo: int, hi: int) -> tuple[int, int]:
    """Of a run: hashes of its core and of its piece. ``far`` and ``near`` are the distances of its first and last start."""
    core = xxhash.xxh3_64_intdigest(data[pos - lo : pos - hi + WINDOW], lo * 512 + hi)
    piece = xxhash.xxh3_64_intdigest(data[pos - far : pos - near + WINDOW], far * 512 + near)
    return core - (1 << 63), piece - (1 << 63)


def runs_of(text: bytes | memoryview) -> Iterator[tuple]:
    """(pos, far, near, lo, hi, key, piece) of each run of a text's windows, in order."""
    view = memoryview(text)
    for base in range(0, len(view) - WINDOW + 1, SEGMENT):
        part = view[base : base + SEGMENT + WINDOW - 1]
        away = anchors(np.frombuffer(part, np.uint8))
        starts = np.arange(len(away))
        kind = (starts + away) * 8 + away // RUN
        first = np.flatnonzero(np.diff(kind, prepend=-1))
        last = np.append(first[1:], len(kind)) - 1
        for i, j, a in zip(first.tolist(), last.tolist(), away[first].tolist(), strict=True):
            pos, lo = i + a, a // RUN * RUN
            hi = min(lo + RUN - 1, GRAMS - 1)
            run = (pos, pos - i, pos - j, lo, hi)
            yield (base + pos, *run[1:], *hashed(part, *run))


def _records(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in text.split(", ")])


def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, text) to rows of RUNS."""

    def rows():
        for batch in batches:
            for th, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                name = th.as_py()
                for run in runs_of(text.as_buffer() or b""):
                    yield (name, *run)

    yield from _records(rows(), _schema(RUNS))


#: A piece as one of a core's different ones: its place in one text, how often it occurs, and the core and piece that it is part of.
PIECES = f"{RUNS}, n long, root long, whole long"
VISITED = f"{PIECES}, halved int, before binary, after binary"


def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, text, wanted pieces) to each piece's bytes beside its core, or to its two halves."""

    def rows():
        for batch in batches:
            for th, text, wanted in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                name, data = th.as_py(), memoryview(text.as_buffer())
                for w in wanted.as_py():
                    pos, far, near, lo, hi, key, piece, n, root, whole, halved = w.values()
                    if not halved:
                        yield name, pos, far, near, lo, hi, key, piece, n, root, whole, 0, bytes(data[pos - far : pos - lo]), bytes(data[pos - hi + WINDOW : pos - near + WINDOW])
                        continue
                    middle = (lo + hi) // 2
                    for a, b in ((lo, middle), (middle + 1, hi)):
                        f, t = min(far, b), max(near, a)
                        if f >= t:
                            yield name, pos, f, t, a, b, *hashed(data, pos, f, t, a, b), n, root, whole, 1, None, None

    yield from _records(rows(), _schema(VISITED))


FOUND = "key long, piece long, from_far int, to_near int"


def repeats(pieces: list[tuple[int, int, int, int, int, bytes, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(piece, far, near): distances between which windows of a piece start elsewhere too. Pieces of one core are (piece,
    number of times that it occurs, far, lo, hi, bytes before the core, bytes after)."""
    length = pieces[0][4] - pieces[0][3] + 1  # symbols of a window: its bytes beside the core, and the core
    strings = ["".join(chr(b + 2) for b in before) + "Ȁ" + "".join(chr(b + 2) for b in after) for *_, before, after in pieces]
    whole = "\1".join(strings) + "\1\0"
    owner = np.full(len(whole), -1)
    place, at = np.zeros(len(whole), np.int64), 0
    for k, x in enumerate(strings):
        n = len(x) - length + 1
        owner[at : at + n] = k
        place[at : at + n] = np.arange(n)
        at += len(x) + 1
    order = [i for i in suffix_array(whole) if owner[i] >= 0]
    hit = np.isin(owner, [k for k, x in enumerate(pieces) if x[1] > 1])
    for i, j in zip(order, order[1:], strict=False):
        if whole[i : i + length] == whole[j : j + length]:
            hit[i] = hit[j] = True
    for k in range(len(pieces)):
        mine = np.flatnonzero(hit & (owner == k))
        if len(mine):
            offsets = place[mine]
            cuts = np.flatnonzero(np.diff(offsets) > 1)
            for i, j in zip([0, *(cuts + 1)], [*cuts, len(offsets) - 1], strict=True):
                yield pieces[k][0], int(pieces[k][2] - offsets[i]), int(pieces[k][2] - offsets[j])


def sort_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, piece, n, far, lo, hi, before, after) that lie together by key, to rows of FOUND."""

    def rows():
        key, held = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[0] != key:
                    if held:
                        yield from ((key, *x) for x in repeats(held))
                    key, held = r[0], []
                held.append(r[1:])
        if held:
            yield from ((key, *x) for x in repeats(held))

    yield from _records(rows(), _schema(FOUND))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, memoryview, list[list[int]]]]:
    """(th, text, copies, starts) to each text's bytes and the spans that go."""
    for batch in batches:
        for th, text, copies, starts in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True):
            data, spans = memoryview(text.as_buffer() or b""), []
            if copies.as_py() > 1 and len(data) >= WINDOW:
                spans = [[0, len(data)]]
            else:
                for a, b in sorted((x["a"], x["b"]) for x in starts.as_py() or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b + WINDOW)
                    else:
                        spans.append([a, b + WINDOW])
            yield th.as_py(), data, spans


def _left(data: memoryview, spans: list[list[int]]) -> Iterator[memoryview]:
    at = 0
    for a, b in [*spans, [len(data), len(data)]]:
        yield data[at:a]
        at = b


CUT = "th binary, spans array<struct<from:long,to:long>>, kept binary"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    schema = pa.schema([("th", pa.binary()), ("spans", spans_type), ("kept", pa.binary())])
    yield from _records(((th, [{"from": a, "to": b} for a, b in spans], b"".join(_left(data, spans))) for th, data, spans in _cut(batches)), schema, 200)


DIGESTED = "th binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for th, data, spans in _cut(batches):
            digest = hashlib.sha256()
            for part in _left(data, spans):
                digest.update(part)
            yield th, len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest()

    yield from _records(rows(), _schema(DIGESTED), 1000)


def _texts(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """(th, text, copies) of each different text, in a table bucketed by ``th``, and the table's name: joins on ``th``
    move no text again. Equal texts meet within tasks before the shuffle."""
    spark = docs.sparkSession
    name = f"contentlake_texts_{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    each = docs.select(F.unhex(F.md5(text)).alias("th"), text.alias("text")).groupBy("th").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    each.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "th").option("path", f"{scratch.base}/texts").option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _recurring(rows: DataFrame, times: Column, scratch: Scratch, name: str, most: int = FREQUENT) -> DataFrame:
    """The rows of cores that occur more than once, by ``times``, with ``same``: in one and the same piece each time. A frequent
    core is counted within tasks first, and its rows are dealt to several tasks."""
    same = (F.min("piece") == F.max("piece")).alias("same")
    keys = scratch.save(rows.groupBy("key").agg(times.alias("n"), same, F.count("*").alias("_rows")).filter("n > 1"), "keys")
    kept = scratch.save(frequent_join(rows, keys.select("key", "same"), "key", most, keys), name)
    scratch.drop(keys)
    return kept


def _sorted_out(texts: DataFrame, pieces: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(root, whole, from_far, to_near): which windows of the given different pieces of cores are repeats."""
    out, tasks = [], int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        each = pieces.groupBy("key", "piece").agg(F.sum("n").alias("n"), F.min(F.struct("th", "pos", "far", "near", "lo", "hi")).alias("r"))
        each = scratch.save(each, "each")
        large = each.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key")
        small = each.join(large, "key", "left_anti").select("r.*", "key", "piece", "n", F.lit(0).cast("long").alias("root"), F.lit(0).cast("long").alias("whole"), F.lit(0).alias("halved"))
        wanted = small.unionByName(pieces.join(large, "key", "left_semi").withColumn("halved", F.lit(1)))
        lists = wanted.groupBy("th").agg(F.collect_list(F.struct(*_columns(PIECES)[1:], "halved")).alias("wanted"))  # one text's
        seen = scratch.save(texts.select("th", "text").join(lists.hint("merge"), "th").mapInArrow(visit, VISITED), "seen")
        together = seen.filter("halved = 0").select("key", "piece", "n", "far", "lo", "hi", "before", "after").repartition(tasks, "key").sortWithinPartitions("key")
        found = scratch.save(together.mapInArrow(sort_cores, FOUND), "found")
        out.append(pieces.select("key", "piece", "root", "whole").join(found, ["key", "piece"]).select("root", "whole", "from_far", "to_near"))
        halves = scratch.save(seen.filter("halved = 1").select(*_columns(PIECES)), "halves")
        scratch.drop(each, seen)
        if not halves.take(1):
            break
        kept = _recurring(halves, F.sum("n"), scratch, "kept")
        scratch.drop(halves)
        out.append(kept.filter("same").select("root", "whole", F.col("far").alias("from_far"), F.col("near").alias("to_near")))
        pieces = kept.filter("NOT same").drop("same")
    return reduce(DataFrame.unionByName, out)


def repeats_of(docs: DataFrame, scratch: Scratch, most: int = MOST) -> tuple[DataFrame, str]:
    """(th, text, copies, starts) of each different text: ``starts`` are ranges (a, b) of starts of windows that start
    elsewhere too, but for texts that occur twice, of which all windows do; and the name of the table of texts."""
    texts, name = _texts(docs, scratch)
    runs = scratch.save(texts.select("th", "text").mapInArrow(cut_runs, RUNS), "runs")
    twice = _recurring(runs, F.count("*"), scratch, "twice")
    scratch.drop(runs)
    mixed = twice.filter("NOT same").drop("same")
    pieces = mixed.groupBy("key", "piece").agg(F.min(F.struct("th", "pos", "far", "near", "lo", "hi")).alias("r"), F.count("*").alias("n"))
    pieces = scratch.save(pieces.select("r.*", "key", "piece", "n", F.col("key").alias("root"), F.col("piece").alias("whole")), "pieces")
    found = scratch.save(_sorted_out(texts, pieces, most, scratch).distinct(), "windows")
    partly = mixed.select("th", "pos", F.col("key").alias("root"), F.col("piece").alias("whole")).join(found, ["root", "whole"])
    marks = twice.filter("same").select("th", (F.col("pos") - F.col("far")).alias("a"), (F.col("pos") - F.col("near")).alias("b"))
    marks = marks.unionByName(partly.select("th", (F.col("pos") - F.col("from_far")).alias("a"), (F.col("pos") - F.col("to_near")).alias("b")))
    starts = marks.groupBy("th").agg(F.collect_list(F.struct("a", "b")).alias("starts"))  # one text's
    return texts.join(starts.hint("merge"), "th", "left").select("th", "text", "copies", "starts"), name


def _rows(docs: DataFrame, finish, schema: str, most: int) -> DataFrame:
    """``finish`` of each different text, for each row."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    found, name = repeats_of(docs, scratch, most)
    kept = scratch.save(found.mapInArrow(finish, schema), "result")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    scratch.clear(kept)
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("th"))
    return rows.join(kept, "th").drop("th")


def without_repeats(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, spans, kept) of each row of (doc_id, text): the removed spans (from, to) and the bytes that stay."""
    return _rows(docs, cut, CUT, most)


def digests(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of (doc_id, text)."""
    return _rows(docs, digested, DIGESTED, most)

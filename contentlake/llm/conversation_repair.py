"""Repair of the turns of conversations at the least cost, by a grammar that conversations share.

A conversation's rows, in order, are a string of symbols: the row's role initial and what is wrong with it. Four states say what
may come next (nothing yet, after s, after u, after a). A symbol is a matrix over states: the least cost of going
from one to another past that row, with edits as an audit rope. Matrices multiply in (min, +); of equal costs the ASCII-least
audit counts. That order is kept by products: of two cheapest audits between the same states over the same rows none is a prefix of
the other, since what the longer one has more would be inserts, which cost.

1. Rows are put in order by ranges of (conversation, turn), so that a conversation of very many rows lies in many tasks; each task
   turns its part of a conversation into a string of symbols and counts faults.
2. Equal strings become one. Re-Pair runs over them in rounds: pairs of symbols are counted, weighted, in tasks; the
   most frequent that share no symbol become rules; strings are rewritten. Rules are at most ``ROUNDS * RULES``, and strings that no
   rule shortens are evaluated as they are, so the bound costs time and no result.
3. Each rule's matrix is the product of its two parts' matrices, bottom-up, its ropes made of theirs. Tasks get all matrices and
   multiply those of each string's remaining symbols, as a balanced tree.
4. Costs and audits go back to the conversations; audits are replayed on the rows, in one stream per conversation.

Faults: a row is blank (no character but white space), else a duplicate (same role and text earlier), else truncated (the last
character that isn't white space is none of ``.!?``). Cases: null roles and texts count as one blank; rows are ordered by turn (null first), role, text;
conversations are told apart by id, null being one; a role's initial is its first character, and roles with others than s, u
and a can't be kept; rows that are equal in all are copies, of which all but the first are duplicates; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.llm.common import Scratch, small_batches

#: Rounds of pairing, and rules that a round adds at most.
ROUNDS, RULES = 6, 32
SPACE = r"\x20\x09-\x0D"
#: States, and where an inserted or re-roled turn leads from each: a user's turn, or an assistant's after a user's.
STATES, END = range(4), (0, 3)
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
#: Symbols of rows: an initial (x: another one) that is right, the same truncated, and rows that must go.
GOOD, CUT, GONE = "suax", "SUAX", "d"
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1

Rope = str | tuple
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def flat(rope: Rope) -> str:
    """The text of a rope: a string, or two ropes after one another."""
    out, left = [], [rope]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            left += (x[1], x[0])
    return "".join(out)


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope]) -> tuple[int, Rope]:
    if a is None or b[0] < a[0]:
        return b
    return a if a[0] < b[0] or flat(a[1]) <= flat(b[1]) else b


def times(left: Matrix, right: Matrix) -> Matrix:
    """What the rows of ``left`` and then those of ``right`` cost."""
    out: Matrix = {}
    for (p, m), (cost, rope) in left.items():
        for q in STATES:
            if (more := right.get((m, q))) is not None:
                out[p, q] = better(out.get((p, q)), (cost + more[0], (rope, more[1])))
    return out


def inserts() -> Matrix:
    """Any number of inserted turns: at most two are ever worth it."""
    out: Matrix = {(p, p): (0, "") for p in STATES}
    for p in STATES:
        q, n = p, 0
        while (q := NEXT[q]) != p and (p, q) not in out:
            n += 1
            out[p, q] = (INSERT * n, "I" * n)
    return out


def of_row(symbol: str) -> Matrix:
    """A row, after any inserts before it."""
    own: Matrix = {(p, p): (DELETE, "D") for p in STATES}
    if symbol != GONE:
        extra, initial = TRUNCATED * (symbol in CUT), symbol.lower()
        for p in STATES:
            q = NEXT[p]
            own[p, q] = better(own.get((p, q)), (REROLE + extra, "R"))
            if initial == ROLE[q][0]:
                own[p, q] = better(own[p, q], (extra, "K"))
        if initial == "s":
            own[0, 1] = (extra, "K")
    return times(inserts(), own)


def product(matrices: list[Matrix]) -> Matrix:
    """As a balanced tree, so that an audit's characters are compared a logarithm of times."""
    while len(matrices) > 1:
        matrices = [times(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0] if matrices else {(p, p): (0, "") for p in STATES}


def cheapest(matrices: list[Matrix]) -> tuple[int, str]:
    """Cost and audit of a conversation with these rows or rules, from nothing to an end."""
    whole, best = times(product(matrices), inserts()), None
    for q in END:
        if (0, q) in whole:
            best = better(best, whole[0, q])
    return best[0], flat(best[1])


def pair_counts(symbols: str) -> Counter:
    """Pairs of neighbours; a run of one symbol has half as many of its pair as neighbours."""
    found: Counter = Counter()
    for m in re.finditer(r"(.)\1*", symbols, re.S):
        if (n := (m.end() - m.start()) // 2) > 0:
            found[m[1] * 2] += n
        if m.end() < len(symbols):
            found[m[1] + symbols[m.end()]] += 1
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for symbols, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for pair, times_ in pair_counts(symbols).items():
                total[pair] += n * times_
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])


def grammar(strings: DataFrame) -> list[tuple[str, str]]:
    """Rules (symbol, pair), in the order of their making, of all strings (symbols, n). Rewriting is repeated from the strings
    themselves, which a round's map does in passing; what a round brings to the driver is a count for each pair of symbols
    at most, and symbols are bounded."""
    rules: list[tuple[str, str]] = []
    for _ in range(ROUNDS):
        rewritten = strings.select(rewrite(F.col("symbols"), rules).alias("symbols"), "n")
        counts = rewritten.mapInArrow(_counted, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(RULES * 8).collect()
        used: set[str] = set()
        most = len(rules) + RULES
        for r in counts:
            if not used & set(r["pair"]) and len(rules) < most:
                used |= set(r["pair"])
                rules.append((chr(0x4E00 + len(rules)), r["pair"]))
        if not used:
            break
    return rules


def rewrite(symbols: Column, rules: list[tuple[str, str]]) -> Column:
    for symbol, pair in rules:
        symbols = F.replace(symbols, F.lit(pair), F.lit(symbol))
    return symbols


def evaluated(strings: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(symbols, cost, audit) of each string."""
    matrices = {c: of_row(c) for c in GOOD + CUT + GONE}
    for symbol, pair in rules:  # bottom-up: a rule's parts were made before it
        matrices[symbol] = times(matrices[pair[0]], matrices[pair[1]])
    sent = strings.sparkSession.sparkContext.broadcast(matrices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            done = [cheapest([known[c] for c in short]) for short in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in done], pa.int64()), pa.array([a for _, a in done], pa.string())], ["symbols", "cost", "audit"])

    return strings.select("symbols", rewrite(F.col("symbols"), rules).alias("short")).mapInArrow(run, "symbols string, cost long, audit string")


PARTS = "conv_id long, part long, symbols string, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, starts string, ends string"
KINDS = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in PARTS.split(", ")])


def as_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows (conv_id, part, turn, role, digest, is_first, blank, cut) to a row for each conversation in the task."""

    def one(rows: list[tuple], conv, part) -> tuple:
        symbols, before, count, turns, illegal = [], None, Counter(), 0, 0
        for turn, role, digest, is_first, blank, cut in rows:
            fault = "blank" if blank else "duplicate" if not is_first or before == (turn, role, digest) else "truncated" if cut else ""
            count[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols.append(GONE if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
            illegal += before is not None and before[1][:1] + role[:1] not in ("su", "ua", "au")
            turns += turn is not None and (before is None or before[0] != turn)
            before = (turn, role, digest)
        known = [r[0] for r in rows if r[0] is not None]
        return conv, part, "".join(symbols), min(known, default=None), max(known, default=None), turns, count["blank"], count["duplicate"], count["truncated"], illegal, rows[0][1][:1], rows[-1][1][:1]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), KINDS, strict=True)], schema=KINDS)

    key, rows, found = None, [], []
    for batch in batches:
        for conv, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv, part) != key:
                if rows:
                    found.append(one(rows, *key))
                key, rows = (conv, part), []
            rows.append(tuple(row))
        if len(found) > 5000:
            yield batch_of(found)
            found = []
    if rows:
        found.append(one(rows, *key))
    if found:
        yield batch_of(found)


def whole(parts: DataFrame) -> DataFrame:
    """A row for each conversation from its parts, of which there are no more than tasks."""
    p = F.sort_array(F.collect_list(F.struct("part", "symbols", "first_turn", "last_turn", "starts", "ends")))
    rows = parts.groupBy("conv_id").agg(p.alias("p"), *(F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")), F.min("first_turn").alias("low"), F.max("last_turn").alias("high"))
    seams = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.struct(F.get("p", k - 1).alias("a"), F.get("p", k).alias("b")))
    seams = F.when(F.size("p") > 1, seams).otherwise(F.array().cast("array<struct<a:struct<part:bigint,symbols:string,first_turn:bigint,last_turn:bigint,starts:string,ends:string>,b:struct<part:bigint,symbols:string,first_turn:bigint,last_turn:bigint,starts:string,ends:string>>>"))
    same = F.size(F.filter(seams, lambda s: s["a"]["last_turn"] == s["b"]["first_turn"]))
    wrong = F.size(F.filter(seams, lambda s: ~F.concat(s["a"]["ends"], s["b"]["starts"]).isin("su", "ua", "au")))
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - (F.col("turns") - same)).cast("long")
    return rows.select("conv_id", F.array_join("p.symbols", "").alias("symbols"), gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + wrong).alias("illegal"))


def clean(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as the operator takes them: longs, and nulls as one blank."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def audits(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``clean`` rows."""
    small_batches(rows.sparkSession)
    end = F.right(F.regexp_replace("text", f"[{SPACE}]+$", ""), F.lit(1))
    known = rows.select("conv_id", "turn", "role", F.substring("text", 1, 32).alias("head"), "text", F.unhex(F.md5("text")).alias("digest"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    # the first row of each role and text, which is the one of the least turn; copies in that turn are neighbours
    turn = F.coalesce("turn", F.lit(-(1 << 63)))
    least = known.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("least")).toDF("own_id", "own_role", "own_digest", "least")
    same = F.col("conv_id").eqNullSafe(F.col("own_id")) & (F.col("role") == F.col("own_role")) & (F.col("digest") == F.col("own_digest"))
    first = known.join(least, same).withColumn("is_first", turn == F.col("least"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    dealt = first.repartitionByRange(*order, "head").sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id().cast("long"))
    parts = scratch.save(dealt.select("conv_id", "part", "turn", "role", "digest", "is_first", "blank", "cut").mapInArrow(as_symbols, PARTS), "parts")
    conversations = scratch.save(whole(parts), "conversations")
    strings = scratch.save(conversations.groupBy("symbols").agg(F.count("*").alias("n")), "strings")
    costs = scratch.save(evaluated(strings, grammar(strings)), "costs")
    return conversations.join(costs, "symbols").drop("symbols")


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Ordered rows (conv_id, kind, audit, role, text), a conversation's audit (kind 0) before its rows, to (conv_id, turns)
    with an iterator of repaired (role, text); to be read before the next is asked for."""

    def every():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    rows = every()
    ahead = [next(rows, None)]

    def turns(conv, audit: str):
        state, at = 0, 0
        while at < len(audit) or ahead[0] is not None and ahead[0][:2] == (conv, 1):
            letter = audit[at]
            at += 1
            if letter == "I":
                state = NEXT[state]
                yield ROLE[state], ""
                continue
            _, _, _, role, text = ahead[0]
            ahead[0] = next(rows, None)
            if letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                yield role, text
            elif letter == "R":
                state = NEXT[state]
                yield ROLE[state], text

    while ahead[0] is not None:
        conv, _, audit, _, _ = ahead[0]
        ahead[0] = next(rows, None)
        yield conv, turns(conv, audit)


def _replay(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows behind their conversation's audit, by conversation: the only step that takes a conversation as one stream, because
    its turns depend on the edits before them. Nothing is held but the audit."""
    heads = found.select("conv_id", F.lit(0).alias("kind"), "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = heads.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "kind", "audit", "role", "text")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of repaired conversations."""
    rows = clean(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turns in replayed(batches):
            for k, (role, text) in enumerate(turns):
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([k], pa.int64()), pa.array([role]), pa.array([text])], ["conv_id", "place", "role", "text"])

    return _replay(rows, audits(rows, Scratch(rows.sparkSession))).mapInArrow(run, "conv_id long, place long, role string, text string")


def reports(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
    rows = clean(rows)
    scratch = Scratch(rows.sparkSession)
    found = scratch.save(audits(rows, scratch), "found")
    scratch.clear(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for conv, turns in replayed(batches):
            digest = hashlib.sha256()
            for k, (role, text) in enumerate(turns):
                digest.update(("\n" * (k > 0) + f"{role}:{text}").encode())
            held.append((conv, digest.hexdigest()))
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["own_id", "repaired_sha256"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), pa.array([d for _, d in held])], ["own_id", "repaired_sha256"])

    digests = _replay(rows, found).mapInArrow(run, "own_id long, repaired_sha256 string")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("own_id"))).drop("own_id")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as a crc32 of ``conv_id:turn`` modulo 20 damages them: 0 is gone, 1 has no text, 2 none of ``.!?``, 3 is there twice,
    4 is a user's."""
    rows = clean(rows)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(twice).alias("copy")).drop("copy")


def damaged_and_reported(rows: DataFrame) -> DataFrame:
    """The reports of damaged rows, for every conversation there was."""
    found = reports(damaged(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("own")).distinct()
    none = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    none |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    return every.join(found, F.col("own").eqNullSafe(F.col("conv_id")), "left").select(F.col("own").alias("conv_id"), *(c.alias(n) for n, c in none.items()))

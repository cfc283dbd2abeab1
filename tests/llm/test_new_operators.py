"""Suffix arrays, repair of conversations and reversed search against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from contentlake.llm import conversation_repair as repair
from contentlake.llm import queries, reversed_search, suffix_dedup
from tests.oracle import connection, rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_suffix_dedup", "op13_ranked_search"])
def test_sql(spark, name):
    found = queries.queries()[name](spark, SMALL).toPandas()
    assert rows(found) == rows(connection(SMALL).execute(queries.oracle_sql()[name]).fetchdf())


def test_suffix_array():
    r = random.Random(1)
    texts = ["", "a" * 60, "ab" * 40, "mississippi", "abcabcab" * 9]
    texts += ["".join(r.choices("abcdefgh"[: r.randint(1, 6)], k=r.randint(0, 60))) for _ in range(600)]
    for text in texts:
        s = text + "\0"
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_an_anchor_is_the_window_s_own():
    r = random.Random(2)
    data = bytes(r.choices(b"ab ", k=3000))
    window = data[1000:1400]
    import numpy as np

    for around in (b"", b"x" * 700, bytes(r.choices(b"ab ", k=999))):
        away = suffix_dedup.anchors(np.frombuffer(around + window + around, np.uint8))
        assert away[len(around)] == suffix_dedup.anchors(np.frombuffer(window, np.uint8))[0]


def removed(texts: list) -> list:
    seen, data = {}, [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - 399):
            seen[d[i : i + 400]] = seen.get(d[i : i + 400], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        out.append((len(d), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyzéß", k=r.randint(1, 9))) for _ in range(n))


def repeated_texts() -> list:
    r = random.Random(4)
    base, passage, exact = words(r, 600), words(r, 90), words(r, 200)[:400]
    out = [None, "", "short", "x" * 399, "x" * 400, "x" * 401, "y" * 3000, "ab" * 900, base, base, words(r, 300)]
    for _ in range(25):  # near copies: some words of one text changed
        w = base.split(" ")
        for k in r.sample(range(len(w)), 3):
            w[k] = words(r, 1)
        out.append(" ".join(w))
    out += [words(r, 20) + " " + passage + " " + words(r, 20) for _ in range(12)]
    out += [words(r, 30) + exact + words(r, 30) for _ in range(8)] + [exact[:399] + "!", exact[1:] + "?"]
    half = words(r, 60)
    return [*out, half + half]


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 3])
def test_repeats_equal_brute_force(spark, most):
    texts = repeated_texts()
    docs = spark.createDataFrame([(k // 2 if k % 5 else None, t, "th", 1) for k, t in enumerate(texts)], "doc_id long, text string, th string, key int")
    found = sorted(map(tuple, suffix_dedup.digests(docs, most).collect()), key=repr)
    assert found == sorted(((k // 2 if k % 5 else None, *x) for k, x in enumerate(removed(texts))), key=repr)


def test_repeats_in_long_texts_and_segments(monkeypatch):
    r = random.Random(5)
    text = words(r, 4000).encode()
    whole = list(suffix_dedup.runs_of(text))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 5000)
    parts = list(suffix_dedup.runs_of(text))
    starts = lambda runs: [s for pos, far, near, *_ in runs for s in range(pos - far, pos - near + 1)]
    assert starts(whole) == starts(parts) == list(range(len(text) - 399))


def test_a_hot_core_is_halved(spark):
    """A passage in very many contexts: no task sorts more pieces of a core than allowed."""
    r = random.Random(6)
    passage = words(r, 80)[:410]
    texts = [words(r, 25) + passage + words(r, 25) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(docs, 16).collect()}
    assert [found[k] for k in range(300)] == removed(texts)


def test_no_task_gets_all_rows_of_a_frequent_core(spark):
    """Rows of one core are joined in several tasks; before, all of them met in one."""
    from pyspark.sql import functions as F

    from contentlake.llm.common import Scratch

    rows = spark.range(6000).selectExpr("if(id < 4000, 7, 1000 + id div 2) AS key", "if(id < 4000, id % 3, id div 2) AS piece", "id AS pos").unionByName(spark.sql("SELECT 5L AS key, 1L AS piece, -1L AS pos"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as on large tables
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        kept = suffix_dedup._recurring(rows, F.count("*"), Scratch(spark), "kept", 500)
        tasks = kept.filter("key = 7").groupBy(F.input_file_name()).count().collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sum(t["count"] for t in tasks) == 4000 and max(t["count"] for t in tasks) < 3000
    assert sorted((r["pos"], r["key"], r["same"]) for r in kept.collect()) == [(k, 7 if k < 4000 else 1000 + k // 2, k >= 4000) for k in range(6000)]


def test_what_is_kept(spark):
    r = random.Random(7)
    passage = words(r, 80)
    docs = spark.createDataFrame([(1, "one " + passage + " two"), (2, passage), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert bytes(found[1]["kept"]) == b"one  two" and found[1]["spans"][0].asDict() == {"from": 4, "to": 4 + len(passage.encode())}
    assert bytes(found[2]["kept"]) == b"" == bytes(found[3]["kept"]) and found[3]["spans"] == []


def test_no_documents(spark):
    assert suffix_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- conversations


def fault_of(text, seen):
    bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
    return "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else ""


def brute_repair(conv: list[tuple]) -> tuple:
    """Rows (turn, role, text) in order: all by the cheapest path over (row, state), ties by the audit."""
    before, faults = set(), []
    for _, role, text in conv:
        faults.append(fault_of(text, (role, text) in before))
        before.add((role, text))
    step = {0: [("u", 2), ("s", 1)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, k, state, turns = heapq.heappop(heap)
        if k == len(conv) and state in (0, 3):
            break
        if (k, state) in done:
            continue
        done.add((k, state))
        for initial, to in step[state]:
            name = {"u": "user", "a": "assistant"}.get(initial)
            if name:
                heapq.heappush(heap, (cost + 2, audit + "I", k, to, (*turns, f"{name}:")))
            if k < len(conv) and faults[k] in ("", "truncated"):
                _, role, text = conv[k]
                if role[:1] == initial:
                    heapq.heappush(heap, (cost + (faults[k] != ""), audit + "K", k + 1, to, (*turns, f"{role}:{text}")))
                if name:
                    heapq.heappush(heap, (cost + 2 + (faults[k] != ""), audit + "R", k + 1, to, (*turns, f"{name}:{text}")))
        if k < len(conv):
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state, turns))
    known = {t for t, _, _ in conv if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(conv, conv[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def damage(conv_id, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def expected(rows_: list[tuple]) -> list[tuple]:
    convs: dict = {}
    for conv_id, turn, role, text in rows_:
        convs.setdefault(conv_id, []).extend(damage(conv_id, turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return sorted(((k, *brute_repair(sorted(v, key=order))) for k, v in convs.items()), key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversations_of_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    found = sorted((tuple(r[c] for c in COLUMNS) for r in queries.queries()["op12_conversation_repair"](spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert found == expected([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def odd_conversations() -> list[tuple]:
    r = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "ursula", "User"], ["Hi.", "what", "  ", "", None, "Well!\n", "so?", "é", "x.y"]
    out = [(None, None, None, None), (None, 3, "user", "a."), (1, None, "user", "a."), (1, None, "user", "a."), (2, 5, "system", "s.")]
    for conv in range(10, 150):
        out += [(conv, r.choice([k, k + 2, None, 1]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"t{k}.") for k in range(r.randint(1, 12))]
    out += [(500, k, "ua"[k % 2] if k % 7 else "tool", f"text {k % 40}" + "." * (k % 3)) for k in range(3000)]
    return out + out[7:20]


def test_odd_conversations(spark):
    data = odd_conversations()
    table = spark.createDataFrame([(*x, "k", 1) for x in data], "conv_id long, turn long, role string, text string, symbols string, part int").repartition(3)
    found = sorted((tuple(r[c] for c in COLUMNS) for r in repair.damaged_and_reported(table).collect()), key=repr)
    want = expected(data)
    assert [x for x, y in zip(found, want, strict=True) if x != y] == []


def test_repaired_turns_and_no_conversations(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "a."), (1, 1, "assistant", "b."), (1, 2, "user", "")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repaired(table).orderBy("place").collect()] == [(1, 0, "user", "a."), (1, 1, "assistant", "b.")]
    assert repair.damaged_and_reported(table.limit(0)).collect() == []


def test_products_keep_the_least_audit():
    r = random.Random(9)
    for _ in range(200):
        symbols = r.choices(repair.GOOD + repair.CUT + repair.GONE, k=r.randint(0, 9))
        each = [repair.of_row(c) for c in symbols]
        cut = r.randint(0, len(each))
        assert repair.cheapest(each) == repair.cheapest([repair.product(each[:cut]), repair.product(each[cut:])])


# --- changes to earlier operators


@pytest.mark.parametrize("scale", [1e6, 1.2e7])
def test_topk_of_large_vectors_is_exact(spark, scale):
    import pandas as pd

    r = random.Random(11)
    vectors = [(k, [r.uniform(-1, 1) * (scale if k % 3 == 0 else 1) for _ in range(8)]) for k in range(60)] + [(20, [scale] * 8), (61, [scale / 2] * 8)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    from contentlake.llm import topk_segments
    from pyspark.sql import functions as F

    con = connection(SMALL)
    table = pd.DataFrame(vectors, columns=["vec_id", "embedding"])
    con.register("large", table)
    want = con.execute(queries.OP10_SQL.replace("FROM embeddings", "FROM large")).fetchdf()
    found = topk_segments.topk(frame, F.col("vec_id") % 20 == 0).toPandas()
    pick = lambda t: sorted(zip(t["query_id"], t["rank"], t["score"], strict=True))
    assert [x[2] for x in pick(found)] == [x[2] for x in pick(want)]


def test_a_shingle_of_all_documents_and_a_large_leader(spark, monkeypatch):
    import numpy as np

    from contentlake.llm import common, ngram_jaccard

    sets = [np.sort(np.array([7, 100 + k, 200 + k % 3], np.uint64)) for k in range(500)]
    names = np.arange(500, dtype=np.int64)
    of_seven = lambda deals: sum((np.frombuffer(key, np.uint64) == 7).sum() for b in ngram_jaccard.packed(sets, names, 4, deals) for n, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if n >= 0)
    assert of_seven(None) == 2 and of_seven(3) == 0
    rows_ = spark.range(20_000).selectExpr("0L as lead", "id as cls").union(spark.createDataFrame([(1, 5)], "lead long, cls long"))
    other = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "lead long, s string")
    joined = common.frequent_join(rows_, other, "lead", 100)
    assert joined.count() == 20_001 and joined.columns == ["lead", "cls", "s"] and joined.filter("s = 'y'").count() == 1
    plan = joined._jdf.queryExecution().toString()
    assert "hashpartitioning(lead" in plan and "_part" in plan
    r = random.Random(12)
    licence = "one line that every text ends with here"
    texts = [f"{words(r, 12)} {licence}" for _ in range(150)]
    base = words(r, 40)
    texts += [base + " " + licence, base + " x " + licence, base]
    monkeypatch.setattr(ngram_jaccard, "COMMON", 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_jaccard.near_copies(docs).collect())
    con = connection(SMALL)
    import pandas as pd

    con.register("few", pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"]))
    assert found == sorted(con.execute("SELECT doc_id, n_shingles, component_id FROM (" + queries.OP2_SQL.replace("FROM documents", "FROM few") + ") x").fetchall())


# --- search


def brute_search(items, docs, k=20):
    import math

    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    lists = [(d, term(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in lists), sum(len(w) for _, w in lists)
    out = []
    for item, text in items:
        scores = []
        for d, w in lists:
            score = 0
            for t in term(text):
                if tf := w.count(t):
                    df = sum(t in x for _, x in lists)
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += weight * (1000000000 * tf // (1000 * tf + 12 * (100 - 25 + 25 * len(w) * n_docs // total)))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, rank + 1, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("entries", [reversed_search.ENTRIES, 40])
def test_search_equals_brute_force(spark, entries):
    r = random.Random(10)
    vocabulary = ["alpha", "Beta", "gamma", "élan", "ß", "x1", "7", "delta"] + [f"w{k}" for k in range(30)]
    text = lambda n: r.choice([" ", ", ", "-", "\n"]).join(r.choices(vocabulary, k=n))
    docs = [(k if k % 9 else None, text(r.randint(1, 30))) for k in range(80)] + [(90, None), (91, ""), (92, "..."), (93, "same text"), (94, "same text"), (94, "same text")]
    items = [(k, text(r.randint(1, 12))) for k in range(12)] + [(20, None), (21, "absent"), (22, ""), (23, "SAME same text")]
    found = reversed_search.ranked(spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n int"), spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(5), entries=entries)
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_search(items, docs)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert reversed_search.ranked(items, docs).collect() == [] == reversed_search.ranked(items.limit(0), spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()


def test_passages_of_the_window_go_and_shorter_ones_stay(spark):
    """A passage of over 50 words may be shorter than the 400 bytes that the contract names; then it stays."""
    words = [f"w{k:06d}" for k in range(4000)]  # eight bytes with the blank
    own = lambda k: " ".join(words[k : k + 60])
    short, long = " ".join(f"s{k:04d}" for k in range(60)), " ".join(f"long{k:05d}" for k in range(60))  # 359 and 599 bytes
    rows = [(k, f"{own(k * 100)} {short if k % 2 else long} {own(k * 100 + 2000)}") for k in range(8)]
    got = {r["doc_id"]: r for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(short) < suffix_dedup.WINDOW <= len(long)
    assert all((got[k]["n_removed"], got[k]["n_spans"]) == (0, 0) for k in (1, 3, 5, 7))
    assert all(len(long) <= got[k]["n_removed"] < len(long) + 20 and got[k]["n_spans"] == 1 for k in (0, 2, 4, 6))


def test_a_rare_label_fills_half_of_the_sample(spark):
    from contentlake.llm.common import labelled_sample

    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labelled = spark.range(1000).selectExpr("id AS doc_id", "cast(id % 20 = 0 AS int) AS toxic").union(spark.sql("SELECT 20L, 0"))  # of two labels the larger counts
    found = labelled_sample(docs, labelled, "toxic", 60, "toxic", halves=True)
    assert len(found) == len(set(found)) == 60 and sum(y for _, y in found) == 30
    assert len(labelled_sample(docs, labelled, "toxic", 400, "toxic", halves=True)) == 400

"""Scores and verdicts against plain loops, and the pipeline on odd rows."""

import itertools
import math
import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from contentlake.llm import compression_bands, language_ftrl, quality_cnn, toxicity_fm

WORDS = [a + b for a in "bcdfgklmnp" for b in ("anow", "eri", "ilo", "utasse", "oma", "isu")]


def some_texts(seed, n=60):
    r = random.Random(seed)
    return ["", "é ü", "ONE one one", *(" ".join(r.choices(WORDS, k=r.randrange(1, 25))) for _ in range(n))]


def test_machine_sums_over_every_pair():
    r = random.Random(2)
    rows = [(" ".join(r.choices(WORDS, k=12)) + (" vermin zebra" if k % 3 == 0 else " zebra" if k % 3 == 1 else ""), int(k % 3 == 0)) for k in range(300)]
    machine = toxicity_fm.train(rows)
    assert len(machine.linear) > 10 and (machine.factors**2).sum() > 0
    for text in some_texts(3) + [t for t, _ in rows[:30]]:
        live = sorted({machine.index[b] for b in toxicity_fm.terms_of(text).tolist() if b in machine.index})
        z = machine.bias + sum(machine.linear[i] for i in live)
        z += sum(float(machine.factors[i] @ machine.factors[j]) for i, j in itertools.combinations(live, 2))
        assert abs(machine.score(text) - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_network_by_loops():
    q = quality_cnn
    net = q.Network.fresh(3)
    r = np.random.default_rng(0)
    net.weights["out"] = r.standard_normal(2 * q.HIDDEN).astype(np.float32)
    net.weights["filter_bias"] = r.standard_normal(q.FILTERS).astype(np.float32) * 0.1
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    texts = [b"", b"short", bytes(r.integers(32, 120, q.CHUNK + 1).astype(np.uint8)), bytes(r.integers(32, 120, 3 * q.CHUNK).astype(np.uint8))]
    for text, got in zip(texts, net.forward(texts)["p"], strict=True):
        hidden, at = [], 0
        while True:
            part = text[at : at + q.CHUNK]
            padded = part + bytes(q.CHUNK - len(part))
            best = np.full(q.FILTERS, -np.inf)
            for place in range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE):
                seen = np.concatenate([w["embed"][b] for b in padded[place : place + q.WIDTH]])
                best = np.maximum(best, seen @ w["filters"])
            inputs = [*np.maximum(best + w["filter_bias"], 0), len(part) / q.CHUNK]
            hidden.append(np.tanh(np.array(inputs) @ w["hidden"] + w["hidden_bias"]))
            if at + q.CHUNK >= len(text):
                break
            at += q.STEP
        z = np.concatenate([np.max(hidden, 0), np.mean(hidden, 0)]) @ w["out"] + w["out_bias"][0]
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-4


def test_language_by_single_windows():
    rows = [("der die das und nicht ist", "de"), ("the and of with that is", "en"), ("el la que los con una", "es")] * 8
    model = language_ftrl.train(rows)

    def bucket(window):
        x = 0
        c = [ord(k) for k in window]
        x = (c[0] * 0x9E3779B1 + c[1] * 0x85EBCA6B) & 0xFFFFFFFF
        if len(c) == 3:
            x = (x * 0xC2B2AE35 + c[2] * 0x27D4EB2F) & 0xFFFFFFFF
        x ^= x >> 15
        return ((x * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - language_ftrl.BITS)

    for text in ["und das ist", "With the", "que Une", "ß", "日本語"]:
        framed = f" {text.lower()} "
        grams = [framed[k : k + n] for n in (2, 3) for k in range(len(framed) - n + 1)]
        z = np.array([sum(float(model.weights[bucket(g), j]) for g in grams) / len(grams) + model.bias[j] for j in range(3)]) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        name, score = model.predict(text)
        assert name == model.names[int(p.argmax())] and abs(score - p.max()) < 1e-6


def test_bands_by_hand():
    r = random.Random(7)
    for size in (0, 10, 255, 256, 600, 1024, 2047, 2048, 4095, 5000, 9000, 20_000):
        for kind in ("words", "same", "noise"):
            text = {"words": lambda: " ".join(r.choices(WORDS, k=size // 5)), "same": lambda: "again and again " * (size // 16), "noise": lambda: "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(size // 3))}[kind]()
            data = text.encode()
            z = lambda d: len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(d)) / len(d)
            whole = z(data) if data else 1.0
            full = len(data) // 2048
            parts = [data[2048 * k : 2048 * (k + 1) if k < full - 1 else len(data)] for k in range(full)]
            bad = sum(not (0.20 if len(p) >= 3072 else 0.22) <= z(p) <= (0.57 if len(p) >= 3072 else 0.59) for p in parts) / len(parts) if parts else 0.0
            band = [b for b in compression_bands.BANDS if b.least <= len(data)][-1]
            fine = band.low <= whole <= band.high and bad <= compression_bands.BAD_SHARE
            got = compression_bands.judge(text, zstandard.ZstdCompressor(level=3, write_content_size=False))
            assert abs(got[6] - whole) < 1e-12 and abs(got[7] - bad) < 1e-12 and got[8] == (not got[5] and fine)


def test_bands_on_repeated_rows_ties_and_clashing_columns(spark):
    texts = ["a b c " * 40, "a b c " * 40, None, "", "漢字 " * 60]
    docs = spark.createDataFrame([(1, t, True, "r", 0.5) for t in texts], "doc_id long, text string, kept boolean, ratio string, j double")
    got = [tuple(r["v"]) for r in docs.select("kept", compression_bands.judge_column().alias("v")).collect()]
    assert got[0] == got[1] and len(got) == 5 and got[2] == got[3] and not got[2][-1]


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing columns, and a table without rows."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clash = {c: "x" for c in ("score", "cls", "n", "lead", "kept", "piece", "length", "h")}
    rows = docs.withColumns({k: F.lit(v) for k, v in clash.items()})
    first = rows.orderBy("doc_id").limit(20)
    odd = first.withColumn("text", F.lit(None).cast("string")).unionByName(first.withColumn("text", F.lit(""))).unionByName(first.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    rows.unionByName(first).unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(got) and (got.groupby("sequence_id")["length"].sum() <= 4096).all()
    plain = corpus_pipeline.run(spark, small).toPandas()
    assert not got["doc_id"].isna().any() and not got.duplicated(["doc_id", "piece"]).any()
    assert len(set(plain["doc_id"]) & set(got["doc_id"])) >= 0.9 * plain["doc_id"].nunique()
    empty = tmp_path / "empty"
    rows.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Two- and three-character windows of the lower-cased text are hashed into buckets; a bucket's value is its share of
all windows times its inverse document frequency in the training sample. Follow-the-regularised-leader with an
elastic-net penalty fits one sparse weight vector per language; one temperature, fitted on a part of the sample
that the weights did not see, calibrates the probabilities. As values are linear in the windows, scoring adds up
the weight rows of all windows: a map without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0; texts of any length are read whole;
repeated rows are each predicted; ties go to the language that sorts first; tables without rows give none; further
columns are not read. Without any labelled row every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.llm.common import LONGEST, small_batches

BITS = 16
UNDETERMINED = "und"


def lettered(text: str | None) -> bool:
    """Has the text a character of a letter category (L)?"""
    return text is not None and any(map(str.isalpha, text))


def windows(text: str) -> np.ndarray:
    """Bucket of every window of two and three characters; spaces frame the text."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    both = np.concatenate([two, three])
    both ^= both >> np.uint32(15)
    return (both * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


@dataclass
class Languages:
    names: list[str]
    weights: np.ndarray  # (buckets, languages); holds the inverse document frequencies too
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        return self.weights[windows(text)].mean(0, dtype=np.float64) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not lettered(text):
            return UNDETERMINED, 0.0
        z = self.logits(text) / self.temperature
        e = np.exp(z - z.max())
        return self.names[int(z.argmax())], float(e.max() / e.sum())

    def column(self, text: str = "text") -> Column:
        """Struct of the predicted language and its calibrated probability."""

        @F.pandas_udf("lang_pred string, score double")
        def language(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.predict(t) for t in texts], columns=["lang_pred", "score"])

        return language(F.col(text))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002, seed: int = 7) -> Languages:
    """FTRL-proximal with elastic net, then a temperature on every fifth row."""
    rows = [(t, y) for t, y in rows if lettered(t)]
    names = sorted({y for _, y in rows})
    size = 1 << BITS
    if not names:
        return Languages([], np.zeros((size, 0), np.float32), np.zeros(0))
    found = [np.unique(windows(t), return_counts=True) for t, _ in rows]
    idf = np.log((1 + len(rows)) / (1 + np.bincount(np.concatenate([i for i, _ in found]), minlength=size))) + 1
    y = np.array([names.index(v) for _, v in rows])
    values = [idf[i] * n / n.sum() for i, n in found]
    z, n, w = (np.zeros((size, len(names))) for _ in range(3))
    bias = np.zeros(len(names))
    r, fitted = np.random.default_rng(seed), [k for k in range(len(rows)) if k % 5 or len(rows) < 10]
    for _ in range(epochs):
        for k in r.permutation(fitted):
            i, x = found[k][0], values[k] * 30
            p = softmax(x @ w[i] + bias)
            p[y[k]] -= 1
            bias -= 0.05 * p
            g = x[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
            w[i] = np.where(np.abs(z[i]) <= l1, 0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))
    model = Languages(names, (w * idf[:, None] * 30).astype(np.float32), bias)
    apart = [k for k in range(len(rows)) if k not in set(fitted)] or fitted
    logits = np.array([model.logits(rows[k][0]) for k in apart])
    loss = {t: -np.log(softmax(logits / t)[np.arange(len(apart)), y[apart]] + 1e-12).mean() for t in np.geomspace(0.1, 10, 60)}
    model.temperature = float(min(loss, key=loss.get))
    return model


def sample(docs: DataFrame, bound: int, label: str = "lang", longest: int = LONGEST) -> list[tuple[str, str]]:
    """At most ``bound`` rows with a text of at most ``longest`` characters and a language, in the order of a hash of the
    id; sorted. Of several such rows of one id the smallest counts."""
    useful = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") <= longest) & F.col(label).isNotNull())
    order = F.xxhash64(F.concat(F.lit("language"), F.col("doc_id").cast("string")))
    ids = useful.select(order.alias("o"), "doc_id").distinct().orderBy("o", "doc_id").limit(bound).select("doc_id")
    chosen = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)
    least = F.min(F.struct(F.col("text").alias("t"), F.col(label).alias("y"))).alias("r")
    rows = useful.select("doc_id", "text", label).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(least).collect()
    return [(r["r"]["t"], r["r"]["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def fit(docs: DataFrame, bound: int = 2000, label: str = "lang") -> Languages:
    """Train on at most ``bound`` rows (see ``sample``); everything else about the operator sees all data."""
    small_batches(docs.sparkSession)
    return train(sample(docs, bound, label))

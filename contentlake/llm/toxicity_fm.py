"""Toxicity: a factorisation machine over hashed terms.

Terms are lower-cased words and the first four and five characters of longer words, hashed into buckets. The
machine adds to a linear score the products of factors of all pairs of terms that a text holds, so a pair such
as an insult with a group can count more than its parts. Training keeps all buckets that at least ``least`` texts
of the sample hold, since a term that is neutral by itself can matter in pairs; the bounded sample bounds them, and
those left without weight or factors go after training. A word without live buckets costs one dictionary look-up when scoring. Scoring is a map without a shuffle.

Defined cases: null, empty and wordless texts get the score of the bias alone; texts of any length are read
whole; repeated rows are each scored; tables without rows give none; further columns are not read. Without any
labelled row every score is 0.5.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.llm.common import labelled_sample, small_batches

BITS, FACTORS = 24, 6
WORDS = re.compile(r"\w+")


def buckets(word: str) -> tuple[int, ...]:
    """The hashed terms of one word."""
    terms = [word] + [f"{word[:n]}-" for n in (4, 5) if len(word) > n]
    return tuple(crc32(t.encode()) & ((1 << BITS) - 1) for t in terms)


def terms_of(text: str | None) -> np.ndarray:
    return np.unique(np.fromiter((b for w in set(WORDS.findall((text or "").lower())) for b in buckets(w)), np.int64))


@dataclass
class Machine:
    bias: float
    index: dict[int, int]
    linear: np.ndarray
    factors: np.ndarray
    memory: dict = field(default_factory=dict, repr=False)

    def logit(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        return float(self.bias + self.linear[rows].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()))

    def score(self, text: str | None) -> float:
        live, memory = set(), self.memory
        if len(memory) > 400_000:
            memory.clear()
        for word in set(WORDS.findall((text or "").lower())):
            got = memory.get(word)
            if got is None:
                got = memory[word] = tuple(self.index[b] for b in buckets(word) if b in self.index)
            if got:
                live.update(got)
        return 1 / (1 + np.exp(-np.clip(self.logit(np.array(sorted(live), np.int64)), -30, 30)))

    def column(self, text: str = "text") -> Column:
        """The probability of label 1 for a text column."""
        machine = Machine(self.bias, self.index, self.linear, self.factors)

        @F.pandas_udf("double")
        def toxicity_score(texts: pd.Series) -> pd.Series:
            return pd.Series([machine.score(t) for t in texts], dtype="float64")

        return toxicity_score(F.col(text))


def live_buckets(found: list[np.ndarray], y: np.ndarray, least: int, depends: float, common: float) -> np.ndarray:
    """Buckets worth a weight: enough texts hold them, and (with ``depends``) they depend on the label or are common."""
    if not found or not sum(map(len, found)):
        return np.zeros(0, np.int64)
    every, held = np.unique(np.concatenate(found), return_counts=True)
    toxic = np.unique(np.concatenate([np.zeros(0, np.int64), *(t for t, v in zip(found, y, strict=True) if v)]), return_counts=True)
    both = np.zeros(len(every))
    both[np.searchsorted(every, toxic[0])] = toxic[1]
    n, positive = len(y), y.sum()
    gap = both * n - held * positive
    spread = held * positive * (n - held) * (n - positive)
    chi = np.divide(gap**2 * n, spread, out=np.zeros(len(every)), where=spread > 0)
    return every[(held >= least) & ((chi >= depends) | (held >= common * n))]


def train(rows: list[tuple[str, int]], epochs: int = 8, rate: float = 0.3, least: int = 4, depends: float = 0.0, common: float = 0.1, l1: float = 1e-3, l2: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, one text at a time."""
    r = np.random.default_rng(seed)
    found, y = [terms_of(t) for t, _ in rows], np.array([v for _, v in rows], float)
    live = live_buckets(found, y, least, depends, common)
    found = [np.searchsorted(live, np.intersect1d(t, live, True)) for t in found]
    linear, factors = np.zeros(len(live)), r.standard_normal((len(live), FACTORS)) * 0.01
    past, past_v, bias, past_b = np.full(len(live), 1e-6), np.full((len(live), FACTORS), 1e-2), 0.0, 1e-6
    for _ in range(epochs):
        for i in r.permutation(len(rows)):
            t = found[i]
            v = factors[t]
            total = v.sum(0)
            z = bias + linear[t].sum() + 0.5 * ((total**2).sum() - (v * v).sum())
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            past_b += d * d
            bias -= rate * d / np.sqrt(past_b)
            past[t] += d * d
            step = rate / np.sqrt(past[t])
            w = linear[t] - step * d
            linear[t] = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            g = d * (total - v) / np.sqrt(1 + len(t)) + l2 * v
            past_v[t] += g * g
            factors[t] = v - 0.1 * rate * g / np.sqrt(past_v[t])
    used = (np.abs(linear) > 1e-3) | ((factors**2).sum(1) > 4e-3 * FACTORS)
    return Machine(float(bias), {int(b): k for k, b in enumerate(live[used])}, linear[used], factors[used])


def fit(docs: DataFrame, labelled: DataFrame, bound: int = 4000, label: str = "toxic") -> Machine:
    """Train on at most ``bound`` labelled rows, up to half of them toxic; everything else about the operator sees all data. Toxic
    rows are rarer among all labels than in the sample, which the bias makes up for, so that scores stay probabilities."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labelled, label, bound, "toxic", halves=True)
    machine = train(sample)
    toxic, clean = labelled.agg(F.count_if(F.col(label) > 0), F.count_if(F.col(label) <= 0)).first()
    taken = sum(y > 0 for _, y in sample)
    if 0 < taken < len(sample):
        machine.bias += float(np.log(toxic / clean) - np.log(taken / (len(sample) - taken)))
    return machine

"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes are embedded, learned
filters run over each chunk and are max-pooled; a hidden layer turns a chunk's maxima into features, whose
maximum and mean over all chunks give one probability. Weights are a few kB and travel with the task; scoring
is a map without a shuffle.

Defined cases: null and empty texts are one empty chunk and get a score like any other text; texts of any length
are covered whole; repeated rows are each scored; tables without rows give none; further columns are not read.
Without any labelled row the untrained network's output is 0.5 for all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.llm.common import labelled_sample, small_batches

CHUNK, STEP = 512, 448
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 6, 2, 6, 24, 16
BLOCK = 192


def chunks_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover all bytes, zero-padded, and the filled share of each."""
    n = len(data)
    count = 1 if n <= CHUNK else 1 + -(-(n - CHUNK) // STEP)
    padded = np.zeros((count - 1) * STEP + CHUNK, np.uint8)
    padded[:n] = np.frombuffer(data, np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]
    fill = np.minimum(CHUNK, n - STEP * np.arange(count)).astype(np.float32) / CHUNK
    return view, fill


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        w = {
            "embed": draw(0.5, 256, EMBED),
            "filters": draw((WIDTH * EMBED) ** -0.5, WIDTH * EMBED, FILTERS),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "hidden": draw((FILTERS + 1) ** -0.5, FILTERS + 1, HIDDEN),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": np.zeros(2 * HIDDEN, np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        w["embed"][0] = 0
        return cls(w)

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Bytes under each filter position: chunks x positions x width."""
        return np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)[:, ::STRIDE]

    def pool(self, chunks: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Filter maxima of each chunk (rectified), and their positions if asked for."""
        w = self.weights
        maxima, places = [], []
        for at in range(0, len(chunks), BLOCK):
            embedded = w["embed"][chunks[at : at + BLOCK]].reshape(-1, CHUNK * EMBED)
            seen = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
            out = np.ascontiguousarray(seen).reshape(-1, WIDTH * EMBED) @ w["filters"]
            out = out.reshape(len(embedded), -1, FILTERS)
            if where:
                places.append(out.argmax(1))
            maxima.append(out.max(1))
        top = np.maximum(np.concatenate(maxima) + w["filter_bias"], 0)
        return top, np.concatenate(places) if where else None

    def forward(self, texts: list[bytes], where: bool = False) -> dict[str, np.ndarray]:
        w = self.weights
        parts = [chunks_of(t) for t in texts]
        counts = np.array([len(c) for c, _ in parts])
        chunks = np.concatenate([c for c, _ in parts])
        top, places = self.pool(chunks, where)
        inputs = np.concatenate([top, np.concatenate([f for _, f in parts])[:, None]], 1)
        hidden = np.tanh(inputs @ w["hidden"] + w["hidden_bias"])
        starts = np.cumsum(counts) - counts
        most = np.maximum.reduceat(hidden, starts)
        mean = np.add.reduceat(hidden, starts) / counts[:, None]
        features = np.concatenate([most, mean], 1)
        logit = features @ w["out"] + w["out_bias"]
        return {"chunks": chunks, "counts": counts, "top": top, "places": places, "inputs": inputs, "hidden": hidden, "most": most, "features": features, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        w, s = self.weights, self.forward(texts, True)
        d_logit = ((s["p"] - y) / len(y)).astype(np.float32)
        g = {"out": s["features"].T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
        d_features = d_logit[:, None] * w["out"]
        doc = np.repeat(np.arange(len(y)), s["counts"])
        d_hidden = d_features[doc, HIDDEN:] / s["counts"][doc, None] + d_features[doc, :HIDDEN] * (s["hidden"] == s["most"][doc])
        d_pre = d_hidden * (1 - s["hidden"] ** 2)
        g |= {"hidden": s["inputs"].T @ d_pre, "hidden_bias": d_pre.sum(0)}
        d_top = (d_pre @ w["hidden"][:FILTERS].T) * (s["top"] > 0)
        g["filter_bias"] = d_top.sum(0)
        rows = np.arange(len(d_top))[:, None]
        under = self.windows(s["chunks"])[rows, s["places"]]  # chunks x filters x width
        seen = w["embed"][under].reshape(len(d_top), FILTERS, -1)
        g["filters"] = np.einsum("cfk,cf->kf", seen, d_top)
        d_seen = np.einsum("cf,kf->cfk", d_top, w["filters"]).reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(under.ravel(), d_seen[:, e], 256) for e in range(EMBED)], 1)
        g["embed"][0] = 0
        return g

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out, at = [], 0
        while at < len(texts):  # about 4 MB of text at a time
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= 4_000_000):
                size += len(texts[end])
                end += 1
            out.append(self.forward(texts[at:end])["p"])
            at = end
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)

    def column(self, text: str = "text") -> Column:
        """The probability of label 1 for a text column."""

        @F.pandas_udf("double")
        def quality_score(texts: pd.Series) -> pd.Series:
            return pd.Series(self.scores([b"" if t is None else t.encode() for t in texts]))

        return quality_score(F.col(text))


def train(rows: list[tuple[str, int]], epochs: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the logistic loss over whole texts."""
    net = Network.fresh(seed)
    texts, y = [t.encode() for t, _ in rows], np.array([v for _, v in rows], np.float32)
    order = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step, total = 0, max(1, epochs * -(-len(rows) // batch))
    for _ in range(epochs):
        turn = order.permutation(len(rows))
        for at in range(0, len(rows), batch):
            take = turn[at : at + batch]
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, g in net.gradients([texts[i] for i in take], y[take]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.weights[k] -= (now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labelled: DataFrame, bound: int = 1200, label: str = "quality") -> Network:
    """Train on at most ``bound`` labelled rows; everything else about the operator sees all data."""
    small_batches(docs.sparkSession)
    return train(labelled_sample(docs, labelled, label, bound, "quality"))

"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into segments; of each segment a vector keeps its mean and its deviation. By Cauchy and Schwarz a
segment of width w adds at most w * (mean * mean' + deviation * deviation') to an inner product, and a coarse cut
bounds no tighter than a finer one. (With the norms this is the lower bound of a distance; the order asked for is
by inner product, so the bound is kept as one on that.) A query's threshold is its k-th best exact score among
the candidates of highest coarse bound; pairs below it go at the coarse level, then at the fine level, and exact
products are computed for survivors only. No pair that could be in the result is dropped.

The stated query set meets all rows in blocks of bounded size: a task holds one block of queries and one block of
candidates, and returns k rows a query; a window over those merges the blocks.

How much the bounds save depends on the data: vectors in clusters leave few pairs to the exact step, those spread evenly
over all directions leave nearly all. A level is used only where its bound costs at most half the product itself.

Defined cases: rows with a null id or vector, an empty vector, or a null or non-finite component take no part; rows that
repeat an id are all candidates, and rows of a query's id share its one result; a query has no partner with its own id,
nor of another length; ties go to the smaller id; tables without rows give none; further columns are not read. A vector
whose scaled components' squares add up to over 2**51 is an error, since its products might not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (4, 16, 64)


def levels(width: int) -> tuple[int, ...]:
    """Numbers of segments, coarse to fine, whose bounds cost at most half a product of this width."""
    return tuple(n for n in LEVELS if 4 * n <= width) or LEVELS[:1]


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations, each times the root of the segment's width: their dot product is the bound."""
    cuts = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    width = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / width
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / width
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0))], 1) * np.sqrt(np.tile(width, 2))


def products(rows: np.ndarray, others: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Dot products where ``alive``, minus infinity elsewhere: one by one if few are alive, else as a block."""
    some, other = np.nonzero(alive)
    if len(some) > 0.05 * alive.size:
        return np.where(alive, rows @ others.T, -np.inf)
    out = np.full(alive.shape, -np.inf)
    for at in range(0, len(some), 65_536):
        i, j = some[at : at + 65_536], other[at : at + 65_536]
        out[i, j] = np.einsum("nd,nd->n", rows[i], others[j])
    return out


def search(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, at_once: int = 128, left: list[float] | None = None, exact: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, ids and scores of its k best rows of x; score descending, id ascending. ``left`` is given the
    shares of pairs that no bound removed. ``exact`` has q and x in integers, where doubles may be too short for their products."""
    cuts = levels(x.shape[1])
    features = [segment_features(x, n) for n in cuts]
    for at in range(0, len(q), at_once):
        rows, ids = q[at : at + at_once], q_ids[at : at + at_once]
        alive = x_ids[None, :] != ids[:, None]
        bound = products(segment_features(rows, cuts[0]), features[0], alive)
        slack = 1e-6 * (1 + np.abs(bound[alive]).max(initial=0))
        first = min(4 * k, len(x))
        probe = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        known = np.where(np.take_along_axis(alive, probe, 1), np.einsum("qd,qnd->qn", rows, x[probe]), -np.inf)
        least = np.partition(known, first - min(k, first), axis=1)[:, first - min(k, first), None]
        alive &= bound >= least - slack
        for segments, feature in zip(cuts[1:], features[1:], strict=True):
            alive &= products(segment_features(rows, segments), feature, alive) >= least - slack
        if left is not None:
            left.append(alive.mean())
        score = products(rows, x, alive) if exact is None else exact_products(*exact, at, at + at_once, alive)
        most = min(k, len(x))
        least = np.partition(score, len(x) - most, axis=1)[:, len(x) - most, None]
        some, other = np.nonzero(alive & (score >= least))
        value = score[some, other]
        order = np.lexsort((x_ids[other], -value, some))
        some, other, value = some[order], other[order], value[order]
        edges = np.searchsorted(some, np.arange(len(rows) + 1))
        for i in range(len(rows)):
            part = slice(edges[i], min(edges[i] + k, edges[i + 1]))
            yield int(ids[i]), x_ids[other[part]], value[part]


def exact_products(q: np.ndarray, x: np.ndarray, begin: int, end: int, alive: np.ndarray) -> np.ndarray:
    """Products of large integers, for pairs that are alive; the least long for others."""
    out = np.full(alive.shape, np.iinfo(np.int64).min)
    far = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] >= 2.0**62
    for i, row in enumerate(q[begin:end]):
        some = np.flatnonzero(alive[i])
        if not far:
            out[i, some] = x[some] @ row
            continue
        for j in some.tolist():
            value = sum(a * b for a, b in zip(x[j].tolist(), row.tolist(), strict=True))
            if not -(1 << 63) < value < 1 << 63:
                raise OverflowError("an inner product is larger than a long")
            out[i, j] = value
    return out


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))


def quantised(vector: str = "embedding", scale: int = 64) -> Column:
    """floor(scale * component), with components taken as double; an error where that is no long."""
    whole = lambda c: F.floor(c.cast("double") * scale).cast("long")
    fits = F.forall(vector, lambda c: F.abs(c.cast("double") * scale) < 2.0**63)
    return F.when(fits, F.transform(vector, whole)).otherwise(F.raise_error(F.lit("a component is too large for a long")))


def topk(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", query_block: int = 4096, row_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest integer inner products."""
    clean = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("embedding")).filter(F.col("vec_id").isNotNull() & usable())
    rows = clean.select("vec_id", quantised().alias("v"), F.monotonically_increasing_id().alias("place")).withColumn("dim", F.size("v"))
    counts = clean.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    query_blocks, row_blocks = -(-max(counts["q"], 1) // query_block), -(-max(counts["n"], 1) // row_block)
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.filter(is_query).select("dim", block(query_blocks, 1).alias("qb"), each(row_blocks).alias("xb"), "vec_id", "v")
    given = rows.select("dim", each(query_blocks).alias("qb"), block(row_blocks, 2).alias("xb"), "vec_id", "v")

    def block_pair(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            whole = tuple(np.stack(f["v"].to_numpy()) for f in (queries, candidates))
            q, x = (v.astype(np.float64) for v in whole)
            short = np.square(q).sum(1).max() * np.square(x).sum(1).max() <= 2.0**102  # then doubles hold every product
            for query, ids, score in search(queries["vec_id"].to_numpy(), q, candidates["vec_id"].to_numpy(), x, k, exact=None if short else whole):
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids, "score": score.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ["dim", "qb", "xb"]
    best = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInPandas(block_pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

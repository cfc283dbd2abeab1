"""Connected components of links by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlake.llm.common import Scratch, spread_join


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node that links reach.

    Each round points a node at its smallest neighbour if that is smaller, follows pointers to their ends by
    doubling, and replaces links by those between ends. At least all but the locally smallest nodes of a component
    go in a round, so rounds are few. A node's neighbours are only ever summed up by a minimum, which is partly
    done before the shuffle, and joins on nodes are broadcast or salted, so a node with very many links is no special case.
    """
    edges = scratch.save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        # smaller ends only ever point down, so a pointer chain has no cycle
        parents = scratch.save(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "parents")
        if not parents.take(1):
            break
        while True:
            up = parents.select(F.col("node").alias("label"), F.col("label").alias("further"))
            jumped = scratch.save(spread_join(parents, up, "label", "left").select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")), "jumped")
            scratch.drop(parents)
            parents = jumped
            if not parents.filter("moved").take(1):
                break
            parents = _keep(parents.drop("moved"), jumped)
        ends = parents.select("node", "label")
        if labels is None:
            labels = _keep(ends, parents)
        else:
            known = spread_join(labels.select("node", F.col("label").alias("was")), ends.select(F.col("node").alias("was"), "label"), "was", "left").select("node", F.coalesce("label", "was").alias("label"))
            fresh = ends.join(labels.select("node"), "node", "left_anti")
            labels = scratch.save(known.unionByName(fresh), "labels")
        to = lambda side: ends.select(F.col("node").alias(side), F.col("label").alias(f"to_{side}"))
        moved = spread_join(spread_join(edges, to("a"), "a", "left"), to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        edges = scratch.save(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))  # no link, no row
    roots = labels.select("label").distinct()
    return labels.unionByName(roots.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti"))


def _keep(df: DataFrame, saved: DataFrame) -> DataFrame:
    """A projection of a saved table stays one, so that it can be dropped."""
    df._scratch_path = saved._scratch_path
    return df

"""Folder tree: closure of an adjacency list, and rollups over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.shared import saved

MAX_DEPTH = 64


def closure(folders: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(ancestor, folder_id) for every folder and each of its ancestors, itself included.

    Pairs are joined with themselves, so each round doubles the depth that is covered and a tree of depth d takes
    log2(d) rounds; a cycle adds no new pair, which ends the loop. Each round is saved, so that plans stay small. Rows without an id take no part, a parent that
    doesn't exist is no ancestor.
    """
    nodes = folders.filter("folder_id IS NOT NULL")
    ids = nodes.select("folder_id").distinct()
    up = nodes.join(ids.select(F.col("folder_id").alias("parent_id")), "parent_id").select(F.col("parent_id").alias("ancestor"), "folder_id")
    pairs = saved(ids.select(F.col("folder_id").alias("ancestor"), "folder_id").unionByName(up).distinct(), "closure")
    count, depth = pairs.count(), 1
    while depth < max_depth:
        further = pairs.alias("a").join(pairs.alias("b"), F.col("a.folder_id") == F.col("b.ancestor")).select(F.col("a.ancestor").alias("ancestor"), F.col("b.folder_id").alias("folder_id")).distinct()
        further = saved(further, "closure")
        more = further.count()
        if more == count:
            break
        pairs, count, depth = further, more, depth * 2
    return pairs


def values(spark: SparkSession, items: Sequence[str], name: str) -> DataFrame:
    """A column of given strings, made by Spark itself."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, items)).cast("array<string>")).alias(name))


def descendants(folders: DataFrame, seeds: list[str]) -> DataFrame:
    """folder_id of the seeds (which are kept even if unknown) and everything below them.

    One recursive plan without an action of its own; a folder's path ends a cycle.
    """
    spark = folders.sparkSession
    given = values(spark, seeds, "folder_id")
    below = """
    WITH RECURSIVE below(folder_id, path) AS (
      SELECT folder_id, array(folder_id) FROM {given}
      UNION ALL
      SELECT f.folder_id, array_append(b.path, f.folder_id) FROM below b JOIN {folders} f ON f.parent_id = b.folder_id
      WHERE NOT array_contains(b.path, f.folder_id)
    )
    SELECT DISTINCT folder_id FROM below"""
    return spark.sql(below, given=given, folders=folders.select("folder_id", "parent_id"))


def rollup(folders: DataFrame, by_folder: DataFrame, value: str) -> DataFrame:
    """(folder_id, value): each folder's own value plus that of all below it; 0 where there is none."""
    pairs = closure(folders)
    return pairs.join(by_folder, "folder_id", "left").groupBy(F.col("ancestor").alias("folder_id")).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))

"""Connected components of an edge table, as Spark joins and aggregations.

Alternating large-star and small-star steps: every step links nodes to the
smallest node they know of.  All aggregations are `min` (partially aggregated
before the shuffle) and joins read a broadcast of small measured size or staged
tables on both sides, so AQE can split a hub's rows.  Each round's edges are
staged on shared storage and the previous ones deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, in_few, is_small, staged, unstage


# Tasks that write a table made from edges of small measured size, however many
# shuffle partitions there are.
FEW = 8
# Largest measured size of a table of nodes that is broadcast.
NODE_BYTES = 4 * 1024 * 1024


def _least(pairs: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs (u, v): the smallest of each u and its v's, and how many v's there are (staged)."""
    return staged(few(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))), "cc-least")


def _star(pairs: DataFrame, least: DataFrame, larger_only: bool) -> DataFrame:
    """pairs (u, v) with their staged `least`: link the v's of each u to the smallest
    of u and its v's.  A `least` of small measured size is broadcast, so the pairs
    aren't shuffled to meet it."""
    linked = pairs.join(broadcast_if_small(least, NODE_BYTES).drop("n"), "u")
    if larger_only:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v")


def connected_components(edges: DataFrame, max_rounds: int = 60, sources: tuple[DataFrame, ...] = ()) -> DataFrame:
    """edges (src, dst), any comparable type -> (node, component), component
    being the smallest reachable node, for every node on an edge between two
    different nodes.  Null ends and loops are ignored; direction and repeats
    don't matter; no edges give no rows.  `sources`: the staged tables that the edges are
    made from, if their sizes may set the number of tasks.

    The steps end when the edges are stars around their smallest nodes: no node
    with a smaller neighbour has another one."""
    distinct = (
        edges.filter("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e = staged(in_few(distinct, *sources), "cc-edges")
    for done in range(max_rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        few = (lambda df: df.coalesce(FEW)) if is_small(e) else (lambda df: df)
        least_1 = _least(both, few)
        if least_1.agg(F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()[0] == 0:
            unstage(least_1)
            break
        if done == max_rounds:
            raise RuntimeError("components did not settle")
        large = _star(both, least_1, True)
        if not is_small(least_1, NODE_BYTES):  # else its rows come from one pass over the edges
            large = staged(large.distinct(), "cc-large")
        least_2 = _least(large, few)
        small = staged(few(_star(large, least_2, False).distinct()), "cc-small")
        for old in (e, least_1, large, least_2):
            unstage(old)
        e = small
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        few(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    )

"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _settled(edges: DataFrame) -> bool:
    """Whether every node is linked to one other, to which nothing else leads."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("out")))
    seen = ends.groupBy("x").agg(F.sum("out").alias("n"), F.min("out").alias("least"))
    return seen.where("n > 1 OR (n = 1 AND least = 0)").isEmpty()


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges with their u's m. least: (u, m, n), n the edges of u.

    Nodes with more than a share of all edges are few: they are broadcast, so that their edges stay where they are.
    """
    hot = F.col("n") > max(1000, total // (4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    few = F.broadcast(least.where(hot).select("u", "m"))  # at most 8 a shuffle partition: an edge counts for two nodes
    rest = edges.join(few, "u", "left_anti").join(least.where(~hot).select("u", "m"), "u")
    return edges.join(few, "u").unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least node next to it."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both, least, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    near = _with_least(edges, least, total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges that a task contracts at a time.
CONTRACTED = 1_000_000


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges with the same components as those of the task: each node of a batch of edges to the least it reaches there."""

    def stars() -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([x.to_numpy() for x in (*(h["u"] for h in held), *(h["v"] for h in held))]), return_inverse=True)
        parent, half = list(range(len(nodes))), len(at) // 2
        for a, b in zip(at[:half].tolist(), at[half:].tolist()):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a < b:
                parent[b] = a
            else:
                parent[a] = b
        for i in range(len(parent)):  # parents are smaller, so they are settled before
            parent[i] = parent[parent[i]]
        root = np.array(parent, np.int64)
        far = root != np.arange(len(nodes))
        return pd.DataFrame({"u": nodes[far], "v": nodes[root[far]]})

    held, size = [], 0
    for frame in frames:
        if len(frame):
            held.append(frame)
            size += len(frame)
        if size >= CONTRACTED:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 64, at_once: int = CONTRACTED) -> DataFrame:
    """(id, component): the least node reachable, for every node that has an edge. edges: (u, v) of longs.

    Large and small stars alternate until only stars are left, or no more than ``at_once`` edges, which one task contracts.
    That takes a number of rounds logarithmic in the nodes.
    Tasks contract their own edges first. Minima are aggregated before the shuffle; edges of a node with very many neighbours
    meet its minimum by a broadcast, those of all others by a join.
    """
    few = edges.where("u <> v").select("u", "v").mapInPandas(_contract, "u long, v long")
    now = scratch.write(few)
    for _ in range(rounds):
        total = now.count()
        if total <= at_once:  # what a task contracts at a time anyway is settled by one task
            now = scratch.write(now.coalesce(1).mapInPandas(_contract, "u long, v long"))
            break
        if _settled(now):
            break
        after = scratch.write(_small_star(_large_star(now, total).distinct(), total))
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()

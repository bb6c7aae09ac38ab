"""Connected components of a graph given by its edges.

Stars are made larger and smaller in turn: every neighbour of a node that is
larger than it is linked to its smallest neighbour, then the smaller ones are,
until no edge changes.  That takes about log(nodes) rounds of joins on node
numbers, each kept in the shared folder; nothing is gathered by node, so a node
of any degree is no burden to one task beyond its rows.

Defined cases: edges with a null end and edges from a node to itself are left
out; repeated edges add nothing; without edges there are no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: each node that has an edge, with the smallest node of its component."""
    low, high = F.least(a, b), F.greatest(a, b)
    links = cut(edges.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").select(low.alias("u"), high.alias("v")).distinct())
    before = _print(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u <> v").union(least.select(F.col("m").alias("u"), "v")).distinct()
        links = cut(small)
        now = _print(links)
        if now == before:
            break
        before = now
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).union(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _print(links: DataFrame) -> tuple:
    """Count and two sums of hashes: equal for equal edges."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("u", "v"))).first())


def hang(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """One class for a and b of each pair, in one process: the larger class number is hung below the smaller until all are equal."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up

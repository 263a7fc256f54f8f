"""Connected components of an undirected graph by alternating large and small stars.

Each round points every node's larger neighbours at its smallest neighbour, then every node's smaller neighbours at the
smallest of them; edges never multiply, and the number of rounds grows with the logarithm of the longest chain. Only
minima are aggregated, so a node with a third of all edges is combined before the shuffle and split by the join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.session import materialise


def reach(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows by links a-b, in one task's memory."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root, new)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _smallest(pairs: DataFrame) -> DataFrame:
    """For (u, v): each u with the least of itself and its v."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of `edges` (a, b: long): the smallest id reachable. Loops and repeated edges do no
    harm, edges with a null end are none, and a graph without edges has no rows."""
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    stars = materialise(stars.distinct(), "edges")
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v")
        large = both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_smallest(large), "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = materialise(small.select("e.u", "e.v").filter("u <> v").distinct(), "stars")
        # Done when every node points at one root, and no root points anywhere.
        several = small.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo < hi")
        deep = small.select(F.col("v").alias("u")).join(small.select("u"), "u", "left_semi")
        stars = small
        if several.isEmpty() and deep.isEmpty():
            break
    nodes = edges.select(F.explode(F.array("a", "b")).alias("u")).filter("u is not null").distinct()
    return nodes.join(stars, "u", "left").select(F.col("u").alias("id"), F.coalesce("v", "u").alias("component"))

"""Connected components: of links within a task, and of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.llm.common import materialize


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the links (a[i], b[i])."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (a, b: long) but the roots: root is the smallest node reachable.

    Alternating stars: each node hands its larger, then its smaller neighbours to the smallest one it knows, until
    every link is from a node to its root. Each round is written to the shared folder, so the lineage stays short and
    the driver sees two numbers a round, no link.
    """

    def stars(edges: DataFrame, larger: bool) -> DataFrame:
        pairs = edges.union(edges.select("v", "u")) if larger else edges
        lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = pairs.join(lowest, "u")
        if larger:
            return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    before = state(edges)
    while before[0]:
        edges = materialize(stars(stars(edges, True), False), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

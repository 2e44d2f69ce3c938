"""Connected components of a link table, as alternating star contractions on DataFrames.

Each round joins and groups the links by node; nothing but a count and a checksum reaches the driver. A round's result is
checkpointed in the shared folder. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def local_forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For links (i, j) among 0..n-1, each node's smallest reachable node."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links come as (a, b) with a > b: hang a's lower neighbours, and a itself, below the lowest of them."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links(a, b) that aren't their own component's smallest node.

    Loops, repeated and reversed links are harmless; an empty table gives an empty result. Nulls are dropped.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("ok"))
    links = checkpoint(links.filter("ok and a != b").select("a", "b").distinct())
    last = None
    while True:
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())  # neither can overflow
        if state[0] == 0 or state == last:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = state
        links = checkpoint(_small_star(_large_star(links)))

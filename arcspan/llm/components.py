"""Connected components by alternating star contraction, on tables only.

Each round first links every node's larger neighbours to its smallest one, then every node's
smaller neighbours to the smallest; after a few rounds (about the logarithm of the longest
chain) each component is a star around its smallest id. Edges and labels stay distributed, and
each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spool


def components(edges: DataFrame, spool: Spool) -> DataFrame:
    """`edges` has the long columns a and b; result: node, root (the component's smallest node).

    Only nodes with an edge to another node are in the result. Null ends, loops and repeated
    edges are ignored; no edges give an empty table.
    """
    e = edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, mark = spool.write(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = spool.write(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        spool.drop(e)
        e = after
        found = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(found) == mark or not found[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(found)


def local_labels(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, of the links a, b."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after

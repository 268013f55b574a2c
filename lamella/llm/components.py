"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import cut_narrow as cut


def components(edges: DataFrame, held: int = 0) -> DataFrame:
    """(node, root) for every node of an edge of (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stay the same.
    Each step is a partial aggregate and a join on one key, whose skew Spark
    splits; nothing but a count and a checksum comes to the driver, and the edges
    once there are ``held`` of them at most, if nodes are longs.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == last or not state[0]:
            break
        if state[0] <= held and {x for _, x in now.dtypes} == {"bigint"}:
            return gathered(now)
        last = state
        # Large star: every larger neighbour of a node goes to the smallest one.
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours of a node and the node go to the smallest one.
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = cut(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def gathered(edges: DataFrame) -> DataFrame:
    """The same of a few edges, on the driver."""
    found = edges.toArrow()
    a, b = (found.column(x).to_numpy() for x in ("a", "b"))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root, last = np.arange(len(names)), None
    while last is None or not np.array_equal(root, last):
        last, low = root, np.minimum(root[a], root[b])
        root = last.copy()
        np.minimum.at(root, last[a], low)
        np.minimum.at(root, last[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
    return edges.sparkSession.createDataFrame(pa.table({"node": names, "root": names[root]}))

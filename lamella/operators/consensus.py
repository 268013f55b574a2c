"""Consensus of base partitions (layer, node, c)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators.linear import clustered, row_normalized


def coassociation(base: DataFrame) -> DataFrame:
    """(src, dst, n): in how many layers two nodes (src <= dst) share a community. As many rows as such pairs."""
    a, b = base.withColumnRenamed("node", "src"), base.withColumnRenamed("node", "dst")
    return a.join(b, ["layer", "c"]).filter("src <= dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def laplacian_product(base: DataFrame, x: DataFrame) -> DataFrame:
    """(node, y): x less its normalised co-association product, without forming the matrix. x: (node, value)."""
    size = base.groupBy("layer", "c").agg(F.count(F.lit(1)).alias("size"))
    d = base.join(size, ["layer", "c"]).groupBy("node").agg(F.sum("size").alias("d"))
    scaled = x.join(d, "node").select("node", "value", F.sqrt("d").alias("rd"))
    sums = base.join(scaled, "node").groupBy("layer", "c").agg(F.sum(F.col("value") / F.col("rd")).alias("s"))
    product = base.join(sums, ["layer", "c"]).groupBy("node").agg(F.sum("s").alias("s"))
    return scaled.join(product, "node").select("node", (F.col("value") - F.col("s") / F.col("rd")).alias("y"))


def cluster_affinity(base: DataFrame) -> DataFrame:
    """(pl, pc, ql, qc, w): affinity of base clusters, each shared node weighing one over its number of clusters."""
    weight = base.groupBy("node").agg((1.0 / F.count(F.lit(1))).alias("dx"))
    a = base.select("node", F.col("layer").alias("pl"), F.col("c").alias("pc"))
    b = base.select("node", F.col("layer").alias("ql"), F.col("c").alias("qc"))
    return a.join(b, "node").join(weight, "node").groupBy("pl", "pc", "ql", "qc").agg(F.sum("dx").alias("w"))


def consensus(base: DataFrame, r: int, matrix_free: bool = False, restarts: int = 3) -> DataFrame:
    """(node, c): the cut of the bipartite graph of nodes and base clusters into r parts.

    The eigenproblem is the size of the base clusters and is solved on the driver.
    ``matrix_free``: spectral clustering of the co-association matrix, whose
    spectrum a small Gram matrix of the clusters has as well.
    """
    keys = [(x.layer, x.c) for x in base.select("layer", "c").distinct().orderBy("layer", "c").collect()]  # layers * r rows
    if len(keys) < r:
        raise ValueError("fewer base clusters than parts")
    number = {k: i for i, k in enumerate(keys)}
    m = np.zeros((len(keys), len(keys)))
    spark = base.sparkSession
    if matrix_free:
        size = base.groupBy("layer", "c").agg(F.count(F.lit(1)).alias("size"))
        d = base.join(size, ["layer", "c"]).groupBy("node").agg(F.sum("size").cast("double").alias("d"))
        a, b = base.select("node", F.col("layer").alias("pl"), F.col("c").alias("pc")), base.select("node", F.col("layer").alias("ql"), F.col("c").alias("qc"))
        cells = a.join(b, "node").join(d, "node").groupBy("pl", "pc", "ql", "qc").agg(F.sum(1 / F.col("d")).alias("w"))
    else:
        cells = cluster_affinity(base)
    for x in cells.collect():
        m[number[x.pl, x.pc], number[x.ql, x.qc]] = x.w
    scale = np.ones(len(keys)) if matrix_free else 1 / np.sqrt(m.sum(axis=1))
    values, vectors = np.linalg.eigh(scale[:, None] * (m + m.T) / 2 * scale[None, :])
    top = vectors[:, np.argsort(-values)[:r]] * scale[:, None]
    small = spark.createDataFrame([(layer, c, j, float(top[i, j])) for (layer, c), i in number.items() for j in range(r)], "layer string, c int, k int, v double")
    lifted = base.join(F.broadcast(small), ["layer", "c"]).groupBy("node", "k").agg(F.sum("v").alias("value"))
    return clustered(row_normalized(lifted), r, restarts=restarts)

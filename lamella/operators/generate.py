"""Planted multilayer block models with node weights, drawn by hashes so that any engine draws the same graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.digests import Endings
from lamella.operators.packed import Tiled


def uniform(*parts: Column) -> Column:
    """A number from 0 (exclusive) to 1 that belongs to the parts."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


#: Pairs of nodes that a task draws at least.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Planted:
    """A scenario: n nodes in K communities of equal size and some layers.

    theta: ``exp`` (1 + 0.2 shifted exponential), ``pow`` (power law 2.5), ``one``
    (all alike) or ``two`` (0.15 and 0.8 by halves, swapped in even layers). B has p on and q off
    the diagonal; ``core``: one dense block, one sparse, and q between them;
    ``deficient``: ones but for one community's own block, another one in each layer.
    """

    n: int = 150
    k: int = 3
    layers: int = 3
    degree: float = 10.0
    theta: str = "exp"
    blocks: str = "same"
    p: float = 0.10
    q: float = 0.04
    theta_by_layer: bool = False
    seed: int = 1


#: Scenarios by name: where node weights and blocks vary between layers.
SCENARIOS = {
    "sim1": {},
    "sim2": {"blocks": "random"},
    "sim3": {"blocks": "random", "theta_by_layer": True},
    "sim4": {"theta_by_layer": True},
    "sim6": {"theta": "two"},
    "sim7": {"theta": "two", "blocks": "random"},
    "sim8": {"k": 2, "blocks": "core"},
    "sim9": {"k": 2, "blocks": "core", "theta_by_layer": True},
    "identifiability": {"blocks": "deficient", "p": 0.2},
}


def _laws(s: Planted, nodes: DataFrame | None, spark: SparkSession) -> tuple[DataFrame, DataFrame, Column, DataFrame]:
    """(node, c); (layer, node, c, theta); the density of blocks p and q; (layer, total): weights of all cells."""
    size = -(-s.n // s.k)
    if nodes is None:
        nodes = spark.range(s.n).select(F.col("id").alias("node"), F.floor(F.col("id") / size).cast("int").alias("c"))
    else:
        nodes = nodes.select("node", F.pmod("node", F.lit(s.k)).cast("int").alias("c"))
    layer = F.explode(F.sequence(F.lit(1), F.lit(s.layers))).alias("layer")
    at = nodes.select("node", "c", layer)
    u = uniform(F.lit(s.seed), F.lit("theta"), F.col("node"), F.col("layer") if s.theta_by_layer else F.lit(0))
    half = F.when((F.col("node") % size) < size // 2, 0.15).otherwise(0.8)
    raw = {"exp": -F.ln(u) + 0.2, "pow": F.pow(u, F.lit(-1 / 1.5)), "one": F.lit(1.0), "two": F.when(F.col("layer") % 2 == 1, half).otherwise(0.95 - half)}[s.theta]
    at = at.withColumn("t", raw)
    mean = at.groupBy("layer", "c").agg(F.avg("t").alias("m"))
    at = at.join(mean, ["layer", "c"]).select("layer", "node", "c", (F.col("t") / F.col("m")).alias("theta"))
    same = F.col("p") == F.col("q")
    if s.blocks == "random":
        drawn = uniform(F.lit(s.seed), F.lit("p"), F.col("layer"))
        b_pq = F.when(same, F.lit(s.q) + drawn * (2 * s.p - s.q)).otherwise(s.q)
    elif s.blocks == "core":
        b_pq = F.when(same & (F.col("p") == 0), 1.0).when(same, 0.05).otherwise(0.5)
    elif s.blocks == "deficient":
        b_pq = F.when(same & (F.col("p") == (F.col("layer") - 1) % s.k), s.p).otherwise(s.q)
    else:
        b_pq = F.when(same, s.p).otherwise(s.q)
    own = at.groupBy("layer", "c").agg(F.sum("theta").alias("t"), F.sum(F.col("theta") * F.col("theta")).alias("t2"))
    x, y = own.select("layer", F.col("c").alias("p"), F.col("t").alias("tp"), "t2"), own.select("layer", F.col("c").alias("q"), F.col("t").alias("tq"))
    total = x.join(y, "layer").withColumn("b", b_pq).groupBy("layer").agg(F.sum(F.col("b") * F.col("tp") * F.col("tq")).alias("total"))
    return nodes, at, b_pq, total


def planted(spark: SparkSession, s: Planted, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): symmetric binary edges without loops, and (node, c) with the planted communities.

    Over given nodes (node), s.n of them, the community is the remainder of the node by k.
    """
    nodes, at, b_pq, total = _laws(s, nodes, spark)
    a, b = (at.select("layer", F.col("node").alias(x), F.col("c").alias(y), F.col("theta").alias(z)) for x, y, z in (("src", "p", "ts"), ("dst", "q", "td")))
    tasks = min(4 * spark.sparkContext.defaultParallelism, 1 + s.n * s.n * s.layers // PAIRS)
    pairs = a.repartition(tasks).join(F.broadcast(b), "layer").filter("src < dst")  # the sampler draws every pair
    raw_p = pairs.withColumn("w", F.col("ts") * F.col("td") * b_pq)
    chance = raw_p.join(F.broadcast(total), "layer").withColumn("chance", F.least(F.lit(1.0), F.col("w") * s.degree * s.n / F.col("total")))
    hit = chance.filter(uniform(F.lit(s.seed), F.col("layer"), F.col("src"), F.col("dst")) < F.col("chance"))
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")  # drawn once for both directions
    edges = hit.select(F.col("layer").cast("string").alias("layer"), both).select("layer", "e.src", "e.dst", F.lit(1.0).alias("weight"))
    return edges, nodes


def planted_tiles(spark: SparkSession, s: Planted, nodes: DataFrame | None = None) -> tuple[Tiled, DataFrame]:
    """The graph of :func:`planted`, its pairs drawn by arrays in tasks and held as bits; numbers of the nodes are on the driver."""
    nodes, at, b_pq, total = _laws(s, nodes, spark)
    table = nodes.orderBy("node").toArrow()
    names, c = table.column("node").to_numpy(), table.column("c").to_numpy()
    table, theta = at.select("layer", "node", "theta").toArrow(), np.zeros((s.layers, len(names)))
    theta[table.column("layer").to_numpy() - 1, np.searchsorted(names, table.column("node").to_numpy())] = table.column("theta").to_numpy()
    b, weight = np.zeros((s.layers, s.k, s.k)), np.ones(s.layers)
    cells = spark.range(1, s.layers + 1).select(F.col("id").cast("int").alias("layer"), F.explode(F.sequence(F.lit(0), F.lit(s.k - 1))).alias("p"))
    for x in cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(s.k - 1))).alias("q")).select("layer", "p", "q", b_pq.alias("b")).collect():
        b[x.layer - 1, x.p, x.q] = x.b
    for x in total.collect():
        weight[x.layer - 1] = x.total
    return Tiled(spark, names, [str(k + 1) for k in range(s.layers)], Drawn(s, names, c, theta, b, weight)), nodes


@dataclass
class Drawn:
    """The draws of :func:`planted` for a node and those after it."""

    s: Planted
    names: np.ndarray
    c: np.ndarray
    theta: np.ndarray
    b: np.ndarray
    total: np.ndarray

    @cached_property
    def endings(self) -> Endings:
        return Endings([str(x) for x in self.names.tolist()])

    def __call__(self, k: int, i: int, a: int, b: int) -> np.ndarray:
        w = self.theta[k, i] * self.theta[k, a:b] * self.b[k, self.c[i]][self.c[a:b]]
        return self.endings.uniform(f"{self.s.seed}:{k + 1}:{self.names[i]}:", a, b) < np.minimum(1.0, w * self.s.degree * self.s.n / self.total[k])

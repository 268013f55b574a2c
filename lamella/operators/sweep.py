"""One parallel sweep of the joint factorization: every node moves given the old state of all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.scalars import quartic_minimum
from lamella.operators.blocks import gathered
from lamella.operators.edges import degrees
from lamella.operators.incidence import Incidence
from lamella.operators.packed import Packed


def coefficients(edges: DataFrame | Incidence | Packed, weights: DataFrame, blocks: DataFrame, r: int, shared: bool = False) -> DataFrame:
    """(layer, node, k, a4, c1, c0): the quartic of each node with edges, for each community k.

    Neighbours are summed by their community before they meet the interactions,
    so the work is per node and community, not per edge and community. ``shared``:
    one weight for all layers, so the coefficients are summed over them (layer: null).
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(r - 1)))
    cells = blocks.select("layer").distinct().withColumn("p", every).withColumn("q", every)
    s = cells.join(blocks, ["layer", "p", "q"], "left").select("layer", F.col("p").cast("int"), F.col("q").cast("int"), F.coalesce("s", F.lit(0.0)).alias("s"))
    s = F.broadcast(s)  # layers * r * r rows
    norm = weights.groupBy("layer", F.col("c").alias("p")).agg(F.sum(F.col("w") * F.col("w")).alias("n2"))
    total = norm.join(s, ["layer", "p"]).groupBy("layer", F.col("q").alias("k")).agg(F.sum(F.col("n2") * F.col("s") * F.col("s")).alias("total"))
    diagonal = s.filter("p = q").select("layer", F.col("p").alias("k"), F.col("s").alias("skk"))
    pull = gathered(edges, weights, loops=False).join(s, ["layer", "p"]).groupBy("layer", "node", F.col("q").alias("k")).agg((-4 * F.sum(F.col("g") * F.col("s"))).alias("c0"))
    live = degrees(edges).filter("deg <> 0").select("layer", "node")
    state = live.join(weights, ["layer", "node"])
    if isinstance(edges, Incidence):
        state = state.withColumn("loop", F.lit(0.0))
    else:
        loops = edges.loops() if isinstance(edges, Packed) else edges.filter("src = dst").groupBy("layer", F.col("src").alias("node")).agg(F.sum("weight").alias("loop"))
        state = state.join(loops, ["layer", "node"], "left").withColumn("loop", F.coalesce("loop", F.lit(0.0)))
    own = state.join(s.withColumnRenamed("q", "k").withColumnRenamed("p", "c"), ["layer", "c"])
    full = own.join(F.broadcast(total), ["layer", "k"]).join(F.broadcast(diagonal), ["layer", "k"]).join(pull, ["layer", "node", "k"], "left")
    before = F.col("w") * F.col("s")
    out = full.select("layer", "node", "k", (F.col("skk") * F.col("skk")).alias("a4"), (2 * (F.col("total") - before * before) - 2 * F.col("skk") * F.col("loop")).alias("c1"), F.coalesce("c0", F.lit(0.0)).alias("c0"))
    if shared:
        out = out.groupBy("node", "k").agg(*(F.sum(c).alias(c) for c in ("a4", "c1", "c0"))).withColumn("layer", F.lit(None).cast("string"))
    return out


def moves(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, c, cost, w): the community of least total cost, ties to the smaller one, and its weights by layer.

    Costs are rounded to nine places before they are compared. A node without
    edges goes to community 0.
    """
    solved = quartic_minimum(found.withColumn("_a", 4 * F.col("a4")).withColumn("_c", 2 * F.col("c1")), "_a", "_c", "c0")
    by = solved.groupBy("node", "k").agg(F.round(F.sum("f"), 9).alias("cost"), F.collect_list(F.struct("layer", F.col("x").alias("w"))).alias("w"))
    best = by.groupBy("node").agg(F.min_by(F.struct("k", "cost", "w"), F.struct("cost", "k")).alias("b"))
    return nodes.join(best, "node", "left").select("node", F.coalesce("b.k", F.lit(0)).cast("int").alias("c"), F.coalesce("b.cost", F.lit(0.0)).alias("cost"), F.col("b.w").alias("w"))


def moved_weights(moved: DataFrame, layers: list[str]) -> DataFrame:
    """(layer, node, c, w) of :func:`moves`, 0 where a node has no edges in the layer. A shared weight goes to all layers."""
    grid = moved.select("node", "c", F.coalesce("w", F.array()).alias("w"), F.explode(F.array(*map(F.lit, layers))).alias("layer"))
    own = F.filter("w", lambda x: x["layer"].isNull() | (x["layer"] == F.col("layer")))
    return grid.select("layer", "node", "c", F.coalesce(F.get(own, F.lit(0))["w"], F.lit(0.0)).alias("w"))

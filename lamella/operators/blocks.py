"""Community sums, weights and block models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.scalars import residual, safe_div
from lamella.operators.edges import degrees, norms, without_loops
from lamella.operators.incidence import Incidence
from lamella.operators.packed import Packed


def community_mass(edges: DataFrame | Incidence | Packed, part: DataFrame) -> DataFrame:
    """(layer, c, mass): degrees summed by community."""
    return degrees(edges).join(part, "node").groupBy("layer", "c").agg(F.sum("deg").alias("mass"))


def degree_share(edges: DataFrame | Incidence | Packed, part: DataFrame, nodes: DataFrame, layers: list[str]) -> DataFrame:
    """(layer, node, c, w): each degree as a share of its community's; 0 where that is 0."""
    deg = degrees(edges, nodes, layers).join(part, "node")
    total = community_mass(edges, part)
    return deg.join(F.broadcast(total), ["layer", "c"], "left").select("layer", "node", "c", safe_div(F.col("deg"), F.coalesce("mass", F.lit(0.0))).alias("w"))  # layers * communities rows


def unit_weights(weights: DataFrame) -> DataFrame:
    """Weights (layer, node, c, w) with norm 1 in each community of each layer; 0 where the norm is 0."""
    norm = weights.groupBy("layer", "c").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(F.broadcast(norm), ["layer", "c"]).select("layer", "node", "c", safe_div(F.col("w"), F.col("norm")).alias("w"))  # layers * communities rows


def gathered(edges: DataFrame | Incidence | Packed, weights: DataFrame, loops: bool = True) -> DataFrame:
    """(layer, node, p, g): the neighbours of each node, summed by their community. loops: a node with a loop is its own neighbour."""
    if not isinstance(edges, DataFrame):
        own = weights.select("layer", "node", F.col("c").alias("k"), F.col("w").alias("value"))
        return (edges.times(own) if isinstance(edges, Incidence) else edges.times(own, loops)).select("layer", "node", F.col("k").alias("p"), F.col("value").alias("g"))
    edges = edges if loops else without_loops(edges)
    near = weights.select("layer", F.col("node").alias("dst"), F.col("c").alias("p"), "w")
    return edges.join(near, ["layer", "dst"]).groupBy("layer", F.col("src").alias("node"), "p").agg(F.sum(F.col("weight") * F.col("w")).alias("g"))


def block_sums(edges: DataFrame | Incidence | Packed, weights: DataFrame) -> DataFrame:
    """(layer, p, q, s): sum of w_i w_j x_ij between communities, Z'XZ."""
    a = weights.select("layer", "node", F.col("c").alias("p"), F.col("w").alias("wp"))
    # Summed by source node and community first, the second join has a row for each node and community, not for each edge.
    half = gathered(edges, weights).withColumnRenamed("p", "q")
    return half.join(a, ["layer", "node"]).groupBy("layer", "p", "q").agg(F.sum(F.col("g") * F.col("wp")).alias("s"))


def block_means(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(layer, p, q, b): edge weight between communities over the number of their pairs of nodes."""
    a, b = part.select(F.col("node").alias("src"), F.col("c").alias("p")), part.select(F.col("node").alias("dst"), F.col("c").alias("q"))
    sums = edges.join(a, "src").join(b, "dst").groupBy("layer", "p", "q").agg(F.sum("weight").alias("s"))
    sizes = part.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    sized = sums.join(sizes.select(F.col("c").alias("p"), F.col("n").alias("np")), "p").join(sizes.select(F.col("c").alias("q"), F.col("n").alias("nq")), "q")
    return sized.select("layer", "p", "q", (F.col("s") / (F.col("np") * F.col("nq"))).alias("b"))


def degree_corrections(edges: DataFrame, part: DataFrame, nodes: DataFrame, layers: list[str]) -> DataFrame:
    """(layer, node, c, theta): degrees over the mean degree of their communities."""
    deg = degrees(edges, nodes, layers).join(part, "node")
    size = part.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    mean = community_mass(edges, part).join(size, "c").select("layer", "c", (F.col("mass") / F.col("size")).alias("mean"))
    return deg.join(F.broadcast(mean), ["layer", "c"], "left").select("layer", "node", "c", safe_div(F.col("deg"), F.coalesce("mean", F.lit(0.0))).alias("theta"))


def block_density(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(layer, p, q, density): as :func:`block_means` for every two communities with p <= q, 0 where there are no edges."""
    c = part.select("c").distinct()
    cells = c.select(F.col("c").alias("p")).join(c.select(F.col("c").alias("q")), F.col("p") <= F.col("q"))  # pairs of communities
    every = edges.select("layer").distinct().crossJoin(F.broadcast(cells))
    return every.join(block_means(edges, part), ["layer", "p", "q"], "left").select("layer", "p", "q", F.coalesce("b", F.lit(0.0)).alias("density"))


def normalized_blocks(means: DataFrame) -> DataFrame:
    """(layer, p, q, b): block means with a unit diagonal."""
    diagonal = means.filter("p = q").select("layer", "p", F.col("b").alias("d"))
    out = means.join(diagonal.withColumnRenamed("d", "dp"), ["layer", "p"]).join(diagonal.select("layer", F.col("p").alias("q"), F.col("d").alias("dq")), ["layer", "q"])
    return out.select("layer", "p", "q", safe_div(F.col("b"), F.sqrt(F.col("dp") * F.col("dq"))).alias("b"))


def normalized_corrections(theta: DataFrame, means: DataFrame) -> DataFrame:
    """Degree corrections times the root of their community's own block mean."""
    diagonal = means.filter("p = q").select("layer", F.col("p").alias("c"), "b")
    return theta.join(diagonal, ["layer", "c"], "left").select("layer", "node", "c", (F.col("theta") * F.sqrt(F.coalesce("b", F.lit(0.0)))).alias("theta"))


def reconstruction(edges: DataFrame | Incidence | Packed, blocks: DataFrame) -> DataFrame:
    """(layer, norm2, s2, error): how far Z S Z' is from each layer, without forming it."""
    s2 = blocks.groupBy("layer").agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    both = norms(edges).join(s2, "layer", "left").withColumn("s2", F.coalesce("s2", F.lit(0.0)))
    return both.withColumn("error", residual(F.col("norm2"), F.col("s2")))


def relative_error(parts: DataFrame) -> DataFrame:
    """(error): of all layers together."""
    return parts.agg(F.sqrt(F.sum(F.col("error") * F.col("error")) / F.sum("norm2")).alias("error"))


def by_total_degree(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(node, c, rank): communities numbered from 1 by descending total degree, ties by the smaller number."""
    mass = part.join(edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("d")), "node", "left").groupBy("c").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("mass"))
    order = mass.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mass"), "c")))  # a row for each community
    return part.join(F.broadcast(order.select("c", "rank")), "c").select("node", "c", "rank")

"""Projections, set operations and normalisations of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.scalars import safe_div
from lamella.operators.incidence import Incidence
from lamella.operators.packed import Packed


def symmetrized(half: DataFrame, how: str = "sum") -> DataFrame:
    """Both directions of every edge; cells that meet are summed, or the larger one stays (``max``). A loop is itself once."""
    back = half.filter("src <> dst").select("layer", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = half.select("layer", "src", "dst", "weight").unionAll(back)
    return both.groupBy("layer", "src", "dst").agg((F.max if how == "max" else F.sum)("weight").alias("weight"))


def mirrored(half: DataFrame) -> DataFrame:
    """Both directions of edges that are listed once each, without loops: a union, no shuffle."""
    one = half.select("layer", "src", "dst", "weight")
    return one.unionAll(one.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def binarized(edges: DataFrame) -> DataFrame:
    """Weight 1 for every positive cell, once each."""
    return edges.filter("weight > 0").select("layer", "src", "dst").distinct().withColumn("weight", F.lit(1.0))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def upper(edges: DataFrame) -> DataFrame:
    return edges.filter("src < dst")


def clamped(edges: DataFrame) -> DataFrame:
    """Negative weights as 0, and zero cells left out."""
    return edges.withColumn("weight", F.greatest("weight", F.lit(0.0))).filter("weight > 0")


def layers_of(edges: DataFrame | Incidence | Packed) -> list[str]:
    """The layers in order: one row for each comes to the driver."""
    if not isinstance(edges, DataFrame):
        return edges.layers
    return [r.layer for r in edges.select("layer").distinct().orderBy("layer").collect()]


def everywhere(nodes: DataFrame, layers: list[str]) -> DataFrame:
    """(layer, node) for every node in every layer."""
    return nodes.select(F.explode(F.array(*map(F.lit, layers))).alias("layer"), "node") if layers else nodes.select(F.lit(None).cast("string").alias("layer"), "node").limit(0)


def degrees(edges: DataFrame | Incidence | Packed, nodes: DataFrame | None = None, layers: list[str] | None = None) -> DataFrame:
    """(layer, node, deg): row sums; with ``nodes`` also those without edges, as 0."""
    own = edges.degrees() if not isinstance(edges, DataFrame) else edges.groupBy("layer", F.col("src").alias("node")).agg(F.sum("weight").alias("deg"))
    if nodes is None:
        return own
    return everywhere(nodes, layers if layers is not None else layers_of(edges)).join(own, ["layer", "node"], "left").withColumn("deg", F.coalesce("deg", F.lit(0.0)))


def norms(edges: DataFrame | Incidence | Packed) -> DataFrame:
    """(layer, norm2): squared Frobenius norms."""
    if not isinstance(edges, DataFrame):
        return edges.norms()
    return edges.groupBy("layer").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm2"))


def layer_sum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def layer_mean(edges: DataFrame, layers: int) -> DataFrame:
    return layer_sum(edges).withColumn("weight", F.col("weight") / layers)


def normalized(edges: DataFrame, nodes: int, tau_fraction: float = 1.0) -> DataFrame:
    """D^-1/2 A D^-1/2 with D the degrees plus tau, a fraction of the layer's mean degree over all nodes."""
    deg = degrees(edges)
    tau = deg.groupBy("layer").agg((F.sum("deg") / nodes * tau_fraction).alias("tau"))
    reg = deg.join(F.broadcast(tau), "layer").select("layer", "node", F.sqrt(F.col("deg") + F.col("tau")).alias("d"))  # tau: one row for each layer
    out = edges.join(reg.select("layer", F.col("node").alias("src"), F.col("d").alias("ds")), ["layer", "src"])
    out = out.join(reg.select("layer", F.col("node").alias("dst"), F.col("d").alias("dd")), ["layer", "dst"])
    return out.select("layer", "src", "dst", safe_div(F.col("weight"), F.col("ds") * F.col("dd")).alias("weight"))


def squared_without_degrees(edges: DataFrame) -> DataFrame:
    """Sum over layers of A'A less the degrees on the diagonal."""
    a = edges.select("layer", F.col("dst").alias("mid"), F.col("src").alias("i"), F.col("weight").alias("wa"))
    b = edges.select("layer", F.col("src").alias("mid"), F.col("dst").alias("j"), F.col("weight").alias("wb"))
    walks = a.join(b, ["layer", "mid"]).groupBy("i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("weight"))
    less = edges.groupBy(F.col("src").alias("i")).agg(F.sum("weight").alias("d")).select("i", F.col("i").alias("j"), (-F.col("d")).alias("weight"))
    return walks.unionByName(less).groupBy(F.col("i").alias("src"), F.col("j").alias("dst")).agg(F.sum("weight").alias("weight")).filter("weight <> 0")


def augmented(edges: DataFrame, nodes: int) -> DataFrame:
    """With loops of degree / (n - 1) in place of the diagonal."""
    loops = degrees(without_loops(edges)).select("layer", F.col("node").alias("src"), F.col("node").alias("dst"), (F.col("deg") / (nodes - 1)).alias("weight"))
    return without_loops(edges).select("layer", "src", "dst", "weight").unionAll(loops)


def topmost(df: DataFrame, key: str, by: list[str], tie: str, k: int) -> DataFrame:
    """The k first rows of each key by descending columns, ties by the smaller ``tie``."""
    order = Window.partitionBy(key).orderBy(*(F.desc(c) for c in by), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

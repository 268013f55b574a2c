"""Agreement of partitions and quality of communities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.assignment import cheapest_assignment


def contingency(labels: DataFrame) -> DataFrame:
    """(a, b, n) of labels (a, b); rows with a missing label do not count."""
    return labels.filter("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def agreement(labels: DataFrame) -> DataFrame:
    """(nmi, nmi_geometric, ari) in one row, from the contingency table.

    Two partitions with one part each agree fully; the geometric form is at least 0.
    """
    t = contingency(labels).withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b")))
    total = t.agg(F.sum("n").cast("double").alias("t"))
    pairs = lambda x: x * (x - 1) / 2
    own = t.join(F.broadcast(total))  # one row
    share = F.col("n") / F.col("t")
    # Each row of the table carries its part n / na of the row's entropy, so one pass sums all of them.
    ha, hb = -share * F.ln(F.col("na") / F.col("t")), -share * F.ln(F.col("nb") / F.col("t"))
    sums = own.agg(
        F.max("t").alias("t"),
        F.sum(share * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"),
        F.sum(ha).alias("ha"),
        F.sum(hb).alias("hb"),
        F.sum(pairs(F.col("n").cast("double"))).alias("ij"),
        F.sum(F.col("n") * (F.col("na") - 1) / 2).alias("i"),
        F.sum(F.col("n") * (F.col("nb") - 1) / 2).alias("j"),
    )
    expected = F.col("i") * F.col("j") / F.nullif(pairs(F.col("t")), F.lit(0.0))
    flat = (F.col("ha") < 1e-15) & (F.col("hb") < 1e-15)
    most = (F.col("i") + F.col("j")) / 2
    return sums.filter("t is not null").select(
        F.when(flat, 1.0).otherwise(2 * F.col("mi") / F.nullif(F.col("ha") + F.col("hb"), F.lit(0.0))).alias("nmi"),
        F.when(flat, 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.col("mi") / F.nullif(F.sqrt(F.col("ha") * F.col("hb")), F.lit(0.0)), F.lit(0.0)))).alias("nmi_geometric"),
        F.when(F.coalesce(most == expected, F.lit(True)), 1.0).otherwise((F.col("ij") - expected) / F.nullif(most - expected, F.lit(0.0))).alias("ari"),
    )


def misclassified(labels: DataFrame) -> DataFrame:
    """(error): the share of rows outside the best one-to-one matching of labels."""
    rows = contingency(labels).collect()  # as many as pairs of labels
    spark = labels.sparkSession
    if not rows:
        return spark.createDataFrame([], "error double")
    a, b = sorted({r.a for r in rows}), sorted({r.b for r in rows})
    k = max(len(a), len(b))
    table = np.zeros((k, k))
    for r in rows:
        table[a.index(r.a), b.index(r.b)] = r.n
    return spark.createDataFrame([(float(1 + cheapest_assignment(-table)[1] / table.sum()),)], "error double")


def modularity(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(layer, c, q): each community's share of the modularity of directed weighted edges."""
    a, b = part.select(F.col("node").alias("src"), F.col("c").alias("p")), part.select(F.col("node").alias("dst"), F.col("c").alias("q"))
    cells = edges.join(a, "src").join(b, "dst").groupBy("layer", "p", "q").agg(F.sum("weight").alias("s"))
    m = cells.groupBy("layer").agg(F.sum("s").alias("m"))
    out = cells.groupBy("layer", F.col("p").alias("c")).agg(F.sum("s").alias("out"), F.sum(F.when(F.col("p") == F.col("q"), F.col("s")).otherwise(0.0)).alias("own"))
    into = cells.groupBy("layer", F.col("q").alias("c")).agg(F.sum("s").alias("into"))
    both = out.join(into, ["layer", "c"], "full").fillna(0.0).join(F.broadcast(m), "layer")
    return both.select("layer", "c", (F.col("own") / F.col("m") - F.col("out") * F.col("into") / (F.col("m") * F.col("m"))).alias("q"))


def weight_change(now: DataFrame, before: DataFrame) -> DataFrame:
    """(z_change, frac_changed) between two states (layer, node, c, w)."""
    b = before.select("layer", "node", F.col("c").alias("c0"), F.col("w").alias("w0"))
    both = now.join(b, ["layer", "node"])
    d = F.when(F.col("c") == F.col("c0"), F.pow(F.col("w") - F.col("w0"), 2)).otherwise(F.col("w") * F.col("w") + F.col("w0") * F.col("w0"))
    return both.agg(F.sqrt(F.sum(d) / F.sum(F.col("w0") * F.col("w0"))).alias("z_change"), F.avg((F.col("c") != F.col("c0")).cast("double")).alias("frac_changed"))

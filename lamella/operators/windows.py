"""Operators on ordered values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def elbow(values: DataFrame, group: str = "layer", value: str = "value", tie: str = "node") -> DataFrame:
    """(group, q): after how many of the descending values the profile likelihood of two normal groups is largest.

    Both groups share one variance; ties go to the smaller q. One window of
    running sums for each group of values.
    """
    order = Window.partitionBy(group).orderBy(F.desc(value), tie)
    run = values.select(group, value, F.row_number().over(order).alias("q"), F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.sum(F.col(value) * F.col(value)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("s2"))
    every = Window.partitionBy(group)
    run = run.select(group, "q", "s", "s2", F.count(F.lit(1)).over(every).alias("p"), F.max(F.struct("q", "s", "s2")).over(every).alias("t"))
    rest, q, p = F.col("p") - F.col("q"), F.col("q"), F.col("p")
    spread = F.col("s2") - F.col("s") * F.col("s") / q + F.when(rest > 0, F.col("t.s2") - F.col("s2") - F.pow(F.col("t.s") - F.col("s"), 2) / F.nullif(rest, F.lit(0))).otherwise(0.0)
    sigma2 = F.greatest(spread, F.lit(0.0)) / F.nullif(p - 1 - F.when(q < p, 1).otherwise(0), F.lit(0))
    likelihood = -p / 2 * F.ln(2 * math.pi * F.nullif(sigma2, F.lit(0.0))) - spread / (2 * F.nullif(sigma2, F.lit(0.0)))
    return run.withColumn("l", F.round(likelihood, 9)).filter("l is not null").groupBy(group).agg(F.max_by("q", F.struct("l", -F.col("q"))).alias("q"))


def elbows(values: DataFrame, n: int, group: str = "layer", value: str = "value", tie: str = "node") -> DataFrame:
    """(group, number, q): the next elbow is looked for among the values after the last one, up to ``n`` of them."""
    order = Window.partitionBy(group).orderBy(F.desc(value), tie)
    ranked = values.withColumn("_at", F.row_number().over(order))
    out, left, done = None, ranked, None
    for i in range(1, n + 1):
        found = elbow(left, group, value, tie)
        if done is not None:
            found = found.join(done, group).select(group, (F.col("q") + F.col("base")).alias("q"))
        own = found.select(group, F.lit(i).alias("number"), "q")
        out = own if out is None else out.unionByName(own)
        done = found.select(group, F.col("q").alias("base"))
        left = ranked.join(done, group).filter("_at > base").drop("base")
    return out

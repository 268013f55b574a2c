"""Writers of graphs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_graphml(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """GraphML of all layers in text files whose names sort in the order of its lines; the layer as the edge's weight; loops go, each undirected edge is written once."""
    order = edges.select("layer").distinct().orderBy("layer").collect()  # one row for each layer
    number = F.create_map(*[F.lit(x) for i, r in enumerate(order) for x in (r.layer, i + 1)])[F.col("layer")] if order else F.lit(1)
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>', '<graph id="G" edgedefault="undirected">']
    spark = edges.sparkSession
    text = lambda rows, at: spark.createDataFrame([(at, i, x) for i, x in enumerate(rows)], "part int, n long, value string")
    body = nodes.select(F.lit(1).alias("part"), F.col("node").cast("long").alias("n"), F.format_string('<node id="n%d"/>', "node").alias("value"))
    links = edges.filter("src < dst").select(F.lit(2).alias("part"), F.col("src").alias("n"), F.format_string('<edge source="n%d" target="n%d"><data key="weight">%d</data></edge>', "src", "dst", number).alias("value"))
    every = text(head, 0).unionAll(body).unionAll(links).unionAll(text(["</graph>", "</graphml>"], 3))
    _ordered(every).write.mode("overwrite").text(path)


def _ordered(lines: DataFrame) -> DataFrame:
    """Lines in order, in files whose names sort in that order."""
    return lines.repartitionByRange("part", "n", "value").sortWithinPartitions("part", "n", "value").select("value")


def write_table(results: DataFrame, path: str, tab: bool = False) -> None:
    """CSV, or tab-separated, with a header."""
    results.write.mode("overwrite").csv(path, header=True, sep="\t" if tab else ",")


def write_trace(history: DataFrame, path: str) -> None:
    """One JSON line for each trial, with its iterations in order."""
    columns = [c for c in history.columns if c != "trial"]
    history.groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("iteration", *(c for c in columns if c != "iteration")))).alias("iterations")).write.mode("overwrite").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Parquet, with the types of the columns."""
    results.write.mode("overwrite").parquet(path)

"""Layered graphs from tables and files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.edges import mirrored, symmetrized, topmost
from lamella.plans.lineage import cut

EDGE_LIST = T.StructType([T.StructField(x, T.StringType()) for x in ("source", "target", "layer")])
NODE_LIST = T.StructType([T.StructField(x, T.StringType()) for x in ("node", "group", "role")])
CONTACTS = T.StructType([T.StructField("time", T.DoubleType()), *(T.StructField(x, T.StringType()) for x in ("id1", "id2", "class1", "class2"))])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coactivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with events of one type in the same hours; a layer for each type, weight: hours shared."""
    seen = read(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), F.date_trunc("hour", "ts").alias("h"), F.col("user_id").alias("node")).filter("node is not null").distinct()
    a, b = seen.withColumnRenamed("node", "src"), seen.withColumnRenamed("node", "dst")
    half = a.join(b, ["layer", "h"]).filter("src < dst").groupBy("layer", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return mirrored(half)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, slot, node): the hours in which users have events of each type; :func:`coactivity` joins the users of one slot."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), F.date_trunc("hour", "ts").alias("slot"), F.col("user_id").alias("node"))


def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`activity` with a layer for each UTC day and all types together."""
    hours = read(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("slot"), F.col("user_id").alias("node"))
    return hours.select(F.date_format("slot", "yyyy-MM-dd").alias("layer"), "slot", "node")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("node")).filter("node is not null").distinct()


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`coactivity` with a layer for each UTC day and all types together, weight 1."""
    seen = read(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("h"), F.col("user_id").alias("node")).filter("node is not null").distinct()
    a, b = seen.withColumnRenamed("node", "src"), seen.withColumnRenamed("node", "dst")
    half = a.join(b, "h").filter("src < dst").select(F.date_format("h", "yyyy-MM-dd").alias("layer"), "src", "dst").distinct()
    return mirrored(half.withColumn("weight", F.lit(1.0)))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items between the nations of customer and supplier, a layer for each return flag, directed counts."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    joined = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("l_returnflag").alias("layer"), "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


#: Bytes of vectors that are sent to every task at once.
BLOCK_BYTES = 32 << 20


def nearest_by_cosine(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(src, dst, sim, rank): the k nearest other rows of each row; ties by the smaller id.

    Exact: all rows meet all blocks of rows, a block of bounded size at a time, as
    products of matrices; each task keeps its rows' k nearest of a block. A vector
    of zeros is near to none and has a similarity of null, last in order.
    """
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-size.n * (size.d or 1) * 8 // block_bytes))
    block_of, sc, out = F.pmod(F.xxhash64("id"), F.lit(blocks)), rows.sparkSession.sparkContext, None

    def unit(table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column(0).to_numpy()
        x = np.array(table.column(1).to_pylist(), dtype=float).reshape(len(ids), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            return ids, x / norm

    for b in range(blocks):
        ids, x = unit(rows.filter(block_of == b).orderBy("id").toArrow())
        sent = sc.broadcast((ids, x))

        def nearest(batches, sent=sent):
            ids, x = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows if len(ids) else 0, 512):
                    own, y = unit(batch.slice(at, 512))
                    sim = np.round(y @ x.T, 9)
                    sim[own[:, None] == ids[None, :]] = -np.inf
                    sim = np.where(np.isnan(sim), -2.0, sim)
                    top = np.argsort(-sim, axis=1, kind="stable")[:, :k]  # ids are in order, so ties go to the smaller one
                    found = np.take_along_axis(sim, top, axis=1)
                    kept = np.isfinite(found)
                    values = found[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, top.shape[1])[kept.ravel()]), pa.array(ids[top][kept]), pa.array(values, mask=values == -2.0)], ["src", "dst", "sim"])

        part = rows.mapInArrow(nearest, "src long, dst long, sim double")
        part = cut(part) if blocks > 1 else part
        out = part if out is None else out.unionAll(part)
    return topmost(out, "src", ["sim"], "dst", k)


def numbered(nodes: DataFrame, name: str = "node") -> DataFrame:
    """(node_id, name): dense ids from 0 in the order of the names.

    Names are dealt out by ranges; a range's first id is the count of the names
    before it, so no task sees more than a range.
    """
    names = nodes.select(F.col(name).alias("name")).distinct()
    parts = max(1, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(names.repartitionByRange(parts, "name").sortWithinPartitions("name").withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    first, total = [], 0
    for part in sorted(sizes):
        first.append((part, total))
        total += sizes[part]
    starts = names.sparkSession.createDataFrame(first, "part int, first long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    return ranged.withColumn("place", place).join(F.broadcast(starts), "part").select((F.col("first") + F.col("place") - 1).alias("node_id"), "name")


def read_edge_list(spark: SparkSession, edge_file: str, node_file: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a CSV edge list (source, target, layer) and node list (node, group, role).

    Edges are made symmetric and binary; self loops go. A group G<k> gives the
    label k, any other group none. An endpoint without a node row is an error.
    """
    listed = spark.read.csv(node_file, header=True, schema=NODE_LIST)
    ids = numbered(listed)
    label = F.regexp_extract("group", r"^G(\d+)$", 1)
    nodes = listed.join(ids, listed["node"] == ids["name"]).select("node_id", "name", F.when(label != "", label.cast("int")).alias("label"), "role")
    pairs = spark.read.csv(edge_file, header=True, schema=EDGE_LIST)
    return _named(pairs, ids, "source", "target").filter("src <> dst").distinct().withColumn("weight", F.lit(1.0)), nodes


def _named(pairs: DataFrame, ids: DataFrame, a: str, b: str) -> DataFrame:
    ends = pairs.select(F.col(a).alias("name")).unionAll(pairs.select(F.col(b).alias("name"))).distinct()
    if ends.join(ids, "name", "left_anti").limit(1).count():
        raise ValueError("an edge names a node that is not in the node list")
    one = pairs.join(ids.select(F.col("name").alias(a), F.col("node_id").alias("src")), a).join(ids.select(F.col("name").alias(b), F.col("node_id").alias("dst")), b)
    both = one.select("layer", "src", "dst")
    return both.unionAll(both.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst")))


def contact_layers(contacts: DataFrame, people: DataFrame, zone: str = "Europe/Paris") -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a contact log (time in epoch seconds, id1, id2, ...) and people (id, class, gender).

    A layer for each local day; self contacts go, repeated ones count once. Empty
    logs, missing times, ids or classes, repeated people and unknown ids are errors.
    """
    bad = contacts.filter("time is null or isnan(time) or id1 is null or id2 is null")
    if not contacts.limit(1).count() or bad.limit(1).count():
        raise ValueError("the contact log is empty or has missing values")
    if people.filter("id is null or class is null").limit(1).count() or people.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("people need distinct ids and a class")
    cleaned = people.select(F.col("id").alias("node"), F.when(F.lower(F.trim("class")).isin("teacher", "teachers"), "teachers").otherwise(F.trim("class")).alias("class"))
    classes = numbered(cleaned, "class").select(F.col("name").alias("class"), (F.col("node_id") + 1).cast("int").alias("label"))
    ids = numbered(cleaned)
    nodes = cleaned.join(classes, "class").join(ids, cleaned["node"] == ids["name"]).select("node_id", "name", "label")
    day = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(F.floor("time")), zone), "yyyy-MM-dd")
    edges = _named(contacts.select(day.alias("layer"), "id1", "id2"), ids, "id1", "id2").filter("src <> dst").distinct()
    return edges.withColumn("weight", F.lit(1.0)), nodes


def citation_layers(papers: DataFrame, cites: DataFrame, classes: list[str], k: int = 20) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of papers (id, features, class) of some classes: a layer of citations and one of similar features."""
    kept = papers.filter(F.col("class").isin(classes))
    ids = numbered(kept.select(F.col("id").cast("string").alias("node")))
    own = kept.join(ids, kept["id"].cast("string") == ids["name"])
    near = nearest_by_cosine(own, k, "node_id", "features").select(F.lit("similar").alias("layer"), "src", "dst", F.lit(1.0).alias("weight"))
    both = cites.select(F.col("cited").cast("string").alias("a"), F.col("citing").cast("string").alias("b"))
    both = both.join(ids.select(F.col("name").alias("a")), "a", "left_semi").join(ids.select(F.col("name").alias("b")), "b", "left_semi")
    cited = _named(both.withColumn("layer", F.lit("cites")), ids, "a", "b").filter("src <> dst").distinct().withColumn("weight", F.lit(1.0))
    ranks = {c: i + 1 for i, c in enumerate(sorted(classes))}
    label = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col("class")]
    return cited.unionByName(symmetrized(near, "max")), own.select("node_id", "name", label.cast("int").alias("label"))


def layered_triples(lines: DataFrame) -> DataFrame:
    """Edges of text lines ``layer i j`` with numbers from 1, binary and symmetric, ids from 0."""
    x = F.split(F.trim("value"), r"\s+")
    half = lines.filter(F.trim("value") != "").select(x[0].cast("int").cast("string").alias("layer"), (x[1].cast("long") - 1).alias("src"), (x[2].cast("long") - 1).alias("dst"))
    return symmetrized(half.filter("src <> dst").withColumn("weight", F.lit(1.0)), "max")


def triplets(rows: DataFrame, binary: bool = True) -> DataFrame:
    """Edges of exported sparse matrices (layer, i, j, x): negative cells count as 0, a cell that is not finite is an error; the diagonal goes."""
    if rows.filter("x is null or isnan(x) or abs(x) = double('infinity')").limit(1).count():
        raise ValueError("cells must be finite")
    kept = rows.filter("x > 0 and i <> j").select(F.col("layer").cast("string").alias("layer"), F.col("i").cast("long").alias("src"), F.col("j").cast("long").alias("dst"), F.col("x").cast("double").alias("weight"))
    return kept.withColumn("weight", F.lit(1.0)) if binary else kept


def known_labels(labels: DataFrame, limit: float = 1e9) -> DataFrame:
    """(node, label) without the sentinels beyond ``limit``."""
    return labels.filter(F.abs("label") < limit)


def single_layer(edges: DataFrame) -> DataFrame:
    """Edges in the engine's types; a table without a layer column has the layer 0. Negative or missing weights are an error."""
    missing = {"src", "dst"} - set(edges.columns)
    if missing:
        raise TypeError(f"edges need the columns src and dst, not found: {sorted(missing)}")
    layer = F.col("layer").cast("string") if "layer" in edges.columns else F.lit("0")
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    out = edges.select(layer.alias("layer"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"))
    if out.filter("weight is null or weight < 0 or isnan(weight)").limit(1).count():
        raise ValueError("weights must be nonnegative numbers")
    return out

"""Listed graphs packed by rows against the same graphs as edges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lamella import queries
from lamella.functions import digests
from lamella.operators import blocks, edges, generate, linear, packed, sweep
from lamella.plans import exact, fit, lineage

#: Loops, a repeated edge, one negative weight, node 9 without edges, and a layer of equal weights.
CELLS = [("a", 1, 2, 0.5), ("a", 2, 1, 0.5), ("a", 3, 3, 2.0), ("a", 1, 3, 1.5), ("a", 3, 1, 1.5), ("a", 1, 3, 1.0), ("a", 3, 1, 1.0), ("b", 2, 7, 1.0), ("b", 7, 2, 1.0), ("b", 7, 7, 1.0), ("a", 2, 7, -0.25), ("a", 7, 2, -0.25)]


def rows(df):
    return sorted((*(x for x in r if not isinstance(x, float)), *(round(x, 9) for x in r if isinstance(x, float))) for r in df.collect() if not (isinstance(r[-1], float) and r[-1] == 0))


@pytest.fixture
def graph(spark, monkeypatch):
    monkeypatch.setattr(packed, "DEALT", 3)
    monkeypatch.setattr(packed, "CELLS", 10)
    e = spark.createDataFrame(CELLS, "layer string, src long, dst long, weight double").repartition(3)
    nodes = spark.createDataFrame([(x,) for x in (1, 2, 3, 7, 9)], "node long")
    return e, nodes, packed.Packed(e, nodes)


def test_same_as_edges(graph):
    e, nodes, p = graph
    assert p.complete and p.layers == ["a", "b"]
    w = edges.everywhere(nodes, ["a", "b"]).select("layer", "node", (F.col("node") % 2).cast("int").alias("c"), (F.col("node") / 4).alias("w"))
    s = blocks.block_sums(e, w)
    for f in (edges.degrees, edges.norms, lambda x: blocks.gathered(x, w), lambda x: blocks.gathered(x, w, loops=False), lambda x: blocks.block_sums(x, w), lambda x: sweep.coefficients(x, w, s, 2)):
        assert rows(f(p)) == rows(f(e))
    assert p.layer(0).times(linear.np.eye(5)).tolist() == [[0, 0.5, 2.5, 0, 0], [0.5, 0, 0, -0.25, 0], [2.5, 0, 2, 0, 0], [0, -0.25, 0, 0, 0], [0, 0, 0, 0, 0]]
    assert p.layer(0).bound() == 4.5


def test_edges_beyond_the_nodes_are_told(graph):
    e, nodes, _ = graph
    assert not packed.Packed(e, nodes.filter("node <> 7")).complete


def test_restarts_join_no_edges(spark, monkeypatch):
    def joined(*_, **__):
        raise AssertionError("edges are joined with a factor")

    g = queries.PlantedGraph(spark, "/root/testdata/sf0.01")
    for name in ("times", "eigenpairs", "smoothed_vertices"):
        monkeypatch.setattr(linear, name, joined)
    monkeypatch.setattr(fit, "base_partitions", joined, raising=False)
    monkeypatch.setattr("lamella.plans.methods.base_partitions", joined)
    found = fit.fit_restarts(g.drawn, g.nodes, exact.Options(r=3, trials=1, rounds=3))
    both = found.assign.join(g.truth.withColumnRenamed("c", "t"), "node").select("c", "t").distinct()
    assert both.count() == 3 and found.assign.count() == g.nodes.count()


@pytest.mark.parametrize("shared", [False, True])
def test_packed_sweeps_as_over_edges(graph, shared):
    e, nodes, p = graph
    start = nodes.withColumn("c", (F.col("node") % 2).cast("int"))
    a, b = (fit.fit_parallel(x, nodes, start, 2, rounds=2, delta=0, shared=shared) for x in (e, p))
    assert a.error == pytest.approx(b.error, abs=1e-9)
    for x, y in ((a.assign, b.assign), (a.weights, b.weights), (a.history, b.history), (a.interactions, b.interactions)):
        assert rows(x) == rows(y)


@pytest.mark.parametrize("name", ["sim3", "sim7", "identifiability"])
def test_tiles_draw_the_planted_graph(spark, monkeypatch, name):
    monkeypatch.setattr(packed, "TILE", 37)
    monkeypatch.setattr(packed, "CELLS", 100)
    s = generate.Planted(n=100, layers=2, **generate.SCENARIOS[name] | {"k": 2})
    nodes = spark.range(100).select((F.col("id") * 97 - 150).alias("node"))
    e = generate.planted(spark, s, nodes)[0]
    p, truth = generate.planted_tiles(spark, s, nodes)
    assert p.wide < 40 and p.high < 11 and e.count() > 500
    listed = packed.Packed(e, nodes)
    for k in range(2):
        assert (p.layer(k).dense() == listed.layer(k).dense()).all()
        assert p.layer(k).bound() == listed.layer(k).bound()
    start = truth.select("node", F.pmod("node", F.lit(3)).cast("int").alias("c"))
    a, b = (fit.fit_parallel(x, nodes, start, 3, rounds=2, delta=0) for x in (listed, p))
    assert rows(a.assign) == rows(b.assign) and rows(a.weights) == rows(b.weights)
    w = edges.everywhere(nodes, ["1", "2"]).select("layer", "node", F.pmod("node", F.lit(2)).cast("int").alias("c"), (F.col("node") / 4).alias("w"))
    for f in (edges.degrees, edges.norms, lambda x: blocks.block_sums(x, w), lambda x: blocks.gathered(x, w, loops=False)):
        assert rows(f(p)) == rows(f(listed))


def test_restarts_of_the_query_list_no_edge(spark, monkeypatch):
    def listed(*_):
        raise AssertionError("edges are listed")

    monkeypatch.setattr(packed.Packed, "__init__", listed)
    monkeypatch.setattr(fit, "cut", lambda df: listed() if "weight" in df.columns else lineage.cut(df))
    assert queries.QUERIES["fit_restarts"](spark, "/root/testdata/sf0.001").count() == 15


def test_texts_of_any_length_digest_as_each_alone():
    texts = [str(x) for x in (0, 7, -12, 99_999, 100_000, 2**62, -(2**63))]
    for beginning in ("", "1:2:3:", "12345", "x" * 34, "x" * 35, "x" * 60):
        want = [(int(hashlib.md5((beginning + x).encode()).hexdigest()[:12], 16) + 0.5) / 16**12 for x in texts]
        assert digests.Endings(texts).uniform(beginning, 0, len(texts)).tolist() == want
        assert digests.Endings(texts).uniform(beginning, 3, 4).tolist() == want[3:4]

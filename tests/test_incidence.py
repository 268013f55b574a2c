"""Queries on the co-activity graph that must not list its edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella import queries
from lamella.functions.scalars import shown
from lamella.operators import edges, pairs, statistics
from lamella.operators.incidence import Incidence
from lamella.sources import graphs

DATA = "/root/testdata/sf0.001"
NAMES = """
elbows
recon_error
quartic
sweep_error
snmtf_iter1
snmf_step
transitivity
bias_adjusted_square
components
layer_table
column_means
layer_similarity
daily_layers
sspa_pick1
mean_similarity
fit_parallel
sweep_coeffs
sweep_assign
sweep_assign_shared
norm_adj_tau
expected_adjacency
"""


@pytest.mark.parametrize("name", NAMES.split())
def test_no_list_of_edges(spark, monkeypatch, name):
    def listed(*_):
        raise AssertionError("edges are listed")

    monkeypatch.setattr(graphs, "coactivity", listed)
    monkeypatch.setattr(graphs, "daily", listed)
    assert queries.QUERIES[name](spark, DATA).limit(1).count() == 1


def test_arrays_round_as_columns(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 5000), rng.integers(-(10**9), 10**9, 5000) / 1e7, rng.normal(0, 1e7, 500), [0.0, -0.0, -1e-9, 5e-7, -5e-7, 4.9999999999e-7, 1e300, 0.1234565, 2.5e-6]])
    want = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", shown(F.col("x")).alias("x")).orderBy("i").toPandas().x.to_numpy()
    got = pairs.shown_numbers(x)
    assert (got == want).all() and (np.signbit(got) == np.signbit(want)).all()


def alike(spark, copies):
    """Rows (layer, slot, node): 130 sets of slots in two layers, each of them for some nodes."""
    rng, rows, node = np.random.default_rng(3), [], 0
    for i in range(130):
        slots = [("ab"[i % 2], int(s)) for s in rng.choice(40, 1 + i % 5, replace=False)]
        for _ in range(copies(i)):
            rows += [(layer, s, node) for layer, s in slots]
            node += 1
    return spark.createDataFrame(rows, "layer string, slot long, node long")


@pytest.mark.parametrize("held", [1 << 20, 8 * 130])
def test_classes_of_alike_nodes_count_as_edges(spark, monkeypatch, held):
    monkeypatch.setattr(pairs, "HELD_BYTES", held)
    seen = alike(spark, lambda i: (1, 1, 1, 2, 5)[i % 7 % 5])
    g = Incidence(seen)
    a, b = seen.withColumnRenamed("node", "src"), seen.withColumnRenamed("node", "dst")
    e = a.join(b, ["layer", "slot"]).filter("src <> dst").groupBy("layer", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")).cache()
    nodes = edges.everywhere(seen.select("node").distinct().unionAll(spark.createDataFrame([(-1,)], "node long")), ["a", "b"])
    assert any(len(t.word) > 2 and {1, 2, 5} <= set(t.size.tolist()) for t in g.twins)
    for f in (statistics.transitivity, lambda x: statistics.layer_statistics(x, nodes.count() // 2), lambda x: statistics.component_counts(x, nodes)):
        got, want = (f(x).orderBy("layer").toPandas() for x in (g, e))
        assert (got[want.columns].round(9) == want.round(9)).all(axis=None) and len(got) == 2


def test_alike_nodes_are_worked_on_once(spark):
    """30,000 nodes of two hours: half a billion edges, which no pair of nodes may cost."""
    n = 30_000
    seen = spark.range(n).select(F.lit("a").alias("layer"), F.explode(F.when(F.col("id") < 10, F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("id") % 2).cast("int")))).alias("slot"), F.col("id").alias("node"))
    g = Incidence(seen)
    assert [sorted(t.size) for t in g.twins] == [[10, n // 2 - 5, n // 2 - 5]]
    found, m = pairs.transitivity(g).first(), n // 2 + 5
    assert found.triangles == 2 * (m * (m - 1) * (m - 2) // 6) - 120
    assert found.triples == 10 * ((n - 1) * (n - 2) // 2) + (n - 10) * ((m - 1) * (m - 2) // 2)

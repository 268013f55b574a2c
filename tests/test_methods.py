"""Distributed factorizations, embeddings and consensus on small planted graphs."""

import numpy as np
import pytest

from lamella.functions import small_graphs, sparse
from lamella.operators import consensus, factors, generate, linear
from lamella.operators.edges import layer_sum
from lamella.plans import exact, fit, methods
from lamella.plans.experiments import scores
from lamella.plans.lineage import cut
from lamella.sources import graphs


@pytest.fixture(scope="module")
def graph(spark):
    e, n = generate.planted(spark, generate.Planted(n=30, k=2, layers=2, p=0.5, q=0.05, degree=9.0))
    return cut(e), cut(n)


def dense(edges, n):
    out = np.zeros((n, n))
    for r in edges.collect():
        out[r.src, r.dst] += r.weight
    return out


def test_eigenpairs(graph):
    total = cut(layer_sum(graph[0]))
    a = dense(total, 30)
    values, vectors = linear.eigenpairs(total, graph[1].select("node"), 2)
    want = np.linalg.eigvalsh(a)
    assert abs(values[0]) == pytest.approx(np.abs(want).max(), rel=1e-3)
    v = np.zeros((30, 2))
    for r in vectors.collect():
        v[r.node, r.k] = r.value
    assert np.allclose(v.T @ v, np.eye(2), atol=1e-6)


@pytest.mark.parametrize("by_size, local", [(True, 0), (False, 0), (True, 10_000)])
def test_eigenvectors_of_a_small_gap(spark, by_size, local):
    rng, n = np.random.default_rng(4), 90
    block = np.arange(n) // 30
    a = np.triu(rng.random((n, n)) < np.where(block[:, None] == block, 0.18, 0.08), 1)
    a = (a + a.T) / 1.0
    e = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in np.argwhere(a)], "src long, dst long, weight double")
    values, vectors = linear.eigenpairs(cut(e), spark.range(n).withColumnRenamed("id", "node"), 3, by_size, local=local)
    want, space = np.linalg.eigh(a)
    order = np.argsort(-np.abs(want) if by_size else -want)[:3]
    assert np.allclose(values, want[order], atol=1e-6)
    v = np.zeros((n, 3))
    for x in vectors.collect():
        v[x.node, x.k] = x.value
    assert np.linalg.svd(space[:, order].T @ v)[1].min() > 1 - 1e-6


def test_successive_picks_and_nearest_directions(graph):
    total = cut(layer_sum(graph[0]))
    u = cut(linear.smoothed_vertices(total, graph[1].select("node"), 2, 3, successive=True))
    found = {r.node: r.c for r in linear.orthogonal_nnls(total, u).collect()}
    truth = {r.node: r.c for r in graph[1].collect()}
    both = [n for n in truth if n in found]
    assert scores(np.array([found[n] for n in both]), np.array([truth[n] for n in both]))[2] > 0.4


def test_consensus_of_equal_partitions(spark):
    base = spark.createDataFrame([(str(layer), i, (i // 10 + layer) % 3) for layer in range(3) for i in range(30)], "layer string, node long, c int")
    for free in (False, True):
        found = {r.node: r.c for r in consensus.consensus(base, 3, matrix_free=free).collect()}
        assert scores(np.array([found[i] for i in range(30)]), np.arange(30) // 10)[2] == pytest.approx(1)
    with pytest.raises(ValueError):
        consensus.consensus(base, 10)


def test_symmetric_objective_falls(graph):
    f = factors.symmetric(layer_sum(graph[0]), graph[1].select("node"), factors.Settings(2, rounds=4, every=1))
    assert f.objective == sorted(f.objective, reverse=True)
    assert f.h.groupBy("node").sum("value").agg({"sum(value)": "max"}).first()[0] == pytest.approx(1)


def test_collective_factors(graph):
    f = factors.collective_tri(graph[0], graph[1].select("node"), factors.Settings(2, rounds=2, every=1, restarts=1, alpha=0.1))
    assert set(f.s) == {"1", "2"} and f.h.filter("value < 0").count() == 0
    with pytest.raises(ValueError):
        factors.checked(graph[0].withColumn("weight", -graph[0]["weight"]))


def test_unknown_method(graph):
    with pytest.raises(ValueError):
        methods.detect("nothing", *graph, 2)


@pytest.mark.parametrize("by_size", [True, False])
def test_sparse_eigenpairs(by_size):
    rng, n = np.random.default_rng(6), 1500
    i, j = rng.integers(0, n, (2, 9000))
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    x = sparse.Sparse(n, i, j, np.ones(len(i)))
    values, vectors = sparse.leading_pairs(x, 3, by_size)
    want = np.linalg.eigvalsh(x.dense())
    assert np.allclose(np.sort(values), np.sort(want[np.argsort(-np.abs(want) if by_size else -want)[:3]]), atol=1e-6)
    assert np.allclose(x.times(vectors), vectors * values, atol=1e-5)


def test_singular_triplets(spark):
    rng = np.random.default_rng(8)
    a = rng.random((12, 7))
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(7)], "src long, dst long, weight double")
    for local in (0, 1000):
        values, left, right = linear.singular_triplets(cells, 2, local)
        u, v = np.zeros((12, 2)), np.zeros((7, 2))
        for r in left.collect():
            u[r.node, r.k] = r.value
        for r in right.collect():
            v[r.node, r.k] = r.value
        assert np.allclose(values, np.linalg.svd(a)[1][:2], atol=1e-5)
        assert np.allclose(a @ v, u * values, atol=1e-4)


def small(k=3, n=60, layers=2, p=0.6, q=0.1, seed=3):
    rng, truth = np.random.default_rng(seed), np.arange(n) % k
    out = []
    for _ in range(layers):
        a = np.triu(rng.random((n, n)) < np.where(truth[:, None] == truth, p, q), 1)
        out.append((a | a.T).astype(float))
    return out, truth


@pytest.mark.parametrize("name", sorted(small_graphs.SMALL))
def test_small_methods_find_planted_communities(name):
    layers, truth = small()
    assert scores(small_graphs.SMALL[name](layers, 3, 1), truth)[2] == pytest.approx(1)


def test_starts_and_factors():
    layers, truth = small()
    x = layers[0]
    for how in ("rnd", "rnda", "rndc", "svd"):
        h = small_graphs.symmetric_factor(x, 3, 1, how)
        assert h.min() >= 0 and scores(h.argmax(axis=1), truth)[2] > 0.9
    with pytest.raises(ValueError):
        small_graphs.factor_start(x, 3, "other")
    u, cores = small_graphs.orthogonal_factor(layers, 3)
    assert np.allclose(u.T @ u, np.eye(3), atol=1e-8) and len(cores) == 2
    points, signs = small_graphs.signed_embedding(x, 3)
    assert small_graphs.expected(points, signs).shape == x.shape and small_graphs.signed_embedding(x)[0].shape[1] >= 1
    density = small_graphs.block_density(x, truth, 3)
    assert density[0, 0] == pytest.approx(x[np.ix_(truth == 0, truth == 0)].mean()) and density[0, 1] == density[1, 0]
    start = small_graphs.soft_start(truth, 3)
    assert np.allclose(np.linalg.norm(start, axis=0), 1)
    assert scores(small_graphs.spectral_clusterer(x, 3), truth)[2] > 0.9


def test_collective_factors_stay_factored(spark):
    layers, truth = small(n=18, layers=2, p=0.9, q=0.1)
    rows = [(str(i), int(a), int(b), 1.0) for i, x in enumerate(layers) for a, b in np.argwhere(x)]
    e = cut(spark.createDataFrame(rows, "layer string, src long, dst long, weight double"))
    n = spark.range(18).withColumnRenamed("id", "node")
    f = factors.collective_symmetric(e, n, factors.Settings(3, rounds=6, every=1))
    assert f.objective == sorted(f.objective, reverse=True) and f.h.filter("value < 0").count() == 0


def test_knn_in_blocks(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(60)] + [(100, [0.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    key = lambda df: sorted((r.src, r.dst, r["rank"]) for r in df.collect())
    assert key(graphs.nearest_by_cosine(v, 5)) == key(graphs.nearest_by_cosine(v, 5, block_bytes=500))


def test_restarts_respect_the_time_limit(spark):
    layers, _ = small(n=18, p=0.9)
    rows = [(str(i), int(a), int(b), 1.0) for i, x in enumerate(layers) for a, b in np.argwhere(x)]
    e = spark.createDataFrame(rows, "layer string, src long, dst long, weight double")
    found = fit.fit_restarts(e, spark.range(18).withColumnRenamed("id", "node"), exact.Options(r=3, trials=5, rounds=3, init="random", seconds=1e-6))
    assert found.assign.count() == 18 and found.history.select("trial").distinct().count() <= 1

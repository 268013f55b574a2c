"""Small solvers, the sequential factorization and agreement scores."""

import itertools

import numpy as np
import pytest

from lamella.functions.assignment import cheapest_assignment, dirichlet, k_means, l1_low_rank, nonnegative_least_squares, weighted_median
from lamella.plans import exact
from lamella.plans.experiments import draw, scores

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_assignment_is_cheapest(n):
    cost = RNG.normal(size=(n, n))
    _, total = cheapest_assignment(cost)
    assert total == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_quartic_minimum_against_a_grid():
    a, c, d = RNG.random(200) * 3, RNG.normal(0, 3, 200), -RNG.random(200) * 4
    _, f = exact.least_on_half_line(a, c, d)
    x = np.linspace(0, 30, 60001)
    for k in range(200):
        assert f[k] <= min(0, (a[k] / 4 * x**4 + c[k] / 2 * x**2 + d[k] * x).min()) + 1e-6


def planted(n=90, layers=3, p=0.35, q=0.05):
    truth = np.repeat(np.arange(3), n // 3)
    parts = []
    for _ in range(layers):
        a = np.triu(RNG.random((n, n)) < np.where(truth[:, None] == truth[None], p, q), 1)
        i, j = np.nonzero(a | a.T)
        parts.append((i, j, np.ones(len(i))))
    return exact.Layers(n, parts), truth


@pytest.mark.parametrize("init", ["usenc", "co-association", "one-layer"])
def test_planted_communities_are_found(init):
    g, truth = planted()
    fit = exact.best_of(g, exact.Options(3, trials=3, init=init))
    assert scores(fit.v, truth)[2] > 0.9


def test_normalised_weights_and_error_identity():
    g, _ = planted(60, 2)
    fit = exact.trial(g, exact.Options(3, rounds=3, init="random"), 0)
    for k in range(2):
        z = np.zeros((60, 3))
        z[np.arange(60), fit.v] = fit.w[k]
        used = np.bincount(fit.v, minlength=3) > 0
        assert np.allclose(z.T @ z, np.diag(used.astype(float)), atol=1e-9)
    errors = [h[2] for h in fit.history]
    assert errors == sorted(errors, reverse=True)


def test_partitions_are_checked():
    g, truth = planted(30, 1)
    with pytest.raises(ValueError):
        exact.trial(g, exact.Options(3), 0, truth + 1)
    with pytest.raises(ValueError):
        exact.trial(g, exact.Options(3), 0, truth.astype(float))
    with pytest.raises(ValueError):
        exact.trial(planted(30, 2)[0], exact.Options(3, init="unknown"), 0)


def test_isolated_nodes_have_no_weight():
    g = exact.Layers(4, [(np.array([0, 1]), np.array([1, 0]), np.ones(2))])
    fit = exact.trial(g, exact.Options(2, init="one-layer", rounds=3), 0)
    assert (fit.w[:, 2:] == 0).all()


def test_scores():
    a = np.array([0, 0, 1, 1, 2, 2])
    assert scores(a, (a + 1) % 3) == pytest.approx((0, 1, 1))


def test_other_solvers():
    assert weighted_median(np.array([3.0, 1.0, 2.0]), np.array([1.0, 1.0, 5.0])) == 2.0
    w, h = RNG.random((20, 3)), RNG.random((3, 7))
    assert np.allclose(nonnegative_least_squares(w.T @ w, w.T @ (w @ h)), h, atol=1e-4)
    assert np.allclose(dirichlet(np.ones(4), 5).sum(axis=1), 1)
    m = np.outer(RNG.random(6), RNG.random(5))
    u, v = l1_low_rank(m, 1)
    assert np.abs(m - u @ v).sum() < 1e-6
    assert len(set(k_means(np.array([[0.0], [0.1], [5.0], [5.1]]), 2))) == 2


def test_scenarios_draw():
    for name in ("sim1", "sim2", "sim3", "sim6", "sim8", "identifiability"):
        g, truth = draw(name, 2, 1)
        assert g.l == 2 and len(truth) == g.n


def test_rows_in_blocks(monkeypatch):
    from lamella.functions import sparse

    monkeypatch.setattr(sparse, "BLOCK", 7)
    rng = np.random.default_rng(3)
    i, j = rng.integers(0, 20, (2, 60))
    i[i == 4] = 5  # a row without entries
    x = rng.random(60)
    one, other = sparse.Rows.of(20, i, j, x), sparse.Sparse(20, i, j, x)
    h = rng.random((20, 3))
    assert np.allclose(one.times(h), other.times(h)) and np.allclose(one.dense(), other.dense()) and one.bound() == pytest.approx(other.bound())
    assert np.allclose(one.column_mean(np.array([1, 7])), other.column_mean(np.array([1, 7])))
    left = one.without_loops().dense()
    assert not np.diag(left).any() and np.allclose(left, other.dense() * (1 - np.eye(20)))


def test_a_task_holds_the_graph_of_six_times_sf01(spark):
    from lamella.plans import fit

    assert fit.TASK_EDGES > 48_600_000
    cells = [("a", 5, 9, 2.0), ("a", 9, 5, 2.0), ("a", 5, 2, 1.0), ("a", 2, 5, 1.0)]
    edges = spark.createDataFrame(cells, "layer string, src long, dst long, weight double")
    start, columns, x = fit.rows_of(edges, np.array([2, 5, 9]))
    assert start.tolist() == [0, 1, 3, 4] and columns.dtype == np.int32 and columns.tolist() == [1, 0, 2, 1] and x.tolist() == [1, 1, 2, 2]
    start, columns, x = fit.rows_of(edges.withColumn("weight", edges["weight"] * 0 + 1), np.array([2, 5, 9]))
    assert columns.tolist() == [1, 0, 2, 1] and x == 1.0

"""Small dense solvers for the driver or one task; their sizes are numbers of communities."""

from __future__ import annotations

import numpy as np


def cheapest_assignment(cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Column of each row in the assignment of least total cost (rows <= columns), by shortest augmenting paths."""
    cost = np.asarray(cost, dtype=float)
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        of[0], at = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while of[at]:
            used[at] = True
            row = of[at]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            back[1:][better] = at
            nxt = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[nxt]
            u[of[used]] += step
            v[used] -= step
            least[~used] -= step
            at = nxt
        while at:
            of[at] = of[back[at]]
            at = back[at]
    columns = np.zeros(n, dtype=int)
    for j in range(1, m + 1):
        if of[j]:
            columns[of[j] - 1] = j - 1
    return columns, float(cost[np.arange(n), columns].sum())


def k_means(points: np.ndarray, k: int, restarts: int = 10, rounds: int = 100, seed: int = 0) -> np.ndarray:
    """Labels of Lloyd's algorithm with spread-out starts, the best of some restarts."""
    rng = np.random.default_rng(seed)
    best, least = np.zeros(len(points), dtype=int), np.inf
    for _ in range(restarts):
        centres = points[[rng.integers(len(points))]]
        while len(centres) < k:
            far = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            centres = np.vstack([centres, points[rng.choice(len(points), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(points))]])
        labels = np.full(len(points), -1)
        for _ in range(rounds):
            d = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
            now = d.argmin(axis=1)
            if (now == labels).all():
                break
            labels = now
            centres = np.array([points[labels == j].mean(axis=0) if (labels == j).any() else points[d.min(axis=1).argmax()] for j in range(k)])
        total = ((points - centres[labels]) ** 2).sum()
        if total < least:
            best, least = labels, total
    return best


def nonnegative_least_squares(gram: np.ndarray, right: np.ndarray, rounds: int = 200) -> np.ndarray:
    """H >= 0 that minimises ||X - W H|| given W'W and W'X, by cyclic coordinate descent."""
    h = np.maximum(np.linalg.lstsq(gram, right, rcond=None)[0], 0)
    for _ in range(rounds):
        last = h.copy()
        for k in range(len(gram)):
            if gram[k, k] > 0:
                h[k] = np.maximum(0, h[k] + (right[k] - gram[k] @ h) / gram[k, k])
        if np.abs(h - last).max(initial=0) < 1e-10:
            break
    return h


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """The least value at which half the weight is reached."""
    order = np.argsort(values, kind="stable")
    sums = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(sums, sums[-1] / 2)])


def l1_low_rank(m: np.ndarray, r: int, rounds: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """U, V with small sum |M - U V|, by coordinate descent on weighted medians."""
    rng = np.random.default_rng(seed)
    u, v = rng.random((m.shape[0], r)), rng.random((r, m.shape[1]))
    for _ in range(rounds):
        for k in range(r):
            rest = m - u @ v + np.outer(u[:, k], v[k])
            for i in range(len(u)):
                ok = np.abs(v[k]) > 1e-12
                u[i, k] = weighted_median(rest[i, ok] / v[k, ok], np.abs(v[k, ok])) if ok.any() else 0.0
            for j in range(v.shape[1]):
                ok = np.abs(u[:, k]) > 1e-12
                v[k, j] = weighted_median(rest[ok, j] / u[ok, k], np.abs(u[ok, k])) if ok.any() else 0.0
    return u, v


def dirichlet(alpha: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """n samples by normalised gamma variates."""
    g = np.random.default_rng(seed).gamma(np.asarray(alpha, dtype=float), size=(n, len(alpha)))
    return g / g.sum(axis=1, keepdims=True)

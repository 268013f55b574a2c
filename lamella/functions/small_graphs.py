"""Community detection on small graphs that one task holds, as dense layers.

A method takes (layers, r, seed), where layers are symmetric arrays of one size,
and gives a label for every node. Studies run thousands of such graphs, a task for
each; graphs that do not fit a task go to :mod:`lamella.plans.methods`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lamella.functions.assignment import k_means

Layers = list[np.ndarray]
SmallMethod = Callable[[Layers, int, int], np.ndarray]

#: Least value of a factor's cell and of a row's norm (fixed value).
LEAST = 1e-6


def laplacian(a: np.ndarray) -> np.ndarray:
    """D^-1/2 A D^-1/2, where D are the degrees plus their mean."""
    d = a.sum(axis=1)
    scale = 1 / np.sqrt(np.maximum(d + d.mean(), 1e-300))
    return scale[:, None] * a * scale[None, :]


def leading(a: np.ndarray, r: int, by_size: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The r largest eigenvalues (by_size: of largest magnitude) and their vectors."""
    values, vectors = np.linalg.eigh(a)
    top = np.argsort(-np.abs(values) if by_size else -values, kind="stable")[:r]
    return values[top], vectors[:, top]


def unit_rows(u: np.ndarray) -> np.ndarray:
    return u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), LEAST)


def by_first(u: np.ndarray) -> np.ndarray:
    """Columns over the first one, which goes."""
    first = u[:, :1]
    return np.where(np.abs(first) > 1e-12, u[:, 1:] / np.where(first == 0, 1, first), 0.0)


def embedding(a: np.ndarray, r: int, scaled: bool, diagonal: bool = False) -> np.ndarray:
    """Leading vectors by magnitude; scaled by the roots of their values; diagonal: with degree / (n - 1) there."""
    if diagonal and not np.diag(a).any():
        a = a + np.diag(a.sum(axis=1) / max(1, len(a) - 1))
    values, vectors = leading(a, r, True)
    return vectors * np.sqrt(np.abs(values)) if scaled else vectors


def elbow(values: np.ndarray) -> int:
    """After how many of the descending values the profile likelihood of two normal groups with one variance is largest."""
    p, best = len(values), (-np.inf, 1)
    for q in range(1, p + 1):
        a, b = values[:q], values[q:]
        spread = ((a - a.mean()) ** 2).sum() + (((b - b.mean()) ** 2).sum() if len(b) else 0.0)
        free = p - 1 - (q < p)
        if free > 0 and spread > 0:
            best = max(best, (-p / 2 * np.log(2 * np.pi * spread / free) - free / 2, -q))
    return abs(best[1])


def signed_embedding(a: np.ndarray, d: int | None = None, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(X, signs) with A ~ X diag(signs) X'; without ``d`` as many columns as come before the elbow of the sizes of the eigenvalues."""
    if diagonal and not np.diag(a).any():
        a = a + np.diag(a.sum(axis=1) / max(1, len(a) - 1))
    values, vectors = np.linalg.eigh(a)
    if d is None:
        sizes = np.sort(np.abs(values))[::-1]
        kept = np.abs(values) >= sizes[elbow(sizes) - 1]
    else:
        kept = np.argsort(-np.abs(values), kind="stable")[:d]
    return vectors[:, kept] * np.sqrt(np.abs(values[kept])), np.sign(values[kept])


def expected(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The adjacency that a signed embedding stands for."""
    return x * signs @ x.T


def joint_vectors(parts: list[np.ndarray], r: int) -> np.ndarray:
    return np.linalg.svd(np.hstack(parts), full_matrices=False)[0][:, :r]


def clustered(u: np.ndarray, r: int, seed: int) -> np.ndarray:
    return k_means(u, r, 20, seed=seed)


def dcmase(scaled: bool = True, rows: Callable[[np.ndarray], np.ndarray] = unit_rows) -> SmallMethod:
    return lambda layers, r, seed: clustered(joint_vectors([rows(embedding(a, r, scaled)) for a in layers], r), r, seed)


def mase(spherical: bool = False, rows: Callable[[np.ndarray], np.ndarray] | None = None) -> SmallMethod:
    def run(layers, r, seed):
        parts = [embedding(a, r, False, True) for a in layers]
        u = joint_vectors([rows(p) for p in parts] if rows else parts, r)
        return clustered(unit_rows(u) if spherical else u, r, seed)

    return run


def aggregate(kind: str) -> SmallMethod:
    """Spectral clustering of the sum of the layers: plain, spherical, score, or of their squares without the degrees."""

    def run(layers, r, seed):
        total = sum(a @ a - np.diag(a.sum(axis=1)) for a in layers) if kind == "squares" else sum(layers)
        u = embedding(total, r, False)
        return clustered(by_first(u) if kind == "score" else u if kind == "plain" else unit_rows(u), r, seed)

    return run


def kernel_sum(layers: Layers, r: int, seed: int) -> np.ndarray:
    """Leading vectors of the sum of the projections on each layer's leading Laplacian vectors."""
    return clustered(leading(sum(u @ u.T for u in (leading(laplacian(a), r)[1] for a in layers)), r)[1], r, seed)


def mean_of_laplacians(layers: Layers, r: int, seed: int) -> np.ndarray:
    return clustered(leading(sum(map(laplacian, layers)), r)[1], r, seed)


def mean_adjacency(layers: Layers, r: int, seed: int) -> np.ndarray:
    return clustered(leading(sum(layers), r)[1], r, seed)


def regularised(layers: Layers, r: int, seed: int) -> np.ndarray:
    """Row-normalised vectors of the Laplacian of the sum."""
    return clustered(unit_rows(leading(laplacian(sum(layers)), r)[1]), r, seed)


def orthogonal_factor(layers: Layers, r: int, rounds: int = 200, tolerance: float = 1e-4) -> tuple[np.ndarray, list[np.ndarray]]:
    """(U, cores) that minimise the sum of ||L - U C U'||^2 over orthonormal U.

    Quasi-Newton steps along the tangent space from the mean Laplacian's vectors,
    with a falling step length and U orthonormal again after each; given U the best
    core is U'LU.
    """
    lap = [laplacian(a) for a in layers]
    u = leading(sum(lap), r)[1]

    def cost(u):
        return sum((x * x).sum() - ((u.T @ x @ u) ** 2).sum() for x in lap)

    now, step, memory = cost(u), 1.0, None
    for _ in range(rounds):
        pull = -sum((x @ u - u @ (u.T @ x @ u)) @ (u.T @ x @ u) for x in lap)
        if memory is not None:  # the length that the last change of the gradient asks for
            move, turn = u - memory[0], pull - memory[1]
            if (bend := float((move * turn).sum())) > 1e-300:
                step = min(100.0, float((move * move).sum()) / bend)
        memory = (u, pull)
        while True:
            q, t = np.linalg.qr(u - step * pull)
            fresh = q * np.where(np.diag(t) < 0, -1.0, 1.0)
            after = cost(fresh)
            if after <= now or step < 1e-10:
                break
            step /= 2
        done = now - after <= tolerance * (abs(now) + tolerance)
        if after <= now:
            u, now = fresh, after
        if done:
            break
    return u, [u.T @ x @ u for x in lap]


def olmf(layers: Layers, r: int, seed: int) -> np.ndarray:
    return clustered(orthogonal_factor(layers, r)[0], r, seed)


def coregularised(layers: Layers, r: int, strength: float = 0.1, rounds: int = 100, tolerance: float = 1e-4) -> tuple[np.ndarray, list[np.ndarray]]:
    """(common vectors, vectors of each layer) that agree: each layer's Laplacian leans on the common projection, and the other way round, in turns."""
    lap = [laplacian(a) for a in layers]
    own = [leading(x, r)[1] for x in lap]
    last = None
    for _ in range(rounds):
        common = leading(sum(strength * u @ u.T for u in own), r)[1]
        value = sum(np.trace(u.T @ x @ u) + strength * ((u.T @ common) ** 2).sum() for u, x in zip(own, lap, strict=True))
        if last is not None and value - last <= tolerance:
            break
        last = value
        own = [leading(x + strength * common @ common.T, r)[1] for x in lap]
    return common, own


def coreg(layers: Layers, r: int, seed: int) -> np.ndarray:
    return clustered(coregularised(layers, r)[0], r, seed)


def soft_start(labels: np.ndarray, r: int) -> np.ndarray:
    """Nearly all of a row in its label's column, 0.01 in the others, columns of length one."""
    h = np.full((len(labels), r), 0.01)
    h[np.arange(len(labels)), labels] = 1 - 0.01 * r
    return h / np.maximum(np.linalg.norm(h, axis=0), LEAST)


def orthogonal_tri(layers: Layers, r: int, seed: int = 0, strength: float = 0.1, rounds: int = 100, tolerance: float = 1e-4) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(common H, H of each layer, cores): nonnegative, nearly orthogonal factors of the Laplacians that lean on a common one, by multiplicative updates."""
    lap = [laplacian(a) for a in layers]
    whole = lambda x: np.maximum(np.nan_to_num(x, nan=LEAST, posinf=LEAST), LEAST)
    pairs = [leading(x, r) for x in lap]
    own = [soft_start(clustered(unit_rows(u), r, seed), r) for _, u in pairs]
    cores = [np.diag(np.abs(values)) for values, _ in pairs]
    common = soft_start(clustered(unit_rows(leading(sum(h @ h.T for h in own) / len(own), r)[1]), r, seed), r)
    last = None
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            value = sum(((x - h @ s @ h.T) ** 2).sum() - strength * ((h.T @ common) ** 2).sum() for x, h, s in zip(lap, own, cores, strict=True))
            if last is not None and last - value <= tolerance:
                break
            last = value
            up = [x @ h @ s + strength * common @ (common.T @ h) for x, h, s in zip(lap, own, cores, strict=True)]
            own = [whole(h * np.sqrt(n / (h @ (h.T @ n)))) for h, n in zip(own, up, strict=True)]
            pull = sum(h @ (h.T @ common) for h in own)
            common = whole(common * np.sqrt(pull / (common @ (common.T @ pull))))
            cores = [whole(s * np.sqrt((h.T @ x @ h) / (h.T @ h @ s @ h.T @ h))) for x, h, s in zip(lap, own, cores, strict=True)]
    return common, own, cores


def co_osntf(layers: Layers, r: int, seed: int) -> np.ndarray:
    return orthogonal_tri(layers, r, seed)[0].argmax(axis=1)


def block_density(a: np.ndarray, labels: np.ndarray, r: int) -> np.ndarray:
    """Edge weight between communities over all their pairs of nodes, a node with itself included."""
    h = np.eye(r)[labels]
    size = h.sum(axis=0)
    return (h.T @ a @ h) / np.maximum(np.outer(size, size), 1)


def factor_start(x: np.ndarray, r: int, how: str = "rnd", seed: int = 0) -> np.ndarray:
    """A nonnegative start: ``rnd`` uniform; ``rnda`` means of a fifth of the columns; ``rndc`` of those with the largest norms; ``svd`` positive parts of the leading singular vectors."""
    n, rng = len(x), np.random.default_rng(seed)
    if how == "rnd":
        return rng.random((n, r))
    p = -(-n // 5)
    if how == "rnda":
        return np.column_stack([x[:, rng.integers(0, n, p)].mean(axis=1) for _ in range(r)])
    if how == "rndc":
        top = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")[: -(-n // 2)]
        return np.column_stack([x[:, top[rng.integers(0, len(top), p)]].mean(axis=1) for _ in range(r)])
    if how != "svd":
        raise ValueError(f"unknown start {how!r}")
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    out = np.zeros((n, r))
    for j in range(r):
        a, b = u[:, j], vt[j]
        if j == 0:
            out[:, 0] = np.sqrt(s[0]) * np.abs(a)
            continue
        best = max(((np.maximum(g * a, 0), np.maximum(g * b, 0)) for g in (1, -1)), key=lambda ab: np.linalg.norm(ab[0]) * np.linalg.norm(ab[1]))
        size = np.linalg.norm(best[0])
        out[:, j] = np.sqrt(s[j] * size * np.linalg.norm(best[1])) * best[0] / max(size, 1e-300)
    return out


def symmetric_factor(x: np.ndarray, r: int, seed: int = 0, how: str = "rnd", rounds: int = 300, tolerance: float = 1e-6) -> np.ndarray:
    """X ~ H H' with H >= 0: multiplicative steps, half of each."""
    h, last = np.maximum(factor_start(x, r, how, seed), 1e-10), np.inf
    for i in range(rounds):
        h = h * (0.5 + 0.5 * (x @ h) / (h @ (h.T @ h) + 1e-10))
        if i % 10 == 0:
            error = float(np.linalg.norm(x - h @ h.T))
            if last - error < tolerance:
                break
            last = error
    return h


def snmf(layers: Layers, r: int, seed: int) -> np.ndarray:
    return symmetric_factor(sum(layers), r, seed).argmax(axis=1)


def csnmf(layers: Layers, r: int, seed: int, alpha: float = 0.5) -> np.ndarray:
    parts = [symmetric_factor(a, r, seed) for a in layers]
    mean = sum(a + alpha * h @ h.T for a, h in zip(layers, parts, strict=True)) / ((1 + alpha) * len(layers))
    return symmetric_factor(mean, r, seed).argmax(axis=1)


def tri_factor(layers: Layers, r: int, seed: int = 0, anchors: Layers = (), starts: Layers | None = None, alpha: float = 0.1, rounds: int = 300, tolerance: float = 1e-6, first: np.ndarray | None = None) -> tuple[np.ndarray, Layers, float]:
    """(H, cores, objective) of X_l ~ H S_l H' with one H, which leans on the projections of ``anchors`` and starts at ``first`` or anywhere."""
    h = np.random.default_rng(seed).random((len(layers[0]), r)) if first is None else np.maximum(first, 1e-4)
    cores = [np.ones((r, r)) for _ in layers] if starts is None else [s.copy() for s in starts]
    fitted = lambda: [s * (h.T @ x @ h) / np.maximum(h.T @ h @ s @ h.T @ h, 1e-10) for x, s in zip(layers, cores, strict=True)]
    for _ in range(20 if starts is None else 0):
        cores = fitted()
    last = np.inf
    for i in range(rounds):
        up = sum(x @ h @ s for x, s in zip(layers, cores, strict=True)) + sum(alpha / 2 * a @ (a.T @ h) for a in anchors)
        h = h * up / np.maximum(h @ (h.T @ up), 1e-10)
        cores = fitted()
        if i % 10 == 0 or i == rounds - 1:
            value = float(sum(((x - h @ s @ h.T) ** 2).sum() for x, s in zip(layers, cores, strict=True)) - alpha * sum(((a.T @ h) ** 2).sum() for a in anchors))
            if 0 <= last - value < tolerance:
                break
            last = value
    return h, cores, value


def csnmtf(layers: Layers, r: int, seed: int, restarts: int = 3) -> np.ndarray:
    """Each normalised layer alone, the best of some starts, then one factor near all of theirs, the best again; starts are means of columns."""
    layers = [laplacian(a) for a in layers]
    alone = [min((tri_factor([x], r, first=factor_start(x, r, "rnda", seed + k)) for k in range(restarts)), key=lambda f: f[2]) for x in layers]
    anchors, starts, mean = [f[0] for f in alone], [f[1][0] for f in alone], sum(layers) / len(layers)
    fits = (tri_factor(layers, r, anchors=anchors, starts=starts, first=factor_start(mean, r, "rnda", seed + 100 + k)) for k in range(restarts))
    return min(fits, key=lambda f: f[2])[0].argmax(axis=1)


def spectral_clusterer(x: np.ndarray, k: int = 2, seed: int = 0) -> np.ndarray:
    """Clusters of a similarity's normalised leading vectors."""
    return clustered(unit_rows(leading(laplacian(x), k)[1]), k, seed)


SMALL: dict[str, SmallMethod] = {
    "dcmase": dcmase(),
    "dcmase-unscaled": dcmase(scaled=False),
    "mase": mase(),
    "mase-spherical": mase(spherical=True),
    "mase-score": mase(rows=by_first),
    "ave": aggregate("plain"),
    "ave_spherical": aggregate("spherical"),
    "score": aggregate("score"),
    "sq-bias-adjusted": aggregate("squares"),
    "speck": kernel_sum,
    "meancluster": mean_of_laplacians,
    "meanadj": mean_adjacency,
    "dcspectral": regularised,
    "lmfo": olmf,
    "coreg": coreg,
    "co-osntf": co_osntf,
    "snmf": snmf,
    "csnmf": csnmf,
    "csnmtf": csnmtf,
}

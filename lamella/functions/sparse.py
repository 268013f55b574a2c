"""Symmetric sparse matrices that one process holds, and their leading eigenpairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Rows up to which a matrix is solved as a dense one, and entries that are multiplied at once.
DENSE, BLOCK = 1200, 1 << 20


@dataclass
class Sparse:
    """n rows; entry values[e] at (rows[e], columns[e]); entries that meet add up."""

    n: int
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def times(self, h: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.rows, self.values * h[self.columns, k], minlength=self.n) for k in range(h.shape[1])]) if h.shape[1] else np.zeros((self.n, 0))

    def column_mean(self, chosen: np.ndarray) -> np.ndarray:
        """The mean of some columns."""
        kept = np.isin(self.columns, chosen)
        return np.bincount(self.rows[kept], self.values[kept], minlength=self.n) / len(chosen)

    def bound(self) -> float:
        """The largest row sum of sizes."""
        return float(np.bincount(self.rows, np.abs(self.values), minlength=self.n).max())

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        np.add.at(out, (self.rows, self.columns), self.values)
        return out


@dataclass
class Rows:
    """The same by rows: values[e] at (i, columns[e]) for e from start[i] to start[i + 1]. Values that are all alike may share their memory."""

    start: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, n: int, i: np.ndarray, j: np.ndarray, x: np.ndarray) -> Rows:
        order = np.argsort(i, kind="stable")
        return cls(np.searchsorted(i[order], np.arange(n + 1)), j[order], x[order])

    @property
    def n(self) -> int:
        return len(self.start) - 1

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, value) of whole rows, some BLOCK entries at once."""
        a = 0
        while a < self.n:
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + BLOCK, "right")) - 1)
            own = slice(self.start[a], self.start[b])
            yield np.repeat(np.arange(a, b), np.diff(self.start[a : b + 1])), self.columns[own], self.values[own]
            a = b

    def times(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, h.shape[1]))
        for i, j, x in self.blocks():
            if len(i):
                first = np.flatnonzero(np.diff(i, prepend=-1))
                out[i[first]] = np.add.reduceat(x[:, None] * h[j], first, axis=0)
        return out

    def column_mean(self, chosen: np.ndarray) -> np.ndarray:
        h = np.zeros((self.n, 1))
        h[chosen] = 1
        return self.times(h)[:, 0] / len(chosen)

    def bound(self) -> float:
        return float(Rows(self.start, self.columns, np.abs(self.values)).times(np.ones((self.n, 1))).max())

    def without_loops(self) -> Rows:
        kept = np.concatenate([i != j for i, j, _ in self.blocks()] or [np.zeros(0, dtype=bool)])
        if kept.all():
            return self
        return Rows(np.concatenate([[0], np.cumsum(kept)])[self.start], self.columns[kept], self.values[kept])

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        for i, j, x in self.blocks():
            np.add.at(out, (i, j), x)
        return out


def leading_pairs(x: Sparse | Rows, r: int, by_size: bool = True, extra: int = 4, seed: int = 0, tolerance: float = 1e-8, degree: int = 8, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The r leading eigenvalues and (n, r) vectors, of largest magnitude or of largest value.

    Small matrices are solved directly; others by block iteration, filtered by a
    Chebyshev polynomial, until the residuals are below ``tolerance`` times the
    largest eigenvalue.
    """
    if x.n <= max(DENSE, r + extra):
        values, vectors = np.linalg.eigh(x.dense())
        top = np.argsort(-np.abs(values) if by_size else -values, kind="stable")[:r]
        return values[top], vectors[:, top]
    bound = x.bound()
    h = np.random.default_rng(seed).standard_normal((x.n, r + extra))
    for _ in range(rounds):
        h = np.linalg.qr(h)[0]
        y = x.times(h)
        values, turn = np.linalg.eigh((h.T @ y + y.T @ h) / 2)
        order = np.argsort(-np.abs(values) if by_size else -values)
        values, turn = values[order], turn[:, order]
        h, y = h @ turn, y @ turn
        if (np.linalg.norm(y[:, :r] - h[:, :r] * values[:r], axis=0) <= tolerance * np.abs(values).max()).all():
            return values[:r], h[:, :r]
        edge = max(abs(values[-1]), 1e-3 * np.abs(values).max()) if by_size else values[-1]
        centre, width = (0.0, edge) if by_size else ((edge - bound) / 2, max((edge + bound) / 2, 1e-3 * bound))
        before, h = h, (y - centre * h) / width
        for _ in range(degree - 1):
            before, h = h, 2 / width * (x.times(h) - centre * h) - before
    raise ArithmeticError(f"eigenvectors have not converged in {rounds} rounds")

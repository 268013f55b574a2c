"""Nonnegative factorizations by multiplicative updates, distributed over edges."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators.linear import gram, matrix, noise_factor, times, turned
from lamella.plans.lineage import cut

EPS = 1e-10


@dataclass
class Factorization:
    """h: (node, k, value). s: by layer, None without interactions. objective: every tenth round and the last. converged: the decrease fell below the tolerance."""

    h: DataFrame
    s: dict[str, np.ndarray] | None
    objective: list[float] = field(default_factory=list)
    converged: bool = False


@dataclass(frozen=True)
class Settings:
    rank: int
    rounds: int = 300
    tolerance: float = 1e-6
    every: int = 10
    seed: int = 0
    restarts: int = 3
    alpha: float = 0.5


def checked(edges: DataFrame) -> DataFrame:
    if edges.filter("weight < 0").limit(1).count():
        raise ValueError("negative entries")
    return cut(edges)


def updated(h: DataFrame, numerator: DataFrame, denominator: DataFrame, half: bool = False) -> DataFrame:
    """H times numerator over denominator, cell by cell; ``half``: the mean of that and H."""
    n, d = numerator.withColumnRenamed("value", "n"), denominator.withColumnRenamed("value", "d")
    ratio = F.coalesce("n", F.lit(0.0)) / (F.coalesce("d", F.lit(0.0)) + EPS if half else F.greatest(F.coalesce("d", F.lit(0.0)), F.lit(EPS)))
    return h.join(n, ["node", "k"], "left").join(d, ["node", "k"], "left").select("node", "k", (F.col("value") * ((0.5 + 0.5 * ratio) if half else ratio)).alias("value"))


def symmetric(edges: DataFrame, nodes: DataFrame, settings: Settings, more: list[tuple[float, DataFrame]] = ()) -> Factorization:
    """X ~ H H'; the rows of H sum to 1 in the end.

    more: X is the matrix of the edges plus a * A A' for each (a, A); those
    products stay factored.
    """
    edges, r = checked(edges), settings.rank

    def product(h: DataFrame) -> DataFrame:
        out = times(edges, h)
        for a, f in more:
            out = out.unionByName(turned(f, a * matrix(gram(f, h), r)))
        return out.groupBy("node", "k").agg(F.sum("value").alias("value")) if more else out

    norm2 = float(edges.agg(F.sum(F.col("weight") * F.col("weight"))).first()[0] or 0.0)
    norm2 += sum(2 * a * float(np.trace(matrix(gram(f, times(edges, f)), r))) for a, f in more)
    norm2 += sum(a * b * float((matrix(gram(f, g), r) ** 2).sum()) for a, f in more for b, g in more)
    h = cut(noise_factor(nodes, r, settings.seed))
    last, out = 1e10, Factorization(h, None)
    for i in range(settings.rounds):
        xh, g = product(h), matrix(gram(h, h), r)
        h = cut(updated(h, xh, turned(h, g), half=True))
        if i % settings.every == 0 or i == settings.rounds - 1:
            g, b = matrix(gram(h, h), r), matrix(gram(h, product(h)), r)
            distance = float(np.sqrt(max(norm2 - 2 * np.trace(b) + (g * g).sum(), 0.0)))
            out.objective.append(distance * distance)
            if last - distance < settings.tolerance:
                out.converged = True
                break
            last = distance
    total = h.groupBy("node").agg(F.sum("value").alias("t"))
    out.h = h.join(total, "node").select("node", "k", (F.col("value") / F.when(F.col("t") != 0, F.col("t")).otherwise(1.0)).alias("value"))
    return out


def column_starts(edges: DataFrame, nodes: DataFrame, r: int, seed: int = 0) -> DataFrame:
    """(node, k, value): for each k the mean of a fifth of the columns of (src, dst, weight), by a hash; a small value where that is 0."""
    cells = nodes.select(F.col("node").alias("dst"), F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("k"))
    chosen = cells.filter(F.pmod(F.xxhash64("dst", "k", F.lit(seed)), F.lit(5)) == 0)
    count = chosen.groupBy("k").agg(F.count(F.lit(1)).alias("p"))
    sums = edges.join(chosen, "dst").groupBy(F.col("src").alias("node"), "k").agg(F.sum("weight").alias("s"))
    mean = sums.join(F.broadcast(count), "k").select("node", "k", (F.col("s") / F.col("p")).alias("m"))
    return cells.select(F.col("dst").alias("node"), "k").join(mean, ["node", "k"], "left").select("node", "k", F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(1e-4)).alias("value"))


def tri(edges: DataFrame, nodes: DataFrame, settings: Settings, anchors: dict[str, DataFrame] | None = None, starts: dict[str, np.ndarray] | None = None) -> Factorization:
    """X_l ~ H S_l H' with one H for all layers, which starts at means of columns of the layers' sum.

    anchors: factors of the layers alone, that H is drawn to with strength alpha.
    """
    edges, r = checked(edges), settings.rank
    layers = [x.layer for x in edges.select("layer").distinct().orderBy("layer").collect()]
    own = {layer: edges.filter(F.col("layer") == layer).drop("layer") for layer in layers}
    norm2 = {x.layer: x.n for x in edges.groupBy("layer").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()}
    total = edges.groupBy("src", "dst").agg((F.sum("weight") / max(1, len(layers))).alias("weight"))
    h = cut(column_starts(total, nodes, r, settings.seed))
    s = {layer: np.ones((r, r)) if starts is None else starts[layer].copy() for layer in layers}

    def cells(h: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return matrix(gram(h, h), r), {layer: matrix(gram(h, times(own[layer], h)), r) for layer in layers}

    def objective(g: np.ndarray, b: dict[str, np.ndarray], h: DataFrame) -> float:
        value = sum(norm2[x] - 2 * (s[x] * b[x]).sum() + np.trace(s[x].T @ g @ s[x] @ g) for x in layers)
        return float(value - settings.alpha * sum((matrix(gram(a, h), r) ** 2).sum() for a in (anchors or {}).values()))

    g, b = cells(h)
    for _ in range(20 if starts is None else 0):
        for x in layers:
            s[x] *= b[x] / np.maximum(g @ s[x] @ g, EPS)
    last, out = objective(g, b, h), Factorization(h, s)
    for i in range(settings.rounds):
        parts = [turned(times(own[x], h), s[x]) for x in layers]
        for a in (anchors or {}).values():
            parts.append(turned(a, settings.alpha / 2 * matrix(gram(a, h), r)))
        numerator = parts[0]
        for p in parts[1:]:
            numerator = numerator.unionByName(p)
        numerator = cut(numerator.groupBy("node", "k").agg(F.sum("value").alias("value")))
        h = cut(updated(h, numerator, turned(h, matrix(gram(h, numerator), r))))
        g, b = cells(h)
        for x in layers:
            s[x] *= b[x] / np.maximum(g @ s[x] @ g, EPS)
        if i % settings.every == 0 or i == settings.rounds - 1:
            value = objective(g, b, h)
            out.objective.append(value)
            if 0 <= last - value < settings.tolerance:
                out.converged = True
                break
            last = value
    size, fit = np.sqrt(sum(norm2.values())), np.linalg.norm(g)
    scale = np.sqrt(size / fit) if size > 0 and fit > 0 else 1.0
    out.h = h.withColumn("value", F.col("value") * float(scale))
    out.s = {x: v / scale**2 for x, v in s.items()}
    return out


def collective_symmetric(edges: DataFrame, nodes: DataFrame, settings: Settings) -> Factorization:
    """Each layer alone, then the mean of the layers and of their weighted H H' once more, which stay factored."""
    layers = [x.layer for x in edges.select("layer").distinct().orderBy("layer").collect()]
    share = 1 / ((1 + settings.alpha) * max(1, len(layers)))
    parts = [(settings.alpha * share, cut(symmetric(edges.filter(F.col("layer") == x).drop("layer"), nodes, settings).h)) for x in layers]
    mean = cut(edges.groupBy("src", "dst").agg((F.sum("weight") * share).alias("weight")))
    return symmetric(mean, nodes, settings, parts)


def collective_tri(edges: DataFrame, nodes: DataFrame, settings: Settings) -> Factorization:
    """Each normalised layer alone, the best of some starts, then one H for all layers that stays near theirs, the best again."""
    from dataclasses import replace

    from lamella.operators.edges import normalized

    edges = cut(normalized(edges, nodes.count()))
    layers = [x.layer for x in edges.select("layer").distinct().orderBy("layer").collect()]
    best = None
    for k in range(settings.restarts):
        alone = {x: tri(edges.filter(F.col("layer") == x), nodes, replace(settings, seed=settings.seed + k)) for x in layers}
        error = sum(f.objective[-1] for f in alone.values())
        if best is None or error < best[0]:
            best = (error, alone)
    anchors = {x: f.h for x, f in best[1].items()}
    starts = {x: f.s[x] for x, f in best[1].items()}
    fits = [tri(edges, nodes, replace(settings, seed=settings.seed + 100 + k), anchors, starts) for k in range(settings.restarts)]
    return min(fits, key=lambda f: f.objective[-1])


def strongest(h: DataFrame) -> DataFrame:
    """(node, c): the column of the largest value, ties to the smaller one."""
    return h.groupBy("node").agg(F.max_by("k", F.struct("value", -F.col("k"))).cast("int").alias("c"))

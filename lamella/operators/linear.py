"""Sparse linear algebra on edges: products with skinny dense factors, and what is built from them.

A dense factor is a table (node, k, value). Only r x r or (layers r) x (layers r)
matrices come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.assignment import cheapest_assignment, k_means
from lamella.functions.sparse import Sparse, leading_pairs
from lamella.operators.incidence import Incidence
from lamella.plans.lineage import cut

#: Entries of a matrix, and rows of a factor, up to which a problem is solved on the driver.
LOCAL_ENTRIES, LOCAL_ROWS = 2_000_000, 50_000


def times(edges: DataFrame | Incidence, h: DataFrame) -> DataFrame:
    """X H: (node, k, value), by layer if ``h`` has one."""
    if isinstance(edges, Incidence):
        return edges.times(h)
    keys = ["layer"] if "layer" in h.columns else []
    own = h.withColumnRenamed("node", "dst")
    return edges.join(own, [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node"), "k").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def gram(a: DataFrame, b: DataFrame) -> DataFrame:
    """A'B: (p, q, value)."""
    keys = ["layer"] if "layer" in a.columns and "layer" in b.columns else []
    x, y = a.select(*keys, "node", F.col("k").alias("p"), F.col("value").alias("x")), b.select(*keys, "node", F.col("k").alias("q"), F.col("value").alias("y"))
    return x.join(y, [*keys, "node"]).groupBy(*keys, "p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def matrix(cells: DataFrame, r: int, c: int | None = None) -> np.ndarray:
    """A small table (p, q, value) as an array."""
    out = np.zeros((r, c or r))
    for x in cells.select("p", "q", "value").collect():
        out[x.p, x.q] = x.value
    return out


def turned(h: DataFrame, m: np.ndarray) -> DataFrame:
    """H M for a small M."""
    spark = h.sparkSession
    rows = [(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    small = spark.createDataFrame(rows, "k int, j int, m double")
    keys = ["layer"] if "layer" in h.columns else []
    return h.join(F.broadcast(small), "k").groupBy(*keys, "node", F.col("j").alias("k")).agg(F.sum(F.col("value") * F.col("m")).alias("value"))


def noise_factor(nodes: DataFrame, r: int, seed: int = 0) -> DataFrame:
    """(node, k, value): reproducible numbers from 0 to 1 by node and column."""
    cells = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("k"))
    return cells.withColumn("value", (F.pmod(F.xxhash64("node", "k", F.lit(seed)), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30))


def eigenpairs(edges: DataFrame, nodes: DataFrame, r: int, by_size: bool = True, extra: int = 4, seed: int = 0, tolerance: float = 1e-6, degree: int = 8, rounds: int = 100, local: int = LOCAL_ENTRIES) -> tuple[np.ndarray, DataFrame]:
    """Leading eigenvalues and (node, k, value) eigenvectors of a symmetric matrix (src, dst, weight).

    Block iteration with some extra columns, filtered by a Chebyshev polynomial of
    ``degree`` and orthonormalised through Gram matrices, until the residuals of the
    r pairs are below ``tolerance`` times the largest eigenvalue; more than
    ``rounds`` filters are an error. by_size: largest magnitudes, else largest values.
    Nodes without edges have no rows. A matrix of ``local`` entries at most is
    solved on the driver, in the same way.
    """
    small = edges.select("src", "dst", "weight").limit(local + 1)
    if local and small.count() <= local:
        return _solved(edges, r, by_size, seed)
    b = r + extra
    bound = float(edges.groupBy("src").agg(F.sum(F.abs("weight")).alias("s")).agg(F.max("s")).first()[0] or 0.0)
    ends = edges.select(F.col("src").alias("node")).distinct()
    h = cut(noise_factor(nodes.join(ends, "node", "left_semi"), b, seed).withColumn("value", F.col("value") - 0.5))
    for _ in range(rounds):
        own = matrix(gram(h, h), b)
        size = np.sqrt(np.maximum(np.diag(own), 1e-300))
        values, vectors = np.linalg.eigh(own / np.outer(size, size))
        keep = values > max(values.max(initial=0), 0) * 1e-12
        h = cut(turned(h, vectors[:, keep] / np.sqrt(values[keep]) / size[:, None]))
        b = int(keep.sum())
        y = cut(times(edges, h))
        small, square = matrix(gram(h, y), b), matrix(gram(y, y), b)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-np.abs(values) if by_size else -values)
        values, vectors = values[order], vectors[:, order]
        residual = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", vectors, square, vectors) - values**2, 0))
        if (residual[:r] <= tolerance * np.abs(values).max(initial=0)).all():
            return values[:r], turned(h, vectors[:, :r])
        # What is not wanted lies in centre +- width, where the polynomial stays within 1.
        edge = max(abs(values[-1]), 1e-3 * np.abs(values).max()) if by_size else values[-1]
        centre, width = (0.0, edge) if by_size else ((edge - bound) / 2, max((edge + bound) / 2, 1e-3 * bound))
        before, h = cut(turned(h, vectors)), cut(combined((1 / width, turned(y, vectors)), (-centre / width, turned(h, vectors))))
        for _ in range(degree - 1):
            before, h = h, cut(combined((2 / width, times(edges, h)), (-2 * centre / width, h), (-1.0, before)))
    raise ArithmeticError(f"eigenvectors have not converged in {rounds} rounds")


def _solved(edges: DataFrame, r: int, by_size: bool, seed: int) -> tuple[np.ndarray, DataFrame]:
    found = edges.select("src", "dst", "weight").toArrow()
    i, j, x = (found.column(c).to_numpy() for c in ("src", "dst", "weight"))
    order = np.lexsort((j, i))
    names = np.unique(np.concatenate([i, j]))
    values, vectors = leading_pairs(Sparse(len(names), np.searchsorted(names, i[order]), np.searchsorted(names, j[order]), x[order].astype(float)), r, by_size, seed=seed)
    return values, as_factor(edges.sparkSession, names, vectors)


def as_factor(spark, names: np.ndarray, h: np.ndarray) -> DataFrame:
    """(node, k, value) of an array with a row for each of ``names``."""
    n, r = h.shape
    table = pa.table({"node": pa.array(np.repeat(names, r), pa.int64()), "k": pa.array(np.tile(np.arange(r, dtype=np.int32), n)), "value": pa.array(np.asarray(h, dtype=float).ravel())})
    return spark.createDataFrame(table)


def combined(*parts: tuple[float, DataFrame]) -> DataFrame:
    """The sum of factors (node, k, value), each with a coefficient."""
    out = None
    for by, h in parts:
        own = h.select("node", "k", (F.col("value") * F.lit(float(by))).alias("value"))
        out = own if out is None else out.unionAll(own)
    return out.groupBy("node", "k").agg(F.sum("value").alias("value"))


def row_normalized(h: DataFrame) -> DataFrame:
    norm = h.groupBy("node").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    return h.join(norm, "node").select("node", "k", F.when(F.col("n") > 1e-15, F.col("value") / F.col("n")).otherwise(F.col("value")).alias("value"))


def vectors_of(h: DataFrame, r: int) -> DataFrame:
    """(node, v): rows as arrays, 0 where a cell is missing."""
    return h.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m")).select("node", F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("v"))


def clustered(h: DataFrame, r: int, dims: int | None = None, restarts: int = 5, mixture: bool = False, local: int = LOCAL_ROWS) -> DataFrame:
    """(node, c): k-means (or a Gaussian mixture) on the rows of a factor, the best of some starts; up to ``local`` rows on the driver."""
    from pyspark.ml.clustering import GaussianMixture, KMeans
    from pyspark.ml.functions import array_to_vector

    found = cut(vectors_of(h, dims or r))
    if not mixture and local and found.limit(local + 1).count() <= local:
        table = found.orderBy("node").toArrow()
        names, points = table.column("node").to_numpy(), np.array(table.column("v").to_pylist(), dtype=float).reshape(table.num_rows, -1)
        labels = k_means(points, r, max(restarts, 20)) if len(points) else np.zeros(0, dtype=int)
        return h.sparkSession.createDataFrame(pa.table({"node": pa.array(names, pa.int64()), "c": pa.array(labels.astype(np.int32))}))
    rows = found.select("node", array_to_vector("v").alias("features"))
    if mixture:
        model = GaussianMixture(k=r, seed=1).fit(rows)
    else:
        model = min((KMeans(k=r, seed=s, initSteps=3, maxIter=50).fit(rows) for s in range(restarts)), key=lambda m: m.summary.trainingCost)
    return model.transform(rows).select("node", F.col("prediction").cast("int").alias("c"))


def expected_adjacency(h: DataFrame, signs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): X D X' for a factor (node, k, value) and signs (k, sign); of all pairs of nodes or of given ones (src, dst)."""
    a = h.join(F.broadcast(signs), "k").select(F.col("node").alias("src"), "k", (F.col("value") * F.col("sign")).alias("x"))
    b = h.select(F.col("node").alias("dst"), "k", F.col("value").alias("y"))
    both = a.join(b, "k") if pairs is None else pairs.select("src", "dst").join(a, "src").join(b, ["dst", "k"])
    return both.groupBy("src", "dst").agg(F.sum(F.col("x") * F.col("y")).alias("weight"))


def absolute_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(distance): the sum of |A - B| over the cells of two matrices (src, dst, weight)."""
    both = a.select("src", "dst", "weight").unionAll(b.select("src", "dst", -F.col("weight"))).groupBy("src", "dst").agg(F.abs(F.sum("weight")).alias("d"))
    return both.agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("distance"))


def largest_rows(edges: DataFrame, n: int) -> DataFrame:
    """(node, norm2): the n rows of largest norm, ties to the smaller node."""
    norm = edges.groupBy(F.col("src").alias("node")).agg(F.round(F.sum(F.col("weight") * F.col("weight")), 9).alias("norm2"))
    return norm.orderBy(F.desc("norm2"), "node").limit(n)


def column_average(edges: DataFrame, chosen: DataFrame, how: str = "mean") -> DataFrame:
    """(node, value): the mean or the median of some columns (column), cells that are not there counting as 0."""
    p = chosen.agg(F.count(F.lit(1)).alias("p"))
    own = edges.join(chosen.withColumnRenamed("column", "dst"), "dst").groupBy(F.col("src").alias("node"))
    if how == "mean":
        return own.agg(F.sum("weight").alias("s")).join(F.broadcast(p)).select("node", (F.col("s") / F.col("p")).alias("value"))
    filled = own.agg(F.collect_list("weight").alias("w")).join(F.broadcast(p))  # a row's cells in the chosen columns
    every = F.array_sort(F.concat("w", F.array_repeat(F.lit(0.0), (F.col("p") - F.size("w")).cast("int"))))
    at = lambda i: F.element_at("v", i.cast("int"))
    return filled.select("node", "p", every.alias("v")).select("node", ((at(F.floor((F.col("p") + 1) / 2)) + at(F.floor((F.col("p") + 2) / 2))) / 2).alias("value"))


def singular_average(columns: np.ndarray) -> np.ndarray:
    """The leading left singular vector of some columns, scaled so that it stands for their mean."""
    u, s, vt = np.linalg.svd(columns, full_matrices=False)
    return u[:, 0] * s[0] * vt[0].mean()


def above(values: DataFrame, rank: int, value: str = "value") -> DataFrame:
    """Rows whose size is that of the ``rank``-th largest one or more."""
    least = values.select(F.abs(value).alias("_s")).orderBy(F.desc("_s")).limit(rank).agg(F.min("_s").alias("_least"))
    return values.join(F.broadcast(least)).filter(F.abs(value) >= F.col("_least")).drop("_least")


def singular_triplets(cells: DataFrame, r: int, local: int = LOCAL_ENTRIES) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(values, left (node, k, value), right) of a rectangular matrix (src, dst, weight), the r largest.

    The right vectors are eigenvectors of X'X; only skinny factors are formed.
    """
    shift = cells.agg(F.max("src").alias("m")).first()[0]
    both = cells.select("src", (F.col("dst") + F.lit((shift or 0) + 1)).alias("dst"), "weight")
    values, vectors = eigenpairs(cut(both.unionAll(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))), both.select(F.col("src").alias("node")).unionAll(both.select("dst")).distinct(), r, False, local=local)
    root = F.col("value") * float(np.sqrt(2))
    left = vectors.filter(F.col("node") <= (shift or 0)).withColumn("value", root)
    right = vectors.filter(F.col("node") > (shift or 0)).select((F.col("node") - ((shift or 0) + 1)).alias("node"), "k", root.alias("value"))
    return values, left, right


def matched_columns(a: DataFrame, b: DataFrame, r: int) -> DataFrame:
    """(k, j, angle): the one-to-one matching of the columns of two factors with the least sum of angles, from 0 to 1, means removed."""
    sums = lambda h, name: h.groupBy("k").agg(F.sum("value").alias("s" + name), F.sum(F.col("value") * F.col("value")).alias("q" + name))
    n = a.select("node").unionAll(b.select("node")).distinct().count()
    cells = {(x.p, x.q): x.value for x in gram(a, b).collect()}  # r * r rows
    one, two = ({x.k: x for x in sums(h, "").collect()} for h in (a, b))
    cost = np.zeros((r, r))
    for i in range(r):
        for j in range(r):
            x, y = one[i], two[j]
            size = np.sqrt(max(x.q - x.s**2 / n, 0) * max(y.q - y.s**2 / n, 0))
            cost[i, j] = np.arccos(np.clip((cells.get((i, j), 0.0) - x.s * y.s / n) / size if size else 0.0, -1, 1)) / np.pi
    columns, _ = cheapest_assignment(cost)
    return a.sparkSession.createDataFrame([(i, int(j), float(cost[i, j])) for i, j in enumerate(columns)], "k int, j int, angle double")


def orthogonal_nnls(edges: DataFrame | Incidence, u: DataFrame) -> DataFrame:
    """(node, c, w): each column of X goes to the column of U at the least angle, ties to the smaller one, with its best weight."""
    norm = u.groupBy("k").agg(F.sum(F.col("value") * F.col("value")).alias("n2"))
    dots = times(edges, u).join(F.broadcast(norm), "k")
    angle = F.round(F.col("value") / (F.sqrt("n2") + 1e-16), 9)
    best = dots.groupBy("node").agg(F.max_by(F.struct("k", "value", "n2"), F.struct(angle, -F.col("k"))).alias("b"))
    return best.select("node", F.col("b.k").alias("c"), (F.col("b.value") / F.col("b.n2")).alias("w"))


def extreme_columns(edges: DataFrame, p: int) -> DataFrame:
    """(node): the p columns nearest to the one of largest norm, by their part along it; ties to the smaller node."""
    norm = edges.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("weight")).alias("n2"))
    first = norm.agg(F.max_by("node", F.struct(F.round("n2", 9), -F.col("node"))).alias("first"))
    column = edges.join(F.broadcast(first), F.col("dst") == F.col("first")).select(F.col("src").alias("dst"), "weight").select(F.col("dst").alias("node"), F.lit(0).alias("k"), F.col("weight").alias("value"))
    part = times(edges, column)
    return part.select("node", F.round("value", 9).alias("part")).orderBy(F.desc("part"), "node").limit(p)


def smoothed_vertices(edges: DataFrame, nodes: DataFrame, r: int, p: int, successive: bool = False, seed: int = 0) -> DataFrame:
    """U (node, k, value): r means of p extreme columns each.

    Each round looks along a direction orthogonal to the means so far: a random one
    in the leading eigenspace, at the end whose median is larger; ``successive``:
    the column with the largest remaining norm, without any noise.
    """
    rng = np.random.default_rng(seed)
    space = None
    if not successive:
        space = cut(eigenpairs(edges, nodes, r)[1])
    basis: list[DataFrame] = []
    out: list[DataFrame] = []
    columns = edges.select(F.col("src").alias("node"), F.col("dst").alias("column"), "weight")
    for k in range(r):
        if successive:
            left = edges.groupBy(F.col("dst").alias("column")).agg(F.sum(F.col("weight") * F.col("weight")).alias("n2"))
            for v in basis:
                along = columns.join(v, "node").groupBy("column").agg(F.sum(F.col("weight") * F.col("value")).alias("x"))
                left = left.join(along, "column", "left").select("column", (F.col("n2") - F.coalesce(F.col("x") * F.col("x"), F.lit(0.0))).alias("n2"))
            first = left.agg(F.max_by("column", F.struct(F.round("n2", 9), -F.col("column"))).alias("column"))
            direction = columns.join(F.broadcast(first), "column").select("node", F.col("weight").alias("value"))
        else:
            direction = turned(space, rng.standard_normal((r, 1))).select("node", "value")
        for v in basis:
            size = v.join(direction.withColumnRenamed("value", "d"), "node").agg(F.sum(F.col("value") * F.col("d"))).first()[0] or 0.0
            direction = direction.unionByName(v.withColumn("value", -F.lit(float(size)) * F.col("value"))).groupBy("node").agg(F.sum("value").alias("value"))
        score = cut(columns.join(direction, "node").groupBy("column").agg(F.round(F.sum(F.col("weight") * F.col("value")), 12).alias("u")))
        ends = [score.orderBy(F.desc("u"), "column").limit(p), score.orderBy("u", "column").limit(p)]
        if successive:
            chosen = ends[0]
        else:
            middle = [abs(x.agg(F.percentile("u", 0.5)).first()[0] or 0.0) for x in ends]
            chosen = ends[0] if middle[0] > middle[1] else ends[1]
        mean = cut(columns.join(F.broadcast(chosen.select("column")), "column").groupBy("node").agg((F.sum("weight") / p).alias("value")))  # p columns
        out.append(mean.select("node", F.lit(k).alias("k"), "value"))
        fresh = mean
        for v in basis:
            size = v.join(mean.withColumnRenamed("value", "d"), "node").agg(F.sum(F.col("value") * F.col("d"))).first()[0] or 0.0
            fresh = fresh.unionByName(v.withColumn("value", -F.lit(float(size)) * F.col("value"))).groupBy("node").agg(F.sum("value").alias("value"))
        norm = float(fresh.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0] or 0.0)
        if norm > 1e-12:
            basis.append(cut(fresh.withColumn("value", F.col("value") / norm)))
    spread = out[0]
    for x in out[1:]:
        spread = spread.unionAll(x)
    return spread

"""Community detection methods by name: each takes (edges, nodes, r, seed) and gives (node, c)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import factors
from lamella.operators.consensus import consensus
from lamella.operators.edges import augmented, layer_sum, layers_of, normalized, squared_without_degrees
from lamella.operators.linear import clustered, eigenpairs, gram, matrix, orthogonal_nnls, row_normalized, smoothed_vertices, turned
from lamella.plans import exact
from lamella.plans.fit import TASK_EDGES, fit_exact, fit_restarts
from lamella.plans.lineage import cut

Method = Callable[[DataFrame, DataFrame, int, int], DataFrame]


def embedded(edges: DataFrame, nodes: DataFrame, r: int, scaled: bool, by_size: bool = True) -> DataFrame:
    """(node, k, value): leading eigenvectors, scaled by the roots of the sizes of their eigenvalues."""
    import numpy as np

    values, vectors = eigenpairs(edges, nodes, r, by_size)
    return turned(vectors, np.diag(np.sqrt(np.abs(values)))) if scaled else vectors


def joint_embedding(edges: DataFrame, nodes: DataFrame, r: int, scaled: bool, rows: str = "none", diagonal: bool = False) -> DataFrame:
    """Embeddings of all layers side by side, and the leading left singular vectors of that.

    rows: ``unit`` for rows of norm 1 in each layer, ``score`` for division by the first vector.
    """
    import numpy as np

    layers = layers_of(edges)
    n = nodes.count()
    wide = None
    for i, layer in enumerate(layers):
        own = edges.filter(F.col("layer") == layer)
        own = (augmented(own, n) if diagonal else own).drop("layer")
        h = embedded(own, nodes, r, scaled)
        if rows == "unit":
            h = row_normalized(h)
        elif rows == "score":
            h = scored(h)
        h = cut(h).withColumn("k", F.col("k") + i * r)
        wide = h if wide is None else wide.unionByName(h)
    wide = cut(wide)
    d = len(layers) * r
    values, vectors = np.linalg.eigh(matrix(gram(wide, wide), d))
    top = np.argsort(-values)[:r]
    return turned(wide, vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12)))


def scored(h: DataFrame) -> DataFrame:
    """Columns divided by the first one, which goes."""
    first = h.filter("k = 0").select("node", F.col("value").alias("f"))
    return h.filter("k > 0").join(first, "node").select("node", "k", F.when(F.abs("f") > 1e-12, F.col("value") / F.col("f")).otherwise(0.0).alias("value"))


def dcmase(scaled: bool = True, rows: str = "unit", mixture: bool = False) -> Method:
    return lambda e, n, r, seed: clustered(joint_embedding(e, n, r, scaled, rows), r, mixture=mixture)


def mase(mixture: bool = False, spherical: bool = False, rows: str = "none") -> Method:
    def run(e, n, r, seed):
        h = joint_embedding(e, n, r, False, rows, diagonal=True)
        return clustered(row_normalized(h) if spherical else h, r, mixture=mixture)

    return run


def aggregate(kind: str) -> Method:
    """Spectral clustering of the sum of the layers: plain, spherical, score or bias-adjusted squares."""

    def run(e, n, r, seed):
        h = embedded(squared_without_degrees(e) if kind == "squares" else layer_sum(e), n, r, False)
        return clustered(scored(h) if kind == "score" else row_normalized(h) if kind != "plain" else h, r)

    return run


def picked(kind: str) -> Method:
    """The same on one layer, chosen by the seed."""

    def run(e, n, r, seed):
        layers = layers_of(e)
        return aggregate(kind)(e.filter(F.col("layer") == layers[seed % len(layers)]), n, r, seed)

    return run


def kernel_sum(edges: DataFrame, nodes: DataFrame, r: int, seed: int) -> DataFrame:
    """Spectral clustering of the sum over layers of the projections on their leading Laplacian vectors."""
    import numpy as np

    n, wide = nodes.count(), None
    for i, layer in enumerate(layers_of(edges)):
        own = normalized(edges.filter(F.col("layer") == layer), n).drop("layer")
        h = cut(embedded(own, nodes, r, False, by_size=False)).withColumn("k", F.col("k") + i * r)
        wide = h if wide is None else wide.unionByName(h)
    wide = cut(wide)
    d = r * len(layers_of(edges))
    values, vectors = np.linalg.eigh(matrix(gram(wide, wide), d))
    top = np.argsort(-values)[:r]
    return clustered(turned(wide, vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))), r)


def laplacian_mean(edges: DataFrame, nodes: DataFrame, r: int, seed: int) -> DataFrame:
    """Clusters of the leading vectors of the sum of the normalised layers."""
    return clustered(embedded(layer_sum(normalized(edges, nodes.count())), nodes, r, False, by_size=False), r)


def mean_adjacency(edges: DataFrame, nodes: DataFrame, r: int, seed: int) -> DataFrame:
    return clustered(embedded(layer_sum(edges), nodes, r, False, by_size=False), r)


def regularised(edges: DataFrame, nodes: DataFrame, r: int, seed: int) -> DataFrame:
    """Row-normalised leading vectors of the normalised sum of the layers."""
    total = layer_sum(edges).withColumn("layer", F.lit("sum"))
    return clustered(row_normalized(embedded(cut(normalized(total, nodes.count())).drop("layer"), nodes, r, False, by_size=False)), r)


def by_size(name: str, far: Method) -> Method:
    """The dense method up to DENSE_NODES nodes, beyond it the distributed one: hundreds of rounds cost a job each there."""
    return lambda e, n, r, seed: dense(name)(e, n, r, seed) if n.limit(DENSE_NODES + 1).count() <= DENSE_NODES else far(e, n, r, seed)


def single(edges: DataFrame, nodes: DataFrame, r: int, seed: int) -> DataFrame:
    """Clusters of the scaled embedding of a graph of one layer."""
    if len(layers_of(edges)) != 1:
        raise ValueError("the embedding of several layers at once is not defined; use mase or dcmase")
    return clustered(embedded(augmented(edges, nodes.count()).drop("layer"), nodes, r, True), r)


#: Nodes that the dense methods hold in one task.
DENSE_NODES = 5000


def dense(name: str) -> Method:
    """A method of functions.small_graphs in one task, which holds layers * nodes^2 numbers; larger graphs are an error."""

    def run(edges, nodes, r, seed):
        from lamella.functions.small_graphs import SMALL
        from lamella.plans.experiments import _trials

        if (n := nodes.limit(DENSE_NODES + 1).count()) > DENSE_NODES:
            raise ValueError(f"over {DENSE_NODES} nodes; {name} is a method for small graphs")
        order = [x.node for x in nodes.select("node").orderBy("node").collect()]  # DENSE_NODES at most
        tags = edges.sparkSession.createDataFrame([(seed,)], "seed int")
        blank = nodes.select("node", F.lit(None).cast("long").alias("label"))
        solve = lambda tag, g, known: [(node, int(c)) for node, c in zip(order, SMALL[name]([g.layer(i).dense() for i in range(g.l)], r, tag["seed"]), strict=True)]
        return _trials(edges, blank, tags, solve, "node long, c int").select("node", "c")

    return run


def base_partitions(edges: DataFrame, nodes: DataFrame, r: int, seed: int, successive: bool = False) -> DataFrame:
    """(layer, node, c): a partition of each layer by extreme columns and nearest directions; nodes without edges get a hashed label."""
    n, out = nodes.count(), None
    for layer in layers_of(edges):
        own = cut(edges.filter(F.col("layer") == layer).drop("layer"))
        u = cut(smoothed_vertices(own, nodes, r, max(2, int(0.1 * n / r)), successive, seed))
        found = nodes.join(orthogonal_nnls(own, u), "node", "left").select(F.lit(layer).alias("layer"), "node", F.coalesce("c", F.pmod(F.xxhash64("node"), F.lit(r)).cast("int")).cast("int").alias("c"))
        out = found if out is None else out.unionByName(found)
    return cut(out)


def joint(init: str = "usenc", shared: bool = False, warm: Method | None = None, trials: int = 10, normalised: bool = False, rounds: int = 50) -> Method:
    """The joint factorization: node by node where a task holds the edges, else all nodes at once."""

    def run(e, n, r, seed):
        start = warm(e, n, r, seed) if warm else None
        own = cut(normalized(e, n.count()) if normalised else e)
        options = exact.Options(r=r, trials=1 if warm else trials, init=init, shared=shared, seed=seed, rounds=rounds)
        if own.limit(TASK_EDGES + 1).count() > TASK_EDGES:
            return fit_restarts(own, n, options, start).assign
        return fit_exact(own, n, options, start).assign

    return run


METHODS: dict[str, Method] = {
    "dcmase": dcmase(),
    "dcmase-gmm": dcmase(mixture=True),
    "dcmase-unscaled": dcmase(scaled=False),
    "mase": mase(),
    "mase-gmm": mase(mixture=True),
    "mase-spherical": mase(spherical=True),
    "mase-score": mase(rows="score"),
    "ave": aggregate("plain"),
    "ave_spherical": aggregate("spherical"),
    "score": aggregate("score"),
    "sq-bias-adjusted": aggregate("squares"),
    "score-onenetwork": picked("score"),
    "spherical-onenetwork": picked("spherical"),
    "speck": kernel_sum,
    "meancluster": laplacian_mean,
    "meanadj": mean_adjacency,
    "dcspectral": regularised,
    "omni": single,
    "lmfo": dense("lmfo"),
    "coreg": dense("coreg"),
    "co-osntf": dense("co-osntf"),
    "consensus": lambda e, n, r, seed: consensus(base_partitions(e, n, r, seed), r),
    "co-association": lambda e, n, r, seed: consensus(base_partitions(e, n, r, seed), r, matrix_free=True),
    "snmf": by_size("snmf", lambda e, n, r, seed: factors.strongest(factors.symmetric(layer_sum(e), n, factors.Settings(r, seed=seed)).h)),
    "csnmf": by_size("csnmf", lambda e, n, r, seed: factors.strongest(factors.collective_symmetric(e, n, factors.Settings(r, seed=seed)).h)),
    "csnmtf": by_size("csnmtf", lambda e, n, r, seed: factors.strongest(factors.collective_tri(e, n, factors.Settings(r, seed=seed, alpha=0.1)).h)),
    "joint": joint(),
    "joint-dcmase": joint(warm=dcmase()),
    "joint-shared": joint(shared=True),
    "joint-shared-normalized": joint(shared=True, normalised=True),
    "us": joint(rounds=0),
}


def detect(name: str, edges: DataFrame, nodes: DataFrame, r: int, seed: int = 0) -> DataFrame:
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(METHODS)}")
    return METHODS[name](edges, nodes, r, seed)

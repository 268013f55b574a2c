"""The joint factorization of all layers as distributed plans."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.sparse import Rows, leading_pairs
from lamella.operators.blocks import block_sums, degree_share, reconstruction, relative_error, unit_weights
from lamella.operators.edges import layers_of
from lamella.operators.incidence import Incidence
from lamella.operators.linear import LOCAL_ENTRIES
from lamella.operators.metrics import weight_change
from lamella.operators.packed import Packed
from lamella.operators.sweep import coefficients, moved_weights, moves
from lamella.plans import exact
from lamella.plans.lineage import cut

#: Edges that one task of the exact solver may hold: 4 bytes each, 8 more where the weights of a layer differ.
TASK_EDGES = 100_000_000


@dataclass
class FitResult:
    """assign: (node, c). weights: (layer, node, w). interactions: (layer, p, q, s). history: by trial and iteration. error: relative."""

    assign: DataFrame
    weights: DataFrame
    interactions: DataFrame
    history: DataFrame
    error: float


def fit_exact(edges: DataFrame, nodes: DataFrame, options: exact.Options, partition: DataFrame | None = None) -> FitResult:
    """Sequential sweeps; every restart is a task that holds the edges, sent through the driver. Larger graphs need :func:`fit_parallel`."""
    spark = edges.sparkSession
    layers = layers_of(edges)
    if (m := edges.count()) > TASK_EDGES:
        raise ValueError(f"{m} edges do not fit a task; use the parallel solver")
    table = (nodes.select("node").join(partition, "node", "left").select("node", "c") if partition is not None else nodes.select("node")).orderBy("node").toArrow()
    names = table.column("node").to_numpy()
    given = table.column("c").to_numpy().astype(np.int64) if partition is not None else None
    parts = [rows_of(edges.filter(F.col("layer") == layer), names) for layer in layers]
    sent = spark.sparkContext.broadcast(parts)

    def graph() -> exact.Layers:
        return exact.Layers(len(names), [Rows(start, columns, np.broadcast_to(x, len(columns))) for start, columns, x in sent.value])

    def vectors(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                start, columns, x = sent.value[k]
                u = leading_pairs(Rows(start, columns, np.broadcast_to(x, len(columns))), options.r)[1]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.ascontiguousarray(u).tobytes()])], ["k", "u"])

    leading = {}
    if given is None and options.init != "random" and layers:  # alike in all restarts
        for x in spark.range(0, len(layers), 1, len(layers)).mapInArrow(vectors, "k long, u binary").collect():
            leading[x.k, options.r] = np.frombuffer(x.u).reshape(len(names), -1)

    def solve(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                g = graph()
                g.leading |= leading
                yield pa.RecordBatch.from_pandas(result(number, exact.trial(g, options, number, given)), preserve_index=False)

    def result(number: int, f: exact.Fit) -> pd.DataFrame:
        out = [("assign", None, int(a), int(b), 0, 0.0, 0.0, 0.0) for a, b in zip(names, f.v, strict=True)]
        out += [("weight", layer, int(a), 0, 0, float(f.w[k, i]), 0.0, 0.0) for k, layer in enumerate(layers) for i, a in enumerate(names)]
        out += [("block", layer, 0, p, q, float(f.s[k, p, q]), 0.0, 0.0) for k, layer in enumerate(layers) for p in range(options.r) for q in range(options.r)]
        out += [("history", None, i, 0, 0, error, change, moved) for i, _, error, change, moved in f.history]
        out.append(("error", None, 0, 0, 0, f.error, 0.0, 0.0))
        frame = pd.DataFrame(out, columns=["kind", "layer", "node", "p", "q", "x", "y", "z"]).astype({"p": "int32", "q": "int32"})
        frame.insert(0, "trial", np.full(len(frame), number, dtype=np.int32))
        return frame

    found = cut(spark.range(0, options.trials, 1, options.trials).mapInArrow(solve, "trial int, kind string, layer string, node long, p int, q int, x double, y double, z double"))
    best = found.filter("kind = 'error'").agg(F.min(F.struct(F.col("x").alias("error"), "trial")).alias("b")).first().b
    own = found.filter(F.col("trial") == best.trial)
    return FitResult(
        own.filter("kind = 'assign'").select("node", F.col("p").alias("c")),
        own.filter("kind = 'weight'").select("layer", "node", F.col("x").alias("w")),
        own.filter("kind = 'block'").select("layer", "p", "q", F.col("x").alias("s")),
        found.filter("kind = 'history'").select("trial", F.col("node").cast("int").alias("iteration"), F.col("x").alias("error"), F.col("y").alias("z_change"), F.col("z").alias("frac_changed")),
        float(best.error),
    )


def rows_of(edges: DataFrame, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(start, columns, weights) of one layer, nodes by their number among ``names``; one weight if all are alike."""
    n, sent = len(names), edges.sparkSession.sparkContext.broadcast(names)
    least, most = edges.agg(F.min("weight"), F.max("weight")).first()

    def cells(batches):
        for batch in batches:
            i, j = (np.searchsorted(sent.value, batch.column(x).to_numpy()) for x in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(i * n + j), *batch.columns[2:]], ["cell", *batch.schema.names[2:]])

    weights = [] if least == most else ["weight"]
    found = edges.select("src", "dst", *weights).mapInArrow(cells, "cell long" + ", weight double" * len(weights)).toArrow()
    cell = found.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable") if weights else None
    cell = cell[order] if weights else np.sort(cell)
    x = found.column("weight").to_numpy()[order] if weights else float(most)
    return np.searchsorted(cell, np.arange(n + 1) * n), (cell % n).astype(np.int32), x


def held(n: int, r: int, layers: int) -> bool:
    """Whether the driver can hold the factors of :func:`fit_restarts`."""
    return n * (r + 4) <= LOCAL_ENTRIES and n * (r + 4) * layers <= 4 * LOCAL_ENTRIES


def fit_restarts(edges: DataFrame | Packed, nodes: DataFrame, options: exact.Options, partition: DataFrame | None = None) -> FitResult:
    """The best of some fits of :func:`fit_parallel`, for graphs that no task holds.

    Each starts from the consensus of partitions of the layers (``random``: from
    hashed labels), or all from ``partition``; no fit begins after the time limit,
    and none sweeps beyond it. Edges are packed by rows, and factors go through the
    driver, as long as it can hold them (``LOCAL_ENTRIES`` for a layer, four times
    that for all). A graph that is packed already is taken as it is.
    """
    from lamella.operators.consensus import consensus
    from lamella.plans.methods import base_partitions

    began, best, histories = time.monotonic(), None, []
    graph, n = edges if isinstance(edges, Packed) else None, nodes.count()
    if graph is None and held(n, options.r, 1):
        graph = Packed(edges, nodes)
    if graph is not edges and (graph is None or not graph.complete or not held(n, options.r, graph.l)):
        graph = cut(edges.select("layer", "src", "dst", "weight"))
    for trial in range(1 if partition is not None else options.trials):
        left = options.seconds - (time.monotonic() - began) if options.seconds else None
        if best is not None and left is not None and left <= 0:
            break
        seed = options.seed + trial
        if partition is not None:
            start = partition
        elif options.init == "random":
            start = nodes.select("node", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(options.r)).cast("int").alias("c"))
        else:
            start = consensus((layer_partitions if isinstance(graph, Packed) else base_partitions)(graph, nodes, options.r, seed), options.r, matrix_free=options.init == "co-association")
        found = fit_parallel(graph, nodes, cut(start), options.r, options.rounds, options.delta, options.shared, left)
        histories.append(found.history.withColumn("trial", F.lit(trial)))
        if best is None or found.error < best.error:
            best = found
    history = histories[0]
    for h in histories[1:]:
        history = history.unionByName(h)
    best.history = history
    return best


def layer_partitions(graph: Packed, nodes: DataFrame, r: int, seed: int) -> DataFrame:
    """(layer, node, c): a partition of each layer, as the exact solver starts from; its products run on the packed rows."""


    def labels(k: int) -> pa.Table:
        c = exact.one_layer(graph, k, r, np.random.default_rng([seed, k]))[1]
        return pa.table({"layer": pa.array([graph.layers[k]] * graph.n, pa.string()), "node": graph.names, "c": c.astype(np.int32)})

    with ThreadPoolExecutor(8) as pool:  # jobs of several layers at once
        parts = list(pool.map(labels, range(graph.l)))
    return cut(nodes.sparkSession.createDataFrame(pa.concat_tables(parts)))


def fit_parallel(edges: DataFrame | Incidence | Packed, nodes: DataFrame, partition: DataFrame, r: int, rounds: int = 10, delta: float = 1e-5, shared: bool = False, seconds: float | None = None) -> FitResult:
    """Parallel sweeps from a partition: all nodes move at once given the last state; the best state is kept.

    Edges stay where they are, in a checkpoint by source; only sums by node and
    community are shuffled in a sweep.
    """
    spark = nodes.sparkSession
    if isinstance(edges, Packed) and (v := edges.labels(partition, r)) is not None:
        return fit_packed(edges, v, r, rounds, delta, shared, seconds)
    if isinstance(edges, DataFrame):
        edges = cut(edges.select("layer", "src", "dst", "weight"))
    layers = layers_of(edges)
    w = cut(unit_weights(degree_share(edges, partition, nodes, layers)))
    s = cut(block_sums(edges, w))
    error = relative_error(reconstruction(edges, s)).first()[0] or 0.0
    best, history, began = (error, w, s), [], time.monotonic()
    for i in range(rounds):
        if seconds is not None and time.monotonic() - began > seconds:
            break
        moved = cut(moves(coefficients(edges, w, s, r, shared), nodes))
        now = cut(unit_weights(moved_weights(moved, layers)))
        s = cut(block_sums(edges, now))
        last, error = error, relative_error(reconstruction(edges, s)).first()[0] or 0.0
        change = weight_change(now, w).first()
        history.append((0, i, error, change.z_change, change.frac_changed))
        w = now
        if error < best[0]:
            best = (error, w, s)
        if delta and (error < delta or abs(last - error) < delta):
            break
    error, w, s = best
    steps = spark.createDataFrame(history, "trial int, iteration int, error double, z_change double, frac_changed double")
    return FitResult(w.select("node", "c").distinct(), w.select("layer", "node", "w"), s, steps, float(error))


def fit_packed(graph: Packed, v: np.ndarray, r: int, rounds: int, delta: float, shared: bool, seconds: float | None) -> FitResult:
    """:func:`fit_parallel` with the state of the nodes on the driver and one product over all layers for each sweep."""
    degree, loop, norm2 = graph.sums
    g, at = SimpleNamespace(l=graph.l, n=graph.n, degree=degree, norm2=norm2), np.arange(graph.n)

    def blocks(w: np.ndarray, v: np.ndarray, near: np.ndarray) -> np.ndarray:
        out = np.zeros((graph.l, r, r))
        for k in range(graph.l):
            np.add.at(out[k], v, w[k][:, None] * near[k])
        return out

    def swept(w: np.ndarray, v: np.ndarray, s: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cost, parts, found = np.zeros((graph.n, r)), np.zeros((3, graph.n, r)), []
        for k in range(graph.l):
            live, own, skk = degree[k] != 0, near[k].copy(), np.diag(s[k])
            own[at, v] -= loop[k] * w[k]
            total = np.bincount(v, w[k] ** 2, minlength=r) @ s[k] ** 2
            c1 = 2 * (total - (w[k][:, None] * s[k][v]) ** 2) - 2 * skk * loop[k][:, None]
            terms = 4 * np.broadcast_to(skk**2, c1.shape), 2 * c1, -4 * own @ s[k]
            if shared:
                parts += [np.where(live[:, None], x, 0) for x in terms]
            else:
                x, f = exact.least_on_half_line(*terms)
                cost += np.where(live[:, None], f, 0)
                found.append(np.where(live[:, None], x, 0))
        if shared:
            x, cost = exact.least_on_half_line(*parts)
            found = [x] * graph.l
        best = np.argmin(np.round(cost, 9), axis=1)
        best[~(degree != 0).any(axis=0)] = 0
        return exact.normalize(np.stack([x[at, best] for x in found]), best, r), best

    w = exact.normalize(exact.degree_shares(g, v, r), v, r)
    near = graph.gathered(w, v, r)
    s = blocks(w, v, near)
    error = exact.relative_error(g, s)
    best, history, began = (error, w, v, s), [], time.monotonic()
    for i in range(rounds):
        if seconds is not None and time.monotonic() - began > seconds:
            break
        w2, v2 = swept(w, v, s, near)
        change, size = np.where(v2 == v, (w2 - w) ** 2, w2**2 + w**2).sum(), (w**2).sum()
        moved = float((v2 != v).mean())
        w, v, near = w2, v2, graph.gathered(w2, v2, r)
        s, last = blocks(w, v, near), error
        error = exact.relative_error(g, s)
        history.append((0, i, error, float(np.sqrt(change / size)) if size else 0.0, moved))
        if error < best[0]:
            best = (error, w, v, s)
        if delta and (error < delta or abs(last - error) < delta):
            break
    error, w, v, s = best
    spark, layer = graph.spark, lambda m: pa.array(np.repeat(graph.layers, m), pa.string())
    p, q = (x.ravel().astype(np.int32) for x in np.indices((r, r)))
    tables = (
        {"node": graph.names, "c": v.astype(np.int32)},
        {"layer": layer(graph.n), "node": np.tile(graph.names, graph.l), "w": w.ravel()},
        {"layer": layer(r * r), "p": np.tile(p, graph.l), "q": np.tile(q, graph.l), "s": s.ravel()},
    )
    steps = spark.createDataFrame(history, "trial int, iteration int, error double, z_change double, frac_changed double")
    return FitResult(*(spark.createDataFrame(pa.table(x)) for x in tables), steps, error)

"""Listed graphs packed by rows, for many products with one graph.

Edges are shuffled once and never joined: a product sends the factor, a row for
each node, to the blocks of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.sparse import Rows, leading_pairs
from lamella.operators.incidence import batch
from lamella.plans.lineage import cut

#: Cells of a block of rows at most, and edges that a task deals out at once.
CELLS, DEALT = 1 << 22, 1 << 20
#: Columns of a tile of bits at most.
TILE = 1 << 15


class Packed:
    """The graph (layer, src, dst, weight) over some nodes, in a checkpoint: 4 bytes for each edge, 8 more where the weights of a block differ.

    complete: no edge leaves the nodes; such edges are not held.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame):
        self.spark, self.names = nodes.sparkSession, np.unique(nodes.select("node").dropna().toArrow().column(0).to_numpy())
        sc, n = self.spark.sparkContext, len(self.names)
        width = max(1, min(-(-n // (4 * sc.defaultParallelism)), CELLS // max(1, n)))
        sent = sc.broadcast(self.names)

        def dealt(batches):
            held = []
            for b in batches:
                held.append(b)
                if sum(x.num_rows for x in held) >= DEALT:
                    yield from chunks(pa.Table.from_batches(held))
                    held = []
            if held:
                yield from chunks(pa.Table.from_batches(held))

        def chunks(table):
            names = sent.value
            layer = table.column("layer").combine_chunks().dictionary_encode()
            ends, known = [], np.ones(table.num_rows, dtype=bool)
            for c in ("src", "dst"):
                x = table.column(c).to_numpy()
                ends.append(np.minimum(np.searchsorted(names, x), max(0, n - 1)))
                known &= (names[ends[-1]] == x) if n else False
            if not known.all():
                yield packed_row(None, -1, b"", b"", b"")
            group = layer.indices.to_numpy().astype(np.int64) * -(-n // width) + ends[0] // width
            order = np.argsort(group[known], kind="stable")
            group, i, j, w = (x[known][order] for x in (group, ends[0] % width, ends[1], table.column("weight").to_numpy()))
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(group)], strict=True):
                code, block = divmod(int(group[a]), -(-n // width))
                yield packed_row(layer.dictionary[code].as_py(), block * width, i[a:b].astype(np.int32).tobytes(), j[a:b].astype(np.int32).tobytes(), shortened(w[a:b]))

        def joined(batches):
            last, held = None, []
            for b in batches:
                for x in b.to_pylist():
                    if last is not None and (x["layer"], x["first"]) != last:
                        yield whole(last, held)
                        held = []
                    last = x["layer"], x["first"]
                    held.append(x)
            if held:
                yield whole(last, held)

        def whole(key, held):
            if key[0] is None:
                return packed_row(None, -1, b"", b"", b"")
            i, j = (np.concatenate([np.frombuffer(x[c], dtype=np.int32) for x in held]) for c in ("start", "columns"))
            w = np.concatenate([lengthened(x["weights"], len(x["columns"]) // 4) for x in held])
            order = np.lexsort((j, i))
            start = np.searchsorted(i[order], np.arange(min(width, n - key[1]) + 1))
            return packed_row(*key, start.astype(np.int64).tobytes(), j[order].tobytes(), shortened(w[order]))

        schema = "layer string, first int, start binary, columns binary, weights binary"
        listed = edges.select("layer", "src", "dst", F.col("weight").cast("double").alias("weight")).dropna(subset=["layer", "weight"])
        apart = listed.mapInArrow(dealt, schema).repartition(max(1, -(-n // width)), "layer", "first").sortWithinPartitions("layer", "first")
        found = cut(apart.mapInArrow(joined, schema))
        #: (layer, first, start, columns, weights): some rows of a layer from number ``first`` on.
        self.blocks = found.filter("layer is not null").coalesce(2 * sc.defaultParallelism)
        kinds = [r.layer for r in found.select("layer").distinct().collect()]
        self.layers, self.complete = sorted(x for x in kinds if x is not None), None not in kinds
        self.n, self.l = n, len(self.layers)
        self.leading: dict[tuple[int, int], np.ndarray] = {}

    def mapped(self, run: Callable[[str, int, Rows], Iterator[pa.RecordBatch]], schema: str, layer: str | None = None) -> DataFrame:
        """What ``run`` gives for the blocks: their layer, the number of their first row, their rows."""

        def part(batches):
            for b in batches:
                for x in b.to_pylist():
                    columns = np.frombuffer(x["columns"], dtype=np.int32)
                    yield from run(x["layer"], x["first"], Rows(np.frombuffer(x["start"], dtype=np.int64), columns, lengthened(x["weights"], len(columns))))

        return (self.blocks if layer is None else self.blocks.filter(F.col("layer") == layer)).mapInArrow(part, schema)

    def _by_node(self, value: Callable[[int, Rows], np.ndarray], name: str) -> DataFrame:
        """(layer, node, name) of the nodes with edges."""
        sent = self.spark.sparkContext.broadcast(self.names)

        def run(layer, first, own):
            some = np.flatnonzero(np.diff(own.start))
            yield batch(layer=pa.array([layer] * len(some), pa.string()), node=sent.value[first + some], x=value(first, own)[some])

        return self.mapped(run, "layer string, node long, x double").withColumnRenamed("x", name)

    def degrees(self) -> DataFrame:
        """(layer, node, deg): row sums of the nodes with edges."""
        n = self.n
        return self._by_node(lambda _, own: own.times(np.ones((n, 1)))[:, 0], "deg")

    def loops(self) -> DataFrame:
        """(layer, node, loop): the diagonal, for nodes with edges."""
        return self._by_node(lambda first, own: diagonal(first, own), "loop")

    def norms(self) -> DataFrame:
        """(layer, norm2): squared Frobenius norms."""

        def run(layer, first, own):
            yield batch(layer=[layer], x=[float(sum((x * x).sum() for _, _, x in own.blocks()))])

        return self.mapped(run, "layer string, x double").groupBy("layer").agg(F.sum("x").alias("norm2"))

    def times(self, h: DataFrame, loops: bool = True) -> DataFrame:
        """X H by layer: (layer, node, k, value), cells of 0 left out; h: (layer, node, k, value). loops: with the diagonal."""
        sc = self.spark.sparkContext
        sent, names = sc.broadcast(self.factors(h)), sc.broadcast(self.names)

        def run(layer, first, own):
            if (f := sent.value.get(layer)) is not None:
                y = own.times(f)
                if not loops:
                    y = y - diagonal(first, own)[:, None] * f[first : first + own.n]
                i, k = np.nonzero(y)
                yield batch(layer=pa.array([layer] * len(i), pa.string()), node=names.value[first + i], k=k.astype(np.int32), value=y[i, k])

        return self.mapped(run, "layer string, node long, k int, value double")

    def factors(self, h: DataFrame) -> dict[str, np.ndarray]:
        """(layer, node, k, value) as arrays by layer."""
        table, r = h.select("layer", "node", "k", "value").toArrow(), 0
        layer, node, k, value = (table.column(c) for c in table.column_names)
        factors, at, k, value = {}, np.minimum(np.searchsorted(self.names, node.to_numpy()), max(0, self.n - 1)), k.to_numpy(), value.to_numpy()
        known, r = (self.names[at] == node.to_numpy()) if self.n else np.zeros(len(at), dtype=bool), int(k.max(initial=-1)) + 1
        codes = layer.combine_chunks().dictionary_encode()
        for c, name in enumerate(codes.dictionary.to_pylist()):
            own = known & (codes.indices.to_numpy() == c)
            factors[name] = np.zeros((self.n, r))
            np.add.at(factors[name], (at[own], k[own]), value[own])
        return factors

    def labels(self, partition: DataFrame, r: int) -> np.ndarray | None:
        """The labels of the nodes in order; None unless each has one, from 0 to r - 1."""
        table = partition.select("node", "c").dropna().toArrow()
        node, c = table.column("node").to_numpy(), table.column("c").to_numpy().astype(np.int64)
        order = np.argsort(node)
        return c[order] if np.array_equal(node[order], self.names) and ((c >= 0) & (c < r)).all() else None

    @cached_property
    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(degree, loop, norm2): degrees and loops by layer and node, squared norms by layer."""
        n = self.n

        def run(layer, first, own):
            sums = own.times(np.ones((n, 1)))[:, 0], diagonal(first, own), np.full(own.n, sum((x * x).sum() for _, _, x in own.blocks()) / own.n)
            yield filled(layer, first, np.column_stack(sums))

        degree, loop, norm2 = np.moveaxis(self._collected(run, 3), 2, 0)
        return degree, loop, norm2.sum(axis=1)

    def gathered(self, w: np.ndarray, v: np.ndarray, r: int) -> np.ndarray:
        """(layers, nodes, r): the weights (layers, nodes) of each node's neighbours, summed by their labels, a product for all layers."""
        sent, n = self.spark.sparkContext.broadcast((dict(zip(self.layers, w, strict=True)), v)), self.n

        def run(layer, first, own):
            h = np.zeros((n, r))
            h[np.arange(n), sent.value[1]] = sent.value[0][layer]
            yield filled(layer, first, own.times(h))

        out = self._collected(run, r)
        sent.unpersist()
        return out

    def _collected(self, run: Callable[[str, int, Rows], Iterator[pa.RecordBatch]], r: int, layer: str | None = None) -> np.ndarray:
        """(layers, nodes, r) from what ``run`` gives by :func:`filled`: r numbers for each node come to the driver."""
        out = np.zeros((self.l, self.n, r))
        for x in self.mapped(run, "layer string, first int, y binary", layer).collect():
            y = np.frombuffer(x.y).reshape(-1, r)
            out[self.layers.index(x.layer), x.first : x.first + len(y)] = y
        return out

    def layer(self, k: int) -> Layer:
        return Layer(self, self.layers[k])

    def vectors(self, k: int, r: int) -> np.ndarray:
        """The leading eigenvectors of a layer."""
        if (k, r) not in self.leading:
            self.leading[k, r] = leading_pairs(self.layer(k), r)[1]
        return self.leading[k, r]


class Tiled(Packed):
    """An undirected graph without loops and weights, as bits of the cells above the diagonal: a bit for every two nodes, in a checkpoint by layer.

    drawn(k, i, a, b): whether node i is joined in layer k with nodes a to b, all of
    them after it; called in tasks. Nothing is shuffled: a product takes each tile
    both ways, and sums of its rows and columns come to the driver.
    """

    def __init__(self, spark: SparkSession, names: np.ndarray, layers: list[str], drawn: Callable[[int, int, int, int], np.ndarray]):
        self.spark, self.names, self.n, self.l, self.layers, self.complete = spark, names, len(names), len(layers), layers, True
        self.leading, n = {}, len(names)
        strips = max(1, min(round((3 * spark.sparkContext.defaultParallelism) ** 0.5), n // 1024), -(-n // TILE))
        #: Columns and rows of a tile.
        self.wide = max(1, -(-n // strips))
        self.high = max(1, -(-self.wide // 4))
        tiles = [(i, j) for j in range(0, n, self.wide) for i in range(0, min(j + self.wide, n), self.high)]
        sent = spark.sparkContext.broadcast((drawn, tiles, self.wide, self.high, n))

        def made(k: int) -> DataFrame:
            def part(batches):
                drawn, tiles, wide, high, n = sent.value
                for b in batches:
                    for i, j in (tiles[t] for t in b.column(0).to_pylist()):
                        last, end, some = min(i + high, j + wide, n), min(j + wide, n), max(1, CELLS // wide)
                        for first in range(i, last, some):
                            bits = np.zeros((min(first + some, last) - first, end - j), dtype=bool)
                            for x in range(len(bits)):
                                a = max(j, first + x + 1)
                                if a < end:
                                    bits[x, a - j :] = drawn(k, first + x, a, end)
                            yield batch(top=pa.array([i], pa.int32()), first=pa.array([first], pa.int32()), begin=pa.array([j], pa.int32()), bits=[np.packbits(bits, axis=1, bitorder="little").tobytes()])

            return cut(spark.range(0, len(tiles), 1, max(1, len(tiles))).mapInArrow(part, "top int, first int, begin int, bits binary"))

        self.tiles = [made(k) for k in range(self.l)]
        some = [k for k in range(self.l) if self.sums[0][k].any()]
        if len(some) < self.l:  # layers without edges are none
            self.tiles, self.layers, self.l = [self.tiles[k] for k in some], [layers[k] for k in some], len(some)
            del self.sums

    def products(self, factors: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """X H of some layers, each with a factor of its own."""
        sent, n, wide, high = self.spark.sparkContext.broadcast(factors), self.n, self.wide, self.high

        def part(batches):
            out = {}
            for b in batches:
                for x, (k, top, first, begin) in enumerate(zip(*(b.column(c).to_pylist() for c in ("k", "top", "first", "begin")), strict=True)):
                    end, h = min(begin + wide, n), sent.value[k]
                    bits = np.frombuffer(b.column("bits")[x].as_buffer(), dtype=np.uint8).reshape(-1, -(-(end - begin) // 8))
                    down = out.setdefault((k, top), np.zeros((min(high, n - top), h.shape[1])))
                    across = out.setdefault((k, begin), np.zeros((end - begin, h.shape[1]))) if begin != top else down
                    if len(across) < end - begin:  # rows and columns begin alike
                        across = out[k, begin] = np.concatenate([across, np.zeros((end - begin - len(across), h.shape[1]))])
                        down = across[: len(down)]
                    for a in range(0, len(bits), 32):
                        left = max(0, first + a - begin) // 8  # no cell lies before the diagonal
                        cells = np.unpackbits(bits[a : a + 32, left:], axis=1, count=end - begin - 8 * left, bitorder="little").astype(float)
                        at = slice(first + a, first + a + len(cells))
                        down[at.start - top : at.stop - top] += cells @ h[begin + 8 * left : end]
                        across[8 * left :] += cells.T @ h[at]
            for (k, first), y in out.items():
                yield batch(k=pa.array([k], pa.int32()), first=pa.array([first], pa.int32()), y=[y.tobytes()])

        every = [self.tiles[k].coalesce(2 * self.spark.sparkContext.defaultParallelism).select(F.lit(k).alias("k"), "*") for k in factors]
        found = {k: np.zeros(h.shape) for k, h in factors.items()}
        if n and every:
            for x in reduce(DataFrame.unionAll, every).mapInArrow(part, "k int, first int, y binary").collect():
                y = np.frombuffer(x.y).reshape(-1, factors[x.k].shape[1])
                found[x.k][x.first : x.first + len(y)] += y
        sent.unpersist()
        return found

    @cached_property
    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one = np.ones((self.n, 1))
        degree = self._stacked(self.products({k: one for k in range(self.l)}), 1)[:, :, 0]
        return degree, np.zeros_like(degree), degree.sum(axis=1)

    def gathered(self, w: np.ndarray, v: np.ndarray, r: int) -> np.ndarray:
        factors = {k: np.zeros((self.n, r)) for k in range(self.l)}
        for k, h in factors.items():
            h[np.arange(self.n), v] = w[k]
        return self._stacked(self.products(factors), r)

    def _stacked(self, found: dict[int, np.ndarray], r: int) -> np.ndarray:
        return np.stack([found[k] for k in range(self.l)]) if self.l else np.zeros((0, self.n, r))

    def layer(self, k: int) -> TiledLayer:
        return TiledLayer(self, k)

    def _listed(self, value: np.ndarray, name: str) -> DataFrame:
        k, i = np.nonzero(self.sums[0])
        table = pa.table({"layer": pa.array([self.layers[x] for x in k], pa.string()), "node": self.names[i], name: value[k, i]})
        return self.spark.createDataFrame(table)

    def degrees(self) -> DataFrame:
        return self._listed(self.sums[0], "deg")

    def loops(self) -> DataFrame:
        return self._listed(self.sums[1], "loop")

    def norms(self) -> DataFrame:
        return self.spark.createDataFrame(list(zip(self.layers, self.sums[2].tolist(), strict=True)), "layer string, norm2 double")

    def times(self, h: DataFrame, loops: bool = True) -> DataFrame:
        factors = self.factors(h)
        found = self.products({self.layers.index(x): f for x, f in factors.items() if x in self.layers})
        parts = []
        for layer, y in ((self.layers[k], y) for k, y in found.items()):
            i, k = np.nonzero(y)
            parts.append(pa.table({"layer": pa.array([layer] * len(i), pa.string()), "node": self.names[i], "k": pa.array(k, pa.int32()), "value": y[i, k]}))
        none = pa.table({"layer": pa.array([], pa.string()), "node": pa.array([], pa.int64()), "k": pa.array([], pa.int32()), "value": pa.array([], pa.float64())})
        return self.spark.createDataFrame(pa.concat_tables([none, *parts]))


class Layer:
    """A layer for methods that hold factors but no edges, as :class:`~lamella.functions.sparse.Rows`."""

    def __init__(self, graph: Packed, name: str):
        self.graph, self.name, self.n = graph, name, graph.n

    def _filled(self, value: Callable[[Rows], np.ndarray], r: int) -> np.ndarray:
        def run(layer, first, own):
            yield filled(layer, first, value(own))

        return self.graph._collected(run, r, self.name)[self.graph.layers.index(self.name)]

    def times(self, h: np.ndarray) -> np.ndarray:
        sent = self.graph.spark.sparkContext.broadcast(np.asarray(h, dtype=float))
        out = self._filled(lambda own: own.times(sent.value), h.shape[1])
        sent.unpersist()
        return out

    def column_mean(self, chosen: np.ndarray) -> np.ndarray:
        h = np.zeros((self.n, 1))
        h[chosen] = 1
        return self.times(h)[:, 0] / len(chosen)

    def bound(self) -> float:
        n = self.n
        return float(self._filled(lambda own: Rows(own.start, own.columns, np.abs(own.values)).times(np.ones((n, 1))), 1).max())

    def dense(self) -> np.ndarray:
        return self.times(np.eye(self.n))


class TiledLayer(Layer):
    def __init__(self, graph: Tiled, k: int):
        super().__init__(graph, graph.layers[k])
        self.k = k

    def times(self, h: np.ndarray) -> np.ndarray:
        return self.graph.products({self.k: np.asarray(h, dtype=float)})[self.k]

    def bound(self) -> float:
        return float(self.graph.sums[0][self.k].max())


def filled(layer: str, first: int, y: np.ndarray) -> pa.RecordBatch:
    return batch(layer=[layer], first=pa.array([first], pa.int32()), y=[np.ascontiguousarray(y, dtype=float).tobytes()])


def diagonal(first: int, own: Rows) -> np.ndarray:
    """The loops of a block of rows."""
    out = np.zeros(own.n)
    for i, j, x in own.blocks():
        np.add.at(out, i[j == i + first], x[j == i + first])
    return out


def shortened(w: np.ndarray) -> bytes:
    """Weights, one if all are alike."""
    return (w[:1] if len(w) and (w == w[0]).all() else w).astype(float).tobytes()


def lengthened(weights: bytes, m: int) -> np.ndarray:
    w = np.frombuffer(weights)
    return np.broadcast_to(w, m) if len(w) == 1 else w


def packed_row(layer: str | None, first: int, start: bytes, columns: bytes, weights: bytes) -> pa.RecordBatch:
    return batch(layer=pa.array([layer], pa.string()), first=pa.array([first], pa.int32()), start=[start], columns=[columns], weights=[weights])

"""Graphs of shared slots, held as the slots of their nodes instead of as edges.

Two nodes of a layer are joined with the number of slots that both have. With B
the matrix of nodes and slots, a layer is B B' without its diagonal. So degrees,
products and norms follow from sums by slot, and nothing grows with the number of
edges; :class:`Whole` makes rows of a layer one at a time where those are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.plans.lineage import cut

#: Bytes of the adjacency that a task holds at once.
HELD_BYTES = 48 << 20


class Incidence:
    """The graph of rows (layer, slot, node). Slots of one node make no edge and are left out."""

    def __init__(self, seen: DataFrame):
        spark, kind = seen.sparkSession, seen.schema["slot"].dataType.simpleString()
        rows = cut(seen.select("layer", "slot", "node").dropna().groupBy("layer", "node").agg(F.collect_set("slot").alias("slots")))
        each = rows.select("layer", "node", F.explode("slots").alias("slot"))
        found = each.groupBy("layer", "slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("layer", "slot").collect()  # a row for each slot: hours, not events
        self.spark, self.layers = spark, sorted({r.layer for r in found})
        #: Where each layer's slots begin among all.
        self.first = [sum(r.layer < x for r in found) for x in self.layers] + [len(found)]
        #: (key, layer, slot, n): slots by number, and how many nodes each has.
        self.slots = spark.createDataFrame([(i, r.layer, r.slot, r.n) for i, r in enumerate(found)], f"key int, layer string, slot {kind}, n long")
        #: (layer, node, keys): the slots of each node that has edges.
        self.rows = cut(each.join(F.broadcast(self.slots), ["layer", "slot"]).groupBy("layer", "node").agg(F.sort_array(F.collect_list("key")).alias("keys")))

    def exploded(self) -> DataFrame:
        return self.rows.select("layer", "node", F.explode("keys").alias("key"))

    def degrees(self) -> DataFrame:
        """(layer, node, deg): row sums of the nodes with edges."""
        return self.exploded().join(F.broadcast(self.slots.select("key", "n")), "key").groupBy("layer", "node").agg(F.sum(F.col("n") - 1).cast("double").alias("deg"))

    def norms(self) -> DataFrame:
        """(layer, norm2): B B' and B'B have one norm, and the slots that nodes share are few next to the edges."""
        a = self.rows.select("layer", "keys", F.explode("keys").alias("a"))
        shared = a.select("layer", "a", F.explode("keys").alias("b")).filter("a < b").groupBy("layer", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("o"))
        parts = shared.groupBy("layer").agg(F.sum(2 * F.col("o") * F.col("o")).alias("x"))
        parts = parts.unionAll(self.slots.groupBy("layer").agg(F.sum(F.col("n").cast("double") * F.col("n"))))
        parts = parts.unionAll(self.rows.groupBy("layer").agg(-F.sum(F.size("keys").cast("double") * F.size("keys"))))
        return parts.groupBy("layer").agg(F.sum("x").alias("norm2"))

    def times(self, h: DataFrame) -> DataFrame:
        """X H: (node, k, value) of the sum of the layers, by layer if ``h`` has one. Rows without a neighbour in ``h`` are left out."""
        by = ["layer"] if "layer" in h.columns else []
        own = self.rows.join(h, [*by, "node"])
        sums = own.select(F.explode("keys").alias("key"), "k", "value").groupBy("key", "k").agg(F.sum("value").alias("y"), F.count(F.lit(1)).alias("m"))
        every = self.exploded().join(F.broadcast(sums), "key").groupBy(*by, "node", "k").agg(F.sum("y").alias("y"), F.sum("m").alias("m"))  # slots * k rows
        mine = own.groupBy(*by, "node", "k").agg(F.sum(F.size("keys") * F.col("value")).alias("v"), F.sum(F.size("keys")).alias("s"))
        both = every.join(mine, [*by, "node", "k"], "left").filter(F.col("m") > F.coalesce("s", F.lit(0)))
        return both.select(*by, "node", "k", (F.col("y") - F.coalesce("v", F.lit(0.0))).alias("value"))

    @cached_property
    def whole(self) -> Whole:
        """All slots of all nodes as arrays, 8 bytes for each: for work on every pair of nodes, which is far more."""
        table = self.rows.select("node", "keys").toArrow()
        names, at = np.unique(table.column("node").to_numpy(), return_inverse=True)
        lists = table.column("keys").combine_chunks()
        node = np.repeat(at, lists.value_lengths().to_numpy()).astype(np.int32)
        key = lists.flatten().to_numpy().astype(np.int32)
        by_node, by_key = np.lexsort((key, node)), np.lexsort((node, key))
        slots = int(self.first[-1])
        return Whole(names, list(self.layers), self.first, np.searchsorted(node[by_node], np.arange(len(names) + 1)), key[by_node], np.searchsorted(key[by_key], np.arange(slots + 1)), node[by_key])

    @cached_property
    def twins(self) -> list[Twins]:
        """The classes of alike nodes of each layer."""
        return [Twins.of(self.whole, layer) for layer in range(len(self.layers))]

    def mapped(self, run: Callable[[Whole, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``run`` gives for the whole graph and the numbers of a task's nodes; no edge is shuffled or kept."""
        n = len(self.whole.names)
        return self.dealt(self.whole, n, lambda g, c, tasks: run(g, np.arange(c, n, tasks)), schema)

    def mapped_twins(self, run: Callable[[Twins, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``run`` gives for each layer and the numbers of a task's classes there."""
        most = max((len(t.size) for t in self.twins), default=0)

        def every(twins, c, tasks):
            for t in twins:
                yield from run(t, np.arange(c, len(t.size), tasks))

        return self.dealt(self.twins, most, every, schema)

    def dealt(self, held: object, n: int, run: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``run`` gives for ``held``, the number of a task and how many there are; at most n."""
        sc = self.spark.sparkContext
        sent, tasks = sc.broadcast(held), max(1, min(n, 4 * sc.defaultParallelism))

        def part(batches):
            for batch in batches:
                for c in batch.column(0).to_pylist():
                    yield from run(sent.value, c, tasks)

        return self.spark.range(0, tasks, 1, tasks).mapInArrow(part, schema)


@dataclass
class Whole:
    """names: of the nodes, in order. first: where each layer's slots begin. start, keys: slots by node. begin, members: nodes by slot."""

    names: np.ndarray
    layers: list[str]
    first: np.ndarray
    start: np.ndarray
    keys: np.ndarray
    begin: np.ndarray
    members: np.ndarray

    def of(self, i: int, layer: int | None = None) -> np.ndarray:
        own = self.keys[self.start[i] : self.start[i + 1]]
        return own if layer is None else own[slice(*np.searchsorted(own, self.first[layer : layer + 2]))]

    def row(self, i: int, layer: int | None = None) -> np.ndarray:
        """A node's weights with all nodes, in one layer or in the sum."""
        own = self.of(i, layer)
        if not len(own):
            return np.zeros(len(self.names), dtype=np.int64)
        out = np.bincount(np.concatenate([self.members[self.begin[k] : self.begin[k + 1]] for k in own]), minlength=len(self.names))
        out[i] = 0
        return out

    def degrees(self, layer: int) -> np.ndarray:
        """Row sums of a layer."""
        a, b = self.first[layer], self.first[layer + 1]
        inside = self.members[self.begin[a] : self.begin[b]]
        return np.bincount(inside, np.repeat(np.diff(self.begin[a : b + 1]) - 1, np.diff(self.begin[a : b + 1])), len(self.names))

    def bits(self, keys: range, at: np.ndarray) -> np.ndarray:
        """Bit sets of the members among the nodes ``at`` (consecutive numbers), a row for each of some slots."""
        out = np.zeros((len(keys), len(at)), dtype=bool)
        for j, k in enumerate(keys):
            x = self.members[self.begin[k] : self.begin[k + 1]]
            out[j, x[slice(*np.searchsorted(x, (at[0], at[-1] + 1)))] - at[0]] = True
        return words(out)

    def blocks(self, rows: int) -> list[np.ndarray]:
        """All nodes in blocks of columns, so that ``rows`` bit sets of a block fit."""
        n = len(self.names)
        width = max(64, HELD_BYTES * 8 // max(1, rows) // 64 * 64)
        return [np.arange(a, min(a + width, n)) for a in range(0, n, width)]


@dataclass
class Twins:
    """Nodes of a layer in classes: those with the same slots have the same neighbours but for each other, and are joined.

    Classes are in order of their sizes, and their columns in bit sets so that no
    word has two sizes. start, keys: slots by class, from 0. place: columns. word:
    the size of the classes of each word. names: of the nodes by class, from
    ``begin`` on.
    """

    layer: str
    slots: int
    start: np.ndarray
    keys: np.ndarray
    size: np.ndarray
    place: np.ndarray
    word: np.ndarray
    names: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, g: Whole, layer: int) -> Twins:
        inside = (g.keys >= g.first[layer]) & (g.keys < g.first[layer + 1])
        ends = np.concatenate([[0], np.cumsum(inside)])[g.start]
        keys = (g.keys[inside] - g.first[layer]).astype(np.int32)
        text, known = keys.tobytes(), {}
        some = np.flatnonzero(np.diff(ends))
        found = np.array([known.setdefault(text[4 * a : 4 * b], len(known)) for a, b in zip(ends[some].tolist(), ends[some + 1].tolist(), strict=True)], dtype=np.int64)
        size = np.bincount(found, minlength=len(known))
        order = np.argsort(size, kind="stable")
        found, size, lists = np.argsort(order)[found], size[order], [np.frombuffer(x, dtype=np.int32) for x in known]
        sizes, many = np.unique(size, return_counts=True)
        wide = -(-many // 64)
        place = np.concatenate([np.zeros(0, dtype=np.int64), *(64 * a + np.arange(m) for a, m in zip(np.cumsum(wide) - wide, many, strict=True))])
        keys = np.concatenate([np.zeros(0, dtype=np.int32), *(lists[c] for c in order)])
        start = np.concatenate([[0], np.cumsum([len(lists[c]) for c in order], dtype=np.int64)])
        return cls(g.layers[layer], g.first[layer + 1] - g.first[layer], start, keys, size, place, np.repeat(sizes, wide), g.names[some][np.argsort(found, kind="stable")], np.concatenate([[0], np.cumsum(size)]))

    def bits(self, a: int, b: int) -> np.ndarray:
        """Bit sets of the classes of each slot, words a to b."""
        out = np.zeros((self.slots, 64 * (b - a)), dtype=bool)
        c = np.repeat(np.arange(len(self.size)), np.diff(self.start))
        own = (self.place[c] >= 64 * a) & (self.place[c] < 64 * b)
        out[self.keys[own], self.place[c[own]] - 64 * a] = True
        return words(out)

    def near(self, bits: np.ndarray, i: int, a: int = 0) -> np.ndarray:
        """The other classes that are joined with one, as a bit set; bits: the words of the slots from a on."""
        row = np.bitwise_or.reduce(bits[self.keys[self.start[i] : self.start[i + 1]]], axis=0)
        if 0 <= (x := int(self.place[i]) - 64 * a) < 64 * len(row):
            row[x >> 6] &= ~(np.uint64(1) << np.uint64(x & 63))
        return row


def words(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))

"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed size. The distinct blocks of the corpus are
sorted and each gets an integer name, its rank; then adjacent names are paired
and every distinct pair gets an integer name, again and again, until a document
has one name. Two documents have the same name exactly when their texts are
equal: a name stands for content, not for a digest of it.

Plan. The text is shuffled once, to sort the distinct blocks (each task sends a
block that it has met already only once in a while, so a block that a third of
the rows share stays small). The documents keep 64-bit digests of their blocks;
a digest leads to a name without the text, as the sorted table tells which
digests belong to one block only. Documents with a digest that two different
blocks share look their names up by the blocks themselves. Pairs are named by
their first occurrence, which a partial aggregate finds before the shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import as_bytes, cut, map_batches, partitions, rows_with_key

#: Bytes in a block.
BLOCK = 1024
#: Key ranges of the sort; each gets the ranks from its own multiple of 2**43.
RANGES = 1 << 16
#: Blocks that a task remembers having sent.
REMEMBERED = 4096
#: Digests shared by different blocks that are sent to every task; beyond it, all blocks travel with their digests.
CLASHES = 100_000


@dataclass(frozen=True)
class BlockNaming:
    """block: bytes of a block. digest_bits: width of the block digests, less than 64 in tests only."""

    block: int = BLOCK
    digest_bits: int = 64

    def digest(self, part: bytes) -> int:
        return xxhash.xxh64_intdigest(part) >> (64 - self.digest_bits)

    def cut_up(self, text: bytes) -> list[bytes]:
        """Blocks of a text with A-Z lower-cased; the empty text has one empty block."""
        text = text.lower()  # of bytes, so no other letter changes
        return [text[i : i + self.block] for i in range(0, len(text), self.block)] or [b""]

    def sorted_names(self, docs: DataFrame, text_col: str) -> DataFrame:
        """(digest, name, part) of the distinct blocks; part is null unless another block has the digest."""

        def send(batches):
            sent: set[bytes] = set()
            for batch in batches:
                out: list[bytes] = []
                for text in as_bytes(batch.column(0)):
                    for part in self.cut_up(text):
                        if part not in sent:
                            if len(sent) >= REMEMBERED:
                                sent.clear()
                            sent.add(part)
                            out.append(part)
                digests = [self.digest(x) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d * RANGES >> self.digest_bits for d in digests], pa.int32()), pa.array([d - (1 << 63) for d in digests], pa.int64()), pa.array(out, pa.binary())],
                    ["key_range", "digest", "part"],
                )

        def rank(batches):
            at, n, held = -1, 0, None  # held: the last block, until the next tells whether they share a digest
            for batch in batches:
                out = []
                for r, d, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if r != at:
                        at, n = r, 0
                    if held and held[0] == d and held[2] == p:
                        continue
                    clash = bool(held) and held[0] == d
                    if held:
                        out.append((held[0], held[1], held[2] if held[3] or clash else None))
                    held, n = (d, (r << 43) + n, p, clash), n + 1
                yield named(out)
            if held:
                yield named([(held[0], held[1], held[2] if held[3] else None)])

        def named(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["digest", "name", "part"])

        blocks = docs.select(F.col(text_col).alias("text")).mapInArrow(send, "key_range int, digest long, part binary")
        ordered = blocks.repartition(partitions(docs.sparkSession), "key_range").sortWithinPartitions("key_range", "digest", "part")
        return cut(ordered.mapInArrow(rank, "digest long, name long, part binary"))

    def rows(self, docs: DataFrame, id_col: str, text_col: str, clashes: set[int] | None, row_col: str | None = None) -> DataFrame:
        """(row_id, doc_id, text_sha256, digests, parts): parts are null but for digests in ``clashes`` (None: all)."""

        def run(batch):
            shas, digests, parts = [], [], []
            for text in as_bytes(batch.column(2)):
                shas.append(hashlib.sha256(text.lower()).hexdigest())
                own = self.cut_up(text)
                of = [self.digest(x) - (1 << 63) for x in own]
                digests.append(of)
                parts.append([x if clashes is None or d in clashes else None for x, d in zip(own, of, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shas, pa.string()), pa.array(digests, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.binary()))],
                ["row_id", "doc_id", "text_sha256", "digests", "parts"],
            )

        kind = docs.schema[id_col].dataType.simpleString()
        row = F.col(row_col) if row_col else F.monotonically_increasing_id()
        chosen = docs.select(row.alias("row_id"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return cut(map_batches(chosen, run, f"row_id long, doc_id {kind}, text_sha256 string, digests array<long>, parts array<binary>"))

    def identities(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
        """(row_id, doc_id, text_sha256, depth, name): (depth, name) are equal exactly when the texts are. row_id is ``row_col`` if given."""
        names = self.sorted_names(docs, text_col)
        clash = names.filter(F.col("part").isNotNull()).select("digest").distinct().limit(CLASHES + 1).collect()
        clashes = {r.digest for r in clash} if len(clash) <= CLASHES else None
        if clashes is None:
            names = names.filter("part is not null").unionByName(self._filled(docs, names, text_col))
        rows = self.rows(docs, id_col, text_col, clashes, row_col)
        blocks = rows.select("row_id", F.size("digests").alias("n"), F.posexplode(F.arrays_zip("digests", "parts")).alias("pos", "x"))
        blocks = blocks.select("row_id", "n", "pos", F.col("x.digests").alias("digest"), F.col("x.parts").alias("part"))
        same = (blocks.digest == names.digest) & blocks.part.eqNullSafe(names.part)
        level = cut(blocks.join(names, same).select("row_id", "n", "pos", "name", F.monotonically_increasing_id().alias("place")))
        longest = rows.agg(F.max(F.size("digests"))).first()[0] or 1
        done, depth = [level.filter("n = 1").select("row_id", F.lit(0).alias("depth"), "name")], 0
        while longest > 1:
            pairs = (
                level.filter("n > 1")
                .groupBy("row_id", F.shiftright("pos", 1).alias("pos"), F.expr("(n + 1) div 2").cast("int").alias("n"))
                .agg(
                    F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                    F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),  # -1: no partner
                    F.min("place").alias("place"),
                )
            )
            pairs = cut(pairs)
            # Names in a table of their own, so that Spark can split the other side of a frequent pair.
            names = cut(pairs.groupBy("a", "b").agg(F.min("place").alias("name")))
            level = cut(pairs.join(names, ["a", "b"]).select("row_id", "n", "pos", "name", "place"))
            longest, depth = (longest + 1) // 2, depth + 1
            done.append(level.filter("n = 1").select("row_id", F.lit(depth).alias("depth"), "name"))
        return rows.select("row_id", "doc_id", "text_sha256").join(reduce(DataFrame.unionAll, done), "row_id")

    def _filled(self, docs: DataFrame, names: DataFrame, text_col: str) -> DataFrame:
        """Names whose blocks were left out, with their blocks."""

        def send(batch):
            parts = list({x for text in as_bytes(batch.column(0)) for x in self.cut_up(text)})
            yield pa.RecordBatch.from_arrays([pa.array([self.digest(x) - (1 << 63) for x in parts], pa.int64()), pa.array(parts, pa.binary())], ["digest", "part"])

        blocks = map_batches(docs.select(F.col(text_col).alias("text")), send, "digest long, part binary").distinct()
        return names.filter("part is null").drop("part").join(blocks, "digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", naming: BlockNaming = BlockNaming()) -> DataFrame:
    """Groups of equal texts, a row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal: identical after lower-casing A-Z. Null text counts as empty. The row
    with the largest id of a group stays; a null id is smaller than any other.
    Of rows with the same id and text one is kept. An empty table gives no rows;
    other columns are ignored. One task holds one text at a time besides a batch.
    """
    return decided(docs, id_col, text_col, naming).drop("row_id")


def decided(docs: DataFrame, id_col: str, text_col: str, naming: BlockNaming, row_col: str | None = None) -> DataFrame:
    """The rows of :func:`exact_groups` with their row_id, which is ``row_col`` if given."""
    found = cut(naming.identities(docs, id_col, text_col, row_col))
    best = found.groupBy("depth", "name").agg(F.max(F.struct("doc_id", "row_id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # With the groups in a table of their own, Spark can split a hot group's side of the join.
    return found.join(cut(best), ["depth", "name"]).select(
        "row_id", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", naming: BlockNaming = BlockNaming()) -> DataFrame:
    """``docs`` without exactly the rows that :func:`exact_groups` does not keep, all columns as they are.

    Decided row by row, so ids may be null or repeat.
    """
    rows, key = rows_with_key(docs, id_col)
    gone = cut(decided(rows, id_col, text_col, naming, key).filter("not kept").select(F.col("row_id").alias("_gone")))
    left = rows.join(gone, rows[key] == gone["_gone"], "left_anti")
    return left if key == id_col else left.drop(key)

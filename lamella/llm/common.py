"""Helpers shared by the training-data operators.

Every helper keeps its memory bounded by a byte budget, not by a row count, so
that a partition of very long texts costs no more than one of short texts.
"""

from __future__ import annotations

import gc
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.plans.lineage import cut, shared_dir

#: Bytes of text that the vectorised kernels take at once.
SLICE_BYTES = 1 << 20

#: The end of a word of two bytes or more.
WORD_END = re.compile(rb"[^ \n]{2}[ \n]")

#: Rows of ids and numbers that the driver, or every task, may hold: some MB.
HELD_ROWS = 1 << 16

#: White space of the word contracts: x20 and x09 to x0D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def cut_narrow(df: DataFrame) -> DataFrame:
    """:func:`cut` for tables of ids and numbers, in an eighth of the shuffle partitions.

    Partitions are as many as texts ask for; rows of a few numbers are a small part
    of that, and each file of a checkpoint or a shuffle takes a disk block at least.
    """
    return cut(narrowed(df))


def narrowed(df: DataFrame) -> DataFrame:
    return df.coalesce(max(8, partitions(df.sparkSession) // 8))


def told(df: DataFrame) -> DataFrame:
    """A checkpointed table, marked to be sent to every task if it has HELD_ROWS at most: a join with it then shuffles nothing."""
    return F.broadcast(df) if df.count() <= HELD_ROWS else df


def release(spark: SparkSession) -> None:
    """Shuffle files and checkpoints of tables that nothing refers to any more go now, not when the driver's heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rows_with_key(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` and the name of a long column that tells its rows apart.

    That is the id where it is a long, never null and never repeats; else a column
    of its own, for which the rows are written to the shared folder.
    """
    if docs.schema[id_col].dataType.simpleString() == "bigint":
        again = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter(f"n > 1 or {id_col} is null")
        if not again.limit(1).count():
            return docs, id_col
    spark, key = docs.sparkSession, "_row"
    while key in docs.columns:
        key += "_"
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    docs.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path), key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(column: str, modulus: int) -> F.Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def crc32_of(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def by_size(items: list, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose lengths sum to about ``most``; one item at least."""
    start, total = 0, 0
    for i, x in enumerate(items):
        if i > start and total + len(x) > most:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(items):
        yield start, len(items)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def splitmix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, as a counter-based generator of reproducible noise."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: list[bytes], most: int = SLICE_BYTES, docs: int = 512) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Slices of at most about ``most`` bytes and ``docs`` pieces: the pieces, and which text each is of.

    A text above ``most`` is cut, after a word of two bytes or more where there is
    one near, so memory does not grow with the longest text.
    """
    held, of, total = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while True:
            end = len(text)
            if end - start > most:
                end = start + most
                # After a word of two bytes or more, so letters that stand apart stay together.
                space = max((m.end() for m in WORD_END.finditer(text, max(start, end - 4096), end)), default=0)
                if space > start:
                    end = space
                else:
                    while text[end] & 0xC0 == 0x80:
                        end -= 1
            if held and (total + end - start > most or len(held) >= docs):
                yield held, np.array(of)
                held, of, total = [], [], 0
            held.append(text[start:end])
            of.append(i)
            total += end - start
            start = end
            if start >= len(text):
                break
    if held:
        yield held, np.array(of)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label): at most ``per_class`` documents of each label, the first by a hash of the id.

    Only rows whose crc32(id as text) mod 5 is not 0 are read as labelled. Of
    several labels of one id the largest counts, of several texts the first in
    order; null labels and ids do not count.
    """
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", 5) != 0))
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    first = [known.filter(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for x in (0, 1)]
    chosen = cut(first[0].unionAll(first[1])).withColumnRenamed("doc_id", "_id")
    # Bounded by 2 * per_class ids, so it is sent to every task.
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = own.join(F.broadcast(chosen), own["doc_id"] == F.col("_id"))
    return found.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "label")

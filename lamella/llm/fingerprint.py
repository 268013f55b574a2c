"""Document fingerprints by content-defined chunking.

A gear hash of the last 16 bytes marks places to cut. A chunk has at least
``least`` bytes, so no mark depends on what stands before its chunk; until the
normal size a mark needs more zero bits than after it, which keeps chunk sizes
near the normal one. The fingerprint is the set of chunk digests with their
lengths; an edit changes the chunks around it and no others. Likeness is the
share of one fingerprint's bytes that the other has too (containment).

For the neighbour in id order the texts are dealt out once, by ranges of ids
that hold about as many rows each; the first row of a range is sent to the range
before it as well, so no task sees more than a range.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import SLICE_BYTES, partitions, splitmix64


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes: least (16 at least, the hash's window), normal, most (256 at most). Bits: zero bits of a mark before and after the normal size."""

    least: int = 16
    normal: int = 40
    most: int = 160
    bits_before: int = 6
    bits_after: int = 4

    def marks(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places after which a chunk may end, and whether they may before the normal size."""
        gear = (splitmix64(np.arange(256, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
        h = gear[data]
        for k in (1, 2, 4, 8):  # h[i] = sum of gear[data[i - j]] << j over the last 2 k bytes
            if len(h) > k:
                h[k:] += h[:-k] << np.uint16(k)
        at = np.flatnonzero(h >> np.uint16(16 - self.bits_after) == 0)
        return at, h[at] >> np.uint16(16 - self.bits_before) == 0

    def ends(self, n: int, at: list[int], strong: list[bool], base: int = 0) -> list[int]:
        """Ends of the chunks of ``n`` bytes whose marks are ``at``, counted from ``base``."""
        out, start = [], 0
        for p, s in zip(at, strong, strict=True):
            p += 1 - base
            while p - start > self.most:
                start += self.most
                out.append(start)
            size = p - start
            if size >= self.normal or s and size >= self.least:
                out.append(p)
                start = p
        while n - start > self.most:
            start += self.most
            out.append(start)
        if n > start:
            out.append(n)
        return out

    def sets(self, texts: list[bytes]) -> list[frozenset[int]]:
        """For each text its chunks, as digest << 8 | length - 1."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        at, strong = self.marks(data)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        first = np.searchsorted(at, offsets).tolist()
        at_list, strong_list, digest = at.tolist(), strong.tolist(), xxhash.xxh64_intdigest
        out = []
        for i, text in enumerate(texts):
            a, b = first[i], first[i + 1]
            start, own = 0, set()
            for end in self.ends(len(text), at_list[a:b], strong_list[a:b], int(offsets[i])):
                own.add((digest(text[start:end]) & 0xFFFFFFFF) << 8 | (end - start - 1))
                start = end
            out.append(frozenset(own))
        return out


def written(chunks: frozenset[int]) -> str:
    """A fingerprint as text: ten hex digits for each chunk, in order."""
    return "".join(f"{x:010x}" for x in sorted(chunks))


def containment(a: frozenset[int], b: frozenset[int]) -> float:
    """Share of the bytes of ``a`` whose chunks ``b`` has; two empty texts are alike."""
    if not a:
        return 0.0 if b else 1.0
    both = a & b
    return sum((x & 255) + 1 for x in both) / sum((x & 255) + 1 for x in a) if both else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunking: Chunking = Chunking()) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; null counts as empty, whose fingerprint is empty."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            texts = ["" if x is None else x for x in texts]
            found, held, size = [], [], 0
            for x in texts:
                held.append(x.encode())
                size += len(x)
                if size > SLICE_BYTES:
                    found += map(written, chunking.sets(held))
                    held, size = [], 0
            found += map(written, chunking.sets(held))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in texts], pa.int64()), pa.array(found, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunking: Chunking = Chunking()) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document in descending order of the id;
    after the last comes the first. Rows with one id are in the order of their
    texts; null ids come last; null text counts as empty. One document is its own
    next. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = chosen.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = np.unique(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("int")
    def id_range(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(bounds, ids[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    # The first row of each range: as many as there are ranges.
    firsts = chosen.select("doc_id").groupBy(id_range("doc_id").alias("r")).agg(F.max("doc_id").alias("first")).orderBy("r").collect()
    before = [(firsts[i].r, firsts[i - 1].first) for i in range(len(firsts))]  # the lowest range is followed by the highest
    follow = spark.createDataFrame(before, "r int, first long")
    wanted = [f for _, f in before if f is not None]
    is_first = F.col("doc_id").isin(wanted) if wanted else F.lit(False)
    if len(wanted) < len(before):
        is_first = is_first | F.col("doc_id").isNull()
    heads = chosen.filter(is_first).groupBy("doc_id").agg(F.min("text").alias("text"))
    tails = heads.join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("first"))).select("r", F.lit(1).alias("tail"), "doc_id", "text")
    dealt = chosen.select(id_range("doc_id").alias("r"), F.lit(0).alias("tail"), "doc_id", "text").unionByName(tails)
    dealt = dealt.repartition(n, "r").sortWithinPartitions("r", "tail", F.desc_nulls_last("doc_id"), "text")

    def measure(held: list[tuple[int, str, str]]):
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, after in held]
        raw = [x.encode() for x in edited]
        own, changed, following = (chunking.sets(x) for x in ([t.encode() for _, t, _ in held], raw, [x.encode() for _, _, x in held]))
        columns = [
            pa.array([x for x, _, _ in held], pa.int64()),
            pa.array([len(x) for _, x, _ in held], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
            pa.array(map(written, own), pa.string()),
            pa.array(map(written, changed), pa.string()),
            pa.array([containment(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
            pa.array([containment(a, b) for a, b in zip(own, following, strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        last, held, size = None, [], 0
        for batch in batches:
            for tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if last is not None:
                    held.append((*last, text))
                    size += len(last[1]) + len(text)
                last = None if tail else (doc_id, text)
                if size > SLICE_BYTES:
                    yield measure(held)
                    held, size = [], 0
        if held:
            yield measure(held)

    return dealt.select("tail", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )

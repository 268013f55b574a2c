"""SimHash near-dedup by Golay-code fuzzy hashing.

The [23, 12, 7] Golay code is perfect: each 23-bit word is within three bits of
one codeword. A word hashes to the codeword it decodes to; as a word three bits
away may cross to another codeword when a bit changes, it also hashes to the
five codewords four bits away. Words that differ in one bit at most then meet:
the codeword that either decodes to is among the keys of the other.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. If two
fingerprints differ in two bits at most, some segment has no error and the next
one (in a circle) has one error at most. So a key is a whole segment together
with a codeword index of the next one, 33 or 34 bits; one side gives the nearest
codeword of each of the three pairs of segments, the other side all the nearby
ones, and candidates are verified by their Hamming distance.

Distinct fingerprints are joined, not documents. A key that very many of them
share is not joined: its fingerprints give all their one-bit changes instead,
and the fingerprints around one such middle, which differ in two bits at most,
are linked to the least of them. That finds the same components in linear size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import HELD_ROWS, as_bytes, cut, cut_narrow, map_batches, narrowed, release, rows_with_key, splitmix64, told
from lamella.llm.components import components

#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011
#: (first bit, bits) of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints that decode to one key and are still joined with each other.
JOINED = 256
#: Buckets of shingles whose parities are kept of each text.
PARITY = 1024
#: Most frequent shingles that are told to every task, to put them last.
COMMON = 1 << 20


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the error within three bits, and the keys: six errors that lead to codewords, -1 where there are fewer."""
    words = np.arange(1 << 23, dtype=np.uint32)
    bits = np.bitwise_count(words)
    near = words[bits <= 4]
    syndromes = syndrome(near)
    errors = np.zeros(1 << 11, dtype=np.int64)
    keys = np.full((1 << 11, 6), -1, dtype=np.int64)
    weight = np.bitwise_count(near)
    close = weight <= 3
    errors[syndromes[close]] = near[close]
    keys[:, 0] = errors
    far = near[(weight == 4) & (np.bitwise_count(errors[syndromes].astype(np.uint32)) == 3)]
    order = np.argsort(syndrome(far), kind="stable")
    far = far[order]
    of = syndrome(far)
    rank = np.arange(len(far)) - np.searchsorted(of, of)
    keys[of, 1 + rank] = far
    return errors, keys


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    out = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        out = np.where(out >> np.uint32(bit) & np.uint32(1), out ^ np.uint32(GENERATOR << (bit - 11)), out)
    return out


def key_arrays(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) keys of the nearest codewords, (n, 18) keys of all nearby codewords, -1 for none."""
    errors, nearby = golay()
    parts = [(fingerprints >> np.uint64(first)) & np.uint64((1 << bits) - 1) for first, bits in SEGMENTS]
    near, every = [], []
    for i in range(3):
        exact, other = parts[i].astype(np.int64), parts[(i + 1) % 3].astype(np.int64)
        s = syndrome(other)
        base = (np.int64(i) << 34) | (exact << 12)
        near.append(base | (other ^ errors[s]) >> 11)  # the 12 message bits of a codeword are its upper ones
        every.append(np.where(nearby[s] < 0, -1, base[:, None] | (other[:, None] ^ nearby[s]) >> 11))
    return np.stack(near, axis=1), np.concatenate(every, axis=1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words of an A-Z-lowered text, repeats included."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    data = np.frombuffer(line, dtype=np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces[words - 1 :].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends, strict=False)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        some = np.ascontiguousarray(hashes[i : i + (1 << 14)], dtype="<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes)))


def parities(shingles: np.ndarray) -> bytes:
    """A bit for each bucket: whether an odd number of the distinct shingles falls into it."""
    return np.packbits(np.bincount((shingles >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1).tobytes()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@dataclass(frozen=True)
class SimHash:
    """words: words of a shingle. joined: see JOINED."""

    words: int = 3
    joined: int = JOINED

    def fingerprints(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, fp): fp holds the 64 bits as a signed integer."""

        def run(batch):
            found = [signed(fingerprint(shingle_hashes(x, self.words))) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

        kind = docs.schema[id_col].dataType.simpleString()
        return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fp long")

    def links(self, distinct: DataFrame) -> DataFrame:
        """Edges (a, b) between values of the column fp that differ in two bits at most.

        Every such pair is joined by a path of edges; pairs under keys of at most
        ``joined`` fingerprints are edges themselves.
        """

        def keys(which: int):
            def run(batch):
                values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = key_arrays(values.view(np.uint64))[which]
                kept = found >= 0
                yield pa.RecordBatch.from_arrays([pa.array(found[kept]), pa.array(np.repeat(values, kept.sum(axis=1)))], ["key", "fp"])

            return map_batches(distinct.select("fp"), run, "key long, fp long")

        near, every = cut_narrow(keys(0)), keys(1)
        counts = near.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        hot = cut_narrow(counts.filter(F.col("n") > self.joined).select("key"))
        joined = near.withColumnRenamed("fp", "a")
        crowded = bool(hot.limit(1).count())
        if crowded:
            joined = joined.join(hot, "key", "left_anti")
        pairs = every.withColumnRenamed("fp", "b").join(joined, "key").filter("a <> b")
        pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
        if not crowded:
            return pairs.distinct()
        rest = every.join(hot, "key", "left_semi").select("fp").distinct()

        def middles(batch):
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, len(values), 1 << 12):
                some = values[i : i + (1 << 12)]
                flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
                around = (some[:, None] ^ flips[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(around), pa.array(np.repeat(some.view(np.int64), 65))], ["middle", "fp"])

        around = map_batches(rest, middles, "middle long, fp long")
        stars = around.groupBy("middle").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        return pairs.unionAll(around.join(stars, "middle").filter("a <> fp").select("a", F.col("fp").alias("b"))).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", simhash: SimHash = SimHash()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Texts link where their fingerprints differ in two bits at most; component_id
    is the smallest id reachable. Null text counts as empty, whose fingerprint is
    zero and links like any other. Rows that repeat an id each get a row. A null
    id is never a component_id unless a component has no other. An empty table
    gives no rows; other columns are ignored.
    """
    prints = cut(simhash.fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(simhash.links(distinct)))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named)
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(best, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class NearCopies:
    """Groups of texts whose sets of word shingles are alike.

    words: of a shingle. similarity: least Jaccard similarity of a link. bands of
    ``rows`` minima each. joined: texts under one band whose pairs are all looked
    at; those of larger bands meet in an exact join (:meth:`crowded`). more: rounds
    of other pivots before it, which only make it smaller. agreeing:
    minima, of all, that texts must share before their sets are compared; at a
    similarity of 0.8 fewer are shared with a probability of 2e-07. PARITY: a bit
    tells whether a bucket of shingles holds an odd number of them. Each bit in which
    two texts differ stands for a shingle that only one of them has, so pairs that
    differ in more bits than a link allows go without a look at their sets, and none
    that is alike does.

    At a similarity of 0.8 fingerprints of 64 bits differ in 6 to 18 bits, beyond
    what Golay keys of that length can find. So the Golay links (two bits) are
    joined by candidates that share a band of minima of the shingle hashes; every
    candidate is verified on the whole sets.

    The search goes from few pairs to many, and leaves out what is in one group by
    then: each text with one of the pivots of its bands, with three more, with all
    of them, with all texts of its small bands, and the exact join of crowded ones.
    A band's pivot is the text whose hash with the band's key is least, so a text
    meets as many members of a large group as it shares bands with it. Whole texts
    are never shuffled: a Bloom filter of bounded size picks those whose sets
    are needed, and only the sets travel.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 2
    joined: int = 32
    agreeing: int = 13
    more: int = 4

    def shingles(self, text: bytes) -> np.ndarray:
        """Distinct shingle hashes in order; a text without words has the hash zero."""
        return self.set_of(shingle_hashes(text, self.words))

    def set_of(self, hashes: np.ndarray) -> np.ndarray:
        return np.unique(hashes) if len(hashes) else np.zeros(1, dtype=np.uint64)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The least value of each of bands * rows hash functions."""
        salts = np.array([0xD1B54A32D192ED03 * (i + 1) % (1 << 64) for i in range(self.bands * self.rows)], dtype=np.uint64)[:, None]
        return np.min([splitmix64(hashes[None, i : i + 4096] ^ salts).min(axis=1) for i in range(0, len(hashes), 4096)], axis=0)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A key for each band."""
        key = np.arange(self.bands, dtype=np.uint64)
        for own in minima.reshape(self.bands, self.rows).T:
            key = splitmix64(key ^ own)
        return key.view(np.int64)

    def sketches(self, docs: DataFrame) -> DataFrame:
        """(doc_id, fp, n, keys, sig): sig has sixteen bits of each minimum, then the parities."""

        def run(batch):
            ids, prints, sizes, keys, signs = batch.column(0), [], [], [], []
            for text in as_bytes(batch.column(1)):
                hashes = shingle_hashes(text, self.words)
                own = self.set_of(hashes)
                least = self.minima(own)
                prints.append(signed(fingerprint(hashes)))
                sizes.append(len(own))
                keys.append(self.keys(least))
                signs.append((least & np.uint64(0xFFFF)).astype("<u2").tobytes() + parities(own))
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())], ["doc_id", "fp", "n", "keys", "sig"])

        return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, n long, keys array<long>, sig binary")

    def chosen(self, docs: DataFrame, ids: DataFrame, run, schema: str) -> DataFrame:
        """``run`` over batches (doc_id, text) of the documents with one of ``ids`` and, as a Bloom filter picks them, of few others."""
        bits = bloom(ids)

        def some(batch):
            kept = batch.filter(pa.array(in_bloom(bits, batch.column(2).to_numpy())))
            if kept.num_rows:
                yield from run(kept)

        return map_batches(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")), some, schema)

    def close(self, x: str, y: str) -> Column:
        """Whether sets of these sizes can be alike."""
        return F.least(x, y) >= F.floor(self.similarity * F.greatest(x, y))

    def stars(self, sketches: DataFrame, bands: DataFrame) -> DataFrame:
        """(a, b): each text a with the pivot b of each of its bands, if their sizes are close."""
        own = sketches.select("doc_id", "n", F.explode("keys").alias("key")).join(bands.select("key", "pivot"), "key")
        return own.filter((F.col("doc_id") != F.col("pivot.doc_id")) & self.close("n", "pivot.n")).select(F.col("doc_id").alias("a"), F.col("pivot.doc_id").alias("b"))

    def golay(self, sketches: DataFrame) -> DataFrame:
        """(a, b) of fingerprints that differ in two bits at most."""
        prints = cut_narrow(sketches.groupBy("fp").agg(F.min("doc_id").alias("least")))
        links = SimHash(self.words).links(prints.select("fp"))
        of = lambda name: prints.select(F.col("fp").alias("_" + name), F.col("least").alias("d" + name))
        linked = links.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b")).select(F.greatest("da", "db").alias("a"), F.least("da", "db").alias("b"))
        same = sketches.select("doc_id", "fp").join(prints, "fp").filter("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
        return linked.unionAll(same)

    def groups(self, docs: DataFrame) -> DataFrame:
        """(doc_id, component_id) of the documents that are near copies of another one; component_id is the smallest id of the group. Ids must be distinct and not null."""
        release(docs.sparkSession)
        sketches = cut(self.sketches(docs))
        banded = sketches.select("doc_id", "n", F.explode("keys").alias("key"))
        bands = cut_narrow(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("doc_id", "key").alias("h"), "doc_id", "n")).alias("pivot")).filter("m > 1"))
        stars = self.stars(sketches, bands).unionAll(self.golay(sketches)).distinct()
        turn = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b"))  # of a text's few pivots
        stars = cut_narrow(stars.withColumn("turn", turn))
        found = cut_narrow(components(self.verified(docs, sketches, cut_narrow(stars.filter("turn = 1"))), HELD_ROWS))
        for some in ("turn between 2 and 4", "turn > 4"):
            found = self.grown(found, docs, sketches, self.apart(stars.filter(some), found))
        banded = banded.join(bands.select("key", "m"), "key")
        rooted = self.mixed(banded, found)
        for salt in range(1, 1 + self.more):  # other pivots of crowded bands, while they find links
            many = rooted.filter(F.col("m") > self.joined)
            pivots = many.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id", "key", F.lit(salt)).alias("h"), "doc_id", "n", "root")).alias("pivot"))
            pairs = many.join(pivots, "key").filter((F.col("root") != F.col("pivot.root")) & self.close("n", "pivot.n"))
            now = self.grown(found, docs, sketches, pairs.select(F.col("doc_id").alias("a"), F.col("pivot.doc_id").alias("b")).distinct())
            if now is found:
                break
            found, rooted = now, self.mixed(rooted.drop("root"), now)
        few = rooted.filter(F.col("m") <= self.joined)
        x, y = (few.select("key", F.col("doc_id").alias(i), F.col("n").alias("n" + i), F.col("root").alias("r" + i)) for i in "ab")
        pairs = x.join(y, "key").filter("a > b and ra <> rb").filter(self.close("na", "nb")).select("a", "b").distinct()
        found = self.grown(found, docs, sketches, pairs)
        hot = cut_narrow(rooted.filter(F.col("m") > self.joined).select("doc_id").distinct())
        if hot.limit(1).count():
            found = self.grown(found, docs, sketches, self.crowded(docs, hot, found))
        return found.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))

    def mixed(self, banded: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of bands whose texts are in different groups, with their root."""
        rooted = banded.join(told(found).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        kept = cut_narrow(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"))
        return cut_narrow(rooted.join(kept, "key"))

    def grown(self, found: DataFrame, docs: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
        """The groups (node, root) after those of the pairs (a, b) that are alike have joined theirs."""
        release(docs.sparkSession)
        pairs = cut_narrow(pairs)
        if not pairs.limit(1).count():
            return found
        alike = self.verified(docs, sketches, pairs)
        if not alike.limit(1).count():
            return found
        return cut_narrow(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b").unionAll(alike), HELD_ROWS))

    def apart(self, pairs: DataFrame, found: DataFrame) -> DataFrame:
        """The pairs whose texts are in different groups."""
        found = told(found)
        of = lambda name: found.select(F.col("node").alias(name), F.col("root").alias("r" + name))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def crowded(self, docs: DataFrame, hot: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs (a, b) to verify: all of the texts ``hot`` that can be alike and have no common root in ``found``.

        Texts list their shingles in one order, rare ones first. If x and y are alike,
        they share at least t = s / (1 + s) of the sum of their sizes; where their
        first common shingle is at i and j, they share no more than what is left
        after it, so that n_x + n_y <= min(n_x - i, n_y - j) / t. Texts meet under
        their shingles within that bound, by classes of size, so a common passage
        brings together only texts that it can make alike. The order decides how
        many pairs there are, not which links are found.
        """
        most = (1 + self.similarity) / self.similarity

        def listed(batch):
            found = [self.shingles(x).view(np.int64) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["shingle"])

        counts = self.chosen(docs, hot, listed, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > self.joined)
        common = counts.orderBy(F.desc("m"), "shingle").limit(COMMON).toPandas().sort_values("shingle")
        names, times = common["shingle"].to_numpy(np.int64), common["m"].to_numpy(np.int64)

        def prefixes(batch):
            ids, sizes, at, shingles = [], [], [], []
            for i, text in enumerate(as_bytes(batch.column(1))):
                x = self.shingles(text).view(np.int64)
                often = np.zeros(len(x), dtype=np.int64)
                if len(names):
                    place = np.minimum(np.searchsorted(names, x), len(names) - 1)
                    often = np.where(names[place] == x, times[place], 0)
                first = np.lexsort((x, often))[: len(x) - int(np.ceil(self.similarity * len(x) - 1e-9)) + 1]
                ids.append(np.full(len(first), i))
                sizes.append(np.full(len(first), len(x)))
                at.append(np.arange(len(first)))
                shingles.append(x[first])
            sizes, at = np.concatenate(sizes), np.concatenate(at)
            both = np.floor((sizes - at) * most + 1e-6).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(sizes), pa.array(both), pa.array(np.concatenate(shingles))], ["doc_id", "n", "both", "shingle"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = self.chosen(docs, hot, prefixes, f"doc_id {kind}, n long, both long, shingle long")
        rows = cut(rows.join(told(found).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")))
        mixed = cut_narrow(rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("shingle"))
        rows = cut(rows.join(mixed, "shingle"))
        of_size = lambda n: F.floor(F.log(n) / float(np.log(1.02)))
        x = rows.filter(F.col("both") >= 2 * F.col("n")).withColumn("size", F.explode(F.sequence(of_size(F.col("n")), of_size(F.col("both") - F.col("n")))))
        x = x.select("shingle", "size", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("both").alias("ma"), F.col("root").alias("ra"))
        y = rows.select("shingle", of_size(F.col("n")).alias("size"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("both").alias("mb"), F.col("root").alias("rb"))
        met = x.join(y, ["shingle", "size"]).filter("ra <> rb and na + nb <= least(ma, mb) and (na < nb or (na = nb and a < b))")
        return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def verified(self, docs: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are alike."""

        def agree(batch):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for i in (2, 3))
            m = self.bands * self.rows
            kept = (x[:, :m] == y[:, :m]).sum(axis=1) >= self.agreeing
            least = np.bitwise_count(x[:, m:] ^ y[:, m:]).sum(axis=1, dtype=np.int64)  # shingles that one of the two has, or more
            both = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            kept = pa.array(kept & (least <= (1 - self.similarity) / (1 + self.similarity) * both + 1e-6))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        of = lambda i: sketches.select(F.col("doc_id").alias(i), F.col("sig").alias("s" + i), F.col("n").alias("n" + i))
        few = told(pairs := pairs.select("a", "b"))
        half = of("a").join(few, "a")
        signed_pairs = of("b").join(half if few is pairs else F.broadcast(half), "b").select("a", "b", "sa", "sb", "na", "nb")
        likely = cut_narrow(map_batches(signed_pairs, agree, f"a {kind}, b {kind}"))
        taken = likely.select(F.explode(F.array("a", "b")).alias("doc_id"))

        def run(batch):
            sets = [self.shingles(x).view(np.int64) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "own"])

        sets = cut(self.chosen(docs, taken, run, f"doc_id {kind}, own array<long>"))
        both = told(likely).join(sets.select(F.col("doc_id").alias("a"), F.col("own").alias("oa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("own").alias("ob")), "b")
        shared = F.size(F.array_intersect("oa", "ob"))
        return cut_narrow(both.filter(shared >= self.similarity * (F.size("oa") + F.size("ob") - shared)).select("a", "b"))


#: Bits of a Bloom filter of ids: 8 MB for every task, however many ids there are.
BLOOM_BITS = 26


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the column doc_id, two places for each id: at most 2**BLOOM_BITS / 64 words come to the driver."""
    places = ids.select(F.xxhash64("doc_id").alias("h")).select(F.explode(F.array(F.col("h").bitwiseAND((1 << BLOOM_BITS) - 1), F.shiftright("h", 32).bitwiseAND((1 << BLOOM_BITS) - 1))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    words = narrowed(words).toPandas()
    out = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bloom(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), dtype=bool)
    for shift in (0, 32):
        p = (hashes >> shift) & ((1 << BLOOM_BITS) - 1)
        found &= bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1) == 1
    return found


def drop_near_copies(docs: DataFrame, near: NearCopies = NearCopies()) -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each group of near copies.

    Groups are the components of the links of :class:`NearCopies` between rows, so
    ids may be null or repeat: a null id is larger than any other, of equal ids any
    one row stays. Null text counts as empty; texts without words are alike. All
    columns stay as they are; an empty table stays empty. A task holds one text's
    set at a time besides a batch.
    """
    rows, key = rows_with_key(docs)
    own = rows.select(F.col(key).alias("doc_id"), "text", F.col("doc_id").alias("_id"))
    found = near.groups(own)
    if key == "doc_id":
        gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    else:
        found = cut(found.join(own.select("doc_id", "_id"), "doc_id"))
        best = found.groupBy("component_id").agg(F.min_by("doc_id", F.struct(F.col("_id").isNull(), "_id", "doc_id")).alias("best"))
        gone = found.join(cut(best), "component_id").filter("doc_id <> best").select(F.col("doc_id").alias("_gone"))
    gone = cut_narrow(gone)
    left = rows.join(gone, rows[key] == gone["_gone"], "left_anti")
    return left if key == "doc_id" else left.drop(key)

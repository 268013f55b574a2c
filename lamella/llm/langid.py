"""Language identification with bit-sliced Bloom filters.

Every language has a Bloom filter of its letter n-grams, and all filters share
their hash functions. They are stored bit-sliced: the table has a bit mask of
languages for each position, so reading the positions of an n-gram and taking
their conjunction tells at once which languages contain it. A document's bits
are counted by language, each count is corrected for the false positives that
the filter's fill lets expect, and the largest one decides.

An n-gram belongs to a language if its share there is a fifth at least of its
largest share in any language, and no smaller than ``least_share``; the shares
are counted over all documents to learn from.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import as_bytes, crc32_of, cut, pieces, splitmix64

#: Identities of n-grams: 20-bit digests.
ID_BITS = 20
#: Languages whose counts a task holds before it passes them on: 8 MB for each.
HELD = 16


@cache
def letters() -> np.ndarray:
    """Code points to themselves for letters, else to a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x32400):  # the planes beyond have no letters
        if chr(i).isalpha():
            out[i] = i
    return out


def ngrams(parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the letter n-grams of lower-cased UTF-8 texts, and the text of each.

    Anything but a letter counts as one space; an n-gram has a letter in its
    middle, so a gram of only spaces does not count.
    """
    texts = [x.decode().lower() + " " * (size - 1) for x in parts]
    points = np.frombuffer("".join([" ", *texts]).encode("utf-32-le"), dtype=np.uint32)
    points = letters()[points]
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h = points[:n].astype(np.uint64)
    for i in range(1, size):
        h = h * np.uint64(0x9E3779B1) + points[i : n + i]
    h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - ID_BITS)
    kept = points[size // 2 : n + size // 2] != 32
    of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    of = np.concatenate([[0], of])[1 : n + 1] if len(of) >= n else np.concatenate([of, of[-1:]])[:n]
    return h[kept].astype(np.uint32), of[kept]


@dataclass
class Filters:
    """languages: in order. table: the bit masks, in words of 8 or 64 languages. false: for each language the share of foreign n-grams that its filter takes."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray
    hashes: int
    size: int

    def masks(self, ids: np.ndarray) -> np.ndarray:
        """For each n-gram, the languages that contain it: (n, words)."""
        mixed = splitmix64(ids.astype(np.uint64))
        out = None
        for i in range(self.hashes):
            at = (mixed >> np.uint64(20 * i)) & np.uint64(len(self.table) - 1)
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts of each language, and the n-grams, of each text."""
        found, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        bits = self.table.dtype.itemsize * 8
        for parts, of in pieces(texts):
            ids, own = ngrams(parts, self.size)
            masks = self.masks(ids)
            n = np.bincount(own, minlength=len(parts))
            np.add.at(total, of, n)
            for i in range(len(self.languages)):
                word = masks[:, i // bits]
                hit = np.bincount(own[(word >> word.dtype.type(i % bits)) & word.dtype.type(1) == 1], minlength=len(parts))
                np.add.at(found[:, i], of, (hit - self.false[i] * n) / (1 - self.false[i]))
        return np.maximum(found, 0), total


@dataclass(frozen=True)
class LanguageFilters:
    """size: letters of an n-gram. bits: log2 of the table's positions, 20 at most. hashes: 3 at most. least_share, of_best: see the module."""

    size: int = 3
    bits: int = 20
    hashes: int = 3
    least_share: float = 1e-5
    of_best: float = 0.2

    def fit(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
        """Learn from documents with a language whose crc32(id as text) mod 4 is not 2."""
        size = self.size

        def passed(totals):
            for lang, sums in totals.items():
                ids = np.flatnonzero(sums)
                for i in range(0, len(ids), 1 << 16):
                    some = ids[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(sums[some])], ["lang", "id", "n"])

        def count(batches):
            totals: dict[str, np.ndarray] = {}
            for batch in batches:
                texts: dict[str, list[bytes]] = {}
                for i, text, lang in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    if lang is not None and crc32_of(i) % 4 != 2:
                        texts.setdefault(lang, []).append(text)
                for lang, own in texts.items():
                    if lang not in totals and len(totals) >= HELD:
                        yield from passed(totals)
                        totals = {}
                    sums = totals.setdefault(lang, np.zeros(1 << ID_BITS, dtype=np.int64))
                    for parts, _ in pieces(own):
                        sums += np.bincount(ngrams(parts, size)[0], minlength=1 << ID_BITS)
            yield from passed(totals)

        chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null")
        counts = cut(chosen.mapInArrow(count, "lang string, id int, n long").groupBy("lang", "id").agg(F.sum("n").alias("n")))
        totals = cut(counts.groupBy("lang").agg(F.sum("n").cast("double").alias("total")))
        languages = sorted(r.lang for r in totals.select("lang").collect())
        dtype = np.uint8 if len(languages) <= 8 else np.uint64
        bits = np.dtype(dtype).itemsize * 8
        table = np.zeros((1 << self.bits, max(1, -(-len(languages) // bits))), dtype=dtype)
        if languages:
            names = docs.sparkSession.createDataFrame(list(enumerate(languages)), "i int, lang string")
            shares = counts.join(totals.join(names, "lang"), "lang").select("i", "id", (F.col("n") / F.col("total")).alias("share")).filter(F.col("share") >= self.least_share)
            best = shares.groupBy("id").agg(F.max("share").alias("best"))
            # Of 2**ID_BITS n-grams at most, each with the few languages that have a fifth of its best share.
            got = shares.join(best, "id").filter(F.col("share") >= self.of_best * F.col("best")).select("i", "id").toPandas()
            for i in range(len(languages)):
                mixed = splitmix64(got.loc[got["i"] == i, "id"].to_numpy(np.uint64))
                for k in range(self.hashes):
                    table[(mixed >> np.uint64(20 * k)) & np.uint64(len(table) - 1), i // bits] |= dtype(1) << dtype(i % bits)
        fill = np.array([np.count_nonzero((table[:, i // bits] >> dtype(i % bits)) & dtype(1)) / len(table) for i in range(len(languages))])
        return Filters(languages, table, np.minimum(fill**self.hashes, 0.5), self.hashes, self.size)

    def predict(self, docs: DataFrame, model: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, held_out, lang_pred, score); see :func:`languages_of`."""
        sent = docs.sparkSession.sparkContext.broadcast(model)  # the table: 2**bits positions of a bit for each language

        def run(batch):
            m, texts = sent.value, as_bytes(batch.column(1))
            if m.languages:
                found, total = m.counts(texts)
                best = found.argmax(axis=1)
                score = found.max(axis=1) / np.maximum(found.sum(axis=1), 1e-9)
                lang = [m.languages[b] if t else "und" for b, t in zip(best, total, strict=True)]
                score = np.where(total > 0, np.minimum(score, 1.0), 0.0)
            else:
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            held = [crc32_of(i) % 4 == 2 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

        kind = docs.schema[id_col].dataType.simpleString()
        chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return chosen.mapInArrow(lambda it: (y for x in it if x.num_rows for y in run(x)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def languages_of(docs: DataFrame, settings: LanguageFilters = LanguageFilters()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text.

    lang_pred is ``und`` and the score 0 for a null text, one without letters, or
    if there is nothing to learn from. Of equal counts the first language in
    order wins; a text with letters but no known n-gram so gets the first
    language and score 0. The score is the winner's share of the corrected counts.
    Rows that repeat an id each get a row, equal texts equal predictions; an empty
    table gives no rows; other columns are ignored. Whole texts are read, a long one
    in slices of a MiB, where the n-grams across a cut count as two words.
    """
    return settings.predict(docs, settings.fit(docs))

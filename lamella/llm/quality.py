"""Quality classifier: random-indexing word vectors and a two-layer network.

Texts are cut into words: runs of letters, of digits and of punctuation. A word has
a sparse random index vector of +1 and -1, drawn by the digest of the word, and so
has each mark of a word's shape and of its repetition. The word vector of a word is
the sum of the index vectors of its neighbours, two to either side and its own
marks, over all documents of the corpus: integers, so their sum does not depend on
the order. Every word has a vector of its own; those of the most frequent words of
the corpus are kept (``words`` of them, a documented bound on what is sent to the
tasks), rarer ones count by their index vectors. A document is the mean, by kind of
word, of its word vectors and of its index vectors, and the shares of its marks. A
network of two layers in numpy learns from those, and a temperature fitted on
documents kept apart from its training calibrates its probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import as_bytes, crc32_of, labelled_sample, pieces, splitmix64

#: Length of the vectors and nonzero entries of an index vector.
DIM, NONZERO = 32, 4
#: Words whose vectors are kept.
WORDS = 1 << 15
#: Marks: 12 of shapes, 2 of repetition.
MARKS = 14
#: Kinds of words: letters, digits, punctuation.
KINDS = 3
#: Columns of a document: word and index vectors by kind, shares of marks, of kinds and of kept words, log length.
FEATURES = 2 * KINDS * DIM + MARKS + KINDS + 1 + 1
#: Distinct words that a task counts before it passes them on.
COUNTED = 1 << 20
#: Rows from which on a run is summed by itself.
LONG = 16


def index_vectors(digests: np.ndarray) -> np.ndarray:
    """The index vectors of some digests; entries that meet add up."""
    noise = splitmix64(digests.astype(np.uint64) ^ np.uint64(1 << 40))
    out = np.zeros(len(digests) * DIM, dtype=np.int8)
    row = np.arange(len(digests)) * DIM
    for k in range(NONZERO):
        at = row + ((noise >> np.uint64(8 * k)) % np.uint64(DIM)).astype(np.int64)
        out[at] += (1 - 2 * ((noise >> np.uint64(60 + k)) & np.uint64(1)).astype(np.int8)).astype(np.int8)
    return out.reshape(-1, DIM)


@cache
def mark_vectors() -> np.ndarray:
    return index_vectors(np.arange(MARKS, dtype=np.uint64))


def distinct(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, the place of each digest among them, an order that sorts the digests, where each value starts in it)."""
    order = np.argsort(digest, kind="stable")
    new = np.append(True, digest[order][1:] != digest[order][:-1])[: len(order)]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return digest[order[first]], place, order, first


@cache
def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each byte (0 space, 1 letter, 2 digit, 3 punctuation), lower case, upper-case flag."""
    kind = np.full(256, 3, dtype=np.uint8)
    kind[list(b" \t\n\x0b\x0c\r")] = 0
    kind[ord("A") : ord("Z") + 1] = kind[ord("a") : ord("z") + 1] = kind[128:] = 1
    kind[ord("0") : ord("9") + 1] = 2
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    return kind, lower, (lower != np.arange(256)).astype(np.int64)


@cache
def powers() -> np.ndarray:
    out = [1]
    for _ in range(63):
        out.append(out[-1] * 0x9E3779B97F4A7C15 % (1 << 64))
    return np.array(out, dtype=np.uint64)


def runs(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, kind, text, shape mark, repetition mark) of each word of the texts, in order."""
    data = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
    kinds, lower, upper = byte_tables()
    kind = kinds[data]
    edge = np.empty(len(data), dtype=bool)
    edge[:1] = True
    edge[1:] = kind[1:] != kind[:-1]
    first = np.flatnonzero(edge)
    own = kind[first]
    size = np.diff(np.append(first, len(data)))
    place = (np.arange(len(data), dtype=np.int32) - np.repeat(first.astype(np.int32), size)) & 63
    digest = np.add.reduceat((lower[data].astype(np.uint64) + np.uint64(1)) * powers()[place], first) if len(first) else np.zeros(0, np.uint64)
    caps = np.add.reduceat(upper[data], first) if len(first) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])])
    kept = own > 0
    first, own, size, digest, caps = first[kept], own[kept].astype(int), size[kept], splitmix64(digest[kept] + size[kept].astype(np.uint64)), caps[kept]
    text = np.searchsorted(starts, first, side="right") - 1
    # Marks: letters without capitals, with a first one, all of them, some; digits; punctuation; long runs.
    shape = np.where(own == 1, np.where(caps == 0, 0, np.where(caps == size, 2, np.where(caps == 1, 1, 3))), own + 2) + 6 * (size > 20)
    repeated = np.zeros(len(own), dtype=bool)
    for back in (1, 2):
        repeated[back:] |= (digest[back:] == digest[:-back]) & (text[back:] == text[:-back]) & (own[back:] == 1)
    return digest, own - 1, text, shape, np.where(repeated, 12, 13)


def frequent(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """The digests, in order, of the most frequent words of all documents; ties by the smaller digest."""

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            both = [np.concatenate(x) for x in zip(*held, strict=True)]
            found, place = np.unique(both[0], return_inverse=True)
            return found, np.bincount(place, both[1], minlength=len(found)).astype(np.int64)

        for batch in batches:
            for parts, _ in pieces(as_bytes(batch.column(0))):
                held.append(np.unique(runs(parts)[0], return_counts=True))
                if len(held) > 1 and sum(len(x[0]) for x in held) > COUNTED:
                    held = [merged()]
                    if len(held[0][0]) > COUNTED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["digest", "n"])
                        held = []
        if held:
            found, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["digest", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "digest long, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "digest").limit(words).select("digest").toPandas()
    return np.sort(top["digest"].to_numpy(np.int64).view(np.uint64))


def placed(digest: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each digest in ``known``, the number of those for none."""
    if not len(known):
        return np.zeros(len(digest), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, digest), len(known) - 1)
    return np.where(known[at] == digest, at, len(known))


def summed(rows: np.ndarray, first: np.ndarray, dtype: type) -> np.ndarray:
    """Sums of runs of rows that start at ``first``: long runs one by one, which is many times faster, the others together."""
    size = np.diff(np.append(first, len(rows)))
    out = np.empty((len(first), rows.shape[1]), dtype=dtype)
    long = size >= LONG
    for i in np.flatnonzero(long).tolist():
        out[i] = rows[first[i] : first[i] + size[i]].sum(axis=0, dtype=dtype)
    if not long.all():
        short = size[~long]
        kept = rows[np.repeat(~long, size)]
        out[~long] = np.add.reduceat(kept, np.cumsum(short) - short, axis=0, dtype=dtype)
    return out


def contexts(parts: list[bytes], known: np.ndarray, sums: np.ndarray) -> None:
    """Adds to ``sums``, a row for each of ``known`` and one for the others, the index vectors around each word."""
    digest, _, text, shape, again = runs(parts)
    if not len(digest):
        return
    values, place, order, first = distinct(digest)
    at = np.arange(len(digest)) + 2 * text + 2  # two rows of zeros between texts
    spaced = np.zeros((at[-1] + 3, DIM), dtype=np.int8)
    spaced[at] = index_vectors(values)[place]
    around = spaced[at - 1] + spaced[at - 2] + spaced[at + 1] + spaced[at + 2] + mark_vectors()[shape] + mark_vectors()[again]
    np.add.at(sums, placed(values, known), summed(around[order], first, np.int64))


def word_vectors(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(digests, vectors of length one) of the most frequent words, and a row of zeros for the others."""
    sc = docs.sparkSession.sparkContext
    known = frequent(docs, text_col, words)
    sent = sc.broadcast(known)

    def gather(batches):
        sums = np.zeros((len(sent.value) + 1, DIM), dtype=np.int64)
        for batch in batches:
            for parts, _ in pieces(as_bytes(batch.column(0))):
                contexts(parts, sent.value, sums)
        some = np.flatnonzero(sums[:-1].any(axis=1))
        for i in range(0, len(some), 1 << 13):
            rows = some[i : i + (1 << 13)]
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *map(pa.array, np.ascontiguousarray(sums[rows].T))], ["word", *names])

    names = [f"c{i}" for i in range(DIM)]
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(gather, ", ".join(["word int", *(f"{x} long" for x in names)]))
    rows = sums.groupBy("word").agg(*(F.sum(x).alias(x) for x in names)).toPandas()  # ``words`` rows at most
    out = np.zeros((len(known) + 1, DIM), dtype=np.float32)
    if len(rows):
        out[rows["word"].to_numpy()] = rows[names].to_numpy(np.float64)
    return known, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[bytes], known: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    rows = len(texts)
    n, sums = np.zeros((rows, KINDS)), np.zeros((rows, KINDS, 2 * DIM))
    marks, kept, size = np.zeros((rows, MARKS)), np.zeros(rows), np.zeros(rows)
    for parts, of in pieces(texts):
        digest, kind, text, *both = runs(parts)
        cell, cells = text * KINDS + kind, len(parts) * KINDS
        np.add.at(n, of, np.bincount(cell, minlength=cells).reshape(-1, KINDS))
        if len(digest):
            values, place, _, _ = distinct(digest)
            word = placed(values, known)
            wide = np.hstack([vectors[word], index_vectors(values).astype(np.float32)])
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(cell[order]) > 0))
            own = np.zeros((cells, 2 * DIM))
            own[cell[order][first]] = summed(wide[place[order]], first, np.float64)
            np.add.at(sums, of, own.reshape(-1, KINDS, 2 * DIM))
            np.add.at(kept, of, np.bincount(text, (word < len(known))[place], minlength=len(parts)))
        for mark in both:
            np.add.at(marks, of, np.bincount(text * MARKS + mark, minlength=len(parts) * MARKS).reshape(-1, MARKS))
        np.add.at(size, of, [len(x) for x in parts])
    total = np.maximum(n.sum(axis=1, keepdims=True), 1)
    mean = (sums / np.maximum(n, 1)[:, :, None]).reshape(rows, -1)
    return np.hstack([mean, marks / total, n / total, kept[:, None] / total, np.log1p(size)[:, None] / 10])


@dataclass
class Network:
    """Two layers: tanh units, then one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -logits, logits))))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-3, apart: float = 0.25, seed: int = 7) -> Network:
    """Adam on the log loss; the temperature is fitted on a share ``apart`` of the rows.

    With one label only, or no rows, the network gives the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    prior = (y.sum() + 1) / (n + 2)
    if n < 8 or y.min() == y.max():
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(prior / (1 - prior))))
    order = rng.permutation(n)
    held, used = order[: max(2, int(apart * n))], order[max(2, int(apart * n)) :]
    net = Network(x[used].mean(axis=0), x[used].std(axis=0) + 0.05, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (x - net.mean) / net.scale
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    b2, step, batch = np.zeros(1), 0, 64
    for _ in range(max(epochs, 2000 // max(1, len(used) // batch))):
        mixed = rng.permutation(used)
        for i in range(0, len(mixed), batch):
            rows = mixed[i : i + batch]
            h = np.tanh(z[rows] @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + b2, -500, 500)))
            g = (p - y[rows]) / len(rows)
            back = np.outer(g, net.w2) * (1 - h * h)
            grads = [z[rows].T @ back + decay * net.w1, back.sum(axis=0), h.T @ g + decay * net.w2, np.array([g.sum()])]
            step += 1
            for (m, v), grad, param in zip(state, grads, (net.w1, net.b1, net.w2, b2), strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(b2[0])
    logits = net.logits(x[held])
    net.temperature = float(min(np.geomspace(0.25, 8, 60), key=lambda t: log_loss(logits / t, y[held])))
    return net


def quality_of(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = 6000, threshold: float = 0.3, words: int = WORDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    The network learns from at most ``per_class`` labelled documents of each
    label, none with crc32(id as text) mod 5 = 0 (held_out), one text of each id;
    the word vectors come from all documents. Null text counts as empty, and an
    empty text gets the score of a document without words. Rows that repeat an id
    each get a row, equal texts equal scores. Without labels, or with one label,
    the score is that label's smoothed share. An empty table gives no rows; other
    columns are ignored. A text over a MiB is read in pieces: its words at a cut
    have no neighbours beyond it.
    """
    known, vectors = word_vectors(docs, words=words)
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((known, vectors))  # (words + 1) * (DIM + 2) numbers of 4 bytes at most

    def features(batch):
        found = pooled(as_bytes(batch.column(1)), *sent.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(found.ravel(), FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(docs, labels, column, per_class)
    rows = sample.mapInArrow(lambda it: (y for b in it if b.num_rows for y in features(b)), f"doc_id {kind}, label int, x array<double>").toPandas()
    rows = rows.iloc[np.argsort(rows["doc_id"].astype(str).to_numpy(), kind="stable")]
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, FEATURES))
    model = sc.broadcast(train(x, rows["label"].to_numpy(np.float64)))

    def score(batch):
        p = model.value.probabilities(pooled(as_bytes(batch.column(1)), *sent.value))
        held = [crc32_of(i) % 5 == 0 for i in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(lambda it: (y for b in it if b.num_rows for y in score(b)), f"doc_id {kind}, held_out boolean, score double, predicted int")

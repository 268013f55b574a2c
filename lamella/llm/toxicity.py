"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel compares texts by the subsequences of three letters of their words. A
subsequence may skip letters: each of its two steps is at most ``GAP`` characters
long and weighs ``DECAY`` to its length, so ``i.d.i.o.t`` and ``idxiot`` stay close
to ``idiot``. Characters that are no letters hold a place and match nothing; digits
that stand for letters count as them; single letters set apart by white space are
read as one word. White space on either side of a word counts as a letter.

    k(s, t) = sum over u of phi_u(s) phi_u(t) / sqrt(d(s) d(t))

d(s) is the sum of squared weights of all steps in s. The machine learns in the
span of some landmark words (Nyström): f(s) = sum over j of beta_j k(s, l_j). As
the features u are few, f is folded into one weight for each u, and scoring a
text reads a table a few times for each character, whatever the landmarks.

It learns from sentences of labelled documents. All sentences of a clean document
are clean; of a toxic one some are toxic, and a few rounds tell which: the
sentences that score highest in each toxic document are its toxic ones, the
machine learns them against clean sentences, and scores all again. The first
scores are the difference of the two labels' mean feature vectors. Landmarks are
words of the highest scores in either label's sentences, none too like another.
A document is scored by the margins of its words, each read as a sentence of its
own: a logistic function of the two highest and of how many are positive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame

from lamella.llm.common import as_bytes, crc32_of, labelled_sample, pieces

GAP, DECAY = 3, 0.7
STEPS = [(a, b) for a in range(1, GAP + 1) for b in range(1, GAP + 1)]
#: Symbols: 1-26 a-z, 27-61 other letters, 62 white space, 63 anything else.
SPACE, OTHER = 62, 63
#: Digits that stand for letters (fixed values).
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
#: Columns that a document's score is made of.
EVIDENCE = 4
#: Margin of a text without any word of three letters.
NONE = -2.0
#: Features: three symbols of six bits.
U = 1 << 18
#: Words of a sentence at most, and at least if its line goes on; letters of a word in a sentence to learn from.
MOST_WORDS, LEAST_WORDS, MOST_LETTERS = 8, 3, 64
WORDS = re.compile(rf"\S{{1,{MOST_LETTERS}}}")


@cache
def symbols() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(0x20000):
        c = STANDS_FOR.get(chr(i), chr(i)).lower()[0]
        if "a" <= c <= "z":
            out[i] = ord(c) - 96
        elif c.isalpha():
            out[i] = 27 + ord(c) * 7 % 35
    for i in range(0x20000, 0x32400):  # the planes beyond have no letters, these no cases
        if chr(i).isalpha():
            out[i] = 27 + i * 7 % 35
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    return out


@dataclass
class Steps:
    """All steps of some texts: at[k] has the features of STEPS[k] by their middle place, -1 for none."""

    word: np.ndarray  # of each place
    text_of_word: np.ndarray
    at: list[np.ndarray]
    d: np.ndarray  # by word


def steps(parts: list[bytes]) -> Steps:
    texts = [x.decode() for x in parts]
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    s = symbols()[points].astype(np.int32)
    n, place = len(s), np.arange(len(s), dtype=np.int32)
    text = np.append(-1, np.repeat(np.arange(len(texts)), [len(x) + 1 for x in texts]))[:n]
    inside = s != SPACE
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1  # the first and the last place are white space
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    single = ends - starts == 1
    joined = np.zeros(len(starts), dtype=bool)
    joined[1:] = single[1:] & single[:-1] & (starts[1:] - starts[:-1] == 2) & (text[starts[1:]] == text[starts[:-1]])
    s[starts[joined] - 1] = OTHER  # the space between single letters belongs to their word
    starts, ends = starts[~joined], ends[~np.append(joined[1:], False)] if len(joined) else ends
    own = text[starts]
    # How far it is from each place to the white space on either side of its word, 0 outside words.
    mark = np.zeros(n + 1, dtype=np.int32)
    mark[starts] = 1
    word = np.cumsum(mark[:n], dtype=np.int32) - 1
    left, right = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    if len(starts):
        within = (word >= 0) & (place < ends[word])
        at = word[within]
        left[within], right[within] = place[within] - starts[at] + 1, ends[at] - place[within]
    letter = s < SPACE
    found, d = [], np.zeros(len(own))
    for a, b in STEPS:
        m = slice(a, n - b) if n > a + b else slice(0, 0)
        x, y = s[: max(n - a - b, 0)], s[a + b :]
        ok = letter[m] & (left[m] >= a) & (right[m] >= b) & (x != OTHER) & (y != OTHER)
        full = np.full(n, -1, dtype=np.int32)
        full[m] = np.where(ok, x << 12 | s[m] << 6 | y, -1)
        found.append(full)
        d += np.bincount(word[m][ok], minlength=len(own)) * DECAY ** (2 * (a + b))
    return Steps(word, own, found, d)


def margins(parts: list[bytes], weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """f of each word that has a feature, and the word's text."""
    x = steps(parts)
    f = np.zeros(len(x.text_of_word))
    for (a, b), at in zip(STEPS, x.at, strict=True):
        ok = np.flatnonzero(at >= 0)
        f += np.bincount(x.word[ok], weights[at[ok]] * DECAY ** (a + b), minlength=len(f))
    some = x.d > 0
    return f[some] / np.sqrt(x.d[some]) + bias, x.text_of_word[some]


def evidence(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """EVIDENCE numbers of each text: two highest margins, and how many are positive, plain and by length."""
    out = np.zeros((len(texts), EVIDENCE))
    out[:, :2] = NONE
    size = np.zeros(len(texts))
    for parts, of in pieces(texts):
        f, own = margins(parts, weights, bias)
        doc = of[own]
        np.add.at(out[:, 2], doc, f > 0)
        np.add.at(size, doc, 1)
        order = np.lexsort((-f, doc))
        f, doc = f[order], doc[order]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
        for at in (first, first[np.append(doc[first[:-1] + 1] == doc[first[:-1]], first[-1] + 1 < len(doc))] + 1 if len(first) else first):
            for v, i in zip(f[at], doc[at], strict=True):
                a, b = out[i, :2]
                out[i, :2] = (v, a) if v > a else (a, max(b, v))
    hits = out[:, 2].copy()
    out[:, 2], out[:, 3] = np.log1p(hits), np.log1p(100 * hits / np.maximum(size, 1))
    return out


def sentences(text: str) -> list[str]:
    """Runs of words that end with a mark, a line or after MOST_WORDS words."""
    out, own = [], []
    for line in text.split("\n"):
        for word in WORDS.findall(line):
            own.append(word)
            if len(own) >= MOST_WORDS or len(own) >= LEAST_WORDS and word[-1] in ".!?:;…":
                out.append(" ".join(own))
                own = []
        if len(own) >= LEAST_WORDS:
            out.append(" ".join(own))
            own = []
    return out + [" ".join(own)] * bool(own)


def sampled(text: str, most: int) -> list[str]:
    """Its sentences, or ``most`` of them by a hash."""
    found = sentences(text)
    if len(found) <= most:
        return found
    chosen = np.argsort([xxhash.xxh32_intdigest(f"{i}:{x}") for i, x in enumerate(found)], kind="stable")[:most]
    return [found[i] for i in sorted(chosen)]


def scored(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """f of each short text as a whole, NONE for one without features."""
    out = np.full(len(texts), NONE)
    for i in range(0, len(texts), 1 << 13):
        x = steps([t.encode() for t in texts[i : i + (1 << 13)]])
        n = min(1 << 13, len(texts) - i)
        f, d = np.zeros(n), np.bincount(x.text_of_word, x.d, minlength=n)
        for (a, b), at in zip(STEPS, x.at, strict=True):
            ok = np.flatnonzero(at >= 0)
            f += np.bincount(x.text_of_word[x.word[ok]], weights[at[ok]] * DECAY ** (a + b), minlength=n)
        some = d > 0
        out[i : i + n][some] = f[some] / np.sqrt(d[some]) + bias
    return out


def summed(texts: list[str], weight: np.ndarray) -> np.ndarray:
    """The sum of the normalised feature vectors of short texts, each with a weight."""
    out = np.zeros(U)
    for i in range(0, len(texts), 1 << 13):
        own = texts[i : i + (1 << 13)]
        x = steps([t.encode() for t in own])
        by = weight[i : i + len(own)] / np.sqrt(np.maximum(np.bincount(x.text_of_word, x.d, minlength=len(own)), 1e-12))
        for (a, b), at in zip(STEPS, x.at, strict=True):
            ok = np.flatnonzero(at >= 0)
            out += np.bincount(at[ok], by[x.text_of_word[x.word[ok]]] * DECAY ** (a + b), minlength=U)
    return out


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features that occur in some texts, and for each feature its place among them, -1 for none."""
    seen = np.unique(np.concatenate([a[a >= 0] for a in steps([t.encode() for t in texts]).at]))
    index = np.full(U, -1, dtype=np.int64)
    index[seen] = np.arange(len(seen))
    return seen, index


def features(texts: list[str], index: np.ndarray, n: int) -> np.ndarray:
    """Normalised features of short texts in the compact columns of ``index``."""
    x = steps([t.encode() for t in texts])
    keys, values = [], []
    for (a, b), at in zip(STEPS, x.at, strict=True):
        ok = np.flatnonzero(at >= 0)
        column = index[at[ok]]
        known = column >= 0
        keys.append(x.text_of_word[x.word[ok[known]]] * n + column[known])
        values.append(np.full(len(keys[-1]), DECAY ** (a + b)))
    out = np.bincount(np.concatenate(keys), np.concatenate(values), minlength=len(texts) * n).reshape(len(texts), n)
    d = np.bincount(x.text_of_word, x.d, minlength=len(texts))
    return (out / np.sqrt(np.maximum(d, 1e-12))[:, None]).astype(np.float32)


def l2_svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Primal Newton steps for the squared hinge loss; y is +1 or -1. Weights of the columns and of one more, the bias."""
    n, d = z.shape
    w, active = np.zeros(d + 1), np.ones(n, dtype=bool)
    for _ in range(rounds):
        square, right, margin = np.eye(d + 1), np.zeros(d + 1), np.empty(n)
        for i in range(0, n, 2048):  # a block at a time, so no copy of z is made
            own = np.flatnonzero(active[i : i + 2048]) + i
            x = np.column_stack([z[own], np.ones(len(own))]).astype(np.float64)
            by = x * cost[own, None]
            square += by.T @ x
            right += by.T @ y[own]
        w = np.linalg.solve(square, right)
        for i in range(0, n, 2048):
            margin[i : i + 2048] = z[i : i + 2048] @ w[:-1] + w[-1]
        now = y * margin < 1
        if (now == active).all():
            break
        active = now
    return w


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    calibration: np.ndarray  # of the evidence and one

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = evidence(texts, self.weights, self.bias)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.calibration, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
    return w


def bare(word: str) -> str:
    return word.lower().strip("\"'()[]{}<>.,;:!?*%&$#|-_")


def spread(words: list[str], most: int, near: float = 0.7) -> list[str]:
    """The first words of which no two have a kernel of ``near`` or more."""
    out, held = [], None
    if words:
        seen, index = numbered(words)
        for i in range(0, len(words), 64):
            some = words[i : i + 64]
            x = features(some, index, len(seen))
            left = np.ones(len(some), dtype=bool) if held is None else (x @ held.T).max(axis=1) < near
            fresh = []
            for j in range(len(some)):
                if left[j] and len(out) < most:
                    out.append(some[j])
                    fresh.append(j)
                    left &= x @ x[j] < near
            if fresh:
                held = x[fresh] if held is None else np.vstack([held, x[fresh]])
    return out


@dataclass(frozen=True)
class Machine:
    """landmarks: at most. rounds: of telling toxic sentences, after the first. hard, drawn: clean sentences to learn from, those of the highest scores and any. most: toxic sentences of a document. share: weight of the toxic sentences by that of the clean ones; variant: of a sentence whose worst word is written with marks or one more letter."""

    landmarks: int = 600
    rounds: int = 2
    hard: int = 3000
    drawn: int = 6000
    most: int = 8
    cost: float = 20.0
    share: float = 0.7
    variant: float = 0.3
    variants: int = 600
    seed: int = 5

    def fit(self, bags: list[list[str]], labels: np.ndarray) -> tuple[np.ndarray, float] | None:
        """(weights of the features, bias) from the sentences of documents and the documents' labels; None if there is nothing to tell apart."""
        rng = np.random.default_rng(self.seed)
        flat = [x for own in bags for x in own]
        doc = np.repeat(np.arange(len(bags)), [len(own) for own in bags])
        toxic = labels[doc] == 1
        if not toxic.any() or toxic.all():
            return None
        even = 1 / np.bincount(doc, minlength=len(bags))[doc]
        weights, bias = summed(flat, np.where(toxic, even / even[toxic].sum(), -even / even[~toxic].sum())), 0.0
        for i in range(self.rounds + 1):
            f = scored(flat, weights, bias)
            order = np.lexsort((-f, doc))
            first = np.flatnonzero(np.append(True, doc[order][1:] != doc[order][:-1]))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            best = order[(rank == 0) | (rank < self.most) & (f[order] > 0) if i else rank == 0]
            positive = best[toxic[best]]
            if i and (f[positive] > 0).any():
                positive = positive[f[positive] > 0]
            hard = order[(rank == 0) & ~toxic[order]]
            hard = hard[np.argsort(-f[hard], kind="stable")][: self.hard]
            negative = np.unique(np.concatenate([hard, rng.permutation(np.flatnonzero(~toxic))[: self.drawn]]))
            said = [self.by_score([flat[j] for j in own], weights, bias) for own in (positive, hard[:500])]
            quarter = self.landmarks // 4
            marks = spread(said[0][:1600], 2 * quarter) + said[1][:quarter]
            marks = list(dict.fromkeys(marks + [said[1][j] for j in rng.permutation(len(said[1]))[:quarter]]))
            more = self.varied([flat[j] for j in positive[np.argsort(-f[positive], kind="stable")][: self.variants]], weights, bias, rng) if i else []
            if not marks:
                return None
            weights, bias = self.learn(marks, [flat[j] for j in positive], more, [flat[j] for j in negative])
        return weights.astype(np.float32), bias

    def by_score(self, texts: list[str], weights: np.ndarray, bias: float) -> list[str]:
        """Their distinct words of three letters or more, the highest margins first."""
        words = list(dict.fromkeys(w for t in texts for x in t.split() if len(w := bare(x)) >= 3))
        f = scored(words, weights, bias)
        return [words[j] for j in np.argsort(-f, kind="stable") if f[j] != NONE]

    def varied(self, texts: list[str], weights: np.ndarray, bias: float, rng: np.random.Generator) -> list[str]:
        """The sentences with marks between the letters of their worst word, and with one more letter in it."""
        out = []
        for t in texts:
            words = t.split()
            j = int(np.argmax(scored(words, weights, bias)))
            if len(w := words[j]) > 3:
                at, letter = int(rng.integers(1, len(w))), chr(97 + int(rng.integers(26)))
                out += [" ".join([*words[:j], form, *words[j + 1 :]]) for form in (".".join(w), w[:at] + letter + w[at:])]
        return out

    def learn(self, marks: list[str], positive: list[str], more: list[str], negative: list[str]) -> tuple[np.ndarray, float]:
        seen, index = numbered(marks)
        basis = features(marks, index, len(seen)).astype(np.float64)
        values, vectors = np.linalg.eigh(basis @ basis.T)
        kept = values > 1e-4 * values.max()
        lift = (basis.T @ (vectors[:, kept] / np.sqrt(values[kept]))).astype(np.float32)
        every = positive + more + negative
        z = np.empty((len(every), lift.shape[1]), dtype=np.float32)
        for i in range(0, len(every), 256):
            z[i : i + 256] = features(every[i : i + 256], index, len(seen)) @ lift
        y = np.concatenate([np.ones(len(positive) + len(more)), -np.ones(len(negative))])
        own = np.concatenate([np.ones(len(positive)), np.full(len(more), self.variant)])
        cost = self.cost * np.concatenate([own * self.share * len(negative) / own.sum(), np.ones(len(negative))])
        w = l2_svm(z, y, cost)
        weights = np.zeros(U)
        weights[seen] = lift @ w[:-1]
        return weights, float(w[-1])


def constant(labels: np.ndarray) -> Model:
    """A model that gives every text the smoothed share of label 1."""
    prior = (labels.sum() + 1) / (len(labels) + 2)
    return Model(np.zeros(U, dtype=np.float32), NONE, np.append(np.zeros(EVIDENCE), np.log(prior / (1 - prior))))


def fit(texts: list[str], labels: np.ndarray, per_doc: int = 48, machine: Machine = Machine()) -> Model:
    """Learn from whole labelled texts in one process; with one label only every score is that label's smoothed share."""
    found = machine.fit([sampled(t, per_doc) for t in texts], labels)
    return Model(*found, logistic(evidence([t.encode() for t in texts], *found), labels)) if found else constant(labels)


def fitted(docs: DataFrame, labels: DataFrame, column: str, per_class: int, per_doc: int, machine: Machine) -> Broadcast:
    """The model, sent to every task; see :func:`toxicity_of`."""
    sc = docs.sparkSession.sparkContext
    sample = labelled_sample(docs, labels, column, per_class)

    def bags(batches):
        for batch in batches:
            found = [sampled("" if t is None else t, per_doc) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.string()))], ["doc_id", "label", "said"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(bags, f"doc_id {kind}, label int, said array<string>").toArrow()  # 2 * per_class documents, per_doc sentences of each, at most
    order = np.argsort(rows.column("doc_id").cast(pa.string()).to_numpy(zero_copy_only=False).astype(str), kind="stable")
    rows = rows.take(pa.array(order))
    y = rows.column("label").to_numpy().astype(np.float64)
    found = machine.fit(rows.column("said").to_pylist(), y)
    del rows
    if found is None:
        return sc.broadcast(constant(y))
    sent = sc.broadcast(found)

    def measured(batches):
        for batch in batches:
            x = evidence(as_bytes(batch.column(1)), *sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, np.ascontiguousarray(x.T))], ["doc_id", "label", *names])

    names = [f"x{i}" for i in range(EVIDENCE)]
    shown = sample.mapInArrow(measured, ", ".join([f"doc_id {kind}, label int", *(f"{x} double" for x in names)])).toPandas()
    shown = shown.iloc[np.argsort(shown["doc_id"].astype(str).to_numpy(), kind="stable")]
    return sc.broadcast(Model(*found, logistic(shown[names].to_numpy(np.float64), shown["label"].to_numpy(np.float64))))


def toxicity_of(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = 3000, per_doc: int = 48, threshold: float = 0.5, machine: Machine = Machine()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    The model learns from at most ``per_class`` labelled documents of each label,
    none with crc32(id as text) mod 5 = 0 (held_out), and at most ``per_doc``
    sentences of each, of any length of document; ids are taken by their hash, one
    text of each id. Null text counts as empty; a text without a word of three
    letters has no evidence and scores lowest. Rows that repeat an id each get a
    row, equal texts equal scores. Without labels of both kinds all scores are the
    smoothed share of label 1. An empty table gives no rows; other columns are
    ignored. Whole texts are scored, a long one in slices.
    """
    model = fitted(docs, labels, column, per_class, per_doc, machine)

    def score(batch):
        p = model.value.scores(as_bytes(batch.column(1)))
        held = [crc32_of(i) % 5 == 0 for i in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: (y for b in it if b.num_rows for y in score(b)), f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = 3000, per_doc: int = 48, threshold: float = 0.5, machine: Machine = Machine()) -> DataFrame:
    """``docs`` without the rows that :func:`toxicity_of` predicts as toxic, all columns as they are.

    Each row is judged by its own text, whatever its id: null and repeated ids,
    empty texts and any other columns stay as they are. An empty table stays empty.
    """
    model = fitted(docs, labels, column, per_class, per_doc, machine)
    text = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.value.scores(as_bytes(batch.column(text))) < threshold))

    return docs.mapInArrow(keep, docs.schema)

"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text is cut before its spaces and around its line feeds, where no piece of the
vocabulary crosses. Each part has a lattice: a node between any two characters
and an arc for every piece that matches, or for the bytes of a character without
a piece of its own. An arc's weight follows Zipf's law over the ranks of the
pieces, to the power ``theta``. Forward filtering sums the weights of all ways to
each node; backward sampling then draws from the end one arc at a time, each with
its exact share of the sum, so a whole path has its exact probability.

The lattice and its sums are built once for each distinct part of a slice of
text, and drawing goes through all parts of the slice at once. The noise of a
draw is a function of the seed, the row's key and the place in its text, so a
row's pieces do not depend on its neighbours, its partition or a retry.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import as_texts, by_size, splitmix64

#: The character that stands for a space in pieces, and what stands for it in texts that have it.
MARK, FOREIGN = 0x2581, 0x10FFFE
PARTS = re.compile(r"\n| *[^ \n]+| +")
#: Characters that a slice takes; a longer text is a slice of its own. A slice's arrays take some 500 bytes a character.
SLICE = 1 << 17
#: Arcs of lattices that a task keeps for the parts of later slices.
KEPT = 1_000_000
#: Rows whose texts a task holds as strings at once.
ROWS = 512
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and scores of a model, by id; byte_ids: the ids of the 256 byte pieces; special ids take part in no lattice."""

    pieces: tuple[str, ...]
    ranks: tuple[float, ...]
    byte_ids: tuple[int, ...]
    special: frozenset[int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        of_bytes = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        special = frozenset(i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        if len(of_bytes) != 256:
            raise ValueError("the model has no byte pieces, so some texts could not be encoded without loss")
        return cls(tuple(sp.id_to_piece(i) for i in range(n)), tuple(-sp.get_score(i) for i in range(n)), tuple(of_bytes[f"<0x{b:02X}>"] for b in range(256)), special)


@dataclass
class Ladder:
    """Filtered lattices of parts, one after the other.

    ladder: for each arc, ordered by the node where it ends, that node's number
    plus the share of the ways that come by this arc or one before it. size: the
    characters of each part. first: its first node.
    """

    ladder: np.ndarray
    length: np.ndarray
    ids: np.ndarray
    size: np.ndarray
    first: np.ndarray

    def joined(self, other: Ladder) -> Ladder:
        nodes = int(self.size.sum()) + len(self.size)
        both = ((self.ladder, other.ladder + nodes), (self.length, other.length), (self.ids, other.ids), (self.size, other.size), (self.first, other.first + nodes))
        return Ladder(*map(np.concatenate, both))


class Lattice:
    """Sampler for one vocabulary. theta: 0 makes all paths alike, large values leave the likeliest path."""

    def __init__(self, vocabulary: Vocabulary, theta: float = 1.0, seed: int = 0):
        self.theta, self.seed = theta, seed
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int32)
        self.raw = [b""] * len(vocabulary.pieces)
        chars: list[tuple[int, ...]] = []
        ids: list[int] = []
        for i, piece in enumerate(vocabulary.pieces):
            if i not in vocabulary.special:
                self.raw[i] = piece.replace(chr(MARK), " ").encode()
                chars.append(tuple(map(ord, piece)))
                ids.append(i)
        for b, i in enumerate(vocabulary.byte_ids):
            self.raw[i] = bytes([b])
        self.longest = max(map(len, chars), default=1)
        rank = np.array(vocabulary.ranks)
        self.log = -theta * (np.log(np.maximum(rank, 0) + 2.7) + np.log(max(2.0, np.log(len(rank) + 2.7))))
        self.byte_log = -theta * (np.log(len(rank) + 2.7) + np.log(max(2.0, np.log(len(rank) + 2.7))))
        digests = np.array([self._digest(x) for x in chars], dtype=np.uint64)
        order = np.argsort(digests)
        self.digests, self.ids = digests[order], np.array(ids, dtype=np.int32)[order]
        prefixes = np.array([self._digest(x) for x in {y[:k] for y in chars for k in range(1, len(y) + 1)}], dtype=np.uint64)
        self.maybe = np.zeros(1 << 22, dtype=np.uint8)  # 1: may begin a piece, 2: may be one
        self.maybe[prefixes * SPREAD >> np.uint64(42)] = 1
        self.maybe[digests * SPREAD >> np.uint64(42)] = 3
        self.number: dict[str, int] = {}  # of the parts whose lattices are kept
        self.kept = Ladder(np.zeros(0), np.zeros(0, np.int8), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    @staticmethod
    def _digest(chars: tuple[int, ...]) -> int:
        h = 0
        for c in chars:
            h = (h * int(BASE) + c + 1) % (1 << 64)
        return h

    def arcs(self, points: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of all arcs; room: characters from each place to the end of its part. id -1: bytes."""
        c = points.astype(np.uint64) + np.uint64(1)
        start, length, found = [], [], []
        h, at = np.zeros(len(points), dtype=np.uint64), np.arange(len(points))
        single = np.zeros(len(points), dtype=bool)
        for k in range(1, self.longest + 1):
            h = h * BASE + c[at + (k - 1)]
            kind = self.maybe[h * SPREAD >> np.uint64(42)]
            likely = np.flatnonzero(kind == 3)
            where = np.minimum(np.searchsorted(self.digests, h[likely]), len(self.digests) - 1)
            hit = self.digests[where] == h[likely]
            own = at[likely[hit]]
            start.append(own)
            length.append(np.full(len(own), k))
            found.append(self.ids[where[hit]])
            if k == 1:
                single[own] = True
            keep = (kind > 0) & (room[at] > k)
            at, h = at[keep], h[keep]
            if not len(at):
                break
        rest = np.flatnonzero(~single)
        start.append(rest)
        length.append(np.ones(len(rest), dtype=np.int64))
        found.append(np.full(len(rest), -1, dtype=np.int32))
        return np.concatenate(start), np.concatenate(length), np.concatenate(found)

    def encode(self, keys: list[str], texts: list[str]) -> list[np.ndarray]:
        """Ids of the pieces of each text."""
        out: list[np.ndarray] = []
        for a, b in by_size(texts, SLICE):
            out += self._encode(keys[a:b], texts[a:b])
        return out

    def ladder(self, parts: list[str]) -> Ladder:
        """The lattices of some distinct parts after forward filtering."""
        size = np.array([len(p) for p in parts], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(size)])  # of each part's characters; its nodes start at first + its number
        points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32).copy()
        points[points == MARK] = FOREIGN
        points[points == 32] = MARK
        part_of = np.repeat(np.arange(len(parts)), size)
        room = first[part_of + 1] - np.arange(len(points))
        start, length, ids = self.arcs(points, room)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        width[points == FOREIGN] = 3
        log = np.where(ids >= 0, self.log[ids], self.byte_log * width[start])
        ids = np.where((ids < 0) & (width[start] == 1), self.byte_ids[points[start] & 0x7F], ids)  # others are spelt at the end
        node = start + part_of[start]
        end = node + length
        order = np.argsort(end * 64 + length)  # two arcs with one end differ in length
        start, length, ids, log, node, end = (x[order] for x in (start, length, ids, log, node, end))
        # The nodes at one distance from the starts of their parts at a time.
        reach = start + length - first[part_of[start]]
        by_reach = np.argsort(reach.astype(np.uint16) if reach.max() < 1 << 16 else reach, kind="stable")
        bounds = np.searchsorted(reach[by_reach], np.arange(1, reach.max() + 2))
        total = np.full(len(points) + len(parts), -np.inf)
        total[first[:-1] + np.arange(len(parts))] = 0.0
        for k in range(len(bounds) - 1):
            own = by_reach[bounds[k] : bounds[k + 1]]
            to = end[own]
            cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            total[to[cut]] = np.logaddexp.reduceat(total[node[own]] + log[own], cut)
        share = np.exp(total[node] + log - total[end])
        new = np.append(True, end[1:] != end[:-1])
        running = np.cumsum(share)
        upto = running - np.repeat((running - share)[new], np.diff(np.append(np.flatnonzero(new), len(end))))
        upto[np.append(new[1:], True)] = 1.0
        return Ladder(end + np.minimum(upto, 1.0), length.astype(np.int8), ids, size, first[:-1] + np.arange(len(parts)))

    def _encode(self, keys: list[str], texts: list[str]) -> list[np.ndarray]:
        number, kept = self.number, len(self.number)
        of_parts = [[number.setdefault(p, len(number)) for p in PARTS.findall(t)] for t in texts]
        flat = np.fromiter((i for own in of_parts for i in own), dtype=np.int64)
        doc_start = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not len(flat):
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        fresh = list(number)[kept:]
        made = self.kept.joined(self.ladder(fresh)) if fresh else self.kept
        if len(made.ladder) <= KEPT:
            self.kept = made
        else:
            for p in fresh:
                del number[p]
        # Backward sampling: all parts of the slice at once, ordered so that they read the ladder from end to end.
        sorted_parts = np.argsort(flat, kind="stable")
        part = flat[sorted_parts]
        begin = np.concatenate([[0], np.cumsum(made.size[flat])[:-1]])[sorted_parts]
        text_of = np.repeat(np.arange(len(texts)), [len(own) for own in of_parts])[sorted_parts]
        row = np.array([xxhash.xxh64_intdigest(k.encode(), self.seed) for k in keys], dtype=np.uint64)[text_of]
        chosen = np.full(doc_start[-1], -2, dtype=np.int32)
        left, base, origin = made.size[part], made.first[part], begin - doc_start[text_of]
        while len(left):
            noise = (splitmix64(row + (origin + left).astype(np.uint64) * BASE) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = np.searchsorted(made.ladder, base + left + noise, side="right")
            left = left - made.length[arc]
            chosen[begin + left] = made.ids[arc]
            more = left > 0
            if not more.all():
                left, base, begin, origin, row = left[more], base[more], begin[more], origin[more], row[more]
        taken = np.flatnonzero(chosen > -2)
        picked = chosen[taken]
        cuts = np.searchsorted(taken, doc_start)
        found = [picked[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
        if (picked == -1).any():
            for i, own in enumerate(found):
                if (own == -1).any():
                    at = taken[cuts[i] : cuts[i + 1]] - doc_start[i]
                    spelt = [self.byte_ids[list(texts[i][p].encode())] if x == -1 else [x] for x, p in zip(own, at, strict=True)]
                    found[i] = np.concatenate(spelt).astype(np.int32)
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of some pieces."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode()


@dataclass(frozen=True)
class Sampler:
    """path: the model's file, read on the driver only. theta, seed: see :class:`Lattice`."""

    path: str
    theta: float = 1.0
    seed: int = 0

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_chars, n_pieces, pieces, decoded_sha256, lossless), a row per document.

        pieces: ids of a sampled segmentation, the same for rows with the same id
        and text. decoded_sha256: of the decoded pieces; lossless: they are the
        text again. Null text counts as empty and has no pieces; a null id is a
        key as any other. Other columns are ignored; an empty table gives no rows.
        """
        sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(self.path))  # a model file: some hundred KB
        theta, seed = self.theta, self.seed

        def run(batches):
            lattice = Lattice(sent.value, theta, seed)
            for batch in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
                texts = as_texts(batch.column(1))
                for a, b in by_size(texts, 4 * SLICE):
                    own = texts[a:b]
                    ids = batch.column(0).slice(a, b - a)
                    found = lattice.encode([str(x) for x in ids.to_pylist()], own)
                    decoded = [lattice.decode(x) for x in found]
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array([len(x) for x in own], pa.int64()),
                            pa.array([len(x) for x in found], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int32))),
                            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                            pa.array([x == y for x, y in zip(decoded, own, strict=True)]),
                        ],
                        ["doc_id", "n_chars", "n_pieces", "pieces", "decoded_sha256", "lossless"],
                    )

        kind = docs.schema[id_col].dataType.simpleString()
        chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return chosen.mapInArrow(run, f"doc_id {kind}, n_chars long, n_pieces long, pieces array<int>, decoded_sha256 string, lossless boolean")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """(doc_id, text) of rows (doc_id, pieces); null pieces give a null text."""
        sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(self.path))

        def run(batches):
            lattice = Lattice(sent.value)
            for batch in batches:
                texts = [None if x is None else lattice.decode(np.array(x, dtype=np.int32)) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return encoded.select("doc_id", "pieces").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")

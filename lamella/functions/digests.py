"""MD5 of many short texts at once, of which the first six bytes are kept: what :func:`lamella.operators.generate.uniform` reads."""

from __future__ import annotations

import hashlib
import math

import numpy as np

TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
ADDED = [int(2**32 * abs(math.sin(i + 1))) for i in range(64)]
WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Endings:
    """Texts by number, to be appended to one beginning after the other."""

    def __init__(self, texts: list[str]):
        self.texts = [x.encode() for x in texts]
        self.length = np.array([len(x) for x in self.texts], dtype=np.uint32)
        width = -(-(int(self.length.max(initial=0)) + 4) // 4)
        #: The texts and the bit after them, moved by 0 to 3 bytes: words by text.
        self.moved = []
        for s in range(4):
            raw = b"".join((b"\0" * s + x + b"\x80").ljust(4 * width, b"\0") for x in self.texts)
            self.moved.append(np.ascontiguousarray(np.frombuffer(raw, dtype="<u4").reshape(-1, width).T))

    def uniform(self, beginning: str, a: int, b: int) -> np.ndarray:
        """Numbers from 0 to 1 of the beginning with each of the texts a to b."""
        first = beginning.encode()
        lengths = self.length[a:b]
        if not len(lengths):
            return np.zeros(0)
        if len(first) + int(lengths.max()) > 55:  # more than one block
            x = np.array([int.from_bytes(hashlib.md5(first + t).digest()[:6]) for t in self.texts[a:b]], dtype=np.float64)
            return (x + 0.5) / 16.0**12
        words: list[int | np.ndarray] = [int.from_bytes(first[k : k + 4].ljust(4, b"\0"), "little") for k in range(0, 64, 4)]
        at = len(first) // 4
        for t, own in enumerate(self.moved[len(first) % 4]):
            if at + t < 14:
                words[at + t] = own[a:b] | np.uint32(words[at + t]) if words[at + t] else own[a:b]
        bits = 8 * (lengths + np.uint32(len(first)))
        words[14] = int(bits[0]) if (lengths == lengths[0]).all() else bits
        return (digested(words, b - a) + 0.5) / 16.0**12


def digested(words: list[int | np.ndarray], m: int) -> np.ndarray:
    """The first six bytes of the digests of m blocks as numbers; words that are alike in all are given once."""
    a, b, c, d = (np.full(m, x, dtype=np.uint32) for x in START)
    f, g = np.empty(m, dtype=np.uint32), np.empty(m, dtype=np.uint32)
    for i in range(64):
        kind, w = i // 16, words[WORDS[i]]
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if isinstance(w, np.ndarray):
            np.add(f, w, out=f)
            w = 0
        np.add(f, np.uint32((ADDED[i] + w) & 0xFFFFFFFF), out=f)
        turn = TURNS[kind][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=g)
        np.left_shift(f, np.uint32(turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(START[0])
    b += np.uint32(START[1])
    return a.byteswap().astype(np.float64) * 65536.0 + (b.byteswap() >> np.uint32(16))

"""64-bit votes of token hashes, made in Arrow batches.

A token's hash is the first eight bytes of its md5. Hashes of tokens seen are remembered as rows of counters: four counters of 16 bits in
one word, so a token adds sixteen words; a text is summed in pieces of fewer tokens than a counter holds.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from holdfast.llm.text import runs, utf8

REMEMBERED = 1 << 17
PIECE = 60_000
CHUNK = 1 << 17
SLICE = 1 << 20


def pieces(text: bytes, size: int = 1_000_000) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end at white space, so no token is cut."""
    while len(text) > size:
        end = min((x for x in (text.find(s, size) for s in (b" ", b"\t", b"\n", b"\x0b", b"\f", b"\r")) if x >= 0), default=len(text))
        yield text[:end]
        text = text[end:]
    yield text


class Votes:
    """Sums of token bits for many texts at once: text after text is added, ``done`` gives (tokens, ones of each bit) of all of them."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((1024, 16), np.uint64)
        self.codes, self.starts, self.owner, self.n, self.sums = [], [], [], [], []

    def _learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.place]
        at = len(self.place)
        if at + len(new) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((max(len(self.table), at + len(new)), 16), np.uint64)))
        self.place.update(zip(new, range(at, at + len(new))))
        bits = np.unpackbits(np.frombuffer(b"".join(hashlib.md5(w).digest()[:8] for w in new), np.uint8).reshape(-1, 8), axis=1)
        self.table[at:at + len(new)] = bits.astype("<u2").view("<u8")

    def add(self, text: bytes) -> None:
        """Tokens are parted by [ \\t\\n\\x0B\\f\\r], as a Java pattern's white space."""
        self.n.append(0)
        for piece in pieces(text):
            words = piece.split()
            try:
                codes = [self.place[w] for w in words]
            except KeyError:
                self._learn(set(words))
                codes = [self.place[w] for w in words]
            for i in range(0, len(codes), PIECE):
                self.starts.append(len(self.codes) + i)
                self.owner.append(len(self.n) - 1)
            self.codes += codes
            self.n[-1] += len(codes)
            if len(self.codes) > CHUNK or len(self.place) > REMEMBERED:
                self._sum()

    def _sum(self) -> None:
        if self.codes:
            sums = np.add.reduceat(self.table[np.array(self.codes, np.int64)], np.array(self.starts, np.int64), axis=0)
            self.sums.append((np.array(self.owner, np.int64), sums.view("<u2").reshape(-1, 64)))
        self.codes, self.starts, self.owner = [], [], []
        if len(self.place) > REMEMBERED:
            self.place = {}

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        self._sum()
        n, ones = np.array(self.n, np.int64), np.zeros((len(self.n), 64), np.int64)
        for owner, sums in self.sums:
            np.add.at(ones, owner, sums)
        self.n, self.sums = [], []
        return n, ones


def words_of(n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits that more than half of the tokens have, as two 32-bit halves; the first bit of a digest is the highest."""
    w = np.packbits(2 * ones > n[:, None], axis=1).reshape(-1, 8).view(">u4").astype(np.int64)
    return w[:, 0], w[:, 1]


LANES = [(c, k) for c in ("_hi", "_lo") for k in range(11)]
TALLY = ", ".join(["_n long", *[f"`{c}{k}` long" for c, k in LANES]])


def tallies(key: str, text: str):
    """Rows of texts -> key, number of tokens and three counters of 21 bits in a word; of a text of over a million bytes several rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes()
        for b in batches:
            raw, off = utf8(b[text])
            for first, end in runs(off, SLICE):
                row = []
                for k in range(first, end):
                    for piece in pieces(raw[off[k]:off[k + 1]].tobytes()):
                        votes.add(piece)
                        row.append(k)
                n, ones = votes.done()
                has = np.flatnonzero(n)
                bit = {"_hi": ones[has][:, 31::-1], "_lo": ones[has][:, :31:-1]}  # by bit, the lowest first
                lanes = [sum(bit[c][:, at] << (21 * lane) for lane, at in enumerate(range(k, 32, 11))) for c, k in LANES]
                keys = b[key].take(pa.array(np.array(row, np.int64)[has]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(n[has]), *[pa.array(x) for x in lanes]], [key, "_n", *[f"{c}{k}" for c, k in LANES]])
    return run


def line_votes(key: str, text: str):
    """Rows of texts -> key, digest and fingerprint of every distinct line with a token of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes()
        for b in batches:
            raw, off = utf8(b[text])
            for first, end in runs(off, SLICE):
                row, digest = [], []
                for k in range(first, end):
                    for line in dict.fromkeys(raw[off[k]:off[k + 1]].tobytes().split(b"\n")):
                        if line and not line.isspace():
                            votes.add(line)
                            row.append(k)
                            digest.append(hashlib.md5(line).hexdigest())
                hi, lo = words_of(*votes.done())
                yield pa.RecordBatch.from_arrays([b[key].take(pa.array(row, pa.int64())), pa.array(digest, pa.string()), pa.array(hi), pa.array(lo)], [key, "digest", "fp_hi", "fp_lo"])
    return run

"""Byte-level BPE by ranks: exact merges in linear time, by backtracking over longest matches.

A piece of text is encoded from left to right. At each place the longest token that matches there is tried, then ever
shorter ones; a token may follow another only if the two are compatible, that is, if merging their joint bytes by
the ranks gives just these two. A sequence whose neighbours are all compatible is the one that merging gives, so
the first sequence that reaches the end is the result, and a place that was once given up is never tried again.
Matches come from the trie of pyahocorasick over the tokens, whose bytes are read as Latin-1 characters.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.text import utf8

#: Remembered pieces (of two generations) and pairs of a worker; results don't depend on them.
PIECES, PAIRS = 300_000, 1_000_000
#: Stands for the rank of a pair that isn't in the table.
NEVER = 1 << 62
#: Texts of more characters are split as they are read, not all at once.
LONG = 1 << 20
_CODECS: dict[tuple[str, str], "RankCodec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The lines of a rank file: a token in base64, then its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Splitter:
    """Matches of a pattern, with classes of characters as the library of the rank files has them.

    Two engines may know different versions of Unicode. A character that they put into different classes of the pattern
    is replaced, before the split only, by one that both put where the library has it.
    """

    def __init__(self, pattern: str):
        import regex
        import tiktoken
        import public_tokenizers
        self.pattern = regex.compile(pattern)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        single = {bytes([b]): b for b in range(256)}
        names = sorted(set(regex.findall(r"\\[pP]\{[^}]*\}|\\[sSdDwW]", pattern)))
        theirs = [set(bytes(tiktoken.Encoding(x, pat_str=x, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()) for x in names]
        self.odd = frozenset().union(*(t.symmetric_difference(regex.findall(x, every)) for x, t in zip(names, theirs)))
        # By the public pattern a match holds white space at its start or throughout, so one ends before a space that follows other text.
        self.by_space = pattern == public_tokenizers.PATTERN
        self.runs = [c + " " for c in regex.findall(r"\s", every)]
        self.table, stand_in = {}, {}
        for c in self.odd:
            kind = tuple(c in t for t in theirs)
            if kind not in stand_in:
                stand_in[kind] = next(x for x in every if x not in self.odd and x not in pattern and tuple(x in t for t in theirs) == kind)
            self.table[ord(c)] = stand_in[kind]

    def words(self, text: str) -> list[str] | None:
        """The text split at its spaces, where each but the first is known to begin a match; None where that isn't so."""
        if not self.by_space or len(text) > LONG or any(r in text for r in self.runs) or not (text.isascii() or self.odd.isdisjoint(text)):
            return None
        return text.split(" ")

    def __call__(self, text: str) -> Iterator[list[str]]:
        """The pieces of the text, in lists."""
        shadow = text if text.isascii() or self.odd.isdisjoint(text) else text.translate(self.table)
        if shadow is text and len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        some: list[str] = []
        for m in self.pattern.finditer(shadow):
            some.append(text[m.start():m.end()])
            if len(some) == 10_000:
                yield some
                some = []
        yield some


class RankCodec:
    """Encoding and decoding by a table of ranks. Ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for {len(missing)} single bytes")
        self.ranks, self.split = ranks, Splitter(pattern)
        self.bytes_of = {i: token for token, i in ranks.items()}
        # Merging never makes some tokens; these are only found as a whole piece.
        made = {token for token in ranks if len(token) < 3 or self.merged(token) == [token]}
        self.length, self.shorter, self.longest, self.reach = {}, {}, {}, max(map(len, made))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token in sorted(made, key=len):
            i, chars = ranks[token], token.decode("latin-1")
            self.automaton.add_word(chars, i)
            self.length[i] = len(token)
            self.shorter[i] = next((self.longest[chars[:k]] for k in range(len(chars) - 1, 0, -1) if chars[:k] in self.longest), -1)
            self.longest[chars] = i
        for chars in list(self.longest):  # the beginnings of tokens, with the longest token in each
            for k in range(2, len(chars)):
                self.longest.setdefault(chars[:k], self.longest[chars[:k - 1]])
        self.edges: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self.memory = Memory(self._piece_ids)
        self.words = Memory(self._word_ids)

    def _piece_ids(self, piece: str) -> str:
        data = piece.encode()
        ids = self.encode_piece(data)
        if self.decode(ids) != data:
            raise AssertionError(f"the ids of {piece[:80]!r} decode to something else")
        return ",".join(map(str, ids))

    def _word_ids(self, word: str) -> str:
        return ",".join(map(self.memory.__getitem__, self.split.pattern.findall(" " + word)))

    def merged(self, data: bytes, steps: list | None = None) -> list[bytes]:
        """Merging as defined, for short data: the pair of lowest rank first, of equal ones the leftmost.

        ``steps`` takes (rank, first part, last part) after each merge.
        """
        rank_of, parts = self.ranks.get, [data[i:i + 1] for i in range(len(data))]
        ranks = [rank_of(data[i:i + 2], NEVER) for i in range(len(data) - 1)]
        while ranks and (rank := min(ranks)) != NEVER:
            i = ranks.index(rank)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] + parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] + parts[i + 1], NEVER)
            if steps is not None:
                steps.append((rank, parts[0], parts[-1]))
        return parts

    def history(self, i: int) -> tuple[list, list]:
        """Merges that make a token: (rank of the next one, last part) and (rank of the next one, first part), from its bytes on."""
        known = self.edges.get(i)
        if known is None:
            token, steps = self.bytes_of[i], []
            self.merged(token, steps)
            ranks = [s[0] for s in steps] + [NEVER]
            known = self.edges[i] = list(zip(ranks, [token[-1:]] + [s[2] for s in steps])), list(zip(ranks, [token[:1]] + [s[1] for s in steps]))
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together leaves just these two: no merge across their border ever comes first."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._compatible(self.history(a)[0], self.history(b)[1])
        return known

    def _compatible(self, left: list, right: list) -> bool:
        i, j, (next_a, last), (next_b, first) = 0, 0, left[0], right[0]
        across = self.ranks.get(last + first, NEVER)
        while across >= next_a or across > next_b:  # of equal ranks the leftmost merges first
            if next_a <= next_b:
                if next_a == NEVER:
                    return True
                i += 1
                next_a, new = left[i]
                if new != last:
                    last = new
                    across = self.ranks.get(last + first, NEVER)
            else:
                j += 1
                next_b, new = right[j]
                if new != first:
                    first = new
                    across = self.ranks.get(last + first, NEVER)
        return False

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        chars, n = data.decode("latin-1"), len(data)
        length, shorter, longest, reach = self.length, self.shorter, self.longest, self.reach
        known, prefix = self.pairs.get, self.automaton.longest_prefix
        given_up, out, at, last = bytearray(n + 1), [], 0, -1
        some = chars[:reach]
        i = longest[some[:prefix(some)]]
        while True:
            end = at + length[i]
            if not given_up[end] and (last < 0 or (fits := known(last << 32 | i)) or fits is None and self.compatible(last, i)):
                out.append(i)
                if end == n:
                    return out
                at, last = end, i
                some = chars[at:at + reach]
                i = longest[some[:prefix(some)]]
            elif shorter[i] >= 0:
                i = shorter[i]
            else:
                given_up[at] = 1
                i = out.pop()
                at -= length[i]
                last = out[-1] if out else -1

    def encode(self, text: str) -> list[int]:
        return [i for some in self.split(text) for p in some for i in self.encode_piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the bytes that they decode to."""
        n, ids, back, comma = 0, hashlib.sha256(), hashlib.sha256(), ""
        words = self.split.words(text)
        if words and len(words) > 1:
            first = map(self.memory.__getitem__, self.split.pattern.findall(words.pop(0)))
            joined = ",".join([*first, *map(self.words.__getitem__, words)])
            return joined.count(",") + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        for some in self.split(text):
            if some:
                joined = ",".join(map(self.memory.__getitem__, some))
                n += joined.count(",") + 1
                ids.update((comma + joined).encode())
                back.update("".join(some).encode())  # what the ids decode to: the memory has compared it piece by piece
                comma = ","
        return n, ids.hexdigest(), back.hexdigest()


class Memory(dict):
    """Ids as text by what they encode. When it is full only what is used again stays."""

    def __init__(self, encode: Callable[[str], str]):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, key: str) -> str:
        known = self.before.get(key)
        if known is None:
            known = self.encode(key)
        if len(key) <= 64:
            if len(self) >= PIECES:
                self.before = dict(self)
                self.clear()
            self[key] = known
        return known


def rank_codec(path: str | None = None, pattern: str | None = None) -> RankCodec:
    """The codec of a rank file and a pattern, built once in a worker. Without them: the public multilingual ranks and pattern."""
    import public_tokenizers
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = RankCodec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of every whole text; a null or empty text has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = rank_codec(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = pa.array([c.encode(t or "") for t in part["text"].to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids], ["doc_id", "ids"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.select('doc_id').dtypes[0][1]}, ids array<int>")


def rank_token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: whole texts encoded by ranks, and decoded again.

    A null text counts as empty, which has no ids (digests of nothing); ids may be null or repeated, repeated rows give
    repeated rows; an empty table gives an empty result; other columns are ignored. The work is narrow: no shuffle,
    one row of output for a row of input. A long text is split as it is read; only one piece is held by character.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = rank_codec(path, pattern)
        for b in batches:
            raw, off = utf8(b["text"])
            raw = raw.tobytes()
            got = [c.digest(raw[i:j].decode()) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            n, ids, back = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.select('doc_id').dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")

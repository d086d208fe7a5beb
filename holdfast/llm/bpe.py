"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that occur inside no token of the vocabulary can never be merged, so a text may be cut between
them. The fragments (mostly words) are encoded independently, each distinct one once for as long as it is
remembered, and their ids are concatenated. A cut is made only where the splitting of the text before the merges
cannot change either: not after white space (its split looks ahead), not inside a character and not before an
apostrophe (which may begin a contraction).
"""
from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.text import utf8

#: Remembered fragments of a worker; a full memory is emptied, results don't depend on it.
MEMORY = 200_000
_CODECS: dict[str, "Codec"] = {}


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Codec:
    """A byte-level BPE tokenizer file with forced boundaries and a memory of fragments."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        symbols = byte_symbols()
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        self.added = {content: i for i, content in added.items()}
        self.bytes_of = {i: content.encode() for i, content in added.items()}
        inside = np.zeros((256, 256), bool)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            raw = bytes(symbols[c] for c in token)
            self.bytes_of.setdefault(i, raw)
            inside[list(raw[:-1]), list(raw[1:])] = True
        cut = ~inside
        cut[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False  # after white space
        cut[:, 39] = False  # before an apostrophe
        cut[:, 0x80:0xC0] = False  # inside a character
        self.cut = cut.ravel()
        # White space beyond ASCII ends in one of these bytes after one of those.
        self.wide_last, self.wide_lead = np.zeros(256, bool), np.zeros(256, bool)
        self.wide_last[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
        self.wide_lead[[0xC2, 0x80, 0x81, 0x9A]] = True
        self.memory: dict[bytes, tuple[str, int, bytes]] = {}

    def fragments(self, data: bytes) -> list[bytes]:
        a = np.frombuffer(data, np.uint8)
        if len(a) < 2:
            return [data] if data else []
        at = np.flatnonzero(self.cut[a[:-1].astype(np.int32) * 256 + a[1:]])
        if len(at):
            wide = self.wide_last[a[at]] & self.wide_lead[a[np.maximum(at - 1, 0)]]
            at = at[~wide] + 1 if wide.any() else at + 1
        edge = at.tolist()
        return [data[i:j] for i, j in zip([0, *edge], [*edge, len(data)])]

    def parts(self, text: str) -> list[bytes | int]:
        """Fragments of the text; an added token, which is matched before all else, is its id."""
        out: list[bytes | int] = []
        if not any(content in text for content in self.added):
            return self.fragments(text.encode())
        rest = text
        while rest:
            at, content = min(((rest.find(c), c) for c in self.added if c in rest), default=(len(rest), ""), key=lambda x: (x[0], -len(x[1])))
            out += self.fragments(rest[:at].encode())
            if not content:
                break
            out.append(self.added[content])
            rest = rest[at + len(content):]
        return out

    def learn(self, fragments: set[bytes]) -> None:
        """Encode fragments that aren't remembered, and decode their ids."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
        new = [f for f in fragments if f not in self.memory]
        for i in range(0, len(new), 20_000):
            some = new[i:i + 20_000]
            for f, e in zip(some, self.tok.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)):
                ids = e.ids
                self.memory[f] = (",".join(map(str, ids)), len(ids), b"".join(map(self.bytes_of.__getitem__, ids)))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the text that they decode to."""
        parts = self.parts(text)
        if any(isinstance(x, int) for x in parts):
            known = {x: (str(x), 1, self.bytes_of[x]) for x in parts if isinstance(x, int)}
            words = {x for x in parts if isinstance(x, bytes)}
        else:
            known, words = {}, set(parts)
        self.learn(words)
        known |= {w: self.memory[w] for w in words}
        got = list(map(known.__getitem__, parts))
        ids = ",".join([x[0] for x in got])
        raw = b"".join([x[2] for x in got])
        text_back = raw if raw == text.encode() else raw.decode("utf-8", "replace").encode()
        return sum([x[1] for x in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text_back).hexdigest()

    def encode(self, text: str) -> list[int]:
        parts = self.parts(text)
        self.learn({x for x in parts if isinstance(x, bytes)})
        out: list[int] = []
        for x in parts:
            out += [x] if isinstance(x, int) else map(int, self.memory[x][0].split(","))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of every whole text; a null or empty text has none. ``path`` is a tokenizer file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path())
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = pa.array([c.encode(t or "") for t in part["text"].to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids], ["doc_id", "ids"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.select('doc_id').dtypes[0][1]}, ids array<int>")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: whole texts encoded, and decoded again.

    A null text counts as empty, which has no ids; repeated rows give repeated rows; an empty table gives an empty
    result; other columns are ignored. The work is narrow: no shuffle, one row of output for a row of input.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path())
        for b in batches:
            raw, off = utf8(b["text"])
            raw = raw.tobytes()
            got = [c.digest(raw[i:j].decode()) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            n, ids, back = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.select('doc_id').dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")

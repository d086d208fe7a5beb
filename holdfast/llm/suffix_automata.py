"""Repeated word windows by suffix automata of reference shards.

All texts are both reference and query. The reference is dealt into shards by the anchors of its windows; a shard is the
contexts (short runs of words) around one anchor hash, so its automaton is small, and it comes to the very tasks whose documents can
match it instead of to all of them. The automaton counts the occurrences of each state; a context streamed through it gets, at each
word, the length of the longest suffix that occurs at least twice in the shard, and where that reaches the window
length the words are covered. A context that is there several times needs no streaming: all of it is repeated.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.repeats import Rule, base, cleaned, digests, spans
from holdfast.llm.text import mix, utf8
from holdfast.llm.words import words
from holdfast.session import cut

LENGTH, GRAM = 35, 6
PIECE = 1 << 22


def word_units(raw: np.ndarray, off: np.ndarray):
    """Hashes of the 6-word grams at each word, word offsets of the texts, first and end byte of each word."""
    if len(off) == 2 and len(raw) > PIECE:  # a very long text: its words piece by piece, cut at white space
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + PIECE)
            if end < len(raw):
                space = np.flatnonzero((raw[at:end] == 32) | ((raw[at:end] >= 9) & (raw[at:end] <= 13)))
                while not len(space) and end < len(raw):
                    end = min(len(raw), end + PIECE)
                    space = np.flatnonzero((raw[at:end] == 32) | ((raw[at:end] >= 9) & (raw[at:end] <= 13)))
                if len(space) and end < len(raw):
                    end = at + int(space[-1]) + 1
            h, s, e, _ = words(raw[at:end], np.array([0, end - at]), False)
            parts.append((h, s + at, e + at))
            at = end
        h, start, end_ = (np.concatenate(x) for x in zip(*parts))
        woff = np.array([0, len(h)])
    else:
        h, start, end_, woff = words(raw, off, False)
    n = max(0, len(h) - GRAM + 1)
    total = np.zeros(n, np.uint64)
    for i in range(GRAM):
        total = total * np.uint64(0xA0761D6478BD642F) + h[i:i + n]
    return mix(total), woff, start, end_


class Automaton:
    """Suffix automaton of several sequences; ``count`` of a state is how often its strings occur, by multiplicity."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def add(self, sequence: list, times: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.len, self.count
        last = 0
        for c in sequence:
            if c in nxt[last]:
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, c)
            else:
                cur = len(length)
                length.append(length[last] + 1)
                nxt.append({})
                link.append(0)
                count.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                last = cur
            count[last] += times

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        length.append(length[p] + 1)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.count.append(0)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def finish(self) -> None:
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, sequence: list) -> Iterator[int]:
        """At each word, the length of the longest suffix that occurs at least twice."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        state = size = 0
        for c in sequence:
            while True:
                to = nxt[state].get(c)
                if to is not None and count[to] > 1:
                    state, size = to, size + 1
                    break
                if state == 0:
                    size = 0
                    break
                state = link[state]
                size = length[state]
            yield size


def automaton_kernel(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts sorted by anchor hash -> (row, first word, end word) of repeated words, in positions of the texts."""
    h, begin, hi = (rows[c].to_numpy().astype(np.int64) for c in ("h", "begin", "hi"))
    ctx = rows["ctx"].to_pylist()
    item, first, last = [], [], []
    edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))).tolist() if len(h) else []
    for a, z in zip(edge, edge[1:]):
        shard: dict[tuple, list[int]] = {}
        for k in range(a, z):
            shard.setdefault((int(hi[k]), *ctx[k].split()), []).append(k)
        single = [s for s, ks in shard.items() if len(ks) == 1]
        if single and len(shard) > 1:
            auto = Automaton()
            for s, ks in shard.items():
                auto.add(s[1:], len(ks))
            auto.finish()
            for s in single:
                k = shard[s][0]
                for j, size in enumerate(auto.repeated(s[1:])):
                    if size >= LENGTH:
                        item.append(k)
                        first.append(begin[k] + j + 1 - LENGTH)
                        last.append(begin[k] + j + 1)
        for s, ks in shard.items():
            if len(ks) > 1:
                item += ks
                first += [begin[k] for k in ks]
                last += [begin[k] + len(s) - 1 for k in ks]
    if not item:
        return (np.zeros(0, np.int64),) * 3
    # windows of one context that touch become one span
    item, first, last = np.array(item), np.array(first), np.array(last)
    new = np.concatenate(([True], (item[1:] != item[:-1]) | (first[1:] > last[:-1])))
    at = np.flatnonzero(new)
    return item[at], first[at], last[np.concatenate((at[1:] - 1, [len(item) - 1]))]


def without_words(text: bytes, merged: list[list[int]]) -> str:
    kept, at, all_ = [], 0, text.split()
    for a, z in merged:
        kept += all_[at:a]
        at = z
    return hashlib.sha256(b" ".join(kept + all_[at:])).hexdigest()


WORDS = Rule(LENGTH, GRAM, word_units, automaton_kernel, without_words)


def whole_words(docs: DataFrame) -> DataFrame:
    """doc_id, th, th2, copy, n_words, whole: the number of words and the digest of all of them; copy is a digest of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8(b["text"])
            raw = raw.tobytes()
            n, sha = [], []
            for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
                w = raw[i:j].split()
                n.append(len(w))
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], b["th2"], b["copy"], pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "th", "th2", "copy", "n_words", "whole"])
    return docs.select("doc_id", *digests(), F.sha2("text", 256).alias("copy"), "text").mapInArrow(run, "doc_id long, th long, th2 long, copy string, n_words long, whole string")


def remove_repeated_words(docs: DataFrame, hot: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: words in a window of 35 that also starts elsewhere go.

    Windows are judged on the input, all texts and the same one included; they don't cross texts. A null text has no words. Of
    copies of a text of at least 35 words all is removed, in every copy; rows that repeat a doc_id or have none are texts of their own; an
    empty table gives an empty result; other columns are ignored.
    """
    docs = base(docs)
    rows = cut(whole_words(docs), "words-rows")
    copies = rows.groupBy("copy").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    marks, texts = spans(docs, WORDS, hot)
    part = cleaned(marks, texts, WORDS)
    out = rows.join(copies, "copy", "left").join(part, ["th", "th2"], "left")
    all_ = F.col("copies").isNotNull() & (F.col("n_words") >= LENGTH)
    return out.select("doc_id", "n_words", F.when(all_, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
                      F.when(all_, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))

"""Repeated byte strings by a hash-compared suffix sort.

A kernel gets contexts of anchors: byte strings around a gram that occurs in all of them. For an offset o the suffixes that start o
bytes before the anchors are merge-sorted; two suffixes are compared by finding their common extension, a binary search over prefix
polynomial hashes, so a comparison costs a logarithm of the length. The longest extension that a suffix shares with any other one
is that with a neighbour in sorted order. If it reaches the length, the windows there repeat, which is verified on the bytes; the same
partner serves all offsets up to their common extension to the left, and the search goes on behind it. All groups of a chunk are worked together in numpy.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.repeats import Rule, base, cleaned, digests, spans
from holdfast.llm.text import mix, small_batches, utf8
from holdfast.llm.words import powers, prefix_hash
from holdfast.session import cut

LENGTH, GRAM, CORE = 200, 32, 25


def byte_units(raw: np.ndarray, off: np.ndarray):
    """Hashes of the 32-byte grams at each byte."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), off, None, None
    x = np.ndarray(len(raw) - 7, "<u8", np.ascontiguousarray(raw).data, strides=(1,)).copy()
    h = x[:n] * np.uint64(0x9E3779B97F4A7C15)
    for i, m in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(32)
        h += x[i:n + i]
        h *= np.uint64(m)
    return mix(h), off, None, None


class Extensions:
    """Common extensions of positions in one byte array by prefix hashes."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.h = raw, prefix_hash(raw)
        _, self.down = powers(len(raw) + 1)

    def same(self, p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        return (self.h[p + n] - self.h[p]) * self.down[p] == (self.h[q + n] - self.h[q]) * self.down[q]

    def right(self, p: np.ndarray, q: np.ndarray, cap: np.ndarray) -> np.ndarray:
        got = np.zeros(len(p), np.int64)
        b = 1 << max(0, int(cap.max(initial=0)).bit_length() - 1)
        while b:
            ok = np.flatnonzero(got + b <= cap)
            ok = ok[self.same(p[ok] + got[ok], q[ok] + got[ok], b)]
            got[ok] += b
            b >>= 1
        return got

    def left(self, p: np.ndarray, q: np.ndarray, cap: np.ndarray) -> np.ndarray:
        got = np.zeros(len(p), np.int64)
        b = 1 << max(0, int(cap.max(initial=0)).bit_length() - 1)
        while b:
            ok = np.flatnonzero(got + b <= cap)
            ok = ok[self.same(p[ok] - got[ok] - b, q[ok] - got[ok] - b, b)]
            got[ok] += b
            b >>= 1
        return got

    def verified(self, p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the bytes themselves agree."""
        out = np.ones(len(p), bool)
        for i in range(0, len(p), 8192):
            m = n[i:i + 8192]
            at = np.cumsum(m) - m
            step = np.arange(int(m.sum())) - np.repeat(at, m)
            bad = self.raw[np.repeat(p[i:i + 8192], m) + step] != self.raw[np.repeat(q[i:i + 8192], m) + step]
            if bad.any():
                out[i + np.unique(np.repeat(np.arange(len(m)), m)[bad])] = False
        return out

    def before(self, p: np.ndarray, p_end: np.ndarray, q: np.ndarray, q_end: np.ndarray, or_same: np.ndarray) -> np.ndarray:
        """Whether the suffix at q sorts before that at p, or is equal where that is asked for."""
        cap = np.minimum(p_end - p, q_end - q)
        got = self.right(p, q, cap)
        out = np.where(q_end - q == p_end - p, or_same, q_end - q < p_end - p)
        inner = got < cap
        out[inner] = self.raw[q[inner] + got[inner]] < self.raw[p[inner] + got[inner]]
        return out


def merge_sort(ext: Extensions, pos: np.ndarray, end: np.ndarray, seg_start: np.ndarray, seg_size: np.ndarray) -> np.ndarray:
    """Order of the suffixes within segments (contiguous; start and size are given per element), bottom up, all segments at once."""
    order, place, width = np.arange(len(pos)), np.arange(len(pos)) - seg_start, 1
    while width < seg_size.max(initial=0):
        run = place // width
        sib = (run ^ 1) * width
        size = np.minimum(width, seg_size - sib)
        slot = np.flatnonzero(size > 0)
        lo, hi = np.zeros(len(slot), np.int64), size[slot].copy()
        first = seg_start[slot] + sib[slot]
        me, right_run = order[slot], (run[slot] & 1).astype(bool)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) >> 1
            other = order[first[live] + mid]
            less = ext.before(pos[me[live]], end[me[live]], pos[other], end[other], right_run[live])
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        new = np.arange(len(pos))
        base_ = seg_start[slot] + (run[slot] & ~1) * width
        new[slot] = base_ + (place[slot] - run[slot] * width) + lo
        nxt = np.empty_like(order)
        nxt[new] = order
        order, width = nxt, width * 2
    return order


def repeating_cores(ext: Extensions, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether another context of the group has the same bytes that all windows of some block of offsets hold.

    Windows of ``CORE`` neighbouring offsets share all but ``CORE`` - 1 of their bytes. Contexts without such a partner repeat nowhere, so they
    need no sorting; a common gram in different surroundings is mostly that. Colliding hashes only keep a context more.
    """
    keep = np.zeros(len(anchor), bool)
    for least in range(0, LENGTH, CORE):
        at = np.flatnonzero((lo < least + CORE) & (hi >= least))
        p = anchor[at] - least
        key = mix((ext.h[p + LENGTH - CORE + 1] - ext.h[p]) * ext.down[p]) ^ (group[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        keep[at[order[1:][same]]] = True
        keep[at[order[:-1][same]]] = True
    return keep


def suffix_kernel(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts sorted by anchor hash -> (row, first byte, end byte) of repeated bytes, in positions of the texts."""
    raw, off = utf8(rows["ctx"])
    h, begin, hi = (rows[c].to_numpy().astype(np.int64) for c in ("h", "begin", "hi"))
    n = len(h)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    group = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]).astype(np.int64))))
    ext = Extensions(raw)
    start, end = off[:-1], off[1:]
    anchor, lo = start + hi, hi - (end - start - LENGTH)
    # Equal contexts of a group become one item; each window of such a one repeats.
    whole = mix((ext.h[end] - ext.h[start]) * ext.down[start] + (end - start).astype(np.uint64))
    by = np.lexsort((whole, hi, group))
    same = (group[by][1:] == group[by][:-1]) & (hi[by][1:] == hi[by][:-1]) & (whole[by][1:] == whole[by][:-1]) & ((end - start)[by][1:] == (end - start)[by][:-1])
    at = np.flatnonzero(same)
    same[at] = ext.verified(start[by[at]], start[by[at + 1]], (end - start)[by[at]])
    head = np.concatenate(([True], ~same))
    many = np.zeros(n, bool)
    many[by[:-1][same]] = True
    many[by[1:][same]] = True
    out = [(np.flatnonzero(many), begin[many], (begin + end - start)[many])]
    item = np.sort(by[head])
    size = np.bincount(group[item], minlength=group[-1] + 1)
    item = item[size[group[item]] > 1]
    item = item[repeating_cores(ext, anchor[item], lo[item], hi[item], group[item])]
    g = group[item]
    g_first = np.searchsorted(g, np.arange(group[-1] + 2))
    active = item[~many[item]]
    o = lo[active].copy()
    while len(active):
        keys = np.unique(group[active] * 1024 + o)
        kg, ko = keys // 1024, keys % 1024
        count = g_first[kg + 1] - g_first[kg]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        member, key = item[np.repeat(g_first[kg], count) + step], np.repeat(np.arange(len(keys)), count)
        mo = ko[key]
        fit = mo <= hi[member]
        member, key, mo = member[fit], key[fit], mo[fit]
        seg_size = np.bincount(key, minlength=len(keys))
        seg_first = np.cumsum(seg_size) - seg_size
        pos = anchor[member] - mo
        order = merge_sort(ext, pos, end[member], seg_first[key], seg_size[key])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # the active item's slot among the members, and its neighbours in sorted order
        mine = np.searchsorted(key * (n + 1) + member, np.searchsorted(keys, group[active] * 1024 + o) * (n + 1) + active)
        k = key[mine]
        best = np.full(len(active), -1, np.int64)
        reach, back = np.zeros(len(active), np.int64), np.zeros(len(active), np.int64)
        for side in (-1, 1):
            p = place[mine] + side
            ok = np.flatnonzero((p >= seg_first[k]) & (p < seg_first[k] + seg_size[k]))
            q = member[order[p[ok]]]
            a, oo = active[ok], o[ok]
            x, y = anchor[a] - oo, anchor[q] - oo
            got = ext.right(x, y, np.minimum(end[a] - x, end[q] - y))
            wide = oo + ext.left(x, y, np.minimum(hi[a], hi[q]) - oo)
            better = (best[ok] < 0) | (got > reach[ok]) | ((got == reach[ok]) & (wide > back[ok]))
            w = ok[better]
            best[w], reach[w], back[w] = q[better], got[better], wide[better]
        r = reach - o
        first, last = np.maximum(o, LENGTH - r), np.minimum(back, hi[active])
        hit = np.flatnonzero((best >= 0) & (first <= last))
        good = ext.verified(anchor[active[hit]] - last[hit], anchor[best[hit]] - last[hit], last[hit] + LENGTH - first[hit])
        for bad in hit[~good]:
            out.append(_by_bytes(raw, active[bad], item[g == group[active[bad]]], anchor, lo, hi, start, begin))
        hit = hit[good]
        a = active[hit]
        out.append((a, begin[a] + hi[a] - last[hit], begin[a] + hi[a] - first[hit] + LENGTH))
        o = np.where(best < 0, hi[active] + 1, np.maximum(back + 1, LENGTH - r))
        live = o <= hi[active]
        active, o = active[live], o[live]
    return tuple(np.concatenate(x) for x in zip(*out))


def _by_bytes(raw, p, items, anchor, lo, hi, start, begin):
    """All windows of one context against the others, byte by byte: only after a collision of hashes."""
    data, found = raw.tobytes(), []
    for o in range(lo[p], hi[p] + 1):
        w = data[anchor[p] - o:anchor[p] - o + LENGTH]
        if any(q != p and lo[q] <= o <= hi[q] and data[anchor[q] - o:anchor[q] - o + LENGTH] == w for q in items):
            found.append(begin[p] + hi[p] - o)
    return np.full(len(found), p), np.array(found, np.int64), np.array(found, np.int64) + LENGTH


def without_bytes(text: bytes, merged: list[list[int]]) -> str:
    out, at = hashlib.sha256(), 0
    for a, z in merged:
        out.update(text[at:a])
        at = z
    out.update(text[at:])
    return out.hexdigest()


BYTES = Rule(LENGTH, GRAM, byte_units, suffix_kernel, without_bytes)


def remove_repeated_bytes(docs: DataFrame, hot: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row: bytes in a 200-byte string that also starts elsewhere go.

    Strings are judged on the input, all texts and the same one included; matches don't cross texts. A null text is empty. Of copies
    of a text of at least 200 bytes all is removed, in every copy; rows that repeat a doc_id or have none are texts of their own; an empty
    table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = base(docs)
    rows = docs.select("doc_id", *digests(), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    rows = cut(rows, "bytes-rows")
    copies = rows.groupBy("whole", "n_bytes").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    marks, texts = spans(docs, BYTES, hot)
    part = cleaned(marks, texts, BYTES)
    out = rows.join(copies, ["whole", "n_bytes"], "left").join(part, ["th", "th2"], "left")
    all_ = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
                      F.when(all_, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
                      F.when(all_, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))

"""Repeated windows of a fixed length across all documents: candidate search shared by byte and word operators.

Every window of L units is assigned to its anchor, the k-unit gram of the smallest hash inside it. Equal windows have equal
anchors at equal offsets, so a window can only repeat within the group of its anchor's hash. An anchor stands for a run of
windows and the few units around it (its context), about one in L / 2 positions is an anchor, and only anchors whose hash occurs twice among
different texts go on: their contexts are shuffled by hash and handed to the kernel of the operator, group by group. Groups of more
than ``hot`` contexts are not given to one task: they are split by offset and by neighbouring units, equal parts are combined, and the
kernel takes the parts.
"""
from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.text import mix, text_of, utf8
from holdfast.session import cut

CHUNK = 1 << 15  # bytes hashed at a time: what is made of them stays in a core's cache
POS_BITS = 22
MASK = np.uint64((1 << POS_BITS) - 1)
HEAVY = 2000
SPREAD = 16


@dataclass(frozen=True)
class Rule:
    """``units(raw, off)`` gives (gram hash at each unit, unit offsets of the texts, first byte and end byte of each unit or None for bytes)."""
    length: int
    gram: int
    units: Callable
    kernel: Callable
    rebuild: Callable


def winnow(h: np.ndarray, uoff: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start (all as unit indexes) of each run of windows with one anchor."""
    n = int(uoff[-1])
    if n < length or not len(h):
        return (np.zeros(0, np.int64),) * 3
    v = (h & ~MASK) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < width:
        v = np.minimum(v[:len(v) - (width - size)], v[width - size:])
    edge = np.zeros(n + 1, np.int32)
    lens = np.diff(uoff)
    full = lens >= length
    np.add.at(edge, uoff[:-1][full], 1)
    np.add.at(edge, uoff[1:][full] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    anchor = (v[start] & MASK).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return anchor[new], start[new], start[np.concatenate((new[1:] - 1, [len(start) - 1]))]


def spans_of(off: np.ndarray, rule: Rule) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, first unit, ...) pieces are cut by ``anchors_of``; this only groups whole texts below the chunk size."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1, i + 1), n)
        yield i, j
        i = j


def anchors_of(raw: np.ndarray, off: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, ...]]:
    """Text index, hash, position, smallest and largest offset of every anchor of the texts."""
    for i, j in spans_of(off, rule):
        h, uoff, _, _ = rule.units(raw[off[i]:off[j]], off[i:j + 1] - off[i])
        n, step = int(uoff[-1]), 1 << 21
        for at in range(0, max(1, n), step):  # one piece, unless a text is very long
            end = min(n, at + step + rule.length - 1)
            if at and end - at < rule.length:
                break
            sub = np.clip(uoff, at, end) - at
            a, s, e = winnow(h[at:max(at, end - rule.gram + 1)], sub, rule.length, rule.gram)
            if len(a):
                doc = np.searchsorted(uoff, a + at, "right") - 1
                yield doc + i, h[a + at], a + at - uoff[doc], a - e, a - s


def _anchors(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # texts of this task so far: copies are taken once
        for b in batches:
            th, th2 = (b[c].to_numpy() for c in ("th", "th2"))
            fresh = []
            for k, key in enumerate(zip(th.tolist(), th2.tolist())):
                if key not in seen:
                    seen.add(key)
                    fresh.append(k)
            if not fresh:
                continue
            raw, off = utf8(b["text"].take(pa.array(fresh)) if len(fresh) < len(th) else b["text"])
            fresh = np.array(fresh)
            for doc, h, pos, lo, hi in anchors_of(raw, off, rule):
                k = fresh[doc]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(th[k]), pa.array(th2[k]), pa.array(pos.astype(np.int32)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16))], ["h", "th", "th2", "pos", "lo", "hi"])
    return run


def _contexts(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8(b["text"])
            th, th2 = b["th"].to_pylist(), b["th2"].to_pylist()
            lists = b["anchors"]
            loff, flat = lists.offsets.to_numpy(), lists.values
            h, pos, lo, hi, n = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("h", "pos", "lo", "hi", "n"))
            out: list[list] = [[] for _ in range(7)]
            for k in range(b.num_rows):
                text = raw[off[k]:off[k + 1]]
                data = text.tobytes()
                s = slice(loff[k], loff[k + 1])
                _, _, first, end = rule.units(text, np.array([0, len(text)])) if rule.gram and rule.units.__name__ != "byte_units" else (None, None, None, None)
                a, z = pos[s].astype(np.int64) - hi[s], pos[s].astype(np.int64) - lo[s] + rule.length
                fa, fz = (a, z) if first is None else (first[a], end[z - 1])
                out[0] += h[s].tolist()
                out[1] += [th[k]] * len(a)
                out[2] += [th2[k]] * len(a)
                out[3] += a.tolist()
                out[4] += hi[s].tolist()
                out[5] += n[s].tolist()
                out[6] += [data[x:y] for x, y in zip(fa.tolist(), fz.tolist())]
                if len(out[0]) > 20_000:
                    yield _rows(out)
                    out = [[] for _ in range(7)]
            yield _rows(out)
    return run


CONTEXT = "h long, th long, th2 long, begin int, hi int, n int, ctx binary"


def _rows(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["h", "th", "th2", "begin", "hi", "n", "ctx"])


def _groups(rule: Rule, chunk_bytes: int):
    """Rows sorted by h -> spans; whole groups are gathered up to a number of bytes and given to the kernel."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done(rows: pa.Table) -> pa.RecordBatch:
            item, a, z = rule.kernel(rows)
            item = pa.array(item, pa.int64())
            return pa.RecordBatch.from_arrays([rows["th"].take(item).combine_chunks(), rows["th2"].take(item).combine_chunks(), pa.array(a, pa.int32()), pa.array(z, pa.int32())], ["th", "th2", "a", "z"])
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b["ctx"].nbytes
            if size >= chunk_bytes:
                rows = pa.Table.from_batches(held).combine_chunks()
                h = rows["h"].to_numpy()
                last = int(np.searchsorted(h, h[-1])) if h[0] <= h[-1] else 0
                if last:
                    yield done(rows.slice(0, last))
                    rows = rows.slice(last)
                held = pa.Table.from_batches(rows.to_batches()).combine_chunks().to_batches()
                size = sum(x["ctx"].nbytes for x in held)
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks())
    return run


def _parts(rule: Rule, width: int):
    """Contexts -> their parts by blocks of ``width`` offsets of the window before the anchor, in the columns of a context.

    All windows of a block hold the units from the block's smallest offset before the anchor to the end of the window of its largest one
    (the core). Equal windows have equal offsets, so equal cores: anchor, block and core are the part's new group.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_bytes = rule.units.__name__ == "byte_units"
        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            out: list[list] = [[] for _ in range(7)]
            for h, th, th2, begin, hi, ctx in zip(*(b[c].to_pylist() for c in ("h", "th", "th2", "begin", "hi", "ctx"))):
                units = ctx if whole_bytes else ctx.split()
                lo = hi - (len(units) - rule.length)
                for block in range(lo // width, hi // width + 1):
                    least, most = block * width, block * width + width - 1
                    a, z = max(lo, least), min(hi, most)
                    core, part = units[hi - least:hi - most + rule.length], units[hi - z:hi - a + rule.length]
                    if not whole_bytes:
                        core, part = b" ".join(core), b" ".join(part)
                    key = hashlib.blake2b(core, digest_size=8, key=struct.pack("<qi", h, block)).digest()
                    for column, value in zip(out, (int.from_bytes(key, "little", signed=True), th, th2, begin + hi - z, z, 0, part)):
                        column.append(value)
            yield _rows(out)
    return run


def _split_marks(contexts: DataFrame, rule: Rule, hot: int, tasks: int, chunk_bytes: int) -> list[DataFrame]:
    """Spans of groups with more contexts than one task should hold, by the same kernel.

    The contexts are split into parts (``_parts``), and equal parts are counted with map-side combining: the kernel gets each kind of a group
    once, or twice where it occurs more often. A group of still too many different kinds is split by narrower blocks; with
    blocks of one offset a part is one window, so a group has one kind.
    """
    marks = []
    kind = [F.xxhash64("h", "hi", "ctx").alias("k1"), F.xxhash64(F.lit(7), "h", "hi", "ctx").alias("k2")]
    for width in sorted({max(1, rule.length // 6), max(1, rule.length // 24), 1}, reverse=True):
        parts = cut(contexts.mapInArrow(_parts(rule, width), CONTEXT), "repeat-parts")
        kinds = cut(parts.groupBy("h", "hi", "ctx").agg(F.count("*").alias("n")), "repeat-kinds")
        sizes = cut(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("parts")).where("parts > 1").select("h", "kinds"), "repeat-sizes")
        calm = sizes if width == 1 else sizes.where(F.col("kinds") <= hot)
        twins = kinds.join(calm.select("h"), "h", "left_semi").select(
            *kind, "h", "hi", "ctx", F.lit(0).alias("begin"), F.explode(F.array_repeat(F.lit(0), F.least("n", F.lit(2)).cast("int"))).alias("twin"))
        twins = twins.withColumnsRenamed({"k1": "th", "k2": "th2"}).repartition(tasks, "h").sortWithinPartitions("h")
        found = cut(twins.mapInArrow(_groups(rule, chunk_bytes), "th long, th2 long, a int, z int").distinct(), "repeat-found")
        # a kind may be part of a third of all texts: its rows are dealt over several tasks
        found = found.select(F.col("th").alias("k1"), F.col("th2").alias("k2"), "a", "z", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
        rows = parts.select("th", "th2", "begin", *kind, F.pmod(F.xxhash64("th", "begin"), F.lit(SPREAD)).cast("int").alias("salt"))
        marks.append(cut(rows.join(found, ["k1", "k2", "salt"]).select("th", "th2", (F.col("begin") + F.col("a")).alias("a"), (F.col("begin") + F.col("z")).alias("z")), "repeat-hot"))
        more = sizes.where(F.col("kinds") > hot).select("h")
        if width == 1 or not more.limit(1).count():
            return marks
        contexts = parts.join(more, "h", "left_semi").select(*parts.columns)
    return marks


def _repeated(found: DataFrame, hot: int, tasks: int) -> DataFrame:
    """Anchors whose hash occurs at different places, with the number ``n`` of its rows; copies of a text in other tasks are no other place.

    Hashes are counted with map-side combining. Those with more than 1/2,000 of the rows that go on are at most 2,000; they are broadcast
    and their rows dealt over all tasks of the join.
    """
    place = F.xxhash64("th", "th2", "pos")
    counts = cut(found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last").select("h", F.col("n").cast("int").alias("n")), "repeat-anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > max(hot, total // HEAVY)
    dealt = found.join(F.broadcast(counts.where(heavy).select("h", F.lit(True).alias("heavy"))), "h", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("heavy"), F.pmod(place, F.lit(tasks)).cast("int")).otherwise(0)).drop("heavy")
    lookup = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(heavy, F.lit(tasks - 1)).otherwise(0))))
    return dealt.join(lookup, ["h", "salt"]).drop("salt")


def _rebuilt(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 64) for whole in batches for i in range(0, whole.num_rows, 64)):
            removed, spans, sha = [], [], []
            for text, marks in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
                merged: list[list[int]] = []
                for m in sorted((m["a"], m["z"]) for m in marks):
                    if merged and m[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], m[1])
                    else:
                        merged.append([m[0], m[1]])
                removed.append(sum(z - a for a, z in merged))
                spans.append(len(merged))
                sha.append(rule.rebuild(text.encode(), merged))
            yield pa.RecordBatch.from_arrays([b["th"], b["th2"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["th", "th2", "n_removed", "n_spans", "kept_sha256"])
    return run


def spans(docs: DataFrame, rule: Rule, hot: int = 20_000, chunk_bytes: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """Spans (th, th2, a, z) of repeated windows between different texts, and the texts (th, th2, text) that they are in.

    ``docs`` has texts without nulls; th and th2 are hashes of the text, ids have no part in the search. Copies of one text
    are taken once: a text that occurs twice is repeated as a whole, which the caller knows from counting texts.
    """
    docs = docs.select("text", *digests())
    found = docs.mapInArrow(_anchors(rule), "h long, th long, th2 long, pos int, lo short, hi short")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_text = _repeated(found, hot, tasks).groupBy("th", "th2").agg(F.collect_set(F.struct("h", "pos", "lo", "hi", "n")).alias("anchors"))
    # one row per text; copies are combined within tasks before the exchange
    single = docs.groupBy("th", "th2").agg(F.first("text").alias("text"))
    texts = cut(single.join(by_text, ["th", "th2"]).select("th", "th2", "text", "anchors"), "repeat-texts")

    def contexts(which) -> DataFrame:
        chosen = texts.select("th", "th2", "text", F.filter("anchors", which).alias("anchors")).where(F.size("anchors") > 0)
        return chosen.mapInArrow(_contexts(rule), CONTEXT)
    calm = contexts(lambda x: x["n"] <= hot).repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(_groups(rule, chunk_bytes), "th long, th2 long, a int, z int")
    marks = cut(calm, "repeat-spans")
    if texts.where(F.exists("anchors", lambda x: x["n"] > hot)).limit(1).count():
        for part in _split_marks(contexts(lambda x: x["n"] > hot), rule, hot, tasks, chunk_bytes):
            marks = marks.union(part)
    return marks, texts


def cleaned(marks: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """th, th2, n_removed, n_spans, kept_sha256 of the texts with spans."""
    lists = marks.groupBy("th", "th2").agg(F.collect_set(F.struct("a", "z")).alias("spans"))
    return texts.select("th", "th2", "text").join(lists, ["th", "th2"]).mapInArrow(_rebuilt(rule), "th long, th2 long, n_removed long, n_spans long, kept_sha256 string")


def digests() -> tuple[Column, Column]:
    """th, th2: two hashes that together stand for a text."""
    return F.xxhash64("text").alias("th"), F.xxhash64(F.lit(7), "text").alias("th2")


def base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

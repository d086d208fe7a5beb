"""Near copies by min-max hashing: both the minimum and the maximum under each permutation, banded, confirmed on full sets.

Each permutation gives two values, so 70 of them make 140 for 28 bands of 5: two documents of similarity 0.8 share no band with a
chance of 1.5e-5, of 0.9 with 1e-11. Documents of equal shingle sets first become one. In each bucket the others are paired
with its head; pairs are confirmed by exact intersection of the full sets, and links join components. In buckets that then
still hold several components the pairs across them follow, so nothing in a bucket stays untested. Such a pair is
tested in full only when exact bounds on what it can share (shingles that occur in any other document, counts by hash class)
allow a link, and when at most ``far`` of 140 one-bit samples differ (14 are expected at 0.8; the chance of more
than 34 is below 1e-7). A bucket whose members are all near its head costs one test per member.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import components
from holdfast.llm.text import mix, runs, text_of, utf8
from holdfast.llm.words import shingles, words
from holdfast.session import cut


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
    return a[:n] | np.uint64(1), a[n:]


def min_max(s: np.ndarray, soff: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Minimum and maximum of each set under each of n permutations: sets x 2n. All sets hold something."""
    out = np.empty((len(soff) - 1, 2 * n), np.uint64)
    for p, (a, b) in enumerate(zip(*permutations(n, seed))):
        h = s * a + b
        out[:, 2 * p] = np.minimum.reduceat(h, soff[:-1])
        out[:, 2 * p + 1] = np.maximum.reduceat(h, soff[:-1])
    return out


def signatures(docs: DataFrame, k: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, two words that identify the set, the band keys, and one bit of each value."""
    n = bands * rows // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8(b["text"])
            for i, j in runs(off, 1 << 20):
                h, _, _, woff = words(raw[off[i]:off[j]], off[i:j + 1] - off[i], True)
                s, soff = shingles(h, woff, k)
                size = np.diff(soff)
                some = np.flatnonzero(size)
                d1, d2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                keys, bits = [None] * len(size), [None] * len(size)
                if len(some):
                    at = soff[some]
                    d1[some], d2[some] = np.add.reduceat(mix(s), at), np.add.reduceat(mix(s ^ np.uint64(0x5DEECE66D1234567)), at)
                    v = min_max(s, np.append(at, len(s)), n, seed)
                    low = (mix(v) & np.uint64(1)).astype(np.uint8)
                    packed = np.zeros((len(some), -(-2 * n // 64) * 64), np.uint8)
                    packed[:, :2 * n] = low
                    sample = np.packbits(packed, axis=1, bitorder="little").view("<i8")
                    band = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(some), 1))
                    for r in range(rows):
                        band = mix(band * np.uint64(0xA0761D6478BD642F) + v[:, r::rows])
                    for x, key, bit in zip(some.tolist(), band.view(np.int64), sample):
                        keys[x], bits[x] = key, bit
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"][i:j], pa.array(size, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "d1", "d2", "keys", "bits"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, bits array<long>")


def each_shingle(texts: DataFrame, k: int) -> DataFrame:
    """s, u: every distinct shingle of every text (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8(b["text"])
            ids = b["id"].to_numpy()
            for i, j in runs(off, 1 << 20):
                h, _, _, woff = words(raw[off[i]:off[j]], off[i:j + 1] - off[i], True)
                s, soff = shingles(h, woff, k)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.repeat(ids[i:j], np.diff(soff)))], ["s", "u"])
    return texts.select("id", "text").mapInArrow(run, "s long, u long")


def profiles(texts: DataFrame, k: int, classes: int = 64) -> DataFrame:
    """u, profile: how many shingles of a text fall into each of 64 hash classes; sums of minima bound an intersection."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8(b["text"])
            for i, j in runs(off, 1 << 20):
                h, _, _, woff = words(raw[off[i]:off[j]], off[i:j + 1] - off[i], True)
                s, soff = shingles(h, woff, k)
                row = np.repeat(np.arange(j - i), np.diff(soff))
                count = np.bincount(row * classes + (s % np.uint64(classes)).astype(np.int64), minlength=(j - i) * classes).reshape(j - i, classes)
                yield pa.RecordBatch.from_arrays([b["id"][i:j], pa.array(list(count.astype(np.int32)), pa.list_(pa.int32()))], ["u", "profile"])
    return texts.select("id", "text").mapInArrow(run, "u long, profile array<int>")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union; ``texts`` is (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for b in batches:
            a, c = b["a"].to_pylist(), b["b"].to_pylist()
            raw_a, off_a = utf8(b["text_a"])
            raw_b, off_b = utf8(b["text_b"])
            good = []
            for i, j in runs(off_b, 1 << 20):
                h, _, _, woff = words(raw_b[off_b[i]:off_b[j]], off_b[i:j + 1] - off_b[i], True)
                s, soff = shingles(h, woff, k)
                for x in range(i, j):
                    if a[x] != head:
                        head = a[x]
                        t = raw_a[off_a[x]:off_a[x + 1]]
                        h1, _, _, w1 = words(t, np.array([0, len(t)]), True)
                        own, _ = shingles(h1, w1, k)
                    other = s[soff[x - i]:soff[x - i + 1]]
                    if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
                        continue
                    both = np.concatenate([own, other])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(own) + len(other) - common):
                        good.append((a[x], c[x]))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], ["a", "b"])
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    # dealt by b first, where equal pairs meet too
    return pairs.repartition("b").distinct().join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 28, rows: int = 5, far: int = 34, seed: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links join sets of k-word shingles of similarity >= percent / 100.

    A-Z are lower-cased. A null or empty text or one without words has an empty set and is a group of its own; a text of
    fewer than k words is one shingle; rows that repeat a doc_id and text are one document and get equal results; rows that repeat a
    doc_id with other texts each follow their own text; a null doc_id is a group of its own with null as its id; an
    empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sig = cut(signatures(docs, k, bands, rows, seed), "minmax")
    some = F.col("n_shingles") > 0
    reps = sig.where(some & F.col("doc_id").isNotNull()).groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    first = F.col("doc_id") == F.col("rep")
    named = sig.join(reps, ["d1", "d2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & some, F.col("rep")).alias("rep"), F.when(first, F.col("keys")).alias("keys"), F.when(first, F.col("bits")).alias("bits"))
    named = cut(named, "minmax-reps")
    bucket = named.where("keys is not null").select(F.explode("keys").alias("key"), F.col("doc_id").alias("u"))
    shared = bucket.groupBy("key").agg(F.min("u").alias("head"), F.max("u").alias("_last")).where("head < _last").select("key", "head")
    bucket = cut(bucket.join(shared, "key").select("key", "u", "head"), "minmax-buckets")
    members = bucket.select(F.col("u").alias("id")).distinct()
    texts = cut(docs.withColumnRenamed("doc_id", "id").join(members, "id", "left_semi"), "minmax-texts")
    links = cut(confirm(bucket.where("u <> head").select(F.col("head").alias("a"), F.col("u").alias("b")), texts, k, percent), "minmax-links")
    groups = components(links)
    open_ = bucket.select("key", "u").join(groups.withColumnRenamed("node", "u"), "u", "left").select("key", "u", F.coalesce("component", "u").alias("c"))
    open_ = cut(open_, "minmax-open")
    mixed = open_.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    bits = named.where("bits is not null").select(F.col("doc_id").alias("u"), "bits", "n_shingles", "keys")
    side = cut(open_.join(mixed, "key", "left_semi").join(bits, "u"), "minmax-mixed")
    if not side.isEmpty():
        # What a document shares with any other is at most its shingles that occur elsewhere among these documents.
        those = texts.join(side.select(F.col("u").alias("id")).distinct(), "id", "left_semi")
        alone = each_shingle(those, k).groupBy("s").agg(F.count("*").alias("n"), F.max("u").alias("u")).where("n = 1").groupBy("u").agg(F.count("*").alias("alone"))
        side = side.join(alone, "u", "left").select("*", (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("shared")).drop("alone").where(F.col("shared") * 100 >= F.col("n_shingles") * percent)
        side = cut(side.join(profiles(those, k), "u"), "minmax-shared")
        x, y = (side.select(F.col("key").alias(f"key_{t}"), *[F.col(c).alias(f"{c}_{t}") for c in ("u", "c", "bits", "n_shingles", "shared", "keys", "profile")]) for t in "ab")
        apart = sum((F.bit_count(F.element_at("bits_a", i + 1).bitwiseXOR(F.element_at("bits_b", i + 1))) for i in range(-(-bands * rows // 64))), F.lit(0))
        def enough(common):
            return common * (100 + percent) >= (F.col("n_shingles_a") + F.col("n_shingles_b")) * percent
        most = F.least("shared_a", "shared_b")
        bound = F.aggregate(F.zip_with("profile_a", "profile_b", lambda p, q: F.least(p, q)), F.lit(0), lambda t, v: t + v)
        # a pair comes once, from the first band in which its keys agree
        agree = F.array_position(F.zip_with("keys_a", "keys_b", lambda p, q: p == q), True)
        first = F.get("keys_a", (agree - 1).cast("int")) == F.col("key_a")
        pairs = x.join(y, (F.col("key_a") == F.col("key_b")) & (F.col("c_a") < F.col("c_b")) & first & enough(most) & (apart <= far) & enough(bound)).select(F.col("u_a").alias("a"), F.col("u_b").alias("b"))
        more = cut(confirm(pairs, texts, k, percent), "minmax-links")
        # what is new joins components, so only their names and the new links are needed
        names = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = components(names.union(more))
    known = named.select("doc_id", "n_shingles", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return known.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

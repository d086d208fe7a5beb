"""Exact copies through an extendible-hash index on shared files.

Texts without white space are hashed to 64 bits. Rows with equal bytes in one Arrow batch first become one entry,
so a text that a third of all rows hold is a few entries. A directory over the leading bits of the key is grown by
doubling: while a bucket holds more than its capacity, it is split on its next bit. Owner tasks each get a range of buckets, walk the
entries in key order, chain those with equal keys and compare their bytes with the heads of the chain.
The index (entry, group) is written to the shared folder and joined back to the rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.text import SPACES, text_of, utf8
from holdfast.session import cut

ENTRY = "doc_id long, n_points long, text_sha256 string, entry long, key long, norm binary, n_rows long, best_points long, best_doc long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document; the first of equal texts in a batch also carries the entry for them."""
    count = TaskContext.get().partitionId() << 33
    for b in batches:
        raw, off = utf8(b["norm"])
        raw = raw.tobytes()
        ids, points = b["doc_id"].to_pylist(), b["n_points"].to_pylist()
        first: dict[bytes, int] = {}
        sha, entry, key, norm, n_rows, best = [], [], [], [], [], []
        for k, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            text = raw[i:j]
            head = first.setdefault(text, k)
            if head == k:
                digest = hashlib.sha256(text).digest()
                sha.append(digest.hex())
                entry.append(count + k)
                key.append(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True))
                norm.append(text)
                n_rows.append(1)
                best.append((points[k], ids[k]))
            else:
                sha.append(sha[head])
                entry.append(entry[head])
                key.append(None)
                norm.append(None)
                n_rows.append(None)
                best.append(None)
                n_rows[head] += 1
                best[head] = max(best[head], (points[k], ids[k]), key=lambda x: (x[0], x[1] is not None, -(x[1] or 0)))
        count += b.num_rows
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["n_points"], pa.array(sha, pa.string()), pa.array(entry, pa.int64()), pa.array(key, pa.int64()), pa.array(norm, pa.binary()), pa.array(n_rows, pa.int64()),
             pa.array([x and x[0] for x in best], pa.int64()), pa.array([x and x[1] for x in best], pa.int64())],
            ["doc_id", "n_points", "text_sha256", "entry", "key", "norm", "n_rows", "best_points", "best_doc"])


def directory(entries: DataFrame, capacity: int, step: int = 10) -> list[tuple[int, int]]:
    """Buckets (depth, leading bits) of an extendible-hash directory: none above capacity unless 60 bits don't part it.

    Counts are taken for up to ``step`` further bits of the overfull buckets only, fewer where these are many, so the driver sees
    about 2 ** 16 counts at a time; it never sees keys. Entries of one key lie in one bucket, however many they are.
    """
    buckets: list[tuple[int, int]] = []
    overfull: list[tuple[int, int]] | None = None
    depth = 0
    while True:
        if overfull is not None:
            step = max(1, min(step, 16 - len(overfull).bit_length(), 60 - depth))
        depth += step
        bits = F.shiftrightunsigned(F.col("key"), 64 - depth)
        rows = entries.select(bits.alias("cell"))
        if overfull is not None:
            near = entries.sparkSession.createDataFrame([(p,) for _, p in overfull], "parent long")
            rows = rows.join(near, F.shiftrightunsigned("cell", step) == F.col("parent"), "left_semi")
        count = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
        tree: dict[tuple[int, int], int] = {}
        for cell, n in count.items():
            for d in range(depth - step, depth + 1):
                k = (d, cell >> (depth - d))
                tree[k] = tree.get(k, 0) + n
        todo, overfull = [k for k in tree if k[0] == depth - step], []
        while todo:  # directory doubling: an overfull bucket of local depth d becomes two of depth d + 1
            d, prefix = todo.pop()
            if tree.get((d, prefix), 0) <= capacity or depth >= 60 and d == depth:
                buckets.append((d, prefix))
            elif d == depth:
                overfull.append((d, prefix))
            else:
                todo += [(d + 1, prefix * 2), (d + 1, prefix * 2 + 1)]
        if not overfull:
            return sorted(buckets, key=lambda x: (x[1] << (64 - x[0])))


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order -> entry, chain head; entries of one key are told apart by their bytes."""
    key, chain = None, []
    for b in batches:
        raw, off = utf8(b["norm"])
        raw = raw.tobytes()
        head = []
        for k, e, i, j in zip(b["key"].to_pylist(), b["entry"].to_pylist(), off[:-1].tolist(), off[1:].tolist()):
            if k != key:
                key, chain = k, []
            text = raw[i:j]
            found = next((h for h, t in chain if t == text), None)
            if found is None:
                chain.append((e, text))
                found = e
            head.append(found)
        yield pa.RecordBatch.from_arrays([b["entry"], pa.array(head, pa.int64()), b["n_rows"], b["best_points"], b["best_doc"]], ["entry", "head", "n_rows", "best_points", "best_doc"])


def exact_copies(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; texts are equal when they are without white space.

    The row of the most code points stays, among those the smallest doc_id. Null counts as empty, and all
    empty texts are one group; rows that repeat a doc_id and text can't be told apart and are all marked as kept when
    one is; a null doc_id yields to any other; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text_of()).cast("long").alias("n_points"), F.translate(text_of(), SPACES, "").alias("norm"))
    rows = cut(rows.mapInArrow(_entries, ENTRY), "copies-rows")
    heads = rows.where("n_rows is not null").select("entry", "key", "norm", "n_rows", "best_points", "best_doc")
    buckets = directory(heads.select("key"), capacity)
    starts = [(i, (p << (64 - d)) - (1 << 64 if p << (64 - d) >= 1 << 63 else 0)) for i, (d, p) in enumerate(buckets)]
    deep = max((d for d, _ in buckets), default=0)
    spark = docs.sparkSession
    tasks = max(1, min(len(buckets), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if deep <= 20:
        # The directory proper: one cell for each value of the leading bits, at most 2 ** 20 of them (16 MB), so it is broadcast.
        cell = {}
        for i, (d, p) in enumerate(buckets):
            for c in range(p << (deep - d), (p + 1) << (deep - d)):
                cell[c] = i
        table = spark.createDataFrame(list(cell.items()) or [(0, 0)], "cell long, bucket int")
        placed = heads.withColumn("cell", F.shiftrightunsigned("key", 64 - deep) if deep else F.lit(0).cast("long")).join(F.broadcast(table), "cell")
    else:
        bounds = np.array(sorted(s for _, s in starts), np.int64)
        placed = heads.withColumn("bucket", _bucket_of(bounds)("key"))
    owned = placed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key").select("entry", "key", "norm", "n_rows", "best_points", "best_doc")
    index = cut(owned.mapInArrow(_own, "entry long, head long, n_rows long, best_points long, best_doc long"), "copies-index")
    best = F.max(F.struct("best_points", F.col("best_doc").isNotNull().alias("known"), (-F.col("best_doc")).alias("doc")))
    groups = index.groupBy("head").agg(F.sum("n_rows").alias("group_size"), best.alias("best"))
    groups = index.select("entry", "head").join(groups, "head").select("entry", "group_size", (-F.col("best.doc")).alias("keep_id"), F.col("best.best_points").alias("keep_points"))
    return (rows.select("doc_id", "n_points", "text_sha256", "entry").join(groups, "entry")
            .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept"), "text_sha256"))


def _bucket_of(bounds: np.ndarray):
    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(bounds, key.to_numpy(), "right") - 1).astype(np.int32))
    return bucket

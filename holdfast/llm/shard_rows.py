"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows start in logical partitions (a hash of the row decides, so a lost task finds the same rows again). The
counts of rows that each partition sends to each shard follow a multivariate hypergeometric law given the exact
shard sizes; the matrix has one line per partition, not per row. Every partition permutes its rows, sends
the first ones to shard 0, the next to shard 1 and so on, and every shard permutes what it has received. The
text is read once and never shuffled: only (doc_id, size, crc) moves.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.text import text_of
from holdfast.session import cut


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement, for populations of any size."""
    if draws <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    # numpy stops at 1e9: invert the distribution over a window of sixteen deviations about the mean.
    total = good + bad
    mean = draws * good / total
    sd = math.sqrt(max(1.0, mean * (bad / total) * (total - draws) / max(1, total - 1)))
    lo, hi = max(0, draws - bad, int(mean - 16 * sd) - 2), min(draws, good, int(mean + 16 * sd) + 2)
    k = np.arange(lo, hi, dtype=float)
    step = np.log(good - k) - np.log(k + 1) + np.log(draws - k) - np.log(bad - draws + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(logp - logp.max())
    c = np.cumsum(p)
    return lo + int(np.searchsorted(c, rng.random() * c[-1], "right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows that partition i sends to shard s: every line sums to counts[i], every column to sizes[s]."""
    rng, left = np.random.default_rng(seed), list(sizes)
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for i, n in enumerate(counts):
        rest = sum(left)
        for s in range(len(left)):
            rest -= left[s]
            out[i, s] = k = hypergeometric(rng, left[s], rest, n)
            left[s] -= k
            n -= k
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 1, partition_rows: int = 1 << 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; shard sizes differ by one at most.

    A null text counts as empty (size 1, crc 0); repeated rows are rows of their own; a null doc_id is kept; an
    empty table gives an empty result; other columns are ignored. Size is the UTF-8 bytes plus one. ``slot``
    numbers the rows of a shard from 0 without gaps. Equal seeds give equal results. The driver sees one count
    per partition of about ``partition_rows`` rows.
    """
    spark = docs.sparkSession
    row = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    base = cut(docs.select("doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of()).cast("long").alias("text_crc32")), "shard-rows")
    n = base.count()
    parts = max(1, -(-n // partition_rows))
    base = base.select("*", F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(parts)).alias("part"))
    found = {r["part"]: r["count"] for r in base.groupBy("part").count().collect()}
    keys = sorted(found)
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication_matrix([found[k] for k in keys], sizes, seed)
    bounds = spark.createDataFrame([(k, [int(x) for x in np.cumsum(line)]) for k, line in zip(keys, matrix)], "part long, bounds array<long>")
    order = [F.xxhash64(F.lit(seed + 1), *row), *row]
    sent = (base.select("*", (F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).alias("place")).join(bounds, "part")
            .select(*row, F.size(F.filter("bounds", lambda b: b <= F.col("place"))).alias("shard")))
    # The second permutation orders a shard by fresh keys, in ranges of the key that fit one task each.
    ranges = max(1, -(-n // (shards * partition_rows)))
    fresh = F.xxhash64(F.lit(seed + 2), *row)
    span = F.least(F.lit(ranges - 1), F.floor((fresh / F.lit(2.0 ** 64) + 0.5) * ranges)).cast("long")
    sent = cut(sent.select("*", fresh.alias("fresh"), span.alias("span")), "shard-sent")
    heads = sent.groupBy("shard", "span").count().select("shard", "span", (F.sum("count").over(Window.partitionBy("shard").orderBy("span")) - F.col("count")).alias("head"))
    place = F.row_number().over(Window.partitionBy("shard", "span").orderBy("fresh", *row)) - 1
    return sent.select(*row, "shard", "span", place.alias("place")).join(heads, ["shard", "span"]).select("doc_id", "size", "text_crc32", "shard", (F.col("head") + F.col("place")).cast("long").alias("slot"))

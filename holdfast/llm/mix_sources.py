"""Mixing sources to target weights by the cube method of balanced sampling.

A source's target over its size is the mean number of times that its documents are taken: a whole part that
all get, and a fraction that is an inclusion probability. The flight moves three fractional probabilities at
a time along the null space of the two balancing constraints (number of documents, number of words) until one
hits 0 or 1, so both totals stay what they were; of a block of documents at most two are left over. The left ones of
many blocks meet in the next, coarser block, until each source has one; the landing settles its last two.
"""
from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.text import word_count
from holdfast.session import cut

WEIGHTS = (3, 1, 2)
EPS = 1e-9


def flight(p: list[float], size: list[int], seed: str, landing: bool) -> list[float]:
    """Probabilities after the flight over one block; with ``landing`` all are 0 or 1."""
    rng, p = random.Random(seed), list(p)
    rest = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
    rng.shuffle(rest)
    hand: list[int] = []
    while True:
        while len(hand) < 3 and rest:
            hand.append(rest.pop())
        if len(hand) < 2:
            break
        if len(hand) == 3:
            a, b, c = (size[i] for i in hand)
            u = (c - b, a - c, b - a)
            if not any(u):
                u = (1, -1, 0)
        elif size[hand[0]] == size[hand[1]]:
            u = (1, -1)
        else:
            break
        up = min((((1.0 - p[i]) / v) if v > 0 else (p[i] / -v)) for i, v in zip(hand, u) if v)
        down = min(((p[i] / v) if v > 0 else ((1.0 - p[i]) / -v)) for i, v in zip(hand, u) if v)
        move = up if rng.random() * (up + down) < down else -down
        for i, v in zip(hand, u):
            x = p[i] + move * v
            p[i] = 0.0 if x < EPS else 1.0 if x > 1.0 - EPS else x
        hand = [i for i in hand if 0.0 < p[i] < 1.0]
    if landing and hand:
        # The few left are set to the corner nearest to the words that they stand for.
        owed = sum(p[i] * size[i] for i in hand)
        best = min(range(1 << len(hand)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(hand) if m >> k & 1) - owed), m))
        for k, i in enumerate(hand):
            p[i] = float(best >> k & 1)
    return p


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n_docs, target: shares by weight, stopped at ``most`` times the size, excess reshared.

    The level L at which the shares of all sources that aren't stopped stand, target = min(most * size, L * weight),
    is found by one running sum over the sources in the order in which they fill up (one row per source).
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    t = by_source.select("*", w.alias("w"), (F.col("source_size") * F.lit(most)).alias("top"))
    t = t.select("*", (F.col("top") / F.col("w")).alias("fill"))
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    t = t.select("*", (left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).alias("level"))
    first = F.first(F.when(F.col("level") <= F.col("fill"), F.col("level")), ignorenulls=True).over(every)
    level = F.coalesce(first, F.lit(0.0))
    return t.select("source", "source_size", "n_docs", F.least(F.col("top"), level * F.col("w")).alias("target"))


def _fly(landing: bool, seed: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("row", "ascending")])
        name = f"{seed}|{group['source'][0]}|{group['level_block'][0]}|{landing}"
        p = flight(group["p"].to_pylist(), group["size"].to_pylist(), name, landing)
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))
    return run


def balanced_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 1, block_rows: int = 4096, fan_in: int = 1024, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row.

    Size is the number of words; ``copies`` is how often the mix holds the document, ``taken`` copies * size. A null or
    empty text has size 0 and takes nothing; a null source is a source of its own, last in order;
    repeated rows are rows of their own; an empty table gives an empty result; other columns are ignored. A source
    without words has target 0. Equal input and seed give equal results: all draws hang on hashes of the rows.
    ``row`` names a column with a long key of each row: the output then has it as ``row``, and texts enter the hashes,
    so rows without an id are dealt like others.
    """
    given = [F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("th")] if row is None else [F.col(row).alias("row"), F.xxhash64("text").alias("th")]
    base = cut(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), *given), "mix-sizes")
    goal = cut(targets(base, share, most, weights), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.select("*", rate.alias("rate"), F.floor(rate).alias("whole"))
    goal = goal.select("*", (F.col("rate") - F.col("whole")).alias("part"))
    named = base.join(goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    spread = F.xxhash64(F.lit(seed), "doc_id", "size", "th")  # a null adds nothing to a hash
    blocks = F.ceil(F.col("n_docs") / block_rows)
    level = named.select("row", "doc_id", "source", "size", "source_size", "target", "whole", F.col("part").alias("p"), spread.alias("key"), F.pmod(F.xxhash64(F.lit(seed + 1), spread), blocks).alias("level_block"))
    kept = "row long, doc_id long, source string, size long, source_size long, target double, whole long, p double, key long, level_block long"
    level = level.select("row", "doc_id", "source", "size", "source_size", F.col("target"), F.col("whole").cast("long").alias("whole"), "p", "key", "level_block").withColumn("doc_id", F.col("doc_id").cast("long"))
    open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    done = [level.where(~open_).withColumn("p", F.round("p"))]
    level = level.where(open_)
    widest = goal.agg(F.max(F.ceil(F.col("n_docs") / block_rows))).first()[0] or 1
    while True:
        last = widest <= 1
        level = cut(level.groupBy("source", "level_block").applyInArrow(_fly(last, seed), kept), "mix-flight")
        done.append(level.where(~open_))
        if last:
            break
        widest = -(-widest // fan_in)
        level = level.where(open_).withColumn("level_block", F.floor(F.col("level_block") / fan_in))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("whole") + F.col("p").cast("long")).cast("long")
    return out.select(*["row"][:row is not None], "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

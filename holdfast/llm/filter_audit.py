"""How filters of documents interact: what each removes in every order, from one relation of failing ids per filter.

The relations are written once, a row per failing document. A prefix of filters takes a document from the next filter's
relation exactly if the document is in the relation of one of them, so a left anti join leaves what the next filter removes
and a left semi join what was removed before. Prefixes with the same filters remove the same, whatever their order.
"""
from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.row_keys import keyed
from holdfast.llm.text import utf8
from holdfast.session import cut

#: Texts are split into words in pieces of about so many bytes.
PIECE = 1 << 22
_FLAGS = "few_words boolean, repetitive boolean, capitals boolean, symbols boolean, digest binary"
_SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#$%&*|"])
#: Failure conditions of the registered audit on the columns of ``described``: letter, then condition.
FILTERS = {"A": "few_words", "B": "repetitive", "C": "capitals", "D": "symbols", "E": "later_copy"}


def _words(raw: bytes) -> tuple[int, int]:
    """Words and distinct words between bytes of white space (those at which bytes are split)."""
    if len(raw) <= PIECE:
        w = raw.split()
        return len(w), len(set(w))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        w = raw[at:end].split()
        n += len(w)
        seen.update(w)
        at = end
    return n, len(seen)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = utf8(b["text"])
        out = []
        for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
            a = raw[i:j]
            text = a.tobytes()
            n, distinct = _words(text)
            capitals, points = int(((a >= 65) & (a <= 90)).sum()), int(((a & 0xC0) != 0x80).sum())
            out.append((n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * points, bool(_SYMBOLS[a].any()), hashlib.sha256(text).digest()))
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, [pa.bool_()] * 4 + [pa.binary()])]
        names = [f.split()[0] for f in _FLAGS.split(", ")]
        yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], b["part"], *columns], ["row", "doc_id", "part", *names])


def described(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, doc_id, part, good, toxic and one flag per failure condition of every document, texts read once and left behind.

    ``later_copy``: a row with the same text and a smaller doc_id exists anywhere. A null doc_id is neither smaller nor larger.
    """
    rows, key = keyed(docs)
    rows = rows.select(F.col(key).alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    rows = cut(rows.mapInArrow(_describe, f"row long, doc_id {rows.select('doc_id').dtypes[0][1]}, part string, {_FLAGS}"), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").select("digest", "first")
    rows = rows.join(first, "digest", "left").withColumn("later_copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marked.where("good = 1 OR toxic = 1"), "doc_id", "left")
    return rows.select("row", "doc_id", "part", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")), *FILTERS.values())


_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _report(names: list[str]):
    """Counts of a part by (filter, set of filters before it) as rows of every order and step."""
    bit = {f: 1 << i for i, f in enumerate(names)}
    orders = ["".join(o) for o in itertools.permutations(names)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, documents, cells in zip(frame["part"], frame["documents"], frame["cells"]):
                known = {(c["filter"], c["before"]): (c["removed"], c["redundant"], c["good_lost"], c["toxic_lost"]) for c in (cells if cells is not None else ())}
                rows, shapley = [], dict.fromkeys(names, 0)
                for order in orders:
                    kept, before = documents, 0
                    for step, f in enumerate(order, 1):
                        removed, redundant, good, toxic = known.get((bit[f], before), (0, 0, 0, 0))
                        kept, shapley[f] = kept - removed, shapley[f] + removed
                        unique = known.get((bit[f], sum(bit.values()) - bit[f]), (0,))[0]
                        rows.append([part, order, step, kept, removed, redundant, unique, good, toxic])
                        before += bit[f]
                yield pd.DataFrame([[*r, shapley[r[1][r[2] - 1]]] for r in rows], columns=[c.split()[0] for c in _OUT.split(", ")])
    return run


def audit(rows: DataFrame, filters: dict[str, str | Column]) -> DataFrame:
    """part, filter_order, step and counts, from rows (row, part, good, toxic, ...) and failure conditions by one-letter names.

    ``row`` is unique. Per part, order of all filters and step: kept (after it), removed (by it), redundant (failing it, removed
    before), unique_fails (failing it alone), good_lost and toxic_lost (removed by it), shapley (what its filter removes, summed over
    all orders). Every order of every part is reported, with zeros where nothing fails; no rows give no parts. The failing ids are
    shuffled once, by row, so no group is larger than the number of filters.
    """
    names = sorted(filters)
    rows = cut(rows, "audit-flags")
    fails = None
    for i, f in enumerate(names):
        condition = F.expr(filters[f]) if isinstance(filters[f], str) else filters[f]
        relation = cut(rows.where(condition).select("row", "part", "good", "toxic"), f"audit-fails-{f}").withColumn("filter", F.lit(1 << i))
        fails = relation if fails is None else fails.unionByName(relation)
    # Each failing id with all sets of other filters that may come before; both joins find it dealt by row already.
    dealt = fails.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")
    sets = F.array(*map(F.lit, range(1 << len(names))))
    tries = dealt.withColumn("before", F.explode(F.filter(sets, lambda s: s.bitwiseAND(F.col("filter")) == 0)))
    other = dealt.select(F.col("row").alias("other"), F.col("filter").alias("by"))
    earlier = (F.col("row") == F.col("other")) & (F.col("before").bitwiseAND(F.col("by")) != 0)
    cell = ["part", "filter", "before"]
    removed = tries.join(other, earlier, "left_anti").groupBy(*cell).agg(F.count("*").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"))
    redundant = tries.join(other, earlier, "left_semi").groupBy(*cell).agg(F.count("*").alias("redundant"))
    counts = removed.join(redundant, cell, "full").fillna(0)
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("filter", "before", "removed", "redundant", "good_lost", "toxic_lost")).alias("cells"))
    parts = rows.groupBy("part").agg(F.count("*").alias("documents"))
    return parts.join(cells, "part", "left").mapInPandas(_report(names), _OUT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five registered filters over whole texts, by source (null: empty).

    A null text counts as empty, and so fails A; ids may be null or repeated, every row counts; labels are looked up by doc_id, a
    null one has none, of several labels of an id any counts; an empty table gives no rows; other columns are ignored.
    """
    return audit(described(docs, labels), FILTERS)

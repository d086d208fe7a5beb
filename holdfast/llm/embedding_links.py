"""Near copies among embeddings: spherical k-means cells, blocked cosine products within cells, one kept per group.

Equal vectors of a label first become one with a count. Each label gets unit centroids, one for about ``cell_rows``
vectors, fitted on a bounded sample. A vector belongs to the cell of the largest cosine; it is also a guest in
every cell in which a partner could lie. With chord c = sqrt(2 - 2 * threshold) and centroids p (own) and q, a partner in q's cell
needs x.(p - q) <= c * |p - q|, so no link is lost. A cell's own vectors, in blocks, meet all its vectors, in blocks, as matrix
products in double precision; a product gives counts of links and a spanning forest of them, never the pairs.
Vectors without any cluster structure are guests nearly everywhere, and the work is then that of all pairs of a label.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import components
from holdfast.session import cut


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal lengths as rows of doubles."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that neither very large nor very small components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids (fewer if there are fewer distinct rows): each round assigns by cosine and takes mean directions."""
    rng = np.random.default_rng(seed)
    c = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def _fit(cell_rows: int, sample_rows: int, max_cells: int, seed: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep").slice(0, 2 * sample_rows)
        n = group["n_label"][0].as_py()
        k = max(1, min(-(-n // cell_rows), max_cells, len(group)))
        x = unit(matrix(group["vec"]))
        c = spherical_kmeans(x, k, seed)
        one = group.slice(0, 1)
        return pa.table({"label": pa.array([one["label"][0].as_py()] * len(c), pa.int64()), "dim": pa.array([one["dim"][0].as_py()] * len(c), pa.int32()), "cell": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(list(c), pa.list_(pa.float64()))})
    return run


def _assign(chord: float):
    def run(rows: pa.Table, cells: pa.Table) -> pa.Table:
        schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("own", pa.bool_()), ("rep", pa.int64()), ("mult", pa.int64()), ("vec", rows.schema.field("vec").type)])
        if not rows.num_rows:
            return schema.empty_table()
        cells = cells.sort_by("cell")
        x, c = unit(matrix(rows["vec"])), matrix(cells["centroid"])
        out = []
        between = np.sqrt(np.maximum(0.0, ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))) if len(c) <= 256 else None
        for i in range(0, len(x), 1024):
            dots = x[i:i + 1024] @ c.T
            own = dots.argmax(axis=1)
            gap = dots[np.arange(len(own)), own][:, None] - dots
            far = between[own] if between is not None else np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (c[own] @ c.T)))
            near = gap <= chord * far + 1e-9
            near[np.arange(len(own)), own] = True
            r, q = np.nonzero(near)
            take = pa.array(i + r)
            out.append(pa.table({"label": rows["label"].take(take), "dim": rows["dim"].take(take), "cell": pa.array(q.astype(np.int32)), "own": pa.array(q == own[r]), "rep": rows["rep"].take(take), "mult": rows["mult"].take(take), "vec": rows["vec"].take(take)}).cast(schema))
        return pa.concat_tables(out)
    return run


def forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows i and columns j of a block: pairs (i, j), at most rows + columns."""
    i, j = np.nonzero(hit)
    if len(i) <= sum(hit.shape):
        return list(zip(i.tolist(), j.tolist()))
    # Dense: breadth first, a whole level of rows or columns at a time.
    out = []
    rows_left, cols_left = hit.any(axis=1), hit.any(axis=0)
    while rows_left.any():
        level = np.array([rows_left.argmax()])
        rows_left[level] = False
        while len(level):
            part = hit[level] & cols_left
            cols = np.flatnonzero(part.any(axis=0))
            if not len(cols):
                break
            out += zip(level[part[:, cols].argmax(axis=0)].tolist(), cols.tolist())
            cols_left[cols] = False
            part = hit[:, cols] & rows_left[:, None]
            level = np.flatnonzero(part.any(axis=1))
            if not len(level):
                break
            out += zip(level.tolist(), cols[part[level].argmax(axis=1)].tolist())
            rows_left[level] = False
    return out


def _compare(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts as (own, null, links) and forest edges as (own, other, null) of one block of own vectors against one of all."""
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        a, b = unit(matrix(left["vec"])), unit(matrix(right["vec"]))
        ia, ib = left["rep"].to_numpy(), right["rep"].to_numpy()
        hit = (a @ b.T) >= threshold
        hit &= ia[:, None] != ib[None, :]
        n = hit @ right["mult"].to_numpy()
        keep = np.flatnonzero(n)
        edges = forest(hit)
        ea, eb = [int(ia[x]) for x, _ in edges], [int(ib[y]) for _, y in edges]
        return pa.table({"a": pa.array(ia[keep].tolist() + ea, pa.int64()), "b": pa.array([None] * len(keep) + eb, pa.int64()), "n": pa.array(n[keep].tolist() + [None] * len(ea), pa.int64())}, schema=schema)
    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.93, cell_rows: int = 2048, block_rows: int = 2048, sample_rows: int = 8192, max_cells: int = 1024, seed: int = 1) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; links lie within a label, cosine >= threshold in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components, and those of a null label, link with
    nothing and are groups of their own; vectors of different lengths don't link; equal vectors link with each
    other; rows that repeat a vec_id are vectors of their own; a null vec_id links and counts but can't name a group and is
    given its group's id, a number below -2**62 where no row of the group has one (ids of the input lie above that); an empty table gives an empty result; other columns are ignored. The centroids are
    fitted on about ``sample_rows`` vectors of a label; all else covers every vector.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vec"))
    kind = rows.schema["vec"].dataType.elementType.simpleString()
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    valid = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists("vec", lambda v: v.cast("double") != 0.0), F.lit(False))
    rows = rows.select("vec_id", "label", "vec", valid.alias("valid"))
    good = rows.where("valid").select("vec_id", "label", F.size("vec").alias("dim"), "vec")
    # Copies become one node, named by their smallest id; where that is null or other vectors have it too, by a hash below -2**62.
    reps = cut(good.groupBy("label", "dim", "vec").agg(F.count("*").alias("mult"), F.min("vec_id").alias("first_id")), "vectors")
    taken = cut(reps.groupBy("first_id").agg(F.count("*").alias("n")).where("n > 1 and first_id is not null").select("first_id", F.lit(True).alias("taken")), "taken-ids")
    named = F.col("first_id").isNotNull() & F.col("taken").isNull()
    reps = reps.join(taken, "first_id", "left").withColumn("rep", F.when(named, F.col("first_id")).otherwise(F.lit(-2 ** 62) - F.pmod(F.xxhash64("label", "dim", "vec"), F.lit(2 ** 62)))).drop("taken")
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n_label"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = reps.join(sizes, ["label", "dim"]).where(draw * F.col("n_label") < sample_rows).select("label", "dim", "rep", "vec", "n_label")
    cells = cut(sample.groupBy("label", "dim").applyInArrow(_fit(cell_rows, sample_rows, max_cells, seed), "label long, dim int, cell int, centroid array<double>"), "centroids")
    chunks = sizes.select("label", "dim", F.ceil(F.col("n_label") / 8192).alias("chunks"))
    spread = reps.join(chunks, ["label", "dim"]).select("label", "dim", F.pmod(F.xxhash64(F.lit(seed + 1), "rep"), "chunks").alias("chunk"), "rep", "mult", "vec")
    copies = cells.join(chunks, ["label", "dim"]).select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "cell", "centroid")
    key = ["label", "dim", "chunk"]
    chord = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    placed = spread.groupBy(key).cogroup(copies.groupBy(key)).applyInArrow(_assign(chord), f"label long, dim int, cell int, own boolean, rep long, mult long, vec array<{kind}>")
    placed = cut(placed, "cells")
    blocks = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count_if("own") / block_rows).alias("own_blocks"), F.ceil(F.count("*") / block_rows).alias("all_blocks"))
    placed = placed.join(blocks, ["label", "dim", "cell"]).withColumn("spread", F.xxhash64(F.lit(seed + 2), "rep"))
    cell = ["label", "dim", "cell", "i", "j"]
    left = placed.where("own").select("label", "dim", "cell", F.pmod("spread", "own_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), "rep", "vec")
    again = placed.select(*[F.col(c).alias(c) for c in placed.columns])  # columns of its own for the cogroup
    right = again.where("own_blocks > 0").select("label", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("i"), F.pmod("spread", "all_blocks").alias("j"), "rep", "mult", "vec")
    found = cut(left.groupBy(cell).cogroup(right.groupBy(cell)).applyInArrow(_compare(threshold), "a long, b long, n long"), "links")
    n_links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked"))
    groups = components(found.where("b is not null").select("a", "b"))
    known = reps.join(n_links, reps["rep"] == n_links["a"], "left").join(groups, reps["rep"] == groups["node"], "left")
    known = known.select("label", "dim", "vec", "first_id", (F.coalesce("linked", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group_"))
    # a group is named by its smallest id; only where a node's name is a hash can that differ from the smallest node
    hashed = known.where(F.col("group_") <= -2 ** 62).groupBy("group_").agg(F.min("first_id").alias("least"))
    known = known.join(hashed, "group_", "left").withColumn("component_id", F.coalesce("least", "group_")).drop("group_", "least", "first_id")
    out = rows.where("valid").withColumn("dim", F.size("vec")).join(known, ["label", "dim", "vec"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

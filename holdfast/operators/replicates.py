"""Cluster draws and the sums they weigh, as arrays and matrix products.

The multiplicities of one cluster over all replicates are one array, and what is known of a cluster is one list of cells, so a cluster
is one row on either side of the join. Each task turns its clusters into two matrices and gives out their product, the weighted sums
per key and replicate, which Spark adds up. Clusters times replicates are never laid out as joined rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

# Fixed value: clusters whose arrays are one matrix.
BLOCK = 512


def _counter(n_boot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches):
        place, held = {}, np.zeros((BLOCK, n_boot), np.int16)
        for batch in batches:
            codes, at = np.unique(batch["_i"].to_numpy(), return_inverse=True)
            for c in codes.tolist():
                place.setdefault(c, len(place))
            if len(place) > len(held):
                held = np.concatenate([held, np.zeros((max(len(held), len(place) - len(held)), n_boot), np.int16)])
            np.add.at(held, (np.array([place[c] for c in codes.tolist()], np.int64)[at], batch["b"].to_numpy()), np.int16(1))
        keys = np.fromiter(place, np.int64, len(place))
        for k in range(0, len(keys), BLOCK):
            block = held[k:min(k + BLOCK, len(keys))]
            ends = np.arange(len(block) + 1, dtype=np.int32) * n_boot
            yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + BLOCK]), pa.ListArray.from_arrays(ends, block.ravel())], ["_i", "weights"])
    return count


def counted(picks: DataFrame, n_boot: int) -> DataFrame:
    """Picks (b, _i) counted into one array over the replicates per ``_i``; all picks of one ``_i`` must lie in one partition."""
    return picks.select(F.col("_i").cast("bigint"), F.col("b").cast("int")).mapInArrow(_counter(n_boot), "_i bigint, weights array<smallint>")


def _codes(cells: pa.StructArray, keys: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """Number of the key of each cell, and the keys by number."""
    code, parts = np.zeros(len(cells), np.int64), []
    for k in keys:
        d = cells.field(k).dictionary_encode(null_encoding="encode")
        parts.append(d.dictionary.to_pylist())
        code = code * len(parts[-1]) + d.indices.to_numpy()
    kinds, at = np.unique(code, return_inverse=True)
    names = []
    for kind in kinds.tolist():
        name = []
        for p in reversed(parts):
            kind, j = divmod(kind, len(p))
            name.append(p[j])
        names.append(tuple(reversed(name)))
    return at, names


def _multiplier(keys: list[str], values: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def multiply(batches):
        total, types, width = {}, None, 2 * len(values) + 1
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(k, BLOCK)
                weights = batch["weights"].flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                cells = batch["cells"].flatten()
                types = types or [cells.field(c).type for c in keys]
                row = np.repeat(np.arange(batch.num_rows), batch["cells"].value_lengths().to_numpy())
                at, names = _codes(cells, keys)
                m = np.zeros((batch.num_rows, len(names), width))
                np.add.at(m, (row, at, 0), 1.0)
                for j, v in enumerate(values):
                    x = cells.field(v)
                    np.add.at(m, (row, at, 1 + 2 * j), x.fill_null(0.0).to_numpy(zero_copy_only=False))
                    if x.null_count:  # how many are missing, so that a sum of nothing stays null
                        np.add.at(m, (row, at, 2 + 2 * j), x.is_null().to_numpy(zero_copy_only=False).astype(float))
                used = np.flatnonzero(m.any(axis=(0, 1)))
                part = np.tensordot(m[:, :, used], weights, axes=(0, 0))
                for name, p in zip(names, part):
                    if name not in total:
                        total[name] = np.zeros((width, weights.shape[1]))
                    total[name][used] += p
        for name, t in total.items():
            b = np.flatnonzero(t[0] > 0)
            cols = [pa.array([x], type).take(pa.array(np.zeros(len(b), np.int64))) for x, type in zip(name, types)]
            sums = [pa.array(t[1 + 2 * j][b], mask=t[0][b] <= t[2 + 2 * j][b]) for j in range(len(values))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(b.astype(np.int32)), *sums], [*keys, "b", *values])
    return multiply


def product_sums(rows: DataFrame, draws: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of ``values``, weighted by the draws, per key and replicate, as doubles: (keys, b, values).

    ``rows`` have keys, source_cluster_id and values; keys must be few (systems, classes, steps), as each task holds their sums. A
    replicate that draws no row of a key has none; a sum over nulls alone is null.
    """
    cells = rows.groupBy("source_cluster_id").agg(F.collect_list(F.struct(*keys, *[F.col(v).cast("double").alias(v) for v in values])).alias("cells"))
    schema = StructType([*[rows.schema[k] for k in keys], StructField("b", IntegerType()), *[StructField(v, DoubleType()) for v in values]])
    part = draws.select("source_cluster_id", "weights").join(cells, "source_cluster_id").select("weights", "cells").mapInArrow(_multiplier(keys, values), schema)
    return part.groupBy(*keys, "b").agg(*[F.sum(v).alias(v) for v in values])

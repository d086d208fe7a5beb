"""The protocol scan over packed answers.

A scan multiplies clips by systems, protocols and grid points, but the metric family needs no more than tallies by class and
flip count. Spark deals out and joins the packed rows; each task reads its rows batch by batch at every protocol and gives out
the tallies, which Spark adds up. Neither the grid points nor the clip table of a protocol are laid out as rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.exprs import BOT, TOL
from holdfast.operators.protocol import Protocol, protocol_array, with_draw
from holdfast.operators.trajectory import PI, with_answers

# Fixed value: Arrow batches that are tallied together.
BATCHES = 8


def factor(p: Protocol, fine: float) -> int:
    """Stored steps in one step of a protocol, as ``trajectory.read_grid`` rounds it."""
    return int(np.rint(p.delta_s / fine))


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of answers as a matrix, which of its cells hold one, and the length of each list."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    row, col = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    pred, there = np.full((len(n), max(1, n.max(initial=0))), BOT, np.int32), np.zeros((len(n), max(1, n.max(initial=0))), bool)
    there[row, col] = flat.is_valid().to_numpy(zero_copy_only=False)
    pred[row, col] = flat.fill_null(BOT).to_numpy(zero_copy_only=False)
    return pred, there, n


def _tally(rows: pa.Table, protocols: list[Protocol], fine: float, offsets: tuple[float, ...]) -> list[dict[str, np.ndarray]]:
    def column(name):
        return rows[name].combine_chunks()
    system, y = column("system").to_numpy(), column("class_code").to_numpy()
    classes, y_code = np.unique(y, return_inverse=True)
    anchor, end, z = (column(c).to_numpy() for c in ("anchor_s", "duration_s", "_z"))
    tables = {}
    for k in {1} | {factor(p, fine) for p in protocols}:
        if f"cells{k}" in rows.column_names:
            tables[k] = (*_matrix(column(f"cells{k}")), column(f"j{k}").fill_null(0).to_numpy(zero_copy_only=False), column(f"cells{k}").is_valid().to_numpy(zero_copy_only=False))
    at, out = np.arange(len(y))[:, None], []
    for knobs in sorted({(p.eps_sys_s, p.eps_jit_sd_s, p.delta_s) for p in protocols}):
        eps, sd, delta = knobs
        mine = [(k, p) for k, p in enumerate(protocols) if (p.eps_sys_s, p.eps_jit_sd_s, p.delta_s) == knobs]
        start = np.minimum(np.maximum(anchor + eps + z * sd, 0.0), end)
        steps = {k: int(np.floor(p.h_s / delta + TOL)) for k, p in mine}
        j = np.arange(max(steps.values()) + 1)
        f = factor(mine[0][1], fine)
        pred, there = np.full((len(y), len(j)), BOT, np.int32), np.zeros((len(y), len(j)), bool)
        again = tables[f][4] if f > 1 and f in tables else np.zeros(len(y), bool)
        for k, chosen in ((f, again), (1, ~again)):  # a re-run is read in its own steps
            if chosen.any():
                made, held, n, first, _ = tables[k]
                place = np.rint((start[:, None] + j * delta - anchor[:, None]) / (k * fine)).astype(np.int64) - first[:, None]
                inside = (place >= 0) & (place < n[:, None]) & chosen[:, None]
                place = np.where(inside, place, 0)
                here = inside & held[at, place]
                there |= here
                pred = np.where(here, made[at, place], pred)
        wrong, moved = pred != y[:, None], pred[:, 1:] != pred[:, :-1]
        for k, p in mine:
            m = steps[k]
            use = end - start >= p.h_s - TOL
            last = np.where(wrong[:, :m + 1], j[:m + 1], -1).max(axis=1)[use]
            flips = moved[:, :m].sum(axis=1)[use]
            code = (system[use] * len(classes) + y_code[use]) * (m + 1) + flips
            delay = np.where(last < 0, 0.0, np.where(last >= m, m * delta, (last + 0.5) * delta))
            values = {"n_missing": (~there[:, :m + 1]).sum(axis=1)[use], "_delay": delay, "_end": last < m}
            n = np.bincount(code)
            kinds = np.flatnonzero(n)
            sums = {c: np.bincount(code, v)[kinds] for c, v in values.items()}
            for o in offsets:
                step = np.rint(o / delta)
                inside = o <= p.h_s + TOL and step <= m
                sums[f"_n{o:g}"] = n[kinds] * inside
                sums[f"_s{o:g}"] = np.bincount(code, last < step)[kinds] * inside
            pair, flip = np.divmod(kinds, m + 1)
            out.append({"protocol": np.full(len(kinds), k), "system": pair // len(classes), "class_code": classes[pair % len(classes)], "flips": flip, "n_clips": n[kinds], **sums})
    return out


def _reader(protocols: list[Protocol], fine: float, offsets: tuple[float, ...], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches):
        while some := [b for b in islice(batches, BATCHES) if b.num_rows]:
            parts = _tally(pa.Table.from_batches(some), protocols, fine, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[f.name] for p in parts])).cast(f.type) for f in schema], schema=schema)
    return read


def scan_tally(manifest: DataFrame, answers: DataFrame | None, systems: list[str], protocols: list[Protocol], fine: float, offsets: tuple[float, ...] = (1.0, 3.0)) -> DataFrame:
    """Sums of the metric family per (system, protocol, class, flip count): the tally of ``trajectory.clips_at`` over packed answers.

    Tasks give partial sums, so a group can have several rows. Without ``answers`` the manifest has them already, as in ``trajectory.read_grid``.
    """
    m = with_draw(manifest, protocols)
    p = m if answers is None else with_answers(m, answers, systems, spread=True)
    def preds(cells: Column) -> Column:
        return F.transform(cells, lambda c: c["pred"])
    cols = [(F.array_position(F.array(*[F.lit(s) for s in systems]), F.col("system_id")) - 1).alias("system"), "class_code", "anchor_s", "duration_s", "_z",
            F.col("j0").alias("j1"), preds(F.col("cells")).alias("cells1")]
    if "reruns" in p.columns:
        for k in sorted({factor(x, fine) for x in protocols} - {0, 1}):
            cols += [F.try_element_at("reruns", F.lit(k))["j0"].alias(f"j{k}"), preds(F.try_element_at("reruns", F.lit(k))["cells"]).alias(f"cells{k}")]
    names = ["n_missing", "_end", *[f"_n{o:g}" for o in offsets]]
    sums = ["_delay", *[f"_s{o:g}" for o in offsets]]
    schema = pa.schema([("protocol", pa.int32()), ("system", pa.int32()), ("class_code", pa.int32()), ("flips", pa.int64()), ("n_clips", pa.int64()),
                        *[(c, pa.int64()) for c in names], *[(c, pa.float64()) for c in sums]])
    ddl = "protocol int, system int, class_code int, flips bigint, n_clips bigint, " + ", ".join([f"{c} bigint" for c in names] + [f"{c} double" for c in sums])
    t = p.select(*cols).mapInArrow(_reader(protocols, fine, offsets, schema), ddl)
    t = t.withColumn("_p", F.get(protocol_array(protocols), F.col("protocol"))).withColumn("system_id", F.get(F.array(*[F.lit(s) for s in systems]), F.col("system")))
    return t.select("system_id", *[f"_p.{c}" for c in PI], "class_code", "flips", "n_clips", *names, *sums)

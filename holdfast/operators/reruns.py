"""Coarse re-runs: answer tables of stateful arms made again at a coarser output step.

An arm whose state depends on every step it has seen answers differently when it sees fewer, so its answers at a
coarse step can't be taken from its fine table. A re-run is named ``<system>__stride<k>``; its steps are counted in its own
unit, k fine steps. It is read in place of the system's own table, never as a system of its own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.exprs import BOT
from holdfast.operators.arms import argmax, commitment_score, dense_steps, ema, ema_fold, hysteresis, hysteresis_fold, long_steps, majority, patience, patience_fold, threshold_commit

SUFFIX = "__stride"


def base_and_stride(column: str = "system_id") -> tuple[Column, Column]:
    """The system that a re-run belongs to and its stride; null for other names."""
    pattern = rf"^(.+){SUFFIX}([0-9]+)$"
    hit = F.col(column).rlike(pattern)
    return F.when(hit, F.regexp_extract(column, pattern, 1)), F.when(hit, F.regexp_extract(column, pattern, 2).cast("int"))


def split_reruns(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of systems, and tables of re-runs with ``system_id`` set to their system and a ``stride``.

    A name with the suffix whose system isn't there is a system itself.
    """
    base, stride = base_and_stride()
    names = answers.select("system_id").distinct()
    known = names.select(F.col("system_id").alias("_base"))
    owned = names.select("system_id", base.alias("_base"), stride.alias("stride")).join(known, "_base")
    return answers.join(owned.select("system_id"), "system_id", "left_anti"), answers.join(owned, "system_id").drop("system_id").withColumnRenamed("_base", "system_id")


def rerun(parents: DataFrame, arms: list[tuple[str, str, str, float]], stride: int, j_min: int, j_max: int) -> DataFrame:
    """Answers of arms (system, parent, rule, value) on every ``stride``-th answer of their parents, step 0 kept.

    Rules: ema, hysteresis, majority, patience, msp, margin. Rows as in an answer table, named as re-runs.
    """
    coarse = parents.filter(F.pmod("j", F.lit(stride)) == 0).withColumn("j", (F.col("j") / stride).cast("int"))
    first, last = -(-j_min // stride), j_max // stride
    out = None
    for rule, value in sorted({a[2:] for a in arms}):
        mine = [a for a in arms if a[2:] == (rule, value)]
        dense = dense_steps(coarse.filter(F.col("system_id").isin([a[1] for a in mine])), first, last)
        if rule in ("msp", "margin"):
            made = threshold_commit(long_steps(dense), rule, value)
        elif rule == "ema":
            made = ema(dense, value)
        elif rule == "hysteresis":
            made = hysteresis(dense, value)
        elif rule in ("majority", "patience"):
            made = {"majority": majority, "patience": patience}[rule](long_steps(dense), int(value))
        else:
            raise ValueError(f"no rule {rule!r}")
        committed = F.col("committed") if "committed" in made.columns else F.lit(False)
        names = F.array(*[F.struct(F.lit(a[1]).alias("parent"), F.lit(f"{a[0]}{SUFFIX}{stride}").alias("name")) for a in mine])
        made = made.withColumn("_n", F.explode(F.filter(names, lambda n: n["parent"] == F.col("system_id"))))
        made = made.select(F.col("_n.name").alias("system_id"), "video_id", "j", F.col("pred").cast("int").alias("pred"), committed.alias("committed"))
        out = made if out is None else out.unionByName(made)
    return out


def rerun_cells(steps: Column, rule: str, value: float) -> Column:
    """The same for one parent's array of steps (j, probs), absent ones included: cells (pred, committed) in place, null without steps.

    Rules: ema, hysteresis, patience, msp, margin.
    """
    if rule in ("msp", "margin"):
        fires = F.filter(steps, lambda x: (x["j"] >= 0) & x["probs"].isNotNull() & (commitment_score(x["probs"], rule) >= value))
        start = F.transform(F.slice(fires, 1, 1), lambda x: F.struct(x["j"].alias("j"), argmax(x["probs"]).alias("label")))
        def cells(first):
            def cell(x):
                on = F.coalesce(x["j"] >= first["j"], F.lit(False))
                pred = F.when(on, first["label"]).when(x["j"] < 0, argmax(x["probs"])).otherwise(BOT)
                return F.struct(pred.cast("int").alias("pred"), on.alias("committed"))
            return F.transform(steps, cell)
        none = F.struct(F.lit(None).cast("int").alias("j"), F.lit(None).cast("int").alias("label"))
        # a list of one, so that the firing step is looked for once and not at every cell
        return F.get(F.transform(F.when(F.size(start) > 0, start).when(steps.isNotNull(), F.array(none)), cells), F.lit(0))
    if rule == "ema":
        made, pred = ema_fold(steps, value), lambda x: argmax(x["probs"])
    elif rule in ("hysteresis", "patience"):
        made, pred = {"hysteresis": hysteresis_fold, "patience": patience_fold}[rule](steps, int(value) if rule == "patience" else value), lambda x: x["pred"]
    else:
        raise ValueError(f"no rule {rule!r} on arrays")
    return F.transform(made, lambda x: F.struct(pred(x).cast("int").alias("pred"), F.lit(False).alias("committed")))


def attach(packed: DataFrame, packed_reruns: DataFrame) -> DataFrame:
    """Packed answers with a map ``reruns`` from stride to (j0, cells).

    A clip that a system's re-run doesn't hold reads as unanswered there: the map then has the stride with no cells, so that
    nothing falls back to the fine table in silence. ``packed_reruns`` has re-runs under their own names.
    """
    base, stride = base_and_stride()
    r = packed_reruns.select(base.alias("system_id"), "video_id", stride.alias("stride"), F.struct("j0", "cells").alias("table"))
    held = r.groupBy("system_id", "video_id").agg(F.map_from_entries(F.collect_list(F.struct("stride", "table"))).alias("_held"))
    strides = r.groupBy("system_id").agg(F.collect_set("stride").alias("_strides"))
    none = F.struct(F.lit(0).alias("j0"), F.filter(F.col("cells"), lambda c: F.lit(False)).alias("cells"))
    every = F.map_from_entries(F.transform("_strides", lambda k: F.struct(k, F.coalesce(F.try_element_at("_held", k), none))))
    out = packed.join(held, ["system_id", "video_id"], "full").join(strides, "system_id", "left")
    return out.withColumn("reruns", every).drop("_held", "_strides")


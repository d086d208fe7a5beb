"""Per-clip trajectories and the metrics read from them.

The answers of one (system, clip) are packed into an array over the stored steps. Its size is bounded
by the stored grid, and it turns every perturbed reading into an indexed lookup: a scan over many
protocols shuffles the answers once instead of once per protocol. All per-clip quantities then come from one
hash aggregation, because an answer is stable exactly when it lies beyond the last wrong step, so
neither a sort nor a running window is needed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.exprs import BOT, TOL, grid_steps, mean_ratio, stable_delay, trapezoid_weight
from holdfast.operators.protocol import Protocol, base_step, eligible, with_draw, with_protocols
from holdfast.operators.ranking import exact_quantiles

PI = ["pi_hash", "eps_sys_s", "eps_jit_sd_s", "delta_s", "h_s", "in_plaus"]
CLIP = ["source_cluster_id", "class_code", "post_anchor_length_s"]


def pack(answers: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per (system, clip): an array of answers from the first stored step ``j0`` to the last.

    Steps without an answer are null; a duplicate cell raises in the map that orders the answers.
    """
    value = F.struct("pred", "committed", *(extra or []))
    g = answers.groupBy("system_id", "video_id").agg(
        F.map_from_entries(F.collect_list(F.struct("j", value))).alias("_m"), F.min("j").alias("j0"), F.max("j").alias("_j1"))
    cells = F.transform(F.sequence("j0", "_j1"), lambda j: F.try_element_at(F.col("_m"), j))
    return g.select("system_id", "video_id", "j0", cells.alias("cells"))


def with_answers(manifest: DataFrame, answers: DataFrame, systems: list[str], extra: list[str] | None = None, spread: bool = False) -> DataFrame:
    """Every clip for every registered system; clips a system never answered keep an empty map.

    ``answers`` may be the long table or one already packed. ``spread`` fixes the number of partitions
    before many protocols multiply the rows; a sort-merge join uses that same partitioning.
    """
    m = manifest.withColumn("system_id", F.explode(F.array(*[F.lit(s) for s in systems])))
    if spread:
        n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        m = m.repartition(n, "system_id", "video_id")
    packed = answers if "cells" in answers.columns else pack(answers, extra)
    return m.join(packed, ["system_id", "video_id"], "left")


def stored(step: Column) -> Column:
    """Answer at a stored step of a packed row; null where there is none."""
    return F.get(F.col("cells"), step - F.col("j0"))


def read_grid(
    manifest: DataFrame,
    answers: DataFrame | None,
    systems: list[str],
    protocols: list[Protocol],
    fine: float,
    probs: bool = False,
    cohort: bool = True,
    span: float | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Answers of every system at every grid point of every protocol.

    A cell that was never stored reads as no answer, hence wrong; it stays in the denominator.
    ``span`` reads a fixed range instead of the horizon; ``cohort=False`` keeps short clips. Packed answers with ``reruns``
    (see ``operators.reruns``) serve coarse steps of stateful arms from them. ``keep`` names columns of the manifest to carry along.
    Without ``answers`` the manifest has them already: every clip once for every system, with its packed answers.
    """
    m = with_draw(manifest, protocols)
    packed = m if answers is None else with_answers(m, answers, systems, ["probs"] if probs else None, spread=len(protocols) > 2)
    p = with_protocols(packed, protocols)
    if cohort:
        p = p.filter(eligible(F.col("post_anchor_length_s_eff"), F.col("h_s")))
    p = p.withColumn("steps", grid_steps(F.col("h_s") if span is None else F.lit(float(span)), F.col("delta_s")))
    a_eff, a, d = F.col("anchor_s_eff"), F.col("anchor_s"), F.col("delta_s")
    unit = F.lit(fine)
    if "reruns" in p.columns:  # a coarse step of a stateful arm is read from its re-run, in the re-run's own steps
        factor = F.rint(d / F.lit(fine)).cast("int")
        p = p.withColumn("_use", F.when(factor > 1, F.try_element_at("reruns", factor)))
        p = p.withColumn("_unit", F.when(F.col("_use").isNotNull(), factor * F.lit(fine)).otherwise(F.lit(fine)))
        p = p.withColumns({"cells": F.coalesce("_use.cells", "cells"), "j0": F.coalesce("_use.j0", "j0")}).drop("_use", "reruns")
        unit = F.col("_unit")
    def no_answer(c):
        return F.coalesce(c, F.lit(BOT))

    term = no_answer(stored(base_step(a_eff, a, F.col("steps"), d, unit)).getField("pred"))
    first_after = F.floor((F.col("duration_s") - a) / fine + TOL).cast("int")
    p = p.withColumn("term", term).withColumn("full_step", first_after)
    p = p.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    cell = stored(base_step(a_eff, a, F.col("j"), d, unit))
    before = stored(base_step(a_eff, a, F.col("j") - 1, d, unit))
    p = p.withColumn("_c", cell).withColumn("prev", F.when(F.col("j") > 0, no_answer(before.getField("pred"))))
    cols = [
        "system_id", "video_id", *CLIP, *PI, "post_anchor_length_s_eff", "anchor_s", "duration_s", "steps", "j", "prev", "term",
        no_answer(F.col("_c.pred")).alias("pred"), F.col("_c.pred").isNotNull().alias("present"),
        F.coalesce(F.col("_c.committed"), F.lit(False)).alias("committed"),
    ]
    cols += keep or []
    if probs:
        cols.append(F.col("_c.probs").alias("probs"))
    return p.select(*cols).withColumn("ok", F.col("pred") == F.col("class_code"))


def clip_table(cells: DataFrame, keys: list[str] | None = None, delta: str = "delta_s", extra: list[Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per (system, protocol, clip) with everything the metrics need; areas are in the unit of the ``delta`` column.

    ``keep`` adds columns that are one per clip.
    """
    keys = ["system_id", *PI, "video_id", *CLIP, "post_anchor_length_s_eff", "steps"] if keys is None else keys
    keys = [*keys, *(keep or [])]
    j, ok = F.col("j"), F.col("ok")
    w = trapezoid_weight(j, F.col("steps"), F.col(delta))
    c = cells.groupBy(*keys).agg(
        *(extra or []),
        F.max(F.when(~ok, j)).alias("lw"),
        F.min(F.when(ok, j)).alias("fc"),
        F.max(F.when(ok, j)).alias("lc"),
        F.sum(F.when(ok, 1).otherwise(0)).alias("n_ok"),
        F.sum(F.when(~ok, w).otherwise(0.0)).alias("err_area"),
        F.sum(F.when(F.col("prev") != F.col("pred"), 1).otherwise(0)).alias("flips"),
        F.max(F.when(F.col("prev") != F.col("pred"), j)).alias("last_flip_j"),
        F.max(F.when(F.col("pred") != F.col("term"), j)).alias("last_off_term"),
        F.sum(F.when((F.col("pred") == F.col("term")) == ok, 1).otherwise(0)).alias("n_agree"),
        F.max(F.when(j == 0, ok.cast("int"))).alias("anchor_ok"),
        F.max("term").alias("end_pred"),
        F.sum(F.when(~F.col("present"), 1).otherwise(0)).alias("n_missing"),
        F.min(F.when(F.col("committed"), j)).alias("commit_j"),
        F.min_by("pred", F.when(F.col("committed"), j)).alias("commit_pred"),
    )
    lw = F.coalesce(F.col("lw"), F.lit(-1))
    return (
        c.withColumn("lw", lw)
        .withColumn("delay", stable_delay(F.col("lw"), F.col("steps"), F.col(delta)))
        .withColumn("retr_area", F.col("delay") - F.col("err_area"))
        .withColumn("end_ok", (F.col("lw") < F.col("steps")).cast("int"))
        .withColumn("onset_j", F.when(F.col("lw") < F.col("steps"), F.col("lw") + 1))
        .withColumn("first_term_j", F.coalesce(F.col("last_off_term"), F.lit(-1)) + 1)
        .withColumn("cwc", F.coalesce(F.col("n_ok") < F.col("lc") - F.col("fc") + 1, F.lit(False)))
    )


def clips_at(manifest: DataFrame, answers: DataFrame, systems: list[str], protocols: list[Protocol], fine: float) -> DataFrame:
    return clip_table(read_grid(manifest, answers, systems, protocols, fine))


def stable_curve(clips: DataFrame, by: list[str]) -> DataFrame:
    """Share of clips stably correct from each grid point on.

    Clips are first counted by their last wrong step, at most ``steps + 2`` rows per group, so the
    curve is a running sum over a tiny table however many clips there are.
    """
    tally = clips.groupBy(*by, "steps", "delta_s", "lw").agg(F.count(F.lit(1)).alias("_n"))
    total = tally.groupBy(*by, "steps", "delta_s").agg(
        F.sum("_n").alias("n_clips"), F.collect_list(F.struct("lw", "_n")).alias("_t"))
    rows = total.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    below = F.aggregate(
        F.filter("_t", lambda t: t["lw"] < F.col("j")), F.lit(0).cast("bigint"), lambda s, t: s + t["_n"])
    return rows.select(*by, "delta_s", "steps", "j", "n_clips", (below / F.col("n_clips")).alias("s_h"))


def delay_summary(clips: DataFrame, by: list[str]) -> DataFrame:
    """Micro and macro delay and its components; macro averages over the classes present."""
    per_class = clips.groupBy(*by, "class_code").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("delay", "err_area", "retr_area", "end_ok")],
    )
    out = [F.sum("n").alias("n_clips")]
    for c in ("delay", "err_area", "retr_area", "end_ok"):
        out += [(F.sum(c) / F.sum("n")).alias(c), F.avg(F.col(c) / F.col("n")).alias(f"{c}_macro")]
    return per_class.groupBy(*by).agg(*out)


def frozen_family(clips: DataFrame, by: list[str], offsets: tuple[float, ...] = (1.0, 3.0)) -> DataFrame:
    """The metric family of the scan: one tally by class and flip count.

    Classes are those of the clips, however many. An offset is read at the nearest grid point; one outside the window is null.
    """
    sums = {"n_clips": F.count(F.lit(1)), "n_missing": F.sum("n_missing"), "_delay": F.sum("delay"), "_end": F.sum("end_ok")}
    for k in offsets:
        step = F.rint(F.lit(k) / F.col("delta_s"))
        inside = (F.lit(k) <= F.col("h_s") + TOL) & (step <= F.col("steps"))
        sums[f"_s{k:g}"] = F.sum(F.when(inside, (F.col("lw") < step).cast("double")))
        sums[f"_n{k:g}"] = F.count(F.when(inside, 1))
    return family_of_tally(clips.groupBy(*by, "class_code", "flips").agg(*[c.alias(n) for n, c in sums.items()]), by, offsets)


def merged(tally: DataFrame, by: list[str]) -> DataFrame:
    """Add up the partial sums of a tally."""
    keys = [*by, "class_code", "flips"]
    return tally.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in tally.columns if c not in keys])


def family_of_tally(tally: DataFrame, by: list[str], offsets: tuple[float, ...] = (1.0, 3.0)) -> DataFrame:
    """The metric family from sums per class and flip count, one row each; what made the tally is read once."""
    same = Window.partitionBy(*by, "class_code")
    t = tally.withColumn("_a", F.sum("_end").over(same) / F.sum("n_clips").over(same))
    t = t.withColumn("_a", F.when(F.row_number().over(same.orderBy("flips")) == 1, F.col("_a")))  # once per class
    return t.groupBy(*by).agg(
        F.sum("n_clips").alias("n_clips"), F.sum("n_missing").alias("n_missing"), (F.sum("_delay") / F.sum("n_clips")).alias("rmscd"),
        *[mean_ratio(F.sum(f"_s{k:g}"), F.sum(f"_n{k:g}")).alias(f"s_at_{k:g}") for k in offsets],
        F.percentile("flips", F.lit(0.5), F.col("n_clips")).alias("median_flips"), F.avg("_a").alias("end_macro_acc"))


FAMILY = ["rmscd", "s_at_1", "s_at_3", "end_macro_acc", "median_flips"]


def long_metrics(family: DataFrame, keys: list[str]) -> DataFrame:
    """The family as rows (metric, value)."""
    return family.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in FAMILY])).alias("_m")
    ).select(*keys, "_m.metric", "_m.value")


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Micro and equal-class-mass weighted means; macro is null when a class has no weight."""
    per_class = df.groupBy(*by, "class_code").agg(
        F.sum(F.col(weight)).alias("_w"), F.sum(F.col(weight) * F.col(value)).alias("_wx"))
    return per_class.groupBy(*by).agg(
        mean_ratio(F.sum("_wx"), F.sum("_w")).alias(f"{out}_micro"),
        F.when(F.min("_w") > 0, F.avg(mean_ratio(F.col("_wx"), F.col("_w")))).alias(f"{out}_macro"),
    )


def irregular_weights(times: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid weights on a strictly increasing grid of any spacing (one bounded grid per group)."""
    w = Window.partitionBy(*by).orderBy("t")
    left = F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0.0))
    right = F.coalesce(F.lead("t").over(w) - F.col("t"), F.lit(0.0))
    return times.withColumn("w", (left + right) / 2)


def own_end(cells: DataFrame, last_step: Column) -> DataFrame:
    """Delay on each clip's own grid ``0..last_step``; later points are ignored."""
    c = cells.withColumn("last_j", last_step).filter(F.col("j") <= F.col("last_j"))
    agg = c.groupBy("system_id", "video_id", "class_code", "post_anchor_length_s", "delta_s", "last_j").agg(
        F.coalesce(F.max(F.when(~F.col("ok"), F.col("j"))), F.lit(-1)).alias("lw"),
        F.sum(F.when(~F.col("present"), 1).otherwise(0)).alias("n_missing"),
        F.count(F.lit(1)).alias("n_cells"),
    )
    return (
        agg.withColumn("delay", stable_delay(F.col("lw"), F.col("last_j"), F.col("delta_s")))
        .withColumn("end_ok", (F.col("lw") < F.col("last_j")).cast("int"))
        .withColumn("onset_j", F.when(F.col("lw") < F.col("last_j"), F.col("lw") + 1))
    )


def delay_bounds(cells: DataFrame, observed: Column) -> DataFrame:
    """Sharp bounds on the delay when only ``observed`` cells are known.

    The upper end takes every unobserved cell as wrong, the lower end as right; no answer is an
    observed error.
    """
    steps, d = F.col("steps"), F.col("delta_s")
    lo = F.coalesce(F.max(F.when(observed & ~F.col("ok"), F.col("j"))), F.lit(-1))
    hi = F.coalesce(F.max(F.when(~observed | ~F.col("ok"), F.col("j"))), F.lit(-1))
    fine = F.coalesce(F.max(F.when(~F.col("ok"), F.col("j"))), F.lit(-1))
    g = cells.groupBy("system_id", "video_id", "class_code", "steps", "delta_s", "stride", "phase").agg(
        lo.alias("_lo"), hi.alias("_hi"), fine.alias("_fine"))
    return g.select(
        "system_id", "video_id", "class_code", "stride", "phase",
        stable_delay(F.col("_lo"), steps, d).alias("lower"), stable_delay(F.col("_hi"), steps, d).alias("upper"),
        stable_delay(F.col("_fine"), steps, d).alias("fine"),
    )


def full_clip_answers(manifest: DataFrame, answers: DataFrame, systems: list[str], fine: float, j_min: int, j_max: int) -> DataFrame:
    """Answer of the longest stored prefix that still ends inside the clip."""
    step = F.floor((F.col("duration_s") - F.col("anchor_s")) / fine + TOL).cast("int")
    step = F.greatest(F.least(step, F.lit(j_max)), F.lit(j_min))
    p = with_answers(manifest, answers, systems).withColumn("full_j", step)
    return p.withColumn("full_pred", F.coalesce(stored(F.col("full_j")).getField("pred"), F.lit(BOT))).drop("cells", "j0")


def per_clip_end(open_cells: DataFrame, h: float) -> DataFrame:
    """The convention that lets points past a clip's own end pass: stable from here to its own end."""
    off = F.col("j") * F.col("delta_s")
    inside = off <= F.col("post_anchor_length_s") + TOL
    g = open_cells.groupBy("system_id", "video_id", "post_anchor_length_s", "delta_s", "steps").agg(
        F.coalesce(F.max(F.when(inside & ~F.col("ok"), F.col("j"))), F.lit(-1)).alias("lw"))
    t = F.when(F.col("lw") < F.col("steps"), (F.col("lw") + 1) * F.col("delta_s"))
    return g.withColumn("time_to_stable", t).withColumn(
        "t_cens", F.coalesce(F.least(F.col("time_to_stable"), F.lit(float(h))), F.lit(float(h))))


def dynamic_curve(open_cells: DataFrame, h: float) -> DataFrame:
    """Stable and instantaneous accuracy on the risk set of clips that still run at each point."""
    off = F.col("j") * F.col("delta_s")
    alive = off <= F.col("post_anchor_length_s") + TOL
    judged = alive & (off <= h + TOL)
    last_bad = F.coalesce(F.max(F.when(judged & ~F.col("ok"), F.col("j"))), F.lit(-1))
    lw = open_cells.groupBy("system_id", "video_id").agg(
        last_bad.alias("lw"), F.collect_list(F.struct(
            "j", F.col("ok").alias("ok"), alias_bool(alive, "alive"), alias_bool(judged, "judged"), "delta_s")).alias("pts"))
    c = lw.select("system_id", "lw", F.explode("pts").alias("p")).select("system_id", "lw", "p.*")
    return c.groupBy("system_id", "j", "delta_s").agg(
        F.sum(F.col("judged").cast("bigint")).alias("risk_set"),
        F.sum(F.col("alive").cast("bigint")).alias("alive"),
        mean_ratio(F.sum((F.col("judged") & (F.col("j") > F.col("lw"))).cast("int")), F.sum(F.col("judged").cast("int"))).alias("s_dyn"),
        mean_ratio(F.sum((F.col("alive") & F.col("ok")).cast("int")), F.sum(F.col("alive").cast("int"))).alias("acc"),
    )


def alias_bool(c: Column, name: str) -> Column:
    return F.coalesce(c, F.lit(False)).alias(name)


def length_gap(df: DataFrame, value: str, length: str, out: str) -> DataFrame:
    """Mean of the long half minus mean of the short half, split at the median length; null below 4 clips.

    The cuts are one row per registered system, so sending them to all tasks is bounded.
    """
    ok = df.filter(F.col(value).isNotNull() & F.col(length).isNotNull())
    cut = exact_quantiles(ok, ["system_id"], length, [0.5]).select("system_id", F.get("q", F.lit(0)).alias("_cut"), F.col("n").alias("_n"))
    long_, short = F.col(length) > F.col("_cut"), F.col(length) <= F.col("_cut")
    return ok.join(F.broadcast(cut), "system_id").groupBy("system_id").agg(
        F.when(F.max("_n") >= 4, F.avg(F.when(long_, F.col(value))) - F.avg(F.when(short, F.col(value)))).alias(out))

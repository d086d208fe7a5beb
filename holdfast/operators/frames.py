"""Reading answers on an axis of whole frames.

Nothing on this axis is rounded but the jitter, once, before any lookup: knobs are whole frames, horizons are whole multiples of the
step, cohorts compare integers without slack, and a request between two stored steps has no answer (wrong, counted) instead of
a neighbour's. Areas are in frames; divided by the common horizon they have no unit.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.exprs import BOT, gaussian, mean_ratio
from holdfast.operators.protocol import JIT_SEED
from holdfast.operators.trajectory import clip_table, stored, with_answers

PI_F = ["pi_hash", "eps_sys_f", "eps_jit_sd_f", "delta_f", "h_f"]
SECONDS = ("anchor_s", "duration_s", "post_anchor_length_s")


@dataclass(frozen=True)
class FrameProtocol:
    """Anchor shift, spread of the anchor jitter, step and horizon, in frames. The vocabulary is part of its identity."""
    eps_sys_f: int = 0
    eps_jit_sd_f: float = 0.0
    delta_f: int = 1
    h_f: int = 1
    jit_seed: int = JIT_SEED
    vocabulary: str = ""

    def __post_init__(self):
        for name, least in (("eps_sys_f", None), ("delta_f", 1), ("h_f", 1), ("jit_seed", None)):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or (least is not None and v < least):
                raise ValueError(f"{name} must be a whole number{'' if least is None else f' of at least {least}'}, not {v!r}")
        if not 0 <= self.eps_jit_sd_f < float("inf"):
            raise ValueError("eps_jit_sd_f must be finite and not negative")
        if self.h_f % self.delta_f:
            raise ValueError(f"the horizon of {self.h_f} frames is no multiple of the step of {self.delta_f}")

    @property
    def pi_hash(self) -> str:
        text = f"frame|{self.eps_sys_f}|{round(self.eps_jit_sd_f, 9):.9f}|{self.delta_f}|{self.h_f}|{self.jit_seed}|{self.vocabulary}"
        return hashlib.sha256(text.encode()).hexdigest()[:12]


def perturb_frames(manifest: DataFrame, protocols: list[FrameProtocol]) -> DataFrame:
    """Manifest rows times protocols with jitter (raw and in whole frames), effective anchor, whether it was clipped, effective length.

    The jitter depends on (seed, clip) alone: the same in every cohort and row order.
    """
    carried = sorted(set(SECONDS) & set(manifest.columns))
    if carried:
        raise ValueError(f"a manifest in frames must not carry seconds columns: {carried}")
    if len({p.jit_seed for p in protocols}) > 1:
        raise ValueError("read protocols of different jitter seeds separately")
    arr = F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(PI_F, (p.pi_hash, p.eps_sys_f, float(p.eps_jit_sd_f), p.delta_f, p.h_f)))) for p in protocols])
    z = gaussian(F.concat_ws("|", F.lit(str(protocols[0].jit_seed)), F.col("video_id"))) if any(p.eps_jit_sd_f for p in protocols) else F.lit(0.0)
    m = manifest.withColumn("_z", z).withColumn("_p", F.explode(arr)).select("*", "_p.*").drop("_p")
    m = m.withColumn("jitter_raw_f", F.col("_z") * F.col("eps_jit_sd_f")).drop("_z")
    m = m.withColumn("jitter_f", F.rint("jitter_raw_f").cast("long"))
    wanted = F.col("anchor_frame") + F.col("eps_sys_f") + F.col("jitter_f")
    m = m.withColumn("_wanted", wanted).withColumn("anchor_frame_eff", F.least(F.greatest("_wanted", "first_frame"), "last_frame"))
    return m.withColumn("anchor_clipped", F.col("anchor_frame_eff") != F.col("_wanted")).withColumn("post_anchor_frames_eff", F.col("last_frame") - F.col("anchor_frame_eff")).drop("_wanted")


def eligible_frames(length: Column, h: Column | int) -> Column:
    return length >= (h if isinstance(h, Column) else F.lit(h))


def stored_step(offset: Column, delta: int) -> Column:
    """Stored step at an offset in frames by exact division; null between two steps."""
    return F.when(F.pmod(offset, F.lit(delta)) == 0, F.floor(offset / F.lit(delta)).cast("int"))


def frame_prefixes(perturbed: DataFrame, grid_max: int, horizons: list[int], delta_fine: int) -> DataFrame:
    """A row per (clip, grid point): offset, last frame read, stored step (null off the grid), eligibility, whether it reads the future."""
    p = perturbed.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor(F.lit(grid_max) / F.col("delta_f")).cast("int"))))
    p = p.withColumn("offset_f", F.col("j") * F.col("delta_f")).withColumn("end_frame", F.col("anchor_frame_eff") + F.col("offset_f"))
    p = p.withColumn("base_j", stored_step(F.col("end_frame") - F.col("anchor_frame"), delta_fine)).withColumn("past_end", F.col("end_frame") > F.col("last_frame"))
    for h in horizons:
        p = p.withColumn(f"eligible_h{h}", eligible_frames(F.col("post_anchor_frames_eff"), h))
    return p


def coarsen(answers: DataFrame, stored_delta: int, delta: int) -> DataFrame:
    """Every k-th stored answer, step 0 kept, as a table of the coarser step; refused where the steps don't divide."""
    if delta < stored_delta or delta % stored_delta:
        raise ValueError(f"a step of {delta} frames is no multiple of the stored one of {stored_delta}")
    k = delta // stored_delta
    return answers.filter(F.pmod("j", F.lit(k)) == 0).withColumn("j", (F.col("j") / k).cast("int"))


def read_frames(manifest: DataFrame, answers: DataFrame, systems: list[str], protocols: list[FrameProtocol], stored_delta: int) -> DataFrame:
    """Answers of every system at every grid point of every protocol on its cohort, looked up by absolute frame.

    Off the stored grid, and where nothing was stored, there is no answer: wrong and in the denominator. ``tail_pred`` is the answer of
    the longest stored prefix inside the clip, by the unshifted anchor.
    """
    p = perturb_frames(with_answers(manifest, answers, systems, spread=len(protocols) > 2), protocols)
    p = p.filter(eligible_frames(F.col("post_anchor_frames_eff"), F.col("h_f")))
    p = p.withColumn("steps", (F.col("h_f") / F.col("delta_f")).cast("int"))

    def pred(offset):
        return F.coalesce(stored(stored_step(offset, stored_delta)).getField("pred"), F.lit(BOT))

    def at(j):
        return F.col("anchor_frame_eff") + j * F.col("delta_f") - F.col("anchor_frame")
    last = F.least(F.floor((F.col("last_frame") - F.col("anchor_frame")) / stored_delta).cast("int"), F.col("j0") + F.size("cells") - 1)
    p = p.withColumn("tail_pred", F.coalesce(stored(F.greatest(last, F.col("j0"))).getField("pred"), F.lit(BOT))).withColumn("term", pred(at(F.col("steps"))))
    p = p.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    step = stored_step(at(F.col("j")), stored_delta)
    p = p.withColumn("_c", stored(step)).withColumn("prev", F.when(F.col("j") > 0, pred(at(F.col("j") - 1))))
    return p.select(
        "system_id", "video_id", "source_cluster_id", "class_code", *PI_F, "post_anchor_frames_eff", "steps", "j", "prev", "term", "tail_pred",
        F.coalesce("_c.pred", F.lit(BOT)).alias("pred"), F.col("_c.pred").isNotNull().alias("present"), step.isNull().alias("off_grid"),
        F.coalesce("_c.committed", F.lit(False)).alias("committed"),
    ).withColumn("ok", F.col("pred") == F.col("class_code"))


def frame_clips(cells: DataFrame) -> DataFrame:
    """A row per (system, protocol, clip), as on the axis of seconds; delays are in frames."""
    keys = ["system_id", *PI_F, "video_id", "source_cluster_id", "class_code", "post_anchor_frames_eff", "steps", "tail_pred"]
    extra = [F.sum(F.col("off_grid").cast("bigint")).alias("n_off_grid")]
    return clip_table(cells, keys, "delta_f", extra)


def frame_curve_at(clips: DataFrame, by: list[str], offsets: list[int]) -> DataFrame:
    """Share of clips stably correct from an offset in frames on; null outside the window and between grid points."""
    c = clips.withColumn("offset_f", F.explode(F.array(*map(F.lit, offsets))))
    return c.groupBy(*by, "offset_f").agg(F.avg(_stable_at(F.col("offset_f"))).alias("s_h"))


def _stable_at(k: Column) -> Column:
    on = (k >= 0) & (k <= F.col("h_f")) & (F.pmod(k, F.col("delta_f")) == 0)
    return F.when(on, (F.col("lw") < k / F.col("delta_f")).cast("double"))


def frame_record(clips: DataFrame, by: list[str], offsets: list[int]) -> DataFrame:
    """The whole record of an evaluation in frames: family, companions, commitment, missing reads.

    ``offsets`` are those registered for the track; there is no default. Commitment is the first committed grid point, a clip that
    never commits counts with the horizon.
    """
    if not offsets:
        raise ValueError("register the read-out offsets on development data first")
    tau = F.coalesce(F.col("commit_j") * F.col("delta_f"), F.col("h_f")).cast("double")
    has = F.col("commit_j").isNotNull()
    tail_ok = (F.col("tail_pred") == F.col("class_code")).cast("double")
    named = {f"s_at_{k}f": _stable_at(F.lit(k)) for k in offsets}
    per_class = clips.groupBy(*by, "class_code").agg(F.avg("delay").alias("d"), F.avg("end_ok").alias("e"), F.avg(tail_ok).alias("t"))
    macro = per_class.groupBy(*by).agg(F.avg("d").alias("rmscd_frames_macro"), F.avg("e").alias("end_macro_acc"), F.avg("t").alias("tail_macro_acc"))
    whole = clips.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_clips"), F.sum("n_missing").alias("n_missing"), F.sum("n_off_grid").alias("n_off_grid"), F.sum(F.col("steps") + 1).alias("n_cells"),
        F.avg("delay").alias("rmscd_frames"), F.avg(F.col("delay") / F.col("h_f")).alias("rmscd_norm"), F.avg("end_ok").alias("end_micro_acc"),
        F.percentile("flips", F.lit(0.5)).alias("median_flips"), F.avg("flips").alias("mean_flips"), F.avg((F.col("flips") > 0).cast("int")).alias("flip_rate"),
        F.avg(has.cast("int")).alias("commit_rate"), F.avg(tau).alias("tau_c_mean_frames"), F.percentile(tau, F.lit(0.5)).alias("tau_c_median_frames"),
        F.avg(F.when(has, (F.col("commit_pred") != F.col("class_code")).cast("int"))).alias("commit_error"),
        F.max("h_f").alias("_h"), *[F.avg(c).alias(n) for n, c in named.items()])
    out = whole.join(macro, by).withColumn("rmscd_norm_macro", F.col("rmscd_frames_macro") / F.col("_h")).drop("_h")
    return out.withColumn("missing_rate", mean_ratio(F.col("n_missing"), F.col("n_cells")))

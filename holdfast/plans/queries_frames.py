"""The axis of whole frames end to end (survey C4, C5, C8, C11, D12-D14)."""
from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions.exprs import r6
from holdfast.operators import frames as X
from holdfast.operators.frames import FrameProtocol
from holdfast.plans.common import manifest, packed
from holdfast.plans.oracle import fgrid, with_base
from holdfast.plans.registry import query
from holdfast.plans.stages import stage
from holdfast.sources import derive as D

STORED_F = int(D.DELTA * D.FPS)
REF = FrameProtocol(0, 0.0, 10, 60)
# On the grid, shifted by whole steps, between steps, with jitter, at a coarse and at a step finer than the stored one.
PROTOCOLS = [REF, FrameProtocol(10, 0.0, 10, 40), FrameProtocol(-7, 0.0, 10, 60), FrameProtocol(0, 4.0, 20, 40), FrameProtocol(5, 2.5, 5, 40)]
OFFSETS = [20, 30, 60]
_ONE = FrameProtocol(-3, 6.0, 10, 40)


def frame_manifest(spark, sf, split=None):
    """The manifest in whole frames, without any column in seconds."""
    m = manifest(spark, sf, split)
    a, last = ((F.col(c) * F.col("fps")).cast("bigint") for c in ("anchor_s", "duration_s"))
    return m.select("video_id", "source_cluster_id", "class_code", "split", F.lit(0).cast("bigint").alias("first_frame"), a.alias("anchor_frame"), last.alias("last_frame"), (last - a).alias("post_anchor_frames"))


def clips(spark, sf):
    return stage(spark, sf, "frame_clips", lambda: X.frame_clips(X.read_frames(frame_manifest(spark, sf, "test"), packed(spark, sf), D.SYSTEM_IDS, PROTOCOLS, STORED_F)))


@query("c04_frame_jitter", with_base(fgrid([_ONE], split=None)) + " SELECT video_id, round(jitter_raw_f,6) AS jitter_raw_f, jitter_f FROM fe")
def c04_frames(spark, sf):
    """The jitter is rounded to whole frames before anything is looked up; both are reported."""
    return X.perturb_frames(frame_manifest(spark, sf), [_ONE]).select("video_id", r6("jitter_raw_f").alias("jitter_raw_f"), "jitter_f")


@query("c05_frame_anchor", with_base(fgrid([_ONE], split=None)) + " SELECT video_id, anchor_frame_eff, leff AS post_anchor_frames_eff, (anchor_frame_eff<>wanted) AS anchor_clipped FROM fe")
def c05_frames(spark, sf):
    return X.perturb_frames(frame_manifest(spark, sf), [_ONE]).select("video_id", "anchor_frame_eff", "post_anchor_frames_eff", "anchor_clipped")


@query("c08_frame_prefixes", with_base(fgrid([_ONE], split=None)) + ", pj AS (SELECT *, unnest(range(0,9))::INT AS j FROM fe) SELECT video_id, j, j*delta_f AS offset_f, anchor_frame_eff+j*delta_f AS end_frame, CASE WHEN (anchor_frame_eff+j*delta_f-anchor_frame)%10=0 THEN ((anchor_frame_eff+j*delta_f-anchor_frame)//10)::INT END AS base_j, (anchor_frame_eff+j*delta_f>last_frame) AS past_end, (leff>=40) AS eligible_h40, (leff>=60) AS eligible_h60 FROM pj")
def c08_frames(spark, sf):
    p = X.frame_prefixes(X.perturb_frames(frame_manifest(spark, sf), [_ONE]), 80, [40, 60], STORED_F)
    return p.select("video_id", "j", F.col("offset_f").cast("bigint").alias("offset_f"), "end_frame", "base_j", "past_end", "eligible_h40", "eligible_h60")


@query("c11_frame_lookup", with_base(fgrid(PROTOCOLS)) + " SELECT pi_hash, system_id, count(*)::BIGINT AS n_cells, sum((NOT present)::INT)::BIGINT AS n_missing, sum(off_grid::INT)::BIGINT AS n_off_grid, sum(ok::INT)::BIGINT AS n_correct, sum(pred)::BIGINT AS pred_sum FROM fx GROUP BY ALL")
def c11_frames(spark, sf):
    """Lookup by absolute frame: what isn't a stored step is missing, never a neighbour's answer."""
    c = X.read_frames(frame_manifest(spark, sf, "test"), packed(spark, sf), D.SYSTEM_IDS, PROTOCOLS, STORED_F)
    def one(x):
        return F.sum(x.cast("bigint"))
    return c.groupBy("pi_hash", "system_id").agg(F.count(F.lit(1)).alias("n_cells"), one(~F.col("present")).alias("n_missing"), one(F.col("off_grid")).alias("n_off_grid"), one(F.col("ok")).alias("n_correct"), F.sum("pred").alias("pred_sum"))


@query("d12_frame_offsets", with_base(fgrid(PROTOCOLS)) + ", q(k) AS (VALUES (0),(15),(20),(30),(60),(100)) SELECT c.pi_hash, c.system_id, k::INT AS offset_f, round(avg(CASE WHEN k<=c.h_f AND k%c.delta_f=0 THEN s.stable END),6) AS s_h FROM fc c CROSS JOIN q LEFT JOIN fs s ON s.pi_hash=c.pi_hash AND s.system_id=c.system_id AND s.video_id=c.video_id AND s.j*c.delta_f=k GROUP BY ALL")
def d12_frames(spark, sf):
    """The curve at offsets in frames; one that isn't a grid point is null, not its neighbour."""
    s = X.frame_curve_at(clips(spark, sf), ["pi_hash", "system_id"], [0, 15, 20, 30, 60, 100])
    return s.select("pi_hash", "system_id", "offset_f", r6("s_h").alias("s_h"))


_AT = ", ".join(f"round(avg(CASE WHEN {k}<=c.h_f AND {k}%c.delta_f=0 THEN (SELECT stable FROM fs s WHERE s.pi_hash=c.pi_hash AND s.system_id=c.system_id AND s.video_id=c.video_id AND s.j*c.delta_f={k}) END),6) AS s_at_{k}f" for k in OFFSETS)
_TAU = "coalesce(cj*delta_f, h_f)::DOUBLE"
_RECORD = f"""count(*)::BIGINT AS n_clips, sum(missing)::BIGINT AS n_missing, sum(off)::BIGINT AS n_off_grid, round(sum(missing)::DOUBLE/sum(cells),6) AS missing_rate, round(avg(delay),6) AS rmscd_frames, round(any_value(m.d),6) AS rmscd_frames_macro, round(avg(delay/h_f),6) AS rmscd_norm, round(any_value(m.d)/any_value(h_f),6) AS rmscd_norm_macro,
 round(any_value(m.e),6) AS end_macro_acc, round(avg(endok),6) AS end_micro_acc, round(any_value(m.t),6) AS tail_macro_acc, median(flips)::DOUBLE AS median_flips, round(avg(flips),6) AS mean_flips, round(avg((flips>0)::INT),6) AS flip_rate,
 round(avg((cj IS NOT NULL)::INT),6) AS commit_rate, round(avg({_TAU}),6) AS tau_c_mean_frames, round(median({_TAU}),6) AS tau_c_median_frames, round(avg(CASE WHEN cj IS NOT NULL THEN (cp<>y)::INT END),6) AS commit_error, {_AT} FROM fc c JOIN fm m USING (pi_hash, system_id) GROUP BY pi_hash, system_id"""
_ROUND = ["missing_rate", "rmscd_frames", "rmscd_frames_macro", "rmscd_norm", "rmscd_norm_macro", "end_macro_acc", "end_micro_acc", "tail_macro_acc", "mean_flips", "flip_rate", "commit_rate", "tau_c_mean_frames", "tau_c_median_frames", "commit_error", *[f"s_at_{k}f" for k in OFFSETS]]


@query("d14_frame_record", with_base(fgrid(PROTOCOLS)) + f" SELECT pi_hash, system_id, {_RECORD}")
def d14_frames(spark, sf):
    """The evaluation record in frames: perturb, fix the cohort, lay the grid, look up by absolute frame, compute."""
    r = X.frame_record(clips(spark, sf), ["pi_hash", "system_id"], OFFSETS)
    return r.select("pi_hash", "system_id", "n_clips", "n_missing", "n_off_grid", "median_flips", *[r6(c).alias(c) for c in _ROUND])


_FAMILY = ["rmscd_frames", "rmscd_norm", "end_macro_acc", *[f"s_at_{k}f" for k in OFFSETS]]


@query("d13_frame_family", with_base(fgrid([REF])) + f" SELECT system_id, rmscd_frames, rmscd_norm, end_macro_acc, median_flips, s_at_20f, s_at_30f, s_at_60f FROM (SELECT system_id, {_RECORD})")
def d13_frames(spark, sf):
    """The frozen family in frames at the reference protocol, at registered offsets."""
    r = X.frame_record(clips(spark, sf).filter(F.col("pi_hash") == REF.pi_hash), ["pi_hash", "system_id"], OFFSETS)
    return r.select("system_id", "median_flips", *[r6(c).alias(c) for c in _FAMILY])

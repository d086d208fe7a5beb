"""Reading protocols: the reference point, the scan grids, anchor perturbation, cohorts and prefixes."""
from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.exprs import TOL, gaussian, grid_steps

# Levels of the four knobs; the plausible subset; the seed of the anchor jitter.
EPS_LEVELS = [-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0]
JIT_LEVELS = [0.0, 0.1, 0.25, 0.5]
DELTA_LEVELS = [0.25, 0.5, 1.0]
H_LEVELS = [2.0, 3.0, 4.0]
PLAUS_EPS = [-0.25, 0.0, 0.25]
PLAUS_JIT = [0.0, 0.1, 0.25]
PLAUS_DELTA = [0.5, 1.0]
JIT_SEED = 20260903

KNOBS = ("eps_sys_s", "eps_jit_sd_s", "delta_s", "h_s")


@dataclass(frozen=True)
class Protocol:
    """One way to read the answers: anchor shift, anchor jitter, step and horizon."""
    eps_sys_s: float = 0.0
    eps_jit_sd_s: float = 0.0
    delta_s: float = 0.5
    h_s: float = 3.0
    jit_seed: int = JIT_SEED

    @property
    def canonical(self) -> str:
        knobs = "|".join(f"{round(getattr(self, k), 9) + 0.0:.9f}" for k in KNOBS)
        return f"{knobs}|{self.jit_seed}"

    @property
    def pi_hash(self) -> str:
        return hashlib.sha256(self.canonical.encode()).hexdigest()[:12]

    @property
    def in_plaus(self) -> bool:
        return (self.eps_sys_s in PLAUS_EPS and self.eps_jit_sd_s in PLAUS_JIT
                and self.delta_s in PLAUS_DELTA and self.h_s in H_LEVELS)


def reference(h: float = 3.0) -> Protocol:
    return Protocol(h_s=h)


def _unique(protocols: list[Protocol]) -> list[Protocol]:
    return list({p.pi_hash: p for p in protocols}.values())


def axis_scan(h: float = 3.0) -> list[Protocol]:
    """One knob at a time away from the reference, reference first."""
    ref = reference(h)
    levels = zip(KNOBS, (EPS_LEVELS, JIT_LEVELS, DELTA_LEVELS, H_LEVELS))
    return _unique([ref, *[replace(ref, **{k: v}) for k, vs in levels for v in vs]])


def plausible_grid() -> list[Protocol]:
    """Full product of the plausible levels."""
    return _unique([reference(), *[
        Protocol(*p) for p in itertools.product(PLAUS_EPS, PLAUS_JIT, PLAUS_DELTA, H_LEVELS)]])


def neighbour_grid(h: float = 3.0) -> list[Protocol]:
    """Product of each knob's reference level and its immediate neighbours."""
    ref = reference(h)
    near = []
    for knob, levels in zip(KNOBS, (EPS_LEVELS, JIT_LEVELS, DELTA_LEVELS, H_LEVELS)):
        i = levels.index(getattr(ref, knob))
        near.append(levels[max(0, i - 1): i + 2])
    return [Protocol(*p) for p in itertools.product(*near)]


def protocol_array(protocols: list[Protocol]) -> Column:
    """The protocols as one literal array, so that a scan needs no join to reach them."""
    return F.array(*[
        F.struct(
            F.lit(p.pi_hash).alias("pi_hash"), F.lit(p.eps_sys_s).alias("eps_sys_s"),
            F.lit(p.eps_jit_sd_s).alias("eps_jit_sd_s"), F.lit(p.delta_s).alias("delta_s"),
            F.lit(p.h_s).alias("h_s"), F.lit(p.jit_seed).alias("jit_seed"), F.lit(p.in_plaus).alias("in_plaus"),
        ) for p in protocols
    ])


def digest(*knobs: Column, seed: Column) -> Column:
    """Protocol identity as a column expression; equals ``Protocol.pi_hash``."""
    parts = [F.format_string("%.9f", F.round(k, 9) + F.lit(0.0)) for k in knobs]
    return F.substring(F.sha2(F.concat_ws("|", *parts, seed.cast("string")), 256), 1, 12)


def with_draw(manifest: DataFrame, protocols: list[Protocol]) -> DataFrame:
    """Add each clip's standard normal draw, once per clip and before anything multiplies the rows.

    All protocols of one reading share the seed of the jitter.
    """
    seeds = {p.jit_seed for p in protocols}
    if len(seeds) > 1:
        raise ValueError("read protocols of different jitter seeds separately")
    if all(p.eps_jit_sd_s <= 0 for p in protocols):
        return manifest.withColumn("_z", F.lit(0.0))
    return manifest.withColumn("_z", gaussian(F.concat_ws("|", F.lit(str(seeds.pop())), F.col("video_id"))))


def with_protocols(manifest: DataFrame, protocols: list[Protocol]) -> DataFrame:
    """Manifest rows times protocols, each with its perturbed anchor and remaining length.

    The shift is common to all clips, the jitter is drawn per clip from (seed, clip) alone; anchors
    are clipped to the recording. The cohort is later taken from the perturbed length.
    """
    m = manifest if "_z" in manifest.columns else with_draw(manifest, protocols)
    m = m.withColumn("_p", F.explode(protocol_array(protocols))).select("*", "_p.*")
    m = m.withColumn("jitter_s", F.col("_z") * F.col("eps_jit_sd_s")).drop("_p", "_z")
    wanted = F.col("anchor_s") + F.col("eps_sys_s") + F.col("jitter_s")
    m = m.withColumn("_wanted", wanted).withColumn("anchor_s_eff", F.least(F.greatest("_wanted", F.lit(0.0)), "duration_s"))
    return (
        m.withColumn("anchor_clipped", F.abs(F.col("anchor_s_eff") - F.col("_wanted")) > TOL)
        .withColumn("post_anchor_length_s_eff", F.col("duration_s") - F.col("anchor_s_eff"))
        .drop("_wanted")
    )


def eligible(length: Column, h: Column | float) -> Column:
    """Membership in the fixed cohort; the slack keeps it a property of the clip, not of rounding."""
    return length >= (h if isinstance(h, Column) else F.lit(float(h))) - TOL


def base_step(anchor_eff: Column, anchor: Column, j: Column, delta: Column, fine: Column | float) -> Column:
    """Stored step read by grid point ``j``: absolute end time over the stored step, half to even."""
    return F.rint((anchor_eff + j * delta - anchor) / (fine if isinstance(fine, Column) else F.lit(fine))).cast("int")


def prefixes(perturbed: DataFrame, grid_max: float, horizons: list[float], fine: float) -> DataFrame:
    """One row per (clip, grid point) with end time, end frame, stored step and eligibility."""
    j = F.explode(F.sequence(F.lit(0), grid_steps(F.lit(grid_max), F.col("delta_s"))))
    p = perturbed.withColumn("j", j)
    p = p.withColumn("offset_s", F.col("j") * F.col("delta_s")).withColumn("end_s", F.col("anchor_s_eff") + F.col("offset_s"))
    p = p.withColumn("end_frame", F.floor(F.col("end_s") * F.col("fps") + TOL))
    p = p.withColumn("base_j", base_step(F.col("anchor_s_eff"), F.col("anchor_s"), F.col("j"), F.col("delta_s"), fine))
    for h in horizons:
        p = p.withColumn(f"eligible_h{h:g}".replace(".", "_"), eligible(F.col("post_anchor_length_s_eff"), h))
    return p

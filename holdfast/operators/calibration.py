"""What a protocol change does to a metric: offsets, rank preservation, resolution, verdicts.

Input is the scan table, one row per (system, protocol, metric); all joins here are on it, so their
size is systems times protocols whatever the number of clips.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.exprs import mean_ratio, sign_tol
from holdfast.operators.protocol import KNOBS
from holdfast.operators.trajectory import PI

# Metrics whose scale is set by the horizon; rank-preservation floor; flip tolerance.
H_SCALED = ["rmscd"]
R0 = 0.9
FLIP_TOL = 0.05


def shifts(scan: DataFrame, ref: str) -> DataFrame:
    """Value at each protocol minus value at the reference, per system and metric."""
    base = scan.filter(F.col("pi_hash") == ref).select("system_id", "metric", F.col("value").alias("value0"), F.col("h_s").alias("h0"))
    return scan.join(base, ["system_id", "metric"]).withColumn("shift", F.col("value") - F.col("value0"))


def offsets_and_spread(scan: DataFrame, ref: str) -> DataFrame:
    """Mean, spread and largest size of the shifts across systems."""
    return shifts(scan, ref).groupBy(*PI, "metric").agg(
        F.count("shift").alias("n_systems"), F.avg("shift").alias("b_m"), F.stddev_samp("shift").alias("s_m"), F.max(F.abs("shift")).alias("max_abs_shift"))


def pair_differences(scan: DataFrame, pairs: DataFrame) -> DataFrame:
    """Difference of every listed pair at every protocol, noise below 1e-12 read as zero; an undefined value leaves a null."""
    on = [k for k in ("metric",) if k in pairs.columns]
    a = scan.select("system_id", *PI, "metric", F.col("value").alias("va")).withColumnRenamed("system_id", "system_a")
    b = scan.select("pi_hash", "metric", F.col("system_id").alias("system_b"), F.col("value").alias("vb"))
    p = pairs.join(a, [*on, "system_a"]).join(b, ["pi_hash", "metric", "system_b"], "left")
    return p.withColumn("d", F.round(F.col("va") - F.col("vb"), 12))


def with_reference(diffs: DataFrame, ref: str) -> DataFrame:
    keys = ["metric", "system_a", "system_b"]
    d0 = diffs.filter(F.col("pi_hash") == ref).select(*keys, F.col("d").alias("d0"))
    return diffs.join(d0, keys)


def rank_preservation(scan: DataFrame, pairs: DataFrame, ref: str) -> DataFrame:
    """Share of reference-ordered pairs that keep their order; a new tie or undefined value counts as lost."""
    d = with_reference(pair_differences(scan, pairs), ref)
    s0, s = F.coalesce(sign_tol(F.col("d0"), 0.0), F.lit(0)), F.coalesce(sign_tol(F.col("d"), 0.0), F.lit(0))
    return d.groupBy(*PI, "metric").agg(
        F.sum((s0 != 0).cast("bigint")).alias("n_pairs"), mean_ratio(F.sum(((s0 != 0) & (s == s0)).cast("int")), F.sum((s0 != 0).cast("int"))).alias("r_m"))


def resolution(scan: DataFrame, ref: str, plaus_only: bool = True, q: float = 0.95) -> DataFrame:
    """Smallest reportable difference: a high quantile of the shift sizes over systems and protocols.

    For metrics scaled by the horizon only protocols of the reference horizon enter; the spread along
    the horizon is reported beside it.
    """
    s = shifts(scan, ref).filter(F.col("pi_hash") != ref)
    same_h = F.abs(F.col("h_s") - F.col("h0")) < 1e-9
    use = (F.lit(not plaus_only) | F.col("in_plaus")) & (~F.col("metric").isin(H_SCALED) | same_h)
    size = F.abs("shift")
    return s.groupBy("metric").agg(
        F.percentile(F.when(use, size), F.lit(q)).alias("mrd"), F.count(F.when(use, size)).alias("n"),
        F.percentile(F.when(~same_h, size), F.lit(q)).alias("h_axis_shift"))


def eps_max(r_table: DataFrame, ref: str, r0: float = R0) -> DataFrame:
    """Largest anchor shift reached before rank preservation first falls below ``r0``, other knobs at the reference."""
    at = r_table.filter(F.col("pi_hash") == ref).select("metric", F.col("delta_s").alias("_d"), F.col("h_s").alias("_h"))
    ax = r_table.join(at, "metric").filter(
        (F.col("eps_jit_sd_s") == 0) & (F.abs(F.col("delta_s") - F.col("_d")) < 1e-9) & (F.abs(F.col("h_s") - F.col("_h")) < 1e-9))
    g = ax.groupBy("metric", F.abs("eps_sys_s").alias("a")).agg(F.min("r_m").alias("r"), F.max(F.col("r_m").isNull().cast("int")).alias("_u"))
    ok = ((F.col("_u") == 0) & (F.col("r") >= r0 - 1e-9)).cast("int")
    walk = Window.partitionBy("metric").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("held", F.min(ok).over(walk))
    return g.groupBy("metric").agg(
        F.coalesce(F.max(F.when(F.col("held") == 1, F.col("a"))), F.lit(0.0)).alias("eps_max"), (F.min("held") == 1).alias("saturated"), F.count(F.lit(1)).alias("n_points"))


def delta_star(flips: DataFrame, by: list[str]) -> DataFrame:
    """Coarsest step from which every finer step agrees with the finest within 5%; input (by, delta_s, value)."""
    g = Window.partitionBy(*by)
    whole = g.orderBy("delta_s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f = flips.withColumn("_finest", F.first("value").over(whole))
    f = f.withColumn("_ok", (F.abs(F.col("value") - F.col("_finest")) <= FLIP_TOL * F.greatest(F.abs("_finest"), F.lit(1.0))).cast("int"))
    finer = g.orderBy("delta_s").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("_held", F.min("_ok").over(finer)).withColumn("_next", F.lead("value").over(g.orderBy(F.col("delta_s").desc())))
    r = f.groupBy(*by).agg(
        F.max(F.when(F.col("_held") == 1, F.col("delta_s"))).alias("delta_star"), F.min("delta_s").alias("_min"), F.count(F.lit(1)).alias("n_points"),
        F.min(F.coalesce(F.col("value") <= F.col("_next") + 1e-9, F.lit(True)).cast("int")).alias("_mono"))
    return r.select(*by, "delta_star", ((F.col("n_points") > 1) & (F.col("delta_star") != F.col("_min"))).alias("saturated"), "n_points", (F.col("_mono") == 1).alias("monotone"))


def verdict(min_r: Column, mrd: Column, ruler: Column, r0: float = R0) -> Column:
    """Can readings of this metric be pooled across plausible protocols?"""
    return (F.when(min_r.isNull(), "undetermined").when(min_r < r0, "not comparable").when(ruler.isNull(), "undetermined (no ruler)")
            .when(ruler == 0, "normalize (ruler is zero)").when(mrd < ruler, "poolable").otherwise("normalize"))


def calibration(scan: DataFrame, pairs: DataFrame, rulers: DataFrame, ref: str) -> DataFrame:
    """One row per metric: largest offset and spread, least rank preservation, resolution, verdict."""
    bs = offsets_and_spread(scan, ref).filter("in_plaus").groupBy("metric").agg(F.max(F.abs("b_m")).alias("max_b"), F.max("s_m").alias("max_s"))
    rt = rank_preservation(scan, pairs, ref)
    r = rt.groupBy("metric").agg(F.min(F.when(F.col("in_plaus"), F.col("r_m"))).alias("min_r"), F.min("r_m").alias("min_r_full"), F.max("n_pairs").alias("n_pairs"))
    m = resolution(scan, ref).select("metric", "mrd")
    t = bs.join(r, "metric", "left").join(m, "metric", "left").join(rulers.select("metric", "ruler"), "metric", "left").join(eps_max(rt, ref).select("metric", "eps_max"), "metric", "left")
    return t.withColumn("verdict", verdict(F.col("min_r"), F.col("mrd"), F.col("ruler")))


def on_axis(scan: DataFrame, ref, knob: str) -> DataFrame:
    """Protocols that differ from the reference in one knob at most."""
    keep = F.lit(True)
    for k in KNOBS:
        if k != knob:
            keep = keep & (F.abs(F.col(k) - getattr(ref, k)) <= 1e-9)
    return scan.filter(keep)


def reversals(diffs: DataFrame, ref: str) -> DataFrame:
    """Pairs that turn round or tie at each protocol, among those ordered at the reference."""
    d = with_reference(diffs, ref).filter(F.col("d0").isNotNull() & F.col("d").isNotNull() & (F.col("d0") != 0))
    rev, tie = F.col("d0") * F.col("d") < 0, F.col("d") == 0
    return d.groupBy("metric", "pi_hash").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(rev.cast("bigint")).alias("reversals"), F.sum(tie.cast("bigint")).alias("new_ties"))


def unique_reversals(diffs: DataFrame, ref: str) -> DataFrame:
    d = with_reference(diffs, ref).filter(F.col("d0").isNotNull() & F.col("d").isNotNull() & (F.col("d0") != 0))
    per = d.groupBy("metric", "system_a", "system_b").agg(F.sum((F.col("d0") * F.col("d") < 0).cast("bigint")).alias("r"), F.sum((F.col("d") == 0).cast("bigint")).alias("t"))
    return per.groupBy("metric").agg(
        F.sum("r").alias("reversal_events"), F.sum((F.col("r") > 0).cast("bigint")).alias("unique_reversed_pairs"),
        F.sum("t").alias("tie_events"), F.sum((F.col("t") > 0).cast("bigint")).alias("unique_tied_pairs"))


def metric_gate(cal: DataFrame, r0: float = R0) -> DataFrame:
    """Rank arm and resolution arm; null is undefined, not failed, and flips never carry the gate."""
    out = F.col("metric") == "median_flips"
    degenerate = F.col("ruler").isNull() | (F.col("ruler") <= 0)
    return cal.select(
        "metric", F.when(~out, F.col("min_r") < r0).alias("rank_arm"), F.when(~out & ~degenerate, F.col("mrd") >= F.col("ruler")).alias("mrd_arm"),
        degenerate.alias("ruler_degenerate"))


def consequence(own: Column, own_lo: Column, own_hi: Column, fixed: Column, fixed_lo: Column, fixed_hi: Column, mrd: Column, ruler: Column) -> Column:
    """Does the own-end convention read a length gap that the fixed cohort does not? Null when any part is undefined."""
    known = own.isNotNull() & own_lo.isNotNull() & own_hi.isNotNull() & fixed.isNotNull() & fixed_lo.isNotNull() & fixed_hi.isNotNull() & mrd.isNotNull() & ruler.isNotNull()
    sees = ((own_lo > 0) | (own_hi < 0)) & (F.abs(own) > mrd)
    quiet = ((fixed_lo <= 0) & (fixed_hi >= 0)) | (F.abs(fixed) < ruler)
    return F.when(known, sees & quiet)


def negative_control(own: Column, fixed: Column, ruler: Column) -> Column:
    """A control that is always right must show no gap beyond the ruler under either convention."""
    return F.coalesce((ruler >= 0) & (F.abs(own) <= ruler) & (F.abs(fixed) <= ruler), F.lit(False))


def group_gate(rows: DataFrame) -> DataFrame:
    """Verdict over groups of systems, one row per role: n, n_consequence, n_undefined and the verdict of all.

    rows: system_id, role, consequence, control_passed (null but for controls that are always right). The computation is valid only if
    there is such a control and none reacts. With any undefined random control or real system the gate is undefined; it passes if every random
    control and at least half of the real systems show the consequence. The table has one row per system.
    """
    g = rows.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("consequence"), 1)).alias("n_consequence"), F.count(F.when(F.col("consequence").isNull(), 1)).alias("n_undefined"),
        F.count("control_passed").alias("_c"), F.count(F.when(~F.col("control_passed"), 1)).alias("_f"))

    def of(role, c):
        return F.coalesce(F.sum(F.when(F.col("role") == role, F.col(c))), F.lit(0))
    v = g.agg(F.sum("_c").alias("_c"), F.sum("_f").alias("_f"), *[of(r, c).alias(f"{r}_{c}") for r in ("random_block", "real") for c in ("n", "n_consequence", "n_undefined")])
    valid = (F.col("_c") > 0) & (F.col("_f") == 0)
    known = (F.col("random_block_n_undefined") == 0) & (F.col("real_n_undefined") == 0)
    passed = (F.col("random_block_n") > 0) & (F.col("random_block_n_consequence") == F.col("random_block_n")) & (F.col("real_n") > 0) & (2 * F.col("real_n_consequence") >= F.col("real_n"))
    status = F.when(~valid, "invalid_computation").when(~known, "undefined").when(passed, "passed").otherwise("failed")
    v = v.select(valid.alias("computation_valid"), status.alias("status"), F.when(valid & known, passed).alias("pass_gate"))
    return g.drop("_c", "_f").crossJoin(F.broadcast(v))  # one row


def seed_replicated(pairs: DataFrame) -> DataFrame:
    """Variant pairs whose significant difference has one direction in at least two seeds.

    ``pairs`` carries variant, base and seed of both systems, ``diff`` and ``significant``.
    """
    p = pairs.filter((F.col("seed_a") == F.col("seed_b")) & (F.col("variant_a") != F.col("variant_b")))
    lo, hi = F.least("variant_a", "variant_b"), F.greatest("variant_a", "variant_b")
    o = F.when(F.col("variant_a") == lo, F.col("diff")).otherwise(-F.col("diff"))
    p = p.select(lo.alias("variant_1"), hi.alias("variant_2"), F.col("seed_a").alias("seed"), o.alias("o"), "significant", (F.col("base_a") != F.col("base_b")).alias("cross_base"))
    g = p.groupBy("variant_1", "variant_2").agg(
        F.max("cross_base").alias("cross_base"), F.count_distinct("seed").alias("n_seeds"),
        F.count_distinct(F.when(F.col("significant") & (F.col("o") > 0), F.col("seed"))).alias("_p"), F.count_distinct(F.when(F.col("significant") & (F.col("o") < 0), F.col("seed"))).alias("_n"))
    return g.select("variant_1", "variant_2", "cross_base", "n_seeds", F.greatest("_p", "_n").alias("n_same_direction"), (F.col("cross_base") & (F.greatest("_p", "_n") >= 2)).alias("passed"))


def response_agreement(real: DataFrame, control: DataFrame, by: list[str], ref: str) -> DataFrame:
    """How alike two response curves are along an axis: signs, and signs where either one moves."""
    j = real.join(control, [*by, "pi_hash"]).filter(F.col("pi_hash") != ref)
    a, b = sign_tol(F.col("b_real")), sign_tol(F.col("b_control"))
    active = (a != 0) | (b != 0)
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((a == b).cast("int")).alias("sign_agreement"), F.avg(F.when(active, (a == b).cast("int"))).alias("active_sign_agreement"),
        F.sum(((a == 0) & (b == 0)).cast("bigint")).alias("n_both_zero"))

"""Rules across stored results: comparisons, ties, calibration, scan and clips must agree with one another.

A rule is a condition that no row of a table may meet. All rules of a table are evaluated in one aggregation over it, so a check costs
one pass per table; each rule reports how many rows it saw, how many break it and the smallest key that does.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.exprs import TOL

EXACT = 1e-12


def check_rules(table: DataFrame, name: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(source, rule, checked, violations, example) of every rule; a condition that is null counts as broken."""
    broken = {r: F.coalesce(c, F.lit(True)) for r, c in rules.items()}
    cells = [x for r, c in broken.items() for x in (F.count(F.when(c, 1)).alias(f"v_{r}"), F.min(F.when(c, key)).alias(f"e_{r}"))]
    agg = table.agg(F.count(F.lit(1)).alias("_n"), *cells)
    rows = F.array(*[F.struct(F.lit(name).alias("source"), F.lit(r).alias("rule"), F.col("_n").alias("checked"), F.col(f"v_{r}").alias("violations"), F.col(f"e_{r}").alias("example")) for r in rules])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def test_rules(tests: DataFrame, points: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests: pair tests with Holm's columns; points: (system_id, metric, value) that they compare."""
    p = [points.select("metric", F.col("system_id").alias(f"system_{s}"), F.col("value").alias(f"_{s}")) for s in "ab"]
    t = tests.join(p[0], ["metric", "system_a"], "left").join(p[1], ["metric", "system_b"], "left")
    return check_rules(t, "tests", F.concat_ws("|", "metric", "system_a", "system_b"), {
        "pair_ordered": ~(F.col("system_a") < F.col("system_b")),
        "p_has_a_floor": ~F.col("p_percentile").between(1.0 / F.col("n_boot") - EXACT, 1.0),
        "adjusted_not_below_raw": F.col("p_adjusted") < F.col("p_percentile") - EXACT,
        "reject_by_adjusted": F.col("reject") != (F.col("p_adjusted") <= alpha),
        "interval_ordered": F.col("ci_lo") > F.col("ci_hi"),
        "difference_of_points": F.abs(F.col("diff") - (F.col("_a") - F.col("_b"))) > TOL,
    })


def interval_rules(holm: DataFrame, alpha: float = 0.05) -> DataFrame:
    """What counts as significant must be so by adjusted p, by its corrected interval and by its own."""
    clear = [(F.col(lo) > 0) | (F.col(hi) < 0) for lo, hi in (("ci_holm_lo", "ci_holm_hi"), ("ci_lo", "ci_hi"))]
    return check_rules(holm, "intervals", F.concat_ws("|", "metric", "system_a", "system_b"), {
        "significant_by_adjusted": F.col("significant") & (F.col("p_adjusted") > alpha),
        "significant_clear_of_zero": F.col("significant") & ~(clear[0] & clear[1]),
        "bonferroni_not_narrower": F.col("ci_bonferroni_hi") - F.col("ci_bonferroni_lo") < F.col("ci_holm_hi") - F.col("ci_holm_lo") - TOL,
    })


def tie_rules(tied: DataFrame, intervals: DataFrame) -> DataFrame:
    """Tied pairs have overlapping intervals. intervals: (system_id, ci_lo, ci_hi) of the metric that ties."""
    t = tied
    for s in "ab":
        t = t.join(intervals.select(F.col("system_id").alias(f"system_{s}"), F.col("ci_lo").alias(f"lo_{s}"), F.col("ci_hi").alias(f"hi_{s}")), f"system_{s}", "left")
    return check_rules(t, "ties", F.concat_ws("|", "system_a", "system_b"), {
        "tie_ordered": ~(F.col("system_a") < F.col("system_b")),
        "intervals_overlap": F.greatest("lo_a", "lo_b") > F.least("hi_a", "hi_b"),
    })


def calibration_rules(cal: DataFrame, tied: DataFrame, points: DataFrame, separated: DataFrame, ranks: DataFrame, ref: str) -> DataFrame:
    """Rulers, pair counts and ranks of a calibration taken anew from ties, points, separated pairs and the scan.

    cal: (metric, min_r, mrd, ruler, n_pairs, verdict); ranks: (pi_hash, metric, r_m).
    """
    p = [points.select("metric", F.col("system_id").alias(f"system_{s}"), F.col("value").alias(f"_{s}")) for s in "ab"]
    ruler = tied.join(p[0], "system_a").join(p[1], ["metric", "system_b"]).groupBy("metric").agg(F.percentile(F.abs(F.col("_a") - F.col("_b")), F.lit(0.5)).alias("_ruler"))
    n = separated.groupBy("metric").agg(F.count(F.lit(1)).alias("_pairs"))
    at = ranks.groupBy("metric").agg(F.max(F.when(F.col("pi_hash") == ref, F.col("r_m"))).alias("_r_ref"), F.count("r_m").alias("_known"))
    c = cal.join(ruler, "metric", "left").join(n, "metric", "left").join(at, "metric", "left")
    undefined = F.coalesce(F.col("_known"), F.lit(0)) == 0
    return check_rules(c, "calibration", F.col("metric"), {
        "ruler_from_ties": ~F.col("ruler").eqNullSafe(F.col("_ruler")) & ~(F.coalesce(F.abs(F.col("ruler") - F.col("_ruler")) <= EXACT, F.lit(False))),
        "pairs_are_the_separated": F.coalesce("n_pairs", F.lit(0)) > F.coalesce("_pairs", F.lit(0)),
        "reference_rank_is_one": ~undefined & (F.col("_r_ref") != 1.0),
        "least_rank_in_range": F.col("min_r").isNotNull() & ~F.col("min_r").between(0.0, 1.0),
        "verdict_by_rule": F.coalesce((F.col("verdict") == "poolable") & ~((F.col("min_r") >= 0.9) & (F.col("mrd") < F.col("ruler"))), F.lit(False)),
    })


def scan_rules(scan: DataFrame, n_systems: int, n_metrics: int) -> DataFrame:
    """Every protocol has every system and metric once; re-runs are never systems of their own."""
    g = scan.groupBy("pi_hash").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("system_id", "metric").alias("_d"), F.count(F.when(F.col("system_id").contains("__stride"), 1)).alias("_s"))
    return check_rules(g, "scan", F.col("pi_hash"), {
        "systems_times_metrics": F.col("_n") != n_systems * n_metrics, "no_row_twice": F.col("_n") != F.col("_d"), "no_rerun_as_system": F.col("_s") > 0})


def clip_rules(clips: DataFrame, n_systems: int) -> DataFrame:
    """One cohort for all systems, delays inside the window, parts that add up, onsets with the end."""
    n = clips.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("system_id").alias("_d"))
    cohort = check_rules(n, "clips", F.col("video_id"), {"one_cohort": F.col("_n") != n_systems, "no_clip_twice": F.col("_n") != F.col("_d")})
    each = check_rules(clips, "clips", F.concat_ws("|", "system_id", "video_id"), {
        "delay_within_window": ~F.col("delay").between(0.0, F.col("h_s")),
        "parts_add_up": (F.abs(F.col("delay") - F.col("err_area") - F.col("retr_area")) > 1e-10) | (F.col("retr_area") < -1e-10),
        "stable_end_has_onset": (F.col("end_ok") == 1) != F.col("onset_j").isNotNull(),
    })
    return cohort.unionByName(each)


def control_rules(gate: DataFrame) -> DataFrame:
    """Controls that are always right show no gap at all."""
    return check_rules(gate.filter(F.col("control_passed").isNotNull()), "controls", F.col("system_id"), {
        "control_without_gap": (F.abs("own_gap") > EXACT) | (F.abs("fixed_gap") > EXACT), "control_passes": ~F.col("control_passed")})

"""Do differences found on one track reappear on another?"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.exprs import mean_ratio, uniform


def match_families(a: DataFrame, b: DataFrame, min_seeds: int) -> DataFrame:
    """Families of two registries side by side: matched, underpowered, or on one side only."""
    def side(df, s):
        return df.groupBy("family_key").agg(F.count(F.lit(1)).alias(f"n_systems_{s}"), F.count_distinct("seed").alias(f"n_seeds_{s}"))
    j = side(a, "a").join(side(b, "b"), "family_key", "full_outer")
    status = (F.when(F.col("n_systems_b").isNull(), "only_a").when(F.col("n_systems_a").isNull(), "only_b")
              .when((F.col("n_seeds_a") >= min_seeds) & (F.col("n_seeds_b") >= min_seeds), "matched").otherwise("underpowered"))
    return j.withColumn("status", status)


def validate_track(obs: DataFrame) -> DataFrame:
    """Counts of what must not happen: duplicates, uneven cohorts, clips whose cluster or class differ, values outside [0, 1]."""
    cell = obs.groupBy("system_id", "video_id").agg(F.count(F.lit(1)).alias("n"))
    dup = cell.agg(F.sum((F.col("n") > 1).cast("bigint")).alias("n")).select(F.lit("duplicate_observation").alias("rule"), "n")
    n_sys = obs.select("system_id").distinct().agg(F.count(F.lit(1))).scalar()
    per = obs.groupBy("video_id").agg(
        F.count_distinct("system_id").alias("n_sys"), (F.min("source_cluster_id") != F.max("source_cluster_id")).alias("_c"), (F.min("class_code") != F.max("class_code")).alias("_k"))
    uneven = per.withColumn("_off", F.col("n_sys") != n_sys).agg(F.sum(F.col("_off").cast("bigint")).alias("n")).select(F.lit("uneven_cohort").alias("rule"), "n")
    meta = per.agg(F.sum((F.col("_c") | F.col("_k")).cast("bigint")).alias("n")).select(F.lit("inconsistent_clip").alias("rule"), "n")
    value = obs.agg(F.sum((F.col("value").isNull() | ~F.col("value").between(0, 1)).cast("bigint")).alias("n")).select(F.lit("value_outside").alias("rule"), "n")
    return dup.unionByName(uneven).unionByName(meta).unionByName(value)


def family_differences(values: DataFrame, by: list[str]) -> DataFrame:
    """Median over shared seeds of the difference of two families; ``values`` has (by, family_key, seed, value)."""
    a = values.select(*by, "seed", F.col("family_key").alias("family_a"), F.col("value").alias("va"))
    b = values.select(*by, "seed", F.col("family_key").alias("family_b"), F.col("value").alias("vb"))
    p = a.join(b, [*by, "seed"]).filter("family_a < family_b")
    return p.groupBy(*by, "family_a", "family_b").agg(F.percentile(F.col("va") - F.col("vb"), F.lit(0.5)).alias("diff"), F.count(F.lit(1)).alias("n_seeds"))


def outcome(diff_a: Column, diff_b: Column, lo_b: Column, hi_b: Column, ruler_b: Column | None = None) -> Column:
    """Agree, reverse, tie or uncertain: no reading on the second track is not the same as a tie.

    With a ruler, the second track's smallest resolvable difference, what lies below it is a tie; a null ruler resolves nothing away, a
    negative one is an error.
    """
    out = (F.when(diff_a.isNull() | F.isnan(diff_a) | (diff_a == 0) | diff_b.isNull() | F.isnan(diff_b) | lo_b.isNull() | hi_b.isNull() | (lo_b > hi_b), "uncertain")
           .when((diff_b == 0) | ((lo_b <= 0) & (hi_b >= 0)), "tie"))
    if ruler_b is not None:
        out = out.when(ruler_b < 0, F.raise_error(F.lit("a ruler must not be negative")).cast("string")).when(F.abs(diff_b) < ruler_b, "tie")
    return out.when((diff_a > 0) == (diff_b > 0), "agree").otherwise("reverse")


def track_ruler(readings: DataFrame) -> Column:
    """Smallest difference that a track resolves: the median absolute difference of its pairs that aren't told apart, null without any."""
    apart = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    return readings.agg(F.percentile(F.when(~apart, F.abs("diff")), F.lit(0.5)).alias("ruler")).scalar()


def agreement_rates(outcomes: DataFrame) -> DataFrame:
    def n(*names):
        return F.sum(F.col("outcome").isin(*names).cast("bigint"))
    return outcomes.agg(
        F.count(F.lit(1)).alias("n_selected"), n("agree").alias("n_agree"), n("reverse").alias("n_reverse"), n("tie").alias("n_tie"), n("uncertain").alias("n_uncertain"),
        mean_ratio(n("agree"), n("agree", "reverse", "tie")).alias("primary_rate"), mean_ratio(n("agree"), n("agree", "reverse")).alias("secondary_rate"),
        mean_ratio(n("agree", "reverse", "tie"), F.count(F.lit(1))).alias("coverage"))


def family_weight_rates(outcomes: DataFrame, n_boot: int, seed: str) -> DataFrame:
    """Agreement rate under random family weights, one row per replicate.

    Weights are exponential draws keyed by replicate and family; a pair weighs the product of its
    families, and the common scale of a Dirichlet draw cancels in the ratio.
    """
    def weight(f):
        return -F.log(uniform(F.concat_ws("|", F.lit(seed), "b", f)) + F.lit(1.0 / 4294967296.0))
    o = outcomes.filter("outcome <> 'uncertain'").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    w = weight("family_a") * weight("family_b")
    return o.groupBy("b").agg((F.sum(F.when(F.col("outcome") == "agree", w).otherwise(0.0)) / F.sum(w)).alias("value"))

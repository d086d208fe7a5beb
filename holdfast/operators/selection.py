"""Choosing systems: best by score, regret, top-k overlap, pair order and rank correlation.

These tables have one row per registered system (or per system and replicate), whatever the number
of clips, so their windows and pair joins stay small.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.exprs import TIE, correlation, mean_ratio, sign_tol


def sweep_choice(summary: DataFrame) -> DataFrame:
    """Pick a swept value per base system and arm: feasible first, then least delay; arm ``base`` is the system itself."""
    base = summary.filter("arm = 'base'").select("system_id", F.col("acc").alias("_base"))
    s = summary.filter("arm <> 'base'").join(base, "system_id").withColumn("feasible", F.col("acc") >= F.col("_base") - TIE).drop("_base")
    order = Window.partitionBy("system_id", "arm").orderBy((~F.col("feasible")).cast("int"), F.round("rmscd", 9), "value")
    return s.withColumn("selected", F.row_number().over(order) == 1)


def best(df: DataFrame, by: list[str], score: Column, out: str) -> DataFrame:
    """System with the smallest score in each group; scores within 1e-9 of the best tie and go to the smallest identifier."""
    low = Window.partitionBy(*by)
    s = df.withColumn("_s", score)
    s = s.filter(F.col("_s").isNotNull()).withColumn("_low", F.min("_s").over(low)).filter(F.col("_s") - F.col("_low") < TIE)
    return s.groupBy(*by).agg(F.min("system_id").alias(out))


def regret(df: DataFrame, by: list[str]) -> DataFrame:
    """What choosing by accuracy costs in delay, and what choosing by delay costs in accuracy."""
    a = best(df, by, -F.col("accuracy"), "by_accuracy")
    d = best(df, by, F.col("delay"), "by_delay")
    ga = df.select(*by, F.col("system_id").alias("by_accuracy"), F.col("accuracy").alias("acc_a"), F.col("delay").alias("delay_a"))
    gd = df.select(*by, F.col("system_id").alias("by_delay"), F.col("accuracy").alias("acc_d"), F.col("delay").alias("delay_d"))
    j = a.join(d, by).join(ga, [*by, "by_accuracy"]).join(gd, [*by, "by_delay"])
    return j.select(*by, "by_accuracy", "by_delay", (F.col("by_accuracy") == F.col("by_delay")).alias("same_choice"),
                    (F.col("delay_a") - F.col("delay_d")).alias("delay_regret"), (F.col("acc_d") - F.col("acc_a")).alias("accuracy_change"))


def top_k_overlap(df: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by)
    ra = F.row_number().over(w.orderBy(F.round(-F.col("accuracy"), 9), "system_id"))
    rd = F.row_number().over(w.orderBy(F.round("delay", 9), "system_id"))
    r = df.withColumn("_a", ra).withColumn("_d", rd)
    return r.groupBy(*by).agg((F.sum(((F.col("_a") <= k) & (F.col("_d") <= k)).cast("int")) / k).alias("overlap"))


def pairs(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Ordered pairs of systems of one group with their differences (first minus second)."""
    a = df.select(*by, F.col("system_id").alias("system_a"), *[F.col(v).alias(f"{v}_a") for v in values])
    b = df.select(*by, F.col("system_id").alias("system_b"), *[F.col(v).alias(f"{v}_b") for v in values])
    return a.join(b, by).filter("system_a < system_b").select(
        *by, "system_a", "system_b", *[(F.col(f"{v}_a") - F.col(f"{v}_b")).alias(f"d_{v}") for v in values])


def pair_disagreement(p: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pairs that two scores order oppositely, ties left out."""
    valid = (F.abs(F.col(x)) >= TIE) & (F.abs(F.col(y)) >= TIE)
    opposite = valid & (F.signum(x) != F.signum(y))
    return p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(valid.cast("bigint")).alias("compared"), F.sum(opposite.cast("bigint")).alias("opposite"),
        mean_ratio(F.sum(opposite.cast("int")), F.sum(valid.cast("int"))).alias("share_opposite"),
        F.percentile(F.when(opposite, F.abs(F.col(x))), F.lit(0.5)).alias("median_abs_dx"))


def kendall(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Tau-b on values rounded to 1e-9; null when a score is constant or fewer than three systems remain."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn(x, F.round(x, 9)).withColumn(y, F.round(y, 9))
    p = pairs(d, by, [x, y])
    sx, sy = sign_tol(F.col(f"d_{x}"), 0.0), sign_tol(F.col(f"d_{y}"), 0.0)
    g = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n0"), F.sum(sx * sy).alias("s"), F.sum((sx == 0).cast("bigint")).alias("tx"), F.sum((sy == 0).cast("bigint")).alias("ty"))
    tau = F.col("s") / F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty")).cast("double"))
    ok = (F.col("n0") >= 3) & (F.col("tx") < F.col("n0")) & (F.col("ty") < F.col("n0"))
    return g.select(*by, F.when(ok, tau).alias("tau"))


def average_rank(by: list[str], c: str) -> Column:
    """Rank with ties sharing their mean rank."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0


def spearman(df: DataFrame, by: list[str], x: str, y: str, out: str) -> DataFrame:
    """Correlation of mean ranks; null when either side is constant."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn(x, F.round(x, 12)).withColumn(y, F.round(y, 12))
    d = d.withColumn("_x", average_rank(by, x)).withColumn("_y", average_rank(by, y))
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y)) & (F.count(F.lit(1)) > 1)
    return d.groupBy(*by).agg(F.when(varies, correlation(F.col("_x"), F.col("_y"))).alias(out))

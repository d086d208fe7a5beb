"""Cluster bootstrap and corrected comparisons.

Draws are hash-keyed, so every system sees the same replicates whatever the partitioning. Clip
values are summed per (system, cluster, class) before they meet the draws: the replicate table then
costs clusters times replicates, not clips times replicates, and is taken as a matrix product in the
tasks (``operators.replicates``). From the replicates on, tables are bounded by systems and replicates.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.exprs import TOL, mean_ratio, uniform
from holdfast.functions.tails import normal_two_sided, normal_upper, student_upper
from holdfast.operators.ranking import grown, hash_rank, spread
from holdfast.operators.replicates import counted, product_sums
from holdfast.session import cut


def packed_draws(clusters: DataFrame, n_boot: int, seed: int | str) -> DataFrame:
    """Multiplicity of every cluster in every replicate, K picks with replacement out of K clusters: an array ``weights`` per cluster.

    Clusters are numbered by hash rank without a global sort; each cluster also stands for one pick. The picks are dealt out by
    the cluster they fall on and counted there; as ``grown`` rows, whose size Spark does not foresee, draws are never broadcast.
    """
    idx = hash_rank(clusters.select("source_cluster_id").distinct(), [], F.col("source_cluster_id"), [F.col("source_cluster_id")], "_i")
    idx = idx.withColumn("_i", F.col("_i") - 1)
    k = idx.agg(F.count(F.lit(1))).scalar()
    slots = spread(idx, "_i").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = uniform(F.concat_ws("|", F.lit(f"boot{seed}"), "b", "_i"))
    picks = slots.select("b", F.floor(u * k).alias("_i")).transform(spread, "_i")
    return grown(grown(counted(picks, n_boot)).join(idx, "_i").select("source_cluster_id", "weights"))


def draw_rows(packed: DataFrame) -> DataFrame:
    """Packed draws as rows (b, source_cluster_id, w), those of weight 0 left out."""
    return packed.select(F.posexplode("weights").alias("b", "w"), "source_cluster_id").filter("w > 0").select("b", "source_cluster_id", F.col("w").cast("bigint").alias("w"))


def cluster_draws(clusters: DataFrame, n_boot: int, seed: int | str) -> DataFrame:
    """``packed_draws`` as rows (b, source_cluster_id, w)."""
    return draw_rows(packed_draws(clusters, n_boot, seed))


def replicate_sums(rows: DataFrame, draws: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of every value, weighted by packed draws or by rows of draws: (keys, b, values)."""
    if "weights" in draws.columns:
        return product_sums(rows, draws, keys, values)
    j = rows.join(spread(grown(draws), "source_cluster_id"), "source_cluster_id")
    return j.groupBy(*keys, "b").agg(*[F.sum(F.col("w") * F.col(v)).alias(v) for v in values])


def supported_draws(draws: DataFrame, cluster_classes: DataFrame, n_boot: int) -> DataFrame:
    """The first ``n_boot`` replicates in which every class has a drawn cluster, and how many were passed over."""
    classes = cluster_classes.select("class_code").distinct().agg(F.count(F.lit(1))).scalar()
    seen = replicate_sums(cluster_classes.select("source_cluster_id", "class_code", F.lit(1).alias("n")), draws, ["class_code"], ["n"])
    seen = seen.groupBy("b").agg(F.count(F.lit(1)).alias("_c"))
    s = seen.withColumn("ok", F.col("_c") == classes)
    order = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_r", F.sum(F.col("ok").cast("int")).over(order)).withColumn("_bad", F.sum((~F.col("ok")).cast("int")).over(order))
    return s.filter(F.col("ok") & (F.col("_r") <= n_boot)).select("b", (F.col("_r") - 1).alias("rep"), F.col("_bad").alias("rejected_before"))


def _draw_supported(clusters: DataFrame, cluster_classes: DataFrame, n_boot: int, seed: int | str) -> tuple[DataFrame, DataFrame]:
    """Supported replicates as ``draw_supported`` gives them, with the packed draws they were chosen from."""
    if cluster_classes.join(clusters.select("source_cluster_id"), "source_cluster_id", "left_semi").select("class_code").distinct().count() < cluster_classes.select("class_code").distinct().count():
        raise ValueError("a class has no cluster among those drawn from, so no replicate can support it")
    n = n_boot
    while True:
        n = n + n // 2 + 1
        draws = grown(cut(packed_draws(clusters, n, seed), "candidates"))
        got = cut(supported_draws(draws, cluster_classes, n_boot), "supported")
        if got.count() >= n_boot:
            return got, draws


def draw_supported(clusters: DataFrame, cluster_classes: DataFrame, n_boot: int, seed: int | str) -> DataFrame:
    """Exactly ``n_boot`` supported replicates: further candidates are drawn by index until there are enough."""
    return _draw_supported(clusters, cluster_classes, n_boot, seed)[0]


def packed_supported(clusters: DataFrame, cluster_classes: DataFrame, n_boot: int, seed: int | str) -> tuple[DataFrame, DataFrame]:
    """Packed draws of exactly ``n_boot`` replicates that support every class, numbered from 0, and one row with the number passed over."""
    chosen, draws = _draw_supported(clusters, cluster_classes, n_boot, seed)
    order = chosen.agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "b"))), lambda x: x["b"])).scalar()  # one element per replicate
    w = draws.withColumn("_order", order).select("source_cluster_id", F.transform("_order", lambda b: F.get("weights", b)).alias("weights"))
    return grown(w), chosen.agg(F.max("rejected_before").alias("n_rejected"))


def supported_weights(clusters: DataFrame, cluster_classes: DataFrame, n_boot: int, seed: int | str) -> tuple[DataFrame, DataFrame]:
    """``packed_supported`` with its draws as rows (b, source_cluster_id, w)."""
    w, rejected = packed_supported(clusters, cluster_classes, n_boot, seed)
    return draw_rows(w), rejected


def cluster_sums(clips: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    return clips.groupBy(*keys, "source_cluster_id", "class_code").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in values.items()])


def replicate_means(sums: DataFrame, draws: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Micro mean and class-average mean of every value in every replicate."""
    per = replicate_sums(sums, draws, [*keys, "class_code"], ["n", *values]).withColumnRenamed("n", "_n")
    out = []
    for v in values:
        out += [mean_ratio(F.sum(v), F.sum("_n")).alias(f"{v}_micro"), F.avg(F.when(F.col("_n") > 0, F.col(v) / F.col("_n"))).alias(f"{v}_macro")]
    return per.groupBy(*keys, "b").agg(*out, F.min("_n").alias("least_class"))


def replicate_median(clips: DataFrame, draws: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Median of a whole-number clip value in every replicate, from its weighted histogram."""
    hist = clips.groupBy(*keys, "source_cluster_id", value).agg(F.count(F.lit(1)).alias("n"))
    h = replicate_sums(hist, draws, [*keys, value], ["n"]).withColumnRenamed("n", "c")
    g = Window.partitionBy(*keys, "b")
    h = h.withColumn("_cum", F.sum("c").over(g.orderBy(value))).withColumn("_tot", F.sum("c").over(g))
    lo = F.min(F.when(F.col("_cum") > F.floor((F.col("_tot") - 1) / 2), F.col(value)))
    hi = F.min(F.when(F.col("_cum") > F.floor(F.col("_tot") / 2), F.col(value)))
    return h.groupBy(*keys, "b").agg(((lo + hi) / 2.0).alias(out))


def family_samples(clips: DataFrame, draws: DataFrame) -> DataFrame:
    """The frozen family in every replicate, as rows (system_id, metric, b, value)."""
    d = F.col("delta_s")
    def at(k):  # null outside the window, as in the point values
        step = F.rint(F.lit(k) / d)
        return F.when((F.lit(k) <= F.col("h_s") + TOL) & (step <= F.col("steps")), (F.col("lw") < step).cast("int"))
    sums = cluster_sums(clips, ["system_id"], {
        "delay": F.col("delay"), "s1": at(1.0), "s3": at(3.0), "end_ok": F.col("end_ok")})
    m = replicate_means(sums, draws, ["system_id"], ["delay", "s1", "s3", "end_ok"])
    m = m.join(replicate_median(clips, draws, ["system_id"], "flips", "med"), ["system_id", "b"])
    cols = {"rmscd": "delay_micro", "s_at_1": "s1_micro", "s_at_3": "s3_micro", "end_macro_acc": "end_ok_macro", "median_flips": "med"}
    return m.select("system_id", "b", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(v).cast("double").alias("value")) for k, v in cols.items()])).alias("_m")
                    ).select("system_id", "b", "_m.metric", "_m.value")


def percentile_interval(df: DataFrame, by: list[str], value: str = "value", floor: float = 0.95) -> DataFrame:
    """95% percentile interval; null when fewer than ``floor`` of the replicates are defined."""
    ok = F.count(value) >= floor * F.count(F.lit(1))
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    g = df.groupBy(*by).agg(F.when(ok, q).alias("_q"), F.count(value).alias("n_valid"))
    return g.select(*by, F.get("_q", F.lit(0)).alias("ci_lo"), F.get("_q", F.lit(1)).alias("ci_hi"), "n_valid")


def pair_samples(samples: DataFrame) -> DataFrame:
    """Differences of every pair in every replicate; below 1e-12 they are summation noise and read as zero."""
    a = samples.select("metric", "b", F.col("system_id").alias("system_a"), F.col("value").alias("va"))
    b = samples.select("metric", "b", F.col("system_id").alias("system_b"), F.col("value").alias("vb"))
    return a.join(b, ["metric", "b"]).filter("system_a < system_b").withColumn("d", F.round(F.col("va") - F.col("vb"), 12)).drop("va", "vb")


def pair_tests(points: DataFrame, samples: DataFrame, normal: bool = False) -> DataFrame:
    """Every pair on every metric: difference, interval, percentile p with its 1/B floor, standard error, z.

    ``z`` is null where the bootstrap has no spread; such a pair has p 0 with an effect and 1 without.
    """
    pa = points.select("metric", F.col("system_id").alias("system_a"), F.col("value").alias("pa"))
    pb = points.select("metric", F.col("system_id").alias("system_b"), F.col("value").alias("pb"))
    keys = ["metric", "system_a", "system_b"]
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    g = pair_samples(samples).groupBy(*keys).agg(
        q.alias("_q"), F.stddev_samp("d").alias("se"), F.count("d").alias("n_boot"),
        F.avg((F.col("d") <= 0).cast("int")).alias("_le"), F.avg((F.col("d") >= 0).cast("int")).alias("_ge"))
    t = g.join(pa, ["metric", "system_a"]).join(pb, ["metric", "system_b"])
    t = t.withColumn("diff", F.round(F.col("pa") - F.col("pb"), 12))
    p = F.least(F.lit(1.0), F.greatest(2 * F.least("_le", "_ge"), 1.0 / F.col("n_boot")))
    out = t.select(*keys, "diff", F.get("_q", F.lit(0)).alias("ci_lo"), F.get("_q", F.lit(1)).alias("ci_hi"), "se", "n_boot",
                   p.alias("p_percentile"), F.when(F.col("se") > 0, F.abs("diff") / F.col("se")).alias("z"))
    if normal:
        flat = F.when(F.abs("diff") > 0, 0.0).otherwise(1.0)
        out = out.withColumn("p_normal", F.when(F.col("z").isNull(), flat).otherwise(normal_two_sided("z")))
    return out


def holm(tests: DataFrame, by: list[str], p: str, alpha: float = 0.05, order: list[str] | None = None) -> DataFrame:
    """Step-down adjusted p and rejection; missing p counts as 1."""
    order = order or ["system_a", "system_b"]
    g = Window.partitionBy(*by)
    t = tests.withColumn("_p", F.coalesce(p, F.lit(1.0)))
    t = t.withColumn("holm_rank", F.row_number().over(g.orderBy("_p", *order))).withColumn("_m", F.count(F.lit(1)).over(g))
    step = (F.col("_m") - F.col("holm_rank") + 1) * F.col("_p")
    adj = F.least(F.lit(1.0), F.max(step).over(g.orderBy("holm_rank").rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("p_adjusted", adj).withColumn("reject", F.col("p_adjusted") <= alpha).drop("_p")


def holm_intervals(tests: DataFrame, by: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Holm and Bonferroni intervals. Significant: rejected in step-down order and both intervals clear of zero."""
    t = holm(tests, by, p, alpha)
    local = F.lit(alpha) / (2 * (F.col("_m") - F.col("holm_rank") + 1))
    r, b = normal_upper(local) * F.col("se"), normal_upper(F.lit(alpha) / (2 * F.col("_m"))) * F.col("se")
    t = t.withColumn("ci_holm_lo", F.col("diff") - r).withColumn("ci_holm_hi", F.col("diff") + r)
    t = t.withColumn("ci_bonferroni_lo", F.col("diff") - b).withColumn("ci_bonferroni_hi", F.col("diff") + b)
    clear = ((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)) & ((F.col("ci_holm_lo") > 0) | (F.col("ci_holm_hi") < 0))
    return t.withColumn("significant", F.col("reject") & clear).drop("_m")


def tied_pairs(intervals: DataFrame) -> DataFrame:
    """Pairs of systems whose intervals overlap; the interval table has one row per system."""
    one = F.lit(1)
    i = intervals.filter(F.col("ci_lo").isNotNull() & F.col("ci_hi").isNotNull()).withColumn("_k", one)
    a = i.select("_k", F.col("system_id").alias("system_a"), F.col("ci_lo").alias("la"), F.col("ci_hi").alias("ha"))
    b = i.select("_k", F.col("system_id").alias("system_b"), F.col("ci_lo").alias("lb"), F.col("ci_hi").alias("hb"))
    j = a.join(b, "_k").filter("system_a < system_b").filter(~((F.col("ha") < F.col("lb")) | (F.col("hb") < F.col("la"))))
    return j.select("system_a", "system_b")


CONTRASTS = ["advantage", "common_success", "success_set_mismatch", "error_area", "retracted_area", "endpoint_scaled"]


def paired_contrasts(clips: DataFrame, horizon: float) -> DataFrame:
    """Six per-clip contrasts of systems that share a seed, positive when the first is better."""
    cols = ["video_id", "seed"]
    keep = ["delay", "err_area", "retr_area", "end_ok"]
    c = clips.withColumn("seed", F.regexp_extract("system_id", r"seed(\d+)", 1))
    a = c.select(*cols, "source_cluster_id", "class_code", F.col("system_id").alias("system_a"), *[F.col(k).alias(f"{k}_a") for k in keep])
    b = c.select(*cols, F.col("system_id").alias("system_b"), *[F.col(k).alias(f"{k}_b") for k in keep])
    p = a.join(b, cols).filter("system_a < system_b")
    ca, cb = F.col("end_ok_a") == 1, F.col("end_ok_b") == 1
    adv = F.col("delay_b") - F.col("delay_a")
    return p.select(
        "system_a", "system_b", *cols, "source_cluster_id", "class_code", ca.alias("ca"), cb.alias("cb"), adv.alias("advantage"),
        F.when(ca & cb, adv).otherwise(0.0).alias("common_success"),
        F.when(ca & ~cb, horizon - F.col("delay_a")).when(~ca & cb, F.col("delay_b") - horizon).otherwise(0.0).alias("success_set_mismatch"),
        (F.col("err_area_b") - F.col("err_area_a")).alias("error_area"), (F.col("retr_area_b") - F.col("retr_area_a")).alias("retracted_area"),
        (horizon * (F.col("end_ok_a") - F.col("end_ok_b"))).alias("endpoint_scaled"))


def melt(df: DataFrame, keys: list[str], values: dict[str, str], name: str, out: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias(name), F.col(c).cast("double").alias(out)) for k, c in values.items()])).alias("_m")).select(*keys, f"_m.{name}", f"_m.{out}")


def simultaneous_band(points: DataFrame, reps: DataFrame, keys: list[str], alpha: float = 0.05, df: Column | None = None) -> DataFrame:
    """Max-t band over all coordinates; ``df`` adds the Student guard. Coordinates without spread keep zero radius.

    ``points`` has one row per coordinate, ``reps`` one per coordinate and replicate.
    """
    se = reps.groupBy(*keys).agg(F.stddev_samp("value").alias("se"))
    s = points.join(se, keys).withColumn("zero_variance", F.col("se") < 1e-12)
    scale = F.when(F.col("zero_variance"), 1.0).otherwise(F.col("se"))
    z = reps.withColumnRenamed("value", "_rep").join(s, keys).withColumn("_z", F.abs((F.col("_rep") - F.col("value")) / scale))
    top = z.groupBy("b").agg(F.max("_z").alias("_z")).agg(F.percentile("_z", F.lit(1 - alpha))).scalar()
    size = points.agg(F.count(F.lit(1))).scalar()
    band = s.withColumn("bootstrap_critical", top).withColumn("n_coordinates", size)
    guard = F.lit(0.0) if df is None else student_upper(F.lit(alpha) / (2 * F.col("n_coordinates")), df)
    band = band.withColumn("guard", guard).withColumn("critical", F.greatest("bootstrap_critical", "guard"))
    radius = F.col("critical") * F.when(F.col("zero_variance"), 0.0).otherwise(F.col("se"))
    return band.withColumn("lower", F.col("value") - radius).withColumn("upper", F.col("value") + radius)


def robust_status(lo_min: Column, lo_max: Column, hi_min: Column, hi_max: Column, eps: Column) -> Column:
    """What a family of reading protocols supports about a pair at margin ``eps``."""
    up, down = lo_max > eps, hi_min < -eps
    return (F.when(lo_min > eps, "robust_a").when(hi_max < -eps, "robust_b").when(up & down, "supported_reversal")
            .when(up | down, "protocol_specific").otherwise("inconclusive"))


def with_terciles(df: DataFrame, cuts: DataFrame, length: str) -> DataFrame:
    """Stratum 0, 1 or 2 by two cuts (one row); a value on a cut belongs to the lower stratum."""
    x, c = F.col(length), cuts.select(F.struct("c1", "c2")).scalar()
    d = df.withColumn("_cut", c)
    return d.withColumn("stratum", F.when(x <= F.col("_cut.c1"), 0).when(x <= F.col("_cut.c2"), 1).otherwise(2)).drop("_cut")

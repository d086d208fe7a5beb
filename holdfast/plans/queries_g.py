"""Resampling and inference (survey section 2.G)."""
from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions.exprs import TOL, mean_ratio, r6
from holdfast.operators import inference as G
from holdfast.operators import trajectory as T
from holdfast.operators.protocol import Protocol, eligible
from holdfast.operators.ranking import exact_quantiles
from holdfast.plans.common import SEED, N_BOOT, clips, clips_for, draws, manifest, points, samples
from holdfast.plans.oracle import grid, u, with_base
from holdfast.plans.registry import query
from holdfast.plans.stages import stage
from holdfast.sources import derive as D

# Draws and samples of the frozen family in SQL.
DRAWS = f"""ix AS (SELECT source_cluster_id, row_number() OVER (ORDER BY md5(source_cluster_id), source_cluster_id)-1 AS i FROM (SELECT DISTINCT source_cluster_id FROM gc)),
kn AS (SELECT count(*) AS k FROM ix),
pk AS (SELECT b, floor({u(f"'boot{SEED}|'||b||'|'||s")}*k)::BIGINT AS i, count(*) AS w FROM kn, range(0,{N_BOOT}) q(b), range(0,(SELECT k FROM kn)) r(s) GROUP BY ALL),
wt AS (SELECT b, source_cluster_id, w FROM pk JOIN ix USING (i))"""
SAMPLES = DRAWS + """,
cs AS (SELECT system_id, source_cluster_id, y, count(*) AS n, sum(delay) AS d, sum((onset IS NOT NULL AND onset<=2)::INT) AS s1, sum((onset IS NOT NULL AND onset<=6)::INT) AS s3, sum(endok) AS e FROM gc GROUP BY ALL),
cy AS (SELECT system_id, b, y, sum(w*n) AS n, sum(w*d) AS d, sum(w*s1) AS s1, sum(w*s3) AS s3, sum(w*e) AS e FROM cs JOIN wt USING (source_cluster_id) GROUP BY ALL),
mm AS (SELECT system_id, b, sum(d)/sum(n) AS rmscd, sum(s1)::DOUBLE/sum(n) AS s_at_1, sum(s3)::DOUBLE/sum(n) AS s_at_3, avg(e::DOUBLE/n) AS end_macro_acc, avg(d/n) AS rmscd_macro FROM cy GROUP BY ALL),
fh AS (SELECT system_id, b, flips, sum(w*n) AS c FROM (SELECT system_id, source_cluster_id, flips, count(*) AS n FROM gc GROUP BY ALL) JOIN wt USING (source_cluster_id) GROUP BY ALL),
fu AS (SELECT *, sum(c) OVER (PARTITION BY system_id, b ORDER BY flips) AS cum, sum(c) OVER (PARTITION BY system_id, b) AS tot FROM fh),
fm AS (SELECT system_id, b, (min(CASE WHEN cum > (tot-1)//2 THEN flips END)+min(CASE WHEN cum > tot//2 THEN flips END))/2.0::DOUBLE AS median_flips FROM fu GROUP BY ALL),
sl AS (SELECT system_id, b, metric, value FROM (SELECT mm.system_id, mm.b, rmscd, s_at_1, s_at_3, end_macro_acc, median_flips FROM mm JOIN fm USING (system_id, b)) UNPIVOT (value FOR metric IN (rmscd, s_at_1, s_at_3, end_macro_acc, median_flips))),
ea AS (SELECT system_id, avg(a) AS end_macro_acc FROM (SELECT system_id, y, avg(endok) AS a FROM gc GROUP BY ALL) GROUP BY ALL),
pw AS (SELECT gc.system_id, avg(delay) AS rmscd, avg((onset IS NOT NULL AND onset<=2)::INT) AS s_at_1, avg((onset IS NOT NULL AND onset<=6)::INT) AS s_at_3, any_value(ea.end_macro_acc) AS end_macro_acc, median(flips)::DOUBLE AS median_flips FROM gc JOIN ea ON ea.system_id=gc.system_id GROUP BY gc.system_id),
pt AS (SELECT * FROM pw UNPIVOT (value FOR metric IN (rmscd, s_at_1, s_at_3, end_macro_acc, median_flips)))"""
TESTS = """,
pd AS (SELECT a.metric, a.system_id AS system_a, b.system_id AS system_b, a.b, round(a.value-b.value,12) AS d FROM sl a JOIN sl b ON a.metric=b.metric AND a.b=b.b AND a.system_id<b.system_id),
ts AS (SELECT pd.metric, system_a, system_b, any_value(round(p.value-q.value,12)) AS diff, quantile_cont(d,0.025) AS ci_lo, quantile_cont(d,0.975) AS ci_hi, stddev_samp(d) AS se, least(1.0::DOUBLE, greatest(2*least(avg((d<=0)::INT), avg((d>=0)::INT)), 1.0::DOUBLE/count(*))) AS p
 FROM pd JOIN pt p ON p.metric=pd.metric AND p.system_id=system_a JOIN pt q ON q.metric=pd.metric AND q.system_id=system_b GROUP BY ALL)"""
S = with_base(grid(3.0), SAMPLES)
ST = S + TESTS


@query("g01_cluster_draws", with_base(grid(3.0), DRAWS) + " SELECT b::INT AS b, source_cluster_id, w::BIGINT AS w FROM wt")
def g01(spark, sf):
    return G.draw_rows(draws(spark, sf))


@query("g02_supported_draws", with_base(grid(3.0), DRAWS.replace(f"range(0,{N_BOOT}) q(b)", f"range(0,{8 * N_BOOT}) q(b)")) + ", cc AS (SELECT DISTINCT source_cluster_id, y FROM gc), sb AS (SELECT b, count(DISTINCT y) AS c FROM wt JOIN cc USING (source_cluster_id) GROUP BY ALL), so AS (SELECT b, c=(SELECT count(DISTINCT y) FROM cc) AS ok FROM sb), sr AS (SELECT b, ok, sum(ok::INT) OVER (ORDER BY b) AS r, sum((NOT ok)::INT) OVER (ORDER BY b) AS bad FROM so) SELECT b::INT AS b, (r-1)::BIGINT AS rep, bad::BIGINT AS rejected_before FROM sr WHERE ok AND r<="+str(N_BOOT))
def g02(spark, sf):
    cc = clips(spark, sf).select("source_cluster_id", "class_code").distinct()
    pool = manifest(spark, sf, "test").filter(eligible(F.col("post_anchor_length_s"), D.H_REF))
    return G.draw_supported(pool, cc, N_BOOT, SEED)


@query("g03_bootstrap_means", S + " SELECT system_id, b::INT AS b, round(rmscd,6) AS rmscd, round(rmscd_macro,6) AS rmscd_macro, round(end_macro_acc,6) AS end_macro_acc FROM mm")
def g03(spark, sf):
    """Clip values summed per cluster and class before they meet the draws."""
    sums = G.cluster_sums(clips(spark, sf), ["system_id"], {"delay": F.col("delay"), "end_ok": F.col("end_ok")})
    m = G.replicate_means(sums, draws(spark, sf), ["system_id"], ["delay", "end_ok"])
    return m.select("system_id", "b", r6("delay_micro").alias("rmscd"), r6("delay_macro").alias("rmscd_macro"), r6("end_ok_macro").alias("end_macro_acc"))


@query("g04_bootstrap_median_flips", S + " SELECT system_id, b::INT AS b, median_flips FROM fm")
def g04(spark, sf):
    return G.replicate_median(clips(spark, sf), draws(spark, sf), ["system_id"], "flips", "median_flips")


@query("g05_percentile_intervals", S + " SELECT system_id, metric, round(quantile_cont(value,0.025),6) AS ci_lo, round(quantile_cont(value,0.975),6) AS ci_hi, count(*)::BIGINT AS n_valid FROM sl GROUP BY ALL")
def g05(spark, sf):
    i = G.percentile_interval(samples(spark, sf), ["system_id", "metric"])
    return i.select("system_id", "metric", r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"), "n_valid")


def tests(spark, sf, normal=False):
    """Tests of every pair on every metric: few rows, made once, so that no query plans the replicates again."""
    t = stage(spark, sf, "pair_tests", lambda: G.pair_tests(points(spark, sf), samples(spark, sf), True))
    return t if normal else t.drop("p_normal")


@query("g06_paired_percentile_p", ST + " SELECT metric, system_a, system_b, round(diff,6) AS diff, round(ci_lo,6) AS ci_lo, round(ci_hi,6) AS ci_hi, round(p,6) AS p_percentile FROM ts")
def g06(spark, sf):
    t = tests(spark, sf)
    return t.select("metric", "system_a", "system_b", *[r6(c).alias(c) for c in ("diff", "ci_lo", "ci_hi", "p_percentile")])


@query("g07_bootstrap_z", ST + " SELECT metric, system_a, system_b, round(se,6) AS se, round(CASE WHEN se>0 THEN abs(diff)/se END,4) AS z FROM ts WHERE metric<>'median_flips'")
def g07z(spark, sf):
    return tests(spark, sf).filter("metric <> 'median_flips'").select("metric", "system_a", "system_b", r6("se").alias("se"), F.round("z", 4).alias("z"))


# Two-sided normal tail by Simpson's rule, since the check engine has no error function.
TAIL = "2*0.012::DOUBLE/3/sqrt(2*pi())*list_sum(list_transform(range(0,1001), lambda k: (CASE WHEN k IN (0,1000) THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END)*exp(-0.5::DOUBLE*power({z}+k*0.012::DOUBLE,2))))"


@query("g07_normal_p", ST + " SELECT metric, system_a, system_b, round(diff,6) AS diff, round(se,6) AS se, round(CASE WHEN se>0 THEN " + TAIL.format(z="abs(diff)/se") + " WHEN abs(diff)>0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END,6) AS p_normal FROM ts")
def g07(spark, sf):
    """Normal p from the bootstrap standard error, with no resolution floor."""
    t = tests(spark, sf, True)
    return t.select("metric", "system_a", "system_b", *[r6(c).alias(c) for c in ("diff", "se", "p_normal")])


@query("g08_all_pair_tests", ST + ", n AS (SELECT *, (ci_lo>0 OR ci_hi<0) AS separated FROM ts) SELECT metric, count(*)::BIGINT AS n_pairs, sum(separated::INT)::BIGINT AS n_separated, round(median(abs(diff)),6) AS median_abs_diff FROM n GROUP BY ALL")
def g08(spark, sf):
    t = tests(spark, sf)
    sep = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    return t.groupBy("metric").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(sep.cast("bigint")).alias("n_separated"), r6(F.percentile(F.abs("diff"), F.lit(0.5))).alias("median_abs_diff"))


HOLM = """, hr AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p, system_a, system_b) AS r, count(*) OVER (PARTITION BY metric) AS m FROM ts),
ha AS (SELECT *, least(1.0::DOUBLE, max((m-r+1)*p) OVER (PARTITION BY metric ORDER BY r)) AS p_adj FROM hr)"""


@query("g09_holm", ST + HOLM + " SELECT metric, system_a, system_b, r::INT AS holm_rank, round(p_adj,6) AS p_adjusted, (p_adj<=0.05) AS reject FROM ha")
def g09(spark, sf):
    h = G.holm(tests(spark, sf), ["metric"], "p_percentile")
    return h.select("metric", "system_a", "system_b", "holm_rank", r6("p_adjusted").alias("p_adjusted"), "reject")


@query("g10_holm_intervals")
def g10(spark, sf):
    """Holm and Bonferroni normal intervals with the step-down mask and the separation requirement."""
    t = G.holm_intervals(tests(spark, sf, True), ["metric"], "p_normal")
    return t.select("metric", "system_a", "system_b", "diff", "p_adjusted", "ci_holm_lo", "ci_holm_hi", "ci_bonferroni_lo", "ci_bonferroni_hi", "significant")


@query("g11_correction_resolution", ST + f" SELECT metric, count(*)::BIGINT AS n_pairs, {N_BOOT}::BIGINT AS n_boot, round(1.0/{N_BOOT},6) AS p_floor, round(count(*)/{N_BOOT}.0,6) AS smallest_adjusted, (count(*)/{N_BOOT}.0 <= 0.05) AS percentile_ok, ceil(count(*)/0.05::DOUBLE)::BIGINT AS n_boot_needed FROM ts GROUP BY ALL")
def g11(spark, sf):
    """Can a percentile p survive the correction at all with this many pairs and replicates?"""
    t = tests(spark, sf).groupBy("metric").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("n_boot").alias("n_boot"))
    worst = F.col("n_pairs") / F.col("n_boot")
    return t.select("metric", "n_pairs", "n_boot", r6(1.0 / F.col("n_boot")).alias("p_floor"), r6(worst).alias("smallest_adjusted"), (worst <= 0.05).alias("percentile_ok"), F.ceil(F.col("n_pairs") / 0.05).alias("n_boot_needed"))


TIED = """, iv AS (SELECT system_id, quantile_cont(value,0.025) AS lo, quantile_cont(value,0.975) AS hi FROM sl WHERE metric='end_macro_acc' GROUP BY ALL),
td AS (SELECT a.system_id AS system_a, b.system_id AS system_b FROM iv a JOIN iv b ON a.system_id<b.system_id AND NOT (a.hi<b.lo OR b.hi<a.lo))"""


def tied(spark, sf):
    return stage(spark, sf, "tied", lambda: G.tied_pairs(G.percentile_interval(samples(spark, sf).filter("metric = 'end_macro_acc'"), ["system_id"])))


@query("g12_tied_pairs", S + TIED + " SELECT * FROM td")
def g12(spark, sf):
    return tied(spark, sf)


def rulers(spark, sf):
    p = points(spark, sf)
    t = tied(spark, sf)
    a = t.join(p.select(F.col("system_id").alias("system_a"), "metric", F.col("value").alias("va")), "system_a")
    b = a.join(p.select(F.col("system_id").alias("system_b"), "metric", F.col("value").alias("vb")), ["system_b", "metric"])
    return b.groupBy("metric").agg(F.percentile(F.abs(F.col("va") - F.col("vb")), F.lit(0.5)).alias("ruler"), F.count(F.lit(1)).alias("n_tied"))


@query("g13_rulers", S + TIED + " SELECT p.metric, round(median(abs(p.value-q.value)),6) AS ruler, count(*)::BIGINT AS n_tied FROM td JOIN pt p ON p.system_id=system_a JOIN pt q ON q.system_id=system_b AND q.metric=p.metric GROUP BY ALL")
def g13(spark, sf):
    return rulers(spark, sf).select("metric", r6("ruler").alias("ruler"), "n_tied")


_PC = """, gd AS (SELECT *, regexp_extract(system_id,'seed([0-9]+)',1) AS seed FROM gc),
pc AS (SELECT a.system_id AS system_a, b.system_id AS system_b, a.video_id, a.source_cluster_id, a.y, a.endok AS ca, b.endok AS cb, b.delay-a.delay AS advantage, CASE WHEN a.endok=1 AND b.endok=1 THEN b.delay-a.delay ELSE 0 END AS common_success,
 CASE WHEN a.endok=1 AND b.endok=0 THEN 3.0-a.delay WHEN a.endok=0 AND b.endok=1 THEN b.delay-3.0 ELSE 0 END AS success_set_mismatch, b.err-a.err AS error_area, b.retr-a.retr AS retracted_area, 3.0*(a.endok-b.endok) AS endpoint_scaled
 FROM gd a JOIN gd b ON a.video_id=b.video_id AND a.seed=b.seed AND a.system_id<b.system_id)"""
PC = with_base(grid(3.0), DRAWS) + _PC


def contrasts(spark, sf):
    return G.paired_contrasts(clips(spark, sf), 3.0)


@query("g14_paired_contrasts", PC + " SELECT system_a, system_b, count(*)::BIGINT AS n, " + ", ".join(f"round(avg({c})::DOUBLE,6) AS {c}" for c in G.CONTRASTS) + ", sum((abs(advantage-common_success-success_set_mismatch)>1e-10)::INT)::BIGINT AS violations FROM pc GROUP BY ALL")
def g14(spark, sf):
    c = contrasts(spark, sf)
    bad = F.abs(F.col("advantage") - F.col("common_success") - F.col("success_set_mismatch")) > 1e-10
    return c.groupBy("system_a", "system_b").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(k)).alias(k) for k in G.CONTRASTS], F.sum(bad.cast("bigint")).alias("violations"))


@query("g15_endpoint_strata", PC + " SELECT system_a, system_b, round(avg((ca=1 AND cb=1)::INT),6) AS p11, round(avg((ca=1 AND cb=0)::INT),6) AS p10, round(avg((ca=0 AND cb=1)::INT),6) AS p01, round(avg((ca=0 AND cb=0)::INT),6) AS p00 FROM pc GROUP BY ALL")
def g15(spark, sf):
    a, b = F.col("ca"), F.col("cb")
    strata = {"p11": a & b, "p10": a & ~b, "p01": ~a & b, "p00": ~a & ~b}
    return contrasts(spark, sf).groupBy("system_a", "system_b").agg(*[r6(F.avg(c.cast("int"))).alias(k) for k, c in strata.items()])


def contrast_band(spark, sf, guard):
    keys = ["system_a", "system_b"]
    c = contrasts(spark, sf)
    pts = G.melt(c.groupBy(*keys).agg(*[F.avg(k).alias(k) for k in G.CONTRASTS]), keys, {k: k for k in G.CONTRASTS}, "contrast", "value")
    sums = G.cluster_sums(c, keys, {k: F.col(k) for k in G.CONTRASTS})
    reps = G.melt(G.replicate_means(sums, draws(spark, sf), keys, G.CONTRASTS), [*keys, "b"], {k: f"{k}_micro" for k in G.CONTRASTS}, "contrast", "value")
    df = None
    if guard:
        df = clips(spark, sf).select("source_cluster_id").distinct().agg((F.count(F.lit(1)) - 1).cast("double")).scalar()
    return G.simultaneous_band(pts, reps, [*keys, "contrast"], df=df)


_BAND = PC + """, pl AS (SELECT system_a, system_b, contrast, avg(v) AS point FROM (SELECT system_a, system_b, advantage::DOUBLE AS advantage, common_success::DOUBLE AS common_success, success_set_mismatch::DOUBLE AS success_set_mismatch, error_area::DOUBLE AS error_area, retracted_area::DOUBLE AS retracted_area, endpoint_scaled::DOUBLE AS endpoint_scaled FROM pc) UNPIVOT (v FOR contrast IN (advantage, common_success, success_set_mismatch, error_area, retracted_area, endpoint_scaled)) GROUP BY ALL),
ps1 AS (SELECT system_a, system_b, source_cluster_id, count(*) AS n, """ + ", ".join(f"sum({c})::DOUBLE AS {c}" for c in G.CONTRASTS) + """ FROM pc GROUP BY ALL),
rp AS (SELECT system_a, system_b, b, """ + ", ".join(f"sum(w*{c})/sum(w*n) AS {c}" for c in G.CONTRASTS) + """ FROM ps1 JOIN wt USING (source_cluster_id) GROUP BY ALL),
rl AS (SELECT * FROM rp UNPIVOT (v FOR contrast IN (advantage, common_success, success_set_mismatch, error_area, retracted_area, endpoint_scaled))),
se AS (SELECT system_a, system_b, contrast, stddev_samp(v) AS se FROM rl GROUP BY ALL),
zz AS (SELECT b, max(abs(v-point)/(CASE WHEN se<1e-12 THEN 1 ELSE se END)) AS z FROM rl JOIN pl USING (system_a, system_b, contrast) JOIN se USING (system_a, system_b, contrast) GROUP BY ALL), cr AS (SELECT quantile_cont(z,0.95) AS c FROM zz)"""


@query("g16_simultaneous_band", _BAND + " SELECT system_a, system_b, contrast, round(point,6) AS point, round(se,6) AS se, round(c,4) AS critical, round(point-c*(CASE WHEN se<1e-12 THEN 0 ELSE se END),5) AS lower, round(point+c*(CASE WHEN se<1e-12 THEN 0 ELSE se END),5) AS upper, (se<1e-12) AS zero_variance FROM pl JOIN se USING (system_a, system_b, contrast), cr")
def g16(spark, sf):
    b = contrast_band(spark, sf, False)
    return b.select("system_a", "system_b", "contrast", r6("value").alias("point"), r6("se").alias("se"), F.round("critical", 4).alias("critical"), F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"), "zero_variance")


@query("g16_guarded_band")
def g16t(spark, sf):
    """The same band with the Student guard on its critical value."""
    b = contrast_band(spark, sf, True)
    return b.select("system_a", "system_b", "contrast", "value", "se", "bootstrap_critical", "guard", "critical", "lower", "upper", "zero_variance")


_CLASSWISE = ", ".join(f"sum({c})::DOUBLE AS {c}" for c in G.CONTRASTS)
_MACRO = with_base(grid(3.0), DRAWS.replace(f"range(0,{N_BOOT}) q(b)", f"range(0,{8 * N_BOOT}) q(b)")) + _PC + f""", cc AS (SELECT DISTINCT source_cluster_id, y FROM gc), sb AS (SELECT b, count(DISTINCT y) AS c FROM wt JOIN cc USING (source_cluster_id) GROUP BY ALL), so AS (SELECT b, c=(SELECT count(DISTINCT y) FROM cc) AS ok FROM sb),
sr AS (SELECT b, ok, sum(ok::INT) OVER (ORDER BY b) AS r, sum((NOT ok)::INT) OVER (ORDER BY b) AS bad FROM so), ws AS (SELECT b, source_cluster_id, w FROM wt JOIN (SELECT b FROM sr WHERE ok AND r<={N_BOOT}) USING (b)), rj AS (SELECT max(bad)::BIGINT AS n_rejected FROM sr WHERE ok AND r<={N_BOOT}),
py AS (SELECT system_a, system_b, y, source_cluster_id, count(*) AS n, {_CLASSWISE} FROM pc GROUP BY ALL),
pl AS (SELECT system_a, system_b, contrast, avg(v) AS point FROM (SELECT system_a, system_b, y, """ + ", ".join(f"sum({c})/sum(n) AS {c}" for c in G.CONTRASTS) + f""" FROM py GROUP BY ALL) UNPIVOT (v FOR contrast IN ({', '.join(G.CONTRASTS)})) GROUP BY ALL),
ry AS (SELECT system_a, system_b, b, y, """ + ", ".join(f"sum(w*{c})/sum(w*n) AS {c}" for c in G.CONTRASTS) + f""" FROM py JOIN ws USING (source_cluster_id) GROUP BY ALL),
rl AS (SELECT system_a, system_b, b, contrast, avg(v) AS v FROM ry UNPIVOT (v FOR contrast IN ({', '.join(G.CONTRASTS)})) GROUP BY ALL),
se AS (SELECT system_a, system_b, contrast, stddev_samp(v) AS se FROM rl GROUP BY ALL),
zz AS (SELECT b, max(abs(v-point)/(CASE WHEN se<1e-12 THEN 1 ELSE se END)) AS z FROM rl JOIN pl USING (system_a, system_b, contrast) JOIN se USING (system_a, system_b, contrast) GROUP BY ALL), cr AS (SELECT quantile_cont(z,0.95) AS c FROM zz)"""


@query("g16_macro_band", _MACRO + " SELECT system_a, system_b, contrast, round(point,6) AS point, round(se,6) AS se, round(c,4) AS critical, round(point-c*(CASE WHEN se<1e-12 THEN 0 ELSE se END),5) AS lower, round(point+c*(CASE WHEN se<1e-12 THEN 0 ELSE se END),5) AS upper, (se<1e-12) AS zero_variance, n_rejected FROM pl JOIN se USING (system_a, system_b, contrast), cr, rj")
def g16m(spark, sf):
    """The band of class averages, on replicates that support every class; those passed over are counted."""
    keys = ["system_a", "system_b"]
    c = contrasts(spark, sf)
    per = c.groupBy(*keys, "class_code").agg(*[F.avg(k).alias(k) for k in G.CONTRASTS]).groupBy(*keys).agg(*[F.avg(k).alias(k) for k in G.CONTRASTS])
    pts = G.melt(per, keys, {k: k for k in G.CONTRASTS}, "contrast", "value")
    cc = clips(spark, sf).select("source_cluster_id", "class_code").distinct()
    w, rejected = G.packed_supported(cc.select("source_cluster_id").distinct(), cc, N_BOOT, SEED)
    reps = G.replicate_means(G.cluster_sums(c, keys, {k: F.col(k) for k in G.CONTRASTS}), w, keys, G.CONTRASTS)
    reps = G.melt(reps, [*keys, "b"], {k: f"{k}_macro" for k in G.CONTRASTS}, "contrast", "value")
    b = G.simultaneous_band(pts, reps, [*keys, "contrast"]).withColumn("n_rejected", rejected.scalar())
    return b.select(*keys, "contrast", r6("value").alias("point"), r6("se").alias("se"), F.round("critical", 4).alias("critical"), F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"), "zero_variance", "n_rejected")


READS = [Protocol(s, 0.0, d, 2.0) for s in (-0.5, 0.0, 0.5) for d in (0.5, 1.0)]


@query("g17_robust_verdict")
def g17(spark, sf):
    """Pairs of same-seed base systems over six readings of one raw-clip cohort, at three margins."""
    m = manifest(spark, sf, "test").filter((F.col("anchor_s") >= 0.5 - TOL) & (F.col("post_anchor_length_s") >= 2.5 - TOL)).select("video_id")
    read = stage(spark, sf, "robust_reads", lambda: clips_for(spark, sf, READS).filter(F.col("system_id").rlike("^(clip|prefix)")).join(m, "video_id"))
    c = read.withColumn("seed", F.regexp_extract("system_id", r"seed(\d+)", 1))
    cols = ["pi_hash", "seed", "video_id"]
    a = c.select(*cols, "source_cluster_id", "class_code", F.col("system_id").alias("system_a"), F.col("delay").alias("da"))
    b = c.select(*cols, F.col("system_id").alias("system_b"), F.col("delay").alias("db"))
    keys = ["system_a", "system_b", "pi_hash"]
    p = a.join(b, cols).filter("system_a < system_b").withColumn("adv", F.col("db") - F.col("da"))
    pts = p.groupBy(*keys).agg(F.avg("adv").alias("value"))
    w = G.packed_draws(p.select("source_cluster_id"), N_BOOT, SEED)
    reps = G.replicate_means(G.cluster_sums(p, keys, {"adv": F.col("adv")}), w, keys, ["adv"]).select(*keys, "b", F.col("adv_micro").alias("value"))
    df = p.select("source_cluster_id").distinct().agg((F.count(F.lit(1)) - 1).cast("double")).scalar()
    band = G.simultaneous_band(pts, reps, keys, df=df)
    g = band.groupBy("system_a", "system_b").agg(
        F.min("lower").alias("lo_min"), F.max("lower").alias("lo_max"), F.min("upper").alias("hi_min"), F.max("upper").alias("hi_max"), F.min("value").alias("v_min"), F.max("value").alias("v_max"))
    g = g.withColumn("margin", F.explode(F.array(F.lit(0.0), F.lit(0.125), F.lit(0.25))))
    status = G.robust_status(F.col("lo_min"), F.col("lo_max"), F.col("hi_min"), F.col("hi_max"), F.col("margin"))
    return g.select("system_a", "system_b", "margin", status.alias("status"), "v_min", "v_max", ((F.col("v_min") < -1e-10) & (F.col("v_max") > 1e-10)).alias("point_sign_reversal"))


_CUTS = "ct AS (SELECT quantile_cont(post_anchor_length_s, 0.3333333333333333::DOUBLE) AS c1, quantile_cont(post_anchor_length_s, 0.6666666666666666::DOUBLE) AS c2 FROM man WHERE split='dev' AND post_anchor_length_s>=2.0-1e-9)"
_STRATA = "sg AS (SELECT gc.*, CASE WHEN len<=c1 THEN 0 WHEN len<=c2 THEN 1 ELSE 2 END AS st FROM gc, ct)"


def cuts(spark, sf):
    d = manifest(spark, sf, "dev").filter(F.col("post_anchor_length_s") >= 2.0 - TOL)
    return exact_quantiles(d, [], "post_anchor_length_s", [1 / 3, 2 / 3]).select(F.get("q", F.lit(0)).alias("c1"), F.get("q", F.lit(1)).alias("c2"))


def strata(spark, sf):
    return G.with_terciles(clips(spark, sf, 2.0), cuts(spark, sf), "post_anchor_length_s")


@query("g18_tercile_gap", with_base(grid(2.0), _CUTS, _STRATA) + " SELECT system_id, sum((st=0)::INT)::BIGINT AS n_short, sum((st=2)::INT)::BIGINT AS n_long, round(avg(CASE WHEN st=2 THEN delay END)-avg(CASE WHEN st=0 THEN delay END),6) AS gap FROM sg GROUP BY ALL")
def g18(spark, sf):
    s = F.col("stratum")
    return strata(spark, sf).groupBy("system_id").agg(
        F.sum((s == 0).cast("bigint")).alias("n_short"), F.sum((s == 2).cast("bigint")).alias("n_long"),
        r6(F.avg(F.when(s == 2, F.col("delay"))) - F.avg(F.when(s == 0, F.col("delay")))).alias("gap"))


def gap_samples(spark, sf):
    c = strata(spark, sf)
    w = G.packed_draws(c.select("source_cluster_id"), N_BOOT, SEED)
    long_, short = F.col("stratum") == 2, F.col("stratum") == 0
    s = c.groupBy("system_id", "source_cluster_id").agg(
        F.sum(long_.cast("int")).alias("nl"), F.sum(F.when(long_, F.col("delay")).otherwise(0.0)).alias("dl"),
        F.sum(short.cast("int")).alias("ns"), F.sum(F.when(short, F.col("delay")).otherwise(0.0)).alias("ds"))
    r = G.replicate_sums(s, w, ["system_id"], ["nl", "dl", "ns", "ds"])
    return r.select("system_id", "b", (mean_ratio(F.col("dl"), F.col("nl")) - mean_ratio(F.col("ds"), F.col("ns"))).alias("value"))


@query("g19_gap_interval", with_base(grid(2.0), _CUTS, _STRATA, DRAWS) + ", gs1 AS (SELECT system_id, b, sum(CASE WHEN st=2 THEN w*delay ELSE 0 END)/nullif(sum(CASE WHEN st=2 THEN w ELSE 0 END),0) - sum(CASE WHEN st=0 THEN w*delay ELSE 0 END)/nullif(sum(CASE WHEN st=0 THEN w ELSE 0 END),0) AS v FROM sg JOIN wt USING (source_cluster_id) GROUP BY ALL) SELECT system_id, round(quantile_cont(v,0.025),6) AS ci_lo, round(quantile_cont(v,0.975),6) AS ci_hi, count(v)::BIGINT AS n_valid FROM gs1 GROUP BY ALL")
def g19(spark, sf):
    i = G.percentile_interval(gap_samples(spark, sf), ["system_id"], floor=0.0)
    return i.select("system_id", r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"), "n_valid")


# Fixed value: two-sided 5% normal quantile used for planning.
Z = 1.959963984540054


_THIN = "string_agg(CASE WHEN {0} THEN 'class_'||class_code END, ',' ORDER BY class_code)"


@query("g21_sample_planning", with_base() + f""", h(h_s) AS (VALUES (2.0::DOUBLE),(3.0::DOUBLE),(4.0::DOUBLE)), v AS (SELECT DISTINCT class_code FROM man), e AS (SELECT h_s, man.* FROM man, h WHERE split='test' AND post_anchor_length_s>=h_s-1e-9),
c AS (SELECT h_s, count(DISTINCT source_cluster_id) AS k FROM e GROUP BY ALL), n AS (SELECT h.h_s, v.class_code, count(e.video_id) AS n FROM h CROSS JOIN v LEFT JOIN e ON e.h_s=h.h_s AND e.class_code=v.class_code GROUP BY ALL),
t AS (SELECT h_s, coalesce({_THIN.format('n=0')}, '') AS empty_classes, coalesce({_THIN.format('n>0 AND n<60')}, '') AS thin_classes FROM n GROUP BY ALL)
SELECT h_s, k::BIGINT AS n_clusters, round({Z}*sqrt(0.25/k),6) AS half_width, round({Z}*sqrt(0.5/k),6) AS half_width_difference, ceil(0.5*({Z}/0.1)*({Z}/0.1))::BIGINT AS n_required, (k>=ceil(0.5*({Z}/0.1)*({Z}/0.1))) AS floor_met, empty_classes, thin_classes FROM c JOIN t USING (h_s)""")
def g21(spark, sf):
    """Clusters needed to resolve 0.1 in S_H, and the manifest's classes below 60 clips, per horizon."""
    horizons = F.explode(F.array(*[F.lit(h) for h in D.HORIZONS])).alias("h_s")
    m = manifest(spark, sf, "test").select("*", horizons).filter(F.col("post_anchor_length_s") >= F.col("h_s") - TOL)
    per = m.groupBy("h_s", "source_cluster_id", "class_code").agg(F.count(F.lit(1)).alias("n"))
    k = per.groupBy("h_s", "source_cluster_id").agg(F.count(F.lit(1)).alias("n")).groupBy("h_s").agg(F.count(F.lit(1)).alias("n_clusters"))
    every = manifest(spark, sf).select("class_code").distinct().select("*", horizons)
    n = every.join(per.groupBy("h_s", "class_code").agg(F.sum("n").alias("n")), ["h_s", "class_code"], "left").fillna(0, ["n"])
    def names(test):
        order = F.array_sort(F.collect_list(F.when(test, F.struct("class_code"))))
        return F.array_join(F.transform(order, lambda c: F.concat(F.lit("class_"), c["class_code"].cast("string"))), ",")
    t = n.groupBy("h_s").agg(names(F.col("n") == 0).alias("empty_classes"), names((F.col("n") > 0) & (F.col("n") < 60)).alias("thin_classes"))
    need = F.ceil(F.lit(0.5 * (Z / 0.1) * (Z / 0.1)))
    return k.join(t, "h_s").select("h_s", "n_clusters", r6(Z * F.sqrt(0.25 / F.col("n_clusters"))).alias("half_width"), r6(Z * F.sqrt(0.5 / F.col("n_clusters"))).alias("half_width_difference"),
                                   need.alias("n_required"), (F.col("n_clusters") >= need).alias("floor_met"), "empty_classes", "thin_classes")


@query("g22_contrast_support", PC + " SELECT system_a, system_b, " + ", ".join(f"count(DISTINCT CASE WHEN abs({c})>1e-12 THEN source_cluster_id END)::BIGINT AS {c}" for c in G.CONTRASTS) + " FROM pc GROUP BY ALL")
def g22(spark, sf):
    """Clusters in which a contrast is not zero."""
    c = contrasts(spark, sf)
    per = c.groupBy("system_a", "system_b", "source_cluster_id").agg(*[F.max((F.abs(k) > 1e-12).cast("int")).alias(k) for k in G.CONTRASTS])
    return per.groupBy("system_a", "system_b").agg(*[F.sum(F.col(k).cast("bigint")).alias(k) for k in G.CONTRASTS])

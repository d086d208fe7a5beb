"""Phenomena, report only (survey section 2.E)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast.functions.exprs import TOL, mean_ratio, r6
from holdfast.operators import trajectory as T
from holdfast.plans.common import cells, clips, event_clips, manifest
from holdfast.plans.oracle import grid, with_base
from holdfast.plans.registry import query
from holdfast.sources import derive as D

CONF, SHORT, PRE = 0.9, 1.0, 1.5
H3 = with_base(grid(3.0))


def quantiles(c, name):
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.count(c).alias(f"{name}_n"), r6(F.avg(c)).alias(f"{name}_mean"), *[r6(F.get(q, F.lit(i))).alias(f"{name}_{n}") for i, n in enumerate(("p25", "median", "p75"))]]


def _q(c, name):
    return f"count({c})::BIGINT AS {name}_n, round(avg({c}),6) AS {name}_mean, round(quantile_cont({c}::DOUBLE,0.25),6) AS {name}_p25, round(quantile_cont({c}::DOUBLE,0.5),6) AS {name}_median, round(quantile_cont({c}::DOUBLE,0.75),6) AS {name}_p75"


@query("e01_flip_statistics", H3 + ", lf AS (SELECT system_id, video_id, max(CASE WHEN prev<>pred THEN j END)*0.5::DOUBLE AS lf FROM gs GROUP BY ALL) SELECT system_id, round(avg((flips>0)::INT),6) AS flip_rate, " + _q("flips", "flips") + ", " + _q("lf", "last_flip") + " FROM gc JOIN lf USING (system_id, video_id) GROUP BY ALL")
def e01(spark, sf):
    return clips(spark, sf).groupBy("system_id").agg(
        r6(F.avg((F.col("flips") > 0).cast("int"))).alias("flip_rate"), *quantiles(F.col("flips"), "flips"), *quantiles(F.col("last_flip_j") * F.col("delta_s"), "last_flip"))


@query("e02_correct_wrong_correct", H3 + ", a AS (SELECT system_id, video_id, j, ok, max(ok::INT) OVER (PARTITION BY system_id, video_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(ok::INT) OVER (PARTITION BY system_id, video_id ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM g), c AS (SELECT system_id, video_id, max((NOT ok AND before=1 AND later=1)::INT) AS cwc FROM a GROUP BY ALL) SELECT system_id, round(avg(coalesce(cwc,0)),6) AS cwc_rate, sum(coalesce(cwc,0))::BIGINT AS n_cwc FROM c GROUP BY ALL")
def e02(spark, sf):
    c = F.col("cwc").cast("bigint")
    return clips(spark, sf).groupBy("system_id").agg(r6(F.avg(c)).alias("cwc_rate"), F.sum(c).alias("n_cwc"))


@query("e03_terminal_agreement", H3 + ", a AS (SELECT system_id, video_id, j, min((pred=term)::INT) OVER (PARTITION BY system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM gs), t AS (SELECT system_id, video_id, min(CASE WHEN m=1 THEN j END)*0.5::DOUBLE AS t FROM a GROUP BY ALL) SELECT system_id, " + _q("t", "first_terminal") + " FROM t GROUP BY ALL")
def e03(spark, sf):
    return clips(spark, sf).groupBy("system_id").agg(*quantiles(F.col("first_term_j") * F.col("delta_s"), "first_terminal"))


@query("e04_prefix_agreement", H3 + " SELECT system_id, round(avg(((pred=term)=ok)::INT),6) AS k1, round(avg((pred=term)::INT),6) AS equals_terminal, round(avg(ok::INT),6) AS equals_truth FROM gs GROUP BY ALL")
def e04(spark, sf):
    return cells(spark, sf).groupBy("system_id").agg(
        r6(F.avg(((F.col("pred") == F.col("term")) == F.col("ok")).cast("int"))).alias("k1"),
        r6(F.avg((F.col("pred") == F.col("term")).cast("int"))).alias("equals_terminal"), r6(F.avg(F.col("ok").cast("int"))).alias("equals_truth"))


@query("e05_lost_correct_prefix", H3 + ", c AS (SELECT system_id, video_id, max(ok::INT) AS ever, max(CASE WHEN j=6 THEN ok::INT END) AS e FROM g GROUP BY ALL) SELECT system_id, round(avg(CASE WHEN e=0 THEN ever END),6) AS k3, sum((e=0)::INT)::BIGINT AS n_terminal_wrong FROM c GROUP BY ALL")
def e05(spark, sf):
    wrong = F.col("end_ok") == 0
    return clips(spark, sf).groupBy("system_id").agg(
        r6(F.avg(F.when(wrong, F.col("fc").isNotNull().cast("int")))).alias("k3"), F.sum(wrong.cast("bigint")).alias("n_terminal_wrong"))


@query("e06_max_probability", H3 + " SELECT system_id, j, round(avg(list_max(probs)),6) AS mean_msp, count(probs)::BIGINT AS n_available FROM g GROUP BY ALL")
def e06(spark, sf):
    msp = F.array_max(F.array_compact("probs"))
    return cells(spark, sf, probs=True).groupBy("system_id", "j").agg(r6(F.avg(msp)).alias("mean_msp"), F.count(msp).alias("n_available"))


_K5 = ", k AS (SELECT *, coalesce(list_max(probs)>=0.9::DOUBLE,false) AS conf FROM gs WHERE j<=2), kv AS (SELECT system_id, video_id, sum(conf::INT) AS n, sum((conf AND pred<>term)::INT) AS bad FROM k GROUP BY ALL)"


@query("e07_confident_inconsistency", H3 + _K5 + " SELECT system_id, sum(n)::BIGINT AS confident_cells, round(sum(bad)::DOUBLE/nullif(sum(n),0),6) AS k5_cell, round(CASE WHEN sum(n)>0 THEN avg((bad>0)::INT) END,6) AS k5_video FROM kv GROUP BY ALL")
def e07(spark, sf):
    c = cells(spark, sf, probs=True).filter(F.col("j") * F.col("delta_s") <= SHORT + TOL)
    conf = F.coalesce(F.array_max("probs") >= CONF, F.lit(False))
    per = c.groupBy("system_id", "video_id").agg(F.sum(conf.cast("int")).alias("n"), F.sum((conf & (F.col("pred") != F.col("term"))).cast("int")).alias("bad"))
    return per.groupBy("system_id").agg(
        F.sum("n").alias("confident_cells"), r6(mean_ratio(F.sum("bad"), F.sum("n"))).alias("k5_cell"),
        r6(F.when(F.sum("n") > 0, F.avg((F.col("bad") > 0).cast("int")))).alias("k5_video"))


_PRE = """, pa AS (SELECT gc.system_id, gc.video_id, gc.endok, a.pred, list_max(a.probs) AS m FROM gc CROSS JOIN range(-3,0) x(j) LEFT JOIN ans a ON a.system_id=gc.system_id AND a.video_id=gc.video_id AND a.j=x.j),
pv AS (SELECT system_id, video_id, any_value(endok) AS e, max(coalesce(pred>=0,false)::INT) AS answered, sum(coalesce(pred>=0 AND m>=0.9::DOUBLE,false)::INT) AS hi, sum((pred IS NOT NULL)::INT) AS av FROM pa GROUP BY ALL)"""


def pre_anchor(spark, sf):
    """Per (system, clip): answered before the anchor, confident cells, available cells, and the final outcome."""
    a = D.answers(D.before_anchor(event_clips(spark, sf))).filter(F.col("j") * D.DELTA >= -PRE - TOL)
    hit = (F.col("pred") >= 0) & (F.array_max("probs") >= CONF)
    per = a.groupBy("system_id", "video_id").agg(
        F.max((F.col("pred") >= 0).cast("int")).alias("answered"), F.sum(F.coalesce(hit, F.lit(False)).cast("int")).alias("hi"), F.count(F.lit(1)).alias("av"))
    return clips(spark, sf).select("system_id", "video_id", "end_ok").join(per, ["system_id", "video_id"], "left").fillna(0, ["answered", "hi", "av"])


@query("e08_pre_anchor_overconfidence", H3 + _PRE + " SELECT system_id, sum(av)::BIGINT AS cells_available, round(avg(answered),6) AS answer_rate, sum(hi)::BIGINT AS confident_cells, round(CASE WHEN sum(hi)>0 THEN avg((hi>0 AND e=0)::INT) END,6) AS confident_finally_wrong, round(CASE WHEN sum(hi)>0 THEN avg((hi>0 AND e=1)::INT) END,6) AS confident_finally_correct FROM pv GROUP BY ALL")
def e08(spark, sf):
    any_hi = F.col("hi") > 0
    def rate(end):
        return r6(F.when(F.sum("hi") > 0, F.avg((any_hi & (F.col("end_ok") == end)).cast("int"))))
    return pre_anchor(spark, sf).groupBy("system_id").agg(
        F.sum("av").alias("cells_available"), r6(F.avg("answered")).alias("answer_rate"), F.sum("hi").alias("confident_cells"),
        rate(0).alias("confident_finally_wrong"), rate(1).alias("confident_finally_correct"))


_K6 = """, a AS (SELECT system_id, video_id, j, stable, min((pred=term)::INT) OVER (PARTITION BY system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM gs),
t AS (SELECT system_id, video_id, min(CASE WHEN m=1 THEN j END)*0.5::DOUBLE AS tt, coalesce(min(CASE WHEN stable=1 THEN j END)*0.5::DOUBLE, 3.0::DOUBLE) AS ts FROM a GROUP BY ALL),
v AS (SELECT DISTINCT system_id, tt AS v FROM t UNION SELECT DISTINCT system_id, ts FROM t),
kd AS (SELECT v.system_id, v.v, avg((t.tt<=v.v)::INT) AS f1, avg((t.ts<=v.v)::INT) AS f2 FROM v JOIN t USING (system_id) GROUP BY ALL), ks AS (SELECT system_id, max(abs(f1-f2)) AS k FROM kd GROUP BY ALL)"""


def _terminal_vs_stable(spark, sf):
    h = F.col("steps") * F.col("delta_s")
    return clips(spark, sf).select("system_id", (F.col("first_term_j") * F.col("delta_s")).alias("tt"), F.coalesce(F.col("onset_j") * F.col("delta_s"), h).alias("ts"))


@query("e09_terminal_vs_stable", H3 + _K6 + " SELECT t.system_id, " + _q("tt-ts", "diff") + ", round(any_value(k),6) AS ks_statistic FROM t JOIN ks USING (system_id) GROUP BY t.system_id")
def e09(spark, sf):
    """Paired difference of the two onset times, and the two-sample KS distance from their grid tallies."""
    t = _terminal_vs_stable(spark, sf)
    both = t.select("system_id", F.col("tt").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(t.select("system_id", F.col("ts").alias("v"), F.lit(0), F.lit(1)))
    tally = both.groupBy("system_id", "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    g = Window.partitionBy("system_id")
    run = g.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("x").over(run) / F.sum("x").over(g) - F.sum("y").over(run) / F.sum("y").over(g))
    ks = tally.withColumn("gap", gap).groupBy("system_id").agg(r6(F.max("gap")).alias("ks_statistic"))
    return t.groupBy("system_id").agg(*quantiles(F.col("tt") - F.col("ts"), "diff")).join(ks, "system_id")


@query("e10_phenomena_table", H3 + _K5 + _PRE + """, f AS (SELECT system_id, count(*)::BIGINT AS n_h, avg((flips>0)::INT) AS fr FROM gc GROUP BY ALL), l AS (SELECT system_id, median(l) AS lm FROM (SELECT system_id, video_id, max(CASE WHEN prev<>pred THEN j END)*0.5::DOUBLE AS l FROM gs GROUP BY ALL) GROUP BY ALL),
k1 AS (SELECT system_id, avg(((pred=term)=ok)::INT) AS k1 FROM gs GROUP BY ALL), k3 AS (SELECT system_id, avg(CASE WHEN e=0 THEN ever END) AS k3 FROM (SELECT system_id, video_id, max(ok::INT) AS ever, max(CASE WHEN j=6 THEN ok::INT END) AS e FROM g GROUP BY ALL) GROUP BY ALL),
k5 AS (SELECT system_id, sum(bad)::DOUBLE/nullif(sum(n),0) AS k5 FROM kv GROUP BY ALL), po AS (SELECT system_id, CASE WHEN sum(hi)>0 THEN avg((hi>0 AND e=0)::INT) END AS po FROM pv GROUP BY ALL)
SELECT system_id, n_h, round(fr,6) AS flip_rate, round(lm,6) AS last_flip_median_s, round(po,6) AS pre_anchor_overconfidence, round(k1,6) AS k1, round(k3,6) AS k3, round(k5,6) AS k5 FROM f JOIN l USING (system_id) JOIN k1 USING (system_id) JOIN k3 USING (system_id) JOIN k5 USING (system_id) JOIN po USING (system_id)""")
def e10(spark, sf):
    """One row per system; the clip table already carries what most columns need."""
    c = clips(spark, sf)
    flat = c.groupBy("system_id").agg(
        F.count(F.lit(1)).alias("n_h"), r6(F.avg((F.col("flips") > 0).cast("int"))).alias("flip_rate"),
        r6(F.percentile(F.col("last_flip_j") * F.col("delta_s"), F.lit(0.5))).alias("last_flip_median_s"),
        r6(F.sum("n_agree") / F.sum(F.col("steps") + 1)).alias("k1"),
        r6(F.avg(F.when(F.col("end_ok") == 0, F.col("fc").isNotNull().cast("int")))).alias("k3"))
    k5 = e07(spark, sf).select("system_id", F.col("k5_cell").alias("k5"))
    pre = e08(spark, sf).select("system_id", F.col("confident_finally_wrong").alias("pre_anchor_overconfidence"))
    return flat.join(k5, "system_id").join(pre, "system_id")

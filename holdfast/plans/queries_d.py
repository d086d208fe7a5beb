"""Trajectory metrics (survey section 2.D)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast.functions.exprs import TOL, mean_ratio, r6, stable_delay
from holdfast.operators import trajectory as T
from holdfast.operators.protocol import Protocol, reference
from holdfast.operators.ranking import hot_join
from holdfast.plans.common import answers, cells, clips, clips_for, manifest, open_cells, packed
from holdfast.plans.oracle import grid, open_grid, pgrid, with_base
from holdfast.plans.registry import query
from holdfast.sources import derive as D


@query("flagship_stable_curve_rmscd", with_base(grid(3.0)) + """
SELECT system_id, j, round(avg(stable), 6) AS s_h, count(*)::BIGINT AS n_clips,
  round((SELECT avg(delay) FROM gc c WHERE c.system_id = gs.system_id), 6) AS rmscd FROM gs GROUP BY system_id, j""")
def flagship(spark, sf):
    """S_H curve and delay per system: the curve is tallied by last wrong step, the delay read off it."""
    curve = T.stable_curve(clips(spark, sf), ["system_id"])
    w = T.trapezoid_weight(F.col("j"), F.col("steps"), F.col("delta_s"))
    total = F.sum(w * (1 - F.col("s_h"))).over(Window.partitionBy("system_id"))
    return curve.select("system_id", "j", r6("s_h").alias("s_h"), "n_clips", r6(total).alias("rmscd"))


H3 = with_base(grid(3.0))


@query("d01_correctness", H3 + " SELECT system_id, j, sum(ok::INT)::BIGINT AS n_correct, count(*)::BIGINT AS n FROM g GROUP BY ALL")
def d01(spark, sf):
    return cells(spark, sf).groupBy("system_id", "j").agg(
        F.sum(F.col("ok").cast("bigint")).alias("n_correct"), F.count(F.lit(1)).alias("n"))


@query("d02_stable_correct", H3 + " SELECT system_id, video_id, j, stable::INT AS stable FROM gs")
def d02(spark, sf):
    """Reverse running AND, read off the last wrong step of each clip."""
    c = clips(spark, sf).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    return c.select("system_id", "video_id", "j", (F.col("j") > F.col("lw")).cast("int").alias("stable"))


@query("d03_s_curve", H3 + " SELECT system_id, j, round(avg(stable),6) AS s_h FROM gs GROUP BY ALL")
def d03(spark, sf):
    return T.stable_curve(clips(spark, sf), ["system_id"]).select("system_id", "j", r6("s_h").alias("s_h"))


@query("d04_s_curve_macro", H3 + " SELECT system_id, j, round(avg(s),6) AS s_h_macro FROM (SELECT system_id, y, j, avg(stable) AS s FROM gs GROUP BY ALL) GROUP BY ALL")
def d04(spark, sf):
    by_class = T.stable_curve(clips(spark, sf), ["system_id", "class_code"])
    return by_class.groupBy("system_id", "j").agg(r6(F.avg("s_h")).alias("s_h_macro"))


@query("d05_trapezoid_irregular", with_base() + """,
t AS (SELECT a.system_id, a.video_id, epoch_us(a.ts) AS t, (a.pred <> m.class_code)::INT AS wrong FROM ans a JOIN man m USING (video_id) WHERE a.j >= 0 AND m.split='test'),
x AS (SELECT *, (coalesce(t - lag(t) OVER w, 0) + coalesce(lead(t) OVER w - t, 0))/2.0::DOUBLE/1e6::DOUBLE AS wt FROM t WINDOW w AS (PARTITION BY system_id, video_id ORDER BY t))
SELECT system_id, round(sum(wt*wrong)/count(DISTINCT video_id), 3) AS mean_wrong_s, round(sum(wt)/count(DISTINCT video_id), 3) AS mean_span_s FROM x GROUP BY system_id""")
def d05(spark, sf):
    """Trapezoid on each clip's own event times, which are not evenly spaced."""
    t = answers(spark, sf).filter("j >= 0").join(manifest(spark, sf, "test").select("video_id", "class_code"), "video_id")
    t = t.select("system_id", "video_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"),
                 (F.col("pred") != F.col("class_code")).cast("int").alias("wrong"))
    per_clip = T.irregular_weights(t, ["system_id", "video_id"]).groupBy("system_id", "video_id").agg(
        F.sum(F.col("w") * F.col("wrong")).alias("a"), F.sum("w").alias("s"))
    return per_clip.groupBy("system_id").agg(F.round(F.avg("a"), 3).alias("mean_wrong_s"), F.round(F.avg("s"), 3).alias("mean_span_s"))


def _all_h(select: str, tail: str = "GROUP BY ALL") -> str:
    parts = [grid(h, name=f"g{k}") for k, h in enumerate(D.HORIZONS)]
    body = " UNION ALL ".join(f"SELECT {h}::DOUBLE AS h_s, {select} FROM g{k}c {tail}" for k, h in enumerate(D.HORIZONS))
    return with_base(*parts) + body


@query("d06_rmscd", with_base(*[grid(h, name=f"g{k}") for k, h in enumerate(D.HORIZONS)]) + "SELECT h_s, system_id, round(sum(d)/sum(n),6) AS rmscd, round(avg(d/n),6) AS rmscd_macro, round(sum(d)/sum(n)/h_s,6) AS rmscd_norm FROM (" + " UNION ALL ".join(
    f"SELECT {h}::DOUBLE AS h_s, system_id, y, sum(delay) AS d, count(*) AS n FROM g{k}c GROUP BY ALL" for k, h in enumerate(D.HORIZONS)) + ") GROUP BY h_s, system_id")
def d06(spark, sf):
    s = T.delay_summary(clips(spark, sf, None), ["h_s", "system_id"])
    return s.select("h_s", "system_id", r6("delay").alias("rmscd"), r6("delay_macro").alias("rmscd_macro"),
                    r6(F.col("delay") / F.col("h_s")).alias("rmscd_norm"))


@query("d07_flips", _all_h("system_id, round(avg(flips),6) AS mean_flips, median(flips)::DOUBLE AS median_flips, round(avg((flips>0)::INT),6) AS flip_rate"))
def d07(spark, sf):
    return clips(spark, sf, None).groupBy("h_s", "system_id").agg(
        r6(F.avg("flips")).alias("mean_flips"), F.percentile("flips", F.lit(0.5)).alias("median_flips"),
        r6(F.avg((F.col("flips") > 0).cast("int"))).alias("flip_rate"))


@query("d08_window_end_accuracy", H3 + " SELECT system_id, round(sum(e)::DOUBLE/sum(n),6) AS end_micro_acc, round(avg(e::DOUBLE/n),6) AS end_macro_acc FROM (SELECT system_id, y, sum(endok) AS e, count(*) AS n FROM gc GROUP BY ALL) GROUP BY ALL")
def d08(spark, sf):
    s = T.delay_summary(clips(spark, sf), ["system_id"])
    return s.select("system_id", r6("end_ok").alias("end_micro_acc"), r6("end_ok_macro").alias("end_macro_acc"))


@query("d09_full_clip_accuracy", with_base() + """,
f AS (SELECT s.system_id, m.video_id, m.class_code AS y, (coalesce(a.pred,-1)=m.class_code)::INT AS ok FROM man m CROSS JOIN sys s
 LEFT JOIN ans a ON a.system_id=s.system_id AND a.video_id=m.video_id AND a.j = greatest(least(floor((m.duration_s-m.anchor_s)/0.5::DOUBLE+1e-9)::INT, 8), -3) WHERE m.split='test' AND m.post_anchor_length_s >= 3.0-1e-9)
SELECT system_id, round(avg(a),6) AS full_clip_macro_acc, round(sum(s)::DOUBLE/sum(n),6) AS full_clip_micro_acc FROM (SELECT system_id, y, avg(ok) AS a, sum(ok) AS s, count(*) AS n FROM f GROUP BY ALL) GROUP BY ALL""")
def d09(spark, sf):
    m = manifest(spark, sf, "test").filter(F.col("post_anchor_length_s") >= 3.0 - TOL)
    f = T.full_clip_answers(m, packed(spark, sf), D.SYSTEM_IDS, D.DELTA, D.J_MIN, D.J_MAX)
    ok = (F.col("full_pred") == F.col("class_code")).cast("int")
    per = f.groupBy("system_id", "class_code").agg(F.avg(ok).alias("a"), F.sum(ok).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("system_id").agg(r6(F.avg("a")).alias("full_clip_macro_acc"), r6(F.sum("s") / F.sum("n")).alias("full_clip_micro_acc"))


@query("d10_stable_onset", H3 + " SELECT system_id, onset AS onset_j, count(*)::BIGINT AS n FROM gc GROUP BY ALL")
def d10(spark, sf):
    return clips(spark, sf).groupBy("system_id", "onset_j").agg(F.count(F.lit(1)).alias("n"))


@query("d11_commitment", H3 + """, k AS (SELECT system_id, video_id, min(CASE WHEN committed THEN j END) AS fj, arg_min(pred, CASE WHEN committed THEN j END) AS fp, any_value(y) AS y FROM g GROUP BY system_id, video_id)
SELECT system_id, round(avg((fj IS NOT NULL)::INT),6) AS rho, round(avg(coalesce(fj*0.5::DOUBLE, 3.0::DOUBLE)),6) AS tau_c_mean, round(median(coalesce(fj*0.5::DOUBLE,3.0::DOUBLE)),6) AS tau_c_median,
 round(avg(CASE WHEN fj IS NOT NULL THEN (fp<>y)::INT END),6) AS e_c, sum((fj IS NOT NULL)::INT)::BIGINT AS n_committed FROM k GROUP BY system_id""")
def d11(spark, sf):
    c = clips(spark, sf)
    has = F.col("commit_j").isNotNull()
    tau = F.coalesce(F.col("commit_j") * F.col("delta_s"), F.col("steps") * F.col("delta_s"))
    return c.groupBy("system_id").agg(
        r6(F.avg(has.cast("int"))).alias("rho"), r6(F.avg(tau)).alias("tau_c_mean"), r6(F.percentile(tau, F.lit(0.5))).alias("tau_c_median"),
        r6(F.avg(F.when(has, (F.col("commit_pred") != F.col("class_code")).cast("int")))).alias("e_c"),
        F.sum(has.cast("bigint")).alias("n_committed"))


@query("d12_s_at_offsets", H3 + """, q(k) AS (VALUES (0.5::DOUBLE),(1.0::DOUBLE),(3.0::DOUBLE),(5.0::DOUBLE))
SELECT s.system_id, q.k AS offset_s, round(avg(CASE WHEN q.k <= 3.0+1e-9 THEN gs.stable END),6) AS s_h FROM sys s CROSS JOIN q LEFT JOIN gs ON gs.system_id=s.system_id AND gs.j = round_even(q.k/0.5::DOUBLE,0) GROUP BY ALL""")
def d12(spark, sf):
    """Curve at requested offsets; one past the window is null, not zero."""
    c = clips(spark, sf).withColumn("offset_s", F.explode(F.array(*[F.lit(k) for k in (0.5, 1.0, 3.0, 5.0)])))
    inside = F.col("offset_s") <= F.col("h_s") + TOL
    s = F.when(inside, (F.col("lw") < F.rint(F.col("offset_s") / F.col("delta_s"))).cast("double"))
    return c.groupBy("system_id", "offset_s").agg(r6(F.avg(s)).alias("s_h"))


@query("d13_frozen_family", with_base(pgrid([reference(h) for h in D.HORIZONS])) + """
SELECT h_s, system_id, n_clips, round(rmscd,6) AS rmscd, round(s_at_1,6) AS s_at_1, round(s_at_3,6) AS s_at_3, median_flips, round(end_macro_acc,6) AS end_macro_acc FROM pgf""")
def d13(spark, sf):
    f = T.frozen_family(clips(spark, sf, None), ["h_s", "system_id"])
    return f.select("h_s", "system_id", "n_clips", r6("rmscd").alias("rmscd"), r6("s_at_1").alias("s_at_1"),
                    r6("s_at_3").alias("s_at_3"), "median_flips", r6("end_macro_acc").alias("end_macro_acc"))


SHIFTED = [Protocol(0.25, 0.25, 0.5, 2.0), Protocol(-0.5, 0.0, 1.0, 3.0), Protocol(0.5, 0.1, 0.25, 2.0)]


@query("d14_evaluation_record", with_base(pgrid(SHIFTED)) + """
SELECT pi_hash, system_id, eps_sys_s, eps_jit_sd_s, delta_s, h_s, n_clips, n_missing, round(rmscd,6) AS rmscd, round(s_at_1,6) AS s_at_1, median_flips, round(end_macro_acc,6) AS end_macro_acc FROM pgf""")
def d14(spark, sf):
    """Perturb, fix the cohort, lay the grid, look answers up by absolute time, compute."""
    c = clips_for(spark, sf, SHIFTED)
    keys = ["pi_hash", "system_id", "eps_sys_s", "eps_jit_sd_s", "delta_s", "h_s"]
    return T.frozen_family(c, keys).select(
        *keys, "n_clips", "n_missing", r6("rmscd").alias("rmscd"), r6("s_at_1").alias("s_at_1"), "median_flips", r6("end_macro_acc").alias("end_macro_acc"))


@query("d15_delay_components", _all_h("system_id, round(avg(delay),6) AS delay, round(avg(err),6) AS error, round(avg(retr),6) AS retracted, round(avg(endok),6) AS endpoint, sum((abs(delay-err-retr)>1e-10)::INT)::BIGINT AS violations"))
def d15(spark, sf):
    """Delay = ordinary error + correct answers later withdrawn."""
    c = clips(spark, sf, None)
    return c.groupBy("h_s", "system_id").agg(
        r6(F.avg("delay")).alias("delay"), r6(F.avg("err_area")).alias("error"), r6(F.avg("retr_area")).alias("retracted"),
        r6(F.avg("end_ok")).alias("endpoint"), F.sum((F.col("retr_area") < -1e-10).cast("bigint")).alias("violations"))


@query("d16_level_delay_split", H3 + """, cu AS (SELECT system_id, j, avg(stable) AS s FROM gs GROUP BY ALL), e AS (SELECT system_id, s AS se FROM cu WHERE j=6)
SELECT system_id, round(3.0*(1-any_value(se)),6) AS level_part, round(sum((CASE WHEN j IN (0,6) THEN 0.25 ELSE 0.5 END)::DOUBLE*(se-s)),6) AS delay_part, round(sum((CASE WHEN j IN (0,6) THEN 0.25 ELSE 0.5 END)::DOUBLE*(1-s)),6) AS rmscd FROM cu JOIN e USING (system_id) GROUP BY system_id""")
def d16(spark, sf):
    curve = T.stable_curve(clips(spark, sf), ["system_id"])
    w = T.trapezoid_weight(F.col("j"), F.col("steps"), F.col("delta_s"))
    last = F.max(F.when(F.col("j") == F.col("steps"), F.col("s_h")))
    span = F.max(F.col("steps") * F.col("delta_s"))
    area = F.sum(w * (1 - F.col("s_h")))
    return curve.groupBy("system_id").agg(
        r6(span * (1 - last)).alias("level_part"), r6(area - span * (1 - last)).alias("delay_part"), r6(area).alias("rmscd"))


PATTERNS = [(2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
_PAT = "pat(stride, phase) AS (VALUES " + ", ".join(f"({a},{b})" for a, b in PATTERNS) + ")"
_BND = f"""{_PAT},
b AS (SELECT gs.*, stride, phase, (j%stride=phase OR j IN (0,6)) AS seen FROM gs, pat),
bb AS (SELECT *, min((CASE WHEN seen THEN ok ELSE true END)::INT) OVER w AS slo, min((CASE WHEN seen THEN ok ELSE false END)::INT) OVER w AS shi FROM b
  WINDOW w AS (PARTITION BY stride, phase, system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
bc AS (SELECT stride, phase, system_id, video_id, sum(w*(1-slo)) AS lower, sum(w*(1-shi)) AS upper, sum(w*(1-stable)) AS fine FROM bb GROUP BY ALL)"""


def _patterned(spark, sf):
    pats = F.array(*[F.struct(F.lit(a).alias("stride"), F.lit(b).alias("phase")) for a, b in PATTERNS])
    return cells(spark, sf).withColumn("_p", F.explode(pats)).select("*", "_p.stride", "_p.phase")


def _seen():
    j = F.col("j")
    return (F.pmod(j, F.col("stride")) == F.col("phase")) | (j == 0) | (j == F.col("steps"))


@query("d17_delay_bounds", with_base(grid(3.0), _BND) + " SELECT stride, phase, system_id, round(avg(lower),6) AS lower, round(avg(upper),6) AS upper, round(avg(fine),6) AS fine, round(avg(upper-lower),6) AS width, sum((lower>fine+1e-10 OR upper<fine-1e-10)::INT)::BIGINT AS violations FROM bc GROUP BY ALL")
def d17(spark, sf):
    b = T.delay_bounds(_patterned(spark, sf), _seen())
    bad = (F.col("lower") > F.col("fine") + 1e-10) | (F.col("upper") < F.col("fine") - 1e-10)
    return b.groupBy("stride", "phase", "system_id").agg(
        r6(F.avg("lower")).alias("lower"), r6(F.avg("upper")).alias("upper"), r6(F.avg("fine")).alias("fine"),
        r6(F.avg(F.col("upper") - F.col("lower"))).alias("width"), F.sum(bad.cast("bigint")).alias("violations"))


@query("d18_coarse_vs_fine", with_base(grid(3.0), _PAT) + """,
b AS (SELECT gs.*, stride, phase FROM gs, pat WHERE (j%stride=phase OR j IN (0,6))),
bb AS (SELECT *, min(ok::INT) OVER (PARTITION BY stride, phase, system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cst,
 (coalesce(j-lag(j) OVER k,0)+coalesce(lead(j) OVER k-j,0))*0.25::DOUBLE AS cw FROM b WINDOW k AS (PARTITION BY stride, phase, system_id, video_id ORDER BY j)),
bc AS (SELECT stride, phase, system_id, video_id, sum(cw*(1-cst)) AS coarse FROM bb GROUP BY ALL)
SELECT stride, phase, bc.system_id, round(avg(coarse),6) AS naive_coarse, round(avg(delay),6) AS fine, round(avg((coarse<delay-1e-10)::INT),6) AS under_fraction, round(avg((coarse>delay+1e-10)::INT),6) AS over_fraction
FROM bc JOIN gc ON gc.system_id=bc.system_id AND gc.video_id=bc.video_id GROUP BY ALL""")
def d18(spark, sf):
    """Integrating only the observed points, against the full grid."""
    c = _patterned(spark, sf).withColumn("seen", _seen())
    keys = ["stride", "phase", "system_id", "video_id", "steps", "delta_s"]
    lw = F.coalesce(F.max(F.when(~F.col("ok"), F.col("j"))), F.lit(-1)).alias("lw")
    clw = F.coalesce(F.max(F.when(F.col("seen") & ~F.col("ok"), F.col("j"))), F.lit(-1)).alias("clw")
    g = c.groupBy(*keys).agg(lw, clw)
    # the coarse indicator drops to zero at clw and is one from the next observed point on: the next one of the phase, or the last of all
    d, after = F.col("delta_s"), F.col("clw") + 1
    nxt = F.least(after + F.pmod(F.col("phase") - after, F.col("stride")), F.col("steps"))
    coarse = F.when(F.col("clw") < 0, 0.0).when(F.col("clw") >= F.col("steps"), F.col("steps") * d).otherwise(
        (F.col("clw") + nxt) / 2.0 * d)
    g = g.withColumn("coarse", coarse).withColumn("fine", stable_delay(F.col("lw"), F.col("steps"), d))
    return g.groupBy("stride", "phase", "system_id").agg(
        r6(F.avg("coarse")).alias("naive_coarse"), r6(F.avg("fine")).alias("fine"),
        r6(F.avg((F.col("coarse") < F.col("fine") - 1e-10).cast("int"))).alias("under_fraction"),
        r6(F.avg((F.col("coarse") > F.col("fine") + 1e-10).cast("int"))).alias("over_fraction"))


@query("d19_identified_sign", with_base(grid(3.0), _BND) + """, m AS (SELECT stride, phase, system_id, avg(lower) AS lo, avg(upper) AS hi, avg(fine) AS f FROM bc GROUP BY ALL)
SELECT a.stride, a.phase, a.system_id AS system_a, b.system_id AS system_b, round(b.lo-a.hi,6) AS lower, round(b.hi-a.lo,6) AS upper, round(b.f-a.f,6) AS dense_advantage,
 (CASE WHEN b.lo-a.hi > 1e-10 THEN 1 WHEN b.hi-a.lo < -1e-10 THEN -1 ELSE 0 END)::INT AS identified_sign FROM m a JOIN m b ON a.stride=b.stride AND a.phase=b.phase AND a.system_id<b.system_id""")
def d19(spark, sf):
    """Which pairs keep their order whatever the unobserved points were."""
    m = T.delay_bounds(_patterned(spark, sf), _seen()).groupBy("stride", "phase", "system_id").agg(
        F.avg("lower").alias("lo"), F.avg("upper").alias("hi"), F.avg("fine").alias("f"))
    a, b = m.alias("a"), m.alias("b")
    p = a.join(b, (F.col("a.stride") == F.col("b.stride")) & (F.col("a.phase") == F.col("b.phase")) & (F.col("a.system_id") < F.col("b.system_id")))
    lo, hi = F.col("b.lo") - F.col("a.hi"), F.col("b.hi") - F.col("a.lo")
    return p.select(F.col("a.stride").alias("stride"), F.col("a.phase").alias("phase"), F.col("a.system_id").alias("system_a"), F.col("b.system_id").alias("system_b"),
                    r6(lo).alias("lower"), r6(hi).alias("upper"), r6(F.col("b.f") - F.col("a.f")).alias("dense_advantage"),
                    F.when(lo > 1e-10, 1).when(hi < -1e-10, -1).otherwise(0).alias("identified_sign"))


_OWN = """, oi AS (SELECT *, least(floor(len/0.5::DOUBLE+1e-9)::INT, 8) AS lastj FROM o),
os AS (SELECT *, min(ok::INT) OVER (PARTITION BY system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS st FROM oi WHERE j <= lastj),
oc AS (SELECT system_id, video_id, any_value(y) AS y, any_value(len) AS len, any_value(lastj) AS lastj,
 sum((CASE WHEN lastj=0 THEN 0.0 WHEN j IN (0,lastj) THEN 0.25 ELSE 0.5 END)::DOUBLE*(1-st)) AS delay, max(CASE WHEN j=lastj THEN ok::INT END) AS endok, min(CASE WHEN st=1 THEN j END) AS onset,
 sum((NOT present)::INT)::BIGINT AS missing, count(*)::BIGINT AS n_cells FROM os GROUP BY system_id, video_id)"""


def _last_step():
    return F.least(F.floor(F.col("post_anchor_length_s") / F.col("delta_s") + TOL).cast("int"), F.col("steps"))


@query("d20_own_end_delay", with_base(open_grid()) + _OWN + " SELECT system_id, round(avg(delay),6) AS own_delay, round(avg(endok),6) AS own_end_acc, round(avg(onset*0.5::DOUBLE),6) AS mean_onset_s, count(*)::BIGINT AS n FROM oc GROUP BY ALL")
def d20(spark, sf):
    o = T.own_end(open_cells(spark, sf), _last_step())
    return o.groupBy("system_id").agg(r6(F.avg("delay")).alias("own_delay"), r6(F.avg("end_ok")).alias("own_end_acc"),
                                      r6(F.avg(F.col("onset_j") * F.col("delta_s"))).alias("mean_onset_s"), F.count(F.lit(1)).alias("n"))


@query("d21_own_visible_delay", with_base(open_grid()) + _OWN + """, v AS (SELECT *, least(len, 3.5::DOUBLE) AS vis FROM oi WHERE j*0.5::DOUBLE <= least(len, 3.5::DOUBLE)+1e-9),
vs AS (SELECT *, min(ok::INT) OVER (PARTITION BY system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS st FROM v),
vc AS (SELECT system_id, video_id, any_value(vis) AS vis, min(CASE WHEN st=1 THEN j END) AS onset, sum((NOT present)::INT) AS mi, count(*) AS n FROM vs GROUP BY ALL)
SELECT system_id, round(avg(coalesce(least(onset*0.5::DOUBLE, vis), vis)),6) AS visible_delay, sum(mi)::BIGINT AS n_missing_visible, sum(n)::BIGINT AS n_visible_cells, sum((mi>0)::INT)::BIGINT AS n_clips_with_missing FROM vc GROUP BY system_id""")
def d21(spark, sf):
    """Delay to each clip's own visible end, never-stable clips censored there; 3.5 s is the cap."""
    vis = F.least(F.col("post_anchor_length_s"), F.lit(3.5))
    o = T.own_end(open_cells(spark, sf), F.floor(vis / F.col("delta_s") + TOL).cast("int"))
    delay = F.coalesce(F.least(F.col("onset_j") * F.col("delta_s"), vis), vis)
    return o.groupBy("system_id").agg(
        r6(F.avg(delay)).alias("visible_delay"), F.sum("n_missing").alias("n_missing_visible"), F.sum("n_cells").alias("n_visible_cells"),
        F.sum((F.col("n_missing") > 0).cast("bigint")).alias("n_clips_with_missing"))


_PCE = """, pe AS (SELECT *, min((ok OR NOT inside)::INT) OVER (PARTITION BY system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS st FROM o),
pc AS (SELECT system_id, video_id, any_value(len) AS len, min(CASE WHEN st=1 THEN j END)*0.5::DOUBLE AS tts FROM pe GROUP BY ALL)"""
_DYN = """, dd AS (SELECT *, (inside AND j*0.5::DOUBLE <= 3.0+1e-9) AS judged FROM o),
de AS (SELECT *, min((ok OR NOT judged)::INT) OVER (PARTITION BY system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS st FROM dd),
dy AS (SELECT system_id, j, sum(judged::INT)::BIGINT AS risk_set, sum(inside::INT)::BIGINT AS alive, sum((judged AND st=1)::INT)::DOUBLE/nullif(sum(judged::INT),0) AS s_dyn, sum((inside AND ok)::INT)::DOUBLE/nullif(sum(inside::INT),0) AS acc FROM de GROUP BY ALL)"""


@query("d22_per_clip_end", with_base(open_grid()) + _PCE + " SELECT system_id, round(median(tts),6) AS median_time_to_stable, round(avg((tts IS NOT NULL)::INT),6) AS frac_ever_stable, count(*)::BIGINT AS n FROM pc GROUP BY ALL")
def d22(spark, sf):
    p = T.per_clip_end(open_cells(spark, sf), 3.0)
    return p.groupBy("system_id").agg(
        r6(F.percentile("time_to_stable", F.lit(0.5))).alias("median_time_to_stable"),
        r6(F.avg(F.col("time_to_stable").isNotNull().cast("int"))).alias("frac_ever_stable"), F.count(F.lit(1)).alias("n"))


@query("d23_dynamic_denominator", with_base(open_grid()) + _DYN + " SELECT system_id, j, risk_set, alive, round(s_dyn,6) AS s_dyn, round(acc,6) AS acc FROM dy")
def d23(spark, sf):
    c = T.dynamic_curve(open_cells(spark, sf), 3.0)
    return c.select("system_id", "j", "risk_set", "alive", r6("s_dyn").alias("s_dyn"), r6("acc").alias("acc"))


def _dyn_area(c, col, fill=False):
    w = F.when((F.col("j") == 0) | (F.col("j") == 6), F.col("delta_s") / 2).otherwise(F.col("delta_s"))
    v = F.coalesce(F.col(col), F.lit(0.0)) if fill else F.col(col)
    return F.sum(F.when(F.col("j") <= 6, w * v))


@query("d24_dynamic_accuracy_area", with_base(open_grid()) + _DYN + " SELECT system_id, round(sum((CASE WHEN j IN (0,6) THEN 0.25 ELSE 0.5 END)::DOUBLE*acc)/3.0,6) AS dynamic_accuracy FROM dy WHERE j<=6 GROUP BY ALL")
def d24(spark, sf):
    c = T.dynamic_curve(open_cells(spark, sf), 3.0)
    return c.groupBy("system_id").agg(r6(_dyn_area(c, "acc") / 3.0).alias("dynamic_accuracy"))


_THREE = with_base(grid(3.0), open_grid()) + _PCE + _DYN + """,
x1 AS (SELECT system_id, avg(coalesce(least(tts,3.0::DOUBLE),3.0::DOUBLE)) AS pce_rmscd, avg((tts IS NOT NULL AND tts<=1.0+1e-9)::INT) AS pce_s1 FROM pc GROUP BY ALL),
x2 AS (SELECT system_id, sum((CASE WHEN j IN (0,6) THEN 0.25 ELSE 0.5 END)::DOUBLE*(1-coalesce(s_dyn,0))) AS dyn_rmscd, max(CASE WHEN j=2 THEN s_dyn END) AS dyn_s1, max(CASE WHEN j=0 THEN risk_set END) AS n0, max(CASE WHEN j=6 THEN risk_set END) AS nh FROM dy WHERE j<=6 GROUP BY ALL),
x3 AS (SELECT system_id, avg(delay) AS fix_rmscd, avg((onset IS NOT NULL AND onset<=2)::INT) AS fix_s1 FROM gc GROUP BY ALL),
pl AS (SELECT system_id, len, coalesce(least(tts,3.0::DOUBLE),3.0::DOUBLE) AS v, median(len) OVER (PARTITION BY system_id) AS cut FROM pc),
fl AS (SELECT system_id, len, delay AS v, median(len) OVER (PARTITION BY system_id) AS cut FROM gc),
g1 AS (SELECT system_id, avg(CASE WHEN len>cut THEN v END)-avg(CASE WHEN len<=cut THEN v END) AS pce_gap FROM pl GROUP BY ALL),
g2 AS (SELECT system_id, avg(CASE WHEN len>cut THEN v END)-avg(CASE WHEN len<=cut THEN v END) AS fix_gap FROM fl GROUP BY ALL)
"""


def three_conventions(spark, sf):
    o = open_cells(spark, sf)
    p = T.per_clip_end(o, 3.0)
    x1 = p.groupBy("system_id").agg(F.avg("t_cens").alias("pce_rmscd"), F.avg(F.coalesce(F.col("time_to_stable") <= 1.0 + TOL, F.lit(False)).cast("int")).alias("pce_s1"))
    c = T.dynamic_curve(o, 3.0).filter("j <= 6")
    w = F.when((F.col("j") == 0) | (F.col("j") == 6), F.col("delta_s") / 2).otherwise(F.col("delta_s"))
    x2 = c.groupBy("system_id").agg(
        F.sum(w * (1 - F.coalesce(F.col("s_dyn"), F.lit(0.0)))).alias("dyn_rmscd"), F.max(F.when(F.col("j") == 2, F.col("s_dyn"))).alias("dyn_s1"),
        F.max(F.when(F.col("j") == 0, F.col("risk_set"))).alias("n0"), F.max(F.when(F.col("j") == 6, F.col("risk_set"))).alias("nh"))
    k = clips(spark, sf)
    x3 = k.groupBy("system_id").agg(F.avg("delay").alias("fix_rmscd"), F.avg((F.col("lw") < 2).cast("int")).alias("fix_s1"))
    g1 = T.length_gap(p, "t_cens", "post_anchor_length_s", "pce_gap")
    g2 = T.length_gap(k, "delay", "post_anchor_length_s", "fix_gap")
    return x1.join(x2, "system_id").join(x3, "system_id").join(g1, "system_id").join(g2, "system_id")


@query("d25_three_conventions", _THREE + "SELECT x1.system_id, round(pce_rmscd,6) AS pce_rmscd, round(pce_s1,6) AS pce_s1, round(dyn_rmscd,6) AS dyn_rmscd, round(dyn_s1,6) AS dyn_s1, n0, nh, round(fix_rmscd,6) AS fix_rmscd, round(fix_s1,6) AS fix_s1, round(pce_gap,6) AS pce_gap, round(fix_gap,6) AS fix_gap FROM x1 JOIN x2 USING (system_id) JOIN x3 USING (system_id) JOIN g1 USING (system_id) JOIN g2 USING (system_id)")
def d25(spark, sf):
    t = three_conventions(spark, sf)
    return t.select("system_id", "n0", "nh", *[r6(c).alias(c) for c in t.columns if c not in ("system_id", "n0", "nh")])


@query("d26_convention_ranks", _THREE + ", r AS (SELECT x1.system_id, row_number() OVER (ORDER BY round(pce_rmscd,9), x1.system_id)::INT AS rank_pce, row_number() OVER (ORDER BY round(dyn_rmscd,9), x1.system_id)::INT AS rank_dyn, row_number() OVER (ORDER BY round(fix_rmscd,9), x1.system_id)::INT AS rank_fix FROM x1 JOIN x2 USING (system_id) JOIN x3 USING (system_id)) SELECT *, (rank_pce=rank_dyn AND rank_dyn=rank_fix) AS conclusion_stable FROM r")
def d26(spark, sf):
    """Ranks over the system table, which has one row per registered system."""
    t = three_conventions(spark, sf)
    one = F.lit(0)
    def rank(c):
        return F.row_number().over(Window.partitionBy(one).orderBy(F.round(c, 9), "system_id"))
    t = t.select("system_id", rank("pce_rmscd").alias("rank_pce"), rank("dyn_rmscd").alias("rank_dyn"), rank("fix_rmscd").alias("rank_fix"))
    return t.withColumn("conclusion_stable", (F.col("rank_pce") == F.col("rank_dyn")) & (F.col("rank_dyn") == F.col("rank_fix")))


@query("d27_anchor_transitions", H3 + " SELECT system_id, round(avg((anchorok=0 AND endok=1)::INT),6) AS wrong_to_correct, round(avg((anchorok=1 AND endok=0)::INT),6) AS correct_to_wrong, round(avg((retr>0)::INT),6) AS ever_correct_then_wrong FROM gc GROUP BY ALL")
def d27(spark, sf):
    a, e = F.col("anchor_ok") == 1, F.col("end_ok") == 1
    return clips(spark, sf).groupBy("system_id").agg(
        r6(F.avg((~a & e).cast("int"))).alias("wrong_to_correct"), r6(F.avg((a & ~e).cast("int"))).alias("correct_to_wrong"),
        r6(F.avg((F.col("retr_area") > 0).cast("int"))).alias("ever_correct_then_wrong"))


_CW = ", cw AS (SELECT gc.*, 1.0::DOUBLE/count(*) OVER (PARTITION BY system_id, source_cluster_id) AS wt FROM gc)"


@query("d28_weighted_means", H3 + _CW + """, k AS (SELECT system_id, y, sum(wt) AS w, sum(wt*delay) AS wd, sum(wt*endok) AS we FROM cw GROUP BY ALL)
SELECT system_id, round(sum(wd)/sum(w),6) AS delay_micro, round(CASE WHEN min(w)>0 THEN avg(wd/w) END,6) AS delay_macro, round(sum(we)/sum(w),6) AS end_micro, round(CASE WHEN min(w)>0 THEN avg(we/w) END,6) AS end_macro, round(sum(wd)/nullif(sum(we),0),6) AS ratio_micro FROM k GROUP BY ALL""")
def d28(spark, sf):
    """Means with clip weights (here one unit per source cluster) and with equal class mass."""
    c = clips(spark, sf)
    size = c.groupBy("system_id", "source_cluster_id").agg((1.0 / F.count(F.lit(1))).alias("wt"))
    c = hot_join(c, size, ["system_id", "source_cluster_id"])
    d, e = T.weighted_mean(c, ["system_id"], "delay", "wt", "delay"), T.weighted_mean(c, ["system_id"], "end_ok", "wt", "end")
    j = d.join(e, "system_id")
    return j.select("system_id", *[r6(x).alias(x) for x in ("delay_micro", "delay_macro", "end_micro", "end_macro")],
                    r6(mean_ratio(F.col("delay_micro"), F.col("end_micro"))).alias("ratio_micro"))


@query("d29_conditional_delay", _all_h("system_id, round(avg(endok*delay)/nullif(avg(endok),0),6) AS ct, round(avg(endok),6) AS accuracy, round(avg(delay),6) AS rmscd, (abs(avg(delay) - (h_s*(1-avg(endok)) + avg(endok*delay))) > 1e-9) AS violated".replace("h_s*", "any_value(hh)*"), "GROUP BY system_id").replace(" FROM g0c", " FROM (SELECT *, 2.0 AS hh FROM g0c)").replace(" FROM g1c", " FROM (SELECT *, 3.0 AS hh FROM g1c)").replace(" FROM g2c", " FROM (SELECT *, 4.0 AS hh FROM g2c)"))
def d29(spark, sf):
    """Delay given final success, and the identity RMSCD = H(1-A) + A*CT."""
    g = clips(spark, sf, None).groupBy("h_s", "system_id").agg(
        F.avg(F.col("end_ok") * F.col("delay")).alias("x"), F.avg("end_ok").alias("a"), F.avg("delay").alias("r"))
    gap = F.abs(F.col("r") - (F.col("h_s") * (1 - F.col("a")) + F.col("x")))
    return g.select("h_s", "system_id", r6(mean_ratio(F.col("x"), F.col("a"))).alias("ct"), r6("a").alias("accuracy"), r6("r").alias("rmscd"), (gap > 1e-9).alias("violated"))


FRACTIONS = [0.1, 0.25, 0.5, 0.75, 1.0]
_FR = "fr(f) AS (VALUES " + ", ".join(f"({f}::DOUBLE)" for f in FRACTIONS) + ")"


@query("d30_relative_vs_absolute_accuracy", with_base(grid(2.0), open_grid(), _FR) + """,
e AS (SELECT * FROM o WHERE len >= 2.0-1e-9),
a1 AS (SELECT e.system_id, avg(e.ok::INT) AS afa FROM e JOIN fr ON e.j = floor(fr.f*e.len/0.5::DOUBLE+1e-9)::INT GROUP BY ALL),
a2 AS (SELECT system_id, sum((CASE WHEN j IN (0,4) THEN 0.25 ELSE 0.5 END)::DOUBLE*ok::INT)/2.0/count(DISTINCT video_id) AS aaa FROM g GROUP BY ALL)
SELECT system_id, round(afa,6) AS afa, round(aaa,6) AS aaa FROM a1 JOIN a2 USING (system_id)""")
def d30(spark, sf):
    """Mean accuracy at fractions of each clip's own length, and over absolute time."""
    o = open_cells(spark, sf).filter(F.col("post_anchor_length_s") >= 2.0 - TOL)
    reads = F.array(*[F.floor(F.lit(f) * F.col("post_anchor_length_s") / F.col("delta_s") + TOL).cast("int") for f in FRACTIONS])
    hits = F.size(F.filter(reads, lambda r: r == F.col("j")))
    w = F.when((F.col("j") == 0) | (F.col("j") == 4), F.col("delta_s") / 2).otherwise(F.col("delta_s"))
    ok = F.col("ok").cast("int")
    return o.groupBy("system_id").agg(
        r6(F.sum(hits * ok) / F.sum(hits)).alias("afa"),
        r6(F.sum(F.when(F.col("j") <= 4, w * ok)) / 2.0 / F.sum(F.when(F.col("j") == 0, 1))).alias("aaa"))


@query("d31_per_class", H3 + """, s1 AS (SELECT system_id, y, avg(CASE WHEN j=0 THEN stable END) AS s0, avg(CASE WHEN j=2 THEN stable END) AS s1 FROM gs GROUP BY ALL),
psh AS (SELECT system_id, endpred AS y, count(*)::DOUBLE AS np FROM gc GROUP BY ALL), tot AS (SELECT system_id, count(*) AS nt FROM gc GROUP BY ALL)
SELECT c.system_id, c.y AS class_code, count(*)::BIGINT AS n, round(avg(endok),6) AS accuracy, round(avg(err),6) AS error_area, round(avg(retr),6) AS retracted_area, round(avg(delay),6) AS rmscd, round(any_value(s0),6) AS s_0, round(any_value(s1),6) AS s_1,
 round(coalesce(any_value(np),0)/any_value(nt),6) AS pred_share_end
FROM gc c JOIN s1 ON s1.system_id=c.system_id AND s1.y=c.y LEFT JOIN psh p ON p.system_id=c.system_id AND p.y=c.y JOIN tot ON tot.system_id=c.system_id GROUP BY c.system_id, c.y""")
def d31(spark, sf):
    c = clips(spark, sf)
    per = c.groupBy("system_id", "class_code").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("end_ok")).alias("accuracy"), r6(F.avg("err_area")).alias("error_area"),
        r6(F.avg("retr_area")).alias("retracted_area"), r6(F.avg("delay")).alias("rmscd"),
        r6(F.avg((F.col("lw") < 0).cast("int"))).alias("s_0"), r6(F.avg((F.col("lw") < 2).cast("int"))).alias("s_1"))
    said = c.groupBy("system_id", F.col("end_pred").alias("class_code")).agg(F.count(F.lit(1)).alias("np"))
    total = c.groupBy("system_id").agg(F.count(F.lit(1)).alias("nt"))
    return per.join(said, ["system_id", "class_code"], "left").join(total, "system_id").withColumn(
        "pred_share_end", r6(F.coalesce(F.col("np"), F.lit(0)) / F.col("nt"))).drop("np", "nt")


@query("d31_confusion", H3 + " SELECT system_id, y AS class_code, endpred AS end_pred, count(*)::BIGINT AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY system_id, y),6) AS share FROM gc GROUP BY system_id, y, endpred")
def d31_confusion(spark, sf):
    """End answers of every class: one row per (system, class, answer), so any set of classes fits."""
    n = clips(spark, sf).groupBy("system_id", "class_code", "end_pred").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("system_id", "class_code").agg(F.sum("n").alias("_t"))
    return n.join(total, ["system_id", "class_code"]).select("system_id", "class_code", "end_pred", "n", r6(F.col("n") / F.col("_t")).alias("share"))


@query("d32_class_recall", H3 + " SELECT system_id, y AS class_code, round(avg(endok),6) AS recall FROM gc GROUP BY ALL")
def d32(spark, sf):
    return clips(spark, sf).groupBy("system_id", "class_code").agg(r6(F.avg("end_ok")).alias("recall"))


@query("d33_start_strata", H3 + ", st AS (SELECT gc.*, CASE WHEN m.anchor_s < 1.0 THEN 'early' WHEN m.anchor_s < 2.0 THEN 'middle' ELSE 'late' END AS stratum FROM gc JOIN man m USING (video_id)) SELECT stratum, system_id, count(*)::BIGINT AS n, round(avg(delay),6) AS delay, round(avg(err),6) AS error, round(avg(retr),6) AS retracted FROM st GROUP BY ALL")
def d33(spark, sf):
    """Components by how early in the recording the anchor falls."""
    m = manifest(spark, sf, "test").select("video_id", F.when(F.col("anchor_s") < 1.0, "early").when(F.col("anchor_s") < 2.0, "middle").otherwise("late").alias("stratum"))
    return clips(spark, sf).join(m, "video_id").groupBy("stratum", "system_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("delay")).alias("delay"), r6(F.avg("err_area")).alias("error"), r6(F.avg("retr_area")).alias("retracted"))


@query("d34_nested_cohorts", _all_h("gate AS eligible_h_s, system_id, count(*)::BIGINT AS n, round(avg(delay),6) AS rmscd", ", (VALUES (2.0::DOUBLE),(3.0::DOUBLE),(4.0::DOUBLE)) e(gate) WHERE len >= gate-1e-9 AND gate >= {h} GROUP BY gate, system_id").replace("{h}", "2.0"))
def d34(spark, sf):
    """Each horizon's delay on every cohort at least as strict."""
    c = clips(spark, sf, None).withColumn("eligible_h_s", F.explode(F.array(*[F.lit(h) for h in D.HORIZONS])))
    c = c.filter(F.col("post_anchor_length_s") >= F.col("eligible_h_s") - TOL)
    return c.groupBy("h_s", "eligible_h_s", "system_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delay")).alias("rmscd"))


GRID35 = [Protocol(delta_s=d, h_s=h) for d in (0.5, 1.0) for h in (2.0, 4.0)]


@query("d35_grid_sensitivity", with_base(pgrid(GRID35)) + " SELECT h_s, delta_s, system_id, count(*)::BIGINT AS n, round(avg(delay),6) AS rmscd, round(avg(endok),6) AS end_acc FROM pgc JOIN man m USING (video_id) WHERE m.post_anchor_length_s >= 4.0-1e-9 GROUP BY ALL")
def d35(spark, sf):
    """Horizons by output steps on one cohort, the strictest."""
    c = clips_for(spark, sf, GRID35).filter(F.col("post_anchor_length_s") >= 4.0 - TOL)
    return c.groupBy("h_s", "delta_s", "system_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delay")).alias("rmscd"), r6(F.avg("end_ok")).alias("end_acc"))


@query("d36_shifted_anchor", with_base("man2 AS (SELECT * REPLACE (anchor_s+0.5 AS anchor_s, post_anchor_length_s-0.5 AS post_anchor_length_s) FROM man WHERE split='test')") + """,
q AS (SELECT s.system_id, m.video_id, x.j, (coalesce(a.pred,-1)=m.class_code)::INT AS ok FROM man2 m CROSS JOIN sys s, range(0,7) x(j) LEFT JOIN ans a ON a.system_id=s.system_id AND a.video_id=m.video_id AND a.j=x.j+1 WHERE m.post_anchor_length_s >= 3.0-1e-9),
qs AS (SELECT *, min(ok) OVER (PARTITION BY system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS st FROM q)
SELECT system_id, count(DISTINCT video_id)::BIGINT AS n, round(sum((CASE WHEN j IN (0,6) THEN 0.25 ELSE 0.5 END)::DOUBLE*(1-st))/count(DISTINCT video_id),6) AS rmscd FROM qs GROUP BY ALL""")
def d36(spark, sf):
    """Answers recorded against the old anchor, scored against an anchor moved by one step."""
    m = manifest(spark, sf, "test").withColumn("anchor_s", F.col("anchor_s") + 0.5).withColumn("post_anchor_length_s", F.col("post_anchor_length_s") - 0.5)
    a = answers(spark, sf).withColumn("j", F.col("j") - 1)
    c = T.clips_at(m, a, D.SYSTEM_IDS, [reference(3.0)], D.DELTA)
    return c.groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delay")).alias("rmscd"))


@query("d37_input_cadence", with_base(grid(3.0)) + """, st(stride) AS (VALUES (1),(2),(3)),
h AS (SELECT st.stride, b.system_id, b.video_id, b.j, b.y, c.pred, b.w FROM gs b, st JOIN g c ON c.system_id=b.system_id AND c.video_id=b.video_id AND c.j=(b.j//st.stride)*st.stride),
hs AS (SELECT *, min((pred=y)::INT) OVER (PARTITION BY stride, system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s2 FROM h)
SELECT stride, system_id, round(sum(w*(1-s2))/count(DISTINCT video_id),6) AS rmscd, round(avg(CASE WHEN j=6 THEN (pred=y)::INT END),6) AS end_acc FROM hs GROUP BY ALL""")
def d37(spark, sf):
    """Reading inputs every 1, 2 or 3 steps and holding, scored on one output grid."""
    c = cells(spark, sf).select("system_id", "video_id", "class_code", "steps", "delta_s", "j", "pred")
    per = c.groupBy("system_id", "video_id", "class_code", "steps", "delta_s").agg(F.map_from_entries(F.collect_list(F.struct("j", "pred"))).alias("at"))
    per = per.withColumn("stride", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    held = F.try_element_at(F.col("at"), (F.floor(F.col("j") / F.col("stride")) * F.col("stride")).cast("int"))
    g = per.withColumn("ok", held == F.col("class_code")).groupBy("stride", "system_id", "video_id", "steps", "delta_s").agg(
        F.coalesce(F.max(F.when(~F.col("ok"), F.col("j"))), F.lit(-1)).alias("lw"))
    return g.groupBy("stride", "system_id").agg(
        r6(F.avg(stable_delay(F.col("lw"), F.col("steps"), F.col("delta_s")))).alias("rmscd"),
        r6(F.avg((F.col("lw") < F.col("steps")).cast("int"))).alias("end_acc"))


@query("d38_configuration_means", H3 + ", s AS (SELECT regexp_replace(system_id,'__seed[0-9]+$','') AS configuration, system_id, avg(endok) AS e, avg(err) AS er, avg(retr) AS re, avg(delay) AS d FROM gc GROUP BY ALL) SELECT configuration, count(*)::BIGINT AS n_seeds, round(avg(e),6) AS endpoint, round(avg(er),6) AS error, round(avg(re),6) AS retracted, round(avg(d),6) AS delay, round(min(d),6) AS delay_min, round(max(d),6) AS delay_max FROM s GROUP BY ALL")
def d38(spark, sf):
    s = T.delay_summary(clips(spark, sf), ["system_id"]).withColumn("configuration", F.regexp_replace("system_id", "__seed[0-9]+$", ""))
    return s.groupBy("configuration").agg(
        F.count(F.lit(1)).alias("n_seeds"), r6(F.avg("end_ok")).alias("endpoint"), r6(F.avg("err_area")).alias("error"),
        r6(F.avg("retr_area")).alias("retracted"), r6(F.avg("delay")).alias("delay"), r6(F.min("delay")).alias("delay_min"), r6(F.max("delay")).alias("delay_max"))


@query("d39_leaderboard", H3 + """, s AS (SELECT system_id, split_part(system_id,'__',1) AS track, avg(endok) AS e, avg(delay) AS d FROM gc GROUP BY ALL), r AS (SELECT *, (track='clip') AS control FROM s)
SELECT system_id, track, control, round(e,6) AS end_acc, round(d,6) AS rmscd,
 CASE WHEN NOT control THEN rank() OVER (PARTITION BY control, track ORDER BY round(e,9) DESC)::INT END AS rank_acc, CASE WHEN NOT control THEN rank() OVER (PARTITION BY control, track ORDER BY round(d,9))::INT END AS rank_rmscd FROM r""")
def d39(spark, sf):
    """Two ranks inside a track; controls are listed but not ranked."""
    s = clips(spark, sf).groupBy("system_id").agg(F.avg("end_ok").alias("e"), F.avg("delay").alias("d"))
    s = s.withColumn("track", F.split("system_id", "__")[0]).withColumn("control", F.col("track") == "clip")
    by = Window.partitionBy("control", "track")
    return s.select("system_id", "track", "control", r6("e").alias("end_acc"), r6("d").alias("rmscd"),
                    F.when(~F.col("control"), F.rank().over(by.orderBy(F.round("e", 9).desc()))).alias("rank_acc"),
                    F.when(~F.col("control"), F.rank().over(by.orderBy(F.round("d", 9)))).alias("rank_rmscd"))

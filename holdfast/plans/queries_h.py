"""Characterisation over the protocol scan (survey section 2.H)."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from holdfast.functions.exprs import TOL, ZERO, correlation, mean_ratio, r6
from holdfast.operators import arms as R
from holdfast.operators import calibration as H
from holdfast.operators import identity as I
from holdfast.operators import inference as G
from holdfast.operators import trajectory as T
from holdfast.operators.protocol import Protocol, axis_scan, neighbour_grid, plausible_grid, reference
from holdfast.operators.scan import scan_tally
from holdfast.operators.selection import spearman
from holdfast.plans import queries_g as QG
from holdfast.plans.common import packed, N_BOOT, SEED, clips, draws, family, manifest, open_cells, points, samples, scan, scan_tables, system_ids
from holdfast.plans.oracle import grid, pgrid, with_base
from holdfast.plans.queries_b import _PARSE
from holdfast.plans.queries_f import CONTROL_SQL
from holdfast.plans.registry import query
from holdfast.plans.stages import stage
from holdfast.sources import derive as D

REF = reference(3.0)
BOTH = list({p.pi_hash: p for p in axis_scan(3.0) + plausible_grid()}.values())

_LONG = """, sc AS (SELECT pi_hash, eps_sys_s, eps_jit_sd_s, delta_s, h_s, in_plaus, system_id, metric, value FROM (SELECT pi_hash, eps_sys_s, eps_jit_sd_s, delta_s, h_s, in_plaus, system_id, rmscd, s_at_1, s_at_3, end_macro_acc, median_flips FROM pgf) UNPIVOT INCLUDE NULLS (value FOR metric IN (rmscd, s_at_1, s_at_3, end_macro_acc, median_flips)))"""
_SHIFT = f", sh AS (SELECT a.*, b.h_s AS h0, a.value-b.value AS shift FROM sc a JOIN sc b ON b.pi_hash='{REF.pi_hash}' AND b.system_id=a.system_id AND b.metric=a.metric)"
# Pairs separated at the reference by their bootstrap interval.
_PAIRS = QG.TESTS.lstrip().lstrip(",") + ", sp AS (SELECT metric, system_a, system_b FROM ts WHERE ci_lo>0 OR ci_hi<0)"
_RANK = f""", df AS (SELECT a.pi_hash, a.eps_sys_s, a.eps_jit_sd_s, a.delta_s, a.h_s, a.in_plaus, sp.*, round(a.value-b.value,12) AS d FROM sp JOIN sc a ON a.metric=sp.metric AND a.system_id=sp.system_a LEFT JOIN sc b ON b.pi_hash=a.pi_hash AND b.metric=sp.metric AND b.system_id=sp.system_b),
dz AS (SELECT x.*, y.d AS d0 FROM df x JOIN df y ON y.pi_hash='{REF.pi_hash}' AND y.metric=x.metric AND y.system_a=x.system_a AND y.system_b=x.system_b),
rk AS (SELECT pi_hash, eps_sys_s, eps_jit_sd_s, delta_s, h_s, in_plaus, metric, sum((coalesce(sign(d0),0)<>0)::INT)::BIGINT AS n_pairs, sum((coalesce(sign(d0),0)<>0 AND coalesce(sign(d),0)=sign(d0))::INT)::DOUBLE/nullif(sum((coalesce(sign(d0),0)<>0)::INT),0) AS r_m FROM dz GROUP BY ALL)"""


def scan_sql(protocols, *parts):
    return with_base(pgrid(protocols), *parts) + _LONG + _SHIFT


def pair_sql(protocols):
    return with_base(pgrid(protocols), grid(3.0), QG.SAMPLES, _PAIRS) + _LONG + _SHIFT + _RANK


def scanned(spark, sf, protocols, blocks=False):
    s = scan(spark, sf).filter(F.col("pi_hash").isin([p.pi_hash for p in protocols]))
    return s if blocks else s.filter(~F.col("is_block"))


def separated(spark, sf):
    t = QG.tests(spark, sf)
    return t.filter((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)).select("metric", "system_a", "system_b")


_LIB = CONTROL_SQL + """,
ans2 AS (SELECT system_id, video_id, j, pred FROM ans UNION ALL SELECT system_id, video_id, j, pred FROM ctl), sys2 AS (SELECT system_id FROM sys UNION ALL SELECT system_id FROM ks)"""


@query("h01_protocol_scan", with_base(_LIB, pgrid(axis_scan(3.0), systems="sys2", answers="ans2")) + " SELECT pi_hash, system_id, (system_id LIKE 'block%') AS is_block, eps_sys_s, eps_jit_sd_s, delta_s, h_s, in_plaus, n_clips, n_missing, round(rmscd,6) AS rmscd, round(s_at_1,6) AS s_at_1, round(s_at_3,6) AS s_at_3, round(end_macro_acc,6) AS end_macro_acc, median_flips, CASE WHEN delta_s = 1.0 AND system_id IN (SELECT system_id FROM rrs) THEN system_id||'__stride2' ELSE system_id END AS table_used, CASE WHEN delta_s = 1.0 AND (system_id LIKE 'postproc%' OR system_id LIKE 'commit%') AND system_id NOT IN (SELECT system_id FROM rrs) THEN 'no re-run supplied, sub-sampled the finest step' END AS note FROM pgf")
def h01(spark, sf):
    """All systems and controls at every protocol in one job, each with the table its answers were read from."""
    f = family(spark, sf).filter(F.col("pi_hash").isin([p.pi_hash for p in axis_scan(3.0)]))
    coarse = F.rint(F.col("delta_s") / D.DELTA) == D.RERUN_STRIDE
    f = f.join(scan_tables(spark, sf).select("system_id", F.col("table_used").alias("_t"), F.col("note").alias("_n")), "system_id", "left")
    f = f.withColumns({"table_used": F.when(coarse, F.coalesce("_t", "system_id")).otherwise(F.col("system_id")), "note": F.when(coarse, F.col("_n"))})
    return f.select("pi_hash", "system_id", "is_block", *T.PI[1:], "n_clips", "n_missing", *[r6(c).alias(c) for c in ("rmscd", "s_at_1", "s_at_3", "end_macro_acc")], "median_flips", "table_used", "note")


@query("h02_incremental_scan", with_base(pgrid(axis_scan(3.0))) + " SELECT CASE WHEN system_id LIKE 'commit%' THEN 'computed' ELSE 'reused' END AS origin, count(*)::BIGINT AS n_rows, round(sum(rmscd),6) AS rmscd_sum FROM pgf GROUP BY ALL")
def h02(spark, sf):
    """Stored rows are kept; wanted (system, protocol) pairs that aren't stored are found first, and only their answers are read."""
    keys = ["system_id", "pi_hash"]
    protocols = axis_scan(3.0)
    stored = family(spark, sf).filter(F.col("pi_hash").isin([p.pi_hash for p in protocols]) & ~F.col("is_block") & ~F.col("system_id").startswith("commit"))
    wanted = spark.createDataFrame([(s, p.pi_hash) for s in D.SYSTEM_IDS for p in protocols], "system_id string, pi_hash string")
    need = wanted.join(stored.select(*keys), keys, "left_anti")
    todo = need.collect()  # at most systems times protocols
    ids, pis = sorted({r.system_id for r in todo}), {r.pi_hash for r in todo}
    reused = stored.select(*keys, "rmscd", F.lit("reused").alias("origin"))
    if todo:
        a = packed(spark, sf).filter(F.col("system_id").isin(ids))
        t = scan_tally(manifest(spark, sf, "test"), a, ids, [p for p in protocols if p.pi_hash in pis], D.DELTA).join(F.broadcast(need), keys, "left_semi")
        reused = reused.unionByName(T.family_of_tally(T.merged(t, ["system_id", *T.PI]), ["system_id", *T.PI]).select(*keys, "rmscd", F.lit("computed").alias("origin")))
    return reused.groupBy("origin").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("rmscd")).alias("rmscd_sum"))


@query("h03_offset_and_spread", scan_sql(BOTH) + " SELECT pi_hash, metric, count(shift)::BIGINT AS n_systems, round(avg(shift),6) AS b_m, round(stddev_samp(shift),6) AS s_m, round(max(abs(shift)),6) AS max_abs_shift FROM sh GROUP BY ALL")
def h03(spark, sf):
    b = H.offsets_and_spread(scanned(spark, sf, BOTH), REF.pi_hash)
    return b.select("pi_hash", "metric", "n_systems", *[r6(c).alias(c) for c in ("b_m", "s_m", "max_abs_shift")])


@query("h04_rank_preservation", pair_sql(BOTH) + " SELECT pi_hash, metric, n_pairs, round(r_m,6) AS r_m FROM rk")
def h04(spark, sf):
    r = H.rank_preservation(scanned(spark, sf, BOTH), separated(spark, sf), REF.pi_hash)
    return r.select("pi_hash", "metric", "n_pairs", r6("r_m").alias("r_m"))


@query("h05_comparability_region", pair_sql(BOTH) + " SELECT metric, count(*)::BIGINT AS n_pi, sum(coalesce(r_m>=0.9,false)::INT)::BIGINT AS n_in_region FROM rk GROUP BY ALL")
def h05(spark, sf):
    r = H.rank_preservation(scanned(spark, sf, BOTH), separated(spark, sf), REF.pi_hash)
    return r.groupBy("metric").agg(F.count(F.lit(1)).alias("n_pi"), F.sum(F.coalesce(F.col("r_m") >= H.R0, F.lit(False)).cast("bigint")).alias("n_in_region"))


_MRD = f", ms AS (SELECT *, (in_plaus AND (metric<>'rmscd' OR abs(h_s-h0)<1e-9)) AS use, abs(h_s-h0)<1e-9 AS same FROM sh WHERE pi_hash<>'{REF.pi_hash}'), md AS (SELECT metric, quantile_cont(CASE WHEN use THEN abs(shift) END,0.95) AS mrd, count(CASE WHEN use THEN shift END)::BIGINT AS n, quantile_cont(CASE WHEN NOT same THEN abs(shift) END,0.95) AS h_axis_shift FROM ms GROUP BY ALL)"


@query("h06_minimum_reportable_difference", scan_sql(BOTH) + _MRD + " SELECT metric, round(mrd,6) AS mrd, n, round(h_axis_shift,6) AS h_axis_shift FROM md")
def h06(spark, sf):
    m = H.resolution(scanned(spark, sf, BOTH), REF.pi_hash)
    return m.select("metric", r6("mrd").alias("mrd"), "n", r6("h_axis_shift").alias("h_axis_shift"))


_EPS = ", ex AS (SELECT metric, abs(eps_sys_s) AS a, min(r_m) AS r, max((r_m IS NULL)::INT) AS un FROM rk WHERE eps_jit_sd_s=0 AND delta_s=0.5 AND h_s=3.0 GROUP BY ALL), eh AS (SELECT *, min((un=0 AND r>=0.9-1e-9)::INT) OVER (PARTITION BY metric ORDER BY a) AS held FROM ex), em AS (SELECT metric, coalesce(max(CASE WHEN held=1 THEN a END),0.0::DOUBLE) AS eps_max, (min(held)=1) AS saturated, count(*)::BIGINT AS n_points FROM eh GROUP BY ALL)"


@query("h07_eps_max", pair_sql(BOTH) + _EPS + " SELECT * FROM em")
def h07(spark, sf):
    return H.eps_max(H.rank_preservation(scanned(spark, sf, BOTH), separated(spark, sf), REF.pi_hash), REF.pi_hash)


_DS = """, fd AS (SELECT system_id, delta_s, value, first_value(value) OVER (PARTITION BY system_id ORDER BY delta_s) AS fin, lead(value) OVER (PARTITION BY system_id ORDER BY delta_s DESC) AS nx FROM sc WHERE metric='median_flips' AND eps_sys_s=0 AND eps_jit_sd_s=0 AND h_s=3.0),
fo AS (SELECT *, min((abs(value-fin)<=0.05*greatest(abs(fin),1))::INT) OVER (PARTITION BY system_id ORDER BY delta_s) AS held FROM fd)"""


@query("h08_delta_star", scan_sql(axis_scan(3.0)) + _DS + " SELECT system_id, max(CASE WHEN held=1 THEN delta_s END) AS delta_star, (max(CASE WHEN held=1 THEN delta_s END)<>min(delta_s)) AS saturated, count(*)::BIGINT AS n_points, (min(coalesce(value<=nx+1e-9,true)::INT)=1) AS monotone FROM fo GROUP BY ALL")
def h08(spark, sf):
    s = H.on_axis(scanned(spark, sf, axis_scan(3.0)), REF, "delta_s").filter("metric = 'median_flips'")
    return H.delta_star(s.select("system_id", "delta_s", "value"), ["system_id"])


_CAL = _MRD + _EPS + QG.TIED + """, ru AS (SELECT p.metric, median(abs(p.value-q.value)) AS ruler FROM td JOIN pt p ON p.system_id=system_a JOIN pt q ON q.system_id=system_b AND q.metric=p.metric GROUP BY ALL),
ob AS (SELECT pi_hash, metric, avg(shift) AS b, stddev_samp(shift) AS s FROM sh WHERE in_plaus GROUP BY ALL), om AS (SELECT metric, max(abs(b)) AS max_b, max(s) AS max_s FROM ob GROUP BY ALL),
rm AS (SELECT metric, min(CASE WHEN in_plaus THEN r_m END) AS min_r, min(r_m) AS min_r_full, max(n_pairs) AS n_pairs FROM rk GROUP BY ALL),
ca AS (SELECT om.metric, max_b, max_s, min_r, min_r_full, n_pairs, mrd, ruler, eps_max, CASE WHEN min_r IS NULL THEN 'undetermined' WHEN min_r<0.9 THEN 'not comparable' WHEN ruler IS NULL THEN 'undetermined (no ruler)' WHEN ruler=0 THEN 'normalize (ruler is zero)' WHEN mrd<ruler THEN 'poolable' ELSE 'normalize' END AS verdict
 FROM om LEFT JOIN rm USING (metric) LEFT JOIN md USING (metric) LEFT JOIN ru USING (metric) LEFT JOIN em USING (metric))"""


def calibrated(spark, sf):
    """Calibration of every metric, one row each; kept as a stage, so that what reads it doesn't plan all of its inference again."""
    return stage(spark, sf, "calibration", lambda: H.calibration(scanned(spark, sf, BOTH), separated(spark, sf), QG.rulers(spark, sf), REF.pi_hash))


@query("h09_calibration_verdict", pair_sql(BOTH) + _CAL + " SELECT metric, round(max_b,6) AS max_b, round(max_s,6) AS max_s, round(min_r,6) AS min_r, round(min_r_full,6) AS min_r_full, n_pairs, round(mrd,6) AS mrd, round(ruler,6) AS ruler, eps_max, verdict FROM ca")
def h09(spark, sf):
    c = calibrated(spark, sf)
    return c.select("metric", *[r6(x).alias(x) for x in ("max_b", "max_s", "min_r", "min_r_full")], "n_pairs", r6("mrd").alias("mrd"), r6("ruler").alias("ruler"), "eps_max", "verdict")


@query("h10_protocol_slice", scan_sql(plausible_grid()) + ", sl AS (SELECT metric, eps_sys_s, h_s, avg(value) AS v FROM sc WHERE eps_jit_sd_s=0 AND delta_s=0.5 GROUP BY ALL) SELECT metric, eps_sys_s, round(max(CASE WHEN h_s=2.0 THEN v END),6) AS h_2, round(max(CASE WHEN h_s=3.0 THEN v END),6) AS h_3, round(max(CASE WHEN h_s=4.0 THEN v END),6) AS h_4, (count(*)=3) AS complete FROM sl GROUP BY ALL")
def h10(spark, sf):
    """Shift by horizon, the other knobs at the reference; a full row has one cell per horizon."""
    s = scanned(spark, sf, plausible_grid()).filter("eps_jit_sd_s = 0 AND delta_s = 0.5").groupBy("metric", "eps_sys_s", "h_s").agg(F.avg("value").alias("v"))
    p = s.groupBy("metric", "eps_sys_s").pivot("h_s", D.HORIZONS).agg(F.first("v"))
    n = s.groupBy("metric", "eps_sys_s").agg((F.count(F.lit(1)) == 3).alias("complete"))
    return p.join(n, ["metric", "eps_sys_s"]).select("metric", "eps_sys_s", *[r6(F.col(f"`{h}`")).alias(f"h_{h:g}") for h in D.HORIZONS], "complete")


_GROUP = "CASE WHEN eps_sys_s<>0 OR eps_jit_sd_s<>0 THEN 'anchor' WHEN delta_s<>0.5 THEN 'step' WHEN h_s<>3.0 THEN 'horizon' ELSE 'reference' END"


@query("h11_knob_decomposition", pair_sql(axis_scan(3.0)) + f", a AS (SELECT {_GROUP} AS knob, metric, min(r_m) AS min_r, count(*)::BIGINT AS n_pi FROM rk GROUP BY ALL), b AS (SELECT {_GROUP} AS knob, metric, quantile_cont(abs(shift),0.95) AS q FROM sh GROUP BY ALL) SELECT knob, metric, n_pi, round(min_r,6) AS min_r, round(q,6) AS q95_shift FROM a JOIN b USING (knob, metric)")
def h11(spark, sf):
    knob = (F.when((F.col("eps_sys_s") != 0) | (F.col("eps_jit_sd_s") != 0), "anchor").when(F.col("delta_s") != 0.5, "step").when(F.col("h_s") != 3.0, "horizon").otherwise("reference"))
    s = scanned(spark, sf, axis_scan(3.0))
    r = H.rank_preservation(s, separated(spark, sf), REF.pi_hash).groupBy(knob.alias("knob"), "metric").agg(F.count(F.lit(1)).alias("n_pi"), r6(F.min("r_m")).alias("min_r"))
    q = H.shifts(s, REF.pi_hash).groupBy(knob.alias("knob"), "metric").agg(r6(F.percentile(F.abs("shift"), F.lit(0.95))).alias("q95_shift"))
    return r.join(q, ["knob", "metric"])


_NB = with_base(pgrid(neighbour_grid(3.0)), grid(3.0), QG.SAMPLES, _PAIRS) + _LONG + _RANK


@query("h12_reversals", _NB + ", v AS (SELECT metric, system_a, system_b, sum((d0*d<0)::INT) AS r, sum((d=0)::INT) AS t FROM dz WHERE d0 IS NOT NULL AND d IS NOT NULL AND d0<>0 GROUP BY ALL) SELECT metric, sum(r)::BIGINT AS reversal_events, sum((r>0)::INT)::BIGINT AS unique_reversed_pairs, sum(t)::BIGINT AS tie_events, sum((t>0)::INT)::BIGINT AS unique_tied_pairs FROM v GROUP BY ALL")
def h12(spark, sf):
    """Strict reversals over the immediate neighbours of the reference, new ties apart."""
    d = H.pair_differences(scanned(spark, sf, neighbour_grid(3.0)), separated(spark, sf))
    return H.unique_reversals(d, REF.pi_hash)


@query("h12_reversals_by_protocol", _NB + " SELECT metric, pi_hash, count(*)::BIGINT AS n_pairs, sum((d0*d<0)::INT)::BIGINT AS reversals, sum((d=0)::INT)::BIGINT AS new_ties FROM dz WHERE d0 IS NOT NULL AND d IS NOT NULL AND d0<>0 GROUP BY ALL")
def h12b(spark, sf):
    return H.reversals(H.pair_differences(scanned(spark, sf, neighbour_grid(3.0)), separated(spark, sf)), REF.pi_hash)


_SPEAR = """, sr AS (SELECT pi_hash, metric, value-0 AS x, value-shift AS y FROM sh WHERE shift IS NOT NULL),
sk AS (SELECT *, rank() OVER (PARTITION BY pi_hash, metric ORDER BY x) + (count(*) OVER (PARTITION BY pi_hash, metric, x)-1)/2.0 AS rx, rank() OVER (PARTITION BY pi_hash, metric ORDER BY y) + (count(*) OVER (PARTITION BY pi_hash, metric, y)-1)/2.0 AS ry FROM sr2),
sv AS (SELECT pi_hash, metric, CASE WHEN max(x)>min(x) AND max(y)>min(y) THEN corr(rx,ry) END AS rho FROM sk GROUP BY ALL)""".replace("sr AS (SELECT pi_hash, metric, value-0 AS x, value-shift AS y FROM sh WHERE shift IS NOT NULL)",
    f"sr2 AS (SELECT a.pi_hash, a.metric, round(a.value,12) AS x, round(b.value,12) AS y FROM sc a JOIN sc b ON b.pi_hash='{REF.pi_hash}' AND b.system_id=a.system_id AND b.metric=a.metric WHERE a.value IS NOT NULL AND b.value IS NOT NULL)")


def _spearman_by_pi(spark, sf):
    s = H.shifts(scanned(spark, sf, BOTH), REF.pi_hash)
    return spearman(s, ["pi_hash", "metric"], "value", "value0", "rho")


@query("h13_rank_correlation", pair_sql(BOTH) + _SPEAR + " SELECT metric, count(*)::BIGINT AS n_pi, sum((r_m>=0.9)::INT)::BIGINT AS n_r, sum(coalesce(rho>=0.9,false)::INT)::BIGINT AS n_rho, sum((coalesce(rho>=0.9,false) AND NOT coalesce(r_m>=0.9,false))::INT)::BIGINT AS added, sum((NOT coalesce(rho>=0.9,false) AND coalesce(r_m>=0.9,false))::INT)::BIGINT AS removed, round(min(rho),6) AS min_rho FROM rk LEFT JOIN sv USING (pi_hash, metric) GROUP BY ALL")
def h13(spark, sf):
    """Spearman over systems instead of pair preservation: which protocols enter or leave the region."""
    r = H.rank_preservation(scanned(spark, sf, BOTH), separated(spark, sf), REF.pi_hash).join(_spearman_by_pi(spark, sf), ["pi_hash", "metric"], "left")
    a, b = F.coalesce(F.col("r_m") >= H.R0, F.lit(False)), F.coalesce(F.col("rho") >= H.R0, F.lit(False))
    def n(c):
        return F.sum(c.cast("bigint"))
    return r.groupBy("metric").agg(F.count(F.lit(1)).alias("n_pi"), n(a).alias("n_r"), n(b).alias("n_rho"), n(b & ~a).alias("added"), n(a & ~b).alias("removed"), r6(F.min("rho")).alias("min_rho"))


@query("h14_jitter_mechanism", scan_sql(axis_scan(3.0)) + """, o AS (SELECT metric, eps_jit_sd_s AS x, round(stddev_samp(shift),12) AS y FROM sh WHERE eps_sys_s=0 AND delta_s=0.5 AND h_s=3.0 GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY x)+(count(*) OVER (PARTITION BY metric, x)-1)/2.0 AS rx, rank() OVER (PARTITION BY metric ORDER BY y)+(count(*) OVER (PARTITION BY metric, y)-1)/2.0 AS ry FROM o WHERE y IS NOT NULL) SELECT metric, round(CASE WHEN max(y)>min(y) THEN corr(rx,ry) END,6) AS t_b FROM k GROUP BY ALL""")
def h14(spark, sf):
    """Does the spread of shifts across systems grow with the jitter?"""
    b = H.offsets_and_spread(H.on_axis(scanned(spark, sf, axis_scan(3.0)), REF, "eps_jit_sd_s"), REF.pi_hash)
    return spearman(b, ["metric"], "eps_jit_sd_s", "s_m", "t_b").select("metric", r6("t_b").alias("t_b"))


@query("h14_step_growth", scan_sql(axis_scan(3.0)) + ", f AS (SELECT system_id, max(CASE WHEN delta_s=0.25 THEN value END) AS a, max(CASE WHEN delta_s=0.5 THEN value END) AS b FROM sc WHERE metric='median_flips' AND eps_sys_s=0 AND eps_jit_sd_s=0 AND h_s=3.0 GROUP BY ALL) SELECT system_id, round((a-b)/greatest(abs(a),1),6) AS t_c FROM f")
def h14c(spark, sf):
    s = H.on_axis(scanned(spark, sf, axis_scan(3.0)), REF, "delta_s").filter("metric = 'median_flips'")
    at = {d: F.max(F.when(F.col("delta_s") == d, F.col("value"))) for d in (0.25, 0.5)}
    g = s.groupBy("system_id").agg(at[0.25].alias("a"), at[0.5].alias("b"))
    return g.select("system_id", r6((F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.lit(1.0))).alias("t_c"))


_AX = ", ".join(f"('{n}',{c})" for n, c in [("eps_sys_s", 1), ("eps_jit_sd_s", 2), ("delta_s", 3), ("h_s", 4)])
_RESP = with_base(_LIB, pgrid(axis_scan(3.0), systems="sys2", answers="ans2")) + _LONG + _SHIFT + f""", ax(axis, n) AS (VALUES {_AX}),
of AS (SELECT pi_hash, eps_sys_s, eps_jit_sd_s, delta_s, h_s, metric, avg(CASE WHEN system_id NOT LIKE 'block%' THEN shift END) AS br, avg(CASE WHEN system_id LIKE 'block%' THEN shift END) AS bc FROM sh GROUP BY ALL),
oa AS (SELECT axis, of.* FROM of, ax WHERE (n=1 OR eps_sys_s=0) AND (n=2 OR eps_jit_sd_s=0) AND (n=3 OR delta_s=0.5) AND (n=4 OR h_s=3.0) AND pi_hash<>'{REF.pi_hash}' AND br IS NOT NULL AND bc IS NOT NULL),
og AS (SELECT *, CASE WHEN br>1e-12 THEN 1 WHEN br<-1e-12 THEN -1 ELSE 0 END AS a, CASE WHEN bc>1e-12 THEN 1 WHEN bc<-1e-12 THEN -1 ELSE 0 END AS b FROM oa)"""


@query("h15_response_agreement", _RESP + " SELECT axis, metric, count(*)::BIGINT AS n, round(avg((a=b)::INT),6) AS sign_agreement, round(avg(CASE WHEN a<>0 OR b<>0 THEN (a=b)::INT END),6) AS active_sign_agreement, sum((a=0 AND b=0)::INT)::BIGINT AS n_both_zero, round(CASE WHEN count(*)>1 AND max(br)-min(br)>1e-12 AND max(bc)-min(bc)>1e-12 THEN corr(br,bc) END,4) AS pearson FROM og GROUP BY ALL")
def h15(spark, sf):
    """Mean response of systems and of controls along each axis."""
    s = scanned(spark, sf, axis_scan(3.0), blocks=True)
    b = H.shifts(s, REF.pi_hash).groupBy(*T.PI, "metric").agg(F.avg(F.when(~F.col("is_block"), F.col("shift"))).alias("b_real"), F.avg(F.when(F.col("is_block"), F.col("shift"))).alias("b_control"))
    curves = None
    for axis in ("eps_sys_s", "eps_jit_sd_s", "delta_s", "h_s"):
        c = H.on_axis(b, REF, axis).withColumn("axis", F.lit(axis))
        curves = c if curves is None else curves.unionByName(c)
    curves = curves.filter("b_real IS NOT NULL AND b_control IS NOT NULL")
    by = ["axis", "metric"]
    agree = H.response_agreement(curves.select(*by, "pi_hash", "b_real"), curves.select(*by, "pi_hash", "b_control"), by, REF.pi_hash)
    off = curves.filter(F.col("pi_hash") != REF.pi_hash)
    varies = (F.count(F.lit(1)) > 1) & (F.max("b_real") - F.min("b_real") > ZERO) & (F.max("b_control") - F.min("b_control") > ZERO)
    corr = off.groupBy(*by).agg(F.round(F.when(varies, correlation(F.col("b_real"), F.col("b_control"))), 4).alias("pearson"))
    return agree.join(corr, by).select(*by, "n", r6("sign_agreement").alias("sign_agreement"), r6("active_sign_agreement").alias("active_sign_agreement"), "n_both_zero", "pearson")


_AVGRANK = "rank() OVER (PARTITION BY axis, metric, fam ORDER BY round({0},12)) + (count(*) OVER (PARTITION BY axis, metric, fam, round({0},12))-1)/2.0::DOUBLE"
_FAM = with_base(_LIB, pgrid(axis_scan(3.0), systems="sys2", answers="ans2")) + _LONG + _SHIFT + f""", ax(axis, n) AS (VALUES {_AX}),
fa AS (SELECT *, regexp_extract(system_id, '^block__([a-z]+)__', 1) AS f0 FROM sh), fr AS (SELECT pi_hash, eps_sys_s, eps_jit_sd_s, delta_s, h_s, metric, avg(shift) AS br FROM fa WHERE f0='' GROUP BY ALL),
fb AS (SELECT pi_hash, metric, coalesce(f0,'all_blocks') AS fam, avg(shift) AS bc FROM fa WHERE f0<>'' GROUP BY GROUPING SETS ((pi_hash, metric), (pi_hash, metric, f0))),
fj AS (SELECT axis, fam, fr.metric, fr.pi_hash, br, bc, CASE WHEN br>1e-12 THEN 1 WHEN br<-1e-12 THEN -1 ELSE 0 END AS a, CASE WHEN bc>1e-12 THEN 1 WHEN bc<-1e-12 THEN -1 ELSE 0 END AS b, fr.pi_hash<>'{REF.pi_hash}' AS off
 FROM fr JOIN fb ON fb.pi_hash=fr.pi_hash AND fb.metric=fr.metric, ax WHERE (n=1 OR eps_sys_s=0) AND (n=2 OR eps_jit_sd_s=0) AND (n=3 OR delta_s=0.5) AND (n=4 OR h_s=3.0) AND br IS NOT NULL AND bc IS NOT NULL),
fk AS (SELECT *, {_AVGRANK.format('br')} AS xr, {_AVGRANK.format('bc')} AS xc FROM fj)"""


@query("h15_response_by_family", _FAM + " SELECT axis, metric, fam AS block_family, sum(off::INT)::BIGINT AS n, round(avg(CASE WHEN off THEN (a=b)::INT END),6) AS sign_agreement, round(avg(CASE WHEN off AND (a<>0 OR b<>0) THEN (a=b)::INT END),6) AS active_sign_agreement, sum((off AND a=0 AND b=0)::INT)::BIGINT AS n_both_zero, round(CASE WHEN count(*)>1 AND max(br)-min(br)>1e-12 AND max(bc)-min(bc)>1e-12 THEN corr(br,bc) END,4) AS pearson, round(CASE WHEN count(*)>1 AND max(xr)>min(xr) AND max(xc)>min(xc) THEN corr(xr,xc) END,4) AS spearman FROM fk GROUP BY ALL")
def h15f(spark, sf):
    """Mean response of systems against each family of controls and all of them: signs, linear and rank correlation of the curves."""
    s = H.shifts(scanned(spark, sf, axis_scan(3.0), blocks=True), REF.pi_hash).withColumn("_f", F.regexp_extract("system_id", "^block__([a-z]+)__", 1))
    real = s.filter("_f = ''").groupBy(*T.PI, "metric").agg(F.avg("shift").alias("b_real"))
    fam = s.filter("_f <> ''").withColumn("block_family", F.explode(F.array(F.lit("all_blocks"), F.col("_f")))).groupBy("pi_hash", "metric", "block_family").agg(F.avg("shift").alias("b_control"))
    b = real.join(fam, ["pi_hash", "metric"])
    curves = None
    for axis in ("eps_sys_s", "eps_jit_sd_s", "delta_s", "h_s"):
        c = H.on_axis(b, REF, axis).withColumn("axis", F.lit(axis))
        curves = c if curves is None else curves.unionByName(c)
    curves = curves.filter("b_real IS NOT NULL AND b_control IS NOT NULL").select("axis", "metric", "block_family", "pi_hash", "b_real", "b_control")
    by = ["axis", "metric", "block_family"]
    agree = H.response_agreement(curves.drop("b_control"), curves.drop("b_real"), by, REF.pi_hash)
    varies = (F.count(F.lit(1)) > 1) & (F.max("b_real") - F.min("b_real") > ZERO) & (F.max("b_control") - F.min("b_control") > ZERO)
    linear = curves.groupBy(*by).agg(F.round(F.when(varies, correlation(F.col("b_real"), F.col("b_control"))), 4).alias("pearson"))
    out = agree.join(linear, by).join(spearman(curves, by, "b_real", "b_control", "_s"), by)
    return out.select(*by, "n", r6("sign_agreement").alias("sign_agreement"), r6("active_sign_agreement").alias("active_sign_agreement"), "n_both_zero", "pearson", F.round("_s", 4).alias("spearman"))


# Gaps of systems and controls: own visible end (at most 3.5 s) against the fixed horizon of 2 s, long against short clips.
_G2 = re.sub(r"\b(gc|ix|kn|pk|wt)\b", r"\g<1>2", QG.DRAWS)
GATE_SQL = pair_sql(BOTH) + _CAL + ", " + QG._CUTS + ", " + _LIB + f""", gc2 AS (SELECT DISTINCT source_cluster_id FROM man WHERE split='test' AND post_anchor_length_s>=2.0-1e-9), {_G2},
gl AS (SELECT s.system_id, m.video_id, m.source_cluster_id, m.post_anchor_length_s AS len, x.j, coalesce(a.pred,-1)=m.class_code AS ok, least(m.post_anchor_length_s, 3.5) AS vis FROM man m CROSS JOIN sys2 s, range(0, 9) x(j) LEFT JOIN ans2 a ON a.system_id=s.system_id AND a.video_id=m.video_id AND a.j=x.j WHERE m.split='test' AND m.post_anchor_length_s>=2.0-1e-9),
gw AS (SELECT system_id, video_id, any_value(source_cluster_id) AS source_cluster_id, any_value(len) AS len, any_value(vis) AS vis, any_value(floor(vis/0.5::DOUBLE+1e-9)::INT) AS last, coalesce(max(CASE WHEN NOT ok AND j<=floor(vis/0.5::DOUBLE+1e-9) THEN j END),-1) AS lo, coalesce(max(CASE WHEN NOT ok AND j<=4 THEN j END),-1) AS lf FROM gl GROUP BY ALL),
gk AS (SELECT system_id, source_cluster_id, len, 'own' AS kind, (CASE WHEN lo<last THEN least((lo+1)*0.5::DOUBLE, vis) ELSE vis END)::DOUBLE AS delay FROM gw UNION ALL SELECT system_id, source_cluster_id, len, 'fixed', (CASE WHEN lf<0 THEN 0 WHEN lf>=4 THEN 2.0 ELSE (lf+0.5)*0.5 END)::DOUBLE FROM gw),
gq AS (SELECT *, CASE WHEN len<=c1 THEN 0 WHEN len<=c2 THEN 1 ELSE 2 END AS st FROM gk, ct),
gx AS (SELECT system_id, kind, avg(CASE WHEN st=2 THEN delay END)-avg(CASE WHEN st=0 THEN delay END) AS gap FROM gq GROUP BY ALL),
gy AS (SELECT system_id, kind, source_cluster_id, sum((st=2)::INT) AS nl, sum(CASE WHEN st=2 THEN delay ELSE 0 END) AS dl, sum((st=0)::INT) AS ns, sum(CASE WHEN st=0 THEN delay ELSE 0 END) AS ds FROM gq GROUP BY ALL),
gz AS (SELECT system_id, kind, b, sum(w*dl)/nullif(sum(w*nl),0)-sum(w*ds)/nullif(sum(w*ns),0) AS v FROM gy JOIN wt2 USING (source_cluster_id) GROUP BY ALL),
gi AS (SELECT system_id, kind, quantile_cont(v,0.025) AS lo, quantile_cont(v,0.975) AS hi FROM gz GROUP BY ALL),
gt AS (SELECT *, ((own_lo>0 OR own_hi<0) AND abs(own_gap)>mrd) AND ((fixed_lo<=0 AND fixed_hi>=0) OR abs(fixed_gap)<ruler) AS consequence, CASE WHEN system_id LIKE 'block__rand%' THEN 'random_block' WHEN system_id LIKE 'block%' THEN 'other_block' ELSE 'real' END AS role
 FROM (SELECT x.system_id, x.gap AS own_gap, i.lo AS own_lo, i.hi AS own_hi, y.gap AS fixed_gap, k.lo AS fixed_lo, k.hi AS fixed_hi, mrd, ruler FROM gx x JOIN gi i ON i.system_id=x.system_id AND i.kind='own' JOIN gx y ON y.system_id=x.system_id AND y.kind='fixed' JOIN gi k ON k.system_id=x.system_id AND k.kind='fixed', ca WHERE x.kind='own' AND ca.metric='rmscd'))"""


@query("h16_metric_gate", pair_sql(BOTH) + _CAL + " SELECT metric, CASE WHEN metric<>'median_flips' THEN min_r<0.9 END AS rank_arm, CASE WHEN metric<>'median_flips' AND ruler>0 THEN mrd>=ruler END AS mrd_arm, (ruler IS NULL OR ruler<=0) AS ruler_degenerate FROM ca")
def h16(spark, sf):
    return H.metric_gate(calibrated(spark, sf))


def consequences(spark, sf, open_, fixed):
    """Own-end gap against fixed-cohort gap of every system in ``open_`` and ``fixed``, with shared cluster replicates."""
    vis = F.least(F.col("post_anchor_length_s"), F.lit(3.5))
    cut = QG.cuts(spark, sf)
    own = T.own_end(open_.filter(F.col("post_anchor_length_s") >= 2.0 - TOL), F.floor(vis / F.col("delta_s") + TOL).cast("int"))
    own = own.withColumn("delay", F.coalesce(F.least(F.col("onset_j") * F.col("delta_s"), vis), vis)).join(
        manifest(spark, sf, "test").select("video_id", "source_cluster_id"), "video_id").select("system_id", "source_cluster_id", "post_anchor_length_s", "delay", F.lit("own").alias("kind"))
    fixed = fixed.select("system_id", "source_cluster_id", "post_anchor_length_s", "delay", F.lit("fixed").alias("kind"))
    c = G.with_terciles(own.unionByName(fixed), cut, "post_anchor_length_s")
    long_, short = F.col("stratum") == 2, F.col("stratum") == 0
    s = c.groupBy("kind", "system_id", "source_cluster_id").agg(
        F.sum(long_.cast("int")).alias("nl"), F.sum(F.when(long_, F.col("delay")).otherwise(0.0)).alias("dl"), F.sum(short.cast("int")).alias("ns"), F.sum(F.when(short, F.col("delay")).otherwise(0.0)).alias("ds"))
    def gap():
        return mean_ratio(F.sum("dl"), F.sum("nl")) - mean_ratio(F.sum("ds"), F.sum("ns"))
    point = s.groupBy("system_id", "kind").agg(gap().alias("gap"))
    w = G.packed_draws(fixed.select("source_cluster_id"), N_BOOT, SEED)
    reps = G.replicate_sums(s, w, ["kind", "system_id"], ["nl", "dl", "ns", "ds"]).groupBy("kind", "system_id", "b").agg(gap().alias("value"))
    iv = G.percentile_interval(reps, ["system_id", "kind"], floor=0.0).join(point, ["system_id", "kind"])
    def side(k):
        return iv.filter(F.col("kind") == k).select("system_id", F.col("gap").alias(f"{k}_gap"), F.col("ci_lo").alias(f"{k}_lo"), F.col("ci_hi").alias(f"{k}_hi"))
    cal = calibrated(spark, sf).filter("metric = 'rmscd'").select(F.struct("mrd", "ruler")).scalar()
    j = side("own").join(side("fixed"), "system_id").withColumn("_cal", cal).select("*", "_cal.mrd", "_cal.ruler").drop("_cal")
    cons = H.consequence(*[F.col(x) for x in ("own_gap", "own_lo", "own_hi", "fixed_gap", "fixed_lo", "fixed_hi", "mrd", "ruler")])
    return j.withColumn("consequence", cons)


@query("h16_consequence_gate", GATE_SQL + " SELECT system_id, round(own_gap,6) AS own_gap, round(own_lo,6) AS own_lo, round(own_hi,6) AS own_hi, round(fixed_gap,6) AS fixed_gap, round(fixed_lo,6) AS fixed_lo, round(fixed_hi,6) AS fixed_hi, round(mrd,6) AS mrd, round(ruler,6) AS ruler, consequence FROM gt WHERE system_id NOT LIKE 'block%'")
def h16c(spark, sf):
    """Own-end gap against fixed-cohort gap, per system."""
    c = consequences(spark, sf, open_cells(spark, sf), clips(spark, sf, 2.0))
    return c.select("system_id", *[r6(x).alias(x) for x in ("own_gap", "own_lo", "own_hi", "fixed_gap", "fixed_lo", "fixed_hi", "mrd", "ruler")], "consequence")


def gate_rows(spark, sf):
    """Systems and controls through one gate: roles, consequences, and whether the controls that are always right stay quiet."""
    def build():
        m = manifest(spark, sf, "test")
        ids = [k.system_id for k in R.CONTROLS]
        ctl = R.packed_controls(m, R.CONTROLS, D.DELTA, D.J_MIN, D.J_MAX)
        open_ = open_cells(spark, sf).unionByName(T.read_grid(m, ctl, ids, [reference(3.0)], D.DELTA, cohort=False, span=D.GRID_MAX), allowMissingColumns=True)
        fixed = clips(spark, sf, 2.0).unionByName(T.clips_at(m, ctl, ids, [reference(2.0)], D.DELTA), allowMissingColumns=True)
        rows = consequences(spark, sf, open_, fixed)
        block = F.regexp_extract("system_id", "^block__([a-z]+)__", 1)
        role = F.when(block == "rand", "random_block").when(block != "", "other_block").otherwise("real")
        return rows.withColumns({"role": role, "control_passed": F.when(block == "oracle", H.negative_control(F.col("own_gap"), F.col("fixed_gap"), F.col("ruler")))})
    return stage(spark, sf, "gate_rows", build)


@query("h16_group_gate", GATE_SQL + """, gr AS (SELECT role, count(*)::BIGINT AS n, count(CASE WHEN consequence THEN 1 END)::BIGINT AS n_consequence, count(CASE WHEN consequence IS NULL THEN 1 END)::BIGINT AS n_undefined FROM gt GROUP BY ALL),
gv AS (SELECT count(*)>0 AND bool_and(abs(own_gap)<=ruler AND abs(fixed_gap)<=ruler AND ruler>=0) AS ok FROM gt WHERE system_id LIKE 'block__oracle%'), gu AS (SELECT sum(n_undefined)=0 AS known FROM gr WHERE role IN ('random_block','real')),
gp AS (SELECT (SELECT n=n_consequence FROM gr WHERE role='random_block') AND (SELECT 2*n_consequence>=n FROM gr WHERE role='real') AS p)
SELECT role, n, n_consequence, n_undefined, ok AS computation_valid, CASE WHEN NOT ok THEN 'invalid_computation' WHEN NOT known THEN 'undefined' WHEN p THEN 'passed' ELSE 'failed' END AS status, CASE WHEN ok AND known THEN p END AS pass_gate FROM gr, gv, gu, gp""")
def h16g(spark, sf):
    """Verdict over the groups, valid only while the always-right control shows no gap."""
    return H.group_gate(gate_rows(spark, sf))


def heterogeneous(spark, sf):
    """Pairs tied at the window end whose delays differ after correction, with their identities; one row per pair, stored."""
    def build():
        t = QG.tests(spark, sf, True).filter("metric = 'rmscd'").join(QG.tied(spark, sf), ["system_a", "system_b"])
        h = G.holm_intervals(t, ["metric"], "p_normal")
        ids = I.parse_system(system_ids(spark, sf))
        root = I.root_of(ids).select("system_id", F.regexp_replace("root", r"__seed\d+", "").alias("base"))
        ids = ids.join(root, "system_id").withColumn("variant", F.concat_ws("|", "base", "arm_rule")).select("system_id", "seed", "base", "variant", "family")
        for side in ("a", "b"):
            h = h.join(ids.select(F.col("system_id").alias(f"system_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("seed", "base", "variant", "family")]), f"system_{side}")
        return h.withColumn("cross_base", F.col("base_a") != F.col("base_b"))
    return stage(spark, sf, "heterogeneous", build)


# Significance without quantiles: an interval at a level is clear of zero exactly when the two-sided p is below that level.
_HET = QG.ST + QG.TIED + ", " + _PARSE + ", hn AS (SELECT t.*, CASE WHEN se>0 THEN " + QG.TAIL.format(z="abs(diff)/se") + """ WHEN abs(diff)>0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS pn FROM ts t JOIN td USING (system_a, system_b) WHERE t.metric='rmscd'),
ho AS (SELECT *, row_number() OVER (ORDER BY pn, system_a, system_b) AS r, count(*) OVER () AS m FROM hn), hp AS (SELECT *, least(1.0::DOUBLE, max((m-r+1)*pn) OVER (ORDER BY r)) AS p_adjusted FROM ho),
hv AS (SELECT system_id, seed, regexp_replace(coalesce(parent, system_id), '__seed[0-9]+', '') AS base, regexp_replace(coalesce(parent, system_id), '__seed[0-9]+', '')||'|'||arm_rule AS variant FROM pq),
hs AS (SELECT p.*, (p_adjusted<=0.05 AND (ci_lo>0 OR ci_hi<0) AND pn < 0.05::DOUBLE/(m-r+1)) AS significant, x.base AS base_a, y.base AS base_b, x.seed AS seed_a, y.seed AS seed_b, x.variant AS variant_a, y.variant AS variant_b, x.base<>y.base AS cross_base FROM hp p JOIN hv x ON x.system_id=system_a JOIN hv y ON y.system_id=system_b)"""


@query("h17_heterogeneous_ties", _HET + " SELECT system_a, system_b, round(diff,6) AS diff, round(p_adjusted,4) AS p_adjusted, significant, base_a, base_b, cross_base FROM hs")
def h17(spark, sf):
    return heterogeneous(spark, sf).select("system_a", "system_b", r6("diff").alias("diff"), F.round("p_adjusted", 4).alias("p_adjusted"), "significant", "base_a", "base_b", "cross_base")


@query("h18_seed_replication", _HET + """, hy AS (SELECT least(variant_a,variant_b) AS variant_1, greatest(variant_a,variant_b) AS variant_2, seed_a AS seed, CASE WHEN variant_a=least(variant_a,variant_b) THEN diff ELSE -diff END AS o, significant, cross_base FROM hs WHERE seed_a=seed_b AND variant_a<>variant_b),
hz AS (SELECT variant_1, variant_2, bool_or(cross_base) AS cross_base, count(DISTINCT seed)::BIGINT AS n_seeds, count(DISTINCT CASE WHEN significant AND o>0 THEN seed END) AS p, count(DISTINCT CASE WHEN significant AND o<0 THEN seed END) AS n FROM hy GROUP BY ALL)
SELECT variant_1, variant_2, cross_base, n_seeds, greatest(p,n)::BIGINT AS n_same_direction, (cross_base AND greatest(p,n)>=2) AS passed FROM hz""")
def h18(spark, sf):
    return H.seed_replicated(heterogeneous(spark, sf))


@query("h19_detected_by_accuracy_area")
def h19(spark, sf):
    """Does the area of dynamic accuracy separate the tied pairs that the delay separates?"""
    o = open_cells(spark, sf).filter("j <= 6")
    alive = (F.col("j") * F.col("delta_s") <= F.col("post_anchor_length_s") + TOL).cast("int")
    s = o.groupBy("system_id", "source_cluster_id", "j", "steps").agg(F.sum(alive).alias("den"), F.sum(alive * F.col("ok").cast("int")).alias("num"))
    weight = F.when((F.col("j") == 0) | (F.col("j") == 6), 0.25).otherwise(0.5) / 3.0
    def area(df, by):
        c = df.groupBy(*by, "j").agg(mean_ratio(F.sum("num"), F.sum("den")).alias("acc"))
        return c.groupBy(*by).agg(F.sum(weight * F.col("acc")).alias("value")).withColumn("metric", F.lit("dynamic_accuracy"))
    w = G.packed_draws(manifest(spark, sf, "test").select("source_cluster_id"), N_BOOT, SEED)
    reps = G.replicate_sums(s, w, ["system_id", "j"], ["num", "den"])
    t = G.pair_tests(area(s, ["system_id"]), area(reps, ["system_id", "b"]), True)
    het = heterogeneous(spark, sf).select("system_a", "system_b", F.col("significant").alias("heterogeneous"), "cross_base")
    h = G.holm_intervals(t.join(het, ["system_a", "system_b"]), ["metric"], "p_normal")
    return h.select("system_a", "system_b", "diff", "significant", "heterogeneous", "cross_base", (F.col("heterogeneous") & F.col("significant")).alias("detected"))


_PARTS = """, cu AS (SELECT system_id, j, avg(stable) AS s FROM gs GROUP BY ALL), ce AS (SELECT system_id, s AS se FROM cu WHERE j=6), lv AS (SELECT system_id, 3.0*(1-any_value(se)) AS lvl, sum((CASE WHEN j IN (0,6) THEN 0.25 ELSE 0.5 END)::DOUBLE*(se-s)) AS dly FROM cu JOIN ce USING (system_id) GROUP BY ALL),
tp AS (SELECT td.*, a.lvl-b.lvl AS l, a.dly-b.dly AS d, a.lvl-b.lvl+a.dly-b.dly AS diff, (system_a LIKE 'commit%' OR system_b LIKE 'commit%') AS commit_pair FROM td JOIN lv a ON a.system_id=system_a JOIN lv b ON b.system_id=system_b)"""


@query("h20_tied_composition", with_base(grid(3.0), QG.SAMPLES) + QG.TIED + _PARTS + " SELECT commit_pair, count(*)::BIGINT AS n, sum((sign(round(d,9))=sign(round(diff,9)))::INT)::BIGINT AS delay_same_sign, sum((abs(d)>abs(l)+1e-9)::INT)::BIGINT AS delay_dominant, sum((sign(round(l,9))<>sign(round(diff,9)))::INT)::BIGINT AS endpoint_opposite, round(median(abs(diff)),6) AS median_abs_diff, round(median(abs(d)),6) AS median_abs_delay, round(median(abs(l)),6) AS median_abs_endpoint FROM tp GROUP BY ALL")
def h20(spark, sf):
    """How much of the delay difference of tied pairs is endpoint level and how much is timing."""
    curve = T.stable_curve(clips(spark, sf), ["system_id"])
    w = T.trapezoid_weight(F.col("j"), F.col("steps"), F.col("delta_s"))
    end = F.max(F.when(F.col("j") == F.col("steps"), F.col("s_h")))
    p = curve.groupBy("system_id").agg((3.0 * (1 - end)).alias("lvl"), (F.sum(w * (1 - F.col("s_h"))) - 3.0 * (1 - end)).alias("dly"))
    t = QG.tied(spark, sf)
    for s in ("a", "b"):
        t = t.join(p.select(F.col("system_id").alias(f"system_{s}"), F.col("lvl").alias(f"l{s}"), F.col("dly").alias(f"d{s}")), f"system_{s}")
    t = t.withColumn("l", F.col("la") - F.col("lb")).withColumn("d", F.col("da") - F.col("db")).withColumn("diff", F.col("l") + F.col("d"))
    t = t.withColumn("commit_pair", F.col("system_a").startswith("commit") | F.col("system_b").startswith("commit"))
    sg = {k: F.signum(F.round(k, 9)) for k in ("l", "d", "diff")}
    med = {f"median_abs_{n}": r6(F.percentile(F.abs(k), F.lit(0.5))) for n, k in (("diff", "diff"), ("delay", "d"), ("endpoint", "l"))}
    return t.groupBy("commit_pair").agg(
        F.count(F.lit(1)).alias("n"), F.sum((sg["d"] == sg["diff"]).cast("bigint")).alias("delay_same_sign"), F.sum((F.abs("d") > F.abs("l") + 1e-9).cast("bigint")).alias("delay_dominant"),
        F.sum((sg["l"] != sg["diff"]).cast("bigint")).alias("endpoint_opposite"), *[c.alias(n) for n, c in med.items()])


@query("h21_pool_comparison", scan_sql(BOTH) + f", pool AS (SELECT 'all' AS pool, * FROM sh WHERE pi_hash<>'{REF.pi_hash}' UNION ALL SELECT 'primary', * FROM sh WHERE pi_hash<>'{REF.pi_hash}' AND system_id NOT LIKE 'commit%'), m AS (SELECT pool, metric, quantile_cont(CASE WHEN in_plaus AND (metric<>'rmscd' OR abs(h_s-h0)<1e-9) THEN abs(shift) END,0.95) AS mrd FROM pool GROUP BY ALL) SELECT metric, round(max(CASE WHEN pool='primary' THEN mrd END),6) AS mrd_primary, round(max(CASE WHEN pool='all' THEN mrd END),6) AS mrd_all FROM m GROUP BY ALL")
def h21(spark, sf):
    """The calibration of the pool without and with one more family, side by side."""
    s = scanned(spark, sf, BOTH)
    a = H.resolution(s.filter(~F.col("system_id").startswith("commit")), REF.pi_hash).select("metric", r6("mrd").alias("mrd_primary"))
    b = H.resolution(s, REF.pi_hash).select("metric", r6("mrd").alias("mrd_all"))
    return a.join(b, "metric", "full_outer")

"""Protocol grid, perturbation, cohort, prefix and lookup (survey section 2.C)."""
from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions.exprs import BOT, TOL, mean_ratio, r6, uniform
from holdfast.operators import protocol as P
from holdfast.operators import trajectory as T
from holdfast.operators.asof import asof_hold
from holdfast.operators.protocol import Protocol, eligible
from holdfast.operators.ranking import exact_quantiles
from holdfast.plans.common import answers, manifest, open_cells, packed, raw_manifest
from holdfast.plans.oracle import grid, open_grid, pgrid, u, with_base
from holdfast.plans.registry import query
from holdfast.sources import derive as D

_KN = """ke(eps) AS (VALUES (-1.0),(-0.5),(-0.25),(0.0),(0.25),(0.5),(1.0)), kj(jit) AS (VALUES (0.0),(0.1),(0.25),(0.5)), kd(delta) AS (VALUES (0.25),(0.5),(1.0)), kh(h) AS (VALUES (2.0),(3.0),(4.0)),
kk AS (SELECT eps::DOUBLE AS eps_sys_s, jit::DOUBLE AS eps_jit_sd_s, delta::DOUBLE AS delta_s, h::DOUBLE AS h_s FROM ke, kj, kd, kh)"""
_ELIG = """, kv AS (SELECT kk.*, m.video_id, m.duration_s - least(greatest(m.anchor_s+eps_sys_s+CASE WHEN eps_jit_sd_s>0 THEN eps_jit_sd_s*sqrt(-2.0::DOUBLE*ln({a}+1.0::DOUBLE/4294967296.0::DOUBLE))*cos(2.0::DOUBLE*pi()*{b}) ELSE 0 END,0),m.duration_s) AS leff FROM kk, man m WHERE m.split='test')""".format(
    a=u("'20260903|'||m.video_id", 1), b=u("'20260903|'||m.video_id", 2))
_GRID_OUT = " SELECT eps_sys_s, eps_jit_sd_s, delta_s, h_s, sum((leff>=h_s-1e-9)::INT)::BIGINT AS n_eligible FROM kv GROUP BY ALL"


def _cohort_sizes(spark, sf, protocols):
    p = P.with_protocols(manifest(spark, sf, "test"), protocols)
    return p.groupBy("pi_hash", *P.KNOBS).agg(
        F.sum(eligible(F.col("post_anchor_length_s_eff"), F.col("h_s")).cast("bigint")).alias("n_eligible"))


@query("c01_axis_scan", with_base(_KN + " ") .replace("FROM ke, kj, kd, kh)", "FROM ke, kj, kd, kh WHERE (eps<>0)::INT+(jit<>0)::INT+(delta<>0.5)::INT+(h<>3.0)::INT <= 1)") + _ELIG + _GRID_OUT)
def c01(spark, sf):
    """One knob at a time, with the cohort each protocol leaves."""
    return _cohort_sizes(spark, sf, P.axis_scan(3.0)).drop("pi_hash")


@query("c02_neighbour_grid", with_base(_KN + " ").replace("FROM ke, kj, kd, kh)", "FROM ke, kj, kd, kh WHERE eps IN (-0.25,0,0.25) AND jit IN (0,0.1) AND delta IN (0.25,0.5,1.0) AND h IN (2.0,3.0,4.0))") + _ELIG + _GRID_OUT)
def c02(spark, sf):
    return _cohort_sizes(spark, sf, P.neighbour_grid(3.0)).drop("pi_hash")


@query("c03_protocol_digest", with_base(_KN + " ").replace("FROM ke, kj, kd, kh)", "FROM ke, kj, kd, kh WHERE (eps<>0)::INT+(jit<>0)::INT+(delta<>0.5)::INT+(h<>3.0)::INT <= 1)") + _ELIG + " SELECT substr(sha256(printf('%.9f|%.9f|%.9f|%.9f|20260903', eps_sys_s, eps_jit_sd_s, delta_s, h_s)),1,12) AS pi_hash, sum((leff>=h_s-1e-9)::INT)::BIGINT AS n_eligible FROM kv GROUP BY ALL")
def c03(spark, sf):
    """Identity of each protocol, computed from its rounded knobs by the column expression."""
    c = _cohort_sizes(spark, sf, P.axis_scan(3.0))
    return c.select(P.digest(*[F.col(k) for k in P.KNOBS], seed=F.lit(P.JIT_SEED)).alias("pi_hash"), "n_eligible")


_JIT = Protocol(eps_sys_s=-0.5, eps_jit_sd_s=0.5, delta_s=0.5, h_s=3.0)


@query("c04_anchor_jitter", with_base(pgrid([_JIT], split=None)) + " SELECT video_id, round(jitter_s,6) AS jitter_s, round_even(jitter_s*fps,0)::BIGINT AS jitter_frames FROM pgj")
def c04(spark, sf):
    p = P.with_protocols(manifest(spark, sf), [_JIT])
    return p.select("video_id", r6("jitter_s").alias("jitter_s"), F.rint(F.col("jitter_s") * F.col("fps")).cast("bigint").alias("jitter_frames"))


@query("c05_perturbed_anchor", with_base(pgrid([_JIT], split=None)) + " SELECT video_id, round(anchor_s_eff,6) AS anchor_s_eff, round(leff,6) AS post_anchor_length_s_eff, anchor_clipped FROM pge")
def c05(spark, sf):
    return P.with_protocols(manifest(spark, sf), [_JIT]).select("video_id", r6("anchor_s_eff").alias("anchor_s_eff"), r6("post_anchor_length_s_eff").alias("post_anchor_length_s_eff"), "anchor_clipped")


@query("c06_cohorts", with_base() + ", h(h_s) AS (VALUES (2.0::DOUBLE),(3.0::DOUBLE),(4.0::DOUBLE)) SELECT h_s, video_id, ((duration_s*20)::BIGINT-(anchor_s*20)::BIGINT >= h_s*20) AS by_frames FROM man, h WHERE post_anchor_length_s >= h_s-1e-9")
def c06(spark, sf):
    """Cohort in seconds with the slack; the exact frame rule must agree."""
    m = manifest(spark, sf).withColumn("h_s", F.explode(F.array(*[F.lit(h) for h in D.HORIZONS])))
    frames = (F.col("duration_s") * 20).cast("bigint") - (F.col("anchor_s") * 20).cast("bigint")
    return m.filter(eligible(F.col("post_anchor_length_s"), F.col("h_s"))).select("h_s", "video_id", (frames >= F.col("h_s") * 20).alias("by_frames"))


@query("c07_cohort_summary", with_base() + """, h(h_s) AS (VALUES (2.0::DOUBLE),(3.0::DOUBLE),(4.0::DOUBLE)), e AS (SELECT h_s, man.*, (post_anchor_length_s>=h_s-1e-9) AS el FROM man, h WHERE split='test'),
w AS (SELECT h_s, sum(el::INT)::BIGINT AS n_h, count(DISTINCT CASE WHEN el THEN source_cluster_id END)::BIGINT AS n_clusters, sum((NOT el)::INT)::BIGINT AS attrition FROM e GROUP BY h_s), k AS (SELECT h_s, class_code, sum(el::INT)::BIGINT AS n_class FROM e GROUP BY ALL)
SELECT w.*, k.class_code, k.n_class, round(k.n_class::DOUBLE/nullif(w.n_h,0),6) AS fraction FROM w JOIN k USING (h_s)""")
def c07(spark, sf):
    """One row per horizon and class of the manifest, with the horizon's totals."""
    m = manifest(spark, sf, "test").withColumn("h_s", F.explode(F.array(*[F.lit(h) for h in D.HORIZONS])))
    el = eligible(F.col("post_anchor_length_s"), F.col("h_s")).cast("bigint")
    per = m.groupBy("h_s", "source_cluster_id", "class_code").agg(F.sum(el).alias("n"), F.sum(1 - el).alias("out"))
    whole = per.groupBy("h_s", "source_cluster_id").agg(F.sum("n").alias("n"), F.sum("out").alias("out")).groupBy("h_s").agg(F.sum("n").alias("n_h"), F.sum((F.col("n") > 0).cast("bigint")).alias("n_clusters"), F.sum("out").alias("attrition"))
    return per.groupBy("h_s", "class_code").agg(F.sum("n").alias("n_class")).join(whole, "h_s").withColumn("fraction", r6(mean_ratio(F.col("n_class"), F.col("n_h"))))


@query("c08_prefix_list", with_base(pgrid([Protocol(0.25, 0.25, 0.5, 2.0)], split=None)) + ", pj AS (SELECT *, unnest(range(0,9))::INT AS j FROM pge) SELECT video_id, j, j*0.5::DOUBLE AS offset_s, round(anchor_s_eff+j*0.5::DOUBLE,6) AS end_s, floor((anchor_s_eff+j*0.5::DOUBLE)*fps+1e-9)::BIGINT AS end_frame, round_even((anchor_s_eff+j*0.5::DOUBLE-anchor_s)/0.5::DOUBLE,0)::INT AS base_j, (leff>=2.0-1e-9) AS eligible_h2, (leff>=3.0-1e-9) AS eligible_h3, (leff>=4.0-1e-9) AS eligible_h4 FROM pj")
def c08(spark, sf):
    p = P.prefixes(P.with_protocols(manifest(spark, sf), [Protocol(0.25, 0.25, 0.5, 2.0)]), D.GRID_MAX, D.HORIZONS, D.DELTA)
    return p.select("video_id", "j", "offset_s", r6("end_s").alias("end_s"), "end_frame", "base_j", "eligible_h2", "eligible_h3", "eligible_h4")


@query("c09_off_grid_frames", with_base() + ", r AS (SELECT video_id, (anchor_s*20)::BIGINT + x.k*7 - (anchor_s*20)::BIGINT AS off FROM man, range(0,12) x(k)) SELECT off AS offset_frames, count(*)::BIGINT AS n, (off%10<>0) AS off_grid, (off//10)::BIGINT AS step_below FROM r GROUP BY ALL")
def c09(spark, sf):
    """Requests every 7 frames against answers stored every 10: what is not a stored step is missing."""
    r = manifest(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    a = (F.col("anchor_s") * 20).cast("bigint")
    r = r.withColumn("offset_frames", a + F.col("k").cast("bigint") * 7 - a)
    return r.groupBy("offset_frames").agg(F.count(F.lit(1)).alias("n")).withColumn("off_grid", F.pmod("offset_frames", F.lit(10)) != 0).withColumn("step_below", F.floor(F.col("offset_frames") / 10))


@query("c10_no_future_read", with_base(pgrid(P.axis_scan(3.0))) + " SELECT pi_hash, count(*)::BIGINT AS n_prefixes, sum((floor((anchor_s_eff+j*delta_s)*fps+1e-9) > floor(duration_s*fps+1e-9))::INT)::BIGINT AS future_reads FROM pgg GROUP BY ALL")
def c10(spark, sf):
    """Inside the eligible window no prefix may end after the last frame."""
    p = P.with_protocols(manifest(spark, sf, "test"), P.axis_scan(3.0)).filter(eligible(F.col("post_anchor_length_s_eff"), F.col("h_s")))
    p = p.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor(F.col("h_s") / F.col("delta_s") + TOL).cast("int"))))
    end = F.floor((F.col("anchor_s_eff") + F.col("j") * F.col("delta_s")) * F.col("fps") + TOL)
    return p.groupBy("pi_hash").agg(F.count(F.lit(1)).alias("n_prefixes"), F.sum((end > F.floor(F.col("duration_s") * F.col("fps") + TOL)).cast("bigint")).alias("future_reads"))


C11 = [Protocol(-0.5, 0.0, 0.5, 3.0), Protocol(0.25, 0.25, 0.25, 2.0), Protocol(1.0, 0.0, 1.0, 2.0)]


@query("c11_absolute_time_lookup", with_base(pgrid(C11)) + " SELECT pi_hash, system_id, count(*)::BIGINT AS n_cells, sum((NOT present)::INT)::BIGINT AS n_missing, round(avg((NOT present)::INT),6) AS missing_rate, sum(pred)::BIGINT AS pred_sum, sum(ok::INT)::BIGINT AS n_correct FROM pg GROUP BY ALL")
def c11(spark, sf):
    c = T.read_grid(manifest(spark, sf, "test"), packed(spark, sf), D.SYSTEM_IDS, C11, D.DELTA)
    miss = (~F.col("present")).cast("bigint")
    return c.groupBy("pi_hash", "system_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(miss).alias("n_missing"), r6(F.avg(miss)).alias("missing_rate"), F.sum("pred").alias("pred_sum"), F.sum(F.col("ok").cast("bigint")).alias("n_correct"))


@query("c12_coarse_subsample", with_base() + " SELECT system_id, (j//2)::INT AS j, delta_s*2 AS delta_s, count(*)::BIGINT AS n, sum(pred)::BIGINT AS pred_sum FROM ans WHERE j%2=0 GROUP BY ALL")
def c12(spark, sf):
    a = answers(spark, sf).filter(F.pmod("j", F.lit(2)) == 0)
    return a.groupBy("system_id", F.floor(F.col("j") / 2).cast("int").alias("j"), (F.col("delta_s") * 2).alias("delta_s")).agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("pred_sum"))


_RR = u("'rr|'||system_id||'|'||video_id||'|'||j")


@query("c13_subsample_equivalence", with_base(f"fi AS (SELECT *, {_RR} AS z FROM ans WHERE j%2=0)") + ", co AS (SELECT system_id, video_id, j//2 AS k, CASE WHEN z<0.02 THEN (pred+1)%5 ELSE pred END AS pred, list_transform(probs, lambda x: x+(CASE WHEN z<0.02 THEN 0.01 ELSE 0 END)::DOUBLE) AS probs FROM fi) SELECT fi.system_id, count(*)::BIGINT AS n, sum((fi.pred<>co.pred)::INT)::BIGINT AS differing, round(max(abs(list_max(fi.probs)-list_max(co.probs))),6) AS max_prob_diff FROM fi JOIN co ON co.system_id=fi.system_id AND co.video_id=fi.video_id AND co.k*2=fi.j GROUP BY ALL")
def c13(spark, sf):
    """A coarse re-run against the sub-sampled fine table."""
    fine = answers(spark, sf).filter(F.pmod("j", F.lit(2)) == 0)
    z = uniform(F.concat_ws("|", F.lit("rr"), "system_id", "video_id", "j"))
    coarse = fine.select("system_id", "video_id", F.floor(F.col("j") / 2).alias("k"), F.when(z < 0.02, F.pmod(F.col("pred") + 1, F.lit(5))).otherwise(F.col("pred")).alias("pred2"),
                         F.transform("probs", lambda x: x + F.when(z < 0.02, 0.01).otherwise(0.0)).alias("probs2"))
    j = fine.withColumn("k", F.floor(F.col("j") / 2)).join(coarse, ["system_id", "video_id", "k"])
    return j.groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") != F.col("pred2")).cast("bigint")).alias("differing"),
                                      r6(F.max(F.abs(F.array_max("probs") - F.array_max("probs2")))).alias("max_prob_diff"))


@query("c14_full_clip_answer", with_base() + " SELECT s.system_id, greatest(least(floor((m.duration_s-m.anchor_s)/0.5::DOUBLE+1e-9)::INT,8),-3) AS full_j, coalesce(a.pred,-1) AS full_pred, count(*)::BIGINT AS n FROM man m CROSS JOIN sys s LEFT JOIN ans a ON a.system_id=s.system_id AND a.video_id=m.video_id AND a.j=greatest(least(floor((m.duration_s-m.anchor_s)/0.5::DOUBLE+1e-9)::INT,8),-3) GROUP BY ALL")
def c14(spark, sf):
    f = T.full_clip_answers(manifest(spark, sf), packed(spark, sf), D.SYSTEM_IDS, D.DELTA, D.J_MIN, D.J_MAX)
    return f.groupBy("system_id", "full_j", "full_pred").agg(F.count(F.lit(1)).alias("n"))


@query("c15_pre_anchor_lookup", with_base() + " SELECT s.system_id, x.j::INT AS j, count(*)::BIGINT AS n, sum((a.pred IS NOT NULL)::INT)::BIGINT AS available, sum((a.pred>=0)::INT)::BIGINT AS answered FROM man m CROSS JOIN sys s, range(-3,0) x(j) LEFT JOIN ans a ON a.system_id=s.system_id AND a.video_id=m.video_id AND a.j=x.j WHERE m.split='test' GROUP BY ALL")
def c15(spark, sf):
    p = T.with_answers(manifest(spark, sf, "test"), packed(spark, sf), D.SYSTEM_IDS)
    p = p.withColumn("j", F.explode(F.sequence(F.lit(-3), F.lit(-1)))).withColumn("pred", T.stored(F.col("j")).getField("pred"))
    return p.groupBy("system_id", "j").agg(F.count(F.lit(1)).alias("n"), F.count("pred").alias("available"), F.sum(F.coalesce(F.col("pred") > BOT, F.lit(False)).cast("bigint")).alias("answered"))


@query("c16_asof_hold", """WITH us AS (SELECT DISTINCT user_id FROM events), b AS (SELECT min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM events), t AS (SELECT user_id, lo + INTERVAL (d) DAY + INTERVAL 12 HOUR AS ts FROM us, b, unnest(range(0, date_diff('day', lo, hi)+1)) q(d))
SELECT t.user_id, t.ts::VARCHAR AS ts, e.value AS value, round((epoch_us(t.ts)-epoch_us(e.ts))/1e6::DOUBLE,3) AS staleness_s FROM t ASOF LEFT JOIN events e ON e.user_id=t.user_id AND t.ts>=e.ts""")
def c16(spark, sf):
    """Value in force for every user at noon of each day, and how old it was."""
    e = D.table(spark, sf, "events").select("user_id", "ts", "value")
    days = e.agg(F.sequence(F.to_date(F.min("ts")), F.to_date(F.max("ts")))).scalar()
    targets = e.select("user_id").distinct().withColumn("day", F.explode(days)).select("user_id", (F.col("day").cast("timestamp_ntz") + F.expr("interval 12 hours")).alias("ts"))
    h = asof_hold(targets, e, "user_id", "ts", F.substring(F.col("ts").cast("string"), 1, 10), ["value"])
    age = F.expr("extract(DAY FROM ts - held_at) * 86400D + extract(HOUR FROM ts - held_at) * 3600D + extract(MINUTE FROM ts - held_at) * 60D + cast(extract(SECOND FROM ts - held_at) AS double)")
    return h.select("user_id", F.col("ts").cast("string").alias("ts"), "value", F.round(age, 3).alias("staleness_s"))


@query("c17_running_feature_mean", """WITH x AS (SELECT vec_id//10 AS clip, vec_id%10 AS i, unnest(embedding) AS v, unnest(range(1,65)) AS d FROM embeddings),
r AS (SELECT clip, i, d, avg(v::DOUBLE) OVER (PARTITION BY clip, d ORDER BY i) AS m FROM x), s AS (SELECT clip, i, sum(m) AS total, sum(m*m) AS sq FROM r GROUP BY ALL), n AS (SELECT vec_id//10 AS clip, max(vec_id%10) AS last FROM embeddings GROUP BY ALL)
SELECT n.clip, k::INT AS k, round(total,4) AS total, round(sq,4) AS sq FROM n, range(0,9) q(k) JOIN s ON s.clip=n.clip AND s.i=least(floor(k*0.5::DOUBLE/0.4::DOUBLE+1e-9)::BIGINT, n.last)""")
def c17(spark, sf):
    """Features every 0.4 s averaged up to each half-second grid time: the last step not after it is held."""
    from pyspark.sql import Window
    e = D.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("clip"), F.pmod("vec_id", F.lit(10)).alias("i"), F.posexplode("embedding").alias("d", "v"))
    upto = Window.partitionBy("clip", "d").orderBy("i")
    m = e.withColumn("m", F.avg(F.col("v").cast("double")).over(upto))
    s = m.groupBy("clip", "i").agg(F.sum("m").alias("total"), F.sum(F.col("m") * F.col("m")).alias("sq"))
    t = D.table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("clip")).agg(F.max(F.pmod("vec_id", F.lit(10))).alias("last"))
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("i", F.least(F.floor(F.col("k") * 0.5 / 0.4 + TOL), F.col("last")))
    return t.join(s, ["clip", "i"]).select("clip", "k", F.round("total", 4).alias("total"), F.round("sq", 4).alias("sq"))


@query("c18_relative_readout", with_base(open_grid()) + ", fr AS (SELECT unnest([0.1,0.25,0.5,0.75,1.0]::DOUBLE[]) AS f) SELECT o.system_id, fr.f AS fraction, count(*)::BIGINT AS n, sum(ok::INT)::BIGINT AS n_correct FROM o JOIN fr ON o.j=floor(fr.f*o.len/0.5::DOUBLE+1e-9)::INT GROUP BY ALL")
def c18(spark, sf):
    """Correctness at fractions of each clip's own length."""
    o = open_cells(spark, sf)
    reads = F.array(*[F.struct(F.lit(f).alias("fraction"), F.floor(F.lit(f) * F.col("post_anchor_length_s") / F.col("delta_s") + TOL).alias("at")) for f in (0.1, 0.25, 0.5, 0.75, 1.0)])
    o = o.withColumn("r", F.explode(F.filter(reads, lambda r: r["at"] == F.col("j"))))
    return o.groupBy("system_id", F.col("r.fraction").alias("fraction")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("bigint")).alias("n_correct"))


@query("c19_horizon_candidates", with_base() + ", q AS (SELECT unnest([0.25,0.5,0.75]::DOUBLE[]) AS p, unnest(quantile_cont(post_anchor_length_s, [0.25,0.5,0.75])) AS h FROM man WHERE split='dev') SELECT p AS quantile, round(h,6) AS horizon_s, sum((post_anchor_length_s>=h-1e-9 AND split='dev')::INT)::BIGINT AS n_dev, sum((post_anchor_length_s>=h-1e-9 AND split='test')::INT)::BIGINT AS n_test FROM q, man GROUP BY p, h")
def c19(spark, sf):
    """Quantiles of development lengths only; each horizon's cohort is then counted."""
    q = exact_quantiles(manifest(spark, sf, "dev"), [], "post_anchor_length_s", [0.25, 0.5, 0.75]).select("q").scalar()
    tally = manifest(spark, sf).groupBy("split", "post_anchor_length_s").agg(F.count(F.lit(1)).alias("n"))
    j = tally.select("*", F.posexplode(q).alias("i", "h")).filter(F.col("post_anchor_length_s") >= F.col("h") - TOL)
    return j.groupBy("i", "h").agg(
        F.sum(F.when(F.col("split") == "dev", F.col("n")).otherwise(0)).alias("n_dev"), F.sum(F.when(F.col("split") == "test", F.col("n")).otherwise(0)).alias("n_test")).select(
        ((F.col("i") + 1) * 0.25).alias("quantile"), r6("h").alias("horizon_s"), "n_dev", "n_test")


@query("c20_length_shift", with_base() + ", q AS (SELECT split, quantile_cont(post_anchor_length_s, [0.25,0.5,0.75]) AS q, avg((post_anchor_length_s>=3.0-1e-9)::INT) AS e FROM man WHERE split IN ('dev','test') GROUP BY ALL) SELECT round(a.q[1]-b.q[1],6) AS d_q25, round(a.q[2]-b.q[2],6) AS d_median, round(a.q[3]-b.q[3],6) AS d_q75, round(a.e-b.e,6) AS d_eligible FROM q a, q b WHERE a.split='test' AND b.split='dev'")
def c20(spark, sf):
    m = manifest(spark, sf).filter(F.col("split").isin("dev", "test"))
    el = m.groupBy("split").agg(F.avg(eligible(F.col("post_anchor_length_s"), 3.0).cast("int")).alias("e"))
    j = exact_quantiles(m, ["split"], "post_anchor_length_s", [0.25, 0.5, 0.75]).join(el, "split")
    def of(split, c):
        return F.max(F.when(F.col("split") == split, c))
    g = j.agg(of("test", F.col("q")).alias("t"), of("dev", F.col("q")).alias("d"), of("test", F.col("e")).alias("et"), of("dev", F.col("e")).alias("ed"))
    return g.select(*[r6(F.get("t", F.lit(i)) - F.get("d", F.lit(i))).alias(n) for i, n in enumerate(("d_q25", "d_median", "d_q75"))], r6(F.col("et") - F.col("ed")).alias("d_eligible"))


@query("c21_attrition_funnel", with_base() + """, f AS (SELECT split_raw AS split, source_cluster_id, lower(decode_ok) IN ('true','1','yes') AS readable, post_anchor_length_s>=0 AS anchored, post_anchor_length_s AS l FROM raw)
SELECT coalesce(split,'all') AS scope, count(*)::BIGINT AS n_raw, sum(readable::INT)::BIGINT AS n_readable, sum((readable AND anchored)::INT)::BIGINT AS n_anchor_valid, count(DISTINCT CASE WHEN readable AND anchored THEN source_cluster_id END)::BIGINT AS n_clusters,
 sum((readable AND anchored AND l>=2.0-1e-9)::INT)::BIGINT AS n_h2, sum((readable AND anchored AND l>=3.0-1e-9)::INT)::BIGINT AS n_h3, sum((readable AND anchored AND l>=4.0-1e-9)::INT)::BIGINT AS n_h4 FROM f GROUP BY GROUPING SETS ((split),())""")
def c21(spark, sf):
    """Raw, readable, anchor-valid, clusters, eligible per horizon; per split and in all."""
    m = raw_manifest(spark, sf)
    ok = F.lower("decode_ok").isin("true", "1", "yes")
    good = ok & (F.col("post_anchor_length_s") >= 0)
    def one(c):
        return F.sum(c.cast("bigint"))
    flags = {"n_readable": ok, "n_anchor_valid": good, **{f"n_h{h:g}": good & eligible(F.col("post_anchor_length_s"), h) for h in D.HORIZONS}}
    per = m.groupBy(F.col("split_raw").alias("scope"), "source_cluster_id").agg(F.count(F.lit(1)).alias("n_raw"), *[one(c).alias(n) for n, c in flags.items()])
    sums = [F.sum(c).alias(c) for c in ["n_raw", *flags]]
    has = F.sum((F.col("n_anchor_valid") > 0).cast("bigint")).alias("n_clusters")
    by_split = per.groupBy("scope").agg(*sums, has)
    whole = per.groupBy("source_cluster_id").agg(*sums).agg(*sums, has).withColumn("scope", F.lit("all"))
    return by_split.unionByName(whole)


@query("c22_descriptive_statistics", with_base() + " SELECT split, count(*)::BIGINT AS n, round(avg(post_anchor_length_s),6) AS mean, min(post_anchor_length_s) AS min, round(quantile_cont(post_anchor_length_s,0.25),6) AS q25, round(median(post_anchor_length_s),6) AS median, round(quantile_cont(post_anchor_length_s,0.75),6) AS q75, max(post_anchor_length_s) AS max, sum((post_anchor_length_s<=0)::INT)::BIGINT AS n_degenerate FROM man GROUP BY ALL")
def c22(spark, sf):
    """Moments by one aggregation; exact quantiles from bucketed running counts."""
    m, l = manifest(spark, sf), F.col("post_anchor_length_s")
    q = exact_quantiles(m, ["split"], "post_anchor_length_s", [0.25, 0.5, 0.75]).select("split", "q")
    g = m.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(l)).alias("mean"), F.min(l).alias("min"), F.max(l).alias("max"), F.sum((l <= 0).cast("bigint")).alias("n_degenerate"))
    return g.join(q, "split").select("split", "n", "mean", "min", *[r6(F.get("q", F.lit(i))).alias(c) for i, c in enumerate(("q25", "median", "q75"))], "max", "n_degenerate")

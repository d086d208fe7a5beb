"""Streaming forms of the causal rules (survey section 2.K)."""
from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions.exprs import TOL, uniform
from holdfast.plans import queries_f as QF
from holdfast.plans.common import answers, manifest
from holdfast.plans.oracle import grid, u, with_base
from holdfast.plans.registry import query
from holdfast.plans.stages import _PATHS, stage
from holdfast.sources import derive as D
from holdfast.session import fresh_path
from holdfast.streaming import live as L

EPOCH = 1704067200  # first instant of the feed, seconds


def feed_path(spark, sf):
    """Live feed of the eligible test clips: every answer with its event time and its clip's close time.

    Two closing rows of no system, days later, move the watermark past the last clip and then past the first of them.
    """
    def build():
        m = manifest(spark, sf, "test").filter(F.col("post_anchor_length_s") >= 3.0 - TOL).select("video_id", "class_code")
        start = F.floor(uniform(F.concat(F.lit("start|"), F.col("video_id"))) * 2592000) * 1000
        a = answers(spark, sf).select("system_id", "video_id", "j", "pred", "probs").join(m, "video_id")
        base = F.lit(EPOCH * 1000) + start
        rows = a.select("system_id", "video_id", "class_code", "j", "pred", "probs",
                        F.timestamp_millis(base + (F.col("j") + 3) * 500).alias("event_time"), F.timestamp_millis(base + 4500).alias("close_time"))
        end = F.max(F.unix_millis("event_time")) + 864000000
        nothing = [F.lit("").alias("system_id"), F.lit("").alias("video_id"), F.lit(0).alias("class_code"), F.lit(0).alias("pred"), F.lit(None).cast("array<double>").alias("probs")]
        last = rows.agg(end.alias("_end")).select(*nothing, F.explode(F.array(F.lit(0), F.lit(1))).alias("j"), "_end")
        at = F.timestamp_millis(F.col("_end") + F.col("j") * 86400000)
        return rows.unionByName(last.select("*", at.alias("event_time"), at.alias("close_time")).drop("_end"))
    stage(spark, sf, "feed", build)
    return _PATHS[(spark.sparkContext.applicationId, sf, "feed")]


def feed(spark, sf):
    return L.read_feed(spark, feed_path(spark, sf))


_ELIG = "JOIN (SELECT video_id, class_code FROM man WHERE split='test' AND post_anchor_length_s>=3.0-1e-9) m USING (video_id)"


_ON = "{0}.system_id=a.system_id AND {0}.video_id=a.video_id AND {0}.j=a.j"


@query("k01_live_smoothing", QF.RECURSIVE + QF.ema_cte("em", 0.35) + QF.hysteresis_cte("hy", 0.2) + QF.patience_cte("pa", 2) + f" SELECT a.system_id, a.video_id, a.j, (CASE WHEN em.q IS NULL THEN -1 ELSE list_position(em.q, list_max(em.q))-1 END)::INT AS ema_pred, hy.cur AS hysteresis_pred, pa.cur AS patience_pred FROM ans a {_ELIG} " + " ".join(f"JOIN {t} ON {_ON.format(t)}" for t in ("em", "hy", "pa")))
def k01(spark, sf):
    """Smoothing, hysteresis and patience on the live feed of the base systems."""
    base = F.col("system_id").startswith("prefix") | F.col("system_id").startswith("clip") | (F.col("system_id") == "")
    out = L.run_available(L.live_smoothing(feed(spark, sf).filter(base), D.J_MIN), "live-smoothing")
    return out.filter("system_id <> ''").select("system_id", "video_id", "j", "ema_pred", "hysteresis_pred", "patience_pred")


@query("k02_live_commitment", with_base() + f" SELECT a.system_id, a.video_id, (count(f.fj)>0) AS committed, any_value(f.lab)::INT AS label, coalesce(min(f.fj)*0.5::DOUBLE, 3.0::DOUBLE) AS tau_s FROM ans a {_ELIG} LEFT JOIN (SELECT system_id, video_id, min(j) AS fj, arg_min(list_position(probs, list_max(probs))-1, j) AS lab FROM ans WHERE j BETWEEN 0 AND 6 AND list_max(probs)>=0.8::DOUBLE GROUP BY ALL) f ON f.system_id=a.system_id AND f.video_id=a.video_id GROUP BY a.system_id, a.video_id")
def k02(spark, sf):
    """Irrevocable commitment at probability 0.8, said once per clip when it closes."""
    out = L.run_available(L.live_commitment(feed(spark, sf), 0.8, 6, D.DELTA), "live-commitment")
    return out.filter("system_id <> ''")


@query("k03_clip_closure", with_base(grid(3.0)) + " SELECT system_id, video_id, round(delay,6) AS delay, flips, missing AS n_missing, (endok=1) AS end_ok FROM gc")
def k03(spark, sf):
    """Final clip metrics once the watermark passes the end of the window."""
    out = L.run_available(L.live_closure(feed(spark, sf), 6, D.DELTA), "live-closure")
    return out.filter("system_id <> ''").select("system_id", "video_id", "delay", F.col("flips").cast("bigint").alias("flips"), F.col("n_missing").cast("bigint").alias("n_missing"), "end_ok")


@query("k04_running_health", with_base() + f", fe AS (SELECT a.system_id, a.pred, lag(a.pred) OVER w AS prev, a.j - coalesce(lag(a.j) OVER w, -4) - 1 AS gap, ({EPOCH}*1000::BIGINT + floor({u(chr(39)+'start|'+chr(39)+'||a.video_id')}*2592000)::BIGINT*1000 + (a.j+3)*500)//86400000 AS d FROM ans a {_ELIG} WINDOW w AS (PARTITION BY a.system_id, a.video_id ORDER BY a.j)) SELECT system_id, (d*86400)::BIGINT AS window_start, count(*)::BIGINT AS n_answers, sum((pred=-1)::INT)::BIGINT AS n_bot, sum((prev IS NOT NULL AND prev<>pred)::INT)::BIGINT AS n_flips, sum(gap)::BIGINT AS n_missing FROM fe GROUP BY ALL")
def k04(spark, sf):
    """Daily counts of answers, empty answers, changes and missing steps; a second stream reads the steps that the first has put in order."""
    path = fresh_path(spark, "live-steps")
    L.run_available(L.live_smoothing(feed(spark, sf), D.J_MIN), "live-steps", path=path)
    return L.run_available(L.live_health(L.read_steps(spark, path)), "live-health").filter("system_id <> ''")

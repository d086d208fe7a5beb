"""Rules across stored results (survey A20) and text answers under one contract (A4)."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from holdfast.functions.exprs import BOT, uniform
from holdfast.operators import calibration as H
from holdfast.operators import consistency as Q
from holdfast.operators import inference as G
from holdfast.operators import trajectory as T
from holdfast.plans import queries_g as QG
from holdfast.plans import queries_h as QH
from holdfast.plans.common import answers, clips, points, samples
from holdfast.plans.oracle import u, with_base
from holdfast.plans.registry import query
from holdfast.plans.stages import _PATHS, stage
from holdfast.sources import derive as D
from holdfast.sources import text_answers as X

_N = 12  # systems
_RULES = QH.pair_sql(QH.BOTH) + QH._CAL + QG.HOLM.replace("p_adj", "p_adj") + f""", ix2 AS (SELECT system_id, quantile_cont(value,0.025) AS lo, quantile_cont(value,0.975) AS hi FROM sl WHERE metric='end_macro_acc' GROUP BY ALL),
q AS (SELECT 'tests' AS source, unnest(['pair_ordered','p_has_a_floor','adjusted_not_below_raw','reject_by_adjusted','interval_ordered','difference_of_points']) AS rule, (SELECT count(*) FROM ha) AS checked
UNION ALL SELECT 'ties', unnest(['tie_ordered','intervals_overlap']), (SELECT count(*) FROM td)
UNION ALL SELECT 'calibration', unnest(['ruler_from_ties','pairs_are_the_separated','reference_rank_is_one','least_rank_in_range','verdict_by_rule']), (SELECT count(*) FROM ca)
UNION ALL SELECT 'scan', unnest(['systems_times_metrics','no_row_twice','no_rerun_as_system']), (SELECT count(DISTINCT pi_hash) FROM sc)
UNION ALL SELECT 'clips', unnest(['one_cohort','no_clip_twice']), (SELECT count(DISTINCT video_id) FROM gc)
UNION ALL SELECT 'clips', unnest(['delay_within_window','parts_add_up','stable_end_has_onset']), (SELECT count(*) FROM gc)),
v AS (SELECT 'p_has_a_floor' AS rule, count(*) AS n FROM ha WHERE NOT p BETWEEN 1.0/{QG.N_BOOT}-1e-12 AND 1 UNION ALL SELECT 'adjusted_not_below_raw', count(*) FROM ha WHERE p_adj<p-1e-12 UNION ALL SELECT 'interval_ordered', count(*) FROM ha WHERE ci_lo>ci_hi
UNION ALL SELECT 'intervals_overlap', count(*) FROM td JOIN ix2 x ON x.system_id=system_a JOIN ix2 y ON y.system_id=system_b WHERE greatest(x.lo,y.lo)>least(x.hi,y.hi)
UNION ALL SELECT 'least_rank_in_range', count(*) FROM ca WHERE NOT min_r BETWEEN 0 AND 1 UNION ALL SELECT 'systems_times_metrics', count(*) FROM (SELECT pi_hash, count(*) AS n FROM sc GROUP BY ALL) WHERE n<>{_N}*5
UNION ALL SELECT 'one_cohort', count(*) FROM (SELECT video_id, count(*) AS n FROM gc GROUP BY ALL) WHERE n<>{_N} UNION ALL SELECT 'delay_within_window', count(*) FROM gc WHERE NOT delay BETWEEN 0 AND 3 UNION ALL SELECT 'parts_add_up', count(*) FROM gc WHERE abs(delay-err-retr)>1e-10 UNION ALL SELECT 'stable_end_has_onset', count(*) FROM gc WHERE (endok=1)<>(onset IS NOT NULL))
SELECT source, rule, checked::BIGINT AS checked, coalesce(n,0)::BIGINT AS violations FROM q LEFT JOIN v USING (rule)"""


@query("a20_stored_results", _RULES)
def a20s(spark, sf):
    """Every rule over stored comparisons, ties, calibration, scan and clips; every count must be zero."""
    tests = G.holm(QG.tests(spark, sf), ["metric"], "p_percentile")
    end = G.percentile_interval(samples(spark, sf).filter("metric = 'end_macro_acc'"), ["system_id"])
    scan = QH.scanned(spark, sf, QH.BOTH)
    ranks = H.rank_preservation(scan, QH.separated(spark, sf), QH.REF.pi_hash)
    parts = [
        Q.test_rules(tests, points(spark, sf)), Q.tie_rules(QG.tied(spark, sf), end),
        Q.calibration_rules(QH.calibrated(spark, sf), QG.tied(spark, sf), points(spark, sf), QH.separated(spark, sf), ranks, QH.REF.pi_hash),
        Q.scan_rules(scan, len(D.SYSTEM_IDS), len(T.FAMILY)), Q.clip_rules(clips(spark, sf), len(D.SYSTEM_IDS))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("source", "rule", "checked", "violations")


# Text answers: one folder of CSV files per system, some of them broken in a known way.
_Z = u("'text|'||system_id||'|'||video_id||'|'||j")
_BROKEN = {"no_pred": "clip__mean__seed12", "mixed_step": "clip__mean__seed13", "bad_record": "prefix__gru64__seed12"}


def text_folder(spark, sf):
    """Answers of the base systems written as text in the wide form; three systems break the contract."""
    def build():
        a = answers(spark, sf).filter(F.col("system_id").startswith("clip") | F.col("system_id").startswith("prefix"))
        z = uniform(F.concat_ws("|", F.lit("text"), "system_id", "video_id", "j"))
        a = a.withColumn("_z", z).withColumn("delta_s", F.when((F.col("system_id") == _BROKEN["mixed_step"]) & (F.col("_z") < 0.01), 0.25).otherwise(F.col("delta_s")))
        rest = [F.get("probs", F.lit(k)).cast("string").alias(f"p{k}") for k in range(5)]
        whole = F.when((F.col("system_id") == _BROKEN["bad_record"]) & (F.col("_z") < 0.01), "none").otherwise(F.col("pred").cast("string"))
        return a.select("system_id", "video_id", F.col("j").cast("string").alias("j"), F.col("delta_s").cast("string").alias("delta_s"), whole.alias("pred"), *rest, F.col("committed").cast("string").alias("committed"))
    rows = stage(spark, sf, "text_rows", build)
    key = (spark.sparkContext.applicationId, sf, "text_folder")
    if key not in _PATHS:
        from holdfast.session import fresh_path
        path = fresh_path(spark, "text-answers")
        short = F.col("system_id") == _BROKEN["no_pred"]
        rows.filter(~short).write.partitionBy("system_id").option("header", True).csv(os.path.join(path, "full"))
        rows.filter(short).drop("pred").write.partitionBy("system_id").option("header", True).csv(os.path.join(path, "short"))
        _PATHS[key] = path
    return _PATHS[key]


_TX = f"""tx AS (SELECT *, {_Z} AS z FROM ans WHERE system_id LIKE 'clip%' OR system_id LIKE 'prefix%'),
tr AS (SELECT system_id, count(*) AS n, CASE system_id WHEN '{_BROKEN['no_pred']}' THEN 'missing columns: pred' WHEN '{_BROKEN['mixed_step']}' THEN 'mixed step' WHEN '{_BROKEN['bad_record']}' THEN 'broken records' END AS refused, sum((z<0.01)::INT) AS k FROM tx GROUP BY ALL)"""


@query("a04_text_sources", with_base(_TX) + f" SELECT system_id, n::BIGINT AS n_records, (CASE WHEN refused IN ('broken records') THEN k ELSE 0 END)::BIGINT AS n_broken, refused FROM tr")
def a04x(spark, sf):
    """Every system's text files under the contract: accepted, or refused by name with the reason."""
    folder = text_folder(spark, sf)
    files = X.read_text(spark, [os.path.join(folder, "full"), os.path.join(folder, "short")])
    return X.verdicts(files).select("system_id", "n_records", "n_broken", "refused")


@query("a04_text_answers", with_base(_TX) + " SELECT tx.system_id, count(*)::BIGINT AS n_cells, sum(pred)::BIGINT AS pred_sum, sum((probs IS NULL)::INT)::BIGINT AS n_without_probs, round(sum(list_max(probs)),4) AS top_sum, sum(committed::INT)::BIGINT AS n_committed, min(j)::INT AS j_min, max(j)::INT AS j_max FROM tx JOIN tr USING (system_id) WHERE refused IS NULL GROUP BY ALL")
def a04t(spark, sf):
    """Answers of the accepted systems, typed; the same table as from any other source."""
    folder = text_folder(spark, sf)
    files = X.read_text(spark, [os.path.join(folder, "full"), os.path.join(folder, "short")])
    a = X.accepted(files)
    return a.groupBy("system_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("pred").alias("pred_sum"), F.count(F.when(F.col("probs").isNull(), 1)).alias("n_without_probs"), F.round(F.sum(F.array_max("probs")), 4).alias("top_sum"),
                                      F.count(F.when(F.col("committed"), 1)).alias("n_committed"), F.min("j").alias("j_min"), F.max("j").alias("j_max"))

"""Rules across results each show their violation; text answers are refused by name; the group gate; macro draws."""
import os

import pytest

from holdfast.operators import calibration as H
from holdfast.operators import consistency as Q
from holdfast.operators import inference as G
from holdfast.sources import text_answers as X


def broken(df):
    return {r.rule: r.violations for r in df.collect() if r.violations}


TEST = dict(metric="m", system_a="a", system_b="b", diff=1.0, ci_lo=0.5, ci_hi=1.5, se=0.2, n_boot=100, p_percentile=0.01, p_adjusted=0.03, reject=True)
TESTS = "metric string, system_a string, system_b string, diff double, ci_lo double, ci_hi double, se double, n_boot long, p_percentile double, p_adjusted double, reject boolean"


@pytest.mark.parametrize("change,rule", [({}, None), ({"system_a": "b", "system_b": "a", "diff": -1.0}, "pair_ordered"), ({"p_percentile": 0.001, "p_adjusted": 0.003}, "p_has_a_floor"), ({"p_percentile": None}, "p_has_a_floor"),
                                         ({"p_adjusted": 0.005}, "adjusted_not_below_raw"), ({"reject": False}, "reject_by_adjusted"), ({"ci_lo": 2.0}, "interval_ordered"), ({"diff": 1.5}, "difference_of_points")])
def test_rules_of_tests(spark, change, rule):
    t = spark.createDataFrame([tuple({**TEST, **change}.values())], TESTS)
    points = spark.createDataFrame([("a", "m", 3.0), ("b", "m", 2.0)], "system_id string, metric string, value double")
    got = broken(Q.test_rules(t, points))
    assert (not got) if rule is None else got.get(rule) == 1


def test_rules_of_intervals_ties_and_scan(spark):
    cols = "metric string, system_a string, system_b string, significant boolean, p_adjusted double, ci_lo double, ci_hi double, ci_holm_lo double, ci_holm_hi double, ci_bonferroni_lo double, ci_bonferroni_hi double"
    rows = [("m", "a", "b", True, 0.01, 1.0, 2.0, 0.5, 2.5, 0.4, 2.6), ("m", "a", "c", True, 0.2, 1.0, 2.0, 0.5, 2.5, 0.4, 2.6), ("m", "a", "d", True, 0.01, 1.0, 2.0, -0.5, 2.5, -0.6, 2.6), ("m", "a", "e", False, 0.9, -1.0, 2.0, -0.5, 2.5, 0.0, 2.0)]
    r = {x.rule: (x.violations, x.example, x.checked) for x in Q.interval_rules(spark.createDataFrame(rows, cols)).collect()}
    assert r == {"significant_by_adjusted": (1, "m|a|c", 4), "significant_clear_of_zero": (1, "m|a|d", 4), "bonferroni_not_narrower": (1, "m|a|e", 4)}
    iv = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.5, 2.0), ("c", 1.5, 3.0)], "system_id string, ci_lo double, ci_hi double")
    ties = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b")], "system_a string, system_b string")
    assert broken(Q.tie_rules(ties, iv)) == {"tie_ordered": 1, "intervals_overlap": 1}
    scan = spark.createDataFrame([("p", "a", "m"), ("p", "b", "m"), ("q", "a", "m"), ("q", "a", "m"), ("r", "a", "m"), ("r", "b__stride2", "m"), ("s", "a", "m")], "pi_hash string, system_id string, metric string")
    assert broken(Q.scan_rules(scan, 2, 1)) == {"systems_times_metrics": 1, "no_row_twice": 1, "no_rerun_as_system": 1}


@pytest.mark.parametrize("change,rule", [({}, None), ({"ruler": 0.9}, "ruler_from_ties"), ({"n_pairs": 5}, "pairs_are_the_separated"), ({"min_r": 1.5}, "least_rank_in_range"), ({"mrd": 2.0}, "verdict_by_rule"), ({"r": 0.5}, "reference_rank_is_one")])
def test_rules_of_calibration(spark, change, rule):
    v = {"min_r": 0.95, "mrd": 0.5, "ruler": 1.0, "n_pairs": 1, "r": 1.0, **change}
    cal = spark.createDataFrame([("m", v["min_r"], v["mrd"], v["ruler"], v["n_pairs"], "poolable")], "metric string, min_r double, mrd double, ruler double, n_pairs long, verdict string")
    ties = spark.createDataFrame([("a", "b")], "system_a string, system_b string")
    points = spark.createDataFrame([("a", "m", 3.0), ("b", "m", 2.0)], "system_id string, metric string, value double")
    separated = spark.createDataFrame([("m", "a", "c")], "metric string, system_a string, system_b string")
    ranks = spark.createDataFrame([("ref", "m", v["r"]), ("x", "m", 0.95)], "pi_hash string, metric string, r_m double")
    got = broken(Q.calibration_rules(cal, ties, points, separated, ranks, "ref"))
    assert got == ({} if rule is None else {rule: 1})


def test_rules_of_clips_and_controls(spark):
    cols = "system_id string, video_id string, h_s double, delay double, err_area double, retr_area double, end_ok int, onset_j int"
    rows = [("a", "v", 3.0, 1.0, 0.5, 0.5, 1, 2), ("b", "v", 3.0, 4.0, 4.0, 0.0, 0, None), ("a", "w", 3.0, 1.0, 0.5, 0.4, 1, 2), ("a", "w", 3.0, 1.0, 1.0, 0.0, 0, 2)]
    assert broken(Q.clip_rules(spark.createDataFrame(rows, cols), 2)) == {"no_clip_twice": 1, "delay_within_window": 1, "parts_add_up": 1, "stable_end_has_onset": 1}
    gate = spark.createDataFrame([("o", 0.0, 0.0, True), ("p", 0.1, 0.0, False), ("q", 5.0, 1.0, None)], "system_id string, own_gap double, fixed_gap double, control_passed boolean")
    assert broken(Q.control_rules(gate)) == {"control_without_gap": 1, "control_passes": 1}


@pytest.mark.parametrize("control,real,block,want", [
    (True, [True, False], [True, True], (True, "passed", True)), (True, [False, False, True], [True, True], (True, "failed", False)), (True, [True], [True, False], (True, "failed", False)),
    (False, [True], [True], (False, "invalid_computation", None)), (True, [None, True], [True], (True, "undefined", None)), (None, [True], [True], (False, "invalid_computation", None))])
def test_group_gate(spark, control, real, block, want):
    rows = [(f"r{k}", "real", c, None) for k, c in enumerate(real)] + [(f"b{k}", "random_block", c, None) for k, c in enumerate(block)]
    rows.append(("o", "other_block", False, control))
    g = H.group_gate(spark.createDataFrame(rows, "system_id string, role string, consequence boolean, control_passed boolean")).collect()
    assert {(r.computation_valid, r.status, r.pass_gate) for r in g} == {want}
    assert {r.role: r.n for r in g} == {"real": len(real), "random_block": len(block), "other_block": 1}


def test_macro_draws_support_every_class(spark):
    clusters = spark.createDataFrame([(f"c{k}", 0 if k < 7 else 1) for k in range(8)], "source_cluster_id string, class_code int")
    w, rejected = G.supported_weights(clusters.select("source_cluster_id"), clusters, 40, 3)
    got = w.collect()
    assert {r.b for r in got} == set(range(40)) and {r.b for r in got if r.source_cluster_id == "c7"} == set(range(40))
    assert all(sum(r.w for r in got if r.b == b) == 8 for b in range(40)) and rejected.first()[0] > 0


def test_outcomes_below_the_resolvable_difference_are_ties(spark):
    from pyspark.sql import functions as F
    from holdfast.operators import agreement as A
    rows = [("agree", 1.0, 2.0, 1.0, 3.0, 0.5), ("reverse", 1.0, -2.0, -3.0, -1.0, 0.5), ("tie", 1.0, 0.4, 0.1, 0.7, 0.5), ("agree", 1.0, 0.4, 0.1, 0.7, None), ("tie", 1.0, 2.0, -1.0, 3.0, None),
            ("uncertain", 1.0, None, None, None, 0.5), ("uncertain", 0.0, 2.0, 1.0, 3.0, 0.5), ("uncertain", 1.0, 2.0, 3.0, 1.0, 0.5), ("agree", 1.0, 0.5, 0.1, 0.7, 0.5)]
    df = spark.createDataFrame(rows, "want string, a double, b double, lo double, hi double, ruler double")
    got = df.select("want", A.outcome(*map(F.col, ("a", "b", "lo", "hi", "ruler"))).alias("o")).collect()
    assert [r.o for r in got] == [r.want for r in got]
    readings = spark.createDataFrame([(0.4, -0.1, 0.9), (-0.2, -0.5, 0.1), (5.0, 4.0, 6.0)], "diff double, ci_lo double, ci_hi double")
    assert abs(spark.range(1).select(A.track_ruler(readings)).first()[0] - 0.3) < 1e-12


def test_the_earliest_answer_to_a_step_counts(spark):
    from datetime import datetime, timedelta
    from holdfast.session import fresh_path
    from holdfast.streaming import live as L
    t0, p = datetime(2024, 1, 1), [0.9, 0.1]
    row = lambda j, pred, s: ("s", "v", 0, j, pred, p if pred == 0 else p[::-1], t0 + timedelta(seconds=s), t0 + timedelta(seconds=60))
    far = [("", "", 0, k, 0, None, t0 + timedelta(days=k + 1), t0 + timedelta(days=k + 1)) for k in (0, 1)]
    seen = []
    for order in ([row(0, 1, 5), row(0, 0, 2), row(2, 1, 9), row(2, 0, 8)], [row(2, 0, 8), row(2, 1, 9), row(0, 0, 2), row(0, 1, 5)]):
        path = fresh_path(spark, "feed-twice")
        for r in order + far:
            spark.createDataFrame([r], L.FEED).coalesce(1).write.mode("append").parquet(path)
        out = L.run_available(L.live_smoothing(L.read_feed(spark, path, 1), 0), "t").filter("system_id <> ''")
        seen.append(sorted((r.j, r.pred, r.ema_pred, r.changed, r.n_missing) for r in out.collect()))
    assert seen[0] == seen[1] == [(0, 0, 0, False, 0), (2, 0, 0, False, 1)]


def folder(files):
    import tempfile
    root = tempfile.mkdtemp(prefix="text-")
    for system, name, body in files:
        os.makedirs(os.path.join(root, f"system_id={system}"), exist_ok=True)
        with open(os.path.join(root, f"system_id={system}", name), "w") as f:
            f.write(body)
    return root


def test_text_answers_are_accepted_or_refused_by_name(spark):
    head = "video_id,j,delta_s,pred,committed,p0,p1\n"
    root = folder([
        ("ok", "a.csv", head + "v,0,0.5,1,True,0.2,0.8\nv,1,0.5,-1,false,,\n"), ("ok", "b.csv", "pred,extra,delta_s,j,video_id\n0,x,0.5,0,w\n"),
        ("short", "a.csv", "video_id,j,delta_s\nv,0,0.5\n"), ("mixed", "a.csv", head + "v,0,0.5,1,1,,\nv,1,0.25,1,1,,\n"), ("bad", "a.csv", head + "v,zero,0.5,1,1,,\n"),
        ("ragged", "a.csv", head + "v,0,0.5\n"), ("twice", "a.csv", head + "v,0,0.5,1,1,,\n"), ("twice", "b.csv", head + "v,0,0.5,0,1,,\n"), ("halfprob", "a.csv", head + "v,0,0.5,1,1,x,0.5\n")])
    t = X.read_text(spark, [root], 2)
    assert {r.system_id: r.refused for r in X.verdicts(t, 2).collect()} == {
        "ok": None, "short": "missing columns: pred", "mixed": "mixed step", "bad": "broken records", "ragged": "broken records", "twice": "repeated cells", "halfprob": "broken records"}
    assert sorted(map(tuple, X.accepted(t, 2).collect())) == [("ok", "v", 0, 0.5, 1, [0.2, 0.8], True), ("ok", "v", 1, 0.5, -1, None, False), ("ok", "w", 0, 0.5, 0, None, False)]
    with pytest.raises(ValueError, match="answers of bad: broken records"):
        X.require(t, 2)
    assert X.require(t.filter("system_id = 'ok'"), 2).count() == 3

"""Hand-computed trajectories, missing cells, perturbation and closed forms."""
import itertools

import pytest
from pyspark.sql import functions as F

from conftest import answers_of, manifest_of
from holdfast.operators import arms as R
from holdfast.operators import trajectory as T
from holdfast.operators.protocol import Protocol, axis_scan, eligible, neighbour_grid, plausible_grid, with_protocols

# Truth 2, seven points half a second apart; last wrong points 3, 4, none, 6, 0.
PATHS = {
    "one_dip": [2, 2, 2, 0, 2, 2, 2],
    "late": [0, 1, 1, 3, 3, 2, 2],
    "always": [2] * 7,
    "lost_at_end": [1, 2, 2, 2, 2, 2, 0],
    "silent_start": [-1, 2, 2, 2, 2, 2, 2],
}


def clips(spark, paths, y=0, h=3.0, **kw):
    m = manifest_of(spark, [(v, y, 1.0, 5.0) for v in paths])
    return T.clips_at(m, answers_of(spark, paths, **kw), ["s"], [Protocol(h_s=h)], 0.5)


def test_handmade_paths(spark):
    got = {r.video_id: (r.delay, r.flips, r.onset_j) for r in clips(spark, PATHS, 2).collect()}
    assert got == {"one_dip": (1.75, 2, 4), "late": (2.25, 3, 5), "always": (0.0, 0, 0), "lost_at_end": (3.0, 2, None), "silent_start": (0.25, 1, 1)}


def test_handmade_curve_and_family(spark):
    c = clips(spark, PATHS, 2)
    curve = [r.s_h for r in T.stable_curve(c, ["system_id"]).orderBy("j").collect()]
    assert curve == [0.2, 0.4, 0.4, 0.4, 0.6, 0.8, 0.8]
    f = T.frozen_family(c, ["system_id", "h_s"]).first()
    assert abs(f.rmscd - 1.45) < 1e-12 and f.s_at_1 == 0.4 and f.s_at_3 == 0.8 and f.median_flips == 2.0 and f.end_macro_acc == 0.8


def test_family_takes_any_class_and_short_horizons(spark):
    m = manifest_of(spark, [("a", 6, 1.0, 5.0), ("b", 0, 1.0, 5.0)])
    c = T.clips_at(m, answers_of(spark, {"a": [6] * 7, "b": [3] * 7}), ["s"], [Protocol(h_s=2.0)], 0.5)
    f = T.frozen_family(c, ["system_id", "h_s"]).first()
    assert f.end_macro_acc == 0.5 and f.s_at_1 == 0.5 and f.s_at_3 is None and f.n_clips == 2
    from holdfast.operators import inference as G
    draws = spark.createDataFrame([(0, "a", 1), (0, "b", 1)], "b int, source_cluster_id string, w long")
    got = {r.metric: r.value for r in G.family_samples(c, draws).collect()}
    assert got["s_at_3"] is None and got["s_at_1"] == 0.5 and got["end_macro_acc"] == 0.5


def test_votes_take_any_class(spark):
    rows = [("s", "v", j, b) for j, b in enumerate([7, 7, 9, 9, 9, -1, 7])]
    steps = spark.createDataFrame(rows, "system_id string, video_id string, j int, base int")
    got = R.majority(steps, 3).orderBy("j").collect()
    assert [r.pred for r in got] == [7, 7, 7, 9, 9, -1, 7] and len(got[0].probs) == 8 and got[2].probs[7] == pytest.approx(2 / 3)


def test_file_digests_and_expected_list(spark, tmp_path):
    import hashlib
    from holdfast.sources.manifest import file_digests, verify_digests
    for name, data in (("a.bin", b"x" * 5000), ("b.bin", b"zz"), ("c.bin", b"q" * 10)):
        (tmp_path / name).write_bytes(data)
    whole = {r.name: r.digest for r in file_digests(spark, f"{tmp_path}/*.bin").collect()}
    parts = {r.name: r.digest for r in file_digests(spark, f"{tmp_path}/*.bin", limit=100, step=999).collect()}
    assert whole == parts and whole["a.bin"] == hashlib.sha256(b"x" * 5000).hexdigest()
    expected = spark.createDataFrame([("a.bin", 5000, "0"), ("b.bin", 1, whole["b.bin"]), ("d.bin", 1, "1")], "name string, length long, digest string")
    status = {r.name: r.status for r in verify_digests(file_digests(spark, f"{tmp_path}/*.bin"), expected).collect()}
    assert status == {"a.bin": "digest_differs", "b.bin": "length_differs", "c.bin": "unexpected", "d.bin": "missing"}


def test_file_digests_hold_no_file_as_a_value(spark, tmp_path):
    import hashlib
    from holdfast.sources.manifest import file_digests
    (tmp_path / "x.bin").write_bytes(b"abc" * 70_000)
    found = file_digests(spark, f"{tmp_path}/*.bin", step=1000)
    assert [tuple(r) for r in found.collect()] == [("x.bin", 210_000, hashlib.sha256(b"abc" * 70_000).hexdigest())]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    assert file_digests(spark, str(tmp_path)).count() == 1


def test_components_add_up_and_counterexample(spark):
    for r in clips(spark, PATHS, 2).collect():
        assert abs(r.delay - r.err_area - r.retr_area) < 1e-12
    two = {"A_1": [0, 0, 0, 0, 0, 1, 0], "B_1": [1, 0, 0, 0, 0, 0, 1]}
    d = {r.video_id: (r.err_area, r.delay) for r in clips(spark, two).collect()}
    assert d["A_1"] == (0.5, 2.75) and d["B_1"] == (0.5, 3.0)


def test_missing_cells_are_wrong_and_kept(spark):
    paths = {"V_1": [0, 0, None, 0, 0, 0, 0], "V_2": [0] * 7}
    m = manifest_of(spark, [("V_1", 0, 1.0, 5.0), ("V_2", 0, 1.0, 5.0), ("V_3", 0, 1.0, 5.0)])
    c = {r.video_id: r for r in T.clips_at(m, answers_of(spark, paths), ["s", "silent"], [Protocol()], 0.5).filter("system_id = 's'").collect()}
    assert c["V_1"].delay == 1.25 and c["V_1"].n_missing == 1 and c["V_1"].flips == 2
    assert c["V_3"].delay == 3.0 and c["V_3"].n_missing == 7 and c["V_3"].flips == 0
    all_rows = T.clips_at(m, answers_of(spark, paths), ["s", "silent"], [Protocol()], 0.5)
    assert all_rows.filter("system_id = 'silent'").count() == 3


def test_no_answer_never_matches_a_class(spark):
    r = clips(spark, {"V_1": [-1, -1, 0, 0, 0, 0, 0]}).first()
    assert r.delay == 0.75 and r.n_missing == 0


def test_duplicate_cell_raises(spark):
    a = answers_of(spark, {"V_1": [0] * 7})
    m = manifest_of(spark, [("V_1", 0, 1.0, 5.0)])
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY|Duplicate map key"):
        T.clips_at(m, a.unionByName(a), ["s"], [Protocol()], 0.5).collect()


def test_cohort_keeps_the_slack(spark):
    df = spark.createDataFrame([(22.08 - 12.08,), (9.99,)], "l double")
    assert [r.e for r in df.select(eligible(F.col("l"), 10.0).alias("e")).collect()] == [True, False]


def test_commitment_triple(spark):
    c = clips(spark, {"V_1": [0, 0, 1, 1, 1, 1, 1], "V_2": [0] * 7}, committed={"V_1": 2})
    r = {x.video_id: (x.commit_j, x.commit_pred) for x in c.collect()}
    assert r == {"V_1": (2, 1), "V_2": (None, None)}


def test_jitter_depends_on_clip_and_seed_only(spark):
    m = manifest_of(spark, [(f"V{k}_1", 0, 5.0, 5.0) for k in range(30)])
    p = [Protocol(eps_jit_sd_s=0.5)]
    full = {r.video_id: r.jitter_s for r in with_protocols(m.repartition(7), p).collect()}
    part = {r.video_id: r.jitter_s for r in with_protocols(m.filter("video_id > 'V2'").orderBy(F.desc("video_id")), p).collect()}
    assert all(full[k] == v for k, v in part.items()) and len(set(full.values())) == 30


def test_shift_moves_a_lock_by_minus_eps_and_changes_the_cohort(spark):
    m = manifest_of(spark, [(f"V{k}_1", k % 5, 2.0, 4.0) for k in range(10)])
    k = [R.Control("lock", d0=2.0)]
    a = R.control_answers(m, k, 0.5, -4, 12)
    ps = [Protocol(eps_sys_s=e, h_s=3.0) for e in (-0.5, 0.0, 0.5, 1.0, 1.5)]
    got = {r.eps_sys_s: (r.d, r.n) for r in T.clips_at(m, a, [k[0].system_id], ps, 0.5).groupBy("eps_sys_s").agg(F.avg("delay").alias("d"), F.count("*").alias("n")).collect()}
    assert got == {-0.5: (2.25, 10), 0.0: (1.75, 10), 0.5: (1.25, 10), 1.0: (0.75, 10)}


@pytest.mark.parametrize("h,delta", [(2.0, 0.5), (3.0, 0.25), (3.0, 1.0), (4.0, 0.5)])
def test_controls_match_closed_form(spark, h, delta):
    m = manifest_of(spark, [(f"V{k}_1", k % 5, 0.5 + 0.25 * (k % 7), 4.0 + 0.25 * (k % 5)) for k in range(25)])
    det = [k for k in R.CONTROLS if k.family != "rand"]
    a = R.control_answers(m, det, 0.25, -8, 30)
    got = T.clips_at(m, a, [k.system_id for k in det], [Protocol(delta_s=delta, h_s=h)], 0.25)
    want = R.control_expectation(m.filter(F.col("post_anchor_length_s") >= h), det, h, delta)
    j = got.join(want.select("system_id", "video_id", "expected_delay", "expected_flips"), ["system_id", "video_id"])
    assert j.count() == got.count() > 0
    assert j.filter(F.abs(F.col("delay") - F.col("expected_delay")) > 1e-12).count() == 0
    assert j.filter("expected_flips IS NOT NULL AND expected_flips <> flips").count() == 0


def test_bounds_are_sharp_over_all_patterns(spark):
    rows, want = [], {}
    for n, pattern in enumerate(itertools.product([0, 1, None], repeat=4)):
        fills = itertools.product(*[[v] if v is not None else [0, 1] for v in pattern])
        delays = []
        for f in fills:
            lw = max([j for j, v in enumerate(f) if v == 0], default=-1)
            delays.append(0.0 if lw < 0 else 1.5 if lw >= 3 else (lw + 0.5) * 0.5)
        want[f"p{n}"] = (min(delays), max(delays))
        rows += [("s", f"p{n}", 0, 3, 0.5, 1, 0, j, v == 1, v is not None) for j, v in enumerate(pattern)]
    df = spark.createDataFrame(rows, "system_id string, video_id string, class_code int, steps int, delta_s double, stride int, phase int, j int, ok boolean, seen boolean")
    got = {r.video_id: (r.lower, r.upper) for r in T.delay_bounds(df, F.col("seen")).collect()}
    assert got == want


def test_irregular_weights_sum_to_the_span(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 0.5, 2.0, 2.25)], "k string, t double")
    w = [r.w for r in T.irregular_weights(df, ["k"]).orderBy("t").collect()]
    assert w == [0.25, 1.0, 0.875, 0.125] and sum(w) == 2.25


def test_grids():
    assert len(axis_scan(3.0)) == 14 and axis_scan(3.0)[0] == Protocol()
    assert len(plausible_grid()) == 54 and len({p.pi_hash for p in neighbour_grid(3.0)}) == 54
    assert all(p.in_plaus for p in plausible_grid())

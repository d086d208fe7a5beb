"""Coarse re-runs in the scan, and the axis of whole frames."""
import pytest
from pyspark.sql import functions as F

from conftest import answers_of, manifest_of
from holdfast.operators import frames as X
from holdfast.operators import reruns as C
from holdfast.operators import trajectory as T
from holdfast.operators.frames import FrameProtocol
from holdfast.operators.protocol import Protocol

COARSE, FINE = Protocol(delta_s=1.0), Protocol(delta_s=0.5)


def delays(spark, base, again, protocols=(FINE, COARSE)):
    m = manifest_of(spark, [(v, 0, 1.0, 5.0) for v in base])
    a = C.attach(T.pack(answers_of(spark, base)), T.pack(answers_of(spark, again, system="s__stride2", delta=1.0)))
    return {(r.video_id, r.delta_s): (r.delay, r.n_missing) for r in T.clips_at(m, a, ["s"], list(protocols), 0.5).collect()}


def test_coarse_step_reads_the_rerun_where_subsampling_differs(spark):
    base = {"v": [1, 0, 0, 0, 0, 0, 0]}
    assert delays(spark, base, {"v": [1, 1, 0, 0]}) == {("v", 0.5): (0.25, 0), ("v", 1.0): (1.5, 0)}
    m = manifest_of(spark, [("v", 0, 1.0, 5.0)])
    alone = T.clips_at(m, answers_of(spark, base), ["s"], [COARSE], 0.5).first()
    assert alone.delay == 0.5  # what every second fine answer would have given


def test_a_clip_outside_the_rerun_is_missing_there_and_never_falls_back(spark):
    got = delays(spark, {"v": [0] * 7, "w": [0] * 7}, {"v": [0, 0, 0, 0]})
    assert got[("w", 0.5)] == (0.0, 0) and got[("w", 1.0)] == (3.0, 4) and got[("v", 1.0)] == (0.0, 0)


def test_reruns_belong_to_their_system(spark):
    names = ["a", "a__stride2", "a__stride4", "orphan__stride2", "b__stridex"]
    a = spark.createDataFrame([(n, "v", 0, 1) for n in names], "system_id string, video_id string, j int, pred int")
    own, again = C.split_reruns(a)
    assert {r.system_id for r in own.collect()} == {"a", "orphan__stride2", "b__stridex"}
    assert {(r.system_id, r.stride) for r in again.collect()} == {("a", 2), ("a", 4)}


def test_arms_run_on_every_second_answer(spark):
    probs = [[0.9, 0.1], [0.0, 1.0], [0.2, 0.8], [1.0, 0.0], [0.3, 0.7]]
    rows = [("p", "v", j, 0.5, int(q[1] > q[0]), q, False) for j, q in enumerate(probs)]
    parents = spark.createDataFrame(rows, "system_id string, video_id string, j int, delta_s double, pred int, probs array<double>, committed boolean")
    made = C.rerun(parents, [("x", "p", "ema", 0.5), ("y", "p", "msp", 0.8)], 2, -1, 4)
    got = {r.system_id: [] for r in made.collect()}
    for r in made.orderBy("j").collect():
        got[r.system_id].append((r.j, r.pred, r.committed))
    # Coarse steps 0, 1, 2 see answers 0, 2, 4: smoothed to .9, .55 and .425 for class 0; the first one commits.
    assert got["x__stride2"] == [(0, 0, False), (1, 0, False), (2, 1, False)]
    assert got["y__stride2"] == [(0, 0, True), (1, 0, True), (2, 0, True)]


# --- frames --------------------------------------------------------------------------------------------------------

def frames_of(spark, clips):
    """clips: (video_id, first, anchor, last, class)"""
    rows = [(v, v, f, a, e, e - a, y) for v, f, a, e, y in clips]
    return spark.createDataFrame(rows, "video_id string, source_cluster_id string, first_frame long, anchor_frame long, last_frame long, post_anchor_frames long, class_code int")


def frame_clips(spark, paths, protocol, clips=None, delta=4, **kw):
    m = frames_of(spark, clips or [(v, 0, 20, 60, 0) for v in paths])
    cells = X.read_frames(m, answers_of(spark, paths, **kw), ["s"], [protocol], delta)
    return cells, {r.video_id: r for r in X.frame_clips(cells).collect()}


@pytest.mark.parametrize("bad", [{"delta_f": 0}, {"delta_f": 1.5}, {"h_f": 10, "delta_f": 4}, {"eps_sys_f": 0.5}, {"eps_jit_sd_f": -1.0}, {"h_f": True}])
def test_protocols_that_frames_cannot_hold_are_refused(bad):
    with pytest.raises(ValueError):
        FrameProtocol(**{"delta_f": 4, "h_f": 8, **bad})


def test_identity_tells_axes_apart():
    a = FrameProtocol(0, 0.0, 4, 8)
    assert a.pi_hash == FrameProtocol(0, 0.0, 4, 8).pi_hash
    assert len({a.pi_hash, FrameProtocol(4, 0.0, 4, 8).pi_hash, FrameProtocol(0, 0.0, 2, 8).pi_hash, FrameProtocol(0, 0.0, 4, 8, vocabulary="v").pi_hash, Protocol(0, 0, 4, 8).pi_hash}) == 5


def test_areas_are_in_frames(spark):
    _, c = frame_clips(spark, {"a": [1, 1, 0, 0, 0, 0], "b": [1] * 6}, FrameProtocol(0, 0.0, 4, 20))
    assert (c["a"].delay, c["a"].onset_j, c["b"].delay, c["b"].end_ok) == (6.0, 2, 20.0, 0)


def test_a_request_between_stored_steps_has_no_answer(spark):
    cells, c = frame_clips(spark, {"a": [0] * 12}, FrameProtocol(2, 0.0, 4, 20))
    assert (c["a"].n_off_grid, c["a"].n_missing, c["a"].delay) == (6, 6, 20.0)
    assert all(r.pred == -1 and not r.present and r.off_grid for r in cells.collect())
    _, c = frame_clips(spark, {"a": [1, 0, 0, 0, 0, 0, 0]}, FrameProtocol(4, 0.0, 4, 20))  # a shift by a whole step is answered
    assert (c["a"].n_off_grid, c["a"].delay) == (0, 0.0)
    _, c = frame_clips(spark, {"a": [0] * 12}, FrameProtocol(0, 0.0, 2, 8))  # a finer step meets every second one
    assert (c["a"].n_off_grid, c["a"].n_missing) == (2, 2)


def test_cohort_compares_whole_frames_without_slack(spark):
    clips = [("just", 0, 20, 40, 0), ("short", 0, 20, 39, 0)]
    _, c = frame_clips(spark, {"just": [0] * 6, "short": [0] * 6}, FrameProtocol(0, 0.0, 4, 20), clips)
    assert set(c) == {"just"}


def test_shift_moves_cohort_and_is_clipped(spark):
    m = frames_of(spark, [("a", 10, 12, 40, 0), ("b", 0, 20, 60, 0)])
    p = {r.video_id: r for r in X.perturb_frames(m, [FrameProtocol(-4, 0.0, 4, 8)]).collect()}
    assert (p["a"].anchor_frame_eff, p["a"].anchor_clipped, p["a"].post_anchor_frames_eff) == (10, True, 30)
    assert (p["b"].anchor_frame_eff, p["b"].anchor_clipped, p["b"].post_anchor_frames_eff) == (16, False, 44)


def test_jitter_is_whole_and_does_not_depend_on_the_cohort(spark):
    m = frames_of(spark, [(f"v{k}", 0, 50, 100, 0) for k in range(60)])
    pv = FrameProtocol(0, 3.0, 4, 8)
    every = {r.video_id: (r.jitter_raw_f, r.jitter_f) for r in X.perturb_frames(m, [pv]).collect()}
    part = {r.video_id: (r.jitter_raw_f, r.jitter_f) for r in X.perturb_frames(m.filter("video_id < 'v3'").repartition(5), [pv]).collect()}
    assert all(every[v] == x for v, x in part.items()) and all(abs(raw - k) <= 0.5 for raw, k in every.values())
    assert len({k for _, k in every.values()}) > 3


def test_seconds_and_undivided_steps_are_refused(spark):
    with pytest.raises(ValueError):
        X.perturb_frames(frames_of(spark, [("a", 0, 1, 2, 0)]).withColumn("anchor_s", F.lit(1.0)), [FrameProtocol(0, 0.0, 1, 1)])
    a = answers_of(spark, {"a": [0, 1, 2, 3]})
    assert [(r.j, r.pred) for r in X.coarsen(a, 4, 8).orderBy("j").collect()] == [(0, 0), (1, 2)]
    with pytest.raises(ValueError):
        X.coarsen(a, 4, 6)


def test_record_in_frames(spark):
    paths = {"a": [1, 0, 0, 0, 0, 0], "b": [0] * 6, "c": [1] * 6, "d": [0, 1, 0, 0, 0, 0]}
    m = [("a", 0, 20, 60, 0), ("b", 0, 20, 60, 0), ("c", 0, 20, 60, 0), ("d", 0, 20, 60, 1)]
    cells, _ = frame_clips(spark, paths, FrameProtocol(0, 0.0, 4, 20), m, committed={"a": 2, "b": 1})
    c = X.frame_clips(cells)
    r = X.frame_record(c, ["system_id"], [4, 6, 24]).first()
    # Delays 2, 0, 20 for class 0 and 20 for class 1.
    assert (r.rmscd_frames, r.rmscd_norm) == (10.5, 0.525) and abs(r.rmscd_frames_macro - (22 / 3 + 20) / 2) < 1e-12
    assert r.rmscd_norm_macro == r.rmscd_frames_macro / 20
    assert (r.s_at_4f, r.s_at_6f, r.s_at_24f) == (0.5, None, None)
    assert (r.commit_rate, r.tau_c_mean_frames, r.tau_c_median_frames, r.commit_error) == (0.5, 13.0, 14.0, 0.0)
    assert (r.flip_rate, r.mean_flips, r.median_flips) == (0.5, 0.75, 0.5)
    with pytest.raises(ValueError):
        X.frame_record(c, ["system_id"], [])


def test_no_eligible_prefix_reads_past_the_last_frame(spark):
    m = frames_of(spark, [("a", 0, 20, 45, 0), ("b", 0, 20, 60, 0)])
    p = X.frame_prefixes(X.perturb_frames(m, [FrameProtocol(-3, 0.0, 4, 20)]), 40, [20, 40], 4)
    assert p.filter("eligible_h20 AND offset_f <= 20 AND past_end").isEmpty()
    assert p.filter("past_end").count() == 3 and p.filter("base_j IS NULL").count() == p.count()

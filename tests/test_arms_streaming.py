"""Arms against a plain loop, and the streaming forms against the batch forms."""
import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import arms as R
from holdfast.session import fresh_path
from holdfast.streaming import live as L

J = list(range(-2, 9))


def random_answers(spark, n=40, seed=3):
    rng = random.Random(seed)
    rows, truth = [], {}
    for v in range(n):
        seq = []
        for j in J:
            p = None
            if rng.random() > 0.15:
                w = [rng.choice([1, 1, 2, 5]) for _ in range(5)]
                p = [x / sum(w) for x in w]
                rows.append(("s", f"v{v}", j, R_top(p), p, False))
            elif rng.random() > 0.5:
                rows.append(("s", f"v{v}", j, -1, None, False))
            seq.append(p)
        if any(p is not None for p in seq):
            truth[f"v{v}"] = seq
    return spark.createDataFrame(rows, "system_id string, video_id string, j int, pred int, probs array<double>, committed boolean"), truth


def R_top(p):
    return -1 if p is None else p.index(max(p))


def loops(seq):
    base = [R_top(p) for p in seq]
    q, e = None, []
    for p in seq:
        q = q if p is None else p if q is None else [0.35 * x + 0.65 * y for x, y in zip(p, q)]
        e.append(R_top(q))
    cur, h = base[0], [base[0]]
    for t in range(1, len(seq)):
        k, p = base[t], seq[t] or [0.0] * 5
        if k != -1 and (cur == -1 or (k != cur and p[max(k, 0)] - p[max(cur, 0)] > 0.1)):
            cur = k
        h.append(cur)
    cur, cand, run, pa = base[0], -1, 0, [base[0]]
    for k in base[1:]:
        run = run + 1 if k == cand else 1
        cand = k
        if k != -1 and (cur == -1 or (k != cur and run >= 3)):
            cur = k
        pa.append(cur)
    m = []
    for t, k in enumerate(base):
        win = [x for x in base[max(0, t - 2): t + 1]]
        counts = [win.count(c) for c in range(5)]
        m.append(-1 if k == -1 else k if counts[k] == max(counts) else counts.index(max(counts)))
    return {"ema": e, "hysteresis": h, "patience": pa, "majority": m}


def test_arms_equal_their_loops(spark):
    a, truth = random_answers(spark)
    dense = R.dense_steps(a, J[0], J[-1])
    steps = R.long_steps(dense)
    out = {"ema": R.ema(dense, 0.35), "hysteresis": R.hysteresis(dense, 0.1), "patience": R.patience(steps, 3), "majority": R.majority(steps, 3)}
    want = {v: loops(s) for v, s in truth.items()}
    for name, df in out.items():
        got = {}
        for r in df.select("video_id", "j", "pred").collect():
            got.setdefault(r.video_id, {})[r.j] = r.pred
        assert {v: [g[j] for j in J] for v, g in got.items()} == {v: w[name] for v, w in want.items()}, name


def test_consecutive_accept_and_scheduled_stop(spark):
    p = lambda c, x: [x if k == c else (1 - x) / 4 for k in range(5)]
    seq = [p(1, .9), p(0, .9), p(0, .4), p(0, .9), p(0, .9), p(2, .9)]
    a = spark.createDataFrame([("s", "v", j, R_top(x), x, False) for j, x in enumerate(seq)], "system_id string, video_id string, j int, pred int, probs array<double>, committed boolean")
    steps = R.long_steps(R.dense_steps(a, -1, 5))
    got = R.consecutive_accept(steps, R.commitment_score(F.col("probs"), "msp") >= 0.5, 2).orderBy("j").collect()
    assert [r.pred for r in got] == [-1, -1, -1, -1, -1, 0, 0] and got[0].first_j == 4
    got = R.scheduled_stop(steps, [None, None, 0.95, 0.95, 0.95, 0.95], 3).orderBy("j").collect()
    assert got[0].first_j == 3 and [r.committed for r in got] == [False] * 4 + [True] * 3


def feed_files(spark, rows, per_file):
    """One file per group of rows, named in order, so that each becomes its own micro-batch."""
    path = fresh_path(spark, "feed-test")
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k:k + per_file], L.FEED).coalesce(1).write.mode("append").parquet(path)
    return path


def test_live_smoothing_over_many_batches_equals_batch(spark):
    from datetime import datetime, timedelta
    a, truth = random_answers(spark, 6, 9)
    t0 = datetime(2024, 1, 1)
    rows = sorted((r.j, r.video_id, r.pred, r.probs) for r in a.collect())
    feed = [("s", v, 0, j, p, pr, t0 + timedelta(seconds=j), t0 + timedelta(seconds=30)) for j, v, p, pr in rows]
    far = [("", "", 0, k, 0, None, t0 + timedelta(days=k + 1), t0 + timedelta(days=k + 1)) for k in (0, 1)]
    shuffled = list(feed)
    random.Random(5).shuffle(shuffled)  # within the allowed delay the order of arrival must not matter
    want, seen = {v: loops(s) for v, s in truth.items()}, []
    for order, per_file in ((feed, 12), (shuffled, 7)):
        f = L.read_feed(spark, feed_files(spark, order + far, per_file), 1)
        out = [r for r in L.run_available(L.live_smoothing(f, J[0], 0.35, 0.1, 3), "t").collect() if r.system_id]
        got = {(r.video_id, r.j): (r.ema_pred, r.hysteresis_pred, r.patience_pred) for r in out}
        assert len(got) == len(out) == len(feed)
        for (v, j), x in got.items():
            assert x == tuple(want[v][k][j - J[0]] for k in ("ema", "hysteresis", "patience"))
        seen.append(sorted((r.video_id, r.j, r.pred, r.changed, r.n_missing) for r in out))
    assert seen[0] == seen[1]
    for v in truth:
        mine, said, last = [x for x in seen[0] if x[0] == v], None, J[0] - 1
        for _, j, pred, changed, missing in mine:
            assert changed == (said is not None and said != pred) and missing == j - last - 1
            said, last = pred, j


def test_late_answers_cannot_change_a_closed_clip(spark):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    close = t0 + timedelta(seconds=3)
    p = [0.9, 0.025, 0.025, 0.025, 0.025]
    row = lambda j, pred, pr, at: ("s", "v", 0, j, pred, pr, at, close)
    on_time = [row(j, 0 if j > 1 else 1, p if j == 3 else [0.2] * 5, t0 + timedelta(seconds=j / 2)) for j in range(7) if j != 4]
    later = [("s", "w", 0, 0, 0, p, t0 + timedelta(hours=h), t0 + timedelta(hours=h, seconds=3)) for h in (1, 2, 3)]
    late = [row(4, 0, p, t0 + timedelta(seconds=2)), row(1, 0, p, t0)]
    feed = on_time + later[:1] + later[1:2] + late + later[2:]
    path = fresh_path(spark, "feed-late")
    for part in (on_time, later[:1], later[1:2], late, later[2:]):
        spark.createDataFrame(part, L.FEED).coalesce(1).write.mode("append").parquet(path)
    assert len(feed) == 11
    c = [r for r in L.run_available(L.live_closure(L.read_feed(spark, path, 1), 6, 0.5), "c").collect() if r.video_id == "v"]
    assert [(r.delay, r.flips, r.n_missing, r.end_ok) for r in c] == [(2.25, 3, 1, True)]
    k = [r for r in L.run_available(L.live_commitment(L.read_feed(spark, path, 1), 0.8, 6, 0.5), "k").collect() if r.video_id == "v"]
    assert [(r.committed, r.label, r.tau_s) for r in k] == [(True, 0, 1.5)]


@pytest.mark.parametrize("spec,name", [(R.Control("lock", d0=2.5, commit_after=2.5), "block__lock__commit-2.5_d0-2.5"), (R.Control("oracle"), "block__oracle__default")])
def test_control_names(spec, name):
    assert spec.system_id == name

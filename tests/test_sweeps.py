"""Swept arms as arrays against their forms by rows, and their tallies."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from holdfast.operators import arms as R
from holdfast.operators import sweeps as S


def trajectories(n=40, seed=4):
    rng = random.Random(seed)
    probs, has = np.zeros((n, 12, 5)), np.zeros((n, 12), bool)
    for i in range(n):
        for t in range(12):
            if rng.random() < 0.75:
                has[i, t], c, rest = True, rng.randrange(3 if i % 2 else 5), rng.choice([0.1, 0.15, 0.19, 0.2])
                probs[i, t] = rest
                probs[i, t, c] = 1 - 4 * rest
    has[0] = False
    probs[0] = 0
    return probs, has


@pytest.mark.parametrize("arm", sorted(R.SWEEPS))
def test_arrays_are_the_arms(spark, arm):
    probs, has = trajectories()
    cells = [("s", f"{i:03d}", [(t - 3, [float(x) for x in probs[i, t]] if has[i, t] else None) for t in range(12)]) for i in range(len(has))]
    dense = spark.createDataFrame(cells, "system_id string, video_id string, steps array<struct<j int, probs array<double>>>").cache()
    rows = {"ema": lambda v: R.ema(dense, v), "hysteresis": lambda v: R.hysteresis(dense, v), "majority": lambda v: R.majority(R.long_steps(dense), v), "patience": lambda v: R.patience(R.long_steps(dense), v)}
    for v in R.SWEEPS[arm]:
        got = S.ARMS[arm](probs, has, v)
        want = {(int(r.video_id), r.j): r.pred for r in rows[arm](v).select("video_id", "j", "pred").collect()}
        assert {(i, t - 3): int(got[i, t]) for i in range(len(has)) for t in range(12)} == want


def test_tallies_of_delay_and_end():
    probs, has = np.zeros((3, 12, 5)), np.ones((3, 12), bool)
    probs[:, :, 1] = 1.0
    probs[1, 5, 1], probs[1, 5, 0] = 0.0, 1.0  # wrong at step 2 only
    probs[2, 9, 1], probs[2, 9, 0] = 0.0, 1.0  # wrong at the end
    out = [b for b in S.tally(lambda b: iter([("s", np.array([1, 1, 1]), probs, has), ("none", np.zeros(0, int), probs[:0], has[:0])]), 3, 6, 0.5)(iter([pa.record_batch({"x": [1]})]))]
    base = [r for b in out for r in b.to_pylist() if r["arm"] == "base"]
    assert base == [{"system_id": "s", "arm": "base", "value": 0.0, "class_code": 1, "d": 0.0 + 1.25 + 3.0, "a": 2, "n": 3}]


def test_the_sweep_is_one_pass_over_development_clips(spark):
    from holdfast.plans import catalog
    plan = catalog.QUERIES["f06_parameter_sweep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Generate" not in plan  # the draws are tallied and stored before the choice

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from holdfast.session import local_session
    s = local_session(4, "holdfast-tests")
    yield s
    s.stop()


def manifest_of(spark, clips):
    """clips: (video_id, class_code, anchor_s, length_s)"""
    rows = [(v, v.rsplit("_", 1)[0], a, 20.0, a + n, n, y) for v, y, a, n in clips]
    return spark.createDataFrame(rows, "video_id string, source_cluster_id string, anchor_s double, fps double, duration_s double, post_anchor_length_s double, class_code int")


def answers_of(spark, paths, system="s", j0=0, delta=0.5, committed=None):
    rows = []
    for video, preds in paths.items():
        for k, p in enumerate(preds):
            if p is not None:
                rows.append((system, video, j0 + k, delta, p, bool(committed and committed.get(video, 99) <= j0 + k)))
    return spark.createDataFrame(rows, "system_id string, video_id string, j int, delta_s double, pred int, committed boolean")

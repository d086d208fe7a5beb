"""What a query reads twice is made once; answers before the anchor are read without the long table."""
import datetime as dt

from holdfast.plans import common, queries_e, queries_h, queries_j, stages
from holdfast.sources import derive as D

SF = "/root/testdata/sf0.001/."  # a spelling of its own, so that no other test has stored its stages


def stored(spark):
    return {k[2] for k in stages._PATHS if k[:2] == (spark.sparkContext.applicationId, SF)}


def test_pre_anchor_answers_are_read_in_place(spark):
    got = queries_e.pre_anchor(spark, SF).count()
    assert got == common.clips(spark, SF).count() > 0 and "answers" not in stored(spark)
    c = common.event_clips(spark, SF)
    a, b = D.answers(D.before_anchor(c)), D.answers(c).filter("j < 0")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_track_readings_are_drawn_once_per_track(spark, monkeypatch):
    drawn, draw = [], queries_j.G.packed_draws
    monkeypatch.setattr(queries_j.G, "packed_draws", lambda c, n, seed: drawn.append(seed) or draw(c, n, seed))
    queries_j.j04r(spark, SF).collect()
    queries_j.j06(spark, SF).collect()
    assert len(drawn) == 2 and len(set(drawn)) == 2


def test_calibration_is_stored(spark):
    cal = {r.metric: r for r in queries_h.calibrated(spark, SF).collect()}
    assert "calibration" in stored(spark) and {r.metric for r in queries_h.h16(spark, SF).collect()} == set(cal)


def test_seed_replication_reads_its_few_pairs(spark):
    df = queries_h.h18(spark, SF)
    df.collect()
    assert {"system_ids", "pair_tests", "tied", "heterogeneous"} <= stored(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "heterogeneous" in plan and "Join" not in plan.split("Initial Plan")[0]


def test_clip_table_is_read_without_a_join(spark):
    from holdfast.operators import trajectory as T
    from holdfast.operators.protocol import reference
    made = common._all_clips(spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    m, refs = common.manifest(spark, SF), [reference(h) for h in D.HORIZONS]
    joined = T.clip_table(T.read_grid(m, common.packed(spark, SF), D.SYSTEM_IDS, refs, D.DELTA, keep=["split"]), keep=["split"])
    assert made.count() > 100 and made.exceptAll(joined.select(made.columns)).count() == joined.select(made.columns).exceptAll(made).count() == 0


def test_answers_are_drawn_in_batches_from_dealt_clips(spark):
    c = D.event_clips(D.table(spark, SF, "events"))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert f", {n}), REPARTITION_BY_NUM" in c._jdf.queryExecution().executedPlan().toString()
    plan = D.packed_answers(common.event_clips(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "md5(" not in plan


def test_clip_table_makes_no_reruns(spark):
    sf = SF + "/."
    common.clips(spark, sf).count()
    made = {k[2] for k in stages._PATHS if k[:2] == (spark.sparkContext.applicationId, sf)}
    assert "clips" in made and "packed" not in made


def test_only_hot_users_are_cut_into_buckets(spark):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=50 * k), None if k == 7 else 1 if k % 3 else k, "view") for k in range(300)] + [(999, None, 1, "view")]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    one, few, every = (sorted(map(str, D.event_clips(e, hot=n).collect())) for n in (10 ** 6, 150, 0))
    assert one == few == every and len(one) > 100
    assert "_hot" in D.event_clips(e)._jdf.queryExecution().optimizedPlan().toString()


def test_arms_need_no_clip_table(spark):
    from holdfast.plans import queries_i
    sf = SF + "/./."
    got = {r.system_id: (r.e, r.d) for r in queries_i.arms(spark, sf).collect()}
    made = {k[2] for k in stages._PATHS if k[:2] == (spark.sparkContext.applicationId, sf)}
    assert "arms" in made and "clips" not in made
    assert got == {r.system_id: (r[1], r[2]) for r in common.clips(spark, SF).groupBy("system_id").avg("end_ok", "delay").collect()} and len(got) == 12

"""Packed answers and the protocol scan are made in place: same rows as the long way, without its shuffles."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from holdfast.operators import reruns as C
from holdfast.operators import trajectory as T
from holdfast.operators.protocol import axis_scan, neighbour_grid
from holdfast.sources import derive as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def clips(spark, tmp_path_factory):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=40 * k + k % 7), k * k % 23, D.EVENT_CLASSES[k * 7 % 5]) for k in range(1500)]
    path = str(tmp_path_factory.mktemp("clips") / "c")
    D.event_clips(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")).write.parquet(path)
    return spark.read.parquet(path)


def as_rows(df):
    flat = df.filter(F.col("cells").isNotNull()).select("system_id", "video_id", "j0", F.to_json("cells"), F.to_json("reruns"))
    return sorted(map(tuple, flat.collect()), key=str)


def test_packed_in_place_equals_packing_the_long_answers(spark, clips):
    long = D.answers(clips)
    again = C.rerun(long, D.RERUNS, D.RERUN_STRIDE, D.J_MIN, D.J_MAX)
    packed = D.packed_answers(clips)
    assert as_rows(packed) == as_rows(C.attach(T.pack(long), T.pack(again)))
    assert "Exchange" not in plan(packed)


@pytest.mark.parametrize("rule,value", [("msp", 0.6), ("margin", 0.3), ("ema", 0.5), ("hysteresis", 0.1), ("patience", 2.0)])
def test_rerun_cells_equal_the_long_rule(spark, clips, rule, value):
    parents = D.answers(clips).filter("system_id = 'prefix__gru64__seed11'")
    made = T.pack(C.rerun(parents, [("x", "prefix__gru64__seed11", rule, value)], 2, D.J_MIN, D.J_MAX))
    coarse = parents.filter("pmod(j, 2) = 0").withColumn("j", (F.col("j") / 2).cast("int"))
    from holdfast.operators.arms import dense_steps
    here = dense_steps(coarse, -1, 4).select("video_id", C.rerun_cells(F.col("steps"), rule, value).alias("cells"))
    def rows(df):
        return sorted(map(tuple, df.select("video_id", F.to_json("cells")).collect()))
    assert rows(here) == rows(made)


def test_scan_tally_equals_the_clip_table(spark, clips):
    from holdfast.operators.scan import scan_tally
    protocols = list({p.pi_hash: p for p in axis_scan(3.0) + neighbour_grid(2.0)}.values())
    m, packed = D.clean(D.raw_manifest(clips), "test"), D.packed_answers(clips).filter("system_id <> 'clip__mean__seed13' OR video_id < 'u2'")
    by = ["system_id", *T.PI]
    tally = scan_tally(m, packed, D.SYSTEM_IDS, protocols, D.DELTA)
    new = T.family_of_tally(T.merged(tally, by), by)
    old = T.frozen_family(T.clips_at(m, packed, D.SYSTEM_IDS, protocols, D.DELTA), by)
    def rows(df):
        return {tuple(r[:7]): [x if x is None else round(x, 12) for x in r[7:]] for r in df.select(*by, *[c for c in old.columns if c not in by]).collect()}
    assert rows(new) == rows(old) and len(rows(new)) > 100
    # the rows that the protocols multiply are never laid out, and what made the tally is read once
    assert plan(new).count("MapInArrow") == 1 and plan(new).count("Generate explode") == plan(m.withColumn("s", F.explode(F.array(F.lit(1))))).count("Generate explode") + plan(packed).count("Generate explode")


def test_family_reads_its_clips_once(spark, clips):
    c = T.clips_at(D.clean(D.raw_manifest(clips), "test"), D.packed_answers(clips), D.SYSTEM_IDS, axis_scan(3.0)[:1], D.DELTA)
    assert plan(T.frozen_family(c, ["system_id", "h_s"])).count("Scan parquet") == plan(c).count("Scan parquet")


def test_next_observed_point_needs_no_list(spark, tmp_path):
    from holdfast.plans.catalog import QUERIES
    assert "collect_list" not in plan(QUERIES["d18_coarse_vs_fine"](spark, "/root/testdata/sf0.001"))

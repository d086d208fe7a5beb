"""The registered queries against their SQL on the smallest tables."""
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SMALL = ["flagship_stable_curve_rmscd", "d14_evaluation_record", "f14_control_closed_form", "g06_paired_percentile_p", "h04_rank_preservation", "i02_selection_regret", "j09_near_fingerprints", "j12_longest_equal_run", "c16_asof_hold"]


def test_names_and_oracles():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200
    for letter, n in {"a": 21, "b": 18, "c": 22, "d": 39, "e": 10, "f": 14, "g": 22, "h": 21, "i": 14, "j": 19, "k": 4}.items():
        have = {k.split("_")[0] for k in q}
        assert not {f"{letter}{i:02d}" for i in range(1, n + 1)} - have


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")
@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, name):
    from tools.check import TABLES, rows
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, got) == rows(cols, res.fetchall())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rmscd" in df.columns

"""The skew-safe helpers give what the plain window or join gives."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast.operators.asof import asof_hold
from holdfast.operators.ranking import bucketed_running, hash_rank, hot_join


def test_bucketed_rank_equals_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.randrange(1000), k, rng.randrange(5)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, t int, id int, v int")
    got = bucketed_running(df, ["g"], F.floor(F.col("t") / 50), [F.col("t"), F.col("id")], "r")
    w = Window.partitionBy("g").orderBy("t", "id")
    assert got.join(df.withColumn("e", F.row_number().over(w)), ["g", "t", "id", "v"]).filter("r <> e").count() == 0
    got = bucketed_running(df, ["g"], F.floor(F.col("t") / 50), [F.col("t"), F.col("id")], "s", F.col("v"))
    want = df.withColumn("e", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert got.join(want, ["g", "t", "id", "v"]).filter("s <> e").count() == 0 and got.count() == 500


def test_hash_rank_is_a_permutation_whatever_the_partitioning(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    a = hash_rank(df.repartition(3), ["g"], F.concat(F.lit("k|"), "id"), [F.col("id")], "r")
    b = hash_rank(df.repartition(11), ["g"], F.concat(F.lit("k|"), "id"), [F.col("id")], "r")
    assert a.exceptAll(b).count() == 0
    assert a.groupBy("g").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count_distinct("r").alias("n"), F.count("*").alias("c")).filter("lo <> 1 OR hi <> c OR n <> c").count() == 0


def test_hot_join_equals_join(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    look = spark.range(0, 300, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    for how in ("inner", "left"):
        got = hot_join(rows, look, ["k"], how)
        want = rows.join(look, ["k"], how)
        assert got.count() == want.count() and got.select("k", "v", "x").exceptAll(want.select("k", "v", "x")).count() == 0


def test_asof_hold_against_brute_force(spark):
    rng = random.Random(2)
    vals = sorted({(rng.choice("hhhc"), rng.randrange(10000)) for _ in range(200)})
    targ = sorted({(rng.choice("hcx"), rng.randrange(10000)) for _ in range(80)})
    v = spark.createDataFrame([(k, t, t * 2.0) for k, t in vals], "key string, t int, value double")
    q = spark.createDataFrame(targ, "key string, t int")
    got = {(r.key, r.t): (r.held_at, r.value) for r in asof_hold(q, v, "key", "t", F.floor(F.col("t") / 500), ["value"]).collect()}
    assert len(got) == len(targ)
    for k, t in targ:
        earlier = [x for kk, x in vals if kk == k and x <= t]
        assert got[(k, t)] == ((max(earlier), max(earlier) * 2.0) if earlier else (None, None))

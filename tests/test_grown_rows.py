"""Rows that Spark underestimates are neither broadcast through the driver nor multiplied in one task."""
from pyspark.sql import functions as F

from holdfast.operators import duplicates as U
from holdfast.operators import identity as I
from holdfast.operators import inference as G
from holdfast.operators.ranking import hash_rank
from holdfast.plans.stages import stage


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def clusters(spark):
    return spark.range(40).select(F.concat(F.lit("c"), "id").alias("source_cluster_id"), F.pmod("id", F.lit(3)).cast("int").alias("class_code"))


def test_draws_and_their_joins_are_not_broadcast(spark):
    c = clusters(spark)
    w = G.cluster_draws(c, 30, 1)
    assert "BroadcastHashJoin" not in plan(w)
    sums = c.withColumns({"system_id": F.lit("s"), "n": F.lit(1), "v": F.lit(0.5)})
    assert "BroadcastHashJoin" not in plan(G.replicate_means(sums, w, ["system_id"], ["v"]))
    per = w.groupBy("b").agg(F.sum("w").alias("n")).collect()
    assert len(per) == 30 and {r.n for r in per} == {40}


def test_stored_tables_are_not_broadcast(spark):
    kept = stage(spark, "test-grown", "kept", lambda: clusters(spark))
    assert "BroadcastHashJoin" not in plan(clusters(spark).join(kept, "source_cluster_id"))


def test_ranked_rows_and_near_keys_are_not_broadcast(spark):
    c = clusters(spark)
    assert "BroadcastHashJoin" not in plan(hash_rank(c, ["class_code"], F.col("source_cluster_id"), [F.col("source_cluster_id")], "r"))
    prints = spark.range(64).select(F.lit(0).cast("bigint").alias("fp_hi"), F.col("id").alias("fp_lo"))
    near = U.near_fingerprints(prints, 1)
    assert "BroadcastHashJoin" not in plan(near)
    assert near.count() == 64 * 6 // 2


def test_clusters_are_spread_before_they_are_multiplied(spark):
    n = spark.conf.get("spark.sql.shuffle.partitions")
    few = clusters(spark).coalesce(1)
    for df in (G.cluster_draws(few, 3, 1), I.stratified_halves(few, 3, 1)):
        assert f", {n}), REPARTITION_BY_NUM" in plan(df)

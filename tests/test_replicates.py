"""Weighted sums by matrix products equal those over joined rows of draws."""
import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import inference as G


def rows_of(spark, n_clusters=1300):
    rng = random.Random(3)
    rows = [(f"c{k}", s, rng.choice([0, 1, None]), rng.randrange(1, 4), None if s == "t" or rng.random() < 0.3 else rng.randrange(8) / 4)
            for k in range(n_clusters) for s in ("s", "t", "u") if s != "u" or k == 7]
    return spark.createDataFrame(rows, "source_cluster_id string, system_id string, class_code int, n int, v double")


def collected(df):
    return {(r.system_id, r.class_code, r.b): (r.n, r.v) for r in df.collect()}


def test_products_equal_joined_rows(spark):
    rows = rows_of(spark)
    packed = G.packed_draws(rows, 25, 4).localCheckpoint()
    keys = ["system_id", "class_code"]
    got = collected(G.replicate_sums(rows, packed, keys, ["n", "v"]))
    assert got == collected(G.replicate_sums(rows, G.draw_rows(packed), keys, ["n", "v"]))
    assert 0 < sum(k[0] == "u" for k in got) < 25  # a key of one cluster is missing where that isn't drawn
    assert all(v is None for (s, _, _), (_, v) in got.items() if s == "t")


def test_replicate_means_and_medians_of_packed_draws(spark):
    rows = rows_of(spark, 60).withColumn("v", F.coalesce("v", F.lit(0.0))).withColumn("class_code", F.coalesce("class_code", F.lit(2))).withColumn("flips", F.col("n"))
    packed = G.packed_draws(rows, 12, 4)
    by = ["system_id", "b"]
    def both(f):
        return [{tuple(r[c] for c in by): tuple(r[c] for c in r.asDict() if c not in by) for r in f(d).collect()} for d in (packed, G.draw_rows(packed))]
    a, b = both(lambda d: G.replicate_means(rows, d, ["system_id"], ["v"]))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    a, b = both(lambda d: G.replicate_median(rows, d, ["system_id"], "flips", "m"))
    assert a == b


def test_clusters_and_replicates_are_not_joined_as_rows(spark):
    rows = rows_of(spark, 40)
    df = G.replicate_sums(rows, G.packed_draws(rows, 6, 4), ["system_id"], ["v"])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastHashJoin" not in plan


def test_supported_draws_keep_the_weights_of_their_replicates(spark):
    cc = spark.createDataFrame([(f"c{k}", 0 if k < 7 else 1) for k in range(8)], "source_cluster_id string, class_code int")
    w, rejected = G.packed_supported(cc.select("source_cluster_id"), cc, 10, 3)
    chosen = [r.b for r in G.draw_supported(cc.select("source_cluster_id"), cc, 10, 3).orderBy("rep").collect()]
    every = {r.source_cluster_id: r.weights for r in G.packed_draws(cc, max(chosen) + 1, 3).collect()}
    assert rejected.first()[0] > 0
    assert {r.source_cluster_id: r.weights for r in w.collect()} == {c: [x[b] for b in chosen] for c, x in every.items()}

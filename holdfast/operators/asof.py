"""As-of hold: the last value at or before each target time, for keys of any size.

A plain window over the union of both sides puts each key into one task. Here time is divided into
buckets: the hold inside a bucket is a window over (key, bucket), and the value carried in from
earlier buckets comes from a table with one row per (key, bucket).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_hold(targets: DataFrame, values: DataFrame, key: str, time: str, bucket: Column, payload: list[str]) -> DataFrame:
    """``targets`` with ``payload`` and ``held_at`` of the last row of ``values`` not after them."""
    extra = [c for c in targets.columns if c not in (key, time)]
    v = values.select(key, time, *[F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in extra],
                      F.struct(F.col(time).alias("held_at"), *payload).alias("_v"), F.lit(0).alias("_side"))
    t = targets.select(key, time, *extra, F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    both = v.unionByName(t).withColumn("_b", bucket)
    here = Window.partitionBy(key, "_b").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_held", F.last("_v", ignorenulls=True).over(here)).filter("_side = 1")
    per_bucket = both.groupBy(key, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(time))).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(key, "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    out = inside.join(carry, [key, "_b"]).withColumn("_held", F.coalesce("_held", "_carry"))
    return out.select(key, time, *extra, "_held.held_at", *[F.col(f"_held.{p}").alias(p) for p in payload])

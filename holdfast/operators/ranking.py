"""Ranks and running sums inside groups of any size.

A plain window puts each group into one task. Here the group is first divided into buckets that
follow the wanted order; rows are numbered inside their bucket, bucket totals (a small table) are
summed up once, and the two are joined. One group holding a third of all rows is thereby spread
over as many tasks as it has buckets, and the result is the same as the plain window's.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grown(rows: DataFrame) -> DataFrame:
    """Mark rows whose size Spark underestimates: made by an explode or a window, or read from a file that compresses well.

    Spark broadcasts what it believes to be small, through the driver; the hint has the next join shuffle both of its sides instead.
    """
    return rows.hint("merge")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` over the session's number of partitions before something multiplies them.

    By their bytes alone adaptive execution would read them in a few tasks; a number that is asked for stays.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bucketed_running(
    df: DataFrame,
    group: list[str],
    bucket: Column,
    order: list[Column],
    out: str,
    value: Column | None = None,
) -> DataFrame:
    """Add ``out``: the running sum of ``value`` (default 1, i.e. the 1-based rank), ends included.

    ``bucket`` must not decrease along ``order`` inside a group.
    """
    keys = group + ["_bucket"]
    rows = df.withColumn("_bucket", bucket).withColumn("_v", F.lit(1).cast("bigint") if value is None else value)
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("_v").over(within))
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        df.withColumn("_bucket", bucket)
        .withColumn("_v", F.lit(1).cast("bigint") if value is None else value)
        .groupBy(*keys).agg(F.sum("_v").alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .select(*keys, "_base")
    )
    return (
        grown(rows).join(totals, keys)
        .withColumn(out, F.col("_run") + F.col("_base"))
        .drop("_bucket", "_v", "_run", "_base")
    )


def hash_rank(df: DataFrame, group: list[str], key: Column, tie: list[Column], out: str) -> DataFrame:
    """1-based rank by ``md5(key)`` inside ``group``: a seeded shuffle that needs no shared state."""
    digest = F.md5(key)
    hashed = df.withColumn("_h", digest)
    return bucketed_running(
        hashed, group, F.substring("_h", 1, 3), [F.col("_h"), *tie], out
    ).drop("_h")


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], buckets: int = 4096) -> DataFrame:
    """Exact interpolated quantiles per group: ``by``, the array ``q`` in the order of ``qs``, and the number ``n`` of values.

    Values are tallied first and the tally's running counts are taken in ``buckets`` of equal width between the least and the largest
    value there is, so neither a group nor its distinct values meet in one task, whatever their scale; the values at the two ranks around each quantile are then plain minima. Nulls don't count.
    """
    tally = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ends = tally.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))).scalar()
    tally = tally.withColumn("_ends", ends)
    place = (F.col(value) - F.col("_ends.lo")) / F.nullif(F.col("_ends.hi") - F.col("_ends.lo"), F.lit(0.0))
    tally = tally.withColumn("_at", F.floor(F.coalesce(place, F.lit(0.0)) * buckets)).drop("_ends")
    run = bucketed_running(tally, by, F.col("_at"), [F.col(value)], "_cum", F.col("_c")).drop("_at")
    total = tally.groupBy(*by).agg(F.sum("_c").alias("n"))
    run = run.join(total, by) if by else run.crossJoin(F.broadcast(total))  # one row without groups
    def at(rank):
        return F.min(F.when(F.col("_cum") > rank, F.col(value)))
    def one(q):
        place = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = at(F.floor(place)), at(F.ceil(place))
        return lo + (hi - lo) * F.max(place - F.floor(place))
    return run.groupBy(*by).agg(F.array(*[one(q) for q in qs]).alias("q"), F.max("n").alias("n"))


def hot_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key where a key may hold a third of all rows.

    A plain join: adaptive execution splits the partitions of hot keys and repeats the lookup rows for each part.
    """
    return rows.join(lookup, keys, how)

"""Answer tables: conformance, summaries, scans and sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.exprs import BOT, N_CLASSES

ANSWER_SCHEMA = T.StructType([
    T.StructField("video_id", T.StringType()), T.StructField("j", T.IntegerType()), T.StructField("delta_s", T.DoubleType()),
    T.StructField("pred", T.IntegerType()), T.StructField("probs", T.ArrayType(T.DoubleType())),
    T.StructField("committed", T.BooleanType()), T.StructField("system_id", T.StringType()),
])


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """All systems under one folder; the system is the partition, so a filter on it prunes files."""
    return spark.read.schema(ANSWER_SCHEMA).option("basePath", path).parquet(path)


def read_answers_csv(spark: SparkSession, glob: str, n_classes: int = N_CLASSES) -> DataFrame:
    """The wide text form, one folder per system; the folder name is the system."""
    cols = ["video_id string", "j int", "delta_s double", "pred int", *[f"p{k} double" for k in range(n_classes)], "committed string"]
    df = spark.read.schema(", ".join(cols)).option("header", True).csv(glob)
    p = [F.col(f"p{k}") for k in range(n_classes)]
    some_null = F.exists(F.array(*p), lambda x: x.isNull())
    return df.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("system_id"), "video_id", "j", "delta_s", "pred",
        F.when(~some_null, F.array(*p)).alias("probs"), F.lower("committed").isin("true", "1", "yes").alias("committed"))


def write_answers(answers: DataFrame, path: str) -> None:
    """Present cells in contract order, one folder per system.

    Rows are spread by system and clip before writing, so a system with a third of all cells is
    written by many tasks while each still opens files for few systems.
    """
    cols = ["video_id", "j", "delta_s", "pred", "probs", "committed", "system_id"]
    spread = answers.select(*cols).repartition("system_id", F.pmod(F.hash("video_id"), F.lit(64)))
    spread.sortWithinPartitions("system_id", "video_id", "j").write.partitionBy("system_id").parquet(path)


def duplicate_cells(answers: DataFrame) -> DataFrame:
    return answers.groupBy("system_id", "video_id", "j").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def conformance(answers: DataFrame, manifest_ids: DataFrame, j_min: int, j_max: int, n_classes: int = N_CLASSES) -> DataFrame:
    """One row per system with a count of violations for every rule of the answer contract.

    A committing system must give no answer between the anchor and its commitment.
    """
    known = manifest_ids.select("video_id", F.lit(True).alias("_known"))
    p, pred, j, com = F.col("probs"), F.col("pred"), F.col("j"), F.col("committed")
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    by_clip = Window.partitionBy("system_id", "video_id").orderBy("j")
    a = answers.join(known, "video_id", "left")
    a = a.withColumn("_was", F.lag("committed").over(by_clip)).withColumn("_label", F.lag("pred").over(by_clip))
    bad = {
        "unknown_clip": F.col("_known").isNull(),
        "pred_outside": ~pred.between(BOT, n_classes - 1),
        "partial_probs": p.isNotNull() & F.exists(p, lambda x: x.isNull()),
        "sum_off": p.isNotNull() & (F.abs(total - 1.0) > 1e-6),
        "prob_range": p.isNotNull() & F.exists(p, lambda x: (x < -1e-9) | (x > 1 + 1e-9)),
        "uncommitted_again": F.coalesce(F.col("_was"), F.lit(False)) & ~com,
        "committed_before_anchor": com & (j < 0),
        "answer_before_commitment": F.col("system_id").startswith("commit") & (j >= 0) & ~com & (pred != BOT),
        "frozen_label_changed": F.coalesce(F.col("_was"), F.lit(False)) & com & (pred != F.col("_label")),
    }
    per_clip = a.groupBy("system_id", "video_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("j").alias("j_lo"), F.max("j").alias("j_hi"),
        F.min("delta_s").alias("d_lo"), F.max("delta_s").alias("d_hi"),
        *[F.sum(F.coalesce(c, F.lit(False)).cast("bigint")).alias(k) for k, c in bad.items()])
    g = per_clip.groupBy("system_id").agg(
        F.sum("n_rows").alias("n_rows"), F.min("j_lo").alias("j_lo"), F.max("j_hi").alias("j_hi"), F.count(F.lit(1)).alias("n_clips"),
        (F.max("d_hi") - F.min("d_lo") < 1e-9).alias("one_delta"), *[F.sum(k).alias(k) for k in bad])
    steps = answers.groupBy("system_id", "j").agg(F.count(F.lit(1)).alias("_n")).groupBy("system_id").agg(F.count(F.lit(1)).alias("n_steps"))
    return (
        g.join(steps, "system_id")
        .withColumn("contiguous", F.col("j_hi") - F.col("j_lo") + 1 == F.col("n_steps"))
        .withColumn("covers", (F.col("j_lo") <= j_min) & (F.col("j_hi") >= j_max))
        .withColumn("rectangular", F.col("n_rows") == F.col("n_clips") * F.col("n_steps"))
    )

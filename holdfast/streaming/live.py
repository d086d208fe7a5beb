"""The causal rules on live answers, in Structured Streaming.

State is kept per (system, clip) and is a few numbers; it is dropped when the clip closes. Rows come
from any streaming source with the feed columns; sinks are file sinks with a checkpoint in the
shared folder, so a query resumes after a failure without repeating or losing output.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.exprs import BOT, stable_delay
from holdfast.operators import arms as R
from holdfast.session import fresh_path

FEED = ("system_id string, video_id string, class_code int, j int, pred int, probs array<double>, "
        "event_time timestamp, close_time timestamp")
KEYS = ["system_id", "video_id"]


def read_feed(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(FEED)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def run_available(df: DataFrame, label: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process what is there, write it to the shared folder, and read the result."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    q = (df.writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, f"{label}-checkpoint"))
         .outputMode(mode).trigger(availableNow=True).start(path))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


STEPS = "system_id string, video_id string, j int, ema_pred int, hysteresis_pred int, patience_pred int, pred int, changed boolean, n_missing int, event_time timestamp"


def live_smoothing(feed: DataFrame, j_min: int, alpha: float = 0.35, margin: float = 0.2, n: int = 2, delay: str = "10 minutes") -> DataFrame:
    """Every answered step once, when its clip closes: smoothed answers, whether the answer changed, steps missing before it.

    The state of a clip is the list of its answers, at most the stored steps and repeats of them, kept by a built-in aggregation.
    When the watermark on close times passes the clip, the steps are folded in order: the earliest answer to a step counts, a step
    that never came is an empty cell. So neither the order of arrival nor the cut into files changes a row, and no Python runs.
    """
    g = feed.filter(F.col("j") >= j_min).withWatermark("close_time", delay).groupBy(*KEYS, "close_time").agg(
        F.array_sort(F.collect_list(F.struct("j", "event_time", "pred", "probs"))).alias("_all"))
    first = F.filter("_all", lambda x, i: (i == 0) | (F.get("_all", i - 1)["j"] != x["j"]))
    g = g.select(*KEYS, first.alias("_said"))
    at = F.map_from_entries(F.transform("_said", lambda x: F.struct(x["j"], x["probs"])))
    g = g.withColumn("_at", at).withColumn("_last", F.element_at("_said", -1)["j"])
    dense = F.transform(F.sequence(F.lit(j_min), F.col("_last")), lambda j: F.struct(j.alias("j"), F.try_element_at("_at", j).alias("probs")))
    g = g.withColumn("_steps", dense)
    g = g.withColumns({"_ema": R.ema_fold(F.col("_steps"), alpha), "_hyst": R.hysteresis_fold(F.col("_steps"), margin), "_pat": R.patience_fold(F.col("_steps"), n)})

    def row(x, i):
        before = F.get("_said", i - 1)
        k = x["j"] - j_min
        return F.struct(
            x["j"].alias("j"), R.argmax(F.get("_ema", k)["probs"]).alias("ema_pred"), F.get("_hyst", k)["pred"].alias("hysteresis_pred"), F.get("_pat", k)["pred"].alias("patience_pred"),
            x["pred"].alias("pred"), ((i > 0) & F.coalesce(before["pred"] != x["pred"], F.lit(False))).alias("changed"),
            (x["j"] - F.when(i > 0, before["j"]).otherwise(j_min - 1) - 1).alias("n_missing"), x["event_time"].alias("event_time"))
    return g.select(*KEYS, F.explode(F.transform("_said", row)).alias("_r")).select(*KEYS, "_r.*")


def live_commitment(feed: DataFrame, threshold: float, steps: int, delta: float, delay: str = "10 minutes") -> DataFrame:
    """One row per clip after its close time: committed or not, frozen label, delay censored at the horizon.

    The earliest confident step wins whatever the order of arrival. A clip is given out once, when the
    watermark on close times passes it, and its state is dropped; rows after that are dropped too, so
    nothing can change a label that was given out. The whole rule is a built-in aggregation.
    """
    label = F.array_position("probs", F.array_max("probs")).cast("int") - 1
    fires = F.when(F.col("j").between(0, steps) & (F.array_max("probs") >= threshold), F.col("j"))
    g = feed.withWatermark("close_time", delay).groupBy(*KEYS, "close_time").agg(F.min(fires).alias("_j"), F.min_by(label, fires).alias("label"))
    return g.select(*KEYS, F.col("_j").isNotNull().alias("committed"), "label", (F.coalesce("_j", F.lit(steps)) * delta).alias("tau_s"))


def live_closure(feed: DataFrame, steps: int, delta: float, delay: str = "10 minutes") -> DataFrame:
    """Final metrics of a clip once the watermark passes its close time; stability needs the window's end.

    Steps not seen by then are wrong. The first answer to a step counts. State is one number per step.
    """
    at = [F.min_by("pred", F.when(F.col("j") == k, F.col("event_time"))).alias(f"_{k}") for k in range(steps + 1)]
    g = feed.withWatermark("close_time", delay).groupBy(*KEYS, "class_code", "close_time").agg(*at)
    wrong = F.array_max(F.array(*[F.when(F.coalesce(F.col(f"_{k}") != F.col("class_code"), F.lit(True)), F.lit(k)) for k in range(steps + 1)]))
    said = [F.coalesce(F.col(f"_{k}"), F.lit(BOT)) for k in range(steps + 1)]
    flips = sum((a != b).cast("int") for a, b in zip(said, said[1:]))
    missing = sum(F.col(f"_{k}").isNull().cast("int") for k in range(steps + 1))
    lw = F.coalesce(wrong, F.lit(-1))
    return g.select(*KEYS, stable_delay(lw, F.lit(steps), F.lit(delta)).alias("delay"), flips.alias("flips"), missing.alias("n_missing"), (lw < steps).alias("end_ok"))


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """The output of ``live_smoothing`` as a stream again."""
    return spark.readStream.schema(STEPS).parquet(path)


def live_health(steps: DataFrame, width: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Tumbling counts per system of answers, empty answers, changes and missing steps, from the steps in order."""
    w = steps.withWatermark("event_time", delay).groupBy("system_id", F.window("event_time", width).alias("w"))
    def n(c):
        return F.sum(c.cast("bigint"))
    return w.agg(F.count(F.lit(1)).alias("n_answers"), n(F.col("pred") == BOT).alias("n_bot"), n(F.col("changed")).alias("n_flips"), n(F.col("n_missing")).alias("n_missing"),
                 ).select("system_id", F.unix_seconds("w.start").alias("window_start"), "n_answers", "n_bot", "n_flips", "n_missing")

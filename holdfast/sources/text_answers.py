"""Answers delivered as text: many CSV files in one folder per system, read under one contract.

A system is refused as a whole and by name: for a missing column, for several output steps, for records that don't parse, for a cell
given twice. The others are read on. Files may have their columns in any order and further ones; probabilities are optional.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.exprs import BOT, N_CLASSES

NEEDED = {"video_id": "string", "j": "int", "delta_s": "double", "pred": "int"}
TRUE = ("true", "1", "yes")


def read_text(spark: SparkSession, folders: list[str], n_classes: int = N_CLASSES) -> DataFrame:
    """system_id, record and fields of every line: text as it stands, null where a file has no such column.

    Each folder holds one sub-folder ``system_id=<name>`` per system. Headers are taken file by file, so files with other columns or
    another order than their neighbours are read right; a line's fields are matched to the header of its own file.
    """
    from pyspark.sql.types import StringType, StructField, StructType
    lines = None
    for folder in folders:
        raw = spark.read.option("recursiveFileLookup", "true").schema(StructType([StructField("value", StringType())])).text(folder)
        raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"))
        lines = raw if lines is None else lines.unionByName(raw)
    # The header is the first line of a file: that of the first block, which is known by content, since all other lines differ from it.
    heads = lines.filter(F.col("value").rlike(r"(^|,)\"?video_id\"?(,|$)")).groupBy("file").agg(F.min("value").alias("header"))
    t = lines.join(heads, "file", "left").filter(F.col("header").isNull() | (F.col("value") != F.col("header"))).filter("value <> ''")
    names = F.transform(F.split("header", ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    wanted = [*NEEDED, "committed", *[f"p{k}" for k in range(n_classes)]]
    t = t.withColumn("_names", names).withColumn("_fields", F.split("value", ",", -1))

    def field(c):
        at = F.array_position("_names", c)
        return F.when(at > 0, F.get("_fields", (at - 1).cast("int"))).alias(c)
    system = F.regexp_extract("file", r"system_id=([^/]+)/", 1)
    return t.select(system.alias("system_id"), "file", "_names", (F.size("_fields") != F.size("_names")).alias("_ragged"), *[field(c) for c in wanted])


def _typed(lines: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    p = [F.col(f"p{k}").try_cast("double") for k in range(n_classes)]
    broken = F.coalesce(F.col("_ragged"), F.lit(True))
    for c, kind in NEEDED.items():
        if kind != "string":
            broken = broken | (F.col(c).try_cast(kind).isNull() & F.array_contains("_names", c))
    for k in range(n_classes):
        broken = broken | ((F.coalesce(F.col(f"p{k}"), F.lit("")) != "") & p[k].isNull())
    probs = F.array(*p)
    return lines.select(
        "system_id", "_names", F.coalesce(broken, F.lit(True)).alias("_broken"), "video_id", *[F.col(c).try_cast(k).alias(c) for c, k in NEEDED.items() if k != "string"],
        F.when(~F.exists(probs, lambda x: x.isNull()), probs).alias("probs"), F.coalesce(F.lower("committed").isin(*TRUE), F.lit(False)).alias("committed"))


def verdicts(lines: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """system_id, n_records, n_broken, refused: the reason in words, null where the system is accepted.

    Reasons come in this order: missing columns, broken records, mixed step, repeated cells.
    """
    t = _typed(lines, n_classes)
    lacks = [F.when(F.max((~F.coalesce(F.array_contains("_names", c), F.lit(False))).cast("int")) == 1, F.lit(c)) for c in NEEDED]
    cells = t.groupBy("system_id", "video_id", "j").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_broken"), 1)).alias("b"), F.min(F.round("delta_s", 9)).alias("lo"), F.max(F.round("delta_s", 9)).alias("hi"))
    per = cells.groupBy("system_id").agg(F.sum("n").alias("n_records"), F.sum("b").alias("n_broken"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("most"))
    cols = t.select("system_id", "_names").distinct().groupBy("system_id").agg(F.array_join(F.array_compact(F.array(*lacks)), ", ").alias("_lacks"))
    reason = (F.when(F.col("_lacks") != "", F.concat(F.lit("missing columns: "), F.col("_lacks"))).when(F.col("n_broken") > 0, "broken records")
              .when(F.col("lo") != F.col("hi"), "mixed step").when(F.col("most") > 1, "repeated cells"))
    return per.join(cols, "system_id").select("system_id", "n_records", "n_broken", reason.alias("refused"))


def accepted(lines: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """The answer table of all systems that aren't refused."""
    good = verdicts(lines, n_classes).filter("refused IS NULL").select("system_id")
    a = _typed(lines, n_classes).join(good, "system_id", "left_semi")
    return a.select("system_id", "video_id", "j", "delta_s", F.coalesce("pred", F.lit(BOT)).alias("pred"), "probs", "committed")


def require(lines: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """All systems' answers, or an error that names every refused system and why."""
    bad = verdicts(lines, n_classes).filter("refused IS NOT NULL").orderBy("system_id").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"answers of {r.system_id}: {r.refused}" for r in bad))
    return accepted(lines, n_classes)

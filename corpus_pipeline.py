"""The corpus pipeline: quality, exact copies, near copies, mixing, tokens. Each stage works on all that the one before kept."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.bpe import token_digests
from holdfast.llm.exact_copies import exact_copies
from holdfast.llm.minmax import near_copies
from holdfast.llm.mix_sources import balanced_mix
from holdfast.llm.quality import accepted
from holdfast.llm.row_keys import free_name, keyed
from holdfast.llm.text import small_batches, table, text_of
from holdfast.session import cut, fresh_path, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    return accepted(docs, table(spark, sf_dir, "labels"))


def _one_of_each(rows: DataFrame, key: str, groups: DataFrame, *first: Column) -> DataFrame:
    """``rows`` without those of a group (key, group_) that aren't its first by ``first``, doc_id (null last) and key."""
    order = F.struct(*first, F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col(key).alias("key"))
    groups = cut(groups, "pipeline-groups")
    stays = rows.select(key, order.alias("order_")).join(groups, key).groupBy("group_").agg(F.min("order_").alias("order_")).select(F.col("order_.key").alias(key))
    dropped = cut(groups.join(stays, key, "left_anti").select(key), "pipeline-dropped")
    return rows.join(dropped, key, "left_anti").drop(key)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies stays: of the longest that with the smallest doc_id. Ids may be null or repeated."""
    ship_package(spark)
    rows, key = keyed(docs)
    copies = exact_copies(rows.select(F.col(key).alias("doc_id"), "text")).where("group_size > 1")
    return _one_of_each(rows, key, copies.select(F.col("doc_id").alias(key), F.col("keep_id").alias("group_")), (-F.char_length(text_of())).alias("n"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, that with the smallest doc_id. Ids may be null or repeated."""
    ship_package(spark)
    small_batches(spark)
    rows, key = keyed(docs)
    groups = near_copies(rows.select(F.col(key).alias("doc_id"), "text"))
    return _one_of_each(rows, key, groups.select(F.col("doc_id").alias(key), F.col("component_id").alias("group_")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix holds it: not at all, once or twice. Ids may be null or repeated."""
    ship_package(spark)
    rows, key = keyed(docs)
    n, copy = free_name(docs, "row_copies"), free_name(docs, "row_copy")
    copies = balanced_mix(rows, row=key).where("copies > 0").select(F.col("row").alias(key), F.col("copies").cast("int").alias(n))
    return rows.join(copies, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(key, n, copy)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document of the mix."""
    ship_package(spark)
    return token_digests(docs)


STAGES = [("quality", quality), ("exact_copies", exact), ("near_copies", near), ("mix", mixing), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

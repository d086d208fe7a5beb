"""Tables kept between stages.

Ingest, the clip table, the protocol scan and the bootstrap samples are each computed once from the
supplied tables, written to the shared folder and read by everything after. A written table cuts the
lineage, survives the loss of executors, and is columnar, so later queries prune what they do not use.
Its files are many times smaller than its rows, so Spark's estimate of it is no ground for a broadcast: it is read as ``grown``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from holdfast.operators.ranking import grown
from holdfast.session import fresh_path

_PATHS: dict[tuple[str, str, str], str] = {}
_SCHEMAS: dict[str, StructType] = {}


def stage(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the stored table ``name`` of this run, building and writing it when it is not there."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key in _PATHS:
        try:
            return grown(spark.read.schema(_SCHEMAS[_PATHS[key]]).parquet(_PATHS[key]))
        except AnalysisException:
            del _PATHS[key]
    path = fresh_path(spark, name)
    df = build()
    df.write.parquet(path)
    _PATHS[key], _SCHEMAS[path] = path, df.schema
    return grown(spark.read.schema(df.schema).parquet(path))


def forget(spark: SparkSession, sf: str) -> None:
    """Drop the memory of stored tables, so that the next use builds them again (for timing)."""
    for key in [k for k in _PATHS if k[:2] == (spark.sparkContext.applicationId, sf)]:
        del _PATHS[key]

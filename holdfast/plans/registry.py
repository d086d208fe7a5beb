"""Named queries with their check SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def steady(sql: str) -> str:
    """Round to twelve places before every rounding to six, as the Spark side does for reports."""
    out, i = "", 0
    while True:
        k = sql.find("round(", i)
        if k < 0 or (k > 0 and sql[k - 1].isalnum()):
            if k < 0:
                return out + sql[i:]
            out, i = out + sql[i:k + 6], k + 6
            continue
        depth, end = 1, k + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = steady(sql[k + 6:end - 1])
        value, _, places = inner.rpartition(",")
        body = f"round({value},12),6" if places.strip() == "6" else inner
        out, i = f"{out}{sql[i:k]}round({body})", end


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = steady(sql)
        return fn
    return add

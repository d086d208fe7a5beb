"""A key for every row of a table, whatever its ids: stages decide on rows, so ids may be null or repeated."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.session import cut

ROW_BITS = 40


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a long key that no two rows share and that stays the same however often the table is read, and its name.

    A plain scan of files has such a key already: the number of the file (the driver holds one line per file) and the
    position in it, so texts aren't written again. Anything else is written once with its keys.
    """
    key, path, at, number = (free_name(docs, f"row_{x}") for x in ("key", "path", "at", "number"))
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return cut(docs.withColumn(key, F.monotonically_increasing_id()), "row-keys"), key
    meta = docs.metadataColumn("_metadata")
    rows = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(at))
    files = sorted(r[0] for r in rows.select(path).distinct().collect())
    names = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], f"{path} string, {number} long")
    rows = rows.join(F.broadcast(names), path)
    return rows.withColumn(key, F.shiftleft(number, ROW_BITS) + F.col(at)).drop(path, at, number), key

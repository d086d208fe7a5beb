"""Manifest ingest: casts, rule checks, reconciliation and integrity. Bad rows come back, named."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.exprs import class_code, normal_class

# The columns a manifest must have, and how far the stored length may be off.
REQUIRED = ["video_id", "source_cluster_id", "anchor_s", "fps", "duration_s", "post_anchor_length_s", "class_code"]
LENGTH_TOL = 1e-3


def to_double(c: Column, default: float | None = None) -> Column:
    v = c.try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(default))


def to_int(c: Column, default: int | None = None) -> Column:
    v = c.try_cast("double").try_cast("bigint")
    return v if default is None else F.coalesce(v, F.lit(default))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))


def check_manifest(df: DataFrame) -> DataFrame:
    """Cast, and add ``broken``: missing columns raise, bad rows are listed.

    Duplicate identifiers are found by a map-side combined count, not by a window over all rows.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"manifest lacks columns {missing}")
    typed = df.withColumns({c: to_double(F.col(c)) for c in ("anchor_s", "fps", "duration_s", "post_anchor_length_s")})
    typed = typed.withColumn("class_code", to_int(F.col("class_code")))
    counts = typed.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    typed = typed.join(counts, "video_id")
    gap = F.abs(F.col("duration_s") - F.col("anchor_s") - F.col("post_anchor_length_s"))
    return typed.withColumn("broken", violations({
        "not_numeric": F.col("anchor_s").isNull() | F.col("fps").isNull() | F.col("duration_s").isNull(),
        "duplicate_id": F.col("_n") > 1,
        "length_mismatch": F.coalesce(gap > LENGTH_TOL, F.lit(False)),
    })).drop("_n")


def decodable(c: Column) -> Column:
    return F.lower(c.cast("string")).isin("true", "1", "yes")


def build_manifest(meta: DataFrame) -> DataFrame:
    """Manifest rows from delivered metadata: path, frame count, duration, anchor, free-text type."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    name = normal_class(F.col("type_text"))
    return meta.select(
        stem.alias("video_id"), "anchor_s", "n_frames",
        F.when(F.col("duration_s") > 0, F.col("n_frames") / F.col("duration_s")).alias("fps"), "duration_s",
        (F.col("duration_s") - F.col("anchor_s")).alias("post_anchor_length_s"),
        class_code(name).alias("class_code"), name.alias("class_name"),
        F.when(name.isNotNull(), "unique").otherwise("unmapped").alias("map_status"),
    )


def whole(c: Column) -> Column:
    """A finite whole number, never a truncated one."""
    v = c.try_cast("double")
    return F.when((v == F.floor(v)) & (F.abs(v) < 9e15), v.cast("bigint"))


SECONDS_COLUMNS = {"anchor_s", "duration_s", "post_anchor_length_s"}


def check_frame_manifest(df: DataFrame, n_classes: int) -> DataFrame:
    """Rule check of a manifest in integer frames; seconds columns are refused outright."""
    carried = SECONDS_COLUMNS & set(df.columns)
    if carried:
        raise ValueError(f"a frame manifest must not carry seconds columns: {sorted(carried)}")
    f = {c: whole(F.col(c)) for c in ("first_frame", "anchor_frame", "last_frame", "post_anchor_frames", "class_code")}
    any_null = f["first_frame"].isNull() | f["anchor_frame"].isNull() | f["last_frame"].isNull() | f["post_anchor_frames"].isNull()
    ident = F.lower(F.trim(F.col("source_cluster_id")))
    return df.withColumn("broken", violations({
        "not_whole": any_null,
        "undefined_cluster": ident.isin("", "nan", "none", "null"),
        "class_outside_set": (f["class_code"] < 0) | (f["class_code"] >= n_classes),
        "length_mismatch": F.coalesce(f["post_anchor_frames"] != f["last_frame"] - f["anchor_frame"], F.lit(False)),
        "anchor_outside": F.coalesce((f["anchor_frame"] < f["first_frame"]) | (f["anchor_frame"] > f["last_frame"]), F.lit(False)),
    }))


def frame_index_statistics(frames: DataFrame, key: str, index: str, size: Column) -> DataFrame:
    """First, last, missing, duplicate and empty frames of every sequence."""
    return frames.groupBy(key).agg(
        F.count(F.lit(1)).alias("frame_count"), F.min(index).alias("first_frame"), F.max(index).alias("last_frame"),
        F.count_distinct(F.col(index)).alias("_u"), F.sum((size == 0).cast("bigint")).alias("zero_byte_frames"),
    ).withColumn("missing_indices", F.col("last_frame") - F.col("first_frame") + 1 - F.col("_u")).withColumn(
        "duplicate_indices", F.col("frame_count") - F.col("_u")).drop("_u")


def swap_candidates(rows: DataFrame) -> DataFrame:
    """For rows whose announced and delivered counts differ: who could have been swapped with them.

    Rows are matched through the table of (announced, delivered) tallies, which is as small as the
    number of distinct counts, so partners are counted exactly without listing any pair.
    """
    off = rows.filter(F.col("announced") != F.col("delivered"))
    tally = off.groupBy("announced", "delivered").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))
    by_announced = tally.groupBy(F.col("announced").alias("delivered")).agg(F.sum("n").alias("n_candidates"))
    recip = tally.select(F.col("announced").alias("delivered"), F.col("delivered").alias("announced"),
                         F.col("n").alias("n_reciprocal"), F.col("first_name").alias("first_reciprocal"))
    out = off.join(by_announced, "delivered", "left").join(recip, ["announced", "delivered"], "left")
    return out.fillna(0, ["n_candidates", "n_reciprocal"]).withColumn(
        "category", F.when(F.col("delivered") > F.col("announced"), "more_images_than_announced").otherwise("fewer_images_than_announced"))


def merge_annotators(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two judgements per code: agreement on a class, agreement to leave out, or ambiguity; gaps are listed."""
    j = first.select("code", F.col("decision").alias("d1")).join(second.select("code", F.col("decision").alias("d2")), "code", "full_outer")
    same = F.col("d1") == F.col("d2")
    status = (
        F.when(F.col("d1").isNull() | F.col("d2").isNull(), "incomplete")
        .when(same & (F.col("d1") == "out_of_scope"), "out_of_scope")
        .when(same & (F.col("d1") != "ambiguous"), "unique")
        .otherwise("ambiguous")
    )
    return j.withColumn("status", status).withColumn("mapped_class", F.when(status == "unique", F.col("d1")))


def file_digests(spark, glob: str, limit: int = 2**31 - 1, step: int = 1 << 22) -> DataFrame:
    """SHA-256 of every file; Spark does not list empty ones. Files of the local scheme are streamed by their tasks, ``step`` bytes at a time.

    Those of another store are read by Spark as values, except beyond ``limit``, as not every store can be opened here.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs as pafs
        for b in batches:
            out = []
            for path in b["path"].to_pylist():
                source, inner = pafs.FileSystem.from_uri(path)
                h = hashlib.sha256()
                with source.open_input_stream(inner, compression=None) as f:
                    while chunk := f.read(step):
                        h.update(chunk)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b["name"], b["length"], pa.array(out, pa.string())], ["name", "length", "digest"])
    files = spark.read.format("binaryFile").load(glob)
    name = F.substring_index("path", "/", -1).alias("name")
    first = files.select("path").first()  # all files of a glob are in one store
    if first is None or first["path"].startswith("file:"):
        limit = 0
    large = files.filter(F.col("length") >= limit).select("path", name, "length").mapInArrow(stream, "name string, length long, digest string")
    if not limit:
        return large
    return files.filter(F.col("length") < limit).select(name, "length", F.sha2("content", 256).alias("digest")).unionByName(large)


def verify_digests(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Found files against the expected (name, length, digest): ok, missing, unexpected, length_differs or digest_differs."""
    e = expected.select("name", F.col("length").alias("expected_length"), F.col("digest").alias("expected_digest"))
    j = found.join(e, "name", "full_outer")
    status = (F.when(F.col("digest").isNull(), "missing").when(F.col("expected_digest").isNull(), "unexpected")
              .when(F.col("length") != F.col("expected_length"), "length_differs").when(F.col("digest") != F.col("expected_digest"), "digest_differs").otherwise("ok"))
    return j.select("name", "length", "digest", status.alias("status"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], numbers: list[str], texts: list[str]) -> DataFrame:
    """Largest difference, null mismatches, text mismatches and rows on one side only."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_1") for c in numbers + texts], F.lit(True).alias("_in1"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_2") for c in numbers + texts], F.lit(True).alias("_in2"))
    j = left.join(right, keys, "full_outer")
    both = F.col("_in1").isNotNull() & F.col("_in2").isNotNull()
    parts = []
    for c in numbers:
        x, y = F.col(f"{c}_1"), F.col(f"{c}_2")
        parts.append(F.struct(F.lit(c).alias("column"), F.when(both, F.abs(x - y)).alias("d"),
                              (both & (x.isNull() != y.isNull())).cast("bigint").alias("nulls"), F.lit(0).cast("bigint").alias("text")))
    for c in texts:
        x, y = F.col(f"{c}_1"), F.col(f"{c}_2")
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("d"), F.lit(0).cast("bigint").alias("nulls"),
                              (both & ~x.eqNullSafe(y)).cast("bigint").alias("text")))
    long = j.select(F.explode(F.array(*parts)).alias("p"), F.col("_in1"), F.col("_in2"))
    return long.groupBy("p.column").agg(
        F.max("p.d").alias("max_abs_diff"), F.sum("p.nulls").alias("null_mismatches"), F.sum("p.text").alias("text_mismatches"),
        F.sum(F.col("_in2").isNull().cast("bigint")).alias("only_first"), F.sum(F.col("_in1").isNull().cast("bigint")).alias("only_second"))

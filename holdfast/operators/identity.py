"""Source clusters, splits and leakage, vocabularies and system identity."""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.exprs import source_cluster
from holdfast.operators.ranking import bucketed_running, hash_rank, hot_join, spread
from holdfast.session import cut


def cluster_mismatches(manifest: DataFrame) -> DataFrame:
    d = source_cluster(F.col("video_id"))
    return manifest.filter(d != F.col("source_cluster_id")).select("video_id", "source_cluster_id", d.alias("derived"))


def cluster_size_histogram(manifest: DataFrame) -> DataFrame:
    size = manifest.groupBy("source_cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return size.groupBy("size").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("size").alias("n_clips"))


def straddling_clusters(manifest: DataFrame, split: str) -> DataFrame:
    """Clusters present in more than one split, with the splits and their counts."""
    per = manifest.groupBy("source_cluster_id", split).agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("source_cluster_id").agg(F.sort_array(F.collect_set(split)).alias("_s"), F.sum("n").alias("n_clips"), F.max("n").alias("largest_part"))
    return g.filter(F.size("_s") > 1).select("source_cluster_id", F.array_join("_s", ",").alias("splits"), "n_clips", "largest_part")


def repair_leaks(manifest: DataFrame, split: str) -> DataFrame:
    """A straddling cluster goes to dev when it has a dev clip, else to train; ``moved`` marks changed clips.

    The target is aggregated per cluster first, so a huge cluster costs one combined row per task.
    """
    t = manifest.groupBy("source_cluster_id").agg(
        F.max((F.col(split) == "dev").cast("int")).alias("_dev"), (F.min(split) != F.max(split)).alias("_many"))
    m = hot_join(manifest, t, ["source_cluster_id"])
    new = F.when(~F.col("_many"), F.col(split)).when(F.col("_dev") == 1, "dev").otherwise("train")
    return m.withColumn("split_new", new).withColumn("moved", new != F.col(split)).drop("_dev", "_many")


def carve_out(manifest: DataFrame, frac: float, seed: int) -> DataFrame:
    """Whole clusters in seeded hash order until at least ``frac`` of the clips is taken."""
    sizes = manifest.groupBy("source_cluster_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("source_cluster_id")))
    run = bucketed_running(sizes.withColumn("_h", h), [], F.substring("_h", 1, 3), [F.col("_h"), F.col("source_cluster_id")], "_sum", F.col("n"))
    target = sizes.agg(F.round(F.sum("n") * F.lit(frac))).scalar()
    return run.withColumn("chosen", F.col("_sum") - F.col("n") < target).select("source_cluster_id", "n", "chosen")


def cluster_class(manifest: DataFrame) -> DataFrame:
    """Class stratum of a cluster: the class of its first clip in identifier order."""
    return manifest.groupBy("source_cluster_id").agg(F.min_by("class_code", "video_id").alias("class_code"), F.count(F.lit(1)).alias("n_clips"))


def stratified_halves(clusters: DataFrame, repeats: int, seed: int) -> DataFrame:
    """Per repeat and class, a random half of the clusters (rounded down) gets half = 1.

    Ranks are taken bucket by bucket, so a class holding most clusters is still spread out.
    """
    c = spread(clusters, "source_cluster_id").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    n = clusters.groupBy("class_code").agg(F.count(F.lit(1)).alias("_n"))
    key = F.concat_ws("|", F.lit(f"half{seed}"), F.col("rep"), F.col("source_cluster_id"))
    r = hash_rank(c, ["rep", "class_code"], key, [F.col("source_cluster_id")], "_r").join(n, "class_code")
    return r.withColumn("half", (F.col("_r") <= F.floor(F.col("_n") / 2)).cast("int")).drop("_r", "_n")


def group_folds(clusters: DataFrame, k: int, seed: int) -> DataFrame:
    """Class-stratified folds of whole clusters."""
    n = clusters.groupBy("class_code").agg(F.count(F.lit(1)).alias("_n"))
    key = F.concat_ws("|", F.lit(f"fold{seed}"), F.col("source_cluster_id"))
    r = hash_rank(clusters, ["class_code"], key, [F.col("source_cluster_id")], "_r").join(n, "class_code")
    return r.withColumn("fold", F.floor((F.col("_r") - 1) * k / F.col("_n")).cast("int")).drop("_r", "_n")


def vocabulary_hash(codes: list[str]) -> str:
    return hashlib.sha256("\n".join(codes).encode()).hexdigest()


def encode(df: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """Native code to index by the ordered vocabulary; null outside the closed set."""
    position = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col(column))
    return df.withColumn("code", F.when(position > 0, (position - 1).cast("int")))


def parse_system(df: DataFrame, column: str = "system_id") -> DataFrame:
    """Family, rule, tuned value, seed and parent from the naming convention."""
    parts = F.split(column, "__")
    family, arm = F.lower(parts[0]), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    word = F.lower(F.regexp_extract(arm, r"^([A-Za-z]+)", 1))
    rule = F.when(word == "", "unknown").otherwise(word)
    is_arm = family.isin("postproc", "commit")
    arm_rule = (
        F.when(family == "trivial", F.when(arm == "", "trivial").otherwise(F.concat(F.lit("trivial_"), rule)))
        .when(family == "prefix", F.when(arm == "", "prefix").otherwise(F.concat(F.lit("prefix_"), F.lower(arm))))
        .when(family == "postproc", rule).when(family == "commit", F.concat(F.lit("commit_"), rule))
        .when(family == "block", F.concat(F.lit("block_"), rule)).otherwise(family)
    )
    tail = F.regexp_replace(arm, r"^[A-Za-z]+", "")
    seed = F.regexp_extract(column, r"seed(\d+)", 1)
    return df.withColumns({
        "family": family, "arm_rule": arm_rule, "arm_value": F.when(is_arm & (tail != ""), tail),
        "seed": F.when(seed != "", seed),
        "parent": F.when(is_arm & (F.size(parts) > 2), F.array_join(F.slice(parts, 3, 99), "__")),
    })


def root_of(cards: DataFrame) -> DataFrame:
    """Follow parents to the root, chains of any length; a system whose chain runs into a cycle gets a null root and depth.

    Pointers are doubled: after r rounds each system points 2 ** r parents up, so the rounds are bounded by the log of the
    number of systems, and one that then still has a parent above it can only be in a cycle. The registry is a small dimension.
    """
    up = cards.select("system_id", F.col("parent").alias("anc"))
    at = up.select("system_id", F.coalesce("anc", "system_id").alias("root"), F.col("anc").isNotNull().cast("bigint").alias("depth"))
    for _ in range(max(1, cards.count()).bit_length()):
        above = at.select(F.col("system_id").alias("root"), F.col("root").alias("_far"), F.col("depth").alias("_more"))
        at = cut(at.join(above, "root", "left").select("system_id", F.coalesce("_far", "root").alias("root"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "roots")
    open_ = up.where("anc is not null").select(F.col("system_id").alias("root"), F.lit(True).alias("_cycle"))
    out = at.join(open_, "root", "left")
    return out.select("system_id", F.when(F.col("_cycle").isNull(), F.col("root")).alias("root"), F.when(F.col("_cycle").isNull(), F.col("depth")).cast("int").alias("depth"))


def restrict_split(manifest: DataFrame, split: str) -> DataFrame:
    """The clips of one split; an unknown or empty split is refused, never read as an empty table."""
    part = manifest.filter(F.col("split") == split)
    if part.isEmpty():
        known = sorted(r[0] for r in manifest.select("split").distinct().collect() if r[0] is not None)
        raise ValueError(f"split {split!r} has no clips; there are {known}")
    return part


def seed_groups(parsed: DataFrame, required: list[str]) -> DataFrame:
    """Label arms so that the spread inside a label is seed spread only.

    A rule with several values inside one seed is a sweep and is labelled with its value; otherwise
    every seed picked its own value and the rule alone is the label.
    """
    p = parsed.filter(F.col("seed").isNotNull())
    sweep = p.groupBy("arm_rule", "seed").agg(F.count_distinct(F.coalesce("arm_value", F.lit("-"))).alias("_n")).groupBy("arm_rule").agg((F.max("_n") > 1).alias("is_sweep"))
    p = p.join(sweep, "arm_rule")
    label = F.when(F.col("is_sweep"), F.concat(F.col("arm_rule"), F.lit(" @ "), F.coalesce("arm_value", F.lit("-")))).otherwise(F.col("arm_rule"))
    p = p.withColumn("label", label)
    full = p.groupBy("label").agg(F.count_distinct("seed").alias("n_seeds"))
    return p.join(full, "label").withColumn("complete", F.col("n_seeds") >= len(required))


def table_for_step(systems: DataFrame, reruns: DataFrame, factor: int) -> DataFrame:
    """Which table serves a coarser step: the stored one, its re-run, or the stored one with a note."""
    base = F.regexp_extract("system_id", r"^(.*)__stride(\d+)$", 1)
    k = F.regexp_extract("system_id", r"^(.*)__stride(\d+)$", 2)
    r = reruns.select(base.alias("system_id"), k.alias("_k"), F.col("system_id").alias("rerun")).filter(F.col("_k") == str(factor)).drop("_k")
    j = systems.join(r, "system_id", "left")
    return j.select(
        "system_id", F.when(F.col("subsampling_equivalent"), F.col("system_id")).otherwise(F.coalesce("rerun", "system_id")).alias("table_used"),
        F.when(~F.col("subsampling_equivalent") & F.col("rerun").isNull(), "no re-run supplied, sub-sampled the finest step").alias("note"))

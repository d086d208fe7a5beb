"""Duplicates, near-duplicates and the components they form.

A group of copies may hold a third of all rows, so no step lists the pairs inside a group. Identical
content is kept as groups with a representative: the edges from each member to it span the same
components as all pairs would, and pair counts follow from group sizes. Near search runs over
distinct fingerprints only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.operators.fingerprints import LANES, TALLY, tallies
from holdfast.operators.near import near_forest, near_pairs
from holdfast.operators.ranking import hot_join
from holdfast.session import cut

NEAR = 8


def token_fingerprint(docs: DataFrame, key: str, text: str) -> DataFrame:
    """64-bit vote of token hashes over the whole text, as two 32-bit halves.

    Tokens of one row are summed in its task, so a row is shuffled as its counters; rows of one key vote together.
    """
    v = docs.select(key, text).mapInArrow(tallies(key, text), f"`{key}` {docs.schema[key].dataType.simpleString()}, {TALLY}")
    ones = {(c, bit): F.sum(F.shiftright(f"{c}{k}", 21 * lane).bitwiseAND(F.lit(0x1FFFFF))) for c, k in LANES for lane, bit in enumerate(range(k, 32, 11))}

    def word(c):
        return sum((F.when(2 * ones[c, k] > F.sum("_n"), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(32)), F.lit(0).cast("bigint"))
    return v.groupBy(key).agg(word("_hi").alias("fp_hi"), word("_lo").alias("fp_lo"))


def distance(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def pair_count(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("bigint")


def identical_groups(items: DataFrame, key: str, digest: list[str]) -> DataFrame:
    """Groups of at least two items with one digest: size, representative and number of pairs."""
    g = items.groupBy(*digest).agg(F.count(F.lit(1)).alias("n_members"), F.min(key).alias("representative"))
    return g.filter("n_members > 1").withColumn("n_pairs", pair_count(F.col("n_members")))


def star_edges(items: DataFrame, key: str, digest: list[str]) -> DataFrame:
    """One edge from every member to its group's representative."""
    rep = items.groupBy(*digest).agg(F.min(key).alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return hot_join(items, rep, digest).filter(F.col(key) != F.col("a")).select("a", F.col(key).alias("b")).distinct()


def same_fingerprint(items: DataFrame, key: str, digest: str) -> DataFrame:
    """Fingerprint groups holding several contents; pairs already identical are not counted again."""
    per = items.groupBy("fp_hi", "fp_lo", digest).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("m"))
    g = per.groupBy("fp_hi", "fp_lo").agg(F.count(F.lit(1)).alias("n_contents"), F.sum("n").alias("n_members"), F.min("m").alias("representative"), F.sum(pair_count(F.col("n"))).alias("_same"))
    return g.filter("n_contents > 1").withColumn("n_pairs", pair_count(F.col("n_members")) - F.col("_same")).drop("_same")


def near_fingerprints(prints: DataFrame, radius: int = NEAR) -> DataFrame:
    """All pairs of distinct fingerprints within ``radius`` (at most 8) differing bits, exactly; listed as they are found, never stored."""
    return near_pairs(prints, radius)


def near_links(items: DataFrame, key: str, radius: int = NEAR) -> DataFrame:
    """Edges (a, b) that span what identical and near fingerprints link: members to their representative, a forest over representatives."""
    rep = items.groupBy("fp_hi", "fp_lo").agg(F.min(key).alias("val"))
    return star_edges(items, key, ["fp_hi", "fp_lo"]).unionByName(near_forest(rep, radius))


def cross_source(items: DataFrame, digest: list[str], source: str) -> DataFrame:
    """Pairs of identical items from different sources, counted from group sizes."""
    per = items.groupBy(*digest, source).agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy(*digest).agg(F.sum("n").alias("n_members"), F.count(F.lit(1)).alias("n_sources"), F.sum(pair_count(F.col("n"))).alias("_within"))
    return g.filter("n_sources > 1").withColumn("n_cross_pairs", pair_count(F.col("n_members")) - F.col("_within")).drop("_within")


def run_probes(frames: DataFrame) -> DataFrame:
    """Probes of three neighbouring contents, all distinct, with the length of the middle one's repeat.

    Two sequences share an aligned run with three distinct contents exactly when they share such a
    probe: where the third content first appears, the two before it differ, and the repeat of the
    middle one lies wholly inside the run.
    """
    order = Window.partitionBy("seq").orderBy("i")
    fresh = F.coalesce((F.lag("digest").over(order) != F.col("digest")).cast("int"), F.lit(1))
    isles = frames.withColumn("_isle", F.sum(fresh).over(order)).groupBy("seq", "_isle").agg(F.first("digest").alias("y"), F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("seq").orderBy("_isle")
    p = isles.withColumn("x", F.lag("y").over(near)).withColumn("z", F.lead("y").over(near)).filter("x <> z")
    return p.select("seq", F.md5(F.concat_ws("|", "x", "y", "n", "z")).alias("probe")).distinct()


def longest_equal_run(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """Longest run of consecutive equal frames of each listed pair of sequences.

    Equal frames of a pair that lie on one diagonal ``i - j`` and follow each other form a run.
    """
    fa = frames.select(F.col("seq").alias("a"), F.col("i").alias("ia"), "digest")
    fb = frames.select(F.col("seq").alias("b"), F.col("i").alias("ib"), "digest")
    m = pairs.join(fa, "a").join(fb, ["b", "digest"])
    diag = Window.partitionBy("a", "b", F.col("ia") - F.col("ib")).orderBy("ia")
    m = m.withColumn("_isle", F.col("ia") - F.row_number().over(diag))
    runs = m.groupBy("a", "b", (F.col("ia") - F.col("ib")).alias("_d"), "_isle").agg(
        F.count(F.lit(1)).alias("run"), F.min("ia").alias("start_a"), F.min("ib").alias("start_b"), F.count_distinct("digest").alias("distinct_contents"))
    best = runs.groupBy("a", "b").agg(F.min_by(F.struct("run", "start_a", "start_b", "distinct_contents"), F.struct(-F.col("run"), "start_a", "start_b")).alias("r"))
    shared = m.groupBy("a", "b").agg(F.count_distinct("digest").alias("n_shared"))
    size = frames.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    out = best.join(shared, ["a", "b"]).join(size.select(F.col("seq").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("seq").alias("b"), F.col("n").alias("n_b")), "b").select("*", "r.*").drop("r")
    exact = (F.col("run") == F.col("n_a")) & (F.col("run") == F.col("n_b"))
    temporal = (F.col("run") >= 3) & (F.col("distinct_contents") >= 3)
    return out.withColumn("relation", F.when(exact, "full_sequence_identical").when(temporal, "aligned_byte_run").otherwise("isolated_shared_bytes")).withColumn(
        "leakage_candidate", temporal | (exact & (F.col("distinct_contents") >= 3)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: every node with the smallest node of its component.

    Each round takes the least label among neighbours and then the label's own label, so labels
    travel in doubling steps. A round ends in a table in the shared folder; the loop stops when no
    label has changed, which the number of nodes bounds.
    """
    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = cut(edges.select(F.explode(ways).alias("e")).select("e.u", "e.v").distinct(), "edges")  # the edges are made once
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        near = hot_join(both.withColumnRenamed("v", "node"), labels, ["node"]).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("_near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_new"))
        step = cut(step, "labels")
        jump = step.select(F.col("node").alias("_new"), F.col("_new").alias("_far"))
        nxt = hot_join(step, jump.withColumnRenamed("_far", "_to"), ["_new"]).select("node", F.col("label").alias("_old"), F.least("_new", "_to").alias("label"))
        nxt = cut(nxt, "labels")
        if nxt.filter("_old <> label").isEmpty():
            return nxt.select("node", F.col("label").alias("component"))
        labels = nxt.select("node", "label")


def content_components(members: DataFrame, fields: list[str], splits: str) -> DataFrame:
    """Per component: identity, size, splits, conflicting annotation fields and what to do.

    The identity hashes the smallest member, the size and an order-free digest of the members, so a
    component of any size is reduced by partial aggregation.
    """
    word = F.conv(F.substring(F.md5(F.col("node").cast("string")), 1, 8), 16, 10).cast("bigint")
    per = members.withColumn("_h", word).groupBy("component").agg(
        F.count(F.lit(1)).alias("n_members"), F.bit_xor("_h").alias("_x"), F.min(splits).alias("split_lo"), F.max(splits).alias("split_hi"),
        *[(F.count(f) > 0).alias(f"_k_{f}") for f in fields],
        *[(F.coalesce(F.min(f) != F.max(f), F.lit(False)) | ((F.count(f) > 0) & (F.count(f) < F.count(F.lit(1))))).alias(f"_c_{f}") for f in fields])
    per = per.filter("n_members > 1")
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"_c_{f}"), F.lit(f)) for f in fields]))
    many = F.col("split_lo") != F.col("split_hi")
    ident = F.concat(F.lit("content_"), F.substring(F.sha2(F.concat_ws("|", F.col("component").cast("string"), F.col("n_members").cast("string"), F.col("_x").cast("string")), 256), 1, 16))
    return per.select(ident.alias("content_id"), "component", "n_members", many.alias("several_splits"), F.array_join(conflicts, ",").alias("conflicts"),
                      F.when(many | (F.size(conflicts) > 0), "quarantine_pending_review").otherwise("deduplicate_or_keep_in_same_partition").alias("action"))


def check_assignments(members: DataFrame, assigned: str) -> DataFrame:
    """Components whose members are assigned to different splits, and those not fully assigned."""
    placed = F.when(~F.col(assigned).isin("unassigned", "excluded"), F.col(assigned))
    return members.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_members"), F.coalesce(F.min(placed) != F.max(placed), F.lit(False)).alias("violation"),
        F.max((F.col(assigned) == "unassigned").cast("int")).cast("boolean").alias("unresolved"))


def guard_components(members: DataFrame, partition: str, source: str) -> DataFrame:
    """Quarantine every component that crosses a partition or a source, before any other filter."""
    g = members.groupBy("component").agg(
        (F.min(partition) != F.max(partition)).alias("_p"), (F.min(source) != F.max(source)).alias("_s"), F.count(F.lit(1)).alias("component_size"))
    flags = g.select("component", "component_size", (F.coalesce("_p", F.lit(False)) | F.coalesce("_s", F.lit(False))).alias("quarantined"))
    return hot_join(members, flags, ["component"])


def runs_with_gaps(matches: DataFrame, keys: list[str], order: str, gap: int) -> DataFrame:
    """Cut ordered correspondences into runs where the next one is more than ``gap`` away."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(1))
    return matches.withColumn("run", F.sum(fresh).over(w))


def map_position(matches: DataFrame, keys: list[str], x: str, y: str, target: str, gap: int) -> DataFrame:
    """Carry a position of one sequence into the other by linear interpolation between correspondences.

    Null where the position lies outside them or in a gap wider than ``gap``.
    """
    g = matches.groupBy(*keys, target).agg(
        F.max_by(F.struct(x, y), F.when(F.col(x) <= F.col(target), F.col(x))).alias("_lo"), F.min_by(F.struct(x, y), F.when(F.col(x) >= F.col(target), F.col(x))).alias("_hi"))
    x0, y0, x1, y1 = (F.col(f"_lo.{x}"), F.col(f"_lo.{y}"), F.col(f"_hi.{x}"), F.col(f"_hi.{y}"))
    inside = F.when(x0 == x1, y0.cast("double")).when(x1 - x0 <= gap, y0 + (F.col(target) - x0) * (y1 - y0) / (x1 - x0))
    return g.select(*keys, target, inside.alias("mapped"))

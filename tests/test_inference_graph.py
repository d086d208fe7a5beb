"""Inference, calibration, selection, identity and the duplicate graph."""
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from holdfast.functions.exprs import class_code, normal_class, source_cluster
from holdfast.functions.tails import normal_two_sided, student_quantile
from holdfast.operators import calibration as H
from holdfast.operators import duplicates as U
from holdfast.operators import identity as I
from holdfast.operators import inference as G
from holdfast.operators import selection as S


def test_draws_keep_the_number_of_clusters(spark):
    c = spark.createDataFrame([(f"c{k}",) for k in range(37)], "source_cluster_id string")
    d = G.cluster_draws(c, 50, 1)
    assert d.groupBy("b").agg(F.sum("w").alias("n")).filter("n <> 37").count() == 0
    assert d.select("b").distinct().count() == 50
    assert d.exceptAll(G.cluster_draws(c.repartition(9), 50, 1)).count() == 0


def test_replicate_median_equals_repeated_median(spark):
    rng = random.Random(5)
    rows = [("s", f"c{rng.randrange(6)}", 0, rng.randrange(7)) for _ in range(60)]
    c = spark.createDataFrame(rows, "system_id string, source_cluster_id string, class_code int, flips int")
    d = G.cluster_draws(c, 20, 2)
    w = {}
    for r in d.collect():
        w.setdefault(r.b, {})[r.source_cluster_id] = r.w
    got = {r.b: r.m for r in G.replicate_median(c, d, ["system_id"], "flips", "m").collect()}
    for b, ws in w.items():
        v = sorted(itertools.chain.from_iterable([f] * ws.get(k, 0) for _, k, _, f in rows))
        assert got[b] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def test_holm_step_down(spark):
    t = spark.createDataFrame([("m", "a", "b", 0.01), ("m", "a", "c", 0.04), ("m", "b", "c", 0.03)], "metric string, system_a string, system_b string, p double")
    got = [(r.p, round(r.p_adjusted, 10), r.reject) for r in G.holm(t, ["metric"], "p").orderBy("p").collect()]
    assert got == [(0.01, 0.03, True), (0.03, 0.06, False), (0.04, 0.06, False)]


def test_tails(spark):
    df = spark.createDataFrame([(1.959963984540054,), (0.0,), (None,)], "z double")
    p = [r.p for r in df.select(normal_two_sided("z").alias("p")).collect()]
    assert abs(p[0] - 0.05) < 1e-12 and p[1] == 1.0 and (p[2] is None or math.isnan(p[2]))
    assert abs(student_quantile(0.025, 10) - 2.228138852) < 1e-6 and abs(student_quantile(0.05, 1) - 6.313751515) < 1e-5
    assert abs(student_quantile(0.005, 86) - 2.634) < 1e-2


def test_tied_pairs_touching_intervals_are_tied(spark):
    i = spark.createDataFrame([("a", 0.0, 1.0), ("b", 1.0, 2.0), ("c", 2.5, 3.0), ("d", None, None)], "system_id string, ci_lo double, ci_hi double")
    assert [(r.system_a, r.system_b) for r in G.tied_pairs(i).collect()] == [("a", "b")]


def test_robust_status(spark):
    rows = [(0.3, 0.5, 0.6, 0.9), (-0.9, -0.5, -0.6, -0.3), (-0.9, 0.2, -0.5, 0.6), (-0.1, 0.2, 0.1, 0.6), (-0.1, -0.05, 0.1, 0.6)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    s = [r.s for r in df.select(G.robust_status(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(0.0)).alias("s")).collect()]
    assert s == ["robust_a", "robust_b", "supported_reversal", "protocol_specific", "inconclusive"]


def test_band_flags_coordinates_without_spread(spark):
    pts = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, value double")
    reps = spark.createDataFrame([(k, b, v) for b in range(40) for k, v in (("x", 1.0 + ((b % 5) - 2) * 0.1), ("y", 2.0))], "k string, b int, value double")
    got = {r.k: r for r in G.simultaneous_band(pts, reps, ["k"]).collect()}
    assert got["y"].zero_variance and got["y"].lower == got["y"].upper == 2.0
    assert not got["x"].zero_variance and got["x"].lower < 0.9


def scan_of(spark, values):
    """values: {(system, eps): value}"""
    rows = [(s, f"p{e}", e, 0.0, 0.5, 3.0, True, "rmscd", v) for (s, e), v in values.items()]
    return spark.createDataFrame(rows, "system_id string, pi_hash string, eps_sys_s double, eps_jit_sd_s double, delta_s double, h_s double, in_plaus boolean, metric string, value double")


def test_rank_preservation_and_eps_max(spark):
    s = scan_of(spark, {("a", 0.0): 1.0, ("b", 0.0): 2.0, ("c", 0.0): 3.0, ("a", 0.5): 1.5, ("b", 0.5): 2.5, ("c", 0.5): 3.5, ("a", 1.0): 2.0, ("b", 1.0): 2.0, ("c", 1.0): 1.0})
    pairs = spark.createDataFrame([("rmscd", "a", "b"), ("rmscd", "a", "c"), ("rmscd", "b", "c")], "metric string, system_a string, system_b string")
    r = H.rank_preservation(s, pairs, "p0.0")
    assert {x.pi_hash: (x.n_pairs, x.r_m) for x in r.collect()} == {"p0.0": (3, 1.0), "p0.5": (3, 1.0), "p1.0": (3, 0.0)}
    e = H.eps_max(r, "p0.0").first()
    assert e.eps_max == 0.5 and not e.saturated
    o = {x.pi_hash: (round(x.b_m, 9), round(x.s_m, 9)) for x in H.offsets_and_spread(s, "p0.0").collect()}
    assert o["p0.5"] == (0.5, 0.0) and o["p1.0"][0] == round((1.0 + 0.0 - 2.0) / 3, 9)


def test_delta_star(spark):
    f = spark.createDataFrame([("flat", 0.25, 4.0), ("flat", 0.5, 4.0), ("flat", 1.0, 2.0), ("grow", 0.25, 8.0), ("grow", 0.5, 4.0), ("grow", 1.0, 2.0)], "s string, delta_s double, value double")
    got = {r.s: (r.delta_star, r.saturated, r.monotone) for r in H.delta_star(f, ["s"]).collect()}
    assert got == {"flat": (0.5, True, True), "grow": (0.25, False, True)}


def test_verdict(spark):
    rows = [(None, 0.1, 1.0), (0.5, 0.1, 1.0), (0.95, 0.1, None), (0.95, 0.1, 0.0), (0.95, 0.1, 1.0), (0.95, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "r double, m double, k double")
    v = [x.v for x in df.select(H.verdict(F.col("r"), F.col("m"), F.col("k")).alias("v")).collect()]
    assert v == ["undetermined", "not comparable", "undetermined (no ruler)", "normalize (ruler is zero)", "poolable", "normalize"]


def test_gate_is_three_valued(spark):
    c = spark.createDataFrame([(1.0, 0.5, 1.5, 0.0, -0.1, 0.1, 0.2, 0.3), (1.0, 0.5, 1.5, 0.5, 0.4, 0.6, 0.2, 0.3), (None, 0.5, 1.5, 0.0, -0.1, 0.1, 0.2, 0.3)], "a double, b double, c double, d double, e double, f double, g double, h double")
    assert [r.x for r in c.select(H.consequence(*[F.col(k) for k in "abcdefgh"]).alias("x")).collect()] == [True, False, None]


def test_seed_replication_needs_two_seeds_and_two_bases(spark):
    rows = [("v1", "v2", "b1", "b2", "1", "1", 1.0, True), ("v2", "v1", "b2", "b1", "2", "2", -1.0, True), ("v1", "v2", "b1", "b2", "3", "3", -1.0, False), ("v1", "v3", "b1", "b1", "1", "1", 1.0, True), ("v1", "v3", "b1", "b1", "2", "2", 1.0, True)]
    df = spark.createDataFrame(rows, "variant_a string, variant_b string, base_a string, base_b string, seed_a string, seed_b string, diff double, significant boolean")
    got = {(r.variant_1, r.variant_2): (r.n_same_direction, r.passed) for r in H.seed_replicated(df).collect()}
    assert got == {("v1", "v2"): (2, True), ("v1", "v3"): (2, False)}


def test_selection_tie_rule_and_kendall(spark):
    s = spark.createDataFrame([("k", "b", 0.9, 1.0), ("k", "a", 0.9 + 2e-10, 1.2), ("k", "c", 0.5, 0.8), ("k", "d", 0.5, 0.9)], "k string, system_id string, accuracy double, delay double")
    r = S.regret(s, ["k"]).first()
    assert (r.by_accuracy, r.by_delay, r.same_choice) == ("a", "c", False) and abs(r.delay_regret - 0.4) < 1e-12
    t = S.kendall(s.withColumn("bad", -F.col("accuracy")), ["k"], "delay", "bad").first().tau
    assert abs(t - (-4.0 / math.sqrt(6 * 4))) < 1e-9


def test_source_cluster_and_class_names(spark):
    names = {"3Xd6PxEvbNk_11_00": "3Xd6PxEvbNk", "3Xd6PxEvbNk_00.mp4": "3Xd6PxEvbNk", "abc_1234": "abc_1234", "_12": "_12", "_12_34": "_12", "a.b/c_01": "a.b/c"}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.c for r in df.select("n", source_cluster(F.col("n")).alias("c")).collect()} == names
    df = spark.createDataFrame([(" Head On ",), ("T-bone/Side",), ("Single-Vehicle",), ("ufo",)], "t string")
    assert [r.c for r in df.select(class_code(normal_class(F.col("t"))).alias("c")).collect()] == [0, 2, 4, None]


def test_parse_and_root_with_cycle(spark):
    df = spark.createDataFrame([("postproc__ema0p2__prefix__gru64__seed7",), ("trivial__majority",), ("block__lock__d0-1",), ("commit__msp0p8__clip__mean",)], "system_id string")
    p = {r.system_id: r for r in I.parse_system(df).collect()}
    r = p["postproc__ema0p2__prefix__gru64__seed7"]
    assert (r.family, r.arm_rule, r.arm_value, r.seed, r.parent) == ("postproc", "ema", "0p2", "7", "prefix__gru64__seed7")
    assert p["trivial__majority"].arm_rule == "trivial_majority" and p["block__lock__d0-1"].arm_rule == "block_lock"
    cards = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")], "system_id string, parent string")
    got = {r.system_id: (r.root, r.depth) for r in I.root_of(cards).collect()}
    assert got == {"a": ("c", 2), "b": ("c", 1), "c": ("c", 0), "x": (None, None), "y": (None, None)}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}" if i < 12 else None) for i in range(13)] + [("p", "q"), ("q", "r"), ("r", "p"), ("s", "p")], "system_id string, parent string")
    got = {r.system_id: (r.root, r.depth) for r in I.root_of(chain).collect()}
    assert got == {**{f"n{i}": ("n12", 12 - i) for i in range(13)}, **dict.fromkeys("pqrs", (None, None))}


def test_split_restriction_refuses(spark):
    m = spark.createDataFrame([("a", "dev"), ("b", "test")], "video_id string, split string")
    assert I.restrict_split(m, "dev").count() == 1
    with pytest.raises(ValueError, match="validation"):
        I.restrict_split(m, "validation")


def test_exact_quantiles(spark):
    import random
    from holdfast.operators.ranking import exact_quantiles
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([rng.random() * 9 - 3, 1.25, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "x", [0.0, 0.1, 0.5, 1.0]).collect()}
    for r in df.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(q) for q in (0.0, 0.1, 0.5, 1.0)])).alias("q")).collect():
        assert got[r.g] == pytest.approx(r.q)


def test_supported_draws_are_as_many_as_asked(spark):
    from holdfast.operators import inference as G
    clusters = spark.createDataFrame([(f"c{i}", 6 if i == 0 else 0) for i in range(9)], "source_cluster_id string, class_code int")
    got = G.draw_supported(clusters, clusters, 40, 5).collect()
    assert sorted(r.rep for r in got) == list(range(40)) and any(r.rejected_before for r in got)
    with pytest.raises(ValueError):
        G.draw_supported(clusters.where("class_code = 0"), clusters, 5, 5)


def test_leak_repair_and_carve_out(spark):
    m = spark.createDataFrame([("a_1", "a", "dev"), ("a_2", "a", "test"), ("b_1", "b", "train"), ("b_2", "b", "test"), ("c_1", "c", "test")], "video_id string, source_cluster_id string, split string")
    r = {x.video_id: x.split_new for x in I.repair_leaks(m, "split").collect()}
    assert r == {"a_1": "dev", "a_2": "dev", "b_1": "train", "b_2": "train", "c_1": "test"}
    c = I.carve_out(m, 0.4, 1)
    assert c.filter("chosen").agg(F.sum("n")).first()[0] >= 2


def brute_near(values):
    return {(a, b, bin(a ^ b).count("1")) for a, b in itertools.combinations(sorted(values), 2) if bin(a ^ b).count("1") <= 8}


def test_near_fingerprints_miss_nothing(spark):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:40]:
        for r in range(1, 11):
            w = v
            for k in rng.sample(range(64), r):
                w ^= 1 << k
            values.add(w)
    df = spark.createDataFrame([(v >> 32, v & 0xFFFFFFFF) for v in values], "fp_hi bigint, fp_lo bigint")
    got = {((r.a_hi << 32) | r.a_lo, (r.b_hi << 32) | r.b_lo, r.distance) for r in U.near_fingerprints(df).collect()}
    assert got == brute_near(values) and len(got) > 300


def find(edges):
    up = {}
    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(1, 40)] + [(200 + k, 200 + (k + 1) % 17) for k in range(17)]
    random.Random(6).shuffle(edges)
    got = {r.node: r.component for r in U.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == find(edges)


def test_identical_groups_count_pairs_without_listing_them(spark):
    df = spark.createDataFrame([(k, "x" if k < 7 else f"d{k}", "s%d" % (k % 2)) for k in range(10)], "id bigint, digest string, source string")
    g = U.identical_groups(df, "id", ["digest"]).first()
    assert (g.n_members, g.representative, g.n_pairs) == (7, 0, 21)
    assert U.star_edges(df, "id", ["digest"]).count() == 6
    assert U.cross_source(df, ["digest"], "source").first().n_cross_pairs == 12


def longest(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    return best


def test_run_probes_find_every_leak(spark):
    rng = random.Random(8)
    seqs = {}
    for k in range(24):
        s = [rng.choice("abcd") for _ in range(rng.randrange(3, 9))]
        if k % 3 == 1:
            s = s[:2] + seqs[k - 1][1:5] + s[2:]
        seqs[k] = s
    def leak(a, b):
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= 3 and len(set(a[i:i + n])) >= 3:
                    return True
        return False
    f = spark.createDataFrame([(k, i, c) for k, s in seqs.items() for i, c in enumerate(s)], "seq bigint, i int, digest string")
    e = U.star_edges(U.run_probes(f), "seq", ["probe"])
    runs = U.longest_equal_run(e, f).collect()
    assert all(leak(seqs[r.a], seqs[r.b]) for r in runs)
    assert all((r.run, r.start_a, r.start_b) == longest(seqs[r.a], seqs[r.b]) for r in runs)
    want = find([(a, b) for a, b in itertools.combinations(seqs, 2) if leak(seqs[a], seqs[b])])
    assert find([(r.a, r.b) for r in runs]) == want and len(want) > 4


def test_runs_and_interpolation(spark):
    m = spark.createDataFrame([("p", x, y, 7) for x, y in ((0, 0), (3, 4), (6, 8), (9, 11), (20, 22))], "k string, x bigint, y bigint, target bigint")
    assert [r.run for r in U.runs_with_gaps(m, ["k"], "x", 5).orderBy("x").collect()] == [1, 1, 1, 1, 2]
    assert U.map_position(m, ["k"], "x", "y", "target", 5).first().mapped == 9.0
    assert U.map_position(m.withColumn("target", F.lit(12).cast("bigint")), ["k"], "x", "y", "target", 5).first().mapped is None


def test_frame_manifest_refuses_seconds(spark):
    from holdfast.sources.manifest import check_frame_manifest
    with pytest.raises(ValueError, match="seconds"):
        check_frame_manifest(spark.createDataFrame([("v", 1.0)], "video_id string, anchor_s double"), 5)

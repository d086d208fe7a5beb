"""Fingerprints and the search for near ones in tasks, against brute force."""
import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from holdfast.operators import duplicates as U
from holdfast.operators import fingerprints as P
from holdfast.operators import near as N
from holdfast.operators import probes


def vote(tokens):
    h = [int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big") for t in tokens]
    v = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    return v >> 32, v & 0xFFFFFFFF


def tokens(text):
    return [t for t in re.split(r"[ \t\n\x0b\f\r]+", text or "") if t]


def test_fingerprints_of_texts_and_lines(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 90)))) for k in range(30)]
    rows += [(40, "a\x0bb\x1cc d e f\f g\r\n  "), (41, None), (42, " \n\t"), (43, "first part"), (43, "of one key"), (44, "x " * 700_000 + "y\n" * 5), (45, "same\nsame\n \n\nother line\x0b")]
    df = spark.createDataFrame(rows, "id long, text string")
    by = {}
    for i, t in rows:
        by.setdefault(i, []).extend(tokens(t))
    got = {r["id"]: (r.fp_hi, r.fp_lo) for r in U.token_fingerprint(df, "id", "text").collect()}
    assert got == {i: vote(t) for i, t in by.items() if t}
    lines = {(i, hashlib.md5(x.encode()).hexdigest(), *vote(tokens(x))) for i, t in rows if i != 44 for x in (t or "").split("\n") if tokens(x)}
    assert sorted(map(tuple, probes.line_probes(df.where("id <> 44"), "id", "text").collect())) == sorted(lines)


def test_long_texts_are_summed_in_pieces():
    v = P.Votes()
    v.add(b"a b " * (P.PIECE + 7))
    v.add(b"")
    v.add(b"c")
    n, ones = v.done()
    assert n.tolist() == [2 * P.PIECE + 14, 0, 1] and ones[0].max() <= n[0] and ones[1].sum() == 0
    a = np.unpackbits(np.frombuffer(hashlib.md5(b"a").digest()[:8] + hashlib.md5(b"b").digest()[:8], np.uint8).reshape(2, 8), axis=1).sum(axis=0)
    assert (ones[0] == a * (P.PIECE + 7)).all()


def crowd(n, seed=5):
    """Distinct fingerprints around a few centres, and some at random."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 7)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def close(prints):
    return {(a, b): (a ^ b).bit_count() for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 8}


def test_every_pair_is_met_once_in_large_and_parted_groups():
    x = crowd(2500)
    u, want = np.array(x, np.uint64), close(x)
    for parts in (1, 3):
        found = []
        g = N._groups_of(u)
        for k in range(9):
            for v in np.unique(g[k]):
                m = u[g[k] == v]
                dealt = [m[i::parts] for i in range(parts)]
                for p, q in itertools.combinations_with_replacement(range(parts), 2):
                    both = dealt[p] if p == q else np.concatenate((dealt[p], dealt[q]))
                    for i, j, d in N._tile(both, None if p == q else len(dealt[p]), k, 8, True):
                        found += [(min(a, b), max(a, b), e) for a, b, e in zip(both[i].tolist(), both[j].tolist(), d.tolist())]
        assert len(found) == len(want) and {(a, b): d for a, b, d in found} == want


def test_readings_of_near_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 40)  # many groups are dealt into parts
    x = crowd(400)
    want = close(x)
    df = spark.createDataFrame([(v >> 32, v & 0xFFFFFFFF, k % 50) for k, v in enumerate(x)], "fp_hi long, fp_lo long, val long")
    got = {((r.a_hi << 32) | r.a_lo, (r.b_hi << 32) | r.b_lo): r.distance for r in U.near_fingerprints(df).collect()}
    assert got == want and U.near_fingerprints(df).count() == len(want)
    val = {v: k % 50 for k, v in enumerate(x)}
    counts = {r.distance: r.k for r in N.near_counts(df, 8).collect()}
    assert counts == {d: sum(val[a] * val[b] for (a, b), e in want.items() if e == d) for d in range(9)}
    groups = {}
    for (a, b), d in want.items():
        groups.setdefault(tuple(sorted((val[a], val[b]))), []).append(d)
    for loops in (True, False):
        assert {(r.a, r.b): (r.distance, r.n) for r in N.near_values(df, 8, loops).collect()} == {k: (min(d), len(d)) for k, d in groups.items() if loops or k[0] != k[1]}
    ids = df.withColumn("val", F.col("fp_hi") * 7 + F.col("fp_lo"))
    number = {v: (v >> 32) * 7 + (v & 0xFFFFFFFF) for v in x}
    edges = spark.createDataFrame([(number[a], number[b]) for a, b in want], "a long, b long")
    assert sorted(map(tuple, U.components(N.near_forest(ids, 8)).collect())) == sorted(map(tuple, U.components(edges).collect()))
    again = ids.repartition(7).orderBy(F.desc("fp_lo"))
    assert sorted(map(tuple, N.near_forest(ids, 8).collect())) == sorted(map(tuple, N.near_forest(again, 8).collect()))
    assert N.near_forest(ids, 8).count() < 9 * 40 * len(x)


def test_near_search_shuffles_a_fingerprint_nine_times_and_stores_no_pair(spark):
    rows = [N._dealt({})(iter([_batch(crowd(100))]))]
    assert sum(b.num_rows for r in rows for b in r) == 900  # it was 67 keys on both sides of a join
    df = spark.createDataFrame([(v >> 32, v & 0xFFFFFFFF) for v in crowd(100)], "fp_hi long, fp_lo long")
    plan = U.near_fingerprints(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def _batch(x):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)), pa.array(np.zeros(len(x), np.int64))], ["fp", "val"])


def test_components_make_their_edges_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long").coalesce(1).mapInArrow(noted, "a long, b long")
    assert sorted(map(tuple, U.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert seen.value == 3  # a forest made twice may be two different ones

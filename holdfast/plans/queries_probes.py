"""Items with several probes, runs of any sequences, seeded pairs (survey J7-J9, J12, J13, J17)."""
from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions.exprs import r6
from holdfast.operators import duplicates as U
from holdfast.operators import probes as P
from holdfast.plans.queries_j import _SEQ, _VOTE, _WORD, PRINTS, frames, prints
from holdfast.plans.registry import query
from holdfast.plans.stages import stage
from holdfast.sources import derive as D

# Non-empty lines are the probes of a document.
PROBES = f"""WITH pl AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), pt AS (SELECT DISTINCT t FROM pl), tk AS (SELECT t AS line, unnest(string_split_regex(t, '\\s+')) AS t FROM pt),
th AS (SELECT line, ('0x'||substr(md5(t),1,8))::BIGINT AS h, ('0x'||substr(md5(t),9,8))::BIGINT AS l FROM tk WHERE t<>''), vt AS (SELECT line, {_VOTE} FROM th GROUP BY line),
pb AS (SELECT doc_id, md5(t) AS digest, {_WORD['h']} AS fp_hi, {_WORD['l']} AS fp_lo FROM pl JOIN vt ON vt.line=pl.t)"""


def probes(spark, sf):
    return stage(spark, sf, "probes", lambda: P.line_probes(D.table(spark, sf, "documents"), "doc_id", "text"))


@query("j07_shared_probes", PROBES + ", g AS (SELECT digest, count(*) AS n, min(doc_id) AS r, bit_xor(('0x'||substr(md5(doc_id::VARCHAR),1,12))::BIGINT) AS x FROM pb GROUP BY ALL HAVING count(*)>1) SELECT n::BIGINT AS n_members, r AS representative, count(*)::BIGINT AS n_probes, min(digest) AS first_digest, (n*(n-1)//2)::BIGINT AS n_pairs FROM g GROUP BY n, r, x")
def j07p(spark, sf):
    """Documents that share a line, however much else differs: sets with size and representative."""
    return P.shared_contents(probes(spark, sf), "doc_id")


@query("j08_shared_fingerprints", PROBES + ", c AS (SELECT fp_hi, fp_lo, count(DISTINCT digest) AS n_contents, count(DISTINCT doc_id) AS n_members, min(doc_id) AS representative FROM pb GROUP BY ALL) SELECT fp_hi, fp_lo, n_contents::BIGINT AS n_contents, n_members::BIGINT AS n_members, representative, (n_members*(n_members-1)//2)::BIGINT AS n_pairs FROM c WHERE n_contents>1 AND n_members>1")
def j08p(spark, sf):
    """Lines of one fingerprint but several contents, and the documents that hold them."""
    return P.shared_fingerprints(probes(spark, sf), "doc_id")


_LINKS = """, ds AS (SELECT DISTINCT fp_hi, fp_lo FROM pb), rp AS (SELECT fp_hi, fp_lo, min(doc_id) AS r FROM pb GROUP BY ALL),
nr AS (SELECT a.fp_hi AS a_hi, a.fp_lo AS a_lo, b.fp_hi AS b_hi, b.fp_lo AS b_lo, (bit_count(xor(a.fp_hi,b.fp_hi))+bit_count(xor(a.fp_lo,b.fp_lo)))::INT AS distance FROM ds a JOIN ds b ON (a.fp_hi<b.fp_hi OR (a.fp_hi=b.fp_hi AND a.fp_lo<b.fp_lo)) WHERE bit_count(xor(a.fp_hi,b.fp_hi))+bit_count(xor(a.fp_lo,b.fp_lo))<=8),
al AS (SELECT DISTINCT r AS x, doc_id AS y, 0 AS distance, fp_hi, fp_lo, NULL::BIGINT AS o_hi, NULL::BIGINT AS o_lo FROM pb JOIN rp USING (fp_hi, fp_lo) WHERE doc_id<>r
  UNION ALL SELECT x.r, y.r, distance, a_hi, a_lo, b_hi, b_lo FROM nr JOIN rp x ON x.fp_hi=a_hi AND x.fp_lo=a_lo JOIN rp y ON y.fp_hi=b_hi AND y.fp_lo=b_lo WHERE x.r<>y.r),
lk AS (SELECT least(x,y) AS a, greatest(x,y) AS b, min(distance)::INT AS distance, count(*)::BIGINT AS n_probe_pairs FROM al GROUP BY ALL)"""


@query("j09_least_probe_distance", PROBES + _LINKS + " SELECT * FROM lk")
def j09p(spark, sf):
    """Least distance over the lines of linked documents."""
    return P.least_distances(probes(spark, sf), "doc_id")


@query("j13_probe_components", PROBES.replace("WITH ", "WITH RECURSIVE ", 1) + _LINKS + ", e2 AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), rc(node, other) AS (SELECT DISTINCT a, a FROM e2 UNION SELECT rc.node, e2.b FROM rc JOIN e2 ON e2.a=rc.other) SELECT node, min(other) AS component FROM rc GROUP BY ALL")
def j13p(spark, sf):
    """Components of documents linked by any line."""
    return U.components(P.probe_links(probes(spark, sf), "doc_id"))


# Candidates: a shared content, a run's probe, or the whole sequence; each group's members against its first.
_CAND = """ww AS (SELECT seq, md5(string_agg(digest, '|' ORDER BY i)) AS probe FROM fr GROUP BY seq), ap AS (SELECT seq, probe FROM pb UNION SELECT seq, digest FROM fr UNION SELECT seq, probe FROM ww),
st AS (SELECT DISTINCT r.a, f.seq AS b FROM (SELECT probe, min(seq) AS a FROM ap GROUP BY probe HAVING count(*)>1) r JOIN ap f USING (probe) WHERE f.seq<>r.a),"""
_HEAD, _TAIL = _SEQ[:_SEQ.index("st AS (")], _SEQ[_SEQ.index("mt AS ("):]


@query("j12_runs_of_any_content", _HEAD + _CAND + _TAIL + " SELECT a, b, run::BIGINT AS run, start_a::INT AS start_a, start_b::INT AS start_b, dc::BIGINT AS distinct_contents, n_shared::BIGINT AS n_shared, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, CASE WHEN ex THEN 'full_sequence_identical' WHEN tm THEN 'aligned_byte_run' ELSE 'isolated_shared_bytes' END AS relation, (tm OR (ex AND dc>=3)) AS leakage_candidate FROM lr")
def j12a(spark, sf):
    """Longest common run of documents that share any line, by binary search over hashed windows."""
    f = frames(spark, sf)
    return P.compare_runs(P.sequence_candidates(f), f)


@query("j12_identical_sequences", _HEAD.rstrip().rstrip(",") + ", w AS (SELECT seq, string_agg(digest, '|' ORDER BY i) AS s, count(*) AS n, count(DISTINCT digest) AS d FROM fr GROUP BY seq) SELECT md5(s) AS sequence, count(*)::BIGINT AS n_members, min(seq) AS representative, max(n)::INT AS length, max(d)::INT AS n_contents, (count(*)*(count(*)-1)//2)::BIGINT AS n_pairs FROM w GROUP BY s HAVING count(*)>1")
def j12s(spark, sf):
    """Groups of identical sequences, also of one or two contents."""
    return P.content_groups(frames(spark, sf))


N_PAIRS = 2000
_PLACE = "row_number() OVER (PARTITION BY source ORDER BY md5('{s}|'||doc_id), doc_id)-1"
_BITS = "('0x'||substr(md5('{s}|'||d||'|{k}'),1,15))::BIGINT"
_SAMPLE = PRINTS + f""", pw AS (SELECT doc_id, source, fp_hi, fp_lo, {_PLACE.format(s='j17w')} AS r FROM fp), cs AS (SELECT source, count(*) AS m, count(*)*(count(*)-1)//2 AS p FROM fp GROUP BY source HAVING count(*)>1),
cu AS (SELECT *, sum(p) OVER (ORDER BY md5(source))::BIGINT AS upto FROM cs), tt AS (SELECT sum(p)::BIGINT AS w FROM cs),
nu AS (SELECT number, min(o) AS o FROM (SELECT {_BITS.format(s='j17w', k=0)} % w AS number, lpad(d::VARCHAR, 12, '0') AS o FROM tt, range(0, {2 * N_PAIRS}) q(d) WHERE w > {N_PAIRS} UNION ALL SELECT d, md5('j17w|'||d) FROM tt, range(0, {N_PAIRS}+1) q(d) WHERE w <= {N_PAIRS} AND d < w) GROUP BY number ORDER BY o, number LIMIT {N_PAIRS // 2}),
hq AS (SELECT source, number-(upto-p) AS q FROM nu JOIN cu ON number>=upto-p AND number<upto), hw AS (SELECT x.source, x.doc_id AS a, y.doc_id AS b FROM hq JOIN pw y ON y.source=hq.source AND y.r*(y.r-1)//2<=q AND (y.r+1)*y.r//2>q JOIN pw x ON x.source=hq.source AND x.r=q-y.r*(y.r-1)//2),
px AS (SELECT doc_id, source, {_PLACE.format(s='j17x')} AS r FROM fp), cx AS (SELECT source, m, row_number() OVER (ORDER BY md5('j17x|'||source), source)-1 AS c FROM (SELECT source, count(*) AS m FROM fp GROUP BY ALL)), nc AS (SELECT count(*) AS n FROM cx),
dx AS (SELECT d, {_BITS.format(s='j17x', k=0)} % n AS c1, {_BITS.format(s='j17x', k=1)} % (n-1) AS o, {_BITS.format(s='j17x', k=2)} AS h1, {_BITS.format(s='j17x', k=3)} AS h2 FROM nc, range(0, 20*({N_PAIRS}-(SELECT count(*) FROM hw))) q(d) WHERE n>1),
hx AS (SELECT least(p.doc_id, q.doc_id) AS a, greatest(p.doc_id, q.doc_id) AS b, min(d) AS d FROM dx JOIN cx k1 ON k1.c=c1 JOIN cx k2 ON k2.c=o+(o>=c1)::INT JOIN px p ON p.source=k1.source AND p.r=h1%k1.m JOIN px q ON q.source=k2.source AND q.r=h2%k2.m GROUP BY ALL ORDER BY d LIMIT {N_PAIRS}-(SELECT count(*) FROM hw)),
sp AS (SELECT 'within' AS kind, least(a,b) AS a, greatest(a,b) AS b FROM hw UNION ALL SELECT 'cross', a, b FROM hx)"""


def seeded_pairs(spark, sf):
    return stage(spark, sf, "seeded_pairs", lambda: P.sample_pairs(prints(spark, sf).select("doc_id", "source"), "doc_id", "source", N_PAIRS, "j17"))


@query("j17_seeded_pairs", _SAMPLE + " SELECT kind, a, b FROM sp")
def j17s(spark, sf):
    """Distinct pairs inside sources and across, drawn by number from all there are."""
    return seeded_pairs(spark, sf)


@query("j17_seeded_distances", _SAMPLE + ", dd AS (SELECT kind, (bit_count(xor(x.fp_hi,y.fp_hi))+bit_count(xor(x.fp_lo,y.fp_lo)))::DOUBLE AS d FROM sp JOIN fp x ON x.doc_id=a JOIN fp y ON y.doc_id=b) SELECT kind, count(*)::BIGINT AS n, min(d)::INT AS min, round(quantile_cont(d,0.25),6) AS q25, round(quantile_cont(d,0.5),6) AS median, round(quantile_cont(d,0.75),6) AS q75, max(d)::INT AS max FROM dd GROUP BY ALL")
def j17d(spark, sf):
    """Distances of fingerprints of the sampled pairs, inside sources and across."""
    s = seeded_pairs(spark, sf)
    for side in ("a", "b"):
        s = s.join(prints(spark, sf).select(F.col("doc_id").alias(side), F.col("fp_hi").alias(f"hi_{side}"), F.col("fp_lo").alias(f"lo_{side}")), side)
    d = U.distance(F.col("hi_a"), F.col("lo_a"), F.col("hi_b"), F.col("lo_b")).cast("int")
    s = s.select("kind", d.alias("d"))
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("min"), *[r6(F.percentile("d", F.lit(q))).alias(n) for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))], F.max("d").alias("max"))

"""Cross-track agreement, duplicates and the leakage graph (survey section 2.J)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast.functions.exprs import r6
from holdfast.operators import agreement as A
from holdfast.operators import duplicates as U
from holdfast.operators import inference as G
from holdfast.operators.near import near_counts, near_values
from holdfast.operators.ranking import hash_rank, hot_join
from holdfast.plans.common import N_BOOT, SEED, clips
from holdfast.plans.oracle import grid, u, with_base
from holdfast.plans.queries_g import TAIL
from holdfast.plans.registry import query
from holdfast.plans.stages import stage
from holdfast.session import cut
from holdfast.sources import derive as D

# ------------------------------------------------------------------ tracks
# Track a is the test split; track b is the development split without some systems.
_B_GONE = ["commit__msp0p8__prefix__gru64__seed13", "commit__msp0p8__prefix__gru64__seed12", "clip__mean__seed13"]
_GONE = ", ".join(f"'{s}'" for s in _B_GONE)
_FAM = "regexp_replace(system_id,'__seed[0-9]+','')"
TRACKS = with_base(grid(3.0), grid(3.0, "dev", "v")) + f""", ta AS (SELECT system_id, {_FAM} AS family_key, regexp_extract(system_id,'seed([0-9]+)',1) AS seed, video_id, source_cluster_id, y, delay/3.0 AS value FROM gc),
tb AS (SELECT system_id, {_FAM} AS family_key, regexp_extract(system_id,'seed([0-9]+)',1) AS seed, video_id, source_cluster_id, y, delay/3.0 AS value FROM vc WHERE system_id NOT IN ({_GONE}))"""


def track(spark, sf, name):
    c = clips(spark, sf, 3.0, "test" if name == "a" else "dev")
    if name == "b":
        c = c.filter(~F.col("system_id").isin(_B_GONE))
    return c.select("system_id", F.regexp_replace("system_id", r"__seed\d+", "").alias("family_key"), F.regexp_extract("system_id", r"seed(\d+)", 1).alias("seed"),
                    "video_id", "source_cluster_id", "class_code", (F.col("delay") / 3.0).alias("value"))


def cards(t):
    return t.select("system_id", "family_key", "seed").distinct()


@query("j01_family_match", TRACKS + ", fa AS (SELECT family_key, count(DISTINCT system_id)::BIGINT AS n_systems_a, count(DISTINCT seed)::BIGINT AS n_seeds_a FROM ta GROUP BY ALL), fb AS (SELECT family_key, count(DISTINCT system_id)::BIGINT AS n_systems_b, count(DISTINCT seed)::BIGINT AS n_seeds_b FROM tb GROUP BY ALL) SELECT family_key, n_systems_a, n_seeds_a, n_systems_b, n_seeds_b, CASE WHEN n_systems_b IS NULL THEN 'only_a' WHEN n_systems_a IS NULL THEN 'only_b' WHEN n_seeds_a>=2 AND n_seeds_b>=2 THEN 'matched' ELSE 'underpowered' END AS status FROM fa FULL JOIN fb USING (family_key)")
def j01(spark, sf):
    return A.match_families(cards(track(spark, sf, "a")), cards(track(spark, sf, "b")), 2)


@query("j02_track_validation", TRACKS + " SELECT 'duplicate_observation' AS rule, (SELECT count(*) FROM (SELECT 1 FROM tb GROUP BY system_id, video_id HAVING count(*)>1))::BIGINT AS n UNION ALL SELECT 'uneven_cohort', (SELECT count(*) FROM (SELECT video_id FROM tb GROUP BY video_id HAVING count(DISTINCT system_id)<>(SELECT count(DISTINCT system_id) FROM tb)))::BIGINT UNION ALL SELECT 'inconsistent_clip', (SELECT count(*) FROM (SELECT video_id FROM tb GROUP BY video_id HAVING count(DISTINCT source_cluster_id)>1 OR count(DISTINCT y)>1))::BIGINT UNION ALL SELECT 'value_outside', (SELECT count(*) FROM tb WHERE value IS NULL OR value NOT BETWEEN 0 AND 1)::BIGINT")
def j02(spark, sf):
    return A.validate_track(track(spark, sf, "b"))


def family_readings(spark, sf, name):
    """Per family pair: point difference and its replicates' interval and spread; kept as a stage, as a query reads a track up to twice."""
    def build():
        t = track(spark, sf, name)
        point = A.family_differences(t.groupBy("family_key", "seed").agg(F.avg("value").alias("value")), [])
        w = G.packed_draws(t.select("source_cluster_id"), N_BOOT, f"{SEED}{name}")
        sums = t.groupBy("family_key", "seed", "source_cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
        reps = G.replicate_sums(sums, w, ["family_key", "seed"], ["n", "s"]).select("family_key", "seed", "b", (F.col("s") / F.col("n")).alias("value"))
        d = A.family_differences(reps, ["b"]).withColumnRenamed("diff", "value")
        se = d.groupBy("family_a", "family_b").agg(F.stddev_samp("value").alias("se"))
        iv = G.percentile_interval(d, ["family_a", "family_b"], floor=0.0)
        return point.join(iv, ["family_a", "family_b"]).join(se, ["family_a", "family_b"])
    return stage(spark, sf, f"readings_{name}", build)


def readings_sql(t, k):
    return f"""{t}x AS (SELECT source_cluster_id, row_number() OVER (ORDER BY md5(source_cluster_id), source_cluster_id)-1 AS i FROM (SELECT DISTINCT source_cluster_id FROM {t})), {t}k AS (SELECT count(*) AS k FROM {t}x),
{t}w AS (SELECT b, source_cluster_id, w FROM (SELECT b, floor({u(f"'boot{SEED}{k}|'||b||'|'||s")}*k)::BIGINT AS i, count(*) AS w FROM {t}k, range(0,{N_BOOT}) q(b), range(0,(SELECT k FROM {t}k)) r(s) GROUP BY ALL) JOIN {t}x USING (i)),
{t}p AS (SELECT family_key, seed, avg(value) AS v FROM {t} GROUP BY ALL), {t}s AS (SELECT family_key, seed, source_cluster_id, count(*) AS n, sum(value) AS s FROM {t} GROUP BY ALL), {t}r AS (SELECT family_key, seed, b, sum(w*s)/sum(w*n) AS v FROM {t}s JOIN {t}w USING (source_cluster_id) GROUP BY ALL),
{t}d AS (SELECT a.family_key AS family_a, b.family_key AS family_b, a.b, median(a.v-b.v) AS d FROM {t}r a JOIN {t}r b ON a.b=b.b AND a.seed=b.seed AND a.family_key<b.family_key GROUP BY ALL),
{t}f AS (SELECT a.family_key AS family_a, b.family_key AS family_b, median(a.v-b.v) AS diff, count(*)::BIGINT AS n_seeds FROM {t}p a JOIN {t}p b ON a.seed=b.seed AND a.family_key<b.family_key GROUP BY ALL),
{t}o AS (SELECT {t}f.*, lo AS ci_lo, hi AS ci_hi FROM {t}f JOIN (SELECT family_a, family_b, quantile_cont(d,0.025) AS lo, quantile_cont(d,0.975) AS hi FROM {t}d GROUP BY ALL) USING (family_a, family_b))"""


@query("j03_family_differences", TRACKS + ", " + readings_sql("ta", "a") + " SELECT family_a, family_b, n_seeds, round(diff,6) AS diff, round(ci_lo,6) AS ci_lo, round(ci_hi,6) AS ci_hi FROM tao")
def j03(spark, sf):
    r = family_readings(spark, sf, "a")
    return r.select("family_a", "family_b", "n_seeds", *[r6(c).alias(c) for c in ("diff", "ci_lo", "ci_hi")])


def compared(selected, b):
    r = b.select("family_a", "family_b", F.col("diff").alias("diff_b"), F.col("ci_lo").alias("lo_b"), F.col("ci_hi").alias("hi_b"), F.col("n_seeds").alias("seeds_b")).filter("seeds_b >= 2")
    j = selected.join(r, ["family_a", "family_b"], "left")
    return j.withColumn("outcome", A.outcome(F.col("diff"), F.col("diff_b"), F.col("lo_b"), F.col("hi_b")))


_CHOSEN = TRACKS + ", " + readings_sql("ta", "a") + ", " + readings_sql("tb", "b") + """, jp AS (SELECT f.*, CASE WHEN se>0 THEN """ + TAIL.format(z="abs(diff)/se") + """ WHEN abs(diff)>0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS p FROM tao f JOIN (SELECT family_a, family_b, stddev_samp(d) AS se FROM tad GROUP BY ALL) USING (family_a, family_b) WHERE n_seeds>=2),
jr AS (SELECT *, row_number() OVER (ORDER BY p, family_a, family_b) AS r, count(*) OVER () AS m FROM jp), jh AS (SELECT *, least(1.0::DOUBLE, max((m-r+1)*p) OVER (ORDER BY r)) AS p_adjusted FROM jr),
jb AS (SELECT * FROM tbo WHERE n_seeds>=2), ju AS (SELECT median(abs(diff)) AS ruler FROM jb WHERE ci_lo<=0 AND ci_hi>=0),
jo AS (SELECT a.family_a, a.family_b, a.diff, a.p_adjusted, b.diff AS diff_b, b.ci_lo AS lo_b, b.ci_hi AS hi_b, ruler, CASE WHEN a.diff=0 OR b.diff IS NULL THEN 'uncertain' WHEN b.diff=0 OR (b.ci_lo<=0 AND b.ci_hi>=0) THEN 'tie' WHEN (a.diff>0)=(b.diff>0) THEN 'agree' ELSE 'reverse' END AS outcome
 FROM jh a LEFT JOIN jb b USING (family_a, family_b), ju WHERE p_adjusted<=0.05 AND a.ci_lo*a.ci_hi>0)"""


def chosen_pairs(spark, sf):
    """Pairs chosen on track a alone by corrected normal p and an interval clear of zero."""
    from holdfast.functions.tails import normal_two_sided
    a = family_readings(spark, sf, "a").filter("n_seeds >= 2")
    flat = F.when(F.abs("diff") > 0, 0.0).otherwise(1.0)
    a = a.withColumn("p", F.when(F.col("se") > 0, normal_two_sided(F.abs("diff") / F.col("se"))).otherwise(flat)).withColumn("k", F.lit(1))
    return G.holm(a, ["k"], "p", order=["family_a", "family_b"]).filter(F.col("reject") & (F.col("ci_lo") * F.col("ci_hi") > 0))


@query("j04_direction_outcome", _CHOSEN + " SELECT family_a, family_b, round(diff,6) AS diff, round(p_adjusted,4) AS p_adjusted, round(diff_b,6) AS diff_b, round(lo_b,6) AS lo_b, round(hi_b,6) AS hi_b, outcome FROM jo")
def j04(spark, sf):
    """Pairs chosen on track a alone, then read on track b."""
    c = compared(chosen_pairs(spark, sf), family_readings(spark, sf, "b"))
    return c.select("family_a", "family_b", r6("diff").alias("diff"), F.round("p_adjusted", 4).alias("p_adjusted"), *[r6(x).alias(x) for x in ("diff_b", "lo_b", "hi_b")], "outcome")


@query("j04_resolvable_outcome", _CHOSEN + " SELECT family_a, family_b, round(diff_b,6) AS diff_b, round(ruler,6) AS ruler_b, CASE WHEN outcome IN ('agree','reverse') AND abs(diff_b)<ruler THEN 'tie' ELSE outcome END AS outcome FROM jo")
def j04r(spark, sf):
    """The same, where a difference below what track b resolves is a tie."""
    b = family_readings(spark, sf, "b")
    c = compared(chosen_pairs(spark, sf), b).withColumn("ruler_b", A.track_ruler(b.filter("n_seeds >= 2")))
    o = A.outcome(F.col("diff"), F.col("diff_b"), F.col("lo_b"), F.col("hi_b"), F.col("ruler_b"))
    return c.select("family_a", "family_b", r6("diff_b").alias("diff_b"), r6("ruler_b").alias("ruler_b"), o.alias("outcome"))


_OUT = TRACKS + ", " + readings_sql("ta", "a") + ", " + readings_sql("tb", "b") + """, oc AS (SELECT a.family_a, a.family_b, a.diff, b.diff AS diff_b, CASE WHEN a.diff=0 OR b.diff IS NULL THEN 'uncertain' WHEN b.diff=0 OR (b.ci_lo<=0 AND b.ci_hi>=0) THEN 'tie' WHEN (a.diff>0)=(b.diff>0) THEN 'agree' ELSE 'reverse' END AS outcome
 FROM tao a LEFT JOIN (SELECT * FROM tbo WHERE n_seeds>=2) b USING (family_a, family_b) WHERE a.ci_lo*a.ci_hi>0)"""


def outcomes(spark, sf):
    """Outcomes of the pairs whose interval on track a is clear of zero."""
    a = family_readings(spark, sf, "a").filter(F.col("ci_lo") * F.col("ci_hi") > 0)
    return compared(a, family_readings(spark, sf, "b"))


@query("j05_agreement_rates", _OUT + " SELECT count(*)::BIGINT AS n_selected, sum((outcome='agree')::INT)::BIGINT AS n_agree, sum((outcome='reverse')::INT)::BIGINT AS n_reverse, sum((outcome='tie')::INT)::BIGINT AS n_tie, sum((outcome='uncertain')::INT)::BIGINT AS n_uncertain, round(sum((outcome='agree')::INT)::DOUBLE/nullif(sum((outcome<>'uncertain')::INT),0),6) AS primary_rate, round(sum((outcome='agree')::INT)::DOUBLE/nullif(sum((outcome IN ('agree','reverse'))::INT),0),6) AS secondary_rate, round(sum((outcome<>'uncertain')::INT)::DOUBLE/count(*),6) AS coverage FROM oc")
def j05(spark, sf):
    r = A.agreement_rates(outcomes(spark, sf))
    return r.select(*[r6(c).alias(c) if c in ("primary_rate", "secondary_rate", "coverage") else F.col(c) for c in r.columns])


_WF = u("'fam|'||b||'|'||{f}")


@query("g20_family_weight_interval", _OUT + f", fw AS (SELECT b, outcome, (-ln({_WF.replace('{f}', 'family_a')}+1.0::DOUBLE/4294967296.0::DOUBLE))*(-ln({_WF.replace('{f}', 'family_b')}+1.0::DOUBLE/4294967296.0::DOUBLE)) AS w FROM oc, range(0,{N_BOOT}) q(b) WHERE outcome<>'uncertain'), fr AS (SELECT b, sum(CASE WHEN outcome='agree' THEN w ELSE 0 END)/sum(w) AS v FROM fw GROUP BY ALL) SELECT round(quantile_cont(v,0.025),6) AS ci_lo, round(quantile_cont(v,0.975),6) AS ci_hi, count(v)::BIGINT AS n_boot FROM fr")
def g20(spark, sf):
    r = A.family_weight_rates(outcomes(spark, sf), N_BOOT, "fam").withColumn("k", F.lit(1))
    return G.percentile_interval(r, ["k"], floor=0.0).select(r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"), F.col("n_valid").alias("n_boot"))


@query("j06_evaluability", _OUT + ", m AS (SELECT (SELECT count(*) FROM (SELECT family_key FROM ta GROUP BY family_key HAVING count(DISTINCT seed)>=2) JOIN (SELECT family_key FROM tb GROUP BY family_key HAVING count(DISTINCT seed)>=2) USING (family_key)) AS f, (SELECT count(*) FROM oc) AS s, (SELECT count(DISTINCT source_cluster_id) FROM tb) AS k, (SELECT count(DISTINCT y) FROM tb) AS c, (SELECT min(n) FROM (SELECT count(DISTINCT video_id) AS n FROM tb GROUP BY y)) AS v) SELECT f::BIGINT AS n_families, s::BIGINT AS n_pairs, k::BIGINT AS n_clusters, concat_ws(',', CASE WHEN f<3 THEN 'min_matched_families' END, CASE WHEN s<4 THEN 'min_selected_pairs' END, CASE WHEN k<20 THEN 'min_clusters_track_b' END, CASE WHEN c<5 THEN 'min_populated_classes_track_b' END, CASE WHEN v<30 THEN 'min_videos_per_class_track_b' END) AS unmet, NOT (f<3 OR s<4 OR k<20 OR c<5 OR v<30) AS evaluable FROM m")
def j06(spark, sf):
    """Preconditions that are not met are listed; a verdict is possible only when there are none."""
    f = A.match_families(cards(track(spark, sf, "a")), cards(track(spark, sf, "b")), 2).agg(F.sum((F.col("status") == "matched").cast("bigint")).alias("n_families"))
    s = outcomes(spark, sf).agg(F.count(F.lit(1))).scalar()
    b = track(spark, sf, "b")
    k = b.select("source_cluster_id").distinct().agg(F.count(F.lit(1))).scalar()
    c = b.select("class_code", "video_id").distinct().groupBy("class_code").agg(F.count(F.lit(1)).alias("n"))
    c = c.agg(F.struct(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("least"))).scalar()
    j = f.withColumn("n_pairs", s).withColumn("n_clusters", k).withColumn("_c", c).select("*", "_c.*").drop("_c")
    unmet = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in (
        ("min_matched_families", F.col("n_families") < 3), ("min_selected_pairs", F.col("n_pairs") < 4), ("min_clusters_track_b", F.col("n_clusters") < 20),
        ("min_populated_classes_track_b", F.col("n_classes") < 5), ("min_videos_per_class_track_b", F.col("least") < 30))]))
    return j.select("n_families", "n_pairs", "n_clusters", F.array_join(unmet, ",").alias("unmet"), (F.size(unmet) == 0).alias("evaluable"))


# ------------------------------------------------------------------ duplicates
_VOTE = ", ".join([f"sum(((h>>{k})&1)*2-1) AS h{k}" for k in range(32)] + [f"sum(((l>>{k})&1)*2-1) AS l{k}" for k in range(32)])
_WORD = {c: "+".join(f"(CASE WHEN {c}{k}>0 THEN {1 << k} ELSE 0 END)::BIGINT" for k in range(32)) for c in ("h", "l")}
PRINTS = f"""WITH tk AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS t FROM documents), th AS (SELECT doc_id, ('0x'||substr(md5(t),1,8))::BIGINT AS h, ('0x'||substr(md5(t),9,8))::BIGINT AS l FROM tk WHERE t<>''),
vt AS (SELECT doc_id, {_VOTE} FROM th GROUP BY doc_id), fp AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, md5(d.text) AS digest, {_WORD['h']} AS fp_hi, {_WORD['l']} AS fp_lo FROM documents d JOIN vt USING (doc_id))"""


def prints(spark, sf):
    """Digest and fingerprint of every whole document, kept as a stage."""
    def build():
        d = D.table(spark, sf, "documents")
        return d.select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("digest")).join(U.token_fingerprint(d, "doc_id", "text"), "doc_id")
    return stage(spark, sf, "prints", build)


@query("j07_identical_content", "SELECT md5(text) AS digest, count(*)::BIGINT AS n_members, min(doc_id) AS representative, (count(*)*(count(*)-1)//2)::BIGINT AS n_pairs FROM documents GROUP BY ALL HAVING count(*)>1")
def j07(spark, sf):
    return U.identical_groups(prints(spark, sf), "doc_id", ["digest"])


@query("j08_same_fingerprint", PRINTS + ", g AS (SELECT fp_hi, fp_lo, digest, count(*) AS n, min(doc_id) AS m FROM fp GROUP BY ALL) SELECT fp_hi, fp_lo, count(*)::BIGINT AS n_contents, sum(n)::BIGINT AS n_members, min(m) AS representative, (sum(n)*(sum(n)-1)//2 - sum(n*(n-1)//2))::BIGINT AS n_pairs FROM g GROUP BY ALL HAVING count(*)>1")
def j08(spark, sf):
    return U.same_fingerprint(prints(spark, sf), "doc_id", "digest")


_NEAR = ", ds AS (SELECT DISTINCT fp_hi, fp_lo FROM fp), nr AS (SELECT a.fp_hi AS a_hi, a.fp_lo AS a_lo, b.fp_hi AS b_hi, b.fp_lo AS b_lo, (bit_count(xor(a.fp_hi,b.fp_hi))+bit_count(xor(a.fp_lo,b.fp_lo)))::INT AS distance FROM ds a JOIN ds b ON (a.fp_hi<b.fp_hi OR (a.fp_hi=b.fp_hi AND a.fp_lo<b.fp_lo)) WHERE bit_count(xor(a.fp_hi,b.fp_hi))+bit_count(xor(a.fp_lo,b.fp_lo))<=8)"


def near(spark, sf):
    """Their number grows with the square of the documents, so the pairs are not kept: other readings have counts or forests made in the tasks."""
    return U.near_fingerprints(prints(spark, sf))


@query("j09_near_fingerprints", PRINTS + _NEAR + " SELECT * FROM nr")
def j09(spark, sf):
    """Every pair of distinct fingerprints within eight bits."""
    return near(spark, sf)


@query("j09_pairs_by_threshold", PRINTS + _NEAR + ", sz AS (SELECT fp_hi, fp_lo, count(*) AS n FROM fp GROUP BY ALL), al AS (SELECT distance AS d, x.n*y.n AS k FROM nr JOIN sz x ON x.fp_hi=a_hi AND x.fp_lo=a_lo JOIN sz y ON y.fp_hi=b_hi AND y.fp_lo=b_lo UNION ALL SELECT 0, n*(n-1)//2 FROM sz) SELECT t::INT AS threshold, sum(CASE WHEN d<=t THEN k ELSE 0 END)::BIGINT AS n_pairs FROM al, (VALUES (0),(4),(8)) q(t) GROUP BY ALL")
def j09t(spark, sf):
    """Document pairs per threshold, from the sizes of the fingerprint groups."""
    size = prints(spark, sf).groupBy("fp_hi", "fp_lo").agg(F.count(F.lit(1)).alias("n"))
    tally = near_counts(size.withColumnRenamed("n", "val"), U.NEAR).unionByName(size.agg(F.sum(U.pair_count(F.col("n"))).alias("k")).withColumn("distance", F.lit(0)))
    t = tally.withColumn("threshold", F.explode(F.array(F.lit(0), F.lit(4), F.lit(8))))
    return t.groupBy("threshold").agg(F.sum(F.when(F.col("distance") <= F.col("threshold"), F.col("k")).otherwise(0)).alias("n_pairs"))


_LED = ", dup AS (SELECT digest FROM fp GROUP BY digest HAVING count(*)>1), lg AS (SELECT fp.doc_id, concat_ws(',', CASE WHEN lb.doc_id IS NULL THEN 'not_labelled' END, CASE WHEN lb.quality=0 THEN 'low_quality' END, CASE WHEN lb.toxic=1 THEN 'toxic' END, CASE WHEN fp.n_chars<20 THEN 'too_short' END, CASE WHEN dup.digest IS NOT NULL THEN 'shares_identical_content' END) AS reasons FROM fp LEFT JOIN labels lb USING (doc_id) LEFT JOIN dup USING (digest))"


def ledger(spark, sf):
    p = prints(spark, sf)
    labels = D.table(spark, sf, "labels").withColumn("has", F.lit(True))
    dup = U.identical_groups(p, "doc_id", ["digest"]).select("digest", F.lit(True).alias("dup"))
    j = hot_join(p.join(labels, "doc_id", "left"), dup, ["digest"], "left")
    rules = {"not_labelled": F.col("has").isNull(), "low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "too_short": F.col("n_chars") < 20, "shares_identical_content": F.col("dup").isNotNull()}
    return j.withColumn("why", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))


@query("j10_candidate_ledger", PRINTS + _LED + " SELECT doc_id, reasons, (reasons='') AS is_candidate FROM lg")
def j10(spark, sf):
    """Every named reason against a document; a candidate has none."""
    return ledger(spark, sf).select("doc_id", F.array_join("why", ",").alias("reasons"), (F.size("why") == 0).alias("is_candidate"))


@query("j10_exclusion_counts", PRINTS + _LED + ", rs AS (SELECT unnest(string_split(CASE WHEN reasons='' THEN 'candidate' ELSE reasons END, ',')) AS reason FROM lg) SELECT reason, count(*)::BIGINT AS n FROM rs GROUP BY ALL")
def j10c(spark, sf):
    why = F.when(F.size("why") == 0, F.array(F.lit("candidate"))).otherwise(F.col("why"))
    return ledger(spark, sf).select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("j11_cross_source_duplicates", "WITH g AS (SELECT md5(text) AS digest, source, count(*) AS n FROM documents GROUP BY ALL) SELECT digest, sum(n)::BIGINT AS n_members, count(*)::BIGINT AS n_sources, (sum(n)*(sum(n)-1)//2-sum(n*(n-1)//2))::BIGINT AS n_cross_pairs FROM g GROUP BY ALL HAVING count(*)>1")
def j11(spark, sf):
    return U.cross_source(prints(spark, sf), ["digest"], "source")


# Non-empty lines are the frames of a document; candidates share a probe with the first document of its group.
_SEQ = """WITH ln AS (SELECT doc_id AS seq, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
fr AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY p)-1 AS i, md5(t) AS digest FROM ln WHERE t<>''),
ch AS (SELECT *, CASE WHEN lag(digest) OVER w = digest THEN 0 ELSE 1 END AS f FROM fr WINDOW w AS (PARTITION BY seq ORDER BY i)), ci AS (SELECT *, sum(f) OVER (PARTITION BY seq ORDER BY i) AS isle FROM ch), ig AS (SELECT seq, isle, any_value(digest) AS y, count(*) AS n FROM ci GROUP BY ALL),
pb AS (SELECT seq, md5(x||'|'||y||'|'||n||'|'||z) AS probe FROM (SELECT *, lag(y) OVER w AS x, lead(y) OVER w AS z FROM ig WINDOW w AS (PARTITION BY seq ORDER BY isle)) WHERE x<>z),
st AS (SELECT DISTINCT r.a, f.seq AS b FROM (SELECT probe, min(seq) AS a FROM pb GROUP BY probe HAVING count(DISTINCT seq)>1) r JOIN pb f USING (probe) WHERE f.seq<>r.a),
mt AS (SELECT st.a, st.b, x.i AS ia, y.i AS ib, x.digest FROM st JOIN fr x ON x.seq=st.a JOIN fr y ON y.seq=st.b AND y.digest=x.digest),
mi AS (SELECT *, ia-row_number() OVER (PARTITION BY a, b, ia-ib ORDER BY ia) AS isle FROM mt), rn AS (SELECT a, b, ia-ib AS d, isle, count(*) AS run, min(ia) AS start_a, min(ib) AS start_b, count(DISTINCT digest) AS dc FROM mi GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY run DESC, start_a, start_b) AS k FROM rn), sh AS (SELECT a, b, count(DISTINCT digest) AS n_shared FROM mt GROUP BY ALL), sz AS (SELECT seq, count(*) AS n FROM fr GROUP BY ALL),
lr AS (SELECT bs.a, bs.b, run, start_a, start_b, dc, n_shared, p.n AS n_a, q.n AS n_b, (run=p.n AND run=q.n) AS ex, (run>=3 AND dc>=3) AS tm FROM bs JOIN sh ON sh.a=bs.a AND sh.b=bs.b JOIN sz p ON p.seq=bs.a JOIN sz q ON q.seq=bs.b WHERE k=1)"""


def frames(spark, sf):
    d = D.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.posexplode(F.split("text", "\n")).alias("p", "t")).filter("t <> ''")
    return d.select("seq", (F.row_number().over(Window.partitionBy("seq").orderBy("p")) - 1).alias("i"), F.md5("t").alias("digest"))


def shared_sequences(spark, sf):
    f = frames(spark, sf)
    return f, U.star_edges(U.run_probes(f), "seq", ["probe"])


@query("j12_longest_equal_run", _SEQ + " SELECT a, b, run::BIGINT AS run, start_a::INT AS start_a, start_b::INT AS start_b, dc::BIGINT AS distinct_contents, n_shared::BIGINT AS n_shared, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, CASE WHEN ex THEN 'full_sequence_identical' WHEN tm THEN 'aligned_byte_run' ELSE 'isolated_shared_bytes' END AS relation, (tm OR (ex AND dc>=3)) AS leakage_candidate FROM lr")
def j12(spark, sf):
    f, e = shared_sequences(spark, sf)
    return U.longest_equal_run(e, f)


# Graph: identical contents to their representative, near fingerprints through their representatives.
_GRAPH = PRINTS.replace("WITH ", "WITH RECURSIVE ", 1) + _NEAR + """, rp AS (SELECT fp_hi, fp_lo, min(doc_id) AS r FROM fp GROUP BY ALL),
eg AS (SELECT r AS a, doc_id AS b FROM fp JOIN rp USING (fp_hi, fp_lo) WHERE doc_id<>r UNION SELECT x.r, y.r FROM nr JOIN rp x ON x.fp_hi=a_hi AND x.fp_lo=a_lo JOIN rp y ON y.fp_hi=b_hi AND y.fp_lo=b_lo),
e2 AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg), rc(node, other) AS (SELECT DISTINCT a, a FROM e2 UNION SELECT rc.node, e2.b FROM rc JOIN e2 ON e2.a=rc.other), cc AS (SELECT node, min(other) AS component FROM rc GROUP BY ALL)"""


def graph(spark, sf):
    """Components of the duplicate graph, kept as a stage."""
    return stage(spark, sf, "components", lambda: U.components(U.near_links(prints(spark, sf), "doc_id")))


@query("j13_components", _GRAPH + " SELECT node, component FROM cc")
def j13(spark, sf):
    return graph(spark, sf)


_SPLIT = u("'split|'||source")
_MEM = f", mb AS (SELECT cc.node, cc.component, d.source, d.lang, lb.quality, lb.toxic, CASE WHEN {_SPLIT}<0.3 THEN 'dev' WHEN {_SPLIT}<0.9 THEN 'test' ELSE 'unassigned' END AS split FROM cc JOIN documents d ON d.doc_id=cc.node LEFT JOIN labels lb ON lb.doc_id=cc.node)"


def members(spark, sf):
    from holdfast.functions.exprs import uniform
    v = uniform(F.concat(F.lit("split|"), F.col("source")))
    d = prints(spark, sf).select(F.col("doc_id").alias("node"), "source", "lang", F.when(v < 0.3, "dev").when(v < 0.9, "test").otherwise("unassigned").alias("split"))
    return graph(spark, sf).join(d, "node").join(D.table(spark, sf, "labels").withColumnRenamed("doc_id", "node"), "node", "left")


def _conf(f):
    return f"(coalesce(min({f})<>max({f}),false) OR (count({f})>0 AND count({f})<count(*)))"


@query("j14_content_components", _GRAPH + _MEM + f", ag AS (SELECT component, count(*) AS n, bit_xor(('0x'||substr(md5(node::VARCHAR),1,8))::BIGINT) AS x, (min(split)<>max(split)) AS many, concat_ws(',', CASE WHEN {_conf('lang')} THEN 'lang' END, CASE WHEN {_conf('quality')} THEN 'quality' END, CASE WHEN {_conf('toxic')} THEN 'toxic' END) AS conflicts FROM mb GROUP BY ALL HAVING count(*)>1) SELECT 'content_'||substr(sha256(component||'|'||n||'|'||x),1,16) AS content_id, component, n::BIGINT AS n_members, many AS several_splits, conflicts, CASE WHEN many OR conflicts<>'' THEN 'quarantine_pending_review' ELSE 'deduplicate_or_keep_in_same_partition' END AS action FROM ag")
def j14(spark, sf):
    return U.content_components(members(spark, sf), ["lang", "quality", "toxic"], "split")


@query("j15_assignment_check", _GRAPH + _MEM + ", pl AS (SELECT component, CASE WHEN split NOT IN ('unassigned','excluded') THEN split END AS s, split FROM mb) SELECT component, count(*)::BIGINT AS n_members, coalesce(min(s)<>max(s),false) AS violation, (max((split='unassigned')::INT)=1) AS unresolved FROM pl GROUP BY ALL")
def j15(spark, sf):
    return U.check_assignments(members(spark, sf), "split")


@query("j16_guard_components", _GRAPH + _MEM + ", gq AS (SELECT component, (min(split)<>max(split) OR min(source)<>max(source)) AS q FROM mb GROUP BY ALL), gm AS (SELECT lang, q, n_chars FROM mb JOIN gq USING (component) JOIN (SELECT doc_id AS node, n_chars FROM documents) USING (node)) SELECT lang, w::INT AS min_chars, count(*)::BIGINT AS n_members, sum((NOT q)::INT)::BIGINT AS n_kept, sum((NOT q AND n_chars>=w)::INT)::BIGINT AS n_eligible FROM gm, (VALUES (50),(500),(2000)) v(w) GROUP BY ALL")
def j16(spark, sf):
    """Quarantine first, then what each length window leaves, by language."""
    m = U.guard_components(members(spark, sf), "split", "source").join(prints(spark, sf).select(F.col("doc_id").alias("node"), "n_chars"), "node")
    m = m.withColumn("min_chars", F.explode(F.array(F.lit(50), F.lit(500), F.lit(2000))))
    kept = ~F.col("quarantined")
    return m.groupBy("lang", "min_chars").agg(F.count(F.lit(1)).alias("n_members"), F.sum(kept.cast("bigint")).alias("n_kept"), F.sum((kept & (F.col("n_chars") >= F.col("min_chars"))).cast("bigint")).alias("n_eligible"))


_RING = PRINTS + ", rw AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('within|'||doc_id), doc_id) AS r FROM fp), rx AS (SELECT *, row_number() OVER (ORDER BY md5('cross|'||doc_id), doc_id) AS r FROM fp), pr AS (SELECT 'within' AS kind, bit_count(xor(a.fp_hi,b.fp_hi))+bit_count(xor(a.fp_lo,b.fp_lo)) AS d FROM rw a JOIN rw b ON a.source=b.source AND b.r=a.r+1 UNION ALL SELECT 'cross', bit_count(xor(a.fp_hi,b.fp_hi))+bit_count(xor(a.fp_lo,b.fp_lo)) FROM rx a JOIN rx b ON b.r=a.r+1 WHERE a.source<>b.source)"


@query("j17_pair_sampling", _RING + " SELECT kind, count(*)::BIGINT AS n, round(avg(d),6) AS mean, round(quantile_cont(d::DOUBLE,0.05),6) AS q05, round(quantile_cont(d::DOUBLE,0.5),6) AS median, round(quantile_cont(d::DOUBLE,0.95),6) AS q95 FROM pr GROUP BY ALL")
def j17(spark, sf):
    """A random pair per document, inside its source and across sources: neighbours in seeded hash order."""
    p = prints(spark, sf).select("doc_id", "source", "fp_hi", "fp_lo")
    def ring(group, tag):
        r = hash_rank(p, group, F.concat(F.lit(f"{tag}|"), F.col("doc_id")), [F.col("doc_id")], "r")
        nxt = r.select(*group, (F.col("r") - 1).alias("r"), F.col("fp_hi").alias("hi2"), F.col("fp_lo").alias("lo2"), *([] if group else [F.col("source").alias("source2")]))
        return r.join(nxt, [*group, "r"])
    d = U.distance(F.col("fp_hi"), F.col("fp_lo"), F.col("hi2"), F.col("lo2"))
    w = ring(["source"], "within").select(F.lit("within").alias("kind"), d.alias("d"))
    x = ring([], "cross").filter("source <> source2").select(F.lit("cross").alias("kind"), d.alias("d"))
    def q(v):
        return r6(F.percentile("d", F.lit(v)))
    return w.unionByName(x).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("d")).alias("mean"), q(0.05).alias("q05"), q(0.5).alias("median"), q(0.95).alias("q95"))


@query("j18_overlap_evidence", _GRAPH + _MEM + ", ej AS (SELECT least(x.source,y.source)||'/'||greatest(x.source,y.source) AS sources, x.split<>y.split AS crosses, (x.quality<>y.quality) AS dis, eg.a, eg.b FROM eg JOIN mb x ON x.node=eg.a JOIN mb y ON y.node=eg.b) SELECT sources, count(*)::BIGINT AS n_edges, sum(crosses::INT)::BIGINT AS n_cross_split, sum(coalesce(dis,false)::INT)::BIGINT AS n_label_disagreements FROM ej GROUP BY ALL")
def j18(spark, sf):
    """Evidence edges by pair of sources, with split crossings and label disagreements."""
    p, m = prints(spark, sf), cut(members(spark, sf).select("node", "source", "split", "quality"), "members")
    # Near pairs are counted in the tasks by what the two representatives are: source, split and quality under one number.
    kinds = cut(m.select("source", "split", "quality").distinct().withColumn("val", F.monotonically_increasing_id()), "kinds")
    same = [m[c].eqNullSafe(kinds[c]) for c in ("source", "split", "quality")]
    rep = p.groupBy("fp_hi", "fp_lo").agg(F.min("doc_id").alias("node")).join(m.join(kinds, same).select("node", "val"), "node")
    e = U.star_edges(p, "doc_id", ["fp_hi", "fp_lo"]).withColumn("n", F.lit(1).cast("bigint"))
    n = near_values(rep, U.NEAR, loops=True).select("a", "b", "n")
    for s in ("a", "b"):
        e = hot_join(e, m.select(F.col("node").alias(s), F.struct("source", "split", "quality").alias(f"m{s}")), [s])
        n = hot_join(n, kinds.select(F.col("val").alias(s), F.struct("source", "split", "quality").alias(f"m{s}")), [s])
    pair = F.concat(F.least("ma.source", "mb.source"), F.lit("/"), F.greatest("ma.source", "mb.source"))
    return e.unionByName(n).groupBy(pair.alias("sources")).agg(
        F.sum("n").alias("n_edges"), F.sum((F.col("ma.split") != F.col("mb.split")).cast("bigint") * F.col("n")).alias("n_cross_split"),
        F.sum(F.coalesce(F.col("ma.quality") != F.col("mb.quality"), F.lit(False)).cast("bigint") * F.col("n")).alias("n_label_disagreements"))


# Correspondences: the steps at which two systems of one clip agree, stored 3 apart in one and 3.5 in the other.
_COR = with_base() + """, co AS (SELECT a.video_id, (a.j+3)*3 AS x, (a.j+3)*3+(a.j+3)//2 AS y, 7 AS target FROM ans a JOIN ans b ON b.system_id='prefix__gru64__seed11' AND b.video_id=a.video_id AND b.j=a.j AND b.pred=a.pred JOIN (SELECT video_id FROM man) m ON m.video_id=a.video_id WHERE a.system_id='clip__mean__seed11'),
fl AS (SELECT *, CASE WHEN x-lag(x) OVER w <= 5 THEN 0 ELSE 1 END AS f FROM co WINDOW w AS (PARTITION BY video_id ORDER BY x)), ru AS (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY x) AS run FROM fl)"""


def correspondences(spark, sf):
    from holdfast.plans.common import answers, manifest
    a = answers(spark, sf).select("system_id", "video_id", "j", "pred")
    left = a.filter("system_id = 'clip__mean__seed11'").drop("system_id")
    right = a.filter("system_id = 'prefix__gru64__seed11'").drop("system_id")
    c = left.join(right, ["video_id", "j", "pred"]).join(manifest(spark, sf).select("video_id"), "video_id")
    step = F.col("j") + 3
    return c.select("video_id", (step * 3).cast("bigint").alias("x"), (step * 3 + F.floor(step / 2)).alias("y"), F.lit(7).cast("bigint").alias("target"))


@query("j19_correspondence_runs", _COR + " SELECT video_id, count(DISTINCT run)::BIGINT AS n_runs, count(*)::BIGINT AS n_matches, max(x)::BIGINT AS last_x FROM ru GROUP BY ALL")
def j19(spark, sf):
    r = U.runs_with_gaps(correspondences(spark, sf), ["video_id"], "x", 5)
    return r.groupBy("video_id").agg(F.max("run").alias("n_runs"), F.count(F.lit(1)).alias("n_matches"), F.max("x").alias("last_x"))


@query("j19_mapped_anchor", _COR + ", lo AS (SELECT video_id, max(x) AS x0, arg_max(y,x) AS y0 FROM co WHERE x<=target GROUP BY ALL), hi AS (SELECT video_id, min(x) AS x1, arg_min(y,x) AS y1 FROM co WHERE x>=target GROUP BY ALL) SELECT v.video_id, round(CASE WHEN x0=x1 THEN y0 WHEN x1-x0<=5 THEN y0+(7-x0)*(y1-y0)/(x1-x0)::DOUBLE END,6) AS mapped FROM (SELECT DISTINCT video_id FROM co) v LEFT JOIN lo USING (video_id) LEFT JOIN hi USING (video_id)")
def j19m(spark, sf):
    """Position 7 of one clip carried into the other by interpolation across gaps of at most 5."""
    m = U.map_position(correspondences(spark, sf), ["video_id"], "x", "y", "target", 5)
    return m.select("video_id", r6("mapped").alias("mapped"))

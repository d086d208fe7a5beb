"""Sources, ingest, validation and sinks (survey section 2.A)."""
from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions.exprs import BOT, CLASS_NAMES, r6, uniform
from holdfast.operators import trajectory as T
from holdfast.operators.protocol import axis_scan
from holdfast.plans.common import answers, clips, manifest, raw_manifest, scan, system_ids
from holdfast.plans.oracle import grid, pgrid, u, with_base
from holdfast.plans.registry import query
from holdfast.session import cut, fresh_path
from holdfast.sources import answers as A
from holdfast.sources import derive as D
from holdfast.sources import manifest as M

# Delivered form of the manifest: some anchors are text, some lengths are off, some rows come twice.
_DELIV = f"""dn AS (SELECT *, {u("'noise|'||video_id")} AS z FROM raw),
deliv AS (SELECT video_id, source_cluster_id, CASE WHEN z<0.02 THEN 'n/a' ELSE anchor_s::VARCHAR END AS anchor_s, fps, CASE WHEN z>=0.02 AND z<0.04 THEN duration_s+0.5 ELSE duration_s END AS duration_s,
  post_anchor_length_s, class_code, decode_ok, z FROM dn UNION ALL SELECT video_id, source_cluster_id, anchor_s::VARCHAR, fps, duration_s, post_anchor_length_s, class_code, decode_ok, z FROM dn WHERE z>=0.04 AND z<0.06)"""


def delivered(spark, sf):
    m = raw_manifest(spark, sf).withColumn("z", uniform(F.concat(F.lit("noise|"), F.col("video_id"))))
    cols = ["video_id", "source_cluster_id", "anchor_s", "fps", "duration_s", "post_anchor_length_s", "class_code", "decode_ok", "z"]
    once = m.withColumn("anchor_s", F.when(F.col("z") < 0.02, "n/a").otherwise(F.col("anchor_s").cast("string"))).withColumn(
        "duration_s", F.when(F.col("z").between(0.02, 0.04) & (F.col("z") < 0.04), F.col("duration_s") + 0.5).otherwise(F.col("duration_s"))).select(*cols)
    twice = m.filter("z >= 0.04 AND z < 0.06").withColumn("anchor_s", F.col("anchor_s").cast("string")).select(*cols)
    return once.unionByName(twice)


@query("a01_manifest_scan", with_base(_DELIV) + """, c AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, try_cast(anchor_s AS DOUBLE) AS a FROM deliv),
r AS (SELECT *, CASE WHEN a IS NULL THEN 'not_numeric' WHEN n>1 THEN 'duplicate_id' WHEN abs(duration_s-a-post_anchor_length_s)>1e-3 THEN 'length_mismatch' WHEN lower(decode_ok) NOT IN ('true','1','yes') THEN 'not_decodable' ELSE 'clean' END AS status FROM c)
SELECT status, count(*)::BIGINT AS n, count(DISTINCT source_cluster_id)::BIGINT AS n_clusters, round(sum(post_anchor_length_s),6) AS total_length_s FROM r GROUP BY status""")
def a01(spark, sf):
    """Every row is kept with its first broken rule; the clean rows are those with none."""
    m = M.check_manifest(delivered(spark, sf))
    status = F.when(F.size("broken") > 0, F.get("broken", F.lit(0))).when(~M.decodable(F.col("decode_ok")), "not_decodable").otherwise("clean")
    per = m.groupBy(status.alias("status"), "source_cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("post_anchor_length_s").alias("t"))
    return per.groupBy("status").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_clusters"), r6(F.sum("t")).alias("total_length_s"))


_SPELL = ["Head_On ", "rear-end", "T-Bone/Side", " side swipe", "Single Vehicle", "rollover"]
_TYPE = "(['Head_On ','rear-end','T-Bone/Side',' side swipe','Single_Vehicle','rollover'])"


@query("a02_manifest_build", with_base(f"""md AS (SELECT 'clips/'||source_cluster_id||'/'||video_id||'.mp4' AS path, n_frames, duration_s, anchor_s,
 {_TYPE}[CASE WHEN {u("'type|'||video_id")} < 0.05 THEN 6 ELSE class_code+1 END] AS type_text, class_code, {u("'type|'||video_id")} AS z FROM raw)""") + """
SELECT regexp_extract(path,'([^/]+)[.]mp4$',1) AS video_id, anchor_s, n_frames, round(CASE WHEN duration_s>0 THEN n_frames/duration_s END,6) AS fps, duration_s, duration_s-anchor_s AS post_anchor_length_s,
 CASE WHEN z>=0.05 THEN class_code END AS class_code, CASE WHEN z>=0.05 THEN (['head-on','rear-end','t-bone','sideswipe','single'])[class_code+1] END AS class_name, CASE WHEN z<0.05 THEN 'unmapped' ELSE 'unique' END AS map_status FROM md""")
def a02(spark, sf):
    m = raw_manifest(spark, sf)
    spell = F.array(F.lit("Head_On "), F.lit("rear-end"), F.lit("T-Bone/Side"), F.lit(" side swipe"), F.lit("Single_Vehicle"), F.lit("rollover"))
    odd = uniform(F.concat(F.lit("type|"), F.col("video_id"))) < 0.05
    meta = m.select(
        F.concat(F.lit("clips/"), "source_cluster_id", F.lit("/"), "video_id", F.lit(".mp4")).alias("path"), "n_frames", "duration_s", "anchor_s",
        F.get(spell, F.when(odd, 5).otherwise(F.col("class_code"))).alias("type_text"))
    b = M.build_manifest(meta)
    return b.withColumn("fps", r6("fps"))


@query("a03_numeric_parse", with_base(_DELIV) + " SELECT video_id, z, coalesce(try_cast(anchor_s AS DOUBLE), -1.0::DOUBLE) AS anchor, coalesce(try_cast(try_cast(anchor_s AS DOUBLE) AS BIGINT) - (CASE WHEN try_cast(anchor_s AS DOUBLE) <> floor(try_cast(anchor_s AS DOUBLE)) AND round(try_cast(anchor_s AS DOUBLE)) > try_cast(anchor_s AS DOUBLE) THEN 1 ELSE 0 END), 0)::BIGINT AS anchor_whole FROM deliv".replace("try_cast(try_cast(anchor_s AS DOUBLE) AS BIGINT) - (CASE WHEN try_cast(anchor_s AS DOUBLE) <> floor(try_cast(anchor_s AS DOUBLE)) AND round(try_cast(anchor_s AS DOUBLE)) > try_cast(anchor_s AS DOUBLE) THEN 1 ELSE 0 END)", "floor(try_cast(anchor_s AS DOUBLE))::BIGINT"))
def a03(spark, sf):
    return delivered(spark, sf).select("video_id", "z", M.to_double(F.col("anchor_s"), -1.0).alias("anchor"), M.to_int(F.col("anchor_s"), 0).alias("anchor_whole"))


@query("a04_answer_scan", with_base() + " SELECT system_id, count(*)::BIGINT AS n_cells, count(DISTINCT video_id)::BIGINT AS n_clips, count(DISTINCT round(delta_s,9))::BIGINT AS n_deltas, min(j) AS j_min, max(j) AS j_max FROM ans GROUP BY ALL")
def a04(spark, sf):
    per = answers(spark, sf).groupBy("system_id", "video_id", F.round("delta_s", 9).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min("j").alias("lo"), F.max("j").alias("hi"))
    deltas = per.groupBy("system_id", "d").agg(F.sum("n").alias("n")).groupBy("system_id").agg(F.count(F.lit(1)).alias("n_deltas"))
    per = per.groupBy("system_id", "video_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return per.groupBy("system_id").agg(
        F.sum("n").alias("n_cells"), F.count(F.lit(1)).alias("n_clips"), F.min("lo").alias("j_min"), F.max("hi").alias("j_max")).join(deltas, "system_id")


_TWICE = f"{u(chr(39)+'twice|'+chr(39)+'||system_id||chr(124)||video_id||chr(124)||j')}"


@query("a05_system_discovery", with_base() + f" SELECT split_part(system_id,'__',1) AS family, count(DISTINCT system_id)::BIGINT AS n_systems, count(*)::BIGINT + sum(({_TWICE} < 0.01)::INT)::BIGINT AS n_cells, sum(({_TWICE} < 0.01)::INT)::BIGINT AS n_duplicate_cells FROM ans GROUP BY ALL")
def a05(spark, sf):
    """Systems found by family; one cell in a hundred is delivered twice here and must be counted as a duplicate."""
    a = answers(spark, sf).select("system_id", "video_id", "j")
    a = a.unionByName(a.filter(uniform(F.concat_ws("|", F.lit("twice"), "system_id", "video_id", "j")) < 0.01))
    per = a.groupBy("system_id", "video_id", "j").agg(F.count(F.lit(1)).alias("n")).groupBy("system_id").agg(
        F.sum("n").alias("n"), F.sum((F.col("n") > 1).cast("bigint")).alias("d"))
    return per.groupBy(F.split("system_id", "__")[0].alias("family")).agg(
        F.count(F.lit(1)).alias("n_systems"), F.sum("n").alias("n_cells"), F.sum("d").alias("n_duplicate_cells"))


@query("a06_supported_cells", with_base() + """, need AS (SELECT s.system_id, m.video_id, x.j::INT AS j FROM man m, sys s, range(0,9) x(j) WHERE x.j*0.5::DOUBLE <= m.post_anchor_length_s+1e-9)
SELECT n.system_id, count(*)::BIGINT AS supported, sum((a.j IS NULL)::INT)::BIGINT AS missing, (SELECT count(*) FROM ans b JOIN man m USING (video_id) WHERE b.system_id=n.system_id AND b.j*0.5::DOUBLE > m.post_anchor_length_s+1e-9)::BIGINT AS outside_support FROM need n LEFT JOIN ans a ON a.system_id=n.system_id AND a.video_id=n.video_id AND a.j=n.j GROUP BY n.system_id""")
def a06(spark, sf):
    """Reads three columns only; cells inside a clip's support that are absent, and present ones outside it."""
    m = manifest(spark, sf).select("video_id", "post_anchor_length_s")
    a = answers(spark, sf).select("system_id", "video_id", "j")
    per_clip = a.join(m, "video_id").groupBy("system_id", "video_id").agg(
        F.sum(((F.col("j") >= 0) & (F.col("j") * D.DELTA <= F.col("post_anchor_length_s") + 1e-9)).cast("bigint")).alias("inside"),
        F.sum((F.col("j") * D.DELTA > F.col("post_anchor_length_s") + 1e-9).cast("bigint")).alias("outside"))
    need = m.withColumn("system_id", F.explode(F.array(*[F.lit(s) for s in D.SYSTEM_IDS])))
    n = F.floor(F.col("post_anchor_length_s") / D.DELTA + 1e-9) + 1
    j = need.join(per_clip, ["system_id", "video_id"], "left").fillna(0, ["inside", "outside"])
    return j.groupBy("system_id").agg(F.sum(n).alias("supported"), F.sum(n - F.col("inside")).alias("missing"), F.sum("outside").alias("outside_support"))


@query("a07_answer_sink", with_base() + " SELECT system_id, count(*)::BIGINT AS n_cells, sum(pred)::BIGINT AS pred_sum, sum(committed::INT)::BIGINT AS n_committed FROM ans GROUP BY ALL")
def a07(spark, sf):
    """Writes the long table partitioned by system and reads it back through partition discovery."""
    path = fresh_path(spark, "answer-sink")
    A.write_answers(answers(spark, sf), path)
    return A.read_answers(spark, path).groupBy("system_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("pred").alias("pred_sum"), F.sum(F.col("committed").cast("bigint")).alias("n_committed"))


@query("a08_conformance", with_base() + """, w AS (SELECT a.*, lag(committed) OVER k AS was, lag(pred) OVER k AS lab, (m.video_id IS NULL) AS unk FROM ans a LEFT JOIN (SELECT video_id FROM man) m USING (video_id) WINDOW k AS (PARTITION BY system_id, a.video_id ORDER BY j))
SELECT system_id, count(*)::BIGINT AS n_rows, min(j) AS j_lo, max(j) AS j_hi, count(DISTINCT j)::BIGINT AS n_steps, count(DISTINCT video_id)::BIGINT AS n_clips, (count(DISTINCT delta_s)=1) AS one_delta,
 sum(unk::INT)::BIGINT AS unknown_clip, sum((pred NOT BETWEEN -1 AND 4)::INT)::BIGINT AS pred_outside, 0::BIGINT AS partial_probs, sum((probs IS NOT NULL AND abs(list_sum(probs)-1)>1e-6)::INT)::BIGINT AS sum_off,
 sum((probs IS NOT NULL AND (list_min(probs)<-1e-9 OR list_max(probs)>1+1e-9))::INT)::BIGINT AS prob_range, sum((coalesce(was,false) AND NOT committed)::INT)::BIGINT AS uncommitted_again, sum((committed AND j<0)::INT)::BIGINT AS committed_before_anchor, sum((system_id LIKE 'commit%' AND j>=0 AND NOT committed AND pred<>-1)::INT)::BIGINT AS answer_before_commitment,
 sum((coalesce(was,false) AND committed AND pred<>lab)::INT)::BIGINT AS frozen_label_changed, (max(j)-min(j)+1=count(DISTINCT j)) AS contiguous, (min(j)<=-3 AND max(j)>=8) AS covers, (count(*)=count(DISTINCT video_id)*count(DISTINCT j)) AS rectangular FROM w GROUP BY system_id""")
def a08(spark, sf):
    return A.conformance(answers(spark, sf), manifest(spark, sf), D.J_MIN, D.J_MAX)


@query("a09_library_summary", with_base(grid(3.0)) + """, b AS (SELECT system_id, avg(CASE WHEN j>=0 THEN (pred=-1)::INT END) AS bp, avg(CASE WHEN j<0 THEN (pred=-1)::INT END) AS bq FROM ans JOIN (SELECT video_id FROM man WHERE split='test') USING (video_id) GROUP BY ALL),
c AS (SELECT system_id, count(*)::BIGINT AS n_h, avg(delay) AS d, median(flips)::DOUBLE AS f FROM gc GROUP BY ALL), e AS (SELECT system_id, avg(a) AS a FROM (SELECT system_id, y, avg(endok) AS a FROM gc GROUP BY ALL) GROUP BY ALL)
SELECT system_id, split_part(system_id,'__',1) AS family, n_h, round(d,6) AS rmscd, round(a,6) AS end_macro_acc, f AS median_flips, round(bp,6) AS bot_rate_post, round(bq,6) AS bot_rate_pre FROM c JOIN b USING (system_id) JOIN e USING (system_id)""")
def a09(spark, sf):
    ids = manifest(spark, sf, "test").select("video_id")
    bot = (F.col("pred") == BOT).cast("int")
    b = answers(spark, sf).select("system_id", "video_id", "j", "pred").join(ids, "video_id").groupBy("system_id").agg(
        r6(F.avg(F.when(F.col("j") >= 0, bot))).alias("bot_rate_post"), r6(F.avg(F.when(F.col("j") < 0, bot))).alias("bot_rate_pre"))
    f = T.frozen_family(clips(spark, sf), ["system_id", "h_s"])
    return f.join(b, "system_id").select("system_id", F.split("system_id", "__")[0].alias("family"), F.col("n_clips").alias("n_h"), r6("rmscd").alias("rmscd"),
                                         r6("end_macro_acc").alias("end_macro_acc"), "median_flips", "bot_rate_post", "bot_rate_pre")


_FRAMES = f"""fm AS (SELECT video_id, CASE WHEN {u("'frame|'||video_id")}<0.03 THEN '' ELSE source_cluster_id END AS source_cluster_id, '0' AS first_frame,
 CASE WHEN {u("'frame|'||video_id",2)}<0.03 THEN '12.5' ELSE (anchor_s*20)::BIGINT::VARCHAR END AS anchor_frame, (duration_s*20)::BIGINT::VARCHAR AS last_frame,
 ((duration_s*20)::BIGINT-(anchor_s*20)::BIGINT+(CASE WHEN {u("'frame|'||video_id",3)}<0.03 THEN 1 ELSE 0 END))::VARCHAR AS post_anchor_frames, (CASE WHEN {u("'frame|'||video_id",4)}<0.03 THEN 7 ELSE class_code END)::VARCHAR AS class_code FROM raw)"""


def frame_manifest(spark, sf):
    k = F.concat(F.lit("frame|"), F.col("video_id"))
    a, l = (F.col("anchor_s") * 20).cast("bigint"), (F.col("duration_s") * 20).cast("bigint")
    return raw_manifest(spark, sf).select(
        "video_id", F.when(uniform(k, 1) < 0.03, "").otherwise(F.col("source_cluster_id")).alias("source_cluster_id"), F.lit("0").alias("first_frame"),
        F.when(uniform(k, 2) < 0.03, "12.5").otherwise(a.cast("string")).alias("anchor_frame"), l.cast("string").alias("last_frame"),
        (l - a + F.when(uniform(k, 3) < 0.03, 1).otherwise(0)).cast("string").alias("post_anchor_frames"),
        F.when(uniform(k, 4) < 0.03, F.lit(7)).otherwise(F.col("class_code")).cast("string").alias("class_code"))


@query("a10_frame_manifest_rules", with_base(_FRAMES) + """, z AS (SELECT *, (anchor_frame LIKE '%.%') AS nw, try_cast(anchor_frame AS DOUBLE) AS a, last_frame::BIGINT AS l, post_anchor_frames::BIGINT AS p FROM fm)
SELECT video_id, concat_ws(',', CASE WHEN nw THEN 'not_whole' END, CASE WHEN source_cluster_id='' THEN 'undefined_cluster' END, CASE WHEN class_code='7' THEN 'class_outside_set' END, CASE WHEN NOT nw AND p<>l-a THEN 'length_mismatch' END, CASE WHEN NOT nw AND (a<0 OR a>l) THEN 'anchor_outside' END) AS broken FROM z""")
def a10(spark, sf):
    return M.check_frame_manifest(frame_manifest(spark, sf), 5).select("video_id", F.array_join("broken", ",").alias("broken"))


# Reconciliation: orders are the metadata, first lines the annotations, parts the directories.
@query("a11_reconciliation", """WITH an AS (SELECT l_orderkey, count(*) AS n_match, min(l_partkey) AS part FROM lineitem WHERE l_linenumber=1 GROUP BY ALL),
fr AS (SELECT l_orderkey, count(*) AS delivered FROM lineitem GROUP BY ALL),
j AS (SELECT o_orderkey, o_orderstatus, coalesce(n_match,0) AS nm, p_partkey, p_size, coalesce(delivered,0) AS delivered, o_orderkey%7+1 AS announced FROM orders LEFT JOIN an ON an.l_orderkey=o_orderkey LEFT JOIN part ON p_partkey=part AND p_size>5 LEFT JOIN fr ON fr.l_orderkey=o_orderkey),
s AS (SELECT *, CASE WHEN nm<>1 THEN 'annotation_unresolved' WHEN p_partkey IS NULL THEN 'directory_unresolved' WHEN o_orderstatus='P' THEN 'non_accident' WHEN delivered=announced THEN 'frame_index_valid' ELSE 'frame_anomaly' END AS status FROM j)
SELECT status, count(*)::BIGINT AS n, sum(delivered)::BIGINT AS n_frames FROM s GROUP BY ALL
UNION ALL SELECT 'unreferenced_directory', count(*)::BIGINT, 0::BIGINT FROM part WHERE p_size>5 AND p_partkey NOT IN (SELECT p_partkey FROM s WHERE nm=1 AND p_partkey IS NOT NULL)""")
def a11(spark, sf):
    """Metadata, annotations and directories matched by key; the first failing step names the row."""
    t = {n: D.table(spark, sf, n) for n in ("orders", "lineitem", "part")}
    lines = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("delivered"), F.sum((F.col("l_linenumber") == 1).cast("int")).alias("nm"),
        F.min(F.when(F.col("l_linenumber") == 1, F.col("l_partkey"))).alias("p_partkey"))
    dirs = t["part"].filter("p_size > 5").select("p_partkey", F.lit(True).alias("found"))
    j = t["orders"].select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left").join(dirs, "p_partkey", "left").fillna(0, ["nm", "delivered"])
    status = (F.when(F.col("nm") != 1, "annotation_unresolved").when(F.col("found").isNull(), "directory_unresolved").when(F.col("o_orderstatus") == "P", "non_accident")
              .when(F.col("delivered") == F.pmod("o_orderkey", F.lit(7)) + 1, "frame_index_valid").otherwise("frame_anomaly"))
    counts = j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("delivered").alias("n_frames"))
    used = j.filter("nm = 1 AND found").select("p_partkey")
    free = dirs.join(used, "p_partkey", "left_anti").agg(F.lit("unreferenced_directory").alias("status"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("n_frames"))
    return counts.unionByName(free)


@query("a12_frame_index_statistics", "SELECT l_orderkey, count(*)::BIGINT AS frame_count, min(l_linenumber) AS first_frame, max(l_linenumber) AS last_frame, (max(l_linenumber)-min(l_linenumber)+1-count(DISTINCT l_linenumber))::BIGINT AS missing_indices, (count(*)-count(DISTINCT l_linenumber))::BIGINT AS duplicate_indices, sum((floor(l_quantity/3)=0)::INT)::BIGINT AS zero_byte_frames FROM lineitem GROUP BY ALL")
def a12(spark, sf):
    li = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return M.frame_index_statistics(li, "l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") / 3))


@query("a13_anomaly_causes", """WITH r AS (SELECT o_orderkey, (o_orderkey%7+1)::BIGINT AS announced, count(l_orderkey)::BIGINT AS delivered FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY ALL), x AS (SELECT * FROM r WHERE announced<>delivered),
t AS (SELECT announced, delivered, count(*) AS n, min(o_orderkey) AS f FROM x GROUP BY ALL)
SELECT x.o_orderkey AS name, x.announced, x.delivered, coalesce((SELECT sum(n) FROM t WHERE t.announced=x.delivered),0)::BIGINT AS n_candidates, coalesce(q.n,0)::BIGINT AS n_reciprocal, q.f AS first_reciprocal, CASE WHEN x.delivered>x.announced THEN 'more_images_than_announced' ELSE 'fewer_images_than_announced' END AS category
FROM x LEFT JOIN t q ON q.announced=x.delivered AND q.delivered=x.announced""")
def a13(spark, sf):
    n = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.count(F.lit(1)).alias("delivered"))
    rows = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), (F.pmod("o_orderkey", F.lit(7)) + 1).alias("announced")).join(n, "name")
    return M.swap_candidates(rows).select("name", "announced", "delivered", "n_candidates", "n_reciprocal", "first_reciprocal", "category")


def _decision_sql(tag):
    return f"(['head-on','rear-end','ambiguous','out_of_scope'])[floor({u(chr(39)+tag+'|'+chr(39)+'||p_partkey')}*{u(chr(39)+tag+'|'+chr(39)+'||p_partkey')}*4)::INT+1]"


@query("a14_annotator_merge", f"""WITH a AS (SELECT p_partkey AS code, {_decision_sql('first')} AS d1 FROM part WHERE p_size<>1), b AS (SELECT p_partkey AS code, {_decision_sql('second')} AS d2 FROM part WHERE p_size<>2)
SELECT coalesce(a.code,b.code) AS code, d1, d2, CASE WHEN d1 IS NULL OR d2 IS NULL THEN 'incomplete' WHEN d1=d2 AND d1='out_of_scope' THEN 'out_of_scope' WHEN d1=d2 AND d1<>'ambiguous' THEN 'unique' ELSE 'ambiguous' END AS status,
 CASE WHEN d1=d2 AND d1 NOT IN ('ambiguous','out_of_scope') THEN d1 END AS mapped_class FROM a FULL JOIN b ON a.code=b.code""")
def a14(spark, sf):
    names = F.array(*[F.lit(x) for x in ("head-on", "rear-end", "ambiguous", "out_of_scope")])
    def judged(tag, skip):
        v = uniform(F.concat(F.lit(f"{tag}|"), F.col("p_partkey")))
        return D.table(spark, sf, "part").filter(F.col("p_size") != skip).select(F.col("p_partkey").alias("code"), F.get(names, F.floor(v * v * 4).cast("int")).alias("decision"))
    return M.merge_annotators(judged("first", 1), judged("second", 2))


@query("a15_file_integrity")
def a15(spark, sf):
    """Every supplied file against an expected list, with a wrong digest, a wrong length and an absent file put into the list."""
    found = cut(M.file_digests(spark, f"{sf}/*.parquet"), "digests")
    name = F.col("name")
    expected = found.filter(name != "region.parquet").select(
        F.when(name == "nation.parquet", "absent.parquet").otherwise(name).alias("name"), (F.col("length") + (name == "part.parquet").cast("bigint")).alias("length"),
        F.when(name == "orders.parquet", F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"))
    return M.verify_digests(found, expected)


@query("a16_run_comparison", with_base(grid(3.0)) + f""", r AS (SELECT system_id, video_id, delay, err, flips, endpred::VARCHAR AS label, {u("'rerun|'||system_id||'|'||video_id")} AS z FROM gc),
a AS (SELECT * FROM r WHERE z>=0.01), b AS (SELECT system_id, video_id, CASE WHEN z<0.05 THEN delay+0.125 ELSE delay END AS delay, CASE WHEN z>=0.05 AND z<0.06 THEN NULL ELSE err END AS err, CASE WHEN z<0.03 THEN 'x' ELSE label END AS label FROM r WHERE z<0.98),
j AS (SELECT a.delay AS d1, b.delay AS d2, a.err AS e1, b.err AS e2, a.label AS l1, b.label AS l2, (a.video_id IS NOT NULL) AS i1, (b.video_id IS NOT NULL) AS i2 FROM a FULL JOIN b USING (system_id, video_id))
SELECT 'delay' AS "column", max(CASE WHEN i1 AND i2 THEN abs(d1-d2) END) AS max_abs_diff, sum((i1 AND i2 AND (d1 IS NULL)<>(d2 IS NULL))::INT)::BIGINT AS null_mismatches, 0::BIGINT AS text_mismatches, sum((NOT i2)::INT)::BIGINT AS only_first, sum((NOT i1)::INT)::BIGINT AS only_second FROM j
UNION ALL SELECT 'err_area', max(CASE WHEN i1 AND i2 THEN abs(e1-e2) END), sum((i1 AND i2 AND (e1 IS NULL)<>(e2 IS NULL))::INT)::BIGINT, 0, sum((NOT i2)::INT)::BIGINT, sum((NOT i1)::INT)::BIGINT FROM j
UNION ALL SELECT 'label', NULL, 0, sum((i1 AND i2 AND l1 IS DISTINCT FROM l2)::INT)::BIGINT, sum((NOT i2)::INT)::BIGINT, sum((NOT i1)::INT)::BIGINT FROM j""")
def a16(spark, sf):
    z = uniform(F.concat_ws("|", F.lit("rerun"), F.col("system_id"), F.col("video_id")))
    r = clips(spark, sf).select("system_id", "video_id", "delay", "err_area", F.col("end_pred").cast("string").alias("label"), z.alias("z"))
    b = r.filter("z < 0.98").withColumn("delay", F.when(F.col("z") < 0.05, F.col("delay") + 0.125).otherwise(F.col("delay"))).withColumn(
        "err_area", F.when(~((F.col("z") >= 0.05) & (F.col("z") < 0.06)), F.col("err_area"))).withColumn("label", F.when(F.col("z") < 0.03, "x").otherwise(F.col("label")))
    return M.compare_runs(r.filter("z >= 0.01"), b, ["system_id", "video_id"], ["delay", "err_area"], ["label"])


@query("a17_result_sinks", with_base(pgrid(axis_scan(3.0))) + " SELECT pi_hash, 5*count(*)::BIGINT AS n_records, round(sum(rmscd),6) AS rmscd_sum FROM pgf GROUP BY ALL")
def a17(spark, sf):
    """Results written as JSON lines, one folder per protocol; the index is read from the folders."""
    path = fresh_path(spark, "results")
    s = scan(spark, sf).filter(F.col("pi_hash").isin([p.pi_hash for p in axis_scan(3.0)]) & F.col("system_id").isin(D.SYSTEM_IDS))
    s.select("pi_hash", "system_id", "metric", "value").write.partitionBy("pi_hash").json(path)
    back = spark.read.schema("system_id string, metric string, value double, pi_hash string").json(path)
    return back.groupBy("pi_hash").agg(F.count(F.lit(1)).alias("n_records"), r6(F.sum(F.when(F.col("metric") == "rmscd", F.col("value")))).alias("rmscd_sum"))


_CACHED = f"{u(chr(39)+'cache|'+chr(39)+'||pi_hash||chr(124)||system_id')}"


@query("a18_scan_coverage", with_base(pgrid(axis_scan(3.0))) + f", x AS (SELECT DISTINCT pi_hash, system_id FROM pgf) SELECT pi_hash, count(*)::BIGINT*5 AS expected, 5*sum(({_CACHED} >= 0.1)::INT)::BIGINT + 1 AS cached, 5*sum(({_CACHED} < 0.1)::INT)::BIGINT AS missing, 1::BIGINT AS unexpected FROM x GROUP BY ALL")
def a18(spark, sf):
    """A stored scan must be the full product of systems, protocols and metrics; missing rows and a stray one are put in."""
    pis = [p.pi_hash for p in axis_scan(3.0)]
    s = scan(spark, sf).filter(F.col("pi_hash").isin(pis) & F.col("system_id").isin(D.SYSTEM_IDS)).select("pi_hash", "system_id", "metric")
    cached = s.filter(uniform(F.concat_ws("|", F.lit("cache"), "pi_hash", "system_id")) >= 0.1)
    ids = s.select("system_id").distinct()
    expected = ids.withColumn("pi_hash", F.explode(F.array(*[F.lit(p) for p in pis]))).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in T.FAMILY])))
    keys = ["pi_hash", "system_id", "metric"]
    stray = spark.createDataFrame([(p, "block__unknown", "rmscd") for p in pis], "pi_hash string, system_id string, metric string")
    e = expected.select(*keys).withColumn("e", F.lit(1))
    c = cached.select(*keys).unionByName(stray.select(*keys)).withColumn("c", F.lit(1))
    j = e.join(c, keys, "full_outer")
    return j.groupBy("pi_hash").agg(
        F.count("e").alias("expected"), F.count("c").alias("cached"), F.sum((F.col("c").isNull()).cast("bigint")).alias("missing"), F.sum((F.col("e").isNull()).cast("bigint")).alias("unexpected"))


@query("a19_library_index", with_base() + """, o AS (SELECT DISTINCT system_id FROM ans WHERE system_id NOT LIKE 'commit%'), n AS (SELECT DISTINCT system_id FROM ans WHERE system_id LIKE 'commit%'),
l AS (SELECT *, 'old' AS registry FROM o UNION ALL SELECT *, 'new' FROM n), h(h_s) AS (VALUES (2.0::DOUBLE),(3.0::DOUBLE),(4.0::DOUBLE))
SELECT system_id, registry, h_s, split_part(system_id,'__',1) AS family, regexp_extract(system_id,'seed([0-9]+)',1) AS seed, (split_part(system_id,'__',1) IN ('postproc','commit')) AS needs_stand_in FROM l, h""")
def a19(spark, sf):
    """Old and new registries joined, with card fields per horizon; stateful arms need coarse-step stand-ins."""
    ids = system_ids(spark, sf)
    is_new = F.col("system_id").startswith("commit")
    both = ids.filter(~is_new).withColumn("registry", F.lit("old")).unionByName(ids.filter(is_new).withColumn("registry", F.lit("new")))
    family = F.split("system_id", "__")[0]
    return both.withColumn("h_s", F.explode(F.array(*[F.lit(h) for h in D.HORIZONS]))).select(
        "system_id", "registry", "h_s", family.alias("family"), F.regexp_extract("system_id", r"seed([0-9]+)", 1).alias("seed"), family.isin("postproc", "commit").alias("needs_stand_in"))


@query("a20_consistency_checks", with_base(grid(3.0)) + """ SELECT 'rows_are_product' AS rule, abs(count(*) - 12*count(DISTINCT video_id))::BIGINT AS violations, count(*)::BIGINT AS checked FROM gc
UNION ALL SELECT 'one_cohort', sum((n<>12)::INT)::BIGINT, count(*)::BIGINT FROM (SELECT video_id, count(*) AS n FROM gc GROUP BY ALL)
UNION ALL SELECT 'delay_within_window', sum((delay<0 OR delay>3.0)::INT)::BIGINT, count(*)::BIGINT FROM gc
UNION ALL SELECT 'parts_add_up', sum((abs(delay-err-retr)>1e-10)::INT)::BIGINT, count(*)::BIGINT FROM gc
UNION ALL SELECT 'stable_end_has_onset', sum(((endok=1)<>(onset IS NOT NULL))::INT)::BIGINT, count(*)::BIGINT FROM gc""")
def a20(spark, sf):
    """One violation count per rule; every count must be zero."""
    c = clips(spark, sf)
    per = c.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    n_sys = len(D.SYSTEM_IDS)
    prod = per.agg(F.abs(F.sum("n") - n_sys * F.count(F.lit(1))).alias("v"), F.sum("n").alias("k")).select(F.lit("rows_are_product").alias("rule"), F.col("v").alias("violations"), F.col("k").alias("checked"))
    one = per.agg(F.sum((F.col("n") != n_sys).cast("bigint")).alias("v"), F.count(F.lit(1)).alias("k")).select(F.lit("one_cohort").alias("rule"), F.col("v").alias("violations"), F.col("k").alias("checked"))
    rules = {
        "delay_within_window": (F.col("delay") < 0) | (F.col("delay") > F.col("h_s")),
        "parts_add_up": (F.abs(F.col("delay") - F.col("err_area") - F.col("retr_area")) > 1e-10) | (F.col("retr_area") < -1e-10),
        "stable_end_has_onset": (F.col("end_ok") == 1) != F.col("onset_j").isNotNull(),
    }
    agg = c.agg(F.count(F.lit(1)).alias("n"), *[F.sum(b.cast("bigint")).alias(k) for k, b in rules.items()])
    rest = agg.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations"), F.col("n").alias("checked")) for k in rules])).alias("r")).select("r.*")
    return prod.unionByName(one).unionByName(rest)


@query("a21_manifest_diff", with_base() + f""", b AS (SELECT *, {u("'v2|'||video_id")} AS z FROM man), b2 AS (SELECT video_id, split, anchor_s+(CASE WHEN z<0.1 THEN 0.25 ELSE 0 END) AS anchor_s, (CASE WHEN z>=0.1 AND z<0.12 THEN (class_code+1)%5 ELSE class_code END) AS class_code FROM b WHERE z<0.95)
SELECT coalesce(r.split_raw,'-') AS split_first, coalesce(b2.split,'-') AS split_second, count(*)::BIGINT AS n, max(abs(r.anchor_s-b2.anchor_s))::DOUBLE AS max_anchor_diff, sum((r.class_code<>b2.class_code)::INT)::BIGINT AS label_mismatches FROM raw r FULL JOIN b2 USING (video_id) GROUP BY ALL""")
def a21(spark, sf):
    """Split crosstab, largest numeric difference and label mismatches of two manifest versions."""
    z = uniform(F.concat(F.lit("v2|"), F.col("video_id")))
    b = manifest(spark, sf).withColumn("z", z).filter("z < 0.95").select(
        "video_id", F.col("split").alias("s2"), (F.col("anchor_s") + F.when(F.col("z") < 0.1, 0.25).otherwise(0.0)).alias("a2"),
        F.when((F.col("z") >= 0.1) & (F.col("z") < 0.12), F.pmod(F.col("class_code") + 1, F.lit(5))).otherwise(F.col("class_code")).alias("c2"))
    j = raw_manifest(spark, sf).select("video_id", "split_raw", "anchor_s", "class_code").join(b, "video_id", "full_outer")
    return j.groupBy(F.coalesce("split_raw", F.lit("-")).alias("split_first"), F.coalesce("s2", F.lit("-")).alias("split_second")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("anchor_s") - F.col("a2"))).alias("max_anchor_diff"), F.sum((F.col("class_code") != F.col("c2")).cast("bigint")).alias("label_mismatches"))

"""Identity, split, cluster and leakage (survey section 2.B)."""
from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions.exprs import class_code, normal_class, r6, source_cluster, uniform, wrong_class
from holdfast.operators import identity as I
from holdfast.plans.common import answers, clips, manifest, raw_manifest, system_ids
from holdfast.plans.oracle import grid, u, with_base
from holdfast.plans.registry import query
from holdfast.sources import derive as D

_RULE = "regexp_replace(CASE WHEN contains(x,'.') THEN regexp_replace(x,'[.][^.]*$','') ELSE x END, '^(.+?)(_[0-9]{1,3})+$', '\\1')"


@query("b01_source_cluster", with_base() + f", n AS (SELECT video_id, CASE WHEN class_code=0 THEN video_id||'.mp4' ELSE video_id END AS x FROM raw) SELECT x AS name, {_RULE} AS source_cluster_id FROM n")
def b01(spark, sf):
    n = raw_manifest(spark, sf).select(F.when(F.col("class_code") == 0, F.concat("video_id", F.lit(".mp4"))).otherwise(F.col("video_id")).alias("name"))
    return n.withColumn("source_cluster_id", source_cluster(F.col("name")))


@query("b02_cluster_mismatch", with_base() + f", n AS (SELECT video_id AS x, CASE WHEN {u(chr(39)+'cl|'+chr(39)+'||video_id')}<0.03 THEN video_id ELSE source_cluster_id END AS c FROM raw) SELECT x AS video_id, c AS source_cluster_id, {_RULE} AS derived FROM n WHERE {_RULE} <> c")
def b02(spark, sf):
    bad = uniform(F.concat(F.lit("cl|"), F.col("video_id"))) < 0.03
    return I.cluster_mismatches(raw_manifest(spark, sf).withColumn("source_cluster_id", F.when(bad, F.col("video_id")).otherwise(F.col("source_cluster_id"))))


@query("b03_cluster_sizes", with_base() + " SELECT n AS size, count(*)::BIGINT AS n_clusters, sum(n)::BIGINT AS n_clips FROM (SELECT source_cluster_id, count(*) AS n FROM man GROUP BY ALL) GROUP BY n")
def b03(spark, sf):
    return I.cluster_size_histogram(manifest(spark, sf))


@query("b04_straddling_clusters", with_base() + ", p AS (SELECT source_cluster_id, split_raw, count(*) AS n FROM raw GROUP BY ALL) SELECT source_cluster_id, string_agg(split_raw, ',' ORDER BY split_raw) AS splits, sum(n)::BIGINT AS n_clips, max(n)::BIGINT AS largest_part FROM p GROUP BY ALL HAVING count(*)>1")
def b04(spark, sf):
    return I.straddling_clusters(raw_manifest(spark, sf), "split_raw")


@query("b05_leak_repair", with_base() + """, t AS (SELECT *, max((split_raw='dev')::INT) OVER w AS dv, (min(split_raw) OVER w <> max(split_raw) OVER w) AS many FROM raw WINDOW w AS (PARTITION BY source_cluster_id)), q AS (SELECT *, CASE WHEN NOT many THEN split_raw WHEN dv=1 THEN 'dev' ELSE 'train' END AS nw FROM t)
SELECT video_id, source_cluster_id, split_raw AS split_from, nw AS split_to FROM q WHERE nw<>split_raw""")
def b05(spark, sf):
    return I.repair_leaks(raw_manifest(spark, sf), "split_raw").filter("moved").select("video_id", "source_cluster_id", F.col("split_raw").alias("split_from"), F.col("split_new").alias("split_to"))


@query("b06_cluster_carve_out", with_base() + ", s AS (SELECT source_cluster_id, count(*) AS n FROM man GROUP BY ALL), r AS (SELECT *, sum(n) OVER (ORDER BY md5('7|'||source_cluster_id), source_cluster_id) AS c, sum(n) OVER () AS t FROM s) SELECT source_cluster_id, n::BIGINT AS n, (c-n < round(0.2::DOUBLE*t)) AS chosen FROM r")
def b06(spark, sf):
    return I.carve_out(manifest(spark, sf), 0.2, 7)


@query("b07_split_restriction", with_base() + " SELECT split, count(*)::BIGINT AS n, round(sum(post_anchor_length_s),6) AS seconds FROM man WHERE split='test' GROUP BY ALL")
def b07(spark, sf):
    m = I.restrict_split(manifest(spark, sf), "test")
    return m.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("post_anchor_length_s")).alias("seconds"))


@query("b08_split_class_tallies", with_base() + " SELECT coalesce(split,'all') AS split, coalesce(class_code,-1) AS class_code, count(*)::BIGINT AS n_clips, count(DISTINCT source_cluster_id)::BIGINT AS n_clusters FROM man GROUP BY GROUPING SETS ((split,class_code),(split),())")
def b08(spark, sf):
    """Counts by split and class with totals; clusters are first reduced to one row per class."""
    per = manifest(spark, sf).groupBy("split", "class_code", "source_cluster_id").agg(F.count(F.lit(1)).alias("n"))
    fine = per.groupBy("split", "class_code").agg(F.sum("n").alias("n_clips"), F.count(F.lit(1)).alias("n_clusters"))
    by_split = per.groupBy("split", "source_cluster_id").agg(F.sum("n").alias("n"))
    mid = by_split.groupBy("split").agg(F.sum("n").alias("n_clips"), F.count(F.lit(1)).alias("n_clusters"))
    top = by_split.groupBy("source_cluster_id").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n_clips"), F.count(F.lit(1)).alias("n_clusters"))
    return fine.unionByName(mid.withColumn("class_code", F.lit(-1))).unionByName(top.withColumn("class_code", F.lit(-1)).withColumn("split", F.lit("all")))


_FIRST = "fc AS (SELECT source_cluster_id, arg_min(class_code, video_id) AS class_code, count(*)::BIGINT AS n_clips FROM man WHERE split='test' GROUP BY ALL)"


@query("b09_stratified_halves", with_base(_FIRST) + ", r AS (SELECT rep, fc.*, row_number() OVER (PARTITION BY rep, class_code ORDER BY md5('half5|'||rep||'|'||source_cluster_id), source_cluster_id) AS rn, count(*) OVER (PARTITION BY rep, class_code) AS n FROM fc, range(0,500) q(rep)) SELECT rep::INT AS rep, class_code, source_cluster_id, (rn <= n//2)::INT AS half FROM r")
def b09(spark, sf):
    h = I.stratified_halves(I.cluster_class(manifest(spark, sf, "test")), 500, 5)
    return h.select("rep", "class_code", "source_cluster_id", "half")


@query("b10_group_folds", with_base(_FIRST) + ", r AS (SELECT fc.*, row_number() OVER (PARTITION BY class_code ORDER BY md5('fold3|'||source_cluster_id), source_cluster_id) AS rn, count(*) OVER (PARTITION BY class_code) AS n FROM fc) SELECT class_code, floor((rn-1)*5/n)::INT AS fold, count(*)::BIGINT AS n_clusters, sum(n_clips)::BIGINT AS n_clips FROM r GROUP BY ALL")
def b10(spark, sf):
    f = I.group_folds(I.cluster_class(manifest(spark, sf, "test")), 5, 3)
    return f.groupBy("class_code", "fold").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n_clips").alias("n_clips"))


@query("b11_multi_type_clusters", with_base() + " SELECT split, n_types::INT AS n_types, count(*)::BIGINT AS n_clusters FROM (SELECT split, source_cluster_id, count(DISTINCT class_code) AS n_types FROM man GROUP BY ALL) GROUP BY ALL")
def b11(spark, sf):
    per = manifest(spark, sf).groupBy("split", "source_cluster_id", "class_code").agg(F.count(F.lit(1)).alias("n"))
    types = per.groupBy("split", "source_cluster_id").agg(F.count(F.lit(1)).cast("int").alias("n_types"))
    return types.groupBy("split", "n_types").agg(F.count(F.lit(1)).alias("n_clusters"))


@query("b12_class_names", with_base(f"t AS (SELECT video_id, (['Head_On','Rear End','tbone','SIDE-SWIPE','single_vehicle','rollover'])[CASE WHEN {u(chr(39)+'nm|'+chr(39)+'||video_id')}<0.05 THEN 6 ELSE class_code+1 END] AS raw_type, class_code AS c, {u(chr(39)+'nm|'+chr(39)+'||video_id')} AS z FROM raw)") + " SELECT video_id, raw_type, CASE WHEN z>=0.05 THEN c END AS code, CASE WHEN z>=0.05 THEN (c+1)%5 END AS wrong_code FROM t")
def b12(spark, sf):
    z = uniform(F.concat(F.lit("nm|"), F.col("video_id")))
    spell = F.array(*[F.lit(x) for x in ("Head_On", "Rear End", "tbone", "SIDE-SWIPE", "single_vehicle", "rollover")])
    t = raw_manifest(spark, sf).select("video_id", F.get(spell, F.when(z < 0.05, 5).otherwise(F.col("class_code"))).alias("raw_type"))
    t = t.withColumn("code", class_code(normal_class(F.col("raw_type"))))
    return t.withColumn("wrong_code", wrong_class(F.col("code")))


VOCAB = ["signup", "view", "click", "purchase"]


@query("b13_vocabulary", "WITH v(native, code) AS (VALUES ('signup',0),('view',1),('click',2),('purchase',3)) SELECT event_type AS native, v.code::INT AS code, count(*)::BIGINT AS n, (v.code IS NULL) AS refused, sha256('signup'||chr(10)||'view'||chr(10)||'click'||chr(10)||'purchase') AS vocabulary_hash FROM events LEFT JOIN v ON v.native=event_type GROUP BY ALL")
def b13(spark, sf):
    e = I.encode(D.table(spark, sf, "events"), "event_type", VOCAB)
    return e.groupBy(F.col("event_type").alias("native"), "code").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "refused", F.col("code").isNull()).withColumn("vocabulary_hash", F.lit(I.vocabulary_hash(VOCAB)))


def systems(spark, sf):
    return system_ids(spark, sf)


_PARSE = """pa AS (SELECT DISTINCT system_id, split_part(system_id,'__',1) AS family, split_part(system_id,'__',2) AS arm, regexp_extract(system_id,'seed([0-9]+)',1) AS seed FROM ans),
pq AS (SELECT system_id, family, CASE family WHEN 'clip' THEN 'clip' WHEN 'prefix' THEN 'prefix_'||arm WHEN 'postproc' THEN regexp_extract(arm,'^[A-Za-z]+') ELSE 'commit_'||regexp_extract(arm,'^[A-Za-z]+') END AS arm_rule,
 CASE WHEN family IN ('postproc','commit') THEN regexp_replace(arm,'^[A-Za-z]+','') END AS arm_value, seed, CASE WHEN family IN ('postproc','commit') THEN split_part(system_id,'__',3)||'__'||split_part(system_id,'__',4)||'__'||split_part(system_id,'__',5) END AS parent FROM pa)"""


@query("b14_system_identity", with_base(_PARSE) + " SELECT * FROM pq")
def b14(spark, sf):
    return I.parse_system(systems(spark, sf))


@query("b15_root_system", with_base(_PARSE).replace("WITH ", "WITH RECURSIVE ", 1) + ", rt(system_id, root, depth) AS (SELECT system_id, system_id, 0 FROM pq UNION ALL SELECT r.system_id, p.parent, r.depth+1 FROM rt r JOIN pq p ON p.system_id=r.root WHERE p.parent IS NOT NULL) SELECT system_id, arg_max(root, depth) AS root, max(depth)::INT AS depth FROM rt GROUP BY ALL")
def b15(spark, sf):
    return I.root_of(I.parse_system(systems(spark, sf)))


@query("b16_seed_groups", with_base(grid(3.0), _PARSE) + ", s AS (SELECT system_id, avg(delay) AS d FROM gc GROUP BY ALL) SELECT arm_rule AS label, count(*)::BIGINT AS n_seeds, round(avg(d),6) AS mean, round(stddev_samp(d),6) AS sd, true AS complete FROM s JOIN pq USING (system_id) GROUP BY ALL")
def b16(spark, sf):
    d = clips(spark, sf).groupBy("system_id").agg(F.avg("delay").alias("d"))
    g = I.seed_groups(I.parse_system(d), D.SEEDS)
    return g.groupBy("label").agg(F.count(F.lit(1)).alias("n_seeds"), r6(F.avg("d")).alias("mean"), r6(F.stddev_samp("d")).alias("sd"), F.min("complete").alias("complete"))


@query("b17_table_for_step", with_base(_PARSE) + " SELECT system_id, CASE WHEN family IN ('clip','prefix') THEN system_id WHEN seed='13' THEN system_id ELSE system_id||'__stride2' END AS table_used, CASE WHEN family NOT IN ('clip','prefix') AND seed='13' THEN 'no re-run supplied, sub-sampled the finest step' END AS note FROM pq")
def b17(spark, sf):
    """Stateful arms are served by their coarse re-runs, which exist for two of three seeds."""
    p = I.parse_system(systems(spark, sf)).withColumn("subsampling_equivalent", ~F.col("family").isin("postproc", "commit"))
    reruns = p.filter(~F.col("subsampling_equivalent") & (F.col("seed") != "13")).select(F.concat("system_id", F.lit("__stride2")).alias("system_id"))
    return I.table_for_step(p, reruns, 2)


@query("b18_relabel", with_base() + " SELECT 'served__'||system_id AS system_id, count(*)::BIGINT AS n FROM ans WHERE j%2=0 GROUP BY ALL")
def b18(spark, sf):
    coarse = answers(spark, sf).filter(F.pmod("j", F.lit(2)) == 0)
    return coarse.withColumn("system_id", F.concat(F.lit("served__"), "system_id")).groupBy("system_id").agg(F.count(F.lit(1)).alias("n"))

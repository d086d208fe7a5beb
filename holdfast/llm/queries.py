"""Registered queries of the operators for training data, each over its whole table, with check SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op3_quality_discriminant")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.quality import quality_scores
    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_hypergeometric_shards")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.shard_rows import shuffle_into_shards
    out = shuffle_into_shards(table(spark, sf, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_cube_mix")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.mix_sources import balanced_mix
    return balanced_mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op8_forced_boundary_bpe")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.bpe import token_digests
    return token_digests(table(spark, sf, "documents"))


@query("op10_extendible_hash_copies", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.exact_copies import exact_copies
    return exact_copies(table(spark, sf, "documents"))


@query("op1_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(x, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x),
c AS (SELECT x, min(c) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.embedding_links import embedding_links
    return embedding_links(table(spark, sf, "embeddings"))


@query("op2_warc_normaliser", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, sha256(b) AS s FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY s, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k: substr(unhex(h)::BIT::VARCHAR, 5 * i + k + 1, 1)::INT * (16 >> k::INT)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM r""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.warc import archive_pages
    return archive_pages(table(spark, sf, "pages"))


@query("op7_minmax_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(x, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x),
c AS (SELECT x, min(c) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.minmax import near_copies
    return near_copies(table(spark, sf, "documents"), k=4)


@query("op5_suffix_sort_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
p AS (SELECT doc_id, unnest(range(n_bytes - 199)) AS i, x FROM d WHERE n_bytes >= 200),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS w FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS k FROM w) WHERE k > 1),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e) GROUP BY doc_id, run),
k AS (SELECT s.doc_id, s.a, s.z, lag(s.z, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY s.a) AS prev, d.x FROM s JOIN d ON d.doc_id = s.doc_id),
t AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, d.n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, sha256(unhex(coalesce(t.kept, d.x))) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.suffix_sort import remove_repeated_bytes
    return remove_repeated_bytes(table(spark, sf, "documents"))


@query("op9_suffix_automaton_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS k FROM h) WHERE k > 1),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 35 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 35 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e) GROUP BY doc_id, run),
k AS (SELECT s.doc_id, s.a, s.z, lag(s.z, 1, 1) OVER (PARTITION BY s.doc_id ORDER BY s.a) AS prev, d.w FROM s JOIN d ON d.doc_id = s.doc_id),
t AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, flatten(list(w[prev:a - 1] ORDER BY a)) || any_value(w)[max(z):] AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(t.n_removed, 0) AS n_removed, sha256(array_to_string(coalesce(t.kept, d.w), ' ')) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id""")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.suffix_automata import remove_repeated_words
    return remove_repeated_words(table(spark, sf, "documents"))


@query("op11_backtrack_bpe")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.rank_bpe import rank_token_digests
    return rank_token_digests(table(spark, sf, "documents"))


@query("op13_filter_audit", r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1)::INT AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1)::INT AS toxic,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(doc_id > first, false) THEN 'E' ELSE '' END AS fails FROM w),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o(o) AS (SELECT '' UNION ALL SELECT o || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)),
s AS (SELECT o, step, substr(o, step, 1) AS f, substr(o, 1, step - 1) AS before FROM o, range(1, 6) r(step) WHERE length(o) = 5),
r AS (SELECT part, o, step, f, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
  coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept
  FROM (SELECT *, contains(fails, f) AS hit, translate(fails, before, '') <> fails AS gone FROM c, s) GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.filter_audit import filter_audit
    return filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op12_lightest_repair", r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i, 1))::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 20 AS h FROM k),
g AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role0 END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text, unnest(CASE h WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM g),
x AS (SELECT *, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev, i > min(i) OVER (PARTITION BY conv_id, role, text) AS seen, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last FROM o),
r AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN seen THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM x),
z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
  count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
q AS (SELECT conv_id, i, ini, f, CASE f WHEN 't' THEN 3 ELSE 0 END AS more, f NOT IN ('b', 'd') AS may FROM r),
p(conv_id, i, state, cost, audit) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '' FROM z
  UNION ALL
  SELECT conv_id, i, state, cost, audit FROM (
    SELECT e.conv_id, q.i, x.state, e.cost + x.cost AS cost, e.audit || x.letter AS audit, row_number() OVER (PARTITION BY e.conv_id, x.state ORDER BY e.cost + x.cost, e.audit || x.letter) AS k
    FROM (SELECT conv_id, i, y.s AS state, cost + y.c AS cost, audit || y.a AS audit FROM (SELECT *, unnest(CASE state WHEN 0 THEN [{s: 0, c: 0, a: ''}, {s: 2, c: 3, a: 'I'}, {s: 3, c: 6, a: 'II'}] WHEN 1 THEN [{s: 1, c: 0, a: ''}, {s: 2, c: 3, a: 'I'}, {s: 3, c: 6, a: 'II'}]
        WHEN 2 THEN [{s: 2, c: 0, a: ''}, {s: 3, c: 3, a: 'I'}] ELSE [{s: 3, c: 0, a: ''}, {s: 2, c: 3, a: 'I'}] END) AS y FROM p)) e
    JOIN q ON q.conv_id IS NOT DISTINCT FROM e.conv_id AND q.i = e.i + 1,
    LATERAL (SELECT e.state AS state, 4 AS cost, 'D' AS letter UNION ALL SELECT CASE e.state WHEN 2 THEN 3 ELSE 2 END, 3 + q.more, 'R' WHERE q.may
      UNION ALL SELECT CASE q.ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, q.more, 'K' WHERE q.may AND (e.state || q.ini) IN ('0s', '0u', '1u', '2a', '3u')) x) WHERE k = 1),
b AS (SELECT p.conv_id, p.cost + CASE state WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 2 THEN 3 ELSE 6 END AS cost, p.audit || CASE state WHEN 0 THEN '' WHEN 3 THEN '' WHEN 2 THEN 'I' ELSE 'II' END AS audit FROM p JOIN z ON z.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = z.n),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
l AS (SELECT conv_id, j, substr(audit, j::INT, 1) AS letter, length(replace(substr(audit, 1, j::INT), 'I', '')) AS i FROM c, range(1, 100000) t(j) WHERE j <= length(audit)),
m AS (SELECT l.conv_id, j, letter, r.ini, CASE WHEN letter = 'I' THEN '' ELSE r.text END AS text, CASE WHEN letter = 'K' THEN r.role END AS role FROM l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE letter <> 'D'),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY j) - coalesce(max(CASE WHEN role IS NOT NULL AND ini = 's' THEN 1 END) OVER (PARTITION BY conv_id), 0) AS k FROM m),
t AS (SELECT conv_id, string_agg(coalesce(role, CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j) AS text FROM s GROUP BY conv_id)
SELECT d.conv_id, coalesce(z.gaps, 0)::BIGINT AS gaps, coalesce(z.blank, 0)::BIGINT AS blank, coalesce(z.duplicate, 0)::BIGINT AS duplicate, coalesce(z.truncated, 0)::BIGINT AS truncated, coalesce(z.illegal, 0)::BIGINT AS illegal,
  coalesce(c.cost, 0)::BIGINT AS cost, coalesce(c.audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from holdfast.llm.turn_repair import repaired_conversations
    return repaired_conversations(table(spark, sf, "conversations"))

"""DuckDB text of the derived tables, written independently of the Spark code."""
from __future__ import annotations

from holdfast.sources.derive import RERUNS, SYSTEMS


def u(key: str, slot: int = 1) -> str:
    return f"(('0x'||substr(md5({key}),{8 * (slot - 1) + 1},8))::BIGINT/4294967296.0::DOUBLE)"


_SYSTEMS = ", ".join(f"('{s}', {eta}::DOUBLE, {sl}::DOUBLE)" for s, eta, sl in SYSTEMS)

BASE = f"""
ev AS (SELECT user_id, event_id, ts, value,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS seen,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
ps AS (SELECT 'u'||user_id||'_'||((rn//12)//1000)||'_'||((rn//12)%1000) AS video_id, user_id, ts, (rn%12)::INT AS pos, seen, value FROM ev),
cl AS (SELECT video_id, user_id, count(*) AS n FROM ps GROUP BY ALL),
attr AS (SELECT video_id, user_id,
    least(n, 12 - floor(5*{u("'clip|'||video_id")}))::INT AS n_keep,
    0.5::DOUBLE + 0.5::DOUBLE*floor({u("'clip|'||video_id", 2)}*4) AS anchor_s,
    (CASE WHEN {u("'clip|'||video_id", 3)} < 0.25 THEN floor({u("'clip|'||video_id", 4)}*5) ELSE floor({u("'user|'||user_id")}*5) END)::INT AS class_code,
    CASE WHEN {u("'user|'||user_id", 2)} < 0.2 THEN 'dev' WHEN {u("'user|'||user_id", 2)} < 0.4 THEN 'train' ELSE 'test' END AS split,
    {u("'leak|'||video_id")} AS lk, {u("'decode|'||video_id")} AS dc, {u("'clip|'||video_id", 3)} AS u3 FROM cl),
raw AS (SELECT video_id, 'u'||user_id AS source_cluster_id, user_id, anchor_s, 20.0::DOUBLE AS fps,
    anchor_s + (n_keep-4)*0.5::DOUBLE AS duration_s, (n_keep-4)*0.5::DOUBLE AS post_anchor_length_s,
    ((anchor_s + (n_keep-4)*0.5::DOUBLE)*20)::BIGINT AS n_frames, class_code, split,
    CASE WHEN lk < 0.03 THEN 'train' ELSE split END AS split_raw,
    CASE WHEN dc < 0.02 THEN 'false' WHEN u3 < 0.5 THEN 'True' ELSE '1' END AS decode_ok, n_keep FROM attr),
man AS (SELECT * FROM raw WHERE lower(decode_ok) IN ('true','1','yes') AND post_anchor_length_s >= 0),
sys(system_id, eta, slope) AS (VALUES {_SYSTEMS}),
cell AS (SELECT s.system_id, p.video_id, p.pos - 3 AS j, p.seen, p.ts, r.class_code, s.eta, s.slope,
    'ans|'||s.system_id||'|'||p.video_id||'|'||(p.pos-3) AS k, 'commit|'||s.system_id||'|'||p.video_id AS pk
    FROM ps p JOIN raw r USING (video_id), sys s),
cell2 AS (SELECT *, system_id LIKE 'commit%' AS isc, {u('k', 1)} AS u1, {u('k', 2)} AS u2, {u('k', 3)} AS u3, 0.30::DOUBLE + 0.69::DOUBLE*{u('k', 4)} AS conf,
    (system_id LIKE 'commit%' AND j >= floor({u('pk', 1)}*8)) AS committed, {u('pk', 2)} AS up FROM cell),
ans0 AS (SELECT system_id, video_id, j::INT AS j, ts, committed, conf,
    (CASE WHEN committed THEN (CASE WHEN up < eta THEN class_code ELSE (class_code+1)%5 END)
      WHEN isc AND j >= 0 THEN -1 WHEN u3 < 0.03 THEN -1
      WHEN u1 < eta + slope*greatest(j,0) THEN class_code ELSE seen END)::INT AS pred
    FROM cell2 WHERE NOT u2 < 0.02),
ans AS (SELECT system_id, video_id, j, 0.5::DOUBLE AS delta_s, pred, committed, ts,
    CASE WHEN pred >= 0 THEN [CASE WHEN pred=0 THEN conf ELSE (1.0::DOUBLE-conf)/4.0::DOUBLE END, CASE WHEN pred=1 THEN conf ELSE (1.0::DOUBLE-conf)/4.0::DOUBLE END,
      CASE WHEN pred=2 THEN conf ELSE (1.0::DOUBLE-conf)/4.0::DOUBLE END, CASE WHEN pred=3 THEN conf ELSE (1.0::DOUBLE-conf)/4.0::DOUBLE END,
      CASE WHEN pred=4 THEN conf ELSE (1.0::DOUBLE-conf)/4.0::DOUBLE END] END AS probs FROM ans0)
"""


def grid(h: float = 3.0, split: str | None = "test", name: str = "g") -> str:
    """Cells of the fixed cohort at the reference protocol, missing ones as no answer."""
    steps = int(h / 0.5)
    where = f"AND split = '{split}'" if split else ""
    return f"""
{name} AS (SELECT s.system_id, m.video_id, m.source_cluster_id, m.class_code AS y, m.post_anchor_length_s AS len, x.j::INT AS j,
    coalesce(a.pred, -1) AS pred, (a.pred IS NOT NULL) AS present, coalesce(a.committed, false) AS committed, a.probs,
    (coalesce(a.pred, -1) = m.class_code) AS ok, m.anchor_s, m.duration_s
    FROM man m, sys s, range(0, {steps + 1}) x(j)
    LEFT JOIN ans a ON a.system_id = s.system_id AND a.video_id = m.video_id AND a.j = x.j
    WHERE m.post_anchor_length_s >= {h} - 1e-9 {where}),
{name}s AS (SELECT *, min(ok::INT) OVER (PARTITION BY system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stable,
    lag(pred) OVER (PARTITION BY system_id, video_id ORDER BY j) AS prev,
    last_value(pred) OVER (PARTITION BY system_id, video_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS term,
    CASE WHEN j IN (0, {steps}) THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS w FROM {name}),
{name}c AS (SELECT system_id, video_id, any_value(source_cluster_id) AS source_cluster_id, any_value(y) AS y, any_value(len) AS len,
    sum(w*(1-stable)) AS delay, sum(w*(1-ok::INT)) AS err, sum(w*(CASE WHEN ok AND stable=0 THEN 1 ELSE 0 END)) AS retr,
    max(CASE WHEN j={steps} THEN ok::INT END) AS endok, max(CASE WHEN j=0 THEN ok::INT END) AS anchorok,
    sum(CASE WHEN prev IS NOT NULL AND prev<>pred THEN 1 ELSE 0 END)::BIGINT AS flips,
    min(CASE WHEN stable=1 THEN j END) AS onset, max(CASE WHEN j={steps} THEN pred END) AS endpred,
    sum((NOT present)::INT)::BIGINT AS missing FROM {name}s GROUP BY system_id, video_id)
"""


def with_base(*parts: str) -> str:
    """``WITH`` clause of the base tables plus further named parts."""
    return "WITH " + ",\n".join([BASE.strip(), *[p.strip() for p in parts]])


def open_grid(split: str | None = "test", name: str = "o") -> str:
    """Cells 0..8 of every clip, cohort or not, with a flag for points inside the clip."""
    where = f"WHERE m.split = '{split}'" if split else ""
    return f"""
{name} AS (SELECT s.system_id, m.video_id, m.source_cluster_id, m.class_code AS y, m.post_anchor_length_s AS len, x.j::INT AS j,
    coalesce(a.pred, -1) AS pred, (a.pred IS NOT NULL) AS present, (coalesce(a.pred, -1) = m.class_code) AS ok,
    (x.j*0.5::DOUBLE <= m.post_anchor_length_s + 1e-9) AS inside
    FROM man m, sys s, range(0, 9) x(j)
    LEFT JOIN ans a ON a.system_id = s.system_id AND a.video_id = m.video_id AND a.j = x.j {where})
"""


_RERUNS = ", ".join(f"('{s}', '{p}', '{rule}')" for s, p, rule, _ in RERUNS)
# Re-runs at twice the step: smoothing (0.35) and commitment (0.8) of every second answer of the parents.
RERUN_SQL = f"""
rrs(system_id, parent, rule) AS (VALUES {_RERUNS}),
rrd AS (SELECT s.system_id, s.rule, v.video_id, x.j, a.probs FROM rrs s JOIN (SELECT DISTINCT system_id, video_id FROM ans WHERE j%2=0) v ON v.system_id=s.parent, range(-1, 5) x(j)
    LEFT JOIN ans a ON a.system_id=s.parent AND a.video_id=v.video_id AND a.j=2*x.j),
rrl AS (SELECT system_id, video_id, list(probs ORDER BY j) AS ps FROM rrd WHERE rule='ema' GROUP BY ALL),
rre AS (SELECT system_id, video_id, j, list_reduce(ps[1:j+2], lambda q, p: CASE WHEN p IS NULL THEN q WHEN q IS NULL THEN p ELSE list_transform(range(1, 6), lambda k: 0.35::DOUBLE*p[k] + 0.65::DOUBLE*q[k]) END) AS q FROM rrl, range(-1, 5) x(j)),
rrf AS (SELECT system_id, video_id, min(j) AS fj, arg_min(list_position(probs, list_max(probs))-1, j) AS lab FROM rrd WHERE rule='msp' AND j>=0 AND list_max(probs) >= 0.8::DOUBLE GROUP BY ALL),
rr AS (SELECT system_id, video_id, j::INT AS j, (CASE WHEN q IS NULL THEN -1 ELSE list_position(q, list_max(q))-1 END)::INT AS pred FROM rre
    UNION ALL SELECT d.system_id, d.video_id, d.j::INT, (CASE WHEN d.j>=fj THEN lab WHEN d.j<0 AND probs IS NOT NULL THEN list_position(probs, list_max(probs))-1 ELSE -1 END)::INT FROM rrd d LEFT JOIN rrf USING (system_id, video_id) WHERE rule='msp')"""


def pgrid(protocols, split: str | None = "test", name: str = "pg", systems: str = "sys", answers: str = "ans") -> str:
    """Cells and clip rows of every protocol, read by absolute time."""
    vals = ", ".join(
        f"('{p.pi_hash}', {p.eps_sys_s}::DOUBLE, {p.eps_jit_sd_s}::DOUBLE, {p.delta_s}::DOUBLE, {p.h_s}::DOUBLE, {p.jit_seed}::BIGINT, {str(p.in_plaus).lower()})"
        for p in protocols)
    where = f"AND m.split = '{split}'" if split else ""
    draw = f"sqrt(-2.0::DOUBLE*ln({u('jit_seed||chr(124)||video_id', 1)}+1.0::DOUBLE/4294967296.0::DOUBLE))*cos(2.0::DOUBLE*pi()*{u('jit_seed||chr(124)||video_id', 2)})"
    return RERUN_SQL + f""",
{name}p(pi_hash, eps_sys_s, eps_jit_sd_s, delta_s, h_s, jit_seed, in_plaus) AS (VALUES {vals}),
{name}j AS (SELECT m.*, p.*, CASE WHEN eps_jit_sd_s > 0 THEN {draw}*eps_jit_sd_s ELSE 0.0::DOUBLE END AS jitter_s FROM man m, {name}p p WHERE true {where}),
{name}e AS (SELECT *, least(greatest(anchor_s+eps_sys_s+jitter_s, 0.0::DOUBLE), duration_s) AS anchor_s_eff,
    abs(least(greatest(anchor_s+eps_sys_s+jitter_s, 0.0::DOUBLE), duration_s) - (anchor_s+eps_sys_s+jitter_s)) > 1e-9 AS anchor_clipped,
    duration_s - least(greatest(anchor_s+eps_sys_s+jitter_s, 0.0::DOUBLE), duration_s) AS leff FROM {name}j),
{name}g AS (SELECT e.*, floor(h_s/delta_s+1e-9)::INT AS steps, unnest(range(0, floor(h_s/delta_s+1e-9)::BIGINT+1))::INT AS j FROM {name}e e WHERE leff >= h_s - 1e-9),
{name}l AS (SELECT *, round_even((anchor_s_eff + j*delta_s - anchor_s)/0.5::DOUBLE, 0)::INT AS base_j,
    round_even((anchor_s_eff + j*delta_s - anchor_s)/1.0::DOUBLE, 0)::INT AS coarse_j, round_even(delta_s/0.5::DOUBLE, 0)=2 AS coarse FROM {name}g),
{name}y AS (SELECT system_id, system_id IN (SELECT system_id FROM rrs) AS again FROM {systems}),
{name} AS (SELECT s.system_id, g.*, g.class_code AS y, coalesce(a.pred,r.pred,-1) AS pred, (coalesce(a.pred,r.pred) IS NOT NULL) AS present, (coalesce(a.pred,r.pred,-1)=g.class_code) AS ok,
    CASE WHEN g.j IN (0, g.steps) THEN g.delta_s/2 ELSE g.delta_s END AS w
    FROM {name}l g CROSS JOIN {name}y s LEFT JOIN {answers} a ON NOT (s.again AND g.coarse) AND a.system_id=s.system_id AND a.video_id=g.video_id AND a.j=g.base_j
    LEFT JOIN rr r ON (s.again AND g.coarse) AND r.system_id=s.system_id AND r.video_id=g.video_id AND r.j=g.coarse_j),
{name}s AS (SELECT *, min(ok::INT) OVER (PARTITION BY pi_hash, system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stable,
    lag(pred) OVER (PARTITION BY pi_hash, system_id, video_id ORDER BY j) AS prev FROM {name}),
{name}c AS (SELECT pi_hash, system_id, video_id, any_value(eps_sys_s) AS eps_sys_s, any_value(eps_jit_sd_s) AS eps_jit_sd_s, any_value(delta_s) AS delta_s,
    any_value(h_s) AS h_s, any_value(in_plaus) AS in_plaus, any_value(source_cluster_id) AS source_cluster_id, any_value(y) AS y, any_value(steps) AS steps,
    sum(w*(1-stable)) AS delay, sum(w*(1-ok::INT)) AS err, max(CASE WHEN j=steps THEN ok::INT END) AS endok,
    CASE WHEN any_value(h_s) >= 1.0-1e-9 AND any_value(steps) >= round_even(1.0::DOUBLE/any_value(delta_s),0) THEN max(CASE WHEN j=round_even(1.0::DOUBLE/delta_s,0) THEN stable END) END AS s1,
    CASE WHEN any_value(h_s) >= 3.0-1e-9 AND any_value(steps) >= round_even(3.0::DOUBLE/any_value(delta_s),0) THEN max(CASE WHEN j=round_even(3.0::DOUBLE/delta_s,0) THEN stable END) END AS s3,
    sum(CASE WHEN prev IS NOT NULL AND prev<>pred THEN 1 ELSE 0 END)::BIGINT AS flips, sum((NOT present)::INT)::BIGINT AS missing
    FROM {name}s GROUP BY pi_hash, system_id, video_id),
{name}m AS (SELECT pi_hash, system_id, avg(a) AS end_macro_acc FROM (SELECT pi_hash, system_id, y, avg(endok) AS a FROM {name}c GROUP BY ALL) GROUP BY ALL),
{name}f AS (SELECT c.pi_hash, c.system_id, any_value(eps_sys_s) AS eps_sys_s, any_value(eps_jit_sd_s) AS eps_jit_sd_s, any_value(delta_s) AS delta_s, any_value(h_s) AS h_s,
    any_value(in_plaus) AS in_plaus, count(*)::BIGINT AS n_clips, avg(delay) AS rmscd, avg(s1) AS s_at_1, avg(s3) AS s_at_3, median(flips)::DOUBLE AS median_flips,
    any_value(m.end_macro_acc) AS end_macro_acc, sum(missing)::BIGINT AS n_missing FROM {name}c c JOIN {name}m m ON m.pi_hash=c.pi_hash AND m.system_id=c.system_id GROUP BY c.pi_hash, c.system_id)
"""


FRAMES = "fman AS (SELECT video_id, source_cluster_id, class_code, split, 0::BIGINT AS first_frame, (anchor_s*20)::BIGINT AS anchor_frame, (duration_s*20)::BIGINT AS last_frame FROM man)"


def fgrid(protocols, split: str | None = "test") -> str:
    """Cells and clip rows of protocols in frames: answers are stored every ten frames, anything between is missing."""
    vals = ", ".join(f"('{p.pi_hash}', {p.eps_sys_f}::BIGINT, {p.eps_jit_sd_f}::DOUBLE, {p.delta_f}::BIGINT, {p.h_f}::BIGINT, {p.jit_seed}::BIGINT)" for p in protocols)
    where = f"WHERE split = '{split}'" if split else ""
    draw = f"sqrt(-2.0::DOUBLE*ln({u('jit_seed||chr(124)||video_id', 1)}+1.0::DOUBLE/4294967296.0::DOUBLE))*cos(2.0::DOUBLE*pi()*{u('jit_seed||chr(124)||video_id', 2)})"
    return FRAMES + f""",
fp(pi_hash, eps_sys_f, eps_jit_sd_f, delta_f, h_f, jit_seed) AS (VALUES {vals}),
fj AS (SELECT m.*, p.*, CASE WHEN eps_jit_sd_f > 0 THEN {draw}*eps_jit_sd_f ELSE 0.0::DOUBLE END AS jitter_raw_f FROM fman m, fp p {where}),
fk AS (SELECT *, round_even(jitter_raw_f, 0)::BIGINT AS jitter_f, anchor_frame + eps_sys_f + round_even(jitter_raw_f, 0)::BIGINT AS wanted FROM fj),
fe AS (SELECT *, least(greatest(wanted, first_frame), last_frame) AS anchor_frame_eff, last_frame - least(greatest(wanted, first_frame), last_frame) AS leff FROM fk),
fg AS (SELECT e.*, (h_f//delta_f)::INT AS steps, unnest(range(0, h_f//delta_f + 1))::INT AS j FROM fe e WHERE leff >= h_f),
fl AS (SELECT *, anchor_frame_eff + j*delta_f - anchor_frame AS off FROM fg),
fx AS (SELECT s.system_id, l.*, class_code AS y, coalesce(a.pred, -1) AS pred, a.pred IS NOT NULL AS present, off%10 <> 0 AS off_grid, coalesce(a.pred, -1) = class_code AS ok, coalesce(a.committed, false) AS committed
    FROM fl l CROSS JOIN sys s LEFT JOIN ans a ON off%10 = 0 AND a.system_id=s.system_id AND a.video_id=l.video_id AND a.j=off//10),
fs AS (SELECT *, min(ok::INT) OVER w1 AS stable, lag(pred) OVER w0 AS prev FROM fx WINDOW w0 AS (PARTITION BY pi_hash, system_id, video_id ORDER BY j),
    w1 AS (PARTITION BY pi_hash, system_id, video_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fb AS (SELECT system_id, video_id, min(j) AS jmin, max(j) AS jmax FROM ans GROUP BY ALL),
ft AS (SELECT b.system_id, m.video_id, coalesce(a.pred, -1) AS tail FROM fman m JOIN fb b USING (video_id) LEFT JOIN ans a ON a.system_id=b.system_id AND a.video_id=m.video_id AND a.j=greatest(least((last_frame-anchor_frame)//10, jmax), jmin)),
fc AS (SELECT pi_hash, fs.system_id, fs.video_id, any_value(y) AS y, any_value(h_f) AS h_f, any_value(delta_f) AS delta_f, any_value(steps) AS steps,
    sum((CASE WHEN j IN (0, steps) THEN delta_f/2.0::DOUBLE ELSE delta_f::DOUBLE END)*(1-stable)) AS delay, max(CASE WHEN j=steps THEN ok::INT END) AS endok,
    sum(CASE WHEN prev IS NOT NULL AND prev<>pred THEN 1 ELSE 0 END)::BIGINT AS flips, sum((NOT present)::INT)::BIGINT AS missing, sum(off_grid::INT)::BIGINT AS off, count(*) AS cells,
    min(CASE WHEN committed THEN j END) AS cj, arg_min(pred, j) FILTER (committed) AS cp, (coalesce(any_value(ft.tail), -1) = any_value(y))::INT AS tailok
    FROM fs LEFT JOIN ft ON ft.system_id=fs.system_id AND ft.video_id=fs.video_id GROUP BY pi_hash, fs.system_id, fs.video_id),
fm AS (SELECT pi_hash, system_id, avg(d) AS d, avg(e) AS e, avg(t) AS t FROM (SELECT pi_hash, system_id, y, avg(delay) AS d, avg(endok) AS e, avg(tailok) AS t FROM fc GROUP BY ALL) GROUP BY ALL)
"""

"""DuckDB SQL for the queries of this package, written from each operator's meaning."""

from __future__ import annotations

_FR = """fr AS (
  SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame,
         epoch_us(ts) AS t_us, event_id, event_type, value FROM events
)"""

_SHOTS = """rd AS (SELECT session_id, frame, CAST(floor(value) AS INTEGER) % 31 AS reading FROM fr WHERE event_type <> 'error'),
st AS (SELECT session_id, frame, lag(reading) OVER (PARTITION BY session_id ORDER BY frame) - reading AS step FROM rd),
dec AS (SELECT session_id, frame, CAST(unnest(range(1, step + 1)) AS INTEGER) AS nth FROM st WHERE step BETWEEN 1 AND 3)"""

_HITS = """sc AS (SELECT session_id, frame, value AS score, value >= 80 AS lit FROM fr WHERE event_type <> 'error' AND value IS NOT NULL),
ed AS (SELECT *, coalesce(lag(lit) OVER (PARTITION BY session_id ORDER BY frame), false) AS was FROM sc),
edge AS (SELECT session_id, frame, score FROM ed WHERE lit AND NOT was)"""


def _matching(shots: str, hits: str) -> str:
    """CTEs pairs, m (matches) and w (whiffs) from tables of shots (si, frame) and hits (hi, frame)."""
    return f"""pairs AS (
  SELECT s.session_id, si, hi, CAST(abs(s.frame - h.frame) AS INTEGER) AS dist,
         row_number() OVER (PARTITION BY s.session_id ORDER BY abs(s.frame - h.frame), si, hi) AS k
  FROM {shots} s JOIN {hits} h ON s.session_id = h.session_id AND abs(s.frame - h.frame) <= 2
), fold AS (
  SELECT DISTINCT session_id, 0::BIGINT AS k, []::INTEGER[] AS ss, []::INTEGER[] AS hh FROM pairs
  UNION ALL
  SELECT f.session_id, p.k,
         CASE WHEN list_contains(ss, si) OR list_contains(hh, hi) THEN ss ELSE list_append(ss, si) END,
         CASE WHEN list_contains(ss, si) OR list_contains(hh, hi) THEN hh ELSE list_append(hh, hi) END
  FROM fold f JOIN pairs p ON p.session_id = f.session_id AND p.k = f.k + 1
), m AS (
  SELECT session_id, unnest(arg_max(ss, k)) AS si, unnest(arg_max(hh, k)) AS hi FROM fold GROUP BY session_id
), w AS (
  SELECT session_id, si, frame FROM {shots} s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.session_id = s.session_id AND m.si = s.si)
)"""


_CLICKS = """cs AS (SELECT session_id, frame, CAST(row_number() OVER (PARTITION BY session_id ORDER BY frame) - 1 AS INTEGER) AS si FROM fr WHERE event_type = 'click'),
ph AS (SELECT session_id, frame, CAST(row_number() OVER (PARTITION BY session_id ORDER BY frame) - 1 AS INTEGER) AS hi FROM fr WHERE event_type = 'purchase')"""

_EVENTS = (
    f"WITH RECURSIVE {_FR}, {_SHOTS}, {_HITS}, "
    "ss_ AS (SELECT session_id, frame, CAST(row_number() OVER (PARTITION BY session_id ORDER BY frame, nth) - 1 AS INTEGER) AS si FROM dec), "
    "hh_ AS (SELECT session_id, frame, CAST(row_number() OVER (PARTITION BY session_id ORDER BY frame) - 1 AS INTEGER) AS hi FROM edge), "
    + _matching("ss_", "hh_")
    + """, ev AS (
  SELECT session_id, frame, 'shot' AS type FROM ss_ UNION ALL SELECT session_id, frame, 'whiff' FROM w UNION ALL SELECT session_id, frame, 'hit' FROM hh_
  UNION ALL SELECT session_id, frame, CASE event_type WHEN 'purchase' THEN 'kill' ELSE 'target_spawn' END FROM fr WHERE event_type IN ('purchase', 'signup')
), n AS (SELECT session_id, CAST(count(*) AS INTEGER) AS n FROM fr GROUP BY 1),
g0 AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY session_id ORDER BY frame, type) > 8 THEN 1 ELSE 0 END AS new FROM ev),
g1 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY frame, type ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM g0),
an AS (SELECT session_id, group_no, min(frame) AS anchor FROM g1 GROUP BY 1, 2),
wi AS (SELECT an.*, n,
         CASE WHEN n <= 30 THEN 0 ELSE greatest(0, least(anchor - 19, n - 30)) END AS lo,
         CASE WHEN n <= 30 THEN n ELSE greatest(0, least(anchor - 19, n - 30)) + 30 END AS hi FROM an JOIN n USING (session_id)),
e1 AS (SELECT wi.session_id, wi.group_no, anchor, lo, hi, frame, type, frame >= lo AND frame < hi AS inside FROM wi JOIN g1 USING (session_id, group_no) WHERE hi - lo >= 4),
e2 AS (SELECT *, min(CASE WHEN type = 'shot' AND inside THEN frame END) OVER (PARTITION BY session_id, group_no) AS first_shot FROM e1),
eg AS (SELECT session_id, group_no, anchor, lo, hi, list_sort(list(DISTINCT type)) AS types,
         CAST(count(*) FILTER (WHERE type = 'shot' AND inside) AS INTEGER) AS n_shots, CAST(count(*) FILTER (WHERE type = 'hit') AS INTEGER) AS n_hits,
         min(first_shot) AS first_shot, max(CASE WHEN type = 'target_spawn' AND inside AND frame <= first_shot THEN frame END) AS last_spawn
       FROM e2 GROUP BY ALL)"""
)

_LABEL = "CASE WHEN list_contains(types, 'whiff') AND list_contains(types, 'death') THEN 'whiff_then_death' WHEN list_contains(types, 'kill') THEN 'kill' WHEN list_contains(types, 'whiff') THEN 'whiff' ELSE 'clean_rep' END"
_DETECTED = "array_to_string(list_sort(list_distinct(list_transform(types, lambda t: CASE t WHEN 'shot' THEN 'ammo_decrement' WHEN 'whiff' THEN 'ammo_decrement' WHEN 'hit' THEN 'hitmarker' WHEN 'kill' THEN 'killfeed' ELSE 'target_color' END))), ',')"

_TR = f"""WITH {_FR}, mo AS (SELECT session_id AS clip_id, frame AS i, value - 50 AS dx, value % 7 - 3 AS dy, event_type <> 'error' AS ok FROM fr),
ac AS (SELECT *, sum(CASE WHEN ok THEN dx ELSE 0.0 END) OVER w AS x_px, sum(CASE WHEN ok THEN dy ELSE 0.0 END) OVER w AS y_px FROM mo WINDOW w AS (PARTITION BY clip_id ORDER BY i)),
an AS (SELECT clip_id, i, i * 1000.0::DOUBLE / 60 AS t_ms, degrees(atan(x_px / (960 / tan(radians(103.0) / 2)))) AS yaw, degrees(atan(y_px / (960 / tan(radians(103.0) / 2)))) AS pitch FROM ac),
df AS (SELECT *, yaw - lag(yaw) OVER w AS dyaw, pitch - lag(pitch) OVER w AS dpitch, t_ms - lag(t_ms) OVER w AS dt FROM an WINDOW w AS (PARTITION BY clip_id ORDER BY i)),
sp AS (SELECT *, CASE WHEN dt IS NULL THEN 0.0 ELSE sqrt(dyaw * dyaw + dpitch * dpitch) / (dt / 1000) END AS speed FROM df),
ns AS (SELECT clip_id, count(*) AS n, CAST(count(*) - 1 - clip_id % 5 AS INTEGER) AS shot_idx FROM sp GROUP BY clip_id)"""

_USER = f"""WITH {_FR}, um AS (
  SELECT session_id % 10 AS session_id, session_id AS idx, avg(value) AS rt, CAST(count(*) FILTER (WHERE event_type = 'error') % 4 AS INTEGER) AS over_,
         max(value) / 1000 AS jr, count(*) FILTER (WHERE event_type = 'click') AS fired, count(*) FILTER (WHERE event_type = 'purchase') AS hit, min(value) AS eff
  FROM fr GROUP BY fr.session_id
), z AS (
  SELECT *, CASE WHEN stddev_pop(rt) OVER p >= 1e-9 THEN (rt - avg(rt) OVER p) / stddev_pop(rt) OVER p ELSE 0 END AS zrt,
         CASE WHEN stddev_pop(jr) OVER p >= 1e-9 THEN (jr - avg(jr) OVER p) / stddev_pop(jr) OVER p ELSE 0 END AS zjr
  FROM um WINDOW p AS (PARTITION BY session_id)
)"""

_HASH = """hs AS (
  SELECT vec_id, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > list_sort(embedding[2:64])[32] THEN '1' ELSE '0' END), '') AS bits FROM embeddings
)"""

_REQ = """rq AS (
  SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'large' WHEN 'user' THEN 'small' ELSE 'unlisted' END AS model, length(coalesce(text, '')) // 4 AS tok FROM conversations
), pr AS (
  SELECT *, CASE model WHEN 'small' THEN 300.0 WHEN 'large' THEN 900.0 ELSE 0.0 END::DOUBLE AS rate_in, CASE model WHEN 'small' THEN 20.0 WHEN 'large' THEN 90.0 ELSE 0.0 END::DOUBLE AS rate_out FROM rq
), us AS (SELECT *, tok / 1e6 * rate_in + 0.0004::DOUBLE * rate_out AS usd FROM pr)"""

_KEYED = """kd AS (
  SELECT doc_id, lang, sha256(coalesce(sha256(text), '') || '|clip_v1|' || coalesce(source, '') || '|clip_analysis/v1') AS key FROM documents
), ca AS (
  SELECT key, lang || ':' || toxic AS payload, CAST(doc_id AS DOUBLE) AS created_at FROM kd JOIN labels USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id DESC, lang || ':' || toxic DESC) = 1
)"""

SQL: dict[str, str] = {
    "counter_decrement": f"WITH {_FR}, {_SHOTS} SELECT * FROM dec",
    "rising_edge": f"WITH {_FR}, {_HITS} SELECT * FROM edge",
    "phash_bits": f"WITH {_HASH} SELECT vec_id, bits FROM hs",
    "hamming_neardup": f"""WITH RECURSIVE {_HASH}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM hs),
f AS (
  SELECT DISTINCT label, 0::BIGINT AS k, []::VARCHAR[] AS seen, []::BIGINT[] AS ids FROM o
  UNION ALL
  SELECT f.label, o.k, CASE WHEN dup THEN seen ELSE list_append(seen, bits)[-64:] END, CASE WHEN dup THEN ids ELSE list_append(ids, vec_id) END
  FROM f JOIN o ON o.label = f.label AND o.k = f.k + 1,
  LATERAL (SELECT len(list_filter(seen, lambda s: hamming(s, bits) <= 24)) > 0 AS dup)
) SELECT label, unnest(arg_max(ids, k)) AS vec_id FROM f GROUP BY label""",
    "feed_persistence": f"""WITH {_FR}, h AS (SELECT session_id, frame, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS slot, CAST(floor(value / 20) AS INTEGER) AS hash FROM fr),
f AS (SELECT *, CASE WHEN frame - lag(frame) OVER w = 1 AND bit_count(xor(hash, lag(hash) OVER w)) <= 1 THEN 0 ELSE 1 END AS starts FROM h WINDOW w AS (PARTITION BY session_id, slot ORDER BY frame)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY session_id, slot ORDER BY frame) AS run FROM f),
c AS (SELECT *, row_number() OVER w AS k, min(frame) OVER w AS began FROM r WINDOW w AS (PARTITION BY session_id, slot, run ORDER BY frame))
SELECT session_id, slot, began AS frame, frame AS confirmed FROM c WHERE k = 2""",
    "slot_assignment": """SELECT l_orderkey AS session_id, l_linenumber AS "row", CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS slot
FROM lineitem WHERE l_quantity >= 6.0 AND l_discount * 10 >= 0.3""",
    "bg_uniformity": """WITH b AS (SELECT l_suppkey, CAST(trunc(l_quantity) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_suppkey, bin AS mode FROM b QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, bin) = 1)
SELECT l_suppkey, mode, round(sum(CASE WHEN abs(bin - mode) <= 12 THEN n ELSE 0 END) / sum(n), 6) AS uniformity FROM b JOIN m USING (l_suppkey) GROUP BY 1, 2""",
    "persistence_spawn": """WITH RECURSIVE dy AS (SELECT user_id AS session_id, CAST(ts AS DATE) AS day, count(*) AS c FROM events GROUP BY 1, 2),
o AS (SELECT session_id, row_number() OVER w AS k, c, min(c) OVER (PARTITION BY session_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS low,
        count(*) OVER (PARTITION BY session_id) AS n FROM dy WINDOW w AS (PARTITION BY session_id ORDER BY day)),
f AS (SELECT DISTINCT session_id, 0::BIGINT AS k, 0::BIGINT AS conf, false AS hit, 0::BIGINT AS c, 0::BIGINT AS n FROM o
  UNION ALL
  SELECT f.session_id, o.k, CASE WHEN o.n - o.k < 6 THEN conf WHEN o.c > conf AND low >= o.c THEN o.c WHEN o.c < conf THEN o.c ELSE conf END,
         o.n - o.k >= 6 AND o.c > conf AND low >= o.c, o.c, o.n
  FROM f JOIN o ON o.session_id = f.session_id AND o.k = f.k + 1),
h AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS found FROM f WHERE hit)
SELECT session_id, CAST(k - 1 AS INTEGER) AS frame, c AS n_targets FROM h WHERE found <= n // 6 // 2""",
    "centroid_area": """SELECT p_brand, count(*) AS area, round(avg(p_size::DOUBLE), 6) AS cx, round(avg(p_retailprice), 4) AS cy FROM part
WHERE p_size BETWEEN 5 AND 40 AND p_retailprice BETWEEN 905 AND 1500 GROUP BY 1 HAVING count(*) >= 3""",
    "ncc_classify": """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings),
t AS (SELECT label, p, avg(v) AS m FROM x GROUP BY 1, 2),
c AS (SELECT x.vec_id, t.label, corr(x.v, t.m) AS r FROM x JOIN t USING (p) GROUP BY 1, 2)
SELECT vec_id, label, round(r, 6) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, label) = 1""",
    "read_digits": """SELECT l_orderkey, CASE WHEN min(0.40::DOUBLE + l_tax) >= 0.405::DOUBLE THEN try_cast(string_agg(CAST(CAST(trunc(l_quantity) AS INTEGER) % 10 AS VARCHAR), '' ORDER BY l_linenumber, CAST(trunc(l_quantity) AS INTEGER) % 10) AS BIGINT) END AS value,
round(avg(0.40::DOUBLE + l_tax), 6) AS confidence FROM lineitem GROUP BY 1""",
    "band_pairs": f"WITH RECURSIVE {_FR}, {_CLICKS}, {_matching('cs', 'ph')} SELECT session_id, si, hi, dist FROM pairs",
    "band_match": f"WITH RECURSIVE {_FR}, {_CLICKS}, {_matching('cs', 'ph')} SELECT session_id, si, hi, dist FROM m JOIN pairs USING (session_id, si, hi)",
    "band_match_whiff": f"""WITH RECURSIVE {_FR}, {_CLICKS}, {_matching('cs', 'ph')}
SELECT session_id, frame, 'shot' AS type FROM cs UNION ALL SELECT session_id, frame, 'whiff' FROM w UNION ALL SELECT session_id, frame, 'hit' FROM ph""",
    "asof_stimulus": f"""WITH {_FR} SELECT c.session_id, c.event_id, v.event_id AS stimulus
FROM (SELECT * FROM fr WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM fr WHERE event_type = 'view') v ON c.session_id = v.session_id AND c.t_us >= v.t_us""",
    "sessionize": f"""WITH {_FR}, g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY session_id ORDER BY t_us, event_id) > 43200000000 THEN 1 ELSE 0 END AS new FROM fr),
h AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS BIGINT) AS group_no FROM g)
SELECT session_id, group_no, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us FROM h GROUP BY 1, 2""",
    "session_window_native": f"""WITH {_FR}, g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY session_id ORDER BY t_us, event_id) > 43200000000 THEN 1 ELSE 0 END AS new FROM fr),
h AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS group_no FROM g)
SELECT session_id, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS n FROM h GROUP BY session_id, group_no""",
    "clip_window": f"""WITH {_FR}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM fr)
SELECT session_id, frame, CAST(CASE WHEN n <= 30 THEN 0 ELSE greatest(0, least(frame - 19, n - 30)) END AS INTEGER) AS lo,
       CAST(CASE WHEN n <= 30 THEN n ELSE greatest(0, least(frame - 19, n - 30)) + 30 END AS INTEGER) AS hi FROM n""",
    "engagements": f"{_EVENTS} SELECT session_id, group_no, anchor, lo, hi, array_to_string(types, ',') AS type_set, n_shots, n_hits, first_shot, last_spawn FROM eg",
    "window_merge": f"""{_EVENTS} SELECT session_id, lo, hi, min(group_no) AS group_no, arg_min(n_shots, group_no) AS n_shots, arg_min(n_hits, group_no) AS n_hits,
array_to_string(arg_min(types, group_no), ',') AS type_set, array_to_string(list_sort(list_distinct(flatten(list(types)))), ',') AS all_types FROM eg GROUP BY 1, 2, 3""",
    "label_case": f"""{_EVENTS} SELECT session_id, group_no, {_LABEL} AS with_hits, CASE WHEN list_contains(types, 'kill') THEN 'kill' ELSE 'tracking_phase' END AS without_hits,
{_DETECTED} AS detected_by FROM eg""",
    "detector_lookup": """SELECT CASE event_type WHEN 'click' THEN 'shot' WHEN 'purchase' THEN 'kill' WHEN 'signup' THEN 'target_spawn' END AS kind,
CASE event_type WHEN 'click' THEN 'ammo_decrement' WHEN 'purchase' THEN 'killfeed' WHEN 'signup' THEN 'target_color' END AS detector, count(*) AS n FROM events GROUP BY 1, 2""",
    "trace_cumsum_gate": f"{_TR} SELECT clip_id, i, round(x_px, 4) AS x_px, round(y_px, 4) AS y_px FROM ac",
    "trace_angles": f"{_TR} SELECT clip_id, i, round(t_ms, 4) AS t_ms, round(yaw, 6) AS yaw_deg, round(pitch, 6) AS pitch_deg FROM an",
    "trace_speed": f"{_TR} SELECT clip_id, i, round(speed, 4) AS speed_dps FROM sp",
    "trace_confidence": f"{_TR} SELECT clip_id, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS confidence FROM mo WHERE i >= 1 GROUP BY 1",
    "motion_gate": """SELECT trunc(l_quantity) >= 24 AND CASE WHEN l_partkey % 200 > 0 THEN trunc(l_quantity) / (l_partkey % 200) ELSE 0 END >= 0.18 AND l_discount * 2 >= 0.13 AS ok, count(*) AS n FROM lineitem GROUP BY 1""",
    "inlier_spread": "SELECT p_brand, round(CASE WHEN count(*) > 1 THEN least(stddev_pop(p_size::DOUBLE) / 50, stddev_pop(p_retailprice) / 2000) ELSE 0 END, 6) AS spread FROM part GROUP BY 1",
    "path_efficiency": f"""{_TR}, c AS (SELECT * FROM sp JOIN ns USING (clip_id) WHERE i <= shot_idx)
SELECT clip_id, round(CASE WHEN sum(sqrt(dyaw * dyaw + dpitch * dpitch)) FILTER (WHERE i > 0) > 1e-9
  THEN least(1.0, sqrt(power(arg_max(yaw, i) - arg_min(yaw, i), 2) + power(arg_max(pitch, i) - arg_min(pitch, i), 2)) / sum(sqrt(dyaw * dyaw + dpitch * dpitch)) FILTER (WHERE i > 0)) ELSE 0.0 END, 6) AS path_efficiency
FROM c GROUP BY 1""",
    "placement_peak": f"{_TR} SELECT clip_id, round(avg(abs(pitch)), 6) AS placement_error_deg, round(max(abs(yaw)), 6) AS peak_error_deg FROM an GROUP BY 1",
    "overshoot": f"""{_TR}, c AS (SELECT sp.*, shot_idx, speed < 20 AS quiet FROM sp JOIN ns USING (clip_id) WHERE shot_idx > 0 AND shot_idx < n AND i <= shot_idx),
b AS (SELECT c.clip_id, max(c.i) AS b FROM c JOIN c AS e ON e.clip_id = c.clip_id AND e.i = c.shot_idx WHERE c.i = 0 OR e.t_ms - c.t_ms >= 600 GROUP BY 1),
mm AS (SELECT clip_id, b, max(i) AS m FROM c JOIN b USING (clip_id) WHERE NOT quiet OR i <= b GROUP BY 1, 2),
rr AS (SELECT mm.clip_id, coalesce(max(c.i), any_value(mm.b)) AS r FROM mm LEFT JOIN c ON c.clip_id = mm.clip_id AND c.i > mm.b AND c.i + 8 <= mm.m
  AND NOT EXISTS (SELECT 1 FROM c AS q WHERE q.clip_id = c.clip_id AND q.i BETWEEN c.i AND c.i + 8 AND NOT q.quiet) GROUP BY 1),
v AS (SELECT c.clip_id, c.i, CASE WHEN c.i > r THEN dyaw END AS v, count(*) OVER (PARTITION BY c.clip_id) AS size FROM c JOIN rr USING (clip_id) WHERE c.i >= r),
k AS (SELECT *, max(abs(v)) OVER (PARTITION BY clip_id) AS top FROM v WHERE size >= 3 AND v IS NOT NULL),
t AS (SELECT clip_id, CASE WHEN sign(v) <> lag(sign(v)) OVER (PARTITION BY clip_id ORDER BY i) THEN 1 ELSE 0 END AS turn FROM k WHERE abs(v) > top * 0.08::DOUBLE)
SELECT ns.clip_id, CAST(coalesce(sum(turn), 0) AS INTEGER) AS overshoot_count FROM ns LEFT JOIN t USING (clip_id) GROUP BY 1""",
    "target_switch": f"""{_TR}, c AS (SELECT clip_id, i, t_ms, n, shot_idx - 40 AS f, sum(CASE WHEN speed < 120 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS slow FROM sp JOIN ns USING (clip_id))
SELECT clip_id, round(min(CASE WHEN i > f AND slow = 3 AND f < n - 3 THEN t_ms END) - max(CASE WHEN i = f THEN t_ms END), 4) AS target_switch_ms FROM c WHERE f >= 0 GROUP BY 1""",
    "reversals": f"""{_TR}, v AS (SELECT clip_id, i, sign(dyaw) AS s, speed >= 20 AS moving FROM sp),
w AS (SELECT *, lag(s) OVER p AS ls, lag(moving) OVER p AS lm FROM v WINDOW p AS (PARTITION BY clip_id ORDER BY i))
SELECT clip_id, i FROM w WHERE s * ls < 0 AND moving AND lm""",
    "sparc": f"""{_TR}, sh AS (SELECT clip_id, count(*) AS n, sum(speed) AS total, power(2, ceil(log2(count(*))) + 4)::BIGINT AS nfft FROM sp GROUP BY 1 HAVING count(*) >= 4 AND max(speed) > 0),
bn AS (SELECT clip_id, total, nfft, unnest(range(0, CAST(floor(nfft * 10 / 60.0) AS BIGINT) + 1)) AS k FROM sh),
ft AS (SELECT bn.clip_id, k, any_value(k * 60.0::DOUBLE / nfft) AS f, sqrt(power(sum(speed * cos(2 * pi() * ((k * i) % nfft) / nfft)), 2) + power(sum(speed * sin(2 * pi() * ((k * i) % nfft) / nfft)), 2)) / any_value(total) AS m
  FROM bn JOIN sp USING (clip_id) GROUP BY 1, 2),
rg AS (SELECT clip_id, min(k) AS k0, max(k) AS k1 FROM ft WHERE m >= 0.05::DOUBLE GROUP BY 1),
ar AS (SELECT ft.clip_id, f - lag(f) OVER w AS df, m - lag(m) OVER w AS dm, max(f) OVER (PARTITION BY ft.clip_id) - min(f) OVER (PARTITION BY ft.clip_id) AS span FROM ft JOIN rg ON ft.clip_id = rg.clip_id AND k BETWEEN k0 AND k1 WINDOW w AS (PARTITION BY ft.clip_id ORDER BY k)),
ln AS (SELECT clip_id, -sum(sqrt(power(df / span, 2) + dm * dm)) AS s FROM ar WHERE df IS NOT NULL AND span > 0 GROUP BY 1)
SELECT ns.clip_id, round(coalesce(s, 0.0), 6) AS sparc FROM ns LEFT JOIN ln USING (clip_id)""",
    "hann_window": "SELECT CAST(i AS INTEGER) AS i, round(0.5 - 0.5 * cos(2 * pi() * i / 64), 6) AS periodic, round(0.5 - 0.5 * cos(2 * pi() * i / 63), 6) AS symmetric FROM range(64) t(i)",
    "reaction_time": f"""WITH {_FR} SELECT c.session_id, c.frame AS shot, round((c.frame - s.frame) * 1000.0 / 60, 4)::DOUBLE AS ms, round(1000.0 / 60, 4)::DOUBLE AS error_ms
FROM (SELECT * FROM fr WHERE event_type = 'click') c ASOF JOIN (SELECT * FROM fr WHERE event_type = 'signup') s ON c.session_id = s.session_id AND c.frame >= s.frame""",
    "zscore": f"{_USER} SELECT session_id, idx, round(zrt, 6) AS z FROM z",
    "coachability": f"{_USER} SELECT session_id, idx, round(2 * abs(zrt) + 1.5 * over_ + 1.5 * zjr + (fired - hit) / greatest(1, fired)::DOUBLE + CASE WHEN over_ = 3 THEN 1 ELSE 0 END, 6) AS score FROM z",
    "diverse_topk": """WITH RECURSIVE g AS (
  SELECT label, list(vec_id ORDER BY vec_id) AS ids, list(embedding::DOUBLE[] ORDER BY vec_id) AS vecs, list((vec_id * 7919 % 1000 / 100.0)::DOUBLE ORDER BY vec_id) AS first, count(*) AS n FROM embeddings GROUP BY 1
), f AS (
  SELECT label, 0 AS pick, first AS scores, 0::BIGINT AS place, 0.0::DOUBLE AS score, []::BIGINT[] AS taken FROM g
  UNION ALL
  SELECT f.label, pick + 1, list_transform(range(1, n + 1), lambda i: CASE WHEN i = pos THEN '-inf'::DOUBLE ELSE scores[i] - 50 * exp(-list_distance(vecs[i], vecs[pos])) END), pos, scores[pos], list_append(taken, pos)
  FROM f JOIN g USING (label), LATERAL (SELECT list_position(scores, list_max(scores))::BIGINT AS pos) WHERE pick < least(8, n)
), l AS (SELECT label, arg_max(taken, pick) AS all_taken, max(pick) AS last FROM f GROUP BY 1),
c AS (SELECT g.label, list_position(first, list_min(first)) AS calm, list_min(first) AS low, ids, n, all_taken, last FROM g JOIN l USING (label))
SELECT label, ids[CASE WHEN pick = last AND n > 8 AND NOT list_contains(all_taken, calm) THEN calm ELSE place END] AS vec_id, pick,
       round(CASE WHEN pick = last AND n > 8 AND NOT list_contains(all_taken, calm) THEN low ELSE score END, 6) AS score FROM f JOIN c USING (label) WHERE pick > 0""",
    "band_compare": f"""{_USER}, u AS (SELECT session_id, idx, unnest(['reaction_time_ms', 'jitter_ratio', 'overshoot_count', 'path_efficiency']) AS metric, unnest([rt, jr, over_::DOUBLE, eff]) AS value,
  unnest([180.0, 0.05, 0, 0.85]::DOUBLE[]) AS lo, unnest([250.0, 0.15, 1, 1.0]::DOUBLE[]) AS hi FROM um)
SELECT session_id, idx, metric, round(value, 6) AS value, CASE WHEN value < lo THEN 'below' WHEN value > hi THEN 'above' ELSE 'within' END AS verdict FROM u WHERE value IS NOT NULL""",
    "record_build": f"""{_EVENTS} SELECT 'clip_analysis/v1' AS schema_version, session_id || ':' || group_no AS clip_id, session_id::VARCHAR AS session_id, lo * 100::BIGINT AS start_ms, hi * 100::BIGINT AS end_ms, '1920x1080' AS resolution,
{_LABEL} AS event_type, {_DETECTED} AS detected_by, n_shots AS shots_fired, NULL::DOUBLE AS jitter_ratio, 'skipped' AS ai_status,
CAST(1 + CASE WHEN n_shots > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_warnings FROM eg""",
    "record_json": f"{_EVENTS} SELECT session_id || ':' || group_no AS clip_id, {_LABEL} AS event_type, n_hits AS shots_hit, true AS nulls_kept FROM eg",
    "record_validate": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN source IS NULL THEN 'confidence,drill,evidence,not_determinable,primary_weakness,severity' ELSE 'confidence,evidence,not_determinable,primary_weakness,severity' END
WHEN 1 THEN '' ELSE 'confidence,drill,evidence,not_determinable,primary_weakness,severity,summary' END AS missing FROM documents""",
    "summary_table": f"""{_EVENTS} SELECT session_id || ':' || group_no AS clip_id, rpad(lo * 100 || '-' || hi * 100, 16, ' ') || rpad({_LABEL}, 17, ' ') || rpad(n_shots::VARCHAR, 7, ' ')
|| rpad(CASE WHEN last_spawn IS NULL THEN 'not measurable' ELSE (first_shot - last_spawn) * 100 || '+-100ms' END, 17, ' ') || rpad('-', 8, ' ') || rpad('0', 6, ' ') || '-' AS line FROM eg""",
    "distinct_warnings": f"""{_EVENTS} SELECT DISTINCT warning FROM (
SELECT 'fps=10 cannot resolve the 8Hz jitter band (Nyquist 5Hz)' AS warning FROM eg
UNION ALL SELECT 'fps=10 too low for reaction time; quantization +/-50.0ms exceeds useful resolution' FROM eg WHERE n_shots > 0 AND last_spawn IS NOT NULL
UNION ALL SELECT 'reaction_time unavailable: no stimulus onset detected (needs target-spawn detection or an enemy detector)' FROM eg WHERE n_shots > 0 AND last_spawn IS NULL)""",
    "overlay_names": f"""{_EVENTS} SELECT session_id, session_id || ':' || group_no AS clip_id, lpad((row_number() OVER (PARTITION BY session_id ORDER BY lo, session_id || ':' || group_no))::VARCHAR, 2, '0') || '_' || lo * 100 // 1000 || 's_' || {_LABEL} || '.png' AS name FROM eg""",
    "trace_serialize": f"{_TR} SELECT clip_id, CAST(count(*) AS INTEGER) AS n, round(sum(round(yaw, 3)), 3) AS yaw_sum, round(max(t_ms), 1) AS last_ms FROM an GROUP BY 1",
    "content_hash": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS content_sha256 FROM t WHERE i % 4 = 0 GROUP BY 1""",
    "weakness_synthesis": """SELECT source AS session_id, lang AS primary_weakness, count(*) AS n, round(avg(1 + quality + 2 * toxic), 6) AS severity, round(count(*) * avg(1 + quality + 2 * toxic), 6) AS weight
FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2 HAVING count(*) >= 3""",
    "token_estimate": "SELECT doc_id, CAST(length(coalesce(text, '')) // 4 + length(coalesce(lang, '')) // 4 AS BIGINT) AS tokens FROM documents",
    "image_tokens": "SELECT p_partkey, CAST(floor(ceil(p_size * 20 / 28.0) * ceil(p_size * 11 / 28.0) * 1.15::DOUBLE) AS BIGINT) AS tokens FROM part",
    "price_join": f"WITH {_REQ} SELECT conv_id, turn, rate_in, round(usd, 6) AS usd, printf('~$%.3f · %d clips · %s', round(usd, 3), 8, model) AS label FROM us",
    "budget_admission": f"""WITH RECURSIVE {_REQ}, o AS (SELECT conv_id, turn, conv_id % 7 AS b, round(usd, 6) AS usd, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id, turn) AS k FROM us),
f AS (SELECT DISTINCT b, 0::BIGINT AS k, -1::BIGINT AS conv_id, -1::BIGINT AS turn, 0.0::DOUBLE AS month, 0.0::DOUBLE AS sess, NULL::BOOLEAN AS admitted, NULL::VARCHAR AS reason, 0.0::DOUBLE AS spent_before FROM o
  UNION ALL
  SELECT f.b, o.k, o.conv_id, o.turn, CASE WHEN why IS NULL THEN month + usd ELSE month END, CASE WHEN why IS NULL THEN cur + usd ELSE cur END, why IS NULL, why, cur
  FROM f JOIN o ON o.b = f.b AND o.k = f.k + 1, LATERAL (SELECT CASE WHEN o.conv_id = f.conv_id THEN sess ELSE 0 END AS cur) x,
  LATERAL (SELECT CASE WHEN cur + usd > 0.5 THEN 'session limit' WHEN month + usd > 3.0 THEN 'month limit' END AS why) y)
SELECT conv_id, turn, admitted, reason, round(spent_before, 6) AS spent_before FROM f WHERE k > 0""",
    "token_bucket": f"""WITH RECURSIVE {_REQ}, o AS (SELECT conv_id, turn, conv_id % 7 AS b, row_number() OVER w AS k, (row_number() OVER w * 5 + tok % 4)::DOUBLE AS due FROM us WINDOW w AS (PARTITION BY conv_id % 7 ORDER BY conv_id, turn)),
f AS (SELECT DISTINCT b, 0::BIGINT AS k, -1::BIGINT AS conv_id, -1::BIGINT AS turn, NULL::DOUBLE AS now, 3.0::DOUBLE AS tokens, 0.0::DOUBLE AS wait_s FROM o
  UNION ALL
  SELECT f.b, o.k, o.conv_id, o.turn, start + wait, have + wait * (8.0::DOUBLE / 60) - 1, start + wait - due
  FROM f JOIN o ON o.b = f.b AND o.k = f.k + 1, LATERAL (SELECT CASE WHEN now IS NULL THEN due ELSE greatest(due, now) END AS start) x,
  LATERAL (SELECT CASE WHEN now IS NULL THEN 3.0 ELSE least(3.0, tokens + (start - now) * (8.0::DOUBLE / 60)) END::DOUBLE AS have) y, LATERAL (SELECT CASE WHEN have >= 1 THEN 0.0 ELSE (1 - have) / (8.0::DOUBLE / 60) END::DOUBLE AS wait) z)
SELECT conv_id, turn, round(wait_s, 4) AS wait_s, round(tokens, 4) AS tokens_left FROM f WHERE k > 0""",
    "cache_key": f"WITH {_KEYED} SELECT doc_id, key FROM kd",
    "cache_upsert": f"WITH {_KEYED} SELECT key, payload, created_at FROM ca",
    "cache_lookup": f"WITH {_KEYED} SELECT doc_id, payload, payload IS NOT NULL AS cached FROM kd LEFT JOIN ca USING (key)",
    "cache_anti": f"WITH {_KEYED} SELECT doc_id FROM kd ANTI JOIN ca USING (key)",
    "request_outcome": f"""WITH {_KEYED} SELECT doc_id, CASE WHEN payload IS NOT NULL THEN 'cached' WHEN doc_id % 7 = 0 THEN 'skipped' WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS ai_status,
doc_id % 11 = 0 AS retryable FROM kd LEFT JOIN ca USING (key)""",
    "scrub": r"""SELECT doc_id, sha256(regexp_replace(coalesce(text, '') || ' key sk-ant-abcdefghijklmnopqrstuv and AIzaAAAAAAAAAAAAAAAAAAAA', '\b(sk-ant-|sk-|AIza)[A-Za-z0-9_\-]{16,}', '\1[REDACTED]', 'g')) AS scrubbed FROM documents""",
    "key_shape": r"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN regexp_matches('AIza' || repeat('a', c_custkey % 40), '^AIza[0-9A-Za-z_\-]{30,}$') WHEN 1 THEN regexp_matches('sk-' || repeat('a', c_custkey % 40), '^sk-[0-9A-Za-z_\-]{20,}$')
WHEN 2 THEN regexp_matches('sk-ant-' || repeat('a', c_custkey % 40), '^sk-ant-[0-9A-Za-z_\-]{20,}$') END AS ok FROM customer""",
    "fingerprint": "SELECT c_custkey, right(c_name, 4) AS last4, left(sha256(c_name), 12) AS sha256_prefix, 'openai: ••••' || right(c_name, 4) AS display FROM customer",
    "roi_mask_anti": """SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM (VALUES (5.0, 9.0, 12.0, 12.0), (30.0, 0.0, 45.0, 14.5), (20.0, 13.0, 20.0, 13.5)) r(x0, y0, x1, y1)
WHERE p_size BETWEEN x0::DOUBLE AND x1::DOUBLE AND p_retailprice / 100 BETWEEN y0::DOUBLE AND y1::DOUBLE)""",
    "roi_crop": """SELECT p_partkey, CAST(floor(p_size / 100.0::DOUBLE * 1920) AS INTEGER) AS x0, 950 AS y0, CAST(least(1920, floor(p_size / 100.0::DOUBLE * 1920) + 211) AS INTEGER) AS x1,
CAST(least(1080, 950 + floor(p_size / 100.0::DOUBLE * 1080)) AS INTEGER) AS y1 FROM part""",
    "projection": "SELECT p_partkey, round(degrees(atan(p_size * 10 / (960 / tan(radians(103.0) / 2)))), 6) AS deg, round((p_size * 10)::DOUBLE, 6) AS px FROM part",
    "grid_samples": f"""WITH {_FR}, s AS (SELECT session_id, min(t_us) AS a, max(t_us) AS b FROM fr GROUP BY 1),
t AS (SELECT session_id, CAST(k AS INTEGER) AS tile, CAST(floor(a + (b - a) * (k + 0.5::DOUBLE) / 9) AS BIGINT) AS t_us FROM s, range(9) r(k)),
e AS (SELECT session_id, t_us, max(event_id) AS seen FROM fr GROUP BY 1, 2)
SELECT t.session_id, tile, t.t_us, seen FROM t ASOF LEFT JOIN e ON t.session_id = e.session_id AND t.t_us >= e.t_us""",
    "fill_forward": f"WITH {_FR} SELECT session_id, frame, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame) AS seen FROM fr",
    "letterbox": """WITH s AS (SELECT p_partkey, p_size * 13 AS w0, p_size * 7 + 50 AS h0, 384.0::DOUBLE / greatest(p_size * 13, p_size * 7 + 50) AS k FROM part),
f AS (SELECT p_partkey, CAST(floor(w0 * k) AS INTEGER) AS w, CAST(floor(h0 * k) AS INTEGER) AS h FROM s)
SELECT p_partkey, w, h, CAST((384 - w) // 2 AS INTEGER) AS "left", CAST((384 - h) // 2 AS INTEGER) AS top FROM f""",
    "sparkline": f"""WITH {_FR}, m AS (SELECT *, min(value) OVER p AS lo, max(value) OVER p AS hi FROM fr WINDOW p AS (PARTITION BY session_id))
SELECT session_id AS clip_id, frame, CAST(floor((1 - CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END) * 59) AS INTEGER) AS y FROM m""",
    "min_jerk_path": """WITH t AS (SELECT i, i / 60.0::DOUBLE AS s FROM range(120) r(i)), u AS (SELECT i, greatest(0, least(1, s / 0.4::DOUBLE)) AS a, greatest(0, least(1, (s - 0.4::DOUBLE) / 0.24::DOUBLE)) AS b FROM t)
SELECT CAST(i AS INTEGER) AS i, round(46 * (10 * power(a, 3) - 15 * power(a, 4) + 6 * power(a, 5)) - 6 * (10 * power(b, 3) - 15 * power(b, 4) + 6 * power(b, 5)), 6) AS yaw_deg FROM u""",
}

SQL["stream_counter_decrement"] = SQL["counter_decrement"]
SQL["stream_rising_edge"] = SQL["rising_edge"]

_WELCH = """, s0 AS (SELECT clip_id, i, speed AS x FROM sp){prep}, s1 AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM {src}),
s2 AS (SELECT *, least(n, {seg}) AS len, least(n, {seg}) - least(n, {seg}) // 2 AS hop FROM s1),
s3 AS (SELECT *, unnest(range(0, (n - len) // hop + 1)) AS seg FROM s2),
s4 AS (SELECT clip_id, len, seg, i - seg * hop AS j, x FROM s3 WHERE i - seg * hop >= 0 AND i - seg * hop < len),
s5 AS (SELECT *, (x - avg(x) OVER (PARTITION BY clip_id, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / len)) AS y, power(0.5 - 0.5 * cos(2 * pi() * j / len), 2) AS w2 FROM s4),
s6 AS (SELECT clip_id, len, seg, k, (power(sum(y * cos(2 * pi() * ((k * j) % len) / len)), 2) + power(sum(y * sin(2 * pi() * ((k * j) % len) / len)), 2)) / (sum(w2) * 60) * CASE WHEN k = 0 OR 2 * k = len THEN 1 ELSE 2 END AS p
  FROM (SELECT *, unnest(range(0, len // 2 + 1)) AS k FROM s5) GROUP BY clip_id, len, seg, k),
s7 AS (SELECT clip_id, k, k * 60.0::DOUBLE / len AS f, avg(p) AS power FROM s6 GROUP BY clip_id, len, k)"""

SQL["welch_psd"] = _TR + _WELCH.format(prep="", src="s0", seg=32) + " SELECT clip_id, CAST(k AS INTEGER) AS k, round(f, 6) AS f, round(power, 4) AS power FROM s7"
SQL["jitter_welch"] = (
    _TR
    + _WELCH.format(prep=", sc AS (SELECT clip_id, i, x - avg(x) OVER (PARTITION BY clip_id) AS x FROM s0)", src="sc", seg=256)
    + """, s8 AS (SELECT clip_id, (power + lag(power) OVER w) / 2 * (f - lag(f) OVER w) AS a, f <= 30 AND lag(f) OVER w >= 8 AS inside FROM s7 WINDOW w AS (PARTITION BY clip_id ORDER BY k))
SELECT ns.clip_id, round(CASE WHEN n < 8 THEN 0.0 ELSE (SELECT coalesce(sum(a) FILTER (WHERE inside), 0) / sum(a) FROM s8 WHERE s8.clip_id = ns.clip_id) END, 6) AS jitter_ratio FROM ns"""
)

_FEED = f"""WITH RECURSIVE {_FR}, h AS (
  SELECT session_id, frame, 0 AS slot, CAST(floor(value / 20) AS BIGINT) AS hash FROM fr
  UNION ALL SELECT session_id, frame, 1, CAST(floor(value / 10) AS BIGINT) FROM fr WHERE event_type = 'purchase'
), f AS (SELECT *, CASE WHEN frame - lag(frame) OVER w = 1 AND bit_count(xor(hash, lag(hash) OVER w)) <= 1 THEN 0 ELSE 1 END AS starts FROM h WINDOW w AS (PARTITION BY session_id, slot ORDER BY frame)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY session_id, slot ORDER BY frame) AS run FROM f),
c AS (SELECT *, row_number() OVER w AS k, min(frame) OVER w AS began FROM r WINDOW w AS (PARTITION BY session_id, slot, run ORDER BY frame)),
o AS (SELECT session_id, slot, hash, began, row_number() OVER (PARTITION BY session_id ORDER BY frame, slot) AS n FROM c WHERE k = 2),
g AS (SELECT DISTINCT session_id, 0::BIGINT AS n, []::BIGINT[] AS seen, false AS kept, 0 AS began, 0 AS slot, 0::BIGINT AS hash FROM o
  UNION ALL
  SELECT g.session_id, o.n, CASE WHEN dup THEN seen ELSE list_append(seen, o.hash)[-3:] END, NOT dup, o.began, o.slot, o.hash
  FROM g JOIN o ON o.session_id = g.session_id AND o.n = g.n + 1, LATERAL (SELECT len(list_filter(seen, lambda s: bit_count(xor(s, o.hash)) <= 1)) > 0 AS dup)
) SELECT session_id, CAST(began AS INTEGER) AS frame, CAST(slot AS INTEGER) AS slot, hash FROM g WHERE kept"""
SQL["feed_kills"] = SQL["stream_feed_kills"] = _FEED

SQL["stream_target_spawns"] = SQL["persistence_spawn"].rpartition(",\nh AS")[0] + "\nSELECT session_id, CAST(k - 1 AS INTEGER) AS frame, CAST(c AS INTEGER) AS n_targets FROM f WHERE hit"
SQL["stream_budget"] = f"""WITH RECURSIVE {_REQ}, o AS (SELECT conv_id % 7 AS b, round(usd, 6) AS usd, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id, turn) AS k FROM us),
f AS (SELECT DISTINCT b, 0::BIGINT AS k, 0.0::DOUBLE AS spent, 0.0::DOUBLE AS usd, false AS admitted FROM o
  UNION ALL SELECT f.b, o.k, CASE WHEN spent + o.usd <= 3.0 THEN spent + o.usd ELSE spent END, o.usd, spent + o.usd <= 3.0 FROM f JOIN o ON o.b = f.b AND o.k = f.k + 1)
SELECT b AS session_id, CAST(k - 1 AS INTEGER) AS frame, usd, admitted FROM f WHERE k > 0"""
SQL["stream_token_bucket"] = SQL["token_bucket"].rpartition("\nSELECT")[0] + "\nSELECT b AS session_id, CAST(k - 1 AS INTEGER) AS frame, round(wait_s, 4) AS wait_s FROM f WHERE k > 0"
SQL["model_lookup"] = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'mine' WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN 'large'
WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'small' ELSE 'other' END AS model FROM customer"""
# What was answered from the cache costs nothing and isn't asked: the budget sees the rest only.
SQL["assess_requests"] = (
    SQL["budget_admission"].rpartition("\nSELECT")[0].replace("FROM us)", "FROM us WHERE turn <> 1)", 1)
    + """
SELECT conv_id, turn, CASE WHEN admitted THEN 'ok' ELSE 'skipped' END AS ai_status, reason AS error, CASE WHEN admitted THEN 1 END::INTEGER AS input_tokens, CASE WHEN admitted THEN 2 END::INTEGER AS output_tokens FROM f WHERE k > 0
UNION ALL SELECT conv_id, turn, 'cached', NULL, NULL, NULL FROM us WHERE turn = 1"""
)

#: The trace of every distinct window, begun anew at its first frame, in the names that the metrics above read.
_WINDOWS = (
    f"WITH w0 AS ({_EVENTS}"
    + """, mw AS (SELECT * FROM eg QUALIFY row_number() OVER (PARTITION BY session_id, lo, hi ORDER BY group_no) = 1)
  SELECT session_id || ':' || lo AS clip_id, frame - lo AS i, CASE WHEN frame > lo THEN value - 50 ELSE 0.0 END AS dx, CASE WHEN frame > lo THEN value % 7 - 3 ELSE 0.0 END AS dy,
         event_type <> 'error' AS ok, hi - lo AS n, coalesce(first_shot - lo, hi - lo - 1) AS shot_idx, n_shots, n_hits, types, (first_shot - last_spawn) * 1000.0::DOUBLE / 60 AS rt, last_spawn IS NOT NULL AS stim
  FROM fr JOIN mw USING (session_id) WHERE frame >= lo AND frame < hi
), mo AS (SELECT clip_id, i, dx, dy, ok FROM w0)"""
    + _TR[_TR.index(",\nac AS") : _TR.index(",\nns AS")]
    + ", ns AS (SELECT DISTINCT clip_id, n, shot_idx FROM w0)"
)
_SETTLE = """, c AS (SELECT clip_id, i, t_ms, n, shot_idx AS f, sum(CASE WHEN speed < 15 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS slow FROM sp JOIN ns USING (clip_id))
SELECT clip_id, min(CASE WHEN i > f AND slow = 3 AND f < n - 3 THEN t_ms END) - max(CASE WHEN i = f THEN t_ms END) AS settle FROM c GROUP BY 1"""


def _of_windows(name: str) -> str:
    return f"({_WINDOWS}{SQL[name].removeprefix(_TR)})"


SQL["review_measures"] = f"""SELECT w.clip_id, confidence AS trace_confidence, path_efficiency, placement_error_deg AS crosshair_placement_error_deg,
  peak_error_deg AS peak_angular_error_deg, sparc AS smoothness_sparc, jitter_ratio, round(settle, 6) AS target_switch_ms, round(rt, 6) AS reaction_time_ms,
  CASE WHEN n_hits > 0 THEN 0.0::DOUBLE END AS headshot_pct, overshoot_count, n_shots AS shots_fired, n_hits AS shots_hit, {_LABEL} AS event_type,
  CAST((stim AND n_shots > 0)::INTEGER + (jitter_ratio IS NULL)::INTEGER + (n_shots > 0 AND NOT stim)::INTEGER AS INTEGER) AS n_warnings
FROM ({_WINDOWS} SELECT DISTINCT clip_id, n_shots, n_hits, types, rt, stim FROM w0) w
JOIN {_of_windows("trace_confidence")} USING (clip_id) JOIN {_of_windows("path_efficiency")} USING (clip_id) JOIN {_of_windows("placement_peak")} USING (clip_id)
JOIN {_of_windows("overshoot")} USING (clip_id) JOIN {_of_windows("sparc")} USING (clip_id) JOIN {_of_windows("jitter_welch")} USING (clip_id) JOIN ({_WINDOWS}{_SETTLE}) USING (clip_id)"""

SQL["review_picks"] = f"""WITH RECURSIVE rm AS ({SQL["review_measures"]}),
s AS (SELECT CAST(string_split(clip_id, ':')[1] AS BIGINT) % 10 AS session_id, clip_id, event_type, coalesce(reaction_time_ms, 0.0) AS rt, overshoot_count AS ov, coalesce(jitter_ratio, 0.0) AS jr, path_efficiency AS pe, smoothness_sparc AS sm,
  shots_fired AS fired, shots_hit AS hit, row_number() OVER (PARTITION BY CAST(string_split(clip_id, ':')[1] AS BIGINT) % 10 ORDER BY CAST(string_split(clip_id, ':')[1] AS BIGINT), CAST(string_split(clip_id, ':')[2] AS INTEGER)) AS idx FROM rm),
z AS (SELECT *, CASE WHEN stddev_pop(rt) OVER p >= 1e-9 THEN (rt - avg(rt) OVER p) / stddev_pop(rt) OVER p ELSE 0 END AS zrt, CASE WHEN stddev_pop(jr) OVER p >= 1e-9 THEN (jr - avg(jr) OVER p) / stddev_pop(jr) OVER p ELSE 0 END AS zjr
  FROM s WINDOW p AS (PARTITION BY session_id)),
c0 AS (SELECT session_id, idx, clip_id, event_type, [rt / 500, ov, jr * 3, coalesce(pe, 0.0), coalesce(sm, 0.0) / 3]::DOUBLE[] AS vec,
  (2 * abs(zrt) + 1.5 * ov + 1.5 * zjr + (fired - hit) / greatest(1, fired)::DOUBLE + CASE WHEN event_type = 'whiff_then_death' THEN 1 ELSE 0 END)::DOUBLE AS score FROM z),
g AS (SELECT session_id, list(clip_id ORDER BY idx) AS clips, list(event_type ORDER BY idx) AS kinds, list(vec ORDER BY idx) AS vecs, list(score ORDER BY idx) AS first, count(*) AS n FROM c0 GROUP BY 1),
f AS (
  SELECT session_id, 0 AS pick, first AS scores, 0::BIGINT AS place, 0.0::DOUBLE AS score, []::BIGINT[] AS taken FROM g
  UNION ALL
  SELECT f.session_id, pick + 1, list_transform(range(1, n + 1), lambda i: CASE WHEN i = pos THEN '-inf'::DOUBLE ELSE scores[i] - 2 * exp(-list_distance(vecs[i], vecs[pos])) END), pos, scores[pos], list_append(taken, pos)
  FROM f JOIN g USING (session_id), LATERAL (SELECT list_position(scores, list_max(scores))::BIGINT AS pos) WHERE pick < least(8, n)
), l AS (SELECT session_id, arg_max(taken, pick) AS all_taken, max(pick) AS last FROM f GROUP BY 1),
c AS (SELECT g.session_id, list_position(first, list_min(first)) AS calm, list_min(first) AS low, clips, kinds, n, all_taken, last FROM g JOIN l USING (session_id)),
p AS (SELECT session_id, pick, pick = last AND n > 8 AND NOT list_contains(all_taken, calm) AS swap, calm, low, place, score, clips, kinds FROM f JOIN c USING (session_id) WHERE pick > 0)
SELECT session_id, clips[CASE WHEN swap THEN calm ELSE place END] AS clip_id, kinds[CASE WHEN swap THEN calm ELSE place END] AS event_type, pick, round(CASE WHEN swap THEN low ELSE score END, 4) AS score FROM p"""

"""SQL of the catalogue's queries, written independently of the operators: plain joins inside an episode."""

from __future__ import annotations

from ..functions import labels

BASE = """
base AS (SELECT user_id AS ep, event_id, event_type, value, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000000 AS t FROM events)"""


def shots(longest: int = 15000) -> str:
    return f"""
gaps AS (SELECT ep, event_id, t, lead(t) OVER (PARTITION BY ep ORDER BY t, event_id) AS nx FROM base),
shots AS (SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY t, event_id) - 1 AS pos, t AS s, least(nx, t + {longest}) AS e FROM gaps WHERE nx > t)"""


CUES = """
cues AS (SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY t, event_id) AS cue, t - 200 AS s, t - 200 + 500 + CAST(floor(value * 10) AS BIGINT) AS e,
  props AS txt, event_type AS speaker, event_id FROM base WHERE event_type IN ('click', 'view', 'purchase'))"""
TURNS = """
turns AS (
  SELECT ep, 0 AS part, 'Speaker ' || (k % 3) AS raw_label, t + 250 AS s, t + 550 + CAST(floor(value * 12) AS BIGINT) AS e, event_id FROM base WHERE event_type IN ('signup', 'error', 'click')
  UNION ALL
  SELECT ep, 1, 'Speaker ' || ((k + event_id) % 4), t + 300, t + 600 + CAST(floor(value * 12) AS BIGINT), event_id FROM base WHERE event_type = 'click' AND event_id % 5 = 0),
voices AS (SELECT *, 'SPEAKER_A' || (part * 4 + CAST(right(raw_label, 1) AS INTEGER) + 1) AS cluster_id FROM turns)"""
ACTIONS = """
actions AS (SELECT ep, event_id AS action, t // 60000 AS segment, t AS s, t + CASE WHEN event_id % 5 = 2 THEN 4000 ELSE 2000 END AS e, 'P' || (event_id % 5) AS who,
  CASE WHEN event_id % 6 = 5 THEN 'open' WHEN event_id % 4 IN (0, 1) THEN 'moving' WHEN event_id % 4 = 2 THEN 'still' ELSE 'not_visible' END AS mouth_state,
  CASE WHEN event_id % 4 IN (0, 1) THEN 'speaking' WHEN event_id % 4 = 2 THEN 'chewing' WHEN event_id % 6 = 5 THEN 'humming' ELSE 'not_applicable' END AS mouth_motion
  FROM base WHERE event_type IN ('error', 'view'))"""
SCENES = """
scenes AS (SELECT ep, pos // 5 AS pos, min(s) AS s, max(e) AS e, count(*) AS shots FROM shots GROUP BY ALL)"""
ASSIGN = """
pairs AS (SELECT c.ep, c.cue, h.pos, greatest(0, least(c.e, h.e) - greatest(c.s, h.s)) AS ov, greatest(0, c.s - h.e, h.s - c.e) AS gap FROM cues c JOIN shots h USING (ep)),
ranked AS (SELECT *, CASE WHEN ov > 100 THEN 0 ELSE 1 END AS kind, row_number() OVER (PARTITION BY ep, cue ORDER BY CASE WHEN ov > 100 THEN 0 ELSE 1 END,
  CASE WHEN ov > 100 THEN -ov ELSE gap END, pos) AS rk FROM pairs),
assigned AS (SELECT ep, cue, pos, CASE WHEN kind = 0 THEN ov ELSE 0 END AS overlap, kind = 1 AS fallback FROM ranked WHERE rk = 1)"""
RELATED = """
related AS (SELECT a.*, c.speaker, c.txt, CASE
  WHEN regexp_matches(txt, '(?s)^[（(].*[）)]$') THEN 'INTERNAL_MONOLOGUE'
  WHEN txt LIKE '%下一集%' OR txt LIKE '%次回%' OR txt LIKE '%前情提要%' OR txt LIKE '%解说%' THEN 'VOICE_OVER'
  WHEN c.e > c.s AND overlap / (c.e - c.s) < 0.6 THEN 'OFF_SCREEN' ELSE 'ON_SCREEN' END AS relation FROM assigned a JOIN cues c USING (ep, cue))"""
SUMMARY = """
summary AS (SELECT h.ep, h.pos, count(r.cue) AS dialogue_count, CAST(coalesce(sum(r.overlap), 0) AS BIGINT) AS spoken_ms, count(DISTINCT coalesce(r.speaker, 'SPEAKER_UNKNOWN')) FILTER (WHERE r.cue IS NOT NULL) AS speakers,
  coalesce(bool_or(r.relation = 'OFF_SCREEN'), false) AS has_offscreen, any_value(h.e - h.s) AS len FROM shots h LEFT JOIN related r USING (ep, pos) GROUP BY h.ep, h.pos),
shot_rows AS (SELECT ep, pos, dialogue_count, spoken_ms, CAST(greatest(0, len - spoken_ms) AS BIGINT) AS silent_ms, speakers,
  CASE WHEN dialogue_count = 0 THEN 'SILENCE' WHEN speakers = 1 THEN 'MONOLOGUE' ELSE 'EXCHANGE' END AS mode, has_offscreen FROM summary)"""
BIND = """
ovs AS (SELECT c.ep, c.cue, v.cluster_id, sum(least(c.e, v.e) - greatest(c.s, v.s)) AS ov FROM cues c JOIN voices v USING (ep) WHERE least(c.e, v.e) > greatest(c.s, v.s) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY ep, cue ORDER BY ov DESC, cluster_id) AS r FROM ovs),
bound AS (SELECT c.ep, c.cue, c.speaker, a.cluster_id,
  CASE WHEN a.ov IS NULL THEN 0.0::DOUBLE WHEN a.ov / greatest(1, c.e - c.s) >= 0.8 THEN 0.9::DOUBLE WHEN a.ov / greatest(1, c.e - c.s) >= 0.5 THEN 0.75::DOUBLE ELSE 0.55::DOUBLE END AS confidence,
  CASE WHEN a.ov IS NULL THEN 'no_speech_overlap' ELSE 'acoustic_diarization' END AS method,
  CASE WHEN b.ov / greatest(1, c.e - c.s) >= 0.4 THEN b.cluster_id END AS secondary_speaker, CAST(coalesce(a.ov, 0) AS BIGINT) AS overlap_ms
  FROM cues c LEFT JOIN (SELECT * FROM rk WHERE r = 1) a USING (ep, cue) LEFT JOIN (SELECT * FROM rk WHERE r = 2) b USING (ep, cue))"""
NAMED = """
votes AS (SELECT ep, cluster_id, speaker AS name, count(*) AS n, min(cue) AS f FROM bound WHERE cluster_id IS NOT NULL AND speaker IS NOT NULL GROUP BY ALL),
tops AS (SELECT *, sum(n) OVER (PARTITION BY ep, cluster_id) AS al, row_number() OVER (PARTITION BY ep, cluster_id ORDER BY n DESC, f) AS r FROM votes),
named AS (SELECT l.ep, l.cluster_id, CASE WHEN t.n >= 2 AND t.n / t.al >= 0.6 THEN t.name END AS name, l.line_count
  FROM (SELECT ep, cluster_id, count(*) AS line_count FROM bound WHERE cluster_id IS NOT NULL GROUP BY ALL) l LEFT JOIN tops t ON t.ep = l.ep AND t.cluster_id = l.cluster_id AND t.r = 1)"""
ATTRS = """
attrs AS (SELECT *, CASE WHEN event_id % 7 < 3 THEN 'male' WHEN event_id % 7 < 5 THEN 'female' ELSE 'unknown' END AS gender,
  CASE WHEN event_id % 7 < 4 THEN 'adult' ELSE 'unknown' END AS age_band, CASE WHEN event_id % 2 = 0 THEN 'soft' ELSE 'deep' END AS timbre FROM voices)"""
LAG = """
sweep AS (SELECT c.ep, c.cue, d.delta, greatest(1, c.e - c.s) AS dur, max(least(c.s + d.delta + greatest(1, c.e - c.s), v.e) - greatest(c.s + d.delta, v.s)) AS ov
  FROM cues c JOIN turns v ON v.ep = c.ep AND v.part = 0, (SELECT unnest(generate_series(-5000, 5000, 250)) AS delta) d
  WHERE least(c.s + d.delta + greatest(1, c.e - c.s), v.e) > greatest(c.s + d.delta, v.s) GROUP BY ALL),
totals AS (SELECT ep, delta, round(sum(ov / dur), 6) AS total FROM sweep GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY total DESC, abs(delta), delta DESC) AS r FROM totals),
lag AS (SELECT n.ep, CAST(CASE WHEN n.n >= 6 THEN coalesce(b.delta, 0) ELSE 0 END AS BIGINT) AS offset_ms FROM (SELECT ep, count(*) AS n FROM cues GROUP BY ep) n LEFT JOIN best b ON b.ep = n.ep AND b.r = 1)"""
CUTS = """
cuts AS (SELECT * FROM (SELECT ep, pos AS boundary, e AS cut_ms, e - s AS left_ms, lead(e - s) OVER (PARTITION BY ep ORDER BY pos) AS right_ms FROM shots) WHERE right_ms IS NOT NULL)"""
VOTES = """
vv AS (SELECT v.ep, v.cluster_id, a.who AS label, count(*) AS votes FROM voices v JOIN actions a ON a.ep = v.ep AND least(v.e, a.e) > greatest(v.s, a.s)
  WHERE a.mouth_state = 'moving' AND a.mouth_motion = 'speaking' GROUP BY ALL)"""
FUSED = """
cnt AS (SELECT ep, cluster_id, 'visual' AS family, label AS candidate, votes AS n FROM vv
  UNION ALL SELECT ep, cluster_id, 'acoustic', 'P' || (event_id % 5), count(*) FROM voices GROUP BY ALL),
dist AS (SELECT *, n / (sum(n) OVER (PARTITION BY ep, cluster_id, family) + 2.0) AS p FROM cnt),
fam AS (SELECT ep, cluster_id, count(DISTINCT family) AS nf FROM dist GROUP BY ALL),
fused AS (SELECT d.ep, d.cluster_id, d.candidate, CASE WHEN count(*) = any_value(nf) THEN coalesce(max(p) FILTER (family = 'acoustic'), 1.0) * coalesce(max(p) FILTER (family = 'visual'), 1.0) ELSE 0.0 END AS score
  FROM dist d JOIN fam USING (ep, cluster_id) GROUP BY d.ep, d.cluster_id, d.candidate)"""
SEQUENCES = """
seqs AS (SELECT ep, (cue - 1) // 10 + 1 AS seq, min(cue) AS a, max(cue) AS b FROM cues GROUP BY ALL)"""
LABELLED = """
listed AS (SELECT ['旁白','王子的声音','威严之声','路人（男）','SPEAKER_A1','凉音','老年男人','茉里','茉里与妈妈','菈菈、店员','','茉里南','神秘老者','家人们'][event_id % 14 + 1] AS label FROM events)"""
LINES = """
lines AS (SELECT conv_id AS ep, turn AS index, role AS speaker, text FROM conversations)"""
SCRIPT = """
script AS (SELECT ep, 1::BIGINT AS scene, index + 1 AS sub, speaker, text,
  CASE WHEN ep % 7 = 3 AND index = 1 THEN 1 WHEN ep % 11 = 5 AND index = 0 THEN 900 ELSE index + 1 END AS shown FROM lines)"""
CAST = """
cluster AS (SELECT DISTINCT ep, speaker AS cluster_id, CASE WHEN speaker = 'user' THEN 'S1' ELSE 'S2' END AS slot_id, CASE WHEN speaker = 'user' THEN 'approved' ELSE 'pending' END AS status FROM lines),
named AS (SELECT c.ep, c.cluster_id, e.name, trim(unnest(e.surfaces)) AS surface FROM cluster c JOIN (VALUES ('S1', 'E1')) s(slot_id, entity_id) USING (slot_id) JOIN (VALUES ('E1', 'assistant', ['assistant', 'helper', ' aide '])) e(entity_id, name, surfaces) USING (entity_id) WHERE c.status = 'approved')"""
GENERIC = "(" + ", ".join(f"'{x}'" for x in labels.GENERIC) + ")"
VOICE_OF, SHAPE = labels.VOICE_OF, labels.SHAPE
# Separators of address terms, as a character class.
SEPARATORS = '，,、：:！!？?…—·~～  \\t"“”「」『』（）()【】'
CALLED = f"""
calls AS (SELECT ep, index, CASE WHEN speaker <> 'system' THEN speaker END AS cluster_id, term, text,
  len(regexp_extract_all(text, '(?m)(?:^|[{SEPARATORS}])' || term || '(?:$|[{SEPARATORS}])')) AS n,
  regexp_matches(text, '^[{SEPARATORS}]*' || term || '(?:[{SEPARATORS}\\n]|$)') AS at_start, regexp_matches(text, '(?:^|[{SEPARATORS}\\n])' || term || '[{SEPARATORS}]*$') AS at_end
  FROM lines, (SELECT unnest(['is', 'der', 'la', 'thing']) AS term)),
heard AS (SELECT * FROM calls WHERE n > 0 AND NOT (n = 1 AND at_start AND at_end))"""


def w(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


_c = (BASE, shots(), CUES)
SQL = {
    "cue_shot_assign": w(*_c, ASSIGN) + "SELECT ep, cue, pos, CAST(overlap AS BIGINT) AS overlap, fallback FROM assigned",
    "cue_scene_counts": w(*_c, SCENES)
    + """, p AS (SELECT c.ep, c.cue, n.pos, row_number() OVER (PARTITION BY c.ep, c.cue ORDER BY least(c.e, n.e) - greatest(c.s, n.s) DESC, n.pos) AS r
  FROM cues c JOIN scenes n ON n.ep = c.ep AND least(c.e, n.e) > greatest(c.s, n.s))
SELECT n.ep, n.pos, count(p.cue) AS cue_count FROM scenes n LEFT JOIN p ON p.ep = n.ep AND p.pos = n.pos AND p.r = 1 GROUP BY n.ep, n.pos""",
    "cue_relations": w(*_c, ASSIGN, RELATED) + "SELECT ep, cue, pos, CAST(overlap AS BIGINT) AS overlap, relation FROM related",
    "aligned_shot_summary": w(*_c, ASSIGN, RELATED, SUMMARY) + "SELECT * FROM shot_rows",
    "timeline_totals": w(*_c, ASSIGN, RELATED, SUMMARY)
    + "SELECT ep, count(*) AS shots, count(*) FILTER (mode = 'SILENCE') AS silent_shots, count(*) FILTER (has_offscreen) AS offscreen_shots, CAST(sum(dialogue_count) AS BIGINT) AS cues FROM shot_rows GROUP BY ep",
    "relation_statistics": w(*_c, ASSIGN, RELATED, SUMMARY)
    + "SELECT relation AS kind, count(*) AS n FROM related GROUP BY 1 UNION ALL SELECT 'SILENT_ACTION', count(*) FILTER (mode = 'SILENCE') FROM shot_rows",
    "speaker_segment_lookup": w(BASE, CUES, TURNS)
    + """, p AS (SELECT c.ep, c.cue, t.raw_label, row_number() OVER (PARTITION BY c.ep, c.cue ORDER BY least(c.e, t.e) - greatest(c.s, t.s) DESC, t.event_id) AS r
  FROM cues c JOIN turns t ON t.ep = c.ep AND t.part = 0 AND least(c.e, t.e) - greatest(c.s, t.s) > 100)
SELECT c.ep, c.cue, CASE WHEN c.speaker = 'purchase' THEN c.speaker ELSE coalesce(p.raw_label, 'SPEAKER_UNKNOWN') END AS speaker
FROM cues c LEFT JOIN p ON p.ep = c.ep AND p.cue = c.cue AND p.r = 1""",
    "cue_cluster_bind": w(BASE, CUES, TURNS, BIND) + "SELECT ep, cue, cluster_id, confidence, method, secondary_speaker, overlap_ms FROM bound",
    "lag_estimate": w(BASE, CUES, TURNS, LAG) + "SELECT * FROM lag",
    "cue_cluster_bind_lagged": w(BASE, CUES, TURNS, LAG)
    + """, ovs AS (SELECT c.ep, c.cue, v.cluster_id, sum(least(c.e + offset_ms, v.e) - greatest(c.s + offset_ms, v.s)) AS ov FROM cues c JOIN lag USING (ep) JOIN voices v USING (ep)
  WHERE least(c.e + offset_ms, v.e) > greatest(c.s + offset_ms, v.s) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY ep, cue ORDER BY ov DESC, cluster_id) AS r FROM ovs)
SELECT c.ep, c.cue, rk.cluster_id, CAST(coalesce(ov, 0) AS BIGINT) AS overlap_ms FROM cues c LEFT JOIN rk ON rk.ep = c.ep AND rk.cue = c.cue AND r = 1""",
    "cluster_components": w(BASE, TURNS)
    + """, nodes AS (SELECT ep, part, raw_label, min((s, e, raw_label, part)) AS f FROM turns GROUP BY ALL),
links AS (SELECT DISTINCT a.ep, a.part AS pa, a.raw_label AS la, b.part AS pb, b.raw_label AS lb FROM turns a JOIN turns b ON a.ep = b.ep AND a.part <> b.part
  WHERE greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / greatest(1, least(a.e - a.s, b.e - b.s)) >= 0.5),
reach AS (SELECT ep, part, raw_label, part AS rp, raw_label AS rl FROM nodes UNION SELECT r.ep, r.part, r.raw_label, l.pb, l.lb FROM reach r JOIN links l ON l.ep = r.ep AND l.pa = r.rp AND l.la = r.rl),
least_of AS (SELECT r.ep, r.part, r.raw_label, min(n.f) AS f FROM reach r JOIN nodes n ON n.ep = r.ep AND n.part = r.rp AND n.raw_label = r.rl GROUP BY ALL)
SELECT ep, part, raw_label, 'SPEAKER_A' || dense_rank() OVER (PARTITION BY ep ORDER BY f) AS cluster_id FROM least_of""",
    "cluster_name_vote": w(BASE, CUES, TURNS, BIND, NAMED) + "SELECT * FROM named",
    "name_manifest": w(BASE, CUES, TURNS, BIND, NAMED) + "SELECT ep, name, CAST(sum(line_count) AS BIGINT) AS lines FROM named WHERE name IS NOT NULL GROUP BY ALL",
    "cluster_summary": w(BASE, CUES, TURNS, BIND)
    + """, sp AS (SELECT ep, cluster_id, CAST(sum(e - s) AS BIGINT) AS speech_ms, string_agg(DISTINCT CAST(part AS VARCHAR), ',' ORDER BY CAST(part AS VARCHAR)) AS parts FROM voices GROUP BY ALL)
SELECT ep, cluster_id, coalesce(n, 0) AS line_count, speech_ms, parts, row_number() OVER (PARTITION BY ep ORDER BY CAST(regexp_extract(cluster_id, '([0-9]+)$', 1) AS BIGINT)) AS ord
FROM sp LEFT JOIN (SELECT ep, cluster_id, count(*) AS n FROM bound WHERE cluster_id IS NOT NULL GROUP BY ALL) USING (ep, cluster_id)""",
    "attribute_vote": w(BASE, TURNS, ATTRS)
    + """, each AS (SELECT ep, cluster_id, 'gender' AS field, gender AS v FROM attrs UNION ALL SELECT ep, cluster_id, 'age_band', age_band FROM attrs UNION ALL SELECT ep, cluster_id, 'timbre', timbre FROM attrs),
cnt AS (SELECT ep, cluster_id, field, v, count(*) AS n FROM each GROUP BY ALL),
top AS (SELECT ep, cluster_id, field, CAST(coalesce(sum(n) FILTER (v <> 'unknown'), 0) AS BIGINT) AS known, max(n) FILTER (v <> 'unknown') AS n, arg_max(v, n) FILTER (v <> 'unknown') AS v FROM cnt GROUP BY ALL)
SELECT ep, cluster_id, field, CASE WHEN n / known >= 0.6 THEN v ELSE 'unknown' END AS value, CASE WHEN n / known >= 0.6 THEN n ELSE 0 END AS votes, known FROM top""",
    "attribute_compliance": w(BASE, TURNS, ATTRS)
    + "SELECT ep, count(*) FILTER (gender <> 'unknown') AS gender, count(*) FILTER (age_band <> 'unknown') AS age_band, count(*) FILTER (timbre <> 'unknown') AS timbre, count(*) AS turns, (count(*) FILTER (gender <> 'unknown') + count(*) FILTER (age_band <> 'unknown') + count(*) FILTER (timbre <> 'unknown')) / (3 * count(*)) AS rate FROM attrs GROUP BY ep",
    "diarization_totals": w(BASE, CUES, TURNS, BIND)
    + "SELECT ep, count(*) AS cues, count(DISTINCT cluster_id) AS clusters, count(*) FILTER (cluster_id IS NULL) AS unattributed, count(*) FILTER (secondary_speaker IS NOT NULL) AS shared, count(DISTINCT speaker) AS speakers FROM bound GROUP BY ep",
    "oped_filter_kept": w(BASE, CUES)
    + """, r AS (SELECT *, greatest(0, least(greatest(e, s + 1), 105000) - greatest(s, 84000)) / greatest(1, greatest(e, s + 1) - s) AS o, greatest(0, least(greatest(e, s + 1), 1440000) - greatest(s, 1320000)) / greatest(1, greatest(e, s + 1) - s) AS d FROM cues)
SELECT ep, cue, row_number() OVER (PARTITION BY ep ORDER BY s, cue) AS index FROM r WHERE o <= 0.5 AND d <= 0.5""",
    "oped_filter_removed": w(BASE, CUES)
    + """, r AS (SELECT *, greatest(0, least(greatest(e, s + 1), 105000) - greatest(s, 84000)) / greatest(1, greatest(e, s + 1) - s) AS o, greatest(0, least(greatest(e, s + 1), 1440000) - greatest(s, 1320000)) / greatest(1, greatest(e, s + 1) - s) AS d FROM cues)
SELECT ep, CASE WHEN o >= d THEN 'OP' ELSE 'ED' END AS label, count(*) AS removed FROM r WHERE o > 0.5 OR d > 0.5 GROUP BY ALL""",
    "segment_plan": w(BASE, shots(10**9), SCENES)
    + """, plan AS (SELECT ep, pos, 0::BIGINT AS segment, s AS s0, s AS a, CASE WHEN e - least(e, s + 90000) < 10000 THEN e ELSE least(e, s + 90000) END AS b, e AS fin FROM scenes WHERE e - s >= 1500
  UNION ALL SELECT ep, pos, segment + 1, s0, b - 5000, CASE WHEN fin - least(fin, b + 85000) < 10000 THEN fin ELSE least(fin, b + 85000) END, fin FROM plan WHERE b < fin)
SELECT ep, pos, segment, a AS start_ms, b AS end_ms FROM plan""",
    "short_scenes": w(BASE, shots()) + "SELECT ep, pos FROM shots WHERE e - s < 1500",
    "chunk_plan": w(BASE)
    + """, d AS (SELECT ep, max(t) * 5 AS n FROM base GROUP BY ep), raw AS (SELECT ep, n, unnest(generate_series(2700000, n - 1, 2700000)) AS b FROM d WHERE n > 3000000),
last AS (SELECT ep, max(b) AS lb FROM raw GROUP BY ep), kept AS (SELECT r.ep, r.b FROM raw r JOIN last USING (ep) WHERE NOT (b = lb AND n - b < 600000)),
pts AS (SELECT ep, 0 AS c FROM d UNION ALL SELECT ep, b FROM kept), nx AS (SELECT p.ep, c, lead(c) OVER (PARTITION BY p.ep ORDER BY c) AS x, row_number() OVER (PARTITION BY p.ep ORDER BY c) - 1 AS part, n FROM pts p JOIN d USING (ep) WHERE n > 0)
SELECT ep, part, CAST(CASE WHEN part = 0 THEN 0 ELSE greatest(0, c - 3000) END AS BIGINT) AS start_ms, CAST(CASE WHEN x IS NULL THEN n ELSE least(n, x + 3000) END AS BIGINT) AS end_ms FROM nx""",
    "greedy_min_gap": w(BASE)
    + """, kept AS (SELECT ep, min(t) AS "at" FROM base GROUP BY ep UNION ALL SELECT k.ep, (SELECT min(t) FROM base b WHERE b.ep = k.ep AND b.t >= k."at" + 30000) FROM kept k WHERE k."at" IS NOT NULL)
SELECT ep, "at" FROM kept WHERE "at" IS NOT NULL""",
    "cuts_to_shots": w(BASE)
    + """, p AS (SELECT DISTINCT ep, t AS "at" FROM base UNION SELECT ep, max(t) + 5000 FROM base GROUP BY ep),
n AS (SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY "at") AS shot_id, "at" AS start_ms, lead("at") OVER (PARTITION BY ep ORDER BY "at") AS end_ms FROM p) SELECT * FROM n WHERE end_ms IS NOT NULL""",
    "even_sample": w(BASE, shots())
    + """, n AS (SELECT ep, pos, row_number() OVER (PARTITION BY ep ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY ep) AS n FROM shots),
pick AS (SELECT DISTINCT ep, n, CAST(floor(j * (n / 12.0)) AS BIGINT) AS i FROM (SELECT DISTINCT ep, n FROM n) x, generate_series(0, 11) g(j) WHERE n > 12)
SELECT ep, pos FROM n WHERE n <= 12 UNION ALL SELECT n.ep, n.pos FROM n JOIN pick USING (ep, i)""",
    "coverage_union": w(BASE, shots(10**9), SCENES, ACTIONS)
    + """, cl AS (SELECT n.ep, n.pos, greatest(a.s, n.s) AS s, least(a.e, n.e) AS e FROM scenes n JOIN actions a ON a.ep = n.ep AND least(a.e, n.e) > greatest(a.s, n.s)),
mk AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY ep, pos ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM cl),
il AS (SELECT *, sum(nw) OVER (PARTITION BY ep, pos ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM mk),
un AS (SELECT ep, pos, sum(x) AS ms FROM (SELECT ep, pos, g, max(e) - min(s) AS x FROM il GROUP BY ALL) GROUP BY ALL)
SELECT n.ep, n.pos, CAST(round(100 * coalesce(ms, 0) / greatest(1, n.e - n.s), 1) AS DOUBLE) AS covered_pct FROM scenes n LEFT JOIN un USING (ep, pos)""",
    "stream_select": """WITH s AS (SELECT event_id // 4 AS ep, event_id AS index, ['eng','chi','jpn','zho','fre'][event_id % 5 + 1] AS lang,
  CASE event_id % 3 WHEN 0 THEN 'signs & songs' WHEN 1 THEN 'full' ELSE '' END AS title, event_id % 11 = 0 AS forced FROM events),
m AS (SELECT *, forced OR regexp_matches(lang || ' ' || title, 'forced|sign|song|lyric|credit') AS skip, CASE lang WHEN 'chi' THEN 0 WHEN 'zho' THEN 1 ELSE 5 END AS pref FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY CASE WHEN skip THEN 6 ELSE pref END, index) AS rk FROM m)
SELECT ep, index, CASE WHEN skip THEN 'last_resort' WHEN pref = 5 THEN 'first_non_sign' ELSE 'language' END AS reason FROM r WHERE rk = 1""",
    "boundary_features": w(*_c, CUTS)
    + """, f AS (SELECT k.ep, k.boundary, k.cut_ms, k.left_ms, k.right_ms, max((c.cue, c.e, c.txt)) FILTER (c.e <= k.cut_ms) AS pre, min((c.cue, c.s)) FILTER (c.s >= k.cut_ms) AS post
  FROM cuts k LEFT JOIN cues c USING (ep) GROUP BY ALL),
g AS (SELECT *, CAST(greatest(0, coalesce(post[2], cut_ms + 10000) - coalesce(pre[2], 0)) AS BIGINT) AS silence_ms FROM f)
SELECT ep, boundary, silence_ms, least(1.0::DOUBLE, 0.2::DOUBLE + CASE WHEN silence_ms > 4000 THEN 0.35::DOUBLE WHEN silence_ms > 2000 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN left_ms > 5000 OR right_ms > 5000 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN pre IS NOT NULL AND post IS NOT NULL AND regexp_matches(pre[3], '(。|！|？|\\.|!|\\?)$') THEN 0.1::DOUBLE ELSE 0 END) AS score FROM g""",
    "protected_boundaries": w(*_c, CUTS)
    + """, f AS (SELECT k.ep, k.boundary, bool_or(c.s < cut_ms - 200 AND c.e > cut_ms + 200) AS across, max((c.cue, c.e)) FILTER (c.e <= cut_ms AND c.e > cut_ms - 800) AS pre,
  min((c.cue, c.s)) FILTER (c.s >= cut_ms AND c.s < cut_ms + 800) AS post FROM cuts k JOIN cues c USING (ep) GROUP BY k.ep, k.boundary)
SELECT ep, boundary FROM f WHERE across OR post[2] - pre[2] < 500""",
    "segmentation_check": w(BASE, shots()) + "SELECT ep, min(pos) AS first, max(pos) AS last, count(*) AS shots, count(*) >= 8 AS in_bounds FROM shots GROUP BY ep",
    "sequence_walls": w(*_c, CUTS, SEQUENCES)
    + """, wl AS (SELECT q.ep, q.seq AS wall, (c.e + n.s) / 2.0 AS wms FROM seqs q JOIN seqs q2 ON q2.ep = q.ep AND q2.seq = q.seq + 1 JOIN cues c ON c.ep = q.ep AND c.cue = q.b JOIN cues n ON n.ep = q.ep AND n.cue = q2.a),
near AS (SELECT w.*, k.boundary, abs(k.cut_ms - wms) AS d, k.cut_ms, row_number() OVER (PARTITION BY w.ep, w.wall ORDER BY abs(k.cut_ms - wms), k.boundary) AS r FROM wl w JOIN cuts k USING (ep)),
pick AS (SELECT n.ep, n.wall, n.wms, n.d <= 15000 AS win, CASE WHEN n.d <= 15000 THEN n.boundary ELSE coalesce((SELECT max(boundary) FROM cuts k WHERE k.ep = n.ep AND k.cut_ms <= n.wms), 0) END AS p FROM near n WHERE r = 1),
fix AS (SELECT ep, wall, 1 AS step, p AS b FROM pick WHERE wall = 1 UNION ALL SELECT f.ep, f.wall + 1, 1, greatest(p.p, f.b + 1) FROM fix f JOIN pick p ON p.ep = f.ep AND p.wall = f.wall + 1)
SELECT f.ep, f.wall, f.b AS boundary, CAST(abs(k.cut_ms - p.wms) AS DOUBLE) AS distance_ms, k.cut_ms IS NOT NULL AND p.win AND (p.p = f.b OR abs(k.cut_ms - p.wms) <= 15000) AS within
FROM fix f JOIN pick p ON p.ep = f.ep AND p.wall = f.wall LEFT JOIN cuts k ON k.ep = f.ep AND k.boundary = f.b""",
    "outline_contiguity": w(BASE, CUES, SEQUENCES)
    + """, x AS (SELECT ep, seq, a, CASE WHEN seq % 3 = 0 THEN b - 1 WHEN seq % 5 = 0 THEN b + 1 ELSE b END AS b FROM seqs),
y AS (SELECT *, lag(b) OVER o AS pb, lead(a) OVER o AS na FROM x WINDOW o AS (PARTITION BY ep ORDER BY seq)), z AS (SELECT ep, min(cue) AS f, max(cue) AS l FROM cues GROUP BY ep)
SELECT ep, seq, 'start' AS problem FROM y JOIN z USING (ep) WHERE pb IS NULL AND a <> f UNION ALL SELECT ep, seq, 'gap' FROM y WHERE a > pb + 1 UNION ALL SELECT ep, seq, 'overlap' FROM y WHERE a <= pb
UNION ALL SELECT ep, seq, 'reversed' FROM y WHERE b < a UNION ALL SELECT ep, seq, 'end' FROM y JOIN z USING (ep) WHERE na IS NULL AND b <> l""",
    "visual_votes": w(BASE, TURNS, ACTIONS, VOTES) + "SELECT * FROM vv",
    "over_split": w(BASE, TURNS, ACTIONS, VOTES)
    + "SELECT ep, label, string_agg(DISTINCT cluster_id, ',' ORDER BY cluster_id) AS clusters FROM vv GROUP BY ALL HAVING count(DISTINCT cluster_id) > 1",
    "mouth_compliance": w(BASE, ACTIONS)
    + """, n AS (SELECT ep, count(*) AS total, count(*) FILTER (mouth_state = 'moving') AS state_moving, count(*) FILTER (mouth_state = 'still') AS state_still, count(*) FILTER (mouth_state = 'not_visible') AS state_not_visible,
  count(*) FILTER (mouth_state NOT IN ('moving', 'still', 'not_visible')) AS state_unknown, count(*) FILTER (mouth_motion = 'speaking') AS motion_speaking, count(*) FILTER (mouth_motion = 'chewing') AS motion_chewing, count(*) FILTER (mouth_motion = 'yawning') AS motion_yawning,
  count(*) FILTER (mouth_motion = 'other') AS motion_other, count(*) FILTER (mouth_motion = 'not_applicable') AS motion_not_applicable, count(*) FILTER (mouth_motion NOT IN ('speaking', 'chewing', 'yawning', 'other', 'not_applicable')) AS motion_unknown,
  count(*) FILTER (e - s > 3000) AS over FROM actions GROUP BY ep)
SELECT *, (total - state_unknown) / total AS valid_rate, (total - over) / total AS window_compliance, total - state_unknown >= 0.8::DOUBLE * total AND total - over >= 0.8::DOUBLE * total AS usable FROM n""",
    "fusion_scores": w(BASE, TURNS, ACTIONS, VOTES, FUSED) + "SELECT ep, cluster_id, candidate, CAST(round(score, 9) AS DOUBLE) AS score FROM fused",
    "fusion_margin": w(BASE, TURNS, ACTIONS, VOTES, FUSED)
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY ep, cluster_id ORDER BY score DESC, candidate) AS k FROM fused)
SELECT ep, cluster_id, max(candidate) FILTER (k = 1) AS winner, CAST(round(CASE WHEN sum(score) > 0 THEN (max(score) FILTER (k = 1) - coalesce(max(score) FILTER (k = 2), 0)) / sum(score) ELSE 0 END, 9) AS DOUBLE) AS margin FROM r GROUP BY ALL""",
    "timecodes": w(BASE, CUES)
    + """, x AS (SELECT ep, cue, greatest(0, e) AS m FROM cues)
SELECT ep, cue, format('{:02d}:{:02d}:{:02d}.{:03d}', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS code, m AS back, format('{:02d}:{:02d}:{:02d}', m // 3600000, m // 60000 % 60, m // 1000 % 60) AS clock FROM x""",
    "strip_tags": "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages",
    "norm_text": r"SELECT conv_id, turn, md5(lower(regexp_replace(coalesce(text, ''), '[\s\x{3000}\x{00a0}，。：:；;！!？?、,.\[\]【】()（）「」『』…—·\-–]', '', 'g'))) AS digest FROM conversations",
    "speaker_prefix": w(LINES)
    + r"""SELECT ep, index, CASE WHEN head = 0 THEN NULL WHEN head = 1 THEN regexp_extract(line, '^[【\\[（(]([^】\\]）)]+)[】\\]）)]', 1) ELSE regexp_extract(line, '^([^：:\\s\\d()\\[\\]【】]{1,16})\\s*[：:]', 1) END AS speaker,
  md5(CASE head WHEN 0 THEN line WHEN 1 THEN trim(regexp_replace(line, '^[【\\[（(][^】\\]）)]+[】\\]）)]', ''), SP) ELSE trim(regexp_replace(line, '^[^：:\\s\\d()\\[\\]【】]{1,16}\\s*[：:]', ''), SP) END) AS digest
FROM (SELECT *, CASE WHEN regexp_matches(line, '^[【\\[（(][^】\\]）)]+[】\\]）)]\\s*[^\\n]*$') AND lower(trim(regexp_extract(line, '^[【\\[（(]([^】\\]）)]+)', 1))) NOT IN ('music', 'sigh', 'laughter') AND length(trim(regexp_extract(line, '^[【\\[（(]([^】\\]）)]+)', 1))) <= 20
    AND trim(regexp_replace(line, '^[【\\[（(][^】\\]）)]+[】\\]）)]', '')) <> '' THEN 1
  WHEN regexp_matches(line, '^[^：:\\s\\d()\\[\\]【】]{1,16}\\s*[：:]\\s*[^\\n]+$') AND NOT regexp_matches(regexp_extract(line, '^([^：:\\s\\d()\\[\\]【】]{1,16})\\s*[：:]', 1), '(?i)^(http|https|ftp)$') THEN 2 ELSE 0 END AS head
  FROM (SELECT ep, index, trim(CASE index % 3 WHEN 0 THEN '【' || speaker || '】' WHEN 1 THEN speaker || '：' ELSE '(music)' END || text, SP) AS line FROM lines))""".replace("SP", "' ' || chr(10) || chr(9) || chr(13) || chr(160) || chr(12288)").replace("\\\\", "\\"),
    "label_taxonomy": w(LABELLED)
    + f""", t AS (SELECT label, trim(label) AS t, regexp_replace(trim(label), '[（(][^（）()]*[)）]\\s*$', '') AS bare FROM listed)
SELECT label, CASE WHEN t = '' THEN 'descriptive' WHEN regexp_matches(t, '^SPEAKER_[A-Z0-9]+$') THEN 'provisional' WHEN t IN {GENERIC} OR bare IN {GENERIC} THEN 'generic'
  WHEN len(list_filter(list_append(regexp_split_to_array(t, '[、/／]'), t), lambda p: regexp_matches(trim(p), '{VOICE_OF}') OR regexp_matches(trim(p), '{SHAPE}'))) > 0 THEN 'descriptive' ELSE 'name' END AS kind, count(*) AS n FROM t GROUP BY ALL""",
    "label_trace": w(LABELLED)
    + """, t AS (SELECT label, trim(label) AS t, regexp_replace(trim(label), '[（(][^（）()]*[)）]\\s*$', '') AS bare, ['茉里', '菈菈', '罗温'] AS known FROM listed),
h AS (SELECT *, list_filter(known, lambda k: length(k) >= 2 AND starts_with(t, k) AND (t = k OR regexp_matches(substr(t, length(k) + 1, 1), '[与和跟及、／/（( 们]'))) AS a, list_filter(known, lambda k: length(k) >= 2 AND starts_with(bare, k) AND (bare = k OR regexp_matches(substr(bare, length(k) + 1, 1), '[与和跟及、／/（( 们]'))) AS b FROM t)
SELECT label, CASE WHEN t = '' THEN NULL WHEN list_contains(known, t) THEN t WHEN list_contains(known, bare) THEN bare ELSE coalesce(a[1], b[1]) END AS surface, count(*) AS n FROM h GROUP BY ALL""",
    "vocative_events": w(LINES, CALLED) + "SELECT ep, index, cluster_id, term, n FROM heard",
    "not_speaker": w(LINES, CALLED) + "SELECT ep, cluster_id, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM heard WHERE cluster_id IS NOT NULL GROUP BY ALL",
    "histogram_distance": """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) / list_sum(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE))))) AS h FROM embeddings)
SELECT a.vec_id, CAST(round(greatest(0, least(1, 1 - list_sum(list_transform(list_zip(a.h, b.h), lambda z: least(z[1], z[2]))))), 6) AS DOUBLE) AS distance FROM u a JOIN u b ON b.vec_id = a.vec_id + 1""",
    "placeholder_check": w(LINES, SCRIPT)
    + """, used AS (SELECT ep, scene, shown AS sub, sub AS ord FROM script), known AS (SELECT ep, sub FROM script)
SELECT DISTINCT ep, scene, 'unknown' AS rule, sub FROM used WHERE (ep, sub) NOT IN (SELECT (ep, sub) FROM known)
UNION ALL SELECT ep, scene, 'missing', sub FROM script WHERE (ep, sub) NOT IN (SELECT (ep, sub) FROM used)
UNION ALL SELECT ep, scene, 'duplicate', sub FROM used GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT ep, scene, 'disorder', sub FROM (SELECT *, lag(sub) OVER (PARTITION BY ep, scene ORDER BY ord) AS p FROM used) WHERE sub < p""",
    "splice_text": w(LINES, SCRIPT)
    + """SELECT a.ep, a.scene, md5('**INT**｜room' || chr(10) || string_agg('**' || a.speaker || '**：' || coalesce(b.text, ''), chr(10) ORDER BY a.sub)) AS digest
FROM script a LEFT JOIN script b ON b.ep = a.ep AND b.sub = a.shown GROUP BY a.ep, a.scene""",
    "head_of_placeholder": w(LINES, SCRIPT) + "SELECT ep, scene, shown AS sub, arg_max(speaker, sub) AS head FROM script GROUP BY ep, scene, shown",
    "lineage_names": w(LINES, CAST) + "SELECT ep, cluster_id, name, surface FROM named",
    "attribution_audit": w(LINES, SCRIPT, CAST)
    + """, h AS (SELECT ep, scene, shown AS sub, arg_max(speaker, sub) AS head FROM script GROUP BY ep, scene, shown)
SELECT DISTINCT s.ep, s.scene, s.sub, s.speaker AS cluster_id, h.head, o.name AS expected FROM script s JOIN h USING (ep, scene, sub) JOIN cluster c ON c.ep = s.ep AND c.cluster_id = s.speaker JOIN named t ON t.ep = s.ep AND t.surface = h.head LEFT JOIN named o ON o.ep = s.ep AND o.cluster_id = s.speaker
WHERE t.name IS DISTINCT FROM o.name AND NOT (s.ep % 4 = 1 AND s.sub IN (1, 3))""",
}
NOTED = """
raws AS (SELECT ep, event_id AS segment, t, '{"visual": {"caption": "", "actions": [{"' || ['start', 'start_time', 'from', 'begin'][event_id % 4 + 1] || '": "' || ['1.5', '0:02', '3', '3'][event_id % 4 + 1] || '", "end": ' || CASE WHEN event_id % 4 = 2 THEN '99' ELSE '4.25' END
  || ', "who": "P' || event_id % 5 || '", "what": "w' || event_id % 3 || '", "mouth_state": "' || CASE WHEN event_id % 2 = 0 THEN 'Moving' ELSE 'odd' END || '", "mouth_motion": "speaking"}]}, "visible_text": [{"from": "1", "text": "t"}, {"start": "2", "content": "u", "to": "9999"}]}' AS raw FROM base WHERE event_type = 'error'),
each AS (SELECT ep, segment, t, c, unnest(from_json(json_extract(raw, p), '["JSON"]')) AS x FROM raws, (VALUES ('actions', '$.visual.actions'), ('visible_text', '$.visible_text')) v(c, p)),
stamp AS (SELECT *, CASE WHEN c = 'actions' THEN coalesce(x ->> '$.start', x ->> '$.start_time', x ->> '$.start_sec', x ->> '$.from') ELSE coalesce(x ->> '$.start', x ->> '$.start_time', x ->> '$.start_sec') END AS s0, CASE WHEN c = 'actions' THEN coalesce(x ->> '$.end', x ->> '$.end_time', x ->> '$.to') ELSE coalesce(x ->> '$.end', x ->> '$.end_time') END AS e0 FROM each),
secs AS (SELECT *, list_reduce(list_transform(string_split(s0, ':'), lambda v: CAST(v AS DOUBLE)), lambda a, v: a * 60 + v) AS s1, list_reduce(list_transform(string_split(coalesce(e0, s0), ':'), lambda v: CAST(v AS DOUBLE)), lambda a, v: a * 60 + v) AS e1 FROM stamp),
noted AS (SELECT ep, segment, c AS channel, t + CAST(round_even(CASE WHEN s1 BETWEEN 0 AND 5.5 THEN s1 END * 1000, 0) AS BIGINT) AS start, t + CAST(round_even(CASE WHEN e1 BETWEEN 0 AND 5.5 THEN e1 END * 1000, 0) AS BIGINT) AS "end", CASE WHEN c = 'actions' THEN x ->> '$.who' END AS who, coalesce(x ->> '$.what', x ->> '$.text', x ->> '$.content') AS what,
  CASE WHEN c = 'actions' THEN CASE WHEN lower(x ->> '$.mouth_state') IN ('moving', 'still', 'not_visible') THEN lower(x ->> '$.mouth_state') ELSE 'unknown' END END AS mouth_state FROM secs)"""
SQL["note_entries"] = w(BASE, NOTED) + """SELECT ep, segment, channel, coalesce("end" >= start AND what IS NOT NULL, false) AS ok, start, "end", who, what, mouth_state FROM noted"""
SQL["note_drops"] = w(BASE, NOTED) + """SELECT ep, segment, channel, count(*) FILTER (NOT coalesce("end" >= start AND what IS NOT NULL, false)) AS dropped FROM noted GROUP BY ALL"""
SQL["audio_encodings"] = """WITH e AS (SELECT event_id, event_id % 5000 AS s, event_id * 3000 AS raw FROM events)
SELECT event_id, CASE WHEN raw <= 7275000 THEN 'passthrough' WHEN s * 32000 <= 7275000 THEN 'wav' WHEN s * 8000 <= 7275000 THEN 'mp3-64' WHEN s * 6000 <= 7275000 THEN 'mp3-48' WHEN s * 5000 <= 7275000 THEN 'mp3-40'
  WHEN s * 4000 <= 7275000 THEN 'mp3-32' WHEN s * 3000 <= 7275000 THEN 'mp3-24' WHEN s * 2000 <= 7275000 THEN 'mp3-16' END AS encoding FROM e"""
SQL["silence_sessions"] = """WITH g AS (SELECT user_id AS ep, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 14400000000 THEN 0 ELSE 1 END AS nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY ep ORDER BY u ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT ep, min(u) AS start_us, max(u) + 14400000000 AS end_us, count(*) AS events FROM s GROUP BY ep, n"""
SQL["evidence_pack"] = (
    w(BASE, shots(), CUES, SCENES)
    + f""", cc AS ({SQL["cue_scene_counts"]}), cv AS ({SQL["coverage_union"]})
SELECT n.ep, n.pos, n.s AS r_start_ms, n.e AS r_end_ms, n.shots, cc.cue_count, cv.covered_pct,
  CASE WHEN greatest(0, least(n.e, 105000) - greatest(n.s, 84000)) / greatest(1, n.e - n.s) > 0.5 THEN 'OP' WHEN greatest(0, least(n.e, 1440000) - greatest(n.s, 1320000)) / greatest(1, n.e - n.s) > 0.5 THEN 'ED' END AS label
FROM scenes n LEFT JOIN cc USING (ep, pos) LEFT JOIN cv USING (ep, pos)"""
)
SQL["overlapped_windows"] = """WITH e AS (SELECT user_id AS ep, epoch_us(ts) // 60000000 AS m FROM events)
SELECT ep, (m // 85 - k) * 85 * 60000000 AS start_us, count(*) AS events FROM e, (VALUES (0), (1)) v(k) WHERE m < (m // 85 - k) * 85 + 90 GROUP BY ALL"""
SQL["unfinished_work"] = "SELECT event_id FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0"
SQL["violation_messages"] = "WITH v AS (" + SQL["placeholder_check"] + "), r AS (SELECT *, row_number() OVER (PARTITION BY ep, rule ORDER BY sub) AS k FROM v) SELECT ep, rule, string_agg(sub::VARCHAR, ', ' ORDER BY sub) FILTER (k <= 12) AS listed, count(*) AS n FROM r GROUP BY ep, rule"
SQL["embedded_choice"] = """WITH s AS (SELECT event_id // 6 AS ep, event_id AS index, ['eng', 'chi', 'zho'][event_id % 3 + 1] AS lang, event_id % 5 = 0 OR event_id % 7 = 0 AS skip FROM events WHERE event_id % 4 > 0),
r AS (SELECT *, CASE WHEN skip THEN 9 WHEN lang = 'chi' THEN 0 WHEN lang = 'zho' THEN 1 ELSE 5 END AS o FROM s) SELECT ep, index, CASE o WHEN 9 THEN 'last_resort' WHEN 5 THEN 'first_non_sign' ELSE 'language' END AS reason FROM r QUALIFY row_number() OVER (PARTITION BY ep ORDER BY o, index) = 1"""
SQL["scene_manifest"] = (
    w(BASE, shots(), CUES, ACTIONS)
    + """, n AS (SELECT ep, pos // 20 + 1 AS scene, min(s) AS s, max(e) AS e FROM shots GROUP BY ALL),
c AS (SELECT ep, scene, count(*) AS cues FROM (SELECT c.ep, c.cue, n.scene, row_number() OVER (PARTITION BY c.ep, c.cue ORDER BY least(c.e, n.e) - greatest(c.s, n.s) DESC, n.scene) AS r FROM cues c JOIN n ON n.ep = c.ep AND least(c.e, n.e) > greatest(c.s, n.s)) WHERE r = 1 GROUP BY ALL),
a AS (SELECT n.ep, n.scene, count(*) AS acts FROM actions x JOIN n ON n.ep = x.ep AND least(x.e, n.e) > greatest(x.s, n.s) GROUP BY ALL),
m AS (SELECT n.ep, n.scene, h.pos, h.s >= n.s - 700 AND h.s < n.e - 700 AS inside FROM n JOIN shots h ON h.ep = n.ep AND least(h.e, n.e - 700) > greatest(h.s, n.s - 700)),
k AS (SELECT *, bool_or(inside) OVER (PARTITION BY ep, scene) AS found FROM m), q AS (SELECT ep, scene, pos, row_number() OVER (PARTITION BY ep, scene ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY ep, scene) AS n FROM k WHERE inside OR NOT found),
t AS (SELECT DISTINCT ep, scene, CAST(floor(j * (n / 12.0)) AS BIGINT) AS i FROM (SELECT DISTINCT ep, scene, n FROM q WHERE n > 12), generate_series(0, 11) g(j)),
f AS (SELECT q.ep, q.scene, count(*) AS pictures FROM q LEFT JOIN t USING (ep, scene, i) WHERE (n <= 12 OR t.i IS NOT NULL) AND (q.ep + q.pos) % 4 > 0 GROUP BY ALL)
SELECT n.ep, n.scene, CASE WHEN greatest(0, least(e, 105000) - greatest(s, 84000)) / greatest(1, e - s) > 0.5 THEN 'OP' WHEN greatest(0, least(e, 1440000) - greatest(s, 1320000)) / greatest(1, e - s) > 0.5 THEN 'ED' END AS label,
  coalesce(cues, 0) AS cues, coalesce(acts, 0) AS acts, coalesce(pictures, 0) AS pictures, (n.ep + n.scene) % 3 > 0 AS written FROM n LEFT JOIN c USING (ep, scene) LEFT JOIN a USING (ep, scene) LEFT JOIN f USING (ep, scene)"""
)

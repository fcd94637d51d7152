"""Queries over scenes: sequences, assembly, pictures, notes and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import align, notes, scenes, segment, windows
from ..sources import testdata as td
from .oracles import ACTIONS, ASSIGN, BASE, CUES, CUTS, LINES, SCENES, SEQUENCES, SQL, shots, w
from .registry import ORACLES, query


def walled(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """shots, cues, cuts and the sequence that each shot lies in."""
    from .catalogue import sequences

    shown, cues = td.shots(spark, d), td.cues(spark, d)
    cuts = segment.boundaries(shown)
    walls = segment.snap_walls(segment.walls(sequences(spark, d), cues), cuts)
    return shown, cues, cuts, scenes.sequence_parts(walls, shown)


#: the walls of the sequence_walls query, up to their snapped boundaries (fix)
SNAPPED = ", wl AS" + SQL["sequence_walls"].split(", wl AS", 1)[1].split("SELECT f.ep, f.wall, f.b AS boundary", 1)[0]
PARTS = """
, ends AS (SELECT ep, max(pos) AS last FROM shots GROUP BY ep), fit AS (SELECT ep, max(b) AS top FROM fix GROUP BY ep),
part AS (SELECT h.ep, h.pos, h.s, h.e, CASE WHEN f.top < n.last THEN 1 + (SELECT count(*) FROM fix x WHERE x.ep = h.ep AND x.b < h.pos) ELSE 0 END AS seq FROM shots h JOIN ends n USING (ep) LEFT JOIN fit f USING (ep))"""


@query(w(BASE, shots(), CUES, CUTS, SEQUENCES) + SNAPPED + PARTS + "SELECT ep, seq, min(pos) AS first_pos, max(pos) AS last_pos FROM part GROUP BY ALL")
def sequence_ranges(spark, d):
    """The shots of each narrative sequence; 0 where the outline does not fit the cuts."""
    return walled(spark, d)[3].groupBy("ep", "seq").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def hierarchical(spark, d) -> DataFrame:
    shown, cues, cuts, parts = walled(spark, d)
    return scenes.solve_sequences(shown, segment.features(cues, cuts), segment.protected(cues, cuts), parts)


@query()
def hierarchical_scenes(spark, d):
    """Scenes solved inside each sequence."""
    return hierarchical(spark, d).drop("cap")


@query(
    w(BASE, shots(), CUES, CUTS, SEQUENCES) + SNAPPED + PARTS
    + """, whole AS (SELECT ep, sum(e - s) AS w FROM shots GROUP BY ep)
SELECT p.ep, p.seq, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS shots, greatest(1, CAST(round_even(35 * greatest(1, max(e) - min(s)) / any_value(w), 0) AS BIGINT)) AS cap, true AS in_order FROM part p JOIN whole USING (ep) GROUP BY p.ep, p.seq"""
)
def sequence_summary(spark, d):
    """Scenes of a sequence follow on from one another, cover its shots and stay within its share of the budget."""
    rows = hierarchical(spark, d)
    after = F.lag("last_pos").over(Window.partitionBy("ep", "seq").orderBy("scene"))
    rows = rows.withColumn("follows", F.coalesce(after + 1 == F.col("first_pos"), F.lit(True)))
    summary = scenes.sequence_summary(rows)
    told = rows.groupBy("ep", "seq").agg(F.sum(F.col("last_pos") - F.col("first_pos") + 1).alias("shots"), F.max("cap").cast("long").alias("cap"), F.every("follows").alias("follows"))
    return summary.join(told, ["ep", "seq"]).select("ep", "seq", "first_pos", "last_pos", "shots", "cap", (F.col("follows") & (F.col("scene_count") <= F.col("cap"))).alias("in_order"))


PLACES = ["zzz", '"k": 7', '"k": 1', ""]


@query(
    w(BASE, shots(), CUES, SCENES)
    + """, p AS (SELECT c.ep, c.cue, c.txt, n.pos, row_number() OVER (PARTITION BY c.ep, c.cue ORDER BY least(c.e, n.e) - greatest(c.s, n.s) DESC, n.pos) AS r FROM cues c JOIN scenes n ON n.ep = c.ep AND least(c.e, n.e) > greatest(c.s, n.s)),
l AS (SELECT ep, pos, count(*) AS cues, string_agg(txt, ' ' ORDER BY cue) AS lines FROM p WHERE r = 1 GROUP BY ALL), k AS (SELECT ep, pos // 5 AS pos, list(pos ORDER BY pos) AS kids FROM shots GROUP BY ALL),
g AS (SELECT n.*, coalesce(cues, 0) AS cues, kids, lpad((n.pos + 1)::VARCHAR, greatest(2, length((n.pos + 1)::VARCHAR))::INTEGER, '0') AS num, CASE WHEN contains(lines, 'zzz') THEN 'zzz' WHEN contains(lines, '"k": 7') THEN '"k": 7' WHEN contains(lines, '"k": 1') THEN '"k": 1' END AS place FROM scenes n JOIN k USING (ep, pos) LEFT JOIN l USING (ep, pos))
SELECT ep, pos + 1 AS scene, 'SCENE_' || num AS scene_id, s AS start_ms, e AS end_ms, e - s AS duration_ms, shots, kids[shots // 2 + 1] AS keyframe_pos, array_to_string(kids, ',') AS children, cues, coalesce('INT/EXT. ' || place || ' - ', '') || 'SCENE ' || num AS slugline FROM g"""
)
def scene_assembly(spark, d):
    shown, cues = td.shots(spark, d), td.cues(spark, d)
    ranges = shown.groupBy("ep", (F.floor(F.col("pos") / 5) + 1).cast("long").alias("scene")).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    places = shown.select("ep").distinct().select("ep", F.posexplode(F.array(*map(F.lit, PLACES))).alias("ord", "place"))
    return scenes.assemble(ranges, shown, cues, places)


# pictures ---------------------------------------------------------------------------------------------------

FRAMES = """
unit AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) / list_sum(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE))))) AS h FROM embeddings),
frames AS (SELECT s.ep, s.pos, u.h FROM shots s JOIN unit u ON u.vec_id = (s.ep * 7 + s.pos) % 100 WHERE (s.ep + s.pos) % 4 > 0)"""


def frames(spark, d) -> DataFrame:
    """ep, pos, histogram: pictures of three shots in four."""
    rows = td.table(spark, d, "embeddings")
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    unit = rows.select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) / size).alias("histogram"))
    held = td.shots(spark, d).filter((F.col("ep") + F.col("pos")) % 4 > 0).select("ep", "pos", ((F.col("ep") * 7 + F.col("pos")) % 100).alias("vec_id"))
    return held.join(unit, "vec_id").select("ep", "pos", "histogram")


@query(
    w(BASE, shots(), CUTS, FRAMES)
    + """SELECT k.ep, count(a.pos) FILTER (b.pos IS NOT NULL) AS measured, count(*) AS total FROM cuts k LEFT JOIN frames a ON a.ep = k.ep AND a.pos = k.boundary LEFT JOIN frames b ON b.ep = k.ep AND b.pos = k.boundary + 1 GROUP BY k.ep"""
)
def visual_coverage(spark, d):
    return scenes.visual_coverage(scenes.visual_changes(segment.boundaries(td.shots(spark, d)), frames(spark, d)))


@query(
    w(BASE, shots(), CUES, CUTS, FRAMES)
    + ", bf AS (WITH f AS" + SQL["boundary_features"].split(", f AS", 1)[1]
    + """), vis AS (SELECT k.ep, k.boundary, CASE WHEN a.pos IS NOT NULL AND b.pos IS NOT NULL THEN greatest(0, least(1, 1 - list_sum(list_transform(list_zip(a.h, b.h), lambda z: least(z[1], z[2]))))) ELSE 0 END AS v FROM cuts k LEFT JOIN frames a ON a.ep = k.ep AND a.pos = k.boundary LEFT JOIN frames b ON b.ep = k.ep AND b.pos = k.boundary + 1)
SELECT bf.ep, bf.boundary, CAST(round(least(1.0::DOUBLE, score + 0.35::DOUBLE * v), 6) AS DOUBLE) AS score FROM bf JOIN vis USING (ep, boundary)"""
)
def boundary_visual_scores(spark, d):
    """Boundary scores with pictures: those of two unlike shots speak for a change of scene."""
    cuts = scenes.visual_changes(segment.boundaries(td.shots(spark, d)), frames(spark, d))
    return segment.features(td.cues(spark, d), cuts).select("ep", "boundary", F.round("score", 6).alias("score"))


@query(
    w(BASE, shots(), SCENES)
    + """, kids AS (SELECT ep, pos // 5 AS scene, list(pos) AS kids FROM shots GROUP BY ALL)
SELECT ep, scene, CASE WHEN ep % 4 = 0 THEN true WHEN scene % 3 = 2 THEN scene % 2 = 1 WHEN scene % 7 = 6 THEN false ELSE len(list_filter(kids, lambda p: p % 6 > 3)) > 0 END AS verified FROM kids"""
)
def visual_verified(spark, d):
    """Scenes with some picture: children, no children, neither; nothing failed where ep is a multiple of four."""
    shown = td.shots(spark, d)
    rows = shown.groupBy("ep", F.floor(F.col("pos") / 5).cast("long").alias("scene")).agg(F.collect_list("pos").alias("kids"), F.collect_list(F.when(F.col("pos") % 6 <= 3, F.col("pos"))).alias("bad"))
    alone = F.col("scene") % 3 == 2
    failed = F.when(F.col("ep") % 4 == 0, F.array().cast("array<bigint>")).when(alone, F.when(F.col("scene") % 2 == 0, F.array("scene")).otherwise(F.array(F.lit(-1).cast("bigint")))).otherwise(F.concat("bad", F.array(F.lit(-1).cast("bigint"))))
    nobody = ~alone & (F.col("scene") % 7 == 6)
    children = F.when(alone | nobody, F.array().cast("array<bigint>")).otherwise(F.col("kids"))
    own = F.when(nobody, F.lit(None).cast("bigint")).otherwise(F.col("scene"))
    return rows.select("ep", "scene", scenes.visually_verified(children, own, failed).alias("verified"))


@query(
    w(BASE, shots(), SCENES.replace("// 5", "// 20"))
    + """, m AS (SELECT n.ep, n.pos + 1 AS scene, h.pos, h.s >= n.s - 700 AND h.s < n.e - 700 AS inside FROM scenes n JOIN shots h ON h.ep = n.ep AND least(h.e, n.e - 700) > greatest(h.s, n.s - 700)),
k AS (SELECT *, bool_or(inside) OVER (PARTITION BY ep, scene) AS found FROM m), r AS (SELECT ep, scene, pos, row_number() OVER (PARTITION BY ep, scene ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY ep, scene) AS n FROM k WHERE inside OR NOT found),
t AS (SELECT DISTINCT ep, scene, CAST(floor(j * (n / 12.0)) AS BIGINT) AS i FROM (SELECT DISTINCT ep, scene, n FROM r WHERE n > 12), generate_series(0, 11) g(j))
SELECT r.ep, r.scene, r.pos FROM r LEFT JOIN t USING (ep, scene, i) WHERE (n <= 12 OR t.i IS NOT NULL) AND (r.ep + r.pos) % 4 > 0"""
)
def keyframe_samples(spark, d):
    """Evenly picked pictures of scenes that lie a little off the cuts."""
    shown = td.shots(spark, d).withColumn("keyframe", F.when((F.col("ep") + F.col("pos")) % 4 > 0, F.lit("k.jpg")))
    spans = align.scenes_of(td.shots(spark, d), 20).select("ep", (F.col("pos") + 1).alias("scene"), (F.col("r_start_ms") - 700).alias("start_ms"), (F.col("r_end_ms") - 700).alias("end_ms"))
    return scenes.sampled_frames(spans, shown)


# notes ------------------------------------------------------------------------------------------------------


@query(
    w(LINES)
    + r""", n AS (SELECT ep, index, lower(regexp_replace(coalesce(text, ''), '[\s\x{3000}\x{00a0}，。：:；;！!？?、,.\[\]【】()（）「」『』…—·\-–]', '', 'g')) AS norm, speaker FROM lines),
v AS (SELECT ep, CASE WHEN index % 2 = 0 THEN norm ELSE norm || 'x' END AS norm FROM n WHERE index % 3 < 2) SELECT ep, count(*) AS echoes FROM v WHERE norm <> '' AND (ep, norm) IN (SELECT (ep, norm) FROM n) GROUP BY ep"""
)
def subtitle_echo(spark, d):
    """Seen texts that only repeat a line, other punctuation aside."""
    rows = td.lines(spark, d)
    seen = rows.filter("index % 3 < 2").select("ep", F.when(F.col("index") % 2 == 0, F.concat(F.lit("「"), F.col("text"), F.lit("」！"))).otherwise(F.concat("text", F.lit("x"))).alias("text"))
    return scenes.subtitle_echoes(seen, rows)


SAVED = """
saved AS (SELECT ep, event_id AS segment, CASE event_id % 6 WHEN 0 THEN '{"raw": {"visual": {"caption": "c"}}, "meta": {"usage": {"total_tokens": ' || event_id % 100 || '}}}' WHEN 1 THEN '{"visual": {"caption": ""}}' WHEN 2 THEN '{"raw": 3}' WHEN 3 THEN '{"raw": {"visual": ' WHEN 4 THEN NULL
  ELSE '{"raw": {"visual": {"actions": [{"start": 1, "what": "w"}, {"start": 9999999}]}}, "meta": {"usage": {"total_tokens": "7"}}}' END AS note FROM base WHERE event_type = 'error')"""


def saved(spark, d) -> DataFrame:
    e = F.col("event_id")
    note = (
        F.when(e % 6 == 0, F.format_string('{"raw": {"visual": {"caption": "c"}}, "meta": {"usage": {"total_tokens": %d}}}', e % 100)).when(e % 6 == 1, '{"visual": {"caption": ""}}').when(e % 6 == 2, '{"raw": 3}')
        .when(e % 6 == 3, '{"raw": {"visual": ').when(e % 6 == 4, None).otherwise('{"raw": {"visual": {"actions": [{"start": 1, "what": "w"}, {"start": 9999999}]}}, "meta": {"usage": {"total_tokens": "7"}}}')
    )
    return td.base(spark, d).filter("event_type = 'error'").select("ep", e.alias("segment"), F.col("t").alias("start_ms"), (F.col("t") + 5000).alias("end_ms"), note.alias("note"))


@query(w(BASE, SAVED) + """SELECT ep, segment, CASE WHEN json_valid(note) AND (json_type(note, '$.raw') = 'OBJECT' OR json_exists(note, '$.visual')) THEN 0 ELSE 7 END AS code, CASE WHEN json_valid(note) THEN coalesce(TRY_CAST(note ->> '$.meta.usage.total_tokens' AS BIGINT), 0) ELSE 0 END AS tokens FROM saved""")
def note_status(spark, d):
    return notes.note_status(saved(spark, d))


@query(
    w(BASE, SAVED)
    + """, p AS (SELECT ep, segment, CASE WHEN json_valid(note) THEN CASE WHEN json_type(note, '$.raw') = 'OBJECT' THEN json_extract(note, '$.raw') WHEN json_exists(note, '$.visual') THEN note::JSON END END AS raw FROM saved),
a AS (SELECT ep, segment, list_filter(from_json(json_extract(raw, '$.visual.actions'), '["JSON"]'), lambda x: CAST(x ->> '$.start' AS DOUBLE) BETWEEN 0 AND 5.5 AND (x ->> '$.what') IS NOT NULL) AS used FROM p)
SELECT ep, segment, coalesce(trim(raw ->> '$.visual.caption'), '') <> '' OR coalesce(len(used), 0) > 0 AS parsed, coalesce(trim(raw ->> '$.visual.caption'), '') <> '' OR coalesce(json_array_length(raw, '$.visual.actions'), 0) > 0 AS shaped FROM p JOIN a USING (ep, segment) WHERE raw IS NOT NULL"""
)
def note_substance(spark, d):
    """Notes that hold something: of what could be used, and by shape alone."""
    rows = saved(spark, d).withColumn("raw", F.when(F.try_parse_json("note").isNotNull(), notes.payload(F.col("note")))).filter("raw is not null")
    used = notes.parsed_substance(rows, notes.entries(rows)).withColumnRenamed("substance", "parsed")
    return used.join(notes.has_substance(rows).withColumnRenamed("substance", "shaped"), ["ep", "segment"])


@query(
    w(BASE, shots(10**9), SCENES, ACTIONS, SAVED)
    + ", cov AS (WITH cl AS" + SQL["coverage_union"].split(", cl AS", 1)[1]
    + """), s AS (SELECT ep, CAST(coalesce(sum(CASE WHEN json_valid(note) THEN TRY_CAST(note ->> '$.meta.usage.total_tokens' AS BIGINT) END), 0) AS BIGINT) AS tokens FROM saved GROUP BY ep)
SELECT s.ep, tokens, covered_min, covered_avg FROM s LEFT JOIN (SELECT ep, min(covered_pct) AS covered_min, CAST(round(avg(covered_pct), 6) AS DOUBLE) AS covered_avg FROM cov GROUP BY ep) USING (ep)"""
)
def note_usage(spark, d):
    from .catalogue import coverage_union

    rows = scenes.usage(saved(spark, d).select("ep", F.col("note").alias("payload")), coverage_union(spark, d))
    return rows.withColumn("covered_avg", F.round("covered_avg", 6))


# plans and gates --------------------------------------------------------------------------------------------


@query(
    w(BASE, shots(), SCENES)
    + """, l AS (SELECT *, CASE WHEN greatest(0, least(e, 105000) - greatest(s, 84000)) / greatest(1, e - s) > 0.5 THEN 'OP' WHEN greatest(0, least(e, 1440000) - greatest(s, 1320000)) / greatest(1, e - s) > 0.5 THEN 'ED' END AS label FROM scenes)
SELECT ep, pos, CASE WHEN label IS NOT NULL THEN label WHEN e - s < 1500 THEN 'short' ELSE 'planned' END AS fate FROM l"""
)
def segment_fates(spark, d):
    """Scenes that are planned for viewing, and why others are not."""
    return windows.segment_fates(align.scenes_of(td.shots(spark, d), 5), td.WINDOWS)


@query(
    w(BASE)
    + """, e AS (SELECT ep, max(t) AS n FROM base GROUP BY ep), m AS (SELECT ep, list(t / 1000.0::DOUBLE ORDER BY t) AS s FROM (SELECT DISTINCT ep, t FROM base WHERE event_type = 'error' AND t % 3 = 0) GROUP BY ep),
b AS (SELECT ep, k, k * 100.0::DOUBLE AS b, s FROM m, generate_series(1, 3) g(k)),
r AS (SELECT ep, 0 AS k, []::BIGINT[] AS used, []::DOUBLE[] AS got FROM m
  UNION ALL SELECT r.ep, b.k, CASE WHEN p.i IS NULL THEN used ELSE list_append(used, p.i) END, list_append(got, coalesce(b.s[p.i], b.b)) FROM r JOIN b ON b.ep = r.ep AND b.k = r.k + 1
  LEFT JOIN LATERAL (SELECT CASE WHEN len(c) > 0 THEN -list_min(c)[2] END AS i FROM (SELECT list_transform(list_filter(range(1, len(b.s) + 1), lambda i: NOT list_contains(r.used, i) AND abs(b.s[i] - b.b) <= 5), lambda i: [abs(b.s[i] - b.b), -i]) AS c)) q(i0) ON true LEFT JOIN LATERAL (SELECT CAST(q.i0 AS BIGINT) AS i) p ON true)
SELECT ep, array_to_string(list_transform(list_sort(got), lambda x: CAST(round(x * 1000) AS BIGINT)), ',') AS bounds FROM r WHERE k = 3"""
)
def snapped_bounds(spark, d):
    """Planned bounds moved to the nearest silence that no other bound took."""
    quiet = td.base(spark, d).filter("event_type = 'error' and t % 3 = 0").select("ep", "t").distinct().groupBy("ep").agg(F.sort_array(F.collect_list(F.col("t") / 1000.0)).alias("s"))
    got = windows.snap_to_silence(F.array(*[F.lit(100.0 * k) for k in (1, 2, 3)]), F.col("s"))
    return quiet.select("ep", F.array_join(F.transform(got, lambda x: F.rint(x * 1000).cast("long").cast("string")), ",").alias("bounds"))


@query(w(BASE, shots()) + "SELECT ep, pos, CAST(sum(e - s) OVER (PARTITION BY ep ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto_ms FROM shots")
def duration_sums(spark, d):
    return segment.duration_sums(td.shots(spark, d))


@query(
    w(BASE, shots(), CUES)
    + """, h AS (SELECT * FROM shots WHERE ep % 10 > 0) SELECT ep, 'no_shots' AS rule, count(*) AS n FROM cues WHERE ep NOT IN (SELECT ep FROM h) GROUP BY ep
UNION ALL SELECT ep, 'orphans', count(*) FROM cues WHERE ep IN (SELECT ep FROM h) AND cue % 9 = 0 AND ep % 3 = 0 GROUP BY ep UNION ALL SELECT ep, 'no_scenes', count(*) FROM h WHERE ep % 7 = 0 GROUP BY ep"""
)
def alignment_violations(spark, d):
    """Episodes without shots or scenes, and cues taken off their shots."""
    cues, shown = td.cues(spark, d), td.shots(spark, d).filter("ep % 10 > 0")
    assigned = align.assign_cues(cues, shown).filter("not (cue % 9 = 0 and ep % 3 = 0)")
    return scenes.alignment_violations(cues, shown, assigned, align.scenes_of(shown.filter("ep % 7 > 0"), 5))


@query(
    w(BASE, CUES, SEQUENCES)
    + """, n AS (SELECT ep, max(seq) AS n FROM seqs GROUP BY ep), acts AS (SELECT ep, n, unnest([1, 2]) AS act, unnest([1, n // 2 + 1 + CASE WHEN ep % 3 = 0 THEN 1 ELSE 0 END]) AS a, unnest([n // 2, n + CASE ep % 4 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END]) AS b FROM n),
g AS (SELECT *, coalesce(lag(b) OVER o + 1, 1) AS due, lead(act) OVER o IS NULL AS fin FROM acts WINDOW o AS (PARTITION BY ep ORDER BY act))
SELECT ep, act, 'break' AS problem FROM g WHERE a <> due UNION ALL SELECT ep, act, 'reversed' FROM g WHERE b < a UNION ALL SELECT ep, act, 'beyond' FROM g WHERE b > n UNION ALL SELECT ep, act, 'short' FROM g WHERE fin AND b < n"""
)
def act_gaps(spark, d):
    from .catalogue import sequences

    n = sequences(spark, d).groupBy("ep").agg(F.max("seq").alias("n"))
    half = F.floor(F.col("n") / 2).cast("long")
    act = lambda k, a, b: F.struct(F.lit(k).alias("act"), a.cast("long").alias("start_seq"), b.cast("long").alias("end_seq"))
    acts = F.array(act(1, F.lit(1), half), act(2, half + 1 + F.when(F.col("ep") % 3 == 0, 1).otherwise(0), F.col("n") + F.when(F.col("ep") % 4 == 1, 1).when(F.col("ep") % 4 == 2, -1).otherwise(0)))
    return scenes.act_gaps(n.select("ep", F.explode(acts).alias("x")).select("ep", "x.*"), n)


@query(
    w(BASE, CUES, SEQUENCES)
    + """, x AS (SELECT ep, seq, CASE WHEN seq % 4 = 0 THEN seq + 1 ELSE seq END AS seq_index, CASE WHEN (ep + seq) % 5 = 0 THEN ' ' ELSE 't' END AS title, CASE WHEN (ep + seq) % 6 = 0 THEN NULL ELSE 'a' END AS value_from, a, CASE WHEN (ep + seq) % 7 = 0 THEN b + 1000 ELSE b END AS b FROM seqs WHERE ep % 8 > 0)
SELECT ep, seq, 'no_title' AS fault FROM x WHERE trim(title) = '' UNION ALL SELECT ep, seq, 'no_value_from' FROM x WHERE value_from IS NULL UNION ALL SELECT ep, seq, 'numbering' FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY seq) AS p FROM x) WHERE p <> seq_index
UNION ALL SELECT ep, seq, 'unknown_cue' FROM x WHERE (ep, b) NOT IN (SELECT (ep, cue) FROM cues) UNION ALL SELECT DISTINCT ep, NULL, 'missing' FROM cues WHERE ep % 8 = 0"""
)
def outline_faults(spark, d):
    from .catalogue import sequences

    at = F.col("ep") + F.col("seq")
    rows = sequences(spark, d).filter("ep % 8 > 0").select(
        "ep", "seq", F.when(F.col("seq") % 4 == 0, F.col("seq") + 1).otherwise(F.col("seq")).alias("seq_index"), F.when(at % 5 == 0, " ").otherwise("t").alias("title"), F.when(at % 6 == 0, None).otherwise("a").alias("value_from"), F.lit("b").alias("value_to"),
        "start_sub", F.when(at % 7 == 0, F.col("end_sub") + 1000).otherwise(F.col("end_sub")).alias("end_sub"),
    )
    return scenes.outline_faults(rows, td.cues(spark, d))


@query(
    w(BASE, CUES)
    + """, n AS (SELECT ep, count(*) FILTER (ep % 3 = 0 AND cue % 2 = 0) AS a, count(*) FILTER (ep % 3 < 2) AS b FROM cues GROUP BY ep), e AS (SELECT DISTINCT ep FROM base), g AS (SELECT e.ep, coalesce(CASE WHEN a > 0 THEN a ELSE b END, 0) AS n, ['external', 'embedded', 'ocr', 'none', NULL][e.ep % 5 + 1] AS mode FROM e LEFT JOIN n USING (ep))
SELECT ep, CASE WHEN mode = 'none' THEN 5 WHEN n > 0 THEN 0 WHEN mode = 'external' THEN 5 ELSE 6 END AS code, CASE WHEN mode = 'none' THEN 'no_subtitles' WHEN n > 0 THEN 'ready' WHEN mode = 'external' THEN 'no_subtitles' ELSE 'needs_ocr' END AS state FROM g"""
)
def subtitle_gate(spark, d):
    from .files import extraction_tiers

    found = extraction_tiers(spark, d)
    mode = F.element_at(F.array(*[F.lit(x) for x in ["external", "embedded", "ocr", "none", None]]), (F.col("ep") % 5 + 1).cast("int"))
    return scenes.subtitle_gate(found.select("ep", mode.alias("mode")), found)


@query("WITH st AS (" + ORACLES["part_status"] + """) SELECT ep, CASE WHEN count(*) FILTER (state IN ('missing', 'invalid')) = 0 THEN 0 WHEN ep % 2 = 0 THEN 7 ELSE 8 END AS code FROM st GROUP BY ep""")
def part_gate(spark, d):
    """Episodes whose parts are not all answered, with and without a key."""
    from ..sources.artifacts import part_status
    from .files import reply_parts

    rows = part_status(reply_parts(spark, d))
    return scenes.part_gate(rows.withColumn("key", F.col("ep") % 2 == 0), F.col("key"))

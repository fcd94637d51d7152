"""Queries over files: subtitle scans, logs, listings, artifacts, replies, configuration, and what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import timecode
from ..operators import windows
from ..sources import artifacts, replies, sinks, subtitles
from ..sources import testdata as td
from .oracles import BASE, CUES, TURNS, w, shots
from .registry import query


def joined(df: DataFrame, keys: list[str], order: list[str], line: str, by: str = "\n") -> DataFrame:
    """keys, text: the lines of a key, in order, as one file."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_line"]), by).alias("text"))


# subtitle files ---------------------------------------------------------------------------------------------


@query(
    w(BASE, CUES)
    + """, x AS (SELECT ep, cue, event_id, speaker, greatest(0, s) AS a, greatest(0, e) AS b, (event_id * 7) % 101 AS o FROM cues WHERE cue % 7 <> 0)
SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY a, o, event_id) AS index, a AS start_ms, b AS end_ms,
  CASE WHEN cue % 3 = 0 THEN 'line ' ELSE 'said ' END || event_id || CASE WHEN cue % 4 = 0 THEN ' more' ELSE '' END AS text, CASE WHEN cue % 3 = 0 THEN speaker END AS speaker FROM x"""
)
def subtitle_scan(spark, d):
    """SRT files, blocks out of order, some with named cue ids, tags, speakers or nothing to say."""
    rows = td.cues(spark, d)
    comma = lambda c: F.replace(timecode(F.col(c)), F.lit("."), F.lit(","))
    said = F.when(F.col("cue") % 3 == 0, F.format_string("%s: <i>line</i> %d", "speaker", "event_id")).otherwise(F.format_string("<b>said</b> %d", "event_id"))
    said = F.when(F.col("cue") % 7 == 0, "<i></i>").otherwise(F.concat(said, F.when(F.col("cue") % 4 == 0, "\nmore").otherwise("")))
    head = F.when(F.col("cue") % 5 == 0, "cue-a").otherwise(F.col("cue").cast("string"))
    block = F.concat(head, F.lit("\n"), comma("start_ms"), F.lit(" --> "), comma("end_ms"), F.lit("\n"), said)
    files = joined(rows.withColumn("block", block).withColumn("o", F.col("event_id") * 7 % 101), ["ep"], ["o", "event_id"], "block", "\n\n")
    found = subtitles.parse_srt(files.select(F.col("ep").cast("string").alias("path"), "text"))
    return found.select(F.col("path").cast("long").alias("ep"), F.col("index").cast("long").alias("index"), "start_ms", "end_ms", "text", "speaker")


@query(
    w(BASE, CUES)
    + """, x AS (SELECT ep, cue, event_id, greatest(0, s) AS a, greatest(0, e) AS b FROM cues)
SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY a, cue) AS index, a AS start_ms, b AS end_ms, 'say ' || event_id || ', ok then' AS text,
  CASE WHEN event_id % 3 = 0 THEN 'Ann' WHEN event_id % 4 = 0 THEN 'Hero' END AS speaker FROM x"""
)
def ass_scan(spark, d):
    """ASS files: columns by their format line, override tags, names and styles."""
    rows = td.cues(spark, d)
    name, style = F.when(F.col("event_id") % 3 == 0, "Ann").otherwise(""), F.when(F.col("event_id") % 4 == 0, "Hero").otherwise("Default")
    line = F.concat(F.lit("Dialogue: 0,"), timecode(F.col("start_ms")), F.lit(","), timecode(F.col("end_ms")), F.lit(","), style, F.lit(","), name, F.lit(",0,0,0,,{\\i1}say "), F.col("event_id").cast("string"), F.lit("{\\i0}, ok\\Nthen"))
    files = joined(rows.withColumn("line", line), ["ep"], ["cue"], "line")
    head = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    found = subtitles.parse_ass(files.select(F.col("ep").cast("string").alias("path"), F.concat(F.lit(head), "text").alias("text")))
    return found.select(F.col("path").cast("long").alias("ep"), F.col("index").cast("long").alias("index"), "start_ms", "end_ms", "text", "speaker")


@query(
    w(BASE)
    + """, m AS (SELECT ep, event_type, t / 1000.0::DOUBLE AS s, lag(event_type) OVER o AS pt, lag(t / 1000.0::DOUBLE) OVER o AS ps, row_number() OVER o AS pos FROM base WHERE event_type IN ('error', 'signup') WINDOW o AS (PARTITION BY ep ORDER BY t, event_id))
SELECT ep, (ps + s) / 2 AS midpoint FROM m WHERE event_type = 'signup' AND pt = 'error'"""
)
def silence_scan(spark, d):
    """Silence logs: errors stand for starts, signups for ends, other lines between them."""
    at = (F.col("t") / 1000).cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("[silencedetect @ 0x1] silence_start: "), at)).when(F.col("event_type") == "signup", F.concat(F.lit("silence_end: "), at, F.lit(" | silence_duration: 1"))).otherwise("frame")
    rows = td.base(spark, d).select("ep", F.struct("t", "event_id").alias("pos"), line.alias("line"))
    return subtitles.parse_silences(rows).select("ep", "midpoint")


CUT_TIMES = """, pts AS (SELECT DISTINCT ep, CAST(trunc(t / 1000.0::DOUBLE * 1000) AS BIGINT) AS p FROM base), kept AS (SELECT DISTINCT ep, 0::BIGINT AS k FROM base
  UNION ALL SELECT c.ep, (SELECT min(p) FROM pts x WHERE x.ep = c.ep AND x.p >= c.k + 500) FROM kept c WHERE c.k IS NOT NULL),
cutpts AS (SELECT ep, k AS "at" FROM kept WHERE k IS NOT NULL UNION ALL SELECT ep, max(t) + 5000 FROM base GROUP BY ep)"""


@query(w(BASE) + CUT_TIMES + 'SELECT ep, "at" FROM cutpts')
def scene_cut_scan(spark, d):
    """Cut logs, thinned, from the start to the episode's end."""
    rows = td.base(spark, d)
    lines = rows.select("ep", F.concat(F.lit("[Parsed_showinfo] n: 3 pts: 77 pts_time:"), (F.col("t") / 1000).cast("string"), F.lit(" fmt:yuv")).alias("line"))
    lines = lines.unionByName(rows.select("ep", F.lit("pts_time:-1.5").alias("line"))).unionByName(rows.select("ep", F.lit("no time").alias("line")))
    return subtitles.cut_points(lines, rows.groupBy("ep").agg((F.max("t") + 5000).alias("duration_ms")))


@query(
    w(BASE, CUES)
    + """, n AS (SELECT ep, count(*) FILTER (ep % 3 = 0 AND cue % 2 = 0) AS a, count(*) FILTER (ep % 3 < 2) AS b FROM cues GROUP BY ep), e AS (SELECT DISTINCT ep FROM base)
SELECT ep, CASE WHEN a > 0 THEN 'external' WHEN b > 0 THEN 'embedded' ELSE 'ocr' END AS tier, coalesce(CASE WHEN a > 0 THEN a ELSE b END, 0) AS subtitle_count, CASE WHEN a > 0 OR b > 0 THEN 'OK' ELSE 'NEEDS_OCR' END AS status FROM e LEFT JOIN n USING (ep)"""
)
def extraction_tiers(spark, d):
    rows = td.cues(spark, d)
    return artifacts.extraction(td.base(spark, d), {"external": rows.filter("ep % 3 = 0 and cue % 2 = 0"), "embedded": rows.filter("ep % 3 < 2")})


# listings ---------------------------------------------------------------------------------------------------

NAMES = ["ep{}.MKV", "ep{}.srt", "ep{}.zh.ass", "ep{}x.vtt", "old-ep{}.srt", "notes{}.txt", "剧本{}.md"]
LISTING = """
listing AS (SELECT DISTINCT user_id AS ep, replace(['ep{}.MKV', 'ep{}.srt', 'ep{}.zh.ass', 'ep{}x.vtt', 'old-ep{}.srt', 'notes{}.txt', '剧本{}.md'][event_id % 7 + 1], '{}', CAST(event_id // 7 % 3 AS VARCHAR)) AS name FROM events),
parsed AS (SELECT ep, name, regexp_replace(name, '[.][^.]*$', '') AS stem, lower(regexp_extract(name, '[.]([^.]*)$', 1)) AS ext FROM listing)"""


def listing(spark, d) -> DataFrame:
    """ep, name: what lies in an episode's folder."""
    name = F.replace(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 7 + 1).cast("int")), F.lit("{}"), (F.floor(F.col("event_id") / 7) % 3).cast("string"))
    return td.table(spark, d, "events").select(F.col("user_id").alias("ep"), name.alias("name")).distinct()


@query(w(LISTING) + "SELECT ep, CASE WHEN ext IN ('mp4', 'mkv', 'mov', 'webm', 'avi', 'ts') THEN 'video' WHEN ext IN ('srt', 'ass', 'ssa', 'vtt') THEN 'subtitle' ELSE 'other' END AS kind, count(*) AS files FROM parsed GROUP BY ALL")
def material_probe(spark, d):
    return artifacts.probed(listing(spark, d)).groupBy("ep", "kind").agg(F.count(F.lit(1)).alias("files"))


@query(w(LISTING) + "SELECT v.ep, v.name AS video, s.name AS subtitle FROM parsed v JOIN parsed s ON s.ep = v.ep AND v.ext = 'mkv' AND s.ext IN ('srt', 'ass', 'vtt') AND contains(s.name, v.stem)")
def material_matches(spark, d):
    return artifacts.matching_subtitles(listing(spark, d))


@query(
    w(LISTING)
    + """, f AS (SELECT v.ep, v.name AS video, s.name AS subtitle, CASE WHEN s.name LIKE 'old-%' THEN 0 ELSE 1 END AS o FROM parsed v JOIN parsed s ON s.ep = v.ep AND v.ext = 'mkv' AND s.ext IN ('srt', 'ass', 'vtt')
  AND (s.stem = v.stem OR starts_with(s.stem, v.stem || '.') OR s.name LIKE 'old-%'))
SELECT ep, video, subtitle, row_number() OVER (PARTITION BY ep, video ORDER BY o, subtitle) AS rank FROM f"""
)
def companion_files(spark, d):
    """Companions of each video; old files were chosen by hand."""
    files = listing(spark, d)
    return artifacts.companions(files, files.filter("name like 'old-%'").select("ep", F.col("name").alias("subtitle")))


@query(w(LISTING) + """SELECT ep, name FROM (SELECT ep, name, row_number() OVER (PARTITION BY ep ORDER BY name) AS r FROM listing WHERE name LIKE '%.md' AND contains(name, '剧本') AND NOT contains(name, '本1')) WHERE r <= 2""")
def exemplar_scan(spark, d):
    return artifacts.exemplars(listing(spark, d).withColumn("own", F.lit("本1")))


# JSON -------------------------------------------------------------------------------------------------------

DOCS = """
docs AS (SELECT event_id // 10 AS path, CASE event_id // 10 % 5 WHEN 0 THEN '{"items": [' WHEN 1 THEN ' [' WHEN 2 THEN '{"other": [' WHEN 3 THEN '{"items": [' ELSE '{"items": {"a": [' END
  || string_agg('{"index": ' || event_id || ', "text": "a, [b] ' || event_type || '"}', ', ' ORDER BY event_id) || CASE event_id // 10 % 5 WHEN 0 THEN ']}' WHEN 1 THEN ']' WHEN 2 THEN ']}' WHEN 3 THEN ']' ELSE ']}}' END AS text FROM events GROUP BY event_id // 10),
good AS (SELECT path, CASE WHEN json_valid(text) THEN CASE WHEN json_type(text) = 'ARRAY' THEN text::JSON WHEN json_type(text, '$.items') = 'ARRAY' THEN json_extract(text, '$.items') END END AS items, json_valid(text) AS valid FROM docs)"""


@query(w(DOCS) + """SELECT path, CASE WHEN NOT valid THEN 'unreadable' WHEN items IS NULL THEN 'no_rows' ELSE 'ok' END AS status, coalesce(json_array_length(items), 0)::BIGINT AS rows,
  CAST(list_sum(list_transform(from_json(items, '["JSON"]'), lambda x: CAST(x ->> '$.index' AS BIGINT))) AS BIGINT) AS total FROM good""")
def artifact_scan(spark, d):
    """Documents with their rows at the root, in a field, in neither, and broken ones."""
    path = F.floor(F.col("event_id") / 10).cast("long")
    row = F.format_string('{"index": %d, "text": "a, [b] %s"}', "event_id", "event_type")
    rows = joined(td.table(spark, d, "events").select(path.alias("path"), "event_id", row.alias("row")), ["path"], ["event_id"], "row", ", ")
    pick = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("path") % 5 + 1).cast("int"))
    files = rows.select("path", F.concat(pick('{"items": [', " [", '{"other": [', '{"items": [', '{"items": {"a": ['), "text", pick("]}", "]", "]}", "]", "]}}")).alias("text"))
    found = artifacts.artifact_rows(files, "items")
    index = F.transform("rows", lambda r: F.get_json_object(r, "$.index").cast("long"))
    return found.select("path", "status", F.size("rows").cast("long").alias("rows"), F.when(F.size("rows") > 0, F.aggregate(index, F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


@query(
    """WITH l AS (SELECT user_id AS id, event_id AS pos, CASE WHEN event_id % 50 = 49 THEN '[DONE]' WHEN event_id % 9 = 0 THEN '{broken' WHEN event_id % 4 < 3 THEN '{"choices":[{"delta":{"content":"' || event_type || ' "}' || CASE WHEN event_id % 20 = 1 THEN ',"finish_reason":"f' || event_id % 3 || '"' ELSE '' END || '}]}' END AS body FROM events),
e AS (SELECT id, min(pos) AS stop FROM l WHERE body = '[DONE]' GROUP BY id), v AS (SELECT l.id, pos, CASE WHEN json_valid(body) THEN body END AS body FROM l LEFT JOIN e USING (id) WHERE body IS NOT NULL AND (stop IS NULL OR pos < stop))
SELECT id, coalesce(string_agg(body ->> '$.choices[0].delta.content', '' ORDER BY pos), '') AS text, arg_max(body ->> '$.choices[0].finish_reason', pos) FILTER ((body ->> '$.choices[0].finish_reason') IS NOT NULL) AS finish FROM v GROUP BY id"""
)
def reply_streams(spark, d):
    """Event streams with broken and foreign lines, and an end."""
    delta = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), F.col("event_type"), F.lit(' "}'), F.when(F.col("event_id") % 20 == 1, F.format_string(',"finish_reason":"f%d"', F.col("event_id") % 3)).otherwise(""), F.lit("}]}"))
    line = F.when(F.col("event_id") % 50 == 49, "data: [DONE]").when(F.col("event_id") % 9 == 0, "data: {broken").when(F.col("event_id") % 4 < 3, delta).otherwise(": ping")
    return replies.folded(td.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), line.alias("line")))


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Sure!' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'It is [1, ' || event_id || ',] as asked.' WHEN 2 THEN 'cut {"a": [1, ' || event_id ELSE 'none ' || event_id END AS text FROM events),
f AS (SELECT event_id, regexp_replace(regexp_extract(text, '(?s)(\\{.*\\}|\\[.*\\])', 1), ',\\s*([}\\]])', '\\1', 'g') AS body FROM t)
SELECT event_id, CASE WHEN json_valid(body) THEN json(body)::VARCHAR END AS found FROM f"""
)
def json_in_prose(spark, d):
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Sure!\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.format_string("It is [1, %d,] as asked.", "event_id"))
        .when(F.col("event_id") % 4 == 2, F.format_string('cut {"a": [1, %d', "event_id")).otherwise(F.format_string("none %d", "event_id"))
    )
    return td.table(spark, d, "events").select("event_id", replies.json_in(text).alias("found"))


# diarized parts ---------------------------------------------------------------------------------------------

PARTS = """
seg AS (SELECT user_id AS ep, event_id % 3 AS part, event_id, '{"speaker": "' || CASE event_id % 7 WHEN 0 THEN ' ' ELSE 'Speaker ' || event_id % 2 END || '", "start": ' || CASE event_id % 7 WHEN 2 THEN '"soon"' WHEN 3 THEN '"' || event_id % 90 || '.5"' WHEN 4 THEN '-1' ELSE event_id % 90 || '.0625' END
  || ', "end": ' || CASE event_id % 7 WHEN 1 THEN '0' ELSE event_id % 90 + 2 || '' END || ', "gender": "' || ['Male', 'FEMALE ', 'robot'][event_id % 3 + 1] || '"}' AS s FROM events),
reply AS (SELECT ep, part, part * 100000 AS offset_ms, CASE WHEN part = 2 AND ep % 4 = 0 THEN '{"segments": []}' WHEN part = 1 AND ep % 5 = 1 THEN '{"note": 1}' WHEN part = 0 AND ep % 6 = 5 THEN NULL WHEN ep % 2 = 0 THEN '[' || string_agg(s, ', ' ORDER BY event_id) || ']' ELSE '{"segments": [' || string_agg(s, ', ' ORDER BY event_id) || ']}' END AS payload FROM seg GROUP BY ep, part),
each AS (SELECT ep, part, offset_ms, payload, CASE WHEN json_type(payload) = 'ARRAY' THEN from_json(payload, '["JSON"]') ELSE from_json(json_extract(payload, '$.segments'), '["JSON"]') END AS list FROM reply),
told AS (SELECT ep, part, offset_ms, pos, x ->> '$.speaker' AS raw_label, TRY_CAST(x ->> '$.start' AS DOUBLE) AS a, TRY_CAST(x ->> '$.end' AS DOUBLE) AS b, lower(trim(x ->> '$.gender')) AS g FROM (SELECT ep, part, offset_ms, unnest(list) AS x, generate_subscripts(list, 1) AS pos FROM each)),
usable AS (SELECT ep, part, pos, raw_label, CAST(round_even(a * 1000, 0) AS BIGINT) + offset_ms AS start_ms, CAST(round_even(b * 1000, 0) AS BIGINT) + offset_ms AS end_ms, CASE WHEN g IN ('male', 'female') THEN g ELSE 'unknown' END AS gender FROM told WHERE trim(raw_label) <> '' AND b > a AND a >= 0)"""


def reply_parts(spark, d) -> DataFrame:
    """ep, part, offset_ms, payload: replies in both shapes, with unusable segments, silent, invalid and missing ones."""
    e = F.col("event_id")
    start = F.when(e % 7 == 2, '"soon"').when(e % 7 == 3, F.format_string('"%d.5"', e % 90)).when(e % 7 == 4, "-1").otherwise(F.format_string("%d.0625", e % 90))
    segment = F.concat(
        F.lit('{"speaker": "'), F.when(e % 7 == 0, " ").otherwise(F.format_string("Speaker %d", e % 2)), F.lit('", "start": '), start, F.lit(', "end": '), F.when(e % 7 == 1, "0").otherwise((e % 90 + 2).cast("string")),
        F.lit(', "gender": "'), F.element_at(F.array(*map(F.lit, ["Male", "FEMALE ", "robot"])), (e % 3 + 1).cast("int")), F.lit('"}'),
    )
    rows = joined(td.table(spark, d, "events").select(F.col("user_id").alias("ep"), (e % 3).alias("part"), "event_id", segment.alias("s")), ["ep", "part"], ["event_id"], "s", ", ")
    ep, part = F.col("ep"), F.col("part")
    payload = (
        F.when((part == 2) & (ep % 4 == 0), '{"segments": []}').when((part == 1) & (ep % 5 == 1), '{"note": 1}').when((part == 0) & (ep % 6 == 5), None)
        .when(ep % 2 == 0, F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.concat(F.lit('{"segments": ['), "text", F.lit("]}")))
    )
    return rows.select("ep", "part", (part * 100_000).alias("offset_ms"), payload.alias("payload"))


@query(w(PARTS) + "SELECT ep, part, row_number() OVER (PARTITION BY ep ORDER BY start_ms, end_ms, raw_label, part, pos) AS turn, raw_label, start_ms, end_ms, gender FROM usable")
def part_turns(spark, d):
    return artifacts.part_turns(reply_parts(spark, d)).select("ep", "part", "turn", "raw_label", "start_ms", "end_ms", "gender")


@query(
    w(PARTS)
    + """, n AS (SELECT ep, part, count(*) AS kept FROM usable GROUP BY ALL)
SELECT ep, part, CASE WHEN payload IS NULL THEN 'missing' WHEN len(list) = 0 THEN 'silent' WHEN kept > 0 THEN 'ok' ELSE 'invalid' END AS state, coalesce(kept, 0) AS kept, coalesce(len(list), 0) - coalesce(kept, 0) AS dropped FROM each LEFT JOIN n USING (ep, part)"""
)
def part_status(spark, d):
    return artifacts.part_status(reply_parts(spark, d))


# configuration ----------------------------------------------------------------------------------------------

CONFIG = """
e AS (SELECT DISTINCT user_id AS ep FROM events),
doc AS (SELECT ep, CASE WHEN ep % 3 = 0 THEN '[{"start_ms": ' || ep * 10 || ', "end_ms": ' || ep * 10 + 90000 || '}, {"start_ms": 5, "end_ms": 1}, {"start_ms": "x", "end_ms": 9}]' WHEN ep % 3 = 1 THEN '{"other": 1}' END AS series,
  CASE WHEN ep % 2 = 0 THEN '{"op_ed_windows": [{"start_ms": 0, "end_ms": "60000"}, {"start_ms": 1000000, "end_ms": 1090000, "label": "预告"}, {"end_ms": 7}]}' END AS legacy FROM e),
lists AS (SELECT ep, CASE WHEN json_type(series) = 'ARRAY' THEN from_json(series, '["JSON"]') END AS own, CASE WHEN legacy IS NOT NULL THEN from_json(json_extract(legacy, '$.op_ed_windows'), '["JSON"]') END AS old FROM doc),
win AS (SELECT ep, CASE WHEN own IS NOT NULL THEN 'series' ELSE 'legacy' END AS origin, own IS NOT NULL AND coalesce(len(old), 0) > 0 AND list_sort(own::VARCHAR[]) <> list_sort(old::VARCHAR[]) AS differs, unnest(coalesce(own, old)) AS x FROM lists),
configured AS (SELECT ep, TRY_CAST(x ->> '$.start_ms' AS BIGINT) AS start_ms, TRY_CAST(x ->> '$.end_ms' AS BIGINT) AS end_ms, x ->> '$.label' AS l, origin, differs FROM win)"""


def configuration(spark, d) -> tuple[DataFrame, DataFrame]:
    eps = td.table(spark, d, "events").select(F.col("user_id").alias("ep")).distinct()
    ep = F.col("ep")
    series = F.when(ep % 3 == 0, F.format_string('[{"start_ms": %d, "end_ms": %d}, {"start_ms": 5, "end_ms": 1}, {"start_ms": "x", "end_ms": 9}]', ep * 10, ep * 10 + 90_000)).when(ep % 3 == 1, '{"other": 1}')
    legacy = F.when(ep % 2 == 0, '{"op_ed_windows": [{"start_ms": 0, "end_ms": "60000"}, {"start_ms": 1000000, "end_ms": 1090000, "label": "预告"}, {"end_ms": 7}]}')
    return eps.select("ep", series.alias("doc")), eps.select("ep", legacy.alias("doc"))


@query(w(CONFIG) + "SELECT ep, start_ms, end_ms, coalesce(l, CASE WHEN start_ms > 0 THEN 'ED' ELSE 'OP' END) AS label, origin, differs FROM configured WHERE end_ms > start_ms")
def window_config(spark, d):
    return artifacts.configured_windows(*configuration(spark, d))


@query(
    w(BASE, TURNS, CONFIG)
    + """, o AS (SELECT v.event_id, v.part, max(greatest(0, least(greatest(v.e, v.s + 1), c.end_ms) - greatest(v.s, c.start_ms)) / greatest(1, greatest(v.e, v.s + 1) - v.s)) AS r FROM voices v JOIN configured c ON c.ep = v.ep AND c.end_ms > c.start_ms GROUP BY ALL)
SELECT v.ep, v.cluster_id, count(*) FILTER (coalesce(r, 0) <= 0.5) AS kept, count(*) FILTER (r > 0.5) AS removed FROM voices v LEFT JOIN o USING (event_id, part) GROUP BY ALL"""
)
def turns_outside_windows(spark, d):
    """Turns of each cluster that lie in none of an episode's own windows."""
    from .catalogue import clustered

    found = windows.in_windows(clustered(spark, d), artifacts.configured_windows(*configuration(spark, d)))
    return found.groupBy("ep", "cluster_id").agg(F.count_if(F.col("label").isNull()).alias("kept"), F.count_if(F.col("label").isNotNull()).alias("removed"))


SCENE_SHOTS = """
wide AS (SELECT ep, pos // 5 + 1 AS scene, min(s) AS s, max(e) AS e FROM shots GROUP BY ALL),
held AS (SELECT ep, scene FROM wide WHERE (ep + scene) % 3 > 0)"""


def scene_table(spark, d, size: int = 5) -> DataFrame:
    from ..operators.align import scenes_of

    return scenes_of(td.shots(spark, d), size).select("ep", (F.col("pos") + 1).alias("scene"), "r_start_ms", "r_end_ms")


@query(w(BASE, shots(), SCENE_SHOTS) + "SELECT ep, count(*) AS scenes, count(h.scene) AS written, count(*) - count(h.scene) AS missing, coalesce(string_agg(CASE WHEN h.scene IS NULL THEN w.scene::VARCHAR END, ',' ORDER BY w.scene), '') AS absent FROM wide w LEFT JOIN held h USING (ep, scene) GROUP BY ep")
def draft_presence(spark, d):
    scenes = scene_table(spark, d)
    return artifacts.draft_status(scenes, scenes.filter("(ep + scene) % 3 > 0"))


# sinks ------------------------------------------------------------------------------------------------------


@query(
    w(BASE, shots(), CUES, SCENE_SHOTS.replace("pos // 5", "pos"))
    + """, n AS (SELECT w.ep, w.scene, w.s, w.e, CASE WHEN greatest(0, least(w.e, 105000) - greatest(w.s, 84000)) / greatest(1, w.e - w.s) > 0.5 THEN 'OP' WHEN greatest(0, least(w.e, 1440000) - greatest(w.s, 1320000)) / greatest(1, w.e - w.s) > 0.5 THEN 'ED' END AS label FROM wide w)
SELECT n.ep, n.scene, md5('## 场 ' || n.scene || '【' || label || '】' || chr(10) || chr(10) || '（动画 ' || label || '——按配置略）' || chr(10)) AS digest FROM n ANTI JOIN held h USING (ep, scene)
WHERE label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cues c WHERE c.ep = n.ep AND least(c.e, n.e) > greatest(c.s, n.s))"""
)
def stub_drafts(spark, d):
    """Drafts of scenes in the opening or the ending that nobody speaks in."""
    from ..operators.interval import interval_join

    scenes = scene_table(spark, d, 1)
    spoken = interval_join(td.cues(spark, d).select("ep", "start_ms", "end_ms"), scenes, ["ep"]).groupBy("ep", "scene").agg(F.count(F.lit(1)).alias("cues"))
    rows = scenes.join(spoken, ["ep", "scene"], "left").select("ep", "scene", windows.window_label(F.col("r_start_ms"), F.col("r_end_ms"), td.WINDOWS).alias("label"), F.coalesce("cues", F.lit(0)).alias("cues"))
    return sinks.stub_drafts(rows, scenes.filter("(ep + scene) % 3 > 0")).select("ep", "scene", F.md5("text").alias("digest"))


@query(
    w(BASE)
    + """, n AS (SELECT ep, max(t) * 5 AS n FROM base GROUP BY ep) SELECT ep, 0::BIGINT AS part, 'diarize' AS kind, 0::BIGINT AS start_ms, n AS end_ms, 'diarize_part_000.json' AS output FROM n WHERE n > 0 AND n <= 3000000
UNION ALL SELECT ep, part, 'diarize', start_ms, end_ms, format('diarize_part_{:03d}.json', part) FROM (SELECT ep, unnest(generate_series(0, cuts)) AS part, cuts, n, CASE WHEN part = 0 THEN 0 ELSE greatest(0, part * 2700000 - 3000) END AS start_ms, CASE WHEN part = cuts THEN n ELSE least(n, (part + 1) * 2700000 + 3000) END AS end_ms
  FROM (SELECT ep, n, (n - 1) // 2700000 - CASE WHEN n - ((n - 1) // 2700000) * 2700000 < 600000 THEN 1 ELSE 0 END AS cuts FROM n WHERE n > 3000000))"""
)
def work_orders(spark, d):
    """A task for each planned part of an episode's audio."""
    ends = td.base(spark, d).groupBy("ep").agg((F.max("t") * 5).alias("duration_ms"))
    return sinks.work_orders(windows.plan_chunks(ends), "diarize")


@query(w(BASE, CUES) + """SELECT ep, md5('{"ep":' || ep || ',"items":[' || string_agg('{"cue":' || cue || ',"start_ms":' || s || ',"speaker":"' || speaker || '"}', ',' ORDER BY cue) || ']}') AS digest FROM cues GROUP BY ep""")
def cue_documents(spark, d):
    """Each episode's cues as one JSON document."""
    rows = td.cues(spark, d).select("ep", "cue", "start_ms", "speaker")
    return sinks.documents(rows, ["ep"], ["cue"], "items").select("ep", F.md5("document").alias("digest"))


@query("SELECT conv_id AS ep, turn AS version, sha256(coalesce(text, '')) AS sha256, (conv_id + turn) % 4 = 0 AND turn % 2 = 1 AS changed FROM conversations")
def table_snapshots(spark, d):
    """Snapshots of texts, and whether the text is another now; those of even turns are drafts."""
    rows = td.lines(spark, d).select(F.struct("ep", "index").alias("ep"), F.col("index").alias("version"), F.coalesce("text", F.lit("")).alias("table"))
    taken = sinks.snapshots(rows)
    now = rows.select("ep", F.when(F.col("version") % 2 == 0, "draft").otherwise("final").alias("version"), F.when((F.col("ep.ep") + F.col("version")) % 4 == 0, F.concat("table", F.lit("+"))).otherwise(F.col("table")).alias("table"))
    return sinks.changed(taken, now).join(taken.select("ep", "sha256"), "ep").select("ep.ep", "version", "sha256", "changed")


@query(
    r"""WITH p AS (SELECT ['out/a.md', '../x/a.md', './b/../c', '/w/e1/../e10/q', '/w/e1/deep/x', '/w/e10', 'a/../../e1/z'][event_id % 7 + 1] AS path FROM events),
f AS (SELECT path, regexp_replace(CASE WHEN path LIKE '/%' THEN path ELSE '/w/e1/' || path END, '/\.(/|$)', '/') AS whole FROM p),
n AS (SELECT path, regexp_replace(regexp_replace(whole, '/[^/.]+/\.\.(/|$)', '/'), '/[^/.]+/\.\.(/|$)', '/') AS whole FROM f)
SELECT path, whole = '/w/e1' OR starts_with(whole, '/w/e1/') AS inside, count(*) AS n FROM n GROUP BY ALL"""
)
def contained_paths(spark, d):
    """Which output paths stay in the folder /w/e1."""
    paths = ["out/a.md", "../x/a.md", "./b/../c", "/w/e1/../e10/q", "/w/e1/deep/x", "/w/e10", "a/../../e1/z"]
    path = F.element_at(F.array(*map(F.lit, paths)), (F.col("event_id") % 7 + 1).cast("int"))
    rows = td.table(spark, d, "events").select(path.alias("path"))
    return rows.groupBy("path", sinks.contained(F.col("path"), F.lit("/w/e1")).alias("inside")).agg(F.count(F.lit(1)).alias("n"))

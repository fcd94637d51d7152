"""The screenplay as a document: headings, overview, labels, appendix, assembly, and whether it may be delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import classify, split_head, trace
from .splice import HEAD

# How headings, slug lines and summaries are written.
TITLED = r"(?m)^##\s*场\s*\d+\s*【\s*([^】]*?)\s*】\s*(?:（([^）]*)）)?\s*$"
HEADING = r"^##\s*(?:场\s*\d+\s*【[^】]*】(?:（[^）]*）)?|第\s*\d+\s*场)[^\n]*$"
SLUG = r"(?m)^\*\*([^*\n].*?)\*\*([^\n]*)$"
SUMMARY = r"(?m)^>\s*概要[：:][^\n]*\n?"
STAMP = r"\[TC[^\]]*\]"
SETTING = r"^(?:内景|外景|片头曲|片尾曲|片尾|黑场)\s*[··・]?\s*(.+?)(?:\s*——.*)?$"
EDGES = r"^[ ··—-]+|[ ··—-]+$"
RELATIONS = {"ON_SCREEN": "说话者在画面内", "OFF_SCREEN": "说话者在画框外（O.S.）", "VOICE_OVER": "非剧情空间声源（旁白/解说）", "INTERNAL_MONOLOGUE": "内心独白/字幕卡"}


def clock_of(timecode: Column) -> Column:
    """HH:MM:SS at the start of a timecode, with as many digits of hours as it has; empty if there is none."""
    return F.regexp_extract(F.trim(F.coalesce(timecode, F.lit(""))), r"^(\d+:\d{2}:\d{2})", 1)


def slug_line(text: Column) -> Column:
    """A scene's first bold line with its tail."""
    return F.trim(F.concat(F.regexp_extract(text, SLUG, 1), F.regexp_extract(text, SLUG, 2)))


def title_of(slug: Column) -> Column:
    """The place that a slug line names."""
    plain = F.trim(F.replace(F.regexp_replace(slug, STAMP, ""), F.lit("`"), F.lit("")))
    after = F.regexp_extract(plain, r"^[^｜|]*[｜|](.*)$", 1)
    setting = F.regexp_extract(plain, SETTING, 1)
    place = F.when(plain.rlike(r"[｜|]"), after).when(plain.rlike(SETTING), setting).otherwise(F.element_at(F.split(plain, r"\s*——"), 1))
    return F.regexp_replace(place, EDGES, "")


def headed(drafts: DataFrame) -> DataFrame:
    """ep, scene, text with one heading ``## 场 N【title】（start - end）``.

    drafts: ep, scene, text, start_tc, end_tc (may be empty). The title is the draft's, else the slug line's place, else 未命名; times come
    from the table, or stay the draft's where it has none. Summaries go.
    """
    body = F.regexp_replace("text", SUMMARY, "")
    rows = drafts.withColumn("body", body)
    own, told = F.trim(F.regexp_extract("body", TITLED, 1)), F.trim(F.regexp_extract("body", TITLED, 2))
    title = F.coalesce(F.nullif(own, F.lit("")), F.nullif(title_of(slug_line(F.col("body"))), F.lit("")), F.lit("未命名"))
    times = F.when((F.col("start_tc") != "") & (F.col("end_tc") != ""), F.concat("start_tc", F.lit(" - "), "end_tc")).otherwise(told)
    head = F.concat(F.lit("## 场 "), F.col("scene").cast("string"), F.lit("【"), title, F.lit("】"), F.when(times != "", F.concat(F.lit("（"), times, F.lit("）"))).otherwise(""))
    rows = rows.withColumn("head", head)
    literal = F.regexp_replace("head", r"([\\$])", r"\\$1")
    first = F.regexp_replace("body", F.lit(r"(?ms)\A(.*?)" + HEADING), F.concat(F.lit("$1"), literal))
    text = F.when(F.col("body").rlike("(?m)" + HEADING), first).otherwise(F.concat("head", F.lit("\n"), F.regexp_replace("body", r"\A\n+", "")))
    return rows.select("ep", "scene", text.alias("text"))


def cell(value: Column) -> Column:
    """A value inside a Markdown table."""
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def safe_name(value: Column) -> Column:
    """A title as a file name."""
    return F.regexp_replace(value, r'[\\/*?:"<>|]', "_")


def overview(scenes: DataFrame) -> DataFrame:
    """ep, overview: a table with a line a scene (ep, scene, text, sequence)."""
    title, times = F.trim(F.regexp_extract("text", TITLED, 1)), F.trim(F.regexp_extract("text", TITLED, 2))
    times = F.when(times != "", times).otherwise(F.regexp_extract("text", STAMP, 0))
    slug = F.regexp_replace(slug_line(F.col("text")), r"\s*`\[TC[^\]]*\]`\s*$", "")
    line = F.concat(F.lit("| 第 "), F.col("scene").cast("string"), F.lit(" 场 | "), cell(F.col("sequence")), F.lit(" | "), cell(slug), F.lit(" | "), cell(title), F.lit(" | "), cell(times), F.lit(" |"))
    rows = scenes.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("scene", line.alias("line")))).alias("lines"))  # an episode's scenes are one document
    head = "| 场号 | 序列 | 时空 | 概要 | 时间码 |\n| :--- | :--- | :--- | :--- | :--- |\n"
    return rows.select("ep", F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("overview"))


# labels -----------------------------------------------------------------------------------------------------


def dialogue_heads(texts: DataFrame) -> DataFrame:
    """ep, scene, line, head: the lines that name a speaker; a scene's first bold line is its slug."""
    listed = texts.select("ep", "scene", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    slug = F.min(F.when(F.col("said").rlike(r"^\*\*([^*\n].*?)\*\*"), F.col("line"))).over(Window.partitionBy("ep", "scene"))
    return listed.withColumn("slug", slug).filter(F.col("said").rlike(HEAD) & ~F.col("line").eqNullSafe(F.col("slug"))).select("ep", "scene", "line", F.trim(F.regexp_extract("said", HEAD, 1)).alias("head"))


def label_audit(texts: DataFrame, allowed: DataFrame) -> DataFrame:
    """ep, part, bucket, first: each label that heads a line, once: descriptive by its shape, named if it traces to a name (ep, surface), else untraced."""
    known = allowed.groupBy("ep").agg(F.collect_set("surface").alias("known"))  # names of one episode
    order = F.struct("scene", "line", "n")
    parts = dialogue_heads(texts).select("ep", "scene", "line", F.posexplode(split_head(F.col("head"))).alias("n", "part"))
    each = parts.groupBy("ep", "part").agg(F.min(order).alias("first")).join(known, "ep", "left")
    names = F.coalesce("known", F.array().cast("array<string>"))
    bucket = F.when(classify(F.col("part")).isin("generic", "descriptive"), "descriptive").when(trace(F.col("part"), names).isNotNull(), "named").otherwise("untraced")
    return each.select("ep", "part", bucket.alias("bucket"), "first")


def label_composition(audit: DataFrame) -> DataFrame:
    """ep, named, descriptive, untraced: the distinct labels of each kind, in the order in which they come."""
    listed = lambda b: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("first", "part")))), lambda x: x["part"]), "、")
    return audit.groupBy("ep").agg(*[listed(b).alias(b) for b in ("named", "descriptive", "untraced")])


# the document -----------------------------------------------------------------------------------------------


def banner(enforced: Column, pending: Column) -> Column:
    """What a screenplay says of a cast that nobody signed off; empty if all was."""
    return F.when(~enforced, "演员表未经核验（本工作区未绑定已签核演员表）").when(pending > 0, F.concat(F.lit("演员表未经核验（"), pending.cast("string"), F.lit(" 个槽位为候选）"))).otherwise("")


def appendix(relations: DataFrame, counts: DataFrame) -> DataFrame:
    """ep, appendix: a table of how lines relate to the picture (ep, relation, n), most first, and how many of the lines are in.

    counts: ep, total, spliced, silent, named, descriptive, untraced.
    """
    told = F.lit("")
    for name, text in RELATIONS.items():
        told = F.when(F.col("relation") == name, text).otherwise(told)
    line = F.concat(F.lit("| "), "relation", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), told, F.lit(" |"))
    rows = relations.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "relation", line.alias("line")))).alias("lines"))
    rows = counts.join(rows, "ep", "left")
    table = F.concat(F.coalesce(F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")), F.lit("")), F.lit("| SILENT_ACTION（纯视听镜头） | "), F.col("silent").cast("string"), F.lit(" | 无对白的关键视听节拍 |"))
    share = F.lit(100.0) * F.col("spliced") / F.greatest(F.lit(1).cast("long"), F.col("total"))
    share = F.concat(F.call_function("format_number", share, F.lit("0.0")), F.lit("%"))  # halves to even; format_string rounds them up
    text = F.concat(
        F.lit("\n---\n\n## 附：本集声画关系统计\n\n| 关系类型 | 条数 | 说明 |\n| :--- | :--- | :--- |\n"), table,
        F.format_string("\n\n> **台词保真说明**：全片 %d 条字幕，本次拼装 %d/%d 条，覆盖率 ", "total", "spliced", "total"), share,
        F.format_string("；台词文本未经过任何改写。\n>\n> **说话人标签构成**：可溯源 %d 个、描述性（未定名）%d 个、表外专名 %d 个\n", "named", "descriptive", "untraced"),
    )
    return rows.select("ep", text.alias("appendix"))


def assembled(titles: DataFrame, views: DataFrame, scenes: DataFrame, ends: DataFrame) -> DataFrame:
    """ep, name, document: title and notice (ep, title, notice), overview, scenes (ep, scene, text) parted by rules, and appendix."""
    part = F.concat(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.lit("\n"))
    body = scenes.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("scene", part.alias("part")))).alias("parts"))
    rows = titles.join(views, "ep").join(body, "ep").join(ends, "ep")
    head = F.concat(F.lit("# 《"), "title", F.lit("》 场号制影视文学剧本\n\n"), F.when(F.col("notice") != "", F.concat(F.lit("> ⚠️ "), "notice", F.lit("\n\n"))).otherwise(""), F.lit("## 场次总表\n\n"), "overview", F.lit("\n\n---\n\n"))
    text = F.concat(head, F.array_join(F.transform("parts", lambda x: x["part"]), "\n---\n\n"), "appendix")
    return rows.select("ep", F.concat(safe_name(F.col("title")), F.lit("_影视文学剧本.md")).alias("name"), text.alias("document"))


def delivery(episodes: DataFrame, violations: DataFrame, untraced: DataFrame, misattributed: DataFrame, enforced: Column) -> DataFrame:
    """ep, code, deliver, warnings: 1 where placeholders are at fault (ep), 9 where a signed table is in force (a column of episodes) and a label (ep)
    is untraced or a line (ep) is given to another than the table says; else 0. Only 0 is delivered; without a table untraced labels warn."""
    count = lambda rows, name: rows.groupBy("ep").agg(F.count(F.lit(1)).alias(name))
    rows = episodes.join(count(violations, "faults"), "ep", "left").join(count(untraced, "loose"), "ep", "left").join(count(misattributed, "wrong"), "ep", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    code = F.when(n("faults") > 0, 1).when(enforced & (n("loose") + n("wrong") > 0), 9).otherwise(0)
    return rows.select("ep", code.alias("code"), (code == 0).alias("deliver"), F.when(~enforced, n("loose")).otherwise(0).cast("long").alias("warnings"))

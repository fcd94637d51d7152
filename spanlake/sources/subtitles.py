"""SRT, WebVTT and ASS files as cue tables; silence logs; scene-cut logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import speaker_prefix, strip_ass, strip_space, strip_tags
from ..functions.time import parse_timecode
from ..operators.windows import thin_cuts

# Style names and Name fields that are no characters.
STYLES = ["default", "title", "staff", "song", "ed", "op", "note", "top"]
NAMES = ["", "default", "normal", "*default"]


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of subtitle files, a row a file; a leading byte order mark is dropped."""
    rows = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^﻿", "")
    return rows.select("path", F.regexp_replace(F.coalesce(text, F.decode("content", "ISO-8859-1")), "\r\n?", "\n").alias("text"))


def numbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("path").orderBy("start_ms", "pos")
    return rows.withColumn("index", F.row_number().over(order)).select("path", "index", "start_ms", "end_ms", "text", "speaker")


def parse_srt(files: DataFrame, keep_named: bool = True) -> DataFrame:
    """path, index, start_ms, end_ms, text, speaker of SRT or WebVTT (path, text).

    Blocks are parted by blank lines; the time line is the first, or the second after a cue id. A cue id need not be
    a number (WebVTT allows any); keep_named=False drops such cues. Rows are in order of start, then of place.
    """
    blocks = files.select("path", F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("pos", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), strip_space), lambda x: x != "")
    rows = blocks.withColumn("lines", lines).filter(F.size("lines") >= 2)
    first = F.get("lines", F.lit(0))
    id_line = first.rlike(r"^\d+$") | (F.lit(keep_named) & ~first.contains("-->"))
    rows = rows.withColumn("at", F.when(id_line, 1).otherwise(0)).withColumn("time", F.get("lines", F.col("at"))).filter(F.col("time").contains("-->"))
    ends = F.split("time", "-->")
    stamp = lambda i: parse_timecode(F.split(strip_space(F.get(ends, F.lit(i))), r"\s+")[0])
    said = strip_space(strip_tags(F.array_join(F.slice("lines", F.col("at") + 2, F.size("lines")), " ")))
    rows = rows.select("path", "pos", stamp(0).alias("start_ms"), stamp(1).alias("end_ms"), said.alias("raw")).filter("raw <> ''").withColumn("split", speaker_prefix(F.col("raw")))
    text = F.when(F.col("split.text") == "", F.col("raw")).otherwise(F.col("split.text"))
    return numbered(rows.select("path", "pos", "start_ms", "end_ms", text.alias("text"), F.col("split.speaker").alias("speaker")))


def parse_ass(files: DataFrame) -> DataFrame:
    """The same of ASS/SSA: columns by the Format line of the events; speaker from the text, the Name, else a telling Style."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", strip_space(F.col("line")))
    upto = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("events", F.max((F.lower("line") == "[events]").cast("int")).over(upto))
    lines = lines.withColumn("format", F.last(F.when((F.col("events") == 1) & F.col("line").startswith("Format:"), F.col("line")), ignorenulls=True).over(upto))
    columns = F.transform(F.split(F.regexp_replace("format", "^Format:", ""), ","), lambda c: F.lower(strip_space(c)))
    rows = lines.filter((F.col("events") == 1) & F.col("line").startswith("Dialogue:")).withColumn("columns", columns)
    n = F.when(F.col("columns").isNull(), 10).otherwise(F.size("columns"))
    rows = rows.withColumn("n", n).withColumn("fields", F.split(F.regexp_replace("line", r"^Dialogue:\s*", ""), ",")).filter(F.size("fields") >= F.col("n"))
    fields = F.concat(F.slice("fields", 1, F.col("n") - 1), F.array(F.array_join(F.slice("fields", F.col("n"), F.size("fields")), ",")))
    rows = rows.withColumn("fields", fields)
    place = lambda name, default: F.coalesce(F.nullif(F.array_position("columns", F.lit(name)), F.lit(0)), F.lit(default))
    field = lambda name, default: strip_space(F.get("fields", (place(name, default) - 1).cast("int")))
    own = F.nullif(F.array_position("columns", F.lit("name")), F.lit(0))
    style = F.nullif(F.array_position("columns", F.lit("style")), F.lit(0))
    name = strip_space(F.get("fields", (own - 1).cast("int")))
    look = strip_space(F.get("fields", (style - 1).cast("int")))
    raw = strip_ass(F.coalesce(field("text", 10), F.element_at("fields", -1)))
    rows = rows.select("path", "pos", parse_timecode(field("start", 2)).alias("start_ms"), parse_timecode(field("end", 3)).alias("end_ms"), raw.alias("raw"), name.alias("name"), look.alias("look")).filter("raw <> ''").withColumn("split", speaker_prefix(F.col("raw")))
    telling = ~F.lower("look").isin(STYLES) & (F.col("look") != "") & (F.length("look") <= 15) & ~F.col("look").rlike(r"\d")
    speaker = F.coalesce(F.col("split.speaker"), F.when(~F.lower("name").isin(NAMES), F.col("name")), F.when(telling, F.col("look")))
    text = F.when(F.col("split.text") == "", F.col("raw")).otherwise(F.col("split.text"))
    return numbered(rows.select("path", "pos", "start_ms", "end_ms", text.alias("text"), speaker.alias("speaker")))


def parse_silences(lines: DataFrame) -> DataFrame:
    """ep, midpoint of (ep, pos, line): each silence_end paired with the silence_start before it; what has no partner is left out."""
    start = F.regexp_extract("line", r"silence_start:\s*(-?[\d.]+)", 1).try_cast("double")
    end = F.regexp_extract("line", r"silence_end:\s*(-?[\d.]+)", 1).try_cast("double")
    marks = lines.select("ep", "pos", start.alias("start"), end.alias("end")).filter("start is not null or end is not null")
    before = F.lag("start").over(Window.partitionBy("ep").orderBy("pos"))
    return marks.withColumn("before", before).filter("end is not null and before is not null").select("ep", "pos", ((F.col("before") + F.col("end")) / 2).alias("midpoint"))


def parse_cuts(lines: DataFrame) -> DataFrame:
    """ep, at (ms) of (ep, line): the pts_time of each line that has one, from 0 on."""
    seconds = F.regexp_extract("line", r"pts_time:\s*(-?[\d.]+)", 1).try_cast("double")
    return lines.select("ep", (seconds * 1000).cast("long").alias("at")).filter("at >= 0")


def cut_points(lines: DataFrame, ends: DataFrame, gap_ms: int = 500) -> DataFrame:
    """ep, at: 0, then each cut that lies ``gap_ms`` or more after the last one kept, then the end (ep, duration_ms) if it is later.

    An episode whose log has no cut still has its start and end.
    """
    first = ends.select("ep", F.lit(0).cast("long").alias("at"))
    kept = thin_cuts(parse_cuts(lines).unionByName(first), gap_ms)
    last = kept.groupBy("ep").agg(F.max("at").alias("last")).join(ends, "ep").filter("duration_ms > last")
    return kept.unionByName(last.select("ep", F.col("duration_ms").alias("at")))

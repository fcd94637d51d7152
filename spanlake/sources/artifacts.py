"""Files around an episode: artifacts in JSON, material listings, diarized parts, exclusion windows, drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import enum_value
from ..functions.time import half_even_ms

# File name endings.
VIDEOS = ["mp4", "mkv", "mov", "webm", "avi", "ts"]
SUBTITLES = ["srt", "ass", "ssa", "vtt"]


def json_list(text: Column, *fields: str) -> Column:
    """The rows of a document as an array of JSON texts: those of a list, or of the first of ``fields`` that an object has.

    Null if the text is no JSON, or has no such list.
    """
    root = F.when(F.try_parse_json(text).isNotNull(), F.ltrim(text))
    inner = F.coalesce(*[F.get_json_object(root, f"$.{f}") for f in fields])
    listed = F.when(root.startswith("["), root).otherwise(inner)
    return F.when(F.ltrim(listed).startswith("["), F.from_json(listed, "array<string>"))


def artifact_rows(files: DataFrame, field: str) -> DataFrame:
    """path, status, rows (JSON texts) of artifacts (path, text): a bad or missing one is told, and is no failure."""
    rows = json_list(F.col("text"), field)
    status = F.when(F.try_parse_json("text").isNull(), "unreadable").when(rows.isNull(), "no_rows").otherwise("ok")
    return files.select("path", status.alias("status"), F.coalesce(rows, F.array().cast("array<string>")).alias("rows"))


# material ---------------------------------------------------------------------------------------------------


def probed(files: DataFrame) -> DataFrame:
    """ep, name, stem, kind (video, subtitle, other) of a listing (ep, name)."""
    ending = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    kind = F.when(ending.isin(VIDEOS), "video").when(ending.isin(SUBTITLES), "subtitle").otherwise("other")
    return files.select("ep", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), kind.alias("kind"))


def matching_subtitles(files: DataFrame) -> DataFrame:
    """ep, video, subtitle: subtitle files whose name holds a video's stem. A folder lists a handful of files."""
    rows = probed(files)
    videos = rows.filter("kind = 'video'").select("ep", F.col("name").alias("video"), "stem")
    subtitles = rows.filter("kind = 'subtitle'").select("ep", F.col("name").alias("subtitle"))
    return videos.join(subtitles, "ep").filter(F.contains("subtitle", "stem")).select("ep", "video", "subtitle")


def companions(files: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """ep, video, subtitle, rank: companions of a video, named as it is or as it and a dot, by name; a file chosen by
    hand (ep, subtitle) comes first."""
    rows = probed(files)
    videos = rows.filter("kind = 'video'").select("ep", F.col("name").alias("video"), F.col("stem").alias("own"))
    found = videos.join(rows.filter("kind = 'subtitle'").select("ep", F.col("name").alias("subtitle"), "stem"), "ep")
    found = found.filter((F.col("stem") == F.col("own")) | F.col("stem").startswith(F.concat("own", F.lit(".")))).select("ep", "video", "subtitle", F.lit(1).alias("order"))
    if chosen is not None:
        found = found.unionByName(videos.join(chosen, "ep").select("ep", "video", "subtitle", F.lit(0).alias("order")))
    found = found.groupBy("ep", "video", "subtitle").agg(F.min("order").alias("order"))
    rank = F.row_number().over(Window.partitionBy("ep", "video").orderBy("order", "subtitle"))
    return found.select("ep", "video", "subtitle", rank.cast("long").alias("rank"))


def extraction(episodes: DataFrame, tiers: dict[str, DataFrame]) -> DataFrame:
    """ep, tier, subtitle_count, status: of tables of cues (ep, ...) in order of preference the first that has any for an
    episode; NEEDS_OCR where none has."""
    counted = None
    for order, (name, rows) in enumerate(tiers.items()):
        one = rows.groupBy("ep").agg(F.count(F.lit(1)).alias("n")).select("ep", F.struct(F.lit(order).alias("order"), F.lit(name).alias("tier"), "n").alias("found"))
        counted = one if counted is None else counted.unionByName(one)
    best = counted.groupBy("ep").agg(F.min("found").alias("found"))
    rows = episodes.select("ep").distinct().join(best, "ep", "left")
    return rows.select("ep", F.coalesce("found.tier", F.lit("ocr")).alias("tier"), F.coalesce("found.n", F.lit(0)).cast("long").alias("subtitle_count"), F.when(F.col("found").isNull(), "NEEDS_OCR").otherwise("OK").alias("status"))


def exemplars(files: DataFrame, most: int = 2) -> DataFrame:
    """ep, name: of the notes (ep, own, name) that are screenplays of others the first ``most`` by name."""
    rows = files.filter(F.col("name").endswith(".md") & F.col("name").contains("剧本") & ~F.contains("name", "own"))
    at = F.row_number().over(Window.partitionBy("ep").orderBy("name"))
    return rows.withColumn("_n", at).filter(F.col("_n") <= most).select("ep", "name")


# diarized parts ---------------------------------------------------------------------------------------------


def part_segments(parts: DataFrame) -> DataFrame:
    """Segments of replies (ep, part, offset_ms, payload), a row each with ``ok``: a speaker, a start from 0 on, a later end."""
    listed = F.posexplode_outer(json_list(F.col("payload"), "segments", "results"))
    rows = parts.select("ep", "part", "offset_ms", "payload", listed.alias("pos", "segment"))
    text = lambda name: F.get_json_object("segment", f"$.{name}")
    start, end = text("start").try_cast("double"), text("end").try_cast("double")
    ok = (F.length(F.trim(text("speaker"))) > 0) & (end > start) & (start >= 0)
    return rows.select(
        "ep", "part", "payload", "pos", F.coalesce(ok, F.lit(False)).alias("ok"), text("speaker").alias("raw_label"),
        (half_even_ms(start) + F.col("offset_ms")).alias("start_ms"), (half_even_ms(end) + F.col("offset_ms")).alias("end_ms"), F.coalesce(text("text"), F.lit("")).alias("text"),
        *[enum_value(F.coalesce(text(f), F.lit("")), f).alias(f) for f in ("gender", "age_band", "timbre")],
    )


def part_turns(parts: DataFrame) -> DataFrame:
    """Usable turns of all parts in episode time, numbered in order of time and label."""
    order = Window.partitionBy("ep").orderBy("start_ms", "end_ms", "raw_label", "part", "pos")
    return part_segments(parts).filter("ok").withColumn("turn", F.row_number().over(order).cast("long")).drop("payload", "ok", "pos")


def part_status(parts: DataFrame) -> DataFrame:
    """ep, part, state, kept, dropped: missing, invalid, silent (an explicit empty list) or ok."""
    rows = part_segments(parts).groupBy("ep", "part").agg(F.first("payload").alias("payload"), F.count_if("ok").alias("kept"), F.count_if(F.col("pos").isNotNull() & ~F.col("ok")).alias("dropped"))
    listed = json_list(F.col("payload"), "segments", "results")
    state = F.when(F.col("payload").isNull(), "missing").when(F.size(listed) == 0, "silent").when(F.col("kept") > 0, "ok").otherwise("invalid")
    return rows.select("ep", "part", state.alias("state"), "kept", "dropped")


# exclusion windows ------------------------------------------------------------------------------------------


def configured_windows(series: DataFrame, legacy: DataFrame) -> DataFrame:
    """ep, start_ms, end_ms, label, origin, differs: usable windows of an episode.

    Both tables are (ep, doc): a JSON list of windows, or an object that holds one. The series' list wins where there is
    one; ``differs`` tells that the older place has another. Windows without whole numbers, or that end before they start, are
    left out; one without a label is an opening if it starts at 0, else an ending.
    """
    listed = json_list(F.col("doc"), "op_ed_windows")
    whole = lambda w, name: F.get_json_object(w, f"$.{name}").try_cast("long")
    as_rows = lambda rows: F.transform(rows, lambda w: F.struct(whole(w, "start_ms").alias("start_ms"), whole(w, "end_ms").alias("end_ms"), F.get_json_object(w, "$.label").alias("label")))
    one = series.select("ep", as_rows(listed).alias("own"))
    other = legacy.select("ep", as_rows(listed).alias("old"))
    both = one.join(other, "ep", "full")
    differs = F.col("own").isNotNull() & (F.size("old") > 0) & (F.sort_array("own") != F.sort_array("old"))
    rows = both.select("ep", F.coalesce("own", "old").alias("windows"), F.when(F.col("own").isNotNull(), "series").otherwise("legacy").alias("origin"), F.coalesce(differs, F.lit(False)).alias("differs"))
    rows = rows.select("ep", "origin", "differs", F.explode("windows").alias("w")).filter("w.end_ms > w.start_ms")
    label = F.coalesce(F.nullif(F.col("w.label"), F.lit("")), F.when(F.col("w.start_ms") > 0, "ED").otherwise("OP"))
    return rows.select("ep", "w.start_ms", "w.end_ms", label.alias("label"), "origin", "differs")


# drafts -----------------------------------------------------------------------------------------------------


def draft_status(scenes: DataFrame, drafts: DataFrame) -> DataFrame:
    """ep, scenes, written, missing, absent: scenes (ep, scene) with and without a draft, and the numbers of the latter."""
    marked = scenes.select("ep", "scene").distinct().join(drafts.select("ep", "scene", F.lit(True).alias("there")).distinct(), ["ep", "scene"], "left")
    gone = F.col("there").isNull()
    return marked.groupBy("ep").agg(
        F.count(F.lit(1)).alias("scenes"), F.count_if(~gone).alias("written"), F.count_if(gone).alias("missing"),
        F.array_join(F.sort_array(F.collect_list(F.when(gone, F.col("scene")))).cast("array<string>"), ",").alias("absent"),
    )

"""Observation notes of drifting shape: entries by channel, what was dropped, and repeats across segments."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_form
from ..functions.time import flexible_seconds, half_even_ms

# Spellings of a field that notes use, most usual first.
START, END = ["start", "start_time", "start_sec", "from"], ["end", "end_time", "end_sec", "to"]
WHO = ["who", "epithet", "character", "person"]
WHAT = {
    "actions": ["what", "description", "action", "content"], "camera": ["movement", "camera", "shot"],
    "acoustic_events": ["what", "event", "sound", "description"], "visible_text": ["text", "content"],
}
NO_ALIAS = {"visible_text": ["from", "to"]}  # there they are words of the text's own
STATE, MOTION = ["mouth_state", "mouth", "mouthState"], ["mouth_motion", "motion", "mouthMotion"]
STATES, MOTIONS = ["moving", "still", "not_visible"], ["speaking", "chewing", "yawning", "other", "not_applicable"]
SHAPE = "struct<visual:struct<caption:string,actions:array<string>,camera:array<string>>,visible_text:array<string>,acoustic:struct<events:array<string>,music_mood:string>,uncertain:array<string>>"


def _first(entry: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at(entry, F.lit(n)) for n in names])


def entries(notes: DataFrame) -> DataFrame:
    """A row an entry of (ep, segment, start_ms, end_ms, raw): channel, absolute start and end, who, what, mouth fields, ok.

    raw is a JSON text. An entry that is no object, has no text, or whose times cannot be read or leave the segment, is not
    ok; it is kept as a row so that it can be counted, and never moved into range.
    """
    parsed = notes.withColumn("note", F.from_json("raw", SHAPE))
    listed = {"actions": "note.visual.actions", "camera": "note.visual.camera", "acoustic_events": "note.acoustic.events", "visible_text": "note.visible_text"}
    tagged = lambda c: lambda e: F.struct(F.lit(c).alias("channel"), e.alias("entry"))
    every = F.flatten(F.array(*[F.transform(F.coalesce(F.col(path), F.array().cast("array<string>")), tagged(c)) for c, path in listed.items()]))
    rows = parsed.select("ep", "segment", "start_ms", "end_ms", F.posexplode(every).alias("pos", "x")).select("ep", "segment", "start_ms", "end_ms", "pos", "x.channel", F.from_json("x.entry", "map<string,string>").alias("e"))
    span = F.greatest(F.lit(0.001), (F.col("end_ms") - F.col("start_ms")) / 1000.0)
    e = F.col("e")
    plain = F.col("channel").isin(*NO_ALIAS)
    stamp = lambda names: F.when(plain, _first(e, [n for n in names if n not in NO_ALIAS["visible_text"]])).otherwise(_first(e, names))
    start = flexible_seconds(stamp(START), span)
    end = F.when(stamp(END).isNull(), start).otherwise(flexible_seconds(stamp(END), span))
    what = F.coalesce(*[F.when(F.col("channel") == c, _first(e, names)) for c, names in WHAT.items()])
    ok = F.coalesce(start.isNotNull() & end.isNotNull() & (end >= start) & what.isNotNull(), F.lit(False))
    acting = F.col("channel") == "actions"
    closed = lambda names, legal: F.when(acting, F.when(F.lower(F.trim(_first(e, names))).isin(legal), F.lower(F.trim(_first(e, names)))).otherwise("unknown"))
    return rows.select(
        "ep", "segment", "pos", "channel", ok.alias("ok"), (F.col("start_ms") + half_even_ms(start)).alias("start"), (F.col("start_ms") + half_even_ms(end)).alias("end"),
        F.when(acting, _first(e, WHO)).alias("who"), what.alias("what"), closed(STATE, STATES).alias("mouth_state"), closed(MOTION, MOTIONS).alias("mouth_motion"),
    )


def dropped(rows: DataFrame) -> DataFrame:
    """ep, segment, channel, dropped: entries that were not ok."""
    return rows.groupBy("ep", "segment", "channel").agg(F.count_if(~F.col("ok")).alias("dropped"))


def payload(note: Column) -> Column:
    """The observation in a saved note: what it holds under raw, or the note itself if it is one; null if it holds none."""
    raw = F.get_json_object(note, "$.raw")
    bare = F.when(F.get_json_object(note, "$.visual").isNotNull(), note)
    return F.when(F.ltrim(raw).startswith("{"), raw).otherwise(bare)


def note_status(notes: DataFrame) -> DataFrame:
    """ep, segment, code, tokens of saved notes (ep, segment, note): 7 where one is missing, no JSON or holds no observation, else 0."""
    usable = F.try_parse_json("note").isNotNull() & payload(F.col("note")).isNotNull()
    tokens = F.coalesce(F.get_json_object("note", "$.meta.usage.total_tokens").try_cast("long"), F.lit(0).cast("long"))
    return notes.select("ep", "segment", F.when(F.coalesce(usable, F.lit(False)), 0).otherwise(7).alias("code"), tokens.alias("tokens"))


def parsed_substance(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """ep, segment, substance: whether any entry (of entries()) could be used, or the note has a caption, a mood or a doubt."""
    note = F.from_json("raw", SHAPE)
    some = lambda path: F.coalesce(F.length(F.trim(F.col(path))) > 0, F.lit(False))
    used = rows.filter("ok").select("ep", "segment").distinct().withColumn("used", F.lit(True))
    told = notes.withColumn("note", note).join(used, ["ep", "segment"], "left")
    has = F.col("used").isNotNull() | some("note.visual.caption") | some("note.acoustic.music_mood") | F.coalesce(F.size(F.col("note.uncertain")) > 0, F.lit(False))
    return told.select("ep", "segment", has.alias("substance"))


def has_substance(notes: DataFrame) -> DataFrame:
    """ep, segment, substance: whether a note as it came holds anything, told by its shape alone: a text that is not blank, or a list with
    such a thing in it."""
    note = F.from_json("raw", SHAPE)
    some = lambda path: F.coalesce(F.length(F.trim(F.col(path))) > 0, F.lit(False))
    blank = r'^\s*(""|" *"|null|false|0|\[\]|\{\})?\s*$'
    any_of = lambda path: F.coalesce(F.exists(F.col(path), lambda x: x.isNotNull() & ~x.rlike(blank)), F.lit(False))
    rows = notes.withColumn("note", note)
    has = some("note.visual.caption") | some("note.acoustic.music_mood") | any_of("note.visual.actions") | any_of("note.visual.camera") | any_of("note.visible_text") | any_of("note.acoustic.events") | any_of("note.uncertain")
    return rows.select("ep", "segment", has.alias("substance"))


def deduplicate(rows: DataFrame, least: float = 0.86, gap_ms: int = 1500) -> DataFrame:
    """Rows (ep, scene, segment, pos, start, end, who, what) without those that repeat an earlier one of their scene.

    A repeat says nearly the same and overlaps the one kept, or begins within 1.5 s of it; it then lengthens the time that
    the kept one is matched by. That depends on order, so a scene is folded as a group.
    """
    marked = rows.withColumn("sig", normal_form(F.concat_ws(" ", F.coalesce("who", F.lit("")), F.coalesce("what", F.lit("")))))

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        kept, pool = [], []
        for i, (sig, start, end) in enumerate(own.sort_values(["segment", "pos"])[["sig", "start", "end"]].itertuples(index=False)):
            same = next((p for p in pool if sig and p[0] and SequenceMatcher(None, sig, p[0]).ratio() >= least and (min(end, p[2]) > max(start, p[1]) or abs(start - p[1]) <= gap_ms)), None)
            if same:
                same[2] = max(same[2], end)
            else:
                kept.append(i)
                pool.append([sig, start, end])
        return own.sort_values(["segment", "pos"]).iloc[kept].drop(columns="sig")

    return marked.groupBy("ep", "scene").applyInPandas(fold, rows.schema)

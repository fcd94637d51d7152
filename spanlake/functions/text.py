"""Subtitle text: tags, speaker prefixes, normal forms, enums, relationships."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sound cues that are no speakers, narrator words, closed attribute sets, punctuation of the normal form.
SOUND_CUES = ["叹气", "哭声", "笑声", "掌声", "音乐", "枪声", "爆炸", "脚步声", "深呼吸", "sigh", "laughter", "music"]
NARRATORS = ["旁白", "解说", "画外音", "Narrator", "Voiceover"]
ATTRIBUTES = {
    "gender": ["male", "female"],
    "age_band": ["child", "teen", "young_adult", "adult", "elderly"],
    "timbre": ["bright", "sharp", "deep", "low", "hoarse", "soft", "nasal", "robotic"],
}
PUNCTUATION = r"(?U)[\s，。：:；;！!？?、,.\[\]【】()（）「」『』…—·\-–]"
VOICE_OVER = ["下一集", "次回", "前情提要", "解说"]


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def strip_ass(text: Column) -> Column:
    """Override blocks removed; escaped breaks and hard spaces become spaces."""
    return strip_space(F.regexp_replace(F.regexp_replace(text, r"\{[^\}]*\}", ""), r"\\[NnhH]", " "))


def normal_form(text: Column) -> Column:
    """White space and listed punctuation removed, lower-cased."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION, ""))


def speaker_prefix(raw: Column) -> Column:
    """struct(speaker, text): a bracketed or colon-led name split off the front of a line, else null and the line."""
    text = strip_space(F.coalesce(raw, F.lit("")))
    bracket = r"(?U)^[【\[（\(]([^】\]）\)]+)[】\]）\)]\s*(.*)$"
    colon = r"(?U)^([^：:\s\d\(\)\[\]【】]{1,16})\s*[：:]\s*(.+)$"
    name, rest = strip_space(F.regexp_extract(text, bracket, 1)), strip_space(F.regexp_extract(text, bracket, 2))
    named = text.rlike(bracket) & ~F.lower(name).isin(SOUND_CUES) & (F.length(name) <= 20) & ((rest != "") | name.isin(NARRATORS))
    lead, said = strip_space(F.regexp_extract(text, colon, 1)), strip_space(F.regexp_extract(text, colon, 2))
    led = text.rlike(colon) & ~lead.rlike(r"(?i)^(http|https|ftp|\d+)$")
    speaker = F.when(named, name).when(led, lead)
    return F.struct(speaker.alias("speaker"), F.when(named, rest).when(led, said).otherwise(text).alias("text"))


def enum_value(value: Column, field: str) -> Column:
    """A drifting value brought into its closed set; whatever is outside it is unknown."""
    tidy = F.translate(F.lower(F.trim(value)), " -", "__")
    return F.when(tidy.isin(ATTRIBUTES[field]), tidy).otherwise(F.lit("unknown"))


def compatible(a: Column, b: Column) -> Column:
    """Equality of two attributes; null where either is unknown."""
    return F.when((a == "unknown") | (b == "unknown"), F.lit(None).cast("boolean")).otherwise(a == b)


def provisional(label: Column) -> Column:
    token = strip_space(F.coalesce(label, F.lit("")))
    return (token == "") | token.isin("UNKNOWN", "SPEAKER_UNKNOWN") | token.rlike(r"^SPEAKER_[A-Z0-9]+$")


def av_relationship(text: Column, overlap: Column, duration: Column) -> Column:
    inner = text.rlike(r"(?s)^[（(].*[）)]$")
    told = F.lit(False)
    for w in VOICE_OVER:
        told = told | text.contains(w)
    return F.when(inner, "INTERNAL_MONOLOGUE").when(told, "VOICE_OVER").when((duration > 0) & (overlap / duration < 0.6), "OFF_SCREEN").otherwise("ON_SCREEN")


def histogram_distance(a: Column, b: Column) -> Column:
    """One minus the intersection of two normalised histograms, within 0..1."""
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda x, y: x + y)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - shared))


def likeness(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio; null where either text is empty. No built-in function computes it."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio(a, b)


def text_agreement(a: Column, b: Column, least: float = 0.60) -> Column:
    return likeness(normal_form(a), normal_form(b)) >= least

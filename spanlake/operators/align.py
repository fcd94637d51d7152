"""Cues to shots and speakers, and summaries of aligned shots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import av_relationship
from .interval import best_overlap, interval_join, nearest

MIN_OVERLAP_MS = 100


def assign_cues(cues: DataFrame, shots: DataFrame) -> DataFrame:
    """Each cue to exactly one shot: that of most overlap over 100 ms, else the nearest, whose overlap counts as 0."""
    hit = best_overlap(cues, shots, MIN_OVERLAP_MS)
    left = cues.join(hit.select("ep", "cue"), ["ep", "cue"], "left_anti")
    near = nearest(left, shots).select("ep", "cue", "pos", F.lit(0).cast("long").alias("overlap"), F.lit(True).alias("fallback"))
    return hit.withColumn("fallback", F.lit(False)).unionByName(near)


def cues_per_scene(cues: DataFrame, scenes: DataFrame) -> DataFrame:
    """ep, pos, cue_count for every scene; a cue counts in the scene of most overlap, and in none if it has no overlap."""
    counted = best_overlap(cues, scenes, 0).groupBy("ep", "pos").agg(F.count(F.lit(1)).alias("n"))
    return scenes.join(counted, ["ep", "pos"], "left").select("ep", "pos", F.coalesce("n", F.lit(0)).cast("long").alias("cue_count"))


def aligned(cues: DataFrame, shots: DataFrame) -> DataFrame:
    """ep, cue, pos, overlap, fallback, speaker, text and the cue's relationship to its shot."""
    rows = assign_cues(cues, shots).join(cues, ["ep", "cue"])
    return rows.withColumn("relation", av_relationship(F.col("text"), F.col("overlap"), F.col("end_ms") - F.col("start_ms")))


def shot_summary(rows: DataFrame, shots: DataFrame) -> DataFrame:
    """Per shot: cues, spoken and silent time, speakers (unknown counts as one) and mode."""
    who = F.coalesce("speaker", F.lit("SPEAKER_UNKNOWN"))
    sums = rows.groupBy("ep", "pos").agg(F.count(F.lit(1)).alias("cues"), F.sum("overlap").alias("spoken_ms"), F.countDistinct(who).alias("speakers"), F.max((F.col("relation") == "OFF_SCREEN").cast("int")).alias("off"))
    all_shots = shots.join(sums, ["ep", "pos"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    mode = F.when(zero("cues") == 0, "SILENCE").when(zero("speakers") == 1, "MONOLOGUE").otherwise("EXCHANGE")
    silent = F.greatest(F.lit(0).cast("long"), F.col("r_end_ms") - F.col("r_start_ms") - zero("spoken_ms"))
    return all_shots.select("ep", "pos", zero("cues").alias("dialogue_count"), zero("spoken_ms").alias("spoken_ms"), silent.alias("silent_ms"), zero("speakers").alias("speakers"), mode.alias("mode"), (zero("off") == 1).alias("has_offscreen"))


def lookup_speakers(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """ep, cue, speaker: a cue's own speaker, else that of the segment of most overlap over 100 ms (first on ties), else unknown.

    segments: ep, pos, r_start_ms, r_end_ms, seg_speaker.
    """
    blank = F.col("speaker").isNull() | F.col("speaker").isin("", "SPEAKER_UNKNOWN")
    found = best_overlap(cues.filter(blank), segments, MIN_OVERLAP_MS).join(segments.select("ep", "pos", "seg_speaker"), ["ep", "pos"]).select("ep", "cue", "seg_speaker")
    rows = cues.join(found, ["ep", "cue"], "left")
    return rows.select("ep", "cue", F.when(~blank, F.col("speaker")).otherwise(F.coalesce("seg_speaker", F.lit("SPEAKER_UNKNOWN"))).alias("speaker"))


def scenes_of(shots: DataFrame, size: int) -> DataFrame:
    """Coarse scenes of ``size`` shots in a row."""
    scene = F.floor(F.col("pos") / size).cast("long")
    return shots.groupBy("ep", scene.alias("pos")).agg(F.min("r_start_ms").alias("r_start_ms"), F.max("r_end_ms").alias("r_end_ms"), F.count(F.lit(1)).alias("shots"))


def straddled(cues: DataFrame, cuts: DataFrame, slack: int = 200) -> DataFrame:
    """(ep, boundary) of the cuts (ep, boundary, cut_ms) that a cue speaks across by more than ``slack`` ms on both sides."""
    points = cuts.select("ep", "boundary", F.col("cut_ms").alias("r_start_ms"), (F.col("cut_ms") + 1).alias("r_end_ms"))
    inner = cues.select("ep", (F.col("start_ms") + slack + 1).alias("start_ms"), (F.col("end_ms") - slack).alias("end_ms")).filter("end_ms > start_ms")
    return interval_join(inner, points, ["ep"]).select("ep", "boundary").distinct()

"""Scenes put together from shots: solving inside narrative sequences, assembly, coverage by pictures, gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import histogram_distance, normal_form
from .interval import best_overlap, interval_join
from .segment import MAX_SCENES, partition, solved_rows


def sequence_parts(walls: DataFrame, shots: DataFrame) -> DataFrame:
    """ep, pos, seq: the sequence that each shot lies in, of snapped walls (ep, wall, boundary).

    Where a wall was pushed to or beyond the last shot the outline does not fit the cuts, and the episode is one sequence, 0.
    """
    last = shots.groupBy("ep").agg(F.max("pos").alias("last"))
    fit = walls.groupBy("ep").agg(F.max("boundary").alias("top"), F.sort_array(F.collect_list("boundary")).alias("walls")).join(last, "ep").filter("top < last")  # an outline's few walls
    rows = shots.join(fit.select("ep", "walls"), "ep", "left")
    seq = F.when(F.col("walls").isNull(), 0).otherwise(F.size(F.filter("walls", lambda b: b < F.col("pos"))) + 1)
    return rows.select("ep", "pos", seq.cast("long").alias("seq"))


def solve_sequences(shots: DataFrame, scores: DataFrame, forbidden: DataFrame, parts: DataFrame, most: int = MAX_SCENES) -> DataFrame:
    """ep, seq, scene, first_pos, last_pos, forced: the best scenes of every sequence by itself.

    The budget of scenes is dealt to sequences by their span against the length of all shots, halves to even, one at least.
    """
    whole = shots.groupBy("ep").agg(F.sum(F.col("r_end_ms") - F.col("r_start_ms")).alias("whole"))
    rows = solved_rows(shots, scores, forbidden).join(parts, ["ep", "pos"]).join(shots.select("ep", "pos", "r_start_ms", "r_end_ms"), ["ep", "pos"]).join(whole, "ep")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        span = max(1, int(own["r_end_ms"].iloc[-1] - own["r_start_ms"].iloc[0]))
        cap = max(1, int(np.rint(most * span / max(1, int(own["whole"].iloc[0])))))
        ends = partition(own["s"].to_numpy(), own["score"].to_numpy(), own["forbidden"].to_numpy(), 1, min(len(own), cap))
        pos, bad = own["pos"].to_numpy(), own["forbidden"].to_numpy() > 0
        starts = [0, *[e + 1 for e in ends[:-1]]]
        return pd.DataFrame({"ep": own["ep"].iloc[0], "seq": own["seq"].iloc[0], "first_pos": pos[starts], "last_pos": pos[ends], "forced": [bool(bad[e]) and e != ends[-1] for e in ends], "cap": cap})

    found = rows.groupBy("ep", "seq").applyInPandas(run, "ep long, seq long, first_pos long, last_pos long, forced boolean, cap int")
    return found.withColumn("scene", F.row_number().over(Window.partitionBy("ep").orderBy("first_pos")).cast("long"))


def sequence_summary(scenes: DataFrame) -> DataFrame:
    """ep, seq, scene_count, first_pos, last_pos."""
    return scenes.groupBy("ep", "seq").agg(F.count(F.lit(1)).alias("scene_count"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"))


def assemble(scenes: DataFrame, shots: DataFrame, cues: DataFrame, places: DataFrame) -> DataFrame:
    """A row a scene (ep, scene, first_pos, last_pos): name, times, child shots, the shot that stands for it, its cues, and a slug line
    with the first place (ep, ord, place) that its lines name. A cue counts in the scene that it shares most time with."""
    held = shots.join(scenes, "ep").filter(F.col("pos").between(F.col("first_pos"), F.col("last_pos")))
    rows = held.groupBy("ep", "scene").agg(
        F.min("r_start_ms").alias("start_ms"), F.max("r_end_ms").alias("end_ms"), F.count(F.lit(1)).alias("shots"), F.sort_array(F.collect_list("pos")).alias("children")
    )  # a scene's own shots
    spans = rows.select("ep", F.col("scene").alias("pos"), F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    said = best_overlap(cues, spans, 0).join(cues.select("ep", "cue", "text"), ["ep", "cue"])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", "text"))), lambda x: x["text"]), " ")
    said = said.groupBy("ep", F.col("pos").alias("scene")).agg(F.count(F.lit(1)).alias("cues"), lines.alias("lines"))
    rows = rows.join(said, ["ep", "scene"], "left")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "place"))), lambda x: x["place"])
    rows = rows.join(places.filter("place <> ''").groupBy("ep").agg(listed.alias("places")), "ep", "left")
    named = F.get(F.filter("places", lambda p: F.contains(F.coalesce("lines", F.lit("")), p)), F.lit(0))
    number = F.format_string("%02d", F.col("scene").cast("int"))
    return rows.select(
        "ep", "scene", F.concat(F.lit("SCENE_"), number).alias("scene_id"), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "shots",
        F.element_at("children", (F.floor(F.col("shots") / 2) + 1).cast("int")).alias("keyframe_pos"), F.array_join(F.col("children").cast("array<string>"), ",").alias("children"),
        F.coalesce("cues", F.lit(0)).cast("long").alias("cues"), F.concat(F.when(named.isNull(), "").otherwise(F.concat(F.lit("INT/EXT. "), named, F.lit(" - "))), F.lit("SCENE "), number).alias("slugline"),
    )


# pictures ---------------------------------------------------------------------------------------------------


def visual_changes(cuts: DataFrame, frames: DataFrame) -> DataFrame:
    """cuts with ``measured`` and ``visual``: how unlike the colours (ep, pos, histogram) on either side are; 0, and not measured, where a
    picture is missing."""
    at = lambda shift, name: frames.select("ep", (F.col("pos") - shift).alias("boundary"), F.col("histogram").alias(name))
    rows = cuts.join(at(0, "_a"), ["ep", "boundary"], "left").join(at(1, "_b"), ["ep", "boundary"], "left")
    measured = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return rows.withColumn("measured", measured).withColumn("visual", F.when(measured, histogram_distance(F.col("_a"), F.col("_b"))).otherwise(0.0)).drop("_a", "_b")


def visual_coverage(cuts: DataFrame) -> DataFrame:
    """ep, measured, total boundaries."""
    return cuts.groupBy("ep").agg(F.count_if("measured").alias("measured"), F.count(F.lit(1)).alias("total"))


def visually_verified(children: Column, own: Column, failed: Column) -> Column:
    """Whether any child shot has its picture; without children, whether the scene itself is not among the failed. Nothing failed: true."""
    some = F.coalesce(F.size(children), F.lit(0)) > 0
    alone = own.isNotNull() & ~F.array_contains(failed, own)
    return F.when(F.coalesce(F.size(failed), F.lit(0)) <= 0, True).when(some, F.size(F.array_except(children, failed)) > 0).otherwise(F.coalesce(alone, F.lit(False)))


def sampled_frames(scenes: DataFrame, shots: DataFrame, limit: int = 12) -> DataFrame:
    """ep, scene, pos: of the shots (ep, pos, r_start_ms, r_end_ms, keyframe) that begin in a scene (ep, scene, start_ms, end_ms), else of those that
    lie across it, all or ``limit`` at even steps; then those that have a picture."""
    pairs = interval_join(scenes.select("ep", "scene", "start_ms", "end_ms"), shots, ["ep"])
    begins = F.col("r_start_ms").between(F.col("start_ms"), F.col("end_ms") - 1)
    own = Window.partitionBy("ep", "scene")
    rows = pairs.withColumn("begins", begins).withColumn("any", F.max(begins.cast("int")).over(own)).filter("any = 0 or begins")
    n, index = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy("pos")) - 1
    rows = rows.withColumn("n", n).withColumn("index", index)
    i = F.ceil(F.col("index") * limit / F.col("n"))
    taken = (F.col("n") <= limit) | ((i < limit) & (F.floor(i * F.col("n") / limit) == F.col("index")))
    return rows.filter(taken & F.col("keyframe").isNotNull()).select("ep", "scene", "pos")


# notes ------------------------------------------------------------------------------------------------------


def subtitle_echoes(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """ep, echoes: visible texts (ep, text) that only repeat a line (ep, text) of the dialogue, punctuation aside."""
    said = lines.select("ep", normal_form(F.col("text")).alias("norm")).filter("norm <> ''").distinct()
    seen = texts.select("ep", normal_form(F.col("text")).alias("norm")).filter("norm <> ''")
    return seen.join(said, ["ep", "norm"], "left_semi").groupBy("ep").agg(F.count(F.lit(1)).alias("echoes"))


def usage(notes: DataFrame, coverage: DataFrame) -> DataFrame:
    """ep, tokens, covered_min, covered_avg: what the notes (ep, payload) cost and how much of the scenes (ep, covered_pct) they cover."""
    tokens = F.get_json_object("payload", "$.meta.usage.total_tokens").try_cast("long")
    spent = notes.groupBy("ep").agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"))
    covered = coverage.groupBy("ep").agg(F.min("covered_pct").alias("covered_min"), F.avg("covered_pct").alias("covered_avg"))
    return spent.join(covered, "ep", "left")


# gates ------------------------------------------------------------------------------------------------------


def alignment_violations(cues: DataFrame, shots: DataFrame, assigned: DataFrame, scenes: DataFrame) -> DataFrame:
    """ep, rule, n: cues of an episode without shots (no_shots), cues that no shot took (orphans), shots that no scene holds (no_scenes)."""
    count = lambda rows, name: rows.groupBy("ep").agg(F.count(F.lit(1)).alias("n")).select("ep", F.lit(name).alias("rule"), "n")
    bare = cues.join(shots.select("ep").distinct(), "ep", "left_anti")
    orphans = cues.join(shots.select("ep").distinct(), "ep", "left_semi").join(assigned.select("ep", "cue"), ["ep", "cue"], "left_anti")
    flat = shots.join(scenes.select("ep").distinct(), "ep", "left_anti")
    return count(bare, "no_shots").unionByName(count(orphans, "orphans")).unionByName(count(flat, "no_scenes"))


def act_gaps(acts: DataFrame, sequences: DataFrame) -> DataFrame:
    """ep, act, problem: acts (ep, act, start_seq, end_seq) that do not go on from one another, or do not cover the sequences (ep, n) from 1 on."""
    order = Window.partitionBy("ep").orderBy("act")
    rows = acts.withColumn("due", F.coalesce(F.lag("end_seq").over(order) + 1, F.lit(1))).withColumn("last", F.lead("act").over(order).isNull()).join(sequences.select("ep", "n"), "ep")
    problem = F.array_compact(F.array(
        F.when(F.col("start_seq") != F.col("due"), "break"), F.when(F.col("end_seq") < F.col("start_seq"), "reversed"),
        F.when(F.col("end_seq") > F.col("n"), "beyond"), F.when(F.col("last") & (F.col("end_seq") < F.col("n")), "short"),
    ))
    return rows.select("ep", "act", F.explode(problem).alias("problem"))


def outline_faults(sequences: DataFrame, cues: DataFrame) -> DataFrame:
    """ep, seq, fault: sequences (ep, seq, seq_index, title, value_from, value_to, start_sub, end_sub) that miss a field, are numbered wrongly, or name
    cues that are none; ep, null, missing where an episode with cues has no outline."""
    known = cues.select("ep", F.col("cue").alias("at"), F.lit(True).alias("there"))
    found = lambda column, name: known.select("ep", F.col("at").alias(column), F.col("there").alias(name))
    rows = sequences.join(found("start_sub", "_a"), ["ep", "start_sub"], "left").join(found("end_sub", "_b"), ["ep", "end_sub"], "left")
    place = F.row_number().over(Window.partitionBy("ep").orderBy("seq"))
    rows = rows.withColumn("_place", place)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fault = F.array_compact(F.array(
        *[F.when(blank(c), f"no_{c}") for c in ("title", "value_from", "value_to")], F.when(~F.col("seq_index").eqNullSafe(F.col("_place")), "numbering"),
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown_cue"),
    ))
    none = cues.select("ep").distinct().join(sequences.select("ep"), "ep", "left_anti").select("ep", F.lit(None).cast("long").alias("seq"), F.lit("missing").alias("fault"))
    return rows.select("ep", "seq", F.explode(fault).alias("fault")).unionByName(none)


def subtitle_gate(episodes: DataFrame, extraction: DataFrame) -> DataFrame:
    """ep, code, state: 5 where a person said that there are no subtitles, 6 where none were found and they must be read off the picture, else 0.

    episodes: ep, mode (external, embedded, ocr, none, or null); extraction: ep, subtitle_count.
    """
    rows = episodes.join(extraction.select("ep", "subtitle_count"), "ep", "left")
    code = F.when(F.col("mode") == "none", 5).when(F.coalesce("subtitle_count", F.lit(0)) > 0, 0).when(F.coalesce("mode", F.lit("")).isin("external"), 5).otherwise(6)
    state = F.when(code == 0, "ready").when(code == 5, "no_subtitles").otherwise("needs_ocr")
    return rows.select("ep", code.alias("code"), state.alias("state"))


def part_gate(status: DataFrame, has_key: Column) -> DataFrame:
    """ep, code: 8 where parts are to be fetched and there is no key, 7 where a part is missing or invalid, else 0 (ep, part, state)."""
    open_ = F.count_if(F.col("state").isin("missing", "invalid"))
    rows = status.groupBy("ep").agg(open_.alias("open"), F.max(has_key).alias("key"))
    return rows.select("ep", F.when((F.col("open") > 0) & ~F.col("key"), 8).when(F.col("open") > 0, 7).otherwise(0).alias("code"))

"""Voices to cues: binding, lag, names, attributes, linking of part-local labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import provisional
from .interval import interval_join

SECONDARY, SHARE, VOTES = 0.40, 0.60, 2
LAG_RANGE_MS, LAG_STEP_MS, LAG_CUES = 5000, 250, 6


def bind(cues: DataFrame, turns: DataFrame, offset_ms: int | str = 0) -> DataFrame:
    """Each cue to the voice cluster that speaks most of it, with a co-speaker from 40 % of its length on.

    cues: ep, cue, start_ms, end_ms; turns: ep, cluster_id, start_ms, end_ms. offset_ms shifts cue windows: a number, or
    the name of a column of cues.
    """
    shift = F.col(offset_ms) if isinstance(offset_ms, str) else F.lit(offset_ms)
    moved = cues.select("ep", "cue", (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"))
    spoken = turns.select("ep", "cluster_id", F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    sums = interval_join(moved, spoken, ["ep"]).groupBy("ep", "cue", "cluster_id").agg(F.sum("overlap").alias("overlap"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("overlap")).alias("neg"), "cluster_id")))  # a cue's few voices
    top = sums.groupBy("ep", "cue").agg(ranked.alias("r"))
    rows = cues.join(top, ["ep", "cue"], "left")
    long = F.greatest(F.lit(1).cast("long"), F.col("end_ms") - F.col("start_ms"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    ratio = -first["neg"] / long
    confidence = F.when(F.col("r").isNull(), 0.0).when(ratio >= 0.8, 0.9).when(ratio >= 0.5, 0.75).otherwise(0.55)
    return rows.select(
        "ep", "cue", first["cluster_id"].alias("cluster_id"), confidence.alias("confidence"),
        F.when(F.col("r").isNull(), "no_speech_overlap").otherwise("acoustic_diarization").alias("method"),
        F.when(-second["neg"] / long >= SECONDARY, second["cluster_id"]).alias("secondary_speaker"),
        F.coalesce(-first["neg"], F.lit(0)).cast("long").alias("overlap_ms"),
    )


def estimate_lag(cues: DataFrame, turns: DataFrame) -> DataFrame:
    """ep, offset_ms: the shift of cues, within 5 s, under which their best single-turn overlaps sum to most.

    All trial shifts are one pass: each cue is joined once, widened by the range, and each pair scored under every
    shift. Fewer than six cues, or no turns, give 0; ties go to the least shift, then to the later one.
    """
    long = F.greatest(F.lit(1).cast("long"), F.col("end_ms") - F.col("start_ms"))
    wide = cues.select("ep", "cue", F.col("start_ms").alias("s"), long.alias("dur"), (F.col("start_ms") - LAG_RANGE_MS).alias("start_ms"), (F.col("start_ms") + long + LAG_RANGE_MS).alias("end_ms"))
    spoken = turns.select("ep", F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    pairs = interval_join(wide, spoken, ["ep"]).select("ep", "cue", "s", "dur", "r_start_ms", "r_end_ms", F.explode(F.sequence(F.lit(-LAG_RANGE_MS), F.lit(LAG_RANGE_MS), F.lit(LAG_STEP_MS))).alias("delta"))
    shared = F.least(F.col("s") + F.col("delta") + F.col("dur"), F.col("r_end_ms")) - F.greatest(F.col("s") + F.col("delta"), F.col("r_start_ms"))
    best = pairs.withColumn("shared", shared).filter("shared > 0").groupBy("ep", "cue", "dur", "delta").agg(F.max("shared").alias("shared"))
    totals = best.groupBy("ep", "delta").agg(F.round(F.sum(F.col("shared") / F.col("dur")), 6).alias("total"))
    top = totals.groupBy("ep").agg(F.max(F.struct("total", (-F.abs("delta")).alias("near"), "delta")).alias("top"))
    enough = cues.groupBy("ep").agg(F.count(F.lit(1)).alias("n"))
    offset = F.when((F.col("n") >= LAG_CUES) & F.col("top").isNotNull(), F.col("top.delta")).otherwise(0)
    return enough.join(top, "ep", "left").select("ep", offset.cast("long").alias("offset_ms"))


def label_components(turns: DataFrame, least: float = 0.5) -> DataFrame:
    """ep, part, raw_label, cluster_id: part-local labels linked where turns of different parts share half the shorter one.

    The links come from an interval join; an episode's graph of labels is small, and its components are named in the
    order of their first turn.
    """
    left = turns.select("ep", F.col("part").alias("pa"), F.col("raw_label").alias("la"), "start_ms", "end_ms")
    right = turns.select("ep", F.col("part").alias("pb"), F.col("raw_label").alias("lb"), F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    shorter = F.greatest(F.lit(1).cast("long"), F.least(F.col("end_ms") - F.col("start_ms"), F.col("r_end_ms") - F.col("r_start_ms")))
    links = interval_join(left, right, ["ep"]).filter((F.col("pa") < F.col("pb")) & (F.col("overlap") / shorter >= least)).select("ep", "pa", "la", "pb", "lb").distinct()
    nodes = turns.groupBy("ep", "part", "raw_label").agg(F.min(F.struct("start_ms", "end_ms")).alias("f")).select("ep", "part", "raw_label", "f.start_ms", "f.end_ms")

    def name(key, own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        root = {n: n for n in zip(own["part"], own["raw_label"], strict=True)}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, c, d in edges[["pa", "la", "pb", "lb"]].itertuples(index=False):
            root[top((c, d))] = top((a, b))
        names: dict = {}
        own = own.sort_values(["start_ms", "end_ms", "raw_label", "part"])
        own["cluster_id"] = [names.setdefault(top(n), f"SPEAKER_A{len(names) + 1}") for n in zip(own["part"], own["raw_label"], strict=True)]
        return own[["ep", "part", "raw_label", "cluster_id"]]

    links = links.withColumnRenamed("ep", "in_ep")  # else both sides' ep is the same column
    return nodes.groupBy("ep").cogroup(links.groupBy("in_ep")).applyInPandas(name, "ep long, part int, raw_label string, cluster_id string")


def name_votes(bound: DataFrame) -> DataFrame:
    """ep, cluster_id, name, line_count: the name of most cues' own metadata, given two votes and 60 % of them.

    bound: ep, cue, cluster_id, speaker. Ties go to the name met first.
    """
    rows = bound.filter("cluster_id is not null")
    lines = rows.groupBy("ep", "cluster_id").agg(F.count(F.lit(1)).alias("line_count"))
    votes = rows.filter(~provisional(F.col("speaker"))).groupBy("ep", "cluster_id", F.trim("speaker").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("cue").alias("first"))
    top = votes.groupBy("ep", "cluster_id").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("first")).alias("early"), "name")).alias("top"))
    named = F.when((F.col("top.n") >= VOTES) & (F.col("top.n") / F.col("all") >= SHARE), F.col("top.name"))
    return lines.join(top, ["ep", "cluster_id"], "left").select("ep", "cluster_id", named.alias("name"), "line_count")


def attribute_votes(turns: DataFrame, fields: list[str], group: list[str]) -> DataFrame:
    """group, field, value, votes, known: the majority of known values from 60 % on, else unknown."""
    each = turns.select(*group, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select(*group, "x.field", "x.value")
    counts = each.groupBy(*group, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value") != "unknown"
    top = counts.groupBy(*group, "field").agg(F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known"), F.max(F.when(known, F.struct("n", "value"))).alias("top"))
    wins = F.col("top.n") / F.col("known") >= SHARE
    return top.select(*group, "field", F.when(wins, F.col("top.value")).otherwise("unknown").alias("value"), F.when(wins, F.col("top.n")).otherwise(0).cast("long").alias("votes"), "known")


def cluster_summary(bound: DataFrame, turns: DataFrame) -> DataFrame:
    """ep, cluster_id, line_count, speech_ms, parts; in the order of the number in the cluster's name."""
    lines = bound.filter("cluster_id is not null").groupBy("ep", "cluster_id").agg(F.count(F.lit(1)).alias("line_count"))
    speech = turns.groupBy("ep", "cluster_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.array_join(F.sort_array(F.collect_set(F.col("part").cast("string"))), ",").alias("parts"))
    rows = speech.join(lines, ["ep", "cluster_id"], "left")
    number = F.regexp_extract("cluster_id", r"(\d+)$", 1).cast("long")
    return rows.select("ep", "cluster_id", F.coalesce("line_count", F.lit(0)).cast("long").alias("line_count"), "speech_ms", "parts", F.row_number().over(Window.partitionBy("ep").orderBy(number)).cast("long").alias("ord"))

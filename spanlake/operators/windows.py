"""Exclusion windows, planning of parts and segments, thinning of cuts, even samples, coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import overlap_ratio
from .interval import merged


def window_label(start: Column, end: Column, windows: list[tuple[int, int, str]], least: float = 0.5) -> Column:
    """The label of the window that holds most of a span and more than half of it, the first on ties; else null.

    Windows are a handful of configured rows, so they are an array in the expression and no join is needed.
    """
    if not windows:
        return F.lit(None).cast("string")
    end = F.when(end <= start, start + 1).otherwise(end)
    scored = F.array(*[F.struct(overlap_ratio(start, end, F.lit(a).cast("long"), F.lit(b).cast("long")).alias("ratio"), F.lit(-i).alias("ord"), F.lit(label).alias("label")) for i, (a, b, label) in enumerate(windows)])
    top = F.array_max(scored)
    return F.when(top["ratio"] > least, top["label"])


def in_windows(rows: DataFrame, windows: DataFrame, least: float = 0.5) -> DataFrame:
    """rows (ep, start_ms, end_ms, ...) with ``label``: that of the episode's own window (ep, start_ms, end_ms, label) that holds
    most of a row and more than half of it, the earliest on ties; else null."""
    own = windows.select("ep", F.struct(F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), "label").alias("w"))
    listed = own.groupBy("ep").agg(F.sort_array(F.collect_list("w")).alias("windows"))  # an episode's few configured windows
    end = F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 1).otherwise(F.col("end_ms"))
    scored = F.transform("windows", lambda x, i: F.struct(overlap_ratio(F.col("start_ms"), end, x["a"], x["b"]).alias("ratio"), (-i).alias("ord"), x["label"].alias("label")))
    found = rows.join(listed, "ep", "left").withColumn("top", F.array_max(scored))
    return found.withColumn("label", F.when(F.col("top.ratio") > least, F.col("top.label"))).drop("top", "windows")


def split_by_windows(rows: DataFrame, windows: list[tuple[int, int, str]]) -> tuple[DataFrame, DataFrame]:
    """(kept with a dense index per episode, removed with the window's label)."""
    marked = rows.withColumn("label", window_label(F.col("start_ms"), F.col("end_ms"), windows))
    order = Window.partitionBy("ep").orderBy("start_ms", "cue")
    kept = marked.filter("label is null").drop("label").withColumn("index", F.row_number().over(order).cast("long"))
    return kept, marked.filter("label is not null")


def plan_segments(scenes: DataFrame, segment_ms: int = 90_000, overlap_ms: int = 5_000, fold_ms: int = 10_000, least_ms: int = 1_500) -> DataFrame:
    """ep, pos, segment, start_ms, end_ms: windows of at most 90 s with 5 s shared; a tail under 10 s joins the last one.

    Window i starts at i * (segment - overlap); the last one is the first that leaves less than the fold.
    """
    step = segment_ms - overlap_ms
    span = F.col("r_end_ms") - F.col("r_start_ms")
    last = F.greatest(F.lit(0).cast("long"), F.floor((span - segment_ms - fold_ms) / step).cast("long") + 1)
    ok = scenes.filter(span >= least_ms).withColumn("last", last).withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    start = F.col("r_start_ms") + F.col("segment") * step
    return ok.select("ep", "pos", "segment", start.alias("start_ms"), F.when(F.col("segment") == F.col("last"), F.col("r_end_ms")).otherwise(start + segment_ms).alias("end_ms"))


def segment_fates(scenes: DataFrame, windows: list[tuple[int, int, str]], least_ms: int = 1_500) -> DataFrame:
    """ep, pos, fate: the label of the exclusion window that holds a scene, short where it is too short to view, else planned."""
    label = window_label(F.col("r_start_ms"), F.col("r_end_ms"), windows)
    return scenes.select("ep", "pos", F.coalesce(label, F.when(F.col("r_end_ms") - F.col("r_start_ms") < least_ms, "short").otherwise("planned")).alias("fate"))


def plan_chunks(episodes: DataFrame, threshold_s: int = 3000, target_s: int = 2700, tail_s: int = 600, overlap_s: int = 3) -> DataFrame:
    """ep, part, start_ms, end_ms of (ep, duration_ms): cuts every 45 min over 50 min, a short tail folded back, parts padded."""
    target = target_s * 1000
    fold = min(tail_s * 1000, target // 2)
    whole = F.ceil(F.col("duration_ms") / target).cast("long") - 1
    cuts = F.when(F.col("duration_ms") <= max(threshold_s, target_s) * 1000, F.lit(0).cast("long")).otherwise(whole - F.when(F.col("duration_ms") - whole * target < fold, 1).otherwise(0))
    rows = episodes.filter("duration_ms > 0").withColumn("cuts", F.greatest(F.lit(0).cast("long"), cuts)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts"))))
    pad = overlap_s * 1000
    start = F.when(F.col("part") == 0, 0).otherwise(F.greatest(F.lit(0).cast("long"), F.col("part") * target - pad))
    end = F.when(F.col("part") == F.col("cuts"), F.col("duration_ms")).otherwise(F.least(F.col("duration_ms"), (F.col("part") + 1) * target + pad))
    return rows.select("ep", "part", start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"))


def snap_to_silence(boundaries: Column, silences: Column, tolerance: float = 5.0) -> Column:
    """Each boundary of an array moved to its nearest unused silence within the tolerance, the later one on ties.

    Order matters, since a silence is used once; a fold over the few boundaries of one file.
    """
    places = F.transform(silences, lambda s, i: F.struct(s.alias("s"), i.alias("i")))

    def take(acc: Column, b: Column) -> Column:
        free = F.filter(places, lambda p: ~F.array_contains(acc["used"], p["i"]) & (F.abs(p["s"] - b) <= tolerance))
        near = F.array_min(F.transform(free, lambda p: F.struct(F.abs(p["s"] - b).alias("d"), (-p["i"]).alias("late"), p["s"].alias("s"))))
        return F.struct(
            F.concat(acc["out"], F.array(F.round(F.coalesce(near["s"], b), 3))).alias("out"),
            F.when(near.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(-near["late"]))).alias("used"),
        )

    empty = F.struct(F.array().cast("array<double>").alias("out"), F.array().cast("array<int>").alias("used"))
    return F.sort_array(F.aggregate(boundaries, empty, take)["out"])


def thin_cuts(points: DataFrame, gap: int) -> DataFrame:
    """ep and the points ``at`` kept so that each is at least ``gap`` after the last one kept.

    Which are kept depends on those kept before, so an episode's points are one group; from each kept point the next
    is found by bisection.
    """

    def keep(own: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(own["at"].to_numpy())
        kept, i = [], 0
        while i < len(at):
            kept.append(at[i])
            i = max(i + 1, int(np.searchsorted(at, at[i] + gap)))
        return pd.DataFrame({"ep": own["ep"].iloc[0], "at": kept})

    return points.select("ep", F.col("at").cast("long").alias("at")).groupBy("ep").applyInPandas(keep, "ep long, at long")


def cuts_to_shots(cuts: DataFrame, ends: DataFrame) -> DataFrame:
    """ep, shot_id, start_ms, end_ms: from each cut to the next, the last to the episode's end if that is later."""
    order = Window.partitionBy("ep").orderBy("at")
    rows = cuts.unionByName(ends.select("ep", F.col("duration_ms").alias("at"))).distinct()
    return rows.select("ep", F.row_number().over(order).cast("long").alias("shot_id"), F.col("at").alias("start_ms"), F.lead("at").over(order).alias("end_ms")).filter("end_ms is not null")


def even_sample(rows: DataFrame, limit: int) -> DataFrame:
    """Of each episode's rows in order of pos, all or the ``limit`` at int(i * n / limit)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ep"))
    index = F.row_number().over(Window.partitionBy("ep").orderBy("pos")) - 1
    marked = rows.withColumn("n", n).withColumn("index", index)
    # index is taken if some i has floor(i * n / limit) = index
    i = F.ceil(F.col("index") * limit / F.col("n"))
    taken = (F.col("n") <= limit) | ((i < limit) & (F.floor(i * F.col("n") / limit) == F.col("index")))
    return marked.filter(taken).drop("n", "index")


def coverage(scenes: DataFrame, pieces: DataFrame) -> DataFrame:
    """ep, pos, covered_pct: the share of a scene that the union of its pieces (ep, pos, start_ms, end_ms) covers."""
    clipped = pieces.join(scenes, ["ep", "pos"]).select("ep", "pos", F.greatest("start_ms", "r_start_ms").alias("start_ms"), F.least("end_ms", "r_end_ms").alias("end_ms")).filter("end_ms > start_ms")
    summed = merged(clipped, ["ep", "pos"]).groupBy("ep", "pos").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    pct = 100 * F.coalesce("ms", F.lit(0)) / F.greatest(F.lit(1).cast("long"), F.col("r_end_ms") - F.col("r_start_ms"))
    return scenes.join(summed, ["ep", "pos"], "left").select("ep", "pos", F.round(pct, 1).alias("covered_pct"))

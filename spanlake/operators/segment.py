"""Scene segmentation: boundary evidence, sequence walls, optimal partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import straddled
from .interval import interval_join

PENALTY, REWARD, SPAN, SNAP_MS = 12.0, 8.0, 40, 15_000
MIN_SCENES, MAX_SCENES = 8, 35


def boundaries(shots: DataFrame) -> DataFrame:
    """ep, boundary, cut_ms and the lengths of the shots on either side; boundary i lies after shot i."""
    order = Window.partitionBy("ep").orderBy("pos")
    length = F.col("r_end_ms") - F.col("r_start_ms")
    rows = shots.select("ep", F.col("pos").alias("boundary"), F.col("r_end_ms").alias("cut_ms"), length.alias("left_ms"), F.lead(length).over(order).alias("right_ms"))
    return rows.filter("right_ms is not null")


def protected(cues: DataFrame, cuts: DataFrame) -> DataFrame:
    """(ep, boundary) not to be cut: a cue speaks across it, or cues answer each other over it within half a second."""
    window = lambda lo, hi: cuts.select("ep", "boundary", (F.col("cut_ms") + lo).alias("r_start_ms"), (F.col("cut_ms") + hi).alias("r_end_ms"))
    point = lambda c: cues.select("ep", "cue", F.col(c).alias("at"), F.col(c).alias("start_ms"), (F.col(c) + 1).alias("end_ms"))
    said = interval_join(point("end_ms"), window(-799, 1), ["ep"]).groupBy("ep", "boundary").agg(F.max(F.struct("cue", "at"))["at"].alias("ended"))
    next_ = interval_join(point("start_ms"), window(0, 800), ["ep"]).groupBy("ep", "boundary").agg(F.min(F.struct("cue", "at"))["at"].alias("began"))
    tight = said.join(next_, ["ep", "boundary"]).filter("began - ended < 500").select("ep", "boundary")
    return straddled(cues, cuts).unionByName(tight).distinct()


def features(cues: DataFrame, cuts: DataFrame) -> DataFrame:
    """ep, boundary, silence_ms, score: how much speaks for a change of scene at a cut.

    The last cue that ended and the first that begins (in cue order) come from two running windows.
    """
    none = F.lit(None).cast("long")
    mark = cuts.select("ep", F.col("cut_ms").alias("at"), "boundary", none.alias("cue"), none.alias("time"), F.lit(None).cast("string").alias("text"))

    def beside(column: str, ahead: bool) -> DataFrame:
        rows = cues.select("ep", F.col(column).alias("at"), none.alias("boundary"), "cue", F.col(column).alias("time"), "text").unionByName(mark)
        is_cue = F.col("cue").isNotNull()
        order = Window.partitionBy("ep").orderBy("at", (is_cue if ahead else ~is_cue).cast("int"))
        one = F.when(is_cue, F.struct("cue", "time", "text"))
        found = F.min(one).over(order.rowsBetween(1, Window.unboundedFollowing)) if ahead else F.max(one).over(order.rowsBetween(Window.unboundedPreceding, -1))
        return rows.select("ep", "boundary", found.alias("post" if ahead else "pre")).filter("boundary is not null")

    rows = cuts.join(beside("end_ms", False), ["ep", "boundary"]).join(beside("start_ms", True), ["ep", "boundary"])
    silence = F.greatest(F.lit(0).cast("long"), F.coalesce("post.time", F.col("cut_ms") + 10_000) - F.coalesce("pre.time", F.lit(0)))
    ends = F.col("pre.text").rlike(r"(。|！|？|\.|!|\?)$")
    score = (
        F.lit(0.20)
        + F.when(silence > 4000, 0.35).when(silence > 2000, 0.20).otherwise(0.0)
        + F.when((F.col("left_ms") > 5000) | (F.col("right_ms") > 5000), 0.15).otherwise(0.0)
        + F.when(F.col("pre").isNotNull() & F.col("post").isNotNull() & ends, 0.10).otherwise(0.0)
    )
    if "visual" in cuts.columns:
        score = score + 0.35 * F.coalesce("visual", F.lit(0.0))
    return rows.select("ep", "boundary", silence.alias("silence_ms"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def duration_sums(shots: DataFrame) -> DataFrame:
    """ep, pos, upto_ms: the length of all shots up to each."""
    upto = Window.partitionBy("ep").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return shots.select("ep", "pos", F.sum(F.col("r_end_ms") - F.col("r_start_ms")).over(upto).alias("upto_ms"))


def partition(duration_s: np.ndarray, score: np.ndarray, forbidden: np.ndarray, k_min: int, k_max: int) -> list[int]:
    """Ends (indices) of the best k_min..k_max contiguous parts. score and forbidden: of the boundary after each shot.

    One table serves all numbers of parts: its row k is the best cost of k + 1 parts, whatever is asked for. Ties go
    to fewer parts, then to the earliest predecessor.
    """
    n = len(duration_s)
    if n <= 1:
        return [0] if n else []
    k_min = max(1, min(k_min, n))
    k_max = max(k_min, min(k_max, n))
    total = np.concatenate([[0.0], np.cumsum(duration_s)])
    reach = max(SPAN, -(-n // k_max))

    step = -REWARD * score + PENALTY * forbidden
    best = np.full((k_max, n), np.inf)
    back = np.full((k_max, n), -1)
    for j in range(n):
        first = np.arange(max(0, j - reach + 1), j + 1)
        length = total[j + 1] - total[first]
        cost = np.where(length < 10, (10 - length) * 3.0, np.where(length > 300, (length - 300) * 0.8, 0.0))
        if j < reach:
            best[0, j] = cost[0]
        p = first - 1  # the last shot of the part before; a part that begins at 0 has none
        p, cost = p[p >= 0], cost[p >= 0]
        if len(p):
            value = best[:-1, p] + (cost + step[p])
            back[1:, j] = np.where(np.isfinite(value.min(axis=1)), p[value.argmin(axis=1)], -1)
            best[1:, j] = value.min(axis=1)
    goals = best[k_min - 1 :, n - 1]
    if not np.isfinite(goals).any():
        return [n - 1]
    k = int(np.argmin(goals)) + k_min - 1
    ends, at = [n - 1], n - 1
    while k > 0 and back[k, at] >= 0:
        at, k = int(back[k, at]), k - 1
        ends.append(at)
    return ends[::-1]


def solved_rows(shots: DataFrame, scores: DataFrame, forbidden: DataFrame) -> DataFrame:
    """ep, pos, s (seconds), score and forbidden of the boundary after each shot."""
    rows = shots.join(scores.select("ep", F.col("boundary").alias("pos"), "score"), ["ep", "pos"], "left")
    rows = rows.join(forbidden.select("ep", F.col("boundary").alias("pos"), F.lit(1.0).alias("forbidden")), ["ep", "pos"], "left")
    return rows.select("ep", "pos", ((F.col("r_end_ms") - F.col("r_start_ms")) / 1000.0).alias("s"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("forbidden", F.lit(0.0)).alias("forbidden"))


def solve(shots: DataFrame, scores: DataFrame, forbidden: DataFrame, k_min: int = MIN_SCENES, k_max: int = MAX_SCENES, target: int | None = None) -> DataFrame:
    """ep, scene, first_pos, last_pos, forced: the optimal scenes of each episode; forced marks a cut through dialogue.

    Dynamic programming over one episode's shots is sequential; episodes are independent groups.
    """
    rows = solved_rows(shots, scores, forbidden)
    low, high = (target, target) if target else (k_min, k_max)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        ends = partition(own["s"].to_numpy(), own["score"].to_numpy(), own["forbidden"].to_numpy(), low, high)
        pos, bad = own["pos"].to_numpy(), own["forbidden"].to_numpy() > 0
        starts = [0, *[e + 1 for e in ends[:-1]]]
        return pd.DataFrame({"ep": own["ep"].iloc[0], "scene": range(1, len(ends) + 1), "first_pos": pos[starts], "last_pos": pos[ends], "forced": [bool(bad[e]) and e != ends[-1] for e in ends]})

    return rows.groupBy("ep").applyInPandas(run, "ep long, scene int, first_pos long, last_pos long, forced boolean")


def walls(sequences: DataFrame, cues: DataFrame) -> DataFrame:
    """ep, wall (1..), wall_ms: half-way between a sequence's last cue and the next one's first.

    sequences: ep, seq, start_sub, end_sub.
    """
    order = Window.partitionBy("ep").orderBy("seq")
    pair = sequences.select("ep", F.col("seq").alias("wall"), "end_sub", F.lead("start_sub").over(order).alias("next_sub")).filter("next_sub is not null")
    ends = cues.select("ep", F.col("cue").alias("end_sub"), F.col("end_ms").alias("e"))
    starts = cues.select("ep", F.col("cue").alias("next_sub"), F.col("start_ms").alias("s"))
    return pair.join(ends, ["ep", "end_sub"]).join(starts, ["ep", "next_sub"]).select("ep", "wall", ((F.col("e") + F.col("s")) / 2.0).alias("wall_ms"))


def snap_walls(wall: DataFrame, cuts: DataFrame) -> DataFrame:
    """ep, wall, boundary, distance_ms, within: each wall at its nearest cut, the first on ties; if that is over 15 s off, at
    the last cut before it. Boundaries are pushed up so that they rise strictly: max(index - k) + k as a running maximum. A wall that is
    pushed beyond the last cut has a boundary that is none, and no distance; scenes.sequence_parts then takes the episode as a whole.
    """
    last = Window.partitionBy("ep").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("ep").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    none = F.lit(None).cast("long")
    rows = cuts.select("ep", F.col("cut_ms").cast("double").alias("at"), F.lit(0).alias("kind"), "boundary", none.alias("wall")).unionByName(wall.select("ep", F.col("wall_ms").alias("at"), F.lit(1).alias("kind"), none.alias("boundary"), F.col("wall").cast("long").alias("wall")))
    cut = F.when(F.col("kind") == 0, F.struct("at", "boundary"))
    seen = rows.withColumn("before", F.last(cut, ignorenulls=True).over(last)).withColumn("after", F.first(cut, ignorenulls=True).over(after)).filter("kind = 1")
    down, up = F.abs(F.col("at") - F.col("before.at")), F.abs(F.col("after.at") - F.col("at"))
    near = F.when(F.col("before").isNull() | (up < down), F.struct(up.alias("d"), F.col("after.boundary").alias("boundary"))).otherwise(F.struct(down.alias("d"), F.col("before.boundary").alias("boundary")))
    rows = seen.withColumn("near", near).withColumn("within", F.col("near.d") <= SNAP_MS)
    rows = rows.withColumn("pick", F.when(F.col("within"), F.col("near.boundary")).otherwise(F.coalesce("before.boundary", F.lit(0))))
    k = F.row_number().over(Window.partitionBy("ep").orderBy("wall")) - 1
    rows = rows.withColumn("k", k).withColumn("boundary", F.max(F.col("pick") - F.col("k")).over(Window.partitionBy("ep").orderBy("wall").rowsBetween(Window.unboundedPreceding, 0)) + F.col("k"))
    placed = rows.select("ep", "wall", F.col("at").alias("wall_ms"), "boundary", "within", "pick").join(cuts.select("ep", "boundary", "cut_ms"), ["ep", "boundary"], "left")
    distance = F.abs(F.col("cut_ms") - F.col("wall_ms"))
    within = F.col("within") & ((F.col("pick") == F.col("boundary")) | (distance <= SNAP_MS)) & F.col("cut_ms").isNotNull()
    return placed.select("ep", "wall", "boundary", distance.alias("distance_ms"), F.coalesce(within, F.lit(False)).alias("within"))

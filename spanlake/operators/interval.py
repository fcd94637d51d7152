"""Interval primitives: overlap join by time buckets, best match, nearest match, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import gap_ms, overlap_ms

BUCKET_MS = 10_000


def buckets(start: Column, end: Column, width: int) -> Column:
    """The time buckets an interval lies in; an empty interval lies in that of its start."""
    last = F.greatest(start, end - 1)
    return F.sequence(F.floor(start / width).cast("long"), F.floor(last / width).cast("long"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = BUCKET_MS) -> DataFrame:
    """Pairs of rows of one key whose intervals (start_ms, end_ms; r_start_ms, r_end_ms on the right) share time.

    Both sides are dealt to time buckets and joined on (keys, bucket), so that a long episode spreads over tasks and no
    pair is looked at that is far apart in time; a pair counts in its first common bucket only. Column ``overlap``
    holds the shared milliseconds.
    """
    dealt_left = left.withColumn("_bucket", F.explode(buckets(F.col("start_ms"), F.col("end_ms"), width)))
    dealt_right = right.withColumn("_bucket", F.explode(buckets(F.col("r_start_ms"), F.col("r_end_ms"), width)))
    first = F.greatest(F.floor(F.col("start_ms") / width), F.floor(F.col("r_start_ms") / width)).cast("long")
    overlap = overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("r_start_ms"), F.col("r_end_ms"))
    return dealt_left.join(dealt_right, [*keys, "_bucket"]).filter((F.col("_bucket") == first) & (overlap > 0)).withColumn("overlap", overlap).drop("_bucket")


def best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order that leaves no ties."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rank = 1").drop("_rank")


def best_overlap(cues: DataFrame, shots: DataFrame, least: int, width: int = BUCKET_MS) -> DataFrame:
    """(ep, cue, start_ms, end_ms) x (ep, pos, r_start_ms, r_end_ms): the shot a cue shares most time with, more than
    ``least`` ms; the earliest on ties."""
    pairs = interval_join(cues.select("ep", "cue", "start_ms", "end_ms"), shots.select("ep", "pos", "r_start_ms", "r_end_ms"), ["ep"], width).filter(F.col("overlap") > least)
    top = pairs.groupBy("ep", "cue").agg(F.max(F.struct(F.col("overlap"), (-F.col("pos")).alias("neg"))).alias("top"))
    return top.select("ep", "cue", (-F.col("top.neg")).alias("pos"), F.col("top.overlap").alias("overlap"))


def nearest(cues: DataFrame, shots: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """The shot with the least gap to each cue; the earliest on ties. Columns as of best_overlap, with gap for overlap.

    Shots that overlap or touch a cue are met by an interval join; of the others only the last end before and the
    first start after a cue can be nearest, which two running windows over cues and shots find.
    """
    slim = shots.select("ep", "pos", "r_start_ms", "r_end_ms")
    wide = cues.select("ep", "cue", (F.col("start_ms") - 1).alias("start_ms"), (F.col("end_ms") + 1).alias("end_ms"))
    wide_shots = slim.select("ep", "pos", F.col("r_start_ms"), F.greatest(F.col("r_end_ms"), F.col("r_start_ms") + 1).alias("r_end_ms"))
    touching = interval_join(wide, wide_shots, ["ep"], width)
    touching = touching.select("ep", "cue", "pos", F.lit(0).cast("long").alias("gap"), (F.col("start_ms") + 1).alias("s"), (F.col("end_ms") - 1).alias("e"), "r_start_ms", "r_end_ms")
    touching = touching.filter((F.col("r_start_ms") <= F.col("e")) & (F.col("r_end_ms") >= F.col("s"))).select("ep", "cue", "pos", "gap")
    none = F.lit(None).cast("long")
    events = cues.select("ep", F.col("start_ms").alias("at"), F.lit(1).alias("kind"), "cue", "start_ms", "end_ms", none.alias("pos"), none.alias("r_start_ms"), none.alias("r_end_ms"))
    events = events.unionByName(slim.select("ep", F.col("r_start_ms").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(dict(cues.dtypes)["cue"]).alias("cue"), none.alias("start_ms"), none.alias("end_ms"), F.col("pos").cast("long").alias("pos"), "r_start_ms", "r_end_ms"))
    order = Window.partitionBy("ep").orderBy("at", "kind")
    shot = F.col("kind") == 0
    before = F.max(F.when(shot, F.struct("r_end_ms", (-F.col("pos")).alias("neg"), "r_start_ms"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(shot, F.struct("r_start_ms", "pos", "r_end_ms"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    seen = events.withColumn("before", before).withColumn("after", after).filter("kind = 1")
    apart = lambda s: gap_ms(F.col("start_ms"), F.col("end_ms"), F.col(f"{s}.r_start_ms"), F.col(f"{s}.r_end_ms"))
    back = seen.filter("before is not null").select("ep", "cue", (-F.col("before.neg")).alias("pos"), apart("before").alias("gap"))
    ahead = seen.filter("after is not null").select("ep", "cue", F.col("after.pos").alias("pos"), apart("after").alias("gap"))
    both = touching.unionByName(back).unionByName(ahead)
    found = both.groupBy("ep", "cue").agg(F.min(F.struct("gap", "pos")).alias("near"))
    return found.select("ep", "cue", F.col("near.pos").alias("pos"), F.col("near.gap").alias("gap"))


def merged(df: DataFrame, by: list[str]) -> DataFrame:
    """Unions of overlapping or touching intervals: (by, start_ms, end_ms), a row an island."""
    order = Window.partitionBy(*by).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    islands = df.withColumn("_reach", F.max("end_ms").over(order)).withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach")), 1).otherwise(0))
    islands = islands.withColumn("_island", F.sum("_new").over(Window.partitionBy(*by).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")

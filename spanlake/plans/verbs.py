"""The stages of a run over many episodes: prepare work orders, run those that are open, merge what came back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribute, windows
from ..sources import artifacts, connectors, sinks
from ..streaming import sessions


def prepare(episodes: DataFrame, kind: str = "diarize") -> DataFrame:
    """Work orders of episodes (ep, duration_ms)."""
    return sinks.work_orders(windows.plan_chunks(episodes), kind)


def run(orders: DataFrame, replies: DataFrame, call: Callable[[dict], tuple[str, str | None]], attempts: int = 3) -> DataFrame:
    """Answers to the orders that have none yet, or an invalid one (ep, part, payload); a silent part is done."""
    told = orders.select("ep", "part", F.col("start_ms").alias("offset_ms")).join(replies.select("ep", "part", "payload"), ["ep", "part"])
    done = artifacts.part_status(told).select("ep", "part", F.col("state").isin("ok", "silent").alias("valid"))
    return connectors.answered(sessions.unfinished(orders, done, ["ep", "part"]), call, attempts)


def merge(orders: DataFrame, replies: DataFrame, cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues bound to voices, episodes not merged): turns of all parts, linked into voices, bound to cues. An episode with a part that
    is missing or invalid gives no partial result; it is listed with its code instead."""
    told = orders.select("ep", "part", F.col("start_ms").alias("offset_ms")).join(replies.select("ep", "part", "payload"), ["ep", "part"], "left")
    status = artifacts.part_status(told)
    broken = status.filter(F.col("state").isin("missing", "invalid")).groupBy("ep").agg(F.lit(7).alias("code"), F.sort_array(F.collect_list("part")).alias("parts"))
    turns = artifacts.part_turns(told.join(broken.select("ep"), "ep", "left_anti")).withColumn("part", F.col("part").cast("int"))
    voices = attribute.label_components(turns)
    bound = attribute.bind(cues.join(broken.select("ep"), "ep", "left_anti"), turns.join(voices, ["ep", "part", "raw_label"]))
    return bound, broken

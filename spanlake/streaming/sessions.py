"""Event-time variants: sessions parted by silence, overlapped windows, and work that is resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def silence_sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """ep, start, end, events of (ep, ts): runs of events with no longer pause than ``gap``. For batches and streams alike."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = seen.groupBy("ep", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select("ep", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def overlapped_counts(events: DataFrame, size: str = "90 minutes", slide: str = "85 minutes", late: str = "1 day") -> DataFrame:
    """ep, start, events per window of ``size`` that begin every ``slide``, as segments of a long scene do."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy("ep", F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("ep", F.col("w.start").alias("start"), "events")


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose output is missing or invalid (done: keys, valid): only that is run again."""
    return work.join(done.filter("valid").select(*keys), keys, "left_anti")

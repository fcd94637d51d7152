"""Timeline tables derived from the driver's parquet: an episode is a user, whole seconds read as milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOWS = [(84_000, 105_000, "OP"), (1_320_000, 1_440_000, "ED")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ep, event_id, event_type, value, props, t: seconds since the episode's first event."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.min(at).over(Window.partitionBy("user_id"))
    return events.select(F.col("user_id").alias("ep"), "event_id", "event_type", "value", "props", F.floor((at - first) / 1_000_000).cast("long").alias("t"))


def shots(spark: SparkSession, sf_dir: str, longest: int = 15_000) -> DataFrame:
    """ep, pos, r_start_ms, r_end_ms: from each event to the next, at most ``longest`` ms."""
    order = Window.partitionBy("ep").orderBy("t", "event_id")
    cut = base(spark, sf_dir).select("ep", "event_id", "t", F.lead("t").over(order).alias("next")).filter("next > t")
    return cut.select("ep", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("t").alias("r_start_ms"), F.least(F.col("next"), F.col("t") + longest).alias("r_end_ms"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ep, cue (1..n), start_ms, end_ms, text, speaker, event_id."""
    rows = base(spark, sf_dir).filter(F.col("event_type").isin("click", "view", "purchase"))
    start = F.col("t") - 200
    order = Window.partitionBy("ep").orderBy("t", "event_id")
    return rows.select("ep", F.row_number().over(order).cast("long").alias("cue"), start.alias("start_ms"), (start + 500 + F.floor(F.col("value") * 10)).cast("long").alias("end_ms"), F.col("props").alias("text"), F.col("event_type").alias("speaker"), "event_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ep, part, raw_label, start_ms, end_ms, event_id: two diarizations of the same audio."""
    rows = base(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    long = F.floor(F.col("value") * 12).cast("long")
    one = rows.filter(F.col("event_type").isin("signup", "error", "click")).select("ep", F.lit(0).alias("part"), F.concat(F.lit("Speaker "), (F.col("k") % 3).cast("string")).alias("raw_label"), (F.col("t") + 250).alias("start_ms"), (F.col("t") + 550 + long).alias("end_ms"), "event_id")
    two = rows.filter((F.col("event_type") == "click") & (F.col("event_id") % 5 == 0)).select("ep", F.lit(1).alias("part"), F.concat(F.lit("Speaker "), ((F.col("k") + F.col("event_id")) % 4).cast("string")).alias("raw_label"), (F.col("t") + 300).alias("start_ms"), (F.col("t") + 600 + long).alias("end_ms"), "event_id")
    return one.unionByName(two)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ep, action, segment, r_start_ms, r_end_ms, who, mouth_state, mouth_motion; some states and motions are none that is legal."""
    rows = base(spark, sf_dir).filter(F.col("event_type").isin("error", "view"))
    kind, odd, long = F.col("event_id") % 4, F.col("event_id") % 6 == 5, F.col("event_id") % 5 == 2
    state = F.when(odd, "open").when(kind.isin(0, 1), "moving").when(kind == 2, "still").otherwise("not_visible")
    motion = F.when(kind.isin(0, 1), "speaking").when(kind == 2, "chewing").when(odd, "humming").otherwise("not_applicable")
    end = F.col("t") + F.when(long, 4000).otherwise(2000)
    segment = F.floor(F.col("t") / 60_000).cast("long")
    return rows.select("ep", F.col("event_id").alias("action"), segment.alias("segment"), F.col("t").alias("r_start_ms"), end.cast("long").alias("r_end_ms"), F.concat(F.lit("P"), (F.col("event_id") % 5).cast("string")).alias("who"), state.alias("mouth_state"), motion.alias("mouth_motion"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ep, index, speaker, text: conversations as lines."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ep"), F.col("turn").alias("index"), F.col("role").alias("speaker"), "text")

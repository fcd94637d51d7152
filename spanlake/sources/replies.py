"""Model replies: event streams folded to text, JSON found in prose, classes of replies, encodings within a budget."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes one part may have, bytes a second of plain audio, bit rates from best to least.
BUDGET, WAVE = int(10_000_000 * 3 / 4 * 0.97), 32_000
RATES = [64, 48, 40, 32, 24, 16]


def audio_encoding(duration_s: Column, raw_bytes: Column, budget: int = BUDGET) -> Column:
    """passthrough, wav, mp3-<kbps>, or null if nothing fits."""
    fits = F.filter(F.array(*map(F.lit, RATES)), lambda r: r * 125 * duration_s <= budget)
    rate = F.get(fits, F.lit(0))
    return F.when(raw_bytes <= budget, "passthrough").when(duration_s * WAVE <= budget, "wav").otherwise(F.concat(F.lit("mp3-"), rate.cast("string")))


def folded(lines: DataFrame) -> DataFrame:
    """id, text, finish of event-stream lines (id, pos, line): deltas joined in order up to [DONE]; lines that are no JSON are skipped."""
    data = lines.filter(F.col("line").startswith("data:")).withColumn("body", F.trim(F.substring("line", 6, 1 << 30)))
    end = data.filter("body = '[DONE]'").groupBy("id").agg(F.min("pos").alias("end"))
    live = data.join(end, "id", "left").filter("end is null or pos < end")
    delta = F.get_json_object("body", "$.choices[0].delta.content")
    finish = F.get_json_object("body", "$.choices[0].finish_reason")
    rows = live.select("id", "pos", delta.alias("delta"), finish.alias("finish"))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("delta", F.lit("")).alias("delta"))))
    return rows.groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["delta"]), "").alias("text"), F.max(F.when(F.col("finish").isNotNull(), F.struct("pos", "finish")))["finish"].alias("finish"))


def find_json(text: str | None) -> str | None:
    """The first whole JSON object or array in prose, as compact text; trailing commas are forgiven, cut-off values are not."""
    if not text:
        return None
    body = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", text)
    for attempt in (body, re.sub(r",\s*([}\]])", r"\1", body)):
        start = re.search(r"[{\[]", attempt)
        if start:
            try:
                return json.dumps(json.JSONDecoder().raw_decode(attempt[start.start() :])[0], ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                continue
    return None


def json_in(text: Column) -> Column:
    """find_json over a column; finding where a value ends needs a JSON decoder."""

    @F.pandas_udf("string")
    def every(s: pd.Series) -> pd.Series:
        return s.map(find_json)

    return every(text)


def reply_class(payload: Column) -> Column:
    """ok, silent (an explicit empty list of segments) or invalid."""
    segments = F.from_json(payload, "struct<segments:array<struct<speaker:string,start:double,end:double>>>")["segments"]
    listed = F.coalesce(F.get_json_object(payload, "$.segments"), payload)
    good = lambda s: (F.length(F.trim(s["speaker"])) > 0) & (s["end"] > s["start"]) & (s["start"] >= 0)
    return F.when(F.trim(listed) == "[]", "silent").when(F.coalesce(F.exists(segments, lambda s: F.coalesce(good(s), F.lit(False))), F.lit(False)), "ok").otherwise("invalid")

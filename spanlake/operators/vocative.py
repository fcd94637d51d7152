"""Names called out in lines, and whom a speaker therefore is not."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators that set a called-out name off from its line (fixed value).
SEPARATORS = "，,、：:！!？?…—·~～  \t\"“”「」『』（）()【】"
_CLASS = re.escape(SEPARATORS)


def positions_in(line: str, term: str) -> list[str]:
    """start, mid or end for every place at which a line, given something else in it, calls the term."""
    found = []
    for m in re.finditer(f"(?:^|[{_CLASS}]){re.escape(term)}(?:$|[{_CLASS}])", line, re.M):
        head, tail = line[: m.start()], line[m.end() :]
        if (head + tail).strip(SEPARATORS + "\n").strip():
            found.append("start" if not head.strip(SEPARATORS) else "mid" if tail.strip(SEPARATORS) else "end")
    return found


def address_positions(text: Column, term: Column) -> Column:
    @F.pandas_udf("array<string>")
    def every(text: pd.Series, term: pd.Series) -> pd.Series:
        return pd.Series([positions_in(x, y) for x, y in zip(text, term, strict=True)])

    return every(text, term)


def address_events(lines: DataFrame, names: DataFrame) -> DataFrame:
    """ep, index, cluster_id, term, position: an event for every call of a known name (ep, term).

    Lines are cut at separators and joined to names by equality, so only lines that hold a name as a whole piece are looked at;
    names that hold a separator themselves are found by their first piece.
    """
    cut = rf"[{_CLASS}\n]+"
    first = lambda c: F.filter(F.split(c, cut), lambda x: x != "")[0]
    terms = names.select("ep", F.trim("term").alias("term")).filter("term <> ''").distinct().withColumn("piece", first(F.col("term")))
    pieces = lines.select("ep", "index", "cluster_id", "text", F.explode(F.array_distinct(F.split("text", cut))).alias("piece"))
    pairs = pieces.join(terms, ["ep", "piece"]).select("ep", "index", "cluster_id", "text", "term").distinct()
    return pairs.withColumn("position", F.explode(address_positions(F.col("text"), F.col("term")))).drop("text")


def term_tally(events: DataFrame) -> DataFrame:
    """Per term: calls, by position, and how many come from attributed lines."""
    at = lambda p: F.count_if(F.col("position") == p).alias(f"at_{p}")
    return events.groupBy("ep", "term").agg(F.count(F.lit(1)).alias("count"), at("start"), at("mid"), at("end"), F.count_if(F.col("cluster_id").isNotNull()).alias("negative"))


def not_speaker(events: DataFrame) -> DataFrame:
    """ep, cluster_id, terms: names that a cluster called and so is not, sorted."""
    own = events.filter("cluster_id is not null and cluster_id <> ''")
    return own.groupBy("ep", "cluster_id").agg(F.array_join(F.sort_array(F.collect_set("term")), ",").alias("terms"))

"""Choice of a subtitle stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words in a title that mark signs and songs; language preferences.
SKIP = ["forced", "sign", "song", "lyric", "credit"]
PREFERENCES = ["chi", "zho", "chs", "cht", "zh"]


def select_stream(streams: DataFrame, preferences: list[str] | None = None) -> DataFrame:
    """ep, index, reason: of (ep, index, language, title, forced) the stream most likely to be dialogue.

    First by preferred language among streams that are no signs, then any of those, then any. The preferences are a handful
    of configured words, so they are tried inside an expression.
    """
    wanted = preferences or PREFERENCES
    lang, title = F.lower(F.coalesce("language", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    marked = F.coalesce("forced", F.lit(0)) != 0
    for w in SKIP:
        marked = marked | F.concat_ws(" ", lang, title).contains(w)
    order = F.lit(len(wanted))
    for i, w in reversed(list(enumerate(wanted))):
        order = F.when(lang.contains(w) | title.contains(w), i).otherwise(order)
    rows = streams.withColumn("skip", marked).withColumn("order", F.when(F.col("skip"), len(wanted) + 1).otherwise(order))
    first = F.row_number().over(Window.partitionBy("ep").orderBy("order", "index"))
    reason = F.when(F.col("skip"), "last_resort").when(F.col("order") == len(wanted), "first_non_sign").otherwise("language")
    return rows.withColumn("rank", first).filter("rank = 1").select("ep", "index", reason.alias("reason"))

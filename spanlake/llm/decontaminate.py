"""Benchmark decontamination by winnowing (DataFrame functions only).

Texts are words, lower-cased in A-Z. Of every window of ``window - gram + 1`` consecutive word ``gram``-grams, that is
of ``window`` words, the grams with the least hash are the fingerprints. The choice only depends on the window's own
words, so a span of ``window`` words that document and item share has the same fingerprint at the same place in
both: none is missed. Fingerprints of both sides are joined; each match is extended, by comparing words, to all windows
that contain the fingerprint. Items shorter than a window have no window of grams; their whole word sequence
is the window, searched by the least word hash in it (a gram of one word) and extended in the same way.

Only fingerprints of documents are shuffled or probed. Where the benchmark's fingerprints are few, which is counted,
they are broadcast; else the join shuffles. Texts are read again only for documents that have a match.

Defined cases: an item without an item_id goes by the empty one, and items that share an id count as one; a null or wordless text has no words and no hits; a null or wordless item has no window; equal items
each count; repeated rows of documents are judged alike and each returned; an empty benchmark leaves all clean;
grams of equal hash are compared by their words; very long texts are arrays of words in one task each. Input columns named like the added ones are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 10, 5
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: fingerprints (about 40 bytes each) or matched documents (24 bytes) that may be broadcast, by count
BROADCAST_ROWS = 500_000
#: bytes of items' words that are broadcast to the extension
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(common.lower_ascii(F.coalesce(text, F.lit(""))), DELIMITERS), lambda w: w != "")


def sliding(rows: DataFrame, keep: list[str], column: str, span: int, f) -> DataFrame:
    """The array in ``column`` with f (least or greatest) taken over every window of ``span``, by doubling the width."""
    shifted = lambda k: F.slice(column, k + 1, F.greatest(F.lit(0), F.size(column) - k))
    width = 1
    while width < span:
        step = min(width, span - width)
        rows = rows.select(*keep, F.zip_with(column, shifted(step), lambda x, y: f(x, y)).alias(column))
        width += step
    return rows.select(*keep, F.slice(column, 1, F.greatest(F.lit(0), F.size(column) - (span - 1))).alias(column))


def fingerprints(rows: DataFrame, keep: list[str], window: int, gram: int) -> DataFrame:
    """(keep, words) -> (keep, pos, fp): the winnowed grams, pos the word at which one starts."""
    span = window - gram + 1
    every = F.transform(F.sequence(F.lit(1), F.size("words") - (gram - 1)), lambda i: F.xxhash64(F.slice("words", i, gram)))
    # a filter on the number of words would be pushed below and split the text twice
    hashed = rows.select(*keep, F.when(F.size("words") >= window, every).alias("g"))
    least = sliding(hashed.select(*keep, "g", F.col("g").alias("m")), [*keep, "g"], "m", span, F.least)
    # so padded, the windows that hold gram i are the span elements from i on: the greatest of their minima is the gram itself if it was chosen
    pad = F.array_repeat(F.lit(-(1 << 63)), span - 1)
    chosen = sliding(least.select(*keep, "g", F.concat(pad, "m", pad).alias("m")), [*keep, "g"], "m", span, F.greatest)
    picks = F.zip_with("g", "m", lambda g, top: F.when(g == top, g))
    return chosen.select(*keep, F.posexplode(picks).alias("pos", "fp")).filter("fp is not null")


def short_anchors(rows: DataFrame, keep: list[str], below: int) -> DataFrame:
    """Of items under a window long: their word of least hash, and all its places in the item."""
    short = rows.filter((F.size("words") > 0) & (F.size("words") < below)).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    least = F.array_min("h")
    at = F.transform("h", lambda g, i: F.when(g == least, F.struct(i.alias("pos"), g.alias("fp"))))
    return short.select(*keep, F.explode(F.filter(at, lambda x: x.isNotNull())).alias("x")).select(*keep, "x.pos", "x.fp")


def matches(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, words) and saved (item, words) -> (key, item, shift): document word = item word + shift at a shared fingerprint."""
    index = common.saved(fingerprints(items, ["item"], window, gram), "bench")
    anchors = common.saved(short_anchors(items, ["item"], window), "anchors")
    side = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    meet = lambda fps, idx: fps.join(side(idx.withColumnRenamed("pos", "q")), "fp").select("_k1", "_k2", "item", (F.col("pos") - F.col("q")).alias("shift"), F.col("q").alias("q"))
    found = meet(fingerprints(docs, ["_k1", "_k2"], window, gram), index)
    if not anchors.isEmpty():
        each = docs.select("_k1", "_k2", F.posexplode("words").alias("pos", "w")).select("_k1", "_k2", "pos", F.xxhash64("w").alias("fp"))
        found = found.unionByName(meet(each, anchors))
    return found.distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per key of a contaminated text: _k1, _k2, n_hit, n_items, item_ids (sorted strings). docs: _k1, _k2, text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("item", F.xxhash64(F.coalesce("item_id", F.lit("")), F.array_join("words", " "))).dropDuplicates(["item"])
    items = common.saved(items, "items")
    spread = docs.select("_k1", "_k2", words(F.col("text")).alias("words"))
    found = common.saved(matches(spread, items, window, gram), "matches")
    # texts are read a second time, of matched documents only
    keys = found.select("_k1", "_k2").distinct()
    keys = common.saved(keys, "keys")
    few = keys.count() <= BROADCAST_ROWS
    again = docs.join(F.broadcast(keys) if few else keys, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", words(F.col("text")).alias("words"))
    sides = items.select("item", F.col("words").alias("item_words"))
    size = sides.agg(F.sum(F.aggregate("item_words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16))).first()[0] or 0
    sides = F.broadcast(sides) if size <= BROADCAST_BYTES else sides
    pairs = found.join(sides, "item").groupBy("_k1", "_k2", "item", "shift").agg(F.collect_set("q").alias("qs"), F.first("item_words").alias("item_words"))
    joined = pairs.join(again, ["_k1", "_k2"])
    span = F.least(F.lit(window), F.size("item_words"))
    # the item windows that contain a matched fingerprint, as starts in the item
    starts = F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(F.greatest(F.lit(0), q - (window - 1)), F.least(q, F.size("item_words") - span)))))
    same = lambda s: (s + F.col("shift") >= 0) & (F.slice("words", F.greatest(F.lit(0), s + F.col("shift")) + 1, span) == F.slice("item_words", s + 1, span))
    spans = joined.select("_k1", "_k2", "item", span.alias("len"), F.transform(F.filter(starts, same), lambda s: s + F.col("shift")).alias("at")).filter(F.size("at") > 0)
    spans = common.saved(spans, "spans")
    runs = spans.select("_k1", "_k2", "len", F.explode("at").alias("at")).groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("runs"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda acc, r: F.struct(F.greatest(acc["end"], r["at"] + r["len"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), r["at"] + r["len"] - F.greatest(acc["end"], r["at"]))).cast("long").alias("n"))
    counted = runs.select("_k1", "_k2", F.aggregate("runs", zero, add)["n"].alias("n_hit"))
    named = spans.select("_k1", "_k2", "item").distinct().join(items.select("item", "item_id"), "item")
    named = named.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set(F.coalesce("item_id", F.lit("")))).alias("item_ids")).withColumn("n_items", F.size("item_ids"))
    return counted.join(named, ["_k1", "_k2"])


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a 128-bit key of their text."""
    return docs.withColumns({"_k1": F.xxhash64("text"), "_k2": F.xxhash64(F.lit(1), F.col("text"))})


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input's rows and columns whose text shares no window with an item."""
    rows = keyed(docs)
    bad = common.saved(hits(rows.select("_k1", "_k2", "text"), benchmark).select("_k1", "_k2"), "bad")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return rows.join(side, ["_k1", "_k2"], "left_anti").select(*docs.columns)


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = keyed(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = common.saved(hits(docs.select("_k1", "_k2", "text"), common.table(spark, sf_dir, "benchmark")), "hits")
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS // 10 else found
    rows = docs.select("doc_id", "_k1", "_k2", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(side, ["_k1", "_k2"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ids = F.array_join(F.coalesce("item_ids", F.array().cast("array<string>")), ",")
    return rows.select("doc_id", "n_words", n("n_hit").alias("n_hit"), n("n_items").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_aggregate(w[p:p + least(10, len(w)) - 1], 'string_agg', ' ') AS win, least(10, len(w)) AS n
       FROM i, generate_series(1, greatest(1, len(w) - 9)) AS g(p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, list_aggregate(w[p:p + n - 1], 'string_agg', ' ') AS win
       FROM d, lens, generate_series(1, len(w) - n + 1) AS g(p) WHERE len(w) >= n),
m AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS pos FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

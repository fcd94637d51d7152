"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text's words are its runs of letters, lower-cased. Every anchor (a common word) is followed by a chain: the next
``CHAIN`` words that are no anchors. Anchor and chain make one spot signature; the set of a text's
signatures, as sorted hashes, is its fingerprint, so equal texts have equal fingerprints and the whole text counts.
The start of a text is an anchor too. Where anchors are rare (as in tables of names) words stand in for them: a word
is a spot if none of the ``GAP`` words before it is an anchor. Every spot thus hangs on the few words around it, and
an edit changes only signatures near it. Likeness is the Jaccard share of two sets; a pair whose set lengths alone
rule the threshold out is not compared.

Defined cases: a null text counts as empty; an anchor that no other word follows stands alone; a text without letters
has the empty fingerprint; likeness is one of fingerprints, so that of equal ones, the empty ones too, is 1; of rows that
repeat a doc_id the one with the smaller text hash stands first; rows with a null doc_id stand before all; a single
document is its own next; a long text is read whole, with its signatures alone held beside it; an empty table gives no rows; of the
input only doc_id and text are read, whatever else it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

# Common words of English, French, German and Spanish (fixed values).
ANCHORS = """
the and of to in is that it he for was on are with as by be this at from or an not but they which you have
de la le les et un une du des en est que qui dans par pour au sur avec elle ne pas
der die das und zu den von mit ist im dem auf nicht ein eine als auch sich sie es
el los y por con para del se las no su al lo más como
"""
CHAIN, GAP = 2, 5
#: bytes of documents that one range of the ordered table holds
RANGE_BYTES = 24 << 20
#: sets of one unit that one task compares
TILE = 1000
#: every byte but letters and what lies beyond ASCII becomes a space
CLEAN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def signatures(text: str, anchors: frozenset[bytes], chain: int = CHAIN) -> frozenset[int]:
    """The set of spot signatures, as 32-bit hashes."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(CLEAN).split()
    content, spots, since = [], [(b"", 0)], GAP
    for w in words:
        if w in anchors:
            spots.append((w, len(content)))
            since = 0
        else:
            content.append(w)
            if since >= GAP:
                spots.append((w, len(content)))
            since += 1
    return frozenset(crc32(b" ".join((w, *content[i : i + chain]))) for w, i in spots if i < len(content) or w in anchors)


def fingerprint(signs: frozenset[int]) -> str:
    return np.sort(np.fromiter(signs, ">u4", len(signs))).astype(">u4").tobytes().hex()


def parse(printed: str) -> frozenset[int]:
    return frozenset(np.frombuffer(bytes.fromhex(printed), ">u4").tolist())


def likeness(a: frozenset[int], b: frozenset[int], least: float = 0.0) -> float:
    """Jaccard share, 1 of two empty sets; 0 without comparing where the lengths alone keep it under ``least``."""
    if not a and not b:
        return 1.0
    if not a or not b or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def in_order(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Documents in ranges of doc_id, one range a partition and sorted, each closed by the document that follows it.

    Columns: doc_id, text, ghost (true on the closing copy). Range bounds are quantiles; the driver sees the bounds
    and the first doc_id of each range, as many as there are ranges.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes), 1)
    cuts = rows.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids, side="right"))

    heads = {r["r"]: r["first"] for r in rows.select("at").groupBy(range_of("at").alias("r")).agg(F.min("at").alias("first")).collect()}
    used = sorted(heads)
    before = {r: used[i - 1] for i, r in enumerate(used)}  # the first range's head closes the last

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, ids, side="right").tolist()
        return pd.Series([[r, -1 - before[r]] if heads[r] == x else [r] for r, x in zip(own, ids.tolist(), strict=True)])

    spread = rows.withColumn("place", F.explode(places("at")))
    ghost = F.col("place") < 0
    spread = spread.select("doc_id", "at", "text", ghost.alias("ghost"), F.when(ghost, -1 - F.col("place")).otherwise(F.col("place")).alias("place"))
    spread = spread.withColumn("_t", F.xxhash64("text"))
    return spread.repartitionById(int(max(used, default=0)) + 1, "place").sortWithinPartitions("ghost", "at", "_t").select("doc_id", "text", "ghost")


def op10_fingerprints(docs: DataFrame, anchors: str = ANCHORS) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness and the next document's."""
    common_words = frozenset(w.encode() for w in anchors.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, closed = None, False
        for batch in batches:
            rows, size = [], 0
            for doc_id, text, ghost in zip(*(batch.column(c) for c in ("doc_id", "text", "ghost")), strict=True):
                if closed:
                    break
                doc_id, text, closed = doc_id.as_py(), text.as_py(), ghost.as_py()
                signs = signatures(text, common_words)
                if held is not None:
                    own_id, own, own_signs = held
                    cut = len(own) // 4
                    edited = own[: len(own) - cut] + text[:cut]
                    edited_signs = signatures(edited, common_words)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((own_id, len(own), sha, fingerprint(own_signs), fingerprint(edited_signs), likeness(own_signs, edited_signs), likeness(own_signs, signs)))
                    size += len(rows[-1][3]) + len(rows[-1][4])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                held = None if closed else (doc_id, text, signs)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tile: int = TILE, anchors: str = ANCHORS) -> DataFrame:
    """doc_id and component_id: the smallest doc_id that chains of pairs of likeness ``threshold`` or more reach.

    Equal sets are compared once. Sets are partitioned by length, in steps of 1 / threshold, so that a set only meets its own
    and the next partition; there, two sets that are alike share one of their rarest signatures (as many as the
    threshold lets differ, and one). Sets that share one are a unit, in order of length: pairs are skipped by length
    and where they are linked already. A unit of over ``tile`` sets is cut into pairs of tiles.
    Documents with the empty set are linked by equal texts.
    """
    common_words = frozenset(w.encode() for w in anchors.split())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(np.fromiter(s, np.int64, len(s))) for s in (signatures(t.as_py() or "", common_words) for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("blank"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "blank", "signs"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("blank"), "text").mapInArrow(sign, "doc_id long, blank long, signs array<long>")
    rows = common.saved(rows.withColumn("key", F.when(F.size("signs") > 0, F.xxhash64("signs")).otherwise(F.col("blank"))), "signs")
    sets = common.saved(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("signs").alias("signs")), "sets")
    each = sets.select("key", F.explode("signs").alias("sign"))
    often = each.groupBy("sign").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(often, "sign").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "sign"))).alias("ranked"))
    size = F.size("signs")
    step = F.floor(F.log(size.cast("double")) / float(np.log(1 / threshold)) + 1e-9).cast("int")
    rare = F.slice("ranked", 1, size - F.ceil(size * threshold - 1e-9).cast("int") + 1)
    dealt = sets.join(ranked, "key").select("key", "signs", size.alias("size"), F.explode(F.flatten(F.transform(rare, lambda x: F.array(F.struct(x["sign"], step.alias("step")), F.struct(x["sign"], (step + 1).alias("step")))))).alias("u"))
    dealt = common.saved(dealt.select("key", "signs", "size", F.xxhash64("u").alias("unit")), "dealt")
    hot = dealt.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")).filter("tiles > 1")
    cut = dealt.join(hot, "unit", "left").withColumn("own", F.pmod("key", F.coalesce("tiles", F.lit(1))).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    cut = cut.select(F.xxhash64("unit", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "size", "key", "signs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, met, root = None, [], {}

        def top(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        for batch in batches:
            left, right = [], []
            for u, n, key, signs in zip(*(batch.column(c).to_pylist() for c in ("unit", "size", "key", "signs")), strict=True):
                if u != unit:
                    unit, met, root = u, [], {}
                if key in root:
                    continue
                root[key], own = key, frozenset(signs)
                met = [x for x in met if x[0] >= threshold * n]  # shorter sets are out of reach for all that follow
                for _, other, theirs in met:
                    if top(other) != top(key) and likeness(own, theirs, threshold) >= threshold:
                        left.append(key)
                        right.append(other)
                        root[top(key)] = top(other)
                met.append((n, key, own))
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    links = cut.repartition("unit").sortWithinPartitions("unit", "size", "key").mapInArrow(run, "a long, b long")
    roots = graph.components(links).withColumnRenamed("node", "key")
    of = sets.select("key", "rep").join(roots, "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("key", "component_id")
    return rows.select("doc_id", "key").join(common.saved(named, "named"), "key").select("doc_id", "component_id")


def op10_spot_signatures(spark, sf_dir: str) -> DataFrame:
    return op10_fingerprints(common.table(spark, sf_dir, "documents"))

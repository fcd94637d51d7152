"""SimHash near-duplicates: 64-bit fingerprints, compared exactly in tiles with exclusive-or and bit counts.

Fingerprints are compared once each, however many documents share one. Cut into blocks of bits, two fingerprints
within ``radius`` bits agree on all blocks but ``radius`` at least, so only fingerprints that share the values of so many blocks
are compared; of those, all are. There are as many blocks as keep the fingerprints that share a key by chance few (three up to some
16 million distinct ones, four up to some 30 billion), so that comparisons grow with the fingerprints, not their square. A key shared by many is cut into tiles of one population count and at most about ``TILE`` rows, and only
pairs of tiles whose population counts differ by at most the radius meet, each in a unit of its own. Within a unit
the comparison is by tiles too, and what leaves it is a spanning forest of its links, never all pairs.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; texts of fewer words than
a shingle are one shingle; rows with a null doc_id get the component of their fingerprint; equal texts have equal
fingerprints; rows that repeat are each returned; a long text is hashed in chunks of shingles; input columns other than doc_id and text
are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

SEED = 42
SPACE = re.compile(rb"[ \t-\r]+")
#: shingles hashed at once; bytes of text from which word ends are kept as numbers of an array
CHUNK, LONG = 1 << 16, 1 << 20
#: fingerprints that may share a key by chance
CHANCE = 8
TILE = 1024
SUB = 256
FEW = 24


def text_bits(text: str | None, shingle: int) -> bytes:
    """The fingerprint's 8 bytes, most significant first."""
    line = SPACE.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip()
    if not line:
        return bytes(8)
    ends = [*np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist(), len(line)] if len(line) < LONG else np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    n = max(1, len(ends) - shingle + 1)
    digest, sums = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        stops = ends[i + shingle - 1 : min(n, i + CHUNK) + shingle - 1] if len(ends) >= shingle else [len(line)]
        starts = [0 if k == 0 else ends[k - 1] + 1 for k in range(i, min(n, i + CHUNK))]
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
        sums += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """The rows' doc_id and fingerprint as a signed long, then the long columns of ``keep``; the others are dropped."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = b"".join(text_bits(t.as_py(), shingle) for t in batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(np.frombuffer(bits, ">u8").astype(np.uint64).view(np.int64))} | {c: batch.column(c) for c in keep})

    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(make, ", ".join(f"{c} long" for c in ("doc_id", "fp", *keep)))


def linked(fp: np.ndarray, radius: int) -> np.ndarray:
    """For the fingerprints of one unit, sorted by population count: the index of the least member of each one's component."""
    n = len(fp)
    count = np.bitwise_count(fp)
    near = np.zeros((n, n), bool)
    for i in range(0, n, SUB):
        a, most = fp[i : i + SUB], count[min(i + SUB, n) - 1]
        for j in range(i, n, SUB):
            if int(count[j]) - int(most) > radius:
                break
            b = fp[j : j + SUB]
            near[i : i + SUB, j : j + SUB] = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    near |= near.T
    label = np.arange(n)
    while True:
        then = np.empty_like(label)
        for i in range(0, n, SUB):
            then[i : i + SUB] = np.where(near[i : i + SUB], label[None, :], n).min(axis=1)
        then = then[then]
        if (then == label).all():
            return label
        label = then


def compare(radius: int):
    """Rows (unit, fp) sorted by unit and population count -> links (a, b), a forest of each unit's."""

    def links(unit: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = fp.view(np.uint64)
        edge = np.flatnonzero(np.diff(unit)) + 1
        start = np.concatenate([[0], edge])
        length = np.diff(np.concatenate([start, [len(unit)]]))
        left, right = [], []
        few = np.repeat(length <= FEW, length)
        for d in range(1, min(FEW, int(length.max(initial=1)))):
            at = np.flatnonzero((unit[d:] == unit[:-d]) & few[d:])
            at = at[np.bitwise_count(bits[at] ^ bits[at + d]) <= radius]
            left.append(fp[at])
            right.append(fp[at + d])
        for s, n in zip(start[length > FEW], length[length > FEW], strict=True):
            root = linked(bits[s : s + n], radius)
            own = np.flatnonzero(root != np.arange(n))
            left.append(fp[s + own])
            right.append(fp[s + root[own]])
        return np.concatenate([np.empty(0, np.int64), *left]), np.concatenate([np.empty(0, np.int64), *right])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            units = np.concatenate([units, batch.column("unit").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if not len(units):
                continue
            whole = np.searchsorted(units, units[-1], side="left")
            if whole:
                a, b = links(units[:whole], fps[:whole])
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})
                units, fps = units[whole:], fps[whole:]
        if len(units):
            a, b = links(units, fps)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return run


def blocks_for(count: int, radius: int) -> int:
    """The least number of blocks whose keys, of all but ``radius`` of them, hardly meet by chance."""
    parts = radius + 1
    while count > CHANCE << 64 * (parts - radius) // parts and parts < 16:
        parts += 1
    return parts


def units(distinct: DataFrame, radius: int, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """(fp) -> (unit, pc, fp): every two fingerprints within the radius share a unit at least once."""
    parts = parts or blocks_for(distinct.count(), radius)
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    keep = lambda chosen: sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    blocks = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(keep(chosen)))).alias("v"))
        for i, chosen in enumerate(combinations(range(parts), parts - radius))
    ])
    rows = distinct.select("fp", F.bit_count("fp").alias("pc"), F.explode(blocks).alias("k")).select("fp", "pc", "k.i", "k.v")
    tiles = rows.groupBy("i", "v", "pc").agg(F.count(F.lit(1)).alias("n"))
    hot = tiles.groupBy("i", "v").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pc", F.ceil(F.col("n") / tile).cast("int")))).alias("tiles"))
    hot = common.saved(hot.filter(F.col("n") > tile).drop("n"), "hot")
    if hot.isEmpty():
        return rows.select(F.xxhash64("i", "v").alias("unit"), "pc", "fp")
    tagged = rows.join(hot, ["i", "v"], "left")
    cold = tagged.filter("tiles is null").select(F.xxhash64("i", "v").alias("unit"), "pc", "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")[F.col("pc")]).cast("int")
    many = tagged.filter("tiles is not null").withColumn("own", F.struct(F.col("pc"), own.alias("t")))
    partners = F.flatten(F.transform(
        F.filter(F.sequence(F.col("pc") - radius, F.col("pc") + radius), lambda q: F.map_contains_key("tiles", q)),
        lambda q: F.transform(F.sequence(F.lit(0), F.element_at("tiles", q) - 1), lambda t: F.struct(q.alias("pc"), t.alias("t"))),
    ))
    many = many.withColumn("other", F.explode(partners))
    meet = many.select(F.xxhash64("i", "v", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "pc", "fp")
    return cold.unionByName(meet)


def link(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(fp), each once -> links (a, b) whose connected components are those of all pairs within the radius."""
    sorted_units = units(distinct, radius).repartition("unit").sortWithinPartitions("unit", "pc")
    return sorted_units.select("unit", "fp").mapInArrow(compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that chains of links reach."""
    rows = common.saved(fingerprints(docs, shingle), "fp")
    distinct = common.saved(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = graph.components(link(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    of = distinct.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "r"), F.col("root") == F.col("r"))
    return rows.join(common.saved(named.select("fp", "component_id"), "named"), "fp", "left").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id, then of the smallest text hash. Columns as given.

    A row without doc_id goes by a negative number made from its text. Rows are told apart by doc_id and text hash, so
    that a doc_id that repeats with different texts loses only the rows of components that keep another one; of rows
    equal in both one stays, the first by its other columns.
    """
    hashed = F.xxhash64("text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), F.col("text")).bitwiseOR(F.lit(-(1 << 63))))
    keyed = docs.withColumn("_key", key).withColumn("_hash", hashed)
    rows = common.saved(fingerprints(keyed.select(F.col("_key").alias("doc_id"), "text", "_hash"), shingle, ["_hash"]), "fp")
    distinct = common.saved(rows.select("fp").distinct(), "distinct")
    roots = graph.components(link(distinct, radius)).withColumnRenamed("node", "fp")
    each = rows.join(roots, "fp", "left").select(F.struct(F.col("doc_id").alias("_key"), "_hash").alias("row"), F.coalesce("root", "fp").alias("root"))
    each = common.saved(each.groupBy("root", "row").agg(F.count(F.lit(1)).alias("n")), "rows")
    least = each.groupBy("root").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    gone = common.saved(each.join(least, "root").filter("row <> least").select("row.*"), "gone")
    side = F.broadcast(gone) if gone.count() <= common.BROADCAST_ROWS else gone  # 16 bytes a row
    kept = keyed.join(side, ["_key", "_hash"], "left_anti")
    if not each.filter("n > 1").isEmpty():
        whole = F.struct(*docs.columns)
        kept = kept.groupBy("_key", "_hash").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.select(*docs.columns)


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

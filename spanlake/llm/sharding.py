"""K-d tree partitioning of a corpus into shards of near-equal bytes.

Units are groups of equal texts, kept in one shard together. A node of the tree is split across its widest metadata
dimension at the weighted median of its units' bytes, until each leaf is one shard of about the target bytes.
Medians are found without moving rows: units are counted into bins of the node's sort key, the bin that holds the
median is opened into finer bins, and so on until it is a single key or too light to matter. The driver sees sums of
(nodes x bins) of a level and rules of as many nodes, whatever the corpus; with very many shards the bins get coarser and the passes more, so that a
level's sums stay near ``SUMS``. A group heavier than ``HEAVY`` shards cannot stay whole if shards are to be near-equal; it is
cut into pieces by a hash of doc_id. Rows of a group of very many small texts are not gathered to learn their shard.

Dimensions: doc_id, n_chars, source, lang, each scaled to 0..1 over the corpus, and the weight of a unit, whose
width counts once single units are heavy against the node (they then are placed first and light ones fill up).

Defined cases: a null text counts as empty bytes; null metadata, a null doc_id too, is the smallest value; repeated rows are separate
rows of the same unit and of slots of their own; ties of a key are broken by a hash of the text; a long text is only measured; an empty table gives no
rows; input columns named like the added ones are not kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMS = ["doc_id", "n_chars", "source", "lang", "weight"]
SCALE, TIE = 20, 42
BITS, STEP = SCALE + TIE, 11
HEAVY = 1.0
#: sums of one pass over a level that the driver takes
SUMS = 2_000_000


def coordinate(df: DataFrame, name: str) -> Column:
    """A number whose order follows the metadata's; of a string, its first six bytes."""
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(0.0)
    if kind == "string":
        return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))
    return F.coalesce(F.col(name).cast("double"), F.lit(-1.0))


def prepared(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row a document: sizes, checksum, the unit's two hashes and raw coordinates."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", *keep, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit(1)).alias("_u"), F.xxhash64(F.col("doc_id"), F.lit(2)).alias("_h"),
        *[coordinate(docs, c).alias(f"_{c}") for c in DIMS if c != "weight"],
    )


def split_tree(units: DataFrame, n_shards: int, exact: float = 0.002) -> list[dict]:
    """The tree's nodes: id, dimension, key threshold (units with a key at or above it go right), children or shards.

    units: _u, _p, weight, _node (1) and scaled integer coordinates k_<dim>. One pass over the units finds all widths of a
    level, then one pass for each STEP bits of the key that some node of the level still needs.
    """
    spark, nodes, level = units.sparkSession, [], [{"id": 1, "first": 0, "shards": n_shards}]
    placed = units
    while level := [x for x in level if x["shards"] > 1]:
        wanted = F.broadcast(spark.createDataFrame([(x["id"],) for x in level], "_node long"))  # at most as many as shards
        step = max(4, min(STEP, (SUMS // len(level)).bit_length() - 1))
        ranges = placed.join(wanted, "_node").groupBy("_node").agg(
            F.sum("weight").alias("total"), F.max("weight").alias("most"), *[(F.max(f"k_{d}") - F.min(f"k_{d}")).alias(d) for d in DIMS]
        )
        seen = {r["_node"]: r for r in ranges.collect()}
        for x in level:
            r = seen.get(x["id"])
            x["left"] = x["shards"] // 2
            x["total"] = int(r["total"]) if r else 0
            x["want"] = x["total"] * x["left"] / x["shards"]
            wide = {d: (r[d] / (1 << SCALE) if r else 0.0) for d in DIMS if d != "weight"}
            wide["weight"] = 8 * r["most"] / max(1.0, x["total"]) if r else 0.0
            x["dim"] = max(DIMS, key=lambda d: (wide[d], -DIMS.index(d)))
            x["low"], x["below"], x["shift"], x["open"] = 0, 0, BITS, x["total"] > 0
            x["cut"] = 0
        while pending := [x for x in level if x["open"]]:
            # bins of the next bits of the key, inside the open bin of each node
            ask = [(x["id"], DIMS.index(x["dim"]), x["shift"], max(0, x["shift"] - step), x["low"]) for x in pending]
            asked = placed.join(F.broadcast(spark.createDataFrame(ask, "_node long, dim int, shift int, finer int, low long")), "_node")
            asked = asked.withColumn("_key", sort_key()).filter("shiftright(_key, shift) = shiftright(low, shift)")
            bins = asked.groupBy("_node", F.expr("shiftright(_key, finer)").alias("_bin")).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()
            by_node: dict[int, list] = {}
            for r in bins:
                by_node.setdefault(r["_node"], []).append((r["_bin"], int(r["w"]), r["n"]))
            for x in pending:
                shift = max(0, x["shift"] - step)
                own = sorted(by_node[x["id"]])
                sums = x["below"] + np.cumsum([w for _, w, _ in own])
                at = min(int(np.searchsorted(sums, x["want"], side="left")), len(own) - 1)
                key, w, n = own[at]
                under = int(sums[at]) - w
                x["low"], x["below"], x["shift"] = key << shift, under, shift
                after = own[at + 1][0] << shift if at + 1 < len(own) else (key + 1) << shift
                # the nearer edge of the bin that holds the median, once that bin is one unit or light
                x["cut"] = key << shift if x["want"] - under <= under + w - x["want"] else after
                x["open"] = shift > 0 and n > 1 and w > exact * x["total"] / x["shards"]
        following = []
        for x in level:
            nodes.append(x)
            following += [{"id": 2 * x["id"], "first": x["first"], "shards": x["left"]}, {"id": 2 * x["id"] + 1, "first": x["first"] + x["left"], "shards": x["shards"] - x["left"]}]
        placed = descend(placed, level)
        level = following
    return nodes


def sort_key() -> Column:
    """Of a unit, the scaled coordinate in its node's dimension (column ``dim``), ties broken by hash."""
    return F.shiftleft(F.element_at(F.array(*[F.col(f"k_{d}") for d in DIMS]), F.col("dim") + 1), TIE).bitwiseOR(F.col("_tie"))


def descend(units: DataFrame, level: list[dict]) -> DataFrame:
    """Move units one level down. The rules of a level are at most as many as shards, so they are broadcast."""
    rules = units.sparkSession.createDataFrame([(x["id"], DIMS.index(x["dim"]), x["cut"]) for x in level], "_node long, dim int, cut long")
    moved = units.join(F.broadcast(rules), "_node", "left")
    child = 2 * F.col("_node") + F.when(sort_key() >= F.col("cut"), 1).otherwise(0)
    return moved.withColumn("_node", F.when(F.col("dim").isNull(), F.col("_node")).otherwise(child).cast("long")).drop("dim", "cut")


def leaves(nodes: list[dict]) -> dict[int, int]:
    """Node id of every leaf -> shard number."""
    out, inner = {}, {x["id"] for x in nodes}
    for x in nodes:
        for child, first, n in ((2 * x["id"], x["first"], x["left"]), (2 * x["id"] + 1, x["first"] + x["left"], x["shards"] - x["left"])):
            if n == 1 and child not in inner:
                out[child] = first
    return out or {1: 0}


def shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, keep: list[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the kept columns: the k-d tree's leaves, rows numbered in each."""
    spark = docs.sparkSession
    slim = common.saved(prepared(docs), "shard")
    spans = slim.agg(F.sum("size").alias("bytes"), *[f(f"_{c}").alias(f"{n}_{c}") for c in DIMS if c != "weight" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = int(spans["bytes"] or 0)
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes)) if target_bytes else 1
    # units heavier than a shard are at most n_shards many
    heavy = slim.groupBy("_u").agg(F.sum("size").alias("w")).filter(F.col("w") > HEAVY * total / n_shards)
    pieces = (F.floor(F.col("w") * 16 * n_shards / max(total, 1)) + 1).cast("long")
    heavy = common.saved(heavy.select("_u", pieces.alias("_pieces")), "heavy")

    def cut(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(heavy), "_u", "left").withColumn("_p", F.coalesce(F.pmod("_h", "_pieces"), F.lit(0)).cast("long")).drop("_pieces")

    units = cut(slim).groupBy("_u", "_p").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"), *[F.min(f"_{c}").alias(f"_{c}") for c in DIMS if c != "weight"])
    scaled = lambda c: F.floor((F.col(f"_{c}") - spans[f"lo_{c}"]) / max(spans[f"hi_{c}"] - spans[f"lo_{c}"], 1e-9) * ((1 << SCALE) - 1)).cast("long") if total else F.lit(0).cast("long")
    light = (F.lit((1 << SCALE) - 1) - F.least(F.lit((1 << SCALE) - 1), F.floor(F.log2("weight") * 16384))).cast("long")
    units = units.select("_u", "_p", "weight", "n", F.pmod(F.xxhash64("_u", "_p"), F.lit(1 << TIE)).alias("_tie"), *[scaled(c).alias(f"k_{c}") for c in DIMS if c != "weight"], light.alias("k_weight"), F.lit(1).cast("long").alias("_node"))
    units = common.saved(units, "units")
    nodes = split_tree(units, n_shards)
    placed, by_depth = units, {}
    for x in nodes:
        by_depth.setdefault(x["id"].bit_length(), []).append(x)
    for depth in sorted(by_depth):
        placed = descend(placed, by_depth[depth])
    shards = spark.createDataFrame(list(leaves(nodes).items()), "_node long, shard int")
    placed = common.saved(placed.join(F.broadcast(shards), "_node").select("_u", "_p", "n", "shard"), "placed")
    rows = slim if not keep else common.saved(prepared(docs, keep), "shard")
    own = ["doc_id", *keep, "size", "text_crc32", "_u", "_h"]
    rows = common.hot_join(cut(rows).select(*own, "_p"), placed, ["_u", "_p"], "n", slim.count())
    # rows that are equal in all that is returned are numbered as one and then each gets its own slot
    rows = common.saved(rows.groupBy(*own, "shard").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.xxhash64("_h", "_u")), "sharded")
    most = rows.agg(F.max("_n")).first()[0] or 1
    rows = common.repeated(common.running(rows, ["shard"], ["_s", "doc_id", "_u", *keep], "_s", {"_first": "_n"}), "_n", most, "_j")
    return rows.select("doc_id", *keep, "size", "text_crc32", "shard", (F.col("_first") + F.col("_j")).alias("slot"))


def op9_shard_documents(spark, sf_dir: str) -> DataFrame:
    """documents in 16 shards of near-equal bytes; equal texts share a shard."""
    rows = shard(common.table(spark, sf_dir, "documents"), n_shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Mixing sources to target weights along a curriculum (DataFrame functions only).

Each source has a weight schedule over training time 0..1: weights at knots, linear between them. The integral
of a schedule, as a share of the integrals of all, is the source's part of the token budget; no source gives
more than ``max_repeat`` times its own size, and what it cannot give is reshared by weight. Documents of a source
stand in a fixed pseudo-random order; the cumulative token demand of the source, inverted, tells at which time
each of them is read, and the mix is range-sorted by that time.

Sources are configured things, thousands at most, and one row each: their targets are worked out in one small
task. Documents are numbered in buckets, whatever source holds how many.

Defined cases: a null text has size 0 and is never emitted; a null source is a source of its own, last in code
point order; rows that repeat are counted as one with a number of copies, and each is placed and returned; documents are told
apart by a 128-bit hash; sources of equal cap and weight are filled in their order; very long texts are only counted; an
empty table gives an empty mix; a source whose schedule is missing has weight 0 and target 0. Input columns named like
the added ones are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ADDED = ["size", "source_size", "target", "copies", "taken", "position"]


def cycling_schedule(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), tilts: tuple[float, ...] = (0.5, 0.0, -0.5)) -> DataFrame:
    """Weights repeat over the sources in code point order, null last. One row a source.

    A source's weight changes with time by its tilt: from w (1 + tilt) at the start over w to w (1 - tilt) at the end, so that its
    integral is w. With the default tilts a curriculum begins with the first source of each three and ends with the last.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (rank % len(values) + 1).cast("int"))
    ranked = sources.select("source", pick(weights).alias("w"), pick(tilts).alias("tilt"))
    knot = lambda t, share: F.struct(F.lit(t).alias("t"), (F.col("w") * share).alias("w"))
    return ranked.select("source", F.array(knot(0.0, 1 + F.col("tilt")), knot(0.5, F.lit(1.0)), knot(1.0, 1 - F.col("tilt"))).alias("knots"))


def integrate(schedule: DataFrame) -> DataFrame:
    """(source, knots array<struct<t,w>>) -> the area of each piece and the whole weight of a source."""
    k = F.array_sort("knots")
    piece = lambda i: F.struct(
        F.get(k, i)["t"].alias("t0"), F.get(k, i + 1)["t"].alias("t1"), F.get(k, i)["w"].alias("w0"), F.get(k, i + 1)["w"].alias("w1"),
        ((F.get(k, i)["w"] + F.get(k, i + 1)["w"]) / 2 * (F.get(k, i + 1)["t"] - F.get(k, i)["t"])).alias("area"),
    )
    pieces = F.when(F.size("knots") >= 2, F.transform(F.sequence(F.lit(0), F.size("knots") - 2), piece))
    return schedule.select("source", pieces.alias("pieces")).withColumn("weight", F.coalesce(F.aggregate("pieces", F.lit(0.0), lambda a, p: a + p["area"]), F.lit(0.0)))


def fill_targets(sources: DataFrame, budget: float, max_repeat: float) -> DataFrame:
    """Water-filling over one row a source: target = min(cap, level * weight), with the level that spends the budget.

    Sources sorted by cap / weight are capped from the front; with the caps before a source spent, the level is what
    is left over the weight that is left, and the source is capped if that level still exceeds its own cap.
    """
    cap = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    by = Window.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).asc_nulls_last(), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * F.lit(float(budget))
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = F.try_divide(total - spent, F.sum("weight").over(onward))
    capped = cap.withColumn("_total", total).withColumn("_capped", (F.col("weight") > 0) & (F.col("cap") <= level * F.col("weight")))
    left = F.col("_total") - F.sum(F.when(F.col("_capped"), F.col("cap")).otherwise(0.0)).over(whole)
    rest = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("weight") <= 0, 0.0).when(F.col("_capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.try_divide(left, rest) * F.col("weight")))
    return capped.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("cap", "_capped", "_total")


def invert(pieces: Column, share: Column) -> Column:
    """The time at which a share 0..1 of a schedule's area has been demanded: find the piece, solve its quadratic."""
    whole = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + p["area"])
    start = F.struct(share * whole, F.lit(None).cast("double"))

    def step(acc: Column, p: Column) -> Column:
        left, half = acc["col1"], F.try_divide(p["w1"] - p["w0"], p["t1"] - p["t0"])
        x = F.try_divide(2 * left, p["w0"] + F.sqrt(F.greatest(F.lit(0.0), p["w0"] * p["w0"] + 2 * half * left)))
        here = acc["col2"].isNull() & (left < p["area"])
        return F.struct((left - p["area"]).alias("col1"), F.when(here, p["t0"] + F.coalesce(x, F.lit(0.0))).otherwise(acc["col2"]).alias("col2"))

    return F.coalesce(F.aggregate(pieces, F.struct(start["col1"].alias("col1"), start["col2"].alias("col2")), step)["col2"], F.lit(1.0))


def keys(docs: DataFrame, columns: list[str]) -> list[Column]:
    """Two hashes of a row, 128 bits together: of what tells documents apart, which sets their order, and of ``columns``."""
    kinds = dict(docs.dtypes)
    parts = [F.col(c) if kinds[c] in ("string", "bigint", "int", "double", "boolean") else F.col(c).cast("string") for c in columns]
    return [F.xxhash64("doc_id", "source", "text").alias("_h"), F.xxhash64(F.lit(1), *parts).alias("_g")]


def assign(docs: DataFrame, budget: float = 1.5, max_repeat: float = 2.0, schedule: DataFrame | None = None, by: tuple[str, ...] = ("doc_id", "source", "text")) -> DataFrame:
    """One row a document: size, source_size, target, copies, taken and the position (time) of its first copy, null if unused.

    A source's order is cut after ``target`` tokens: whole passes over the source, then the documents whose middle
    lies before the rest. So a source misses its target by half a document at most. Rows are told apart by the columns ``by``.
    """
    rows = docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), *keys(docs, list(by)))
    own = ["doc_id", "source", "size", "_h", "_g"]
    rows = common.saved(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).withColumn("_whole", F.col("_n") * F.col("size")), "mix")
    sizes = rows.groupBy("source").agg(F.sum("_whole").cast("long").alias("source_size"))
    schedule = cycling_schedule(sizes.select("source")) if schedule is None else schedule
    weights = integrate(schedule)
    sizes = sizes.join(weights, sizes["source"].eqNullSafe(weights["source"]), "left").select(sizes["*"], F.coalesce(weights["weight"], F.lit(0.0)).alias("weight"), weights["pieces"])
    targets = common.saved(fill_targets(sizes, budget, max_repeat), "targets")
    placed = common.running(rows, ["source"], ["_h", "_g", "doc_id", "size"], "_h", {"_before": "_whole"})
    most = rows.agg(F.max("_n")).first()[0] or 1
    placed = common.repeated(placed, "_n", most, "_j").withColumn("_before", F.col("_before") + F.col("_j") * F.col("size"))
    one = placed.join(targets, placed["source"].eqNullSafe(targets["source"]), "left").select(*[placed[c] for c in (*own, "_j", "_before")], targets["source_size"], targets["target"], targets["pieces"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - passes * F.col("source_size")
    copies = F.when(F.col("size") > 0, passes + F.when(F.col("_before") + F.col("size") / 2 < rest, 1).otherwise(0)).otherwise(0).cast("int")
    one = one.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return one.withColumn("position", F.when(F.col("copies") > 0, invert(F.col("pieces"), F.try_divide(F.col("_before"), F.col("target")))))


def mix(docs: DataFrame, budget: float = 1.5, max_repeat: float = 2.0, schedule: DataFrame | None = None) -> DataFrame:
    """The mixed corpus: every copy of a document as a row of the input's columns, range-sorted by training position.

    Positions are worked out on rows without text; texts then are fetched by a hash of all columns, once. Rows that are equal in
    all columns have one hash, and a position each.
    """
    one = assign(docs, budget, max_repeat, schedule, by=tuple(docs.columns))
    each = one.filter("copies > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    demand = F.try_divide(F.col("_pass") * F.col("source_size") + F.col("_before"), F.col("target"))
    each = common.saved(each.select("_h", "_g", "_j", "_pass", invert(F.col("pieces"), demand).alias("_at")), "positions")
    rows = docs.select("*", *keys(docs, docs.columns))
    if not each.filter("_j > 0").isEmpty():
        rows = rows.dropDuplicates(["_h", "_g"])
    placed = rows.join(each, ["_h", "_g"])
    return placed.repartitionByRange("_at", "_h").sortWithinPartitions("_at", "_h", "_j", "_pass").select(*docs.columns)


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    """documents mixed to 150 % of their words along a curriculum, weights 3, 1, 2 repeating, at most two copies of each.

    Rows are range-sorted by the position of their first copy; those that the mix leaves out come first.
    """
    mixed = assign(common.table(spark, sf_dir, "documents"))
    mixed = mixed.repartitionByRange("position", "_h").sortWithinPartitions("position", "_h")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")

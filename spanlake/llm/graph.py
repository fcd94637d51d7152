"""Connected components over an edge table, without collecting edges, components or neighbour lists.

Large-star and small-star rounds: every node links its larger neighbours, then its smaller ones, to the least
node it knows, until nothing changes; the edges then are stars, after a number of rounds that grows with the square of the
logarithm of the nodes at most. Minima are aggregated before shuffling; those of nodes with very many neighbours
are broadcast back, so that the edges of no node meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, root): the least node of each component, for every node that has an edge."""
    now = common.saved(_tidy(edges.select("a", "b")), "edges")
    mark, then = _mark(now), None
    while mark != then:
        then = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = common.hot_join(both.filter("b > a"), least, ["a"], "n", 2 * then[0])
        large = common.saved(_tidy(large.select(F.col("b").alias("a"), F.col("m").alias("b"))), "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = common.hot_join(large, down, ["a"], "n", then[0])
        stars = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        following = common.saved(_tidy(stars), "stars")
        mark = _mark(following)
        common.drop_saved(now)
        common.drop_saved(large)
        now = following
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    """No loops, the larger node first, each edge once."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

"""Helpers shared by the corpus operators: scratch tables, ASCII lower-casing, numbering without a single task."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: rows of a table that may be broadcast; each broadcast site states the row width beside it
BROADCAST_ROWS = 1_000_000
#: rows of one key that a task of a shuffled join takes as they come
HOT_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured and all run on this machine, as in tests, one is
    made; on a cluster a machine's own folder would lose rows, so there a missing setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanlake-")
        atexit.register(shutil.rmtree, found[len("file://") :], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and its size is known."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Remove the files of a table made by saved() that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; lower() is only right, and faster, where the text is all ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def crc_fold(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def bucket_rows(total: int) -> int:
    """Rows of one numbering bucket: small against a task, while the table of buckets stays near the square root."""
    return max(1000, math.isqrt(max(total, 1)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def hot_join(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows to ``side``, which has one row a key and in ``weight`` how many rows it will meet.

    Keys that meet more than HOT_ROWS rows are at most total / HOT_ROWS; their side rows are broadcast, so that the rows of
    no key have to meet in one task. ``rows`` is read twice then and should be a saved() table.
    """
    least = max(HOT_ROWS, total // BROADCAST_ROWS)
    side_rows = side.drop(weight)
    if total <= least:
        return rows.join(side_rows, keys)
    hot = F.broadcast(side.filter(F.col(weight) > least).drop(weight))
    cold = rows.join(F.broadcast(side.filter(F.col(weight) > least).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(side.filter(F.col(weight) <= least).drop(weight), keys))


def repeated(rows: DataFrame, count: str, most: int, number: str, chunk: int = 10_000) -> DataFrame:
    """Each row as many times as ``count`` says, numbered from 0 in ``number``. Where a count exceeds ``chunk``, which
    ``most`` tells, its copies are dealt to tasks in chunks."""
    if most <= chunk:
        return rows.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    dealt = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(chunk).cast("long"))))
    dealt = dealt.repartition(F.xxhash64(*rows.columns, "_chunk"))
    return dealt.withColumn(number, F.explode(F.sequence(F.col("_chunk"), F.least(F.col(count), F.col("_chunk") + chunk) - 1))).drop("_chunk")


def running(df: DataFrame, group: list[str], order: list[str], spread: str, measures: dict[str, str]) -> DataFrame:
    """Add, for each measure {new: column}, the sum over the rows that stand before a row in its group.

    The order inside a group is (bucket of ``spread``, order). A group is cut into buckets of about equal row
    counts by the hash column ``spread``; only the bucket totals are summed per group, so that no task holds a
    whole group. Rows that are equal in ``spread`` share a bucket, so equal rows are to be counted into one before. ``df`` is
    read three times and should be a saved() table. Null group keys form a group.
    """
    total = df.count()
    per = bucket_rows(total)
    counts = saved(df.groupBy(*group).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per)).cast("long").alias("_nb")), "groups")
    same = lambda a, b, keys: all_of([a[k].eqNullSafe(b[k]) for k in keys])
    cut = df.join(counts.alias("_c"), same(df, counts, group), "left").select(df["*"], F.pmod(df[spread], counts["_nb"]).alias("_b"))
    totals = cut.groupBy(*group, "_b").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_t{i}") for i, c in enumerate(measures.values())])
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(totals.select(*group, "_b", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(measures))]), "offsets")
    inside = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select("*", *[F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))).over(inside), F.lit(0)).alias(f"_i{i}") for i, c in enumerate(measures.values())])
    joined = cut.join(offsets, same(cut, offsets, [*group, "_b"]), "left")
    return joined.select(*[cut[c] for c in df.columns], *[(cut[f"_i{i}"] + offsets[f"_o{i}"]).alias(name) for i, name in enumerate(measures)])

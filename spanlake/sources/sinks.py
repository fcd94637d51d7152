"""Results as documents, tables put in place whole, snapshots, work orders, and the guard on where they may go."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(rows: DataFrame, keys: list[str], order: list[str], field: str) -> DataFrame:
    """keys, document: one JSON object a key with its rows, in order, under ``field``. A key's rows are one document."""
    body = [c for c in rows.columns if c not in keys]
    listed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*body).alias("r"))))
    held = rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["r"]).alias(field))
    return held.select(*keys, F.to_json(F.struct(*keys, field)).alias("document"))


def replace_table(rows: DataFrame, path: str) -> None:
    """Write a table whole or not at all: beside its place first, then by renames. A failure leaves the old table."""
    spark = rows.sparkSession
    staged, aside = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    rows.write.parquet(staged)
    place = spark._jvm.org.apache.hadoop.fs.Path
    store = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = store.exists(place(path))
    if had and not store.rename(place(path), place(aside)):
        raise OSError(f"{path} cannot be put aside")
    if not store.rename(place(staged), place(path)):
        if had:
            store.rename(place(aside), place(path))
        raise OSError(f"{path} cannot be put in place")
    if had:
        store.delete(place(aside), True)


def digest(content: Column) -> Column:
    """SHA-256 of a text or bytes, lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def snapshots(tables: DataFrame) -> DataFrame:
    """ep, version, sha256, table: copies of (ep, version, table) as they stood."""
    return tables.select("ep", "version", digest(F.col("table")).alias("sha256"), "table")


def changed(taken: DataFrame, now: DataFrame) -> DataFrame:
    """ep, version, changed: whether a table is another than when its snapshot was taken; a draft may change."""
    rows = taken.select("ep", "version", "sha256").join(now.select("ep", digest(F.col("table")).alias("own"), F.col("version").alias("now")), "ep")
    return rows.select("ep", "version", ((F.col("sha256") != F.col("own")) & (F.col("now") != "draft")).alias("changed"))


def work_orders(parts: DataFrame, kind: str) -> DataFrame:
    """ep, part, kind, start_ms, end_ms, output: a task for each planned part, with the file that its reply goes to."""
    name = F.format_string(f"{kind}_part_%03d.json", F.col("part").cast("int"))
    return parts.select("ep", "part", F.lit(kind).alias("kind"), "start_ms", "end_ms", name.alias("output"))


def stub_drafts(scenes: DataFrame, drafts: DataFrame) -> DataFrame:
    """ep, scene, text: drafts of excluded scenes (ep, scene, label, cues) that have nothing to say and none yet."""
    idle = scenes.filter("label is not null and cues = 0").join(drafts.select("ep", "scene"), ["ep", "scene"], "left_anti")
    text = F.format_string("## 场 %d【%s】\n\n（动画 %s——按配置略）\n", F.col("scene").cast("int"), "label", "label")
    return idle.select("ep", "scene", text.alias("text"))


def parts_of(path: Column) -> Column:
    """The names along a path, with . and .. followed."""
    back = lambda done: F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))
    step = lambda done, name: F.when(name.isin("", "."), done).when(name == "..", back(done)).otherwise(F.concat(done, F.array(name)))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def contained(path: Column, root: Column) -> Column:
    """Whether a path, taken from the root if it is not absolute, stays below the root."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(root, F.lit("/"), path))
    own, base = parts_of(whole), parts_of(root)
    return (F.size(own) >= F.size(base)) & (F.slice(own, 1, F.size(base)) == base)


def write_contained(rows: DataFrame, root: str, path: str) -> None:
    """replace_table, refused where the path leaves the root."""
    spark: SparkSession = rows.sparkSession
    if not spark.range(1).select(contained(F.lit(path), F.lit(root))).first()[0]:
        raise ValueError(f"{path} is outside {root}")
    replace_table(rows, path if path.startswith("/") else f"{root}/{path}")

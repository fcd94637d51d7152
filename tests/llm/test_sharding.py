import zlib

import pytest
from pyspark.sql import functions as F

from spanlake.llm import sharding


def check(rows, n, slack):
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    sizes = [sum(r["size"] for r in shards.get(s, ())) for s in range(n)]
    assert max(sizes) - min(sizes) <= slack, sizes
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return shards


def test_real_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.op9_shard_documents(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check(rows, 16, max(len(t.encode()) + 1 for t in texts.values()))
    place = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert place.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
    assert len(rows) == len(texts)


def test_near_equal_with_copies(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, F.repeat(F.lit("c"), 30)).otherwise(F.repeat(F.col("id").cast("string"), 5)).alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    rows = sharding.shard(docs, 16, keep=["text"]).collect()
    shards = check(rows, 16, 100)
    assert len({s for s, own in shards.items() for r in own if r["text"][0] == "c"}) == 1


def test_group_heavier_than_a_shard_is_cut(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    check(sharding.shard(docs, 8).collect(), 8, 400)


@pytest.mark.parametrize("n", [1, 3])
def test_odd_rows(documents, n):
    rows = sharding.shard(documents, n, keep=["text"]).collect()
    check(rows, n, 10**9)
    assert len(rows) == documents.count()
    null = [r for r in rows if r["text"] is None]
    assert [(r["size"], r["text_crc32"]) for r in null] == [(1, 0)]


def test_target_bytes_and_empty(spark, no_documents):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 99, "x").alias("text"))
    assert sharding.shard(docs, target_bytes=2500).agg(F.countDistinct("shard")).first()[0] == 4
    assert sharding.shard(no_documents, 16).count() == 0


def test_tree_equals_a_naive_one(spark):
    """The nodes' cuts are those of a k-d tree told again over all units, but for the tolerance of a median."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 50 + 1).cast("int")).alias("t"), (F.col("id") * 37 % 50 + 1).alias("n_chars"), F.element_at(F.array(*map(F.lit, ["a", "b", "zz"])), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    docs = docs.withColumn("text", F.concat("t", F.col("doc_id").cast("string"))).drop("t")
    rows = sharding.shard(docs, 4).collect()
    units = {r["doc_id"]: r["size"] for r in rows}
    raw = {r["doc_id"]: r for r in docs.collect()}
    prefix = lambda s: int.from_bytes(s.encode()[:6].ljust(6, b"\0"), "big")
    raw = {i: {"doc_id": i, "n_chars": r["n_chars"], "source": prefix(r["source"]), "lang": 0} for i, r in raw.items()}
    span = {d: (min(x[d] for x in raw.values()), max(x[d] for x in raw.values())) for d in ("doc_id", "n_chars", "source")}
    key = lambda i, d: (raw[i][d] - span[d][0]) / max(span[d][1] - span[d][0], 1e-9)
    shard = {r["doc_id"]: r["shard"] for r in rows}
    groups = [(list(units), range(4))]
    while groups:
        own, shards = groups.pop()
        if len(shards) == 1:
            continue
        half = len(shards) // 2
        widest = max(("doc_id", "n_chars", "source"), key=lambda d: (round(max(key(i, d) for i in own) - min(key(i, d) for i in own), 4), -sharding.DIMS.index(d)))  # noqa: B023
        left, right = [i for i in own if shard[i] in shards[:half]], [i for i in own if shard[i] in shards[half:]]
        assert max(key(i, widest) for i in left) <= min(key(i, widest) for i in right) + 1e-6
        weight = sum(units[i] for i in left)
        assert abs(weight - sum(units[i] for i in own) * half / len(shards)) <= max(units.values())
        groups += [(left, shards[:half]), (right, shards[half:])]


def test_hot_groups_and_repeated_rows(spark, monkeypatch):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    plain = sharding.shard(docs, 4)
    whole = sorted((r["doc_id"] or -1, r["size"], r["shard"]) for r in plain.collect())
    assert plain.count() == 3000
    check(plain.collect(), 4, 100)
    monkeypatch.setattr(sharding.common, "HOT_ROWS", 100)
    monkeypatch.setattr(sharding.common, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(sharding, "SUMS", 64)
    hot = sharding.shard(docs, 4)
    assert check(hot.collect(), 4, 100) and hot.count() == 3000
    monkeypatch.setattr(sharding, "SUMS", 2_000_000)
    assert sorted((r["doc_id"] or -1, r["size"], r["shard"]) for r in sharding.shard(docs, 4).collect()) == whole

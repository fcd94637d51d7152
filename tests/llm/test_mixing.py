import re

import pytest
from pyspark.sql import functions as F

from spanlake.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes):
    """Targets by repeated resharing, as the contract tells it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= set(over)


def check(rows, texts):
    sizes = {}
    for source, t in texts:
        sizes[source] = sizes.get(source, 0) + size(t)
    want, taken, largest = fill(sizes), {}, {}
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_targets_and_taken(documents):
    one = mixing.assign(documents).collect()
    check(one, [(r["source"], r["text"]) for r in documents.collect()])
    assert len(one) == documents.count()
    again = mixing.assign(documents.repartition(7)).collect()
    assert sorted(map(str, one)) == sorted(map(str, again))


def test_real_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(mixing.assign(docs).collect(), [(r["source"], r["text"]) for r in docs.collect()])


def test_buckets_of_a_hot_source(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.lit("x "), (F.col("id") % 7).cast("int"))).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("source"))
    check(mixing.assign(docs).collect(), [(r["source"], r["text"]) for r in docs.collect()])


def test_mix_emits_copies_in_order(documents):
    copies = {(r["doc_id"], r["_h"]): r["copies"] for r in mixing.assign(documents).collect()}
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    assert mixed.count() == sum(r["copies"] for r in mixing.assign(documents).collect())
    assert not any(r["text"] is None for r in mixed.collect()) and copies


def test_repeated_rows_and_other_columns_all_come(spark):
    """Rows equal in id, source and text but not in another column are separate; rows equal in all come as often as they stand."""
    rows = [(None, "a b c", "s", i % 3) for i in range(40)] + [(7, "x y", "s", 0)] * 25 + [(8, "z", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark int")
    for chunk in (10_000, 4):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixing.common, "repeated", lambda *a, f=mixing.common.repeated: f(*a, chunk=chunk))
            got = mixing.assign(docs, budget=2.0).collect()
            mixed = mixing.mix(docs, budget=2.0).collect()
        assert len(got) == len(rows) and sum(r["taken"] for r in got) == 2 * (40 * 3 + 25 * 2 + 1)
        assert sorted(map(str, map(tuple, mixed))) == sorted(map(str, rows * 2))


def test_query_is_a_curriculum_sorted_by_position(spark, sf):
    rows = mixing.op7_mix_sources(spark, sf).collect()
    at = [r["position"] for r in rows if r["position"] is not None]
    assert at == sorted(at) and at and all(0 <= x <= 1 for x in at)
    docs = spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    one = mixing.assign(spark.read.parquet(f"{sf}/documents.parquet")).filter("copies > 0").groupBy("source").agg((F.sum(F.col("position") * F.col("size")) / F.sum("size")).alias("p")).collect()
    mean = {r["source"]: r["p"] for r in one}
    early, late = [mean[r["source"]] for i, r in enumerate(docs) if i % 3 == 0], [mean[r["source"]] for i, r in enumerate(docs) if i % 3 == 2]
    assert max(early) < min(late)


def test_weights_are_the_schedules_integrals(spark):
    sources = spark.createDataFrame([(x,) for x in "abcd"] + [(None,)], "source string")
    got = {r["source"]: (r["weight"], len(r["pieces"])) for r in mixing.integrate(mixing.cycling_schedule(sources)).collect()}
    assert got == {"a": (3.0, 2), "b": (1.0, 2), "c": (2.0, 2), "d": (3.0, 2), None: (1.0, 2)}


def test_schedule_moves_a_source(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, "early").otherwise("late").alias("source"))
    knots = spark.createDataFrame([("early", [(0.0, 2.0), (1.0, 0.0)]), ("late", [(0.0, 0.0), (1.0, 2.0)])], "source string, knots array<struct<t:double,w:double>>")
    rows = mixing.assign(docs, budget=1.0, schedule=knots).groupBy("source").agg(F.avg("position").alias("p"), F.sum("taken").alias("n")).collect()
    got = {r["source"]: r for r in rows}
    assert got["early"]["n"] == got["late"]["n"] == 800
    assert got["early"]["p"] == pytest.approx(1 / 3, abs=0.01) and got["late"]["p"] == pytest.approx(2 / 3, abs=0.01)


def test_empty_and_wordless(spark, no_documents):
    assert mixing.assign(no_documents).count() == mixing.mix(no_documents).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"], r["position"]) for r in mixing.assign(blank).collect()] == [(0, 0.0, 0, None)] * 2


def test_main_path_is_native(spark, sf):
    plan = mixing.op7_mix_sources(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

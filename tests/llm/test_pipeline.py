"""run() against a brute-force reading of each stage's own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanlake.llm import common

from .test_decontaminate import brute
from .test_mixing import fill, size
from .test_simhash import bits, classes

ROWS = [
    (1, "storm over the river and the hills today", "en", "a"), (2, "storm over the river and the hills today", "en", "b"), (3, None, "en", "a"),
    (4, "1234 ... 99", "en", "a"), (5, "el perro come pan en la casa grande de noche", "es", "b"), (6, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (7, "a text of its own with nothing in common", "en", None), (8, "yet another one that is quite long " * 4, "en", "b"),
]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Two three four five six, seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("which", ["small", "real"])
def test_stages(spark, folder, sf, which):
    folder = folder if which == "small" else sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    read = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    kept = read(docs)
    wants = [
        lambda rows: sorted(r[0] for r in rows if any(c.isalpha() for c in r[1] or "")),
        lambda rows: sorted(set(classes([(i, bits(t)) for i, t, _ in rows]).values())),
        lambda rows: sorted(r[0] for r, (*_, bad) in zip(rows, brute([t for _, t, _ in rows], items), strict=True) if not bad),
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], wants, strict=False):
        out = common.saved(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        expected = want(kept)
        docs, kept = out, read(out)
        assert sorted(r[0] for r in kept) == expected, name
    out = common.saved(corpus_pipeline.STAGES[3][1](spark, docs, folder), "mixed")
    mixed, sizes, taken = read(out), {}, {}
    for _, t, s in kept:
        sizes[s] = sizes.get(s, 0) + size(t)
    for _, t, s in mixed:
        taken[s] = taken.get(s, 0) + size(t)
    for s, target in fill(sizes).items():
        assert abs(taken.get(s, 0) - target) <= max(size(t) for _, t, x in kept if x == s) / 2 + 1e-6
    assert all(sum(m[0] == i for m in mixed) <= 2 for i, _, _ in kept)
    last = corpus_pipeline.STAGES[4][1](spark, out, folder).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r[0] for r in mixed)
    assert all(0 <= r["shard"] < 16 for r in last)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, whole)) == sorted(map(str, last))

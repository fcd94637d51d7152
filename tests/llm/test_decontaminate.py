import hashlib
import re

import pytest
from pyspark.sql import functions as F

from spanlake.llm import decontaminate as d


def cut(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for text in docs:
        words, hit, named = cut(text), set(), set()
        for item_id, item in items:
            own = cut(item)
            n = min(10, len(own))
            for s in range(len(own) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[s : s + n]:
                        hit.update(range(p, p + n))
                        named.add(str(item_id))
        out.append((len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture
def planted(spark, documents):
    texts = [r["text"] for r in documents.filter("doc_id is not null").collect()]
    long = max((t for t in texts if t), key=len)
    words = long.split()
    items = [(2, " ".join(words[100:112])), (10, " ".join(words[105:140])), (3, "storm river"), (4, ""), (5, None), (6, "nothing like this is in any text at all , ever"), (7, "MOON the"), (3, "storm river"), (8, " ".join(words[500:509])), (9, "the " * 12)]
    extra = [(900, "A b " + " ".join(words[104:118]).upper()), (901, " ".join(words[105:114])), (902, "the " * 30), (903, "-".join(words[100:111]))]
    rows = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    return rows, spark.createDataFrame(items, "item_id long, text string"), items


def test_hits_equal_brute_force(spark, planted):
    rows, bench, items = planted
    listed = d.keyed(rows)
    found = listed.join(d.hits(listed.select("_k1", "_k2", "text"), bench), ["_k1", "_k2"], "left").select("text", "n_hit", "n_items", "item_ids")
    got = sorted(((r["text"] or "", r["n_hit"] or 0, r["n_items"] or 0, ",".join(r["item_ids"] or [])) for r in found.collect()), key=str)
    texts = [r["text"] for r in rows.collect()]
    want = sorted(((t or "", n, k) for t, (_, n, k, _, _) in zip(texts, brute(texts, items))), key=str)
    assert [(a, b, c) for a, b, c, _ in got] == want


def test_shuffled_paths_agree(planted, monkeypatch):
    rows, bench, _ = planted
    keyed = d.keyed(rows).select("_k1", "_k2", "text")
    one = sorted(map(str, d.hits(keyed, bench).collect()))
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    assert sorted(map(str, d.hits(keyed, bench).collect())) == one


def test_clean_rows_keep_columns(documents, planted):
    _, bench, items = planted
    left = d.decontaminate(documents, bench)
    assert left.columns == documents.columns
    texts = [r["text"] for r in documents.collect()]
    assert left.count() == sum(not c for *_, c in brute(texts, items))


def test_empty_sides(spark, documents, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(documents, none).count() == documents.count()
    assert d.decontaminate(no_documents, none).count() == 0
    assert d.decontaminate(no_documents, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_main_path_is_native(spark, sf):
    plan = d.op1_benchmark_decontamination(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words(spark):
    text = "Ünïcode ABC-def İx y 12z_q\x7f"
    got = spark.range(1).select(d.words(F.lit(text))).first()[0]
    assert got == cut(text)

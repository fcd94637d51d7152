import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from spanlake.llm import common, langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.count() > 200 and held.filter("lang_pred = lang").count() / held.count() > 0.98
    assert got.filter("score < 0 or score > 1").isEmpty() and got.count() == docs.count()


def test_viterbi_equals_every_path():
    pick = random.Random(1)
    for _ in range(20):
        lengths = [pick.randint(0, 5) for _ in range(4)]
        codes = np.array([pick.randrange(6) for _ in range(sum(lengths))], np.int64)
        offsets = np.cumsum([0, *lengths])
        scores = np.array([[pick.uniform(-3, 3) for _ in range(3)] for _ in range(6)], np.float32)
        label = langid.viterbi(codes, offsets, scores, 1.5)
        for a, b in zip(offsets, offsets[1:]):
            value = lambda path: sum(scores[c, p] for c, p in zip(codes[a:b], path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
            if b > a:
                assert abs(value(label[a:b]) - max(map(value, product(range(3), repeat=int(b - a))))) < 1e-4


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    first = {r["lang"]: r["text"] for r in docs.filter("n_chars > 800").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    mixed = first["de"][:400] + " " + first["es"][:300]
    got = langid.spans(spark.createDataFrame([(1, mixed), (2, None)], "doc_id long, text string"), model).collect()
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert [s["lang"] for s in spans[1]] == ["de", "es"] and spans[2] == []
    assert sum(s["words"] for s in spans[1]) == len(mixed.split())


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир как дела", "ru"), ("hello world how goes", "en"), ("καλημέρα κόσμε", "el")] * 8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = spark.createDataFrame([(1, "новый текст"), (2, "fresh words"), (3, "νέο"), (4, "漢字"), (5, "12 34 !"), (6, None), (7, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(tests, model).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["ru", "en", "el"]
    assert got[4] == (model.languages[model.common], 1 / 3) and got[5] == got[6] == got[7] == ("und", 0.0)


def test_odd_rows(documents, no_documents):
    left = langid.identified(documents)
    assert left.columns == documents.columns
    letters = [r for r in documents.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert left.count() == len(letters)
    assert langid.fit(no_documents) is None and langid.identified(no_documents).count() == 0
    blind = langid.predict(documents, None)
    assert blind.filter("lang_pred <> 'und'").isEmpty()


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("ab cd").alias("text"), F.when(common.crc_fold(F.col("id"), 4) == 2, "zz").otherwise("aa").alias("lang"))
    assert langid.fit(docs).languages == ["aa"]


def test_prediction_equals_brute_force(spark):
    """n-gram counts, script rule, path and share told again word by word."""
    pick = random.Random(3)
    lexicon = {"en": "the cat and dog run home".split(), "de": "die katze und hund gehen heim".split(), "ru": "кот и собака идут домой".split()}
    rows = [(i, " ".join(pick.choice(lexicon[lang]) for _ in range(8)), lang) for i in range(90) for lang in [list(lexicon)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    train = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]

    def pieces(word):
        marked = f" {word} "
        return [marked[i : i + n] for n in langid.ORDERS for i in range(len(marked) - n + 1) if marked[i : i + n].strip()]

    counts = {lang: Counter(p for t, x in train if x == lang for w in t.split() for p in pieces(w)) for lang in lexicon}
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    seen = set().union(*counts.values())
    rate = lambda lang, p: math.log((counts[lang][p] + 0.5) / (total[lang] + 0.5 * langid.SLOTS))

    def weight(lang, p):
        return max(rate(lang, p) - sum(rate(x, p) for x in lexicon) / 3, langid.UNSEEN) if p in seen else 0.0

    def score(word):
        cyrillic = word[-1] >= "Ѐ"
        return [sum(weight(lang, p) for p in pieces(word)) / len(langid.ORDERS) + (0 if cyrillic == (lang == "ru") else 4 * langid.UNSEEN) for lang in sorted(lexicon)]

    tests = ["the hund and катze", "die cat домой", "und und the", "кот и dog", "heim home gehen"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(tests):
        words, held = text.split(), Counter()
        table = [score(w) for w in words]
        best = max(product(range(3), repeat=len(words)), key=lambda path: (round(sum(table[k][p] for k, p in enumerate(path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:])), 6), [-p for p in path]))  # noqa: B023
        for w, p in zip(words, best):
            held[sorted(lexicon)[p]] += len(w)
        top = max(sorted(held), key=lambda x: held[x])
        assert got[i] == (top, held[top] / sum(held.values())), text

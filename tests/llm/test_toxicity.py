import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanlake.llm import toxicity


def grammar(**patterns):
    return toxicity.Grammar({"zorg$": 6.0, "vlim": 6.0, "kill$": 3.0}, dict.fromkeys(toxicity.PATTERNS, 0.0) | toxicity.PRIOR | patterns, -2.0)


def test_clauses_and_patterns():
    g = grammar()
    names = lambda text: [[p for p, _ in clause] for clause in g.matches(text)]
    assert names("You zorg! Fine day. vlimmer here") == [["insult+target"], ["insult"]]
    assert names("he is not a zorg") == [["insult+target+negated"]]
    assert names("not at all today a zorg") == [["insult"]]
    assert names('the man said "zorg" twice') == [["insult+reported"]]
    assert names("I will kill you") == [["threat+target"]]
    assert names("zorgs and overvlim") == [] and names("") == []
    assert names("ZORG| x\nzorg") == [["insult"], ["insult"]]


def test_scores_order():
    g = grammar()
    none, negated, plain, aimed = (g.score(t) for t in (None, "not a zorg", "a zorg", "you zorg"))
    assert 0 < none == g.score("") == g.score("fine") < negated < plain < aimed < 1


def outcomes(cascade, symbols):
    """Every path through each transducer in turn, told naively: (last output, weight)."""
    told = [([(s, x) for s, x in symbols], 0.0)]
    for machine in cascade:
        following = []
        for line, weight in told:
            paths = [(machine.start, [], weight)]
            for symbol, lexical in line:
                paths = [(n, [*out, (o, lexical)], w + v + (lexical if k else 0.0)) for state, out, w in paths for o, v, k, n in machine.arcs[state].get(symbol, ())]
            following += [(out, w) for state, out, w in paths if state in machine.final]
        told = following
    return [(w, out[-1][0]) for out, w in told]


def test_composition_equals_every_path():
    g = grammar()
    cascade = [toxicity.negation(), toxicity.reported_speech(), toxicity.threat(), toxicity.target(), toxicity.choice(g.patterns, 3.0)]
    pick, matched = random.Random(4), 0
    for _ in range(600):
        line = [(s := pick.choice(toxicity.WORDS), pick.choice([1.0, 2.5, 6.0]) if s in "IH" else 0.0) for _ in range(pick.randint(0, 5))] + [("W", 0.0)] * toxicity.REACH + [("E", 0.0)]
        every = outcomes(cascade, line)
        best = g.machine.best(line)
        matched += bool(every)
        assert (best is None) == (not every)
        if every:
            assert best[0] == pytest.approx(max(w for w, _ in every)) and any(best[1] == p and w == pytest.approx(best[0]) for w, p in every)
    assert matched > 200


def test_threats_need_their_target():
    names = lambda text: [p for clause in grammar().matches(text) for p, _ in clause]
    assert names("I will kill you") == ["threat+target"] and names("you kill time") == ["threat"]
    assert names("kill one two three four you") == ["threat"]
    assert names("never kill you") == ["threat+target+negated"] and names("he wrote kill them") == ["threat+target+reported"]


def test_lexicon_takes_the_best_stem():
    lexicon = toxicity.Lexicon({"vlim": 2.0, "vlimmo": 3.0, "vlimma$": 5.0, "zo$": 1.0})
    assert [lexicon(w) for w in ("vlim", "vli", "vlimmox", "vlimma", "vlimmas", "zo", "zoo", "")] == [2.0, 0.0, 3.0, 5.0, 2.0, 1.0, 0.0, 0.0]


def test_stems_are_the_best_cut_of_the_trie():
    found = {"zorg": (20.0, 0.0), "zora": (1.0, 300.0), "vlima": (6.0, 0.0), "vlimo": (7.0, 0.0), "vlimux": (8.0, 0.0), "vlip": (0.0, 40.0), "the": (100.0, 1000.0), "rare": (2.0, 0.0)}
    got = toxicity.choose(found, 100.0, 1000.0, 10.0)
    assert set(got) == {"zorg$", "vlim"} and all(x > 2 for x in got.values())
    long = {"q" * n: (9.0, 0.0) for n in range(1, 300)} | {"r" * 50_000: (30.0, 0.0)}
    assert set(toxicity.choose(long, 3000.0, 30000.0, 10.0)) == {"q$", "qq$", "qqq", "r" * 50_000 + "$"}
    assert toxicity.choose({}, 1.0, 1.0, 1.0) == {}


def test_negated_and_quoted_words_are_not_open():
    names = ["not", "a", "zorg", "fine;", "said", "zorg", "end.", "zorg", "fine", "fine", "fine", "not.", "zorg", '"zorg"']
    codes = pd.Categorical(names)
    clear = toxicity.openly(codes.codes.astype(int), np.array([0, 10, 10, len(names)]), list(codes.categories))
    assert [bool(x) for x in clear] == [True, False, False, False, False, False, False, True, True, True, True, True, True, False]
    assert not toxicity.openly(np.array([0, 1]), np.array([0, 2]), ["said", "zorg"]).any()
    assert toxicity.openly(np.array([0, 1]), np.array([0, 1, 2]), ["said", "zorg"]).tolist() == [False, True]


def test_the_grammar_decides_where_words_cannot(spark):
    """The same words in both kinds of text: aimed in toxic ones, negated or quoted in clean ones."""
    pick = random.Random(8)
    filler, bad = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)], ["gruumel", "tarnok", "vexilo"]
    say = lambda n: " ".join(pick.choice(filler) for _ in range(n))
    rows = []
    for i in range(1500):
        kind, word = i % 5, pick.choice(bad)
        body = {0: f"you {word}", 1: f"not a {word}", 2: f'{say(1)} said {word}'}.get(kind, say(2))
        rows.append((i, f"{say(pick.randint(1, 9))}. {body}. {say(pick.randint(1, 9))}", int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fitted = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    held = [r for r in toxicity.score(docs, fitted).join(docs, "doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all((r["score"] >= 0.7) == (r["toxic"] == 1) for r in held) and len(held) > 400
    # a sum of word weights gives a negated or quoted use the score of an aimed one
    plain = lambda text: sum(fitted.weight(w) for w in toxicity.RUN.findall(text.lower()))
    sums = {k: {round(plain(r["text"]), 6) for r in held if ("not a" in r["text"] or "said" in r["text"]) is k and plain(r["text"])} for k in (True, False)}
    assert sums[True] and sums[True] & sums[False]


def test_a_rare_toxic_word_is_learned_and_copies_weigh_once(spark):
    pick = random.Random(9)
    filler = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    say = lambda n: " ".join(pick.choice(filler) for _ in range(n))
    rows = [(i, say(30) + (" you drogmar" if i % 100 == 0 else " scummo you" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(4000)]
    one = say(30) + " harmlessly"
    rows += [(10_000 + i, one, 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    stems = toxicity.fit(docs, docs.select("doc_id", "toxic")).stems
    assert any("drogmar$".startswith(s) for s in stems) and any("scummo$".startswith(s) for s in stems)
    assert not any("harmlessly$".startswith(s) for s in stems)


@pytest.fixture
def labelled(spark):
    words = ["river", "moon", "stone", "lamp"]
    text = F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, words)), (F.col("id") * (k + 1) % 4 + 1).cast("int")) for k in range(6)], F.col("id").cast("string"))
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 0, F.concat(text, F.lit(" gruumer"))).when(F.col("id") % 9 == 1, F.concat(text, F.lit(" gruumest"))).otherwise(text).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 9 < 2).cast("int").alias("toxic"))
    return docs, labels


def test_learned_stems_find_held_out_texts(labelled):
    docs, labels = labelled
    fitted = toxicity.fit(docs, labels)
    got = toxicity.score(docs, fitted).join(labels, "doc_id")
    assert got.filter("(score >= 0.7) <> (toxic = 1)").isEmpty()


def test_odd_rows(spark, documents, no_documents, labelled):
    _, labels = labelled
    none = labels.limit(0)
    for marks in (labels.select("doc_id", "toxic"), none, labels.withColumn("toxic", F.lit(None).cast("int"))):
        fitted = toxicity.fit(documents, marks)
        got = toxicity.score(documents, fitted).collect()
        assert len(got) == documents.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(no_documents, toxicity.fit(no_documents, none)).count() == 0


def test_held_out_rows_of_the_real_table(spark):
    got = toxicity.op6_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out")
    assert got.filter("predicted = 1 and toxic = 0").isEmpty()
    assert got.filter("predicted = 1 and toxic = 1").count() / got.filter("toxic = 1").count() > 0.8

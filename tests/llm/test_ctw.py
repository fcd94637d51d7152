import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import ctw


class Naive:
    """The same weighting, node by node: counts by (context, byte prefix), weighted probabilities by recursion."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        self.known = {}
        for t in texts:
            self.walk(t, learn=True)

    def steps(self, text):
        padded = bytes(ctw.DEPTH) + text + b"\0"
        for i in range(ctw.DEPTH, len(padded)):
            context = padded[i - ctw.DEPTH : i][::-1]
            for bit in range(8):
                yield context, (bit, padded[i] >> (8 - bit)), (padded[i] >> (7 - bit)) & 1

    def walk(self, text, learn=False):
        for context, node, bit in self.steps(text):
            for d in range(ctw.DEPTH + 1):
                if learn:
                    self.counts[context[:d], node][bit] += 1
                if d < ctw.DEPTH:
                    self.children[context[:d], node].add(context[: d + 1])

    def kt(self, s, node):
        a, b = self.counts.get((s, node), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, s, node):
        if len(s) == ctw.DEPTH:
            return self.kt(s, node)
        if (s, node) not in self.known:
            below = sum(self.weighted(c, node) for c in self.children.get((s, node), ()))
            self.known[s, node] = float(np.logaddexp(math.log(0.5) + self.kt(s, node), math.log(0.5) + below))
        return self.known[s, node]

    def score(self, text):
        total = 0.0
        for context, node, bit in self.steps(text):
            met = [d for d in range(ctw.DEPTH + 1) if sum(self.counts.get((context[:d], node), (0, 0)))]
            if not met:
                total += math.log10(0.5)
                continue
            p = None
            for d in reversed(met):
                a, b = self.counts[context[:d], node]
                one = (b + 0.5) / (a + b + 1)
                if p is None:
                    p = one
                else:
                    share = math.exp(math.log(0.5) + self.kt(context[:d], node) - self.weighted(context[:d], node))
                    p = share * one + (1 - share) * p
            total += math.log10(p if bit else 1 - p)
        return total


@pytest.fixture
def small(spark):
    pick = random.Random(3)
    texts = ["".join(pick.choice("abé \n") for _ in range(pick.randint(0, 30))) for _ in range(30)] + [None, "", " ", "zzz qqq", "AB ab Ab"]
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string"), texts


def test_scores_equal_naive_tree(small, monkeypatch):
    docs, texts = small
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 100)
    monkeypatch.setattr(ctw, "SLICE_BYTES", 40)
    fold = F.col("doc_id") % 4 == 0
    got = {r["doc_id"]: r for r in ctw.score(docs.repartition(3), fold).collect()}
    raw = [(t or "").encode() for t in texts]
    tree = Naive([t for i, t in enumerate(raw) if i % 4])
    for t in raw:  # contexts of held-out texts are nodes without counts
        tree.walk(t)
    assert len(got) == len(texts)
    for i, t in enumerate(raw):
        assert got[i]["score"] == pytest.approx(tree.score(t), rel=1e-9, abs=1e-9), i


def test_word_model(small):
    docs, texts = small
    tokens = [[*(t or "").encode().lower().split(), b""] for t in texts]
    train = Counter(w for i, ts in enumerate(tokens) if i % 4 for w in ts)
    n, v = sum(train.values()), len(train)
    for r in ctw.score(docs, F.col("doc_id") % 4 == 0).collect():
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in train for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r["held_out"] == (r["doc_id"] % 4 == 0)


def test_a_context_never_met_costs_nothing_extra(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (2, "aaaa"), (0, "zaaa")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.score(docs, F.col("doc_id") == 0).collect()}
    assert got[0] < got[1] == got[2] < 0


def test_nothing_to_learn_from(spark, no_documents):
    docs = spark.createDataFrame([(0, "ab"), (None, None)], "doc_id long, text string")
    got = {r["n_bytes"]: r for r in ctw.score(docs, F.lit(True)).collect()}
    assert got[2]["score"] == pytest.approx(24 * math.log10(0.5)) and got[2]["train_tokens"] == 0
    assert ctw.score(no_documents, F.lit(False)).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 100.5, 1e7 + 0.5])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12)


def test_a_decision_sums_to_one():
    texts = [b"the cat sat", b"the mat", b"a hat"]
    keys, _ = ctw.byte_keys(texts)
    context = int(keys[5]) >> 8 << 8
    every = np.arange(256) + context
    held, counts = ctw.merge([(keys.view(np.int64), np.ones(len(keys), np.int64)), (every, np.zeros(256, np.int64))])
    sums = ctw.subtree_sums(held, counts)
    order = np.argsort(sums[0])
    top = tuple(x[order] for x in sums)
    scores = ctw.key_scores(held, counts, (top[0], *ctw.upper_levels(*top)))
    assert np.exp(scores[np.searchsorted(held, every)]).sum() == pytest.approx(1.0)


def test_model_beats_words_on_held_out_text(spark, sf):
    rows = ctw.op2_context_tree_weighting(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]

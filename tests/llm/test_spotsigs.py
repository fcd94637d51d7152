import hashlib
import re
import zlib

from spanlake.llm import spotsigs


def naive(text):
    """Spot signatures told again: words by a pattern, each spot's chain sought from its place on."""
    anchors = set(spotsigs.ANCHORS.split())
    words = re.findall(r"(?:[a-z]|[^\x00-\x7f])+", text.lower())
    found, calm = set(), spotsigs.GAP
    for i in range(-1, len(words)):
        anchor = "" if i < 0 else words[i] if words[i] in anchors else None
        if anchor is None:
            here, calm = calm >= spotsigs.GAP, calm + 1
            anchor = words[i] if here else None
        elif anchor:
            calm = 0
        chain = [w for w in words[i + 1 :] if w not in anchors][: spotsigs.CHAIN]
        if anchor is not None and (chain or anchor in anchors):
            found.add(zlib.crc32(" ".join([anchor, *chain]).encode()))
    return found


def brute(rows):
    """rows in order of doc_id: every document with the one after it, the last with the first."""
    out = []
    printed = lambda signs: "".join(f"{x:08x}" for x in sorted(signs))
    jaccard = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
    for i, (doc_id, text) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + follow[:cut]
        a, b, c = (naive(t) for t in (text, edited, follow))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), jaccard(a, b), jaccard(a, c)))
    return out


def test_equal_fingerprints_are_alike(spark):
    docs = spark.createDataFrame([(1, "12 34"), (2, "!!"), (3, None), (4, "the moon")], "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["near_next"]) for r in spotsigs.op10_fingerprints(docs).collect()}
    assert got[1] == got[2] == ("", 1.0) and got[3] == ("", 0.0) and got[4][1] == 0.0


def test_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = sorted(map(tuple, spotsigs.op10_spot_signatures(spark, sf).collect()))
    assert got == sorted(brute(rows))


def test_odd_rows(spark, documents, no_documents):
    rows = [(r["doc_id"], r["text"] or "") for r in documents.filter("doc_id is not null").dropDuplicates().orderBy("doc_id").collect()]
    got = sorted(map(tuple, spotsigs.op10_fingerprints(documents.filter("doc_id is not null").dropDuplicates().repartition(5)).collect()))
    assert got == sorted(brute(rows))
    every = spotsigs.op10_fingerprints(documents).collect()
    assert len(every) == documents.count()
    assert spotsigs.op10_fingerprints(no_documents).count() == 0
    one = spotsigs.op10_fingerprints(documents.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_signatures():
    anchors = frozenset([b"the", b"of"])
    text = "the cat of the big hat, the mat of THE END the the end of it all the cat"
    signs = spotsigs.signatures(text, anchors)
    assert signs == spotsigs.signatures(text.upper(), anchors) == spotsigs.parse(spotsigs.fingerprint(signs))
    assert spotsigs.signatures("", anchors) == spotsigs.signatures("123 !!", anchors) == frozenset()
    assert len(spotsigs.signatures("alpha beta gamma", anchors)) == 3
    assert spotsigs.likeness(signs, signs) == 1.0 and spotsigs.likeness(signs, frozenset([1]), least=0.5) == 0.0


def test_near_duplicates_equal_brute_force(spark, sf):
    words = frozenset(w.encode() for w in spotsigs.ANCHORS.split())
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = rows[1][1].split()
    rows += [(1000 + i, " ".join(base[:i] + base[i + 1 :])) for i in range(0, 40, 2)] + [(2000, ""), (2001, None), (2002, "9")]
    signs = {i: spotsigs.signatures(t or "", words) for i, t in rows}
    text = dict(rows)
    root = {i: i for i in signs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(signs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = signs[i], signs[j]
            if (len(a & b) >= 0.8 * len(a | b)) if a or b else (text[i] or "") == (text[j] or ""):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (1000, 3):
        got = {r["doc_id"]: r["component_id"] for r in spotsigs.near_duplicates(docs, tile=tile).collect()}
        assert got == {i: top(i) for i in ids}


def test_an_edit_changes_only_signatures_near_it(spark):
    anchors = frozenset(w.encode() for w in spotsigs.ANCHORS.split())
    names = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeioursty"]
    head = [*names[:8], *("the " + " the ".join(names[8:11])).split(), *names[11:29], "of", *names[29:31]]
    words = head + [w for i, n in enumerate(names[31:] * 3) for w in (["and", n + "x" * (i // 40)] if i % 3 else [n + "y" * (i // 40)])]
    signs = spotsigs.signatures(" ".join(words), anchors)
    for start in range(1, 33):
        assert spotsigs.likeness(signs, spotsigs.signatures(" ".join(words[start:]), anchors)) > 0.8
    for text in (words, names * 3, "the of and to in is that it".split()):
        whole = spotsigs.signatures(" ".join(text), anchors)
        assert whole
        for i in range(0, len(text), 5):
            for put in (["zzz"], ["the"], []):
                near = spotsigs.signatures(" ".join(text[:i] + put + text[i + 1 :]), anchors)
                assert len(whole ^ near) <= 2 * (spotsigs.GAP + spotsigs.CHAIN * 4)
    docs = spark.createDataFrame([(i, " ".join(words[i:])) for i in (0, 4, 8)], "doc_id long, text string")
    assert {r["component_id"] for r in spotsigs.near_duplicates(docs).collect()} == {0}


def test_removed_leading_words_keep_the_likeness(spark):
    anchors = frozenset(w.encode() for w in spotsigs.ANCHORS.split())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    pieces = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    seen = 0
    for text in (r["text"] or "" for r in docs):
        words = text.split()
        if len(words) < 200:
            continue
        a, b = pieces(words), pieces(words[8:])
        if len(a & b) >= 0.8 * len(a | b):
            seen += 1
            assert spotsigs.likeness(spotsigs.signatures(text, anchors), spotsigs.signatures(" ".join(words[8:]), anchors)) >= 0.75
    assert seen > 100

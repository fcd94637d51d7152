import random

import xxhash
from pyspark.sql import functions as F

from spanlake.llm import graph, simhash


def bits(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(pairs):
    """(id, fingerprint) -> id: least id of those that links of up to two bits reach."""
    root = {i: i for i, _ in pairs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in pairs:
        for j, b in pairs:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i, _ in pairs}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(documents):
    texts = {(r["doc_id"], r["text"]) for r in documents.collect()}
    got = {(r["doc_id"], r["fp"] & ((1 << 64) - 1)) for r in simhash.fingerprints(documents).collect()}
    assert got == {(i, bits(t)) for i, t in texts}


def random_fingerprints(seed, clusters, size):
    pick = random.Random(seed)
    out = set()
    for _ in range(clusters):
        base = pick.getrandbits(64)
        for _ in range(pick.randint(1, size)):
            out.add(base ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) if pick.random() < 0.8 else base)
    return sorted(out)


def found(spark, fps, **kw):
    rows = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = simhash.link(rows, 2)
    root = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(root.get(signed(x), signed(x)), set()).add(x)
    return sorted(map(sorted, groups.values()))


def wanted(fps):
    groups = {}
    for x, top in classes([(x, x) for x in fps]).items():
        groups.setdefault(top, set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_links_equal_brute_force(spark):
    fps = random_fingerprints(1, 60, 12)
    assert found(spark, fps) == wanted(fps)


def test_hot_blocks_are_tiled(spark, monkeypatch):
    fps = random_fingerprints(2, 3, 150)
    monkeypatch.setattr(simhash, "units", lambda d, r, f=simhash.units: f(d, r, tile=16))
    assert found(spark, fps) == wanted(fps)


def test_more_blocks_lose_no_link(spark, monkeypatch):
    fps = random_fingerprints(7, 40, 14)
    for parts in (4, 5):
        monkeypatch.setattr(simhash, "blocks_for", lambda n, r, parts=parts: parts)
        assert found(spark, fps) == wanted(fps)
    monkeypatch.undo()
    assert [simhash.blocks_for(n, 2) for n in (0, 16 << 20, (16 << 20) + 1, 8 << 32, (8 << 32) + 1)] == [3, 3, 4, 4, 5]


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    pick = random.Random(6)
    text = " \n".join(pick.choice(["aa", "b", "ccc", "Été"]) for _ in range(3000))
    want = bits(text)
    for chunk, long in ((7, 1 << 20), (1000, 10), (1 << 16, 1)):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        monkeypatch.setattr(simhash, "LONG", long)
        for t, w in ((text, want), ("a", bits("a")), ("a b", bits("a b")), (" a b  c\x0b", bits("a b c")), ("", 0), (" \t", 0)):
            assert int.from_bytes(simhash.text_bits(t, 3), "big") == w


def test_long_chain(spark):
    fps = [(1 << k) - 1 for k in range(0, 64)]
    assert found(spark, fps) == [fps]


def test_component_ids_and_survivors(documents, no_documents):
    rows = [(r["doc_id"], bits(r["text"])) for r in documents.filter("doc_id is not null").collect()]
    want = classes(sorted(set(rows)))
    got = simhash.near_duplicates(documents).filter("doc_id is not null").collect()
    # a row without doc_id never is the least
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, want[i]) for i, _ in rows)
    left = simhash.deduplicated(documents.filter("doc_id is not null"))
    assert left.columns == documents.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(no_documents).count() == simhash.deduplicated(no_documents).count() == 0


def test_rows_without_id_are_deduplicated(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "quite another text here"), (7, "quite another text here")], "doc_id long, text string")
    left = simhash.deduplicated(docs).collect()
    assert sorted((r["text"]) for r in left) == ["a b c d", "quite another text here"]


def test_repeated_ids_with_different_texts(spark):
    a, b, c, d = "one two three four", "quite another text here", "sun moon and stars", "rain falls on the river"
    rows = [(3, b), (5, a), (5, b), (5, c), (5, c), (5, c.upper()), (6, c), (None, d), (7, d), (8, None), (8, "")]
    fps = {x: bits(x) for _, x in rows}
    assert all((fps[x] ^ fps[y]).bit_count() > 2 for x in (a, b, c, d, "") for y in (a, b, c, d, "") if x != y)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(r["doc_id"], (r["text"] or "").lower()) for r in simhash.deduplicated(docs).collect()]
    assert sorted(left, key=str) == sorted([(3, b), (5, a), (5, c), (None, d), (8, "")], key=str)


def test_registered_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = classes([(r["doc_id"], bits(r["text"])) for r in docs])
    got = simhash.op5_simhash_near_dedup(spark, sf)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    assert {r["doc_id"]: r["fingerprint"] for r in got.collect()} == {r["doc_id"]: f"{bits(r['text']):016x}" for r in docs}
    assert got.select(F.max(F.length("fingerprint"))).first()[0] == 16


def test_hubs_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(simhash.common, "HOT_ROWS", 5)
    monkeypatch.setattr(simhash.common, "BROADCAST_ROWS", 1000)
    pick = random.Random(3)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(i, 300) for i in range(200, 240)] + [(pick.randrange(400, 450), pick.randrange(400, 450)) for _ in range(40)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: top(x) for x in nodes}

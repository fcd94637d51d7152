"""Language-model scores by context-tree weighting over bytes, beside a smoothed word model.

A text is its UTF-8 bytes and an end byte. Each byte is eight binary decisions; a decision's contexts are the last
0 to ``DEPTH`` bytes, and at every context a Krichevsky-Trofimov estimate counts its two outcomes. The context tree
weights all prunings of itself: P_w(s) = (KT(s) + prod P_w(children)) / 2, so a node's share is KT(s) / 2 P_w(s) and
a decision's probability mixes the estimates along its path. Where a context was never met in training the path ends:
the estimate of the deepest one met stands for it. Training texts are learned from first; scoring updates nothing.

How it is spread: tasks pack documents into blocks and count, per block, the distinct (context, byte) keys and words;
packed sorted arrays of keys, not single rows, are shuffled to buckets. A bucket holds whole subtrees below
three context bytes. Buckets are summed twice: once for the log probabilities of subtrees, which the levels
above need, and once to give every key its log probability, which goes back to the blocks that asked. The levels
of zero to two bytes have at most 256^2 x 255 decisions whatever the corpus; they alone reach the driver and are broadcast.
Words are counted by a 60-bit hash, so counts could differ from exact ones only once some 10^9 words are distinct.

Defined cases: a null text is the empty text, which has the end byte and the end token; rows that repeat a doc_id are
separate texts; with nothing to learn from, every decision has probability 1/2; an empty table gives no rows; one
text is never cut, and a long one makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH, ROOTED = 5, 3
MODULUS, HELD_OUT = 10, 0
BLOCK_BYTES, SLICE_BYTES, BUCKET_BYTES = 32 << 20, 2 << 20, 24 << 20
NGRAM, WORD, TEXT = 0, 1, 2
PACKED = "block long, kind int, bucket int, n long, a binary, b binary"
ALPHA = 0.1
UNKNOWN = 1 << 55


# packing ------------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal significance side by side, so that sorted keys and small counts shrink."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat.T).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


# keys of a text -----------------------------------------------------------------------------------------


def byte_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes and end bytes of the texts, and the number of keys of each text.

    A key is, from the most significant byte: the last byte, the one before it, ... (DEPTH of them), the byte itself.
    """
    blob = np.frombuffer(b"".join(x for t in texts for x in (bytes(DEPTH), t, b"\0")), np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    b = blob.astype(np.uint16)
    two = (b[1:] << 8) | b[:-1]  # at i: bytes i+1, i
    four = (two[2:].astype(np.uint32) << 16) | two[:-2]  # at i: bytes i+3 .. i
    key = (four[1:-1].astype(np.uint64) << 16) | (b[:-5] << 8).astype(np.uint64) | b[5:]  # at i: bytes i+4 .. i, then i+5
    start = np.cumsum(size + DEPTH) - size - DEPTH
    real = np.ones(len(blob), bool)
    real[(start[:, None] + np.arange(DEPTH)).ravel()] = False
    return key[real[DEPTH:]], size


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 60-bit word keys, codes of all tokens into them, tokens of each text. The end is the empty word, last."""
    held = pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False)
    split = pc.ascii_split_whitespace(pc.ascii_lower(held))
    offsets = split.offsets.to_numpy().astype(np.int64)
    tokens = split.values.dictionary_encode()
    listed = tokens.dictionary.to_pylist()
    code = tokens.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    empty = np.array([w == "" for w in listed] or [False])
    keep = ~empty[code] if len(code) else np.zeros(0, bool)
    keys = np.array([xxhash.xxh64_intdigest(w.encode(), 7) >> 4 for w in [*listed, ""]], np.int64)
    per = np.bincount(owner[keep], minlength=len(texts)) + 1
    out = np.full(int(per.sum()), len(listed), np.int64)
    body = np.ones(len(out), bool)
    body[np.cumsum(per) - 1] = False
    out[body] = code[keep]
    return keys, out, per


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values (unsorted) and the code of each key."""
    got = pa.array(keys.view(np.int64)).dictionary_encode()
    return got.dictionary.to_numpy(), got.indices.to_numpy()


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum (keys, counts) parts; keys come out sorted."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def bucket_of(keys: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """Keys of one context of ROOTED bytes share a bucket."""
    base = (keys >> 8 * (DEPTH + 1 - ROOTED)) if kind == NGRAM else keys
    return (((base.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def slices_of(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[slice]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def count_blocks(buckets: int):
    """(doc_id, held_out, text) batches -> packed rows: each block's texts, and its keys with training counts by bucket."""

    def emit(block: int, ids: list, held: list[bool], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {NGRAM: [], WORD: []}
        for s in slices_of(texts):
            trained = ~np.array(held[s])
            keys, size = byte_keys(texts[s])
            distinct, code = counted(keys)
            parts[NGRAM].append((distinct, np.bincount(code[np.repeat(trained, size)], minlength=len(distinct))))
            distinct, code, size = word_keys(texts[s])
            parts[WORD].append((distinct, np.bincount(code[np.repeat(trained, size)], minlength=len(distinct))))
            for kind in parts:
                if len(parts[kind]) >= 8:
                    parts[kind] = [merge(parts[kind])]
        rows = []
        for kind, own in parts.items():
            keys, counts = merge(own)
            into = bucket_of(keys, kind, buckets)
            order = np.argsort(into, kind="stable")
            edges = np.searchsorted(into[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)):
                at = order[edges[k] : edges[k + 1]]
                rows.append((block, kind, int(k), len(at), pack(keys[at]), pack(counts[at].astype(np.int64))))
        about = pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "size": pa.array([len(t) for t in texts], pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, about.schema) as out:
            out.write_table(about)
        rows.append((block, TEXT, 0, len(ids), zstandard.ZstdCompressor(level=1).compress(b"".join(texts)), sink.getvalue().to_pybytes()))
        for r in rows:
            yield batch_of([r])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
                raw = (t.as_py() or "").encode()
                if texts and size + len(raw) > BLOCK_BYTES:
                    yield from emit(block, ids, held, texts)
                    block, ids, held, texts, size = block + 1, [], [], [], 0
                ids.append(i)
                held.append(h)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield from emit(block, ids, held, texts)

    return run


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "kind", "bucket", "n", "a", "b"])


# the tree -----------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: shifted by eight, then Stirling's series."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    r = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + r / 12 - r**3 / 360 + r**5 / 1260 - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """All decisions of one context depth and one bit: sorted node keys, counts, weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int):
        # keys: sorted distinct (context << 8 | byte)
        node = keys >> (8 - bit)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        one = (keys >> (7 - bit)) & 1
        self.node = node[first]
        self.of = np.cumsum(np.concatenate([[False], node[1:] != node[:-1]]))
        total = np.add.reduceat(counts, first).astype(float)
        self.ones = np.add.reduceat(counts * one, first).astype(float)
        self.zeros = total - self.ones
        self.total = total
        self.kt = (self.ones + 0.5) / (total + 1.0)
        self.log_kt = log_kt(self.zeros, self.ones)
        self.log_w = self.log_kt
        self.share = np.ones(len(first))

    def above(self, child: Level, bit: int) -> np.ndarray:
        """Take the children's log probabilities; returns the index of each child's parent."""
        prefix = child.node & ((1 << bit) - 1)
        parent = np.searchsorted(self.node, ((child.node >> (bit + 8)) << bit) | prefix)
        self.weigh(np.bincount(parent, child.log_w, minlength=len(self.node)))
        return parent

    def weigh(self, children: np.ndarray) -> None:
        half = np.log(0.5)
        self.log_w = np.logaddexp(half + self.log_kt, half + children)
        self.share = np.exp(half + self.log_kt - self.log_w)


def by_depth(keys: np.ndarray, counts: np.ndarray, least: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """depth -> sorted (context << 8 | byte) keys and counts, from the full depth's."""
    out = {DEPTH: (keys, counts)}
    for depth in range(DEPTH - 1, least - 1, -1):
        k, c = out[depth + 1]
        out[depth] = merge([(((k >> 16) << 8) | (k & 255), c)])
    return out


def subtree_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the decisions at ROOTED - 1 context bytes: key (context << 8 | node), zeros, ones and the sum over children
    in these subtrees of their log probability."""
    levels, out = by_depth(keys, counts, ROOTED), []
    for bit in range(8):
        at = {d: Level(*levels[d], bit) for d in range(ROOTED, DEPTH + 1)}
        for d in range(DEPTH - 1, ROOTED - 1, -1):
            at[d].above(at[d + 1], bit)
        top = at[ROOTED]
        parent = ((top.node >> (bit + 8)) << 8) | (1 << bit) | (top.node & ((1 << bit) - 1))
        own, index = np.unique(parent, return_inverse=True)
        out.append((own, *(np.bincount(index, x, minlength=len(own)) for x in (top.zeros, top.ones, top.log_w))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def upper_levels(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, ...]:
    """From the sums at ROOTED - 1 bytes, all levels above. Per key (sorted): A, B, U, with which a decision's
    probability is A + B p for p mixed below, and U where nothing below was met in training."""
    table = {ROOTED - 1: (key, zeros, ones, children)}
    share, kt, total, up = {}, {}, {}, {}
    for d in range(ROOTED - 1, -1, -1):
        k, z, o, c = table[d]
        half, own = np.log(0.5), log_kt(z, o)
        log_w = np.logaddexp(half + own, half + c)
        share[d], kt[d], total[d] = np.exp(half + own - log_w), (o + 0.5) / (z + o + 1.0), z + o
        if d:
            above = ((k >> 16) << 8) | (k & 255)
            parents, index = np.unique(above, return_inverse=True)
            table[d - 1] = (parents, *(np.bincount(index, x, minlength=len(parents)) for x in (z, o, log_w)))
            up[d] = index
    index = {ROOTED - 1: np.arange(len(key))}
    for d in range(ROOTED - 1, 0, -1):
        index[d - 1] = up[d][index[d]]
    fixed, rest, unmet = np.zeros(len(key)), np.ones(len(key)), np.zeros(len(key), bool)
    last = np.full(len(key), 0.5)
    for d in range(ROOTED):
        w, p, seen = share[d][index[d]], kt[d][index[d]], total[d][index[d]] > 0
        stop = ~seen & ~unmet  # the path ends above: what is left takes the last estimate met
        fixed, rest, unmet = np.where(stop, fixed + rest * last, fixed), np.where(stop, 0.0, rest), unmet | ~seen
        live = ~unmet
        fixed, rest = np.where(live, fixed + rest * w * p, fixed), np.where(live, rest * (1 - w), rest)
        last = np.where(live, p, last)
    return fixed, rest, fixed + rest * last


def key_scores(keys: np.ndarray, counts: np.ndarray, upper: tuple[np.ndarray, ...]) -> np.ndarray:
    """Natural log probability of each (context, byte) key of a bucket."""
    levels, out = by_depth(keys, counts, ROOTED), np.zeros(len(keys))
    top_key, fixed, rest, bare = upper
    for bit in range(8):
        at = {d: Level(*levels[d], bit) for d in range(ROOTED, DEPTH + 1)}
        parent = {}
        for d in range(DEPTH - 1, ROOTED - 1, -1):
            parent[d] = at[d].above(at[d + 1], bit)
        deep = at[DEPTH]
        index = {DEPTH: np.arange(len(deep.node))}
        for d in range(DEPTH - 1, ROOTED - 1, -1):
            index[d] = parent[d][index[d + 1]]
        p, met = deep.kt, deep.total > 0
        for d in range(DEPTH - 1, ROOTED - 1, -1):
            x, i = at[d], index[d]
            p = np.where(met, x.share[i] * x.kt[i] + (1 - x.share[i]) * p, x.kt[i])
            met = x.total[i] > 0
        root = at[ROOTED].node[index[ROOTED]]
        i = np.searchsorted(top_key, ((root >> (bit + 8)) << 8) | (1 << bit) | (root & ((1 << bit) - 1)))
        p = np.where(met, fixed[i] + rest[i] * p, bare[i])
        one = ((keys >> (7 - bit)) & 1) == 1
        p = p[deep.of]
        out += np.log(np.where(one, p, 1 - p))
    return out


# passes -------------------------------------------------------------------------------------------------


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[dict, dict]:
    """A bucket's packed rows -> kind: merged (keys, counts), and kind: (block, keys) of each row."""
    parts, asked = {NGRAM: [], WORD: []}, {NGRAM: [], WORD: []}
    for batch in batches:
        for r in batch.to_pylist():
            keys = unpack(r["a"], np.int64)
            parts[r["kind"]].append((keys, unpack(r["b"], np.int64)))
            asked[r["kind"]].append((r["block"], keys))
            if len(parts[r["kind"]]) >= 64:
                parts[r["kind"]] = [merge(parts[r["kind"]])]
    return {k: merge(v) for k, v in parts.items()}, asked


def sum_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged, _ = gathered(batches)
    keys, counts = merged[WORD]
    rows = [(np.array([-1]), np.array([float(counts.sum())]), np.array([float((counts > 0).sum())]), np.zeros(1))]
    if len(merged[NGRAM][0]):
        rows.append(subtree_sums(*merged[NGRAM]))
    key, zeros, ones, children = (np.concatenate(x) for x in zip(*rows, strict=True))
    yield pa.RecordBatch.from_pydict({"key": key, "zeros": zeros, "ones": ones, "children": children})


def answer_bucket(upper):
    """Packed requests of a bucket -> the same rows with values for counts: log probabilities, or word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged, asked = gathered(batches)
        for kind, (keys, counts) in merged.items():
            if not len(keys):
                continue
            values = key_scores(keys, counts, upper.value) if kind == NGRAM else counts.astype(float)
            for block, own in asked[kind]:
                yield batch_of([(block, kind, 0, len(own), pack(own), pack(values[np.searchsorted(keys, own)]))])

    return run


def score_blocks(total: float, distinct: float):
    """A block's answers, then its texts -> a row a text."""

    def texts_of(row: dict) -> tuple[pa.Table, list[bytes]]:
        about = pa.ipc.open_stream(row["b"]).read_all()
        raw = zstandard.ZstdDecompressor().decompress(row["a"])
        ends = np.cumsum(about["size"].to_numpy())
        return about, [raw[e - n : e] for e, n in zip(ends.tolist(), about["size"].to_pylist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {NGRAM: [], WORD: []}
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] != TEXT:
                    got[r["kind"]].append((unpack(r["a"], np.int64), unpack(r["b"], np.float64)))
                    continue
                look = {}
                for kind, parts in got.items():
                    keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(keys)
                    look[kind] = keys[order], values[order]
                got = {NGRAM: [], WORD: []}
                about, texts = texts_of(r)
                for s in slices_of(texts):
                    yield score_texts(about.slice(s.start, s.stop - s.start), texts[s], look, total, distinct)

    return run


def score_texts(about: pa.Table, texts: list[bytes], look: dict, total: float, distinct: float) -> pa.RecordBatch:
    find = lambda kind, x: look[kind][1][np.searchsorted(look[kind][0], x)]
    keys, size = byte_keys(texts)
    own, code = counted(keys)
    score = np.add.reduceat(find(NGRAM, own)[code], np.cumsum(size) - size) / np.log(10)
    own, code, words = word_keys(texts)
    count = find(WORD, own)
    begin = np.cumsum(words) - words
    known = np.add.reduceat((count > 0)[code].astype(np.int64), begin)
    base = np.add.reduceat(np.log10((count + ALPHA) / (total + ALPHA * (distinct + 1)))[code], begin)
    n = len(texts)
    return pa.RecordBatch.from_pydict({
        "doc_id": about["doc_id"].combine_chunks(), "held_out": about["held_out"].combine_chunks(), "n_tokens": words.astype(np.int64), "n_known": known,
        "train_tokens": np.full(n, int(total)), "base_score": base, "score": score, "n_bytes": size - 1, "bits_per_byte": -score * np.log2(10) / size,
    })


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def score(docs: DataFrame, held_out) -> DataFrame:
    """Learn from the texts where held_out is false; score every text (doc_id, text). held_out: a Column."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > UNKNOWN:  # what Spark says of rows that it has no statistics of
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(6, size // BUCKET_BYTES)
    packed = common.saved(rows.mapInArrow(count_blocks(buckets), PACKED), "blocks")
    asked = packed.filter(F.col("kind") != TEXT)
    dealt = asked.repartitionById(buckets, F.col("bucket"))
    sums = dealt.mapInArrow(sum_bucket, "key long, zeros double, ones double, children double").groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("children")).toArrow()
    key, zeros, ones, children = (np.asarray(sums.column(i).to_numpy()) for i in range(4))
    order = np.argsort(key)
    key, zeros, ones, children = key[order], zeros[order], ones[order], children[order]
    total, distinct = (zeros[0], ones[0]) if len(key) else (0.0, 0.0)
    upper = spark.sparkContext.broadcast((key[1:], *upper_levels(key[1:], zeros[1:], ones[1:], children[1:])))
    answers = dealt.mapInArrow(answer_bucket(upper), PACKED)
    both = answers.unionByName(packed.filter(F.col("kind") == TEXT))
    blocks = packed.filter(F.col("kind") == TEXT).count()
    return both.repartition(max(1, 2 * blocks), "block").sortWithinPartitions("block", "kind").mapInArrow(score_blocks(total, distinct), SCORED)


def op2_context_tree_weighting(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, common.crc_fold(F.col("doc_id"), MODULUS) == HELD_OUT)

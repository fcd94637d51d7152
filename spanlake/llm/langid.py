"""Language identification of mixed text: script ranges, character n-grams and a Viterbi pass over words.

Every word is scored under each language by the log odds of its character n-grams. Script ranges narrow the
candidates: a language in which the word's script is (nearly) unseen cannot label it. A Viterbi pass over the words of a
text, with a penalty for each switch, labels spans. A text's language is the one whose spans hold most letters;
its score is their share of all letters.

The model is fit on a bounded sample of labelled rows, about ``PER_LANGUAGE`` texts a language, chosen by a hash
of doc_id and text among the rows that may be learned from, and counts n-grams of their whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a letter is what Unicode calls one;
ties go to the language first in sorted order; a text none of whose scripts any language was learned with is given the most
frequent language at a score of 1 / languages; a token without spaces in it counts by the script of its last letter; rows that
repeat are each judged; with nothing to learn from every text is ``und``, and an empty table gives no rows; long texts are
handled whole, in time and memory linear in their words; columns named like the added ones are replaced by them.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words

PER_LANGUAGE = 2000
MODULUS, HELD_OUT = 4, 2
SLOTS = 1 << 17
ORDERS = (1, 2, 3, 4)
SWITCH = 6.0
#: bytes of text whose tokens are labelled at once; a token takes some 60 bytes meanwhile
SLICE_BYTES = 2 << 20
#: distinct words whose n-grams are held at once; a word takes about a kilobyte meanwhile
WORDS_AT_ONCE = 8192
UNSEEN = -8.0
# First code points of script ranges (fixed values).
SCRIPTS = """
0000 latin 0370 greek 0400 cyrillic 0530 armenian 0590 hebrew 0600 arabic 0900 devanagari 0980 bengali 0E00 thai
1100 hangul 1E00 latin 1F00 greek 2000 common 2E80 han 3040 kana 3100 han AC00 hangul D7B0 common F900 han FB00 common
"""
_pairs = [(int(a, 16), b) for a, b in zip(SCRIPTS.split()[::2], SCRIPTS.split()[1::2], strict=True)]
SCRIPT_NAMES = sorted({b for _, b in _pairs})
SCRIPT_STARTS = np.array([a for a, _ in _pairs], np.uint32)
SCRIPT_OF = np.array([SCRIPT_NAMES.index(b) for _, b in _pairs])


def grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct word: slots of its n-grams (flat), the word each belongs to, its letters and its script."""
    line = "\n" + "\n".join(vocabulary) + "\n"
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    kinds = {c: c.isalpha() for c in set(line)}
    table = np.zeros(max(map(ord, kinds)) + 1, bool)
    table[[ord(c) for c, letter in kinds.items() if letter]] = True
    letter = table[points]
    owner = np.cumsum(points == 10) - 1
    n = len(vocabulary)
    letters = np.bincount(owner[letter], minlength=n)[:n]
    script = np.zeros(n, np.int64)
    which = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, points[letter].astype(np.uint32), side="right") - 1]
    script[owner[letter]] = which  # the script of a word's last letter
    # what is no letter is a boundary; n-grams hold at least one letter and boundaries only at their ends
    symbol = np.where(letter, points, 0)
    slots, belongs = [], []
    for order in ORDERS:
        size = len(points) - order + 1
        if size <= 0:
            continue
        code, inner, some = np.full(size, order, np.uint64), np.ones(size, bool), np.zeros(size, bool)
        for k in range(order):
            code = code * np.uint64(0x9E3779B97F4A7C15) + symbol[k : k + size] + np.uint64(1)
            some |= letter[k : k + size]
            if 0 < k < order - 1:
                inner &= letter[k : k + size]
        # belongs to the word of its first letter
        first = np.where(letter[:size], owner[:size], owner[min(1, order - 1) : min(1, order - 1) + size])
        good = inner & some & (first >= 0) & (first < n)
        slots.append(((code[good] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(47)).astype(np.int64))
        belongs.append(first[good])
    return np.concatenate(slots), np.concatenate(belongs), letters, script


@dataclasses.dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages, log odds
    allowed: np.ndarray  # scripts x languages
    common: int

    def score(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per distinct word its score in each language, its letters, and whether any language has its script."""
        parts = [self._score(vocabulary[a : a + WORDS_AT_ONCE]) for a in range(0, len(vocabulary), WORDS_AT_ONCE)]
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def _score(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots, belongs, letters, script = grams(vocabulary)
        n, k = len(vocabulary), len(self.languages)
        out = np.empty((n, k))
        for j in range(k):
            out[:, j] = np.bincount(belongs, self.weights[slots, j], minlength=n)[:n]
        out /= len(ORDERS)
        out[(letters > 0)[:, None] & ~self.allowed[script]] += 4 * UNSEEN
        return out.astype(np.float32), letters, (letters > 0) & self.allowed[script].any(axis=1)


def learnable(docs: DataFrame) -> Column:
    return (common.crc_fold(F.col("doc_id"), MODULUS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Count n-grams and scripts of the sample. The driver sees SLOTS + scripts sums a language at most."""
    rows = docs.filter(learnable(docs)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))])
    sample = rows.filter(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")
    place = {lang: i for i, lang in enumerate(languages)}
    width = SLOTS + len(SCRIPT_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), width))
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                codes, offsets, vocabulary = words.coded(part.column("text"))
                if not vocabulary:
                    continue
                spoken = np.repeat([place[x] for x in part.column("lang").to_pylist()], np.diff(offsets))
                often = {j: np.bincount(codes[spoken == j], minlength=len(vocabulary)).astype(float) for j in np.unique(spoken)}
                for a in range(0, len(vocabulary), WORDS_AT_ONCE):
                    slots, belongs, letters, script = grams(vocabulary[a : a + WORDS_AT_ONCE])
                    for j, n in often.items():
                        n = n[a : a + WORDS_AT_ONCE]
                        sums[j, :SLOTS] += np.bincount(slots, n[belongs], minlength=SLOTS)[:SLOTS]
                        sums[j, SLOTS:] += np.bincount(script, n * letters, minlength=len(SCRIPT_NAMES))
        lang, slot = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"lang": lang.astype(np.int32), "slot": slot.astype(np.int32), "n": sums[lang, slot]})

    got = sample.mapInArrow(count, "lang int, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((len(languages), width))
    sums[got["lang"].to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
    seen, scripts = sums[:, :SLOTS], sums[:, SLOTS:]
    rate = (seen + 0.5) / (seen.sum(axis=1, keepdims=True) + 0.5 * SLOTS)
    weights = np.log(rate) - np.log(rate).mean(axis=0)
    weights[:, seen.sum(axis=0) == 0] = 0
    allowed = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True)) >= 0.001
    return Model(languages, np.maximum(weights, UNSEEN).T.astype(np.float32).copy(), allowed.T.copy(), int(np.argmax([counts[x] for x in languages])))


def viterbi(codes: np.ndarray, offsets: np.ndarray, scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The language of each token: the best path of every text, all texts stepped through together."""
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    start, sorted_length = offsets[:-1][order], length[order]
    k = scores.shape[1]
    most = int(length.max(initial=0))
    alive = np.searchsorted(-sorted_length, -np.arange(most), side="left")
    value = np.zeros((len(order), k), np.float32)
    stay, best = np.empty((len(codes), k), bool), np.empty(len(codes), np.uint8 if k < 256 else np.int32)
    for t in range(most):
        n = alive[t]
        at = start[:n] + t
        v = value[:n]
        top = v.argmax(axis=1)
        switched = v[np.arange(n), top][:, None] - np.float32(penalty)
        keep = v >= switched
        stay[at], best[at] = keep, top
        value[:n] = np.where(keep, v, switched) + scores[codes[at]]
    label = np.empty(len(codes), np.int64)
    now = value.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        n = alive[t]
        at = start[:n] + t
        label[at] = now[:n]
        now[:n] = np.where(stay[at, now[:n]], now[:n], best[at])
    return label


def label_tokens(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token labels, letters of each token, whether its script is known, offsets of texts."""
    codes, offsets, vocabulary = words.coded(texts)
    if not vocabulary:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), offsets
    scores, letters, known = model.score(vocabulary)
    return viterbi(codes, offsets, scores), letters[codes], known[codes], offsets


def predict(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs with the language and its score added, or put in place of columns so named."""
    rows = docs.drop(*names)
    if model is None:
        return rows.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)})
    schema = T.StructType([*rows.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    held_model = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages weights, 4 bytes each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held_model.value
        k = len(model.languages)
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                label, letters, known, offsets = label_tokens(model, part.column("text"))
                owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                held = np.bincount(owner * k + label, letters, minlength=part.num_rows * k).reshape(-1, k)
                total, best = held.sum(axis=1), held.argmax(axis=1)
                share = held.max(axis=1) / np.maximum(total, 1)
                foreign = (total > 0) & (np.bincount(owner[known], minlength=part.num_rows) == 0)
                best, share = np.where(foreign, model.common, best), np.where(foreign, 1 / k, share)
                told = np.array(model.languages, object)[best]
                told[total == 0] = "und"
                added = [pa.array(told.tolist(), pa.string()), pa.array(np.where(total == 0, 0.0, share))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *names])

    return rows.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """The rows whose language can be told: those with a letter. Columns as given."""
    names = ("_lang_pred", "_lang_score")
    return predict(docs, fit(docs), names).filter(F.col(names[0]) != "und").select(*docs.columns)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and its spans (lang, first word, words, letters) in order."""
    schema = "doc_id long, spans array<struct<lang:string,first:long,words:long,letters:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                label, letters, _, offsets = label_tokens(model, part.column("text"))
                out = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    edge = np.concatenate([[a], np.flatnonzero(np.diff(label[a:b])) + a + 1, [b]]) if b > a else np.array([a])
                    out.append([{"lang": model.languages[label[i]], "first": int(i - a), "words": int(j - i), "letters": int(letters[i:j].sum())} for i, j in zip(edge[:-1], edge[1:], strict=True)])
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("letters", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (common.crc_fold(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "lang_pred", "score")

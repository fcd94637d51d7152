"""Toxicity by a weighted finite-state pattern grammar over clauses.

A cascade of weighted transducers, each a table of arcs (input, output, weight, next state), is composed into one
machine. The lexicon, a letter transducer, turns words into classes: insults and threats (a seed list, and stems learned
from labels) with their weights, targets (pronouns of address), negations, reporting verbs and quotes. Over these classes run
negation (reaches ``REACH`` words ahead), reported speech (from its verb or an open quote to the end of the clause), threat (aimed
if a target follows within reach), target (is anybody of the clause addressed) and, last and not deterministic, the choice
of one match a clause, whose pattern (plain, aimed, negated, reported) closes the path. The best path's weight is the clause's.

Isolated words are not scored: what counts is the clause with its pattern, how strong the strongest is, and how many
clauses stay calm beside the matched ones; a text is scored by a logistic model of these three.

Learned from labels, on a bounded sample of about ``SAMPLE`` labelled rows a label, whole texts: stems, which are word
beginnings or whole words that stand, neither negated nor reported, significantly more often in toxic texts; pattern weights;
and the model of texts. Texts that share their least shingle are mostly copies of each other and weigh as one together.

Defined cases: a null, empty or wordless text has no clause and scores as every text without a match does; several
labels of one document each count; a null label is not learned from; without labels of both kinds the seed list alone decides;
repeated rows are each scored; of equal paths the first pattern in order counts; long texts are parsed whole, clause by clause; an empty
table gives no rows; input columns but doc_id and text are not kept, whatever their names.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

MODULUS, HELD_OUT = 3, 1
SAMPLE = 12_000
#: what a stem costs, beside twice the logarithm of the vocabulary, in units of the likelihood ratio statistic
COST, LEAST_LETTERS, LEAST_ODDS = 8.0, 3, math.log(8)
#: bytes of text whose words are counted at once
COUNTED_BYTES = 2 << 20
REACH = 3
THRESHOLD = 0.7
# Seed words of the lexicon (fixed values).
INSULTS = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting"
THREATS = "kill murder strangle"
TARGETS = "you your yours he his she her they them their du dich dir ihr euch tu te vous toi vosotros usted ustedes"
NEGATIONS = "not no never nobody isn't aren't don't nicht kein keine nie pas jamais ni nunca jamás"
REPORTS = "said says told wrote quoted called reported sagte schrieb nannte dit écrit dijo escribió llamó"
SEED_WEIGHT = 1.0
CLAUSE = re.compile(r"[.!?;:|\n]+")
RUN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]")
PATTERNS = [f"{kind}{aim}{how}" for kind in ("insult", "threat") for aim in ("", "+target") for how in ("", "+negated", "+reported")]
PRIOR = {p: (-1.0 if "negated" in p else -0.7 if "reported" in p else 0.3 if "target" in p else 0.0) for p in PATTERNS}


# transducers --------------------------------------------------------------------------------------------

# Classes: I insult, H threat, T target, N negation, R report, W any other word, E the end of the clause. I- and I= are
# negated and reported, H! is a threat that has met its target; E+ ends a clause that addresses somebody.
WORDS = ["I", "H", "T", "N", "R", "W"]
HOW = {"": "", "-": "+negated", "=": "+reported"}


@dataclasses.dataclass
class Transducer:
    """arcs: state -> input -> [(output, weight, lexical, next state)], every arc reading and writing one symbol; ``lexical`` arcs
    also add the weight of the word that is read. A path begins in ``start`` and may end in any state of ``final``."""

    start: object
    arcs: dict
    final: frozenset

    def compose(self, other: Transducer) -> Transducer:
        """The machine that reads what self reads and writes what other makes of self's output."""
        start = (self.start, other.start)
        arcs, todo = {}, [start]
        while todo:
            a, b = state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for read, own in self.arcs.get(a, {}).items():
                out = [(y, v + w, k or m, (p, q)) for x, v, k, p in own for y, w, m, q in other.arcs.get(b, {}).get(x, ())]
                if out:
                    arcs[state][read] = out
                    todo += [arc[3] for arc in out]
        return Transducer(start, arcs, frozenset(x for x in arcs if x[0] in self.final and x[1] in other.final))

    def numbered(self) -> Transducer:
        """The same machine with small numbers for states."""
        number = {x: i for i, x in enumerate(self.arcs)}
        arcs = {number[x]: {r: [(o, w, k, number[n]) for o, w, k, n in out] for r, out in own.items()} for x, own in self.arcs.items()}
        return Transducer(number[self.start], arcs, frozenset(number[x] for x in self.final))

    def best(self, symbols: list[tuple[str, float]]) -> tuple[float, str] | None:
        """Weight and last output of the best path over (symbol, lexical weight); of equal ones the first output by name."""
        at = {self.start: (0.0, "")}
        for symbol, lexical in symbols:
            then: dict = {}
            for state, (weight, _) in at.items():
                for out, w, k, following in self.arcs[state].get(symbol, ()):
                    found = (weight + w + (lexical if k else 0.0), out)
                    if following not in then or (-found[0], found[1]) < (-then[following][0], then[following][1]):
                        then[following] = found
            at = then
        ends = [v for state, v in at.items() if state in self.final]
        return min(ends, key=lambda v: (-v[0], v[1])) if ends else None


def negation() -> Transducer:
    """States: words that the last negation still reaches."""
    arcs = {}
    for left in range(REACH + 1):
        after = max(0, left - 1)
        arcs[left] = {x: [(x + "-" if left and x in "IH" else x, 0.0, False, after)] for x in ("I", "H", "T", "R", "W")}
        arcs[left] |= {"N": [("W", 0.0, False, REACH)], "E": [("E", 0.0, False, 0)]}
    return Transducer(0, arcs, frozenset([0]))


def reported_speech() -> Transducer:
    arcs = {}
    for inside in (False, True):
        keep = {x: [(x, 0.0, False, inside)] for x in ("T", "W", "I-", "H-")}
        told = {x: [(x + "=" if inside else x, 0.0, False, inside)] for x in ("I", "H")}
        arcs[inside] = keep | told | {"R": [("W", 0.0, False, True)], "E": [("E", 0.0, False, False)]}
    return Transducer(False, arcs, frozenset([False]))


def threat() -> Transducer:
    """A threat is aimed if a target follows within reach, else plain; it is told where that is known, so that ``REACH`` other
    words have to stand before the end. States: none, or the manner of a threat heard and the words left to it (0: overdue)."""
    none, insults = ("", -1), ["I" + h for h in HOW]
    arcs = {none: {x: [(x, 0.0, False, none)] for x in ("W", "T", "E", *insults)} | {"H" + h: [("W", 0.0, False, (h, REACH))] for h in HOW}}
    for how in HOW:
        for left in range(REACH + 1):
            own = {x: [(x, 0.0, False, (how, max(0, left - 1)))] for x in insults}
            own |= {"H" + h: [("H" + how, 0.0, False, (h, REACH))] for h in HOW}
            own["W"] = [("W", 0.0, False, (how, left - 1))] if left > 1 else [("H" + how, 0.0, False, none)]
            own["T"] = [("H!" + how, 0.0, False, none)] if left else [("T", 0.0, False, (how, 0))]
            arcs[how, left] = own
    return Transducer(none, arcs, frozenset([none]))


def target() -> Transducer:
    """The end says whether anybody was addressed."""
    arcs = {}
    for seen in (False, True):
        same = ["W", *["I" + h for h in HOW], *["H" + h for h in HOW]]
        arcs[seen] = {x: [(x, 0.0, False, seen)] for x in same} | {"H!" + h: [("H!" + h, 0.0, False, True)] for h in HOW}
        arcs[seen] |= {"T": [("W", 0.0, False, True)], "E": [("E+" if seen else "E", 0.0, False, False)]}
    return Transducer(False, arcs, frozenset([False]))


def choice(patterns: dict[str, float], threat_weight: float) -> Transducer:
    """Take one match of the clause, pass the others by; the pattern it makes is written, and weighed, at the end."""
    symbols = ["W", *[x + h for x in ("I", "H", "H!") for h in HOW]]
    arcs = {"open": {x: [("-", 0.0, False, "open")] for x in symbols}}
    for h, how in HOW.items():
        for x, taken in (("I", f"insult|{how}"), ("H", f"threat|{how}"), ("H!", f"threat+target|{how}")):
            arcs["open"][x + h].append(("-", 0.0 if x == "I" else threat_weight, x == "I", taken))
            arcs.setdefault(taken, {s: [("-", 0.0, False, taken)] for s in symbols})
            for end in ("E", "E+"):
                kind = taken.split("|")[0]
                name = (kind + "+target" if end == "E+" and kind == "insult" else kind) + how
                arcs[taken][end] = [(name, patterns.get(name, 0.0), False, "done")]
    arcs["done"] = {}
    return Transducer("open", arcs, frozenset(["done"]))


class Lexicon:
    """A letter transducer: reading a word letter by letter, the weight of the best stem on the way; ``$`` ends a whole word."""

    def __init__(self, stems: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.weight: list[float] = [0.0]
        for stem, weight in stems.items():
            at = 0
            for letter in stem:
                if letter not in self.next[at]:
                    self.next[at][letter] = len(self.next)
                    self.next.append({})
                    self.weight.append(0.0)
                at = self.next[at][letter]
            self.weight[at] = max(self.weight[at], weight)

    def __call__(self, word: str) -> float:
        at, found = 0, 0.0
        for letter in word:
            at = self.next[at].get(letter, -1)
            if at < 0:
                return found
            found = max(found, self.weight[at])
        end = self.next[at].get("$", -1)
        return max(found, self.weight[end]) if end >= 0 else found


@dataclasses.dataclass
class Grammar:
    """stems: beginnings and, closed by $, whole words -> weight; patterns: weight of each; bias: the logit of texts without a
    match; model: logit of the others, from 1, log(1 + matched weight), log(1 + calm clauses) and the strongest clause."""

    stems: dict[str, float]
    patterns: dict[str, float]
    bias: float
    model: tuple[float, float, float, float] | None = None

    def __post_init__(self):
        self.classes = {w: c for c, listed in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in listed.split()}
        self.threats = set(THREATS.split())
        self.weight = Lexicon(self.stems)
        strongest = max([self.weight(w) for w in self.threats], default=0.0)
        cascade = negation().compose(reported_speech()).compose(threat()).compose(target())
        self.machine = cascade.compose(choice(self.patterns, strongest)).numbered()

    def symbol(self, word: str) -> tuple[str, float]:
        """The class of a lower-cased word or quote, and its lexical weight."""
        if not word[0].isalpha():
            return "R", 0.0
        if kind := self.classes.get(word):
            return kind, 0.0
        weight = self.weight(word)
        return ("H" if word in self.threats else "I", weight) if weight else ("W", 0.0)

    def matches(self, text: str) -> list[list[tuple[str, float]]]:
        """Per clause with a match, its best path's (pattern, weight)."""
        out = []
        for clause in CLAUSE.split(text.lower()):
            symbols = [self.symbol(w) for w in RUN.findall(clause)]
            if any(kind in "IH" for kind, _ in symbols):
                weight, pattern = self.machine.best([*symbols, *[("W", 0.0)] * REACH, ("E", 0.0)])
                out.append([(pattern, weight)])
        return out

    def features(self, text: str) -> tuple[float, float, float] | None:
        """log(1 + matched weight), log(1 + calm clauses), strongest clause; None without a match."""
        found = [max(0.0, w) for clause in self.matches(text) for _, w in clause]
        if not found:
            return None
        calm = len(CLAUSE.findall(text)) + 1 - len(found)
        return math.log1p(sum(found)), math.log1p(calm), max(found)

    def score(self, text: str | None) -> float:
        got, total = self.features(text or ""), self.bias
        if got is not None:
            one, matched, calm, strongest = self.model or (self.bias, 1.0, 0.0, 0.5)
            total = one + matched * got[0] + calm * got[1] + strongest * got[2]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def seeds() -> dict[str, float]:
    return {w + "$": SEED_WEIGHT for w in f"{INSULTS} {THREATS}".split()}


# learning -----------------------------------------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, weight): labelled rows that may be learned from, thinned by hash to about ``most`` a label.

    The weight is one over the number of texts of the label that share the least shingle.
    """
    fold = common.crc_fold(F.col("doc_id"), MODULUS)
    marks = labels.filter((fold != HELD_OUT) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", F.lit(6)).alias("h"))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, most / max(1, n.get(1, 0)))).otherwise(min(1.0, most / max(1, n.get(0, 0))))
    marks = marks.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    rows = rows.withColumn("w", F.split(F.lower("text"), r"\s+"))
    least = F.array_min(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    rows = common.saved(rows.select("text", "toxic", F.when(F.size("w") >= 3, least).otherwise(F.xxhash64("text")).alias("key")), "toxic")
    copies = rows.groupBy("toxic", "key").agg((1 / F.count(F.lit(1))).alias("weight"))
    return rows.join(F.broadcast(copies), ["toxic", "key"]).select("text", "toxic", "weight")  # 20 bytes for each row of the sample


def openly(codes: np.ndarray, offsets: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """Which tokens stand neither in the reach of a negation nor after a report or quote of their clause."""
    kinds = {w: c for c, listed in (("N", NEGATIONS), ("R", REPORTS)) for w in listed.split()}
    found = [RUN.findall(v) for v in vocabulary]
    told = np.array([any(not w[0].isalpha() or kinds.get(w) == "R" for w in f) for f in found])[codes]
    no = np.array([any(kinds.get(w) == "N" for w in f) for f in found])[codes]
    closing = np.array([bool(CLAUSE.search(v)) for v in vocabulary])[codes]
    begins = np.concatenate([[False], closing[:-1]])
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    clause = np.cumsum(begins)
    first = np.searchsorted(clause, clause)
    before = np.cumsum(told) - told
    reached = np.zeros(len(codes), bool)
    for k in range(1, REACH + 1):
        reached[k:] |= no[:-k] & (clause[k:] == clause[:-k])
    return ~(reached | (before - before[first] + told > 0))


def gain(toxic: float, clean: float, all_toxic: float, all_clean: float, cost: float) -> float:
    """How much better a stem tells the labels apart than none: the likelihood ratio statistic less its cost; 0 if it leans to clean."""
    share = all_toxic / (all_toxic + all_clean)
    if toxic <= 0 or odds(toxic, clean, all_toxic, all_clean) < LEAST_ODDS:
        return 0.0
    both = toxic + clean
    g = 2 * (toxic * math.log(toxic / (both * share)) + (clean * math.log(clean / (both * (1 - share))) if clean > 0 else 0.0))
    return max(0.0, g - cost)


def odds(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def choose(found: dict[str, tuple[float, float]], all_toxic: float, all_clean: float, cost: float) -> dict[str, float]:
    """word -> (toxic, clean) counts of one set of words -> stems with their log odds.

    Candidates are the whole words and the beginnings at which words part, as a trie of them has; in every subtree either
    its root is taken or the best of what lies below it, whichever gains more.
    """
    names = sorted(w + "$" for w in found)
    stack: list[list] = [[0, "", 0.0, 0.0, 0.0, []]]  # depth, text, toxic, clean, gain and choice of what lies below

    def close() -> None:
        depth, text, toxic, clean, below, chosen = stack.pop()
        own = gain(toxic, clean, all_toxic, all_clean, cost) if depth >= LEAST_LETTERS or text[-1:] == "$" else 0.0
        if own > 0 and own >= below:
            below, chosen = own, [(text, odds(toxic, clean, all_toxic, all_clean))]
        up = stack[-1]
        up[2], up[3], up[4] = up[2] + toxic, up[3] + clean, up[4] + below
        up[5] = [*chosen, *up[5]] if len(chosen) < len(up[5]) else [*up[5], *chosen]

    for i, name in enumerate(names):
        last = names[i - 1] if i else ""
        shared = next((k for k, (x, y) in enumerate(zip(last, name, strict=False)) if x != y), min(len(last), len(name)))
        while stack[-1][0] > shared:
            if stack[-2][0] < shared:  # the words part inside: a node of its own between
                top = stack.pop()
                stack.append([shared, name[:shared], 0.0, 0.0, 0.0, []])
                stack.append(top)
            close()
        stack.append([len(name), name, *found[name[:-1]], 0.0, []])
    while len(stack) > 1:
        close()
    return dict(stack[0][5])


def vocabulary_of(rows: DataFrame) -> DataFrame:
    """word -> toxic and clean: weights of the texts that say it openly. Words of another class are left out."""
    known = frozenset(f"{TARGETS} {NEGATIONS} {REPORTS}".split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict = defaultdict(lambda: [0.0, 0.0])
            for part in words.slices(batch, "text", COUNTED_BYTES):
                codes, offsets, vocabulary = words.coded(part.column("text"))
                if not len(codes):
                    continue
                said = [{w for w in RUN.findall(v) if w[0].isalpha() and w not in known} for v in vocabulary]
                clear = openly(codes, offsets, vocabulary)
                for mark, weight, a, b in zip(part.column("toxic").to_pylist(), part.column("weight").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                    for w in set().union(*(said[i] for i in np.unique(codes[a:b][clear[a:b]]))):
                        sums[w][mark != 1] += weight
            names = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x][0] for x in names], pa.float64()), pa.array([sums[x][1] for x in names], pa.float64())], names=["word", "toxic", "clean"])

    counted = rows.mapInArrow(count, "word string, toxic double, clean double").groupBy("word")
    return counted.agg(F.round(F.sum("toxic"), 9).alias("toxic"), F.round(F.sum("clean"), 9).alias("clean"))


def learn_stems(rows: DataFrame) -> dict[str, float]:
    """Stems of the sample; words that share their first letters are looked at together, in as many tasks."""
    known = common.saved(vocabulary_of(rows), "vocabulary")
    sums = known.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.count(F.lit(1)).alias("n")).first()
    if not sums["n"] or not sums["t"] or not sums["c"]:
        return {}
    all_toxic, all_clean, cost = sums["t"], sums["c"], COST + 2 * math.log(sums["n"])

    def stems(own: pd.DataFrame) -> pd.DataFrame:
        found = choose({w: (t, c) for w, t, c in own[["word", "toxic", "clean"]].itertuples(index=False)}, all_toxic, all_clean, cost)
        return pd.DataFrame({"stem": list(found), "odds": list(found.values())}).astype({"stem": str, "odds": float})

    groups = known.withColumn("front", F.substring("word", 1, LEAST_LETTERS)).groupBy("front")
    return {r["stem"]: r["odds"] for r in groups.applyInPandas(stems, "stem string, odds double").orderBy("stem").collect()}


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Grammar:
    rows = common.saved(sample(docs, labels, most), "sample")
    weight = {r["toxic"]: r["weight"] for r in rows.groupBy("toxic").agg(F.sum("weight").alias("weight")).collect()}
    toxic, clean = weight.get(1, 0), weight.get(0, 0)
    bias = math.log((toxic + 1) / (clean + toxic + 2)) if weight else -2.0
    if not toxic or not clean:
        return Grammar(seeds(), dict(PRIOR), min(bias, -1.0))
    first = Grammar(seeds() | learn_stems(rows), dict.fromkeys(PATTERNS, 0.0), bias)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, mark, w in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "weight")), strict=True):
                for p in {p for clause in first.matches(text or "") for p, _ in clause}:
                    seen[p, mark == 1] += w
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([m for _, m in seen], pa.bool_()), pa.array(list(seen.values()), pa.float64())], names=["pattern", "toxic", "n"])

    met = rows.mapInArrow(patterns, "pattern string, toxic boolean, n double").groupBy("pattern", "toxic").agg(F.round(F.sum("n"), 9).alias("n")).collect()
    met = {(r["pattern"], r["toxic"]): r["n"] for r in met}
    # texts with a pattern pull its weight from the prior to the log odds that they are toxic, against those of texts with any match
    every = [sum(n for (_, m), n in met.items() if m is x) for x in (True, False)]
    weights = {}
    for p in PATTERNS:
        t, c = met.get((p, True), 0.0), met.get((p, False), 0.0)
        told = math.log((t + 0.5) / (every[0] + 1)) - math.log((c + 0.5) / (every[1] + 1))
        trust = (t + c) / (t + c + 10)
        weights[p] = trust * told + (1 - trust) * PRIOR[p]
    second = Grammar(first.stems, weights, bias)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(*f, mark, w) if (f := second.features(text or "")) else (None, None, None, mark, w) for text, mark, w in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "weight")), strict=True)]
            kinds = [pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], names=["matched", "calm", "strongest", "toxic", "weight"])

    told = common.saved(rows.mapInArrow(measured, "matched double, calm double, strongest double, toxic int, weight double"), "measured")
    calm = {r["toxic"]: r["weight"] for r in told.filter("matched is null").groupBy("toxic").agg(F.round(F.sum("weight"), 9).alias("weight")).collect()}
    columns = ["matched", "calm", "strongest", "toxic", "weight"]
    seen = told.filter("matched is not null").toPandas().sort_values(columns)  # 36 bytes for each matched row of the sample
    model = logistic(seen[columns[:3]].to_numpy(), (seen["toxic"] == 1).to_numpy(), seen["weight"].to_numpy())
    return Grammar(first.stems, weights, math.log((calm.get(1, 0.0) + 0.5) / (calm.get(0, 0.0) + 1)), model)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton steps on the penalised likelihood; a weight of the wrong sign (calm clauses help, matches harm) is 0."""
    signs, free = np.array([0, 1, -1, 1]), np.ones(4, bool)
    x = np.column_stack([np.ones(len(x)), x])
    while True:
        beta = np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x.T @ (weight * (y - p)) - ridge * beta
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(4)
            step = np.zeros(4)
            step[free] = np.linalg.solve(bend[np.ix_(free, free)], slope[free])
            beta += step / max(1.0, np.abs(step).max())
        wrong = free & (beta * signs < 0)
        if not wrong.any():
            return tuple(float(b) for b in beta)
        free &= ~wrong


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and score; a text is parsed only if the lexicon knows one of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = grammar.score(None)
        for batch in batches:
            for part in words.slices(batch, "text"):
                texts = part.column("text")
                codes, offsets, vocabulary = words.coded(texts)
                known = np.array([any(grammar.weight(w) for w in RUN.findall(v)) for v in vocabulary] or [False])
                hit = np.zeros(part.num_rows, bool)
                if len(codes):
                    hit[np.repeat(np.arange(part.num_rows), np.diff(offsets))[known[codes]]] = True
                out = np.full(part.num_rows, none)
                for i in np.flatnonzero(hit):
                    out[i] = grammar.score(texts[int(i)].as_py())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.crc_fold(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

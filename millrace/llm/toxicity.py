"""Toxicity from a learned lexicon, misspellings included (operator 9).

Lexicon terms and stems are learned from labelled rows.  A trie holds every
term that can be misspelled; a Levenshtein automaton of a word, intersected
with the trie, finds the terms that the word misspells.  Every hit is weighed by its context window:
quotation marks around it and words of reporting before it set quotation apart
from abuse.  A calibrated logistic regression turns a document's hits into a
probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._linear import calibrate, fit_logistic, sigmoid
from ._stage import map_arrow, settle

#: Bounds on the labelled rows used to fit, by label; the lexicon is bounded by these rows alone.
FIT_TOXIC, FIT_CLEAN = 2500, 7500
#: A term needs this many different contexts in toxic rows and this share of all its contexts.
TERM_CONTEXTS, STEM_CONTEXTS, PRECISION = 5, 15, 0.75
STEM_LENGTHS = range(4, 8)
#: Terms and words at least this long may misspell one another, by one insertion, deletion, substitution or swap of neighbours.
FUZZY_LENGTH = 4
#: A word with this many different contexts in clean rows, and no term itself, is spelled as meant.
ORDINARY_CONTEXTS = 3
WINDOW = 8
#: Tokens that a worker remembers, and the longest of them; longer ones are looked up each time.
WORD_MEMORY, REMEMBERED_LENGTH = 250_000, 64

_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„‘’«»…¡¿–—"
_QUOTES = frozenset("\"“”„«»")
#: Fixed words of reporting in the languages at hand.
_REPORTING = frozenset("said says wrote called calls quoted quote quotes word slur dit disait appelé citation mot sagte nannte zitat wort dijo llamó cita palabra".split())

EXACT, STEM, FUZZY = 1, 2, 3
N_FEATURES = 10


@dataclass(frozen=True)
class Lexicon:
    terms: dict[str, float]
    stems: dict[str, float]
    ordinary: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float


class Trie:
    """Terms by characters, searched with a word's Levenshtein automaton.

    Forms of stems are held like other terms: a stem is matched by exact
    prefix, so a misspelling within it is found through its forms.
    """

    def __init__(self, terms: dict[str, float]) -> None:
        self.root: dict = {}
        self.heads: dict[str, set[int]] = {}  # halves of terms -> lengths of words that may misspell them
        self.tails: dict[str, set[int]] = {}
        self.crossed: set[str] = set()  # the one edit that touches both halves
        for term, weight in terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, weight)
            half = len(term) // 2
            for halves, part in ((self.heads, term[:half]), (self.tails, term[half:])):
                halves.setdefault(part, set()).update((len(term) - 1, len(term), len(term) + 1))
            if half:
                self.crossed.add(term[: half - 1] + term[half] + term[half - 1] + term[half + 1 :])
        self.head_sizes = sorted({len(h) for h in self.heads if h})
        self.tail_sizes = sorted({len(t) for t in self.tails})

    def may_match(self, word: str) -> bool:
        """One edit leaves a term's first or second half intact, at the word's start or end, but for a swap across the middle."""
        size = len(word)
        for n in self.head_sizes:
            if size in self.heads.get(word[:n], ()):
                return True
        for n in self.tail_sizes:
            if size in self.tails.get(word[-n:], ()):
                return True
        return word in self.crossed

    def within_one(self, word: str) -> tuple[str, float] | None:
        """The heaviest term at most one edit away; a swap of neighbours is one edit.

        The automaton's states are (characters of the word consumed, edits
        made).  Without an edit a term's path is the word's own; from each
        state on it every kind of edit leads to a state with one edit made,
        from which the rest of the word must follow exactly.
        """
        found = []

        def follow(node: dict | None, at: int) -> None:
            while node is not None and at < len(word):
                node, at = node.get(word[at]), at + 1
            if node is not None and "" in node:
                found.append(node[""])

        node, n = self.root, len(word)
        for i in range(n + 1):
            for c, child in node.items():
                if c:
                    follow(child, i)  # the word lacks the term's character
                    if i < n and c != word[i]:
                        follow(child, i + 1)  # another character stands in its place
            if i < n:
                follow(node, i + 1)  # the word has one character more
            if i + 1 < n and word[i] != word[i + 1] and word[i + 1] in node:
                follow(node[word[i + 1]].get(word[i]), i + 2)  # two neighbours are swapped
            if i == n and "" in node:
                found.append(node[""])
            node = node.get(word[i]) if i < n else None
            if node is None:
                break
        return max(found, key=lambda hit: (hit[1], hit[0])) if found else None


class Hits(dict):
    """Raw token -> None or (kind, term, weight); filled as tokens come, emptied when full."""

    def __init__(self, lexicon: Lexicon, limit: int = WORD_MEMORY) -> None:
        super().__init__()
        plain = {t: w for t, w in lexicon.terms.items() if len(t) >= FUZZY_LENGTH}
        self.lexicon, self.trie, self.limit = lexicon, Trie(plain), limit

    @staticmethod
    def of(lexicon: Lexicon) -> "Hits":
        """The worker's table for a lexicon, kept from task to task; only the latest lexicon's is."""
        global _latest
        if _latest is None or _latest.lexicon != lexicon:
            _latest = Hits(lexicon)
        return _latest

    def __missing__(self, token: str):
        found = self.look_up(token.strip(_PUNCTUATION))
        if len(token) <= REMEMBERED_LENGTH:
            if len(self) >= self.limit:
                self.clear()
            self[token] = found
        return found

    def look_up(self, word: str):
        weight = self.lexicon.terms.get(word)
        if weight is not None:
            return EXACT, word, weight
        for n in STEM_LENGTHS:
            if len(word) >= n and word[:n] in self.lexicon.stems:
                return STEM, word[:n], self.lexicon.stems[word[:n]]
        if len(word) >= FUZZY_LENGTH and word not in self.lexicon.ordinary and self.trie.may_match(word):
            near = self.trie.within_one(word)
            if near:
                return FUZZY, near[0], near[1]
        return None


_latest: Hits | None = None


def quoted(tokens: list[str], at: int) -> bool:
    """Whether a hit stands in quotation marks within the window, or after a word of reporting."""
    before, after = tokens[max(0, at - WINDOW) : at + 1], tokens[at : at + WINDOW + 1]
    opens = any(t[0] in _QUOTES for t in before)
    closes = any(t.rstrip(".,;:!?")[-1:] in _QUOTES for t in after)
    return (opens and closes) or any(t.strip(_PUNCTUATION) in _REPORTING for t in before[-4:-1])


def features(text: str, hits: Hits) -> np.ndarray:
    """What a document's hits say: heaviest and number by kind, in and out of quotation."""
    out = np.zeros(N_FEATURES)
    tokens = text.lower().split()
    found = [(i, hit) for i, hit in enumerate(map(hits.__getitem__, tokens)) if hit is not None]
    out[9] = np.log1p(len(tokens)) / 10
    if not found:
        return out
    kinds = [0, 0, 0, 0]
    inside = 0
    for i, (kind, _, weight) in found:
        if quoted(tokens, i):
            inside += 1
            out[7] = max(out[7], weight)
        else:
            kinds[kind] += 1
            out[0] = max(out[0], weight if kind != FUZZY else weight - 1)
    out[1:4] = np.log1p(kinds[1:])
    out[4] = np.log1p(inside)
    out[5] = np.log1p(len({hit[1] for _, hit in found}))
    out[6] = 10 * len(found) / len(tokens)
    out[8] = sum(kinds) > 0
    return out


def _sample(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[DataFrame, dict[int, int]]:
    """Bounded labelled rows (doc_id, y, text), and how many rows each label has in all."""
    marks = labels.where("toxic is not null and doc_id is not null").where(usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    total = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    bound = {1: FIT_TOXIC, 0: FIT_CLEAN}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, bound[1] / max(total.get(1, 0), 1)))).otherwise(F.lit(min(1.0, bound[0] / max(total.get(0, 0), 1))))
    chosen = marks.where(draw < rate).withColumnRenamed("doc_id", "id")
    texts = docs.where("text is not null").select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select(F.col("id").cast("long").alias("doc_id"), "y", "text")), total


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms and stems whose contexts (neighbouring words) are mostly in toxic rows, and ordinary words one edit from a term.

    Contexts and not occurrences are counted, so that copies of a document
    don't make its words into terms.
    """

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            words_out, contexts, ys = [], [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [t.strip(_PUNCTUATION) for t in text.lower().split()]
                seen = set()
                for i, w in enumerate(words):
                    if w:
                        seen.add((w, zlib.crc32(" ".join(words[max(0, i - 1) : i] + ["_"] + words[i + 1 : i + 2]).encode())))
                for w, c in seen:
                    words_out.append(w)
                    contexts.append(c)
                    ys.append(y)
            yield {"word": words_out, "context": contexts, "y": ys}

        return step

    uses = map_arrow(sample.select("y", "text"), make, "word string, context long, y int").distinct()
    words = settle(uses.groupBy("word").agg(F.sum(F.col("y")).alias("bad"), F.sum(1 - F.col("y")).alias("good")))
    sums = words.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    if not sums["bad"] or not sums["good"]:
        return Lexicon({}, {})
    base = sums["bad"] / (sums["bad"] + sums["good"])

    def weigh(frame: DataFrame, contexts: int) -> dict[str, float]:
        # Bounded by the sample: each row stands for ``contexts`` of its contexts at least.
        rows = frame.where((F.col("bad") >= contexts) & (F.col("bad") >= PRECISION * (F.col("bad") + F.col("good")))).orderBy("word").collect()
        # Shrunk log odds against the base rate.
        return {r["word"]: float(np.log((r["bad"] + 4 * base) / (r["good"] + 4 * (1 - base))) - np.log(base / (1 - base))) for r in rows}

    prefixes = words.select(F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_LENGTHS])).alias("word"), "bad", "good").where("word is not null")
    stems = weigh(prefixes.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("forms")).where("forms >= 4"), STEM_CONTEXTS)
    stems = {s: w for s, w in stems.items() if not any(s[:n] in stems for n in range(STEM_LENGTHS.start, len(s)))}
    terms = weigh(words, TERM_CONTEXTS)

    def near():
        hits = Hits(Lexicon(terms, {}))

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            yield {"word": [w for w in batch.column(0).to_pylist() if (hits.look_up(w) or (0,))[0] == FUZZY]}

        return step

    common = words.where((F.col("good") >= ORDINARY_CONTEXTS) & (F.col("bad") < PRECISION * (F.col("bad") + F.col("good"))))
    return Lexicon(terms, stems, frozenset(r["word"] for r in map_arrow(common.select("word"), near, "word string").collect()))


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """A model from labelled rows for which ``usable`` holds, at most about FIT_TOXIC and FIT_CLEAN of them.

    Rows are chosen by a hash of doc_id; several labels of one id count by
    their maximum.  Without labelled rows of both kinds every document gets
    the base rate.
    """
    sample, total = _sample(docs, labels, usable)
    lexicon = learn_lexicon(sample)

    def make():
        hits = Hits.of(lexicon)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            rows = [features(t, hits) for t in batch.column(2).to_pylist()]
            yield {"doc_id": batch.column(0), "y": batch.column(1), "x": [r.tolist() for r in rows]}

        return step

    table = map_arrow(sample, make, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    y = table.column("y").to_numpy().astype(np.float64)
    n_bad, n_good = total.get(1, 0), total.get(0, 0)
    prior = np.log((n_bad + 0.5) / (n_good + 0.5))
    if not len(y) or y.min() == y.max():
        return Model(lexicon, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), float(prior))
    x = np.array(table.column("x").to_pylist())
    held = np.arange(len(y)) % 4 == 3
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = (x - mean) / spread
    w, b = fit_logistic(x[~held], y[~held], rounds=800, ridge=1e-3)
    slope, offset = calibrate(x[held] @ w + b, y[held])
    # The sample's mix of labels isn't the corpus's.
    drawn = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return Model(lexicon, mean, spread, slope * w, float(slope * b + offset + prior - drawn))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and n_hits for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts are scored as texts without hits.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        hits = Hits.of(m.lexicon)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            x = np.array([features(t or "", hits) for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            p = sigmoid(((x - m.mean) / m.spread) @ m.weights + m.bias)
            yield {"doc_id": batch.column(0), "score": p, "n_hits": np.round(np.expm1(x[:, 1:5]).sum(axis=1)).astype(np.int64)}

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, score double, n_hits long")

"""Quality rules: text statistics and a hashed n-gram classifier (operator 2).

Words and character 4-grams are hashed into buckets; a logistic regression on
the square roots of bucket shares, trained on labelled rows and calibrated on
rows that the training didn't see, scores whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._linear import calibrate, fit_logistic, sigmoid
from ._stage import map_arrow
from ._text import Chunk, chunks, mix

WORD_BUCKETS = CHAR_BUCKETS = 2048
ORDER = 4
#: Bound on the labelled rows used to fit; every fourth of them calibrates.
FIT_ROWS = 5000
#: A document is kept if its calibrated probability of good quality is at least this.
KEEP_AT = 0.4
MIN_WORDS = 50
_BLOCK_TEXTS = 256

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Model:
    words: np.ndarray
    chars: np.ndarray
    bias: float
    slope: float
    offset: float


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def _parts(chunk: Chunk) -> Iterator[Chunk]:
    """The chunk in blocks of a bounded number of texts."""
    for lo in range(0, chunk.n, _BLOCK_TEXTS):
        hi = min(chunk.n, lo + _BLOCK_TEXTS)
        own = chunk.offsets[lo : hi + 1]
        yield Chunk(chunk.data[own[0] : own[-1]], own - own[0], chunk.first + lo)


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of bucket shares of words and of character n-grams; one row per text."""
    low = chunk.lower()
    starts, ends, first = low.words()
    h = low.range_hash(starts, ends)
    words = _shares((h & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), first, chunk.n, WORD_BUCKETS)
    wide = chunk.data.astype(np.uint64)
    n = max(0, len(wide) - ORDER + 1)
    packed = np.zeros(n, dtype=np.uint64)
    for j in range(ORDER):
        packed = (packed << np.uint64(8)) | wide[j : n + j]
    # A gram that reaches into the next text counts for neither.
    inside = np.ones(n, dtype=bool)
    for j in range(1, ORDER):
        at = chunk.offsets[1:] - j
        inside[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(inside)
    bucket = (mix(packed[at], 8) & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64)
    chars = _shares(bucket, np.searchsorted(at, chunk.offsets), chunk.n, CHAR_BUCKETS)
    return words, chars


def _shares(bucket: np.ndarray, first: np.ndarray, n: int, size: int) -> np.ndarray:
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    table = np.bincount(owner * size + bucket, minlength=n * size).reshape(n, size).astype(np.float32)
    return np.sqrt(table / np.maximum(count, 1)[:, None].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from at most about ``rows`` rows of ``docs`` with a label in ``labels`` (doc_id, quality).

    Rows are chosen by a hash of doc_id; several labels of one id count by
    their maximum; null texts and labels are left out.  Without labelled rows
    every document scores alike, at 0.5 or above.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    total = marks.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.where(draw < min(1.0, rows / max(total, 1))).select(F.col("doc_id").alias("id"), F.col("y").cast("int"))
    sample = docs.where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select(F.col("id").cast("long").alias("id"), "y", F.col("text").cast("string").alias("text"))

    def make():
        np.seterr(over="ignore")

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for whole in chunks(batch.column(2)):
                for chunk in _parts(whole):
                    words, chars = features(chunk)
                    both = np.concatenate([words, chars], axis=1).astype(np.float16)
                    yield {"id": batch.column(0).slice(chunk.first, chunk.n), "y": batch.column(1).slice(chunk.first, chunk.n), "x": [r.tobytes() for r in both]}

        return step

    table = map_arrow(sample, make, "id long, y int, x binary").toArrow().sort_by("id")
    y = table.column("y").to_numpy().astype(np.float64)
    if not len(y):
        return Model(np.zeros(WORD_BUCKETS), np.zeros(CHAR_BUCKETS), 0.0, 1.0, 1.0)
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), dtype=np.float16).reshape(len(y), -1)
    held = np.arange(len(y)) % 4 == 3
    train = x[~held].astype(np.float32)
    w, b = fit_logistic(train, y[~held])
    slope, offset = calibrate(x[held].astype(np.float32) @ w + b, y[held])
    return Model(w[:WORD_BUCKETS], w[WORD_BUCKETS:], b, slope, offset)


def statistics(chunk: Chunk) -> dict:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words and n_words of each text."""
    starts, ends, first = chunk.words()
    h = chunk.range_hash(starts, ends)
    solid = np.zeros(len(chunk.data) + 1, dtype=np.int64)
    np.add.at(solid, starts, 1)
    np.add.at(solid, ends, -1)
    inside = np.cumsum(solid[:-1]) > 0
    counts = np.diff(first)
    return {
        "n_words": counts,
        "word_chars": _sums(inside & ((chunk.data & 0xC0) != 0x80), chunk.offsets),
        "n_symbols": _sums(_SYMBOL[chunk.data], chunk.offsets),
        "n_dup_lines": _dup_lines(chunk, starts),
        "n_repeat_words": _repeat_words(h, counts, first),
    }


def _dup_lines(chunk: Chunk, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(chunk.data == 10)
    begin = np.sort(np.concatenate([chunk.offsets[:-1], breaks + 1]), kind="stable")
    stop = np.sort(np.concatenate([breaks, chunk.offsets[1:]]), kind="stable")
    owner = np.repeat(np.arange(chunk.n), 1 + _sums(chunk.data == 10, chunk.offsets))
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, owner = begin[worded], stop[worded], owner[worded]
    key = chunk.range_hash(begin, stop)
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner[order][1:][same], minlength=chunk.n)


def _repeat_words(h: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words inside 3-word windows that occur at least twice in their text."""
    if len(h) < 3:
        return np.zeros(len(counts), dtype=np.int64)
    window = mix(mix(mix(h[:-2], 1) + h[1:-1], 2) + h[2:], 3)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(owner[:-2] == owner[2:])
    order = at[np.lexsort((window[at], owner[at]))]
    same = (window[order][1:] == window[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    hit = np.zeros(len(h), dtype=bool)
    for j in range(3):
        hit[order[1:][same] + j] = True
        hit[order[:-1][same] + j] = True
    return np.bincount(owner[hit], minlength=len(counts))


def score(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """Statistics, ``probability`` (of good quality, 0 to 1), base_failed and kept, one row per input row.

    A text fails the base rules with fewer than 50 words, or if more than half
    as many words again stand in repeated 3-word windows as it has words:
    100 * n_repeat_words > 50 * n_words.  ``kept`` needs a passed base and a
    probability of at least ``keep_at``.  Null texts have no words and fail.
    Columns besides doc_id and text are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        np.seterr(over="ignore")
        m = held.value
        words, chars = m.words.astype(np.float32), m.chars.astype(np.float32)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for whole in chunks(batch.column(1)):
                out = {k: v.astype(np.int64) for k, v in statistics(whole).items()}
                z = []
                for chunk in _parts(whole):
                    by_word, by_char = features(chunk)
                    z.append(by_word @ words + by_char @ chars + m.bias)
                p = sigmoid(m.slope * np.concatenate(z) + m.offset)
                failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
                yield {"doc_id": batch.column(0).slice(whole.first, whole.n)} | {k: out[k] for k in names} | {"base_failed": failed, "kept": ~failed & (p >= keep_at), "probability": p}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, make, "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, probability double")

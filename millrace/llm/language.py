"""Language identification with bit-sliced n-gram Bloom filters (operator 8).

One array of slots serves all languages: bit l of a slot belongs to language
l's filter, so a lookup returns, for an n-gram, the mask of every language
whose filter contains it.  A slot has one word per 64 languages, each word in a
row of the array.  A document's per-language counts, corrected for each
filter's false-positive rate, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import map_arrow, quoted
from ._text import Chunk, chunks, mix

ORDERS = (3, 5)
HASHES = 3
WORD_BITS = 64
#: Bound on the labelled rows that the filters are fitted on, for up to 64 languages; each further one adds as many as one of 64 gets.
FIT_ROWS = 6000
#: An n-gram enters a language's filter if it is seen this often there, and its
#: rate there is at least this share of its highest rate in any language.
MIN_COUNT, MIN_SHARE = 3, 0.25

_CLEAN = np.full(256, 32, dtype=np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    slots: np.ndarray
    false_rate: np.ndarray


def ngrams(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order, the packed n-grams of all texts and where each text's begin (n + 1 entries).

    Letters are lower-cased (A-Z and the Latin-1 range), every other ASCII byte
    is a space, and each text stands between two spaces.
    """
    size = np.diff(chunk.offsets)
    offsets = np.concatenate([[0], np.cumsum(size + 2)])
    data = np.full(offsets[-1], 32, dtype=np.uint8)
    place = np.arange(len(chunk.data)) + np.repeat(2 * np.arange(chunk.n) + 1, size)
    data[place] = _CLEAN[chunk.data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[upper] += 0x20
    wide = data.astype(np.uint64)
    for order in ORDERS:
        n = max(0, len(data) - order + 1)
        packed = np.full(n, order, dtype=np.uint64)
        for j in range(order):
            packed = (packed << np.uint64(8)) | wide[j : n + j]
        # Windows that reach into the next text, and windows within blanks, don't count.
        inside = np.zeros(len(data), dtype=bool)
        inside[: len(data)] = True
        for j in range(1, order):
            edge = offsets[1:] - j
            inside[edge[edge >= 0]] = False
        letters = data != 32
        lead = letters[:n] | letters[1 : n + 1] if order > 1 else letters[:n]
        at = np.flatnonzero(inside[:n] & lead)
        yield packed[at], np.searchsorted(at, offsets)


def _slots(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    h = mix(grams, 5)
    step = mix(grams, 6) | np.uint64(1)
    for k in range(HASHES):
        yield ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Filters:
    """Filters from the rows of ``docs`` (doc_id, text, lang) with non-null text and lang.

    At most about ``rows`` rows are used, chosen by a hash of doc_id and text with
    the same bound for each language, which more than 64 languages don't lower;
    n-grams are counted on the executors.  No labelled rows: no languages.
    """
    labelled = docs.where("text is not null and lang is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = labelled.groupBy("lang").count().collect()
    languages = tuple(sorted(r["lang"] for r in counts))
    if not languages:
        return Filters((), np.zeros((1, 1), np.uint64), np.zeros(0))
    share = max(1, rows // min(len(languages), WORD_BITS))
    index = {lang: i for i, lang in enumerate(languages)}
    known = docs.sparkSession.createDataFrame([(r["lang"], index[r["lang"]], min(1.0, share / r["count"])) for r in counts], "own string, l long, rate double")
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # One row per language, collected above.
    sample = labelled.join(F.broadcast(known), F.col("lang") == F.col("own")).where(draw < F.col("rate")).select("l", "text")

    def make():
        np.seterr(over="ignore")

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            own = batch.column(0).to_numpy()
            for chunk in chunks(batch.column(1)):
                for grams, first in ngrams(chunk):
                    lang = np.repeat(own[chunk.first : chunk.first + chunk.n], np.diff(first))
                    for l in np.unique(lang):
                        values, n = np.unique(grams[lang == l], return_counts=True)
                        yield {"gram": values.view(np.int64), "l": np.full(len(n), l), "n": n}

        return step

    seen = map_arrow(sample, make, "gram long, l int, n long").groupBy("gram", "l").agg(F.sum("n").alias("n"))
    seen = seen.where(F.col("n") >= MIN_COUNT).toPandas()
    total = np.bincount(seen["l"], weights=seen["n"], minlength=len(languages))
    seen["rate"] = seen["n"] / total[seen["l"]]
    seen = seen[seen["rate"] >= MIN_SHARE * seen.groupby("gram")["rate"].transform("max")]
    size = 1 << max(10, int(np.ceil(np.log2(16 * max(1, seen["gram"].nunique())))))
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slots = np.zeros((-(-len(languages) // WORD_BITS), size), dtype=kind)
    with np.errstate(over="ignore"):
        grams = seen["gram"].to_numpy().view(np.uint64)
        word, bit = np.divmod(seen["l"].to_numpy(), WORD_BITS)
        for at in _slots(grams, size):
            np.bitwise_or.at(slots, (word, at), (np.uint64(1) << bit.astype(np.uint64)).astype(kind))
    fill = np.array([((slots[l // WORD_BITS] >> kind(l % WORD_BITS)) & kind(1)).mean() for l in range(len(languages))])
    return Filters(languages, slots, fill**HASHES)


def _votes(chunk: Chunk, filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Corrected hits per text and language, and n-grams per text."""
    hits = np.zeros((chunk.n, len(filters.languages)))
    total = np.zeros(chunk.n)
    kind = filters.slots.dtype.type
    for grams, first in ngrams(chunk):
        masks = None
        for at in _slots(grams, filters.slots.shape[1]):
            masks = [w[at] if masks is None else masks[k] & w[at] for k, w in enumerate(filters.slots)]
        n = np.diff(first)
        total += n
        for l in range(len(filters.languages)):
            running = np.concatenate([[0], np.cumsum((masks[l // WORD_BITS] >> kind(l % WORD_BITS)) & kind(1), dtype=np.int64)])
            raw = running[first[1:]] - running[first[:-1]]
            hits[:, l] += np.maximum(0, raw - n * filters.false_rate[l]) / (1 - filters.false_rate[l])
    return hits, total


def has_letter(text: bytes) -> bool:
    if any(97 <= c <= 122 or 65 <= c <= 90 for c in text[:64]):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def predict(docs: DataFrame, filters: Filters, names: tuple[str, str, str] = ("lang_pred", "score", "coverage")) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and coverage (0 to 1) added, called ``names``.

    ``score`` is the winner's share of all languages' corrected hits, and
    ``coverage`` the share of n-grams in its filter.  Null texts and texts
    without a letter are ``und`` with score and coverage 0; so is every text
    when no language was learned.  Ties go to the first language in code point
    order.  All other columns pass through; one called like an added column (in
    any case) is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slots, filters.false_rate))
    added = {n.lower() for n in names}
    passed = [f for f in docs.schema if f.name.lower() not in added]
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in passed) + f", {quoted(names[0])} string, {quoted(names[1])} double, {quoted(names[2])} double"
    place = [f.name for f in passed].index("text")

    def make():
        np.seterr(over="ignore")
        model = Filters(*held.value)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for chunk in chunks(batch.column(place).cast(pa.string())):
                part = batch.slice(chunk.first, chunk.n)
                names_out, score, cover = ["und"] * chunk.n, np.zeros(chunk.n), np.zeros(chunk.n)
                if model.languages:
                    hits, total = _votes(chunk, model)
                    best = hits.argmax(axis=1)
                    top = hits[np.arange(chunk.n), best]
                    score = np.minimum(1.0, top / np.maximum(hits.sum(axis=1), 1e-9))
                    cover = np.minimum(1.0, top / np.maximum(total, 1))
                    for i in range(chunk.n):
                        if has_letter(chunk.text(i)):
                            names_out[i] = model.languages[best[i]]
                        else:
                            score[i] = cover[i] = 0.0
                yield {f.name: part.column(i) for i, f in enumerate(passed)} | dict(zip(names, (names_out, score, cover)))

        return step

    return map_arrow(docs.select(*[F.col(quoted(f.name)) for f in passed]), make, schema)

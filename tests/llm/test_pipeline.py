"""The corpus pipeline against a plain version, and its stages on odd rows."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from millrace.llm import language, mixing
from millrace.llm.near_duplicates import Rule
from millrace.llm.queries import QUERIES, language_filters, tokenizer_path
from pyspark.sql import functions as F
from test_pairs import brute_components, brute_lines
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "coverage", "lang_pred", "line_count", "line_drops", "__th", "__id", "__bitmap", "id", "th", "times", "__n", "row", "taken", "size", "weight", "key", "line", "end_key", "kept", "component_id", "rep", "ids", "n_tokens", "a.b", "we`ird"]


# ---------------------------------------------------------------- a plain version of every stage


def plain_grams(text):
    raw = bytearray(b" " + text.encode() + b" ")
    for i, c in enumerate(raw):
        if c < 128:
            raw[i] = ord(chr(c).lower()) if chr(c).isalpha() else 32
        elif raw[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97:
            raw[i] = c + 0x20
    for order in (3, 5):
        yield [int.from_bytes(bytes([order]) + raw[i : i + order], "big") for i in range(len(raw) - order + 1) if raw[i] != 32 or raw[i + 1] != 32]


def plain_votes(text, filters):
    """Each language's corrected n-grams, from one slot lookup at a time, and the number of n-grams."""
    hits, total = [0.0] * len(filters.languages), 0
    for grams in plain_grams(text):
        total += len(grams)
        if grams:
            with np.errstate(over="ignore"):
                at = list(language._slots(np.array(grams, dtype=np.uint64), filters.slots.shape[1]))
            for lang in range(len(hits)):
                raw = sum(all(int(filters.slots[lang // 64][slots[i]]) >> (lang % 64) & 1 for slots in at) for i in range(len(grams)))
                false = filters.false_rate[lang]
                hits[lang] += max(0, raw - len(grams) * false) / (1 - false)
    return hits, total


def plain_coverage(text, filters):
    hits, total = plain_votes(text, filters)
    return min(1.0, max(hits) / max(total, 1))


def test_op8_equals_a_plain_version(spark):
    filters = language_filters(spark, SF)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op8_language"](spark, SF).collect():
        text = texts[r.doc_id] or ""
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        hits, total = plain_votes(text, filters)
        assert r.lang_pred == filters.languages[hits.index(max(hits))]
        assert r.score == pytest.approx(max(hits) / sum(hits)) and r.coverage == pytest.approx(min(1.0, max(hits) / total))


def plain_language(rows, filters):
    return [r for r in rows if any(map(str.isalpha, r[1] or "")) and plain_coverage(r[1], filters) >= corpus_pipeline.LEAST_COVERAGE]


def plain_lines(rows):
    done = {i: t for i, _, _, t in brute_lines([(r[0], r[1]) for r in rows])}
    return [(r[0], done[r[0]], *r[2:4], len(done[r[0]])) for r in rows]


def plain_near(rows):
    groups = brute_components([(r[0], r[1]) for r in rows], Rule(5, 80, 100))
    return [r for r in rows if groups[r[0]][1] == r[0]]


def plain_mix(rows):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        level = left / max(sum(weight[s] for s in open_), 1)
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    out = []
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, ahead, keyed = target[s] - epochs * total[s], 0, []
        for r in (r for r in rows if r[3] == s):
            t = r[1] or ""
            share = len(t.translate(str.maketrans("", "", "#*$%&|<>"))) / len(t) if t else 1.0
            u = (int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            keyed.append((-math.log(u) / max(0.0625, share**4), r))
        for _, r in sorted(keyed):
            n = size[r[0]]
            out += [r] * (epochs + (ahead + n / 2 <= rest) if n else 0)
            ahead += n
    return out


def plain_bpe(rows):
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    out = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        out.append((r[0], len(ids), tuple(ids), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_run_equals_the_plain_pipeline(spark):
    """Stage by stage, each on what the plain version of the one before kept, and the whole run."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    filters = language_filters(spark, SF)
    plain = {"language_id": lambda r: plain_language(r, filters), "line_dedup": plain_lines, "near_dedup": plain_near, "mixing": plain_mix}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, spark.createDataFrame(rows, DOCS), SF)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = plain[name](rows)
        assert rows and Counter(map(tuple, got.collect())) == Counter(rows), name
    want = Counter(plain_bpe(rows))
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == want


# ---------------------------------------------------------------- odd rows


def odd_rows():
    line = "a line that many documents share, of more than forty characters"
    text = "the words of this text are in the language that the filters have learned and "
    rows = [(i, f"{text}{i}\n{line}", "en", "abc"[i % 3], i) for i in range(12)]
    rows += [(3, text * 3, "en", None, 1), (3, text * 3, "en", None, 1), (3, line, None, "a", 2), (None, f"{text}x\n{line}", "en", "a", 3), (None, text * 2, None, None, None)]
    return rows + [(50, None, None, None, None), (51, "", "", "", 0), (52, " \n\t", "en", "a", 3), (53, "x" * 200_000, "en", "b", 1), (54, (text + "\n") * 3000, "fr", "c", 2), (55, "🙂 İ ſ K\x00", "en", "a", 4)]


@pytest.mark.parametrize("k", range(4), ids=[n for n, _ in corpus_pipeline.STAGES[:4]])
def test_stages_keep_rows_and_columns_whatever_their_names(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    rows = odd_rows()
    plain = spark.createDataFrame(rows, DOCS)
    docs = plain
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("source"), F.lit("none"))))
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    out = got.collect()
    assert all(r[5 + i] == f"{i}:{'none' if r.source is None else r.source}" for r in out for i in range(len(CLASHES)))
    same = Counter(tuple(r)[:5] for r in stage(spark, plain, SF).collect())
    assert Counter(tuple(r)[:5] for r in out) == same
    ids = Counter(r[0] for r in same.elements())
    if name == "language_id":
        assert ids[None] == 2 and ids[3] == 4 and not {50, 51, 52, 53} & set(ids)
    elif name == "line_dedup":
        # The line is in ids 0 to 11 (12 documents): id 11 keeps it, rows without id lose nothing.
        assert sum(same.values()) == len(rows)
        held = Counter(r[0] for r in same.elements() if r[1] and "many documents share" in r[1])
        assert held == {11: 1, None: 1}
        assert next(r for r in same if r[0] == 50)[1] is None
    elif name == "near_dedup":
        assert ids[None] == 2 and ids[50] == ids[51] == ids[52] == 1 and ids[0] == 1
        assert set(same) <= set(rows)
    else:
        assert set(same) <= set(rows) and max((n / rows.count(r) for r, n in same.items()), default=0) <= 2 and ids[None] and not {50, 51, 52} & set(ids)


def test_stages_on_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_bpe_stage_on_odd_rows(spark):
    rows = odd_rows()
    got = corpus_pipeline.bpe_stage(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in got) == Counter(plain_bpe(rows))


def test_mix_stage_emits_each_row_as_often_as_it_is_taken(spark):
    rows = [(None if i % 5 == 0 else i // 2, f"{'word ' * (1 + i % 7)}t{i}", "en", "abc"[i % 3] if i % 11 else None, i) for i in range(120)]
    rows += [(3, "one text", "en", "a", 1), (3, "one text", "en", "a", 2), (None, None, "en", "a", 3), (None, "", None, "b", 4)]
    docs = spark.createDataFrame(rows, DOCS)
    out = corpus_pipeline.mix_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter(map(tuple, out.collect()))
    assert set(got) <= set(rows) and max(got.values()) <= 2 and any(r[0] is None for r in got)
    taken = Counter()
    for r in mixing.mix_sources(docs).collect():
        taken[r.doc_id, r.source, r.size] += r.taken
    emitted = Counter()
    for (doc_id, text, _, source, _), n in got.items():
        emitted[doc_id, source, len(text.split())] += n * len(text.split())
    assert emitted == +taken

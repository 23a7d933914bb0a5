"""Near duplicates, line dedup and embeddings against brute force."""

import hashlib
import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from millrace.llm import embeddings, line_dedup, near_duplicates
from millrace.llm._graph import components
from millrace.llm.near_duplicates import Rule

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs_frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*(w[i:] for i in range(k))))


def brute_components(texts, rule):
    sets = {i: shingles(t, rule.shingle) for i, t in texts}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        n = len(x & y)
        if x and y and rule.denominator * n >= rule.numerator * (len(x) + len(y) - n):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def mutated(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(99))
    return w


def near_fixture():
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(rng.randrange(8, 160))]
        for _ in range(rng.randrange(1, 12)):
            rows.append((n, " ".join(mutated(rng, base, rng.randrange(0, 5)))))
            n += 1
    # A chain: neighbours are linked, the ends aren't.
    base = [f"w{i}" for i in range(120)]
    for k in range(8):
        rows.append((n, " ".join(base)))
        base = [*base[6:], *(f"c{k}{i}" for i in range(6))]
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One  word"), (n + 4, "one\nWORD"), (n + 5, "É é")]
    return rows


@pytest.mark.parametrize("rule", [Rule(3, 85, 100), Rule(5, 80, 100)])
def test_near_duplicates_match_brute_force(spark, rule):
    rows = near_fixture()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs_frame(spark, rows), rule).collect()}
    assert got == brute_components(rows, rule)


def test_hubs_pairs_are_dealt_over_tasks(spark, monkeypatch):
    """One document near hundreds of others: its pairs are joined in parts, with the same links."""
    monkeypatch.setattr(near_duplicates, "HUB_PAIRS", 16)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(range(1, 100))]
    rows = [(0, " ".join(base))] + [(i + 1, t) for i, t in rows]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs_frame(spark, rows)).collect()}
    assert got == brute_components(rows, Rule())


def test_near_duplicates_large_buckets(spark, monkeypatch):
    """Blocks of a few members give the links that pairs give."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    monkeypatch.setattr(near_duplicates, "SMALL_BUCKET", 3)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 150)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(mutated(rng, base, rng.randrange(0, 7)))) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs_frame(spark, rows), Rule(3, 85, 100)).collect()}
    assert got == brute_components(rows, Rule(3, 85, 100))


def test_near_duplicates_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "x"), (1, text, "y"), (2, text + " more", "x"), (None, text, None), (7, "a b " * 40000, "x"), (8, "a b " * 40000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    out = sorted(near_duplicates.near_duplicates(df).collect(), key=str)
    assert len(out) == 6
    by = {r.doc_id: (r.component_id, r.kept) for r in out}
    assert by == {1: (1, True), 2: (1, False), None: (None, True), 7: (7, True), 8: (7, False)}
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (5, 5), (3, 4), (4, 3), (None, 2)] + [(20, 21 + i) for i in range(50)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 1: 1, 5: 5, 3: 3, 4: 3, 20: 20, **{21 + i: 20 for i in range(50)}}
    assert components(edges.limit(0)).count() == 0


# ---------------------------------------------------------------- lines


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                held.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def line_fixture():
    rng = random.Random(3)
    common = [f"This line is shared by many of the documents, number {i} of them" for i in range(40)]
    rows = []
    for i in range(120):
        lines = [rng.choice(common) for _ in range(rng.randrange(0, 6))] + [f"own line of document {i} with enough characters in it"] * rng.randrange(0, 3) + ["short"]
        rng.shuffle(lines)
        lines = [x.upper() if rng.random() < 0.2 else " \t" + x + "\r" if rng.random() < 0.2 else x for x in lines]
        rows.append((i, "\n".join(lines)))
    edge = "é" * 40
    return rows + [(200 + i, edge) for i in range(5)] + [(300 + i, "é" * 39) for i in range(5)] + [(None, common[0]), (400, None), (401, ""), (402, "\n\n")]


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_line_dedup_matches_brute_force(spark, parts):
    rows = line_fixture()
    df = docs_frame(spark, rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(((r.doc_id, r.line_count, r.line_drops, r.text or "") for r in line_dedup.line_dedup(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute_lines(rows)


def test_line_dedup_hot_key_spans_tasks(spark):
    """One line in every document, over more range partitions than it has neighbours."""
    line = "the very same line stands in each of these many documents"
    rows = [(i, f"{line}\nunique line number {i} that is also long enough to count") for i in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.doc_id: r.line_drops for r in line_dedup.line_dedup(docs_frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {i: int(i != 399) for i in range(400)}


def test_line_dedup_repeated_rows_and_extra_columns(spark):
    line = "a line of at least forty characters for the test of rows"
    rows = [(i, line, i) for i in range(5)] + [(2, line + "\n" + line, 9), (2, line, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int")
    got = sorted((r.doc_id, r.pos, r.line_drops) for r in line_dedup.line_dedup(df).collect())
    assert got == [(0, 0, 1), (1, 1, 1), (2, 2, 1), (2, 2, 1), (2, 9, 2), (3, 3, 1), (4, 4, 0)]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


# ---------------------------------------------------------------- embeddings


def brute_links(rows, least=0.93):
    unit = []
    for i, v, label in rows:
        ok = v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, dtype=float) / np.linalg.norm(v) if ok else None)
    links = Counter()
    up = {i: i for i, _, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (x, a), (y, b) in itertools.combinations(list(enumerate(rows)), 2):
        if unit[x] is not None and unit[y] is not None and a[2] == b[2] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= least:
            links[a[0]] += 1
            links[b[0]] += 1
            p, q = root(a[0]), root(b[0])
            up[max(p, q)] = min(p, q)
    return {i: (links[i], root(i)) for i, _, _ in rows}


def embedding_fixture(n=900, dim=16):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(60)] + rng.normal(size=dim) * rng.choice([0.05, 0.25, 0.6])
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(2))))
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(4)]
    rows += [(n + 10, None, 0), (n + 11, [0.0] * dim, 0), (n + 12, [1.0, None] + [0.0] * (dim - 2), 0), (n + 13, [float("nan")] * dim, 0), (n + 14, [float("inf")] + [0.0] * (dim - 1), 0), (n + 15, rows[0][1], None), (n + 16, rows[0][1][:5], rows[0][2])]
    return rows


def test_embeddings_are_exact_without_splits(spark):
    rows = embedding_fixture(300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_embeddings(df).collect()}
    assert got == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in embeddings.near_embeddings(df).collect())


def test_embedding_forest_recall(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 64)
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    rows = embedding_fixture()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.near_embeddings(df).collect()}
    want = {i: n for i, (n, _) in brute_links(rows).items()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())


def test_large_leaves_are_split_again(spark, monkeypatch):
    """Trees fitted on few vectors give large leaves; those get trees of their own, until they are small."""
    for name, value in {"LEAF": 16, "MAX_LEAF": 64, "FIT_LEAF": 200, "ROUTED": 100, "BLOCK": 50}.items():
        monkeypatch.setattr(embeddings, name, value)
    rows = embedding_fixture()
    rows += [(2000 + i, [1.0] + [0.0] * 15, 0) for i in range(150)]  # one class
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    seen = []
    refined = embeddings._refined

    def spy(indexed, kind, trees):
        out = refined(indexed, kind, trees)
        seen.append([max(r["count"] for r in x.groupBy("part", "leaf").count().collect()) for x in (indexed, out)])
        twice = out.groupBy("part", "leaf", "rep").count().where("count > 1").count()
        assert twice == 0 and out.select("rep").distinct().count() == indexed.select("rep").distinct().count()
        return out

    monkeypatch.setattr(embeddings, "_refined", spy)
    for bound in (100, 0):  # few vectors for the first trees, and no first trees at all
        got = {r.vec_id: r.n_links for r in embeddings.near_embeddings(df, bound=bound).collect()}
        want = {i: n for i, (n, _) in brute_links(rows).items()}
        assert all(got[i] <= want[i] for i in want)
        assert sum(got.values()) >= 0.9 * sum(want.values())
    assert all(before > 64 >= after for before, after in seen), seen


def test_vectors_that_no_line_parts_stay_one_leaf(spark, monkeypatch):
    for name, value in {"LEAF": 4, "MAX_LEAF": 8, "BLOCK": 7}.items():
        monkeypatch.setattr(embeddings, name, value)
    rows = [(i, [float(i + 1), 0.0], 0) for i in range(40)]  # different classes, one direction
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in embeddings.near_embeddings(df, bound=0).collect()} == {(39, 0)}


def test_vectors_travel_once_for_a_tree(spark, monkeypatch):
    """A pass moves each class once, however many trees there are; a group that every cut would part stays whole."""
    for name, value in {"LEAF": 32, "MAX_LEAF": 64, "BLOCK": 50, "PASS_BYTES": 1}.items():
        monkeypatch.setattr(embeddings, name, value, raising=False)
    rows = embedding_fixture()
    rng = np.random.default_rng(2)
    rows += [(2000 + i, [float(x) for x in np.float32([9.0] + [0.0] * 15 + 0.01 * rng.normal(size=16))], 1) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    seen = []
    compare = embeddings._compare

    def spy(indexed, *rest):
        seen.append((indexed.count(), indexed.select("rep").distinct().count()))
        return compare(indexed, *rest)

    monkeypatch.setattr(embeddings, "_compare", spy)
    got = {r.vec_id: r.n_links for r in embeddings.near_embeddings(df, bound=600).collect()}
    assert seen and all(moved == classes for moved, classes in seen), seen
    want = {i: n for i, (n, _) in brute_links(rows).items()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())
    assert all(got[2000 + i] >= 119 for i in range(120))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1", "/root/testdata/check_s"])
def test_recall_on_the_real_tables(spark, folder):
    """All links of a table by brute force, label by label: at least 0.99 of them are found, and none besides."""
    if not os.path.isdir(folder):
        pytest.skip(f"no {folder}")
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in embeddings.near_embeddings(table).collect()}
    rows = table.select("vec_id", "embedding", "label").collect()
    found = total = 0
    for label in {r.label for r in rows if r.label is not None}:
        own = [r for r in rows if r.label == label and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
        unit = np.array([r.embedding for r in own], dtype=np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        for at in range(0, len(own), 1000):
            n = (unit[at : at + 1000] @ unit.T >= 0.93).sum(axis=1) - 1
            for r, k in zip(own[at : at + 1000], n.tolist()):
                assert got[r.vec_id] <= k
                found, total = found + got[r.vec_id], total + k
    assert found >= 0.99 * total and (total or "check" not in folder)  # sf0.1 holds no links at all


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_embeddings(df).count() == 0


def test_op4_on_the_smallest_tables(spark):
    from millrace.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_near_duplicates"](spark, SF).collect()}
    assert got == brute_components(rows, Rule(3, 85, 100))


def test_op10_and_op1_match_sql(spark):
    import duckdb
    from millrace.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name in ORACLES:
        a, b = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
        names = sorted(a.columns)
        assert names == sorted(b.columns)
        a, b = (x[names].sort_values("doc_id").reset_index(drop=True) for x in (a, b))
        assert (a == b).all().all(), name


def test_op10_digest(spark):
    from millrace.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows)}
    assert {tuple(r) for r in QUERIES["op10_line_dedup"](spark, SF).collect()} == want

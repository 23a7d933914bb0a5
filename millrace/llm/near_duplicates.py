"""MinHash near-duplicate groups by min-max hashing (operator 4).

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so the signature costs half the hash evaluations.  Values are
banded; documents that share a band are candidates, and every link is
confirmed on the whole shingle sets.

No step emits all pairs of a group:

1. documents with equal shingle sets form one class (aggregated before the
   shuffle), and only classes are compared;
2. in each band bucket every class is compared with the bucket's smallest
   class only, one row per member;
3. components of those confirmed links settle most buckets.  What remains,
   buckets that still hold several components, is compared exhaustively across
   components: small buckets as pairs, large ones in blocks of ``BLOCK``
   members by counting shared shingles with matrix products inside a task,
   which returns only links that join components.

A pair is handled in the bucket of the first band it shares, and skipped only
if its 96-value signature estimate is over six standard deviations below the
threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._stage import map_arrow, settle, ship
from ._text import Chunk, chunks, mix

ROWS, BANDS = 4, 24
VALUES = ROWS * BANDS
BLOCK = 2048
#: A block's shingles, so that long texts make smaller blocks.
BLOCK_SHINGLES = 2_000_000
SMALL_BUCKET = 64
#: Pairs of one document beyond which they are dealt over several tasks, each with a copy of its text.
HUB_PAIRS = 4096


@dataclass(frozen=True)
class Rule:
    """Shingle length in words and the Jaccard threshold as a fraction."""

    shingle: int = 5
    numerator: int = 80
    denominator: int = 100

    def linked(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.denominator * shared >= self.numerator * (a + b - shared)

    @property
    def smallest(self) -> int:
        """Below this set size only equal sets can be linked: n shared of n + 1 is too little."""
        if self.numerator >= self.denominator:
            return 1 << 60
        n = 1
        while self.denominator * n < self.numerator * (n + 1):
            n += 1
        return n

    @property
    def least_matches(self) -> int:
        p = self.numerator / self.denominator
        return int(np.floor(VALUES * p - 6 * np.sqrt(VALUES * p * (1 - p))))


def _permutations() -> np.ndarray:
    """Odd multipliers from a fixed seed; an odd multiplier permutes the 64-bit integers."""
    return np.random.default_rng(20240229).integers(0, 2**63, size=VALUES // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(chunk: Chunk, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text.

    Fewer than k words: the whole sequence as one shingle; no words: empty.
    """
    low = chunk.lower()
    starts, ends, first = low.words()
    h = low.range_hash(starts, ends)
    rolled = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled = mix(rolled * np.uint64(0x100000001B3) + h[j : len(h) - k + 1 + j], 1)
    for i in range(chunk.n):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = mix(np.array([one * np.uint64(0x100000001B3) + x]), 2)[0]
            yield np.array([one], dtype=np.uint64)
        else:
            yield h[:0]


def _signature(sets: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    low = np.full(len(multipliers), 2**64 - 1, dtype=np.uint64)
    high = np.zeros(len(multipliers), dtype=np.uint64)
    for at in range(0, len(sets), 4096):
        part = sets[None, at : at + 4096] * multipliers[:, None]
        part ^= part >> np.uint64(29)
        np.minimum(low, part.min(axis=1), out=low)
        np.maximum(high, part.max(axis=1), out=high)
    return np.concatenate([low, high])


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig, bands) per row; bands is null where only equal sets can be linked."""
    k, smallest = rule.shingle, rule.smallest

    def make():
        np.seterr(over="ignore")
        multipliers = _permutations()

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1)):
                n, f1, f2, sig, bands = [], [], [], [], []
                for s in shingle_sets(chunk, k):
                    n.append(len(s))
                    f1.append(int(mix(s, 11).sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(mix(s, 12).sum(dtype=np.uint64).view(np.int64)))
                    if len(s) < smallest:
                        sig.append(None)
                        bands.append(None)
                        continue
                    values = _signature(s, multipliers)
                    band = np.arange(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        band = mix(band * np.uint64(0x100000001B3) + values[r * BANDS : (r + 1) * BANDS], 21)
                    sig.append((values >> np.uint64(7)).astype(np.uint8).tobytes())
                    bands.append(band.view(np.int64))
                yield {"doc_id": ids.slice(chunk.first, chunk.n), "n_shingles": n, "f1": f1, "f2": f2, "sig": sig, "bands": bands}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, make, "doc_id long, n_shingles long, f1 long, f2 long, sig binary, bands array<long>")


def _linked_pairs(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Of candidate pairs (a, b), those whose whole shingle sets meet the threshold.

    A hub's pairs are salted, and its text is copied once per ``HUB_PAIRS`` of
    them; all others share one exchange of the texts.  The hubs are a small
    table: each stands for that many pairs.
    """
    pairs = settle(pairs)
    hubs = settle(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_PAIRS).select("a", F.ceil(F.col("n") / HUB_PAIRS).cast("int").alias("copies")))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    if hubs.isEmpty():
        begun = pairs.join(left, "a")
    else:
        salted = pairs.join(hubs, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"))
        copied = left.join(hubs, "a").select("a", "ta", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
        begun = pairs.join(hubs, "a", "left_anti").join(left, "a").select("a", "b", "ta").unionByName(salted.join(copied, ["a", "salt"]).select("a", "b", "ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def make():
        np.seterr(over="ignore")

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            # One pair at a time in memory beyond the batch itself.
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            keep = np.zeros(len(a), dtype=bool)
            at = 0
            for ca in chunks(batch.column(2)):
                other = batch.column(3).slice(ca.first, ca.n)
                sets_b = (s for cb in chunks(other) for s in shingle_sets(cb, rule.shingle))
                for sa, sb in zip(shingle_sets(ca, rule.shingle), sets_b):
                    shared = len(np.intersect1d(sa, sb, assume_unique=True))
                    keep[at] = len(sa) > 0 and len(sb) > 0 and rule.linked(shared, len(sa), len(sb))
                    at += 1
            yield {"a": a[keep], "b": b[keep]}

        return step

    return map_arrow(begun.join(right, "b").select("a", "b", "ta", "tb"), make, "a long, b long").distinct()


class _Union:
    def __init__(self, labels: list) -> None:
        self.up = {x: x for x in labels}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _candidates(sig: np.ndarray, bands: np.ndarray, n: np.ndarray, comp: np.ndarray, band: int, rule: Rule, i: int, js: np.ndarray) -> np.ndarray:
    """Of members ``js``, those that member i must be compared with in this bucket."""
    a, b = np.minimum(n[i], n[js]), np.maximum(n[i], n[js])
    js = js[(comp[js] != comp[i]) & (rule.denominator * a >= rule.numerator * b)]
    js = js[(bands[js] == bands[i]).argmax(axis=1) == band]
    return js[(sig[js] == sig[i]).sum(axis=1) >= rule.least_matches]


def _members(table: pa.Table) -> tuple:
    rep = table.column("rep").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, VALUES)
    bands = np.array(table.column("bands").to_pylist(), dtype=np.int64).reshape(-1, BANDS)
    return rep, table.column("n").to_numpy(), table.column("comp").to_numpy(), sig, bands


def _small_buckets(members: DataFrame, rule: Rule) -> DataFrame:
    """Candidate pairs inside buckets of at most ``SMALL_BUCKET`` members."""
    ship(members.sparkSession)

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        rep, n, comp, sig, bands = _members(table)
        band = int(table.column("band")[0].as_py())
        out = []
        for i in range(len(rep)):
            for j in _candidates(sig, bands, n, comp, band, rule, i, np.arange(i + 1, len(rep))):
                out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return members.groupBy("bucket").applyInArrow(pairs, "a long, b long").distinct()


def _large_buckets(members: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links across components inside larger buckets, found block against block."""
    ship(members.sparkSession)
    loads = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("here"), F.sum("n").alias("load"))
    blocks = F.ceil(F.greatest(F.col("here") / BLOCK, F.col("load") / BLOCK_SHINGLES)).cast("int")
    dealt = members.join(loads, "bucket").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("p", F.least("mine", "other")).withColumn("q", F.greatest("mine", "other"))
    dealt = dealt.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").select("bucket", "p", "q", "mine", "band", "rep", "n", "comp", "sig", "bands", "text")

    def links(key: tuple, table: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        rep, n, comp, sig, bands = _members(table)
        mine = table.column("mine").to_numpy()
        band, p, q = int(table.column("band")[0].as_py()), key[1].as_py(), key[2].as_py()
        sets = [s for c in chunks(table.column("text")) for s in shingle_sets(c, rule.shingle)]
        shared = _shared_counts(sets)
        size = np.array([len(s) for s in sets])
        union, found = _Union(list(set(comp.tolist()))), []
        at = np.arange(len(rep))
        for i in range(len(rep)):
            js = at[i + 1 :] if p == q else at[(mine == q)] if mine[i] == p else at[:0]
            js = _candidates(sig, bands, n, comp, band, rule, i, js)
            for j in js[rule.linked(shared[i, js], size[i], size[js])]:
                if union.join(int(comp[i]), int(comp[j])):
                    found.append((int(rep[i]), int(rep[j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.groupBy("bucket", "p", "q").applyInArrow(links, "a long, b long").distinct()


def _shared_counts(sets: list[np.ndarray], width: int = 1024) -> np.ndarray:
    """How many shingles each two sets share: products of 0/1 matrices, ``width`` shingles at a time."""
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    if not sets:
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    keep = counts[ids] > 1
    owner, ids = owner[keep], place[ids[keep]]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        lo, hi = np.searchsorted(ids, (at, at + width))
        dense = np.zeros((len(sets), width), dtype=np.float32)
        dense[owner[lo:hi], ids[lo:hi] - at] = 1
        out += dense @ dense.T
    return out


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id, n_shingles, component_id (smallest
    doc_id reachable by links, itself included), kept (doc_id = component_id).

    Null or empty texts, and texts without words, have no shingles and are
    linked with nothing.  Rows that share a doc_id count as one document: a
    link of any of them links the id, and they share its verdict.  Rows with a
    null doc_id are linked with nothing: component_id null, kept true.  An
    empty table gives an empty result.
    """
    marks = settle(signatures(docs, rule))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = marks.where("n_shingles > 0 and doc_id is not null")
    classes = settle(
        known.groupBy("f1", "f2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .select("f1", "f2", F.col("n_shingles").alias("n"), "rep", "sig", "bands")
    )

    dealt = classes.where("bands is not null").select("rep", F.posexplode("bands").alias("band", "bucket"))
    hubs = dealt.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = settle(dealt.join(hubs, "bucket"))
    stars = shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    first = settle(_linked_pairs(stars, texts, rule))

    labels = components(first)
    members = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    open_buckets = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    rest = members.join(open_buckets, "bucket").select("bucket", "band", "size", "rep", "comp")
    rest = settle(rest.join(classes.select("rep", "n", "sig", "bands"), "rep"))
    more = _linked_pairs(_small_buckets(rest.where(F.col("size") <= SMALL_BUCKET), rule), texts, rule)
    more = more.unionByName(_large_buckets(rest.where(F.col("size") > SMALL_BUCKET), texts, rule))

    # An id may stand for several classes when rows repeat it; the class table's self loops tie them.
    own = known.select("f1", "f2", "n_shingles", F.col("doc_id")).join(classes.select("f1", "f2", F.col("n").alias("n_shingles"), "rep"), ["f1", "f2", "n_shingles"])
    repeated = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("doc_id")
    ties = own.join(repeated, "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # Only what joins components of the first links is contracted again.
    extra = more.unionByName(ties.distinct())
    for end in ("a", "b"):
        to = labels.select(F.col("node").alias(end), F.col("component").alias("to"))
        extra = extra.join(to, end, "left").withColumn(end, F.coalesce("to", end)).select("a", "b")
    groups = components(settle(extra)).select(F.col("node").alias("comp"), F.col("component").alias("whole"))

    named = classes.select("f1", "f2", F.col("n").alias("n_shingles"), "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    named = named.join(groups, "comp", "left").select("f1", "f2", "n_shingles", F.coalesce("whole", "comp").alias("component_id"))
    linked = marks.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"])
    alone = marks.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

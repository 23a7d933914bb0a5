"""Mixing sources to target weights (operator 1), in DataFrame operations only.

Efraimidis-Spirakis sampling: each document draws a uniform number u from a
hash of its id and gets the key -ln(u) / w for quality weight w; taking
documents by ascending key is weighted sampling without replacement.  A
source's token budget is met by complete epochs first, then by the documents
with the smallest keys until the rest of the budget is filled.

The prefix sums over keys need no sort of a whole source: keys fall into
ordered bins, bins are summed before the shuffle, and the one bin per source in
which the budget runs out is cut into bins again, by key and, among equal keys,
by text and row, until it holds few rows.  Only those are sorted.  So no task
sees more than some thousand rows in order, however the weights bunch the keys
and however many rows share an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import quoted, settle

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a bin aims at, and bins of a source in one round.
BIN_ROWS, MAX_BINS = 1024, 1 << 16
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, salt: str) -> Column:
    """A uniform number in (0, 1) from 52 bits of the id's MD5."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def text_quality(text: Column) -> Column:
    """Weight in [1/16, 1]: the fourth power of the share of characters that are not ``#*$%&|<>``."""
    share = F.length(F.translate(text, "#*$%&|<>", "")) / F.length(text)
    share = F.when(F.length(text) > 0, share).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.0625), share * share * share * share)


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, source_size, n_docs), one row per source.

    Sources in code point order, null last, weigh 5, 2, 1, repeating, and share
    150 % of all sizes; a target stops at twice its source's size and the
    excess is reshared by weight until none is above.  The fixed point is a
    water level: with sources ordered by cap / weight, the first k are capped,
    the others get weight times level, where level = (all - caps) / weights.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", (F.lit(MOST) * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (
        rows.withColumn("budget", F.lit(SHARE) * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(onward))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
    )
    # The level of the first source that isn't capped holds for all that follow.
    fits = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    rows = rows.withColumn("final", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return rows.select("source", "source_size", "n_docs", target.alias("target"))


def mix_sources(docs: DataFrame, weight: Column | None = None, salt: str = "mix:", carry: bool = False) -> DataFrame:
    """What a mix of ``docs`` (doc_id, text, source) takes from every document.

    Returns one row per input row: doc_id, source, size, source_size, target,
    weight, taken; with ``carry`` also ``row``, the input row as a struct, so
    that rows without an id and rows sharing one keep their own count.
    ``taken`` counts words with repeats: a document is taken
    whole ``floor(target / source_size)`` times, and once more if, in key
    order, at least half of it fits the rest of the budget; so a source's taken
    words differ from its target by at most half the document at the cut, and
    nothing is taken more than twice.

    Null texts and texts without words have size 0 and nothing is taken of
    them; a source without words has target 0.  Null sources are one source.
    Rows with equal keys (rows repeating a doc_id, null ids) are ordered by
    their text's hash; equal texts come in the order of reading.
    A null or non-positive weight counts as the smallest, 1/16.
    """
    quality = F.greatest(F.coalesce(weight if weight is not None else text_quality(F.col("text")), F.lit(0.0)), F.lit(0.0625))
    whole = [F.col(quoted(c)) for c in docs.columns]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        quality.alias("weight"),
        F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("line"),
        *([F.struct(*whole).alias("row")] if carry else []),
    )
    # Texts are read once; what follows works on these few numbers a document (and carries its row along, if asked to).
    rows = settle(rows.withColumn("key", -F.ln(uniform(F.col("doc_id"), salt)) / F.col("weight")))

    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    # One row per source; joined without a hint, so that Spark broadcasts it only where its size allows.
    sources = settle(sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    ends = last_documents(rows, sources)
    placed = _with(_with(rows, sources.drop("n_docs")), ends)
    at, end = F.struct("key", "tie", "line"), F.struct("end_key", "end_tie", "end_line")
    more = F.coalesce((at < end) | ((at == end) & F.col("end_fits")), F.lit(False)).cast("long")
    what = ["doc_id", "source", "size", "source_size", "target", "weight"] + (["row"] if carry else [])
    return placed.select(*what, ((F.col("epochs") + more) * F.col("size")).alias("taken"))


def _with(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of one row per source."""
    return rows.join(per_source.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")), "left").drop("own")


def last_documents(rows: DataFrame, sources: DataFrame, bin_rows: int | None = None) -> DataFrame:
    """Where each source's rest of the budget runs out, in the order of (key, tie, line).

    Returns (source, end_key, end_tie, end_line, end_fits): the first document
    with which the running size exceeds ``rest``, and whether at least half of
    it fits.  Sources without a rest have no row.
    """
    aim = bin_rows or BIN_ROWS
    bins = F.greatest(F.lit(2), F.least(F.ceil(F.col("n") / F.lit(aim)), F.lit(MAX_BINS)))
    left = _with(rows.where("size > 0").select("source", "key", "tie", "line", "size"), sources.where("rest > 0").select("source", "rest", F.col("n_docs").alias("n")))
    # 1 - exp(-key) is monotone in the key and spreads the keys of weight 1 evenly over (0, 1).
    left = left.where("rest is not null").withColumn("below", F.lit(0.0)).withColumn("place", F.lit(1.0) - F.exp(-F.col("key")))
    while True:
        left = left.withColumn("bin", F.least(F.floor(F.col("place") * bins), bins - 1))
        sums = left.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.max("rest").alias("rest"), F.max("below").alias("below"))
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("through", F.col("below") + F.sum("bin_size").over(upto)).where(F.col("through") > F.col("rest"))
        first = F.min_by(F.struct("bin", (F.col("through") - F.col("bin_size")).alias("below")), "bin")
        cut = sums.groupBy("source").agg(first.alias("cut")).select("source", F.col("cut.bin").alias("cut_bin"), F.col("cut.below").alias("cut_below"))
        left = settle(_with(left, cut).where("bin = cut_bin").select("source", "key", "tie", "line", "size", "rest", F.col("cut_below").alias("below")))
        tie = F.col("tie").cast("double")
        spans = left.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in ("key", "line") for f, n in ((F.min, "lo"), (F.max, "hi"))], F.min(tie).alias("tie_lo"), F.max(tie).alias("tie_hi"))
        if (spans.agg(F.max("n")).first()[0] or 0) <= 4 * aim:
            break
        # Bins between the least and the greatest value left, of the first of key, text and line that has two.
        part = lambda value, name: F.when(F.col(f"{name}_lo") < F.col(f"{name}_hi"), (value - F.col(f"{name}_lo")) / (F.col(f"{name}_hi") - F.col(f"{name}_lo")))
        left = _with(left, spans).withColumn("place", F.coalesce(part(F.col("key"), "key"), part(tie, "tie"), part(F.col("line"), "line"), F.lit(0.0)))
        left = left.select("source", "key", "tie", "line", "size", "rest", "below", "n", "place")
    order = Window.partitionBy("source").orderBy("key", "tie", "line").rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumn("ahead", F.col("below") + F.coalesce(F.sum("size").over(order), F.lit(0))).where(F.col("ahead") + F.col("size") > F.col("rest"))
    fits = (F.col("ahead") + F.col("size") / 2 <= F.col("rest")).alias("fits")
    end = left.groupBy("source").agg(F.min(F.struct("key", "tie", "line", fits)).alias("end"))
    return settle(end.select("source", *[F.col(f"end.{c}").alias(f"end_{c}") for c in ("key", "tie", "line", "fits")]))


#: The same rows in DuckDB SQL; sources are few, so the water level is found by one join.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN length(text) > 0 THEN length(translate(text, '#*$%&|<>', ''))::DOUBLE / length(text) ELSE 1.0 END AS share,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / greatest(0.0625, share * share * share * share) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS r, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
l AS (SELECT a.r, (any_value(a.budget) - coalesce(sum(CASE WHEN b.r < a.r THEN b.cap END), 0)) / sum(CASE WHEN b.r >= a.r THEN b.weight END) AS level FROM o a, o b GROUP BY a.r),
f AS (SELECT min(o.r) AS r FROM o JOIN l USING (r) WHERE level * weight < cap),
t AS (SELECT source, source_size, CASE WHEN o.r >= (SELECT r FROM f) THEN least(cap, weight * (SELECT level FROM l WHERE l.r = (SELECT r FROM f))) ELSE cap END AS target FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((epochs + (ahead + size / 2 <= rest)::BIGINT) * size)::BIGINT AS taken FROM p
"""

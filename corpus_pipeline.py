"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, language, line_dedup, mixing, near_duplicates
from millrace.llm._stage import free_names, quoted, settle
from millrace.llm.queries import language_filters, tokenizer_path

#: Below this share of known n-grams a text is in none of the learned languages.
LEAST_COVERAGE = 0.05


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that are in none of the learned languages.

    Null, empty and letterless texts go; every other row is judged by itself,
    so rows repeating a doc_id and rows without one stay or go by their text.
    The filters are learned from the ``documents`` of ``sf_dir``; without any
    labelled row there every row goes.  Ties between languages don't matter:
    only the best coverage counts.  Columns may have any names.
    """
    names = free_names(docs.columns, "lang_pred", "score", "coverage")
    told = language.predict(docs, language_filters(spark, sf_dir), names)
    return told.where((F.col(quoted(names[0])) != "und") & (F.col(quoted(names[2])) >= LEAST_COVERAGE)).select(*_own(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; n_chars follows the text (null: null), and no row goes.

    Rows sharing a doc_id count as one document; rows without one count nowhere
    and lose nothing; null texts stay null.  Of documents that hold a repeated
    line the largest doc_id keeps it, with every repeat inside that document.
    Columns may have any names.
    """
    done = line_dedup.line_dedup(docs, names=tuple(free_names(docs.columns, "line_count", "line_drops")))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*_own(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate group (five words, 80 %).

    Texts that are null, empty or without words, and rows without a doc_id, are
    in no group and stay.  Rows sharing a doc_id stay or go together.  Columns
    may have any names.
    """
    groups = near_duplicates.near_duplicates(docs)
    gone = settle(groups.where("not kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*_own(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it, zero to two times.

    Every row has its own count, whatever its doc_id; null sources are one
    source.  Rows without words are taken zero times: they add nothing to any
    source's words.  Ties are broken by text, then by order of reading.
    Columns may have any names.
    """
    mixed = mixing.mix_sources(docs, carry=True).where("taken > 0")
    times = F.expr("cast(taken div size as int)")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text's digest of every row.

    Rows come out one for one, repeats and rows without doc_id included; null
    and empty texts have no ids.
    """
    return bpe.encode(docs, tokenizer_path(), digests=False).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in docs.columns]


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("bpe", bpe_stage),
]

#: Language ID and near-dedup are beyond SQL; tests/llm/test_pipeline.py holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus queries: each applies one operator to its whole table with the contract's parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as _bpe
from . import embeddings as _embeddings
from . import language as _language
from . import line_dedup as _lines
from . import mixing as _mixing
from . import near_duplicates as _near
from . import pii as _pii
from . import quality as _quality
from . import secrets as _secrets
from . import toxicity as _toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold(divisor: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``divisor`` (null ids: null)."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return _mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics, base rules and the classifier's verdict on every document."""
    docs = _read(spark, sf_dir, "documents")
    return _quality.score(docs, _quality.fit(docs, _read(spark, sf_dir, "labels")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return _bpe.encode(_read(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups at three words and 85 %."""
    return _near.near_duplicates(_read(spark, sf_dir, "documents"), _near.Rule(3, 85, 100))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = _read(spark, sf_dir, "documents")
    return _secrets.scan(docs, _secrets.fit(docs))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return _pii.find_pii(_read(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate embeddings."""
    return _embeddings.near_embeddings(_read(spark, sf_dir, "embeddings"))


def language_filters(spark: SparkSession, sf_dir: str) -> _language.Filters:
    """Filters learned from the rows that are not held out."""
    return _language.fit(_read(spark, sf_dir, "documents").where(F.coalesce(fold(4), F.lit(0)) != 2))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    told = _language.predict(docs, language_filters(spark, sf_dir))
    return told.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows of fold 0 are never learned from."""
    docs = _read(spark, sf_dir, "documents")
    model = _toxicity.fit(docs, _read(spark, sf_dir, "labels"), F.coalesce(fold(5), F.lit(1)) != 0)
    told = _toxicity.score(docs, model)
    return told.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of what each document keeps."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    done = _lines.line_dedup(docs)
    return done.select("doc_id", F.col("line_count").alias("n_lines"), F.col("line_drops").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (
  SELECT k.*, coalesce(f.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_secrets": op5_secrets,
    "op6_pii": op6_pii,
    "op7_embeddings": op7_embeddings,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES: dict[str, str] = {
    "op1_mixing": _mixing.ORACLE,
    "op10_line_dedup": OP10_SQL,
}

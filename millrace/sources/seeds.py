"""CSV seeds with one-pass type inference."""

from __future__ import annotations

import csv
import hashlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ladder of types that a column may have, tried in this order; else string.
LADDER = (("boolean", r"(?i)true|false"), ("bigint", r"[+-]?\d{1,18}"), ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"))


def seed_hash(content: bytes) -> str:
    return "csv:" + hashlib.sha256(content).hexdigest()


def header(content: str) -> list[str]:
    return next(csv.reader(io.StringIO(content)), [])


def read_seed(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A CSV file with a header as a table.

    Every column gets the first type of the ladder boolean, bigint, double
    that all its values match, else string; empty values are null, and a column
    without values is a string.  One aggregation looks at all columns at once.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue="", emptyValue="")
    if not infer or not raw.columns:
        return raw
    checks = [F.coalesce(F.bool_and(F.trim(F.col(f"`{c}`")).rlike(f"^(?:{pattern})$")), F.lit(False)).alias(f"{i}:{kind}") for i, c in enumerate(raw.columns) for kind, pattern in LADDER]
    fits = raw.agg(*checks).first()
    columns = []
    for i, c in enumerate(raw.columns):
        kind = next((k for k, _ in LADDER if fits[f"{i}:{k}"]), None)
        column = F.col(f"`{c}`")
        columns.append((F.trim(column).cast(kind) if kind else column).alias(c))
    return raw.select(*columns)
